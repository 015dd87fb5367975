"""A SQL engine for a compact relational dialect on PySpark, with operators for training-data corpora."""
