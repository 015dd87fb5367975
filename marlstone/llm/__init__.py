"""Training-data operators: scoring, deduplication, tokenising, filtering and packing of a text corpus.

Nothing else in the library imports this subpackage; ``queries.py`` lists what it registers.
"""
