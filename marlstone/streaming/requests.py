"""Requests that arrive as a stream of text rows, each executed once and in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marlstone.engine import Engine
from marlstone.errors import EngineError


def execute_stream(engine: Engine, requests: DataFrame, checkpoint: str, order: str = "n", text: str = "request", failed: Callable[[str, EngineError], None] | None = None) -> StreamingQuery:
    """``requests``: a streaming DataFrame with a number and a text. A batch's requests run by number.

    Spark repeats a batch that it isn't sure of. Each request's place, the batch and its number in it,
    is committed with its changes, so a repeated one is passed over; with a catalog in a root folder
    that holds after a crash too. A request at fault ends the stream, or goes to ``failed`` and counts
    as done. A batch is a few texts that someone typed, not data; it comes to the driver, which plans them.
    """

    def run(batch: DataFrame, number: int) -> None:
        for k, row in enumerate(batch.orderBy(order, text).toLocalIterator()):
            if engine.catalog.marks.get(checkpoint, [-1, -1]) >= [number, k]:
                continue
            mark = {checkpoint: [number, k]}
            try:
                engine.execute(row[text], marks=mark)
            except EngineError as e:
                if failed is None:
                    raise
                failed(row[text], e)
                engine.catalog.install({}, mark)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
