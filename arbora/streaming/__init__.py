"""Streams: changes that arrive as a stream are written to a graph batch by batch.

The language has no streaming operators of its own; a micro-batch is bound to a
parameterless statement as rows, through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stream(graph, stream: DataFrame, statement: str, checkpoint: str):
    """Run ``statement`` for every micro-batch; the batch's columns are its variables."""
    from arbora.plans.lower import Rows, read_by
    from arbora.plans.parser import parse

    clauses = parse(statement)["parts"][0]

    def one(batch: DataFrame, epoch: int) -> None:
        needs = read_by(clauses)
        needs.whole |= set(batch.columns)
        rows = Rows(graph, {}, needs, batch, list(batch.columns))
        rows.run(clauses)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
