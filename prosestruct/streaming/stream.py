"""Documents are independent of each other, so a stream of them goes through the same transforms, without state.

Row-wise operators (gates, the plain decomposer, functions of texts and tokens) run on the stream itself, in append mode.
Those that number sentences or aggregate a document are applied to each micro-batch, which holds whole documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import lexical_density, readability
from ..operators.decompose import plain
from ..plans.engine import Engine
from ..sources.ingest import gate, split_errors


def paragraph_stream(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs with the formulas of readability and lexical density, errors) of a stream of plain documents."""
    good, errors = split_errors(gate(raw, ("plain",)))
    rows = plain(good)
    return rows.withColumn("grade", readability(rows.text)).withColumn("density", lexical_density(rows.text)), errors


def analyze_stream(raw: DataFrame, engine: Engine, write: Callable[[DataFrame, DataFrame, int], None]) -> DataStreamWriter:
    """A writer that analyses each micro-batch and hands its documents and errors to `write` with the batch's number."""

    def batch(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        try:
            write(*engine.analyze(kept), number)
        finally:
            kept.unpersist()

    return raw.writeStream.foreachBatch(batch)
