"""Documents that arrive as a stream.

The engine itself is batch: it evaluates a fixed set of documents. What can be said of one document without the others,
its errors and its chunks, holds for a stream as it does for a table, as both are row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalloom.operators import corpus


def validated_stream(documents: DataFrame, suites: DataFrame) -> DataFrame:
    """A stream of documents with their errors; `suites` is a table."""
    return corpus.validate(documents, suites)


def chunk_stream(documents: DataFrame, suites: DataFrame) -> DataFrame:
    """The chunks of the valid documents of a stream."""
    return corpus.chunk(validated_stream(documents, suites).where("valid"))
