"""Joins of documents with tables of few columns, whose sizes are known only when they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of ids (and a short word) that are broadcast, at most: some tens of MB.
MOST_BROADCAST = 500_000


def sized(written: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small enough; if not, both sides are shuffled by id.

    The result of the join is the same, but without a broadcast the documents' texts move too.
    """
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written
