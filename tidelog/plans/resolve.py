"""Latest-version-wins: the view of a version log that readers see.

For a key: highest seq; then a tombstone before a value; then the row applied first. A winner that is a
tombstone hides the key. Predicates on the key may go below (Catalyst pushes them); predicates on values
must stay above, or they would bring old versions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ, TOMB, ORD, DELETED_AT = "_seq", "_tombstone", "_ord", "_deleted_at"
META = (SEQ, TOMB, ORD, DELETED_AT)


def winners(log: DataFrame, key: str | list[str], seq: str | Column = SEQ, tombstone: str | Column = TOMB, ord_: str | Column = ORD) -> DataFrame:
    """One row per key, tombstones included. One exchange on the key; rank 1 is pruned before it, too."""
    keys = [key] if isinstance(key, str) else list(key)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*keys).orderBy(col(seq).desc(), col(tombstone).desc(), col(ord_).asc())
    return log.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def live(log: DataFrame, key: str | list[str], seq: str | Column = SEQ, tombstone: str | Column = TOMB, ord_: str | Column = ORD) -> DataFrame:
    """The visible rows."""
    col = F.col(tombstone) if isinstance(tombstone, str) else tombstone
    return winners(log, key, seq, tombstone, ord_).filter(~col)


def key_range(df: DataFrame, key: str, start=None, end=None, ordered: bool = True) -> DataFrame:
    """Half-open [start, end); None leaves a side open."""
    if start is not None:
        df = df.filter(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(key) < F.lit(end))
    return df.orderBy(key) if ordered else df
