"""Joins of rows with the classes they belong to, where a class can hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a class above which it is broadcast instead of shuffled, and the most classes broadcast.
HOT_ROWS = 10_000
HOT_CLASSES = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], size: str, n: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``classes`` (one row per class, its rows counted in ``size``) by ``on``.

    ``n`` rows hold at most HOT_CLASSES classes of more than n / HOT_CLASSES rows.
    Those are broadcast, so that their rows stay where they are; the others meet
    by a shuffle.  ``classes`` should be a written table.
    """
    most = max(HOT_ROWS, n // HOT_CLASSES)
    big = classes.where(F.col(size) > most)
    if big.isEmpty():
        return rows.join(classes, on, how)
    rest = rows.join(F.broadcast(big.select(*on)), on, "left_anti").join(classes.where(F.col(size) <= most), on, how)
    return rest.unionByName(rows.join(F.broadcast(big), on))
