"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))


def oxford(items: Column, comma_for_two: bool = False) -> Column:
    """'a', 'a and b' (or 'a, and b'), 'a, b, and c'."""
    n, last = F.size(items), F.element_at(items, -1)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    two = F.concat(head, F.lit(", and " if comma_for_two else " and "), last)
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, two).otherwise(F.concat(head, F.lit(", and "), last))


def article(word: Column) -> Column:
    return F.when(F.rlike(F.lower(word), F.lit("^[aeiou]")), "an").otherwise("a")


def half_centimetres(mm: Column) -> Column:
    """Millimetres in centimetres to the nearest half, ties to even."""
    return F.bround(mm / 10 * 2) / 2


def present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)
