"""Column expressions over arrays and long strings whose work grows no faster than a sort's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op: Callable[[Column, Column], Column], backward: bool = False) -> Column:
    """For each item of an array ``op`` (associative) over all up to it, or with ``backward`` from it on; by doubling,
    as an accumulator that an item is appended to is copied for each."""

    def doubled(own: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)

        def one(x: Column, i: Column) -> Column:
            other = F.get(own, i + step if backward else i - step)
            return F.when(other.isNull(), x).otherwise(op(x, other))

        return F.transform(own, one)

    def run(own: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(own), F.lit(2)))).cast("int") - 1)
        return F.when(F.size(own) > 1, F.aggregate(steps, own, doubled)).otherwise(own)

    return let(values, run)


def blocks_of(text: Column, size: int) -> Column:
    """A text's runs of ``size`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def between(blocks: Column, size: int, start: Column, stop: Column) -> Column:
    """Code points [start, stop) of a text given by its blocks: a place is found within a block, not from the
    beginning of the text."""
    first, last = F.floor(start / size).cast("int"), F.floor((stop - 1) / size).cast("int")
    inside = lambda i, low, n: F.substr(F.get(blocks, i), (low + 1).cast("int"), n.cast("int"))
    one = inside(first, start - first * size, stop - start)
    whole = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    many = F.concat(inside(first, start - first * size, F.lit(size)), whole, inside(last, F.lit(0), stop - last * size))
    return F.when(stop <= start, "").when(first == last, one).otherwise(many)
