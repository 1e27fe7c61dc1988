"""Array expressions whose cost grows with the length of the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import right_part

#: Elements summed one by one; longer prefixes start at the sum of the groups before.
GROUP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it.

    A projection of its own would not do: the optimizer merges projections and then repeats the
    expression inside every lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def running_starts(lengths: Column) -> Column:
    """For each element the sum of those before it."""

    def sums(n: Column) -> Column:
        groups = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.floor((F.size(n) - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
        base = F.aggregate(
            F.transform(groups, lambda g: _total(F.slice(n, g * GROUP + 1, F.lit(GROUP)))), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        place = lambda b, i: b[F.floor(i / GROUP).cast("int")] + _total(F.slice(n, F.floor(i / GROUP).cast("int") * GROUP + 1, F.pmod(i, F.lit(GROUP))))
        return let(base, lambda b: F.transform(n, lambda _, i: place(b, i)))

    return let(lengths, sums)


def with_overlap(extracts: Column, overlap: Column, least: Column) -> Column:
    """Each extract behind the last ``overlap`` characters of what stands before it.

    No extract but the last is shorter than ``least``, which bounds how far to look back.
    """

    def pieces(all_: Column) -> Column:
        def back(i: Column, n: Column) -> Column:
            n = F.least(n, i)
            return F.array_join(F.slice(all_, i - n + 1, n), "")

        def piece(x: Column, i: Column) -> Column:
            most = F.ceil(overlap / least).cast("int")
            tail = F.when((i == 0) | (overlap <= 0), F.lit(""))
            # Mostly the extract before is long enough.
            tail = tail.when(F.length(all_[i - 1]) >= overlap, right_part(all_[i - 1], overlap))
            few = let(back(i, F.lit(4)), lambda t: F.when(F.length(t) >= overlap, right_part(t, overlap)))
            return F.concat(F.coalesce(tail.otherwise(few), right_part(back(i, most), overlap)), x)

        return F.transform(all_, piece)

    return let(extracts, pieces)
