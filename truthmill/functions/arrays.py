"""Small array-expression helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``.

    Catalyst may copy a repeated sub-expression into every lambda that mentions it;
    binding it as the element of a one-element array keeps it to one evaluation.
    """
    return F.transform(F.array(value), body)[0]


def keep(tokens: Column, predicate: Callable[[Column], Column]) -> Column:
    """Tokens that satisfy the predicate; removed ones leave no trace."""
    return F.filter(tokens, predicate)


def blank_out(tokens: Column, predicate: Callable[[Column], Column]) -> Column:
    """Tokens that satisfy the predicate; removed ones stay as null, keeping positions."""
    return F.transform(tokens, lambda t: F.when(predicate(t), t))


def run_lengths(tokens: Column) -> Column:
    """``array<struct<word, tf>>`` of a token array: a bag of words without a shuffle.

    The array is sorted inside the row and equal neighbours are counted, so a
    document's bag never leaves its task.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        counted = let(
            starts,
            lambda st: F.transform(
                st,
                lambda begin, k: F.struct(
                    F.get(s, begin).alias("word"),
                    (F.coalesce(F.get(st, k + 1), n) - begin).cast("long").alias("tf"),
                ),
            ),
        )
        return F.when(n > 0, counted)

    return let(F.sort_array(tokens), runs)
