"""Folds over arrays that collect as they go (native expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements appended to a short array before it is put away whole.
RUN = 128


def collected(
    items: Column, state: Column, step: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str,
    has: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """The array of ``made(state, item)`` of the items in order, ``step(state, item)`` being the next state.

    An append copies its array, so elements go to arrays of ``RUN`` and these to one
    of arrays: a fold over n items copies some n * (RUN + n / RUN) / 2 references. Items for which
    ``has`` is false make no element.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def merge(acc: Column, x: Column) -> Column:
        full = F.size(acc["cur"]) >= RUN
        cur = F.array_append(F.when(full, none).otherwise(acc["cur"]), made(acc["s"], x))
        out = F.when(full, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
        if has is not None:
            cur, out = F.when(has(acc["s"], x), cur).otherwise(acc["cur"]), F.when(has(acc["s"], x), out).otherwise(acc["out"])
        return F.struct(step(acc["s"], x).alias("s"), cur.alias("cur"), out.alias("out"))

    return F.aggregate(
        items, F.struct(state.alias("s"), none.alias("cur"), nothing.alias("out")), merge, lambda acc: F.flatten(F.array_append(acc["out"], acc["cur"]))
    )
