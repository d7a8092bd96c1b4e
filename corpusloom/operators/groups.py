"""Groups of rows in Arrow tasks, and hot groups cut into parts that all meet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger groups are cut into parts of about so many, and every two parts meet in a task of their own.
PART = 2048


def by_group(keys: int, fn: Callable[[pa.Table], Iterable[pa.RecordBatch]]):
    """For mapInArrow over rows sorted by their first columns: fn on the rows of several groups at once, never on a part of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            if held and any(c[0] != x for c, x in zip(columns, last)):
                yield from fn(pa.Table.from_batches(held))
                held = []
            last = [c[-1] for c in columns]
            other = np.flatnonzero(np.logical_or.reduce([c != x for c, x in zip(columns, last)]))
            s = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if s:
                yield from fn(pa.Table.from_batches([*held, batch.slice(0, s)]))
                held = []
            held.append(batch.slice(s))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return run


def bounds(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of rows with equal first columns begin, and end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], table.num_rows)


def part_of(size: Column, key: str, most: int) -> tuple[Column, Column]:
    """(parts, part) of a member of a group of this size."""
    parts = F.ceil(size / most).cast("int")
    return parts.alias("parts"), F.when(parts > 1, F.pmod(F.xxhash64(key), parts)).otherwise(0).cast("int").alias("part")


def meeting(parts: Column, part: Column) -> Column:
    """The tasks (x, y) to which a part goes: every two parts meet in one, and each with itself in (x, x)."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least(part, q).alias("x"), F.greatest(part, q).alias("y")))
