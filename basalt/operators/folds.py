"""Ordered folds: a small state goes over the rows of each key in order, in Arrow batches of a sorted partition.

Only the state is held, never a key's rows, so a key may have any number of them; its rows do pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Fold:
    """Takes the rows of one key in order. ``step`` and ``close`` give rows of the result, without the key."""

    def step(self, *row) -> Iterable[tuple]:
        return ()

    def close(self) -> Iterable[tuple]:
        return ()


def folded(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], schema: str, size: int = 8192) -> DataFrame:
    """Rows (keys..., then ``schema``) that a fold made for each key gives on the other columns of ``rows``, in their order."""
    others = [c for c in rows.columns if c not in keys]
    out = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(schema).fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        held: list[tuple] = []
        key, fold = None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

        for rb in batches:
            for row in zip(*(c.to_pylist() for c in rb.columns)):
                if fold is None or row[:n] != key:
                    if fold is not None:
                        held += [key + r for r in fold.close()]
                    key, fold = row[:n], make()
                held += [key + r for r in fold.step(*row[n:])]
            if len(held) >= size:
                yield batch()
        if fold is not None:
            held += [key + r for r in fold.close()]
        if held:
            yield batch()

    return rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class Greedy(Fold):
    """Of spans (first, end, others...) in order, the others of those that begin where the last kept one has ended, or later.

    ``most`` is how many of the others are given.
    """

    def __init__(self, most: int | None = None):
        self.upto, self.most = None, most

    def step(self, first, end, *row) -> Iterable[tuple]:
        if self.upto is None or first >= self.upto:
            self.upto = end
            yield row[: self.most]


class Anchored(Fold):
    """Windows (anchor, n, last) of rows (ts, id, us): each begins with the first row more than ``width`` after the last one's begin."""

    def __init__(self, width: int):
        self.width, self.now = width, None

    def step(self, ts, id_, us) -> Iterable[tuple]:
        if self.now is None or us - self.now[1] > self.width:
            yield from self.close()
            self.now = [ts, us, 0, id_]
        self.now[2] += 1
        self.now[3] = max(self.now[3], id_)

    def close(self) -> Iterable[tuple]:
        if self.now:
            yield self.now[0], self.now[2], self.now[3]


class Digest(Fold):
    """SHA-1 of texts in order, joined by ``between``, and their number."""

    def __init__(self, between: str = "\n"):
        self.between, self.hash, self.n = between.encode(), hashlib.sha1(), 0

    def step(self, _order, text) -> Iterable[tuple]:
        if self.n:
            self.hash.update(self.between)
        self.hash.update((text or "").encode())
        self.n += 1
        return ()

    def close(self) -> Iterable[tuple]:
        yield self.hash.hexdigest(), self.n


class Nested(Fold):
    """For rows (place, level, name): the place of the nearest row before with a smaller level, the depth, and the names down to it."""

    def __init__(self):
        self.open: list[tuple[int, int, str]] = []

    def step(self, place, level, name, *rest) -> Iterable[tuple]:
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        parent = self.open[-1][1] if self.open else None
        self.open.append((level, place, name))
        yield (place, parent, len(self.open) - 1, [n for _, _, n in self.open], *rest)


def nested(rows: DataFrame, keys: list[str], place: str, level: str, name: str, *keep: str) -> DataFrame:
    """(keys..., place, parent, depth, path, keep...) of ``rows``: what each is under, by levels that grow inwards."""
    taken = rows.select(*keys, F.col(place).cast("long").alias("place"), F.col(level).cast("long").alias("level"), F.col(name).alias("name"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in taken.select(*keep).schema.fields)
    return folded(taken, keys, ["place"], Nested, f"place long, parent long, depth int, path array<string>{kept}")
