"""Vectors of whole numbers in blocks, and a stated set of asking rows in chunks, scored block by chunk.

A block is one row: the ids, labels and vectors of up to ``BLOCK`` rows of the table, cut
where they are read, so that no vector is shuffled and no key can make a block large. A
chunk is one row too: up to about ``CHUNK`` asking rows with what is asked of them, dealt by
a hash. Every block meets every chunk: chunks are broadcast where they are proven small,
else the blocks travel to them. Tasks add up what they find for a chunk before they send it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block, asking rows of a chunk, of which so many are scored at once; bytes of chunks that may be broadcast.
BLOCK, CHUNK, AT_ONCE, BROADCAST = 4_096, 4_096, 128, 32 << 20
#: Chunks that a task adds up before it sends what it has.
HELD = 8
#: Largest squared length of a scaled vector: beyond it scores need not fit 64 bits. Up to EXACT, doubles hold them exactly.
LONGEST, EXACT = 1 << 61, 1 << 53


def usable(table: DataFrame, scale: int, *more: str) -> DataFrame:
    """vec_id, vec (floor(scale * x) of each component, as longs) and further columns of the rows that take part.

    Left out: null ids; vectors that are null, empty, hold a null or non-finite component, or
    are so long that scores would not fit a long; vectors of another width than most (ties:
    the smallest width) and rows with a null in a further column.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**31)) & (F.size("x") > 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *more).dropna()
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("vec"), *more)
    return rows.filter(squared() <= LONGEST)


def squared() -> Column:
    return F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


class Shape:
    """How the vectors of a table are held: all that tasks need to know of it."""

    def __init__(self, width: int, bound: int):
        self.width, self.exact, self.kind = width, bound < EXACT, np.int16 if bound < 1 << 28 else np.int64

    def numbers(self, raw: bytes) -> np.ndarray:
        """A row a vector; as doubles where every score is exact in them, else as longs."""
        x = np.frombuffer(raw, self.kind).reshape(-1, self.width)
        return x.astype(float if self.exact else np.int64)


class Blocks:
    """The rows of :func:`usable` in blocks: ``rows`` (ids, labels, vectors), how many, how wide, how long at most."""

    def __init__(self, rows: DataFrame, label: str | None = None):
        kinds = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.max(squared()).alias("most"))
        most = kinds.orderBy(F.desc("n"), "width").limit(1).collect()  # one row
        self.width, self.n, longest = (most[0]["width"], most[0]["n"], most[0]["most"]) if most else (0, 0, 0.0)
        self.bound = math.isqrt(math.ceil(longest)) ** 2 + 2 * math.isqrt(math.ceil(longest)) + 1
        self.shape = Shape(self.width, self.bound)
        self.vectors = rows.filter(F.size("vec") == self.width)
        kind = self.shape.kind

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(kind)
                    columns = [b.column("vec_id").to_numpy().tobytes(), b.column("label").to_numpy().tobytes(), x.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["ids", "labels", "vectors"])

        read = self.vectors.select("vec_id", (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("label"), "vec")
        self.rows = written(read.mapInArrow(cut, "ids binary, labels binary, vectors binary"))

    def packed(self) -> Column:
        """A vector as bytes."""
        kind = self.shape.kind

        def pack(vec: pd.Series) -> pd.Series:
            return vec.map(lambda v: np.asarray(v, kind).tobytes())

        pack.__annotations__ = {"vec": pd.Series, "return": pd.Series}
        return F.pandas_udf(pack, "binary")("vec")

    def dealt(self, asking: DataFrame, n: int, key: Column) -> DataFrame:
        """``asking`` (n rows) with the number of its chunk."""
        return asking.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(n / CHUNK)))).cast("int"))

    def meet(self, asking: DataFrame, n: int, rows_each: int = 1) -> DataFrame:
        """Every block beside every chunk of ``asking`` (a row a question, with its ``chunk``): n asking rows at most."""
        chunks = max(1, math.ceil(n / CHUNK))
        held = asking.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in asking.columns if c != "chunk"])).alias("asked"))
        small = n * rows_each * (self.width * np.dtype(self.shape.kind).itemsize + 80) <= BROADCAST
        to = self.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return to.join(F.broadcast(held) if small else held, "chunk").select("chunk", "ids", "labels", "vectors", "asked")

    def run(self, met: DataFrame, state: Callable, add: Callable, send: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
        """What each task finds: ``state(asked)`` once a chunk, ``add(state, ids, labels, vectors)`` a block, ``send(state)``."""

        shape = self.shape

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states: dict[int, object] = {}
            for b in batches:
                for i in range(b.num_rows):
                    chunk = b.column("chunk")[i].as_py()
                    if chunk not in states:
                        while len(states) >= HELD:
                            yield pa.RecordBatch.from_pydict(send(states.pop(next(iter(states)))), arrow)
                        states[chunk] = state(b.column("asked")[i].values)
                    ids, labels, vectors = (b.column(c)[i].as_py() for c in ("ids", "labels", "vectors"))
                    add(states[chunk], np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), shape.numbers(vectors))
            for s in states.values():
                yield pa.RecordBatch.from_pydict(send(s), arrow)

        return met.mapInArrow(task, schema)


def asked_column(asked: pa.StructArray, name: str) -> np.ndarray:
    return asked.field(name).to_numpy(zero_copy_only=False)


class Best:
    """The k best (score, ties to the smaller id) of each question, as far as a task has seen."""

    def __init__(self, k: int):
        self.k, self.found = k, [np.zeros((0, 3), np.int64)]

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(question):
            self.found.append(self.cut(np.column_stack([question, score, ids])))
            if len(self.found) > 64:
                self.found = [self.cut(np.vstack(self.found))]

    def cut(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[np.arange(len(rows)) - first < self.k]

    def rows(self) -> np.ndarray:
        return self.cut(np.vstack(self.found))


FOUND, FOUND_ARROW = "question long, score long, vec_id long", pa.schema([("question", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def sent(best: Best) -> dict[str, np.ndarray]:
    return dict(zip(("question", "score", "vec_id"), best.rows().T))


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each question, with their ``rank`` from 1."""
    order = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
