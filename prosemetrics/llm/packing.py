"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. Pieces of more than half of it
open a sequence each, since no two of them share one. Then come rounds. Pieces without a
place and the gaps of sequences are range-sorted by size, ties by id, so that a common
size spreads over many ranges. Read in that order, a gap takes the nearest piece before it
that is still free: the largest that fits; a piece goes to its successor among the gaps,
and where several want the same one their rank decides, as brackets match. Every task
sweeps its own range; what stays open there carries a level, the sum of pieces minus gaps
of the ranges before, and matches by level across ranges. Gaps are updated and the next
round begins. If no piece fits any gap, as many sequences are opened as the rest of the
pieces must have.

A gap that could hold several of the largest free pieces offers as many slots, so rounds
do not grow with the number of pieces a sequence holds. The driver sees counts only.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, written
from .hashing import slices

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
#: Pieces and gaps that a task sweeps.
RANGE = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of other characters, and words that might hold a special token, go through the library itself.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]+\Z")
#: White space for str.split() but not for the tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Pool:
    """Arrays of ids, one after the other, each found by its number."""

    def __init__(self):
        self.flat, self.first, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(flat)
        self.flat, self.first, self.size = self._grown(self.flat, used), self._grown(self.first, n), self._grown(self.size, n)
        self.flat[self.used : used] = flat
        self.size[self.n : n] = sizes
        self.first[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the arrays of these numbers, in a row, and the size of each."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.first[numbers] - (ends - sizes), sizes)
        return self.flat[at], sizes


class WordEncoder:
    """Token ids of whole texts, word by word: this vocabulary never joins across white space.

    Keeps the ids of words it has met, up to ``room`` of them; when they become more, those
    stay that were met again. Texts or words with unusual characters go through the
    library unchanged, so ids always equal its own.
    """

    def __init__(self, path: str, room: int = 500_000):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)  # no normaliser, no splitting: one piece is one BPE input
        self.room = room
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(0x100, 0x200))
        self.bytes = {b: chr(b if b in keep else next(spare)) for b in range(256)}
        self.words, self.word_ids, self.again = {}, Pool(), np.zeros(room + 1, bool)
        self.pieces, self.piece_ids = {}, Pool()

    def _forget(self) -> None:
        """Forgets the words that were met in one batch only, or all if too many would stay."""
        keep = np.flatnonzero(self.again[: len(self.words)])
        keep = keep if len(keep) <= self.room // 2 else keep[:0]
        names = list(self.words)
        flat, sizes = self.word_ids.take(keep)
        self.words, self.word_ids = {names[i]: k for k, i in enumerate(keep.tolist())}, Pool()
        self.word_ids.add(flat, sizes)
        self.again[:] = False
        self.pieces, self.piece_ids = {}, Pool()

    def _whole(self, text: str) -> list[int]:
        return self.full.encode(text, add_special_tokens=False).ids

    def _learn_pieces(self, found: list[str]) -> None:
        table = self.bytes
        for p in found:
            self.pieces[p] = len(self.pieces)
        coded = [p if p.isascii() else "".join([table[b] for b in p.encode()]) for p in found]
        out = self.bare.encode(coded, is_pretokenized=True, add_special_tokens=False)
        owner = np.array(out.word_ids, np.int64)
        self.piece_ids.add(np.array(out.ids, "<u4"), np.bincount(owner, minlength=len(found)))

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if (w.isascii() and w.isprintable() or _PLAIN.match(w)) and "<|" not in w]
        found = _PIECES.findall(unicodedata.normalize("NFC", "\n".join([*plain, ""])).lower())
        fresh = [p for p in dict.fromkeys(found) if p not in self.pieces and p != "\n"]
        if fresh:
            self._learn_pieces(fresh)
        numbers = np.fromiter(map(self.pieces.get, found, itertools.repeat(-1)), np.int64, len(found))
        ends = np.flatnonzero(numbers < 0)
        each = np.diff(ends, prepend=-1) - 1
        flat, sizes = self.piece_ids.take(numbers[numbers >= 0])
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(each)])]
        for w in plain:
            self.words[w] = len(self.words)
        self.word_ids.add(flat, np.diff(upto))
        taken = set(plain)
        for w in new:
            if w not in taken:
                ids = np.array(self._whole(w), "<u4")
                self.words[w] = len(self.words)
                self.word_ids.add(ids, np.array([len(ids)]))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids a text (null: empty)."""
        odd = {i for i, t in enumerate(texts) if t and any(c in t for c in _ODD)}
        split = pc.utf8_split_whitespace(pa.array([t if t and i not in odd else "" for i, t in enumerate(texts)], pa.large_string()))
        coded = split.flatten().dictionary_encode()  # each word of the batch is looked up once
        every, places = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        numbers = np.fromiter(map(self.words.get, every, itertools.repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            if len(self.words) + len(missing) > self.room and self.words:
                self.again[numbers[numbers >= 0]] = True
                self._forget()
                numbers = np.fromiter(map(self.words.get, every, itertools.repeat(-1)), np.int64, len(every))
                missing = np.flatnonzero(numbers < 0)
            self.again = Pool._grown(self.again, len(self.words) + len(missing))
            self.again[numbers[numbers >= 0]] = True
            self._learn([every[i] for i in missing])
            numbers[missing] = [self.words[every[i]] for i in missing]
        flat, sizes = self.word_ids.take(numbers[places])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [np.array(self._whole(texts[i]), "<u4") if i in odd else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]


#: Bytes of text that are encoded at once.
SLICE = 3_000_000


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document (its ids, then ``END``)."""
    path = path or tokenizer_path()

    def run(batches):
        encode = _encoder(path)
        end = np.array([END], "<u4")
        for whole in batches:
            texts, docs_of = whole.column("text"), whole.column("doc_id").to_pylist()
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(docs_of[a:b], encode(texts.slice(a, b - a).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for column, value in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes()))):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pieces and of the gaps that take them, among rows in order of size; gap: whether a row is one.

    A gap takes the nearest free piece before it. The rows left over are gaps first, then pieces.
    """
    depth = np.cumsum(np.where(gap, -1, 1))
    level = depth + gap
    order = np.argsort(level, kind="stable")
    here = level[order]
    met = np.flatnonzero((here[1:] == here[:-1]) & ~gap[order[:-1]] & gap[order[1:]])
    return order[met], order[met + 1]


_SWEPT = "piece long, length long, seq long, slot int, gap long, part int, nth long"


def _range_sweep(batches):
    """The rows of one range, sorted: what matches inside it, then what stays open (piece or seq is null) with its rank."""
    tables = list(batches)
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    gap = np.asarray(t["is_gap"])
    pieces, gaps = sweep(gap)
    rest = np.ones(len(gap), bool)
    rest[pieces] = rest[gaps] = False
    left_gaps, left = np.flatnonzero(rest & gap), np.flatnonzero(rest & ~gap)
    ids, size, slot, room = t["id"], t["size"], t["slot"], t["gap"]
    part = TaskContext.get().partitionId()
    none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
    yield from pa.table({"piece": ids.take(pieces), "length": size.take(pieces), "seq": ids.take(gaps), "slot": slot.take(gaps), "gap": room.take(gaps), "part": none(len(pieces), pa.int32()), "nth": none(len(pieces))}).to_batches(50_000)
    for at, is_gap in ((left_gaps, True), (left, False)):
        n, mine = len(at), ids.take(at)
        yield from pa.table(
            {"piece": none(n) if is_gap else mine, "length": none(n) if is_gap else size.take(at), "seq": mine if is_gap else none(n), "slot": slot.take(at) if is_gap else none(n, pa.int32()),
             "gap": room.take(at) if is_gap else none(n), "part": pa.array(np.full(n, part, np.int32)), "nth": pa.array(np.arange(n))}
        ).to_batches(50_000)


def _across(swept: DataFrame) -> DataFrame:
    """What stays open in the ranges, matched across them: piece, length, seq, slot, gap; seq is null if the piece stays free."""
    open_ = swept.filter("part is not null")
    per = open_.groupBy("part").agg(F.count("piece").alias("pieces"), F.count("seq").alias("gaps"))
    before = F.coalesce(F.sum(F.col("pieces") - F.col("gaps")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = written(per.select("part", "gaps", before.alias("before")))  # one row a range
    level = F.when(F.col("piece").isNull(), F.col("before") - F.col("nth")).otherwise(F.col("before") - F.col("gaps") + F.col("nth") + 1)
    leveled = open_.join(F.broadcast(per), "part").withColumn("level", level)
    ahead = Window.partitionBy("level").orderBy("part", F.col("piece").isNotNull())  # two rows a range at most
    met = lambda c: F.lead(c).over(ahead).alias(c)
    # A gap is ahead of a piece, or nothing is: two pieces of a level have a gap between them.
    return leveled.select("piece", "length", met("seq"), met("slot"), met("gap")).filter("piece is not null")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (pieces, written, with a number of their own in ``row``) with sequence_id and offset, without ``row``.

    Empty table: no rows.
    """
    spark = table.sparkSession
    large = F.col("length") * 2 > capacity
    items = table.select(F.col("row").alias("piece"), "length")
    done = [items.filter(large).select("piece", F.col("piece").alias("seq"), F.lit(0).cast("long").alias("offset"))]
    gaps = items.filter(large & (F.col("length") < capacity)).select(F.col("piece").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap"))
    free, opened, old = items.filter(~large), 0, []
    while True:
        n, total, least, most = free.agg(F.count("*"), F.sum("length"), F.min("length"), F.max("length")).first()
        if not n:
            break
        gaps = gaps.filter(F.col("gap") >= least)
        n_gaps, widest = gaps.agg(F.count("*"), F.max("gap")).first()
        if not n_gaps:
            n_gaps = -(-total // capacity)
            gaps = spark.range(opened, opened + n_gaps).select((-1 - F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            opened += n_gaps
        each = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / most), F.lit(-(-2 * n // n_gaps)))).cast("int")
        slots = gaps.withColumn("each", each).select("seq", "gap", F.floor(F.col("gap") / F.col("each")).alias("size"), F.explode(F.sequence(F.lit(0), F.col("each") - 1)).alias("slot"))
        rows = free.select(F.col("length").alias("size"), F.lit(False).alias("is_gap"), F.col("piece").alias("id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("gap"))
        rows = rows.unionByName(slots.select("size", F.lit(True).alias("is_gap"), F.col("seq").alias("id"), "slot", "gap"))
        ranges = -(-(n + min(2 * n + n_gaps, n_gaps * capacity)) // RANGE)
        order = ("size", "is_gap", "id", "slot")
        ranged = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
        swept = written(ranged.sortWithinPartitions(*order).mapInArrow(_range_sweep, _SWEPT))
        rest = written(_across(swept)) if ranges > 1 else swept.filter("part is not null and piece is not null").drop("part", "nth")
        fitted = swept.filter("part is null").drop("part", "nth").unionByName(rest.filter("seq is not null"))
        sums = Window.partitionBy("seq")
        upto = sums.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        # The sequence's own row comes first and keeps what is left of its gap.
        both = fitted.unionByName(gaps.select(F.lit(None).cast("long").alias("piece"), F.lit(0).cast("long").alias("length"), "seq", F.lit(-1).alias("slot"), "gap"))
        updated = written(both.select("piece", "seq", (F.lit(capacity) - F.col("gap") + F.coalesce(F.sum("length").over(upto), F.lit(0))).alias("offset"), (F.col("gap") - F.sum("length").over(sums)).alias("gap")))
        done.append(updated.filter("piece is not null").select("piece", "seq", "offset"))
        gaps = updated.filter("piece is null").select("seq", "gap")
        free = rest.filter("seq is null").select("piece", "length")
        old.append(swept)
    places = functools.reduce(DataFrame.unionByName, done).select(F.col("piece").alias("row"), F.col("seq").alias("sequence_id"), "offset")
    placed = written(table.join(places, "row").drop("row"))
    for t in old:
        remove(t)
    return placed


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty (one piece, the end id alone). Repeated rows are packed
    each for itself; null ids stay null. Empty table: no rows. Columns of ``docs`` other
    than doc_id and text do not matter.
    """
    return pack(written(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id())), capacity)
