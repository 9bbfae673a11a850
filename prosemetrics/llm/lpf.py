"""Exact-substring dedup by longest-previous-factor arrays, keeping the first copy.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier. Strings
are sorted in suffix order; for each, the nearest neighbours before and after it that
start at a smaller position (previous and next smaller positions) share the longest
prefixes with it that any earlier string can; the longer of the two is its longest
previous factor. A string whose factor is ``length`` or more goes.

The suffix order is built in buckets. The bucket of a string is that of its anchor, the
least hash among its ``GRAM``-byte grams, so equal strings always meet. Neighbouring
strings with the same anchor make a chunk. First chunks travel as the hash of their anchor
and a place: a chunk whose anchor stands nowhere else can't hold a repeated string. The
bytes of all others are fetched, compared and sorted; hashes alone decide nothing. Equal
chunks of one slice of documents are combined before the first shuffle, after comparing
their bytes. Anchors that a sample shows to be common are split into one chunk a string,
which spread by their own hash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import between, prefix, slices

LENGTH, GRAM = 100, 20
#: Bytes of text whose chunks share a bucket; bytes that a map step combines at once, and hashes at once.
BUCKET, SLICE, SEGMENT = 2_000_000, 2_000_000, 1_000_000
#: Anchors that this share of the documents holds, or this many of them, are split; the sample that finds them holds this many documents, and so many of each such anchor.
HOT_SHARE, HOT_ROWS, SAMPLE, SEEN = 0.004, 500_000, 2_000, 8
_LOW = np.uint64(0xFFFFFF)
_FIELDS = (("a", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "u1"))


def anchors(raw: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """The chunks of documents laid end to end in ``raw``: document, first string, strings, hash of the anchor, hash of the bytes."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if len(raw) > SEGMENT + length - 1:  # places must fit beside the hash; a chunk cut in two stays right
        ends, parts = np.cumsum(sizes), []
        for p in range(0, len(raw) - length + 1, SEGMENT):
            part = raw[p : p + SEGMENT + length - 1]
            found = anchors(part, np.diff(np.clip(ends, p, p + len(part)), prepend=p), length, gram)
            parts.append((found[0], found[1] + p, *found[2:]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    h = prefix(raw)
    place = np.arange(len(raw) - gram + 1)
    grams = between(h, place, place + gram)
    least = (grams & ~_LOW) | place.astype(np.uint64)  # the leftmost of equal ones
    width, span = length - gram + 1, 1
    whole = least
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(whole) - width + 1
    least = np.minimum(least[:n], least[width - span : width - span + n])
    anchor = (least & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + length <= np.repeat(np.cumsum(sizes), sizes)[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    count = np.bincount((np.cumsum(new & inside) - 1)[inside], minlength=len(first))
    return doc[first], first, count, grams[anchor[first]], between(h, first, first + count + length - 1)


def _chunks(ids: np.ndarray, texts: list[bytes], hot: np.ndarray, length: int) -> dict[str, np.ndarray]:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    doc, first, count, a, c = anchors(raw, sizes, length)
    if len(hot) and len(a):
        split = hot[np.searchsorted(hot, a).clip(0, len(hot) - 1)] == a
        if split.any():
            each = np.repeat(np.flatnonzero(split), count[split])
            step = np.arange(len(each)) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
            at = first[each] + step
            own = between(prefix(raw), at, at + length)
            doc, first, count = np.concatenate([doc[~split], doc[each]]), np.concatenate([first[~split], at]), np.concatenate([count[~split], np.ones(len(each), int)])
            a, c = np.concatenate([a[~split], own]), np.concatenate([c[~split], own])
    starts = np.cumsum(sizes) - sizes
    return {"a": a, "c": c, "doc": ids[doc] if len(doc) else doc, "start": first - starts[doc] if len(doc) else first, "n": count, "at": first}


def _earliest(x: dict[str, np.ndarray], raw: bytes, length: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """x sorted by (a, c, doc, start); whether a row's chunk, byte for byte, also starts earlier among these."""
    order = np.lexsort((x["start"], x["doc"], x["c"], x["a"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    same = np.zeros(n, bool)
    same[1:] = (x["a"][1:] == x["a"][:-1]) & (x["c"][1:] == x["c"][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n))) if n else np.zeros(0, int)
    later = same & ((x["doc"] != x["doc"][head]) | (x["start"] != x["start"][head]))
    rows = np.flatnonzero(later)
    size = (x["n"][rows] + length - 1).tolist()
    later[rows] = [raw[i : i + k] == raw[j : j + k] for i, j, k in zip(x["at"][rows].tolist(), x["at"][head[rows]].tolist(), size)]
    return x, later


def _join(rows: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k, _ in _FIELDS}
    width = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    for blob in rows:
        n, at = len(blob) // width, 0
        for k, t in _FIELDS:
            size = n * np.dtype(t).itemsize
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += size
    return {k: np.concatenate(v) if v else np.zeros(0, t) for (k, t), v in zip(_FIELDS, parts.values())}


def _pack(x: dict[str, np.ndarray], rows: np.ndarray) -> bytes:
    return b"".join(x[k][rows].astype(t).tobytes() for k, t in _FIELDS)


def spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same bytes as maximal runs, sorted; ends are exclusive."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    reach = np.concatenate([np.maximum.accumulate(e) for e in np.split(end, edges[1:])]) if len(edges) < 2000 else _reach(doc, end)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _reach(doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running maximum of end within each document."""
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64)
    top = int(end.max()) + 1
    return np.maximum.accumulate(rank * top + end) - rank * top


def suffix_ranks(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``at`` how many of them start a smaller string of ``length`` bytes; equal strings have equal ranks.

    Strings are sorted by eight bytes at a time, each time only those that are still equal.
    """
    rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
    width = min(8, length)
    for offset in [*range(0, length - width, width), length - width]:
        key = np.zeros(len(tied), np.uint64)
        for j in range(width):
            key = (key << np.uint64(8)) | raw[at[tied] + (offset + j)]
        was = rank[tied]
        order = np.lexsort((key, was)) if offset else np.argsort(key, kind="stable")
        tied, key, was = tied[order], key[order], was[order]
        group, own = np.ones(len(tied), bool), np.ones(len(tied), bool)
        group[1:] = was[1:] != was[:-1]
        own[1:] = group[1:] | (key[1:] != key[:-1])
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(own, place, 0))
        rank[tied] = was + first - np.maximum.accumulate(np.where(group, place, 0))
        tied = tied[~own | ~np.append(own[1:], True)]
        if not len(tied):
            break
    return rank


def shared_prefixes(raw: np.ndarray, at: np.ndarray, length: int, block: int = 20_000) -> np.ndarray:
    """How many bytes, ``length`` at most, the strings at these places share with the one before (the first: none)."""
    out = np.zeros(len(at), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else None
    for i in range(1, len(at), block):
        rows = windows[at[i - 1 : i + block]]
        differ = rows[1:] != rows[:-1]
        out[i : i + len(differ)] = np.where(differ.any(1), differ.argmax(1), length)
    return out


def smaller_before(position: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest row before it of a smaller position (-1: none), and the prefix that both share.

    shared: with the row before. A row points to the one before it; while that one's
    position isn't smaller, it takes over where that one points to.
    """
    at, common = np.arange(len(position)) - 1, shared.copy()
    open_ = np.arange(1, len(position))
    while len(open_):
        to = at[open_]
        more = (to >= 0) & (position[to] >= position[open_])
        open_, to = open_[more], to[more]
        common[open_] = np.minimum(common[open_], common[to])
        at[open_] = at[to]
    common[at < 0] = 0
    return at, common


def longest_previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of strings in suffix order: their positions, and the prefix each shares with the string before."""
    before = smaller_before(position, shared)[1]
    after = smaller_before(position[::-1], np.append(0, shared[:0:-1]) if len(shared) else shared)[1][::-1]
    return np.maximum(before, after)


def previous_factors(chunks: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings of these chunks whose longest previous factor is ``length`` or more."""
    if not len(chunks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + step
    doc, start = np.repeat(doc, n), np.repeat(start, n) + step
    order = np.lexsort((start, doc, suffix_ranks(raw, at, length)))
    at, doc, start = at[order], doc[order], start[order]
    by_place = np.lexsort((start, doc))
    new = np.ones(len(at), bool)
    new[1:] = (doc[by_place][1:] != doc[by_place][:-1]) | (start[by_place][1:] != start[by_place][:-1])
    position = np.empty(len(at), np.int64)
    position[by_place] = np.cumsum(new)  # rows of one id and start have the same position
    found = longest_previous_factors(position, shared_prefixes(raw, at, length)) >= length
    return doc[found], start[found]


def repeated_strings(chunks: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the runs of strings of a bucket's chunks that start earlier too.

    Equal chunks are neighbours throughout the suffix order, so only the first of them is
    sorted: the previous smaller position of any other's strings is that same string.
    """
    order = np.lexsort((start, doc))
    first: dict[bytes, int] = {}
    head = np.array([first.setdefault(chunks[i], i) for i in order], np.int64)
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    copies, once = order[later], np.fromiter(first.values(), np.int64, len(first))
    d, s = previous_factors([chunks[i] for i in once], doc[once], start[once], n[once], length)
    return spans(np.concatenate([doc[copies], d]), np.concatenate([start[copies], s]), np.concatenate([start[copies] + n[copies] + length - 1, s + length]))


def _hot_anchors(docs: DataFrame, rows: int, length: int) -> np.ndarray:
    """Hashes of the common anchors: at most as many as chunks there are divided by the rows that make an anchor common."""
    most = max(SEEN, min(HOT_SHARE * rows, HOT_ROWS))
    share = min(1.0, max(SAMPLE / max(1, rows), SEEN / most))
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil(share * (1 << 40))).select("id", "text")

    def run(batches):
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for i, j in slices([len(t) for t in texts], SLICE):
                sizes = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
                doc, _, _, a, _ = anchors(np.frombuffer(b"".join(texts[i:j]), np.uint8), sizes, length)
                pairs = np.unique(np.stack([a.view(np.int64), doc], 1), axis=0)[:, 0] if len(a) else np.zeros(0, np.int64)
                values, counts = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["a", "n"])

    found = sample.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(SEEN, share * most))
    return np.sort(np.array([r["a"] for r in found.select("a").collect()], np.int64).view(np.uint64))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, spans: for each document that loses bytes, [start, end) pairs of all its strings that start earlier too (not merged).

    docs: id (long, not null), text (not null).
    """
    total = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(16, math.ceil((total["bytes"] or 0) / BUCKET))
    hot = _hot_anchors(docs, total["rows"], length)
    tail = length - 1

    def combine(batches):
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            ids = np.asarray(b.column("id"))
            for i, j in slices([len(t) for t in texts], SLICE):
                x, later = _earliest(_chunks(ids[i:j], texts[i:j], hot, length), b"".join(texts[i:j]), length)
                bucket = (x["a"] >> np.uint64(33)).astype(np.int64) % buckets
                # What is decided here rides along in a bucket of its own document.
                bucket[later] = x["doc"][later] % buckets
                order = np.lexsort((bucket, later))
                cut = np.flatnonzero(np.diff(bucket[order] * 2 + later[order])) + 1
                groups = [g for g in np.split(order, cut) if len(g)]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), pa.array([bool(later[g[0]]) for g in groups], pa.bool_()), pa.array([_pack(x, g) for g in groups], pa.binary())], ["bucket", "later", "blob"])

    def decide(p: pd.DataFrame) -> pd.DataFrame:
        """The runs that are decided, and the chunks whose anchor stands in several."""
        gone, x = (_join(list(p["blob"][p["later"] == later])) for later in (True, False))
        doc, start, end = spans(gone["doc"], gone["start"], gone["start"] + gone["n"].astype(np.int64) + tail)
        _, group, times = np.unique(x["a"], return_inverse=True, return_counts=True)
        k = np.flatnonzero(times[group] > 1) if len(group) else np.zeros(0, int)
        return pd.DataFrame({"id": np.concatenate([doc, x["doc"][k]]), "a": np.concatenate([np.zeros(len(doc), np.int64), x["a"][k].view(np.int64)]), "start": np.concatenate([start, x["start"][k]]), "size": np.concatenate([end - start, x["n"][k].astype(np.int64)]), "open": np.concatenate([np.zeros(len(doc), bool), np.ones(len(k), bool)])})

    blobs = docs.mapInArrow(combine, "bucket long, later boolean, blob binary")
    decided = written(blobs.groupBy("bucket").applyInPandas(decide, "id long, a long, start long, size long, open boolean"))
    closed = decided.filter("not open").select("id", F.struct("start", (F.col("start") + F.col("size")).alias("end")).alias("span"))
    wanted = decided.filter("open").groupBy("id").agg(F.collect_list(F.struct("a", "start", "size")).alias("wanted"))  # at most a document's length a row

    def fetch(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text, rows in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for r in rows:
                    chunk = raw[r["start"] : r["start"] + r["size"] + tail]
                    if len(chunk) == r["size"] + tail:  # else it is of another row with this id
                        for column, value in zip(out, (r["a"], i, r["start"], r["size"], chunk)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["a", "id", "start", "size", "chunk"])

    fetched = docs.join(wanted.hint("shuffle_hash"), "id").select("id", "text", "wanted").mapInArrow(fetch, "a long, id long, start long, size long, chunk binary")

    def sort(p: pd.DataFrame) -> pd.DataFrame:
        doc, start, end = repeated_strings(list(p["chunk"]), p["id"].to_numpy(), p["start"].to_numpy(), p["size"].to_numpy(), length)
        return pd.DataFrame({"id": doc, "start": start, "end": end})

    opened = fetched.withColumn("bucket", F.pmod(F.shiftrightunsigned("a", 33), F.lit(buckets))).groupBy("bucket").applyInPandas(sort, "id long, start long, end long")
    opened = opened.select("id", F.struct("start", "end").alias("span"))
    return closed.unionByName(opened).groupBy("id").agg(F.collect_list("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes): one row a row of ``docs``.

    Null text counts as empty; null ids come before all others. Rows that share an id
    do not remove each other's bytes at the same place. Empty table: no rows.
    """
    least = F.lit(-(2**63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lost = repeated(rows, length)
    joined = rows.join(lost.hint("shuffle_hash"), "id", "left")

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text, found in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                start, end = (np.array([s[k] for s in found or ()], np.int64) for k in ("start", "end"))
                _, start, end = spans(np.zeros(len(start), np.int64), start, np.minimum(end, len(raw)))
                kept = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
                for column, value in zip(out, (i, len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)][: len(names)], names)

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    names = [x.split()[0] for x in kinds.split(", ")]
    done = joined.select("id", "text", "spans").mapInArrow(run, kinds)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
