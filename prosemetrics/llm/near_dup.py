"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

A signature has ``BUCKETS`` registers. A register compresses the least hash of its bucket
to the number of leading zeros and ``MANTISSA`` bits behind them; an empty bucket borrows
the register of another by a fixed order of its own. Registers are banded; documents that
share a band are candidates. A pair's share of equal registers, corrected for chance
collisions, estimates its Jaccard similarity and drops hopeless pairs; the others are
compared on their whole sets.

Equal sets are one node. In each band, members are first compared with its smallest
member only, and components are formed. Where a band still holds several components, the
members outside its largest one are compared with the rest of the band, signatures first,
whole sets after; a task counts the shared shingles of a row with all others through a
sorted index and returns at most a spanning forest of links. So no group is expanded into
all its pairs, and no link that could join two components is lost.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written
from .hashing import mix, shingle_sets, slices

WORDS, PERCENT = 3, 85
BUCKETS, MANTISSA = 64, 10
_BITS = 64 - BUCKETS.bit_length() + 1  # of a hash behind its bucket
#: Pairs of sets of this size or more need an estimate within ``SLACK`` of the threshold (more than 4 standard deviations).
SURE, SLACK = 64, 0.25
#: Members of a band that one task holds; rows of them that are compared at once.
HELD, BLOCK = 4_096, 512
#: Characters of text that are hashed at once.
SLICE = 500_000

_ORDER = np.stack([np.random.default_rng(1000 + j).permutation(BUCKETS) for j in range(BUCKETS)])
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(_BITS)


def compress(rest: np.ndarray) -> np.ndarray:
    """Registers of least hashes (their bits behind the bucket): leading zeros, then MANTISSA bits."""
    top = np.frexp(rest.astype(float))[1].astype(np.int64)  # bit length; rounding up at a power of two is the same for equal values
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    bits = (rest >> shift).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (((_BITS - top).clip(0, 63) << MANTISSA) | bits).astype(np.uint16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of sorted distinct hashes (not empty)."""
    at = np.searchsorted(hashes, _EDGES)
    end = np.append(at[1:], len(hashes))
    full = at < end
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = compress(hashes[at[full]] - _EDGES[full])
    if not full.all():
        lend = _ORDER[np.arange(BUCKETS), full[_ORDER].argmax(1)]
        out[~full] = out[lend[~full]]
    return out


def band_rows(percent: int) -> int:
    """Registers a band: as many as leave a pair at the threshold a chance below 1e-5 of sharing no band, 4 at most."""
    share = percent / 100
    return next((r for r in (4, 3, 2) if (1 - share**r) ** (BUCKETS // r) < 1e-5), 1)


def bands(signatures: np.ndarray, rows: int = 4) -> np.ndarray:
    """A key for each band of each signature."""
    n = BUCKETS // rows
    parts = signatures[:, : n * rows].reshape(-1, n, rows).astype(np.uint64)
    packed = (parts << (np.uint64(16) * np.arange(rows, dtype=np.uint64))).sum(2, dtype=np.uint64)
    return mix(packed + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


@functools.lru_cache(maxsize=4096)
def _chance(log_n: int, log_m: int) -> float:
    """The chance that registers of unrelated sets of 2 ** (log / 2) members agree."""
    lead = np.arange(0, 40)[:, None]
    low = 2.0 ** -(lead + 1.0) * (1 + np.arange(1 << MANTISSA)[None] / (1 << MANTISSA))
    high = low + 2.0 ** -(lead + 1.0) / (1 << MANTISSA)
    of = lambda n: np.exp(-low * n) - np.exp(-high * n)
    return float((of(2 ** (log_n / 2) / BUCKETS) * of(2 ** (log_m / 2) / BUCKETS)).sum())


def estimate(equal, n: int, m: int):
    """Jaccard similarity from how many registers agree, corrected for chance collisions."""
    c = _chance(round(2 * np.log2(max(n, 1))), round(2 * np.log2(max(m, 1))))
    return np.clip((equal / BUCKETS - c) / (1 - c), 0, 1)


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), digest (of the set; null if empty), sig, keys (one a band)."""
    rows = band_rows(percent)

    def run(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for i, j in slices([len(t or "") for t in texts], SLICE):
                sets = shingle_sets(texts[i:j], words)
                some = [k for k, s in enumerate(sets) if len(s)]
                sig = np.stack([signature(sets[k]) for k in some]) if some else np.zeros((0, BUCKETS), np.uint16)
                keys = bands(sig, rows)
                digests, sigs, all_keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for r, k in enumerate(some):
                    digests[k], sigs[k], all_keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), sig[r].tobytes(), keys[r]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(all_keys, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sig binary, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """rid, members (sorted hashes of the shingles)."""

    def run(batches):
        for b in batches:
            every, ids = b.column("text").to_pylist(), b.column("rid")
            for i, j in slices([len(t or "") for t in every], SLICE):
                sets = [s.view(np.int64) for s in shingle_sets(every[i:j], words)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], ["rid", "members"])

    return texts.mapInArrow(run, "rid long, members array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar on the whole sets."""
    x = sets.select(F.col("rid").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("rid").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return joined.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of ``edges`` (a, b).

    Labels sink to the least of a node's neighbours, then jump to the label of their
    label, so the rounds grow with the logarithm of a component's width.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        sunk = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        at = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = written(sunk.join(at, "component").select("node", "was", F.least("component", "further").alias("component")))
        changed = new.filter("component <> was").limit(1).count()
        remove(labels)
        labels = new.select("node", "component")
        if not changed:
            remove(both)
            return labels


def _likely(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of rows against rows, as :func:`estimate`; -1 where the sizes or the estimate rule the pair out."""
    equal = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for k in range(BUCKETS):
        equal += sig_a[:, k, None] == sig_b[None, :, k]
    small, large = np.minimum(n_a[:, None], n_b[None]), np.maximum(n_a[:, None], n_b[None])
    (of_a, at_a), (of_b, at_b) = (np.unique(np.round(2 * np.log2(n)).astype(int), return_inverse=True) for n in (n_a, n_b))
    chance = np.array([[_chance(x, y) for y in of_b.tolist()] for x in of_a.tolist()])[at_a[:, None], at_b[None]]
    guess = np.clip((equal / BUCKETS - chance) / (1 - chance), 0, 1)
    possible = (100 * small >= percent * large) & ((small < SURE) | (guess >= percent / 100 - SLACK))
    return np.where(possible, guess, -1.0)


def live_rows(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Those of a band's rows (rid, component, query, n, sig) with a likely partner of another component; queries look at all rows."""
    comp, n = np.unique(rows["component"], return_inverse=True)[1], rows["n"].to_numpy()
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, BUCKETS)
    live = np.zeros(len(rows), bool)
    asking = np.flatnonzero(rows["query"])
    for i in range(0, len(asking), BLOCK):
        q = asking[i : i + BLOCK]
        for j in range(0, len(rows), BLOCK):
            some = (_likely(sig[q], n[q], sig[j : j + BLOCK], n[j : j + BLOCK], percent) >= 0) & (comp[q][:, None] != comp[None, j : j + BLOCK])
            live[q] |= some.any(1)
            live[j : j + BLOCK] |= some.any(0)
    return rows[live]


def links(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between components among rows (rid, component, query, members); queries look at all rows."""
    rows = rows.sort_values(["rid", "query"]).drop_duplicates("rid", keep="last")
    ids, comp = rows["rid"].to_numpy(), np.unique(rows["component"], return_inverse=True)[1]
    sizes = rows["members"].map(len).to_numpy()
    every = np.concatenate([np.asarray(m) for m in rows["members"]])
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    parent = list(range(int(comp.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(rows["query"]):
        mine = np.asarray(rows["members"].iloc[i])
        first, end = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)):
            x, y = root(comp[i]), root(comp[j])
            if x != y:
                parent[x] = y
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def bridges(members: DataFrame, labels: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between different components within a band. members: key, rid, size; about: rid, n, sig.

    A band's rows are dealt to blocks, its rows outside the largest component also to
    chunks; a task holds one block and one chunk, so it is bounded whatever the band's size.
    """
    rows = members.filter("size > 2").join(labels, members["rid"] == labels["node"], "left").select("key", "rid", F.coalesce("component", "rid").alias("component"))
    per = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1")
    dealt = rows.join(written(per), "key")  # written, so that Spark may split this join too
    blocks, chunks = (F.ceil(F.col(c) / HELD).cast("int") for c in ("total", "rest"))
    dealt = dealt.withColumn("rest", F.col("total") - F.col("most")).withColumns({"blocks": blocks, "query": F.col("component") != F.col("main")}).withColumn("chunks", chunks)
    some = lambda n: F.pmod(F.xxhash64("rid"), n.cast("long")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    base = dealt.select("key", "rid", "component", F.lit(False).alias("query"), some(F.col("blocks")).alias("block"), F.explode(upto(F.col("chunks"))).alias("chunk"))
    asking = dealt.filter("query").select("key", "rid", "component", "query", F.explode(upto(F.col("blocks"))).alias("block"), some(F.col("chunks")).alias("chunk"))
    task = ["key", "block", "chunk"]
    every = base.unionByName(asking).groupBy(*task, "rid", "component").agg(F.max("query").alias("query")).join(about, "rid")

    def alive(key, p: pd.DataFrame) -> pd.DataFrame:
        return live_rows(p, percent)[[*task, "rid", "component", "query"]]

    def find(key, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links(p, percent), columns=["a", "b"], dtype="int64")

    alive_rows = every.groupBy(*task).applyInPandas(alive, "key long, block int, chunk int, rid long, component long, query boolean")
    return alive_rows.join(sets, "rid").groupBy(*task).applyInPandas(find, "a long, b long").distinct()


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``.

    Rows that share an id are one document. A null or empty text has no shingles and no
    links. A null id is its own component, which is null, and is kept.
    """
    signed = written(signatures(docs, words, percent))
    some = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(some.groupBy("digest").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    banded = reps.select("rid", F.explode("keys").alias("key"))
    # Written by itself, so that Spark may split the join where one band holds many rows; the sums before it are combined in each task.
    heads = written(banded.groupBy("key").agg(F.min("rid").alias("head"), F.count("*").alias("size")).filter("size > 1"))
    members = written(banded.join(heads, "key"))
    remove(heads)
    same_id = reps.groupBy("rid").count().filter("count > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    wanted = members.select("rid").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rid"), "text")
    sets = written(_sets(texts.join(wanted.hint("shuffle_hash"), "rid"), words))
    about = reps.select("rid", "n", "sig")
    star = members.filter("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    star = star.join(about.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a").join(about.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    star = star.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & _vector_likely(percent)("n_a", "sig_a", "n_b", "sig_b")).select("a", "b")
    edges = written(verified(star, sets, percent).unionByName(same_id))
    labels = components(edges)
    more = written(bridges(members, labels, about, sets, percent))
    remove(sets)
    remove(members)
    if more.limit(1).count():
        remove(labels)
        labels = components(edges.unionByName(more))
    remove(edges)
    remove(more)
    root = reps.join(labels, reps["rid"] == labels["node"], "left").select("digest", F.coalesce("component", "rid").alias("component_id"))
    none = F.col("digest").isNull()  # documents without words share that, and need no join
    out = signed.filter(~none).alias("s").join(root.alias("r"), "digest", "left").select("s.doc_id", F.col("s.n").alias("n_shingles"), F.coalesce("r.component_id", "s.doc_id").alias("component_id"))
    out = out.unionByName(signed.filter(none).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _vector_likely(percent: int):
    @F.pandas_udf("boolean")
    def likely(n_a: pd.Series, sig_a: pd.Series, n_b: pd.Series, sig_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, BUCKETS) for s in (sig_a, sig_b))
        guess = np.array([estimate(e, n, m) for e, n, m in zip((a == b).sum(1), n_a, n_b)])
        return pd.Series((np.minimum(n_a, n_b) < SURE) | (guess >= percent / 100 - SLACK))

    return likely


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs``, with the same columns, without the rows of documents that are not the smallest of their component.

    Rows that repeat an id are one document and all stay or all go. Documents whose text
    is null, empty or without words stay, as do rows of a null id. Empty table: no rows.
    Columns of ``docs`` may have any name.
    """
    gone = linked(docs.select("doc_id", "text"), words, percent).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(gone.hint("shuffle_hash"), F.col("row.doc_id").cast("long") == F.col("id"), "left_anti").select("row.*")
