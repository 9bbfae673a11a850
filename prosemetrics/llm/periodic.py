"""Periodic runs of words: a suffix automaton whose states hold ordered sets of end positions.

A run is a stretch of words that repeats with a smallest period q (words q apart are
equal), is at least twice as long as q, and can't be made longer. The states of a suffix
automaton are visited from the longest to the shortest; each takes the end positions of
the states that link to it, the smaller sets inserted into the largest. Two positions
that become neighbours there, at a distance d, end equal stretches of exactly the state's
length: where d does not exceed that length, they seed a square of period d. Being
neighbours, no smaller period holds between them, so d is the smallest one. The stretch
starts at the first word of the state's string before the left position; the furthest
right position of all seeds with that start and period is the end of the run.

The automaton is only built where a run can be: in a run of ``least`` words or more, half
of them at least come again one period later, so every word of it lies in a window of half
``least`` words that stands twice in the stretch. Other words are left out before, exactly.
For the same reason sets need no merging in states shorter than that.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Documents handled at once; ends inserted one by one into the larger set (more of them are merged with it).
SLICE, FEW = 256, 64

_ODD = np.random.default_rng(11).integers(0, 1 << 63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where a run can be: stretches covered by windows of half ``least`` words that come twice in the stretch."""
    half, out, todo = (least + 1) // 2, [], [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo - half + 1
        if hi - lo < least:
            continue
        h = np.zeros(n, np.uint64)
        for j in range(half):
            h += ids[lo + j : lo + j + n] * _ODD[j % len(_ODD)] * np.uint64(2 * (j // len(_ODD)) + 1)
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        again = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        edges = np.zeros(hi - lo + 1, np.int64)
        at = np.flatnonzero(again)
        edges[at] += 1
        np.subtract.at(edges, at + half, 1)
        covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
        ends = np.flatnonzero(covered[1:] != covered[:-1])
        found = [(lo + a, lo + b) for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()) if b - a >= least]
        if found == [(lo, hi)]:
            out.append((lo, hi))
        else:
            todo += found
    return sorted(out)


def _automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """length, suffix link and own end position (-1 for a clone) of each state; state 0 is the empty string."""
    moves: list[dict[int, int]] = [{}]
    length, link, own = [0], [-1], [-1]
    last = 0
    for i, w in enumerate(words):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        link.append(0)
        own.append(i)
        at = last
        while at >= 0 and w not in moves[at]:
            moves[at][w] = new
            at = link[at]
        if at >= 0:
            to = moves[at][w]
            if length[to] != length[at] + 1:
                clone = len(moves)
                moves.append(moves[to].copy())
                length.append(length[at] + 1)
                link.append(link[to])
                own.append(-1)
                link[to] = clone
                while at >= 0 and moves[at].get(w) == to:
                    moves[at][w] = clone
                    at = link[at]
                to = clone
            link[new] = to
        last = new
    return length, link, own


def _runs_of_stretch(words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of ``least`` words or more."""
    length, link, own = _automaton(words)
    ends: list[list[int] | None] = [[] if e < 0 else [-e] for e in own]  # negated, so that earlier ends come last
    small: list[list[int]] = [[] for _ in own]
    after = [-1] * len(words)  # the next end in the set that holds this one
    runs: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        size = length[state]
        if size < (least + 1) // 2:
            break
        mine, new = ends[state], small[state]
        if len(new) > FEW:
            mine = mine + new
            mine.sort()  # of few sorted stretches: a merge
        else:
            for x in new:
                insort(mine, x)
        for x in new:
            at = bisect_left(mine, x)
            for left, right in ((-x, -mine[at - 1] if at else -1), (-mine[at + 1] if at + 1 < len(mine) else -1, -x)):
                if left < 0 or right < 0 or after[left] == right:
                    continue
                after[left] = right
                period = right - left
                if period <= size:
                    key = (left - size + 1, period)
                    runs[key] = max(runs.get(key, 0), right + 1)
        up = link[state]
        ends[state], small[state] = None, ()
        if len(mine) > len(ends[up]):
            mine, ends[up] = ends[up], mine
        small[up] += mine
    return [(start, end, period) for (start, period), end in runs.items() if end - start >= least]


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of ``least`` words or more, by start, then period."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint64, len(words))
    out = []
    for lo, hi in _stretches(ids + np.uint64(1), least):
        out += [(lo + s, lo + e, p) for s, e, p in _runs_of_stretch(ids[lo:hi].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, end, period in runs:
        edges[start + period] += 1
        edges[end] -= 1
    drop = np.cumsum(edges[:-1]) > 0
    return [w for w, d in zip(words, drop.tolist()) if not d] if runs else words


def stretched(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Plants a periodic tail in one document of ten, as its id says; a null id gets none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    unit = words[first : first + period]
    return words[:first] + (unit * ((n - first) // period + 1))[: n - first]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(
    docs: DataFrame, least: int = LEAST, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """One row a document: doc_id, runs (start, length, period; in words, by start, then period), kept.

    ``kept`` is the text (bytes) without what repeats: a word goes if a run contains it after
    that run's first period; those that stay are joined by one space. ``edit`` changes the
    words of a document before they are looked at. Null, empty and blank texts have no words,
    no runs and an empty ``kept``. Repeated rows are handled alike, whatever their ids; other
    columns don't matter. Runs that overlap are all reported. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                runs, kept = [], []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    words = (text or b"").split()  # bytes split at the six ASCII blanks
                    if edit is not None:
                        words = edit(doc_id, words)
                    found = runs_of(words, least)
                    runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in found])
                    kept.append(b" ".join(without_repeats(words, found)))
                columns = [b.column("doc_id"), pa.array(runs, RUNS), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "kept"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept binary")


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Periodic tails are planted by :func:`stretched` first. The longest run: ties go to the
    smallest start, then period; four nulls without a run.
    """
    found = periodic_runs(docs, edit=stretched)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("longest", longest)
    length, period = -F.col("longest.less"), F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
