"""Periodic runs of words: maximal stretches in which words some distance apart are identical.

By the runs theorem every run holds a longest Lyndon word, under the order of words or under its reverse,
whose length is the run's smallest period. For each stretch that can hold a run:

1. Suffix arrays by prefix doubling under both orders; the longest Lyndon word at i ends at the next smaller
   value of the inverse suffix array.
2. The longest common prefixes of neighbours in the suffix array, with a sparse table for range minima, tell
   how far a Lyndon root's copy goes on to the right; those of the reversed words, to the left.
3. Roots whose extended stretch is long enough are runs; both orders and all places give each run once.

Before that, `stretches` leaves out words that no run can hold: in a run of period q and exponent 4 or more at least 3 q words
in a row come again within q words. So the suffix arrays see repetitive stretches only, and the
result is the same as over the whole text (a run outside them would make its own stretch).

A document is a row of its own; nothing is shuffled. Memory of a text: its words, and for its longest
stretch of m words some 3 m log2(m) numbers of 4 bytes.

Defined results: null and empty texts have no words and no run. A null identifier has no crc32: its text stays
as it is. Repeated rows stay repeated. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: A run has this many words, and this many periods, at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4

RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where the identifier's crc32 asks for it (h % 10 = 0)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end) that hold every run whole.

    For periods from 2^k to below 2^(k+1): a run of period q has 3 q words (and 6 - q) in a row whose next equal word is at most
    q on; behind them come q words more.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    found = []
    low = 1
    while LEAST_PERIODS * low <= n:
        high = 2 * low - 1
        least = max((LEAST_PERIODS - 1) * low, LEAST_WORDS - high)
        near = gap <= high
        if np.count_nonzero(near) >= least:
            edge = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
            starts, ends = edge[::2], edge[1::2]
            long = ends - starts >= least
            found += zip(starts[long].tolist(), np.minimum(ends[long] + high, n).tolist(), strict=True)
        low *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all substrings of 1, 2, 4, ... numbers from each place, up to where they are distinct (the end counts as smallest)."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while True:
        rank = levels[-1]
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        steps = np.empty(n, np.int64)
        steps[0] = 0
        steps[1:] = key[order[1:]] != key[order[:-1]]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(steps)
        levels.append(new)
        width *= 2
        if new[order[-1]] == n - 1:
            return levels


class CommonPrefix:
    """Length of the longest common prefix of two suffixes: LCP array of the suffix array and a sparse table of minima."""

    def __init__(self, levels: list[np.ndarray]):
        self.rank = levels[-1]
        n = len(self.rank)
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(max(0, n - 1), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            width = 1 << k
            inside = (a + width <= n) & (b + width <= n)
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            step = np.where(same, width, 0)
            total += step
            a += step
            b += step
        self.table = [total.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(total):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j, both inside."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for level in np.unique(k).tolist():
            at = k == level
            row = self.table[level]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << level)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length."""
    values = rank.tolist()
    n = len(values)
    out = [n] * n
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def stretch_runs(ids: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs inside one stretch."""
    n = len(ids)
    levels = suffix_ranks(ids)
    ahead = CommonPrefix(levels)
    back = CommonPrefix(suffix_ranks(ids[::-1]))
    found: set[tuple[int, int, int]] = set()
    for rank in (levels[-1], suffix_ranks(ids.max() - ids)[-1]):
        i, j = np.arange(n), next_smaller(rank)
        inside = j < n
        i, j = i[inside], j[inside]  # a root that ends with the stretch is no first copy of a run
        right = ahead(i, j)
        # a run's first Lyndon root is followed by two whole copies at least
        full = right >= (LEAST_PERIODS - 2) * (j - i)
        i, j, right = i[full], j[full], right[full]
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back(n - i[inner], n - j[inner])
        start, end, period = i - left, j + right, j - i
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.update(zip(start[long].tolist(), (end - start)[long].tolist(), period[long].tolist(), strict=True))
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    ids = word_numbers(words)
    found = []
    for a, b in stretches(ids):
        found += [(a + s, n, p) for s, n, p in stretch_runs(ids[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change)[:-1] == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_tails: bool = False, outputs: tuple[str, ...] = ("runs", "collapsed")) -> DataFrame:
    """One row per input row: the identifier, n_words and the outputs named.

    `runs`: all runs (start, length, period) by start, then period. `collapsed`: the text's kept words,
    joined by one space. `runs_sha256`, `collapsed_sha256`: digests of both. `repeat_tails` gives some
    documents a periodic tail first (`repeated_tail`).
    """
    types = {"runs": RUN_TYPE, "collapsed": "string", "runs_sha256": "string", "collapsed_sha256": "string"}
    kinds = {"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def row(doc_id: int | None, text: str | None) -> tuple[int, dict]:
        words = (text or "").encode().split()  # bytes are split at exactly the six ASCII separators
        if repeat_tails:
            words = repeated_tail(words, doc_id)
        runs = runs_of(words)
        out: dict = {"runs": [{"start": s, "length": n, "period": p} for s, n, p in runs]}
        if "runs_sha256" in outputs:
            out["runs_sha256"] = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        if "collapsed" in outputs or "collapsed_sha256" in outputs:
            joined = b" ".join(collapsed(words, runs))
            out["collapsed"] = joined.decode() if "collapsed" in outputs else None
            out["collapsed_sha256"] = hashlib.sha256(joined).hexdigest()
        return len(words), out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                done = [row(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                arrays = [part.column(0), pa.array([n for n, _ in done], pa.int64())]
                arrays += [pa.array([out[k] for _, out in done], kinds[k]) for k in outputs]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", *outputs])

    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(["id bigint", "n_words bigint", *(f"{k} {types[k]}" for k in outputs)])
    return docs.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(documents(spark, sf_dir), repeat_tails=True, outputs=("runs", "runs_sha256", "collapsed_sha256"))
    # greatest length, then smallest start, then smallest period
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    rows = found.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
