"""Periodic runs of words, by maximal pairs.

A run is a stretch of consecutive words with smallest period q and length >= max(6, 4 q) that no neighbouring
word extends. Two occurrences i < j of the same words, l of them, that neither the word to the left nor the one
to the right extends (a maximal pair) are the stretch [i, j + l) of period j - i: if l >= 3 (j - i) and it has six
words, it is a run, and every run is such a pair. So nothing is extended:

1. words become numbers, suffixes are sorted by prefix doubling, and the common prefixes of neighbours are read off
   the ranks of the rounds (numpy);
2. the tree of LCP intervals is walked bottom-up with a stack. Each interval holds its positions in order, and one
   list per word to the left of them. Joining two intervals of common length l, the smaller one's positions look for
   partners of another left word at a distance of at most l / 3: near positions of equal words are a progression, of
   which all but the first have the same left word, so a partner to the right shows in the next position, and the
   one to the left stands before the positions of the own left word, found in their list;
3. a stretch found with several periods keeps the smallest, which is its smallest period.

Only positions whose next five words occur twice can be part of a pair (l >= 5), so a document without them has no
suffix array. Work per document is O(n log^2 n); documents are independent, so Spark deals them out as they come.

Null, empty and blank texts have no words and no run. ``exponent_milli`` and the run's columns are then null, the
digests those of no bytes. Ties (runs of equal length) go to the smallest start, then period. Very long texts are
taken whole; a batch holds few rows. Equal rows get equal results. An empty table gives an empty result. Only the
columns of the id and the text are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, table

MIN_WORDS = 6     # a run's least length
MIN_EXPONENT = 4  # in periods
SEED = 5          # least common length of a pair: one period less than the run, whatever the period

Run = tuple[int, int, int]  # start, length, period


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: rank of the 2^k words from i on (fewer at the end: a shorter stretch is less), until all differ."""
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    step, n = 1, len(ids)
    while ranks[-1].max() < n and step < n:
        r = ranks[-1]
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = r[step:]
        ranks.append(np.unique(r * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64) + 1)
        step *= 2
    return ranks


def common_prefixes(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes order[t] and order[t + 1] have in common."""
    n = len(ranks[0])
    i, j, out = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        # equal ranks of stretches that reach the end would be equal suffixes, so both are whole
        ok = (i + step <= n) & (j + step <= n)
        same = np.zeros(len(i), bool)
        same[ok] = ranks[k][i[ok]] == ranks[k][j[ok]]
        out[same] += step
        i[same] += step
        j[same] += step
    return out


class Interval:
    """Positions of an LCP interval in order, and the same by the word to the left of them."""

    __slots__ = ("at", "by_left")

    def __init__(self, position: int, left: int):
        self.at = [position]
        self.by_left = {left: [position]}

    def take(self, other: "Interval") -> None:
        if len(other.at) * 8 > len(self.at):
            self.at = sorted(self.at + other.at)
        else:
            for p in other.at:
                insort(self.at, p)
        for left, ps in other.by_left.items():
            mine = self.by_left.get(left)
            if mine is None:
                self.by_left[left] = ps
            elif len(ps) * 8 > len(mine):
                self.by_left[left] = sorted(mine + ps)
            else:
                for p in ps:
                    insort(mine, p)


def pairs(small: Interval, big: Interval, common: int, left: list[int]) -> Iterator[tuple[int, int]]:
    """(i, j): i < j, one of ``small`` and one of ``big``, different words to the left, distance <= common / 3."""
    reach, at = common // (MIN_EXPONENT - 1), big.at
    for p in small.at:
        k = bisect_left(at, p)
        own = left[p]
        # to the right: all partners have one left word; if it is the own one, none counts
        r = k
        while r < len(at) and at[r] <= p + reach and left[at[r]] != own:
            yield p, at[r]
            r += 1
        # to the left: behind those of the own left word
        if k and at[k - 1] >= p - reach:
            m = k - 1
            if left[at[m]] == own:
                mine = big.by_left[own]
                e = bisect_left(mine, p) - 1
                lo, hi = 0, min(m, e)  # how many further positions back are still of the own left word
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    if mine[e - mid] == at[m - mid]:
                        lo = mid
                    else:
                        hi = mid - 1
                m -= lo + 1
            if m >= 0 and at[m] >= p - reach:
                yield at[m], p


def maximal_pairs(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, common) for the maximal pairs that make runs, among the suffixes from ``starts`` on."""
    ranks = suffix_ranks(ids)
    last = ranks[-1][starts]
    order = starts[np.argsort(last, kind="stable")]
    lcp = common_prefixes(ranks, order).tolist() + [0]
    left = np.concatenate([[-1], ids[:-1]]).tolist()
    stack: list[tuple[int, Interval]] = []  # (common length, positions), lengths increasing
    for p, nxt in zip(order.tolist(), lcp):
        node = Interval(p, left[p])
        # close the intervals that the next suffix does not share
        while stack and stack[-1][0] > nxt:
            common, other = stack.pop()
            small, big = (node, other) if len(node.at) <= len(other.at) else (other, node)
            for i, j in pairs(small, big, common, left):
                yield i, j, common
            big.take(small)
            node = big
        if nxt < SEED:
            stack.clear()
        elif stack and stack[-1][0] == nxt:
            common, other = stack.pop()
            small, big = (node, other) if len(node.at) <= len(other.at) else (other, node)
            for i, j in pairs(small, big, common, left):
                yield i, j, common
            big.take(small)
            stack.append((nxt, big))
        else:
            stack.append((nxt, node))


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    # positions whose next SEED words occur twice
    gram = ids.astype(np.int64)
    for k in range(1, SEED):
        gram = np.unique(gram[:n - k] * (n + 1) + ids[k:], return_inverse=True)[1]
    starts = np.flatnonzero(np.bincount(gram)[gram] > 1)
    if not len(starts):
        return []
    best: dict[tuple[int, int], int] = {}
    for i, j, common in maximal_pairs(ids, starts):
        period = j - i
        length = period + common
        if length >= max(MIN_WORDS, MIN_EXPONENT * period) and best.get((i, length), n) > period:
            best[i, length] = period
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def words_of(text: str | None, doc_id: int | None) -> list[bytes]:
    """The text's words with the planted repetition: of documents whose crc32 ends in 0, the words from a on repeat the
    first p of them. A null id plants nothing."""
    words = text.encode().split() if text else []  # bytes.split() parts at exactly the six ASCII white-space characters
    if words and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            part = words[a:a + p]
            words[a:] = (part * (-(-(n - a) // p)))[:n - a]
    return words


def collapse(words: list, runs: list[Run]) -> list:
    """``words`` without those behind the first period of a run."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def runs_of(words: list) -> list[Run]:
    known: dict = {}
    return find_runs(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))


RESULT = T.StructType([T.StructField(c, T.LongType(), c != "n_runs")
                       for c in ("n_runs", "start", "length", "period", "exponent_milli")]
                      + [T.StructField(c, T.StringType(), False) for c in ("runs_sha256", "collapsed_sha256")])


def digest(words: list[bytes]) -> tuple:
    runs = runs_of(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            sha256(b" ".join(collapse(words, runs))).hexdigest())


def _rows(rows: list[tuple], schema: T.StructType) -> pa.StructArray:
    cols = list(zip(*rows)) or [()] * len(schema.names)
    types = {"bigint": pa.int64(), "string": pa.string()}
    return pa.StructArray.from_arrays([pa.array(c, types[f.dataType.simpleString()]) for c, f in zip(cols, schema)],
                                      schema.names)


@F.arrow_udf(RESULT)
def run_digest(ids: pa.Array, texts: pa.Array) -> pa.Array:
    return _rows([digest(words_of(t.as_py(), i.as_py())) for i, t in zip(ids, texts)], RESULT)


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


@F.arrow_udf(RUNS)
def runs_in(texts: pa.Array) -> pa.Array:
    """The runs of each text as it is (no planted repetition)."""
    found = [[dict(zip(("start", "length", "period"), r)) for r in runs_of(words_of(t.as_py(), None))] for t in texts]
    return pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))


@F.arrow_udf(T.StringType())
def without_repeats(texts: pa.Array) -> pa.Array:
    """Each text's words joined by a space, without those behind the first period of a run; null stays null."""
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        words = words_of(t, None)
        return b" ".join(collapse(words, runs_of(words))).decode()
    return pa.array([one(t.as_py()) for t in texts], pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text."""
    arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run_digest(F.col(id_col).cast("long"), F.col(text)).alias("r")) \
               .select("doc_id", "r.*")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
