"""Periodic runs against the definition, tried for every period."""

import random
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest

from carelake.llm.runs import collapse, find_runs, op12_periodic_runs, periodic_runs, runs_in, runs_of, without_repeats, words_of
from tests.llm.odd import odd_documents, rows_of

SF = "/root/testdata/sf0.01"


def brute_runs(words):
    """Stretches by definition: for each period, the longest stretches that keep it; the smallest period names them."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            if k > i and length >= max(6, 4 * q):
                best.setdefault((i, length), q)
            i = k + 1 if k == i else k
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_words(text, doc_id):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(text, doc_id):
    words = brute_words(text, doc_id)
    runs = brute_runs(words)
    top = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())


def some_words(rng):
    kind, n = rng.randrange(4), rng.randrange(0, 90)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abcd") for _ in range(n)]
    out = []
    while len(out) < n:  # repeated pieces, nested in one another, with noise between them
        piece = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += (piece * rng.randrange(1, 8)) * (rng.randrange(1, 4) if kind == 3 else 1) + [rng.choice("xyz")] * rng.randrange(0, 2)
    return out


def test_runs_are_the_definition():
    rng, seen = random.Random(5), 0
    for _ in range(6000):
        words = some_words(rng)
        want = brute_runs(words)
        assert runs_of(words) == want, words
        seen += len(want)
    assert seen > 5000


@pytest.mark.parametrize("words", [
    ["a"] * 20_000,
    ["a", "b", "c"] * 7_000,
    [w for i in range(400) for w in ["x"] * 40 + [f"n{i}"]],
    [w for i in range(150) for w in (["p", "q"] * 9 + ["r"]) * 4 + [f"m{i % 3}"]]])
def test_long_repeats_are_quick(words):
    start = time.monotonic()
    runs = runs_of(words)
    assert time.monotonic() - start < 8
    assert runs == brute_runs(words) if len(words) < 17_000 else runs[0][0] == 0


def test_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    for _ in range(13):
        a, b = b, b + a
    assert runs_of(b) == brute_runs(b) == []  # no fourth powers
    cubes = np.array([0, 1, 1] * 40 + [2] + [0, 1] * 30 + [1] * 9)
    assert find_runs(cubes) == brute_runs(cubes.tolist())


def test_table_is_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in op12_periodic_runs(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    checked = 0
    for r in rows:
        if len(r.text or "") < 6000:
            assert got[r.doc_id] == brute_digest(r.text, r.doc_id), r.doc_id
            checked += 1
    assert checked > 0.9 * len(rows) and sum(v[0] for v in got.values()) > 50


def test_odd_rows(spark):
    got = rows_of(periodic_runs(odd_documents(spark)))
    rows = odd_documents(spark).select("doc_id", "text").collect()
    assert [(g[0], *g[1:]) for g in got if g[0] is not None and g[0] != 4] == sorted(
        ((r.doc_id, *brute_digest(r.text, r.doc_id)) for r in rows if r.doc_id is not None and r.doc_id != 4), key=repr)
    empty = (0, None, None, None, None, sha256(b"").hexdigest(), sha256(b"").hexdigest())
    assert (None, *empty) in got and sum(g[0] is None for g in got) == 2
    assert periodic_runs(odd_documents(spark).limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([("go on " * 5 + "now",), ("a b c",), (None,)], "t string")
    got = df.select(runs_in("t").alias("r"), without_repeats("t").alias("c")).collect()
    assert [[tuple(x) for x in r.r] for r in got] == [[(0, 10, 2)], [], []]
    assert [r.c for r in got] == ["go on now", "a b c", None]
    assert words_of("a b", None) == [b"a", b"b"] and collapse(["a"], []) == ["a"]
