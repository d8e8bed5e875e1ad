"""The prefix trie against one built of dictionaries."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from carelake.llm import prefix_trie as pt

SF = "/root/testdata/sf0.01"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows (conv_id, turn, role, text) -> sorted rows of the trie."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    seq = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    built = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(seq.get(c - c % 5, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
        ends[x].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in children[node])
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                   sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def result(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def test_table_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(pt.op11_prefix_trie(spark, SF)) == brute(rows)


@pytest.fixture
def few_turns():
    """Conversations over three texts, so that prefixes meet often."""
    rng, rows = random.Random(3), []
    for c in range(-20, 260):
        for k in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["user", None]), rng.choice(["a", "ß" * 3, None])))
    rng.shuffle(rows)
    return rows


def test_shared_prefixes(spark, few_turns):
    want = brute(few_turns)
    assert max(r[4] for r in want) > 2 and max(r[3] for r in want[1:]) > 20
    got = pt.prefix_trie(frame(spark, few_turns))
    assert result(got) == want
    # the reference of a node is a stored turn of its text: the bytes below a leaf's parent add up
    assert got.where("depth > 0 and src_conv is null").count() == 0


def test_long_conversation_spans_tasks_and_blocks(spark, monkeypatch, few_turns):
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "HOT", 2)
    rng = random.Random(4)
    long = [(10, k // 3, "user", rng.choice("ab")) for k in range(700)] + [(11, 0, None, "x")] * 300
    rows = few_turns + long + [(c, t, r, x) for c in (12, 13) for _, t, r, x in long[:90]]
    df = frame(spark, rows)
    assert result(pt.prefix_trie(df)) == brute(rows)
    pos = pt.turns(df, 0).where("conv_id = 10")
    assert [r.pos for r in pos.orderBy("pos").collect()] == list(range(1, pos.count() + 1))


def test_collisions_are_found_and_mended(spark, monkeypatch, few_turns):
    rows, want = few_turns[:600], brute(few_turns[:600])
    plain, seen = pt.turn_number, []

    def weak(seed, role, text):
        seen.append(seed)
        return F.length(text).cast("long") if seed == 0 else plain(seed, role, text)

    monkeypatch.setattr(pt, "turn_number", weak)
    assert result(pt.prefix_trie(frame(spark, rows))) == want
    assert max(seen) == 1
    # fingerprints that collide though the turns' numbers do not
    monkeypatch.setattr(pt, "turn_number", plain)
    monkeypatch.setattr(pt, "PRIMES", (5, 7))
    monkeypatch.setattr(pt, "TRIES", 2)
    with pytest.raises(RuntimeError):
        pt.prefix_trie(frame(spark, rows))


def test_odd_rows(spark):
    assert pt.prefix_trie(frame(spark, [(1, 1, "user", "a")]).limit(0)).count() == 0
    long = "é" * 400_000
    rows = [(None, 1, "user", "a"), (None, None, None, None), (3, None, None, None), (5, 1, "user", long), (5, 2, "user", ""),
            (6, 1, "user", long), (6, 1, "user", long), (8, 0, "a", "b"), (9, 0, "a", "b")]
    df = frame(spark, rows, 3)
    for c in ("DEPTH", "f1", "part", "turn_no", "block", "ids"):
        df = df.selectExpr("*", f"'x' AS {c}")
    assert result(pt.prefix_trie(df)) == brute(rows)
