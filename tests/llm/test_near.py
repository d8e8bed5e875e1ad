"""The chosen-path join against brute force over all pairs."""

import os

from pyspark.sql import functions as F

from carelake.llm.chosen_path import drop_near_duplicates, near_duplicates

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


def shingle_set(text):
    words = (text or "").encode().split()
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute(rows):
    """doc -> (class, links) by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    ids = sorted(sets)
    root, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        near = {e for s in sets[d] for e in holders[s] if e < d}
        for e in near:
            both = len(sets[d] & sets[e])
            if 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                links[d] += 1
                links[e] += 1
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (find(d), links[d]) for d in ids}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_is_dealt_into_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):  # every copy differs by a word of its own: more classes than a block holds
        words = list(base)
        words[i % 120] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert max(n for _, n in want.values()) > 500
    assert result(near_duplicates(docs)) == want
    assert drop_near_duplicates(docs).count() == len({c for c, _ in want.values()})


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "one two", "x"), (5, "one  two\n", "x"),
            (6, text, None), (6, text, None), (7, text + " tail", "y"), (None, text, "z"), (9, "b " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SID string").repartition(3)
    got = {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 3), (7, 6, 3), (None, 6, 3), (9, 9, 0)}
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 9]
    empty = docs.where(F.lit(False))
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
