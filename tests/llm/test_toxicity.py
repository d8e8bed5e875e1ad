"""Toxicity: the automaton against edit distances, misspelled and quoted terms, held-out rows."""

import random
import zlib

import numpy as np
import pytest

from carelake.llm import toxicity as tox
from tests.llm.odd import odd_documents


def distances(a, b):
    """Edit distances of a to every beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row


def brute_nearest(terms, word):
    found = []
    for i, t in enumerate(terms):
        letters = t.rstrip("$")
        row = distances(letters, word)
        d = row[-1] if t.endswith("$") else min(row)
        if d <= tox.errors(t):
            found.append((d, -len(letters), not t.endswith("$"), i))
    return min(found) if found else None


def test_automaton_is_edit_distance():
    rng, hits = random.Random(1), 0
    for _ in range(300):
        terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) + rng.choice(["$", ""]) for _ in range(rng.randrange(1, 9))})
        automaton = tox.Automaton(terms)
        for _ in range(30):
            w = list(rng.choice(terms).rstrip("$"))
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randrange(2)] = rng.choice(["", "a", "b", "cc"])
            got, want = automaton.find("".join(w)), brute_nearest(terms, "".join(w))
            assert got == (want and (want[3], want[0])), (terms, w)
            hits += got is not None
    assert hits > 3000


def test_cues():
    find = tox.Automaton(["idiot$"]).find
    cues = lambda t: [h[2] for h in tox.hits_in(t, find)[1]]
    assert cues("you idiot go away") == [0]
    assert cues("he said idiot and left") == [1]
    assert cues('the "idiot" left') == [2] and cues("«idiot»") == [2] and cues('a" b\nidiot "c') == [0]
    assert cues('the word "idiot" is an insult') == [3]
    assert tox.hits_in("you id1ot", find) == (2, [(0, 1, 0)])
    assert tox.hits_in(None, find) == tox.hits_in("", find) == (0, [])


def labelled(spark, n=900):
    """Invented texts; toxic ones insult, some clean ones quote the same words."""
    rng, rows = random.Random(2), []
    filler = [a + b for a in ("stone", "river", "garden", "window", "copper", "yellow") for b in ("", "bank", "side", "house", "way", "town", "light", "field")]
    for i in range(n):
        words = [rng.choice(filler) for _ in range(60)]
        toxic = int(i % 5 == 1)
        if toxic:
            for bad in rng.sample(["dimwitted", "blockhead", "worthless"], 2):
                words.insert(rng.randrange(50), bad)
        elif i % 25 == 0:
            words[20:20] = ["the", "term", '"blockhead"', "is", "quoted"]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels, rows


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels, rows = labelled(spark)
    extra = [(10_001, "stone river garden " * 10 + " you dimwited blokhead " + "market paper " * 10),
             (10_002, "stone river garden " * 10 + 'the term "blockhead" is quoted ' + "market paper " * 10),
             (10_003, "stone river garden " * 20), (10_004, None), (10_005, " "), (None, "blockhead dimwitted")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    return {r.doc_id: r for r in tox.score_toxicity(docs, labels).collect()}, rows


def test_held_out_rows(scored):
    got, rows = scored
    for i, _, y in rows:
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i].held_out == held and got[i].predicted == (got[i].score >= 0.5)
        if held:
            assert got[i].predicted == y, (i, got[i])


def test_misspelled_and_quoted(scored):
    got, _ = scored
    assert got[10_001].predicted == 1 and got[10_001].n_hits == 2
    assert got[10_002].score < got[10_001].score and got[10_002].predicted == 0
    assert got[10_003].score == got[10_004].score == got[10_005].score < 0.1
    assert got[None].predicted == 1 and not got[None].held_out


def test_table_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = tox.op13_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    s = np.array([x for x, _ in held])
    y = np.array([t for _, t in held])
    assert len(y) > 600 and y.sum() > 50
    assert (s[y == 1] >= 0.5).mean() > 0.85 and (s[y == 0] >= 0.5).mean() < 0.02
    assert np.mean([(s[y == 0] < a).mean() + (s[y == 0] == a).mean() / 2 for a in s[y == 1]]) > 0.93


def test_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tox.score_toxicity(docs, none)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "n_hits"]
    assert got.count() == docs.count() and got.where("score is null or score >= 0.5").count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 0), (None, 1), (6, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    assert tox.score_toxicity(docs, labels).count() == docs.count()
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
    given = tox.score_toxicity(docs, none, terms=("alpha3",)).where("doc_id = 9").first()
    assert given.predicted == 1
