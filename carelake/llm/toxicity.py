"""Toxicity by a lexicon trie that Levenshtein automata search, and scores of the words' surroundings.

1. ``count_terms``: over all labelled training rows, in how many texts of each label a word, or a stem (a word's first
   MIN_STEM to MAX_STEM letters), stands. Tasks add up before the shuffle.
2. ``lexicon``: terms whose counts differ by more than chance among all terms tried (G^2 > 2 ln of their number) and lean to
   label 1; a term counts no more often than there are words before it, so copies of a text don't vote. A stem that one longer term almost covers gives way to it, a term that says no more than a shorter one goes. At
   most MAX_TERMS stay, the most significant; that is the model's size and the bound of what is sent to the tasks.
3. ``scan``: the Levenshtein automata of all terms run along the trie of the lexicon, made deterministic as words come, so a
   word costs a look-up per letter, and most end after a few letters with no state left. So misspelled terms are found: one
   error from 5 letters on, two from 9. Stems match the word's beginning. A word belongs to its nearest, then longest term.
   Around each hit a window of CONTEXT words and the quotation marks of its line give a cue: bare, reported, quoted, or both.
4. ``weigh``: per (term, errors) the log odds of its hits, shrunk to a part of the term's own for unseen misspellings; per
   cue the share of abuse among its hits, shrunk to a prior that counts quotation as less. A hit weighs their product.
5. ``fit``: a ridge logistic model on five figures of the weights (largest, second, sum, number, density), by Newton steps
   whose sums are taken over all training rows in Spark. Only the 6 x 6 sums reach the driver.

Training rows have a non-null label and a crc32 of their id's digits that 5 does not divide. Neither labels, lang, source nor
ids enter a score. Null, empty and blank texts have no hit: their score is the model's for none. Several labels
of one id count as their largest. Rows without id are scored but never trained on; repeated rows are scored alike and counted
each. Without labels there is no lexicon and every score is that of the prior (below 0.5). Very long texts are taken whole. An
empty table gives an empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, fresh, save, small, table

MIN_STEM, MAX_STEM = 3, 10
MAX_WORD = 40            # letters of a word that count
MAX_TERMS = 4096         # terms of the model
STATES = 50_000          # states of the automaton that a task keeps
FLUSH = 300_000          # terms a task adds up before it passes them on
CONTEXTS = 63            # kinds of places in which a term is seen
COVERED = 0.9            # share of a stem's toxic texts that a longer term must hold to replace it
GAIN = 0.3               # log odds by which a longer term must beat a shorter one
GIVEN = 4.0              # log odds of terms that the caller gives
CONTEXT = 6              # words on each side
MISS = 0.75              # share of a term's weight that each error of an unseen misspelling leaves
SHRINK = 4.0             # texts that the prior weight of a hit counts as
CUE_PRIOR = (0.95, 0.6, 0.4, 0.2)  # share of abuse: bare, reported, quoted, both
CUE_STRENGTH = 20.0
PRIOR = np.array([-2.0, 0.8, 0.0, 0.0, 0.0, 0.0])  # bias, largest, second, sum, number, density
RIDGE = 1.0
STEPS = 12

# Words that report what others say.
REPORTING = frozenset("""said says say wrote writes called calls calling quote quoted quotes word words term terms insult insults slur
reported reports alleged allegedly dit écrit appelé mot mots terme sagte schrieb nannte genannt wort wörter zitat dijo escribió
llamó palabra palabras término""".split())

TOKEN = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
END = "$"  # behind a whole word; no token ends with it


def errors(term: str) -> int:
    n = len(term.rstrip(END))
    return 0 if n < 5 else 1 if n < 9 else 2


class Node:
    """A node of the lexicon trie. ``word`` and ``stem`` are the numbers of the terms that end here, ``allowed`` their errors,
    ``k`` the most errors that a term here or below allows."""

    __slots__ = ("next", "word", "stem", "size", "allowed", "k", "id")

    def __init__(self, number: int, size: int):
        self.next, self.word, self.stem, self.size, self.allowed, self.k, self.id = {}, None, None, size, 0, 0, number


def trie(terms: list[str]) -> Node:
    root = Node(0, 0)
    n = 1
    for i, term in enumerate(terms):
        node, k = root, errors(term)
        node.k = max(node.k, k)
        for c in term.rstrip(END):
            if c not in node.next:
                node.next[c] = Node(n, node.size + 1)
                n += 1
            node = node.next[c]
            node.k = max(node.k, k)
        node.allowed = k
        if term.endswith(END):
            node.word = i
        else:
            node.stem = i
    return root


class Automaton:
    """The Levenshtein automata of all terms at once, run along their trie and made deterministic as words come.

    A state is the set of (trie node, fewest errors) that the letters read so far can reach; nodes whose errors exceed what a
    term below allows are left out, so after a few letters most words have no state left. Letters that no term has are one
    letter. The table of states is cleared when it holds STATES of them."""

    def __init__(self, terms: list[str]):
        self.root = trie(terms)
        self.letters = {c for t in terms for c in t.rstrip(END)}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, list] = {}
        self.start = self.state({self.root: 0})

    def state(self, reached: dict[Node, int]) -> list:
        """[reached, steps by letter, best whole word, best stem] of a set, letters of terms skipped on the way."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in node.next.values():
                if e <= child.k and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        key = tuple(sorted((node.id, e) for node, e in reached.items()))
        if key not in self.states:
            ends = [(e, -n.size, n) for n, e in reached.items() if e <= n.allowed]
            words = [(e, size, False, n.word) for e, size, n in ends if n.word is not None]
            stems = [(e, size, True, n.stem) for e, size, n in ends if n.stem is not None]
            self.states[key] = [reached, {}, min(words, default=None), min(stems, default=None)]
        return self.states[key]

    def step(self, state: list, c: str) -> list:
        reached: dict[Node, int] = {}
        for node, e in state[0].items():
            if e < node.k and e + 1 < reached.get(node, 99):  # a letter too many
                reached[node] = e + 1
            for letter, child in node.next.items():
                cost = e if letter == c else e + 1
                if cost <= child.k and cost < reached.get(child, 99):
                    reached[child] = cost
        out = state[1][c] = self.state(reached)
        return out

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the nearest, then longest term; a whole word before a stem. Stems match the word's beginning."""
        if len(self.states) > STATES:
            self.clear()
        state, letters = self.start, self.letters
        best = state[3]
        for c in word[:MAX_WORD]:
            if c not in letters:
                c = ""
            state = state[1].get(c) or self.step(state, c)
            if state[3] and (best is None or state[3] < best):
                best = state[3]
            if not state[0]:
                break
        if state[2] and (best is None or state[2] < best):
            best = state[2]
        return best and (best[3], best[0])


# --- counts and lexicon ---

def words_in(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def terms_in(text: str | None) -> dict[str, int]:
    """The text's words and stems, each with the places that it is seen in as a bit set: the word before, of CONTEXTS kinds."""
    out: dict[str, int] = {}
    seen, before = set(), ""
    for w in words_in(text):
        if w not in seen:
            seen.add(w)
            bit = 1 << zlib.crc32(before.encode()) % CONTEXTS
            short = w[:MAX_WORD]
            for term in (short + END, *(short[:k] for k in range(MIN_STEM, min(MAX_STEM, len(short)) + 1))):
                out[term] = out.get(term, 0) | bit
        before = w
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> (term, n0, n1, places), added up over a task's texts; the term '' counts the texts. ``places`` are those
    in texts of label 1."""
    sums: dict[str, list[int]] = {}

    def out():
        cols = [list(sums), *zip(*sums.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 3))],
                                          names=["term", "n0", "n1", "places"])
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            for term, places in (terms_in(text.as_py()) | {"": 0}).items():
                s = sums.get(term)
                if s is None:
                    s = sums[term] = [0, 0, 0]
                s[label] += 1
                if label:
                    s[2] |= places
            if len(sums) > FLUSH:
                yield out()
                sums.clear()
    if sums:
        yield out()


def count_terms(train: DataFrame) -> DataFrame:
    """Rows (text, label 0 or 1) -> term, n0, n1: texts of either label with the term; spread: about how many different
    words stand before it in texts of label 1 (linear counting over the bit set)."""
    kinds = F.lit(float(CONTEXTS))
    spread = -kinds * F.log((kinds - F.least(F.bit_count("places"), F.lit(CONTEXTS - 0.5))) / kinds)
    return save(train.mapInArrow(_count, "term string, n0 long, n1 long, places long").groupBy("term")
                .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("places").alias("places"))
                .select("term", "n0", "n1", spread.alias("spread")), "toxic-terms")


def lexicon(counts: DataFrame, terms: tuple[str, ...] = ()) -> tuple[list[str], list[float], int, int]:
    """(terms, their log odds, texts of label 0, texts of label 1)."""
    whole = counts.where("term = ''").first()
    n0, n1 = (whole.n0, whole.n1) if whole else (0, 0)
    given = [t.lower() + END for t in terms]
    if not n0 or not n1:
        return given, [GIVEN] * len(given), n0, n1
    tried = max(counts.count() - 1, 2)
    x = lambda part, n, total: F.when(part > 0, part * F.log(part * F.lit(float(n0 + n1)) / (F.lit(float(n)) * total))).otherwise(0.0)
    # a word of one text that has a thousand copies stands in one place: it counts as often as it has places
    hits = F.least(F.col("n1").cast("double"), F.col("spread"))
    total = F.col("n0") + hits
    g2 = 2 * (x(F.col("n0"), n0, total) + x(hits, n1, total)
              + x(n0 - F.col("n0"), n0, n0 + n1 - total) + x(n1 - hits, n1, n0 + n1 - total))
    parent = F.expr("substring(term, 1, length(term) - 1)")
    longer = counts.where("n1 > 0 and length(term) > 1").groupBy(parent.alias("term")).agg(F.max("n1").alias("top"))
    found = counts.where("term != '' and n1 > 1").withColumn("g2", g2) \
        .where((F.col("g2") > 2 * math.log(tried)) & (hits * n0 > F.col("n0") * n1)) \
        .join(longer, "term", "left").where(F.col("term").endswith(END) | (F.coalesce("top", F.lit(0)) < COVERED * F.col("n1")))
    rows = found.orderBy(F.desc("g2"), "term").limit(MAX_TERMS).select("term", "n0", "n1").collect()  # MAX_TERMS at most
    odds = {r.term: math.log((r.n1 + 0.5) / (n1 + 1)) - math.log((r.n0 + 0.5) / (n0 + 1)) for r in rows}
    kept: dict[str, float] = {}
    for term in sorted(odds, key=len):
        stems = [odds[term[:k]] for k in range(MIN_STEM, len(term)) if term[:k] in kept]
        if not stems or odds[term] > max(stems) + GAIN:
            kept[term] = odds[term]
    for term in given:
        kept.setdefault(term, GIVEN)
    return list(kept), list(kept.values()), n0, n1


# --- hits ---

HITS = T.StructType([T.StructField("n_words", T.LongType()),
                     T.StructField("hits", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("term", "errors", "cue")])))])
HITS_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([(c, pa.int32()) for c in ("term", "errors", "cue")])))])


def quoted(text: str, start: int, end: int) -> bool:
    """Inside quotation marks that open and close in its line."""
    a = text.rfind("\n", 0, start) + 1
    b = text.find("\n", end)
    before, after = text[a:start], text[end:b if b >= 0 else len(text)]
    return before.count('"') % 2 == 1 and '"' in after or any(
        before.rfind(o) > before.rfind(c) and c in after for o, c in ("“”", "«»", "„“"))


def hits_in(text: str | None, find) -> tuple[int, list[tuple[int, int, int]]]:
    """(number of words, hits (term, errors, cue)); ``find`` gives a word's (term, errors) or None."""
    low = text.lower() if text else ""
    words = TOKEN.findall(low)
    found = {w: hit for w in set(words) if (hit := find(w))}
    if not found:
        return len(words), []
    out = []
    for i, m in enumerate(TOKEN.finditer(low)):
        hit = found.get(m.group())
        if hit:
            near = words[max(0, i - CONTEXT):i] + words[i + 1:i + 1 + CONTEXT]
            out.append((*hit, 2 * quoted(low, m.start(), m.end()) + (not REPORTING.isdisjoint(near))))
    return len(words), out


def scan(terms: list[str], text: Column) -> Column:
    made = []  # one automaton per worker

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Automaton(terms))
        rows = [hits_in(t.as_py(), made[0].find) for t in texts]
        return pa.array([{"n_words": n, "hits": [dict(zip(("term", "errors", "cue"), h)) for h in hs]} for n, hs in rows], HITS_ARROW)
    return hits(text)


# --- weights, features, model ---

def weigh(train: DataFrame, odds: list[float], n0: int, n1: int) -> tuple[dict[tuple[int, int], float], list[float]]:
    """Weights of (term, errors), and the share of abuse by cue, from training rows (label, hits). The groups are bounded by
    the lexicon and the errors, and by the four cues."""
    hit = train.select("label", F.explode(F.array_distinct("hits")).alias("h"))
    by_term = train.select("label", F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["term"], h["errors"])))).alias("h")) \
        .groupBy(F.col("h").getField("term").alias("term"), F.col("h").getField("errors").alias("errors")) \
        .agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).collect()
    seen = {(r.term, r.errors): (r.n0, r.n1) for r in by_term}
    weights = {}
    for i, own in enumerate(odds):
        for d in range(3):
            c0, c1 = seen.get((i, d), (0, 0))
            # SHRINK texts whose odds are the term's own, less by each error
            share = 1 / (1 + math.exp(-own * MISS ** d) * max(n0, 1) / max(n1, 1))
            weights[i, d] = math.log((c1 + SHRINK * share) / max(n1, 1)) - math.log((c0 + SHRINK * (1 - share)) / max(n0, 1))
    cues = {r.cue: (r.n0, r.n1) for r in hit.groupBy(F.col("h.cue").alias("cue")).agg(
        F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).collect()}
    abuse = []
    for c, mean in enumerate(CUE_PRIOR):
        c0, c1 = cues.get(c, (0, 0))
        c0 = c0 * n1 / n0 if n0 else 0.0  # as if the labels were equally frequent
        abuse.append((c1 + CUE_STRENGTH * mean) / (c0 + c1 + CUE_STRENGTH))
    return weights, abuse


def figures(n_words: int, hits, weights: dict[tuple[int, int], float], abuse: list[float]) -> list[float]:
    best: dict[tuple[int, int], float] = {}
    n = 0
    for h in hits:
        w = weights[h["term"], h["errors"]] * abuse[h["cue"]]
        key = (h["term"], h["errors"])
        best[key] = max(best.get(key, -99.0), w)
        n += w > 0
    top = sorted((w for w in best.values() if w > 0), reverse=True)
    return [1.0, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, math.log1p(sum(top)), math.log1p(n),
            math.log1p(100.0 * n / max(n_words, 1))]


def features(weights: dict, abuse: list[float], hits: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def one(rows: pa.Array) -> pa.Array:
        return pa.array([figures(r["n_words"], r["hits"], weights, abuse) for r in rows.to_pylist()], pa.list_(pa.float64()))
    return one(hits)


def fit(train: DataFrame) -> list[float]:
    """Coefficients from all rows (label, x): ridge logistic regression towards PRIOR, by Newton steps."""
    k, beta = len(PRIOR), PRIOR.copy()
    for _ in range(STEPS):
        now = beta.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k)
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column("x").to_pylist())
                    p = 1 / (1 + np.exp(-x @ now))
                    total[:k] += x.T @ (b.column("label").to_numpy(zero_copy_only=False) - p)
                    total[k:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(total)], names=["i", "v"])

        got = train.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(k + k * k)
        for r in got:
            total[r.i] = r.v
        step = np.linalg.solve(total[k:].reshape(k, k) + RIDGE * np.eye(k), total[:k] - RIDGE * (beta - PRIOR))
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return [round(float(b), 6) for b in beta]  # sums may differ in the last bits from run to run


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
                   terms: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_hits. ``terms`` are words that the lexicon has at
    any rate."""
    arrow_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    y = save(labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
             .agg(F.max((F.col(label) > 0).cast("int")).alias("label")), "toxic-labels")
    y = small(y.where(~is_held_out(F.col("label_id"))))

    train = d.join(y, d.doc_id == y.label_id)
    found, odds, n0, n1 = lexicon(count_terms(train.select("text", "label")), terms)
    scanned = save(d.select("doc_id", scan(found, F.col("text")).alias("s")), "toxic-hits")

    train = scanned.join(y, scanned.doc_id == y.label_id).select("label", "s")
    weights, abuse = weigh(train.select("label", "s.hits"), odds, n0, n1)
    beta = fit(save(train.select("label", features(weights, abuse, F.col("s")).alias("x")), "toxic-train"))

    x = fresh("x", ["doc_id"])
    out = scanned.withColumn(x, features(weights, abuse, F.col("s")))
    z = sum((F.col(x)[i] * b for i, b in enumerate(beta)), F.lit(0.0))
    score = F.round(1 / (1 + F.exp(-z)), 6)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                      (score >= 0.5).cast("int").alias("predicted"), F.size("s.hits").cast("long").alias("n_hits"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
