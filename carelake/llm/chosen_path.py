"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles (five words; a text of one to four words is one shingle). Texts
with equal sets are one class, and the join runs on classes. A class is known by a sketch: MinHash
tokens, so that two sets share a token with the probability of their similarity.

* Each of RUNS independent runs sends every class down a path: a node holds the classes that share
  the tokens sampled on the way. A node of more than SMALL classes is split again, on BRANCH newly
  sampled tokens (a class goes to a child for each), at most LEVELS deep. Sets that share little are
  apart after a token or two; sets that are alike stay together on some path of nearly every run.
* A node of at most SMALL classes, or of the last level, is compared by brute force; so is one whose
  members are alike on the whole (mean similarity ALIKE or more): splitting gains nothing there. A large one
  (thousands of copies of one text that differ by a word never split) is dealt into square blocks
  of BLOCK x BLOCK classes, each a task of its own, so no group is held whole.
* A pair that shares several leaves belongs to the first of them, which is known from the two lists
  of leaves alone: every pair is verified once and no table of pairs is ever made.
* First the sketches are compared (at least half the tokens equal); only classes with such a partner
  bring their texts, whose shingle sets then decide exactly.

Recall: a pair of similarity s survives a run with probability about s (1 - (1 - s)^2)^2 at worst
(s alone where nodes are small), so 8 runs miss a pair of similarity 0.8 once in 40,000.

Result: per document its class (the least doc_id among the documents connected by links) and its
number of links: other documents at THRESHOLD or more, those with an equal set included.

Null, empty and blank texts have no shingles: they have no links and their class is their own doc_id.
Rows repeated whole count as documents. Null doc_ids have links like others; a class of null ids only
has the class null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, groups, save, small, table
from carelake.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # similarity as a fraction
RUNS, LEVELS, BRANCH = 8, 3, 2
TOKENS = RUNS * (1 + BRANCH * (LEVELS - 1))
SMALL = 128
ALIKE = 0.5
BLOCK = 256

_rng = np.random.default_rng(20240521)
_MUL = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = T.StructType([T.StructField("sid", T.BinaryType()), T.StructField("sketch", T.BinaryType())])


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    s = np.full(n, k, np.uint64)
    for j in range(k):
        s += w[j:j + n] * _PLACE[j]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def sketch(s: np.ndarray) -> np.ndarray:
    """TOKENS MinHash tokens (32 bits each) of a set."""
    low = np.full(TOKENS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, ((s[None, at:at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(8)).astype(np.uint32)


@F.arrow_udf(SKETCH)
def sketches(texts: pa.Array) -> pa.Array:
    hashes, sids, out = WordHashes(), [], []
    for text in texts.to_pylist():
        s = shingles(text, hashes)
        sids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        out.append(sketch(s).tobytes() if len(s) else None)
    return pa.StructArray.from_arrays([pa.array(sids, pa.binary()), pa.array(out, pa.binary())], ["sid", "sketch"])


def _token(index) -> F.Column:
    return F.substr("sketch", index * 4 + 1, F.lit(4))


def leaves(reps: DataFrame) -> DataFrame:
    """(sid, leaf, size): the leaf nodes of every class that it does not have for itself."""
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), _token(F.lit(r))).alias("node"))
                     for r in range(RUNS)])
    nodes = reps.select("sid", F.explode(runs).alias("x")).select("sid", "x.*")
    done = []
    for level in range(1, LEVELS + 1):
        # a node's number starts with its run, so that most pairs belong to a leaf of the first run
        nodes = nodes.withColumn("leaf", F.shiftleft(F.col("run").cast("long"), 56) + F.shiftrightunsigned("node", 8))
        sizes = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        nodes = save(nodes.join(sizes, "leaf"), f"nodes-{level}")
        done.append(nodes if level == LEVELS else nodes.where(F.col("size") <= SMALL))
        nodes = nodes.where(F.col("size") > SMALL)
        if level == LEVELS or nodes.isEmpty():
            break
        first = F.lit(RUNS * (1 + BRANCH * (level - 1))) + F.col("run") * BRANCH
        children = F.array(*[F.struct(F.lit(b).alias("branch"), F.xxhash64("node", F.lit(b), _token(first + b)).alias("child"))
                             for b in range(BRANCH)])
        children = save(nodes.join(reps.select("sid", "sketch"), "sid").select("sid", "run", "leaf", "size", F.explode(children).alias("x"))
                        .select("sid", "run", "leaf", "size", "x.*"), f"children-{level}")
        # the chance that two members share a new token is the node's mean similarity
        together = children.groupBy("leaf", "size", "branch", "child").agg(F.count(F.lit(1)).alias("c"))
        alike = together.groupBy("leaf", "size").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs")) \
            .where(F.col("pairs") >= ALIKE * BRANCH * F.col("size") * (F.col("size") - 1)).select("leaf")
        alike = save(alike, f"alike-{level}")
        done.append(nodes.join(alike, "leaf", "left_semi"))
        nodes = children.join(alike, "leaf", "left_anti").select("sid", "run", F.col("child").alias("node"))
    out = done[0].select("sid", "leaf", "size")
    for d in done[1:]:
        out = out.unionByName(d.select("sid", "leaf", "size"))
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """A row of leaf, size, sid for each square block that it takes part in: ``square`` names the block,
    ``side`` says as what (0 row, 1 column, 2 both: a block on the diagonal)."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("n", n).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    square = F.concat_ws(":", "leaf", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return rows.withColumn("square", square).withColumn("side", side).drop("n", "mine", "other")


def _owned(leaf: int, lists: list[list[int]], ok: np.ndarray) -> np.ndarray:
    """``ok`` without the pairs that share a leaf before this one."""
    codes: dict[int, int] = {}
    at = [(i, codes.setdefault(x, len(codes))) for i, xs in enumerate(lists) for x in xs if x < leaf]
    if at:
        i, c = np.asarray(at).T
        keep = np.bincount(c, minlength=len(codes)) > 1
        new = np.cumsum(keep) - 1
        i, c = i[keep[c]], new[c[keep[c]]]
        has = np.zeros((len(lists), int(keep.sum())), np.float32)
        has[i, c] = 1
        ok &= (has @ has.T) == 0
    return ok


def _pairs_allowed(side: np.ndarray) -> np.ndarray:
    """Pairs of a square block: row with column, or any two on the diagonal."""
    ok = (side[:, None] == 0) & (side[None, :] == 1)
    ok |= ok.T
    ok |= (side[:, None] == 2) & (side[None, :] == 2)
    np.fill_diagonal(ok, False)
    return ok


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in groups(batches, "square"):
        side = t["side"].to_numpy()
        ok = _pairs_allowed(side)
        if not ok.any():
            continue
        tokens = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(len(side), TOKENS)
        equal = np.zeros(ok.shape, np.uint8)
        for k in range(TOKENS):
            equal += tokens[:, k][:, None] == tokens[:, k][None, :]
        ok &= 2 * equal >= TOKENS
        if ok.any():
            ok = _owned(t["leaf"][0].as_py(), t["leaves"].to_pylist(), ok)
        t = t.drop_columns(["sketch"]).filter(pa.array(ok.any(axis=1)))
        yield from t.to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    p, q = THRESHOLD
    for t in groups(batches, "square"):
        side = t["side"].to_numpy()
        ok = _pairs_allowed(side)
        if not ok.any():
            continue
        sets = [shingles(x, hashes) for x in t["text"].to_pylist()]
        n = np.asarray([len(s) for s in sets])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), n)
        shared = count > 1
        new = np.cumsum(shared) - 1
        row, code = row[shared[code]], new[code[shared[code]]]
        by = np.argsort(code, kind="stable")
        row, code = row[by], code[by]
        common = np.zeros(ok.shape, np.int64)
        for at in range(0, int(shared.sum()), 8192):
            a, b = np.searchsorted(code, [at, at + 8192])
            has = np.zeros((len(sets), 8192), np.float32)
            has[row[a:b], code[a:b] - at] = 1
            common += (has @ has.T).astype(np.int64)
        ok &= q * common >= p * (n[:, None] + n[None, :] - common)
        if ok.any():
            ok = _owned(t["leaf"][0].as_py(), t["leaves"].to_pylist(), ok)
        hit = ok.any(axis=1)
        if not hit.any():
            continue
        links = ok @ t["n_docs"].to_numpy()
        # a spanning forest: every class points to the first class of its part of the block
        root = np.arange(len(sets))
        while True:
            low = np.where(ok, root[None, :], len(sets)).min(axis=1)
            new_root = np.minimum(root, low)
            new_root = new_root[new_root]
            if (new_root == root).all():
                break
            root = new_root
        sid = t["sid"].to_pylist()
        rows = np.flatnonzero(hit).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([sid[i] for i in rows], pa.binary()), pa.array(links[rows], pa.int64()),
                                          pa.array([sid[root[i]] for i in rows], pa.binary())], ["sid", "links", "root"])


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, and (sid, content) that tell its set and text."""
    arrow_batches(docs.sparkSession)
    content = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    known = save(docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), sketches(F.col(text)).alias("x"))
                 .select("doc_id", "content", "x.*"), "sketches")
    reps = save(known.where("sid is not null").groupBy("sid").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("content").alias("content"), F.max("sketch").alias("sketch")), "classes")

    at = save(leaves(reps), "leaves")
    listed = at.groupBy("sid").agg(F.collect_list("leaf").alias("leaves"))  # at most RUNS * BRANCH ^ (LEVELS - 1)
    rows = _blocks(at).join(listed.join(reps.select("sid", "n_docs", "sketch"), "sid"), "sid")
    columns = "square string, side int, leaf long, sid binary, leaves array<long>, n_docs long"
    found = rows.select("square", "side", "leaf", "sid", "leaves", "n_docs", "sketch") \
        .repartition("square").sortWithinPartitions("square").mapInArrow(_candidates, columns)
    found = save(found, "candidates")

    wanted = save(found.select("sid").distinct().join(reps.select("sid", "content"), "sid"), "wanted")
    t = docs.select(content.alias("content"), F.col(text).alias("text")) \
        .join(small(wanted.select("content")), "content", "left_semi").dropDuplicates(["content"])
    texts = wanted.join(t, "content").select("sid", "text")
    hits = save(found.join(texts, "sid").select("square", "side", "leaf", "sid", "leaves", "n_docs", "text")
                .repartition("square").sortWithinPartitions("square")
                .mapInArrow(_verified, "sid binary, links long, root binary"), "links")

    roots = components(hits.where("sid != root").select(F.col("sid").alias("u"), F.col("root").alias("v")))
    links = hits.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = reps.select("sid", "n_docs").join(links, "sid", "left") \
        .join(roots.withColumnRenamed("node", "sid"), "sid", "left") \
        .select("sid", F.coalesce("root", "sid").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    members = known.select("doc_id", "content", "sid").join(classes, "sid", "left")
    # a table of its own, so that the join on the root of a large class can be split
    first = save(members.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id")), "first")
    return members.join(first, "root", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "sid", "root", "content")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: the least doc_id (null first), of equal ids the least text
    digest; all columns as they were. Rows equal in id and text stay or go together."""
    found = save(near_duplicates(docs, text, id_col).where("n_links > 0"), "near")
    stays = save(found.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("stays")), "stays")
    goes = found.join(stays, "root").where(~F.struct("doc_id", "content").eqNullSafe(F.col("stays")))
    goes = save(goes.select(F.col("doc_id").alias("near_id"), F.col("content").alias("near_content")).distinct(), "goes")
    content = F.unhex(F.md5(F.coalesce(docs[text], F.lit(""))))
    g = small(goes)
    return docs.join(g, docs[id_col].eqNullSafe(g["near_id"]) & (content == g["near_content"]), "left_anti")


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
