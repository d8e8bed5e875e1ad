"""Prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by the conversation's own turns behind its first h.
Its texts are never put together. With s(t) a number of a turn's role and text, the turns 1..d have the fingerprint
``sum(s(t_i) B^i)`` modulo two primes, a monoid under (f, n) + (g, m) = (f + B^n g, n + m):

1. ``turns``: turns are range-sorted by (conversation, turn, role, text); each task adds up the fingerprints of the
   pieces of conversations it holds, and the sums of a conversation's earlier pieces (one row per task it spans) go on
   top. So a conversation with a third of all turns is spread over many tasks.
2. ``paths``: prefix d of rebuilt conversation c has the base's fingerprint at d within the head, and behind it
   ``base[m] + B^(m-h) (own[pos] - own[h])``: sums and a shift by one of nine constants. A row keeps the reference
   (conversation, position) of its last turn in the source table, not the turn.
3. ``nodes``: paths grouped by (depth, fingerprint). Equality is verified: all turns that share a number must have one
   role and text (grouped by content over the referenced turns), and all rows of a node must have one last turn and one
   parent. By induction over the depth, the groups are then exactly the equal prefixes; else all is done again with
   another seed.
4. subtree figures without walking the tree: a node's smallest member c stays the smallest all the way down, so the nodes
   fall into chains, one per conversation. A node's subtree sum is the sum of its members' chain totals less what its own
   chain holds above it. All are grouped sums and sums in blocks of ``BLOCK`` positions.
5. the ids of the conversations that end at a node are sorted by range, joined in chunks of ``BLOCK`` and hashed as a
   stream, so no task holds a node's ids.

Joins on a conversation are salted by block, joins of children to a parent with more than ``HOT`` of them take the few such
parents apart.

Null role and text are empty. Turns are in ascending order, null first; ties by role, then text, so repeated rows follow
each other. Rows without conv_id belong to no conversation and are left out. Negative ids: c - c % 5 with the
remainder in 0..4. Long texts meet only hash and sort, in the JVM. An empty table has no node, not even the root. Only
the four columns named are read; others, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import arrow_batches, save, small, table

PRIMES = (2_147_483_647, 2_147_483_629)  # the two largest below 2^31: products fit a long
EVERY, HEADS = 5, 9  # base of c is c - c % EVERY; its head has crc32(c) % HEADS turns
BLOCK = 4096         # positions of a conversation, or ids of a node, that go together
HOT = 10_000         # children beyond which a parent is joined apart
TRIES = 8            # seeds before giving up; one is enough but for a collision of 62 bits


def turn_number(seed: int, role: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), role, text)


def base_of(seed: int, lane: int) -> int:
    return 1_000_003 + 7919 * (2 * seed + lane)


def powers(exponents: np.ndarray, lane: int, seed: int) -> np.ndarray:
    """B^n modulo the lane's prime, by squaring, for all exponents at once."""
    p, square = PRIMES[lane], base_of(seed, lane) % PRIMES[lane]
    out, left = np.ones(len(exponents), np.int64), exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % p, out)
        square, left = square * square % p, left >> 1
    return out


LOCAL = "conv_id long, part int, local long, turn_no long, n_bytes long, f1 long, g1 long, f2 long, g2 long"


def _scan(seed: int):
    """Sorted turns of a task -> place within the task's piece of the conversation, and the piece's fingerprint up to
    the turn (f) and before it (g)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy(zero_copy_only=False)
            number = b.column("turn_no").to_numpy(zero_copy_only=False)
            new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            local = np.where(first < 0, place + 1 + np.arange(len(conv)), 1 + np.arange(len(conv)) - first)
            cols = {"conv_id": conv, "part": np.full(len(conv), part, np.int32), "local": local, "turn_no": number,
                    "n_bytes": b.column("n_bytes")}
            for lane, p in enumerate(PRIMES):
                term = (1 + number % (p - 1)) * powers(local, lane, seed) % p
                total = np.cumsum(term)
                before = np.where(first < 0, -sums[lane], np.where(first > 0, total[first - 1], 0))
                f = (total - before) % p
                cols[f"f{lane + 1}"], cols[f"g{lane + 1}"] = f, (f - term) % p
                sums[lane] = int(f[-1])
            last, place = conv[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], names=list(cols))
    return scan


def _shift(seed: int, n: Column, lane: int) -> Column:
    """B^n as an Arrow UDF, for the few pieces of conversations that span tasks."""
    @F.arrow_udf(T.LongType())
    def power(x: pa.Array) -> pa.Array:
        return pa.array(powers(x.to_numpy(zero_copy_only=False), lane, seed))
    return power(n)


def _contents(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the rows that belong to a conversation, nothing null but turns."""
    return convs.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def turns(convs: DataFrame, seed: int) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), turn_no, n_bytes, fingerprints f1, f2 up to it and g1, g2 before it."""
    # equal rows may be a third of all: the task that reads them is the last sort key, which parts them
    keys = ["conv_id", "turn", "role", "text", "reader"]
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows = _contents(convs).withColumn("reader", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("conv_id", turn_number(seed, F.col("role"), F.col("text")).alias("turn_no"),
                F.octet_length("text").cast("long").alias("n_bytes"))
    local = save(rows.mapInArrow(_scan(seed), LOCAL), "trie-local")

    # pieces that go on with a conversation of earlier tasks: at most one per task
    piece = local.groupBy("conv_id", "part").agg(F.max("local").alias("n"), F.max_by(F.struct("f1", "f2"), "local").alias("f"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = piece.withColumn("pieces", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).where("pieces > 1") \
        .withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    for lane, p in enumerate(PRIMES, 1):
        spans = spans.withColumn(f"s{lane}", _shift(seed, F.col("before"), lane - 1))
        spans = spans.withColumn(f"t{lane}", F.col(f"s{lane}") * F.col(f"f.f{lane}") % p)
    for lane, p in enumerate(PRIMES, 1):
        spans = spans.withColumn(f"c{lane}", F.sum(f"t{lane}").over(w) % p)
    carry = save(spans.where("before > 0").select("conv_id", "part", "before", "s1", "s2", "c1", "c2"), "trie-carry")

    out = local.join(small(carry), ["conv_id", "part"], "left")
    on_top = [F.when(F.col("before").isNull(), F.col(f"{x}{lane}"))
              .otherwise((F.col(f"c{lane}") + F.col(f"s{lane}") * F.col(f"{x}{lane}") % p) % p).alias(f"{x}{lane}")
              for x in "fg" for lane, p in enumerate(PRIMES, 1)]
    return out.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_no", "n_bytes", *on_top)


def _block(col: str) -> Column:
    return F.floor(F.col(col) / BLOCK)


def paths(turn: DataFrame, seed: int) -> DataFrame:
    """One row per prefix of each rebuilt conversation: conv_id, depth, f1, f2, the parent's fingerprint e1, e2, the
    last turn's number, bytes and reference (src_conv, src_pos), and whether the conversation ends there."""
    item = F.struct("pos", "turn_no", "n_bytes", "f1", "f2", "g1", "g2")
    firsts = turn.where(F.col("pos") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    length = turn.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = save(firsts.join(length, "conv_id"), "trie-firsts")
    base = own.select(F.col("conv_id").alias("base"), F.col("items").alias("head"))
    c = own.withColumn("base", F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(EVERY))) \
           .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS).join(base, "base", "left") \
           .withColumn("head", F.expr("coalesce(slice(head, 1, cast(h as int)), slice(items, 1, 0))")) \
           .withColumn("m", F.size("head").cast("long")) \
           .withColumn("depth", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda arr, k, field: F.coalesce(F.get(F.col(arr), (F.col(k) - 1).cast("int"))[field], F.lit(0).cast("long"))
    for lane, p in enumerate(PRIMES, 1):
        back = pow(base_of(seed, lane - 1), -1, p)
        shift = F.get(F.array(*[F.lit(pow(back, k, p)) for k in range(HEADS)]), (F.col("h") - F.col("m")).cast("int"))
        c = c.withColumn(f"k{lane}", shift).withColumn(f"a{lane}", at("head", "m", f"f{lane}")) \
             .withColumn(f"o{lane}", at("items", "h", f"f{lane}"))
    c = save(c, "trie-rebuilt")

    zero = F.lit(0).cast("long")
    cols = ["conv_id", "depth", "f1", "f2", "e1", "e2", "turn_no", "n_bytes", "src_conv", "src_pos", "ends"]
    root = c.select("conv_id", zero.alias("depth"), *[zero.alias(x) for x in ("f1", "f2", "e1", "e2", "turn_no", "n_bytes")],
                    F.lit(None).cast("long").alias("src_conv"), F.lit(None).cast("long").alias("src_pos"),
                    (F.col("depth") == 0).alias("ends"))
    head = c.select("conv_id", "base", "depth", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.f1", "t.f2", F.col("t.g1").alias("e1"), F.col("t.g2").alias("e2"),
        "t.turn_no", "t.n_bytes", F.col("base").alias("src_conv"), F.col("t.pos").alias("src_pos"),
        (F.col("t.pos") == F.col("depth")).alias("ends"))
    tail_of = c.where("n > h").select("conv_id", "h", "m", F.col("depth").alias("len"), "k1", "k2", "a1", "a2", "o1", "o2",
                                      F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    tail = turn.withColumn("block", _block("pos")).join(tail_of, ["conv_id", "block"]).where("pos > h")
    moved = lambda x, lane, p: (F.col(f"a{lane}") + F.col(f"k{lane}") * F.pmod(F.col(x) - F.col(f"o{lane}"), F.lit(p)) % p) % p
    tail = tail.select(
        "conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"),
        *[moved(f"{x}{lane}", lane, p).alias(f"{y}{lane}") for x, y in (("f", "f"), ("g", "e")) for lane, p in enumerate(PRIMES, 1)],
        "turn_no", "n_bytes", F.col("conv_id").alias("src_conv"), F.col("pos").alias("src_pos"),
        (F.col("m") + F.col("pos") - F.col("h") == F.col("len")).alias("ends"))
    return save(root.select(*cols).unionByName(head.select(*cols)).unionByName(tail.select(*cols)), "trie-paths")


NODE = ["depth", "f1", "f2"]


def verified_nodes(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes) under the first seed without a collision. A node has its smallest member, the members' number, its last
    turn's bytes and reference, and its parent's fingerprint."""
    for seed in range(TRIES):
        p = paths(turns(convs, seed), seed)
        nodes = save(p.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
            F.max("e1").alias("e1"), F.max("e2").alias("e2"), F.min(F.struct("src_conv", "src_pos")).alias("turn"),
            ((F.max("turn_no") != F.min("turn_no")) | (F.max("e1") != F.min("e1")) | (F.max("e2") != F.min("e2"))).alias("mixed")),
            "trie-nodes")
        # the numbers stand for the turns referred to: one role and text each
        texts = _contents(convs).select(turn_number(seed, F.col("role"), F.col("text")).alias("turn_no"), "role", "text").distinct()
        shared = texts.groupBy("turn_no").count().where("count > 1")
        if nodes.where("mixed").isEmpty() and shared.isEmpty():
            return p, nodes.drop("mixed")
    raise RuntimeError(f"fingerprints collide under {TRIES} seeds")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends sorted by node and id -> chunks of a node's ids, joined by commas."""
    part, chunk, ids, key = TaskContext.get().partitionId(), 0, [], None
    names = [*NODE, "part", "chunk", "ids"]
    for b in batches:
        rows = []
        for *k, c in zip(*(b.column(x).to_pylist() for x in [*NODE, "conv_id"])):
            if k != key or len(ids) == BLOCK:
                if ids:
                    rows.append((*key, part, chunk, ",".join(ids)))
                key, chunk, ids = k, chunk + 1, []
            ids.append(str(c))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, part, chunk, ",".join(ids))], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> the SHA-256 of each node's ids, taken as a stream."""
    key, h = None, None
    names = [*NODE, "ends_sha256"]
    for b in batches:
        rows = []
        for *k, ids in zip(*(b.column(x).to_pylist() for x in [*NODE, "ids"])):
            if k != key:
                if h:
                    rows.append((*key, h.hexdigest()))
                key, h = k, sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=names)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], names=names)


def end_digests(p: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 for the nodes at which a conversation ends."""
    ends = p.where("ends").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = ends.mapInArrow(_join_ids, "depth long, f1 long, f2 long, part long, chunk long, ids string")
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "chunk")
    return save(chunks.mapInArrow(_digest, "depth long, f1 long, f2 long, ends_sha256 string"), "trie-ends")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and src_conv, src_pos: where its last turn stands in ``convs`` (null for the root)."""
    arrow_batches(convs.sparkSession)
    p, nodes = verified_nodes(convs)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("e1").alias("f1"), F.col("e2").alias("f2")) \
                    .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = save(nodes.join(children, NODE, "left").fillna(0, ["n_children"])
                      .withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn("block", _block("depth")), "trie-nodes")

    # chains: the nodes with one smallest member, in blocks of depth
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    up = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = save(blocks.withColumn("above", F.coalesce(F.sum("saved").over(up), F.lit(0))), "trie-chains")
    chains = blocks.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.max("block").alias("block")) \
                   .select("conv_id", "saved", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("block"))
    below = p.select("conv_id", *NODE, _block("depth").alias("block")).join(chains, ["conv_id", "block"]) \
             .groupBy(*NODE).agg(F.sum("saved").alias("below"), F.sum("leaf").alias("n_leaves"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("saved").over(inside), F.lit(0))) \
                 .join(blocks.select("conv_id", "block", "above"), ["conv_id", "block"]).drop("block")

    out = nodes.join(below, NODE).join(end_digests(p), NODE, "left") \
               .withColumn("saved_tokens", F.col("below") - F.col("above") - F.col("before")) \
               .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())))
    out = save(out.drop("saved", "before", "above", "below"), "trie-out")

    # the parent's smallest member: children of the few parents with very many are joined by broadcast
    parent = out.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("e1"), F.col("f2").alias("e2"),
                        F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = ["depth", "e1", "e2"]
    hot = save(parent.where(F.col("n_children") > HOT).drop("n_children"), "trie-hot")
    rest = parent.where(F.col("n_children").between(1, HOT)).drop("n_children")
    out = out.join(small(hot.withColumnRenamed("parent_conv_id", "hot_conv_id")), up, "left")
    cold = out.where(F.col("hot_conv_id").isNull()).drop("hot_conv_id").join(rest, up, "left")
    out = out.where(F.col("hot_conv_id").isNotNull()).withColumnRenamed("hot_conv_id", "parent_conv_id").unionByName(cold)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
                      F.col("turn.src_conv").alias("src_conv"), F.col("turn.src_pos").alias("src_pos"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("src_conv", "src_pos")
