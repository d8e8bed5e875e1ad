"""Exact duplicates by an extendible-hash index on shared files (DataFrame and SQL functions only).

1. ``entries``: one narrow row per document (hash key, length), written to the shared folder.
2. ``directory``: starts as one bucket over the whole key range and doubles while a bucket
   holds more distinct keys than ``capacity``; only overfull buckets split. A directory slot
   (the leading ``depth`` bits of a key) names its bucket; shallow buckets own several slots.
3. ``index``: texts are grouped by (key, bytes of the normalised text). Copies are combined
   before the shuffle, so a group holding a third of all rows sends one row per task. One narrow
   row per distinct text then goes to its bucket's owner, the task that writes the bucket's key
   range: texts that share a key but differ in bytes form a chain there. The index keeps digests
   only, no texts.
4. every document looks its bucket and key up in the index; only where a chain has several
   links does the text's digest choose the link.

Normal form: the text without ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and blank
texts are one group. Of equal texts the row with the most code points, then the smallest doc_id
(null last) stays. Rows repeated whole share keep_id; ``drop_duplicates`` keeps one of them.
An empty table gives an empty result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import ASCII_SPACE, fresh, save, small, table

BUCKET_CAPACITY = 65_536  # distinct keys per bucket
MAX_DEPTH = 40            # bits of the key a directory may use


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def hash_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[DataFrame, int]:
    """(slot -> bucket, local_depth) for distinct ``key`` rows, and the directory's depth.

    Doubling: each round counts the keys of the buckets that are still overfull, one bit
    deeper. Rounds end when every bucket is within capacity (or at MAX_DEPTH, where chains
    take the rest). Only bucket counts, never keys, leave the executors."""
    spark, depth, done = keys.sparkSession, 0, []
    open_keys = keys
    while True:
        counts = save(open_keys.groupBy(_slot(F.col("key"), depth).alias("slot"))
                      .agg(F.count(F.lit(1)).alias("n")), f"directory-{depth}")
        over = counts.where(F.col("n") > capacity)
        if depth == MAX_DEPTH or over.isEmpty():
            done.append((counts, depth))
            break
        done.append((counts.where(F.col("n") <= capacity), depth))
        open_keys = open_keys.join(over.select(F.col("slot").alias("over")),
                                   _slot(F.col("key"), depth) == F.col("over"), "left_semi")
        depth += 1
    # a bucket of local depth d owns the 2^(depth - d) slots that extend its bits
    slots = None
    for counts, d in done:
        owned = counts.select(
            F.explode(F.sequence(F.shiftleft("slot", depth - d),
                                 F.shiftleft(F.col("slot") + 1, depth - d) - 1)).alias("slot"),
            F.shiftleft("slot", depth - d).alias("bucket"), F.lit(d).alias("local_depth"))
        slots = owned if slots is None else slots.unionByName(owned)
    return slots if slots is not None else spark.createDataFrame([], "slot long, bucket long, local_depth int"), depth


def build_index(docs: DataFrame, text: str, id_col: str, directory: DataFrame, depth: int) -> DataFrame:
    """One row per distinct normalised text: bucket, key, link (its place in the key's
    chain), links, sha, keep_id, group_size; written by bucket."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    d = d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("len"), normalised(F.col("text")).alias("norm"))
    d = d.withColumn("key", hash_key(F.col("norm")))
    best = F.max_by("doc_id", F.struct("len", F.col("doc_id").isNotNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))))
    texts = d.groupBy("key", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                         F.max("len").alias("len"))
    entries = texts.select("key", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size", "len")
    entries = entries.withColumn("slot", _slot(F.col("key"), depth)).join(small(directory), "slot").drop("slot")
    # each bucket goes to its owner, which orders its key range and numbers the links of its chains
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "key", "sha")
    chain = Window.partitionBy("bucket", "key")
    return owned.withColumn("link", F.row_number().over(chain.orderBy("sha"))) \
                .withColumn("links", F.count(F.lit(1)).over(chain))


def duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                     capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row per document: doc_id, len, key, bucket, link, keep_id, group_size, text_sha256, kept."""
    entries = save(docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("doc_len"),
                               hash_key(normalised(F.col(text))).alias("key")), "entries")
    directory, depth = build_directory(entries.select("key").distinct(), capacity)
    directory = save(directory, "directory")
    index = save(build_index(docs, text, id_col, directory, depth), "index")

    # Owners probe their key ranges. Chains of one link (all, but for hash collisions) need no text.
    single = index.where("links = 1")
    out = entries.withColumn("slot", _slot(F.col("key"), depth)).join(small(directory.select("slot", "bucket")), "slot") \
                 .join(single, ["bucket", "key"])
    chained = index.where("links > 1")
    if not chained.isEmpty():
        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
        d = d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("doc_len"), normalised(F.col("text")).alias("norm"))
        d = d.select("doc_id", "doc_len", hash_key(F.col("norm")).alias("key"), F.sha2("norm", 256).alias("sha"))
        out = out.unionByName(d.join(chained, ["key", "sha"]), allowMissingColumns=True)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("doc_len") == F.col("len"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"),
                      "bucket", "key", "link")


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                    capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """``docs`` with one row per normalised text, all columns as they were.

    Texts that occur once (most) are settled by their key alone; a row of a group stays if it
    has the keeper's id and length. Only where several rows do (rows repeated whole, or null
    ids) a window picks one by content."""
    out = docs.columns
    key, rank = fresh("dedup_key", out), fresh("dedup_rank", out)
    entries = save(docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("doc_len"),
                               hash_key(normalised(F.col(text))).alias("key")), "entries")
    directory, depth = build_directory(entries.select("key").distinct(), capacity)
    index = save(build_index(docs, text, id_col, save(directory, "directory"), depth), "index")
    side = save(index.where("links > 1 or group_size > 1"), "copies")
    twins = entries.join(small(side.select("key", "keep_id", "len")), "key") \
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("doc_len") == F.col("len"))) \
        .groupBy("key", "keep_id", "len").count().where("count > 1")

    side = side.select(*[F.col(c).alias(f"{key}_{c}") for c in ("key", "sha", "links", "keep_id", "len")])
    norm = normalised(F.col(text))
    same = (F.col(key) == F.col(f"{key}_key")) & ((F.col(f"{key}_links") == 1) | (F.sha2(norm, 256) == F.col(f"{key}_sha")))
    alone = F.col(f"{key}_key").isNull()
    keeper = F.col(id_col).eqNullSafe(F.col(f"{key}_keep_id")) & \
        (F.length(F.coalesce(text, F.lit(""))) == F.col(f"{key}_len"))
    kept = docs.withColumn(key, hash_key(norm)).join(small(side), same, "left").where(alone | keeper)
    if twins.isEmpty():
        return kept.select(*out)
    one = Window.partitionBy(f"{key}_key", f"{key}_sha").orderBy(F.xxhash64(text))
    picked = kept.where(~alone).withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    return kept.where(alone).select(*out).unionByName(picked.select(*out))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
