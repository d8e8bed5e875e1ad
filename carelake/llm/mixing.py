"""Mixing sources to target weights, cut at exact budgets.

Every document gets a hash-random key. Within each source the documents stand in key order; prefix
sums of their sizes decide which are taken: the whole source once for every full epoch of its
budget, then documents from the start until the rest of the budget is spent (the document on the
boundary is taken in part, so a source takes exactly its budget, its target without the fraction).

The order and its sums are distributed: keys are uniform, so a source of n documents falls into
n / BLOCK_ROWS even key ranges (blocks) that need no sampling. A block is sorted and summed in one
task, the sums of the blocks before it are added. A source with a third of all rows is many blocks.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share the total size.
A target stops at MAX_EPOCHS times its source's size; what is over is shared anew by weight among
the others until none is above.

Null, empty and blank texts have size 0 and take 0. Null sources are one source. Rows repeated whole
tie; which of them is cut at the boundary makes no difference. Keys come from md5 of the doc_id
(null as ''), so reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import fresh, n_words, save, small, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_ROWS = 4_096
SEED = "mix-1"


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size) -> the same with target (double).

    Sharing the excess again and again fills the sources up in the order of size per weight, so one
    running sum over the sources in that order finds the end of the rounds: the first k sources are
    capped, where k is the least count that leaves nobody above the cap. Runs on one row per source."""
    lcm = math.lcm(*weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (rank % len(weights)).cast("int") + 1)
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_fill = Window.orderBy((F.col("cap") * (F.lit(lcm) / F.col("w")).cast("long")), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
          .withColumn("w_left", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the first source, in fill order, whose share of what is left stays within its cap ends the rounds
    open_ = F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")
    s = s.withColumn("fill", F.row_number().over(by_fill)).withColumn("open", open_)
    s = s.withColumn("end", F.min(F.when(F.col("open"), F.struct("fill", "left", "w_left"))).over(everyone))
    share = (F.col("end.left") * F.col("w")).cast("double") / F.col("end.w_left").cast("double")
    target = F.when(F.col("end").isNull() | (F.col("fill") < F.col("end.fill")), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "n", "source_size", target.alias("target"))


def prefix_sums(rows: DataFrame, n_blocks: Column, key: str, value: str, by: str, order: list) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``by`` that come first
    in the order of ``key`` (uniform md5 hex), then ``order``. ``n_blocks``: key ranges of the row's group."""
    u = F.conv(F.substring(key, 1, 12), 16, 10).cast("long")  # 48 uniform bits
    rows = rows.withColumn("block", F.shiftrightunsigned(u * n_blocks, 48))
    sums = rows.groupBy(by, "block").agg(F.sum(value).alias("block_sum"))
    earlier = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = save(sums.select(F.col(by).alias("g"), F.col("block").alias("b"),
                            F.coalesce(F.sum("block_sum").over(earlier), F.lit(0)).alias("base")), "blocks")
    inside = Window.partitionBy(by, "block").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.join(small(sums), F.col(by).eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    return out.withColumn("before", F.col("base") + F.col("inner")).drop("block", "g", "b", "base", "inner")


def take(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size) rows with source_size, target and taken."""
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    targets = save(source_targets(sources, weights, max_epochs), "targets")
    rows = sized.join(small(targets.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("key", random_key(F.col("doc_id")))
    n_blocks = F.ceil(F.col("n") / block_rows)
    rows = prefix_sums(rows, n_blocks, "key", "size", "source", ["doc_id", "size"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before")))
    return rows.withColumn("epochs", epochs).withColumn("part", part) \
               .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them: each document once for every epoch, and once more if it comes before
    its source's cut; all columns as they were. Texts stay whole: the document on the boundary counts
    if at least half of it is within the budget. Documents without words are in no mix.

    The cut of a source is one row (epochs, key on the boundary), so no text is shuffled."""
    c = {x: fresh(f"mix_{x}", docs.columns) for x in ("source", "epochs", "cut", "size", "times")}
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
                             n_words(F.col(text)).alias("size")), "sized")
    last = F.max(F.when(F.col("part") > 0, F.struct("key", "doc_id", "size", "part")))
    cuts = take(sized, **options).groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("cut"))
    cuts = save(cuts.select(F.col("source").alias(c["source"]), F.col("epochs").alias(c["epochs"]), F.col("cut").alias(c["cut"])), "cuts")
    out = docs.withColumn(c["size"], n_words(F.col(text))).where(F.col(c["size"]) > 0) \
              .join(small(cuts), F.col(source).eqNullSafe(F.col(c["source"])))
    cut = F.col(c["cut"])
    here = F.struct(random_key(F.col(id_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(c["size"]).alias("size"))
    there = F.struct(cut["key"].alias("key"), cut["doc_id"].alias("doc_id"), cut["size"].alias("size"))
    once_more = F.when(cut.isNull(), 0).when(here < there, 1).when(here > there, 0) \
                 .otherwise((2 * cut["part"] >= cut["size"]).cast("int"))
    out = out.withColumn(c["times"], (F.col(c["epochs"]) + once_more).cast("int")).where(F.col(c["times"]) > 0)
    return out.withColumn(c["times"], F.explode(F.sequence(F.lit(1), F.col(c["times"])))).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    return take(sized).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size * (10 // w), source NULLS LAST) AS fill
  FROM s),
g AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rem,
            (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_rem
  FROM f),
e AS (SELECT fill AS f0, rem AS rem0, w_rem AS w0 FROM g WHERE rem * w <= cap * w_rem ORDER BY fill LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN f0 IS NULL OR fill < f0 THEN cap::DOUBLE ELSE (rem0 * w)::DOUBLE / w0::DOUBLE END AS target
  FROM g LEFT JOIN e ON true),
b AS (
  SELECT *, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs
  FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p
"""
