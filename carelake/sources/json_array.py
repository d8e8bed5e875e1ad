"""S3: a file that is one JSON array of objects, read in splits, so one file feeds many tasks.

The text source cuts the file at every ``}`` and deals byte ranges out to tasks. Where a record ends depends on all text
before: is this brace inside a string, and how deep? Both are prefix sums. A range is summed up for both cases (it begins
inside a string or not), the sums of the ranges are added up per file, one narrow row per range, and each piece gets its range's
start on top. The pieces up to a brace at depth 0 are one record, whatever ranges they lie in, and are joined again. No task
holds more than a range of the file or one record.

Result: a row per element, as the ``multiLine`` reader gives, in no fixed order; an empty array or file gives none. A record
that doesn't fit the schema has nulls. A file that ends inside a record is an error. The pieces are written once (checkpoint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators.numbering import checkpointed


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _depth(bare: Column, inside: Column, quotes: Column) -> Column:
    """What a piece adds to the depth, its brace at the end included, if it begins ``inside`` a string (0 or 1)."""
    whole = F.when(inside == 1, F.concat(F.lit('"'), bare)).otherwise(bare)
    outside = F.regexp_replace(whole, r'"[^"]*("|\z)', "")
    return _count(outside, "{") - (1 - (inside + quotes) % 2)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the byte range), at (place in it), piece, quotes (0/1, odd number of them), inside (0/1, if the
    range begins outside strings), depth0 and depth1 (added to the depth if the range begins outside, inside)."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # an escape never spans pieces: \} is none
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = lines.withColumn("bare", bare).withColumn("quotes", _count(F.col("bare"), '"') % 2)
    out = out.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    return out.withColumn("depth0", _depth(F.col("bare"), F.col("inside"), F.col("quotes"))) \
              .withColumn("depth1", _depth(F.col("bare"), 1 - F.col("inside"), F.col("quotes"))).drop("bare")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    cut = checkpointed(pieces(spark, path))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("quotes", "depth0", "depth1")])
    starts = starts.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = starts.withColumn("base", F.coalesce(F.sum(F.when(F.col("start") == 1, F.col("depth1")).otherwise(F.col("depth0"))).over(earlier), F.lit(0)))
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("start") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    placed = cut.join(starts.select("file", "block", "start", "base"), ["file", "block"]) \
                .withColumn("depth", F.col("base") + F.sum(step).over(upto))
    structural = (F.col("start") + F.col("inside") + F.col("quotes")) % 2 == 0
    placed = placed.withColumn("end", F.when(structural & (F.col("depth") == 0), F.col("at")))

    # a record is named by its last piece: the next one in this range, else the first in a later one
    onward = Window.partitionBy("file", "block").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    firsts = placed.groupBy("file", "block").agg(F.min("end").alias("end"))
    firsts = firsts.select("file", "block", F.first("end", ignorenulls=True).over(later).alias("next"))
    named = placed.withColumn("record", F.min("end").over(onward)).join(firsts, ["file", "block"])
    record = F.coalesce("record", "next")
    rest = F.col("piece").rlike(r"^\s*\[?\s*\]?\s*$")  # behind the last record, or an empty array
    record = F.when(record.isNull() & ~rest, F.raise_error(F.concat(F.lit("JSON array ends inside a record: "), F.col("file")))
                    .cast("long")).otherwise(record)
    records = named.select("file", record.alias("record"), "block", "at", "piece").where(F.col("record").isNotNull()) \
                   .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "piece"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["piece"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[\s,\[\x{FEFF}]+", "")
    return records.select(F.from_json(text, schema).alias("r")).select("r.*")
