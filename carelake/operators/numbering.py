"""Row numbers and running totals over a whole table, and joins on position, without one task holding it.

Rows are dealt out by ranges of the sort key and sorted inside their task; each task numbers its own rows, and the counts of
the tasks before it go on top. The dealt rows are written (checkpoint) because both steps must see the same ranges; a lost
executor then recomputes nothing that was counted. Only one number per task is gathered, as one array for all. Rows that are
equal in the whole key may be a third of all: the task that read a row is the last part of the key, so they part too.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, PLACE = "_part", "_place"
MONEY = "decimal(38,6)"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``. Only a local session may go without it; then a temporary
    folder is set once."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="carelake-checkpoint-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with PART (in key order) and PLACE (from 0, in key order within the part)."""
    low = 1 << 33  # monotonically_increasing_id: the partition's number in the upper bits, the row's in the lower 33
    keys = [*order, F.col("_reader").asc()]
    out = df.withColumn("_reader", F.spark_partition_id()).repartitionByRange(*keys).sortWithinPartitions(*keys) \
            .drop("_reader").withColumn(PLACE, F.monotonically_increasing_id())
    out = out.withColumn(PART, F.shiftright(PLACE, 33).cast("int")).withColumn(PLACE, F.col(PLACE) % low)
    return checkpointed(out)


def _before(dealt: DataFrame, amount: Column, kind: str) -> Column:
    """Array over the parts: the sum of ``amount`` (of type ``kind``) in all parts before it."""
    zero = F.lit(0).cast(kind)
    per = dealt.groupBy(PART).agg(amount.alias("n"))
    one = per.agg(F.map_from_entries(F.collect_list(F.struct(PART, "n"))).alias("m"), F.max(PART).alias("last"))
    filled = F.transform(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))), lambda p: F.coalesce(F.try_element_at("m", p), zero))
    sums = F.aggregate(filled, F.array(zero), lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n).cast(kind))))
    return one.select(sums).scalar()


def number_rows(df: DataFrame, order: list[Column], name: str = "RN") -> DataFrame:
    """``df`` and its row number from 1 in ``order`` (all of it ascending or descending columns). Rows equal in ``order`` are
    numbered in any order among themselves."""
    dealt = _dealt(df, order)
    before = F.get(_before(dealt, F.count(F.lit(1)), "bigint"), F.col(PART))
    return dealt.withColumn(name, before + F.col(PLACE) + 1).drop(PART, PLACE)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` and the sum of ``value`` over all rows up to it in ``order``, exact to six decimals (null adds 0)."""
    v = F.coalesce(F.col(value).cast(MONEY), F.lit(0).cast(MONEY))
    dealt = _dealt(df, order)
    w = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.get(_before(dealt, F.sum(v).cast(MONEY), MONEY), F.col(PART))
    return dealt.withColumn(name, (before + F.sum(v).over(w)).cast(MONEY)).drop(PART, PLACE)


def bucket_of(rn: Column, every: int, shares: list[tuple[int, str]]) -> Column:
    """The name whose upper bound is the first above ``rn % every``; ``shares`` are (upper bound, name) in order."""
    out = F
    for bound, name in shares[:-1]:
        out = out.when(rn % every < bound, name)
    return out.otherwise(shares[-1][1])


def join_positions(left: DataFrame, rn: str, right: DataFrame, order: list[Column], position: str = "POSITION") -> DataFrame:
    """Row ``rn`` of ``left`` meets row ``(rn - 1) % n + 1`` of ``right`` in ``order``, n rows long; an equi-join. Without
    rows in ``right`` there is no partner (nulls)."""
    numbered = number_rows(right, order, position)
    n = right.agg(F.count(F.lit(1))).scalar()
    at = (F.col(rn) - 1) % F.nullif(n, F.lit(0)) + 1
    return left.withColumn("_at", at).join(numbered, F.col("_at") == F.col(position), "left").drop("_at", position)
