"""L3/L4: key drivers of a 0/1 metric between a control and a test period.

The reference calls a closed "top insights" service; its consumers need
CONTRIBUTOR, METRIC_CONTROL, METRIC_TEST, RELATIVE_CONTRIBUTION and
GROWTH_RATE plus an ``["Overall"]`` row. Our definition (published
decomposition of a rate change):

* segment s = one dimension value or a pair of values of two dimensions;
* n_c, n_t rows and rate_c, rate_t metric means in control / test;
* contribution = n_t/N_t * rate_t - n_c/N_c * rate_c (a side without rows adds 0);
* relative contribution = contribution / |rate_T - rate_C| (overall change);
* growth rate = rate_t / rate_c - 1.

``key_drivers`` emits every single and pair with its counts; readers filter by support. ``segment_drivers`` searches the
lattice of segments level by level, up to three dimensions or more, as follows.

* A level's segments are counted from the cells (rows grouped by all dimensions), never from the rows.
* Only segments with MIN_PCT percent of all rows stay. A cell makes candidates of the next level only from its own frequent
  segments, and only those of which every smaller part is frequent: no row or cell is exploded into all subsets. There are at
  most C(d, k) * 100 / MIN_PCT frequent segments on level k, whatever the data.
* The cells and each level's frequent segments are written (checkpoint), as the next level and the report read them again.
* A segment that keeps COVER percent of the rows of a part of it says nothing new and goes.

Plan of ``key_drivers``: the rows are first counted by all dimensions and the label (map-side
combined; counts add up), then each such group, not each row, is exploded
into its 1 + d + d(d-1)/2 segments, which feed one hash aggregate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.numbering import checkpointed

OVERALL = '["Overall"]'
MIN_PCT = 1
COVER = 98
MEASURES = ["TEST_COUNT", "S_T", "CONTROL_COUNT", "S_C"]


def _seg(i: int, j: int, vi, vj):
    return F.struct(F.lit(i).alias("A"), F.lit(j).alias("B"),
                    vi.cast("string").alias("VA"), vj.cast("string").alias("VB"))


def _sums(metric: str, label: str) -> list:
    lab, m = F.col(label), F.col(metric)
    return [F.sum(F.when(lab, 1).otherwise(0)).alias("TEST_COUNT"), F.sum(F.when(lab, m).otherwise(0)).alias("S_T"),
            F.sum(F.when(~lab, 1).otherwise(0)).alias("CONTROL_COUNT"), F.sum(F.when(~lab, m).otherwise(0)).alias("S_C")]


def key_drivers(df: DataFrame, metric: str, label: str, dims: list[str], digits: int = 6) -> DataFrame:
    none = F.lit(None).cast("string")
    segs = [_seg(-1, -1, none, none)]
    segs += [_seg(i, -1, F.col(d), none) for i, d in enumerate(dims)]
    segs += [_seg(i, j, F.col(dims[i]), F.col(dims[j])) for i, j in itertools.combinations(range(len(dims)), 2)]
    sums, measures = _sums(metric, label), MEASURES
    x = df.groupBy(*dims).agg(*sums).select(F.explode(F.array(*segs)).alias("S"), *measures).select("S.*", *measures)
    agg = x.groupBy("A", "B", "VA", "VB").agg(*[F.sum(c).cast("long").alias(c) for c in measures])
    # Overall totals straight from the input (no explode), as ONE scalar
    # subquery returning a struct: every field reference reuses it.
    ov = df.agg(F.struct(*[c.cast("long").alias(k) for c, k in zip(sums, ("NT", "ST", "NC", "SC"))])).scalar()
    names = F.array(*[F.lit(d) for d in dims])

    def part(idx, val):
        return F.concat(F.lit('"'), F.element_at(names, idx + 1), F.lit(" = "), F.coalesce(val, F.lit("NULL")), F.lit('"'))

    contributor = (F.when(F.col("A") == -1, F.lit(OVERALL))
                    .when(F.col("B") == -1, F.concat(F.lit("["), part(F.col("A"), F.col("VA")), F.lit("]")))
                    .otherwise(F.concat(F.lit("["), part(F.col("A"), F.col("VA")), F.lit(", "),
                                        part(F.col("B"), F.col("VB")), F.lit("]"))))
    return _report(agg, ov, contributor, digits)


def _report(agg: DataFrame, ov, contributor, digits: int) -> DataFrame:
    """Rates, contribution and growth of segments with their MEASURES; ``ov`` is the struct of the totals NT, ST, NC, SC."""
    n_t, n_c, s_t, s_c = (ov.getField(k) for k in ("NT", "NC", "ST", "SC"))
    rate_t = F.when(F.col("TEST_COUNT") > 0, F.col("S_T") / F.col("TEST_COUNT"))
    rate_c = F.when(F.col("CONTROL_COUNT") > 0, F.col("S_C") / F.col("CONTROL_COUNT"))
    change = F.abs(F.when(n_t > 0, s_t / n_t) - F.when(n_c > 0, s_c / n_c))
    contrib = F.when((n_t > 0) & (n_c > 0), F.col("S_T") / n_t - F.col("S_C") / n_c)
    return agg.select(
        contributor.alias("CONTRIBUTOR"),
        F.round(rate_c, digits).alias("METRIC_CONTROL"),
        F.round(rate_t, digits).alias("METRIC_TEST"),
        F.round(contrib, digits).alias("CONTRIBUTION"),
        F.round(F.when(change > 0, contrib / change), digits).alias("RELATIVE_CONTRIBUTION"),
        F.round(F.when(rate_c > 0, rate_t / rate_c - 1), digits).alias("GROWTH_RATE"),
        "CONTROL_COUNT", "TEST_COUNT",
    )


def segment_drivers(df: DataFrame, metric: str, label: str, dims: list[str], max_dims: int = 3, min_pct: int = MIN_PCT,
                    cover: int = COVER, digits: int = 6) -> DataFrame:
    """Frequent segments of up to ``max_dims`` dimensions that are not redundant, and the overall row. Null dimension values
    read NULL."""
    values = F.array(*[F.coalesce(F.col(d).cast("string"), F.lit("NULL")) for d in dims])
    cells = checkpointed(df.groupBy(*dims).agg(*[x.cast("long").alias(m) for x, m in zip(_sums(metric, label), MEASURES)])
                           .select(values.alias("V"), *MEASURES))
    total = cells.agg(*[F.sum(m).alias(m) for m in MEASURES])
    ov = total.select(F.struct(*[F.col(m).alias(k) for m, k in zip(MEASURES, ("NT", "ST", "NC", "SC"))])).scalar()
    least = (ov.getField("NT") + ov.getField("NC")) * min_pct

    rows = F.col("TEST_COUNT") + F.col("CONTROL_COUNT")
    out = [total.select(F.array().cast("array<int>").alias("S"), F.array().cast("array<string>").alias("W"), *MEASURES)]
    # S: the segment's dimensions in order, W: their values, M: the dimensions as bits
    held = cells.select("V", *MEASURES, F.explode(_sets(len(dims), 1)).alias("C"))
    smaller = None
    for k in range(1, min(max_dims, len(dims)) + 1):
        held = held.select("V", *MEASURES, "C.M", "C.S", F.transform("C.S", lambda i: F.element_at("V", i + 1)).alias("W"))
        frequent = checkpointed(held.groupBy("S", "W").agg(*[F.sum(m).alias(m) for m in MEASURES]).where(100 * rows >= least))
        out.append(frequent if k == 1 else _telling(frequent, smaller, cover))
        if k < min(max_dims, len(dims)):
            mine = held.join(frequent.select("S", "W"), ["S", "W"]).groupBy("V", *MEASURES).agg(F.collect_set("M").alias("P"))
            grown = F.filter(_sets(len(dims), k + 1), lambda c: F.forall(c["PARTS"], lambda m: F.array_contains("P", m)))
            held, smaller = mine.select("V", *MEASURES, F.explode(grown).alias("C")), frequent

    segments = out[0]
    for x in out[1:]:
        segments = segments.unionByName(x)
    names = F.array(*[F.lit(d) for d in dims])
    parts = F.zip_with("S", "W", lambda i, v: F.concat(F.lit('"'), F.element_at(names, i + 1), F.lit(" = "), v, F.lit('"')))
    contributor = F.when(F.size("S") == 0, F.lit(OVERALL)).otherwise(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")))
    return _report(segments, ov, contributor, digits)


def _sets(d: int, k: int):
    """All sets of k of d dimensions: M as bits, S in order, PARTS the bits of the sets that lack one of them."""
    def struct(c: tuple) -> str:
        bits = sum(1 << i for i in c)
        parts = ", ".join(f"{bits - (1 << i)}L" for i in c)
        return f"named_struct('M', {bits}L, 'S', array({', '.join(map(str, c))}), 'PARTS', array({parts}))"
    return F.expr(f"array({', '.join(struct(c) for c in itertools.combinations(range(d), k))})")


def _telling(frequent: DataFrame, smaller: DataFrame, cover: int) -> DataFrame:
    """Segments with fewer than ``cover`` percent of the rows of each segment that lacks one of their dimensions."""
    rows = F.col("TEST_COUNT") + F.col("CONTROL_COUNT")
    parts = frequent.select("S", "W", rows.alias("N"), F.posexplode("S").alias("AT", "DIM")) \
        .select("S", "W", "N", F.filter("S", lambda d, i: i != F.col("AT")).alias("PS"), F.filter("W", lambda v, i: i != F.col("AT")).alias("PW"))
    of = smaller.select(F.col("S").alias("PS"), F.col("W").alias("PW"), rows.alias("PN"))
    repeats = parts.join(of, ["PS", "PW"]).where(100 * F.col("N") >= cover * F.col("PN")).select("S", "W")
    return frequent.join(repeats, ["S", "W"], "left_anti")
