"""Host-level quality rules.

Every text is measured once; the measures fail or pass a few rules. Failures are added up by host
(map-side, so a host with a third of all rows is no hot spot), each host's failure rate is shrunk
towards the rate of all hosts by an empirical beta prior (moments of the hosts' rates), and the
verdict on the host comes back to its documents. A host is rejected if its rate is above the prior's
mean with a posterior probability of CERTAIN; so the verdict is on hosts as they are in this corpus, and
a host with few documents needs a far worse share than one with many:

* ``base_failed``: fewer than MIN_WORDS words, or over half of the words in repeated 3-word windows.
  Such documents go wherever they come from.
* gross rules: GROSS times as many symbols or repeated lines as a soft rule allows, or a mean word length as far off.
  Such documents go wherever they come from, too.
* soft rules: many symbols, many repeated lines, odd mean word length. They alone remove no document; on a
  rejected host a document that fails one goes. Documents that fail no rule always stay.

Null texts have no words; so have empty and blank ones: all measures are 0 and they fail the base
rule. Null hosts are one host. Equal rows are measured alike. An empty table gives an empty result
(no host, prior of mean 0). Long texts are measured whole; batches hold few rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import ASCII_SPACE, arrow_batches, fresh, save, small, table

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES_PER_100_WORDS = 5.0
MEAN_WORD_CHARS = (2.0, 15.0)
GROSS = 20.0
GROSS_WORD_CHARS = (1.2, 60.0)
CERTAIN = 0.8

SYMBOLS = "#*$%&|<>"

MEASURES = T.StructType([T.StructField(c, T.LongType(), False) for c in
                         ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window occurring twice or more in ``words``."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    first = np.fromiter((seen.setdefault(w, i) for i, w in enumerate(windows)), np.int64, len(windows))
    twice = (np.bincount(first, minlength=len(windows)) > 1)[first]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(windows)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() parts at exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (len(words), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    rows = [measure(x) for x in texts.to_pylist()]
    cols = list(zip(*rows)) or [()] * len(MEASURES.names)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], MEASURES.names)


def base_rule(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


def soft_rule(m: Column, times: float = 1.0, word_chars: tuple[float, float] = MEAN_WORD_CHARS) -> Column:
    """Any soft rule failed; the rules are ratios to n_words, in products so that 0 words need no guard."""
    n = m["n_words"]
    return ((m["n_symbols"] > times * MAX_SYMBOLS_PER_WORD * n) | (100 * m["n_dup_lines"] > times * MAX_DUP_LINES_PER_100_WORDS * n)
            | (m["word_chars"] < word_chars[0] * n) | (m["word_chars"] > word_chars[1] * n))


def gross_rule(m: Column) -> Column:
    return soft_rule(m, GROSS, GROSS_WORD_CHARS)


def beta_below(x: float, a: float, b: float) -> float:
    """P(Beta(a, b) <= x), by the continued fraction of the incomplete beta function (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on this side of the mean
        return 1 - beta_below(1 - x, b, a)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out, k = d, 0
    while True:
        k += 1
        for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log) * out / a


@F.arrow_udf(T.DoubleType())
def worse(failed: pa.Array, n: pa.Array, mu: pa.Array, strength: pa.Array) -> pa.Array:
    """Probability that a host's rate is above ``mu`` after ``failed`` of ``n``, from a prior of that mean and strength."""
    return pa.array([1 - beta_below(m, f + m * k, c - f + (1 - m) * k) for f, c, m, k in
                     zip(*(x.to_pylist() for x in (failed, n, mu, strength)))], pa.float64())


def host_verdicts(measured: DataFrame, host: str, m: str) -> DataFrame:
    """host, n, failed, rate (shrunk), worse (probability), rejected: one row per host of a table with measures ``m``. If all
    documents or none fail, no host is worse than the others."""
    failed = base_rule(F.col(m)) | soft_rule(F.col(m))
    hosts = save(measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed")), "hosts")
    # Beta(a, b) by moments of the hosts' rates: mean mu, variance v, strength a + b = mu (1 - mu) / v - 1.
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.coalesce(F.sum("failed") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("mu"),
                      F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v")).first()
    mu, v = prior["mu"], prior["v"]
    strength = max(mu * (1 - mu) / v - 1, 1.0) if v > 0 else 100.0
    shrunk = (F.col("failed") + mu * strength) / (F.col("n") + strength)
    p = worse(F.col("failed"), F.col("n"), F.lit(mu), F.lit(strength)) if 0 < mu < 1 else F.lit(0.0)
    return hosts.withColumn("rate", shrunk).withColumn("worse", p).withColumn("rejected", F.col("worse") >= CERTAIN)


def judge(measured: DataFrame, m: str, host: str = "source") -> DataFrame:
    """A saved table with measures ``m``, and three more columns (named clear of its own): base_failed,
    host_rate, kept."""
    base, rate, kept, h = (fresh(c, measured.columns) for c in ("base_failed", "host_rate", "kept", "verdict_host"))
    verdicts = save(host_verdicts(measured, host, m), "verdicts")
    side = small(verdicts.select(F.col("host").alias(h), F.col("rate").alias(rate), F.col("rejected").alias(kept)))
    out = measured.join(side, F.col(host).eqNullSafe(F.col(h)), "left").drop(h)
    base_failed = base_rule(F.col(m))
    return out.withColumn(base, base_failed).withColumn(
        kept, ~base_failed & ~gross_rule(F.col(m)) & ~(F.coalesce(F.col(kept), F.lit(False)) & soft_rule(F.col(m))))


def filter_quality(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns as they were."""
    arrow_batches(docs.sparkSession)
    m = fresh("measures", docs.columns)
    measured = save(docs.withColumn(m, measures(F.col(text))), "measured")
    return judge(measured, m, host).where(F.col(fresh("kept", measured.columns))).select(*docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    docs = table(spark, sf_dir, "documents")
    measured = save(docs.select("doc_id", "source", measures("text").alias("measures")), "measured")
    return judge(measured, "measures").select("doc_id", "measures.*", "base_failed", "kept", "host_rate")
