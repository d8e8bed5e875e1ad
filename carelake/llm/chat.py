"""Chat logs: collapse cumulative snapshots, then render (DataFrame and SQL functions only).

A logger that writes a conversation after every reply leaves one row group per snapshot, each a prefix
of the next. Every turn gets a rolling hash of its conversation up to and with it (the xor, over turns,
of two 64-bit hashes of place, role and text: order counts, and the sum can be made in parts). A
conversation goes if the hash of all its turns is the hash of a prefix of a longer one, found by an
anti-join; of conversations alike in all turns the least conv_id stays. The maximal ones are rendered.

A turn's place is its rank by (turn, role, text). Ranks and hashes are made per block of BLOCK turn
numbers and the blocks' sums added, so a conv_id with very many rows is dealt over tasks; copies of a
conversation, however many, are combined before they are compared. A rendered conversation is one value;
only that last step gathers a conversation's rows, and only of those that stay.

Null roles render as ``user``, null texts as empty; to the hash null and '' are different. Null conv_ids
are one conversation, null turns come first. Rows repeated whole are turns like others. Control tokens
inside texts lose their leading ``<|`` to ``< |``, so a text can't forge a turn. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import save, small, table

BLOCK = 4096
SEEDS = (17, 42)


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with ``place`` (from 1) and ``h0``, ``h1``: the hash of the turns so far."""
    t = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("inner", F.row_number().over(inside))
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    later = save(sizes.where("before > 0"), "chat-places")  # blocks but the first: none where conversations are short
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    t = t.join(small(later), same, "left").withColumn("place", F.col("inner") + F.coalesce("before", F.lit(0)))
    t = t.drop("c", "b", "before")
    # null and '' differ: xxhash64 skips nulls, so whether each is null is hashed too
    one = [F.xxhash64(F.lit(s), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for s in SEEDS]
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({f"x{i}": x for i, x in enumerate(one)})
    t = t.withColumns({f"h{i}": F.bit_xor(f"x{i}").over(so_far) for i in (0, 1)})
    ends = t.groupBy("conv_id", "block").agg(F.bit_xor("x0").alias("e0"), F.bit_xor("x1").alias("e1"))
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                       *[F.bit_xor(f"e{i}").over(earlier).alias(f"p{i}") for i in (0, 1)],
                       F.row_number().over(Window.partitionBy("conv_id").orderBy("block")).alias("nth"))
    ends = save(ends.where("nth > 1").drop("nth"), "chat-hashes")
    t = t.join(small(ends), same, "left")
    for i in (0, 1):
        t = t.withColumn(f"h{i}", F.col(f"h{i}").bitwiseXOR(F.coalesce(f"p{i}", F.lit(0).cast("long"))))
    return t.select("conv_id", "turn", "role", "text", "place", "h0", "h1")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved turns with their prefixes, and a row per conversation: conv_id, n_turns, kept, copies
    (conversations alike in all turns), first_id (the least conv_id of those)."""
    t = save(turn_prefixes(turns.select("conv_id", "turn", "role", "text")), "chat-prefixes")
    lengths = t.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("n_turns"))
    whole = t.select("conv_id", "place", "h0", "h1").join(lengths.withColumnRenamed("conv_id", "c"), same) \
             .select("conv_id", "n_turns", "h0", "h1")
    whole = save(whole, "chat-whole")
    alike = whole.groupBy("n_turns", "h0", "h1").agg(
        F.min_by("conv_id", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # prefixes that end before their conversation does
    open_ends = t.select("conv_id", "place", "h0", "h1").join(
        lengths.withColumnRenamed("conv_id", "c"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") < F.col("n_turns"))) \
        .select(F.col("place").alias("n_turns"), "h0", "h1").distinct()
    maximal = save(alike.join(open_ends, ["n_turns", "h0", "h1"], "left_anti").select("n_turns", "h0", "h1"), "chat-maximal")
    groups = alike.join(maximal.withColumn("maximal", F.lit(True)), ["n_turns", "h0", "h1"], "left")
    out = whole.join(groups, ["n_turns", "h0", "h1"])
    kept = F.coalesce("maximal", F.lit(False)) & F.col("conv_id").eqNullSafe(F.col("first_id"))
    return t, save(out.select("conv_id", "n_turns", kept.alias("kept"), "copies", "first_id"), "chat-verdicts")


def rendered_turn(role: Column, text: Column) -> Column:
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    name = F.replace(F.coalesce(role, F.lit("user")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, rendered: one row per conversation of ``turns`` (with ``place``), turns in order."""
    parts = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "place", rendered_turn(F.col("role"), F.col("text")).alias("part")))).alias("parts"))
    return parts.select("conv_id", F.concat_ws("", F.col("parts.part")).alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, kept, copies, first_id, rendered (null unless kept)."""
    t, verdicts = collapse(turns)
    stay = verdicts.where("kept").select(F.col("conv_id").alias("c"))
    texts = render(t.join(stay, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))
    texts = texts.select(F.col("conv_id").alias("c"), "rendered")
    return verdicts.join(texts, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


# The same by whole strings: every prefix written out, no hashes.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS place, role, text,
         coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') AS piece,
         '<|im_start|>' || replace(coalesce(role, 'user'), '<|', '< |') || chr(10)
           || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS part
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT conv_id, place, string_agg(piece, '' ORDER BY place)
           OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
         max(place) OVER (PARTITION BY conv_id) AS n_turns
  FROM t),
w AS (SELECT conv_id, n_turns, prefix FROM p WHERE place = n_turns),
o AS (SELECT DISTINCT prefix FROM p WHERE place < n_turns),
g AS (SELECT prefix, min(conv_id) AS first_id, count(*) AS copies FROM w GROUP BY prefix),
r AS (SELECT conv_id, string_agg(part, '' ORDER BY place) AS rendered FROM t GROUP BY conv_id)
SELECT w.conv_id, w.n_turns, w.conv_id IS NOT DISTINCT FROM g.first_id AND o.prefix IS NULL AS kept, g.copies, g.first_id,
       CASE WHEN w.conv_id IS NOT DISTINCT FROM g.first_id AND o.prefix IS NULL THEN r.rendered END AS rendered
FROM w JOIN g USING (prefix) LEFT JOIN o USING (prefix) JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id
"""
