"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. A sequence of capacity c costs c + c * c / ATTENTION +
OVERHEAD: work per position, work per pair of positions, and work per sequence. So long sequences
share the overhead among more tokens and short ones save attention. Pieces are placed longest first:

* into the open bin with the least room that still holds the piece (best fit), or else
* into a new bin of the permitted length that costs least per token it will hold. What it will hold
  is looked up among the pieces still unplaced (the longest that fits its room, again and again),
  less what the open bins have room for.

A shard is packed once for each permitted length as the longest that may be opened for shorter
pieces, and the cheapest of these packings counts (ties: the one of the lesser length). At the end
each bin is downsized to the least permitted length that holds its contents.

Documents longer than the longest length are cut into pieces of that length (no token is lost).
Rows are dealt out evenly into shards of about SHARD_PIECES narrow rows (id, length), which are packed
one per task; a repeated id or a tie is no hot spot, and Spark makes the deal repeatable when a task
is run again. No text goes through Python.

A document's length is its number of words plus one end token; so null, empty and blank texts are
pieces of one token. Null and repeated ids are packed like others, and pieces of equal length by id
and piece. An empty table gives no bins. Only the id and text columns are read, so other columns
can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import n_words, save, ship, table

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 128
ATTENTION = 16_384  # the length at which attention costs as much as all else
SHARD_PIECES = 100_000

SCHEMA = ("doc_id long, piece int, start_token long, n_tokens int, shard int, bin int, bin_offset int, "
          "capacity int, bin_used int")


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """Work of one sequence."""
    return capacity + capacity * capacity / attention + overhead


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD,
         attention: int = ATTENTION) -> tuple[list, list, list, list]:
    """(bin, offset) of each piece; (used, capacity) of each bin. ``sizes``: each at most max(lengths)."""
    lengths = tuple(sorted(lengths))
    prices = {c: cost(c, overhead, attention) for c in lengths}
    packings = (_pack(sizes, lengths, prices, longest) for longest in lengths)
    return min(packings, key=lambda p: sum(prices[c] for c in p[3]))


def _pack(sizes: list[int], lengths: tuple[int, ...], prices: dict[int, float], longest: int) -> tuple[list, list, list, list]:
    """One packing that opens bins above ``longest`` only for pieces above it."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    by_room: dict[int, list[int]] = {}  # room left -> open bins with it
    rooms: list[int] = []               # its keys, sorted
    values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
    waiting = values.tolist()           # sizes of the unplaced pieces, sorted; the longest go first, so it shrinks at its end
    copies = dict(zip(waiting, counts.tolist()))
    shortest = waiting[0] if waiting else 0
    left, open_room = int(np.sum(sizes)) if len(sizes) else 0, 0

    def filling(room: int) -> int:
        """Tokens of unplaced pieces that fit into ``room``, longest first."""
        whole, at = room, len(waiting)
        while at := bisect_right(waiting, room, 0, at):
            at -= 1
            room -= min(copies[waiting[at]], room // waiting[at]) * waiting[at]
        return whole - room

    for i in order.tolist():
        s = sizes[i]
        copies[s] -= 1
        if not copies[s]:
            waiting.pop()
        left -= s
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            open_room -= room
        else:
            spare = max(left - open_room, 0)
            room = min((c for n, c in enumerate(lengths) if c >= s and (c <= longest or not n or lengths[n - 1] < s)),
                       key=lambda c: (prices[c] / (s + min(filling(c - s), spare)), c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        room -= s
        if room >= shortest:
            open_room += room
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, used, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, length: Column, id_col: str, longest: int) -> DataFrame:
    """doc_id, piece, start_token, n_tokens: each document in pieces of at most ``longest`` tokens."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("length"))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / longest) - 1).cast("int"))))
    start = F.col("piece").cast("long") * longest
    return d.select("doc_id", "piece", start.alias("start_token"),
                    F.least(F.lit(longest).cast("long"), F.col("length") - start).cast("int").alias("n_tokens"))


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lengths=LENGTHS,
                   overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES, length: Column | None = None,
                   attention: int = ATTENTION) -> DataFrame:
    """One row per piece (SCHEMA): where it starts in its document and in which bin of which shard it
    lies; (shard, bin) names a sequence of ``capacity`` tokens of which ``bin_used`` are filled."""
    ship(docs.sparkSession)
    length = n_words(F.col(text)) + 1 if length is None else length
    rows = save(pieces(docs, length, id_col, max(lengths)), "pieces")
    shards = -(-rows.count() // shard_pieces) or 1
    dealt = rows.repartition(shards).withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        bins, offsets, used, caps = pack(t["n_tokens"].to_pylist(), tuple(lengths), overhead, attention)
        at = np.asarray(bins)
        t = (t.append_column("bin", pa.array(bins, pa.int32())).append_column("bin_offset", pa.array(offsets, pa.int32()))
              .append_column("capacity", pa.array(np.asarray(caps)[at], pa.int32()))
              .append_column("bin_used", pa.array(np.asarray(used)[at], pa.int32())))
        yield from t.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, SCHEMA)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
