"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt out by ranges of doc_id (equal ids by text hash, so a repeated id is no hot spot),
sorted, encoded and written by the same task. A shard (partition) is a run of chunks; a chunk holds
whole documents, about CHUNK_TOKENS ids, and is one row of a Parquet file, so files are committed by
Spark: a lost executor leaves no half file, on any store that Spark can write.

Chunk: ``payload`` (the blocks), ``block_starts`` (byte offset of each block), ``doc_ids`` and
``doc_tokens`` (the documents and their numbers of ids), ``first_token`` (ids before it in its shard).

Block of up to BLOCK ids, little endian:

    uint32 minimum | uint16 count - 1 | uint8 width | uint8 0 | uint16 exceptions | uint16 0
    packed deltas  ceil(count / 64) * width words of 64 bits; delta k of a group of 64 at bit k * width
    uint16 place and then uint32 delta of each exception

Deltas are ids less the block's minimum; width is the number of bits of the PERCENTILE-th delta, and
deltas that need more bits are exceptions. A block is found from ``block_starts`` and decoded alone.

Null and empty texts are the end id alone. Null ids come first. Equal ids stand by text hash; rows
repeated whole are written as often. Empty tables give no chunks. Long texts are encoded whole.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import arrow_batches, saved_dir, small, table

BLOCK = 4096
PERCENTILE = 0.9
CHUNK_TOKENS = 1 << 20
ENCODE_BYTES = 8 << 20   # texts prepared at a time
ENCODE_ROWS = 8192       # words or texts that the tokenizer gets at a time,
ENCODE_CHARS = 1 << 19   # or as many as have so many letters: it takes some hundred bytes for each token
MEMO_BYTES = 64 << 20    # words and ids that a worker remembers, besides those of the texts at hand
END_ID = 0

CHUNK = ("shard int, chunk int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
         "block_starts array<int>, payload binary")
HEAD = np.dtype([("low", "<u4"), ("count", "<u2"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2"), ("zero2", "<u2")])


# --- blocks ---------------------------------------------------------------------------------------

def _pack(deltas: np.ndarray, width: int) -> np.ndarray:
    """(m, 64 g) values under 2^width -> (m, g * width) words."""
    v = np.ascontiguousarray(deltas.reshape(-1, 64).T)
    out = np.zeros((max(width, 1), v.shape[1]), np.uint64)
    for k in range(64 if width else 0):
        i, s = divmod(k * width, 64)
        out[i] |= v[k] << np.uint64(s)
        if s + width > 64:
            out[i + 1] |= v[k] >> np.uint64(64 - s)
    return np.ascontiguousarray(out[:width].T).reshape(len(deltas), -1)


def _unpack(words: np.ndarray, width: int, groups: int) -> np.ndarray:
    """(m, groups * width) words -> (m, 64 * groups) values."""
    w = np.ascontiguousarray(words.reshape(-1, width).T) if width else None
    out = np.zeros((64, len(words) * groups), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64 if width else 0):
        i, s = divmod(k * width, 64)
        x = w[i] >> np.uint64(s)
        if s + width > 64:
            x |= w[i + 1] << np.uint64(64 - s)
        out[k] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), -1)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Payload and block starts of a sequence of ids (uint32)."""
    out: list[bytes] = []
    starts: list[int] = []
    at = 0
    full = len(ids) // BLOCK * BLOCK
    for part in (ids[:full].reshape(-1, BLOCK), ids[full:].reshape(1, -1) if full < len(ids) else None):
        if part is None or not part.size:
            continue
        m, n = part.shape
        low = part.min(axis=1)
        deltas = np.zeros((m, -(-n // 64) * 64), np.uint64)
        deltas[:, :n] = part - low[:, None]
        at_percentile = np.partition(deltas[:, :n], min(n - 1, int(PERCENTILE * n)), axis=1)[:, min(n - 1, int(PERCENTILE * n))]
        widths = np.frexp(at_percentile.astype(np.float64))[1]  # bits needed: exact below 2^53
        blocks: list[bytes] = [b""] * m
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            d = deltas[rows]
            over = d >> np.uint64(width) > 0
            words = _pack(d & np.uint64((1 << width) - 1), width).astype("<u8", copy=False)
            for j, r in enumerate(rows.tolist()):
                places = np.flatnonzero(over[j])
                head = np.zeros(1, HEAD)
                head[0] = (low[r], n - 1, width, 0, len(places), 0)
                blocks[r] = b"".join((head.tobytes(), words[j].tobytes(), places.astype("<u2").tobytes(),
                                      d[j, places].astype("<u4").tobytes()))
        for b in blocks:
            starts.append(at)
            at += len(b)
            out.append(b)
    return b"".join(out), starts


def decode_blocks(payload: bytes, starts: list[int]) -> np.ndarray:
    """The ids (uint32) of the blocks that start at ``starts``, in order."""
    heads = [np.frombuffer(payload, HEAD, 1, s)[0] for s in starts]
    out: list = [None] * len(starts)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        kinds.setdefault((int(h["width"]), int(h["count"]) + 1), []).append(i)
    for (width, n), which in kinds.items():
        g = -(-n // 64)
        words = np.array([np.frombuffer(payload, "<u8", g * width, starts[i] + HEAD.itemsize) for i in which], np.uint64)
        values = _unpack(words.reshape(len(which), g * width), width, g)[:, :n]
        for j, i in enumerate(which):
            at, e = starts[i] + HEAD.itemsize + 8 * g * width, int(heads[i]["exceptions"])
            v = values[j]
            if e:
                v[np.frombuffer(payload, "<u2", e, at)] = np.frombuffer(payload, "<u4", e, at + 2 * e)
            out[i] = (v + np.uint64(heads[i]["low"])).astype(np.uint32)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


# --- encoding -------------------------------------------------------------------------------------

# Byte-level BPE never merges across the places where its pattern parts a text, and it always parts before
# a single space or line feed between words. So a text of plain spacing is the sum of its words, each of
# which the tokenizer encodes once. Texts with any of these go to the tokenizer whole.
FIRST = "\x01"
SPACING = (FIRST, "  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
WIDE_SPACING = ("\x85", "\xa0", "\u1680", "\u180e", *map(chr, range(0x2000, 0x200c)), "\u2028", "\u2029", "\u202f",
                "\u205f", "\u2060", "\u3000", "\ufeff")


class Encoder:
    """Texts to ids by a tokenizers file; remembers the ids of words, in arrays: word, place, size."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = self.tokenizer.pre_tokenizer
        self.by_word = type(spec).__name__ == "ByteLevel" and not spec.add_prefix_space and self.tokenizer.normalizer is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.start, self.size = np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32)

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        while len(out) < len(texts):
            at = len(out)
            full = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENCODE_CHARS, side="right"))
            part = texts[at:min(max(full, at + 1), at + ENCODE_ROWS)]
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _plain(self, text: str) -> bool:
        return not (any(x in text for x in SPACING) or not text.isascii() and any(x in text for x in WIDE_SPACING)
                    or any(x in text for x in self.special))

    def _learn(self, words: pa.Array) -> None:
        """Adds words to the memo."""
        known = self._ids([w[1:] if w[:1] == FIRST else w if w[:1] == "\n" else " " + w for w in words.to_pylist()])
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        self.start = np.concatenate((self.start, np.cumsum(size, dtype=np.int32) - size + len(self.ids)))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(known), "<u4")))
        self.words = pa.concat_arrays([self.words, words])

    def _plain_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of plain spacing: "a b\\nc" is "a", " b", "\\nc". In the memo FIRST marks a text's
        first word, and words after a space stand without it."""
        parts = pc.split_pattern(pc.replace_substring(pa.array([FIRST + x for x in texts], pa.large_string()), "\n", " \n"), " ")
        ends = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        if self.words.nbytes + self.ids.nbytes + self.start.nbytes + self.size.nbytes > MEMO_BYTES:
            self._forget()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        if at.null_count:
            new = coded.dictionary.filter(at.is_null())
            first_new = len(self.words)
            self._learn(new)
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = np.arange(first_new, len(self.words))
        code = np.asarray(at, np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        # the words' ids stand in one array; every place takes its word's stretch of it
        n = self.size[code]
        until = np.cumsum(n, dtype=np.int32)  # a batch is a few million ids
        out = self.ids[np.repeat(self.start[code] - until + n, n) + np.arange(until[-1], dtype=np.int32)]
        return np.split(out, until[ends[1:-1] - 1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        plain = [i for i, x in enumerate(texts) if self.by_word and self._plain(x)]
        whole = sorted(set(range(len(texts))).difference(plain))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = np.frombuffer(ids, "<u4")
        for i, ids in zip(plain, self._plain_texts([texts[i] for i in plain]) if plain else ()):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One per worker process, kept from task to task."""
    if tokenizer_json not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer_json] = Encoder(tokenizer_json)
    return _ENCODERS[tokenizer_json]


def _chunks(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
    """Chunks of one shard, from its rows (shard, doc_id, text) in order."""
    end = np.array([END_ID], "<u4")
    held: list[tuple[int | None, np.ndarray]] = []
    size = before = chunk = 0
    shard = None

    def close() -> pa.RecordBatch:
        payload, starts = encode_blocks(np.concatenate([x for _, x in held]))
        row = {"shard": shard, "chunk": chunk, "first_token": before, "n_tokens": size, "doc_ids": [d for d, _ in held],
               "doc_tokens": [len(x) for _, x in held], "block_starts": starts, "payload": payload}
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def texts() -> Iterator[tuple[list, list]]:
        ids, parts, n = [], [], 0
        for b in batches:
            nonlocal shard
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
            ids += b.column("doc_id").to_pylist()
            parts += [x or "" for x in b.column("text").to_pylist()]
            n += b.nbytes
            if n >= ENCODE_BYTES:
                yield ids, parts
                ids, parts, n = [], [], 0
        yield ids, parts

    for ids, parts in texts():
        for doc_id, x in zip(ids, encode(parts) if parts else []):
            held.append((doc_id, np.concatenate((x, end))))
            size += len(x) + 1
            if size >= CHUNK_TOKENS:
                yield close()
                held, before, size, chunk = [], before + size, 0, chunk + 1
    if held:
        yield close()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", id_col: str = "doc_id") -> None:
    """Encodes ``docs`` and writes their chunks to ``path`` in the order of id."""
    arrow_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:  # read on the driver: workers get its content
        spec = f.read()
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    d = d.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    d.mapInArrow(lambda batches: _chunks(batches, _encoder(spec).encode), CHUNK).write.parquet(path)


def read_documents(chunks: DataFrame) -> DataFrame:
    """From the chunks of a folder: doc_id, start, n_tokens, ids_crc32 of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = decode_blocks(row["payload"], row["block_starts"]).astype("<u4", copy=False)
                n = np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - n + row["first_token"]), pa.array(n), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    docs = chunks.mapInArrow(run, "shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # shards are few (one per task of the writer), so their prefix sums are a small window
    totals = chunks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return docs.join(small(base), "shard").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = f"{saved_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    arrow_batches(spark, 8)  # rows are chunks of megabytes here
    return read_documents(spark.read.schema(CHUNK).parquet(path))
