"""Token ids as compressed binary shards with a shared zstandard dictionary.

A shard is one row of a Parquet table, so any store Spark writes to will do and a task that is run
again replaces its own output only. Its columns are the file format:

    part, shard    place of the shard; shards in this order hold the documents in ascending doc_id order
    width          bytes of one id, little-endian: 2 or 4
    dict_sha256    hash of the zstandard dictionary the frames need ("" without one)
    doc_ids        ids of the documents, ascending, nulls first
    counts         token ids of each document, with the end id
    offsets        where each document's frame begins in ``frames``; one more for the end
    frames         one zstandard frame for each document, one after another

A single document is read by its offset and its own frame only. The dictionary lies beside the
shards as a one-row table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regimecast.llm.common import col, tool
from regimecast.session import scratch_path

END_ID = 2
#: A shard is closed when its frames reach this size.
SHARD_BYTES = 4 << 20
PIECE_BYTES = 2 << 20  # of text whose units are looked up together
#: The dictionary is trained on about so many documents of at most so many bytes each, picked by a
#: hash of doc_id; every document is compressed with it.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, DICT_BYTES = 400, 32 << 10, 64 << 10
SHARDS = (
    "part int, shard int, width int, dict_sha256 string, doc_ids array<bigint>, counts array<bigint>, "
    "offsets array<bigint>, frames binary"
)

#: Fragments that a worker keeps, and the longest one kept.
_CACHE_FRAGMENTS, _CACHE_CHARS = 600_000, 64


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


# Bytes of UTF-8. No character of two bytes that begins with C3 to DF is white space; of those with C3 all but two are letters.
_ASCII_LETTER = _bytes((65, 90), (97, 122))
_SIGN = _bytes((33, 47), (58, 64), (91, 96), (123, 126))
_VISIBLE = _bytes((33, 126))
_TWO = _bytes((0xC3, 0xDF))
_OPENS_VISIBLE = _bytes((33, 126), (0xC3, 0xE0), (0xE4, 0xF4))
_AFTER_C3 = _bytes((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))


def _cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which the byte-level pattern certainly ends a piece, told by their neighbours.

    These are a single space before something visible, a single end of a line and what follows it, and a
    sign after a letter. Where a neighbour may be white space or no letter there is no cut.
    """
    closes = _VISIBLE[data]
    closes[1:] |= _TWO[data[:-1]]
    alone = (data == 32) | (data == 10)
    alone[1:] &= closes[:-1]
    alone[:-1] &= _OPENS_VISIBLE[data[1:]]
    letter = _ASCII_LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    cut = alone.copy()
    cut[1:] |= (alone[:-1] & (data[:-1] == 10)) | (letter[:-1] & _SIGN[data[1:]])
    return cut


class CachedEncoder:
    """A byte-level tokenizer whose fragments are looked up before they are encoded.

    Merges never cross the pieces of the tokenizer's own split pattern. Texts are cut where a piece
    certainly ends, every distinct fragment is encoded once by the library, and its ids are kept.
    Texts with a special token's string go to the library whole.
    """

    def __init__(self, vocabulary: str, width: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.width = width or (2 if size <= 1 << 16 else 4)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        self.whole = not self._standard(vocabulary)  # the cuts need the byte-level pattern
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = np.array([n.startswith("\u0120") for n in names])  # the byte alphabet's space
        self.held: dict[str, bytes] = {}

    @staticmethod
    def _standard(vocabulary: str) -> bool:
        import json

        parts = json.loads(vocabulary)
        split = parts.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        return bool(plain) and parts.get("normalizer") is None

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Latin letters after a space, in one call: every piece begins with a token that begins with the space."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.int64)
        packed, size = ids.astype(f"<u{self.width}").tobytes(), self.width
        at = (np.flatnonzero(self.opens[ids]) * size).tolist()
        at.append(len(packed))
        return {w: packed[a:b] for w, a, b in zip(words, at, at[1:])}

    def _lookup(self, fragments: list[str]) -> list[bytes]:
        """Ids of distinct fragments; short ones are kept."""
        found = list(map(self.held.get, fragments))
        lacking = [f for f, ids in zip(fragments, found) if ids is None]
        if not lacking:
            return found
        words, rest = [], []
        for f in lacking:
            word = f[0] == " " and f[1:].isalpha() and (f.isascii() or max(f) < "\u0250")
            (words if word else rest).append(f)
        new = self._words(words) if words else {}
        new.update(zip(rest, self._encode(rest)))
        if len(self.held) > _CACHE_FRAGMENTS:
            self.held.clear()
        self.held.update((f, ids) for f, ids in new.items() if len(f) <= _CACHE_CHARS)
        return [new[f] if ids is None else ids for f, ids in zip(fragments, found)]

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text, as the library's encode gives them without special tokens added."""
        return self.encode_many(pa.array([text], pa.string()))[0]

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The same for a column of texts: equal fragments are found by Arrow and looked up once for the column."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.full(len(texts), self.whole)
        if self.special and not self.whole:
            whole = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        asis = np.flatnonzero(whole)
        for i, ids in zip(asis.tolist(), self._encode(texts.take(pa.array(asis)).to_pylist())):
            out[i] = ids
        plain = np.flatnonzero(~whole)
        cut = texts.take(pa.array(plain))
        size = pc.sum(pc.binary_length(cut)).as_py()
        if not size:
            return out
        bounds = np.frombuffer(cut.buffers()[1], np.int64, len(cut) + 1)
        data = np.frombuffer(cut.buffers()[2], np.uint8, size)
        begins = np.append(_cuts(data), True)
        begins[bounds] = True
        starts = np.flatnonzero(begins)
        fragments = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), cut.buffers()[2])
        coded = fragments.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        parts = self._lookup(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        first, own = np.cumsum(sizes) - sizes, sizes[index]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join(parts), f"<u{self.width}")
        ids = ids[np.arange(ends[-1]) + np.repeat(first[index] - ends + own, own)]
        at = np.append(0, ends)[np.searchsorted(starts, bounds)].tolist()
        for i, a, b in zip(plain.tolist(), at, at[1:]):
            out[i] = ids[a:b].tobytes()
        return out


def encoder(held) -> CachedEncoder:
    """The encoder of a broadcast vocabulary, one for each worker."""
    return tool(("encoder", hash(held.value)), lambda: CachedEncoder(held.value))


def vocabulary_of(path: str) -> str:
    """The vocabulary file, read once by the driver; workers get its content."""
    return Path(path).read_text(encoding="utf-8")


def train_dictionary(docs: DataFrame, held, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from serialized id arrays of a bounded sample; empty if it is too small.

    A document is in the sample if the hash of its id falls below a threshold set by the number of rows.
    """
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    limit = int(-(1 << 63) + share * ((1 << 64) - 1))
    sample = docs.where((F.xxhash64("doc_id") <= min(limit, (1 << 63) - 1)) & (F.octet_length("text") <= SAMPLE_DOC_BYTES))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(held)
        for frame in frames:
            ids = coder.encode_many(pa.array(frame["text"], pa.string()))
            yield pd.DataFrame({"ids": [i + coder.pack([end_id]) for i in ids]})

    rows = sample.select("text").limit(2 * SAMPLE_DOCS).mapInPandas(pack, "ids binary").collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(bytes(r["ids"]) for r in rows)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _shards(held, dictionary: bytes, end_id: int):
    digest = hashlib.sha256(dictionary).hexdigest() if dictionary else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(held)
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        squeeze = zstandard.ZstdCompressor(level=3, **extra).compress
        end, ids, counts, parts, size, shard, part = coder.pack([end_id]), [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, parts)]).tolist()
            values = (part, shard, coder.width, digest, ids, counts, offsets, b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW)], names=_NAMES)

        for batch in batches:
            for piece in pieces(batch, batch.schema.get_field_index("text")):
                part = piece.column("part")[0].as_py()
                for doc_id, packed in zip(piece.column("doc_id").to_pylist(), coder.encode_many(piece.column("text"))):
                    packed += end
                    ids.append(doc_id)
                    counts.append(len(packed) // coder.width)
                    parts.append(squeeze(packed))
                    size += len(parts[-1])
                    if size >= SHARD_BYTES:
                        yield row()
                        ids, counts, parts, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield row()

    return run


_NAMES = ["part", "shard", "width", "dict_sha256", "doc_ids", "counts", "offsets", "frames"]
_ARROW = [pa.int32()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about PIECE_BYTES in the column of texts at this place."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + PIECE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Encode (doc_id, text) and write shards under ``path``/shards and the dictionary under ``path``/dictionary.

    A null text counts as empty and gives the end id only. Rows come in ascending doc_id order, null ids
    first; rows of equal id in the order of their texts. A range of ids is a task, so rows with one id
    stay together; an empty table writes no shard.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    dictionary = train_dictionary(docs, held, end_id)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    placed = (
        docs.repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    shards = placed.mapInArrow(_shards(held, dictionary, end_id), SHARDS)
    # Frames are compressed already.
    shards.write.option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(f"{path}/shards")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def decompressor(dictionary: bytes, wanted: str):
    """A function that unpacks one frame; the dictionary must be the one the shard was written with."""
    if wanted != (hashlib.sha256(dictionary).hexdigest() if dictionary else ""):
        raise ValueError("the shard was written with another dictionary")
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**extra).decompress


def _documents(dictionary: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                unpack = decompressor(dictionary, row.dict_sha256)
                doc_ids, starts, counts, packed = [], [], [], []
                at = row.first_token
                for i, doc_id in enumerate(row.doc_ids):
                    raw = unpack(row.frames[row.offsets[i] : row.offsets[i + 1]])
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    starts.append(at)
                    counts.append(len(raw) // row.width)
                    packed.append(raw if row.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    at += counts[-1]
                yield pd.DataFrame(
                    {"doc_id": pd.array(doc_ids, "Int64"), "start": starts, "n_tokens": counts, "ids": packed}
                )

    return run


def _with_first_token(shards: DataFrame) -> DataFrame:
    """Add the number of ids before each shard. One total per written part passes the driver."""
    spark = shards.sparkSession
    own = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    totals = shards.groupBy("part").agg(F.sum(own).alias("n")).collect()
    before, seen = [], 0
    for row in sorted(totals, key=lambda r: r["part"]):
        before.append((row["part"], seen))
        seen += row["n"]
    offsets = spark.createDataFrame(before, "part int, base bigint")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", own.alias("n")).withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    first = sizes.join(offsets, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("first_token"))
    return shards.join(first, ["part", "shard"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start = ids before them."""
    shards = _with_first_token(spark.read.schema(SHARDS).parquet(f"{path}/shards"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return shards.mapInPandas(_documents(read_dictionary(spark, path)), schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The id lists of one document; only shards that hold it are opened, only its frames unpacked."""
    rows = spark.read.schema(SHARDS).parquet(f"{path}/shards").where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
    found, dictionary = [], read_dictionary(spark, path)
    for row in rows.orderBy("part", "shard").toLocalIterator():
        unpack = decompressor(dictionary, row["dict_sha256"])
        for i, d in enumerate(row["doc_ids"]):
            if d == doc_id:
                raw = unpack(bytes(row["frames"][row["offsets"][i] : row["offsets"][i + 1]]))
                found.append(np.frombuffer(raw, f"<u{row['width']}").tolist())
    return found


def op8_token_binary(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs.select("doc_id", col("text")), vocabulary_of(vocabulary_path), path)
    tokens = read_tokens(spark, path)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
