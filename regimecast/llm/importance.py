"""Importance resampling towards a target distribution, by bit-sliced sums.

Features are runs of words, hashed to buckets. A bucket's gain is the logarithm of how much more often
the target texts have it, in whole thousandths. A document's weight is the mean gain of its features.

The sum of gains is taken bit by bit. The counts of a document's buckets become planes of one bit for
each bucket: plane p holds the bits of value 2^p. Gains become planes too, the highest one of negative
value. The buckets that two planes share are an AND and a population count, and each such count stands
for a power of two. All sums are whole numbers, so the weights are exact.

Of the documents with enough words, those of the highest weight plus Gumbel noise are drawn. The noise
comes from a hash of the document's id.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimecast.llm.common import alnum_words, col, tool
from regimecast.session import materialise

BUCKETS, LONGEST, SEED, PERCENT, MIN_WORDS = 10_000, 1, 2024, 10, 20
_CACHE = 500_000
_SLICE = 1 << 18  # features whose planes are built together, or those of one longer document


class _Buckets(dict):
    """Bucket of every feature seen lately."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[feature] = bucket = crc32(feature) % self.buckets
        return bucket


def features(text: str | None, longest: int = LONGEST) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to ``longest`` of them."""
    words = alnum_words(text)
    out = list(words)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*[words[i:] for i in range(n)]))
    return len(words), out


def _hashed(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = tool(("buckets", buckets), lambda: _Buckets(buckets)).__getitem__
        kind = _kind(buckets)
        for batch in batches:
            words, counts, packed = [], [], []
            for text in batch.column("text"):
                n, own = features(text.as_py(), longest)
                words.append(n)
                counts.append(len(own))
                packed.append(np.fromiter(map(bucket_of, own), kind, len(own)).tobytes())
            arrays = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "buckets"])

    return run


def hashed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every feature, packed."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"
    return docs.mapInArrow(_hashed(longest, buckets), schema)


def _kind(buckets: int) -> str:
    return "<u4" if buckets > 1 << 16 else "<u2"


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows. Tasks send one row for each bucket; the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                total += np.bincount(np.frombuffer(packed.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["b", "n"])

    found = rows.select("buckets").mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["b"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of target share over source share, one added to every bucket."""
    n = len(source)
    above = (target + 1.0) * (float(source.sum()) + n)
    below = (source + 1.0) * (float(target.sum()) + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


class BitSliced:
    """Sums of gains over the counts of documents, by planes of bits."""

    def __init__(self, gain: np.ndarray) -> None:
        self.buckets = len(gain)
        self.width = -(-self.buckets // 64) * 64
        bits = int(max(gain.max(initial=0), -1 - gain.min(initial=0))).bit_length() + 1
        # Two's complement: the highest plane counts below zero.
        self.planes = [(self._packed(((gain >> q) & 1)[None, :].astype(bool))[0], -(1 << q) if q == bits - 1 else 1 << q) for q in range(bits)]
        self.planes = [(plane, value) for plane, value in self.planes if plane.any()]

    def _packed(self, dense: np.ndarray) -> np.ndarray:
        """Rows of booleans as rows of 64-bit words."""
        if dense.shape[1] < self.width:
            dense = np.pad(dense, ((0, 0), (0, self.width - dense.shape[1])))
        return np.packbits(dense, axis=1).view(np.uint64)

    def sums(self, buckets: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The gain of every document; ``buckets`` holds those of its features, document after document."""
        out = np.zeros(len(lens), np.int64)
        owner = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
        cells, counts = np.unique(owner * self.width + buckets, return_counts=True)
        power = 0
        while len(cells):
            on = (counts >> power) & 1 == 1
            docs, rows = np.unique(cells[on] // self.width, return_inverse=True)
            for start in range(0, len(docs), 256):
                mine = docs[start : start + 256]
                inside = (rows >= start) & (rows < start + 256)
                dense = np.zeros((len(mine), self.width), bool)
                dense[rows[inside] - start, cells[on][inside] % self.width] = True
                plane = self._packed(dense)
                for gain, value in self.planes:
                    shared = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                    out[mine] += (value << power) * shared
            power += 1
            rest = counts >> power > 0
            cells, counts = cells[rest], counts[rest]
        return out


def _slices(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``_SLICE`` features."""
    total, at = np.cumsum(lens), 0
    while at < len(lens):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + _SLICE, "right")))
        yield at, end
        at = end


def _weigher(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool(("gains",), tuple)
        sliced = BitSliced(held.value)
        kind = _kind(sliced.buckets)
        for batch in batches:
            lens = batch.column("n_features").to_numpy(zero_copy_only=False)
            packed = batch.column("buckets")
            total = np.zeros(len(lens), np.int64)
            for a, b in _slices(lens):
                own = np.frombuffer(b"".join(packed.slice(a, b - a).to_pylist()), kind).astype(np.int64)
                total[a:b] = sliced.sums(own, lens[a:b])
            weight = pa.array(total // np.maximum(lens, 1), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "n_words", "n_features")] + [weight], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths from the first 32 bits of a hash of the id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where it is not drawn.

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred of highest score are drawn, equal
    scores by ascending doc_id, nulls last. Repeated rows are documents of their own; of equal ids the order is
    Spark's. Null and empty texts have no features and weight 0. Without target texts the target counts as
    uniform. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = materialise(hashed(docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")), longest, buckets))
    wanted = target.select(F.lit(None).cast("bigint").alias("doc_id"), col(target_text).alias("text"))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(hashed(wanted, longest, buckets), buckets))
    held = spark.sparkContext.broadcast(gain)
    weighed = rows.mapInArrow(_weigher(held), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return _ranked(scored, percent, min_words)


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Scores are whole thousandths of a bounded logarithm, so there are some ten thousand of them, whatever
    the number of rows, and the noise leaves none with more than a two-thousandth of the rows. The driver counts rows
    by score; rows of one score are numbered by id."""
    enough = F.col("n_words") >= min_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    before, seen = [], 0
    for score, n in counts:
        if seen >= wanted:
            break
        before.append((score, seen))
        seen += n
    listed = scored.sparkSession.createDataFrame(before, "_score bigint, _before bigint")
    drawn = F.when(enough, F.col("score"))
    placed = scored.join(F.broadcast(listed), drawn == F.col("_score"), "left")
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    among = placed.where("_score IS NOT NULL").withColumn("rank", (F.col("_before") + inside).cast("bigint"))
    rest = placed.where("_score IS NULL").withColumn("rank", F.lit(None).cast("bigint"))
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
    return among.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank)


def op13_importance_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents with weight, score and rank against the benchmark texts; edge cases as in ``resample``."""
    return resample(docs, benchmark)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
k AS (SELECT r, w, count(*)::BIGINT AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
steps AS (SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS c FROM range(256) x(i)),
tab AS (SELECT list(list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM steps),
v AS (SELECT DISTINCT w FROM (SELECT w FROM k UNION ALL SELECT w FROM e)),
h AS (SELECT w, hex(encode(w)) AS x FROM v),
b AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM k JOIN b USING (w) GROUP BY bucket),
u AS (SELECT bucket, count(*)::BIGINT AS n FROM e JOIN b USING (w) GROUP BY bucket),
z AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS sn, coalesce((SELECT sum(n) FROM u), 0)::DOUBLE AS un),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(u.n, 0) + 1)::DOUBLE * (sn + 10000)) / ((s.n + 1)::DOUBLE * (un + 10000))))::BIGINT AS gain FROM s LEFT JOIN u USING (bucket), z),
m AS (SELECT r, sum(n * gain)::BIGINT AS total FROM k JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
o AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(floor_div, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM (SELECT d.r, doc_id, ws, CASE WHEN len(ws) > 0 THEN (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS floor_div FROM d LEFT JOIN m ON d.r = m.r)),
p AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT)::BIGINT AS score FROM o),
q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score, (CASE WHEN rank <= 10 * n // 100 THEN rank END)::BIGINT AS rank FROM p LEFT JOIN q USING (r)
"""
