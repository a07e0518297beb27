"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. A table holds every distinct fingerprint
once per segment, under the segment's value. Of two fingerprints that differ in at most two bits, one
segment differs in at most one, so the table is probed with the Hamming ball of radius 1 around each
segment value, and matches are verified on all 64 bits. Where two values differ in one bit, one of them
lacks it; it is enough that this one asks for the other, so only variants with a further bit set are probed.

A segment value that many fingerprints share is split by a further segment: the other half's two
quarters, with the ball of radius 1 around each (two bits over two quarters leave one with at most one).
A split bucket has 48 bits in common, so it holds at most 2^16 fingerprints whatever the table's size.
Nothing is capped. Equal fingerprints are one node of the graph from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, fresh, spaced_words, tool
from regimecast.session import materialise

SEGMENTS, SEGMENT_BITS, SEED, SHINGLE, MAX_BITS = 2, 32, 42, 3, 2
#: Fingerprints under one segment value above which they are split by a further segment.
HOT_BUCKET = 64
_BLOCK = 1 << 18  # shingles whose bits are unpacked at once


def _bit_totals(hashes: list[int]) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[i : i + _BLOCK], dtype="<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint; zero for a text without words."""
    words = spaced_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(p, SEED) for p in pieces]
    set_bits = 2 * _bit_totals(hashes) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _signed(texts: pd.Series) -> pd.Series:
    tool(("fingerprints",), tuple)
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed bigint of the same bits."""
    return F.pandas_udf(_signed, "bigint")(text)


def _bits(value: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def _itself(value: Column, bits: int) -> Column:
    return F.array(value)


def _ball(value: Column, bits: int) -> Column:
    """The value and its variants with one further bit set."""
    return F.array_distinct(F.array(value, *[value.bitwiseOR(F.lit(1 << bit).cast("bigint")) for bit in range(bits)]))


def segment_rows(prints: DataFrame, around) -> DataFrame:
    """(segment, value, fp): for each segment of the fingerprints the values ``around`` its own."""
    fp = F.col("fp")
    first, second = (
        prints.select(F.lit(s).alias("segment"), F.explode(around(_bits(fp, s * SEGMENT_BITS, SEGMENT_BITS), SEGMENT_BITS)).alias("value"), "fp")
        for s in range(SEGMENTS)
    )
    return first.unionByName(second)


def _split(rows: DataFrame, hot: DataFrame, around) -> DataFrame:
    """The rows with ``part``: -1, or under a hot value the values ``around`` either quarter of the other segment."""
    fp, quarter = F.col("fp"), SEGMENT_BITS // 2
    rest = F.when(F.col("segment") == 0, _bits(fp, SEGMENT_BITS, SEGMENT_BITS)).otherwise(_bits(fp, 0, SEGMENT_BITS))
    low, high = _bits(rest, 0, quarter), _bits(rest, quarter, quarter).bitwiseOR(F.lit(1 << quarter).cast("bigint"))
    parts = F.concat(around(low, quarter), around(high, quarter))
    marked = rows.join(hot.withColumn("_hot", F.lit(True)), ["segment", "value"], "left")
    one = F.array(F.lit(-1).cast("bigint"))
    return marked.select("segment", "value", F.explode(F.when(F.col("_hot"), parts).otherwise(one)).alias("part"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """All links (u, v), u > v, between the distinct fingerprints of column ``fp``: at most ``MAX_BITS`` bits differ.

    A fingerprint has at most 2,080 others within two bits.
    """
    table = segment_rows(prints, _itself)
    hot = table.groupBy("segment", "value").count().where(F.col("count") > HOT_BUCKET).select("segment", "value")
    held = _split(table, hot, _itself)
    asked = _split(segment_rows(prints, _ball), hot, _ball).withColumnRenamed("fp", "asker")
    # Spark sizes the variants as if they were one row each, and would broadcast them by that.
    met = held.join(asked.hint("merge"), ["segment", "value", "part"])
    near = (F.col("fp") != F.col("asker")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("asker"))) <= MAX_BITS)
    return met.where(near).select(F.greatest("fp", "asker").alias("u"), F.least("fp", "asker").alias("v")).distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def stars(edges: DataFrame) -> DataFrame:
    """Contract links (u, v), u > v, until every node hangs on the smallest node of its component.

    Alternating large and small stars; only aggregates and joins, so a node with very many
    neighbours is split like any other skewed join key. Each round ends in a checkpoint.
    """
    edges = materialise(edges)
    before = _sum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").where(F.col("v") != F.col("m"))
        small = least.select("u", F.col("m").alias("v")).unionByName(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = materialise(small.distinct())
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges


def components(prints: DataFrame) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint, named by its smallest one."""
    nodes = materialise(prints.select("fp").distinct())
    roots = stars(links(nodes)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed bigint), component_id.

    A null or empty text has fingerprint zero and is linked like any other; repeated rows share the
    fingerprint; a null doc_id is never the smallest one, and a component of null ids only has a null
    component_id. An empty table gives no rows. Other columns of the input are not looked at.
    """
    prints = materialise(docs.select(col(doc_id).alias("doc_id"), fingerprint_column(col(text)).alias("fp")))
    # One row per fingerprint before the components are joined: copies do not travel.
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = materialise(components(prints).join(firsts, "fp"))
    smallest = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the frame, unchanged, that stay: of each component the one of smallest (doc_id, hash of text).

    A null doc_id comes first. Of repeated rows that tie, one stays, picked by Spark.
    """
    th = F.xxhash64(col(text)).alias("th")
    prints = materialise(docs.select(col(doc_id).cast("bigint").alias("doc_id"), th, fingerprint_column(col(text)).alias("fp")))
    rows = prints.groupBy("fp", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct("doc_id", "th", "copies")).alias("best")
    firsts = rows.groupBy("fp").agg(best).join(components(prints), "fp")
    d, t, n = (fresh(docs, name) for name in ("_doc", "_hash", "_copies"))
    stay = materialise(firsts.groupBy("root").agg(F.min("best").alias("best")).select("best.*").toDF(d, t, n))
    match = docs[f"`{doc_id}`"].cast("bigint").eqNullSafe(stay[d]) & F.xxhash64(docs[f"`{text}`"]).eqNullSafe(stay[t])
    held = docs.join(stay, match)
    once, more = held.where(col(n) == 1), held.where(col(n) > 1).dropDuplicates([d, t])
    return once.unionByName(more).select(*[col(c) for c in docs.columns])


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
