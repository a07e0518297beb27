"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimecast.llm import reach_workers

#: Bits of the table that tells which texts take part in a join.
MAX_BITS = 1 << 27

# Bytes as seen by the two word definitions, after A-Z are lower-cased. Bytes above 127 are never
# separators in either, so whole UTF-8 texts can be cut without decoding them.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in _LOWER)

#: The same words for Spark's regular expressions; the text has to be lower-cased by ``lower_ascii``.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and any character beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    reach_workers(spark.sparkContext)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name the frame does not have."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem = "_" + stem
    return stem


def with_fields(df: DataFrame, struct: Column, fields: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Add the fields of a struct, as ``names`` if given; input columns of the same names are replaced."""
    names = names or fields
    taken = {n.lower() for n in names}
    held = fresh(df, "_fields")
    rest = [col(c) for c in df.columns if c.lower() not in taken]
    wide = df.select(*[col(c) for c in df.columns], struct.alias(held))
    return wide.select(*rest, *[F.col(held)[f].alias(n) for f, n in zip(fields, names)])


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs."""
    out = None
    for a, b in pairs:
        one = left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
        out = one if out is None else out & one
    return out


def marked(docs: DataFrame, hashes: DataFrame):
    """A column that tells of a text hash whether it may be one of ``hashes`` (column th); never false for one that is.

    The table of bits is broadcast; its size is bounded, whatever the number of hashes. It only spares rows a shuffle.
    """
    count = hashes.count()
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    words = hashes.selectExpr(f"pmod(th, {bits}) DIV 64 AS w", "shiftleft(1L, CAST(pmod(th, 64) AS INT)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()  # 16 bytes a row, whatever the session's settings
    table = np.zeros(bits // 64, np.int64)
    table[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def test(th: pd.Series) -> pd.Series:
        at = th.to_numpy(np.int64) % bits
        return pd.Series((held.value[at >> 6] >> (at & 63)) & 1 == 1)

    return F.pandas_udf(test, "boolean")


_TOOL: dict[tuple, object] = {}


def tool(key: tuple, build: Callable[[], object]):
    """The one large object a Python worker keeps between batches; another one takes its place.

    Workers are reused by all stages of a job, so what an earlier stage cached must not stay.
    """
    if key not in _TOOL:
        if _TOOL:
            _TOOL.clear()
            release()
        _TOOL[key] = build()
    return _TOOL[key]


def release() -> None:
    """Hand freed memory back to the system: a Python worker that waits for its next task would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only with the GNU C library
    if trim:
        trim(0)
