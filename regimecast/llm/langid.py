"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors,
permuted by their place; a text is the sum of its trigrams, a language the sum of its texts. The
language whose vector has the largest cosine with the text's vector is predicted.

The sums are whole numbers, so the profiles do not depend on partitioning. Training adds up one
vector per language and task; what reaches the driver is one vector per language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, tool, with_fields

DIMENSIONS, SEED, UNKNOWN = 1024, 20240607, "und"
#: More labels than this are not languages; training then raises an error.
MAX_LANGUAGES = 4096
_SYMBOLS = 128  # 0 stands for anything that is no letter
_CHARS = 1 << 18  # characters counted in one dense block


class _Letters:
    """Symbols of code points, filled in as they are met; kept by each worker."""

    table = np.full(0x110000, -1, np.int16)

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        symbols = cls.table[points]
        if symbols.size and symbols.min() < 0:
            for p in np.unique(points[symbols < 0]).tolist():
                cls.table[p] = cls.symbol(p)
            symbols = cls.table[points]
        return symbols

    @staticmethod
    def symbol(point: int) -> int:
        """a-z and the letters of Latin-1 have symbols of their own, others share the rest by a hash."""
        if not chr(point).isalpha():
            return 0
        if 97 <= point <= 122:
            return point - 96
        if 0xDF <= point <= 0xFF:
            return 27 + point - 0xDF
        return 60 + (point * 2654435761 >> 7) % (_SYMBOLS - 60)


def _letter_vectors(dimensions: int) -> list[np.ndarray]:
    """The letters' vectors, permuted once for each place in a trigram."""
    base = np.random.default_rng(SEED).integers(0, 2, (_SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
    return [np.roll(base, shift, axis=1).astype(np.int8) for shift in (2, 1, 0)]


def _bind(codes: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    first, second, third = codes // _SYMBOLS**2, codes // _SYMBOLS % _SYMBOLS, codes % _SYMBOLS
    return (places[0][first] * places[1][second] * places[2][third]).astype(np.float32)


def _trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams; everything between two runs of letters counts as one separator."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = _Letters.of(points).astype(np.int32)
    keep = symbols > 0
    if not keep.any():
        return np.empty(0, np.int32)
    keep[1:] |= keep[:-1]
    keep[0] = True
    symbols = symbols[keep]
    return (symbols[:-2] * _SYMBOLS + symbols[1:-1]) * _SYMBOLS + symbols[2:]


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places of texts, their trigram counts as a dense table, the trigrams of its columns)."""
    def table(rows: list[int], parts: list[np.ndarray]):
        codes = np.concatenate(parts)
        used = np.flatnonzero(np.bincount(codes, minlength=_SYMBOLS**3))
        column = np.zeros(_SYMBOLS**3, np.int32)
        column[used] = np.arange(len(used), dtype=np.int32)
        row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])
        counts = np.bincount(row * len(used) + column[codes], minlength=len(parts) * len(used))
        return rows, counts.reshape(len(parts), len(used)), used

    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        codes = _trigrams(text) if text else np.empty(0, np.int32)
        if not codes.size:
            continue
        if size and size + codes.size > _CHARS:
            yield table(rows, parts)
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(codes)
        size += codes.size
    if rows:
        yield table(rows, parts)


def _sums(dimensions: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, total = tool(("letters", dimensions), lambda: _letter_vectors(dimensions)), {}
        for frame in frames:
            labels = frame["label"].tolist()
            for rows, counts, used in _blocks(frame["text"].tolist()):
                owner = pd.factorize(pd.Series([labels[i] for i in rows]))
                by_label = np.zeros((len(owner[1]), len(used)), np.int64)
                np.add.at(by_label, owner[0], counts)
                vectors = by_label.astype(np.float64) @ _bind(used, places).astype(np.float64)
                for label, vector in zip(owner[1], vectors):
                    total[label] = total.get(label, 0) + vector
        for label, vector in total.items():
            yield pd.DataFrame({"label": [label], "vector": [np.rint(vector).astype(np.int64)]})

    return run


def _predictor(labels: list[str], profiles: np.ndarray) -> Callable:
    units = (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)).astype(np.float64)

    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if labels:
            places = tool(("letters", units.shape[1]), lambda: _letter_vectors(units.shape[1]))
            for rows, counts, used in _blocks(texts.tolist()):
                vectors = counts.astype(np.float32) @ _bind(used, places)
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
                cosines = vectors.astype(np.float64) @ units.T / norms[:, None]
                best = cosines.argmax(axis=1)
                for i, b, c in zip(rows, best, cosines[np.arange(len(rows)), best]):
                    names[i], scores[i] = labels[b], min(max(float(c), 0.0), 1.0)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run


@dataclass
class LanguageProfiles:
    """Labels in ascending order and one vector each; at most MAX_LANGUAGES x dimensions numbers."""

    labels: list[str]
    vectors: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", label: str = "lang", dimensions: int = DIMENSIONS):
        """Bundle all rows whose text and label are not null."""
        known = docs.select(col(text).alias("text"), col(label).alias("label")).dropna()
        partial = known.mapInPandas(_sums(dimensions), "label string, vector array<bigint>")
        cells = partial.select("label", F.posexplode("vector").alias("i", "x"))
        summed = cells.groupBy("label", "i").agg(F.sum("x").alias("x"))
        vectors = summed.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        rows = vectors.select("label", F.col("v.x").alias("v")).limit(MAX_LANGUAGES + 1).collect()
        if len(rows) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} different labels in {label!r}")
        rows.sort(key=lambda r: r["label"])
        if not rows:
            return cls([], np.zeros((0, dimensions)))
        return cls([r["label"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64))

    def predict(self, docs: DataFrame, text: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
        """Add the predicted label and its score (cosine, 0 to 1); columns of these names are replaced.

        ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing was
        learned. Ties go to the first label in order. Equal texts get equal results; an empty table
        stays empty.
        """
        guess = F.pandas_udf(_predictor(self.labels, self.vectors), "lang_pred string, score double")
        return with_fields(docs, guess(col(text)), ["lang_pred", "score"], names)


def fold(doc_id: str = "doc_id"):
    """The remainder that decides which rows are held out; 2 means held out. A null id is not."""
    return F.coalesce(F.crc32(col(doc_id).cast("string")) % 4, F.lit(0).cast("bigint"))


def op1_language_id(docs: DataFrame) -> DataFrame:
    profiles = LanguageProfiles.fit(docs.where(fold() != 2))
    rows = docs.select("doc_id", "text", (fold() == 2).alias("held_out"))
    return profiles.predict(rows).select("doc_id", "held_out", "lang_pred", "score")
