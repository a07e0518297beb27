"""BPE encoding by forced boundaries, and decoding.

Two neighbouring bytes that never stand side by side inside any token of the vocabulary can never
end up in one token: a cut between them is certain. Words are split at these cuts, the fragments
are encoded independently by the tokenizer's own merges, and their ids are concatenated. Fragments
are short and come back often, so each distinct one is merged once by a worker. Only the last
fragment of a word takes the end-of-word mark.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regimecast.llm.common import col, tool
from regimecast.llm.tokens import pieces, vocabulary_of

#: Entries of a cache in a worker at most; it holds one of words and two of fragments.
_CACHE = 360_000


class Recent(dict):
    """Results by key, computed when first asked for; of those not asked for lately at most half the limit stays."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        self.compute, self.half, self.older = compute, limit // 2, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """A tokenizer of the ``tokenizers`` library with byte-level BPE, encoded fragment by fragment."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer, models

        parts = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = parts["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = self.tokenizer.model
        self.inner = models.BPE(vocab=model["vocab"], merges=merges) if suffix else self.last
        self.joined = {
            token[i : i + 2]
            for token in (t.removesuffix(suffix) if suffix else t for t in model["vocab"])
            for i in range(len(token) - 1)
        }
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Words end at plain spaces if the tokenizer itself drops white space before it merges.
        self.drops_space = bool(suffix) and self.words("a b\nc") == ["a", "b", "c"]
        self.letters = self._letters() if self.drops_space else {}
        self.marks = {m for m in ".,;:!?" if self.words(m) == [m] and all(self.words(w + m) == [*self.words(w), m] for w in ("a", "bc"))}
        size = self.tokenizer.get_vocab_size()
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.plain_join = parts.get("decoder") is None
        self.ids = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.ids.itemsize == 2 else "I"
        self.chunks = Recent(self._chunk, _CACHE)
        self.fragments = Recent(self._by(self.inner), _CACHE), Recent(self._by(self.last), _CACHE)

    def words(self, text: str) -> list[str]:
        """Words in the byte alphabet, normalised and split by the tokenizer."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text] if text else []
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _letters(self) -> dict[int, str]:
        """What the letters up to U+00FF are in the byte alphabet, each by itself; none if a run of them all is not one word of just these."""
        letters = [c for c in map(chr, range(256)) if c.isalpha()]
        one = {ord(c): "".join(self.words(c)) for c in letters}
        return one if self.words("".join(letters)) == ["".join(one.values())] else {}

    def _plain_word(self, chunk: str) -> bool:
        """Whether the chunk is letters up to U+00FF only: one word, no two letters of which are composed."""
        return bool(self.letters) and chunk.isalpha() and (chunk.isascii() or max(chunk) <= "\xff")

    def cut(self, word: str) -> list[str]:
        """Fragments between certain cuts."""
        if self.joined.issuperset(map(add, word, word[1:])):
            return [word]
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])]

    def _by(self, model) -> Callable[[str], bytes]:
        def ids(fragment: str) -> bytes:
            found = [t.id for t in model.tokenize(fragment)]
            return struct.pack(f"<{len(found)}{self.code}", *found)

        return ids

    def _chunk(self, chunk: str) -> bytes:
        out: list[bytes] = []
        inner_ids, last_ids = self.fragments
        if self._plain_word(chunk):
            words = [chunk.translate(self.letters)]
        elif chunk[-1:] in self.marks and self._plain_word(chunk[:-1]):
            # A mark after a word is a word of its own.
            return self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]
        else:
            words = self.words(chunk) if chunk else []
        for word in words:
            *inner, last = self.cut(word)
            out += [inner_ids[f] for f in inner]
            out.append(last_ids[last])
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not self.drops_space:
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def pack(self, text: str | None) -> np.ndarray:
        """The ids that the library's encode gives without adding special tokens."""
        if not text:
            return np.empty(0, self.ids)
        if self.special_cut is None or not self.special_cut.search(text):
            return np.frombuffer(self._plain(text), self.ids)
        parts = [
            np.array([self.special[p]], self.ids).tobytes() if p in self.special else self._plain(p)
            for p in self.special_cut.split(text)
            if p
        ]
        return np.frombuffer(b"".join(parts), self.ids)

    def encode(self, text: str | None) -> list[int]:
        """The same as a list."""
        return self.pack(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text that the library's decode gives with special tokens kept."""
        if self.plain_join:
            names = self.names
            return " ".join([names[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def codec(held) -> ForcedBoundaryBpe:
    """The codec of a broadcast vocabulary, one for each worker."""
    return tool(("codec", hash(held.value)), lambda: ForcedBoundaryBpe(held.value))


def _held(df: DataFrame, vocabulary_path: str | None):
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    return df.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary_path))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """Add the ids of each text as array<int>; a column of this name is replaced. Null and empty: no ids."""
    held = _held(docs, vocabulary_path)

    def run(texts: pd.Series) -> pd.Series:
        coder = codec(held)
        return pd.Series([coder.encode(t) for t in texts], dtype=object)

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(col(text)))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary_path: str | None = None) -> DataFrame:
    """Add the decoded text; a column of this name is replaced. Null ids give an empty text."""
    held = _held(docs, vocabulary_path)

    def run(rows: pd.Series) -> pd.Series:
        coder = codec(held)
        return pd.Series([coder.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(col(ids)))


DIGEST = "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(
    docs: DataFrame, text: str = "text", vocabulary_path: str | None = None, with_ids: bool = False, with_text: bool = True
) -> DataFrame:
    """Encode, decode and hash in one pass: add n_tokens, ids_sha256 and decoded_sha256, and ids if wanted.

    Columns of these names are replaced. Null and empty texts have no ids, and the hashes of empty
    strings. Without ``with_ids`` the lists, and without ``with_text`` the texts never leave the worker.
    Rows are handed on in portions of texts, so a batch's lists are never held together.
    """
    held = _held(docs, vocabulary_path)
    added = [f for f in StructType.fromDDL(DIGEST).fields if with_ids or f.name != "ids"]
    taken = {f.name for f in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in taken and (with_text or c != text)]
    at = docs.columns.index(text)
    schema = StructType([*[docs.schema.fields[i] for i in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(held)
        decimal = list(map(str, range(len(coder.names))))
        for batch in batches:
            for piece in pieces(batch, at):
                packed = [coder.pack(t) for t in piece.column(at).to_pylist()]
                listed, decoded = [], []
                for one in packed:
                    ids = one.tolist()
                    listed.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                sizes = [len(one) for one in packed]
                columns = [piece.column(i) for i in kept]
                if with_ids:
                    values = pa.array(np.concatenate(packed).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values))
                columns += [pa.array(sizes, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def op9_bpe(docs: DataFrame) -> DataFrame:
    return digests(docs.select("doc_id", "text"), with_text=False)
