"""SentencePiece BPE by a table of prefixes, and decoding.

The encoding of every prefix of a text ends in one certain token. An automaton over all pieces finds
the tokens that can end at a place, and of these exactly one stands beside the last token of the
prefix before it without a merge across the seam that would have come first. So the table is filled
from left to right with one entry for each character, and the ids are read from it backwards.

No piece of such a model holds a space mark after another character, so texts are cut before runs of
spaces, and each distinct word is encoded once by a worker. Characters without a piece become bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, tool, with_fields

SPACE = "▁"
_CACHE_WORDS, _CACHE_SEAMS = 400_000, 2_000_000
_NORMAL, _BYTE = 1, 6


class PrefixBpe:
    """The encoder of a SentencePiece BPE model with byte fallback and without text normalisation.

    ``model`` is the content of the model file. Models of another kind are refused.
    """

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self._refuse(spec)
        self.library = SentencePieceProcessor(model_proto=model)
        self.pieces = [p.piece for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        places = {s: k for k, s in enumerate(sorted({spec.pieces[i].score for i in self.ids.values()}, reverse=True))}
        # When a token is merged: a place in the order of merges, -1 for a character that is there from the start.
        self.order = [-1] * len(self.pieces)
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.order[i] = places[spec.pieces[i].score]
        self.sizes = list(map(len, self.pieces))
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._split(i):
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.decimal = list(map(str, range(len(self.pieces))))
        self.raw = [p.replace(SPACE, " ").encode("utf-8") for p in self.pieces]
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words: dict[str, tuple[int, str, str]] = {}
        self.seams: dict[int, bool] = {}

    @staticmethod
    def _refuse(spec) -> None:
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if not plain or norm.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model normalises texts; only the identity with a leading space mark is supported")
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        if not kinds <= {_NORMAL, 2, 3, _BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        characters = {p.piece for p in spec.pieces if p.type == _NORMAL and len(p.piece) == 1}
        if any(set(p.piece) - characters for p in spec.pieces if p.type == _NORMAL):
            raise ValueError("a piece holds a character that is no piece itself")

    def _split(self, token: int) -> bool:
        """Note the two tokens of whose merge ``token`` comes; false if its own text is encoded otherwise."""
        parts = [self.ids[c] for c in self.pieces[token]]
        while len(parts) > 1:
            merged = [self.ids.get(self.pieces[a] + self.pieces[b], -1) for a, b in zip(parts, parts[1:])]
            best = min((k for k, m in enumerate(merged) if m >= 0), key=lambda k: (self.order[merged[k]], k), default=None)
            if best is None:
                return False
            self.halves[merged[best]] = (parts[best], parts[best + 1])
            parts[best : best + 2] = [merged[best]]
        return parts == [token]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay two: no merge across their seam precedes those that build them."""
        key = left * len(self.pieces) + right
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > _CACHE_SEAMS:
                self.seams.clear()
            known = self.seams[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        pieces, order, before = self.pieces, self.order, len(self.pieces)
        while True:
            across = self.ids.get(pieces[left] + pieces[right])
            if across is not None and order[across] < before:
                return False
            if order[left] < 0 and order[right] < 0:
                return True
            # Undo the later of the last merges on either side. Of equal ones the left one came first.
            if order[left] > order[right]:
                before, left = order[left], self.halves[left][1]
            else:
                before, right = order[right] + 1, self.halves[right][0]

    def table(self, text: str) -> list[int]:
        """The last token of every prefix, the empty one first; -1 where the last character has no piece."""
        last, seams, size_of, many = [-1] * (len(text) + 1), self.seams, self.sizes, len(self.pieces)
        done = -1
        for end, token in self.automaton.iter(text):
            if end != done:
                before = last[end + 1 - size_of[token]]
                if before < 0:
                    last[end + 1], done = token, end
                    continue
                known = seams.get(before * many + token)
                if known is None:
                    known = self.apart(before, token)
                if known:
                    last[end + 1], done = token, end
        return last

    def fragment(self, text: str) -> list[int]:
        """The ids of a text in which spaces are space marks already."""
        last, ids, at = self.table(text), [], len(text)
        while at:
            token = last[at]
            if token < 0:
                ids += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8"))]
                at -= 1
            else:
                ids.append(token)
                at -= self.sizes[token]
        ids.reverse()
        return ids

    def units(self, text: str) -> list[str]:
        """The parts of a text that are encoded alone, each without the space mark it begins with."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return [marked[1:]]
        if SPACE + SPACE not in marked and not marked.endswith(SPACE):
            return marked[1:].split(SPACE)
        return [u[1:] for u in _UNIT.findall(marked)]

    def described(self, text: str | None) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by commas, decoded text) of every unit of a text."""
        if not text:
            return []
        units = self.units(text)
        found = list(map(self.words.get, units))
        if None in found:
            for i, unit in enumerate(units):
                if found[i] is None:
                    found[i] = self.words.get(unit) or self._learn(unit)
        return found

    def _learn(self, unit: str) -> tuple[int, str, str]:
        ids = self.fragment(SPACE + unit)
        # The bytes of a character stand together, so a unit is decoded alone.
        decoded = b"".join([self.raw[i] for i in ids]).decode("utf-8")
        entry = (len(ids), ",".join([self.decimal[i] for i in ids]), decoded)
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        if len(unit) <= 64:
            self.words[unit] = entry
        return entry

    def encode(self, text: str | None) -> list[int]:
        """The ids of the library's encode without begin and end ids."""
        return [int(i) for _, listed, _ in self.described(text) for i in listed.split(",")]

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode([int(i) for i in ids])


_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


def _held(df: DataFrame, model_path: str | None):
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())


def codec(held) -> PrefixBpe:
    """The encoder of a broadcast model, one for each worker."""
    return tool(("pieces", hash(held.value)), lambda: PrefixBpe(held.value))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """Add the ids of each text as array<int>; a column of this name is replaced. Null and empty: no ids."""
    held = _held(docs, model_path)

    def run(texts: pd.Series) -> pd.Series:
        coder = codec(held)
        return pd.Series([coder.encode(t) for t in texts], dtype=object)

    return with_fields(docs, F.struct(F.pandas_udf(run, "array<int>")(col(text)).alias(ids)), [ids])


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Add the decoded text; a column of this name is replaced. Null ids give an empty text."""
    held = _held(docs, model_path)

    def run(rows: pd.Series) -> pd.Series:
        coder = codec(held)
        return pd.Series([coder.decode([] if r is None else r) for r in rows], dtype=object)

    return with_fields(docs, F.struct(F.pandas_udf(run, "string")(col(ids)).alias(text)), [text])


FIELDS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def digests(docs: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """Encode, decode and hash in one pass: add n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the decoded text in UTF-8).

    Columns of these names are replaced, all others are kept. Null and empty texts have no ids and the
    hashes of empty strings; repeated rows are encoded alike; an empty table gives no rows. A text of
    any length is encoded whole, in time and memory in proportion to its length.
    """
    held = _held(docs, model_path)

    def run(texts: pd.Series) -> pd.DataFrame:
        coder, rows = codec(held), []
        for t in texts:
            units = coder.described(t)
            counts, listed, decoded = zip(*units) if units else ((), (), ())
            # The first unit's own space mark was put there by the encoder.
            whole = "".join(decoded)[1:].encode("utf-8")
            ids = ",".join(listed).encode()
            rows.append((sum(counts), hashlib.sha256(ids).hexdigest(), hashlib.sha256(whole).hexdigest()))
        return pd.DataFrame(rows, columns=FIELDS)

    udf = F.pandas_udf(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return with_fields(docs, udf(col(text)), FIELDS)


def op11_sentencepiece(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of ``digests`` for every row of a documents table."""
    return digests(docs.select("doc_id", "text")).drop("text")
