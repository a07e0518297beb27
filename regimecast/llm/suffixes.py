"""Exact substring duplicates by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Anchors. Every LENGTH-byte string owns the SEED-byte window of smallest hash inside it, the leftmost
   on ties. Equal strings own equal windows at equal places, so strings have to be compared only if
   the hashes of their anchors are equal. Neighbouring strings share their anchor: a text falls into
   runs of starts, about two every LENGTH - SEED bytes. Anchors met once in the corpus are done.
2. Contexts. The bytes under a run are its context. Equal contexts hold equal strings, so a context
   is sorted once with its count, however many copies the corpus has; if it is the only context of its
   anchor, all its strings are repeated and there is nothing to order.
3. Suffixes. The suffixes of all other contexts with one anchor meet in one task and are sorted
   deep-shallow: multikey quicksort on words of eight bytes down to a shallow depth, then a blind
   trie for every group that is still tied. Neighbours equal in LENGTH bytes are repeated.

An anchor with more than ``HOT_CONTEXTS`` different contexts is not brought together. Its suffixes
are grouped by the 128-bit hash of their first LENGTH bytes instead, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, same
from regimecast.session import scratch_path

LENGTH, SEED, SHALLOW = 200, 32, 32
HOT_CONTEXTS = 32_768
_PIECE = 1 << 22  # starts looked at together in a long text
_BATCH = 2 << 20  # bytes of contexts sorted together, plus the anchor that crosses the limit
_YIELD = 1 << 21  # bytes of texts or contexts after which a task hands on what it has
_LOW = np.uint64((1 << 24) - 1)
_M, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: bytes) -> np.ndarray:
    """A hash of the SEED bytes at every place."""
    h, width, factor = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1, _M
    with np.errstate(over="ignore"):
        while width < SEED:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, width * 2
        h ^= h >> np.uint64(29)
        h *= _C
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor hash, context hash) of all runs of a text."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, _PIECE):
        piece = data[at : at + _PIECE + LENGTH - 1]
        h = _hashes(piece)
        owner = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - SEED + 1) & _LOW
        cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
        anchor = owner[first].astype(np.int64)
        place = (anchor - first).tolist()
        digest = xxhash.xxh3_64_intdigest
        contexts = [digest(piece[a : b + LENGTH], p) for a, b, p in zip(first.tolist(), last.tolist(), place)]
        out.append((first + at, last + at, h[anchor].view(np.int64), np.array(contexts, np.uint64).view(np.int64)))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(parts) for parts in zip(*out))


class BlindTrie:
    """Strings that share a prefix, ordered by a trie that stores branching depths and bytes only.

    A string walks down without looking at skipped bytes, is compared once with the string at the leaf
    it comes to, and is hung in where the two first differ.
    """

    def __init__(self, buffer: bytes, length: int = LENGTH) -> None:
        self.buffer, self.length = buffer, length
        self.root: list | None = None  # leaf: [starts]; inner node: [depth, {byte: node}]

    def insert(self, start: int) -> None:
        buffer, node = self.buffer, self.root
        if node is None:
            self.root = [[start]]
            return
        path = []
        while len(node) == 2:
            path.append(node)
            child = node[1].get(buffer[start + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[0][0]
        ours, theirs = buffer[start : start + self.length], buffer[other : other + self.length]
        if ours == theirs:
            node[0].append(start)
            return
        differ = int.from_bytes(ours, "big") ^ int.from_bytes(theirs, "big")
        depth = self.length - (differ.bit_length() + 7) // 8
        above = None
        for step in path:
            if step[0] >= depth:
                break
            above = step
        if above is not None and (below := above[1].get(ours[above[0]])) is None:
            above[1][ours[above[0]]] = [[start]]
            return
        below = self.root if above is None else below
        if len(below) == 2 and below[0] == depth:
            below[1][ours[depth]] = [[start]]
            return
        split = [depth, {theirs[depth]: below, ours[depth]: [[start]]}]
        if above is None:
            self.root = split
        else:
            above[1][ours[above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """Starts of equal strings, string by string in ascending order."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 1:
                yield node[0]
            else:
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))


def deep_shallow(buffer: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at the given starts, and which equal the one before.

    Every string has to lie inside the buffer.
    """
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    words = np.zeros(len(buffer) + 1, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    tied = order.copy()
    for depth in range(0, shallow, 8):
        # Only strings still tied are sorted by their next eight bytes.
        key = words[starts[order[tied]] + depth]
        by = np.lexsort((key, group[tied]))
        moved, key, own = order[tied][by], key[by], group[tied]
        order[tied] = moved
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    equal = np.zeros(len(starts), bool)
    if len(tied):
        edges = np.flatnonzero(np.diff(group[tied])) + 1
        for at, end in zip([0, *edges.tolist()], [*edges.tolist(), len(tied)]):
            first = int(tied[at])
            members = order[first : first + end - at]
            trie = BlindTrie(buffer, length)
            by_start: dict[int, list[int]] = {}
            for i, s in zip(members.tolist(), starts[members].tolist()):
                trie.insert(s)
                by_start.setdefault(s, []).append(i)
            place = first
            for leaf in trie.leaves():
                for n, s in enumerate(leaf):
                    order[place] = by_start[s].pop(0)
                    equal[place] = n > 0
                    place += 1
    return order, equal


def repeated_starts(contexts: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For each (context, count) the offsets of its strings that occur more than once."""
    counts = [len(data) - LENGTH + 1 for data, _ in contexts]
    base = np.cumsum([0, *[len(data) for data, _ in contexts]])[:-1]
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
    order, equal = deep_shallow(b"".join(data for data, _ in contexts), base[owner] + offset)
    hit = np.zeros(len(owner), bool)
    hit[order] = equal | np.append(equal[1:], False)
    hit |= np.array([n > 1 for _, n in contexts])[owner]
    parts = np.split(hit, np.cumsum(counts)[:-1])
    return [np.flatnonzero(p) for p in parts]


_KEY = "doc_id bigint, th bigint"
RUNS = f"{_KEY}, lo int, hi int, h bigint, ch bigint"
CONTEXT = "h bigint, ch bigint, n bigint, data binary"
FOUND = "h bigint, ch bigint, froms array<int>, tos array<int>"


def _portions(sizes: list[int]) -> Iterator[slice]:
    """Neighbouring rows of _YIELD bytes, plus the row that crosses the limit."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= _YIELD:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _portions([len(t or "") for t in frame["text"]]):
            rows = frame.iloc[part]
            found = [runs((t or "").encode("utf-8", "surrogatepass")) for t in rows["text"]]
            sizes = [len(f[0]) for f in found]
            columns = [np.concatenate([f[i] for f in found]) for i in range(4)]
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].astype("Int64").repeat(sizes).reset_index(drop=True),
                    "th": np.repeat(rows["th"].to_numpy(), sizes),
                    "lo": columns[0].astype(np.int32),
                    "hi": columns[1].astype(np.int32),
                    "h": columns[2],
                    "ch": columns[3],
                }
            )


def _packed(texts: pd.Series) -> pd.Series:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in texts])


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack, names = zstandard.ZstdDecompressor().decompress, ["h", "ch", "n", "data"]
    rows, size = [], 0
    for frame in frames:
        for packed, los, his, hs, chs, ns in zip(*(frame[c] for c in ("packed", "lo", "hi", "h", "ch", "n"))):
            data = unpack(packed)
            for a, b, h, c, n in zip(los, his, hs, chs, ns):
                rows.append((h, c, n, data[a : b + LENGTH]))
                size += b - a + LENGTH
                if size >= _YIELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _ranges(places: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [-1]])].tolist()


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor; whole anchors are sorted together, a bounded number of bytes at once."""
    held: list[tuple] = []
    size = 0

    def flush() -> pd.DataFrame:
        rows = []
        for (h, ch, *_), places in zip(held, repeated_starts([(data, n) for *_, n, data in held])):
            if len(places):
                rows.append((h, ch, *_ranges(places)))
        return pd.DataFrame(rows, columns=["h", "ch", "froms", "tos"])

    for frame in frames:
        for row in frame.itertuples(index=False):
            if size >= _BATCH and row.h != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append((row.h, row.ch, row.n, row.data))
            size += len(row.data)
    if held:
        yield flush()


def _strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_128_digest
    for frame in frames:
        for part in _portions([len(data) * 16 for data in frame["data"]]):
            piece = frame.iloc[part]
            rows = [
                (h, c, n, j, digest(data[j : j + LENGTH]))
                for h, c, n, data in zip(piece["h"], piece["ch"], piece["n"], piece["data"])
                for j in range(len(data) - LENGTH + 1)
            ]
            yield pd.DataFrame(rows, columns=["h", "ch", "n", "j", "s"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last): sorted byte ranges [first, last) to remove, as two arrays, of the texts that have any.

    ``docs`` has doc_id, th (hash of text) and text; ranges of one text may overlap.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "runs")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    every = table(docs.mapInPandas(_runs, RUNS), "runs")
    common = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    matched = table(every.join(common, "h").select(*every.columns), "matched")
    rep = F.min(F.struct("doc_id", "th", "lo", "hi")).alias("rep")
    contexts = table(matched.groupBy("h", "ch").agg(F.count(F.lit(1)).alias("n"), rep), "contexts")
    kinds = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"))
    several = contexts.join(kinds.where("contexts > 1"), "h")
    asked = several.select(F.col("rep.doc_id").alias("_d"), F.col("rep.th").alias("_t"), "rep.lo", "rep.hi", "h", "ch", "n")
    lists = asked.groupBy("_d", "_t").agg(F.collect_list(F.struct("lo", "hi", "h", "ch", "n")).alias("asked"))
    packed = docs.select("doc_id", "th", F.pandas_udf(_packed, "binary")("text").alias("packed"))
    holders = packed.join(lists, same(packed, lists, [("doc_id", "_d"), ("th", "_t")]))
    holders = holders.select("packed", *[F.col("asked")[c].alias(c) for c in ("lo", "hi", "h", "ch", "n")])
    data = table(holders.mapInPandas(_contexts, CONTEXT), "data")
    hot = kinds.where(F.col("contexts") > HOT_CONTEXTS).select("h")
    ordinary = data.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "ch")
    found = ordinary.mapInPandas(_judge, FOUND)
    # The rest: suffixes of hot anchors, equal ones by hash.
    strings = data.join(hot, "h", "left_semi").mapInPandas(_strings, "h bigint, ch bigint, n bigint, j int, s binary")
    again = strings.groupBy("s").agg(F.sum("n").alias("times")).where("times > 1").select("s")
    places = strings.join(again, "s").groupBy("h", "ch").agg(F.sort_array(F.collect_set("j")).alias("froms"))
    found = found.unionByName(places.select("h", "ch", "froms", F.col("froms").alias("tos")))
    whole = contexts.join(kinds.where("contexts = 1"), "h").select(
        "h", "ch", F.array(F.lit(0)).alias("froms"), F.array(F.lit(None).cast("int")).alias("tos")
    )
    verdict = table(found.unionByName(whole), "verdict")
    hits = matched.join(verdict, ["h", "ch"]).select("doc_id", "th", "lo", "hi", F.explode(F.arrays_zip("froms", "tos")).alias("z"))
    first = F.col("lo") + F.col("z.froms")
    last = F.coalesce(F.col("lo") + F.col("z.tos"), F.col("hi")) + LENGTH
    spans = hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct(first.alias("a"), last.alias("b")))).alias("s"))
    return spans.select("doc_id", "th", F.col("s.a").alias("first"), F.col("s.b").alias("last"))


def _cut(packed: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    unpack, rows = zstandard.ZstdDecompressor().decompress, []
    for data, starts, ends in zip(packed, firsts, lasts):
        if data is None:
            rows.append((None, 0, 0, None))
            continue
        text, kept, at, removed, spans = unpack(data), [], 0, 0, 0
        for a, b in zip(starts, ends):
            if a > at or not spans:
                kept.append(text[at:a])
                removed += b - a
                spans += 1
                at = b
            elif b > at:
                removed += b - at
                at = b
        kept.append(text[at:])
        rest = b"".join(kept)
        rows.append((rest, removed, spans, hashlib.sha256(rest).hexdigest()))
    return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans", "kept_sha256"])


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (bytes).

    Null counts as empty; texts below LENGTH bytes are whole. Rows of equal doc_id and text are copies of
    each other like any two rows. What is kept may not be whole UTF-8: cuts are between bytes. No other
    column is looked at; an empty table gives no rows.
    """
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("th"), col(text).alias("text"))
    spans = repeated_spans(rows).toDF("_d", "_t", "first", "last")
    body = F.coalesce("text", F.lit(""))
    packed = rows.select(
        "doc_id",
        "th",
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.sha2(body, 256).alias("sha"),
        F.pandas_udf(_packed, "binary")("text").alias("packed"),
    )
    joined = packed.join(spans, same(packed, spans, [("doc_id", "_d"), ("th", "_t")]), "left")
    touched = F.when(F.col("first").isNotNull(), F.col("packed"))
    schema = "kept binary, n_removed bigint, n_spans bigint, kept_sha256 string"
    kept = ["packed"] if with_text else []
    cut = joined.select("doc_id", "n_bytes", "sha", *kept, F.pandas_udf(_cut, schema)(touched, "first", "last").alias("r"))
    out = cut.select(
        "doc_id",
        "n_bytes",
        F.coalesce("r.n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("r.n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("r.kept_sha256", "sha").alias("kept_sha256"),
        *[F.col(k) for k in kept],
        *([F.col("r.kept").alias("cut")] if with_text else []),
    )
    if not with_text:
        return out
    unpacked = F.pandas_udf(_unpacked, "binary")(F.when(F.col("cut").isNull(), F.col("packed")))
    return out.withColumn("kept", F.coalesce("cut", unpacked)).drop("cut", "packed")


def _unpacked(packed: pd.Series) -> pd.Series:
    unpack = zstandard.ZstdDecompressor().decompress
    return pd.Series([None if p is None else unpack(p) for p in packed], dtype=object)


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeated(docs, with_text=False)
