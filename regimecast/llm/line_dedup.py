"""Repeated passages of lines, found by content-defined chunks.

The lines of a text are hashed, and a rolling hash over the last two line hashes decides where a
chunk of at least two lines ends. Boundaries depend on the lines around them only, so the same
passage is cut alike wherever it stands. Chunks whose hash occurs more than once are compared byte
by byte with the first one (smallest doc_id, text hash, place) and removed if they are equal; the
first one stays.

``remove_runs``, which the query and the pipeline use, loses no run of two or more lines. Its chunks are cut by the
same rolling hash of two lines, but without a least length, so a cut depends on no line outside the two. Chunks of
equal hash are compared byte by byte. What chunks cannot find, matches that reach beyond the cuts and runs between
them, is found line by line: by all pairs of neighbouring lines outside the copied chunks, which are again
compared by their bytes with the first of equal hash. Lines of the first occurrence of a repeated pair stay,
whatever else repeats them, so every repeated pair of the input still stands in the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import col, fresh, marked, same, tool
from regimecast.session import Tables, materialise

MIN_LINES, MEAN_LINES = 2, 2
#: Mean length of the chunks of ``remove_runs``; it decides the cost only, never the result.
CHUNK_LINES = 4
_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first line, after the last line, bytes) of all chunks, in order; they cover the text."""
    if text is None:
        return []
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out, start, before = [], 0, 0
    for i, line in enumerate(lines):
        now = xxhash.xxh64_intdigest(line)
        rolled = (now * _FACTOR + before) & _MASK
        before = now
        if i + 1 - start >= MIN_LINES and (rolled >> 40) % MEAN_LINES == 0:
            out.append((start, i + 1, b"\n".join(lines[start : i + 1])))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines), b"\n".join(lines[start:])))
    return out


def _wanted(text: str | None) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the chunks that may be removed: several lines, not blank."""
    for place, (first, last, data) in enumerate(chunks(text)):
        if last - first >= MIN_LINES and data.strip():
            yield place, data


def pairs_of_lines(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(first line, after the last line, bytes) of every two neighbouring lines that are not blank, with the blank ones between."""
    lines = [] if text is None else text.encode("utf-8", "surrogatepass").split(b"\n")
    before = None
    for i, line in enumerate(lines):
        if line.strip():
            if before is not None:
                yield before, i + 1, b"\n".join(lines[before : i + 1])
            before = i


def pieces(text: str | None) -> Iterator[tuple[int, int, bool, bytes]]:
    """(chunk, first line, whether a whole chunk, bytes) of all pairs of neighbouring lines and all chunks of three lines or more.

    Lines that are not blank are counted. A pair that lies in no such chunk has chunk -1.
    """
    found = list(pairs_of_lines(text))
    if not found:
        return
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    starts, before = [0], xxhash.xxh64_intdigest(lines[found[0][0]])
    for at, (_, end, _) in enumerate(found, 1):
        now = xxhash.xxh64_intdigest(lines[end - 1])
        if (((now * _FACTOR + before) & _MASK) >> 40) % CHUNK_LINES == 0:
            starts.append(at + 1)
        before = now
    # Line ``at`` (of those not blank) is the first of pair ``at``; the last pair of a chunk leads out of it.
    for chunk, (start, after) in enumerate(zip(starts, [*starts[1:], len(found) + 1])):
        long = after - start >= 3
        if long:
            first, end = found[start][0], found[after - 2][1]
            yield chunk, first, True, b"\n".join(lines[first:end])
        for at in range(start, min(after, len(found))):
            yield chunk if long and at < after - 1 else -1, found[at][0], False, found[at][2]


_KEY = "doc_id bigint, th bigint"


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tool(("lines",), tuple)
    for frame in frames:
        rows = [
            (d, t, place, xxhash.xxh3_64_intdigest(data) - (1 << 63))
            for d, t, text in zip(frame["doc_id"].astype("Int64"), frame["th"], frame["text"])
            for place, data in _wanted(text)
        ]
        out = pd.DataFrame(rows, columns=["doc_id", "th", "place", "h"])
        yield out.astype({"doc_id": "Int64", "th": "int64", "place": "int32", "h": "int64"})


def _hashed_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tool(("lines",), tuple)
    for frame in frames:
        rows = [
            (d, t, chunk, first, whole, xxhash.xxh3_128_digest(data))
            for d, t, text in zip(frame["doc_id"].astype("Int64"), frame["th"], frame["text"])
            for chunk, first, whole, data in pieces(text)
        ]
        out = pd.DataFrame(rows, columns=["doc_id", "th", "chunk", "place", "whole", "h"])
        yield out.astype({"doc_id": "Int64", "th": "int64", "chunk": "int32", "place": "int32", "whole": "bool"})


def _bytes_of(whole_chunks: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, t, text, places in zip(frame["doc_id"].astype("Int64"), frame["th"], frame["text"], frame["places"]):
                asked = set(places)
                rows += [(d, t, first, data) for _, first, whole, data in pieces(text) if whole == whole_chunks and first in asked]
            out = pd.DataFrame(rows, columns=["doc_id", "th", "place", "data"])
            yield out.astype({"doc_id": "Int64", "th": "int64", "place": "int32"})

    return run


def _bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for d, t, text, places in zip(frame["doc_id"].astype("Int64"), frame["th"], frame["text"], frame["places"]):
            asked = set(places)
            rows += [(d, t, place, data) for place, data in _wanted(text) if place in asked]
        out = pd.DataFrame(rows, columns=["doc_id", "th", "place", "data"])
        yield out.astype({"doc_id": "Int64", "th": "int64", "place": "int32"})


def _places(rows: DataFrame) -> DataFrame:
    """Places per document; a document has at most as many as it has chunks."""
    return rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _attach(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "places")
    return docs.join(lists, same(docs, lists, [("doc_id", "_d"), ("th", "_t")]), how).drop("_d", "_t")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, places): the places of the chunks to remove. ``docs`` has doc_id, th (hash of text) and text."""
    found = materialise(docs.mapInPandas(_hashes, f"{_KEY}, place int, h bigint"))
    me = F.struct("doc_id", "th", "place")
    repeated = found.groupBy("h").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first <> last")
    pairs = materialise(found.join(repeated.drop("last"), "h").select(*found.columns, "first"))
    # Bytes of every chunk whose hash is repeated, fetched from the texts that hold one.
    data = _attach(docs, _places(pairs), "inner").mapInPandas(_bytes, f"{_KEY}, place int, data binary")
    cells = ["doc_id", "th", "place"]
    data = data.toDF("_d", "_t", "_p", "data")
    with_data = pairs.join(data, same(pairs, data, list(zip(cells, ["_d", "_t", "_p"]))))
    held = materialise(with_data.select("h", *cells, "first", "data"))
    originals = held.where(F.struct(*cells) == F.col("first")).groupBy("h").agg(F.first("data").alias("original"))
    equal = held.join(originals, "h").where((F.col("data") == F.col("original")) & (F.struct(*cells) != F.col("first")))
    return _places(equal)


def _equal(held: DataFrame, docs: DataFrame, whole: bool) -> DataFrame:
    """The rows of ``held`` whose bytes equal those of ``first``, the first piece of the same hash h."""
    lists = _places(held)
    some = docs.where(marked(docs, lists)("th")).dropDuplicates(["doc_id", "th"])
    data = _attach(some, lists, "inner").mapInPandas(_bytes_of(whole), f"{_KEY}, place int, data binary")
    cells = ["doc_id", "th", "place"]
    data = data.toDF("_d", "_t", "_p", "data")
    # Keys that repeat make a small file of many rows, by whose size Spark would broadcast them.
    held = held.join(data.hint("merge"), same(held, data, list(zip(cells, ["_d", "_t", "_p"])))).drop("_d", "_t", "_p")
    held = materialise(held)
    originals = held.where(F.struct(*cells) == F.col("first")).groupBy("h").agg(F.first("data").alias("original"))
    return held.join(originals, "h").where(F.col("data") == F.col("original")).drop("data", "original")


def run_removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, places): the first lines of the pairs of lines to remove, and as -1 - line those of the pairs to keep.

    A repeated pair is kept where it stands first, by doc_id, hash of text and place. Texts that lose nothing are left out.
    """
    tables = Tables(docs.sparkSession, "lines")
    found = docs.mapInPandas(_hashed_pieces, f"{_KEY}, chunk int, place int, whole boolean, h binary")
    found = tables.write("pieces", found)
    me = F.struct("doc_id", "th", "place")
    ends = [F.min(me).alias("first"), F.max(me).alias("last")]
    chunks_ = found.where("whole").select("doc_id", "th", "chunk", "place", "h")
    repeated = chunks_.groupBy("h").agg(*ends).where("first <> last").drop("last")
    held = tables.write("held-chunks", chunks_.join(repeated, "h"))
    copied = _equal(held, docs, True).select("doc_id", "th", "chunk", (me != F.col("first")).alias("copy")).distinct()
    copied = tables.write("copied", copied.toDF("_d", "_t", "_c", "copy"))
    pairs = found.where("NOT whole").drop("whole")
    # Only pairs of chunks in texts that hold a copied one are looked up.
    pairs = pairs.withColumn("_maybe", (F.col("chunk") >= 0) & marked(docs, copied.select(F.col("_t").alias("th")))("th"))
    asked, rest = pairs.where("_maybe"), pairs.where("NOT _maybe").select("doc_id", "th", "place", "h", F.lit(None).cast("boolean").alias("copy"))
    asked = asked.join(copied, same(asked, copied, [("doc_id", "_d"), ("th", "_t"), ("chunk", "_c")]), "left")
    pairs = asked.select("doc_id", "th", "place", "h", "copy").unionByName(rest)
    # The pairs in a copied chunk are repeated and stand first elsewhere; of the others, those of its original are repeated.
    in_copies = pairs.where("copy").select("doc_id", "th", "place", F.lit(True).alias("again"))
    others = pairs.where("copy IS NULL OR NOT copy").withColumn("known", F.col("copy").isNotNull()).select("doc_id", "th", "place", "h", "known")
    repeated = others.groupBy("h").agg(*ends, F.max("known").alias("known")).where("first <> last OR known")
    held = tables.write("held-pairs", others.drop("known").join(repeated.drop("known"), "h"))
    several = _equal(held.where("first <> last").drop("last"), docs, False)
    marks = several.select("doc_id", "th", "place", (me != F.col("first")).alias("again"))
    alone = held.where("first = last").select("doc_id", "th", "place", F.lit(False).alias("again"))
    marks = in_copies.unionByName(marks).unionByName(alone)
    asked = F.when(F.col("again"), F.col("place")).otherwise(-1 - F.col("place"))
    lists = marks.groupBy("doc_id", "th").agg(F.max("again").alias("loses"), F.collect_set(asked).alias("places"))
    lists = materialise(lists.where("loses").select("doc_id", "th", F.sort_array("places").alias("places")))
    tables.drop("pieces", "held-chunks", "copied", "held-pairs")
    return lists


def remove_repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """The frame with repeated chunks cut out of ``text``, plus the lines of the input and of them the removed ones.

    Columns of these two names are replaced, all others kept as they are. Rows with equal
    doc_id and text are one document: none is a repeat of the other, and both get the same result. A null text stays
    null with 0 lines; a text that is wholly repeated becomes empty. Single lines and blank chunks are
    never removed. A hash that different chunks share removes only chunks equal to the first.
    """
    return _cut(docs, doc_id, text, names, removals, _rebuilt)


def remove_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """Like ``remove_repeated``, but every run of two or more lines goes that stands earlier, in a text or in this one.

    Lines that also belong to a pair of neighbouring lines which stands here first and again later stay: nothing
    is cut out of the first occurrence of a repeated pair, so each remains whole in some text. Lines repeated alone
    stay, and so do blank lines at the end of a run.
    """
    return _cut(docs, doc_id, text, names, run_removals, _without_pairs)


def _cut(docs: DataFrame, doc_id: str, text: str, names: tuple[str, str], find, rebuilt) -> DataFrame:
    keyed = docs.select(
        col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("th"), col(text).alias("text")
    )
    found = materialise(find(keyed))
    d, t, p, r, h, m = (fresh(docs, name) for name in ("_doc", "_hash", "_places", "_result", "_text_hash", "_maybe"))
    lists = found.toDF(d, t, p)
    # A text that loses nothing stays where it is; only the others are shuffled and travel to Python.
    hashed = docs.withColumn(h, F.xxhash64(col(text)))
    hashed = hashed.withColumn(m, marked(docs, found)(F.col(h)))
    asked = hashed.where(F.col(m))
    match = asked[f"`{doc_id}`"].cast("bigint").eqNullSafe(lists[d]) & asked[h].eqNullSafe(lists[t])
    joined = asked.join(lists, match, "left")
    result = F.pandas_udf(rebuilt, "text string, n_removed bigint")(F.when(F.col(p).isNotNull(), col(text)), F.col(p))
    cut = joined.select(*[col(c) for c in docs.columns], result.alias(r))
    rest = hashed.where(~F.col(m)).select(*[col(c) for c in docs.columns], F.lit(None).cast("struct<text string, n_removed bigint>").alias(r))
    joined = rest.unionByName(cut)
    lines = F.length(col(text)) - F.length(F.replace(col(text), F.lit("\n"))) + 1
    counts = [n.lower() for n in names]
    return joined.select(
        *[
            F.coalesce(F.col(r)["text"], col(c)).alias(c) if c == text else col(c)
            for c in docs.columns
            if c.lower() not in counts
        ],
        F.coalesce(lines, F.lit(0)).cast("bigint").alias(names[0]),
        F.coalesce(F.col(r)["n_removed"], F.lit(0)).alias(names[1]),
    )


def _rebuilt(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    rows = []
    for text, cut in zip(texts, places):
        if text is None:
            rows.append((None, 0))
            continue
        gone = set(cut)
        kept, removed = [], 0
        for place, (first, last, data) in enumerate(chunks(text)):
            if place in gone:
                removed += last - first
            else:
                kept.append(data)
        rows.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), removed))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def _without_pairs(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    rows = []
    for text, cut in zip(texts, places):
        if text is None:
            rows.append((None, 0))
            continue
        asked, gone, kept_lines = set(cut), set(), set()
        for first, end, _ in pairs_of_lines(text):
            if first in asked:
                gone.update(range(first, end))
            elif -1 - first in asked:
                kept_lines.update(range(first, end))
        gone -= kept_lines
        kept = [line for i, line in enumerate(text.split("\n")) if i not in gone]
        rows.append(("\n".join(kept), len(gone)))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, the lines of every text, those removed by ``remove_runs``, and the hash of what is kept; null counts as empty."""
    out = remove_runs(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
