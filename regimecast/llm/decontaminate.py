"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all test items (ten words each, or the whole item if it is shorter) are the patterns
of one automaton over normalised words. Every text runs through it once, as a sequence of word
numbers; the place of a match in that sequence is mapped back to words and characters of the
original text.

The automaton is bounded: it holds items of at most ``BLOCK_BYTES`` of text. A benchmark larger
than that is searched block by block, one pass over the texts each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimecast.llm.common import alnum_words, col, tool, with_fields
from regimecast.session import materialise

WINDOW = 10
BLOCK_BYTES = 4 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class Automaton:
    """Windows of (item id, text) pairs over numbered words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.items = [i for i, _ in items]
        for place, (_, text) in enumerate(items):
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]
            size = min(window, len(words))
            if size:
                for key in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}:
                    owners.setdefault(key, []).append(place)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in owners.items():
            self.machine.add_word(key, (len(key), places))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Maximal runs [first, after last) of hit words, and the ids of the items found."""
        if self.empty or not words:
            return [], []
        get = self.numbers.get
        coded = tuple([get(w, 0) for w in words])
        spans, found = [], set()
        if any(coded):
            for end, (size, places) in self.machine.iter(coded):
                spans.append((end + 1 - size, end + 1))
                found.update(places)
        return merged(spans), [self.items[p] for p in found]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as character ranges of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size, in the order of their ids as strings."""
    items = benchmark.select(col(item_id).cast("string").alias("i"), col(text).alias("t"))
    items = items.where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    block, held = [], 0
    for i, t in items.orderBy("i", "t").toLocalIterator():
        n = len(t.encode("utf-8", "surrogatepass"))
        if block and held + n > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((i, t))
        held += n
    yield block


def _automaton(held) -> Automaton:
    """The automaton of a broadcast block, built once by each worker."""
    return tool(("automaton", hash(tuple(held.value))), lambda: Automaton(held.value))


RESULT = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _scanner(block):
    """``earlier``: spans and items found with the blocks before this one."""

    def run(texts: pd.Series, *earlier: pd.Series) -> pd.DataFrame:
        machine = _automaton(block)
        sizes, runs, ids = [], [], []
        for k, text in enumerate(texts):
            words = alnum_words(text)
            spans, items = machine.scan(words)
            if earlier:
                spans = merged(spans + [(s["first"], s["last"]) for s in earlier[0].iloc[k]])
                items = {*items, *earlier[1].iloc[k]}
            sizes.append(len(words))
            runs.append([{"first": a, "last": b} for a, b in spans])
            ids.append(sorted(items))
        return pd.DataFrame({"n_words": sizes, "spans": runs, "items": ids})

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    names: Sequence[str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """Add the number of words, the runs of hit words (first, last exclusive) and the ids found, as sorted strings.

    Columns of these names are replaced. A null or empty text has no words; an item that is null,
    has no word or no id is never found; an item given twice counts once. Without items nothing is hit.
    """
    context = docs.sparkSession.sparkContext
    out, earlier = docs, []
    for block in item_blocks(benchmark, item_id, item_text):
        if earlier:
            out = materialise(out)  # one automaton at a time in a worker
        scan = F.pandas_udf(_scanner(context.broadcast(block)), RESULT)
        out = with_fields(out, scan(col(text), *earlier), ["n_words", "spans", "items"], names)
        earlier = [col(names[1]), col(names[2])]
    return out


def cut(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace the text by the text without its hit runs, using the offsets in the original."""

    def run(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, runs):
            if t is not None and r is not None:
                for a, b in reversed(char_spans(t, [(s["first"], s["last"]) for s in r])):
                    t = t[:a] + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, F.pandas_udf(run, "string")(col(text), col(spans)))


def op2_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, len(ws)::BIGINT AS n, ws, unnest(range(1, greatest(len(ws) - 10, 0)::BIGINT + 2)) AS i FROM b WHERE len(ws) > 0),
patterns AS (SELECT DISTINCT item_id, least(n, 10) AS size, array_to_string(ws[i:i + least(n, 10) - 1], ' ') AS p FROM bw),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (SELECT doc_id, size, ws, unnest(range(1, len(ws)::BIGINT - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size),
hits AS (SELECT doc_id, i, h.size, item_id FROM (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS p FROM places) h JOIN patterns USING (size, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""
