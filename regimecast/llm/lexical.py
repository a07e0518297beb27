"""Ranked lexical search of many items at once, sharing what the items have in common.

1. Index. One pass over the texts keeps, for every document, its number of terms and the counts of
   those that any item asks for. Document counts of the terms come from it.
2. Sharing. Terms that several items ask for are put together: the pair that most items of a block
   still share becomes a partial sum of its own, and stands for both in these items, again and again.
   Partial sums of partial sums make a graph that ends in the items.
3. Scores. Documents come in slices. Every partial sum is added up once for a slice, in the order of
   the graph, and all items that hang on it use it. Sums are whole numbers, so sharing changes no
   score. A task keeps the best documents of each item; the best of all tasks are taken in two steps.

Items come in batches of bounded size, each with one pass over the texts.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimecast.llm.common import alnum_words, col, tool
from regimecast.session import materialise

DEPTH = 50
#: Text of the items whose terms and graph are broadcast together.
BATCH_BYTES = 16 << 20
#: Items whose shared terms are mined together, and shared terms of one of them that are paired. Both
#: decide how much is shared, never a score.
BLOCK_ITEMS, PAIRED_TERMS = 256, 200
_SLICE = 4096

#: A block's graph: ``left`` and ``right`` are terms, or partial sums from the number of terms on.
PLAN = "block int, items array<int>, left array<int>, right array<int>, parts array<array<int>>"


def share(items: Sequence[Sequence[int]], first: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Partial sums, numbered from ``first``, as pairs of terms or earlier sums; and what each item adds up."""
    parts = [set(terms) for terms in items]
    asked = Counter(t for terms in parts for t in terms)
    holders: dict[int, set[int]] = defaultdict(set)
    together: Counter = Counter()
    for k, terms in enumerate(parts):
        common = sorted((t for t in terms if asked[t] > 1), key=lambda t: (-asked[t], t))[:PAIRED_TERMS]
        for t in common:
            holders[t].add(k)
        common.sort()
        together.update((a, b) for i, a in enumerate(common) for b in common[i + 1 :])
    queue = [(-n, pair) for pair, n in together.items() if n > 1]
    heapq.heapify(queue)
    sums: list[tuple[int, int]] = []
    while queue:
        n, (a, b) = heapq.heappop(queue)
        both = holders[a] & holders[b]
        if len(both) != -n:
            if len(both) > 1:
                heapq.heappush(queue, (-len(both), (a, b)))
            continue
        new = first + len(sums)
        sums.append((a, b))
        beside: Counter = Counter()
        for k in both:
            parts[k] -= {a, b}
            beside.update(t for t in parts[k] if t in holders and k in holders[t])
            parts[k].add(new)
        holders[a] -= both
        holders[b] -= both
        holders[new] = both
        for t, m in beside.items():
            if m > 1:
                heapq.heappush(queue, (-m, (t, new)))
    return sums, [sorted(p) for p in parts]


def _shared(first: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        sums, parts = share([list(t) for t in frame["terms"]], first)
        row = {
            "block": int(frame["block"].iloc[0]),
            "items": frame["item"].tolist(),
            "left": [a for a, _ in sums],
            "right": [b for _, b in sums],
            "parts": parts,
        }
        return pd.DataFrame([row])

    return run


class Scorer:
    """The best documents of every item of a batch, as slices of the index pass by."""

    def __init__(self, plans: list, weights: np.ndarray, documents: int, length: int, depth: int) -> None:
        self.plans, self.weights, self.depth = plans, weights, depth
        self.documents, self.length = documents, length
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, lens: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Documents by id (``nulls``: without one), number of terms, and their entries one after another."""
        m = 50 + (50 * sizes * self.documents) // self.length
        at = np.repeat(np.arange(len(ids)), lens)
        gain = self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[at]))
        order = np.argsort(terms, kind="stable")
        found, starts = np.unique(terms[order], return_index=True)
        where = np.split(at[order], starts[1:])
        what = np.split(gain[order], starts[1:])
        held = dict(zip(found.tolist(), zip(where, what)))
        for items, sums, parts in self.plans:
            partial: dict[int, np.ndarray] = {}
            for number, pair in sums:
                total = self._total(pair, held, partial, len(ids))
                if total is not None:
                    partial[number] = total
            for item, own in zip(items, parts):
                total = self._total(own, held, partial, len(ids))
                if total is not None:
                    self._keep(item, total, ids, nulls)

    @staticmethod
    def _total(parts: Sequence[int], held: dict, partial: dict, n: int) -> np.ndarray | None:
        total = None
        for p in parts:
            known = partial.get(p)
            entries = held.get(p) if known is None else None
            if known is None and entries is None:
                continue
            if total is None:
                total = np.zeros(n, np.int64)
            if known is not None:
                total += known
            else:
                total[entries[0]] += entries[1]
        return total

    def _keep(self, item: int, total: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        before = self.best.get(item)
        least = int(before[0][-1]) if before is not None and len(before[0]) == self.depth else 1
        at = np.flatnonzero(total >= least)
        if not len(at):
            return
        scores, own, none = total[at], ids[at], nulls[at]
        if before is not None:
            scores, own, none = (np.concatenate(pair) for pair in zip(before, (scores, own, none)))
        if len(scores) > 8 * self.depth:  # only what can still be among the best is sorted
            cut = np.partition(scores, len(scores) - self.depth)[len(scores) - self.depth]
            good = scores >= cut
            scores, own, none = scores[good], own[good], none[good]
        order = np.lexsort((own, none, -scores))[: self.depth]
        self.best[item] = (scores[order], own[order], none[order])


def _indexer(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool(("terms",), tuple)
        known = vocabulary.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                own = Counter(words)
                hits = sorted(known[w] for w in own.keys() & known.keys())
                sizes.append(len(words))
                terms.append(hits)
                names = known[_NAMES]
                counts.append([own[names[h]] for h in hits])
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])

    return run


_NAMES = None  # the entry of a vocabulary under which its terms stand by number


def index(docs: DataFrame, vocabulary: Sequence[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its number of terms, and those of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast({**{w: k for k, w in enumerate(vocabulary)}, _NAMES: list(vocabulary)})
    schema = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
    return materialise(docs.mapInArrow(_indexer(held), schema).where("n > 0"))


def _ranker(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, weights, documents, length, depth = held.value
        scorer = Scorer(plans, weights, documents, length, depth)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                terms, counts = batch.column("terms"), batch.column("counts")
                ids = batch.column("doc_id")
                scorer.add(
                    pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False),
                    ids.is_null().to_numpy(zero_copy_only=False),
                    batch.column("n").to_numpy(zero_copy_only=False),
                    pc.list_value_length(terms).to_numpy(zero_copy_only=False),
                    terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                )
        for item, (scores, ids, nulls) in scorer.best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return run


def weights_of(documents: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight from the number of documents, and of those that hold it."""
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * holding + 1))).astype(np.int64)


def item_batches(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, set[bytes]]]]:
    """Items with their terms, in batches of bounded text. Rows of one id are one item; without id or terms there is none."""
    rows = items.select(col(item_id).alias("i"), col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    batch, size = [], 0
    for i, t in rows.distinct().orderBy("i", "t").toLocalIterator():
        terms = set(alnum_words(t))
        if not terms:
            continue
        if batch and batch[-1][0] == i:
            batch[-1][1].update(terms)
        else:
            if size > BATCH_BYTES:
                yield batch
                batch, size = [], 0
            batch.append((i, terms))
        size += len(t.encode("utf-8", "surrogatepass"))
    if batch:
        yield batch


def _batch(docs: DataFrame, batch: list, depth: int, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*[terms for _, terms in batch]))
    number = {w: k for k, w in enumerate(vocabulary)}
    entries = index(docs, vocabulary)
    documents, length = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for t, n in entries.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the vocabulary at most
        holding[t] = n
    rows = [(k // BLOCK_ITEMS, k, sorted(number[w] for w in terms)) for k, (_, terms) in enumerate(batch)]
    asked = spark.createDataFrame(rows, "block int, item int, terms array<int>")
    first = len(vocabulary)
    mined = asked.groupBy("block").applyInPandas(_shared(first), PLAN).orderBy("block").collect()
    plans = [(r["items"], [(first + k, pair) for k, pair in enumerate(zip(r["left"], r["right"]))], r["parts"]) for r in mined]
    held = spark.sparkContext.broadcast((plans, weights_of(documents, holding), documents, length, depth))
    found = entries.mapInArrow(_ranker(held), "item int, doc_id bigint, score bigint")
    # The lists of all tasks are merged in groups first, so that no item's window grows with the number of tasks.
    parts = entries.rdd.getNumPartitions()
    groups = max(1, round(parts**0.5))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.row_number().over(Window.partitionBy("item", "_group").orderBy(*order))
    best = found.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups))).withColumn("_place", place)
    best = best.where(F.col("_place") <= depth)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(batch)], f"item int, item_id {id_type}")
    # One name for each item of a bounded batch.
    return ranked.where(F.col("rank") <= depth).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    depth: int = DEPTH,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``depth`` best documents of every item, those of score above 0.

    Equal scores are ranked by ascending doc_id, nulls last. Every row of ``docs`` is a document, so
    repeated rows have ranks of their own. Null and empty texts and texts without terms are no documents
    and match nothing. Items of null id or without terms have no rows; rows of one item id are one item.
    Without documents or items the result is empty. Other columns are not looked at.
    """
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    id_type = items.schema[item_id].dataType.simpleString()
    out = None
    for batch in item_batches(items, item_id, item_text):
        found = _batch(rows, batch, depth, id_type)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    return out


def op12_lexical_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of every benchmark item; edge cases as in ``search``."""
    return search(docs, benchmark)


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ws, len(ws)::BIGINT AS n FROM w WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, docs),
g AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS gain FROM t JOIN d USING (r) JOIN f USING (term), s),
x AS (SELECT item_id, r, sum(gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY item_id, r),
y AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50
"""
