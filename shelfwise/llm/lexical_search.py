"""Ranked lexical search for many items at once, by shared partial sums.

A document's score for an item is a sum over the item's terms. Items share terms, so
sums over shared terms are computed once a document and used by all items that need them.

1. *Mining.* Terms that stand in just the same items, just as often in each, are one
   class; two aggregations over (item, term) find all classes. The terms that only one
   item has fall to one class as well.
2. *Sharing graph.* Each item is the list of its classes, those of many items first.
   The lists are put into one tree, so items with a common beginning share its nodes:
   a node's sum is its parent's sum and that of one class. An item's score is its last node's sum.
3. *Evaluation.* Documents are read once and kept as postings: the items' terms that they
   hold, and how often. From these come document frequencies and weights. Each task then takes
   batches of documents, adds their postings up by class, once each (the partial
   accumulators), and goes down the tree level by level.
   A task keeps the best ``k`` documents of each item; only those leave it.

All sums are 64-bit whole numbers, so their order does not matter and results are exact.
Items come in blocks of bounded size, each a pass over the documents; a batch has as many
documents as a bounded number of sums allows. Ranks are taken in two steps, so no task gets all candidates of an item.

Defined results: a document without text or terms counts nowhere and is never found.
Repeated rows are documents of their own; equal scores go by ascending doc_id, rows
without an id last. Items without id or terms take no part; equal item rows count
once, and an id with several texts is one item with the terms of all. An item that
finds nothing has no row. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows
from .scratch import Scratch

TOP = 10
#: Fixed values of the ranking function.
WEIGHT_SCALE, LENGTH_PERCENT, SATURATION = 1000, 75, 8
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 8_000_000
#: Partial sums that a task holds at a time.
SUMS = 2_000_000
SALTS = 32

#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space.
_TERMS = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_TERMS).split()


def item_blocks(items: DataFrame, item_id: str, text: str, block_items: int, block_chars: int) -> Iterator[list[tuple]]:
    """Different (id, text) rows in blocks that fit the driver, however many there are; all rows of an id are in one block."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars")).first()
    n_blocks = max(-(-size["n"] // block_items), -(-(size["chars"] or 0) // block_chars))
    for number in range(n_blocks):
        found = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number).distinct().collect()
        if found:
            yield [(r["item_id"], r["text"]) for r in found]


def term_classes(block: DataFrame) -> DataFrame:
    """(places, terms) of items (item, text): terms with equal places, an array of (item, times), are one class."""
    def count(part: Iterator[tuple]) -> Iterator[tuple]:
        for item, text in part:
            yield from ((item, term, times) for term, times in Counter(terms(text)).items())

    counted = map_rows(block.select("item", "text"), count, "item int, term binary, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))
    placed = counted.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("item", "times"))).alias("places"))
    return placed.groupBy("places").agg(F.array_sort(F.collect_list("term")).alias("terms"))


class Sharing:
    """The classes of a block's items, and the tree in which items share sums.

    ``term_class``: class of each term number; ``levels``: (nodes, parents, classes, times) by depth; ``leaf``: last node of each item.
    """

    def __init__(self, classes: list[tuple[list[tuple[int, int]], list[bytes]]], n_items: int):
        classes = sorted(classes, key=lambda c: (-len(c[0]), c[1][0]))  # those of many items come first
        self.vocabulary = {term: i for i, term in enumerate(term for _, own in classes for term in own)}
        self.term_class = np.array([c for c, (_, own) in enumerate(classes) for _ in own], np.int64)
        self.n_classes, self.n_nodes = len(classes), 1
        self.leaf = np.zeros(n_items, np.int64)
        known: dict[tuple[int, int, int], int] = {}
        depth, levels = [0], []
        for c, (places, _) in enumerate(classes):
            for item, times in places:
                step = (int(self.leaf[item]), c, times)
                node = known.get(step)
                if node is None:
                    node = known[step] = self.n_nodes
                    self.n_nodes += 1
                    depth.append(depth[step[0]] + 1)
                    if depth[node] > len(levels):
                        levels.append([])
                    levels[depth[node] - 1].append((node, *step))
                self.leaf[item] = node
        self.levels = [tuple(np.array(column, np.int64) for column in zip(*level)) for level in levels]

    def scores(self, rows: np.ndarray, numbers: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
        """Documents x items, from postings: document, term and the term's value in it."""
        partial = np.zeros((self.n_classes, n_docs), np.int64)
        np.add.at(partial, (self.term_class[numbers], rows), values)
        sums = np.zeros((self.n_nodes, n_docs), np.int64)
        for nodes, parents, classes, times in self.levels:
            sums[nodes] = sums[parents] + times[:, None] * partial[classes]
        return sums[self.leaf].T

    def docs_at_once(self, sums: int) -> int:
        return max(1, sums // max(1, self.n_nodes + self.n_classes + len(self.leaf)))


class Best:
    """The best ``k`` of each item among the documents seen: (-score, no id, id)."""

    def __init__(self, n_items: int, k: int):
        self.k, self.found, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def see(self, ids: list, scores: np.ndarray) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        scores = scores[order]
        enough = self.least
        if len(ids) > self.k:
            enough = np.maximum(enough, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        docs, items = np.nonzero(scores >= enough)
        held = scores[docs, items]
        ranked = np.lexsort((docs, -held, items))
        docs, items, held = docs[ranked], items[ranked], held[ranked]
        starts = np.searchsorted(items, items)
        first = np.arange(len(items)) - starts < self.k
        for doc, item, score in zip(docs[first].tolist(), items[first].tolist(), held[first].tolist()):
            own = ids[order[doc]]
            self.found[item].append((-score, own is None, own))
        for item in np.unique(items).tolist():
            best = self.found[item] = sorted(self.found[item], key=lambda f: (f[0], f[1], f[2] if f[2] is not None else 0))[:self.k]
            if len(best) == self.k:
                self.least[item] = -best[-1][0]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, numbers, times): number of terms, and which of the ``vocabulary`` stand in it how often; documents without terms are left out."""
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in part:
            own = terms(text)
            if own:
                held = Counter(number for number in map(vocabulary.get, own) if number is not None)
                yield doc_id, len(own), list(held), list(held.values())

    return map_rows(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, numbers array<int>, times array<bigint>")


def weighted(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(number, weight) from (number, df)."""
    return frequencies.select("number", F.floor(WEIGHT_SCALE * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint").alias("weight"))


def _best_of(held: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, item_ids: list, kind: str, k: int, sums: int) -> DataFrame:
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        best, at_once = Best(len(item_ids), k), sharing.docs_at_once(sums)
        for rows in _groups(part, at_once):
            length = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * row[1] * n_docs // n_terms for row in rows], np.int64)
            sizes = [len(row[2]) for row in rows]
            doc = np.repeat(np.arange(len(rows)), sizes)
            number = np.fromiter((x for row in rows for x in row[2]), np.int64, len(doc))
            times = np.fromiter((x for row in rows for x in row[3]), np.int64, len(doc))
            value = weights[number] * ((1_000_000_000 * times) // (1000 * times + SATURATION * length[doc]))
            best.see([row[0] for row in rows], sharing.scores(doc, number, value, len(rows)))
        for item_id, found in zip(item_ids, best.found):
            yield from ((item_id, own, -score) for score, _, own in found)

    return map_rows(held, run, f"item_id {kind}, doc_id {held.schema['doc_id'].dataType.simpleString()}, score bigint")


def _groups(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           k: int = TOP, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, sums: int = SUMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    for block in item_blocks(items, item_id, item_text, block_items, block_chars):
        item_ids = sorted({own for own, _ in block})
        number = {own: i for i, own in enumerate(item_ids)}
        listed = [(number[own], value) for own, value in block]
        classes = [([tuple(place) for place in row["places"]], [bytes(term) for term in row["terms"]]) for row in term_classes(spark.createDataFrame(listed, "item int, text string")).collect()]
        if not classes:
            continue
        sharing = Sharing(classes, len(item_ids))
        held = scratch.keep(postings(read, sharing.vocabulary), "postings")
        n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        counts = held.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
        weights = np.zeros(len(sharing.vocabulary), np.int64)
        for row in weighted(counts, n_docs).collect():  # one row per term of the block
            weights[row["number"]] = row["weight"]
        found.append(_best_of(held, sharing, weights, n_docs, n_terms, item_ids, kind, k, sums))
    if not found:
        found = [spark.createDataFrame([], f"item_id {kind}, doc_id {read.schema['doc_id'].dataType.simpleString()}, score bigint")]
    rows = functools.reduce(DataFrame.unionAll, found)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return scratch.result(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
