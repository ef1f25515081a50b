"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded number of documents of one task. Its words become symbols:
a word of the benchmark gets its number, any other word can be part of no
occurrence and only separates. The stretches of benchmark words of the shard are
sorted by suffix, their Burrows-Wheeler transform goes into a wavelet matrix, and
every window of the benchmark is searched backwards, all windows at once. Each
row of a found interval walks back to the next sampled suffix, which gives its
place. The places, as spans of words, are merged per document.

The benchmark goes out in blocks of a bounded number of items. Each block is one
more pass over the rows, which carry what the blocks before have found, so
neither the driver nor a task ever holds the whole benchmark.

Defined results: a null or empty text, or one without words, has no words, no hits
and no items. An item without words, with a null text or with a null id is no
phrase. Repeated items count once by id. Repeated document rows are judged each.
Columns of any name may be carried along: they are put aside under other names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, renamed

WINDOW_WORDS = 13
SHARD_WORDS = 300_000
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000
SAMPLE_EVERY = 8
#: A document is contaminated when this many times its hit words reach its words.
HIT_FACTOR = 20

#: Bytes of a UTF-8 text: A-Z lower-cased, ASCII that belongs to no word as a space.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_FOLD).split()


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit plane per bit of a symbol, for many queries at once."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            plane = (sequence >> bit) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(plane, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate((sequence[plane == 0], sequence[plane == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(places), places.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbols >> bit) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbols, low, at = np.zeros_like(places), np.zeros_like(places), places.copy()
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            at_ones, low_ones = ones[at], ones[low]
            one = ones[at + 1] > at_ones
            symbols = symbols * 2 + one
            at = np.where(one, zeros + at_ones, at - at_ones)
            low = np.where(one, zeros + low_ones, low - low_ones)
        return symbols, at - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the compared length; each separator (0) ranks by its place, so no two are equal."""
    breaks = symbols == 0
    n, step = len(symbols), 1
    rank = symbols.astype(np.int64) + int(breaks.sum())
    rank[breaks] = np.arange(int(breaks.sum()))
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if dense[order[-1]] == n - 1:
            return order
        rank = dense * (n + 1)
        rank[:-step] += dense[step:] + 1
        step *= 2


class FMIndex:
    """Backward search and location over a sequence of symbols that ends with a separator (0)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample_every: int = SAMPLE_EVERY):
        order = suffix_order(symbols)
        last = symbols[order - 1]  # order 0 takes the closing separator
        self.tree = WaveletMatrix(last.astype(np.int64), max(1, int(n_symbols - 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols))))
        # A walk ends at a sampled place; the start of a stretch is always sampled, as no walk may pass a separator.
        self.sampled = (order % sample_every == 0) | (last == 0)
        self.places = order[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each phrase; ``phrases`` holds the words right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sample_at), np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            symbols = phrases[live, -step]
            low[live] = self.before[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.tree.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, steps = np.full(len(rows), -1, np.int64), 0
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            found[open_[done]] = self.places[self.sample_at[rows[done]]] + steps
            rows, open_ = rows[~done], open_[~done]
            if len(rows):
                symbols, seen = self.tree.access(rows)
                rows = self.before[symbols] + seen
            steps += 1
        return found


class Phrases:
    """The windows of a block of items: symbols of their words, and which items each window belongs to."""

    def __init__(self, items: list[tuple], window: int):
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            own = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
            width = min(window, len(own))
            for start in range(len(own) - width + 1 if own else 0):
                owners.setdefault(tuple(own[start:start + width]), set()).add(item_id)
        self.numbers, self.windows = numbers, list(owners)
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.table = np.zeros((len(self.windows), window), np.int64)
        for row, symbols in enumerate(self.windows):
            self.table[row, window - len(symbols):] = symbols
        self.owners = [sorted(s) for s in owners.values()]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def find(self, documents: list[list[bytes]]) -> list[tuple[np.ndarray, list[int]]]:
        """Per document of a shard: its merged spans (start, stop) of words, and the items found in it."""
        ends = np.cumsum([len(d) for d in documents])
        total = int(ends[-1]) if len(ends) else 0
        nothing = [(np.zeros((0, 2), np.int64), [])] * len(documents)
        if not total or not self.windows:
            return nothing
        get = self.numbers.get
        symbols = np.fromiter((get(w, 0) for d in documents for w in d), np.int64, total)
        sequence, source = self._stretches(symbols, ends)
        if not len(sequence):
            return nothing
        index = FMIndex(sequence, len(self.numbers) + 1)
        low, high = index.search(self.table, self.lengths)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        starts = source[index.locate(rows)]
        return self._merged(documents, ends, starts, which)

    def _stretches(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of benchmark words inside one document that are long enough for a window, each followed by a separator."""
        edge = np.zeros(len(symbols) + 1, bool)
        edge[0] = True
        edge[ends] = True
        known = symbols > 0
        begins = known & (edge[:-1] | np.concatenate(([True], ~known[:-1])))
        stops = known & (edge[1:] | np.concatenate((~known[1:], [True])))
        begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long = stop - begin >= self.shortest
        begin, stop = begin[long], stop[long]
        sizes = stop - begin + 1
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        source = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
        sequence = symbols[np.minimum(source, len(symbols) - 1)].copy()
        sequence[np.cumsum(sizes) - 1] = 0
        return sequence, source

    def _merged(self, documents: list, ends: np.ndarray, starts: np.ndarray, which: np.ndarray) -> list[tuple[np.ndarray, list[int]]]:
        order = np.argsort(starts, kind="stable")
        starts, which = starts[order], which[order]
        stops = starts + self.lengths[which]
        owner = np.searchsorted(ends, starts, side="right")
        bounds = np.searchsorted(owner, np.arange(len(documents) + 1))
        result = []
        for number in range(len(documents)):
            a, b = bounds[number], bounds[number + 1]
            offset = int(ends[number]) - len(documents[number])
            items = {item for w in np.unique(which[a:b]) for item in self.owners[w]}
            result.append((merge_spans(np.stack((starts[a:b], stops[a:b]), 1) - offset), sorted(items)))
        return result


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch, made one; ``spans`` are (start, stop)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[first, 0], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(spans) - 1]))]), 1)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_items: int, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark's phrases in blocks that fit the driver, however many there are."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-(size["chars"] or 0) // block_chars))
    for number in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number) if n_blocks > 1 else items
        yield sorted((r["item_id"], r["text"]) for r in part.collect())


def _shards(rows: Iterator[tuple], at: int, shard_words: int) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    held, split, total = [], [], 0
    for row in rows:
        held.append(row)
        split.append(words(row[at]))
        total += len(split[-1])
        if total >= shard_words:
            yield held, split
            held, split, total = [], [], 0
    if held:
        yield held, split


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row of ``docs``, its columns as c0, c1 ..., with ``n_words``, ``spans`` (hit words as merged, flat start, stop
    pairs), ``items`` (sorted ids of the items with an occurring window), ``n_hit`` and ``contaminated``.

    ``batches.renamed`` gives the columns their names back.
    """
    width, at = len(docs.columns), docs.columns.index(text)
    kind = benchmark.schema[item_id].dataType.simpleString()
    frame = docs.select("*", F.lit(0).cast("bigint"), F.array().cast("array<bigint>"), F.array().cast(f"array<{kind}>"))
    for block in blocks_of(benchmark, item_id, item_text, block_items, block_chars):
        def run(part, block=block):
            phrases = Phrases(block, window)
            for held, split in _shards(part, at, shard_words):
                for row, own, (spans, items) in zip(held, split, phrases.find(split)):
                    *_, before, found = row
                    if len(spans) and before:
                        spans = merge_spans(np.concatenate((np.array(before, np.int64).reshape(-1, 2), spans)))
                    yield *row[:width], len(own), spans.ravel().tolist() if len(spans) else before, sorted({*found, *items})

        frame = _next(frame, width, run, kind)
    hits = F.when(F.size("spans") > 0, n_hit()).otherwise(F.lit(0).cast("bigint"))
    return frame.withColumn("n_hit", hits).withColumn("contaminated", contaminated())


def _next(frame: DataFrame, width: int, run, kind: str) -> DataFrame:
    plain = frame.toDF(*(f"c{i}" for i in range(width)), "n_words", "spans", "items")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema[:width])
    return map_rows(plain, run, f"{fields}n_words bigint, spans array<bigint>, items array<{kind}>")


def n_hit():
    """Hit words: the sum of the spans' lengths."""
    ends = F.transform("spans", lambda place, i: F.when(i % 2 == 1, place).otherwise(-place))
    return F.aggregate(ends, F.lit(0).cast("bigint"), lambda total, x: total + x)


def contaminated(factor: int = HIT_FACTOR):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * factor >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rule leaves."""
    found = find_overlap(docs, benchmark, **options)
    return renamed(found.filter(~F.col("contaminated")), docs.columns)
