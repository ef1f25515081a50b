"""Substring dedup by sliding sentence spans.

A text is cut into sentences at the ends of sentences and lines. A sentence that
runs on is cut further at places that its own words choose (the least hash in each
stretch of words), so a passage is cut alike wherever it stands. Where it begins or ends
inside a sentence, at most a stretch of its words falls to a piece of the host's, so any
50 shared words hold a whole run. Every shortest run of
several consecutive sentences that has enough words is hashed to 96 bits: the shortest from
each sentence on, and the shortest up to each sentence. Runs are joined over the whole table.
In order of the rows (by id) and places the first run of each hash stays and all others
are repeats. Every sentence that a repeat covers is removed.

Hashes that occur once are dropped by a count that combines before the shuffle, and a
row's text moves only if a repeat may cover part of it.

Defined results: null stays null and empty stays empty. A text too short for a
run is kept. Rows with equal ids, and rows without id, are told
apart by their text; fully repeated rows count once and give equal results. All other
columns stay as they are. Sentences are compared by their words with A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import extend_rows, map_rows, renamed
from .key_filter import likely, unlikely
from .scratch import Scratch

RUN_SENTENCES, RUN_WORDS = 3, 25
#: Pieces hold at most 12 words, so a run is never short of sentences where it has its words. Both sides of 50 shared words may lose 12.
LONG_WORDS, STRETCH_WORDS = 12, 12
SPAN_FILTER_BITS = 1 << 24

_END = re.compile(r"[.!?…。！？]+[\"')\]»”’]*\s+|\n\s*")
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
#: Of a run's 128 bits 96 are kept: 10^12 different runs then meet by chance with a probability of some 10^-5.
_DIGEST = np.dtype([("run", ">i8"), ("check", ">i4"), ("rest", ">i4")])


class _Hashes(dict):
    """Hash of each lower-cased word, computed once per task; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value

    def of(self, words: list[str]) -> list[int]:
        if len(self) > 50_000:
            self.clear()
        return list(map(self.__getitem__, words))


def lowered(text: str) -> str:
    return text.encode().translate(_LOWER).decode()


def _ends(text: str) -> list[int]:
    return [*(m.end() for m in _END.finditer(text)), len(text)]


def _firsts(words: list[str], hashes: _Hashes) -> list[int]:
    """Where the pieces of a long sentence begin: at its start and at the least hash of every stretch of words."""
    own = hashes.of(words)
    least = min(own[:STRETCH_WORDS])
    at = own.index(least)
    found = [0, at] if at else [0]
    for stop in range(STRETCH_WORDS, len(own)):
        value = own[stop]
        if value < least:
            least, at = value, stop
        elif at <= stop - STRETCH_WORDS:  # the least has left the stretch
            first = stop + 1 - STRETCH_WORDS
            part = own[first:stop + 1]
            least = min(part)
            at = first + part.index(least)
        else:
            continue
        found.append(at)
    return found


def said(low: str, hashes: _Hashes) -> list[list[str]]:
    """The words of each sentence of a lower-cased text."""
    found: list[list[str]] = []
    at = 0
    for stop in _ends(low):
        words = low[at:stop].split()
        if len(words) > LONG_WORDS:
            firsts = _firsts(words, hashes)
            found += [words[a:b] for a, b in zip(firsts, [*firsts[1:], len(words)])]
        elif words:
            found.append(words)
        at = stop
    return found


def sentences(text: str, hashes: _Hashes | None = None) -> list[tuple[int, int, int]]:
    """(start, stop, words) of the same sentences in the text; between them is white space only."""
    found, low, at = [], lowered(text), 0
    for words in said(low, _Hashes() if hashes is None else hashes):
        start = low.find(words[0], at)
        at = start + len(words[0])
        for word in words[1:]:
            at = low.find(word, at) + len(word)
        found.append((start, at, len(words)))
    return found


def shortest_runs(words: list[int], run: int, run_words: int) -> list[tuple[int, int]]:
    """(first, stop) of the shortest runs of at least ``run`` sentences and ``run_words`` words, from and up to each sentence."""
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    places = np.arange(len(words))
    stops = np.maximum(places + run, np.searchsorted(total, total[:-1] + run_words, side="left"))
    firsts = np.minimum(places + 1 - run, np.searchsorted(total, total[1:] - run_words, side="right") - 1)
    ahead, back = stops <= len(words), firsts >= 0
    width = len(words) + 1
    pairs = np.unique(np.concatenate((places[ahead] * width + stops[ahead], firsts[back] * width + places[back] + 1)))
    return list(zip((pairs // width).tolist(), (pairs % width).tolist()))


def run_hashes(text: str, run: int, run_words: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Hash (64 bits), check (32 more bits of it), first sentence and number of sentences of each run."""
    own = said(lowered(text), hashes)
    raw = b"".join([xxhash.xxh3_128_digest(" ".join(words).encode()) for words in own])
    found = shortest_runs([len(words) for words in own], run, run_words)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[16 * first:16 * stop]) for first, stop in found]), _DIGEST)
    return digests["run"].astype(np.int64), digests["check"].astype(np.int32), [first for first, _ in found], [stop - first for first, stop in found]


def without(text: str, covered: set[int], hashes: _Hashes | None = None) -> str:
    """The text without the sentences at these places; what stays keeps the white space before it."""
    kept, at = [], 0
    for place, (_, stop, _) in enumerate(sentences(text, hashes)):
        if place not in covered:
            kept.append(text[at:stop])
        at = stop
    return "".join(kept).strip()


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, row_key, runs): the runs of a row, as (first, size) of sentences, that are repeats."""
    def runs(part: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _Hashes()
        for own_id, key, value in part:
            found = run_hashes(value, run, run_words, hashes)
            if len(found[0]):
                yield own_id, key, *found

    scratch, kind = Scratch(docs.sparkSession), docs.schema[doc_id].dataType.simpleString()
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    each = map_rows(rows, runs, f"doc_id {kind}, row_key bigint, run array<bigint>, check array<int>, first array<int>, size array<int>")
    spans = scratch.keep(each.select("doc_id", "row_key", F.inline(F.arrays_zip("run", "check", "first", "size"))), "spans")
    several = scratch.keep(spans.groupBy("run").count().filter("count > 1").select("run"), "several")
    # An inner join, the hashes being distinct: Spark would move a semi join below the filter in front of it.
    again = scratch.keep(likely(spans, "run", several, SPAN_FILTER_BITS).join(several, "run"), "again")
    # The first row: least id, rows without one last, then least key; in it the least place. Plain minima combine before the shuffle.
    same = ["run", "check"]
    ids = again.groupBy(*same).agg(F.min("doc_id").alias("first_id"))
    leading = again.join(ids, same).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    keys = leading.groupBy(*same).agg(F.min("row_key").alias("first_key"))
    places = leading.join(keys, same).filter(F.col("row_key") == F.col("first_key")).groupBy(*same, "first_key").agg(F.min("first").alias("first_place"))
    later = again.join(places, same).filter((F.col("row_key") != F.col("first_key")) | (F.col("first") != F.col("first_place")))
    return scratch.result(later.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "size")).alias("runs")), "repeats")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN_SENTENCES, run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of ``docs`` with their text cut, columns in order, and behind them ``n_removed``, the number of sentences removed."""
    columns, at = docs.columns, docs.columns.index(text)
    found = repeats(docs, doc_id, text, run, run_words)
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    keyed = plain.withColumn("row_key", row_key(f"c{columns.index(doc_id)}", f"c{at}"))

    def cut(part: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _Hashes()
        for *row, own in part:
            covered = {place for x in own or () for place in range(x["first"], x["first"] + x["size"])}
            yield *row[:at], without(row[at], covered, hashes) if covered else row[at], *row[at + 1:], None, len(covered)

    own = found.select(F.col("doc_id").alias("own_id"), F.col("row_key").alias("own_key"), "runs")
    same = (F.col("row_key") == F.col("own_key")) & F.col(f"c{columns.index(doc_id)}").eqNullSafe(F.col("own_id"))
    maybe = likely(keyed, "row_key", found).join(own, same, "left").select(*plain.columns, "runs")
    whole = unlikely(keyed, "row_key", found).select(*plain.columns, F.lit(0).cast("bigint").alias("n_removed"))
    names = [F.col(f"c{i}").alias(name) for i, name in enumerate(columns)]
    return renamed(extend_rows(maybe, cut, "n_removed bigint"), columns, "n_removed").unionAll(whole.select(*names, "n_removed"))
