"""Byte-level BPE encoding and decoding of whole texts.

A text that fits one chunk is encoded where it is read. A longer text is cut into
overlapping chunks. Each chunk is split into pre-tokens from its own first
character, so a chunk that starts inside a pre-token is wrong at first and right
from the first boundary it shares with the chunk before it. That shared boundary
is a true one, and the text is cut there. The pieces between the cuts are encoded
as rows of their own and their ids are put together in order.

A pre-token longer than the overlap leaves two chunks without a shared boundary;
the text is then not cut from there on, and its rest is one piece. Pieces of more than
``LONG_CHARS`` are split by the splitter and encoded pre-token by pre-token, as the encoder's own
splitting fails on runs of some million white space characters.

Decoding is the concatenation of the ids' bytes.

Defined results: null and empty texts have no ids. Repeated rows each get a row.
Only the key columns and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import array
import base64
import functools
from collections.abc import Iterator, Sequence

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
LONG_CHARS = 4 * CHUNK_CHARS
#: Characters after a boundary that can still move it: the longest contraction, less one, and one looked ahead at.
REACH = 3

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The characters that the pattern's ``\s`` stands for (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoder(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(vocabulary), special_tokens={})


@functools.cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def _ids(text: str, vocabulary: str, pattern: str, long: int = LONG_CHARS) -> array.array:
    encode = encoder(vocabulary, pattern)
    if len(text) <= long:
        return array.array("I", encode.encode_ordinary(text))
    ids = array.array("I")
    for match in splitter(pattern).finditer(text):
        ids.extend(encode._encode_single_piece(match[0].encode()))
    return ids


def seams(text: str, pattern: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, list[int]]]:
    """For each seam between chunks and each side of it: the boundaries seen in the overlap, as places in the text."""
    find = splitter(pattern).finditer
    for number, start in enumerate(range(0, len(text), chunk)):
        piece = text[start:start + chunk + overlap]
        settled = len(piece) - REACH if start + chunk + overlap < len(text) else len(piece)
        places = [m.start() for m in find(piece)]
        if number:
            yield number, False, [start + p for p in places if p < overlap]
        if start + chunk < len(text):
            yield number + 1, True, [start + p for p in places if chunk <= p <= settled]


def encode(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY,
           pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per row of ``docs``: the keys, ``n_tokens`` and ``ids``, the ids as little-endian unsigned 32-bit integers."""
    if not REACH < overlap <= chunk:
        raise ValueError("the overlap must be longer than the reach of a boundary and no longer than a chunk")
    fields = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    named = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short, long = rows.filter(F.length("text") <= chunk), rows.filter(F.length("text") > chunk)

    def in_place(part):
        for *key, value in part:
            ids = _ids(value, vocabulary, pattern)
            yield *key, len(ids), ids.tobytes()

    done = map_rows(short, in_place, f"{fields}, n_tokens bigint, ids binary")
    pieces = _encoded_texts(long.select("text"), vocabulary, pattern, chunk, overlap)
    stitched = (long.select(*named, F.md5("text").alias("text_key")).join(pieces, "text_key")
                .select(*named, "n_tokens", "ids"))
    return done.unionAll(stitched).select(*(F.col(n).alias(k) for k, n in zip(keys, named)), "n_tokens", "ids")


def _encoded_texts(texts: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(text_key, n_tokens, ids) of each different text; copies are cut and encoded once."""
    texts = texts.withColumn("text_key", F.md5("text"))

    def look(part):
        for value, key in part:
            for seam, left, places in seams(value, pattern, chunk, overlap):
                yield key, seam, left, places

    sides = map_rows(texts, look, "text_key string, seam int, left boolean, places array<int>")
    shared = (sides.groupBy("text_key", "seam")
              .agg(F.max(F.when(F.col("left"), F.col("places"))).alias("before"), F.max(F.when(~F.col("left"), F.col("places"))).alias("after"))
              .select("text_key", "seam", F.array_min(F.array_intersect("before", "after")).alias("place")))
    cuts = (shared.groupBy("text_key")
            .agg(F.sort_array(F.collect_list(F.struct("seam", "place"))).alias("found"), F.min(F.when(F.col("place").isNull(), F.col("seam"))).alias("lost"))
            .select("text_key", F.transform(F.filter("found", lambda x: F.col("lost").isNull() | (x["seam"] < F.col("lost"))), lambda x: x["place"]).alias("cuts")))

    def cut(part):
        for value, key, places in part:
            ends = [0, *(places or []), len(value)]
            for number, (start, stop) in enumerate(zip(ends, ends[1:])):
                yield key, number, value[start:stop]

    def put_in_ids(part):
        for key, number, value in part:
            ids = _ids(value, vocabulary, pattern)
            yield key, number, len(ids), ids.tobytes()

    def join_ids(part):
        for key, n, found in part:
            yield key, n, b"".join(x["ids"] for x in found)

    pieces = map_rows(texts.join(cuts, "text_key", "left").select("text", "text_key", "cuts"), cut, "text_key string, piece int, text string")
    encoded = map_rows(pieces.dropDuplicates(["text_key", "piece"]), put_in_ids, "text_key string, piece int, n bigint, ids binary")
    whole = encoded.groupBy("text_key").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("found"))
    return map_rows(whole, join_ids, "text_key string, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, into: str = "decoded") -> DataFrame:
    """``encoded`` with one more column: the bytes its ids stand for, null for null ids."""
    if into in encoded.columns:
        raise ValueError(f"there is a column {into} already")
    columns, at = encoded.columns, encoded.columns.index(ids)
    named = encoded.toDF(*(f"c{i}" for i in range(len(columns))))

    def run(part):
        words = {rank: token for token, rank in ranks(vocabulary).items()}
        for row in part:
            yield *row, None if row[at] is None else b"".join(map(words.__getitem__, array.array("I", row[at])))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    return map_rows(named, run, f"{fields}, decoded binary").toDF(*columns, into)

