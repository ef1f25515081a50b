"""Exact n-gram Jaccard join by pivots and regions.

Points are sets of word shingles, the distance is Jaccard's. The pivots are single
shingles. A set is at distance 1 - 1/size of the pivots it holds and at distance 1
of all others, so its Voronoi region is that of the first pivot it holds, in one
order for all sets: pivots that many sets share come last.

A set within the threshold of another can miss only so many of its shingles; the
triangle inequality of the distance gives the number. Each set is therefore copied
to the regions of its first pivots, one more than it may miss, and two sets within
the threshold meet in the region of the first pivot they share. There, their sizes
and the places of that pivot in both sets bound the distance (``Members``).

Each region is joined in two steps.

1. The most central member is the region's document pivot. All members are measured
   against it. Members within the threshold link to it, which already puts them in
   one component; no pair of them is looked at again.
2. Where a region still holds several components, members meet again in windows:
   two members can only be linked if their distances to the document pivot differ
   by the threshold at most, so each goes to the ring of its distance and to the
   rings beside. Pairs inside one component are left out.

Before sets are fetched, a pair must pass a parity sketch: each bit of it is the
parity of the shingles that fall to it, so sketches differ in at most as many bits
as the sets differ in shingles. That bound only rejects pairs that are too far.

Equal sets are one point throughout; they are never paired with each other.

How many documents share a shingle is counted over all documents, for the shingles
that can come first in a set: by their hash, the first half more than a set may miss.
The ``most_counted`` most shared of them are put last, in steps of their counts. The order decides how
large regions are, never which links are found.

Defined results: null and empty texts, and texts without words, have no shingles,
link with nothing and are their own component. A text shorter than a shingle has its
whole word sequence as its only shingle. Repeated rows and equal sets fall together.
A row without an id belongs to its component but cannot name it. Other columns are
not read. Shingles are compared by 64-bit hashes, sets and rows by 128-bit ones.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows
from .components import components
from .key_filter import likely, unlikely
from .scratch import Scratch

SHINGLE_WORDS, LINK = 3, Fraction(9, 10)
#: Shingles whose counts tasks hold, 9 bytes each; where more are shared, these are the most shared ones.
MOST_COUNTED = 1_000_000
#: Shingles counted beyond the first half more that a set may miss, so that short sets are not left out.
EVEN_COUNTED = 4
RINGS = 10
FAR = RINGS + 1
REGION_FILTER_BITS = 1 << 24
#: In regions of so few members all may meet; in larger ones only members of neighbouring sizes and rings.
FEW = 24
PARITIES = ("b0", "b1", "b2", "b3")

#: Bytes of a UTF-8 text with A-Z lower-cased.
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """Hash of each word, computed once per task; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 50_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int, hashes: _Hashes) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    words = [] if text is None else text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = hashes.of(words)
    width = min(k, len(own))
    total = own[:len(own) - width + 1].copy()
    for i in range(1, width):
        total = _mixed(total * _STEP[0] + np.uint64(i)) + own[i:len(own) - width + 1 + i] * _STEP[1]
    return np.unique(_mixed(total + np.uint64(width)))


@dataclass(frozen=True)
class Members:
    """What the threshold allows, in whole numbers. Overlap o of sizes n and m links when o * (p + q) >= p * (n + m), t = p / q."""

    t: Fraction = LINK

    def missing(self, n: int) -> int:
        """How many of its n shingles a linked set can lack."""
        return n - -(-self.t.numerator * n // self.t.denominator)

    def linked(self, overlap: int, n: int, m: int) -> bool:
        return self.t.denominator * overlap >= self.t.numerator * (n + m - overlap)

    def most_different(self, n: int, m: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        p, q = self.t.numerator, self.t.denominator
        return n + m - 2 * -(-p * (n + m) // (p + q))

    def far(self, n, m):
        """Column: sizes that differ too much."""
        p, q = self.t.numerator, self.t.denominator
        return (F.least(n, m) * q) < (F.greatest(n, m) * p)

    def possible(self, n, i, m, j):
        """Column: sets of sizes n and m whose first shared shingle is at places i and j can be linked."""
        p, q = self.t.numerator, self.t.denominator
        return (F.least(n - i, m - j) * (p + q)) >= ((n + m) * p)


def row_key(doc_id: str, text: str):
    """128 bits of id and text; an id's length keeps the two apart."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.length(own), F.col(doc_id).isNull(), own, F.coalesce(F.col(text), F.lit("")))))


def _point(own: bytes) -> bytes:
    """The point of a set, from the bytes of its sorted shingles."""
    return xxhash.xxh3_128_digest(own)


def _sketch(own: np.ndarray) -> bytes:
    bits = 64
    while bits < 0.35 * len(own):
        bits *= 2
    return np.packbits(np.bincount(((own >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _parities(own: np.ndarray) -> list[int]:
    """A sketch of 256 bits as whole numbers, for use in a join's condition."""
    bits = np.bincount(((own >> np.uint64(20)) % np.uint64(256)).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def _differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, size)), np.bitwise_xor.reduce(y.reshape(-1, size))
    return int(np.bitwise_count(x ^ y).sum())


def shared_pivots(docs: DataFrame, text: str, k: int, members: Members, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most different texts share, ascending, and the step of their counts; ``most`` at most, by counts over all rows.

    Repeated texts count once a task.
    """
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        hashes, seen = _Hashes(), set()
        for (value,) in part:
            own = shingles(value, k, hashes)
            if len(own) and (point := _point(own.tobytes())) not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(point)
                yield (own[:(members.missing(len(own)) + 1) * 3 // 2 + EVEN_COUNTED].view(np.int64),)

    firsts = map_rows(docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()), run, "shingles array<bigint>")
    step = F.floor(F.log2("count") * 4).cast("int")
    counts = scratch.keep(firsts.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().filter("count > 1").select("shingle", step.alias("step")), "counts")
    sizes = {r["step"]: r["n"] for r in counts.groupBy("step").agg(F.count("*").alias("n")).collect()}  # a few hundred steps
    least, total = 0, 0
    for own in sorted(sizes, reverse=True):
        total += sizes[own]
        if total > most:
            least = own + 1
            break
    held = counts.filter(F.col("step") >= least).toArrow()
    shingle = held["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], held["step"].to_numpy()[order].astype(np.uint8)


def point_sets(docs: DataFrame, text: str, doc_id: str, k: int, members: Members, pivots: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: id, number of shingles, the point its set is (a hash), its first pivots in order, and its parity sketch."""
    known, steps = pivots

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _Hashes()
        for own_id, row_key, value, key in part:
            own = shingles(value, k, hashes)
            n = len(own)
            if not n:
                yield own_id, row_key, key, 0, None, [], b"", 0, 0, 0, 0
                continue
            shared = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                shared = np.where(known[at] == own, steps[at], 0)
            first = np.lexsort((own, shared))[:members.missing(n) + 1]
            yield own_id, row_key, key, n, _point(own.tobytes()), own[first].view(np.int64), _sketch(own), *_parities(own)

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"), F.md5(text).alias("text_key")), run,
                    f"doc_id {docs.schema[doc_id].dataType.simpleString()}, row_key binary, text_key string, n bigint, point binary, pivots array<bigint>, sketch binary, {', '.join(f'{b} bigint' for b in PARITIES)}")


def _measured(pairs: DataFrame, points: DataFrame, texts: DataFrame, k: int, members: Members, scratch: Scratch) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of the pairs (a, b) that the sketches let pass; ``texts`` are the texts behind the points."""
    def sketched(part: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, n_a, n_b, one, other in part:
            if _differing(one, other) <= members.most_different(n_a, n_b):
                yield a, b

    side = lambda name: points.select(F.col("point").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(~members.far(F.col("n_a"), F.col("n_b")))
    own = Scratch(texts.sparkSession)
    close = own.keep(map_rows(met.select("a", "b", "n_a", "n_b", "s_a", "s_b"), sketched, "a binary, b binary"), "close")
    needed = close.select(F.col("a").alias("point")).unionAll(close.select(F.col("b").alias("point"))).distinct()
    keys = own.keep(points.join(needed, "point", "left_semi").select("text_key"), "keys")
    # An inner join, the keys being distinct: Spark would move a semi join below the filter in front of it.
    found = likely(texts.select("text", F.md5("text").alias("text_key")), "text_key", keys).join(keys, "text_key").dropDuplicates(["text_key"])

    def make(part: Iterator[tuple]) -> Iterator[tuple]:
        hashes = _Hashes()
        for (value,) in part:
            held = shingles(value, k, hashes).tobytes()
            yield _point(held), held

    sets = own.keep(map_rows(found.select("text"), make, "point binary, held binary"), "sets")

    def measure(part: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, one, other in part:
            x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            yield a, b, len(x), len(y), int((both[1:] == both[:-1]).sum())

    held = close.join(sets.select(F.col("point").alias("a"), F.col("held").alias("held_a")), "a").join(sets.select(F.col("point").alias("b"), F.col("held").alias("held_b")), "b")
    measured = scratch.keep(map_rows(held.select("a", "b", "held_a", "held_b"), measure, "a binary, b binary, n_a bigint, n_b bigint, overlap bigint"), "measured")
    own.free()
    return measured


def _meetings(left: DataFrame, members: Members) -> DataFrame:
    """Pairs (x, y) of members of one region, of different components, that sizes, places and rings allow to be linked."""
    p, q = members.t.numerator, members.t.denominator
    # The larger set may meet sizes from ``low`` to ``top``. Sizes go by steps a little wider than the threshold allows, so it meets its own step and the one below.
    most = F.floor(((F.col("n") - F.col("place")) * (p + q) - F.col("n") * p) / p)
    low, top = F.ceil(F.col("n") * p / q), F.least(F.col("n"), most)
    width = max(math.log(q / p), 1e-6) * 1.001
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / width).cast("int")
    large = left.filter(top >= low).select("pivot", "size", *(F.col(b).alias(f"x_{b}") for b in PARITIES), F.col("point").alias("x"), F.col("n").alias("n_x"), F.col("place").alias("i"), F.col("component").alias("c_x"), "ring",
                                           F.array(step(F.col("n")) - 1, step(F.col("n"))).alias("steps"))
    small = left.filter(most >= F.col("n")).select("pivot", "size", *(F.col(b).alias(f"y_{b}") for b in PARITIES), F.col("point").alias("y"), F.col("n").alias("n_y"), F.col("place").alias("j"), F.col("component").alias("c_y"), "ring",
                                                   step(F.col("n")).alias("step"))
    # The parity sketches differ in no more bits than the sets in shingles: what is too far leaves no row behind.
    differing = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))).cast("bigint") for b in PARITIES), F.lit(0).cast("bigint"))
    both = F.col("n_x") + F.col("n_y")
    fits = (differing <= both - 2 * F.ceil(both * p / (p + q))) & (F.col("c_x") != F.col("c_y")) & (F.col("n_y") <= F.col("n_x")) & members.possible(F.col("n_x"), F.col("i"), F.col("n_y"), F.col("j"))
    few, many = F.col("size") <= FEW, F.col("size") > FEW
    met = [large.filter(few).drop("ring", "size", "steps").join(small.filter(few).drop("ring", "size", "step"), "pivot")]
    # Ring 0 are the linked members, the threshold itself included: they need not meet each other, and reach one ring further.
    window = F.when(F.col("ring") == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array_distinct(F.array(F.greatest(F.col("ring") - 2, F.lit(0)), F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    stepped = large.filter(many).withColumn("step", F.explode("steps")).drop("size", "steps")
    known, lost = F.col("ring") < FAR, F.col("ring") == FAR
    beside = small.filter(many).drop("size")
    met.append(stepped.filter(known).withColumn("ring", F.explode(window)).join(beside.filter(known), ["pivot", "ring", "step"]).drop("ring"))
    met.append(stepped.filter(lost).drop("ring").join(beside.drop("ring"), ["pivot", "step"]))
    met.append(stepped.filter(known).drop("ring").join(beside.filter(lost).drop("ring"), ["pivot", "step"]))
    return functools.reduce(DataFrame.unionAll, [m.filter(fits).select("x", "y") for m in met])


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, threshold: Fraction = LINK,
         most_counted: int = MOST_COUNTED, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n_shingles, point, component) and links (a, b, n_a, n_b, overlap) between points.

    ``point`` is equal for equal sets, null without words; ``component`` is equal for points that links connect.
    The links are those that were measured: enough to connect every component, not each pair inside one.
    Both frames stand on what ``scratch`` keeps.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    members = Members(Fraction(threshold))
    p, q = members.t.numerator, members.t.denominator
    rows = scratch.keep(point_sets(docs, text, doc_id, k, members, shared_pivots(docs, text, k, members, most_counted, scratch)), "points")
    points = scratch.keep(rows.filter(F.col("point").isNotNull()).dropDuplicates(["point"]).select("point", "text_key", "n", "pivots", "sketch", *PARITIES), "distinct")
    texts = docs.select(F.col(text).alias("text"))

    # Regions: the first pivots of each point, with the pivot's place in it.
    copies = points.select("point", "n", F.posexplode("pivots").alias("place", "pivot"))
    shared = scratch.keep(copies.groupBy("pivot").count().filter("count > 1").select("pivot"), "shared")
    rank = F.col("place").cast("bigint") * (1 << 44) + F.pmod(F.xxhash64("point"), F.lit(1 << 44))
    held = scratch.keep(likely(copies, "pivot", shared, REGION_FILTER_BITS).join(shared, "pivot"), "held")
    inside = scratch.keep(held.join(held.groupBy("pivot").agg(F.min_by("point", rank).alias("centre")), "pivot"), "regions")

    # Step 1: members against the document pivot of their region.
    spokes = inside.filter(F.col("point") != F.col("centre")).select(F.col("point").alias("a"), F.col("centre").alias("b")).distinct()
    first = _measured(spokes, points, texts, k, members, scratch)
    is_link = (F.col("overlap") * q) >= ((F.col("n_a") + F.col("n_b") - F.col("overlap")) * p)
    links = first.filter(is_link)
    parts = components(links, scratch)

    # Step 2: regions that several components share, in windows of the distance to the document pivot.
    width = float(1 - members.t)
    distance = 1 - F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))
    ring = F.least(F.floor(distance / width + 1e-9).cast("int"), F.lit(RINGS))
    rings = first.select(F.col("a").alias("point"), F.col("b").alias("centre"), F.when(is_link, 0).otherwise(F.greatest(ring, F.lit(1))).alias("ring"))
    placed = (inside.join(parts.select(F.col("node").alias("point"), "component"), "point", "left").withColumn("component", F.coalesce("component", "point"))
              .join(rings, ["point", "centre"], "left"))
    # The document pivot is done, so only regions whose other members are of several components are left.
    others = placed.filter(F.col("point") != F.col("centre"))
    mixed = (others.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
             .filter(F.col("low") < F.col("high")).select("pivot", "size"))
    # What the sketch kept from the document pivot is in no ring.
    left = scratch.keep(others.join(mixed, "pivot").select("pivot", "size", "point", "n", "place", "component", F.coalesce("ring", F.lit(FAR)).alias("ring"))
                        .join(points.select("point", *PARITIES), "point"), "left")
    met = _meetings(left, members).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    second = _measured(met, points, texts, k, members, scratch)
    links = links.unionAll(second.filter(is_link))
    parts = components(links, scratch)
    # Rows without words have no point; they stay out of the join, where they would be one group.
    wordless = rows.filter(F.col("point").isNull()).withColumn("component", F.col("point"))
    named = rows.filter(F.col("point").isNotNull()).join(parts.select(F.col("node").alias("point"), "component"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    return named.unionByName(wordless).select("doc_id", "row_key", F.col("n").alias("n_shingles"), "point", "component"), links


def classes(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.result(join(docs, doc_id=doc_id, scratch=scratch, **options)[0], "classes")
    # Written, so that Spark can split the rows of one component in the join.
    names = scratch.keep(rows.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least")), "names")
    named = rows.filter(F.col("component").isNotNull()).join(names, "component").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return named.unionAll(rows.filter(F.col("component").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among ``keys``. An outer join, as Spark would move an anti join below the filter in front of it."""
    return rows.join(keys.withColumn("listed", F.lit(True)), "row_key", "left").filter(F.col("listed").isNull()).select(*rows.columns)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the least id, then the least key of id and text. Rows without words all stay.

    Only rows that may have to go are looked up; the others stay where they are.
    """
    scratch = Scratch(docs.sparkSession)
    found = join(docs, doc_id=doc_id, text=text, scratch=scratch, **options)[0]
    rows = scratch.result(found.filter(F.col("component").isNotNull()).select("component", "doc_id", "row_key"), "members")
    ids = scratch.keep(rows.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    leading = rows.join(ids, "component").filter(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("component").agg(F.min("row_key").alias("lead"))
    goes = scratch.keep(rows.join(scratch.keep(leading, "leading"), "component").filter(F.col("row_key") != F.col("lead")).select("row_key").distinct(), "goes")
    again = scratch.keep(rows.groupBy("row_key").count().filter("count > 1").select("row_key").join(goes, "row_key", "left_anti"), "again")
    keyed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    keyed = keyed.withColumn("row_key", row_key(f"c{docs.columns.index(doc_id)}", f"c{docs.columns.index(text)}"))
    either = scratch.keep(goes.unionAll(again), "either")
    kept = unlikely(keyed, "row_key", either).unionAll(_without(likely(keyed, "row_key", either), goes))
    if not again.isEmpty():
        kept = kept.join(again, "row_key", "left_anti").select(*keyed.columns).unionAll(kept.join(again, "row_key", "left_semi").select(*keyed.columns).dropDuplicates(["row_key"]))
    return kept.drop("row_key").toDF(*docs.columns)
