"""Language identification by a convolutional network over bytes.

Text is lower-cased and its UTF-8 bytes become classes: each letter a-z, each byte
of a longer character, and one class for all else. Fixed-length windows cover the
whole text. Filters of several widths run over a window, the best answer of each
filter is kept (max pooling), and a softmax over these answers gives the window's
languages. A document's languages are the mean over its windows.

The network is trained in numpy on a bounded, balanced sample of labelled rows:
``docs_per_lang`` documents of each language, the first by a hash of their id,
and ``windows_per_doc`` windows of each, spread over the whole text. Every row is
predicted by the same network, in batches of windows.

Defined results: a null text, and one without a letter, is ``und`` with score 0;
so is every text where there is nothing to learn from. Rows without an id or a
language are never learned. Repeated rows are predicted each. Other columns travel
along under other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import extend_rows, map_rows

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
STRIDE = WINDOW - max(WIDTHS) + 1
DOCS_PER_LANG, WINDOWS_PER_DOC, EPOCHS, BATCH = 600, 4, 6, 64
BATCH_WINDOWS = 512
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_CLASSES = 160
_CLASS = bytes(b - 96 if 97 <= b <= 122 else b - 100 if b >= 128 else 0 for b in range(256))
_OTHER = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def windows_of(text: str) -> np.ndarray:
    """The classes of the whole text as overlapping windows, one row each; no n-gram is lost between two of them."""
    raw = b" " + b" ".join(text.lower().encode().translate(_OTHER).split()) + b" "
    count = max(1, -(-(len(raw) - (WINDOW - STRIDE)) // STRIDE))
    raw = raw.ljust((count - 1) * STRIDE + WINDOW)
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw.translate(_CLASS), np.uint8), WINDOW)[::STRIDE]


@dataclass
class Network:
    """``filters[w]`` is (w, classes, filters): what each filter of width w adds for a class at a place in it."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per width: tables over pairs of classes (and a single class for an odd width) whose rows add up to the answers."""
        made = []
        for width, w in self.filters.items():
            pairs = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(_CLASSES * _CLASSES, -1) for j in range(0, width - 1, 2)]
            made.append((width, pairs, w[width - 1] if width % 2 else None))
        return made

    def pooled(self, windows: np.ndarray, tables: list) -> np.ndarray:
        x = windows.astype(np.int32)
        pair = x[:, :-1] * _CLASSES + x[:, 1:]
        best = []
        for width, pairs, single in tables:
            n = WINDOW - width + 1
            answer = np.take(pairs[0], pair[:, :n], axis=0)
            for j, table in enumerate(pairs[1:], 1):
                answer += np.take(table, pair[:, 2 * j:2 * j + n], axis=0)
            if single is not None:
                answer += np.take(single, x[:, width - 1:width - 1 + n], axis=0)
            best.append(answer.max(axis=1))
        return np.maximum(np.concatenate(best, 1) + self.bias, 0)

    def likely(self, pooled: np.ndarray) -> np.ndarray:
        return softmax(pooled @ self.dense + self.dense_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], filters: int = FILTERS, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 1) -> Network:
    """Adam over mini-batches; through max pooling only the winning place of a filter learns."""
    rng = np.random.default_rng(seed)
    net = Network(langs, {w: rng.normal(0, 0.3, (w, _CLASSES, filters)).astype(np.float32) for w in WIDTHS},
                  np.zeros(filters * len(WIDTHS), np.float32), rng.normal(0, 0.3, (filters * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    weights = [*net.filters.values(), net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            part = order[start:start + BATCH]
            x, rows = windows[part].astype(np.intp), np.arange(len(part))
            best, places = [], []
            for width, w in net.filters.items():
                n = WINDOW - width + 1
                answer = sum(np.take(w[j], x[:, j:j + n], axis=0) for j in range(width))
                places.append(answer.argmax(axis=1))
                best.append(np.take_along_axis(answer, places[-1][:, None, :], 1)[:, 0])
            plain = np.concatenate(best, 1) + net.bias
            pooled = np.maximum(plain, 0)
            off = net.likely(pooled)
            off[rows, labels[part]] -= 1
            off /= len(part)
            back = (off @ net.dense.T) * (plain > 0)
            grads = []
            for k, (width, w) in enumerate(net.filters.items()):
                g, own = np.zeros_like(w), back[:, k * filters:(k + 1) * filters]
                for j in range(width):
                    np.add.at(g[j], (x[rows[:, None], places[k] + j], np.arange(filters)[None, :]), own)
                grads.append(g)
            grads += [back.sum(0), pooled.T @ off, off.sum(0)]
            step += 1
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: a fifth by a checksum of the id, and rows without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG,
        windows_per_doc: int = WINDOWS_PER_DOC, **options) -> Network | None:
    """Train on the sample that the module describes; None where no row has a language and a text with a letter."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("draw", F.xxhash64("doc_id"))
    counts = rows.groupBy("lang").count()
    # A draw of about four times the wanted number is cut down to it; a language with few documents gives all.
    share = counts.select("lang", F.least(F.lit(1.0), 4.0 * docs_per_lang / F.col("count")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").filter(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ranked = drawn.select("lang", "draw", "doc_id").withColumn("place", F.row_number().over(_by_draw())).filter(F.col("place") <= docs_per_lang)
    chosen = drawn.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi")

    def cut(part: Iterator[tuple]) -> Iterator[tuple]:
        for own_lang, draw, value in part:
            if _LETTER.search(value):
                all_ = windows_of(value)
                for k in np.unique(np.linspace(0, len(all_) - 1, windows_per_doc).astype(int)):
                    yield own_lang, draw, int(k), all_[k].tobytes()

    sample = sorted(tuple(r) for r in map_rows(chosen.select("lang", "draw", "text"), cut, "lang string, draw bigint, k int, classes binary").collect())
    if not sample:
        return None
    langs = sorted({r[0] for r in sample})
    windows = np.frombuffer(b"".join(r[3] for r in sample), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([langs.index(r[0]) for r in sample]), langs, **options)


def _by_draw():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("draw", "doc_id")


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Rows of ``docs``, columns as c0, c1 ... (see ``batches.renamed``), with ``lang_pred`` and ``score``."""
    at = docs.columns.index(text)

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        tables = network.tables() if network else []
        held: list[tuple] = []
        queue: list[tuple[int, np.ndarray]] = []
        sums: dict[int, np.ndarray] = {}
        waiting = 0

        def work():
            stacked = np.concatenate([w for _, w in queue])
            owners = np.repeat([i for i, _ in queue], [len(w) for _, w in queue])
            for start in range(0, len(stacked), BATCH_WINDOWS):
                likely = network.likely(network.pooled(stacked[start:start + BATCH_WINDOWS], tables))
                own = owners[start:start + BATCH_WINDOWS]
                edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                for i, total in zip(own[edges], np.add.reduceat(likely, edges, axis=0)):
                    sums[int(i)] = sums.get(int(i), 0) + total
            queue.clear()

        def finished():
            for i, row in enumerate(held):
                if i not in sums:
                    yield *row, UNKNOWN, 0.0
                else:
                    mean = sums[i] / sums[i].sum()
                    yield *row, network.langs[int(mean.argmax())], float(mean.max())
            held.clear()
            sums.clear()

        for row in part:
            held.append(row)
            if network and row[at] is not None and _LETTER.search(row[at]):
                queue.append((len(held) - 1, windows_of(row[at])))
                waiting += len(queue[-1][1])
            if waiting >= BATCH_WINDOWS or len(held) >= 4096:
                if queue:
                    work()
                waiting = 0
                yield from finished()
        if queue:
            work()
        yield from finished()

    return extend_rows(docs, run, "lang_pred string, score double")
