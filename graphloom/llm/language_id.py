"""Language of texts by a convolutional network over bytes.

Each byte has a short embedding; filters of several widths run over windows of fixed
length, the largest response of each filter in the window goes to a softmax over the
languages. The network is trained in numpy on a bounded sample of labelled windows; a
document's prediction is the mean over windows that cover its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.common import blocks

# bytes of a window
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# documents of each language, and languages, that the network is fitted on
SAMPLE_DOCS = 400
MOST_LANGUAGES = 200
EPOCHS = 6
BATCH = 64
RATE = 0.01
# windows that a task holds as arrays at a time
WINDOWS = 128
UNKNOWN = "und"


def windows_of(text: bytes) -> np.ndarray:
    """Windows that cover the whole text, one at least; the last one ends with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    table: np.ndarray  # byte, component
    filters: list[np.ndarray]  # for each width: tap, component, filter
    biases: list[np.ndarray]
    weights: np.ndarray  # feature, language
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.biases, self.weights, self.offset]

    def responses(self, embedded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each width the largest response of each filter in a window, and where."""
        n, length, _ = embedded.shape
        for taps, bias in zip(self.filters, self.biases):
            width = len(taps)
            out = np.zeros((n, length - width + 1, taps.shape[2]), np.float32)
            for k in range(width):
                out += embedded[:, k : length - width + 1 + k] @ taps[k]
            at = out.argmax(1)
            yield np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + bias, 0), at

    def features(self, windows: np.ndarray) -> np.ndarray:
        """The largest responses only; a filter is a table of its taps' answers to the bytes."""
        # place by place, so that taps and the maximum run over whole rows of memory
        places = np.ascontiguousarray(windows.T).astype(np.intp)
        out = []
        for taps, bias in zip(self.filters, self.biases):
            width = len(taps)
            until = len(places) - width + 1
            answers = np.einsum("be,kef->kbf", self.table, taps)
            total = np.take(answers[0], places[:until], axis=0, mode="clip")
            for k in range(1, width):
                total += np.take(answers[k], places[k : until + k], axis=0, mode="clip")
            out.append(np.maximum(total.max(0) + bias, 0))
        return np.concatenate(out, 1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.features(windows) @ self.weights + self.offset)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def fit(texts: list[bytes], languages: list[str], seed: int = 42, epochs: int = EPOCHS) -> Network:
    """Trains on one window a text, Adam on the cross entropy.

    In every epoch half the windows are shortened at random, so that short texts are known too.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    wanted = np.array([names.index(x) for x in languages])
    windows = np.concatenate([windows_of(t[:WINDOW]) for t in texts])
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape).astype(np.float32)
    net = Network(
        names, normal(256, EMBEDDING), [normal(w, EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        normal(FILTERS * len(WIDTHS), len(names)), np.zeros(len(names), np.float32),
    )
    net.table[0] = 0
    # a language counts alike whatever its number of texts
    share = (len(wanted) / (len(names) * np.bincount(wanted))).astype(np.float32)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        shown = windows.copy()
        shorter = rng.random(len(shown)) < 0.5
        length = rng.integers(12, WINDOW, len(shown))
        shown[shorter[:, None] & (np.arange(WINDOW) >= length[:, None])] = 0
        order = rng.permutation(len(shown))
        for a in range(0, len(order), BATCH):
            step += 1
            at = order[a : a + BATCH]
            gradients = _gradients(net, shown[at], wanted[at], share[wanted[at]])
            for p, g, m, v in zip(net.parameters(), gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.table[0] = 0
    return net


def _gradients(net: Network, windows: np.ndarray, wanted: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    n = len(windows)
    embedded = net.table[windows]
    pooled = list(net.responses(embedded))
    features = np.concatenate([p for p, _ in pooled], 1)
    off = softmax(features @ net.weights + net.offset)
    off[np.arange(n), wanted] -= 1
    off *= (share / n)[:, None]
    back = off @ net.weights.T
    g_table, g_filters, g_biases = np.zeros_like(net.table), [], []
    rows = np.arange(n)[:, None]
    for i, (taps, (response, at)) in enumerate(zip(net.filters, pooled)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS] * (response > 0)
        g_taps = np.empty_like(taps)
        for k in range(len(taps)):
            # only the place with the largest response learns
            met = embedded[rows, at + k]
            g_taps[k] = np.einsum("nfe,nf->ef", met, g)
            np.add.at(g_table, windows[rows, at + k], g[:, :, None] * taps[k].T)
        g_filters.append(g_taps)
        g_biases.append(g.sum(0))
    return [g_table, *g_filters, *g_biases, features.T @ off, off.sum(0)]


def held_out() -> Column:
    """Rows that no training sees: crc32 of the id as text is a multiple of 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def has_letter() -> Column:
    return F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))


def sample(docs: DataFrame, most: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES, seed: int = 42) -> DataFrame:
    """Rows (lang, window, chance): up to ``most`` labelled texts of each of the most frequent languages, a window of each.

    The texts with the smallest hashes of their id and text are taken; the window
    starts at a hashed place. Of a frequent language only hashes that can be
    among the smallest are exchanged at all: four times ``most`` on average.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not sizes:
        return known.select("lang", F.col("text").alias("window"), F.lit(0).cast("bigint").alias("chance")).limit(0)
    low, span = -(1 << 63), 1 << 64
    bounds = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, low + min(span - 1, span * 4 * most // r["count"]))])
    chance = F.xxhash64("doc_id", "text", F.lit(seed))
    begin = F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    windows = known.select("lang", chance.alias("chance"), F.substr("text", begin.cast("int"), F.lit(WINDOW)).alias("window"))
    likely = windows.where(F.col("chance") <= F.element_at(bounds, F.col("lang")))
    ranked = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("chance", "window"))).where(F.col("rank") <= most)
    return ranked.select("lang", "window", "chance")


def train(docs: DataFrame, most: int = SAMPLE_DOCS, most_languages: int = MOST_LANGUAGES, seed: int = 42) -> Network | None:
    """A network for the labelled languages of ``docs``; none where no labelled text can be learned from.

    At most ``most_languages`` languages, the most frequent ones, and ``most``
    texts of each come to the driver.
    """
    rows = sorted((r.lang, r.chance, r.window) for r in sample(docs, most, most_languages, seed).collect())
    return fit([w.encode() for _, _, w in rows], [lang for lang, _, _ in rows], seed) if rows else None


def _predicted(net: Network):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", WINDOWS * WINDOW):
            texts = batch.column("text")
            total = np.zeros((batch.num_rows, len(net.languages)))
            count = np.zeros(batch.num_rows)
            held: list[np.ndarray] = []
            owner: list[int] = []

            def judge() -> None:
                np.add.at(total, owner, net.probabilities(np.concatenate(held)))
                np.add.at(count, owner, 1)
                held.clear()
                owner.clear()

            for i, text in enumerate(texts):
                if not text.is_valid:
                    continue
                windows = windows_of(text.as_py())
                for a in range(0, len(windows), WINDOWS):
                    held.append(windows[a : a + WINDOWS])
                    owner += [i] * len(held[-1])
                    if len(owner) >= WINDOWS:
                        judge()
            if owner:
                judge()
            mean = total / np.maximum(count, 1)[:, None]
            known = count > 0
            best = mean.argmax(1)
            names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    return rows


def predicted(docs: DataFrame, net: Network | None, row: Column | None = None) -> DataFrame:
    """Rows (row, held_out, lang_pred, score), one per document; ``row`` is the input row or the columns given.

    The languages of all windows of the whole text are averaged; ``score`` is the
    mean probability of the answer. A null text or one without a letter is ``und``
    with score 0, as is every text without a network.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if row is None else row
    carried = docs.select(F.struct(whole.alias("row"), held_out().alias("held_out")).alias("row"), F.when(has_letter(), F.col("text").cast("binary")).alias("text"))
    if net is None:
        return carried.select("row.row", "row.held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = carried.schema["row"].dataType
    found = carried.mapInArrow(_predicted(net), f"row {kind.simpleString()}, lang_pred string, score double")
    return found.select("row.row", "row.held_out", "lang_pred", "score")
