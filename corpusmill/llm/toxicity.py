"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed twice into tables of embeddings, whose rows are added up; filters over one,
two and three words, rectified, keep their maximum over the whole text; a logistic unit
reads the maxima. Max pooling over all positions makes length irrelevant: one passage of a
long text counts as much as in a short one.

Embeddings, filters and output start at random and are all learned by gradients. A maximum
passes its gradient to one place, which a random start points anywhere; so the first epochs
pool softly (the logarithm of the mean of exponentials, ever sharper: SHARPNESS) over a
random part of the words (DROPPED), which teaches every word of a text, and the last by the
maximum itself, as scoring does.

The threshold of each language (guessed from the text by a naive Bayes model over the same
hashed words, never read from a column) is chosen on labelled rows that were not fitted on
(of a class with fewer than 40 labelled rows, on all of them), and scores are shifted so that every language's threshold is 0.5.

Every labelled row is learned from, over its whole text: three of four by a hash of the id are
fitted on, the fourth chooses the thresholds. Rows to fit on are dealt to shards of about
SHARD_ROWS rows or SHARD_BYTES bytes. In an epoch a task goes through its shard from the
network that all share, and the networks of the shards are averaged: filters and output over
all shards, an embedding over those that moved it. Rows stream through a task; a text of more
than WORDS_AT_ONCE words is gone through in pieces, twice. Only networks, which have a fixed
size, and counts of cells pass through the driver.
Every row is scored over its whole text. Null and empty texts and others without words score
the share of toxic labels, at most just below a half. Labels that repeat for a document count once, as
toxic if one of them is. Documents that repeat are fitted on and scored each. Without labels
of both classes every score is the share of toxic labels (0 without any), at most just below
a half. Empty tables are fine. Extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.language_id import id_crc
from corpusmill.llm.scratch import discard, filter_by_text, materialize
from corpusmill.llm.wordhash import ALNUM, mix, slices, text_bytes, words

#: Rows and bytes of a shard; one task trains on a shard in an epoch.
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
#: A text beyond this was once cut for fitting; it is fitted on whole now.
SAMPLE_BYTES = 16_384
#: Words whose gradients are computed at once.
WORDS_AT_ONCE = 1 << 16
TABLE_BITS = 16
WIDTH = 16
FILTERS = {1: 32, 2: 16, 3: 16}
#: Sharpness of the pooling in each epoch; None: the maximum.
SHARPNESS: tuple[float | None, ...] = (1.0, 2.0, 16.0, None)
#: Share of the words that an epoch of soft pooling leaves out.
DROPPED = 0.5
TABLE_RATE = 0.05
LEAST_TEXTS = 3
#: Words are counted in 2**CELL_BITS cells; those that meet in one count together.
CELL_BITS = 20
#: Labelled rows with which a language gets a threshold of its own, and cells of a logit's unit in the counts for thresholds.
LEAST_ROWS = 60
LOGIT_CELLS, LOGIT_MOST = 256, 1 << 14
BATCH = 32
#: Labelled ids are marked in 2**ID_BITS cells before documents meet labels.
ID_BITS = 26
LANGUAGE_BITS = 13
#: Rows of its own that outweigh, in a language's threshold, the rows of all languages.
PRIOR_ROWS = 100
_PIECE_BYTES = 1 << 19


@dataclass
class Network:
    """tables: two of 2**TABLE_BITS embeddings; filters[w]: (w * WIDTH, n) weights; out: the logistic unit."""

    tables: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str] = field(default_factory=list)
    language_logs: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    constant: float | None = None
    #: The score of a text without words, which says nothing: the share of toxic labels, at most just below a half.
    wordless: float | None = None


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Two independent rows of the embedding tables for each word."""
    h = mix(hashes ^ np.uint64(0x5DEECE66D))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return np.stack([(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)])


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    n = sum(FILTERS.values())
    return Network(
        rng.normal(0, 0.1, (2, 1 << TABLE_BITS, WIDTH)).astype(np.float32),
        {w: rng.normal(0, 1 / math.sqrt(w * WIDTH), (w * WIDTH, k)).astype(np.float32) for w, k in FILTERS.items()},
        {w: np.zeros(k, np.float32) for w, k in FILTERS.items()},
        rng.normal(0, 0.1, n).astype(np.float32), np.zeros(1, np.float32),
    )


_PAD = max(FILTERS) - 1


def _embed(net: Network, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings with _PAD empty places after each text and one for a text without words, places of the words, text starts)."""
    n = len(bounds) - 1
    lengths = np.maximum(np.diff(bounds), 1)
    starts = np.concatenate([[0], np.cumsum(lengths + _PAD)[:-1]]).astype(np.int64)
    x = np.zeros((int((lengths + _PAD).sum()), WIDTH), net.tables.dtype)
    places = np.repeat(starts - bounds[:-1], np.diff(bounds)) + np.arange(rows.shape[1]) if n else np.zeros(0, np.int64)
    x[places] = net.tables[0][rows[0]] + net.tables[1][rows[1]]
    return x, places, starts


def _windows(x: np.ndarray, w: int) -> np.ndarray:
    """Each place with the w - 1 after it; a view's rows past the end are left out."""
    flat = np.ascontiguousarray(x).reshape(-1)
    return np.lib.stride_tricks.as_strided(flat, (len(x) - w + 1, w * WIDTH), (WIDTH * x.itemsize, x.itemsize))


def _tops(y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maxima of each text's places."""
    edges = np.minimum(np.stack([starts, np.minimum(ends, len(y))], axis=1).reshape(-1), len(y))
    # even entries are the texts, odd ones the places between them
    return np.maximum.reduceat(np.concatenate([y, np.full((1, y.shape[1]), -np.inf, y.dtype)]), edges, axis=0)[::2]


def maxima(net: Network, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Max pooled features of each text."""
    x, _, starts = _embed(net, rows, bounds)
    ends = np.append(starts[1:], len(x)) - _PAD
    return np.concatenate([np.maximum(_tops(_windows(x, w) @ net.filters[w], starts, ends) + net.bias[w], 0) for w in FILTERS], axis=1)


@dataclass
class Gradients:
    """Of the mean loss; tables: for each word place of the batch, the gradient of its embedding."""

    loss: float
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    words: np.ndarray


def gradients(net: Network, rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray, sharpness: float | None) -> Gradients:
    """Loss and gradients of a batch of texts, pooled at a sharpness (None: by the maximum)."""
    x, places, starts = _embed(net, rows, bounds)
    n = len(starts)
    ends = np.append(starts[1:], len(x)) - _PAD
    # the places of the texts, without those between
    of = np.repeat(np.arange(n), ends - starts)
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]).astype(np.int64)
    own = np.arange(len(of)) + (starts - first)[of]
    feats, shares, views = [], {}, {}
    for w in FILTERS:
        views[w] = _windows(x, w)
        y = views[w] @ net.filters[w]
        top = _tops(y, starts, ends)
        if sharpness is None:
            value = top
            best = np.array([y[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)]).reshape(n, -1)
            shares[w] = best
        else:
            e = np.exp(sharpness * (y[own] - top[of]))
            total = np.add.reduceat(e, first, axis=0)
            value = top + np.log(total / (ends - starts)[:, None]) / sharpness
            shares[w] = e / total[of]
        feats.append(np.maximum(value + net.bias[w], 0))
    feats = np.concatenate(feats, axis=1)
    z = feats @ net.out + net.out_bias[0]
    p = 1 / (1 + np.exp(-z))
    loss = float((weights * (np.logaddexp(0, z) - labels * z)).mean())
    delta = ((p - labels) * weights / n).astype(x.dtype)
    back = delta[:, None] * net.out * (feats > 0)
    dx = np.zeros_like(x)
    filters, bias, k = {}, {}, 0
    for w, width in FILTERS.items():
        g = back[:, k : k + width]
        k += width
        bias[w] = g.sum(axis=0)
        if sharpness is None:
            filters[w] = np.einsum("tf,tfd->df", g, views[w][shares[w]])
            spread = (g[:, :, None] * net.filters[w].T).reshape(-1, w, WIDTH)
            for j in range(w):
                np.add.at(dx, shares[w].reshape(-1) + j, spread[:, j])
        else:
            dy = shares[w] * g[of]
            filters[w] = views[w][own].T @ dy
            spread = (dy @ net.filters[w].T).reshape(-1, w, WIDTH)
            for j in range(w):
                dx[own + j] += spread[:, j]
    return Gradients(loss, filters, bias, feats.T @ delta, delta.sum(keepdims=True), dx[places])


def _pieces(net: Network, rows: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, embeddings with the _PAD places after them) of the pieces of one text."""
    n = rows.shape[1]
    for a in range(0, n, most):
        b = min(n, a + most)
        x = np.zeros((b - a + _PAD, WIDTH), net.tables.dtype)
        here = rows[:, a : b + _PAD]
        x[: here.shape[1]] = net.tables[0][here[0]] + net.tables[1][here[1]]
        yield a, b, x


def long_gradients(net: Network, rows: np.ndarray, label: int, weight: float, sharpness: float | None, most: int = WORDS_AT_ONCE) -> Gradients:
    """`gradients` of one text with words, of which pieces are held: one pass pools, the next sends the gradient back."""
    n, dtype = rows.shape[1], net.tables.dtype
    tops = {w: np.full(k, -np.inf, dtype) for w, k in FILTERS.items()}
    totals = {w: np.zeros(k, dtype) for w, k in FILTERS.items()}
    best = {w: np.zeros(k, np.int64) for w, k in FILTERS.items()}
    for a, b, x in _pieces(net, rows, most):
        for w in FILTERS:
            y = _windows(x, w)[: b - a] @ net.filters[w]
            top = y.max(axis=0)
            best[w] = np.where(top > tops[w], y.argmax(axis=0) + a, best[w])
            top = np.maximum(top, tops[w])
            if sharpness is not None:
                totals[w] = totals[w] * np.exp(sharpness * (tops[w] - top)) + np.exp(sharpness * (y - top)).sum(axis=0)
            tops[w] = top
    values = {w: tops[w] if sharpness is None else tops[w] + np.log(totals[w] / n) / sharpness for w in FILTERS}
    feats = np.concatenate([np.maximum(values[w] + net.bias[w], 0) for w in FILTERS])
    z = float(feats @ net.out + net.out_bias[0])
    loss = float(weight * (np.logaddexp(0, z) - label * z))
    delta = np.array([(1 / (1 + np.exp(-z)) - label) * weight], dtype)
    back = delta * net.out * (feats > 0)
    widths = np.cumsum([0, *FILTERS.values()])
    bias = {w: back[widths[i] : widths[i + 1]] for i, w in enumerate(FILTERS)}
    filters = {w: np.zeros_like(net.filters[w]) for w in FILTERS}
    out = np.zeros((n + _PAD, WIDTH), dtype)
    for a, b, x in _pieces(net, rows, most):
        for w in FILTERS:
            view = _windows(x, w)[: b - a]
            if sharpness is None:
                mine = np.flatnonzero((best[w] >= a) & (best[w] < b))
                filters[w][:, mine] += view[best[w][mine] - a].T * bias[w][mine]
                spread = (bias[w][mine, None] * net.filters[w].T[mine]).reshape(-1, w, WIDTH)
                for j in range(w):
                    np.add.at(out, best[w][mine] + j, spread[:, j])
            else:
                dy = np.exp(sharpness * (view @ net.filters[w] - tops[w])) / totals[w] * bias[w]
                filters[w] += view.T @ dy
                spread = (dy @ net.filters[w].T).reshape(-1, w, WIDTH)
                for j in range(w):
                    out[a + j : b + j] += spread[:, j]
    return Gradients(loss, filters, bias, feats * delta[0], delta, out[:n])


def batch_gradients(net: Network, rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray, sharpness: float | None, most: int = WORDS_AT_ONCE) -> Gradients:
    """`gradients` of a batch, at most so many words at once."""
    n = len(bounds) - 1
    parts = []
    for i, j in slices(bounds, most):
        mine = rows[:, bounds[i] : bounds[j]]
        w = weights[i:j] * ((j - i) / n)
        parts.append(long_gradients(net, mine, labels[i], w[0], sharpness, most) if mine.shape[1] > most else gradients(net, mine, bounds[i : j + 1] - bounds[i], labels[i:j], w, sharpness))
    if len(parts) == 1:
        return parts[0]
    add = lambda f: sum(f(p) for p in parts)
    return Gradients(add(lambda p: p.loss), {w: add(lambda p: p.filters[w]) for w in FILTERS}, {w: add(lambda p: p.bias[w]) for w in FILTERS}, add(lambda p: p.out), add(lambda p: p.out_bias), np.concatenate([p.words for p in parts]))  # noqa: B023


def logits(net: Network, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) < 2:
        return np.zeros(0)
    return (maxima(net, buckets(hashes), bounds) @ net.out + net.out_bias[0]).astype(np.float64)


def cells(hashes: np.ndarray) -> np.ndarray:
    """The cell in which a word is counted."""
    return (mix(hashes ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Fit:
    """A network with what gradient descent keeps: Adam's means for the filters and the output, what each embedding has moved."""

    def __init__(self, known: np.ndarray, seed: int = 7, rate: float = 0.01) -> None:
        self.net, self.known, self.seed, self.rate = new_network(seed), known, seed, rate
        self.moved = np.zeros((2, 1 << TABLE_BITS), np.float32)
        self.step = np.zeros(1, np.float32)
        net = self.net
        self.dense = {"out": net.out, "out_bias": net.out_bias, **{f"f{w}": net.filters[w] for w in FILTERS}, **{f"b{w}": net.bias[w] for w in FILTERS}}
        self.means = {k: np.zeros((2, *v.shape), np.float32) for k, v in self.dense.items()}

    def _adam(self, name: str, grad: np.ndarray) -> None:
        m, v = self.means[name]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        step = float(self.step[0])
        value = self.dense[name]
        value -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, sharp: float | None) -> None:
        """One step on a batch: Adam for the filters and the output, steps by row for the embeddings."""
        self.step += 1
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes = np.concatenate(texts)
        rows = buckets(hashes)
        net = self.net
        g = batch_gradients(net, rows, bounds, labels, weights, sharp)
        self._adam("out", g.out + 1e-4 * net.out)
        self._adam("out_bias", g.out_bias)
        for w in FILTERS:
            self._adam(f"f{w}", g.filters[w] + 1e-4 * net.filters[w])
            self._adam(f"b{w}", g.bias[w])
        changed = np.flatnonzero(g.words.any(axis=1) & self.known[cells(hashes)])
        for t in (0, 1):
            ids, inverse = np.unique(rows[t][changed], return_inverse=True)
            total = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(total, inverse, g.words[changed])
            # a row's steps get shorter with what it has moved
            self.moved[t][ids] += (total * total).mean(axis=1)
            net.tables[t][ids] -= TABLE_RATE * total / (np.sqrt(self.moved[t][ids]) + 1e-4)[:, None]

    def _arrays(self) -> list[np.ndarray]:
        return [*self.dense.values(), *self.means.values(), self.step]

    def parts(self, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, ids, their values): the filters and all that goes with them as block -1, and the embeddings that moved since `before`."""
        flat = np.concatenate([a.reshape(-1) for a in self._arrays()])
        yield -1, np.arange(len(flat)), flat
        rows = np.concatenate([self.net.tables, self.moved[:, :, None]], axis=2).reshape(-1, WIDTH + 1)
        ids = np.flatnonzero((self.moved != before).reshape(-1))
        for mine in np.split(ids, np.flatnonzero(np.diff(ids // _BLOCK)) + 1) if len(ids) else []:
            yield int(mine[0] // _BLOCK), mine, rows[mine].reshape(-1)

    def take(self, block: int, ids: np.ndarray, values: np.ndarray) -> None:
        """Put averaged values in their places."""
        if block < 0:
            at = 0
            for a in self._arrays():
                a[...] = values[at : at + a.size].reshape(a.shape)
                at += a.size
        else:
            values = values.reshape(len(ids), WIDTH + 1)
            self.net.tables.reshape(-1, WIDTH)[ids] = values[:, :WIDTH]
            self.moved.reshape(-1)[ids] = values[:, WIDTH]


#: Embeddings of a row when networks are averaged.
_BLOCK = 256
_PART = "block int, shard int, ids array<int>, vals array<float>"


def _texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words), a bounded number of bytes at a time."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets, _PIECE_BYTES):
        _, _, _, bounds, hashes = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        for k in range(j - i):
            yield i + k, hashes[bounds[k] : bounds[k + 1]]


def _part_rows(block: int, shard: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([values.astype(np.float32)], pa.list_(pa.float32()))], ["block", "shard", "ids", "vals"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of block and shard: each id's mean over the shards that sent it."""
    block, total, n = None, np.zeros(0), np.zeros(0)

    def end() -> pa.RecordBatch:
        at = np.flatnonzero(n)
        return _part_rows(block, 0, at + max(0, block) * _BLOCK, (total[at] / n[at, None]).reshape(-1))

    for batch in batches:
        for b, ids, vals in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            ids, vals = ids.values.to_numpy().astype(np.int64), vals.values.to_numpy()
            if b != block:
                if block is not None:
                    yield end()
                block, size = b, len(ids) if b < 0 else _BLOCK
                total, n = np.zeros((size, len(vals) // len(ids))), np.zeros(size)
            ids = ids - max(0, b) * _BLOCK
            total[ids] += vals.reshape(len(ids), -1)
            n[ids] += 1
    if block is not None:
        yield end()


def fit(rows: DataFrame, counts: dict[int, int], size: int, seed: int = 7, sharpness: tuple[float | None, ...] = SHARPNESS) -> Network:
    """Gradient descent on the logistic loss over all rows (lid, text, toxic) of so many bytes; counts: rows of each class, which weigh alike."""
    sc = rows.sparkSession.sparkContext
    n = sum(counts.values())
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    weight = {k: 0.5 / c * n for k, c in counts.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for _, hashes in _texts_of(batch.column(0)):
                held[np.unique(cells(np.unique(hashes)))] += 1
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used], pa.int64())], ["cell", "n"])

    # only rows of words of several texts are used: all else, also what is never seen here, adds nothing
    common = rows.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS).select("cell").toArrow()
    known = np.zeros(1 << CELL_BITS, bool)
    known[common.column(0).to_numpy()] = True
    state = Fit(known, seed)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << TABLE_BITS), bool)
        for batch in batches:
            for _, hashes in _texts_of(batch.column(0)):
                for t, at in enumerate(buckets(hashes[known[cells(hashes)]])):
                    held[t, at] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held), pa.int32())], ["row"])

    unused = np.ones(2 << TABLE_BITS, bool)
    unused[rows.select("text").mapInArrow(use, "row int").distinct().toArrow().column(0).to_numpy()] = False
    state.net.tables.reshape(-1, WIDTH)[unused] = 0
    dealt = rows.select("lid", "text", "toxic", F.pmod(F.xxhash64("lid", F.lit(37)), F.lit(shards)).cast("int").alias("shard"))
    for epoch, sharp in enumerate(sharpness):
        shared = sc.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], sharp: float | None = sharp, epoch: int = epoch, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            shard, mine, rng, texts, labels = None, None, None, [], []

            def learn() -> None:
                if texts:
                    y = np.array(labels)
                    mine.learn(texts, y, np.array([weight[k] for k in labels]), sharp)
                    texts.clear()
                    labels.clear()

            def end() -> Iterator[pa.RecordBatch]:
                if shard is not None:
                    learn()
                    for part in mine.parts(shared.value.moved):
                        yield _part_rows(part[0], shard, *part[1:])

            for batch in batches:
                toxic, of = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for i, hashes in _texts_of(batch.column(0)):
                    if of[i] != shard:
                        yield from end()
                        shard, mine, rng = of[i], copy.deepcopy(shared.value), np.random.default_rng([seed, epoch, of[i]])
                    texts.append(hashes if sharp is None else hashes[rng.random(len(hashes)) >= DROPPED])
                    labels.append(toxic[i])
                    if len(texts) == BATCH:
                        learn()
            yield from end()

        ordered = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.xxhash64("lid", F.lit(epoch)), "text", "toxic")
        parts = ordered.select("text", "toxic", "shard").mapInArrow(run, _PART)
        # written, so that the shuffled texts of an epoch go with it
        written = materialize(parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average, _PART), "means")
        means = written.toArrow()
        discard(written)
        shared.unpersist()
        for block, ids, vals in zip(means.column("block").to_pylist(), means.column("ids"), means.column("vals"), strict=True):
            state.take(block, ids.values.to_numpy(), vals.values.to_numpy())
    return state.net


def guess_languages(net: Network, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of the most probable language of each text."""
    if not net.languages or len(bounds) < 2:
        return np.zeros(max(0, len(bounds) - 1), np.int64)
    logs = net.language_logs[(mix(hashes) >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64)]
    sums = np.add.reduceat(np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)]), bounds[:-1], axis=0, dtype=np.float64)
    return np.where(np.diff(bounds) > 0, sums.argmax(axis=1), 0)


def _errors(z: np.ndarray, y: np.ndarray, cuts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Wrong decisions of `z >= cut` for each cut that is no value of z; n: how many rows have such a value."""
    order = np.argsort(z, kind="stable")
    z, y, n = z[order], y[order], n[order]
    at = np.searchsorted(z, cuts)
    bad, good = (np.concatenate([[0], np.cumsum(n * (y == k))]) for k in (1, 0))
    return bad[at] + good[-1] - good[at]


def _best_threshold(z: np.ndarray, y: np.ndarray, all_z: np.ndarray, all_y: np.ndarray, prior: float = PRIOR_ROWS, n: np.ndarray | None = None, all_n: np.ndarray | None = None) -> float:
    """The logit with the fewest errors here and, with the weight of `prior` rows, everywhere; the middle of the widest such gap. n: rows of each entry, one by default."""
    n = np.ones(len(z)) if n is None else n
    all_n = np.ones(len(all_z)) if all_n is None else all_n
    values = np.unique(np.concatenate([z, all_z]))
    edges = np.concatenate([[values[0] - 2], values, [values[-1] + 2]])
    cuts = (edges[1:] + edges[:-1]) / 2
    errors = _errors(z, y, cuts, n) + prior / max(1, all_n.sum()) * _errors(all_z, all_y, cuts, all_n)
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(cuts[best[np.argmax(np.minimum(np.diff(edges)[best], 4.0))]])


def calibrate(net: Network, rows: DataFrame, least: int = LEAST_ROWS) -> Network:
    """A threshold for all, and one for each language that has enough labelled texts of both classes, from rows (text, toxic, lang).

    Rows are counted by language, class and logit in steps of 1 / LOGIT_CELLS; a language of fewer than `least` rows is not told apart.
    """
    sc = rows.sparkSession.sparkContext
    names = sorted(r["lang"] for r in rows.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("lang").collect())
    net.languages = names
    net.thresholds = np.zeros(max(1, len(names)))
    net.language_logs = np.zeros((1 << LANGUAGE_BITS, max(1, len(names))), np.float32)
    number = {k: i for i, k in enumerate(names)}
    if names:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(names), 1 << LANGUAGE_BITS), np.int64)
            for batch in batches:
                of = batch.column(1).to_pylist()
                for i, hashes in _texts_of(batch.column(0)):
                    if of[i] in number:
                        held[number[of[i]]] += np.bincount((mix(hashes) >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64), minlength=1 << LANGUAGE_BITS)
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held.reshape(-1)[at], pa.int64())], ["cell", "n"])

        found = rows.select("text", "lang").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(len(names) << LANGUAGE_BITS, 0.1)
        counts[found.column("cell").to_numpy()] += found.column("n").to_numpy()
        counts = counts.reshape(len(names), -1).T
        net.language_logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    shared = sc.broadcast(net)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets, _PIECE_BYTES):
                _, _, _, bounds, hashes = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                z = np.clip(np.rint(logits(shared.value, hashes, bounds) * LOGIT_CELLS), -LOGIT_MOST, LOGIT_MOST)
                own = guess_languages(shared.value, hashes, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(1).slice(i, j - i), pa.array(z, pa.int32())], ["own", "toxic", "z"])

    placed = rows.select("text", "toxic").mapInArrow(place, "own int, toxic int, z int").groupBy("own", "toxic", "z").agg(F.count(F.lit(1)).alias("n")).toArrow()
    shared.unpersist()
    own, y, z, n = (placed.column(k).to_numpy() for k in ("own", "toxic", "z", "n"))
    z = z / LOGIT_CELLS
    both = lambda m: n[m & (y == 1)].sum() >= 5 and n[m & (y == 0)].sum() >= 5
    everywhere = _best_threshold(z, y, z, y, n=n, all_n=n) if both(np.ones(len(z), bool)) else 0.0
    for k in range(len(net.thresholds)):
        mine = own == k
        net.thresholds[k] = _best_threshold(z[mine], y[mine], z, y, n=n[mine], all_n=n) if n[mine].sum() >= least and both(mine) else everywhere
    return net


def score_bytes(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1 of whole texts, a bounded number of bytes at a time."""
    n = len(offsets) - 1
    out = np.empty(n)
    for i, j in slices(offsets, _PIECE_BYTES):
        _, _, _, bounds, hashes = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        if net.constant is not None:
            out[i:j] = net.constant
            continue
        z = logits(net, hashes, bounds) - net.thresholds[guess_languages(net, hashes, bounds)]
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        if net.wordless is not None:
            out[i:j][np.diff(bounds) == 0] = net.wordless
    return out


def _labelled_only(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """The documents whose lid falls in a cell of some lid of `marked`: all of those with a label, and few others.

    So the join that follows moves the texts of labelled rows and not of all. The cells are bits
    of a fixed number; where there are more labels than cells, more rows pass, and the join is as right.
    """
    kinds = {df.schema["lid"].dataType.simpleString() for df in (documents, marked)}
    if kinds not in ({"bigint"}, {"int"}, {"string"}):  # other equal ids may not have equal hashes
        return documents
    cell = lambda: F.pmod(F.xxhash64("lid", F.lit(43)), F.lit(1 << ID_BITS))
    ones = marked.select(cell().alias("cell")).select(F.shiftright("cell", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
    found = ones.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (ID_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def marked_cell(cells: pa.Array) -> pa.Array:
        at = cells.to_numpy(zero_copy_only=False)
        return pa.array(shared.value[at >> 6] >> (at & 63) & 1 == 1)

    return documents.filter(marked_cell(cell()))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "toxic", held_out_of: int | None = 5) -> Network:
    """Fit and calibrate on labelled documents; with held_out_of = m, ids whose checksum is 0 modulo m stay out."""
    marked = labels.select(F.col(label_id_col).alias("lid"), F.col(label_col).cast("int").alias("toxic")).filter("lid is not null and toxic in (0, 1)")
    if held_out_of:
        marked = marked.filter(id_crc("lid") % held_out_of != 0)
        documents = documents.filter(id_crc(id_col) % held_out_of != 0)
    marked = marked.groupBy("lid").agg(F.max("toxic").alias("toxic"))
    documents = documents.select(F.col(id_col).alias("lid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # one row of four of each class is for the thresholds; a class of few rows serves for both
    aside = F.pmod(F.xxhash64("lid", F.lit(31)), F.lit(4)) == 3
    # shuffled on both sides at any size: labels grow with the documents
    near = _labelled_only(documents, marked).hint("merge")
    known = materialize(near.join(marked, "lid").select("lid", "text", "toxic", "lang", F.octet_length("text").cast("bigint").alias("size"), aside.alias("aside")), "labelled")
    sizes = {(r["toxic"], r["aside"]): (r["n"], r["size"]) for r in known.groupBy("toxic", "aside").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    classes = {k for k, _ in sizes}
    if len(classes) < 2:
        net = new_network()
        net.constant = min(0.499, float(1 in classes))
        return net
    total = {k: sum(n for (t, _), (n, _) in sizes.items() if t == k) for k in classes}
    fewer = [k for k in classes if total[k] < 40 or len({a for t, a in sizes if t == k}) < 2]
    fitted = {(k, a): v for (k, a), v in sizes.items() if not a or k in fewer}
    counts = {k: sum(n for (t, _), (n, _) in fitted.items() if t == k) for k in classes}
    both = F.col("toxic").isin(fewer) if fewer else F.lit(False)
    net = fit(known.filter(~F.col("aside") | both), counts, sum(size for _, size in fitted.values()))
    net = calibrate(net, known.filter(F.col("aside") | both))
    net.wordless = min(0.499, total[1] / sum(total.values()))
    discard(known)
    return net


def score(documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 if score >= 0.5) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_bytes(shared.value, *text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(documents: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The documents, all their columns, whose score is below 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    return filter_by_text(documents, text_col, lambda texts: score_bytes(shared.value, *text_bytes(texts)) < 0.5)
