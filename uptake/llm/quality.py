"""Text quality: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters, digits and bytes above 0x7F, and runs of other visible characters.
Every token has a sparse random index vector (``NONZERO`` entries of +1 or -1, given by its hash);
its word vector is the sum of the index vectors of the two tokens on either side, over the whole corpus. Tokens share
a table of ``slots`` rows by hash, so the table's size is fixed whatever the vocabulary, and it may
be broadcast. A document is the mean and the spread of its tokens' unit vectors, with the mean
product of neighbours and the log of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import words
from uptake.llm.chunks import map_rows

SLOTS = 1 << 15
DIMENSIONS = 32
NONZERO = 2
REACH = 2
_ROWS = 1024  # slots per row of a partial table
_PARTS = 16  # in which a sample reaches the driver


def _kinds():
    """0 for white space, 1 for letters, digits and bytes above 0x7F, 2 for all others."""
    kind = np.full(256, 2, dtype=np.uint8)
    kind[[32, 9, 10, 11, 12, 13]] = 0
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[low:high] = 1
    return kind


def is_word(first_bytes):
    """Which tokens are runs of letters, digits and bytes above 0x7F."""
    return _kinds()[first_bytes] == 1


def tokens(data, offsets):
    """(starts, ends, first) as words.find_words gives them, for the tokens of this module."""
    if len(data) == 0:
        return words.find_words(data, offsets)
    k = _kinds()[data]
    opens = np.r_[True, k[1:] != k[:-1]]
    opens[offsets[(offsets > 0) & (offsets < len(data))]] = True
    edges = np.flatnonzero(opens)
    shown = k[edges] != 0
    starts, ends = edges[shown], np.r_[edges[1:], len(data)][shown]
    return starts, ends, np.searchsorted(starts, offsets)


def token_slots(table: pa.Table, slots: int):
    """The slot of every token and each row's first token."""
    data, offsets = words.text_bytes(table.column("text"))
    starts, ends, first = tokens(data, offsets)
    return (words.hash_words(data, starts, ends) % np.uint64(slots)).astype(np.int64), first


def index_vectors(slots: int, dimensions: int):
    """Places and signs of the entries of each slot's index vector."""
    h = words.mix(np.arange(slots * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(slots, NONZERO)
    return (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def add_contexts(total, slot, first, slots, dimensions):
    """Add to each token's row the index vectors of its neighbours in the same document."""
    place, sign = index_vectors(slots, dimensions)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, REACH + 1):
        if len(slot) <= step:
            return
        same = doc[step:] == doc[:-step]
        left, right = slot[:-step][same], slot[step:][same]
        for here, there in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(
                    here * dimensions + place[there, k], weights=sign[there, k], minlength=len(total)).astype(np.int64)


def _contexts(slots, dimensions):
    def contexts(batches):
        total = np.zeros(slots * dimensions, dtype=np.int64)
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                slot, first = token_slots(table, slots)
                add_contexts(total, slot, first, slots, dimensions)
        step = _ROWS * dimensions
        parts = [total[a:a + step] for a in range(0, len(total), step)]
        yield pa.record_batch({
            "part": pa.array(range(len(parts)), pa.int32()),
            "sums": pa.array([x.tobytes() for x in parts], pa.binary()),
        })
    return contexts


def _add_up(key, table):
    total = 0
    for x in table.column("sums").to_pylist():
        total = total + np.frombuffer(x, dtype=np.int64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, slots: int = SLOTS, dimensions: int = DIMENSIONS):
    """The unit word vectors of all slots, from every text of ``docs``."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_contexts(slots, dimensions), "part int, sums binary")
    parts = parts.groupBy("part").applyInArrow(_add_up, "part int, sums binary").collect()
    total = np.zeros((slots // _ROWS, _ROWS * dimensions), dtype=np.int64)
    for row in parts:
        total[row.part] = np.frombuffer(row.sums, dtype=np.int64)
    return unit(total.reshape(slots, dimensions))


def unit(vectors):
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (vectors / np.maximum(norm, 1)).astype(np.float32)


def pooled(table: pa.Table, vectors):
    """Mean and spread of each row's token vectors, how alike neighbours are, and the log length."""
    slot, first = token_slots(table, len(vectors))
    count = np.diff(first)
    out = np.zeros((len(count), 2 * vectors.shape[1] + 2), dtype=np.float32)
    width = vectors.shape[1]
    for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b > a:
            mean = square = alike = 0
            for at in range(a, b, 1 << 16):  # long texts in steps
                part = vectors[slot[at:min(b, at + (1 << 16))]]
                mean = mean + part.sum(axis=0, dtype=np.float64)
                square = square + (part * part).sum(axis=0, dtype=np.float64)
                alike += float((part[1:] * part[:-1]).sum(dtype=np.float64))
            mean = mean / (b - a)
            out[r, :width] = mean
            out[r, width:2 * width] = np.sqrt(np.maximum(square / (b - a) - mean ** 2, 0))
            out[r, 2 * width] = np.log1p(b - a)
            out[r, 2 * width + 1] = alike / (b - a)
    return out


class Network:
    """Standardised inputs, one hidden layer, one logit, divided by a temperature."""

    def __init__(self, inputs: int, hidden: int = 48, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.centre, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [
            draw.normal(0, (2 / inputs) ** 0.5, (inputs, hidden)), np.zeros(hidden),
            draw.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        self.temperature = 1.0

    def _forward(self, x):
        w1, b1, w2, b2 = self.weights
        inner = np.maximum(x @ w1 + b1, 0)
        return inner, inner @ w2 + b2[0]

    def logit(self, x):
        return self._forward((x - self.centre) / self.scale)[1]

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))

    def fit(self, x, y, epochs: int = 25, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7):
        """Adam on the cross entropy."""
        draw = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        x = (x - self.centre) / self.scale
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        t = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at:at + 256]
                inner, logit = self._forward(x[rows])
                error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y[rows]) / len(rows)
                back = np.outer(error, self.weights[2]) * (inner > 0)
                steps = [x[rows].T @ back, back.sum(axis=0), inner.T @ error, np.array([error.sum()])]
                t += 1
                for k, g in enumerate(steps):
                    g = g + decay * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    fixed = first[k] / (1 - 0.9 ** t)
                    self.weights[k] = self.weights[k] - rate * fixed / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def calibrate(self, x, y):
        """The temperature with the smallest cross entropy on rows that were not fitted."""
        logit, best = self.logit(x), (np.inf, 1.0)
        for temperature in np.geomspace(0.25, 8, 101):
            z = logit / temperature
            loss = (np.logaddexp(0, z) - y * z).mean()
            best = min(best, (loss, temperature))
        self.temperature = float(best[1])
        return self


def train(x, y):
    """A fitted and calibrated network; every fifth row only calibrates. None without both classes."""
    fitted = np.arange(len(y)) % 5 != 4
    if len(set(y[fitted].tolist())) < 2:
        return None
    net = Network(x.shape[1]).fit(x[fitted], y[fitted])
    return net.calibrate(x[~fitted], y[~fitted]) if (~fitted).any() else net


def _pool(vectors):
    def pool(batches):
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                rows = pooled(table, vectors.value)
                yield from pa.table({
                    "doc_id": table.column("doc_id"), "label": table.column("label"),
                    "pooled": pa.array([x.tobytes() for x in rows], pa.binary())}).to_batches()
    return pool


def _score(vectors, net, otherwise, least=None):
    def score(batches):
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                rows = pooled(table, vectors.value)
                scores = net.score(rows) if net else np.full(table.num_rows, otherwise)
                if least is None:
                    out = table.drop_columns(["text"]).append_column("score", pa.array(scores, pa.float64()))
                else:
                    out = table.filter(pa.array(scores >= least))
                yield from out.to_batches()
    return score


def bounded(sample: DataFrame, columns, most: int) -> DataFrame:
    """At most ``most`` rows of a labelled sample, those with the smallest hashes of their ids; equal rows count once. A doc_id
    that very many rows share would multiply the sample otherwise."""
    return sample.dropDuplicates(columns).orderBy(F.xxhash64("doc_id"), *columns).limit(most)


def gathered(sample: DataFrame, columns) -> pa.Table:
    """A bounded sample on the driver, in the order of ``columns``, of which doc_id is the first. Tasks by ranges of doc_id send
    a part each; the limit's one task would send all rows at once."""
    return sample.repartitionByRange(_PARTS, "doc_id").sortWithinPartitions(*columns).toArrow()


def matrix(column: pa.ChunkedArray, width: int, dtype):
    """The rows of a column of bytes, of ``width`` numbers each, without a copy besides the result."""
    out, at = np.empty((len(column), width), dtype=dtype), 0
    for chunk in column.chunks:
        if len(chunk):
            chunk = chunk.cast(pa.large_binary())
            first = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset]
            rows = np.frombuffer(chunk.buffers()[2], dtype=dtype, count=len(chunk) * width, offset=first)
            out[at:at + len(chunk)] = rows.reshape(-1, width)
            at += len(chunk)
    return out


def _learned(docs, labels, most_labelled):
    """What scoring needs: word vectors (broadcast), the network, and the score without one."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most_labelled)
    sample = docs.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    sample = sample.mapInArrow(_pool(vectors), "doc_id bigint, label int, pooled binary")
    columns = ["doc_id", "label", "pooled"]
    sample = gathered(bounded(sample, columns, most_labelled), columns)
    y = sample.column("label").to_numpy().astype(np.float64)
    x = matrix(sample.column("pooled"), 2 * DIMENSIONS + 2, np.float32)
    order = np.argsort(words.mix(sample.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    return vectors, train(x[order].astype(np.float64), y[order]), float(y.mean()) if len(y) else 0.5


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): how likely label 1 is, 0 to 1.

    ``labels`` holds (doc_id, label) with label 0 or 1; other labels are ignored. The network learns from at
    most ``most_labelled`` labelled rows (those with the smallest hashes of their ids), the word
    vectors from all texts. NULL and empty texts have a zero vector and get its score. Without rows
    of both classes every score is the share of label 1, 0.5 if there are none. Rows without
    doc_id are scored; other columns are ignored; an empty table gives an empty table.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _score(*_learned(docs, labels, most_labelled)), "doc_id bigint, score double")


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7, most_labelled: int = 40_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    return map_rows(docs, _score(*_learned(docs, labels, most_labelled), least))
