"""Mixing documents to target weights of domains, with soft membership.

A softmax classifier, learned from a labelled table, gives every document a posterior over the
domains. Document i with t_i words and posterior p_i at rate r_i >= 0 contributes r_i t_i p_i to the
expected words per domain. The rates minimise the squared distance of the totals, as shares of the
corpus, from the targets, starting from rate 1 for all:

    s = sum(r_i t_i p_i) / sum(t_i),  G = sum(t_i p_i p_i') / sum(t_i)
    minimise (s - w)' G^+ (s - w) / 2 over r >= 0

In the metric of the words t_i the gradient for document i is p_i . G^+ (s - w), its Lipschitz
constant is 1, so projected gradient steps of length 1 are safe and without clipping one suffices.
Documents at rate 0 do not move; G over the others gives longer steps, used while the gap shrinks.
A step needs one vector with an entry per domain, so each iteration is one distributed sum over a
small table, and a document's rate is a function of its posterior and the vectors so far.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uptake.llm import quality, words
from uptake.llm.chunks import map_rows, written

FEATURES = 1024
_OWN = ("n_tokens", "posterior", "rate", "copies")


def features(table: pa.Table):
    """Square roots of the shares of hashed tokens in each text."""
    slot, first = quality.token_slots(table, FEATURES)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    x = np.bincount(row * FEATURES + slot, minlength=len(count) * FEATURES).reshape(len(count), FEATURES)
    return np.sqrt(x / np.maximum(count, 1)[:, None]).astype(np.float32)


class Softmax:
    """Multinomial logistic regression."""

    def __init__(self, classes: int):
        self.weights, self.bias = np.zeros((FEATURES, classes)), np.zeros(classes)

    def posterior(self, x):
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x, y, epochs: int = 15, rate: float = 0.05, decay: float = 1e-5, seed: int = 5):
        """Adam on the cross entropy."""
        draw, hot = np.random.default_rng(seed), np.eye(len(self.bias))
        self.bias = np.log(np.maximum(np.bincount(y, minlength=len(self.bias)), 0.5) / max(len(y), 1))
        moments, t = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.weights, self.bias)], 0
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for at in range(0, len(y), 256):
                rows = order[at:at + 256]
                part = np.asarray(x[rows], dtype=np.result_type(x, np.float32))  # half precision only as stored
                error = (self.posterior(part) - hot[y[rows]]) / len(rows)
                steps, t = [part.T @ error + decay * self.weights, error.sum(axis=0)], t + 1
                for value, moment, g in zip((self.weights, self.bias), moments, steps):
                    moment[0] = 0.9 * moment[0] + 0.1 * g
                    moment[1] = 0.999 * moment[1] + 0.001 * g * g
                    value -= rate * moment[0] / (1 - 0.9 ** t) / (np.sqrt(moment[1] / (1 - 0.999 ** t)) + 1e-8)
        return self


def _gather(batches):
    for batch in batches:
        for table in words.batched_rows(pa.Table.from_batches([batch])):
            yield from pa.table({
                "doc_id": table.column("doc_id"), "domain": table.column("domain"),
                # Half precision is plenty for shares, and half the bytes for the driver.
                "features": pa.array([x.tobytes() for x in features(table).astype(np.float16)], pa.binary())}).to_batches()


def _judge(model, keep_all):
    def judge(batches):
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                p = model.posterior(features(table))
                _, _, first = words.find_words(*words.text_bytes(table.column("text")))
                own = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.reshape(-1)))
                count = pa.array(np.diff(first), pa.int64())
                out = table.append_column("n_tokens", count) if keep_all else pa.table({"n_tokens": count})
                yield from out.append_column("posterior", own).to_batches()
    return judge


def domain_classifier(docs: DataFrame, labelled: DataFrame, domains, most_labelled: int = 20_000) -> Softmax:
    """A classifier of texts into ``domains``, learned from at most ``most_labelled`` rows of
    ``labelled`` (doc_id, domain) and as many texts, those with the smallest hashes of their ids. Rows with other
    domains are ignored, equal rows of one doc_id count once; without any row the posterior is even."""
    known = labelled.where(F.col("domain").isin(*domains)).select(F.col("doc_id").cast("long"), "domain")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most_labelled)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = texts.join(F.broadcast(known), "doc_id").mapInArrow(_gather, "doc_id bigint, domain string, features binary")
    columns = ["doc_id", "domain", "features"]
    sample = quality.gathered(quality.bounded(sample, columns, most_labelled), columns)
    y = np.array([domains.index(d) for d in sample.column("domain").to_pylist()], dtype=np.int64)
    x = quality.matrix(sample.column("features"), FEATURES, np.float16)
    del sample
    return Softmax(len(domains)).fit(x, y) if len(y) else Softmax(len(domains))


def _rate(steps, rate: str = "1D"):
    """The rate after the given steps, as SQL over the column posterior."""
    for h in steps:
        move = " + ".join(f"posterior[{k}] * {float(v)!r}D" for k, v in enumerate(h))
        rate = f"greatest(0D, {rate} - ({move}))"
    return rate


def fit_rates(soft: DataFrame, weights, iterations: int = 100, tolerance: float = 1e-7):
    """Steps of the projected gradient for ``soft`` (n_tokens, posterior) and target shares. Warns where the last
    rates miss a target by more than a thousandth of the corpus, as for a domain without documents."""
    k = range(len(weights))
    pairs = [(i, j) for i in k for j in k if i <= j]
    steps, done, start, gap, last, worst, safe = [], 0, "1D", None, None, np.inf, False
    for _ in range(iterations):
        rate = _rate(steps[done:], start)
        rated = soft.selectExpr("n_tokens", "posterior", f"{rate} AS rate")
        sums = rated.selectExpr(
            "sum(n_tokens) AS n", *[f"sum(n_tokens * rate * posterior[{i}]) AS s{i}" for i in k],
            *[f"sum(n_tokens * posterior[{i}] * posterior[{j}]) AS g{i}_{j}" for i, j in pairs],
            *[f"sum(if(rate > 0, n_tokens, 0) * posterior[{i}] * posterior[{j}]) AS a{i}_{j}" for i, j in pairs]).first()
        if not sums["n"]:
            return []
        last, gap = gap, np.array([sums[f"s{i}"] for i in k]) / sums["n"] - np.asarray(weights, float)
        if np.abs(gap).max() < tolerance or safe and np.abs(gap - last).max() < tolerance:
            break

        def towards(name):
            gram = np.array([[sums[f"{name}{min(i, j)}_{max(i, j)}"] for j in k] for i in k]) / sums["n"]
            return np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ gap
        # The metric of the documents that still move is the faster one; the safe one if it overshoots or, where the
        # targets are out of reach, moves nothing.
        step = towards("a")
        safe = np.abs(gap).max() >= worst or np.abs(step).max() < tolerance
        step = towards("g") if safe else step
        worst = np.abs(gap).max()
        if np.abs(step).max() < tolerance:
            break
        if len(steps) - done == 8:  # keep the expression short
            soft, done, start = written(rated), len(steps), "rate"
        steps.append(step)
    if gap is not None and np.abs(gap).max() > 1e-3:
        warnings.warn(f"the rates miss a target by {np.abs(gap).max():.2g} of the corpus", stacklevel=2)
    return steps


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most_labelled: int = 20_000, seed: int = 11,
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with n_tokens (words of the text), posterior
    (one entry per domain in the order of ``targets``), rate and copies.

    ``targets`` are made to sum to 1. Over all rows the sums of rate * n_tokens * posterior are in
    proportion to the targets and keep the corpus's size, as far as nonnegative rates allow (a
    domain without any document cannot be met). ``copies`` is the rate rounded up or down at
    random with its mean kept, by a hash of doc_id and text. NULL and empty texts have no words and the posterior of
    an empty text. Repeated rows are separate documents with equal rates. Columns of ``docs``
    with the names of these results are replaced; an empty table gives an empty table.
    """
    if any(w < 0 for w in targets.values()) or not sum(targets.values()) > 0:
        raise ValueError("targets must be nonnegative and not all 0")
    domains = list(targets)
    weights = np.array([targets[d] for d in domains]) / sum(targets.values())
    docs = docs.drop(*_OWN).withColumn("text", F.col("text").cast("string"))
    model = domain_classifier(docs, labelled, domains, most_labelled)
    own = T.StructType().add("n_tokens", T.LongType()).add("posterior", T.ArrayType(T.DoubleType()))
    soft = written(docs.select("text").mapInArrow(_judge(model, False), own))
    steps = fit_rates(soft, weights)
    out = map_rows(docs, _judge(model, True), own.fields)
    out = out.withColumn("rate", F.expr(_rate(steps)))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
