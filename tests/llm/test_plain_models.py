"""The classifier, the mixture and short test items against plain versions; samples that repeated ids would blow up."""

import math
import random
import re
import tracemalloc
import warnings

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA

from uptake.llm import leaks, mixing, quality, words

SF = f"{DATA}/sf0.001"
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d0-9A-Za-z\x80-\xff]+")


def slots(text, count):
    out = []
    for token in TOKEN.findall((text or "").encode()):
        data = np.frombuffer(token, dtype=np.uint8)
        out.append(int(words.hash_words(data, np.array([0]), np.array([len(data)]))[0] % np.uint64(count)))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows += [(900, None, "en"), (901, "", "en"), (902, "x", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_quality_against_a_plain_version(spark, sample):
    """Index vectors summed neighbour by neighbour, pooled token by token, and the network layer by layer."""
    rows, docs = sample
    place, sign = quality.index_vectors(quality.SLOTS, quality.DIMENSIONS)
    total = np.zeros((quality.SLOTS, quality.DIMENSIONS))
    tokens = {i: slots(t, quality.SLOTS) for i, t, _ in rows}
    for mine in tokens.values():
        for a, one in enumerate(mine):
            for b in range(max(0, a - 2), min(len(mine), a + 3)):
                if a != b:
                    for k in range(quality.NONZERO):
                        total[one, place[mine[b], k]] += sign[mine[b], k]
    vectors = np.array([v / max(1, math.sqrt((v * v).sum())) for v in total])
    assert np.allclose(quality.word_vectors(docs), vectors, atol=1e-6)

    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows[:30]], "doc_id long, label int")
    _, net, _ = quality._learned(docs, labels, 100)
    w1, b1, w2, b2 = net.weights
    found = {r.doc_id: r.score for r in quality.quality_scores(docs, labels, 100).collect()}
    for i, mine in tokens.items():
        x = np.zeros(2 * quality.DIMENSIONS + 2)
        if mine:
            v = vectors[mine]
            mean = sum(v) / len(v)
            near = sum(float(a @ b) for a, b in zip(v[:-1], v[1:])) / len(v)
            x = np.concatenate([mean, [math.sqrt(max(0, (c * c).mean() - c.mean() ** 2)) for c in v.T], [math.log(1 + len(v)), near]])
        x = (x - net.centre) / net.scale
        hidden = [max(0.0, float(x @ w1[:, j] + b1[j])) for j in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2)) + b2[0]
        assert found[i] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=2e-3)
    # The temperature has the smallest cross entropy on the rows that were not fitted.
    assert 0.25 <= net.temperature <= 8


def plain_rates(p, t, target, rounds=4000):
    gram = (p * t[:, None]).T @ p / t.sum()
    back = np.linalg.pinv(gram, rcond=1e-10)
    rate = np.ones(len(t))
    for _ in range(rounds):
        gap = (rate * t) @ p / t.sum() - target
        rate = np.maximum(0, rate - p @ (back @ gap))
    return rate


def shares(rate, p, t):
    return (rate * t) @ p / t.sum()


@pytest.mark.parametrize("target", [(0.5, 0.3, 0.2), (0.9, 0.08, 0.02), (0.1, 0.1, 0.8)])
def test_rates_against_plain_gradient_steps(spark, target):
    draw = np.random.default_rng(8)
    p, t = draw.dirichlet([0.4] * 3, 300), draw.integers(1, 90, 300)
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, posterior array<double>")
    expression = mixing._rate(mixing.fit_rates(soft, np.array(target)))
    rate = np.array([r[0] for r in soft.selectExpr(f"{expression} AS rate").collect()])
    assert (rate >= 0).all()
    # The plain steps are the safe ones and come close more slowly.
    assert np.allclose(shares(rate, p, t), target, atol=1e-6)
    assert np.allclose(shares(rate, p, t), shares(plain_rates(p, t, np.array(target)), p, t), atol=2e-3)


def test_targets_out_of_reach_are_told(spark):
    """No document is surely of the first domain, so rates cannot raise it alone."""
    p = np.array([[0.5, 0.5], [0.2, 0.8], [0.4, 0.6]] * 20)
    t = np.full(60, 10)
    soft = spark.createDataFrame([(10, x.tolist()) for x in p], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="miss a target"):
        steps = mixing.fit_rates(soft, np.array([0.9, 0.1]))
    rate = np.array([r[0] for r in soft.selectExpr(f"{mixing._rate(steps)} AS rate").collect()])
    back = np.linalg.pinv((p * t[:, None]).T @ p / t.sum(), rcond=1e-10)

    def loss(r):
        gap = shares(r, p, t) - np.array([0.9, 0.1])
        return gap @ back @ gap
    assert loss(rate) <= 1.05 * loss(plain_rates(p, t, np.array([0.9, 0.1])))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.fit_rates(soft, np.array([0.4, 0.6]))


def test_mixture_against_a_plain_version(spark, sample):
    rows, docs = sample
    labelled = docs.selectExpr("doc_id", "lang AS domain").where("doc_id % 2 = 0")
    targets = {"en": 0.5, "de": 0.3, "fr": 0.2}
    model = mixing.domain_classifier(docs, labelled, list(targets), 100)
    x = np.zeros((len(rows), mixing.FEATURES))
    for r, (_, text, _) in enumerate(rows):
        mine = slots(text, mixing.FEATURES)
        for s in mine:
            x[r, s] += 1 / len(mine)
    z = np.sqrt(x) @ model.weights + model.bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    t = np.array([len((text or "").encode().split()) for _, text, _ in rows])
    found = {r.doc_id: r for r in mixing.mix_to_targets(docs, labelled, targets, 100).collect()}
    mine = [found[i] for i, _, _ in rows]
    assert [r.n_tokens for r in mine] == t.tolist()
    assert np.allclose([r.posterior for r in mine], p, atol=1e-4)
    rate = np.array([r.rate for r in mine])
    assert np.allclose(shares(rate, p, t), shares(plain_rates(p, t, np.array(list(targets.values()))), p, t), atol=1e-3)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in mine)


def test_a_repeated_id_does_not_multiply_the_sample(spark, monkeypatch):
    rows = [(1, f"text {i % 3}") for i in range(600)] + [(i, f"other {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sizes, before = [], quality.bounded

    def counted(sample, columns, most):
        out = before(sample, columns, most)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(quality, "bounded", counted)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, label int")
    assert quality.quality_scores(docs, labels, 20).count() == len(rows)
    domains = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 40)], "doc_id long, domain string")
    assert mixing.mix_to_targets(docs, domains, {"a": 1, "b": 1}, 30).count() == len(rows)
    assert sizes[0] <= 20 and sizes[1] <= 30 and min(sizes) > 10


# ---- 9: short items ---------------------------------------------------------------------------

def test_short_items_whole_and_with_one_word_changed(spark):
    """Items of 1 to 8 words against whole-text alignment: those that share enough rare words, and no others."""
    draw = random.Random(6)
    common = [f"common{i}" for i in range(12)]
    filler = lambda n: [draw.choice(common) for _ in range(n)]
    items, rows, at = [], [], 0
    for n in range(1, 9):
        for form in range(4):
            item = [f"item{at}word{k}" for k in range(n)]
            if n > 4:
                item[1] = draw.choice(common)  # items hold frequent words too
            items.append((at, " ".join(item)))
            rows.append((at, " ".join(filler(30) + item + filler(30))))
            changed = list(item)
            changed[form * n // 4] = "changed"
            rows.append((1000 + at, " ".join(filler(30) + changed + filler(30))))
            at += 1
    rows += [(5000 + i, " ".join(filler(80))) for i in range(200)]
    items += [(900, "common1"), (901, "common1 common2"), (902, "common3 common4 common5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in leaks.leaks(docs, bench).collect()}

    block = leaks.Items([i for i, _ in items], [t for _, t in items])
    h, first = leaks.word_hashes(pa.table({"text": [t for _, t in rows]}))
    expected = {}
    for (i, _), passage in zip(rows, (h[a:b] for a, b in zip(first, first[1:]))):
        for (item, _), target in zip(items[:at], block.words):
            n = len(target)
            if len(leaks._shared(target, passage)) >= leaks.least_shared(n, 0.4, 8):
                score = leaks.align(target, passage)[0] / 2 / n
                if score >= 0.4:
                    expected[i, item] = score
    assert found == expected
    assert {(i, i) for i in range(at)} <= set(found)
    assert {i for i in range(at) if len(items[i][1].split()) >= 3} == {j for i, j in found if i >= 1000}
    sentence = "answer to question nine is forty three exactly"
    docs = spark.createDataFrame([(1, f"x y z {sentence.replace('three', 'two')} u v w"), (2, "x y z"), (3, "to is exactly the answer")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, sentence)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks.leaks(docs, bench).collect()] == [(1, 1)]


def test_every_third_word_replaced(spark):
    """No triple is left, but rare pairs are."""
    item = [f"w{i}" for i in range(30)]
    text = [f"z{i}" if i % 3 == 2 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["a b c", *text, "d e f"]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    row = leaks.leaks(docs, bench).first()
    assert (row.item_id, row.start_word) == (7, 3) and row.score >= 0.45


def test_seeds_of_many_items_take_linear_time():
    import time

    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 50_000, 40)) for _ in range(26_000)]
    items = leaks.Items(list(range(len(texts))), texts)
    counts = {int(g): int(n) for g, n in zip(*np.unique(items.gram.view(np.int64), return_counts=True))}
    began = time.time()
    seeds = items.keep_seeds(counts, 10 ** 9)
    assert time.time() - began < 5
    assert len(np.unique(seeds.item)) == len(texts)


def test_seeds_against_plain_rules():
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 14))) for _ in range(40)]
    items = leaks.Items(list(range(40)), texts)
    values = np.unique(items.gram.view(np.int64))
    counts = {int(g): draw.choice([0, 1, 2, 40, 500, 9000]) for g in values}
    before = [(int(g), int(i), int(a), int(s)) for g, i, a, s in zip(items.gram.view(np.int64), items.item, items.at, items.size)]
    expected = set()
    for item in range(40):
        length = len(texts[item].split())
        triples = sorted((a, g) for g, i, a, s in before if i == item and s == 3 and counts[g])
        if triples:
            median = np.median([counts[g] for _, g in triples])
            expected |= {(item, a, 3) for a, g in triples if counts[g] <= leaks.COMMON * median}
            for k in range(max(1, len(triples) - leaks.STRETCH + 1)):
                a, g = min(triples[k:k + leaks.STRETCH], key=lambda x: counts[x[1]])
                expected.add((item, a, 3))
        for g, i, a, s in before:
            if i == item and s < 3 and counts[g] and (counts[g] <= leaks.RARE + 1e-7 * 1000 or s == 2 and length <= leaks.SHORT):
                expected.add((item, a, s))
    seeds = items.keep_seeds(counts, 1000)
    assert set(zip(seeds.item.tolist(), seeds.at.tolist(), seeds.size.tolist())) == expected


def test_the_sample_reaches_the_driver_in_parts_and_is_held_once(spark, monkeypatch):
    """The driver holds half-precision rows, and no task sends all of them."""
    n, parts, before = 4000, [], quality.gathered

    def counted(sample, columns):
        found = before(sample, columns)
        parts.append(found.column("features").num_chunks)
        assert found.equals(found.sort_by([(c, "ascending") for c in columns]))
        return found
    monkeypatch.setattr(quality, "gathered", counted)
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(if(id % 97 < 50, 'red ', 'blue '), id % 89) AS text")
    labelled = docs.selectExpr("doc_id", "if(doc_id % 97 < 50, 'a', 'b') AS domain")
    tracemalloc.start()
    model = mixing.domain_classifier(docs, labelled, ["a", "b"], n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts[0] > 1 and most < 2.5 * n * mixing.FEATURES * 2
    text = docs.select("text").toArrow()
    found = model.posterior(mixing.features(text)).argmax(axis=1)
    assert (found == (np.arange(n) % 97 >= 50)).mean() > 0.9


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_rows_of_bytes_as_a_matrix(kind):
    rows = np.arange(60, dtype=np.float16).reshape(12, 5)
    whole = pa.array([r.tobytes() for r in rows], kind)
    column = pa.chunked_array([whole[:0], whole[2:7], whole[:2], whole[7:]], kind)
    assert quality.matrix(column, 5, np.float16).tolist() == rows[[2, 3, 4, 5, 6, 0, 1, 7, 8, 9, 10, 11]].tolist()
    assert quality.matrix(column[:0], 5, np.float16).shape == (0, 5)
