"""Operators against SQL, brute force, libraries and planted cases."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA, compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from uptake.llm import (
    chunks, components, interpolation, leaks, mixing, near_duplicates, quality, queries, repeats, token_counts, words,
)

SF = f"{DATA}/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def small_chunks():
    """Several chunks and blocks even for small tables."""
    before = chunks.in_chunks.__defaults__, interpolation.CHUNK_BYTES, near_duplicates._BLOCK_ROWS
    chunks.in_chunks.__defaults__ = (40_000, False)
    interpolation.CHUNK_BYTES, near_duplicates._BLOCK_ROWS = 40_000, 16
    yield
    chunks.in_chunks.__defaults__, interpolation.CHUNK_BYTES, near_duplicates._BLOCK_ROWS = before


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    _, message = compare(contract.queries()[name](spark, SF), connect(SF), contract.oracle_sql()[name])
    assert not message, message


def test_registry():
    names = {n: [q for q in contract.queries() if q.startswith(f"op{n}_")] for n in range(1, 14)}
    assert all(len(found) == 1 for found in names.values()) and "pipeline" in contract.queries()


def test_native_query_has_no_python(spark):
    plan = queries.QUERIES["op8_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "Join") if x in plan]


# ---- words ------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ é\n\t\x0b\x0c\r\x1c\xa0 ", max_size=30), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    data, offsets = words.text_bytes(pa.chunked_array([pa.array(texts, pa.string())]))
    starts, ends, first = words.find_words(data, offsets)
    raw = data.tobytes()
    found = [[raw[a:b] for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert found == [t.encode().split() for t in texts]
    for fold in (False, True):
        hashes = words.hash_words(data, starts, ends, fold).tolist()
        flat = [w.lower() if fold else w for row in found for w in row]
        assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_hash_does_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"w{i}" for i in range(2000))
    data, offsets = words.text_bytes(pa.chunked_array([pa.array([text])]))
    starts, ends, _ = words.find_words(data, offsets)
    whole = words.hash_words(data, starts, ends)
    monkeypatch.setattr(words, "_BLOCK", 64)
    assert (words.hash_words(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 2000


# ---- 7: repeats -------------------------------------------------------------------------------

def brute_repeats(texts, length):
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        w = text.encode().split()
        gone = [False] * len(w)
        for at in range(len(w) - length + 1):
            window = tuple(w[at:at + length])
            if window in seen:
                gone[at:at + length] = [True] * length
            seen.add(window)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("vocabulary, length, anchor", [(2, 10, 5), (3, 20, 8), (40, 12, 6)])
def test_repeats_against_brute_force(spark, vocabulary, length, anchor):
    draw = random.Random(vocabulary)
    passage = [f"p{draw.randint(0, 3)}" for _ in range(60)]
    texts = {}
    for i in range(150):
        w = [f"v{draw.randint(1, vocabulary)}" for _ in range(draw.randint(0, 80))]
        if i % 3 == 0:
            at = draw.randint(0, 30)
            w[draw.randint(0, len(w)):0] = passage[at:at + draw.randint(5, 30)]
        texts[i] = draw.choice([" ", "\n", "  "]).join(w)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in repeats.remove_repeats(frame, length, anchor, group_size=50).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in found.items()} == brute_repeats(texts, length)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in found.values())
    cut = {r.doc_id: r.text for r in repeats.without_repeats(frame, length, anchor).collect()}
    assert {i: t.split() for i, t in cut.items()} == {
        i: r.kept_text.split() for i, r in found.items() if r.kept_text or not r.n_words}


def test_hot_paths_are_split(spark):
    rows = [("chunk", p, n) for p, n in ((0x1111_2222_3333, 60), (0x1111_2222_4444, 60), (0x1111_5555_6666, 5), (0x7777_1111_1111, 50))]
    frame = spark.createDataFrame(rows, "chunk string, p long, n long").selectExpr("array(p) AS paths", "array(n) AS suffixes")
    total, hot = repeats.split_paths(frame, 55, 1000)
    assert total == 175 and [h.tolist() for h in hot] == [[0x1111], [0x1111_2222], [0x1111_2222_3333, 0x1111_2222_4444]]
    keys = np.array([p << 16 | k for _, p, _ in rows for k in (1, 2)], dtype=np.uint64)
    groups = repeats._group_of(keys, hot, 1 << 30)
    # Only under the two hottest paths suffixes with other last words may part.
    assert groups[4] == groups[5] and groups[6] == groups[7] and len(set(groups.tolist())) == 6


@pytest.mark.parametrize("copied", [False, True])
def test_hot_anchors_do_not_fill_a_group(spark, monkeypatch, copied):
    """A phrase of 8 words in most texts, with other words around it or in exact copies."""
    draw = random.Random(4)

    def rank(phrase):
        data, offsets = words.text_bytes(pa.chunked_array([pa.array([" ".join(phrase)])]))
        return int(words.mix(repeats.anchor_keys(words.hash_words(data, *words.find_words(data, offsets)[:2]), 8))[0])
    # One that most windows around it elect.
    phrase, lead = min(([f"hot{k}_{i}" for i in range(8)] for k in range(60)), key=rank), [f"lead{i}" for i in range(9)]
    texts = {}
    for i in range(900):
        around = [f"v{draw.randint(1, 10 ** 6)}" for _ in range(30)]
        w = around[:15] + phrase + around[15:]
        if copied and i % 3:  # some of the windows around the phrase stand in many texts, often twice in one
            w = around[:3] + lead + phrase + [f"tail{i % 2}"] * 9 + lead + phrase + [f"tail{i % 2}"] * 9
        texts[i] = draw.choice([" ", "\n"]).join(w)
    frame = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string").repartition(4)
    grow = repeats._grow

    def counting(*how):
        run = grow(*how)

        def counted(key, table):
            assert sum(map(len, table.column("docs").to_pylist())) <= 300
            return run(key, table)
        return counted
    monkeypatch.setattr(repeats, "_grow", counting)
    found = repeats.remove_repeats(frame, 20, 8, group_size=60).collect()
    expected = brute_repeats(texts, 20)
    assert len(found) == 901 and all((r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id] for r in found)
    assert any(n for _, n, _ in expected.values()) == copied


# ---- 10: near duplicates ----------------------------------------------------------------------

def brute_components(texts, size, per_cent):
    sets = {}
    for i, text in texts.items():
        w = text.lower().encode().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= per_cent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(spark, size):
    draw = random.Random(size)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(160):  # a large group of edited copies, in which not all are similar to the first
        w = list(base)
        for _ in range(draw.randint(0, 14)):
            w[draw.randrange(len(w))] = f"x{draw.randint(0, 500)}"
        texts[i] = " ".join(w)
    for i in range(200, 280):
        texts[i] = " ".join(f"u{draw.randint(0, 400)}" for _ in range(draw.randint(0, 60)))
    for i in range(300, 340):
        texts[i] = texts[draw.choice(list(texts))].upper()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_duplicates.near_duplicates(frame, size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(texts, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 300)]
    edges = spark.createDataFrame(path + star + [(500, 500)], "a long, b long")
    found = {r.node: r.label for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}}


def test_signature_estimates_similarity():
    draw = np.random.default_rng(3)
    shared = draw.integers(0, 2 ** 63, 900).astype(np.uint64)
    sets = [np.sort(np.r_[shared, draw.integers(0, 2 ** 63, 100).astype(np.uint64)]) for _ in range(2)]
    first = np.array([0, 1000, 2000])
    signature = near_duplicates.packed_signature(near_duplicates.minima(np.concatenate(sets), first, 512))
    assert near_duplicates.estimated(signature[0], signature[1:])[0] == pytest.approx(900 / 1100, abs=0.08)


# ---- 1: tokens --------------------------------------------------------------------------------

def test_token_counts_equal_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = token_counts.stretch_counter(token_counts.read_vocabulary(path))
    draw = random.Random(1)
    parts = [*"abcdeth on▁  \n\té😀<s>ßñ中文!!##||...  ", "    ", "the ", "▁▁", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "​"]
    texts = ["", " ", "  ", "▁", "a" * 5000, " " * 300 + "x", "aaaa bbbb" * 100]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    assert [token_counts.count_tokens(t, counts) for t in texts] == [len(x) for x in library.encode(texts)]


# ---- 5: language model ------------------------------------------------------------------------

def plain_model(texts, held, weights=None):
    """Counts, left-out events and weights of a text model, token by token; (scores, weights)."""
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()

    def grams(w):
        padded = ["end", "end", *w]
        return list(zip(padded, padded[1:], w))
    for i, w in texts.items():
        if not held[i]:
            one.update(w)
            two.update((v, x) for _, v, x in grams(w))
            three.update(grams(w))
    n, types, starts = sum(one.values()), len(one), sum(not held[i] for i in texts)

    def estimates(u, v, x, own_one, own_two, own_three, length, first):
        """The bucket and the four estimates, a text's own counts deleted."""
        context = one[v] - own_one[v]
        pair = two[v, x] - own_two[v, x]
        far = context if first else two[u, v] - own_two[u, v]
        triple = pair if first else three[u, v, x] - own_three[u, v, x]
        bucket = ("pair", far.bit_length()) if far else ("word", context.bit_length())
        return bucket, (triple / max(far, 1), pair / max(context, 1), (one[x] - own_one[x]) / max(n - length, 1), 1 / (types + 1))
    none = collections.Counter()
    if weights is None:
        events = collections.defaultdict(list)
        for i, w in texts.items():
            if not held[i]:
                own = collections.Counter(w), collections.Counter((v, x) for _, v, x in grams(w)), collections.Counter(grams(w))
                for k, g in enumerate(grams(w)):
                    bucket, p = estimates(*g, *own, len(w), k == 0)
                    events[bucket].append(p)
        weights = {}
        for bucket, p in events.items():
            p, weight = np.array(p), np.full(4, 0.25)
            for _ in range(100):
                share = p * weight
                weight = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1
                weight /= weight.sum()
            weights[bucket] = weight
    scores = {}
    for i, w in texts.items():
        score = 0.0
        for k, g in enumerate(grams(w)):
            bucket, p = estimates(*g, none, none, none, 0, k == 0)
            score += math.log10(float(np.dot(weights.get(bucket, (0, 0, 0, 1)), p)))
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (types + 1))) for x in w)
        scores[i] = (len(w), sum(one[x] > 0 for x in w), n, base, score)
    return scores, weights


def test_language_model_against_brute_force(spark, monkeypatch):
    kept, fit = {}, interpolation.fit_weights

    def remembered(events, types):
        kept["weights"] = fit(events, types)
        return kept["weights"]
    monkeypatch.setattr(interpolation, "fit_weights", remembered)
    found = {r.doc_id: r for r in queries.QUERIES["op5_language_model"](spark, SF).collect()}
    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        texts[r.doc_id] = [*folded.encode().split(), "end"]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    mine = {("pair" if b >= interpolation._LEVEL else "word", b % interpolation._LEVEL): w for b, w in enumerate(kept["weights"])}
    same, _ = plain_model(texts, held, mine)
    own, weights = plain_model(texts, held)
    assert set(weights) == {b for b, w in mine.items() if w[3] != 1}
    sums = np.zeros(2)
    for i, (tokens, known, n, base, score) in same.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        # A plain model that fits its own weights, from probabilities that are not binned.
        assert r.score == pytest.approx(own[i][4], rel=0.01)
        if held[i]:
            sums += (base, score)
    assert sums[1] > sums[0]  # better than word frequencies on texts it has not seen


def test_packed_counts():
    counts = np.array([0, 1, 254, 255, 256, 2 ** 40, 3])
    blob = interpolation.packed_counts(counts)
    assert len(blob) == 7 + 3 * 8 and interpolation.unpacked_counts(blob, 7).tolist() == counts.tolist()


def test_weights_by_expectation_maximisation():
    never = interpolation._NEVER
    # In bucket 3 triples always predict well, in bucket 1 never, in the pairs' bucket 2 pairs do.
    events = {interpolation._code(3, 0, 90, 80): 1000, interpolation._code(1, never, never, 4): 1000, interpolation._code(74, never, 1, 40): 1000}
    weights = interpolation.fit_weights(events, types=10 ** 6)
    assert weights[3][0] > 0.99 and weights[1][2] > 0.9 and weights[74][1] > 0.9 and weights[9].tolist() == [0, 0, 0, 1]
    assert np.allclose(weights.sum(axis=1), 1)


def test_only_triples_that_may_occur_elsewhere_are_asked():
    """Where all pairs are the chunk's own, so are all triples, and none is sent."""
    texts = [" ".join(f"w{(i * k) % 400}" for k in range(60)) for i in range(1, 40)]
    batch = pa.table({"chunk": [0] * 39, "row_key": range(39), "doc_id": range(39), "train": [True] * 39, "text": texts})
    blob = pa.Table.from_batches(list(interpolation._pack(batch.to_batches())))
    tokens = interpolation._Tokens(blob, 2)
    assert tokens.table.column("text").to_pylist() == [t.encode() for t in texts]
    answers = lambda bit: {int(tokens.pairs.bucket[a]): (b"", bit * (b - a)) for a, b in tokens.pairs.spans()}
    alone = tokens.triples(answers(b"\x00"))
    assert not alone.spans() and alone.totals({}).tolist() == alone.count.tolist()
    every = tokens.triples(answers(b"\xff"))
    assert sum(b - a for a, b in every.spans()) == len(every.key) == len(alone.key)


@pytest.mark.parametrize("most", [7, 1 << 40, 1 << 62])
def test_distinct_numbers_and_their_places(most):
    code = np.random.default_rng(1).integers(0, min(most, 900), 2000)
    code[0] = most - 1
    for some in (code, code[:1], code[:0]):
        distinct, index = interpolation._distinct(some, most)
        expected, places = np.unique(some, return_inverse=True)
        assert distinct.tolist() == expected.tolist() and index.tolist() == places.reshape(-1).tolist()


def test_a_chunk_sorts_places_once(monkeypatch):
    """Only words need an argsort; counts of a text's own keys skip what occurs once, and equal plain counts."""
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(60)) for i in range(1, 40)] + ["", "a a a a b a a"]
    n = len(texts)
    batch = pa.table({"chunk": [0] * n, "row_key": range(n), "doc_id": range(n), "train": [i % 5 != 1 for i in range(n)], "text": texts})
    blob = pa.Table.from_batches(list(interpolation._pack(batch.to_batches())))
    sorts, owns, unique, own = [], [], np.unique, interpolation._own

    def counted(values, *args, **named):
        if named.get("return_inverse"):
            sorts.append(len(values))
        return unique(values, *args, **named)

    def kept(doc, index, *several):
        found = own(doc, index, *several)
        owns.append((found.tolist(), [sum((doc == d) & (index == i)) for d, i in zip(doc, index)]))
        return found
    monkeypatch.setattr(np, "unique", counted)
    monkeypatch.setattr(interpolation, "_own", kept)
    tokens = interpolation._Tokens(blob, 2)
    everything = {}
    for keys in (tokens.words, tokens.pairs):
        for a, b in keys.spans():
            everything[int(keys.bucket[a])] = (interpolation.packed_counts(keys.count[a:b]), b"\x00" * (b - a))
    answers = pa.table({"bucket": list(everything), "totals": [t for t, _ in everything.values()], "shared": [x for _, x in everything.values()]})
    sorts.clear()
    interpolation._events(2, len(tokens.token))(None, blob, answers)
    assert sum(sorts) <= len(tokens.token)
    assert len(owns) == 3 and all(mine == plain for mine, plain in owns)


# ---- 3, 9, 2 ----------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    """Most labels of the larger table's held-out rows are met."""
    sf = f"{DATA}/sf0.01"
    scored = queries.QUERIES["op3_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.3])
def test_edited_items_are_found(spark, rate):
    """Exactly those whose alignment with the whole text reaches the threshold: seeds lose none."""
    draw = random.Random(9)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    vocabulary = [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect() for w in r.text.split()]
    rows = []
    for i, text in items:
        edited = [draw.choice(vocabulary) if draw.random() < rate else w for w in text.split()]
        edited = [w for w in edited if draw.random() >= rate / 4]
        rows.append((i, " ".join([*draw.choices(vocabulary, k=50), *edited, *draw.choices(vocabulary, k=50)])))
    rows += [(1000 + i, " ".join(draw.choices(vocabulary, k=300))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, bench).collect()}
    block = leaks.Items([i for i, _ in items], [t for _, t in items])
    h, first = leaks.word_hashes(pa.table({"text": [t for _, t in rows]}))
    whole = [leaks.align(w, h[a:b])[0] / 2 / len(w) for w, a, b in zip(block.words, first, first[1:])]
    assert found == {(i, i) for i, score in zip(block.ids, whole) if score >= 0.4}
    assert rate > 0.1 or len(found) == len(items)
    assert leaks.without_leaks(docs, bench).count() == len(rows) - len(found)


def test_items_in_several_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, leaks.leaks(docs, bench).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 120)
    assert sorted(map(tuple, leaks.leaks(docs, bench).collect())) == whole != []


def brute_alignment(item, passage):
    table, best = [[0] * (len(passage) + 1)], 0
    for a in item:
        row = [0]
        for j, b in enumerate(passage, 1):
            row.append(max(0, table[-1][j - 1] + (2 if a == b else -1), table[-1][j] - 1, row[-1] - 1))
        table.append(row)
        best = max(best, *row)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=15))
def test_alignment_against_the_plain_recurrence(item, passage):
    score, start, end = leaks.align(np.array(item), np.array(passage, dtype=np.int64))
    assert score == brute_alignment(item, passage) and 0 <= start <= end <= len(passage)
    # The reported span alone reaches the score.
    assert brute_alignment(item, passage[start:end]) == score


def test_mixture_meets_its_targets(spark):
    rows = queries.QUERIES["op2_mixing"](spark, SF).collect()
    total = sum(r.n_tokens for r in rows)
    for name, share in queries.WITH_JUNK.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows) / total == pytest.approx(share, abs=1e-4)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_rates_against_a_plain_projected_gradient(spark):
    draw = np.random.default_rng(5)
    p, t = draw.dirichlet([0.3] * 3, 400), draw.integers(1, 50, 400)
    soft = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, posterior array<double>")
    target = np.array([0.9, 0.08, 0.02])
    rate = np.ones(400)
    for h in mixing.fit_rates(soft, target):
        rate = np.maximum(0, rate - p @ h)
    assert np.allclose((rate * t) @ p / t.sum(), target, atol=1e-6) and (rate == 0).any()


# ---- pipeline ---------------------------------------------------------------------------------

def test_pipeline_on_planted_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    clean = [r.text for r in docs.orderBy(F.desc("n_chars")).limit(12).collect()]
    draw = random.Random(2)
    texts = [" ".join(draw.sample(t.split(), min(200, len(t.split())))) for t in clean]
    passage = " ".join(f"passage{i}" for i in range(60))
    edited = texts[0].split()
    edited[7] = "changed"
    rows = dict(enumerate(texts))
    rows |= {100: texts[0], 101: " ".join(edited), 102: texts[1] + " " + passage, 103: texts[2] + " tail " + passage,
             104: texts[3][::-1] + " " + items[0], 105: texts[4][::-1] + "\n" + items[1].replace(" ", "\n")}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["near_duplicates"](spark, frame, SF).collect()}
    assert kept == set(rows) - {100, 101}
    cut = {r.doc_id: r for r in stages["substrings"](spark, frame, SF).collect()}
    assert passage in cut[102].text and "passage5" not in cut[103].text and cut[103].text.endswith("tail ")
    assert all(cut[i].text == texts[i] and cut[i].n_chars == len(texts[i]) for i in range(12))
    found = {r.doc_id for r in stages["decontamination"](spark, frame, SF).collect()}
    assert found == set(rows) - {104, 105}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "mixing"]
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) < 200 and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert all(1 <= r.copy <= r.copies for r in rows)


def test_pipeline_leaves_no_tables_but_the_last_stages(spark):
    import os

    chunks.sweep(spark)
    out = corpus_pipeline.run(spark, SF)
    left = os.listdir(chunks._own_folder(spark))
    with chunks.recorded() as made:
        corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert 1 <= len(left) <= 3 and len(made) <= 2
    assert out.count() > 0


def test_repeated_rows_leave_the_copies_stage_once(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (6, text + " end"), (7, "one two"), (7, "one two"), (7, "three"), (None, text), (None, text), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [
        (5, text), (7, "one two"), (7, "three"), (None, text), (None, text), (8, None)]))


def test_mixing_stage_rows_have_the_target_shares(spark):
    """Documents without copies go, others come as often as their copies say."""
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' OR doc_id % 3 = 0")
    rows = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, sf).select("doc_id", "lang", "n_tokens", "copies", "copy", "text").collect()
    total = sum(r.n_tokens for r in rows)
    share = {k: sum(r.n_tokens for r in rows if r.lang == k) / total for k in queries.LANGUAGES}
    assert all(abs(share[k] - w) < 0.04 for k, w in queries.LANGUAGES.items()), share
    seen = collections.Counter((r.doc_id, r.text) for r in rows)
    times = collections.Counter((r.doc_id, r.text, r.copy) for r in rows)
    assert max(seen.values()) > 1 and 0 < len(seen) < docs.count()
    assert all(1 <= r.copy <= r.copies and seen[r.doc_id, r.text] == r.copies * times[r.doc_id, r.text, 1] for r in rows)


def test_sweep_removes_what_was_written(spark):
    import os

    folder = chunks._own_folder(spark)
    assert chunks.written(spark.range(5)).count() == 5 and os.listdir(folder)
    chunks.sweep(spark)
    assert not os.path.exists(folder)
