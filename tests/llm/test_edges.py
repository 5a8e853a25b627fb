"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from uptake.llm import (
    integers, interpolation, leaks, mixing, near_duplicates, quality, repeats, templates, token_counts, topk, url_filters,
)

TEXT = " ".join(f"word{i}" for i in range(30))
LONG = "a " * 60_000 + "b" * 300_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = (
    "chunk", "row_key", "carried", "score", "rate", "copies", "posterior", "n_tokens", "label", "domain", "train",
    "node", "key", "d1", "centre", "component_id", "kept", "spans", "host", "html", "classes", "item_id", "a b.c")


def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return frame.withColumns({c: F.lit("x") for c in CLASHES})


ROWS = [
    (1, TEXT), (2, TEXT), (2, TEXT), (3, None), (4, ""), (5, " \t\n "), (6, LONG), (None, TEXT), (7, "one"),
    (8, TEXT + " and more words here"), (9, None), (9, None)]


def test_repeats(spark):
    found = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in
                   repeats.remove_repeats(docs(spark, ROWS)).collect())
    # A NULL doc_id comes before all others; rows of document 2 repeat document 1 and the row without id.
    assert found == [
        (1, 30, 30), (2, 30, 30), (2, 30, 30), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 60001, 59999), (7, 1, 0),
        (8, 34, 30), (9, 0, 0), (9, 0, 0), (99, 30, 0)]
    cut = repeats.without_repeats(docs(spark, ROWS))
    assert cut.columns == docs(spark, ROWS).columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == {None, 3, 4, 5, 6, 7, 8, 9}
    assert texts[8] == "and more words here" and texts[5] == " \t\n " and texts[3] is None
    assert texts[6] == "a " + "b" * 300_000


def test_repeats_of_the_same_document(spark):
    same = repeats.remove_repeats(docs(spark, [(1, TEXT), (1, TEXT), (1, TEXT + "\n" + TEXT)]))
    assert sorted((r.n_words, r.n_removed) for r in same.collect()) == [(30, 0), (30, 0), (60, 30)]


def test_near_duplicates(spark):
    for size in (2, 5):
        found = sorted(
            ((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in
             near_duplicates.near_duplicates(docs(spark, ROWS), size=size).collect()), key=str)
        n = 31 - size
        assert sorted(found, key=str) == sorted([
            (0, n, None, True), (1, n, 1, True), (2, n, 1, False), (2, n, 1, False), (3, 0, 3, True), (4, 0, 4, True),
            (5, 0, 5, True), (6, 2, 6, True), (7, 1, 7, True), (8, n + 4, 1, False), (9, 0, 9, True), (9, 0, 9, True)], key=str)


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 1), (None, 1), (5, None), (5, 7)], "doc_id long, label int")
    scores = quality.quality_scores(docs(spark, ROWS), labels)
    assert scores.columns == ["doc_id", "score"]
    found = scores.collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert len({round(r.score, 12) for r in found if r.doc_id in (3, 4, 5, 9)}) == 1
    unlabelled = quality.quality_scores(docs(spark, ROWS), labels.where("false"))
    assert {r.score for r in unlabelled.collect()} == {0.5}
    good = quality.good_documents(docs(spark, ROWS), labels, least=0.0)
    assert good.columns == docs(spark, ROWS).columns and good.count() == len(ROWS)


def test_leaks(spark):
    items = spark.createDataFrame(
        [(1, TEXT), (1, TEXT), (2, None), (None, TEXT), (3, ""), (4, "two words")], "item_id long, text string")
    found = leaks.leaks(docs(spark, ROWS), items.withColumn("doc_id", F.lit(0)))
    assert sorted(map(str, {(r.doc_id, r.item_id, r.score) for r in found.collect()})) == sorted(
        map(str, {(1, 1, 1.0), (2, 1, 1.0), (8, 1, 1.0), (None, 1, 1.0)}))
    clean = leaks.without_leaks(docs(spark, ROWS), items)
    assert clean.columns == docs(spark, ROWS).columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 7, 9, 9]
    assert leaks.leaks(docs(spark, ROWS), items.where("false")).count() == 0


def test_mixing(spark):
    labelled = spark.createDataFrame([(1, "a"), (7, "b"), (8, "a"), (None, "b"), (6, None)], "doc_id long, domain string")
    mixed = mixing.mix_to_targets(docs(spark, ROWS), labelled, {"a": 3, "b": 1})
    assert [c for c in mixed.columns if c not in ("n_tokens", "posterior", "rate", "copies")] == [
        c for c in docs(spark, ROWS).columns if c not in ("n_tokens", "posterior", "rate", "copies")]
    rows = mixed.collect()
    assert len(rows) == len(ROWS) and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    assert sum(r.rate * r.n_tokens * r.posterior[0] for r in rows) / total == pytest.approx(0.75, abs=1e-5)
    unlabelled = mixing.mix_to_targets(docs(spark, ROWS), labelled.where("false"), {"a": 1, "b": 1}).collect()
    assert {round(r.rate, 6) for r in unlabelled} == {1.0}
    with pytest.raises(ValueError):
        mixing.mix_to_targets(docs(spark, ROWS), labelled, {"a": 0})


def test_token_counts(spark):
    import public_tokenizers

    found = token_counts.token_counts(docs(spark, ROWS), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found}
    assert (by[3].n_bytes, by[3].n_tokens, by[3].over_limit) == (0, 0, False)
    assert by[6].n_bytes == 420_000 and by[6].over_limit and by[1].n_tokens == by[None].n_tokens


def test_language_model(spark):
    found = interpolation.score_texts(docs(spark, ROWS).withColumn("train", F.expr("doc_id != 8"))).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found}
    assert by[3].n_tokens == 1 and by[3].score == by[4].score and not by[None].train and by[1].train
    assert by[8].n_tokens == 35 and by[8].n_known == 31 and by[8].score < by[1].score < 0
    untrained = interpolation.score_texts(docs(spark, ROWS).withColumn("train", F.lit(None))).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, round(r.score, 9)) for r in untrained} == {(0, 0, 0.0, 0.0)}


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 2.0]), (40, [2.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []),
            (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("score", F.lit("x"))
    found = topk.top_k(frame.where("vec_id % 20 = 0"), frame, k=4)
    assert sorted(tuple(r) for r in found.collect()) == [
        (20, 1, 1, 5), (20, 2, 1, 5), (20, 3, 2, 5), (20, 4, 40, 4),
        (40, 1, 1, 4), (40, 2, 1, 4), (40, 3, 2, 4), (40, 4, 20, 4)]
    assert topk.top_k(frame.where("false"), frame).count() == 0
    assert topk.top_k(frame, frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [1e3, 6.4e7, 1e12, 1e30, 1e200, 1e308])
def test_top_k_is_exact_at_any_size(spark, monkeypatch, size):
    """Against Python's integers: mixed sizes in one tile, ties, scores beyond 64 bits."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(size=8).clip(-1.7, 1.7) * (size if i % 3 else 1.0)).tolist()) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, [0.5] * 3), (220, [-0.5, 0.25, 1.0])]
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in rows}
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = {}
    for r in topk.top_k(frame.where("vec_id % 20 = 0"), frame, k=5, scale=64).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    for q, best in found.items():
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        assert best == [(i, -s if -(2 ** 63) <= -s < 2 ** 63 else None) for s, i in scores[:5]]


def test_one_pair_of_large_vectors_does_not_end_the_search(spark):
    rows = [(1, [6.4e7] * 8), (2, [6.4e7] * 8), (3, [1.0] * 8), (4, [1e30] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(frame, frame, k=2).collect()}
    assert found[1, 1] == (4, None) and found[1, 2] == (2, 8 * 64_000_000 ** 2)
    assert found[3, 2] == (1, 8 * 64_000_000) and found[4, 1] == (1, None)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_products_of_whole_numbers(data):
    width = data.draw(st.integers(1, 5))
    number = st.one_of(st.integers(-9, 9), st.integers(-(2 ** 31), 2 ** 31), st.integers(-(10 ** 40), 10 ** 40))
    left, right = (data.draw(st.lists(st.lists(number, min_size=width, max_size=width), min_size=1, max_size=4)) for _ in range(2))
    ours, theirs = (np.array(x, dtype=object).reshape(-1, width) for x in (left, right))
    expected = [[sum(a * b for a, b in zip(x, y)) for y in right] for x in left]
    assert integers.products(ours, theirs).tolist() == expected
    if max(abs(v) for row in left + right for v in row) < 2 ** 53:
        assert integers.products(ours.astype(np.int64), theirs.astype(np.int64)).tolist() == expected


def test_top_k_merges_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    frame = spark.range(1500).selectExpr("id AS vec_id", "array(double(id % 7), double(id % 11) - 5) AS vector").cache()
    vectors = {r.vec_id: r.vector for r in frame.collect()}
    found = {}
    for r in topk.top_k(frame.where("vec_id % 60 = 0"), frame, k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 1500, 60):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:20]
        assert found[q] == [(i, -s) for s, i in best]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "nowhere"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/x?q#f"), (6, "x://b.net/es/"),
            (6, "x://b.net/es/"), (None, "x://bad.org/p"), (7, "x://bad.org?p"), (8, "x://good.org/p"), (9, "x://a.com"), (10, "x://example.com/en")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASHES})
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), ("bad.org",), (None,), ("not.there",)], "key string").withColumn("host", F.lit("x"))
    found = sorted((tuple(r) for r in url_filters.judge_urls(pages, rules, listed).collect()), key=str)
    assert found == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (6, "b.net", "/es/", "net/es/", "block"),
        (6, "b.net", "/es/", "net/es/", "block"), (None, "bad.org", "/p", None, "block"), (7, "bad.org", "", None, "block"),
        (8, "good.org", "/p", None, "allow"), (9, "a.com", "", None, "allow"), (10, "example.com", "/en", "com/", "allow")], key=str)
    assert url_filters.judge_urls(pages.where("false"), rules, listed).count() == 0
    none = url_filters.judge_urls(pages, rules, listed.where("false")).where("rule IS NULL").collect()
    assert len(none) == 8 and {r.verdict for r in none} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    """Every third of 20,000 keys is listed; several levels are needed and none errs."""
    keys = spark.range(20_000).selectExpr("concat('h', id % 97, '.org/', id) AS key", "id % 3 = 0 AS listed")
    cascade = url_filters.Cascade(keys)
    assert len(cascade.levels) > 2
    wrong = keys.where(cascade.contains(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
    plan = keys.select(cascade.contains(F.col("key")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "Join") if x in plan]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div>
<{tag}><h1>Head &amp; tail</h1><p>One<br>two  <b>three</b> &lt;four&gt;</p><!-- no --><p>Five<p>Six
<div class="ad">Buy</div><form><p>Mail</p><input name=q></form></{tag}>
<aside>Side</aside><section id="comments"><{tag} class="comment">Said</{tag}></section><footer>&copy; 1</footer>"""
MAIN = "Head & tail\nOne two three <four>\nFive\nSix"


def test_pages(spark):
    rows = [(1, "x://a.org/1", PAGE.format(tag="article")), (2, "x://a.org/2", PAGE.format(tag="article")),
            (3, "x://b.org/1", PAGE.format(tag="main")), (4, None, None), (5, "x://a.org/3", ""), (6, "x://c.org", "bare &amp text"),
            (None, "x://a.org/4", PAGE.format(tag="article")), (7, "x://d.org", "<article>" + "<div>" * 3000 + "deep"),
            (8, "x://e.org", "<article><p>" + "word " * 100_000 + "</article><footer>f</footer>")]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in CLASHES if c != "html"})
    found = templates.main_texts(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    assert by[1] == by[2] == by[3] == by[None] == MAIN
    assert (by[4], by[5], by[6], by[7]) == ("", "", "bare & text", "deep")
    assert by[8] == ("word " * 100_000).strip()
    assert templates.main_texts(pages.where("false")).count() == 0


@pytest.mark.parametrize("rows", [[], ROWS])
def test_empty_and_odd_tables_pass_every_stage(spark, tmp_path, rows):
    table = docs(spark, rows)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "mixing":
            assert out.columns == table.columns and out.dtypes == table.dtypes
        n = out.count()
        assert n <= len(rows) and (n == 0) == (not rows)
    for frame in (
        interpolation.score_texts(table.withColumn("train", F.lit(True))), near_duplicates.near_duplicates(table),
        repeats.remove_repeats(table), quality.quality_scores(table, spark.read.parquet(f"{tmp_path}/labels.parquet").withColumnRenamed("quality", "label"))):
        assert frame.count() == len(rows)


def test_kept_words_digest(spark):
    row = repeats.remove_repeats(docs(spark, [(1, " a  b\nc ")])).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256(b"a b c").hexdigest()
