"""Source divergence against a plain version, with odd rows and hot groups."""

import collections
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uptake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("term", "times", "total", "cells", "n", "p", "q", "zero", "item", "value", "rank", "part", "a b.c")


def frame(spark, rows):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return made.withColumns({c: F.lit("x") for c in CLASHES})


def plain(rows, least=3, most=200):
    """Every kept term in every group, one by one."""
    counts, total, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in [tuple(c or "" for c in r) for r in rows]:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        counts[lang, source].update(terms)
        total[lang].update(terms)
        texts[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in texts.items()}

    def shares(found, lang):
        terms = kept.get(lang, [])
        size = sum(found[t] for t in terms)
        return {t: 1 + 1000000000 * (found[t] + 1) // (size + len(terms)) for t in terms}
    out = []
    for (lang, source), found in counts.items():
        p, whole = shares(found, lang), shares(total[lang], lang)
        pairs = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                q = shares(counts[lang, other], lang)
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in p), other))
        terms = [(-((p[t] - whole[t]) ** 2 // whole[t]), t) for t in p if found[t] and p[t] > whole[t]]
        for part, ranked in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
            out += [(lang, source, part, item, -value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.source_divergence(frame(spark, rows), **options).collect())


WORDS = ["the", "The", "a", "of", "é", "É", "straße", "x1y", "don't", "𝔘", "ß[ß", "z"]
ROWS = [
    (" ".join(WORDS[(i * k) % len(WORDS)] for k in range(i % 9)), ["en", "de", None][i % 3], ["s1", "s2", None, "s4"][i % 4])
    for i in range(80)]


def test_against_a_plain_version(spark):
    assert found(spark, ROWS) == plain(ROWS)
    assert found(spark, ROWS, least_texts=1, most=2) == plain(ROWS, 1, 2)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(
    st.one_of(st.none(), st.lists(st.sampled_from(WORDS), max_size=8).map(" ".join)), st.sampled_from(["en", None]),
    st.sampled_from(["s1", "s2", "s3", None])), max_size=14))
def test_small_tables_against_a_plain_version(spark, rows):
    assert found(spark, rows, least_texts=2, most=3) == plain(rows, 2, 3)


def test_odd_rows(spark):
    assert found(spark, []) == []
    # A language without kept terms: pairs of value 0, in the order of their names.
    assert found(spark, [("one", "en", "b"), (None, "en", "a"), ("", "en", None)]) == [
        ("en", "", "pair", "a", 0, 1), ("en", "", "pair", "b", 0, 2), ("en", "a", "pair", "", 0, 1), ("en", "a", "pair", "b", 0, 2),
        ("en", "b", "pair", "", 0, 1), ("en", "b", "pair", "a", 0, 2)]
    assert found(spark, [("only", "en", "s")] * 5) == plain([("only", "en", "s")] * 5) == []
    # Repeated rows are documents of their own, and a very long text counts as one.
    long = ("word " * 400_000 + "b" * 200_000, "en", "s")
    rows = [long, *[("word other", "en", "t")] * 3, ("b" * 200_000, "en", "t"), ("b" * 200_000, "en", "u")]
    assert found(spark, rows) == plain(rows)


def test_ties_at_the_last_rank_go_by_bytes(spark):
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in ("z", "é", "𝔘", "ｚ")]
    rows = [(" ".join(names), "en", "s1")] * 3 + [("common", "en", "s2")] * 3
    mine = found(spark, rows, most=30)
    assert mine == plain(rows, most=30)
    assert [r[3] for r in sorted((r for r in mine if r[1:3] == ("s1", "term")), key=lambda r: r[5])] == sorted(names, key=str.encode)[:30]


def test_pieces_of_long_texts_and_flushes(spark, monkeypatch):
    data = b"ab cd " * 1000
    monkeypatch.setattr(divergence, "_PIECE", 100)
    assert sum(divergence.pieces(data), []) == data.split() and len(list(divergence.pieces(data))) > 50
    monkeypatch.setattr(divergence, "_MOST_TERMS", 3)
    assert found(spark, ROWS) == plain(ROWS)


@pytest.mark.parametrize("size", [(2, 2), (1000, 5000)])
def test_shares_are_exact_beyond_64_bits(spark, size):
    count = 10 ** 15 + 7
    row = spark.range(1).select(divergence._share(F.lit(count), F.lit(size[0] + count), F.lit(size[1])).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (count + 1) // (size[0] + count + size[1])
