"""How far the sources of a language diverge from each other and from the language, by count cells.

1. One pass counts the terms of each (lang, source) group and in how many documents they stand; a task adds
   up its own documents first, so a frequent term costs one row per task and group.
2. In a group all terms with the same count there and the same count in the language share a cell, and so a
   value. Cells are valued, cells of equal value merged, and the values ranked by the cumulative
   number of their terms; only the cells that reach the ranks asked for are expanded to their terms, in
   UTF-8 order.
3. For pairs of sources, terms with equal counts in all sources are one row with a multiplicity. Only pairs of
   sources that share a term are listed from it: what a term adds where one or both lack it follows from the number
   of terms with each count.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uptake.llm.chunks import written

_MOST_TERMS = 400_000  # terms that a task adds up before it hands them on
_PIECE = 1 << 22
# A-Z become a-z, other ASCII that is no letter becomes a space; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: bytes):
    """The terms of a text, a list per few MB."""
    data, at = text.translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches):
    found, held = {}, 0

    def rows():
        columns = ([], [], [], [], [])
        for (lang, source), (times, texts) in found.items():
            columns[0].extend([lang] * len(times))
            columns[1].extend([source] * len(times))
            columns[2].extend(times)
            columns[3].extend(times.values())
            columns[4].extend(texts[t] for t in times)
        found.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "times", "texts"])
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            times, texts = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(times), set()
            for terms in pieces(text.as_py()):
                times.update(terms)
                new = set(terms) - seen
                texts.update(new)
                seen |= new
            held += len(times) - before
            if held >= _MOST_TERMS:
                yield rows()
                held = 0
    yield rows()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kept)), in decimals; no terms count as one."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", wide, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are below 10^9 + 2, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _terms_part(terms: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """The ``most`` highest values of each group's terms, with ranks."""
    group = ["lang", "source"]
    cells = terms.groupBy(*group, "times", "total").agg(F.count("*").alias("n"))
    p, q = _share(F.col("times"), F.col("size"), F.col("kept")), _share(F.col("total"), F.col("lang_size"), F.col("kept"))
    cells = cells.join(groups, group).select(*group, "times", "total", "n", p.alias("p"), q.alias("q")).where("p > q")
    cells = written(cells.select(*group, "times", "total", "n", _apart(F.col("p"), F.col("q")).alias("value")))
    merged = cells.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    high = Window.partitionBy(*group).orderBy(F.desc("value"))
    # Every value has a term at least, so no more than the first values count; Spark limits them before the shuffle.
    merged = merged.withColumn("place", F.row_number().over(high)).where(F.col("place") <= most)
    before = F.coalesce(F.sum("n").over(high.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = merged.select(*group, "value", before.alias("before")).where(F.col("before") < most)
    kept = written(cells.join(kept, [*group, "value"]).select(*group, "times", "total", "value", "before"))
    expanded = terms.join(kept, [*group, "times", "total"])
    ordered = Window.partitionBy(*group, "value").orderBy("term")
    expanded = expanded.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= most)
    rank = (F.col("before") + F.col("place")).cast("int")
    return expanded.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).where(
        F.col("rank") <= most)


def _pairs_part(vectors: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """The value of every other source of a group's language, summed over all kept terms, with ranks."""
    zero = _share(F.lit(0), F.col("size"), F.col("kept"))
    one = groups.select("lang", "source", "size", "kept", zero.alias("zero"))
    other = one.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    # All terms as if they stood in neither source.
    base = _apart(F.col("zero"), F.col("other_zero"))
    both = one.join(other, "lang").where("source != other").withColumn("base", base)
    sums = [both.select("lang", "source", F.col("other").alias("item"), (F.col("kept") * F.col("base")).alias("value"))]
    # Terms of one source, as if they stood in no other.
    spread = terms.groupBy("lang", "source", "times").agg(F.count("*").alias("n")).join(one, ["lang", "source"])
    spread = spread.select("lang", "source", "n", "zero", _share(F.col("times"), F.col("size"), F.col("kept")).alias("p"))
    spread = spread.join(other, "lang").where("source != other")
    p, p0, q0, n = (F.col(c) for c in ("p", "zero", "other_zero", "n"))
    sums.append(spread.select("lang", "source", F.col("other").alias("item"), n * (_apart(p, q0) - _apart(p0, q0))))
    sums.append(spread.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), n * (_apart(q0, p) - _apart(q0, p0))))
    # What changes for terms of both.
    shared = vectors.where(F.size("cells") > 1).groupBy("lang", "cells").agg(F.count("*").alias("n"))
    shared = shared.select("lang", "n", "cells", F.explode("cells").alias("x")).select("lang", "n", "x", F.explode("cells").alias("y"))
    shared = shared.where("x.source < y.source").select(
        "lang", "n", F.col("x.source").alias("source"), F.col("x.times").alias("times"),
        F.col("y.source").alias("other"), F.col("y.times").alias("other_times"))
    shared = shared.groupBy("lang", "source", "other", "times", "other_times").agg(F.sum("n").alias("n"))
    shared = shared.join(one, ["lang", "source"]).join(
        one.select("lang", F.col("source").alias("other"), F.col("size").alias("other_size"), F.col("zero").alias("other_zero")), ["lang", "other"])
    shared = shared.select(
        "lang", "source", "other", "n", "zero", "other_zero", _share(F.col("times"), F.col("size"), F.col("kept")).alias("p"),
        _share(F.col("other_times"), F.col("other_size"), F.col("kept")).alias("q"))
    q = F.col("q")
    sums.append(shared.select("lang", "source", F.col("other").alias("item"), n * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))))
    sums.append(shared.select(
        "lang", F.col("other").alias("source"), F.col("source").alias("item"), n * (_apart(q, p) - _apart(q, p0) - _apart(q0, p) + _apart(q0, p0))))
    rows = sums[0]
    for more in sums[1:]:
        rows = rows.union(more)
    rows = rows.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def source_divergence(docs: DataFrame, least_texts: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs`` (text, lang, source).

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language keeps the V terms that stand in at
    least ``least_texts`` of its rows. A group gives a kept term p = 1 + floor(10^9 * (count + 1) / (N + V)) with N the sum of its
    counts, and so does the language. Against q the value of p is floor((p - q)^2 / q). Part ``pair`` holds the group's other
    sources in its language, values summed over all kept terms; part ``term`` the terms that the group holds and whose
    p is above the language's, down to rank ``most``. Ranks go by descending value, ties by the item's UTF-8 bytes.

    NULL texts, languages and sources count as empty; a group without terms has p from zero counts; a language
    without kept terms has pairs of value 0. Every row counts as a document, repeated ones too. Other columns are
    ignored; an empty table gives no rows.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        _counted, "lang string, source string, term binary, times bigint, texts bigint")
    # One shuffle by language and term serves both sums; a term has at most a row per source and task.
    counted = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))
    cells = F.sort_array(F.collect_list(F.struct("source", "times")))
    vectors = counted.groupBy("lang", "term").agg(F.sum("texts").alias("texts"), F.sum("times").alias("total"), cells.alias("cells"))
    vectors = written(vectors.where(F.col("texts") >= least_texts).drop("texts"))
    terms = vectors.select("lang", "term", "total", F.explode("cells").alias("cell")).select("lang", "term", "total", "cell.*")
    sizes = terms.groupBy("lang", "source").agg(F.sum("times").alias("size"))
    vocabulary = vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    groups = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = written(groups.na.fill(0, ["size", "kept", "lang_size"]))
    return _pairs_part(vectors, terms, groups).unionByName(_terms_part(terms, groups, most))
