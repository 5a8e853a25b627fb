"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased, so punctuation and line
breaks do not matter. The test items come in blocks of bounded size; for each block

1. one pass counts how often each word, pair and triple of the items occurs in all texts;
2. an item's seeds are its rare triples: those that occur, at most ``COMMON`` times as often as its
   median one. A leak repeated many times raises the median alike, so it stays found. Of any
   ``STRETCH`` consecutive triples the rarest stays as well, so every stretch of an item has a seed. Pairs
   and single words are seeds too where they are rare in the texts, and all pairs of items of up to ``SHORT`` words, which
   may have no triple left after an edit;
3. a second pass looks the seeds up in every text. A seed puts the item at a place in the text; the
   passage there is aligned word by word, unless it shares too few words to reach the threshold.

An alignment scores 2 for an equal word, -1 for another and -1 for a gap; the score of an item is
the best local alignment divided by that of an exact copy. Of a short item the words in common have to be so rare that
no more than one such passage is to be expected by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import quality, words
from uptake.llm.chunks import map_rows

N = 3
STRETCH = 4
COMMON = 16
SHORT = 8
RARE, RARE_SHARE = 16, 1e-7  # a rare pair or word: this often, and this share of all words more
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 20
_SIZE = words.mix(np.arange(N + 1, dtype=np.uint64) + np.uint64(77))


def word_hashes(table: pa.Table):
    """Hashes of all words of a table's texts, and each row's first word."""
    data, offsets = words.text_bytes(table.column("text"))
    starts, ends, first = quality.tokens(data, offsets)
    plain = np.r_[False, quality.is_word(data[starts])] if len(starts) else np.zeros(1, bool)
    return words.hash_words(data, starts[plain[1:]], ends[plain[1:]], fold=True), np.cumsum(plain)[first]


def grams(h, at, size):
    """Hashes of the ``size`` words from each place of ``at`` on."""
    out = h[at]
    for k in range(1, size):
        out = words.pair_up(out, h[at + k])
    return out ^ _SIZE[size]


def runs(known, first, size):
    """Places from which on ``size`` words of one text are all ``known``."""
    n = max(0, len(known) - size + 1)
    whole = known[:n].copy()
    for k in range(1, size):
        whole &= known[k:n + k]
        edge = first[1:-1] - k  # not across two texts
        whole[edge[(edge >= 0) & (edge < n)]] = False
    return np.flatnonzero(whole)


def _among(values, found):
    """For each of ``found`` its place in the sorted ``values``, -1 where it is not there."""
    if not len(values):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    return np.where(values[at] == found, at, -1)


class Items:
    """A block of test items with their words and n-grams."""

    def __init__(self, ids, texts):
        self.ids = ids
        h, first = word_hashes(pa.table({"text": pa.array(texts, pa.string())}))
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        self.known = np.unique(h)
        parts = []
        for size in range(1, N + 1):
            at = runs(np.ones(len(h), dtype=bool), first, size)
            item = np.searchsorted(first, at, side="right") - 1
            parts.append((grams(h, at, size), item, at - first[item], np.full(len(at), size)))
        gram, item, at, size = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.at, self.size = gram[order], item[order], at[order], size[order]
        self.share = np.ones(len(self.known))
        self.total = 0

    @classmethod
    def of(cls, state):
        """Items from the plain values of a broadcast."""
        items = cls.__new__(cls)
        items.__dict__ = state
        return items

    def keep_seeds(self, counts, total: int):
        """Keep the rare n-grams; ``counts`` maps an n-gram to its occurrences among ``total`` words."""
        known = np.array(sorted(counts), dtype=np.int64)
        times = np.array([counts[g] for g in known.tolist()], dtype=np.int64)
        at = _among(known, self.gram.view(np.int64))
        count = np.where(at >= 0, times[at] if len(times) else 0, 0)
        length = np.array([len(w) for w in self.words], dtype=np.int64)
        rare = RARE + RARE_SHARE * total
        keep = (self.size < N) & (count > 0) & ((count <= rare) | ((self.size == 2) & (length[self.item] <= SHORT)))
        # The triples of all items, in the order of their places.
        mine = np.flatnonzero((self.size == N) & (count > 0))
        mine = mine[np.lexsort((self.at[mine], self.item[mine]))]
        if len(mine):
            item, n = self.item[mine], count[mine]
            start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            many = np.diff(np.r_[start, len(item)])
            by_count = n[np.lexsort((n, item))]
            median = (by_count[start + (many - 1) // 2] + by_count[start + many // 2]) / 2
            keep[mine[n <= COMMON * np.repeat(median, many)]] = True
            # The rarest of every stretch, and of items shorter than one.
            last = np.repeat(start + many, many) - 1
            window = np.minimum(np.arange(len(n))[:, None] + np.arange(STRETCH)[None, :], last[:, None])
            begins = (np.arange(len(n)) + STRETCH - 1 <= last) | np.repeat(many < STRETCH, many)
            keep[mine[window[np.arange(len(n)), n[window].argmin(axis=1)][begins]]] = True
        at = _among(known, (self.known ^ _SIZE[1]).view(np.int64))
        self.share = np.where(at >= 0, times[at] if len(times) else 0, 0) / max(1, total)
        self.total = total
        self.gram, self.item, self.at, self.size = (x[keep] for x in (self.gram, self.item, self.at, self.size))
        return self

    def found(self, h, first):
        """(places in the words ``h``, entries of this block) of every seed that occurs there."""
        known, places, entries = _among(self.known, h) >= 0, [], []
        for size in range(1, N + 1):
            at = runs(known, first, size)
            gram = grams(h, at, size)
            low = np.searchsorted(self.gram, gram, side="left")
            n = np.searchsorted(self.gram, gram, side="right") - low
            hit = np.flatnonzero(n)
            n, low = n[hit], low[hit]
            entries.append(np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
            places.append(np.repeat(at[hit], n))
        return np.concatenate(places), np.concatenate(entries)

    def by_chance(self, shared):
        """How many passages with these words in common are to be expected among all texts; the words themselves
        where there is only one."""
        share = self.share[_among(self.known, shared)]
        return float(self.total * np.prod(share))


def align(item, passage):
    """(score, start, end) of the best local alignment; the span is in the passage."""
    width = len(passage)
    step = np.arange(width + 1) * GAP
    above, begun = np.zeros(width + 1), np.arange(width + 1)
    best = (0.0, 0, 0)
    for w in item:
        diagonal = above[:-1] + np.where(passage == w, MATCH, MISMATCH)
        row = np.zeros(width + 1)
        start = np.arange(width + 1)
        row[1:], start[1:] = diagonal, begun[:-1]
        up = above + GAP
        start = np.where(up > row, begun, start)
        row = np.maximum(row, up)
        start = np.where(row <= 0, np.arange(width + 1), start)
        row = np.maximum(row, 0)
        lifted = row - step  # a gap in the item carries the best cell to the left along
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(width + 1), 0))
        row, start = run + step, start[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (float(row[end]), int(start[end]), end)
        above, begun = row, start
    return best


def least_shared(n: int, threshold: float, least_words: int) -> float:
    """How many words of an item of n have to be in common: all of one or two, all but one of a short item."""
    return max(threshold * n, min(n if n < 3 else n - 1, least_words))


def leaked(table: pa.Table, items: Items, threshold: float, least_words: int):
    """(row, item, score, start, end) of each leaked item, the best passage of each row and item."""
    h, first = word_hashes(table)
    place, entry = items.found(h, first)
    row = np.searchsorted(first, place, side="right") - 1
    item = items.item[entry]
    origin = place - items.at[entry]  # where the item would begin
    order = np.lexsort((origin, item, row))
    out, i = {}, 0
    while i < len(order):
        k = order[i]
        r, it = int(row[k]), int(item[k])
        target = items.words[it]
        slack = len(target) // 2 + 2
        j, last = i, int(origin[k])
        # A passage collects the seeds that put the item at about the same place, whatever lies between.
        while j < len(order) and row[order[j]] == r and item[order[j]] == it and origin[order[j]] - last <= slack:
            last = int(origin[order[j]])
            j += 1
        low = max(int(first[r]), int(origin[k]) - slack)
        high = min(int(first[r + 1]), last + len(target) + slack)
        passage = h[low:high]
        shared = _shared(target, passage)
        need = least_shared(len(target), threshold, least_words)
        if len(shared) >= need:
            score, a, b = align(target, passage)
            score /= MATCH * len(target)
            if score >= threshold and score > out.get((r, it), (0,))[0] and _meant(items, target, passage[a:b], need):
                out[r, it] = (score, low - int(first[r]) + a, low - int(first[r]) + b)
        i = j
    return [(r, it, *x) for (r, it), x in out.items()]


def _meant(items, target, passage, need) -> bool:
    """Whether the aligned passage of a short item is more than chance; longer items are by their length."""
    if len(target) > SHORT:
        return True
    shared = _shared(target, passage)
    limit = RARE + RARE_SHARE * items.total if len(shared) == 1 else 1
    return len(shared) >= need and items.by_chance(shared) <= limit


def _shared(target, passage):
    """The words in common, repeats included: no alignment has more equal words."""
    values, count = np.unique(target, return_counts=True)
    at = np.minimum(np.searchsorted(values, passage), len(values) - 1)
    seen = np.bincount(at[values[at] == passage], minlength=len(values))
    return np.repeat(values, np.minimum(count, seen))


def _count(items):
    def count(batches):
        gram, known = np.unique(items.value["gram"]), items.value["known"]
        total, n = np.zeros(len(gram), dtype=np.int64), 0
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                h, first = word_hashes(table)
                n += len(h)
                here = _among(known, h) >= 0
                for size in range(1, N + 1):
                    at = _among(gram, grams(h, runs(here, first, size), size))
                    total += np.bincount(at[at >= 0], minlength=len(gram))
        seen = np.flatnonzero(total)
        yield pa.record_batch({
            "gram": pa.array([None, *gram[seen].view(np.int64).tolist()], pa.int64()), "n": pa.array([n, *total[seen].tolist()], pa.int64())})
    return count


def _blocks(docs, benchmark):
    """Blocks of items with their seeds, ready to be broadcast; each has at most BLOCK_WORDS words
    (or one item)."""
    context = docs.sparkSession.sparkContext
    ids, texts, size = [], [], 0

    def ready():
        block = context.broadcast(vars(Items(ids, texts)))
        counted = docs.select(F.col("text").cast("string")).mapInArrow(_count(block), "gram bigint, n bigint")
        counts = {r[0]: r[1] for r in counted.groupBy("gram").agg(F.sum("n")).collect()}
        total = counts.pop(None, 0)
        return context.broadcast(vars(Items(ids, texts).keep_seeds(counts, total)))

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        n = len(text.split())
        if ids and size + n > BLOCK_WORDS:
            yield ready()
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += n
    if ids:
        yield ready()


def _find(items, threshold, least_words):
    def find(batches):
        block = Items.of(items.value)
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                hits = leaked(table, block, threshold, least_words)
                doc_ids = table.column("doc_id").to_pylist()
                yield from pa.table({
                    "doc_id": pa.array([doc_ids[x[0]] for x in hits], pa.int64()),
                    "item_id": pa.array([block.ids[x[1]] for x in hits], pa.int64()),
                    "score": pa.array([x[2] for x in hits], pa.float64()),
                    "start_word": pa.array([x[3] for x in hits], pa.int64()),
                    "end_word": pa.array([x[4] for x in hits], pa.int64()),
                }).to_batches()
    return find


def _drop(items, threshold, least_words):
    def drop(batches):
        block = Items.of(items.value)
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                keep = np.ones(table.num_rows, dtype=bool)
                keep[[x[0] for x in leaked(table, block, threshold, least_words)]] = False
                yield from table.filter(pa.array(keep)).to_batches()
    return drop


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, least_words: int = 8) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): every item of ``benchmark`` (item_id, text)
    that a text of ``docs`` (doc_id, text) holds as a whole, in large part or in an edited form.

    One row per row of docs and item, for its best passage; words count from 0, the end is
    exclusive. The score is at least ``threshold`` and at least ``least_words`` words are shared; of items of up to nine words
    all but one, of one or two words all. Items of up to ``SHORT`` words are found only where the words in common are rare: at most one such
    passage is to be expected among all texts by the words' frequencies, and a single word stands in them ``RARE`` times or a
    ten-millionth of all words more. Items without id, text or words are ignored, as are NULL and
    empty texts; repeated items give repeated rows. Other columns are ignored; an empty table on
    either side gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], kind)
    for items in _blocks(docs, benchmark):
        out = out.unionByName(docs.mapInArrow(_find(items, threshold, least_words), kind))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, least_words: int = 8) -> DataFrame:
    """The rows of ``docs`` (with a column text, all columns are kept) in which ``leaks`` finds nothing."""
    out = docs
    for items in _blocks(docs, benchmark):
        out = map_rows(out, _drop(items, threshold, least_words))
    return out
