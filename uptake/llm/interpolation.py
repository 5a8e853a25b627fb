"""Language-model scores by deleted interpolation of n-gram estimates.

Tokens are lower-cased words and one end per text; before a text's first word stand two ends. With counts
c over the training texts, N tokens and V types, the probability of w after u v is

    l3(b) * c(u v w) / c(u v)  +  l2(b) * c(v w) / c(v)  +  l1(b) * c(w) / N  +  l0(b) / (V + 1)

where b is the bucket of the context's frequency, 1, 2-3, 4-7 and so on: that of c(u v), or of c(v) where u v
does not occur. The weights of each bucket come from
expectation-maximisation on held-out counts: every training text in turn is left out, that is, its
own occurrences are deleted from the counts before its words are predicted.

The counts stay distributed. Each chunk of texts sends its distinct words and pairs of words with
their counts to buckets of keys and gets the totals back in the same order; so a frequent word costs
one entry per chunk, and what is gathered grows with the corpus. Triples follow in a second exchange, but only those
whose two pairs both stand in other chunks as well: all others stand in the chunk alone, so its own count is
the total. For the weights, events are summed
in a histogram of the probabilities (two steps per factor of two), whose size is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import chunks, words

END = np.uint64(0xE7D5C0DE5EED0001)
CHUNK_BYTES = 6 << 20
_STEPS = 2
_NEVER = 1 << 8  # the bin of probability 0
_LEVEL = 72  # buckets of the frequencies of words; those of pairs follow
_PACK_BYTES = 16 << 20


def packed_counts(counts):
    """Counts as a byte each; 255 stands for a larger one, which follows behind all."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked_counts(blob, n: int):
    counts = np.frombuffer(blob, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob[n:], dtype=np.int64)
    return counts


def _pack(batches):
    """Rows of (chunk, row_key, doc_id, text, train) as one compressed blob per chunk and a few MB of a task."""
    import zstandard

    packer, held, size = zstandard.ZstdCompressor(level=3), {}, 0

    def blobs():
        chunk, out = [], []
        for key, rows in held.items():
            ids, keys, train, texts = zip(*rows)
            numbers = np.array([[i is not None for i in ids], [i or 0 for i in ids], keys, train, [len(t) for t in texts]], dtype=np.int64)
            chunk.append(key)
            out.append(np.int64(len(rows)).tobytes() + packer.compress(numbers.tobytes() + b"".join(texts)))
        held.clear()
        return pa.record_batch({"chunk": pa.array(chunk, pa.int32()), "blob": pa.array(out, pa.binary())})
    for batch in batches:
        text = batch.column("text").cast(pa.binary()).to_pylist()
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_id", "row_key", "train")), text):
            row[-1] = row[-1] or b""
            held.setdefault(key, []).append(row)
            size += 64 + len(row[-1])
            if size > _PACK_BYTES:
                yield blobs()
                size = 0
    yield blobs()


def _unpack(blobs):
    """The rows of a chunk in their order."""
    import zstandard

    reader, tables = zstandard.ZstdDecompressor(), []
    for blob in blobs.column("blob").to_pylist():
        n, data = int(np.frombuffer(blob[:8], dtype=np.int64)[0]), reader.decompress(blob[8:])
        known, ids, keys, train, lengths = np.frombuffer(data[:40 * n], dtype=np.int64).reshape(5, n)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].tobytes()), pa.py_buffer(data[40 * n:])])
        tables.append(pa.table({
            "doc_id": pa.array(ids, mask=known == 0), "row_key": pa.array(keys), "train": pa.array(train == 1), "text": text}))
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("train", pa.bool_()), ("text", pa.large_binary())])
    return chunks.ordered(pa.concat_tables(tables) if tables else schema.empty_table())


class _Tokens:
    """The tokens of a chunk: their distinct words and pairs, in the order in which they are asked."""

    def __init__(self, blobs, buckets):
        self.table, self.buckets = _unpack(blobs), buckets
        data, offsets = _bytes(self.table.column("text"))
        starts, ends, first = words.find_words(data, offsets)
        rows = len(first) - 1
        counts = np.diff(first) + 1
        self.first = np.r_[0, np.cumsum(counts)]
        last = self.first[1:] - 1
        token = np.empty(int(self.first[-1]), dtype=np.uint64)
        inner = np.ones(len(token), dtype=bool)
        inner[last] = False
        token[inner] = words.hash_words(data, starts, ends, fold=True)
        token[last] = END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = END
        self.doc = np.repeat(np.arange(rows), counts)
        self.train = self.table.column("train").to_numpy().astype(bool)
        self.learned = self.train[self.doc]
        self.token, pair = token, words.pair_up(before, token)
        self.words = _Keys(token, self.learned, 0, buckets)
        self.before = np.empty(len(token), dtype=np.int64)  # the key of the word before, the end's at the start
        if rows:
            self.before[1:] = self.words.index[:-1]
            self.before[self.first[:-1]] = self.words.index[last[0]]
        types = len(self.words.key)
        self.pairs = _Keys(pair, self.learned, buckets, buckets, code=self.before * types + self.words.index, most=types ** 2)
        # Places that have two words of their text before them, or an end and a word.
        later = np.ones(len(token), dtype=bool)
        later[self.first[:-1]] = False
        self.later, self.pair = np.flatnonzero(later), pair

    def triples(self, answers):
        """The distinct triples; those that must be asked are the ones whose pairs both stand in other chunks too."""
        at, elsewhere = self.later, self.pairs.elsewhere(answers)
        asked = elsewhere[self.pairs.index[at - 1]] & elsewhere[self.pairs.index[at]]
        types = len(self.words.key)
        code, most = self.pairs.index[at - 1] * types + self.words.index[at], len(self.pairs.key) * types
        key = words.pair_up(self.pair[at - 1], self.token[at])
        return _Keys(key, self.learned[at], 2 * self.buckets, self.buckets, asked, code, most)


def _bytes(column):
    """As words.text_bytes, for a column of bytes without NULLs."""
    column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _distinct(code, most):
    """Distinct numbers of 0 to ``most`` - 1 in order, and each number's place among them. Where a number and its place fit
    into one integer these are sorted: that takes less time than the argsort of np.unique."""
    bits = len(code).bit_length()
    if int(most).bit_length() + bits > 63:
        distinct, index = np.unique(code, return_inverse=True)
        return distinct, index.reshape(-1)
    packed = np.sort(code.astype(np.int64) << bits | np.arange(len(code)))
    at = packed & ((1 << bits) - 1)
    packed >>= bits
    new = np.r_[True, packed[1:] != packed[:-1]][:len(packed)]
    index = np.empty(len(code), dtype=np.int64)
    index[at] = np.cumsum(new) - 1
    return packed[new], index


class _Keys:
    """Distinct keys with their counts in the chunk, by bucket; those of which no place is ``asked`` come last."""

    def __init__(self, key, learned, base, buckets, asked=None, code=None, most=0):
        if code is None:
            distinct, index = np.unique(key, return_inverse=True)
            index = index.reshape(-1)
        else:  # numbers below ``most`` that tell the keys apart
            numbers, index = _distinct(code, most)
            distinct = np.empty(len(numbers), dtype=np.uint64)
            distinct[index] = key
        count = np.bincount(index[learned], minlength=len(distinct))
        bucket = (words.mix(distinct) % np.uint64(buckets)).astype(np.int64)
        if asked is not None:
            alone = np.ones(len(distinct), dtype=bool)
            alone[index[asked]] = False
            bucket[alone] = buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        bucket = bucket[order]
        self.key, self.count = distinct[order], count[order]
        self.bucket = np.where(bucket < buckets, base + bucket, np.iinfo(np.int64).max)
        self.index = rank[index]
        open_ = int(np.searchsorted(self.bucket, np.iinfo(np.int64).max))
        self.cuts = np.flatnonzero(np.r_[True, self.bucket[1:open_] != self.bucket[:max(0, open_ - 1)], True]) if open_ else np.zeros(1, int)

    def spans(self):
        return list(zip(self.cuts[:-1], self.cuts[1:]))

    def elsewhere(self, answers):
        """Which of the distinct keys stand in other chunks too."""
        parts = [np.unpackbits(np.frombuffer(answers[int(self.bucket[a])][1], dtype=np.uint8), count=b - a) for a, b in self.spans()]
        return np.concatenate([np.zeros(0, dtype=np.uint8), *parts]) == 1

    def totals(self, answers):
        """The corpus counts of the distinct keys."""
        parts = [unpacked_counts(answers[int(self.bucket[a])][0], b - a) for a, b in self.spans()]
        return np.concatenate([*parts, self.count[self.cuts[-1]:]])


def _asked(chunk, *kinds):
    """A row per bucket with the keys of a chunk and their counts there."""
    out = {"bucket": [], "keys": [], "counts": []}
    for keys in kinds:
        for a, b in keys.spans():
            out["bucket"].append(int(keys.bucket[a]))
            out["keys"].append(keys.key[a:b].tobytes())
            out["counts"].append(packed_counts(keys.count[a:b]))
    return pa.table({
        "bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array([chunk] * len(out["bucket"]), pa.int32()),
        "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})


def _ask(buckets):
    def ask(key, blobs):
        tokens = _Tokens(blobs, buckets)
        return _asked(key[0].as_py(), tokens.words, tokens.pairs)
    return ask


def _ask_triples(buckets):
    def ask(key, blobs, answers):
        tokens = _Tokens(blobs, buckets)
        return _asked(key[0].as_py(), tokens.triples(_replies(answers)))
    return ask


def _answer(buckets):
    def answer(key, table):
        table = table.sort_by("chunk")
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpacked_counts(x, len(p)) for x, p in zip(table.column("counts").to_pylist(), parts)])
        distinct, index = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, index.reshape(-1), counts)
        each = total[index.reshape(-1)]
        shared = np.bincount(index.reshape(-1))[index.reshape(-1)] > 1
        cuts = np.cumsum([0] + [len(p) for p in parts])
        rows, bucket = table.num_rows, key[0].as_py()
        of_words = bucket < buckets
        return pa.table({
            "bucket": pa.array([bucket] * (rows + 1), pa.int32()),
            "chunk": pa.array(table.column("chunk").to_pylist() + [None], pa.int32()),
            "totals": pa.array([packed_counts(each[a:b]) for a, b in zip(cuts[:-1], cuts[1:])] + [None], pa.binary()),
            "shared": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])] + [None], pa.binary()),
            "n": pa.array([None] * rows + [int(total.sum()) if of_words else 0], pa.int64()),
            "types": pa.array([None] * rows + [int((total > 0).sum()) if of_words else 0], pa.int64())})
    return answer


def _replies(answers):
    columns = (answers.column(c).to_pylist() for c in ("bucket", "totals", "shared"))
    return {bucket: (totals, shared) for bucket, totals, shared in zip(*columns)}


def bucket_of(count):
    """0 for 0, 1 for 1, 2 for 2-3, 3 for 4-7 ..."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _bins(p):
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-_STEPS * np.log2(np.where(p > 0, p, 1))), _NEVER - 1), _NEVER).astype(np.int64)


def _own(doc, index, several):
    """For each event how often its key occurs in its document; only where ``several`` it may be more than once."""
    own, at = np.ones(len(index), dtype=np.int64), np.flatnonzero(several)
    keys = int(index.max(initial=0)) + 1
    _, place = _distinct(doc[at] * keys + index[at], (int(doc.max(initial=0)) + 1) * keys)
    own[at] = np.bincount(place)[place]
    return own


def _code(bucket, *bins):
    """One number for a bucket and the bins of three estimates."""
    code = bucket
    for x in bins:
        code = code * (_NEVER + 1) + x
    return code


def _context(pair_context, word_context):
    """The bucket of each context: by the pair's frequency, or the word's where the pair does not occur."""
    return np.where(pair_context > 0, _LEVEL + bucket_of(pair_context), bucket_of(word_context))


def _events(buckets, n):
    def events(key, blobs, answers):
        tokens, replies = _Tokens(blobs, buckets), _replies(answers)
        word, pair = tokens.words.totals(replies), tokens.pairs.totals(replies)
        triples = tokens.triples(replies)
        triple = triples.totals(replies)
        use = np.flatnonzero(tokens.learned)  # whole texts, so a token's predecessor is the one before it here too
        doc, w, p, v = tokens.doc[use], tokens.words.index[use], tokens.pairs.index[use], tokens.before[use]
        rest = n - np.diff(tokens.first)[doc]  # tokens of the other texts
        # A pair occurs twice in a text only if both its words do, a triple only if both its pairs do.
        own = _own(doc, w, tokens.words.count[w] > 1)
        single = (word[w] - own) / np.maximum(rest, 1)
        first = np.r_[True, doc[1:] != doc[:-1]][:len(doc)]
        last = np.r_[first[1:], True][:len(doc)]
        # A text's contexts are its own tokens once more: all but the last, and the end before the first.
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = own[last]
        own_pair = _own(doc, p, (own > 1) & (before > 1) & (tokens.pairs.count[p] > 1))
        context, both = word[v] - before, pair[p] - own_pair
        joint = both / np.maximum(context, 1)
        # After two ends the pair says what the triple would.
        far, three = context.copy(), both.copy()
        later = tokens.learned[tokens.later]
        at = np.searchsorted(use, tokens.later[later])
        index = triples.index[later]
        far[at] = both[at - 1]
        several = (own_pair[at] > 1) & (own_pair[at - 1] > 1) & (triples.count[index] > 1)
        three[at] = triple[index] - _own(doc[at], index, several)
        code = _code(_context(far, context), _bins(three / np.maximum(far, 1)), _bins(joint), _bins(single))
        distinct, count = np.unique(code, return_counts=True)
        return pa.table({"event": pa.array(distinct, pa.int64()), "n": pa.array(count, pa.int64())})
    return events


def fit_weights(events: dict[int, int], types: int, rounds: int = 100):
    """(buckets, 4) weights of triple, pair, word and uniform estimates, by expectation-maximisation.

    One pseudo-event for each estimate keeps every weight above 0; a bucket without events has a
    uniform estimate only.
    """
    code = np.array(sorted(events), dtype=np.int64)
    n = np.array([events[int(c)] for c in code], dtype=np.float64)
    side, bins = _NEVER + 1, []
    for _ in range(3):
        bins.append(code % side)
        code = code // side
    back = lambda q: np.where(q == _NEVER, 0.0, 2.0 ** (-q / _STEPS))
    p = np.stack([*(back(q) for q in reversed(bins)), np.full(len(code), 1 / (types + 1))], axis=1)
    weights = np.zeros((2 * _LEVEL, 4))
    weights[:, 3] = 1
    for b in np.unique(code):
        here, mass = p[code == b], n[code == b]
        w = np.full(4, 1 / 4)
        for _ in range(rounds):
            share = here * w
            share *= (mass / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) + 1
            w /= w.sum()
        weights[b] = w
    return weights


def _score(buckets, n, types, weights):
    def score(key, blobs, answers):
        tokens, replies = _Tokens(blobs, buckets), _replies(answers)
        if len(tokens.first) > 1:
            word, pair = tokens.words.totals(replies), tokens.pairs.totals(replies)
            triples, at = tokens.triples(replies), tokens.later
            count, context, both = word[tokens.words.index], word[tokens.before], pair[tokens.pairs.index]
            far, three = context.copy(), both.copy()
            far[at] = both[at - 1]
            three[at] = triples.totals(replies)[triples.index]
            w = weights[_context(far, context)]
            p = w[:, 0] * three / np.maximum(far, 1) + w[:, 1] * both / np.maximum(context, 1)
            p += w[:, 2] * (count / max(n, 1)) + w[:, 3] / (types + 1)
            base = np.log10((count + 0.5) / (n + 0.5 * (types + 1)))
            first = tokens.first[:-1]
            sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
        else:
            sums = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table({
            "doc_id": tokens.table.column("doc_id"), "train": pa.array(tokens.train, pa.bool_()),
            "n_tokens": pa.array(np.diff(tokens.first), pa.int64()), "n_known": pa.array(sums[0], pa.int64()),
            "base_score": pa.array(sums[1], pa.float64()), "score": pa.array(sums[2], pa.float64())})
    return score


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of
    ``docs`` (doc_id, text, train): the log10 probabilities of all texts under the model above and
    under the smoothed word frequencies (c + 0.5) / (N + 0.5 (V + 1)), learned from the rows with train.

    NULL and empty texts consist of an end. n_known counts tokens that occur in training texts,
    train_tokens is N. NULL in train counts as false; without training texts all words are equally
    unknown and scores are 0. Rows without doc_id and repeated rows count like all others; other columns are
    ignored; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col("train").cast("boolean"), F.lit(False)).alias("train"))
    size = chunks.text_size(docs)
    buckets = max(1, size // (8 * chunks.KEYS_PER_BUCKET))
    parts = chunks.in_chunks(docs, size, CHUNK_BYTES, carry=True).select("chunk", "row_key", "doc_id", "text", "carried.train")
    by_chunk = parts.mapInArrow(_pack, "chunk int, blob binary").groupBy("chunk")
    keys = "bucket int, chunk int, keys binary, counts binary"

    def answered(asked):
        return chunks.written(asked.groupBy("bucket").applyInArrow(
            _answer(buckets), "bucket int, chunk int, totals binary, shared binary, n bigint, types bigint"))
    answers = answered(by_chunk.applyInArrow(_ask(buckets), keys))
    known = answers.where("chunk IS NULL").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).first()
    n, types = known["n"] or 0, known["types"] or 0
    replies = answers.where("chunk IS NOT NULL").select("bucket", "chunk", "totals", "shared")
    more = answered(by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_ask_triples(buckets), keys))
    replies = replies.unionByName(more.where("chunk IS NOT NULL").select("bucket", "chunk", "totals", "shared")).groupBy("chunk")
    events = by_chunk.cogroup(replies).applyInArrow(_events(buckets, n), "event bigint, n bigint")
    events = {r[0]: r[1] for r in events.groupBy("event").agg(F.sum("n")).collect()}  # bounded by the bins
    weights = fit_weights(events, types)
    scored = by_chunk.cogroup(replies).applyInArrow(
        _score(buckets, n, types, weights),
        "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
