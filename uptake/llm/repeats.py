"""Removal of repeated passages with prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. A word goes if a window covers it whose
word sequence also starts at an earlier place (smaller doc_id, or earlier in the same document).

Indexing every suffix of a corpus costs many times its size, so the trees are sparse. Each window
elects one of its starts by the smallest hash of the ``anchor`` words there; equal windows elect
alike, so it is enough to index the suffixes at elected places, with the few words before them.

1. Every chunk of documents asks which of its anchors occur again anywhere. The 64-bit key of an
   anchor is built like a path in a trie: 16 bits each for its first word, the second, the next
   two and the next four. The answers also count, per path, the suffixes that are left.
2. Suffixes under one path form a group. Paths with more than ``group_size`` suffixes are split by
   the next step of the path, the others are packed, so that a group of whole subtrees fits in memory.
3. In each group the suffixes are sorted word by word. Runs with a common prefix of d words are the
   tree's internal nodes at depth d; together with the same ordering of the words before the
   anchor, nodes that span ``length`` words are the repeats, and their earliest place is kept.
4. Anchors that alone have more than ``group_size`` suffixes are not sent as suffixes: their windows are
   told apart. Chunks ask which of these windows occur again, by hash, and send each distinct one that
   does once, with its earliest place in the chunk; the earliest of all goes back to the chunks. A window
   costs a row per chunk however often it stands, one that stands once costs a hash.
5. The chunks turn the answers into spans; overlapping windows join into maximal repeats.

Equal fragments of one chunk travel once with the list of their places, so a group of copies sends
one entry per chunk. Windows are compared by their words; hashes only choose candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uptake.llm import chunks, words

_STEPS = (48, 32, 16)  # bits below the first word, the second, the third and fourth


def anchor_keys(h, size: int):
    """The trie path of the ``size`` words from each place on (size >= 5)."""
    n = max(0, len(h) - size + 1)
    two = h[1:n + 1]
    middle = words.pair_up(h[2:n + 2], h[3:n + 3])
    last = h[4:n + 4]
    for k in range(5, size):
        last = words.pair_up(last, h[k:n + k])
    top = np.uint64(48)
    key = words.mix(h[:n]) >> top
    for part in (two, middle, last):
        key = (key << np.uint64(16)) | (words.mix(part) >> top)
    return key


def elected(key, first, length: int, size: int):
    """For every window (its start), the place it elects: (starts, places)."""
    span = length - size + 1
    counts = np.maximum(0, np.diff(first) - length + 1)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.arange(total) + np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)
    value, place, width = words.mix(key), np.arange(len(key)), 1
    while width < span:
        step = min(width, span - width)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, value[step:], value[:-step])
        width += step
    return starts, place[starts]


class _Chunk:
    """The words of a chunk, its windows and their anchors."""

    def __init__(self, table, length, size):
        self.table = chunks.ordered(table)
        self.data, offsets = words.text_bytes(self.table.column("text"))
        self.starts, self.ends, self.first = words.find_words(self.data, offsets)
        self.hashes = words.hash_words(self.data, self.starts, self.ends)
        key = anchor_keys(self.hashes, size)
        self.windows, self.places = elected(key, self.first, length, size)
        fresh = np.ones(len(self.places), dtype=bool)
        fresh[1:] = self.places[1:] != self.places[:-1]
        self.opens = np.flatnonzero(fresh)
        self.anchors = self.places[self.opens]
        self.keys = key[self.anchors]

    def of(self, hot, length):
        """Windows that elect one of the ``hot`` anchors: their first words, their anchors' places, their hashes."""
        owner = np.repeat(np.arange(len(self.opens)), np.diff(np.r_[self.opens, len(self.places)]))
        pick = np.isin(self.keys, hot)[owner]
        start = self.windows[pick]
        value = self.hashes[start]
        for k in range(1, length):
            value = words.pair_up(value, self.hashes[start + k])
        return start, self.places[pick], value


def _asked(keys, buckets):
    """Distinct keys in the order in which they are asked, their bucket and how often they stand, and for
    each of ``keys`` its position in that order."""
    distinct, index, counts = np.unique(keys, return_inverse=True, return_counts=True)
    bucket = (words.mix(distinct) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], bucket[order], counts[order], rank[index.reshape(-1)]


def _blob_bounds(bucket):
    return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)


def _ask(length, size, buckets, hot=None):
    """A chunk's questions, about its anchors or about the windows of ``hot`` anchors."""
    def ask(key, table):
        part = _Chunk(table, length, size)
        keys, bucket, counts, _ = _asked(part.keys if hot is None else part.of(hot, length)[2], buckets)
        again = np.minimum(counts, 65_535).astype(np.uint16)
        cuts = _blob_bounds(bucket)
        spans = list(zip(cuts[:-1], cuts[1:]))
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(spans), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([again[a:b].tobytes() for a, b in spans], pa.binary()),
        })
    return ask


def _known(key, table):
    """One bucket: (distinct keys, how often they stand), and a table of which occur more than once, per chunk."""
    table = table.sort_by("chunk")
    parts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
    weight = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in table.column("counts").to_pylist()])
    distinct, index = np.unique(np.concatenate(parts), return_inverse=True)
    index = index.reshape(-1)
    total = np.bincount(index, weights=weight, minlength=len(distinct))
    flags = (total >= 2)[index]
    cuts = np.cumsum([0] + [len(p) for p in parts])
    return distinct, total, pa.table({
        "bucket": pa.array([key[0].as_py()] * table.num_rows, pa.int32()),
        "chunk": table.column("chunk").combine_chunks().cast(pa.int32()),
        "bits": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def _answer_windows(key, table):
    return _known(key, table)[2]


def _answer(group_size):
    """One bucket: which keys occur more than once, per chunk; the suffixes left per path; and the keys
    that alone have more than ``group_size``."""
    def answer(key, table):
        distinct, total, out = _known(key, table)
        kept, total = distinct[total >= 2], total[total >= 2]
        path, at = np.unique(kept >> np.uint64(16), return_inverse=True)
        # What is sent is at most one fragment per anchor of a chunk; equal ones travel together.
        sent = np.bincount(at.reshape(-1), weights=total, minlength=len(path))
        kinds = {"paths": path, "suffixes": sent, "hot": kept[total > group_size], "often": total[total > group_size]}
        last = {"bucket": pa.array([key[0].as_py()], pa.int32())} | {
            name: pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for name, x in kinds.items()}
        return pa.concat_tables([out, pa.table(last)], promote_options="default")
    return answer


def split_paths(answers: DataFrame, group_size: int, most: int):
    """(suffixes, paths to split at each step). A path is split if it holds more suffixes than a
    group may; at most ``most`` paths per step can, since the limit grows with the total."""
    counted = answers.where("paths IS NOT NULL").select(F.explode(F.arrays_zip("paths", "suffixes")).alias("p"))
    counted = counted.groupBy(F.col("p.paths").alias("path")).agg(F.sum("p.suffixes").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit, hot = max(group_size, total // most), []
    for bits in _STEPS:
        prefix = F.shiftright("path", bits - 16).alias("prefix")
        big = counted.groupBy(prefix).agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        found = [row[0] for row in big.select("prefix").collect()]
        hot.append(np.array(sorted(found), dtype=np.uint64))
        if not found:
            break
    return total, hot


def hot_keys(answers: DataFrame, total: int, group_size: int, most: int):
    """Anchors with more suffixes than a group may hold, which no path can split; at most ``most``."""
    found = answers.where("paths IS NOT NULL").select(F.explode(F.arrays_zip("hot", "often")).alias("k"))
    found = found.where(F.col("k.often") > max(group_size, total // most)).select("k.hot").collect()
    return np.sort(np.array([row[0] for row in found], dtype=np.int64).view(np.uint64))


def _group_of(keys, hot, groups):
    """The group of each key: its shortest path that is not split, hashed."""
    path = (keys >> np.uint64(_STEPS[0])) | np.uint64(1 << 60)
    open_ = np.ones(len(keys), dtype=bool)
    for step, split in enumerate(hot):
        open_ &= np.isin(keys >> np.uint64(_STEPS[step]), split)
        below = _STEPS[step + 1] if step + 1 < len(_STEPS) else 0
        path[open_] = (keys[open_] >> np.uint64(below)) ^ np.uint64((step + 2) << 60)
    return (words.mix(path) % np.uint64(groups)).astype(np.int32)


def _send(length, size, buckets, hot, groups, apart):
    """The suffixes of a chunk at anchors that occur again, but for those of the hot anchors ``apart``."""
    span = length - size

    def send(key, texts, replies):
        part = _Chunk(texts, length, size)
        out = {"grp": [], "fragment": [], "before": [], "windows": [], "docs": [], "rows": [], "places": []}
        if part.keys.size:
            anchors = np.flatnonzero(_unpacked(part.keys, buckets, replies) & ~np.isin(part.keys, apart))
            grp = _group_of(part.keys[anchors], hot, groups)
            doc_ids = pc.fill_null(part.table.column("doc_id"), -(1 << 63)).to_numpy()  # NULL sorts first
            row = np.searchsorted(part.first, part.anchors[anchors], side="right") - 1
            closes = np.r_[part.opens[1:], len(part.places)]
            far = part.anchors[anchors] - part.windows[part.opens[anchors]]
            near = part.anchors[anchors] - part.windows[closes[anchors] - 1]
            place = part.anchors[anchors]
            low, high = part.starts[place - far], part.ends[place - near + length - 1]
            # windows of one anchor are consecutive starts: offsets near..far
            mask = (1 << (far + 1)) - (1 << near)
            assert span < 31
            raw, seen = part.data.tobytes(), {}
            at = place - part.first[row]
            for i in range(len(anchors)):
                text = b" ".join(raw[low[i]:high[i]].split())
                seen.setdefault((text, int(mask[i]), int(far[i])), []).append(i)
            for (text, windows, before), members in seen.items():
                out["grp"].append(int(grp[members[0]]))
                out["fragment"].append(text)
                out["before"].append(before)
                out["windows"].append(windows)
                out["docs"].append([int(doc_ids[row[i]]) for i in members])
                out["rows"].append(row[members].tolist())
                out["places"].append(at[members].tolist())
        out["chunk"] = [key[0].as_py()] * len(out["grp"])
        return pa.table({name: pa.array(out[name], kind) for name, kind in (
            ("grp", pa.int32()), ("chunk", pa.int32()), ("fragment", pa.binary()), ("before", pa.int32()),
            ("windows", pa.int32()), ("docs", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())),
            ("places", pa.list_(pa.int32())))})
    return send


def _unpacked(keys, buckets, replies):
    """The answer for each of ``keys``."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    _, bucket, _, rank = _asked(keys, buckets)
    cuts = _blob_bounds(bucket)
    by = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()))
    parts = [
        np.unpackbits(np.frombuffer(by[int(bucket[a])], dtype=np.uint8), count=b - a)
        for a, b in zip(cuts[:-1], cuts[1:])
    ]
    return np.concatenate(parts).astype(bool)[rank]


class _Windows:
    """A chunk's windows of hot anchors that occur again: distinct ones, and the place of each."""

    def __init__(self, texts, replies, length, size, buckets, hot):
        part = _Chunk(texts, length, size)
        start, anchor, value = part.of(hot, length)
        again = _unpacked(value, buckets, replies)
        start, anchor = start[again], anchor[again]
        raw, seen = part.data.tobytes(), {}
        low, high = part.starts[start].tolist(), part.ends[start + length - 1].tolist()
        self.owner = np.array([
            seen.setdefault(b" ".join(raw[a:b].split()), len(seen)) for a, b in zip(low, high)], dtype=np.int64)
        self.texts = list(seen)
        self.row = np.searchsorted(part.first, start, side="right") - 1
        ids = pc.fill_null(part.table.column("doc_id"), -(1 << 63)).to_numpy()  # NULL sorts first
        self.doc, self.place = ids[self.row], start - part.first[self.row]
        self.anchor, self.offset = anchor - part.first[self.row], anchor - start


def _earliest(*parts):
    """Each distinct window of a chunk with its earliest place there."""
    def earliest(key, texts, replies):
        found = _Windows(texts, replies, *parts)
        order = np.lexsort((found.place, found.doc, found.owner))
        first = order[np.flatnonzero(np.diff(np.r_[-1, found.owner[order]]))]
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(first), pa.int32()), "at": pa.array(np.arange(len(first)), pa.int32()),
            "seq": pa.array(found.texts, pa.binary()), "doc": pa.array(found.doc[first], pa.int64()),
            "place": pa.array(found.place[first], pa.int32())})
    return earliest


def _later(*parts):
    """The places of a chunk's windows that start after the earliest ones, as ``_grow`` gives them."""
    def later(key, replies, texts):
        # The answers about hashes and those about places come as one table.
        found = _Windows(texts, replies.filter(pc.is_valid(replies.column("bits"))), *parts)
        first = replies.filter(pc.is_valid(replies.column("at"))).sort_by("at")
        doc, place = (first.column(c).to_numpy() for c in ("doc", "place"))
        late = (found.doc != doc[found.owner]) | (found.place != place[found.owner])
        pick = lambda x: pa.array([x[late].astype(np.int32).tobytes()] if late.any() else [], pa.binary())
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * int(late.any()), pa.int32()),
            "rows": pick(found.row), "places": pick(found.anchor), "windows": pick(1 << found.offset)})
    return later


def tree_nodes(matrix):
    """Sort suffixes given as rows of word numbers and find the tree's internal nodes.

    Returns a function of d: the node at depth d (a common prefix of d words) of each row.
    """
    n, width = matrix.shape
    order = np.lexsort(matrix.T[::-1]) if width else np.arange(n)
    common = np.zeros(n, dtype=np.int32)  # words shared with the suffix before
    if n > 1 and width:
        differs = matrix[order[1:]] != matrix[order[:-1]]
        common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)

    def at_depth(d):
        node = np.empty(n, dtype=np.int64)
        node[order] = np.cumsum(np.r_[True, common[1:] < d]) if n else 0
        return node
    return at_depth


def _fill(lists, width, reverse=False):
    matrix = np.full((len(lists), width), -1, dtype=np.int32)
    for i, x in enumerate(lists):
        x = x[::-1] if reverse else x
        matrix[i, :min(len(x), width)] = x[:width]
    return matrix


def _grow(length, size):
    """One group of subtrees: for each place, which of its windows start earlier elsewhere."""
    far = length - size

    def grow(key, table):
        number, after, ahead = {}, [], []
        before = table.column("before").to_pylist()
        for text, b in zip(table.column("fragment").to_pylist(), before):
            ids = [number.setdefault(w, len(number)) for w in text.split()]
            after.append(ids[b:])
            ahead.append(ids[:b])
        right, left = tree_nodes(_fill(after, length)), tree_nodes(_fill(ahead, far, reverse=True))
        windows = table.column("windows").to_numpy()
        docs, rows, places = (table.column(c).combine_chunks() for c in ("docs", "rows", "places"))
        sizes = np.diff(docs.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        doc, row, place = (x.flatten().to_numpy(zero_copy_only=False) for x in (docs, rows, places))
        chunk = table.column("chunk").to_numpy()[owner]
        order = np.lexsort((place, doc))
        owner, doc, row, place, chunk = (x[order] for x in (owner, doc, row, place, chunk))
        gone = np.zeros(len(owner), dtype=np.int32)
        for offset in range(far + 1):
            have = np.flatnonzero(windows[owner] >> offset & 1)
            if not len(have):
                continue
            of = owner[have]
            node = right(length - offset)[of] * np.int64(len(windows) + 1) + left(offset)[of]
            _, first, index = np.unique(node, return_index=True, return_inverse=True)
            origin = have[first[index.reshape(-1)]]
            later = (doc[have] != doc[origin]) | (place[have] != place[origin])
            gone[have[later]] |= np.int32(1 << offset)
        hit = np.flatnonzero(gone)
        hit = hit[np.lexsort((place[hit], row[hit], chunk[hit]))]
        cuts = _blob_bounds(chunk[hit])
        spans = list(zip(cuts[:-1], cuts[1:]))
        pick = lambda x: pa.array([x[hit[a:b]].astype(np.int32).tobytes() for a, b in spans], pa.binary())
        return pa.table({
            "chunk": pa.array([int(chunk[hit[a]]) for a, _ in spans], pa.int32()),
            "rows": pick(row), "places": pick(place), "windows": pick(gone),
        })
    return grow


class _Cut:
    """A chunk's words and which of them go."""

    def __init__(self, texts, found, length, size):
        self.table = chunks.ordered(texts)
        data, self.offsets = words.text_bytes(self.table.column("text"))
        self.starts, self.ends, self.first = words.find_words(data, self.offsets)
        self.raw = data.tobytes()
        change = np.zeros(len(self.starts) + length + 1, dtype=np.int32)
        row, place, windows = (
            np.concatenate([np.zeros(0, np.int32)] + [np.frombuffer(x, dtype=np.int32) for x in found.column(name).to_pylist()])
            for name in ("rows", "places", "windows"))
        for offset in range(length - size + 1):
            hit = windows >> offset & 1 == 1
            start = self.first[row[hit]] + place[hit] - offset
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
        self.gone = np.cumsum(change)[:len(self.starts)] > 0
        self.edge = np.flatnonzero(np.diff(np.r_[0, self.gone.astype(np.int8), 0]))
        self.removed = np.diff(np.r_[0, np.cumsum(self.gone)][self.first])

    def pieces(self, r):
        """Row r as runs of words (from, to, whether they go)."""
        a, b = int(self.first[r]), int(self.first[r + 1])
        cuts = self.edge[np.searchsorted(self.edge, a):np.searchsorted(self.edge, b, side="right")]
        inner = np.unique(np.r_[a, cuts, b]) if b > a else []
        return [(int(x), int(y), bool(self.gone[x])) for x, y in zip(inner[:-1], inner[1:])]


def _report(length, size):
    def report(key, texts, found):
        cut = _Cut(texts, found, length, size)
        spans, kept = [], []
        for r in range(len(cut.first) - 1):
            pieces, a = cut.pieces(r), int(cut.first[r])
            spans.append([{"start": x - a, "end": y - a} for x, y, gone in pieces if gone])
            kept.append(b" ".join(w for x, y, gone in pieces if not gone for w in cut.raw[cut.starts[x]:cut.ends[y - 1]].split()))
        return pa.table({
            "doc_id": cut.table.column("doc_id"), "row_key": cut.table.column("row_key"),
            "n_words": pa.array(np.diff(cut.first), pa.int64()), "n_removed": pa.array(cut.removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })
    return report


def _rewrite(length, size):
    """Cut the texts in place: kept words with the white space after them."""
    def rewrite(key, texts, found):
        cut = _Cut(texts, found, length, size)
        column, kept, keep = cut.table.column("text").to_pylist(), [], []
        for r in range(len(cut.first) - 1):
            pieces = cut.pieces(r)
            keep.append(any(not gone for _, _, gone in pieces) or not pieces)
            if not cut.removed[r]:
                kept.append(column[r])
                continue
            last = int(cut.offsets[r + 1])
            starts = np.r_[cut.starts, last]
            kept.append(b"".join(
                cut.raw[cut.starts[x]:(last if y == cut.first[r + 1] else starts[y])]
                for x, y, gone in pieces if not gone).decode())
        out = pa.table({"text": pa.array(kept, pa.string()), "carried": cut.table.column("carried")})
        return out.filter(pa.array(keep, pa.bool_()))
    return rewrite


def _found(parts, size, length, anchor, group_size, max_paths) -> DataFrame:
    """For every chunk of ``parts`` the places of its windows that start earlier elsewhere."""
    if not 5 <= anchor < length or length - anchor > 30:
        raise ValueError("5 <= anchor < length and length - anchor <= 30 are needed")
    buckets = max(1, size // (8 * chunks.KEYS_PER_BUCKET))
    by_chunk = parts.groupBy("chunk")
    asked = by_chunk.applyInArrow(
        _ask(length, anchor, buckets), "bucket int, chunk int, keys binary, counts binary")
    answers = chunks.written(asked.groupBy("bucket").applyInArrow(
        _answer(group_size), "bucket int, chunk int, bits binary, paths array<bigint>, suffixes array<bigint>, "
        "hot array<bigint>, often array<bigint>"))
    total, hot = split_paths(answers, group_size, max_paths)
    apart = hot_keys(answers, total, group_size, max_paths)
    groups = max(1, -(-2 * total // group_size))
    bits = answers.where("chunk IS NOT NULL").select("bucket", "chunk", "bits")
    sent = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(
        _send(length, anchor, buckets, hot, groups, apart),
        "grp int, chunk int, fragment binary, before int, windows int, docs array<bigint>, "
        "rows array<int>, places array<int>")
    found = sent.groupBy("grp").applyInArrow(
        _grow(length, anchor), "chunk int, rows binary, places binary, windows binary")
    return found.unionByName(_found_apart(parts, length, anchor, buckets, apart)) if len(apart) else found


def _found_apart(parts, length, anchor, buckets, apart) -> DataFrame:
    """The same for the windows of the hot anchors ``apart``."""
    by_chunk, how = parts.groupBy("chunk"), (length, anchor, buckets, apart)
    asked = by_chunk.applyInArrow(_ask(*how), "bucket int, chunk int, keys binary, counts binary")
    # Not written: another job would shuffle the texts again.
    bits = asked.groupBy("bucket").applyInArrow(_answer_windows, "bucket int, chunk int, bits binary")
    sent = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(
        _earliest(*how), "chunk int, at int, seq binary, doc bigint, place int")
    first = F.min(F.struct("doc", "place")).over(Window.partitionBy("seq"))
    firsts = sent.select("chunk", "at", first.alias("first")).select("chunk", "at", "first.doc", "first.place")
    replies = bits.unionByName(firsts, allowMissingColumns=True)
    return replies.groupBy("chunk").cogroup(by_chunk).applyInArrow(
        _later(*how), "chunk int, rows binary, places binary, windows binary")


def remove_repeats(
    docs: DataFrame, length: int = 20, anchor: int = 8, group_size: int = 50_000, max_paths: int = 100_000,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row_key, n_words, n_removed, spans
    (maximal runs of removed words, end exclusive) and kept_text (kept words joined by one space).

    ``row_key`` is xxhash64(doc_id, text). NULL and empty texts, and those with fewer than
    ``length`` words, keep all their words. A NULL doc_id sorts before all others. Rows with the same doc_id
    count as one document: of equal windows that start at the same place in them, neither is
    earlier. Other columns are ignored; an empty table gives an empty table. ``group_size`` is the
    number of suffixes that one task indexes at once; ``max_paths`` bounds the lists of split paths and
    of hot anchors, all that passes through the driver, and the group size grows beyond it.
    """
    size = chunks.text_size(docs)
    parts = chunks.in_chunks(docs.select("doc_id", "text"), size)
    found = _found(parts, size, length, anchor, group_size, max_paths)
    return parts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _report(length, anchor),
        "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, "
        "spans array<struct<start:int,end:int>>, kept_text string")


def without_repeats(
    docs: DataFrame, length: int = 20, anchor: int = 8, group_size: int = 50_000, max_paths: int = 100_000,
) -> DataFrame:
    """``docs`` with all its columns, the repeated words cut from text (white space between kept
    words stays). Rows that lose all their words go; all else is as in ``remove_repeats``."""
    size = chunks.text_size(docs)
    parts = chunks.in_chunks(docs, size, carry=True)
    found = _found(parts, size, length, anchor, group_size, max_paths)
    carried = parts.schema["carried"].dataType
    out = parts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _rewrite(length, anchor), T.StructType().add("text", T.StringType()).add("carried", carried))
    return out.select(*[F.col("text") if c == "text" else F.col(f"carried.`{c}`") for c in docs.columns])
