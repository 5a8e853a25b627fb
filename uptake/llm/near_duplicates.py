"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of ``size`` lower-cased words (with fewer words, the
whole sequence; without words, nothing). Documents whose sets have a Jaccard similarity of at
least ``threshold`` are linked; a component is what links reach.

1. One pass sketches every text: a 128-bit digest of its set, minima of ``bands * rows`` hash
   functions, of which only the low four bits are kept and packed, and one key per band.
2. Equal sets are one node from here on, so a group of exact copies costs one row.
3. Nodes with a band key in common share the smallest of them as a centre. Members of a centre compare
   packed signatures; bit counts, corrected for chance collisions, rule out dissimilar pairs. The nodes that
   the others connect are a candidate group. The first bands find nearly all groups; of the other bands only
   keys whose nodes are in different groups are looked at.
4. Every node is in one candidate group at most, so its text is shuffled once. Sets of a group are compared
   exactly, by postings of their shingles, as long as they are not connected. A task emits the links of a
   spanning forest, not all pairs.
5. Groups beyond a block's size are dealt to blocks, which hold the group's centre too. As a rule all of it is one
   component then. Where it is not, the members outside of the largest component, in blocks again, meet
   all others; those inside need not meet each other. Components of all links are classes.

With 32 bands of 4 rows a pair at 0.8 has no band in common once in 2 * 10^7 pairs, and the bit
count of a linked pair falls below the bound once in 10^6.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import words
from uptake.llm.chunks import written
from uptake.llm.components import components

BITS = 4
_LOW = np.uint64(0x1111111111111111)
_SALT = np.uint64(0x5851F42D4C957F2D)
_BLOCK_ROWS = 8192
_BLOCK_BYTES = 16 << 20
_SALTS = 64
_FIRST_BANDS = 8


def shingle_sets(table: pa.Table, size: int):
    """Distinct shingle hashes of each row, sorted: (all, first), row r has all[first[r]:first[r + 1]]."""
    data, offsets = words.text_bytes(table.column("text"))
    starts, ends, first = words.find_words(data, offsets)
    h = words.hash_words(data, starts, ends, fold=True)
    n = max(0, len(h) - size + 1)
    rolled = reduce(words.pair_up, [h[k:n + k] for k in range(1, size)], h[:n])
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            sets.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            whole = reduce(words.pair_up, [h[k:k + 1] for k in range(a + 1, b)], h[a:a + 1])
            sets.append(words.mix(whole + np.uint64(b - a)))
        else:
            sets.append(h[:0])
    return np.concatenate(sets) if sets else h[:0], np.cumsum([0] + [len(s) for s in sets])


def minima(values, first, count: int):
    """The smallest value of each of ``count`` hash functions over each row's set (rows, count)."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, count), dtype=np.uint64)
    salts = words.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    at = 0
    while at < len(full):
        upto = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + (1 << 15))))
        low = first[full[at]]
        part = values[low:first[full[upto - 1] + 1]]
        bounds = first[full[at:upto]] - low
        for k in range(count):
            scrambled = (part ^ salts[2 * k]) * (salts[2 * k + 1] | np.uint64(1))
            out[full[at:upto], k] = np.minimum.reduceat(scrambled, bounds)
        at = upto
    return out


def packed_signature(low):
    """The low four bits of the minima, sixteen to a 64-bit integer."""
    low = words.mix(low) & np.uint64((1 << BITS) - 1)
    low = low.reshape(len(low), -1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(low << shifts, axis=2)


def estimated(signature, others):
    """Similarity of one packed signature to others: equal fields, corrected for those equal by chance."""
    differ = others ^ signature
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    unequal = np.bitwise_count(differ & _LOW).sum(axis=1, dtype=np.int64)
    chance = 0.5 ** BITS
    return (1 - unequal / (others.shape[1] * 64 // BITS) - chance) / (1 - chance)


def _sketch(size, bands, rows):
    def sketch(batches):
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                values, first = shingle_sets(table, size)
                counts = np.diff(first)
                low = minima(values, first, bands * rows)
                keys = low.reshape(len(low), bands, rows)
                key = keys[:, :, 0]
                for k in range(1, rows):
                    key = words.pair_up(key, keys[:, :, k])
                key = words.mix(key ^ words.mix(np.arange(bands, dtype=np.uint64)))
                sums = np.zeros((2, len(values) + 1), dtype=np.uint64)
                np.cumsum(words.mix(values), out=sums[0, 1:])
                np.cumsum(words.mix(values ^ _SALT), out=sums[1, 1:])
                digest = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
                signature = packed_signature(low)
                _, offsets = words.text_bytes(table.column("text"))
                yield from pa.table({
                    "doc_id": table.column("doc_id").combine_chunks().cast(pa.int64()),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                    "d1": pa.array(digest[0]), "d2": pa.array(digest[1]),
                    "signature": pa.array([s.tobytes() for s in signature], pa.binary()),
                    "keys": pa.ListArray.from_arrays(
                        pa.array(np.arange(0, key.size + 1, bands), pa.int32()), pa.array(key.reshape(-1).view(np.int64))),
                }).to_batches()
    return sketch


def _forest(node, label, side, similar):
    """Links of a spanning forest between rows that are ``similar`` and not of equal ``label``, which are
    connected already. With ``side`` only between rows of side 0 and of side 1. ``similar(x)`` says of
    every row whether it is similar to row x."""
    root = np.unique(label, return_inverse=True)[1].reshape(-1)
    left, right = [], []
    for x in range(len(node)) if side is None else np.flatnonzero(side == 0):
        other = root != root[x]
        if side is None:
            other[:x] = False  # compared before, from the other end
        else:
            other &= side == 1
        if not other.any():
            continue
        found = np.flatnonzero(other & similar(x))
        if len(found):
            found = found[np.unique(root[found], return_index=True)[1]]
            left.append(np.full(len(found), node[x]))
            right.append(node[found])
            root[np.isin(root, root[found])] = root[x]
    left, right = (np.concatenate(e) if e else np.zeros(0, dtype=np.int64) for e in (left, right))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _columns(table):
    table = table.sort_by([("node", "ascending"), ("side", "ascending")])
    side = table.column("side").to_numpy(zero_copy_only=False)
    whole = len(side) == 0 or table.column("side").null_count == len(side)
    return table, table.column("node").to_numpy(), table.column("label").to_numpy(), None if whole else side


def _alike(threshold, least):
    """Links between rows whose signatures may be those of similar sets."""
    def alike(key, table):
        table, node, label, side = _columns(table)
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        count = table.column("n_shingles").to_numpy()

        def similar(x):
            fit = np.minimum(count, count[x]) >= threshold * np.maximum(count, count[x]) - 1e-9
            at = np.flatnonzero(fit)
            fit[at] = estimated(signature[x], signature[at]) >= least
            return fit
        return _forest(node, label, side, similar)
    return alike


def _confirmed(size, threshold):
    """Links between rows whose sets are similar. Rows that share a node are one document."""
    def confirmed(key, table):
        table, node, label, side = _columns(table)
        values, first = shingle_sets(table, size)
        count = np.diff(first)
        shingle = np.unique(values, return_inverse=True)[1].reshape(-1)
        order = np.argsort(shingle, kind="stable")
        owner = np.repeat(np.arange(len(node)), count)[order]
        begin = np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))

        def similar(x):
            mine = shingle[first[x]:first[x + 1]]
            length = begin[mine + 1] - begin[mine]
            at = np.arange(length.sum()) + np.repeat(begin[mine] - np.cumsum(length) + length, length)
            shared = np.bincount(owner[at], minlength=len(node))
            return (shared > 0) & (100 * shared >= round(100 * threshold) * (count + count[x] - shared))
        return _forest(node, label, side, similar)
    return confirmed


def _looked_up(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join on centre, salted by node: a centre with very many members spreads over many tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(_SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    return rows.withColumn("salt", salt).join(found.withColumn("salt", salts), ["centre", "salt"], how).drop("salt")


def _part(count: str):
    """The block of a node, of as many as the column ``count`` says."""
    return F.pmod(F.xxhash64("node"), count).cast("int")


def _all(count: str):
    return F.sequence(F.lit(0), F.col(count) - 1)


def _across_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of tasks (centre, i, j) in which members outside of their group's largest component
    meet all its members. ``members`` are those of groups with several blocks."""
    known = members.join(labels.withColumnRenamed("label", "known"), "node", "left")
    known = known.withColumn("label", F.coalesce("known", "label")).drop("known")
    sizes = known.groupBy("centre", "label").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("centre").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    groups = groups.where("outside > 0").withColumn("parts", F.ceil(F.col("outside") / _BLOCK_ROWS).cast("int"))
    known = _looked_up(known, groups.select("centre", "main", "parts"), "inner")
    outside = known.where("label != main").select(
        "centre", _part("parts").alias("i"), F.explode(_all("blocks")).alias("j"), "node", "label", F.lit(0).alias("side"))
    everyone = known.select(
        "centre", F.explode(_all("parts")).alias("i"), _part("blocks").alias("j"), "node", "label", F.lit(1).alias("side"))
    return outside.unionByName(everyone)


def _links(members: DataFrame, load, compare) -> DataFrame:
    """Links among the ``members`` (centre, node, label, n_bytes) of every centre. ``load`` adds to rows (..., node)
    what ``compare`` needs of the nodes."""
    sizes = members.groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / _BLOCK_ROWS, F.col("n_bytes") / _BLOCK_BYTES)).cast("int")
    large = written(sizes.select("centre", blocks.alias("blocks")).where("blocks > 1"))
    tasks = _looked_up(members, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    places = F.when(F.col("node") == F.col("centre"), _all("blocks")).otherwise(F.array(_part("blocks")))
    tasks = tasks.select("centre", F.explode(places).alias("i"), F.lit(0).alias("j"), "node", "label", F.lit(None).cast("int").alias("side"))

    def linked(tasks):
        return written(load(tasks).groupBy("centre", "i", "j").applyInArrow(compare, "a bigint, b bigint"))

    links = linked(tasks)
    if large.isEmpty():
        return links
    there = _looked_up(members, large, "inner")
    inside = links.join(there.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    known = inside.unionByName(there.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    more = written(_across_blocks(there, components(known)))
    return links if more.isEmpty() else links.unionByName(linked(more))


def near_duplicates(
    docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 4,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, itself included) and kept (doc_id is component_id).

    NULL and empty texts have an empty set, link with nothing and are their own component. A row
    without doc_id takes no part: component_id NULL, kept true. Rows that share a doc_id count as
    one document, linked to whatever any of them is linked to; rows that share text too are compared once. ``threshold``
    counts in whole per cent. Other columns are ignored; an empty table gives an empty table.
    """
    sketches = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketch(size, bands, rows),
        "doc_id bigint, n_shingles bigint, n_bytes bigint, d1 bigint, d2 bigint, signature binary, keys array<bigint>"))
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Written, so that Spark sees its size and can split a digest that very many rows share.
    copies = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")))
    own = full.join(copies.select(F.col("node").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"])
    # One row per set; the set's other rows with this doc_id are equal to it.
    one = [F.first(c).alias(c) for c in ("n_shingles", "n_bytes", "signature", "keys")]
    nodes = written(own.groupBy(F.col("doc_id").alias("node"), "d1", "d2").agg(*one, F.count("*").alias("times")))
    same = full.join(copies.where("node != last"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    deviation = (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    alike = _alike(threshold, threshold - 5.2 * deviation)
    signatures = nodes.select("node", "n_shingles", "signature")

    def candidates(keyed):
        """Links by signatures between nodes of one key but of different labels; ``keyed`` has node, label and key."""
        centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.min("label").alias("low"), F.max("label").alias("high"))
        centres = centres.where("low != high").select("key", "centre")
        members = written(keyed.join(centres, "key").select("centre", "node", "label").distinct())
        return _links(members.withColumn("n_bytes", F.lit(0)), lambda t: t.join(signatures, "node"), alike)

    keyed = nodes.select("node", F.col("node").alias("label"), F.explode(F.slice("keys", 1, _FIRST_BANDS)).alias("key"))
    near = candidates(keyed)
    if bands > _FIRST_BANDS:
        keyed = nodes.join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
        keyed = keyed.select("node", "label", F.explode(F.slice("keys", _FIRST_BANDS + 1, bands)).alias("key"))
        near = near.unionByName(candidates(keyed))

    groups = components(near).withColumnRenamed("label", "centre")
    sizes = nodes.groupBy("node").agg(F.sum("n_bytes").alias("n_bytes"))
    members = written(groups.join(sizes, "node").withColumn("label", F.col("node")))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    repeated = written(nodes.where("times > 1").select("node").distinct())
    if not repeated.isEmpty():
        # Rows that repeat both id and text: one of each is enough.
        again = texts.join(repeated, "node", "left_semi").dropDuplicates(["node", "text"])
        texts = texts.join(repeated, "node", "left_anti").unionByName(again)
    links = _links(members, lambda t: t.join(texts, "node"), _confirmed(size, threshold))
    label = components(links.unionByName(same.where("a != b")))
    out = sketches.select("doc_id", "n_shingles").join(
        label.withColumnRenamed("node", "doc_id").withColumnRenamed("label", "component_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
