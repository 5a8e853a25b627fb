"""Exact top-k search by inner product over integer vectors: tiles and tree merges.

Queries and candidates are packed into blocks of rows of equal length. Every block of candidates (a shard) meets a group of query
blocks in one task, a tile at a time: one matrix product, then a partial selection of
each query's k best. Lists of several shards are merged ``FAN`` at a time, in rounds, so no task holds
more than ``FAN`` lists of one block of queries, however many shards there are.

Products are exact: sums below 2^53 in doubles, larger ones from products of digits, beyond 64 bits as Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm.chunks import written
from uptake.llm.integers import largest, products, whole

QUERY_ROWS = 2048
SHARD_ROWS = 8192
BLOCK_BYTES = 16 << 20  # of components, at eight bytes each
TOGETHER = 8  # query blocks that meet a shard in one task
FAN = 8
_SINGLE = 2 ** 24  # sums of integers below it are exact in single precision


def _packed(key, table, name, scale):
    """One block: its ids and its components, in the smallest of the types that hold them, else as they came."""
    table = table.sort_by("vec_id")
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    values, kind = flat, "raw"
    if np.abs(flat).max(initial=0) * scale < 2 ** 31 - 1:
        values = whole(flat, scale, 2 ** 31)
        kind = "<i2" if largest(values) < 2 ** 15 else "<i4"
        values = values.astype(kind)
    return pa.table({
        "width": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int32()), "kind": pa.array([kind]),
        "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
        "vectors": pa.array([values.tobytes()], pa.binary())})


def _opened(row, scale):
    """The ids and the matrix of a packed block."""
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    if row["kind"] == "raw":
        flat = whole(np.frombuffer(row["vectors"], dtype=np.float64), scale, 2 ** 53)
    else:
        flat = np.frombuffer(row["vectors"], dtype=row["kind"]).astype(np.int64)
    return ids, flat.reshape(len(ids), -1)


def _best(scores, ids, valid, k):
    """For each row of scores the k best valid ones (score descending, id ascending): (scores, ids, number).
    Rows with fewer are filled up. ``ids`` holds one id per cell."""
    n = len(scores)
    if scores.dtype == object:
        picked = []
        for row in range(n):
            at = np.flatnonzero(valid[row]).tolist()
            picked.append(sorted(at, key=lambda c: (-scores[row, c], ids[row, c]))[:k])
        rows = np.repeat(np.arange(n), [len(p) for p in picked])
        columns = np.array([c for p in picked for c in p], dtype=np.int64)
    else:
        reach = valid
        if scores.shape[1] > k:
            # All that reach the k-th score stay, so that ties are settled by id and not by place.
            least = np.where(valid, scores, np.iinfo(np.int64).min)
            least = np.partition(least, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            reach = valid & (scores >= least[:, None])
        rows, columns = np.nonzero(reach)
        # Descending by the complement, which unlike the negative holds every 64-bit number.
        order = np.lexsort((ids[rows, columns], ~scores[rows, columns], rows))
        rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    keep = rank < k
    rows, columns, rank = rows[keep], columns[keep], rank[keep]
    best, names = np.zeros((n, k), dtype=scores.dtype), np.zeros((n, k), dtype=np.int64)
    best[rows, rank], names[rows, rank] = scores[rows, columns], ids[rows, columns]
    return best, names, np.bincount(rows, minlength=n)


def _list(width, block, shard, query_ids, scores, ids, number):
    """A block's lists as one row; scores beyond 64 bits as text."""
    big = None
    if scores.dtype == object:
        fits = all(-(1 << 63) <= x < 1 << 63 for x in scores.reshape(-1).tolist())
        scores, big = (scores.astype(np.int64), None) if fits else (np.zeros(0, dtype=np.int64), [str(x) for x in scores.reshape(-1).tolist()])
    return {
        "width": width, "block": block, "shard": shard, "query_ids": query_ids, "scores": scores.tobytes(), "big": big,
        "ids": ids.tobytes(), "number": number.astype(np.int64).tobytes()}


_LISTS = "width int, block int, shard int, query_ids binary, scores binary, big array<string>, ids binary, number binary"
_SCHEMA = pa.schema([
    ("width", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("query_ids", pa.binary()), ("scores", pa.binary()),
    ("big", pa.list_(pa.string())), ("ids", pa.binary()), ("number", pa.binary())])


def _opened_list(row, k):
    number = np.frombuffer(row["number"], dtype=np.int64)
    ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(-1, k)
    if row["big"] is not None:
        scores = np.empty(ids.shape, dtype=object)
        scores.reshape(-1)[:] = [int(x) for x in row["big"]]
    else:
        scores = np.frombuffer(row["scores"], dtype=np.int64).reshape(-1, k)
    return scores, ids, np.arange(k)[None, :] < number[:, None]


def _scores(left, right):
    """Exact inner products of a few queries and a shard."""
    if largest(left) * largest(right) * max(1, left.shape[1]) < _SINGLE:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int64)
    if right.dtype != object and left.dtype != object:
        return products(left, right)
    # Vectors with huge components are multiplied by themselves, the others as usual.
    huge = [largest(r) >= 1 << 40 for r in right]
    huge = np.array(huge, dtype=bool)
    parts = [products(left, np.array(right[at].tolist(), dtype=object if at is huge else np.int64).reshape(-1, right.shape[1])) for at in (huge, ~huge)]
    out = np.zeros((len(left), len(right)), dtype=object if any(p.dtype == object for p in parts) else np.int64)
    for at, part in zip((huge, ~huge), parts):
        out[:, at] = part
    return out


def _tile(k, scale):
    def tile(key, queries, shard):
        width, _, number = (x.as_py() for x in key)
        lists = []
        if queries.num_rows and shard.num_rows:
            theirs, right = _opened(shard.to_pylist()[0], scale)
            for row in sorted(queries.select(["block", "kind", "ids", "vectors"]).to_pylist(), key=lambda r: r["block"]):
                mine, left = _opened(row, scale)
                parts = []
                for at in range(0, len(mine), 128):
                    scores = _scores(left[at:at + 128], right)
                    valid = mine[at:at + 128, None] != theirs[None, :]
                    parts.append(_best(scores, np.broadcast_to(theirs, scores.shape), valid, k))
                scores, ids, count = (np.concatenate(x) for x in zip(*parts))
                lists.append(_list(width, row["block"], number, row["ids"], scores, ids, count))
        return pa.Table.from_pylist(lists, _SCHEMA)
    return tile


def _merge(k):
    def merge(key, table):
        rows = sorted(table.select([f.name if f.name != "shard" else "part" for f in _SCHEMA]).to_pylist(), key=lambda r: r["part"])
        scores, ids, valid = (np.concatenate(x, axis=1) for x in zip(*[_opened_list(r, k) for r in rows]))
        width, block, shard = (x.as_py() for x in key)
        return pa.Table.from_pylist([_list(width, block, shard, rows[0]["query_ids"], *_best(scores, ids, valid, k))], _SCHEMA)
    return merge


def _unpack(k):
    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                queries = np.frombuffer(row["query_ids"], dtype=np.int64)
                scores, ids, valid = _opened_list(row, k)
                at, place = np.nonzero(valid)
                found = [x if -(1 << 63) <= x < 1 << 63 else None for x in scores[at, place].tolist()]
                yield pa.record_batch({
                    "query_id": pa.array(queries[at]), "rank": pa.array((place + 1).astype(np.int32)),
                    "vec_id": pa.array(ids[at, place]), "score": pa.array(found, pa.int64())})
    return unpack


def _count(rows: DataFrame, most: int, name: str) -> DataFrame:
    """How many blocks the rows of each width need: at most ``most`` rows and ``BLOCK_BYTES`` each."""
    held = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width")))))
    return rows.groupBy("width").agg(F.count("*").alias("n")).select("width", F.ceil(F.col("n") / held).cast("int").alias(name))


def _blocks(rows: DataFrame, counts: DataFrame, name: str, count: str, scale: int) -> DataFrame:
    """Rows dealt to the blocks of their width by their ids, one packed row per block."""
    dealt = rows.join(counts, "width").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int"))
    return written(dealt.groupBy("width", name).applyInArrow(
        lambda key, table: _packed(key, table, name, scale), f"width int, {name} int, kind string, ids binary, vectors binary"))


def _usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & (F.size("vector") > 0), F.lit(False)))
    return rows.withColumn("width", F.size("vector"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` the k rows of ``candidates``
    with the largest inner products, ties to the smaller id; all of them if there are fewer.

    Both hold (vec_id, vector); a component x counts as the integer floor(``scale`` * x), whatever its size. A candidate with the
    query's own id takes no part in its list, nor do vectors of another length than the query's. Rows without id or vector, with an
    empty vector or with NULL or non-finite components take no part at all.
    A repeated candidate is ranked as often as it occurs, a repeated query gets a list for each
    row. Other columns are ignored; an empty side gives no rows. Ranks are always exact; a score that 64 bits do not hold is NULL.
    """
    queries, candidates = _usable(queries), _usable(candidates)
    counts = _count(queries, QUERY_ROWS, "blocks").join(_count(candidates, SHARD_ROWS, "shards"), "width")
    counts = written(counts)  # a row per length of vector
    left = _blocks(queries, counts, "block", "blocks", scale).join(counts, "width")
    left = left.withColumn("together", F.floor(F.col("block") / TOGETHER).cast("int"))
    left = left.select("width", "together", "block", "kind", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = _blocks(candidates, counts, "shard", "shards", scale)
    groups = counts.select("width", F.floor((F.col("blocks") - 1) / TOGETHER).cast("int").alias("groups"))
    right = right.join(groups, "width").select(
        "width", "shard", "kind", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.col("groups"))).alias("together"))
    keys = ("width", "together", "shard")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k, scale), _LISTS)
    shards = counts.agg(F.max("shards")).first()[0] or 1
    while shards > 1:
        shards = -(-shards // FAN)
        lists = lists.withColumnRenamed("shard", "part").withColumn("shard", F.floor(F.col("part") / FAN).cast("int"))
        lists = lists.groupBy("width", "block", "shard").applyInArrow(_merge(k), _LISTS)
    return lists.mapInArrow(_unpack(k), "query_id bigint, rank int, vec_id bigint, score bigint")
