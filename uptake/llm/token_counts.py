"""Token counts by byte-pair merging with a heap over a linked list of symbols.

A text's count is its initial symbols less its merges; no token identifiers are made. Texts are cut
where no merge can cross, namely between two characters that are not neighbours in any piece of the
vocabulary, so equal stretches are merged once per task and remembered.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptake.llm import words

SPACE = "▁"
_REMEMBERED = 400_000


def read_vocabulary(path: str) -> dict[str, float]:
    """The rank of every piece of a sentencepiece BPE model: lower ranks merge first."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, kinds = model.normalizer_spec, model.SentencePiece
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces \
            or not (rules.add_dummy_prefix and model.trainer_spec.byte_fallback):
        raise ValueError("only BPE models with byte fallback, a leading space and no normalisation are known")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not known")
    return {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}


def merges(symbols: list[str], rank: dict[str, float]) -> int:
    """How many merges the symbols allow: always the pair of the lowest rank, the leftmost of equals."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in rank:
            heap.append((rank[pair], i, len(pair)))
    heapify(heap)
    done = 0
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
            continue  # one of the two has been merged since
        symbols[i] += symbols[j]
        symbols[j] = ""
        done += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = symbols[i] + symbols[k]
            if pair in rank:
                heappush(heap, (rank[pair], i, len(pair)))
        h = before[i]
        if h >= 0:
            pair = symbols[h] + symbols[i]
            if pair in rank:
                heappush(heap, (rank[pair], h, len(pair)))
    return done


def stretch_counter(rank: dict[str, float]):
    """A dictionary from a stretch of text (space marks in place) to its tokens, filled on demand."""
    neighbours = {a + b for piece in rank for a, b in zip(piece, piece[1:])}
    single = {c for c in rank if len(c) == 1}

    def initial(c):
        return 1 if c in single else len(c.encode())

    class Counts(dict):
        def __missing__(self, stretch):
            total, at = 0, 0
            for i in range(1, len(stretch) + 1):
                if i == len(stretch) or stretch[i - 1] + stretch[i] not in neighbours:
                    part = stretch[at:i]
                    known = self.get(part)
                    if known is None:
                        known = sum(map(initial, part)) - (merges(part, rank) if len(part) > 1 else 0)
                        self[part] = known
                    total, at = total + known, i
            if len(self) >= _REMEMBERED:
                self.clear()
            self[stretch] = total
            return total
    return Counts()


# Where spaces end, a stretch of text ends as well: pieces have space marks at the front only.
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def count_tokens(text: str, counts) -> int:
    """The tokens of one text; an empty one has none."""
    if not text:
        return 0
    return sum(map(counts.__getitem__, _STRETCH.findall(SPACE + text.replace(" ", SPACE))))


def _count(ranks):
    def count(batches):
        counts = stretch_counter(ranks.value)
        for batch in batches:
            for table in words.batched_rows(pa.Table.from_batches([batch])):
                _, offsets = words.text_bytes(table.column("text"))
                found = [count_tokens(text, counts) for text in table.column("text").to_pylist()]
                yield from pa.table({
                    "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                    "n_tokens": pa.array(found, pa.int64())}).to_batches()
    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``vocabulary`` is the path of a sentencepiece model, read on the driver; its pieces, whose
    number the model fixes, are broadcast. Texts are counted whole, without added tokens; names of special tokens
    inside a text are ordinary text. NULL and empty texts have 0 bytes and 0 tokens. Rows without
    doc_id and repeated rows are counted like all others; other columns are ignored; an empty
    table gives an empty table.
    """
    rank = read_vocabulary(vocabulary)
    if any(SPACE in piece.lstrip(SPACE) for piece in rank):
        raise ValueError("pieces with a space mark after other characters are not known")
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _count(docs.sparkSession.sparkContext.broadcast(rank)), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
