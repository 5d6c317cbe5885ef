"""Packing token pieces into sequences by swap-based local search.

Documents become token pieces (`pieces`); pieces are dealt round-robin to shards of bounded size and each shard is
packed on its own: best fit decreasing, then a local search over the underfull bins that moves one document, exchanges
one for one, or two for one, whenever the sum of squared fills grows, so that fuller bins fill up and the emptiest run
empty. What is left in underfull bins of all shards is dealt and packed again, round by round, while that empties bins,
so the loss doesn't grow with the number of shards.

Defined cases: a null or empty text is one piece that holds only the end token; repeated rows are packed once each;
a document of more than `capacity` tokens is cut so that only its first piece is shorter; ties are broken by the order
of rows in a shard; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, stored

CAPACITY = 2048
SHARD_ROWS = 40_000
#: Rounds after which what is left keeps its last packing.
LEVELS = 20
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, _fill long"


@lru_cache(maxsize=2)
def _tokenizer(tokenizer_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str):
    """Encode a list of texts. The vocabulary also exists as ranks, which are several times faster and give the same
    ids; texts with the special token's string, and vocabularies without a ranks file, go to the tokenizers library."""
    import os

    def plain(text: str) -> list[int]:
        return _tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids

    ranks = tokenizer_path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: plain(text) if SPECIAL in text else fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenised(tokenizer_path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_tokenised(tokenizer_path, end_id, capacity)), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing; a bit set of the free room in use finds the tightest bin in a few operations."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


def _best_change(own: np.ndarray, other: np.ndarray, room: int) -> tuple[int, list[int], list[int]]:
    """The change between a fuller bin with room and an emptier one that fills most: gain, what goes out, what comes in.

    Only distinct lengths are tried; a bin of 2048 tokens has at most 63 of them, which bounds the tables below.
    """

    def choices(lengths: np.ndarray) -> tuple[np.ndarray, list[list[int]], np.ndarray, list[list[int]]]:
        values, first, counts = np.unique(lengths, return_index=True, return_counts=True)
        a, b = np.triu_indices(len(values), 0)
        kept = (a != b) | (counts[a] > 1)
        a, b = a[kept], b[kept]
        twos = [[int(first[i]), int(first[j]) if i != j else int(np.flatnonzero(lengths == values[i])[1])] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        return values, [[int(i)] for i in first], values[a] + values[b], twos

    one, ones, two, twos = choices(other)
    have, haves, pair, pairs = choices(own)
    nothing = (np.zeros(1, dtype=np.int64), [[]])
    best: tuple[int, list[int], list[int]] = (0, [], [])
    for (out, outs), (into, intos) in ((nothing, (one, ones)), ((have, haves), (one, ones)), ((have, haves), (two, twos)), ((pair, pairs), (one, ones))):
        if best[0] < room and len(out) and len(into):
            gain = into[None, :] - out[:, None]
            gain = np.where(gain <= room, gain, 0)
            if gain.max() > best[0]:
                i, j = np.unravel_index(int(gain.argmax()), gain.shape)
                best = (int(gain[i, j]), outs[i], intos[j])
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, neighbours: int = 12, rounds: int = 40) -> list[list[int]]:
    """Fill the fuller of the underfull bins from the emptier ones until no change raises the sum of squared fills."""
    fill = [int(lengths[b].sum()) for b in bins]
    for _ in range(rounds):
        if sum(f > 0 for f in fill) <= -(-sum(fill) // capacity):  # no bin can be saved any more
            break
        order = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: -fill[k])
        changed = False
        for at, k in enumerate(order):
            for other in reversed(order[at + 1 :][-neighbours:]):
                if fill[other] == 0 or fill[k] >= capacity or fill[other] > fill[k]:
                    continue
                gain, out, into = _best_change(lengths[bins[k]], lengths[bins[other]], capacity - fill[k])
                if gain <= 0:
                    continue
                moved_out, moved_in = [bins[k][i] for i in out], [bins[other][j] for j in into]
                bins[k] = [x for i, x in enumerate(bins[k]) if i not in out] + moved_in
                bins[other] = [x for j, x in enumerate(bins[other]) if j not in into] + moved_out
                fill[k] += gain
                fill[other] -= gain
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _packed(level: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        lengths = rows.column("length").to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        sizes = np.array([len(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins = ends - lengths[order]
        fill = np.add.reduceat(lengths[order], first)
        base = (level << 56) + (TaskContext.get().partitionId() << 24)
        out = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(order))
        for name, values in (("sequence_id", base + number), ("offset", begins - begins[first][number]), ("_fill", fill[number])):
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        yield from out.to_batches()

    return run


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, levels: int = LEVELS) -> DataFrame:
    """Every piece with the sequence that it lies in and its place there."""
    done: DataFrame | None = None
    rest, before = cut_pieces, None
    for level in range(levels):
        n, tokens = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
        shards = max(1, -(-n // shard_rows))
        now = stored(rest.repartition(shards).mapInArrow(lean(_packed(level, capacity)), PACKED), "packed")
        full = now.where(F.col("_fill") >= capacity) if shards > 1 else now
        done = full if done is None else done.unionByName(full)
        if shards == 1:
            break
        rest = now.where(F.col("_fill") < capacity)
        if before is not None and tokens > 0.9 * before or level == levels - 1:  # what is left hardly shrinks or was packed often enough: keep its packing
            done = done.unionByName(rest)
            break
        before = tokens
    return done.drop("_fill")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(stored(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
