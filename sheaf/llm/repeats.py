"""Finding every position that a repeated window of `width` symbols covers, shared by the byte and the word operator.

Anchors: of each window's k-grams the one with the smallest hash is an anchor, so equal windows have equal anchors at
equal places, and about 2 in `span` positions are anchors. The context of an anchor is all that its windows can reach.

1. Anchors with their context's hash are counted by k-gram (partial aggregates first); those of k-grams that occur once
   are dropped. If all contexts of a k-gram agree, or a context occurs twice, every window of it is repeated.
2. For other contexts one representative each is read again. Their windows are dealt to bins of neighbouring starts; a
   bin whose common part is unique holds no repeat, a bin whose whole extent occurs twice is all repeated.
3. What is left (bins that agree in their common part only) is resolved by the operator's own method, over groups of
   bounded size, or by counting ever finer bins, which works for groups of any size.

Hashes are 64 bits of k-gram and 64 bits of content, compared together. Rows of equal doc_id and text count as separate
occurrences. No step has all occurrences of a key in one task; joins on keys are left to skew handling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, small_batches, stored

_U = np.uint64
_BASE, _C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []
BLOCK = 1 << 18


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n, BLOCK).bit_length()
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> _U(32))
    z = z * _C1
    z ^= z >> _U(29)
    z *= _C2
    return z ^ (z >> _U(32))


class Hashed:
    """Prefix hashes of a sequence of symbols: the hash of any stretch in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        powers, self.inverse = _tables(self.n + 1)
        self.prefix = np.zeros(self.n + 1, dtype=_U)
        np.cumsum(symbols * powers[: self.n], out=self.prefix[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(_U) * _C3)

    def grams(self, k: int) -> np.ndarray:
        m = self.n - k + 1
        return mix((self.prefix[k:] - self.prefix[:m]) * self.inverse[:m])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def byte_symbols(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTES[raw], bounds


def word_symbols(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts raw[bounds[i]:bounds[i+1]], and the bounds counted in words."""
    if not len(raw):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    starts[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Hashed(_BYTES[raw]).stretch(s, e) | _U(1), np.searchsorted(s, bounds)


@dataclass(frozen=True)
class Scheme:
    """width: symbols of a window; gram: of an anchor's k-gram; bin: neighbouring starts that are judged together."""

    width: int
    gram: int
    bin: int
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    item: int  # bytes of a symbol in stored contexts

    @property
    def span(self) -> int:
        return self.width - self.gram + 1

    def anchors(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, place in the text, k-gram hash and context hash of each anchor."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
        if len(symbols) < self.width:
            return none
        hashed, w = Hashed(symbols), self.span
        grams = hashed.grams(self.gram)
        short = (grams >> _U(32)).astype(np.uint32)
        least = _sliding(short, w, np.minimum)
        change = np.zeros(len(symbols) + 1, np.int32)
        long = np.diff(bounds) >= self.width
        np.add.at(change, bounds[:-1][long], 1)
        np.add.at(change, bounds[1:][long] - self.width + 1, -1)
        least[np.cumsum(change)[: len(least)] <= 0] = 0
        pad = np.zeros(w - 1, np.uint32)
        at = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), w, np.maximum) == short) & (short > 0))
        if not len(at):
            return none
        text = np.searchsorted(bounds, at, "right") - 1
        low, high = np.maximum(bounds[text], at - (w - 1)), np.minimum(bounds[text + 1], at + self.width)
        return text, at - bounds[text], grams[at], mix(hashed.stretch(low, high) + (at - low).astype(_U) * _BASE)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the bounds of its rows."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
        yield at, end
        at = end


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and a key of both: rows that agree in it are copies of one another, id included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def anchor_table(rows: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = texts_of(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high in _blocks(bounds):
                own = bounds[low : high + 1]
                symbols, places = scheme.symbols(raw[own[0] : own[-1]], own - own[0])
                text, at, gram, context = scheme.anchors(symbols, places)
                yield pa.record_batch([_long(gram), _long(context), pa.array(keys[low + text]), pa.array(at.astype(np.int32))], names=["a", "c", "rk", "pos"])

    return rows.select("rk", "text").mapInArrow(run, "a long, c long, rk long, pos int")


def _contexts(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = scheme.span
        for batch in batches:
            raw, bounds = texts_of(batch.column(0))
            out: list[tuple] = []
            for k, wanted in enumerate(batch.column(1).to_pylist()):
                own = raw[bounds[k] : bounds[k + 1]]
                if scheme.item > 1:
                    own, _ = scheme.symbols(own, np.array([0, len(own)]))
                for x in wanted:
                    low, high = max(0, x["pos"] - (w - 1)), min(len(own), x["pos"] + scheme.width)
                    out.append((x["a"], x["c"], x["n"], x["pos"] - low, own[low:high].tobytes()))
            a, c, n, left, ctx = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())], names=["a", "c", "n", "left", "ctx"])

    return run


CONTEXT = "a long, c long, n long, left int, ctx binary"


def _laid_out(batch: pa.RecordBatch, scheme: Scheme, column: str = "ctx") -> tuple[Hashed, np.ndarray, np.ndarray]:
    """Prefix hashes over all contexts of a batch, their bounds, and the place of each anchor."""
    raw, bounds = texts_of(batch.column(column))
    symbols = raw.view(_U) if scheme.item > 1 else _BYTES[raw]
    bounds = bounds // scheme.item
    return Hashed(symbols), bounds, bounds[:-1] + batch.column("left").to_numpy(zero_copy_only=False)


def _bins(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, size = scheme.width, scheme.bin
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed, bounds, at = _laid_out(batch, scheme)
            for b in range(-(-scheme.span // size)):
                first, last = at - (b + 1) * size + 1, at - b * size  # the bin's starts, in full
                low, high = np.maximum(np.maximum(first, bounds[:-1]), at - scheme.span + 1), np.minimum(last, bounds[1:] - width)
                ok = np.flatnonzero(low <= high)
                if not len(ok):
                    continue
                low, high, mid = low[ok], high[ok], at[ok]
                common = hashed.stretch(last[ok], first[ok] + width)
                whole = mix(hashed.stretch(low, high + width) + (mid - low).astype(_U) * _C3)
                rows = pa.array(ok)
                yield pa.record_batch([batch.column("a").take(rows), batch.column("c").take(rows), batch.column("n").take(rows), pa.array(np.full(len(ok), b, np.int32)), _long(common), _long(whole), pa.array((low - mid).astype(np.int32)), pa.array((high + width - mid).astype(np.int32))], names=["a", "c", "n", "bin", "ik", "uk", "low", "high"])

    return run


def _windows(scheme: Scheme):
    """A row for each window of the bins that are left: its hash, and the hashes of its first and last width-1 symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = scheme.width
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed, _, at = _laid_out(batch, scheme)
            low = batch.column("low").to_numpy(zero_copy_only=False)
            n = batch.column("high").to_numpy(zero_copy_only=False) - width - low + 1
            row = np.repeat(np.arange(len(n)), n)
            d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
            s = at[row] + d
            take = lambda name: batch.column(name).take(pa.array(row))  # noqa: B023, E731
            yield pa.record_batch([take("a"), take("c"), take("nu"), pa.array(d.astype(np.int32)), _long(hashed.stretch(s, s + width)), _long(hashed.stretch(s, s + width - 1)), _long(hashed.stretch(s + 1, s + width))], names=["a", "c", "nu", "d", "edge", "source", "target"])

    return run


WINDOWS = "a long, c long, nu long, d int, edge long, source long, target long"


def window_table(left_over: DataFrame, scheme: Scheme) -> DataFrame:
    return left_over.select("a", "c", "nu", "left", "ctx", "low", "high").mapInArrow(_windows(scheme), WINDOWS)


def _cut_bins(scheme: Scheme, size: int, finer: int):
    """The rows of bins of `size` starts, dealt to bins of `finer` starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = scheme.width
        for batch in batches:
            if not batch.num_rows:
                continue
            hashed, bounds, at = _laid_out(batch, scheme)
            for k in range(size // finer):
                b = batch.column("bin").to_numpy(zero_copy_only=False).astype(np.int64) * (size // finer) + k
                first, last = at - (b + 1) * finer + 1, at - b * finer
                low, high = np.maximum(np.maximum(first, bounds[:-1]), at - scheme.span + 1), np.minimum(last, bounds[1:] - width)
                ok = np.flatnonzero(low <= high)
                if not len(ok):
                    continue
                low, high, mid, rows = low[ok], high[ok], at[ok], pa.array(ok)
                common = hashed.stretch(last[ok], first[ok] + width)
                whole = mix(hashed.stretch(low, high + width) + (mid - low).astype(_U) * _C3)
                yield pa.record_batch([batch.column("a").take(rows), batch.column("c").take(rows), batch.column("nu").take(rows), pa.array(b[ok].astype(np.int32)), _long(common), _long(whole), pa.array((low - mid).astype(np.int32)), pa.array((high + width - mid).astype(np.int32))], names=["a", "c", "nu", "bin", "ik", "uk", "low", "high"])

    return run


def counted_windows(large: DataFrame, contexts: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, c, low, high) of stretches that cover the windows that occur twice, for groups of any size.

    Bins (a, c, nu, bin, left, ctx) are cut into finer ones, down to single windows. A finer bin that occurs twice as a
    whole is a stretch; those that agree in their common part only are cut again, one of equal ones for all of them.
    """
    rows, size, found = large.select("a", "c", "nu", "bin", "left", "ctx"), scheme.bin, []
    while size > 1:
        finer = size // 2 if size % 2 == 0 else 1
        parts = stored(rows.mapInArrow(_cut_bins(scheme, size, finer), "a long, c long, nu long, bin int, ik long, uk long, low int, high int"), "parts")
        kinds = stored(parts.groupBy(*KEY, "uk").agg(F.sum("nu").alias("n"), F.min("c").alias("c")), "kinds")
        twice = kinds.where("n >= 2").select(*KEY, "uk")
        found.append(stored(parts.join(twice, [*KEY, "uk"], "left_semi").select("a", "c", "low", "high"), "found"))
        several = kinds.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kinds")).where("kinds >= 2").select(*KEY)
        unclear = stored(kinds.join(several, KEY, "left_semi").select("a", "c", F.col("n").alias("nu"), "bin"), "unclear")
        for table in (parts, kinds):
            discard(table)
        release(large.sparkSession)
        size = finer
        if unclear.isEmpty():
            break
        rows = unclear.join(contexts.select("a", "c", "left", "ctx"), ["a", "c"])
    return reduce(DataFrame.unionByName, found)


def repeated_anchors(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, c, rk, pos, pure): the anchors whose k-gram occurs twice; pure where all its contexts agree."""
    anchors = stored(anchor_table(rows, scheme), "anchors")
    again = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n >= 2")
    # stored, so that both sides of the join are plain exchanges and a hot key's partition can be split
    again = stored(again.select("a", (F.col("c0") == F.col("c1")).alias("pure")), "again")
    found = stored(anchors.join(again, "a"), "repeated")
    discard(anchors)
    discard(again)
    release(rows.sparkSession)
    return found


def read_contexts(rows: DataFrame, found: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, c, n, left, ctx): one representative of each distinct context of the k-grams whose contexts differ."""
    mixed = found.where("not pure").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "pos")).alias("at"))
    wanted = mixed.select("a", "c", "n", "at.rk", "at.pos").groupBy("rk").agg(F.collect_list(F.struct("a", "c", "n", "pos")).alias("wanted"))
    contexts = stored(rows.select("rk", "text").join(wanted, "rk").select("text", "wanted").mapInArrow(_contexts(scheme), CONTEXT), "contexts")
    release(rows.sparkSession)
    return contexts


KEY = ["a", "bin", "ik"]


def binned(contexts: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, c, n, bin, ik, uk, low, high) of the bins whose common part occurs twice."""
    bins = contexts.select("a", "c", "n", "left", "ctx").mapInArrow(_bins(scheme), "a long, c long, n long, bin int, ik long, uk long, low int, high int")
    again = stored(bins.groupBy(*KEY).agg(F.sum("n").alias("total")).where("total >= 2").select(*KEY), "again")
    bins = stored(bins.join(again, KEY, "left_semi"), "bins")
    discard(again)
    release(contexts.sparkSession)
    return bins


def everywhere(scheme: Scheme) -> Column:
    """The stretches of an anchor whose whole context is repeated."""
    return F.array(F.struct(F.lit(1 - scheme.span).alias("low"), F.lit(scheme.width).alias("high")))


def covered(docs: DataFrame, scheme: Scheme, resolve: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and (rk, ranges): the stretches of each document that repeated windows cover.

    resolve: from the ambiguous bins (a, c, n, nu, members, ik, bin, low, high, left, ctx) to (a, c, low, high).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs)
    found = repeated_anchors(rows, scheme)
    contexts = read_contexts(rows, found, scheme)
    bins = binned(contexts, scheme)
    whole = bins.groupBy(*KEY, "uk").agg(F.sum("n").alias("nu"), F.min("c").alias("c"), F.min("low").alias("low"), F.min("high").alias("high"))
    whole = stored(whole, "wholes")
    members = whole.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    unclear = whole.join(members, KEY).join(contexts.select("a", "c", "left", "ctx"), ["a", "c"])
    resolved = stored(resolve(unclear).select("a", "c", "low", "high"), "resolved")
    release(spark)

    all_twice = bins.join(whole.where("nu >= 2").select(*KEY, "uk"), [*KEY, "uk"], "left_semi").select("a", "c", "low", "high")
    stretches = all_twice.unionByName(resolved).groupBy("a", "c").agg(F.collect_set(F.struct("low", "high")).alias("own"))
    twice = contexts.where("n >= 2").select("a", "c", everywhere(scheme).alias("own")).distinct()
    partly = stretches.join(contexts.where("n = 1").select("a", "c"), ["a", "c"])
    marks = stored(twice.unionByName(partly), "marks")
    for table in (contexts, bins, whole, resolved):
        discard(table)
    release(spark)
    full = found.where("pure").select("rk", "pos", everywhere(scheme).alias("own"))
    marked = found.where("not pure").join(marks, ["a", "c"]).select("rk", "pos", "own")
    spans = full.unionByName(marked).groupBy("rk").agg(F.collect_list(F.struct("pos", "own")).alias("marks"))
    return rows, spans


def union_of(marks: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """The maximal covered stretches of a sequence of n symbols."""
    if not marks:
        return []
    cover = np.zeros(n + 1, np.int32)
    for m in marks:
        for x in m["own"]:
            cover[max(0, m["pos"] + x["low"])] += 1
            cover[min(n, m["pos"] + x["high"])] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
