"""Repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

Anchors (`repeats`) cut the corpus into groups of suffixes that start at the same 40 bytes. Suffixes that agree in all
that a window can reach are one leaf of the group's tree, with the number of its places as its weight. The distinct
suffixes of a group are sorted, neighbours' common prefixes form the LCP array, and a stack scan lists the intervals of
the tree. For each interval the left extensions are compared: members whose left contexts agree far enough occur
together as a maximal repeat, and all of them, not just neighbours, get its extent. A leaf of weight two or more is an
interval as it stands. Every marked byte comes from such an interval; `repeat_groups` lists the intervals themselves.

Groups of more than `DIRECT` distinct suffixes are split by the longer common part of neighbouring starts (`binned`), where
those that agree in all that these starts reach are one leaf again, and scanned in the same way; parts of more than `MEMBERS` leaves are resolved by counting ever finer bins instead,
so no group has to fit in one task.

Defined cases: a null text is an empty text; a text shorter than 200 bytes keeps everything; a repeat within one
document counts, overlapping or not; copies of whole documents are removed in each of them; matches don't cross
documents; strings are judged on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, small_batches, stored
from .repeats import KEY, Scheme, binned, byte_symbols, counted_windows, keyed, read_contexts, repeated_anchors, texts_of, union_of

SCHEME = Scheme(width=200, gram=40, bin=40, symbols=byte_symbols, item=1)
DIRECT = 1024
MEMBERS = 4096
RESOLVED = "a long, c long, low int, high int"
GROUPS = "a long, node long, length int, c long, begin int"


def lcp_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the interval tree: lcp[i] is the common prefix of ranks i-1 and i; -1 separates groups."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of the rows of two matrices; 0 stands for the end of a row."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _flat(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _shared(lcp: np.ndarray) -> np.ndarray:
    """The longest prefix that each rank shares with any other of its group."""
    return np.maximum(lcp, np.append(lcp[1:], -1))


def _candidates(group: np.ndarray, left: np.ndarray, right: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose longest shared left and right contexts, with whichever partner, reach `need` together, how much each
    shares to its left, and its place in the order of the left contexts: no other row is in a pair that reaches `need`, so the others leave the tree."""
    ahead, after = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for side, most in ((right, after), (left, ahead)):
        order, lcp = _array(group, side)
        most[order] = np.maximum(_shared(lcp), 0)
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group))
    kept = np.flatnonzero(ahead + after >= need)
    return kept, ahead[kept], place[kept]


def _array(group: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted within their groups, and their LCP array."""
    order = np.argsort(_flat(right), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    r, g = right[order], group[order]
    lcp = np.full(len(order), -1)
    lcp[1:] = np.where(g[1:] == g[:-1], _common(r[:-1], r[1:]), -1)
    return order, lcp


def maximal_extents(group: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(row, bytes to the left, bytes to the right) wherever both together reach `need` and occur in another place.

    left: reversed left contexts, right: what follows the common part; as bytes + 1, padded with 0. weight: places of
    the row; with two or more, all of it is repeated.
    """
    heavy = np.flatnonzero(weight >= 2)
    out = list(zip(heavy.tolist(), (left[heavy] > 0).sum(1).tolist(), (right[heavy] > 0).sum(1).tolist(), strict=True))
    kept, bound, place = _candidates(group, left, right, need)
    group, left, right, weight = group[kept], left[kept], right[kept], weight[kept]
    order, lcp = _array(group, right)
    pairs = np.zeros(len(order), np.int64)  # what neighbours in the array share to their left
    pairs[1:] = _common(left[order[:-1]], left[order[1:]])
    beside, depths, rows = pairs.tolist(), lcp.tolist(), kept[order].tolist()
    bound, place = bound[order], place[order]
    told = np.where(weight[order] >= 2, left.shape[1], -1)  # inner intervals come first: outer ones count only if they reach further left
    for depth, first, last in lcp_intervals(lcp):
        if last == first + 1:  # two suffixes, most of the intervals
            most = beside[last]
            if most + depths[last] >= need:
                for at in (first, last):
                    if most > told[at]:
                        told[at] = most
                        out.append((rows[at], most, depth))
            continue
        most = bound[first : last + 1]
        if not ((most > told[first : last + 1]) & (most + depth >= need)).any():  # nothing in it can still grow
            continue
        ranks = first + np.argsort(place[first : last + 1])
        own = order[ranks]
        near = np.zeros(len(own) + 1, np.int64)
        near[1:-1] = _common(left[own[:-1]], left[own[1:]])
        most = np.maximum(near[:-1], near[1:])  # the longest left extension that another shares
        new = np.flatnonzero((most + depth >= need) & (most > told[ranks]))
        told[ranks[new]] = most[new]
        out += zip(kept[own[new]].tolist(), most[new].tolist(), [depth] * len(new), strict=True)
    return out


def maximal_groups(group: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, need: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, rows) of each maximal repeat: extended to either side, its rows differ.

    An interval's members are put in order of their left contexts, and the intervals of those are its left-diverse
    groups; a group that lies in one child of the interval reaches further right and is listed there.
    """
    order, lcp = _array(group, right)
    flat = _flat(left)
    ahead, after = (left > 0).sum(1), (right > 0).sum(1)
    inner = np.zeros(len(order), bool)  # suffixes that lie whole in another one: their leaf is no group of its own
    for depth, first, last in lcp_intervals(lcp):
        ranks = np.arange(first, last + 1)
        ranks = ranks[np.argsort(flat[order[ranks]], kind="stable")]
        own = order[ranks]
        near = np.full(len(own), -1)
        near[1:] = _common(left[own[:-1]], left[own[1:]])
        for reach, low, high in lcp_intervals(near):
            held = ranks[low : high + 1]
            if reach + depth >= need and lcp[held.min() + 1 : held.max() + 1].min() == depth:
                rows = own[low : high + 1]
                inner[rows[(ahead[rows] == reach) & (after[rows] == depth)]] = True
                yield reach, depth, rows.tolist()
    for row in np.flatnonzero((weight >= 2) & ~inner).tolist():
        yield int(ahead[row]), int(after[row]), [row]


def _around(raw: np.ndarray, bounds: np.ndarray, last: np.ndarray, common: int) -> tuple[np.ndarray, np.ndarray]:
    """What precedes `last`, reversed, and what follows the `common` bytes there, within a window's reach."""
    reach = np.arange(SCHEME.width - common)
    raw = np.concatenate([raw, np.zeros(1, np.uint8)])
    before = last[:, None] - 1 - reach
    after = last[:, None] + common + reach
    left = np.where(before >= bounds[:-1, None], raw[np.maximum(before, 0)].astype(np.int16) + 1, 0).astype(np.uint8)
    right = np.where(after < bounds[1:, None], raw[np.minimum(after, len(raw) - 1)].astype(np.int16) + 1, 0).astype(np.uint8)
    return left, right


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group that a batch cuts waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        marks = np.stack([table.column(x).to_numpy() for x in keys], 1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1))
        done = int(cuts[-1]) + 1 if len(cuts) else 0
        if done:
            yield table.slice(0, done).combine_chunks().to_batches()[0]
        rest = table.slice(done)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _numbered(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    marks = np.stack([_numbers(batch, x) for x in keys], 1)
    return np.concatenate([[0], np.cumsum((marks[1:] != marks[:-1]).any(1))])


def _scanned(batch: pa.RecordBatch, keys: list[str], common: int, back: np.ndarray) -> pa.RecordBatch:
    """The extents of a batch of whole groups whose members agree in `common` bytes that start `back` before the anchor."""
    raw, bounds = texts_of(batch.column("ctx"))
    left, right = _around(raw, bounds, bounds[:-1] + _numbers(batch, "left") - back, common)
    hits = maximal_extents(_numbered(batch, keys), left, right, _numbers(batch, "n"), SCHEME.width - common)
    row, low, high = np.array(hits, dtype=np.int64).reshape(-1, 3).T
    take = pa.array(row)
    start = -back[row]
    ends = (pa.array((start - low).astype(np.int32)), pa.array((start + common + high).astype(np.int32)))
    return pa.record_batch([batch.column("a").take(take), batch.column("c").take(take), *ends], names=["a", "c", "low", "high"])


def _scan_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["ik", "a", "bin"]
    for batch in _whole_groups(batches, keys):
        yield _scanned(batch, keys, SCHEME.width - SCHEME.bin + 1, _numbers(batch, "bin").astype(np.int64) * SCHEME.bin)


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that stand for one leaf, read from documents of equal id and text, count once."""
    marks = np.stack([_numbers(batch, x) for x in ("a", "c")], 1)
    first = np.concatenate([[True], (marks[1:] != marks[:-1]).any(1)])
    return batch if first.all() else batch.filter(pa.array(first))


def _scan_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group of one leaf needs no bytes: its interval is the whole context."""
    for batch in _whole_groups(batches, ["a"]):
        batch = _distinct(batch)
        lone = batch.column("ctx").is_null()
        one = batch.filter(lone)
        if one.num_rows:
            low, high = np.full(one.num_rows, 1 - SCHEME.span, np.int32), np.full(one.num_rows, SCHEME.width, np.int32)
            yield pa.record_batch([one.column("a"), one.column("c"), pa.array(low), pa.array(high)], names=["a", "c", "low", "high"])
        many = batch.filter(pc.invert(lone))
        if many.num_rows:
            yield _scanned(many, ["a"], SCHEME.gram, np.zeros(many.num_rows, np.int64))


def _list_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = SCHEME.gram
    for batch in _whole_groups(batches, ["a"]):
        batch = _distinct(batch)
        raw, bounds = texts_of(batch.column("ctx"))
        left, right = _around(raw, bounds, bounds[:-1] + _numbers(batch, "left"), common)
        a, c, out = _numbers(batch, "a"), _numbers(batch, "c"), []
        for node, (low, high, rows) in enumerate(maximal_groups(_numbered(batch, ["a"]), left, right, _numbers(batch, "n"), SCHEME.width - common)):
            out += [(a[r], node, low + common + high, c[r], -low) for r in rows]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["a", "node", "length", "c", "begin"])


def resolve(unclear: DataFrame, contexts: DataFrame, members: int = MEMBERS, crowded: bool = True) -> DataFrame:
    """(a, c, low, high) of the repeats in bins (a, bin, ik, members, nu, c, low, high, left, ctx); crowded: whether some
    have more than `members`."""
    small = unclear.where(F.col("members") <= members).select("a", "c", F.col("nu").alias("n"), "bin", "ik", "left", "ctx")
    scanned = small.repartition("ik", "a", "bin").sortWithinPartitions("ik", "a", "bin").mapInArrow(_scan_bins, RESOLVED)
    return scanned.unionByName(counted_windows(unclear.where(F.col("members") > members), contexts, SCHEME)) if crowded else scanned


def _split(contexts: DataFrame, members: int) -> DataFrame:
    """The repeats of groups that are too large for one scan, over bins of neighbouring starts.

    Members that agree in all that a bin's windows reach are one leaf of the bin; where a leaf has several places, all of
    the bin's windows are repeated in each of its members. So only distinct leaves are scanned or cut, by one member each.
    """
    bins = binned(contexts, SCHEME)
    leaves = stored(bins.groupBy(*KEY, "uk").agg(F.sum("n").alias("nu"), F.min("c").alias("c")), "leaves")
    # a context of several places is repeated in whole; the others are where their leaves have other members
    repeated = bins.where("n < 2").join(leaves.where("nu >= 2").select(*KEY, "uk"), [*KEY, "uk"], "left_semi").select("a", "c", "low", "high")
    own = contexts.where((F.col("n") >= 2) & (F.octet_length("ctx") >= SCHEME.width))
    repeated = repeated.unionByName(own.select("a", "c", (-F.col("left")).alias("low"), (F.octet_length("ctx") - F.col("left")).alias("high")))
    sizes = stored(leaves.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).where("members >= 2"), "sizes")
    unclear = leaves.join(sizes, KEY).join(contexts.select("a", "c", "left", "ctx"), ["a", "c"])
    crowded = not sizes.where(F.col("members") > members).isEmpty()
    return stored(resolve(unclear, contexts, members, crowded).select("a", "c", "low", "high").unionByName(repeated), "split")


def extents(docs: DataFrame, direct: int = DIRECT, members: int = MEMBERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed documents, their anchors (a, c, rk, pos), and (a, c, own): the repeated stretches around each anchor."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs)
    found = repeated_anchors(rows, SCHEME)
    contexts = read_contexts(rows, found, SCHEME)
    large = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > direct).select("a")
    large = stored(large, "large")
    nothing = F.lit(None)
    lone = found.where("pure").groupBy("a").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"))
    lone = lone.select("a", "c", "n", nothing.cast("int").alias("left"), nothing.cast("binary").alias("ctx"))
    leaves = contexts.join(large, "a", "left_anti").unionByName(lone)
    scanned = leaves.repartition("a").sortWithinPartitions("a", "c").mapInArrow(_scan_anchors, RESOLVED)
    scanned = stored(scanned, "extents")
    everything = scanned
    if not large.isEmpty():
        everything = scanned.unionByName(_split(stored(contexts.join(large, "a", "left_semi"), "crowded"), members))
    # All extents of an anchor hold its k-gram, so together they are one stretch.
    reach = F.struct(F.min("low").alias("low"), F.max("high").alias("high"))
    own = stored(everything.groupBy("a", "c").agg(F.array(reach).alias("own")), "marks")
    for table in (contexts, large, scanned):
        discard(table)
    release(spark)
    return rows, found, own


def repeated_spans(docs: DataFrame, direct: int = DIRECT, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """The documents with their key, and the marked stretches by key."""
    rows, found, own = extents(docs, direct, members)
    marked = found.join(own, ["a", "c"]).select("rk", "pos", "own")
    return rows, marked.groupBy("rk").agg(F.collect_list(F.struct("pos", "own")).alias("marks"))


def repeat_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, anchor, node): all occurrences of each maximal repeat of 200 bytes or more around an
    anchor, within 160 bytes to its left and 200 to its right; (anchor, node) names the repeat. A longer repeat comes as
    several such groups, one for each anchor. One task holds all distinct contexts of an anchor."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    found = repeated_anchors(rows, SCHEME)
    both = found.withColumn("pure", F.lit(False))
    leaves = read_contexts(rows, both, SCHEME).repartition("a").sortWithinPartitions("a", "c")
    groups = stored(leaves.mapInArrow(_list_groups, GROUPS), "groups")
    ids = rows.select("rk", "doc_id").distinct()
    placed = groups.join(found.select("a", "c", "rk", "pos"), ["a", "c"]).join(ids, "rk")
    return placed.select("doc_id", (F.col("pos") + F.col("begin")).alias("start"), "length", F.col("a").alias("anchor"), "node")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = texts_of(batch.column(1))
        out = []
        for k, marks in enumerate(batch.column(2).to_pylist()):
            own = raw[bounds[k] : bounds[k + 1]].tobytes()
            runs = union_of(marks, len(own))
            hashed, done = hashlib.sha256(), 0
            for s, e in runs:
                hashed.update(own[done:s])
                done = e
            hashed.update(own[done:])
            out.append((len(own), sum(e - s for s, e in runs), len(runs), hashed.hexdigest()))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, spans = repeated_spans(docs)
    return rows.join(spans, "rk", "left").select("doc_id", "text", "marks").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
