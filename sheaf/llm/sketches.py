"""Near duplicates by SetSketch registers, banding, a joint likelihood estimate and exact verification.

A document's set of word shingles becomes REGISTERS registers, each the truncated logarithm (base BASE) of the smallest
of the elements' exponential hashes: exponentially spaced, mergeable by maximum, equal with a probability close to the
Jaccard similarity. Documents with equal sets form one node. Bands of registers deal nodes to buckets. In each bucket
every node is paired with one representative; a maximum-likelihood estimate from the counts of larger, smaller and equal
registers discards pairs that are far off, the rest is verified on full sets, and verified links give components. This
is repeated with other representatives for what lies apart. Then the members of a bucket that still lie in different
components are compared block by block, through the same two steps; only links come out. Buckets of two members, and
all but one of the buckets that have the same members, are left out there, since their pairs are compared elsewhere.
So a link between nodes that share a bucket is never lost, while linked copies cost one pair each.

A pair at similarity 0.8 shares no bucket with probability of about 3e-6 (48 bands of 6 out of 192 registers).

Defined cases: null or empty text, or text without words, has an empty set and is linked with nothing; equal sets are
always linked; too few words for a shingle make one; rows of equal doc_id are separate nodes if their sets differ; null doc_id
takes part, never names a component unless no other id can (component null, kept true); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, release, small_batches, stored, unused
from .repeats import _BASE, _C1, _C3, _blocks, _U, _long, keyed, mix, texts_of, word_symbols

REGISTERS, BASE, BANDS, ROWS = 192, 1.02, 48, 6
#: Similarity in hundredths at which two sets are linked.
LINK = 80
#: Rounds in which another node stands for each bucket, before the rest is compared in blocks; members and shingles of
#: a block that one task holds while the bucket's members pass by.
TURNS, BLOCK_NODES, BLOCK_ITEMS = 2, 1000, 1_000_000
#: Pairs whose estimate is below are not verified: nearly five standard errors under 0.8.
DISCARD = 0.66
#: Distinct texts up to which their keys are broadcast to fetch them; beyond, texts are shuffled.
BROADCAST_ROWS = 300_000
_random = np.random.default_rng(1729)
_MULTIPLY = (_random.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_BAND = np.stack([_random.permutation(REGISTERS)[:ROWS] for _ in range(BANDS)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int = 2) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    words, places = word_symbols(_LOWER[raw], bounds)
    if not len(words):
        return [np.zeros(0, _U)] * (len(bounds) - 1)
    grams = words.copy()
    for k in range(1, size):
        grams[:-k] = grams[:-k] * _BASE + words[k:]
    grams = mix(grams)
    out = []
    for s, e in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(grams[s : e - size + 1]))
        elif e > s:  # too few words: the whole sequence is one shingle
            whole = _U(0)
            for w in words[s:e]:
                whole = whole * _C3 + w
            out.append(mix(np.array([whole + _U(e - s)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def registers(elements: np.ndarray) -> np.ndarray:
    """K_i = floor(1 - log_b of the least exponential hash), from 0 to 65535."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (elements >> _U(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        x = short[at : at + 1024, None] * _MULTIPLY[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 1000, 0, 65535).astype(np.uint16)


def band_keys(own: np.ndarray) -> np.ndarray:
    picked, key = own[_BAND].astype(_U), np.arange(BANDS, dtype=_U) * _C1
    for k in range(ROWS):
        key = key * _BASE + picked[:, k]
    return mix(key)


def likely(larger: np.ndarray, smaller: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, grid: int = 51) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers of x are larger and smaller than y's."""
    u = n_x / (n_x + n_y)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, chosen = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.linspace(0, 1, grid):
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        possible = (j <= u / v) & (j <= v / u)
        value = larger * np.log(up) + smaller * np.log(down) + (REGISTERS - larger - smaller) * np.log(np.clip(1 - up - down, 1e-9, 1))
        better = possible & (value > best)
        best, chosen = np.where(better, value, best), np.where(better, j, chosen)
    return chosen


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = texts_of(batch.column(2))
        for low, high in _blocks(bounds):
            own = bounds[low : high + 1]
            sets = shingle_sets(raw[own[0] : own[-1]], own - own[0], size)
            sizes = np.array([len(s) for s in sets])
            node = np.array([s.sum(dtype=_U) for s in map(mix, sets)], _U) if sets else np.zeros(0, _U)
            node = mix(node + sizes.astype(_U) * _C3)
            sketches = [registers(s) if len(s) else None for s in sets]
            keys = [None if r is None else band_keys(r).view(np.int64) for r in sketches]
            part = batch.slice(low, high - low)
            yield pa.record_batch([part.column(0), part.column(1), _long(sizes), _long(node), pa.array([None if r is None else r.tobytes() for r in sketches], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "rk", "n", "node", "registers", "bands"])


def sketched(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("doc_id", "rk", "text").mapInArrow(lean(partial(_sketched, size=size)), "doc_id long, rk long, n long, node long, registers binary, bands array<long>")


def _full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = texts_of(batch.column(1))
        for low, high in _blocks(bounds):
            own = bounds[low : high + 1]
            sets = shingle_sets(raw[own[0] : own[-1]], own - own[0], size)
            items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0).slice(low, high - low), items], names=["node", "items"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(texts_of(batch.column(k))[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for k in ("rx", "ry"))
            n_x, n_y = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("nx", "ny"))
            keep = np.flatnonzero(likely((x > y).sum(1), (x < y).sum(1), n_x, n_y) >= DISCARD)
            yield pa.record_batch([batch.column("x").take(pa.array(keep)), batch.column("y").take(pa.array(keep))], names=["x", "y"])


class _Block:
    """Members of one bucket: nodes, components, sizes, registers and sets."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n")]
            own = np.frombuffer(texts_of(batch.column("registers"))[0].tobytes(), np.uint16).reshape(-1, REGISTERS)
            items = batch.column("items")
            ends = items.offsets.to_numpy()
            values = items.values.to_numpy(zero_copy_only=False).view(_U)  # sorted as such
            self.parts.append((*numbers, own, [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]))

    def all(self) -> tuple:
        return (*(np.concatenate(x) for x in list(zip(*self.parts, strict=True))[:4]), [s for p in self.parts for s in p[4]])


def _met(one: tuple, two: tuple, joined: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Links between members of two blocks, smaller node first; one for each pair of components is enough."""
    node, label, n, own, sets = one
    for at in range(0, len(two[0]), 32):
        y, ly, ny, other, others = (x[at : at + 32] for x in two)
        open_ = (node[:, None] < y[None]) & (label[:, None] != ly[None]) & (n[:, None] * 100 >= ny[None] * LINK) & (ny[None] * 100 >= n[:, None] * LINK)
        i, j = np.nonzero(open_)
        for low in range(0, len(i), 4096):
            a, b = i[low : low + 4096], j[low : low + 4096]
            x, z = own[a], other[b]
            near = np.flatnonzero(likely((x > z).sum(1), (x < z).sum(1), n[a].astype(float), ny[b].astype(float)) >= DISCARD)
            for k in near.tolist():
                p, q = int(a[k]), int(b[k])
                ends = (min(label[p], ly[q]), max(label[p], ly[q]))
                if ends in joined:
                    continue
                small, large = sorted((sets[p], others[q]), key=len)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                if both * 100 >= (len(small) + len(large) - both) * LINK:
                    joined.add(ends)
                    yield int(node[p]), int(y[q])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups (bucket, block), whose rows come together, those of the block itself before all others of the
    bucket; a block without others is the whole bucket."""
    key, block, own, alone, joined = None, _Block(), None, True, set()

    def finished() -> list[tuple[int, int]]:
        return list(_met(mine := block.all(), mine, joined)) if block.parts and alone else []

    for batch in batches:
        found: list[tuple[int, int]] = []
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "block", "side")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if tuple(keys[a, :2]) != key:
                found += finished()
                key, block, own, alone, joined = tuple(keys[a, :2]), _Block(), None, True, set()
            if keys[a, 2] == 0:
                block.add(batch.slice(a, b - a))
            elif block.parts:
                own, alone = own or block.all(), False
                passing = _Block()
                passing.add(batch.slice(a, b - a))
                found += _met(own, passing.all(), joined)
        if found:
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["x", "y"])
    if found := finished():
        yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["x", "y"])


def linked(x: str, y: str):
    """Whether two arrays of distinct items reach the similarity, in whole numbers."""
    both, all_ = F.size(F.array_intersect(x, y)).cast("long"), (F.size(x) + F.size(y)).cast("long")
    sizes = (F.size(x) * 100 >= F.size(y) * LINK) & (F.size(y) * 100 >= F.size(x) * LINK)
    return sizes & (both * 100 >= (all_ - both) * LINK)


#: Edges up to which one task joins them up (16 bytes each); larger graphs go through stars.
ONE_TASK_EDGES = 1_000_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component) of all edges of one task, whose number is checked before."""
    parts = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if not parts:
        return
    edges = np.concatenate(parts, 1)
    nodes, at = np.unique(edges, return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge, label the smallest node reachable: alternating large and small stars."""
    spark = edges.sparkSession
    at = stored(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    if at.count() <= ONE_TASK_EDGES:
        return at.coalesce(1).mapInArrow(lean(_joined_up), "node long, label long")
    while True:
        both = at.unionByName(at.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct(), "large")
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        small = stored(moved.unionByName(down.select("x", F.col("m").alias("y"))).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "small")
        changed = small.join(at, ["x", "y"], "left_anti").limit(1).count() + at.join(small, ["x", "y"], "left_anti").limit(1).count()
        discard(at)
        discard(large)
        at = small
        release(spark)
        if not changed:
            break
    labelled = at.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labelled.unionByName(at.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def near_duplicates(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, rk, n_shingles (of `size` words), label for every row: rows of one label are linked, directly or over others."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    table = stored(sketched(rows, size), "sketches")
    few = stored(table.select("doc_id", "rk", F.col("n").alias("n_shingles"), "node"), "documents")
    nodes = table.where("n > 0").groupBy("node").agg(F.min("rk").alias("rk"), F.min("n").alias("n"), F.any_value("registers").alias("registers"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    discard(table)
    release(spark)
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared")
    members = stored(placed.join(shared, "bucket").select("bucket", F.col("node").alias("x"), "k"), "members")
    release(spark)
    # the node that shares most buckets with others stands for a bucket: of near copies the one closest to all
    weight = members.groupBy("x").agg(F.sum("k").alias("weight"))
    chosen = stored(members.join(weight, "x").groupBy("bucket").agg(F.max(F.struct("weight", "x")).alias("m")).select("bucket", F.col("m.x").alias("y")), "chosen")
    first_pairs = members.join(chosen, "bucket").where("x <> y").select("x", "y").distinct()

    wanted = stored(members.select(F.col("x").alias("node")).distinct(), "wanted")
    side = stored(nodes.join(wanted, "node").select(F.col("node").alias("x"), F.col("registers").alias("rx"), F.col("n").alias("nx")), "registers")
    keys = stored(nodes.join(wanted, "node").select("node", "rk"), "keys")
    discard(nodes)
    release(spark)
    few_keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    full = stored(rows.select("rk", "text").join(few_keys, "rk").select("node", "text").mapInArrow(lean(partial(_full_sets, size=size)), "node long, items array<long>").dropDuplicates(["node"]), "sets")
    release(spark)

    def links_of(pairs: DataFrame) -> DataFrame:
        """The links among pairs (x, y): estimated on registers, then verified on full sets."""
        sized = pairs.join(side, "x").join(side.toDF("y", "ry", "ny"), "y").where(f"nx * 100 >= ny * {LINK} and ny * 100 >= nx * {LINK}")
        near = stored(sized.select("x", "y", "rx", "ry", "nx", "ny").mapInArrow(lean(_estimated), "x long, y long"), "pairs")
        one, two = full.select(F.col("node").alias("x"), F.col("items").alias("ix")), full.select(F.col("node").alias("y"), F.col("items").alias("iy"))
        found = stored(near.join(one, "x").join(two, "y").where(linked("ix", "iy")).select("x", "y"), "links")
        discard(near)
        release(spark)
        return found

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels after components that links connect have become one."""
        if links.isEmpty():
            return labels
        to = labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        joined = components(links.join(to[0], "x").join(to[1], "y").select(F.col("lx").alias("x"), F.col("ly").alias("y")))
        return stored(labels.join(joined.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")

    labels = stored(wanted.select("node", F.col("node").alias("label")), "labels")
    labels = merged(labels, links_of(first_pairs))
    for turn in range(TURNS):  # another node stands for a bucket: most of what is linked joins here, at one pair a node
        placed = members.select("bucket", F.col("x").alias("node")).join(labels, "node").select("bucket", "node", "label")
        some = F.max_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("r")
        apart = stored(placed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), some).where("a <> b").select("bucket", "r"), "apart")
        pairs = placed.join(apart, "bucket").where("label <> r.label").select(F.col("node").alias("x"), F.col("r.node").alias("y"))
        labels = merged(labels, links_of(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()))
    # the rest: every pair of different components, in whole; pairs of a bucket of two met in the first round
    weighed = labels.join(side.select(F.col("x").alias("node"), F.col("nx").alias("n")), "node")
    placed = members.select("bucket", F.col("x").alias("node")).join(weighed, "node").select("bucket", "node", "label", "n")
    sets_of = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), F.min("label").alias("a"), F.max("label").alias("b"), *sets_of).where("a <> b and m > 2")
    sizes = sizes.groupBy("h1", "h2", "m", "items").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    sizes = stored(sizes.select("bucket", "items", blocks.alias("blocks")), "sizes")
    left_over = stored(placed.join(sizes.select("bucket", "blocks"), "bucket"), "open")
    release(spark)
    # a slice ships no more shingles than all documents have
    shipped = sizes.agg(F.sum(F.col("items") * F.when(F.col("blocks") > 1, F.col("blocks") + 1).otherwise(1))).first()[0] or 0
    slices = max(1, -(-shipped // max(few.agg(F.sum("n_shingles")).first()[0] or 1, BLOCK_ITEMS)))
    found: DataFrame | None = None
    whole = side.select(F.col("x").alias("node"), F.col("rx").alias("registers")).join(full, "node")
    for k in range(slices):
        some = left_over if slices == 1 else left_over.where(F.pmod(F.xxhash64("bucket"), F.lit(slices)) == k)
        own = some.select("bucket", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "node", "label", "n")
        others = some.where("blocks > 1").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "node", "label", "n")
        rows_ = own.unionByName(others).join(whole, "node").select("bucket", "block", "side", "node", "label", "n", "registers", "items")
        links = stored(rows_.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side").mapInArrow(lean(_compared), "x long, y long"), "links")
        release(spark)
        found = links if found is None else found.unionByName(links)
    final = merged(labels, found)
    for table in (full, side, keys, left_over):
        discard(table)
    return few.join(final, "node", "left").select("doc_id", "rk", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, kept for every row."""
    rows = stored(near_duplicates(docs), "near")
    ids = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = rows.join(ids, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "rk", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def representatives(docs: DataFrame, size: int) -> DataFrame:
    """The rows of docs, all columns, that stay when one of each class does: the smallest id (a null id only where no
    other is, then the smaller key of the text, then any of identical rows); rows without words, null texts included,
    all stay; columns of docs may have any names."""
    near = stored(near_duplicates(docs, size), "near")
    first = near.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk"))).alias("m"))
    copied = near.where("label is not null").groupBy("rk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rk", F.lit(True).alias("copied"))
    key, many, place = (unused(docs, c) for c in ("_rk", "_many", "_place"))
    stay = first.select("m.rk").join(copied, "rk", "left").select(F.col("rk").alias(key), F.coalesce("copied", F.lit(False)).alias(many))
    stay = stay.unionByName(near.where("label is null").select(F.col("rk").alias(key), F.lit(False).alias(many)).distinct())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text)).join(stay, key)
    # only rows of equal id and text are ranked; a hot row is cut down to its distinct copies before they meet
    ranked = rows.where(F.col(many))
    ranked = ranked.dropDuplicates(docs.columns) if _comparable(docs) else ranked
    single = ranked.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(place) == 1)
    return rows.where(~F.col(many)).select(*docs.columns).unionByName(single.select(*docs.columns))


def _comparable(docs: DataFrame) -> bool:
    """Whether whole rows can be compared: maps can't."""
    return "map<" not in docs.schema.simpleString() and "variant" not in docs.schema.simpleString()


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rk")
