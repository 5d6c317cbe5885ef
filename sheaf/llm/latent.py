"""Benchmark decontamination by latent semantic retrieval.

Words (A-Z lower-cased, ASCII punctuation as white space) are numbered by the benchmark's vocabulary; a document becomes
the sequence of its word numbers, 0 for any other word, in one compact table. Passages are windows of words weighted by
TF-IDF with frequencies counted over all passages of all documents. A distributed randomised SVD (one pass sums
A'A Omega over all passages; the factors follow by the Nystroem formula on the driver, whose size is that of the
benchmark's vocabulary) gives latent vectors, scaled by the singular values so that no common direction rules them.

The cosine alone makes the candidates: every document is cut into overlapping windows of about the length of an item
(widths grow by half, a window starts every quarter of its width), and each window is compared with all items of its
width by one matrix product. Candidates are verified by the longest common subsequence with the item's words: a copy has
`COPY` of them in order, a paraphrase `PARAPHRASE` of them and `ANSWER` of the answer, the item's rarest words.

Large benchmarks are searched in blocks of bounded rows and bytes. Defined cases: null or empty texts match nothing; an
item without words is never found; an item with a null id is reported with that null; repeated items are each reported;
repeated documents are each reported; items shorter than `SHORT` words count only if all their words follow in order;
a document of any length is searched whole, in segments that overlap; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, small_batches, stored, unused
from .repeats import _U, _blocks, texts_of, word_symbols

WINDOW, RANK, OVERSAMPLE = 48, 64, 16
#: Cosine of candidates; shares of the item's words in the common subsequence for a copy and for a paraphrase; share
#: of the answer words that a paraphrase must have; words of an answer; items too short for a paraphrase.
CANDIDATE, COPY, PARAPHRASE, ANSWER, ANSWER_WORDS, SHORT = 0.4, 0.75, 0.5, 0.375, 8, 8
#: Items and bytes of items of a block; words that are searched at once.
BLOCK_ITEMS, BLOCK_BYTES, SEGMENT = 1_000, 1 << 18, 1 << 13
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[65:91] += 32
_SPACED[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_symbols(_SPACED[raw], bounds)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items: ids, their word numbers, and the sorted hashes that number the vocabulary from 1."""

    ids: pa.Array
    words: list[np.ndarray]
    vocabulary: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Items:
        raw, bounds = texts_of(pa.array([t or "" for t in texts], pa.large_string()))
        hashes, places = word_hashes(raw, bounds)
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        kept = [k for k in range(len(ids)) if places[k + 1] > places[k]]
        return cls(pa.array([ids[k] for k in kept], pa.int64()), [numbers[places[k] : places[k + 1]].astype(np.int32) + 1 for k in kept], vocabulary)


def _numbering(vocabulary: np.ndarray):
    """From hashes to word numbers: one look into a direct table, a binary search only where two words share its slot."""
    bits = max(16, int(len(vocabulary)).bit_length() + 6)
    slot = (vocabulary >> _U(64 - bits)).astype(np.int64)
    first = np.zeros(1 << bits, np.int32)
    first[slot[::-1]] = np.arange(len(vocabulary), 0, -1, dtype=np.int32)
    crowded = np.zeros(1 << bits, bool)
    values, counts = np.unique(slot, return_counts=True)
    crowded[values[counts > 1]] = True
    top = np.concatenate([np.zeros(1, _U), vocabulary])

    def number(hashes: np.ndarray) -> np.ndarray:
        own = (hashes >> _U(64 - bits)).astype(np.int64)
        found = first[own]
        found[top[found] != hashes] = 0
        rest = np.flatnonzero(crowded[own] & (found == 0))
        if len(rest):
            at = np.minimum(np.searchsorted(vocabulary, hashes[rest]), len(vocabulary) - 1)
            found[rest] = np.where(vocabulary[at] == hashes[rest], at + 1, 0)
        return found

    return number


def numbered(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id and the word numbers of every document, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbering(vocabulary)
        for batch in batches:
            raw, bounds = texts_of(batch.column(1))
            out: list[bytes] = []
            for low, high in _blocks(bounds):
                own = bounds[low : high + 1]
                hashes, places = word_hashes(raw[own[0] : own[-1]], own - own[0])
                numbers = number(hashes)
                out += [numbers[s:e].tobytes() for s, e in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "words"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lean(run), "doc_id long, words binary")


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, bounds = texts_of(batch.column("words"))
    return raw.view(np.int32), bounds // 4


def passage_frequencies(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and the number of passages; over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1)
        for batch in batches:
            words, bounds = _sequences(batch)
            passage, n = _passages(bounds)
            known = np.flatnonzero(words > 0)
            pairs = passage[known] * (size + 1) + words[known]
            for at in range(0, len(pairs), 1 << 16):  # sorted runs stay in the cache; a passage cut in two is put right
                part = pairs[at : at + (1 << 16)]
                base = int(part[0]) // (size + 1) * (size + 1)
                wide = np.uint32 if int(part[-1]) - base + size < 1 << 32 else np.int64
                own = np.sort((part - base).astype(wide))
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                if at:
                    cut = own < size + 1
                    again = np.isin(own[cut], (last[last // (size + 1) == base // (size + 1)] - base).astype(wide))
                    own = np.concatenate([own[cut][~again], own[~cut]])
                counts += np.bincount(own % (size + 1), minlength=size + 1)
                last = pairs[max(0, at + (1 << 16) - WINDOW) : at + (1 << 16)]
            counts[0] += n  # 0 counts all passages
        k = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(counts[k])], names=["k", "n"])

    counts = np.zeros(size + 1)
    for r in table.select("words").mapInArrow(lean(run), "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts, int(counts[0])


def _passages(bounds: np.ndarray) -> tuple[np.ndarray, int]:
    """The passage number of each word: passages of WINDOW words, none reaching into the next document."""
    lengths = np.diff(bounds)
    per_text = -(-lengths // WINDOW)
    first = np.cumsum(per_text) - per_text
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    return np.repeat(first, lengths) + within // WINDOW, int(per_text.sum())


def singular_vectors(table: DataFrame, weights: np.ndarray, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of the normalised TF-IDF passages, each over its singular value, so that all
    latent directions weigh the same in a cosine; a row for each word number."""
    size = len(weights)
    l = min(RANK + OVERSAMPLE, size)
    omega = np.random.default_rng(seed).normal(size=(size, l)).astype(np.float32)
    omega[0] = 0
    names = [f"v{j}" for j in range(l)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, l))
        own_weights = weights.astype(np.float32)
        weighted = omega * own_weights[:, None]
        for batch in batches:
            words, bounds = _sequences(batch)
            passage, n = _passages(bounds)
            known = np.flatnonzero(words > 0)
            every, passage = words[known], passage[known]
            starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(known) else np.zeros(0, int)
            for at in range(0, len(starts), 512):  # so many passages stay in the cache
                cut = starts[at : at + 512]
                words = every[cut[0] : starts[at + 512] if at + 512 < len(starts) else len(every)]
                cut = cut - cut[0]
                own = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(words))))
                square = np.add.reduceat(own_weights[words] ** 2, cut)
                y = np.add.reduceat(weighted[words], cut, axis=0) / np.maximum(square, 1e-9)[:, None]
                by_word = np.argsort(words, kind="stable")
                ordered = words[by_word]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                total[ordered[first]] += np.add.reduceat(y[own[by_word]], first, axis=0)
        total *= weights[:, None]
        k = np.flatnonzero(np.abs(total).sum(1))
        yield pa.record_batch([pa.array(k.astype(np.int32)), *[pa.array(total[k, j]) for j in range(l)]], names=["k", *names])

    summed = table.select("words").mapInArrow(lean(run), "k int, " + ", ".join(f"{x} double" for x in names)).groupBy("k").agg(*[F.sum(x).alias(x) for x in names])
    product = np.zeros((size, l))
    for r in summed.collect():
        product[r["k"]] = [r[x] for x in names]
    core = omega.T.astype(float) @ product
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    kept = values > max(values.max(), 1e-12) * 1e-9
    factor = product @ (vectors[:, kept] / np.sqrt(values[kept]))
    left, root, _ = np.linalg.svd(factor, full_matrices=False)
    return left[:, :RANK] / np.maximum(root[:RANK], 1e-6)


def common_subsequence(places: dict[int, int], n: int, seen: list[int]) -> int:
    """Length of the longest common subsequence of an item of n words, given as the bits of the places of each word, and
    the words seen: a row of the table is one number of n bits."""
    full = row = (1 << n) - 1
    for word in seen:
        if here := places.get(word):
            both = row & here
            row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def _places(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def width_of(length: int) -> int:
    """The window width for an item: the first of 2, 3, 5, 8, 12 ... (half more each) that holds it."""
    width = 2
    while width < length:
        width += -(-width // 2)
    return width


def segments(bounds: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of pieces of at most SEGMENT + overlap words that overlap, so that each window lies in one."""
    lengths = np.diff(bounds)
    n = np.maximum(1, -(-lengths // SEGMENT))
    text = np.repeat(np.arange(len(lengths)), n)
    start = bounds[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
    return text, start, np.minimum(start + SEGMENT + overlap, bounds[text + 1])


def windows(begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of the windows of each segment: one every quarter of the width and one at the end."""
    spare = np.maximum(end - begin - width, 0)
    stride = max(1, width // 4)
    n = np.where(end > begin, -(-spare // stride) + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    return own, begin[own] + np.minimum((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * stride, spare[own])


def _searched(items: Items, weights: np.ndarray, vectors: np.ndarray):
    lengths = np.array([len(w) for w in items.words])
    rarest = [sorted({x for x in w.tolist() if weights[x] > 0}, key=lambda x: (-weights[x], x))[:ANSWER_WORDS] for w in items.words]
    asked = np.array([max(len(x), 1) for x in rarest])
    projected = (weights[:, None] * vectors).astype(np.float32)
    latent = np.stack([projected[w].sum(0) for w in items.words])
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
    widths = np.array([width_of(n) for n in lengths.tolist()])
    of_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    overlap = int(widths.max()) * 2
    short = lengths < SHORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.zeros((len(lengths), len(weights)), np.uint8)  # 1: a word of the item, 17: one of its answer words
        for k, words in enumerate(items.words):
            member[k, words] = 1
            member[k, rarest[k]] = 17
        places: dict[int, tuple[dict[int, int], set[int]]] = {}

        def close(words: np.ndarray, sums: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
            """Segment, item, cosine and stretch of the windows whose vector is close to an item of this width."""
            segment, start = windows(begin, end, width)
            stop = np.minimum(start + width, end[segment])
            z = sums[first[stop]] - sums[first[start]]
            norm = np.sqrt(np.einsum("ij,ij->i", z, z))
            some = np.flatnonzero(norm > 1e-4)
            own = of_width[width]
            near = (z[some] / norm[some, None]) @ latent[own].T
            w, k = np.nonzero(near >= CANDIDATE)
            segment, start, stop, margin = segment[some[w]], start[some[w]], stop[some[w]], width // 4
            return segment, own[k], near[w, k], np.maximum(start - margin, begin[segment]), np.minimum(stop + margin, end[segment])

        def verified(words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Which candidates copy or paraphrase their item, and their shares. Counts of the item's words come first:
            a stretch can't have more of them in order than it has at all."""
            kept, share, answer = [], [], []
            for at in range(0, len(item), 4096):
                i, a, b = item[at : at + 4096], low[at : at + 4096], high[at : at + 4096]
                place = a[:, None] + np.arange(int((b - a).max()))
                is_own = member[i[:, None], np.where(place < b[:, None], words[np.minimum(place, len(words) - 1)], 0)]
                n, rare = (is_own > 0).sum(1), (is_own > 16).sum(1)
                most = n / lengths[i]
                possible = np.where(short[i], most >= 1, (most >= COPY) | ((most >= PARAPHRASE) & (rare >= ANSWER * asked[i])))
                for c in np.flatnonzero(possible).tolist():
                    k = int(i[c])
                    if k not in places:
                        places[k] = _places(items.words[k]), set(rarest[k])
                    bits, wanted = places[k]
                    seen = words[a[c] : b[c]].tolist()
                    s, r = common_subsequence(bits, int(lengths[k]), seen) / lengths[k], len(wanted.intersection(seen)) / asked[k]
                    if s >= (1 if short[k] else COPY) or not short[k] and s >= PARAPHRASE and r >= ANSWER:
                        kept.append(at + c)
                        share.append(s)
                        answer.append(r)
            return np.array(kept, np.int64), np.array(share), np.array(answer)

        for batch in batches:
            every, bounds = _sequences(batch)
            text, begin, end = segments(bounds, overlap)
            near: list[tuple] = []
            at = 0
            while at < len(text):  # segments of about SEGMENT words at a time
                to = max(at + 1, int(np.searchsorted(end, begin[at] + SEGMENT, "right")))
                low, high = int(begin[at]), int(end[at:to].max())
                words = every[low:high]
                known = np.flatnonzero(words > 0)
                if len(known):
                    first = np.concatenate([[0], np.cumsum(words > 0)])
                    sums = np.zeros((len(known) + 1, projected.shape[1]), np.float32)
                    np.cumsum(projected[words[known]], axis=0, out=sums[1:])
                    for width in of_width:
                        segment, item, cosine, a, b = close(words, sums, first, begin[at:to] - low, end[at:to] - low, width)
                        good, share, answer = verified(words, item, a, b) if len(item) else (np.zeros(0, np.int64),) * 3
                        if len(good):
                            near.append((text[at + segment[good]], item[good], cosine[good], share, answer))
                at = to
            if not near:
                continue
            t, k, c, s, r = (np.concatenate(x) for x in zip(*near, strict=True))
            order = np.lexsort((-c, -s, k, t))
            t, k, c, s, r = t[order], k[order], c[order], s[order], r[order]
            best = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(t[best])), items.ids.take(pa.array(k[best])), pa.array(c[best].astype(float)), pa.array(s[best]), pa.array(r[best])], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


RESULT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of every benchmark item found in a document."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = ordered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found: DataFrame | None = None
    blocks = max(-(-n // block_items), -(-size // BLOCK_BYTES))
    for b in range(blocks):
        own = ordered if blocks == 1 else ordered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = own.collect()
        items = Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(items.ids):
            continue
        table = stored(numbered(docs, items.vocabulary), "words")
        counts, passages = passage_frequencies(table, len(items.vocabulary))
        weights = np.where(counts > 0, np.log((passages + 1) / (counts + 0.5)), 0)  # words that no document has find nothing
        weights[0] = 0
        vectors = singular_vectors(table, weights)
        hits = stored(table.mapInArrow(lean(_searched(items, weights, vectors)), RESULT), "hits")
        discard(table)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], RESULT) if found is None else found


#: Contaminated documents up to which their keys are broadcast; beyond, texts are shuffled.
BROADCAST_ROWS = 300_000


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. Rows of equal id and text go or stay together; null
    and empty texts stay; without items all rows stay."""
    key, name = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), unused(docs, "_rk")
    hits = stored(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name)).distinct(), "hits")
    few = hits.count() <= BROADCAST_ROWS
    return docs.withColumn(name, key).join(F.broadcast(hits) if few else hits, name, "left_anti").select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contaminated(docs, benchmark)
    return out.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("cosine", "lcs_share", "answer_share")])
