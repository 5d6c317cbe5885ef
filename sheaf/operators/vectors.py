"""Embedders and vector search: hashing grams (E1), prefixes (E2, E3), exact top-k (V1, V2), LSH (V3), lookup (V4)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sheaf.sources.scratch import stored

#: Prefixes that model families expect.
PREFIXES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", ""), "none": ("", "")}
#: Bytes of query vectors that one pass holds in each task; more queries go in blocks.
QUERY_BYTES = 64 << 20
#: Bytes of scores that a task works out at once.
SCORE_BYTES = 8 << 20


def _slot(gram: str, dim: int) -> tuple[int, int]:
    digest = hashlib.blake2b(gram.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dim, 1 if digest[4] & 1 else -1


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists of 32-bit numbers."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix, np.float32).ravel()))


def hashing_embedding(rows: DataFrame, id_column: str, dim: int = 256, n: int = 2, normalize: bool = True) -> DataFrame:
    """(id, vec). White space goes in the JVM; grams are counted and hashed where the row is, each distinct gram of
    a batch once, so nothing is shuffled."""
    kind = rows.schema[id_column].dataType.simpleString()
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, slots = np.zeros((batch.num_rows, dim)), {}
            for row, text in zip(out, batch.column(1).to_pylist(), strict=True):
                for gram, count in Counter(map("".join, zip(*(text[k:] for k in range(n)), strict=False))).items():
                    if (slot := slots.get(gram)) is None:
                        slot = slots[gram] = _slot(gram, dim)
                    row[slot[0]] += slot[1] * count
            if normalize:
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                out /= np.where(norm > 0, norm, 1.0)
            yield pa.record_batch([batch.column(0), _lists(out)], names=["id", "vec"])

    return rows.select(id_column, flat.alias("_flat")).mapInArrow(dense, f"id {kind}, vec array<float>").withColumnRenamed("id", id_column)


def prefix_style(model: str) -> str:
    """E3."""
    return next((s for s in ("e5", "bge") if re.search(rf"(^|[/_-]){s}([/_-]|$)", model.lower())), "none")


def with_prefix(text: Column, model: str, query: bool) -> Column:
    return F.concat(F.lit(PREFIXES[prefix_style(model)][0 if query else 1]), text)


def model_embedding(rows: DataFrame, id_column: str, model: str, encode: Callable[[list[str]], np.ndarray] | None = None, query: bool = False) -> DataFrame:
    """One model per worker; `encode` may be given, else the sentence-transformers library is asked for it."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encode is not None:
            own = encode
        else:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as error:
                raise ImportError(f"{model} needs the sentence-transformers library") from error
            own = SentenceTransformer(model).encode
        for batch in batches:
            vectors = np.asarray(own(batch.column(1).to_pylist()), dtype=np.float32)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["id", "vec"])

    return rows.select(F.col(id_column), with_prefix(F.col("text"), model, query)).mapInArrow(run, f"id {kind}, vec array<float>").withColumnRenamed("id", id_column)


def _first_copies(vectors: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The places in the given order without copies of a vector after its first k: no query has those among its k best."""
    mixed = (vectors[order].view(np.uint64) * np.random.default_rng(0).integers(1 << 63, size=vectors.shape[1], dtype=np.uint64)).sum(axis=1)
    by = np.argsort(mixed, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], mixed[by][1:] != mixed[by][:-1]]))
    sizes = np.diff(np.append(first, len(by)))
    if sizes.max() <= k:
        return order
    start = np.repeat(first, sizes)
    other = (vectors[order[by]] != vectors[order[by[start]]]).any(axis=1)
    spared = np.repeat(np.logical_or.reduceat(other, first), sizes)  # another vector of the same sum: all stay
    return order[np.sort(by[spared | (np.arange(len(by)) - start < k)])]


def _inner(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """All inner products, and how far one can be off: a product's last digits depend on its place in the matrix."""
    return queries @ vectors.T, 1e-12 * np.linalg.norm(queries, axis=1).max() * np.linalg.norm(vectors, axis=1).max()


def _inner_pairs(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Added in longer numbers, so that equal products are equal whatever their parts."""
    return (queries.astype(np.longdouble) * vectors).sum(axis=1).astype(float)


def _searched(block: np.ndarray, ids: np.ndarray, kind: pa.DataType, k: int, scores_of=_inner, scores_of_pairs=_inner_pairs):
    """The k best of a task's vectors for each query of a block. Scores are worked out a tile of bounded size at a time;
    those that reach the k-th best so far are worked out again pair by pair, so equal vectors have equal scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        places, names, schema = None, np.full(best.shape, None, object), None
        for batch in batches:
            schema = batch.schema
            if not batch.num_rows or not len(ids):
                continue
            own, place = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("corpus_ord").to_numpy(zero_copy_only=False)
            at = _first_copies(own, np.argsort(place, kind="stable"), k)
            places = np.full(best.shape, place[0], place.dtype) if places is None else places
            own, place, name = own[at], place[at], np.array([*batch.column("chunk_id").take(pa.array(at)).to_pylist(), None], object)[:-1]
            step = max(1, SCORE_BYTES // (8 * len(own)))
            for low in range(0, len(ids), step):
                asked = block[low : low + step]
                scores, off = scores_of(asked, own)
                least = np.maximum(best[low : low + step, -1] - off, np.finfo(float).min)
                met = scores >= least[:, None]
                many = np.flatnonzero(met.sum(axis=1) > 2 * k)
                if len(many):
                    met[many] &= scores[many] >= (np.partition(scores[many], len(own) - k, axis=1)[:, len(own) - k] - off)[:, None]
                q, v = np.nonzero(met)
                if not len(q):
                    continue
                exact = np.concatenate([scores_of_pairs(asked[q[i : i + 16384]], own[v[i : i + 16384]]) for i in range(0, len(q), 16384)])
                rows = np.unique(q)
                mine = rows + low
                every_q, every_s = np.concatenate([np.repeat(rows, k), q]), np.concatenate([best[mine].ravel(), exact])
                every_p, every_n = np.concatenate([places[mine].ravel(), place[v]]), np.concatenate([names[mine].ravel(), name[v]])
                order = np.lexsort((every_p, -every_s, every_q))
                top = order[np.searchsorted(every_q[order], rows)[:, None] + np.arange(k)]
                best[mine], places[mine], names[mine] = every_s[top], every_p[top], every_n[top]
        for low in range(0, 0 if places is None else len(ids), 65536 // k + 1):
            q, r = np.nonzero(best[low : low + 65536 // k + 1] > -np.inf)
            q += low
            columns = [pa.array(ids[q], kind), pa.array(names[q, r], schema.field("chunk_id").type), pa.array(places[q, r], schema.field("corpus_ord").type), pa.array(best[q, r])]
            yield pa.record_batch(columns, names=["qid", "chunk_id", "corpus_ord", "score"])

    return run


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, *measure: Callable) -> DataFrame:
    """The search behind V1 and V3: each task holds a block of queries, and sends k of its vectors a query."""
    kind = to_arrow_type(queries.schema["qid"].dataType)
    asked = stored(queries.select("qid", F.col("vec").cast("array<double>").alias("vec")), "queries")
    qid, chunk, order = queries.schema["qid"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString(), vectors.schema["corpus_ord"].dataType.simpleString()
    best = f"qid {qid}, chunk_id {chunk}, corpus_ord {order}, score double"
    found: DataFrame | None = None
    numbers = asked.agg(F.sum(F.size("vec") + 4 * k)).first()[0] or 0
    blocks = max(1, -(-8 * numbers // QUERY_BYTES))
    for at in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid", "vec"), F.lit(blocks)) == at).toPandas()
        matrix = np.stack(block["vec"].to_list()) if len(block) else np.zeros((0, 1))
        part = vectors.select("chunk_id", "corpus_ord", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_searched(matrix, block["qid"].to_numpy(), kind, k, *measure), best)
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """V1: (qid, rank, chunk_id, score). queries (qid, vec); vectors (chunk_id, corpus_ord, vec), both of unit length.

    Each task multiplies its vectors with a block of queries and keeps k per query; only those meet in the ranking.
    Blocks are of bounded size, and the driver holds one at a time. Ties go to the smaller corpus_ord.
    """
    return _nearest(queries, vectors, k)


def ranked(hits: DataFrame, k: int, *extra: str) -> DataFrame:
    """The k best hits of each question by score, then by place in the corpus."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "corpus_ord")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "corpus_ord", "score", *extra)


def _within_buckets(tables: int) -> tuple[Callable, Callable]:
    """Scores by distance for vectors that carry the numbers of their buckets at the end; none for those without a common one."""

    def scores_of(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float]:
        q, v = queries[:, :-tables], vectors[:, :-tables]
        qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
        scores = 1 - (qq[:, None] + vv - 2 * (q @ v.T)) / 2
        common = np.zeros(scores.shape, bool)
        for t in range(tables, 0, -1):
            _, number = np.unique(np.concatenate([queries[:, -t], vectors[:, -t]]), return_inverse=True)
            number = number.astype(np.min_scalar_type(len(number)))
            common |= number[: len(q), None] == number[len(q) :]
        scores[~common] = -np.inf
        return scores, 1e-12 * (qq.max() + vv.max())

    def scores_of_pairs(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        distance = np.sqrt(((queries[:, :-tables] - vectors[:, :-tables]) ** 2).sum(axis=1))
        return np.where(distance < 2.0, 1 - distance**2 / 2, -np.inf)

    return scores_of, scores_of_pairs


def vector_lsh(queries: DataFrame, vectors: DataFrame, k: int = 5, bucket: float = 1.0, tables: int = 12) -> DataFrame:
    """V3, opt-in: approximate neighbours from random projections of unit vectors, ranked exactly. Buckets of unit vectors
    hold a large share of the table, so pairs with a common one are never joined: tasks score them in place, as in V1."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=42)
    doubles = F.col("vec").cast("array<double>").alias("vec")
    left, right = (rows.select(*own, doubles).distinct().withColumn("v", array_to_vector("vec")) for rows, own in ((queries, ["qid"]), (vectors, ["chunk_id", "corpus_ord"])))
    model = lsh.fit(right.select("v").limit(1))  # it asks for the number of dimensions only
    numbered = lambda rows: model.transform(rows).withColumn("vec", F.concat("vec", F.transform("h", lambda b: vector_to_array(b)[0])))
    return _nearest(numbered(left), numbered(right), k, *_within_buckets(tables))


def lookup(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """V4: chunks by id; of repeated ids the last in the corpus."""
    last = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("corpus_ord")))).where("_r = 1").drop("_r")
    return ids.join(last, "chunk_id")
