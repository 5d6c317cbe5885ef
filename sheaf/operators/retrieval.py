"""Query transforms (Q1 to Q3) and retrieval: dense (R1), BM25 (R2, R3), reciprocal rank fusion."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sheaf.functions.text import TOKEN_NOISE, WHITE_SPACE, let, nfkc, strip, token_ngrams
from sheaf.sources.grouped import whole_groups
from sheaf.sources.scratch import stored

from .vectors import ranked, vector_topk

K1, B, EPSILON, RRF_K, CHILD_K = 1.5, 0.75, 0.25, 60, 20
EMPTY = "__empty__"
#: Bytes of query weights that a task holds at once.
MATRIX_BYTES = 64 << 20
#: Rows of a batch, and characters, whose terms a task counts at once; a number above all characters.
COUNT_ROWS, COUNT_CHARS, NO_CHARACTER = 512, 1 << 19, 0x1FFFFF
#: 2 for white space, 1 for a character of noise, 0 for others; those beyond the table are others.
KINDS = np.array([2 if chr(c) in WHITE_SPACE else 1 if re.match(TOKEN_NOISE, chr(c)) else 0 for c in range(0x10000)] + [0], np.int8)


def identity(text: Column) -> Column:
    """Q1."""
    return F.array(text)


def normalized_query(text: Column, unicode: bool = True) -> Column:
    """Q2: single spaces, trimmed."""
    return F.array(F.regexp_replace(strip(nfkc(text) if unicode else text), r"(?U)\s+", " "))


def synonym_queries(text: Column, synonyms: Mapping[str, Sequence[str]], max_queries: int = 4, unicode: bool = True) -> Column:
    """Q3: the text, then with each contained term replaced by each alternative; at most max_queries, 2 at least."""
    base = nfkc(text) if unicode else text
    pairs = [F.struct(F.lit(t).alias("t"), F.lit(a).alias("a")) for t, alternatives in synonyms.items() for a in alternatives]
    if not pairs:
        return F.array(base)
    made = lambda b: F.transform(F.filter(F.array(*pairs), lambda p: F.contains(b, p["t"])), lambda p: F.replace(b, p["t"], p["a"]))
    return let(base, lambda b: F.slice(F.array_distinct(F.concat(F.array(b), made(b))), 1, max(max_queries, 2)))


def queries_of(questions: DataFrame, transformed: Column) -> DataFrame:
    """(qid, q_ord, text) from (qid, question)."""
    return questions.select("qid", F.posexplode(transformed).alias("q_ord", "text"))


def dense(queries: DataFrame, vectors: DataFrame, k: int = 5, search: Callable[..., DataFrame] = vector_topk) -> DataFrame:
    """Queries (qid, q_ord, vec). Several queries of a question fetch more each and merge by maximum. `search` is the
    indexer's way to find the nearest vectors."""
    several = queries.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    fetch = min(2 * k, k + 10) if several else k
    numbered = queries.select(F.struct("qid", "q_ord").alias("key"), F.to_json(F.struct("qid", "q_ord")).alias("qid"), "vec")
    hits = search(numbered.select("qid", "vec"), vectors, fetch).join(numbered.select(F.col("qid"), "key"), "qid")
    merged = hits.groupBy(F.col("key.qid").alias("qid"), "chunk_id", "corpus_ord").agg(F.max("score").alias("score"))
    return ranked(merged, k).withColumn("provenance", F.create_map(F.lit("dense"), "score"))


def postings(chunks: DataFrame, n: int = 2, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, corpus_ord, term, tf, dl) and (term, df_, idf). Texts are dealt by chunk before they are cut, so the
    far larger table of their terms is counted and grouped by chunk where it arises."""
    tokens = let(token_ngrams(F.coalesce("text", F.lit("")), n, unicode), lambda t: F.when(F.size(t) == 0, F.array(F.lit(EMPTY))).otherwise(t))
    filled = chunks.select("chunk_id", "corpus_ord", "text").repartition("chunk_id").select("chunk_id", "corpus_ord", tokens.alias("tokens"))
    counted = filled.select("chunk_id", "corpus_ord", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    tf = counted.groupBy("chunk_id", "corpus_ord", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = filled.agg(F.count(F.lit(1)).alias("n_docs"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df_")).crossJoin(F.broadcast(n_docs))
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df_") + F.lit(0.5)) - F.log(F.col("df_") + F.lit(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df_", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return tf, idf


def bm25_scores(queries: DataFrame, tf: DataFrame, idf: DataFrame, n: int = 2, k1: float = K1, b: float = B, unicode: bool = True) -> DataFrame:
    """(qid, q_ord, chunk_id, corpus_ord, score) of chunks that share a term; a repeated query term counts again."""
    asked = queries.select("qid", "q_ord", F.explode(token_ngrams(F.coalesce("text", F.lit("")), n, unicode)).alias("term")).groupBy("qid", "q_ord", "term").agg(F.count(F.lit(1)).alias("qtf"))
    length = tf.select("chunk_id", "dl").distinct().agg(F.avg("dl").alias("avgdl"))
    weight = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    met = tf.join(asked.join(idf, "term"), "term").crossJoin(F.broadcast(length))
    return met.groupBy("qid", "q_ord", "chunk_id", "corpus_ord").agg(F.sum(weight).alias("score"))


def _bigrams(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """T1 with n = 2 for lower-case texts: the distinct terms, packed, how often and in how many groups they occur."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    group = np.repeat(groups, [len(t) + 1 for t in texts])
    kind = KINDS[np.minimum(points, len(KINDS) - 1)]
    first = np.concatenate([[True], kind[:-1] == 2])[kind != 2]
    points, group, kind = points[kind != 2], group[kind != 2], kind[kind != 2]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(points)))
    real = np.repeat(np.minimum.reduceat(kind, starts) == 0, sizes) if len(starts) else np.zeros(0, bool)  # more than noise
    pair = np.flatnonzero(real[:-1] & ~first[1:]) if len(points) else starts
    lone = starts[(sizes == 1) & real[starts]]
    at, second = np.concatenate([pair, lone]), np.concatenate([points[pair + 1], np.full(len(lone), NO_CHARACTER)])
    keys = np.sort(group[at] << 42 | points[at] << 21 | second)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    terms, number = np.unique(keys[new] & ((1 << 42) - 1), return_inverse=True)
    times = np.diff(np.append(new, len(keys)))
    return terms, np.bincount(number, times, len(terms)).astype(np.int64), np.bincount(number, minlength=len(terms))


def bigram_counts(docs: DataFrame, id_column: str, unicode: bool = True) -> DataFrame:
    """(term, n, df_): how often each bigram (T1) occurs and in how many documents. Terms are counted where they are cut;
    a row leaves a task for each distinct one among some texts, never one for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every, starts in whole_groups(batches, [id_column], 256):
            sizes = pc.utf8_length(every.column("_t")).to_numpy(zero_copy_only=False)
            bounds, held = [0], 0
            for low, size in zip(starts.tolist(), np.add.reduceat(sizes, starts).tolist(), strict=True):
                if held and held + size > COUNT_CHARS:
                    bounds, held = [*bounds, low], 0
                held += size
            for low, high in zip(bounds, [*bounds[1:], every.num_rows], strict=True):
                number = np.searchsorted(starts, np.arange(low, high), side="right")
                terms, n, df = _bigrams(every.column("_t")[low:high].to_pylist(), number - number[0])
                names = [chr(t >> 21) + ("" if t & NO_CHARACTER == NO_CHARACTER else chr(t & NO_CHARACTER)) for t in terms.tolist()]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(n), pa.array(df)], names=["term", "n", "df_"])

    text = F.coalesce("text", F.lit(""))
    lowered = docs.select(id_column, F.lower(nfkc(text) if unicode else text).alias("_t")).repartition(id_column).sortWithinPartitions(id_column)
    return lowered.mapInArrow(run, "term string, n long, df_ long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df_").alias("df_"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each row with their counts, in order of the terms; a few rows of a batch at a time."""
    for every in batches:
        for low in range(0, every.num_rows, COUNT_ROWS):
            batch = every.slice(low, COUNT_ROWS)
            terms = batch.column("terms")
            flat, bounds = terms.values.to_numpy(zero_copy_only=False), terms.offsets.to_numpy()
            flat, bounds = flat[bounds[0] : bounds[-1]], bounds - bounds[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])) if len(flat) else np.zeros(0, int)
            counts = np.diff(np.append(first, len(flat))).astype(np.int32)
            ends = pa.array(np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat[first], counts)]
            yield pa.record_batch([batch.column("chunk_id"), batch.column("corpus_ord"), pa.array(np.diff(bounds).astype(np.int32)), *columns], names=["chunk_id", "corpus_ord", "dl", "terms", "tfs"])


def indexed(chunks: DataFrame, n: int = 2, unicode: bool = True) -> DataFrame:
    """(chunk_id, corpus_ord, dl, terms, tfs): the postings of each chunk in one row, written once. A term is the 64-bit
    hash of its n-gram; they are counted where they are cut, so that no table of terms is shuffled."""
    tokens = let(token_ngrams(F.coalesce("text", F.lit("")), n, unicode), lambda t: F.when(F.size(t) == 0, F.array(F.lit(EMPTY))).otherwise(t))
    hashed = chunks.repartition("chunk_id").select("chunk_id", "corpus_ord", F.transform(tokens, lambda t: F.xxhash64(t)).alias("terms"))
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "corpus_ord")}
    return stored(hashed.mapInArrow(_counted, f"chunk_id {kinds['chunk_id']}, corpus_ord {kinds['corpus_ord']}, dl int, terms array<long>, tfs array<int>"), "postings")


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 5, n: int = 2, k1: float = K1, b: float = B, unicode: bool = True, index: DataFrame | None = None) -> DataFrame:
    """R2: the k best chunks of each question that has a token; chunks without a common term score 0 and so fill up in
    corpus order. The postings are written once (or given, as `indexed` returns them). The query side becomes matrices of
    term weights, a block of questions of bounded size each; every chunk is scored against a block at a time, and only k
    chunks a question leave a batch."""
    index = indexed(chunks, n, unicode) if index is None else index
    n_docs, total = index.agg(F.count(F.lit(1)), F.sum("dl")).first()
    average = (total or 0) / max(n_docs, 1)
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_"))
    raw = stored(df.select("term", (F.log(F.lit(n_docs) - F.col("df_") + F.lit(0.5)) - F.log(F.col("df_") + F.lit(0.5))).alias("raw")), "frequencies")
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
    tokens = F.explode(token_ngrams(F.coalesce("text", F.lit("")), n, unicode))
    asked = queries.select("qid", "q_ord", tokens.alias("t")).groupBy("qid", "q_ord", F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("qtf"))
    idf = F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.coalesce("raw", F.lit(0.0)))
    entries = stored(asked.join(raw, "term", "left").select("qid", "q_ord", "term", (F.col("qtf") * idf * (k1 + 1)).alias("w")), "questions")
    n_terms, n_columns = entries.agg(F.count_distinct("term"), F.count_distinct("qid", "q_ord")).first()
    blocks = max(1, -(-8 * n_terms * n_columns // MATRIX_BYTES))
    qid = queries.schema["qid"].dataType.simpleString()
    kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "corpus_ord")}
    found: DataFrame | None = None
    for at in range(blocks):
        block = entries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == at).toPandas().sort_values(["qid", "q_ord"], kind="stable")
        terms, number = np.unique(block["term"].to_numpy(np.int64), return_inverse=True)
        columns = block[["qid", "q_ord"]].drop_duplicates()
        place = block.groupby(["qid", "q_ord"], sort=False).ngroup().to_numpy()
        matrix = np.zeros((len(terms) + 1, len(columns)))  # the last row is for terms that no question has
        matrix[number, place] = block["w"].to_numpy()
        names = columns["qid"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, int)
        part = index.mapInArrow(_scored(terms, matrix, starts, names[starts], to_arrow_type(queries.schema["qid"].dataType), average, k, k1, b), f"qid {qid}, chunk_id {kinds['chunk_id']}, corpus_ord {kinds['corpus_ord']}, score double")
        found = part if found is None else found.unionByName(part)
    return stored(ranked(found, k), "hits").withColumn("provenance", F.create_map(F.lit("bm25"), "score"))


def _scored(terms: np.ndarray, matrix: np.ndarray, starts: np.ndarray, own: np.ndarray, kind: pa.DataType, average: float, k: int, k1: float, b: float):
    """The k best chunks of a batch for each question of a block; of several queries of a question the best counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for low in range(0, every.num_rows if len(own) else 0, COUNT_ROWS):
                batch = every.slice(low, COUNT_ROWS)
                sizes = np.diff(batch.column("terms").offsets.to_numpy())
                flat, counts = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(float)
                at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
                row = np.repeat(np.arange(batch.num_rows), sizes)
                known = np.flatnonzero(terms[at] == flat)
                norm = k1 * (1 - b + b * batch.column("dl").to_numpy().astype(float) / average)
                part = counts[known] / (counts[known] + norm[row[known]])
                weight = np.zeros((batch.num_rows, len(matrix)))
                weight[row[known], at[known]] = part
                best = np.maximum.reduceat(weight @ matrix, starts, axis=1).T
                order = batch.column("corpus_ord").to_numpy(zero_copy_only=False)
                top = np.stack([np.lexsort((order, -x))[:k] for x in best])
                q, chunk = np.repeat(np.arange(len(own)), top.shape[1]), top.ravel()
                place = pa.array(chunk)
                yield pa.record_batch([pa.array(own[q], kind), batch.column("chunk_id").take(place), batch.column("corpus_ord").take(place), pa.array(best[q, chunk])], names=["qid", "chunk_id", "corpus_ord", "score"])

    return run


def fuse(children: Sequence[tuple[str, DataFrame]], k: int = 5, weights: Sequence[float] | None = None, rrf_k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (name, hits). Partial scores are added in the children's order, ties go to the
    earlier child and its rank; children of the same name keep their provenance apart by a number."""
    weights = [1.0] * len(children) if weights is None else list(weights)
    if not children or len(weights) != len(children) or not rrf_k > 0:
        raise ValueError("fusion needs retrievers, as many weights, and a positive rrf_k")
    names = [name if [n for n, _ in children].count(name) == 1 else f"{name}_{i}" for i, (name, _) in enumerate(children)]
    parts = [hits.select("qid", "chunk_id", "corpus_ord", F.struct(F.lit(i).alias("child"), "rank", (F.lit(float(w)) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("part"), F.lit(name).alias("name"), "score").alias("h")) for i, (name, w, (_, hits)) in enumerate(zip(names, weights, children, strict=True))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("qid", "chunk_id", "corpus_ord").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    score = F.aggregate("hs", F.lit(0.0), lambda a, h: a + h["part"])
    entries = F.flatten(F.transform("hs", lambda h: F.array(F.struct(h["name"].alias("key"), h["score"].alias("value")), F.struct(F.concat(h["name"], F.lit("_rank")).alias("key"), h["rank"].cast("double").alias("value")))))
    scored = merged.select("qid", "chunk_id", "corpus_ord", score.alias("score"), F.get("hs", F.lit(0)).alias("first"), entries.alias("entries"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first.child", "first.rank")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    provenance = F.map_from_entries(F.concat("entries", F.array(F.struct(F.lit("rrf").alias("key"), F.col("score").alias("value")))))
    return out.select("qid", "rank", "chunk_id", "corpus_ord", "score", provenance.alias("provenance"))


def describe(kind: str, **options) -> dict:
    """What a run record says of its retriever."""
    return {"retriever": kind, "k1": K1, "b": B, "rrf_k": RRF_K, "child_top_k": CHILD_K} | options


def idf_of(df: int, n_docs: int) -> float:
    """R3 for one term, before the floor."""
    return math.log(n_docs - df + 0.5) - math.log(df + 0.5)
