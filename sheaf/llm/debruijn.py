"""Repeated word sequences by compaction of a token de Bruijn graph.

Edges are the windows of 35 words (k-mers), nodes their first and last 34 words. `repeats` first settles whole runs of
edges by their hash: a context or bin that occurs twice is a path of repeated edges as it stands. The edges that are
left are counted with partial aggregates; those that occur twice form the graph. At a node with one repeated edge in and
one out the two edges join into one path, by pointer doubling in Spark joins. Source coordinates then verify each span:
a document's windows count as one long repeat only where their places advance in step with their ranks in the path.

Defined cases: null text has no words; words are runs of other than space and \\x09-\\x0D, unchanged; a document of
fewer than 35 words keeps all; repeats within a document and copies of whole documents count, each of them is removed;
windows don't cross documents and are judged on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .repeats import Scheme, covered, union_of, window_table, word_symbols

SCHEME = Scheme(width=35, gram=8, bin=7, symbols=word_symbols, item=8)
#: Paths are compacted in pieces of up to 2 ** ROUNDS edges; longer ones come as several pieces with the same cover.
ROUNDS = 3


def compacted(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """From distinct repeated edges (edge, source, target) to (edge, path, rank): the piece of a nonbranching path that
    the edge belongs to, named by its first edge, and its place there."""
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("edge")).where("n = 1").select(F.col("source").alias("node"), "edge")
    into = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("before")).where("n = 1").select(F.col("target").alias("node"), "before")
    step = out.join(into, "node").where("edge <> before").select("edge", "before")
    at = stored(edges.select("edge").join(step, "edge", "left").select("edge", F.coalesce("before", "edge").alias("path"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("rank")), "paths")
    for _ in range(rounds):
        beyond = at.select(F.col("edge").alias("path"), F.col("path").alias("further"), F.col("rank").alias("more"))
        at = stored(at.join(beyond, "path").select("edge", F.col("further").alias("path"), (F.col("rank") + F.col("more")).alias("rank")), "paths")
    return at


def resolve(unclear: DataFrame) -> DataFrame:
    """(a, c, low, high) of the repeated spans among the ambiguous bins."""
    windows = stored(window_table(unclear, SCHEME), "windows")
    counted = windows.groupBy("a", "d", "edge").agg(F.sum("nu").alias("n"), F.min("source").alias("source"), F.min("target").alias("target")).where("n >= 2")
    twice = stored(counted, "edges")
    paths = compacted(twice.groupBy("edge").agg(F.min("source").alias("source"), F.min("target").alias("target")))
    placed = windows.select("a", "c", "d", "edge").join(twice.select("a", "d", "edge"), ["a", "d", "edge"], "left_semi").join(paths, "edge")
    # Copies of a coordinate (one window in two bins of one context) count once.
    runs = placed.groupBy("a", "c", "path", (F.col("d") - F.col("rank")).alias("line")).agg(F.min("d").alias("low"), F.max("d").alias("last"), F.collect_set("d").alias("ds"))
    whole = F.size("ds") == F.col("last") - F.col("low") + 1
    span = F.struct(F.col("low"), (F.col("last") + SCHEME.width).cast("int").alias("high"))
    single = F.transform("ds", lambda d: F.struct(d.alias("low"), (d + SCHEME.width).cast("int").alias("high")))
    return runs.select("a", "c", F.explode(F.when(whole, F.array(span)).otherwise(single)).alias("s")).select("a", "c", "s.low", "s.high")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            kept, done, removed = [], 0, 0
            for s, e in union_of(marks, len(words)):
                kept += words[done:s]
                done, removed = e, removed + e - s
            kept += words[done:]
            out.append((len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, digest = zip(*out, strict=True) if out else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their key, and the marked stretches, in words, by key."""
    return covered(docs, SCHEME, resolve)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, spans = repeated_spans(docs)
    return rows.join(spans, "rk", "left").select("doc_id", "text", "marks").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
