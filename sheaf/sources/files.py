"""Sources and sinks: text files (S1), gold questions (S4), runs (S5 to S7, S10), judgments (S8), artifacts (S9), checks."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".md", ".markdown")
GOLD = (
    "qid STRING, question STRING, answer STRING, answer_aliases ARRAY<STRING>, answer_type STRING, "
    "evidence ARRAY<STRUCT<page: INT, quote: STRING, section_path: STRING>>, answerable BOOLEAN, question_type STRING, tags ARRAY<STRING>, notes STRING"
)
PREDICTION = (
    "qid STRING, answer STRING, outcome STRING, exact_match BOOLEAN, contains BOOLEAN, char_f1 DOUBLE, set_f1 DOUBLE, abstained BOOLEAN, citations ARRAY<STRING>, "
    "gold_chunk_ids ARRAY<STRING>, context_chunk_ids ARRAY<STRING>, retrieved ARRAY<STRUCT<chunk_id: STRING, score: DOUBLE>>, retrieval MAP<STRING, DOUBLE>, latency_ms DOUBLE, question_type STRING, answer_type STRING"
)
JUDGMENT = "qid STRING, answer STRING, verdict STRING, comment STRING, reviewed_at STRING, run STRING"
VERDICTS = ("correct", "incorrect", "valid_abstention", "invalid_abstention")
QUESTION_TYPES = ("short", "numeric", "list", "long")


def read_texts(spark: SparkSession, path: str, recursive: bool = True, encoding: str = "utf-8") -> DataFrame:
    """(doc_id, text, source, n_chars, corpus_path). A folder gives its text files, a single file is read whatever
    its suffix; file stems that occur twice are an error, as ids would collide."""
    single = os.path.isfile(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select(F.col("path").alias("source"), F.decode("content", encoding).alias("text"))
    if not single:
        suffix = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
        files = files.where(suffix.isin(*TEXT_SUFFIXES))
    docs = files.select(F.regexp_extract("source", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "text", "source", F.length("text").alias("n_chars"))
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    if not facts["n"]:
        raise ValueError(f"{path} holds no text files")
    if facts["most"] > 1:
        raise ValueError(f"{path} holds files of equal stem: {[r[0] for r in counted.where('n > 1').limit(5).collect()]}")
    return docs


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without blank and comment lines, validated; the first fault raises with its cause."""
    # filters may move past the parser, so what isn't a record is null to it
    record = F.when(F.col("value").rlike(r"(?U)\S") & ~F.trim("value").startswith("#"), F.col("value"))
    parsed = spark.read.text(path).select(F.from_json(record, GOLD, {"mode": "FAILFAST"}).alias("g"))
    gold = parsed.where("g is not null").select("g.*")
    gold = gold.withColumns({"answer_aliases": F.coalesce("answer_aliases", F.array().cast("array<string>")), "answerable": F.coalesce("answerable", F.lit(True)), "evidence": F.coalesce("evidence", F.array().cast("array<struct<page: int, quote: string, section_path: string>>")), "answer_type": F.coalesce("answer_type", F.lit("short"))})
    empty = F.exists("evidence", lambda e: e["page"].isNull() & (F.coalesce(e["quote"], F.lit("")) == "") & (F.coalesce(e["section_path"], F.lit("")) == ""))
    fault = F.when(F.col("qid").isNull() | (F.col("qid") == ""), "no qid").when(~F.col("answer_type").isin(*QUESTION_TYPES), "unknown answer_type").when(empty, "evidence without page, quote and section").when(F.col("answerable") & (F.coalesce("answer", F.lit("")) == ""), "answerable without answer")
    bad = gold.withColumn("fault", fault).where("fault is not null").select("qid", "fault").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['qid']}: {r['fault']}" for r in bad))
    twice = gold.groupBy("qid").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"qid occurs twice: {[r['qid'] for r in twice]}")
    return gold


def read_predictions(spark: SparkSession, run: str) -> DataFrame:
    """The predictions of a run; of a repeated qid the last line."""
    lines = spark.read.schema(PREDICTION).json(f"{run}/predictions.jsonl").withColumn("_line", F.monotonically_increasing_id())
    last = lines.groupBy("qid").agg(F.max_by(F.struct(*[c for c in lines.columns if c not in ("qid", "_line")]), "_line").alias("p"))
    return last.select("qid", "p.*")


def find_runs(root: str) -> list[str]:
    """Folders of finished runs, newest name first."""
    return sorted((str(p.parent) for p in Path(root).glob("*/metrics.json")), key=lambda p: Path(p).name, reverse=True)


def resolve_run(root: str, ref: str) -> str:
    """A path, or the only run whose name starts with ref."""
    if os.path.isdir(ref):
        return ref
    found = [r for r in find_runs(root) if Path(r).name.startswith(ref)]
    if len(found) != 1:
        raise ValueError(f"{ref!r} names {len(found)} runs under {root}")
    return found[0]


def write_run(root: str, name: str, config: dict, predictions: DataFrame, metrics: dict, environment: dict) -> str:
    """One folder a run; the stamp carries a random part, so that runs of one second don't share it."""
    digest = hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "name"}, sort_keys=True).encode()).hexdigest()[:12]
    folder = f"{root}/{time.strftime('%Y%m%d-%H%M%S')}-{name}-{digest}-{uuid.uuid4().hex[:6]}"
    predictions.write.json(f"{folder}/predictions.jsonl")
    for file, value in (("config.resolved.json", config), ("env.json", environment), ("metrics.json", metrics)):
        Path(folder, file).write_text(json.dumps(value, ensure_ascii=False, indent=1, default=str))
    return folder


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """The records as appended; `comparison.last_judgments` keeps the last of each."""
    return spark.read.schema(JUDGMENT).json(path)


def append_judgments(rows: DataFrame, path: str) -> None:
    wrong = rows.where(~F.col("verdict").isin(*VERDICTS)).limit(1).count()
    if wrong:
        raise ValueError(f"verdicts are {VERDICTS}")
    rows.write.mode("append").json(path)


def save_artifact(folder: str, tables: dict[str, DataFrame], signature: str) -> None:
    """One Parquet table each, the manifest last: a folder without it is not an artifact."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    if "chunks" in counts and "vectors" in counts and counts["chunks"] != counts["vectors"]:
        raise ValueError(f"{counts['chunks']} chunks and {counts['vectors']} vectors")
    Path(folder, "manifest.json").write_text(json.dumps({"signature": signature, "tables": counts}))


def load_artifact(spark: SparkSession, folder: str, signature: str) -> dict[str, DataFrame] | None:
    """The tables, or None where no finished artifact of this signature lies."""
    manifest = Path(folder, "manifest.json")
    if not manifest.exists() or (found := json.loads(manifest.read_text()))["signature"] != signature:
        return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in found["tables"]}


def corpus_signature(spark: SparkSession, path: str) -> str:
    """Digest over the relative paths and contents of a file or folder, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("digest"))
    total = hashlib.sha256()
    for r in files.orderBy("path").toLocalIterator():  # names and digests only
        total.update(f"{r['path'].rpartition(path.rstrip('/'))[2]}\t{r['digest']}\n".encode())
    return total.hexdigest()


def verify_files(spark: SparkSession, path: str, lock: dict[str, str]) -> DataFrame:
    """Files of a lock (name to SHA-256) that are missing or differ."""
    wanted = spark.createDataFrame(list(lock.items()), "name string, sha256 string")
    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return wanted.join(have, "name", "left").where("found is null or found <> sha256").select("name", F.when(F.col("found").isNull(), "missing").otherwise("differs").alias("fault"))
