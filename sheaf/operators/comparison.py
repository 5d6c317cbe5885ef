"""Sampling for review (L1, L2), agreement with reviewers (L3, L4), and comparing runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import answer_key, pick_quote

from .evaluation import SEED, intervals, significant

#: What an automatic outcome means as a verdict, and the words of a comparison.
VERDICTS = {"correct": "correct", "incorrect": "incorrect", "correct_abstention": "valid_abstention", "unjustified_abstention": "invalid_abstention"}
LOWER_IS_BETTER, NEUTRAL = ("error_rate", "latency_ms"), ("abstention_rate",)
BETTER, WORSE, MORE, LESS, SAME, BASE = "改善", "悪化", "増加", "減少", "有意差なし", "基準"


def stratified_sample(rows: DataFrame, stratum: Column, n: int, key: Column, seed: int | str = SEED) -> DataFrame:
    """L1: round robin over sorted strata, in a seeded order inside each: rank within the stratum, then stratum."""
    if n <= 0:
        return rows.limit(0)
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    placed = rows.withColumn("stratum", F.coalesce(stratum, F.lit("unknown"))).withColumn("_m", mixed)
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy("_m", key))
    return placed.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "stratum").limit(n).drop("_m")


def draft_candidates(chunks: DataFrame, n: int, seed: int | str = SEED) -> DataFrame:
    """L2: chunks spread over top sections (or ten pages each), numbered, with a quote; those without one are skipped
    and keep their number."""
    section = F.when(F.coalesce("section_path", F.lit("")) != "", F.get(F.split("section_path", " > "), F.lit(0)))
    decade = F.when(F.col("page").isNotNull(), F.concat(F.lit("p"), F.lpad(F.floor(F.col("page") / 10).cast("string"), 2, "0"), F.lit("x")))
    sample = stratified_sample(chunks, F.coalesce(section, decade), n, F.col("chunk_id"), seed)
    numbered = sample.withColumn("number", F.row_number().over(Window.orderBy("turn", "stratum")))  # n rows at most
    return numbered.withColumn("quote", pick_quote(F.col("text"))).where("quote is not null").select("number", "stratum", "chunk_id", "page", "section_path", "quote")


def verdict_of(outcome: Column) -> Column:
    out = F.lit("incorrect")
    for name, verdict in VERDICTS.items():
        out = F.when(outcome == name, verdict).otherwise(out)
    return out


def last_judgments(judgments: DataFrame, order: str = "reviewed_at") -> DataFrame:
    """The last record of each question and answer."""
    keyed = judgments.withColumn("key", answer_key(F.col("qid"), F.col("answer")))
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(order), F.desc("verdict")))).where("_r = 1").drop("_r")


def reviewed(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """L3: predictions with a human verdict on the same answer: (qid, question_type, auto, human, agrees)."""
    keyed = predictions.withColumn("key", answer_key(F.col("qid"), F.col("answer")))
    human = last_judgments(judgments).select("key", F.col("verdict").alias("human"))
    return keyed.join(human, "key").select("qid", "question_type", verdict_of(F.col("outcome")).alias("auto"), "human").withColumn("agrees", F.col("auto") == F.col("human"))


def agreement(rows: DataFrame) -> DataFrame:
    """L3: rate per question type and overall (null type)."""
    return rows.groupingSets([["question_type"], []], "question_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("agrees").cast("int")), 4).alias("rate"))


def retrieval_note(predictions: DataFrame) -> DataFrame:
    """L4: rank of the first gold chunk among the hits, and whether one reached the prompt. retrieved holds ids."""
    place = F.array_min(F.filter(F.transform("gold_chunk_ids", lambda g: F.array_position("retrieved", g)), lambda p: p > 0))
    return predictions.select("qid", place.alias("first_gold_rank"), F.coalesce(F.arrays_overlap("gold_chunk_ids", "context_chunk_ids"), F.lit(False)).alias("in_prompt"))


def shared_questions(runs: DataFrame) -> DataFrame:
    """Questions that all runs have; runs: (run, qid, ...)."""
    n = runs.agg(F.count_distinct("run").alias("n_runs"))
    return runs.groupBy("qid").agg(F.count_distinct("run").alias("n")).crossJoin(F.broadcast(n)).where("n = n_runs").select("qid")


def metric_rows(predictions: DataFrame) -> DataFrame:
    """(run, qid, metric, value): outcomes as 0/1 series, char_f1, latency and the retrieval map's entries."""
    out = F.col("outcome")
    flag = lambda c: c.cast("int").cast("double")
    base = F.create_map(
        F.lit("accuracy"), flag(out.isin("correct", "correct_abstention")), F.lit("error_rate"), flag(out == "incorrect"),
        F.lit("abstention_rate"), flag(out.like("%abstention")), F.lit("char_f1"), F.col("char_f1"), F.lit("latency_ms"), F.col("latency_ms"),
    )
    every = F.map_concat(base, F.coalesce("retrieval", F.create_map().cast("map<string,double>"))) if "retrieval" in predictions.columns else base
    return predictions.select("run", "qid", F.explode(every).alias("metric", "value"))


def polarity(metric: Column, difference: Column, is_significant: Column, is_base: Column) -> Column:
    """L7."""
    up = difference > 0
    good = F.when(metric.isin(*LOWER_IS_BETTER), ~up).otherwise(up)
    word = F.when(metric.isin(*NEUTRAL), F.when(up, MORE).otherwise(LESS)).otherwise(F.when(good, BETTER).otherwise(WORSE))
    return F.when(is_base, BASE).when(~is_significant, SAME).otherwise(word)


def compare(predictions: DataFrame, baseline: str) -> DataFrame:
    """Per run and metric the interval and the paired difference to the baseline."""
    rows = metric_rows(predictions.join(shared_questions(predictions), "qid", "left_semi"))
    own = intervals(rows, ["run", "metric"])
    base = rows.where(F.col("run") == baseline).select("metric", "qid", F.col("value").alias("_base"))
    paired = rows.join(base, ["metric", "qid"]).withColumn("value", F.col("value") - F.col("_base")).where("value is not null")
    differences = intervals(paired, ["run", "metric"], proportion=False).select("run", "metric", F.col("point").alias("diff"), F.col("low").alias("diff_low"), F.col("high").alias("diff_high"))
    out = own.join(differences, ["run", "metric"], "left").withColumn("significant", significant(F.col("diff_low"), F.col("diff_high")))
    return out.withColumn("verdict", polarity(F.col("metric"), F.col("diff"), F.col("significant"), F.col("run") == baseline))
