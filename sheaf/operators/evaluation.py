"""Judging answers (J1 to J7), ranking metrics (N1 to N6), statistics and cost (A1 to A7). NULL means not measurable."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import scoring, text
from sheaf.sources.grouped import changes

#: Fixed values.
KS = (1, 3, 5, 10)
THRESHOLD, PHRASE_LENGTH = 0.6, 10
Z = {0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}
SEED, RESAMPLES = 20260731, 2000
#: Random numbers that a task draws at once.
DRAWS = 1 << 18
OUTCOMES = ("correct", "incorrect", "correct_abstention", "unjustified_abstention")


def judge(gold: DataFrame, answers: DataFrame, unicode: bool = True) -> DataFrame:
    """Gold (qid, answer, answer_aliases, answer_type, answerable) with answers (qid, text, abstained); a
    question without an answer is judged as an empty one."""
    a = answers.select("qid", F.col("text").alias("said"), "abstained")
    rows = gold.join(a, "qid", "left").withColumns({"said": F.coalesce("said", F.lit("")), "abstained": F.coalesce("abstained", F.lit(False))})
    rows = rows.withColumn("p", text.normalize_answer(F.col("said"), unicode)).withColumn("accepted", scoring.accepted_answers(F.col("answer"), F.col("answer_aliases"), unicode))
    items = lambda xs: F.split(text.normalize_answer(F.array_join(xs, "\u0001"), unicode), "\u0001")
    wanted = text.answer_items(F.coalesce("answer", F.lit("")), F.col("answer_type"))
    rows = rows.withColumns({"_said": items(text.split_items(F.col("said"))), "_wanted": items(wanted), "_size": F.length(text.normalize_answer(F.coalesce("answer", F.lit("")), unicode))})
    rows = rows.withColumns({
        "exact_match": scoring.exact_match(F.col("p"), F.col("accepted")), "contains": scoring.contains_answer(F.col("p"), F.col("accepted")),
        "char_f1": scoring.best_char_f1(F.col("p"), F.col("accepted")),
        "set_f1": F.when(F.col("answer_type") == "list", scoring.set_f1(F.col("_said"), F.col("_wanted"))),
    })
    pairs = rows.select("qid", "p", F.explode_outer("accepted").alias("a"))
    best = pairs.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("a").isNotNull(), scoring.windowed_char_f1("p", "a"))), F.lit(0.0)).alias("windowed"))
    rows = rows.join(best, "qid")
    near = F.col("windowed") >= THRESHOLD
    numeric = F.exists("accepted", lambda x: scoring.numeric_match(F.col("p"), x))
    long_answer = F.col("_size") >= PHRASE_LENGTH
    right = (
        F.when(F.col("answer_type") == "list", F.coalesce("set_f1", F.lit(0.0)) >= THRESHOLD).when(F.col("answer_type") == "long", F.col("contains") | near)
        .when(F.col("answer_type") == "numeric", F.col("exact_match") | numeric).otherwise(F.col("exact_match") | F.col("contains") | (long_answer & near))
    )
    outcome = F.when(~F.col("answerable"), F.when(F.col("abstained"), "correct_abstention").otherwise("incorrect")).when(F.col("abstained"), "unjustified_abstention").otherwise(F.when(right, "correct").otherwise("incorrect"))
    review = F.col("answerable") & ~F.col("abstained") & (F.col("answer_type") == "long")
    return rows.select("qid", outcome.alias("outcome"), "exact_match", "contains", "char_f1", "set_f1", "windowed", "abstained", review.alias("needs_human_review"))


def judge_citations(rows: DataFrame) -> DataFrame:
    """Rows with citations, context_chunk_ids, gold_chunk_ids."""
    cited = F.size("citations")
    exist = (cited > 0) & (F.size(F.array_except("citations", "context_chunk_ids")) == 0)
    return rows.withColumns({"cited": cited > 0, "all_exist": exist, "supported": F.coalesce(F.arrays_overlap("citations", "gold_chunk_ids"), F.lit(False)), "n_cited": cited, "n_supported": F.size(F.array_intersect("citations", "gold_chunk_ids")), "n_hallucinated": F.size(F.filter("citations", lambda c: ~F.array_contains("context_chunk_ids", c)))})


def item_results(gold: DataFrame, answers: DataFrame, matches: DataFrame, hits: DataFrame, contexts: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row for each gold question: judgment (J1), citations (J2), ranking and context metrics.

    answers (qid, text, abstained, citations), matches (qid, ev_ord, chunk_ids), hits (qid, rank, chunk_id), contexts
    (qid, pos, chunk_id). A question without an answer is wrong, not an abstention; one without gold chunks has no
    ranking or context metrics. Each table is grouped by question once, so the joins share one partitioning.
    """
    none = F.array().cast(contexts.select(F.array("chunk_id")).schema[0].dataType.simpleString())
    ids = matches.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("chunk_ids"))).alias("gold_chunk_ids"))
    shown = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("_c")).select("qid", F.col("_c.chunk_id").alias("context_chunk_ids"))
    rows = judge(gold, answers).join(answers.select("qid", "citations"), "qid", "left").join(ids, "qid", "left").join(shown, "qid", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("citations", "gold_chunk_ids", "context_chunk_ids")})
    return context_metrics(judge_citations(rows)).join(ranking_metrics(hits, matches, ks), "qid", "left")


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def outcome_rates(judged: DataFrame, *by: str, unanswerable: int | None = None) -> DataFrame:
    """Counts of the outcomes and the rates; abstention recall takes its denominator from outside if given."""
    counts = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    right, abstained = F.col("correct") + F.col("correct_abstention"), F.col("correct_abstention") + F.col("unjustified_abstention")
    rows = counts.withColumns({"accuracy": rate(right, F.col("n")), "error_rate": rate(F.col("incorrect"), F.col("n")), "abstention_rate": rate(abstained, F.col("n")), "abstention_precision": rate(F.col("correct_abstention"), abstained)})
    return rows if unanswerable is None else rows.withColumn("abstention_recall", rate(F.col("correct_abstention"), F.lit(unanswerable)))


def stratified(rows: DataFrame) -> DataFrame:
    """Per question type and per answer type, and in total, in one pass of grouping sets. rows: outcome, char_f1,
    question_type, answer_type and the hit_* columns."""
    hits = [c for c in rows.columns if c.startswith("hit_")]
    right = F.col("outcome").isin("correct", "correct_abstention").cast("int")
    hit = F.avg(sum((F.col(h) for h in hits), F.lit(0.0)) / len(hits)) if hits else F.lit(None).cast("double")
    aggregates = [F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 4).alias("accuracy"), F.round(F.avg((F.col("outcome") == "incorrect").cast("int")), 4).alias("error_rate"), F.round(F.avg(F.col("outcome").like("%abstention").cast("int")), 4).alias("abstention_rate"), F.round(F.avg("char_f1"), 4).alias("char_f1"), F.round(hit, 4).alias("hit_mean")]
    return rows.groupingSets([["question_type"], ["answer_type"], []], "question_type", "answer_type").agg(*aggregates)


def ranking_metrics(hits: DataFrame, matches: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """N1 to N4 per question of `matches` with gold: hits (qid, rank, chunk_id), matches (qid, ev_ord, chunk_ids)."""
    gold = matches.where(F.size("chunk_ids") > 0).select("qid", "ev_ord", F.explode("chunk_ids").alias("chunk_id"))
    found = gold.join(hits.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left")
    per_evidence = found.groupBy("qid", "ev_ord").agg(F.min("rank").alias("first"))
    metrics = [F.count(F.lit(1)).alias("n_evidence"), F.coalesce(1 / F.min("first"), F.lit(0.0)).alias("reciprocal_rank")]
    for k in ks:
        metrics += [F.coalesce(F.max((F.col("first") <= k).cast("int")), F.lit(0)).cast("double").alias(f"hit_{k}"), F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}")]
    out = per_evidence.groupBy("qid").agg(*metrics)
    gains = found.where("rank is not null").select("qid", "chunk_id", "rank").distinct().groupBy("qid").agg(*[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in ks])
    out = out.join(gains, "qid", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("n_evidence"), F.lit(1))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return out.withColumns({f"ndcg_{k}": F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal(k) for k in ks}).drop(*[f"dcg_{k}" for k in ks])


def context_metrics(rows: DataFrame) -> DataFrame:
    """Rows with gold_chunk_ids and context_chunk_ids."""
    has = F.size("gold_chunk_ids") > 0
    hit = F.when(has, F.coalesce(F.arrays_overlap("gold_chunk_ids", "context_chunk_ids"), F.lit(False)).cast("double"))
    share = F.when(has, F.try_divide(F.size(F.filter("context_chunk_ids", lambda c: F.array_contains("gold_chunk_ids", c))), F.size("context_chunk_ids")))
    return rows.withColumns({"context_hit": hit, "context_precision": share})


def wilson(successes: Column, n: Column, level: float = 0.95) -> Column:
    """A2: struct of point, low, high, level; null without observations."""
    z = F.lit(Z.get(level, 1.96))
    p = successes / n
    middle, root = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    return F.when(n > 0, F.struct(p.alias("point"), F.greatest((middle - root) / below, F.lit(0.0)).alias("low"), F.least((middle + root) / below, F.lit(1.0)).alias("high"), F.lit(level).alias("level")))


def _parts(series: np.ndarray) -> np.ndarray:
    """Each number as a sum of a real part, so short that any n of them add without rounding, and an imaginary rest."""
    if not np.isfinite(series).all():
        return series + 0j
    unit = int(np.frexp(np.abs(series).max())[1]) - 52 + len(series).bit_length()
    high = np.ldexp(np.rint(np.ldexp(series, -unit)), unit)
    return high + 1j * (series - high)


def _resampled(series: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of the series drawn with replacement at the places that `random.Random(seed).randrange(n)` gives in turn:
    the same generator, read DRAWS numbers at a time."""
    n, bits = len(series), len(series).bit_length()
    version, state, _ = random.Random(seed).getstate()
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    parts, sums, done = _parts(series), np.zeros(resamples, complex), 0
    while done < n * resamples:
        drawn = generator.random_raw(DRAWS) >> np.uint64(32 - bits)
        drawn = drawn[drawn < n][: n * resamples - done].astype(np.int64)
        first = done // n
        cuts = np.arange(first * n, done + len(drawn), n) - done
        cuts[0] = 0
        if len(drawn):
            sums[first : first + len(cuts)] += np.add.reduceat(parts[drawn], cuts)
        done += len(drawn)
    return (sums.real + sums.imag) / n


def bootstrap(values: Sequence[float], level: float = 0.95, resamples: int = RESAMPLES, seed: int = SEED, proportion: bool | None = None) -> tuple[float, float, float] | None:
    """A3 for one series in its order: seeded resampled means; 0/1 series take the closed form unless told otherwise.
    Memory is a few times the series, whatever the number of resamples."""
    series = np.asarray(values, float)
    n = len(series)
    if not n:
        return None
    total = _parts(series).sum()
    point = float(total.real + total.imag) / n
    if n == 1:
        return point, point, point
    if proportion or proportion is None and np.isin(series, (0.0, 1.0)).all():
        z2 = Z.get(level, 1.96) ** 2
        middle, spread = (point + z2 / (2 * n)) / (1 + z2 / n), (z2 * (point * (1 - point) + z2 / (4 * n)) / n) ** 0.5 / (1 + z2 / n)
        return point, max(0.0, middle - spread), min(1.0, middle + spread)
    means = np.sort(_resampled(series, resamples, seed))
    tail = (1 - level) / 2
    low, high = (means[min(int(q * resamples), resamples - 1)] for q in (tail, 1 - tail))
    return point, float(low), float(high)


def intervals(rows: DataFrame, by: list[str], order: str = "qid", value: str = "value", level: float = 0.95, proportion: bool | None = None) -> DataFrame:
    """A3, A4 per group of a long table. Groups come sorted, a batch at a time, so a task holds the numbers of one only."""
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, n long, point double, low double, high double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, kinds = None, [], None

        def closed() -> pa.RecordBatch:
            series = np.concatenate(held)
            point, low, high = bootstrap(series, level, proportion=proportion) or (None, None, None)
            columns = [*own.columns, pa.array([len(series)]), *(pa.array([x], pa.float64()) for x in (point, low, high))]
            return pa.record_batch(columns, names=[*by, "n", "point", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = [*changes(batch, by), batch.num_rows]
            values = batch.column("_v").to_numpy(zero_copy_only=False)
            for low, high in zip(starts[:-1], starts[1:], strict=True):
                key = batch.select(by).slice(low, 1)
                if own is None or not own.equals(key):
                    if own is not None:
                        yield closed()
                    own, held = key, []
                held.append(values[low:high][~np.isnan(values[low:high])])
        if own is not None:
            yield closed()

    own = rows.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))
    return own.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last("_o"), "_v").select(*by, "_v").mapInArrow(run, schema)


def paired_differences(a: DataFrame, b: DataFrame, by: list[str], **options) -> DataFrame:
    """A4: a - b over the questions that have both; always resampled."""
    both = a.select(*by, "qid", F.col("value").alias("x")).join(b.select(*by, "qid", F.col("value").alias("y")), [*by, "qid"])
    return intervals(both.where("x is not null and y is not null").withColumn("value", F.col("x") - F.col("y")), by, proportion=False, **options)


def significant(low: Column, high: Column) -> Column:
    """A5."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def nearest_rank(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """A6 for groups of any size: the value at place floor(q n), the last at most, by a ranking instead of a list."""
    own = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(own.orderBy(value)) - 1).alias("_i"), F.count(F.lit(1)).over(own).alias("_n"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1), F.col(value))).alias(name) for name, q in quantiles.items()])


def cost_summary(trace: DataFrame) -> DataFrame:
    """Per stage of a trace (qid, stage, duration_ms, rss_mb): p50, p95, peak memory."""
    return nearest_rank(trace, ["stage"], "duration_ms", {"p50": 0.5, "p95": 0.95}).join(trace.groupBy("stage").agg(F.max("rss_mb").alias("peak_rss_mb"), F.count(F.lit(1)).alias("n")), "stage")


def overall(rows: DataFrame) -> DataFrame:
    """One row of means over judged questions with their ranking and citation columns; nulls are left out."""
    right = F.col("outcome").isin("correct", "correct_abstention").cast("int")
    kept = [c for c in rows.columns if c.startswith(("hit_", "recall_", "ndcg_")) or c in ("reciprocal_rank", "context_hit", "context_precision", "char_f1", "set_f1")]
    cited = F.col("cited").cast("int")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), *[F.avg(c).alias(c) for c in kept], F.avg(cited).alias("cited_rate"), F.avg(F.when(F.col("cited"), F.col("all_exist").cast("int"))).alias("all_exist_rate"), F.avg(F.when(F.col("cited"), F.col("supported").cast("int"))).alias("supported_rate"))
    return out.withColumn("accuracy", wilson(F.col("n_right"), F.col("n")))
