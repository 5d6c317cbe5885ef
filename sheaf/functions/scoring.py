"""Answer scores (M1 to M7) on columns of normalised text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import let, normalize_answer


def accepted_answers(answer: Column, aliases: Column, unicode: bool = True) -> Column:
    """Normalised answer and aliases that are not blank as written."""
    given = F.filter(F.concat(F.array(answer), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: a.isNotNull() & a.rlike(r"(?U)\S"))
    joined = normalize_answer(F.array_join(given, "\u0001"), unicode)  # one pass of the normal form for all of them
    return F.when(F.size(given) == 0, F.array().cast("array<string>")).otherwise(F.split(joined, "\u0001"))


def exact_match(prediction: Column, accepted: Column) -> Column:
    """M1, on normalised text."""
    return (prediction != "") & F.exists(accepted, lambda a: a == prediction)


def contains_answer(prediction: Column, accepted: Column, compat: bool = False) -> Column:
    """M2; an alias of punctuation alone matches everything only in compat mode."""
    return F.exists(accepted, lambda a: F.contains(prediction, a) & (F.lit(compat) | (a != "")))


def char_counts(text: Column) -> Column:
    """A map from character to count."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(chars, lambda cs: F.map_from_arrays(F.array_distinct(cs), F.transform(F.array_distinct(cs), lambda c: F.size(cs) - F.size(F.array_remove(cs, c)))))


def char_f1(prediction: Column, reference: Column) -> Column:
    """M3: F1 of the character multisets; 1 if both are empty, 0 if one is."""
    shared = lambda p, r: F.aggregate(F.map_keys(p), F.lit(0), lambda a, k: a + F.least(F.element_at(p, k), F.coalesce(F.try_element_at(r, k), F.lit(0))))
    common = let(char_counts(prediction), lambda p: let(char_counts(reference), lambda r: shared(p, r)))
    total = F.length(prediction) + F.length(reference)
    return F.when(total == 0, F.lit(1.0)).when((F.length(prediction) == 0) | (F.length(reference) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * common / total)


def best_char_f1(prediction: Column, accepted: Column) -> Column:
    """M4."""
    return F.coalesce(F.array_max(F.transform(accepted, lambda a: char_f1(prediction, a))), F.lit(0.0))


def windowed(prediction: str, reference: str) -> float:
    """M5 for one pair: windows as long as the reference slide over a longer prediction."""
    if len(prediction) <= len(reference) or not reference:
        if not prediction and not reference:
            return 1.0
        common = sum((Counter(prediction) & Counter(reference)).values())
        return 2.0 * common / (len(prediction) + len(reference)) if prediction and reference else 0.0
    width, step = len(reference), max(1, len(reference) // 10)
    wanted, best = Counter(reference), 0
    have = Counter(prediction[:width])
    for start in range(0, len(prediction) - width + 1, step):
        if start:
            have.subtract(prediction[start - step : start])
            have.update(prediction[start + width - step : start + width])
        best = max(best, sum(min(n, have[c]) for c, n in wanted.items()))
    return best / width


@F.pandas_udf(DoubleType())
def windowed_char_f1(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """M5, on normalised text."""
    return pd.Series([windowed(p or "", r or "") for p, r in zip(prediction, reference, strict=True)], dtype=float)


def set_f1(predicted: Column, wanted: Column) -> Column:
    """M6: items are linked if either contains the other; arrays of normalised items, without Python UDFs in them."""
    linked = lambda x, ys: F.exists(ys, lambda y: F.contains(x, y) | F.contains(y, x))

    def score(p: Column, w: Column) -> Column:
        precision = F.try_divide(F.size(F.filter(p, lambda x: linked(x, w))), F.size(p))
        recall = F.try_divide(F.size(F.filter(w, lambda x: linked(x, p))), F.size(w))
        both = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
        return F.when((F.size(p) == 0) & (F.size(w) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(w) == 0), F.lit(0.0)).otherwise(both)

    kept = lambda xs: F.filter(xs, lambda x: x != "")
    return let(kept(predicted), lambda p: let(kept(wanted), lambda w: score(p, w)))


def numeric_match(prediction: Column, wanted: Column) -> Column:
    """M7: every number of the wanted text is among the predicted ones; false without numbers."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"[0-9]+(\.[0-9]+)?"), 0)
    return (F.size(numbers(wanted)) > 0) & (F.size(F.array_except(numbers(wanted), numbers(prediction))) == 0)
