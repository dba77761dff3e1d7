"""Quality rules whose cutoffs are certified on labelled documents to reject few good ones."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, words

# Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS, WINDOW = 50, 50, "#*$%&|<>", 3

#: The share of good documents of a stratum that all rules together may reject, and the chance that a promise fails.
FALSE_REJECTION, FAILURE = 0.02, 0.05
#: Strata by number of words: a document belongs to the last bound that it reaches.
STRATA = (0, 200, 500, 1500)
#: The rules: a metric and its cutoffs from the strictest; a document above the cutoff is rejected.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0),
    "mean_word_chars": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "dup_line_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
}


def base_metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every whole text.

    Windows of three words become 64-bit hashes whose low bits, as many as positions need, are replaced by
    the position; after one sort of primitive longs equal windows stand side by side. Where hashes meet the words are compared, with
    those of the neighbour and, if these differ, of all windows of that hash. No rows are exploded or shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"), words(F.col(text)).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "_words",
        F.size("_words").alias("_n"),
        lines.alias("_lines"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    rows = rows.select("*", F.expr("shiftleft(1L, cast(ceil(log2(_n + 2)) as int)) - 1").alias("_low"))
    key = F.transform(
        "_words",
        lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))
        .bitwiseAND(F.bitwise_not("_low"))
        .bitwiseOR(i.cast("long")),
    )
    rows = rows.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_low",
        "_words",
        F.sort_array(F.slice(key, F.lit(1), F.greatest(F.lit(0), F.col("_n") - WINDOW + 1))).alias("_keys"),
    )

    def meets(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b).bitwiseAND(F.bitwise_not("_low")) == 0

    def equal(a: Column, b: Column) -> Column:
        word = lambda x, d: F.get(F.col("_words"), (x.bitwiseAND(F.col("_low")) + d).cast("int"))
        return reduce(Column.__and__, (word(a, d) == word(b, d) for d in range(WINDOW)))

    def repeated(x: Column, i: Column) -> Column:
        after, before = F.get(F.col("_keys"), i + 1), F.when(i > 0, F.get(F.col("_keys"), i - 1))
        beside = [F.coalesce(meets(x, y), F.lit(False)) for y in (after, before)]
        found = (beside[0] & equal(x, after)) | (beside[1] & equal(x, before))
        return found | ((beside[0] | beside[1]) & F.exists("_keys", lambda y: (y != x) & meets(x, y) & equal(x, y)))

    twice = F.filter("_keys", repeated)
    rows = rows.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("_low")))))
    steps = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(WINDOW).cast("long"))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("_low", "_words", "_keys", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metric(name: str) -> Column:
    total = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / total,
        "mean_word_chars": F.col("word_chars") / total,
        "repeat_share": F.col("n_repeat_words") / total,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }[name]


def stratum(n_words: Column, strata: tuple[int, ...] = STRATA) -> Column:
    out = F.lit(0)
    for i, bound in enumerate(strata):
        out = F.when(n_words >= bound, F.lit(i)).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly up to rounding: terms from k downwards until they no longer count."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 0.5  # the median is at most one above n * p, so more than the bounds in use
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term, total = math.exp(log), 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return total


def certified_cutoffs(
    metrics: DataFrame,
    labels: DataFrame,
    cutoffs: dict[str, tuple[float, ...]] | None = None,
    false_rejection: float = FALSE_REJECTION,
    failure: float = FAILURE,
    strata: tuple[int, ...] = STRATA,
) -> dict[tuple[int, str], float]:
    """The strictest cutoff of every rule in every stratum for which the promise can be given.

    Of the labelled documents of quality 1 that pass the base rules, n in a stratum, k lie above a cutoff. The exact binomial
    (Clopper-Pearson) upper bound of the true share is at most p where P(Binomial(n, p) <= k) is at most the level;
    p is ``false_rejection`` over the number of rules and the level is ``failure`` over the number of rules, strata and
    cutoffs (Bonferroni). A rule without such a cutoff, as with few labels, rejects nothing in that stratum. All labelled
    rows count; one row of counts for each stratum reaches the driver. Null or repeated labels: the lowest of a document
    counts, null ones don't.
    """
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = metrics.where(~base_failed()).join(good, "doc_id", "left_semi").withColumn("_stratum", stratum(F.col("n_words"), strata))
    above = [F.count_if(metric(r) > c).alias(f"{r}_{i}") for r, grid in cutoffs.items() for i, c in enumerate(grid)]
    counts = held.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), *above).collect()  # a row for each stratum
    level = failure / (len(strata) * sum(map(len, cutoffs.values())))
    share = false_rejection / max(1, len(cutoffs))
    out: dict[tuple[int, str], float] = {}
    for row in counts:
        for r, grid in cutoffs.items():
            passing = [c for i, c in enumerate(grid) if binomial_tail(row[f"{r}_{i}"], row["_n"], share) <= level]
            if passing:
                out[row["_stratum"], r] = min(passing)
    return out


def apply_cutoffs(metrics: DataFrame, chosen: dict[tuple[int, str], float], strata: tuple[int, ...] = STRATA) -> DataFrame:
    """Add ``base_failed``, ``stratum``, ``rejected_by`` (names of the rules) and ``kept``."""
    at = stratum(F.col("n_words"), strata)
    hits = [F.when((at == s) & (metric(r) > c), F.lit(r)) for (s, r), c in sorted(chosen.items())]
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    rows = metrics.withColumns({"base_failed": base_failed(), "stratum": at, "rejected_by": rejected})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def judge_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Metrics and verdict for every document.

    Null and empty texts have no words and fail the base rules; repeated rows give repeated results; null ids are judged
    but never matched to a label; other columns are not read; without labels only the base rules reject.
    """
    metrics = cut(base_metrics(docs, doc_id, text))  # small rows: texts are read once
    return apply_cutoffs(metrics, certified_cutoffs(metrics, labels, **options))
