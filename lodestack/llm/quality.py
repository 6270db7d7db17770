"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule rejects a document whose feature lies above a cutoff. For every
stratum, rule and cutoff of a fixed grid, labelled good documents give an exact
binomial test of "the rule rejects at least `risk / rules` of the good
documents". Cutoffs that are safe after a Bonferroni correction over all tests
qualify; the strictest one of them that rejects more bad than good labelled
documents is used, and none where nothing qualifies. So with probability
1 - error, all rules together reject less than `risk` of each stratum's good
documents.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_table

# Rules (feature, reject above) and their cutoffs, strictest first.
RULES = {
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5],
    "dup_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "repeat_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.29],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0],
}

_SPACE = r"[\\x20\\x09-\\x0D]+"


def features(docs: DataFrame) -> DataFrame:
    """The counts of every row, under names that start with __ beside doc_id and lang."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = r"filter(split(__text, '\\n', -1), x -> length(btrim(x, ' \t\n\u000b\u000c\r')) > 0)"
    words = rf"if(btrim(__text, ' \t\n\u000b\u000c\r') = '', cast(array() as array<string>), split(btrim(__text, ' \t\n\u000b\u000c\r'), '{_SPACE}', -1))"
    # let-bindings: transform(array(x), v -> ...)[0] computes x once
    windows = """element_at(transform(array(transform(__words, w -> xxhash64(w))), h -> if(size(h) < 8, cast(array() as array<bigint>),
        transform(sequence(1, size(h) - 7), i -> xxhash64(slice(h, i, 8))))), 1)"""
    covered = """element_at(transform(array(sort_array(transform(__windows, (x, i) -> struct(x as h, i as p)))), s ->
        element_at(transform(array(sort_array(transform(filter(transform(s, (e, k) ->
            struct(e.p as p, coalesce(get(s, k - 1).h = e.h, false) or coalesce(get(s, k + 1).h = e.h, false) as d)), z -> z.d), z -> z.p))), p ->
            aggregate(transform(p, (x, k) -> least(8, coalesce(get(p, k + 1) - x, 8))), 0, (a, b) -> a + b)), 1)), 1)"""
    out = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("__text"))
    out = out.withColumn("__words", F.expr(words)).withColumn("__lines", F.expr(lines))
    out = out.select(
        "doc_id",
        "lang",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(windows).alias("__windows"),
    )
    repeats = F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), 0).otherwise(F.expr(covered)).cast("long")
    return out.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def _shares() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbol_share": part("n_symbols", "word_chars"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"), "word_length": part("word_chars", "n_words")}


def _lgamma(x: Column) -> Column:
    z = x + 8.0
    low = reduce(lambda a, b: a + b, (F.ln(x + float(i)) for i in range(8)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * log(2 * pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p) for k < n p, else 1.

    Sums the point probabilities from k downwards; those more than 40 standard
    deviations and 100 places below k don't change a double.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    down = F.sequence(k.cast("long"), F.greatest(F.lit(0), (k - 40 * F.sqrt(n * p) - 100).cast("long")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * i * (1 - p) / ((n - i + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * F.aggregate(down, start, step, lambda a: a["sum"]))


def cutoffs(labelled: DataFrame, *, risk: float = 0.01, error: float = 0.05, rules: dict = RULES) -> DataFrame:
    """lang, rule, cutoff, n_good, false_rejects, p_value: the cutoffs in use.

    labelled: rows with lang, features and `good` (boolean). Strata are languages;
    rows without one form a stratum of their own ("").
    """
    counts = []
    for rule, grid in rules.items():
        for c, cut in enumerate(grid):
            over = F.col(rule) > cut
            counts += [F.count_if(over & F.col("good")).alias(f"{rule}_{c}_good"), F.count_if(over & ~F.col("good")).alias(f"{rule}_{c}_bad")]
    by = labelled.groupBy(F.coalesce("lang", F.lit("")).alias("stratum")).agg(F.count_if(F.col("good")).alias("n_good"), *counts)
    tests = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"{rule}_{c}_good").alias("good"), F.col(f"{rule}_{c}_bad").alias("bad")) for rule, grid in rules.items() for c, cut in enumerate(grid)))
    strata = by.agg(F.count(F.lit(1)).alias("strata"))
    rows = by.select("stratum", "n_good", F.inline(tests)).join(F.broadcast(strata))  # one row
    rows = rows.withColumn("p_value", binomial_tail(F.col("good"), F.col("n_good"), risk / len(rules)))
    n_tests = F.col("strata") * sum(map(len, rules.values()))
    safe = rows.where((F.col("p_value") <= error / n_tests) & (F.col("bad") > F.col("good")))
    return safe.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n_good", F.col("good").alias("false_rejects"), "p_value")).alias("x")).select("stratum", "rule", "x.*")


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = 0.01, error: float = 0.05, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules for every row of docs.

    Words are runs of anything but ASCII white space; null text has none.
    n_dup_lines counts lines with a word that equal an earlier line;
    n_repeat_words counts words in windows of 8 words that occur twice or more in
    the text, the first included. base_failed: fewer than min_words words, or
    more than repeat_percent of them repeated. Other rows are kept unless they
    lie above a cutoff in use for their language (see `cutoffs`), which labels
    (doc_id, quality 0/1) decide; labels with a null in either are left out, and
    of several labels for a doc_id the largest counts. Without labels nothing
    but the base rejects. Repeated rows each get their row, extra columns are
    ignored, and an empty table gives no rows.
    """
    rows = cut_table(features(docs).withColumns(_shares()))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    labelled = rows.where(~failed).join(known, "doc_id")
    by = cutoffs(labelled, risk=risk, error=error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    out = rows.withColumn("base_failed", failed).join(by, F.coalesce("lang", F.lit("")) == by.stratum, "left")
    broken = F.filter(F.array(*(F.when(F.col(r) > F.try_element_at("cuts", F.lit(r)), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", broken)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
