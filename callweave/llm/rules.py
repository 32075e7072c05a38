"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

statistics() makes one narrow pass over whole texts. A setting gives each rule "statistic above cutoff" a cutoff; a row
goes if any rule rejects it. calibrate() takes labelled good documents as a holdout and halves them by a hash of the id.
The first half only orders settings: for each stratum a path from mild to strict. Its settings have, rule by rule, the lowest
cutoff that rejects at most L / LEVELS of `risk` (shared by the rules) of that half, L from 0 to LEVELS, after MARGIN settings
whose cutoffs are so many places milder than those of L = 0. The second half
tests the path by fixed sequence: setting after setting, until one is not certified. With n good rows and k of them
rejected, a setting is certified if a binomial count of n with rate `risk` would be at most k with chance `doubt` / strata or
less (exact; Bonferroni over strata, no correction along the path is needed). So, with confidence 1 - doubt, no stratum
loses more than `risk` of its good documents to these rules.

A stratum is a language. The smallest that can be certified has log(doubt / strata) / log(1 - risk) good rows in the second
half: with risk and doubt 0.05 and four strata 86, so some 170 in all. One with fewer has no cutoffs and rejects nothing.

Defined cases: null text has no words and fails the base rules; a text of any length is read whole, in one task; a repeated
three-word window is found by 64-bit hashes of its words; null lang is the stratum `und`; null or other labels are not
used; repeated rows count each, and those of one id are in one half; equal statistics share a verdict; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import BLANKS, WORD, computed, materialise, read_table

#: Rule name: (statistic, cutoffs from strict to mild). Higher is worse.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_a_word": ("n_symbols / n_words", [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0]),
    "repeated_words": ("n_repeat_words / n_words", [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "duplicate_lines": ("n_dup_lines / n_lines", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "capitals": ("n_capitals / word_chars", [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]),
    "word_length": ("word_chars / n_words", [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keep = ["doc_id", "stratum"]
    rows = computed(
        rows,
        keep,
        words=F.filter(F.split(text, BLANKS), lambda w: w != ""),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        word_chars=F.length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        n_symbols=F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        n_capitals=F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"),
    )
    windows = F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")
    keep += ["word_chars", "n_symbols", "n_capitals"]
    rows = computed(
        rows,
        keep,
        n_words=F.size("words").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        windows=F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>")),
    )
    keep += ["n_words", "n_lines", "n_dup_lines"]
    # windows in order of hash and place: equal neighbours are the repeated ones; their places, in order, cover the words
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = computed(rows, keep, pairs=F.when(some, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    places = F.expr("sort_array(transform(filter(pairs, (p, j) -> (j > 0 and pairs[j - 1].x = p.x) or (j + 1 < size(pairs) and pairs[j + 1].x = p.x)), p -> p.i))")
    rows = computed(rows, keep, places=places)
    covered = F.expr("3 + aggregate(sequence(1, size(places) - 1), 0, (a, j) -> a + least(3, places[j] - places[j - 1]))")
    rows = computed(rows, keep, n_repeat_words=F.when(F.size("places") >= 2, covered).otherwise(0).cast("long"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _values() -> list[tuple[str, Column, list[float]]]:
    return [(name, F.try_divide(*(F.col(x).cast("double") for x in statistic.split(" / "))), cutoffs) for name, (statistic, cutoffs) in RULES.items()]


def low_tail(n: Column, k: Column, rate: float) -> Column:
    """P(binomial(n, rate) <= k), its terms summed from logarithms. Callers keep k below n * rate."""
    odds = math.log(rate / (1 - rate))
    start = F.struct((n * F.lit(math.log1p(-rate))).alias("log"), F.exp(n * F.lit(math.log1p(-rate))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]


#: Steps of a path of settings.
MARGIN, LEVELS = 4, 10
LAST = MARGIN + LEVELS


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = 0.05, doubt: float = 0.05) -> DataFrame:
    """stats: of statistics(). labels: doc_id, quality. One row a stratum: stratum, cutoffs map<rule, double> (null: none)."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
    # of each rule, how many cutoffs the row exceeds; it is rejected by cutoff number c if that is more than c
    passed = [sum((F.coalesce(value > c, F.lit(False)).cast("int") for c in cutoffs), F.lit(0)) for _, value, cutoffs in _values()]
    half = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).alias("half")
    holdout = materialise(stats.filter(~F.col("base_failed")).join(good, "doc_id").select("stratum", half, F.array(*passed).alias("passed")), "rule-holdout")

    bins = holdout.filter("half = 0").select("stratum", F.posexplode("passed").alias("rule", "passed")).groupBy("stratum", "rule", "passed").agg(F.count(F.lit(1)).alias("rows"))
    cells = bins.groupBy("stratum", "rule").agg(F.sum("rows").alias("n"), F.collect_list(F.struct("passed", "rows")).alias("bins"))
    sizes = F.array(*[F.lit(len(c)) for _, _, c in _values()])
    tails = F.transform(F.sequence(F.lit(0), sizes[F.col("rule")]), lambda c: F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["passed"] > c, b["rows"]).otherwise(0)))
    allowed = lambda level: F.floor(F.col("n") * risk * level / (LEVELS * len(RULES)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.size(F.filter("tails", lambda t: t > allowed(level))))
    mild = F.transform(F.sequence(F.lit(MARGIN), F.lit(1), F.lit(-1)), lambda x: F.least(sizes[F.col("rule")], F.col("steps")[0] + x))
    paths = cells.withColumn("tails", tails).withColumn("steps", steps).select("stratum", F.struct("rule", F.concat(mild, "steps").alias("steps")).alias("p"))
    paths = materialise(paths.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["steps"]).alias("paths")), "rule-paths")

    # the first setting that rejects the row, LAST + 1 if none does
    level = F.array_min(F.transform("paths", lambda steps, i: F.size(F.filter(steps, lambda c: c >= F.get("passed", i)))))
    tested = holdout.filter("half = 1").join(paths, "stratum").groupBy("stratum", level.alias("level")).agg(F.count(F.lit(1)).alias("rows"))
    tested = tested.groupBy("stratum").agg(F.sum("rows").alias("n"), F.collect_list(F.struct("level", "rows")).alias("bins"))
    tested = materialise(tested.join(paths, "stratum"), "rule-tests")
    strata = max(1, tested.count())
    losses = F.transform(F.sequence(F.lit(0), F.lit(LAST)), lambda x: F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["level"] <= x, b["rows"]).otherwise(0)))
    few = F.col("n") * F.lit(risk)
    fails = F.transform("losses", lambda k: F.when(k < few, low_tail(F.col("n"), k, risk) > F.lit(doubt / strata)).otherwise(True))
    # settings before the first that fails
    certified = F.when(F.array_contains("fails", True), F.array_position("fails", True).cast("int") - 1).otherwise(LAST + 1)
    told = tested.withColumn("losses", losses).withColumn("fails", fails).withColumn("certified", certified).filter("certified > 0")
    cutoff = lambda i, cutoffs: F.get(F.array(*map(F.lit, cutoffs)), F.col("paths")[i][F.col("certified") - 1])
    return told.select("stratum", F.create_map(*[x for i, (name, _, cutoffs) in enumerate(_values()) for x in (F.lit(name), cutoff(i, cutoffs))]).alias("cutoffs"))


def apply(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats with kept: the base rules and every certified cutoff of the row's stratum passed. cutoffs has a row a language,
    so Spark broadcasts it while it is small and splits a hot stratum otherwise."""
    rows = stats.join(cutoffs, "stratum", "left")
    bad = [F.coalesce(value > F.col("cutoffs")[name], F.lit(False)) for name, value, _ in _values()]
    verdict = bad[0]
    for b in bad[1:]:
        verdict = verdict | b
    return rows.withColumn("kept", ~F.col("base_failed") & ~verdict).drop("cutoffs")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's statistics and verdict."""
    stats = materialise(statistics(read_table(spark, sf_dir, "documents")), "rule-statistics")
    cutoffs = materialise(calibrate(stats, read_table(spark, sf_dir, "labels")), "rule-cutoffs")
    return apply(stats, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
