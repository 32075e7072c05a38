"""Calls: first-call resolution, agents, customers, audit and distribution reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration_seconds(text: Column) -> Column:
    """Seconds of M:SS or H:MM:SS; null, empty and malformed text give 0."""
    parts = F.split(text, ":")
    numbers = F.transform(parts, lambda p: p.cast("long"))
    value = F.when(F.size(parts) == 2, numbers[0] * 60 + numbers[1]).when(F.size(parts) == 3, F.get(numbers, F.lit(0)) * 3600 + F.get(numbers, F.lit(1)) * 60 + F.get(numbers, F.lit(2)))
    return F.coalesce(F.when(text.rlike(r"^\d+:\d{1,2}(:\d{1,2})?$"), value), F.lit(0)).cast("long")


def duration_text(seconds: Column) -> Column:
    """MM:SS; null stays null."""
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long")))


def fcr_flags(calls: DataFrame, category: str = "category_raw", days: int = 7) -> DataFrame:
    """calls with fcr: false if the same customer and category call again 1 to `days` days later. Same-day calls don't
    count, null keys never match. Only distinct days are sorted, so a customer with many calls is no heavy group."""
    key = ["customer_id", category]
    seen = calls.filter(F.col("customer_id").isNotNull() & F.col(category).isNotNull()).select(*key, "call_date").distinct()
    following = F.lead("call_date").over(Window.partitionBy(*key).orderBy("call_date"))
    repeated = seen.withColumn("again", F.datediff(following, F.col("call_date")) <= days).filter("again").drop("again").withColumn("failed", F.lit(True))
    return calls.join(repeated, [*key, "call_date"], "left").withColumn("fcr", F.col("failed").isNull()).drop("failed")


def similar_recent(calls: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Calls of the last `days` days with their failure by sub-category over all history."""
    flagged = fcr_flags(calls, "category_sub")
    return flagged.filter(F.col("call_date") >= F.date_sub(F.lit(as_of), days)).select("id", "customer_id", "category_sub", "call_date", (~F.col("fcr")).alias("fcr_failed"))


def agent_performance(calls: DataFrame) -> DataFrame:
    """calls: of fcr_flags(). Ranked agents; percent and mean seconds are cut to whole numbers."""
    stats = calls.filter(F.col("agent_id").isNotNull()).groupBy("agent_id").agg(F.count(F.lit(1)).alias("consultations"), F.count_if("fcr").alias("resolved"), F.floor(F.avg(duration_seconds(F.col("call_duration")))).alias("avg_seconds"))
    stats = stats.withColumn("fcr_rate", F.floor(F.col("resolved").cast("double") / F.col("consultations") * 100))
    text = F.when(F.col("avg_seconds") > 0, F.format_string("%d:%02d", F.floor(F.col("avg_seconds") / 60), F.col("avg_seconds") % 60)).otherwise("0:00")
    order = Window.orderBy(F.desc("consultations"), F.desc("fcr_rate"), "avg_seconds", "agent_id")
    return stats.select("agent_id", "consultations", "fcr_rate", "avg_seconds", text.alias("avg_time"), F.row_number().over(order).cast("long").alias("rank"))


def apply_agent_performance(employees: DataFrame, performance: DataFrame) -> DataFrame:
    """employees with their figures; those without calls keep zeros and no rank."""
    stats = performance.select(F.col("agent_id").alias("id"), "consultations", "fcr_rate", "rank")
    return employees.join(stats, "id", "left").fillna({"consultations": 0, "fcr_rate": 0})


def customer_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_consultations"), F.count_if("fcr").alias("resolved_first_call"), F.max("call_date").alias("last_consultation_date"))


def apply_customer_stats(customers: DataFrame, stats: DataFrame) -> DataFrame:
    """Only customers with calls change; the others have zeros."""
    return customers.join(stats.withColumnRenamed("customer_id", "id"), "id", "left").fillna({"total_consultations": 0, "resolved_first_call": 0})


def fcr_summary(calls: DataFrame) -> DataFrame:
    total, good = F.count(F.lit(1)), F.count_if("fcr")
    return calls.agg(total.alias("total"), good.alias("fcr_true"), (total - good).alias("fcr_false"), F.round(good * 100.0 / total, 6).cast("double").alias("rate"))


def customer_recent_history(calls: DataFrame, as_of: dt.date, days: int = 90, relevant: int = 30) -> DataFrame:
    recent = calls.filter(F.col("call_date") >= F.date_sub(F.lit(as_of), days))
    out = recent.groupBy("customer_id").agg(F.count(F.lit(1)).alias("calls"), F.max("call_date").alias("last_date"), F.min("call_date").alias("first_date"), F.array_sort(F.collect_set("category_sub")).alias("categories"))
    since = F.datediff(F.lit(as_of), F.col("last_date")).cast("long")
    return out.select("*", since.alias("days_since"), (since <= relevant).alias("has_relevant"))


def suspicious_downloads(log: DataFrame, staff: DataFrame, until: dt.datetime, hours: int = 1, least: int = 10) -> DataFrame:
    """Users with `least` downloads or more in the `hours` before `until`; unknown users stay, without a name."""
    end = F.lit(until).cast("timestamp_ntz")
    recent = log.filter((F.col("downloaded_at") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("downloaded_at") <= end))
    out = recent.groupBy("downloaded_by").agg(F.count(F.lit(1)).alias("downloads"), F.max("downloaded_at").alias("last_at"), F.array_sort(F.collect_set("consultation_id")).alias("consultations")).filter(F.col("downloads") >= least)
    return out.join(staff.select(F.col("id").alias("downloaded_by"), "name"), "downloaded_by", "left")


def daily_download_stats(log: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    day = F.to_date("downloaded_at")
    return log.filter(day >= F.date_sub(F.lit(as_of), days)).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("downloads"), F.count_distinct("downloaded_by").alias("users"), F.count_distinct("consultation_id").alias("consultations"))


def agent_distribution(calls: DataFrame) -> DataFrame:
    n = calls.groupBy("agent_id").count()
    return n.agg(F.count(F.lit(1)).alias("agents"), F.sum("count").alias("total"), F.round(F.avg("count"), 2).alias("average"), F.min("count").alias("least"), F.max("count").alias("most"), (F.max("count") - F.min("count")).alias("spread"))


def agent_balance(calls: DataFrame, limit: float = 0.5) -> DataFrame:
    n = calls.groupBy("agent_id").count()
    return n.agg(F.round(F.avg("count"), 6).alias("mean"), F.round(F.stddev_pop("count"), 6).alias("deviation"), (F.stddev_pop("count") / F.avg("count") > limit).alias("uneven"))


def agent_extremes(calls: DataFrame, k: int = 5) -> DataFrame:
    """The k busiest and the k least busy agents."""
    n = calls.groupBy("agent_id").agg(F.count(F.lit(1)).alias("calls"))
    top = n.orderBy(F.desc("calls"), "agent_id").limit(k).withColumn("side", F.lit("top"))
    low = n.orderBy("calls", "agent_id").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def category_rollup(calls: DataFrame) -> DataFrame:
    """Calls and agents by main and raw category, by main category (level 1) and in total (level 3)."""
    return calls.rollup("category_main", "category_raw").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("agent_id").alias("agents"), F.grouping_id().cast("long").alias("level"))


def category_pools(calls: DataFrame, expected: dict[str, int], gap: int = 2) -> DataFrame:
    """category_main, agents, expected, warn: a pool that is more than `gap` agents off. A category without an expected size
    is what it is. Agents are made distinct before they are counted, so a hot category needs no large group."""
    sizes = F.coalesce(*[F.when(F.col("category_main") == c, F.lit(n).cast("long")) for c, n in expected.items()], F.col("agents"))
    pools = calls.select("category_main", "agent_id").distinct().groupBy("category_main").agg(F.count("agent_id").alias("agents"))
    return pools.withColumn("expected", sizes).withColumn("warn", F.abs(F.col("agents") - F.col("expected")) > gap)


def type_distribution(rows: DataFrame, code: str) -> DataFrame:
    """Count and percent of all rows, those without a code included in the base."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.lit(True)).select("code", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).cast("double").alias("percent"))


def frequency_of_frequencies(calls: DataFrame) -> DataFrame:
    return calls.groupBy("customer_id").agg(F.count(F.lit(1)).alias("calls")).groupBy("calls").agg(F.count(F.lit(1)).alias("customers"))


def scenario_catalog(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n")).select("category", "n", F.explode(F.array(F.lit("beginner"), F.lit("advanced"))).alias("level"))


def recent_rank(calls: DataFrame) -> DataFrame:
    order = Window.partitionBy("customer_id").orderBy(F.desc("call_date"), F.desc("id"))
    return calls.select("id", "customer_id", "call_date", F.row_number().over(order).cast("long").alias("recency"))


def consultation_relevance(calls: DataFrame, as_of: dt.date, latest: int = 10) -> DataFrame:
    order = Window.partitionBy("customer_id").orderBy(F.desc("call_date"), F.desc("id"))
    d = F.col("days_ago")
    level = F.when(d <= 7, "high").when(d <= 30, "medium").when(d <= 90, "low").otherwise("none")
    score = F.when(d <= 7, 100 - 5 * d).when(d <= 30, 65 - 2 * (d - 7)).when(d <= 90, 20 - F.expr("(days_ago - 30) div 6")).otherwise(0)
    rows = calls.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= latest)
    return rows.withColumn("days_ago", F.datediff(F.lit(as_of), F.col("call_date")).cast("long")).select("id", "customer_id", "days_ago", level.alias("level"), score.cast("long").alias("score"))


def persona_relevance(customers: DataFrame, calls: DataFrame, as_of: dt.date) -> DataFrame:
    last = calls.groupBy("customer_id").agg(F.max("call_date").alias("last"), F.count_if(F.col("call_date") >= F.date_sub(F.lit(as_of), 90)).alias("recent_calls"))
    days = F.coalesce(F.datediff(F.lit(as_of), F.col("last")), F.lit(9999)).cast("long")
    state = F.when(days <= 30, "valid").when(days <= 180, "stale").otherwise("outdated")
    return customers.select("id").join(last.withColumnRenamed("customer_id", "id"), "id", "left").select("id", days.alias("days_since"), state.alias("state"), F.coalesce("recent_calls", F.lit(0)).alias("recent_calls"))


def customer_guidance_info(customers: DataFrame, as_of: dt.date) -> DataFrame:
    """customers: of apply_customer_stats()."""
    total, days = F.col("total_consultations"), F.datediff(F.lit(as_of), F.col("last_consultation_date"))
    tier = F.when((total == 0) | days.isNull(), "new").when(days <= 7, "very_recent").when(days <= 30, "recent").when(days <= 90, "quarter").when(days <= 365, "year").otherwise("inactive")
    rate = F.when(total > 0, F.round(F.col("resolved_first_call") * F.lit(100).cast("decimal(20,0)") / total, 1)).cast("double")
    return customers.select("id", tier.alias("tier"), rate.alias("fcr_rate"))


def slot_conflicts(calls: DataFrame) -> DataFrame:
    """Calls of agents who have another in the same minute."""
    minute = F.date_trunc("minute", F.col("call_ts").cast("timestamp")).cast("timestamp_ntz")
    booked = F.count(F.lit(1)).over(Window.partitionBy("agent_id", "minute"))
    return calls.withColumn("minute", minute).withColumn("booked", booked).filter("booked > 1").select("id", "agent_id", "minute", "booked")


def round_robin(calls: DataFrame, pools: DataFrame) -> DataFrame:
    """The n-th call of a category goes to place n mod size of its pool. pools: category_raw, slot, agent.

    A category may hold most calls, so no window spans one: calls are counted by category and hash bucket, and a
    call's number is its bucket's offset plus its place in the bucket."""
    buckets = 64
    rows = calls.select("id", "category_raw", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    sizes = rows.groupBy("category_raw", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("category_raw").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("category_raw", "bucket").orderBy("id")) - 1
    numbered = rows.withColumn("place", place).join(sizes.withColumn("offset", offset).drop("n"), ["category_raw", "bucket"])
    many = pools.groupBy("category_raw").agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(F.broadcast(many), "category_raw").withColumn("slot", ((F.col("offset") + F.col("place")) % F.col("size"))).join(F.broadcast(pools), ["category_raw", "slot"]).select("id", "category_raw", "agent")


# First and last rank of a band, targets of these two.
TARGET_BANDS = [(1, 5, 132, 124), (6, 15, 122, 108), (16, 35, 106, 88), (36, 55, 87, 79), (56, 60, 78, 75)]


def agent_targets(ranked: DataFrame, total: DataFrame | None = None, bands: Sequence[tuple[int, int, int, int]] = TARGET_BANDS, default: int = 93, adjusted: tuple[int, int] = (15, 55)) -> DataFrame:
    """agent_id, target. ranked: agent_id, rank (agents, so a short table; null counts as rank 35). Linear between a band's
    targets, rounded half to even; `default` beyond the bands. With total (one row: calls), what is missing or left over is
    spread one by one over the ranks of `adjusted` in order, again and again; without such an agent nothing is."""
    rank = F.coalesce("rank", F.lit(35))
    bands_of = [F.when(rank.between(a, z), F.bround(F.lit(float(high)) - (high - low) * (rank - a) / max(z - a, 1)).cast("long")) for a, z, high, low in bands]
    rows = ranked.select("agent_id", "rank", F.coalesce(*bands_of, F.lit(default).cast("long")).alias("target"))
    if total is None:
        return rows.select("agent_id", "target")
    inside = F.coalesce(F.col("rank").between(*adjusted), F.lit(False))
    sums = rows.agg(F.sum("target").alias("__given"), F.count_if(inside).alias("__n")).join(F.broadcast(total.select(F.col("calls").alias("__calls"))), F.lit(True))
    rows = rows.withColumn("__in", inside).withColumn("__place", F.row_number().over(Window.partitionBy("__in").orderBy("rank", "agent_id")))
    rows = rows.join(F.broadcast(sums), F.lit(True)).withColumn("__gap", F.col("__calls") - F.col("__given"))
    more = F.expr("abs(__gap) div __n + CAST(__place <= abs(__gap) % __n AS BIGINT)")
    return rows.select("agent_id", (F.col("target") + F.when(F.col("__in"), F.signum("__gap").cast("long") * more).otherwise(0)).alias("target"))


def calls_per_agent(calls: DataFrame, each: int = 3, most: int = 100) -> DataFrame:
    """The first calls of each agent, `each` at most, and the first `most` of these overall."""
    order = Window.partitionBy("agent_id").orderBy("id")
    rows = calls.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= each)
    return rows.select("agent_id", "id", F.col("place").cast("long").alias("place")).orderBy("agent_id", "place").limit(most)


def learning_analytics(results: DataFrame, edge: int = 5) -> DataFrame:
    """Per employee: totals, scores, pass rate, improvement (mean of last `edge` less first), completed scenarios."""
    first = Window.partitionBy("employee_id").orderBy("started_at", "id")
    last = Window.partitionBy("employee_id").orderBy(F.desc("started_at"), F.desc("id"))
    rows = results.withColumn("up", F.row_number().over(first)).withColumn("down", F.row_number().over(last))
    score = F.col("overall_score")
    return rows.groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.round(F.avg(score), 6).alias("avg_score"),
        F.max(score).alias("best_score"),
        F.round(F.count_if("passed") * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("pass_rate"),
        F.round(F.avg(F.when(F.col("down") <= edge, score)) - F.avg(F.when(F.col("up") <= edge, score)), 6).alias("improvement"),
        F.array_sort(F.collect_set(F.when(F.col("passed"), F.col("scenario_id")))).alias("completed"),
        F.sum("call_seconds").alias("total_seconds"),
        F.round(F.avg("similarity"), 6).alias("avg_similarity"),
        F.round(F.avg("completion"), 6).alias("avg_completion"),
        F.max("started_at").alias("latest_at"),
        F.max(F.when(F.col("down") == 1, score)).alias("latest_score"),
    )


def learning_breakdown(results: DataFrame, by: str) -> DataFrame:
    """Attempts, mean and best score and pass rate per employee and value of a column (type or category)."""
    score = F.col("overall_score")
    return results.groupBy("employee_id", by).agg(
        F.count(F.lit(1)).alias("attempts"), F.round(F.avg(score), 6).alias("avg_score"), F.max(score).alias("best_score"),
        F.round(F.count_if("passed") * 100.0 / F.count(F.lit(1)), 2).cast("double").alias("pass_rate"),
    )


def weighted_evaluation(scores: DataFrame, weights: DataFrame, pass_at: float = 70.0) -> DataFrame:
    """scores: id, criterion, score. weights: criterion, weight (percent). Overall = sum of weight * score / 100."""
    total = F.round(F.sum(F.col("weight") * F.col("score") / 100.0), 6)
    return scores.join(F.broadcast(weights), "criterion").groupBy("id").agg(total.alias("overall")).withColumn("passed", F.col("overall") >= pass_at)


def personality_majority(labels: DataFrame) -> DataFrame:
    """Of the current and two earlier labels: one that occurs twice, else S3, S2 or S1 in this order, else the latest."""
    frame = Window.partitionBy("customer_id").orderBy("ts", "id").rowsBetween(-2, 0)
    last = F.col("last")
    a, b, c = (F.get(last, F.lit(i)) for i in range(3))
    twice = F.when(a == b, a).when(b == c, b).when(a == c, a)
    strong = F.coalesce(*[F.when(F.array_contains(last, s), F.lit(s)) for s in ("S3", "S2", "S1")])
    rows = labels.withColumn("last", F.collect_list("label").over(frame))
    return rows.select("id", "customer_id", "label", F.coalesce(twice, strong, F.col("label")).alias("personality"))


def model_summary(rows: DataFrame, measures: Sequence[str] = ("ttft", "tps", "tokens")) -> DataFrame:
    """Rows, accuracy in percent and the mean of each measure by model; nulls don't count in a mean."""
    means = [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in measures]
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("res")).cast("int")) * 100, 6).alias("accuracy"), *means)


def class_accuracy(rows: DataFrame, classes: list) -> DataFrame:
    """Accuracy in percent by model and true class, one column a class."""
    cells = [F.round(F.avg(F.when(F.col("truth") == c, (F.col("res") == c).cast("int"))) * 100, 6).alias(f"class_{c}") for c in classes]
    return rows.groupBy("model").agg(*cells)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame], least: dict[str, int] | None = None) -> DataFrame:
    """name, rows, status: empty, few (under the expected minimum, one row where none is given) or ok."""
    out = None
    for name, df in tables.items():
        status = F.when(F.col("rows") == 0, "empty").when(F.col("rows") < (least or {}).get(name, 1), "few").otherwise("ok")
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", status.alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
