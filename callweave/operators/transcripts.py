"""Transcripts: fragments to turns, dialogue text, batches, sampling of training rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions import matching
from callweave.functions import text as T
from callweave.sources.stored import dealt


def merge_same_speaker(rows: DataFrame) -> DataFrame:
    """Consecutive messages of one speaker as one turn. rows: session_id, seq, pos, speaker, message."""
    order = Window.partitionBy("session_id").orderBy("seq", "pos")
    changed = (F.lag("speaker").over(order).isNull() | (F.lag("speaker").over(order) != F.col("speaker"))).cast("long")
    rows = rows.withColumn("turn", changed).withColumn("turn", F.sum("turn").over(order))
    out = rows.groupBy("session_id", "turn").agg(F.min("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("seq", "pos", "message"))).alias("parts"))
    return out.select("session_id", "turn", "speaker", F.array_join(F.transform("parts", lambda p: p["message"]), " ").alias("message"))


def recent_context(rows: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return rows.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n).select("session_id", "seq", "speaker", "message")


def fragment_batches(rows: DataFrame, size: int = 3) -> DataFrame:
    """Every `size` fragments of a session are a batch; a lone last fragment is the agent's."""
    whole = Window.partitionBy("session_id")
    place = F.row_number().over(whole.orderBy("seq", "pos")) - 1
    rows = rows.withColumn("batch", F.floor(place / size))
    return rows.withColumn("in_batch", F.count(F.lit(1)).over(Window.partitionBy("session_id", "batch"))).select("session_id", "seq", "pos", "batch", F.when(F.col("in_batch") == 1, "agent").otherwise(F.col("speaker")).alias("speaker"))


def overlap_batches(rows: DataFrame, size: int = 6, overlap: int = 2) -> DataFrame:
    """Batches of `size` rows, each with the `overlap` rows before it too."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "pos")) - 1
    rows = rows.withColumn("place", place.cast("long"))
    last = F.floor((F.col("place") + overlap) / size)
    return rows.withColumn("batch", F.explode(F.sequence(F.floor(F.col("place") / size), last))).select("session_id", "batch", "place")


def format_dialogue(rows: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "speaker", "message").alias("line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda p: p["line"]), "\n").alias("dialogue"))


def dialogue_json(rows: DataFrame) -> DataFrame:
    """key, value: the turns of a session as one JSON text."""
    turns = F.array_sort(F.collect_list(F.struct("seq", "speaker", "message")))
    return rows.groupBy("session_id").agg(F.to_json(turns).alias("value")).select(F.concat(F.lit("stt:"), F.col("session_id")).alias("key"), "value")


def customer_script(rows: DataFrame, noise: list[str] = T.SCRIPT_NOISE) -> DataFrame:
    """Customer messages without noise phrases, those of more than 4 characters joined by blanks."""
    clean = T.strip(T.replace_all(F.col("message"), {n: "" for n in noise}))
    rows = rows.filter("speaker = 'customer'").withColumn("message", clean).filter(F.length("message") > 4)
    parts = F.array_sort(F.collect_list(F.struct("seq", "message")))
    return rows.groupBy("session_id").agg(T.collapse(F.array_join(F.transform(parts, lambda p: p["message"]), " ")).alias("script"))


def refine_join(turns: DataFrame, refined: DataFrame) -> DataFrame:
    """Refined text where there is some, the first pass's elsewhere. refined: session_id, seq, refined."""
    return turns.join(refined, ["session_id", "seq"], "left").select("session_id", "seq", "speaker", F.coalesce(F.nullif("refined", F.lit("")), "message").alias("message"))


def near_duplicate_turns(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """A turn like the last kept one goes; of the two the longer text stays (the earlier one's place)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            if kept and kept[-1][2] == r.speaker and matching.ratio(kept[-1][3], r.message, least) >= least:
                if len(r.message) > len(kept[-1][3]):
                    kept[-1][3] = r.message
            else:
                kept.append([r.session_id, r.seq, r.speaker, r.message])
        return pd.DataFrame(kept, columns=["session_id", "seq", "speaker", "message"])

    return rows.groupBy("session_id").applyInPandas(fold, "session_id long, seq long, speaker string, message string")


def merge_batches(rows: DataFrame, most: int = 8, least: float = 0.93) -> DataFrame:
    """Overlapping batches of turns folded into one list per session. rows: session_id, batch, seq, speaker, message (null
    is blank)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        session, merged = pdf["session_id"].iloc[0], []
        for _, batch in pdf.sort_values(["batch", "seq"]).groupby("batch", sort=True):
            merged = matching.append_turns(merged, list(zip(batch["speaker"], batch["message"].fillna(""))), most, least)
        merged = matching.tidy_turns(merged)
        return pd.DataFrame({"session_id": session, "turn": range(len(merged)), "speaker": [s for s, _ in merged], "message": [m for _, m in merged]})

    return rows.groupBy("session_id").applyInPandas(fold, "session_id long, turn long, speaker string, message string")


def sequence_ratio(rows: DataFrame, a: str, b: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["id"]].assign(ratio=[round(matching.ratio(x or "", y or ""), 6) for x, y in zip(f[a], f[b])])

    return dealt(rows.select("id", a, b)).mapInPandas(run, "id long, ratio double")


def word_diff(rows: DataFrame, a: str, b: str) -> DataFrame:
    """id, op, before, after of every changed stretch of words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, *d) for i, x, y in zip(f["id"], f[a], f[b]) for d in matching.word_changes(x or "", y or "")]
            yield pd.DataFrame(out, columns=["id", "op", "before", "after"])

    return dealt(rows.select("id", a, b)).mapInPandas(run, "id long, op string, before string, after string")


def correction_summary(rows: DataFrame, before: str, after: str) -> DataFrame:
    changed = F.count_if(~F.col(before).eqNullSafe(F.col(after)))
    return rows.agg(F.count(F.lit(1)).alias("utterances"), changed.alias("changed"), F.round(changed * 100.0 / F.count(F.lit(1)), 6).cast("double").alias("percent"))


def clean_items(rows: DataFrame) -> DataFrame:
    """rows with speakers by their usual names and clean messages; other speakers and blank messages go."""
    rows = rows.withColumn("speaker", T.speaker_of(F.col("speaker"))).withColumn("message", T.clean_utterance(F.col("message")))
    return rows.filter(F.col("speaker").isNotNull() & (F.col("message") != ""))


def correction_similarity(rows: DataFrame, before: str, after: str, truth: str) -> DataFrame:
    """Rows, mean ratio to the truth before and after a correction, and the gain. Nulls count as empty; no rows give nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({c: [matching.ratio(x or "", t or "") for x, t in zip(f[c], f["t"])] for c in ("a", "b")})

    scored = dealt(rows.select(F.col(before).alias("a"), F.col(after).alias("b"), F.col(truth).alias("t"))).mapInPandas(run, "a double, b double")
    return scored.agg(F.count(F.lit(1)).alias("utterances"), F.round(F.avg("a"), 6).alias("before"), F.round(F.avg("b"), 6).alias("after"), F.round(F.avg("b") - F.avg("a"), 6).alias("gain"))


def speaker_accuracy(rows: DataFrame) -> DataFrame:
    """aligned, truth_characters, accuracy (of the aligned characters) and coverage (of the true ones), 0 where there are
    none. rows as in speaker_confusion."""
    n = F.col("characters")
    aligned = speaker_confusion(rows).agg(F.coalesce(F.sum(n), F.lit(0)).alias("aligned"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), n)), F.lit(0)).alias("same"))
    size = rows.filter("kind = 'truth'").agg(F.coalesce(F.sum(F.length(F.replace("message", F.lit(" "), F.lit("")))), F.lit(0)).alias("truth_characters"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return aligned.join(F.broadcast(size), F.lit(True)).select("aligned", "truth_characters", share("same", "aligned").alias("accuracy"), share("aligned", "truth_characters").alias("coverage"))


def speaker_confusion(rows: DataFrame) -> DataFrame:
    """truth, predicted, characters: per-character speakers on the equal stretches of two versions of a session.
    rows: session_id, kind (truth or predicted), seq, speaker, message."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        sides = [[(s, m.replace(" ", "")) for s, m in zip(p["speaker"], p["message"])] for p in (pdf[pdf["kind"] == "truth"], pdf[pdf["kind"] == "predicted"])]
        return pd.DataFrame(matching.aligned_speakers(*sides), columns=["truth", "predicted", "characters"])

    per_session = rows.groupBy("session_id").applyInPandas(fold, "truth string, predicted string, characters long")
    return per_session.groupBy("truth", "predicted").agg(F.sum("characters").alias("characters"))


def longest_error_spans(rows: DataFrame, least: int = 20, most: int = 20) -> DataFrame:
    """The longest stretches of a session given to the wrong speaker, ranked. rows as in speaker_confusion."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        sides = [[(s, m.replace(" ", "")) for s, m in zip(p["speaker"], p["message"])] for p in (pdf[pdf["kind"] == "truth"], pdf[pdf["kind"] == "predicted"])]
        found = matching.error_spans(*sides, least, most)
        key = pdf["session_id"].iloc[0]
        return pd.DataFrame([(key, rank, *x) for rank, x in enumerate(found, 1)], columns=["session_id", "rank", "characters", "truth_start", "predicted_start", "truth", "predicted"])

    return rows.groupBy("session_id").applyInPandas(fold, "session_id long, rank long, characters long, truth_start long, predicted_start long, truth string, predicted string")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.withColumn("__order", F.xxhash64(F.lit(seed), F.col(key)))


def style_sample(rows: DataFrame, key: str, n: int, labels: dict[str, float], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows get a label by weight, the others `plain`; the same for equal seed and keys.

    The n-th smallest order value is found by a limited sort of keys, so no window spans all rows."""
    ordered = seeded_order(rows, key, seed)
    chosen = ordered.select(key, "__order").orderBy("__order", key).limit(n).select(key, F.lit(True).alias("__in"))
    share = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(1_000_000)) / 1_000_000
    label, total = None, 0.0
    for name, weight in labels.items():
        total += weight
        label = F.when(share < total, name) if label is None else label.when(share < total, name)
    return rows.join(chosen, key, "left").withColumn("style", F.when(F.col("__in"), label.otherwise(list(labels)[-1])).otherwise("plain")).drop("__in")


def train_test_split(rows: DataFrame, key: str, n: int | None = None, test: int = 10, seed: int = 42) -> DataFrame:
    """The first n rows (default: all) in a seeded order, with is_test for the first `test` percent of these, rounded up.

    The order is that of the md5 of seed and key, then the key. Rows are numbered inside buckets by the first digits of the
    hash and offset by the sizes of the buckets before, so no window spans all rows."""
    rows = rows.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    rows = rows.withColumn("__bucket", F.substring("__hash", 1, 3))
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__bucket").alias("__of"), before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))  # 4,096 rows and one of nulls at most
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", key))
    rows = rows.withColumn("__place", place).join(F.broadcast(offsets), F.col("__bucket").eqNullSafe(F.col("__of")))
    most = F.col("__all") if n is None else F.least(F.col("__all"), F.lit(n))
    rows = rows.withColumn("__place", F.col("__before") + F.col("__place")).filter(F.col("__place") <= most)
    return rows.withColumn("is_test", F.col("__place") <= F.ceil(most * test / 100)).drop("__hash", "__bucket", "__of", "__before", "__all", "__place")
