"""Citations and packages: which generated paragraphs and scenes their sources back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def enforce(paragraphs: DataFrame, known: DataFrame, package: str, key: str, cited: str, text: str, mode: str = "label") -> DataFrame:
    """paragraphs with only the ids that known (package, id) holds, and what becomes of those left without any.

    mode remove drops their text, label marks it, fail leaves it; supported tells which are backed. A package without
    paragraphs has no rows; one without known ids supports nothing. (package, key) names one paragraph, so what is
    gathered is never more than a paragraph cites.
    """
    asked = paragraphs.select(package, key, F.posexplode(F.array_distinct(cited)).alias("__at", "id"))
    held = asked.join(known.select(package, "id"), [package, "id"], "left_semi")
    valid = held.groupBy(package, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "id"))), lambda x: x["id"]).alias("valid"))
    out = paragraphs.join(valid, [package, key], "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>"))).withColumn("supported", F.size("valid") > 0)
    changed = {"remove": F.lit(None).cast("string"), "label": F.concat(F.lit("[Interpretation] "), F.col(text)), "fail": F.col(text)}[mode]
    return out.select(package, key, "valid", "supported", F.when(F.col("supported"), F.col(text)).otherwise(changed).alias(text))


def coverage(enforced: DataFrame, package: str) -> DataFrame:
    """(package, paragraphs, supported, coverage); 1.0 where a package has no paragraphs cannot arise from rows."""
    ok = F.sum(F.col("supported").cast("int"))
    return enforced.groupBy(package).agg(F.count("*").alias("paragraphs"), ok.alias("supported"), F.round(ok / F.count("*"), 6).alias("coverage"))


def scene_flags(scenes: DataFrame, needs: Column, indices: Column) -> DataFrame:
    return scenes.withColumn("warning", F.when(needs & (F.coalesce(F.size(indices), F.lit(0)) < 1), "no citation"))


def scene_range(want_low: Column, want_high: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The wanted range within the format's own, which is 5 to 10 where there is none."""
    least, most = F.coalesce(low, F.lit(5)), F.coalesce(high, F.lit(10))
    return F.greatest(F.coalesce(want_low, least), least), F.least(F.coalesce(want_high, most), most)


def script(scenes: DataFrame, package: str, number: str, title: str, text: str) -> DataFrame:
    line = F.struct(F.col(number).alias("n"), F.concat(F.lit("### Scene "), F.col(number), F.lit(": "), F.col(title), F.lit("\n"), F.col(text)).alias("t"))
    return scenes.groupBy(package).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n\n").alias("script"))


def next_versions(history: DataFrame, new: DataFrame, package: str, order: str) -> DataFrame:
    """new with version numbers that follow the greatest of history (package, version), in the order given."""
    last = history.groupBy(package).agg(F.max("version").alias("__last"))
    n = F.row_number().over(Window.partitionBy(package).orderBy(order))
    return new.join(last, package, "left").withColumn("version", F.coalesce("__last", F.lit(0)) + n).drop("__last")


def pacing(scenes: DataFrame, templates: DataFrame, text: str, seconds: str, per_minute: int = 150) -> DataFrame:
    """scenes with words, max_words, too_long, per_minute and too_fast, against the limits of their template.

    templates (template, max_words) is a small table; a scene of an unknown template has no limit, one without seconds
    no pace.
    """
    words = F.size(F.split(F.trim(text), r"\s+"))
    both = scenes.join(F.broadcast(templates), "template", "left").withColumn("words", words)
    pace = F.col("words") * 60 / F.nullif(F.col(seconds), F.lit(0))
    return both.withColumns({"too_long": F.coalesce(F.col("words") > F.col("max_words"), F.lit(False)), "per_minute": F.round(pace, 4), "too_fast": pace > per_minute})
