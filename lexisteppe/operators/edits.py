"""Fixes applied to paragraphs, and what they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_offsets(runs: DataFrame, keys: tuple[str, ...] = ("doc_id", "para"), order: str = "ord") -> DataFrame:
    """Runs (keys, ord, text, ...) with start_pos and end_pos in their paragraph; empty runs are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return runs.where(F.length("text") > 0).withColumn("end_pos", F.sum(F.length("text")).over(w).cast("int")).withColumn("start_pos", (F.col("end_pos") - F.length("text")).cast("int"))


def applied(paragraphs: DataFrame, fixes: DataFrame, keys: tuple[str, ...] = ("doc_id", "para")) -> DataFrame:
    """(keys, text): paragraphs with non-overlapping fixes (keys, start_pos, end_pos, replacement) applied.

    A paragraph's fixes are folded from the right, so that positions to the left stay as they are. A fix that
    overlaps one applied before it, or reaches beyond the text, is left out.
    """
    fix = F.struct("start_pos", "end_pos", "replacement")
    sorted_fixes = F.reverse(F.array_sort(F.collect_list(fix)))
    grouped = fixes.where("start_pos is not null and end_pos is not null and replacement is not null").groupBy(*keys).agg(sorted_fixes.alias("_fixes"))

    def step(acc: Column, f: Column) -> Column:
        bad = (f["end_pos"] > acc["limit"]) | (f["start_pos"] < 0) | (f["start_pos"] > f["end_pos"])
        text = F.concat(F.substring(acc["text"], F.lit(1), f["start_pos"]), f["replacement"], F.substring(acc["text"], f["end_pos"] + 1, F.length(acc["text"])))
        return F.when(bad, acc).otherwise(F.struct(text.alias("text"), f["start_pos"].alias("limit")))

    zero = F.struct(F.col("text"), F.length("text").alias("limit"))
    joined = paragraphs.select(*keys, "text").join(grouped, list(keys), "left")
    return joined.select(*keys, F.when(F.col("_fixes").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.aggregate("_fixes", zero, step, lambda a: a["text"])).alias("text"))


def shifted(issues: DataFrame, fixes: DataFrame, keys: tuple[str, ...] = ("doc_id", "para")) -> DataFrame:
    """Open issues after fixes: moved by the length differences to their left, closed where a fix overlaps them.

    Issues and fixes meet in one array per paragraph, by an equality of keys only.
    """
    fix = F.struct("start_pos", "end_pos", (F.length("replacement") - (F.col("end_pos") - F.col("start_pos"))).alias("delta"))
    grouped = fixes.groupBy(*keys).agg(F.collect_list(fix).alias("_fixes"))
    joined = issues.join(grouped, list(keys), "left").withColumn("_fixes", F.coalesce("_fixes", F.array().cast("array<struct<start_pos:int,end_pos:int,delta:int>>")))
    before = F.filter("_fixes", lambda f: f["end_pos"] <= F.col("start_pos"))
    delta = F.aggregate(before, F.lit(0), lambda a, f: a + f["delta"])
    hit = F.exists("_fixes", lambda f: (f["start_pos"] < F.col("end_pos")) & (F.col("start_pos") < f["end_pos"]))
    moved = joined.withColumn("_delta", F.when(hit, 0).otherwise(delta)).withColumn("_hit", hit)
    status = F.when(F.col("_hit") & (F.col("status") == "open"), "closed").otherwise(F.col("status"))
    return moved.withColumn("status", status).withColumn("start_pos", F.col("start_pos") + F.col("_delta")).withColumn("end_pos", F.col("end_pos") + F.col("_delta")).drop("_fixes", "_delta", "_hit")


def split_runs(runs: DataFrame, cuts: DataFrame, keys: tuple[str, ...] = ("doc_id", "para")) -> DataFrame:
    """Runs cut at the given places (keys, at): each part keeps its run's other columns, with new offsets and text."""
    grouped = cuts.groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    joined = runs.join(grouped, list(keys), "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<int>")))
    inside = F.filter("_cuts", lambda c: (c > F.col("start_pos")) & (c < F.col("end_pos")))
    edges = F.concat(F.array("start_pos"), inside, F.array("end_pos"))
    parts = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda a, i: F.struct(a.alias("a"), F.get(edges, i + 1).alias("b")))
    exploded = joined.withColumn("_part", F.explode(parts))
    text = F.substring("text", F.col("_part.a") - F.col("start_pos") + 1, F.col("_part.b") - F.col("_part.a"))
    return exploded.withColumn("text", text).withColumn("start_pos", F.col("_part.a")).withColumn("end_pos", F.col("_part.b")).drop("_part", "_cuts")
