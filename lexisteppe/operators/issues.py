"""What happens to issues after they are found: filters, overlaps, order, counts, states."""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field as dataclass_field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ENGINE_PRIORITY, OTHER_PRIORITY


@dataclass
class Settings:
    """Which issues are wanted."""

    categories: dict[str, bool] = dataclass_field(default_factory=dict)
    disabled_rules: list[str] = dataclass_field(default_factory=list)
    sentence_words_limit: int = 60
    language: str = "auto"
    last_folder: str = ""


def priority(engine: Column) -> Column:
    """The rank of an engine; the lower wins where issues overlap."""
    out = F.lit(OTHER_PRIORITY)
    for name, rank in ENGINE_PRIORITY.items():
        out = F.when(engine == name, rank).otherwise(out)
    return out


def wanted(issues: DataFrame, settings: Settings) -> DataFrame:
    """Issues of categories that are on (unknown ones are) and of rules that are not disabled."""
    off = [c for c, on in settings.categories.items() if not on]
    out = issues.where(F.col("category").isNull() | ~F.col("category").isin(*off)) if off else issues
    return out.where(F.col("rule_id").isNull() | ~F.col("rule_id").isin(*settings.disabled_rules)) if settings.disabled_rules else out


def covered(text: Column, start: Column, end: Column, phrases: list[str]) -> Column:
    """Whether any occurrence of a phrase, in any case, covers the span; occurrences may overlap.

    An occurrence that covers [start, end) begins between end - length and start, so only that window is searched.
    """
    low = F.lower(text)
    out = F.lit(False)
    for phrase in phrases:
        n = len(phrase)
        begin = F.greatest(end - n, F.lit(0))
        window = F.substring(low, begin + 1, F.greatest(start - begin + n, F.lit(0)))
        out = out | ((end - start <= n) & window.contains(phrase))
    return out


def without_accepted(issues: DataFrame, user_words: DataFrame, phrases: list[str]) -> DataFrame:
    """Spelling issues dropped whose fragment is a user's word or lies within a user's phrase.

    ``issues`` has text (of the paragraph); ``user_words`` a column entry in lower case.
    """
    from ..runtime import sized_join

    fragment = F.lower(F.trim(F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))))
    marked = sized_join(issues.withColumn("_entry", fragment), user_words.select(F.col("entry").alias("_entry"), F.lit(True).alias("_known")).distinct(), ["_entry"], "left")
    keep = (F.col("category") != "spelling") | (F.col("_known").isNull() & ~covered(F.col("text"), F.col("start_pos"), F.col("end_pos"), phrases))
    return marked.where(F.coalesce(keep, F.lit(True))).drop("_entry", "_known")


def without_overlaps(issues: DataFrame, keys: tuple[str, ...] = ("doc_id", "para"), order: str = "seq") -> DataFrame:
    """One of overlapping issues of one category in one paragraph, folded in their order of arrival.

    The first kept issue that overlaps decides: a better engine takes its place, any other is dropped; a
    replacement is not compared again. The fold is over one paragraph's issues of one category, which is small.
    """
    kept = [c for c in issues.columns if c not in (*keys, "category")]
    row = F.struct(F.col(order).alias("_order"), F.struct(priority(F.col("engine")).alias("p"), F.struct(*kept).alias("row")).alias("x"))
    arrays = issues.groupBy(*keys, "category").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias("all"))
    overlap = lambda a, b: (a["row"]["start_pos"] < b["row"]["end_pos"]) & (b["row"]["start_pos"] < a["row"]["end_pos"])

    def step(acc: Column, x: Column) -> Column:
        hits = F.transform(acc, lambda o: overlap(o, x))
        at = F.array_position(hits, F.lit(True))
        swapped = F.transform(acc, lambda o, i: F.when((i + 1 == at) & (x["p"] < o["p"]), x).otherwise(o))
        return F.when(at > 0, swapped).otherwise(F.array_append(acc, x))

    folded = F.aggregate("all", F.slice("all", 1, 0), step)
    rows = arrays.select(*keys, "category", F.explode(folded).alias("x"))
    return rows.select(*keys, "category", "x.row.*").select(*issues.columns)


def in_order(issues: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Issues with their number in the document, by paragraph, span and engine."""
    w = Window.partitionBy(*keys).orderBy("para", "start_pos", "end_pos", priority(F.col("engine")), "seq")
    return issues.withColumn("number", F.row_number().over(w))


def counts(issues: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Totals for each document: all, errors, warnings, hints."""
    return issues.groupBy(*keys).agg(F.count("*").alias("issues"), *[F.count_if(F.col("level") == level).alias(f"{level}s") for level in ("error", "warning", "hint")])


def fragment(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


# States of a session: every change is a new table, nothing is altered in place.


def opened(issues: DataFrame) -> DataFrame:
    return in_order(issues).withColumn("status", F.lit("open"))


def skipped(states: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen (doc_id, number) become skipped."""
    marks = chosen.select("doc_id", "number").distinct().withColumn("_chosen", F.lit(True))
    return states.join(marks, ["doc_id", "number"], "left").withColumn("status", F.when(F.col("_chosen") & (F.col("status") == "open"), "skipped").otherwise(F.col("status"))).drop("_chosen")


def closed_by_word(states: DataFrame, words: DataFrame) -> DataFrame:
    """Open spelling issues whose fragment, in any case, was added to a dictionary become closed. ``words``: doc_id, entry."""
    marks = words.select("doc_id", F.lower("entry").alias("_entry")).distinct().withColumn("_chosen", F.lit(True))
    joined = states.withColumn("_entry", F.lower("fragment")).join(marks, ["doc_id", "_entry"], "left")
    close = F.col("_chosen") & (F.col("status") == "open") & (F.col("category") == "spelling")
    return joined.withColumn("status", F.when(close, "closed").otherwise(F.col("status"))).drop("_entry", "_chosen")


def closed_by_rule(states: DataFrame, rule_id: str) -> DataFrame:
    close = (F.col("rule_id") == rule_id) & (F.col("status") == "open")
    return states.withColumn("status", F.when(close, "closed").otherwise(F.col("status")))


def visible(states: DataFrame, settings: Settings) -> DataFrame:
    off = [c for c, on in settings.categories.items() if not on]
    open_ones = states.where(F.col("status") == "open")
    return open_ones.where(~F.col("category").isin(*off)) if off else open_ones
