"""An external checker behind an interface: batching, positions, mapping of answers."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORY_LEVELS, EXTERNAL_CATEGORIES
from ..runtime import ship_package, sized_join
from .names import title_case
from .spell import Words, accepted_words, unchecked

SEPARATOR = "\n\n"
#: A checker takes a text and gives matches: offset, length, message, rule, category, replacements.
Checker = Callable[[str], list[dict]]
SCHEMA = "start_pos int, end_pos int, category string, level string, rule_id string, engine string, message string, suggestions array<string>, pos int"


class Unavailable(Exception):
    """The checker gave no answer."""


def http_checker(url: str, language: str = "ru-RU", disabled: tuple[str, ...] = (), timeout: float = 120) -> Checker:
    """A checker that posts to a server's /v2/check."""

    def check(text: str) -> list[dict]:
        fields = {"language": language, "text": text} | ({"disabledRules": ",".join(disabled)} if disabled else {})
        try:
            request = urllib.request.Request(f"{url.rstrip('/')}/v2/check", data=urllib.parse.urlencode(fields).encode())
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                found = json.load(answer)["matches"]
            return [{"offset": m["offset"], "length": m["length"], "message": m.get("message", ""), "rule": m["rule"]["id"], "category": m["rule"]["category"]["id"], "replacements": [r["value"] for r in m.get("replacements", [])]} for m in found]
        except (OSError, ValueError, KeyError) as e:
            raise Unavailable(str(e)) from e

    return check


def packed(lengths: list[int], limit: int = 20_000, separator: int = len(SEPARATOR)) -> list[list[int]]:
    """Positions of texts in batches whose joined length stays within the limit; a longer text is alone."""
    out: list[list[int]] = []
    size = 0
    for i, n in enumerate(lengths):
        if out and out[-1] and size + separator + n <= limit:
            out[-1].append(i)
            size += separator + n
        else:
            out.append([i])
            size = n
    return out


def batch_numbers(paragraphs: DataFrame, limit: int = 20_000, keys: tuple[str, str] = ("doc_id", "para")) -> DataFrame:
    """(keys, batch): the packing of each document's paragraphs, as a fold over its array of lengths."""
    arrays = paragraphs.groupBy(keys[0]).agg(F.array_sort(F.collect_list(F.struct(F.col(keys[1]).alias("para"), F.length("text").alias("n")))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["out"]) > 0) & (acc["size"] + len(SEPARATOR) + x["n"] <= limit)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        size = F.when(fits, acc["size"] + len(SEPARATOR) + x["n"]).otherwise(x["n"])
        return F.struct(batch.alias("batch"), size.alias("size"), F.array_append(acc["out"], F.struct(x["para"].alias("para"), batch.alias("batch"))).alias("out"))

    zero = F.struct(F.lit(-1).alias("batch"), F.lit(0).alias("size"), F.array().cast(f"array<struct<para:{paragraphs.schema[keys[1]].dataType.simpleString()},batch:int>>").alias("out"))
    return arrays.select(keys[0], F.inline(F.aggregate("all", zero, step, lambda a: a["out"]))).select(keys[0], F.col("para").alias(keys[1]), "batch")


def external_issues(paragraphs: DataFrame, checker: Checker, limit: int = 20_000, keys: tuple[str, str] = ("doc_id", "para")) -> DataFrame:
    """Issues of an external checker, engine lt. Matches across paragraphs are dropped; a failed batch gives nothing."""
    types = {f.name: f.dataType.simpleString() for f in paragraphs.schema.fields}
    ship_package(paragraphs.sparkSession)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            out = []
            for batch in packed([len(t) for t in texts], limit):
                try:
                    found = checker(SEPARATOR.join(texts[i] for i in batch))
                except Unavailable:
                    continue
                base = 0
                for i in batch:
                    end = base + len(texts[i])
                    for pos, m in enumerate(found):
                        if base <= m["offset"] and m["offset"] + m["length"] <= end:
                            category = EXTERNAL_CATEGORIES.get(m["category"], "style")
                            start = m["offset"] - base
                            out.append((frame.iloc[i, 0], frame.iloc[i, 1], start, start + m["length"], category, CATEGORY_LEVELS[category], m["rule"], "lt", m["message"].strip(), m["replacements"][:5], pos))
                    base = end + len(SEPARATOR)
            yield pd.DataFrame(out, columns=[*keys, "start_pos", "end_pos", "category", "level", "rule_id", "engine", "message", "suggestions", "pos"])

    found = paragraphs.where(F.col("text").rlike(r"(?U)\S")).select(*keys, "text").mapInPandas(kernel, f"{keys[0]} {types[keys[0]]}, {keys[1]} {types[keys[1]]}, {SCHEMA}")
    return found.withColumn("seq", F.struct(F.lit(1).alias("stage"), F.lit(0).alias("rule"), F.col("pos").alias("pos"))).drop("pos")


def refined_spelling(issues: DataFrame, words: DataFrame, lists: Words, keys: tuple[str, str] = ("doc_id", "para")) -> DataFrame:
    """An external checker's spelling issues by our lists: accepted words dropped, capitalised ones inside a sentence a hint.

    ``words`` are the tokens of the checked paragraphs; a name that stands twice in its document is no issue.
    """
    lt = (F.col("engine") == "lt") & (F.col("category") == "spelling")
    counted = words.withColumn("_n", F.count("*").over(Window.partitionBy(keys[0], "word"))).select(*keys, "start_pos", "end_pos", "word", "starts", "_n")
    joined = issues.where(lt).join(counted, [*keys, "start_pos", "end_pos"], "left")
    marked = sized_join(joined, accepted_words(joined, lists), ["word"], "left").where(~F.coalesce(F.col("accepted") | unchecked(F.col("word")), F.lit(False)))
    name = F.coalesce(title_case(F.col("word")) & ~F.col("starts"), F.lit(False))
    kept = marked.where(~(name & (F.col("_n") >= 2)))
    changed = kept.withColumn("level", F.when(name, "hint").otherwise(F.col("level"))).withColumn("suggestions", F.when(name, F.array().cast("array<string>")).otherwise(F.col("suggestions")))
    return issues.where(~lt).unionByName(changed.select(issues.columns))
