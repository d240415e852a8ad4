"""Texts for readers: one document's report, JSON, comments, the noise report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORY_TITLES, LEVEL_TITLES


def _titled(column: Column, titles: dict[str, str]) -> Column:
    out = column
    for key, title in titles.items():
        out = F.when(column == key, title).otherwise(out)
    return out


def report_line() -> Column:
    """One issue as a line: paragraph from 1, category, level, fragment, suggestions, message."""
    arrow = F.when(F.size("suggestions") > 0, F.concat(F.lit(" → "), F.array_join("suggestions", ", "))).otherwise("")
    quoted = F.concat(F.lit("«"), F.coalesce("fragment", F.lit("")), F.lit("»"), arrow)
    return F.concat_ws(" | ", F.concat(F.lit("абзац "), (F.col("para") + 1).cast("string")), _titled(F.col("category"), CATEGORY_TITLES), _titled(F.col("level"), LEVEL_TITLES), quoted, "message")


def summary_line(name: Column) -> Column:
    return F.format_string("%s: %d замечаний (ошибок %d, предупреждений %d, подсказок %d)", name, F.col("issues"), F.col("errors"), F.col("warnings"), F.col("hints"))


def document_reports(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, report): a document's summary and its issues in order, one line each."""
    lines = issues.select(key, "level", F.struct("number", report_line().alias("line")).alias("x"))
    grouped = lines.groupBy(key).agg(
        F.count("*").alias("issues"), *[F.count_if(F.col("level") == level).alias(f"{level}s") for level in ("error", "warning", "hint")],
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("_lines"),
    )
    return grouped.select(key, F.concat_ws("\n", summary_line(F.col(key).cast("string")), F.lit(""), "_lines").alias("report"))


def as_json(issues: DataFrame) -> DataFrame:
    """(value): every issue as a JSON object, for ``write.text``."""
    return issues.select(F.to_json(F.struct(*[c for c in issues.columns if c != "seq"])).alias("value"))


def comments(issues: DataFrame) -> DataFrame:
    """(doc_id, para, start_pos, end_pos, comment) of issues outside headers and footers, for annotated copies."""
    arrow = F.when(F.size("suggestions") > 0, F.concat(F.lit(" → "), F.array_join(F.slice("suggestions", 1, 2), ", "))).otherwise("")
    shown = issues.where(~F.col("where_in").isin("header", "footer")) if "where_in" in issues.columns else issues
    return shown.select("doc_id", "para", "start_pos", "end_pos", F.concat(_titled(F.col("category"), CATEGORY_TITLES), F.lit(": "), "message", arrow).alias("comment"))


def noise_markdown(report: DataFrame, files: int) -> DataFrame:
    """(line): the noise report as lines of a Markdown table, the rules with most issues first."""
    head = report.sparkSession.createDataFrame([(0, 0, "| Правило | Замечаний | Актов | Примеры |"), (1, 0, "|---|---|---|---|")], "part int, minus bigint, line string")
    flag = F.when(F.col("flagged"), " ⚠").otherwise("")
    share = F.format_string("%d/%d (%.0f %%)", F.col("docs"), F.lit(files), F.col("share") * 100)
    row = F.concat(F.lit("| "), "rule", F.lit(" | "), F.col("issues").cast("string"), F.lit(" | "), share, flag, F.lit(" | "), F.replace("examples", F.lit("|"), F.lit("¦")), F.lit(" |"))
    body = report.select(F.lit(2).alias("part"), (-F.col("issues")).alias("minus"), row.alias("line"))
    return head.unionByName(body).orderBy("part", "minus", "line").select("line")


def output_path(original: str, folder: str | None = None, suffix: str = "_проверено") -> Path:
    """Where a checked copy goes: beside the original or in a folder, numbered if the name is taken."""
    path = Path(original)
    base = Path(folder) if folder else path.parent
    out, n = base / f"{path.stem}{suffix}{path.suffix}", 2
    while out.exists():
        out, n = base / f"{path.stem}{suffix} ({n}){path.suffix}", n + 1
    return out
