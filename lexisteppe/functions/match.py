"""Regular-expression matches with code-point offsets, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_type(groups: int) -> str:
    return "array<struct<start:int,end:int,frag:string" + "".join(f",g{k}:string" for k in range(1, groups + 1)) + ">>"


def finditer(text: Column, pattern: str, groups: int = 0) -> Column:
    """Non-overlapping matches of a Java pattern as an array of (start, end, frag, g1, ...).

    The texts between matches (from ``split``) and the matches themselves give the offsets as running lengths, which
    count code points. The pattern must not match the empty string. Null texts give null, texts without a match an
    empty array after one quick search.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(groups + 1)])
    found = F.filter(parts, lambda x: x["1"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        one = F.struct(start.alias("start"), end.alias("end"), x["1"].alias("frag"), *[x[str(k + 1)].alias(f"g{k}") for k in range(1, groups + 1)])
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(match_type(groups)).alias("out"))
    folded = F.aggregate(found, zero, step, lambda acc: acc["out"])
    return F.when(text.isNull(), F.lit(None).cast(match_type(groups))).when(text.rlike(pattern), folded).otherwise(F.array().cast(match_type(groups)))


def expand(template: str, match: Column) -> Column:
    """A replacement template with ``\\1`` back-references, over one match."""
    parts: list[Column] = []
    literal = ""
    i = 0
    while i < len(template):
        if template[i] == "\\" and i + 1 < len(template) and template[i + 1].isdigit():
            if literal:
                parts.append(F.lit(literal))
                literal = ""
            k = template[i + 1]
            parts.append(match["frag"] if k == "0" else match[f"g{k}"])
            i += 2
        else:
            literal += template[i]
            i += 1
    if literal or not parts:
        parts.append(F.lit(literal))
    return F.concat(*parts)


def alternatives(words: list[str] | tuple[str, ...], quote: bool = True) -> str:
    """Words as one group of a pattern, the longest first."""
    import re

    return "(?:" + "|".join(sorted((re.escape(w) if quote else w for w in words), key=lambda w: (-len(w), w))) + ")"


Condition = Callable[[Column, Column], Column]
