"""Tokens and sentences of a paragraph as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ABBREVIATIONS_KK, ABBREVIATIONS_RU, LETTERS
from .match import alternatives

#: Number, word, white space, any other character: every character lies in exactly one token.
TOKEN = rf"(?U)\d+(?:[.,]\d+)*(?:-(?:\d+|[{LETTERS}]+))*|[{LETTERS}]+(?:[-'’][{LETTERS}]+)*|\s+|[^\s{LETTERS}\d]"
WORD = rf"(?U)(?:\d+(?:[.,]\d+)*(?:-(?:\d+|[{LETTERS}]+))*)|([{LETTERS}]+(?:[-'’][{LETTERS}]+)*)"
TOKEN_TYPE = "array<struct<start:int,end:int,text:string,kind:string>>"


ALL_LETTERS = "".join(chr(c) for a, b in re.findall("(.)-(.)", LETTERS) for c in range(ord(a), ord(b) + 1)) + re.sub(".-.", "", LETTERS)


def token_kind(piece: Column) -> Column:
    """By the first character; the common kinds need no regular expression."""
    first = F.substring(piece, 1, 1)
    rare = F.when(first.rlike(r"(?U)\d"), "number").when(first.rlike(r"(?U)\s"), "space").otherwise("punct")
    return F.when(F.lit(ALL_LETTERS).contains(first), "word").when(first == " ", "space").when(F.lit("0123456789").contains(first), "number").otherwise(rare)


def _starts(pieces: Column) -> Column:
    """Where each piece begins: running lengths. A fold over plain integers is far quicker than one over structs."""

    def step(acc: Column, piece: Column) -> Column:
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def tokens(text: Column) -> Column:
    """(start, end, text, kind) of every token; together they are the text again. Null gives null."""

    def build(pieces: Column) -> Column:
        return F.transform(
            F.arrays_zip(pieces.alias("text"), _starts(pieces).alias("start")),
            lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text"), token_kind(x["text"]).alias("kind")),
        )

    # One array in an array binds the pieces to a name, so that the pattern runs once.
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.get(F.transform(F.array(found), build), F.lit(0))


def words(text: Column) -> Column:
    """The word tokens' texts, without offsets: one pass of the pattern, numbers left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), lambda w: w != "")


def sentence_end(lang: str) -> str:
    """A pattern of what may end a sentence, with the closing signs behind it.

    Marks end a sentence at the text's end, or before white space and a capital, a digit, a quote or a bracket; a
    single full stop does not after an abbreviation or one capital letter. (Nor after a number that begins its line,
    which :func:`sentences` sees to, since a number may have any length.)
    """
    forms = alternatives([*ABBREVIATIONS_RU, *(ABBREVIATIONS_KK if lang == "kk" else [])])
    short = rf"(?<!(?<![{LETTERS}.])(?iu:{forms}))(?<!(?<![{LETTERS}.])\p{{Lu}})"
    begins = r"(?=\s+[\p{Lu}\d«\"(])"
    close = r"[»\")\]]*"
    return rf"(?U)(?<![.!?…])(?:[.!?…]+{close}(?=\s*\z)|[!?…][.!?…]*{close}{begins}|(?=\.){short}\.[.!?…]*{close}{begins})"


def sentences(text: Column, lang: str = "ru") -> Column:
    """(start, end) of the sentences, without white space around them. Null gives null, blank text none.

    The ends and the texts between them, found by one pattern, give the offsets as running lengths; nothing is
    written into the text.
    """
    pattern = sentence_end(lang)
    between = F.split(text, pattern, -1)
    ends = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(between.alias("text"), ends.alias("end"), F.slice(between, F.lit(2), F.size(between)).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        piece, first = F.concat(x["text"], F.coalesce(x["end"], F.lit(""))), acc["at"] == 0
        numbered = F.when(first, x["text"].rlike(r"(?U)(?:\A|\n)\s*\d+\z")).otherwise(x["text"].rlike(r"(?U)\n\s*\d+\z"))
        goes_on = F.coalesce(F.startswith(x["end"], F.lit(".")) & numbered & x["next"].rlike(r"(?U)\S"), F.lit(False))
        blank = ~piece.rlike(r"(?U)\S")
        begin = F.when(acc["begin"] >= 0, acc["begin"]).when(blank, F.lit(-1)).otherwise(acc["at"] + F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", "")))
        stop = F.when(blank, acc["stop"]).otherwise(acc["at"] + F.length(F.regexp_replace(piece, r"(?U)\s+\z", "")))
        whole = ~goes_on & (begin >= 0)
        out = F.when(whole, F.array_append(acc["out"], F.struct(begin.alias("start"), stop.alias("end")))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(whole, F.lit(-1)).otherwise(begin).alias("begin"), stop.alias("stop"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("begin"), F.lit(0).alias("stop"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def sentences_by_language(text: Column, lang: Column) -> Column:
    """Kazakh paragraphs by the Kazakh abbreviations too, Russian and mixed ones by the Russian."""
    return F.when(lang == "kk", sentences(text, "kk")).otherwise(sentences(text, "ru"))
