"""Sentence offsets for texts of several languages and scripts (problem 6).

A pushdown automaton hops over a line's special characters: opening quotes and brackets are pushed, closing ones
popped, terminators end a sentence only while the stack is empty. Tries of short forms, read backwards from a
full stop, say whether the stop belongs to a word that needs a follower, to one that may also end a sentence, or
to none.

Defined results: null texts, and texts without letters, give no sentences; a line of signs alone is one; offsets are code
points, half-open, without white space around; an opening sign that is not closed on its line opens nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map

# Short forms, written without their last full stop. A form with a space or a stop inside is listed
# whole. NEEDS: something of the same sentence follows. MAY_END: may stand at a sentence's end.
NEEDS = (
    "ст", "ст.ст", "п", "пп", "ч", "гл", "разд", "абз", "прил", "см", "ср", "ул", "д", "корп", "стр", "оф", "пр", "пер", "пл", "бул", "мкр",
    "обл", "пос", "дер", "рис", "табл", "им", "тел", "гр", "проф", "акад", "доц", "и.о", "в.о", "л. д", "л.д", "л", "т.е", "т.к", "т.н", "т.ч", "напр", "кв",
    "млн", "млрд", "трлн", "тыс", "б", "қ", "көш", "бап", "қар", "м.а", "ш", "к",
    "art", "arts", "no", "nos", "sec", "par", "p", "pp", "vol", "fig", "mr", "mrs", "ms", "dr", "prof", "st", "vs", "i.e", "e.g", "cf", "approx",
)
MAY_END = ("г", "гг", "ж", "жж", "в", "вв", "тг", "руб", "коп", "м", "кв. м", "ш. м", "км", "см", "мм", "кг", "т.д", "т.п", "т.б", "т.с.с", "др", "пр", "etc", "a.m", "p.m", "inc", "ltd", "co", "corp", "jr")


def _trie(forms: tuple[str, ...]) -> dict:
    root: dict = {}
    for form in forms:
        node = root
        for c in reversed(form):
            node = node.setdefault(c, {})
        node[""] = True
    return root


NEEDS_TRIE, MAY_END_TRIE = _trie(NEEDS), _trie(MAY_END)
PAIRS = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]", "「": "」", "『": "』", "《": "》", "（": "）", "【": "】", "‹": "›"}
CLOSERS = frozenset(PAIRS.values())
SPECIAL = regex.compile(r'[.!?…。！？؟۔।]+|[«»“”„"()\[\]「」『』《》（）【】‹›]')
LINE = regex.compile(r"[^\n\r  \x0b\x0c\x85]+")
LETTER = regex.compile(r"\p{L}")
WORDY = regex.compile(r"[\p{L}\p{N}]")
ITEM_NUMBER = regex.compile(r"\s*\(?\d{1,3}(?:\.\d{1,3})*$")
NEXT_ITEM = regex.compile(r"\d{1,3}\.\s*\p{Lu}")
INITIAL = regex.compile(r"(?<!\p{L})\p{Lu}$")
EASTERN_STOPS = frozenset("。！？۔।")


def _form(trie: dict, text: str, stop: int) -> bool:
    """Whether a form of the trie ends at a full stop, beginning after something that is no letter."""
    node, i, hit = trie, stop - 1, False
    while i >= 0:
        c = text[i].lower()
        node = node.get(c)
        if node is None:
            break
        if "" in node and (i == 0 or not text[i - 1].isalpha()):
            hit = True
        i -= 1
    return hit


def _signs(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the line's special signs: a terminator, an opening or a closing sign that has its partner."""
    found = [(m.start(), m.end()) for m in SPECIAL.finditer(line)]
    kinds, stack, straight = {}, [], None
    waiting: dict[str, int] = {}  # how many of each closing sign the stack waits for, so that one in vain costs nothing
    for s, _ in found:
        c = line[s]
        if c == '"':
            if straight is None:
                straight = s
            else:
                kinds[straight], kinds[s], straight = "open", "close", None
        elif stack and c == stack[-1][1]:
            kinds[stack.pop()[0]], kinds[s] = "open", "close"
            waiting[c] -= 1
        elif c in PAIRS:
            stack.append((s, PAIRS[c]))
            waiting[PAIRS[c]] = waiting.get(PAIRS[c], 0) + 1
        elif c in CLOSERS and waiting.get(c):
            while True:  # what lies above its partner has none
                at, closer = stack.pop()
                waiting[closer] -= 1
                if closer == c:
                    kinds[at], kinds[s] = "open", "close"
                    break
    return [(s, e, kinds.get(s, "") if e - s == 1 and line[s] in _BRACKETS else "stop") for s, e in found]


_BRACKETS = frozenset('«»“”„"()[]「」『』《》（）【】‹›')


def _ends(line: str, begin: int, s: int, e: int, after_close: bool) -> bool:
    """Whether the terminator at [s, e), with the signs that close behind it, ends the sentence that began at begin.

    ``after_close``: the terminator stood inside the quotation or brackets that close just behind it.
    """
    n = len(line)
    k = s
    while k < n and not line[k].isspace() and (line[k] in ".!?…。！？؟۔।" or line[k] in CLOSERS or line[k] == '"'):
        k += 1
    e = max(e, k)
    gap = 0
    while e + gap < n and line[e + gap].isspace():
        gap += 1
    if e + gap >= n:
        return True
    nxt = line[e + gap]
    if after_close:  # words that follow a quotation belong to its sentence
        return nxt.isupper() or nxt in "«“„\"" and gap > 0 or nxt.isdigit() and gap > 0
    sign = line[s]
    if sign in EASTERN_STOPS:
        return nxt not in "，、；：,;:)）"
    if nxt in ",;:)]»”–—-/%，、；：":
        return False
    if sign in "!?؟" or (sign == "." and s + 1 < n and line[s + 1] in "!?"):
        return True
    if sign == "…" or line[s : s + 2] == "..":
        return gap > 1 or nxt.isupper() or nxt.isdigit() or nxt in "«“„\"(" or not nxt.isalpha() or not nxt.islower()
    # a single full stop
    before = line[s - 1] if s else ""
    if s - begin <= 24 and ITEM_NUMBER.match(line[begin:s]):
        return False  # a leading item number, or a number still without its words
    if gap == 0:
        if before.isdigit() and (nxt.isdigit() or nxt.isalpha() and nxt.islower()):
            return False
        if nxt.isalpha() and nxt.islower() or nxt.isdigit() and before.isascii() and before.isalpha():
            return False  # web names, т.д. and the like
    if before.isalpha():
        last = INITIAL.search(line, 0, s)
        if last:
            if not nxt.isupper():
                return gap > 1 and nxt.islower()
            return False  # an initial before a name or another initial
        if _form(MAY_END_TRIE, line, s):
            if gap > 1:
                return True
            if nxt.isdigit():
                return bool(NEXT_ITEM.match(line, e + gap))
            counted = not _form(_CITY, line, s) or _after_number(line, s)
            return counted and (nxt.isupper() or nxt in "«“„\"")
        if _form(NEEDS_TRIE, line, s):
            return False
    return True


_CITY = _trie(("г",))


def _after_number(line: str, s: int) -> bool:
    i = s - 1
    while i >= 0 and line[i].isalpha():
        i -= 1
    while i >= 0 and line[i].isspace():
        i -= 1
    return i >= 0 and line[i].isdigit()


def line_sentences(line: str) -> Iterator[tuple[int, int]]:
    """Offsets of the sentences of one line, with white space around still in them."""
    signs = _signs(line)
    depth = begin = 0
    stop_inside: int | None = None
    for s, e, kind in signs:
        if s < begin:
            continue
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
            closes = stop_inside is not None and line[s] not in ")]）】" and not line[stop_inside:s].strip()
            if depth == 0 and closes and _ends(line, begin, s, e, True):
                yield begin, e
                begin = e
            if depth == 0:
                stop_inside = None
        elif kind == "stop":
            if depth:
                stop_inside = e
            elif _ends(line, begin, s, e, False):
                end = e
                while end < len(line) and line[end] in CLOSERS:
                    end += 1
                yield begin, end
                begin = end
    if begin < len(line):
        yield begin, len(line)


def sentence_offsets(text: str | None) -> list[tuple[int, int]]:
    """Offsets of all sentences of a text. Signs without a word join the sentence before them, or the next."""
    out: list[tuple[int, int]] = []
    for m in LINE.finditer(text or ""):
        line, base, mine = m.group(), m.start(), []
        for s, e in line_sentences(line):
            while s < e and line[s].isspace():
                s += 1
            while s < e and line[e - 1].isspace():
                e -= 1
            if s >= e:
                continue
            if mine and not WORDY.search(line, s, e):
                mine[-1][1] = e
            elif mine and not WORDY.search(line, mine[-1][0], mine[-1][1]):
                mine[-1][1] = e
            else:
                mine.append([s, e])
        out += [(base + s, base + e) for s, e in mine]
    return out


def split_sentences(paragraphs: DataFrame, id_column: str = "para_id", text_column: str = "text") -> DataFrame:
    """(id, start_pos, end_pos): the sentences of every text with words, in one pass without a shuffle.

    A repeated input row repeats its sentences; see :func:`distinct_texts`.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and LETTER.search(text):
                    for s, e in sentence_offsets(text):
                        ids.append(i)
                        starts.append(s)
                        ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_column, "start_pos", "end_pos"])

    kind = paragraphs.schema[id_column].dataType.simpleString()
    return arrow_map(paragraphs.select(id_column, text_column), kernel, f"{id_column} {kind}, start_pos int, end_pos int")


def distinct_sentences(paragraphs: DataFrame, id_column: str = "para_id", text_column: str = "text") -> DataFrame:
    """(id, start_pos, end_pos): the sentences of every id once, though its row may be repeated.

    Repeated rows are dropped behind the automaton, by the offsets and a hash of the text, so that no text is
    shuffled. Of different texts of one id the one with the lowest hash counts.
    """
    kind = paragraphs.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start_pos": s, "end_pos": e} for s, e in sentence_offsets(t)] if t and LETTER.search(t) else [] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span)], names=[id_column, "h", "spans"])

    rows = paragraphs.select(id_column, F.xxhash64(text_column).alias("h"), text_column).where(F.col(text_column).isNotNull())
    found = arrow_map(rows, kernel, f"{id_column} {kind}, h bigint, spans array<struct<start_pos:int,end_pos:int>>")
    return found.groupBy(id_column).agg(F.min(F.struct("h", "spans")).alias("x")).select(id_column, F.inline("x.spans"))


def distinct_texts(paragraphs: DataFrame, id_column: str = "para_id", text_column: str = "text") -> DataFrame:
    """One row for each id: repeated rows once; of several texts of one id the smallest."""
    return paragraphs.groupBy(id_column).agg(F.min(text_column).alias(text_column))
