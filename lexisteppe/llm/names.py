"""Variant spellings of registered persons and organisations (problem 5).

Rewriting rules on both sides: every registered name is exploded into all its canonical rewritings (nicknames,
initials, left-out parts, order of parts, legal forms, transliteration, abbreviation), every mention is rewritten
the same way, and the two meet by an equi-join. The score of a rewriting is its rarity, 1 / (number of entities that
have it) over the whole registry; a link is sure at 1. Slips of typing are met the same way, word by word: the
distinct capitalised words of all texts and the words of all registered names are exploded into deletion keys and
joined, and the unique nearest registered word stands for the typed one.

Defined results: null and empty texts have no mentions; a mention spelled as registered gives no row; each
(table row, entity) is given once; repeated rows of a table count once; an empty registry links nothing; a rewriting
of several entities gives the smallest of them with its score, and :func:`rewritings_of` holds them all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, checkpointed, is_small, sized_join, spread
from .canonical import FORMS, IGNORABLE, SPACES, mapped

# Short names of persons, and the legal forms of organisations with what they stand for.
NICKNAMES = {
    "александр": "саша шура саня", "алексей": "лёша алёша", "болат": "боря болик боке", "владимир": "вова володя", "георгий": "гоша жора гога",
    "дмитрий": "дима митя", "ерлан": "ерик ереке", "иван": "ваня", "марат": "марик маке", "михаил": "миша", "николай": "коля",
    "нұрлан": "нұрик нуреке нурик", "павел": "паша", "серік": "сека серике", "тимур": "тима тимка", "өмірбек": "өмеш омеке омеш",
    "андрей": "андрюша", "сергей": "серёжа", "пётр": "петя", "юрий": "юра", "евгений": "женя", "виктор": "витя", "константин": "костя",
    "анна": "аня", "мария": "маша", "ольга": "оля", "светлана": "света", "екатерина": "катя", "елена": "лена", "наталья": "наташа", "татьяна": "таня",
}
LEGAL_FORMS = (
    "товарищество с ограниченной ответственностью", "жауапкершілігі шектеулі серіктестігі", "жауапкершілігі шектеулі серіктестік", "акционерное общество",
    "акционерлік қоғамы", "акционерлік қоғам", "тоо", "жшс", "ао", "ақ", "ооо", "пао", "зао", "llp", "jsc", "llc", "ltd",
)
FOLDED = str.maketrans("әғқңөұүһіё", "агкноуухие")
LATIN = {
    "а": "a", "ә": "a", "б": "b", "в": "v", "г": "g", "ғ": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "қ": "q", "л": "l",
    "м": "m", "н": "n", "ң": "ng", "о": "o", "ө": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ұ": "u", "ү": "u", "ф": "f", "х": "kh", "һ": "h", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "і": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
PATRONYMIC = regex.compile(r"^(.{3,}?)(?:ович|евич|овна|евна|ұлы|улы|қызы|кызы)$")
WORDS = regex.compile(r"\p{L}+")
PARTS = regex.compile(r"\p{Lu}?[^\P{L}\p{Lu}]+|\p{Lu}+(?!\p{Ll})")
NAME_GAP = regex.compile(r"[ \t ]*(?:[.,] ?[ \t ]*)?")
QUOTES = tuple("«»\"“”„")
FORM_BEFORE = regex.compile(rf"(?i)(?<!\p{{L}})(?:{'|'.join(LEGAL_FORMS)})[ \t]*$")
FORM_AFTER = regex.compile(rf"(?i)[ \t]*,?[ \t]*(?:{'|'.join(LEGAL_FORMS)})(?!\p{{L}})")
FIRM_GAP = regex.compile(r"[ \t\-]{1,3}")
CAPITAL = regex.compile(r"[\p{Lu}\p{Lt}\p{Lo}]\p{L}*")
#: What changes a text whatever stands beside it, marks that compose, and whatever lies beyond the first plane.
COMPOSING = {chr(int(d[1], 16)) for d in map(str.split, map(unicodedata.decomposition, map(chr, range(0x10000)))) if len(d) == 2 and d[0][0] != "<"}
ODD = re.compile(f"[{re.escape(''.join(sorted(c for c in {*IGNORABLE, *FORMS, *COMPOSING} if c < chr(0x10000))))}{SPACES}]")
FAR = re.compile("[\U00010000-\U0010ffff]")


def odd(text: str) -> bool:
    return bool(ODD.search(text) or FAR.search(text))


#: What a word may be, with the slips allowed in a listed word: (most, from this many letters on, one slip from this many on).
ROLES = {"surname": (2, 7, 3), "given": (1, 5, 5), "root": (1, 5, 5), "firm": (1, 4, 4), "initials": (0, 1, 1)}


def allowed(role: str, word: str) -> int:
    most, long, short = ROLES[role]
    return most if len(word) >= long else int(most > 0 and len(word) >= short)


def fold(word: str) -> str:
    """Lower case, Kazakh letters as the Russian ones that people type for them."""
    return word.lower().translate(FOLDED)


def latin(word: str) -> str:
    return "".join(LATIN.get(c, c) for c in word.lower())


def deletions(word: str, n: int) -> set[str]:
    """The word and what is left of it without up to n letters."""
    out = level = {word}
    for _ in range(n):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def slips(a: str, b: str) -> int:
    """Distance by insertions, deletions, replacements and swaps of neighbours."""
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, prev = prev, row
    return prev[-1]


def root(patronymic: str) -> str:
    m = PATRONYMIC.match(patronymic)
    return fold(m.group(1)).rstrip("ь") if m else fold(patronymic)


def rewritings(kind: str, name: str) -> set[str]:
    """All canonical rewritings of a registered name."""
    words = WORDS.findall(name)
    out: set[str] = set()
    if kind == "person" and len(words) >= 2:
        s, g, p = fold(words[0]), fold(words[1]), root(words[2]) if len(words) > 2 else ""
        out = {f"person {s} {a} {b}" for a in (g, g[0]) for b in (p, p[:1], "")}
        out |= {f"person {s} {latin(words[1])[0]} {b}" for b in (latin(words[2])[0] if p else "", "")}
    elif kind != "person":
        folded = [fold(w) for w in words if w.lower() not in LEGAL_FORMS]
        out = {" ".join(["firm", *sorted(folded)])}
        if len(folded) > 1:
            out.add("initials " + "".join(w[0] for w in folded))
    return out


def listed_words(kind: str, name: str) -> set[tuple[str, str, str, str]]:
    """(role, script, word, canonical word) of a registered name's words in all forms that a text may use.

    Forms of the script "latin" and initials are met whole, others with slips.
    """
    words = WORDS.findall(name)
    out: set[tuple[str, str, str, str]] = set()
    if kind == "person" and len(words) >= 2:
        s, g = fold(words[0]), fold(words[1])
        out = {("surname", "own", s, s), ("surname", "latin", latin(words[0]), s)}
        out |= {("given", "own", w, g) for w in (g, latin(words[1]), *map(fold, NICKNAMES.get(words[1].lower(), "").split()))}
        if len(words) > 2:
            p = root(words[2])
            out |= {("root", "own", p, p), ("root", "latin", latin(words[2]), p)}
    elif kind != "person":
        core = [w for w in words if w.lower() not in LEGAL_FORMS]
        out = {x for w in core for x in (("firm", "own", fold(w), fold(w)), ("firm", "latin", latin(w), fold(w)))}
        if len(core) > 1:
            initials = "".join(fold(w)[0] for w in core)
            out.add(("initials", "own", initials, initials))
    return {x for x in out if x[2]}


def typed_forms(word: str) -> Iterator[tuple[str, str, int, str, int]]:
    """(role, script, order, form, slips allowed) under which a typed word in small letters is looked up; the first order with one nearest word counts."""
    f = fold(word)
    for role, (most, _, _) in ROLES.items():
        if role in ("surname", "root", "firm"):
            yield role, "latin", 0, word, 0
        yield role, "own", 1, root(word) if role == "root" else f, most
    if f[-1:] in ("а", "у", "е") and len(f) > 1:
        yield "surname", "own", 2, f[:-1], 0
    if word != f:
        yield "given", "own", 2, word, 0


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held.clear()
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def _entities(registry: DataFrame) -> DataFrame:
    return registry.select("entity_id", "kind", "name").where("name is not null and entity_id is not null").distinct()


def rewritings_of(registry: DataFrame) -> DataFrame:
    """(form, entity_id, name): the names of a registry, exploded into all their rewritings."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("form", pa.string()), ("entity_id", pa.int64()), ("name", pa.string())]
        for b in batches:
            yield _batch([(form, i, name) for i, kind, name in zip(*(c.to_pylist() for c in b.columns), strict=True) for form in sorted(rewritings(kind, name))], schema)

    entities = _entities(registry).withColumn("entity_id", F.col("entity_id").cast("bigint"))
    return arrow_map(entities, kernel, "form string, entity_id bigint, name string")


def _listed_keys(registry: DataFrame) -> DataFrame:
    """(role, script, listed, canonical, most, key): the words of registered names by their deletion keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [(n, pa.string()) for n in ("role", "script", "listed", "canonical")] + [("most", pa.int32()), ("key", pa.string())]
        for b in batches:
            words = {x for kind, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for x in listed_words(kind, name)}
            rows = ((role, script, w, c, n, key) for role, script, w, c in words for n in (allowed(role, w) if script == "own" else 0,) for key in deletions(w, n))
            yield from _batches(rows, schema)

    return arrow_map(_entities(registry), kernel, "role string, script string, listed string, canonical string, most int, key string").distinct()


def capitalised(text: str) -> set[str]:
    """The distinct whole words that hold a capital, or a letter of a script without small ones."""
    out = set()
    for m in CAPITAL.finditer(text):
        s = m.start()
        while s and text[s - 1].isalpha():
            s -= 1
        out.add(m.group() if s == m.start() else text[s : m.end()])
    return out


def plain(line: str) -> str:
    """A line in one form of characters, white space kept."""
    return " ".join(mapped(t) for t in line.split(" "))


def typed_words(texts: DataFrame, column: str) -> DataFrame:
    """(word): the distinct words with capitals of all texts, in small letters; repeats are removed within each task first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        sent: set[str] = set()
        for b in batches:
            found: set[str] = set()
            for text in b.column(0).to_pylist():
                if text:
                    found |= capitalised(text)
                    if odd(text):
                        for line in text.split("\n"):
                            if odd(line):
                                found |= capitalised(plain(line))
            new = found - seen
            seen |= new
            forms = {x for w in new for x in _keys_of(w)} - sent
            sent |= forms
            yield pa.RecordBatch.from_arrays([pa.array(sorted(forms), pa.string())], names=["word"])
            if len(seen) > 2_000_000:  # memory only: the same words may be sent again
                seen.clear()
                sent.clear()

    return spread(arrow_map(texts.select(column), kernel, "word string"), "word").distinct()


def _keys_of(word: str) -> set[str]:
    """A word in small letters, and its parts between capitals, also in one alphabet where it mixes two."""
    out = {word.lower(), *(p.lower() for p in PARTS.findall(word))}
    plain = mapped(word)
    return out if plain == word else out | {plain.lower(), *(p.lower() for p in PARTS.findall(plain))}


def meant_words(words: DataFrame, registry: DataFrame) -> DataFrame:
    """(word, role, canonical, missed): the registered word that a typed one stands for in each role, and its slips.

    Typed and registered words are joined by equal deletion keys; of the orders of :func:`typed_forms` the first
    with a single nearest word counts.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [(n, pa.string()) for n in ("word", "role", "script", "form")] + [("order", pa.int32()), ("slips", pa.int32()), ("key", pa.string())]
        for b in batches:
            rows = ((w, role, script, form, order, n, key) for w in b.column(0).to_pylist() for role, script, order, form, n in typed_forms(w) for key in deletions(form, n))
            yield from _batches(rows, schema)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, listed = b.column(b.schema.get_field_index("form")).to_pylist(), b.column(b.schema.get_field_index("listed")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([slips(x, y) for x, y in zip(forms, listed, strict=True)], pa.int32())], names=[*b.schema.names, "missed"])

    exploded = arrow_map(words, keys, "word string, role string, script string, form string, order int, slips int, key string")
    met = sized_join(exploded, _listed_keys(registry), ["role", "script", "key"])
    pairs = met.groupBy("word", "role", "order", "form", "listed").agg(F.min("canonical").alias("canonical"), F.min(F.least("slips", "most")).alias("most"))
    near = arrow_map(pairs, measured, "word string, role string, order int, form string, listed string, canonical string, most int, missed int").where("missed <= most")
    equal = near.groupBy("word", "role", "order", "missed").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"))
    nearest = equal.groupBy("word", "role", "order").agg(F.min_by(F.struct("n", "canonical", "missed"), "missed").alias("x")).where("x.n = 1")
    return nearest.groupBy("word", "role").agg(F.min_by("x", "order").alias("x")).select("word", "role", "x.canonical", "x.missed")


class Line:
    """One line and what its words stand for: the rewritings of all mentions in it."""

    def __init__(self, line: str, known: dict[tuple[str, str], tuple[str, int]], longest: int) -> None:
        self.line, self.known, self.longest = line, known, longest

    def _role(self, role: str, word: str) -> tuple[str, int] | None:
        return self.known.get((role, word.lower()))

    def mentions(self) -> Iterator[tuple[int, int, str, int, int]]:
        """(mention, rank, form, start, end): of one mention's forms that are registered the lowest rank counts."""
        yield from self._persons()
        yield from self._firms()

    def _persons(self) -> Iterator[tuple[int, int, str, int, int]]:
        words = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(self.line)]
        for k, (start, end, word) in enumerate(words):
            if word.islower() or not (hit := self._role("surname", word)):
                continue
            s, missed = hit
            full = len(word) < 2 or len(s) < 5 and missed  # what so short a surname needs beside it is a full given name
            sides = [x for x in (self._parts(words, k, 1), self._parts(words, k, -1)) if x]
            for rank, parts in enumerate(sorted(sides, key=len, reverse=True)):
                form = None if full and len(parts[0][2]) < 2 else self._person(s, missed, parts)
                if form is not None:
                    yield 2 * start, rank, form, min(start, parts[0][0], parts[-1][0]), max(end, parts[0][1], parts[-1][1])

    def _parts(self, words: list, k: int, step: int) -> list:
        """Up to two names or initials directly after (or before) word k, in reading order."""
        line = self.line
        out: list = []
        j = k + step
        while 0 <= j < len(words) and len(out) < 2:
            a, b = (words[j - 1][1], words[j][0]) if step > 0 else (words[j][1], words[j + 1][0])
            if not NAME_GAP.fullmatch(line, a, b) or words[j][2][0].islower():
                break
            word = words[j][2]
            if "." in line[a:b] and len(words[j - 1 if step > 0 else j][2]) > 1 or "," in line[a:b] and not (step > 0 and j == k + 1 and len(word) > 1):
                break
            if len(word) > 1 and not (self._role("given", word) or self._role("root", word) or PATRONYMIC.match(word.lower())):
                break
            out.append(words[j])
            j += step
        return out if step > 0 else out[::-1]

    def _person(self, s: str, missed: int, parts: list) -> str | None:
        first = parts[0][2].lower()
        if len(first) == 1:
            if missed > 1:
                return None
            g = fold(first)
        else:
            given = self._role("given", first)
            if given is None:
                return None
            g = given[0]
        p = ""
        if len(parts) > 1:
            second = parts[1][2].lower()
            if len(second) == 1:
                p = fold(second)
            else:
                hit = self._role("root", second)
                p = hit[0] if hit else root(second)
        return f"person {s} {g} {p}"

    def _firms(self) -> Iterator[tuple[int, int, str, int, int]]:
        line = self.line
        words = []
        for m in WORDS.finditer(line):
            parts = list(PARTS.finditer(m.group())) if any(c.isupper() for c in m.group()[1:]) and not m.group().isupper() else []
            words += [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in parts] or [(m.start(), m.end(), m.group())]
        canon = [None if w[2].islower() else self._role("firm", w[2]) for w in words]
        k = 0
        while k < len(words):
            if canon[k]:
                n = 1
                while k + n < len(words) and canon[k + n] and (words[k + n - 1][1] == words[k + n][0] or FIRM_GAP.fullmatch(line, words[k + n - 1][1], words[k + n][0])):
                    n += 1
                for rank, size in enumerate(range(min(n, self.longest), 0, -1)):
                    if self._alone(words, k, k + size) and (size > 1 or self._marked(words, k)):
                        form = " ".join(["firm", *sorted(c[0] for c in canon[k : k + size])])
                        yield 2 * words[k][0] + 1, rank, form, *self._whole(words[k][0], words[k + size - 1][1])
                k += n
            else:
                a, b, word = words[k]
                if word.isupper() and self._role("initials", word) and line[max(0, a - 1) : a] in QUOTES and line[b : b + 1] in QUOTES and k and words[k - 1][2].lower() in LEGAL_FORMS:
                    yield 2 * a + 1, 0, f"initials {fold(word)}", a, b
                k += 1

    def _alone(self, words: list, k: int, end: int) -> bool:
        """Whether no further capitalised word belongs to the same quoted or unquoted name."""
        line = self.line
        for i, a, b in ((k - 1, words[k - 1][1] if k else 0, words[k][0]), (end, words[end - 1][1], words[end][0] if end < len(words) else 0)):
            if 0 <= i < len(words) and words[i][2][0].isupper() and regex.fullmatch(r"[ \-]+", line[a:b]) and words[i][2].lower() not in LEGAL_FORMS:
                return i < k and not _inside_quotes(line, a)
        return True

    def _marked(self, words: list, k: int) -> bool:
        """Whether one word stands in quotes of its own or directly beside a legal form."""
        line = self.line
        start, end = words[k][:2]
        if line[start - 1 : start] in QUOTES and line[end : end + 1] in QUOTES and start:
            return True
        after = words[k + 1] if k + 1 < len(words) else None
        if after and after[2][0].isupper() and after[2].lower() not in LEGAL_FORMS and regex.fullmatch(r"[ \-]*", line[end : after[0]]):
            return False  # the first word of a longer name
        return bool(FORM_BEFORE.search(line[max(0, start - 80) : start]) or FORM_AFTER.match(line, end))

    def _whole(self, start: int, end: int) -> tuple[int, int]:
        """A name's span with the quotes around it and the legal form before or after."""
        line = self.line
        a, b = start, end
        if a and line[a - 1] in "«\"“„":
            a -= 1
        if b < len(line) and line[b] in "»\"”“":
            b += 1
        before = line[max(0, a - 80) : a]
        cut = a - len(before)
        before = before.rstrip()
        for form in LEGAL_FORMS:
            if before.lower().endswith(form) and not before[: -len(form)][-1:].isalpha():
                return cut + len(before) - len(form), b
        after = line[b : b + 80]
        for form in LEGAL_FORMS:
            if after.lstrip().lower().startswith(form):
                return a, b + len(after) - len(after.lstrip()) + len(form)
        return a, b


def _inside_quotes(line: str, at: int) -> bool:
    return line.count("«", max(0, at - 300), at) > line.count("»", max(0, at - 300), at) or line.count('"', max(0, at - 300), at) % 2 == 1


def _lines(texts: DataFrame, keys: list[str], column: str, types: str) -> DataFrame:
    """(keys, line_no, line, raw, words): lines with capitals in plain characters, as they are where that differs, and their typed words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, tuple[set[str], bool]] = {}
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                if not text:
                    continue
                anywhere = odd(text)
                for n, raw in enumerate(text.split("\n")):
                    capital, hidden = capitalised(raw), anywhere and odd(raw)
                    if not capital and not hidden:
                        continue
                    if len(forms) > 1_000_000:
                        forms.clear()
                    words: set[str] = set()
                    mixed = False
                    for w in capital:
                        own = forms.get(w)
                        if own is None:
                            own = forms[w] = (_keys_of(w), mapped(w) != w)
                        words |= own[0]
                        mixed = mixed or own[1]
                    line = raw
                    if mixed or hidden:
                        line = plain(raw)
                        if line != raw:
                            words.update(x for w in capitalised(line) for x in _keys_of(w))
                    at.append(i)
                    out.append((n, line, raw if line != raw else None, list(words)))
            picked = [b.column(j).take(pa.array(at, pa.int32())) for j in range(len(keys))]
            rest = _batch(out, [("line_no", pa.int32()), ("line", pa.string()), ("raw", pa.string()), ("words", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*picked, *rest.columns], names=[*keys, *rest.schema.names])

    return arrow_map(texts.select(*keys, column), kernel, f"{types}, line_no int, line string, raw string, words array<string>")


def links(texts: DataFrame, registry: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, entity_id, score): registered entities named in another spelling, with the rarity of the best rewriting.

    Below a score of 1 the entity is the smallest of those that share the rewriting. Texts are read twice, for their
    distinct words and for the lines that hold a registered one; only those lines' few words meet in a shuffle.
    Every table that is broadcast is measured first, beyond its bound the same join is salted.
    """
    types = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    texts = spread(texts.select(*keys, column))
    forms = checkpointed(rewritings_of(registry))
    longest = forms.where("startswith(form, 'firm ')").agg(F.max(F.size(F.split("form", " ")) - 1)).first()[0] or 0
    meant = checkpointed(meant_words(typed_words(texts, column), registry))
    lines = _lines(texts, keys, column, types)
    row = [*keys, "line_no"]
    mark = F.struct("word", "role", "canonical", "missed")
    if is_small(meant):
        # A line goes on with each of its registered words, so that it is not looked up again.
        met = lines.select(*row, "line", "raw", F.explode("words").alias("word")).join(F.broadcast(meant), "word")
        held = met.groupBy(*row).agg(F.first("line").alias("line"), F.first("raw").alias("raw"), F.collect_set(mark).alias("known"))
    else:
        met = sized_join(lines.select(*row, F.explode("words").alias("word")), meant, ["word"]).groupBy(*row).agg(F.collect_set(mark).alias("known"))
        held = lines.drop("words").join(met, row)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, (line, raw, known) in enumerate(zip(*(b.column(n).to_pylist() for n in ("line", "raw", "known")), strict=True)):
                for mention, rank, form, start, end in Line(line, {(x["role"], x["word"]): (x["canonical"], x["missed"]) for x in known}, longest).mentions():
                    shown = line[start:end]
                    at.append(i)
                    out.append((mention, rank, form, shown, raw is None or shown in raw))
            picked = [b.column(n).take(pa.array(at, pa.int32())) for n in row]
            rest = _batch(out, [("mention", pa.int32()), ("rank", pa.int32()), ("form", pa.string()), ("shown", pa.string()), ("exact", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*picked, *rest.columns], names=[*row, *rest.schema.names])

    mentions = arrow_map(held, kernel, f"{types}, line_no int, mention int, rank int, form string, shown string, exact boolean")
    shared = forms.groupBy("form").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("entities"))
    linked = sized_join(mentions, shared, ["form"])
    best = linked.groupBy(*row, "mention").agg(F.min_by(F.struct("form", "shown", "exact", "entity_id", "entities"), F.struct(F.col("entities") > 1, "rank")).alias("x")).select(*keys, "x.*")
    # Not a variant: the shown text is the registered name of an entity with this rewriting.
    registered = forms.select("form", F.col("name").alias("shown"), F.lit(True).alias("exact"), F.lit(True).alias("_registered")).distinct()
    other = sized_join(best, registered, ["form", "shown", "exact"], "left").where(F.col("_registered").isNull())
    kind = registry.schema["entity_id"].dataType.simpleString()
    return other.groupBy(*keys, F.col("entity_id").cast(kind).alias("entity_id")).agg(F.max(1 / F.col("entities")).alias("score"))


def link(texts: DataFrame, registry: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """The distinct (keys, entity_id) of the sure links: rewritings that one entity alone has."""
    return links(texts, registry, keys, column).where("score = 1").select(*keys, "entity_id")
