"""Text that looks the same in different characters (problem 3).

Every distinct token gets a look-alike-mapped value; in SQL the tokens are grouped by that value under an
accent-sensitive Unicode collation, which also takes canonically equal spellings and ignorable characters as equal;
each class has one canonical member, which is joined back to the texts. Which characters stand for others comes from
Unicode's own decompositions and a table of look-alike letters.

Defined results: null and empty texts are no cases; repeated rows of a table count once, by id; a token is what
stands between plain spaces, tabs and line breaks; the canonical member of a class is the one with the fewest odd
characters, then the most frequent, then the smallest; signs of Chinese and Arabic sentences and symbols such as №,
½ or ² are ordinary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, checkpointed, sized_join

# Letters of other alphabets beside the Cyrillic letters that look like them.
LATIN = "ABCEHKMOPTXYIaceopxyihəӘS"
LATIN_AS = "АВСЕНКМОРТХУІасеорхуіһәӘЅ"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρυχικ"
GREEK_AS = "АВЕZНІКМNОРТУХоарухік"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXoapuxik"
# Letters of rarer alphabets beside the Latin ones that look like them: Cherokee, Lisu, Coptic, Armenian, rare Cyrillic, small Latin.
RARE = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓥꓦꓧꓪꓫꓬꓮꓰꓲꓳ" "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ" "օսոհ" "ԁԛԝԌ" "ıɑɡɪʏᴀᴄᴇᴍᴏᴛᴠᴡᴢ"
RARE_AS = "ABCDEHJKLMPRSTVWZ" "BPDTGKJCZFMNLSRVVHWXYAEIO" "ABEHIKMNOPCTXopc" "ounh" "dqwG" "iagiyacemotvwz"
TO_CYRILLIC = str.maketrans(LATIN + GREEK, LATIN_AS + GREEK_AS)
TO_LATIN = str.maketrans(LATIN_AS + GREEK, LATIN + GREEK_AS_LATIN)
FROM_RARE = str.maketrans(RARE, RARE_AS)
SPACES = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}" + f"-\\U{b:08x}" * (b > a) for a, b in out)


def _decompositions() -> tuple[dict[str, str], set[str]]:
    """Letters and digits that are other forms of ordinary ones (wide, narrow, mathematical, ligatures), and characters that are never written in composed text."""
    forms, other = {}, set()
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c)
        if not parts:
            continue
        tag = parts.split()[0]
        if tag[0] != "<":
            if unicodedata.normalize("NFC", c) != c:
                other.add(c)
        elif (tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and 0xFB00 <= ord(c) <= 0xFB17) and unicodedata.category(c) in ("Lu", "Ll", "Lo", "Lt", "Nd"):
            plain = unicodedata.normalize("NFKC", c)
            if unicodedata.category(plain[0])[0] in "LN":
                forms[c] = plain
    return forms, other


FORMS, UNCOMPOSED = _decompositions()
#: Default-ignorable characters and controls: nothing is seen of them.
IGNORABLE = {
    chr(c) for a, b in (
        (0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
        (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
    ) for c in range(a, b + 1)
}
INVISIBLE = _ranges(IGNORABLE)

#: In Java's syntax: what a token must hold to be anything but its own canonical member, in broad blocks, since it only
#: chooses what is looked at. Ordinary characters are passed over first. A wholly Latin or Greek run of capitals may
#: stand for a Cyrillic short form; marks count when they compose with their letter.
BLOCKS = (
    r"\x00-\x08\x0e-\x1b\x7f-\xa0\xad\u0131\u0250-\u02ff\u0340-\u0344\u034f\u0370-\u03ff\u0483-\u0489\u0500-\u058f\u061c\u0900-\u0fff\u115f\u1160\u13a0-\u13ff\u1680\u17b4\u17b5\u180b-\u180f\u1c80-\u1c8f\u1d00-\u1dbf"
    r"\u1f00-\u200f\u2028-\u202f\u205f-\u206f\u2071-\u209f\u2102-\u2115\u2117-\u214f\u2180-\u218f\u2329\u232a\u2adc\u2c80-\u2cff\u2de0-\u2dff\u3000\u3164\ua4d0-\ua4ff\ua640-\ua69f\uf900-\ufb4f\ufe00-\ufe0f\ufeff\uff10-\uff19"
    r"\uff21-\uff3a\uff41-\uff5a\uff66-\uffdc\ufff9-\ufffb\x{10000}-\x{10ffff}"
)
SUSPECT = rf"(?![ -~Ѐ-҂Ҋ-ӿ])(?:[{BLOCKS}]|(?<=\p{{L}})\p{{Mn}})|[A-Za-zªºÀ-ɏḀ-ỿⱠ-Ɀ꜠-ꟿ](?:(?<=[Ѐ-ӿ].)|(?=[Ѐ-ӿ]))|(?<![A-Za-z])[ABCEHKMOPTXYI]{{2,}}(?![A-Za-z])"

_INVISIBLE = regex.compile(f"[{INVISIBLE}]")
_SPACES = regex.compile(f"[{SPACES}]")
_FORMS = regex.compile(f"[{_ranges(FORMS)}]")
_RARE = regex.compile(f"[{RARE}]")
_UNCOMPOSED = regex.compile(rf"[{_ranges(UNCOMPOSED)}]|\p{{L}}\p{{Mn}}")
_RUN = regex.compile(r"[\p{L}\p{M}]+")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_FOREIGN = regex.compile(r"[\p{Latin}\p{Greek}]")
_ORDINARY = regex.compile(r"[\p{Cyrillic}\p{Latin}\p{Greek}]")
_GREEK = regex.compile(r"\p{Greek}")
_SHORT_FORM = regex.compile(f"[{LATIN}]{{2,}}")
_ROMAN = regex.compile(r"M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})")


def _run(match: regex.Match) -> str:
    run = match.group()
    if _RARE.search(run) and _ORDINARY.search(_RARE.sub("", run)):  # beside letters of an alphabet in use
        run = run.translate(FROM_RARE)
    if _FOREIGN.search(run):
        if _CYRILLIC.search(run):
            cyrillic = run.translate(TO_CYRILLIC)
            if _FOREIGN.search(cyrillic):  # a letter without a Cyrillic look-alike: the word is Latin
                latin = run.translate(TO_LATIN)
                return cyrillic if _CYRILLIC.search(latin) else latin
            return cyrillic
        if _GREEK.search(run):
            latin = run.translate(TO_LATIN)
            return run if _GREEK.search(latin) else run.translate(TO_CYRILLIC)
        if _SHORT_FORM.fullmatch(run) and run.isupper() and not _ROMAN.fullmatch(run):
            return run.translate(TO_CYRILLIC)
    return run


def _mapping(token: str) -> tuple[str, int]:
    """(look-alike-mapped value, how many characters stand for, or hide beside, ordinary ones).

    Characters are counted where they are taken away, replaced or composed, so that one hidden character does not
    make those behind it count.
    """
    odd = 0
    token, n = _INVISIBLE.subn("", token)
    odd += n
    token, n = _SPACES.subn(" ", token)
    odd += n
    token, n = _FORMS.subn(lambda m: FORMS[m.group()], token)
    odd += n
    if _UNCOMPOSED.search(token):
        composed = unicodedata.normalize("NFC", token)
        odd += max(int(composed != token), len(token) - len(composed))
        token = composed
    changed = 0

    def one(match: regex.Match) -> str:
        nonlocal changed
        run = _run(match)
        changed += sum(a != b for a, b in zip(match.group(), run, strict=True))
        return run

    return _RUN.sub(one, token), odd + changed


def mapped(token: str) -> str:
    """The look-alike-mapped value of a token: plain, composed, and each word in one alphabet."""
    return _mapping(token)[0]


def odd(token: str) -> int:
    """How many characters of a token stand for, or hide beside, ordinary ones."""
    return _mapping(token)[1]


def weak(token: str, value: str) -> bool:
    """Whether a token differs from its value only by Latin capitals in place of a whole Cyrillic form."""
    return len(token) == len(value) and all(a == b or a in LATIN for a, b in zip(token, value, strict=True)) and not any(_CYRILLIC.search(r) and _FOREIGN.search(r) for r in _RUN.findall(token))


def _map_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column(0).to_pylist()
        found = [_mapping(t) for t in tokens]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v for v, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32()), pa.array([weak(t, v) for t, (v, _) in zip(tokens, found, strict=True)], pa.bool_())], names=["token", "n", "value", "odd", "weak"])


def tokens_of(text) -> F.Column:
    return F.split(text, r"[ \t\n\r]+")


def canonical_members(texts: DataFrame, column: str = "text") -> DataFrame:
    """(token, canonical) of every distinct token that differs from the canonical member of its class.

    The tokens of all rows are counted with partial aggregation; only tokens with suspect characters pass through
    Python, and ordinary tokens are their own mapped value.
    """
    spark = texts.sparkSession
    counted = texts.select(F.explode(tokens_of(column)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    suspect = arrow_map(counted.where(F.col("token").rlike(SUSPECT)), _map_kernel, "token string, n bigint, value string, odd int, weak boolean", 10_000)
    plain = counted.where(~F.col("token").rlike(SUSPECT)).select("token", "n", F.col("token").alias("value"), F.lit(0).alias("odd"), F.lit(False).alias("weak"))
    members = checkpointed(suspect)
    # A mapped value is a member too, as often as nothing: a class of odd tokens only has an ordinary one that way.
    ideal = members.where("odd > 0").select(F.col("value").alias("token"), F.lit(0).cast("bigint").alias("n"), "value", F.lit(0).alias("odd"), F.lit(False).alias("weak"))
    classes = spark.sql(
        """
        select min_by(token, struct(odd, -n, token)) as canonical, max(if(odd = 0, n, 0)) as ordinary, collect_set(struct(token, n, weak)) as members
        from {members} group by collate(value, 'UNICODE') having count(distinct token) > 1""",
        members=members.unionByName(plain).unionByName(ideal),
    )
    # A wholly Latin form, which may be a real word, yields only to a Cyrillic one that is as frequent.
    return classes.select(F.explode("members").alias("m"), "canonical", "ordinary").where("m.token <> canonical and (not m.weak or ordinary >= m.n)").select("m.token", "canonical").distinct()


def lookalike_rows(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """The distinct keys of the rows whose text holds a token with another canonical member."""
    rows = texts.where(F.col(column).isNotNull())
    members = canonical_members(rows, column)
    suspects = rows.where(F.col(column).rlike(SUSPECT)).select(*keys, F.explode(F.array_distinct(F.filter(tokens_of(column), lambda t: t.rlike(SUSPECT)))).alias("token"))
    return sized_join(suspects, members.select("token"), ["token"], "left_semi").select(*keys).distinct()


def in_one_form(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Every row with its text in canonical form (column ``canonical``), white space kept.

    Only distinct texts with suspect characters are taken apart, put together again and joined back by the text; all
    other rows pass without a shuffle.
    """
    suspect = F.coalesce(F.col(column).rlike(SUSPECT), F.lit(False))
    distinct = checkpointed(texts.where(suspect).select(F.col(column).alias("_text")).distinct())
    taken = distinct.select("_text", F.posexplode(F.regexp_extract_all("_text", F.lit(r"([ \t\n\r]+|[^ \t\n\r]+)"), F.lit(1))).alias("_at", "token"))
    joined = sized_join(taken, canonical_members(texts, column), ["token"], "left")
    piece = F.struct("_at", F.coalesce("canonical", "token").alias("piece"))
    built = joined.groupBy("_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "").alias("canonical"), F.max(F.col("canonical").isNotNull()).alias("_changed"))
    changed = sized_join(texts.where(suspect).withColumn("_text", F.col(column)), built.where("_changed").select("_text", "canonical"), ["_text"], "left")
    return texts.where(~suspect).select(*keys, F.col(column).alias("canonical")).unionByName(changed.select(*keys, F.coalesce("canonical", "_text").alias("canonical")))
