"""Personal data in free text (problem 4), by aggregation of weak labelers.

Candidates of five kinds are found by anchors. For each candidate, labelers by pattern, word list and context vote
for (1), against (-1) or not at all (0). Candidates with equal votes and features are counted over the whole
collection; expectation-maximisation over these counts estimates every labeler's reliability, and its posteriors
train the final classifier of spans, a logistic one over votes and features. Both need only the table of patterns,
whose size is bounded by the labelers, never by the data.

A span is the whole of what it names and nothing else: an address is the chain of its parts around a street word
(place, street, house, flat), an e-mail its whole local part and domain, a name its words and initials. No span
begins or ends inside a word or takes a line's end.

Defined results: null and empty texts hold nothing; rows are taken as given (``doc_id`` is unique); of overlapping
spans all count, and in a redacted text the placeholder of the earliest and longest stands for all that they cover;
texts keep everything else unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, checkpointed
from .names import NICKNAMES, latin

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Given names, and the words around personal data in Russian, Kazakh and English.
GIVEN = frozenset(
    """александр александра алексей алина алия әлия амина анастасия андрей анна антон арман асель айгүл айгуль ахмет бақыт болат борис вадим валентина
    валерий василий вера виктор виталий владимир вячеслав галина георгий геннадий григорий гүлнар гульнара данияр дарья денис динара дмитрий евгений
    екатерина елена ерлан еркін жанар жанна зарина зейнеп иван игорь илья ирина қайрат кайрат константин ксения лариса людмила мадина максим марат
    маргарита мария марина михаил мұрат мурат надежда наталья никита николай нұрлан нурлан ольга олег омирбек өмірбек павел пётр полина роман руслан сабина
    светлана сауле сергей серик серік станислав степан тамара татьяна тимур фёдор шынар юлия юрий яна ярослав""".split()
) | frozenset(NICKNAMES) | frozenset(n for v in NICKNAMES.values() for n in v.split())
GIVEN_LATIN = frozenset(map(latin, GIVEN))
SURNAME = re.compile(r"(?:[оеё]в|[иы]н|[оеё]ва|[иы]на|[оеё]в[аоыу]й?|ским?|ская|цкий|цкая|енко|ук|юк|[eo]va?|ina?|yna?|sky|skaya|bayeva?|enko)$")
PATRONYMIC = re.compile(r"(?:[оеё]вич|[оеё]вна|ич|ична|ұлы|улы|қызы|кызы|[eo]vich|[eo]vna|uly|qyzy)(?:а|у|ем|ом|ой|е)?$")
ROLES = re.compile(
    r"(?:истец|истца|ответчик\w*|заявител\w+|свидетел\w+|понят\w+|секретарь(?: заседания)?|редактор(?: отдела|ы)?|судь\w+|эксперт\w*|адвокат\w*|нотариус\w*|гражданин\w*|представител\w+|явился|явилась|"
    r"выступает|сдал[а]?|дал[а]?|делу|слов|хатшысы|куә\w*|қоюшы|жауапкер\w*|тарапы|судья\w*|азамат\w*|отырысқа|құжаттарды|түсіндірмесі|clerk was|mr|ms|mrs|dr|hearing|named is|filed by|claimant|witness|editor)[ :.–—-]*$",
    re.I,
)
FIRM = re.compile(r"(?:тоо|жшс|ао|ооо|ип|компани\w+|фирм\w+|завод\w*|зауыт\w*|дүкен\w*|магазин\w*|«|\"|“|llp|jsc)[ «\"“:]*$", re.I)
FIRM_AFTER = re.compile(r"^[ »]*(?:торг|и ко|және|ұлдары|и сыновья|& |and sons|трейд|холдинг|групп|зауыт\w*|завод\w*|\w*»|llp|jsc)", re.I)
STREET_BEFORE = re.compile(r"(?:ул|улица|улице|улицы|пр-т|проспект\w*|мкр|микрорайон\w*|пер|переулок|бульвар|площадь|пл|имени|им|атындағы)\.?[ ]*$", re.I)
STREET_AFTER = re.compile(r"^ ?(?:көш\w*|к-сі|даңғыл\w*|street|road|lane|drive|avenue|ауданы)", re.I)
STREET = re.compile(
    r"(?:(?P<prefix>\bул\.|\bулиц[аеыу]\b|\bпр-т\b|\bпросп(?:\.|ект\w*)|\bмкр\b\.?|\bмикрорайон\w*|\bпереул\w+|\bпер\.|\bбульвар\w*)|\bкөшесі\w*|\bк-сі\w*|\bдаңғыл\w*|\bықшам ?аудан\w*|"
    r"\b(?:Street|Road|Lane|Drive|Avenue|Square|Court|Close)\b)", re.I,
)
COMMON = frozenset(("court", "close", "square"))
NUMBERED = re.compile(r"\d[\w/-]*(?: [\w'’.-]+){1,3} $")
_WORD = r"\p{Lu}[\p{L}'’]*(?:-\p{L}+)*"
_NUMBER = r"\d+(?:[/-]\d+)*(?:-?\p{L})?(?![\p{L}\d])"
_UNIT = r"(?:д|дом|корп|корпус|стр|строение|кв|квартира|оф|офис|пом|помещение|под|подъезд|flat|apt|apartment|house|unit)"
_PART = rf"(?:(?i:{_UNIT})\.? ?(?:№ ?)?{_NUMBER}|\d+(?:/\d+)?\p{{L}}? ?-? ?(?:үй|пәтер|корпус|кеңсе)\p{{L}}*)"
_PLACE = (
    rf"(?:\b(?:г|гор|город|пос|посёлок|поселок|с|село|аул|ауыл|қ|обл|р-н)\.? ?{_WORD}(?: {_WORD})*|{_WORD}(?: {_WORD})* (?:қ|қала\p{{L}}*|ауыл\p{{L}}*|облыс\p{{L}}*|аудан\p{{L}}*|обл|область|район|р-н)\.?|\b\d{{6}}\b)"
)
STREET_NAME = regex.compile(rf" ?(?:им(?:ени|\.) ?)?(?:\d+(?:-?\p{{Ll}}{{1,3}})? )?(?:{_WORD}(?: {_WORD})*|«[^»\n]*»)")
NAME_BEFORE = regex.compile(rf"(?r)(?<![\p{{L}}\d])(?:{_WORD} )+")
HOUSE_PARTS = regex.compile(rf"(?:,? ?{_PART}|,? {_NUMBER})(?:,? ?{_PART})*|(?:,? ?{_PART})+")
FLAT_AFTER = regex.compile(rf"(?:, ?{_PART})+")
FLAT_BEFORE = regex.compile(rf"(?r)(?<![\p{{L}}\d])(?:{_PART},? ?)*{_NUMBER},? ")
PLACES_BEFORE = regex.compile(rf"(?r)(?<![\p{{L}}\d])(?:{_PLACE} ?, ?)+")
PLACES_AFTER = regex.compile(rf"(?: ?, ?{_PLACE})+")
BARE_BEFORE = regex.compile(r"(?r)(?<![\p{L}\d.-])(\p{Lu}\p{Ll}{2,}(?:-\p{L}+)*) ?, ?")
BARE_AFTER = regex.compile(r", (\p{Lu}\p{Ll}{2,}(?:-\p{L}+)*)(?!\.?\p{L}| \p{Lu})")
LIVES = re.compile(r"(?:прожива|адресу|повестка|жительств|мекенжай|шақыру қағазы|тұратын|зарегистрирован по|lives at|served at|resides|address)\w*", re.I)
AT = re.compile(r"@|＠|[(\[](?:at|собака|dog|ат|эт)[)\]]", re.I)
LOCAL = regex.compile(r"(?r)[\w.+\-]+ ?")
DOMAIN = re.compile(r" ?[\w\-]+(?: ?(?:\.|\((?:dot|точка)\)) ?[\w\-]+)+")
MAIL = re.compile(r"(?:mailto:|почт|пошта|mail|писать|присыла|направить|жіберу|мекенжай|replies|copy sent|адрес|write)", re.I)
NUMBER = re.compile(r"(?<![\w.,/])(?:\+|\()?\d[\d ().\-]{5,20}\d(?![\w/])|(?:(?<=ИИН)|(?<=иин)|(?<=ЖСН)|(?<=жсн)|(?<=IIN))\d{12}\b|\b[A-ZА-Я]{1,2} ?(?:№ ?)?\d{7,9}\b|№ ?\d{8,9}\b")
RUN = re.compile(r"[\d ().+\-]*\d")
PART = re.compile(r"[+(]*\d(?:[\d().\-]*\d)?")
CALL = re.compile(r"(?:тел\b|тел\.|телефон|звон|хабарлас|хабарлау|қоңырау|call|phone|reached|\+7|whatsapp|сот\.)", re.I)
IDENTITY = re.compile(r"(?:иин|жсн|\biin|удостоверени|паспорт|passport|куәлі|identity|личност|жеке бас|данные стороны|деректері)", re.I)
OTHER_NUMBER = re.compile(r"(?:бин\b|бсн\b|\bbin\b|сч[её]т|шот\b|account|сумм|сома|amount|парти|batch|кадастр|дело №|іс\b|договор|contract|№ ?\d+-\d+-\d+|kz\d\d|код |доверенност|опись|тізімдеме|сенімхат|mandate|list no)", re.I)
PHONE_SHAPE = re.compile(r"(?:\+?7|8)[ .\-]?\(?7\d\d\)?[ .\-]?\d{3}[ .\-]?\d\d[ .\-]?\d\d|\d{3}-\d\d-\d\d")
BIRTH = re.compile(r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])")
STOP_OF_INITIAL = regex.compile(r"\.(?=[,;:)]|[ \t]+[\p{Ll}\d(–—-])")
CAPITAL = regex.compile(r"(?<![\p{L}\d])\p{Lu}(?:\p{L}+|(?=\.))")

Candidate = tuple[int, int, str, tuple[int, ...], tuple[int, ...]]  # start, end, kind, votes, features


def _line(text: str, at: int, reach: int = 400) -> tuple[int, int]:
    """The line around a place, as far as its context counts."""
    low, high = max(0, at - reach), min(len(text), at + reach)
    start = text.rfind("\n", low, at) + 1 or low
    end = text.find("\n", at, high)
    return start, high if end < 0 else end


def _emails(text: str) -> Iterator[Candidate]:
    for m in AT.finditer(text):
        begin, stop = _line(text, m.start())
        before, after = LOCAL.match(text, 0, m.start()), DOMAIN.match(text, m.end())
        whole = bool(before) and bool(after)
        s = before.start() if before else m.start()
        e = after.end() if after else m.end()
        plain = m.group() in "@＠"
        yield s, e, "email", (
            1 if whole else -1,
            1 if MAIL.search(text, begin, stop) else 0,
            1 if after and "." in after.group().strip(". ") else -1,
            -1 if not before or not text[e - 1 : e].isalpha() else 0,
        ), (int(plain), int(text[s:e].isupper()))


def _number_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, where its context begins at the earliest) of every number.

    What has more digits than any number is several side by side: in the whole run of digits and blanks, the parts
    of twelve digits and those that make a phone are numbers, and what is left between them is one if it is short.
    """
    done = 0
    for m in NUMBER.finditer(text):
        if m.start() < done:
            continue
        if sum(c.isdigit() for c in m.group()) <= 12:
            yield *m.span(), 0
            continue
        run = RUN.match(text, m.start())
        done = run.end()
        parts = [p.span() for p in PART.finditer(text, *run.span())]
        if text[done : done + 1] == "/" or text[done : done + 1].isalnum():
            parts.pop()
        low, k, rest = 0, 0, []
        numbers: list[tuple[int, int]] = []

        def flush(rest=rest, numbers=numbers) -> None:
            joined = rest and sum(c.isdigit() for c in text[rest[0][0] : rest[-1][1]]) <= 12
            numbers.extend([(rest[0][0], rest[-1][1])] if joined else rest)
            rest.clear()

        while k < len(parts):
            fits = [j for j in range(k, min(k + 6, len(parts))) if PHONE_SHAPE.fullmatch(text, parts[k][0], parts[j][1])]
            if fits or sum(c.isdigit() for c in text[slice(*parts[k])]) == 12:
                flush()
                j = max(fits, default=k)
                numbers.append((parts[k][0], parts[j][1]))
                k = j + 1
            else:
                rest.append(parts[k])
                k += 1
        flush()
        for s, e in numbers:
            yield s, e, low
            low = e


def _numbers(text: str) -> Iterator[Candidate]:
    for s, e, low in _number_spans(text):
        begin, stop = _line(text, s)
        number = text[s:e]
        digits = "".join(c for c in number if c.isdigit())
        n = len(digits)
        if n < 7 or n > 12:
            continue
        lettered = not digits.startswith(number[:1]) and number[:1].isalpha() or number[:1] == "№"
        near = text[max(begin, low, s - 48) : s]
        call, identity, other = bool(CALL.search(near)), bool(IDENTITY.search(near)), bool(OTHER_NUMBER.search(text, max(begin, low, s - 32), e))
        house = "(дом" in text[e : e + 6]
        if not lettered and n in (7, 10, 11):
            yield s, e, "phone", (
                1 if PHONE_SHAPE.fullmatch(number.strip("() ")) or PHONE_SHAPE.fullmatch(number) else -1,
                1 if call or house else -1 if not CALL.search(text, begin, stop) else 0,
                -1 if other and not call else 0,
                -1 if identity else 0,
            ), (n, int(number[:1] == "+"))
        if n == 12 and not lettered or lettered and 7 <= n <= 9 or n == 9:
            yield s, e, "id_number", (
                (1 if BIRTH.match(digits) else -1) if n == 12 else 1 if n in (8, 9) else 0,
                1 if identity else -1,
                -1 if other and not identity else 0,
                -1 if call and not identity else 0,
            ), (n, int(lettered))


def _address_span(text: str, m: re.Match, low: int, taken: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """(start, end, with a street name, parts of a house, with a place) of the address around a street word.

    It grows part by part and stops at ``low`` and at the names of persons (``taken``, their spans in order).
    """
    s, e = m.span()
    named = STREET_NAME.match(text, e) if m.group("prefix") else None
    if named:
        e = named.end()
    elif found := NAME_BEFORE.match(text, low, s):
        named, s = found, found.start()
    # The persons nearest to the core on both sides; one that lies over the core is the street's own name.
    at = bisect_right(taken, (s, e))
    left = max((b for a, b in taken[max(0, at - 2) : at] if b <= s), default=low)
    right = min((a for a, b in taken[at : at + 2] if a >= e), default=len(text))
    house = 0
    if found := HOUSE_PARTS.match(text, e, right):
        house, e = house + 1, found.end()
    if m.group().isascii():
        if found := FLAT_BEFORE.match(text, left, s):
            house, s = house + 1, found.start()
        if found := FLAT_AFTER.match(text, e, right):
            house, e = house + 1, found.end()
    place = 0
    if found := PLACES_BEFORE.match(text, left, s):
        place, s = 1, found.start()
    elif (found := BARE_BEFORE.match(text, left, s)) and _word_class(found.group(1)) == "-":
        place, s = 1, found.start()
    if found := PLACES_AFTER.match(text, e, right):
        place, e = 1, found.end()
    elif m.group().isascii() and house and (found := BARE_AFTER.match(text, e, right)) and _word_class(found.group(1)) == "-":
        place, e = 1, found.end()
    return s, e, int(named is not None), house, place


def _addresses(text: str, persons: list[Candidate]) -> Iterator[Candidate]:
    """Every street word of a line is a candidate of its own; ``last`` is where the one before it on the line ends."""
    last = 0
    taken: list[tuple[int, int]] | None = None
    for m in STREET.finditer(text):
        if m.start() < last:
            continue  # a part of the address before
        if taken is None:
            taken = [c[:2] for c in persons]
        begin, _ = _line(text, m.start())
        low = max(begin, last)
        latin_form = m.group().isascii()
        own = LIVES.search(text, low, m.start())
        lives = own or LIVES.search(text, begin, m.start())
        if lives and not own and m.group() in COMMON and not NUMBERED.search(text, low, m.start()):  # "the court" behind somebody's address
            lives = None
        s, e, named, house, place = _address_span(text, m, max(last, own.end() if own else 0), taken)
        last = e
        yield s, e, "address", (
            1 if house else -1,
            1 if lives else -1,
            1 if place else 0,
            -1 if m.group()[0].islower() and latin_form else 0,
        ), (int(latin_form), named, min(house, 2))


def _word_class(word: str) -> str:
    w = word.lower()
    if len(w) == 1:
        return "I"
    if w in GIVEN or w in GIVEN_LATIN:
        return "G"
    if len(w) > 5 and PATRONYMIC.search(w):
        return "P"
    if len(w) > 3 and SURNAME.search(w):
        return "S"
    return "-"


_GAP = re.compile(r"(?:\.? ?|, ?|  ?|\.|-)")
FULL = re.compile("GPS|SGP|IIS|SII|GS|SG|IS|SI|GP")


def _persons(text: str, classes: dict[str, str]) -> Iterator[Candidate]:
    run: list[tuple[int, int, str]] = []
    words = []
    for m in CAPITAL.finditer(text):
        w = m.group()
        c = classes.get(w)
        if c is None:
            if len(classes) > 500_000:
                classes.clear()
            c = classes[w] = _word_class(w)
        words.append((m.start(), m.end(), c))
    words.append((len(text) + 9, len(text) + 9, "-"))
    for s, e, c in words:
        if run and (c != "-" or any(x[2] in "GI" for x in run)) and s - run[-1][1] <= 3 and _GAP.fullmatch(text, run[-1][1], s) and "\n" not in text[run[-1][1] : s]:
            gap = text[run[-1][1] : s]
            if not (("." in gap) != (run[-1][2] == "I") and ("." in gap or run[-1][2] == "I")) and not (c == "-" and "," in gap):
                run.append((s, e, c))
                continue
        if run:
            for part in _single(run):
                yield from _person(text, part)
        run = [(s, e, c)] if c != "-" or e - s > 4 else []


def _single(run: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """A run of name words as one person each, where it holds several whole names."""
    whole = [m.span() for m in FULL.finditer("".join(c for _, _, c in run))] if len(run) > 3 else []
    if len(whole) < 2:
        yield run
        return
    at = 0
    for s, e in [*whole, (len(run), len(run))]:
        if at < s:
            yield run[at:s]
        if s < e:
            yield run[s:e]
        at = e


def _person(text: str, run: list[tuple[int, int, str]]) -> Iterator[Candidate]:
    if any(c == "S" for _, _, c in run):  # an ordinary capitalised word beside the name
        while run[0][2] == "-":
            run = run[1:]
        while run[-1][2] == "-":
            run = run[:-1]
    shape = "".join(c for _, _, c in run)
    if not (("G" in shape and len(shape) > 1) or ("S" in shape and ("I" in shape or "P" in shape)) or shape in ("S", "P", "G", "GP", "IP", "-I", "-II", "I-", "II-")):
        return
    s, e = run[0][0], run[-1][1]
    if shape[-1] == "I" and len(shape) > 1 and STOP_OF_INITIAL.match(text, e):
        e += 1
    begin, stop = _line(text, s)
    before, after = text[max(begin, s - 40) : s], text[e : min(stop, e + 24)]
    role = bool(ROLES.search(before))
    if len(shape) == 1 and not role or "-" in shape and "G" not in shape and not role:
        return
    full = shape in ("GPS", "SGP", "IIS", "SII", "GS", "SG", "IS", "SI", "GP")
    street = bool(STREET_BEFORE.search(before) or STREET_AFTER.search(after))
    firm = bool(FIRM.search(before) or FIRM_AFTER.search(after)) or before.count("«") > before.count("»")
    yield s, e, "name", (
        1 if full else 0,
        1 if "G" in shape or "P" in shape else 0,
        1 if "S" in shape else 0,
        1 if role else 0,
        -1 if street else 0,
        -1 if firm else 0,
    ), (int(len(shape) == 1), int("I" in shape))


def candidates(text: str, classes: dict[str, str] | None = None) -> list[Candidate]:
    """All candidates of a text with the labelers' votes."""
    persons = list(_persons(text, {} if classes is None else classes))
    return [*_emails(text), *_numbers(text), *_addresses(text, persons), *persons]


def estimate(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...], tuple[int, ...]], float]:
    """The probability of each pattern (kind, votes, features), from the counts of all.

    Expectation-maximisation per kind: the latent truth of each pattern, and for each labeler the chances of its
    votes given the truth, starting from the sum of votes. A labeler's chances stay on its own side: who votes for
    does so rather in true cases. The posteriors then train a logistic classifier with votes and features.
    """
    result = {}
    for kind in dict.fromkeys(p[0] for p in patterns):
        mine = [p for p in patterns if p[0] == kind]
        votes = np.array([p[1] for p in mine])
        counts = np.array([p[3] for p in mine], float)
        true = 1 / (1 + np.exp(-2.0 * votes.sum(1)))
        for _ in range(rounds):
            prior = np.clip((true * counts).sum() / counts.sum(), 0.02, 0.98)
            odds = np.full(len(mine), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                for v in (-1, 1):
                    here = votes[:, j] == v
                    yes = ((true * counts)[here].sum() + 1) / ((true * counts).sum() + 3)
                    no = (((1 - true) * counts)[here].sum() + 1) / (((1 - true) * counts).sum() + 3)
                    odds[here] += np.clip(np.log(yes / no), *((0, 6) if v > 0 else (-6, 0)))
            true = 1 / (1 + np.exp(-odds))
        marks = sorted({(i, f) for p in mine for i, f in enumerate(p[2])})
        x = np.array([[1.0, *p[1], *[float(p[2][i] == f) for i, f in marks]] for p in mine])
        weights = np.zeros(x.shape[1])
        weights[1 : 1 + votes.shape[1]] = 1.0
        share = np.sqrt(counts) / np.sqrt(counts).sum()
        for _ in range(800):
            p = 1 / (1 + np.exp(-x @ weights))
            weights -= 2.0 * (x.T @ ((p - true) * share) + 1e-4 * weights)
        for p, y in zip(mine, 1 / (1 + np.exp(-x @ weights)), strict=True):
            result[p[:3]] = float(y)
    return result


SPAN = pa.struct([("line_no", pa.int32()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("pattern", pa.string())])
SPANS = "array<struct<line_no:int,kind:string,start_pos:int,end_pos:int,pattern:string>>"


def _found(documents: DataFrame, with_text: bool) -> tuple[DataFrame, dict[str, float]]:
    """(doc_id, [text], spans) with all candidates of every document that has any, written; and the patterns' chances.

    The texts are read once and never shuffled. The number of patterns is bounded by the labelers' votes and features.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, str] = {}
        for b in batches:
            out: list[list[dict]] = []
            for text in b.column(1).to_pylist():
                held: list[dict] = []
                if text:
                    ends = [m.start() for m in re.finditer("\n", text)]
                    for s, e, k, votes, features in candidates(text, classes):
                        held.append({"line_no": bisect_right(ends, s - 1), "kind": k, "start_pos": s, "end_pos": e, "pattern": f"{k} {votes} {features}"})
                out.append(held)
            yield pa.RecordBatch.from_arrays([*b.columns[: 1 + with_text], pa.array(out, pa.list_(SPAN))], names=[*b.schema.names[: 1 + with_text], "spans"])

    found = checkpointed(arrow_map(documents.select("doc_id", "text"), kernel, f"doc_id {kind}, {'text string, ' * with_text}spans {SPANS}"))
    patterns = []
    for r in found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect():
        k, votes, features = re.fullmatch(r"(\w+) (\(.*\)) (\(.*\))", r.pattern).groups()
        patterns.append((k, _tuple(votes), _tuple(features), r["count"]))
    return found, {f"{k} {v} {f}": p for (k, v, f), p in estimate(patterns).items()}


def spans(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, line_no, kind, start_pos, end_pos, probability) of the personal data in every document."""
    found, chances = _found(documents, False)
    table = documents.sparkSession.createDataFrame(list(chances.items()), "pattern string, probability double")
    each = found.select("doc_id", F.inline("spans"))
    return each.join(F.broadcast(table), "pattern").where(F.col("probability") >= threshold).drop("pattern")


def _tuple(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"-?\d+", text))


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """A text with the placeholders of spans (start, end, kind) in their place, from the left.

    A span that begins inside an earlier one only extends what that covers.
    """
    out, at, covered = [], 0, False
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if covered and s < at:
            at = max(at, e)
            continue
        out += [text[at:s], PLACEHOLDERS[kind]]
        at, covered = e, True
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text): every text with typed placeholders in place of its personal data; null stays null.

    Texts and their candidates are written side by side once, so that no text is shuffled.
    """
    found, chances = _found(documents, True)
    sure = documents.sparkSession.sparkContext.broadcast({k for k, p in chances.items() if p >= threshold})
    kind = documents.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t and replaced(t, [(x["start_pos"], x["end_pos"], x["kind"]) for x in held if x["pattern"] in sure.value]) for t, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return arrow_map(found, kernel, f"doc_id {kind}, text string")
