"""Queries over the tables of a data directory, and the same in DuckDB's SQL where SQL can say it.

Every query runs over its whole tables. Repeated rows of ``issues`` and ``paras`` count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.lang import evidence, score, with_languages
from ..functions.match import alternatives
from ..functions.segment import sentences_by_language, tokens, words
from ..operators import corpus, edits, external, issues, names, reports, rules, spell
from ..runtime import checkpointed, read, spread, sized_join
from .examples import EXAMPLES, FOUND
from .pipeline import Resources, check

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SETTINGS = issues.Settings(categories={"style": False}, disabled_rules=["typo.dash", "lt:AGREE_X"])
PHRASES = ["срок исковой давности", "төлем кестесін", "по делу"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues once each, their paragraph's text joined by file and number, with the fragment."""
    found = read(spark, sf_dir, "issues").dropDuplicates()
    paras = read(spark, sf_dir, "paras").groupBy("file_id", "para").agg(F.min("text").alias("text"))
    joined = found.join(paras, ["file_id", "para"], "left")
    return joined.withColumn("fragment", issues.fragment(F.col("text"), F.col("start_pos"), F.col("end_pos")))


_LINES = "lines as (select doc_id, cast(i - 1 as integer) as para, pieces[i] as text from (select doc_id, string_split(text, chr(10)) as pieces from documents where text is not null) d, unnest(range(1, len(pieces) + 1)) as u(i))"
_ISSUES = """once as (select distinct * from issues),
para_texts as (select file_id, para, min(text) as text from paras group by file_id, para),
found as (select o.*, t.text, substring(t.text, o.start_pos + 1, o.end_pos - o.start_pos) as fragment from once o left join para_texts t on o.file_id = t.file_id and o.para = t.para)"""
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_TOKEN = rf"\p{{Nd}}+(?:[.,]\p{{Nd}}+)*(?:-(?:\p{{Nd}}+|[{X.LETTERS}]+))*|[{X.LETTERS}]+(?:[-''’][{X.LETTERS}]+)*|{_WS}+|[^{_WS[1:-1]}{X.LETTERS}\p{{Nd}}]"


@query(f"with {_LINES} select doc_id, para, text from lines")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paragraphs_of(read(spark, sf_dir, "documents"))


@query(
    rf"""with {_LINES}, t as (select doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) as piece from lines)
select doc_id, case when regexp_matches(piece, '^\p{{Nd}}') then 'number' when regexp_matches(piece, '^[{X.LETTERS}]') then 'word' when regexp_matches(piece, '^{_WS}') then 'space' else 'punct' end as kind,
count(*) as n, cast(sum(length(piece)) as bigint) as chars from t group by 1, 2"""
)
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("text"))).alias("t"))
    return t.groupBy("doc_id", F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("t.end") - F.col("t.start")).alias("chars"))


@query(rf"""with {_LINES}, t as (select doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) as piece from lines)
select piece as word, count(*) as n, count(distinct doc_id) as docs from t where regexp_matches(piece, '^[{X.LETTERS}]') group by 1""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = _lines(spark, sf_dir).select("doc_id", F.explode(words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_LANG = rf"""{_LINES},
w as (select doc_id, para, text, list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda x: regexp_matches(x, '^[{X.LETTERS}]')) as ws from lines),
s as (select doc_id, para,
  3 * length(regexp_replace(text, '[^{X.KK_LOWER}{X.KK_UPPER}]', '', 'g')) + 2 * len(list_filter(ws, lambda x: lower(x) in ({_list(X.KK_WORDS)}))) as kk,
  2 * len(list_filter(ws, lambda x: lower(x) in ({_list(X.RU_WORDS)}) and lower(x) not in ({_list(X.KK_WORDS)}))) as ru,
  len(list_filter(ws, lambda x: regexp_matches(lower(x), '[{X.KK_LOWER}]') or lower(x) in ({_list(X.KK_WORDS)}))) as kk_words,
  len(list_filter(ws, lambda x: lower(x) in ({_list(X.RU_WORDS)}) and not (regexp_matches(lower(x), '[{X.KK_LOWER}]') or lower(x) in ({_list(X.KK_WORDS)})))) as ru_words from w),
own as (select *, case when kk = 0 and ru = 0 then null when kk_words >= 3 and ru_words >= 3 then 'mixed' when ru_words >= 2 * greatest(kk_words, 1) then 'ru'
  when kk_words >= 2 * greatest(ru_words, 1) then 'kk' when kk > ru then 'kk' else 'ru' end as own from s)"""


@query(f"with {_LANG} select doc_id, para, cast(kk as bigint) as kk, cast(ru as bigint) as ru, cast(kk_words as bigint) as kk_words, cast(ru_words as bigint) as ru_words from s")
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _lines(spark, sf_dir).select("doc_id", "para", score(F.col("text")).alias("s"), evidence(F.col("text")).alias("e"))
    return t.select("doc_id", "para", *[F.col(c).cast("bigint").alias(n) for c, n in (("s.kk", "kk"), ("s.ru", "ru"), ("e.kk", "kk_words"), ("e.ru", "ru_words"))])


@query(f"""with {_LANG} select doc_id, para, coalesce(own, last_value(case when own <> 'mixed' then own end ignore nulls) over (partition by doc_id order by para rows between unbounded preceding and 1 preceding), 'ru') as lang from own""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_languages(spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")), "doc_id")).select("doc_id", "para", "lang")


_CHARS = f"""{_LINES}, chars as (select doc_id, para, cast(i - 1 as integer) as start_pos, substring(text, i - 1, 1) as before, substring(text, greatest(i - 2, 0), least(i - 1, 2)) as before2,
  substring(text, greatest(i - 4, 1), least(i - 1, 4)) as before4, substring(text, greatest(i - 3, 0), least(i - 1, 3)) as before3, substring(text, i) as rest, i from lines, unnest(range(1, length(text) + 1)) as u(i))"""
_SOLID = f"i > 1 and not regexp_matches(before, '{_WS}')"
_NO_WORD = r"(i = 1 or not regexp_matches(before, '[\p{L}\p{M}\p{N}\p{Pc}]'))"


@query(rf"""with {_CHARS}
select 'typo.double_space' as rule_id, doc_id, para, start_pos from chars where {_SOLID} and regexp_matches(rest, '^ {{2,}}[^{_WS[1:-1]}]')
union all select 'typo.space_before_punct', doc_id, para, start_pos from chars where {_SOLID} and regexp_matches(rest, '^ +[,;:!?]')
union all select 'typo.space_before_punct', doc_id, para, start_pos from chars where {_SOLID} and not regexp_matches(before, '[\p{{Nd}}.]') and regexp_matches(rest, '^ +\.({_WS}|$)')
union all select 'typo.no_space_after_punct', doc_id, para, start_pos from chars where regexp_matches(before, '[{X.CYR}»)]') and regexp_matches(rest, '^[,;][{X.CYR}«(]')
union all select 'typo.dash', doc_id, para, start_pos from chars where {_SOLID} and regexp_matches(rest, '^ - [^{_WS[1:-1]}]')
union all select 'typo.abbrev_space', doc_id, para, start_pos from chars where {_NO_WORD} and regexp_matches(rest, '^{alternatives(X.SPACED_ABBREVIATIONS, quote=False)}\.[\p{{Nd}}{X.UP}]')
union all select 'typo.abbrev_space', doc_id, para, start_pos from chars where regexp_matches(rest, '^№\p{{Nd}}')
union all select 'typo.year_g', doc_id, para, start_pos from chars where regexp_matches(before4, '^\p{{Nd}}{{4}}$') and regexp_matches(rest, '^г\.')
union all select 'typo.initials', doc_id, para, start_pos from chars where regexp_matches(before3, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])[{X.UP}]\.$') and regexp_matches(rest, '^[{X.UP}]\.({_WS}|$)')
union all select 'typo.quotes', doc_id, para, start_pos from (
  select doc_id, para, start_pos, rest, row_number() over (partition by doc_id, para order by start_pos) as k, count(*) over (partition by doc_id, para) as quotes from chars where rest like '"%')
  where k % 2 = 1 and regexp_matches(rest, '^"[^"]{{1,120}}"')""")
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.rule_issues(_lines(spark, sf_dir).withColumn("lang", F.lit("ru")), rules.TYPOGRAPHY)
    return found.select("rule_id", "doc_id", "para", "start_pos")


# Rows of which the tables have none, for both sides: (doc_id, text).
FIXTURE = [(-1, "Заңның 12 бабы, 3 ші қабат, ҚРның заңы"), (-2, "Глава ІІ и ХІV, статья V, том І"), (-3, "12 бап 5 тармағы 1 інші"), (-4, "ҚРға, АҚШтан, БҰҰның, ЖШСнің")]
_FIXTURE = "(values " + ", ".join(f"(cast({i} as bigint), '{t}')" for i, t in FIXTURE) + ") as fixture(doc_id, text)"
_FIXED_CHARS = _CHARS.replace("from documents where text is not null", f"from (select doc_id, text from documents union all select doc_id, text from {_FIXTURE}) where text is not null")


@query(rf"""with {_FIXED_CHARS}
select 'kk.hyphen_ordinal' as rule_id, doc_id, para, start_pos from chars where {_NO_WORD} and regexp_matches(rest, '^\p{{Nd}}+ {alternatives(X.NUMBERED_NOUNS_KK, quote=False)}[{X.LOW_KK}]*([^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|$)')
union all select 'kk.hyphen_suffix', doc_id, para, start_pos from chars where {_NO_WORD} and regexp_matches(rest, '^\p{{Nd}}+ {alternatives(X.NUMBER_SUFFIXES_KK, quote=False)}([^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|$)')
union all select 'kk.hyphen_abbrev', doc_id, para, start_pos from chars where {_NO_WORD} and regexp_matches(rest, '^[{X.UP}]{{2,6}}{alternatives(X.ABBREVIATION_AFFIXES_KK)}([^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|$)')
union all select 'alpha.roman', doc_id, para, start_pos from chars where {_NO_WORD} and regexp_matches(rest, '^[ІХV]{{2,5}}([^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|$)') and regexp_matches(rest, '^V*[ІХ]')""")
def kk_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [r for r in rules.default_rules() if r.id.startswith("kk.hyphen") or r.id == "alpha.roman"]
    fixture = corpus.paragraphs_of(spark.createDataFrame(FIXTURE, "doc_id bigint, text string"))
    found = rules.rule_issues(_lines(spark, sf_dir).unionByName(fixture).withColumn("lang", F.lit("kk")), chosen)
    return found.select("rule_id", "doc_id", "para", "start_pos")


@query(rf"""with once as (select para_id, min(text) as text from paras group by para_id), t as (select para_id, unnest(regexp_extract_all(text, '{_TOKEN}')) as piece from once)
select para_id, piece as word, count(*) as n from t where regexp_matches(piece, '^[{X.LETTERS}]') and regexp_matches(piece, '[A-Za-z]') and regexp_matches(piece, '[{X.CYR}]') group by 1, 2""")
def mixed_alphabets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = read(spark, sf_dir, "paras").groupBy("para_id").agg(F.min("text").alias("text")).withColumn("lang", F.lit("ru")).withColumn("para", F.lit(0))
    found = rules.rule_issues(paras, [r for r in rules.default_rules() if r.id == "alpha.mixed"], ("para_id",)).join(paras, "para_id")
    return found.groupBy("para_id", issues.fragment(F.col("text"), F.col("start_pos"), F.col("end_pos")).alias("word")).agg(F.count("*").alias("n"))


@query(rf"""with {_LINES}, w as (select doc_id, para, text, list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda x: not regexp_matches(x, '^{_WS}')) as ts from lines),
p as (select doc_id, para, i, lower(ts[i]) as a, lower(ts[i - 1]) as b, ts[i - 1] as b0, ts[i] as a0 from w, unnest(range(2, len(ts) + 1)) as u(i)),
d as (select *, case when a = b and regexp_matches(a0, '^[{X.CYR}]+$') and regexp_matches(b0, '^[{X.CYR}]+$') then 1 else 0 end as same from p),
g as (select doc_id, para, i, i - row_number() over (partition by doc_id, para order by i) as run from d where same = 1)
select doc_id, para, cast(sum((n + 1) // 2) as bigint) as n from (select doc_id, para, run, count(*) as n from g group by 1, 2, 3) group by 1, 2""")
def double_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.rule_issues(_lines(spark, sf_dir).withColumn("lang", F.lit("ru")), [r for r in rules.default_rules() if r.id == "rep.double"])
    return found.groupBy("doc_id", "para").agg(F.count("*").alias("n"))


@query()
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_languages(spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")), "doc_id"))
    return t.select("doc_id", "para", F.size(sentences_by_language(F.col("text"), F.col("lang"))).alias("sentences"))


@query()
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraph rules over all lines of all documents, in one projection."""
    found = rules.rule_issues(with_languages(spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")), "doc_id")))
    return found.groupBy("rule_id", "level").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query()
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = checkpointed(with_languages(spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")), "doc_id")))
    return names.variant_issues(texts).select("doc_id", "para", "start_pos", "end_pos", "message", F.array_join("suggestions", ", ").alias("suggestion"))


@query()
def official_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisations of the registry, a fixed table, as the official list, against all lines."""
    official = [r.name for r in read(spark, sf_dir, "registry").where("kind = 'organisation' and name is not null").orderBy("entity_id").select("name").toLocalIterator()]
    texts = with_languages(spread(corpus.paragraphs_of(read(spark, sf_dir, "documents")), "doc_id"))
    return names.official_issues(texts, official, official).select("doc_id", "para", "start_pos", "end_pos", "message")


_NOISE = f"""with {_ISSUES}, files as (select count(distinct file_id) as total from docx_files),
rows_ as (select concat_ws(':', engine, rule_id) as rule, count(*) as issues, count(distinct file_id) as docs from found group by 1),
frags as (select rule, string_agg(fragment, '; ' order by fragment) as examples from (select rule, fragment, row_number() over (partition by rule order by fragment) as r from (select distinct concat_ws(':', engine, rule_id) as rule, fragment from found where fragment is not null)) where r <= 3 group by 1)"""


@query(f"{_NOISE} select r.rule, r.issues, r.docs, round(r.docs / f.total, 6) as share, r.docs / f.total > 0.34 as flagged, coalesce(x.examples, '') as examples from rows_ r cross join files f left join frags x on r.rule = x.rule")
def noise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.noise_report(_issues(spark, sf_dir), read(spark, sf_dir, "docx_files"))


@query(f"with {_ISSUES} select fragment, n, regexp_matches(fragment, '^\\p{{Lu}}') as capital from (select fragment, count(*) as n from found where category = 'spelling' and fragment is not null group by 1) order by n desc, fragment limit 40")
def spelling_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.spelling_fragments(_issues(spark, sf_dir))


@query(f"with {_ISSUES} select issue_id, fragment from found")
def issue_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("issue_id", "fragment")


@query(f"with {_ISSUES} select file_id, count(*) as issues, count_if(level = 'error') as errors, count_if(level = 'warning') as warnings, count_if(level = 'hint') as hints from found group by 1")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.counts(read(spark, sf_dir, "issues").dropDuplicates(), ("file_id",))


@query(f"with {_ISSUES} select issue_id, rule_id, category from once where (category is null or category <> 'style') and (rule_id is null or rule_id not in ('typo.dash', 'lt:AGREE_X'))")
def issues_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.wanted(read(spark, sf_dir, "issues").dropDuplicates(), SETTINGS).select("issue_id", "rule_id", "category")


@query(f"""with {_ISSUES} select issue_id, number from (select issue_id, row_number() over (partition by file_id order by para, start_pos, end_pos,
case engine when 'rules' then 0 when 'user' then 0 when 'lt' then 1 when 'kk_spell' then 2 when 'ru_spell' then 2 else 9 end, issue_id) as number from once)""")
def issue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.in_order(read(spark, sf_dir, "issues").dropDuplicates().withColumn("seq", F.col("issue_id")), ("file_id",)).select("issue_id", "number")


@query(f"""with {_ISSUES}, p as (select unnest([{_list(PHRASES)}]) as phrase),
hit as (select distinct f.issue_id from found f, p, unnest(range(0, length(f.text) - length(p.phrase) + 1)) as u(i)
  where f.category = 'spelling' and contains(lower(f.text), p.phrase) and lower(substring(f.text, i + 1, length(p.phrase))) = p.phrase and i <= f.start_pos and f.end_pos <= i + length(p.phrase))
select issue_id from once where category = 'spelling' and issue_id not in (select issue_id from hit)""")
def phrases_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir).where("category = 'spelling'")
    none = spark.createDataFrame([], "entry string")
    return issues.without_accepted(found, none, PHRASES).select("issue_id")


@query(f"""with {_ISSUES} select o.rule_id, r.category as rule_category, r.lang, o.engine = r.engine as same_engine, count(*) as n from once o join rules r on o.rule_id = r.rule_id group by 1, 2, 3, 4""")
def issues_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = read(spark, sf_dir, "rules").select("rule_id", F.col("category").alias("rule_category"), "lang", F.col("engine").alias("rule_engine"))
    joined = sized_join(read(spark, sf_dir, "issues").dropDuplicates(), dim, ["rule_id"])
    return joined.groupBy("rule_id", "rule_category", "lang", (F.col("engine") == F.col("rule_engine")).alias("same_engine")).agg(F.count("*").alias("n"))


@query(f"""with recursive {_ISSUES}, o as (select issue_id, file_id, para, category, engine, start_pos as s, end_pos as e, case engine when 'rules' then 0 when 'user' then 0 when 'lt' then 1 when 'kk_spell' then 2 when 'ru_spell' then 2 else 9 end as p,
  row_number() over (partition by file_id, para, category order by issue_id) as k from once),
fold as (select file_id, para, category, k, [{{'id': issue_id, 's': s, 'e': e, 'p': p, 'g': engine}}] as kept from o where k = 1
  union all select o.file_id, o.para, o.category, o.k,
    case when coalesce(list_position(list_transform(f.kept, lambda x: x.s < o.e and o.s < x.e), true), 0) = 0 then list_append(f.kept, {{'id': o.issue_id, 's': o.s, 'e': o.e, 'p': o.p, 'g': o.engine}})
    when f.kept[list_position(list_transform(f.kept, lambda x: x.s < o.e and o.s < x.e), true)].p > o.p
      then list_concat(list_append(f.kept[:list_position(list_transform(f.kept, lambda x: x.s < o.e and o.s < x.e), true) - 1], {{'id': o.issue_id, 's': o.s, 'e': o.e, 'p': o.p, 'g': o.engine}}), f.kept[list_position(list_transform(f.kept, lambda x: x.s < o.e and o.s < x.e), true) + 1:])
    else f.kept end
  from fold f join o on o.file_id is not distinct from f.file_id and o.para is not distinct from f.para and o.category is not distinct from f.category and o.k = f.k + 1),
last as (select file_id, para, category, unnest(kept) as x from (select *, row_number() over (partition by file_id, para, category order by k desc) as r from fold) where r = 1)
select x.id as issue_id, file_id, para, category, x.g as engine from last""")
def issues_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "issues").dropDuplicates().withColumn("seq", F.col("issue_id")).drop("suggestions")
    return issues.without_overlaps(found, ("file_id", "para")).select("issue_id", "file_id", "para", "category", "engine")


_TITLES = {k: f"case {k} " + " ".join(f"when '{a}' then '{b}'" for a, b in v.items()) + f" else {k} end" for k, v in (("category", X.CATEGORY_TITLES), ("level", X.LEVEL_TITLES))}


@query(f"""with {_ISSUES} select issue_id, concat_ws(' | ', 'абзац ' || (para + 1), {_TITLES["category"]}, {_TITLES["level"]},
'«' || coalesce(fragment, '') || '»' || case when len(suggestions) > 0 then ' → ' || array_to_string(suggestions, ', ') else '' end, message) as line from found""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("issue_id", reports.report_line().alias("line"))


@query("""select para_id, r.start_pos, r.end_pos, r.bold, substring(text, r.start_pos + 1, r.end_pos - r.start_pos) as run from (select distinct para_id, text, unnest(runs) as r from paras)""")
def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = read(spark, sf_dir, "paras").select("para_id", "text", F.explode("runs").alias("r")).distinct()
    return exploded.select("para_id", "r.start_pos", "r.end_pos", "r.bold", issues.fragment(F.col("text"), F.col("r.start_pos"), F.col("r.end_pos")).alias("run"))


@query("""with once as (select distinct para_id, text, runs from paras), parts as (select para_id, i, substring(text, runs[i].start_pos + 1, runs[i].end_pos - runs[i].start_pos) as run from once, unnest(range(1, len(runs) + 1)) as u(i)),
w as (select para_id, cast(i - 1 as integer) as ord, cast(sum(length(run)) over (partition by para_id order by i) as integer) as end_pos, length(run) as n from parts where length(run) > 0)
select para_id, ord, cast(end_pos - n as integer) as start_pos, end_pos from w""")
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = read(spark, sf_dir, "paras").select("para_id", "text", "runs").distinct()
    runs = once.select("para_id", F.col("text").alias("_t"), F.posexplode("runs").alias("ord", "r")).select("para_id", "ord", issues.fragment(F.col("_t"), F.col("r.start_pos"), F.col("r.end_pos")).alias("text"))
    return edits.run_offsets(runs, ("para_id",)).select("para_id", "ord", "start_pos", "end_pos")


def _fixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typography fixes of the lines, found by the rules themselves, without overlaps."""
    lines = checkpointed(_lines(spark, sf_dir).withColumn("lang", F.lit("ru")))
    found = issues.without_overlaps(rules.rule_issues(lines, rules.TYPOGRAPHY))
    return lines, found.where(F.size("suggestions") > 0).select("doc_id", "para", "start_pos", "end_pos", F.col("suggestions")[0].alias("replacement"))


@query()
def fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, fixes = _fixes(spark, sf_dir)
    return edits.applied(lines, fixes)


@query("""with recursive lens as (select doc_id, row_number() over (partition by doc_id order by para) as k, para, length(text) as n from (select doc_id, cast(i - 1 as integer) as para, pieces[i] as text from (select doc_id, string_split(text, chr(10)) as pieces from documents where text is not null) d, unnest(range(1, len(pieces) + 1)) as u(i))),
packs as (select doc_id, k, para, n as size, 0 as batch from lens where k = 1
  union all select l.doc_id, l.k, l.para, case when p.size + 2 + l.n <= 2000 then p.size + 2 + l.n else l.n end, case when p.size + 2 + l.n <= 2000 then p.batch else p.batch + 1 end from packs p join lens l on l.doc_id = p.doc_id and l.k = p.k + 1)
select doc_id, para, batch from packs""")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.batch_numbers(corpus.paragraphs_of(read(spark, sf_dir, "documents")), 2_000)


_COURT = """courts as (select doc_id, min(court) as court from acts where court is not null group by 1),
d as (select documents.*, coalesce(c.court, case when contains(filename, '-') then upper(string_split(filename, '-')[1]) when filename is not null then '' end) as court from documents left join courts c on documents.doc_id = c.doc_id)"""
_WORDS = rf"""{_COURT},
t as (select doc_id, court, unnest(regexp_extract_all(text, '{_TOKEN}')) as word from d),
f as (select doc_id, court, word, count(*) as n from t where length(word) >= 3 and regexp_matches(word, '^[{X.LETTERS}]') and not regexp_matches(word, '[A-Za-z\p{{Nd}}]') group by 1, 2, 3),
starts as (select doc_id, unnest(regexp_extract_all(text, '(?m)(?:^|[.!?»]{_WS}+)([{X.LETTERS}]+(?:[-''’][{X.LETTERS}]+)*)', 1)) as word from d),
s as (select doc_id, word, count(*) as begun from starts group by 1, 2),
w as (select f.*, regexp_matches(f.word, '^\p{{Lu}}[^\p{{Lu}}]*\p{{Ll}}[^\p{{Lu}}]*$') and f.n > coalesce(s.begun, 0) as title, regexp_matches(f.word, '^[^\p{{Lu}}]*\p{{Ll}}[^\p{{Lu}}]*$') as small
  from f left join s on f.doc_id = s.doc_id and f.word = s.word)"""


def _corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_words(spread(corpus.with_court(read(spark, sf_dir, "documents"), read(spark, sf_dir, "acts"))))


@query(f"with {_WORDS} select word, count(*) as docs, count(distinct court) as courts from w where small group by 1 having count(*) >= 5 and count(distinct court) >= 3")
def lexicon_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lexicon_candidates(_corpus_words(spark, sf_dir))


@query(f"""with {_WORDS}, names as (select word, count(*) as docs, count(distinct court) as courts from w where title group by 1 having count(*) >= 3 and count(distinct court) >= 2),
low as (select word, count(*) as n from w where small group by 1)
select names.word, names.docs, names.courts from names left join low on lower(names.word) = low.word where coalesce(low.n, 0) <= 0.1 * names.docs""")
def corpus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_names(checkpointed(_corpus_words(spark, sf_dir)))


@query(f"with {_WORDS} select lower(word) as word, cast(sum(n) as bigint) as n from w group by 1 order by 2 desc, 1 limit 300")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stop_words(_corpus_words(spark, sf_dir))


_SHARE = "(length(text) - length(translate(text, 'әқңү', ''))) * 100.0 / length(text)"


@query(f"select doc_id, round({_SHARE}, 6) as share from documents where length(text) > 0")
def kk_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(corpus.kk_share(F.col("text")), 6).alias("share"))


@query(f"""select doc_id, lang, place from (select doc_id, lang, row_number() over (partition by lang order by md5('1' || doc_id), doc_id) as place from (
select doc_id, case when {_SHARE} > 1 then 'kk' else 'ru' end as lang from documents where length(text) between 4000 and 30000)) where place <= 60""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stratified_sample(read(spark, sf_dir, "documents"), {"ru": 60, "kk": 60}, "1")


_KNOWN = "known as (select word as form from w where small group by 1 having count(*) >= 3)"


# Compounds that the texts do not have, for both sides: of listed parts, of one part that no list has, with empty parts.
COMPOUNDS = ["иск-суд", "суд-", "-суд-иск-", "договор-суд-иск", "суд-ыыы", "суд"]
_COMPOUNDS = "(values " + ", ".join(f"('{w}')" for w in COMPOUNDS) + ") as fixture(word)"


@query(f"with {_WORDS}, {_KNOWN} select w.word, cast(sum(n) as bigint) as n from w anti join known k on lower(w.word) = k.form where small group by 1")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(_corpus_words(spark, sf_dir).where("lower"))
    known = corpus.lexicon_candidates(found, min_docs=3, min_courts=0).select(F.col("word").alias("_low"))
    return found.withColumn("_low", F.lower("word")).join(known, "_low", "left_anti").groupBy("word").agg(F.sum("n").alias("n"))


@query(f"""with {_WORDS}, {_KNOWN}, c as (select distinct word, list_filter(string_split(word, '-'), lambda x: x <> '') as parts from (select word from w union all select word from {_COMPOUNDS}) where contains(word, '-')),
p as (select word, unnest(parts) as part from c where len(parts) > 1)
select word from p left join known k on p.part = k.form group by word having bool_and(k.form is not null)""")
def compounds_of_known_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(_corpus_words(spark, sf_dir))
    known = corpus.lexicon_candidates(found, min_docs=3, min_courts=0).select(F.col("word").alias("form"))
    return corpus.known_by_parts(found.select("word").unionByName(spark.createDataFrame([(w,) for w in COMPOUNDS], "word string")), known)


def corpus_lists(spark: SparkSession, sf_dir: str) -> Resources:
    """Word lists mined from the collection itself, as both languages' dictionaries."""
    forms, proper = corpus.mined_lists(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "acts"))
    return Resources(ru=spell.Words("ru_spell", forms, names=proper), kk=spell.Words("kk_spell", forms, names=proper))


@query()
def checked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check of all documents, with word lists mined from them."""
    found = check(corpus.paragraphs_of(read(spark, sf_dir, "documents")), corpus_lists(spark, sf_dir))
    return found.groupBy("rule_id", "category", "level").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_LEVELS = ", ".join(f"count_if(level = '{level}') as {level}s" for level in ("error", "warning", "hint"))
_LINE = f"""concat_ws(' | ', 'абзац ' || (para + 1), {_TITLES["category"]}, {_TITLES["level"]},
'«' || coalesce(fragment, '') || '»' || case when len(suggestions) > 0 then ' → ' || array_to_string(suggestions, ', ') else '' end, message)"""


@query(f"""with {_ISSUES}, n as (select *, row_number() over (partition by file_id order by issue_id) as number from found),
r as (select file_id, count(*) as issues, {_LEVELS}, string_agg({_LINE}, chr(10) order by number) as body from n group by 1)
select file_id, file_id || ': ' || issues || ' замечаний (ошибок ' || errors || ', предупреждений ' || warnings || ', подсказок ' || hints || ')' || chr(10) || chr(10) || body as report from r""")
def document_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole report of every file, its issues in the order of their ids."""
    from pyspark.sql import Window

    numbered = _issues(spark, sf_dir).withColumn("number", F.row_number().over(Window.partitionBy("file_id").orderBy("issue_id")))
    return reports.document_reports(numbered, "file_id")


@query(f"""with {_ISSUES} select file_id, para, start_pos, end_pos, {_TITLES["category"]} || ': ' || message || case when len(suggestions) > 0 then ' → ' || array_to_string(suggestions[1:2], ', ') else '' end as comment
from (select f.*, p.where_in from found f left join (select file_id, para, min(where_in) as where_in from paras group by 1, 2) p on f.file_id = p.file_id and f.para = p.para) where where_in is null or where_in not in ('header', 'footer')""")
def issue_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "paras").groupBy("file_id", "para").agg(F.min("where_in").alias("where_in"))
    found = _issues(spark, sf_dir).join(places, ["file_id", "para"], "left").withColumn("where_in", F.coalesce("where_in", F.lit("body")))
    return reports.comments(found.withColumnRenamed("file_id", "doc_id")).withColumnRenamed("doc_id", "file_id")


_FIXES = "fixes as (select distinct file_id, para, start_pos, end_pos, suggestions[1] as replacement from once where category = 'typography' and len(suggestions) > 0 and start_pos is not null and end_pos is not null)"


@query(f"""with {_ISSUES}, {_FIXES}, m as (select o.issue_id, o.start_pos, o.end_pos, coalesce(bool_or(f.start_pos < o.end_pos and o.start_pos < f.end_pos), false) as hit,
  coalesce(sum(case when f.end_pos <= o.start_pos then length(f.replacement) - (f.end_pos - f.start_pos) end), 0) as delta
  from once o left join fixes f on o.file_id = f.file_id and o.para = f.para group by 1, 2, 3)
select issue_id, cast(start_pos + case when hit then 0 else delta end as integer) as start_pos, cast(end_pos + case when hit then 0 else delta end as integer) as end_pos, case when hit then 'closed' else 'open' end as status from m""")
def shifted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues after the first suggestions of the typographical ones were applied."""
    found = read(spark, sf_dir, "issues").dropDuplicates()
    fixes = found.where("category = 'typography' and size(suggestions) > 0 and start_pos is not null and end_pos is not null").select("file_id", "para", "start_pos", "end_pos", F.col("suggestions")[0].alias("replacement")).distinct()
    moved = edits.shifted(found.withColumn("status", F.lit("open")), fixes, ("file_id", "para"))
    return moved.select("issue_id", F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"), "status")


@query(f"""with {_ISSUES}, o as (select *, row_number() over (partition by file_id order by para, start_pos, end_pos, case engine when 'rules' then 0 when 'user' then 0 when 'lt' then 1 when 'kk_spell' then 2 when 'ru_spell' then 2 else 9 end, issue_id) as number from found),
s as (select *, case when number = 1 then 'skipped' when category = 'spelling' and lower(fragment) in (select distinct lower(fragment) from found f where f.file_id = o.file_id and f.category = 'spelling' and f.issue_id % 7 = 0) then 'closed' when rule_id = 'typo.dash' then 'closed' else 'open' end as status from o)
select issue_id, number, status from s""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of every file: its first issue skipped, words of every seventh issue added to a dictionary, one rule closed."""
    found = _issues(spark, sf_dir).withColumn("seq", F.col("issue_id")).withColumnRenamed("file_id", "doc_id")
    states = issues.skipped(issues.opened(found), found.select("doc_id", F.lit(1).alias("number")).distinct())
    added = found.where("category = 'spelling' and issue_id % 7 = 0").select("doc_id", F.col("fragment").alias("entry"))
    states = issues.closed_by_rule(issues.closed_by_word(states, added), "typo.dash")
    return states.select("issue_id", "number", "status")


# DuckDB counts bytes between words, so that letters of two bytes are written as one each.
_BYTES = "translate(lower({}), 'абвгдеёжзийклмнопрстуфхцчшщъыьэюяәғқңөұүһі', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop')"


@query(f"""with {_WORDS}, {_KNOWN}, u as (select distinct word, {_BYTES.format("word")} as b from w anti join known k on lower(w.word) = k.form where small), listed as (select form, {_BYTES.format("form")} as b from known),
near as (select u.word, f.form, row_number() over (partition by u.word order by levenshtein(u.b, f.b), f.form) as r
  from u join listed f on abs(length(u.b) - length(f.b)) <= 1 and (levenshtein(u.b, f.b) <= 1
    or length(u.b) = length(f.b) and exists (select 1 from unnest(range(1, length(u.b) + 1)) a(i), unnest(range(1, length(f.b) + 1)) c(j)
      where substring(u.b, 1, i - 1) || substring(u.b, i + 1) = substring(f.b, 1, j - 1) || substring(f.b, j + 1))))
select word, array_to_string(list(form order by r), ' ') as suggestions from near where r <= 5 group by word""")
def suggested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five known words one slip away from every unknown word of the texts."""
    found = checkpointed(_corpus_words(spark, sf_dir).where("lower"))
    known = checkpointed(corpus.lexicon_candidates(found, min_docs=3, min_courts=0).select(F.col("word").alias("form")))
    unknown = found.select("word", F.lower("word").alias("form")).join(known, "form", "left_anti").select("word").distinct()
    return spell.suggestions(unknown, known).select("word", F.array_join("suggestions", " ").alias("suggestions"))


@query(f"""with {_WORDS}, {_KNOWN}, q as (select distinct word from w), p as (select word, unnest(list_filter(regexp_split_to_array(word, '[-''’]'), lambda x: x <> '')) as part from q where regexp_matches(word, '[-''’]')),
parts as (select word, count(*) as n, bool_and(part in (select form from known)) as listed from p group by word)
select q.word, q.word in (select form from known) or (coalesce(parts.listed, false) and parts.n > 1) as accepted from q left join parts on q.word = parts.word""")
def accepted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership test of the spelling engine over every distinct word: in the list, or a compound of listed parts."""
    found = checkpointed(_corpus_words(spark, sf_dir))
    known = corpus.lexicon_candidates(found, min_docs=3, min_courts=0).select(F.col("word").alias("form"))
    return spell.accepted_words(found, spell.Words("ru_spell", known)).select("word", "accepted")


_EXPECTED = ", ".join("({}, '{}', {})".format(i, rule, "'" + fixed.replace("'", "''") + "'") for i, (rule, _, _, fixed) in enumerate(EXAMPLES) if fixed is not None)


@query(f"select * from (values {_EXPECTED}) as t(example, rule_id, fixed)")
def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's example sentences with the first fix applied: the expected texts are the literal rows of the SQL."""
    texts = spark.createDataFrame([(i, 0, text, lang, rule) for i, (rule, lang, text, _) in enumerate(EXAMPLES)], "doc_id int, para int, text string, lang string, example_rule string")
    found = rules.rule_issues(texts).join(texts.select("doc_id", "text", "example_rule"), "doc_id").where("rule_id = example_rule")
    first = found.groupBy("doc_id", "rule_id", "text").agg(F.min_by(F.struct("start_pos", "end_pos", "suggestions"), "seq").alias("x"))
    fixed = F.concat(F.substring("text", F.lit(1), F.col("x.start_pos")), F.get("x.suggestions", F.lit(0)), F.substring("text", F.col("x.end_pos") + 1, F.length("text")))
    return first.select(F.col("doc_id").alias("example"), "rule_id", F.when(F.size("x.suggestions") > 0, fixed).otherwise(FOUND).alias("fixed"))
