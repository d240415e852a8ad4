import io
import sqlite3
import zipfile

import pytest

from lexisteppe.operators import reports
from lexisteppe.sources import docx, lists
from lexisteppe.sources.sqlite import read_sqlite

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>'
RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="h" Target="header1.xml"/></Relationships>'


def _run(text, bold=False):
    return f'<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _p(*runs):
    return f"<w:p>{''.join(runs)}</w:p>"


def _file(body, header=None):
    out = io.BytesIO()
    section = '<w:sectPr><w:headerReference r:id="rId1"/></w:sectPr>' if header else ""
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}{section}</w:body></w:document>')
        if header:
            z.writestr("word/_rels/document.xml.rels", RELS)
            z.writestr("word/header1.xml", f'<?xml version="1.0"?><w:hdr {NS}>{header}</w:hdr>')
    return out.getvalue()


@pytest.fixture
def content():
    table = f"<w:tbl><w:tr><w:tc>{_p(_run('Я1'))}</w:tc><w:tc>{_p(_run('Я2'))}</w:tc></w:tr></w:tbl>"
    box = f"<w:p>{_run('Хозяин')}<w:r><w:pict><w:txbxContent>{_p(_run('Надпись'))}</w:txbxContent></w:pict></w:r></w:p>"
    link = f"<w:p>{_run('до ')}<w:hyperlink>{_run('ссылка')}</w:hyperlink><w:r><w:tab/><w:t>а</w:t><w:br/></w:r></w:p>"
    return _file(_p(_run("Жирный", True), _run(" и обычный")) + table + box + link, _p(_run("Шапка")))


def test_read(spark, tmp_path, content):
    (tmp_path / "б.docx").write_bytes(content)
    (tmp_path / "а.docx").write_bytes(b"no zip")
    (tmp_path / "~$б.docx").write_bytes(b"lock")
    rows = docx.read_docx(spark, str(tmp_path)).orderBy("path", "para").collect()
    assert rows[0].error and rows[0].text is None
    assert [(r.para, r.text, r.where_in) for r in rows[1:]] == [(0, "Жирный и обычный", "body"), (1, "Я1", "table"), (2, "Я2", "table"), (3, "Хозяин", "body"), (4, "Надпись", "textbox"), (5, "до ссылка\tа\n", "body"), (6, "Шапка", "header")]
    assert [(x.start_pos, x.end_pos, x.bold) for x in rows[1].runs] == [(0, 6, True), (6, 16, False)]


def test_corrected_and_annotated_copies(content):
    fixed = docx.corrected_bytes(content, [(0, 4, 8, "ое"), (6, 0, 5, "Новая"), (0, 0, 1, "ж")])
    texts = [t for _, t, _, _ in docx.paragraphs_of_bytes(fixed)]
    assert texts[0] == "жирное обычный" and texts[6] == "Новая" and texts[1:6] == [t for _, t, _, _ in docx.paragraphs_of_bytes(content)][1:6]
    noted = docx.annotated_bytes(content, [(0, 0, 3, "проверьте"), (6, 0, 2, "шапка")])
    assert [t for _, t, _, _ in docx.paragraphs_of_bytes(noted)] == [t for _, t, _, _ in docx.paragraphs_of_bytes(content)]
    with zipfile.ZipFile(io.BytesIO(noted)) as z:
        notes = z.read("word/comments.xml").decode()
    assert "проверьте" in notes and "шапка" not in notes
    with pytest.raises(ValueError):
        docx.corrected_bytes(content, [(0, 90, 95, "x")])


def test_lists(spark, tmp_path):
    p = tmp_path / "dict.txt"
    p.write_text("﻿# note\nСуд\n\nпо делу\nсуд\n", encoding="utf-8")
    words, phrases = lists.user_dictionary(spark, str(p))
    assert [r.entry for r in words.collect()] == ["суд"] and phrases == ["по делу"]
    assert lists.word_list(spark, str(tmp_path / "none.txt")).count() == 0
    assert not lists.added_entry(str(p), " СУД ") and lists.added_entry(str(p), "новое") and not lists.added_entry(str(p), " ")
    assert {r.form for r in lists.word_list(spark, str(p), lower=False).collect()} == {"Суд", "суд", "по делу", "новое"}
    (tmp_path / "off.txt").write_text("A # why\n#B\n\nC", encoding="utf-8")
    assert lists.disabled_rules(str(tmp_path / "off.txt")) == ["A", "C"] and lists.disabled_rules("none") == []


def _commented(content):
    """{comment id: the text between its marks}, over all runs of the main part in order."""
    from xml.etree import ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    inside, out = set(), {}
    for x in root.iter():
        if x.tag == docx.W + "commentRangeStart":
            inside.add(x.get(docx.W + "id"))
            out[x.get(docx.W + "id")] = ""
        elif x.tag == docx.W + "commentRangeEnd":
            inside.discard(x.get(docx.W + "id"))
        elif x.tag == docx.W + "r":
            for n in inside:
                out[n] += docx._run_text(x)
    return out


def test_comments_lie_around_exactly_their_spans(content):
    """Spans inside a run, over two runs, in a link, from a link on, over tabs and breaks, and touching or overlapping ones."""
    notes = [(0, 1, 3, "a"), (0, 4, 9, "b"), (5, 4, 6, "c"), (5, 7, 11, "d"), (5, 9, 12, "e"), (0, 3, 4, "f"), (0, 2, 8, "g"), (1, 0, 2, "h")]
    texts = [t for _, t, _, _ in docx.paragraphs_of_bytes(content)]
    noted = docx.annotated_bytes(content, notes)
    assert _commented(noted) == {str(n): texts[para][s:e] for n, (para, s, e, _) in enumerate(notes)}
    assert [t for _, t, _, _ in docx.paragraphs_of_bytes(noted)] == texts
    bold = [(r["text"], r["bold"]) for r in docx.paragraphs_of_bytes(noted)[0][3]]
    assert "".join(t for t, b in bold if b) == "Жирный" and "".join(t for t, b in bold if not b) == " и обычный"


def test_a_bad_entry_names_all_that_is_wrong(tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("- {найти: '(', уровень: x}\n- {найти: 'а*', сообщение: m, язык: de, категория: y}\n- 5\n- {найти: суд, сообщение: m, язык: null}\n", encoding="utf-8")
    rules, errors = lists.user_rules(str(p))
    assert [(r.id, r.lang, r.level, r.category) for r in rules] == [("user.4", "any", "warning", "style")]
    assert [e.count("«") for e in errors] == [3, 3, 0] and errors[0].startswith("entry 1: «найти»")


def test_user_rules(spark, tmp_path):
    from lexisteppe.operators.rules import rule_issues

    p = tmp_path / "r.yaml"
    p.write_text("- {id: a, найти: имеет место быть, заменить: есть, сообщение: m}\n- {найти: '(', сообщение: m}\n- {найти: x}\n- text\n- {id: e, найти: '(?P<n>суд)\\.(да)', заменить: '\\2', сообщение: m, уровень: ошибка, категория: грамматика, язык: ru}\n", encoding="utf-8")
    rules, errors = lists.user_rules(str(p))
    assert [r.id for r in rules] == ["user.a", "user.e"] and len(errors) == 3
    df = spark.createDataFrame([(1, 0, "Спор ИМЕЕТ место быть. Суд.да", "ru")], "doc_id int, para int, text string, lang string")
    assert sorted((r.rule_id, r.start_pos, r.suggestions[0], r.engine) for r in rule_issues(df, rules).collect()) == [("user.a", 5, "есть", "user"), ("user.e", 23, "да", "user")]
    p.write_text("a: [", encoding="utf-8")
    assert lists.user_rules(str(p))[0] == [] and len(lists.user_rules(str(p))[1]) == 1
    assert lists.user_rules("none") == ([], [])


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"sentence_words_limit": 40, "language": 5, "other": 1, "disabled_rules": ["x"]}', encoding="utf-8")
    s = lists.load_settings(str(p))
    assert (s.sentence_words_limit, s.language, s.disabled_rules) == (40, "auto", ["x"])
    lists.save_settings(str(p), s)
    assert lists.load_settings(str(p)) == s and lists.load_settings("none").sentence_words_limit == 60


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as con:
        con.execute('create table documents (id integer primary key, text text, "odd name" real)')
        con.executemany("insert into documents values (?, ?, ?)", [(i * 3, f"т{i}" if i % 2 else None, i / 2) for i in range(50)])
        con.execute("create table empty (id integer)")
    df = read_sqlite(spark, path, "documents", 4)
    assert sorted(tuple(r) for r in df.collect()) == [(i * 3, f"т{i}" if i % 2 else None, i / 2) for i in range(50)]
    assert read_sqlite(spark, path, "empty").count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, 0, 3, "spelling", "error", "суд", "m", ["сад", "сук"]), (1, 4, 2, 0, 2, "style", "hint", "да", "n", [])], "doc_id int, para int, number int, start_pos int, end_pos int, category string, level string, fragment string, message string, suggestions array<string>")
    report = reports.document_reports(df).first().report.split("\n")
    assert report[0].startswith("1: 2 ") and report[2:] == ["абзац 1 | Орфография | ошибка | «суд» → сад, сук | m", "абзац 5 | Стиль | подсказка | «да» | n"]
    assert '"fragment":"суд"' in reports.as_json(df).orderBy("value").collect()[0].value and reports.comments(df).count() == 2
    noise = spark.createDataFrame([("a", 3, 2, 0.4, True, "x|y"), ("b", 9, 1, 0.2, False, "")], "rule string, issues bigint, docs bigint, share double, flagged boolean, examples string")
    assert [r.line for r in reports.noise_markdown(noise, 5).collect()][2:] == ["| b | 9 | 1/5 (20 %) |  |", "| a | 3 | 2/5 (40 %) ⚠ | x¦y |"]
    (tmp_path / "f.docx").write_text("")
    first = reports.output_path(str(tmp_path / "f.docx"))
    first.write_text("")
    assert first.name == "f_проверено.docx" and reports.output_path(str(tmp_path / "f.docx")).name == "f_проверено (2).docx"


def test_stream(spark, tmp_path):
    from lexisteppe.streaming.check import check_stream

    spark.createDataFrame([(1, "иск - да"), (2, None), (3, "Суд  решил")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    check_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert {(r.doc_id, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out/issues")).collect()} == {(1, "typo.dash"), (3, "typo.double_space")}
    assert spark.read.parquet(str(tmp_path / "out/totals")).count() == 2
