"""Word files as tables of paragraphs, and annotated or corrected copies, with the standard library only."""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import arrow_map

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAIN = "word/document.xml"
RUN = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("text", pa.string()), ("bold", pa.bool_())])
SCHEMA = "path string, para int, text string, where_in string, runs array<struct<start_pos:int,end_pos:int,text:string,bold:boolean>>, error string"


def _piece(x: ET.Element) -> str:
    """The text that one element of a run stands for."""
    if x.tag == W + "t":
        return x.text or ""
    return {W + "tab": "\t", W + "ptab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}.get(x.tag, "")


def _run_text(run: ET.Element) -> str:
    return "".join(map(_piece, run))


def _runs(p: ET.Element) -> Iterator[ET.Element]:
    for x in p:
        if x.tag == W + "r":
            yield x
        elif x.tag == W + "hyperlink":
            yield from x.findall(W + "r")


def _bold(run: ET.Element) -> bool:
    mark = run.find(f"{W}rPr/{W}b")
    return mark is not None and mark.get(W + "val", "1") not in ("0", "false")


def _one(p: ET.Element) -> tuple[str, list[dict]]:
    text, runs = "", []
    for run in _runs(p):
        t = _run_text(run)
        if t:
            runs.append({"start_pos": len(text), "end_pos": len(text) + len(t), "text": t, "bold": _bold(run)})
            text += t
    return text, runs


def _walk(container: ET.Element, where: str) -> Iterator[tuple[ET.Element, str]]:
    """Paragraphs in reading order; those of text boxes after their host, cells of tables row by row."""
    for x in container:
        if x.tag == W + "p":
            yield x, where
            for box in x.iter(W + "txbxContent"):
                for p in box.findall(W + "p"):
                    yield p, "textbox"
        elif x.tag == W + "tbl":
            for row in x.findall(W + "tr"):
                for cell in row.findall(W + "tc"):
                    merged = cell.find(f"{W}tcPr/{W}vMerge")
                    if merged is None or merged.get(W + "val") == "restart":
                        yield from _walk(cell, "table")
        elif x.tag == W + "sdt":
            content = x.find(W + "sdtContent")
            if content is not None:
                yield from _walk(content, where)


def _parts(z: zipfile.ZipFile) -> Iterator[tuple[str, ET.Element, ET.Element, str]]:
    """(part name, its root, paragraph, where) of a whole file, headers and footers of the sections last."""
    root = ET.fromstring(z.read(MAIN))
    body = root.find(W + "body")
    for p, where in _walk(body if body is not None else root, "body"):
        yield MAIN, root, p, where
    try:
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    except KeyError:
        links = {}
    for section in root.iter(W + "sectPr"):
        for kind in ("header", "footer"):
            for ref in section.findall(f"{W}{kind}Reference"):
                if ref.get(W + "type", "default") == "default" and (target := links.get(ref.get(R + "id"))):
                    name = f"word/{target.lstrip('/').removeprefix('word/')}"
                    part = ET.fromstring(z.read(name))
                    for p in part.findall(W + "p"):
                        if _one(p)[0].strip():
                            yield name, part, p, kind


def paragraphs_of_bytes(content: bytes) -> list[tuple[int, str, str, list[dict]]]:
    """(para, text, where, runs) of one file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i, *_one(p)[:1], where, _one(p)[1]) for i, (_, _, p, where) in enumerate(_parts(z))]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of a Word file, or of the files directly in a folder; lock files are skipped.

    A file that is no Word document gives one row with ``error`` and null text; the others are read all the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "false").load(path).select("path", "content").where(~F.col("path").rlike(r"/(?:~|%7E)\$[^/]*$"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, i, text, where, runs, None) for i, text, where, runs in paragraphs_of_bytes(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, ValueError) as e:
                    rows.append((name, None, None, None, None, f"no Word document: {type(e).__name__}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(RUN), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "para", "text", "where_in", "runs", "error"])

    return arrow_map(files, kernel, SCHEMA, 8)


def _set_text(run: ET.Element, text: str) -> None:
    for x in list(run):
        if x.tag in (W + "t", W + "tab", W + "ptab", W + "br", W + "cr", W + "noBreakHyphen"):
            run.remove(x)
    t = ET.SubElement(run, W + "t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _replace(p: ET.Element, start: int, end: int, new: str) -> None:
    """Put new text for [start, end): the first run that it touches takes it, the others lose their share."""
    at, put = 0, False
    for run in _runs(p):
        t = _run_text(run)
        a, b = max(start, at), min(end, at + len(t))
        if t and (a < b or start == end and at <= start <= at + len(t) and not put):
            left, right = t[: a - at], t[b - at :]
            _set_text(run, left + ("" if put else new) + right)
            put = True
        at += len(t)
    if not put:
        raise ValueError("the span lies outside the paragraph's runs")


def corrected_bytes(content: bytes, fixes: list[tuple[int, int, int, str]]) -> bytes:
    """A copy of a file with fixes (para, start, end, replacement) applied; formatting stays that of the first run."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = list(_parts(z))
        roots = {name: root for name, root, _, _ in parts}
        for para, start, end, new in sorted(fixes, key=lambda f: (f[0], -f[1])):
            _replace(parts[para][2], start, end, new)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for item in z.infolist():
                target.writestr(item, ET.tostring(roots[item.filename], encoding="utf-8", xml_declaration=True) if item.filename in roots else z.read(item.filename))
    return out.getvalue()


def _keep(run: ET.Element, start: int, end: int) -> None:
    """Leave of a run's text only [start, end), with its properties and the other elements inside."""
    at = 0
    for x in list(run):
        text = _piece(x)
        a, b = max(start - at, 0), min(end - at, len(text))
        at += len(text)
        if not text or b - a == len(text):
            continue
        if a >= b:
            run.remove(x)
        else:  # only texts have more than one character
            x.text = text[a:b]
            x.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _cut(p: ET.Element, place: int) -> None:
    """Split the run of a paragraph that a place lies inside of; a run of a link is split inside the link."""
    at = 0
    parents = {id(r): q for q in (p, *p.findall(W + "hyperlink")) for r in q.findall(W + "r")}
    for run in list(_runs(p)):
        size = len(_run_text(run))
        if at < place < at + size:
            right = copy.deepcopy(run)
            _keep(run, 0, place - at)
            _keep(right, place - at, size)
            parent = parents[id(run)]
            parent.insert(list(parent).index(run) + 1, right)
            return
        at += size


def annotated_bytes(content: bytes, notes: list[tuple[int, int, int, str]], author: str = "Checker") -> bytes:
    """A copy with Word comments (para, start, end, comment) around exactly each span; headers and footers get none.

    Runs are split at the span's ends, their formatting is kept on both sides; a span may begin or end inside a link.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = list(_parts(z))
        roots = {name: root for name, root, _, _ in parts}
        comments = ET.Element(W + "comments")
        for n, (para, start, end, text) in enumerate(notes):
            name, _, p, where = parts[para]
            if where in ("header", "footer"):
                continue
            for place in (start, end):
                _cut(p, place)
            at, inside = 0, []
            parents = {id(r): q for q in (p, *p.findall(W + "hyperlink")) for r in q.findall(W + "r")}
            for run in _runs(p):
                size = len(_run_text(run))
                if size and at < end and start < at + size:
                    inside.append((parents[id(run)], run))
                at += size
            if not inside:
                continue
            (before, first), (behind, last) = inside[0], inside[-1]
            place = list(behind).index(last) + 1
            behind.insert(place, ET.Element(W + "commentRangeEnd", {W + "id": str(n)}))
            ref = ET.Element(W + "r")
            ET.SubElement(ref, W + "commentReference", {W + "id": str(n)})
            behind.insert(place + 1, ref)
            before.insert(list(before).index(first), ET.Element(W + "commentRangeStart", {W + "id": str(n)}))
            c = ET.SubElement(comments, W + "comment", {W + "id": str(n), W + "author": author})
            t = ET.SubElement(ET.SubElement(ET.SubElement(c, W + "p"), W + "r"), W + "t")
            t.text = text
        types = ET.fromstring(z.read("[Content_Types].xml"))
        ET.SubElement(types, types.tag.replace("Types", "Override"), {"PartName": "/word/comments.xml", "ContentType": "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"})
        rels_name = "word/_rels/document.xml.rels"
        rels = ET.fromstring(z.read(rels_name)) if rels_name in z.namelist() else ET.Element("{http://schemas.openxmlformats.org/package/2006/relationships}Relationships")
        ET.SubElement(rels, rels.tag.replace("Relationships", "Relationship"), {"Id": "rIdComments", "Type": "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments", "Target": "comments.xml"})
        changed = {name: root for name, root in roots.items()} | {"[Content_Types].xml": types, rels_name: rels, "word/comments.xml": comments}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for item in z.infolist():
                if item.filename not in changed:
                    target.writestr(item, z.read(item.filename))
            for name, root in changed.items():
                target.writestr(name, ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()
