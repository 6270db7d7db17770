"""Scans, fingerprints and parsers on files made here."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestack.sources import files, parsers


def packed(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


DOCX = packed(
    {
        "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First</w:t><w:tab/><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Last</w:t></w:r></w:p></w:body></w:document>',
        "word/header1.xml": '<w:hdr xmlns:w="w"><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>',
    }
)
XLSX = packed(
    {
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Second" r:id="rId2"/><sheet name="First" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>4.5</v></c></row><row r="2"/></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": '<worksheet xmlns="m"><sheetData><row r="3"><c r="A3"><f>SUM(B1:B2)</f><v>9</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    }
)
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
PPTX = packed({"ppt/slides/slide10.xml": SLIDE.format("ten"), "ppt/slides/slide2.xml": SLIDE.format("two"), "ppt/slides/_rels/slide2.xml.rels": '<Relationships xmlns="p"><Relationship Id="r" Target="../notesSlides/notesSlide1.xml"/></Relationships>', "ppt/notesSlides/notesSlide1.xml": SLIDE.format("note")})
ZIP = packed({"good.txt": "inner text", "../evil.txt": "x", "in.zip": packed({"deep.md": "deep", "deeper.zip": packed({"x.txt": "no"})})})


def texts(parser, data):
    return [b["raw_text"] for b in parser("p", data)]


def test_encodings():
    for text, encoding, name in (("中文内容" * 9, "gb18030", "gb18030"), ("<?xml?><a>x</a>", "utf-16-le", "utf-16-le"), ("ä", "utf-8", "utf-8"), ("x", "utf-8-sig", "utf-8-sig"), ("héllo", "utf-16", "utf-16"), ("", "ascii", "utf-8")):
        data = text.encode(encoding)
        assert parsers.detect_encoding(data) == name
        assert "".join(texts(parsers.parse_text, data)) == text


def test_text_blocks():
    got = list(parsers.parse_text("p", b"a\nb\r\nc\n", lines=2))
    assert [(b["location_text"], b["line_start"], b["line_end"], b["raw_text"]) for b in got] == [("第 1-2 行", 1, 2, "a\nb\r"), ("第 3-3 行", 3, 3, "c")]
    assert texts(parsers.parse_text, b"") == []


def test_office_formats():
    assert texts(parsers.parse_docx, DOCX) == ["First\tpara", "a | b", "Last", "Head"]
    got = list(parsers.parse_xlsx("p", XLSX))
    assert [(b["sheet_name"], b["raw_text"]) for b in got] == [("Second", "A3==SUM(B1:B2) | B3=TRUE | C3=in"), ("First", "A1=one | B1=4.5")]
    assert (got[0]["cell_start"], got[0]["cell_end"]) == ("A3", "C3")
    assert [(b["block_index"], b["slide_number"], b["raw_text"]) for b in parsers.parse_pptx("p", PPTX)] == [(0, 1, "two"), (1, 1, "note"), (2, 2, "ten")]


def test_html():
    assert parsers.html_text("<title>T</title><style>p{}</style><p>a &amp; <b>b</b></p><script>x</script><ul><li>c<li>d</ul>") == "T\na & b\nc\nd"


def test_archives():
    got = {name: status for _, name, _, _, status, _ in parsers.zip_members(ZIP)}
    assert got == {"good.txt": "", "../evil.txt": "failed", "in.zip > deep.md": "", "in.zip > deeper.zip": "skipped"}
    assert parsers.safe_member("a/../b") is None and parsers.safe_member("C:\\x") is None and parsers.safe_member("a\\b.txt") == "a/b.txt"
    info = zipfile.ZipInfo("说明书.txt".encode("gb18030").decode("cp437"))
    assert parsers.member_name(info) == "说明书.txt"


def test_parsing_never_fails_a_task(spark):
    cases = [("a.txt", ".txt", b"hello"), ("b.docx", ".docx", b"not a zip"), ("c.zip", ".zip", ZIP), ("d.pdf", ".pdf", b"%PDF"), ("e.png", ".png", b"x"), ("f.doc", ".doc", b"x"), ("g.mp4", ".mp4", b"x"), ("h.bin", ".bin", b"x"), ("i.xlsx", ".xlsx", XLSX)]
    df = spark.createDataFrame(cases, "path string, extension string, content binary")
    got = parsers.parse(df).collect()
    status = {r.path: (r.status, r.error_code) for r in got if r.block_index is None}
    assert status == {
        "a.txt": ("success", None), "b.docx": ("failed", "CORRUPT_FILE"), "c.zip": ("partial_success", "ZIP_MEMBER_FAILED"), "d.pdf": ("failed", "CORRUPT_FILE"), "e.png": ("ocr_disabled", "OCR_DISABLED"),
        "f.doc": ("converter_missing", "LEGACY_CONVERTER_MISSING"), "g.mp4": ("metadata_only", None), "h.bin": ("unsupported", "UNSUPPORTED"), "i.xlsx": ("success", None),
    }
    assert [(r.block_index, r.raw_text, r.block_type) for r in got if r.path == "c.zip" and r.block_index is not None] == [(0, "inner text", "zip_text"), (1, "deep", "zip_text")]
    plugin = parsers.Registry(pdf=lambda path, data: iter([{"block_type": "pdf_page", "location_text": "p1", "page_number": 1, "raw_text": "page"}]))
    assert parsers.parse(df.where("extension = '.pdf'"), plugin).where("block_index = 0").first().raw_text == "page"
    manifest = {r.path: r.status for r in parsers.zip_manifest(df).collect()}
    assert manifest["c.zip > good.txt"] == "pending" and manifest["c.zip > ../evil.txt"] == "failed"


def test_scan_and_keys(spark, tmp_path):
    for name, data in {"a.txt": b"same", "sub/b.txt": b"same", "sub/~$x.docx": b"", "c.tmp": b"", ".git/d.txt": b"", "e.unknown": b"", "f.docx": DOCX, "g.mp4": b"v", ".hidden.txt": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = files.with_content_key(files.scan(spark, str(tmp_path)))
    rows = {r.filename: r for r in found.collect()}
    assert set(rows) == {"a.txt", "b.txt", "f.docx", "g.mp4"}
    assert rows["a.txt"].content_key == rows["b.txt"].content_key != rows["g.mp4"].content_key
    assert [rows[n].content_key.split(":")[0] for n in ("a.txt", "f.docx", "g.mp4")] == ["sha256", "zipdir", "metadata"]
    assert {r.filename for r in files.scan(spark, str(tmp_path), recursive=False, content=False).collect()} == {"a.txt", "f.docx", "g.mp4"}
    later = found.withColumn("size_bytes", F.when(F.col("filename") == "a.txt", 99).otherwise(F.col("size_bytes"))).where("filename <> 'g.mp4'")
    assert {r.path.rsplit("/", 1)[-1] for r in files.source_changed(found, later).collect()} == {"a.txt", "g.mp4"}


def test_digests():
    assert files.zip_directory_digest(DOCX) != files.zip_directory_digest(XLSX) and files.zip_directory_digest(b"no") is None
    big = bytes(range(256)) * 100
    assert files.sampled_digest(big, 100) == files.sampled_digest(big, 100) != files.sampled_digest(big + b"x", 100)


def test_manifest_queries_settings(spark, tmp_path):
    head = ",".join(files.MANIFEST_COLUMNS)
    (tmp_path / "m.csv").write_text("﻿" + head + "\na,b,c,failed,E,\"x\ny\",p\n", encoding="utf-8")
    assert files.failure_manifest(spark, str(tmp_path / "m.csv")).first().parse_error_message == "x\ny"
    for bad in (head + "\n", "path,filename\na,b\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            files.failure_manifest(spark, str(tmp_path / "bad.csv"))
    assert files.query_list('{"queries": [" a ", "b", "a", ""]}') == files.query_list('["a", "b"]') == ["a", "b"]
    for bad in ("[]", '{"x": 1}', '[" "]'):
        with pytest.raises(ValueError):
            files.query_list(bad)
    s = files.Settings.from_dict({"version": 0, "lines_per_block": 7, "unknown": 1})
    assert (s.version, s.lines_per_block, s.max_zip_depth) == (1, 7, 2)


def stream(body: bytes, more: bytes = b"", packed: bool = True) -> bytes:
    data = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", more, data)


CMAP = b"1 beginbfchar <0001> <4E2D> endbfchar 2 beginbfrange <0002> <0003> <6587> <0010> <0011> [<0041> <00DF>] endbfrange"
FIRST = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\)) Tj 40 0 Td (world) Tj 0 -14 Td [(Sec) -20 (ond) -300 (li\156e)] TJ T* <E9> Tj ET"
SECOND = b"BT /F2 9 Tf 1 0 0 1 72 700 Tm <000100020003> Tj 1 0 0 1 72 650 Tm <001000110099> Tj ET q /I Do Q"
OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 3 /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
    8: b"<< /Type /Pages /Parent 2 0 R /Kids [9 0 R 12 0 R] >>",
    9: b"<< /Type /Page /Parent 8 0 R /Contents [10 0 R] /MediaBox [0 0 100 50.5] /Resources << /Font << /F2 6 0 R >> /XObject << /I 11 0 R >> >> >>",
    12: b"<< /Type /Page /Parent 8 0 R >>",
}
STREAMS = {4: stream(FIRST), 7: stream(CMAP), 10: stream(SECOND, packed=False), 11: stream(b"xx", b"/Type /XObject /Subtype /Image", packed=False)}


def classic(trailer: bytes = b"") -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in (OBJECTS | STREAMS).items()) + b"trailer << /Root 1 0 R %s >>\n%%%%EOF" % trailer


def compressed() -> bytes:
    heads, body = b"", b""
    for k, x in OBJECTS.items():
        heads += b"%d %d " % (k, len(body))
        body += x + b" "
    held = stream(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(OBJECTS), len(heads)))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in (STREAMS | {20: held, 21: stream(b"\0" * 6, b"/Type /XRef /Root 1 0 R /W [1 4 1]")}).items())


@pytest.mark.parametrize("data", [classic(), compressed()])
def test_pdf_pages(spark, data):
    want = ["Hello (PDF) world\nSecond line\né", "中文斈\nAß�", ""]
    df = spark.createDataFrame([("a.pdf", ".pdf", data), ("b.pdf", ".pdf", classic(b"/Encrypt 9 0 R")), ("c.pdf", ".pdf", b"%PDF-1.4 nothing")], "path string, extension string, content binary")
    rows = parsers.parse(df).collect()
    got = {r.block_index: (r.page_number, r.location_text, r.raw_text) for r in rows if r.path == "a.pdf" and r.block_index is not None}
    assert got == {0: (1, "第 1 页", want[0]), 1: (2, "第 2 页", want[1])}
    assert {r.path: (r.status, r.error_code) for r in rows if r.block_index is None} == {"a.pdf": ("success", None), "b.pdf": ("password_protected", "PASSWORD_PROTECTED"), "c.pdf": ("failed", "CORRUPT_FILE")}
    pages = parsers.pdf_pages(df).where("path = 'a.pdf'").orderBy("page").collect()
    assert [(p.width, p.height, p.images, p.is_scanned) for p in pages] == [(612.0, 792.0, 0, False), (100.0, 50.5, 1, True), (612.0, 792.0, 0, False)]
    assert len({p.identity for p in pages}) == 3


def test_broken_pdfs_are_rows(spark):
    """No cut of a file fails the job."""
    data = classic()
    df = spark.createDataFrame([(f"{k}.pdf", ".pdf", data[:k]) for k in range(0, len(data), 37)], "path string, extension string, content binary")
    assert parsers.parse(df).where("block_index is null").select("path").distinct().count() == df.count()
    parsers.pdf_pages(df).count()


def test_encodings_without_marks():
    assert parsers.detect_encoding("<?xml version='1.0'?>".encode("utf-16-le")) == "utf-16-le"
    assert parsers.detect_encoding("<?xml version='1.0'?>".encode("utf-16-be")) == "utf-16-be"
    assert parsers.detect_encoding("a\0b".encode()) == "utf-8"
