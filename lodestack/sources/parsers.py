"""Parsers: (path, content) to content blocks, one row each, plus one status row on failure.

All run inside `mapInArrow`; a file's error becomes a row with a code, never a
failed task. Formats that need outside software (OCR, legacy office conversion)
take plug-in functions and report their absence; a plug-in may replace the PDF
reader too.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars
from ..operators import geometry
from ..schemas import ARCHIVE_EXTENSIONS, IMAGE_EXTENSIONS, LEGACY_EXTENSIONS, PARSED, TEXT_EXTENSIONS, VIDEO_EXTENSIONS
from . import pdf

Block = dict
Parser = Callable[[str, bytes], Iterator[Block]]


class ParseError(Exception):
    def __init__(self, status: str, code: str, message: str = ""):
        super().__init__(message)
        self.status, self.code = status, code


def detect_encoding(sample: bytes) -> str:
    """Byte order mark, XML's first signs or zero-byte pattern of UTF-16, strict UTF-8, GB18030, a detector's choice if one is installed, else UTF-8."""
    if sample.isascii() and b"\0" not in sample:  # what most files are passes all tests up to UTF-8's
        return "utf-8"
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if sample.startswith(mark):
            return name
    head = sample[: len(sample) // 2 * 2]
    for name in ("utf-16-le", "utf-16-be"):
        if head.startswith("<?xml"[:4].encode(name)):
            return name
    if len(head) >= 8:
        even, odd = (head[i::2].count(0) / (len(head) // 2) for i in (0, 1))
        if odd >= 0.45 and even <= 0.10:
            return "utf-16-le"
        if even >= 0.45 and odd <= 0.10:
            return "utf-16-be"
    for name in ("utf-8", "gb18030"):
        try:
            codecs.getincrementaldecoder(name)("strict").decode(sample)  # a cut last character is no error
            return name
        except UnicodeDecodeError:
            continue
    try:
        from charset_normalizer import from_bytes
    except ModuleNotFoundError:
        return "utf-8"
    best = from_bytes(sample).best()
    return best.encoding if best and best.encoding and not best.encoding.startswith(("utf_16", "utf_32")) else "utf-8"


def parse_text(path: str, data: bytes, lines: int = 500, kind: str = "text") -> Iterator[Block]:
    text = data.decode(detect_encoding(data[: 64 << 10]), "replace")
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    for i in range(0, len(rows), lines):
        part = rows[i : i + lines]
        yield {"block_type": kind, "location_text": f"第 {i + 1}-{i + len(part)} 行", "line_start": i + 1, "line_end": i + len(part), "raw_text": "\n".join(part)}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _content(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """z.read(info); a plain or deflated member of a sound archive in memory is taken from its bytes without a reader's set-up."""
    data, at, end = z.fp.getbuffer(), info.header_offset, getattr(info, "_end_offset", None)
    if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not info.flag_bits & 0x61 and end is not None and 0 <= at <= len(data) - 30 and data[at : at + 4] == b"PK\3\4":
        n, more = struct.unpack_from("<HH", data, at + 26)
        name, start = bytes(data[at + 30 : at + 30 + n]), at + 30 + n + more
        if start + info.compress_size <= min(end, len(data)) and name == info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace"):
            body = data[start : start + info.compress_size]
            try:
                body = bytes(body) if info.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(body, info.file_size + 1)
            except zlib.error:
                body = b""
            if len(body) == info.file_size and zlib.crc32(body) == info.CRC:
                return body
    del data
    return z.read(info)


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        info = z.getinfo(name)
    except KeyError:
        return None
    return ET.XML(_content(z, info))


def natural_key(name: str) -> tuple:
    return tuple(int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name))


_WORD_MARKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _word_text(e: ET.Element) -> str:
    return "".join(x.text or "" if _tag(x) == "t" else _WORD_MARKS.get(_tag(x), "") for x in e.iter())


def parse_docx(path: str, data: bytes) -> Iterator[Block]:
    """Paragraphs and table rows in document order, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml")
        if body is None:
            raise ParseError("failed", "DOCX_NO_DOCUMENT")
        n = {"p": 0, "tr": 0}

        def walk(e: ET.Element) -> Iterator[Block]:
            for x in e:
                if _tag(x) == "p":
                    n["p"] += 1
                    if (text := _word_text(x)).strip():
                        yield {"block_type": "docx_paragraph", "location_text": f"段落 {n['p']}", "raw_text": text}
                elif _tag(x) == "tr":
                    n["tr"] += 1
                    cells = [t for c in x if _tag(c) == "tc" and (t := "\n".join(_word_text(p) for p in c.iter() if _tag(p) == "p").strip())]
                    if cells:
                        yield {"block_type": "docx_table_row", "location_text": f"表格行 {n['tr']}", "raw_text": " | ".join(cells)}
                else:
                    yield from walk(x)

        yield from walk(body)
        for name in sorted((i for i in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", i)), key=natural_key):
            for x in _xml(z, name).iter():
                if _tag(x) == "p" and (text := _word_text(x)).strip():
                    yield {"block_type": "docx_header_footer", "location_text": posixpath.basename(name)[:-4], "raw_text": text}


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    if root is None:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in root}


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def cell_text(cell: ET.Element, shared: list[str]) -> str:
    """A cell as text: its formula wins, then shared and inline strings, booleans, the value."""
    parts = {_tag(x): x for x in cell}
    if "f" in parts and (parts["f"].text or ""):
        return "=" + parts["f"].text
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in cell.iter() if _tag(x) == "t")
    value = parts["v"].text or "" if "v" in parts else ""
    if kind == "s" and value.isdigit() and int(value) < len(shared):
        return shared[int(value)]
    return {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value


def parse_xlsx(path: str, data: bytes) -> Iterator[Block]:
    """One block per row with values, `A1=value` joined, sheets in workbook order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _xml(z, "xl/workbook.xml")
        if book is None:
            raise ParseError("failed", "XLSX_NO_WORKBOOK")
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in strings] if strings is not None else []
        parts = _relations(z, "xl/workbook.xml")
        for sheet in (x for x in book.iter() if _tag(x) == "sheet"):
            root = _xml(z, parts.get(_attribute(sheet, "id"), ""))
            for row in () if root is None else (x for x in root.iter() if _tag(x) == "row"):
                cells = [(c.get("r") or "", t) for c in row if _tag(c) == "c" and (t := cell_text(c, shared)).strip()]
                if cells:
                    yield {"block_type": "xlsx_row", "location_text": f"{sheet.get('name')} 第 {row.get('r')} 行", "sheet_name": sheet.get("name"), "cell_start": cells[0][0], "cell_end": cells[-1][0], "raw_text": " | ".join(f"{r}={t}" for r, t in cells)}


def parse_pptx(path: str, data: bytes) -> Iterator[Block]:
    """Text, then notes of each slide, in the order of slide numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((i for i in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", i)), key=natural_key)
        for n, name in enumerate(slides, 1):
            notes = next((t for t in _relations(z, name).values() if "notesSlide" in t), None)
            for k, (part, kind, label) in enumerate(((name, "pptx_slide", "幻灯片"), (notes, "pptx_notes", "备注"))):
                root = _xml(z, part) if part else None
                lines = [] if root is None else ["".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in root.iter() if _tag(p) == "p"]
                if text := "\n".join(x for x in lines if x.strip()):
                    yield {"block_index": (n - 1) * 2 + k, "block_type": kind, "location_text": f"{label} {n}", "slide_number": n, "raw_text": text}


class _Html(HTMLParser):
    BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title", "section", "article", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip -= self.skip > 0 and tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_text(markup: str) -> str:
    """Visible text, one line per block element."""
    parser = _Html()
    parser.feed(markup)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def parse_html(path: str, data: bytes) -> Iterator[Block]:
    yield from parse_text(path, html_text(data.decode(detect_encoding(data[: 64 << 10]), "replace")).encode(), kind="html")


def parse_pdf(path: str, data: bytes) -> Iterator[Block]:
    """A block for each page with text; pages without are left to recognition."""
    try:
        for page in pdf.read(data):
            if page["text"].strip():
                yield {"block_type": "pdf_page", "location_text": f"第 {page['page']} 页", "page_number": page["page"], "block_index": page["page"] - 1, "raw_text": page["text"]}
    except pdf.Encrypted as e:
        raise ParseError("password_protected", "PASSWORD_PROTECTED", str(e)) from e
    except pdf.PdfError as e:
        raise ParseError("failed", "CORRUPT_FILE", str(e)) from e


#: Files read from, and rows and characters written to, an Arrow batch at a time.
FILES, ROWS, CHARS = 256, 2000, 16 << 20


def _each(files: DataFrame, rows_of: Callable[..., list[tuple]], schema: T.StructType | str) -> DataFrame:
    """The rows of each file: rows_of takes the columns of files, in order."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def column(values: tuple, field: pa.Field) -> pa.Array:
        if pa.types.is_map(field.type):
            values = [x.items() if isinstance(x, dict) else x for x in values]
        elif not pa.types.is_string(field.type):
            values = [None if x != x else x for x in values]  # NaN stands for none
        return pa.array(values, field.type)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(values, field) for values, field in zip(zip(*rows), arrow)], schema=arrow)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            size = 0
            for k in range(0, part.num_rows, FILES):
                for file in zip(*(c.to_pylist() for c in part.slice(k, FILES).columns)):
                    for row in rows_of(*file):
                        rows.append(row)
                        size += sum(len(x) for x in row if type(x) is str)
                        if len(rows) >= ROWS or size >= CHARS:
                            yield batch(rows)
                            rows, size = [], 0
            if rows:
                yield batch(rows)

    return files.mapInArrow(run, kind)


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page, width, height, images, text, identity and is_scanned of every page of PDF files (path, content)."""

    schema = "path string, page int, width double, height double, images int, text string"

    def run(path: str, data: bytes) -> list[tuple]:
        try:
            return [(path, *page.values()) for page in pdf.read(data)]
        except Exception:  # parse() tells its status
            return []

    pages = _each(files.select("path", "content"), run, schema)
    own = scalars.page_identity(*(F.col(c) for c in ("page", "width", "height", "images", "text")))
    return pages.withColumns({"identity": own, "is_scanned": geometry.scanned_page(F.col("text"), F.col("images") > 0)})


def safe_member(name: str) -> str | None:
    """A member's normal path; None for absolute paths, drives and ways upwards."""
    clean = name.replace("\\", "/")
    if clean.startswith("/") or re.match(r"[A-Za-z]:", clean) or ".." in clean.split("/"):
        return None
    return posixpath.normpath(clean)


def member_name(info: zipfile.ZipInfo) -> str:
    """Name of a member; old archives' bytes are read as GB18030 where that gives readable text."""
    if info.flag_bits & 0x800 or info.filename.isascii():
        return info.filename
    try:
        raw = info.filename.encode("cp437")
    except UnicodeEncodeError:
        return info.filename
    best = info.filename
    for name in ("utf-8", "gb18030"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if _readable(text) > _readable(best):
            best = text
    return best


def _readable(text: str) -> int:
    good = sum("一" <= c <= "鿿" or c.isascii() and c.isprintable() for c in text)
    return good * 2 - len(text)


def zip_members(data: bytes, depth: int = 2, most: int = 10_000, most_bytes: int = 512 << 20, inside: str = "") -> Iterator[tuple[int, str, int, int, str, bytes | None]]:
    """(index, path, size, crc, status, content) of each member, nested archives included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > most:
            raise ParseError("skipped", "ZIP_TOO_MANY_MEMBERS")
        for k, info in enumerate(infos):
            path = safe_member(member_name(info))
            status = "failed" if path is None else "password_protected" if info.flag_bits & 1 else "skipped" if info.file_size > most_bytes else ""
            shown = inside + (path or info.filename)
            if status:
                yield k, shown, info.file_size, info.CRC, status, None
                continue
            content = _content(z, info)
            if path.lower().endswith(".zip"):
                if depth <= 1:
                    yield k, shown, info.file_size, info.CRC, "skipped", None
                else:
                    try:
                        yield from zip_members(content, depth - 1, most, most_bytes, shown + " > ")
                    except zipfile.BadZipFile:
                        yield k, shown, info.file_size, info.CRC, "failed", None
            else:
                yield k, shown, info.file_size, info.CRC, "", content


def zip_manifest(files: DataFrame) -> DataFrame:
    """path (`archive > member`), container, internal_path, member_order, size, crc32, status of each member."""
    schema = "path string, container string, internal_path string, member_order long, size_bytes long, crc32 long, status string"

    def run(path: str, data: bytes) -> list[tuple]:
        try:
            return [(f"{path} > {name}", path, name, k, size, crc, status or "pending") for k, name, size, crc, status, _ in zip_members(data)]
        except (zipfile.BadZipFile, ParseError):
            return [(path, path, "", -1, len(data), 0, "failed")]

    return _each(files.where(F.col("extension").isin(ARCHIVE_EXTENSIONS)).select("path", "content"), run, schema)


class Registry:
    """Chooses a parser by extension; plug-ins: pdf, ocr, legacy (path, bytes) -> blocks."""

    def __init__(self, **plugins: Parser):
        self.plugins = plugins

    def parser_for(self, extension: str) -> Parser:
        if extension in TEXT_EXTENSIONS:
            return parse_text
        known = {".docx": parse_docx, ".xlsx": parse_xlsx, ".xlsm": parse_xlsx, ".pptx": parse_pptx, ".html": parse_html, ".htm": parse_html, ".zip": self.parse_zip, ".pdf": self.plugins.get("pdf", parse_pdf)}
        if extension in known:
            return known[extension]
        for group, name, status in ((IMAGE_EXTENSIONS, "ocr", "ocr_disabled"), (LEGACY_EXTENSIONS, "legacy", "converter_missing")):
            if extension in group:
                return self.plugins.get(name) or _absent(status, f"{name.upper()}_CONVERTER_MISSING" if status == "converter_missing" else "OCR_DISABLED")
        return _absent("metadata_only", None) if extension in VIDEO_EXTENSIONS else _absent("unsupported", "UNSUPPORTED")

    def identity(self, extension: str) -> tuple[str, str]:
        """Name and version of the parser: what a cached result depends on."""
        parser = self.parser_for(extension)
        return getattr(parser, "__name__", "plugin"), "1" + ("+plugins:" + ",".join(sorted(self.plugins)) if self.plugins else "")

    def parse_zip(self, path: str, data: bytes) -> Iterator[Block]:
        failed = 0
        for _, name, _, _, status, content in zip_members(data):
            if status:
                failed += status == "failed"
                continue
            try:
                for b in self.parser_for(_extension(name))(name, content):
                    yield {**b, "block_type": "zip_text" if b["block_type"] == "text" else b["block_type"], "location_text": f"{name} > {b['location_text']}", "block_index": None}
            except (ParseError, zipfile.BadZipFile, ET.ParseError, KeyError):
                failed += 1
        if failed:
            raise ParseError("partial_success", "ZIP_MEMBER_FAILED", f"{failed} members")


def _extension(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def _absent(status: str, code: str | None) -> Parser:
    def parse(path: str, data: bytes) -> Iterator[Block]:
        raise ParseError(status, code)
        yield

    return parse


def parse(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Blocks (PARSED) of files (path, extension, content); a file without blocks gives its status row.

    In a status row block_index is null; partial results keep their blocks
    beside it. Every block of a file has its final status in the status row only.
    """
    registry = registry or Registry()
    names = PARSED.fieldNames()

    def one(path: str, ext: str, data: bytes) -> list[dict]:
        rows: list[dict] = []
        status, code, message = "success", None, None
        try:
            for b in registry.parser_for(ext)(path, data):
                rows.append({"path": path, "source_type": "native_text", **b, "block_index": b["block_index"] if b.get("block_index") is not None else len(rows), "status": "success"})
        except ParseError as e:
            status, code, message = e.status, e.code, str(e)[:1000] or None
        except (zipfile.BadZipFile, ET.ParseError, zlib.error) as e:
            status, code, message = "failed", "CORRUPT_FILE", str(e)[:1000]
        except MemoryError:
            status, code = "failed_retryable", "OUT_OF_MEMORY"
        except Exception as e:  # a parser's own fault is a row, not a lost job
            status, code, message = "failed", "PARSE_ERROR", f"{type(e).__name__}: {e}"[:1000]
        return [*rows, {"path": path, "status": status, "error_code": code, "error_message": message}]

    return _each(files.select("path", "extension", "content"), lambda *file: [tuple(map(row.get, names)) for row in one(*file)], PARSED)
