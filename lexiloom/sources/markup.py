"""Text of uploaded files: format detection, decoding, HTML, TEI, DOCX, Markdown, CSV.

Files come from ``binaryFile``; parsers that need a tree run as one function over
Arrow batches, the others are column expressions.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("txt", "docx", "pdf", "html", "xml", "csv", "md")


def detect_format(path: Column) -> Column:
    """Lower-case format by extension, htm as html; null for what is not supported."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    ext = F.when(ext == "htm", "html").otherwise(ext)
    return F.when(ext.isin(*FORMATS), ext)


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """Text and encoding: by byte-order mark, then UTF-8, then Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, errors="replace"), name
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        try:
            return raw.decode("cp1252"), "cp1252"
        except UnicodeDecodeError:
            return raw.decode("utf-8", errors="replace"), "utf-8"


def parsed_xml(source: str | bytes) -> ElementTree.Element:
    """The root of an XML document; one that declares entities is refused, as they may expand without bound."""

    def refuse(*_):
        raise ValueError("XML with entity declarations")

    scan = expat.ParserCreate()
    scan.EntityDeclHandler = refuse
    try:
        scan.Parse(source, True)
    except expat.ExpatError:
        pass  # said again, with its place, by the parser below
    return ElementTree.fromstring(source)


def tidy(text: str) -> str:
    """Composed, LF line ends, no zero-width characters, at most one blank line in a row, trimmed."""
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub("[​‌‍﻿]", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


class PageText(HTMLParser):
    """Text lines of a page, of its article, main or body if one has text."""

    SKIP = {"script", "style", "noscript"}
    ROOTS = ("article", "main", "body")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.open: list[str] = []
        self.parts: dict[str, list[str]] = {k: [] for k in (*self.ROOTS, "")}

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.ROOTS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        for k in {*self.open, ""}:
            self.parts[k].append(data.strip())

    def text(self) -> str:
        for k in (*self.ROOTS, ""):
            if self.parts[k]:
                return "\n".join(self.parts[k])
        return ""


def html_text(html: str) -> str:
    page = PageText()
    page.feed(html)
    page.close()
    return tidy(page.text())


PARAGRAPHS, LINES, WORDS, BREAKS = {"p", "div", "head", "section", "article"}, {"s", "seg", "u"}, {"w", "token"}, {"lb", "pb", "br"}


def tei_text(source: str) -> str:
    """Running text of a TEI-like document without its header."""

    def name(e) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    out: list[str] = []

    def walk(e) -> None:
        tag = name(e)
        if tag == "teiHeader":
            return
        if tag in BREAKS:
            out.append("\n")
        if e.text:
            out.append(e.text)
        for child in e:
            walk(child)
            if child.tail:
                out.append(child.tail)
        out.append("\n\n" if tag in PARAGRAPHS else "\n" if tag in LINES else " " if tag in WORDS else "")

    root = parsed_xml(source)
    found = next((e for wanted in ("body", "text", "doc") for e in root.iter() if name(e) == wanted), root)
    walk(found)
    return tidy(re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(out))))


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table cells, joined by blank lines."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = parsed_xml(z.read("word/document.xml")).find(f"{ns}body")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t")).strip()
    parts = [plain(p) for p in body.findall(f"{ns}p")] + [plain(c) for c in body.iter(f"{ns}tc")]
    return tidy("\n\n".join(p for p in parts if p))


def csv_text(text: str) -> str:
    """Non-blank cells of the column ``text``, or of the first, one a line."""
    import csv

    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return ""
    at = rows[0].index("text") if "text" in rows[0] else 0
    return tidy("\n".join(r[at] for r in rows[1:] if len(r) > at and r[at].strip()))


def markdown_text(text: str) -> str:
    lines = [re.sub(r"^\s*#+\s*", "", line) for line in text.split("\n") if not line.lstrip().startswith("```")]
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", "\n".join(lines))
    return tidy(re.sub(r"\*\*|__|\*|_|`", "", text))


#: Parsers by format; PDF needs a library that is not assumed and can be added here.
PARSERS = {
    "txt": lambda raw: tidy(decode_bytes(raw)[0]),
    "md": lambda raw: markdown_text(decode_bytes(raw)[0]),
    "html": lambda raw: html_text(decode_bytes(raw)[0]),
    "xml": lambda raw: tei_text(decode_bytes(raw)[0]),
    "csv": lambda raw: csv_text(decode_bytes(raw)[0]),
    "docx": docx_text,
}


def parse_files(files: DataFrame) -> DataFrame:
    """(path, format, text, error) of a binaryFile table; a file that fails has null text and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for fmt, raw in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    texts.append(PARSERS[fmt](raw))
                    errors.append(None)
                except Exception as e:  # a damaged file must not end the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("format"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "format", "text", "error"])

    return files.select("path", detect_format(F.col("path")).alias("format"), "content").mapInArrow(run, "path string, format string, text string, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, genre, text) of the members of tar.gz and zip corpora.

    Sentence files of tar archives give a document a line (second tab column), zip
    members one each, with their folder as genre.  No member is left out.
    """
    import tarfile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                if raw[:2] == b"\x1f\x8b":
                    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:gz") as tar:
                        for m in tar:
                            if m.isfile() and m.name.endswith("-sentences.txt"):
                                for line in decode_bytes(tar.extractfile(m).read())[0].split("\n"):
                                    cells = line.split("\t")
                                    if len(cells) > 1 and cells[1].strip():
                                        rows.append((path, m.name, None, tidy(cells[1])))
                elif raw[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for n in z.namelist():
                            fmt = n.rpartition(".")[2].lower()
                            if fmt in ("txt", "xml"):
                                rows.append((path, n, n.rpartition("/")[0].rpartition("/")[2] or None, PARSERS[fmt](z.read(n))))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "name", "genre", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, genre string, text string")
