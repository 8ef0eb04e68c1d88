"""Sinks: delimited text, JSON, fixed width, XLSX, SVG network, methods text, encryption.

Directory sinks are distributed.  Single-file sinks are for reports; they take
tables that a limit or an aggregate has made small, and refuse more than ``MOST_ROWS``.
"""

from __future__ import annotations

import csv
import io
import json
import math
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; infinities become null."""
    fixed = [F.when(F.abs(c) == float("inf"), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).write.mode("overwrite").json(path)


def write_tokens(tokens_df: DataFrame, path: str) -> None:
    """The token table, a folder for each corpus and version, sorted within files for pruning."""
    tokens_df.sortWithinPartitions("doc_id", "sentence_idx", "token_idx").write.mode("append").partitionBy("corpus", "version_id").parquet(path)


def report_rows(df: DataFrame) -> tuple[list[str], list[list]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows; use a directory sink")
    return df.columns, [list(r) for r in rows]


def to_csv(headers: list[str], rows: list[list], sep: str = ",", bom: bool = False) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow(headers)
    writer.writerows(rows)
    return (b"\xef\xbb\xbf" if bom else b"") + out.getvalue().encode()


def to_fixed_width(headers: list[str], rows: list[list]) -> bytes:
    cells = [[str("" if c is None else c) for c in r] for r in rows]
    widths = [min(50, 2 + max(len(x[i]) for x in [headers, *cells])) for i in range(len(headers))]
    line = lambda r: "".join(c[: w - 1].ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(headers), "-" * sum(widths), *map(line, cells), ""]).encode()


def to_json(headers: list[str], rows: list[list]) -> bytes:
    clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps([{h: clean(v) for h, v in zip(headers, r, strict=True)} for r in rows], ensure_ascii=False, default=str).encode()


def to_xlsx(headers: list[str], rows: list[list], sheet: str = "Sheet1") -> bytes:
    """A minimal workbook: bold header, column widths from the first 200 rows."""

    def cell(v, style: int = 0) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
            return f'<c s="{style}"><v>{v}</v></c>'
        return f'<c t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str("" if v is None else v))}</t></is></c>'

    widths = [min(60, 2 + max(len(str(r[i])) for r in [headers, *rows[:200]])) for i in range(len(headers))]
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    body = "".join("<row>" + "".join(cell(v, int(k == 0)) for v in r) + "</row>" for k, r in enumerate([headers, *rows]))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31], {chr(34): ""})}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><cols>{columns}</cols><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


WRITERS: dict[str, Callable[[list[str], list[list]], bytes]] = {
    "csv": to_csv,
    "tsv": lambda h, r: to_csv(h, r, "\t"),
    "txt": to_fixed_width,
    "json": to_json,
    "xlsx": to_xlsx,
}


def serialize(fmt: str, headers: list[str], rows: list[list]) -> bytes:
    if fmt not in WRITERS:
        raise ValueError(f"unknown export format {fmt!r}")
    return WRITERS[fmt](headers, rows)


def to_lst(counts: list[tuple[str, int, float]], corpus: str, total: int) -> bytes:
    """Frequency list with three comment lines, a header and four columns."""
    lines = ["# frequency list", f"# corpus: {corpus}", f"# tokens: {total}", "word\tfreq\tper_million\trank"]
    lines += [f"{w}\t{f}\t{p}\t{i}" for i, (w, f, p) in enumerate(counts, 1)]
    return ("\n".join(lines) + "\n").encode()


def network_svg(node: str, layout: list[dict], size: int = 800) -> str:
    """Collocates on a circle around their node, from ``association.network_layout`` rows."""
    c, r = size / 2, size * 0.38
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">']
    for p in layout:
        x, y = c + r * p["x"], c + r * p["y"]
        parts.append(f'<line x1="{c}" y1="{c}" x2="{x:.1f}" y2="{y:.1f}" stroke="#888" stroke-width="{p["edge_width"]}"/>')
        parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{p["radius"]}" fill="#cde"/><text x="{x:.1f}" y="{y:.1f}" text-anchor="middle">{escape(p["collocate"])}</text>')
    parts.append(f'<circle cx="{c}" cy="{c}" r="32" fill="#fda"/><text x="{c}" y="{c}" text-anchor="middle">{escape(node)}</text></svg>')
    return "".join(parts)


def methods_text(corpus: str, recipe: dict, stats: dict) -> str:
    """A methods section in Markdown."""
    lines = [f"# Methods: {corpus}", "", "## Pipeline", *(f"- {k}: {v}" for k, v in recipe.items()), "", "## Corpus", *(f"- {k}: {v}" for k, v in stats.items()), ""]
    return "\n".join(lines)


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with its nonce in front; passes through where the key is null."""
    return F.when(key.isNotNull(), F.aes_encrypt(value, key, F.lit("GCM"))).otherwise(value.cast("binary"))


def decrypt(value: Column, key: Column) -> Column:
    return F.when(key.isNotNull(), F.aes_decrypt(value, key, F.lit("GCM"))).otherwise(value)
