"""Word documents: body paragraphs, then tables, then headers and footers, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import CELL_SEPARATOR, DOCX_NOISE, ROW_SEPARATOR
from plumbline.functions.text import repair_python

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def inline(text: str) -> str:
    value = re.sub(r"[ \t]+", " ", repair_python(text).replace("\x00", " "))
    return re.sub(r"\n{3,}", "\n\n", value).strip()


def is_noise(text: str) -> bool:
    plain = re.sub(r"\s+", " ", inline(text).lower().replace("–", "-").replace("—", "-")).strip()
    return not plain or any(re.search(p, plain) for p in DOCX_NOISE)


def _settled(items: list[str]) -> list[str]:
    """Without empty ones and repeats, white space as single blanks."""
    compact = (" ".join(re.split(r"\s+", x)).strip() for x in items)
    return list(dict.fromkeys(x for x in compact if x))


def _text(paragraph: ET.Element) -> str:
    """Runs directly in the paragraph or in its links; what is struck by revision marks is not there."""
    out = []
    for child in paragraph:
        for run in [child] if child.tag == f"{W}r" else child.iter(f"{W}r") if child.tag == f"{W}hyperlink" else []:
            for node in run:
                out.append({f"{W}t": node.text or "", f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}.get(node.tag, ""))
    return "".join(out)


def _kept(paragraphs: list[ET.Element]) -> list[str]:
    texts = [inline(_text(p)) for p in paragraphs]
    return [x for x in texts if x and not is_noise(x)]


def _grid(row: ET.Element, above: dict[int, ET.Element]) -> list[ET.Element]:
    """A row's cells by grid column: wide cells stand several times, cells merged downward are those above."""
    cells, column = [], 0
    for cell in row.iter(f"{W}tc"):
        if cell not in list(row):
            continue
        width = cell.find(f"{W}tcPr/{W}gridSpan")
        merge = cell.find(f"{W}tcPr/{W}vMerge")
        for _ in range(int(width.get(f"{W}val", "1")) if width is not None else 1):
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and column in above:
                cells.append(above[column])
            else:
                above[column] = cell
                cells.append(cell)
            column += 1
    return cells


def extract(content: bytes) -> str:
    """The text of a document, one chunk a line, the first of equal chunks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        chunks = _kept(body.findall(f"{W}p"))
        for table in body.findall(f"{W}tbl"):
            above: dict[int, ET.Element] = {}
            for row in table.findall(f"{W}tr"):
                cells = [CELL_SEPARATOR.join(_settled(_kept(c.findall(f"{W}p")))) for c in _grid(row, above)]
                if line := ROW_SEPARATOR.join(_settled(cells)):
                    chunks.append(line)
        names = set(z.namelist())
        targets = {}
        if "word/_rels/document.xml.rels" in names:
            targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
        for section in body.iter(f"{W}sectPr"):
            for kind in ("headerReference", "footerReference"):
                for ref in section.findall(f"{W}{kind}"):
                    part = f"word/{targets.get(ref.get(f'{R}id'), '')}"
                    if ref.get(f"{W}type", "default") == "default" and part in names:
                        chunks += _kept(ET.fromstring(z.read(part)).findall(f"{W}p"))
    return "\n".join(_settled(chunks))


def documents(found: DataFrame, doc_type: str) -> DataFrame:
    """``(case_id, doc_type, path, raw_text, error)`` of files as ``sources.files`` lists them; what cannot be read has an error instead of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for content in b.column("content").to_pylist():
                try:
                    texts.append(extract(content))
                    errors.append(None)
                except Exception as e:  # any broken file is a finding about that file, not a failure of the scan
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("folder"), b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["case_id", "path", "raw_text", "error"])

    read = found.select("folder", "path", "content").mapInArrow(run, "case_id string, path string, raw_text string, error string")
    return read.select("case_id", F.lit(doc_type).alias("doc_type"), "path", "raw_text", "error")
