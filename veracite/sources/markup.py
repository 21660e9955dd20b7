"""XML parts, HTML pages and PDF files as rows or text.

Mixed content (text with inline elements) must keep its order, so XML is read by a parser in Arrow batches, one file at a
time; all that follows (markers, subsections, citations) is left to Catalyst. Extracting text needs no third-party parser
for XML and HTML; PDF needs pypdf.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import HTML_DROPPED
from ..session import reachable
from .files import whole_texts


def _flat(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _citation(section: ET.Element, otherwise: str) -> str:
    try:
        return json.loads(section.get("hierarchy_metadata") or "{}").get("citation", otherwise)
    except (ValueError, AttributeError):
        return otherwise


def section_paragraphs(xml: str, source_id: str) -> Iterator[tuple]:
    """The paragraphs of every section of a part, in document order (those of footnotes too); other documents have none."""
    part = ET.fromstring(xml)
    own = (source_id, part.get("N", ""), _flat(part.find("HEAD")))
    sections = (s for s in part.iter("DIV8") if s.get("TYPE") == "SECTION")
    for i, s in enumerate(sections):
        place = (i, s.get("N", ""), _flat(s.find("HEAD")), _citation(s, f"{own[1]} {s.get('N', '')}"))
        for j, p in enumerate(s.iter("P")):
            if text := _flat(p):
                yield (*own, *place, j, text)


def parts(spark: SparkSession, folder: str, skip_broken: bool = False) -> DataFrame:
    """PARAGRAPH rows of all .xml files of a folder. A file that isn't well-formed raises, or is left out with skip_broken."""
    reachable(spark)
    kinds = [pa.int32() if x.split()[1] == "int" else pa.string() for x in schemas.PARAGRAPH.split(", ")]
    names = [x.split()[0] for x in schemas.PARAGRAPH.split(", ")]

    def run(batches):
        for b in batches:
            for stem, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = list(section_paragraphs(xml or "", stem))
                except ET.ParseError as e:
                    if not skip_broken:
                        raise ValueError(f"{stem} isn't well-formed: {e}") from e
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return whole_texts(spark, folder, ".xml").select("stem", "value").mapInArrow(run, schemas.PARAGRAPH)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.within: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HTML_DROPPED:
            self.within.append(tag)

    def handle_endtag(self, tag):
        if tag in self.within:
            del self.within[self.within.index(tag) :]

    def handle_data(self, data):
        if not self.within:
            self.parts.append(data)


def html_to_text(data: bytes) -> str:
    """The text nodes of a page, one per line, all character references resolved; for the few pages that are fetched."""
    charset = re.search(rb"(?i)<meta[^>]*charset=[\"']?([\w-]+)", data[:4096])
    p = _Text()
    p.feed(data.decode(charset[1].decode() if charset else "utf-8", "replace"))
    p.close()
    return "\n".join(p.parts)


def pdf_to_text(data: bytes) -> str:
    """The pages' texts with a blank line between them. Needs pypdf."""
    from pypdf import PdfReader

    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of a folder's .pdf files, extracted on the executors, file by file."""

    reachable(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pdf_to_text(x) for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.col("content")).mapInArrow(run, "path string, text string")
