"""Word documents as text: each file is one archive, read by Spark and parsed part by part where it lies."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PART, NAMES = "word/document.xml", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LISTS = ("listparagraph", "listbullet", "listnumber")  # fixed values: styles of list items
TEXT = StructType([StructField("text", StringType()), StructField("error", StringType())])


def paragraphs(document: io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    """(style, text) of the paragraphs of a document's XML, without holding the whole of it."""
    style, said = "", []
    for event, node in ElementTree.iterparse(document, ("start", "end")):
        tag = node.tag.removeprefix(NAMES)
        if event == "start":
            if tag == "p":
                style, said = "", []
            continue
        if tag == "pStyle":
            style = style or node.get(f"{NAMES}val", "")
        elif tag == "numPr":
            style = "ListParagraph"
        elif tag == "t":
            said.append(node.text or "")
        elif tag in ("tab", "br"):
            said.append(" ")
        elif tag == "p":
            yield style, re.sub(r"\s+", " ", "".join(said)).strip()
            node.clear()


def lead(style: str) -> str:
    """How Markdown begins a paragraph of a style: headings one level deeper, between two and four, and list items."""
    name = style.lower().replace(" ", "")
    if name.startswith("heading"):
        digits = re.sub(r"\D", "", name)
        return "#" * min(4, max(2, int(digits or 2) + 1)) + " "
    return "- " if name in LISTS else ""


def text_of(content: bytes | None) -> tuple[str | None, str | None]:
    """(text, None) of a Word document, or (None, why not)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive, archive.open(PART) as part:
            lines = [lead(style) + text if text else "" for style, text in paragraphs(part)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as e:
        return None, f"not a Word document ({type(e).__name__})"
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), None


@F.pandas_udf(TEXT)
def _texts(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in contents:
        yield pd.DataFrame([text_of(c) for c in batch], columns=["text", "error"])


def word_text(content: Column) -> Column:
    """text and error of a Word document's bytes."""
    return _texts(content)


def word_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, text and error of each .docx file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), word_text(F.col("content")).alias("x")).select("path", "modified", "x.*")
