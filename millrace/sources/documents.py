"""Files to documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_blank
from millrace.operators.figures import figure_documents, nearest_captions

TEXT_FILES, PDF_FILES = r"(?i)\.(txt|md|markdown)$", r"(?i)\.pdf$"
SPARSE = 30
BLOCKS = "path string, page int, pos int, type int, bbox array<double>, lines array<struct<spans:array<struct<text:string>>>>"


def _fitz(content: bytes) -> str:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _pdfplumber(content: bytes) -> str:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as doc:
        return "\n".join(page.extract_text() or "" for page in doc.pages)


def _pypdf(content: bytes) -> str:
    import io

    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


#: Readers in the order they are tried; an OCR function may be put behind them.
PDF_READERS: tuple[Callable[[bytes], str], ...] = (_fitz, _pdfplumber, _pypdf)


def pdf_text(content: bytes, readers: tuple[Callable[[bytes], str], ...] = PDF_READERS) -> str:
    """The first text that isn't sparse; else what the last reader gave. A reader that isn't installed or fails gives nothing."""
    text = ""
    for read in readers:
        try:
            text = read(content) or ""
        except Exception:
            text = ""
        if len(text.strip()) >= SPARSE:
            return text
    return text


def _decoded(readers: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts.append(pdf_text(content, readers) if path.lower().endswith(".pdf") else content.decode("utf-8", "ignore"))
                except Exception:  # one bad file doesn't end the load
                    texts.append(None)
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return run


def load_documents(spark: SparkSession, folder: str, readers: tuple = PDF_READERS) -> DataFrame:
    """doc_ord, path, source, text, figure of all readable files below ``folder``, in path order.

    Hidden files and those that begin with an underscore are not read. The
    number of files, not of their rows, is ordered in one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    files = files.filter(F.col("path").rlike(TEXT_FILES) | F.col("path").rlike(PDF_FILES))
    texts = files.mapInPandas(_decoded(readers), "path string, text string")
    texts = texts.withColumn("text", F.regexp_replace("text", "\r\n?", "\n")).filter(~is_blank(F.coalesce("text", F.lit(""))))
    figure = "struct<page:int,index:int,kind:string,caption:string,bbox:array<double>>"
    docs = texts.select("path", F.element_at(F.split("path", "/"), -1).alias("source"), "text", F.lit(None).cast(figure).alias("figure"))
    blocks = files.filter(F.col("path").rlike(PDF_FILES)).mapInPandas(_blocks, BLOCKS)
    figures = figure_documents(nearest_captions(blocks)).withColumn("figure", F.col("figure").cast(figure))
    both = docs.unionByName(figures)
    order = Window.orderBy("path", F.col("figure").isNotNull(), "figure.index")
    return both.withColumn("doc_ord", (F.row_number().over(order) - 1).cast("long"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of PDF pages, where a layout library is installed."""
    names = [x.split(" ")[0] for x in ("path", "page", "pos", "type", "bbox", "lines")]
    try:
        import fitz
    except ImportError:
        fitz = None
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True) if fitz else ():
            try:
                pages = fitz.open(stream=content, filetype="pdf")
            except Exception:
                continue
            for number, page in enumerate(pages, 1):
                try:
                    found = page.get_text("dict").get("blocks", [])
                except Exception:  # a page that can't be parsed is left out
                    continue
                for pos, x in enumerate(found):
                    lines = [{"spans": [{"text": s.get("text", "")} for s in line.get("spans", [])]} for line in x.get("lines", [])]
                    rows.append((path, number, pos, x.get("type", 0), [float(v) for v in x.get("bbox", [0, 0, 0, 0])], lines))
        yield pd.DataFrame(rows, columns=names)
