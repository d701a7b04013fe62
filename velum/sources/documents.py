"""Files to texts, each file read once. A file that can't be read gives a row with an error code; it never fails the job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions.text import trim

#: Reads (path, content) into one text per page, in order, as (embedded text, recognised text); None for what is missing.
PageReader = Callable[[str, bytes], list[tuple[str | None, str | None]]]
#: Counts the pages of the file at a path, and reads those from a first to before a last one, as PageReader does.
PageCounter = Callable[[str], int]
RangeReader = Callable[[str, int, int], list[tuple[str | None, str | None]]]
#: Reads (path, content) of a legacy Word file.
DocReader = Callable[[str, bytes], str]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, modification_time) of the files under a folder; those that vanish or can't be read are left out (see :func:`extract_folder`)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(path)
    return files.select("path", "content", F.col("modificationTime").alias("modification_time"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*V.EXTENSIONS)


def decode_text(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1, which takes any bytes."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def usable_embedded(text: Column) -> Column:
    """A page's embedded text, form feeds as line breaks and trimmed, if it has enough letters and digits to be trusted; else null."""
    clean = trim(F.replace(text, F.lit("\f"), F.lit("\n")))
    return F.when(F.length(F.regexp_replace(clean, "[^\\p{L}\\p{M}\\p{N}]", "")) >= V.MIN_EMBEDDED_TEXT, clean)


def page_text(embedded: Column, recognised: Column) -> Column:
    """Usable embedded text, else recognised text, else whatever is embedded."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(usable_embedded(embedded), some(trim(recognised)), some(trim(F.replace(embedded, F.lit("\f"), F.lit("\n")))), F.lit(""))


def join_pages(pages: DataFrame) -> DataFrame:
    """(path, text) of (path, page_no, embedded, recognised): pages in order, one line break between those with text."""
    every = F.sort_array(F.collect_list(F.struct("page_no", "embedded", "recognised")))
    return pages.groupBy("path").agg(pages_text(every).alias("text")).filter("text <> ''")


def pages_text(pages: Column) -> Column:
    """The text of array<struct<page_no,embedded,recognised>>."""
    texts = F.filter(F.transform(pages, lambda p: page_text(p["embedded"], p["recognised"])), lambda t: t != "")
    return trim(F.array_join(texts, "\n"))


def reading_order(observations: DataFrame, *page: str) -> DataFrame:
    """(page, text) of recognised lines (page, text, min_x, max_y in 0..1): from the top, and from the left within a row.

    A row ends where the next lower line is more than the tolerance below: so lines within it of each other always share a row, wherever
    they lie, and the order is a strict one. Windows are within one page, whose lines are few.
    """
    down = W.partitionBy(*page).orderBy(F.desc("max_y"), "min_x", "text")
    # Places are compared to a millionth of the page, so that sums of floating point numbers at the tolerance stay within it.
    gap = F.round(F.lag("max_y").over(down) - F.col("max_y"), 6) > V.OCR_ROW
    rows = observations.withColumn("velum_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("velum_row", F.sum("velum_gap").over(down.rowsBetween(W.unboundedPreceding, 0)))
    listed = F.sort_array(F.collect_list(F.struct(F.col("velum_row").alias("row"), F.col("min_x").alias("x"), F.col("text").alias("t"))))
    return rows.groupBy(*page).agg(trim(F.array_join(F.transform(listed, lambda o: o["t"]), "\n")).alias("text"))


def raster_size(width: Column, height: Column, rotation: Column) -> Column:
    """struct(width, height) in pixels of a page to be recognised: up to three times, within the longest edge; quarter turns swap sides."""
    scale = F.least(F.lit(V.OCR_SCALE), F.lit(V.OCR_EDGE) / F.greatest(width, height))
    turned = F.pmod(rotation, F.lit(180)) == 90
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return F.struct(F.round(w * scale).cast("int").alias("width"), F.round(h * scale).cast("int").alias("height"))


_PART = re.compile(r"^word/(document|footnotes|endnotes|header[^/]*|footer[^/]*)\.xml$", re.IGNORECASE)


class _WordText:
    """Collects the text of a WordprocessingML part as its elements come."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.inside = 0

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition("}")[2]
        self.inside += name == "t"
        if name == "tab":
            self.out.append("\t")
        elif name in ("br", "cr") or name == "p" and self.out:
            self.out.append("\n")

    def end(self, tag: str) -> None:
        self.inside -= tag.rpartition("}")[2] == "t"

    def data(self, text: str) -> None:
        if self.inside:
            self.out.append(text)

    def close(self) -> str:
        return "".join(self.out)


def wordprocessing_text(xml: bytes) -> str:
    """The text of a part: runs, tabs, breaks, and a line break before each paragraph but the first output; of a damaged part, what
    stands before the damage."""
    text = _WordText()
    parser = ElementTree.XMLParser(target=text)
    try:
        parser.feed(xml)
        parser.close()
    except ElementTree.ParseError:
        pass
    return text.close()


def docx_text(content: bytes) -> str:
    """The document, then headers, footers and notes by name; parts without text are left out. Raises if there is no document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in z.namelist() if _PART.match(n)]
        if not any(n.lower() == "word/document.xml" for n in parts):
            raise ValueError("no document part")
        kinds = ("document", "header", "footer")
        rank = lambda n: (next((i for i, k in enumerate(kinds) if n.lower().startswith(f"word/{k}")), len(kinds)), n.lower())
        texts = [wordprocessing_text(z.read(n)).strip() for n in sorted(parts, key=rank)]
    return "\n\n".join(t for t in texts if t)


def extract(files: DataFrame, page_reader: PageReader | None = None, doc_reader: DocReader | None = None) -> DataFrame:
    """(path, file_hash, text, error_code): the text of each file (path, content), or why there is none; null content couldn't be read.

    One pass: text files stay in built-in functions, only the bytes of Word and PDF files go to Python. PDF pages and legacy Word files
    need the readers given.
    """
    parsed_type = "text string, error string, pages array<struct<page_no:int,embedded:string,recognised:string>>"

    def word(path: str, content: bytes) -> tuple[str | None, str | None]:
        text, error = None, None
        try:
            text = docx_text(content)
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError):
            error = "unreadableWord"
        if doc_reader and (error or not text.strip()):
            try:
                text, error = doc_reader(path, content), None
            except Exception:  # an outside reader's own errors
                error = "unreadableWord"
        return (None if error else text), error

    def pdf(path: str, content: bytes) -> list[tuple[int, str | None, str | None]] | None:
        try:
            return [(i, a, b) for i, (a, b) in enumerate(page_reader(path, content))] if page_reader else None
        except Exception:  # an outside reader's own errors: the file has no pages
            return None

    @F.pandas_udf(parsed_type)
    def parse(path: pd.Series, ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, e, c in zip(path, ext, content, strict=True):
            if c is None:
                rows.append((None, None, None))
            elif e == "pdf":
                pages = pdf(p, bytes(c))
                rows.append((None, "unreadablePDF" if pages is None else None if pages else "emptyDocument", pages))
            else:
                rows.append((*word(p, bytes(c)), None))
        return pd.DataFrame(rows, columns=["text", "error", "pages"])

    ext, content = F.col("ext"), F.col("content")
    keyed = files.select("path", F.sha2("content", 256).alias("file_hash"), extension(F.col("path")).alias("ext"), "content")
    outside = F.coalesce(ext.isin("pdf", "doc", "docx"), F.lit(False))
    done = keyed.withColumn("parsed", parse("path", "ext", F.when(outside, content)))
    paged = pages_text(F.col("parsed.pages"))
    text = F.when(ext.isin("txt", "text"), decode_text(content)).when(ext == "pdf", F.when(paged != "", paged)).otherwise(F.col("parsed.text"))
    error = (
        F.when(~F.coalesce(ext.isin(*V.EXTENSIONS), F.lit(False)), "unsupportedFileType")
        .when(content.isNull(), "readFailed")
        .when(F.col("parsed.error").isNotNull(), F.col("parsed.error"))
        .when((ext == "pdf") & (paged == ""), "unreadablePDF")
    )
    every = done.select("path", "file_hash", text.alias("text"), error.alias("error_code"))
    blank = F.col("error_code").isNull() & F.coalesce(trim(F.col("text")) == "", F.lit(True))
    return every.select("path", "file_hash", F.when(F.col("error_code").isNull() & ~blank, F.col("text")).alias("text"), F.when(blank, "emptyDocument").otherwise(F.col("error_code")).alias("error_code"))


def extract_ranges(files: DataFrame, counter: PageCounter, reader: RangeReader, pages: int = 50) -> DataFrame:
    """(path, text, error_code) of paged files (path) by ranges of ``pages`` pages, each a row of its own for a task: so a file of many pages
    is read by many tasks, none of which holds its bytes, and files are opened by their path where the readers run.

    The rows are those that :func:`extract` gives with a reader of whole files: a file that can't be counted, or a range of it that can't be
    read, is unreadablePDF, as is one whose pages hold no text; one without pages is emptyDocument.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for path in pdf["path"]:
                try:
                    sizes.append(counter(path))
                except Exception:  # an outside reader's own errors
                    sizes.append(-1)
            yield pd.DataFrame({"path": pdf["path"], "n_pages": sizes})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, first, last in zip(pdf["path"], pdf["first"], pdf["last"], strict=True):
                try:
                    rows += [(path, int(first) + i, a, b, True) for i, (a, b) in enumerate(reader(path, int(first), int(last)))]
                except Exception:  # an outside reader's own errors
                    rows.append((path, int(first), None, None, False))
            yield pd.DataFrame(rows, columns=["path", "page_no", "embedded", "recognised", "ok"])

    counted = files.select("path").mapInPandas(count, "path string, n_pages int")
    first = F.explode_outer(F.when(F.col("n_pages") > 0, F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(pages))))
    ranges = counted.select("path", "n_pages", first.alias("first")).withColumn("last", F.least(F.col("first") + pages, F.col("n_pages")))
    # Dealt by path and range, so that the ranges of one file go to different tasks.
    some = ranges.filter("first is not null").select("path", "first", "last").repartition("path", "first")
    found = some.mapInPandas(read, "path string, page_no int, embedded string, recognised string, ok boolean")
    texts = found.groupBy("path").agg(F.every("ok").alias("ok"), pages_text(F.sort_array(F.collect_list(F.struct("page_no", "embedded", "recognised")))).alias("text"))
    none = ranges.filter("first is null").select("path", F.lit(None).cast("string").alias("text"), F.when(F.col("n_pages") == 0, "emptyDocument").otherwise("unreadablePDF").alias("error_code"))
    good = F.col("ok") & (F.col("text") != "")
    return texts.select("path", F.when(good, F.col("text")).alias("text"), F.when(~good, "unreadablePDF").alias("error_code")).unionByName(none)


def with_failures(listed: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` with a row of the code readFailed for each listed path (path) that it lacks."""
    joined = listed.select("path").join(done, "path", "left")
    return joined.withColumn("error_code", F.when(F.col("file_hash").isNull() & F.col("error_code").isNull(), "readFailed").otherwise(F.col("error_code")))


def extract_folder(spark: SparkSession, path: str, page_reader: PageReader | None = None, doc_reader: DocReader | None = None) -> DataFrame:
    """:func:`extract` of a folder's files; those that are listed but vanish or can't be read have the code readFailed."""
    files = read_files(spark, path)
    # The reader's own list of files, which the driver holds for any scan; none is opened for it.
    listed = [(unquote(p).replace("file:///", "file:/"),) for p in files.inputFiles()]
    return with_failures(spark.createDataFrame(listed, "path string"), extract(files, page_reader, doc_reader))


def latest(files: DataFrame) -> DataFrame:
    """One row per path: the last modified."""
    return files.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("modification_time")))).filter("n = 1").drop("n")
