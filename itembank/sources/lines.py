"""Document text to located lines, all inside the row: no shuffle, no per-line Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.functions.text import LINE_BREAK, normalize_whitespace, strip_bullets, sub, trim_ws
from itembank.operators.ordering import first_rows

# --- fixed values: accepted file types --------------------------------------------------------
ACCEPTED = ("docx", "pdf", "txt", "md")
NO_TEXT = "文件是空的，没有可用的文字。"
LITTLE_TEXT = "文字太少，可能缺页。"


def _pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def _bare(piece: Column) -> Column:
    return trim_ws(F.replace(piece, F.lit("\ufeff"), F.lit("")))


def _numbered(texts: Column) -> Column:
    """Array of (line, text) with true line numbers and without blank lines."""
    rows = F.transform(texts, lambda t, i: F.struct((i + 1).cast("int").alias("line"), t.alias("text")))
    return F.filter(rows, lambda r: r["text"] != "")


def _exploded(docs: DataFrame, rows: Column, keep: list[str], para: Column) -> DataFrame:
    out = docs.select(*keep, F.posexplode(rows).alias("pos", "_r"))
    return out.select(
        *keep, "pos", F.lit(0).alias("page"), F.col("_r.line").alias("line"), para.alias("para"), F.col("_r.text").alias("text")
    )


def text_lines(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Plain text and Markdown: line numbers of the file, blank lines dropped."""
    return _exploded(docs, _numbered(F.transform(_pieces(F.col(text)), _bare)), keep, F.lit(0))


def line_texts(text: Column) -> Column:
    """The texts of text_lines as one array, in the row."""
    return F.filter(F.transform(_pieces(text), _bare), lambda t: t != "")


def paragraph_lines(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Word text: blank lines take no number; line and paragraph numbers agree."""
    kept = F.filter(F.transform(_pieces(F.col(text)), trim_ws), lambda t: t != "")
    return _exploded(docs, _numbered(kept), keep, F.col("_r.line"))


def pasted_lines(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Pasted text: as plain text, with bullets and numbering stripped."""
    clean = lambda t: strip_bullets(normalize_whitespace(t))
    return _exploded(docs, _numbered(F.transform(_pieces(F.col(text)), clean)), keep, F.lit(0))


def line_status(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Line count of each document, with an error when it is empty and a warning when it is tiny."""
    n = F.size(F.filter(F.transform(_pieces(F.col(text)), _bare), lambda t: t != ""))
    return docs.select(
        *keep, n.alias("lines"), F.when(n == 0, NO_TEXT).otherwise("").alias("error"),
        F.when((n > 0) & (n < 3), LITTLE_TEXT).otherwise("").alias("warning"),
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: file name and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"), F.col("value").alias("text")
    )


def extension(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"\.([^./\\]+)$", 1))


def content_guess(content: Column) -> Column:
    """A guess at the real type from the first bytes."""
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    return (
        F.when(head.startswith("PK"), "zip").when(head.startswith("%PDF"), "pdf").when(head.startswith("%!PS"), "postscript")
        .when(head.startswith("{\\rtf"), "rtf").when(F.hex(F.substring(content, 1, 4)) == "D0CF11E0", "old office")
        .when(head.rlike(r"^\s*<"), "html").otherwise("")
    )


def has_pdf_mark(content: Column) -> Column:
    return F.decode(F.substring(content, 1, 1024), "ISO-8859-1").contains("%PDF-")


def triage(files: DataFrame, name: str = "file_name", content: str = "content") -> DataFrame:
    """Accept or reject files by extension and first bytes, with the reason."""
    ext, body = extension(F.col(name)), F.col(content)
    reason = (
        F.when(ext == "doc", "旧版 .doc 文件不能读取：先转存为 .docx。")
        .when(ext == "", "文件名没有扩展名；可用类型：docx、pdf、txt、md。")
        .when(~ext.isin(*ACCEPTED), F.concat(F.lit("类型不可用：「"), F.col(name), F.lit("」；可用类型：docx、pdf、txt、md。")))
        .when((ext == "docx") & (content_guess(body) != "zip"), "实际内容不是 .docx")
        .when((ext == "pdf") & ~has_pdf_mark(body), "实际内容不是 PDF")
        .otherwise("")
    )
    return files.withColumn("ext", ext).withColumn("guess", content_guess(body)).withColumn("reason", reason).withColumn(
        "accepted", F.col("reason") == ""
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary file listing ready for ``triage``."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content"
    )


def debug_dump(lines: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first lines of each bank as ``p<page>:<line>`` and the text."""
    top = first_rows(lines, [key], order, limit, "n")
    return top.select(
        key, "n",
        F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit("\t"), "text").alias("text"),
    )
