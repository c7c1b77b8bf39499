"""Plain-text books."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.text import stem
from quirelight.operators.books import SHORT, line_table, paragraphs, txt_chapters

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "big5", "shift_jis", "latin-1")


def decoded(data: bytes, encoding: str | None = None) -> str:
    if encoding:
        return data.decode(encoding, "replace")
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def read_text_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(book_id: the path, title: the file's stem, text) of each file below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(x, encoding) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["book_id", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "book_id string, text string")
    return rows.select("book_id", stem(F.col("book_id")).alias("title"), "text")


def text_books(files: DataFrame, merge: bool = True, threshold: int = SHORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files: book_id, title, text. (books, chapters, blocks): see :func:`txt_chapters` and
    :func:`paragraphs`. A book without headings is one chapter of the file's title. Block ids are
    unique in the book."""
    books = files.select("book_id", "title", F.lit("Unknown").alias("author"), F.lit("und").alias("language"), F.lit("horizontal").alias("layout"))
    placed = txt_chapters(line_table(files))
    named = placed.join(files.select("book_id", F.col("title").alias("__file")), "book_id")
    chapters = named.groupBy("book_id", "chapter_id").agg(F.max(F.coalesce("title", "__file")).alias("title"), (F.min("chapter") - 1).alias("ord"))
    blocks = paragraphs(placed.select("book_id", "chapter_id", "line_no", "line"), ["book_id", "chapter_id"], merge, threshold)
    block_id = F.concat_ws("_", "chapter_id", F.concat(F.lit("p"), "ord"))
    return books, chapters.select("book_id", "chapter_id", "ord", "title"), blocks.select("book_id", "chapter_id", "ord", block_id.alias("block_id"), F.lit("paragraph").alias("type"), "text")
