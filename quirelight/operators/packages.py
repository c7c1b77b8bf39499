"""Joins inside a package: spine, contents, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import basename, is_front_matter, is_technical, normal_href, strip

DOCUMENTS = ("application/xhtml+xml", "text/html")
MAX_EDGE = 1600


def spine_documents(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """spine: book_id, pos, idref; manifest: book_id, item_pos, item_id, name, media_type. Returns
    book_id, pos, item_id, name: documents in reading order, without front matter. An idref names
    an item by id, else by name, else by base name. A book whose spine gives none has all its
    documents, in the manifest's order."""
    items = manifest.withColumn("base", basename(F.col("name")))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("prio"), F.col(c).alias("idref")) for i, c in enumerate(("item_id", "name", "base")))))
    keyed = items.select("*", keys.alias("k")).select("*", "k.prio", "k.idref").drop("k")
    nth = F.row_number().over(Window.partitionBy("book_id", "pos").orderBy("prio", "item_pos"))
    found = spine.join(keyed, ["book_id", "idref"]).withColumn("nth", nth).where("nth = 1")
    wanted = F.col("media_type").isin(*DOCUMENTS) & ~is_front_matter(F.col("name"), F.col("item_id"))
    found = found.where(wanted).select("book_id", "pos", "item_id", "name")
    rest = manifest.where(wanted).join(found.select("book_id").distinct(), "book_id", "left_anti")
    return found.unionByName(rest.select("book_id", F.col("item_pos").alias("pos"), "item_id", "name"))


def toc_titles(toc: DataFrame) -> DataFrame:
    """toc: book_id, source (the package's contents first), pos, href, title. (book_id, href,
    title): by base name in lower case, the first one; resources' names and titles over 80
    characters are none."""
    rows = toc.withColumn("href", normal_href(F.col("href"))).withColumn("title", strip(F.col("title")))
    rows = rows.where((F.col("href") != "") & (F.length("title") <= 80) & ~is_technical(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("book_id", "href").orderBy("source", "pos"))
    return rows.withColumn("nth", nth).where("nth = 1").select("book_id", "href", "title")


def document_titles(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """documents: book_id, pos, item_id, name; titles: book_id, href, title (:func:`toc_titles`). (book_id, pos, title):
    what the contents call a document, by its file's name, else by its item's id; others give no row."""
    keys = F.array(F.struct(F.lit(0).alias("prio"), normal_href(F.col("name")).alias("href")), F.struct(F.lit(1).alias("prio"), F.lower("item_id").alias("href")))
    keyed = documents.select("book_id", "pos", F.inline(keys)).where("href <> ''")
    return keyed.join(titles, ["book_id", "href"]).groupBy("book_id", "pos").agg(F.min_by("title", "prio").alias("title"))


def soft_boundaries(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """blocks: book_id, pos (of its document), idx; titles: book_id, pos, title. (book_id, idx, title): the first
    block of each document that has a title; of documents without blocks nothing is left."""
    first = blocks.groupBy("book_id", "pos").agg(F.min("idx").alias("idx"))
    return first.join(titles, ["book_id", "pos"]).select("book_id", "idx", "title")


def toc_labels(toc: DataFrame) -> DataFrame:
    """(book_id, pos, label): titles in order, each once."""
    rows = toc.where(F.col("title") != "").groupBy("book_id", F.col("title").alias("label")).agg(F.min(F.struct("source", "pos")).alias("p"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("p")) - 1
    return rows.select("book_id", place.alias("pos"), "label")


def image_assets(refs: DataFrame, assets: DataFrame, book: str = "book_id") -> DataFrame:
    """refs: book, src; assets: book, pos, path. Adds path: the first asset of the book whose path
    holds the src's base name; null without one."""
    rows = refs.withColumn("base", basename(F.col("src")))
    hit = F.when((F.col("base") != "") & F.col("path").contains(F.col("base")), F.col("pos"))
    found = rows.join(assets, book, "left").groupBy(book, "src").agg(F.min_by("path", hit).alias("path"))
    return refs.join(found, [book, "src"], "left")


def shrunk(images: DataFrame, most: int = MAX_EDGE) -> DataFrame:
    """images: w, h. Adds new_w, new_h: scaled to a longest edge of most, cut to whole pixels."""
    edge = F.greatest("w", "h")
    scale = F.when(edge > most, F.lit(float(most)) / edge).otherwise(F.lit(1.0))
    size = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * scale)).cast("int")
    return images.withColumn("new_w", size("w")).withColumn("new_h", size("h"))
