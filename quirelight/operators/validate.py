"""Validation: replies, books, assets. Findings are rows (entity, place, severity, code, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.functions.text import is_translatable, strip


def _finding(rows: DataFrame, entity: str, place, severity: str, code: str, detail) -> DataFrame:
    return rows.select(
        F.col(entity).cast("string").alias("entity"), place.cast("int").alias("place"), F.lit(severity).alias("severity"),
        F.lit(code).alias("code"), detail.cast("string").alias("detail"),
    )


def reply_items(replies: DataFrame) -> DataFrame:
    """replies: reply_id, payload (JSON text), source_ids. Each item of its translations: reply_id,
    place, error (null for none), id, text."""
    parsed = replies.withColumn("v", F.expr("try_parse_json(payload)"))
    listed = F.expr("try_variant_get(v, '$.translations', 'array<variant>')")
    each = parsed.select("reply_id", F.posexplode(listed).alias("place", "item"))
    kind = lambda path: F.expr(f"schema_of_variant(variant_get(item, '$.{path}', 'variant'))")
    is_object = F.expr("schema_of_variant(item)").startswith("OBJECT")
    each = each.withColumn("object", is_object)
    text_kind, id_kind = F.when(F.col("object"), kind("text")), F.when(F.col("object"), kind("id"))
    each = each.withColumn("text_kind", text_kind).withColumn("id_kind", id_kind)
    value = lambda path: F.expr(f"try_variant_get(item, '$.{path}', 'string')")
    named = F.coalesce(F.col("id_kind") == "STRING", F.lit(False))
    each = each.withColumn("id", F.when(named, F.nullif(value("id"), F.lit(""))))
    each = each.withColumn("text", F.when(F.col("text_kind") == "STRING", value("text")))
    nth = F.row_number().over(Window.partitionBy("reply_id", "id").orderBy("place"))
    each = each.withColumn("nth", F.when(F.col("id").isNotNull(), nth))
    no_text = F.col("text_kind").isNull() | (F.col("text_kind") == "VOID") | ((F.col("text_kind") == "STRING") & (strip(F.col("text")) == ""))
    error = (
        F.when(~F.col("object"), "item_not_object")
        .when(F.col("id").isNull(), "item_without_id")
        .when(F.col("nth") > 1, "duplicate_id")
        .when(no_text, "empty_text")
        .when(F.col("text_kind") != "STRING", "text_not_string")
    )
    keys = F.when(F.col("object"), F.expr("json_object_keys(to_json(item))"))
    extra = F.array_sort(F.array_except(keys, F.array(F.lit("id"), F.lit("text"))))
    return each.select("reply_id", "place", error.alias("error"), "id", "text", extra.alias("extra"))


def reply_findings(replies: DataFrame) -> DataFrame:
    """What is wrong with replies: each must be an object of translations alone, a list of objects
    of id and text, with each source id once and a text that isn't blank."""
    parsed = replies.withColumn("v", F.expr("try_parse_json(payload)"))
    is_object = F.coalesce(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("object", is_object)
    has_list = F.expr("schema_of_variant(variant_get(v, '$.translations', 'variant'))").startswith("ARRAY")
    parsed = parsed.withColumn("listed", F.col("object") & F.coalesce(F.when(F.col("object"), has_list), F.lit(False)))
    extra = F.array_sort(F.array_except(F.when(F.col("object"), F.json_object_keys("payload")), F.array(F.lit("translations"))))
    parsed = parsed.withColumn("extra", extra)
    none = F.lit(None)
    out = _finding(parsed.where("not object"), "reply_id", F.lit(-3), "error", "not_object", none)
    top = parsed.where("object and size(extra) > 0")
    out = out.unionByName(_finding(top, "reply_id", F.lit(-2), "error", "unexpected_fields", F.array_join("extra", ",")))
    out = out.unionByName(_finding(parsed.where("object and not listed"), "reply_id", F.lit(-1), "error", "no_translations", none))
    items = reply_items(parsed.where("listed"))
    wrong = items.where("error is not null")
    detail = F.coalesce("id", F.col("place").cast("string"))
    each = wrong.select("reply_id", "place", "error", detail.alias("d"))
    out = out.unionByName(
        each.select(F.col("reply_id").cast("string").alias("entity"), F.col("place").cast("int").alias("place"), F.lit("error").alias("severity"), F.col("error").alias("code"), F.col("d").alias("detail"))
    )
    more = items.where("size(extra) > 0")
    out = out.unionByName(_finding(more, "reply_id", F.col("place"), "error", "unexpected_item_fields", F.array_join("extra", ",")))
    good = items.where("error is null").groupBy("reply_id").agg(F.collect_set("id").alias("ids"))
    both = parsed.where("listed").join(good, "reply_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except("source_ids", "ids"))
    unknown = F.array_sort(F.array_except("ids", "source_ids"))
    last = 1 << 30
    for place, code, ids in ((last, "missing_ids", missing), (last + 1, "unknown_ids", unknown)):
        rows = both.withColumn("found", ids).where("size(found) > 0")
        out = out.unionByName(_finding(rows, "reply_id", F.lit(place), "error", code, F.array_join("found", ",")))
    return out


def duplicate_ids(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id", "block_id").agg(F.count("*").alias("n")).where("n > 1")


def unmapped_images(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Image blocks without a ref, or with one that their book's assets lack."""
    images = blocks.where("type = 'image'").select("book_id", "block_id", "image_ref")
    known = assets.select("book_id", F.col("asset_key").alias("image_ref"))
    return images.join(known, ["book_id", "image_ref"], "left_anti").select("book_id", "block_id", "image_ref")


def missing_blocks(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Translatable blocks that no completed chunk holds. done: book_id, block_id."""
    wanted = blocks.where(is_translatable(F.col("type"), F.col("text"))).select("book_id", "block_id")
    return wanted.join(done.select("book_id", "block_id"), ["book_id", "block_id"], "left_anti")


def failed_by_chapter(chunks: DataFrame) -> DataFrame:
    out = chunks.where("status = 'failed'").groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_failed"))
    return out.orderBy("book_id", "chapter_id")


def book_findings(books: DataFrame, chapters: DataFrame, blocks: DataFrame, assets: DataFrame, chunks: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All checks of books; with chunks (book_id, chapter_id, status, block_ids) that they are
    translated, too, and with files (:func:`listing`) that assets named by a rel_path are there. A book
    is in order if it has no error."""
    none = F.lit(None)
    out = _finding(books.join(chapters, "book_id", "left_anti"), "book_id", F.lit(0), "error", "no_chapters", none)
    blank = chapters.where(F.coalesce(strip(F.col("title")), F.lit("")) == "")
    out = out.unionByName(_finding(blank, "book_id", F.lit(1), "warning", "blank_title", F.col("chapter_id")))
    out = out.unionByName(_finding(duplicate_ids(blocks), "book_id", F.lit(2), "error", "duplicate_block", F.col("block_id")))
    out = out.unionByName(_finding(unmapped_images(blocks, assets), "book_id", F.lit(3), "warning", "image_not_mapped", F.col("block_id")))
    if chunks is not None:
        failed = failed_by_chapter(chunks)
        out = out.unionByName(_finding(failed, "book_id", F.lit(4), "error", "failed_chunks", F.concat_ws(":", "chapter_id", "n_failed")))
        waiting = chunks.where("status in ('pending', 'in_progress')").groupBy("book_id").count()
        out = out.unionByName(_finding(waiting, "book_id", F.lit(5), "error", "open_chunks", F.col("count")))
        done = chunks.where("status = 'completed'").select("book_id", F.explode("block_ids").alias("block_id"))
        lacking = missing_blocks(blocks, done).groupBy("book_id").count()
        out = out.unionByName(_finding(lacking, "book_id", F.lit(6), "error", "untranslated_blocks", F.col("count")))
    lost = [assets.where(F.coalesce(F.length("content"), F.lit(0)) == 0)] if "content" in assets.columns else []
    lost += [missing_assets(assets, files)] if files is not None else []
    for rows in lost:
        out = out.unionByName(_finding(rows, "book_id", F.lit(7), "error", "asset_missing", F.col("asset_key")))
    return out


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below a folder, path from the folder on. Only names are listed: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    end = (folder.partition("://")[2] or folder.removeprefix("file:")).rstrip("/") + "/"
    return files.select(F.substring_index("path", end, -1).alias("path"), "length")


def missing_assets(assets: DataFrame, files: DataFrame) -> DataFrame:
    """assets whose rel_path is no listed file's path, or, where lengths are listed too, that of an empty file."""
    there = (files.where("length > 0") if "length" in files.columns else files).select(F.col("path").alias("rel_path"))
    return assets.where("rel_path is not null").join(there, "rel_path", "left_anti")


def first_of(findings: DataFrame, severity: str = "warning", most: int = 3) -> DataFrame:
    """The first findings of each entity and severity, by place and detail, with nth from 1; and n, how many there are."""
    rows = findings.where(F.col("severity") == severity)
    order = Window.partitionBy("entity").orderBy("place", "detail", "code")
    counts = rows.groupBy("entity").agg(F.count("*").alias("n"))
    kept = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return kept.join(counts, "entity")
