"""Blocks as XHTML, prompts and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import basename, rendered, strip, xml_escape

# Media types by suffix.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}
MODES = ("standard", "compact")

PROMPT = """Translate from {{source_language_name}} to {{target_language_name}}.
Answer with a JSON object {"translations": [{"id": ..., "text": ...}]} that holds each given id once.
Keep ids and the order of blocks. Use the glossary's terms. Earlier blocks are context only."""
STYLES = {
    "fiction": PROMPT + "\nThe text is fiction: keep the voices and the rhythm of speech.",
    "nonfiction": PROMPT + "\nThe text is non-fiction: keep terms and facts exact.",
}


def media_type(path: Column, default: str = "application/octet-stream") -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, suffix), F.lit(default))


def mode_of(given: Column) -> Column:
    own = F.lower(strip(F.coalesce(given, F.lit(""))))
    return F.when(own.isin(*MODES), own).otherwise("standard")


def with_images(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds src: the file of an image block's asset, by its ref or by the ref's base name; null
    without one. assets: book_id, asset_key, file_name; a book has a key once."""
    keys = assets.select("book_id", F.col("asset_key").alias("__key"), F.col("file_name").alias("__file"))
    own = blocks.withColumn("__base", basename(F.col("image_ref")))
    exact = keys.withColumnRenamed("__key", "image_ref").withColumnRenamed("__file", "__exact")
    by_base = keys.withColumnRenamed("__key", "__base").withColumnRenamed("__file", "__near")
    rows = own.join(exact, ["book_id", "image_ref"], "left").join(by_base, ["book_id", "__base"], "left")
    return rows.withColumn("src", F.coalesce("__exact", "__near")).drop("__base", "__exact", "__near")


def block_html(kind: Column, level: Column, text: Column, src: Column, alt: Column, mode: str = "standard") -> Column:
    """A block's XHTML, null for an image without a file. In compact mode headings of level 3 and
    deeper are sub-heads."""
    own, depth = xml_escape(text), F.least(F.greatest(F.when(F.coalesce(level, F.lit(0)) == 0, 2).otherwise(level), F.lit(1)), F.lit(6))
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name.split()[0]}>"))
    heading = F.concat(F.lit("<h"), depth, F.lit(">"), own, F.lit("</h"), depth, F.lit(">"))
    if mode == "compact":
        heading = F.when(depth >= 3, tag('p class="subhead"', own)).otherwise(heading)
    image = F.when(src.isNotNull(), F.concat(F.lit('<img src="'), src, F.lit('" alt="'), xml_escape(alt), F.lit('"/>')))
    return (
        F.when(kind == "heading", heading)
        .when(kind == "paragraph", tag("p", own))
        .when(kind.isin("caption", "footnote"), F.concat(F.lit('<p class="'), kind, F.lit('">'), own, F.lit("</p>")))
        .when(kind == "image", image)
    )


def chapter_html(chapters: DataFrame, blocks: DataFrame, mode: str = "standard") -> DataFrame:
    """chapters: book_id, chapter_id, ord, title; blocks with src. (book_id, chapter_id, ord, html)."""
    own = block_html(*(F.col(c) for c in ("type", "level", "text", "src", "image_alt")), mode)
    rows = blocks.select("book_id", "chapter_id", F.col("ord").alias("n"), own.alias("h")).where("h is not null")
    each = F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"])
    bodies = rows.groupBy("book_id", "chapter_id").agg(each.alias("lines"))
    title = F.concat(F.lit("<h1>"), xml_escape(F.col("title")), F.lit("</h1>"))
    parts = F.concat(F.array(F.lit('<div class="chapter">'), title), F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit("</div>")))
    return chapters.join(bodies, ["book_id", "chapter_id"], "left").select("book_id", "chapter_id", "ord", F.array_join(parts, "\n").alias("html"))


def css(layout: str = "horizontal", mode: str = "standard") -> str:
    """A style sheet for the layout and mode."""
    lines = ["body { margin: 1em; line-height: 1.6; }", "p { margin: 0 0 0.6em 0; text-indent: 1em; }"]
    lines += [".caption, .footnote { font-size: 0.85em; text-indent: 0; }", "img { max-width: 100%; }"]
    if mode == "compact":
        lines += ["p { margin: 0; }", "h1, h2 { margin: 0.4em 0; }", ".subhead { font-weight: bold; text-indent: 0; }"]
    if layout == "vertical":
        lines += ["html { writing-mode: vertical-rl; -epub-writing-mode: vertical-rl; }"]
    return "\n".join(lines)


def system_prompt(style: Column, custom: Column) -> Column:
    """The custom prompt unless it is blank, else the style's; an unknown style is fiction."""
    plain = F.regexp_replace(F.lower(strip(F.coalesce(style, F.lit("")))), "[-_]", "")
    return F.coalesce(F.nullif(strip(custom), F.lit("")), F.when(plain == "nonfiction", STYLES["nonfiction"]).otherwise(STYLES["fiction"]))


def prompt(template: Column, source: Column, target: Column, text: Column) -> Column:
    """source, target: structs of code and name_en."""
    return rendered(
        template,
        {"source_language": source["code"], "target_language": target["code"], "source_language_name": source["name_en"],
         "target_language_name": target["name_en"], "text": text},
    )


def payload(chunks: DataFrame) -> DataFrame:
    """chunks: source_lang, target_lang, style, glossary array<struct<source,target,type>>,
    carry_over array<struct<id,text>>, carry_translated map<string,string>, blocks
    array<struct<id,text>>. Adds payload: the JSON that a translator gets. A carried block shows
    its translation where there is one; blank ids go."""
    context = F.transform(
        F.filter("carry_over", lambda x: F.coalesce(x["id"], F.lit("")) != ""),
        lambda x: F.struct(x["id"].alias("id"), x["text"].alias("source"), F.try_element_at("carry_translated", x["id"]).alias("translated")),
    )
    body = F.struct(
        "source_lang", "target_lang", "style", "glossary", context.alias("carry_over"), F.col("blocks").alias("to_translate")
    )
    return chunks.withColumn("payload", F.to_json(body))
