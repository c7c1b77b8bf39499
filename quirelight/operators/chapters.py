"""Edits of a book's chapters, and what a preview shows of them.

chapters: book_id, chapter_id, ord, title. blocks: book_id, chapter_id, ord, block_id, type, text.
Edits return both tables; reading order is numbered anew from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import is_translatable, strip

CHAPTER, BLOCK = ["book_id", "chapter_id", "ord", "title"], ["book_id", "chapter_id"]


class EditError(ValueError):
    """An edit that names no such chapter, or that its rules forbid."""


def renumbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("ord", place.cast("int"))


def _must(chapters: DataFrame, chapter_id: str) -> None:
    if not chapters.where(F.col("chapter_id") == chapter_id).limit(1).count():
        raise EditError(f"no chapter {chapter_id}")


def rename(chapters: DataFrame, chapter_id: str, title: str, check: bool = True) -> DataFrame:
    title = title.strip()
    if not title:
        raise EditError("a title must not be blank")
    if check:
        _must(chapters, chapter_id)
    return chapters.withColumn("title", F.when(F.col("chapter_id") == chapter_id, title).otherwise(F.col("title")))


def remove(chapters: DataFrame, blocks: DataFrame, chapter_id: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    if check:
        _must(chapters, chapter_id)
    other = F.col("chapter_id") != chapter_id
    return renumbered(chapters.where(other), ["book_id"], ["ord"]), blocks.where(other)


def merge_next(chapters: DataFrame, blocks: DataFrame, left: str, right: str, title: str | None = None, check: bool = True):
    """right's blocks behind left's; left's id, and its title unless another is given."""
    after = F.lead("chapter_id").over(Window.partitionBy("book_id").orderBy("ord"))
    pairs = chapters.withColumn("next", after).where((F.col("chapter_id") == left) & (F.col("next") == right))
    if check and not pairs.limit(1).count():
        raise EditError(f"{right} does not follow {left}")
    joined = pairs.select("book_id", F.lit(right).alias("chapter_id"), F.lit(True).alias("moved"))
    kept = renumbered(chapters.join(joined, BLOCK, "left_anti"), ["book_id"], ["ord"])
    if title and title.strip():
        kept = rename(kept, left, title, check=False)
    rows = blocks.join(F.broadcast(joined), BLOCK, "left")
    late = F.coalesce("moved", F.lit(False))
    rows = rows.withColumn("late", late).withColumn("chapter_id", F.when(late, left).otherwise(F.col("chapter_id")))
    return kept.select(*CHAPTER), renumbered(rows, BLOCK, ["late", "ord"]).drop("moved", "late")


def split_at(chapters: DataFrame, blocks: DataFrame, chapter_id: str, block_id: str, title: str | None = None):
    """The block and those behind it become a chapter of their own, right behind. It must not be
    the chapter's first block. The new id is the chapter's with _s and the place; taken ids are
    passed over."""
    _must(chapters, chapter_id)
    at = blocks.where((F.col("chapter_id") == chapter_id) & (F.col("block_id") == block_id)).select("ord").first()
    if at is None or at["ord"] == 0:
        raise EditError(f"{block_id} can't begin a new chapter")
    place = chapters.where(F.col("chapter_id") == chapter_id).first()["ord"] + 1
    # The ids of one book's chapters that begin alike.
    alike = chapters.where(F.col("chapter_id").startswith(f"{chapter_id}_s")).select("chapter_id")
    taken = {r["chapter_id"] for r in alike.toLocalIterator()}
    while f"{chapter_id}_s{place}" in taken:
        place += 1
    new = f"{chapter_id}_s{place}"
    return _split(chapters, blocks, chapter_id, F.lit(at["ord"]), new, title)


def _split(chapters, blocks, chapter_id, at, new, title=None):
    own = F.col("chapter_id") == chapter_id
    name = F.lit(title.strip()) if title and title.strip() else F.concat("title", F.lit(" (2)"))
    right = chapters.where(own).select("book_id", F.lit(new).alias("chapter_id"), "ord", name.alias("title"), F.lit(1).alias("late"))
    both = chapters.select(*CHAPTER, F.lit(0).alias("late")).unionByName(right)
    moved = own & (F.col("ord") >= at)
    rows = blocks.withColumn("chapter_id", F.when(moved, new).otherwise(F.col("chapter_id")))
    return renumbered(both, ["book_id"], ["ord", "late"]).select(*CHAPTER), renumbered(rows, BLOCK, ["ord"])


def reorder(chapters: DataFrame, ids: list[str], check: bool = True) -> DataFrame:
    """ids: each chapter's id once."""
    if check:
        own = sorted(r["chapter_id"] for r in chapters.select("chapter_id").limit(len(ids) + 1).toLocalIterator())
        if own != sorted(ids):
            raise EditError("the ids are not each chapter's once")
    places = chapters.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "chapter_id string, ord int")
    return chapters.drop("ord").join(F.broadcast(places), "chapter_id").select(*CHAPTER)


def block_counts(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each chapter, empty ones too: n_blocks, n_translatable, n_images."""
    counts = blocks.groupBy(*BLOCK).agg(
        F.count("*").alias("n_blocks"),
        F.count_if(is_translatable(F.col("type"), F.col("text"))).alias("n_translatable"),
        F.count_if(F.col("type") == "image").alias("n_images"),
    )
    return chapters.join(counts, BLOCK, "left").na.fill(0, ["n_blocks", "n_translatable", "n_images"])


def snippets(blocks: DataFrame, size: int = 120) -> DataFrame:
    """(book_id, chapter_id, snippet): a chapter's first two texts, size characters at most."""
    rows = blocks.withColumn("s", strip(F.coalesce("text", F.lit("")))).where("type in ('paragraph', 'heading') and s <> ''")
    first = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("ord"))
    rows = rows.withColumn("nth", first).where("nth <= 2")
    both = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "s"))), lambda x: x["s"]), " ")
    out = rows.groupBy(*BLOCK).agg(both.alias("t"))
    cut = F.when(F.length("t") > size, F.concat(F.substring("t", 1, size - 3), F.lit("…"))).otherwise(F.col("t"))
    return out.select(*BLOCK, cut.alias("snippet"))


def preview_text(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_id, preview): texts, each with a blank line behind; images by their alt."""
    image = F.when(strip(F.coalesce("image_alt", F.lit(""))) != "", F.concat(F.lit("[image: "), "image_alt", F.lit("]"))).otherwise(F.lit("[image]"))
    own = F.when(F.col("type") == "image", image).otherwise(strip(F.coalesce("text", F.lit(""))))
    rows = blocks.withColumn("s", own).where("s <> ''")
    each = F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: F.concat(x["s"], F.lit("\n\n")))
    return rows.groupBy(*BLOCK).agg(F.array_join(each, "").alias("preview"))


def midpoints(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_id, at): where a chapter of two or more blocks would be split in half."""
    counts = blocks.groupBy(*BLOCK).agg(F.count("*").alias("n")).where("n >= 2")
    return counts.select(*BLOCK, F.expr("n div 2").cast("int").alias("at"))
