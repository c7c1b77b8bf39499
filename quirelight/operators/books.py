"""From lines to paragraphs, chapters and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions.text import CJK, LINE_END, is_technical, is_txt_heading, lines, strip, tokens, weighed, with_block_title

SHORT = 40


def line_table(docs: DataFrame, book: str = "book_id", text: str = "text") -> DataFrame:
    """(book, line_no from 0, line)."""
    each = F.posexplode(lines(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(book, each.alias("line_no", "line"))


def paragraphs(lines_of: DataFrame, by: list[str], merge: bool = True, threshold: int = SHORT) -> DataFrame:
    """lines_of: by, line_no, line. Returns by, ord (from 0), text.

    A run of short lines is one paragraph, joined with a space; a line of threshold characters or
    more is one of its own; blank lines end a run and go. Without merge each line is one."""
    rows = lines_of.withColumn("s", strip(F.col("line")))
    kind = F.when(F.col("s") == "", "blank").when(F.length("s") < threshold, "short").otherwise("long")
    order = Window.partitionBy(*by).orderBy("line_no")
    rows = rows.withColumn("kind", kind)
    begins = (F.col("kind") == "long") | ((F.col("kind") == "short") & ~F.coalesce(F.lag("kind").over(order) == "short", F.lit(False)))
    if not merge:
        begins = F.col("kind") != "blank"
    rows = rows.withColumn("ord", F.sum(begins.cast("int")).over(order) - 1).where("kind <> 'blank'")
    each = F.array_sort(F.collect_list(F.struct("line_no", "s")))
    text = F.array_join(F.transform(each, lambda x: x["s"]), " ")
    return rows.groupBy(*by, "ord").agg(text.alias("text")).withColumn("ord", F.col("ord").cast("int"))


def paragraph_lists(texts: DataFrame, text: str = "text", name: str = "paragraphs", merge: bool = True, threshold: int = SHORT) -> DataFrame:
    """texts with the column name added: array<string> of a text's paragraphs, as :func:`paragraphs` finds them. A text that
    lies in one row is taken apart in that row: nothing is exploded or shuffled."""
    # An end of line at the end begins no further line.
    each = F.split(F.coalesce(F.col(text), F.lit("")), LINE_END)
    own = F.transform(_once(each, lambda e: F.slice(e, 1, F.size(e) - F.when(F.get(e, F.size(e) - 1) == "", 1).otherwise(0))), strip)

    def short(x: Column) -> Column:
        return (x != "") & (F.length(x) < threshold)

    def joined(l: Column, starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(l))
            return F.array_join(F.filter(F.slice(l, start + 1, end - start), lambda x: x != ""), " ")

        return F.transform(starts, one)

    def found(l: Column) -> Column:
        if not merge:
            return F.filter(l, lambda x: x != "")
        begins = lambda x, i: (x != "") & ~(short(x) & (i > 0) & F.coalesce(short(F.get(l, i - 1)), F.lit(False)))
        starts = F.array_compact(F.transform(l, lambda x, i: F.when(begins(x, i), i)))
        return _once(starts, lambda s: joined(l, s))

    return texts.withColumn(name, _once(own, found))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def txt_chapters(lines_of: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, chapter_id, chapter, title, line_no, line) of plain text: a heading line begins a
    chapter and is its title; lines before the first heading go. A book without headings is one
    chapter without title (named by its file where it is read)."""
    rows = lines_of.withColumn("heading", is_txt_heading(F.col("line")))
    order, whole = Window.partitionBy(book).orderBy("line_no"), Window.partitionBy(book)
    rows = rows.withColumn("no", F.sum(F.col("heading").cast("int")).over(order)).withColumn("any", F.max("heading").over(whole))
    own = Window.partitionBy(book, "no")
    title = F.max(F.when(F.col("heading"), F.substring(strip(F.col("line")), 1, 200))).over(own)
    rows = rows.withColumn("title", title).where("not heading and (no > 0 or not any)")
    chapter = F.greatest(F.col("no"), F.lit(1)).cast("int")
    return rows.select(book, F.concat(F.lit("ch"), chapter).alias("chapter_id"), chapter.alias("chapter"), "title", "line_no", "line")


def boundaries(titled: DataFrame, book: str = "book_id") -> DataFrame:
    """titled: book, idx, title (null for none). Rows that begin a chapter: a title that repeats
    right behind a boundary of the same title is none, so of a run of the same title every second
    one counts."""
    rows = titled.where("title is not null")
    by_title = Window.partitionBy(book, "title").orderBy("idx")
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(by_title))
    in_run = Window.partitionBy(book, "title", "run").orderBy("idx")
    return rows.where("true").withColumn("nth", F.row_number().over(in_run)).where("nth % 2 = 1").select(book, "idx", "title")


def matched_label(blocks: DataFrame, labels: DataFrame, book: str = "book_id") -> DataFrame:
    """blocks: book, idx, text; labels: book, pos, label (a table of contents). Adds label: the
    first that equals the text, else the first that begins with it or that it begins with (two
    characters at least); null without one. Labels are few, and meet only their own book's blocks."""
    text, label = strip(F.coalesce(F.col("text"), F.lit(""))), F.col("label")
    short = F.least(F.length(text), F.length(label)) >= 2
    prefix = short & (text.startswith(label) | label.startswith(text))
    own = blocks.join(labels, book, "left")
    found = own.groupBy(book, "idx").agg(
        F.min_by(F.when(text == label, label), F.when(text == label, F.col("pos"))).alias("same"),
        F.min_by(F.when(prefix, label), F.when(prefix, F.col("pos"))).alias("near"),
    )
    return blocks.join(found.select(book, "idx", F.coalesce("same", "near").alias("label")), [book, "idx"], "left")


def detect_chapters(blocks: DataFrame, labels: DataFrame | None = None, book: str = "book_id", soft: DataFrame | None = None) -> DataFrame:
    """blocks: book, idx (reading order), type, level, text. Adds chapter_id, chapter (from 1),
    chapter_title, ord (from 0 in the chapter).

    Headings and title-like paragraphs begin chapters, as do blocks that a label of the contents
    names; what comes before the first belongs to it. In a book without any, the boundaries of
    soft (book, idx, title) count, but for resources' names. A book without these too is one
    chapter, titled by its first label that is no resource's name, else Untitled."""
    rows = with_block_title(blocks, "type", "level", "text", "title")
    if labels is not None:
        named = matched_label(blocks.select(book, "idx", "text"), labels, book).select(book, "idx", "label")
        label = F.when(~is_technical(F.col("label")), F.col("label"))
        rows = rows.join(named, [book, "idx"], "left").withColumn("title", F.coalesce("title", label)).drop("label")
    if soft is not None:
        weak = soft.where(~is_technical(F.col("title"))).select(book, "idx", F.substring("title", 1, 200).alias("__soft"))
        rows = rows.join(weak, [book, "idx"], "left").withColumn("__strong", F.count("title").over(Window.partitionBy(book)))
        rows = rows.withColumn("title", F.when(F.col("__strong") > 0, F.col("title")).otherwise(F.col("__soft"))).drop("__soft", "__strong")
    # As boundaries has them: of blocks in a row with the same title every second one begins.
    order = Window.partitionBy(book).orderBy("idx")
    goes_on = (F.lag("title").over(order) == F.col("title")) & (F.lag("idx").over(order) == F.col("idx") - 1)
    rows = rows.withColumn("__run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    nth = F.row_number().over(Window.partitionBy(book, "__run").orderBy("idx"))
    rows = rows.withColumn("begins", F.when(nth % 2 == 1, F.col("title"))).drop("title", "__run")
    chapter = F.greatest(F.lit(1), F.count("begins").over(order)).cast("int")
    rows = rows.withColumn("chapter", chapter)
    inside = Window.partitionBy(book, "chapter").orderBy("idx")
    title = F.max("begins").over(Window.partitionBy(book, "chapter"))
    rows = rows.withColumn("chapter_title", title).withColumn("ord", (F.row_number().over(inside) - 1).cast("int"))
    if labels is not None:
        first = labels.where(~is_technical(F.col("label"))).groupBy(book).agg(F.min_by("label", "pos").alias("first_label"))
        rows = rows.join(first, book, "left").withColumn("chapter_title", F.coalesce("chapter_title", "first_label")).drop("first_label")
    rows = rows.withColumn("chapter_title", F.coalesce("chapter_title", F.lit("Untitled"))).drop("begins")
    return rows.withColumn("chapter_id", F.concat(F.lit("ch"), F.col("chapter")))


def chunks(blocks: DataFrame, by: list[str], target: int = 1000) -> DataFrame:
    """blocks: by (a chapter), ord, block_id, text (the translatable ones). Returns by, chunk
    (from 0), first_ord, last_ord, n_blocks, tokens, block_ids array<string>.

    Blocks are taken in order while their tokens fit target; a larger block is a chunk of its
    own; no chunk crosses a chapter."""
    one = F.struct("ord", "block_id", tokens(F.col("text")).alias("tokens"))
    return packed(blocks.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("b")), by, "b", target)


def paragraph_chunks(lists: DataFrame, by: list[str], name: str = "paragraphs", target: int = 1000) -> DataFrame:
    """:func:`chunks` of :func:`paragraph_lists`, by row, without a shuffle; a paragraph's id is its place, and chapters
    that have no paragraph give no chunk."""
    each = F.transform(name, lambda x, i: F.struct(i.alias("ord"), i.cast("string").alias("block_id"), x.alias("text")))
    kept = F.filter(each, lambda x: strip(x["text"]) != "")
    # Without any character beyond ASCII there is nothing to look for.
    rest = lambda x: F.when(F.octet_length(x) == F.length(x), F.length(x)).otherwise(F.length(F.regexp_replace(x, CJK, "")))
    size = lambda x: _once(rest(x), lambda m: weighed(F.length(x), m))
    b = F.transform(kept, lambda x: F.struct(x["ord"].alias("ord"), x["block_id"].alias("block_id"), size(x["text"]).alias("tokens")))
    return packed(lists.withColumn("b", b).where(F.size("b") > 0), by, "b", target)


def packed(rows: DataFrame, by: list[str], b: str, target: int) -> DataFrame:
    """rows: by, b array<struct<ord,block_id,tokens>> in order. One fold over a chapter's blocks: it keeps finished chunks'
    last places and the open chunk's tokens."""
    rows = rows.select(*by, F.col(b).alias("b"))
    begin = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("open"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["i"] > 0) & (acc["open"] + x["tokens"] > target) & (acc["open"] >= 0)
        ends = F.when(full, F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"])
        open_ = F.when(full, x["tokens"]).otherwise(acc["open"] + x["tokens"])
        return F.struct(ends.alias("ends"), open_.alias("open"), (acc["i"] + 1).alias("i"))

    ends = F.aggregate("b", begin, step, lambda acc: F.concat(acc["ends"], F.array(acc["i"])))
    rows = rows.withColumn("ends", ends)
    each = F.transform("ends", lambda e, i: F.struct(i.alias("chunk"), _part(e, i).alias("p")))
    rows = rows.select(*by, F.explode(each).alias("c")).select(*by, "c.chunk", "c.p")
    total = F.aggregate("p", F.lit(0), lambda acc, x: acc + x["tokens"])
    first, last = F.element_at("p", 1)["ord"], F.element_at("p", -1)["ord"]
    ids = F.transform("p", lambda x: x["block_id"])
    return rows.select(
        *by, F.col("chunk").cast("int").alias("chunk"), first.alias("first_ord"), last.alias("last_ord"),
        F.size("p").alias("n_blocks"), total.cast("int").alias("tokens"), ids.alias("block_ids"),
    )


def _part(end: Column, i: Column) -> Column:
    start = F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    return F.slice("b", start + 1, end - start)


def carried_over(chunk_rows: DataFrame, by: list[str], k: int = 2) -> DataFrame:
    """Adds carry_over: the last k block ids of the chunk before, in the same chapter."""
    before = F.lag("block_ids").over(Window.partitionBy(*by).orderBy("chunk"))
    none = F.array().cast("array<string>")
    tail = F.when(F.size(before) > k, F.slice(before, -k, k)).otherwise(before) if k > 0 else none
    return chunk_rows.withColumn("carry_over", F.coalesce(tail, none))
