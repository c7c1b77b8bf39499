"""Column functions over text: white space, lines, tokens, names, titles, escapes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

# Line ends.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"

# Names that package tools give to resources.
TECHNICAL = (
    r"p[-_]?\d+|item[-_]?\d+|sec(?:tion)?[-_]?\d+|chap(?:ter)?[-_]?\d+|part[-_]?\d+|page[-_]?\d+|xhtml?[-_]?\d+|"
    r"text[-_/]?\d+|content[-_]?\d+|doc(?:ument)?[-_]?\d+|OEBPS.*|index[-_]?\d*|title[-_]?page|p[-_]?titlepage|"
    r"p[-_]?fmatter|p[-_]?toc|toc|nav|cover|colophon|copyright|[A-Z]?\d{2,6}|[A-Z]{0,8}[-_]\d{1,6}"
)
# What a chapter title begins with, and what may follow it.
TITLE_NUMERALS = "0-9０-９零一二三四五六七八九十百千两兩〇壹貳參叄肆伍陸柒捌玖拾"
TITLE_START = (
    rf"第\s*[{TITLE_NUMERALS}]+\s*[章节節回卷部篇話话]|chapter\s+\d+|ch\.?\s*\d+|part\s+\d+|prologue|epilogue|"
    r"前言|序章|序[章言]?|後記|后记|跋|楔子|終章|终章|尾聲|尾声|幕間|幕间|追加\s*SS|番外|特典|特別篇|特别篇"
)
TITLE_NEXT = " \t　" + chr(0xA0) + ":：—－–-·・|｜/／"
TITLE_LONGEST = 80
# Heading lines of plain text.
TXT_HEADINGS = (
    r"(?iU)^第\s*[0-9一二三四五六七八九十百千零〇两兩]+\s*[章节回話话集部篇]",
    r"(?iU)^chapter\s+\d+\b",
    r"(?U)^CHAPTER\s+[IVXLCDM]+\b",
    r"(?iU)^第\s*\d+\s*話",
    # Not an address, a decimal or the number of a section, whose point a digit follows.
    r"(?iU)^\d+\s*(?:\.(?!\d)|、)\s*\S+",
)
# Documents before the first chapter.
FRONT_MATTER = (
    r"(?i)(?:^|/)(?:cover|title[-_]?page|p[-_]?titlepage|titlepage|front[-_]?matter|p[-_]?fmatter|colophon|copyright|"
    r"imprint|half[-_]?title|dedication)(?:\.|$)"
)
FRONT_NAMES = ("nav.xhtml", "toc.xhtml", "toc.ncx", "nav.ncx", "ncx")
FRONT_IDS = ("nav", "ncx", "cover", "titlepage", "title-page", "frontmatter")
# Term candidates.
LATIN_TERM, CJK_TERM = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", r"[一-鿿]{2,8}"


def strip(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.btrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    """array<string> of the lines; an end of line at the end begins no further line."""
    each = F.split(text, LINE_END)
    last = F.element_at(each, -1) == ""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(last, F.slice(each, 1, F.size(each) - 1)).otherwise(each)


#: Characters that weigh 1/1.5 of a token.
CJK = "[一-鿿぀-ヿ]"


def tokens(text: Column) -> Column:
    """The token estimate: CJK ideographs and kana weigh 1/1.5, other characters 1/4; at least 1,
    and 0 for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    return weighed(F.length(text), F.length(F.regexp_replace(text, CJK, "")))


def weighed(n: Column, other: Column) -> Column:
    """The estimate for n characters of which so many are no CJK ones."""
    weight = F.floor((n - other) / F.lit(1.5) + other / F.lit(4.0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), weight)).cast("int")


def basename(path: Column) -> Column:
    """What follows the last slash; slashes at the end don't count."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last suffix. A leading or trailing dot is no suffix."""
    base = basename(path)
    return F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^(.+)\.[^.]+$", 1), F.lit("")), base)


def is_technical(name: Column) -> Column:
    """Whether a text reads like a resource's name rather than a title; empty texts do."""
    return strip(stem(F.coalesce(name, F.lit("")))).rlike(rf"(?i)^(?:{TECHNICAL})?$")


def _title_like(own: Column, technical: Column, start: Column) -> Column:
    after = F.substring(own, F.length(start) + 1, F.lit(1))
    follows = (after == "") | F.contains(F.lit(TITLE_NEXT), after)
    return (own != "") & (F.length(own) <= TITLE_LONGEST) & ~technical & (start != "") & follows


def _title_start(own: Column) -> Column:
    return F.regexp_extract(own, rf"(?iU)^(?:{TITLE_START})", 0)


def is_chapter_title(text: Column) -> Column:
    own = strip(F.coalesce(text, F.lit("")))
    return _title_like(own, is_technical(own), _title_start(own))


def with_block_title(blocks: DataFrame, kind: str, level: str, text: str, name: str) -> DataFrame:
    """Adds the chapter title that a block gives, or null. Each regular expression has a column of
    its own on the way, so that it runs once for a row."""
    own, technical, start, like = (F.col(f"__{x}") for x in ("own", "technical", "start", "like"))
    rows = blocks.withColumn("__own", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("__technical", is_technical(own)).withColumn("__start", _title_start(own))
    rows = rows.withColumn("__like", _title_like(own, technical, start))
    depth = F.when(F.coalesce(F.col(level), F.lit(0)) == 0, 2).otherwise(F.col(level))
    heading = (F.col(kind) == "heading") & ((depth <= 1) | like | ((depth == 2) & (F.length(own) <= 40)))
    titled = (own != "") & ~technical & (heading | ((F.col(kind) == "paragraph") & like))
    return rows.withColumn(name, F.when(titled, F.substring(own, 1, 200))).drop("__own", "__technical", "__start", "__like")


def is_txt_heading(line: Column) -> Column:
    own = strip(line)
    found = F.lit(False)
    for pattern in TXT_HEADINGS:
        found = found | own.rlike(pattern)
    return found


def normal_href(href: Column) -> Column:
    """Without the fragment and folders, in lower case."""
    return F.lower(basename(F.split(F.coalesce(href, F.lit("")), "#")[0]))


def is_front_matter(name: Column, item_id: Column) -> Column:
    low, item_id = F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/"))), F.lower(F.coalesce(item_id, F.lit("")))
    base = basename(low)
    named = F.lit(False)
    for part in FRONT_NAMES:
        named = named | base.contains(part)
    named = named | low.rlike(FRONT_MATTER) | stem(base).rlike(FRONT_MATTER) | item_id.isin(*FRONT_IDS)
    return named | (item_id.contains("cover") & ~item_id.contains("chapter"))


def xml_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def terms(text: Column) -> Column:
    """array<string> of term candidates in order: capitalised runs, then ideograph runs."""
    return F.concat(F.regexp_extract_all(text, F.lit(LATIN_TERM), F.lit(1)), F.regexp_extract_all(text, F.lit(CJK_TERM), F.lit(0)))


def is_translatable(kind: Column, text: Column) -> Column:
    return kind.isin("paragraph", "caption", "heading", "footnote") & (strip(F.coalesce(text, F.lit(""))) != "")


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{name}} replaced, in the order given; a null value is empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def chapter_label(order: Column, title: Column, untitled: str = "Untitled") -> Column:
    """The chapter's number, counted from 1, and its title."""
    return F.concat((order + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(strip(title), F.lit("")), F.lit(untitled)))


def error_kind(summary: Column, failed_chunks: Column) -> Column:
    """What went wrong with a job: its export, some of its chunks, or the translation."""
    exported = F.coalesce(summary, F.lit("")).rlike("^(?:export_failed:|Export failed)")
    some = F.coalesce(failed_chunks, F.lit(0)) > 0
    return F.when(exported, "export_failed").when(some, "chunks_failed").otherwise("translation_failed")


def counted_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """How many tokens a public tokenizer's vocabulary file (its path, the same on all executors) gives for a text;
    0 for an empty or null one. Without a vocabulary, the estimate (:func:`tokens`)."""
    if vocabulary is None:
        return tokens(text)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        for batch in batches:
            yield pd.Series([len(e.ids) for e in own.encode_batch(batch.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(count(text))
