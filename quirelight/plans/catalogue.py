"""Queries over the driver's tables, one for each operator, with DuckDB SQL for the same rows.

Roles: documents are books of lines; conversations are books (conv_id) of chapters (turn); orders
are jobs, lineitem their chunks, customers their books; events are a log of calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import books, chapters, render
from quirelight.sources.store import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.array_join(name, ","))


def values_sql(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


WS = "'" + tx.WHITE + "'"

# ---- lines, paragraphs, tokens, chunks -------------------------------------------------------

PARAGRAPHS_SQL = f"""
raw AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM raw),
kinds AS (
  SELECT doc_id, line_no, trim(line, {WS}) AS s,
         CASE WHEN trim(line, {WS}) = '' THEN 'b' WHEN length(trim(line, {WS})) < 40 THEN 's' ELSE 'l' END AS kind
  FROM each),
starts AS (
  SELECT *, CASE WHEN kind = 'l' OR (kind = 's' AND coalesce(lag(kind) OVER w, '') <> 's') THEN 1 ELSE 0 END AS b
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ord FROM starts),
paragraphs AS (
  SELECT doc_id, ord::INT AS ord, string_agg(s, ' ' ORDER BY line_no) AS text
  FROM numbered WHERE kind <> 'b' GROUP BY doc_id, ord)"""
TOKENS_SQL = """CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor(
  (length(text) - length(regexp_replace(text, '[一-鿿぀-ヿ]', '', 'g'))) / 1.5
  + length(regexp_replace(text, '[一-鿿぀-ヿ]', '', 'g')) / 4.0)) END::INT"""
CHUNKS_SQL = f"""WITH RECURSIVE {PARAGRAPHS_SQL},
sized AS (SELECT doc_id, ord, {TOKENS_SQL} AS t FROM paragraphs WHERE trim(text, {WS}) <> ''),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM sized),
walk AS (
  SELECT doc_id, ord, t, n, 0 AS chunk, t AS cur FROM seq WHERE n = 1
  UNION ALL
  SELECT s.doc_id, s.ord, s.t, s.n, w.chunk + CASE WHEN w.cur + s.t > 200 THEN 1 ELSE 0 END,
         CASE WHEN w.cur + s.t > 200 THEN s.t ELSE w.cur + s.t END
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.n = w.n + 1),
chunks AS (
  SELECT doc_id, chunk::INT AS chunk, min(ord)::INT AS first_ord, max(ord)::INT AS last_ord, count(*)::INT AS n_blocks,
         sum(t)::INT AS tokens
  FROM walk GROUP BY doc_id, chunk)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return books.line_table(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def doc_paragraphs(spark: SparkSession, d: str, merge: bool = True) -> DataFrame:
    lists = books.paragraph_lists(spread(table(spark, d, "documents").select("doc_id", "text")), merge=merge)
    return lists.select("doc_id", F.posexplode("paragraphs").alias("ord", "text"))


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    lists = books.paragraph_lists(spread(table(spark, d, "documents").select("doc_id", "text")))
    return books.paragraph_chunks(lists, ["doc_id"], target=200)


@query(f"WITH {PARAGRAPHS_SQL} SELECT doc_id, ord, text FROM paragraphs")
def short_line_merge(spark, d):
    return doc_paragraphs(spark, d).select("doc_id", "ord", "text")


@query(f"""WITH {PARAGRAPHS_SQL}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS ord, s AS text FROM kinds WHERE kind <> 'b'""")
def line_blocks_nomerge(spark, d):
    return doc_paragraphs(spark, d, merge=False)


@query(f"WITH {PARAGRAPHS_SQL} SELECT doc_id, ord, text FROM paragraphs")
def line_table_merge(spark, d):
    """Paragraphs of texts that come as a table of lines."""
    return books.paragraphs(doc_lines(spark, d), ["doc_id"]).select("doc_id", "ord", "text")


@query(f"SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(f"""WITH t AS (SELECT doc_id, translate(text, 'aeiour', '漢字かなカ鿿') AS text FROM documents) SELECT doc_id, {TOKENS_SQL} AS tokens FROM t""")
def token_estimate_cjk(spark, d):
    """Texts of which six letters have become ideographs and kana."""
    rows = table(spark, d, "documents").select("doc_id", F.translate("text", "aeiour", "漢字かなカ鿿").alias("text"))
    return rows.select("doc_id", tx.tokens(F.col("text")).alias("tokens"))


@query(f"{CHUNKS_SQL} SELECT doc_id, chunk, first_ord, last_ord, n_blocks, tokens FROM chunks")
def chunk_pack(spark, d):
    return doc_chunks(spark, d).drop("block_ids")


@query(f"""{CHUNKS_SQL} SELECT doc_id, count(*) AS n_chunks, sum(tokens)::BIGINT AS tokens, max(tokens) AS largest FROM chunks GROUP BY doc_id""")
def chunk_pack_stats(spark, d):
    rows = doc_chunks(spark, d).groupBy("doc_id")
    return rows.agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


@query(f"""{CHUNKS_SQL}, tails AS (
  SELECT doc_id, chunk, ord, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY ord DESC) AS back FROM walk)
SELECT c.doc_id, c.chunk, coalesce(string_agg(t.ord::VARCHAR, ',' ORDER BY t.ord), '') AS carry_over
FROM chunks c LEFT JOIN tails t ON t.doc_id = c.doc_id AND t.chunk = c.chunk - 1 AND t.back <= 2 GROUP BY c.doc_id, c.chunk""")
def chunk_carry_over(spark, d):
    rows = books.carried_over(doc_chunks(spark, d), ["doc_id"], 2)
    return listed(rows.select("doc_id", "chunk", "carry_over"), "carry_over")


# ---- chapters --------------------------------------------------------------------------------

HEADED_SQL = f"""raw AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS l FROM documents),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM raw),
headed AS (
  SELECT doc_id, line_no * 2 + 1 AS line_no, trim(line, {WS}) AS line, FALSE AS heading FROM each
  UNION ALL SELECT doc_id, line_no * 2, 'Chapter ' || (line_no // 7 + 1), TRUE FROM each WHERE line_no % 7 = 3)"""


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a heading before every seventh, from the fourth on."""
    rows = doc_lines(spark, d)
    own = rows.select("doc_id", (F.col("line_no") * 2 + 1).alias("line_no"), tx.strip(F.col("line")).alias("line"))
    heads = rows.where("line_no % 7 = 3").select(
        "doc_id", (F.col("line_no") * 2).alias("line_no"), F.expr("concat('Chapter ', line_no div 7 + 1)").alias("line")
    )
    return own.unionByName(heads)


@query(f"""WITH {HEADED_SQL},
placed AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS no,
  max(heading::INT) OVER (PARTITION BY doc_id) AS any_heading FROM headed)
SELECT p.doc_id, greatest(p.no, 1)::INT AS chapter, max(h.line) AS title, count(*) AS n_lines, sum(length(p.line))::BIGINT AS n_chars
FROM placed p LEFT JOIN placed h ON h.doc_id = p.doc_id AND h.no = p.no AND h.heading
WHERE NOT p.heading AND (p.no > 0 OR p.any_heading = 0) GROUP BY p.doc_id, greatest(p.no, 1)""")
def txt_chapters(spark, d):
    rows = books.txt_chapters(headed_lines(spark, d), "doc_id")
    return rows.groupBy("doc_id", "chapter").agg(
        F.max("title").alias("title"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query(f"""WITH {HEADED_SQL},
placed AS (SELECT *, greatest(1, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS chapter FROM headed)
SELECT doc_id, chapter, coalesce(min(CASE WHEN heading THEN line END), 'Untitled') AS title, count(*) AS n_blocks
FROM placed GROUP BY doc_id, chapter""")
def detect_chapters(spark, d):
    rows = headed_lines(spark, d).select(
        "doc_id", F.col("line_no").alias("idx"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), F.col("line").alias("text")
    )
    out = books.detect_chapters(rows, book="doc_id")
    return out.groupBy("doc_id", "chapter").agg(F.max("chapter_title").alias("title"), F.count("*").alias("n_blocks"))


@query("""WITH RECURSIVE titled AS (SELECT doc_id // 40 AS doc_id, doc_id % 40 AS idx, CASE WHEN lang IN ('en', 'fr') THEN lang END AS title FROM documents),
walk AS (
  SELECT doc_id, idx, title, title IS NOT NULL AS kept, CASE WHEN title IS NOT NULL THEN idx END AS last_idx, title AS last_title FROM titled WHERE idx = 0
  UNION ALL
  SELECT t.doc_id, t.idx, t.title,
         t.title IS NOT NULL AND NOT coalesce(w.last_title = t.title AND w.last_idx = t.idx - 1, FALSE),
         CASE WHEN t.title IS NOT NULL AND NOT coalesce(w.last_title = t.title AND w.last_idx = t.idx - 1, FALSE) THEN t.idx ELSE w.last_idx END,
         CASE WHEN t.title IS NOT NULL AND NOT coalesce(w.last_title = t.title AND w.last_idx = t.idx - 1, FALSE) THEN t.title ELSE w.last_title END
  FROM walk w JOIN titled t ON t.doc_id = w.doc_id AND t.idx = w.idx + 1)
SELECT doc_id, idx, title FROM walk WHERE kept""")
def boundary_dedupe(spark, d):
    """Documents as blocks of books of forty, two languages as titles."""
    title = F.when(F.col("lang").isin("en", "fr"), F.col("lang"))
    rows = table(spark, d, "documents").select(F.expr("doc_id div 40").alias("doc_id"), F.expr("doc_id % 40").alias("idx"), title.alias("title"))
    return books.boundaries(rows, "doc_id")


NAMES = [(i, n) for i, n in enumerate([
    "P001.xhtml", "p002", "p-005", "item001.xhtml", "item12", "chap_01.xhtml", "chap_0004", "section1", "page-12", "titlepage",
    "p-toc", "toc", "第一章", "Chapter One", "prologue", "尾聲", "OEBPS/part", "v1.2 notes", "Line one.", "a12", "index", "ab-12",
    "  cover  ", "", "text/5", "A sentence about nothing", "x1234567", "copyright.html"])]
STEM_SQL = """CASE WHEN regexp_extract(base, '(?s)^(.+)\\.[^.]+$', 1) <> '' THEN regexp_extract(base, '(?s)^(.+)\\.[^.]+$', 1) ELSE base END"""
TECH_RE = "(?i)^(?:" + tx.TECHNICAL + ")$"


@query(f"""WITH n AS (SELECT id, name FROM {values_sql(NAMES, 'id, name')}
  UNION ALL SELECT 1000 + page_id, regexp_extract(url, '([^/]*)$', 1) FROM pages),
based AS (SELECT *, regexp_extract(regexp_replace(name, '/+$', ''), '([^/]*)$', 1) AS base FROM n),
stemmed AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem FROM based)
SELECT id::BIGINT AS id, name, stem = '' OR regexp_matches(stem, '{TECH_RE}') AS technical FROM stemmed""")
def technical_names(spark, d):
    own = spark.createDataFrame(NAMES, "id long, name string")
    tails = table(spark, d, "pages").select((F.col("page_id") + 1000).alias("id"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    return own.unionByName(tails).select("id", "name", tx.is_technical(F.col("name")).alias("technical"))


TITLES = [(i, *t) for i, t in enumerate([
    ("paragraph", None, "第一話　出發的早晨"), ("paragraph", None, "第二話　雨中的車站"), ("paragraph", None, "幕間　旅人①"), ("paragraph", None, "尾聲"),
    ("paragraph", None, "追加SS　回信"), ("heading", 2, "第一章 黎明"), ("paragraph", None, "第一話正文續頁"), ("paragraph", None, "幕間正文"),
    ("heading", 1, "p-005"), ("heading", 1, "Any words at all"), ("heading", 2, "Short heading"), ("heading", 3, "Short heading"),
    ("heading", 2, "A heading of the second level that is longer than forty characters"), ("paragraph", None, "Chapter 12: Rain"),
    ("paragraph", None, "chapter 3"), ("paragraph", None, "Chapterhouse"), ("heading", None, "Part 2 - Home"), ("paragraph", None, "Prologue"),
    ("paragraph", None, "Prologues"), ("caption", None, "Prologue"), ("paragraph", None, "x" * 90), ("paragraph", None, " "), ("paragraph", None, None)])]
TITLE_CTE = f"""f AS (SELECT * FROM {values_sql(TITLES, 'i, kind, level, given')}),
t AS (SELECT d.doc_id AS id, kind, level, given || CASE WHEN d.doc_id % 3 = 0 THEN ' ' || substr(d.text, 1, d.doc_id % 30) ELSE '' END AS text FROM documents d JOIN f ON d.doc_id % {len(TITLES)} = i),
owned AS (SELECT *, trim(coalesce(text, ''), {WS}) AS own FROM t),
based AS (SELECT *, regexp_extract(regexp_replace(own, '/+$', ''), '([^/]*)$', 1) AS base FROM owned),
stemmed AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem, regexp_extract(own, '(?i)^(?:{tx.TITLE_START})') AS start FROM based),
judged AS (SELECT *, stem = '' OR regexp_matches(stem, '{TECH_RE}') AS technical FROM stemmed),
titled AS (SELECT *, own <> '' AND length(own) <= 80 AND NOT technical AND start <> ''
  AND (length(own) = length(start) OR contains('{tx.TITLE_NEXT}', substr(own, length(start) + 1, 1))) AS is_title FROM judged)"""


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Title-like and other texts, one for each document; behind every third one stands how the document begins."""
    fixture = spark.createDataFrame(TITLES, "i long, kind string, level int, given string")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.substring("text", F.lit(1), F.col("doc_id") % 30))).otherwise("")
    rows = table(spark, d, "documents").join(F.broadcast(fixture), F.col("doc_id") % len(TITLES) == F.col("i"))
    return rows.select(F.col("doc_id").alias("id"), "kind", "level", F.concat("given", more).alias("text"))


@query(f"WITH {TITLE_CTE} SELECT id, is_title FROM titled")
def chapter_title_predicate(spark, d):
    return titles(spark, d).select("id", tx.is_chapter_title(F.col("text")).alias("is_title"))


@query(f"""WITH {TITLE_CTE} SELECT id, CASE WHEN own = '' OR technical THEN NULL
  WHEN kind = 'heading' AND (coalesce(level, 2) <= 1 OR is_title OR (coalesce(level, 2) = 2 AND length(own) <= 40)) THEN own
  WHEN kind = 'paragraph' AND is_title THEN own END AS title FROM titled""")
def block_titles(spark, d):
    return tx.with_block_title(titles(spark, d), "kind", "level", "text", "title").select("id", "title")


@query(f"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), {WS}) AS own FROM pages),
based AS (SELECT *, regexp_extract(regexp_replace(own, '/+$', ''), '([^/]*)$', 1) AS base FROM t),
stemmed AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem FROM based)
SELECT page_id, CASE WHEN own <> '' AND NOT (stem = '' OR regexp_matches(stem, '{TECH_RE}')) THEN substr(own, 1, 200) END AS title FROM stemmed""")
def guess_title(spark, d):
    inner = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    own = tx.strip(F.regexp_replace(inner, "<[^>]*>", " "))
    return table(spark, d, "pages").select("page_id", F.when((own != "") & ~tx.is_technical(own), F.substring(own, 1, 200)).alias("title"))


ITEMS = [(i, *x) for i, x in enumerate([
    ("Text/cover.xhtml", "x1"), ("Text/Title-Page.xhtml", "x2"), ("nav.xhtml", "n"), ("Text/chap1.xhtml", "cover-image"), ("Text/chap2.xhtml", "chapter-cover"),
    ("OPS\\imprint.html", "x3"), ("a/b/toc.ncx", "ncx"), ("Text/ch01.xhtml#top", "c1"), ("dedication", "d"), ("uncovered.xhtml", "u"), (None, None)])]


@query(f"""WITH f AS (SELECT * FROM {values_sql(ITEMS, 'i, n, item')}),
g AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN n ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) || '/' || n END AS name, item FROM pages JOIN f ON page_id % {len(ITEMS)} = i),
t AS (SELECT id, name, item, lower(replace(coalesce(name, ''), chr(92), '/')) AS low, lower(coalesce(item, '')) AS iid FROM g),
based AS (SELECT *, regexp_extract(regexp_replace(low, '/+$', ''), '([^/]*)$', 1) AS base FROM t),
stemmed AS (SELECT *, {STEM_SQL} AS stem FROM based)
SELECT id, regexp_matches(base, 'nav.xhtml|toc.xhtml|toc.ncx|nav.ncx|ncx') OR regexp_matches(low, '{tx.FRONT_MATTER}') OR regexp_matches(stem, '{tx.FRONT_MATTER}')
  OR iid IN ('nav', 'ncx', 'cover', 'titlepage', 'title-page', 'frontmatter') OR (contains(iid, 'cover') AND NOT contains(iid, 'chapter')) AS front,
  lower(regexp_extract(regexp_replace(string_split(coalesce(name, ''), '#')[1], '/+$', ''), '([^/]*)$', 1)) AS href FROM stemmed""")
def front_matter(spark, d):
    """Names and ids of a package's items, below folders that are called as the pages' hosts."""
    fixture = spark.createDataFrame(ITEMS, "i long, n string, item string")
    host = F.concat(F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit("/"), F.col("n"))
    rows = table(spark, d, "pages").join(F.broadcast(fixture), F.col("page_id") % len(ITEMS) == F.col("i"))
    rows = rows.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.col("n")).otherwise(host).alias("name"), "item")
    return rows.select("id", tx.is_front_matter(F.col("name"), F.col("item")).alias("front"), tx.normal_href(F.col("name")).alias("href"))


# ---- books made of conversations --------------------------------------------------------------

CONV_SQL = f"""blocks AS (
  SELECT conv_id AS book_id, 'c' || (turn // 3) AS chapter_id, turn AS ord, 'b' || turn AS block_id,
         CASE role WHEN 'system' THEN 'image' WHEN 'user' THEN 'heading' ELSE 'paragraph' END AS type, 2 AS level, text,
         CASE role WHEN 'system' THEN 'img' || turn || '.png' END AS image_ref, NULL::VARCHAR AS image_alt FROM conversations),
chapters AS (
  SELECT book_id, chapter_id, (row_number() OVER (PARTITION BY book_id ORDER BY min(ord)) - 1)::INT AS ord, 'Title ' || chapter_id AS title
  FROM blocks GROUP BY book_id, chapter_id)"""


def conv_blocks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "image").when(F.col("role") == "user", "heading").otherwise("paragraph")
    image = F.when(F.col("role") == "system", F.concat(F.lit("img"), "turn", F.lit(".png")))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("book_id"), F.expr("concat('c', turn div 3)").alias("chapter_id"), F.col("turn").alias("ord"),
        F.concat(F.lit("b"), "turn").alias("block_id"), kind.alias("type"), F.lit(2).alias("level"), "text",
        image.alias("image_ref"), F.lit(None).cast("string").alias("image_alt"),
    )


def conv_chapters(blocks: DataFrame) -> DataFrame:
    rows = blocks.groupBy("book_id", "chapter_id").agg(F.min("ord").alias("ord"))
    rows = chapters.renumbered(rows, ["book_id"], ["ord"])
    return rows.withColumn("title", F.concat(F.lit("Title "), "chapter_id"))


@query(f"""WITH {CONV_SQL} SELECT book_id, block_id FROM blocks WHERE type IN ('paragraph', 'caption', 'heading', 'footnote') AND trim(coalesce(text, ''), {WS}) <> ''""")
def translatable_filter(spark, d):
    rows = conv_blocks(spark, d)
    return rows.where(tx.is_translatable(F.col("type"), F.col("text"))).select("book_id", "block_id")


@query(f"""WITH {CONV_SQL} SELECT c.book_id, c.chapter_id, c.ord, count(b.ord) AS n_blocks,
  count(CASE WHEN b.type <> 'image' AND trim(coalesce(b.text, ''), {WS}) <> '' THEN 1 END) AS n_translatable, count(CASE WHEN b.type = 'image' THEN 1 END) AS n_images
FROM chapters c LEFT JOIN blocks b USING (book_id, chapter_id) GROUP BY c.book_id, c.chapter_id, c.ord""")
def chapter_block_counts(spark, d):
    rows = conv_blocks(spark, d)
    return chapters.block_counts(conv_chapters(rows), rows).drop("title")


@query(f"""WITH {CONV_SQL} SELECT book_id, count(DISTINCT chapter_id) AS n_chapters, count(*) AS n_blocks, count(CASE WHEN type = 'image' THEN 1 END) AS n_images
FROM blocks GROUP BY book_id""")
def preview_summary(spark, d):
    rows = conv_blocks(spark, d)
    per = chapters.block_counts(conv_chapters(rows), rows).groupBy("book_id")
    return per.agg(F.count("*").alias("n_chapters"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_images").alias("n_images"))


@query(f"""WITH {CONV_SQL}, firsts AS (
  SELECT *, trim(coalesce(text, ''), {WS}) AS s, row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY ord) AS n
  FROM blocks WHERE type IN ('paragraph', 'heading') AND trim(coalesce(text, ''), {WS}) <> ''),
joined AS (SELECT book_id, chapter_id, string_agg(s, ' ' ORDER BY n) AS t FROM firsts WHERE n <= 2 GROUP BY book_id, chapter_id)
SELECT book_id, chapter_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '…' ELSE t END AS snippet FROM joined""")
def chapter_snippet(spark, d):
    return chapters.snippets(conv_blocks(spark, d))


@query(f"""WITH {CONV_SQL}, shown AS (SELECT *, CASE WHEN type = 'image' THEN '[image]' ELSE trim(coalesce(text, ''), {WS}) END AS s FROM blocks)
SELECT book_id, chapter_id, string_agg(s || chr(10) || chr(10), '' ORDER BY ord) AS preview FROM shown WHERE s <> '' GROUP BY book_id, chapter_id""")
def chapter_preview(spark, d):
    return chapters.preview_text(conv_blocks(spark, d))


@query(f"""WITH {CONV_SQL} SELECT book_id, chapter_id, ord, (ord + 1) || '. ' || title AS label FROM chapters""")
def chapter_labels(spark, d):
    rows = conv_chapters(conv_blocks(spark, d))
    return rows.select("book_id", "chapter_id", "ord", tx.chapter_label(F.col("ord"), F.col("title")).alias("label"))


@query(f"""WITH {CONV_SQL} SELECT book_id, chapter_id, ord, CASE WHEN chapter_id = 'c1' THEN 'New name' ELSE title END AS title FROM chapters""")
def chapter_rename(spark, d):
    return chapters.rename(conv_chapters(conv_blocks(spark, d)), "c1", " New name ").select(*chapters.CHAPTER)


@query(f"""WITH {CONV_SQL} SELECT book_id, chapter_id, (row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1)::INT AS ord, title FROM chapters WHERE chapter_id <> 'c0'""")
def chapter_remove(spark, d):
    rows = conv_blocks(spark, d)
    return chapters.remove(conv_chapters(rows), rows, "c0")[0].select(*chapters.CHAPTER)


@query(f"""WITH {CONV_SQL} SELECT book_id, chapter_id, block_id, (row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY late, ord) - 1)::INT AS ord FROM (
  SELECT book_id, block_id, ord, chapter_id = 'c1' AS late, CASE WHEN chapter_id = 'c1' THEN 'c0' ELSE chapter_id END AS chapter_id FROM blocks)""")
def chapter_merge(spark, d):
    rows = conv_blocks(spark, d)
    return chapters.merge_next(conv_chapters(rows), rows, "c0", "c1")[1].select("book_id", "chapter_id", "block_id", "ord")


@query(f"""WITH {CONV_SQL}, cut AS (SELECT *, CASE WHEN chapter_id = 'c0' AND ord >= 1 THEN 'c0_s1' ELSE chapter_id END AS new_id FROM blocks)
SELECT book_id, new_id AS chapter_id, block_id, (row_number() OVER (PARTITION BY book_id, new_id ORDER BY ord) - 1)::INT AS ord FROM cut""")
def chapter_split(spark, d):
    rows = conv_blocks(spark, d)
    return chapters.split_at(conv_chapters(rows), rows, "c0", "b1")[1].select("book_id", "chapter_id", "block_id", "ord")


@query(f"""WITH {CONV_SQL}, ids AS (SELECT * FROM (VALUES ('c2', 0), ('c0', 1), ('c1', 2)) AS v(chapter_id, ord))
SELECT c.book_id, c.chapter_id, i.ord::INT AS ord, c.title FROM chapters c JOIN ids i USING (chapter_id)""")
def chapter_reorder(spark, d):
    return chapters.reorder(conv_chapters(conv_blocks(spark, d)), ["c2", "c0", "c1"], check=False)


@query(f"""WITH {CONV_SQL} SELECT book_id, chapter_id, (count(*) // 2)::INT AS at FROM blocks GROUP BY book_id, chapter_id HAVING count(*) >= 2""")
def chapter_midpoint(spark, d):
    return chapters.midpoints(conv_blocks(spark, d))


def _render_sql(mode: str) -> str:
    esc = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"
    depth = "(b.ord % 5 + 1)"
    heading = f"'<h' || {depth} || '>' || {esc('b.text')} || '</h' || {depth} || '>'"
    if mode == "compact":
        heading = f"CASE WHEN {depth} >= 3 THEN '<p class=\"subhead\">' || {esc('b.text')} || '</p>' ELSE {heading} END"
    return f"""WITH {CONV_SQL}, lines AS (
  SELECT b.*, CASE b.type WHEN 'heading' THEN {heading} WHEN 'paragraph' THEN '<p>' || {esc('b.text')} || '</p>'
    WHEN 'image' THEN CASE WHEN b.ord = 0 THEN '<img src="images/img0.png" alt=""/>' END END AS h FROM blocks b)
SELECT c.book_id, c.chapter_id, '<div class="chapter">' || chr(10) || '<h1>' || {esc('c.title')} || '</h1>' || chr(10)
  || coalesce(string_agg(l.h || chr(10), '' ORDER BY l.ord), '') || '</div>' AS html
FROM chapters c LEFT JOIN lines l USING (book_id, chapter_id) GROUP BY c.book_id, c.chapter_id, c.title"""


def _rendered(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = conv_blocks(spark, d).withColumn("level", (F.col("ord") % 5 + 1).cast("int"))
    assets = rows.select("book_id", F.lit("img0.png").alias("asset_key"), F.lit("images/img0.png").alias("file_name")).distinct()
    return render.chapter_html(conv_chapters(rows), render.with_images(rows, assets), mode).drop("ord")


@query(_render_sql("standard"))
def render_standard(spark, d):
    return _rendered(spark, d, "standard")


@query(_render_sql("compact"))
def render_compact(spark, d):
    return _rendered(spark, d, "compact")
