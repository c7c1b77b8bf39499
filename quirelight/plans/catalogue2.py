"""More of the catalogue: glossaries, jobs, validation, prompts, languages, packages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.functions import languages as lang
from quirelight.functions import text as tx
from quirelight.operators import books, glossary, jobs, packages, render, translate, validate
from quirelight.plans.catalogue import CONV_SQL, STEM_SQL, TECH_RE, WS, conv_blocks, conv_chapters, query, table, values_sql
from quirelight.sources import epub, epub_io, store

# ---- glossaries -------------------------------------------------------------------------------

ENTRIES_SQL = """entries AS (
  SELECT 'g' || (item_id % 3) AS glossary_id, item_id AS entry_id, regexp_extract(text, '[a-z]{6,}') AS source, upper(regexp_extract(text, '[a-z]{4,}')) AS target,
         CASE WHEN item_id % 2 = 0 THEN 'proper_noun' ELSE 'terminology' END AS type, item_id % 4 <> 0 AS confirmed,
         regexp_extract(text, '[A-Z][a-z]{3,}') AS variant FROM benchmark)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries made of benchmark texts: their first long word, a shorter one, a capitalised one."""
    pick = lambda p: F.regexp_extract("text", p, 0)
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("g"), F.col("item_id") % 3).alias("glossary_id"), F.col("item_id").alias("entry_id"), pick("[a-z]{6,}").alias("source"),
        F.upper(pick("[a-z]{4,}")).alias("target"), F.when(F.col("item_id") % 2 == 0, "proper_noun").otherwise("terminology").alias("type"),
        F.lit(None).cast("string").alias("notes"), (F.col("item_id") % 4 != 0).alias("confirmed"), F.array(pick("[A-Z][a-z]{3,}")).alias("variants"),
    )


@query(f"""WITH {ENTRIES_SQL} SELECT DISTINCT d.doc_id, e.entry_id FROM documents d JOIN entries e ON e.source <> '' AND contains(d.text, e.source)""")
def glossary_prefilter(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", "text")
    plain = entries(spark, d).withColumn("variants", F.array().cast("array<string>"))
    return glossary.relevant(chunks, plain, "doc_id")


@query(f"""WITH {ENTRIES_SQL}, needles AS (SELECT entry_id, source AS n FROM entries UNION SELECT entry_id, variant FROM entries)
SELECT DISTINCT d.doc_id, e.entry_id FROM documents d JOIN needles e ON e.n <> '' AND contains(d.text, e.n)""")
def glossary_prefilter_variants(spark, d):
    return glossary.relevant(table(spark, d, "documents").select("doc_id", "text"), entries(spark, d), "doc_id")


@query(f"""WITH {ENTRIES_SQL}, needles AS (SELECT entry_id, source AS n FROM entries UNION SELECT entry_id, variant FROM entries)
SELECT DISTINCT d.doc_id, e.entry_id FROM documents d JOIN needles e ON e.n <> '' AND contains(d.text, e.n)""")
def glossary_prefilter_keyed(spark, d):
    """The way for many needles, forced."""
    chunks = table(spark, d, "documents").select("doc_id", "text")
    return glossary.relevant(chunks, entries(spark, d), "doc_id", most=0)


@query(f"""WITH {ENTRIES_SQL}, slots AS (SELECT substr(glossary_id, 2)::INT + 1 AS slot, entry_id AS pos, source, target FROM entries)
SELECT slot, pos, source, target FROM slots WHERE source <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY slot, pos) = 1""")
def glossary_slot_merge(spark, d):
    rows = entries(spark, d)
    slot = (F.substring("glossary_id", 2, 9).cast("int") + 1).alias("slot")
    return glossary.first_wins(rows.select(slot, F.col("entry_id").alias("pos"), F.concat(F.lit(" "), "source").alias("source"), "target"))


@query(f"""WITH {ENTRIES_SQL} SELECT glossary_id, entry_id, source, target, type,
  row_number() OVER (PARTITION BY glossary_id ORDER BY CASE type WHEN 'proper_noun' THEN 0 ELSE 1 END, source, entry_id)::INT AS place FROM entries WHERE confirmed""")
def glossary_prompt_order(spark, d):
    return glossary.prompt_list(entries(spark, d)).select("glossary_id", "entry_id", "source", "target", "type", "place")


@query(f"""WITH {ENTRIES_SQL} SELECT glossary_id, count(CASE WHEN confirmed THEN 1 END) AS confirmed, count(*) AS total FROM entries GROUP BY glossary_id""")
def glossary_counts(spark, d):
    return glossary.confirmed_counts(entries(spark, d))


@query(f"""WITH {ENTRIES_SQL}, kept AS (SELECT entry_id, source, CASE WHEN entry_id % 5 = 2 THEN 'T' || entry_id ELSE target END AS target,
  confirmed OR entry_id % 5 = 0 AS confirmed FROM entries WHERE entry_id % 5 <> 1)
SELECT * FROM kept UNION ALL SELECT 9000, 'added', 'ADDED', FALSE""")
def glossary_edits(spark, d):
    rows = entries(spark, d)
    k = F.col("entry_id") % 5
    action = F.when(k == 0, "confirm").when(k == 1, "reject").when(k == 2, "update")
    blank = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in ("entry_id", "confirmed", "target")}
    change = rows.where(k <= 2).select("entry_id", action.alias("action"), F.concat(F.lit("T"), "entry_id").alias("target"), *(v.alias(c) for c, v in blank.items()))
    added = spark.range(1).select(F.lit(9000).cast("long").alias("entry_id"), F.lit("add").alias("action"), F.lit("ADDED").alias("target"), *((F.lit("added") if c == "source" else v).alias(c) for c, v in blank.items()))
    return glossary.edited(rows, change.unionByName(added)).select("entry_id", "source", "target", "confirmed")


SIDES_SQL = """sides AS (SELECT conv_id AS pair_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS idx FROM conversations WHERE role <> 'system'),
pairs AS (SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.idx, t.idx) AS idx, s.text AS source_text, t.text AS target_text
  FROM (SELECT * FROM sides WHERE role = 'user') s FULL JOIN (SELECT * FROM sides WHERE role = 'assistant') t ON s.pair_id = t.pair_id AND s.idx = t.idx)"""


def conv_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("ord"), "role", "text")
    return glossary.aligned(rows.where("role = 'user'"), rows.where("role = 'assistant'"))


@query(f"WITH {SIDES_SQL} SELECT pair_id, idx, source_text, target_text FROM pairs WHERE source_text IS NOT NULL AND target_text IS NOT NULL")
def align_pairs(spark, d):
    return conv_pairs(spark, d).where("source_text is not null and target_text is not null").withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {SIDES_SQL} SELECT pair_id, idx, source_text IS NULL AS target_only FROM pairs WHERE source_text IS NULL OR target_text IS NULL")
def align_unpaired(spark, d):
    rows = conv_pairs(spark, d).where("source_text is null or target_text is null")
    return rows.select("pair_id", F.col("idx").cast("long").alias("idx"), F.col("source_text").isNull().alias("target_only"))


@query(f"""WITH {SIDES_SQL}, n AS (SELECT pair_id, count(source_text) AS n_source, count(target_text) AS n_target FROM pairs GROUP BY pair_id)
SELECT *, abs(n_source - n_target) / greatest(n_source, n_target)::DOUBLE AS ratio,
  n_source = 0 OR n_target = 0 OR abs(n_source - n_target) / greatest(n_source, n_target)::DOUBLE > 0.3 AS manual FROM n""")
def align_gate(spark, d):
    return glossary.gate(conv_pairs(spark, d))


# Letters beyond ASCII count as word characters, so they are masked before a boundary is looked for.
TERMS_SQL = r"regexp_extract_all(regexp_replace({c}, '[^\x00-\x7F]', '0', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1)"
TERM_PAIRS_SQL = f"""p AS (SELECT a.doc_id AS pair_id, {TERMS_SQL.format(c='a.text')} AS s, {TERMS_SQL.format(c='b.text')} AS t
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0),
src AS (SELECT DISTINCT pair_id, unnest(s) AS term FROM p),
freq AS (SELECT term, count(*) AS n FROM src WHERE length(term) >= 2 GROUP BY term),
tgt AS (SELECT pair_id, unnest(t) AS target FROM p)"""
TOP_SQL = "top AS (SELECT * FROM freq ORDER BY n DESC, encode(term) LIMIT 200)"


def doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    a = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("source_text"))
    b = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("target_text"))
    return a.join(b, "pair_id")


@query(f"WITH {TERM_PAIRS_SQL}, {TOP_SQL} SELECT term, n FROM top")
def term_frequency_topk(spark, d):
    return glossary.term_counts(doc_pairs(spark, d), ["pair_id"]).orderBy(F.desc("n"), "term").limit(200)


@query(f"WITH {TERM_PAIRS_SQL} SELECT term, target, count(*) AS n FROM src JOIN tgt USING (pair_id) WHERE length(term) >= 2 AND length(target) >= 2 GROUP BY term, target HAVING count(*) >= 3")
def term_cooccurrence(spark, d):
    return glossary.cooccurrence(doc_pairs(spark, d)).where("n >= 3")


@query(f"""WITH {TERM_PAIRS_SQL}, {TOP_SQL},
co AS (SELECT term, target, count(*) AS c FROM src JOIN tgt USING (pair_id) WHERE term IN (SELECT term FROM top) AND length(target) >= 2 GROUP BY term, target),
best AS (SELECT term, target FROM co QUALIFY row_number() OVER (PARTITION BY term ORDER BY c DESC, encode(target)) = 1)
SELECT term, n, target FROM top JOIN best USING (term) WHERE n >= 2 AND target <> term""")
def term_candidates(spark, d):
    return glossary.term_candidates(doc_pairs(spark, d), ["pair_id"])


# ---- jobs -------------------------------------------------------------------------------------

JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS book_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'paused' ELSE 'pending' END AS status FROM orders),
chunks AS (SELECT l_orderkey AS job_id, l_linenumber AS chunk_id, l_partkey AS part,
  CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'in_progress' END END AS status FROM lineitem)"""


def job_table(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "P", "paused").otherwise("pending")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("book_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))


def job_chunks(spark: SparkSession, d: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = F.when(flag == "R", "failed").when(flag == "A", "completed").when(line == "O", "pending").otherwise("in_progress")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_partkey").alias("part"), status.alias("status"))


def job_books(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("title"))


PROGRESS_SQL = """progress AS (SELECT job_id, count(*) AS total, count(CASE WHEN status = 'completed' THEN 1 END) AS completed, count(CASE WHEN status = 'failed' THEN 1 END) AS failed
  FROM chunks GROUP BY job_id)"""
LIST_SQL = """SELECT job_id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, job_id::VARCHAR) AS title, status, created_at
FROM jobs LEFT JOIN customer ON c_custkey = book_id"""


@query(f"WITH {JOBS_SQL}, {PROGRESS_SQL} SELECT *, (100 * (completed + failed) // total)::INT AS percent FROM progress")
def job_progress(spark, d):
    return jobs.progress(job_chunks(spark, d))


@query(f"""WITH {JOBS_SQL}, {PROGRESS_SQL} SELECT j.job_id, CASE WHEN coalesce(p.failed, 0) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS final_status
FROM jobs j LEFT JOIN progress p USING (job_id)""")
def job_final_status(spark, d):
    return jobs.final_status(job_table(spark, d), job_chunks(spark, d))


@query(f"WITH {JOBS_SQL} {LIST_SQL}")
def list_jobs(spark, d):
    return jobs.job_list(job_table(spark, d), job_books(spark, d))


@query(f"WITH {JOBS_SQL} {LIST_SQL} WHERE status IN ('pending', 'processing', 'paused', 'completed_with_errors')")
def list_incomplete_jobs(spark, d):
    return jobs.incomplete(job_table(spark, d), job_books(spark, d))


@query(f"WITH {JOBS_SQL} SELECT job_id, chunk_id, status FROM chunks WHERE status IN ('pending', 'failed')")
def pending_chunks(spark, d):
    return jobs.pending(job_chunks(spark, d)).select("job_id", "chunk_id", "status")


@query(f"""WITH {JOBS_SQL} SELECT j.job_id, CASE WHEN j.job_id % 4 = 0 THEN 'cancelled' ELSE j.status END AS status, j.book_id FROM jobs j
UNION ALL SELECT job_id + 100000000, 'cancelled', book_id + 1 FROM jobs WHERE job_id % 4 = 0""")
def upsert(spark, d):
    old = job_table(spark, d).select("job_id", "status", "book_id")
    new = old.where("job_id % 4 = 0").select("job_id", F.lit("cancelled").alias("status"), (F.col("book_id") + 1).alias("book_id"))
    fresh = new.withColumn("job_id", F.col("job_id") + 100000000)
    return jobs.upserted(old, new.unionByName(fresh), ["job_id"], ["status"])


@query("""SELECT l_orderkey AS job_id, max_by(l_returnflag, l_linenumber) AS flag, max(l_linenumber) AS version FROM lineitem GROUP BY l_orderkey""")
def latest_wins(spark, d):
    """An order's line numbers repeat: the first row of the log counts."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("version"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return jobs.latest(rows, ["job_id"], "version", ["file", "row"]).drop("file", "row")


@query(f"""WITH {JOBS_SQL} SELECT job_id, chunk_id, status FROM chunks WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE book_id % 7 = 0)
UNION ALL SELECT job_id, 1, 'pending' FROM jobs WHERE book_id % 7 = 0""")
def replace_partition(spark, d):
    old = job_chunks(spark, d).drop("part")
    new = job_table(spark, d).where("book_id % 7 = 0").select("job_id", F.lit(1).alias("chunk_id"), F.lit("pending").alias("status"))
    return jobs.replaced(old, new, ["job_id"])


@query(f"""WITH {JOBS_SQL}, gone AS (SELECT job_id FROM jobs WHERE status = 'paused')
SELECT 'jobs' AS name, count(*) AS n FROM jobs WHERE job_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE job_id NOT IN (SELECT * FROM gone)""")
def delete_cascade(spark, d):
    tables = {"jobs": job_table(spark, d), "chunks": job_chunks(spark, d)}
    gone = tables["jobs"].where("status = 'paused'").select(F.col("job_id").alias("id"))
    left = jobs.deleted(tables, gone, {"jobs": "job_id", "chunks": "job_id"})
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()]
    return counts[0].unionByName(counts[1])


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'processing' ELSE status END AS status,
  CASE WHEN job_id % 12 = 0 THEN 'new' WHEN job_id % 4 = 0 THEN 'old' END AS error FROM jobs""")
def update_status(spark, d):
    rows = job_table(spark, d).withColumn("error", F.when(F.col("job_id") % 4 == 0, "old"))
    changes = rows.where("job_id % 6 = 0").select("job_id", F.lit("processing").alias("new_status"), F.when(F.col("job_id") % 12 == 0, "new").alias("new_error"))
    return jobs.with_status(rows, changes).select("job_id", "status", "error")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T: ' || text ELSE text END AS text FROM documents""")
def apply_translations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return jobs.applied(rows, rows.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("T: "), "text")), ["doc_id"])


EVENTS_SQL = """e AS (SELECT user_id, ts, event_id, event_type = 'error' OR value < 20 AS bad FROM events),
g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM g)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    bad = (F.col("event_type") == "error") | (F.col("value") < 20)
    return table(spark, d, "events").select("user_id", "ts", "event_id", bad.alias("bad"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, streak::BIGINT AS streak FROM s")
def breaker_streak(spark, d):
    return jobs.streaks(event_log(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "streak")


@query(f"WITH {EVENTS_SQL} SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM s WHERE streak >= 3 GROUP BY user_id")
def breaker_opens(spark, d):
    return jobs.broken(event_log(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""SELECT policy, a::INT AS attempt, ((a - 1) * delay)::DOUBLE AS wait, (delay * a * (a - 1) / 2)::DOUBLE AS waited
FROM (SELECT p_partkey AS policy, (p_partkey % 5) / 2.0 AS delay, unnest(range(1, greatest(1, p_size % 6) + 1)) AS a FROM part)""")
def retry_schedule(spark, d):
    """A policy for each part: its size gives the attempts, its key the delay."""
    policies = table(spark, d, "part").select(F.col("p_partkey").alias("policy"), (F.col("p_size") % 6).cast("int").alias("attempts"), ((F.col("p_partkey") % 5) / 2).alias("delay"))
    return jobs.retry_schedule(policies)


STATUSES = ("pending", "processing", "paused", "completed", "completed_with_errors", "cancelled")
ACTIONS = ("cancel", "pause", "resume", "retry", "remove")


@query(f"""WITH i AS (SELECT o_orderkey AS item_id, ({list(STATUSES)})[(o_custkey % 6 + 1)::INT] AS status, ({list(ACTIONS)})[(o_orderkey % 5 + 1)::INT] AS action FROM orders),
t AS (SELECT * FROM {values_sql(list(jobs.TRANSITIONS), 'action, status, new_status, asked')})
SELECT i.item_id, i.action, i.status, coalesce(t.new_status, i.status) AS new_status, t.asked, t.new_status IS NOT NULL AS allowed,
  CASE WHEN i.action = 'retry' AND t.new_status IS NOT NULL THEN NULL ELSE 'e' END AS new_error
FROM i LEFT JOIN t ON t.action = i.action AND t.status = i.status""")
def queue_transitions(spark, d):
    """Orders as queue items, each asked for one action."""
    pick = lambda names, key: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col(key) % len(names) + 1).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), pick(STATUSES, "o_custkey").alias("status"), F.lit("e").alias("error"), pick(ACTIONS, "o_orderkey").alias("action"))
    return jobs.moved(rows.drop("action"), rows.select("item_id", "action"))


# ---- validation -------------------------------------------------------------------------------

LABELLED_SQL = """labelled AS (SELECT d.doc_id, 'ch' || (d.doc_id % 10) AS chapter_id, d.doc_id % 50 AS book_id,
  CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'pending' WHEN l.doc_id IS NOT NULL THEN 'completed' ELSE 'in_progress' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "pending").when(F.col("quality").isNotNull(), "completed").otherwise("in_progress")
    return rows.select("doc_id", F.concat(F.lit("ch"), F.col("doc_id") % 10).alias("chapter_id"), (F.col("doc_id") % 50).alias("book_id"), status.alias("status"))


@query(f"WITH {LABELLED_SQL} SELECT book_id, chapter_id, count(*) AS n_failed FROM labelled WHERE status = 'failed' GROUP BY book_id, chapter_id")
def l2_failed_by_chapter(spark, d):
    return validate.failed_by_chapter(labelled(spark, d))


@query(f"""WITH {LABELLED_SQL} SELECT book_id, 'b' || doc_id AS block_id FROM labelled JOIN documents d USING (doc_id)
WHERE status <> 'completed' AND d.lang <> 'de' AND trim(coalesce(CASE WHEN doc_id % 9 > 0 THEN d.text END, ''), {WS}) <> ''""")
def l2_missing_blocks(spark, d):
    """Documents as blocks: German ones are images, every ninth has no text; labels tell what is done."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", "image").otherwise("paragraph").alias("type"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("text"))
    rows = labelled(spark, d).join(docs, "doc_id").select("book_id", F.concat(F.lit("b"), "doc_id").alias("block_id"), "type", "text", "status")
    return validate.missing_blocks(rows, rows.where("status = 'completed'"))


@query("SELECT conv_id AS book_id, role AS block_id, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def l2_duplicate_ids(spark, d):
    return validate.duplicate_ids(table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("role").alias("block_id")))


@query("""SELECT conv_id AS book_id, 'b' || turn AS block_id, CASE WHEN turn % 3 > 0 THEN 'i' || turn END AS image_ref FROM conversations
WHERE role = 'user' AND NOT (turn % 3 > 0 AND turn < 4)""")
def l2_image_refs(spark, d):
    ref = F.when(F.col("turn") % 3 > 0, F.concat(F.lit("i"), "turn"))
    rows = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("book_id"), F.concat(F.lit("b"), "turn").alias("block_id"), ref.alias("image_ref"), F.lit("image").alias("type"), "turn")
    assets = rows.where("turn < 4 and image_ref is not null").select("book_id", F.col("image_ref").alias("asset_key")).distinct()
    return validate.unmapped_images(rows, assets)


REPLY_CASES = 8


@query(f"""WITH t AS (SELECT conv_id, turn, 't' || turn AS id, trim(coalesce(text, ''), {WS}) = '' AS blank, conv_id % {REPLY_CASES} AS k,
  row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
found AS (
  SELECT DISTINCT conv_id, -3 AS place, 'not_object' AS code, NULL AS detail FROM t WHERE k = 6
  UNION ALL SELECT DISTINCT conv_id, -2, 'unexpected_fields', 'more' FROM t WHERE k = 4
  UNION ALL SELECT DISTINCT conv_id, -1, 'no_translations', NULL FROM t WHERE k = 7
  UNION ALL SELECT conv_id, place, 'unexpected_item_fields', 'note' FROM t WHERE k = 4
  UNION ALL SELECT conv_id, place, 'empty_text', id FROM t WHERE k NOT IN (1, 6, 7) AND (blank OR (k = 3 AND place = 0))
  UNION ALL SELECT conv_id, place - 1, 'empty_text', id FROM t WHERE k = 1 AND place > 0 AND blank
  UNION ALL SELECT conv_id, n, 'duplicate_id', id FROM t WHERE k = 5 AND place = 0
  UNION ALL SELECT conv_id, {1 << 30}, 'missing_ids', string_agg(id, ',' ORDER BY id) FROM t
    WHERE k NOT IN (6, 7) AND (blank OR (k = 1 AND place = 0) OR (k = 3 AND place = 0)) GROUP BY conv_id
  UNION ALL SELECT DISTINCT conv_id, {(1 << 30) + 1}, 'unknown_ids', 'zz' FROM t WHERE k = 2)
SELECT conv_id::VARCHAR AS entity, place::INT AS place, 'error' AS severity, code, detail FROM found""")
def l1_validate(spark, d):
    """Replies made of conversations: whole ones, and such as lack, repeat, blank or add something, or are no reply."""
    k = F.col("k")
    said = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "text"))).alias("b")).withColumn("k", F.col("conv_id") % REPLY_CASES)
    item = lambda x, i: F.struct(x["id"].alias("id"), F.when((k == 3) & (i == 0), F.lit(" ")).otherwise(x["text"]).alias("text"), F.when(k == 4, F.lit(1)).alias("note"))
    each = F.transform("b", item)
    more = F.struct(F.lit("zz").alias("id"), F.lit("Z").alias("text"), F.lit(None).cast("int").alias("note"))
    each = F.when(k == 1, F.slice(each, 2, F.size("b") - 1)).when(k == 2, F.concat(each, F.array(more))).when(k == 5, F.concat(each, F.slice(each, 1, 1))).otherwise(each)
    whole = F.to_json(F.struct(each.alias("translations"), F.when(k == 4, F.lit(2)).alias("more")))
    payload = F.when(k == 6, F.lit("[1]")).when(k == 7, F.lit('{"translations":{"id":"a"}}')).otherwise(whole)
    return validate.reply_findings(rows.select(F.col("conv_id").alias("reply_id"), payload.alias("payload"), F.transform("b", lambda x: x["id"]).alias("source_ids")))


@query(f"""WITH {CONV_SQL}, w AS (
  SELECT book_id::VARCHAR AS entity, 1 AS place, chapter_id AS detail, 'blank_title' AS code FROM chapters WHERE book_id % 3 = 0
  UNION ALL SELECT book_id::VARCHAR, 3, block_id, 'image_not_mapped' FROM blocks WHERE type <> 'paragraph'),
nth AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY place, detail, code)::INT AS nth, count(*) OVER (PARTITION BY entity) AS n FROM w)
SELECT entity, place::INT AS place, code, detail, nth, n FROM nth WHERE nth <= 3""")
def l2_first_warnings(spark, d):
    """The first three warnings of each book: chapters without a title in every third, images that no book has."""
    rows = conv_blocks(spark, d).withColumn("type", F.when(F.col("type") == "paragraph", "paragraph").otherwise("image"))
    heads = conv_chapters(rows).withColumn("title", F.when(F.col("book_id") % 3 > 0, F.col("title")))
    none = rows.limit(0).select("book_id", F.col("block_id").alias("asset_key"))
    found = validate.book_findings(rows.select("book_id").distinct(), heads, rows, none)
    return validate.first_of(found).select("entity", "place", "code", "detail", "nth", "n")


# ---- prompts and languages --------------------------------------------------------------------


@query("""SELECT doc_id, 'From ' || coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END, '')
  || ' to Japanese (ja): ' || text AS prompt FROM documents""")
def prompt_render(spark, d):
    rows = lang.normalized(table(spark, d, "documents").select("doc_id", "lang", "text"), "lang")
    target = F.struct(F.lit("ja").alias("code"), F.lit("Japanese").alias("name_en"))
    template = F.lit("From {{source_language_name}} to {{target_language_name}} ({{target_language}}): {{text}}")
    return rows.select("doc_id", render.prompt(template, F.struct("code", "name_en"), target, F.col("text")).alias("prompt"))


@query("""SELECT conv_id, count(CASE WHEN turn >= 1 AND turn % 5 > 0 THEN 1 END) AS n_context, count(CASE WHEN turn >= 1 AND turn % 5 > 0 AND turn % 2 = 0 THEN 1 END) AS n_translated,
  count(*) AS n_blocks, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(CASE WHEN role = 'user' THEN 1 END) AS n_entries FROM conversations GROUP BY conv_id""")
def user_payload(spark, d):
    """What the payload's JSON holds, read back: texts are the turns', a glossary has an entry for each of the user's."""
    block = F.struct(F.when(F.col("turn") % 5 > 0, F.concat(F.lit("t"), "turn")).otherwise("").alias("id"), F.col("text").alias("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.collect_list(block).alias("blocks"), F.collect_list(F.when(F.col("turn") >= 1, block)).alias("carry_over"),
        F.map_from_entries(F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct(F.concat(F.lit("t"), "turn").alias("k"), F.lit("done").alias("v"))))).alias("carry_translated"),
        F.collect_list(F.when(F.col("role") == "user", F.struct(F.substring("text", 1, 8).alias("source"), F.lit("x").alias("target"), F.lit("terminology").alias("type")))).alias("glossary"),
    )
    rows = rows.select("*", F.lit("en").alias("source_lang"), F.lit("ja").alias("target_lang"), F.lit("fiction").alias("style"))
    back = F.from_json("payload", "carry_over array<struct<id:string,source:string,translated:string>>, to_translate array<struct<id:string,text:string>>, glossary array<struct<source:string>>")
    rows = render.payload(rows).select("conv_id", back.alias("p"))
    done = F.filter("p.carry_over", lambda x: x["translated"].isNotNull())
    chars = F.aggregate("p.to_translate", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.length(x["text"]), F.lit(0)))
    sizes = ((F.col("p.carry_over"), "n_context"), (done, "n_translated"), (F.col("p.to_translate"), "n_blocks"), (F.col("p.glossary"), "n_entries"))
    return rows.select("conv_id", chars.alias("n_chars"), *(F.size(c).cast("long").alias(n) for c, n in sizes))


GIVEN = ["ja", "zh-Hant", "ZH-hant", " en ", "zh-TW", "zh-HK", "zh-CN", "zh-Hans", "auto", "", None, "Yue", "xx"]
GIVEN_SQL = f"""g AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN ' ' || lang || chr(9) WHEN 1 THEN upper(lang) WHEN 2 THEN lang || '-XX'
  ELSE ({GIVEN})[(doc_id % {len(GIVEN)} + 1)::INT] END AS given FROM documents)""".replace("None", "NULL")
REGISTRY_SQL = values_sql(list(lang.LANGUAGES), "code, name_en")[: -len(" AS v(code, name_en)")] + " AS l(code, name_en)"


@query(f"""WITH {GIVEN_SQL} SELECT g.id, l.code, l.name_en FROM g LEFT JOIN {REGISTRY_SQL} ON lower(trim(g.given, {WS})) = lower(l.code)""")
def language_normalize(spark, d):
    """Documents' languages as people write them, and other codes."""
    k = F.col("doc_id") % 4
    other = F.element_at(F.array(*(F.lit(x) for x in GIVEN)), (F.col("doc_id") % len(GIVEN) + 1).cast("int"))
    given = F.when(k == 0, F.concat(F.lit(" "), "lang", F.lit("\t"))).when(k == 1, F.upper("lang")).when(k == 2, F.concat("lang", F.lit("-XX"))).otherwise(other)
    return lang.normalized(table(spark, d, "documents").select(F.col("doc_id").alias("id"), given.alias("given")), "given").select("id", "code", "name_en")


@query(f"SELECT code, name_en, count(d.lang) AS n_documents FROM {REGISTRY_SQL} LEFT JOIN documents d ON d.lang = l.code GROUP BY code, name_en")
def language_registry(spark, d):
    """The registry, and how many documents are in each language."""
    rows = lang.languages(spark).join(table(spark, d, "documents").select(F.col("lang").alias("code"), "lang"), "code", "left")
    return rows.groupBy("code", "name_en").agg(F.count("lang").alias("n_documents"))


# ---- packages ---------------------------------------------------------------------------------

# Documents are items of books of twenty: doc_id // 20 is the book, doc_id % 20 the place in its manifest. Every
# seventh is an image, every eleventh the cover, every eighth book has a spine that names nothing.
ITEM_SQL = """m AS (SELECT doc_id // 20 AS book_id, (doc_id % 20)::INT AS item_pos, CASE WHEN doc_id % 11 = 0 THEN 'cover' ELSE 'i' || doc_id END AS item_id,
  'Text/P' || doc_id || '.xhtml' AS name, CASE WHEN doc_id % 7 = 0 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type, doc_id, text FROM documents)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("i"), "doc_id")
    return table(spark, d, "documents").select(
        F.expr("doc_id div 20").alias("book_id"), F.expr("cast(doc_id % 20 as int)").alias("item_pos"), F.when(F.col("doc_id") % 11 == 0, "cover").otherwise(own).alias("item_id"),
        F.concat(F.lit("Text/P"), "doc_id", F.lit(".xhtml")).alias("name"), F.when(F.col("doc_id") % 7 == 0, "image/png").otherwise("application/xhtml+xml").alias("media_type"), "doc_id", "text",
    )


@query(f"""WITH {ITEM_SQL}, s AS (SELECT book_id, 19 - item_pos AS pos, CASE WHEN book_id % 8 = 0 THEN 'nothing' WHEN doc_id % 4 = 0 THEN item_id WHEN doc_id % 4 = 1 THEN name
    WHEN doc_id % 4 = 2 THEN 'P' || doc_id || '.xhtml' ELSE 'lost' || doc_id END AS idref FROM m),
k AS (SELECT *, 0 AS prio, item_id AS idref FROM m UNION ALL SELECT *, 1, name FROM m UNION ALL SELECT *, 2, 'P' || doc_id || '.xhtml' FROM m),
met AS (SELECT s.book_id, s.pos, k.item_id, k.name, k.media_type FROM s JOIN k USING (book_id, idref) QUALIFY row_number() OVER (PARTITION BY s.book_id, s.pos ORDER BY prio, item_pos) = 1),
found AS (SELECT book_id, pos, item_id, name FROM met WHERE media_type <> 'image/png' AND item_id <> 'cover')
SELECT book_id, pos::INT AS pos, item_id, name FROM found
UNION ALL SELECT book_id, item_pos, item_id, name FROM m WHERE media_type <> 'image/png' AND item_id <> 'cover' AND book_id NOT IN (SELECT book_id FROM found)""")
def spine_documents(spark, d):
    """Spines in the manifest's opposite order, by id, name or base name; one that gives none falls back to the manifest."""
    rows = items(spark, d)
    k = F.col("doc_id") % 4
    idref = F.when(F.col("book_id") % 8 == 0, "nothing").when(k == 0, F.col("item_id")).when(k == 1, F.col("name")).when(k == 2, F.concat(F.lit("P"), "doc_id", F.lit(".xhtml"))).otherwise(F.concat(F.lit("lost"), "doc_id"))
    spine = rows.select("book_id", (F.lit(19) - F.col("item_pos")).alias("pos"), idref.alias("idref"))
    return packages.spine_documents(spine, rows.drop("doc_id", "text"))


# A package's contents: its own, then an older form's. Every fifth title is a resource's name, every ninth too long.
TOC_SQL = f"""{ITEM_SQL},
toc AS (SELECT book_id, 0 AS source, item_pos AS pos, CASE WHEN doc_id % 2 = 0 THEN '../' || name || '#top' ELSE upper('P' || doc_id || '.xhtml') END AS href,
    CASE WHEN doc_id % 5 = 0 THEN 'chap_0' || doc_id WHEN doc_id % 9 = 0 THEN repeat('x', 81) ELSE ' ' || substr(text, 1, 20) || ' ' END AS title FROM m WHERE doc_id % 3 > 0
  UNION ALL SELECT book_id, 1, item_pos, name, 'Old ' || doc_id FROM m WHERE doc_id % 4 > 0),
cut AS (SELECT *, lower(regexp_extract(regexp_replace(string_split(href, '#')[1], '/+$', ''), '([^/]*)$', 1)) AS h, trim(title, {WS}) AS own FROM toc),
named AS (SELECT *, regexp_extract(regexp_replace(own, '/+$', ''), '([^/]*)$', 1) AS base FROM cut),
tocs AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem FROM named),
titles AS (SELECT book_id, h AS href, own AS title FROM tocs WHERE h <> '' AND length(own) <= 80 AND NOT (stem = '' OR regexp_matches(stem, '{TECH_RE}'))
  QUALIFY row_number() OVER (PARTITION BY book_id, h ORDER BY source, pos) = 1)"""


def contents(spark: SparkSession, d: str) -> DataFrame:
    rows, k = items(spark, d), F.col("doc_id")
    href = F.when(k % 2 == 0, F.concat(F.lit("../"), "name", F.lit("#top"))).otherwise(F.upper(F.concat(F.lit("P"), "doc_id", F.lit(".xhtml"))))
    title = F.when(k % 5 == 0, F.concat(F.lit("chap_0"), "doc_id")).when(k % 9 == 0, F.repeat(F.lit("x"), 81)).otherwise(F.concat(F.lit(" "), F.substring("text", 1, 20), F.lit(" ")))
    own = rows.where("doc_id % 3 > 0").select("book_id", F.lit(0).alias("source"), F.col("item_pos").alias("pos"), href.alias("href"), title.alias("title"))
    old = rows.where("doc_id % 4 > 0").select("book_id", F.lit(1).alias("source"), F.col("item_pos").alias("pos"), F.col("name").alias("href"), F.concat(F.lit("Old "), "doc_id").alias("title"))
    return own.unionByName(old)


@query(f"WITH {TOC_SQL} SELECT book_id, href, title FROM titles")
def toc_lookup(spark, d):
    return packages.toc_titles(contents(spark, d))


LABEL_SQL = f"""l AS (SELECT doc_id // 20 AS book_id, doc_id % 20 AS pos, trim(substr(text, 1, 6 + doc_id % 7), {WS}) AS label FROM documents WHERE doc_id % 3 = 0),
b AS (SELECT doc_id // 20 AS book_id, doc_id % 20 AS idx, trim(substr(text, 1, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 + doc_id % 7 END), {WS}) AS t FROM documents)"""


@query(f"""WITH {LABEL_SQL} SELECT b.book_id, idx, coalesce(min_by(CASE WHEN t = label THEN label END, CASE WHEN t = label THEN pos END),
  min_by(CASE WHEN least(length(t), length(label)) >= 2 AND (starts_with(t, label) OR starts_with(label, t)) THEN label END,
         CASE WHEN least(length(t), length(label)) >= 2 AND (starts_with(t, label) OR starts_with(label, t)) THEN pos END)) AS label
FROM b LEFT JOIN l USING (book_id) GROUP BY b.book_id, idx""")
def toc_label_match(spark, d):
    """How documents begin, as labels and as blocks of books of twenty: some blocks are shorter than their label, some the same."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 20").alias("book_id"), F.expr("doc_id % 20").alias("idx"), "doc_id", "text")
    size = (F.lit(6) + F.col("doc_id") % 7).cast("int")
    labels = docs.where("doc_id % 3 = 0").select("book_id", F.col("idx").alias("pos"), tx.strip(F.substring("text", F.lit(1), size)).alias("label"))
    shown = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 3).otherwise(size)
    blocks = docs.select("book_id", "idx", F.substring("text", F.lit(1), shown).alias("text"))
    return books.matched_label(blocks, labels).select("book_id", "idx", "label")


@query("""WITH a AS (SELECT page_id, unnest(range(3)) AS pos, 'images/p' || (page_id + unnest(range(3))) || '.png' AS path FROM pages)
SELECT page_id, min_by(path, pos) AS path FROM a WHERE contains(path, 'p' || (page_id + 1) || '.png') GROUP BY page_id""")
def image_ref_resolve(spark, d):
    page = table(spark, d, "pages").select("page_id")
    assets = page.select("page_id", F.posexplode(F.expr("transform(sequence(0, 2), i -> concat('images/p', page_id + i, '.png'))")).alias("pos", "path"))
    refs = page.select("page_id", F.expr("concat('../x/p', page_id + 1, '.png')").alias("src"))
    return packages.image_assets(refs, assets, "page_id").select("page_id", "path")


SUFFIXES = [".JPG", ".jpeg", ".png", ".svg", "", ".b/noext", ".webp", ".gif", ".bin", "."]


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) || '/img' || page_id || ({SUFFIXES})[(page_id % {len(SUFFIXES)} + 1)::INT] AS path FROM pages)
SELECT page_id, path, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif'
  WHEN 'webp' THEN 'image/webp' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS media_type FROM p""")
def media_types(spark, d):
    """Images below the pages' hosts, whose names hold dots too."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in SUFFIXES)), (F.col("page_id") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit("/img"), "page_id", suffix)
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("media_type", render.media_type(F.col("path")))


SIZE_SQL = """s AS (SELECT l_orderkey, l_linenumber, (l_partkey % 2500 + 1)::INT AS w, (l_suppkey * 37 % 4000 + 1)::INT AS h FROM lineitem
  UNION ALL SELECT 0, range::INT, (1590 + range)::INT, 900 FROM range(20)),
scaled AS (SELECT *, CASE WHEN greatest(w, h) > 1600 THEN 1600.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS k FROM s)"""


@query(f"WITH {SIZE_SQL} SELECT l_orderkey, l_linenumber, w, h, greatest(1, floor(w * k))::INT AS new_w, greatest(1, floor(h * k))::INT AS new_h FROM scaled")
def image_sizes(spark, d):
    """Sizes made of line items, and those around the limit."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_partkey % 2500 + 1 as int)").alias("w"), F.expr("cast(l_suppkey * 37 % 4000 + 1 as int)").alias("h"))
    near = spark.range(20).select(F.lit(0).cast("long").alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), F.expr("cast(1590 + id as int)").alias("w"), F.lit(900).alias("h"))
    return packages.shrunk(rows.withColumn("l_linenumber", F.col("l_linenumber").cast("int")).unionByName(near.withColumn("l_orderkey", F.col("l_orderkey"))))


@query("""SELECT user_id, count(*) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY user_id""")
def stream_progress(spark, d):
    """The progress of a stream of calls, drained once."""
    from quirelight.streaming.progress import drained_progress

    return drained_progress(spark, d)


@query(f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS n_open, min_by(event_id, (ts, event_id)) AS event_id FROM s WHERE streak = 3 GROUP BY user_id")
def stream_breaker(spark, d):
    """How often each user's breaker opens, and where first, by the events' time: they come in several files, some late."""
    from quirelight.streaming.progress import drained_breaker

    return drained_breaker(spark, d)


@query(f"""SELECT conv_id AS book_id, count(*) AS n_blocks, count(*) AS n_translated, 0::BIGINT AS n_twice FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, ''), {WS}) <> '' GROUP BY conv_id""")
def stream_translation(spark, d):
    """Chunks as a stream that is killed and taken up again: each block is translated once."""
    from quirelight.streaming.translation import drained_translation

    return drained_translation(spark, d)


# Pages as their generator writes them: a body of a navigation list, a comment, an advertisement, an article and a
# footer; inside the article h1, p, b and br. Tags that end a text become chr(1), others chr(2).
UNESCAPED = "replace(replace(replace(replace({x}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
PAGE_SQL = f"""bodies AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)^.*?</nav>|<!--.*?-->|<footer>.*$', '', 'g'), '(?s)<(script|style)\\b.*?</(script|style)>', '', 'g') AS h FROM pages),
cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '<h1[^>]*>', chr(1) || 'H', 'g'), '</?(div|article|p|h1|br|body|html)\\b[^>]*>', chr(1), 'g'), chr(1)) AS parts FROM bodies),
parts AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS n FROM cut),
pieces AS (SELECT page_id, n, starts_with(part, 'H') AND n > 0 AS head, string_split(regexp_replace(CASE WHEN starts_with(part, 'H') AND n > 0 THEN substr(part, 2) ELSE part END, '<[^>]*>', chr(2), 'g'), chr(2)) AS p FROM parts),
marked AS (SELECT * REPLACE (list_filter(list_transform(p, lambda x: trim({UNESCAPED.format(x='x')}, {WS})), lambda x: x <> '') AS p) FROM pieces),
blocks AS (SELECT page_id, n, head, array_to_string(p, ' ') AS text FROM marked WHERE len(p) > 0)"""


@query(f"""WITH {PAGE_SQL.replace("starts_with(part, 'H') AND n > 0", "starts_with(part, chr(3))").replace("chr(1) || 'H'", "chr(1) || chr(3)")}
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS ord, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN head THEN 1 END::INT AS level, text,
  NULL::VARCHAR AS image_ref, NULL::VARCHAR AS image_alt FROM blocks""")
def html_blocks(spark, d):
    from quirelight.sources.html import html_blocks as walk

    return walk(table(spark, d, "pages").select("page_id", "html"), "page_id")


HEADING_SQL = f"""raw AS (
  SELECT page_id, 'h1' AS tag, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS t FROM pages
  UNION ALL SELECT page_id, 'h2', regexp_extract_all(html, '(?s)<h2[^>]*>(.*?)</h2>', 1) FROM pages
  UNION ALL SELECT page_id, 'h3', regexp_extract_all(html, '(?s)<h3[^>]*>(.*?)</h3>', 1) FROM pages
  UNION ALL SELECT page_id, 'title', regexp_extract_all(html, '(?s)<title[^>]*>(.*?)</title>', 1) FROM pages),
each AS (SELECT page_id, tag, unnest(t) AS inside, unnest(range(len(t))) AS nth FROM raw),
headings AS (SELECT page_id, tag, nth::INT AS nth, array_to_string(list_filter(list_transform(string_split(regexp_replace(inside, '<[^>]*>', chr(1), 'g'), chr(1)),
  lambda x: trim({UNESCAPED.format(x='x')}, {WS})), lambda x: x <> ''), ' ') AS text FROM each)"""


@query(f"WITH {HEADING_SQL} SELECT page_id, tag, nth, text FROM headings")
def page_headings(spark, d):
    """Headings and titles, by a table function that is joined laterally."""
    from quirelight.sources import html

    return html.page_headings(table(spark, d, "pages").select("page_id", "html"), "page_id")


@query(f"""WITH {HEADING_SQL},
firsts AS (SELECT page_id, tag, trim(text, {WS}) AS own FROM headings WHERE nth = 0 AND NOT (tag = 'h1' AND page_id % 2 = 0)),
named AS (SELECT page_id, 'stem' AS tag, trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#].*$', ''), {WS}) AS own FROM pages),
everything AS (SELECT *, regexp_extract(regexp_replace(own, '/+$', ''), '([^/]*)$', 1) AS base FROM (SELECT * FROM firsts WHERE page_id % 3 > 0 UNION ALL SELECT * FROM named)),
stemmed AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem FROM everything),
good AS (SELECT page_id, CASE tag WHEN 'h1' THEN 0 WHEN 'h2' THEN 1 WHEN 'h3' THEN 2 WHEN 'title' THEN 3 ELSE 4 END AS rung, substr(CASE tag WHEN 'stem' THEN stem ELSE own END, 1, 200) AS title
  FROM stemmed WHERE own <> '' AND NOT (stem = '' OR regexp_matches(stem, '{TECH_RE}')))
SELECT p.page_id, min_by(g.title, g.rung) AS title FROM pages p LEFT JOIN good g USING (page_id) GROUP BY p.page_id""")
def page_titles(spark, d):
    """The ladder of h1, h2, h3, title and the file's stem; even pages have lost their h1, every third all headings."""
    from quirelight.sources import html

    pages = table(spark, d, "pages")
    found = html.page_headings(pages.select("page_id", "html"), "page_id").where("page_id % 3 > 0 and not (tag = 'h1' and page_id % 2 = 0)")
    return html.guessed_titles(found, pages.select("page_id", "url"), "page_id", F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[?#].*$", ""))


# Conversations as packages: a chapter of every three turns; the user's turns are headings of level 2, system turns
# images without a file. Read back, headings begin chapters.
READ_SQL = f"""{CONV_SQL},
shown AS (SELECT book_id, c.ord AS c, -1 AS n, 'heading' AS type, 1 AS level, c.title AS own FROM chapters c
  UNION ALL SELECT b.book_id, c.ord, b.ord, b.type, 2, trim(b.text, {WS}) FROM blocks b JOIN chapters c USING (book_id, chapter_id) WHERE b.type <> 'image' AND trim(coalesce(b.text, ''), {WS}) <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY c, n) - 1 AS idx, regexp_extract(regexp_replace(own, '/+$', ''), '([^/]*)$', 1) AS base FROM shown),
stemmed AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem, regexp_extract(own, '(?i)^(?:{tx.TITLE_START})') AS start FROM placed),
judged AS (SELECT *, length(own) <= 80 AND start <> '' AND (length(own) = length(start) OR contains('{tx.TITLE_NEXT}', substr(own, length(start) + 1, 1))) AS likely,
  stem = '' OR regexp_matches(stem, '{TECH_RE}') AS technical FROM stemmed),
labels AS (SELECT book_id, title AS label, ord FROM chapters),
named AS (SELECT j.book_id, j.idx, min_by(l.label, l.ord) AS label FROM judged j JOIN labels l ON j.book_id = l.book_id AND length(j.own) >= 2 AND (starts_with(j.own, l.label) OR starts_with(l.label, j.own)) GROUP BY j.book_id, j.idx),
titled AS (SELECT j.*, coalesce(CASE WHEN technical THEN NULL WHEN type = 'heading' AND (level = 1 OR likely OR length(own) <= 40) THEN substr(own, 1, 200)
  WHEN type = 'paragraph' AND likely THEN substr(own, 1, 200) END, m.label) AS title FROM judged j LEFT JOIN named m USING (book_id, idx)),
run1 AS (SELECT *, coalesce(lag(title) OVER w = title, FALSE) AS goes FROM titled WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
run2 AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY idx) AS run FROM run1),
run3 AS (SELECT *, title IS NOT NULL AND row_number() OVER (PARTITION BY book_id, run ORDER BY idx) % 2 = 1 AS begins FROM run2),
numbered AS (SELECT *, greatest(1, sum(begins::INT) OVER (PARTITION BY book_id ORDER BY idx))::INT AS chapter FROM run3)"""


@query(f"""WITH {READ_SQL} SELECT book_id::VARCHAR AS book_id, chapter, (row_number() OVER (PARTITION BY book_id, chapter ORDER BY idx) - 1)::INT AS ord, type, own AS text,
  max(CASE WHEN begins THEN title END) OVER (PARTITION BY book_id, chapter) AS chapter_title FROM numbered""")
def epub_round_trip(spark, d):
    """Conversations written as EPUB files by the package sink, read again by the package source: their blocks."""
    folder = f"{store.root(spark)}/quirelight/packages-{uuid.uuid4().hex}"
    epub.save_files(conv_packages(spark, d), folder)
    parts = epub_io.read_packages(spark, folder, ["book_id", *epub.PARTS])
    _, read = epub.books_of(store.saved(parts.withColumn("book_id", tx.stem(F.col("book_id"))), "package-parts"))
    return read.select("book_id", "chapter", "ord", "type", "text", "chapter_title")


def conv_packages(spark: SparkSession, d: str) -> DataFrame:
    rows = conv_blocks(spark, d).withColumn("src", F.lit(None).cast("string"))
    heads = conv_chapters(rows)
    html = render.chapter_html(heads, rows).join(heads.drop("ord"), ["book_id", "chapter_id"])
    about = heads.select("book_id").distinct().select("book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.lit("Unknown").alias("author"), F.lit("en").alias("language"))
    pictures = conv_images(spark, d)
    return epub.write_epubs(about, html, pictures)


def conv_images(spark: SparkSession, d: str) -> DataFrame:
    """Every third turn's text as an image's bytes; the first one of a conversation is its cover."""
    rows = table(spark, d, "conversations").where("turn % 3 = 0 and text <> ''")
    kind = F.element_at(F.array(F.lit("png"), F.lit("jpg"), F.lit("svg")), (F.col("turn") % 9 / 3 + 1).cast("int"))
    return rows.select(F.col("conv_id").alias("book_id"), F.concat(F.lit("img/t "), "turn", F.lit("."), kind).alias("asset_key"), F.col("text").cast("binary").alias("content"), (F.col("turn") == 0).alias("cover"))


@query("""SELECT conv_id::VARCHAR AS book_id, 'Book ' || conv_id AS title, 'Unknown' AS author, 'en' AS language, 'urn:book:' || conv_id AS identifier, count(DISTINCT turn // 3)::INT AS n_spine,
  (count(DISTINCT turn // 3) + count(CASE WHEN turn % 3 = 0 AND text <> '' THEN 1 END) + 2)::INT AS n_items FROM conversations GROUP BY conv_id""")
def package_metadata(spark, d):
    """What packages say of themselves: no page and no image is unpacked for it."""
    folder = f"{store.root(spark)}/quirelight/packages-{uuid.uuid4().hex}"
    epub.save_files(conv_packages(spark, d), folder)
    rows = epub_io.read_packages(spark, folder, ["book_id", "title", "author", "language", "identifier", "spine", "manifest"])
    return rows.select(tx.stem(F.col("book_id")).alias("book_id"), "title", "author", "language", "identifier", F.size("spine").alias("n_spine"), F.size("manifest").alias("n_items"))


@query("""SELECT conv_id AS book_id, count(*) AS n_blocks, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_translated FROM conversations GROUP BY conv_id""")
def translate_books(spark, d):
    """Chunks of assistant turns through the translator, chapter by chapter, and laid over the books."""
    from quirelight.operators.translate import translated_books

    return translated_books(spark, d)


# ---- a run that is taken up again, and images ----------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 3 <> 0 AS done FROM conversations),
b AS (SELECT *, lag(turn) OVER w AS p, lag(text) OVER w AS t, lag(done) OVER w AS d FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn::INT AS chunk, coalesce(p::VARCHAR, '') AS ids, coalesce(t, '') AS source, CASE WHEN d THEN 'T ' || t ELSE '' END AS translated FROM b""")
def resume_carry_over(spark, d):
    """The context of every chunk, whether the run before it has translated its predecessor or not."""
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.lit("c").alias("chapter_id"), F.col("turn").cast("int").alias("chunk"), F.coalesce("text", F.lit("")).alias("t"))
    one = F.struct(F.col("chunk").cast("string").alias("id"), F.col("t").alias("text"))
    rows = said.select("book_id", "chapter_id", "chunk", F.array(one).alias("blocks"))
    done = said.where("chunk % 3 <> 0").select("book_id", "chapter_id", "chunk", F.lit("completed").alias("status"), F.create_map(F.col("chunk").cast("string"), F.concat(F.lit("T "), "t")).alias("translations"))
    out = translate.with_context(rows, done, 2)
    part = lambda c: F.array_join(F.transform("carry_over", lambda x: F.coalesce(x[c], F.lit(""))), ",")
    return out.select(F.col("book_id").alias("conv_id"), "chunk", part("id").alias("ids"), part("source").alias("source"), part("translated").alias("translated"))


@query("""SELECT conv_id AS book_id, 'img/t ' || turn || CASE turn % 9 WHEN 0 THEN '.png' WHEN 3 THEN '.jpg' ELSE '.svg' END AS asset_key,
  CASE turn % 9 WHEN 0 THEN 'image/png' WHEN 3 THEN 'image/jpeg' ELSE 'image/svg+xml' END AS media_type, octet_length(encode(text))::INT AS size, md5(text) AS md5, turn = 0 AS cover
FROM conversations WHERE turn % 3 = 0 AND text <> ''""")
def epub_images(spark, d):
    """Images of packages, written and read back: texts of conversations as their bytes."""
    read = epub.read_images(conv_packages(spark, d))
    return read.select("book_id", "asset_key", "media_type", F.length("content").alias("size"), F.md5("content").alias("md5"), "cover")


# Documents are spine items of books of twenty (as above), their first lines blocks; the contents name some. Books of an
# even number have a heading before every seventh document, so their contents' titles don't count.
SOFT_SQL = f"""{TOC_SQL},
parts AS (SELECT book_id, item_pos, name, item_id, doc_id, text FROM m),
lines AS (SELECT book_id, item_pos, 1 AS k, 'paragraph' AS type, trim(string_split(text, chr(10))[1], {WS}) AS t FROM parts
  UNION ALL SELECT book_id, item_pos, 2, 'paragraph', trim(string_split(text, chr(10))[2], {WS}) FROM parts
  UNION ALL SELECT book_id, item_pos, 0, 'heading', 'Heading of ' || doc_id FROM parts WHERE book_id % 2 = 0 AND doc_id % 7 = 0),
flat AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY item_pos, k) - 1)::INT AS idx FROM lines WHERE coalesce(t, '') <> ''),
based2 AS (SELECT *, regexp_extract(regexp_replace(t, '/+$', ''), '([^/]*)$', 1) AS base FROM flat),
stemmed2 AS (SELECT *, trim({STEM_SQL}, {WS}) AS stem, regexp_extract(t, '(?i)^(?:{tx.TITLE_START})') AS start FROM based2),
strong AS (SELECT *, CASE WHEN stem = '' OR regexp_matches(stem, '{TECH_RE}') THEN NULL WHEN type = 'heading' THEN substr(t, 1, 200)
  WHEN length(t) <= 80 AND start <> '' AND (length(t) = length(start) OR contains('{tx.TITLE_NEXT}', substr(t, length(start) + 1, 1))) THEN t END AS title FROM stemmed2),
by_key AS (SELECT p.book_id, p.item_pos, min_by(x.title, CASE WHEN x.href = lower('P' || p.doc_id || '.xhtml') THEN 0 ELSE 1 END) AS soft
  FROM parts p JOIN titles x ON x.book_id = p.book_id AND x.href IN (lower('P' || p.doc_id || '.xhtml'), lower(p.item_id)) GROUP BY p.book_id, p.item_pos),
heads AS (SELECT book_id, item_pos, min(idx) AS idx FROM flat GROUP BY book_id, item_pos),
soft AS (SELECT h.book_id, h.idx, b.soft FROM heads h JOIN by_key b USING (book_id, item_pos)),
both_tiers AS (SELECT s.book_id, s.idx, CASE WHEN count(s.title) OVER (PARTITION BY s.book_id) > 0 THEN s.title ELSE f.soft END AS title FROM strong s LEFT JOIN soft f USING (book_id, idx)),
run1 AS (SELECT *, coalesce(lag(title) OVER w = title, FALSE) AS goes FROM both_tiers WINDOW w AS (PARTITION BY book_id ORDER BY idx)),
run2 AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY idx) AS run FROM run1),
run3 AS (SELECT *, title IS NOT NULL AND row_number() OVER (PARTITION BY book_id, run ORDER BY idx) % 2 = 1 AS begins FROM run2),
numbered AS (SELECT *, greatest(1, sum(begins::INT) OVER (PARTITION BY book_id ORDER BY idx))::INT AS chapter FROM run3)"""


@query(f"""WITH {SOFT_SQL} SELECT book_id, chapter, coalesce(max(CASE WHEN begins THEN title END), 'Untitled') AS title, min(idx) AS first_idx, count(*) AS n_blocks FROM numbered GROUP BY book_id, chapter""")
def soft_boundaries(spark, d):
    """Chapters of books whose spine files carry no headings, by the contents' titles of the files."""
    rows = items(spark, d)
    line = lambda i: tx.strip(F.get(F.split("text", "\n"), F.lit(i)))
    heading = F.when((F.col("book_id") % 2 == 0) & (F.col("doc_id") % 7 == 0), F.concat(F.lit("Heading of "), "doc_id"))
    each = F.posexplode(F.array(F.struct(F.lit("heading").alias("type"), heading.alias("text")), *(F.struct(F.lit("paragraph").alias("type"), line(i).alias("text")) for i in (0, 1))))
    each = rows.select("book_id", F.col("item_pos").alias("pos"), each.alias("k", "b")).select("book_id", "pos", "k", "b.*").where("coalesce(text, '') <> ''")
    flat = each.withColumn("idx", (F.row_number().over(Window.partitionBy("book_id").orderBy("pos", "k")) - 1).cast("int")).withColumn("level", F.lit(1))
    titles = packages.document_titles(rows.select("book_id", F.col("item_pos").alias("pos"), "item_id", "name"), packages.toc_titles(contents(spark, d)))
    soft = packages.soft_boundaries(flat.select("book_id", "pos", "idx"), titles)
    out = books.detect_chapters(flat.drop("pos", "k"), soft=soft)
    return out.groupBy("book_id", "chapter").agg(F.max("chapter_title").alias("title"), F.min("idx").alias("first_idx"), F.count("*").alias("n_blocks"))
