"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.shared import WORD, ranked, ranked_in, save, table, text_of

#: Fixed point: copies are counted in 2**-24.
ONE = 1 << 24
WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: A row that has more than 1 / LONG of its source's words is long: so a source has fewer than LONG of them.
LONG = 200
#: Sources up to which their targets are sent to every task.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources: (key string, source_size long). Adds target double: share of all sizes, dealt by
    weight; weights repeat along the keys' order. What a source would get beyond cap times its
    size is dealt again by weight, until none is above. One row comes to the driver in each
    round; there are as many rounds as times that further sources reach their cap."""
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(cap)
    all_of = save(ranked(sources, ["key"], "mix-keys").withColumn("weight", weight).withColumn("full", full), "mix-sources")
    total = (all_of.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1
    while True:
        at_cap = F.col("full") <= F.col("weight") * F.lit(level)
        n, held, free = all_of.agg(
            F.count_if(at_cap), F.sum(F.when(at_cap, F.col("full"))), F.sum(F.when(~at_cap, F.col("weight")))
        ).first()
        if n == before or not free:
            break
        before, level = n, (total - (held or 0)) / free
    return all_of.select("key", "source_size", F.least("full", F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs with doc_id, source, text. Returns for each row doc_id, mark (a hash of the text),
    source, size (its words), source_size, target (its source's), copies, taken (words), and the
    columns named in keep.

    Expected copies are summed up along a source's rows, one random offset for each source is added, and a row
    is taken once for each whole number that its interval crosses. Long rows expect whole copies, so
    that what they take, longest first, follows the target's share of their words; the others, by
    size, doc_id and text, expect equal copies, which make up what is left of the target. That misses
    the target by less than the longest of those rows, a LONGth of the source; of a source of long rows
    alone, by its shortest. A null text has size 0; a null source is a source of its own, last in order; a
    source without words has target 0. Reruns give the same rows. Repeated rows are rows of their
    own; an empty table gives no rows."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))  # null last
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", key.alias("key"), size.alias("size"), *keep)
    rows = save(rows, "mix-sizes")
    goals = targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "key")), 1, 6), 16, 10).cast("long")
    goals = save(goals.withColumn("offset", offset), "mix-goals")
    # A row for each source. Beyond the bound a source's rows meet its row in a join that AQE splits.
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    small = lambda g: F.broadcast(g) if few else g
    met = rows.join(small(goals), "key")
    is_long = F.col("size") * LONG > F.col("source_size")
    long = save(_long(met.where(is_long), cap, keep), "mix-long")
    taken = F.sum(F.col("copies") * F.col("size"))
    held = long.groupBy("key").agg(F.sum("size").alias("long_size"), taken.alias("long_taken"))
    left = goals.join(held, "key", "left").na.fill(0, ["long_size", "long_taken"])
    rest = F.col("source_size") - F.col("long_size")
    ratio = F.when(rest > 0, F.least(F.lit(cap), F.greatest(F.lit(0.0), (F.col("target") - F.col("long_taken")) / rest))).otherwise(0.0)
    left = left.select("key", "offset", "source_size", "target", F.floor(ratio * ONE + 0.5).cast("long").alias("expected"))
    short = met.where(~is_long).select(*rows.columns)
    numbered = ranked_in(short, ["key"], ["size", "doc_id", "mark"], "mix-dealt").join(small(left), "key")
    upto = (F.col("rank") + 1) * F.col("expected") + F.col("offset")
    copies = F.shiftright(upto, 24) - F.shiftright(upto - F.col("expected"), 24)
    shown = ["doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep]
    return numbered.withColumn("copies", copies).select(*shown).unionByName(long.select(*shown))


def _long(met: DataFrame, cap: float, keep: tuple[str, ...]) -> DataFrame:
    """Long rows, with their whole number of copies. Along a source's, fewer than LONG, from the longest on: each
    takes what brings the words taken up to the target's share of the words so far, rounded by the
    source's offset."""
    fields = ["doc_id", "mark", "source", "size", *keep]
    each = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "doc_id", "mark", "source", "size", *keep)))
    rows = met.groupBy("key", "source_size", "target", "offset").agg(each.alias("rows"))
    ratio, up = F.col("target") / F.col("source_size"), F.col("offset") / F.lit(float(ONE))
    begin = F.struct(F.lit(0.0).alias("want"), F.lit(0.0).alias("taken"), F.array().cast("array<long>").alias("copies"))

    def step(acc: Column, x: Column) -> Column:
        want = acc["want"] + ratio * x["size"]
        wanted = F.floor((want - acc["taken"]) / x["size"] + up)
        n = F.least(F.lit(int(cap)), F.greatest(F.lit(0), wanted)).cast("long")
        return F.struct(want.alias("want"), (acc["taken"] + n * x["size"]).alias("taken"), F.concat(acc["copies"], F.array(n)).alias("copies"))

    rows = rows.withColumn("copies", F.aggregate("rows", begin, step, lambda acc: acc["copies"]))
    out = rows.select("key", "source_size", "target", F.explode(F.arrays_zip("rows", "copies")).alias("x"))
    return out.select("key", "source_size", "target", F.col("x.copies").alias("copies"), *(F.col(f"x.rows.{c}").alias(c) for c in fields))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as :func:`mix` takes it, with all their columns. Repeated rows
    have copies of their own; null texts and sources are as there; an empty table stays empty."""
    row, copies = "__ql_row", "__ql_copies"
    # Rows are numbered as they are written, so that equal ones are no common key.
    rows = save(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(rows, keep=(row,), **options).where("copies > 0").select(row, F.col("copies").alias(copies))
    out = rows.join(taken, row)
    return out.withColumn("__ql_copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: what the mix takes of each."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('s' || source, 't') AS key, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT key, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS full_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY encode(key)) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY key),
ordered AS (
  SELECT *, full_size / weight AS fills_at,
         sum(full_size) OVER w - full_size AS held, sum(weight) OVER w - weight AS spent,
         sum(weight) OVER () AS weights, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sources WINDOW w AS (ORDER BY full_size / weight, key ROWS UNBOUNDED PRECEDING)),
water AS (
  SELECT coalesce(min_by((total - held) / (weights - spent), fills_at), 0) AS level
  FROM ordered WHERE fills_at >= (total - held) / (weights - spent)),
goals AS (
  SELECT key, source_size, least(full_size, weight * level)::DOUBLE AS target,
         ('0x' || substr(md5('{SEED}' || key), 1, 6))::BIGINT AS shift
  FROM sources, water),
met AS (
  SELECT s.key, s.doc_id, s.size, g.source_size, g.target, g.shift, s.size * {LONG} > g.source_size AS long
  FROM sized s JOIN goals g USING (key)),
longs AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size DESC, doc_id) AS nth FROM met WHERE long),
walk AS (
  SELECT key, doc_id, nth, size, source_size, target, target / source_size * size AS want,
         least(2, greatest(0, floor(target / source_size * size / size + shift / {ONE}.0::DOUBLE)))::BIGINT AS copies, 0.0::DOUBLE AS before
  FROM longs WHERE nth = 1
  UNION ALL
  SELECT l.key, l.doc_id, l.nth, l.size, l.source_size, l.target, w.want + l.target / l.source_size * l.size,
         least(2, greatest(0, floor((w.want + l.target / l.source_size * l.size - (w.before + w.copies * w.size)) / l.size + l.shift / {ONE}.0::DOUBLE)))::BIGINT,
         w.before + w.copies * w.size
  FROM walk w JOIN longs l ON l.key = w.key AND l.nth = w.nth + 1),
held AS (SELECT key, sum(size)::BIGINT AS long_size, sum(copies * size)::BIGINT AS long_taken FROM walk GROUP BY key),
shares AS (
  SELECT g.key, CASE WHEN g.source_size - coalesce(h.long_size, 0) > 0
    THEN floor(least(2.0::DOUBLE, greatest(0.0::DOUBLE, (g.target - coalesce(h.long_taken, 0)) / (g.source_size - coalesce(h.long_size, 0)))) * {ONE} + 0.5)::BIGINT ELSE 0 END AS e
  FROM goals g LEFT JOIN held h USING (key)),
steps AS (
  SELECT m.*, s.e, row_number() OVER (PARTITION BY m.key ORDER BY m.size, m.doc_id) AS nth
  FROM met m JOIN shares s USING (key) WHERE NOT m.long)
SELECT doc_id, size, source_size, target, (((nth * e + shift) >> 24) - (((nth - 1) * e + shift) >> 24)) * size AS taken FROM steps
UNION ALL SELECT doc_id, size, source_size, target, copies * size FROM walk
"""
