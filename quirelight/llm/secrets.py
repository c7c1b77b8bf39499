"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.shared import save, table, text_of

#: Kind, pattern, the group that holds the secret, and its least length.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
     r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates that only their owners' number tells from examples: long runs of a key's characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What sets keys apart from addresses' paths, names and words that hyphens join: small and capital letters and
#: digits, a long stretch without any separator, and digits that follow letters more than once.
KEYLIKE = ("[a-z]", "[A-Z]", "[0-9]", "[A-Za-z0-9+]{16,}", "[A-Za-z][0-9].*[A-Za-z][0-9]")
#: A secret is its owners' own if no more sources than this hold it, and no more documents for each.
OWNERS, REPOSITORIES = 2, 20
#: Documents from which on a secret's count is sent to every task, and how many such there may be.
HOT, BROADCAST_SECRETS = 10_000, 100_000
RANK = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), "owned"])}


def _matches(pattern: str, group: int, kind: str) -> Column:
    """array<struct<start, rank, end, value>> of the leftmost non-overlapping matches, in code
    points. Each piece of the text that has no match is taken with the match behind it, which
    tells where that stands; the last piece ends in an empty match. A text without a match costs
    one pass, one with matches a pass for each part that is taken."""
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, found = F.regexp_extract_all("text", cut, F.lit(1)), F.regexp_extract_all("text", cut, F.lit(2))
    value = F.regexp_extract_all("text", cut, F.lit(2 + group)) if group else found
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string>>")
    begin = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = (start + F.length(x["found"])).cast("bigint")
        row = F.struct(
            start.cast("bigint").alias("start"), F.lit(RANK[kind]).alias("rank"), end.alias("end"), x["value"].alias("value")
        )
        out = F.when(F.length(x["found"]) > 0, F.concat(acc["out"], F.array(row))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), out.alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    spans = F.aggregate(zipped, begin, step, lambda acc: acc["out"])
    return F.when(F.col("text").rlike(pattern), spans).otherwise(none)


def _as_long(least: int):
    return lambda x: F.length(x["value"]) >= least


def _found(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, source, mark (a hash of the text), base and more: spans with the
    secret's hash in place of the secret."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), text_of().alias("text"))
    kept = [F.filter(_matches(p, g, kind), _as_long(n)) for kind, p, g, n in BASE]
    rows = rows.withColumn("base", F.array_sort(F.concat(*kept)))
    telling = lambda x: reduce(and_, (x["value"].rlike(p) for p in KEYLIKE))
    rows = rows.withColumn("more", F.filter(_matches(CANDIDATE, 0, "owned"), telling))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn("more", F.when(F.size("more") > 0, F.filter("more", free)).otherwise(F.col("more")))
    hashed = lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("hash")
    )
    spans = [F.transform(c, hashed).alias(c) for c in ("base", "more")]
    return rows.select("doc_id", "source", "mark", *spans)


def owners(found: DataFrame) -> DataFrame:
    """hash, repositories (documents that have it) and owners (sources that do), over all rows.
    Counts are summed by source first, so a widely copied secret is no hot key."""
    each = found.select("doc_id", "source", F.explode(F.concat("base", "more")).alias("s"))
    each = each.select(F.col("s.hash").alias("hash"), "source", "doc_id").distinct()
    by_owner = each.groupBy("hash", "source").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, most_owners: int = OWNERS, most_repositories: int = REPOSITORIES) -> DataFrame:
    """docs with doc_id, source, text. Returns for each row doc_id, mark (a hash of the text) and
    spans: array<struct<start, rank, end, owners, live>> by start, then kind.

    The base kinds (assign, access, hex) always stay. A further candidate, a run of 20 or more
    characters that is made like a key (KEYLIKE) and not like a path or words, is a span of kind owned if its hash belongs to
    its owners: at most most_owners sources of the whole corpus hold it, and at most
    most_repositories documents for each of them. One that more sources hold, or that one source
    repeats over and over, is a copied example. live says the same of each span, base ones too. A
    null or empty text has no spans; a null source counts as one source; repeated rows come back
    repeated; an empty table gives no rows."""
    found = save(_found(docs), "secrets")
    hits = found.where((F.size("base") > 0) | (F.size("more") > 0))
    each = hits.select("doc_id", "mark", F.explode(F.concat("base", "more")).alias("s")).distinct()
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= F.col("owners") * most_repositories)
    counts = save(owners(hits).select("hash", "owners", live.alias("live"), (F.col("repositories") > HOT).alias("hot")), "secret-owners")
    each = each.withColumn("hash", F.col("s.hash"))
    hot = counts.where("hot")
    if 0 < hot.limit(BROADCAST_SECRETS + 1).count() <= BROADCAST_SECRETS:
        # Hits of widely copied secrets stay where they are.
        met = each.join(F.broadcast(hot), "hash", "left")
        rest = met.where("live is null").select(*each.columns).join(counts.where("not hot"), "hash")
        each = met.where("live is not null").unionByName(rest)
    else:
        each = each.join(counts, "hash")
    each = each.where((F.col("s.rank") < RANK["owned"]) | F.col("live"))
    span = F.struct("s.start", "s.rank", "s.end", "owners", "live")
    per_row = each.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    per_row = per_row.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "spans")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return found.join(per_row, on, "left").select("doc_id", "mark", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, instead: str = "[SECRET]", **options) -> DataFrame:
    """docs with what :func:`scan` finds replaced in text, and n_chars (where docs has it) as it
    is then. Overlapping spans are replaced together. All rows and columns stay; null and empty
    texts as they are, and repeated rows alike."""
    hits = scan(docs, **options).where(F.size("spans") > 0)
    hits = hits.select(F.col("doc_id").alias("__ql_id"), F.col("mark").alias("__ql_mark"), F.col("spans").alias("__ql_spans"))
    hits = hits.dropDuplicates(["__ql_id", "__ql_mark"])
    on = F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64("text") == F.col("__ql_mark"))
    rows = docs.join(hits, on, "left")
    begin = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring("text", (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int"))
        fresh = F.concat(acc["out"], before, F.lit(instead))
        out = F.when(x["start"] >= acc["pos"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring("text", (acc["pos"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col("__ql_spans").isNull(), F.col("text")).otherwise(F.aggregate("__ql_spans", begin, step, rest))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("__ql_spans").isNull(), F.col("n_chars")).otherwise(length))
    return rows.select(*docs.columns)


def _listed(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*(F.lit(k) for k in RANK)), x["rank"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets: the base kinds' counts and digest, and all spans."""
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["rank"] == RANK[kind])).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < RANK["owned"])
    return out.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k, *_ in BASE),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _pieces_sql(kind: str, pattern: str, group: int, least: int) -> str:
    cut = "'(?s)(.*?)(?:(" + pattern.replace("'", "''") + r")|\z)'"
    each = lambda g: f"unnest(regexp_extract_all(text, {cut}, {g}))"
    return (
        f"SELECT rid, {RANK[kind]} AS kind, {least} AS least, {each(1)} AS gap, {each(2)} AS found, {each(2 + group)} AS secret, "
        f"unnest(range(len(regexp_extract_all(text, {cut}, 1)))) AS n FROM t"
    )


OP6_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS text FROM documents),
pieces AS ({" UNION ALL ".join(_pieces_sql(*b) for b in (*BASE, ("owned", CANDIDATE, 0, 0)))}),
placed AS (
  SELECT *, (sum(length(gap) + length(found)) OVER (PARTITION BY rid, kind ORDER BY n))::BIGINT AS e FROM pieces),
spans AS (SELECT rid, kind, e - length(found) AS s, e, secret FROM placed WHERE found <> '' AND length(secret) >= least),
base AS (SELECT * FROM spans WHERE kind < {RANK["owned"]}),
more AS (
  SELECT * FROM spans m WHERE kind = {RANK["owned"]} AND {" AND ".join(f"regexp_matches(secret, '{p}')" for p in KEYLIKE)}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.s < m.e AND m.s < b.e)),
held AS (
  SELECT secret, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM (SELECT * FROM base UNION ALL SELECT * FROM more) JOIN t USING (rid) GROUP BY secret),
kept AS (
  SELECT rid, kind, s, ({list(RANK)})[kind + 1] || ':' || s || ':' || e AS listed
  FROM (SELECT * FROM base UNION ALL SELECT m.* FROM more m JOIN held USING (secret) WHERE owners <= {OWNERS} AND repositories <= owners * {REPOSITORIES})),
found AS (
  SELECT rid, string_agg(listed, ',' ORDER BY s, kind) AS spans,
    string_agg(CASE WHEN kind < {RANK["owned"]} THEN listed END, ',' ORDER BY s, kind) AS base, {", ".join(f"count(CASE WHEN kind = {RANK[k]} THEN 1 END) AS n_{k}" for k, *_ in BASE)}
  FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN found USING (rid)
"""
