"""Bilingual glossaries: filters for chunks, merges, alignment, term candidates, edits.

entries: glossary_id, entry_id, source, target, type, notes, confirmed, variants array<string>."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirelight.functions.text import strip, terms
from quirelight.sources.store import saved, spread

#: Needles up to this many are sent to the tasks; more are joined by a piece of them.
BROADCAST_NEEDLES = 10_000
#: Characters of the pieces by which more needles meet texts, and different pieces of needles that are sent to the tasks.
PIECE, BROADCAST_PIECES = 6, 200_000


def needles(entries: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, needle): an entry's source and variants, empty ones left out."""
    every = F.array_union(F.array("source"), F.coalesce("variants", F.array().cast("array<string>")))
    return entries.select(key, F.explode(every).alias("needle")).where("needle <> ''").distinct()


def relevant(chunks: DataFrame, entries: DataFrame, chunk: str = "chunk_id", key: str = "entry_id", most: int = BROADCAST_NEEDLES) -> DataFrame:
    """(chunk, key) for entries of which the source or a variant stands in the chunk's text, case
    and all. Up to most needles are counted, sent to the tasks as one automaton, and found in one
    pass over each text. With more, see :func:`candidates`."""
    found = needles(entries, key)
    if found.limit(most + 1).count() <= most:
        return _scanned(chunks, found, chunk, key)
    met = candidates(chunks, found.select("needle").distinct(), chunk)
    # All needles that a text may hold are gathered first, so each text is fetched once.
    asked = met.groupBy(chunk).agg(F.collect_list("needle").alias("__needles"))
    texts = chunks.select(chunk, "text").join(asked, chunk)
    held = texts.select(chunk, F.explode(F.filter("__needles", lambda n: F.col("text").contains(n))).alias("needle"))
    return held.join(found, "needle").select(chunk, key).distinct()


def candidates(chunks: DataFrame, wanted: DataFrame, chunk: str) -> DataFrame:
    """wanted: needle, each once. (chunk, needle) for needles whose rarest piece stands in the chunk's text: of the
    pieces of PIECE characters (a shorter needle is one) that which the fewest texts hold. A needle
    that is no longer than a piece is found by this alone; one with a piece that no text holds goes."""
    size = F.least(F.length("needle"), F.lit(PIECE))
    # Overlapping pieces by looking ahead: a text is passed once, whatever its length.
    ahead = lambda text, n: F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1))
    each = wanted.select("needle", F.explode(F.array_distinct(ahead(F.col("needle"), size))).alias("piece"))
    each = saved(each, "needle-pieces")
    sizes = [r["n"] for r in each.select(F.length("piece").alias("n")).distinct().collect()]  # PIECE at most
    pieces = F.array_distinct(F.concat(*(ahead(F.col("text"), F.lit(n)) for n in sizes)) if sizes else F.array().cast("array<string>"))
    vocabulary = each.select("piece").distinct()
    few = vocabulary.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES
    own = spread(chunks.where("text is not null").select(chunk, "text")).select(chunk, F.explode(pieces).alias("piece"))
    own = saved(own.join(F.broadcast(vocabulary) if few else vocabulary, "piece", "left_semi"), "text-pieces")
    held = own.groupBy("piece").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "piece")
    rarest = each.join(held, "piece", "left").groupBy("needle").agg(F.min_by("piece", rarity).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return own.join(rarest.where("n > 0").select("needle", "piece"), "piece").select(chunk, "needle")


def _scanned(chunks: DataFrame, found: DataFrame, chunk: str, key: str) -> DataFrame:
    """Needles, few, found by an automaton. Equal needles of several entries are found together."""
    rows = found.groupBy("needle").agg(F.collect_set(key).alias("keys")).collect()  # counted before
    shared = chunks.sparkSession.sparkContext.broadcast([(r["needle"], r["keys"]) for r in rows])
    kinds = [f.dataType for f in chunks.select(chunk).schema] + [f.dataType for f in found.select(key).schema]
    types = [to_arrow_type(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle, keys in shared.value:
            machine.add_word(needle, keys)
        if shared.value:
            machine.make_automaton()
        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for _, keys in machine.iter(text) for k in keys} if text and shared.value else ()
                ids += [i] * len(own)
                out += own
            yield pa.record_batch([pa.array(ids, types[0]), pa.array(out, types[1])], [chunk, key])

    schema = f"`{chunk}` {kinds[0].simpleString()}, `{key}` {kinds[1].simpleString()}"
    return chunks.select(chunk, "text").mapInArrow(run, schema).distinct()


def first_wins(slots: DataFrame) -> DataFrame:
    """slots: slot, pos, source, ... : of entries with the same source (stripped) the first slot's
    first one."""
    rows = slots.withColumn("source", strip(F.col("source"))).where("source <> ''")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot", "pos"))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def prompt_list(entries: DataFrame, only_confirmed: bool = True, by: str = "glossary_id") -> DataFrame:
    """Entries as a glossary's prompt lists them, with place (from 1): proper nouns first, then by source."""
    rows = entries.where("confirmed") if only_confirmed else entries
    order = Window.partitionBy(by).orderBy(F.when(F.col("type") == "proper_noun", 0).otherwise(1), "source", "entry_id")
    return rows.withColumn("place", F.row_number().over(order))


def edited(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: entry_id, action (add, confirm, reject, update) and new values, null for no
    change; one change for an entry. An added entry is unconfirmed."""
    values = [c for c in entries.columns if c not in ("entry_id", "confirmed")]
    new = changes.select("entry_id", "action", *(F.col(c).alias(f"__{c}") for c in values))
    added = new.where("action = 'add'").select("entry_id", *(F.col(f"__{c}").alias(c) for c in values), F.lit(False).alias("confirmed"))
    rows = entries.join(new.where("action <> 'add'"), "entry_id", "left").where("coalesce(action, '') <> 'reject'")
    update = F.coalesce(F.col("action") == "update", F.lit(False))
    for c in values:
        rows = rows.withColumn(c, F.when(update, F.coalesce(f"__{c}", c)).otherwise(F.col(c)))
    rows = rows.withColumn("confirmed", F.col("confirmed") | F.coalesce(F.col("action") == "confirm", F.lit(False)))
    return rows.select(*entries.columns).unionByName(added.select(*entries.columns))


def aligned(source: DataFrame, target: DataFrame, by: str = "pair_id") -> DataFrame:
    """source, target: by, ord, text. (by, idx, source_text, target_text): the nth texts together;
    what one side has more stands alone."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1
    a = source.select(by, nth.alias("idx"), F.col("text").alias("source_text"))
    b = target.select(by, nth.alias("idx"), F.col("text").alias("target_text"))
    return a.join(b, [by, "idx"], "full_outer")


def gate(pairs: DataFrame, by: str = "pair_id", mismatch: float = 0.3) -> DataFrame:
    """(by, n_source, n_target, ratio, manual): whether a pair of books differs too much in
    length, or lacks a side, to be paired by place."""
    counts = pairs.groupBy(by).agg(F.count("source_text").alias("n_source"), F.count("target_text").alias("n_target"))
    most = F.greatest("n_source", "n_target")
    ratio = F.abs(F.col("n_source") - F.col("n_target")) / most.cast("double")
    counts = counts.withColumn("ratio", ratio)
    return counts.withColumn("manual", (F.col("n_source") == 0) | (F.col("n_target") == 0) | (F.col("ratio") > mismatch))


def term_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(term, n): in how many pairs' sources a term of two characters or more stands."""
    each = pairs.select(*keys, F.explode(F.array_distinct(terms(F.col("source_text")))).alias("term")).where("length(term) >= 2")
    return each.groupBy("term").agg(F.count("*").alias("n"))


def cooccurrence(pairs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, target, n): how often a term of the target stands in the pairs of a source term.
    With wanted (term), for those alone."""
    both = pairs.select(F.array_distinct(terms(F.col("source_text"))).alias("s"), terms(F.col("target_text")).alias("t"))
    each = both.select(F.explode("s").alias("term"), "t").where("length(term) >= 2")
    if wanted is not None:
        each = each.join(wanted.select("term"), "term", "left_semi")
    each = each.select("term", F.explode("t").alias("target")).where("length(target) >= 2")
    return each.groupBy("term", "target").agg(F.count("*").alias("n"))


def term_candidates(pairs: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """(term, n, target): the most frequent terms, then those of two pairs or more whose most
    frequent target term differs from them. Ties go to the smaller text."""
    top = term_counts(pairs, keys).orderBy(F.desc("n"), "term").limit(most)
    best = cooccurrence(pairs, F.broadcast(top))
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "target"))
    best = best.withColumn("nth", nth).where("nth = 1").select("term", "target")
    return top.where("n >= 2").join(best, "term").where(F.col("target") != F.col("term"))


def confirmed_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("glossary_id").agg(F.count_if("confirmed").alias("confirmed"), F.count("*").alias("total"))


def labels_of(kind: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("proper_noun"))
