"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelight.llm.shared import ranked, save, table, text_of

#: Lengths of the n-grams; a word is read with a space before and behind it.
ORDERS = (2, 3, 4)
#: An n-gram belongs to a language if it makes up this share of the language's n-grams or more. So a
#: language has 1 / SHARE of them at most, whatever it is learned from.
SHARE = 1e-5
#: Rows of a filter for each n-gram of its largest language; rows that an n-gram is looked up in.
SPARSE, PROBES = 16, 4
#: Languages of one filter: it has SPARSE / SHARE x LANGS / 8 bytes at most (64 MB). More languages
#: have further filters.
LANGS = 256
#: N-grams that a learning task holds before it sums them up.
HELD = 1 << 22
UNKNOWN = "und"


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 for letters, 2 for marks, which stand inside words, 0 for others."""
    return np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def letters(text: str) -> np.ndarray | None:
    """Code points of the lower-cased text's words, each with one space before and behind; None
    where no letter is."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kind = _kinds()[codes]
    if not (kind == 1).any():
        return None
    word = kind > 0
    kept = word.copy()
    kept[1:] |= word[:-1]
    own = np.where(word, codes, 32)[kept].astype(np.uint64)
    return np.concatenate([[32], own, [] if word[-1] else [32]]).astype(np.uint64)


def grams(codes: np.ndarray, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """64-bit hashes of the n-grams that don't reach into a further word, repeats included."""
    out, space = [], codes == 32
    for n in orders:
        m = max(0, len(codes) - n + 1)
        code, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for i in range(n):
            code = (code ^ codes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(31)
            if 0 < i < n - 1:
                inside &= ~space[i : i + m]
        out.append(code[inside])
    return np.concatenate(out)


def places(codes: np.ndarray, rows: int) -> list[np.ndarray]:
    """The filter's rows (a power of two of them) that each n-gram is looked up in."""
    first, step = codes >> np.uint64(32), codes | np.uint64(1)
    return [((first + np.uint64(i) * step) & np.uint64(rows - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filter:
    """bits: for each row a bit mask of languages, bit j of byte j // 8 for names[j]. An n-gram's
    languages are those whose bit is set in all its rows."""

    names: list[str]
    bits: np.ndarray

    def __post_init__(self) -> None:
        full = np.unpackbits(self.bits, axis=1, bitorder="little")[:, : len(self.names)].mean(axis=0)
        #: The chance that an n-gram of no language seems to be of this one.
        self.false = full**PROBES

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """For each language the share of n-grams that it has: a popcount over the answers, less
        the false positives that are to be expected."""
        at = places(codes, len(self.bits))
        mask = reduce(np.bitwise_and, (self.bits[p] for p in at))
        each = [np.bincount(mask[:, b], minlength=256) @ _BITS for b in range(mask.shape[1])]
        share = np.concatenate(each)[: len(self.names)] / max(1, len(codes))
        return (share - self.false) / np.maximum(1e-12, 1 - self.false)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """rows with lang and text. Returns (lang, gram long, n long): how often each n-gram stands in the
    texts of each language, summed in each task first."""

    def summed(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
        out = {}
        for lang, parts in held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            out[lang] = [(keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64))]
        return out

    def told(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, [(keys, n)] in held.items():
            for s in range(0, len(keys), 1 << 16):
                k = keys[s : s + (1 << 16)].view(np.int64)
                yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(k)), pa.array(k), pa.array(n[s : s + (1 << 16)])], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for i in range(len(batch)):
                codes = letters(batch.column(1)[i].as_py())
                if codes is None:
                    continue
                found = grams(codes)
                held.setdefault(batch.column(0)[i].as_py(), []).append((found, np.ones(len(found), np.int64)))
                size += len(found)
                if size >= HELD:
                    held = summed(held)
                    size = sum(len(keys) for [(keys, _)] in held.values())
                    if size >= HELD // 2:
                        yield from told(held)
                        held, size = {}, 0
        yield from told(summed(held))

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, share: float = SHARE) -> list[Filter]:
    """rows with lang and text: one filter for each LANGS languages, those with most n-grams first.

    All rows' whole texts are counted. Rows without lang, text or letters teach nothing; repeated
    rows count as often as they stand; an empty table gives no filter. What comes to the driver is
    a filter's rows that aren't empty, and names of LANGS languages at a time."""
    spark = rows.sparkSession
    counts = save(counted(rows.where("lang is not null and text is not null")), "lang-grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = save(ranked(total.withColumn("less", -F.col("total")), ["less", "lang"], "lang-order"), "langs")
    own = counts.join(langs, "lang").where(F.col("n") >= F.col("total") * F.lit(share))
    own = save(own.select("rank", "gram"), "lang-own")
    out = []
    for first in range(0, langs.count(), LANGS):
        names = [r["lang"] for r in langs.where(F.col("rank").between(first, first + LANGS - 1)).orderBy("rank").collect()]
        few = own.where(F.col("rank").between(first, first + LANGS - 1))
        most = few.groupBy("rank").count().agg(F.max("count")).first()[0] or 1
        size, wide = 1 << max(10, ceil(np.log2(SPARSE * most))), ceil(len(names) / 8)

        def run(batches: Iterator[pa.RecordBatch], size=size, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = places(batch.column(1).to_numpy().view(np.uint64), size)
                rank = np.tile(batch.column(0).to_numpy() - first, PROBES)
                yield pa.record_batch([pa.array(np.concatenate(at)), pa.array(rank // 8), pa.array(1 << (rank % 8))], ["row", "byte", "bit"])

        set_bits = few.mapInArrow(run, "row long, byte long, bit long").groupBy("row", "byte").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros((size, wide), np.uint8)
        bits[set_bits["row"].to_numpy(), set_bits["byte"].to_numpy()] = set_bits["bits"].to_numpy()
        out.append(Filter(names, bits))
    return out


def identified(docs: DataFrame, filters: list[Filter], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of the text's n-grams that are the language's, 0 to 1)
    and margin (by how much that is above the next language's) added; columns of docs of these
    names are replaced.

    The language with the largest corrected share is told; of equal ones that which was learned
    from more n-grams, then the smaller name. A text that is null, empty or without letters is
    `und`, with score and margin 0, and so is every text where nothing was learned. Whole texts are
    looked at, each row by itself: nothing is shuffled while one filter holds all languages."""
    given = [c for c in docs.columns if c not in ("lang_pred", "score", "margin")]
    rows, spark = docs.select(*given), docs.sparkSession
    if not filters:
        none = F.lit(0.0)
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": none, "margin": none})
    if len(filters) == 1:
        return _told(rows, filters[0], text)
    number = "__ql_row"
    rows = save(rows.withColumn(number, F.monotonically_increasing_id()), "lang-rows")
    parts = [_told(rows.select(number, text), f, text).select(number, F.lit(i).alias("i"), "lang_pred", "score", "margin") for i, f in enumerate(filters)]
    each = reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("lang_pred", "score", "margin"), F.struct("score", -F.col("i"))).alias("best")
    # The next language may be the best one's next, or another filter's best.
    scores = F.sort_array(F.collect_list("score"), asc=False).alias("scores")  # one for each filter
    told = each.groupBy(number).agg(best, scores)
    second = F.greatest(F.col("best.score") - F.col("best.margin"), F.get("scores", F.lit(1)))
    told = told.select(number, "best.lang_pred", "best.score", (F.col("best.score") - second).alias("margin"))
    return rows.join(told, number).drop(number)


def _told(rows: DataFrame, made: Filter, text: str) -> DataFrame:
    shared, given = rows.sparkSession.sparkContext.broadcast(made), rows.columns
    schema = StructType([*rows.schema, *StructType.fromDDL("lang_pred string, score double, margin double")])

    def one(found: str | None) -> tuple[str, float, float]:
        codes = letters(found) if found else None
        if codes is None:
            return UNKNOWN, 0.0, 0.0
        f: Filter = shared.value
        share = np.clip(f.shares(grams(codes)), 0.0, 1.0)
        best = int(share.argmax())
        rest = np.delete(share, best)
        return f.names[best], float(share[best]), float(share[best] - rest.max()) if len(rest) else float(share[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = given.index(text)
        for batch in batches:
            told = [one(batch.column(at)[i].as_py()) for i in range(len(batch))]
            more = [pa.array([t[j] for t in told], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.record_batch([*batch.columns, *more], [*given, "lang_pred", "score", "margin"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the decimal doc_id leaves 2 when divided by 4; null without doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out. A document without
    doc_id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_of().alias("text"))
    return identified(rows, filters).select("doc_id", "held_out", "lang_pred", "score", "margin")
