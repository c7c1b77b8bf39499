"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.components import components, joined_up
from quirelight.llm.shared import save, table

BITS = 64
SEED = 42
#: Codes that one index holds; larger groups are dealt to pairs of blocks of this size.
BLOCK = 2048
#: Nodes or codes under a node of the index.
FAN = 16


def shingle_hashes(text: bytes, n: int = 4) -> np.ndarray:
    """The hashes of the text's n-word shingles in their order; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - n + 1)
    stops = ends[-last:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops, strict=True)], "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes; of none, zero."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        rows = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, n: int = 4) -> int:
    """The 64-bit SimHash of the text's n-word shingles; without words, zero."""
    return fingerprint_of(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, code long: the fingerprint's bits as a signed number) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t or b"", n) for t in batch.column(1).to_pylist()]
            codes = np.array(codes, np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(codes)], ["doc_id", "code"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Each code's place in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A hierarchy over codes in Gray order. A node stands for up to FAN neighbours below it
    and holds the bits on which all its codes agree (mask) and their values (pattern)."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.levels = []  # from the leaves' parents up: (pattern, mask)
        low = high = self.codes
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high)))

    def pairs(self, radius: int, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions i < j (in self.codes) of codes that differ in at most radius bits."""
        n = len(self.codes)
        for first in range(0, n - 1, chunk):
            asked = np.arange(first, min(first + chunk, n))
            q, node = asked, np.zeros(len(asked), np.int64)
            above = np.zeros(len(asked), np.uint64)
            apart = np.zeros(len(asked), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[depth]
                # Differences add up on the bits that this node fixes and its parent did not.
                fresh = mask[node] & ~above
                apart = apart + np.bitwise_count((self.codes[q] ^ pattern[node]) & fresh)
                last = (node + 1) * FAN ** (depth + 1) - 1
                keep = (apart <= radius) & (last > q)
                q, node, apart, above = q[keep], node[keep], apart[keep], mask[node[keep]]
                q, apart, above = (np.repeat(x, FAN) for x in (q, apart, above))
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < (len(self.levels[depth - 1][0]) if depth else n)
                q, node, apart, above = q[inside], node[inside], apart[inside], above[inside]
            keep = node > q
            q, node = q[keep], node[keep]
            keep = np.bitwise_count(self.codes[q] ^ self.codes[node]) <= radius
            yield q[keep], node[keep]


def _links_of(codes: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the pairs within radius connect."""
    index = GrayIndex(codes)
    label = joined_up(len(codes), index.pairs(radius))
    moved = np.flatnonzero(label != np.arange(len(codes)))
    ids = ids[index.order]
    return ids[moved], ids[label[moved]]


def _bands(count: int, bands: int) -> list[tuple[int, int]]:
    edges = [BITS * i // bands for i in range(bands + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def band_keys(bands: int, radius: int) -> list[int]:
    """Masks of which codes within radius agree on at least one: with radius differing bits at
    least bands - radius of the bands hold none."""
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in _bands(BITS, bands)]
    return [sum(c) for c in combinations(parts, bands - radius)]


def code_links(codes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """codes: (id long, code long), a row for each different code. Returns (a, b): links that
    connect exactly what the pairs within radius connect.

    The root level of the index is dealt out: a code goes to one group for each mask of
    :func:`band_keys` under which its masked bits are the group's shared pattern. Each group is
    indexed in Gray order below. More codes get wider masks, so that groups stay near the block
    size; a group that is still larger goes, exactly, to pairs of blocks."""
    spark, n = codes.sparkSession, codes.count()
    bands = radius + 1
    while n >> int(BITS * (bands - radius) / bands) > block and bands < radius + 4:
        bands += 1
    masks = [m - (1 << 64) if m >> 63 else m for m in band_keys(bands, radius)]
    key = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("mask"), F.col("code").bitwiseAND(F.lit(m)).alias("bits"))
                for i, m in enumerate(masks)
            )
        )
    )
    keyed = codes.select("id", "code", key.alias("k")).select("id", "code", "k.*")
    large = keyed.groupBy("mask", "bits").count().where(F.col("count") > block)
    large = save(large.select("mask", "bits", F.ceil(F.col("count") / block).cast("int").alias("n")), "sh-large")
    if large.count():
        # At most count * masks / block rows.
        keyed = keyed.join(large, ["mask", "bits"], "left")
        own = F.pmod(F.xxhash64("code"), F.coalesce("n", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))
        keyed = keyed.withColumn("own", own).withColumn("other", other)
        keyed = keyed.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    else:
        keyed = keyed.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    group = ["mask", "bits", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 6), np.int64)
        for batch in (*batches, None):
            if batch is not None:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
                rest = np.concatenate([rest, rows])
            if not len(rest):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (rest[1:, :4] != rest[:-1, :4]).any(axis=1))))
            stops = [*starts[1:], len(rest)]
            whole = len(starts) if batch is None else len(starts) - 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(starts[:whole], stops[:whole], strict=True):
                if e - s > 1:
                    x, y = _links_of(rest[s:e, 4].astype(np.uint64), rest[s:e, 5], radius)
                    a.append(x)
                    b.append(y)
            rest = rest[stops[whole - 1] if whole else 0 :]
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = keyed.select(*group, "code", "id").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, n: int = 4) -> DataFrame:
    """docs with doc_id and text; further columns don't matter. Returns (doc_id long,
    fingerprint string, component_id long) for each row.

    Texts are lower-cased (A-Z), cut into words and n-word shingles; a shorter text is one
    shingle. A null or empty text has fingerprint zero and is linked like any other. Equal
    fingerprints, and those that differ in at most radius bits, are linked; component_id is the
    smallest doc_id reachable. Repeated rows come back repeated; a null doc_id gets its
    fingerprint's component, which is null where no row of the component has a doc_id. An empty
    table gives an empty result."""
    codes = save(fingerprints(docs, n), "sh-codes")
    # A code is its own number: it is there whether its rows have a doc_id or not.
    named = save(codes.groupBy("code").agg(F.min("doc_id").alias("first")), "sh-named")
    parts = components(code_links(named.select(F.col("code").alias("id"), "code"), radius))
    part = F.coalesce("component", "code").alias("part")
    of_code = save(named.join(parts, F.col("code") == F.col("node"), "left").select("code", "first", part), "sh-parts")
    smallest = of_code.groupBy("part").agg(F.min("first").alias("component_id"))
    out = codes.join(of_code.select("code", "part").join(smallest, "part"), "code")
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' SimHash fingerprints and the components of those within 4 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
