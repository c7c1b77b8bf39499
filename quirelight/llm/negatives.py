"""Hard negatives with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.llm.shared import ranked, save, table

#: Cells of each dimension; their inner edges are quantiles of a sample of so many rows (about, by a
#: hash) and bytes.
CELLS, SAMPLE, SAMPLE_BYTES = 64, 16_384, 64 << 20
#: Bytes of the anchors that go to the tasks at once, and rows and anchors that a task scores at once.
ANCHOR_BYTES, ROWS, ANCHORS = 16 << 20, 4096, 64
#: Positives of an anchor, negatives of a pair, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Stands for the id of a row that has none, after all others.
NO_ID = (1 << 63) - 1
#: Beyond any score: scores are sums that stay below.
FAR = 1 << 62


@dataclass
class Approximation:
    """For each dimension the ascending inner edges of its cells (a cell holds values from an edge on
    to below the next), and each cell's smallest and largest possible value."""

    edges: np.ndarray  # dimensions x (CELLS - 1)
    least: np.ndarray  # dimensions x CELLS
    most: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Approximation:
        edges = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.astype(np.int64)
        least = np.concatenate([lows[:, None], edges], axis=1)
        # An empty cell, between equal edges, has a largest value below its smallest: no row is in it.
        most = np.concatenate([edges - 1, highs[:, None]], axis=1)
        return Approximation(np.ascontiguousarray(edges), least, np.maximum(most, least))

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for d, e in enumerate(self.edges):
            out[:, d] = np.searchsorted(e, x[:, d], side="right")
        return out

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimensions, cells, anchors): the least and the most that a value of the cell adds to the
        anchor's score."""
        a, b = self.least[:, :, None] * anchors.T[:, None, :], self.most[:, :, None] * anchors.T[:, None, :]
        return np.minimum(a, b), np.maximum(a, b)


def _bounds(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """(rows, anchors): lower and upper bounds of the scores, summed up by table lookup."""
    out = []
    for t in tables:
        total = np.zeros((len(cells), t.shape[2]), np.int64)
        for d in range(cells.shape[1]):
            total += t[d][cells[:, d]]
        out.append(total)
    return out


@dataclass
class Asked:
    """Anchors with windows of scores, one or more for each, from low to high. alike: whether rows of the anchor's
    label are asked for, or those of others; each window asks for its first `top` rows."""

    rows: np.ndarray  # the anchors' row numbers
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray  # anchors x windows
    high: np.ndarray
    alike: bool
    top: int


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """The kth largest value of each column; -FAR where there are fewer."""
    if len(x) < k:
        return np.full(x.shape[1], -FAR)
    return np.partition(x, len(x) - k, axis=0)[len(x) - k]


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # windows, scores, ids, row numbers


def _first(found: Found, top: int) -> Found:
    """The first rows of each window: by score, largest first, then by id and row number."""
    order = np.lexsort((found[3], found[2], -found[1], found[0]))
    window = found[0][order]
    start = np.concatenate([[True], window[1:] != window[:-1]]) if len(window) else np.zeros(0, bool)
    nth = np.arange(len(window)) - np.maximum.accumulate(np.where(start, np.arange(len(window)), 0))
    return tuple(c[order][nth < top] for c in found)


class _Scan:
    """The rows that a task has seen go past all anchors. held: the first rows of each window so far."""

    def __init__(self, asked: Asked, approximation: Approximation):
        self.asked, self.approximation = asked, approximation
        self.windows = asked.low.shape[1]
        self.held: Found = tuple(np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(asked.low.shape, -FAR)  # a window's last score, once it is full

    def add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, vectors: np.ndarray) -> None:
        a, found = self.asked, [self.held]
        for s in range(0, len(a.rows), ANCHORS):
            own = slice(s, s + ANCHORS)
            lower, upper = _bounds(cells, self.approximation.tables(a.vectors[own]))
            fits = (labels[:, None] == a.labels[own][None]) == a.alike
            fits &= rows[:, None] != a.rows[own][None]
            for w in range(self.windows):
                low, high = a.low[own, w], a.high[own, w]
                # Rows surely inside tell which scores, at least, the window's first rows have.
                inside = fits & (lower >= low) & (upper <= high)
                enough = np.maximum(_largest(np.where(inside, lower, -FAR), a.top), self.least[own, w])
                near = fits & (upper >= np.maximum(low, enough)) & (lower <= high)
                r, q = np.nonzero(near)
                for t in range(0, len(r), 1 << 16):
                    i, j = r[t : t + (1 << 16)], q[t : t + (1 << 16)]
                    score = np.einsum("ij,ij->i", vectors[i], a.vectors[own][j])
                    kept = (score >= low[j]) & (score <= high[j])
                    i, j = i[kept], j[kept]
                    found.append(((s + j) * self.windows + w, score[kept], ids[i], rows[i]))
        self.held = _first(tuple(np.concatenate([f[c] for f in found]) for c in range(4)), a.top)
        window, n = np.unique(self.held[0], return_counts=True)
        last = self.held[1][np.cumsum(n) - 1]
        self.least.reshape(-1)[window[n >= a.top]] = last[n >= a.top]


_FOUND = "window long, score long, id long, row long"


def _numbers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(batch), -1)


def scanned(file: DataFrame, asked: Asked, approximation: Approximation) -> DataFrame:
    """file: (row, id, label, cells binary, v array<long>). The first rows of each window, (window, rank, score,
    id): each task gives its own, of which those of all are taken."""
    shared = file.sparkSession.sparkContext.broadcast((asked, approximation))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(*shared.value)
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                part = batch.slice(s, ROWS)
                cells = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(part), -1)
                scan.add(*(part.column(c).to_numpy(zero_copy_only=False) for c in range(3)), cells, _numbers(part, 4))
        yield pa.record_batch([pa.array(c) for c in scan.held], ["window", "score", "id", "row"])

    found = file.select("row", "id", "label", "cells", "v").mapInArrow(run, _FOUND)
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.col("score").desc(), "id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= asked.top).select("window", "rank", "score", "id")


def _approximated(rows: DataFrame, dims: int) -> tuple[DataFrame, Approximation]:
    """The vector-approximation file of rows of one length, and its cells."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, FAR), np.full(dims, -FAR)
        for batch in batches:
            if len(batch):
                v = _numbers(batch, 0)
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pa.record_batch([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = rows.select("v").mapInArrow(reach, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = ends.orderBy("d").toArrow()  # a row for each dimension
    n, some = rows.count(), min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dims)))
    chance = F.pmod(F.xxhash64("row", F.lit("cells")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, some / n)) + 1)
    sample = rows.where(chance).select("v").toArrow()["v"].combine_chunks()
    sample = np.asarray(sample.flatten(), np.int64).reshape(len(sample), dims)
    low, high = ends["low"].to_numpy(), ends["high"].to_numpy()
    made = Approximation.of(sample if len(sample) else np.stack([low, high]), low, high)
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(_numbers(batch, 4))
            yield pa.record_batch([*batch.columns[:3], pa.array([c.tobytes() for c in cells], pa.binary()), *batch.columns[3:]], ["row", "id", "label", "cells", "asks", "v"])

    file = rows.select("row", "id", "label", "asks", "v").mapInArrow(run, "row long, id long, label long, cells binary, asks boolean, v array<long>")
    return save(file, "va-file"), made


def hard_negatives(vectors: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors: vec_id, label (whole number), v array<long>; asks tells the anchors among them. Returns for
    each anchor and each of its first `positives` other rows of its label the first `negatives` rows of
    other labels whose score is from low to high hundredths of the positive's: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product with the anchor; larger ones come first, then smaller ids. Each
    dimension is cut into cells; a row's cells give bounds of its scores by table lookup, and only
    rows that may be among the first of a window, by the bounds of the rows that are surely in it
    and the scores found so far, are scored. Nothing is left out. Anchors go to the tasks in
    blocks of ANCHOR_BYTES; every row is met by every anchor of its length, in a pass over the file
    for each block, so rows aren't shuffled and labels don't matter to where they lie.

    Rows with a null label, vector or component take no part; neither do those of another length
    with an anchor. A row without vec_id is as good as another, comes last among equals, and can't
    be an anchor unless asks says so. Repeated rows are rows of their own: each can be the other's
    positive, and each is an anchor. Empty tables, and anchors without positives, give no rows.
    Components whose scores might leave the range of long raise an ArithmeticError."""
    whole = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), "v")
    # Numbered as it is written, so every pass reads the same numbers.
    rows = save(rows.where(whole).withColumn("row", F.monotonically_increasing_id()), "va-rows")
    lengths = [r["d"] for r in rows.where("asks").select(F.size("v").alias("d")).distinct().orderBy("d").toLocalIterator()]
    parts = [p for d in lengths for p in _mined(rows.where(F.size("v") == d), d, positives, negatives, low, high)]
    out = reduce(DataFrame.unionByName, parts, rows.sparkSession.createDataFrame([], f"anchor_id long, positive_id long, {_MINED}"))
    return out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("anchor_id", "positive_id", "negative_id")})


_MINED = "rank int, negative_id long, positive_score long, negative_score long"


def _mined(rows: DataFrame, dims: int, positives: int, negatives: int, low: int, high: int) -> Iterator[DataFrame]:
    spark = rows.sparkSession
    file, made = _approximated(rows, dims)
    reach = np.maximum(np.abs(made.least), np.abs(made.most)).max(axis=1).astype(float) if dims else np.zeros(0)
    if float((reach * reach).sum()) * max(100, high) >= FAR:
        raise ArithmeticError("scores of these components leave the range of long")
    anchors, block = file.where("asks"), max(1, ANCHOR_BYTES // (8 * dims + 64))
    n = anchors.count()
    if n > block:
        anchors = save(ranked(anchors, ["row"], "va-order"), "va-anchors")
    for first in range(0, n, block):
        some = anchors.where(F.col("rank").between(first, first + block - 1)) if n > block else anchors
        got = some.select("row", "id", "label", "v").orderBy("row").toArrow()
        ids, own, labels = (got[c].to_numpy() for c in ("id", "row", "label"))
        v = np.asarray(got["v"].combine_chunks().flatten(), np.int64).reshape(len(ids), dims)
        every = np.full((len(ids), 1), FAR)
        best = save(scanned(file, Asked(own, labels, v, -every, every, True, positives), made), "va-positives")
        pairs = best.toArrow()  # `positives` for each anchor of the block at most
        anchor, rank, score = (pairs[c].to_numpy() for c in ("window", "rank", "score"))
        # A window without rows, from FAR to -FAR, where an anchor has fewer positives.
        lows, highs = np.full((len(ids), positives), FAR), np.full((len(ids), positives), -FAR)
        lows[anchor, rank - 1] = -((-low * score) // 100)
        highs[anchor, rank - 1] = (high * score) // 100
        mined = scanned(file, Asked(own, labels, v, lows, highs, False, negatives), made)
        names = spark.createDataFrame(pa.table({"window": np.arange(len(ids)), "anchor_id": ids}))
        best = best.join(F.broadcast(names), "window").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("window") * positives + F.col("rank") - 1).alias("window"))
        mined = mined.select("window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = mined.join(best, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        yield save(out, "va-mined")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, components in 256ths; anchors are the ids divisible by 100. The
    label of ids divisible by 7 is moved on by one, of ten."""
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite).select("vec_id", label.alias("label"), v.alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, r.n, r.vec_id, a.label = r.label AS alike,
         list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r ON a.n <> r.n AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) AS nth FROM scored WHERE alike),
mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id, s.n) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.alike AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
  WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10
"""
