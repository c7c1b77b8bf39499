"""Embedding near-dedup with an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.llm.components import components, joined_up
from quirelight.llm.shared import save, table

#: Vectors that the codebooks are fitted on, and asked ones that recall is measured with, at most
#: (about: rows are taken by a hash).
SAMPLE, ASKED = 16_384, 512
#: Made neighbours of each asked vector, just at the cosine, that recall is measured with too.
MADE = 8
#: Members of a row of the grid, and vectors that ask there, in one task; more are dealt to pairs of blocks.
MEMBERS, ASKS = 8192, 16_384
#: Mean vectors of a cell that the codebooks' size aims at; most centroids of a half (2 billion vectors' worth).
FILL, MOST = 128, 4096


def codebook(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids by Lloyd's rounds from a seeded choice."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_apart(points[s : s + 2048], centres).argmin(axis=1) for s in range(0, len(points), 2048)])
        for c in range(len(centres)):
            own = points[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def traversal(first: np.ndarray, second: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Multi-sequence traversal of the product grid: the most pairs (i, j) of least first[i] +
    second[j], in that order. A cell is queued once a neighbour before it, in either sorted
    sequence, has been visited."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    queue, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while queue and len(out) < most:
        _, i, j = heappop(queue)
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heappush(queue, (first[a[p]] + second[b[q]], p, q))
    return out


def traversals(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """The cells (i * width + j) that :func:`traversal` visits, for each row of first and second at once, in no order.
    The pair at places (r, s) of the two sorted sequences comes behind all pairs before it in both,
    so it is among the first `most` only if (r + 1) * (s + 1) is no more than that."""
    width, most = second.shape[1], min(most, first.shape[1] * second.shape[1])
    r = np.arange(min(most, first.shape[1]))
    each = np.minimum(most // (r + 1), width)
    r, s = np.repeat(r, each), np.concatenate([np.arange(n) for n in each])
    a, b = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
    total = np.take_along_axis(first, a, 1)[:, r] + np.take_along_axis(second, b, 1)[:, s]
    near = np.argpartition(total, most - 1, axis=1)[:, :most]
    return np.take_along_axis(a, r[near], 1) * width + np.take_along_axis(b, s[near], 1)


class MultiIndex:
    """Codebooks of the two halves of unit vectors; a cell is a pair of their centroids. visited:
    the cells that a traversal goes through."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = max(1, sample.shape[1] // 2)
        self.books = codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)
        self.width = len(self.books[1])
        self.visited = 1

    def apart(self, x: np.ndarray) -> list[np.ndarray]:
        halves = x[:, : self.half], x[:, self.half :]
        return [_apart(v, b) for v, b in zip(halves, self.books, strict=True)]

    def cells(self, apart: list[np.ndarray]) -> np.ndarray:
        return apart[0].argmin(axis=1) * self.width + apart[1].argmin(axis=1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a traversal from each vector goes through before the given one."""
        out = np.zeros(len(x), np.int64)
        for s in range(0, len(x), 256):
            first, second = self.apart(x[s : s + 256])
            at = np.arange(len(first)), cells[s : s + 256]
            mine = first[at[0], at[1] // self.width] + second[at[0], at[1] % self.width]
            second = np.sort(second, axis=1)
            out[s : s + 256] = [np.searchsorted(b, m - a).sum() for a, b, m in zip(first, second, mine, strict=True)]
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector its own cell, and the cells visited: if its own isn't among them, it stands in
        place of one."""
        own, cells = np.zeros(len(x), np.int64), np.zeros((len(x), min(self.visited, len(self.books[0]) * self.width)), np.int64)
        for s in range(0, len(x), 256):
            apart = self.apart(x[s : s + 256])
            own[s : s + 256], cells[s : s + 256] = self.cells(apart), traversals(*apart, self.visited)
        lacking = ~(cells == own[:, None]).any(axis=1)
        cells[lacking, 0] = own[lacking]
        return own, cells


def made_neighbours(x: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """MADE unit vectors at exactly the cosine from each of x, in seeded directions."""
    rng = np.random.default_rng(seed)
    q = np.repeat(x, MADE, axis=0)
    r = rng.normal(size=q.shape)
    r -= (r * q).sum(axis=1)[:, None] * q
    length = np.sqrt((r * r).sum(axis=1))[:, None]
    return cosine * q + np.sqrt(max(0.0, 1 - cosine * cosine)) * r / np.maximum(length, 1e-300)


def needed(reps: DataFrame, index: MultiIndex, cosine: float, recall: float) -> int:
    """The cells to visit for the recall, measured in two ways, of which the larger counts. The links of
    some ASKED vectors with all vectors are found by brute force, in tasks, and with each the cells
    that either side goes through to meet the other; each asked vector that has links weighs the
    same, so one large group doesn't decide. And to each asked vector neighbours are made that are
    just near enough, and as hard to meet as any: where links are rare, and the asked vectors have
    few or none, these tell how far a traversal must go."""
    n = reps.count()
    chance = F.pmod(F.xxhash64("id", F.lit("asked")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, ASKED / max(n, 1))) + 1)
    some = reps.where(chance).select("id", "v").toArrow()
    if not len(some):
        some = reps.select("id", "v").limit(ASKED).toArrow()
    ids, asked = some["id"].to_numpy(), np.array(some["v"].combine_chunks().flatten()).reshape(len(some), -1)
    cells = index.cells(index.apart(asked))
    made = made_neighbours(asked, cosine)
    theirs, mine = index.cells(index.apart(made)), np.repeat(cells, MADE)
    ranks = np.sort(np.minimum(index.ranks(np.repeat(asked, MADE, axis=0), theirs), index.ranks(made, mine)))
    floor = int(ranks[ceil(recall * len(ranks)) - 1]) + 1
    shared = reps.sparkSession.sparkContext.broadcast((index, ids, asked, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, asked, cells = shared.value
        for batch in batches:
            other, v = batch.column(0).to_numpy(), np.array(batch.column(1).flatten()).reshape(len(batch), -1)
            for s in range(0, len(other), 2048):
                x = v[s : s + 2048]
                i, j = np.nonzero(_linked(asked, x, cosine) & (ids[:, None] != other[s : s + 2048][None]))
                near, at = np.unique(j, return_inverse=True)
                own = index.cells(index.apart(x[near])) if len(near) else np.zeros(0, np.int64)
                rank = np.minimum(index.ranks(asked[i], own[at]), index.ranks(x[j], cells[i]))
                pairs, n = np.unique(np.column_stack([i, rank]), axis=0, return_counts=True)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["asked", "rank", "n"])

    # A row for each asked vector and rank: ASKED times the cells at most, far fewer where the grid fits.
    met = reps.select("id", "v").mapInArrow(run, "asked long, rank long, n long").groupBy("rank", "asked").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("asked"))
    by_rank = met.withColumn("w", share).groupBy("rank").agg(F.sum("w").alias("w")).orderBy("rank").toArrow()
    if not len(by_rank):
        return floor
    upto = np.cumsum(by_rank["w"].to_numpy())
    return max(floor, int(by_rank["rank"].to_numpy()[np.searchsorted(upto, recall * upto[-1] - 1e-9)]) + 1)


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None]
    return x @ y.T / norms >= cosine


@dataclass
class Rows:
    """Vectors of one row of the grid: members with all cells that they visit, or those who ask there, with the
    cells of this row that they visit; -1 fills the lists up."""

    ids: np.ndarray
    many: np.ndarray
    own: np.ndarray
    cells: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        ids, many, own, cells, v = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "many", "own", "cells", "v"))
        sizes = np.diff(cells.offsets.to_numpy())
        wide = np.full((len(ids), max(1, sizes.max(initial=0))), -1)
        wide[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = cells.flatten().to_numpy()
        return Rows(ids.to_numpy(), many.to_numpy(), own.to_numpy(), wide, np.array(v.flatten()).reshape(len(ids), -1))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        """Rows of one block together; their lists may differ in width."""
        wide = max(p.cells.shape[1] for p in parts)
        cells = [np.pad(p.cells, ((0, 0), (0, wide - p.cells.shape[1])), constant_values=-1) for p in parts]
        ids, many, own, v = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "many", "own", "v"))
        return Rows(ids, many, own, np.concatenate(cells), v)


def _pairs(asking: Rows, members: Rows, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of asking vectors and of members that are linked, cell by cell of those visited."""
    who, at = np.nonzero(asking.cells >= 0)
    cell = asking.cells[who, at]
    by_cell, member = np.argsort(cell, kind="stable"), np.argsort(members.own, kind="stable")
    who, cell, own = who[by_cell], cell[by_cell], members.own[member]
    for c in np.unique(own):
        q, m = who[slice(*np.searchsorted(cell, [c, c + 1]))], member[slice(*np.searchsorted(own, [c, c + 1]))]
        for s in range(0, len(q), 512):
            i, j = np.nonzero(_linked(asking.v[q[s : s + 512]], members.v[m], cosine))
            yield q[s : s + 512][i], m[j]


def _met(asking: Rows, members: Rows, cosine: float) -> pa.RecordBatch:
    """Links between asking vectors and a block's members: rows (a, b, null) are a forest over
    them, rows (a, null, n) count the copies that a is linked with here."""
    ids = np.concatenate([asking.ids, members.ids])
    many = np.concatenate([asking.many, members.many])
    n, found, first = np.zeros(len(ids), np.int64), [], len(asking.ids)
    for i, j in _pairs(asking, members, cosine):
        # Each pair counts in one place: in its own cell from the smaller id, and in the lower
        # of two cells if either vector visits the other's.
        a, b = asking.own[i], members.own[j]
        both = (members.cells[j] == a[:, None]).any(axis=1)
        once = np.where(a == b, asking.ids[i] < members.ids[j], ~both | (b < a))
        i, j = i[once], j[once] + first
        np.add.at(n, i, many[j])
        np.add.at(n, j, many[i])
        found.append((i, j))
    # A vector that asks and is a member stands twice; its places are joined first.
    _, same, at = np.unique(ids, return_index=True, return_inverse=True)
    label = joined_up(len(ids), iter([(np.arange(len(ids)), same[at]), *found]))
    moved, counted = np.flatnonzero(ids != ids[label]), np.flatnonzero(n)
    a = np.concatenate([ids[moved], ids[counted]])
    b = [*ids[label[moved]].tolist(), *[None] * len(counted)]
    c = [*[None] * len(moved), *n[counted].tolist()]
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "n"])


ROUTED = "row int, member boolean, id long, many long, own long, cells array<long>, v array<double>"


def link_table(reps: DataFrame, cosine: float, recall: float, fill: int = FILL) -> DataFrame:
    """reps: (id long, many long, v array<double>: unit vectors, different ones of one length).
    Returns (a, b, n): rows with b are links of a forest, rows with n add up to a's linked copies.

    Cells lie together by row of the grid. A vector is sent once to each row in which it visits
    cells (not once for each cell), and compared there with the members of those cells."""
    spark, n = reps.sparkSession, reps.count()
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / max(n, 1))) + 1)
    sample = reps.where(chance).select("v").toArrow()
    sample = sample if len(sample) else reps.select("v").limit(64).toArrow()
    if not len(sample):
        return spark.createDataFrame([], "a long, b long, n long")
    made = MultiIndex(np.array(sample["v"].combine_chunks().flatten()).reshape(len(sample), -1), max(1, min(MOST, round(sqrt(n / fill)))))
    # Twice what the asked vectors' links, or made ones, need.
    made.visited = 2 * needed(reps, made, cosine, recall)
    index = spark.sparkContext.broadcast(made)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = index.value.width
        for batch in batches:
            for s in range(0, len(batch), 1024):
                ids, many, v = batch.slice(s, 1024).columns
                x = np.array(v.flatten()).reshape(len(ids), -1)
                own, cells = index.value.visits(x)
                cells.sort(axis=1)
                # A run of cells in one row of the grid is one copy; each vector is a member of its own cell's row besides.
                row = cells // width
                begins = np.concatenate([np.ones((len(x), 1), bool), row[:, 1:] != row[:, :-1]], axis=1)
                who, at = np.nonzero(begins)
                offsets = np.append(np.flatnonzero(begins.ravel()), cells.size)
                asks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells.ravel()))
                columns = [pa.array(row[who, at], pa.int32()), pa.array(np.zeros(len(who), bool)), ids.take(pa.array(who)), many.take(pa.array(who)), pa.array(own[who]), asks, v.take(pa.array(who))]
                names = ["row", "member", "id", "many", "own", "cells", "v"]
                yield pa.record_batch(columns, names)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield pa.record_batch([pa.array(own // width, pa.int32()), pa.array(np.ones(len(x), bool)), ids, many, pa.array(own), lists, v], names)

    routed = save(reps.select("id", "many", "v").mapInArrow(route, ROUTED), "imi-routed", "zstd")
    # Members and those who ask in a row of the grid, in blocks; a task meets one block of each. A row for each row of the grid.
    sizes = routed.groupBy("row").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q"))
    sizes = sizes.select("row", F.ceil(F.greatest("m", F.lit(1)) / MEMBERS).cast("int").alias("parts"), F.ceil(F.greatest("q", F.lit(1)) / ASKS).cast("int").alias("turns"))
    each = routed.join(F.broadcast(sizes), "row")  # MOST rows at most
    hashed = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    part = F.when(F.col("member"), F.array(hashed(F.col("parts")))).otherwise(every("parts"))
    by = F.when(F.col("member"), every("turns")).otherwise(F.array(hashed(F.col("turns"))))
    each = each.withColumn("part", F.explode(part)).withColumn("by", F.explode(by))
    names = ["row", "part", "by", "member", "id", "many", "own", "cells", "v"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, whole = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            row, part, by, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (by[1:] != by[:-1]) | (member[1:] != member[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(row)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if key != (row[s], part[s], by[s]):
                    key, members, whole = (row[s], part[s], by[s]), [], None
                if member[s]:
                    members.append(Rows.of(batch.slice(s, e - s)))
                elif members:
                    whole = whole or Rows.joined(members)
                    yield _met(Rows.of(batch.slice(s, e - s)), whole, cosine)

    # A block's members come first; those who ask stream past them.
    keys = ["row", "part", "by"]
    dealt = each.select(*names).repartition(*keys).sortWithinPartitions(*keys, F.col("member").desc())
    return save(dealt.mapInArrow(verify, "a long, b long, n long"), "imi-links")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999) -> DataFrame:
    """vectors: vec_id, embedding array<float or double>; further columns don't matter. Returns
    vec_id, n_links (other vectors with that cosine or more), component_id (smallest vec_id
    reachable), kept (vec_id = component_id) for each row.

    Equal vectors are linked, whatever their length, and searched for once. Vectors are compared
    with others of their length: with those of the cells nearest to them, twice as many as give
    the recall as measured by brute force between some vectors and all; a pair is found if either
    side visits the other's cell. A vector that is null, empty, zero, or holds null or non-finite
    components links with nothing: n_links 0, and itself as component. Repeated rows are vectors of
    their own. A row without vec_id is a vector like any other, but gives no component its name;
    a component without any vec_id has none, and its rows are kept."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
    largest = F.aggregate("v", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & (largest > 0), F.lit(False))
    units = rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    # Squares of very large or small components leave the range of doubles; those are scaled first.
    scale = F.when(square("v").between(1e-200, 1e200), 1.0).otherwise(largest)
    scaled = units.select("v", "first", "many", F.transform("v", lambda x: x / scale).alias("u"))
    unit = F.transform("u", lambda x: x / F.sqrt(square("u")))
    # Numbered as it is written, so every later step reads the same numbers.
    units = save(scaled.select(F.monotonically_increasing_id().alias("id"), "v", "first", "many", unit.alias("u")), "imi-reps")
    lengths = [r["d"] for r in units.select(F.size("v").alias("d")).distinct().orderBy("d").toLocalIterator()]
    links = [link_table(units.where(F.size("v") == d).select("id", "many", F.col("u").alias("v")), cosine, recall) for d in lengths]
    links = reduce(DataFrame.unionByName, links, rows.sparkSession.createDataFrame([], "a long, b long, n long"))
    parts = components(links.where("b is not null").select("a", "b"))
    counts = links.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    reps = units.join(parts, F.col("id") == F.col("node"), "left").join(counts, F.col("id") == F.col("a"), "left")
    reps = reps.select("v", "first", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "id").alias("part"))
    smallest = reps.groupBy("part").agg(F.min("first").alias("c"))
    out = rows.where(usable).join(reps.join(smallest, "part").select("v", "n", "c"), "v").select("vec_id", "n", "c")
    out = out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c")))
    kept = F.col("vec_id").eqNullSafe(F.col("c"))
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), kept.alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings' links at cosine 0.9 and their components."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
