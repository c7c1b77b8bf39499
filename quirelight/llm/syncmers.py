"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.llm.shared import save, table, text_of

#: Bytes of an inner substring, and how many of them a k-mer has.
INNER, SPAN = 8, 33
K = INNER + SPAN - 1
#: Shifts of two anchors next to each other that differ by no more than this go on alike.
SLACK = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, byte positions) of the closed syncmers: k-mers of K bytes whose smallest
    inner substring (by hash) is the first or the last. Whether a k-mer is one depends on its
    own bytes alone. A text in which none is one, as any under K bytes, is one anchor; an empty
    text has none."""
    n = len(data)
    whole = np.array([int.from_bytes(hashlib.sha256(data).digest()[:4], "big")] if n else [], np.uint32), np.zeros(min(n, 1), np.int64)
    if n < K:
        return whole
    inner = _mixed(np.ndarray(n - INNER + 1, "<u8", data, 0, (1,)))
    rank = (inner >> np.uint64(32)).astype(np.uint32)
    low, width = rank, 1
    while width < SPAN:  # the minimum of ever longer runs
        step = min(width, SPAN - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    m = len(low)
    at = np.flatnonzero((low == rank[:m]) | (low == rank[SPAN - 1 : SPAN - 1 + m]))
    if not len(at):
        return whole
    code = inner[at]
    for shift in range(INNER, SPAN, INNER):
        code = _mixed(code + inner[at + shift])
    return (code >> np.uint64(32)).astype(np.uint32), at


def fingerprint(data: bytes) -> np.ndarray:
    """Rows (hash, position) of all anchors, by position."""
    return np.column_stack(syncmers(data)).astype(">u4")


def _numbered(anchors: np.ndarray) -> np.ndarray:
    """A key for each anchor: its hash, and how many of that hash stand before it."""
    order = np.argsort(anchors[:, 0], kind="stable")
    hashes = anchors[order, 0].astype(np.uint64)
    first = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    nth = np.arange(len(hashes)) - np.maximum.accumulate(np.where(first, np.arange(len(hashes)), 0))
    out = np.empty(len(hashes), np.uint64)
    out[order] = hashes << np.uint64(32) | nth.astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of the two fingerprints' anchors that match in content and place.

    The nth anchor of a hash meets the nth of the same hash. Going through a, a meeting counts if
    the one before or behind it has the same shift of position, up to SLACK: text that was moved,
    or that stands between insertions, goes on to match, and a stray hash doesn't. Where a
    fingerprint has one anchor, meeting it is enough. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(_numbered(a), _numbered(b), assume_unique=True, return_indices=True)
    order = np.argsort(i)
    shift = a[i[order], 1].astype(np.int64) - b[j[order], 1].astype(np.int64)
    if min(len(a), len(b)) > 1 and len(shift):
        goes_on = np.abs(np.diff(shift)) <= SLACK
        shift = shift[np.append(goes_on, False) | np.append(False, goes_on)]
    return 2 * len(shift) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digest(anchors: np.ndarray) -> str:
    """32 hex digits that stand for a whole fingerprint; empty for none."""
    return hashlib.sha256(anchors.tobytes()).hexdigest()[:32] if len(anchors) else ""


def whole(anchors: np.ndarray) -> str:
    """All anchors as hex digits: hash and position in turn, eight digits each."""
    return anchors.tobytes().hex()


Shown = Callable[[np.ndarray], str]


def _compared(doc_id: int, text: str, following: str, shown: Shown) -> tuple:
    other = edited(text, following)
    own, new, nxt = (fingerprint(t.encode()) for t in (text, other, following))
    sha = hashlib.sha256(other.encode()).hexdigest()
    return doc_id, len(text), sha, shown(own), shown(new), likeness(own, new), likeness(own, nxt)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def neighbours(docs: DataFrame, shown: Shown = whole) -> DataFrame:
    """docs with doc_id and text. Returns NAMES for each row: the text's fingerprint, that of
    its edited text (see :func:`edited`) and its likeness to both that one and the next
    document's, in ascending order of doc_id (after the last: the first; ties by a hash of the
    text; null ids first). Null texts are empty. Repeated rows are each other's next; a single row
    is its own. shown makes a fingerprint's column, of all its anchors.

    Whole texts are dealt once, by range of doc_id; within a range a row meets the next one. The
    first and last rows of the ranges, two for each, are joined afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["part", "head", "text", *NAMES], [pa.int32(), pa.bool_(), pa.string(), *TYPES]
        part, last, none = TaskContext.get().partitionId(), None, (None,) * (len(NAMES) - 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None:
                    out.append((part, True, text, doc_id, *none))
                else:
                    out.append((part, None, None, *_compared(*last, text, shown)))
                last = doc_id, text
            yield _batch(out, names, types)
        if last is not None:
            yield _batch([(part, False, last[1], last[0], *none)], names, types)

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    done = save(dealt.mapInArrow(run, f"part int, head boolean, text string, {SCHEMA}"), "syncmers")
    ends = done.where("head is not null")
    heads = ends.where("head").select("part", F.col("text").alias("following"))
    # A row for each range that has rows: as many as partitions.
    parts = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.first("part").over(Window.orderBy("part")).alias("first"))
    parts = parts.select("part", F.coalesce("next", "first").alias("next"))
    tails = ends.where("not head").select("part", "doc_id", "text").join(F.broadcast(parts), "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_compared(*r, shown) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], NAMES, TYPES)

    return done.where("head is null").select(*NAMES).unionByName(pairs.mapInArrow(meet, SCHEMA))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, as digests of all their anchors, and likenesses."""
    return neighbours(table(spark, sf_dir, "documents"), digest)
