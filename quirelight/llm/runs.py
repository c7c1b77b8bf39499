"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelight.llm.shared import WORD, table, text_of

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Periods tried at one middle by comparing words; more are looked up in Z functions.
FEW = 32
#: Rows and words of a batch that goes back to Spark.
ROWS, WORDS = 512, 1 << 20


def overlap(least: int) -> int:
    """Words that any run shares with itself, moved by its period q, at least: its length, max(least,
    2q), without q. The fewest are left by the q nearest to half of least."""
    return max(1, least // 2)


def _mixed(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k-gram that begins at each place."""
    code = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        code = (code ^ ids[i : i + len(code)]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def segments(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Longest stretches [start, end) of words that lie in k-grams which occur twice or more. A run's
    words all do: k-grams of its first length - q words occur again q words later, and those two
    stretches cover it. Two k-grams of one hash at most keep words for nothing."""
    code = _mixed(ids, k)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    starts = np.flatnonzero(np.isin(code, twice))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    kept = np.diff(np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(kept == 1).tolist(), np.flatnonzero(kept == -1).tolist(), strict=True))


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many words two stretches share from their start on; compared in ever longer pieces."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        apart = x[at : min(n, at + step)] != y[at : min(n, at + step)]
        if apart.any():
            return at + int(apart.argmax())
        at, step = at + step, step * 4
    return n


def _z(x: list[int]) -> list[int]:
    """For each place, how many words from there on are those from the start on."""
    n, z, left, right = len(x), [0] * len(x), 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(ids: np.ndarray, start: int, mid: int, end: int, periods: np.ndarray, ahead: bool, least: int, found: set) -> None:
    """Runs within [start, end) around mid, of the periods given in ascending order: those with a whole
    period behind mid (ahead), or before it. One that could go on beyond the block is left to the
    block in which it can't."""
    one = 1 if ahead else -1
    lookup = None
    if len(periods) > FEW:
        left, right = ids[start:mid][::-1].tolist(), ids[mid:end].tolist()
        if ahead:  # words from mid on against themselves; words before mid + p, backwards, against those before mid
            lookup = _z(right), _z([*left, -1, *ids[start:end][::-1].tolist()])
        else:
            lookup = _z([*right, -1, *ids[start:end].tolist()]), _z(left)
    while len(periods):
        p = int(periods[0])
        periods = periods[1:]
        a, b = (mid, mid + p) if ahead else (mid - p, mid)
        if b > end or a < start:
            continue
        if lookup is None:
            on, back = _same(ids[a:end], ids[b:end]), _same(ids[start:a][::-1], ids[start:b][::-1])
        elif ahead:
            on, back = lookup[0][p] if b < end else 0, min(lookup[1][mid - start + 1 + end - b], mid - start)
        else:
            on, back = min(lookup[0][end - mid + 1 + a - start], end - mid), lookup[1][p] if a > start else 0
        first, last = a - back, b + on
        if on + back < p or last - first < least:
            continue
        if not ((first == start > 0 and ids[first - 1] == ids[first - 1 + p]) or (last == end < len(ids) and ids[last] == ids[last - p])):
            found.add((first, last, p))
        # Multiples of the period, as far as they lie in the run, give the same run.
        inside = mid + one * periods
        periods = periods[(periods % p != 0) | (inside < first) | (inside > last)]


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period), in that order, of all runs of a sequence of word numbers: stretches of
    smallest period q, at least max(least, 2q) long, that no neighbour extends with that period.

    Main and Lorentz: a run lies in some block of a halving of the sequence and goes over its middle.
    At each middle m only periods p are tried for which the few words at m, or those before it, stand
    again p further on (or back), as the overlap of a run around m has half of its words there."""
    ids, n = np.asarray(ids, np.int64), len(ids)
    if n < least:
        return []
    few = max(1, (overlap(least) + 1) // 2)
    # Numbers of few-grams; those that would go beyond either end are like no other.
    size = 1 << max(1, (n - 1).bit_length())
    _, gram = np.unique(_mixed(ids.astype(np.uint64), few), return_inverse=True)
    pad = np.full(few + 2 * size, -1, np.int64)
    pad[few : few + len(gram)] = gram
    found: set[tuple[int, int, int]] = set()
    block = 1 << (least - 1).bit_length()
    while block <= size:
        half = block // 2
        mids = np.arange(half, n, block)
        far = pad[few : few + len(mids) * block].reshape(-1, block)  # grams from a block's start on
        near = pad[: len(mids) * block].reshape(-1, block)  # those that end before a place
        for ahead in (True, False):
            if ahead:
                hit = ((far[:, half:] == far[:, half : half + 1]) & (far[:, half : half + 1] >= 0)) | ((near[:, half:] == near[:, half : half + 1]) & (near[:, half : half + 1] >= 0))
                last = np.zeros((len(mids), 1), bool)  # the period half: the block's end
                at = np.minimum((np.arange(len(mids)) + 1) * block, len(pad) - 1)
                last[:, 0] = (pad[at] == near[:, half]) & (pad[at] >= 0)
                hit = np.concatenate([hit[:, 1:], last], axis=1)  # column p - 1
            else:
                hit = ((far[:, :half] == far[:, half : half + 1]) & (far[:, half : half + 1] >= 0)) | ((near[:, :half] == near[:, half : half + 1]) & (near[:, half : half + 1] >= 0))
                hit = hit[:, ::-1]
            for j in np.flatnonzero(hit.any(axis=1)).tolist():
                periods = np.flatnonzero(hit[j]) + 1
                _across(ids, j * block, int(mids[j]), min(n, (j + 1) * block), periods, ahead, least, found)
        block *= 2
    smallest: dict[tuple[int, int], int] = {}
    for first, last, p in found:
        smallest[first, last] = min(p, smallest.get((first, last), p))
    return sorted((first, last - first, p) for (first, last), p in smallest.items() if last - first >= max(least, 2 * p))


def runs_in_words(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """:func:`runs_of` the segments that survive masking, with places in the whole text."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    out = []
    for first, last in segments(ids, overlap(least)):
        out += [(first + s, n, p) for s, n, p in runs_of(ids[first:last], least)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        edge[s + p] += 1
        edge[s + n] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


ADDED = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """docs with the columns runs (start, length, period of each periodic run of words, in that order)
    and collapsed (the words that no run contains after its first period, joined by one space) added.

    Words are the text between ASCII white space. Null and empty texts have no runs, and collapse to
    an empty text. Each row is looked at by itself, whole, in the task that reads it: nothing is
    shuffled, repeated rows and ids don't matter, an empty table gives no rows. Columns of docs named
    runs or collapsed are replaced; all others stay."""
    given = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(*given, text_of(text).cast("binary").alias("__ql_words"))
    schema = StructType([*docs.select(*given).schema, *StructType.fromDDL(ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*given, "runs", "collapsed"]
        for batch in batches:
            texts, done, first, size = batch.column(len(given)), [], 0, 0
            for i in range(len(batch)):
                words = texts[i].as_py().split()  # bytes: at ASCII white space
                runs = runs_in_words(words, least)
                done.append((runs, b" ".join(collapsed(words, runs) if runs else words).decode()))
                size += len(words)
                if i + 1 == len(batch) or i + 1 - first == ROWS or size >= WORDS:
                    kept = [batch.column(c).slice(first, i + 1 - first) for c in range(len(given))]
                    found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in done]
                    yield pa.record_batch([*kept, pa.array(found, _RUNS), pa.array([t for _, t in done], pa.string())], names)
                    done, first, size = [], i + 1, 0

    return rows.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """text; where the CRC-32 of the decimal doc_id is divisible by 10, its words from one on repeat
    with a period (both made of that checksum). A null doc_id leaves the text as it is."""
    checksum = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(checksum / 10).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

    # The words are bound once, by a transform of an array of one.
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when(checksum % 10 == 0, made).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' periodic runs, some of the texts made periodic (:func:`looped`)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), text_of()).alias("text"))
    out = periodic_runs(docs)
    # The longest; of equal ones the first, then the one of the smallest period.
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(1))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
