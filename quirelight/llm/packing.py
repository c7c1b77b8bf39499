"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.shared import ranked_in, save, table, text_of

SIZE = 1024
#: Distinct words whose ids a worker remembers.
REMEMBERED = 200_000


class Irregular(Exception):
    """A text whose words can't be encoded one by one."""


class Encoder:
    """Ids of the public byte-level BPE vocabulary, as tokenizers gives them, as little-endian
    unsigned 32-bit numbers.

    The vocabulary's pattern never joins a word with the space behind it, so a text with single
    spaces is the sum of its space-led words, whose ids are remembered. A text with other white
    space next to a space is encoded whole; one that holds the special token's string goes to
    the tokenizers library."""

    SPECIAL = "<|endoftext|>"

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None
        self.led: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Irregular
        ids = self._ids(" " + word)
        if len(self.led) < REMEMBERED:
            self.led[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if first and first[-1].isspace():
            return self._ids(text)
        led, word = self.led, self._word
        try:
            return self._ids(first) + b"".join([led[w] if w in led else word(w) for w in rest])
        except Irregular:
            return self._ids(text)


def public_encoder() -> Encoder:
    import public_tokenizers as P

    return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole, or full pieces behind a first one that
    takes the remainder."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, size: int = SIZE, encoder=public_encoder, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): each document's ids and then end, cut only if
    they are more than size. A null text counts as empty and is one piece, the end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + stop
                for i, (start, length) in enumerate(cuts(len(ids) // 4, size)):
                    for column, x in zip(rows, (doc_id, i, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids"]
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Minimum bin slack for one bin: the multiset of available lengths that fills room best.

    A bitset holds the sums that the lengths so far can reach; longer lengths come first, and of
    equal fills the one that spares the shorter lengths is taken."""
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for length in sorted((k for k, c in counts.items() if c and k <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Bins for counts pieces of each length: (pattern, how many bins have it). A bin takes the
    longest piece left and what fills it best beside; the same choice is repeated while there
    are pieces for it, so there are few patterns however many pieces."""
    left, out = {k: c for k, c in counts.items() if c}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = fullest(rest, size - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def placed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows: pieces with length (1 to size), doc_id and piece. Adds sequence_id and offset.

    The plan needs only how many pieces of each length there are: at most size rows for the
    driver. Pieces are numbered within their length, and stretches of numbers go to patterns, so
    the plan is a small table (patterns times lengths, whatever the input) that is joined on."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    taken: dict[int, int] = {}
    stretches, sequence = [], 0
    for pattern, times in plan(counts, size):
        offset = 0
        for length, many in sorted(pattern.items(), reverse=True):
            first = taken.get(length, 0)
            taken[length] = first + many * times
            stretches.append((length, first, taken[length], many, sequence, offset))
            offset += length * many
        sequence += times
    schema = "length long, first long, last long, many long, sequence long, at long"
    stretches = F.broadcast(rows.sparkSession.createDataFrame(stretches, schema))
    out = ranked_in(rows, ["length"], ["doc_id", "piece"], "pack").join(stretches, "length")
    nth = F.col("rank") - F.col("first")
    out = out.where((nth >= 0) & (F.col("rank") < F.col("last")))
    place = F.col("at") + F.pmod(nth, "many") * F.col("length")
    return out.withColumn("sequence_id", F.expr("sequence + (rank - first) div many")).withColumn("offset", place)


def pack(docs: DataFrame, derive: dict[str, Column] | None = None, size: int = SIZE, encoder=public_encoder) -> DataFrame:
    """docs with doc_id and text. Returns (doc_id, piece, start, length, ids or what derive
    makes of ids, sequence_id, offset): pieces in sequences of at most size tokens, as few as
    minimum bin slack finds.

    derive: columns over a piece's row (ids: binary, little-endian unsigned 32-bit), kept in
    place of ids, so that digests need no second tokenizing and no shuffle of ids. A null or empty
    text is one piece, the end token; repeated rows are packed as often as they come; an empty table gives no sequence."""
    kept = {"ids": F.col("ids")} if derive is None else derive
    row = "__ql_row"
    rows = pieces(docs, size, encoder).select("doc_id", "piece", "start", "length", *(c.alias(k) for k, c in kept.items()))
    # Numbered as they are written. Ids stay there while places are found, and are joined on once.
    # Half of their bytes are zeros, which zstd takes for over a third less than snappy does.
    rows = save(rows.withColumn(row, F.monotonically_increasing_id()), "pack-pieces", "zstd")
    wide = [f.name for f in rows.schema if f.name in kept and f.dataType.simpleString() == "binary"]
    out = placed(rows.drop(*wide), size)
    if wide:
        out = out.join(rows.select(row, *wide), row)
    return out.select("doc_id", "piece", "start", "length", *kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """packed with ids: (sequence_id, tokens binary), the pieces of each sequence in place."""
    each = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return each.select("sequence_id", joined.alias("tokens"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with a CRC-32 of their ids, and their places in sequences."""
    return pack(table(spark, sf_dir, "documents"), {"ids_crc32": F.crc32("ids")})
