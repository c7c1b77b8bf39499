"""Language-model scoring with a log-frequency Bloom filter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.shared import save, table, text_of

#: Tokens that a worker gathers before it writes a block of documents.
BLOCK_TOKENS = 1_000_000
#: Tokens that are scored at once, and tokens for each shard of the n-grams' hashes.
SLICE_TOKENS, SHARD_TOKENS = 250_000, 3_000_000
#: Counts are kept as levels: level q stands for q up to EXACT, then for steps of STEP.
EXACT, STEP = 8, 1.25
#: Bits of the filter for each level of each n-gram, probes for each, bits of an n-gram's hash.
BITS_PER_ENTRY, PROBES, KEY_BITS = 20, 10, 56
#: Weight of the bigram estimate: of steps of 0.1 the one that gives held-out text the most on sf0.1.
WEIGHT = 0.4
END = b"\x00</s>"  # no word: words hold no byte 0 next to a space, and it is hashed with its own seed

#: The least count of each level; a count beyond the last one (some 10**13) is that level's.
LEAST = np.unique(np.concatenate([np.arange(1, EXACT + 1), np.ceil(EXACT * STEP ** np.arange(1, 125))]).astype(np.int64))
#: What a level is read back as; 0 for none: of a wide level the middle.
READ = np.concatenate([[0.0], np.where(LEAST < EXACT, LEAST, np.sqrt(LEAST * (np.append(LEAST[1:], LEAST[-1] * STEP) - 1.0)))])


def level_of(counts: np.ndarray) -> np.ndarray:
    """The level that holds each count; 0 for none."""
    return np.searchsorted(LEAST, counts, side="right")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """KEY_BITS-bit hashes of word pairs from the words' 64-bit hashes."""
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + _mix(b)) >> np.uint64(64 - KEY_BITS)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _sorted_pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, as differences."""
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _sorted_unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
BLOCKS = "block long, n long, ids array<long>, lengths binary, tokens binary, hashes binary"
PARTS = "block long, shard int, words binary, word_counts binary, pairs binary, pair_counts binary"
COUNTS = "block long, shard int, counts binary, word_levels binary, pair_levels binary, sums array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _out(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def encode(docs: DataFrame) -> DataFrame:
    """BLOCKS: documents in blocks of about BLOCK_TOKENS tokens: their ids, lengths, and tokens as
    places in the block's vocabulary, whose hashes are sorted."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    end_hash = xxhash.xxh64_intdigest(END, 1)

    def block(name: int, ids: list[int | None], lengths: list[int], flat: list[np.ndarray], vocabulary: dict[bytes, int]) -> tuple:
        hashes = np.fromiter((*map(digest, vocabulary), end_hash), np.uint64, len(vocabulary) + 1)
        order = np.argsort(hashes)
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        tokens = np.concatenate(flat)
        tokens[np.cumsum(lengths) - 1] = len(vocabulary)
        return name, len(tokens), ids, _pack(np.array(lengths, "<u4")), _pack(rank[tokens]), _sorted_pack(hashes[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, flat, vocabulary, size = [], [], [], {}, 0
        place, name = vocabulary.setdefault, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                words = t.as_py().lower().split()
                own = np.empty(len(words) + 1, "<u4")
                own[:-1] = [place(w, len(vocabulary)) for w in words]
                ids.append(i.as_py())
                lengths.append(len(own))
                flat.append(own)
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield _out([block(name, ids, lengths, flat, vocabulary)], BLOCKS)
                    ids, lengths, flat, vocabulary, size = [], [], [], {}, 0
                    place, name = vocabulary.setdefault, name + 1
        if ids:
            yield _out([block(name, ids, lengths, flat, vocabulary)], BLOCKS)

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary")).mapInArrow(run, BLOCKS)


def _trains(ids: list[int | None], folds: int) -> np.ndarray:
    """Training documents: those whose crc32(doc_id as text) modulo folds is not 0. A null doc_id
    has no text, whose crc32 is 0."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds != 0 for i in ids], bool)


def _pairs(lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of tokens that have one before them in their document, hashes of the two)."""
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    return at, pair_hash(hashes[tokens[at - 1]], hashes[tokens[at]])


def _edges(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard begins, and the end, in sorted keys: shards are equal ranges of hashes."""
    width = (1 << bits) // shards + 1
    return np.append(np.searchsorted(keys, np.array([i * width for i in range(shards)], np.uint64)), len(keys))


def parts(blocks: DataFrame, shards: int, folds: int) -> DataFrame:
    """PARTS: each block's different words and bigrams by shards of their hashes, with their counts in
    its training documents. There is no row without n-grams, so rows are no more than n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, tokens, words = _unpack(row["lengths"], "<u4").astype(np.int64), _unpack(row["tokens"], "<u4"), _sorted_unpack(row["hashes"])
                trained = np.repeat(_trains(row["ids"], folds), lengths)
                word_counts = np.bincount(tokens[trained], minlength=len(words)).astype("<u4")
                at, keys = _pairs(lengths, tokens, words)
                pairs, inverse = np.unique(keys, return_inverse=True)
                pair_counts = np.bincount(inverse, trained[at], len(pairs)).astype("<u4")
                w, p, out = _edges(words, 64, shards), _edges(pairs, KEY_BITS, shards), []
                for s in range(shards):
                    own, two = slice(w[s], w[s + 1]), slice(p[s], p[s + 1])
                    if own.start < own.stop or two.start < two.stop:
                        out.append((row["block"], s, _sorted_pack(words[own]), _pack(word_counts[own]), _sorted_pack(pairs[two]), _pack(pair_counts[two])))
                yield _out(out, PARTS)

    return blocks.mapInArrow(run, PARTS)


def _by_key(rows: DataFrame, keys: list[str], each, schema: str) -> DataFrame:
    """each(list of rows) for the rows of each first key, which lie together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in range(len(batch)):
                row = {n: c[r].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if key is not None and key != row[keys[0]]:
                    yield from each(held)
                    held = []
                key = row[keys[0]]
                held.append(row)
        if held:
            yield from each(held)

    return rows.repartition(keys[0]).sortWithinPartitions(*keys).mapInArrow(run, schema)


class LogFrequencyFilter:
    """A Bloom filter of n-grams with quantised counts. One of level q is entered as levels 1 to q;
    the level read back is the last before a miss. It is never too low; it is too high with the
    small chance of a Bloom filter's false positive, which is the same at every size: bits grow
    with the entries."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        self.top = int(levels.max(initial=0))
        self.bits = max(64, int(levels.sum()) * BITS_PER_ENTRY)
        self.data = np.zeros((self.bits + 7) // 8, np.uint8)
        for level in range(1, self.top + 1):
            for at in self._probes(keys[levels >= level], level):
                np.bitwise_or.at(self.data, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def _probes(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = _mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level))
        step = _mix(h + np.uint64(0x165667B19E3779F9)) | np.uint64(1)
        for i in range(PROBES):
            yield (((h + np.uint64(i) * step) >> np.uint64(8)) % np.uint64(self.bits)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram's count, 0 where it is unknown."""
        out, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, self.top + 1):
            here = np.ones(len(left), bool)
            for at in self._probes(keys[left], level):
                here &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[here]
            if not len(left):
                break
            out[left] = level
        return out


#: Words are entered as pairs with this; no word has the hash.
ALONE = np.array([0x5851F42D4C957F2D], np.uint64)


def counted(rows: DataFrame) -> DataFrame:
    """COUNTS: for each row of PARTS the corpus's exact counts of its words, and the levels that its
    shard's filter gives for its words and bigrams; the shard's training tokens and different
    words. A shard's filter is made and probed where its n-grams are, so it may grow with the
    input, and nothing is sent around but what a block asks for."""

    def each(held: list[dict]) -> Iterator[pa.RecordBatch]:
        def merged(keys: str, counts: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
            own = [_sorted_unpack(r[keys]) for r in held]
            every, at = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(at, np.concatenate([_unpack(r[counts], "<u4") for r in held]), len(every))
            return np.cumsum([len(k) for k in own])[:-1].tolist(), every, at, total.astype(np.int64)

        w_ends, words, w_at, n = merged("words", "word_counts")
        p_ends, pairs, p_at, m = merged("pairs", "pair_counts")
        words = pair_hash(words, ALONE)
        made = LogFrequencyFilter(np.concatenate([words[n > 0], pairs[m > 0]]), level_of(np.concatenate([n[n > 0], m[m > 0]])))
        # What blocks ask for in common is probed once.
        exact = np.split(n.astype("<u8")[w_at], w_ends)
        levels = np.split(made.levels(words)[w_at], w_ends), np.split(made.levels(pairs)[p_at], p_ends)
        sums = [int(n.sum()), int((n > 0).sum())]
        for r, c, w, p in zip(held, exact, *levels, strict=True):
            yield _out([(r["block"], r["shard"], _pack(c), _pack(w), _pack(p), sums)], COUNTS)

    return _by_key(rows, ["shard", "block"], each, COUNTS)


def scored(docs: DataFrame, folds: int = 10, weight: float = WEIGHT) -> DataFrame:
    """docs with doc_id and text. Returns SCORES for each row.

    Counts come from the training documents of all docs, none left out. base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over exact counts c of words. score reads quantised
    counts of words and bigrams from a log-frequency Bloom filter by repeated probes: it sums
    log10((1 - weight) * u + weight * b), where u is the same share with the quantised count, and b
    the bigram's quantised count over its first word's (1 at most); a document's first token, and one behind
    a word that the filter doesn't know, has u alone. A null or empty text is its end token. A null
    doc_id stays null and is held out. Repeated rows are documents of their own; an empty table
    gives no rows.

    The filter is cut by ranges of the n-grams' hashes into shards of about SHARD_TOKENS training
    tokens: as many as the input calls for, each as large at every size."""
    blocks = save(encode(docs), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-tokens // SHARD_TOKENS))
    counts = save(counted(parts(blocks, shards, folds)), "lm-counts")
    each_shard = counts.groupBy("shard").agg(F.first("sums").alias("s")).select(F.col("s")[0].alias("n"), F.col("s")[1].alias("v"))
    n, v = (x or 0 for x in each_shard.agg(F.sum("n"), F.sum("v")).first())
    names = [x.split()[0] for x in SCORES.split(", ")]
    total = n + 0.1 * (v + 1)

    def each(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own, *held = rows
        known, word_level, pair_level = (np.concatenate([_unpack(r[c], d) for r in held]) for c, d in (("counts", "<u8"), ("word_levels", "<u1"), ("pair_levels", "<u1")))
        lengths, tokens, hashes = _unpack(own["lengths"], "<u4").astype(np.int64), _unpack(own["tokens"], "<u4"), _sorted_unpack(own["hashes"])
        at, keys = _pairs(lengths, tokens, hashes)
        level = np.zeros(len(tokens), np.uint8)  # of the bigram that ends here
        level[at] = pair_level[np.unique(keys, return_inverse=True)[1]]
        inner = np.zeros(len(tokens), bool)
        inner[at] = True
        del at, keys
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        seen, base, score = np.zeros(len(lengths), np.int64), np.zeros(len(lengths)), np.zeros(len(lengths))
        for s in range(0, len(tokens), SLICE_TOKENS):
            q = slice(s, s + SLICE_TOKENS)
            here, c = doc[q] - doc[s], known[tokens[q]]
            u = (READ[word_level[tokens[q]]] + 0.1) / total
            before = READ[word_level[tokens[np.maximum(np.arange(s, s + len(c)) - 1, 0)]]] * inner[q]
            b = np.minimum(READ[level[q]] / np.maximum(before, 1.0), 1.0) * (c > 0)
            p = np.where(before > 0, (1 - weight) * u + weight * b, u)
            to = slice(doc[s], doc[s] + here[-1] + 1)
            seen[to] += np.bincount(here, c > 0).astype(np.int64)
            base[to] += np.bincount(here, np.log10((c + 0.1) / total))
            score[to] += np.bincount(here, np.log10(p))
        columns = [pa.array(own["ids"], pa.int64()), ~_trains(own["ids"], folds), lengths, seen, np.full(len(lengths), n), base, score]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    none = {c: F.lit(None).cast("binary").alias(c) for c in ("lengths", "tokens", "hashes", "counts", "word_levels", "pair_levels")}
    whole = blocks.select("block", F.lit(-1).alias("shard"), "ids", "lengths", "tokens", "hashes", none["counts"], none["word_levels"], none["pair_levels"])
    asked = counts.select("block", "shard", F.lit(None).cast("array<long>").alias("ids"), none["lengths"], none["tokens"], none["hashes"], "counts", "word_levels", "pair_levels")
    return _by_key(whole.unionByName(asked), ["block", "shard"], each, SCORES)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores by the model of the training documents."""
    return scored(table(spark, sf_dir, "documents"))
