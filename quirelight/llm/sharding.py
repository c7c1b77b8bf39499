"""Sharding by a Feistel permutation over global row numbers. DataFrame functions only."""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.shared import ranked, save, table

PRIME = (1 << 31) - 1
ROUNDS = 6
PLACE = "__ql_place"


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """For each round two numbers below PRIME."""
    digest = hashlib.sha256(str(seed).encode()).digest() + hashlib.sha256(f"{seed}+".encode()).digest()
    each = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") % (PRIME - 1) + 1 for i in range(2 * rounds)]
    return list(zip(each[::2], each[1::2], strict=True))


def sides(n: int) -> tuple[int, int]:
    """a * b is the least product of about equal sides that holds n rows; under a + 1 places
    are left over."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def feistel(x: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    """One pass of the permutation of 0 .. a*b-1: :func:`_pass` for a single number."""
    left, right = divmod(x, b)
    for i, (k0, k1) in enumerate(keys):
        t = ((left if i % 2 else right) + k0) % PRIME
        f = (t * t % PRIME * k1 + t) % PRIME
        if i % 2:
            right = (right + f) % b
        else:
            left = (left + f) % a
    return left * b + right


def walk_length(n: int, keys: list[tuple[int, int]]) -> int:
    """Passes that the longest cycle walk from a row below n takes: one more than the longest
    run of places at n or above, of which there are fewer than a + 1, about the root of n."""
    a, b = sides(n)
    step = {x: feistel(x, a, b, keys) for x in range(n, a * b)}
    longest = 0
    for x in set(step) - set(step.values()):  # where a walk enters
        steps = 0
        while x in step:
            x, steps = step[x], steps + 1
        longest = max(longest, steps)
    return longest + 1


def shards(rows: DataFrame, order: list[str], n_shards: int, seed: int = 1) -> DataFrame:
    """Adds shard int and slot long to each row: the row's number in the order is permuted by a
    seeded Feistel network over 0 .. n-1 (walking on while a place lies beyond n); the place
    modulo n_shards is the shard, the quotient the slot. Shards differ by at most one row, slots
    have no gaps, and reruns agree. Equal rows may swap places; order should end in columns
    that split ties. Columns that are already named shard or slot are replaced. No rows give no rows."""
    numbered = ranked(rows, order, "shards", PLACE)
    n = rows.count()
    keys = round_keys(seed)
    out = numbered
    for i in range(walk_length(n, keys)):
        go = F.lit(True) if i == 0 else F.col(PLACE) >= n
        out = _pass(out, n, keys, go)
    shard, slot = F.pmod(PLACE, F.lit(n_shards)).cast("int"), F.expr(f"{PLACE} div {n_shards}").cast("long")
    return out.withColumn("shard", shard).withColumn("slot", slot).drop(PLACE)


def _pass(df: DataFrame, n: int, keys: list[tuple[int, int]], go: Column) -> DataFrame:
    """The place moved by one pass where go holds. Each round binds its halves in a lambda, so that
    the expression grows with the rounds and does not double."""
    a, b = sides(n)
    sql = f"named_struct('l', {PLACE} div {b}L, 'r', {PLACE} % {b}L)"
    for i, (k0, k1) in enumerate(keys):
        side = "l" if i % 2 else "r"
        t = f"((s.{side} + {k0}) % {PRIME})"
        f = f"((({t} * {t}) % {PRIME} * {k1} + {t}) % {PRIME})"
        moved = f"'l', s.l, 'r', (s.r + {f}) % {b}" if i % 2 else f"'l', (s.l + {f}) % {a}, 'r', s.r"
        sql = f"element_at(transform(array({sql}), s -> named_struct({moved})), 1)"
    sql = f"element_at(transform(array({sql}), s -> s.l * {b} + s.r), 1)"
    return df.withColumn(PLACE, F.when(go, F.expr(sql)).otherwise(F.col(PLACE)).cast("long"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shards(save(rows, "shard-rows"), ["doc_id", "size", "text_crc32"], 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _pass_sql(source: str, place: str) -> str:
    """One pass over source's place, as nested selects: a level for each round."""
    out = f"SELECT doc_id, size, crc, a, b, n, {place} // b AS l, {place} % b AS r FROM {source}"
    for i, (k0, k1) in enumerate(round_keys(1)):
        t = f"(({'l' if i % 2 else 'r'} + {k0}) % {PRIME})"
        f = f"((({t} * {t}) % {PRIME} * {k1} + {t}) % {PRIME})"
        moved = f"l, (r + {f}) % b AS r" if i % 2 else f"(l + {f}) % a AS l, r"
        out = f"SELECT doc_id, size, crc, a, b, n, {moved} FROM ({out})"
    return f"SELECT doc_id, size, crc, a, b, n, l * b + r AS place FROM ({out})"


#: CRC-32 by its table, which is made by its rule.
OP4_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END)) AS t),
digits AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM digits),
sized AS (
  SELECT doc_id, len(b) + 8 AS size,
    xor({0xFFFFFFFF}, list_reduce(list_prepend({0xFFFFFFFF}, b), lambda c, x: xor(c >> 8, crc_table.t[(xor(c, x) & 255) + 1]))) AS crc
  FROM bytes, crc_table),
counted AS (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM documents),
ranked AS (
  SELECT doc_id, size, crc, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY doc_id, size, crc) - 1 AS number FROM sized, counted),
walk AS ({_pass_sql("ranked", "number")} UNION ALL {_pass_sql("(SELECT * FROM walk WHERE place >= n)", "place")})
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (place % 24)::INT AS shard, (place // 24)::BIGINT AS slot,
  NULL::INT AS grown_shard
FROM walk WHERE place < n
"""
