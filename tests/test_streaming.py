"""Streams with kept state, late rows, and runs that are killed."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quirelight.operators import jobs, translate
from quirelight.operators.translate import UpperCase
from quirelight.streaming import progress, translation

START = datetime.datetime(2024, 1, 1)
LOG = "user_id long, ts timestamp, event_id long, bad boolean"


def opened(spark, folder, files, delay):
    """files: lists of (user, second, event, bad), in the order in which they come."""
    for i, rows in enumerate(files):
        made = spark.createDataFrame([(u, START + datetime.timedelta(seconds=s), e, b) for u, s, e, b in rows], LOG)
        made.coalesce(1).write.mode("append").parquet(folder)
        os.utime(next(p for p in sorted(os.scandir(folder), key=lambda p: -p.stat().st_mtime) if p.name.endswith(".parquet")).path, (1_700_000_000 + i, 1_700_000_000 + i))
    with progress.state_in_rocksdb(spark):
        out = progress.drained(progress.breaker(progress.events(spark, folder, 1), delay), "append", "b")
    return sorted((r["user_id"], r["event_id"]) for r in out.collect())


def test_a_late_good_call_keeps_the_breaker_shut(spark, tmp_path):
    late = [[(1, 1, 1, True), (1, 2, 2, True)], [(1, 4, 4, True), (2, 4, 9, True)], [(1, 3, 3, False), (2, 5, 10, True), (2, 6, 11, True)], [(-1, 1000, 0, False)]]
    assert opened(spark, str(tmp_path / "late"), late, "10 seconds") == [(2, 11)]
    # A call that comes in time but out of order completes a streak that was cut by arrival.
    bad = [[(1, 1, 1, True), (1, 3, 3, True), (1, 4, 4, False)], [(1, 2, 2, True)], [(1, 20, 5, True)], [(1, 21, 6, True), (1, 22, 7, True)], [(-1, 1000, 0, False)]]
    assert opened(spark, str(tmp_path / "bad"), bad, "10 seconds") == [(1, 3), (1, 7)]


def test_the_stream_gives_what_the_log_gives(spark, sf):
    bad = (F.col("event_type") == "error") | (F.col("value") < 20)
    log = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", bad.alias("bad"))
    want = {r["user_id"]: r["event_id"] for r in jobs.broken(log, ["user_id"], ["ts", "event_id"]).collect()}
    got = {r["user_id"]: r["event_id"] for r in progress.drained_breaker(spark, sf).collect()}
    assert got == want and len(want) > 10


class Refusing(UpperCase):
    def translate(self, payload):
        if any("no" in b["text"] for b in payload["to_translate"]):
            raise ValueError("refused")
        said = "|".join(c["translated"] or "-" for c in payload["carry_over"])
        return {"translations": [{"id": b["id"], "text": f"{b['text'].upper()}<{said}>"} for b in payload["to_translate"]]}


def test_a_killed_run_loses_no_chunk_and_has_none_twice(spark, tmp_path):
    rows = [("k", f"c{c}", i, [(f"c{c}b{i}", f"no {i}" if (c, i) == (1, 1) else f"t{c}{i}")]) for c in range(3) for i in range(4)]
    chunks = spark.createDataFrame(rows, "book_id string, chapter_id string, chunk int, blocks array<struct<id:string,text:string>>")
    feed = translation.Feed(spark, str(tmp_path / "feed"))
    feed.offer(chunks, per_file=2)
    seen, sizes = [], []

    def kill(number):
        seen.append(number)
        sizes.append(feed.results().where(F.col("batch") == number).count())
        if seen.count(number) == 1 and number in (1, 3):
            raise translation.Killed("here")

    for _ in range(2):
        with pytest.raises(Exception, match="Killed"):
            feed.run(Refusing, on_batch=kill)
    feed.run(Refusing, on_batch=kill)
    assert seen.count(1) == seen.count(3) == 2 and max(sizes) <= 2  # the rate limit: one file of two chunks
    out = feed.results().collect()
    assert sorted((r["chapter_id"], r["chunk"]) for r in out) == [(f"c{c}", i) for c in range(3) for i in range(4)]
    text = {k: v for r in out for k, v in (r["translations"] or {}).items()}
    assert text["c0b1"] == "T01<T00<>>" and text["c1b2"] == "T12<->" and "c1b1" not in text
    feed.run(Refusing, on_batch=kill)
    assert feed.results().count() == 12 and translate is not None


def test_a_drained_feed_has_few_batches_whatever_its_size(spark, monkeypatch):
    seen, plain = [], translation.Feed.run

    def run(self, on_batch, **more):
        plain(self, on_batch=lambda n: (seen.append(n), on_batch(n)), **more)

    monkeypatch.setattr(translation.Feed, "run", run)
    out = translation.drained_translation(spark, "/root/testdata/sf0.1").collect()
    assert len(out) == 958 and all((r["n_translated"], r["n_twice"]) == (r["n_blocks"], 0) for r in out)
    assert 2 < max(seen) < translation.BATCHES and seen.count(0) == seen.count(2) == 2
