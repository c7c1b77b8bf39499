"""Operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from quirelight.functions import languages as lang
from quirelight.functions import text as tx
from quirelight.operators import books, chapters, glossary, jobs, packages, validate
from quirelight.operators.translate import Retryable, UpperCase, base_url, chunked, reply_errors, run_chunks, to_do, with_retry
from quirelight.plans import all_queries


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    assert one(spark, tx.tokens, "", "a", "hello world", "你好世界", "ab你好", None) == [0, 1, 2, 2, 1, 0]


def test_lines_and_strip(spark):
    assert one(spark, tx.lines, "a\r\nb\x0bc d", "a\n", "", "\n\na") == [["a", "b", "c", "d"], ["a"], [], ["", "", "a"]]
    assert one(spark, tx.strip, "　 a\t\x85", "\x1fb ") == ["a", "b"]


def test_txt_headings(spark):
    yes = ["Chapter 1", "CHAPTER IV", "第3章 海", "第１２話", "12. Harbour", "3、港"]
    no = ["chapter iv", "Chapter1", "第三節", "plain words"]
    assert one(spark, tx.is_txt_heading, *yes, *no) == [True] * 6 + [False] * 4


def test_a_point_before_a_digit_is_no_txt_heading(spark):
    assert one(spark, tx.is_txt_heading, "56.187.231.175 is an address", "3.14 is pi", "12.Harbour", "12. 7 days", "3、7") == [False, False, True, True, True]


def test_latest_takes_the_first_of_equal_versions(spark):
    log = spark.createDataFrame([(1, 2, "b", 7), (1, 2, "a", 3), (1, 1, "c", 1), (2, 5, "d", 9)], "k int, v int, x string, at int").repartition(4)
    assert rows(jobs.latest(log, ["k"], "v", ["at"]), "k", "x") == [(1, "a"), (2, "d")]


def test_latest_wins_by_the_order_of_the_file(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag").collect()
    first = {}
    for r in given:
        if r["l_orderkey"] not in first or r["l_linenumber"] > first[r["l_orderkey"]][0]:
            first[r["l_orderkey"]] = (r["l_linenumber"], r["l_returnflag"])
    # Several files, in the order of their names, read in many partitions.
    for k in range(4):
        part = given[k * len(given) // 4 : (k + 1) * len(given) // 4]
        spark.createDataFrame(part, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "made"), mode="overwrite")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    out = {r["job_id"]: (r["version"], r["flag"]) for r in all_queries()[0]["latest_wins"](spark, str(tmp_path)).collect()}
    assert out == first


def test_short_lines_merge(spark):
    long = "x" * 40
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "b", long, "c", "", "d"])], "book_id int, line_no int, line string")
    out = books.paragraphs(lines, ["book_id"]).orderBy("ord").collect()
    assert [r["text"] for r in out] == ["a b", long, "c", "d"]


def test_packing_rules(spark):
    sizes = [60, 60, 250, 10, 10]
    blocks = spark.createDataFrame([(1, i, str(i), "abcd" * n) for i, n in enumerate(sizes)], "book_id int, ord int, block_id string, text string")
    out = books.chunks(blocks, ["book_id"], 100)
    assert rows(out, "chunk", "first_ord", "last_ord", "tokens") == [(0, 0, 0, 60), (1, 1, 1, 60), (2, 2, 2, 250), (3, 3, 4, 20)]
    carried = books.carried_over(out, ["book_id"], 2)
    assert [r["carry_over"] for r in carried.orderBy("chunk").collect()] == [[], ["0"], ["1"], ["2"]]
    assert all(r["carry_over"] == [] for r in books.carried_over(out, ["book_id"], 0).collect())
    assert books.chunks(blocks.limit(0), ["book_id"], 100).count() == 0


def test_chunks_hold_each_block_once(spark):
    blocks = spark.createDataFrame([(1, i, f"p{i}", "A short sentence. " * 20) for i in range(30)], "book_id int, ord int, block_id string, text string")
    ids = [b for r in books.chunks(blocks, ["book_id"], 200).orderBy("chunk").collect() for b in r["block_ids"]]
    assert ids == [f"p{i}" for i in range(30)]


def test_txt_drops_what_precedes_the_first_heading(spark):
    text = "lost\n\nChapter 1\n\nHello world.\n\nChapter 2\n\nSecond chapter text.\n"
    docs = spark.createDataFrame([("b", text), ("c", "only text")], "book_id string, text string")
    out = books.txt_chapters(books.line_table(docs)).where("line <> ''")
    assert rows(out, "book_id", "chapter", "line") == [("b", 1, "Hello world."), ("b", 2, "Second chapter text."), ("c", 1, "only text")]


def test_detect_chapters_with_contents(spark):
    blocks = [("b", 0, "paragraph", None, "preamble"), ("b", 1, "heading", 1, "One"), ("b", 2, "paragraph", None, "x"), ("b", 3, "paragraph", None, "Two"), ("b", 4, "heading", 3, "p-005"), ("n", 0, "paragraph", None, "x")]
    df = spark.createDataFrame(blocks, "book_id string, idx int, type string, level int, text string")
    labels = spark.createDataFrame([("b", 0, "One"), ("b", 1, "Two"), ("n", 0, "toc"), ("n", 1, "Name")], "book_id string, pos int, label string")
    out = books.detect_chapters(df, labels)
    assert rows(out, "book_id", "idx", "chapter", "chapter_title") == [
        ("b", 0, 1, "One"), ("b", 1, 1, "One"), ("b", 2, 1, "One"), ("b", 3, 2, "Two"), ("b", 4, 2, "Two"), ("n", 0, 1, "Name"),
    ]


@pytest.fixture()
def book(spark):
    ch = spark.createDataFrame([("b", f"ch{i + 1}", i, f"T{i + 1}") for i in range(3)], "book_id string, chapter_id string, ord int, title string")
    bl = [("b", "ch1", i, f"a{i}") for i in range(3)] + [("b", "ch2", i, f"b{i}") for i in range(2)] + [("b", "ch3", i, f"c{i}") for i in range(2)]
    return ch, spark.createDataFrame(bl, "book_id string, chapter_id string, ord int, block_id string")


def test_chapter_edits(book):
    ch, bl = book
    kept, left = chapters.remove(ch, bl, "ch2")
    assert rows(kept, "chapter_id", "ord") == [("ch1", 0), ("ch3", 1)] and left.count() == 5
    kept, moved = chapters.merge_next(ch, bl, "ch1", "ch2", "Both")
    assert rows(kept, "chapter_id", "ord", "title") == [("ch1", 0, "Both"), ("ch3", 1, "T3")]
    assert [r["block_id"] for r in moved.where("chapter_id = 'ch1'").orderBy("ord").collect()] == ["a0", "a1", "a2", "b0", "b1"]
    kept, cut = chapters.split_at(ch, bl, "ch1", "a2")
    assert rows(kept, "ord", "chapter_id", "title")[:2] == [(0, "ch1", "T1"), (1, "ch1_s1", "T1 (2)")]
    assert rows(cut.where("chapter_id = 'ch1_s1'"), "block_id", "ord") == [("a2", 0)]
    assert rows(chapters.reorder(ch, ["ch3", "ch1", "ch2"]), "ord", "chapter_id") == [(0, "ch3"), (1, "ch1"), (2, "ch2")]
    assert rows(chapters.rename(ch, "ch1", " New "), "title")[0] == ("New",)


@pytest.mark.parametrize("bad", [
    lambda c, b: chapters.rename(c, "ch1", " "), lambda c, b: chapters.rename(c, "none", "x"), lambda c, b: chapters.remove(c, b, "none"),
    lambda c, b: chapters.merge_next(c, b, "ch1", "ch3"), lambda c, b: chapters.split_at(c, b, "ch1", "a0"), lambda c, b: chapters.split_at(c, b, "ch1", "b1"),
    lambda c, b: chapters.reorder(c, ["ch1", "ch2"]), lambda c, b: chapters.reorder(c, ["ch1", "ch1", "ch2"]),
])
def test_edits_refused(book, bad):
    with pytest.raises(chapters.EditError):
        bad(*book)


def test_alignment_gate(spark):
    def gate(n, m):
        side = lambda k: spark.createDataFrame([(1, i, "x") for i in range(k)], "pair_id int, ord int, text string")
        return rows(glossary.gate(glossary.aligned(side(n), side(m))), "manual")[0][0]

    assert [gate(10, 7), gate(10, 6), gate(0, 3), gate(3, 3)] == [False, True, True, False]


def test_jobs_upsert_and_queue(spark):
    old = spark.createDataFrame([(1, "pending", "x"), (2, "paused", "y")], "job_id int, status string, made string")
    new = spark.createDataFrame([(2, "pending", "z"), (3, "pending", "w")], "job_id int, status string, made string")
    assert rows(jobs.upserted(old, new, ["job_id"], ["status"]), "job_id", "status", "made") == [(1, "pending", "x"), (2, "pending", "y"), (3, "pending", "w")]
    items = spark.createDataFrame([("a", "processing", None), ("b", "completed_with_errors", "e")], "item_id string, status string, error string")
    acts = spark.createDataFrame([("a", "remove"), ("b", "retry")], "item_id string, action string")
    assert rows(jobs.moved(items, acts), "item_id", "new_status", "allowed", "new_error") == [("a", "processing", False, None), ("b", "pending", True, None)]
    assert rows(jobs.final_status(old, old.limit(0).withColumn("x", F.lit(1))), "job_id", "final_status") == [(1, "completed"), (2, "completed")]


def test_book_findings(spark):
    b = spark.createDataFrame([("b",), ("empty",)], "book_id string")
    ch = spark.createDataFrame([("b", "c1", " ")], "book_id string, chapter_id string, title string")
    bl = spark.createDataFrame([("b", "p0", "paragraph", "x", None), ("b", "p0", "paragraph", "y", None), ("b", "i", "image", None, "no.png")], "book_id string, block_id string, type string, text string, image_ref string")
    assets = spark.createDataFrame([("b", "a.png", "a.png")], "book_id string, asset_key string, rel_path string")
    ck = spark.createDataFrame([("b", "c1", "failed", ["p0"])], "book_id string, chapter_id string, status string, block_ids array<string>")
    codes = {r["code"] for r in validate.book_findings(b, ch, bl, assets, ck).collect()}
    assert codes == {"no_chapters", "blank_title", "duplicate_block", "image_not_mapped", "failed_chunks", "untranslated_blocks"}
    assert validate.missing_assets(assets, spark.createDataFrame([("b.png",)], "path string")).count() == 1


def test_languages(spark):
    assert len(lang.LANGUAGES) == 38 and lang.code_of(" ZH-hant ") == "zh-Hant" and lang.name_of("ja") == "Japanese"
    for bad in ("zh-TW", "zh-HK", "zh-CN", "zh-Hans", "auto", "", "garbage"):
        with pytest.raises(ValueError):
            lang.code_of(bad)
    known = lang.normalized(spark.createDataFrame([("xx",)], "given string"), "given")
    with pytest.raises(Exception, match="not a known language"):
        known.select(lang.required(F.col("code"), F.col("given"))).collect()


def test_images(spark):
    out = packages.shrunk(spark.createDataFrame([(3200, 1000), (100, 50)], "w int, h int"))
    assert rows(out, "w", "new_w", "new_h") == [(100, 100, 50), (3200, 1600, 500)]


class Flaky:
    """Fails on chunks that hold FAIL."""

    def translate(self, payload):
        if any("FAIL" in b["text"] for b in payload["to_translate"]):
            raise ValueError("no")
        return {"translations": [{"id": b["id"], "text": f"{len(payload['carry_over'])}:{b['text']}"} for b in payload["to_translate"]]}


def test_translate_and_resume(spark):
    texts = ["one " * 100, "FAIL " * 80, "three " * 70]
    blocks = spark.createDataFrame([("b", "c", i, f"p{i}", t) for i, t in enumerate(texts)], "book_id string, chapter_id string, ord int, block_id string, text string")
    each = chunked(blocks, 100)
    out = run_chunks(each, Flaky, attempts=1, delay=0)
    assert rows(out, "chunk", "status") == [(0, "completed"), (1, "failed"), (2, "completed")]
    assert rows(to_do(each, out), "chunk") == [(1,)] == rows(to_do(each, out, only_failed=True), "chunk")
    assert {r["status"] for r in run_chunks(each, UpperCase).collect()} == {"completed"}


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Retryable
        return {}

    assert with_retry(call, 3, 2.0, waits.append) == ({}, 3) and waits == [2.0, 4.0]
    with pytest.raises(Retryable):
        with_retry(lambda: (_ for _ in ()).throw(Retryable()), 0, 1.0, waits.append)
    assert base_url("http://h:1/") == "http://h:1/v1" == base_url("http://h:1/v1")
    assert reply_errors(["a"], {"translations": [{"id": "a", "text": "x"}]}) == [] and reply_errors(["a"], 5) == ["no_translations"]


def test_counted_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello there, reader.", "", None, "第一章 黎明", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    own = Tokenizer.from_file(path)
    want = [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n"] for r in rows.select(tx.counted_tokens(F.col("text"), path).alias("n")).collect()] == want
    assert [r["n"] for r in rows.select(tx.counted_tokens(F.col("text")).alias("n")).collect()] == [5, 0, 0, 3, 1250]
