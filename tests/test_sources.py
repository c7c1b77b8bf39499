"""Sources and sinks."""

import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.sources import epub, epub_io, html, store, txt


def test_html_walk():
    page = "<body>lost<div><h2>Head</h2>a<br>b<!-- c --><script>d</script><p>para <b>bold</b></p><span><img src=x.png alt=y></span></div><ul><li>one<li>two</ul><nav><p>no</p></nav></body>"
    assert html.blocks_of(page) == [
        ("heading", 2, "Head", None, None), ("paragraph", None, "a", None, None), ("paragraph", None, "b", None, None), ("paragraph", None, "para bold", None, None),
        ("image", None, None, "x.png", "y"), ("paragraph", None, "one", None, None), ("paragraph", None, "two", None, None),
    ]
    assert html.blocks_of("") == [] == html.blocks_of(None)


def test_encodings():
    assert txt.decoded("第一章".encode("gbk")) == "第一章" and txt.decoded("é".encode("latin-1"), "latin-1") == "é"
    assert txt.decoded(b"\xef\xbb\xbfa") == "﻿a"


def test_text_files(spark, tmp_path):
    (tmp_path / "book.txt").write_text("Chapter 1\n\nHello world.\n\nChapter 2\n\nSecond chapter text.\n")
    books, chapters, blocks = txt.text_books(txt.read_text_files(spark, str(tmp_path)))
    assert books.first()["title"] == "book"
    assert [tuple(r) for r in chapters.select("chapter_id", "ord", "title").orderBy("ord").collect()] == [("ch1", 0, "Chapter 1"), ("ch2", 1, "Chapter 2")]
    assert sorted(r["block_id"] for r in blocks.collect()) == ["ch1_p0", "ch2_p0"]


def test_epub_round_trip(spark, tmp_path):
    content = epub.package("A & B", "Me", "en", "urn:x", [("One", "<h1>One</h1><p>a &lt; b</p>"), ("Two", "<h1>Two</h1><p>c</p>")])
    assert content == epub.package("A & B", "Me", "en", "urn:x", [("One", "<h1>One</h1><p>a &lt; b</p>"), ("Two", "<h1>Two</h1><p>c</p>")])
    assert epub.problems(content) == [] and epub.problems(b"") == [("error", "empty")] and epub.problems(b"x") == [("error", "no_zip")]
    files = spark.createDataFrame([("k", bytearray(content)), ("bad", bytearray(b"no zip"))], "book_id string, content binary")
    books, blocks = epub.read_epubs(files)
    assert {r["book_id"]: r["title"] for r in books.collect()} == {"k": "A & B", "bad": None}
    got = [(r["chapter"], r["type"], r["text"]) for r in blocks.orderBy("idx").collect()]
    assert got == [(1, "heading", "One"), (1, "paragraph", "a < b"), (2, "heading", "Two"), (2, "paragraph", "c")]
    epub.save_files(files.where("book_id = 'k'"), str(tmp_path))
    assert (tmp_path / "k.epub").read_bytes() == content
    assert [tuple(r) for r in epub.package_findings(files).collect()] == [("bad", "error", "no_zip")]


def made_packages(spark, n, size=10):
    page = "<h1>One</h1><p>" + "x" * size + "</p>"
    rows = [(f"b{i}", bytearray(epub.package(f"T{i}", "A", "en", f"urn:{i}", [("One", page)], images={"cover.png": b"png"}, cover="cover.png"))) for i in range(n)]
    return spark.createDataFrame(rows, "book_id string, content binary")


def test_packages_as_a_data_source(spark, tmp_path):
    folder = str(tmp_path / "books")
    epub_io.register(spark)
    made_packages(spark, 6).repartition(3).write.format("epub").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "books").iterdir()) == [f"b{i}.epub" for i in range(6)]
    (tmp_path / "books" / "bad.epub").write_bytes(b"no zip")
    (tmp_path / "books" / "notes.txt").write_text("no package")
    read = epub_io.read_packages(spark, folder, ["book_id", "title", "warnings", "size"])
    assert read.columns == ["book_id", "title", "warnings", "size"]
    got = {r["book_id"].rpartition("/")[2]: r for r in read.collect()}
    assert len(got) == 7 and got["b3.epub"]["title"] == "T3" and got["bad.epub"]["title"] is None and got["bad.epub"]["warnings"]
    assert got["b3.epub"]["size"] == (tmp_path / "books" / "b3.epub").stat().st_size
    images = epub.images_of(epub_io.read_packages(spark, folder, ["book_id", "images"])).collect()
    assert len(images) == 6 and all(bytes(r["content"]) == b"png" and r["cover"] for r in images)
    assert spark.read.format("epub").load(folder).count() == 7
    assert epub_io.read_packages(spark, folder + "/b1.epub", ["title"]).first()["title"] == "T1"


def test_package_partitions_follow_sizes_and_metadata_unpacks_no_page(tmp_path, monkeypatch):
    sizes = [900, 10, 20, 30, 500, 40]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i}.epub").write_bytes(b"x" * n)
    parts = [p.paths for p in epub_io.EpubReader(str(tmp_path), 600, None).partitions()]
    weight = [sum(sizes[int(p.rpartition("/")[2][0])] for p in paths) for paths in parts]
    assert sorted(x for p in parts for x in p) == [f"{tmp_path}/{i}.epub" for i in range(6)] and sorted(weight) == [100, 500, 900]
    opened = []
    plain = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: opened.append(name) or plain(self, name, *a))
    content = epub.package("T", "A", "en", "urn:x", [("One", "<p>x</p>")], images={"a.png": b"png"})
    assert epub.parse(io.BytesIO(content), ["title", "spine"]) == {"title": "T", "spine": [(0, "c0")]}
    assert opened == ["META-INF/container.xml", "OEBPS/content.opf"]
    epub.parse(io.BytesIO(content), ["toc"])
    assert not any("chap" in n or "png" in n for n in opened)


def test_a_write_that_fails_leaves_no_file_and_a_retry_no_second_one(spark, tmp_path):
    folder = tmp_path / "books"
    epub_io.register(spark)
    bad = made_packages(spark, 4).unionByName(spark.createDataFrame([("b9", bytearray(b""))], "book_id string, content binary"))
    with pytest.raises(Exception, match="empty package"):
        bad.repartition(5).write.format("epub").mode("append").save(str(folder))
    assert not folder.exists() or list(folder.iterdir()) == []
    twice = made_packages(spark, 2).unionByName(made_packages(spark, 1))
    with pytest.raises(Exception, match="two packages"):
        twice.write.format("epub").mode("append").save(str(folder))
    assert list(folder.iterdir()) == []
    for _ in range(2):
        epub.save_files(made_packages(spark, 3), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["b0.epub", "b1.epub", "b2.epub"]


def test_an_attempt_that_failed_moves_nothing(tmp_path, monkeypatch):
    """The first attempt of a task writes a file and dies; the second one's is the one that counts."""
    writer = epub_io.EpubWriter(str(tmp_path / "out"))
    batch = pa.record_batch([pa.array(["b/1"]), pa.array([b"one"], pa.binary())], ["book_id", "content"])
    attempt = iter([7, 8])

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def taskAttemptId():
            return next(attempt)

    monkeypatch.setattr(epub_io, "TaskContext", Task)

    def dying():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    done = writer.write(iter([batch]))
    writer.commit([done, None])
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()] == [("b%2F1.epub", b"one")]


def test_soft_boundaries_only_where_nothing_stronger_is(spark):
    pages = lambda *bodies: [(f"P{i}", b) for i, b in enumerate(bodies)]
    plain = epub.package("T", "A", "en", "urn:1", pages("<p>front</p>", "<p>a</p><p>b</p>", "<p>c</p>"))
    plain = plain_contents(plain, {"chap_0001.xhtml": "The Sea", "chap_0002.xhtml": "p-005"})
    strong = plain_contents(epub.package("T", "A", "en", "urn:2", pages("<p>front</p>", "<h1>Real</h1><p>b</p>", "<p>c</p>")), {"chap_0002.xhtml": "The Sea"})
    files = spark.createDataFrame([("plain", bytearray(plain)), ("strong", bytearray(strong))], "book_id string, content binary")
    _, blocks = epub.read_epubs(files)
    got = {b: [(r["chapter"], r["chapter_title"], r["text"]) for r in blocks.where(F.col("book_id") == b).orderBy("idx").collect()] for b in ("plain", "strong")}
    assert got["plain"] == [(1, "The Sea", "front"), (1, "The Sea", "a"), (1, "The Sea", "b"), (1, "The Sea", "c")]
    assert {(c, t) for c, t, _ in got["strong"]} == {(1, "Real")}
    two = plain_contents(epub.package("T", "A", "en", "urn:3", pages("<p>a</p>", "<p>b</p>", "<p>c</p>")), {"CHAP_0000.xhtml#x": "First", "c2": "By id"})
    _, blocks = epub.read_epubs(spark.createDataFrame([("two", bytearray(two))], "book_id string, content binary"))
    assert [(r["chapter"], r["chapter_title"], r["text"]) for r in blocks.orderBy("idx").collect()] == [(1, "First", "a"), (1, "First", "b"), (2, "By id", "c")]


def plain_contents(content, titles):
    """The package with other contents: href to title."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as new:
        for n in z.namelist():
            links = "".join(f'<li><a href="{h}">{t}</a></li>' for h, t in titles.items())
            new.writestr(n, f"<html><body><nav><ol>{links}</ol></nav></body></html>" if n.endswith("nav.xhtml") else z.read(n))
    return out.getvalue()


def test_deep_and_open_markup():
    for page, n in (("<div>" * 100_000 + "x" + "</div>" * 100_000, 1), ("<p>" + "<b>" * 100_000 + "x", 1), ("<div><span>a" * 20_000, 1), ("<div>a</q>" * 20_000, 20_000)):
        assert len(html.blocks_of(page)) == n and html.headings_of(page) == [] == html.nav_links(page)


def test_page_headings_and_titles(spark):
    rows = [("a", "<title>T</title><h2>Two</h2><h1>p-005</h1><h1>Next</h1>"), ("b", "<title> </title><p>x"), ("c", None), ("d", "<h3>x <b>y</b></h3><h2></h2>"), ("e", "<title>index</title>")]
    pages = spark.createDataFrame(rows, "page_id string, html string")
    found = html.page_headings(pages, "page_id")
    assert sorted(tuple(r) for r in found.where("page_id = 'a'").collect()) == [("a", "h1", 0, "p-005"), ("a", "h1", 1, "Next"), ("a", "h2", 0, "Two"), ("a", "title", 0, "T")]
    names = {"a": "x.html", "b": "Deep Sea.html", "c": "toc.xhtml", "d": "n", "e": "chap_01.xhtml"}
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("page_id")]
    got = {r["page_id"]: r["title"] for r in html.guessed_titles(found, pages, "page_id", name).collect()}
    assert got == {"a": "Two", "b": "Deep Sea", "c": None, "d": "x y", "e": None}
    html.register(spark)
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT page_id, h.text FROM some_pages, LATERAL page_headings(html) AS h WHERE h.tag = 'h3'").collect() == [("d", "x y")]


def test_store_replaces_one_partition(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    s.save("blocks", spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "book_id string, ord int"))
    s.save("blocks", spark.createDataFrame([("b", 9)], "book_id string, ord int"))
    assert sorted((r["book_id"], r["ord"]) for r in s.load("blocks").collect()) == [("a", 1), ("b", 9)]
    assert s.load("blocks", "a").count() == 1


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    """Ids in no order, so that smallest and largest values exclude nothing: Bloom filters do."""
    rows = spark.range(60_000).coalesce(1).select(F.concat(F.lit("b"), F.xxhash64("id")).alias("block_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    wanted = rows.collect()[41_234]["block_id"]

    def read(folder, writer):
        writer.parquet(folder)
        found = spark.read.parquet(folder).where(F.col("block_id") == wanted)
        assert found.count() == 1 and len(found.collect()) == 1
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return scan.metrics().apply("numOutputRows").value()

    plain = read(str(tmp_path / "plain"), store.indexed(rows, [], 1 << 20))
    assert read(str(tmp_path / "bloom"), store.indexed(rows, ["block_id"], 1 << 20)) <= plain / 3
    small = store.indexed(rows.limit(10), ["block_id"])
    small.parquet(str(tmp_path / "small"))
    assert sum(p.stat().st_size for p in (tmp_path / "small").iterdir()) < 100_000


def test_glossaries_and_settings(spark, tmp_path):
    one = {"glossary_id": "g1", "name": "n", "scope": "book", "entries": [{"id": "e", "source": "Alice", "target": "A", "type": "proper_noun", "confirmed": True, "variants": ["Al"]}]}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g1.json").write_text(json.dumps(one, indent=1))
    read = store.read_glossaries(spark, str(tmp_path / "g"))
    assert [(r["entry_id"], r["source"]) for r in store.glossary_entries(read).collect()] == [("e", "Alice")]
    assert store.imported(read).first()["glossary_id"] != "g1" and store.read_glossaries(spark, str(tmp_path / "g"), "global").count() == 0
    path = str(tmp_path / "s" / "settings.json")
    assert store.load_settings(path) == store.Settings()
    store.save_settings(store.Settings(model="m", chunk_target_tokens=7), path)
    assert store.load_settings(path).chunk_target_tokens == 7
    (tmp_path / "s" / "settings.json").write_text("{broken")
    assert store.load_settings(path) == store.Settings() and store.Settings().prompt_to_store(" P ", "P") == ""


def test_an_unended_reference_is_text():
    page = "<title>a&amp;&amp</title><h1>b &lt;c&ampd; &copy &amp</h1><p>e&quot;f&am</p>&amp"
    assert html.blocks_of(page) == [("heading", 1, "b <c&ampd; &copy &amp", None, None), ("paragraph", None, 'e"f&am', None, None)]
    assert html.headings_of(page) == [("title", 0, "a&&amp"), ("h1", 0, "b <c&ampd; &copy &amp")]
