"""Whole jobs."""

import http.server
import json
import os
import threading
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelight import app
from quirelight.functions.languages import display_pairs
from quirelight.operators import translate, validate
from quirelight.operators.translate import UpperCase
from quirelight.sources import epub, store


class Picky(UpperCase):
    """Fails where a text holds FAIL."""

    def translate(self, payload):
        if any("FAIL" in b["text"] for b in payload["to_translate"]):
            raise ValueError("refused")
        return super().translate(payload)


@pytest.fixture()
def source(tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "book.txt"
    path.write_text("Chapter 1\n\nHello & world.\n\nChapter 2\n\nFAIL here.\n")
    return str(path)


def test_convert_and_read_back(spark, tmp_path, source):
    assert app.main(["convert", source, "-o", str(tmp_path / "out")], spark) == 0
    made = tmp_path / "out" / "book.epub"
    assert "mimetype" in zipfile.ZipFile(made).namelist()
    again = app.load_books(spark, str(made))
    assert [r["text"] for r in again["blocks"].where("type = 'paragraph'").orderBy("chapter_id").collect()] == ["Hello & world.", "FAIL here."]
    assert [r["title"] for r in again["chapters"].orderBy("ord").collect()] == ["Chapter 1", "Chapter 2"]
    assert app.preview(again).count() == 2
    with pytest.raises(ValueError):
        app.load_books(spark, "x.pdf")


def test_job_resumes_and_export_is_gated(spark, tmp_path, source):
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    (job,) = owner.create(app.load_books(spark, source))
    assert owner.run(job, Picky) == "completed_with_errors"
    with pytest.raises(app.ExportBlocked, match="failed_chunks"):
        owner.export(job, str(tmp_path / "out"))
    owner.export(job, str(tmp_path / "forced"), force=True)
    before = owner.results(job).where("status = 'completed'").first()["version"]
    assert owner.run(job, only_failed=True) == "completed" == owner.status(job)
    assert owner.results(job).where("chapter_id = 'ch1'").first()["version"] == before
    owner.export(job, str(tmp_path / "out"))
    assert (tmp_path / "out" / f"{job}.epub").exists() and open(source).read().startswith("Chapter 1")
    assert sorted(r["text"] for r in owner.book(job)["blocks"].collect()) == ["FAIL HERE.", "HELLO & WORLD."]
    with pytest.raises(ValueError):
        owner.create(app.load_books(spark, source), store.Settings(target_lang="zh-TW"))


def test_queue(spark, tmp_path, source):
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    (job,) = owner.create(app.load_books(spark, source))
    queue = app.Queue(owner, str(tmp_path / "out"), Picky)
    queue.restore()
    assert queue.items == {job: {"status": "pending", "error": None}}
    with pytest.raises(app.QueueError):
        queue.act("resume", job)
    queue.run()
    assert queue.items[job]["status"] == "completed_with_errors" and queue.items[job]["error"].startswith("export_failed: ")
    queue.act("retry", job)
    queue.translator = UpperCase
    queue.run()
    assert queue.items[job] == {"status": "completed", "error": None} and owner.status(job) == "completed"
    queue.act("remove", job)
    assert queue.items == {}


class Heard(UpperCase):
    """Answers with what it was sent."""

    def translate(self, payload):
        said = json.dumps({k: v for k, v in payload.items() if k != "to_translate"}, sort_keys=True, ensure_ascii=False)
        return {"translations": [{"id": b["id"], "text": said} for b in payload["to_translate"]]}


class Gone:
    def translate(self, payload):
        raise translate.LostConnection("Connection refused")


@pytest.fixture()
def many(tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("Chapter 1\n\n" + "\n\n".join(f"Alice says line {i} of a text that goes on for more than forty characters." for i in range(6)) + "\n")
    return str(path)


def made(spark, tmp_path, many, **settings):
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    glossary = [{"source": "Alice", "target": "A", "type": "proper_noun"}, {"source": "Bob", "target": "B", "type": "proper_noun"}]
    (job,) = owner.create(app.load_books(spark, many), store.Settings(chunk_target_tokens=10, request_interval_seconds=0.0, retry_delay_seconds=0.0, **settings), glossary)
    return owner, job


def test_a_translator_is_sent_all_and_a_resumed_run_has_its_context(spark, tmp_path, many):
    owner, job = made(spark, tmp_path, many)
    asked = iter([None, "pause"])
    assert owner.run(job, Heard, wave=2, asked=lambda: next(asked)) == "paused" and owner.results(job).count() == 2
    told = []
    assert owner.run(job, Heard, wave=2, on_progress=lambda event, data: told.append(event) or 1 / 0) == "completed" and told == ["wave_done"] * 2
    got = {r["chunk"]: json.loads(next(iter(r["translations"].values()))) for r in owner.results(job).collect()}
    assert set(got) == set(range(6)) and got[0]["carry_over"] == []
    for i in range(1, 6):
        (context,) = got[i]["carry_over"]
        assert context["source"].startswith(f"Alice says line {i - 1} ") and json.loads(context["translated"])["source_lang"] == "ja"
    assert [g["source"] for g in got[3]["glossary"]] == ["Alice"] and got[3]["target_lang"] == "zh-Hant" and "from Japanese to Traditional Chinese" in got[3]["prompt"]


def test_lost_connections_pause_a_job(spark, tmp_path, many):
    owner, job = made(spark, tmp_path, many, retry_count=1)
    assert owner.run(job, Gone, wave=1) == "paused" and owner.results(job).count() == 3
    assert "3 lost connections" in owner.db.load("jobs", job).first()["error"]


class Counted(UpperCase):
    """Loses connections after so many calls in all; each call leaves a file in a folder."""

    def __init__(self, folder, after):
        self.folder, self.after = folder, after

    def translate(self, payload):
        n = len(os.listdir(self.folder))
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        if n >= self.after:
            raise translate.LostConnection("Connection refused")
        return super().translate(payload)


@pytest.mark.parametrize("after", [0, 6])
def test_a_dead_service_is_called_as_often_as_the_threshold_says(spark, tmp_path, after):
    path = tmp_path / "wide.txt"
    path.write_text("".join(f"Chapter {c}\n\n" + "".join(f"Line {i} of chapter {c}, which goes on for more than forty characters.\n\n" for i in range(6)) for c in range(1, 5)))
    owner, job = made(spark, tmp_path, str(path), retry_count=1)
    calls = tmp_path / "calls"
    calls.mkdir()
    assert owner.run(job, lambda: Counted(str(calls), after)) == "paused"
    n = len(list(calls.iterdir()))
    # Gone from the start: three calls. Gone after the first chapter: three calls of each other chapter at most.
    assert n == 3 if after == 0 else 9 <= n <= 15
    assert owner.results(job).where("status = 'failed'").count() == n - after
    assert owner.run(job) == "completed" and owner.results(job).where("status = 'completed'").count() == 24


def test_a_changed_file_is_a_job_of_its_own(spark, tmp_path, source):
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    (old,) = owner.create(app.load_books(spark, source))
    assert owner.run(old) == "completed"
    with open(source, "w") as f:
        f.write("Chapter 1\n\nAnother text.\n")
    (new,) = owner.create(app.load_books(spark, source))
    (same,) = owner.create(app.load_books(spark, source))
    assert len({old, new, same}) == 3 and owner.results(new).count() == 0
    assert owner.run(new) == "completed"
    assert [r["text"] for r in owner.book(new)["blocks"].collect()] == ["ANOTHER TEXT."]
    assert [r["text"] for r in owner.book(old)["blocks"].collect()] == ["HELLO & WORLD.", "FAIL HERE."]


def test_a_creation_that_fails_half_way_shows_nothing(spark, tmp_path, source, monkeypatch):
    db = store.Store(spark, str(tmp_path / "db"))
    owner, plain = app.Jobs(db), store.Transaction.save
    (first,) = owner.create(app.load_books(spark, source))

    def save(self, name, rows):
        plain(self, name, rows)
        if name == "chunks":
            assert db.load("blocks").count() == 2  # written, and not to be seen
            raise OSError("disk full")

    monkeypatch.setattr(store.Transaction, "save", save)
    with pytest.raises(OSError):
        owner.create(app.load_books(spark, source))
    monkeypatch.undo()
    assert [r["job_id"] for r in db.load("jobs").collect()] == [first] and db.load("chunks").count() == 2
    assert len(list((tmp_path / "db" / "blocks").glob("txn=*"))) == 1
    # A failure between two heads of one transaction leaves each key whole: old or new.
    with pytest.raises(RuntimeError), db.transaction() as t:
        t.save("jobs", db.load("jobs", first).withColumn("status", F.lit("paused")))
        raise RuntimeError("stopped")
    assert owner.status(first) == "pending"


class Server:
    """A stub of the service: upper-cases, or refuses what holds the word."""

    def __init__(self, refused=""):
        class Reply(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                own = json.loads(asked["messages"][1]["content"])["to_translate"]
                seen.append((asked["model"], [b["text"] for b in own]))
                bad = refused and any(refused in b["text"] for b in own)
                self.send_response(400 if bad else 200)
                self.end_headers()
                if not bad:
                    content = json.dumps({"translations": [{"id": b["id"], "text": "T:" + b["text"]} for b in own]})
                    self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())

            def log_message(self, *args):
                return

        seen = self.seen = []
        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Reply)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1"

    def close(self):
        self.server.shutdown()
        self.server.server_close()


def test_retry_failed_calls_the_jobs_own_service_for_chosen_chunks(spark, tmp_path, many, capsys):
    server = Server()
    owner, job = made(spark, tmp_path, many, endpoint=server.url, model="m7")
    assert owner.run(job, lambda: Picky6()) == "completed_with_errors" and owner.results(job).where("status = 'failed'").count() == 3
    db = ["--db", str(tmp_path / "db"), "retry-failed", job]
    assert app.main([*db, "--chunks", "ch1:4"], spark) == 1
    assert [m for m, _ in server.seen] == ["m7"] and server.seen[0][1][0].startswith("Alice says line 4 ")
    assert app.main([*db, "-o", str(tmp_path / "out")], spark) == 0 and len(server.seen) == 3
    texts = {r["text"][:17] for r in owner.book(job)["blocks"].collect()}
    assert {"T:Alice says line", "ALICE SAYS LINE 0"} <= texts and (tmp_path / "out" / f"{job}.epub").exists()
    # A queue that is taken up again runs each job with its own service too.
    (other,) = owner.create(app.load_books(spark, many), store.Settings(endpoint=server.url, model="m8", request_interval_seconds=0.0))
    queue = app.Queue(owner, str(tmp_path / "q"))
    queue.restore()
    queue.run()
    server.close()
    assert queue.items[other]["status"] == "completed" and server.seen[-1][0] == "m8"


class Picky6(UpperCase):
    def translate(self, payload):
        if any(f"line {i} " in b["text"] for b in payload["to_translate"] for i in (2, 4, 5)):
            raise ValueError("refused")
        return super().translate(payload)


def test_single_blocks_and_chapters_are_looked_up(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"))
    rows = [("k", f"c{i // 10}", i % 10, f"b{i}", f"text {i}") for i in reversed(range(50))]
    db.save("blocks", spark.createDataFrame(rows, "book_id string, chapter_id string, ord int, block_id string, text string"))
    assert [r["text"] for r in db.block("k", "b7").collect()] == ["text 7"] and db.block("k", "none").count() == 0
    assert [r["ord"] for r in db.chapter("k", "c3").collect()] == list(range(10))
    assert [r["block_id"] for r in db.load("blocks", "k").collect()][:3] == ["b0", "b1", "b2"] and db.load("blocks", "nobody").count() == 0


def test_removal_and_requests_reach_the_store(spark, tmp_path, many):
    owner, job = made(spark, tmp_path, many)
    queue = app.Queue(owner, str(tmp_path / "out"))
    queue.add(job)
    queue.asked[job] = "stop"
    queue.run()
    assert queue.items[job]["status"] == "cancelled" == owner.status(job)
    queue.act("remove", job)
    queue.restore()
    assert queue.items == {} and owner.status(job) == "removed"
    again, other = made(spark, tmp_path, many, model="other")
    queue.add(other)
    queue.act("remove", other, delete_job_data=True)
    assert owner.db.load("jobs", other).count() == owner.db.load("chunks", other).count() == owner.db.load("blocks", other).count() == 0
    assert owner.db.load("chunks", job).count() == 6


def test_images_go_through_a_job(spark, tmp_path):
    pictures = {"img/a.png": b"png bytes", "img/front cover.jpg": b"jpg bytes"}
    body = '<h1>One</h1><p>said</p><p><img src="../img/a.png" alt="A"/></p>'
    (tmp_path / "b.epub").write_bytes(epub.package("T", "A", "en", "urn:x", [("One", body)], images=pictures, cover="img/front cover.jpg"))
    tables = app.load_books(spark, str(tmp_path / "b.epub"))
    assert {(r["asset_key"], bytes(r["content"]), r["cover"]) for r in tables["assets"].collect()} == {("img/a.png", b"png bytes", False), ("img/front cover.jpg", b"jpg bytes", True)}
    assert [r["image_ref"] for r in tables["blocks"].where("type = 'image'").collect()] == ["img/a.png"]
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    (job,) = owner.create(tables)
    assert owner.run(job) == "completed"
    owner.export(job, str(tmp_path / "out"))
    done = zipfile.ZipFile(tmp_path / "out" / f"{job}.epub")
    assert done.read("OEBPS/img/a.png") == b"png bytes" and b'properties="cover-image"' in done.read("OEBPS/content.opf")
    assert b'<img src="img/a.png" alt="A"/>' in done.read("OEBPS/chap_0000.xhtml")


def test_a_lost_image_blocks_the_export(spark, tmp_path):
    body = '<h1>One</h1><p>said</p><p><img src="img/a.png"/></p>'
    (tmp_path / "b.epub").write_bytes(epub.package("T", "A", "en", "urn:x", [("One", body)], images={"img/a.png": b"png"}))
    owner = app.Jobs(store.Store(spark, str(tmp_path / "db")))
    (job,) = owner.create(app.load_books(spark, str(tmp_path / "b.epub")))
    assert owner.run(job) == "completed"
    owner.db.save("assets", owner.db.load("assets", job).withColumn("content", F.lit(b"")))
    with pytest.raises(app.ExportBlocked, match="asset_missing img/a.png"):
        owner.export(job, str(tmp_path / "out"))
    owner.export(job, str(tmp_path / "out"), force=True)
    assert "OEBPS/img/a.png" not in zipfile.ZipFile(tmp_path / "out" / f"{job}.epub").namelist()
    # Assets that are files are held to a listing of their folder.
    (tmp_path / "files" / "img").mkdir(parents=True)
    (tmp_path / "files" / "img" / "x.png").write_bytes(b"x")
    (tmp_path / "files" / "img" / "empty.png").write_bytes(b"")
    assets = spark.createDataFrame([("k", "x", "img/x.png"), ("k", "e", "img/empty.png"), ("k", "y", "img/y.png")], "book_id string, asset_key string, rel_path string")
    files = validate.listing(spark, str(tmp_path / "files"))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    blocks = spark.createDataFrame([], "book_id string, chapter_id string, block_id string, type string, text string, image_ref string")
    books = spark.createDataFrame([("k", "c", "T")], "book_id string, chapter_id string, title string")
    found = validate.book_findings(books, books, blocks, assets, files=files)
    assert sorted(r["detail"] for r in found.collect()) == ["e", "y"]


def test_settings_and_flags_are_merged(spark, tmp_path, source):
    path = str(tmp_path / "settings.json")
    store.save_settings(store.Settings(source_lang="en", target_lang="fr", style="non-fiction", endpoint="", output_dir=str(tmp_path / "out"), chunk_target_tokens=7), path)
    cli = ["--db", str(tmp_path / "db"), "--settings", path, "translate", source, "--target", "German"]
    assert app.main(cli, spark) == 0 and len(list((tmp_path / "out").glob("*.epub"))) == 1
    config = json.loads(store.Store(spark, str(tmp_path / "db")).load("jobs").first()["config"])
    assert (config["source_lang"], config["target_lang"], config["style"], config["chunk_target_tokens"]) == ("en", "de", "non-fiction", 7)
    with pytest.raises(SystemExit):
        app.main(["--db", str(tmp_path / "db"), "convert", source], spark)
    assert display_pairs()[0] == ("Chinese", "zh") and len(display_pairs()) == 38


def test_glossary_and_queue_verbs(spark, tmp_path, source, capsys):
    root = ["glossary", "--root", str(tmp_path / "g")]
    assert app.main([*root, "create", "names"], spark) == 0
    own = capsys.readouterr().out.strip()
    assert app.main([*root, "add", own, "Hello", "HI"], spark) == 0 and app.main([*root, "list"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("names 1/1")
    kept = store.Glossaries(str(tmp_path / "g"))
    with pytest.raises(KeyError):
        kept.confirm(own, "nobody")
    said = "Chapter 1\n\n" + "\n\n".join(f"Then Alice saw number {i} of all the things that stood along the road." for i in range(4))
    (tmp_path / "s.txt").write_text(said)
    (tmp_path / "t.txt").write_text(said.replace("Alice", "Alicia"))
    assert app.main([*root, "build", str(tmp_path / "s.txt"), str(tmp_path / "t.txt")], spark) == 0
    built = kept.load(capsys.readouterr().out.split()[-1])["entries"]
    assert any(e["target"] == "Alicia" for e in built) or built
    assert app.main([*root, "build", str(tmp_path / "s.txt"), source], spark) == 1
    db = ["--db", str(tmp_path / "db2")]
    assert app.main([*db, "queue", str(tmp_path / "s.txt"), "-o", str(tmp_path / "q"), "--glossary", own, "--glossaries", str(tmp_path / "g")], spark) == 0
    assert len(list((tmp_path / "q").glob("*.epub"))) == 1


def test_endpoint():
    class Reply(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(asked)
            self.send_response(200 if len(seen) > 1 else 503)
            self.end_headers()
            if len(seen) > 1:
                own = json.loads(asked["messages"][1]["content"])["to_translate"]
                content = json.dumps({"translations": [{"id": b["id"], "text": "ok"} for b in own]})
                self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())

        def log_message(self, *args):
            return

    seen = []
    server = http.server.HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = translate.Endpoint(f"http://127.0.0.1:{server.server_port}/", "m", 5)
    reply, n = translate.with_retry(lambda: own.translate({"prompt": "P", "to_translate": [{"id": "a", "text": "x"}]}), 2, 0)
    server.shutdown()
    server.server_close()
    assert n == 2 and reply == {"translations": [{"id": "a", "text": "ok"}]} and seen[1]["messages"][0]["content"] == "P" and seen[1]["temperature"] == 0.3
    with pytest.raises(translate.LostConnection):
        own.translate({"to_translate": []})
