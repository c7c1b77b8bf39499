"""Whole jobs over the operators: convert, preview, translate with resume, export; and the queue."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.functions.languages import code_of, name_of
from quirelight.functions.text import is_translatable, stem, strip
from quirelight.operators import chapters as edits
from quirelight.operators import glossary, jobs, packages, render, translate, validate
from quirelight.sources import epub, epub_io, store, txt

BLOCKS = ["book_id", "chapter_id", "ord", "block_id", "type", "level", "text", "image_ref", "image_alt"]
ASSETS = ["book_id", "asset_key", "media_type", "content", "cover"]
ASSET_SCHEMA = "asset_key string, media_type string, content binary, cover boolean, book_id string"
RESULTS = "job_id string, book_id string, chapter_id string, chunk int, status string, attempts int, error string, translations map<string,string>, ended double, version int"
Tables = dict[str, DataFrame]


def load_books(spark: SparkSession, path: str) -> Tables:
    """books, chapters, blocks and assets of the files that path names, by its suffix: .txt or .epub."""
    suffix = path.rpartition(".")[2].lower()
    if suffix == "txt":
        books, chapters, blocks = txt.text_books(txt.read_text_files(spark, path))
        assets = books.limit(0).select("book_id", F.lit("").alias("asset_key"), F.lit("").alias("media_type"), F.lit(None).cast("binary").alias("content"), F.lit(False).alias("cover"))
    elif suffix == "epub":
        parts = store.saved(epub_io.read_packages(spark, path, ["book_id", *epub.PARTS]), "packages-read")
        books, flat = epub.books_of(parts)
        images = epub.images_of(parts)
        books = books.select("book_id", F.coalesce("title", stem(F.col("book_id"))).alias("title"), "author", "language", F.lit("horizontal").alias("layout"))
        flat = store.saved(flat, "blocks")
        chapters = flat.groupBy("book_id", "chapter_id").agg((F.min("chapter") - 1).alias("ord"), F.max("chapter_title").alias("title"))
        blocks = flat.withColumn("block_id", F.concat_ws("_", "chapter_id", F.concat(F.lit("b"), "ord")))
        # An image block names its asset by key, where the package has one.
        refs = blocks.where("type = 'image'").select("book_id", F.col("image_ref").alias("src")).distinct()
        known = packages.image_assets(refs, images.select("book_id", "pos", F.col("asset_key").alias("path")))
        blocks = blocks.join(known.withColumnRenamed("src", "image_ref"), ["book_id", "image_ref"], "left").withColumn("image_ref", F.coalesce("path", "image_ref")).drop("path")
        assets = images.select(*ASSETS)
    else:
        raise ValueError(f"neither .txt nor .epub: {path}")
    for name, kind in (("level", "int"), ("image_ref", "string"), ("image_alt", "string")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    return {"books": books.select("book_id", "title", "author", "language", "layout"), "chapters": chapters.select(*edits.CHAPTER), "blocks": blocks.select(*BLOCKS), "assets": assets}


def packaged(tables: Tables, mode: str = "standard") -> DataFrame:
    """(book_id, content): each book as a package, with its images."""
    assets = tables["assets"].where(F.length("content") > 0)
    blocks = render.with_images(tables["blocks"], assets.select("book_id", "asset_key", F.col("asset_key").alias("file_name")))
    html = render.chapter_html(tables["chapters"], blocks, mode)
    titled = html.join(tables["chapters"].drop("ord"), ["book_id", "chapter_id"])
    return epub.write_epubs(tables["books"], titled.select("book_id", "ord", "title", "html"), assets, mode)


def preview(tables: Tables) -> DataFrame:
    """A row for each chapter: its label's parts, counts and a snippet."""
    counts = edits.block_counts(tables["chapters"], tables["blocks"])
    return counts.join(edits.snippets(tables["blocks"]), ["book_id", "chapter_id"], "left").orderBy("book_id", "ord")


#: Findings that an error's text names; it says how many there are besides.
SHOWN = 20


class ExportBlocked(RuntimeError):
    """The findings that forbid an export."""


class Jobs:
    """Translation jobs in a store. A job works on its own snapshot of the book, so later edits of
    the source don't reach it; results of chunks are a log."""

    def __init__(self, db: store.Store):
        self.db, self.spark = db, db.spark

    def create(self, tables: Tables, settings: store.Settings = store.Settings(), entries: list[dict] | None = None) -> list[str]:
        """A job for each book, in one transaction: a creation that fails leaves nothing. Unknown
        languages are refused before anything is written."""
        config = {**asdict(settings), "source_lang": code_of(settings.source_lang), "target_lang": code_of(settings.target_lang), "glossary": entries or []}
        text = json.dumps(config, ensure_ascii=False, sort_keys=True)
        # Each creation makes jobs of its own: what an earlier one has of the same file stays its own.
        salt = uuid.uuid4().hex
        job_id = F.substring(F.sha2(F.concat(F.lit(salt), F.col("book_id").cast("string")), 256), 1, 16)
        own = {k: t.withColumn("book_id", job_id) for k, t in tables.items()}
        job = own["books"].select(F.col("book_id").alias("job_id"), "title", F.lit("pending").alias("status"), F.lit(text).alias("config"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("created_at"))
        wanted = own["blocks"].where(is_translatable(F.col("type"), F.col("text")))
        chunks = translate.chunked(wanted, settings.chunk_target_tokens).withColumn("job_id", F.col("book_id"))
        with self.db.transaction() as t:
            for name, rows in {**own, "chunks": chunks, "jobs": job}.items():
                t.save(name, rows)
            # One id for each book that was handed in.
            return sorted(key for key, names in t.keys().items() if "jobs" in names)

    def results(self, job_id: str) -> DataFrame:
        return jobs.latest(self.db.results(job_id, RESULTS), ["book_id", "chapter_id", "chunk"], "version")

    def status(self, job_id: str) -> str:
        return self.db.load("jobs", job_id).first()["status"]

    def set_status(self, job_id: str, status: str, error: str | None = None) -> None:
        rows = self.db.load("jobs", job_id).withColumn("status", F.lit(status)).withColumn("error", F.lit(error).cast("string"))
        self.db.save("jobs", rows)

    def translator(self, job_id: str) -> Callable[[], translate.Translator]:
        """What the job was made for: its endpoint and model; without an endpoint, the one that needs no service."""
        config = json.loads(self.db.load("jobs", job_id).first()["config"])
        endpoint, model, timeout = config["endpoint"], config["model"], config["request_timeout_seconds"]
        return (lambda: translate.Endpoint(endpoint, model, timeout)) if endpoint else translate.UpperCase

    def delete(self, job_id: str) -> None:
        """The job, its chunks, its results and its snapshot of the book."""
        self.db.delete(job_id)

    def run(
        self, job_id: str, translator: Callable[[], translate.Translator] = translate.UpperCase, only_failed: bool = False, wave: int = 8,
        asked: Callable[[], str | None] = lambda: None, on_progress: Callable[[str, dict], None] = lambda event, data: None, chosen: list[str] | None = None,
    ) -> str:
        """Runs the chunks that aren't completed (or the failed alone; of them, those chosen by id,
        ``chapter_id:chunk``), and returns the job's status.

        Chapters go side by side, in waves of so many chunks of each. A wave's results are stored
        before the next one begins, so a lost run is taken up behind its last wave. Between waves
        asked may answer pause or stop. on_progress hears of waves; what it raises changes nothing.

        So many lost connections in a row as the job's threshold, in the order in which calls ended,
        pause it. A chapter calls no more once it has seen so many; and one chapter goes alone until
        the service has replied, and again when a wave ends in a lost connection. So a service that
        is gone is called as often as the threshold says, or, if it goes in the middle of a wave, at
        most so often by each chapter."""
        config = json.loads(self.db.load("jobs", job_id).first()["config"])
        sent = {k: config[k] for k in ("source_lang", "target_lang", "style", "glossary")}
        names = {k: name_of(config[k]) for k in ("source_lang", "target_lang")}
        prompt = config["custom_prompt"].strip() or render.STYLES["nonfiction" if "non" in config["style"].lower() else "fiction"]
        for mark, value in (("source_language", sent["source_lang"]), ("target_language", sent["target_lang"]), ("source_language_name", names["source_lang"]), ("target_language_name", names["target_lang"])):
            prompt = prompt.replace("{{" + mark + "}}", value or "")
        self.set_status(job_id, "processing")
        chunks, keys = self.db.load("chunks", job_id).select("book_id", "chapter_id", "chunk", "blocks"), ["book_id", "chapter_id", "chunk"]
        first = version = (self.results(job_id).agg(F.max("version")).first()[0] or 0) + 1
        open_ = translate.to_do(chunks, self.results(job_id), only_failed)
        if chosen is not None:
            open_ = open_.where(F.concat_ws(":", "chapter_id", "chunk").isin(*chosen))
        open_ = store.saved(open_.select(*keys), "open-chunks")
        most = config["endpoint_fail_threshold"]
        lost, replied, status, error = 0, False, None, None
        while status is None:
            log = self.results(job_id)
            left = open_.join(log.where(F.col("version") >= first).select(*keys), keys, "left_anti")
            if not replied or lost:
                left = left.join(left.agg(F.min(F.struct("book_id", "chapter_id")).alias("c")).select("c.*"), ["book_id", "chapter_id"])
            nth = F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("chunk"))
            now = left.withColumn("nth", nth).where(F.col("nth") <= wave).drop("nth")
            wanted = asked()
            if not left.limit(1).count():
                # As the whole job stands, not this run's chunks alone.
                failed = log.where("status = 'failed'").limit(1).count()
                status = "completed_with_errors" if failed else "completed"
            elif wanted:
                status = "cancelled" if wanted == "stop" else "paused"
            else:
                ready = translate.with_context(chunks, log, config["carry_over_paragraphs"]).join(now, keys, "left_semi")
                done = translate.run_chunks(
                    ready, translator, config["carry_over_paragraphs"], config["retry_count"], config["retry_delay_seconds"],
                    config["request_interval_seconds"] if translator is not translate.UpperCase else 0.0, {**sent, "prompt": prompt}, lost, most,
                )
                self.db.append_results(done.select(F.lit(job_id).alias("job_id"), *done.columns, F.lit(version).alias("version")))
                events = self.results(job_id).where(F.col("version") == version)
                n = events.count()
                streak, lost = self._streaks(events, lost)
                replied = replied or lost < streak or not streak
                self._tell(on_progress, "wave_done", {"job_id": job_id, "chunks": n, "version": version})
                version += 1
                if streak >= most:
                    status, error = "paused", f"{streak} lost connections in a row"
        self.set_status(job_id, status, error)
        return status

    @staticmethod
    def _streaks(events: DataFrame, before: int) -> tuple[int, int]:
        """(the longest run of lost connections, the run that lasts), of one wave's calls by when they
        ended; before is how many there were already."""
        bad = F.coalesce(F.col("error").contains("Connection"), F.lit(False))
        order = ["ended", "chapter_id", "chunk"]
        rows = jobs.streaks(events.withColumn("bad", bad), ["job_id"], order)
        replies = F.sum((~F.col("bad")).cast("int")).over(Window.partitionBy("job_id").orderBy(*order))
        rows = rows.withColumn("streak", F.col("streak") + F.when(replies == 0, before).otherwise(0))
        longest, last = rows.agg(F.max("streak"), F.max_by("streak", F.struct(*order))).first()
        return longest or 0, last or 0

    @staticmethod
    def _tell(on_progress: Callable[[str, dict], None], event: str, data: dict) -> None:
        try:
            on_progress(event, data)
        except Exception:  # noqa: BLE001  a listener's failure is its own
            return

    def book(self, job_id: str) -> Tables:
        """The job's book with its translations laid over."""
        tables = {k: self.db.load(k, job_id).drop("schema_version") for k in ("books", "chapters", "blocks")}
        tables["assets"] = self.db.load("assets", job_id, ASSET_SCHEMA).drop("schema_version")
        done = self.results(job_id).where("status = 'completed'").select("book_id", F.explode("translations").alias("block_id", "text"))
        return {**tables, "blocks": jobs.applied(tables["blocks"], done, ["book_id", "block_id"])}

    def export(self, job_id: str, folder: str, force: bool = False, mode: str = "standard") -> None:
        """Writes the job's package, unless the book or the package has errors; force goes past
        the book's."""
        tables, log = self.book(job_id), self.results(job_id)
        states = self.db.load("chunks", job_id).join(log.select("book_id", "chapter_id", "chunk", "status"), ["book_id", "chapter_id", "chunk"], "left")
        states = states.select("book_id", "chapter_id", F.coalesce("status", F.lit("pending")).alias("status"), F.transform("blocks", lambda b: b["id"]).alias("block_ids"))
        found = store.saved(validate.book_findings(tables["books"], tables["chapters"], tables["blocks"], tables["assets"], states), "findings")
        wrong = found.where("severity = 'error'").orderBy("place", "detail").limit(SHOWN).collect()
        if wrong and not force:
            n = found.where("severity = 'error'").count()
            more = f" (and {n - len(wrong)} more)" if n > len(wrong) else ""
            raise ExportBlocked("; ".join(f"{r['code']} {r['detail']}" for r in wrong) + more)
        content = store.saved(packaged(tables, mode), "packages")
        broken = epub.package_findings(content).where("severity = 'error'").limit(SHOWN).collect()
        if broken:
            raise ExportBlocked("; ".join(r["code"] for r in broken))
        epub.save_files(content, folder)


class QueueError(RuntimeError):
    """What the queue's transition table doesn't allow."""


class Queue:
    """Jobs in a line. An action is looked up in the transition table and stored before the queue's
    own view of the item changes."""

    def __init__(self, owner: Jobs, folder: str, translator: Callable[[], translate.Translator] | None = None, mode: str = "standard"):
        """Without a translator, each job is run with its own."""
        self.jobs, self.folder, self.translator, self.mode = owner, folder, translator, mode
        self.items: dict[str, dict] = {}
        self.asked: dict[str, str] = {}
        self.table = {(a, s): (n, ask) for a, s, n, ask in jobs.TRANSITIONS}

    def add(self, job_id: str) -> None:
        self.items[job_id] = {"status": "pending", "error": None}

    def restore(self) -> None:
        """Takes up the store's incomplete jobs."""
        if not self.jobs.db.has("jobs"):
            return
        for r in self.jobs.db.load("jobs").where(F.col("status").isin(*jobs.OPEN)).select("job_id", "status").toLocalIterator():
            self.items[r["job_id"]] = {"status": "pending" if r["status"] == "processing" else r["status"], "error": None}

    def act(self, action: str, job_id: str, delete_job_data: bool = False) -> None:
        """What is asked of a running job reaches it between two waves. A removed item is stored as
        removed, or deleted with all its data; if that fails, the item stays."""
        item = self.items[job_id]
        if (action, item["status"]) not in self.table:
            raise QueueError(f"{action} is not allowed while {item['status']}")
        new, ask = self.table[action, item["status"]]
        if ask:
            self.asked[job_id] = ask
        elif new == "removed":
            if delete_job_data:
                self.jobs.delete(job_id)
            else:
                self.jobs.set_status(job_id, "removed")
            del self.items[job_id]
        else:
            self.jobs.set_status(job_id, new)
            item.update(status=new, error=None if action == "retry" else item["error"])

    def run(self) -> None:
        """Pending items in order. A failed export leaves the item completed with errors."""
        for job_id in [k for k, v in self.items.items() if v["status"] == "pending"]:
            self.items[job_id]["status"] = "processing"
            status, error = self.jobs.run(job_id, self.translator or self.jobs.translator(job_id), asked=lambda j=job_id: self.asked.pop(j, None)), None
            self.asked.pop(job_id, None)
            if status in ("paused", "cancelled"):
                self.items[job_id].update(status=status)
                continue
            try:
                self.jobs.export(job_id, self.folder, mode=self.mode)
            except Exception as e:  # noqa: BLE001  the item's result
                status, error = "completed_with_errors", f"export_failed: {e}"
                self.jobs.set_status(job_id, status, error)
            self.items[job_id].update(status=status, error=error)


def _translating(verb: argparse.ArgumentParser) -> None:
    """What is given goes before the settings file's values, and these before the defaults."""
    for flag in ("--source", "--target", "--style", "--model"):
        verb.add_argument(flag)
    verb.add_argument("--endpoint", help="without one, here or in the settings, a translator that needs no service")
    verb.add_argument("--glossary", default="", help="a glossary's id; its confirmed entries are frozen into the job")
    verb.add_argument("--glossaries", default="./glossaries")


def _settings(given: argparse.Namespace) -> store.Settings:
    base = store.load_settings(given.settings) if given.settings else store.Settings(endpoint="")
    flags = {"source_lang": given.source, "target_lang": given.target, "style": given.style, "model": given.model, "endpoint": given.endpoint}
    merged = replace(base, **{k: v for k, v in flags.items() if v is not None})
    return replace(merged, endpoint=translate.base_url(merged.endpoint) if merged.endpoint else "")


def _output(given: argparse.Namespace) -> str:
    """The folder named, else the settings' one."""
    folder = given.output or (store.load_settings(given.settings).output_dir if given.settings else "")
    if not folder:
        raise SystemExit("an output folder is needed: -o, or output_dir in the settings")
    return folder


def _frozen(given: argparse.Namespace) -> list[dict]:
    """Confirmed entries as a prompt lists them: proper nouns first, then by source."""
    entries = store.Glossaries(given.glossaries).load(given.glossary)["entries"] if given.glossary else []
    return sorted((e for e in entries if e.get("confirmed")), key=lambda e: (e.get("type") != "proper_noun", e["source"]))


def built_glossary(source: Tables, official: Tables, most: int = 200) -> tuple[bool, list[dict]]:
    """(whether the books must be aligned by hand, candidate entries): the nth translatable texts of
    both together, and their frequent terms, unless the books differ too much in length. most
    bounds the candidates."""

    def texts(tables: Tables) -> DataFrame:
        rows = tables["blocks"].where(is_translatable(F.col("type"), F.col("text")))
        rows = rows.join(tables["chapters"].select("book_id", "chapter_id", F.col("ord").alias("c")), ["book_id", "chapter_id"])
        return rows.select(F.lit(0).alias("pair_id"), F.struct("c", "ord").alias("ord"), strip(F.col("text")).alias("text"))

    pairs = store.saved(glossary.aligned(texts(source), texts(official)), "pairs")
    gate = glossary.gate(pairs).first()
    if gate is None or gate["manual"]:
        return True, []
    both = pairs.where("source_text is not null and target_text is not null")
    found = glossary.term_candidates(both, ["pair_id", "idx"], most).orderBy(F.desc("n"), "term").collect()
    return False, [{"id": f"c{i}", "source": r["term"], "target": r["target"], "type": "proper_noun", "notes": None, "confirmed": False, "variants": []} for i, r in enumerate(found)]


def _glossary(given: argparse.Namespace, spark: SparkSession) -> int:
    kept = store.Glossaries(given.root)
    if given.act == "list":
        for i in kept.ids():
            own = kept.load(i)
            print(i, own["name"], f"{sum(bool(e.get('confirmed')) for e in own['entries'])}/{len(own['entries'])}")
    elif given.act == "create":
        print(kept.create(given.name))
    elif given.act == "add":
        print(kept.add(given.glossary_id, given.source, given.target, confirmed=True))
    else:
        manual, entries = built_glossary(load_books(spark, given.source), load_books(spark, given.official))
        if manual:
            print("the books differ too much in length to be aligned by place", file=sys.stderr)
            return 1
        print(kept.create(f"{given.source} / {given.official}", "book", entries))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: not completed; 2: the export is blocked."""
    parser = argparse.ArgumentParser(prog="quirelight")
    parser.add_argument("--db", default="./quirelight_db")
    parser.add_argument("--settings", default="", help="a settings file")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("convert", "preview", "translate"):
        verb = verbs.add_parser(name)
        verb.add_argument("input")
        if name != "preview":
            verb.add_argument("-o", "--output")
            verb.add_argument("--mode", default="standard", choices=render.MODES)
        if name == "translate":
            _translating(verb)
            verb.add_argument("--force", "--force-export", action="store_true", help="export a book that has errors")
    for name in ("export", "retry-failed"):
        verb = verbs.add_parser(name)
        verb.add_argument("job")
        verb.add_argument("-o", "--output")
        verb.add_argument("--force", "--force-export", action="store_true")
        verb.add_argument("--mode", default="standard", choices=render.MODES)
        if name == "retry-failed":
            verb.add_argument("--chunks", nargs="*", help="ids of failed chunks, chapter_id:chunk; all of them without")
    verbs.add_parser("list-jobs")
    queued = verbs.add_parser("queue")
    queued.add_argument("inputs", nargs="*")
    queued.add_argument("-o", "--output")
    queued.add_argument("--mode", default="standard", choices=render.MODES)
    _translating(queued)
    listed = verbs.add_parser("glossary")
    listed.add_argument("--root", default="./glossaries")
    acts = listed.add_subparsers(dest="act", required=True)
    acts.add_parser("list")
    acts.add_parser("create").add_argument("name")
    for name, wanted in (("add", ("glossary_id", "source", "target")), ("build", ("source", "official"))):
        act = acts.add_parser(name)
        for w in wanted:
            act.add_argument(w)
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quirelight").getOrCreate()
    owner = Jobs(store.Store(spark, given.db))
    if given.verb == "convert":
        epub.save_files(packaged(load_books(spark, given.input), given.mode).withColumn("book_id", stem(F.col("book_id"))), _output(given))
    elif given.verb == "preview":
        preview(load_books(spark, given.input)).show(truncate=60)
    elif given.verb == "glossary":
        return _glossary(given, spark)
    elif given.verb == "queue":
        queue = Queue(owner, _output(given), mode=given.mode)
        queue.restore()
        for path in given.inputs:
            for job_id in owner.create(load_books(spark, path), _settings(given), _frozen(given)):
                queue.add(job_id)
        queue.run()
        return int(any(i["status"] != "completed" for i in queue.items.values()))
    elif given.verb == "list-jobs":
        owner.db.load("jobs").select("job_id", "title", "status", "created_at").orderBy(F.desc("created_at")).show(truncate=False)
    else:
        try:
            if given.verb == "translate":
                made = owner.create(load_books(spark, given.input), _settings(given), _frozen(given))
            else:
                made = [given.job]
            if given.verb == "retry-failed":
                owner.run(given.job, owner.translator(given.job), only_failed=True, chosen=given.chunks)
            ended = [owner.run(j, owner.translator(j)) for j in made] if given.verb == "translate" else [owner.status(j) for j in made]
            if given.verb == "retry-failed" and not given.output:
                return int(any(s != "completed" for s in ended))
            for j in made:
                owner.export(j, _output(given), given.force, given.mode)
        except ExportBlocked as e:
            print(e, file=sys.stderr)
            return 2
        return int(any(s != "completed" for s in ended))
    return 0


if __name__ == "__main__":
    sys.exit(main())
