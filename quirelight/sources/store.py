"""The engine's own tables as Parquet, glossaries as JSON, settings as a file."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
GLOSSARY = (
    "glossary_id string, name string, scope string, book_key string, version string, schema_version int, "
    "entries array<struct<id:string,source:string,target:string,type:string,notes:string,confirmed:boolean,variants:array<string>>>"
)
_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a
    temporary one for a local master, and a folder of the warehouse for others."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        local = spark.sparkContext.master.startswith("local[")
        _own[app] = tempfile.mkdtemp(prefix="quirelight-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quirelight"
    return _own[app]


def saved(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read back: computed once, however often they are used."""
    path = f"{root(rows.sparkSession)}/quirelight/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, where their input comes in fewer: work in a row isn't left
    to the few tasks that a small file gives. Large inputs stay as they are, unshuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


class Store:
    """Tables below a folder: books, chapters, blocks, assets by book_id; jobs, chunks by job_id.

    A partition, the rows of one key in one table, is written below the number of its transaction
    (``blocks/txn=7f/book_id=k``) and never changed. For each key one small file, its head, names
    the transaction of each of its tables that counts. A transaction writes its partitions and then
    swaps heads, by an atomic rename; until then, and for good if it fails, readers are on the
    state before. Keys of several tables are the same where a job owns its book's snapshot."""

    KEYS = {"books": "book_id", "chapters": "book_id", "blocks": "book_id", "assets": "book_id", "jobs": "job_id", "chunks": "job_id", "results": "job_id"}
    #: What reading order means.
    ORDERED = {"chapters": ["ord"], "blocks": ["chapter_id", "ord"], "chunks": ["chapter_id", "chunk"], "assets": ["asset_key"]}
    #: Columns that single rows are looked up by: their files carry Bloom filters.
    LOOKED_UP = {"blocks": ["block_id", "chapter_id"], "chapters": ["chapter_id"]}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- heads

    def _path(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{where}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _name(key: str) -> str:
        return quote(str(key), safe="")

    def head(self, key: str) -> dict[str, str]:
        """The transaction of each table's rows of the key."""
        path, files = self._path(f"_heads/{self._name(key)}.json")
        if not files.exists(path):
            return {}
        found = self.spark.read.schema("tables map<string,string>").json(str(path)).first()
        return dict(found["tables"] or {}) if found else {}

    def _swap(self, key: str, tables: dict[str, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        part, files = self._path(f"_heads/_{uuid.uuid4().hex}")
        target, _ = self._path(f"_heads/{self._name(key)}.json")
        out = files.create(part, True)
        out.write(json.dumps({"key": str(key), "tables": tables}).encode())
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, target, how)

    def heads(self, name: str) -> DataFrame:
        """(key, txn): what counts of a table, for all keys."""
        if not self.has("_heads"):
            return self.spark.createDataFrame([], "key string, txn string")
        rows = self.spark.read.schema("key string, tables map<string,string>").option("pathGlobFilter", "*.json").json(f"{self.folder}/_heads")
        return rows.select("key", F.try_element_at("tables", F.lit(name)).alias("txn")).where("txn is not null")

    # -- writing

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """What is saved in the block counts all at once, when it ends. If it fails nothing does,
        and what was written goes."""
        own = Transaction(self)
        try:
            yield own
            own.commit()
        except BaseException:
            own.undo()
            raise

    def save(self, name: str, rows: DataFrame) -> None:
        """Replaces the partitions that the rows belong to; no other partition is touched."""
        with self.transaction() as t:
            t.save(name, rows)

    def append_results(self, rows: DataFrame) -> None:
        """Results of chunks as a log, by job; :func:`quirelight.operators.jobs.latest` reads it."""
        rows.write.mode("append").partitionBy("job_id").parquet(f"{self.folder}/results")

    def delete(self, key: str) -> None:
        """Drops a key's rows of all tables: first its head, so that they count no more, then the files."""
        tables = self.head(key)
        path, files = self._path(f"_heads/{self._name(key)}.json")
        files.delete(path, False)
        for where in [f"{n}/txn={t}/{self.KEYS[n]}={self._name(key)}" for n, t in tables.items()] + [f"results/job_id={self._name(key)}"]:
            path, files = self._path(where)
            files.delete(path, True)

    # -- reading

    def load(self, name: str, key: str | None = None, schema: str | None = None) -> DataFrame:
        """The table, or one book's or job's part of it, read from its partition alone, in reading
        order, and checked. A table that may hold no rows at all needs its schema."""
        reader = self.spark.read if schema is None else self.spark.read.schema(f"{schema}, txn string, schema_version int")
        root, column = f"{self.folder}/{name}", self.KEYS[name]
        if key is None:
            live = self.heads(name).withColumnRenamed("key", column)
            rows = reader.parquet(root).withColumn(column, F.col(column).cast("string")).withColumn("txn", F.col("txn").cast("string"))
            rows = rows.join(live, [column, "txn"], "left_semi")
        else:
            txn = self.head(key).get(name)
            where, files = self._path(f"{name}/txn={txn}/{column}={self._name(key)}")
            there = txn is not None and files.exists(where)
            rows = reader.option("basePath", root).parquet(str(where)) if there else reader.parquet(root).limit(0)
            rows = rows.withColumn(column, F.lit(str(key)))
            order = [c for c in self.ORDERED.get(name, []) if c in rows.columns]
            rows = rows.orderBy(*order) if there and order else rows
        wrong = rows.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count()
        if wrong:
            raise ValueError(f"{name} has rows of another schema version than {SCHEMA_VERSION}")
        return rows.drop("txn")

    def block(self, key: str, block_id: str) -> DataFrame:
        """One block of a book. Row groups whose Bloom filter or statistics exclude the id aren't read."""
        return self.load("blocks", key).where(F.col("block_id") == block_id)

    def chapter(self, key: str, chapter_id: str) -> DataFrame:
        """One chapter's blocks, in order."""
        return self.load("blocks", key).where(F.col("chapter_id") == chapter_id).orderBy("ord")

    def has(self, name: str) -> bool:
        """Whether anything has been saved under the name."""
        path, files = self._path(name)
        return files.exists(path)

    def results(self, job_id: str, schema: str) -> DataFrame:
        """One job's log; without rows if nothing has been run yet."""
        where, files = self._path(f"results/job_id={self._name(job_id)}")
        if not files.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/results").parquet(str(where)).withColumn("job_id", F.lit(str(job_id)))


class Transaction:
    """Partitions that are written and don't count yet."""

    def __init__(self, owner: Store):
        self.owner, self.txn, self.names = owner, uuid.uuid4().hex, []

    def save(self, name: str, rows: DataFrame) -> None:
        rows = rows.withColumn("schema_version", F.lit(SCHEMA_VERSION)) if "schema_version" not in rows.columns else rows
        self.names.append(name)
        indexed(rows, Store.LOOKED_UP.get(name, [])).partitionBy(Store.KEYS[name]).parquet(f"{self.owner.folder}/{name}/txn={self.txn}")

    def keys(self) -> dict[str, list[str]]:
        """For each key the tables that it has new partitions in: what the folders' names say."""
        out: dict[str, list[str]] = {}
        for name in self.names:
            path, files = self.owner._path(f"{name}/txn={self.txn}")
            for found in files.listStatus(path) if files.exists(path) else []:
                column, _, key = found.getPath().getName().partition("=")
                if column == Store.KEYS[name]:
                    out.setdefault(unquote(key), []).append(name)
        return out

    def commit(self) -> None:
        for key, names in self.keys().items():
            self.owner._swap(key, {**self.owner.head(key), **dict.fromkeys(names, self.txn)})

    def undo(self) -> None:
        for name in self.names:
            path, files = self.owner._path(f"{name}/txn={self.txn}")
            files.delete(path, True)


def indexed(rows: DataFrame, columns: list[str], group_bytes: int | None = None) -> DataFrameWriter:
    """A writer of Parquet files with Bloom filters on the columns, so that a scan for one value passes
    over the row groups that lack it, also where their smallest and largest values enclose it."""
    writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as a column's different values ask for
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer if group_bytes is None else writer.option("parquet.block.size", group_bytes)


def read_glossaries(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Glossaries, one JSON file each; files that can't be read are left out."""
    rows = spark.read.schema(GLOSSARY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where("glossary_id is not null").orderBy("glossary_id")
    return rows if scope is None else rows.where(F.col("scope") == scope)


def glossary_entries(glossaries: DataFrame) -> DataFrame:
    each = glossaries.select("glossary_id", F.explode("entries").alias("e")).select("glossary_id", F.col("e.id").alias("entry_id"), "e.*")
    return each.drop("id")


def imported(glossaries: DataFrame, new_id: bool = True) -> DataFrame:
    """Glossaries as they come in: under a new id, made of the old one, unless it is to be kept."""
    return glossaries.withColumn("glossary_id", F.substring(F.sha2(F.concat(F.lit("import:"), "glossary_id"), 256), 1, 32)) if new_id else glossaries


class Glossaries:
    """Glossaries in a folder, one JSON file each: small documents that people edit."""

    def __init__(self, folder: str):
        self.folder = folder

    def _file(self, glossary_id: str) -> str:
        return os.path.join(self.folder, f"{glossary_id}.json")

    def ids(self) -> list[str]:
        return sorted(n[:-5] for n in os.listdir(self.folder) if n.endswith(".json")) if os.path.isdir(self.folder) else []

    def load(self, glossary_id: str) -> dict:
        with open(self._file(glossary_id), encoding="utf-8") as f:
            return json.load(f)

    def save(self, glossary: dict, path: str | None = None) -> None:
        os.makedirs(self.folder, exist_ok=True)
        part = f"{path or self._file(glossary['glossary_id'])}.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(glossary, f, ensure_ascii=False, indent=1)
        os.replace(part, part.rpartition(".")[0])

    def create(self, name: str, scope: str = "book", entries: list[dict] = ()) -> str:
        own = uuid.uuid4().hex
        self.save({"glossary_id": own, "name": name, "scope": scope, "version": "1", "schema_version": SCHEMA_VERSION, "entries": list(entries)})
        return own

    def delete(self, glossary_id: str) -> None:
        os.remove(self._file(glossary_id))

    def export(self, glossary_id: str, path: str) -> None:
        self.save(self.load(glossary_id), path)

    def add(self, glossary_id: str, source: str, target: str, kind: str = "proper_noun", confirmed: bool = False) -> str:
        own = self.load(glossary_id)
        entry = {"id": uuid.uuid4().hex, "source": source, "target": target, "type": kind, "notes": None, "confirmed": confirmed, "variants": []}
        self.save({**own, "entries": [*own["entries"], entry]})
        return entry["id"]

    def change(self, glossary_id: str, entry_id: str, **values) -> None:
        """New values of an entry, None for no change; KeyError where there is no such entry."""
        own = self.load(glossary_id)
        found = [e for e in own["entries"] if e["id"] == entry_id]
        if not found:
            raise KeyError(entry_id)
        found[0].update({k: v for k, v in values.items() if v is not None})
        self.save(own)

    def confirm(self, glossary_id: str, entry_id: str) -> None:
        self.change(glossary_id, entry_id, confirmed=True)

    def reject(self, glossary_id: str, entry_id: str) -> None:
        self.change(glossary_id, entry_id)
        own = self.load(glossary_id)
        self.save({**own, "entries": [e for e in own["entries"] if e["id"] != entry_id]})


def write_glossaries(glossaries: DataFrame, path: str) -> None:
    glossaries.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Settings:
    # The defaults.
    source_lang: str = "ja"
    target_lang: str = "zh-Hant"
    style: str = "fiction"
    model: str = ""
    endpoint: str = "http://localhost:1234/v1"
    chunk_target_tokens: int = 1000
    carry_over_paragraphs: int = 2
    retry_count: int = 3
    retry_delay_seconds: float = 2.0
    request_timeout_seconds: float = 120.0
    request_interval_seconds: float = 0.5
    endpoint_fail_threshold: int = 3
    conversion_mode: str = "standard"
    output_dir: str = ""
    custom_prompt: str = ""

    def prompt_to_store(self, shown: str, built_in: str) -> str:
        """Empty where the prompt shown is the built-in one."""
        return "" if shown.strip() in ("", built_in.strip()) else shown


def load_settings(path: str) -> Settings:
    """Defaults where the file, or a value in it, is missing or unreadable."""
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        known = {f.name: type(f.default) for f in fields(Settings)}
        return Settings(**{k: v for k, v in given.items() if k in known and isinstance(v, (known[k], int))})
    except (OSError, ValueError, AttributeError, TypeError):
        return Settings()


def save_settings(settings: Settings, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, ensure_ascii=False, indent=1)
    os.replace(part, path)
