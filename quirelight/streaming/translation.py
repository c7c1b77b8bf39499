"""Translation as a stream of chunks: each is answered once, however often the run is killed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.operators import translate
from quirelight.sources.store import root, saved

KEYS = ["book_id", "chapter_id", "chunk"]
RESULTS = "book_id {book}, chapter_id string, chunk int, status string, attempts int, error string, translations map<string,string>, ended double, batch int"


#: Batches of a feed that is drained at once, and chunks in a file of it at most.
BATCHES, MOST_IN_FILE = 6, 1 << 16


class Feed:
    """A folder of chunks to be translated, and what has become of them.

    queue: files of at most so many chunks, in the chapters' order: a chapter's next chunk is never in an earlier
    file. results: one folder for each batch of the stream, written whole; a batch that was killed
    is run again under its number, and its folder replaced. state: which files a batch has, and
    which batches have ended. So no chunk is lost, and none is in the results twice."""

    def __init__(self, spark: SparkSession, folder: str, book: str = "string"):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), RESULTS.format(book=book)

    def offer(self, chunks: DataFrame, per_file: int = 64) -> None:
        """chunks: KEYS, blocks. A wave, the nth chunks of all chapters, is written behind the one before; more than
        per_file of them make several files."""
        nth = F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("chunk"))
        rows = saved(chunks.select(*KEYS, "blocks").withColumn("__wave", nth), "feed")
        rows.drop("__wave").write.mode("append").parquet(f"{self.folder}/chunks")
        for wave in range(1, (rows.agg(F.max("__wave")).first()[0] or 0) + 1):
            now = rows.where(F.col("__wave") == wave).select(*KEYS)
            now.write.mode("append").option("maxRecordsPerFile", per_file).parquet(f"{self.folder}/queue")

    def results(self, before: int | None = None) -> DataFrame:
        """The log of answers, of batches before the given one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/results")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/results")
        return rows if before is None else rows.where(F.col("batch") < before)

    def run(
        self, translator: Callable[[], translate.Translator] = translate.UpperCase, files: int = 1, carry: int = 2, attempts: int = 3, delay: float = 2.0,
        config: dict | None = None, on_batch: Callable[[int], None] = lambda number: None, every: str | None = None,
    ) -> None:
        """Translates all that is offered. files (of per_file chunks) are taken by a batch, and with `every`
        (an interval) a batch begins that often, until the stream is stopped: that is the rate
        limit. A chunk's context is the chunk before it, with its translation if that is done."""
        chunks = self.spark.read.parquet(f"{self.folder}/chunks")
        queue = self.spark.readStream.schema(chunks.select(*KEYS).schema).option("maxFilesPerTrigger", files).parquet(f"{self.folder}/queue")

        def write(batch: DataFrame, number: int) -> None:
            # Of the other chapters no context is needed.
            own = chunks.join(batch.select("book_id", "chapter_id").distinct(), ["book_id", "chapter_id"], "left_semi")
            ready = translate.with_context(own, self.results(before=number), carry).join(batch.dropDuplicates(KEYS), KEYS, "left_semi")
            done = translate.run_chunks(ready, translator, carry, attempts, delay, 0.0, config)
            done.write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")
            on_batch(number)

        writer = queue.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/state")
        (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start().awaitTermination()


class Killed(RuntimeError):
    pass


def drained_translation(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, n_blocks, n_translated, n_twice) of conversations whose chunks go through the stream, which is killed twice: behind a
    batch's results, before the batch is marked as ended."""
    from quirelight.plans.catalogue import conv_blocks

    blocks = conv_blocks(spark, d).where("type = 'paragraph' and trim(text) <> ''")
    feed = Feed(spark, f"{root(spark)}/quirelight/translation-{uuid.uuid4().hex}", "long")
    chunks = saved(translate.chunked(blocks, 400), "chunks")
    # Here no service asks for a rate, so a batch is a share of the feed, whatever its size.
    feed.offer(chunks, per_file=min(MOST_IN_FILE, max(1, chunks.count() // (2 * BATCHES))))
    files = max(1, -(-len(spark.read.parquet(f"{feed.folder}/queue").inputFiles()) // BATCHES))
    kills = {0, 2}

    def kill(number: int) -> None:
        if number in kills:
            kills.remove(number)
            raise Killed(str(number))

    for _ in range(len(kills) + 1):
        try:
            feed.run(files=files, on_batch=kill)
        except Exception as e:  # noqa: BLE001  the kill comes back as the stream's failure
            if "Killed" not in str(e):
                raise
    done = feed.results().where("status = 'completed'").select("book_id", F.explode("translations").alias("block_id", "translated"))
    met = blocks.select("book_id", "block_id", "text").join(done, ["book_id", "block_id"], "left")
    each = met.groupBy("book_id", "block_id").agg(F.count("translated").alias("n"), F.bool_and(F.col("translated") == F.upper("text")).alias("good"))
    return each.groupBy("book_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("good") & (F.col("n") >= 1)).alias("n_translated"), F.count_if(F.col("n") > 1).alias("n_twice"))
