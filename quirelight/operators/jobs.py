"""Jobs, their chunks and the queue.

Tables are never changed in place: a change is a log of rows, or a new version of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN = ("pending", "processing", "paused", "completed_with_errors")

# Action, status before, status after; what is asked of a running engine.
TRANSITIONS = (
    ("cancel", "pending", "cancelled", None), ("cancel", "paused", "cancelled", None), ("cancel", "processing", "processing", "stop"),
    ("pause", "processing", "processing", "pause"), ("resume", "paused", "pending", None),
    ("retry", "completed_with_errors", "pending", None),
    ("remove", "pending", "removed", None), ("remove", "completed", "removed", None),
    ("remove", "completed_with_errors", "removed", None), ("remove", "cancelled", "removed", None),
)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], updatable: list[str]) -> DataFrame:
    """old with new's rows: of a key that both have, the updatable columns come from new and the
    rest from old. One row for a key on either side."""
    known = F.col("__old")
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    changed = F.col("__new").isNotNull()

    def value(c: str):
        if c in keys:
            return F.col(c)
        fresh = changed if c in updatable else changed & known.isNull()
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*(value(c) for c in old.columns))


def latest(log: DataFrame, keys: list[str], version: str, came: list[str] | None = None) -> DataFrame:
    """Of an append-only log the last version of each key; of rows of the same version the one that came first, by
    the columns came (a log whose versions repeat needs them)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), *(came or [])))
    return log.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the partitions (keys) that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def deleted(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose key (by table) is in gone (id): a delete that cascades."""
    return {name: t.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti") for name, t in tables.items()}


def with_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: job_id, new_status, new_error, finished. A null error keeps the old one."""
    rows = jobs.join(changes, "job_id", "left")
    status = F.coalesce("new_status", "status")
    return rows.withColumn("status", status).withColumn("error", F.coalesce("new_error", "error")).select(*jobs.columns)


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("status").isin("pending", "failed"))


def progress(chunks: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, total, completed, failed, percent)."""
    counts = chunks.groupBy(job).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    percent = F.expr("(100 * (completed + failed)) div greatest(total, 1)").cast("int")
    return counts.withColumn("percent", percent)


def final_status(jobs: DataFrame, chunks: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, final_status): a job without chunks, or without failed ones, is completed."""
    counts = progress(chunks, job)
    failed = F.coalesce("failed", F.lit(0)) > 0
    status = F.when(failed, "completed_with_errors").otherwise("completed")
    return jobs.select(job).join(counts, job, "left").select(job, status.alias("final_status"))


def job_list(jobs: DataFrame, books: DataFrame) -> DataFrame:
    """Jobs, newest first, with their book's title or else their own id."""
    title = F.coalesce("title", F.col("job_id").cast("string")).alias("title")
    rows = jobs.join(books.select("book_id", "title"), "book_id", "left")
    return rows.select("job_id", title, "status", "created_at").orderBy(F.desc("created_at"), "job_id")


def incomplete(jobs: DataFrame, books: DataFrame) -> DataFrame:
    """What a restart takes up again."""
    return job_list(jobs.where(F.col("status").isin(*OPEN)), books)


def streaks(events: DataFrame, by: list[str], order: list[str], bad: str = "bad") -> DataFrame:
    """Adds streak: how many rows in a row, up to this one, are bad; 0 for a good one."""
    at = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("__run", F.sum((~F.col(bad)).cast("int")).over(at))
    inside = Window.partitionBy(*by, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.col(bad).cast("int")).over(inside)).drop("__run")


def broken(events: DataFrame, by: list[str], order: list[str], threshold: int = 3) -> DataFrame:
    """by, and the place of the first row whose streak reaches threshold: where the breaker opens."""
    rows = streaks(events, by, order).where(F.col("streak") >= threshold)
    return rows.groupBy(*by).agg(F.min(F.struct(*order)).alias("first")).select(*by, "first.*")


def retry_schedule(policies: DataFrame) -> DataFrame:
    """policies: policy, attempts, delay. (policy, attempt from 1, wait before it, waited in all):
    the wait grows by delay each time; without attempts there is one."""
    each = policies.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "attempts"))))
    wait = (F.col("attempt") - 1) * F.col("delay")
    order = Window.partitionBy("policy").orderBy("attempt")
    return each.select("policy", "attempt", wait.alias("wait"), F.sum(wait).over(order).alias("waited"))


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "action string, status string, new_status string, asked string")


def moved(items: DataFrame, actions: DataFrame) -> DataFrame:
    """items: item_id, status, error; actions: item_id, action. Adds new_status, asked, allowed and
    new_error (a retry clears it). What the table doesn't allow changes nothing."""
    rows = items.join(actions, "item_id").join(F.broadcast(transitions(items.sparkSession)), ["action", "status"], "left")
    allowed = F.col("new_status").isNotNull()
    error = F.when(allowed & (F.col("action") == "retry"), None).otherwise(F.col("error"))
    return rows.select(
        "item_id", "action", "status", F.coalesce("new_status", "status").alias("new_status"), "asked",
        allowed.alias("allowed"), error.alias("new_error"),
    )


def applied(blocks: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """blocks with each text replaced by its translation where there is one."""
    new = translations.select(*keys, F.col("text").alias("__text"))
    return blocks.join(new, keys, "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")
