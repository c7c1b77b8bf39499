"""Chat formatting in budgeted windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.llm.shared import table

#: Tokens of a window, of repeated history, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 256, 4
#: Control strings; all begin with <|, which no escaped text holds.
FRESH, AGAIN, END, LINE = "<|im_start|>", "<|im_again|>", "<|im_end|>\n", "<|im_line|>"


def escaped(text: Column) -> Column:
    """text without control strings: back-slashes doubled, then <| written as <, back-slash, |."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conversations: conv_id, turn, role, text, a row for each turn. Returns a row for each
    window: conv_id, window int, text, loss array<struct<start, end>> (code points of text, end
    exclusive).

    Turns stand in the order of turn (null first; ties by role, then text); null roles and texts
    are empty. Prefix sums of turn tokens (a quarter of the characters, rounded up, and 4 for
    the marks) choose spans of whole turns: a window goes on while its own turns fit the budget
    without the system turn and the history. A turn that alone is larger gets a window of its
    own. A conversation's first turn, if a system turn, stands again at the head of each later
    window, then as many earlier turns as fit history; both are marked as repeated. The loss
    covers the escaped texts of the window's own assistant turns, so each stands under it once.
    A row without conv_id is a conversation of its own; an empty table has no windows."""
    return _windows(conversations, budget, history).drop("__lone")


def _windows(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """The windows with __lone: a number for each conversation that has no conv_id, else null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", lone.alias("__lone"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("role_out", _role(F.col("role"))).withColumn("text_out", escaped(F.col("text")))
    rows = rows.withColumn("tokens", (F.ceil(F.length("text") / 4) + MARKS).cast("long"))
    order = Window.partitionBy("conv_id", "__lone").orderBy("turn", "role", "text")
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("upto", upto)
    one = F.struct("nth", "role", "text", "role_out", "text_out", "upto")
    convs = rows.groupBy("conv_id", "__lone").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    sums = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("turns", lambda t: t["upto"]))
    has_system = F.lower(F.element_at("turns", 1)["role"]) == "system"
    convs = convs.withColumn("sums", sums).withColumn("system", has_system)
    system = F.when(F.col("system"), F.element_at("sums", 2)).otherwise(0)
    convs = convs.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - system))
    # The first turn (from 0) of each window.
    begin = F.struct(F.array(F.lit(0)).alias("first"), F.lit(0).cast("bigint").alias("base"))

    def step(acc: Column, i: Column) -> Column:
        over = (F.element_at("sums", i + 1) - acc["base"] > F.col("room")) & (i - 1 > F.element_at(acc["first"], -1))
        first = F.when(over, F.concat(acc["first"], F.array(i - 1))).otherwise(acc["first"])
        base = F.when(over, F.element_at("sums", i)).otherwise(acc["base"])
        return F.struct(first.alias("first"), base.alias("base"))

    firsts = F.aggregate(F.sequence(F.lit(1), F.size("turns")), begin, step, lambda acc: acc["first"])
    convs = convs.withColumn("firsts", firsts)

    def span(first: Column, w: Column) -> Column:
        stop = F.coalesce(F.get("firsts", w + 1), F.size("turns"))
        # Earlier turns whose tokens up to this window's first fit history, without the system turn.
        # A turn has MARKS tokens at least, so no more than history / MARKS of them can.
        limit = F.element_at("sums", first + 1) - F.lit(history)
        lowest = F.when(F.col("system"), 1).otherwise(0)
        fits = F.filter(F.sequence(F.greatest(F.lit(0), first - history // MARKS), first), lambda j: (j >= lowest) & (F.element_at("sums", j + 1) >= limit))
        since = F.when(first > 0, F.coalesce(F.array_min(fits), first)).otherwise(first)
        head = F.when((first > 0) & F.col("system"), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        return F.struct(
            w.alias("window"),
            F.concat(head, F.slice("turns", since + 1, first - since)).alias("again"),
            F.slice("turns", first + 1, stop - first).alias("own"),
        )

    out = convs.select("conv_id", "__lone", F.explode(F.transform("firsts", span)).alias("w")).select("conv_id", "__lone", "w.*")
    line = lambda mark: lambda t: F.concat(F.lit(mark), t["role_out"], F.lit("\n"), t["text_out"], F.lit(END))
    before, own = F.array_join(F.transform("again", line(AGAIN)), ""), F.array_join(F.transform("own", line(FRESH)), "")
    out = out.withColumn("before", before).withColumn("rendered", own)
    start = F.struct(
        F.length("before").cast("bigint").alias("pos"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")
    )

    def mask(acc: Column, t: Column) -> Column:
        at = acc["pos"] + len(FRESH) + F.length(t["role_out"]) + 1
        end = at + F.length(t["text_out"])
        mine = F.array(F.struct(at.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        spans = F.when(F.lower(t["role"]) == "assistant", F.concat(acc["out"], mine)).otherwise(acc["out"])
        return F.struct((end + len(END)).cast("bigint").alias("pos"), spans.alias("out"))

    loss = F.aggregate("own", start, mask, lambda acc: acc["out"])
    return out.select("conv_id", "__lone", "window", F.concat("before", "rendered").alias("text"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """array<struct<role, text>>: the turns that a window's text shows as its own, read back."""
    mark = lambda s: s.replace("|", r"\|").replace("\n", r"\n")
    pattern = F.lit(rf"(?s){mark(FRESH)}(.*?)\n(.*?){mark(END)}")
    each = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("role"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("text")
    )
    plain = lambda r: unescaped(F.replace(r, F.lit(LINE), F.lit("\n")))
    return F.transform(each, lambda x: F.struct(plain(x["role"]).alias("role"), unescaped(x["text"]).alias("text")))


def targets_of(text: Column, loss: Column) -> Column:
    """array<string>: the texts under the loss mask, unescaped."""
    return F.transform(loss, lambda x: unescaped(F.substring(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    roles = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    two = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles)
    two = two.select("conv_id", F.col("turn").cast("long"), "role", said.alias("text"))
    out = _windows(rows.unionByName(two), BUDGET, HISTORY)
    read = out.select(
        "conv_id", "__lone", "window", turns_of(F.col("text")).alias("turns"), F.length("text").alias("n"),
        F.array_join(targets_of(F.col("text"), F.col("loss")), "").alias("target"),
    )
    whole = read.groupBy("conv_id", "__lone").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "target"))).alias("w"), F.sum("n").alias("formatted_chars")
    )
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = whole.withColumn("turns", turns).withColumn("target", F.array_join(F.transform("w", lambda x: x["target"]), ""))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("target").cast("long").alias("loss_chars"), F.sha2(F.col("target").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
#: Lengths alone tell how long the windows are: a line is marks, role, line end and text.
OP7_SQL = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS t, (length(text) + 3) // 4 + 4 AS tokens,
    {len(FRESH) + 1 + len(END)} + length(replace({_ESCAPED.format("role")}, chr(10), '{LINE}')) + length({_ESCAPED.format("text")}) AS line FROM said),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY t) AS upto FROM turns),
convs AS (
  SELECT conv_id, line AS head, lower(role) = 'system' AS system, greatest(1, {1024 - 256} - CASE WHEN lower(role) = 'system' THEN tokens ELSE 0 END) AS room
  FROM summed WHERE t = 0),
walk AS (
  SELECT conv_id, t, 0::BIGINT AS first, 0::HUGEINT AS base FROM summed WHERE t = 0
  UNION ALL
  SELECT w.conv_id, s.t, CASE WHEN s.upto - w.base > c.room AND s.t > w.first THEN s.t ELSE w.first END,
    CASE WHEN s.upto - w.base > c.room AND s.t > w.first THEN s.upto - s.tokens ELSE w.base END
  FROM walk w JOIN summed s ON s.conv_id = w.conv_id AND s.t = w.t + 1 JOIN convs c ON c.conv_id = w.conv_id),
starts AS (SELECT DISTINCT conv_id, first, base FROM walk WHERE first > 0),
again AS (
  SELECT x.conv_id, sum(s.line) AS n FROM starts x JOIN convs c ON c.conv_id = x.conv_id JOIN summed s ON s.conv_id = x.conv_id
    AND s.t < x.first AND (s.t >= CASE WHEN c.system THEN 1 ELSE 0 END AND s.upto - s.tokens >= x.base - 256 OR c.system AND s.t = 0)
  GROUP BY x.conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(s.role || chr(10) || s.text || chr(10), '' ORDER BY s.t)) AS turns_sha256,
  sum(CASE WHEN lower(s.role) = 'assistant' THEN length(s.text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN lower(s.role) = 'assistant' THEN s.text END, '' ORDER BY s.t), '')) AS loss_sha256,
  (sum(s.line) + coalesce(any_value(a.n), 0))::BIGINT AS formatted_chars
FROM summed s LEFT JOIN again a ON a.conv_id = s.conv_id GROUP BY s.conv_id
"""
