"""Chunks through a translator: sequential in a chapter, parallel over chapters, resumable."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Retryable(Exception):
    """A failure that another attempt may mend: time-outs, lost connections, overload."""


class Translator(Protocol):
    def translate(self, payload: dict) -> dict:
        """{"translations": [{"id", "text"}]} for payload's to_translate; may raise."""


class LostConnection(Retryable):
    """The service can't be reached: what the breaker counts."""


class Endpoint:
    """An OpenAI-compatible chat endpoint."""

    def __init__(self, endpoint: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = base_url(endpoint) + "/chat/completions", model, timeout

    def translate(self, payload: dict) -> dict:
        said = {k: v for k, v in payload.items() if k != "prompt"}
        messages = [{"role": "system", "content": payload.get("prompt") or ""}, {"role": "user", "content": json.dumps(said, ensure_ascii=False)}]
        body = {"model": self.model, "temperature": 0.3, "response_format": {"type": "json_object"}, "messages": messages}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(json.load(reply)["choices"][0]["message"]["content"])
        except urllib.error.HTTPError as e:
            raise (Retryable if e.code == 429 or e.code >= 500 else ValueError)(f"status {e.code}") from e
        except TimeoutError as e:
            raise Retryable("timed out") from e
        except urllib.error.URLError as e:
            raise (Retryable("timed out") if isinstance(e.reason, TimeoutError) else LostConnection(f"Connection: {e.reason}")) from e


class UpperCase:
    """A translator that needs no service."""

    def translate(self, payload: dict) -> dict:
        return {"translations": [{"id": b["id"], "text": b["text"].upper()} for b in payload["to_translate"]]}


def base_url(given: str | None, default: str = "http://localhost:1234") -> str:
    """An endpoint's address, ending in /v1."""
    own = (given or "").strip().rstrip("/") or default
    return own if own.endswith("/v1") else own + "/v1"


def with_retry(call: Callable[[], dict], attempts: int = 3, delay: float = 2.0, sleep=time.sleep) -> tuple[dict, int]:
    """call's result and how many attempts it took; waits delay, 2 * delay, ... between them. There
    is one attempt at least."""
    for i in range(max(1, attempts)):
        try:
            return call(), i + 1
        except Retryable:
            if i + 1 >= attempts:
                raise
            sleep(delay * (i + 1))
    raise AssertionError


def reply_errors(ids: list[str], reply: object) -> list[str]:
    """The reply contract, for one reply in the worker (see validate.reply_findings for tables)."""
    items = reply.get("translations") if isinstance(reply, dict) else None
    if not isinstance(items, list):
        return ["no_translations"]
    given = [x.get("id") if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"].strip() else None for x in items]
    out = ["bad_item"] * given.count(None) + ["duplicate_id"] * (len(given) - len(set(given)))
    out += ["missing_ids"] * bool(set(ids) - set(given)) + ["unknown_ids"] * bool(set(given) - {None} - set(ids))
    return out


CONTEXT = "array<struct<id:string,source:string,translated:string>>"


def with_context(chunks: DataFrame, results: DataFrame, carry: int = 2) -> DataFrame:
    """Adds carry_over: the last blocks of the chunk before in the chapter, with the translations
    that results (book_id, chapter_id, chunk, status, translations) has for them, whichever run
    made these. Without a chunk before, or with a carry of 0, it is empty."""
    keys = ["book_id", "chapter_id", "chunk"]
    done = results.where("status = 'completed'").select(*keys, F.col("translations").alias("__done"))
    order = Window.partitionBy("book_id", "chapter_id").orderBy("chunk")
    rows = chunks.join(done, keys, "left").withColumn("__blocks", F.lag("blocks").over(order)).withColumn("__done", F.lag("__done").over(order))
    tail = F.when(F.size("__blocks") > carry, F.slice("__blocks", -carry, carry)).otherwise(F.col("__blocks")) if carry else F.lit(None)
    shown = F.transform(tail, lambda b: F.struct(b["id"].alias("id"), b["text"].alias("source"), F.try_element_at("__done", b["id"]).alias("translated"))) if carry else tail
    return rows.withColumn("carry_over", F.coalesce(shown.cast(CONTEXT), F.array().cast(CONTEXT))).drop("__blocks", "__done")


def relevant_entries(glossary: list[dict], texts: list[str]) -> list[dict]:
    """Entries of which the source or a variant stands in the texts, each source once."""
    whole, out = "\n".join(texts), {}
    for e in glossary:
        if e.get("source") and any(n and n in whole for n in (e["source"], *(e.get("variants") or []))):
            out.setdefault(e["source"], {k: e[k] for k in ("source", "target", "type", "notes") if e.get(k)})
    return list(out.values())


def run_chunks(
    chunks: DataFrame, translator: Callable[[], Translator] = UpperCase, carry: int = 2, attempts: int = 3, delay: float = 2.0,
    interval: float = 0.0, config: dict | None = None, lost: int = 0, most: int | None = None,
) -> DataFrame:
    """chunks: book_id, chapter_id, chunk, blocks array<struct<id,text>>, and perhaps carry_over (see
    :func:`with_context`). A row for each chunk: book_id, chapter_id, chunk, status, attempts,
    error, translations map<string,string>, ended (seconds since 1970).

    A translator is sent to_translate, carry_over, and of config the languages, style, prompt and
    those entries of the glossary that the chunk's texts hold. The last blocks of a chapter's
    chunk, and their translations if it succeeded, are the next one's context; behind a gap it is
    the chunk's own carry_over. A failed chunk doesn't stop the chapter; `most` lost connections in
    a row do (there were `lost` of them before), and what follows gives no row. translator is made
    once in each group, which waits interval seconds behind each chunk."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    given = dict(config or {})
    glossary = given.pop("glossary", [])

    def chapter(rows: pd.DataFrame) -> pd.DataFrame:
        own, context, before, out, gone = translator(), [], None, [], lost
        for row in rows.sort_values("chunk").itertuples():
            blocks = [{"id": b["id"], "text": b["text"]} for b in row.blocks]
            if before is None or before != row.chunk - 1:
                listed = getattr(row, "carry_over", None)
                context = [{k: b[k] for k in ("id", "source", "translated")} for b in (listed if listed is not None else [])]
            payload = {**given, "glossary": relevant_entries(glossary, [b["text"] for b in blocks]), "to_translate": blocks, "carry_over": context}
            done, error, n, status = {}, None, max(1, attempts), "failed"
            try:
                reply, n = with_retry(lambda p=payload: own.translate(p), attempts, delay)
                wrong = reply_errors([b["id"] for b in blocks], reply)
                if wrong:
                    error = "; ".join(wrong)
                else:
                    done, status = {x["id"]: x["text"] for x in reply["translations"]}, "completed"
                gone = 0
            except Exception as e:  # noqa: BLE001  any failure of a call is the chunk's result
                error, gone = f"{type(e).__name__}: {e}", gone + 1 if isinstance(e, LostConnection) else 0
            before = row.chunk
            context = [{"id": b["id"], "source": b["text"], "translated": done.get(b["id"])} for b in blocks[len(blocks) - carry if carry and len(blocks) > carry else 0 :]] if carry else []
            out.append((row.book_id, row.chapter_id, row.chunk, status, n, error, done, time.time()))
            if most is not None and gone >= most:
                break
            if interval:
                time.sleep(interval)
        return pd.DataFrame(out, columns=["book_id", "chapter_id", "chunk", "status", "attempts", "error", "translations", "ended"])

    schema = f"book_id {kinds['book_id']}, chapter_id string, chunk int, status string, attempts int, error string, translations map<string,string>, ended double"
    return chunks.groupBy("book_id", "chapter_id").applyInPandas(chapter, schema)


def to_do(chunks: DataFrame, results: DataFrame, only_failed: bool = False) -> DataFrame:
    """Chunks that a resumed run takes up: all but the completed; or the failed alone."""
    keys = ["book_id", "chapter_id", "chunk"]
    if only_failed:
        return chunks.join(results.where("status = 'failed'").select(*keys), keys, "left_semi")
    return chunks.join(results.where("status = 'completed'").select(*keys), keys, "left_anti")


def chunked(blocks: DataFrame, target: int = 1000) -> DataFrame:
    """blocks: book_id, chapter_id, ord, block_id, text. Chunks with their blocks."""
    from quirelight.operators.books import chunks

    rows = chunks(blocks, ["book_id", "chapter_id"], target)
    each = rows.select("book_id", "chapter_id", "chunk", F.posexplode("block_ids").alias("n", "block_id"))
    texts = each.join(blocks.select("book_id", "chapter_id", "block_id", "text"), ["book_id", "chapter_id", "block_id"])
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("block_id").alias("id"), "text")))
    plain = F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return texts.groupBy("book_id", "chapter_id", "chunk").agg(plain.alias("blocks"))


def translated_books(spark: SparkSession, d: str) -> DataFrame:
    from quirelight.operators.jobs import applied
    from quirelight.plans.catalogue import conv_blocks

    blocks = conv_blocks(spark, d)
    done = run_chunks(chunked(blocks.where("type = 'paragraph'"), 400)).select("book_id", F.explode("translations").alias("block_id", "text"))
    out = applied(blocks.withColumnRenamed("text", "before").withColumn("text", F.lit(None).cast("string")), done, ["book_id", "block_id"])
    same = F.col("text") == F.upper("before")
    return out.groupBy("book_id").agg(F.count("*").alias("n_blocks"), F.count_if(same).alias("n_translated"))
