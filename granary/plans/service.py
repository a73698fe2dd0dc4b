"""The engine's API: one function for each request a client can make, over tables in a folder. Functions give DataFrames or plain values."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import providers, rules
from granary.operators import context, feedback, knowledge, retrieval
from granary.plans import chat
from granary.sources import readers


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


class Service:
    """kb: the knowledge base with pos and embedding. Tables of items, history, sessions and feedback are versions in folders; a change writes the next version and then points to it, unless another writer has changed the table since it was read (readers.Conflict). What only adds rows is then tried again."""

    SCHEMAS = {"items": knowledge.ITEMS, "history": knowledge.HISTORY, "sessions": "request_id string, query string, reply string, trace_json string, top1_intent string, latency_ms double, answer_source string, created_at timestamp", "feedback": "id long, request_id string, query string, reply string, helpful boolean, reason string, expected_reply string, trace_json string, created_at timestamp, top1_intent string, latency_ms double, answer_source string, failure_stage string, exported boolean"}

    def __init__(self, spark: SparkSession, folder: str, kb: DataFrame, embed=None, generate=None, settings: readers.Settings | None = None) -> None:
        self.spark, self.folder, self.base, self._read = spark, folder, kb, threading.local()
        self.embed, self.generate, self.settings = embed or providers.embedder(), generate, settings or readers.Settings.from_env()

    # tables

    def _current(self, name: str) -> DataFrame | None:
        found = readers.pointer(self.spark, f"{self.folder}/{name}")
        setattr(self._read, name, found[0] if found else 0)  # what this thread's next change of the table is based on
        return self.spark.read.parquet(found[1]) if found else None

    def table(self, name: str) -> DataFrame:
        found = self._current(name)
        return self.spark.createDataFrame([], self.SCHEMAS[name]) if found is None else found

    def put(self, name: str, rows: DataFrame) -> None:
        expected = self._read.__dict__.pop(name, None)
        readers.swap(rows, f"{self.folder}/{name}", uuid.uuid4().hex, expected)

    def add(self, name: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> None:
        """A change that only adds rows, made again from the newer table if another writer was first."""
        for k in range(tries):
            try:
                return self.put(name, change(self.table(name)))
            except readers.Conflict:
                if k == tries - 1:
                    raise

    def kb(self) -> DataFrame:
        found = self._current("kb")
        return self.base if found is None else found

    def asked(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string").withColumn("q_embedding", self.embed("query"))

    # chat and retrieval

    def chat_prompt(self, queries: list[str], metadata: DataFrame | None = None) -> DataFrame:
        """Answers with prompts, traces and diagnostics; each is kept as a session. Every query of a batch waits for the whole batch, so that time is its latency."""
        started = time.perf_counter()
        rows = chat.answers(self.asked(queries), self.kb(), self.settings, self.generate, metadata).withColumn("request_id", F.expr("replace(uuid(), '-', '')")).cache()
        rows.count()
        latency = round((time.perf_counter() - started) * 1000, 2)
        rows = rows.withColumn("trace", F.col("trace").withField("request_id", F.col("request_id")).withField("latency_ms", F.lit(latency)))
        at = F.lit(_now()).cast("timestamp")
        self.add("sessions", lambda old: feedback.upsert(old, chat.session_rows(rows, F.col("request_id"), at, latency)))
        return rows

    def retrieval_search(self, query: str, limit: int = 3, min_score: float | None = None) -> DataFrame:
        if not 1 <= limit <= 20 or not 0 <= (min_score or 0) <= 1:
            raise ValueError("limit is 1 to 20, min_score 0 to 1")
        found = retrieval.search(self.asked([query]), self.kb(), limit, self.settings.min_vector_score if min_score is None else min_score, weight=self.settings.model_rerank_weight)
        return retrieval.items(found)

    def prompt_preview(self, query: str, limit: int = 3) -> DataFrame:
        """The evidence and the prompt of a query; scores but the two of ranking are zero in its items."""
        items = self.retrieval_search(query, limit).withColumns({c: F.lit(0.0) for c in ("vector_score", "keyword_bonus", "direction_penalty", "model_rerank_score")})
        return context.prompts(self.asked([query]), context.context_items(items, limit))

    def retrieval_config(self) -> dict:
        return self.settings.as_dict()

    def model_info(self) -> dict:
        s = self.settings
        return {"embedding_model": s.embedding_model_name, "reranker_model": s.reranker_model_name, "generation_provider": s.generation_provider, "status": "ok"}

    def intent_hint(self, query: str) -> str:
        return self.spark.range(1).select(rules.intent_hint(F.lit(query)).alias("i")).first().i

    # examples

    def categories(self) -> list[str]:
        return [r.category for r in knowledge.categories(self.kb()).orderBy("category").collect()]

    def examples_by_category(self, category: str, limit: int = 10) -> DataFrame:
        found = knowledge.of_category(self.kb(), category, limit)
        if found.isEmpty():
            raise KeyError(f"category not found: {category}")
        return found

    def search_examples(self, keyword: str, limit: int = 10) -> DataFrame:
        return knowledge.containing(self.kb(), keyword, limit)

    # knowledge

    def create_item(self, item: dict) -> int:
        return self._edit(None, item)

    def update_item(self, item_id: int, item: dict) -> int:
        return self._edit(knowledge.get(self.table("items"), item_id).first().base_id, item)

    def _edit(self, base: str | None, item: dict) -> int:
        items = self.table("items")
        new = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        base = base or f"kb_{uuid.uuid4().hex[:12]}"
        row = self.spark.createDataFrame([(new, base, *(item.get(f, "") for f in knowledge.FIELDS))], "id long, base_id string, " + ", ".join(f"{f} string" for f in knowledge.FIELDS)).withColumn("at", F.lit(_now()).cast("timestamp"))
        self.put("items", knowledge.next_versions(items, row))
        return new

    def review_item(self, item_id: int, status: str, note: str = "") -> None:
        self.put("items", knowledge.review(self.table("items"), item_id, status, note, F.lit(_now()).cast("timestamp")))

    def archive_item(self, item_id: int) -> None:
        self.put("items", knowledge.archive(self.table("items"), item_id, F.lit(_now()).cast("timestamp")))

    def items(self, **filters) -> tuple[int, DataFrame]:
        return knowledge.page(self.table("items"), **filters)

    def export_approved(self) -> tuple[int, str]:
        lines = [r.line for r in knowledge.export_approved(self.table("items")).collect()]
        return len(lines), "\n".join(lines)

    def publish_approved(self) -> str:
        """Appends the approved items to the knowledge base, embeds them, and points to the new base; on any failure the old one is the current one again. Gives the status."""
        items, old, run = self.table("items"), self.kb(), f"pub_{datetime.now(timezone.utc):%Y%m%d%H%M%S}_{uuid.uuid4().hex[:8]}"
        ids = [r.id for r in items.filter("status = 'approved'").select("id").orderBy("id").collect()]
        if not ids:
            return self._record(run, "publish", "skipped", note="no approved knowledge")
        backup, base = None, self._read.kb
        try:
            backup = readers.swap(old, f"{self.folder}/kb", f"backup_{run}", base)
            self._read.kb = base + 1
            after, merged = knowledge.publish(items, old)
            new = merged.withColumn("embedding", F.coalesce("embedding", self.embed(retrieval.document_text(*[F.col(c) for c in ("category", "intent", "question", "answer")]))))
            self.put("kb", new)
            self.put("items", after)
        except Exception as e:
            if backup:
                self._restore(backup, base + 2)
            self._record(run, "publish", "failed", note=str(e)[:500])
            raise
        return self._record(run, "publish", "succeeded", merged_count=len(ids), item_ids=ids, backup_path=backup)

    def _restore(self, backup: str, ours: int) -> None:
        """Points to the old base again where this publication made the current one; what another writer made stays."""
        try:
            readers.point(self.spark, f"{self.folder}/kb", backup, ours)
        except readers.Conflict:
            return

    def rollback_latest(self) -> str:
        record = knowledge.latest_published(self.table("history")).first()
        if record is None:
            raise ValueError("no succeeded publish record to rollback")
        self.put("kb", self.spark.read.parquet(record.backup_path))
        self.put("items", knowledge.rolled_back(self.table("items"), self.table("history")))
        return self._record(f"rollback_{uuid.uuid4().hex[:8]}", "rollback", "succeeded", merged_count=record.merged_count, item_ids=list(record.item_ids), backup_path=record.backup_path, note=f"rollback {record.publish_id}")

    def publish_history(self, limit: int = 20) -> DataFrame:
        return knowledge.listed(self.table("history"), limit)

    def _record(self, run: str, action: str, status: str, **values) -> str:
        values = {"created_at": datetime.now(timezone.utc).replace(tzinfo=None)} | values
        self.add("history", lambda old: knowledge.recorded(old, self.spark, publish_id=run, action=action, status=status, **values))
        return status

    # feedback and operation

    def add_feedback(self, payload: dict) -> int:
        new = 0

        def added(old: DataFrame) -> DataFrame:
            nonlocal new
            new = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
            row = self.spark.createDataFrame([(new, payload.get("request_id", ""), payload.get("query", ""), payload.get("reply", ""), bool(payload.get("helpful")), payload.get("reason", ""), payload.get("expected_reply", ""), payload.get("trace_json", "{}"))], "id long, request_id string, query string, reply string, helpful boolean, reason string, expected_reply string, trace_json string").withColumn("created_at", F.lit(_now()).cast("timestamp"))
            return old.unionByName(feedback.feedback_rows(row))

        self.add("feedback", added)
        return new

    def recent_feedback(self, **filters) -> DataFrame:
        return feedback.recent(self.table("feedback"), **filters)

    def export_eval_case(self, feedback_id: int) -> dict:
        case, marked = feedback.exported(self.table("feedback"), feedback_id)
        out = case.first().asDict()
        self.put("feedback", marked)
        return out

    def ops_metrics(self) -> dict:
        """Metrics of the sessions, by their traces."""
        t = F.from_json("trace_json", "degraded boolean, failure_stage string, retrieval_count int, reply_rules_applied boolean, used_fallback_prompt boolean")
        rows = self.table("sessions").select(F.col("created_at").alias("seq"), t.alias("t"), "answer_source", "latency_ms").select("seq", "t.*", "answer_source", "latency_ms")
        return feedback.ops_metrics(rows).first().asDict()
