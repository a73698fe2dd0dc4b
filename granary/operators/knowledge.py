"""Knowledge items as append-only versions: edits, reviews, listing, export, publishing and rollback.

Tables are immutable DataFrames: an operation gives the next state, which a store writes beside the old one and then
points to (see sinks.swap). Clock and ids are arguments, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import places

ITEMS = "id long, base_id string, version int, question string, answer string, category string, intent string, status string, review_note string, created_at timestamp, updated_at timestamp, reviewed_at timestamp"
HISTORY = "id long, publish_id string, action string, status string, merged_count int, item_ids array<long>, backup_path string, knowledge_path string, index_path string, note string, created_at timestamp"
FIELDS = ("question", "answer", "category", "intent")
#: Fixed values of a published item.
PUBLISHED = {"source": "knowledge_ops", "dialogue_type": "single_turn", "quality": "reviewed", "sentiment": "neutral"}
RISK = "待确认"


def categories(kb: DataFrame) -> DataFrame:
    """(category, n) of the base; null counts as empty."""
    return kb.groupBy(text.text("category").alias("category")).agg(F.count("*").alias("n"))


def of_category(kb: DataFrame, category: str, limit: int = 10) -> DataFrame:
    """The first rows of a category by pos."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    return kb.filter(F.col("category") == category).orderBy("pos").limit(limit)


def containing(kb: DataFrame, keyword: str, limit: int = 10, fields: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """The first rows by pos of which a field contains the keyword."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    return kb.filter(F.exists(F.array(*fields), lambda c: F.coalesce(c.contains(keyword), F.lit(False)))).orderBy("pos").limit(limit)


def next_versions(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items plus one draft for each edit (id, base_id or null for a new item, FIELDS, at): the next version of its base, 1 for a new one.

    Old rows are untouched. Several edits of a base count up in the order of their ids.
    """
    last = items.groupBy("base_id").agg(F.max("version").alias("_last"))
    new = edits.withColumn("base_id", F.coalesce("base_id", F.concat(F.lit("kb_"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 12))))
    new = new.join(last, "base_id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("base_id").orderBy("id"))).cast("int"))
    none = F.lit(None).cast("timestamp")
    return items.unionByName(new.select("id", "base_id", "version", *FIELDS, F.lit("draft").alias("status"), F.lit("").alias("review_note"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), none.alias("reviewed_at")))


def changed(items: DataFrame, ids: DataFrame, status: Column, at: Column, note: Column | None = None, only: str | None = None) -> DataFrame:
    """Items with the status, and note of a review, of the ids (id) set; `only` restricts it to items of that status."""
    hit = items.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    hit = hit.withColumn("_hit", F.col("_hit") & (F.col("status") == only)) if only else hit
    put = lambda c, v: F.when(F.col("_hit"), v).otherwise(F.col(c))
    out = hit.withColumn("status", put("status", status)).withColumn("updated_at", put("updated_at", at))
    if note is not None:
        out = out.withColumn("review_note", put("review_note", note)).withColumn("reviewed_at", put("reviewed_at", at))
    return out.select(*items.columns)


def get(items: DataFrame, item_id: int) -> DataFrame:
    found = items.filter(F.col("id") == item_id)
    if found.isEmpty():
        raise KeyError(f"knowledge item not found: {item_id}")
    return found


def review(items: DataFrame, item_id: int, status: str, note: str, at: Column) -> DataFrame:
    if status not in ("approved", "rejected"):
        raise ValueError("status must be approved or rejected")
    get(items, item_id)
    return changed(items, items.filter(F.col("id") == item_id), F.lit(status), at, F.lit(note))


def archive(items: DataFrame, item_id: int, at: Column) -> DataFrame:
    get(items, item_id)
    return changed(items, items.filter(F.col("id") == item_id), F.lit("archived"), at)


def matching(items: DataFrame, category: str | None = None, intent: str | None = None, status: str | None = None, keyword: str | None = None) -> DataFrame:
    """Items with the given values; the keyword is a LIKE pattern part in question or answer, in any case."""
    for name, value in (("category", category), ("intent", intent), ("status", status)):
        if value:
            items = items.filter(F.col(name) == value)
    return items.filter(F.col("question").ilike(f"%{keyword}%") | F.col("answer").ilike(f"%{keyword}%")) if keyword else items


def page(items: DataFrame, limit: int = 20, offset: int = 0, **filters) -> tuple[int, DataFrame]:
    """(number of all that match, one page of them, the latest first)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    found = matching(items, **filters)
    return found.count(), found.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit)


def payload(items: DataFrame) -> DataFrame:
    """Items as rows of the knowledge base."""
    return items.select(F.format_string("%s_v%d", "base_id", "version").alias("id"), F.lit(PUBLISHED["source"]).alias("source"), F.lit(PUBLISHED["dialogue_type"]).alias("dialogue_type"), F.lit(PUBLISHED["quality"]).alias("quality"), *FIELDS, F.lit(PUBLISHED["sentiment"]).alias("sentiment"), F.create_map(F.lit("risk"), F.lit(RISK)).alias("entities"), "base_id", "version")


def export_approved(items: DataFrame) -> DataFrame:
    """(base_id, version, line): JSON lines of the approved items, for writing in the order of base and version."""
    rows = payload(items.filter("status = 'approved'"))
    return rows.select("base_id", "version", F.to_json(F.struct(*[c for c in rows.columns if c not in ("base_id", "version")])).alias("line")).orderBy("base_id", "version")


def publish(items: DataFrame, kb: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items after, knowledge base after): all approved items are appended behind the last pos; strict takes the latest version of a base only.

    Without approved items both stay as they are.
    """
    approved = items.filter("status = 'approved'")
    if strict:
        approved = approved.withColumn("_n", F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc("version")))).filter("_n = 1").drop("_n")
    start = kb.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    new = places.numbered(payload(approved), ["base_id", "version"], start=start)
    merged = kb.unionByName(new.select("pos", *[c for c in new.columns if c in kb.columns and c != "pos"]), allowMissingColumns=True)
    return changed(items, approved, F.lit("published"), F.current_timestamp()), merged


def latest_published(history: DataFrame) -> DataFrame:
    """The newest succeeded publication with a backup."""
    return history.filter("action = 'publish' and status = 'succeeded' and backup_path <> ''").orderBy(F.desc("id")).limit(1)


def rolled_back(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items with those of the newest publication that are still published approved again. The record stays, so this can be repeated."""
    record = latest_published(history)
    if record.isEmpty():
        raise ValueError("no succeeded publish record to rollback")
    return changed(items, record.select(F.explode("item_ids").alias("id")), F.lit("approved"), F.current_timestamp(), only="published")


def recorded(history: DataFrame, spark: SparkSession, **values) -> DataFrame:
    """History plus one row, with the next id."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = {"id": last + 1, "merged_count": 0, "item_ids": [], "backup_path": "", "knowledge_path": "", "index_path": "", "note": "", "created_at": None} | values
    names = [c.split()[0] for c in HISTORY.split(", ")]
    return history.unionByName(spark.createDataFrame([tuple(row.get(n) for n in names)], HISTORY))


def listed(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.desc("id")).limit(limit)
