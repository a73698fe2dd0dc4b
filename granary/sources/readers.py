"""Sources and sinks: JSON lines in order, reports, cases, vector stores, versioned tables, settings."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import text
from granary.operators import places, retrieval

KB = "id string, source string, dialogue_type string, quality string, question string, answer string, category string, intent string, sentiment string, entities map<string,string>"
CASES = "id string, scenario string, case_type string, query string, expected_intent string, expected_evidence_keywords array<string>, forbidden_keywords array<string>, notes string"
SMOKE = "id string, query string, expected_top1_intent string, expected_reply_keywords array<string>, forbidden_reply_keywords array<string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file in its order, from 0.

    Positions are ranks of Spark's own place of a line: partitions of a text source follow the file, so the partition's
    number and the line's number in it give the order, and only one count per partition is summed up and joined.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_number"))
    return places.from_parts(lines, "_number").select("pos", "line")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of a JSON lines file with pos. Strict: a blank or broken line is an error; lenient: blank lines are skipped.

    Missing texts become empty.
    """
    lines = numbered_lines(spark, path)
    blank = text.trimmed(F.col("line")) == ""
    if strict:
        bad = lines.filter(blank | F.try_parse_json("line").isNull()).orderBy("pos").limit(1).collect()
        if bad:
            raise ValueError(f"line {bad[0].pos + 1} of {path} is not JSON")
    else:
        lines = lines.filter(~blank)
    if limit is not None:
        lines = lines.orderBy("pos").limit(limit)
    rows = lines.select("pos", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c, kind in rows.dtypes if kind == "string"})


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, KB)


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; a missing field, an unknown type, and repeated ids or queries are errors."""
    lines = numbered_lines(spark, path).filter(text.trimmed(F.col("line")) != "")
    keys = F.map_keys(F.from_json("line", "map<string,string>"))
    absent = F.array_except(F.array(*map(F.lit, sorted(fixed.CASE_FIELDS))), F.coalesce(keys, F.array().cast("array<string>")))
    bad = lines.select("pos", absent.alias("absent")).filter(F.size("absent") > 0).orderBy("pos").limit(1).collect()
    if bad:
        raise ValueError(f"Evaluation case line {bad[0].pos + 1} missing fields: {sorted(bad[0].absent)}")
    rows = json_lines(spark, path, CASES, strict=False)
    bad = rows.filter(~F.col("case_type").isin(*fixed.CASE_TYPES)).orderBy("pos").limit(1).collect()
    if bad:
        raise ValueError(f"Evaluation case line {bad[0].pos + 1} has invalid case_type: {bad[0].case_type}")
    for name, what in (("id", "case id"), ("query", "query")):
        _unique(rows, name, f"Duplicate evaluation {what}")
    return rows


def _unique(rows: DataFrame, name: str, message: str) -> None:
    bad = rows.groupBy(name).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {bad[0][0]}")


def smoke_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = json_lines(spark, path, SMOKE, strict=False)
    bad = rows.filter(F.col("expected_reply_keywords").isNull() | F.col("forbidden_reply_keywords").isNull() | (F.col("id") == "") | (F.col("query") == "")).orderBy("pos").limit(1).collect()
    if bad:
        raise ValueError(f"Smoke case line {bad[0].pos + 1} lacks a field")
    _unique(rows, "id", "Duplicate smoke case id")
    return rows


def report(spark: SparkSession, path: str, rows: str = "reports") -> tuple[DataFrame, DataFrame]:
    """(envelope of one row, its rows with pos) of a report in one JSON document."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.drop(rows), whole.select(F.posexplode(rows).alias("pos", "r")).select("pos", "r.*")


def content_key(kb: DataFrame) -> DataFrame:
    """(rows, key, dimension): a fingerprint of a base's rows in their order, for comparing stores without their data."""
    row = F.xxhash64("pos", *[text.text(c) for c in ("answer", "question", "category", "intent")])
    dim = F.max(F.size("embedding")) if "embedding" in kb.columns else F.lit(None).cast("int")
    return kb.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("key"), dim.alias("dimension"))


def compatible(stored: DataFrame, kb: DataFrame, dimension: int | None = None) -> bool:
    """Whether a stored base with embeddings still fits: as many rows, the same content, the embedding's dimension."""
    a, b = content_key(stored).first(), content_key(kb).first()
    return (a.rows, a.key) == (b.rows, b.key) and (dimension is None or a.dimension == dimension)


def ensured(spark: SparkSession, path: str, kb: DataFrame, embed, dimension: int | None = None) -> DataFrame:
    """The stored vector base at path, or, where there is none that fits, a new one made by embed(DataFrame with text); dimension: of the embeddings of the model in use."""
    try:
        stored = spark.read.parquet(path)
        if compatible(stored, kb, dimension):
            return stored
    except Exception as e:  # only a path without a table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    rows = kb.withColumn("text", retrieval.document_text(*[F.col(c) for c in ("category", "intent", "question", "answer")]))
    embed(rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lines(rows: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> None:
    """Rows as compact JSON lines, one part per partition; with order in one sorted run of range partitions."""
    rows = rows.repartitionByRange(order).sortWithinPartitions(order) if order else rows
    names = [c for c in rows.columns if c != order]
    rows.select(F.to_json(F.struct(*names)).alias("value")).write.mode(mode).text(path)


def append_lines(path: str, lines: list[str]) -> None:
    """Appends to a local file, with a line end before them if the file lacks one."""
    need = False
    if os.path.exists(path) and os.path.getsize(path):
        with open(path, "rb") as f:
            f.seek(-1, os.SEEK_END)
            need = f.read(1) not in (b"\n", b"\r")
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        f.write("\n" * need + "\n".join(lines) + "\n")


def _file(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, so that tables and reports may lie in any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_new(spark: SparkSession, path: str, content: str) -> None:
    """Writes a file; an error if there is one."""
    found, files = _file(spark, path)
    out = files.create(found, False)
    try:
        out.write(content.encode())
    finally:
        out.close()


def save_report(spark: SparkSession, folder: str, payload: dict, now: datetime) -> str:
    """A report as one JSON file, named by its time, with a number behind it if the name is taken."""
    run = now.strftime("%Y-%m-%d_%H-%M-%S")
    path, k = f"{folder}/{run}.json", 1
    while (taken := _file(spark, path))[1].exists(taken[0]):
        path, k = f"{folder}/{run}-{k}.json", k + 1
    _write_new(spark, path, json.dumps({"run_id": run, "created_at": now.isoformat(timespec="seconds")} | payload, ensure_ascii=False, indent=2))
    return path


class Conflict(Exception):
    """Another writer has changed a table since it was read."""


#: Pointers that are kept, so that a reader which has just listed them still finds its own.
POINTERS = 100


def swap(rows: DataFrame, folder: str, version: str, expected: int | None = None) -> str:
    """Writes a version of a table beside the others and points to it by one rename, so readers see the old or the new one whole. After a Conflict, see point(), the version is deleted."""
    spark, target = rows.sparkSession, f"{folder}/v_{version}"
    rows.write.mode("errorifexists").parquet(target)
    try:
        point(spark, folder, target, expected)
    except Conflict:
        found, files = _file(spark, target)
        files.delete(found, True)
        raise
    return target


def point(spark: SparkSession, folder: str, target: str, expected: int | None = None) -> int:
    """Makes a version that swap() wrote the current one, and gives the pointer's number.

    Pointers are numbered files, and the next one is made by a rename that never overwrites, so of two writers one gets
    a Conflict wherever the store's renames are atomic. With expected, the number that was read (0: none), a pointer
    made since then is a Conflict too.
    """
    last, at = (pointer(spark, folder) or (0, ""))[0], f"{folder}/POINTERS"
    if expected is not None and last != expected:
        raise Conflict(f"{folder} has changed: pointer {expected} was read, {last} is the current one")
    new = f"{folder}/CURRENT.{uuid.uuid4().hex}"
    _write_new(spark, new, target)
    found, files = _file(spark, new)
    fs = spark._jvm.org.apache.hadoop.fs
    files.mkdirs(fs.Path(at))
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").NONE
    whole = lambda path: path.makeQualified(files.getUri(), files.getWorkingDirectory())
    try:
        fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(whole(found), whole(fs.Path(f"{at}/{last + 1:012d}")), how)
    except Py4JJavaError as e:
        files.delete(found, False)
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        raise Conflict(f"{folder} has changed: another writer made pointer {last + 1}") from e
    files.delete(fs.Path(f"{at}/{last + 1 - POINTERS:012d}"), False)
    return last + 1


def pointer(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, target) of the current version. A table written before pointers had numbers has one file, with number 0."""
    at, files = _file(spark, f"{folder}/POINTERS")
    numbers = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    path = f"{folder}/POINTERS/{max(n for n in numbers if n.isdigit())}" if any(n.isdigit() for n in numbers) else f"{folder}/CURRENT"
    if path.endswith("CURRENT") and not files.exists(_file(spark, path)[0]):
        return None
    return int(path.rpartition("/")[2].replace("CURRENT", "0")), spark.read.text(path, wholetext=True).first().value


def has_version(spark: SparkSession, folder: str) -> bool:
    return pointer(spark, folder) is not None


def current(spark: SparkSession, folder: str) -> DataFrame:
    found = pointer(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no version of a table: {folder}")
    return spark.read.parquet(found[1])


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A table with line ends as <br> and escaped bars."""
    cell = lambda v: str(v).replace("\r\n", "\n").replace("\n", "<br>").replace("|", "\\|")
    head = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows]) + "\n"


def _flag(name: str, default: bool) -> bool:
    value = os.getenv(name)
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval and answering; an empty path means the default."""

    embedding_model_name: str = "BAAI/bge-small-zh-v1.5"
    reranker_model_name: str = "BAAI/bge-reranker-base"
    generation_provider: str = "local"
    model_rerank_weight: float = retrieval.MODEL_WEIGHT
    min_vector_score: float = retrieval.MIN_SCORE
    store_dir: str = "data/vector_store"
    answer_composer_enabled: bool = True
    reply_rules_enabled: bool = True

    @classmethod
    def from_env(cls) -> Settings:
        d = cls()
        return cls(os.getenv("RAG_EMBEDDING_MODEL_NAME", d.embedding_model_name), os.getenv("RAG_RERANKER_MODEL_NAME", d.reranker_model_name), os.getenv("RAG_GENERATION_PROVIDER", d.generation_provider), float(os.getenv("RAG_MODEL_RERANK_WEIGHT", d.model_rerank_weight)), float(os.getenv("RAG_MIN_VECTOR_SCORE", d.min_vector_score)), os.getenv("RAG_FAISS_STORE_DIR") or d.store_dir, _flag("RAG_ANSWER_COMPOSER_ENABLED", True), _flag("RAG_REPLY_RULES_ENABLED", True))

    def as_dict(self) -> dict:
        return asdict(self)
