"""Rules as rows: terms belong to clauses, clauses to ways, ways to rules; which rules hold is found by joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.phrases import containing

#: One row for each term of a rule: rank (of the rule), result, way, clause, needed (clauses of the way that must be met), field, equal (the whole field, else a part of it), negated, term.
TERMS = "rank int, result string, way int, clause int, needed int, field string, equal boolean, negated boolean, term string"


def rule_terms(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """The table of rules that are written as texts (condition, result), in order of priority; conditions as in functions.rules.

    A way that forbids terms only would hold for rows in which nothing is found; such a rule is refused.
    """
    rows = []
    for rank, (condition, result) in enumerate(rules):
        for way, text in enumerate(condition.split(" OR ")):
            clauses = [c.strip() for c in text.split(" & ")]
            needed = sum(not c.startswith("!") for c in clauses)
            if not needed:
                raise ValueError(f"no clause of rule {rank} must be met: {text}")
            for k, clause in enumerate(clauses):
                plain = clause.removeprefix("!")
                rows += [(rank, result, way, k, needed, plain[0], plain[1] == "=", clause.startswith("!"), term) for term in dict.fromkeys(plain[2:].split("|"))]
    return spark.createDataFrame(rows, TERMS)


def matched(rows: DataFrame, terms: DataFrame, id_cols: list[str], fields: dict[str, str]) -> DataFrame:
    """(id_cols, rank, result) of the rules that hold for rows: those with a way whose needed clauses are all met and of whose forbidden terms none is found.

    fields: the rules' names of rows' columns. Null fields are empty. A row's fields are searched once for all terms of
    all rules, which meet them by joins, so rules may be as many as a table holds; nothing is compiled into the plan.
    Ids must tell rows apart.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("body")) for n, c in fields.items()]))
    bodies = rows.select(*id_cols, parts.alias("_x")).select(*id_cols, "_x.*")
    wanted = terms.select("field", "equal", "term").distinct()
    inside = containing(bodies, wanted.filter("not equal").select("field", F.col("term").alias("phrase"), F.col("term").alias("_term")), "body", "_term", ["field"])
    inside = inside.select(*id_cols, "field", F.lit(False).alias("equal"), F.col("_term").alias("term"))
    same = bodies.withColumnRenamed("body", "term").withColumn("equal", F.lit(True)).join(wanted.filter("equal"), ["field", "equal", "term"])
    hits = inside.unionByName(same.select(*id_cols, "field", "equal", "term")).join(terms, ["field", "equal", "term"])
    met = hits.groupBy(*id_cols, "rank", "result", "way").agg(F.count_distinct(F.when(~F.col("negated"), F.col("clause"))).alias("_met"), F.max("needed").alias("_needed"), F.bool_or("negated").alias("_forbidden"))
    return met.filter("_met = _needed and not _forbidden").select(*id_cols, "rank", "result").distinct()


def first_matched(rows: DataFrame, terms: DataFrame, id_cols: list[str], fields: dict[str, str], other: str = "") -> DataFrame:
    """(id_cols, result): the result of the first rule in rank that holds for a row, else `other`."""
    best = matched(rows, terms, id_cols, fields).groupBy(*id_cols).agg(F.min_by("result", "rank").alias("result"))
    return rows.select(*id_cols).join(best, id_cols, "left").withColumn("result", F.coalesce("result", F.lit(other)))
