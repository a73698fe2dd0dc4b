"""The greedy choice among similar answers for groups of any size: pairs by a similarity join, then rounds of what is decided."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators.phrases import containing
from granary.scratch import written

#: Kinds of bigrams whose frequencies are broadcast at most.
BROADCAST_GRAMS = 200_000


def _jaccard_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets (_id, _grams) that may have a Jaccard similarity of threshold: they share one of their rarest grams, of which each shows as many as it could lack."""
    grams = sets.select("_id", F.explode("_grams").alias("gram"))
    often = written(grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"))  # what one set has alone is first in its order and meets nobody
    often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often
    ordered = grams.join(often, "gram", "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "gram"))).alias("g"))
    n = F.size("g")
    shown = ordered.withColumn("_n", n).withColumn("g", F.slice("g", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")))
    shown = written(shown.select("_id", "_n", F.posexplode("g").alias("_at", "_x")).filter("_x.df > 1").select("_id", "_n", "_at", F.col("_x.gram").alias("gram")))
    left, right = shown.toDF("a", "an", "aat", "gram"), shown.toDF("b", "bn", "bat", "gram")
    room = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) + 1e-9 >= (F.col("an") + F.col("bn")) * (threshold / (1 + threshold))
    return left.join(right, "gram").filter((F.col("a") < F.col("b")) & room).select("a", "b").distinct()


def _contained(keys: DataFrame) -> DataFrame:
    """(a, b): keys (_id, _key) of which b contains a and is not too long for it."""
    step = F.floor(F.log(F.length("_key")) / -math.log(text.CONTAINED) + 1e-9)
    bodies = keys.select(F.col("_id").alias("b"), F.explode(F.array(step - 1, step)).alias("_step"), F.col("_key").alias("body"))
    return containing(bodies, keys.select(F.col("_id").alias("a"), F.col("_key").alias("phrase"), step.alias("_step")), "body", "a", ["_step"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_pairs(keys: DataFrame, threshold: float = text.SIMILAR) -> DataFrame:
    """(a, b), a < b: the ids of distinct keys (_id, _key) that are near copies (text.similar); exact, by joins of what they share."""
    sets = written(keys.filter("_key <> ''").withColumn("_grams", text.bigrams(F.col("_key"))))
    may = _jaccard_candidates(sets, threshold).unionByName(_contained(sets.select("_id", "_key"))).distinct()
    of = lambda c: sets.select(F.col("_id").alias(c), F.col("_key").alias(f"{c}_key"), F.col("_grams").alias(f"{c}_grams"))
    return may.join(of("a"), "a").join(of("b"), "b").filter(text.similar(F.col("a_key"), F.col("b_key"), F.col("a_grams"), F.col("b_grams"), threshold)).select("a", "b")


def greedy_kept(candidates: DataFrame, group: list[str], order: list[Column], limit: int | None = None, threshold: float = text.SIMILAR) -> DataFrame:
    """Candidates (with answer) that stay when each group is walked in order and near copies of kept answers are left out; with rank.

    What greedy_dedupe gives, for groups of any size, none of which is held in one row or task. Similar keys are found
    once for all groups, by joins. Then, in rounds, a row stays once no undecided row before it is similar, and the rows
    after it that are similar go; rows that nothing is similar to are never touched. There are as many rounds as the
    longest chain of rows of which each waits for the one before. Equal keys, and equal answers without a key, are the
    first of them. Ties of the order are broken by the answer. Pairs are candidates if they share a rare bigram, so texts
    in an alphabet of few letters, whose bigrams are all common, cost nearly as much as comparing all.
    """
    named = [f"_g{i}" for i in range(len(group))]
    answer = text.text(F.col("_row.answer"))
    key = text.answer_key(answer)
    # the place in the order, as a number that grows from one range of the sort to the next
    ordered = candidates.orderBy(*order, "answer").select(F.monotonically_increasing_id().alias("_o"), F.struct(*[F.col(f"`{c}`") for c in candidates.columns]).alias("_row"))
    rows = ordered.select("_o", "_row", *[F.to_json(F.struct(F.col(f"_row.`{g}`").alias("g"))).alias(n) for g, n in zip(group, named, strict=True)], key.alias("_key"), answer.alias("_answer"))
    rows = written(rows.withColumn("_id", F.sha2(F.when(F.col("_key") == "", F.concat(F.lit("="), "_answer")).otherwise(F.concat(F.lit(":"), "_key")).cast("binary"), 256)).drop("_answer"))
    first = written(rows.groupBy(*named, "_id").agg(F.min("_o").alias("_o")))
    pairs = similar_pairs(rows.groupBy("_id").agg(F.first("_key").alias("_key")), threshold)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    early = first.select(*named, F.col("_id").alias("a"), F.col("_o").alias("early"))
    late = first.select(*named, F.col("_id").alias("b"), F.col("_o").alias("late"))
    edges = written(early.join(both, "a").join(late, [*named, "b"]).filter("early < late").select("early", "late"))
    gone = None
    while not edges.isEmpty():
        waiting = edges.select(F.col("late").alias("early")).distinct()
        free = written(edges.select("early").distinct().join(waiting, "early", "left_anti"))
        goes = written(edges.join(free, "early", "left_semi").select("late").distinct())
        gone = goes if gone is None else gone.unionByName(goes)
        edges = written(edges.join(free, "early", "left_anti").join(goes, "late", "left_anti").join(goes.withColumnRenamed("late", "early"), "early", "left_anti"))
    kept = first.select("_o") if gone is None else first.select("_o").join(gone.withColumnRenamed("late", "_o"), "_o", "left_anti")
    kept = rows.join(kept, "_o", "left_semi")
    rank = F.row_number().over(Window.partitionBy(*named).orderBy("_o"))
    out = kept.withColumn("_rank", rank)
    out = out.filter(F.col("_rank") <= limit) if limit else out
    return out.select("_row.*", F.col("_rank").alias("rank"))
