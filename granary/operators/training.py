"""Audit of a knowledge base, and training records from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import text


def audit(items: DataFrame, expressions=fixed.EXPRESSION_RULES, answers=fixed.ANSWER_RULES) -> DataFrame:
    """One row per intent: samples, categories, counts of labels of questions and answers and of dialogue types, and risks.

    Labels are counted in one pass, without exploding rows; an intent's categories and dialogue types are few.
    """
    q, a = text.text("question"), text.text("answer")
    has = {f"q_{k}": text.has_any(q, words) for k, words in expressions.items()} | {f"a_{k}": text.has_any(a, words) for k, words in answers.items()}
    other = F.lit(True)
    for k in expressions:
        other = other & ~has[f"q_{k}"]
    has["q_other"] = other
    rows = items.withColumn("intent", F.coalesce("intent", F.lit("unknown"))).withColumn("_type", F.coalesce("dialogue_type", F.lit("unknown")))
    found = rows.groupBy("intent").agg(F.count("*").alias("sample_count"), F.array_join(F.array_sort(F.collect_set(F.when(text.text("category") != "", F.col("category")))), "/").alias("category"), *[F.count_if(c).alias(k) for k, c in has.items()])
    types = rows.groupBy("intent", "_type").agg(F.count("*").alias("n")).groupBy("intent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_type", "n")))).alias("dialogue_type_counts"))
    counts = lambda prefix: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k.removeprefix(prefix)).alias("k"), F.col(k).alias("n")) for k in sorted(has) if k.startswith(prefix)]), lambda x: x["n"] > 0))
    zero = lambda k: F.col(k) == 0 if k in has else F.lit(True)
    risks = F.array_compact(F.array(F.when(F.col("sample_count") <= 2, "sample_count_low"), F.when(zero("q_emotional"), "missing_emotional_expression"), F.when(zero("q_boundary"), "missing_boundary_expression"), F.when(zero("a_action"), "answer_missing_action"), F.when(zero("a_caution"), "answer_missing_caution")))
    return found.join(types, "intent").select("intent", "category", "sample_count", counts("q_").alias("expression_counts"), counts("a_").alias("answer_signal_counts"), "dialogue_type_counts", risks.alias("risks"))


def confusion_pairs(rows: DataFrame, pairs=fixed.CONFUSION_PAIRS) -> DataFrame:
    """(place, pair, counts, risks) of the pairs of intents that both occur."""
    order = rows.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "place int, left string, right string")
    side = lambda n: rows.select(F.col("intent").alias(n), F.col("sample_count").alias(f"{n}_count"), F.col("risks").alias(f"{n}_risks"))
    return side("right").join(side("left").join(F.broadcast(order), "left"), "right").select("place", F.concat_ws(" vs ", "left", "right").alias("pair"), "left_count", "right_count", "left_risks", "right_risks")


def normalised_seeds(rows: DataFrame) -> DataFrame:
    """Seeds (pos from 0, ...) with defaults for what is missing."""
    risk = F.coalesce(F.element_at("entities", "risk"), F.lit("低"))
    or_ = lambda c, v: F.when(text.text(c) == "", v).otherwise(F.col(c))
    out = rows.withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,string>")))
    out = out.withColumns({"id": or_("id", F.format_string("takeout_%04d", F.col("pos") + 1)), "source": or_("source", F.lit("curated_seed")), "dialogue_type": or_("dialogue_type", F.lit("single_turn")), "quality": or_("quality", F.when(risk.isin("低", "中", "高"), "high").otherwise("medium"))})
    return out.withColumns({c: text.trimmed(text.text(c)) for c in ("question", "answer", "category", "intent", "sentiment")})


def followed_up(answer: Column, sentiment: Column) -> Column:
    b = fixed.BRIDGE_SENTENCES
    return F.concat(answer, F.lit(" "), F.when(sentiment == "negative", b["negative"]).when(sentiment == "positive", b["positive"]).otherwise(b["neutral"]))


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def augmented(rows: DataFrame, target: int = fixed.TARGET_SIZE) -> DataFrame:
    """Seeds and their variants: two single-turn ones and a multi-turn one each, without repeats, then further multi-turn ones until `target`; ids are given anew.

    Even variants get an opening, odd ones the colloquial style and an ending. Order: the seeds, then the variants seed
    by seed, then the further ones in cycles, of which at most target are generated and the first that repeat nothing
    are taken.
    """
    seeds = normalised_seeds(rows)
    p, q = F.col("pos"), F.col("question")

    def single(no: Column, at: Column) -> Column:
        return F.when(no % 2 == 0, F.concat(_pick(fixed.QUESTION_PREFIXES, at), q)).otherwise(F.concat(text.colloquial(q), _pick(fixed.QUESTION_SUFFIXES, at)))

    def multi(follow: Column, again: str = "继续追问") -> Column:
        return F.concat(F.lit("多轮对话：用户先问“"), q, F.lit(f"”，客服初步回复后，用户{again}“"), follow, F.lit("”"))

    answer = followed_up(F.col("answer"), F.col("sentiment"))
    context = F.map_concat(F.map_filter("entities", lambda k, v: k != "context"), F.create_map(F.lit("context"), F.lit("multi_turn_follow_up")))
    quality = F.when(F.col("sentiment") == "negative", "high").otherwise("medium")
    shape = lambda k, question, source, kind, grade, entities: F.struct(F.lit(k).alias("k"), question.alias("question"), F.lit(source).alias("source"), F.lit(kind).alias("dialogue_type"), grade.alias("quality"), answer.alias("answer"), entities.alias("entities"))
    three = F.array(shape(0, single(p, p), "synthetic_augmentation", "single_turn", F.lit("medium"), F.col("entities")), shape(1, single(p + 1, p + 2), "synthetic_augmentation", "single_turn", F.lit("medium"), F.col("entities")), shape(2, multi(_pick(fixed.FOLLOW_UPS, p)), "synthetic_multi_turn", "multi_turn", quality, context))
    variants = seeds.select("pos", "category", "intent", "sentiment", F.explode(three).alias("v")).select(F.lit(1).alias("part"), (F.col("pos") * 3 + F.col("v.k")).alias("place"), "category", "intent", "sentiment", *[f"v.{c}" for c in ("question", "source", "dialogue_type", "quality", "answer", "entities")])
    columns = ["part", "place", "source", "dialogue_type", "quality", "question", "answer", "category", "intent", "sentiment", "entities"]
    base = seeds.withColumns({"part": F.lit(0), "place": p.cast("long")}).select(*columns)
    n = F.broadcast(seeds.agg(F.count("*").alias("_n")))
    cycles = F.explode(F.sequence(F.lit(0), F.least(F.lit(len(fixed.FOLLOW_UPS)), F.ceil(F.lit(target) / F.col("_n"))).cast("int"))).alias("_cycle")
    more = seeds.crossJoin(n).select("*", cycles).withColumn("place", F.col("_cycle") * F.col("_n") + p)
    more = more.withColumn("question", multi(_pick(fixed.FOLLOW_UPS, F.col("place") + 3), "再次追问")).withColumns({"source": F.lit("synthetic_multi_turn"), "dialogue_type": F.lit("multi_turn"), "quality": quality, "answer": answer, "entities": context, "part": F.lit(2)}).select(*columns)
    unique = Window.partitionBy("question", "answer", "intent").orderBy("part", "place")
    every = base.unionByName(variants.select(*columns)).unionByName(more).withColumn("_n", F.row_number().over(unique)).filter("_n = 1").drop("_n")
    out = every.orderBy("part", "place").limit(target)
    return out.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "place"))).withColumn("id", F.format_string("takeout_%04d", "_i")).withColumnRenamed("_i", "n").drop("part", "place")


def messages(rows: DataFrame) -> DataFrame:
    """Rows as chat records: system, user and assistant, or five turns where a question quotes a first and a further one."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    quoted = F.regexp_extract_all("question", F.lit("“([^”]+)”"), F.lit(1))
    first, more = F.coalesce(F.get(quoted, F.lit(0)), F.col("question")), F.coalesce(F.get(quoted, F.lit(1)), F.lit("那现在我应该怎么处理？"))
    system = turn("system", F.lit(fixed.SYSTEM_PROMPT))
    many = F.array(system, turn("user", first), turn("assistant", F.lit("我会先帮您按订单问题来判断，并尽量给出可以立即操作的处理方式。")), turn("user", more), turn("assistant", F.col("answer")))
    one = F.array(system, turn("user", F.col("question")), turn("assistant", F.col("answer")))
    meta = F.struct("id", "category", "intent", "sentiment", "quality", "dialogue_type", "entities")
    return rows.select(F.when(F.col("dialogue_type") == "multi_turn", many).otherwise(one).alias("messages"), meta.alias("metadata"))


def split(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows with split (train, val, test): 80, 10 and 10 in a hundred of the order by a hash of the key, cut at whole numbers.

    The cut is exact, so ranks are needed; they come from counts of hash buckets, so no task sorts all rows.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    rows = rows.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned("_h", 48))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))  # 65,536 buckets at most
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0)))).drop("_n")
    rows = rows.join(F.broadcast(starts), "_b").withColumn("_r", F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    name = F.when(F.col("_r") <= F.floor(F.col("_all") * 0.8), "train").when(F.col("_r") <= F.floor(F.col("_all") * 0.9), "val").otherwise("test")
    return rows.withColumn("split", name).drop("_h", "_b", "_start", "_all", "_r")


def repeated(rows: DataFrame, extra: DataFrame, times: int) -> DataFrame:
    """rows and `times` copies of extra."""
    return rows.unionByName(extra.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k")) if times > 0 else rows


def profile(rows: DataFrame) -> DataFrame:
    """(field, value, n) of categories, dialogue types and qualities, in one pass."""
    parts = [F.struct(F.lit(c).alias("field"), text.text(c).alias("value")) for c in ("category", "dialogue_type", "quality")]
    return rows.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
