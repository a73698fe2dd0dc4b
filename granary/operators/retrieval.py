"""Retrieval: exact vector and keyword top-k, hybrid scores, supplements by intent, reranking, greedy deduplication.

A knowledge base is a DataFrame of pos (its order), question, answer, category, intent and, for vector search,
embedding; queries are query_id, query and, for vector search, q_embedding. Missing texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed
from granary.functions import rules, text
from granary.operators.greedy import greedy_kept
from granary.operators.phrases import containing
from granary.scratch import written

LIMIT, MIN_SCORE, MODEL_WEIGHT = 3, 0.40, 0.01
HINT_BONUS, SUPPLEMENT_SCORE, SUPPLEMENTS = 0.10, 0.80, 3
ORIGIN_HIT, ORIGIN_HINT = "faiss", "intent_hint_supplement"
#: Queries, and numbers of their vectors (32 MB), that are broadcast at most. More are dealt over the cluster, in cells of at most about so many queries and rows.
QUERY_BLOCK, QUERY_NUMBERS = 4096, 1 << 22
CELL_QUERIES, CELL_ROWS = 1 << 13, 1 << 14
#: Scores that a task holds at once, 4 MB of them; rounding and choosing the best copy them a few times over.
SCORES = 1 << 19
DIGITS = 6
#: Query terms that are broadcast at most, and rows of a query that are scored first, to learn what its best rows must reach.
BROADCAST_TERMS, SEEDS = 200_000, 32


def document_text(category: Column, intent: Column, question: Column, answer: Column) -> Column:
    """The text that is embedded, and that a cross-encoder reads: four labelled lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(label), text.text(c)) for label, c in (("分类：", category), ("意图：", intent), ("问题：", question), ("答案：", answer))])


def _vectors(column, n: int, cosine: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    if cosine:
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    return rows


def _nearest(ids: np.ndarray, matrix: np.ndarray, pos: np.ndarray, rows: np.ndarray, k: int, exclude_self: bool, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, pos, score) of each query's k best among some rows; ties to the smaller pos. The scores of SCORES pairs are held at once, of which those that reach a query's k-th best are sorted."""
    found = []
    step = max(1, SCORES // max(1, len(pos)))
    for at in range(0, len(ids), step):
        own = ids[at : at + step]
        scores = np.round(matrix[at : at + step] @ rows.T, digits) + 0.0
        if exclude_self:
            scores[own[:, None] == pos] = -np.inf
        if len(pos) > k:
            q, r = np.nonzero(scores >= np.partition(scores, len(pos) - k, axis=1)[:, len(pos) - k, None])
        else:
            q, r = np.divmod(np.arange(scores.size), max(1, len(pos)))
        s = scores[q, r]
        order = np.lexsort((pos[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else q
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = (place < k) & np.isfinite(s)
        found.append((own[q[keep]], pos[r[keep]], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids[:0], pos[:0], np.zeros(0))


def vector_topk(queries: DataFrame, kb: DataFrame, k: int, exclude_self: bool = False, cosine: bool = True, digits: int = DIGITS) -> DataFrame:
    """(query_id, pos, vector_score, hit_rank): each query's k nearest rows, over all rows.

    Few queries, of a checked size, are one matrix that is broadcast; each Arrow batch of rows is one matrix product and
    nothing of the knowledge base is shuffled. More queries are dealt in groups, as the rows are, and each two groups meet
    in a cell of their own, of bounded size, so no query passes through the driver and memory doesn't depend on how many
    there are. Either way only the k best per query leave a task. No pair is built in the JVM. Scores are doubles,
    rounded; ties go to the smaller pos. A zero vector scores 0. Queries and rows without a vector take no part.
    """
    spark, schema = kb.sparkSession, "query_id long, pos long, vector_score double"
    asked = queries.select(F.col("query_id").cast("long"), F.col("q_embedding").cast("array<double>").alias("v")).filter("v is not null")
    rows = kb.filter("embedding is not null").select(F.col("pos").cast("long"), "embedding")
    names = ["query_id", "pos", "vector_score"]
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if n <= QUERY_BLOCK and numbers <= QUERY_NUMBERS:
        table = asked.toArrow()
        shared = spark.sparkContext.broadcast((table.column("query_id").to_numpy(), _vectors(table.column("v"), n, cosine) if n else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    best = _nearest(ids, matrix, batch.column(0).to_numpy(), _vectors(batch.column(1), batch.num_rows, cosine), k, exclude_self, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names)

        found = rows.mapInArrow(run, schema)
    else:
        across = -(-n // CELL_QUERIES)
        down = max(-(-rows.count() // CELL_ROWS), -(-spark.sparkContext.defaultParallelism // across), 1)

        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if mine.num_rows and theirs.num_rows:
                best = _nearest(mine.column("query_id").to_numpy(), _vectors(mine.column("v"), mine.num_rows, cosine), theirs.column("pos").to_numpy(), _vectors(theirs.column("embedding"), theirs.num_rows, cosine), k, exclude_self, digits)
            return pa.table([pa.array(x) for x in best], names)

        dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = asked.withColumn("_r", dealt("query_id", across)).withColumn("_s", all_of(down))
        right = rows.withColumn("_s", dealt("pos", down)).withColumn("_r", all_of(across))
        found = left.groupBy("_r", "_s").cogroup(right.groupBy("_r", "_s")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "pos"))
    return found.withColumn("hit_rank", rank).filter(F.col("hit_rank") <= k)


def keyword_bonus(query: Column, fields: dict[str, Column], field_weights=fixed.BONUS_FIELDS, keywords=fixed.BONUS_KEYWORDS) -> Column:
    """Sum of field weight times keyword weight over the keywords that query and field contain."""
    total = F.lit(0.0)
    for field, weight in field_weights.items():
        for word, factor in keywords.items():
            total = total + F.when(query.contains(word) & fields[field].contains(word), F.lit(weight * factor)).otherwise(F.lit(0.0))
    return total


def direction_penalty(query: Column, category: Column, intent: Column, question: Column) -> Column:
    """Penalty of a row that answers another direction than the query's; the first that fits holds."""
    whole = F.concat(category, intent, question)
    food = text.has_any(query, ("餐品", "异物", "食品", "变质", "吃坏", "赔")) & text.has_any(whole, ("发票", "优惠", "赠品", "会员", "金额"))
    late = query.contains("超时") & ~text.has_any(query, ("取消", "不想要", "不要了", "退款", "退单")) & (intent == "超时取消")
    rider = ("骑手", "配送员")
    other = query.contains("联系不上") & text.has_any(query, rider) & text.has_any(question, rider) & text.has_any(question, ("联系不到我", "联系不上我"))
    return F.when(food, 0.15).when(late, 0.08).when(other, 0.08).otherwise(0.0)


def toy_embedding(c: Column, dimensions=fixed.TOY_DIMENSIONS) -> Column:
    """Distinct keywords of each of the four groups in a text."""
    return F.array(*[sum((c.contains(w).cast("int") for w in words), F.lit(0)).cast("double") for words in dimensions])


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def toy_topk(queries: DataFrame, kb: DataFrame, limit: int = LIMIT, dimensions=fixed.TOY_DIMENSIONS, document: Column | None = None) -> DataFrame:
    """(query_id, pos, score, rank): rows by the cosine of toy vectors, those above 0, ties in the order of the base.

    A toy vector has few values, so queries meet distinct vectors, not rows: cosines are computed per pair of distinct
    vectors, and each distinct vector brings its first `limit` rows only.
    """
    whole = document_text(*[text.text(c) for c in ("category", "intent", "question", "answer")]) if document is None else document
    rows = kb.select("pos", toy_embedding(whole, dimensions).alias("v"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("pos"))).filter(F.col("n") <= limit)
    vectors = first.groupBy("v").agg(F.sort_array(F.collect_list("pos")).alias("rows"))
    asked = queries.select("query_id", toy_embedding(text.text("query"), dimensions).alias("q"))
    # a bounded number of distinct vectors: the product of the groups' sizes
    pairs = asked.join(F.broadcast(vectors), F.exists("q", lambda x: x > 0)).withColumn("score", F.round(cosine(F.col("q"), F.col("v")), DIGITS)).filter("score > 0")
    found = pairs.select("query_id", "score", F.explode("rows").alias("pos"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))).filter(F.col("rank") <= limit)


def keyword_scores(queries: DataFrame, kb: DataFrame, weights=fixed.FIELD_WEIGHTS) -> DataFrame:
    """(query_id, pos, score, matched_term_count, details) of the pairs that score above 0.

    Points are the terms that query and field share times the field's weight, and the weight and two more where a field
    contains the whole query. Queries and rows meet by equal terms: the queries' terms are broadcast if they are few,
    which a count checks, else both sides are shuffled. Fields that contain a whole query are found by `containing`.
    """
    fields = [f for f in weights if f in kb.columns]
    rows = kb.select("pos", *[F.lower(text.text(f)).alias(f) for f in fields])
    asked = queries.select("query_id", text.text("query").alias("query")).withColumn("terms", text.terms(F.col("query")))
    parts = rows.select("pos", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(weights[f]).alias("weight"), F.col(f).alias("body")) for f in fields])).alias("x")).select("pos", "x.*").filter("body <> ''")
    words = parts.select("pos", "field", "weight", F.explode(text.terms(F.col("body"))).alias("term"))
    wanted = asked.select("query_id", F.explode("terms").alias("term"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    by_term = words.join(wanted, "term").groupBy("query_id", "pos", "field", "weight").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    matched = by_term.select("query_id", "pos", "field", F.lit("matched_terms").alias("reason"), "terms", (F.size("terms") * F.col("weight")).alias("points"))
    whole = containing(parts, asked.select("query_id", F.lower("query").alias("phrase")), "body", "query_id").join(asked.select("query_id", "query"), "query_id")
    whole = whole.select("query_id", "pos", "field", F.lit("full_query_match").alias("reason"), F.array("query").alias("terms"), (F.col("weight") + 2).alias("points"))
    detail = F.struct("field", "reason", "terms", "points")
    count = F.sum(F.when(F.col("reason") == "matched_terms", F.size("terms")).otherwise(0))
    return matched.unionByName(whole).groupBy("query_id", "pos").agg(F.sum("points").alias("score"), count.alias("matched_term_count"), F.sort_array(F.collect_list(detail)).alias("details"))


def _keyword_index(queries: DataFrame, kb: DataFrame, weights) -> tuple[DataFrame, DataFrame]:
    """The inverted index of the terms that queries have, (term, pos, weight) for each field, and (query_id, term, df, upper): a term's postings, and the most that it can add to a row's score."""
    fields = [f for f in weights if f in kb.columns]
    wanted = queries.select("query_id", F.explode(text.terms(text.text("query"))).alias("term"))
    known = wanted.select("term").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    parts = [kb.select("pos", F.lit(weights[f]).alias("weight"), F.explode(text.terms(F.lower(text.text(f)))).alias("term")).filter("term <> ''") for f in fields]
    index = parts[0]
    for more in parts[1:]:
        index = index.unionByName(more)
    index = written(index.join(known, "term", "left_semi").select("term", "pos", "weight"))
    by_field = index.groupBy("term", "weight").agg(F.count("*").alias("n"))  # fields of one weight count as often as they are
    same = {}
    for f in fields:
        same[weights[f]] = same.get(weights[f], 0) + 1
    times = F.element_at(F.create_map(*[F.lit(x) for w, n in same.items() for x in (w, n)]), F.col("weight"))
    of_term = by_field.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.col("weight") * times).alias("upper"))
    return index, written(wanted.join(of_term, "term"))


def _term_scores(pairs: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """pairs (query_id, pos) with score and matched_term_count over the given terms of each query."""
    found = pairs.join(terms.select("query_id", "term"), "query_id").join(index, ["term", "pos"])
    return found.groupBy("query_id", "pos").agg(F.sum("weight").alias("score"), F.count("*").alias("matched_term_count"))


def keyword_top(queries: DataFrame, kb: DataFrame, limit: int = LIMIT, weights=fixed.FIELD_WEIGHTS, seeds: int = SEEDS) -> DataFrame:
    """(query_id, pos, score, matched_term_count, rank): each query's best rows by the scores of keyword_scores, ties by more matched terms, shorter answer and order; exact.

    An inverted index with upper bounds, so that no query scores all rows that share a word with it. A few rows of a
    query's rarest terms are scored in full; the last of their best `limit` is what any better row must reach. In the order
    of their frequency, a query's commonest terms that together can't reach it name no candidates; the rows of the other
    terms do, and go on only if what they have and all the common terms could add reaches it. Only those are scored over
    the common terms. Rows that contain a whole query, which earns more, are found apart and always scored.
    """
    index, terms = _keyword_index(queries, kb, weights)
    fields = [f for f in weights if f in kb.columns]
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    ranked = written(terms.withColumn("rest", F.sum("upper").over(Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("before", F.sum("df").over(rare) - F.col("df")))
    first = ranked.filter(F.col("before") < seeds).join(index, "term").select("query_id", "pos").distinct()
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("pos")))).filter(F.col("_n") <= seeds).drop("_n")
    reach = _term_scores(first, ranked, index).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_n") == limit).select("query_id", F.col("score").alias("least"))
    bound = written(ranked.join(reach, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(1))).withColumn("names", F.col("rest") >= F.col("least")))
    common = bound.groupBy("query_id").agg(F.max("least").alias("least"), F.coalesce(F.max(F.when(~F.col("names"), F.col("rest"))), F.lit(0)).alias("common"))
    naming = bound.filter("names").select("query_id", "term")
    naming = F.broadcast(naming) if naming.count() <= BROADCAST_TERMS else naming
    partial = index.join(naming, "term").groupBy("query_id", "pos").agg(F.sum("weight").alias("score"), F.count("*").alias("matched_term_count"))
    alive = written(partial.join(common, "query_id").filter("score + common >= least").select("query_id", "pos", "score", "matched_term_count"))
    whole = containing(kb.select("pos", F.explode(F.array(*[F.struct(F.lit(weights[f] + 2).alias("points"), F.lower(text.text(f)).alias("body")) for f in fields])).alias("x")).select("pos", "x.*").filter("body <> ''"), queries.select("query_id", F.lower(text.text("query")).alias("phrase")), "body", "query_id")
    whole = written(whole.groupBy("query_id", "pos").agg(F.sum("points").alias("score")))
    more = _term_scores(alive.select("query_id", "pos"), bound.filter("not names"), index)
    apart = whole.select("query_id", "pos").join(alive, ["query_id", "pos"], "left_anti")  # rows of a whole query that its terms alone don't keep
    zero = F.lit(0).cast("long").alias("matched_term_count")
    every = alive.unionByName(more).unionByName(_term_scores(apart, bound, index)).unionByName(whole.select("query_id", "pos", "score", zero))
    scored = every.groupBy("query_id", "pos").agg(F.sum("score").alias("score"), F.sum("matched_term_count").alias("matched_term_count"))
    # ties of the last place all go on, until the answers' lengths decide
    near = scored.withColumn("_n", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched_term_count")))).filter(F.col("_n") <= limit).drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched_term_count"), "_length", "pos")
    sized = near.join(kb.select("pos", F.length(text.text("answer")).alias("_length")), "pos")
    return sized.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_length")


def _fold(items: Column, limit: int | None, threshold: float = text.SIMILAR) -> Column:
    """The greedy choice over an ordered array of structs with _key and _grams: an item stays if no kept one is similar, up to the limit."""

    def step(kept: Column, x: Column) -> Column:
        again = F.exists(kept, lambda y: (x["answer"] == y["answer"]) | text.similar(x["_key"], y["_key"], x["_grams"], y["_grams"], threshold))
        full = F.size(kept) >= limit if limit else F.lit(False)
        return F.when(full | again, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def greedy_dedupe(candidates: DataFrame, group: list[str], order: list[Column], limit: int | None = LIMIT, threshold: float = text.SIMILAR) -> DataFrame:
    """Candidates (with answer) that stay when each group is walked in order and near copies of kept answers are left out.

    Equal answers go first, by a window whose rank is cut before the shuffle; the walk then is one expression over a
    group's distinct answers. Groups are the candidates of a query, so bounded by the search's k; for groups of any size
    there is greedy.greedy_kept.
    """
    first = Window.partitionBy(*group, "answer").orderBy(*order)
    rows = candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = rows.withColumn("_o", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("_key", text.answer_key(F.col("answer"))).withColumn("_grams", text.bigrams(F.col("_key")))
    items = F.array_sort(F.collect_list(F.struct("_o", *[c for c in rows.columns if c != "_o" and c not in group])))
    kept = rows.groupBy(*group).agg(items.alias("_items")).select(*group, F.posexplode(_fold(F.col("_items"), limit, threshold)).alias("_at", "_x"))
    columns = [c for c in candidates.columns if c not in group]
    return kept.select(*group, *[F.col(f"_x.`{c}`").alias(c) for c in columns], (F.col("_at") + 1).alias("rank"))


def keyword_search(queries: DataFrame, kb: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Keyword retrieval: near copies are left out in the order of the base, before sorting by score, matched terms, shorter answer and order."""
    scored = keyword_scores(queries, kb).join(kb.select("pos", text.text("answer").alias("answer")), "pos")
    kept = greedy_kept(scored, ["query_id"], [F.col("pos")]).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("matched_term_count"), F.length("answer"), "pos")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def raw_candidates(hits: DataFrame, queries: DataFrame, kb: DataFrame, min_score: float = MIN_SCORE, hybrid: bool = True, field_weights=fixed.BONUS_FIELDS, keywords=fixed.BONUS_KEYWORDS) -> DataFrame:
    """Hits at or above min_score by their vector alone, with score = similarity + keyword bonus - direction penalty."""
    base = kb.select("pos", *[text.text(c).alias(c) for c in ("question", "answer", "category", "intent")])
    rows = hits.filter(F.col("vector_score") >= min_score).join(base, "pos").join(queries.select("query_id", text.text("query").alias("query")), "query_id")
    fields = {c: F.col(c) for c in ("question", "answer", "category", "intent")}
    bonus = keyword_bonus(F.col("query"), fields, field_weights, keywords) if hybrid else F.lit(0.0)
    penalty = direction_penalty(F.col("query"), F.col("category"), F.col("intent"), F.col("question")) if hybrid else F.lit(0.0)
    rows = rows.withColumn("keyword_bonus", bonus).withColumn("direction_penalty", penalty)
    return rows.withColumn("score", F.col("vector_score") + F.col("keyword_bonus") - F.col("direction_penalty")).withColumn("retrieval_origin", F.lit(ORIGIN_HIT))


def hint_supplements(candidates: DataFrame, queries: DataFrame, kb: DataFrame, limit: int = SUPPLEMENTS) -> DataFrame:
    """The first rows, in the order of the base, of the intent that a query hints at, whose questions the query has not got yet; one for each question.

    queries: query_id, query, intent_hint. The rows of an intent are cut to the first of each question, and of those to
    as many as a query can look at: its limit and the questions that it has. So a query meets a bounded part of its
    intent, and the result is the same.
    """
    most = limit + (candidates.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    asked = queries.filter("intent_hint <> ''").select("query_id", text.text("query").alias("query"), F.col("intent_hint").alias("intent"))
    base = kb.select("pos", *[text.text(c).alias(c) for c in ("question", "answer", "category", "intent")])
    base = base.withColumn("_n", F.row_number().over(Window.partitionBy("intent", "question").orderBy("pos"))).filter("_n = 1")
    base = base.withColumn("_n", F.row_number().over(Window.partitionBy("intent").orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")
    new = asked.join(base, "intent").join(candidates.select("query_id", "question").distinct(), ["query_id", "question"], "left_anti")
    new = new.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("hit_rank") <= limit)
    return new.withColumns({"vector_score": F.lit(0.0), "keyword_bonus": F.lit(0.0), "direction_penalty": F.lit(0.0), "score": F.lit(SUPPLEMENT_SCORE), "retrieval_origin": F.lit(ORIGIN_HINT)})


def reranked(candidates: DataFrame, hint: Column, weight: float | Column = MODEL_WEIGHT, model: str | None = None) -> DataFrame:
    """Candidates with model_rerank_score and rerank_score; model names a column of a cross-encoder's scores, 0 without."""
    m = F.col(model) if model else F.lit(0.0)
    w = F.lit(weight) if isinstance(weight, float) else weight
    follow = F.col("query").contains("怎么办") & (F.col("intent").contains("追问") | F.col("question").contains("追问"))
    hinted = (hint != "") & (F.col("intent") == hint)
    tie = hinted & (hint == "优惠券不可用") & F.col("query").contains("优惠券") & F.col("query").contains("满减")
    extra = F.when(follow, 0.02).otherwise(0.0) + F.when(hinted, HINT_BONUS).otherwise(0.0) + F.when(tie, 0.02).otherwise(0.0)
    return candidates.withColumn("model_rerank_score", m.cast("double")).withColumn("rerank_score", F.col("score") + F.col("model_rerank_score") * w + extra)


def rerank_order() -> list[Column]:
    """By rerank score; ties as the candidates came: hits by their rank, then supplements."""
    return [F.round("rerank_score", 9).desc(), F.col("retrieval_origin").asc(), F.col("hit_rank").asc(), F.col("pos").asc()]


def search(queries: DataFrame, kb: DataFrame, limit: int = LIMIT, min_score: float = MIN_SCORE, hybrid: bool = True, weight: float = MODEL_WEIGHT, model=None, hints=rules.INTENT_HINTS, exclude_self: bool = False) -> DataFrame:
    """The whole retrieval: nearest rows, scores, supplements, reranking, greedy deduplication; rank from 1.

    model: a function from a DataFrame of candidates (with query and rerank_text) to one with model_score, the cross-encoder.
    """
    hits = vector_topk(queries, kb, max(5 * limit, 20), exclude_self)
    asked = queries.withColumn("intent_hint", rules.intent_hint(text.text("query"), hints) if hints else F.lit(""))
    found = raw_candidates(hits, queries, kb, min_score, hybrid)
    # the nearest rows are found once: both the supplements and the reranking read this small table
    found = found.cache() if hints else found
    if hints:
        found = found.unionByName(hint_supplements(found, asked, kb))
    if model:
        found = model(found.withColumn("rerank_text", document_text(F.col("category"), F.col("intent"), F.col("question"), F.col("answer"))))
    found = found.join(asked.select("query_id", "intent_hint"), "query_id")
    found = reranked(found, F.col("intent_hint"), weight, "model_score" if model else None)
    return greedy_dedupe(found, ["query_id"], rerank_order(), limit)


def items(results: DataFrame) -> DataFrame:
    """Results as the API's flat items."""
    return results.select("query_id", "rank", "answer", "category", "intent", "question", "score", "rerank_score", "model_rerank_score", "vector_score", "keyword_bonus", "direction_penalty", "retrieval_origin")
