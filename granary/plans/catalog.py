"""Every query on the driver's tables by name, with its SQL.

The knowledge base is documents joined to embeddings by id: pos and question key are the id, answer the text, category
the source, intent the label. The base holds documents that have an embedding. Searches take as queries, whole, every
row whose id is divisible by 20, a stated query set; all rows are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import rules, text
from granary.operators import context, feedback, grounding, knowledge, retrieval, rule_match, training

MIN_SCORE, LIMIT = 0.20, 3
#: A small lexicon for the test tables, whose texts are invented words.
FIELDS = {"intent": 0.04, "category": 0.03, "answer": 0.01}
KEYWORDS = {"the": 0.2, "tion": 0.5, "src1": 1.0, "ment": 0.8, "lich": 0.6}
TOYS = [["the", "ing", "tion"], ["ment", "eau", "que"], ["lich", "keit", "und"], ["ción", "para", "los"]]
EXPRESSIONS = {"emotional": ["!"], "boundary": ["http", "@"], "standard": ["the", "que"]}
ANSWERS = {"action": ["ing"], "caution": ["not", "license"], "evidence": ["copyright"]}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def kb_view(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("answer"), F.col("source").alias("category"))
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.col("label").cast("string").alias("intent"))
    return docs.join(vectors, "pos").withColumn("question", F.concat(F.lit("q"), F.col("pos").cast("string")))


def asked(kb: DataFrame) -> DataFrame:
    return kb.filter(F.col("pos") % 20 == 0).select(F.col("pos").alias("query_id"), F.col("answer").alias("query"), F.col("embedding").alias("q_embedding"))


KB_SQL = """
kb AS (SELECT d.doc_id AS pos, d.text AS answer, d.source AS category, e.label::VARCHAR AS intent, 'q' || d.doc_id AS question, e.embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
q AS (SELECT pos AS query_id, answer AS query, v AS qv FROM kb WHERE pos % 20 = 0),
pairs AS (SELECT query_id, query, kb.*, round(list_cosine_similarity(qv, v), 6) + 0.0 AS vector_score FROM q JOIN kb ON kb.pos <> q.query_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, pos) AS hit_rank FROM pairs) WHERE hit_rank <= 20)
"""
BONUS_SQL = " + ".join(f"CASE WHEN contains(query, '{w}') AND contains({f}, '{w}') THEN {a * b!r}::DOUBLE ELSE 0.0::DOUBLE END" for f, a in FIELDS.items() for w, b in KEYWORDS.items())
RAW_SQL = f"{KB_SQL}, raw AS (SELECT *, vector_score + ({BONUS_SQL}) AS score, {BONUS_SQL} AS keyword_bonus FROM hits WHERE vector_score >= {MIN_SCORE})"


def _hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kb = kb_view(spark, sf)
    q = asked(kb)
    return q, kb, retrieval.vector_topk(q, kb.select("pos", "embedding"), 20, exclude_self=True)


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, kb, hits = _hits(spark, sf)
    return q, kb, retrieval.raw_candidates(hits, q, kb, MIN_SCORE, True, FIELDS, KEYWORDS)


@query(f"WITH {KB_SQL} SELECT query_id, pos, vector_score, hit_rank FROM hits WHERE vector_score >= {MIN_SCORE}")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)[2].filter(F.col("vector_score") >= MIN_SCORE)


@query(f"WITH {RAW_SQL} SELECT query_id, pos, round(score, 6) AS score, round(keyword_bonus, 6) AS keyword_bonus, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hit_rank) AS rank FROM raw")
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf)[2]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "hit_rank"))
    return raw.select("query_id", "pos", F.round("score", 6).alias("score"), F.round("keyword_bonus", 6).alias("keyword_bonus"), rank.alias("rank"))


#: In place of a cross-encoder: a number in [0, 1) from both ids.
MODEL = "CAST((query_id * 31 + pos * 17) % 97 AS DOUBLE) / CAST(97 AS DOUBLE)"
HINT_SQL = "(query_id % 10)::VARCHAR"
RERANK_SQL = f"{RAW_SQL}, re AS (SELECT *, score + (({MODEL})::DOUBLE) * w + CASE WHEN intent = {HINT_SQL} THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS rerank_score FROM raw CROSS JOIN (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE)) t(w)), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY round(rerank_score, 9) DESC, hit_rank) AS rank FROM re)"


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, sf)[2].withColumn("w", F.explode(F.array(F.lit(0.01), F.lit(0.03), F.lit(0.05)))).withColumn("model_score", F.expr(MODEL).cast("double"))
    out = retrieval.reranked(raw, (F.col("query_id") % 10).cast("string"), F.col("w"), "model_score")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "w").orderBy(F.round("rerank_score", 9).desc(), "hit_rank")))


@query(f"WITH {RERANK_SQL} SELECT query_id, w, pos, round(rerank_score, 6) AS rerank_score, rank FROM rk")
def rerank_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", "w", "pos", F.round("rerank_score", 6).alias("rerank_score"), "rank")


IMPACT_SQL = f"""{RERANK_SQL}, im AS (SELECT query_id, w, arg_min(intent, (-round(score, 9), rank)) AS a, arg_min(intent, rank) AS b, list(intent ORDER BY rank) AS l FROM rk WHERE rank <= 3 GROUP BY query_id, w),
ju AS (SELECT *, (SELECT intent FROM kb WHERE pos = query_id) AS e FROM im),
ru AS (SELECT query_id, w, a AS original_top_intent, b AS reranked_top_intent, a <> b AS top1_changed,
 CASE WHEN a = b THEN 'unchanged' WHEN a <> e AND b = e THEN 'improved' WHEN a = e AND b <> e THEN 'worsened' ELSE 'changed_neutral' END AS impact,
 CASE WHEN b = e THEN 'Top1 命中' WHEN list_contains(l, e) THEN 'Top3 召回但 Top1 错误' ELSE '未命中' END AS judgement FROM ju)"""


def _impact(spark: SparkSession, sf: str) -> DataFrame:
    truth = kb_view(spark, sf).select(F.col("pos").alias("query_id"), F.array("intent").alias("expected_intents"))
    top = _reranked(spark, sf).filter("rank <= 3").join(truth, "query_id").withColumn("query_id", F.struct("query_id", "w"))
    return grounding.rerank_impact(top).select("query_id.query_id", "query_id.w", "original_top_intent", "reranked_top_intent", "top1_changed", "impact", "judgement")


@query(f"WITH {IMPACT_SQL} SELECT * FROM ru")
def rerank_impact(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf)


@query(f"""WITH {IMPACT_SQL} SELECT w, count(*) AS total, count(*) FILTER (WHERE judgement LIKE 'Top1%') AS top1, count(*) FILTER (WHERE judgement LIKE 'Top3%') AS top3_error, count(*) FILTER (WHERE judgement NOT LIKE 'Top%') AS miss,
 count(*) FILTER (WHERE impact <> 'unchanged') AS changed_top1, count(*) FILTER (WHERE impact = 'improved') AS improved, count(*) FILTER (WHERE impact = 'worsened') AS worsened, count(*) FILTER (WHERE impact = 'unchanged') AS unchanged, count(*) FILTER (WHERE impact = 'changed_neutral') AS changed_neutral FROM ru GROUP BY w""")
def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.retrieval_summary(_impact(spark, sf), ["w"])


@query(f"""WITH {RAW_SQL}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent, question ORDER BY pos) AS n FROM kb) WHERE n = 1),
s AS (SELECT q.query_id, b.pos, b.intent, row_number() OVER (PARTITION BY q.query_id ORDER BY b.pos) AS hit_rank FROM q JOIN b ON b.intent = (q.query_id % 10)::VARCHAR
 WHERE NOT EXISTS (SELECT 1 FROM raw WHERE raw.query_id = q.query_id AND raw.question = b.question))
SELECT query_id, pos, intent, hit_rank, 0.80::DOUBLE AS score FROM s WHERE hit_rank <= 3""")
def hint_supplement(spark: SparkSession, sf: str) -> DataFrame:
    q, kb, raw = _raw(spark, sf)
    out = retrieval.hint_supplements(raw, q.withColumn("intent_hint", (F.col("query_id") % 10).cast("string")), kb)
    return out.select("query_id", "pos", "intent", "hit_rank", "score")


TERMS_SQL = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '[\\s]+'), lambda w: regexp_replace(regexp_replace(w, '^[?.!,;:，。！？；：、]+', ''), '[?.!,;:，。！？；：、]+$', '')), lambda w: w <> '' AND w NOT IN ('a','an','and','are','can','how','i','is','of','the','to','what','your')))"


@query(f"""WITH q AS (SELECT item_id AS query_id, text AS query, {TERMS_SQL.format('text')} AS t FROM benchmark),
d AS (SELECT doc_id AS pos, lower(source) AS category, lower(text) AS answer, {TERMS_SQL.format('source')} AS tc, {TERMS_SQL.format('text')} AS ta, length(text) AS n FROM documents),
qt AS (SELECT query_id, unnest(t) AS term FROM q), dt AS (SELECT pos, 3 AS w, unnest(tc) AS term FROM d WHERE category <> '' UNION ALL SELECT pos, 1, unnest(ta) FROM d WHERE answer <> ''),
m AS (SELECT query_id, pos, sum(w) AS points, count(*) AS terms FROM qt JOIN dt USING (term) GROUP BY 1, 2 UNION ALL
 SELECT query_id, pos, CASE WHEN contains(category, lower(query)) THEN 5 ELSE 0 END + CASE WHEN contains(answer, lower(query)) THEN 3 ELSE 0 END, 0 FROM q JOIN d ON contains(answer, lower(query)) OR contains(category, lower(query))),
s AS (SELECT query_id, pos, sum(points)::BIGINT AS score, sum(terms)::BIGINT AS matched_term_count FROM m GROUP BY 1, 2),
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched_term_count DESC, n, pos) AS rank FROM s JOIN d USING (pos))
SELECT query_id, pos, score, matched_term_count, rank FROM r WHERE rank <= 3""")
def keyword_rank(spark: SparkSession, sf: str) -> DataFrame:
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    kb = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("category"), F.col("text").alias("answer"))
    return retrieval.keyword_top(q, kb).select("query_id", "pos", F.col("score").cast("long").alias("score"), F.col("matched_term_count").cast("long").alias("matched_term_count"), "rank")


TOY_SQL = "[" + ", ".join("(" + " + ".join(f"contains({{0}}, '{w}')::INT" for w in ws) + ")::DOUBLE" for ws in TOYS) + "]"


@query(f"""WITH q AS (SELECT item_id AS query_id, {TOY_SQL.format('text')} AS a FROM benchmark), d AS (SELECT doc_id AS pos, {TOY_SQL.format('text')} AS b FROM documents),
p AS (SELECT query_id, pos, round(list_cosine_similarity(a, b), 6) AS score FROM q JOIN d ON list_sum(a) > 0 AND list_sum(b) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM p WHERE score > 0) SELECT query_id, pos, score, rank FROM r WHERE rank <= 3""")
def toy_vector(spark: SparkSession, sf: str) -> DataFrame:
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    kb = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("answer"))
    return retrieval.toy_topk(q, kb, LIMIT, TOYS, F.col("answer")).select("query_id", "pos", "score", "rank")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) > 0 AS first FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", text.collapsed(F.col("text")).alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))


CONTEXT_SQL = f"""{RERANK_SQL}, it AS (SELECT *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS plain FROM rk WHERE w = 0.01),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, plain ORDER BY rank) AS n FROM it WHERE plain <> '') WHERE n = 1),
nx AS (SELECT *, lead(rerank_score) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM de)"""


@query(f"""WITH {CONTEXT_SQL} SELECT query_id, place, pos, intent, CASE WHEN place = 1 THEN 'primary' ELSE 'supporting' END AS role, CASE WHEN place = 1 AND nxt IS NOT NULL AND rerank_score - nxt < 0.08 THEN 'close_match' ELSE 'normal' END AS evidence_strength,
 CASE WHEN length(plain) <= 120 THEN plain ELSE rtrim(substr(plain, 1, 120)) || '...' END AS evidence_summary FROM nx WHERE place <= 3""")
def context_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reranked(spark, sf).filter("w = 0.01")
    return context.context_items(rows).select("query_id", "place", "pos", "intent", "role", "evidence_strength", "evidence_summary")


#: The greedy walk is over the candidates of a query, a group that the search bounds.
KEY_SQL = "regexp_replace(lower({0}), '[\\s!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~，。！？；：、（）《》“”‘’]', '', 'g')"


@query(f"""WITH {RERANK_SQL}, a AS (SELECT query_id, pos, rank, answer, {KEY_SQL.format('answer')} AS k FROM rk WHERE w = 0.01),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, answer ORDER BY rank) AS n FROM a) WHERE n = 1),
g AS (SELECT *, CASE WHEN length(k) >= 2 THEN list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i::INT, 2))) WHEN length(k) = 1 THEN [k] ELSE []::VARCHAR[] END AS b FROM u),
f AS (SELECT query_id, list_reduce(list([{{'i': pos, 'k': k, 'b': b}}] ORDER BY rank), lambda x, y: CASE WHEN len(list_filter(x, lambda z: z.k <> '' AND y[1].k <> '' AND
 CASE WHEN contains(z.k, y[1].k) OR contains(y[1].k, z.k) THEN least(length(z.k), length(y[1].k)) / greatest(length(z.k), length(y[1].k)) >= 0.6
 ELSE len(list_intersect(z.b, y[1].b)) / greatest(1, len(z.b) + len(y[1].b) - len(list_intersect(z.b, y[1].b))) >= 0.72 END)) > 0 THEN x ELSE x || y END) AS l FROM g GROUP BY query_id)
SELECT query_id, unnest(list_transform(l, lambda x: x.i)) AS pos, unnest(range(1, len(l) + 1)) AS rank FROM f""")
def greedy_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = _reranked(spark, sf).filter("w = 0.01").select("query_id", "pos", F.col("rank").alias("place"), "answer")
    return retrieval.greedy_dedupe(rows, ["query_id"], [F.col("place")], None).select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}', '[phone]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[mail]', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\\1[手机号已脱敏]\\2', 'g'), '(^|[^0-9])[0-9]{12,20}($|[^0-9])', '\\1[订单号已脱敏]\\2', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(^|[^0-9])[0-9]{12,20}($|[^0-9])', '\\1[订单号已脱敏]\\2', 'g') AS t FROM b)
SELECT doc_id, length(t) AS n, md5(t) AS masked_md5 FROM c""")
def mask_pii(spark: SparkSession, sf: str) -> DataFrame:
    t = text.masked(F.col("text"), text.MASKS_EN + text.MASKS)
    return _t(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("masked_md5"))


WORDS = ("the", "tion", "eau", "lich", "para")


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations),
a AS (SELECT conv_id, turn, text AS reply, coalesce(evidence, '') AS evidence FROM t WHERE role = 'assistant'), k AS (SELECT *, list_filter(['the', 'tion', 'eau', 'lich', 'para'], lambda w: contains(evidence, w)) AS expected FROM a)
SELECT conv_id, turn, len(expected) AS expected, len(list_filter(expected, lambda w: contains(reply, w))) AS matched, array_to_string(list_filter(expected, lambda w: NOT contains(reply, w)), ',') AS missing FROM k""")
def evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf)
    matched, missing = text.found_and_missing(F.col("reply"), F.col("expected"))
    return rows.select("conv_id", "turn", F.size("expected").cast("long").alias("expected"), F.size(matched).cast("long").alias("matched"), F.array_join(missing, ",").alias("missing"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _t(spark, sf, "conversations").withColumn("evidence", before).filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"), text.text("evidence").alias("evidence"))
    return rows.withColumn("expected", F.filter(F.array(*map(F.lit, WORDS)), lambda w: F.col("evidence").contains(w)))


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a benchmark text, met at the text's rarest anchor (phrases.containing)."""
    b = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    d = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return retrieval.containing(d, b, "body", "item_id").select("item_id", "doc_id")


@query("""WITH t AS (SELECT conv_id, turn, text AS reply FROM conversations WHERE role = 'assistant'),
w AS (SELECT conv_id, turn, reply, unnest(['the', 'tion', 'eau', 'lich']) AS word FROM t), p AS (SELECT *, strpos(reply, word) AS p0 FROM w WHERE contains(reply, word)),
h AS (SELECT *, substr(reply, greatest(1, p0 - 30), p0 + length(word) + 12 - greatest(1, p0 - 30)) AS near FROM p)
SELECT conv_id, turn, count(*) AS hits FROM h WHERE NOT (contains(near, ' of ') OR contains(near, ' und ') OR contains(near, ' de ')) GROUP BY conv_id, turn""")
def forbidden_hits(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, ("the", "tion", "eau", "lich")))
    rows = _t(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.forbidden_hits(F.col("text"), words, (" of ", " und ", " de ")).alias("h"))
    return rows.select("conv_id", "turn", F.size("h").cast("long").alias("hits")).filter("hits > 0")


REPORT_SQL = """r AS (SELECT l.doc_id, d.source, CASE WHEN quality = 1 THEN 'yes' WHEN l.doc_id % 3 = 0 THEN 'partial' ELSE 'no' END AS direct_answer, CASE WHEN toxic = 0 THEN 'yes' WHEN l.doc_id % 2 = 0 THEN 'partial' ELSE 'no' END AS grounded,
 CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS useful, CASE WHEN l.doc_id % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS judge_status, l.doc_id % 7 > 0 AS items, l.doc_id % 5 = 0 AS risky, l.doc_id % 4 > 0 AS used, l.doc_id % 9 = 0 AS mixed, (l.doc_id % 4)::VARCHAR AS top1, (l.doc_id % 5)::VARCHAR AS expected, l.doc_id % 13 = 0 AS absent
 FROM labels l JOIN documents d USING (doc_id)), b AS (SELECT *, direct_answer <> 'yes' OR grounded <> 'yes' OR useful <> 'yes' AS bad FROM r)"""


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports made of labels: quality stands for a direct and useful answer, toxicity for a lack of grounding."""
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    i = F.col("doc_id")
    score = F.struct(F.when(F.col("quality") == 1, "yes").when(i % 3 == 0, "partial").otherwise("no").alias("direct_answer"), F.when(F.col("toxic") == 0, "yes").when(i % 2 == 0, "partial").otherwise("no").alias("grounded"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("useful"), F.lit("").alias("notes"))
    items = F.when(i % 7 > 0, F.array(F.struct((i % 4).cast("string").alias("intent")))).otherwise(F.expr("slice(array(named_struct('intent', '')), 1, 0)"))
    rows = rows.withColumns({
        "query": i.cast("string"), "pos": i, "reply": F.lit(""), "manual_judgment": score, "judge_status": F.when(i % 11 == 0, "failed").otherwise("succeeded"), "judge_failure_type": F.when(i % 11 == 0, "not_json").otherwise(""), "retrieved_items": items,
        "risky_promises": F.when(i % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "used_primary_evidence": i % 4 > 0, "mixed_supporting_intent": i % 9 == 0, "expected_intent": (i % 5).cast("string"),
        "final_prompt": F.lit("p"), "needs_manual_review": i % 5 == 0, "retrieved_documents": F.array(F.lit("known")), "missing_evidence_keywords": F.when(i % 13 == 0, F.array(F.lit("gone"))).otherwise(F.array(F.lit("known"))),
        "matched_evidence_keywords": F.array(F.lit("known")), "expected_evidence_keywords": F.array(F.lit("known"), F.lit("gone")), "forbidden_keyword_hits": F.when(i % 17 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")),
    })
    return grounding.classified(rows)


@query(f"""WITH {REPORT_SQL} SELECT doc_id, CASE WHEN NOT items THEN 'retrieval_bad' WHEN risky THEN 'safety_overclaim' WHEN grounded = 'no' THEN 'generation_not_grounded' WHEN direct_answer <> 'yes' THEN 'generation_not_direct' WHEN grounded = 'partial' THEN 'generation_not_grounded' ELSE 'judge_or_other' END AS issue_type,
 CASE WHEN judge_status = 'failed' THEN 'judge' WHEN NOT bad THEN 'pass' WHEN NOT items THEN 'retrieval' WHEN mixed THEN 'context_builder_or_reply_rules' WHEN risky THEN 'reply_rules' WHEN used AND grounded = 'no' THEN 'judge' WHEN NOT used OR direct_answer <> 'yes' THEN 'generation_or_reply_rules' ELSE 'judge' END AS suggested_layer,
 CASE WHEN NOT bad THEN 'pass' WHEN judge_status = 'failed' THEN 'judge' WHEN NOT items OR top1 <> expected THEN 'retrieval_failure' WHEN absent THEN 'evidence_insufficient' WHEN grounded <> 'yes' OR direct_answer <> 'yes' OR risky THEN 'generation_not_using_evidence' ELSE 'judge_or_other' END AS attribution FROM b""")
def failure_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("doc_id", "issue_type", "suggested_layer", "attribution")


@query(f"WITH {REPORT_SQL}, l AS (SELECT CASE WHEN judge_status = 'failed' THEN 'judge' WHEN NOT bad THEN 'pass' WHEN NOT items THEN 'retrieval' WHEN mixed THEN 'context_builder_or_reply_rules' WHEN risky THEN 'reply_rules' WHEN used AND grounded = 'no' THEN 'judge' WHEN NOT used OR direct_answer <> 'yes' THEN 'generation_or_reply_rules' ELSE 'judge' END AS suggested_layer FROM b) SELECT suggested_layer, count(*) AS n FROM l GROUP BY 1")
def issue_layer_hist(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.histogram(_reports(spark, sf), "suggested_layer")


@query(f"""WITH {REPORT_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE risky) AS manual_review_count, count(*) FILTER (WHERE used) AS used_primary_evidence_count, count(*) FILTER (WHERE mixed) AS mixed_supporting_intent_count,
 count(*) FILTER (WHERE judge_status = 'succeeded') AS judge_succeeded, count(*) FILTER (WHERE judge_status = 'failed') AS judge_failed, 0::BIGINT AS judge_not_run, 0::BIGINT AS failure_empty_response, count(*) FILTER (WHERE judge_status = 'failed') AS failure_not_json, 0::BIGINT AS failure_missing_field, 0::BIGINT AS failure_invalid_enum, 0::BIGINT AS failure_empty_reason, 0::BIGINT AS failure_other,
 {", ".join(f"count(*) FILTER (WHERE {f} = '{v}') AS {f}_{v}" for f in ("direct_answer", "grounded", "useful") for v in ("yes", "partial", "no", "empty"))} FROM r GROUP BY source""")
def grounding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.summary(_reports(spark, sf), ["source"])


@query(f"""WITH {REPORT_SQL}, m AS (SELECT source, count(*) AS total_cases, count(*) AS expected_intent_case_count, count(*) FILTER (WHERE items AND top1 = expected) AS top1_intent_hit_count, count(*) AS matched_evidence_keyword_count, 2 * count(*) AS expected_evidence_keyword_count,
 count(*) FILTER (WHERE doc_id % 17 = 0) AS forbidden_hit_count, count(*) FILTER (WHERE NOT bad) AS judge_pass_count FROM b GROUP BY source)
SELECT *, round(top1_intent_hit_count / expected_intent_case_count, 4) AS top1_intent_hit_rate, round(matched_evidence_keyword_count / expected_evidence_keyword_count, 4) AS evidence_keyword_coverage, round(judge_pass_count / total_cases, 4) AS judge_pass_rate FROM m""")
def grounding_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.metrics(_reports(spark, sf), ["source"])


@query("""WITH a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS s, CASE toxic WHEN 1 THEN 'no' ELSE 'yes' END AS g FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CASE s WHEN 'yes' THEN 'no' ELSE 'yes' END ELSE s END AS s, CASE WHEN doc_id % 10 = 3 THEN 'partial' ELSE g END AS g FROM a WHERE doc_id % 6 > 0)
SELECT a.doc_id, CASE WHEN (a.s = 'yes' AND a.g = 'yes') AND NOT (b.s = 'yes' AND b.g = 'yes') THEN 'worsened' WHEN NOT (a.s = 'yes' AND a.g = 'yes') AND (b.s = 'yes' AND b.g = 'yes') THEN 'improved' WHEN a.s = b.s AND a.g = b.g THEN 'unchanged' ELSE 'changed' END AS transition FROM a JOIN b USING (doc_id)""")
def report_compare(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    a = _t(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("s"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("g"))
    b = a.filter(i % 6 > 0).select("doc_id", F.when(i % 7 == 0, F.when(F.col("s") == "yes", "no").otherwise("yes")).otherwise(F.col("s")).alias("s"), F.when(i % 10 == 3, "partial").otherwise(F.col("g")).alias("g"))
    run = lambda d: d.select(i.alias("query"), i.alias("pos"), F.struct(F.col("s").alias("direct_answer"), F.col("g").alias("grounded"), F.col("s").alias("useful")).alias("manual_judgment"))
    return grounding.compare(run(a), run(b)).select(F.col("query").alias("doc_id"), "transition")


COMPARE_SQL = """WITH a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS s, CASE toxic WHEN 1 THEN 'no' ELSE 'yes' END AS g FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CASE s WHEN 'yes' THEN 'no' ELSE 'yes' END ELSE s END AS s, CASE WHEN doc_id % 10 = 3 THEN 'partial' ELSE g END AS g FROM a WHERE doc_id % 6 > 0)
SELECT a.doc_id, CASE WHEN (a.s = 'yes' AND a.g = 'yes') AND NOT (b.s = 'yes' AND b.g = 'yes') THEN 'worsened' WHEN NOT (a.s = 'yes' AND a.g = 'yes') AND (b.s = 'yes' AND b.g = 'yes') THEN 'improved' WHEN a.s = b.s AND a.g = b.g THEN 'unchanged' ELSE 'changed' END AS transition FROM a JOIN b USING (doc_id)"""


@query(f"""WITH c AS ({COMPARE_SQL}), k(place, key) AS (VALUES (0, 'improved'), (1, 'worsened'), (2, 'unchanged'), (3, 'changed')) SELECT place, key, (SELECT count(*) FROM c WHERE transition = key) AS n FROM k""")
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many cases of the two compared runs went which way."""
    return grounding.transition_counts(QUERIES["report_compare"](spark, sf))


@query("""WITH r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS s, CASE doc_id % 4 WHEN 0 THEN 'not_json' WHEN 1 THEN 'missing_field' WHEN 2 THEN 'strange' ELSE 'empty_reason' END AS t FROM labels),
k(place, key) AS (VALUES (0, 'empty_response'), (1, 'not_json'), (2, 'missing_field'), (3, 'invalid_enum'), (4, 'empty_reason'), (5, 'other'))
SELECT place, key, (SELECT count(*) FROM r WHERE s = 'failed' AND CASE WHEN t = 'strange' THEN 'other' ELSE t END = key) AS n FROM k""")
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of judges over the labelled documents, by all kinds, those that never occur and unknown ones included."""
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "not_json").when(i % 4 == 1, "missing_field").when(i % 4 == 2, "strange").otherwise("empty_reason")
    return grounding.failure_counts(_t(spark, sf, "labels").select(F.when(i % 11 == 0, "failed").otherwise("succeeded").alias("judge_status"), kind.alias("judge_failure_type")))


@query("WITH a AS (SELECT n_name AS key, n_regionkey AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE n_regionkey + 1 END AS value FROM nation WHERE n_nationkey > 4) SELECT key, a.value AS base, b.value AS target FROM a FULL JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value")
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    a = n.filter("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))
    b = n.filter("n_nationkey > 4").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey")).otherwise(F.col("n_regionkey") + 1).alias("value"))
    return grounding.config_diff(a, b)


@query("""WITH t AS (SELECT event_id, value, event_type, json_extract_string(props, '$.k')::INT AS k FROM events), l AS (SELECT value FROM t ORDER BY event_id DESC LIMIT 1000), s AS (SELECT list(coalesce(value, 0) ORDER BY coalesce(value, 0)) AS a, count(*) AS n FROM l)
SELECT count(*) AS request_count, count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ('', 'none', 'click', 'view')) AS failure_count, count(*) FILTER (WHERE coalesce(k, 0) = 0) AS empty_retrieval_count, count(*) FILTER (WHERE k % 2 = 1) AS reply_rules_hit_count, count(*) FILTER (WHERE k % 5 = 0) AS fallback_count,
 (SELECT round(list_sum(a) / n, 2) FROM s) AS average_latency_ms, (SELECT round(a[least(floor(n * 0.95)::INT, n - 1) + 1], 2) FROM s) AS p95_latency_ms FROM t""")
def ops_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t = e.select(F.col("event_id").alias("seq"), F.lit(False).alias("degraded"), F.when(F.col("event_type").isin("click", "view"), "none").otherwise(F.col("event_type")).alias("failure_stage"), F.col("k").alias("retrieval_count"), (F.col("k") % 2 == 1).alias("reply_rules_applied"), F.lit(False).alias("used_fallback_prompt"), F.when(F.col("k") % 5 == 0, "fallback").otherwise("rag").alias("answer_source"), F.col("value").alias("latency_ms"))
    return feedback.ops_metrics(t)


@query("SELECT l.doc_id AS id, d.source AS top1_intent, quality = 1 AS helpful FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0 ORDER BY d.n_chars DESC, l.doc_id DESC LIMIT 20")
def feedback_recent(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("top1_intent"), (F.col("quality") == 1).alias("helpful"), F.col("n_chars").alias("created_at"))
    return feedback.recent(rows, 20, helpful=False).drop("created_at")


KB_ITEMS = "SELECT o_orderkey AS id, o_custkey::VARCHAR AS base_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS version, o_orderpriority AS question, o_orderstatus AS answer, 'c' AS category, 'i' AS intent, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'draft' ELSE 'published' END AS status, o_orderdate AS updated_at FROM orders"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "draft").otherwise("published")
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("base_id"), version.alias("version"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.lit("c").alias("category"), F.lit("i").alias("intent"), status.alias("status"), F.lit("").alias("review_note"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp").alias("reviewed_at"))


@query(f"WITH i AS ({KB_ITEMS}), e AS (SELECT o_orderkey + 1000000000 AS id, o_custkey::VARCHAR AS base_id FROM orders WHERE o_orderkey % 10 = 0), m AS (SELECT base_id, max(version) AS v FROM i GROUP BY base_id) SELECT e.id, e.base_id, (m.v + row_number() OVER (PARTITION BY e.base_id ORDER BY e.id))::INT AS version, 'draft' AS status FROM e JOIN m USING (base_id)")
def kb_versions(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    edits = items.filter("id % 10 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "base_id", "question", "answer", "category", "intent", F.col("updated_at").alias("at"))
    return knowledge.next_versions(items, edits).filter("id >= 1000000000").select("id", "base_id", "version", "status")


@query(f"WITH i AS ({KB_ITEMS}) SELECT base_id || '_v' || version AS id, question, answer, 'knowledge_ops' AS source, 'reviewed' AS quality FROM i WHERE status = 'approved'")
def kb_publish(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.payload(_items(spark, sf).filter("status = 'approved'")).select("id", "question", "answer", "source", "quality")


@query(f"WITH i AS ({KB_ITEMS}) SELECT id, base_id, version, status FROM i WHERE status = 'draft' AND (question ILIKE '%urg%' OR answer ILIKE '%urg%') ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 10")
def kb_list(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.page(_items(spark, sf), 50, 10, status="draft", keyword="urg")[1].select("id", "base_id", "version", "status")


@query("""WITH c AS (SELECT source AS intent, count(*) AS sample_count, string_agg(DISTINCT lang, '/' ORDER BY lang) AS category, count(*) FILTER (WHERE contains(text, '!')) AS emotional, count(*) FILTER (WHERE contains(text, 'http') OR contains(text, '@')) AS boundary, count(*) FILTER (WHERE contains(text, 'ing')) AS act, count(*) FILTER (WHERE contains(text, 'not') OR contains(text, 'license')) AS caution FROM documents GROUP BY source)
SELECT intent, sample_count, category, array_to_string(list_filter([CASE WHEN sample_count <= 2 THEN 'sample_count_low' END, CASE WHEN emotional = 0 THEN 'missing_emotional_expression' END, CASE WHEN boundary = 0 THEN 'missing_boundary_expression' END, CASE WHEN act = 0 THEN 'answer_missing_action' END, CASE WHEN caution = 0 THEN 'answer_missing_caution' END], lambda x: x IS NOT NULL), ',') AS risks,
 emotional, caution FROM c""")
def kb_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.audit(_audited(spark, sf), EXPRESSIONS, ANSWERS)
    n = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0)).cast("long")
    return rows.select("intent", "sample_count", "category", F.array_join("risks", ",").alias("risks"), n("expression_counts", "emotional").alias("emotional"), n("answer_signal_counts", "caution").alias("caution"))


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("source").alias("intent"), F.col("lang").alias("category"), F.lit("single_turn").alias("dialogue_type"), F.col("text").alias("question"), F.col("text").alias("answer"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT p.a || ' vs ' || p.b AS pair, x.n AS left_count, y.n AS right_count FROM (VALUES ('src0', 'src1'), ('src2', 'src19'), ('src3', 'nosuch')) p(a, b) JOIN c x ON x.source = p.a JOIN c y ON y.source = p.b")
def confusion_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = training.audit(_audited(spark, sf), EXPRESSIONS, ANSWERS)
    return training.confusion_pairs(rows, [("src0", "src1"), ("src2", "src19"), ("src3", "nosuch")]).select("pair", "left_count", "right_count")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a base without vectors."""
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("answer"), F.col("source").alias("category"), "lang")


@query("SELECT source AS category, count(*) AS n FROM documents GROUP BY source")
def category_list(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.categories(_documents(spark, sf))


@query("SELECT doc_id, md5(text) AS m FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 10")
def by_category(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.of_category(_documents(spark, sf), "src3").select(F.col("pos").alias("doc_id"), F.md5(F.col("answer").cast("binary")).alias("m"))


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'ightly') OR contains(source, 'src1') ORDER BY doc_id LIMIT 10")
def search_examples(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    found = knowledge.containing(docs, "ightly", fields=("answer",)).unionByName(knowledge.containing(docs, "src1", fields=("category",)))
    return found.select(F.col("pos").alias("doc_id"), "lang").distinct().orderBy("doc_id").limit(10)


@query("SELECT doc_id, CASE WHEN contains(text, '“') THEN 5 ELSE 3 END AS turns, md5(text) AS answer FROM documents")
def sft_messages(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("q").alias("question"), F.col("text").alias("answer"), F.col("source").alias("category"), F.col("lang").alias("intent"), F.lit("neutral").alias("sentiment"), F.lit("high").alias("quality"), F.when(F.col("text").contains("“"), "multi_turn").otherwise("single_turn").alias("dialogue_type"), F.create_map().cast("map<string,string>").alias("entities"))
    m = training.messages(d)
    return m.select(F.substring("metadata.id", 2, 20).cast("long").alias("doc_id"), F.size("messages").alias("turns"), F.md5(F.element_at("messages", -1)["content"].cast("binary")).alias("answer"))


@query("SELECT 'train' AS split, floor(count(*) * 0.8)::BIGINT AS n FROM documents UNION ALL SELECT 'val', (floor(count(*) * 0.9) - floor(count(*) * 0.8))::BIGINT FROM documents UNION ALL SELECT 'test', (count(*) - floor(count(*) * 0.9))::BIGINT FROM documents")
def sft_split(spark: SparkSession, sf: str) -> DataFrame:
    return training.split(_t(spark, sf, "documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT field, value, count(*) AS n FROM (SELECT 'category' AS field, source AS value FROM documents UNION ALL SELECT 'dialogue_type', lang FROM documents UNION ALL SELECT 'quality', CASE WHEN n_chars > 1000 THEN 'high' ELSE 'medium' END FROM documents) GROUP BY 1, 2")
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    return training.profile(_t(spark, sf, "documents").select(F.col("source").alias("category"), F.col("lang").alias("dialogue_type"), F.when(F.col("n_chars") > 1000, "high").otherwise("medium").alias("quality")))


def _hint_queries() -> list[str]:
    """Queries that meet each alternative of each hint by its first and by its last terms, and those cut short by a clause."""
    found = []
    for rule, _ in rules.INTENT_HINTS:
        for way in rule.split(" OR "):
            terms = [c[2:].split("|") for c in way.split(" & ") if c.startswith("q:")]
            found += ["，".join(t[0] for t in terms), "，".join(t[-1] for t in terms), "，".join(t[0] for t in terms[1:])]
    return found


def _rule_sql(rule: str, columns: dict[str, str]) -> str:
    """A condition of the rules in SQL."""
    ways = []
    for way in rule.split(" OR "):
        clauses = []
        for c in way.split(" & "):
            bare = c.strip().removeprefix("!")
            terms = ["'" + t.replace("'", "''") + "'" for t in bare[2:].split("|")]
            column = columns[bare[0]]
            any_of = f"{column} IN ({', '.join(terms)})" if bare[1] == "=" else "(" + " OR ".join(f"contains({column}, {t})" for t in terms) + ")"
            clauses.append(f"NOT {any_of}" if c.strip().startswith("!") else any_of)
        ways.append("(" + " AND ".join(clauses) + ")")
    return " OR ".join(ways)


HINT_ROWS = ", ".join(f"({i}, '{q}')" for i, q in enumerate(_hint_queries()))
HINT_CASE = "CASE " + " ".join(f"WHEN {_rule_sql(r, {'q': 'query'})} THEN '{i}'" for r, i in rules.INTENT_HINTS) + " ELSE '' END"


@query(f"WITH p(i, phrase) AS (VALUES {HINT_ROWS}), q AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || phrase AS query FROM conversations JOIN p ON i = (conv_id * 7 + turn) % {len(_hint_queries())}) SELECT conv_id, turn, {HINT_CASE} AS intent FROM q")
def intent_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The hinted intents of all turns of conversations, each with a customer's phrase added, as the tables' own words are invented."""
    phrases = _hint_queries()
    phrase = F.element_at(F.array(*map(F.lit, phrases)), ((F.col("conv_id") * 7 + F.col("turn")) % len(phrases) + 1).cast("int"))
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", F.concat(text.text("text"), F.lit(" "), phrase).alias("query"))
    return rows.select("conv_id", "turn", rules.intent_hint(F.col("query")).alias("intent"))


#: Rules in the words that the test tables have.
ASKS = [("q:tion & q:eau|lich & !q:ing", "mixed"), ("q:license|copyright OR q:http & q:the", "notice"), ("q:ción|para", "spanish"), ("q:eau|que & !q:the", "french"), ("q:lich|keit|ung & q:und|der", "german"), ("q:ing & q:the & q:tion", "english"), ("q:on", "other")]


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'tion') AND (contains(text, 'eau') OR contains(text, 'lich')) AND NOT contains(text, 'ing') THEN 'mixed'
 WHEN contains(text, 'license') OR contains(text, 'copyright') OR (contains(text, 'http') AND contains(text, 'the')) THEN 'notice'
 WHEN contains(text, 'ción') OR contains(text, 'para') THEN 'spanish' WHEN (contains(text, 'eau') OR contains(text, 'que')) AND NOT contains(text, 'the') THEN 'french'
 WHEN (contains(text, 'lich') OR contains(text, 'keit') OR contains(text, 'ung')) AND (contains(text, 'und') OR contains(text, 'der')) THEN 'german'
 WHEN contains(text, 'ing') AND contains(text, 'the') AND contains(text, 'tion') THEN 'english' WHEN contains(text, 'on') THEN 'other' ELSE '' END AS result FROM conversations""")
def rule_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds for each turn, with the rules as a table."""
    return rule_match.first_matched(_t(spark, sf, "conversations"), rule_match.rule_terms(spark, ASKS), ["conv_id", "turn"], {"q": "text"}).select("conv_id", "turn", "result")


#: Rules over a reply (r), the turn before it (d) and a role of the conversation (i).
CHECKS = [("i=even & d:the & r:the", "both"), ("i=odd & d:tion|ment & r:tion & !r:eau", "odd_tion"), ("d:and & r:and & r:or|er OR d:of & r:of", "linked"), ("r:ing|ed & !d:ing", "new_form")]


@query("""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS r, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS d FROM conversations), a AS (SELECT * FROM t WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, 'both' AS result FROM a WHERE conv_id % 2 = 0 AND contains(d, 'the') AND contains(r, 'the')
 UNION ALL SELECT conv_id, turn, 'odd_tion' FROM a WHERE conv_id % 2 = 1 AND (contains(d, 'tion') OR contains(d, 'ment')) AND contains(r, 'tion') AND NOT contains(r, 'eau')
 UNION ALL SELECT conv_id, turn, 'linked' FROM a WHERE (contains(d, 'and') AND contains(r, 'and') AND (contains(r, 'or') OR contains(r, 'er'))) OR (contains(d, 'of') AND contains(r, 'of'))
 UNION ALL SELECT conv_id, turn, 'new_form' FROM a WHERE (contains(r, 'ing') OR contains(r, 'ed')) AND NOT contains(d, 'ing')) SELECT conv_id, turn, result FROM m""")
def rule_all(spark: SparkSession, sf: str) -> DataFrame:
    """All rules that hold for each reply and what stands before it, with the rules as a table."""
    rows = _turns(spark, sf).withColumn("parity", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    return rule_match.matched(rows, rule_match.rule_terms(spark, CHECKS), ["conv_id", "turn"], {"r": "reply", "d": "evidence", "i": "parity"}).select("conv_id", "turn", "result")


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations),
k AS (SELECT conv_id, turn, text AS reply, list_filter({list(WORDS)}, lambda w: contains(coalesce(evidence, ''), w)) AS expected FROM t WHERE role = 'assistant'),
h AS (SELECT conv_id, turn, CASE WHEN len(expected) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(expected, lambda w: contains(coalesce(reply, ''), w)))::DOUBLE / len(expected) END AS hit_rate FROM k)
SELECT conv_id, turn, round(hit_rate, 6) AS hit_rate, CASE WHEN hit_rate = 1 THEN 'OK' WHEN hit_rate >= 0.5 THEN '部分命中' WHEN hit_rate > 0 THEN '弱命中' ELSE '未命中' END AS band FROM h""")
def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    from granary.plans import evaluation

    rows = evaluation.hit_rates(_turns(spark, sf), "reply", "expected")
    return rows.select("conv_id", "turn", F.round("hit_rate", 6).alias("hit_rate"), "band")


@query("""WITH old AS (SELECT o_orderkey::VARCHAR AS request_id, o_orderstatus AS query FROM orders WHERE o_orderkey % 3 > 0),
new AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderkey::VARCHAR END AS request_id, o_orderpriority AS query FROM orders WHERE o_orderkey % 2 = 0), real AS (SELECT * FROM new WHERE trim(request_id) <> '')
SELECT * FROM real UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM real WHERE real.request_id = old.request_id)""")
def session_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with new ones in place of those of their ids; blank ids are left out."""
    o = _t(spark, sf, "orders").withColumn("key", F.col("o_orderkey").cast("string"))
    old = o.filter("o_orderkey % 3 > 0").select(F.col("key").alias("request_id"), F.col("o_orderstatus").alias("query"), F.col("o_orderdate").alias("created_at"))
    new = o.filter("o_orderkey % 2 = 0").select(F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("key")).alias("request_id"), F.col("o_orderpriority").alias("query"), F.col("o_orderdate").alias("created_at"))
    return feedback.upsert(old, new).select("request_id", "query")


@query("""SELECT 'feedback_' || doc_id AS id, 'feedback_bad_case' AS scenario, 'feedback' AS case_type, CASE WHEN doc_id % 3 = 0 THEN '待人工确认' ELSE 'i' || quality END AS expected_intent,
 'reason=' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'r' || toxic END || '; expected_reply=e' || doc_id AS notes FROM labels""")
def feedback_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback as drafts of evaluation cases, its intent read from the trace."""
    i = F.col("doc_id")
    trace = F.to_json(F.struct(F.when(i % 3 > 0, F.concat(F.lit("i"), "quality")).alias("top1_intent")))
    rows = _t(spark, sf, "labels").select(i.alias("id"), F.lit("").alias("request_id"), F.lit("q").alias("query"), F.lit("").alias("reply"), F.lit(False).alias("helpful"), F.when(i % 5 > 0, F.concat(F.lit("r"), "toxic")).alias("reason"), F.concat(F.lit("e"), i).alias("expected_reply"), trace.alias("trace_json"), F.lit(0).alias("created_at"))
    return feedback.eval_cases(feedback.feedback_rows(rows)).select("id", "scenario", "case_type", "expected_intent", "notes")


def _calibration_rows() -> list[tuple[str, str, str, str]]:
    """Query, intent, documents and reply that meet each alternative of each calibration by its first terms, and the same with an empty reply."""
    found = []
    for _, _, rule in rules.CALIBRATION:
        for way in rule.split(" OR "):
            own = {f: "，".join(c.strip()[2:].split("|")[0] for c in way.split(" & ") if c.strip()[0] == f) for f in "qidr"}
            found += [(own["q"], own["i"], own["d"], own["r"]), (own["q"], own["i"], own["d"], "")]
    return found


CALIBRATION_ROWS = ", ".join(f"({i}, '{q}', '{n}', '{d}', '{r}')" for i, (q, n, d, r) in enumerate(_calibration_rows()))
CALIBRATION_LIST = ", ".join("CASE WHEN " + _rule_sql(r, {"q": "q", "i": "i", "d": "d", "r": "r"}) + f" THEN '{n}' END" for n, _, r in rules.CALIBRATION)


@query(f"WITH c(id, q, i, d, r) AS (VALUES {CALIBRATION_ROWS}), t AS (SELECT doc_id, q, i, d || ' ' || text AS d, r FROM documents JOIN c ON c.id = doc_id % {len(_calibration_rows())}) SELECT doc_id, array_to_string(list_filter([{CALIBRATION_LIST}], lambda x: x IS NOT NULL), ',') AS rules FROM t")
def calibration_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The calibrations that hold, in order, for cases whose retrieved text is a case's with a whole document after it."""
    cases = F.broadcast(spark.createDataFrame([(k, *c) for k, c in enumerate(_calibration_rows())], "id long, q string, i string, d string, r string"))
    rows = _t(spark, sf, "documents").withColumn("id", F.col("doc_id") % len(_calibration_rows())).join(cases, "id").withColumn("d", F.concat("d", F.lit(" "), "text"))
    fields = {f: F.col(f) for f in "qidr"}
    met = [F.when(rules.condition(rule, fields), name) for name, _, rule in rules.CALIBRATION]
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*met)), ",").alias("rules"))


@query("""WITH t AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b, doc_id % 4 = 0 AS c FROM labels),
r AS (SELECT doc_id::VARCHAR AS query, CASE WHEN a THEN 0 WHEN c THEN 1 ELSE 2 END AS x, CASE WHEN b THEN 1 WHEN c THEN 0 ELSE 2 END AS y FROM t)
SELECT query, ['top1', 'ranking_error', 'miss'][x + 1] AS base_type, ['top1', 'ranking_error', 'miss'][y + 1] AS target_type, CASE WHEN y < x THEN 'improved' WHEN y > x THEN 'worsened' ELSE 'unchanged' END AS transition FROM r""")
def retrieval_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two retrieval runs over the labelled documents, each case's judgement made from its labels."""
    rows, judgements = _t(spark, sf, "labels"), ("Top1 命中", "Top3 召回但 Top1 错误", "未命中")
    run = lambda first, second, k: rows.select(F.col("doc_id").cast("string").alias("query"), F.col("doc_id").alias("pos"), F.when(first, judgements[k]).when(second, judgements[1 - k]).otherwise(judgements[2]).alias("judgement"))
    c = F.col("doc_id") % 4 == 0
    return grounding.compare_retrieval(run(F.col("quality") == 1, c, 0), run(F.col("toxic") == 1, c, 1)).select("query", "base_type", "target_type", "transition")


@query(f"""WITH r AS (SELECT l.doc_id AS id, 'i' || quality AS expected, 'i' || toxic AS got, list_filter({list(WORDS[:2])}, lambda w: NOT contains(coalesce(d.text, ''), w)) AS missing, list_filter({list(WORDS[2:])}, lambda w: contains(coalesce(d.text, ''), w)) AS hits FROM labels l JOIN documents d USING (doc_id))
SELECT id, expected = got AND len(missing) = 0 AND len(hits) = 0 AS passed, concat_ws('|', CASE WHEN expected <> got THEN 'top1 intent expected ' || expected || ', got ' || got END, CASE WHEN len(missing) > 0 THEN 'missing reply keywords: [''' || array_to_string(missing, ''', ''') || ''']' END,
 CASE WHEN len(hits) > 0 THEN 'forbidden reply hits: [''' || array_to_string(hits, ''', ''') || ''']' END) AS failures FROM r""")
def smoke_results(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as replies of a smoke test, checked for intents and for wanted and unwanted words."""
    labels = _t(spark, sf, "labels")
    cases = labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("i"), "quality").alias("expected_top1_intent"), F.array(*map(F.lit, WORDS[:2])).alias("expected_reply_keywords"), F.array(*map(F.lit, WORDS[2:])).alias("forbidden_reply_keywords"))
    replies = _t(spark, sf, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("reply"), F.array(F.struct(F.concat(F.lit("i"), "toxic").alias("intent"))).alias("retrieved_items"))
    return grounding.smoke(cases, replies).select("id", "passed", F.array_join("failures", "|").alias("failures"))


@query()
def chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole answer to every query: one row each."""
    from granary.plans import chat
    from granary.sources.readers import Settings

    kb = kb_view(spark, sf)
    rows = chat.answers(asked(kb), kb, Settings(min_vector_score=MIN_SCORE), exclude_self=True)
    return rows.select("query_id", "reply", "confidence_score", F.size("retrieved_items").alias("n_items"), "used_primary_evidence", "suggested_layer", F.md5(F.col("final_prompt").cast("binary")).alias("prompt_md5"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval and evidence for every query of the small tables."""
    q, kb, raw = _raw(spark, sf_dir)
    found = retrieval.reranked(raw, F.lit(""))
    kept = retrieval.greedy_dedupe(found, ["query_id"], retrieval.rerank_order(), LIMIT)
    return context.context_items(kept).select("query_id", "rank", F.col("pos").alias("doc_id"), "category", "intent", "score", "rerank_score", "role", "evidence_strength")
