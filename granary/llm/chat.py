"""Preference formatting of chosen and rejected conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands before and after a turn's text; {role} is the turn's.
BEFORE, AFTER = "<|im_start|>{role}\n", "<|im_end|>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"


def preference_pairs(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row for each pair: _pair, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.

    turns: _pair, _side (chosen or rejected), _turn, _role, _text. The longest common prefix of both sides' turns, equal
    in role and text, is rendered once as the prompt. What is left of either side is its completion, with the spans
    (start, end in code points of the completion) of the trained role's texts and the mark that ends them: the mask of
    the loss. A turn's own place is its order by _turn, then role, then text, so gaps and ties in _turn do no harm.

    Null roles and texts count as empty. Where one side is missing nothing is common: the prompt is empty and the missing
    completion too. Equal sides are all prompt, with empty completions. Rows that repeat are turns of their own, next to
    each other. Rows with a null pair take no part; an empty table gives an empty result. Columns of turns beside the
    five are not read, so their names do not matter. A pair's turns meet in one shuffle; everything after it is done
    within the pair, whose prompt and completions, however long, must fit in a row (2 GB).
    """
    rows = turns.filter("_pair is not null").select("_pair", "_side", "_turn", F.coalesce("_role", F.lit("")).alias("_role"), F.coalesce("_text", F.lit("")).alias("_text"))
    rows = rows.repartition("_pair")
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("_pair", "_side").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_text")))
    place = Window.partitionBy("_pair", "_pos")
    turn = F.struct("_role", "_text")
    same = (F.count("*").over(place) == 2) & (F.min(turn).over(place) == F.max(turn).over(place))
    rows = rows.withColumn("_differs", F.when(~same, F.col("_pos")))
    rows = rows.withColumn("_first", F.min("_differs").over(Window.partitionBy("_pair")))
    rows = rows.withColumn("_common", F.col("_first").isNull() | (F.col("_pos") < F.col("_first")))
    before, after = (F.concat(*[F.col("_role") if p == "{role}" else F.lit(p) for p in _parts(x)]) for x in (BEFORE, AFTER))
    rows = rows.withColumn("_shown", F.concat(before, "_text", after)).withColumn("_length", F.when(F.col("_common"), 0).otherwise(F.length("_shown")))
    so_far = Window.partitionBy("_pair", "_side").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_length").over(so_far), F.lit(0)) + F.length(before))
    rows = rows.withColumn("_end", F.col("_start") + F.length("_text") + F.length(F.regexp_replace(after, "\n$", "")))
    part = lambda when: F.collect_list(F.when(when, F.struct("_pos", "_shown")))
    span = lambda side: F.collect_list(F.when((F.col("_side") == side) & ~F.col("_common") & (F.col("_role") == trained), F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))))
    side = lambda s: (F.col("_side") == s) & ~F.col("_common")
    made = rows.groupBy("_pair").agg(part((F.col("_side") == "chosen") & F.col("_common")).alias("p"), part(side("chosen")).alias("c"), part(side("rejected")).alias("r"), span("chosen").alias("cs"), span("rejected").alias("rs"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["_shown"]), "")
    return made.select("_pair", F.size("p").alias("n_prompt_turns"), text("p").alias("prompt"), text("c").alias("chosen"), F.array_sort("cs").alias("chosen_spans"), text("r").alias("rejected"), F.array_sort("rs").alias("rejected_spans"))


def _parts(template: str) -> list[str]:
    head, mark, tail = template.partition("{role}")
    return [x for x in (head, mark, tail) if x]


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """The turns of conversations 2k as chosen and 2k + 1 as rejected of pair k, for ids of any size; a null id has no pair."""
    return conversations.select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("_pair"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("_side"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"))


ORACLE_SQL = r"""
WITH t AS (SELECT ((conv_id - (conv_id & 1)) // 2)::BIGINT AS pair, conv_id % 2 = 0 AS chosen, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT pair, min(pos) AS first FROM (SELECT pair, pos FROM t GROUP BY pair, pos HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY pair),
r AS (SELECT t.*, (first IS NULL OR pos < first) AS common, '<|im_start|>' || role || chr(10) AS head, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t LEFT JOIN d USING (pair)),
s AS (SELECT *, coalesce(sum(CASE WHEN common THEN 0 ELSE length(shown) END) OVER (PARTITION BY pair, chosen ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT pair AS pair_id, count(*) FILTER (WHERE chosen AND common)::INT AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE chosen AND common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE chosen AND NOT common), '') AS chosen,
  coalesce(string_agg(start::BIGINT || ':' || (start + length(text) + 10)::BIGINT, ',' ORDER BY pos) FILTER (WHERE chosen AND NOT common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT chosen AND NOT common), '') AS rejected,
  coalesce(string_agg(start::BIGINT || ':' || (start + length(text) + 10)::BIGINT, ',' ORDER BY pos) FILTER (WHERE NOT chosen AND NOT common AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY pair
"""
