"""Rules as a table beside the same rules compiled into an expression."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import rules
from granary.operators import rule_match


def test_the_table_matches_what_the_expression_does(spark):
    """All hints and calibrations over texts put together from their own terms, some of which forbid others."""
    rng = random.Random(11)
    terms = sorted({t for r, _ in rules.INTENT_HINTS for way in r.split(" OR ") for c in way.split(" & ") for t in c.strip().removeprefix("!")[2:].split("|")})
    rows = [(i, "，".join(rng.sample(terms, rng.randint(0, 5)))) for i in range(400)] + [(400, None), (401, "")]
    df = spark.createDataFrame(rows, "id int, query string")
    want = df.select("id", rules.intent_hint(F.coalesce("query", F.lit(""))).alias("result")).collect()
    got = rule_match.first_matched(df, rule_match.rule_terms(spark, rules.INTENT_HINTS), ["id"], {"q": "query"}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.result for r in got}) > 10
    cases = []
    for k, (_, _, rule) in enumerate(rules.CALIBRATION):
        for way in rule.split(" OR "):
            own = {f: "，".join(rng.choice(c.strip()[2:].split("|")) for c in way.split(" & ") if c.strip()[0] == f) for f in "qidr"}
            cases += [(len(cases), own["q"], own["i"], own["d"], own["r"]), (len(cases) + 1, own["q"], own["i"] if k % 2 else "x", own["d"], own["r"][:4])]
    df = spark.createDataFrame(cases, "id int, q string, i string, d string, r string")
    fields = {f: F.col(f) for f in "qidr"}
    want = [(r.id, n) for n, _, rule in rules.CALIBRATION for r in df.filter(rules.condition(rule, fields)).select("id").collect()]
    got = rule_match.matched(df, rule_match.rule_terms(spark, [(rule, n) for n, _, rule in rules.CALIBRATION]), ["id"], {f: f for f in "qidr"})
    assert sorted((r.id, r.result) for r in got.collect()) == sorted(want) and len(want) > 20


def test_a_rule_that_only_forbids_is_refused(spark):
    with pytest.raises(ValueError):
        rule_match.rule_terms(spark, [("q:a & q:b OR !q:c", "x")])
