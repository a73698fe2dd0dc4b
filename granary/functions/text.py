"""Scalar text functions as Column expressions. White space is Unicode's, as (?U) makes \\s and \\w mean."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import fixed_values as fixed

#: Punctuation that answers are compared without: ASCII's and 15 marks.
ANSWER_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。！？；：、（）《》“”‘’"
#: Marks that replies and evidence are compared without.
MATCH_MARKS = "。，；：！？.,;:!?\"'“”（）()"
#: Marks that a sentence ends with.
END_MARKS = "。！？!? ，,；;：:"
#: Marks that a query's word is stripped of.
TERM_MARKS = "?.!,;:，。！？；：、"
#: Words that begin a sentence of its own after a comma.
LEAD_WORDS = ("建议", "请", "您可以", "如果", "若", "具体", "最终", "平台", "商家", "骑手", "退款", "到账")
SHORT = 120
SIMILAR, CONTAINED = 0.72, 0.6


def text(c: Column | str) -> Column:
    """A column, null as empty: missing means empty throughout."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def has_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether any of the terms is contained, as an OR of literal tests, which stay in code generation."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms], F.lit(False))


def _marks(marks: str) -> str:
    return "[" + "".join(re.escape(m) if m.isascii() and not m.isalnum() and m != " " else m for m in marks) + "]"


def trimmed(c: Column, marks: str = "") -> Column:
    """Without white space, and the marks, at both ends."""
    cls = _marks(marks)[1:-1] if marks else ""
    return F.regexp_replace(c, f"(?U)^[\\s{cls}]+|[\\s{cls}]+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def shortened(c: Column, length: int = SHORT) -> Column:
    plain = collapsed(c)
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(F.regexp_replace(F.substring(plain, 1, length), r"(?U)\s+$", ""), F.lit("...")))


def answer_key(c: Column) -> Column:
    """Lower case, without white space and ANSWER_MARKS."""
    return F.regexp_replace(F.lower(c), f"(?U)[\\s{_marks(ANSWER_MARKS)[1:-1]}]", "")


def match_key(c: Column) -> Column:
    """Lower case, without white space and MATCH_MARKS."""
    return F.translate(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), MATCH_MARKS, "")


def bigrams(key: Column) -> Column:
    """The distinct pairs of neighbouring characters of a key; one character is a set of its own, none an empty set."""
    # by an array of characters, as a substring is found by counting from the text's start
    chars = F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0))
    pairs = F.array_compact(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b)))
    return F.when(F.length(key) >= 2, F.array_distinct(pairs)).when(F.length(key) == 1, F.array(key)).otherwise(F.array().cast("array<string>"))


def similar(a: Column, b: Column, a_grams: Column, b_grams: Column, threshold: float = SIMILAR) -> Column:
    """Whether two answer keys are near copies: where one contains the other their lengths decide, else the bigrams' Jaccard similarity."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inside = long.contains(short)
    ratio = F.length(short) / F.length(long)
    shared = F.size(F.array_intersect(a_grams, b_grams))
    jaccard = shared / F.greatest(F.lit(1), F.size(a_grams) + F.size(b_grams) - shared)
    return (a != "") & (b != "") & F.when(inside, ratio >= CONTAINED).otherwise(jaccard >= threshold)


def similar_answers(a: Column, b: Column, threshold: float = SIMILAR) -> Column:
    x, y = answer_key(a), answer_key(b)
    return similar(x, y, bigrams(x), bigrams(y), threshold)


def terms(c: Column) -> Column:
    """The terms of a text: its words without marks and stop words, the domain terms that it contains, and triggers with what they add."""
    words = F.transform(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(TERM_MARKS)))
    parts = [F.filter(words, lambda w: (w != "") & ~w.isin(*fixed.STOP_WORDS))]
    none = F.array().cast("array<string>")
    known = [F.when(c.contains(k), F.array(F.lit(k))).otherwise(none) for k in fixed.DOMAIN_KEYWORDS]
    known += [F.when(c.contains(k), F.array(*map(F.lit, (k, *more)))).otherwise(none) for k, more in fixed.QUERY_EXPANSIONS.items()]
    # one search for their first characters passes over most texts that have none of them
    first = "[" + "".join(sorted({re.escape(k[0]) for k in (*fixed.DOMAIN_KEYWORDS, *fixed.QUERY_EXPANSIONS)})) + "]"
    parts.append(F.when(c.rlike(first), F.concat(*known)).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def stripped(c: Column) -> Column:
    """Collapsed, without END_MARKS at the ends."""
    return F.regexp_replace(collapsed(c), f"^{_marks(END_MARKS)[:-1]} ]+|{_marks(END_MARKS)[:-1]} ]+$", "")


def sentences(c: Column) -> Column:
    """Parts between full stops and semicolons, and after commas before LEAD_WORDS; empty ones are left out."""
    rough = F.split(collapsed(c), "[。；;]+")
    parts = F.flatten(F.transform(rough, lambda s: F.split(s, f"，(?=(?:{'|'.join(LEAD_WORDS)}))")))
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def with_period(c: Column) -> Column:
    plain = stripped(c)
    return F.when(plain == "", F.lit("")).otherwise(F.concat(plain, F.lit("。")))


def sentence_key(c: Column) -> Column:
    return F.regexp_replace(collapsed(c), r"(?U)[^\w一-鿿]+", "")


def overlap(a: Column, b: Column) -> Column:
    """Whether two sentences say the same: equal keys, or the shorter, of 8 characters at least and 0.72 of the longer, is contained."""
    x, y = sentence_key(a), sentence_key(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x != "") & (y != "") & ((x == y) | ((F.length(short) >= 8) & (F.length(short) / F.length(long) >= 0.72) & long.contains(short)))


#: Patterns of private data and their masks, applied one after the other.
MASKS = ((r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号已脱敏]"), (r"(?U)(验证码|校验码|验正码)[：: ]?\d{4,8}", "$1[已脱敏]"), (r"(?U)(?<!\d)\d{12,20}(?!\d)", "[订单号已脱敏]"))
#: Patterns for texts like the test tables': phones with an area code, and mail addresses.
MASKS_EN = ((r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[phone]"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]"))


def masked(c: Column, masks: tuple[tuple[str, str], ...] = MASKS) -> Column:
    return reduce(lambda x, m: F.regexp_replace(x, *m), masks, text(c))


def echoes(query: Column, reply: Column) -> Column:
    """Whether a reply only repeats the query, with at most 20 characters more."""
    q, r = stripped(query), stripped(reply)
    return (q != "") & (r != "") & ((q == r) | (r.contains(q) & (F.length(r) <= F.length(q) + 20)))


def evidence_overlap(reply: Column, evidence: Column) -> Column:
    """Whether a reply has one of the evidence's parts of 3 characters or more; with no such part it counts as having."""
    parts = F.filter(F.split(evidence, r"(?U)[，。；、\s]+"), lambda t: F.length(t) >= 3)
    return (reply != "") & (evidence != "") & ((F.size(parts) == 0) | F.exists(parts, lambda t: reply.contains(t)))


def without_tails(reply: Column) -> Column:
    """Without the endings that say nothing, each tried with and without a space before it."""
    out = collapsed(reply)
    for tail in fixed.GENERIC_TAILS:
        for suffix in (f" {tail}", tail):
            out = F.when(out.endswith(suffix), F.regexp_replace(F.substring(out, F.lit(1), F.length(out) - len(suffix)), r"(?U)\s+$", "")).otherwise(out)
    return out


def colloquial(c: Column) -> Column:
    """The replacements in order; a text without any gets an opening."""
    out = c
    for old, new in fixed.COLLOQUIAL_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(out == c, F.concat(F.lit("这个问题我有点不太明白，"), c)).otherwise(out)


def promises(reply: Column) -> Column:
    """The terms of a promise in a reply; denied ones count too."""
    return F.filter(F.array(*map(F.lit, fixed.RISKY_PROMISE_TERMS)), lambda t: reply.contains(t))


def forbidden_hits(reply: Column, forbidden: Column, safe: tuple[str, ...] | list[str] = tuple(fixed.SAFE_FORBIDDEN_CONTEXT_TERMS)) -> Column:
    """The forbidden words in a reply, but for those whose first occurrence has a harmless term from 30 before it to 12 after it."""

    def harmless(word: Column) -> Column:
        at = F.position(word, reply)
        start = F.greatest(F.lit(1), at - 30)
        return has_any(F.substring(reply, start, at + F.length(word) + 12 - start), safe)

    return F.filter(forbidden, lambda w: reply.contains(w) & ~harmless(w))


def found_and_missing(reply: Column, words: Column) -> tuple[Column, Column]:
    return F.filter(words, lambda w: reply.contains(w)), F.filter(words, lambda w: ~reply.contains(w))


def labels(c: Column, rules: dict[str, list[str]], other: str = "") -> Column:
    """The labels whose words a text contains; `other` if there are none."""
    found = F.array_compact(F.array(*[F.when(has_any(c, words), F.lit(k)) for k, words in rules.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found) if other else found


def score_text(c: Column) -> Column:
    return F.coalesce(F.format_string("%.4f", c.cast("double")), F.lit(""))


def completions_url(base: str) -> str:
    """Address of the chat completions of an API."""
    plain = base.strip().rstrip("/")
    if not plain:
        raise ValueError("online_api_base_url is empty")
    return plain if plain.endswith("/chat/completions") else f"{plain}/chat/completions"
