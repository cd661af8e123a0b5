"""Operator 9: quality rules as a short-circuit cascade, in DataFrame functions only.

Every document gets the base measures. The verdict is a conjunction of rules. On a bounded
sample each rule's cost (its own time, over many evaluations) is measured and which rows it
rejects; the rules are then chained in one CASE, each time the one with most rejections per cost
among the rows that the base rule and the rules before it leave, so that most rejected rows skip
the expensive ones. The order changes the work, never the verdict.

No word list is built in. Toxicity is learned from labels(doc_id, toxic), where there are any:
``fit_lexicon`` finds, for each language, the words and word beginnings that toxic documents hold
far more often than clean ones, and the `toxic` rule rejects a document in which they make up
more than 1 in 80 words. A caller's own list can take their place.

Words are runs of anything but space and \\t..\\r. Null text has no words, and so fails the
base rule. Repeated rows get equal results; null ids are kept; an empty table gives no rows;
extra columns are kept by ``filter_documents`` and ignored by ``score_documents``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documented bound of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 1000
#: Evaluations of a rule on each row of the sample when its time is taken, and times that it is taken (the least counts).
REPEATS, TAKES = 3, 2
#: A rule is put before another only if it rejects so many times as much per cost; else their given order holds.
MARGIN = 2.0
#: Documented bound of the labelled rows on which the lexicon is fitted: so many of each language and label, about.
FIT_ROWS = 500
#: Characters of a word's beginning, and the ratio of rates and standard deviations above chance that a term needs.
STEMS, RATIO, SURE = range(3, 11), 8, 6


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def fit_lexicon(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[str]:
    """Terms of toxic documents, from docs(doc_id, text, lang if there is one) and labels(doc_id, toxic).

    A term is a word, or with a * a word's beginning; all that are sure are taken. Each word counts once a document; a language with
    too few toxic rows for a sure term gives none.
    """
    bin_: list[str] = []
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id", lang.alias("lang")).join(known, "doc_id")
    shares = ids.groupBy("lang", "toxic").agg(F.least(F.lit(1.0), rows / F.count("*")).alias("share"))  # a few rows
    chosen = ids.join(F.broadcast(shares), ["lang", "toxic"]).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("doc_id", "lang", "toxic").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    words = texts.select("lang", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"))
    counts = common.settle(words.groupBy("lang", "word").agg(F.count_if(F.col("toxic") > 0).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")), "toxic-words", bin_)
    whole = counts.groupBy("lang").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    stems = F.array(*(F.when(F.length("word") > k, F.concat(F.left("word", F.lit(k)), F.lit("*"))) for k in STEMS), F.col("word"))
    terms = counts.select("lang", "p", "n", F.explode(F.array_compact(stems)).alias("term")).groupBy("lang", "term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).join(F.broadcast(whole), "lang")
    chance = (F.col("p") + F.col("n")) * F.col("all_p") / (F.col("all_p") + F.col("all_n"))
    sure = terms.withColumn("z", (F.col("p") - chance) / F.sqrt(chance)).filter((F.col("z") >= SURE) & (F.col("p") * F.col("all_n") >= RATIO * F.col("n") * F.col("all_p")))
    best = sure.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("z"), F.desc(F.length(F.translate("term", "*", ""))), "term")))
    # what a surer beginning covers adds nothing, and what widens a surer term adds clean words
    best = common.settle(best.select("term", F.row_number().over(Window.orderBy("lang", "place")).alias("rank"), F.rtrim("term", F.lit("*")).alias("stem"), F.endswith(F.col("term"), F.lit("*")).alias("wide")), "toxic-terms", bin_)  # of a bounded sample
    surer = common.small(best.select(F.col("rank").alias("r"), F.col("stem").alias("x"), F.col("wide").alias("w")))
    covers = (F.col("x") == F.col("stem")) | (F.col("w") & F.startswith(F.col("stem"), F.col("x"))) | (F.col("wide") & F.startswith(F.col("x"), F.col("stem")))
    found = [r.term for r in best.join(surer, (F.col("r") < F.col("rank")) & (F.left("x", F.lit(3)) == F.left("stem", F.lit(3))) & covers, "left_anti").orderBy("rank").collect()]
    common.discard(bin_)
    return found


def toxic_rule(terms: list[str]) -> Rule:
    """Rejects where the terms make up more than 1 in 80 words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    leads = "".join(sorted({x[0] for x in terms}))  # letters and digits: most places fail on their first character
    each = "|".join(x[:-1] if x.endswith("*") else x + r"(?![\p{L}\p{N}])" for x in terms)
    return Rule("toxic", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(rf"(?=[{leads}])(?<![\p{{L}}\p{{N}}])(?:{each})")) * 80 > n)


def cascade_rules(toxic: list[str] | None = None) -> list[Rule]:
    """The rules besides the base; each rejects on the text and the measured columns. toxic: terms, from ``fit_lexicon`` or the caller."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-z]*[A-Z]{2}[^\x20\x09-\x0Da-z]*(?![^\x20\x09-\x0D])"))
    rules = [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("dup_lines", (F.col("n_dup_lines") * 10 > 4 * F.col("n_lines")) & (F.col("n_dup_lines") > 1)),
        Rule("word_length", (F.col("word_chars") > 14 * n) | (F.col("word_chars") < 2 * n)),
        Rule("exclamations", F.length(text) - F.length(F.translate(text, "!", "")) > 0.5 * n),
        Rule("capitals", upper * 10 > 3 * n),
        Rule("word_runs", (F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])){3}")) * 10) > n),
    ]
    return [*rules, toxic_rule(toxic)] if toxic else rules


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed to docs(text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    step = docs.withColumn("_w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("_lines", lines)
    step = step.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_lines", F.size("_lines").cast("long"))
    step = step.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    step = step.withColumn("word_chars", F.length(bare).cast("long")).withColumn("n_symbols", (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"))
    # a hash for each 5-word window; only documents in which one repeats go on to count words
    at = "get(_w, i), get(_w, i + 1), get(_w, i + 2), get(_w, i + 3), get(_w, i + 4)"
    step = step.withColumn("_h", F.expr(f"case when size(_w) > 5 then transform(sequence(0, size(_w) - 5), i -> xxhash64({at})) else array() end"))
    step = step.withColumn("_again", F.expr("size(array_distinct(_h)) < size(_h)"))
    step = step.withColumn("_s", F.expr("case when _again then array_sort(transform(_h, (h, i) -> struct(h, i))) else null end"))
    step = step.withColumn("_p", F.expr("case when _again then array_sort(transform(filter(_s, (x, i) -> x.h = get(_s, i - 1).h or x.h = get(_s, i + 1).h), x -> x.i)) else null end"))
    # each repeated window adds the words that the one before it has not covered
    step = step.withColumn("n_repeat_words", F.expr("case when _again then aggregate(transform(_p, (p, i) -> case when i = 0 then 5L else cast(least(5, p - get(_p, i - 1)) as bigint) end), 0L, (a, x) -> a + x) else 0L end"))
    step = step.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return step.drop("_w", "_lines", "_h", "_again", "_s", "_p")


def rule_costs(sample: DataFrame, rules: list[Rule]) -> list[float]:
    """Seconds that each rule takes on the sample, evaluated ``REPEATS`` times a row, less what an empty rule takes."""
    rows = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def took(rule: Rule) -> float:
        times = []
        for _ in range(TAKES):
            began = time.perf_counter()
            rows.agg(F.count_if(rule.rejects & (F.col("_again") > 0)), F.sum("n_words"), F.max(F.length("text"))).first()
            times.append(time.perf_counter() - began)
        return min(times)

    took(Rule("warm-up", F.lit(False)))
    empty = took(Rule("empty", F.lit(False)))
    return [max(took(rule) - empty, empty / 2) for rule in rules]  # less can't be told from nothing


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, costs: list[float] | None = None) -> list[Rule]:
    """Rules by rejections per cost, as a random sample of at most ``sample_rows`` rows shows them."""
    bin_: list[str] = []
    share = min(1.0, 2 * sample_rows / max(1, docs.count()))
    sample = common.settle(measure(docs.select("text").sample(share, seed=11).limit(sample_rows)), "rule-sample", bin_).filter("not base_failed")
    rejects = F.concat(*(F.when(rule.rejects, F.lit("1")).otherwise(F.lit("0")) for rule in rules))
    groups = [(r["by"], r["count"]) for r in sample.groupBy(rejects.alias("by")).count().collect()]  # at most as many as sampled rows
    costs = costs or rule_costs(sample, rules)
    common.discard(bin_)
    left, order = list(range(len(rules))), []
    while left:
        worth = {k: sum(n for by, n in groups if by[k] == "1") / costs[k] for k in left}
        best = next(k for k in left if worth[k] * MARGIN >= max(worth.values()))
        order.append(best)
        left.remove(best)
        groups = [(by, n) for by, n in groups if by[best] == "0"]
    return [rules[k] for k in order]


def verdict(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    ordered = order_rules(docs, rules or cascade_rules())
    cascade = F.when(F.col("base_failed"), F.lit(False))
    for rule in ordered:
        cascade = cascade.when(rule.rejects, F.lit(False))
    return measure(docs).withColumn("kept", cascade.otherwise(F.lit(True)))


def score_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept for every row of docs(doc_id, text); toxicity as the labels show it."""
    rules = cascade_rules(fit_lexicon(docs, labels) if labels is not None else None)
    return verdict(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    wide = docs.select(F.struct("*").alias("_row"), "text")
    # a filter on a column of running numbers stays above the projections that make the measures;
    # pushed below them it would repeat each measure wherever the verdict names it
    return verdict(wide, rules).withColumn("_at", F.monotonically_increasing_id()).filter("kept and _at >= 0").select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) u(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) x, unnest(range(0, 5)) v(k) WHERE c > 1 GROUP BY doc_id),
o AS (SELECT doc_id, i, w[i] AS x, i - row_number() OVER (PARTITION BY doc_id, w[i] ORDER BY i) AS island FROM d, unnest(range(1, len(w) + 1)) u(i)),
q AS (SELECT doc_id, sum(n // 4) AS n FROM (SELECT doc_id, x, island, count(*) AS n FROM o GROUP BY doc_id, x, island) GROUP BY doc_id),
known AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
words AS (SELECT doc_id, coalesce(lang, '') AS lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS x FROM documents),
seen AS (SELECT lang, word, count(*) FILTER (toxic > 0) AS p, count(*) FILTER (toxic = 0) AS n FROM (SELECT DISTINCT doc_id, lang, toxic, unnest(x) AS word FROM words JOIN known USING (doc_id)) GROUP BY lang, word),
whole AS (SELECT lang, sum(p)::BIGINT AS all_p, sum(n)::BIGINT AS all_n FROM seen GROUP BY lang),
each AS (SELECT lang, p, n, word AS term FROM seen UNION ALL SELECT lang, p, n, left(word, k) || '*' FROM seen, unnest(range(3, 11)) u(k) WHERE length(word) > k),
terms AS (SELECT lang, term, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n FROM each GROUP BY lang, term),
z AS (SELECT lang, term, (p - (p + n) * all_p / (all_p + all_n)) / sqrt((p + n) * all_p / (all_p + all_n)) AS z FROM terms JOIN whole USING (lang) WHERE p * all_n >= 8 * n * all_p AND all_p > 0),
best AS (SELECT term, row_number() OVER (ORDER BY lang, place) AS rank, rtrim(term, '*') AS stem, ends_with(term, '*') AS wide
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY z DESC, length(rtrim(term, '*')) DESC, term) AS place FROM z WHERE z >= 6)),
lexicon AS (SELECT stem, wide FROM best b WHERE NOT EXISTS (SELECT 1 FROM best s WHERE s.rank < b.rank AND (s.stem = b.stem OR (s.wide AND starts_with(b.stem, s.stem)) OR (b.wide AND starts_with(s.stem, b.stem))))),
toxic AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, unnest(x) AS word FROM words, (SELECT 0 AS i)) w WHERE EXISTS (SELECT 1 FROM lexicon l WHERE w.word = l.stem OR (l.wide AND starts_with(w.word, l.stem))) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, greatest(len(w), 1) AS n, length(array_to_string(w, '')) AS word_chars, length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS bangs,
  len(list_filter(w, lambda x: regexp_full_match(x, '[^a-z]*[A-Z][A-Z][^a-z]*'))) AS capitals, coalesce(q.n, 0) AS runs,
  coalesce(toxic.n, 0) AS toxic
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN toxic USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n OR (n_dup_lines * 10 > 4 * n_lines AND n_dup_lines > 1) OR word_chars > 14 * n OR word_chars < 2 * n OR bangs > 0.5 * n OR capitals * 10 > 3 * n OR runs * 10 > n OR toxic * 80 > n) AS kept FROM b
"""
