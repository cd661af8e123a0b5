"""Queries over texts: chunks, contexts, names, similarity of texts, classification."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import classify, documents, matching, projects, responses
from ..sources import json_arrays
from ..sources.scratch import final, shared_folder
from . import domain as D
from .registry import query

_CHUNKS = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS x FROM documents),
c(doc_id, n, st, en) AS (
  SELECT doc_id, 0, 0, CASE WHEN length(x) > 2400 AND length(regexp_replace(substring(x, 1201, 1200), '[^.!?;\n]*$', '')) > 0 THEN 1200 + length(regexp_replace(substring(x, 1201, 1200), '[^.!?;\n]*$', '')) ELSE least(length(x), 2400) END FROM t WHERE length(x) > 0
  UNION ALL
  SELECT c.doc_id, n + 1, s, CASE WHEN length(x) > s + 2400 AND length(regexp_replace(substring(x, s + 1201, 1200), '[^.!?;\n]*$', '')) > 0 THEN s + 1200 + length(regexp_replace(substring(x, s + 1201, 1200), '[^.!?;\n]*$', '')) ELSE least(length(x), s + 2400) END
  FROM (SELECT c.doc_id, n, greatest(en - 160, st + 1) AS s, x FROM c JOIN t USING (doc_id) WHERE en < length(x)) c)
"""


@query(_CHUNKS + r"SELECT c.doc_id, n AS chunk_no, st, en, sha256(regexp_replace(regexp_replace(substring(x, st + 1, en - st), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')) AS chunk_sha FROM c JOIN t USING (doc_id) WHERE length(regexp_replace(substring(x, st + 1, en - st), '[\s\p{Z}]+', '', 'g')) > 0")
def doc_chunks(spark, sf_dir):
    return documents.chunks(D.spread(D.read(spark, sf_dir, "documents")), marks=".!?;\n").select("doc_id", "chunk_no", "st", "en", F.sha2("chunk", 256).alias("chunk_sha"))


@query(_CHUNKS + "SELECT source, count(*) AS n_chunks, sum(en - st) AS n_chars FROM c JOIN documents USING (doc_id) GROUP BY source")
def chunk_counts(spark, sf_dir):
    docs = D.spread(D.read(spark, sf_dir, "documents"))
    return documents.chunks(docs, marks=".!?;\n").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.col("en") - F.col("st")).alias("n_chars"))


@query(
    "WITH" + D.SEGMENTS + """
SELECT segment_id, CASE WHEN lag(session_title) OVER w = session_title THEN right(lag(clean_text) OVER w, 300) ELSE '' END AS prev_context,
  CASE WHEN lead(session_title) OVER w = session_title THEN left(lead(clean_text) OVER w, 300) ELSE '' END AS next_context FROM segments WINDOW w AS (PARTITION BY file ORDER BY ord)"""
)
def segment_context(spark, sf_dir):
    """A file holds two sessions, so that neighbours of another title give no context."""
    return documents.with_context(D.segments(spark, sf_dir)).select("segment_id", "prev_context", "next_context")


@query("WITH" + D.SEGMENTS + " SELECT count(*) AS n_segments, count(*) FILTER (WHERE trim(segment_id) = '') AS blank_ids, (SELECT count(*) FROM (SELECT segment_id FROM segments GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (WHERE trim(clean_text) = '') AS blank_texts FROM segments")
def segment_contract(spark, sf_dir):
    return documents.segment_faults(D.segments(spark, sf_dir))


@query(
    "WITH" + D.SEGMENTS + """, f AS (SELECT file, row_number() OVER (PARTITION BY file // 256 ORDER BY ord) - 1 AS place, segment_id, session_title, clean_text FROM segments)
SELECT segment_id, place, session_title, length(clean_text) AS n_chars, sha256(clean_text) AS text_sha FROM f"""
)
def segment_files(spark, sf_dir):
    """Segments written as JSON arrays, 1024 conversations a file, and read again in byte ranges of 256 kB, whose bounds fall anywhere."""
    bin_: list[str] = []
    w = Window.partitionBy("file").orderBy("ord")
    one = F.to_json(F.struct("segment_id", "session_title", "clean_text"))
    lines = F.concat(F.when(F.row_number().over(w) == 1, F.lit("[")).otherwise(F.lit(",")), one, F.when(F.lead("ord").over(w).isNull(), F.lit("]")).otherwise(F.lit("")))
    rows = D.segments(spark, sf_dir).withColumn("file", F.expr("file div 256")).select("file", "ord", lines.alias("value"))
    path = f"{shared_folder(spark)}/segment-files-{uuid.uuid4().hex}"
    rows.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    bin_.append(path)
    read = json_arrays.array_items(spark, path, 1 << 18, strict=True)
    seen = read.select(F.col("ord").alias("place"), F.from_json("value", "segment_id string, session_title string, clean_text string").alias("s"))
    return final(seen.select("s.segment_id", "place", "s.session_title", F.length("s.clean_text").alias("n_chars"), F.sha2("s.clean_text", 256).alias("text_sha")), "segments", bin_)


#: The same rules with words of the test data's language.
_WORDS = {"action": ["the", "des"], "responsibility": ["with", "pour"], "time": ["this", "dans"], "status": ["not", "pas"], "safety": ["that was", "sich"]}


def _any(words):
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


_GUARD_SQL = (
    "WITH" + D.SEGMENTS + f""",
r AS (SELECT segment_id, clean_text AS text, ['task','report','suggestion','non_task','decision'][ord % 5 + 1] AS primary_label, ['DISCARD','CONTEXT_ONLY','EXTRACT'][ord % 3 + 1] AS route,
  ord % 7 = 0 AS explicit_action, ord % 11 = 0 AS explicit_actor, ord % 13 = 0 AS explicit_deadline, ord % 17 = 0 AS safety_related FROM segments),
h AS (SELECT *, explicit_action OR {_any(_WORDS['action'])} AS a, explicit_actor OR {_any(_WORDS['responsibility'])} AS p, explicit_deadline OR {_any(_WORDS['time'])} AS t, {_any(_WORDS['status'])} AS s, safety_related OR {_any(_WORDS['safety'])} AS f FROM r),
u AS (SELECT *, CASE WHEN primary_label IN ('task','task_update','decision','issue') AND route NOT IN ('EXTRACT','HUMAN_REVIEW') THEN 'candidate_label_recalled'
  WHEN primary_label = 'report' AND a AND (p OR t OR s) AND route NOT IN ('EXTRACT','HUMAN_REVIEW') THEN 'actionable_report_recalled'
  WHEN primary_label IN ('suggestion','non_task') AND a AND (p OR t OR s) AND route = 'DISCARD' THEN 'weak_task_signal_review' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('candidate_label_recalled','actionable_report_recalled') THEN 'EXTRACT' WHEN rule IS NOT NULL THEN 'HUMAN_REVIEW' ELSE route END AS r1 FROM u)
SELECT segment_id, CASE WHEN f AND r1 IN ('DISCARD','CONTEXT_ONLY') THEN 'HUMAN_REVIEW' ELSE r1 END AS final_route, f AS final_safety,
  concat_ws(',', CASE WHEN f AND NOT safety_related THEN 'safety_keyword_signal' END, rule, CASE WHEN f AND r1 IN ('DISCARD','CONTEXT_ONLY') THEN 'safety_candidate_review' END) AS overrides FROM v"""
)


@query(_GUARD_SQL)
def recall_routes(spark, sf_dir):
    rows = D.segments(spark, sf_dir).selectExpr("segment_id", "clean_text as text", "element_at(array('task','report','suggestion','non_task','decision'), cast(ord % 5 + 1 as int)) as primary_label", "element_at(array('DISCARD','CONTEXT_ONLY','EXTRACT'), cast(ord % 3 + 1 as int)) as route", "ord % 7 = 0 as explicit_action", "ord % 11 = 0 as explicit_actor", "ord % 13 = 0 as explicit_deadline", "ord % 17 = 0 as safety_related")
    return classify.guard_routes(rows, lexicons=_WORDS).select("segment_id", "final_route", "final_safety", F.array_join("overrides", ",").alias("overrides"))


@query("WITH" + D.SEGMENTS + ", r AS (SELECT segment_id, clean_text AS text FROM segments) SELECT segment_id, " + ", ".join(f"{_any(v)} AS has_{k}" for k, v in _WORDS.items()) + " FROM r")
def lexicon_signals(spark, sf_dir):
    return D.segments(spark, sf_dir).select("segment_id", *(c.alias(k) for k, c in classify.lexicon_signals(F.col("clean_text"), **_WORDS).items()))


_RESPONSES = "CASE ord % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"segment_id\":\"' || segment_id || '\",\"label_code\":\"T\"}' WHEN 2 THEN '{\"label_code\":\"T\",\"segment_id\":\"x\",\"primary_label\":\"task\"}' WHEN 3 THEN '{\"label_code\":\"T\",\"segment_id\":\"' || segment_id || '\",\"primary_label\":\"report\"}' WHEN 4 THEN '{\"label_code\":\"T\",\"segment_id\":\"' || segment_id || '\",\"primary_label\":\"task\",\"evidence\":\"@\"}' ELSE '{\"label_code\":\"R\",\"segment_id\":\"' || segment_id || '\",\"primary_label\":\"report\",\"evidence\":\"' || regexp_replace(left(clean_text, 8), '[^A-Za-z ].*', '') || '\"}' END"


@query("WITH" + D.SEGMENTS + ", r AS (SELECT segment_id, ord, clean_text, regexp_replace(left(clean_text, 8), '[^A-Za-z ].*', '', 's') AS e FROM segments) SELECT segment_id, CASE ord % 6 WHEN 0 THEN 'not_json_object' WHEN 1 THEN 'label_code_not_first' WHEN 2 THEN 'segment_mismatch' WHEN 3 THEN 'label_code_mismatch' WHEN 4 THEN CASE WHEN contains(clean_text, '@') THEN 'ok' ELSE 'evidence_not_in_text' END ELSE CASE WHEN e = '' THEN 'evidence_not_in_text' ELSE 'ok' END END AS fault FROM r")
def response_validate(spark, sf_dir):
    rows = D.segments(spark, sf_dir).withColumn("raw", F.expr(_RESPONSES.replace("'[^A-Za-z ].*'", "'(?s)[^A-Za-z ].*'")))
    return rows.select("segment_id", F.coalesce(classify.response_fault(F.col("raw"), F.col("segment_id"), F.col("clean_text")), F.lit("ok")).alias("fault"))


@query(
    """WITH c AS (SELECT doc_id, doc_id % 6 AS m, text, CASE WHEN doc_id % 6 = 5 THEN 'evidence.0: no_clear_place' WHEN text IS NULL THEN 'evidence.0: missing_field' WHEN text = '' THEN 'evidence.0.end_char: not_allowed'
  WHEN doc_id % 6 = 2 THEN 'route: not_allowed' WHEN doc_id % 6 = 3 THEN 'segment_mismatch' WHEN doc_id % 6 = 4 THEN 'label_code_mismatch' END AS fault FROM documents)
SELECT doc_id, fault, CASE WHEN fault IS NULL THEN length(text) END AS end_char, CASE WHEN fault IS NULL THEN 'content' END AS field, CASE WHEN fault IS NULL THEN 'ambiguity_fields_normalized' || CASE WHEN m = 1 AND length(text) > 1 THEN ',evidence_offset_recovered:0' ELSE '' END END AS normalizations FROM c"""
)
def response_contract(spark, sf_dir):
    m, text = F.col("doc_id") % 6, F.col("text")
    lit = F.lit
    piece = F.struct(F.when(m == 5, lit("\u0001none")).otherwise(text).alias("text"), lit(0).alias("start_char"), F.when(m == 5, lit(5)).when((m == 1) & (text != ""), lit(1)).otherwise(F.length(text)).alias("end_char"))
    raw = F.to_json(
        F.struct(
            F.when(m == 4, lit("R")).otherwise(lit("T")).alias("label_code"), lit("v1").alias("schema_version"), F.when(m == 3, lit("odd")).otherwise(F.col("doc_id").cast("string")).alias("segment_id"),
            lit("task").alias("primary_label"), F.array(lit("report")).alias("secondary_labels"), lit("NONE").alias("event_hint"), F.when(m == 2, lit("odd")).otherwise(lit("EXTRACT")).alias("route"),
            F.struct(*(lit(False).alias(s) for s in responses.SIGNALS)).alias("signals"), F.array(piece).alias("evidence"), F.array(lit("which?")).alias("ambiguities"),
        )
    )
    rows = D.read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("segment_id"), text.alias("clean_text"), raw.alias("raw"))
    return responses.checked(rows).select("doc_id", "fault", F.get("evidence", F.lit(0))["end_char"].cast("long").alias("end_char"), F.get("ambiguities", F.lit(0))["field"].alias("field"), F.array_join("normalizations", ",").alias("normalizations"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '[a-z]{2,10}(?:tion|ment)', 0), '') AS project_name FROM documents")
def infer_project(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select("doc_id", T.project_name(F.lit(None).cast("string"), F.col("text"), "[a-z]{2,10}(?:tion|ment)").alias("project_name"))


@query(
    "WITH p AS (SELECT p_partkey AS ord, p_brand AS canonical, p_name AS alias FROM part), k AS (SELECT *, " + D.LOOSE.format("alias") + """ AS alias_key FROM p)
SELECT alias_key, arg_min(canonical, ord) AS owner, arg_min(alias, ord) AS alias_name, count(DISTINCT canonical) - 1 AS n_conflicts FROM k WHERE alias_key <> '' GROUP BY alias_key"""
)
def alias_keys(spark, sf_dir):
    return projects.alias_owners(D.read(spark, sf_dir, "part").selectExpr("p_partkey as ord", "p_brand as canonical", "p_name as alias"))


@query(
    "WITH k AS (SELECT p_partkey AS ord, p_brand AS canonical, " + D.LOOSE.format("p_name") + " AS alias_key FROM part), o AS (SELECT alias_key, arg_min(canonical, ord) AS owner FROM k WHERE ord % 2 = 0 AND alias_key <> '' GROUP BY alias_key), n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE upper(p_name) END AS source_name FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 10 = 0), m AS (SELECT *, " + D.LOOSE.format("source_name") + """ AS alias_key FROM n)
SELECT p_partkey, owner AS canonical, CASE WHEN trim(source_name) = '' THEN 'none' WHEN owner IS NOT NULL THEN 'existing' ELSE 'unknown' END AS resolution FROM m LEFT JOIN o USING (alias_key)"""
)
def alias_lookup(spark, sf_dir):
    part = D.read(spark, sf_dir, "part")
    owners = projects.alias_owners(part.filter("p_partkey % 2 = 0").selectExpr("p_partkey as ord", "p_brand as canonical", "p_name as alias"))
    rows = part.filter("p_partkey % 2 = 1 or p_partkey % 10 = 0").selectExpr("p_partkey", "case when p_partkey % 10 = 0 then ' ' else upper(p_name) end as source_name")
    return projects.look_up(rows, owners).select("p_partkey", "canonical", "resolution")


_RESOLVE = """WITH RECURSIVE q0 AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE 'Name ' || CAST(p_partkey * 7 % 61 AS VARCHAR) END AS source_name, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'existing' WHEN p_partkey % 4 = 3 THEN 'none' ELSE 'new' END AS said,
  'R' || CAST(p_partkey % 8 AS VARCHAR) AS asked, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'name-' || CAST(p_partkey * 3 % 67 AS VARCHAR) END AS new, CAST(p_size AS DOUBLE) / 100 AS sure FROM part),
q AS MATERIALIZED (SELECT *, lower(replace(source_name, ' ', '')) AS key, lower(replace(replace(new, ' ', ''), '-', '')) AS nkey, asked IN (SELECT 'R' || CAST(r_regionkey AS VARCHAR) FROM region) AS there, row_number() OVER (ORDER BY ord) AS rn FROM q0),
f(rn, known, ord, source_name, resolution, project_id, confidence, fault, made) AS (
  SELECT CAST(0 AS BIGINT), (SELECT map_from_entries(list({'k': lower(replace(r_name, ' ', '')), 'v': 'R' || CAST(r_regionkey AS VARCHAR)})) FROM region), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
  UNION ALL
  SELECT rn, CASE WHEN target IS NULL THEN known WHEN said = 'new' AND same IS NULL THEN map_concat(known, MAP {key: target}, MAP {nkey: target}) ELSE map_concat(known, MAP {key: target}) END, ord, nullif(trim(source_name), ''),
    CASE WHEN key = '' THEN 'none' WHEN hit IS NOT NULL THEN 'existing' WHEN fault IS NULL THEN said END, coalesce(hit, target), CASE WHEN key = '' OR hit IS NOT NULL OR said = 'none' THEN 1.0 WHEN fault IS NULL THEN sure END, fault, CASE WHEN target IS NOT NULL AND said = 'new' AND same IS NULL THEN new END
  FROM (SELECT *, CASE WHEN key <> '' AND hit IS NULL AND fault IS NULL THEN CASE said WHEN 'existing' THEN asked WHEN 'new' THEN coalesce(same, 'P' || left(sha256(nkey), 10)) END END AS target FROM
    (SELECT *, CASE WHEN key = '' OR hit IS NOT NULL THEN NULL WHEN said IS NULL THEN 'no_answer' WHEN said = 'existing' AND NOT there THEN 'unknown_project' WHEN said = 'new' AND trim(new) = '' THEN 'canonical_name_required' END AS fault FROM
      (SELECT q.*, f.known, f.known[q.key] AS hit, f.known[q.nkey] AS same FROM f JOIN q ON q.rn = f.rn + 1)))),
n AS (SELECT project_id, made AS name FROM f WHERE made IS NOT NULL UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), r_name FROM region)
SELECT ord AS record_id, source_name, resolution, f.project_id, n.name AS canonical_name, confidence, fault FROM f LEFT JOIN n ON n.project_id = f.project_id WHERE rn > 0"""


@query(_RESOLVE)
def catalog_resolve(spark, sf_dir):
    """Names that become known row by row: projects by their own names and by those linked to them."""
    part, region = D.read(spark, sf_dir, "part"), D.read(spark, sf_dir, "region")
    rows = part.selectExpr("p_partkey as record_id", "p_partkey as ord", "case when p_partkey % 9 = 0 then ' ' else concat('Name ', cast(p_partkey * 7 % 61 as string)) end as source_name")
    answers = part.filter("p_partkey % 11 > 0").selectExpr("p_partkey as record_id", "case p_partkey % 4 when 0 then 'existing' when 3 then 'none' else 'new' end as resolution", "concat('R', cast(p_partkey % 8 as string)) as project_id", "case when p_partkey % 13 = 0 then ' ' else concat('name-', cast(p_partkey * 3 % 67 as string)) end as canonical_name", "cast(p_size as double) / 100 as confidence")
    there = region.selectExpr("concat('R', cast(r_regionkey as string)) as project_id", "r_name as canonical_name")
    none = there.filter("false").selectExpr("project_id", "canonical_name as alias_name")
    return projects.resolve(rows, there, none, answers).drop("ord")


@query("SELECT p_brand AS project_id, upper(p_brand) AS canonical_name, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS aliases FROM part GROUP BY p_brand")
def catalog_list(spark, sf_dir):
    part = D.read(spark, sf_dir, "part")
    return projects.catalogue(part.selectExpr("p_brand as project_id", "upper(p_brand) as canonical_name").distinct(), part.selectExpr("p_brand as project_id", "p_name as alias_name"))


def _grown(spark, sf_dir):
    part = D.read(spark, sf_dir, "part")
    known = part.filter("p_size < 10 and right(p_brand, 1) < '5'").selectExpr("p_brand as project_id", "p_brand as canonical_name").distinct()
    aliases = part.filter("p_size < 3 and right(p_brand, 1) < '5'").groupBy("p_name").agg(F.min("p_brand").alias("project_id")).selectExpr("project_id", "p_name as alias_name")
    return projects.grow(known, aliases, part.filter("p_size >= 10").selectExpr("p_partkey as ord", "p_brand as canonical", "p_name as alias"))


_GROW = (
    "WITH known AS (SELECT DISTINCT p_brand AS project_id FROM part WHERE p_size < 10 AND right(p_brand, 1) < '5'), al AS (SELECT p_name AS alias_name, min(p_brand) AS project_id FROM part WHERE p_size < 3 AND right(p_brand, 1) < '5' GROUP BY p_name), kk AS (SELECT key, min(project_id) AS known_id FROM (SELECT project_id, "
    + D.LOOSE.format("project_id") + " AS key FROM known UNION ALL SELECT project_id, " + D.LOOSE.format("alias_name") + " FROM al) GROUP BY key), w AS (SELECT p_partkey AS ord, p_brand AS canonical, p_name AS alias, " + D.LOOSE.format("p_brand") + " AS key, " + D.LOOSE.format("p_name")
    + " AS alias_key FROM part WHERE p_size >= 10), h AS (SELECT w.key, arg_min(canonical, ord) AS canonical_name, any_value(known_id) AS known_id FROM w LEFT JOIN kk USING (key) GROUP BY w.key), hp AS (SELECT *, coalesce(known_id, 'P' || left(sha256(key), 10)) AS project_id FROM h), cl AS (SELECT w.*, hp.project_id FROM w JOIN hp USING (key) WHERE alias_key <> ''), ow AS (SELECT "
    + D.LOOSE.format("alias_name") + " AS alias_key, min(project_id) AS owner_id FROM al GROUP BY 1), f AS (SELECT cl.alias_key, arg_min(project_id, ord) AS project_id, arg_min(alias, ord) AS alias_name, any_value(owner_id) AS owner_id FROM cl LEFT JOIN ow USING (alias_key) GROUP BY cl.alias_key)\n"
)


@query(_GROW + "SELECT 'project' AS kind, project_id, canonical_name AS name FROM hp WHERE known_id IS NULL UNION ALL SELECT 'alias', project_id, alias_name FROM f WHERE owner_id IS NULL")
def catalog_upsert(spark, sf_dir):
    new, aliases, _ = _grown(spark, sf_dir)
    return new.select(F.lit("project").alias("kind"), "project_id", F.col("canonical_name").alias("name")).union(aliases.select(F.lit("alias"), "project_id", "alias_name"))


@query(_GROW + "SELECT ord, canonical, alias, cl.project_id, coalesce(f.owner_id, f.project_id) AS owner_id FROM cl JOIN f USING (alias_key) WHERE cl.project_id <> coalesce(f.owner_id, f.project_id)")
def alias_conflicts(spark, sf_dir):
    return _grown(spark, sf_dir)[2]


@query(
    "WITH a AS (SELECT DISTINCT p_name AS l FROM part), k AS (SELECT l, " + D.STRICT.format("l") + " AS k FROM a), g AS (SELECT l, " + D.BIGRAMS.format("k") + " AS g FROM k) SELECT x.l AS left_name, y.l AS right_name, round(" + D.DICE.format("x.g", "y.g") + ", 9) AS dice FROM g x JOIN g y ON len(list_intersect(x.g, y.g)) > 0"
)
def dice_pairs(spark, sf_dir):
    names = D.read(spark, sf_dir, "part").select(F.col("p_name").alias("left_name")).distinct().withColumn("k", T.strict_key(F.col("left_name")))
    other = names.select(F.col("left_name").alias("right_name"), F.col("k").alias("k2"))
    return matching.bigram_links(names, other, "left_name", "right_name", "k", "k2").select("left_name", "right_name", F.round("dice", 9).alias("dice"))


_A = (
    "WITH tx AS (SELECT conv_id * 1000 + turn AS text_id, CASE WHEN turn % 3 = 0 THEN (SELECT p_name FROM part WHERE p_partkey = conv_id % 50) ELSE left(text, 16) END AS text FROM conversations), ta AS (SELECT p_name AS task_id, p_name AS title, arg_min(p_type, p_partkey) AS description, arg_min(p_brand, p_partkey) AS assignee_raw FROM part GROUP BY p_name), tk AS (SELECT text_id, "
    + D.LOOSE.format("text") + " AS tk FROM tx), kk AS (SELECT task_id, " + D.LOOSE.format("title") + " AS ti, " + D.LOOSE.format("description") + " AS de, " + D.LOOSE.format("assignee_raw") + " AS asg FROM ta), tg AS (SELECT *, " + D.BIGRAMS.format("tk") + " AS g FROM tk), kg AS (SELECT *, " + D.BIGRAMS.format("ti") + " AS gi, " + D.BIGRAMS.format("de") + " AS gd FROM kk), p AS (SELECT text_id, task_id, ti <> '' AND contains(tk, ti) AS exact, greatest("
    + D.DICE.format("g", "gi") + ", 0.85::DOUBLE * " + D.DICE.format("g", "gd") + ") AS base, asg <> '' AND contains(tk, asg) AS helped FROM tg CROSS JOIN kg), s AS (SELECT text_id, task_id, exact, CASE WHEN exact THEN 0.95::DOUBLE WHEN helped THEN least(1.0::DOUBLE, base + 0.08::DOUBLE) ELSE base END AS score FROM p WHERE base > 0 OR exact OR helped), r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY text_id ORDER BY score DESC, task_id))\n"
)


def _scored_a(spark, sf_dir):
    part = D.read(spark, sf_dir, "part")
    names = part.filter("p_partkey < 50").selectExpr("p_partkey as _c", "p_name as _name")
    texts = D.read(spark, sf_dir, "conversations").withColumn("_c", F.expr("conv_id % 50")).join(names, "_c", "left").selectExpr("conv_id * 1000 + turn as text_id", "case when turn % 3 = 0 then _name else left(text, 16) end as text")
    tasks = part.groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("description"), F.min_by("p_brand", "p_partkey").alias("assignee_raw")).selectExpr("p_name as task_id", "p_name as title", "description", "assignee_raw")
    return texts, matching.score_all(texts, tasks)


@query(_A + "SELECT text_id, task_id, round(score, 9) AS score, place FROM r WHERE place <= 5")
def match_a_topk(spark, sf_dir):
    return matching.top_k(_scored_a(spark, sf_dir)[1], "text_id").select("text_id", "task_id", F.round("score", 9).alias("score"), "place")


@query(_A + ", d AS (SELECT text_id, CASE WHEN exact AND second < 0.95 THEN 'exact_title' WHEN NOT exact AND score >= 0.48 AND score - second >= 0.12 THEN 'unique_similarity' ELSE 'ambiguous' END AS decision, task_id, score FROM r WHERE place = 1) SELECT tx.text_id, coalesce(decision, 'unmatched') AS decision, CASE WHEN decision <> 'ambiguous' THEN task_id END AS task_id, round(coalesce(score, 0), 9) AS score FROM tx LEFT JOIN d USING (text_id)")
def match_a_decision(spark, sf_dir):
    texts, scored = _scored_a(spark, sf_dir)
    return matching.decide_all(texts, scored).withColumn("score", F.round("score", 9))


@query("SELECT p_partkey, upper(left(sha256(p_name || chr(0) || p_brand), 16)) AS id, regexp_replace(regexp_replace(regexp_replace('a&<' || p_name, '&', '&amp;', 'g'), '<', '&lt;', 'g'), '>', '&gt;', 'g') AS xml, CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'blocked' END AS state FROM part")
def stable_ids(spark, sf_dir):
    from ..operators import commands

    status = F.element_at(F.array(*map(F.lit, ("待执行", "进行中", "已完成", "已延期"))), F.col("p_size") % 4 + 1)
    return D.read(spark, sf_dir, "part").select("p_partkey", F.upper(T.digest_id("", 16, F.col("p_name"), F.col("p_brand"))).alias("id"), T.xml_text(F.concat(F.lit("a&<"), F.col("p_name"))).alias("xml"), commands.mapped_status(status).alias("state"))


@query("WITH s AS (SELECT p_partkey, p_type, 'm' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey AS VARCHAR) AS key FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS place FROM part")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window

    rows = D.read(spark, sf_dir, "part").withColumn("k", T.natural_key(F.concat(F.lit("m"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"))))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy("k")).alias("place"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 9 <> 0 AS is_object FROM events")
def tolerant_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.col("props"))
    v = F.try_parse_json(raw)
    return D.read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))


@query("WITH s AS (SELECT conv_id, turn, text, substring(text, 3, 12) AS e FROM conversations) SELECT conv_id, turn, CASE WHEN e <> '' AND strpos(text, e) > 0 AND strpos(substring(text, strpos(text, e) + 1), e) = 0 THEN strpos(text, e) - 1 END AS st FROM s")
def evidence_span(spark, sf_dir):
    rows = D.read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.unique_span(F.col("text"), F.substring("text", 3, 12))["start"].alias("st"))
