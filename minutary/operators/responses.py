"""Whole contract of a classification response: shape, meaning, and evidence set right where its place is clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C, text as T

# Names and enumerations of the response contract.
FIELDS = ("label_code", "schema_version", "segment_id", "primary_label", "secondary_labels", "event_hint", "route", "signals", "evidence", "ambiguities")
EVENT_HINTS = ("CREATE", "UPDATE", "COMPLETE", "BLOCK", "CHANGE_DEADLINE", "REASSIGN", "CANCEL", "NONE")
ROUTES = ("EXTRACT", "CONTEXT_ONLY", "DISCARD", "HUMAN_REVIEW")
SIGNALS = ("explicit_action", "explicit_actor", "explicit_object", "explicit_deadline", "negated", "hypothetical", "quoted_previous_instruction", "completed_report", "safety_related")
EVIDENCE = ("text", "start_char", "end_char")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, OBJECT<..>, ARRAY<..>, VOID (a JSON null), or null where there is nothing."""
    return F.schema_of_variant(v)


def _word(v: Column, path: str = "$") -> Column:
    """The text of a string that isn't empty, else null."""
    x = _at(v, path)
    return F.when((_kind(x) == "STRING") & (_at(v, path, "string") != ""), _at(v, path, "string"))


def _keys_fault(v: Column, path: Column, wanted: tuple[str, ...]) -> Column:
    """Null where v is an object with just these fields."""
    keys = F.json_object_keys(F.to_json(v))
    names = F.array(*map(F.lit, wanted))
    return (
        F.when(~F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), F.concat(path, F.lit(": not_object")))
        .when(F.size(F.array_except(keys, names)) > 0, F.concat(path, F.lit(": unknown_field")))
        .when(F.size(F.array_except(names, keys)) > 0, F.concat(path, F.lit(": missing_field")))
    )


def _enum_fault(v: Column, path: str, values) -> Column:
    return F.when(~F.coalesce(_word(v, f"$.{path}").isin(*values), F.lit(False)), F.lit(f"{path}: not_allowed"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(_at(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def _array_fault(v: Column, path: str, item_fault) -> Column:
    """The first fault of an array: itself, then its items in order."""
    bad = F.filter(F.transform(_items(v, path), lambda x, i: item_fault(x, F.concat(F.lit(f"{path}."), i.cast("string")))), lambda f: f.isNotNull())
    return F.when(~F.coalesce(_kind(_at(v, f"$.{path}")).startswith("ARRAY"), F.lit(False)), F.lit(f"{path}: not_array")).otherwise(F.get(bad, F.lit(0)))


def _ambiguity(x: Column) -> Column:
    """struct(field, description, changed): a text, or text and reason, become field and description; null fields where neither fits."""
    keys = F.array_sort(F.json_object_keys(F.to_json(x)))
    is_object = F.coalesce(_kind(x).startswith("OBJECT"), F.lit(False))
    plain = is_object & (keys == F.array(F.lit("description"), F.lit("field")))
    said = F.nullif(T.strip(_word(x)), F.lit(""))
    text, why = _word(x, "$.text"), F.coalesce(_word(x, "$.reason"), _word(x, "$.description"))
    both = F.when(text.isNotNull() & why.isNotNull(), F.concat(text, F.lit("："), why)).otherwise(F.coalesce(why, text))
    field = F.when(plain, _word(x, "$.field")).when(is_object & both.isNotNull(), F.coalesce(_word(x, "$.field"), F.lit("content"))).when(said.isNotNull(), F.lit("content"))
    return F.struct(field.alias("field"), F.when(plain, _word(x, "$.description")).when(is_object, both).otherwise(said).alias("description"), (~plain).alias("changed"))


def _evidence_fault(x: Column, path: Column) -> Column:
    whole = lambda f, least: (_kind(_at(x, f"$.{f}")) == "BIGINT") & (_at(x, f"$.{f}", "long") >= least)
    wrong = lambda ok, f: F.when(~F.coalesce(ok, F.lit(False)), F.concat(path, F.lit(f".{f}: not_allowed")))
    # in the order of the paths
    return F.coalesce(_keys_fault(x, path, EVIDENCE), wrong(whole("end_char", 1), "end_char"), wrong(whole("start_char", 0), "start_char"), wrong(_word(x, "$.text").isNotNull(), "text"))


def evidence_span(text: Column, part: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a piece of evidence: as given where that is its place, else the one place where it stands; null if not clear."""
    own = (end > start) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == part)
    return F.when(F.coalesce(own, F.lit(False)), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).otherwise(T.unique_span(text, part))


def checked(rows: DataFrame, raw: str = "raw", segment_id: str = "segment_id", text: str = "clean_text", version: str = "v1") -> DataFrame:
    """rows with fault, evidence, ambiguities and normalizations of a model response.

    Faults in this order: not JSON, not an object, the shape (the first by path, the object's own fields before all), label_code not
    first, another segment, code and label that don't match, a secondary label that repeats the primary one, evidence without a clear
    place. Evidence and ambiguities are null for a faulty response. Numbers with a fraction, even 3.0, are no places.
    """
    names = [*rows.columns, "fault", "evidence", "ambiguities", "normalizations"]
    rows = rows.withColumn("_bare", T.without_fence(F.col(raw))).withColumn("_v", F.try_parse_json("_bare"))
    v, labels = F.col("_v"), tuple(C.LABEL_CODES.values())
    codes = F.create_map(*(F.lit(x) for kv in C.LABEL_CODES.items() for x in kv))
    secondary = F.transform(_items(v, "secondary_labels"), lambda x: _word(x))
    signals = F.coalesce(_keys_fault(_at(v, "$.signals"), F.lit("signals"), SIGNALS), *(F.when(~F.coalesce(_kind(_at(v, f"$.signals.{s}")) == "BOOLEAN", F.lit(False)), F.lit(f"signals.{s}: not_boolean")) for s in sorted(SIGNALS)))
    noted = F.transform(_items(v, "ambiguities"), _ambiguity)
    shape = F.coalesce(
        _keys_fault(v, F.lit("<root>"), FIELDS),
        _array_fault(v, "ambiguities", lambda x, p: F.when(_ambiguity(x)["field"].isNull() | _ambiguity(x)["description"].isNull(), F.concat(p, F.lit(": not_allowed")))),
        _enum_fault(v, "event_hint", EVENT_HINTS),
        F.when(F.coalesce(_kind(_at(v, "$.evidence")).startswith("ARRAY"), F.lit(False)) & (F.size(_items(v, "evidence")) == 0), F.lit("evidence: empty")),
        _array_fault(v, "evidence", _evidence_fault),
        _enum_fault(v, "label_code", C.LABEL_CODES),
        _enum_fault(v, "primary_label", labels),
        _enum_fault(v, "route", ROUTES),
        _enum_fault(v, "schema_version", (version,)),
        F.when(F.size(F.array_distinct(secondary)) < F.size(secondary), F.lit("secondary_labels: repeated")),
        _array_fault(v, "secondary_labels", lambda x, p: F.when(~F.coalesce(_word(x).isin(*labels), F.lit(False)), F.concat(p, F.lit(": not_allowed")))),
        F.when(_word(v, "$.segment_id").isNull(), F.lit("segment_id: not_allowed")),
        signals,
    )
    found = F.transform(_items(v, "evidence"), lambda x: F.struct(_at(x, "$.start_char", "int").alias("given"), _at(x, "$.end_char", "int").alias("given_end"), evidence_span(F.col(text), _at(x, "$.text", "string"), _at(x, "$.start_char", "int"), _at(x, "$.end_char", "int")).alias("at")))
    rows = rows.withColumns({"_shape": shape, "_found": found, "_noted": noted})
    lost = F.filter(F.transform("_found", lambda e, i: F.when(e["at"].isNull(), i)), lambda i: i.isNotNull())
    primary = _word(v, "$.primary_label")
    fault = (
        F.when(v.isNull(), F.lit("not_json"))
        .when(~_kind(v).startswith("OBJECT"), F.lit("not_object"))
        .when(F.col("_shape").isNotNull(), F.col("_shape"))
        .when(F.get(F.json_object_keys("_bare"), F.lit(0)) != "label_code", F.lit("label_code_not_first"))
        .when(~F.coalesce(_word(v, "$.segment_id") == F.col(segment_id), F.lit(False)), F.lit("segment_mismatch"))
        .when(F.element_at(codes, _word(v, "$.label_code")) != primary, F.lit("label_code_mismatch"))
        .when(F.array_contains(secondary, primary), F.lit("secondary_repeats_primary"))
        .when(F.size(lost) > 0, F.concat(F.lit("evidence."), F.get(lost, F.lit(0)).cast("string"), F.lit(": no_clear_place")))
    )
    moved = F.filter(F.transform("_found", lambda e, i: F.when((e["at"]["start"] != e["given"]) | (e["at"]["end"] != e["given_end"]), F.concat(F.lit("evidence_offset_recovered:"), i.cast("string")))), lambda s: s.isNotNull())
    good = lambda c: F.when(F.col("fault").isNull(), c)
    rows = rows.withColumn("fault", fault).withColumns({
        "evidence": good(F.transform("_found", lambda e: F.struct(F.substring(F.col(text), e["at"]["start"] + 1, e["at"]["end"] - e["at"]["start"]).alias("text"), e["at"]["start"].alias("start_char"), e["at"]["end"].alias("end_char")))),
        "ambiguities": good(F.transform("_noted", lambda a: F.struct(a["field"].alias("field"), a["description"].alias("description")))),
        "normalizations": good(F.concat(F.when(F.exists("_noted", lambda a: a["changed"]), F.array(F.lit("ambiguity_fields_normalized"))).otherwise(F.array().cast("array<string>")), moved)),
    })
    return rows.select(*names)
