import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from minutary.operators import records
from minutary.sources import readers, sinks


def test_documents_of_several_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("甲\n乙")
    (tmp_path / "b.json").write_text(json.dumps({"segments": [{"clean_text": " x "}, {"raw_text": "y"}, {"clean_text": ""}]}))
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>一</w:t><w:t>二</w:t></w:p><w:p/><w:p><w:t>三</w:t></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.xyz").write_text("?")
    got = {r.suffix: (r.text, r.error) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"txt": ("甲\n乙", None), "json": ("x\ny", None), "docx": ("一二\n三", None), "xyz": (None, "unsupported_suffix")}


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"no archive")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00x")
    (tmp_path / "c.pdf").write_bytes(b"x")

    def refuses(content):
        raise ValueError("broken")

    got = {r.suffix: (r.text, r.error) for r in readers.documents(spark, str(tmp_path), {"pdf": refuses}).collect()}
    assert got["docx"][0] is None and got["docx"][1].startswith("BadZipFile") and got["txt"] == (None, "not_utf8") and got["pdf"] == (None, "ValueError: broken")
    with pytest.raises(Exception, match="not_utf8|BadZipFile|broken"):
        readers.documents(spark, str(tmp_path), {"pdf": refuses}, strict=True).collect()


def test_labelled_records(spark, tmp_path):
    good = dict.fromkeys(records.LABELLED_FIELDS) | {"segment_id": "s1", "subsegment_id": "001", "text_raw": "x", "task_category": "task", "nbest": ["x"], "start_ms": 5}
    items = [good, good | {"subsegment_id": "2"}, {k: v for k, v in good.items() if k != "nbest"} | {"subsegment_id": "005"}, good | {"subsegment_id": "003", "text_raw": None}, good | {"subsegment_id": "004", "text_raw": "y"}, good | {"subsegment_id": "004", "text_raw": "z"}]
    (tmp_path / "r.json").write_text(json.dumps(items))
    rows = readers.json_items(spark, str(tmp_path / "r.json"))
    assert sorted(str(r.fault) for r in records.labelled_records(rows).collect()) == sorted(["None", "subsegment_id_format", "keys_differ", "text_blank", "key_repeated", "key_repeated"])


def test_artefacts_and_stage_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, fault string")
    sinks.artefacts(rows, str(tmp_path / "out"), {"results": F.col("id") > 0, "review": F.col("fault").isNotNull()})
    got = sorted((r.output, r.id) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("results", 1), ("results", 2), ("results", 3), ("review", 1), ("review", 3)]
    log = str(tmp_path / "log")
    assert sinks.logged(spark, log, "r", "read", lambda: 7) == 7
    with pytest.raises(KeyError):
        sinks.logged(spark, log, "r", "match", lambda: {}["x"])
    assert sorted((r.stage, r.status, "KeyError" in (r.error or "")) for r in spark.read.parquet(log).collect()) == [("match", "failed", True), ("read", "done", False)]


def test_record_contract(spark):
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1,"c":2}',), ("x",)], "value string")
    got = [(r.missing, r.extra) for r in readers.record_faults(rows, ["a", "b"]).collect()]
    assert got == [([], []), (["b"], ["c"]), (["a", "b"], [])]


@pytest.mark.parametrize("size", [1 << 30, 6000])
def test_archives_are_cut_by_size_and_hold_all(spark, tmp_path, size):
    import random

    r = random.Random(1)
    texts = {f"s{i:03d}": bytes(r.randrange(97, 123) for _ in range(r.choice([0, 10, 900]))).decode() for i in range(80)} | {"big": "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(9000))}
    rows = [(k, v, json.dumps({"id": k})) for k, v in texts.items()] + [("none", None, None), ("none", None, None), (None, "x", None)]
    done = sinks.export_archives(spark.createDataFrame(rows, "sample_id string, evidence_text string, label string").repartition(3), f"file://{tmp_path}/out", size).collect()
    seen, n = {}, 0
    for row in done:
        path = row.archive.removeprefix("file://")
        with zipfile.ZipFile(path) as z:
            m = json.loads(z.read("manifest.json"))
            assert m["sample_count"] == row.n_samples == len(m["samples"]) and os.path.getsize(path) == row.n_bytes
            assert row.n_bytes <= size or m["samples"] == ["big"]
            n += row.n_samples
            seen |= {s: z.read(f"samples/{s}/evidence.txt").decode() for s in m["samples"]}
            assert all(json.loads(z.read(f"samples/{s}/label.json")) == {"id": s} for s in m["samples"] if s in texts)
    assert seen == texts | {"none": "", None: "x"} and n == len(rows) and (len(done) > 8 or size > 6000)
    assert sinks.export_archives(spark.createDataFrame([], "sample_id string, evidence_text string, label string"), f"file://{tmp_path}/empty").count() == 0


def test_segments_and_one_json(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"segment_id": "1", "clean_text": "a"}, {"segment_id": "2"}]))
    rows = readers.segments(spark, str(tmp_path / "s.json"))
    assert [(r.ord, r.segment_id, r.clean_text) for r in rows.orderBy("ord").collect()] == [(0, "1", "a"), (1, "2", None)]
    (r,) = sinks.one_json(rows.select("ord", "segment_id"), "ord", note="n").collect()
    assert json.loads(r.value) == {"items": [{"segment_id": "1"}, {"segment_id": "2"}], "note": "n"}


def test_stream_applies_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from minutary.streaming import ingest

    src = spark.range(20).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("event_key"), F.lit("CREATE").alias("db_action"), F.timestamp_seconds(F.col("id")).alias("ts"))
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = ingest.land(ingest.commands(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
