"""The pipeline's stages against brute force on a small table."""

import os

import pytest

import corpus_pipeline
from minutary.llm import common, packing


def test_stages_take_effect(spark, docs, passage, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "never seen words here at all in this table of texts")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    from test_operators import bag, measures

    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, str(tmp_path))
        rows.write.parquet(str(tmp_path / f"out{k}"))
        rows = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = rows.collect()
        assert name == "packing" or rows.columns == docs.columns
    first, second, third = (kept[n] for n in names[:3])
    assert not any(measures(r.text)[-1] for r in first) and len(first) > 20
    bags = [bag(r.text) for r in second]
    assert not any(sum((a & b).values()) >= 0.8 * sum((a | b).values()) for i, a in enumerate(bags) for b in bags[:i])
    assert any(passage in r.text for r in second) and not any(passage in r.text for r in third)
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["decontamination"]}
    packed = packing.pack_histogram({r.length: sum(x.length == r.length for x in kept["packing"]) for r in kept["packing"]}, 2048)
    assert max(r.sequence_id for r in kept["packing"]) + 1 == sum(n for _, n in packed)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def stage_folders(spark):
    fs, place = common.filesystem(common.shared_dir(spark))
    return {x for x in os.listdir(place) if x.startswith("stage-")}


def test_run_with_labels_benchmark_nulls_and_repeats(spark, tmp_path):
    """Every kind of document meets its stage, clean ones reach the end, and of the stages' documents only the last stay."""
    import random

    r = random.Random(8)
    clean = [words(r, 30) for _ in range(200)]
    rude = [words(r, 20) + " vilegrunt " + words(r, 20) + " vilegrunts " for _ in range(40)]
    item, passage = words(r, 14), words(r, 60)
    rows = [(i, t) for i, t in enumerate(clean + rude)]
    rows += [(1000, None), (1001, ""), (1002, words(r, 30) + " " + item.upper() + " " + words(r, 30)), (1003, clean[0]), (1004, clean[1] + " more"), (1, clean[1]), (None, words(r, 50))]
    rows += [(1010 + k, words(r, 40) + " " + passage + " " + words(r, 40)) for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], "doc_id long, text string, lang string, kept string, _row string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(200 <= i)) for i in range(240)] + [(3, 1, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = stage_folders(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    pieces = out.collect()
    assert [x.rsplit("-", 1)[0] for x in stage_folders(spark) - before] == ["stage-decontamination"]
    ids = {p.doc_id for p in pieces}
    assert {*range(200), None, 1010, 1011, 1012} == ids
    assert [p.start for p in pieces if p.doc_id == 1] == [0]  # the repeated row stays once


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "repeated_passages", "decontamination", "packing"])
def test_stages_on_an_empty_table(spark, empty, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_an_empty_benchmark_leaves_all(spark, docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_many_sure_terms_are_all_taken(spark):
    """More terms than a short list would hold: each toxic word stands in enough toxic texts to be sure."""
    import random

    from minutary.llm import quality

    r = random.Random(2)
    bad = [f"{a}{b}zz" for a in "bcdfghjkl" for b in ("arq", "elq", "ixq", "oyq", "uwq", "anq")]
    rows = [(i, words(r, 10) + " " + " ".join(bad), 1) for i in range(40)] + [(100 + i, words(r, 30), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = quality.fit_lexicon(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(terms) > 45 and all(any(w == t or t.endswith("*") and w.startswith(t[:-1]) for t in terms) for w in bad)
