"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. The last stage returns pieces of sequences, all others the
columns of documents.
"""

from __future__ import annotations

from minutary.llm import common, decontaminate, near_dedup, packing, quality, suffix_dedup


def quality_rules(spark, docs, sf_dir):
    """Documents that a quality rule rejects go; toxic words are those that the labels show, where there is a table of labels.

    A null text has no words and is rejected; equal rows share their fate; an empty table gives an empty one; other columns are kept.
    """
    labels = common.optional_table(spark, sf_dir, "labels")
    toxic = quality.fit_lexicon(docs, labels) if labels is not None else None
    return quality.filter_documents(docs, quality.cascade_rules(toxic))


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays: the one of the least doc_id.

    Of rows that repeat with their doc_id one stays; texts without words resemble nothing and stay; an empty table gives an empty one.
    """
    return near_dedup.one_of_each(docs)


def repeated_passages(spark, docs, sf_dir):
    """Passages of 200 bytes or more that stand anywhere else are taken out, and documents that are left without a word go.

    A null text stays null; all places of a passage go, so copies take each other out; an empty table gives an empty one; n_chars is
    counted anew, other columns are kept.
    """
    return suffix_dedup.strip_documents(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark window go.

    Null texts, and null texts of the benchmark, have no words and hit nothing; an empty benchmark leaves all documents.
    """
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def sequences(spark, docs, sf_dir):
    """Token pieces packed into sequences of 2048; a null text is packed as its end id alone, and repeated rows each for themselves."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", sequences)]
#: MinHash, the suffix index and the tokenizer are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. A stage's documents go once the next stage's are written; those that the result reads stay."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        written = []
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name}", written)
        common.discard(before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
