"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from . import common, decontaminate, hard_negatives, hnsw, html_main, lm_score, near_dedup, packing, prefix_trie, quality, sharding, suffix_dedup, token_counts, token_files


def op1_stupid_backoff(spark, sf_dir):
    return lm_score.score(common.table(spark, sf_dir, "documents"))


def op2_bagminhash(spark, sf_dir):
    return near_dedup.near_classes(common.table(spark, sf_dir, "documents"))


def op3_two_tier_token_counts(spark, sf_dir):
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"))


def op4_mph_token_files(spark, sf_dir):
    return token_files.round_trip(common.table(spark, sf_dir, "documents"))


def op5_run_length_index(spark, sf_dir):
    return suffix_dedup.removals(common.table(spark, sf_dir, "documents"))


def op6_positional_index(spark, sf_dir):
    return decontaminate.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_shortest_pack_first(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op8_byte_prefix_shards(spark, sf_dir):
    return sharding.shard_by_bytes(common.table(spark, sf_dir, "documents"))


def op9_quality_cascade(spark, sf_dir):
    return quality.score_documents(common.table(spark, sf_dir, "documents"), common.optional_table(spark, sf_dir, "labels"))


def op10_block_labeller(spark, sf_dir):
    return html_main.extract(common.table(spark, sf_dir, "pages"))


def op11_bit_sliced_negatives(spark, sf_dir):
    return hard_negatives.mine(common.table(spark, sf_dir, "embeddings"), label=hard_negatives.shifted_label())


def op12_sharded_hnsw(spark, sf_dir):
    return hnsw.nearest(common.table(spark, sf_dir, "embeddings"))


def op13_lcp_mergesort_trie(spark, sf_dir):
    return prefix_trie.trie(common.table(spark, sf_dir, "conversations"))


def queries():
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql():
    return {"op1_stupid_backoff": lm_score.ORACLE_SQL, "op6_positional_index": decontaminate.ORACLE_SQL, "op9_quality_cascade": quality.ORACLE_SQL, "op11_bit_sliced_negatives": hard_negatives.ORACLE_SQL, "op13_lcp_mergesort_trie": prefix_trie.ORACLE_SQL}
