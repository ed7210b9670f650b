"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fim, flac, hashindex, importance, packing, passages, pii, quality, simhash, suffixtree, tokenshards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_personal_data": pii.op2_personal_data,
        "op3_preference_format": chat.op3_preference_format,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_suffix_tree_scores": suffixtree.op5_suffix_tree_scores,
        "op6_flac_media": flac.op6_flac_media,
        "op7_simhash_groups": simhash.op7_simhash_groups,
        "op8_shared_passages": passages.op8_shared_passages,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_token_shards": tokenshards.op10_token_shards,
        "op11_exact_duplicates": hashindex.op11_exact_duplicates,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_importance_draw": importance.op13_importance_draw,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.sql(), "op3_preference_format": chat.SQL, "op11_exact_duplicates": hashindex.SQL, "op12_fill_in_middle": fim.SQL}
