"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemart.llm import (
    chat, decontaminate, filter_audit, langid, lm, mixing, ngram_join, order_minhash, packing, pii, repeats, token_files, whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_token_files": token_files.op2_token_files,
        "op3_lm_score": lm.op3_lm_score,
        "op4_pack": packing.op4_pack,
        "op5_pii": pii.op5_pii,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_repeats": repeats.op7_repeats,
        "op8_order_minhash": order_minhash.op8_order_minhash,
        "op9_chat_snapshots": chat.op9_chat_snapshots,
        "op10_language_id": langid.op10_language_id,
        "op11_mix": mixing.op11_mix,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_whiten": whitening.op13_whiten,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontaminate.OP6_SQL, "op9_chat_snapshots": chat.OP9_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
