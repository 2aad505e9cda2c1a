"""The corpus operators' queries and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embeddings, html, licenses, linededup, mixing, packing, quality, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        embeddings.op1_embedding_near_dedup,
        bpe.op2_token_counts,
        licenses.op3_license_scan,
        chat.op4_chat_format,
        quality.op5_quality_rules,
        html.op6_html_extraction,
        packing.op7_best_fit_packing,
        linededup.op8_line_dedup,
        mixing.op9_mix_sources,
        simhash.op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.OP3_SQL, "op4_chat_format": chat.OP4_SQL, "op8_line_dedup": linededup.OP8_SQL, "op9_mix_sources": mixing.OP9_SQL}
