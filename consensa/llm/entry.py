"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann_bits, bpe, branch_merge, chat_pairs, fertility, language_id, pivot_topk, secret_scan, simhash, source_mix, spelling, suffix_dedup, url_filter
from ..functions.session import prepare
from .common import table


def _over(name: str, op):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(table(prepare(spark), sf_dir, name))

    return query


QUERIES = {
    "op1_secret_scan": _over("documents", secret_scan.op1),
    "op2_source_mix": _over("documents", source_mix.op2),
    "op3_language_id": _over("documents", language_id.op3),
    "op4_bpe": _over("documents", bpe.op4),
    "op5_ann_bits": _over("embeddings", ann_bits.op5),
    "op6_url_filter": _over("pages", url_filter.op6),
    "op7_pivot_topk": _over("embeddings", pivot_topk.op7),
    "op8_simhash": _over("documents", simhash.op8),
    "op9_chat_pairs": _over("conversations", chat_pairs.op9),
    "op10_suffix_dedup": _over("documents", suffix_dedup.op10),
    "op11_spelling": _over("documents", spelling.op11),
    "op12_fertility": _over("documents", fertility.op12),
    "op13_branch_merge": _over("documents", branch_merge.op13),
}

#: op1, op3, op4, op5, op8, op10 and op12 have no practical SQL form: tests hold them against brute force, round trips and held-out rows.
ORACLE_SQL = {
    "op2_source_mix": source_mix.OP2_SQL, "op6_url_filter": url_filter.OP6_SQL, "op7_pivot_topk": pivot_topk.OP7_SQL,
    "op9_chat_pairs": chat_pairs.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL, "op13_branch_merge": branch_merge.OP13_SQL,
}
