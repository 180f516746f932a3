"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import html_extract, license_scan, line_dedup, minmax_dedup, mixing, ngram_join, packing, quality_rules, spelling, token_files, topk_search, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_topk_search": topk_search.op2_topk_search,
        "op3_mixing": mixing.op3_mixing,
        "op4_token_files": token_files.op4_token_files,
        "op5_packing": packing.op5_packing,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_warc": warc.op9_warc,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_minmax_dedup": minmax_dedup.op11_minmax_dedup,
        "op12_spelling": spelling.op12_spelling,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op2_topk_search": topk_search.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op8_license_scan": license_scan.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op11_minmax_dedup": minmax_dedup.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
