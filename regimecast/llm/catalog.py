"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regimecast.llm import bpe, decontaminate, html_text, importance, langid, lexical, licenses, line_dedup, pieces, quality_rules, simhash, suffixes, tokens
from regimecast.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, d: langid.op1_language_id(read(spark, d, "documents")),
    "op2_decontaminate": lambda spark, d: decontaminate.op2_decontaminate(
        read(spark, d, "documents"), read(spark, d, "benchmark")
    ),
    "op3_html_extract": lambda spark, d: html_text.op3_html_extract(read(spark, d, "pages")),
    "op4_line_dedup": lambda spark, d: line_dedup.op4_line_dedup(read(spark, d, "documents")),
    "op5_suffix_dedup": lambda spark, d: suffixes.op5_suffix_dedup(read(spark, d, "documents")),
    "op6_license_scan": lambda spark, d: licenses.op6_license_scan(read(spark, d, "documents")),
    "op7_quality_rules": lambda spark, d: quality_rules.op7_quality_rules(read(spark, d, "documents")),
    "op8_token_binary": lambda spark, d: tokens.op8_token_binary(read(spark, d, "documents")),
    "op9_bpe": lambda spark, d: bpe.op9_bpe(read(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
    "op10_simhash": lambda spark, d: simhash.op10_simhash(read(spark, d, "documents")),
    "op11_sentencepiece": lambda spark, d: pieces.op11_sentencepiece(read(spark, d, "documents")),
    "op12_lexical_search": lambda spark, d: lexical.op12_lexical_search(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op13_importance_resampling": lambda spark, d: importance.op13_importance_resampling(
        read(spark, d, "documents"), read(spark, d, "benchmark")
    ),
}
SQL: dict[str, str] = {"op2_decontaminate": decontaminate.OP2_SQL, "op6_license_scan": licenses.OP6_SQL, "op12_lexical_search": lexical.OP12_SQL, "op13_importance_resampling": importance.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
