"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, licences, ngram_join, ogg, packing, pii, posting_lists, quality, quotes, secrets, spm_sampling, substring, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_ogg": ogg.op1_media_ogg,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_piece_sampling": spm_sampling.op6_piece_sampling,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_pii": pii.op8_pii,
    "op9_quote_links": quotes.op9_quote_links,
    "op10_licence_scan": licences.op10_licence_scan,
    "op11_posting_lists": posting_lists.op11_posting_lists,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": ngram_join.OP3_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op7_secret_scan": secrets.OP7_SQL,
    "op9_quote_links": quotes.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_spelling_variants": variants.OP13_SQL,
}
