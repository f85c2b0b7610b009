"""The opN queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import decontamination, html_extraction, language_id, lexical_search, media, ngram_join, pii, quality_knn, sentencepiece_sampling, spelling_variants, substring_dedup, toxicity, warc_zip

QUERIES = {
    "op1_warc_zip": warc_zip.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_toxicity": toxicity.query,
    "op4_ngram_join": ngram_join.query,
    "op5_language_id": language_id.query,
    "op6_decontamination": decontamination.query,
    "op7_html_extraction": html_extraction.query,
    "op8_pii": pii.query,
    "op9_media_columns": media.query,
    "op10_sentencepiece": sentencepiece_sampling.query,
    "op11_quality_knn": quality_knn.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_lexical_search": lexical_search.query,
}
ORACLES: dict[str, str] = {
    "op1_warc_zip": warc_zip.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
