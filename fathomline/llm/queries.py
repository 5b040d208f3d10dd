"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fathomline.llm import decontamination, fim, html_extract, jaccard_join, license_scan, lm_scoring, packing, quality_rules, spelling_variants, substring_dedup, suffix_dedup, token_files, url_filter

QUERIES = {"op2_packing": packing.op2_packing, "op1_quality_rules": quality_rules.op1_quality_rules, "op3_substring_dedup": substring_dedup.op3_substring_dedup, "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup, "op5_decontamination": decontamination.op5_decontamination, "op6_url_filter": url_filter.op6_url_filter, "op7_license_scan": license_scan.op7_license_scan, "op8_html_extract": html_extract.op8_html_extract, "op9_lm_scoring": lm_scoring.op9_lm_scoring, "op10_jaccard_join": jaccard_join.op10_jaccard_join, "op11_spelling_variants": spelling_variants.op11_spelling_variants, "op12_token_files": token_files.op12_token_files, "op13_fim": fim.op13_fim}

ORACLES: dict[str, str] = {**decontamination.ORACLE_SQL, **license_scan.ORACLE_SQL, **substring_dedup.ORACLE_SQL, **suffix_dedup.ORACLE_SQL, **spelling_variants.ORACLE_SQL, **fim.ORACLE_SQL}
