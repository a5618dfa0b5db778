"""The subpackage's queries and the SQL that checks them."""

from runloom.llm import decontam, embedding_dedup, language_id, license_scan, packing, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_simhash": simhash.query,
    "op3_decontamination": decontam.query,
    "op4_packing": packing.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_secret_scan": secret_scan.query,
    "op10_language_id": language_id.query,
}

SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_decontamination": decontam.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
}
