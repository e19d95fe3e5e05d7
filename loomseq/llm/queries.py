"""The operators' queries by name, and their SQL where SQL can express them."""

from loomseq.llm import exact_dedup, license_scan, line_dedup, media, mixing, near_dedup, packing, quality, token_store, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_pack": packing.op4_pack,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_media": media.op7_media,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_token_store": token_store.op10_token_store,
}
ORACLE_SQL = exact_dedup.SQL | line_dedup.SQL | mixing.SQL | near_dedup.SQL | url_filter.SQL | license_scan.SQL
