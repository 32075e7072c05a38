"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import bitpack, centroids, collocations, decontaminate, langid, linededup, neardup, packing, quality, repeats, rules, secretscan, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": linededup.line_dedup,
    "op2_language_id": langid.language_id,
    "op3_quality_classifier": quality.quality_classifier,
    "op4_quality_rules": rules.quality_rules,
    "op5_packing": packing.packing,
    "op6_suffix_dedup": repeats.suffix_dedup,
    "op7_decontamination": decontaminate.decontamination,
    "op8_token_ids": bitpack.token_ids,
    "op9_minhash_neardup": neardup.minhash_neardup,
    "op10_warc": warc.warc,
    "op11_phrase_collocations": collocations.phrase_collocations,
    "op12_secret_scan": secretscan.secret_scan,
    "op13_centroid_clustering": centroids.centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op11_phrase_collocations": collocations.ORACLE,
    "op13_centroid_clustering": centroids.oracle(),
}
