"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import block_max, credentials, digest, fill_in_middle, kneser_ney, linededup, minhash, mpegts, packing, pfair, prefix_tokens, quotes, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": quotes.op1_quotes,
    "op2_mix": pfair.op2_mix,
    "op3_mpegts": mpegts.op3_mpegts,
    "op4_packing": packing.op4_packing,
    "op5_digest": digest.op5_digest,
    "op6_records": records.op6_records,
    "op7_quality": kneser_ney.op7_quality,
    "op8_secrets": credentials.op8_secrets,
    "op9_linededup": linededup.op9_linededup,
    "op10_minhash": minhash.op10_minhash,
    "op11_search": block_max.op11_search,
    "op12_tokencounts": prefix_tokens.op12_tokencounts,
    "op13_fillmiddle": fill_in_middle.op13_fillmiddle,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP9 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nth
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.nth, k.line, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL = {"op2_mix": pfair.ORACLE, "op9_linededup": _OP9, "op11_search": block_max.ORACLE, "op13_fillmiddle": fill_in_middle.ORACLE}
