"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidecast.llm.align import op13_tokenizer_alignment
from tidecast.llm.bpe import op1_bpe
from tidecast.llm.decontaminate import op4_decontaminate
from tidecast.llm.embed_dup import op11_embedding_links
from tidecast.llm.fingerprints import op10_spot_signatures
from tidecast.llm.html_text import op7_html_extraction
from tidecast.llm.lang_id import op3_language_id
from tidecast.llm.licenses import op6_license_scan
from tidecast.llm.near_dup import op2_near_dedup
from tidecast.llm.resample import op12_importance_resample
from tidecast.llm.secrets import op9_secret_scan
from tidecast.llm.sharding import op8_hilbert_sharding
from tidecast.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_secret_scan": op9_secret_scan,
    "op10_spot_signatures": op10_spot_signatures,
    "op11_embedding_links": op11_embedding_links,
    "op12_importance_resample": op12_importance_resample,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

# The other operators rest on hashes, models, vocabularies or parsers that SQL does not have; their tests hold them against brute force.
SQL: dict[str, str] = {
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), each AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a
), component AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN component ON component.a = sets.doc_id
""",
    "op11_embedding_links": """
WITH RECURSIVE given AS (
  SELECT vec_id, CASE WHEN list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding]) THEN CAST(embedding AS DOUBLE[]) END AS x
  FROM embeddings
), sides AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM given a JOIN given b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM given
  UNION
  SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM sides GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN degree USING (vec_id)
""",
    "op12_importance_resample": r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), laid AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hexed AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM laid)
), bucketed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(h) // 2)]), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM laid JOIN bucketed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counts) + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM counts) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts
), sums AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS g FROM laid JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight,
         CAST(coalesce(g, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN sums USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= 20
)
SELECT scores.*, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM placed) THEN place END AS rank FROM scores LEFT JOIN placed USING (doc_id)
""",
}
