"""SQL twins of the text operators that SQL can express."""

from __future__ import annotations

LLM_ORACLES: dict[str, str] = {}

LLM_ORACLES["op4_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents),
ranked AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id
  FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked"""

# The given conversations fit one page each.
LLM_ORACLES["op10_chat_format"] = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM turns GROUP BY conv_id),
same AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered FROM whole GROUP BY n_turns, rendered)
SELECT conv_id, CAST(0 AS INTEGER) AS page, n_turns, copies, rendered FROM same AS s
WHERE NOT EXISTS (
  SELECT 1 FROM same AS longer WHERE longer.n_turns > s.n_turns AND starts_with(longer.rendered, s.rendered))"""

LLM_ORACLES["op11_gnat_negatives"] = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept AS a JOIN kept AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives AS p JOIN scored AS n
  ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3"""


def _rounds(rounds: int = 3, clusters: int = 16) -> str:
    """Centroids c0, c1, ... and assignments a0, a1, ... as one common table expression each."""
    parts = [
        """kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "numbered AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, v FROM kept)",
        f"""c0 AS (
  SELECT number - 1 AS cluster, v AS c FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS number FROM kept)
  WHERE number <= {clusters})""",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, v, best.d AS d, best.cluster AS cluster FROM (
    SELECT n, vec_id, v, min(struct_pack(
      d := list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c), cluster := cluster)) AS best
    FROM numbered, c{k} GROUP BY n, vec_id, v))"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} AS (
  SELECT cluster, coalesce(m.c, old.c) AS c FROM c{k} AS old LEFT JOIN (
    SELECT cluster, list(floor(s / n) ORDER BY place) AS c FROM (
      SELECT cluster, place, sum(v[place]) AS s, count(*) AS n
      FROM a{k}, range(1, 65) AS places(place) GROUP BY cluster, place)
    GROUP BY cluster) AS m USING (cluster))"""
            )
    return ",\n".join(parts)


LLM_ORACLES["op12_laesa_centroids"] = f"""
WITH {_rounds()}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)"""
