"""Queries of this package by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontam, htmltext, iblt, langid, mixing, packing, periods, ring, simhash, substrings, toxicity, urlfilter
from .common import table


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_mixture": lambda s, d: langid.op1(table(s, d, "documents")),
        "op2_token_packing": lambda s, d: packing.op2(table(s, d, "documents")),
        "op3_url_rules": lambda s, d: urlfilter.op3(table(s, d, "pages")),
        "op4_simhash_anchors": lambda s, d: simhash.op4(table(s, d, "documents")),
        "op5_decontamination": lambda s, d: decontam.op5(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_source_mixing": lambda s, d: mixing.op6(table(s, d, "documents")),
        "op7_repeated_substrings": lambda s, d: substrings.op7(table(s, d, "documents")),
        "op8_toxicity": lambda s, d: toxicity.op8(table(s, d, "documents"), table(s, d, "labels")),
        "op9_sketch_fingerprints": lambda s, d: iblt.op9(table(s, d, "documents")),
        "op10_main_text": lambda s, d: htmltext.op10(table(s, d, "pages")),
        "op11_centroid_clusters": lambda s, d: centroids.op11(table(s, d, "embeddings")),
        "op12_periodic_runs": lambda s, d: periods.op12(table(s, d, "documents")),
        "op13_ring_shards": lambda s, d: ring.op13(table(s, d, "documents")),
        "pipeline": _pipeline,
    }


_OP3 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""


def _op11(rounds: int = 10) -> str:
    """Every distance in every round, without screening; a round is two tables."""
    far = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT 8))",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT v.r, min({{'d': {far}, 'c': c.c}}) AS m FROM v CROSS JOIN c{t} c GROUP BY v.r)")
        if t < rounds:
            whole = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.c, coalesce(x.q, c.q) AS q FROM c{t} c LEFT JOIN (
  SELECT c, list({whole} ORDER BY k) AS q FROM (SELECT m.c AS c, k, COUNT(*) AS n, SUM(q[k]) AS s FROM a{t} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2) GROUP BY c) x ON x.c = c.c)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(SUM(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(SUM(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn, draw or hash as SQL cannot, or compare what only
    brute force over every text would; tests hold them against brute force,
    exact round trips or held-out accuracy."""
    return {"op3_url_rules": _OP3, "op11_centroid_clusters": _op11()}
