"""Query over the centroid clustering, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids
from tidemark.runtime import read_table


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, its distance and its cluster's figures."""
    out = centroids.cluster(read_table(spark, sf_dir, "embeddings"))
    figures = out.clusters.select("cluster", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))
    # as many rows as there are centroids
    return out.rows.join(F.broadcast(figures), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    near = """d{i} AS (SELECT q, cluster, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{i} AS c USING (j) GROUP BY q, cluster),
 n{i} AS (SELECT q, min(struct_pack(d := d, cluster := cluster)) AS best FROM d{i} GROUP BY q)"""
    step = """s{i} AS (SELECT best.cluster AS cluster, j, sum(x * n) AS s, sum(n) AS n FROM n{i} JOIN p USING (q) GROUP BY ALL),
 c{k} AS (SELECT c.cluster, j, CASE WHEN s IS NULL THEN x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{i} AS c LEFT JOIN s{i} AS s USING (cluster, j))"""
    rounds = ",\n ".join(near.format(i=i) + ",\n " + step.format(i=i, k=i + 1) for i in range(centroids.ROUNDS))
    last = centroids.ROUNDS
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT q, n, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM (SELECT q, count(*) AS n FROM v GROUP BY q)),
 f AS (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster FROM v WHERE vec_id IS NOT NULL),
 c0 AS (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM f WHERE cluster < {centroids.K}),
 {rounds},
 {near.format(i=last)},
 r AS (SELECT v.vec_id, best.cluster AS cluster, best.d AS distance FROM v JOIN n{last} USING (q)),
 h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY cluster)
 SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM r JOIN h USING (cluster)"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLE_SQL = {"op12_centroids": _sql()}
