"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import metrics as M
from lectern.plans.registry import query
from lectern.sources.tables import embedded, table

_L = "l AS (SELECT quality AS a, 1 - toxic AS b FROM labels)"


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


@query("a22_kappa", f"WITH {_L}, t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) AS pa, avg(b) AS pb FROM l) SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM t")
def _(spark, sf_dir):
    return M.kappa(_labels(spark, sf_dir), "a", "b").withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


_CONF = "SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a <> 1 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b <> 1) AS fn, count(*) FILTER (a <> 1 AND b <> 1) AS tn FROM l"


@query("a23_confusion", f"WITH {_L}, c AS ({_CONF}) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def _(spark, sf_dir):
    found = M.confusion(_labels(spark, sf_dir), F.col("a") == 1, F.col("b") == 1, 0.0)
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("a25_separation", "SELECT round(avg(CASE WHEN toxic = 1 THEN n_chars END), 4) AS mean_toxic, round(avg(CASE WHEN toxic = 0 THEN n_chars END), 4) AS mean_clean FROM labels JOIN documents USING (doc_id)")
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.agg(F.round(F.avg(F.when(F.col("toxic") == 1, F.col("n_chars"))), 4).alias("mean_toxic"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("n_chars"))), 4).alias("mean_clean"))


@query("a26_purity", "WITH e AS (SELECT vec_id // 50 AS c, label AS t FROM embeddings), n AS (SELECT c, t, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT c, max(n) AS best, sum(n) AS n FROM n GROUP BY c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(best) / sum(n), 6) AS purity FROM b")
def _(spark, sf_dir):
    return M.purity(embedded(spark, sf_dir), "session", "topic").withColumn("purity", F.round("purity", 6))


_ASSIGN = """WITH RECURSIVE n AS (SELECT vec_id // 50 AS c, label AS t, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM n)),
g AS (SELECT k, list(coalesce(n.n, 0) ORDER BY l) AS ns FROM s CROSS JOIN range(0, 10) AS r(l) LEFT JOIN n ON n.c = s.c AND n.t = l GROUP BY k),
f AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(0, 1024), lambda m: CASE WHEN m = 0 THEN CAST(0 AS BIGINT) ELSE CAST(-1000000 AS BIGINT) END) AS best
UNION ALL SELECT f.k + 1, list_transform(range(0, 1024), lambda m: greatest(best[m + 1], list_max(list_transform(range(0, 10), lambda l: CASE WHEN (m >> l) & 1 = 1 THEN best[m - (1 << l) + 1] + ns[l + 1] ELSE -1000000 END)))) FROM f JOIN g ON g.k = f.k)
SELECT (SELECT count(*) FROM embeddings) AS n, round(list_max(best) / (SELECT count(*) FROM embeddings), 6) AS matched_purity FROM f WHERE k = (SELECT count(*) FROM s)"""


@query("a27_matched_purity", _ASSIGN)
def _(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    value = M.matched_purity(rows, "session", "topic")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("matched_purity", F.lit(round(value, 6)))


@query(
    "a28_v_measure_ari",
    """WITH n AS (SELECT vec_id // 50 AS a, label AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM n),
s AS (SELECT any_value(total) AS total, sum(n / total * ln(n * total / (na * nb))) AS mi, -sum(n / total * ln(na / total)) AS ha, -sum(n / total * ln(nb / total)) AS hb, sum(n * (n - 1) / 2) AS pairs, sum(n / na * (na * (na - 1) / 2)) AS pa, sum(n / nb * (nb * (nb - 1) / 2)) AS pb FROM t)
SELECT round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness, round(2 * (mi / hb) * (mi / ha) / (mi / hb + mi / ha), 6) AS v_measure, round(2 * mi / (ha + hb), 6) AS nmi,
round((pairs - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)), 6) AS ari FROM s""",
)
def _(spark, sf_dir):
    found = M.information(embedded(spark, sf_dir), "session", "topic")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(
    "a29_silhouette",
    """WITH e AS (SELECT vec_id AS id, label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT x.id, x.c AS c, y.c AS k, avg(1 - list_cosine_similarity(x.v, y.v)) AS d FROM e x JOIN e y ON x.id <> y.id GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN c = k THEN d END) AS a, min(CASE WHEN c <> k THEN d END) AS b FROM d GROUP BY id)
SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def _(spark, sf_dir):
    rows = embedded(spark, sf_dir).select(F.col("seq").alias("id"), F.col("topic").alias("c"), "embedding")
    return M.silhouette(rows, "c").withColumn("silhouette", F.round("silhouette", 6))


@query(
    "a32_boundary_errors",
    """WITH e AS (SELECT vec_id // 50 AS session, vec_id AS seq, label FROM embeddings), b AS (SELECT session, seq, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS truth, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS guess FROM e WINDOW w AS (PARTITION BY session ORDER BY seq)),
f AS (SELECT session, sum(truth) OVER w AS t, sum(guess) OVER w AS g, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT session, round(avg(CASE WHEN (t > 0) <> (g > 0) THEN 1.0 ELSE 0.0 END), 6) AS p_k, round(avg(CASE WHEN t <> g THEN 1.0 ELSE 0.0 END), 6) AS window_diff FROM f WHERE n = 5 GROUP BY session""",
)
def _(spark, sf_dir):
    before = F.lag("topic").over(Window.partitionBy("session").orderBy("seq"))
    rows = embedded(spark, sf_dir).select("session", "seq", "topic").withColumn("truth", F.coalesce((F.col("topic") != before).cast("int"), F.lit(0)))
    return M.boundary_errors(rows.withColumn("guess", (F.col("seq") % 5 == 0).cast("int")), 5).withColumns({c: F.round(c, 6) for c in ("p_k", "window_diff")})
