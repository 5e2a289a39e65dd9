"""Queries of study progress, ensembles, agreement and combined verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.text import repeats, tokens
from lectern.operators import sequence, study
from lectern.operators.relational import merge
from lectern.plans.registry import query
from lectern.sources.tables import table, utterances

_R = "r AS (SELECT user_id, ts, event_id, CAST(1 + floor(value / 20) AS INT) AS rating FROM events WHERE value >= 0)"


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value >= 0").select("user_id", "event_type", "ts", "event_id", (1 + F.floor(F.col("value") / 20)).cast("int").alias("rating"))


@query("a13_topic_accuracy", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN 1 + floor(value / 20) >= 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events WHERE value >= 0 GROUP BY event_type")
def _(spark, sf_dir):
    return _reviews(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("rating") >= 3).cast("double")), 6).alias("accuracy"))


@query("a14_study_progress", f"WITH {_R}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM r) SELECT user_id, count(*) AS total, count(*) FILTER (rating >= 3) AS correct, round(avg(CASE WHEN rating >= 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (rating >= 3 AND k <= 20) AS recent_correct FROM k GROUP BY user_id")
def _(spark, sf_dir):
    return study.progress(_reviews(spark, sf_dir), "user_id", F.col("rating"), ["ts", "event_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query("a17_ensemble_vote", "WITH c AS (SELECT user_id, event_type AS prediction, count(*) AS n, avg(value / 100) AS c FROM events GROUP BY 1, 2), b AS (SELECT user_id, sum(n) AS total, arg_max({'p': prediction, 'n': n, 'c': c}, (n, prediction)) AS b FROM c GROUP BY user_id) SELECT user_id, CASE WHEN b.n * 2 > total THEN b.p ELSE 'mixed' END AS final_type, round(CASE WHEN b.n * 2 > total THEN b.c ELSE 0 END, 6) AS confidence, NOT b.n * 2 > total AS review FROM b")
def _(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("prediction"), (F.col("value") / 100).alias("confidence"))
    return study.ensemble(votes, "user_id").withColumn("confidence", F.round("confidence", 6))


@query("a20_gate", "WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY 1, 2), w AS (SELECT user_id, min(m) AS best FROM m GROUP BY user_id) SELECT user_id, round(best, 6) AS best, best < 20 AS passed FROM w")
def _(spark, sf_dir):
    medians = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("m"))
    return medians.groupBy("user_id").agg(F.round(F.min("m"), 6).alias("best"), (F.min("m") < 20).alias("passed"))


@query(
    "a39_token_agreement",
    """WITH w AS (SELECT conv_id AS session, turn AS seq, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^0-9a-z_\\s]', '', 'g')), '\\s+'), lambda x: x <> '') AS a FROM conversations),
n AS (SELECT *, lead(a) OVER (PARTITION BY session ORDER BY seq) AS b FROM w)
SELECT session, seq, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) / (len(a) + len(b)) END, 6) AS agreement FROM n WHERE b IS NOT NULL""",
)
def _(spark, sf_dir):
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^0-9a-z_\s]", "")), r"\s+"), lambda w: w != "")
    rows = utterances(spark, sf_dir).select("session", "seq", words.alias("a")).withColumn("b", F.lead("a").over(sequence.ordered("session"))).where("b IS NOT NULL")
    return rows.select("session", "seq", F.round(study.token_f1(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("a41_consensus", "WITH p AS (SELECT event_id, value / 100 AS a, lead(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT event_id, round(CASE WHEN abs(a - b) >= 0.3 THEN least(a, b) ELSE (a + b) / 2 END, 6) AS confidence, abs(a - b) >= 0.3 AS disagreement FROM p WHERE b IS NOT NULL")
def _(spark, sf_dir):
    after = F.lead("a").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf_dir, "events").withColumn("a", F.col("value") / 100).withColumn("b", after).where("b IS NOT NULL")
    return pairs.select("event_id", study.consensus(F.col("a"), F.col("b")).alias("c")).select("event_id", F.round("c.confidence", 6).alias("confidence"), "c.disagreement")


@query("w7_quality_status", "WITH q AS (SELECT event_id, value / 2 AS snr, (user_id % 10) / 100.0 AS clip FROM events), s AS (SELECT event_id, CASE WHEN snr < 10 THEN 3 WHEN snr < 15 THEN 2 WHEN snr < 20 THEN 1 ELSE 0 END AS a, CASE WHEN clip > 0.05 THEN 3 WHEN clip > 0.01 THEN 2 ELSE 0 END AS b FROM q) SELECT event_id, ['normal', 'degraded', 'warning', 'critical'][greatest(a, b) + 1] AS status FROM s")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", study.quality_status(F.col("value") / 2, (F.col("user_id") % 10) / 100.0).alias("status"))


_W = "list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\w\\s]', '', 'g')), '\\s+'), lambda x: x <> '')"
_VERDICT = f"""WITH w AS (SELECT conv_id AS session, turn AS seq, {_W} AS a, 1 - length(text) * 20 / 4000 AS silent FROM conversations), n AS (SELECT *, lead(a) OVER (PARTITION BY session ORDER BY seq) AS b FROM w),
g AS (SELECT session, seq, q, array_to_string(a[i:i + q - 1], ' ') AS gram FROM w, unnest([3, 4, 5]) AS x(q), unnest(range(1, len(a) - q + 2)) AS y(i)), r AS (SELECT session, seq, max(k) AS k FROM (SELECT session, seq, q, gram, count(*) AS k FROM g GROUP BY ALL) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) / (len(a) + len(b)) END AS f1, coalesce(k, 0) >= 3 AS repeated FROM n LEFT JOIN r USING (session, seq))
SELECT session, seq, CASE WHEN f1 < 0.5 THEN 'cross_model' WHEN repeated THEN 'repetition' WHEN silent > 0.5 THEN 'vad_contradiction' ELSE 'none' END AS reason,
  round(greatest(0.0, CASE WHEN f1 < 0.5 THEN 1 - f1 END, CASE WHEN repeated THEN 1.0 END, CASE WHEN silent > 0.5 THEN silent END), 6) AS confidence FROM f"""


@query("v13_hallucination_verdict", _VERDICT)
def _(spark, sf_dir):
    """Detectors over utterances: agreement with the next one, repetition, and the share of silence."""
    rows = utterances(spark, sf_dir).withColumn("words", tokens(F.col("text"))).withColumn("next", F.lead("words").over(sequence.ordered("session")))
    silent = 1 - (F.col("end_ms") - F.col("start_ms")) / 4000
    found = study.verdict(F.when(F.col("next").isNotNull(), study.token_f1(F.col("words"), F.col("next"))), repeats(F.col("words")), silent)
    return rows.select("session", "seq", found.alias("v")).select("session", "seq", F.coalesce("v.reason", F.lit("none")).alias("reason"), F.round("v.confidence", 6).alias("confidence"))


@query("j23_missing_citations", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, sf_dir):
    return study.missing(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("j20_common_pairs", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS first_type, b.event_type AS second_type, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def _(spark, sf_dir):
    """Types that share a user; a user's distinct types are few, and only they are paired."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a: F.transform(F.filter("k", lambda b: b > a), lambda b: F.struct(a.alias("first_type"), b.alias("second_type")))))
    return kinds.select(F.explode(pairs).alias("p")).groupBy("p.first_type", "p.second_type").agg(F.count(F.lit(1)).alias("n"))


@query("j15_suppressed_pairs", "SELECT lang, source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'en' AS l, 'src1' AS s UNION ALL SELECT 'de', 'src2') x WHERE x.l = d.lang AND x.s = d.source) GROUP BY 1, 2")
def _(spark, sf_dir):
    hidden = spark.sql("SELECT * FROM VALUES ('en', 'src1'), ('de', 'src2') AS t(lang, source)")
    return table(spark, sf_dir, "documents").select("lang", "source").join(F.broadcast(hidden), ["lang", "source"], "left_anti").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("w13_sibling_ordinals", "WITH m AS (SELECT n_regionkey AS parent, substr(n_name, 1, 1) AS title, min(n_nationkey) AS first_key, string_agg(n_name, '; ' ORDER BY n_nationkey) AS description FROM nation GROUP BY 1, 2) SELECT parent, title, description, CAST(row_number() OVER (PARTITION BY parent ORDER BY first_key) - 1 AS INT) AS ordinal FROM m")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.substring("n_name", 1, 1).alias("title"), "n_nationkey", F.col("n_name").alias("description"))
    return study.renumber(rows, "parent", "title", "n_nationkey")


@query("d3_upsert_by_title", "SELECT n_name AS title, n_regionkey AS parent, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS v FROM nation")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.col("n_regionkey").alias("parent"))
    return merge(rows.withColumn("v", F.lit("old")), rows.where("parent = 1").withColumn("v", F.lit("new")), ["title", "parent"])
