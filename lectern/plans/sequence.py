"""Queries over ordered and embedded sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.scalar import midpoint
from lectern.functions.text import CUES, GREETINGS
from lectern.operators import search, sequence
from lectern.operators.metrics import diversity
from lectern.operators.vectorindex import build_vector_index, index_knn, recall
from lectern.plans.registry import query
from lectern.session import scratch
from lectern.sources.tables import embedded, utterances

_E = "e AS (SELECT vec_id // 50 AS session, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS embedding, label AS topic FROM embeddings)"
_U = "u AS (SELECT conv_id AS session, turn AS seq, role AS speaker, text, turn * 4000 AS start_ms, turn * 4000 + length(text) * 20 AS end_ms FROM conversations)"
_SIM = f"""{_E}, s AS (
  SELECT session, seq, list_cosine_similarity(embedding, lead(embedding) OVER (PARTITION BY session ORDER BY seq)) AS similarity FROM e
), t AS (
  SELECT *, quantile_cont(similarity, 0.25) OVER (PARTITION BY session) AS threshold, stddev_pop(similarity) OVER (PARTITION BY session) AS spread FROM s
), c AS (SELECT *, CAST(coalesce(similarity < threshold, false) AS INT) AS cut FROM t
), g AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY seq) - cut AS segment FROM c
), k AS (
  SELECT session, segment, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n, max(CASE WHEN cut = 1 THEN similarity END) AS at_cut,
         any_value(threshold) AS threshold, any_value(spread) AS spread FROM g GROUP BY session, segment
)"""


@query("w1_context_windows", f"WITH {_U} SELECT session, seq, string_agg(text, ' ') OVER w AS context, count(*) OVER w AS n_context FROM u WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    return sequence.context_windows(utterances(spark, sf_dir), 3).select("session", "seq", "context", "n_context")


@query("w2_adjacent_similarity", f"WITH {_SIM} SELECT session, seq, round(similarity, 6) AS similarity FROM s")
def _(spark, sf_dir):
    return sequence.adjacent_similarity(embedded(spark, sf_dir)).select("session", "seq", F.round("similarity", 6).alias("similarity"))


@query("w3_session_threshold", f"WITH {_SIM} SELECT session, round(any_value(threshold), 6) AS threshold, round(any_value(spread), 6) AS spread FROM t GROUP BY session")
def _(spark, sf_dir):
    scored = sequence.adjacent_similarity(embedded(spark, sf_dir))
    return scored.groupBy("session").agg(F.round(F.percentile("similarity", F.lit(0.25)), 6).alias("threshold"), F.round(F.stddev_pop("similarity"), 6).alias("spread"))


@query(
    "w5_segments",
    f"""WITH {_SIM} SELECT session, CAST(segment AS BIGINT) AS segment, start_seq, end_seq, n, round(CASE WHEN at_cut IS NULL THEN 1.0 ELSE 1 - at_cut END, 6) AS boundary_score,
  round(CASE WHEN at_cut IS NULL THEN 1.0 WHEN spread > 0 THEN least(1.0, abs(threshold - at_cut) / spread) ELSE 0.5 END, 6) AS confidence FROM k""",
)
def _(spark, sf_dir):
    return sequence.segments(embedded(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("boundary_score", "confidence")})


@query("j3_segment_members", f"WITH {_SIM} SELECT e.session, e.seq, e.topic, CAST(k.segment AS BIGINT) AS segment FROM e JOIN k ON e.session = k.session AND e.seq BETWEEN k.start_seq AND k.end_seq")
def _(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    return sequence.members(rows.drop("embedding"), sequence.segments(rows))


_ONE = _SIM.replace("vec_id // 50 AS session", "0 AS session")
#: Segments that a session of one long recording is cut into here, so that the blocks show on small tables too.
_LONG = 400


def _one_session(spark, sf_dir):
    return embedded(spark, sf_dir).withColumn("session", F.lit(0))


@query("w1_long_session", "WITH u AS (SELECT 0 AS session, conv_id * 1000 + turn AS seq, text FROM conversations) SELECT session, seq, string_agg(text, ' ') OVER w AS context, count(*) OVER w AS n_context FROM u WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    """All turns as one session: no task holds it, as windows run in blocks with halo rows."""
    rows = utterances(spark, sf_dir).select(F.lit(0).alias("session"), (F.col("session") * 1000 + F.col("seq")).alias("seq"), "text")
    return sequence.long_context_windows(rows, 3, _LONG).select("session", "seq", "context", "n_context")


@query(
    "w5_long_session",
    f"""WITH {_ONE} SELECT session, CAST(segment AS BIGINT) AS segment, start_seq, end_seq, n, round(CASE WHEN at_cut IS NULL THEN 1.0 ELSE 1 - at_cut END, 6) AS boundary_score,
  round(CASE WHEN at_cut IS NULL THEN 1.0 WHEN spread > 0 THEN least(1.0, abs(threshold - at_cut) / spread) ELSE 0.5 END, 6) AS confidence FROM k""",
)
def _(spark, sf_dir):
    """All embedded rows as one session, segmented in blocks."""
    return sequence.long_segments(_one_session(spark, sf_dir), most=_LONG).withColumns({c: F.round(c, 6) for c in ("boundary_score", "confidence")})


@query("j3_long_members", f"WITH {_ONE} SELECT e.session, e.seq, CAST(k.segment AS BIGINT) AS segment FROM e JOIN k ON e.session = k.session AND e.seq BETWEEN k.start_seq AND k.end_seq")
def _(spark, sf_dir):
    rows = _one_session(spark, sf_dir)
    return sequence.long_members(rows.select("session", "seq"), sequence.long_segments(rows, most=_LONG), _LONG)


_POOL = """p AS (SELECT {keys}, i, avg(embedding[i]) AS x, count(*) AS n FROM {src}, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY {keys}, i)"""


@query("a6_mean_pool", f"WITH {_E}, {_POOL.format(keys='session', src='e')} SELECT session, i - 1 AS i, n, round(x, 6) AS x FROM p")
def _(spark, sf_dir):
    pooled = sequence.mean_pool(embedded(spark, sf_dir), "session")
    return pooled.select("session", "n", F.posexplode("centroid").alias("i", "x")).select("session", F.col("i").cast("long"), "n", F.round("x", 6).alias("x"))


@query("a7_topic_centroids", f"WITH {_E}, {_POOL.format(keys='topic', src='e')} SELECT topic, max(n) AS n, round(sqrt(sum(x * x)), 6) AS length, round(max(CASE WHEN i = 1 THEN x END), 6) AS first FROM p GROUP BY topic")
def _(spark, sf_dir):
    pooled = sequence.mean_pool(embedded(spark, sf_dir), "topic")
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return pooled.select("topic", "n", F.round(length, 6).alias("length"), F.round(F.element_at("centroid", 1), 6).alias("first"))


@query("a8_cluster_summary", f"WITH {_E} SELECT session, topic, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY session, topic")
def _(spark, sf_dir):
    return embedded(spark, sf_dir).groupBy("session", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("w15_next_positive", f"WITH {_E} SELECT topic, seq, CASE WHEN count(*) OVER (PARTITION BY topic) > 1 THEN coalesce(lead(seq) OVER (PARTITION BY topic ORDER BY seq), min(seq) OVER (PARTITION BY topic)) END AS follower FROM e")
def _(spark, sf_dir):
    return sequence.next_of_group(embedded(spark, sf_dir).select("topic", "seq"), "topic", "seq")


@query("w16_batches", f"WITH {_U} SELECT session, seq, CAST(floor((row_number() OVER (PARTITION BY session ORDER BY seq) - 1) / 3) AS BIGINT) AS batch FROM u")
def _(spark, sf_dir):
    return sequence.batches(utterances(spark, sf_dir).select("session", "seq"), 3)


_CUE_SQL = " UNION ALL ".join(f"SELECT session, seq, '{name}' AS cue, CAST({weight} AS DOUBLE) AS weight FROM u WHERE regexp_matches(text, '(?i){pattern.replace(chr(39), chr(39) * 2)}')" for name, (pattern, weight) in CUES.items())


@query("f5_transition_cues", f"WITH {_U} {_CUE_SQL}")
def _(spark, sf_dir):
    return sequence.cue_matches(utterances(spark, sf_dir), CUES)


@query("w10_greeting_start", f"""WITH {_U} SELECT session, min(seq) AS start_seq FROM u WHERE regexp_matches(text, '(?i){GREETINGS["en"]}') OR regexp_matches(text, '(?i){GREETINGS["es"]}') GROUP BY session""")
def _(spark, sf_dir):
    any_ = F.lit(False)
    for pattern in GREETINGS.values():
        any_ = any_ | F.col("text").rlike("(?i)" + pattern)
    return utterances(spark, sf_dir).where(any_).groupBy("session").agg(F.min("seq").alias("start_seq"))


# every fifth word position stands in for cues where texts hold none: rows whose topic differs from the one before
_TURN = f"""{_SIM}, d AS (SELECT session, seq, topic, lag(topic) OVER (PARTITION BY session ORDER BY seq) AS before FROM e
), q AS (SELECT session, seq, 'turn' AS cue, 0.5 AS weight FROM d WHERE topic <> before
), near AS (
  SELECT q.session, q.seq, k.segment, weight, row_number() OVER (PARTITION BY q.session, q.seq ORDER BY abs(q.seq - k.start_seq), k.start_seq) AS rank
  FROM q JOIN k ON q.session = k.session AND abs(q.seq - k.start_seq) <= 3)"""


def _turns(spark, sf_dir):
    before = F.lag("topic").over(sequence.ordered("session"))
    rows = embedded(spark, sf_dir).select("session", "seq", "topic").withColumn("before", before).where("topic <> before")
    return rows.select("session", "seq", F.lit("turn").alias("cue"), F.lit(0.5).alias("weight"))


@query("j9_nearest_segment", f"WITH {_TURN} SELECT session, seq, CAST(segment AS BIGINT) AS segment FROM near WHERE rank = 1")
def _(spark, sf_dir):
    return sequence.nearest_segment(_turns(spark, sf_dir), sequence.segments(embedded(spark, sf_dir))).select("session", "seq", "segment")


@query(
    "v12_boundary_boost",
    f"""WITH {_TURN}, b AS (SELECT session, segment, sum(weight) AS w FROM near WHERE rank = 1 GROUP BY session, segment)
SELECT k.session, CAST(k.segment AS BIGINT) AS segment, round(CASE WHEN at_cut IS NULL THEN 1.0 ELSE 1 - at_cut END + 0.2 * coalesce(w, 0), 6) AS boosted_score
FROM k LEFT JOIN b ON k.session = b.session AND k.segment = b.segment""",
)
def _(spark, sf_dir):
    spans = sequence.segments(embedded(spark, sf_dir))
    return sequence.boosted(spans, _turns(spark, sf_dir)).select("session", "segment", F.round("boosted_score", 6).alias("boosted_score"))


_KNN = f"""{_E}, m AS (
  SELECT q.seq AS query, r.seq AS id, q.topic AS t0, r.topic AS t1, list_cosine_similarity(q.embedding, r.embedding) AS similarity
  FROM e q JOIN e r ON q.seq <> r.seq WHERE q.seq % 100 = 0)"""


@query("k2_knn", f"WITH {_KNN} SELECT query, id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM m) WHERE rank <= 10")
def _(spark, sf_dir):
    rows = embedded(spark, sf_dir).select(F.col("seq").alias("id"), "embedding")
    return search.knn(rows, rows.where("id % 100 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


def _indexed(spark, sf_dir):
    """The rows, an index of all of them, and the queries: every hundredth row."""
    rows = embedded(spark, sf_dir).select(F.col("seq").alias("id"), "embedding")
    return rows, build_vector_index(rows, scratch(spark, "vectors")), rows.where("id % 100 = 0")


@query("k2_index_knn")
def _(spark, sf_dir):
    """The same search through the vector index: exact similarities of the rows that its codes put first."""
    _, index, asked = _indexed(spark, sf_dir)
    return index_knn(index, asked, 10).withColumn("similarity", F.round("similarity", 6))


@query("k2_index_recall")
def _(spark, sf_dir):
    """The share of the exact ten nearest rows that the index finds."""
    rows, index, asked = _indexed(spark, sf_dir)
    return recall(index_knn(index, asked, 10), rows, asked, 10)


@query("j18_hard_negatives", f"WITH {_KNN} SELECT query, id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id) AS rank FROM m WHERE t0 <> t1) WHERE rank <= 3")
def _(spark, sf_dir):
    """Nearest rows of other topics, in one search: rows of the query's own topic are masked."""
    rows = embedded(spark, sf_dir).select(F.col("seq").alias("id"), "embedding", "topic")
    return search.knn(rows, rows.where("id % 100 = 0"), 3, other="topic").withColumn("similarity", F.round("similarity", 6))


_TOPIC = f"{_E}, {_POOL.format(keys='topic', src='e')}, cen AS (SELECT topic, list(x ORDER BY i) AS centroid FROM p GROUP BY topic)"


@query(
    "j17_nearest_topic",
    f"""WITH {_TOPIC}, b AS (SELECT seq, arg_max(cen.topic, list_cosine_similarity(e.embedding, centroid)) AS topic, max(list_cosine_similarity(e.embedding, centroid)) AS s FROM e, cen GROUP BY seq)
SELECT seq AS id, CASE WHEN s >= 0.3 THEN topic ELSE -1 END AS topic, round(CASE WHEN s >= 0.3 THEN s END, 6) AS similarity FROM b""",
)
def _(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    topics = sequence.mean_pool(rows, "topic")
    found = search.best_topic(rows.select(F.col("seq").alias("id"), "embedding"), topics, 0.3)
    return found.select("id", F.coalesce(F.col("topic").cast("int"), F.lit(-1)).alias("topic"), F.round("similarity", 6).alias("similarity"))


@query(
    "j14_coverage",
    f"""WITH {_TOPIC}, {_POOL.format(keys='session', src='e').replace('p AS', 'ps AS')}, ses AS (SELECT session, list(x ORDER BY i) AS v FROM ps GROUP BY session),
m AS (SELECT topic AS item, session, list_cosine_similarity(centroid, v) AS s FROM cen, ses)
SELECT item, round(max(s), 6) AS best, CASE WHEN max(s) >= 0.8 THEN 'covered' WHEN max(s) >= 0.6 THEN 'partial' ELSE 'uncovered' END AS status, count(*) FILTER (s >= 0.6) AS n_near FROM m GROUP BY item""",
)
def _(spark, sf_dir):
    """Items (topic centroids) against sessions (pooled): the item list is one row for each label."""
    rows = embedded(spark, sf_dir)
    items = sequence.mean_pool(rows, "topic").select(F.col("topic").alias("id"), F.col("centroid").alias("embedding"))
    sessions = sequence.mean_pool(rows, "session").select(F.col("session").alias("id"), F.col("centroid").alias("embedding"))
    return search.coverage(items, sessions).withColumn("best", F.round("best", 6))


@query(
    "a9_coverage_rollup",
    f"""WITH {_TOPIC}, {_POOL.format(keys='session', src='e').replace('p AS', 'ps AS')}, ses AS (SELECT session, list(x ORDER BY i) AS v FROM ps GROUP BY session),
m AS (SELECT topic AS item, max(list_cosine_similarity(centroid, v)) AS s FROM cen, ses GROUP BY topic)
SELECT count(*) AS total, count(*) FILTER (s >= 0.8) AS covered, count(*) FILTER (s >= 0.6 AND s < 0.8) AS partial, round(100.0 * count(*) FILTER (s >= 0.8) / count(*), 2) AS pct FROM m""",
)
def _(spark, sf_dir):
    from lectern.plans.registry import QUERIES

    status = QUERIES["j14_coverage"](spark, sf_dir)
    covered = F.count_if(F.col("status") == "covered")
    return status.agg(F.count(F.lit(1)).alias("total"), covered.alias("covered"), F.count_if(F.col("status") == "partial").alias("partial"), F.round(100.0 * covered / F.count(F.lit(1)), 2).alias("pct"))


@query("a36_diversity", f"WITH {_E}, n AS (SELECT topic, i, sum(embedding[i] / sqrt(list_dot_product(embedding, embedding))) AS x, count(*) AS n FROM e, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY topic, i) SELECT topic, any_value(n) AS n, round(CASE WHEN any_value(n) > 1 THEN greatest(0.0, least(1.0, 1 - (sum(x * x) - any_value(n)) / (any_value(n) * (any_value(n) - 1)))) ELSE 0.0 END, 6) AS diversity FROM n GROUP BY topic")
def _(spark, sf_dir):
    """1 minus the mean pairwise cosine, from the length of the sum of unit vectors: no pair is formed."""
    return diversity(embedded(spark, sf_dir), "topic").withColumn("diversity", F.round("diversity", 6))


@query(
    "j10_best_overlap",
    f"""WITH {_U}, a AS (SELECT * FROM u), b AS (SELECT session, seq, start_ms + 1500 AS start_ms, end_ms + 1500 AS end_ms FROM u),
m AS (SELECT a.session, a.seq, b.seq AS other, greatest(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms), 0) AS o, a.end_ms - a.start_ms + b.end_ms - b.start_ms AS t FROM a JOIN b ON a.session = b.session),
i AS (SELECT *, CASE WHEN t - o > 0 THEN o / (t - o) ELSE 0 END AS iou FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY iou DESC, other) AS rank FROM i WHERE iou >= 0.3)
SELECT a.session, a.seq, coalesce(r.other, -1) AS other, round(r.iou, 6) AS iou FROM a LEFT JOIN r ON a.session = r.session AND a.seq = r.seq AND rank = 1""",
)
def _(spark, sf_dir):
    first = utterances(spark, sf_dir)
    second = first.select("session", "seq", (F.col("start_ms") + 1500).alias("start_ms"), (F.col("end_ms") + 1500).alias("end_ms"))
    return search.best_overlap(first, second).withColumn("iou", F.round("iou", 6)).withColumn("other", F.coalesce("other", F.lit(-1)))


@query(
    "j11_speaker_at_midpoint",
    f"""WITH {_U}, m AS (SELECT session, seq, CAST(floor((start_ms + end_ms) / 2) AS BIGINT) AS mid FROM u), s AS (SELECT session, speaker, start_ms, start_ms + 4000 AS stop_ms FROM u),
j AS (SELECT m.session, m.seq, arg_min(s.speaker, s.start_ms) AS speaker FROM m JOIN s ON m.session = s.session AND mid >= s.start_ms AND mid < s.stop_ms GROUP BY 1, 2)
SELECT m.session, m.seq, coalesce(j.speaker, 'UNKNOWN') AS speaker FROM m LEFT JOIN j USING (session, seq)""",
)
def _(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    mid = rows.select("session", "seq", midpoint(F.col("start_ms"), F.col("end_ms")).alias("mid"))
    turns = rows.select("session", "speaker", "start_ms", (F.col("start_ms") + 4000).alias("end_ms"))
    return search.at_point(mid, turns, "speaker").select("session", "seq", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"))


@query(
    "j12_silence_overlap",
    f"""WITH {_U}, r AS (SELECT session, end_ms AS s2, start_ms + 4000 AS e2 FROM u WHERE end_ms < start_ms + 4000)
SELECT u.session, u.seq, CAST(sum(CASE WHEN s2 IS NULL THEN 0 ELSE greatest(least(u.end_ms + 200, e2) - greatest(u.start_ms - 200, s2), 0) END) AS BIGINT) AS covered_ms FROM u LEFT JOIN r ON u.session = r.session GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    rows = utterances(spark, sf_dir)
    gaps = rows.where("end_ms < start_ms + 4000").select("session", F.col("end_ms").alias("start_ms"), (F.col("start_ms") + 4000).alias("end_ms"))
    return search.covered_ms(rows.select("session", "seq", "start_ms", "end_ms"), gaps, 200)
