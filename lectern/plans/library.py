"""Scans, predicates, joins and sessions of a course library, played by the order tables and documents.

Users are nations, subjects are customers, sessions are orders and their utterances are line items; note sections are
documents, provenance is ``labels``, the syllabus is ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalar, text
from lectern.functions.vector import parse
from lectern.operators import governance as G
from lectern.operators import relational as R
from lectern.operators import search, sequence, study
from lectern.plans.registry import query
from lectern.session import scratch
from lectern.sources import tables as S
from lectern.sources.tables import embedded, sessions, table, utterances

_S = """s AS (SELECT o_orderkey AS session, o_custkey AS subject, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'transcribed' ELSE 'recording' END AS status,
  o_orderpriority LIKE '1%' AS notes_ready, o_orderkey % 5 AS retry_count, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 7 AS INT)) END AS last_retry_at, o_orderdate AS created_at FROM orders)"""


@query("s2_version_scan", "SELECT vec_id // 50 AS session, vec_id AS seq FROM embeddings WHERE label = 3")
def _(spark, sf_dir):
    return embedded(spark, sf_dir).where("topic = 3").select("session", "seq").orderBy("session", "seq")


@query("s3_segment_scan", f"WITH {_S} SELECT session, created_at FROM s WHERE subject = 7")
def _(spark, sf_dir):
    return R.partition_scan(sessions(spark, sf_dir), "subject", 7).select("session", "created_at").orderBy("created_at", "session")


@query("s4_topic_by_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200 AND l_linenumber = 1")
def _(spark, sf_dir):
    """Rows of a composite key; both parts reach the scan."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_orderkey").between(100, 200) & (F.col("l_linenumber") == 1)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("s5_sections", "SELECT source AS session, doc_id AS section, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS ordinal FROM documents WHERE lang = 'en'")
def _(spark, sf_dir):
    notes = R.partition_scan(table(spark, sf_dir, "documents"), "lang", "en").select(F.col("source").alias("session"), F.col("doc_id").alias("section"))
    return sequence.renumbered(notes, "session", "section")


@query("s6_provenance", "SELECT d.doc_id AS section, count(l.doc_id) AS n_sources, count(*) FILTER (quality = 1) AS n_good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def _(spark, sf_dir):
    cited = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("section")).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("quality") == 1).alias("n_good"))
    joined = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section")).join(cited, "section", "left")
    return joined.select("section", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_good", F.lit(0)).alias("n_good"))


@query("s7_foreign_scan", "SELECT item_id, length(text) AS n_chars FROM benchmark")
def _(spark, sf_dir):
    """The syllabus lives in a store of its own; here it is written to, and read from, files behind a view of its own name."""
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.parquet(path := scratch(spark, "syllabus"))
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.read.table(name).select("item_id", F.char_length("text").cast("long").alias("n_chars"))


@query("s9_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf_dir):
    path = scratch(spark, "csv")
    S.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return S.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s10_annotations", "SELECT doc_id, unnest(['quality', 'toxic']) AS annotator, unnest([quality, toxic]) AS label FROM labels")
def _(spark, sf_dir):
    """Wide annotations, read from JSON, as long rows."""
    path = scratch(spark, "json")
    table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").write.json(path)
    return S.annotator_votes(S.read_json(spark, path, "doc_id long, quality int, toxic int"), "doc_id")


@query("s11_versioned_lines", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf_dir):
    """A dataset written as JSON lines under a version, and read back."""
    path = S.write_versioned(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), scratch(spark, "dataset"), "v1")
    return S.read_json(spark, path, "lang string, n long")


@query("s13_whole_texts", "SELECT role, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM conversations GROUP BY role")
def _(spark, sf_dir):
    """Folders of text files, each read whole; a file's folder names its role."""
    path = scratch(spark, "texts")
    table(spark, sf_dir, "conversations").select("role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).write.partitionBy("role").text(path)
    files = S.read_texts(spark, f"{path}/*/*.txt")
    return files.groupBy(F.regexp_extract("path", "role=([^/]+)/", 1).alias("role")).agg(F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query("s20_run_search", "SELECT event_type AS model, max(value) AS best, arg_max(event_id, (value, event_id)) AS run FROM events WHERE value < 100 GROUP BY event_type")
def _(spark, sf_dir):
    """Runs of a tracking table: of each model the best one."""
    runs = table(spark, sf_dir, "events").where("value < 100")
    return R.latest(runs.select("event_type", "event_id", "value"), "event_type", "value", "event_id").select(F.col("event_type").alias("model"), F.col("value").alias("best"), F.col("event_id").alias("run"))


@query("s22_report", "SELECT '| model | n | mean |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || printf('%.3f', mean) || ' |', chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)")
def _(spark, sf_dir):
    """A Markdown table of an aggregate, by way of a CSV sink."""
    path = scratch(spark, "report")
    stats = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.format_string("%.3f", F.avg("value")).alias("mean"))
    S.write_csv(stats, path)
    return S.markdown_table(S.read_csv(spark, path, "model string, n long, mean string"), ["model", "n", "mean"])


@query("s25_full_export", "SELECT kind, count(*) AS n FROM (SELECT 'subject' AS kind FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'session' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'utterance' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))) GROUP BY kind")
def _(spark, sf_dir):
    """All rows of one user, table by table down the chain of ownership, as JSON rows by kind."""
    t = lambda n: table(spark, sf_dir, n)
    chain = [("subject", t("customer"), "c_custkey", "c_nationkey"), ("session", t("orders"), "o_orderkey", "o_custkey"), ("utterance", t("lineitem"), "l_orderkey", "l_orderkey")]
    exported = R.exported(t("nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("k")), chain)
    return exported.groupBy("kind").agg(F.count("record").alias("n"))


@query("p3_is_true_is_false", "SELECT d.doc_id, (quality = 1) IS TRUE AS is_true, (quality = 1) IS FALSE AS is_false FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    good = F.col("quality") == 1
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", good.eqNullSafe(True).alias("is_true"), good.eqNullSafe(False).alias("is_false"))


@query("p5_not_null", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def _(spark, sf_dir):
    has = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id").join(has, "doc_id", "left_semi")


_RETRY = f"WITH {_S}, n AS (SELECT max(created_at) AS now FROM s) SELECT session, CAST(retry_count + 1 AS BIGINT) AS retry_count, now AS last_retry_at FROM s, n WHERE status = 'transcribed' AND NOT notes_ready AND retry_count < 3 AND coalesce(last_retry_at, created_at) <= now - INTERVAL 45 MINUTE"


@query("p9_retry_eligible", _RETRY)
def _(spark, sf_dir):
    """Transcribed sessions without notes, idle for 45 minutes and below the cap of retries; ``now`` is the newest row's time."""
    rows = sessions(spark, sf_dir)
    return study.to_retry(rows, rows.agg(F.max("created_at").alias("now")))


@query("r10_retry_sweep", _RETRY.replace("SELECT session, CAST(retry_count + 1 AS BIGINT) AS retry_count, now AS last_retry_at", "SELECT count(*) AS n, max(session) AS last_session, CAST(sum(retry_count + 1) AS BIGINT) AS retries"))
def _(spark, sf_dir):
    """The sweep applied twice: the second finds nothing, as the first has set ``last_retry_at``."""
    rows = sessions(spark, sf_dir)
    now = rows.agg(F.max("created_at").alias("now"))
    first = study.to_retry(rows, now)
    after = R.merge(rows, rows.drop("retry_count", "last_retry_at").join(first, "session").select(*rows.columns), ["session"])
    both = first.unionByName(study.to_retry(after, now))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max("session").alias("last_session"), F.sum("retry_count").cast("long").alias("retries"))


@query("p10_consent", "SELECT c_custkey, 'consented' AS scope FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'owner' FROM customer WHERE c_nationkey = 5")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    agreed = F.col("c_mktsegment") == "BUILDING"
    scoped = lambda df, name: df.select("c_custkey", F.lit(name).alias("scope"))
    return scoped(G.consented(rows, agreed, "c_nationkey"), "consented").unionByName(scoped(G.consented(rows, agreed, "c_nationkey", owner=5), "owner"))


@query("p11_allowed_columns", "SELECT event_id, event_type FROM events")
def _(spark, sf_dir):
    return G.allowed_columns(table(spark, sf_dir, "events"), ["event_id", "event_type", "user_id", "email"])


_LIC = "['cc0', 'cc-by', 'cc-by-sa', 'cc-by-nd', 'cc-by-nc', 'pdm', 'unknown'][p_size % 7 + 1]"


def _images(spark, sf_dir):
    licence = F.element_at(F.array(*(F.lit(x) for x in ("cc0", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "pdm", "unknown"))), F.col("p_size") % 7 + 1)
    author = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", licence.alias("licence"), author.alias("author"))


@query("p13_licence_gate", f"SELECT p_partkey, CASE WHEN l IN ('cc0', 'cc-by', 'cc-by-sa', 'pdm') THEN 'accepted' WHEN l = 'unknown' THEN 'unverifiable' ELSE 'rejected' END AS verdict FROM (SELECT p_partkey, {_LIC} AS l FROM part)")
def _(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", text.licence_gate(F.col("licence")).alias("verdict"))


@query("f33_composite_score", f"WITH i AS (SELECT p_partkey, {_LIC} AS l, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type || ' widget'), '[a-z0-9]+')) AS b, (p_size % 11) / 10.0 AS clip FROM part), j AS (SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(a || b)) AS sim, clip FROM i WHERE l IN ('cc0', 'cc-by', 'cc-by-sa', 'pdm')) SELECT p_partkey, round(0.5 * sim + 0.5 * clip, 6) AS score, 0.5 * sim + 0.5 * clip >= 0.5 AS accepted FROM j")
def _(spark, sf_dir):
    """Images that pass the licence gate, and only these, are scored."""
    size = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 11) / 10.0).alias("clip"))
    passed = _images(spark, sf_dir).where(text.licence_gate(F.col("licence")) == "accepted").join(size, "p_partkey")
    similar = text.jaccard(text.token_set(F.col("p_name")), text.token_set(F.concat("p_type", F.lit(" widget"))))
    score = scalar.composite(similar, F.col("clip"))
    return passed.select("p_partkey", F.round(score, 6).alias("score"), (score >= 0.5).alias("accepted"))


@query("f30_attribution", f"SELECT p_partkey, p_name || ' by ' || (CASE p_partkey % 4 WHEN 0 THEN 'Unknown author' WHEN 1 THEN 'Unknown author' ELSE p_brand END) || ', licensed under ' || replace(upper({_LIC}), '-', ' ') AS attribution FROM part")
def _(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", text.attribution(F.col("p_name"), F.col("author"), F.col("licence")).alias("attribution"))


@query("p16_ownership", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7) AND c_nationkey = 7")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    first = rows.where("c_nationkey = 7").agg(F.min("c_custkey").alias("k")).first()["k"]
    return G.require_owned(rows, "c_custkey", first, "c_nationkey", 7).select("c_custkey", "c_name")


@query("p17_computed_text", "SELECT page_id, url || ': ' || html AS text FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(": "), "html").alias("text"))


@query("p18_display_label", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_brand || ', ' || p_type ELSE 'Untitled topic' END AS label FROM part")
def _(spark, sf_dir):
    kind = F.col("p_size") % 3
    label = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.lit("")).otherwise(F.lit(None))
    words = F.when(kind == 1, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", text.display_label(label, words, "Untitled topic").alias("label"))


_TYPES = ("image/png", "application/pdf", "text/plain", "image/heic")


@query("p19_upload_validation", "SELECT page_id, CASE WHEN length(html) * 5000 > 20971520 THEN '413' WHEN page_id % 4 IN (0, 3) THEN 'image' WHEN page_id % 4 = 1 THEN 'pdf' ELSE '415' END AS verdict FROM pages")
def _(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(x) for x in _TYPES)), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.upload_verdict(kind, F.char_length("html").cast("long") * 5000).alias("verdict"))


def _versions(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "deployed").otherwise("draft")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("agent"), F.concat(F.lit("v"), (F.col("o_orderkey") % 10).cast("string")).alias("version"), status.alias("status"), F.lit("v3").alias("current"), F.col("o_orderkey").alias("ordinal"))
    return rows


@query("p22_latest_version", "WITH v AS (SELECT o_custkey AS agent, 'v' || (o_orderkey % 10) AS version, CASE WHEN o_orderstatus = 'F' THEN 'deployed' ELSE 'draft' END AS status, o_orderkey AS ordinal FROM orders), r AS (SELECT *, version = 'v3' AS exact, row_number() OVER (PARTITION BY agent ORDER BY version = 'v3' DESC, ordinal DESC) AS rank FROM v WHERE version = 'v3' OR status = 'deployed') SELECT agent, version, status, NOT exact AS fallback FROM r WHERE rank = 1")
def _(spark, sf_dir):
    """Each agent's current version, or else the last one that was deployed; agents with neither are left out."""
    return G.version_of(_versions(spark, sf_dir), "agent")


@query("j4_reviews_of_subject", "SELECT o_custkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf_dir):
    cards = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(cards, "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber")


@query("j5_provenance_join", "SELECT d.doc_id, length(d.text) AS n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n_chars")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("j6_consent_flags", "SELECT c_custkey, n_name, n_regionkey IN (1, 2) AS consents FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").isin(1, 2).alias("consents"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(users, "c_nationkey").drop("c_nationkey")


@query(
    "j13_asof_nearest",
    """WITH p AS (SELECT user_id AS session, event_id AS point, CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events WHERE event_type = 'click'),
w AS (SELECT user_id AS session, event_id AS win, CAST(floor(epoch(ts)) AS BIGINT) AS b, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS e FROM events WHERE event_type = 'view'),
m AS (SELECT p.session, p.point, win, b, greatest(b - pos, pos - e, 0) AS delta FROM p JOIN w ON p.session = w.session WHERE greatest(b - pos, pos - e, 0) <= 300),
r AS (SELECT *, row_number() OVER (PARTITION BY session, point ORDER BY delta, b, win) AS rank FROM m),
f AS (SELECT user_id AS session, arg_max(event_id, (value, -event_id)) AS other, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT p.point, coalesce(r.win, CASE WHEN v >= 80 THEN f.other END) AS match, CASE WHEN r.win IS NOT NULL THEN 'timestamp' WHEN v >= 80 THEN 'semantic' END AS method, round(CASE WHEN r.win IS NOT NULL THEN 1 - delta / 300 WHEN v >= 80 THEN v / 500 END, 6) AS confidence
FROM p LEFT JOIN r ON p.session = r.session AND p.point = r.point AND rank = 1 LEFT JOIN f ON p.session = f.session""",
)
def _(spark, sf_dir):
    """A photo's window by time, at most 300 s away; else the section most like it, if it is like enough."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", "event_type", "value", F.unix_timestamp("ts").alias("at"))
    points = e.where("event_type = 'click'").select("session", F.col("event_id").alias("point"), "at")
    views = e.where("event_type = 'view'")
    near = search.nearest_window(points, views.select("session", F.col("event_id").alias("window"), F.col("at").alias("start"), (F.col("at") + 600).alias("end")))
    like = views.groupBy("session").agg(F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("b")).where("b.value >= 80")
    joined = near.join(like, "session", "left")
    timed, alike = F.col("window").isNotNull(), F.col("b").isNotNull()
    return joined.select(
        "point",
        F.coalesce("window", "b.event_id").alias("match"),
        F.when(timed, "timestamp").when(alike, "semantic").alias("method"),
        F.round(F.when(timed, 1 - F.col("delta") / 300).when(alike, F.col("b.value") / 500), 6).alias("confidence"),
    )


@query("j13_asof_before", "WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS other, user_id, ts AS t2 FROM events WHERE event_type = 'purchase'), m AS (SELECT v.event_id, other, row_number() OVER (PARTITION BY v.event_id ORDER BY t2 DESC, other DESC) AS rank FROM v JOIN p ON v.user_id = p.user_id AND t2 <= ts) SELECT v.event_id, coalesce(other, -1) AS other FROM v LEFT JOIN m ON v.event_id = m.event_id AND rank = 1")
def _(spark, sf_dir):
    """As-of join: both sides in one ordered pass of each user, the last purchase carried on; no pairs are formed."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))
    bought = F.col("event_type") == "purchase"
    carried = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(bought, F.struct("ts", "event_id"))).over(carried)["event_id"]
    return e.withColumn("other", F.coalesce(last, F.lit(-1))).where(~bought).select("event_id", "other")


@query("j21_annotator_pairs", "SELECT 'quality' AS first_annotator, 'toxic' AS second_annotator, count(*) AS n, count(*) FILTER (quality = toxic) AS same FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, sf_dir):
    """Annotators that judged the same rows, pair by pair; an item's judgements are few, and only they are paired."""
    votes = S.annotator_votes(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id").where("label IS NOT NULL")
    return study.annotator_pairs(votes, "doc_id")


@query("j22_assets_to_delete", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 20)")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_custkey < 20").select(F.col("o_orderkey").alias("l_orderkey"))
    doomed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(own, "l_orderkey", "left_semi")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(doomed, "p_partkey", "left_semi")


@query("j26_exists", "SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS provisioned FROM nation")
def _(spark, sf_dir):
    found = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("provisioned", F.lit(True))
    return table(spark, sf_dir, "nation").select("n_nationkey").join(found, "n_nationkey", "left").withColumn("provisioned", F.coalesce("provisioned", F.lit(False)))


@query("w11_renumbered", "SELECT o_custkey AS session, o_orderkey AS section, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS ordinal FROM orders")
def _(spark, sf_dir):
    """Sections of chunks, each numbered by itself, numbered anew in their session."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("section"), F.col("o_orderdate").alias("chunk"))
    return sequence.renumbered(rows, "session", "chunk", "section").select("session", "section", "ordinal")


@query("w12_ordinals_rise", "WITH n AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS before FROM lineitem) SELECT l_orderkey, count(*) AS n, bool_and(before IS NULL OR l_linenumber > before) AS valid FROM n GROUP BY l_orderkey")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("at"))
    return sequence.rising(rows, "l_orderkey", "at", "l_linenumber")


@query("k11_asset_order", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_quantity, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey) AS assets FROM lineitem GROUP BY l_orderkey")
def _(spark, sf_dir):
    """Assets of a section by ordinal, then by the rank of their type."""
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_quantity", rank.alias("rank"), "l_linenumber", "l_partkey", "l_returnflag").alias("a"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("a")).alias("a"))
    return listed.select("l_orderkey", F.array_join(F.transform("a", lambda a: F.concat_ws(":", a["l_linenumber"], a["l_returnflag"])), ",").alias("assets"))


_DELAY = "WITH q AS (SELECT event_id, user_id, floor(epoch(ts)) + 60 * pow(2, user_id % 4) AS eligible FROM events WHERE event_type = 'error'), n AS (SELECT max(floor(epoch(ts))) - 86400 AS now FROM events)"


@query("k12_delay_queue_pop", f"{_DELAY} SELECT user_id, arg_min(event_id, (eligible, event_id)) AS event_id FROM q, n WHERE eligible <= now GROUP BY user_id")
def _(spark, sf_dir):
    """Of each queue the job that has been eligible longest."""
    queue, now = _delayed(spark, sf_dir)
    return study.popped(queue, "user_id", now).select("user_id", "event_id")


def _delayed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    queue = e.where("event_type = 'error'").select("user_id", "event_id", (F.unix_timestamp("ts") + scalar.backoff_seconds(F.col("user_id") % 4)).alias("eligible"))
    return queue, e.agg((F.unix_timestamp(F.max("ts")) - 86400).alias("now"))  # one row


@query("r11_delay_queue", f"{_DELAY}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY eligible, event_id) AS k FROM q, n WHERE eligible <= now) SELECT user_id, count(*) AS popped, min(event_id) AS first_job, max(k) AS rounds FROM o WHERE k <= 3 GROUP BY user_id")
def _(spark, sf_dir):
    """Three rounds of pops from the queues: what is popped leaves the queue, so no job is handed out twice."""
    queue, now = _delayed(spark, sf_dir)
    out = None
    for k in range(1, 4):
        taken = study.popped(queue, "user_id", now)
        out = taken.withColumn("k", F.lit(k).cast("long")) if out is None else out.unionByName(taken.withColumn("k", F.lit(k).cast("long")))
        queue = queue.join(taken.select("event_id"), "event_id", "left_anti").select(*queue.columns)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("popped"), F.min("event_id").alias("first_job"), F.max("k").alias("rounds"))


@query("f15_hex_hamming", "WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) SELECT doc_id, CAST(bit_count(xor(('0x' || h[1:15])::BIGINT, ('0x' || h[17:31])::BIGINT)) AS INT) AS distance FROM h")
def _(spark, sf_dir):
    part = lambda at: F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), at, 15), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", scalar.hamming(part(1), part(17)).alias("distance"))


@query("f17_chunk_ids", "SELECT event_id, event_id // 1000 AS chunk FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.chunk_of(F.col("event_id")).alias("chunk"))


@query("f24_vector_literals", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def _(spark, sf_dir):
    literal = F.concat(F.lit("["), F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), ","), F.lit("]"))
    return table(spark, sf_dir, "embeddings").select("vec_id", parse(literal).alias("v")).select("vec_id", F.size("v").alias("n"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("f28_truncated", "SELECT doc_id, left(text, 200) AS head, length(left(text, 2000)) AS n_kept FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"), F.char_length(F.left("text", F.lit(2000))).cast("long").alias("n_kept"))


@query("f29_last_attempt", f"WITH {_S} SELECT session, coalesce(last_retry_at, created_at) AS last_attempt, created_at - INTERVAL 45 MINUTE AS cutoff FROM s")
def _(spark, sf_dir):
    return sessions(spark, sf_dir).select("session", F.coalesce("last_retry_at", "created_at").alias("last_attempt"), (F.col("created_at") - F.expr("INTERVAL 45 MINUTES")).alias("cutoff"))


@query("f31_version_names", "SELECT p_partkey, regexp_matches(name, '^v[0-9]+\\.[0-9]+\\.[0-9]+\\.md$') AS valid FROM (SELECT p_partkey, 'v' || p_size || '.' || (CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '1.2' END) || '.md' AS name FROM part)")
def _(spark, sf_dir):
    name = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise("1.2"), F.lit(".md"))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_version(name).alias("valid"))


@query("f35_time_forms", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(spark, sf_dir):
    """Seconds since the epoch, back to a timestamp, and its ISO form."""
    at = F.timestamp_seconds("seconds")
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("seconds")).select("event_id", "seconds", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("f38_membership", "SELECT user_id, list_contains(list(event_type), 'purchase') AS bought, len(list_distinct(list(event_type))) AS n_kinds FROM events GROUP BY user_id")
def _(spark, sf_dir):
    kinds = F.collect_set("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_contains(kinds, "purchase").alias("bought"), F.size(kinds).cast("long").alias("n_kinds"))


@query("r13_durable_sessions", f"WITH {_S}, r AS (SELECT o_orderkey AS session FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 10 = 0) SELECT r.session, CASE WHEN s.session IS NULL THEN 'not found' WHEN status = 'transcribed' THEN 'ok' ELSE 'has status ' || status END AS verdict FROM r LEFT JOIN s USING (session)")
def _(spark, sf_dir):
    """Which sessions may go on, of all that are asked for: only transcribed ones, and some that are asked for do not exist."""
    own = sessions(spark, sf_dir)
    asked = own.select("session").unionByName(own.where("session % 10 = 0").select((-1 - F.col("session")).alias("session")))
    return G.start_verdicts(asked, own, "session")


@query("w14_clamped_words", "WITH RECURSIVE w AS (SELECT l_orderkey AS session, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) AS k, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity + l_discount * 100 AS BIGINT) AS e FROM lineitem), f AS (SELECT session, k, greatest(s, 0) AS s, greatest(e, greatest(s, 0) + 1) AS e FROM w WHERE k = 1 UNION ALL SELECT w.session, w.k, greatest(w.s, f.e), greatest(w.e, greatest(w.s, f.e) + 1) FROM f JOIN w ON w.session = f.session AND w.k = f.k + 1) SELECT session, CAST(count(*) AS BIGINT) AS n, CAST(max(e) AS BIGINT) AS last_end, CAST(sum(s) AS BIGINT) AS starts FROM f GROUP BY session")
def _(spark, sf_dir):
    """Word times of each session (its lines in order) made monotone."""
    word = F.struct(F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").cast("string").alias("word"), F.col("l_quantity").cast("long").alias("start_ms"), F.round(F.col("l_quantity") + F.col("l_discount") * 100).cast("long").alias("end_ms"))
    words = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    clamped = words.select("session", sequence.clamp_words(F.col("words")).alias("w"))
    return clamped.select("session", F.size("w").cast("long").alias("n"), F.array_max(F.transform("w", lambda w: w["end_ms"])).alias("last_end"), F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["start_ms"]).alias("starts"))


@query("j25_preserved_labels", """WITH e AS (SELECT label AS topic, vec_id // 50 AS session, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT topic, i, avg(v[i]) AS x FROM e, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY 1, 2), c AS (SELECT topic, list(x ORDER BY i) AS v FROM p GROUP BY topic),
ps AS (SELECT session, i, avg(v[i]) AS x FROM e, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY 1, 2), k AS (SELECT session AS cluster, list(x ORDER BY i) AS v FROM ps GROUP BY session),
m AS (SELECT cluster, topic, list_cosine_similarity(k.v, c.v) AS s FROM k, c WHERE topic % 2 = 0), b AS (SELECT cluster, arg_max(topic, (s, -topic)) AS topic, max(s) AS s FROM m GROUP BY cluster)
SELECT k.cluster, CAST(CASE WHEN s >= 0.2 THEN topic END AS BIGINT) AS topic, round(CASE WHEN s >= 0.2 THEN s END, 6) AS similarity FROM k LEFT JOIN b USING (cluster)""")
def _(spark, sf_dir):
    from lectern.operators.cluster import preserved_labels

    rows = embedded(spark, sf_dir)
    topics = sequence.mean_pool(rows, "topic").withColumn("is_user_edited", F.col("topic") % 2 == 0)
    clusters = sequence.mean_pool(rows, "session").withColumnRenamed("session", "cluster")
    return preserved_labels(clusters, topics, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("r3_preprocessed", "WITH c AS (SELECT conv_id AS session, turn AS sequence, least(1.0, length(text) / 200.0) AS speech FROM conversations) SELECT session, sequence, round(speech, 6) AS speech_ratio, speech > 0.1 AS has_speech, sequence = 7 AS final FROM c")
def _(spark, sf_dir):
    """Chunk by chunk: speech ratio and whether there is speech; stateless, so the same select serves a stream."""
    from lectern.streaming.ingest import preprocessed

    rows = utterances(spark, sf_dir).select("session", F.col("seq").alias("sequence"), F.array(F.struct(F.lit(0).alias("start_ms"), F.char_length("text").alias("end_ms"))).alias("regions"), F.lit(200).alias("duration_ms"), (F.col("seq") == 7).alias("final"))
    return preprocessed(rows).select("session", "sequence", F.round("speech_ratio", 6).alias("speech_ratio"), "has_speech", "final")


@query("r2_status_flip", f"WITH {_S}, c AS (SELECT DISTINCT l_orderkey AS session FROM lineitem WHERE l_linenumber = 1) SELECT session, CASE WHEN status = 'recording' AND session IN (SELECT session FROM c) THEN 'transcribed' ELSE status END AS status FROM s")
def _(spark, sf_dir):
    """Sessions take their next status on their first chunk; more chunks, or the same ones again, change nothing."""
    from lectern.streaming.ingest import first_chunk_status

    rows = sessions(spark, sf_dir).select("session", "status")
    chunks = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("session"))
    once = first_chunk_status(rows, chunks, "recording", "transcribed")
    return first_chunk_status(once, chunks, "recording", "transcribed")
