"""Relational queries: scans, predicates, joins, aggregates, top-k, set operations, changes to tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalar
from lectern.operators import relational as R
from lectern.plans.registry import query
from lectern.sources.tables import table, utterances

_U = "u AS (SELECT conv_id AS session, turn AS seq, role AS speaker, text, turn * 4000 AS start_ms FROM conversations)"


@query("s1_session_scan", f"WITH {_U} SELECT session, seq, speaker FROM u WHERE session = 7 ORDER BY seq")
def _(spark, sf_dir):
    return R.partition_scan(utterances(spark, sf_dir), "session", 7).select("session", "seq", "speaker").orderBy("seq")


@query("s19_chunks", "SELECT user_id, i AS chunk, i * 30000 AS start_ms, least(30000, d - i * 30000) AS duration_ms, i = n - 1 AS is_final FROM (SELECT user_id, CAST(sum(value * 1000) AS BIGINT) AS d, greatest(CAST(ceil(CAST(sum(value * 1000) AS BIGINT) / 30000.0) AS BIGINT), 0) AS n FROM events GROUP BY user_id), unnest(range(0, n)) AS t(i)")
def _(spark, sf_dir):
    """Fixed-duration chunks of each user's total."""
    total = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") * 1000)).cast("long").alias("d")).withColumn("n", F.ceil(F.col("d") / 30000)).where("n > 0")
    i = F.col("chunk")
    return total.select("user_id", "d", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk")).select("user_id", "chunk", (i * 30000).alias("start_ms"), F.least(F.lit(30000), F.col("d") - i * 30000).alias("duration_ms"), (i == F.col("n") - 1).alias("is_final"))


@query("s25_owner_export", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')))")
def _(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    chain = [(t("customer"), "c_custkey", "c_nationkey"), (t("nation"), "n_nationkey", "n_regionkey"), (t("region"), "r_regionkey", "r_regionkey")]
    return R.owned(t("orders"), "o_custkey", chain, F.col("r_name") == "ASIA").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("p2_not_distinct_from_false", "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (quality = 1) IS DISTINCT FROM false")
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.where(~(F.col("quality") == 1).eqNullSafe(False)).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("p4_substring_search", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%tion%'")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("text").ilike("%tion%")).select("conv_id", "turn")


@query("p12_ambiguity_band", "SELECT event_id, coalesce(value BETWEEN 40 AND 60, false) AS ambiguous FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.in_band(F.col("value"), 40, 60).alias("ambiguous"))


@query("p14_first_minutes", f"WITH {_U} SELECT session, seq FROM (SELECT *, min(start_ms) OVER (PARTITION BY session) AS m FROM u) WHERE start_ms - m < 12000")
def _(spark, sf_dir):
    first = F.min("start_ms").over(Window.partitionBy("session"))
    return utterances(spark, sf_dir).withColumn("m", first).where("start_ms - m < 12000").select("session", "seq")


@query("p15_row_isolation", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') GROUP BY n_name")
def _(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    seen = R.owned(t("supplier"), "s_nationkey", [(t("nation"), "n_nationkey", "n_regionkey"), (t("region"), "r_regionkey", "r_regionkey")], F.col("r_name") == "EUROPE")
    return seen.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("p21_validation_errors", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN source = 'src0' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def _(spark, sf_dir):
    rules = {"short": F.col("n_chars") >= 200, "language": F.col("lang") == "en", "source": F.col("source") != "src0"}
    return R.quarantine(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), rules).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("j1_foreign_join", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j2_left_join_max", "SELECT c_custkey, max(o_orderdate) AS last_order, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, sf_dir):
    """Orders are aggregated by customer before the join, so the join sees one row for each."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.count("o_orderkey").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "last_order", F.coalesce("n", F.lit(0)).alias("n"))


@query("j7_anti_join", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("j8_lookup_union", "SELECT kind, id, name FROM (SELECT 'supplier' AS kind, s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer) LEFT JOIN (SELECT n_nationkey, n_name AS name FROM nation) ON k = n_nationkey")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    return s.unionByName(c).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k", "left").drop("k")


@query("j16_similar_hashes", "WITH h AS (SELECT doc_id AS id, ('0x' || md5(coalesce(lang, '') || coalesce(source, '') || (n_chars % 7))[1:15])::BIGINT AS h FROM documents), m AS (SELECT a.id, b.id AS other, bit_count(xor(a.h, b.h)) AS distance FROM h a JOIN h b ON a.id <> b.id WHERE bit_count(xor(a.h, b.h)) <= 8) SELECT id, other, CAST(distance AS INT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM m) WHERE rank = 1")
def _(spark, sf_dir):
    text = F.concat(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), (F.col("n_chars") % 7).cast("string"))
    hashed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("h"))
    return R.similar_hashes(hashed, "id", "h")


@query("j19_trace_pairs", "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.ts <= b.ts GROUP BY a.user_id")
def _(spark, sf_dir):
    """Pairs of a click before a purchase of one user, counted by a running sum: the pairs are never formed."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    before = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    counted = e.withColumn("clicks", F.count_if(F.col("event_type") == "click").over(before)).where("event_type = 'purchase'")
    return counted.groupBy("user_id").agg(F.sum("clicks").alias("n")).where("n > 0")


@query("j24_label_precedence", "SELECT doc_id, coalesce(b.label, a.label) AS label FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS label FROM documents) a LEFT JOIN (SELECT doc_id, quality AS label FROM labels) b USING (doc_id)")
def _(spark, sf_dir):
    guess = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("label"))
    human = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.label_precedence([(guess, 0), (human, 1)], "doc_id")


@query("a1_conditional_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a5_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("a11_cost_per_session", "WITH p AS (SELECT 'Brand#' || k AS agent, k / 100.0 AS price FROM range(1, 15) AS t(k)) SELECT l_orderkey AS session, round(sum(l_quantity * coalesce(price, 0)), 4) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN p ON p_brand = agent GROUP BY 1")
def _(spark, sf_dir):
    """Runs priced by a table of prices that lacks some brands: these cost nothing."""
    prices = spark.range(1, 15).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"), (F.col("id") / 100.0).alias("price"))
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return R.costs(runs.select(F.col("l_orderkey").alias("session"), "p_brand", F.col("l_quantity").alias("units")), prices, "p_brand").withColumn("cost", F.round("cost", 4))


@query("a12_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 4).alias("discount"))


_ALLOC = "WITH w AS (SELECT event_type AS topic, greatest(1 - avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0.05) AS w FROM events GROUP BY event_type), q AS (SELECT topic, w / sum(w) OVER () * 20 AS quota FROM w), b AS (SELECT topic, floor(quota) AS base, round(quota - floor(quota), 9) AS rest FROM q) SELECT topic, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, topic) <= 20 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS slots FROM b"


@query("a15_slot_allocation", _ALLOC)
def _(spark, sf_dir):
    accuracy = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(F.avg((F.col("value") > 50).cast("double")).alias("accuracy"))
    return R.allocate(accuracy, "topic", F.greatest(1 - F.col("accuracy"), F.lit(0.05)), 20)


@query("a16_majority_vote", "SELECT user_id, count(*) FILTER (value > 50) AS n_keep, count(*) FILTER (NOT value > 50) AS n_drop, count(*) FILTER (value > 50) >= count(*) FILTER (NOT value > 50) AS kept, count(*) FILTER (value > 50) = count(*) FILTER (NOT value > 50) AS review FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return R.majority(table(spark, sf_dir, "events"), "user_id", F.col("value") > 50)


@query("a18_histogram_map", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda x: F.concat_ws("=", x["event_type"], x["n"])), ",").alias("histogram"))


@query("a19_statistics", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(max(value), 6) AS top FROM events GROUP BY event_type")
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(v), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.max(v), 6).alias("top"))


@query("a21_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(CASE WHEN abs(l_discount - l_tax) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS disagreement FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.avg((F.abs(F.col("l_discount") - F.col("l_tax")) > 0.05).cast("double")), 6).alias("disagreement"))


@query("w6_rolling_quality", "SELECT event_id, round(sum(v * w) / sum(w), 6) AS rolling FROM (SELECT a.event_id, b.value AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) b ON a.user_id = b.user_id AND b.k BETWEEN a.k - 4 AND a.k) GROUP BY event_id")
def _(spark, sf_dir):
    """Mean of a user's last five values with linearly rising weights."""
    last = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0))
    weighted = F.aggregate(F.transform("last", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    n = F.size("last")
    return table(spark, sf_dir, "events").withColumn("last", last).select("event_id", F.round(weighted / (n * (n + 1) / 2), 6).alias("rolling"))


@query("k1_page", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 50 OFFSET 100")
def _(spark, sf_dir):
    return R.page(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.col("conv_id"), F.col("turn")], 100, 50)


@query("k6_latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("k7_next_due", "SELECT user_id, coalesce(min(CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN ts END), min(ts)) AS due FROM events GROUP BY user_id")
def _(spark, sf_dir):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("ts") <= now, F.col("ts"))), F.min("ts")).alias("due"))


@query("k9_first_of_group", "SELECT lang, doc_id, CAST(rank AS INT) AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10")
def _(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("lang", "doc_id").withColumn("rank", rank).where("rank <= 10")


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@query("d1_bulk_update", "SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality IS NULL THEN lang ELSE 'labelled' END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("quality").isNull(), F.col("lang")).otherwise(F.lit("labelled")).alias("lang"))


@query("d2_upsert", "SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) UNION ALL SELECT DISTINCT l_partkey, 'large' FROM lineitem WHERE l_quantity = 50")
def _(spark, sf_dir):
    target = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    source = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("k"), F.lit("large").alias("v")).distinct()
    return R.merge(target, source, ["k"])


@query("d4_insert_if_absent", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    return R.insert_new(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("d6_anonymize", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN -1 ELSE o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    leaving = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("gone"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_semi").join(leaving, "o_custkey", "left")
    return joined.select("o_orderkey", F.when(F.col("gone"), F.lit(-1)).otherwise(F.col("o_custkey")).alias("o_custkey"))


@query("r12_legal_transitions", "WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), n AS (SELECT event_id, CASE before WHEN 'view' THEN 'created' WHEN 'click' THEN 'recording' WHEN 'signup' THEN 'transcribed' ELSE 'processing' END AS a, CASE event_type WHEN 'view' THEN 'recording' WHEN 'click' THEN 'transcribed' WHEN 'signup' THEN 'processing' ELSE 'failed' END AS b FROM s WHERE before IS NOT NULL) SELECT event_id, (a, b) IN (('created', 'recording'), ('recording', 'transcribed'), ('transcribed', 'processing'), ('processing', 'complete'), ('processing', 'failed'), ('failed', 'processing'), ('failed', 'transcribed'), ('created', 'failed'), ('recording', 'failed')) AS legal FROM n")
def _(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("before", before).where("before IS NOT NULL")
    named = lambda c, *names: F.when(c == "view", names[0]).when(c == "click", names[1]).when(c == "signup", names[2]).otherwise(names[3])
    a, b = named(F.col("before"), "created", "recording", "transcribed", "processing"), named(F.col("event_type"), "recording", "transcribed", "processing", "failed")
    return e.select("event_id", R.legal(a, b).alias("legal"))
