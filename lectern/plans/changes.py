"""Changes to tables: validated upserts, append-only logs, corrections, cascades, reprocessing, merges."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import functions as F

from lectern.operators import governance as G
from lectern.operators import relational as R
from lectern.operators import study
from lectern.plans.registry import query
from lectern.session import scratch
from lectern.sources.tables import sessions, table
from lectern.sources.versions import Versions


@query("d2_validated_upsert", """WITH new AS (SELECT l_suppkey % 5 AS session, CAST(NULL AS VARCHAR) AS topic, l_linenumber AS ordinal, l_partkey AS source FROM lineitem),
old AS (SELECT s_suppkey % 5 AS session, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'x' END AS topic, 1 + s_suppkey % 9 AS ordinal, min(s_suppkey) AS source FROM supplier GROUP BY 1, 2, 3), w AS (SELECT DISTINCT session, topic, ordinal FROM new),
kept AS (SELECT session, topic, ordinal, source, 'old' AS origin FROM old WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.session = old.session AND w.topic IS NOT DISTINCT FROM old.topic AND w.ordinal = old.ordinal))
SELECT session, coalesce(topic, '-') AS topic, ordinal, count(DISTINCT source) AS n_sources, min(origin) AS origin FROM (SELECT * FROM kept UNION ALL SELECT DISTINCT session, topic, ordinal, source, 'new' FROM new) GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    """Sections and their sources replaced by null-safe keys, in one commit, applied twice; a write that cites an unknown source leaves the table as it was."""
    new = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("session"), F.lit(None).cast("string").alias("topic"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_partkey").alias("source"))
    new = new.groupBy("session", "topic", "ordinal").agg(F.collect_set("source").alias("sources")).withColumn("origin", F.lit("new"))
    key = F.col("s_suppkey")
    old = table(spark, sf_dir, "supplier").select((key % 5).alias("session"), F.when(key % 2 == 0, F.lit(None)).otherwise("x").alias("topic"), (1 + key % 9).alias("ordinal"), key.alias("source"))
    old = old.groupBy("session", "topic", "ordinal").agg(F.min("source").alias("source"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"))
    store = Versions(spark, scratch(spark, "notes"))
    store.commit({"sections": old.drop("source").withColumn("origin", F.lit("old")), "provenance": old})
    for _ in range(2):
        G.durable_sections(store, new, known)
    with suppress(G.Rejected):
        G.durable_sections(store, new.withColumns({"sources": F.array(F.lit(-1).cast("long")), "origin": F.lit("bad")}), known)
    p = store.read("provenance").withColumn("topic", F.coalesce("topic", F.lit("-"))).groupBy("session", "topic", "ordinal").agg(F.countDistinct("source").alias("n_sources"))
    return store.read("sections").withColumn("topic", F.coalesce("topic", F.lit("-"))).join(p, ["session", "topic", "ordinal"])


@query("d5_append_only", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    """A log that only grows: rewrites between two appends that would change its rows, or lose some, change nothing."""
    log = G.AppendOnly(spark, scratch(spark, "log"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    log.append(rows.where("event_id % 2 = 0"))
    log.update("event_type", F.lit("gone"))
    log.delete(F.col("event_id") % 4 == 0)
    log.append(rows.where("event_id % 2 = 1"))
    return log.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("d6_cascade", "SELECT 'subject' AS kind, count(*) AS n FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 'session', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 4 UNION ALL SELECT 'user', count(*) FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 'correction', count(*) FROM supplier UNION ALL SELECT 'anonymous', count(*) FROM supplier WHERE s_nationkey = 4")
def _(spark, sf_dir):
    """Deletion of a user: what hangs below it goes, corrections stay without their author."""
    t = lambda n: table(spark, sf_dir, n)
    (users, subjects, kept), corrections = G.forget_user(4, t("nation"), [(t("customer"), "c_custkey", "c_nationkey"), (t("orders"), "o_orderkey", "o_custkey")], t("supplier"), "s_nationkey")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    parts = [count(users, "user"), count(subjects, "subject"), count(kept, "session"), count(corrections, "correction"), count(corrections.where("s_nationkey IS NULL"), "anonymous")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("d7_merge_undo", "SELECT vec_id, label, CASE WHEN label = 3 THEN 4 ELSE label END AS merged_label, label = 3 AS moved FROM embeddings")
def _(spark, sf_dir):
    """A merge of two topics, its audit rows, and the undo that they make exact: the state after each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    merged, audit = R.merge_topics(rows, "label", 3, 4)
    undone = R.undo_merge(merged, audit, "label").withColumn("label", F.col("label").cast("int"))
    moved = audit.select(F.col("moved_id").alias("vec_id"), F.lit(True).alias("moved"))
    both = undone.join(merged.select("vec_id", F.col("label").cast("int").alias("merged_label")), "vec_id").join(moved, "vec_id", "left")
    return both.withColumn("moved", F.coalesce("moved", F.lit(False)))


@query("d8_corrections", "SELECT p_partkey, CASE WHEN p_size = 7 THEN p_name || ' (edited)' ELSE p_name END AS p_name, p_size = 7 AS is_user_edited, CASE WHEN p_size = 7 THEN p_name END AS original, CASE WHEN p_size = 7 THEN p_name || ' (edited)' END AS corrected FROM part")
def _(spark, sf_dir):
    """Edited labels: the table takes them and is marked, and each edit is recorded with what was there before."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(False).alias("is_user_edited"))
    edits = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey", F.concat("p_name", F.lit(" (edited)")).alias("value"), F.lit("u1").alias("user_id"), F.lit(True).alias("consent"))
    changed, log = G.capture(rows, edits, "p_partkey", "p_name", "topic_label_edit", ("is_user_edited", F.lit(True)))
    said = log.select(F.col("source_id").alias("p_partkey"), F.get_json_object("original_value", "$.p_name").alias("original"), F.get_json_object("corrected_value", "$.p_name").alias("corrected"))
    return changed.join(said, "p_partkey", "left")


@query("d9_sticky_links", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'linked' WHEN user_id % 4 = 1 THEN array_to_string(list_sort(list_distinct(list_filter(list(event_type), lambda x: x <> 'error') || ['linked'])), ',') ELSE array_to_string(list_sort(list_distinct(list(event_type))), ',') END AS covered_by, user_id % 4 < 2 OR user_id % 10 = 3 AS manually_corrected FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """Links edited by hand; the mark of an edit stays, whatever comes later."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("covered_by")).withColumn("manually_corrected", F.col("user_id") % 10 == 3)
    ids = rows.select("user_id")
    edit = lambda where, action, link: ids.where(where).select("user_id", F.lit(action).alias("action"), F.lit(link).alias("link"))
    edits = edit("user_id % 4 = 0", "replace", "linked").unionByName(edit("user_id % 4 = 1", "link", "linked")).unionByName(edit("user_id % 4 = 1", "unlink", "error"))
    found = G.linked(rows, edits, "user_id")
    return found.select("user_id", F.array_join(F.array_sort("covered_by"), ",").alias("covered_by"), "manually_corrected")


@query("d11_write_guard", "SELECT item_id FROM benchmark")
def _(spark, sf_dir):
    """A guarded table, written by the one path that may; what another path tries to add is not in it."""
    path, rows = scratch(spark, "guarded"), table(spark, sf_dir, "benchmark").select("item_id")
    with G.write_authority():
        G.guarded_write(rows, path)
    with suppress(PermissionError):
        G.guarded_write(rows.select((-F.col("item_id") - 1).alias("item_id")), path)
    return spark.read.parquet(path)


@query("d12_reprocessed", "WITH o AS (SELECT o_orderkey AS section, o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderstatus = 'F' AS edited FROM orders) SELECT session, CAST(ordinal AS INT) AS ordinal, CASE WHEN edited THEN 'v1' ELSE 'v2' END AS version, count(*) FILTER (edited) OVER (PARTITION BY session) AS preserved FROM o")
def _(spark, sf_dir):
    """All sections made anew, but those that a human has edited stay as they are."""
    from lectern.operators.sequence import renumbered

    old = renumbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.col("o_custkey").alias("session"), "o_orderstatus"), "session", "section")
    edited = old.where("o_orderstatus = 'F'").select("section")
    rows = old.select("section", "session", "ordinal").withColumn("version", F.lit("v1"))
    after, counts = G.reprocessed(rows, edited, rows.withColumn("version", F.lit("v2")))
    return after.join(counts, "session").select("session", "ordinal", "version", "preserved")


@query("r9_reconciled", """WITH s AS (SELECT o_orderkey AS session, o_orderdate AS created_at, (SELECT max(o_orderdate) FROM orders) AS now FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT l_orderkey AS session, max(l_shipdate) AS last_at FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT s.session, CASE WHEN last_at IS NULL THEN 'failed' ELSE 'transcribed' END AS status FROM s LEFT JOIN a ON s.session = a.session WHERE coalesce(last_at, created_at) <= now - INTERVAL 15 MINUTE""")
def _(spark, sf_dir):
    """Recordings that nobody stopped: with utterances they are finalised, without they fail."""
    rows = sessions(spark, sf_dir)
    activity = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("session")).agg(F.max("l_shipdate").alias("last_utterance_at"))
    now = rows.agg(F.max("created_at").alias("now"))
    return study.reconciled(rows, activity, now).select("session", "status")
