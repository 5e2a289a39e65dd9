"""Queries of the scalar functions over texts, JSON, hashes and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import scalar, text
from lectern.operators import sequence
from lectern.plans.registry import query
from lectern.sources.tables import table, utterances

_TOK = "list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\w\\s]', '', 'g')), '\\s+'), lambda x: x <> '')"
_Z = "regexp_replace(lower({0}), '[^0-9a-zA-Z_\\s]', '', 'g')"


@query("f3_token_sets", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS n_tokens FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.token_set(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query(
    "a38_jaccard",
    """WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s, lead(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS session, turn AS seq, round(CASE WHEN len(list_distinct(s || n)) > 0 THEN len(list_intersect(s, n)) / len(list_distinct(s || n)) ELSE 0 END, 6) AS similarity FROM a WHERE n IS NOT NULL""",
)
def _(spark, sf_dir):
    own = text.token_set(F.col("text"))
    rows = utterances(spark, sf_dir).withColumn("own", own).withColumn("next", F.lead("own").over(sequence.ordered("session"))).where("next IS NOT NULL")
    return rows.select("session", "seq", F.round(text.jaccard(F.col("own"), F.col("next")), 6).alias("similarity"))


_KW = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in text.SYLLABUS_WORDS)


@query("f6_keyword_density", f"WITH x AS (SELECT page_id, lower(html) AS t FROM pages) SELECT page_id, round(({_KW}) / greatest(len(regexp_extract_all(t, '[a-z0-9_]+')), 1), 6) AS density FROM x")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(text.keyword_density(F.col("html")), 6).alias("density"))


@query("f11_concepts", "WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in text.CONCEPTS.items()) + " ELSE 'unknown' END AS concept FROM x")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.concept_kind(F.coalesce("text", F.lit(""))).alias("concept"))


@query("f13_balanced_math", "SELECT doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '$', ''))) % 2 = 0 AS balanced FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.balanced_math(F.coalesce("text", F.lit(""))).alias("balanced"))


@query("f12_slug", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("f14_concept_hash", "SELECT item_id, sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS concept_hash FROM benchmark")
def _(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.concept_hash(F.col("text")).alias("concept_hash"))


@query("f16_object_keys", "SELECT conv_id, turn, 'session-' || lpad(CAST(conv_id AS VARCHAR), 5, '0') || '/chunk-' || lpad(CAST(turn AS VARCHAR), 5, '0') AS object_key FROM conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("session-%05d/chunk-%05d", "conv_id", "turn").alias("object_key"))


@query("f22_confidence", "SELECT event_id, round(least(greatest(exp((value - 80) / 20), 0), 1), 6) AS confidence FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(scalar.confidence((F.col("value") - 80) / 20), 6).alias("confidence"))


@query("f26_json_props", "SELECT event_id, json_keys(props)[1] AS first_key, CAST(len(json_keys(props)) AS INT) AS n_keys FROM events")
def _(spark, sf_dir):
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(keys, F.lit(1)).alias("first_key"), F.size(keys).alias("n_keys"))


@query("f20_speaker_tags", "SELECT event_id, CASE WHEN user_id % 7 BETWEEN 0 AND 4 THEN 'SPK_' || chr(CAST(65 + user_id % 7 AS INT)) ELSE 'UNKNOWN' END AS tag FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.speaker_tag(F.col("user_id") % 7).alias("tag"))


@query("w19_backoff", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + CAST(60 * pow(2, user_id % 4) AS BIGINT) AS eligible_at FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp("ts") + scalar.backoff_seconds(F.col("user_id") % 4).cast("long")).alias("eligible_at"))


@query("w20_cadence", "SELECT DISTINCT user_id, CASE WHEN user_id <= 5 THEN user_id % 2 = 0 ELSE user_id % 10 = 0 END AS tens, CASE WHEN user_id BETWEEN 2 AND 5 THEN true ELSE user_id > 5 AND (user_id - 5) % 5 = 0 END AS fives FROM events")
def _(spark, sf_dir):
    n = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", scalar.early_then_tens(n).alias("tens"), scalar.early_then_fives(n).alias("fives"))


@query("w9_repetition", f"WITH w AS (SELECT conv_id AS session, turn AS seq, {_TOK} AS ws FROM conversations), g AS (SELECT session, seq, n, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM w, unnest([3, 4, 5]) AS a(n), unnest(range(1, len(ws) - n + 2)) AS b(i)), c AS (SELECT session, seq, n, gram, count(*) AS k FROM g GROUP BY ALL) SELECT w.session, w.seq, coalesce(max(c.k), 0) >= 3 AS repeated FROM w LEFT JOIN c ON w.session = c.session AND w.seq = c.seq GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = utterances(spark, sf_dir).withColumn("words", text.tokens(F.col("text")))
    return rows.select("session", "seq", text.repeats(F.col("words")).alias("repeated"))


@query("a34_reward", "WITH t AS (SELECT user_id, avg(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS n, count(DISTINCT event_type) / count(*) AS d FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN least(c, n, d) <= 0 THEN 0 ELSE exp((0.30 * ln(c) + 0.20 * ln(n) + 0.15 * ln(d)) / 0.65) END, 6) AS reward FROM t")
def _(spark, sf_dir):
    weights = {"coverage": 0.30, "note_coverage": 0.20, "diversity": 0.15, "validity": 0.20, "provenance": 0.15}
    v = F.col("value")
    terms = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((v > 25).cast("double")).alias("c"), F.avg((v > 50).cast("double")).alias("n"), (F.countDistinct("event_type") / F.count(F.lit(1))).alias("d"))
    given = F.create_map(F.lit("coverage"), F.col("c"), F.lit("note_coverage"), F.col("n"), F.lit("diversity"), F.col("d"), F.lit("validity"), F.lit(None).cast("double"), F.lit("provenance"), F.lit(None).cast("double"))
    return terms.select("user_id", F.round(scalar.weighted_geometric_mean(given, weights), 6).alias("reward"))


@query("k10_keywords", "WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM conversations), c AS (SELECT role, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS rank, max(n) OVER (PARTITION BY role) AS top FROM c) SELECT role, word, round(n / top, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("role")
    best = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "word"))).where("rank <= 10")
    return best.withColumn("score", F.round(F.col("n") / F.max("n").over(w), 6)).select("role", "word", "score", "rank")


@query("a42_first_texts", "SELECT conv_id AS session, string_agg(text, ' ' ORDER BY turn) AS opening FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 5 GROUP BY conv_id")
def _(spark, sf_dir):
    k = F.row_number().over(sequence.ordered("session"))
    first = utterances(spark, sf_dir).withColumn("k", k).where("k <= 5")
    return first.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("opening"))


@query("s23_markdown_export", "SELECT conv_id AS session, '# Session ' || conv_id || chr(10) || string_agg('- **' || role || '**: ' || text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("- **"), "speaker", F.lit("**: "), "text").alias("line"))))
    joined = utterances(spark, sf_dir).groupBy("session").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    return joined.select("session", F.concat(F.lit("# Session "), F.col("session").cast("string"), F.lit("\n"), "body").alias("markdown"))


@query("s23_card_export", "SELECT item_id, replace(replace(left(text, 40), chr(9), ' '), chr(10), ' ') || chr(9) || replace(replace(text, chr(9), ' '), chr(10), ' ') || chr(9) || 'item-' || item_id AS card FROM benchmark")
def _(spark, sf_dir):
    """Cards as lines of front, back and tag, separated by tabs: the text form that flashcard programs import."""
    return table(spark, sf_dir, "benchmark").select("item_id", text.card_line(F.left("text", F.lit(40)), F.col("text"), F.concat(F.lit("item-"), F.col("item_id").cast("string"))).alias("card"))
