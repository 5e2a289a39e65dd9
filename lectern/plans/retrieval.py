"""Hybrid search and retrieval over two tables, and the read methods of a course library.

Utterances are conversation turns, notes are documents; a turn takes the vector numbered ``conv_id * 5 + turn`` (turns 0
to 4), a note the one of its own id, where there is one. Queries are all notes whose id is divisible by 100: their words
are the first and last of their distinct words by order, their vector is their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import api
from lectern.functions.text import jaccard
from lectern.operators import search
from lectern.operators.textindex import TextIndex, build_text_index, lexical_top, words_of
from lectern.plans.registry import query
from lectern.session import scratch
from lectern.sources.tables import table

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: Brute force over all words: occurrences of the asked ones, documents that hold what is asked, ranks by place and by nearness.
_SRC = rf"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
src AS (SELECT 'utterance' AS source_type, conv_id * 1000 + turn AS id, role AS scope, {_TOK} AS ws, v FROM conversations LEFT JOIN e ON turn < 5 AND vec_id = conv_id * 5 + turn
  UNION ALL SELECT 'note_section', doc_id, lang, {_TOK}, v FROM documents LEFT JOIN e ON vec_id = doc_id),
n AS (SELECT * FROM src WHERE source_type = 'note_section' AND id % 100 = 0 AND len(ws) > 0)"""
_OCC = """w AS (SELECT DISTINCT unnest(asked) AS word FROM qs),
occ AS (SELECT source_type, id, held_in, word, list(pos ORDER BY pos) AS ps FROM (SELECT source_type, id, scope AS held_in, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM src) SEMI JOIN w USING (word) GROUP BY ALL)"""
_OFTEN = "0.1 / 1.64493406685 * list_sum(list_transform(range(1, len({0}) + 1), lambda j: 1.0 / (j * j)))"
_NEAR = "1 - exp(coalesce(list_sum(flatten(list_transform({0}, lambda a: list_transform(list_filter({1}, lambda b: abs(a - b) <= 100), lambda b: ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2)))))))), 0))"
_FUSED = """lr AS (SELECT *, row_number() OVER (PARTITION BY query, source_type ORDER BY round(score, 9) DESC, id) AS rank FROM lx QUALIFY rank <= 50),
vx AS (SELECT query, source_type, id, list_cosine_similarity(src.v, qs.v) AS score FROM src, qs WHERE src.v IS NOT NULL AND qs.v IS NOT NULL),
vr AS (SELECT *, row_number() OVER (PARTITION BY query, source_type ORDER BY round(score, 9) DESC, id) AS rank FROM vx QUALIFY rank <= 50),
f AS (SELECT coalesce(lr.query, vr.query) AS query, coalesce(lr.source_type, vr.source_type) AS source_type, coalesce(lr.id, vr.id) AS id, lr.rank AS lexical_rank, vr.rank AS vector_rank,
  coalesce(1 / (60 + lr.rank), 0) + coalesce(1 / (60 + vr.rank), 0) AS fused FROM lr FULL JOIN vr ON lr.query = vr.query AND lr.source_type = vr.source_type AND lr.id = vr.id),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 12) DESC, source_type, id) AS rank FROM f)"""
_SOURCES = f"""{_SRC}, qs AS (SELECT id AS query, scope, v, list_distinct([list_min(ws), list_max(ws)]) AS asked FROM n), {_OCC},
m AS (SELECT query, source_type, id, list(ps) AS pl FROM occ JOIN (SELECT query, asked, scope, unnest(asked) AS word FROM qs) USING (word) GROUP BY query, source_type, id, len(asked) HAVING count(*) = len(asked)),
lx AS (SELECT query, source_type, id, CASE WHEN len(pl) = 1 THEN {_OFTEN.format("pl[1]")} ELSE {_NEAR.format("pl[1]", "pl[2]")} END AS score FROM m),
{_FUSED}"""


def _texts(spark, sf_dir):
    """Both sources as (source, id, scope, text): turns by role, notes by language."""
    turns = table(spark, sf_dir, "conversations").select(F.lit("utterance").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("scope"), "text")
    notes = table(spark, sf_dir, "documents").select(F.lit("note_section").alias("source"), F.col("doc_id").alias("id"), F.col("lang").alias("scope"), "text")
    return turns.unionByName(notes)


#: Queries up to which all tasks get their candidates' ids and their notes' words, so that whole texts and words of pairs are not shuffled.
SENT_QUERIES = 10_000
_BUILT: dict[tuple, TextIndex] = {}


def text_index(spark, sf_dir, language="simple"):
    """The text index of both sources, built at the first search of a session and kept for the next ones."""
    key = (spark.sparkContext.applicationId, sf_dir, language)
    if key not in _BUILT:
        _BUILT[key] = build_text_index(_texts(spark, sf_dir), scratch(spark, "index"), language)
    return _BUILT[key]


def _vectors(spark, sf_dir):
    """The rows of both sources that have a vector: (id, scope, embedding)."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turns = table(spark, sf_dir, "conversations").where("turn < 5").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("scope"), (F.col("conv_id") * 5 + F.col("turn")).alias("vec_id"))
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("scope"), F.col("doc_id").alias("vec_id"))
    return {"utterance": turns.join(vectors, "vec_id").drop("vec_id"), "note_section": notes.join(vectors, "vec_id").drop("vec_id")}


def _search(spark, sf_dir, asked, limit=20):
    return search.hybrid_search(text_index(spark, sf_dir), _vectors(spark, sf_dir), asked, limit)


def _asking(spark, sf_dir, text):
    """Queries (query, scope, text, embedding) of all notes with words whose id is divisible by 100; ``text`` is SQL over their words."""
    notes = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("lang").alias("scope"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    return notes.select("query", "scope", F.expr(text).alias("text")).join(vectors, "query", "left")


_FIRST_AND_LAST = """format_string('"%s" "%s"', array_min(words), array_max(words))"""


def _queries(spark, sf_dir):
    return _asking(spark, sf_dir, _FIRST_AND_LAST).drop("scope")


def _longs(found, *names):
    return found.withColumns({c: F.col(c).cast("long") for c in names})


@query("v9_hybrid_search", f"WITH {_SOURCES} SELECT query, source_type, id, lexical_rank, vector_rank, round(fused, 9) AS fused, rank FROM h WHERE rank <= 20")
def _(spark, sf_dir):
    """Both sources, lexical and vector candidates fused; queries without a vector fall back to their words."""
    found = _search(spark, sf_dir, _queries(spark, sf_dir))
    return _longs(found.withColumn("fused", F.round("fused", 9)), "lexical_rank", "vector_rank", "rank")


@query("v9_scoped_search", f"WITH {_SOURCES.replace('USING (word) GROUP BY query', 'USING (word) WHERE held_in = scope GROUP BY query').replace('WHERE src.v IS NOT NULL', 'WHERE src.scope = qs.scope AND src.v IS NOT NULL')} SELECT query, source_type, id, round(fused, 9) AS fused, rank FROM h WHERE rank <= 20")
def _(spark, sf_dir):
    """The same within one subject, the query note's own: rows of other subjects are not looked at."""
    found = _search(spark, sf_dir, _asking(spark, sf_dir, _FIRST_AND_LAST))
    return _longs(found.select("query", "source_type", "id", F.round("fused", 9).alias("fused"), "rank"), "rank")


@query("k4_vector_candidates", f"WITH {_SOURCES} SELECT query, source_type, id, round(score, 6) AS similarity, rank FROM vr WHERE rank <= 10")
def _(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = _queries(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("query").alias("id"), "embedding")
    near = lambda name: search.knn(rows[name].select("id", "embedding"), asked, 10, skip_self=False).withColumn("source_type", F.lit(name))
    return near("utterance").unionByName(near("note_section")).select("query", "source_type", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _lexical(spark, sf_dir, text, k=10, language="simple", scoped=False):
    """The best k of each source for the queries that ``text`` writes."""
    asked = _asking(spark, sf_dir, text).drop("embedding", *([] if scoped else ["scope"]))
    best = lexical_top(text_index(spark, sf_dir, language), asked, k).withColumnRenamed("source", "source_type")
    return best.select("query", "source_type", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("k3_lexical_topk", f"WITH {_SOURCES} SELECT query, source_type, id, round(score, 6) AS score, rank FROM lr WHERE rank <= 10")
def _(spark, sf_dir):
    """All words asked: ranked by how near they stand."""
    return _lexical(spark, sf_dir, _FIRST_AND_LAST)


_PHRASE = f"""{_SRC}, qs AS (SELECT id AS query, [ws[(len(ws) + 1) // 2], ws[(len(ws) + 1) // 2 + 1]] AS asked FROM n WHERE len(ws) > 1), {_OCC},
m AS (SELECT query, a.source_type, a.id, a.ps AS p1, b.ps AS p2, asked FROM qs JOIN occ a ON a.word = asked[1] JOIN occ b ON b.word = asked[2] AND b.source_type = a.source_type AND b.id = a.id
  WHERE len(list_intersect(list_transform(a.ps, lambda p: p + 1), b.ps)) > 0),
lx AS (SELECT query, source_type, id, CASE WHEN asked[1] = asked[2] THEN {_OFTEN.format("p1")} ELSE {_NEAR.format("p1", "p2")} END AS score FROM m),
lr AS (SELECT *, row_number() OVER (PARTITION BY query, source_type ORDER BY round(score, 9) DESC, id) AS rank FROM lx)"""


@query("k3_phrase_search", f"WITH {_PHRASE} SELECT query, source_type, id, round(score, 6) AS score, rank FROM lr WHERE rank <= 10")
def _(spark, sf_dir):
    """A phrase of two words, from the middle of each asking note."""
    return _lexical(spark, sf_dir, """CASE WHEN size(words) > 1 THEN format_string('"%s %s"', words[(size(words) + 1) div 2 - 1], words[(size(words) + 1) div 2]) END""")


_EITHER = f"""{_SRC}, qs AS (SELECT id AS query, scope, [list_min(ws), list_max(ws), ws[1]] AS asked FROM n), {_OCC},
t AS (SELECT query, scope, asked, unnest(list_distinct(asked)) AS word FROM qs),
m AS (SELECT query, source_type, id, any_value(asked) AS asked, list(occ.word) AS held, list(ps) AS pl FROM t JOIN occ ON t.word = occ.word AND scope = held_in GROUP BY query, source_type, id),
lx AS (SELECT query, source_type, id, list_sum(list_transform(pl, lambda p: {_OFTEN.format("p")})) / len(list_distinct(asked)) AS score FROM m
  WHERE list_contains(held, asked[1]) OR (list_contains(held, asked[2]) AND NOT list_contains(held, asked[3]))),
lr AS (SELECT *, row_number() OVER (PARTITION BY query, source_type ORDER BY round(score, 9) DESC, id) AS rank FROM lx)"""


@query("k3_either_without", f"WITH {_EITHER} SELECT query, source_type, id, round(score, 6) AS score, rank FROM lr WHERE rank <= 10")
def _(spark, sf_dir):
    """One word, or another without a third, within the query's subject: ranked by how often they occur."""
    text = """format_string('"%s" or "%s" -"%s"', array_min(words), array_max(words), words[0])"""
    return _lexical(spark, sf_dir, text, scoped=True)


@query("k3_english_search")
def _(spark, sf_dir):
    """Stems instead of words, stop words left out: the first two words and the last one of each asking note."""
    text = "concat_ws(' ', words[0], 'or', get(words, 1), element_at(words, -1))"
    return _lexical(spark, sf_dir, text, language="english")


@query("k5_lexical_only", f"WITH {_SOURCES.replace('qs.v IS NOT NULL', 'false')} SELECT query, source_type, id, round(fused, 9) AS fused, rank FROM h WHERE rank <= 20")
def _(spark, sf_dir):
    """The same search while no vectors can be had: it degrades to words, and does not fail."""
    asked = _queries(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<double>"))
    return _longs(_search(spark, sf_dir, asked).select("query", "source_type", "id", F.round("fused", 9).alias("fused"), "rank"), "rank")


_RERANK = f"""{_SOURCES}, c AS (SELECT h.*, src.ws, qs.asked, q.ws AS qw FROM h JOIN src USING (source_type, id) JOIN qs USING (query) JOIN src q ON q.source_type = 'note_section' AND q.id = query WHERE rank <= 50),
s AS (SELECT query, source_type, id, rank, CASE WHEN len(list_distinct(ws || qw)) > 0 THEN len(list_intersect(list_distinct(ws), list_distinct(qw))) / len(list_distinct(ws || qw)) ELSE 0 END AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, rank) AS position FROM s)"""


def _candidates(spark, sf_dir):
    """The first stage's 50 candidates of each query with a second score: overlap of their words with the query note's."""
    _search(spark, sf_dir, _queries(spark, sf_dir), 50).write.parquet(path := scratch(spark, "found"))
    found = spark.read.parquet(path)
    distinct = F.array_distinct(words_of(F.col("text")))
    few = found.select("query").distinct().count() <= SENT_QUERIES
    sent = F.broadcast if few else lambda df: df
    texts = _texts(spark, sf_dir).withColumnRenamed("source", "source_type").join(sent(found.select("source_type", "id").distinct()), ["source_type", "id"], "left_semi")
    own = sent(table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), distinct.alias("own")))
    joined = found.join(texts.select("source_type", "id", distinct.alias("words")), ["source_type", "id"]).join(own, "query")
    return joined.withColumn("score", jaccard(F.col("words"), F.col("own"))).drop("words", "own")


@query("k8_reranked", f"WITH {_RERANK} SELECT query, source_type, id, round(score, 6) AS rerank_score, true AS reranked, position FROM r WHERE position <= 10")
def _(spark, sf_dir):
    best = search.reranked(_candidates(spark, sf_dir), F.col("score"), 10)
    return best.select("query", "source_type", "id", F.round("rerank_score", 6).alias("rerank_score"), "reranked", F.col("position").cast("long").alias("position"))


@query("k8_rerank_fallback", f"WITH {_SOURCES} SELECT query, source_type, id, false AS reranked, rank AS position FROM h WHERE rank <= 10")
def _(spark, sf_dir):
    """The second stage is down: first-stage order, and a flag that says so."""
    best = search.reranked(_candidates(spark, sf_dir), None, 10)
    return best.select("query", "source_type", "id", "reranked", F.col("position").cast("long").alias("position"))


@query("v10_retrieve", f"WITH {_RERANK}, t AS (SELECT 'note_section' AS source_type, doc_id AS id, lang AS topic FROM documents UNION ALL SELECT 'utterance', conv_id * 1000 + turn, role FROM conversations) SELECT query, source_type, id, position, topic, 'label of ' || topic AS label FROM r JOIN t USING (source_type, id) WHERE position <= 10")
def _(spark, sf_dir):
    """Hybrid recall, second stage, limit, and the topic of each result by one lookup of its table."""
    best = search.reranked(_candidates(spark, sf_dir), F.col("score"), 10)
    notes = table(spark, sf_dir, "documents").select(F.lit("note_section").alias("source_type"), F.col("doc_id").alias("id"), F.col("lang").alias("topic"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("utterance").alias("source_type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("topic"))
    topics = notes.select("topic").union(turns.select("topic")).distinct().withColumn("label", F.concat(F.lit("label of "), "topic"))
    merged = api.with_topics(best, notes.unionByName(turns), topics)
    return merged.select("query", "source_type", "id", F.col("position").cast("long").alias("position"), "topic", "label")


# ---- read methods


@query("q_transcript", "WITH u AS (SELECT conv_id AS session, turn AS seq, role AS speaker, text, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN true ELSE false END AS is_relevant FROM conversations) SELECT session, seq, speaker, (SELECT count(*) FROM u WHERE speaker = 'user' AND is_relevant IS DISTINCT FROM false) AS total FROM u WHERE speaker = 'user' AND is_relevant IS DISTINCT FROM false ORDER BY session, seq LIMIT 50 OFFSET 20")
def _(spark, sf_dir):
    """A page of a transcript with its filters (rows judged irrelevant are left out, unjudged ones stay), and the total."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.col("turn") % 3 == 1).alias("is_relevant"))
    return api.transcript(rows, offset=20, limit=50, speaker="user").select("session", "seq", "speaker", "total")


@query("q_session_notes", "SELECT source AS session, doc_id AS section, left(text, 40) AS heading FROM documents WHERE source = 'src3' ORDER BY doc_id")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("lang").alias("topic"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("section"), F.left("text", F.lit(40)).alias("heading"))
    return api.session_notes(notes, "src3").select("session", "section", "heading")


@query("q_topic_notes", "SELECT lang AS topic, doc_id AS section FROM documents WHERE lang = 'de' ORDER BY source, doc_id")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("lang").alias("topic"), F.col("doc_id").alias("ordinal"), F.col("doc_id").alias("section"))
    return api.topic_notes(notes, "de").select("topic", "section")


@query("q_dashboard", "WITH s AS (SELECT o_custkey AS subject, o_orderkey AS session, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT c_custkey AS subject, c_name AS title, count(session) AS total_sessions, count(DISTINCT status) AS total_topics, coalesce(string_agg(CAST(session AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5), '') AS recent FROM customer LEFT JOIN s ON c_custkey = subject GROUP BY 1, 2")
def _(spark, sf_dir):
    """All subjects at once: counts, and the five newest sessions."""
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("title"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("topic"))
    return api.dashboard(subjects, orders.drop("topic"), orders.select("subject", "topic").distinct()).select("subject", "title", "total_sessions", "total_topics", F.array_join("recent", ",").alias("recent"))


@query("q_dashboard_compat", "WITH s AS (SELECT o_custkey AS subject, o_orderkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), n AS (SELECT subject, session, k, count(*) OVER (PARTITION BY subject) AS n FROM s WHERE k <= 50) SELECT subject, CAST(any_value(n) AS BIGINT) AS total_sessions, string_agg(CAST(session AS VARCHAR), ',' ORDER BY k) FILTER (k > n - 5) AS recent FROM n GROUP BY subject")
def _(spark, sf_dir):
    """The older behaviour under its own name: of the newest 50 sessions the five oldest, and a total that stops at 50."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("created_at"))
    return api.recent_compat(orders).select("subject", "total_sessions", F.array_join("recent", ",").alias("recent"))


@query("q_study_status", "WITH s AS (SELECT o_custkey AS subject, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS session, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1), f AS (SELECT o_custkey AS subject, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey AS subject, session, status, coalesce(n, 0) AS flashcard_count FROM customer LEFT JOIN s ON c_custkey = s.subject LEFT JOIN f ON c_custkey = f.subject")
def _(spark, sf_dir):
    """Of each subject its newest session and the number of its cards."""
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session")).join(orders.select("subject", "session"), "session")
    return api.study_status(subjects, orders, cards)


@query("q_flashcards", "SELECT l_orderkey AS subject, l_partkey AS card, l_shipdate AS due_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11 ORDER BY due_at, card")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_custkey = 11").select(F.col("o_orderkey").alias("subject"))
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("card"), F.col("l_shipdate").alias("due_at"))
    return api.flashcards(cards.join(own, "subject", "left_semi"))


@query("q_sessions_by_subject", "SELECT subject, session, k FROM (SELECT o_custkey AS subject, o_orderkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 50")
def _(spark, sf_dir):
    """The newest 50 sessions of each subject."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("created_at"))
    return api.sessions_by_subject(orders).drop("created_at")


@query("q_search", f"WITH {_SRC}, qs AS (SELECT 'en' AS scope, ['with'] AS asked), {_OCC}, lr AS (SELECT source_type, id, row_number() OVER (PARTITION BY source_type ORDER BY round({_OFTEN.format('ps')}, 9) DESC, id) AS rank FROM occ WHERE held_in = 'en'), h AS (SELECT *, row_number() OVER (ORDER BY round(1 / (60 + rank), 12) DESC, source_type, id) AS place FROM lr WHERE rank <= 50) SELECT source_type, id, rank AS lexical_rank, place AS rank FROM h WHERE place <= 20")
def _(spark, sf_dir):
    """One search of one subject by a word."""
    found = api.search(text_index(spark, sf_dir), _vectors(spark, sf_dir), spark, "with", "en")
    return _longs(found.select("source_type", "id", "lexical_rank", "rank"), "lexical_rank", "rank")


@query("q_coverage", "SELECT o_custkey AS subject, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS covered, count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_orderstatus = 'O') AS uncovered, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS pct FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """How much of each subject's syllabus is covered."""
    kind = F.col("o_orderstatus")
    return api.coverage_summary(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.when(kind == "F", "covered").when(kind == "P", "partial").otherwise("uncovered").alias("status")))


@query("q_next_card", "WITH c AS (SELECT o_custkey AS subject, l_partkey AS card, l_shipdate AS due_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT subject, card, due_at FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY due_at > TIMESTAMP '1995-06-17', due_at, card) = 1")
def _(spark, sf_dir):
    """The card that each subject should study next."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey")
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("card"), F.col("l_shipdate").alias("due_at")).join(own, "o_orderkey").drop("o_orderkey")
    return api.next_card(cards, F.lit("1995-06-17").cast("timestamp"))


@query("q_cold_start", "WITH s AS (SELECT o_custkey AS subject, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS active FROM orders GROUP BY 1) SELECT c_custkey AS subject, coalesce(active, 0) AS seed_count, CASE WHEN n IS NULL THEN 'not_seeded' WHEN active > 0 THEN 'seeded' ELSE 'stabilized' END AS status, CASE WHEN c_nationkey < 5 AND active > 0 THEN 'tight' ELSE 'normal' END AS cadence FROM customer LEFT JOIN s ON c_custkey = subject")
def _(spark, sf_dir):
    """Which subjects still stand on their seeds."""
    seeds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderstatus") == "F").alias("replaced"))
    return api.cold_start_status(seeds, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("sessions")))


@query("q_reclassified", "SELECT o_orderkey AS session, CASE WHEN l.session IS NOT NULL THEN 'syllabus' ELSE 'content' END AS final_type, CASE WHEN l.session IS NOT NULL THEN 'operator_override' ELSE 'ensemble' END AS method FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS session FROM lineitem WHERE l_quantity = 50) l ON o_orderkey = l.session")
def _(spark, sf_dir):
    """Classifications with an operator's overrides, which win and say so."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.lit("content").alias("final_type"), F.lit("ensemble").alias("method"))
    said = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("session"), F.lit("syllabus").alias("override"))
    return api.overridden(rows, said)
