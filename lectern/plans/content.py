"""Classification, parsing, diagrams, signals, error rates and study of a course's contents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import memory, scalar, syllabus, text
from lectern.operators import metrics as M
from lectern.operators import sequence, study
from lectern.plans.registry import query
from lectern.sources.tables import embedded, table, utterances

_PLAIN = "lower(regexp_replace(regexp_replace(trim({0}), '\\s\\s+', ' ', 'g'), '\\p{{P}}', '', 'g'))"


@query("f2_plain_text", f"SELECT conv_id, turn, {_PLAIN.format('text')} AS plain FROM conversations")
def _(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_text(F.col("text")).alias("plain"))


_KW = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in text.SYLLABUS_WORDS)
_NOTE = "(CASE doc_id % 5 WHEN 0 THEN 'the syllabus and grading, ' WHEN 1 THEN 'a schedule; ' ELSE '' END || coalesce(text, ''))"


def _notes(spark, sf_dir):
    head = F.when(F.col("doc_id") % 5 == 0, "the syllabus and grading, ").when(F.col("doc_id") % 5 == 1, "a schedule; ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


_DENSITY = f"WITH x AS (SELECT doc_id, lower({_NOTE}) AS t FROM documents), d AS (SELECT doc_id, ({_KW}) / greatest(len(regexp_extract_all(t, '[a-z0-9_]+')), 1) AS d FROM x)"


@query("f6_density_vote", f"{_DENSITY} SELECT doc_id, CASE WHEN d > 0.02 THEN 'syllabus' WHEN d < 0.005 THEN 'content' ELSE 'mixed' END AS prediction, round(CASE WHEN d > 0.02 THEN least(1.0, d / 0.02) WHEN d < 0.005 THEN 1 - d / 0.005 ELSE 0.5 END, 6) AS confidence FROM d")
def _(spark, sf_dir):
    vote = _notes(spark, sf_dir).select("doc_id", text.density_vote(F.col("text")).alias("v"))
    return vote.select("doc_id", "v.prediction", F.round("v.confidence", 6).alias("confidence"))


@query("f8_routed_segments", f"{_DENSITY}, v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'syllabus' ELSE 'content' END AS kind, CASE WHEN d > 0.02 THEN 'syllabus' ELSE 'content' END AS own, CASE WHEN d > 0.02 THEN least(1.0, d / 0.02) WHEN d < 0.005 THEN 1 - d / 0.005 ELSE 0.5 END AS c FROM d), r AS (SELECT doc_id, CASE WHEN kind = 'mixed' THEN own ELSE kind END AS classification, CASE WHEN kind = 'mixed' THEN c ELSE 1.0 END AS c FROM v) SELECT doc_id, classification, CASE WHEN classification = 'syllabus' THEN 'db_3' ELSE 'db_2' END AS route_target, round(c, 6) AS confidence FROM r")
def _(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "mixed").when(F.col("doc_id") % 3 == 1, "syllabus").otherwise("content")
    found = _notes(spark, sf_dir).select("doc_id", text.routed(kind, text.density_vote(F.col("text"))).alias("r"))
    return found.select("doc_id", "r.classification", "r.route_target", F.round("r.confidence", 6).alias("confidence"))


_SAID = "(CASE turn % 4 WHEN 0 THEN 'First, hand it in by Friday. ' WHEN 1 THEN 'Week 3 is due on 4/12; finally ' ELSE '' END || text)"
_STRUCT = f"""WITH u AS (SELECT conv_id, turn, {_SAID} AS t FROM conversations), j AS (SELECT conv_id AS session, string_agg(t, ' ' ORDER BY turn) AS joined, avg(CASE WHEN len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) < 8 THEN 1.0 ELSE 0.0 END) AS short FROM u GROUP BY 1),
s AS (SELECT session, len(regexp_extract_all(joined, '{text.LIST_MARKERS}')) * 0.15 + len(regexp_extract_all(joined, '{text.DATES}')) * 0.2 + short * 0.5 AS s FROM j)"""


@query("f7_structure_vote", f"{_STRUCT} SELECT session, round(s, 6) AS score, CASE WHEN s > 0.6 THEN 'syllabus' WHEN s < 0.2 THEN 'content' ELSE 'mixed' END AS prediction, round(CASE WHEN s > 0.6 THEN least(1.0, s) WHEN s < 0.2 THEN 1 - s ELSE 0.5 END, 6) AS confidence FROM s")
def _(spark, sf_dir):
    """List markers, dates and short utterances of each session."""
    head = F.when(F.col("seq") % 4 == 0, "First, hand it in by Friday. ").when(F.col("seq") % 4 == 1, "Week 3 is due on 4/12; finally ").otherwise("")
    said = utterances(spark, sf_dir).select("session", "seq", F.concat(head, "text").alias("t"))
    short = F.size(F.filter(F.split(F.trim("t"), r"\s+"), lambda w: w != "")) < 8
    whole = said.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), " ").alias("joined"), F.avg(short.cast("double")).alias("short"))
    scored = whole.select("session", text.structure_score(F.col("joined"), F.col("short")).alias("s"))
    return scored.select("session", F.round("s", 6).alias("score"), text.structure_vote(F.col("s")).alias("v")).select("session", "score", "v.prediction", F.round("v.confidence", 6).alias("confidence"))


_LINE = "CASE p_size % 7 WHEN 0 THEN 'Module ' || (p_partkey % 9) || ': ' || p_name WHEN 1 THEN (1 + p_partkey % 4) || '.' || (p_partkey % 3) || ' ' || p_name WHEN 2 THEN 'Quiz 2: ' || p_name || ' (weight ' || (p_partkey % 40) || '%)' WHEN 3 THEN 'Week ' || (p_partkey % 14) || ' - ' || p_name WHEN 4 THEN 'References: ' || p_type WHEN 5 THEN 'exam ' || p_name ELSE 'welcome to ' || p_name END"


def _lines(spark, sf_dir):
    key, name = F.col("p_partkey"), F.col("p_name")
    s = lambda c: c.cast("string")
    kinds = [
        F.concat(F.lit("Module "), s(key % 9), F.lit(": "), name), F.concat(s(1 + key % 4), F.lit("."), s(key % 3), F.lit(" "), name), F.concat(F.lit("Quiz 2: "), name, F.lit(" (weight "), s(key % 40), F.lit("%)")),
        F.concat(F.lit("Week "), s(key % 14), F.lit(" - "), name), F.concat(F.lit("References: "), F.col("p_type")), F.concat(F.lit("exam "), name), F.concat(F.lit("welcome to "), name),
    ]
    line = F.coalesce(*(F.when(F.col("p_size") % 7 == k, x) for k, x in enumerate(kinds)))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("syllabus"), key.alias("at"), line.alias("line"))


_ITEMS = f"""WITH l AS (SELECT p_brand AS syllabus, p_partkey AS pos, p_size % 7 AS k, {_LINE} AS line, p_name, p_type, p_partkey FROM part),
m AS (SELECT *, count(*) FILTER (k = 0) OVER w - 1 AS module FROM l WHERE k < 6 WINDOW w AS (PARTITION BY syllabus ORDER BY pos)),
p AS (SELECT *, CASE WHEN k = 1 THEN CASE WHEN p_partkey % 4 BETWEEN 0 AND module THEN p_partkey % 4 ELSE module END END AS parent FROM m),
i AS (SELECT *, k <> 4 AND NOT (k = 1 AND parent < 0) AS own FROM p),
n AS (SELECT *, count(*) FILTER (own) OVER w - 1 AS item, count(*) FILTER (k IN (2, 5)) OVER w - 1 AS na, count(*) FILTER (k = 3) OVER w - 1 AS ns, CASE WHEN k = 1 AND own THEN row_number() OVER (PARTITION BY syllabus, k, own, parent ORDER BY pos) - 1 END AS nt FROM i WINDOW w AS (PARTITION BY syllabus ORDER BY pos)),
r AS (SELECT syllabus, item, string_agg(p_type, '|' ORDER BY pos) AS refs FROM n WHERE k = 4 AND item >= 0 GROUP BY 1, 2), f AS (SELECT syllabus, string_agg(p_name, '; ' ORDER BY pos) AS d FROM n WHERE k = 1 AND NOT own GROUP BY 1), lm AS (SELECT syllabus, max(item) AS item FROM n WHERE k = 0 GROUP BY 1)"""


@query("f9_syllabus_items", f"{_ITEMS} SELECT n.syllabus, n.item, CASE k WHEN 0 THEN 'module' WHEN 1 THEN 'topic' WHEN 3 THEN 'schedule' ELSE 'assessment' END AS item_type, CASE k WHEN 0 THEN module WHEN 1 THEN nt WHEN 3 THEN ns ELSE na END AS ordinal, parent AS parent_ordinal, CASE k WHEN 2 THEN 'Quiz: ' || p_name WHEN 5 THEN 'Exam: ' || p_name ELSE p_name END AS title, CASE WHEN k = 2 THEN CAST(p_partkey % 40 AS DOUBLE) END AS weight_pct, CASE WHEN k = 3 THEN p_partkey % 14 END AS week_number, coalesce(refs, '') AS refs, CASE WHEN lm.item IS NOT NULL THEN f.d END AS description FROM n LEFT JOIN r ON n.syllabus = r.syllabus AND n.item = r.item LEFT JOIN lm ON n.syllabus = lm.syllabus AND n.item = lm.item AND k = 0 LEFT JOIN f ON n.syllabus = f.syllabus WHERE own")
def _(spark, sf_dir):
    """Lines of each brand's parts as a syllabus: modules, topics, assessments, schedule, references."""
    found = syllabus.parsed_lines(_lines(spark, sf_dir), "syllabus", "at")
    return found.withColumn("refs", F.array_join("references", "|")).drop("references").withColumn("parent_ordinal", F.col("parent_ordinal").cast("long")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("f10_extraction_grade", f"{_ITEMS}, c AS (SELECT l.syllabus, count(*) AS n_lines, (SELECT count(*) FROM n WHERE n.syllabus = l.syllabus AND own) AS n_items FROM l GROUP BY l.syllabus), g AS (SELECT syllabus, CASE WHEN n_items = 0 THEN 0.0 ELSE round(0.4 + 0.6 * n_items / n_lines, 2) END AS c FROM c) SELECT syllabus, c AS confidence, CASE WHEN c >= 0.85 THEN 1 WHEN c >= 0.65 THEN 2 WHEN c >= 0.4 THEN 3 WHEN c > 0 THEN 4 ELSE 5 END AS grade FROM g")
def _(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    items = syllabus.parsed_lines(lines, "syllabus", "at").groupBy("syllabus").agg(F.count(F.lit(1)).alias("n_items"))
    both = lines.groupBy("syllabus").agg(F.count(F.lit(1)).alias("n_lines")).join(items, "syllabus", "left")
    sure = syllabus.extraction_confidence(F.col("n_lines"), F.coalesce("n_items", F.lit(0)))
    return both.select("syllabus", sure.alias("confidence"), syllabus.authority_grade(sure).alias("grade"))


_STEPS = "p AS (SELECT user_id, list(event_type || ' ' || n ORDER BY event_type) AS s, count(*) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)"
_ID = "lambda x: regexp_replace(x, '[^a-zA-Z0-9]', '_', 'g')[1:30]"


def _processes(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.concat_ws(" ", "event_type", "n")))
    told = counts.groupBy("user_id").agg(F.concat(F.lit("The process goes: "), F.array_join(listed, " -> "), F.lit(".")).alias("source"))
    return told.select("user_id", text.steps(F.col("source")).alias("steps"), F.when(F.col("user_id") % 2 == 0, "state_machine").otherwise("flowchart").alias("kind"))


@query("f12_diagrams", f"WITH {_STEPS}, n AS (SELECT user_id, s, list_transform(s, {_ID}) AS ids FROM p) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'stateDiagram-v2' ELSE 'graph TD' || list_reduce(list_transform(range(1, len(s) + 1), lambda i: chr(10) || '    ' || ids[i] || '[\"' || s[i] || '\"]'), lambda a, b: a || b) END || coalesce(list_reduce(list_transform(range(1, len(s)), lambda i: chr(10) || '    ' || ids[i] || ' --> ' || ids[i + 1]), lambda a, b: a || b), '') AS mermaid, 'digraph G {{' || list_reduce(list_transform(range(1, len(s) + 1), lambda i: chr(10) || '  ' || ids[i] || ' [label=\"' || s[i] || '\"];'), lambda a, b: a || b) || coalesce(list_reduce(list_transform(range(1, len(s)), lambda i: chr(10) || '  ' || ids[i] || ' -> ' || ids[i + 1] || ';'), lambda a, b: a || b), '') || chr(10) || '}}' AS graphviz, true AS valid FROM n")
def _(spark, sf_dir):
    """A chain of steps as a flowchart or state diagram, and as a graph."""
    drawn = _processes(spark, sf_dir).select("user_id", text.mermaid(F.col("steps"), F.col("kind")).alias("mermaid"), text.graphviz(F.col("steps")).alias("graphviz"))
    return drawn.withColumn("valid", text.valid_diagram(F.col("mermaid")))


_BODY = "(CASE WHEN doc_id % 7 = 0 THEN 'Source utt_ids: [1, 2]' ELSE coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```mermaid' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'graph TD' ELSE '  ' END || '```' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' $x$ $$y' ELSE '' END END)"


@query("f13_body_checks", f"WITH b AS (SELECT doc_id, {_BODY} AS b FROM documents) SELECT doc_id, doc_id % 7 = 0 OR doc_id % 3 <> 0 OR doc_id % 2 = 0 AS mermaid_ok, (length(replace(b, '$$', '')) - length(replace(replace(b, '$$', ''), '$', ''))) % 2 = 0 AS math_ok, doc_id % 7 <> 0 AS prose FROM b")
def _(spark, sf_dir):
    key = F.col("doc_id")
    fence = F.when(key % 3 == 0, F.concat(F.lit("\n```mermaid\n"), F.when(key % 2 == 0, "graph TD").otherwise("  "), F.lit("```"))).otherwise("")
    body = F.when(key % 7 == 0, "Source utt_ids: [1, 2]").otherwise(F.concat(F.coalesce("text", F.lit("")), fence, F.when(key % 5 == 0, " $x$ $$y").otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.body_checks(body).alias("c")).select("doc_id", "c.*")


@query("f4_greetings", f"""WITH g AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Good morning, ' WHEN 1 THEN 'Buenas tardes: ' ELSE '' END || text AS t FROM conversations), x AS (SELECT *, regexp_extract(t, '(?i)({text.GREETINGS["en"]})', 1) AS en, regexp_extract(t, '(?i)({text.GREETINGS["es"]})', 1) AS es FROM g) SELECT conv_id, turn, CASE WHEN en <> '' THEN 'en' ELSE 'es' END AS language, CASE WHEN en <> '' THEN en ELSE es END AS phrase FROM x WHERE en <> '' OR es <> ''""")
def _(spark, sf_dir):
    head = F.when(F.col("turn") % 4 == 0, "Good morning, ").when(F.col("turn") % 4 == 1, "Buenas tardes: ").otherwise("")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.greeting(F.concat(head, "text")).alias("g")).where("g IS NOT NULL")
    return found.select("conv_id", "turn", "g.language", "g.phrase")


@query("f5_cue_positions", "WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, 'moving_on' AS cue, CAST(k.s + n AS INT) AS start, CAST(k.s + n + 12 AS INT) AS stop FROM c, (SELECT unnest([1, 15]) AS s) k")
def _(spark, sf_dir):
    """Where cues stand in a text, in characters; the cue is put in twice, so that there are some."""
    cue = " moving on to;"
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(cue + cue)).alias("t"))
    found = said.select("conv_id", "turn", F.explode(text.places(F.col("t"), "(?i)" + text.CUES["moving_on"][0])).alias("p"))
    return found.select("conv_id", "turn", F.lit("moving_on").alias("cue"), "p.start", "p.stop")


@query("f23_signal", """WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT vec_id, k, sum(v[n + 1] * cos(2 * pi() * k * n / len(v))) AS re, sum(v[n + 1] * sin(2 * pi() * k * n / len(v))) AS im FROM s, unnest(range(0, 33)) AS a(k), unnest(range(0, 64)) AS b(n) GROUP BY 1, 2),
p AS (SELECT vec_id, re * re + im * im AS p, row_number() OVER (PARTITION BY vec_id ORDER BY re * re + im * im DESC) AS rank FROM f), q AS (SELECT vec_id, max(p) AS signal, median(p) FILTER (rank > 1) AS noise FROM p GROUP BY vec_id)
SELECT s.vec_id, round(10 * log10(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 4) AS rms_db, round(len(list_filter(v, lambda x: abs(x) >= 0.999)) / len(v), 6) AS clipping, round(10 * log10(greatest(signal, 1e-12) / greatest(noise, 1e-12)) - 15, 4) AS snr_db FROM s JOIN q USING (vec_id)""")
def _(spark, sf_dir):
    """Loudness, clipping and signal to noise of vectors taken as samples; the spectra of a batch are one transform for each length."""

    @F.pandas_udf("double")
    def snr(samples: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=samples.index)
        for _, own in samples.groupby(samples.map(len)):
            out[own.index] = M.snr_db(np.stack(own.to_list()).astype(float))
        return out

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalar.rms_db(v), 4).alias("rms_db"), F.round(scalar.clipping_rate(v), 6).alias("clipping"), F.round(snr(v), 4).alias("snr_db"))


_DEC = "d AS (SELECT user_id, event_id % 10 AS seq, value > 50 AS r, value / 100 AS c, event_id FROM events)"


def _payloads(spark, sf_dir):
    """Each user's decisions as the JSON text that a model would send."""
    rows = table(spark, sf_dir, "events")
    item = F.struct("event_id", F.struct((F.col("event_id") % 10).alias("seq"), (F.col("value") > 50).alias("is_relevant"), (F.col("value") / 100).alias("confidence")).alias("d"))
    listed = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return listed.select("user_id", F.to_json(F.transform("x", lambda x: x["d"])).alias("payload"), F.array_distinct(F.transform("x", lambda x: x["d"]["seq"])).alias("expected"))


@query("f25_strict_decisions", f"WITH {_DEC} SELECT user_id, bool_and(c <= 1) AS valid, CASE WHEN bool_and(c <= 1) THEN count(*) END AS n FROM d GROUP BY user_id")
def _(spark, sf_dir):
    found = _payloads(spark, sf_dir).select("user_id", study.strict_decisions(F.col("payload"), F.col("expected")).alias("d"))
    return found.select("user_id", F.col("d").isNotNull().alias("valid"), F.when(F.col("d").isNotNull(), F.size("d")).cast("long").alias("n"))


@query("f26_lenient_decisions", f"WITH {_DEC}, f AS (SELECT user_id, seq, arg_min(r, event_id) AS r, arg_min(c, event_id) AS c FROM d WHERE c <= 1 GROUP BY 1, 2) SELECT user_id, seq, r AS is_relevant, round(c, 6) AS confidence FROM f")
def _(spark, sf_dir):
    found = _payloads(spark, sf_dir).select("user_id", F.explode(study.lenient_decisions(F.col("payload"), F.col("expected"))).alias("d"))
    return found.select("user_id", "d.seq", "d.is_relevant", F.round("d.confidence", 6).alias("confidence"))


_W = memory.WEIGHTS
_FACTOR = 0.9 ** (-1 / _W[20]) - 1
_FSRS = f"""c AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1 + value / 10 END AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1.0 + user_id % 10 END AS d, event_id % 30 AS t, 1 + event_id % 4 AS g FROM events),
r AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE pow(1 + {_FACTOR!r} * t / s, {-_W[20]!r}) END AS r FROM c),
n AS (SELECT *, CASE WHEN s IS NULL THEN [{', '.join(map(repr, _W[:4]))}][g] ELSE greatest(0.001, CASE WHEN t < 1 THEN s * CASE WHEN g >= 3 THEN greatest(1.0, exp({_W[17]!r} * (g - 3 + {_W[18]!r})) * pow(s, {-_W[19]!r})) ELSE exp({_W[17]!r} * (g - 3 + {_W[18]!r})) * pow(s, {-_W[19]!r}) END
  WHEN g = 1 THEN least({_W[11]!r} * pow(d, {-_W[12]!r}) * (pow(s + 1, {_W[13]!r}) - 1) * exp((1 - r) * {_W[14]!r}), s / exp({_W[17] * _W[18]!r}))
  ELSE s * (1 + exp({_W[8]!r}) * (11 - d) * pow(s, {-_W[9]!r}) * (exp((1 - r) * {_W[10]!r}) - 1) * CASE WHEN g = 2 THEN {_W[15]!r} ELSE 1 END * CASE WHEN g = 4 THEN {_W[16]!r} ELSE 1 END) END) END AS s2,
  least(10.0, greatest(1.0, CASE WHEN s IS NULL THEN {_W[4]!r} - exp({_W[5]!r} * (g - 1)) + 1 ELSE {_W[7]!r} * ({_W[4]!r} - exp({_W[5]!r} * 3) + 1) + {1 - _W[7]!r} * (d + (10 - d) * ({-_W[6]!r} * (g - 3)) / 9) END)) AS d2 FROM r)"""


@query("f34_card_reviews", f"WITH {_FSRS} SELECT event_id, round(s2, 6) AS stability, round(d2, 6) AS difficulty, round(r, 6) AS recall, CAST(least(36500, greatest(1, round(s2 / {_FACTOR!r} * {0.9 ** (-1 / _W[20]) - 1!r}))) AS BIGINT) AS interval_days FROM n")
def _(spark, sf_dir):
    """One review of each card: memory state, recall, and days until it is due; every seventh card is new."""
    new = F.col("event_id") % 7 == 0
    state = lambda x: F.when(~new, x)
    cards = table(spark, sf_dir, "events").select("event_id", state(1 + F.col("value") / 10).alias("s"), state(1.0 + F.col("user_id") % 10).alias("d"), (F.col("event_id") % 30).alias("t"), (1 + F.col("event_id") % 4).alias("g"))
    found = cards.select("event_id", memory.reviewed(F.col("s"), F.col("d"), F.col("t"), F.col("g")).alias("m"))
    return found.select("event_id", F.round("m.stability", 6).alias("stability"), F.round("m.difficulty", 6).alias("difficulty"), F.round("m.recall", 6).alias("recall"), "m.interval_days")


@query("w7_overall_quality", "WITH q AS (SELECT event_id, value / 2 AS snr, (user_id % 10) / 100.0 AS clip FROM events) SELECT event_id, round(0.7 * least(greatest((snr - 10) / 20, 0.0), 1.0) + 0.3 * (1 - least(clip / 0.1, 1.0)), 6) AS overall FROM q")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.overall_quality(F.col("value") / 2, (F.col("user_id") % 10) / 100.0, digits=6).alias("overall"))


@query("a37_agreement", "WITH p AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 500 END AS a FROM events) SELECT user_id, round(avg(a), 6) AS mean, round(min(a), 6) AS least FROM p GROUP BY user_id")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value") / 500).alias("a"))
    return study.agreement_summary(rows, "user_id", "a").withColumns({c: F.round(c, 6) for c in ("mean", "least")})


@query("a40_passed_cases", "WITH c AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, lower(props) LIKE '%1%' AS has FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (has AND k >= 10) AS passed, round(count(*) FILTER (has AND k >= 10) / count(*), 6) AS pass_rate FROM c GROUP BY event_type")
def _(spark, sf_dir):
    """Golden cases: the output's text contains something, and a field of it is large enough."""
    rows = table(spark, sf_dir, "events")
    field = F.get_json_object("props", "$.k").try_cast("long")
    return study.passed_cases(rows, "event_type", {"contains": F.lower("props").contains("1"), "field": field >= 10}).withColumn("pass_rate", F.round("pass_rate", 6))


@query("a43_text_resolved", "WITH x AS (SELECT lang, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT lang, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in text.CONCEPTS.items()) + " ELSE 'unknown' END AS k FROM x) SELECT lang, count(*) AS total, count(*) FILTER (k NOT IN ('genuinely_pictorial', 'unknown')) AS resolved, round(count(*) FILTER (k NOT IN ('genuinely_pictorial', 'unknown')) / count(*), 6) AS ratio FROM c GROUP BY lang")
def _(spark, sf_dir):
    """Share of the concepts that a text diagram can show."""
    kinds = table(spark, sf_dir, "documents").select("lang", text.concept_kind(F.coalesce("text", F.lit(""))).alias("k"))
    shown = F.count_if(~F.col("k").isin("genuinely_pictorial", "unknown"))
    return kinds.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), shown.alias("resolved"), F.round(shown / F.count(F.lit(1)), 6).alias("ratio"))


@query("a44_speech_ratio", "SELECT l_orderkey AS chunk, round(least(1.0, sum(CAST(l_quantity AS BIGINT)) / 200), 6) AS ratio FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    region = F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.col("l_quantity").cast("bigint").alias("end_ms"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_list(region).alias("regions"))
    return rows.select("chunk", F.round(scalar.speech_ratio(F.col("regions"), F.lit(200)), 6).alias("ratio"))


@query("a24_empty_is_perfect", "SELECT lang, count(*) FILTER (q = 1 AND t = 1) AS tp, round(CASE WHEN count(*) FILTER (t = 1) = 0 THEN 1.0 ELSE count(*) FILTER (q = 1 AND t = 1) / count(*) FILTER (t = 1) END, 6) AS precision, round(CASE WHEN count(*) FILTER (q = 1) = 0 THEN 1.0 ELSE count(*) FILTER (q = 1 AND t = 1) / count(*) FILTER (q = 1) END, 6) AS recall FROM (SELECT lang, quality AS q, CASE WHEN lang = 'en' THEN toxic ELSE 0 END AS t FROM labels JOIN documents USING (doc_id)) GROUP BY lang")
def _(spark, sf_dir):
    """Precision and recall by language where nothing guessed, or nothing true, counts as perfect."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    guess = F.when(F.col("lang") == "en", F.col("toxic")).otherwise(0) == 1
    found = M.confusion(joined, F.col("quality") == 1, guess, 1.0, "lang")
    return found.select("lang", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# edits of two lists of words, row by row: a cell is the least of what comes from above and of steps to the right
_PAIRS = f"WITH p AS (SELECT conv_id AS session, turn AS seq, {_PLAIN.format('text')} AS a, lead({_PLAIN.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)"
_WER = f"""WITH RECURSIVE p AS (SELECT conv_id AS session, turn AS seq, list_filter(regexp_split_to_array({_PLAIN.format('text')}, '\\s+'), lambda x: x <> '') AS a, lead(list_filter(regexp_split_to_array({_PLAIN.format('text')}, '\\s+'), lambda x: x <> '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
q AS (SELECT * FROM p WHERE b IS NOT NULL), f AS (SELECT session, seq, a, b, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(j AS BIGINT)) AS line FROM q
UNION ALL SELECT session, seq, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda m: least(line[m] + 1, CASE WHEN m > 1 THEN line[m - 1] + CASE WHEN a[i + 1] = b[m - 1] THEN 0 ELSE 1 END ELSE line[m] + 1 END) - m)) + j) FROM f WHERE i < len(a)),
e AS (SELECT session, seq, len(a) AS n, line[len(b) + 1] AS edits FROM f WHERE i = len(a))"""


def _spoken_pairs(spark, sf_dir, ahead=1):
    plain = text.plain_text(F.col("text"))
    rows = utterances(spark, sf_dir).withColumn("said", plain).withColumn("next", F.lead("said", ahead).over(sequence.ordered("session"))).where("next IS NOT NULL")
    return M.error_rates(rows.select("session", "seq", "speaker", "said", "next"), "said", "next")


@query("a30_error_rates", f"{_WER} SELECT session, CAST(sum(edits) AS BIGINT) AS word_edits, CAST(sum(n) AS BIGINT) AS n_words, round(CASE WHEN sum(n) > 0 THEN sum(edits) / sum(n) WHEN sum(edits) > 0 THEN 1 ELSE 0 END, 6) AS wer FROM e GROUP BY session")
def _(spark, sf_dir):
    """Each utterance against the next one of its session, both made plain: edits over words, summed by session."""
    found = _spoken_pairs(spark, sf_dir).groupBy("session").agg(F.sum("word_edits").alias("word_edits"), F.sum("n_words").alias("n_words"))
    return found.withColumn("wer", F.round(M.rate(F.col("word_edits"), F.col("n_words")), 6))


@query("a30_character_errors", f"{_PAIRS} SELECT session, CAST(sum(levenshtein(translate(a, 'óéñèíüçêäöß', 'ABCDEFGHIJK'), translate(b, 'óéñèíüçêäöß', 'ABCDEFGHIJK'))) AS BIGINT) AS char_edits, CAST(sum(length(a)) AS BIGINT) AS n_chars FROM p WHERE b IS NOT NULL GROUP BY session")
def _(spark, sf_dir):
    return _spoken_pairs(spark, sf_dir).groupBy("session").agg(F.sum("char_edits").alias("char_edits"), F.sum("n_chars").alias("n_chars"))


_RATES = "SELECT session, seq, CASE WHEN n > 0 THEN edits / n WHEN edits > 0 THEN 1 ELSE 0 END AS rate FROM e"
_WER2 = _WER.replace(") OVER (PARTITION BY conv_id ORDER BY turn) AS b", ", 2) OVER (PARTITION BY conv_id ORDER BY turn) AS b")


@query("a31_rates_by_condition", f"SELECT u.role AS condition, count(*) AS n, round(avg(x.rate), 6) AS baseline, round(avg(y.rate), 6) AS adapted, avg(y.rate) < avg(x.rate) AS improved FROM ({_WER} {_RATES}) x JOIN ({_WER2} {_RATES}) y USING (session, seq) JOIN conversations u ON u.conv_id = x.session AND u.turn = x.seq GROUP BY 1")
def _(spark, sf_dir):
    """Error rates averaged over utterances, by speaker, of two guesses at each: the turn after it and the one after that."""
    rate, keys = M.rate(F.col("word_edits"), F.col("n_words")), ["session", "seq"]
    first = _spoken_pairs(spark, sf_dir).select(*keys, F.col("speaker").alias("condition"), rate.alias("baseline"))
    second = _spoken_pairs(spark, sf_dir, 2).select(*keys, rate.alias("adapted"))
    return M.by_condition(first.join(second, keys)).withColumns({c: F.round(c, 6) for c in ("baseline", "adapted")})


@query("a20_purity_gate", "WITH n AS (SELECT vec_id % 3 AS run, vec_id // 50 AS c, label, count(*) AS n FROM embeddings GROUP BY 1, 2, 3), b AS (SELECT run, c, max(n) AS best, sum(n) AS n FROM n GROUP BY 1, 2), p AS (SELECT run, sum(best) / sum(n) AS purity FROM b GROUP BY run) SELECT round(max(purity), 6) AS best, max(purity) > 0.6 AS passed FROM p")
def _(spark, sf_dir):
    """Of several runs the best purity, against a gate of 0.6."""
    runs = embedded(spark, sf_dir).withColumn("run", F.col("seq") % 3)
    return M.purity_gate(runs, "run", "session", "topic").withColumn("best", F.round("best", 6))
