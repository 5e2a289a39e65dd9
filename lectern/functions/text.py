"""Text expressions; all but ``repeats`` run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.multiset import has_repeats
from lectern.functions.prefix import ahead, let, prefixed, sum_of

# Concept kinds in order of precedence, each with the words that speak for it.
CONCEPTS = {
    "genuinely_pictorial": r"anatomy|heart|organ|geography|map of|apparatus|microscop|cell structure|skeleton|topograph",
    "tree_hierarchy": r"hierarchy|classification|taxonomy|is a subclass of",
    "state_machine": r"state transitions|transitions from|state machine",
    "math_formula": r"[=∑∫√]|\\frac|\bequation\b",
    "graph_network": r"network of|graph of|connected to|nodes and edges",
    "flowchart": r"process goes|the steps are|→|->|then|followed by",
}
# Greetings and transition cues (pattern, weight), by id.
GREETINGS = {
    "en": r"\bgood\s+(morning|afternoon|evening)\b|\bhello\b|\bwelcome\b|\bstart(?:ing)?\s+(?:the\s+)?(?:lecture|class|session|today)\b",
    "es": r"\bbuen(?:os|as)\s+(dias|tardes|noches)\b",
}
CUES = {
    "moving_on": (r"\b(moving\s+on\s+to|let'?s\s+move\s+on\s+to|now\s+we'?ll\s+(?:look\s+at|cover|discuss))\b", 0.8),
    "next_topic": (r"\b(next\s+(?:we'?ll|let'?s|I'?ll|topic\s+is)|the\s+next\s+(?:topic|subject|thing))\b", 0.75),
    "completes_section": (r"\b(that\s+completes|that\s+covers|that\s+(?:wraps\s+up|finishes)|so\s+that'?s\s+(?:the\s+)?end\s+of)\b", 0.85),
    "break_reference": (r"\b(before\s+(?:the\s+)?break|after\s+(?:the\s+)?break|let'?s\s+take\s+a\s+break)\b", 0.9),
    "today_we_cover": (r"\btoday\s+we'?ll\s+(?:be\s+)?(?:covering|looking\s+at|discussing|talking\s+about)\b", 0.7),
}
# Words whose density tells a syllabus from content, list markers, and dates.
SYLLABUS_WORDS = ("syllabus", "grading", "assessment", "schedule", "office hours", "prerequisites", "textbook", "curriculum")
LIST_MARKERS = r"(?i)\b(first(?:ly)?|second(?:ly)?|third(?:ly)?|finally)\b"
DATES = r"(?i)\b(due|deadline|by\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|\d{1,2}/\d{1,2}|week\s+\d+)\b"


def normalized(text: Column) -> Column:
    """Lower case, without punctuation."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\w\s]", ""))


def tokens(text: Column) -> Column:
    """Words of the normalized text."""
    return F.filter(F.split(normalized(text), r"\s+"), lambda w: w != "")


def token_set(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` stands in the text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def keyword_density(text: Column, words: tuple[str, ...] = SYLLABUS_WORDS) -> Column:
    """Occurrences of the words for each word of the text."""
    low = F.lower(text)
    hits = sum((occurrences(low, w) for w in words), F.lit(0))
    return hits / F.greatest(F.size(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0))), F.lit(1))


def repeats(words: Column, sizes: tuple[int, ...] = (3, 4, 5), least: int = 3) -> Column:
    """Whether some n-gram of the words stands at least ``least`` times; where one of a larger size does, one of the smallest does too."""
    return has_repeats(words, min(sizes), least)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def concept_hash(text: Column) -> Column:
    """sha256 of the text in lower case with single blanks."""
    return F.sha2(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), 256)


def balanced_math(text: Column) -> Column:
    """Whether dollar signs come in pairs."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit("$"), F.lit("")))) % 2 == 0


def display_label(label: Column, keywords: Column, fallback: str) -> Column:
    """A label, or else the joined keywords, or else ``fallback``; empty texts count as missing."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(F.array_join(keywords, ", "), F.lit("")), F.lit(fallback))


def concept_kind(text: Column) -> Column:
    """The first kind of ``CONCEPTS`` that the lower-cased text speaks for, else ``unknown``."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike(pattern), F.lit(kind)) for kind, pattern in CONCEPTS.items()), F.lit("unknown"))


def plain_text(text: Column) -> Column:
    """Text made comparable before error rates: trimmed, single blanks, no punctuation, lower case, in that order."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s\s+", " "), r"\p{P}", ""))


# Densities of syllabus words above and below which a text is of one kind.
DENSE, SPARSE = 0.02, 0.005


def _vote(syllabus: Column, content: Column, sure_syllabus: Column, sure_content: Column) -> Column:
    prediction = F.when(syllabus, "syllabus").when(content, "content").otherwise("mixed")
    return F.struct(prediction.alias("prediction"), F.when(syllabus, F.least(F.lit(1.0), sure_syllabus)).when(content, sure_content).otherwise(F.lit(0.5)).alias("confidence"))


def density_vote(text: Column, high: float = DENSE, low: float = SPARSE) -> Column:
    """Struct (prediction, confidence) by the density of syllabus words."""
    d = keyword_density(text)
    return _vote(d > high, d < low, d / high, 1 - (d / low if low else F.lit(0.0)))


def structure_score(joined: Column, short: Column) -> Column:
    """How much a session's joined text reads like a syllabus: list markers, dates, and the share of short utterances."""
    return F.regexp_count(joined, F.lit(LIST_MARKERS)) * 0.15 + F.regexp_count(joined, F.lit(DATES)) * 0.2 + short * 0.5


def structure_vote(score: Column) -> Column:
    """Struct (prediction, confidence) by the structure score."""
    return _vote(score > 0.6, score < 0.2, score, 1 - score)


def route_target(kind: Column) -> Column:
    """Where a segment goes: syllabus to db_3, all else to db_2."""
    return F.when(kind == "syllabus", "db_3").otherwise("db_2")


def routed(session_type: Column, segment_vote: Column) -> Column:
    """Struct (classification, route_target, confidence): a mixed session's segments by their own votes (mixed counts as content)."""
    own = F.when(segment_vote["prediction"] == "syllabus", "syllabus").otherwise("content")
    kind = F.when(session_type == "mixed", own).otherwise(session_type)
    return F.struct(kind.alias("classification"), route_target(kind).alias("route_target"), F.when(session_type == "mixed", segment_vote["confidence"]).otherwise(F.lit(1.0)).alias("confidence"))


def greeting(text: Column) -> Column:
    """Struct (language, phrase) of the first greeting pattern, in the order of ``GREETINGS``, that the text holds; null without one."""
    def found(language: str) -> Column:
        phrase = F.regexp_extract(text, "(?i)(" + GREETINGS[language] + ")", 1)
        return F.when(phrase != "", F.struct(F.lit(language).alias("language"), phrase.alias("phrase")))

    return F.coalesce(*(found(language) for language in GREETINGS))


def places(text: Column, pattern: str) -> Column:
    """Where a pattern matches: array<struct<start, stop>> in characters from 0, leftmost, not overlapping."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(f: Column) -> Column:
        gaps = F.transform(F.slice(f["p"], 1, F.size(f["m"])), lambda x: F.char_length(x))
        widths = F.zip_with(gaps, F.transform(f["m"], lambda x: F.char_length(x)), lambda g, w: g + w)
        known = F.struct(f["m"].alias("m"), gaps.alias("g"), prefixed(widths, sum_of, F.lit(0)).alias("w"))
        start = lambda q, i: ahead(q["w"], i, sum_of, lambda x, y: x + y) + F.element_at(q["g"], i + 1)
        return let(known, lambda q: F.transform(q["m"], lambda x, i: let(start(q, i), lambda at: F.struct(at.alias("start"), (at + F.char_length(x)).alias("stop")))))

    return let(found, lambda f: F.when(F.size(f["m"]) > 0, placed(f)).otherwise(F.array().cast("array<struct<start:int,stop:int>>")))


def steps(text: Column) -> Column:
    """The steps of ``a -> b -> c``, without what leads up to a first colon, blanks and dots; empty steps are left out."""
    plain = F.replace(text, F.lit("→"), F.lit("->"))
    chain = F.when(F.instr(plain, ":") > 0, F.substring(plain, F.instr(plain, ":") + 1, F.lit(2**31 - 1))).otherwise(plain)
    return F.filter(F.transform(F.split(chain, "->"), lambda p: F.trim(p, F.lit(" ."))), lambda p: p != "")


def node_id(label: Column) -> Column:
    """A diagram node's name: letters and digits, others as ``_``, 30 at most, ``n`` for nothing."""
    name = F.substring(F.regexp_replace(F.trim(label), "[^a-zA-Z0-9]", "_"), 1, 30)
    return F.when(name == "", F.lit("n")).otherwise(name)


def _edges(parts: Column, line) -> Column:
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: line(node_id(F.element_at(parts, i)), node_id(F.element_at(parts, i + 1))))).otherwise(F.array().cast("array<string>"))


def mermaid(parts: Column, kind: Column) -> Column:
    """A flowchart of the steps, or a state diagram for the kind ``state_machine``."""
    nodes = F.transform(parts, lambda p: F.concat(F.lit("    "), node_id(p), F.lit('["'), p, F.lit('"]')))
    arrows = _edges(parts, lambda a, b: F.concat(F.lit("    "), a, F.lit(" --> "), b))
    state = kind == "state_machine"
    return F.array_join(F.when(state, F.concat(F.array(F.lit("stateDiagram-v2")), arrows)).otherwise(F.concat(F.array(F.lit("graph TD")), nodes, arrows)), "\n")


def graphviz(parts: Column) -> Column:
    nodes = F.transform(parts, lambda p: F.concat(F.lit("  "), node_id(p), F.lit(' [label="'), p, F.lit('"];')))
    arrows = _edges(parts, lambda a, b: F.concat(F.lit("  "), a, F.lit(" -> "), b, F.lit(";")))
    return F.array_join(F.concat(F.array(F.lit("digraph G {")), nodes, arrows, F.array(F.lit("}"))), "\n")


def valid_diagram(syntax: Column) -> Column:
    """Whether a mermaid text has a known header and, beyond two lines, an edge."""
    lines = F.filter(F.split(syntax, "\n"), lambda x: F.trim(x) != "")
    header = F.trim(F.element_at(lines, 1)).rlike(r"^(graph TD|graph LR|flowchart TD|flowchart LR|stateDiagram-v2)")
    edge = F.exists(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike("->|→"))
    return F.when(F.size(lines) == 0, F.lit(False)).otherwise(header & (edge | (F.size(lines) <= 2)))


def body_checks(body: Column) -> Column:
    """Struct (mermaid_ok, math_ok, prose): fences hold something, dollar signs pair up, and the text is no mere list of sources."""
    fences = F.regexp_extract_all(body, F.lit(r"(?s)```mermaid\s*\n(.*?)```"), F.lit(1))
    return F.struct(
        F.forall(fences, lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "").alias("mermaid_ok"),
        balanced_math(F.replace(body, F.lit("$$"), F.lit(""))).alias("math_ok"),
        (~body.rlike(r"(?i)^\s*source[_ ]?utt(?:erance)?[_ ]?ids?\s*:?\s*\[.*\]\s*$")).alias("prose"),
    )


def attribution(title: Column, author: Column, licence: Column) -> Column:
    return F.concat(title, F.lit(" by "), F.coalesce(F.nullif(author, F.lit("")), F.lit("Unknown author")), F.lit(", licensed under "), F.replace(F.upper(licence), F.lit("-"), F.lit(" ")))


# Licences that may be used.
OPEN_LICENCES = ("cc0", "cc-by", "cc-by-sa", "pdm", "odc-odbl", "usgov")


def licence_gate(licence: Column) -> Column:
    """accepted, rejected or unverifiable; comes before any score."""
    return F.when(licence.isin(*OPEN_LICENCES), "accepted").when(F.coalesce(licence, F.lit("unknown")) == "unknown", "unverifiable").otherwise("rejected")


def upload_verdict(content_type: Column, size: Column, most: int = 20 << 20) -> Column:
    """image, pdf, or the status code of a refusal: 413 too large, 415 of another type."""
    return F.when(size > most, "413").when(content_type.isin("image/png", "image/jpeg", "image/webp", "image/heic"), "image").when(content_type == "application/pdf", "pdf").otherwise("415")


def is_version(name: Column) -> Column:
    """Whether a file name is ``v<major>.<minor>.<patch>.md``."""
    return name.rlike(r"^v[0-9]+\.[0-9]+\.[0-9]+\.md$")


def card_line(front: Column, back: Column, tag: Column) -> Column:
    """A flashcard as one line of tab-separated fields; tabs and line ends inside become blanks."""
    flat = lambda c: F.translate(c, "\t\n", "  ")
    return F.concat_ws("\t", flat(front), flat(back), tag)
