"""Personal data by candidate gradient boosting, on DataFrame operations alone.

High-recall generators (patterns) propose overlapping candidate spans; boosted trees over format and
context features score them; a calibrated threshold selects what is added to the base spans, which
always stay. There are no labels of personal data, so the trees learn from made examples, true ones and look-alikes
(``pii_examples``): checks such as Luhn's are features among others. Scores are calibrated by isotonic regression on
examples that the trees have not seen, and each kind's threshold is set there. Positions come from ``split``: the pieces between a pattern's matches and the matches
themselves give each match's code-point offsets, by sums over blocks of matches. Patterns are written
without nested repetition, so that a match takes linear time and constant stack on texts of any length.
"""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.pii_examples import examples
from lectern.llm.spark import NULL_ID, materialize

#: Stand-ins of one code point for a separator inside a number, and for a dot inside a host name; their own occurrences in texts become U+FFFD.
_JOINT, _DOT = "\ue000", "\ue001"

BASE_KINDS = ("email", "ip", "card", "phone")
#: Characters of context on each side of a candidate.
CONTEXT = 24

# The base patterns, as equivalents that a backtracking matcher runs in linear time on the prepared text.
BASE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+\-{_DOT}]))[A-Za-z0-9._%+\-{_DOT}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9\-{_DOT}]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9{_JOINT}]{{2,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Candidate patterns by kind. They are wide on purpose; the trees decide. Runs have no longest length; counts stand only where a number's own form has them.
CANDIDATES = {
    "email": r"(?<![\w.%+-])[\w.%+-]++ ?(?:@|\(at\)|\[at\]| at ) ?[\w-]++ ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}+[.,:]){3}[0-9]{1,4}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ .\-/]?[0-9]{4,6}+[ .\-/]?[0-9]{4,5}+[ .\-/]?[0-9]{0,4}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[(]?[0-9]{1,4}+[)]?[ .\-/][(]?[0-9]{2,4}+[)]?[ .\-/]?[0-9]{3,4}+[ .\-/]?[0-9]{0,4}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?:api[_-]?key|apikey|secret|token|password|passwd|pwd)(?![A-Za-z0-9])\W{1,5}+[A-Za-z0-9_+/=-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
EXTRA_KINDS = tuple(CANDIDATES)

# Ends of host names that are no English words; an address in plain words must end in one.
ENDS = "com|org|net|edu|gov|mil|int|info|biz|dev|xyz|de|fr|uk|nl|es|pl|ch|se|dk|fi|cz|ru|jp|cn|kr|br|ca|au|nz|eu|io|ai"

#: Examples that are made (six in ten fit the trees, the others calibrate them), and the share of false ones at which a kind's threshold is set.
FIT_ROWS, FALSE_SHARE = 12_000, 0.02
TREES, DEPTH = 20, 4
#: Steps of the calibration's grid; threshold of a kind whose scores leave none.
GRID, NEVER = 200, 2.0

# Words near a span that speak for each kind.
CUES = {
    "email": r"(?i)e-?mail|contact|write|mailto|reach",
    "ip": r"(?i)\bip\b|host|server|address|login",
    "card": r"(?i)card|visa|credit|payment|amex",
    "phone": r"(?i)tel|phone|call|fax|mobile|whatsapp",
    "secret": r"(?i)key|secret|token|password|auth",
    "iban": r"(?i)iban|bank|account|bic",
    "ssn": r"(?i)ssn|social|security",
}
FEATURES = ("digits", "letters", "length", "separators", "groups", "plus", "cue", "luhn", "octets", "before_solid", "after_solid", "distinct", "valid", "cue_next", "signs", "plain_name", "number_beside", *(f"is_{k}" for k in EXTRA_KINDS))


def prepared(text: Column) -> Column:
    """The text with joints for single separators between digits and dots between host characters; same code points."""
    free = F.translate(text, _JOINT + _DOT, "\ufffd\ufffd")
    return F.regexp_replace(free, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)


def jointed(text: Column) -> Column:
    free = F.translate(text, _JOINT + _DOT, "\ufffd\ufffd")
    return F.regexp_replace(free, r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array that holds it alone."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefixed(values: Column, total, none: Column):
    """A struct (v, k, before) from which ``_before`` gives ``total`` over the values ahead of a place.

    ``before`` holds the totals ahead of each block of k values, k the root of their number, so that all places together
    take n * sqrt(n) steps and nothing grows by appending.
    """
    blocks = lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(b["v"]) - 1) / b["k"]).cast("int"), F.lit(0))), lambda j: total(F.slice(b["v"], j * b["k"] + 1, b["k"])))
    ahead = lambda t: F.transform(t, lambda _, j: F.when(j > 0, total(F.slice(t, 1, j))).otherwise(none))
    sized = F.struct(values.alias("v"), F.ceil(F.sqrt(F.greatest(F.size(values), F.lit(1)))).cast("int").alias("k"))
    return _let(sized, lambda b: F.struct(b["v"].alias("v"), b["k"].alias("k"), _let(blocks(b), ahead).alias("before")))


def _before(p: Column, i: Column, total, join) -> Column:
    """The total over the first i values of ``_prefixed``."""
    j = F.floor(i / p["k"]).cast("int")
    rest = i - j * p["k"]
    return F.when(rest > 0, join(F.element_at(p["before"], j + 1), total(F.slice(p["v"], j * p["k"] + 1, rest)))).otherwise(F.element_at(p["before"], j + 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


_MATCHES = "array<struct<start:int,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, context: int = CONTEXT) -> Column:
    """All matches of a pattern as array<struct<start, match, before, after>>: leftmost, not overlapping, code points from 0.

    ``before`` and ``after`` are up to ``context`` code points beside a match, no further than the match beside it reaches.
    """

    def placed(b: Column) -> Column:
        gaps = F.transform(F.slice(b["p"], 1, F.size(b["m"])), lambda x: F.char_length(x))
        widths = F.zip_with(gaps, F.transform(b["m"], lambda x: F.char_length(x)), lambda g, w: g + w)
        known = F.struct(b["m"].alias("m"), b["p"].alias("p"), gaps.alias("g"), _prefixed(widths, _sum, F.lit(0)).alias("w"))
        start = lambda q, i: _before(q["w"], i, _sum, lambda x, y: x + y) + F.element_at(q["g"], i + 1)
        beside = lambda q, i: F.coalesce(F.get(q["m"], i), F.lit(""))
        left = lambda q, i: F.right(F.concat(F.when(i > 0, beside(q, i - 1)).otherwise(""), F.get(q["p"], i)), F.lit(context))
        right = lambda q, i: F.left(F.concat(F.get(q["p"], i + 1), beside(q, i + 1)), F.lit(context))
        return _let(known, lambda q: F.transform(q["m"], lambda x, i: F.struct(start(q, i).alias("start"), x.alias("match"), left(q, i).alias("before"), right(q, i).alias("after"))))

    empty = F.array().cast(_MATCHES)
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return _let(whole, lambda b: F.when(F.size(b["m"]) > 0, placed(b)).otherwise(empty))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    """An IBAN's remainder: its first four characters go last, letters count from 10; 1 is valid."""
    body = F.regexp_replace(match, "[^A-Z0-9]", "")
    each = F.filter(F.split(F.concat(F.substring(body, 5, 2**31 - 1), F.substring(body, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c >= "A", a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97)


def _octets(match: Column, separators: str = r"[.,:]") -> Column:
    """Whether all parts of a dotted number are at most 255."""
    return F.forall(F.split(match, separators), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _valid(kind: str, m: Column) -> Column:
    digits = digits_of(m["match"])
    n = F.char_length(digits)
    if kind == "ip":
        return _octets(m["match"], r"\.")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind as array<struct<start, stop>>."""
    place = {"email": prepared, "card": jointed}.get(kind, lambda t: t)(text)
    # a cheap look for what every match holds comes first
    able = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}[kind]
    spans = F.transform(
        F.filter(matches(place, BASE[kind]), lambda m: _valid(kind, m)),
        lambda m: F.struct(m["start"].cast("long").alias("start"), (m["start"] + F.char_length(m["match"])).cast("long").alias("stop")),
    )
    return F.when(able, spans).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _candidates(text: Column) -> Column:
    """All candidates as array<struct<kind, start, stop, match, before, after>>."""
    able = {"email": r"@|\bat\b", "secret": "(?i)key|secret|token|passw|pwd"}

    def of(kind: str) -> Column:
        found = matches(text, CANDIDATES[kind] if kind != "secret" else "(?i)" + CANDIDATES[kind])
        if kind in ("card", "phone"):  # a separator at the end is no part of the number
            found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["match"], r"[ .\-/]+$", "").alias("match"), m["before"].alias("before"), F.left(F.concat(F.regexp_extract(m["match"], r"[ .\-/]*$", 0), m["after"]), F.lit(CONTEXT)).alias("after")))
        shape = F.transform(
            found,
            lambda m: F.struct(
                F.lit(kind).alias("kind"),
                m["start"].cast("long").alias("start"),
                (m["start"] + F.char_length(m["match"])).cast("long").alias("stop"),
                m["match"].alias("match"),
                m["before"].alias("before"),
                m["after"].alias("after"),
            ),
        )
        return F.when(text.rlike(able.get(kind, "[0-9]" if kind == "ip" else "[0-9]{2}")), shape).otherwise(F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,match:string,before:string,after:string>>"))

    return F.concat(*(of(kind) for kind in EXTRA_KINDS))


def _features(c: DataFrame) -> DataFrame:
    """Format and context features of candidates; none of them asks whether a base span is there."""
    match, kind = F.col("match"), F.col("kind")
    digits = digits_of(match)
    n = F.char_length(digits)
    around = F.concat("before", F.lit(" "), "after")
    cue = functools.reduce(lambda a, k: F.when(kind == k, around.rlike(CUES[k])).otherwise(a), CUES, F.lit(False))
    size = F.char_length(match)
    values = {
        "digits": n,
        "letters": F.char_length(F.regexp_replace(match, "[^A-Za-z]", "")),
        "length": size,
        "separators": F.char_length(F.regexp_replace(match, "[^ .\\-/(),:]", "")),
        "groups": F.size(F.split(match, "[^0-9A-Za-z]+")),
        "plus": match.startswith("+"),
        "cue": cue,
        "luhn": F.when(n > 0, luhn(digits)).otherwise(False),
        "octets": F.when(kind == "ip", _octets(match)).otherwise(False),
        "before_solid": F.col("before").rlike(r"[A-Za-z0-9]$"),
        "after_solid": F.col("after").rlike(r"^[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(match, ""))),
    }
    next_to = functools.reduce(lambda a, k: F.when(kind == k, F.col("before").rlike(f"(?i)(?:{CUES[k].removeprefix('(?i)')})\\W{{1,4}}$")).otherwise(a), CUES, F.lit(False))
    values |= {
        "cue_next": next_to,
        "number_beside": F.col("before").rlike(r"[0-9][ .\-/]?$") | F.col("after").rlike(r"^[ .\-/]?[0-9]"),
        "signs": match.rlike(r"@|\(at\)|\[at\]"),
        "plain_name": match.rlike(r"^[A-Za-z]+(?: |@|\(|\[)"),
    }
    values |= {f"is_{k}": kind == k for k in EXTRA_KINDS}
    some = [name for name in FEATURES if name != "valid"]
    c = c.select("*", *(F.coalesce(values[name].cast("double"), F.lit(0.0)).alias(name) for name in some))
    return c.withColumn("valid", F.coalesce(_checks(kind).cast("double"), F.lit(0.0)))


def _address(match: Column) -> Column:
    """Whether a match has the shape of an address once its at and dot are signs; in plain words both must be spelled and the end known."""
    signs = F.regexp_replace(F.regexp_replace(F.lower(match), r" ?(?:\(at\)|\[at\]|@) ?", "@"), r" ?(?:\(dot\)|\[dot\]) ?", ".")
    worded = F.regexp_replace(F.regexp_replace(signs, " at ", "@"), " dot ", ".")
    shape = r"^\w[\w.%+-]*@[a-z0-9][a-z0-9-]*\."
    return F.when(signs.contains("@"), F.regexp_replace(signs, " dot ", ".").rlike(shape + r"[a-z]{2,24}$")).otherwise(signs.contains(" dot ") & worded.rlike(shape + f"(?:{ENDS})$"))


def _number_of_phone(match: Column, n: Column) -> Column:
    """Whether a match of n digits is a phone number: by its prefix, brackets, the shape 3-3-4 or a word near it; dates and decimals are none."""
    shape = match.rlike(r"^(?:\+|00[1-9]|0[1-9]|\([0-9]{2,4}\))") | match.rlike(r"^(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}$") | (F.col("cue") == 1)
    other = match.rlike(r"^[0-9]+\.[0-9]+$|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|^(?:19|20)[0-9]{2}[./-][01][0-9](?![0-9])")
    joined = F.col("before").rlike(r"(?:[A-Za-z0-9_$]|[0-9][.,])$") | F.col("after").rlike("^[A-Za-z0-9_]")
    return (n >= 9) & (n <= 15) & shape & ~other & ~joined


def _checks(kind: Column) -> Column:
    """Whether a candidate's own match passes its kind's checks: a feature, not a verdict."""
    match = F.col("match")
    digits = digits_of(match)
    n = F.char_length(digits)
    between = F.regexp_replace(match, "[0-9]", "")
    value = F.regexp_extract(match, r"\W([A-Za-z0-9_+/=-]+)$", 1)
    secret = (F.char_length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    own = {
        "email": _address(match),
        "ip": _octets(match) & ((between == "...") | (between.isin(",,,", ":::") & (F.col("cue") == 1))),
        "card": (n >= 13) & (n <= 19) & (F.col("luhn") == 1) & ~digits.rlike("^0+$"),
        "phone": _number_of_phone(match, n),
        "secret": secret,
        "iban": mod97(match) == 1,
        "ssn": ~match.rlike("^(000|666|9)|-00-|-0000$"),
    }
    return functools.reduce(lambda a, k: F.when(kind == k, own[k]).otherwise(a), own, F.lit(False))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, text_key, base, spans) for each input row: arrays of (kind, start, stop), code points, stop exclusive.

    ``base`` holds the base spans in the order of ``BASE_KINDS``; ``spans`` adds the accepted candidates that
    overlap no base span or better candidate. Accepted are those whose calibrated chance reaches their kind's threshold:
    the trees are fitted on ``fit_rows`` made examples, which are the same in every run, and the threshold of a kind is the smallest chance, of 0.5 at
    least, above which at most ``false_share`` of its held-out examples are false.

    Candidates of equal chance are taken by their start. A null text is empty and has no spans; texts of any length are
    searched whole, in time near linear in them; rows that repeat or share an id are each searched; a null id stays null;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = F.concat(*(_of_kind(k, base_spans(F.col("text"), k)) for k in BASE_KINDS))
    found = rows.select("doc_id", F.xxhash64("text").alias("text_key"), base.alias("base"), _candidates(F.col("text")).alias("candidates"), F.monotonically_increasing_id().alias("uid"))
    found = materialize(found, "pii")
    some = found.where(F.size("candidates") > 0)
    some = _beside_base(some.select("uid", "text_key", F.explode("candidates").alias("c")).select("uid", "text_key", "c.*"), some.select("uid", F.explode("base").alias("s")).select("uid", "s.start", "s.stop"))
    judged = judge(docs.sparkSession, fit_rows, false_share).judged(_features(some.where("NOT on_any")))
    kept = _apart(judged.where("accepted").withColumn("rank", -F.col("chance")).select("uid", "rank", "start", "stop", "kind"))
    added = kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    joined = found.select("doc_id", "text_key", "base", "uid").join(added, "uid", "left")
    everything = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")))
    kinds = F.array(*(F.lit(k) for k in dict.fromkeys((*BASE_KINDS, *EXTRA_KINDS))))
    order = F.array_sort(F.transform(everything, lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("at"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return joined.select("doc_id", "text_key", "base", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def _beside_base(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates with ``on_any``: whether a base span of their text overlaps them.

    One ordered pass of each text: of the spans that begin before a candidate's end, the furthest end is carried on.
    """
    marks = base.select("uid", F.col("start").alias("at"), F.lit(1).alias("is_base"), F.col("stop").alias("reach"))
    both = candidates.withColumns({"at": F.col("stop"), "is_base": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    carried = F.max("reach").over(Window.partitionBy("uid").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("on_any", F.coalesce(carried > F.col("start"), F.lit(False))).where("is_base = 0").drop("at", "is_base", "reach")


def _apart(chosen: DataFrame) -> DataFrame:
    """Of overlapping candidates of one text the better ones (smaller rank, then earlier start): (uid, kind, start, stop).

    Candidates are first parted into runs that touch, so the choice, which looks at all better ones, stays within a run.
    """
    own = Window.partitionBy("uid").orderBy("start", "stop", "kind")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = chosen.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.size("some") == 1
    runs = runs.groupBy("uid", "run").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "stop", "kind"))).alias("some"))
    none = F.array().cast("array<struct<rank:double,start:bigint,stop:bigint,kind:string>>")
    clear = F.aggregate("some", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["stop"]) & (y["stop"] > x["start"])), acc).otherwise(F.concat(acc, F.array(x))))
    return runs.select("uid", F.explode(F.when(alone, F.col("some")).otherwise(clear)).alias("s")).select("uid", "s.kind", "s.start", "s.stop")


@dataclass(frozen=True)
class Judge:
    """Fitted trees, each kind's calibrated chances over a grid of scores, and its threshold."""

    trees: GBTClassificationModel | None
    chances: dict[str, list[float]]
    least: dict[str, float]

    def scored(self, candidates: DataFrame) -> DataFrame:
        """Candidates with features, and the calibrated ``chance`` that each is personal data."""
        if self.trees is None:
            return candidates.withColumn("chance", F.lit(0.0))
        scored = self.trees.transform(_VECTOR().transform(candidates)).withColumn("score", vector_to_array("probability")[1])
        place = F.floor(F.col("score") * GRID).cast("int")
        of = lambda k: F.get(F.array(*(F.lit(x) for x in self.chances[k])), place)
        chance = functools.reduce(lambda a, k: F.when(F.col("kind") == k, of(k)).otherwise(a), self.chances, F.lit(0.0))
        return scored.withColumn("chance", chance).drop("features", "rawPrediction", "probability", "prediction")

    def judged(self, candidates: DataFrame) -> DataFrame:
        """Scored candidates with ``accepted``."""
        bound = functools.reduce(lambda a, k: F.when(F.col("kind") == k, self.least[k]).otherwise(a), self.least, F.lit(NEVER))
        return self.scored(candidates).withColumn("accepted", F.col("chance") >= bound)


def _VECTOR() -> VectorAssembler:  # noqa: N802
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def labelled_candidates(spark: SparkSession, n: int) -> DataFrame:
    """Candidates of n made examples with features, ``label`` (1 for the planted span of a true example, whole) and ``held_out``."""
    made = examples(spark, n, mod97).select("row", F.col("kind").alias("planted"), F.col("start").alias("from_"), F.col("stop").alias("to_"), "is_true", F.explode(_candidates(F.col("text"))).alias("c"))
    own = F.col("is_true") & (F.col("kind") == F.col("planted")) & (F.col("start") == F.col("from_")) & (F.col("stop") == F.col("to_"))
    return _features(made.select("*", "c.*")).select("row", "kind", own.cast("double").alias("label"), (F.pmod(F.xxhash64("row", F.lit("part")), F.lit(10)) >= 6).alias("held_out"), *FEATURES)


_JUDGES: dict[tuple, Judge] = {}


def judge(spark: SparkSession, n: int = FIT_ROWS, false_share: float = FALSE_SHARE) -> Judge:
    """The judge of n made examples; as it depends on nothing else, it is fitted once in a session."""
    key = (spark.sparkContext.applicationId, n, false_share)
    if key not in _JUDGES:
        _JUDGES[key] = _fitted(spark, n, false_share)
    return _JUDGES[key]


def _fitted(spark: SparkSession, n: int, false_share: float) -> Judge:
    """Trees fitted on six tenths of n made examples, calibrated on the others; on one partition, so that nothing depends on the cluster."""
    made = materialize(labelled_candidates(spark, n).coalesce(1), "pii-examples").coalesce(1).sortWithinPartitions("row", "kind")
    fit = made.where("NOT held_out")
    if fit.select("label").distinct().count() < 2:
        return Judge(None, {}, {})
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(_VECTOR().transform(fit).select("label", "features"))
    held = trees.transform(_VECTOR().transform(made.where("held_out"))).select("kind", "label", vector_to_array("probability")[1].alias("score"))
    held = materialize(held, "pii-held-out")
    chances = {k: _calibrated(held.where(F.col("kind") == k)) for k in EXTRA_KINDS}
    known = Judge(trees, chances, {})
    place = F.floor(F.col("score") * GRID).cast("int")
    counts = held.groupBy("kind", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("label")).alias("bad")).collect()  # a row for each kind and step
    return Judge(trees, chances, {k: _threshold([(known.chances[k][r["place"]], r["n"], r["bad"]) for r in counts if r["kind"] == k], false_share) for k in EXTRA_KINDS})


def _calibrated(held: DataFrame) -> list[float]:
    """Isotonic chances at the steps of the grid, between the fitted points by their distance; none where nothing was held out."""
    if held.isEmpty():
        return [0.0] * (GRID + 1)
    fitted = IsotonicRegression(featuresCol="score", labelCol="label").fit(held)
    x, y = list(fitted.boundaries), list(fitted.predictions)

    def at(v: float) -> float:
        j = bisect.bisect_right(x, v)
        if j == 0 or j == len(x):
            return y[0] if j == 0 else y[-1]
        return y[j - 1] + (y[j] - y[j - 1]) * (v - x[j - 1]) / (x[j] - x[j - 1])

    return [float(at((k + 0.5) / GRID)) for k in range(GRID + 1)]


def _threshold(steps: list[tuple[float, int, float]], false_share: float) -> float:
    """Of (chance, examples, false ones) the smallest chance, of 0.5 at least, above which at most ``false_share`` are false."""
    least, n, bad = NEVER, 0, 0.0
    by: dict[float, list[float]] = {}
    for chance, many, wrong in steps:
        own = by.setdefault(chance, [0, 0.0])
        own[0], own[1] = own[0] + many, own[1] + wrong
    for chance in sorted(by, reverse=True):
        n, bad = n + by[chance][0], bad + by[chance][1]
        if chance >= 0.5 and bad <= false_share * n:
            least = chance
    return least


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, with each span of personal data in the text replaced by ``<KIND>``.

    Rows are matched to their spans by id and a hash of the text; a null text stays null, an empty one empty, a text of
    any length is cut in time near linear in it; rows that repeat are each cut; an empty table gives an empty result.
    """
    from lectern.llm.spark import free_name

    found = find_pii(docs, id_col, text_col, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    key_id, key_text, spans = (free_name(docs, n) for n in ("key_id", "key_text", "spans"))
    found = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(key_id), F.col("text_key").alias(key_text), F.col("spans").alias(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias(key_id), F.xxhash64(text).alias(key_text))
    joined = keyed.join(found, [key_id, key_text], "left")
    clean = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col(spans)))
    return joined.select(*(clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


#: Code points of a block of text that spans are cut out of by themselves.
_BLOCK = 2048


def _without(text: Column, spans: Column) -> Column:
    """The text with ``<KIND>`` for each span; of spans that overlap, what is left of the later one.

    Spans are cut block by block, so a span costs its block and not the text before it.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    most = lambda values: F.array_max(values)

    def disjoint(o: Column) -> Column:
        stops = _prefixed(F.transform(o, lambda s: s["stop"]), most, F.lit(0).cast("long"))
        reach = lambda p, i: F.greatest(_before(p, i, most, lambda x, y: F.greatest(x, y)), F.lit(0))
        cuts = _let(stops, lambda p: F.transform(o, lambda s, i: F.struct(F.greatest(s["start"], reach(p, i)).alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.filter(cuts, lambda c: c["stop"] > c["start"])

    def block(cuts: Column, piece: Column, j: Column) -> Column:
        low, size = j.cast("long") * _BLOCK, F.char_length(piece)
        own = F.filter(cuts, lambda c: (c["start"] < low + size) & (c["stop"] > low))

        def step(acc: Column, c: Column) -> Column:
            begin, end = F.greatest(c["start"] - low, F.lit(0)).cast("int"), F.least(c["stop"] - low, size).cast("int")
            mark = F.when(c["start"] >= low, F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise("")
            return F.struct(end.alias("at"), F.concat(acc["out"], F.substring(piece, acc["at"] + 1, begin - acc["at"]), mark).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(own, begin, step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(_BLOCK))))

    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))
    cut = _let(ordered, disjoint)
    return _let(cut, lambda c: F.array_join(F.transform(pieces, lambda piece, j: block(c, piece, j)), ""))
