"""Labelled examples of personal data and of look-alikes, made by DataFrame functions from row numbers alone.

Each row is a text of invented words with one planted span: of a kind, in one of its forms, true or false. True
ones are valid numbers in usual, odd and obfuscated forms; false ones fail a check, or are dates, decimals, part
numbers and plain words of the same shape. Half of all rows have a word near that speaks for the kind, false ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words near examples by kind, ends of hosts, names of secrets.
NEAR = {
    "email": ("email", "e-mail", "mailto", "write to"),
    "ip": ("ip", "host", "server", "login from"),
    "card": ("card", "visa", "credit card", "payment"),
    "phone": ("phone", "tel", "call", "fax"),
    "secret": ("auth", "login", "config", "env"),
    "iban": ("iban", "bank", "account", "bic"),
    "ssn": ("ssn", "social security", "security number", "social"),
}
_ENDS = ("com", "org", "net", "de", "fr", "io")
_SECRETS = ("api_key", "apikey", "token", "password", "secret", "pwd", "api-key")
_SYLLABLES = ("ta", "ren", "mo", "lis", "ka", "dor", "ven", "si", "pul", "an", "gre", "to")
_PLAIN = ("look", "me", "us", "meet", "arrive", "stay", "back", "stop")


def _draw(salt: str, most: int) -> Column:
    return F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.lit(most))


def _one_of(values: tuple[str, ...], salt: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (_draw(salt, len(values)) + 1).cast("int"))


def _word(salt: str) -> Column:
    return F.concat(*(_one_of(_SYLLABLES, f"{salt}{k}") for k in range(2)))


def _digits(n: int, salt: str, least: int = 0) -> Column:
    """n digits, the first of ``least`` at least."""
    first = (F.lit(least) + _draw(f"{salt}first", 10 - least)).cast("string")
    return F.concat(first, F.lpad(_draw(salt, 10 ** (n - 1)).cast("string"), n - 1, "0")) if n > 1 else first


def _mixed(salt: str) -> Column:
    """8 to 40 hex digits with a letter and a digit among them."""
    return F.concat(F.lit("a"), F.substring(F.md5(F.concat(F.col("row").cast("string"), F.lit(salt))), 1, 6), F.lit("7"), F.left(F.sha1(F.col("row").cast("string")), (_draw(f"{salt}n", 33)).cast("int")))


def _grouped(digits: Column, sizes: tuple[int, ...], salt: str, separators: tuple[str, ...] = (" ", "-", ".", "/", "")) -> Column:
    at, parts = 1, []
    for n in sizes:
        parts.append(F.substring(digits, at, n))
        at += n
    return F.replace(F.concat_ws("|", *parts), F.lit("|"), _one_of(separators, salt))


def _checked(body: Column, off: Column) -> Column:
    """Digits with their Luhn digit, moved on by ``off``."""
    each = F.filter(F.split(F.reverse(body), ""), lambda d: d != "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10 + off) % 10).cast("string"))


def forms(mod97) -> list[tuple[str, bool, bool | None, Column]]:
    """(kind, true, whether a word near speaks for it or None for either, span) of each form."""
    w, d = _word, _digits
    wrong = (1 + _draw("wrong", 8)).cast("int")
    end = _one_of(_ENDS, "end")
    host = F.when(_draw("host", 2) == 0, w("h")).otherwise(F.concat(w("h"), d(2, "hd")))
    local = F.concat(w("l"), _one_of((".", "_", "", "-"), "ls"), d(2, "ld"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    four = lambda least, separator: F.array_join(F.array(*((F.lit(least) + _draw(f"o{k}", 256 - least)).cast("string") for k in range(4))), separator)
    over = say(d(1, "v1", 1), ".", d(3, "v2", 3), ".", d(3, "v3", 3), ".", d(1, "v4"))
    amex = lambda off: _grouped(_checked(say("37", d(12, "ax")), off), (4, 6, 5), "as")
    visa = lambda off: _grouped(_checked(say(_one_of(("4", "5", "6"), "c0"), d(14, "cx")), off), (4, 4, 4, 4), "cs")
    bank = say(_one_of(("DE", "FR", "ES", "NL", "CH"), "cc"), "00", d(15, "b1"), d(3, "b2"))
    check = lambda off: F.lpad((1 + (97 - mod97(bank) + off) % 97).cast("string"), 2, "0")
    account = lambda off: _grouped(say(F.left(bank, F.lit(2)), check(off), F.substring(bank, 5, 99)), (4, 4, 4, 4, 4, 2), "bs", (" ", ""))
    key, equal = _one_of(_SECRETS, "key"), _one_of((": ", "=", " = ", ':"', ' = "'), "eq")
    area = F.lpad((1 + _draw("area", 665)).cast("string"), 3, "0")
    us = lambda s: say(d(3, "u1", 2), s, d(3, "u2", 2), s, d(4, "u3"))
    return [
        ("email", True, None, say(local, "@", host, ".", end)),
        ("email", True, None, say(local, " (at) ", host, " (dot) ", end)),
        ("email", True, None, say(w("l"), " [at] ", host, " [dot] ", end)),
        ("email", True, None, say(local, " at ", host, " dot ", end)),
        ("email", True, None, say(w("l"), d(1, "l1"), "@", host, " dot ", end)),
        ("email", False, None, say(_one_of(_PLAIN, "p"), " at ", w("h"), " dot ", end)),
        ("email", False, None, say(w("l"), " at ", w("h"), " dot ", end)),
        ("email", False, None, say(_one_of(_PLAIN, "p"), " at ", host, ".", _one_of(("The", "Then", "And", "In"), "t"))),
        ("email", False, None, say(w("l"), " at ", host, ". ", _one_of(("The", "Then", "And", "In"), "t"))),
        ("ip", True, None, four(1, ".")),
        ("ip", True, True, four(1, ",")),
        ("ip", True, True, four(1, ":")),
        ("ip", False, False, four(10, ",")),
        ("ip", False, False, four(10, ":")),
        ("ip", False, None, over),
        ("ip", False, None, say(d(1, "v1", 1), ".", d(1, "v2"), ".", d(1, "v3"), ".", d(4, "v4", 1))),
        ("card", True, None, visa(F.lit(0))),
        ("card", True, None, amex(F.lit(0))),
        ("card", False, None, visa(wrong)),
        ("card", False, None, amex(wrong)),
        ("card", False, None, say(d(4, "n1", 1), " ", d(4, "n2"), " ", d(4, "n3"))),
        ("phone", True, None, say("(", d(3, "u1", 2), ") ", d(3, "u2", 2), "-", d(4, "u3"))),
        ("phone", True, None, us("-")),
        ("phone", True, None, us(".")),
        ("phone", True, None, say("0", d(2, "g1", 1), " ", d(4, "g2"), " ", d(3, "g3"))),
        ("phone", True, None, say("00", d(2, "g1", 1), " ", d(3, "g2"), " ", d(4, "g3"))),
        ("phone", True, True, say(d(3, "g1", 1), " ", d(3, "g2"), " ", d(4, "g3"))),
        ("phone", False, None, say(d(2, "y1"), ".", F.lpad((1 + _draw("y2", 12)).cast("string"), 2, "0"), ".20", d(2, "y3"), " ", d(3, "y4", 1))),
        ("phone", False, None, say("20", d(2, "y3"), "-", F.lpad((1 + _draw("y2", 12)).cast("string"), 2, "0"), "-", d(2, "y1"), " ", d(3, "y4"))),
        ("phone", False, None, say(d(3, "f1", 1), ".", d(4, "f2"), d(3, "f3"))),
        ("phone", False, False, say(d(3, "k1", 1), " ", d(3, "k2", 1))),
        ("phone", False, False, say(d(4, "k1", 1), "-", d(3, "k2"), "-", d(4, "k3"))),
        ("phone", False, None, say("97", d(1, "i0", 8), "-", d(1, "i1"), "-", d(2, "i2"), "-", d(6, "i3"), "-", d(1, "i4"))),
        ("secret", True, None, say(key, equal, _mixed("m"))),
        ("secret", True, None, say(key, equal, F.initcap(w("s1")), w("s2"), d(2, "s3"), F.upper(w("s4")))),
        ("secret", False, None, say(key, ": ", w("s1"), w("s2"), w("s3"))),
        ("secret", False, None, say(key, " ", w("s1"), w("s2"), w("s3"))),
        ("secret", False, None, say(key, " = ", w("s1"), w("s2"), "-", w("s3"))),
        ("iban", True, None, account(F.lit(0))),
        ("iban", False, None, account(wrong)),
        ("iban", False, None, say(F.upper(F.left(w("s1"), F.lit(2))), d(2, "n1"), " ", F.upper(F.left(w("s2"), F.lit(4))), " ", d(4, "n2"), " ", F.upper(F.left(F.concat(w("s3"), w("s4")), F.lit(4))), " ", d(4, "n3"))),
        ("ssn", True, None, say(area, "-", d(1, "q1", 1), d(1, "q2"), "-", d(3, "q3"), d(1, "q4", 1))),
        ("ssn", False, None, say(_one_of(("000", "666", "900", "987", "999"), "q0"), "-", d(2, "q1"), "-", d(4, "q3"))),
        ("ssn", False, None, say(area, "-00-", d(4, "q3"))),
        ("ssn", False, None, say(area, "-", d(2, "q1", 1), "-0000")),
    ]


def examples(spark: SparkSession, n: int, mod97) -> DataFrame:
    """(row, text, kind, start, stop, is_true) of n examples; the same for each call."""
    every = forms(mod97)
    shape = F.pmod(F.col("row"), F.lit(len(every)))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (shape + 1).cast("int"))
    span = F.lit("")
    for k, (*_, value) in enumerate(every):
        span = F.when(shape == k, value).otherwise(span)
    kind = pick([k for k, *_ in every])
    wants = pick([{None: 2, True: 1, False: 0}[c] for _, _, c, _ in every])
    cue = F.lit("")
    for k, words in NEAR.items():
        cue = F.when(kind == k, _one_of(words, "cue")).otherwise(cue)
    said = F.when(wants == 2, _draw("said", 2)).otherwise(wants) == 1
    lead = F.concat(_word("w1"), F.lit(" "), _word("w2"), F.lit(" "), F.when(said, F.concat(cue, _one_of((" ", ": ", " is "), "gap"))).otherwise(F.concat(_word("w3"), F.lit(" "))))
    tail = F.concat(_one_of((" ", ", ", "; ", " - "), "tail"), _word("w4"), F.lit(" "), _word("w5"), F.lit("."))
    rows = spark.range(n).select(F.col("id").alias("row")).select("row", kind.alias("kind"), pick([t for _, t, *_ in every]).alias("is_true"), lead.alias("lead"), span.alias("span"), tail.alias("tail"))
    start = F.char_length("lead").cast("long")
    return rows.select("row", F.concat("lead", "span", "tail").alias("text"), "kind", start.alias("start"), (start + F.char_length("span")).alias("stop"), "is_true")
