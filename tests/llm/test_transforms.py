"""Fill-in-the-middle, chat examples and the filter audit against plain versions, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")
from lectern.llm import chat, fim  # noqa: E402
from lectern.llm.filter_audit import filter_audit, packed_outcomes, unpack  # noqa: E402

TEXTS = [
    None, "", " ", "\t\n ", "one", " one", "one ", "  two  words \n", "größe naïve 漢字 🦉 end", "🦉🦉 🦉", "a <P> b", "<S>", "x<M", "<<P x", "S> y <", "Same text here", "Same text here", "é" * 50 + " z", "w " * 3000,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11


def plain_fim(doc_id, text, unit):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if unit == "tokens" else list(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["tokens", "chars"])
def test_fill_in_middle_equals_a_plain_version(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "an id is not here"), (3, "the same id"), (3, "the same id"), (2**40, "long id ✓ " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("other")).withColumn("output", F.lit(1))
    out = fim.fill_in_middle(docs, unit=unit)
    got = out.withColumn("back", fim.restored("output", "form")).collect()
    wanted = Counter((i, *plain_fim(i, t, unit), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == wanted
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_a_very_long_text_is_cut_whole(spark):
    text = "ä long wörd 漢 " * 300_000
    form = next(i for i in range(99) if plain_fim(i, text, "tokens")[1] == "spm")
    docs = spark.range(1).select(F.lit(form).alias("doc_id"), F.repeat(F.lit("ä long wörd 漢 "), F.lit(300_000)).alias("text"))
    row = fim.fill_in_middle(docs).select("n", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("digest"), F.sha2(fim.restored("output", "form"), 256).alias("back")).first()
    n, _, p, m, output = plain_fim(form, text, "tokens")
    assert tuple(row) == (n, p, m, sha(output), sha(text))


def test_the_exception_index_converts_both_ways():
    text = "aé漢🦉b" * 7 + "plain" * 40 + "ß"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Excess(data)
    places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.chars(places).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert len(index.at) == 22  # ASCII spans leave no trace in it


# ---- 12


def said(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("extra")).withColumn("block", F.lit("extra"))


ODD = [r"a\b", "\\", "\\\\", "<|im_end|>", r"<\|im_end|>", "<s>", r"<\\s>", "[INST]x[/INST]", "line\nline", None, "", "<<s>>", "<", "|im_sep|>", "<</SYS>>🦉", "<|im_start|>user<|im_sep|>"]


def conversations():
    rng = np.random.default_rng(5)
    rows = [(1, k, ("system", "user", "assistant")[int(rng.integers(3))], ODD[int(rng.integers(len(ODD)))]) for k in range(1200)]
    rows += [(2, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(ODD)]
    rows += [(3, 0, "user", "no reply"), (4, None, None, "null role"), (4, 5, "assistant", None), (4, 5, "assistant", "tied"), (4, 5, "assistant", "tied"), (4, -300, "user", "before")]
    return rows + [(None, 0, "user", "whose?"), (None, 1, "assistant", "nobody's"), (5, 0, "assistant", "first")]


def plain_conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(role, text) for _, _, role, text in sorted(turns)] for conv, turns in out.items()}


def test_chat_is_read_back_as_it_was(spark):
    rows = conversations()
    turns = chat.format_turns(said(spark, rows))
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    wanted = plain_conversations(rows)
    assert got.keys() == wanted.keys()
    for conv, turns_ in wanted.items():
        r = got[conv]
        assert r["turns_text"] == "".join(f"{role}\n{text}\n" for role, text in turns_)
        assert r["loss_text"] == "".join(text for role, text in turns_ if role == "assistant")
        assert (r["n_turns"], r["n_examples"]) == (len(turns_), sum(role == "assistant" for role, _ in turns_))


def test_each_reply_is_an_example_with_all_before_it(spark):
    rows = [r for r in conversations() if r[0] != 1] + [r for r in conversations() if r[0] == 1][:40]
    turns = chat.format_turns(said(spark, rows)).cache()
    whole = {r["conv_id"]: r["text"] for r in turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "formatted"))), lambda t: t["formatted"]), "").alias("text")).collect()}
    examples = defaultdict(list)
    for r in chat.prefix_targets(turns).orderBy("position").collect():
        text = whole[r["conv_id"]]
        assert text[r["context_chars"] :].startswith(r["target"] + "<|im_end|>")
        assert r["example_chars"] == r["context_chars"] + len(r["target"]) + len("<|im_end|>")
        context = text[: r["context_chars"]]
        assert context.count("<|im_start|>") == r["context_turns"] + 1 and context.endswith("<|im_start|>assistant<|im_sep|>")
        examples[r["conv_id"]].append((context, r["target"]))
    out = defaultdict(list)
    for r in chat.expanded(turns).orderBy("example").collect():
        out[r["conv_id"]].append((r["context"], r["target"]))
    assert out == examples
    marks = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "[INST]", "[/INST]", "<</SYS>>"]
    for r in turns.collect():
        inner = r["formatted"].removeprefix(marks[0]).removesuffix(marks[2]).replace(marks[1], "", 1)
        assert not any(m in inner for m in marks)


def test_chat_plans_without_python_and_empty_tables(spark):
    turns = chat.format_turns(said(spark, conversations()).limit(0))
    assert chat.read_back(turns).count() == 0 and chat.prefix_targets(turns).count() == 0 and chat.expanded(turns).count() == 0
    plan = chat.read_back(chat.format_turns(spark.range(3).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    with pytest.raises(ValueError):
        chat.Template(begin="<s", middle="s>", end="</e>")


# ---- 13


def plain_audit(rows, marks):
    """Every order applied to every document, one by one."""
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in marks:
        good[i] |= q == 1
        toxic[i] |= t == 1
    failed = []
    for i, text, part in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A"} if len(ws) < 200 else set()
        f |= {"B"} if 100 * len(set(ws)) < 50 * len(ws) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in rows) else set()
        failed.append((part or "", f, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [r for r in failed if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                redundant = sum(letter in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[1] == {letter} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[letter] += len(gone)
        for key in out:
            if key[0] == part:
                out[key] = [*out[key], shapley[key[1][key[2] - 1]]]
    return out


def test_the_audit_equals_one_by_one(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)] + ["Upper", "CAPS", "a#b", "50%"]
    texts = [" ".join(words[int(k)] for k in rng.integers(int(rng.choice([3, 60, 304])), size=int(rng.choice([0, 5, 199, 200, 400])))) for _ in range(60)]
    rows = [(int(rng.integers(90)), texts[int(rng.integers(60))], [None, "", "en", "de", "en"][int(rng.integers(5))]) for _ in range(150)]
    rows += [(i, "one text " * 3, "en") for i in range(100, 160)] + [(None, None, "en"), (None, None, "en"), (None, texts[0], None), (7, texts[0], "de"), (7, texts[0], "de")]
    marks = [(int(rng.integers(170)), *(None if rng.random() < 0.1 else int(rng.integers(2)) for _ in range(2))) for _ in range(150)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("part", F.lit("x")).withColumn("n", F.lit(1))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit(docs, labels).collect()}
    assert got == plain_audit(rows, marks)
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).where("good_lost > 0").count() == 0


def test_wide_counters_do_not_run_over():
    wide = packed_outcomes()
    most = 2**61
    total = unpack(sum(most * wide["removed"][m] for m in (1, 2)))
    assert total.reshape(120, 5).sum(axis=1).tolist() == [2 * most] * 120
    assert set(total.tolist()) == {0, most}
    for m in range(32):
        steps = [unpack(wide[o][m]).reshape(120, 5) for o in ("kept", "removed", "redundant")]
        assert (steps[1].sum(axis=1) == (m > 0)).all() and (steps[0][:, 4] == (m == 0)).all() and ((steps[1] + steps[2]).sum(axis=1) == m.bit_count()).all()


def test_the_loss_is_read_where_the_prefix_of_each_example_ends(spark):
    rows = [(1, 0, "user", "a </s> ü"), (1, 1, "assistant", "x\\y 𝄞 <s>"), (1, 2, "user", "b"), (1, 3, "assistant", "zz")]
    turns = chat.format_turns(said(spark, rows)).withColumn("target", F.regexp_replace("target", ".", "#"))
    (got,) = chat.read_back(turns).collect()
    assert got["loss_text"] == "x\\y 𝄞 <s>zz" and got["n_examples"] == 2
