"""Plain versions of what SQL can't express, very long texts, clashing names, and the pipeline stage by stage."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")
import public_tokenizers  # noqa: E402

from lectern.llm import license_scan as L  # noqa: E402
from lectern.llm import pii, quality, shards, toxicity  # noqa: E402
from lectern.llm.decontaminate import contamination  # noqa: E402
from lectern.llm.embedding_dedup import Coded, embedding_dedup, tile_links  # noqa: E402
from lectern.llm.minhash import minhash_dedup, near_duplicates  # noqa: E402
from lectern.llm.packing import pack, pack_lengths  # noqa: E402
from lectern.llm.substring_dedup import substring_dedup  # noqa: E402
from lectern.llm.textstats import structure  # noqa: E402
from lectern.llm.words import text_buffers  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---- 2: the tree against a plain one


def plain_tree(units, n_shards):
    """Shards of (weight, places, tie) units by sorting: exact weighted medians along the widest dimension."""
    out = {}

    def cut(some, first, leaves):
        if leaves == 1 or not some:
            for u in some:
                out[u] = first
            return
        d = max(range(3), key=lambda i: max(u[1][i] for u in some) - min(u[1][i] for u in some))
        some = sorted(some, key=lambda u: (u[1][d], u[2]))
        want = sum(u[0] for u in some) * (leaves // 2) / leaves
        upto = list(itertools.accumulate((u[0] for u in some), initial=0))
        k = next(i for i in range(1, len(upto)) if upto[i] >= want)
        if want - upto[k - 1] <= upto[k] - want:
            k -= 1
        cut(some[:k], first, leaves // 2)
        cut(some[k:], first + leaves // 2, leaves - leaves // 2)

    cut(units, 0, n_shards)
    return out


@pytest.mark.parametrize("n_shards", [2, 5, 8])
def test_shards_equal_a_plain_tree(spark, n_shards):
    rng = np.random.default_rng(n_shards)
    rows = [(i, f"t{rng.integers(70)} " * int(rng.integers(1, 30)), "abc"[rng.integers(3)], f"s{rng.integers(4)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r["shard"] for r in shards.kd_tree_shards(docs, n_shards=n_shards, slack=10.0, tolerance=0.0).collect()}
    dealt = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"), "lang", "source", F.lit(0).alias("uid"))
    units = {r["text_hash"]: (r["weight"], (r["d0"], r["d1"], r["d2"]), r["tie"]) for r in shards._units(dealt, shards._places(dealt), 1e9).collect()}
    tree = plain_tree(list(units.values()), n_shards)
    assert out == {r["doc_id"]: tree[units[r["text_hash"]]] for r in dealt.collect()}


def test_equal_texts_share_a_shard_and_heavy_ones_find_room(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"w{i} " * int(rng.integers(1, 60))) for i in range(300)] + [(1000 + i, "copy of one text " * 4) for i in range(90)] + [(2000 + i, "another " * 300) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"most_nodes": 2}):
        out = shards.kd_tree_shards(docs, n_shards=6, **options).toPandas()
        assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
        total = out.groupby("shard")["size"].sum()
        assert len(total) == 6 and total.max() < 1.15 * total.mean()
    over = shards.kd_tree_shards(spark.range(80).select(F.col("id").alias("doc_id"), F.lit("the same").alias("text")), n_shards=4).toPandas()
    assert over.groupby("shard").size().tolist() == [20] * 4  # no shard could hold this group: it is cut row by row


# ---- 3: literals of added tokens, and the bins


def test_literals_of_added_tokens_are_those_tokens(spark):
    from tokenizers import Tokenizer

    from lectern.llm.tokens import Encoder

    whole, encode, rng = Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER), np.random.default_rng(0)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a", "The", " word", "é", " 12", "...", "\t", "'s", "<", "endoftext", "—", "x" * 30, "\r\n", "你好"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(3000)]
    ids, upto = encode(*text_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
    out = pack(spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string"), TOKENIZER, with_ids=True).first()
    assert out["ids"][1] == 50256 and out["ids"][-1] == 0 and out["length"] == 4


def test_packing_is_near_the_least_number_of_sequences(spark):
    rng = np.random.default_rng(4)
    best = lambda size, cap: next(n for n in itertools.count(-(-sum(size) // cap)) if fits(sorted(size, reverse=True), [cap] * n))

    def fits(size, room):
        if not size:
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= size[0] and r not in tried:
                tried.add(r)
                if fits(size[1:], [*room[:i], r - size[0], *room[i + 1 :]]):
                    return True
        return False

    for _ in range(40):
        size = rng.integers(1, 10, 9)
        home, _ = pack_lengths(size, 12)
        assert len(set(home.tolist())) == best(size.tolist(), 12)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 60, 400))], "doc_id long, text string")
    apart, together = (pack(docs, TOKENIZER, capacity=64, group=g).select("sequence_id").distinct().count() for g in (50, 8192))
    assert apart <= together * 1.05  # groups of 50 meet again in later rounds


# ---- 4: codes in doubt


def test_pairs_at_the_threshold_are_settled_in_doubles(spark):
    rng = np.random.default_rng(8)
    u = rng.normal(size=(40, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    edge = float(np.sort((u @ u.T)[np.triu_indices(40, 1)])[-30])  # a threshold that some pair has exactly
    found, doubt = set(), set()
    for i, j, x, y in tile_links(Coded.of(u), Coded.of(u), edge, True):
        found |= set(zip(i.tolist(), j.tolist()))
        doubt |= set(zip(x.tolist(), y.tolist()))
    exact = {(i, j) for i in range(40) for j in range(i + 1, 40) if float(u[i] @ u[j]) >= edge}
    assert found <= exact and exact - found <= doubt and 1 <= len(doubt) <= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    assert embedding_dedup(df, threshold=edge, tile=8).agg(F.sum("n_links")).first()[0] in {2 * len(exact), 2 * len(exact) - 2}  # scaling may move the very last bit


# ---- 5 and 10: scores from their definitions


def test_machine_scores_equal_the_explicit_double_sum():
    rng = np.random.default_rng(3)
    texts = pa.array(["some words here some", "", "other words! 12 34", "x " * 50])
    counted = quality.word_counts(texts)
    machine = quality.fit_machine(*counted, np.array([1.0, 0, 1, 0]), epochs=3)
    machine.factors = rng.normal(size=machine.factors.shape)
    f = quality.assemble(*counted, machine.edges)
    for row, score in enumerate(machine.scores(f)):
        j, x = f.j[f.first[row] : f.first[row + 1]], f.x[f.first[row] : f.first[row + 1]]
        z = machine.bias + sum(machine.linear[a] * v for a, v in zip(j, x))
        z += sum(float(machine.factors[j[p]] @ machine.factors[j[q]]) * x[p] * x[q] for p in range(len(j)) for q in range(p))
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def test_lexicon_weights_equal_plain_counts(spark):
    rows = [(i, f"common {'awful' if i % 3 == 0 else 'lovely'} w{i % 5}", float(i % 3 == 0), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double, half int")
    votes = df.mapInArrow(toxicity._votes, "entry long, half long, bad long, good long").groupBy("entry", "half").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = {h: (sum(int(r[2]) for r in rows if r[3] == h), sum(1 - int(r[2]) for r in rows if r[3] == h)) for h in (0, 1)}
    lexicon = toxicity._learned(votes, totals, (0, 1))
    bad, good = sum(t[0] for t in totals.values()), sum(t[1] for t in totals.values())
    for word in ("awful", "lovely", "common"):
        h = toxicity._plain_words(pa.array([word])).hashes(31)
        p, n = (sum(word in r[1] and r[2] == y for r in rows) + 0.5 for y in (1.0, 0.0))
        odds = np.log(p / (bad - p + 1.0)) - np.log(n / (good - n + 1.0))
        weight = odds - toxicity.ERRORS * np.sqrt(1 / p + 1 / n)
        assert lexicon.weigh(h)[0] == pytest.approx(weight if weight >= toxicity.SURE and p >= toxicity.SUPPORT else 0.0)


def test_toxicity_calibration_is_isotonic_in_the_trees(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.4
        rows.append((i, " ".join([f"w{k}" for k in rng.integers(0, 50, 20)] + (["awfulword"] if bad and rng.random() < 0.8 else []))))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    steps = judge.steps
    edges, values = np.array(steps.boundaries), np.array(steps.predictions)
    assert (np.diff(edges) >= 0).all() and (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    scored = toxicity.score_toxicity(docs, judge)[0].toPandas().merge(docs.join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").toPandas())
    good, bad = (scored.loc[scored.toxic == y, "score"].to_numpy() for y in (0, 1))
    assert (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean() > 0.8  # the area under the curve


def test_structure_statistics_equal_plain_ones():
    texts = ["One two TWO two!\nThree 4 5...", "", "é É ñandú"]
    rows, _, _ = structure(pa.array(texts))
    for t, r in zip(texts, rows):
        w, n = t.split(), max(len(t.split()), 1)
        assert r[0] == pytest.approx(np.log1p(len(w))) and r[2] == pytest.approx(sum(c.isdigit() and c.isascii() for c in t) / max(len(t.encode()), 1))
        assert r[7] == pytest.approx(sum(len(x.encode()) for x in w) / n) and r[9] == pytest.approx(len({x.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for x in w}) / n)


# ---- 7: spans


def test_matches_equal_plain_ones_and_long_texts_are_whole(spark):
    texts = ["", "abc", "12", "1 22 333", "é1😀22 3", "9 " * 700 + "7"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, found in df.select("i", pii.matches(F.col("t"), "[0-9]+", 3)).collect():
        plain = [(m.start(), m[0]) for m in re.finditer("[0-9]+", texts[i])]
        assert [(m["start"], m["match"]) for m in found] == plain
        ends = [0, *(s + len(x) for s, x in plain)]
        for k, m in enumerate(found):
            assert texts[i][: m["start"]].endswith(m["before"]) and texts[i][m["start"] + len(m["match"]) :].startswith(m["after"]) and len(m["before"]) <= 3
            assert len(m["before"]) >= min(3, m["start"] - ends[k])


def test_a_secret_is_taken_whole(spark):
    key = "a1B2" * 80
    df = spark.createDataFrame([(1, f"api_key: {key} end"), (2, "password: Summer24x then"), (3, "the password reminder arrives tomorrow"), (4, "x " * 4000 + f"token = {key}")], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "secret"] for r in pii.find_pii(df).collect()}
    assert spans[1] == [(0, 9 + len(key))] and spans[2] == [(0, 19)] and spans[3] == [] and spans[4] == [(8000, 8008 + len(key))]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == "<SECRET> end" and clean[4] == "x " * 4000 + "<SECRET>"


def test_spans_are_cut_as_a_plain_version_cuts_them(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(12):
        text = "".join(rng.choice(list("abé😀 \n"), int(rng.integers(0, 7000))))
        spans = [(int(a), int(min(len(text), a + rng.integers(1, 2600))), "x") for a in rng.integers(0, max(len(text), 1), int(rng.integers(0, 9))) if a < len(text)]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:bigint,stop:bigint,kind:string>>")
    for i, cut in df.select("i", pii._without(F.col("t"), F.col("s"))).collect():
        text, at, out = rows[i][1], 0, ""
        for a, b, _ in sorted(rows[i][2]):
            if b > at:
                out += text[at : max(a, at)] + "<X>"
                at = b
        assert cut == out + text[at:]


def test_candidates_beside_base_spans_and_apart(spark):
    rng = np.random.default_rng(7)
    base = [(u, int(a), int(a + rng.integers(1, 9))) for u in (1, 2) for a in rng.integers(0, 90, 6)]
    some = [(u, "k", int(a), int(a + rng.integers(1, 9)), float(rng.random())) for u in (1, 2, 3) for a in rng.integers(0, 90, 30)]
    c = spark.createDataFrame(some, "uid long, kind string, start long, stop long, rank double")
    b = spark.createDataFrame(base, "uid long, start long, stop long")
    for r in pii._beside_base(c, b).collect():
        assert r["on_any"] == any(u == r["uid"] and x < r["stop"] and y > r["start"] for u, x, y in base)
    want = set()
    for u in (1, 2, 3):
        kept = []
        for x in sorted((s for s in some if s[0] == u), key=lambda s: (s[4], s[2], s[3])):
            if not any(y[2] < x[3] and y[3] > x[2] for y in kept):
                kept.append(x)
        want |= {(u, "k", x[2], x[3]) for x in kept}
    assert {tuple(r) for r in pii._apart(c.select("uid", "rank", "start", "stop", "kind")).collect()} == want


# ---- 8: templates against regular expressions


def as_regex(template):
    out = ""
    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        out += {"[": "(?:", "]": ")?"}.get(token) or (r"(?:\S+ ){0,%s}" % token[1:-1] if token[0] == "{" else f"(?:{token}) ")
    return re.compile(r"(?<!\S)" + out)


def test_licence_labels_equal_regular_expressions(spark):
    rng = np.random.default_rng(9)

    def spelled(template):
        words = []
        for token in re.findall(r"\[[^\[\]]*\]|\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
            if token[0] == "[" and len(token) > 1:
                words += token[1:-1].split() if rng.random() < 0.5 and "{" not in token else []
            elif token[0] == "{":
                words += ["someone"] * int(rng.integers(0, int(token[1:-1]) + 1))
            elif token not in "[]":
                words.append(token.split("|")[0])
        if rng.random() < 0.3:
            words[int(rng.integers(len(words)))] = "different"
        return " ".join(words)

    names = list(L.TEMPLATES)
    texts = ["So: " + ". ".join(spelled(L.TEMPLATES[n]).title() for n in rng.choice(names, 2)) + " (end)" for _ in range(60)] + ["", None, "word " * 20000 + spelled(L.TEMPLATES["isc"])]
    out = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = Counter()
    for r in out:
        line = " ".join((texts[r["doc_id"]] or "").encode().translate(L._TABLE).decode().split()) + " "
        want = {n for n in names if as_regex(L.TEMPLATES[n]).search(line)}
        assert set(r["labels"]) - set(r["base_labels"]) == want
        hits.update(want)
    assert {"mit-license", "bsd-3-clause", "isc", "apache-2.0-notice", "gpl-3.0-notice"} <= set(hits)


# ---- all: very long texts, and columns named like the output's


CLASH = ["shard", "slot", "size", "piece", "start", "length", "base", "spans", "labels", "n_words", "n_removed", "kept_text", "class_id", "kept", "uid", "unit", "sequence_id"]


def test_long_texts_and_clashing_names(spark):
    rng = np.random.default_rng(10)
    long = " ".join(f"w{i}" for i in rng.integers(0, 3000, 120_000))  # about 700 kB
    rows = [(1, long), (2, long + " tail"), (3, "short text of five words"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    words = len(long.split())
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect()}
    assert removed[1] == (words, 0) and removed[2] == (words + 1, words)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert minhash_dedup(df).columns == df.columns
    dealt = shards.kd_tree_shards(df, n_shards=2).collect()
    assert sorted(r["size"] for r in dealt) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    packed = pack(df, TOKENIZER).toPandas()
    assert packed.groupby("doc_id")["length"].sum()[1] > 120_000 and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    bench = spark.createDataFrame([(1, " ".join(long.split()[-30:]))], "item_id long, text string")
    found, out = contamination(df, bench)
    assert {r["doc_id"]: r[out]["n_hit"] for r in found.collect()} == {1: 30, 2: 30, 3: 0, 4: 0} and found.columns == [*df.columns, out]
    assert {r["doc_id"]: r["n_words"] for r in L.license_scan(df).collect()} == {1: words, 2: words + 1, 3: 5, 4: 0}
    assert pii.find_pii(df).count() == 4 and pii.redact(df).columns == df.columns
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    scored, name = quality.score_quality(df, quality.fit_quality(df, labels))
    assert scored.columns == [*df.columns, name] and scored.where(f"{name} BETWEEN 0 AND 1").count() == 4
    scored, name = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels))
    assert scored.columns[:-1] == [*df.columns, name] and scored.columns[-1].startswith("chance") and scored.where(f"{name} BETWEEN 0 AND 1").count() == 4


def test_the_fit_is_bounded_and_made_in_a_task(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7, i % 7 + 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    few = quality.fit_quality(docs, labels, most_counts=300)
    many = quality.fit_quality(docs, labels)
    assert (few.linear != 0).sum() <= (many.linear != 0).sum() and quality.fit_quality(docs.where("false"), labels).bias == 0.0


# ---- the pipeline: each stage on its own input against a plain version


def test_pipeline_stages_equal_plain_versions(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lectern.llm.spark import materialize
    from test_llm import brute_near, key

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    after = {}
    for name in list(stages)[:-1]:
        after[name] = (before, materialize(stages[name](spark, before, sf), "plain"))
        before = after[name][1]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    # quality: the machine's explicit score
    docs, kept = (texts(x) for x in after["quality classifier"])
    machine = quality.fit_quality(after["quality classifier"][0], labels)
    f = quality.assemble(*quality.word_counts(pa.array(list(docs.values()))), machine.edges)
    scores = machine.scores(f)
    assert set(kept) == {i for i, s in zip(docs, scores) if s >= 0.3}
    # near-duplicates: one of each class, all pairs compared
    docs, kept = (texts(x) for x in after["MinHash near-dedup"])
    rows = list(docs.items())
    classes = defaultdict(list)
    for (i, _), c in zip(rows, brute_near(rows)):
        classes[c].append(i)
    assert set(kept) == {min(map(key, v)) for v in classes.values()}
    # benchmark: no window of ten words
    docs, kept = (texts(x) for x in after["benchmark decontamination"])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r["text"])
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[min(len(w), 10)].add(tuple(w[s : s + 10]))
    hit = lambda w: any(tuple(w[s : s + n]) in some for n, some in windows.items() for s in range(len(w) - n + 1))
    assert set(kept) == {i for i, t in docs.items() if not hit(split(t))}
    # personal data: the spans found, cut by hand
    docs, kept = (texts(x) for x in after["PII"])
    for r in pii.find_pii(after["PII"][0]).collect():
        text, at, out = docs[r["doc_id"]], 0, ""
        for s in sorted(r["spans"], key=lambda s: (s["start"], s["stop"], s["kind"])):
            if s["stop"] > at:
                out += text[at : max(s["start"], at)] + f"<{s['kind'].upper()}>"
                at = s["stop"]
        assert kept[r["doc_id"]] == out + text[at:]
    # packing: the library's ids, whole, in sequences that hold them
    packed = stages["best-fit packing"](spark, before, sf).toPandas()
    whole = Tokenizer.from_file(TOKENIZER)
    for i, own in packed.sort_values("piece").groupby("doc_id"):
        ids = whole.encode(kept[i] or "", add_special_tokens=False).ids + [0]
        got = [(r.start, r.length, r.ids_crc32) for r in own.itertuples()]
        assert got == [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in got] and sum(n for _, n, _ in got) == len(ids)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 2048 and list(own["offset"]) == list(own["length"].cumsum() - own["length"])
