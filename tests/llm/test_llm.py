"""The corpus operators against brute force, on small tables that hold the odd cases.

``odd_docs`` has null and empty texts, null ids, repeated rows, one id with two texts, a long text,
ties, and extra columns whose names clash with those that the operators add.
"""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lectern.llm")
import public_tokenizers  # noqa: E402

from lectern.llm import decontaminate as D  # noqa: E402
from lectern.llm.embedding_dedup import embedding_dedup, quantise  # noqa: E402
from lectern.llm.labelled import fold_of  # noqa: E402
from lectern.llm.license_scan import Automaton, license_scan  # noqa: E402
from lectern.llm.minhash import minhash_dedup, near_duplicates, shingles, signatures  # noqa: E402
from lectern.llm.packing import pack, pack_lengths  # noqa: E402
from lectern.llm import pii  # noqa: E402
from lectern.llm.pii import find_pii, redact  # noqa: E402
from lectern.llm.quality import fit_quality, quality_filter, score_quality  # noqa: E402
from lectern.llm.shards import kd_tree_shards  # noqa: E402
from lectern.llm.substring_dedup import substring_dedup  # noqa: E402
from lectern.llm.toxicity import fit_toxicity, score_toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key_id long, contamination string"
PASSAGE = " ".join(f"p{i}" for i in range(30))
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = np.random.default_rng(3)
    some = lambda n, k: " ".join(f"w{i}" for i in rng.integers(0, k, n))
    base = some(120, 5000)
    near = base.split()
    near[60] = "changed"
    long = some(6000, 300)
    return [
        (1, base), (2, base + " " + PASSAGE), (3, PASSAGE + "\n\t" + some(40, 5000)), (4, " ".join(near)), (5, None), (6, ""), (7, "  \n "), (7, "one id two texts"), (8, base), (8, base),
        (None, PASSAGE + " tail"), (None, None), (9, "a b c"), (10, "the " * 90), (11, long), (12, "x" * 3000), (13, "café naïve " * 30), (14, long + " end"), (15, "a b c"),
    ]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}", len(t or ""), 0.5, 7, "x") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return 2**63 - 1 if i is None else i


# ---- 1: substring dedup


def brute_substring(rows, window):
    docs = sorted({(key(i), t or "") for i, t in rows})
    split = {d: d[1].encode().split() for d in docs}
    first, gone = {}, defaultdict(set)
    places = sorted(((d[0], d[1], s), d) for d in docs for s in range(len(split[d]) - window + 1))
    for (_, _, s), d in places:
        w = tuple(split[d][s : s + window])
        if w in first:
            gone[d].update(range(s, s + window))
        first.setdefault(w, (d, s))
    out = []
    for i, t in rows:
        d = (key(i), t or "")
        kept = [w for k, w in enumerate(split[d]) if k not in gone[d]]
        out.append((str(i), len(split[d]), len(gone[d]), b" ".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("held", [3_000_000, 40])
def test_substring_dedup_equals_brute_force(odd_docs, held):
    found = substring_dedup(odd_docs, window=20, buckets=5, held=held).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in found) == brute_substring(texts(), 20)


def test_substring_dedup_of_nothing(no_docs):
    assert substring_dedup(no_docs).count() == 0


# ---- 2: sharding


def test_shards_are_even_and_gapless(spark, odd_docs):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 97 + 1).cast("int")).alias("text"), (F.col("id") % 3).alias("lang"), F.lit("s").alias("source"))
    out = kd_tree_shards(docs, n_shards=8, slack=0.2).toPandas()
    total = out.groupby("shard")["size"].sum()
    assert len(out) == 400 and len(total) == 8 and total.max() - total.min() < 0.2 * total.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    odd = kd_tree_shards(odd_docs, n_shards=3).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in odd) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())


def test_equal_texts_share_a_shard_within_the_slack(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") % 150).cast("string")).alias("text"))
    out = kd_tree_shards(docs, n_shards=4, slack=0.1)
    assert out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


def test_shards_of_nothing(no_docs):
    assert kd_tree_shards(no_docs, n_shards=8).count() == 0


# ---- 3: packing


def test_packing_round_trip(odd_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = pack(odd_docs, TOKENIZER, capacity=64, group=7).toPandas()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 64 and list(own["offset"]) == list(own["length"].cumsum() - own["length"])
    want = Counter()
    for i, t in texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        a, b, k = 0, len(ids) % 64 or 64, 0
        while a < len(ids):
            want[(str(i), k, a, min(b, len(ids)) - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
            a, b, k = b, b + 64, k + 1
    ids = ["None" if x != x else str(int(x)) for x in out.doc_id.astype(float)]
    assert Counter(zip(ids, out.piece, out.start, out.length, out.ids_crc32, strict=True)) == want


def test_local_search_keeps_pieces_and_capacity():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 700, 300)
    home, at = pack_lengths(size, 1000)
    assert max(np.bincount(home, size)) <= 1000 and len(set(home)) <= -(-size.sum() // 1000) + 1


def test_packing_of_nothing(no_docs):
    assert pack(no_docs, TOKENIZER).count() == 0


# ---- 4: embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    rows = [(i, (centers[i % 6] + rng.normal(size=16) * 0.16).tolist()) for i in range(90)]
    rows += [(90, [0.0] * 16), (91, None), (92, [1.0] * 15 + [None]), (93, [float("nan")] * 16), (94, []), (95, rows[0][1]), (96, [x * 1e300 for x in rows[0][1]]), (97, [1.0, 0.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string")
    out = {r["vec_id"]: r for r in embedding_dedup(df, tile=16).collect()}
    ok = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0}
    links = {i: {j for j, w in ok.items() if i != j and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9} for i, v in ok.items()}
    for i, _ in rows:
        if i is None:
            assert out[i]["kept"] and out[i]["n_links"] == 0
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (len(links.get(i, ())), min(seen), i == min(seen))


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(50, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, step, norm, loss = quantise(u)
    about = (code * step[:, None]) @ (code * step[:, None]).T
    bound = norm[:, None] * loss[None] + loss[:, None] * norm[None] + loss[:, None] * loss[None]
    assert (np.abs(u @ u.T - about) <= bound).all()


def test_embeddings_of_nothing(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 5 and 10: classifiers


@pytest.fixture(scope="module")
def classed(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if junk:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[5:5] = ["awfulword", "you"]
            words[20:20] = ["dreadful" + "abcdefg"[i % 7]]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (10**6, 1, 0)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scored, name, labels, label, folds, fold):
    out = scored.where(fold_of("doc_id", folds) == fold).join(labels, "doc_id").select(((F.col(name) >= 0.3).cast("int") == F.col(label)).cast("int").alias("ok"))
    return out.agg(F.avg("ok")).first()[0]


def test_quality_on_held_out_rows(classed, odd_docs, no_docs):
    docs, labels = classed
    machine = fit_quality(docs, labels)
    scored, name = score_quality(docs, machine)
    assert held_out_accuracy(scored, name, labels, "quality", 5, 0) > 0.95
    odd, name = score_quality(odd_docs, machine)
    assert name == "score_" and odd.where(f"{name} BETWEEN 0 AND 1").count() == len(texts())
    assert quality_filter(no_docs, labels).count() == 0
    constant = fit_quality(docs, labels.where("quality = 1"))
    assert score_quality(docs, constant)[0].where("score > 0.5").count() == 400


def test_toxicity_on_held_out_rows(classed, odd_docs, no_docs):
    docs, labels = classed
    judge = fit_toxicity(docs, labels)
    scored, name = score_toxicity(docs, judge)
    assert held_out_accuracy(scored, name, labels, "toxic", 4, 2) > 0.95
    odd, name = score_toxicity(odd_docs, judge)
    assert odd.columns[:-1] == [*odd_docs.columns, name] and odd.columns[-1].startswith("chance") and odd.where(f"{name} BETWEEN 0 AND 1").count() == len(texts())
    assert score_toxicity(no_docs, judge)[0].count() == 0
    assert score_toxicity(docs, fit_toxicity(docs, labels.where("toxic = 0")))[0].where("score < 0.3").count() == 400


# ---- 6: decontamination

ITEMS = [(1, " ".join(f"p{i}" for i in range(12))), (2, "A, b; C"), (3, None), (4, "..."), (None, "tail"), (1, "naïve café naïve"), (5, " ".join(f"zz{i}" for i in range(20)))]


@pytest.mark.parametrize("bound", [1000, 0])
def test_contamination_equals_brute_force(spark, odd_docs, bound):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in ITEMS:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add("null" if i is None else str(i))
    want = []
    for i, t in texts():
        w, hit, items = words(t), set(), set()
        for win, names in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    items |= names
        want.append((str(i), len(w), len(hit), tuple(sorted(items))))
    found, out = D.contamination(odd_docs, spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_windows=bound)
    assert found.columns == [*odd_docs.columns, out]
    assert sorted((str(r["doc_id"]), r[out]["n_words"], r[out]["n_hit"], tuple(r[out]["items"])) for r in found.collect()) == sorted(want)


def test_contamination_of_nothing(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(no_docs, bench).count() == 0
    assert D.decontaminate(odd_docs, bench.where("false")).count() == len(texts())


# ---- 7: personal data

PII = [
    "a@b.c@d.e x@y.z%w@q.r a@b@c.d 1.2.3.4.5.6.7.8 +1 (650) 555-1234. 256.1.1.1 0255.1.1.001", "4111 1111-1111 1111 and 4111111111111111 a@b.c_d@e.f --@-.- é😀 1@2.3",
    "+1+123456789012 +12345678.(90) x+111111111111111--", "..@a.b a..b@c..d a@b.c. 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "1 " * 9000, "a." * 9000 + "@b" + ".c" * 9000, "9" * 50000, None, "", 'token = "c80fd45a66f8564ae70609f7b2a26100e64e830e"',
]


def brute_pii(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x, d: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x, d: 13 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x, d: 9 <= len(d) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for r in find_pii(df).collect():
        assert [tuple(s) for s in r["base"]] == brute_pii(PII[r["doc_id"]])
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    clean = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    assert "<EMAIL>" in clean[0] and "<PHONE>" in clean[2] and clean[7] is None and clean[8] == ""


def test_pii_of_odd_rows_and_nothing(odd_docs, no_docs):
    assert find_pii(odd_docs).count() == len(texts()) and find_pii(no_docs).count() == 0
    assert redact(odd_docs).columns == odd_docs.columns and redact(odd_docs).count() == len(texts())


def planted_pii(i):
    """Of each row a text, its one span that no base pattern finds, and a look-alike that must stay."""
    rng = np.random.default_rng(i)
    a, b, c = (int(x) for x in rng.integers(200, 999, 3))
    good = [f"({a}) {b}-{1000 + c}", f"030 {1000 + a} {b}", f"0049 {a} {1000 + b}", f"jo{i} (at) host{i} (dot) org", f"jo{i} at host{i} dot com", f"{a}-{10 + b % 80}-{1000 + c}".replace("666-", "665-").replace("9", "8"), "4111.1111.1111.1111"][i % 7]
    bad = [f"{a}.{1000 + b}{c}", f"12.03.2019 {a}", f"arrived at work{i}. The", f"1.{a}.{b}.{c}", f"4111.1111.1111.{1112 + i % 7}", f"{a} {b}", "2019-11-05"][i // 7 % 7]
    return f"row {i} has {good} for you, and {bad} by then", good, bad


@pytest.mark.parametrize("n", [7, 210])
def test_pii_that_no_base_pattern_finds(spark, n):
    rows = [(i, *planted_pii(i)) for i in range(n)]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    found = {r["doc_id"]: r for r in find_pii(df).collect()}
    for i, t, good, bad in rows:
        spans = [t[s["start"] : s["stop"]] for s in found[i]["spans"]]
        assert not found[i]["base"] and good in spans, (good, spans)
        assert not any(bad.startswith(s) or s in bad for s in spans), (bad, spans)


def test_ibans_are_checked_and_partitioning_changes_nothing(spark):
    rows = [(i, planted_pii(i)[0]) for i in range(120)] + [(900, "pay to DE89 3704 0044 0532 0130 00 now"), (901, "part AB12 CDEF 3456 GHIJ 7890 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_pii(x).collect()} for x in (df.repartition(1), df.repartition(7, "text"))]
    assert runs[0] == runs[1]
    assert runs[0][900] == [("iban", 7, 34)] and runs[0][901] == []


def test_the_trees_decide_what_is_added(spark, monkeypatch):
    texts = ["look at acme dot com now", "meet me at bob dot com", "jo7 at host7 dot com is mine", "ssn 219-09-9998 here", "a@b.org and 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = lambda: {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_pii(df).collect()}
    found = spans()
    assert found[0] == found[1] == [] and found[2] == [("email", 0, 20)] and found[3] == [("ssn", 4, 15)] and len(found[4]) == 2
    judge = pii.judge(spark)
    monkeypatch.setattr(pii, "judge", lambda *_: pii.Judge(None, {}, {}))
    assert spans() == {0: [], 1: [], 2: [], 3: [], 4: found[4]}  # without trees nothing is added to the base spans
    monkeypatch.setattr(pii, "judge", lambda *_: pii.Judge(judge.trees, judge.chances, dict.fromkeys(judge.least, 0.0)))
    assert spans()[0] and spans()[1]  # without thresholds look-alikes come through


def test_added_spans_are_those_above_the_threshold_and_recall_is_high(spark):
    judge = pii.judge(spark)
    fresh = pii.labelled_candidates(spark, 17_000).where(f"row >= {pii.FIT_ROWS}")  # examples that neither trees nor thresholds have seen
    rows = judge.judged(fresh).select("kind", "label", "chance", "accepted").collect()
    for kind in pii.EXTRA_KINDS:
        own = [r for r in rows if r["kind"] == kind]
        assert all(r["accepted"] == (r["chance"] >= judge.least[kind]) for r in own)
        true, taken = [r for r in own if r["label"] == 1], [r for r in own if r["accepted"]]
        assert sum(r["accepted"] for r in true) >= 0.9 * len(true) and len(true) > 50, kind
        assert sum(r["label"] for r in taken) >= 0.95 * len(taken), kind


def test_thresholds_leave_few_false_ones():
    steps = [(0.9, 50, 0.0), (0.8, 50, 1.0), (0.7, 10, 4.0), (0.3, 900, 0.0)]
    assert pii._threshold(steps, 0.02) == 0.8 and pii._threshold([(0.4, 9, 0.0)], 0.02) == pii.NEVER


# ---- 8: licences


def test_base_phrases_equal_brute_force(spark, odd_docs, no_docs):
    rows = [(1, "All Rights Reserved. CC-BY, cc by cc by"), (2, "the GNU General\nPublic License all rights\x00reserved"), (3, None), (4, "accc by"), (5, "é cc by"), (6, "Released under the MIT License.")]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [s for p in ("cc by", "general public license", "all rights reserved") for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        assert (out[i]["n_words"], out[i]["n_base"], out[i]["first_word"], out[i]["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert out[6]["labels"] == ["mit"] and out[6]["base_labels"] == []
    assert license_scan(odd_docs).count() == len(texts()) and license_scan(no_docs).count() == 0


def test_template_markup():
    a = Automaton("one [two [three]] {2} four|five")
    ends = lambda t: a.match(t.split(), 0)
    assert ends("one four") == 2 and ends("one two five") == 3 and ends("one two three x y four") == 6
    assert ends("one x y z four") is None and ends("two four") is None
    with pytest.raises(ValueError):
        Automaton("[all optional]")


# ---- 9: near-duplicates


def brute_near(rows):
    tx, k, c = shingles(pa.array([t for _, t in rows], pa.string()))
    bags = [Counter() for _ in rows]
    for d, h, n in zip(tx.tolist(), k.tolist(), c.tolist(), strict=True):
        bags[d][h] = n
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if all_ and both >= 0.8 * all_ - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = defaultdict(lambda: 2**63)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], key(d))
    return [least[root(i)] for i in range(len(rows))]


def test_near_duplicate_classes_equal_brute_force(spark, odd_docs):
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(70)]
    rows = texts()
    for i in range(60):  # copies that drift, over a common passage that alone makes no pair
        own = [f"u{i % 12}_{k}" for k in range(60)]
        for at in rng.integers(0, 60, i % 5):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((100 + i, " ".join(common + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((str(r["doc_id"]), key(r["class_id"])) for r in near_duplicates(df).collect())
    assert found == Counter((str(d), c) for (d, _), c in zip(rows, brute_near(rows), strict=True))


def test_one_row_of_each_class_stays(odd_docs, no_docs):
    kept = minhash_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[4] == 0 and ids[8] == 0 and ids[14] == 0 and ids[15] == 0
    assert minhash_dedup(no_docs).count() == 0


def test_signatures_are_unbiased():
    text = np.repeat([0, 1], [80, 80])
    keys = np.concatenate([np.arange(80), np.arange(80)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.concatenate([np.full(80, 5), np.r_[np.full(40, 5), np.full(40, 2)]])
    s = signatures(text, keys, count, 2, 6000)
    assert abs((s[0] == s[1]).mean() - (200 + 80) / 400) < 0.03


# ---- the pipeline


def test_pipeline_over_the_smallest_tables(spark):
    import corpus_pipeline
    from lectern.llm.spark import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.where("piece = 0").count() == n
