"""The text index and the vector index against plain searches of all rows."""

import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.functions.stem import stem
from lectern.operators import search, textindex
from lectern.operators.textindex import build_text_index, lexical_top, parse_query
from lectern.operators.vectorindex import build_vector_index, index_knn, recall
from lectern.session import scratch

# ---- stems and queries

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "hopping": "hop", "hoping": "hope", "falling": "fall", "sized": "size",
    "luxuriated": "luxuri", "happy": "happi", "say": "say", "by": "by", "relational": "relat", "conditional": "condit", "rationally": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
    "formality": "formal", "sensibility": "sensibl", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "adoption": "adopt", "replacement": "replac", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "rate": "rate", "cease": "ceas", "controlling": "control", "generously": "generous", "communication": "communic", "skies": "sky", "dying": "die", "proceed": "proceed", "knightly": "knight", "apology": "apolog", "consignment": "consign", "größe": "größe",
}


def test_stems_are_the_published_ones():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_web_style_queries_are_alternatives_of_clauses():
    rule = parse_query('Red "big apple" or -"rotten pear" green -sour', "simple", frozenset())
    assert rule["any"] == [{"all": [[[0, "red"]], [[0, "big"], [1, "apple"]]], "none": []}, {"all": [[[0, "green"]]], "none": [[[0, "rotten"], [1, "pear"]], [[0, "sour"]]]}]
    assert parse_query("well-known", "simple", frozenset())["any"][0]["all"] == [[[0, "well"], [1, "known"]]]
    assert parse_query("-only -forbidden", "simple", frozenset())["any"] == [] and parse_query(None, "simple", frozenset())["any"] == []
    assert parse_query("the walking of dogs", "english", frozenset({"the", "of"}))["any"][0]["all"] == [[[0, "walk"]], [[0, "dog"]]]


# ---- the text index

VOCABULARY = ["apple", "apples", "pear", "running", "runs", "the", "Zürich", "x1", "or", "deep", "sea", "blue"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    size = [0, 1, 3, 12, 60, 300]
    p = np.arange(len(VOCABULARY), 0, -1) ** 2.0
    return [(i, ["bio", "law", None][i % 3], None if i % 11 == 0 else ", ".join(rng.choice(VOCABULARY, size[int(rng.integers(6))], p=p / p.sum()))) for i in range(n)]


def plain_search(rows, asked, k, language):
    """Every document read, every pair of places compared."""
    stops = {"the", "or"} if language == "english" else set()
    out = []
    for query, scope, options in asked:
        found = []
        terms = sorted({t for o in options for part in o for c in part for t in c})
        for i, s, text in rows:
            if text is None or (scope is not None and s != scope):
                continue
            words = [stem(w) if language == "english" and w not in stops else w for w in re.findall(r"\w+", text.lower())]
            has = lambda c: any(words[p : p + len(c)] == list(c) for p in range(len(words)))  # noqa: B023, E731
            if not any(all(map(has, yes)) and not any(map(has, no)) for yes, no in options):
                continue
            at = {t: [p for p, w in enumerate(words) if w == t] for t in terms}
            if len(options) == 1 and len(terms) > 1:
                left = 1.0
                for x, a in enumerate(terms):
                    for b in terms[:x]:
                        for p in at[a]:
                            for q in at[b]:
                                d = abs(p - q)
                                left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 0)
                score = 1 - left
            else:
                score = sum(0.1 * sum(1 / j**2 for j in range(1, len(p) + 1)) / 1.64493406685 for p in at.values()) / len(terms)
            found.append((-round(score, 9), i, score))
        out += [(query, i, pytest.approx(score, abs=1e-9)) for _, i, score in sorted(found)[:k]]
    return out


ASKED = [
    (1, None, "apple pear", [([("apple",), ("pear",)], [])]),
    (2, "bio", '"apple pear"', [([("apple", "pear")], [])]),
    (3, None, '"deep sea" or zürich -apple', [([("deep", "sea")], []), ([("zürich",)], [("apple",)])]),
    (4, "law", "x1", [([("x1",)], [])]),
    (5, None, 'apple -"pear apple" -x1', [([("apple",)], [("pear", "apple"), ("x1",)])]),
    (6, None, "absent apple", [([("absent",), ("apple",)], [])]),
    (7, None, "apple apples pear", [([("apple",), ("apples",), ("pear",)], [])]),
    (8, None, "-apple", []),
    (9, None, None, []),
]


@pytest.mark.parametrize(("k", "block_docs"), [(5, 7), (1000, 16), (3, 1000)])
def test_text_search_equals_reading_every_document(spark, k, block_docs):
    rows = texts(160, 3)
    docs = spark.createDataFrame(rows, "id long, scope string, text string").withColumn("term", F.lit("extra"))
    index = build_text_index(docs, scratch(spark, "words"), block_docs=block_docs)
    asked = spark.createDataFrame([r[:3] for r in ASKED], "query long, scope string, text string")
    found = [(r["query"], r["id"], r["score"]) for r in lexical_top(index, asked, k).orderBy("query", "rank").collect()]
    assert found == plain_search(rows, [(q, s, o) for q, s, _, o in ASKED], k, "simple")


def test_english_search_meets_stems_and_leaves_stop_words_out(spark):
    rows = texts(60, 8)
    index = build_text_index(spark.createDataFrame(rows, "id long, scope string, text string"), scratch(spark, "stems"), "english")
    asked = spark.createDataFrame([(1, "the apples running"), (2, '"run the apple"'), (3, "the")], "query long, text string")
    found = lexical_top(index, asked, 50).orderBy("query", "rank").collect()
    wanted = plain_search(rows, [(1, None, [([("appl",), ("run",)], [])])], 50, "english")
    assert [(r["query"], r["id"], r["score"]) for r in found if r["query"] == 1] == wanted and wanted
    gap = {i for i, _, t in rows if t and re.search(r"\brun(s|ning), \w+, apples?\b", t.lower())}
    assert {r["id"] for r in found if r["query"] == 2} == gap and not [r for r in found if r["query"] == 3]


def test_text_search_of_nothing_and_what_it_reads(spark):
    docs = spark.createDataFrame(texts(40, 1), "id long, scope string, text string")
    index = build_text_index(docs, scratch(spark, "few"))
    asked = spark.createDataFrame([(1, "apple pear")], "query long, text string")
    plan = lexical_top(index, asked, 3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*(In\(term|EqualTo\(term)", plan)
    nothing = build_text_index(docs.limit(0), scratch(spark, "none"))
    assert lexical_top(nothing, asked, 3).count() == 0 and lexical_top(index, asked.limit(0), 3).count() == 0


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("text", ["apple pear", "apple or pear -x1"])
def test_postings_of_common_words_are_not_sent_once_for_each_query(spark, text):
    index = build_text_index(spark.createDataFrame(texts(3000, 5), "id long, scope string, text string"), scratch(spark, "common"))
    cost = []
    for n in (4, 400):
        asked = spark.createDataFrame([(i, f"{text} -w{i % 4}") for i in range(n)], "query long, text string")
        before = shuffled(spark)
        found = lexical_top(index, asked, 5).collect()
        cost.append(shuffled(spark) - before)
        assert len(found) == 5 * n
    assert cost[1] < 3 * cost[0] + 100_000


def test_text_search_by_tiles_and_parts_equals_reading_every_document(spark, monkeypatch):
    for name, value in (("TILE_ASKS", 3), ("PARTS", 5), ("NAMED_QUERIES", 2), ("SENT_TERMS", 1)):
        monkeypatch.setattr(textindex, name, value)
    rows = texts(160, 3)
    index = build_text_index(spark.createDataFrame(rows, "id long, scope string, text string"), scratch(spark, "parts"), block_docs=9)
    twice = [(q + 10 * again, s, t, o) for again in range(2) for q, s, t, o in ASKED]
    asked = spark.createDataFrame([r[:3] for r in twice], "query long, scope string, text string")
    found = [(r["query"], r["id"], r["score"]) for r in lexical_top(index, asked, 6).orderBy("query", "rank").collect()]
    assert found == plain_search(rows, [(q, s, o) for q, s, _, o in twice], 6, "simple")


def test_long_phrases_stay_inside_a_document(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, "a", " ".join(words)), (2, "a", " ".join(words[:150])), (3, "a", " ".join(words[150:]))]
    index = build_text_index(spark.createDataFrame(rows, "id long, scope string, text string"), scratch(spark, "long"))
    asked = spark.createDataFrame([(7, '"' + " ".join(words[100:]) + '"')], "query long, text string")
    assert [r["id"] for r in lexical_top(index, asked, 5).collect()] == [1]


def test_words_of_the_index_are_runs_of_letters_and_digits_of_any_script():
    rng = np.random.default_rng(2)
    characters = ["a", "z", "0", " ", "-", "_", "é", "ß", "ж", "中", "😀", "𝒳", "١", "Ⅷ", "²", "\u0301", "\u00ad", "\u200b", "\ufffd", "\x00", "\u3000"]
    rows = ["", "", *("".join(rng.choice(characters, int(n))) for n in rng.integers(0, 9, 2000)), "", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000), ""]
    for text in (pa.array(rows), pa.array(rows).slice(7, 900), pa.array(rows[:2]), pa.array([], pa.string())):
        words, at = textindex._words(text)
        split = pa.compute.split_pattern_regex(text, r"[^\p{L}\p{N}]+").to_pylist()
        assert [words[a:b].to_pylist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[w for w in own if w] for own in split]


def test_the_index_tries_no_dictionaries_of_what_hardly_repeats_and_holds_terms_in_order(spark):
    index = build_text_index(spark.createDataFrame(texts(300, 4), "id long, scope string, text string").coalesce(1), path := scratch(spark, "plain"))
    files = list(Path(path.removeprefix("file:")).rglob("*.parquet"))
    for file in files:
        held = pq.ParquetFile(file)
        group = held.metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert not any(columns[c].has_dictionary_page for c in ("term", "ids", "places"))
        terms = held.read(["term"]).column("term").to_pylist()
        assert terms == sorted(terms)
    assert files and index.postings(spark).select("term").distinct().count() == len({w.lower() for w in VOCABULARY})


def test_hybrid_search_asks_the_text_index_once_for_all_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, s, None, t) for s in ("a", "b") for i, _, t in texts(50, 6)], "id long, source string, scope string, text string")
    index = build_text_index(docs, scratch(spark, "once"))
    none = spark.createDataFrame([], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "apple", None)], "query long, text string, embedding array<double>")
    found = search.hybrid_search(index, {"a": none, "b": none}, asked, 6)
    assert index.path not in found._jdf.queryExecution().toString()  # its answers were written, and both sources read them
    assert sorted(r["source_type"] for r in found.collect()) == ["a"] * 3 + ["b"] * 3


def test_packed_numbers_come_back():
    values = np.array([0, 127, 128, 300, 2**14, 2**35, 2**64 - 1, 5], np.uint64)
    rows = np.array([0, 0, 3, 8, 8])
    back, at = textindex.unpacked(textindex.packed(values, rows))
    assert (back == values).all() and at.tolist() == rows.tolist()
    part, at = textindex.unpacked(textindex.packed(values, rows).slice(2, 2))
    assert (part == values[3:]).all() and at.tolist() == [0, 5, 5]


def test_nearness_counts_all_pairs_in_reach_of_each_document():
    rng = np.random.default_rng(0)
    docs = [[np.sort(rng.choice(400, n, replace=False)) for n in (40, 25, 3)] for _ in range(5)]
    terms, ids = ["a", "b", "c"], np.array([3, 4, 8, 9, 20])
    block = textindex.Block(terms, [ids] * 3, [np.array([len(d[t]) for d in docs]) for t in range(3)], [np.concatenate([d[t] for d in docs]) for t in range(3)], ids[:4])
    want = []
    for places in docs[:4]:
        left = 1.0
        for i, b in enumerate(places):
            for a in places[:i]:
                for p in a:
                    for q in b:
                        d = abs(int(p) - int(q))
                        left *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30)
        want.append(1 - left)
    assert block.near(terms).tolist() == pytest.approx(want)


# ---- the vector index


def test_vector_index_finds_most_neighbours_and_scores_them_exactly(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 32))
    rows = [(i, (centers[i % 40] + 0.6 * rng.normal(size=32)).tolist()) for i in range(4000)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [1.0, 2.0]), (5003, [float("nan")] * 32), (5004, rows[7][1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = build_vector_index(df, scratch(spark, "lists"), sample=1500)
    assert int(index.sizes.sum()) == 4001  # every row with a direction, and no other
    asked = df.where("id % 100 = 0")
    found = index_knn(index, asked, 10).cache()
    told = recall(found, df, asked, 10).first()
    assert told["n_queries"] == 40 and told["recall"] >= 0.9
    vectors = dict(rows)
    for r in found.collect():
        a, b = (np.array(vectors[r[c]]) for c in ("query", "id"))
        assert r["similarity"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and r["query"] != r["id"]
    everything = index_knn(index, asked, 10, probes=10_000, refine=500)
    assert recall(everything, df, asked, 10).first()["recall"] == 1.0


def test_vector_index_of_small_tables_and_many_tiles(spark, monkeypatch):
    from lectern.operators import vectorindex

    monkeypatch.setattr(vectorindex, "TILE", 16)
    monkeypatch.setattr(vectorindex, "BLOCK", 8)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(90)], "id long, embedding array<double>")
    index = build_vector_index(df, scratch(spark, "tiles"), lists=2, subspaces=2)
    got = {(r["query"], r["id"], r["rank"]) for r in index_knn(index, df, 4, probes=2, refine=90).collect()}
    assert got == {(r["query"], r["id"], r["rank"]) for r in search.knn(df, df, 4).collect()}
    assert index_knn(index, df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        build_vector_index(df.limit(0), scratch(spark, "no"))


def test_an_index_is_built_without_shuffling_its_postings(spark):
    rows = spark.createDataFrame(texts(3000, 5), "id long, scope string, text string")
    before = shuffled(spark)
    index = build_text_index(rows, scratch(spark, "segments"))
    assert shuffled(spark) == before and index.postings(spark).count() > 0


def test_gaps_at_the_ends_and_odd_texts_leave_words_in_their_places(spark):
    odd = [(1, "a", "  --one,two  ONE_"), (2, "a", ""), (3, "a", None), (4, "b", "...!"), (5, None, "zwei  Ünï-ÇÖDÉ \U00010400x ٣ one"), (6, "a", "two. one")]
    index = build_text_index(spark.createDataFrame(odd, "id long, scope string, text string"), scratch(spark, "odd"))
    placed = {}
    for r in index.postings(spark).collect():
        ids, _ = textindex.unpacked(pa.array([r["ids"]], pa.binary()))
        sizes, _ = textindex.unpacked(pa.array([r["sizes"]], pa.binary()))
        gaps, _ = textindex.unpacked(pa.array([r["places"]], pa.binary()))
        for i, own in zip(np.cumsum(ids), np.split(gaps, np.cumsum(sizes)[:-1].astype(int)), strict=True):
            placed.setdefault(int(i), {}).update({int(at): r["term"] for at in np.cumsum(own)})
    want = {r["id"]: dict(enumerate(r["words"], 1)) for r in spark.createDataFrame(odd, "id long, scope string, text string").select("id", textindex.words_of(F.col("text")).alias("words")).collect() if r["words"]}
    assert placed == want


def test_thousands_of_queries_are_one_tile_of_the_postings(spark):
    index = build_text_index(spark.createDataFrame(texts(300, 5), "id long, scope string, text string"), scratch(spark, "tile"))
    cost = []
    for n in (4000, 8000):  # distinct ones, in one tile both
        asked = spark.createDataFrame([(i, f"apple pear -w{i}x") for i in range(n)], "query long, text string")
        before = shuffled(spark)
        lexical_top(index, asked, 1).count()
        cost.append(shuffled(spark) - before)
    assert textindex.TILE_ASKS > 8000 and cost[1] < 2.3 * cost[0]
