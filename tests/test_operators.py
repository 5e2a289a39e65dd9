"""Operators on literal rows: the edge cases that the tables do not hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import scalar, text, vector
from lectern.operators import metrics, relational, search, sequence
from lectern.streaming.quality import fold


def one(df):
    return df.first()[0]


def test_zero_vectors_take_the_value_asked_for(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert one(df.select(vector.cosine(F.col("a"), F.col("b"), 1.0))) == 1.0
    assert one(df.select(vector.cosine(F.col("a"), F.col("b")))) == 0.0


def test_segments_cover_each_session_in_order(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, rng.normal(size=8).tolist()) for s, n in ((1, 1), (2, 2), (3, 40)) for i in range(n)]
    out = sequence.segments(spark.createDataFrame(rows, "session long, seq long, embedding array<double>")).orderBy("session", "segment").collect()
    for s, n in ((1, 1), (2, 2), (3, 40)):
        own = [r for r in out if r["session"] == s]
        assert own[0]["start_seq"] == 0 and own[-1]["end_seq"] == n - 1
        assert all(a["end_seq"] + 1 == b["start_seq"] for a, b in zip(own, own[1:]))
        assert own[-1]["boundary_score"] == 1.0 and sum(r["n"] for r in own) == n


def test_identical_vectors_are_one_segment(spark):
    df = spark.createDataFrame([(1, i, [1.0, 2.0]) for i in range(6)], "session long, seq long, embedding array<double>")
    assert sequence.segments(df).count() == 1


def test_context_window_of_zero_is_the_row_alone(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("abc")], "session long, seq long, text string")
    assert [r["context"] for r in sequence.context_windows(df, 0).orderBy("seq").collect()] == ["a", "b", "c"]
    assert [r["context"] for r in sequence.context_windows(df, 2).orderBy("seq").collect()] == ["a", "a b", "b c"]


def test_clamped_words_never_overlap(spark):
    df = spark.sql("SELECT array(named_struct('word','a','start_ms',5L,'end_ms',3L), named_struct('word','b','start_ms',1L,'end_ms',9L)) AS w")
    out = one(df.select(sequence.clamp_words(F.col("w"))))
    assert [(w["start_ms"], w["end_ms"]) for w in out] == [(5, 6), (6, 9)]


def test_partition_scan_needs_its_key(spark):
    with pytest.raises(ValueError):
        relational.partition_scan(spark.range(3), "id", None)


@pytest.mark.parametrize("slots", [0, 1, 7, 20])
def test_allocation_sums_to_the_slots(spark, slots):
    df = spark.createDataFrame([("a", 0.05), ("b", 0.5), ("c", 0.9)], "topic string, w double")
    assert sum(r["slots"] for r in relational.allocate(df, "topic", F.col("w"), slots).collect()) == slots


def test_merge_matches_null_keys(spark):
    t = spark.createDataFrame([(None, "old"), (1, "old")], "k int, v string")
    s = spark.createDataFrame([(None, "new")], "k int, v string")
    assert sorted(map(str, relational.merge(t, s, ["k"]).collect())) == sorted(map(str, [t.collect()[1], s.collect()[0]]))


def test_undo_restores_exactly_the_moved_rows(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 3)], "id long, topic long")
    merged, audit = relational.merge_topics(df, "topic", 3, 4)
    assert {r["topic"] for r in merged.collect()} == {4}
    assert sorted(relational.undo_merge(merged, audit, "topic").collect()) == sorted(df.collect())


def test_knn_leaves_out_itself_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    assert [r["id"] for r in search.knn(df, df.where("id = 2"), 2).orderBy("rank").collect()] == [1, 3]


def test_repeats(spark):
    df = spark.createDataFrame([("a b c a b c a b c",), ("a b c a b c",), ("",)], "t string").withColumn("w", text.tokens(F.col("t")))
    assert [r[0] for r in df.select(text.repeats(F.col("w"))).collect()] == [True, False, False]


def test_reward_skips_missing_terms_and_collapses_on_zero(spark):
    df = spark.sql("SELECT map('a', 0.25D, 'b', CAST(NULL AS DOUBLE)) AS t, map('a', 0.0D, 'b', 1.0D) AS z")
    weights = {"a": 1.0, "b": 3.0}
    r = df.select(scalar.weighted_geometric_mean(F.col("t"), weights), scalar.weighted_geometric_mean(F.col("z"), weights)).first()
    assert r[0] == pytest.approx(0.25) and r[1] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_distance(a, b):
    table = [[i + j if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
    assert metrics.edit_distance(a, b) == table[-1][-1]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms())
def test_best_assignment(n, m, rnd):
    from itertools import permutations

    grid = np.array([[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)])
    small, large = sorted((n, m))
    g = grid if n <= m else grid.T
    assert metrics.best_assignment(grid) == max(sum(g[i, p[i]] for i in range(small)) for p in permutations(range(large), small))


def test_alerts_wait_and_cool_down():
    rows = [(i, i * 10.0, 1.0) for i in range(8)]
    out, *_ = fold(rows, [], 0, None, 5.0, 30.0)
    assert [e for e, _, _ in out] == [2, 5]


def test_streaming_alerts_equal_the_batch(spark, tmp_path):
    from lectern.streaming.quality import alert_stream, alerts

    rows = spark.createDataFrame([(s, s * 100 + i, 1.7e9 + i * 10.0, float((i * 7 + s) % 11)) for s in (1, 2) for i in range(12)], "session long, event long, at double, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = alert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5.0)
    q = stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(spark.table("alerts").collect()) == sorted(alerts(rows, 5.0).collect())


def test_append_is_idempotent(spark, tmp_path):
    from lectern.streaming.ingest import append_new

    write, path = append_new(str(tmp_path / "t"), ["id"]), str(tmp_path / "t")
    for epoch in (0, 1):
        write(spark.range(5), epoch)
    assert spark.read.parquet(path).count() == 5


def test_matched_purity_brings_a_bounded_grid_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(c), int(t)) for c, t in zip(rng.integers(-1, 60, 900), rng.integers(0, 4, 900) ** 2 // 2)]
    grid = np.zeros((60, 5))
    for c, t in rows:
        if c >= 0:
            grid[c, t] += 1
    df = spark.createDataFrame(rows, "cluster long, truth long")
    kind, fetched = type(df), []
    whole = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: fetched.append(whole(self)) or fetched[-1])
    for a, b in (("cluster", "truth"), ("truth", "cluster")):
        used = df.where("cluster >= 0")
        assert metrics.matched_purity(used, a, b) == pytest.approx(metrics.best_assignment(grid) / grid.sum())
    assert metrics.matched_purity(df, "cluster", "truth") == pytest.approx(metrics.best_assignment(grid) / grid.sum())
    assert max(map(len, fetched)) <= 16 and metrics.matched_purity(df.where("false"), "cluster", "truth") == 0.0


def test_batch_alerts_equal_the_fold_and_hold_no_session_whole(spark):
    from lectern.streaming.quality import alerts

    rng = np.random.default_rng(6)
    rows = [(s, i, float(rng.integers(0, 900)), None if rng.random() < 0.02 else float(rng.integers(0, 11))) for s, n in ((1, 700), (2, 2), (None, 40), (4, 90)) for i in range(n)]
    want = []
    for s in (1, 2, None, 4):
        own = sorted((x[1:] for x in rows if x[0] == s), key=lambda x: (x[1], x[0]))
        want += [(s, *x) for x in fold([(e, a, float("nan") if v is None else v) for e, a, v in own], [], 0, None, 5.0, 30.0)[0]]
    df = spark.createDataFrame(rows, "session long, event long, at double, value double")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = alerts(df, 5.0)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_a_merge_writes_one_audit_row_for_each_row_moved(spark):
    df = spark.range(50).select("id", (F.col("id") % 5).alias("topic"))
    merged, audit = relational.merge_topics(df, "topic", 3, 4)
    assert sorted(map(tuple, audit.collect())) == [("merge", 3, 4, i) for i in range(3, 50, 5)]
    assert sorted(relational.undo_merge(merged, audit, "topic").collect()) == sorted(df.collect())


def test_similar_hashes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    far = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 6)]
    one_bit_a_byte = sum(1 << (8 * k + k) for k in range(8)) - (1 << 64)  # 8 bits, one in each byte; as a signed number
    hashes = [x for h in far[:3] for x in (h, h ^ one_bit_a_byte, h)] + far[3:] + [far[4] ^ 0b1011, far[5]]
    rows = [(i * 3, h) for i, h in enumerate(hashes)]
    want = set()
    for i, h in rows:
        near = sorted((bin((h ^ g) & (2**64 - 1)).count("1"), j) for j, g in rows if j != i)
        want |= {(i, j, d) for d, j in near[:1] if d <= 8}
    df = spark.createDataFrame(rows, "id long, h long")
    for bands in (None, 3, 4, 9):
        assert set(map(tuple, relational.similar_hashes(df, "id", "h", bands=bands).collect())) == want
    assert {d for _, _, d in want} == {0, 3, 8}


def test_probes_keep_the_expected_work_of_a_hash_far_below_all_hashes():
    for n, most in ((10**3, 200), (10**5, 2000), (10**7, 5000), (10**8, 50_000)):
        bands, bits, work = relational.probe_plan(n, 8)
        assert bits == 8 // bands and work < most
