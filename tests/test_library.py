"""Search, topics, governance, parsing and study on literal rows and against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import memory, scalar, syllabus, text
from lectern.operators import cluster, governance, metrics, relational, search, sequence, study
from lectern.operators.textindex import build_text_index
from lectern.session import scratch
from lectern.sources.versions import Conflict, Versions

RNG = np.random.default_rng(11)


def vectors(spark, n=60, d=6, groups=4):
    rows = [(i, i % groups, RNG.normal(size=d).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, topic long, embedding array<double>")


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


# ---- products by blocks: small fixed sides are broadcast, large ones meet in tiles


@pytest.mark.parametrize("block", [1024, 7])
def test_knn_equals_brute_force_on_both_paths(spark, block):
    rows, df = vectors(spark)
    odd = spark.createDataFrame([(900, 0, None), (901, 0, [0.0] * 6), (902, 1, [1.0]), (903, 1, [float("nan")] * 6)], df.schema)
    found = {(r["query"], r["rank"]): r["id"] for r in search.knn(df.unionByName(odd), df.where("id % 3 = 0"), 4, other="topic", block=block).collect()}
    for q, t, v in rows[::3]:
        near = sorted((-round(cosine(v, w), 9), i) for i, u, w in rows if u != t)[:4]
        assert [found[q, k + 1] for k in range(4)] == [i for _, i in near]


@pytest.mark.parametrize("block", [1024, 3])
def test_best_topic_coverage_and_silhouette_equal_brute_force(spark, block):
    rows, df = vectors(spark)
    topics = [(k, RNG.normal(size=6).tolist()) for k in range(5)]
    t = spark.createDataFrame(topics, "topic long, centroid array<double>")
    for r in search.best_topic(df, t, -2.0, block=block).collect():
        own = next(v for i, _, v in rows if i == r["id"])
        assert r["topic"] == max(topics, key=lambda x: cosine(own, x[1]))[0]
    items = t.select(F.col("topic").alias("id"), F.col("centroid").alias("embedding")).unionByName(spark.createDataFrame([(9, None)], "id long, embedding array<double>"))
    for r in search.coverage(items, df, 0.7, 0.4, block=block).collect():
        s = [cosine(topics[r["item"]][1], v) for _, _, v in rows] if r["item"] != 9 else [0.0]
        assert r["best"] == pytest.approx(max(s)) and r["n_near"] == sum(x >= 0.4 for x in s)
        assert r["status"] == ("covered" if max(s) >= 0.7 else "partial" if max(s) >= 0.4 else "uncovered")
    per = []
    for i, c, v in rows:
        mean = {k: np.mean([1 - cosine(v, w) for j, t, w in rows if t == k and j != i]) for k in range(4)}
        a, b = mean[c], min(x for k, x in mean.items() if k != c)
        per.append((b - a) / max(a, b))
    assert metrics.silhouette(df, "topic", block=block).first()["silhouette"] == pytest.approx(np.mean(per))
    assert metrics.silhouette(df.withColumn("topic", F.lit(1)), "topic").first()["silhouette"] == 0.0


def test_hybrid_search_degrades_to_words_and_ranks_both_sources(spark):
    schema = "id long, text string, embedding array<double>, scope string"
    turns = spark.createDataFrame([(1, "red apple", [1.0, 0.0], "a"), (2, "green pear", [0.9, 0.1], "a"), (3, "red red fox", None, "b")], schema)
    notes = spark.createDataFrame([(1, "Red note", [0.0, 1.0], "b")], schema)
    vectors = {"utterance": turns.select("id", "scope", "embedding"), "note_section": notes.select("id", "scope", "embedding")}
    index = build_text_index(turns.withColumn("source", F.lit("utterance")).unionByName(notes.withColumn("source", F.lit("note_section"))), scratch(spark, "two"))
    asked = spark.createDataFrame([(7, "red", [1.0, 0.0]), (8, "red", None), (9, "absent", None)], "query long, text string, embedding array<double>")
    out = search.hybrid_search(index, vectors, asked, 10).orderBy("query", "rank").collect()
    by = {q: [(r["source_type"], r["id"]) for r in out if r["query"] == q] for q in (7, 8, 9)}
    assert by[7][0] == ("note_section", 1) or by[7][0] == ("utterance", 1)
    assert set(by[7]) == {("utterance", 1), ("utterance", 2), ("utterance", 3), ("note_section", 1)}  # found by vector alone, too
    assert set(by[8]) == {("utterance", 1), ("utterance", 3), ("note_section", 1)} and by[9] == []
    assert all(r["vector_rank"] is None for r in out if r["query"] == 8)
    first = next(r for r in out if r["query"] == 7 and (r["source_type"], r["id"]) == ("utterance", 1))
    assert first["fused"] == pytest.approx(1 / (60 + first["lexical_rank"]) + 1 / (60 + first["vector_rank"]))
    scoped = search.hybrid_search(index, vectors, asked.withColumn("scope", F.lit("b")), 10).collect()
    assert {(r["query"], r["source_type"], r["id"]) for r in scoped} == {(q, *x) for q in (7, 8) for x in (("utterance", 3), ("note_section", 1))}


def test_reranking_counts_null_as_zero_and_keeps_the_order_when_down(spark):
    df = spark.createDataFrame([(1, 5, 1, None), (1, 6, 2, 0.5), (1, 7, 3, -0.5)], "query long, id long, rank long, s double")
    order = lambda out: [r["id"] for r in out.orderBy("position").collect()]
    assert order(search.reranked(df, F.col("s"))) == [6, 5, 7]
    down = search.reranked(df, None, 2)
    assert order(down) == [5, 6] and not down.first()["reranked"] and down.first()["rerank_score"] is None


def test_nearest_window_covered_time_and_points(spark):
    points = spark.createDataFrame([(1, 1, 50), (1, 2, 700), (1, 3, 5000), (2, 4, 10)], "session long, point long, at long")
    windows = spark.createDataFrame([(1, 10, 0, 100), (1, 11, 400, 500), (1, 12, 900, 1000)], "session long, window long, start long, end long")
    assert {r["point"]: (r["window"], r["delta"]) for r in search.nearest_window(points, windows).collect()} == {1: (10, 0), 2: (11, 200), 3: (None, None), 4: (None, None)}
    rows = spark.createDataFrame([(1, 0, 0, 130_000), (2, 0, 0, 10)], "session long, seq long, start_ms long, end_ms long")
    gaps = spark.createDataFrame([(1, 50_000, 70_000), (1, 125_000, 400_000)], "session long, start_ms long, end_ms long")
    assert {r["session"]: r["covered_ms"] for r in search.covered_ms(rows, gaps).collect()} == {1: 25_000, 2: 0}
    mids = spark.createDataFrame([(1, 0, 65_000), (1, 1, 400_000)], "session long, seq long, mid long")
    said = gaps.withColumn("speaker", F.lit("A"))
    assert {r["seq"]: r["speaker"] for r in search.at_point(mids, said, "speaker").collect()} == {0: "A", 1: None}


def test_members_and_nearest_segments_equal_brute_force(spark):
    starts = [0, 7, 8, 20, 33]
    spans = [(1, k, a, b - 1) for k, (a, b) in enumerate(itertools.pairwise([*starts, 40]))]
    df = spark.createDataFrame(spans, "session long, segment long, start_seq long, end_seq long")
    rows = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(0, 45, 2)], "session long, seq long")
    want = {(1, i, next(k for _, k, a, b in spans if a <= i <= b)) for i in range(0, 40, 2)}
    assert set(map(tuple, sequence.members(rows, df).collect())) == want
    cues = rows.withColumn("cue", F.lit("c"))
    near = {r["seq"]: r["segment"] for r in sequence.nearest_segment(cues, df).collect() if r["session"] == 1}
    for i in range(0, 45, 2):
        best = sorted((abs(i - a), a, k) for _, k, a, _ in spans if abs(i - a) <= 3)
        assert near.get(i) == (best[0][2] if best else None)


# ---- topics


def test_density_labels_find_blobs_and_noise():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.05, (12, 3)), rng.normal(5, 0.05, (9, 3))
    labels = cluster.density_labels(np.vstack([a, b, [[50.0, 0, 0]]]), 4, 4)
    assert labels[:12].tolist() == [0] * 12 and labels[12:21].tolist() == [1] * 9 and labels[21] == -1
    assert cluster.density_labels(np.zeros((1, 2)), 2, 2).tolist() == [-1] and cluster.density_labels(np.zeros((0, 2)), 2, 2).tolist() == []
    assert [cluster.least_size(n) for n in (2, 7, 9, 100)] == [2, 3, 3, 5]


def test_density_labels_choose_the_most_mass():
    """On small sets: the chosen parts are the best antichain of the hierarchy, tried one by one."""
    for seed in range(12):
        points = np.random.default_rng(seed).normal(size=(9, 2)) + (np.arange(9) % 3)[:, None] * 2.0
        size = 2
        d = np.linalg.norm(points[:, None] - points[None], axis=2)
        core = np.sort(d, axis=1)[:, 1]
        reach = np.maximum(np.maximum(d, core[:, None]), core[None])

        def parts_at(w, reach=reach):
            seen, out = set(), []
            for i in range(9):
                if i not in seen:
                    part, todo = {i}, [i]
                    while todo:
                        x = todo.pop()
                        for y in range(9):
                            if y not in part and reach[x, y] <= w:
                                part.add(y)
                                todo.append(y)
                    seen |= part
                    out.append(frozenset(part))
            return out

        levels = sorted({reach[i, j] for i in range(9) for j in range(i)})
        labels = cluster.density_labels(points, size, 2)
        groups = {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}}
        everything = {p for w in levels for p in parts_at(w)}
        assert groups <= everything and all(len(g) >= size for g in groups) and frozenset(range(9)) not in groups


def test_session_topics_fall_back_and_refuse_long_sessions(spark):
    rows = [(1, 0, [1.0, 0.0])] + [(2, i, [float(i * i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "session long, seq long, embedding array<double>")
    assert {(r["session"], r["topic"], r["outlier_score"]) for r in cluster.session_topics(df).collect()} >= {(1, 0, 0.0)}
    assert all(r["topic"] >= -1 for r in cluster.session_topics(df).collect())
    timed = df.withColumn("start_ms", F.col("seq") * 1000)
    assert cluster.provisional_topics(timed).count() == 0  # fewer than five rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_sessions_are_clustered_by_tiles_as_small_ones_in_a_task(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(s, i * 3, (rng.normal(size=2) * 0.2 + rng.integers(0, 4, 2) * (2 if s == 1 else 1)).tolist()) for s, n in ((1, 90), (2, 61), (3, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "session long, seq long, embedding array<double>")
    one, tiled = (sorted(map(tuple, cluster.session_topics(df, most=most, tile=17).collect())) for most in (4096, 20))
    assert one == tiled and len({t for s, _, t, _ in one if s == 1}) > 2


@pytest.mark.parametrize("seeded", [True, False])
def test_kmeans_equals_plain_rounds(spark, seeded):
    rows, df = vectors(spark, 40, 3)
    seeds = df.where("id < 4") if seeded else None
    assigned, centers = cluster.seeded_kmeans(df, seeds, rounds=5)
    x = np.array([v for _, _, v in rows])
    got = np.array([r["cluster"] for r in assigned.orderBy("id").collect()])
    if seeded:
        c = x[:4].copy()
        for _ in range(5):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[own == k].mean(axis=0) for k in range(4)])
        assert got.tolist() == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    else:
        assert len(set(got)) <= 13
    assert centers.agg(F.sum("n")).first()[0] == 40
    few, none = cluster.seeded_kmeans(df.limit(2), seeds)
    assert few.count() == 0 and none.count() == 0


def test_seeds_are_replaced_and_statuses_follow(spark):
    seeds = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    centers = spark.createDataFrame([(0, 1, [2.0, 0.1])], "cluster long, n long, centroid array<double>")
    assert {r["seed"]: r["replaced"] for r in cluster.replaced_seeds(seeds, centers).collect()} == {1: True, 2: False, 3: False}
    rows = spark.createDataFrame([("a", True, 1), ("a", False, 1), ("b", True, 1), ("c", None, 1), ("d", False, 9)], "subject string, replaced boolean, s int")
    out = {r["subject"]: (r["seed_count"], r["status"], r["cadence"]) for r in cluster.seeding_status(rows, "subject", F.col("s")).collect()}
    assert out == {"a": (1, "seeded", "tight"), "b": (0, "stabilized", "normal"), "c": (0, "not_seeded", "normal"), "d": (1, "seeded", "normal")}


def test_grown_topics_equal_the_fold_over_small_batches(spark):
    rows = [(s, i, RNG.normal(size=3).tolist()) for s, n in ((1, 40), (2, 1), (3, 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "session long, seq long, embedding array<double>")
    want = set()
    for s in (1, 2, 3):
        cents, sizes = [], []
        for _, i, v in [r for r in rows if r[0] == s]:
            sims = [cosine(c, v) for c in cents]
            if sims and max(sims) >= 0.5:
                k = int(np.argmax(sims))
                cents[k] = (np.array(cents[k]) * sizes[k] + v) / (sizes[k] + 1)
                sizes[k] += 1
            else:
                k = len(cents)
                cents.append(np.array(v))
                sizes.append(1)
            want.add((s, i, k))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert set(map(tuple, cluster.grown_topics(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_items_travel_in_packs(spark):
    said = [(1, i, RNG.normal(size=3).tolist()) for i in range(9)] + [(2, 0, [1.0, 0.0, 0.0])]
    items = [(1, i, RNG.normal(size=3).tolist()) for i in range(11)]
    out = cluster.best_in_session(spark.createDataFrame(said, "session long, seq long, embedding array<double>"), spark.createDataFrame(items, "session long, item long, embedding array<double>"), width=4)
    for r in out.collect():
        own = next(v for s, i, v in said if (s, i) == (r["session"], r["seq"]))
        assert r["best"] == pytest.approx(max((cosine(own, v) for s, _, v in items if s == r["session"]), default=0.0))


def test_baselines_and_the_gate(spark):
    sizes = spark.createDataFrame([(1, 50), (2, 3), (3, 1)], "session long, n long")
    assert {(r["session"], r["at"]) for r in sequence.fixed_boundaries(sizes, 20).collect()} == {(1, 20), (1, 40)}
    drawn = sequence.random_boundaries(sizes, 4).collect()
    assert sum(r["session"] == 1 for r in drawn) == 4 and sum(r["session"] == 2 for r in drawn) == 2 and not any(r["session"] == 3 for r in drawn)
    rows = spark.createDataFrame([(1, i, int(i % 10 == 0), int(i % 10 == 0)) for i in range(60)], "session long, seq long, truth int, guess int")
    r = metrics.segmentation_gate(rows, 5, 20, 3).first()
    assert r["p_k"] == 0.0 and r["passed"] and r["beats"]


# ---- governance


def test_missing_and_foreign_rows_look_alike(spark):
    df = spark.createDataFrame([(1, 7), (2, 8)], "id long, user_id long")
    assert governance.require_owned(df, "id", 1, "user_id", 7).count() == 1
    for key, user in ((2, 7), (3, 7)):
        with pytest.raises(governance.NotFound, match=f"id {key} not found"):
            governance.require_owned(df, "id", key, "user_id", user)


def test_nothing_starts_before_a_transcript_is_there(spark):
    df = spark.createDataFrame([(1, "transcribed"), (2, "recording")], "session long, status string")
    assert governance.require_status(df, "session", 1).count() == 1
    with pytest.raises(ValueError, match="has status recording"):
        governance.require_status(df, "session", 2)
    with pytest.raises(governance.NotFound):
        governance.require_status(df, "session", 3)


def test_a_section_with_an_unknown_source_refuses_the_whole_write(spark):
    sections = spark.createDataFrame([(1, None, 0, "old")], "session long, topic string, ordinal long, body string")
    provenance = spark.createDataFrame([(1, None, 0, 5)], "session long, topic string, ordinal long, source long")
    known = spark.createDataFrame([(5,), (6,)], "source long")
    new = spark.createDataFrame([(1, None, 0, "new", [6]), (1, "t", 1, "more", [5, 6])], "session long, topic string, ordinal long, body string, sources array<long>")
    once = governance.persist_sections(sections, provenance, known, new)
    twice = governance.persist_sections(*once, known, new)
    for a, b in (once, twice):
        assert sorted(r["body"] for r in a.collect()) == ["more", "new"] and sorted((r["ordinal"], r["source"]) for r in b.collect()) == [(0, 6), (1, 5), (1, 6)]
    with pytest.raises(governance.Rejected, match="99"):
        governance.persist_sections(sections, provenance, known, new.unionByName(spark.createDataFrame([(1, None, 2, "bad", [99])], new.schema)))


def test_only_the_writer_writes_and_logs_only_grow(spark, tmp_path):
    with pytest.raises(PermissionError):
        governance.guarded_write(spark.range(3), str(tmp_path / "g"))
    with governance.write_authority():
        governance.guarded_write(spark.range(3), str(tmp_path / "g"))
    with pytest.raises(PermissionError):
        governance.guarded_write(spark.range(3), str(tmp_path / "g"))
    log = governance.AppendOnly(spark, str(tmp_path / "log"))
    log.append(spark.range(3))
    assert log.update("id", F.lit(1)) == log.delete(F.col("id") == 1) == 0 and log.append(spark.range(3, 5)) == 2
    assert sorted(r["id"] for r in log.read().collect()) == [0, 1, 2, 3, 4]
    assert log.rewrite(log.read().unionByName(spark.range(9, 10))) == 3  # nothing is lost or changed


def test_a_commit_is_all_or_nothing_wherever_it_is_killed(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path / "s"))
    pair = lambda n: {"a": spark.range(n), "b": spark.range(n, 2 * n)}
    state = lambda: (store.latest(), *(sorted(r["id"] for r in store.read(t).collect()) for t in "ab"))
    assert store.latest() == 0 and store.commit(pair(2)) == 1
    old = state()
    pinned = store.tables(1)

    def killed(*_, **__):
        raise KeyboardInterrupt

    for step in ("stage", "publish"):
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(Versions, step, killed)
            store.commit(pair(3))
        assert state() == old
    with pytest.raises(KeyboardInterrupt):
        store.commit(pair(3), killed)  # in a check, after staging
    fs, path = store._fs()
    fs.create(path(str(tmp_path / "s" / "versions" / "_draft")), False).close()  # as left by a kill just before the rename
    assert state() == old
    assert store.commit({"b": spark.range(1)}) == 2 and state() == (2, [0, 1], [0])
    with pytest.raises(Conflict):
        store.publish(store.stage(pair(4)), based_on=1)
    assert store.tables(1) == pinned and [sorted(r["id"] for r in store.read(t, 1).collect()) for t in "ab"] == [list(x) for x in old[1:]]


def test_sections_and_sources_change_in_one_commit_or_not_at_all(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "n"))
    store.commit({"sections": spark.createDataFrame([(1, None, 0, "old")], "session long, topic string, ordinal long, body string"), "provenance": spark.createDataFrame([(1, None, 0, 5)], "session long, topic string, ordinal long, source long")})
    known = spark.createDataFrame([(5,), (6,)], "source long")
    new = lambda *rows: spark.createDataFrame(list(rows), "session long, topic string, ordinal long, body string, sources array<long>")
    assert governance.durable_sections(store, new((1, None, 0, "new", [6])), known) == 2
    for bad in (new((1, None, 2, "bad", [99])), new((1, "t", 3, "x", [5]), (1, "t", 3, "y", [6]))):
        with pytest.raises(governance.Rejected):
            governance.durable_sections(store, bad, known)
    assert store.latest() == 2 and [r["body"] for r in store.read("sections").collect()] == ["new"] and [r["source"] for r in store.read("provenance").collect()] == [6]


def test_forgetting_a_user_cascades_and_keeps_corrections(spark):
    users, subjects = spark.createDataFrame([(1,), (2,)], "u long"), spark.createDataFrame([(10, 1), (20, 2)], "s long, u long")
    notes, said = spark.createDataFrame([(100, 10), (200, 20)], "n long, s long"), spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "user_id long, c string")
    (u, s, n), c = governance.forget_user(1, users, [(subjects, "s", "u"), (notes, "n", "s")], said)
    assert [r[0] for r in u.collect()] == [2] and [r[0] for r in s.collect()] == [20] and [r[0] for r in n.collect()] == [200]
    assert sorted((str(r["user_id"]), r["c"]) for r in c.collect()) == [("2", "y"), ("None", "x"), ("None", "z")]


def test_corrections_of_unknown_keys_are_recorded_and_change_nothing(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "b", False)], "id long, label string, edited boolean")
    edits = spark.createDataFrame([(1, "A", "u", True), (9, "Z", "u", False)], "id long, value string, user_id string, consent boolean")
    changed, log = governance.capture(rows, edits, "id", "label", "topic_label_edit", ("edited", F.lit(True)))
    assert sorted(map(tuple, changed.collect())) == [(1, "A", True), (2, "b", False)]
    assert {(r["source_id"], r["original_value"], r["corrected_value"]) for r in log.collect()} == {(1, '{"label":"a"}', '{"label":"A"}'), (9, "{}", '{"label":"Z"}')}


def test_backfill_resumes_and_reruns_without_change(spark):
    rows = spark.createDataFrame([(i, "v1" if i % 2 else "v0", i) for i in range(6)], "id long, version string, value long")
    double = F.col("value") * 2
    half = governance.backfilled(rows.where("id < 3"), rows.where("false"), double, "v1", "v2")
    done = governance.backfilled(rows, half, double, "v1", "v2")
    want = {(i, "v2" if i % 2 else "v0", i * 2 if i % 2 else i) for i in range(6)}
    assert set(map(tuple, done.collect())) == want == set(map(tuple, governance.backfilled(done, done, double, "v1", "v2").collect()))


def test_versions_fall_back_to_the_last_deployed(spark):
    v = spark.createDataFrame([("a", "1", "deployed", "3", 1), ("a", "2", "deployed", "3", 2), ("a", "3", "draft", "3", 3), ("b", "1", "draft", "2", 1)], "agent string, version string, status string, current string, ordinal long")
    pick = lambda wanted=None: {r["agent"]: (r["version"], r["fallback"]) for r in governance.version_of(v, "agent", wanted).collect()}
    assert pick() == {"a": ("3", False)} and pick("1") == {"a": ("1", False), "b": ("1", False)} and pick("9") == {"a": ("2", True)}
    with pytest.raises(governance.NotFound):
        governance.require_version(v, "agent", "b", "7")


def test_owners_see_their_own_rows_and_private_columns_go(spark):
    df = spark.createDataFrame([(1, True, "a"), (2, None, "b"), (2, True, "c")], "user_id long, consent boolean, x string")
    got = lambda out: sorted(r["x"] for r in out.collect())
    assert got(governance.consented(df, F.col("consent"), "user_id")) == ["a", "c"]
    assert got(governance.consented(df, F.col("consent"), "user_id", owner=2)) == ["b", "c"]
    assert governance.allowed_columns(df, ["user_id", "x", "nope"]).columns == ["x"]


def test_edits_stick(spark):
    rows = spark.createDataFrame([(1, ["a"], True), (2, ["b"], False), (3, ["c"], False)], "id long, covered_by array<string>, manually_corrected boolean")
    edits = spark.createDataFrame([(2, "link", "z"), (2, "unlink", "b"), (3, "replace", "y")], "id long, action string, link string")
    assert sorted((r[0], r[1], r[2]) for r in governance.linked(rows, edits, "id").collect()) == [(1, ["a"], True), (2, ["z"], True), (3, ["y"], True)]


def test_retry_stops_at_the_cap_and_reconciliation_tells_silence(spark):
    s = spark.sql("SELECT * FROM VALUES (1, 'transcribed', false, 0, NULL, TIMESTAMP '2024-01-01 00:00:00'), (2, 'transcribed', false, 3, NULL, TIMESTAMP '2024-01-01 00:00:00'), (3, 'transcribed', true, 0, NULL, TIMESTAMP '2024-01-01 00:00:00'), (4, 'transcribed', false, 1, TIMESTAMP '2024-01-01 11:30:00', TIMESTAMP '2024-01-01 00:00:00'), (5, 'recording', false, 0, NULL, TIMESTAMP '2024-01-01 00:00:00'), (6, 'recording', false, 0, NULL, TIMESTAMP '2024-01-01 00:00:00'), (7, 'recording', false, 0, NULL, TIMESTAMP '2024-01-01 11:50:00') AS t(session, status, notes_ready, retry_count, last_retry_at, created_at)")
    now = spark.sql("SELECT TIMESTAMP '2024-01-01 12:00:00' AS now")
    assert [(r["session"], r["retry_count"]) for r in study.to_retry(s, now).collect()] == [(1, 1)]
    heard = spark.sql("SELECT 6 AS session, TIMESTAMP '2024-01-01 01:00:00' AS last_utterance_at")
    assert {r["session"]: r["status"] for r in study.reconciled(s, heard, now).collect()} == {5: "failed", 6: "transcribed"}


# ---- texts, parsing, study


def test_syllabus_lines(spark):
    lines = ["1.1 too early", "Module 1: Cells", "1.1 Walls", "2.4 Lost", "References: Smith", "Midterm 1: Parts (weight 30%)", "Week 2 - Labs", "hello", "Module 2: Genes", "2.1 Helix", "1.2 Cores"]
    df = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], "syllabus string, at long, line string")
    out = [(r["item_type"], r["ordinal"], r["parent_ordinal"], r["title"]) for r in syllabus.parsed_lines(df, "syllabus", "at").orderBy("item").collect()]
    assert out == [
        ("module", 0, None, "Cells"), ("topic", 0, 0, "Walls"), ("topic", 1, 0, "Lost"), ("assessment", 0, None, "Midterm: Parts"), ("schedule", 0, None, "Labs"), ("module", 1, None, "Genes"), ("topic", 0, 1, "Helix"), ("topic", 2, 0, "Cores"),
    ]
    by = {r["title"]: r for r in syllabus.parsed_lines(df, "syllabus", "at").collect()}
    assert by["Midterm: Parts"]["weight_pct"] == 30.0 and by["Labs"]["week_number"] == 2 and by["Lost"]["references"] == ["Smith"] and by["Genes"]["description"] == "too early"


def test_votes_diagrams_and_bodies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.structure_vote(F.lit(0.7)))["prediction"] == "syllabus" and one(text.structure_vote(F.lit(0.1)))["confidence"] == pytest.approx(0.9)
    assert one(text.routed(F.lit("mixed"), text.density_vote(F.lit("nothing of that kind here"))))["route_target"] == "db_2"
    assert one(text.steps(F.lit("It goes: boil → stir -> . serve."))) == ["boil", "stir", "serve"]
    drawn = one(text.mermaid(F.array(F.lit("a b"), F.lit("c")), F.lit("flowchart")))
    assert drawn == 'graph TD\n    a_b["a b"]\n    c["c"]\n    a_b --> c' and one(text.valid_diagram(F.lit(drawn)))
    assert not one(text.valid_diagram(F.lit("pie\n x\n y"))) and not one(text.valid_diagram(F.lit("graph TD\n a\n b"))) and not one(text.valid_diagram(F.lit(" ")))
    assert one(text.body_checks(F.lit("x\n```mermaid\n \n```\n$a$ $")))[0:3] == (False, False, True)
    assert not one(text.body_checks(F.lit("Source utt_ids: [a, b]")))["prose"]
    assert [tuple(p) for p in one(text.places(F.lit("aé12b3"), "[0-9]+"))] == [(2, 4), (5, 6)]
    assert one(text.greeting(F.lit("hola, buenas tardes")))["language"] == "es" and one(text.greeting(F.lit("no"))) is None
    assert one(text.plain_text(F.lit("  A,  b!\tC  "))) == "a b\tc"
    assert one(text.display_label(F.lit(""), F.array(), "none")) is not None


def test_decisions_strict_and_lenient(spark):
    raw = '[{"seq":1,"is_relevant":true,"confidence":0.5},{"seq":1,"is_relevant":false,"confidence":0.6},{"seq":2,"confidence":0.5},{"seq":9,"is_relevant":true,"confidence":0.5},{"seq":3,"is_relevant":true,"confidence":1.5}]'
    df = spark.createDataFrame([(raw,), ("no json",), ('[{"seq":1,"is_relevant":true,"confidence":1.0},{"seq":2,"is_relevant":true,"confidence":0.0},{"seq":3,"is_relevant":true,"confidence":0.5}]',)], "p string")
    asked = F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    out = df.select(study.strict_decisions(F.col("p"), asked).alias("s"), study.lenient_decisions(F.col("p"), asked).alias("l")).collect()
    assert out[0]["s"] is None and [(d["seq"], d["is_relevant"]) for d in out[0]["l"]] == [(1, True)]
    assert out[1]["s"] is None and out[1]["l"] is None and len(out[2]["s"]) == 3


def test_memory_follows_the_published_formulas(spark):
    first = spark.range(1, 5).select(memory.reviewed(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0), F.col("id")).alias("m")).select("m.*").collect()
    assert [r["stability"] for r in first] == list(memory.WEIGHTS[:4]) and first[3]["difficulty"] == 1.0
    again = spark.range(1, 5).select(memory.reviewed(F.lit(10.0), F.lit(5.0), F.lit(10), F.col("id")).alias("m")).select("m.*").collect()
    assert all(r["recall"] == pytest.approx(0.9) for r in again)  # after as many days as the stability
    s = [r["stability"] for r in again]
    assert s[0] < 10 < s[1] < s[2] < s[3] and [r["interval_days"] for r in again] == [max(1, round(x)) for x in s]
    assert again[0]["difficulty"] > again[1]["difficulty"] > again[2]["difficulty"] > again[3]["difficulty"]


def test_signals(spark):
    assert metrics.snr_db(np.zeros(64)) == 0.0 == metrics.snr_db(np.ones(3))
    tone = np.sin(np.arange(512) * 0.3)
    noise = np.random.default_rng(0).normal(size=512)
    assert metrics.snr_db(tone + 0.01 * noise) > metrics.snr_db(tone + noise) > metrics.snr_db(noise)
    r = spark.sql("SELECT array(1.0D, -1.0D, 0.0D, 0.0D) AS v, CAST(array() AS array<double>) AS e").select(scalar.rms_db(F.col("v")), scalar.clipping_rate(F.col("v")), scalar.clipping_rate(F.col("e"))).first()
    assert r[0] == pytest.approx(10 * np.log10(0.5)) and r[1] == 0.5 and r[2] == 0.0


def test_costs_without_a_price_are_nothing(spark):
    runs = spark.createDataFrame([(1, "a", 2.0), (1, "b", 5.0), (2, "b", 1.0)], "session long, model string, units double")
    prices = spark.createDataFrame([("a", 3.0)], "model string, price double")
    assert {r["session"]: r["cost"] for r in relational.costs(runs, prices, "model").collect()} == {1: 6.0, 2: 0.0}


def test_rates_of_empty_references(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (1, 4)], "e long, n long")
    assert [r[0] for r in df.select(metrics.rate(F.col("e"), F.col("n"))).collect()] == [0.0, 1.0, 0.25]


# ---- streams


def run_stream(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("c_" + name))).trigger(availableNow=True).start()
    assert q.awaitTermination(180)


def test_repeats_within_the_horizon_are_dropped(spark, tmp_path):
    from lectern.streaming.ingest import deduplicated

    rows = spark.sql("SELECT session, sequence, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, h) AS received_at FROM VALUES (1, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 3), (1, 1, 5) AS t(session, sequence, h)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "received_at", ["session", "sequence"])
    run_stream(stream, "deduped", tmp_path)
    assert sorted((r["session"], r["sequence"]) for r in spark.table("deduped").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_sessions_are_final_once_and_only_without_gaps(spark, tmp_path):
    from lectern.streaming.ingest import complete_sessions, finalised

    schema = "session long, sequence long, final boolean, hour int"
    parts = [[(1, 2, True, 0), (1, 0, False, 0), (2, 1, True, 0), (3, 0, True, 0), (4, 1, True, 0)], [(1, 1, False, 1), (1, 2, True, 1), (3, 0, True, 1)], [(1, 1, False, 80), (2, 1, True, 80)], [(4, 0, False, 2), (5, 0, True, 81)]]
    timed = lambda df: df.withColumn("received_at", F.timestamp_seconds(F.col("hour") * 3600 + 1_700_000_000)).drop("hour")
    for k, p in enumerate(parts):
        timed(spark.createDataFrame(p, schema)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    source = spark.readStream.schema("session long, sequence long, final boolean, received_at timestamp, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(finalised(source), "final_sessions", tmp_path)
    # session 4 misses its first chunk until long after the horizon: that chunk comes too late
    assert sorted(map(tuple, spark.table("final_sessions").collect())) == [(1, 3), (3, 1), (5, 1)]
    batch = complete_sessions(spark.createDataFrame([r for p in parts for r in p], schema)).where("ready")
    assert sorted(r["session"] for r in batch.collect()) == [1, 3, 4, 5]


def test_ranges_of_numbers_merge():
    from lectern.streaming.ingest import merged

    assert merged({}, [3, 1, 2, 7]) == {1: 4, 7: 8} and merged({1: 4, 7: 8}, [0, 5, 5, 6]) == {0: 4, 5: 8} and merged({0: 4, 5: 8}, [4]) == {0: 8}


def test_a_long_session_keeps_a_small_state_and_goes_on_after_a_restart(spark, tmp_path):
    from lectern.streaming.ingest import appended, finalised

    rng = np.random.default_rng(1)
    offsets, sink, source = str(tmp_path / "offsets"), str(tmp_path / "sink"), str(tmp_path / "in")
    chunk = lambda numbers, hour: spark.createDataFrame([(9, int(i), bool(i == 499)) for i in numbers], "session long, sequence long, final boolean").withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000 + hour * 600)))
    stream = lambda: finalised(spark.readStream.schema("session long, sequence long, final boolean, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(source))
    ranges = lambda: spark.read.format("statestore").option("stateVarName", "ranges").load(offsets).count()
    for k in range(3):  # out of order and repeated inside a batch; number 250 is missing
        own = [i for i in rng.permutation(np.arange(k * 100, k * 100 + 130)) if i != 250]
        chunk(own + own[:5], k).coalesce(1).write.mode("append").parquet(source)
        assert appended(stream(), sink, offsets).count() == 0
        assert ranges() <= 2  # 330 numbers by then
    chunk(range(300, 500), 4).coalesce(1).write.mode("append").parquet(source)
    assert appended(stream(), sink, offsets).count() == 0 and ranges() == 2
    chunk([250, 251], 5).coalesce(1).write.mode("append").parquet(source)
    assert list(map(tuple, appended(stream(), sink, offsets).collect())) == [(9, 500)] and ranges() == 0
    chunk([0, 499], 6).coalesce(1).write.mode("append").parquet(source)
    assert appended(stream(), sink, offsets).count() == 1  # once, also after its end


def test_alerts_carry_their_state_over_batches_and_drop_late_rows(spark, tmp_path):
    from lectern.streaming.ingest import appended
    from lectern.streaming.quality import alert_stream, alerts

    rows = [(s, s * 1000 + i, 1.7e9 + i * 10.0, float((i * 7 + s) % 11)) for s in (1, 2) for i in range(40)]
    schema = "session long, event long, at double, value double"
    for k in range(4):
        spark.createDataFrame([r for r in rows if (r[1] % 1000) // 10 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: alert_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 5.0, idle="1 minutes")
    out = appended(stream(), str(tmp_path / "out"), str(tmp_path / "offsets"))
    assert sorted(out.collect()) == sorted(alerts(spark.createDataFrame(rows, schema), 5.0).collect())
    n = out.count()
    spark.createDataFrame([(1, 9000 + i, 1.7e9 + i, 0.0) for i in range(9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert appended(stream(), str(tmp_path / "out"), str(tmp_path / "offsets")).count() == n


def test_a_sink_reads_only_touched_parts_and_knows_null_keys(spark, tmp_path):
    from lectern.streaming.ingest import append_new

    path = str(tmp_path / "sink")
    write = append_new(path, ["session", "sequence"], F.col("session") % 4)
    rows = spark.createDataFrame([(1, 1), (1, None), (None, 2), (None, None), (2, 7)], "session long, sequence long")
    for epoch in (0, 1):
        write(rows, epoch)
    assert spark.read.parquet(path).count() == 5
    write(spark.createDataFrame([(6, 7), (1, None)], rows.schema), 2)
    assert spark.read.parquet(path).count() == 6
    assert len(list((tmp_path / "sink").glob("part_of_table=*"))) == 3


def test_preprocessing_and_status_flips_serve_streams(spark, tmp_path):
    from lectern.streaming.ingest import first_chunk_status, preprocessed

    rows = spark.sql("SELECT 1 AS session, 0 AS sequence, array(named_struct('start_ms', 0, 'end_ms', 30), named_struct('start_ms', 20, 'end_ms', 90)) AS regions, 80 AS duration_ms, true AS final")
    rows.write.parquet(str(tmp_path / "in"))
    run_stream(preprocessed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "pre", tmp_path)
    assert [(r["speech_ratio"], r["has_speech"]) for r in spark.table("pre").collect()] == [(1.0, True)]
    s = spark.createDataFrame([(1, "created"), (2, "created"), (3, "failed")], "session long, status string")
    once = first_chunk_status(s, spark.createDataFrame([(1,), (1,), (3,)], "session long"))
    assert sorted(map(tuple, once.collect())) == [(1, "recording"), (2, "created"), (3, "failed")]


def test_versions_of_a_dataset_never_change(spark, tmp_path):
    from lectern.sources.tables import write_versioned

    write_versioned(spark.range(2), str(tmp_path / "d"), "v1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_versioned(spark.range(3), str(tmp_path / "d"), "v1")


# ---- another database


def test_a_foreign_table_is_read_in_ranges_with_its_filters_pushed_down(spark, tmp_path):
    from lectern.sources.tables import read_database

    url, driver = f"jdbc:derby:{tmp_path}/syllabus;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id AS item", "'title ' || id AS title").write.format("jdbc").options(url=url, dbtable="items", driver=driver).save()
    items = read_database(spark, url, "items", "item", 0, 100, 4, driver=driver)
    assert items.rdd.getNumPartitions() == 4 and items.count() == 100
    few = items.where("item >= 90 AND item <> 95").select("title")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan.upper() or ">= 90" in plan or "PushedFilters: [*" in plan
    assert sorted(r["title"] for r in few.collect()) == [f"title {i}" for i in range(90, 100) if i != 95]


# ---- arrays without quadratic steps


def test_multisets_places_and_word_times_equal_plain_loops(spark):
    from collections import Counter

    rng = np.random.default_rng(12)
    pairs = [([f"w{k}" for k in rng.integers(0, 9, int(rng.integers(0, 40)))], [f"w{k}" for k in rng.integers(0, 9, int(rng.integers(0, 40)))]) for _ in range(20)] + [([], []), ([], ["a"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for a, b, f1 in df.select("a", "b", study.token_f1(F.col("a"), F.col("b"))).collect():
        assert f1 == pytest.approx(2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0)
    times = [[(f"w{i}", int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(-3, 60, n), rng.integers(-5, 9, n), strict=True))] for n in (0, 1, 2, 9, 16, 50)]
    words = spark.createDataFrame([(t,) for t in times], "w array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    for told, out in words.select("w", sequence.clamp_words(F.col("w"))).collect():
        at, want = 0, []
        for w, s, e in told:
            s = max(s, at)
            at = max(e, s + 1)
            want.append((w, s, at))
        assert [tuple(x) for x in out] == want
    texts = ["aab baab", "", "b", "éab ab aab"]
    for t, found in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.places(F.col("t"), "a+b")).collect():
        import re

        assert [tuple(p) for p in found] == [m.span() for m in re.finditer("a+b", t)]


def test_repeats_and_overlaps_of_words_are_counted_batch_by_batch(spark):
    import random
    from collections import Counter

    draw = random.Random(3)
    lists = [None, [], ["a"], ["a", "b"], ["a"] * 5, ["a"] * 4, ["x", "y", "z"] * 3, ["x", "y", "z"] * 2 + ["x", "y"]]
    lists += [[draw.choice("abcd"[: draw.randint(1, 4)]) for _ in range(draw.randint(0, 40))] for _ in range(300)]
    rows = [(i, a, draw.choice(lists)) for i, a in enumerate(lists)]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").repartition(3)
    found = df.select("a", "b", text.repeats(F.col("a")).alias("r"), study.token_f1(F.col("a"), F.col("b")).alias("f"))
    for a, b, r, f in found.collect():
        most = max((n for k in (3, 4, 5) for n in Counter(tuple(a[i : i + k]) for i in range(len(a) - k + 1)).values()), default=0) if a else 0
        assert r == (most >= 3)
        if a is None or b is None:
            assert f is None
        else:
            assert f == (2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan  # no list is walked element by element
