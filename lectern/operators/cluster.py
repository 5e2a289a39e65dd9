"""Topics: density clustering of a session, seeded k-means over all rows, keywords, provisional topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.longscan import positioned
from lectern.operators.search import BLOCK, Side, best_topic, compared
from lectern.operators.sequence import mean_pool
from lectern.session import scratch

#: Rows of a session that one task clusters, at most, as it holds the square of their number; rows of a tile of a larger one.
SESSION_MOST, TILE = 4096, 2048


def least_size(n: int, most: int = 5) -> int:
    """The smallest cluster of n points: a third of them, 2 to ``most``."""
    return max(2, min(most, -(-n // 3), n))


def _joined(comp: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of Borůvka: of edges (w, lo, hi) that leave the component of ``comp[lo]`` or ``comp[hi]`` the chosen ones, and the components after."""
    order = np.lexsort((hi, lo, w))
    chosen: set[int] = set()
    for ends in (comp[lo[order]], comp[hi[order]]):
        chosen |= set(order[np.unique(ends, return_index=True)[1]].tolist())
    best: dict[int, int] = {}
    for e in sorted(chosen, key=lambda e: (w[e], lo[e], hi[e])):
        for c in (int(comp[lo[e]]), int(comp[hi[e]])):
            best.setdefault(c, e)
    up = {int(c): int(c) for c in np.unique(comp)}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for e in sorted(set(best.values())):
        x, y = find(int(comp[lo[e]])), find(int(comp[hi[e]]))
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(e)
    values, at = np.unique(comp, return_inverse=True)
    return np.array(kept, dtype=np.int64), np.array([find(int(c)) for c in values])[at]


def _spanning_tree(d: np.ndarray) -> np.ndarray:
    """Edges (i, j, distance) of the minimum spanning tree of a full distance matrix, shortest first; ties go by i, then j."""
    n = len(d)
    comp, edges, rows = np.arange(n), [], np.arange(n)
    while len(np.unique(comp)) > 1:
        open_ = np.where(comp[:, None] == comp[None], np.inf, d)
        j = open_.argmin(axis=1)  # the first of equal ones is also the first in the order of (i, j)
        w, lo, hi = open_[rows, j], np.minimum(rows, j), np.maximum(rows, j)
        kept, comp = _joined(comp, w, lo, hi)
        edges += list(zip(lo[kept].tolist(), hi[kept].tolist(), w[kept].tolist(), strict=True))
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1])))


def density_labels(points: np.ndarray, size: int, samples: int) -> np.ndarray:
    """Labels by density: -1 is noise, clusters count from 0 by their first point.

    Points are linked by mutual reachability (the larger of their distance and both distances to the ``samples``-th
    neighbour, itself included). The hierarchy is cut where parts of at least ``size`` points split off, and of each part
    and its descendants the more persistent is chosen: the excess of mass. The whole is never a cluster by itself.
    """
    n = len(points)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(axis=2), 0)) if n <= 256 else _distances(points)
    core = np.partition(d, min(samples, n) - 1, axis=1)[:, min(samples, n) - 1]
    return tree_labels(_spanning_tree(np.maximum(np.maximum(d, core[:, None]), core[None])), n, size)


def tree_labels(tree: np.ndarray, n: int, size: int) -> np.ndarray:
    """The labels that a spanning tree's edges (i, j, distance), shortest first, give its n points; memory is linear in them."""
    up, count = list(range(n)), n
    at: dict[int, tuple[int, int, float]] = {}  # a merged part: its two parts and their distance
    root, many, first = list(range(n)), [1] * n, list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j, w in tree.tolist():
        a, b = root[find(int(i))], root[find(int(j))]
        at[count] = (a, b, w)
        many.append(many[a] + many[b])
        first.append(min(first[a], first[b]))
        up[find(int(i))] = find(int(j))
        root[find(int(j))] = count
        count += 1
    density = lambda w: 1 / max(w, 1e-12)
    # condensed: (part at which it is born, density there, its children, how much mass it holds)
    born, children, mass, start = [], [], [], [(count - 1, 0.0, -1)]
    while start:
        node, birth, parent = start.pop()
        me = len(born)
        born.append(node)
        children.append([])
        mass.append(0.0)
        if parent >= 0:
            children[parent].append(me)
        while node in at:
            a, b, w = at[node]
            lam, big = density(w), [x for x in (a, b) if many[x] >= size]
            if len(big) == 2:
                mass[me] += many[node] * (lam - birth)
                start += [(x, lam, me) for x in big]
                break
            gone = sum(many[x] for x in (a, b) if x not in big)
            mass[me] += gone * (lam - birth)
            if not big:
                break
            node = big[0]
    chosen: list[int] = []
    best = list(mass)
    keep = [True] * len(born)
    for c in reversed(range(len(born))):
        below = sum(best[x] for x in children[c])
        if c == 0 or below > mass[c]:
            keep[c], best[c] = False, below
    todo = [0]
    while todo:
        c = todo.pop()
        if keep[c]:
            chosen.append(c)
        else:
            todo += children[c]
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(chosen, key=lambda c: first[born[c]])):
        todo = [born[c]]
        while todo:
            node = todo.pop()
            if node in at:
                todo += at[node][:2]
            else:
                labels[node] = k
    return labels


def _distances(points: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * points @ points.T, 0))


def session_topics(rows: DataFrame, most: int = SESSION_MOST, tile: int = TILE) -> DataFrame:
    """Density clusters of each session's vectors: (session, seq, topic, outlier_score).

    One vector is a topic of its own, and vectors without any dense part are one topic together; else rows outside the
    clusters are noise (topic -1, outlier 1). A session of up to ``most`` rows is clustered in one task; a longer one by tiles of rows, whose
    pairs are many tasks' work. ``rows`` has (session, seq, embedding).
    """
    counted = rows.select("session", "seq", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session")))
    kind = rows.schema["session"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        points = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return _told(pdf, density_labels(points, least_size(len(points)), least_size(len(points))))

    found = counted.where(F.col("n") <= most).groupBy("session").applyInPandas(run, f"session {kind}, seq long, topic long, outlier_score double")
    large = counted.where(F.col("n") > most)
    return found if large.isEmpty() else found.unionByName(_large_sessions(large, kind, tile))


def _told(pdf: pd.DataFrame, labels: np.ndarray) -> pd.DataFrame:
    labels = np.zeros(len(labels), int) if (labels < 0).all() else labels
    return pd.DataFrame({"session": pdf["session"], "seq": pdf["seq"], "topic": labels, "outlier_score": (labels < 0).astype(float)})


def _met(points: DataFrame, tile: int, work: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``work(rows, columns, distances)`` says of each pair of tiles of a session; a tile meets each other one once, and itself."""
    tiles, own = F.floor((F.col("n") - 1) / tile), F.floor(F.col("position") / tile)
    a = points.withColumns({"side": F.lit(0), "ti": own}).withColumn("tj", F.explode(F.sequence(own, tiles)))
    b = points.withColumns({"side": F.lit(1), "tj": own}).withColumn("ti", F.explode(F.sequence(F.lit(0).cast("long"), own)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["side"] == k].sort_values("position", ignore_index=True) for k in (0, 1))
        u, v = (np.stack(z["embedding"].to_numpy()) for z in (x, y))
        d = np.sqrt(np.maximum((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None] - 2 * u @ v.T, 0))
        if x["position"].iloc[0] == y["position"].iloc[0]:
            np.fill_diagonal(d, 0.0)
        return work(x, y, d)

    return a.unionByName(b.select(a.columns)).groupBy("session", "ti", "tj").applyInPandas(meet, schema)


def _large_sessions(rows: DataFrame, kind: str, tile: int) -> DataFrame:
    """``session_topics`` of sessions too large for a matrix: neighbours' distances and each round's shortest ways out of a component by pairs of tiles.

    A session's spanning tree and components are a few numbers a row; they alone meet in one task.
    """
    spark = rows.sparkSession
    kept = lambda df, name: (df.write.parquet(path := scratch(spark, name)), spark.read.schema(df.schema).parquet(path))[1]
    points = kept(positioned(rows, "session", "seq"), "points")

    def nearest(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        k = least_size(int(x["n"].iloc[0]))
        parts = [(x, np.sort(d, axis=1)[:, :k])] + ([(y, np.sort(d, axis=0).T[:, :k])] if x["position"].iloc[0] != y["position"].iloc[0] else [])
        return pd.concat([pd.DataFrame({"session": z["session"], "position": z["position"], "near": list(near)}) for z, near in parts])

    near = _met(points.select("session", "position", "n", "embedding"), tile, nearest, f"session {kind}, position long, near array<double>")
    size = F.array_max(F.array(F.lit(2), F.array_min(F.array(F.lit(5).cast("long"), F.ceil(F.col("n") / 3)))))
    core = near.groupBy("session", "position").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    points = points.join(core, ["session", "position"]).withColumn("core", F.get("near", (size - 1).cast("int"))).drop("near")
    points = kept(points.withColumn("comp", F.col("position")), "points")
    tree = None

    def out(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        reach = np.maximum(np.maximum(d, x["core"].to_numpy()[:, None]), y["core"].to_numpy()[None])
        cx, cy = x["comp"].to_numpy(), y["comp"].to_numpy()
        reach = np.where(cx[:, None] == cy[None], np.inf, reach)
        px, py = x["position"].to_numpy(), y["position"].to_numpy()
        j, i = reach.argmin(axis=1), reach.argmin(axis=0)
        comp = np.concatenate([cx, cy])
        w = np.concatenate([reach[np.arange(len(px)), j], reach[i, np.arange(len(py))]])
        a, b = np.concatenate([px, px[i]]), np.concatenate([py[j], py])
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo, w, comp))
        first = order[np.append(True, comp[order][1:] != comp[order][:-1])]  # of each component the shortest way out of this pair of tiles
        first = first[np.isfinite(w[first])]
        return pd.DataFrame({"session": x["session"].iloc[0], "comp": comp[first], "w": w[first], "lo": lo[first], "hi": hi[first]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["is_edge"] == 0].sort_values("position")
        edges = pdf[pdf["is_edge"] == 1].drop_duplicates(["lo", "hi"])
        comp = known["comp"].to_numpy()
        w, lo, hi = (edges[c].to_numpy() for c in ("w", "lo", "hi"))
        taken, now = _joined(comp, w, lo.astype(np.int64), hi.astype(np.int64))
        moved = pd.DataFrame({"session": key[0], "is_edge": 0, "position": known["position"], "comp": now, "w": np.nan, "lo": -1, "hi": -1})
        return pd.concat([moved, pd.DataFrame({"session": key[0], "is_edge": 1, "position": -1, "comp": -1, "w": w[taken], "lo": lo[taken], "hi": hi[taken]})])

    state = "is_edge int, position long, comp long, w double, lo long, hi long"
    while True:
        ways = _met(points.select("session", "position", "n", "embedding", "core", "comp"), tile, out, f"session {kind}, comp long, w double, lo long, hi long")
        ways = kept(ways.groupBy("session", "comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("session", "e.*"), "ways")
        if ways.isEmpty():
            break
        none = lambda t: F.lit(-1).cast(t)
        members = points.join(ways.select("session").distinct(), "session", "left_semi").select("session", F.lit(0).alias("is_edge"), "position", "comp", none("double").alias("w"), none("long").alias("lo"), none("long").alias("hi"))
        edges = ways.select("session", F.lit(1).alias("is_edge"), none("long").alias("position"), none("long").alias("comp"), "w", "lo", "hi")
        done = kept(members.unionByName(edges).groupBy("session").applyInPandas(merge, f"session {kind}, {state}"), "merged")
        part = done.where("is_edge = 1").select("session", "w", "lo", "hi")
        tree = part if tree is None else tree.unionByName(part)
        now = done.where("is_edge = 0").select("session", "position", F.col("comp").alias("after"))
        points = kept(points.join(now, ["session", "position"], "left").withColumn("comp", F.coalesce("after", "comp")).drop("after"), "points")

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["is_edge"] == 0].sort_values("position", ignore_index=True)
        edges = pdf[pdf["is_edge"] == 1].sort_values(["w", "lo", "hi"])
        return _told(own, tree_labels(edges[["lo", "hi", "w"]].to_numpy(), len(own), least_size(len(own))))

    listed = points.select("session", "seq", F.lit(0).alias("is_edge"), "position", F.lit(-1.0).alias("w"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    edges = tree.select("session", F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("is_edge"), F.lit(-1).cast("long").alias("position"), "w", "lo", "hi")
    return listed.unionByName(edges).groupBy("session").applyInPandas(label, f"session {kind}, seq long, topic long, outlier_score double")


def provisional_topics(rows: DataFrame, window_ms: int = 600_000, least: int = 5) -> DataFrame:
    """Early topics from the first minutes of each session: (session, topic, n, start_seq, end_seq); noise is left out.

    Sessions with fewer than ``least`` rows in the window have none. ``rows`` has (session, seq, start_ms, embedding).
    """
    own = Window.partitionBy("session")
    early = rows.withColumn("first_ms", F.min("start_ms").over(own)).where(F.col("start_ms") - F.col("first_ms") < window_ms)
    early = early.withColumn("many", F.count(F.lit(1)).over(own)).where(F.col("many") >= least)
    found = session_topics(early.select("session", "seq", "embedding")).where("topic >= 0")
    return found.groupBy("session", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"))


def _nearest_center(data: DataFrame, centers: DataFrame, block: int) -> DataFrame:
    """(id, cluster): each row's nearest center by Euclidean distance, rounded to nine digits; ties take the smaller cluster."""
    wide = lambda df, key: df.select(F.col(key).alias("id"), F.concat("embedding", F.array(F.lit(1.0))).alias("embedding"))  # noqa: E731  no vector is without a length then

    def near(a: Side, b: Side) -> dict[str, np.ndarray]:
        order = np.argsort(b.ids, kind="stable")
        x, c = a.units * a.lengths[:, None], (b.units * b.lengths[:, None])[order]
        d = ((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None]).round(9)
        at = d.argmin(axis=1) if len(a.ids) else np.zeros(0, np.int64)
        return {"id": a.ids, "cluster": b.ids[order][at], "distance": d[np.arange(len(at)), at]}

    found = compared(wide(data, "id"), wide(centers, "cluster"), near, "id long, cluster long, distance double", block=block)
    return found.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("best")).select("id", "best.cluster")


def seeded_kmeans(rows: DataFrame, seeds: DataFrame | None = None, rounds: int = 300, least: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """k-means by Lloyd's rounds from seeds, until no center moves or ``rounds`` are done: (id, cluster) of all rows, and (cluster, n, centroid) of the centers.

    ``seeds`` has (id, embedding); clusters are numbered by their seeds' order. Without seeds a third of the rows' number are drawn by a
    hash of their id. Fewer than ``least`` rows make no clusters. Rows meet centers in tiles and blocks, centers are means by cluster, both
    written once a round: any number of centers will do, and none reaches the driver. A cluster that loses all rows is left out; ties
    take the smaller one.
    """
    spark: SparkSession = rows.sparkSession
    kept = lambda df, name: (df.write.parquet(path := scratch(spark, name)), spark.read.schema(df.schema).parquet(path))[1]
    data = kept(rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL"), "points")
    n = data.count()
    if seeds is None:
        seeds = data.orderBy(F.xxhash64("id"), "id").limit(max(1, n // 3))
    start = positioned(seeds.select(F.lit(0).alias("one"), F.col("id").alias("seed"), F.col("embedding").cast("array<double>").alias("embedding")), "one", "seed")
    centers = kept(start.where(F.lit(n >= least)).select(F.col("position").alias("cluster"), F.lit(0).cast("long").alias("n"), "embedding"), "centers")
    for _ in range(rounds):
        assigned = _nearest_center(data, centers, block)
        moved = kept(mean_pool(data.join(assigned, "id"), "cluster").withColumnRenamed("centroid", "embedding"), "centers")
        gap = F.aggregate(F.zip_with(moved["embedding"], F.col("before"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
        both = moved.join(centers.select("cluster", F.col("embedding").alias("before")), "cluster", "full")
        still = both.agg(F.max(F.coalesce(gap, F.lit(1.0))).alias("gap")).first()["gap"]
        centers = moved
        if still is None or still <= 1e-12:
            break
    return _nearest_center(data, centers, block), centers.withColumnRenamed("embedding", "centroid")


def replaced_seeds(seeds: DataFrame, centers: DataFrame, least: float = 0.70, block: int = BLOCK) -> DataFrame:
    """(seed, best, replaced): a seed gives way to the data where a center is nearer to it than ``least`` by cosine."""

    def near(a: Side, b: Side) -> dict[str, np.ndarray]:
        s = b.units @ a.units.T if len(a.ids) else np.zeros((len(b.ids), 1))
        return {"seed": b.ids, "best": s.max(axis=1)}

    found = compared(centers.select(F.col("cluster").alias("id"), F.col("centroid").alias("embedding")), seeds.select("id", "embedding"), near, "seed long, best double", block=block)
    found = found.groupBy("seed").agg(F.max("best").alias("best"))
    joined = seeds.select(F.col("id").alias("seed")).join(found, "seed", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return joined.select("seed", "best", (F.col("best") > least).alias("replaced"))


def seeding_status(seeds: DataFrame, subject: str, sessions: Column, tight: int = 5) -> DataFrame:
    """(subject, seed_count, status, cadence) from rows (subject, replaced or null where a subject has no seeds)."""
    grouped = seeds.groupBy(subject).agg(F.count("replaced").alias("n"), F.count_if(~F.col("replaced")).alias("active"), F.max(sessions).alias("sessions"))
    active = F.col("active")
    status = F.when(F.col("n") == 0, "not_seeded").when(active > 0, "seeded").otherwise("stabilized")
    cadence = F.when((F.col("sessions") < tight) & (active > 0), "tight").otherwise("normal")
    return grouped.select(subject, active.alias("seed_count"), status.alias("status"), cadence.alias("cadence"))


def preserved_labels(clusters: DataFrame, topics: DataFrame, least: float = 0.75) -> DataFrame:
    """(cluster, topic, similarity): the best user-edited topic of each cluster's center, null below ``least``: its label stays."""
    edited = topics.where("is_user_edited").select("topic", "centroid")
    found = best_topic(clusters.select(F.col("cluster").alias("id"), F.col("centroid").alias("embedding")), edited, least)
    return found.withColumnRenamed("id", "cluster")


def stop_words(language: str = "english") -> list[str]:
    """Spark's own list of a language's stop words."""
    return StopWordsRemover.loadDefaultStopWords(language)


def class_keywords(rows: DataFrame, group: str, n: int = 10, stops: list[str] | None = None) -> DataFrame:
    """Keywords of each group's texts taken as one document: (group, term, n, score, ctfidf, rank).

    Terms are words of two or more letters or digits, and pairs of neighbours once stop words are gone. ``score`` is the
    term's count over the group's greatest, which ranks them (ties by term); ``ctfidf`` weighs the count by how rare the
    term is among the groups: n * ln(1 + mean terms of a group / occurrences in all).
    """
    gone = F.array(*(F.lit(w) for w in (stop_words() if stops is None else stops)))
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~F.array_contains(gone, w))
    held = rows.select(group, words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    counts = held.select(group, F.explode(F.concat("w", pairs)).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("term").agg(F.sum("n").alias("everywhere"))
    mean = F.broadcast(counts.groupBy(group).agg(F.sum("n").alias("n")).agg(F.avg("n").alias("mean")))  # one row
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= n)
    best = best.withColumn("score", F.col("n") / F.max("n").over(Window.partitionBy(group)))
    return best.join(whole, "term").join(mean).select(group, "term", "n", "score", (F.col("n") * F.ln(1 + F.col("mean") / F.col("everywhere"))).alias("ctfidf"), "rank")


def grown_topics(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Topics grown in arrival order, a session each: (session, seq, grown_topic).

    A row joins the nearest topic of at least ``least`` by cosine, whose centroid then becomes the mean of its rows, else
    it founds one. Rows come sorted, batch by batch, and only the topics of the session at hand are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_hand, centroids, sizes = None, [], []
        for pdf in batches:
            out = []
            for session, seq, vector in pdf[["session", "seq", "embedding"]].itertuples(index=False):
                if session != at_hand:
                    at_hand, centroids, sizes = session, [], []
                x = np.asarray(vector, dtype=float)
                s = [float(c @ x / max(np.linalg.norm(c) * np.linalg.norm(x), 1e-300)) for c in centroids]
                k = int(np.argmax(s)) if s else -1
                if s and s[k] >= least:
                    centroids[k] = (centroids[k] * sizes[k] + x) / (sizes[k] + 1)
                    sizes[k] += 1
                else:
                    k = len(centroids)
                    centroids.append(x)
                    sizes.append(1)
                out.append((session, seq, k))
            yield pd.DataFrame(out, columns=["session", "seq", "grown_topic"])

    ordered = rows.select("session", "seq", "embedding").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, "session long, seq long, grown_topic long")


def best_in_session(rows: DataFrame, items: DataFrame, width: int = 256) -> DataFrame:
    """The best cosine of each row (session, seq, embedding) to the items (session, item, embedding) of its session: (session, seq, best).

    Items travel packed, ``width`` to a row, so a row of the session meets packs, never an unbounded group. Without items 0.
    """
    from lectern.functions.vector import dot, unit

    dealt = items.select("session", unit(F.col("embedding")).alias("u"), F.floor((F.row_number().over(Window.partitionBy("session").orderBy("item")) - 1) / width).alias("pack"))
    packs = dealt.groupBy("session", "pack").agg(F.collect_list("u").alias("us"))
    met = rows.select("session", "seq", unit(F.col("embedding")).alias("v")).join(packs, "session")
    best = met.select("session", "seq", F.array_max(F.transform("us", lambda u: dot(u, F.col("v")))).alias("s")).groupBy("session", "seq").agg(F.max("s").alias("best"))
    return rows.select("session", "seq").join(best, ["session", "seq"], "left").select("session", "seq", F.coalesce("best", F.lit(0.0)).alias("best"))


__all__ = ["mean_pool", "seeded_kmeans", "session_topics"]
