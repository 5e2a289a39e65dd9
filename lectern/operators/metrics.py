"""Evaluation metrics as aggregations: agreement, classification, clustering, error rates, boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vector import dot, unit
from lectern.operators.search import BLOCK, Side, compared
from lectern.operators.sequence import fixed_boundaries, mean_pool, pooled, random_boundaries


#: Labels of the smaller side that an assignment is solved for, at most.
SOLVED = 1000


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns: (n, agreement, kappa); kappa is 1 where chance agreement is 1."""
    t = contingency(rows, a, b)
    total = t.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("cross"))
    po, pe = F.col("same") / F.col("total"), F.col("cross") / (F.col("total") * F.col("total"))
    return total.join(chance).select(F.col("total").alias("n"), po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))  # one row each


def confusion(rows: DataFrame, truth: Column, guess: Column, empty: float, *keys: str) -> DataFrame:
    """Counts, precision and recall, of each group where ``keys`` are named; ``empty`` is their value where nothing was guessed or true."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    c = rows.groupBy(*keys).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(F.lit(empty))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*keys, "tp", "fp", "fn", "tn", share(tp, fp).alias("precision"), share(tp, fn).alias("recall"))


def purity(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Share of rows that have their cluster's most frequent truth."""
    t = contingency(rows, cluster, truth)
    best = t.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").alias("n"), (F.sum("best") / F.sum("n")).alias("purity"))


def information(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Homogeneity, completeness, V-measure, NMI (arithmetic) and adjusted Rand index from the contingency table."""
    t = contingency(rows, cluster, truth)
    side = lambda c: t.groupBy(c).agg(F.sum("n").alias("n" + c))
    total = F.broadcast(t.agg(F.sum("n").alias("total")))  # one row
    t = t.join(side("a"), "a").join(side("b"), "b").join(total)
    n, total, na, nb = F.col("n"), F.col("total"), F.col("na"), F.col("nb")
    pairs = lambda x: x * (x - 1) / 2
    sums = t.agg(
        F.first("total").alias("total"),
        F.sum(n / total * F.ln(n * total / (na * nb))).alias("mi"),
        (-F.sum(n / total * F.ln(na / total))).alias("ha"),
        (-F.sum(n / total * F.ln(nb / total))).alias("hb"),
        F.sum(pairs(n)).alias("both"),
        F.sum(n / na * pairs(na)).alias("pa"),
        F.sum(n / nb * pairs(nb)).alias("pb"),
    )
    mi, ha, hb = F.col("mi"), F.col("ha"), F.col("hb")
    h, c = F.when(hb > 0, mi / hb).otherwise(1.0), F.when(ha > 0, mi / ha).otherwise(1.0)
    expected = F.col("pa") * F.col("pb") / pairs(F.col("total"))
    ari = F.when((F.col("pa") + F.col("pb")) / 2 == expected, 1.0).otherwise((F.col("both") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected))
    return sums.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"), F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0).alias("nmi"), ari.alias("ari"))


def matched_purity(rows: DataFrame, cluster: str, truth: str) -> float:
    """Share of rows under the best one-to-one assignment of clusters to truths; cluster -1 is noise and left out.

    With k labels on the smaller side, only the k heaviest partners of each can matter: of those, at most k - 1
    go to other labels, so one at least as heavy as any lighter partner is free. The driver solves these k * k
    cells at most; the rest stays in Spark. More than ``SOLVED`` labels on both sides are refused.
    """
    table = contingency(rows.where(F.col(cluster) != -1), cluster, truth)
    sizes = table.agg(F.count_distinct(F.struct("a")).alias("a"), F.count_distinct(F.struct("b")).alias("b"), F.sum("n").alias("total")).first()
    if not sizes["total"]:
        return 0.0
    few, many = ("a", "b") if sizes["a"] <= sizes["b"] else ("b", "a")
    if sizes[few] > SOLVED:
        raise ValueError(f"an assignment of {sizes[few]} labels is too large to solve")
    heavy = Window.partitionBy(few).orderBy(F.desc("n"), many)
    cells = table.withColumn("rank", F.row_number().over(heavy)).where(F.col("rank") <= sizes[few]).toPandas()
    i, j = (pd.factorize(cells[c], use_na_sentinel=False)[0] for c in (few, many))
    grid = np.zeros((i.max() + 1, j.max() + 1))
    grid[i, j] = cells["n"]
    return float(best_assignment(grid) / sizes["total"])


def best_assignment(grid: np.ndarray) -> float:
    """The greatest sum of cells, one for each row and column, by shortest augmenting paths."""
    cost = -np.asarray(grid, dtype=float)
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while match[j]:
            used[j] = True
            slack = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            free = np.flatnonzero(~used[1:]) + 1
            step = free[least[free].argmin()]
            delta = least[step]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = step
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return float(-sum(cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def edit_distance(a: list, b: list) -> int:
    row = np.arange(len(b) + 1)
    codes = {w: k for k, w in enumerate(dict.fromkeys(b))}
    other = np.array([codes[w] for w in b], dtype=np.int64)
    for i, w in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (other != codes.get(w, -1)))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def word_edits(a: Column, b: Column) -> Column:
    """Edits of words from one text to another: each distinct word of the pair becomes a character of its own, and the built-in distance counts those."""
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    words = F.struct(split(a).alias("a"), split(b).alias("b"))

    def spelled(own: Column, known: Column) -> Column:
        codes = F.transform(own, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    known = F.transform(F.array(words), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_distinct(F.concat(p["a"], p["b"])).alias("known")))
    return F.element_at(F.transform(known, lambda p: F.levenshtein(spelled(p["a"], p["known"]), spelled(p["b"], p["known"])).cast("long")), 1)


def error_rates(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """All columns, and ``word_edits``, ``n_words``, ``char_edits``, ``n_chars`` of each pair of texts, by the built-in Levenshtein distance; null texts are empty."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    n_words = F.size(F.filter(F.split(a, r"\s+"), lambda w: w != "")).cast("long")
    return rows.withColumns({"word_edits": word_edits(a, b), "n_words": n_words, "char_edits": F.levenshtein(a, b).cast("long"), "n_chars": F.char_length(a).cast("long")})


def rate(edits: Column, length: Column) -> Column:
    """Edits for each unit of the reference; of an empty reference 0 where nothing was guessed either, else 1."""
    return F.when(length > 0, edits / length).when(edits > 0, 1.0).otherwise(0.0)


def segmentation_gate(rows: DataFrame, window: int, fixed: int, many: int, most: float = 0.30, margin: float = 0.05) -> DataFrame:
    """One row that says whether guessed boundaries are good: (p_k, fixed_p_k, random_p_k, passed, beats).

    ``rows`` has (session, seq, truth, guess). ``passed`` is a mean P_k below ``most``; ``beats`` is one lower by more than
    ``margin`` than both baselines, a boundary every ``fixed`` rows and ``many`` random ones.
    """
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1)
    sizes = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    marked = numbered
    for name, cuts in (("fixed", fixed_boundaries(sizes, fixed)), ("random", random_boundaries(sizes, many))):
        marked = marked.join(cuts.select("session", "at", F.lit(1).alias(name)), ["session", "at"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    score = lambda name: boundary_errors(marked.select("session", "seq", "truth", F.col(name).alias("guess")), window).agg(F.avg("p_k").alias(name))
    one = score("guess").join(score("fixed")).join(score("random"))  # one row each
    best = F.least("fixed", "random")
    return one.select(F.col("guess").alias("p_k"), F.col("fixed").alias("fixed_p_k"), F.col("random").alias("random_p_k"), (F.col("guess") < most).alias("passed"), (F.col("guess") < best - margin).alias("beats"))


def boundary_errors(rows: DataFrame, window: int) -> DataFrame:
    """P_k and WindowDiff of guessed against true boundaries: rows (session, seq, truth, guess as 0/1).

    Each position compares the boundaries within the next ``window`` rows; sums over a window frame,
    so a session is read once.
    """
    frame = Window.partitionBy("session").orderBy("seq").rowsBetween(0, window - 1)
    t, g, n = F.sum("truth").over(frame), F.sum("guess").over(frame), F.count(F.lit(1)).over(frame)
    seen = rows.select("session", t.alias("t"), g.alias("g"), n.alias("n")).where(F.col("n") == window)
    return seen.groupBy("session").agg(F.avg(((F.col("t") > 0) != (F.col("g") > 0)).cast("double")).alias("p_k"), F.avg((F.col("t") != F.col("g")).cast("double")).alias("window_diff"))


def silhouette(rows: DataFrame, cluster: str, block: int = BLOCK) -> DataFrame:
    """Mean cosine silhouette, noise (-1) left out: (n, silhouette); 0 with one cluster.

    The mean cosine distance of a row to a cluster is 1 minus its product with the cluster's mean unit vector, so rows
    meet cluster means, never each other. ``rows`` has (id, cluster as a whole number, embedding).
    """
    rows = rows.where(F.col(cluster) != -1).select("id", F.col(cluster).cast("long").alias("c"), unit(F.col("embedding").cast("array<double>")).alias("embedding"))
    means = mean_pool(rows, "c").select(F.col("c").alias("id"), F.col("n").alias("c"), F.col("centroid").alias("embedding"))

    def seen(a: Side, b: Side) -> dict[str, np.ndarray]:
        s = a.units @ (b.units * b.lengths[:, None]).T
        own = a.tags[:, None] == b.ids[None, :]
        best = lambda mask: np.where(mask, s, -np.inf).max(axis=1, initial=-np.inf)
        return {"id": a.ids, "own": best(own), "other": best(~own), "n": np.where(own, b.tags[None, :], 0).max(axis=1, initial=0)}

    met = compared(rows, means, seen, "id long, own double, other double, n long", tag="c", block=block)
    met = met.groupBy("id").agg(F.max("own").alias("own"), F.max("other").alias("other"), F.max("n").alias("n"))
    n = F.col("n")
    met = met.withColumn("a", 1 - (F.col("own") * n - 1) / F.when(n > 1, n - 1)).withColumn("b", 1 - F.col("other"))
    alone = F.col("a").isNull() | (F.col("other") == float("-inf"))
    s = F.when(alone, 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return met.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def diversity(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, diversity): 1 minus the mean pairwise cosine of a group's vectors, in [0, 1]; 0 for a single one.

    The sum of all products is the squared length of the sum of unit vectors, so no pair is formed.
    """
    sums = pooled(rows.withColumn("embedding", unit(F.col("embedding").cast("array<double>"))), Summarizer.sum, "total", key)
    n = F.col("n")
    mean = (dot(F.col("total"), F.col("total")) - n) / F.when(n > 1, n * (n - 1))
    value = F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean))).otherwise(F.lit(0.0))
    return sums.select(key, "n", value.alias("diversity"))


# The share of the spectrum that counts as signal, and the bias of such estimates in decibels.
SHARE, OFFSET = 0.05, 15.0


def snr_db(samples: np.ndarray, share: float = SHARE, offset: float = OFFSET) -> np.ndarray:
    """Signal to noise from the spectra along the last axis: mean power of the strongest bins over the median of the rest, less a fixed bias; 0 for fewer than 8 samples or silence."""
    samples = np.asarray(samples, dtype=float)
    if samples.shape[-1] < 8:
        return np.zeros(samples.shape[:-1])
    power = np.sort(np.abs(np.fft.rfft(samples, axis=-1)) ** 2, axis=-1)[..., ::-1]
    n = max(1, int(power.shape[-1] * share))
    signal = power[..., :n].mean(axis=-1)
    noise = np.median(power[..., n:], axis=-1) if power.shape[-1] > n else signal
    ratio = 10 * np.log10(np.maximum(signal, 1e-12) / np.maximum(noise, 1e-12)) - offset
    return np.where(power.sum(axis=-1) > 0, ratio, 0.0)


def by_condition(rows: DataFrame) -> DataFrame:
    """(condition, n, baseline, adapted, improved): mean rates over the texts of each condition, before and after."""
    found = rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg("baseline").alias("baseline"), F.avg("adapted").alias("adapted"))
    return found.withColumn("improved", F.col("adapted") < F.col("baseline"))


def purity_gate(rows: DataFrame, run: str, cluster: str, truth: str, least: float = 0.6) -> DataFrame:
    """One row (best, passed): the best purity of several runs, against a gate."""
    counts = rows.groupBy(run, cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(run, cluster).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy(run).agg((F.sum("best") / F.sum("n")).alias("purity")).agg(F.max("purity").alias("best"), (F.max("purity") > least).alias("passed"))
