"""Relational operators: guarded scans, row isolation, pages, allocations, merges, votes, audits."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalar import hamming


def partition_scan(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows of one partition; a missing key is an error, so that no scan crosses partitions by accident."""
    if value is None:
        raise ValueError(f"{key} is required")
    return rows.where(F.col(key) == F.lit(value))


def owned(rows: DataFrame, key: str, chain: list[tuple[DataFrame, str, str]], owner: Column) -> DataFrame:
    """Row isolation: the rows whose ``key`` leads, link by link of ``chain`` (table, its key, its parent key), to an owner.

    Each link is a semi-join from the owner down, so only keys travel.
    """
    table, own, parent = chain[-1]
    allowed = table.where(owner).select(F.col(own).alias("k"))
    for table, own, parent in reversed(chain[:-1]):
        allowed = table.join(allowed, F.col(parent) == F.col("k"), "left_semi").select(F.col(own).alias("k"))
    return rows.join(allowed, F.col(key) == F.col("k"), "left_semi")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """One page in a total order; the limit is at most ``most``."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row of each key with the greatest ``at``, then ``tie``; an aggregation, no sort."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(at, tie)).alias("row")).select("row.*")


def allocate(weights: DataFrame, key: str, weight: Column, slots: int) -> DataFrame:
    """Largest-remainder allocation: (key, slots) sums to ``slots``; ties of remainders go to the smaller key.

    The sum is an aggregate, and the largest remainders are a sort with a limit (fewer than ``slots`` and than keys),
    so no task holds all keys.
    """
    w = weights.select(key, weight.alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    quota = w.join(F.broadcast(total)).withColumn("quota", F.col("w") / F.col("total") * slots).withColumn("base", F.floor("quota").cast("long"))  # one row
    left = slots - (quota.agg(F.sum("base").alias("n")).first()["n"] or 0)
    extra = quota.orderBy(F.desc(F.round(F.col("quota") - F.col("base"), 9)), key).limit(max(left, 0)).select(key, F.lit(1).cast("long").alias("extra"))
    return quota.join(extra, key, "left").select(key, (F.col("base") + F.coalesce("extra", F.lit(0))).alias("slots"))


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: source rows replace target rows of the same (null-safe) keys; the rest of both stays."""
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    kept = t.join(s, on, "left_anti").select("t.*")
    return kept.unionByName(source)


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent append: the source rows whose keys the target lacks, one for each key."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def majority(votes: DataFrame, item: str, keep: Column) -> DataFrame:
    """(item, n_keep, n_drop, kept, review): the majority of each item's votes; a tie keeps and asks for review."""
    yes, no = F.count_if(keep), F.count_if(~keep)
    return votes.groupBy(item).agg(yes.alias("n_keep"), no.alias("n_drop"), (yes >= no).alias("kept"), (yes == no).alias("review"))


def label_precedence(sources: list[tuple[DataFrame, int]], key: str) -> DataFrame:
    """Labels of several sources by key: of each key the one from the source of the highest priority."""
    both = None
    for rows, priority in sources:
        part = rows.select(key, "label", F.lit(priority).alias("priority"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.max_by("label", F.struct("priority", "label")).alias("label"))


def merge_topics(rows: DataFrame, topic: str, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """Rows with topic ``old`` moved to ``new``, and the audit rows that undo it: one for each row moved."""
    moved = rows.where(F.col(topic) == old)
    audit = moved.select(F.lit("merge").alias("operation"), F.lit(old).alias("old"), F.lit(new).alias("new"), F.col(rows.columns[0]).alias("moved_id"))
    return rows.withColumn(topic, F.when(F.col(topic) == old, F.lit(new)).otherwise(F.col(topic))), audit


def undo_merge(rows: DataFrame, audit: DataFrame, topic: str) -> DataFrame:
    """The rows as before the merge: exactly those of the audit rows go back."""
    ids = audit.select("old", "moved_id").dropDuplicates(["moved_id"])
    joined = rows.join(ids, F.col(rows.columns[0]) == F.col("moved_id"), "left")
    return joined.select(*(F.coalesce("old", topic).alias(topic) if c == topic else F.col(c) for c in rows.columns))


# The legal steps of a session's state.
TRANSITIONS = (
    ("created", "recording"), ("recording", "transcribed"), ("transcribed", "processing"), ("processing", "complete"), ("processing", "failed"),
    ("failed", "processing"), ("failed", "transcribed"), ("created", "failed"), ("recording", "failed"),
)


def legal(before: Column, after: Column) -> Column:
    """Whether a step from one state to another is legal."""
    return F.struct(before.alias("a"), after.alias("b")).isin(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TRANSITIONS])


def quarantine(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``errors``: the names of the rules they break; null counts as broken."""
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return rows.withColumn("errors", F.filter(broken, lambda e: e.isNotNull()))


def probe_plan(n: int, most: int) -> tuple[int, int, float]:
    """For n hashes of 64 bits: how many bands they are cut into, how many bits of a band a probe may differ in, and the expected work for each hash.

    Where two hashes differ in ``most`` bits, some of m bands differs in at most ``most // m``. Few wide bands have small buckets and
    many probes, many narrow ones few probes and large buckets; the number of bands of the least expected work is taken (at 10^8
    hashes three bands, and some 40000 comparisons for each hash).
    """

    def work(m: int) -> float:
        width = 64 // m
        probes = sum(comb(width + (64 % m > 0), r) for r in range(most // m + 1))
        return m * probes * (1 + n / 2.0**width)

    bands = min(range(3, max(4, most + 2)), key=work)
    return bands, most // bands, work(bands)


def similar_hashes(rows: DataFrame, id_col: str, hash_col: str, most: int = 8, bands: int | None = None) -> DataFrame:
    """Each row with the other row of the nearest 64-bit hash within ``most`` differing bits: (id, other, distance).

    Exact multi-index hashing: every hash is listed under its bits in each of ``bands`` disjoint bands, and looks under all values
    within ``most // bands`` bits of its own (``probe_plan`` picks the bands by the counted hashes). Equal hashes are collapsed first to
    their two smallest ids, so copies cost one row.
    """
    if bands is not None and not 1 <= bands <= 64:
        raise ValueError("1 to 64 bands")
    bands = bands or probe_plan(rows.count(), most)[0]
    cuts = [b * 64 // bands for b in range(bands + 1)]
    masks = [[sum(1 << x for x in c) for r in range(most // bands + 1) for c in combinations(range(b - a), r)] for a, b in zip(cuts, cuts[1:], strict=False)]
    bits = lambda a, b: F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))
    copies = rows.select(F.col(hash_col).alias("h"), F.col(id_col).alias("id"))
    first_two = copies.withColumn("rank", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).where("rank <= 2")  # cut to two before the shuffle
    single = first_two.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("next"))
    own = [F.struct(F.lit(i).alias("band"), bits(a, b).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    listed = single.select("h", "id", F.explode(F.array(*own)).alias("k")).select(F.col("h").alias("h2"), F.col("id").alias("other"), "k.*")

    def near(band: int) -> Column:
        """The band's values that a hash looks under."""
        value = bits(cuts[band], cuts[band + 1])
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks[band])), lambda m: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(m).alias("bits")))

    values = F.flatten(F.array(*(near(band) for band in range(bands))))
    probes = single.select("h", F.explode(values).alias("k")).select("h", "k.*")
    met = probes.join(listed, ["band", "bits"]).where("h <> h2").withColumn("distance", hamming(F.col("h"), F.col("h2"))).where(F.col("distance") <= most)
    best = met.groupBy("h").agg(F.min(F.struct("distance", "other")).alias("best"))
    pairs = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).join(single.select("h", F.col("id").alias("first"), F.when(F.col("next") > F.col("id"), F.col("next")).alias("second")), "h").join(best, "h", "left")
    twin = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    found = pairs.select("id", F.when(twin.isNotNull(), F.struct(F.lit(0).alias("distance"), twin.alias("other"))).otherwise(F.col("best")).alias("b"))
    return found.where("b IS NOT NULL").select("id", "b.other", "b.distance")


def exported(owners: DataFrame, chain: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """All rows of some owners (k), table by table down ``chain`` (kind, table, its key, its parent key): (kind, record as JSON)."""
    out, keys = None, owners
    for kind, table, own, parent in chain:
        held = table.join(keys, F.col(parent) == F.col("k"), "left_semi")
        part = held.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*table.columns)).alias("record"))
        out = part if out is None else out.unionByName(part)
        keys = held.select(F.col(own).alias("k"))
    return out


def costs(runs: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """(session, cost) of runs (session, key, units) by a price list (key, price); what has no price costs nothing.

    Units are summed by session and key before they meet the prices.
    """
    used = runs.groupBy("session", key).agg(F.sum("units").alias("units"))
    return used.join(prices, key, "left").groupBy("session").agg(F.sum(F.col("units") * F.coalesce("price", F.lit(0.0))).alias("cost"))
