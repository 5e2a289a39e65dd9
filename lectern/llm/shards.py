"""Sharding by k-d tree partitioning, on DataFrame operations alone.

Nodes are split at distributed weighted medians along their widest metadata dimension until the leaves have the target
bytes. Texts that are equal are one unit and stay together. A median is found by radix selection: a round sums the
weights of a node's units in bins of the remaining bits of their keys, so the driver sees bins, never rows. A key is a
unit's place in the dimension and then a hash of its text, which breaks ties. Units that are heavy for a shard are few;
they go to their side of the cut where there is room, and the other units make up for them. Once a level has ``NODES``
nodes, their parts are small, and the levels below are cut by windows over each node, without the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.spark import NULL_ID, materialize

#: Bits of a key: the place in a dimension, and the tie-breaker.
_PLACE, _TIE = 12, 48
#: Nodes of a level whose cuts the driver searches at once, and bins that a round of the search sends it over all nodes.
NODES, BINS = 4096, 1 << 20
_DIMENSIONS = 3
#: Rows of a shard that one task numbers.
_NUMBERED = 50_000
_UNIT = ["text_hash", "unit"]


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, of at most a row for each node or heavy unit; broadcast in the joins below."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _looked_up(df: DataFrame, key: str, rows: list[dict], schema: str) -> DataFrame:
    """``df`` with the columns of the node's row, null where there is none: literal maps of few rows, else a broadcast join."""
    types = dict(f.split(":") for f in schema.split(","))
    if len(rows) > 64:
        return df.join(F.broadcast(_local(df.sparkSession, rows, schema)), key, "left")
    for name, kind in types.items():
        if name != key:
            pairs = [F.lit(x).cast(t) for r in rows for x, t in ((r[key], types[key]), (r[name], kind))]
            df = df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(key)) if rows else F.lit(None).cast(kind))
    return df


class Cut:
    """The radix search of one node for the key at which its left part has the wanted weight."""

    def __init__(self, want: float, tolerance: float):
        self.want, self.tolerance, self.prefix, self.below, self.key = max(want, 0.0), tolerance, 0, 0, None

    def narrow(self, bins: dict[int, int], bits: int, left_bits: int) -> None:
        """Step into the bin that holds the wanted weight; end where one of its edges is near enough, at the nearer edge."""
        at, b, weight = self.below, 0, 0
        for b in sorted(bins):
            weight = bins[b]
            if at + weight >= self.want:
                break
            at += weight
        else:  # all that is left weighs less than is wanted
            b, weight = (1 << bits) - 1, 0
        self.below, self.prefix = at, (self.prefix << bits) | b
        before, after = self.want - at, at + weight - self.want
        if min(before, after) <= self.tolerance or left_bits == 0:
            self.key = (self.prefix + (after < before)) << left_bits


def deal_heavy(heavy: list[dict], want: float, rest: float, cut: float | None) -> list[bool]:
    """For heavy units (place, tie, weight) whether each goes left: to its side of ``cut`` where there is room, else where more is; the heaviest first."""
    room, out = {True: want, False: rest}, [False] * len(heavy)
    for i in sorted(range(len(heavy)), key=lambda i: (-heavy[i]["weight"], heavy[i]["place"], heavy[i]["tie"])):
        w = heavy[i]["weight"]
        left = heavy[i]["place"] < cut if cut is not None else room[True] >= room[False]
        if room[left] < w and room[not left] > room[left]:
            left = not left
        out[i] = left
        room[left] -= w
    return out


def _key(d: Column) -> Column:
    return F.element_at(F.array(*(F.col(f"d{i}") for i in range(_DIMENSIONS))), d + 1) * F.lit(1 << _TIE) + F.col("tie")


def _search(keyed: DataFrame, cuts: dict[int, Cut]) -> None:
    """Rounds of bins until every cut is found; ``keyed`` has (node, key, weight)."""
    left_bits = _PLACE + _TIE
    while asked := {k: c for k, c in cuts.items() if c.key is None}:
        bits = min(left_bits, 12, max(1, int(math.log2(BINS / len(asked)))))
        state = [{"node": k, "prefix": c.prefix} for k, c in asked.items()]
        inside = _looked_up(keyed, "node", state, "node:bigint,prefix:bigint").where(F.shiftright("key", left_bits) == F.col("prefix"))
        left_bits -= bits
        bins = inside.groupBy("node", F.shiftright("key", left_bits).bitwiseAND((1 << bits) - 1).alias("bin")).agg(F.sum("weight").alias("w"))
        found: dict[int, dict[int, int]] = {k: {} for k in asked}
        for r in bins.collect():  # BINS at most
            found[r["node"]][r["bin"]] = r["w"]
        for k, c in asked.items():
            c.narrow(found[k], bits, left_bits)


def _split(light: DataFrame, heavy: list[dict], nodes: dict[int, int], tolerance: float) -> tuple[DataFrame, dict[int, int]]:
    """One level: every node of more than one shard is cut in two. A node is named by its first shard; ``nodes`` has its number of shards."""
    mean = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    bounds = [f(f"d{i}").alias(f"{name}{i}") for i in range(_DIMENSIONS) for name, f in (("lo", F.min), ("hi", F.max), ("mean", mean))]
    stats = {r["node"]: r.asDict() for r in light.groupBy("node").agg(F.sum("weight").alias("w"), *bounds).collect()}
    own: dict[int, list[dict]] = {}
    for u in heavy:
        own.setdefault(u["node"], []).append(u)
    plan = {}
    for k, leaves in nodes.items():
        some, r = own.get(k, []), stats.get(k)
        if leaves < 2 or not (some or r):
            continue
        ends = lambda i, r=r, some=some: [u[f"d{i}"] for u in some] + ([r[f"lo{i}"], r[f"hi{i}"]] if r else [])
        d = max(range(_DIMENSIONS), key=lambda i, ends=ends: max(ends(i)) - min(ends(i)))
        total = (r["w"] if r else 0) + sum(u["weight"] for u in some)
        plan[k] = {"node": k, "d": d, "want": total * (leaves // 2) / leaves, "total": total}
    # heavy units choose their side by the mean of the light ones; then the light ones are cut to what is left
    for k, p in plan.items():
        units, r = own.get(k, []), stats.get(k)
        for u in units:
            u["place"] = u[f"d{p['d']}"]
        sides = deal_heavy(units, p["want"], p["total"] - p["want"], float(r[f"mean{p['d']}"]) if r else None)
        for u, left in zip(units, sides, strict=True):
            p["want"] -= u["weight"] if left else 0
            u["node"] = k if left else k + nodes[k] // 2
    cuts = {k: Cut(p["want"], tolerance * p["total"]) for k, p in plan.items() if k in stats}
    widest = [{"node": k, "d": plan[k]["d"]} for k in cuts]
    _search(_looked_up(light, "node", widest, "node:bigint,d:int").where("d IS NOT NULL").select("node", "weight", _key(F.col("d")).alias("key")), cuts)
    table = [{"node": k, "d": plan[k]["d"], "cut": c.key, "right": k + nodes[k] // 2} for k, c in cuts.items()]
    side = F.when(F.col("cut").isNull() | (_key(F.coalesce("d", F.lit(0))) < F.col("cut")), F.col("node")).otherwise(F.col("right"))
    light = _looked_up(light, "node", table, "node:bigint,d:int,cut:bigint,right:bigint").withColumn("node", side).drop("d", "cut", "right")
    after = {}
    for k, leaves in nodes.items():
        if leaves > 1:
            after |= {k: leaves // 2, k + leaves // 2: leaves - leaves // 2}
        else:
            after[k] = 1
    return light, after


def _windowed(units: DataFrame) -> DataFrame:
    """One level of small nodes: ``units`` have their node and its number of shards (leaves); cut within one unit of the median."""
    own = Window.partitionBy("node")
    spread = [F.max(f"d{i}").over(own) - F.min(f"d{i}").over(own) for i in range(_DIMENSIONS)]
    most = F.greatest(*spread)
    widest = F.coalesce(*(F.when(s == most, F.lit(i)) for i, s in enumerate(spread)))
    units = units.withColumn("key", _key(widest)).withColumn("total", F.sum("weight").over(own))
    half = F.floor(F.col("leaves") / 2)
    upto = F.sum("weight").over(own.orderBy("key", *_UNIT).rowsBetween(Window.unboundedPreceding, 0))
    left = upto - F.col("weight") / 2 < F.col("total") * half / F.col("leaves")
    single = F.col("leaves") == 1
    units = units.withColumn("left", left)
    node = F.when(single | F.col("left"), F.col("node")).otherwise(F.col("node") + half)
    leaves = F.when(single, 1).when(F.col("left"), half).otherwise(F.col("leaves") - half)
    return units.select(*_UNIT, "weight", *(f"d{i}" for i in range(_DIMENSIONS)), "tie", node.alias("node"), leaves.cast("long").alias("leaves"))


def _places(rows: DataFrame) -> DataFrame:
    """Equal texts as one group: (text_hash, weight, n, d0, d1, d2); metadata are those of its smallest id."""
    place = lambda x: F.least(F.greatest(F.floor(x * (1 << _PLACE)), F.lit(0)), F.lit((1 << _PLACE) - 1)).cast("long")
    named = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << _PLACE))
    first = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)), "lang", "source", "uid")
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), F.first("n_chars").alias("n_chars"), F.min_by(F.struct("lang", "source"), first).alias("own"))
    return groups.select("text_hash", "weight", "n", place(F.log2(F.col("n_chars") + 1) / 32).alias("d0"), named("own.lang").alias("d1"), named("own.source").alias("d2"))


def _units(rows: DataFrame, groups: DataFrame, limit: float) -> DataFrame:
    """Groups as units, but groups that no shard holds as units of a row each: (text_hash, unit, weight, d0, d1, d2, tie)."""
    over = F.broadcast(groups.where((F.col("weight") > limit) & (F.col("n") > 1)))  # fewer than there are shards
    whole = groups.where((F.col("weight") <= limit) | (F.col("n") == 1)).select("text_hash", F.lit(-1).cast("long").alias("unit"), "weight", "d0", "d1", "d2")
    cut = rows.select("text_hash", F.col("uid").alias("unit"), F.col("size").alias("weight")).join(over.select("text_hash", "d0", "d1", "d2"), "text_hash")
    return whole.unionByName(cut).withColumn("tie", F.pmod(F.xxhash64(*_UNIT), F.lit(1 << _TIE)))


def kd_tree_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int = 256 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: tuple[str, str] = ("lang", "source"),
    slack: float = 0.01,
    tolerance: float = 5e-4,
    most_nodes: int = NODES,
) -> DataFrame:
    """Deal all documents into shards of near equal bytes, by a k-d tree over their metadata.

    ``n_shards``, or else as many shards as make ``target_bytes`` each. Dimensions: the text's length (log scale) and two
    categorical columns (by hash; nulls, or a missing column, are one value). Returns (doc_id, size, text_crc32, shard,
    slot): ``size`` is the text's UTF-8 bytes plus 1, ``slot`` counts from 0 without gaps in each shard.

    Rows of equal text stay together; only a group of more bytes than a shard's share is cut, row by row, as no shard
    could hold it and be near equal. Units of more than ``slack`` of a share (at most 1 / slack for each shard or node
    of the widest driver-searched level) are placed by the driver. Each cut is within ``tolerance`` of its node's bytes,
    or one other unit, of the median. A null text is empty (size 1), a null id stays null, repeated rows are dealt each,
    texts of any length are one row of metadata here, an empty table gives an empty result. Other columns are ignored,
    also those named like the output's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang, source = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in categories)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.length(text).cast("long").alias("n_chars"),
        lang.alias("lang"),
        source.alias("source"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = materialize(rows, "shard-rows")
    spark = rows.sparkSession
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_shards = n_shards or max(1, round(whole["bytes"] / target_bytes))
    groups = materialize(_places(rows), "shard-groups")
    units = _units(rows, groups, whole["bytes"] / n_shards)
    is_heavy = F.col("weight") > slack * whole["bytes"] / min(n_shards, most_nodes)
    heavy = [r.asDict() | {"node": 0} for r in units.where(is_heavy).collect()]  # at most min(n_shards, most_nodes) / slack
    light, nodes, level = materialize(units.where(~is_heavy).withColumn("node", F.lit(0).cast("long")), "shard-nodes"), {0: n_shards}, 0
    while any(n > 1 for n in nodes.values()) and 2 * len(nodes) <= max(most_nodes, 2):
        light, nodes = _split(light, heavy, nodes, tolerance)
        level += 1
        if level % 3 == 0:
            light = materialize(light, "shard-nodes")
    columns = [*_UNIT, "weight", *(f"d{i}" for i in range(_DIMENSIONS)), "tie", "node"]
    schema = "text_hash:bigint,unit:bigint,weight:bigint,d0:bigint,d1:bigint,d2:bigint,tie:bigint,node:bigint"
    placed = light.select(*columns).unionByName(_local(spark, [{c: u[c] for c in columns} for u in heavy], schema))
    if any(n > 1 for n in nodes.values()):
        table = F.broadcast(_local(spark, [{"node": k, "leaves": n} for k, n in nodes.items()], "node:bigint,leaves:bigint"))
        placed, deepest = placed.join(table, "node"), max(nodes.values())
        while deepest > 1:
            placed, deepest = materialize(_windowed(placed), "shard-nodes"), deepest - deepest // 2
    parts = max(math.ceil(whole["n"] / (n_shards * _NUMBERED)), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards))
    over = F.broadcast(groups.where((F.col("weight") > whole["bytes"] / n_shards) & (F.col("n") > 1)).select("text_hash", F.lit(True).alias("over")))  # fewer than n_shards
    dealt = rows.join(over, "text_hash", "left").withColumn("unit", F.when(F.col("over"), F.col("uid")).otherwise(F.lit(-1)))
    dealt = dealt.join(placed.select(*_UNIT, F.col("node").cast("int").alias("shard")), _UNIT).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)))
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "shard", "part", "uid"), "shard-dealt")
    return _numbered(dealt)


def _numbered(dealt: DataFrame) -> DataFrame:
    """Slots: each (shard, part) is numbered by itself, after the counts of the parts before it."""
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return dealt.withColumn("own", own).join(counts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))
