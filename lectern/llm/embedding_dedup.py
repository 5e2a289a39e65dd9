"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length in double precision and quantised to int8 with a step of their
own; the norm of what quantisation loses is kept with each vector. For unit u = q + e and v = r + f,
|u.v - q.r| <= |q||f| + |e||r| + |e||f|, so a tile of integer products sorts its pairs into sure
links, sure others and pairs in doubt. What int8 loses is itself kept in int16, so a pair in doubt is
first computed from both codes, within bounds of the same kind that are 30000 times closer; only a pair
that these leave in doubt is fetched and computed in double precision. Tiles ship codes, never doubles.
Equal vectors are one class and are compared once. Classes are dealt to tiles of bounded size by a
hash, and each pair of tiles is one task's work: it emits link counts, a spanning forest of its
links, and the few pairs still in doubt, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import Forest, connected_components
from lectern.llm.spark import materialize

#: Vectors of a tile.
TILE = 4096
#: Rows of a tile multiplied at once: bounds a task's memory.
STRIP = 512
#: Slack for rounding in the double-precision bounds.
EPS = 1e-9


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to unit vectors (as bytes of doubles), or null where they can link with nothing."""
    for batch in batches:
        units = []
        for values in batch.column("embedding").to_pylist():
            unit = None
            if values and None not in values:
                x = np.array(values, dtype=np.float64)
                scale = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if scale > 0:
                    x = x / scale  # keeps squares in range
                    unit = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
            units.append(unit)
        yield pa.record_batch([batch.column("vec"), pa.array(units, pa.binary())], ["vec", "unit"])


def quantise(unit: np.ndarray, kind: type = np.int8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole-number codes, step, norm of the coded vector, and norm of the loss (both rounded up), for rows."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-300) / np.iinfo(kind).max
    code = np.rint(unit / step[:, None]).astype(kind)
    coded = code * step[:, None]
    return code, step, np.sqrt((coded**2).sum(axis=1)) + EPS, np.sqrt(((unit - coded) ** 2).sum(axis=1)) + EPS


class Coded:
    """Unit vectors in codes: int8 with step, norm and loss, and the loss again in int16 with a step and what that loses."""

    FIELDS = "code binary, step double, norm double, loss double, fine binary, fine_step double, fine_loss double"

    def __init__(self, code: np.ndarray, step: np.ndarray, norm: np.ndarray, loss: np.ndarray, fine: np.ndarray, fine_step: np.ndarray, fine_loss: np.ndarray):
        self.code, self.step, self.norm, self.loss, self.fine, self.fine_step, self.fine_loss = code, step, norm, loss, fine, fine_step, fine_loss

    @classmethod
    def of(cls, unit: np.ndarray) -> Coded:
        code, step, norm, loss = quantise(unit)
        fine, fine_step, _, fine_loss = quantise(unit - code * step[:, None], np.int16)
        return cls(code, step, norm, loss, fine, fine_step, fine_loss)

    @classmethod
    def read(cls, pdf: pd.DataFrame) -> Coded:
        whole = lambda c, t: np.frombuffer(b"".join(pdf[c]), t).reshape(len(pdf), -1)
        return cls(whole("code", "<i1"), *(pdf[c].to_numpy() for c in ("step", "norm", "loss")), whole("fine", "<i2"), *(pdf[c].to_numpy() for c in ("fine_step", "fine_loss")))

    def near(self, i: np.ndarray) -> np.ndarray:
        """The vectors as both codes give them."""
        return self.code[i] * self.step[i, None] + self.fine[i] * self.fine_step[i, None]

    def __len__(self) -> int:
        return len(self.code)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (cls, many, unit) to their codes; vectors of one length at a time."""
    for batch in batches:
        units = batch.column("unit").to_pylist()
        size = np.array([len(u) for u in units], dtype=np.int64)
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            c = Coded.of(np.frombuffer(b"".join([units[i] for i in own.tolist()]), "<f8").reshape(len(own), -1))
            raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            some = pa.array(own)
            yield pa.record_batch(
                [batch.column("cls").take(some), batch.column("many").take(some), pa.array(np.full(len(own), width // 8)), raw(c.code), pa.array(c.step), pa.array(c.norm), pa.array(c.loss), raw(c.fine.astype("<i2")), pa.array(c.fine_step), pa.array(c.fine_loss)],
                ["cls", "many", "width", *(f.split()[0] for f in Coded.FIELDS.split(", "))],
            )


def tile_links(a: Coded, b: Coded, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Strips of pairs (rows of a, rows of b), within one tile each pair once: sure links, and pairs still in doubt."""
    fb = b.code.astype(np.float32 if a.code.shape[1] <= 1024 else np.float64)  # sums of int8 products stay exact
    for lo in range(0, len(a), STRIP):
        own = slice(lo, lo + STRIP)
        product = a.code[own].astype(fb.dtype) @ fb.T
        bound = a.norm[own].max() * b.loss.max() + a.loss[own].max() * b.norm.max() + a.loss[own].max() * b.loss.max() + EPS
        least = (threshold - bound) / (a.step[own].max() * b.step.max()) if threshold > bound else -np.inf
        i, j = np.nonzero(product >= 0.999 * least)
        if same:
            keep = j > i + lo
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        about = product[i, j].astype(np.float64) * a.step[i + lo] * b.step[j]
        i = i + lo
        error = a.norm[i] * b.loss[j] + a.loss[i] * b.norm[j] + a.loss[i] * b.loss[j] + EPS
        sure = about - error >= threshold
        doubt = np.flatnonzero(~sure & (about + error >= threshold))
        still = []
        for k in range(0, len(doubt), 1 << 14):
            part = doubt[k : k + (1 << 14)]
            x, y = i[part], j[part]
            value = np.einsum("ij,ij->i", a.near(x), b.near(y))
            off = (1 + a.fine_loss[x]) * b.fine_loss[y] + a.fine_loss[x] * (1 + b.fine_loss[y]) + EPS
            sure[part] = value - off >= threshold
            still.append(part[(value - off < threshold) & (value + off >= threshold)])
        rest = np.concatenate(still) if still else np.zeros(0, np.int64)
        yield i[sure], j[sure], i[rest], j[rest]


#: What a row of ``embedding_links`` says: a spanning link, a class's count of links, or a pair still in doubt.
LINK, COUNT, DOUBT = 0, 1, 2


def _pair_of_tiles(tiles: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One task's work: counts of links, weighted by how many vectors a class stands for, a spanning forest, and pairs in doubt."""
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    parts = [tiles[tiles["side"] == s] for s in (0, 1)]
    same = bool((tiles["t0"] == tiles["t1"]).all())
    left = parts[0]
    if not same and not (len(left) and len(parts[1])):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "n", "kind")})
    right = left if same else parts[1]
    a = Coded.read(left)
    b = a if same else Coded.read(right)
    id_a, id_b = left["cls"].to_numpy(), right["cls"].to_numpy()
    many_a, many_b = left["many"].to_numpy(), right["many"].to_numpy()
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    forest = Forest(len(a) if same else len(a) + len(b))
    for i, j, x, y in tile_links(a, b, threshold, same):
        out.append((id_a[x], id_b[y], DOUBT))
        n_a += np.bincount(i, many_b[j], len(a)).astype(np.int64)
        n_b += np.bincount(j, many_a[i], len(b)).astype(np.int64)
        i, j = forest.add(i, j if same else j + len(a))
        out.append((id_a[i], id_b[j] if same else id_b[j - len(a)], LINK))
    frames = [pd.DataFrame({"a": a, "b": b, "n": 0, "kind": kind}) for a, b, kind in out]
    frames += [pd.DataFrame({"a": x[n > 0], "b": x[n > 0], "n": n[n > 0], "kind": COUNT}) for x, n in ((id_a, n_a), (id_b, n_b))]
    return pd.concat(frames, ignore_index=True).astype(dict.fromkeys(("a", "b", "n", "kind"), "int64"))


def embedding_links(classes: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, n, kind): spanning links, counts of the links of class a = b, and pairs in doubt.

    ``classes`` has cls, unit (bytes of doubles) and many. Every pair of classes meets in the one
    group of their two tiles; a tile holds about ``tile`` classes, 3 bytes for each component.
    """
    coded = materialize(classes.select("cls", "unit", "many").mapInArrow(_coded, f"cls long, many long, width long, {Coded.FIELDS}"), "coded")
    n = coded.count()
    tiles = max(-(-n // tile), min(8, -(-n // 256)), 1)
    mine, other = F.pmod(F.xxhash64("cls"), F.lit(tiles)), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    met = coded.select("*", mine.alias("mine")).withColumn("other", other)
    met = met.withColumns({"t0": F.least("mine", "other"), "t1": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")}).drop("mine", "other")
    return met.groupBy("width", "t0", "t1").applyInPandas(lambda pdf: _pair_of_tiles(pdf, threshold), "a long, b long, n long, kind long")


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with both their vectors to those that link in double precision."""
    for batch in batches:
        u, v = ([np.frombuffer(x, "<f8") for x in batch.column(c).to_pylist()] for c in ("unit_a", "unit_b"))
        ok = pa.array([float(x @ y) >= threshold for x, y in zip(u, v, strict=True)], pa.bool_())
        yield pa.record_batch([batch.column(c).filter(ok) for c in ("a", "b", "many_a", "many_b")], ["a", "b", "many_a", "many_b"])


def _settled(links: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b, many_a, many_b) among the pairs in doubt, from the vectors themselves."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("unit").alias(f"unit_{c}"), F.col("many").alias(f"many_{c}"))
    pairs = links.where(F.col("kind") == DOUBT).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return pairs.mapInArrow(lambda it: _exact(it, threshold), "a long, b long, many_a long, many_b long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """Links of all vectors by cosine: (vec_id, n_links, component_id, kept), a row for each input row.

    ``n_links`` counts the other rows with a cosine of at least ``threshold`` (double precision),
    ``component_id`` is the smallest id reachable by links, ``kept`` marks the row that has it.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. Equal unit vectors are compared once, as a class, whatever
    their number, and vectors of any length are compared whole; an id that is the smallest of several rows
    names the component, and all of its rows there are kept. A row with a null id links with nothing and is kept; rows that repeat an id are
    vectors of their own that share it. Empty tables give empty results; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("embedding"))
    units = rows.mapInArrow(_classes, "vec long, unit binary")
    units = materialize(units.withColumn("key", F.when(F.col("vec").isNotNull(), F.sha2("unit", 256))), "units")
    classes = units.where("key IS NOT NULL").groupBy("key").agg(F.min("vec").alias("cls"), F.count(F.lit(1)).alias("many"), F.first("unit").alias("unit"))
    classes = materialize(classes, "classes")
    links = materialize(embedding_links(classes, threshold, tile), "links")
    settled = materialize(_settled(links, classes, threshold), "settled")
    counts = links.where(F.col("kind") == COUNT).select(F.col("a").alias("cls"), "n")
    counts = counts.unionByName(settled.select(F.col("a").alias("cls"), F.col("many_b").alias("n"))).unionByName(settled.select(F.col("b").alias("cls"), F.col("many_a").alias("n")))
    counts = counts.groupBy("cls").agg(F.sum("n").alias("n"))
    edges = links.where(F.col("kind") == LINK).select("a", "b").unionByName(settled.select("a", "b"))
    components = connected_components(edges).withColumnRenamed("node", "cls")
    known = classes.select("key", "cls", "many").join(counts, "cls", "left").join(components, "cls", "left")
    known = known.select("key", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    joined = units.select("vec", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec")
    return joined.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec") == component, F.lit(True)).alias("kept"))
