"""Near-duplicate embeddings by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import bare, components, cut, table

COSINE = 0.98
RECALL = 0.999       # of the pairs at exactly the threshold, by the count alone
PROJECTIONS = 16
LEAD = 4             # projections that lay out the cells
BLOCK = 1024         # vectors of a block, about
SPAN = 8.0           # projections of unit vectors are standard normal: cells cover -4 to 4, the outer ones all beyond
_PAIRS = 1 << 16     # pairs that are verified at once


@dataclass(frozen=True)
class Windows:
    """Projections, the half width of a query's window, and the collisions that a pair needs."""

    axes: np.ndarray
    lead: float
    width: float
    least: int


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _at_least(n: int, p: float, k: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


@cache
def calibrate(dims: int, cosine: float = COSINE, recall: float = RECALL, projections: int = PROJECTIONS) -> Windows:
    """Unit vectors at the threshold are d = sqrt(2 - 2 cos) apart, so on a random axis they differ by d times a normal number.

    A window of 2 d holds such a pair with probability 0.95; the needed count is the largest that at least
    ``recall`` of such pairs reach.  Closer pairs collide more often.  Windows of the leading axes are wider (4.5 d), so that
    blocks which are skipped lose less than one pair in a hundred thousand.
    """
    distance = math.sqrt(max(2 - 2 * cosine, 1e-12))
    axes = np.random.default_rng(11).standard_normal((dims, projections))
    p = 2 * _normal_cdf(2.0) - 1
    least = max(k for k in range(projections + 1) if _at_least(projections, p, k) >= recall)
    return Windows(axes, 4.5 * distance, 2.0 * distance, least)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each place's least place reachable, after links between ``a`` and ``b``."""
    while True:
        one, two = label[a], label[b]
        low = np.minimum(one, two)
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(one: np.ndarray, two: np.ndarray, w: Windows, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs between two blocks of unit vectors, a part of the rows at a time.

    On each axis the second block is sorted; the window around a query then is a range of ranks.  A pair's
    collisions are counted over all axes, and pairs with enough of them are verified in double precision.
    """
    project_one, project_two = one @ w.axes, two @ w.axes
    order = np.argsort(project_two, axis=0)
    rank = np.empty(order.shape, np.uint32)
    np.put_along_axis(rank, order, np.arange(len(two), dtype=np.uint32)[:, None], axis=0)
    rank = np.ascontiguousarray(rank.T)
    step = max(1, _PAIRS // max(1, len(two)))
    for low in range(0, len(one), step):
        high = min(low + step, len(one))
        count = np.zeros((high - low, len(two)), np.uint8)
        for k in range(w.axes.shape[1]):
            ranked, query = project_two[order[:, k], k], project_one[low:high, k]
            begin = np.searchsorted(ranked, query - w.width, "left").astype(np.uint32)
            end = np.searchsorted(ranked, query + w.width, "right").astype(np.uint32)
            # ranks before the window wrap round to large numbers
            count += (rank[k][None, :] - begin[:, None]) < (end - begin)[:, None]
        i, j = np.nonzero(count >= w.least)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("nd,nd->n", one[i], two[j])
        yield i[exact >= cosine], j[exact >= cosine]


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _blocks(projected: DataFrame, width: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``projected`` with its block, and the (label, one, two) of blocks that can hold a pair within ``width`` on all axes.

    Cells are cubes of the leading axes, finer for a label of more vectors.  A dense cell is dealt out over
    several blocks by the hash of the id.  Blocks meet those of the cells around theirs, by an equal join.
    """
    axes = [f"p{k}" for k in range(LEAD)]
    cells = [f"c{k}" for k in range(LEAD)]
    sizes = projected.groupBy("label").agg(F.greatest(F.lit(1), F.round(F.pow(F.count("*") / block, F.lit(1 / LEAD)))).cast("int").alias("cuts"))
    placed = projected.join(sizes, "label")
    for c, p in zip(cells, axes):
        cut_at = F.floor((F.col(p) + SPAN / 2) * F.col("cuts") / SPAN).cast("int")
        placed = placed.withColumn(c, F.greatest(F.lit(0), F.least(cut_at, F.col("cuts") - 1)))
    dense = placed.groupBy("label", *cells).agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
    placed = placed.join(dense, ["label", *cells])
    placed = placed.withColumn("block", F.xxhash64(*cells, F.pmod(F.xxhash64("vec_id"), F.col("deals"))))
    placed = cut(placed.select("vec_id", "label", "v", "copies", "block", "cuts", *cells, *axes))
    ranges = placed.groupBy("label", "block", "cuts", *cells).agg(*[f(p).alias(f"{n}_{p}") for p in axes for n, f in (("low", F.min), ("high", F.max))])
    ranges = cut(ranges)
    around = ranges
    reach = F.ceil(F.lit(width) * F.col("cuts") / SPAN).cast("int")
    for c in cells:
        near = F.sequence(F.greatest(F.lit(0), F.col(c) - reach), F.least(F.col(c) + reach, F.col("cuts") - 1))
        around = around.withColumn(c, F.explode(near))
    other = ranges.select("label", *cells, F.col("block").alias("two"), *[F.col(f"{n}_{p}").alias(f"o_{n}_{p}") for p in axes for n in ("low", "high")])
    pairs = around.withColumnRenamed("block", "one").join(other, ["label", *cells]).filter("one <= two")
    for p in axes:
        pairs = pairs.filter((F.col(f"low_{p}") <= F.col(f"o_high_{p}") + width) & (F.col(f"o_low_{p}") <= F.col(f"high_{p}") + width))
    return placed.select("vec_id", "label", "v", "copies", "block"), pairs.select("label", "one", "two")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is at least ``cosine``.  Equal vectors of a label are one class
    with one representative.  Representatives are projected on random axes and dealt into blocks by the first
    few; blocks near each other on all of those meet in a task, which sorts one along every axis, counts
    in how many windows each pair collides, and verifies the pairs with enough.  A task holds two blocks and gives back
    counts of links and a spanning forest, not the pairs.

    ``n_links`` counts other rows linked directly, equal ones included; ``component_id`` is the least vec_id
    reachable.  Vectors that are null or empty, zero, or hold a null or non-finite number, and rows without label or
    vec_id link with nothing; vectors of different lengths don't link.  A vec_id that occurs twice is two rows,
    each judged by its vector.
    """
    rows = bare(embeddings, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
        F.concat_ws(":", F.size("embedding"), "label").alias("key"), F.col("label").isNotNull().alias("ok"))
    sane = F.col("ok") & F.col("vec_id").isNotNull() & (F.size("v") > 0)
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(sane & fine, F.lit(False))
    names = ["label", "h1", "h2"]
    rows = rows.select("vec_id", "v", F.when(ok, F.col("key")).alias("label"), F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v")).alias("h2"))
    good = rows.filter("label IS NOT NULL")
    classes = cut(good.groupBy(*names).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    spark = embeddings.sparkSession
    reps = good.join(classes.withColumn("vec_id", F.col("rep")), [*names, "vec_id"]).dropDuplicates([*names, "vec_id"])
    axes = [f"p{k}" for k in range(LEAD)]

    def project(batches):
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len)):
                x = _rows(part["v"])
                x /= np.linalg.norm(x, axis=1)[:, None]
                p = x @ calibrate(x.shape[1], cosine, recall).axes[:, :LEAD]
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "v": list(x), "copies": part["copies"], **dict(zip(axes, p.T))})

    kinds = "vec_id long, label string, v array<double>, copies long, " + ", ".join(f"{p} double" for p in axes)
    unit = cut(reps.select("vec_id", "label", "v", "copies").mapInPandas(project, kinds))
    placed, pairs = _blocks(unit, calibrate(1, cosine, recall).lead, block)
    sides = pairs.select("label", "one", "two", F.explode(F.when(F.col("one") == F.col("two"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("part"))
    sides = sides.withColumn("block", F.when(F.col("part") == 0, F.col("one")).otherwise(F.col("two")))
    met = placed.join(sides, ["label", "block"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "vec_id"])
        same = group["one"].iloc[0] == group["two"].iloc[0]
        x, split = _rows(group["v"]), 0 if same else int((group["part"] == 0).sum())
        one, two = (x, x) if same else (x[:split], x[split:])
        ids, weight = group["vec_id"].to_numpy(), group["copies"].to_numpy()
        counts, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for i, j in _links(one, two, calibrate(x.shape[1], cosine, recall), cosine, same):
            j = j + split
            counts += np.bincount(i, weight[j], len(x)).astype(np.int64) + np.bincount(j, weight[i], len(x)).astype(np.int64)
            label = _join(label, i, j)
        at, linked = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({
            "a": np.concatenate([ids[at], ids[linked]]), "b": np.concatenate([ids[at], ids[label[linked]]]),
            "n": np.concatenate([counts[at], np.zeros(len(linked), np.int64)])})

    found = cut(met.groupBy("label", "one", "two").applyInPandas(compare, "a long, b long, n long"))
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    by_class = classes.join(links, "rep", "left").join(roots, "rep", "left")
    by_class = by_class.select(*names, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    component = F.coalesce("c", "vec_id")
    return rows.drop("v").join(by_class, names, "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
