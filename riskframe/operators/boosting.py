"""Second-order boosted trees with a learned side for missing values.

Each level of a tree is one aggregate: gradients and Hessians added up by node, feature and bin. Spark chooses the splits from these sums as well;
the driver sees one row a node. Sums are of whole numbers, so trees don't depend on how rows are dealt or which tasks were repeated.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_folder

#: Gradients and Hessians are counted in units of 1 / UNIT. Sums of more than 2 ** 63 / UNIT rows (8.8e12) overflow, which Spark reports as an error.
UNIT = 1 << 20
#: Trees whose margins are computed anew for each level before they are written next to the rows.
PENDING = 5


@dataclass(frozen=True)
class Node:
    """A leaf (feature is None), or a split: values up to `edge` go left, missing ones where missing_left says."""

    value: float = 0.0
    feature: str | None = None
    edge: float = 0.0
    bin: int = 0
    missing_left: bool = False
    left: Node | None = None
    right: Node | None = None

    @staticmethod
    def of(record: dict) -> Node:
        return Node(**{k: Node.of(v) if k in ("left", "right") and v else v for k, v in record.items()})


@dataclass(frozen=True)
class Boosted:
    """A fitted model. probability() is a Column of the features' own values: scoring shuffles nothing."""

    base: float
    trees: tuple[Node, ...]

    def features(self) -> list[str]:
        def names(node: Node) -> set[str]:
            return set() if node.feature is None else {node.feature} | names(node.left) | names(node.right)

        return sorted(set().union(*[names(t) for t in self.trees]))

    def probability(self) -> Column:
        """In Arrow batches: as a CASE of all splits, twenty trees of four levels exceed what Java takes as one method."""
        if not self.trees:
            return F.lit(1 / (1 + math.exp(-self.base)))
        names, tables, base = self.features(), [], self.base
        for tree in self.trees:
            rows: list[list[float]] = []
            _flatten(tree, names, rows)
            tables.append(np.array(rows))

        @F.pandas_udf("double")
        def scored(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float, na_value=np.nan) for v in values])
            every, margin = np.arange(len(x)), np.full(len(x), base)
            for t in tables:
                at = np.zeros(len(x), dtype=int)
                while (inner := t[at, 0] >= 0).any():
                    value = x[every, np.maximum(t[at, 0], 0).astype(int)]
                    left = np.where(np.isnan(value), t[at, 2] > 0, value <= t[at, 1])
                    at = np.where(inner, np.where(left, t[at, 3], t[at, 4]), at).astype(int)
                margin += t[at, 5]
            return pd.Series(1 / (1 + np.exp(-margin)))

        return scored(*[F.col(f"`{n}`").cast("double") for n in names])

    def record(self) -> dict:
        """For JSON; of() reads it."""
        return {"base": self.base, "trees": [asdict(t) for t in self.trees]}

    @staticmethod
    def of(record: dict) -> Boosted:
        return Boosted(record["base"], tuple(Node.of(t) for t in record["trees"]))


def _flatten(node: Node, names: list[str], rows: list[list[float]]) -> int:
    """Appends feature's place (-1: a leaf), edge, missing_left, rows of the children and value; gives the node's own row."""
    at = len(rows)
    rows.append([-1, 0, 0, 0, 0, node.value])
    if node.feature is not None:
        left, right = (_flatten(n, names, rows) for n in (node.left, node.right))
        rows[at] = [names.index(node.feature), node.edge, node.missing_left, left, right, 0]
    return at


def present(column: str) -> Column:
    """A number; null where it is missing or not a number."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """The distinct upper ends of at most `bins` bins of about equal counts, without the last; none for a feature that is always missing. One aggregate of Spark's sketches."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(present(f), shares, 100 * bins).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return {f: sorted(set(row[f"e{i}"] or [])) for i, f in enumerate(features)}


def bin_of(value: Column, ends: list[float]) -> Column:
    """How many ends lie below a value: bin k holds the values up to ends[k]. Null stays null."""
    if not ends:
        return F.when(value.isNotNull(), F.lit(0))
    below = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < value))
    return F.when(value.isNotNull(), below)


def histogram(rows: DataFrame, features: list[str]) -> DataFrame:
    """node, feature (its place), bin (null: missing), g, h from rows with node, g, h and a bin column b<place> a feature. Rows are added up before they are exchanged, so a
    hot bin or a root that holds all rows costs a task no more than any other."""
    each = rows.select("node", "g", "h", F.posexplode(F.array(*[F.col(f"b{i}").cast("int") for i in range(len(features))])).alias("feature", "bin"))
    return each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def candidates(sums: DataFrame, penalty: float = 1.0, least: float = 1.0) -> DataFrame:
    """All splits that a histogram allows, after each bin and with missing values on either side: node, feature, bin, missing_left, gl, hl, gr, hr (units) and gain.

    gain: half of what the squared gradients over Hessians plus penalty win by the split. Both sides need a sum of Hessians of `least`, and the gain has to be above 0.
    A window holds the bins of one feature at one node.
    """
    whole = Window.partitionBy("node", "feature")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.col("bin").isNotNull()
    summed = sums.select(
        "node", "feature", "bin",
        *[F.coalesce(F.sum(F.when(there, F.col(x))).over(so_far), F.lit(0)).alias(f"{x}_up") for x in "gh"],
        *[F.sum(x).over(whole).alias(f"{x}_all") for x in "gh"],
        *[F.coalesce(F.sum(F.when(~there, F.col(x))).over(whole), F.lit(0)).alias(f"{x}_none") for x in "gh"],
    ).where(there)
    sided = summed.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    left = {x: F.col(f"{x}_up") + F.when(F.col("missing_left"), F.col(f"{x}_none")).otherwise(0) for x in "gh"}
    cut = sided.select("node", "feature", "bin", "missing_left", left["g"].alias("gl"), left["h"].alias("hl"), "g_all", "h_all")
    cut = cut.withColumn("gr", F.col("g_all") - F.col("gl")).withColumn("hr", F.col("h_all") - F.col("hl"))

    def worth(g: str, h: str) -> Column:
        part = F.col(g).cast("double") / UNIT
        return part * part / (F.col(h).cast("double") / UNIT + penalty)

    gain = (worth("gl", "hl") + worth("gr", "hr") - worth("g_all", "h_all")) / 2
    enough = (F.col("hl") >= least * UNIT) & (F.col("hr") >= least * UNIT)
    return cut.where(enough).withColumn("gain", gain).where("gain > 0").drop("g_all", "h_all")


def best(splits: DataFrame) -> DataFrame:
    """One split a node: of largest gain; of equal ones the first feature, its lowest bin, and missing values to the right."""
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("m"))
    return splits.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "missing_left", "gl", "hl", "gr", "hr"), order).alias("s")).select("node", "s.*")


def _grow(rows: DataFrame, features: list[str], ends: dict[str, list[float]], depth: int, rate: float, penalty: float, least: float) -> Node:
    """One tree, a job a level. Nodes are numbered as in a heap: the children of k are 2 k and 2 k + 1."""
    splits: dict[int, object] = {}
    value = lambda g, h: -rate * (g / UNIT) / (h / UNIT + penalty)

    def build(k: int, own: float) -> Node:
        s = splits.get(k)
        if s is None:
            return Node(own)
        name = features[s.feature]
        return Node(own, name, ends[name][s.bin], s.bin, s.missing_left, build(2 * k, value(s.gl, s.hl)), build(2 * k + 1, value(s.gr, s.hr)))

    def place(k: int, level: int) -> Column:
        """The node that a row has come to; null where it rests in a leaf above the level."""
        if level == 0:
            return F.lit(k)
        if k not in splits:
            return F.lit(None).cast("int")
        s = splits[k]
        return _either(f"b{s.feature}", s.bin, s.missing_left, place(2 * k, level - 1), place(2 * k + 1, level - 1))

    for level in range(depth):
        at = rows.withColumn("node", place(1, level)).where("node IS NOT NULL")
        found = best(candidates(histogram(at, features), penalty, least)).collect()  # at most 2 ** level rows
        if not found:
            break
        splits |= {s.node: s for s in found}
    return build(1, 0.0)


def _either(column: str, end: int, missing_left: bool, left: Column, right: Column) -> Column:
    """What isn't known to be true is otherwise, so a null goes where it should without a test of its own."""
    return F.when(F.col(column) > end, right).otherwise(left) if missing_left else F.when(F.col(column) <= end, left).otherwise(right)


def _value(node: Node, places: dict[str, int]) -> Column:
    """A tree's share of the margin, from bins."""
    if node.feature is None:
        return F.lit(node.value)
    return _either(f"b{places[node.feature]}", node.bin, node.missing_left, _value(node.left, places), _value(node.right, places))


def fit(df: DataFrame, features: list[str], label: str = "label", *, trees: int = 20, depth: int = 4, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0, bins: int = 64) -> Boosted:
    """Learns a 0/1 label by log loss. Rows without a label are left out; without any labelled row it raises. Columns but the features and the label aren't read.

    Features are binned once and written to the shared folder, as one row with a count for rows of the same bins and label; margins are added there after every PENDING trees, so that plans stay small and a lost executor
    costs no more than its tasks. Growing stops early where no split gains anything. Where all rows have one label, every score is close to it.
    """
    if not features or len(set(features)) < len(features):
        raise ValueError("features have to be named, each once")
    known = df.where(F.col(f"`{label}`").isNotNull())
    ends = edges(known, features, bins)
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/boosting-{uuid.uuid4().hex[:12]}"
    y = F.col(f"`{label}`").cast("int").alias("y")
    written, grown, waiting, places = f"{folder}/0", [], [], {f: i for i, f in enumerate(features)}
    try:
        binned = known.select(y, *[bin_of(present(f), ends[f]).cast("short").alias(f"b{i}") for i, f in enumerate(features)])
        # Rows of the same bins and label have the same margin in every tree: one stands for all.
        binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("margin", F.lit(0.0)).write.parquet(written)
        n, ones = spark.read.parquet(written).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0))).first()
        if not n:
            raise ValueError("no labelled rows to learn from")
        share = min(max(ones / n, 1e-6), 1 - 1e-6)
        base = math.log(share / (1 - share))
        for k in range(trees):
            rows = spark.read.parquet(written).withColumn("margin", sum((_value(t, places) for t in waiting), F.col("margin")))
            if len(waiting) == PENDING:
                before, written, waiting = written, f"{folder}/{k}", []
                rows.write.parquet(written)
                remove(spark, before)
                rows = spark.read.parquet(written)
            p = 1 / (1 + F.exp(-(F.col("margin") + base)))
            sloped = rows.withColumn("p", p).withColumn("g", F.round((F.col("p") - F.col("y")) * UNIT).cast("long") * F.col("n")).withColumn("h", F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long") * F.col("n"))
            tree = _grow(sloped.drop("p", "margin", "y", "n"), features, ends, depth, rate, penalty, least)
            if tree.feature is None:
                break
            grown.append(tree)
            waiting.append(tree)
    finally:
        remove(spark, folder)
    return Boosted(base, tuple(grown))
