"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) divided by its quality weight. Within a source, documents
are taken in the order of their keys. A source whose target exceeds its size is taken whole as often as
it fits (complete epochs); the rest goes to the first documents, up to the budget.

The documents that the rest goes to are those up to one key, the source's cut. It is found from sums over ranges of
keys, then over parts of the one range that the budget ends in, and within one of these; texts are never moved, each
row meets its source's cut. Ranges are even in the logarithm of the key: whatever the weights of a source, no range
has more than about a row in a thousand, and no part more than one in 240,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, unit_hash

WEIGHTS = (1, 2, 3)
#: Ranges of keys in which a key doubles, and parts of a range.
RANGES, PARTS = 256, 256
#: The first and last parts reach to 0 and to infinity.
_FARTHEST = 1 << 24
#: Sources up to which their table is sent to every task; with more, Spark chooses how to join it.
BROADCAST_SOURCES = 1 << 16


def n_words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def letter_share(text: str = "text") -> Column:
    """Quality weight of a document, from 0.05 to 1: its characters less those of symbols, capitals and digits, by all."""
    t = F.coalesce(F.col(text), F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "#*$%&|<>!=+_~^@0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), 1.0 - odd / F.greatest(F.length(t), F.lit(1)))


def source_targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size): target, the least of most * source_size and level * weight, where one level makes the targets sum up to share of all sizes.

    That level is where resharing the excess ends. Sources are ordered by code point, null last. One task orders them:
    sources are names, far fewer than documents, and the table has one row for each.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", w).withColumn("_cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("_full", F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", share * F.sum("source_size").over(every))
    )
    # Levels rise up to the first source, in the order of cap by weight, that is not filled, and fall after it: the highest is the one.
    level = (F.col("_all") - F.coalesce(F.col("_full"), F.lit(0.0))) / F.col("_open")
    filled = filled.withColumn("_level", F.when(level * F.col("weight") <= F.col("_cap"), level))
    target = F.least(F.col("_cap"), F.coalesce(F.max("_level").over(every), F.lit(float("inf"))) * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, quality: Column | None, seed: int) -> DataFrame:
    """The row as doc, and doc_id, source, size, key, bin: a function of the key that never falls as it rises, so that equal keys share a bin: the part of a range."""
    weight = letter_share(text) if quality is None else quality
    drawn = -F.log(unit_hash(doc_id, F.md5(F.coalesce(F.col(text), F.lit(""))), seed=seed))
    key = F.when((weight > 0) & ~F.isnan(weight.cast("double")), F.try_divide(drawn, weight.cast("double"))).otherwise(F.lit(float("inf")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), key.alias("key"))
    bin = F.greatest(F.lit(-_FARTHEST), F.least(F.lit(_FARTHEST), F.floor(F.log2("key") * (RANGES * PARTS))))
    return rows.withColumn("bin", F.coalesce(bin, F.lit(-_FARTHEST)).cast("int"))


#: A row's place in its source's order. Ties in the key go by doc_id, null last; rows that still tie are alike.
def _place() -> Column:
    return F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id")


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    own = sources.select(F.col("source").alias("_s"), *[c for c in sources.columns if c != "source"])
    return rows.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def cuts(thin: DataFrame, scratch: Scratch, share: float, most: float, weights: tuple[int, ...]) -> tuple[DataFrame, bool]:
    """One row a source: source, source_size, target, epochs (how often it is taken whole), cut_bin, cut (the place of the last row that is taken once more, of
    those in that bin; null if none is) and ties, most_ties (rows at that place, and how many of them are taken); and whether sources are few."""
    whole_range = F.floor(F.col("bin") / PARTS).cast("int")
    sums = scratch.table(thin.groupBy("source", whole_range.alias("at")).agg(F.sum("size").alias("at_size")), "ranges")
    targets = source_targets(sums.groupBy("source").agg(F.sum("at_size").alias("source_size")), share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < int(most), F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0.0)))
    targets = scratch.table(targets.select("source", "source_size", "target", "epochs", "rest"), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ends_in = (F.col("rest") > 0) & (F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("at_size"))
    bases = _with_sources(sums.withColumn("base", F.coalesce(F.sum("at_size").over(before), F.lit(0))), targets, few)
    first = scratch.table(bases.where(ends_in).select("source", F.col("at").alias("cut_range"), "base", "rest"), "first")
    # Parts of the range that the rest ends in, PARTS a source.
    parts = _with_sources(thin, first.select("source", "cut_range"), few).where(whole_range == F.col("cut_range")).groupBy("source", F.col("bin").alias("at")).agg(F.sum("size").alias("at_size"))
    parts = _with_sources(parts.withColumn("_upto", F.coalesce(F.sum("at_size").over(before), F.lit(0))), first, few).withColumn("base", F.col("base") + F.col("_upto"))
    ends = scratch.table(parts.where(ends_in).select("source", F.col("at").alias("cut_bin"), "base", "rest"), "ends")
    # The documents of the one part that the rest ends in; taken while half of the document or more lies within the rest.
    run = F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = _with_sources(thin, ends, few).where("bin = cut_bin").withColumn("taken", F.col("base") + run - F.col("size") / 2.0 <= F.col("rest")).withColumn("place", _place())
    cut = inside.withColumn("cut", F.max(F.when(F.col("taken"), F.col("place"))).over(Window.partitionBy("source"))).where("place = cut")
    cut = cut.groupBy("source", "cut").agg(F.count(F.lit(1)).alias("ties"), F.count_if("taken").alias("most_ties"))
    found = targets.join(ends.select(F.col("source").alias("_e"), "cut_bin"), F.col("source").eqNullSafe(F.col("_e")), "left").join(cut.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left")
    return scratch.table(found.select("source", "source_size", "target", "epochs", "cut_bin", "cut", "ties", "most_ties"), "cuts"), few


def _copied(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Adds source_size, target and copies. Only rows that tie at a cut, and are alike, have to be counted."""
    out = _with_sources(rows, sources, few).withColumn("place", _place())
    ahead = (F.col("bin") < F.col("cut_bin")) | (F.col("bin") == F.col("cut_bin")) & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
    tied = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("place") == F.col("cut")) & (F.col("most_ties") < F.col("ties")), F.lit(False))
    once = F.coalesce(ahead, F.lit(False)).cast("int")
    if sources.where("most_ties < ties").isEmpty():
        out = out.withColumn("once", once)
    else:
        counted = out.where(tied).withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("key"))).withColumn("once", (F.col("_r") <= F.col("most_ties")).cast("int")).drop("_r")
        out = out.where(~tied).withColumn("once", once).unionByName(counted)
    return out.withColumn("copies", F.col("epochs") + F.col("once"))


def mix(docs: DataFrame, *, share: float = 1.0, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None, seed: int = 7, keep: bool = False, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, key, source_size, target, copies, taken; a row for each row of docs.

    Null texts and texts without words have size 0 and cost nothing. A null source is a source. Ties in the key are
    ordered by doc_id; identical rows may swap places, with the same result. A document is taken at most `most` times
    (a whole number). Documents whose weight is null, not a number or not above 0 come after all others. The budget's last document is taken if that leaves the source nearer to its target. keep: column doc has the row.

    Keys are dealt into ranges, so that a source with a third of all rows is added up by many tasks, and ordered only
    within the part of one range that its budget ends in.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = _sized(docs, doc_id, text, source, quality, seed)
    thin = scratch.table(rows.drop("doc"), "sized")
    sources, few = cuts(thin, scratch, share, most, weights)
    out = _copied(rows if keep else thin, sources, few)
    return out.select(*(["doc"] if keep else []), "doc_id", "source", "size", "key", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of docs, each as often as the mix takes it."""
    out = mix(docs, keep=True, **parameters).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
