"""Codes to texts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import missing

UNKNOWN = "N/A"
#: Dictionaries up to this size are written out in the plan; larger ones are one literal.
LITERAL_ENTRIES = 200


@dataclass(frozen=True)
class ColumnToText:
    """A column's label and how its values read. values: a dictionary of whole codes, or a function of a column."""

    name: str
    label: str
    values: dict[int, str] | Callable[[Column], Column] | None = None
    missing: str = UNKNOWN
    unknown: str = UNKNOWN
    value_only: bool = False

    def of(self, x: Column) -> Column:
        """The text; the fill for missing values; 'N/A' for codes that aren't whole or not in the dictionary."""
        if callable(self.values):
            text = self.values(x)
        else:
            table = self.values or {}
            code = F.when(x.cast("double") == F.floor(x.cast("double")), x.cast("int"))
            if len(table) > LITERAL_ENTRIES:
                known, code = F.from_json(F.lit(json.dumps({str(k): v for k, v in table.items()})), "map<string,string>"), code.cast("string")
            else:
                known = F.create_map(*[F.lit(v) for kv in table.items() for v in kv]) if table else F.lit(None).cast("map<int,string>")
            text = F.coalesce(F.try_element_at(known, code), F.lit(self.unknown))
        return F.when(missing(x), F.lit(self.missing)).otherwise(text)


def composed(codes: dict, labels: dict) -> dict:
    """Code to group to label, as one dictionary; groups without a label go."""
    return {k: labels[g] for k, g in codes.items() if g in labels}


def looked_up(df: DataFrame, column: str, table: DataFrame, *, code: str = "code", text: str = "text", into: str, fill: str = UNKNOWN, missing_fill: str | None = None) -> DataFrame:
    """Adds `into`, the text that the table has for the column's code. The table's codes are unique. Spark broadcasts the table if it
    is small enough by its own measure."""
    own = table.select(F.col(code).cast("long").alias("_code"), F.col(text).alias("_text"))
    x = F.col(column).cast("double")
    out = df.withColumn("_k", F.when(x == F.floor(x), x.cast("long"))).join(own, F.col("_k") == F.col("_code"), "left")
    filled = F.coalesce("_text", F.lit(fill))
    if missing_fill is not None:
        filled = F.when(missing(F.col(column)), F.lit(missing_fill)).otherwise(filled)
    return out.withColumn(into, filled).drop("_k", "_code", "_text")


def region_lookup(df: DataFrame, name: str, areas: DataFrame, *, aliases: dict[str, str] | None = None, regions: dict[str, str] | None = None, into: str = "region") -> DataFrame:
    """Adds the region of an area's name: by alias and exact name; else that of the first area, in file order, whose name holds it; else by
    the regions given for names; else 'N/A'. areas: position, area, region.

    Names are looked up once each. A name meets only areas that hold its rarest run of three letters, by an index of the areas' runs; these are then compared whole.
    """
    x = F.trim(F.split_part(F.col(name), F.lit("("), F.lit(1)))
    alias = F.create_map(*[F.lit(v) for kv in (aliases or {"": ""}).items() for v in kv])
    given = F.create_map(*[F.lit(v) for kv in (regions or {"": UNKNOWN}).items() for v in kv])
    named = df.withColumn("_name", F.coalesce(F.try_element_at(alias, x), x))
    names = named.select("_name").distinct()
    a = areas.select("position", F.col("area").alias("_area"), F.col("region").alias("_region"))
    exact = names.join(a, F.col("_name") == F.col("_area")).groupBy("_name").agg(F.min_by("_region", "position").alias("_exact"))
    rest = names.join(exact, "_name", "left_anti")
    inside = holding(rest, a).groupBy("_name").agg(F.min_by("_region", "position").alias("_inside"))
    found = names.join(exact, "_name", "left").join(inside, "_name", "left")
    region = F.coalesce("_exact", "_inside", F.try_element_at(given, F.col("_name")), F.lit(UNKNOWN))
    return named.join(found.select(F.col("_name").alias("_n"), region.alias(into)), F.col("_name").eqNullSafe(F.col("_n")), "left").drop("_n", "_name")


def _runs(x: Column, n: int) -> Column:
    """Distinct runs of n characters."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: x.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def holding(names: DataFrame, areas: DataFrame, run: int = 3) -> DataFrame:
    """Pairs of a _name and a row of areas whose _area holds it, from distinct names. Names shorter than a run are runs themselves, the empty one too, which all areas hold."""
    shorter = [_runs(F.col("_area"), n) for n in range(1, run)]
    index = areas.where("_area IS NOT NULL").withColumn("_run", F.explode(F.concat(_runs(F.col("_area"), run), *shorter, F.array(F.lit("")))))
    counts = index.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    own = names.where("_name IS NOT NULL").select("_name", F.explode(F.when(F.length("_name") < run, F.array("_name")).otherwise(_runs(F.col("_name"), run))).alias("_run"))
    # A name with a run that no area has is in none: it takes as few areas as there are, none.
    rarest = own.join(counts, "_run", "left").groupBy("_name").agg(F.min_by("_run", F.coalesce("_n", F.lit(0))).alias("_run"))
    return rarest.join(index, "_run").where(F.col("_area").contains(F.col("_name"))).drop("_run")
