"""A yearly survey's records by year, horizon, unit and state: raw files of many layouts, one table partitioned by all four."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("year", "horizon", "unit", "ST")
UNITS = {"person": "p", "household": "h"}

# States by their number in the survey.
STATES = {
    "AL": 1, "AK": 2, "AZ": 4, "AR": 5, "CA": 6, "CO": 8, "CT": 9, "DE": 10, "FL": 12, "GA": 13, "HI": 15, "ID": 16, "IL": 17, "IN": 18, "IA": 19, "KS": 20, "KY": 21,
    "LA": 22, "ME": 23, "MD": 24, "MA": 25, "MI": 26, "MN": 27, "MS": 28, "MO": 29, "MT": 30, "NE": 31, "NV": 32, "NH": 33, "NJ": 34, "NM": 35, "NY": 36, "NC": 37,
    "ND": 38, "OH": 39, "OK": 40, "OR": 41, "PA": 42, "RI": 44, "SC": 45, "SD": 46, "TN": 47, "TX": 48, "UT": 49, "VT": 50, "VA": 51, "WA": 53, "WV": 54, "WI": 55,
    "WY": 56, "PR": 72,
}

# Relationships to the reference person as coded from 2019 on, and the code that each had before.
RELATIONSHIP_BEFORE_2019 = {20: 0, 21: 1, 22: 13, 23: 1, 24: 13, 25: 2, 26: 3, 27: 4, 28: 5, 29: 6, 30: 7, 31: 8, 32: 9, 33: 10, 34: 12, 35: 14, 36: 15, 37: 16, 38: 17}


@dataclass(frozen=True)
class Change:
    """From `year` on, `column` stands in the files as `name`; codes maps its values to those of before (others become null)."""

    year: int
    column: str
    name: str
    codes: Mapping[int, int] | None = None

    def restored(self) -> Column:
        raw = F.col(f"`{self.name}`")
        if self.codes is None:
            return raw
        return F.element_at(F.create_map(*[F.lit(x) for pair in self.codes.items() for x in pair]), raw.cast("int"))


CHANGES = (Change(2019, "RELP", "RELSHIPP", RELATIONSHIP_BEFORE_2019), Change(2023, "ST", "STATE"))


def reconciled(raw: DataFrame, year: int, columns: Mapping[str, str], changes: Iterable[Change] = CHANGES) -> DataFrame:
    """The columns (name to type) of one year's rows, whatever their names and codes in that year.

    An empty or unreadable cell is null. A column that the year lacks raises: a null in its place would look like an answer that wasn't given.
    Columns that aren't asked for don't matter, whatever their names.
    """
    newest = {c.column: c for c in sorted(changes, key=lambda c: c.year) if c.year <= year}
    source = {name: newest[name].name if name in newest else name for name in columns}
    absent = sorted(s for s in source.values() if s not in raw.columns)
    if absent:
        raise ValueError(f"the files of {year} have no {', '.join(absent)}")
    value = lambda name: newest[name].restored() if name in newest else F.col(f"`{name}`")
    return raw.select(*[value(name).try_cast(kind).alias(name) for name, kind in columns.items()])


def numbers(states: Iterable[str | int] | None) -> list[int]:
    """Numbers of states given by letters or numbers; all of them for None."""
    if states is None:
        return sorted(STATES.values())
    given = [STATES.get(str(s).upper(), s) for s in states]
    unknown = [str(s) for s in given if not str(s).isdecimal() or int(s) not in STATES.values()]
    if unknown:
        raise ValueError(f"no such state: {', '.join(unknown)}")
    return sorted({int(s) for s in given})


def file_names(year: int, unit: str, states: Iterable[str | int] | None = None) -> list[str]:
    """Names of a year's raw files: they changed in 2017."""
    if unit not in UNITS:
        raise ValueError(f"{unit} is none of {', '.join(UNITS)}")
    letters = {n: s.lower() for s, n in STATES.items()}
    return [f"psam_{UNITS[unit]}{n:02d}.csv" if year >= 2017 else f"ss{year % 100:02d}{UNITS[unit]}{letters[n]}.csv" for n in numbers(states)]


def read_raw(
    spark: SparkSession, root: str, years: Iterable[int], columns: Mapping[str, str], *, horizon: str = "1-Year", unit: str = "person", states: Iterable[str | int] | None = None, changes: Iterable[Change] = CHANGES
) -> DataFrame:
    """Rows of the raw files <root>/<year>/<horizon>/*.csv of the states: year, horizon, unit, ST, then `columns`.

    Only files of the wanted years and states are opened, found by one pattern a year (a state without a file is left out; a year without
    any raises), and only the wanted columns are parsed. All files of a year share its header.
    """
    columns = {"ST": "int"} | {k: v for k, v in columns.items() if k != "ST"}
    parts = []
    for year in sorted(set(years)):
        pattern = "{" + ",".join(file_names(year, unit, states)) + "}"
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(f"{root.rstrip('/')}/{year}/{horizon}/{pattern}")
        parts.append(reconciled(raw, year, columns, changes).select(F.lit(year).alias("year"), F.lit(horizon).alias("horizon"), F.lit(unit).alias("unit"), "*"))
    if not parts:
        raise ValueError("no year is asked for")
    return functools.reduce(DataFrame.unionByName, parts)


def person_columns(names: Iterable[str]) -> dict[str, str]:
    """Types of the columns that name a person, and of features and targets, which are numbers."""
    return {"SERIALNO": "string", "SPORDER": "int"} | {name: "int" for name in names}


def write_table(df: DataFrame, path: str) -> None:
    """Adds rows to a table partitioned by year, horizon, unit and state; partitions that df has rows of are replaced, others stay, so that a repeated run changes nothing.

    Rows aren't exchanged: the tasks that read a state's files write its partition.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def read_table(
    spark: SparkSession, path: str, years: Iterable[int] | int = 2018, *, horizon: str = "1-Year", unit: str = "person", states: Iterable[str | int] | None = None
) -> DataFrame:
    """The asked part of a table of write_table(); the rest isn't listed or opened. With SERIALNO (and SPORDER), row_id names a row: year, horizon, household, person.

    A person's row_id is the same in every run, whichever states are read. Years or states without rows give none.
    """
    if unit not in UNITS:
        raise ValueError(f"{unit} is none of {', '.join(UNITS)}")
    wanted = [years] if isinstance(years, int) else sorted(set(years))
    df = spark.read.parquet(path).where(F.col("year").isin(wanted) & (F.col("horizon") == horizon) & (F.col("unit") == unit))
    if states is not None:
        df = df.where(F.col("ST").isin(numbers(states)))
    parts = [c for c in ("SERIALNO", "SPORDER") if c in df.columns]
    if "SERIALNO" not in parts:
        return df
    return df.withColumn("row_id", F.concat_ws("-", F.col("year").cast("string"), "horizon", *[F.col(c).cast("string") for c in parts]))
