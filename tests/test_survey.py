"""Raw survey files of several years, and the table made of them."""

from __future__ import annotations

import pytest

from riskframe import cli
from riskframe.sources import survey
from riskframe.sources.census import TASKS

COLUMNS = {"SERIALNO": "string", "SPORDER": "int", "AGEP": "int", "RELP": "int"}


@pytest.fixture()
def root(tmp_path):
    files = {
        "2016/1-Year/ss16pca.csv": "SERIALNO,ST,SPORDER,RELP,AGEP,year\n11,6,1,0,40,x\n11,6,2,13,,y\n",
        "2018/1-Year/psam_p06.csv": "RT,SERIALNO,SPORDER,ST,AGEP,RELP\nP,2018HU1,1,06,33,0\nP,2018HU1,2,06,five,2\n",
        "2018/1-Year/psam_p36.csv": "RT,SERIALNO,SPORDER,ST,AGEP,RELP\nP,2018HU2,1,36,50,0\n",
        "2018/5-Year/psam_p06.csv": "RT,SERIALNO,SPORDER,ST,AGEP,RELP\nP,2014HU1,1,06,21,0\n",
        "2018/1-Year/psam_h06.csv": "RT,SERIALNO,ST,NP\nH,2018HU1,06,2\n",
        "2019/1-Year/psam_p06.csv": "RT,SERIALNO,SPORDER,ST,AGEP,RELSHIPP\nP,2019HU1,1,06,33,20\nP,2019HU1,2,06,31,24\nP,2019HU1,3,06,3,99\n",
        "2023/1-Year/psam_p72.csv": "RT,STATE,SERIALNO,SPORDER,AGEP,RELSHIPP\nP,72,2023HU1,1,60,38\n",
    }
    for name, text in files.items():
        at = tmp_path / "raw" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_years_of_other_layouts(spark, root):
    df = survey.read_raw(spark, str(root / "raw"), [2016, 2018, 2019, 2023], COLUMNS)
    assert df.columns == ["year", "horizon", "unit", "ST", *COLUMNS]
    got = sorted(map(tuple, df.select("year", "ST", "SERIALNO", "SPORDER", "AGEP", "RELP").collect()), key=lambda r: r[:4])
    assert got == [
        (2016, 6, "11", 1, 40, 0), (2016, 6, "11", 2, None, 13),
        (2018, 6, "2018HU1", 1, 33, 0), (2018, 6, "2018HU1", 2, None, 2), (2018, 36, "2018HU2", 1, 50, 0),
        (2019, 6, "2019HU1", 1, 33, 0), (2019, 6, "2019HU1", 2, 31, 13), (2019, 6, "2019HU1", 3, 3, None),
        (2023, 72, "2023HU1", 1, 60, 17),
    ]


def test_only_wanted_files_are_opened(spark, root):
    raw = str(root / "raw")
    one = survey.read_raw(spark, raw, [2018], COLUMNS, states=["ny"])
    assert [f.rsplit("/", 1)[1] for f in one.inputFiles()] == ["psam_p36.csv"]
    assert "AGEP" not in next(x for x in one.select("SERIALNO")._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x).split("ReadSchema")[1]
    assert rows(survey.read_raw(spark, raw, [2018], COLUMNS, horizon="5-Year"), "SERIALNO", "horizon") == [("2014HU1", "5-Year")]
    assert rows(survey.read_raw(spark, raw, [2018], {"SERIALNO": "string", "NP": "int"}, unit="household"), "unit", "NP") == [("household", 2)]


def test_what_is_refused(spark, root):
    raw = str(root / "raw")
    with pytest.raises(ValueError, match="2018 have no WKHP"):
        survey.read_raw(spark, raw, [2018], {"WKHP": "int"})
    with pytest.raises(ValueError, match="no such state: XX"):
        survey.read_raw(spark, raw, [2018], COLUMNS, states=["XX"])
    with pytest.raises(ValueError, match="no year"):
        survey.read_raw(spark, raw, [], COLUMNS)
    with pytest.raises(ValueError, match="none of"):
        survey.file_names(2018, "family")


def test_table_is_pruned_and_added_to(spark, root):
    raw, path = str(root / "raw"), str(root / "table")
    survey.write_table(survey.read_raw(spark, raw, [2016, 2018, 2019], COLUMNS), path)
    survey.write_table(survey.read_raw(spark, raw, [2018], COLUMNS, horizon="5-Year"), path)
    before = rows(spark.read.parquet(path), "year", "horizon", "ST", "SERIALNO", "SPORDER")
    survey.write_table(survey.read_raw(spark, raw, [2018], COLUMNS, states=["CA"]), path)  # once more: nothing changes
    assert rows(spark.read.parquet(path), "year", "horizon", "ST", "SERIALNO", "SPORDER") == before and len(before) == 9

    two = survey.read_table(spark, path, [2018, 2019], states=[6])
    assert rows(two, "row_id") == [(f"{y}-1-Year-{y}HU1-{i}",) for y, n in ((2018, 2), (2019, 3)) for i in range(1, n + 1)]
    plan = two._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert all(c in filters for c in ("year", "horizon", "unit", "ST")) and "PushedFilters: []" in plan
    assert survey.read_table(spark, path, 2017).isEmpty()


def test_command_line_reads_part_of_a_survey(spark, root, tmp_path):
    """Years whose layouts differ, through to the metrics of a task that asks for the relationship."""
    task, path = TASKS["ACSIncome"], str(tmp_path / "people")
    at = tmp_path / "more"
    for year, name, codes in ((2018, "RELP", range(18)), (2019, "RELSHIPP", range(20, 39))):
        header = ["SERIALNO", "SPORDER", "ST", *(name if c == "RELP" else c for c in task.required)]
        cells = {name: 0, "AGEP": 40, "COW": 1, "SCHL": 21, "MAR": 1, "OCCP": 10, "POBP": 6, "WKHP": 40, "SEX": 1, "RAC1P": 1, "ST": 6}
        lines = [",".join(str({**cells, name: codes[i % len(codes)], "SERIALNO": f"{year}HU{i}", "SPORDER": 1, "PINCP": 1000 * i}[c]) for c in header) for i in range(100)]
        file = at / str(year) / "1-Year" / "psam_p06.csv"
        file.parent.mkdir(parents=True)
        file.write_text("\n".join([",".join(header), *lines]) + "\n")
    survey.write_table(survey.read_raw(spark, str(at), [2018, 2019], survey.person_columns(task.required)), path)
    args = ["--model", "hash", "--results-dir", str(tmp_path / "results"), "--data", path, "--survey-years", "2018,2019", "--states", "CA"]
    assert cli.records(cli.parser().parse_args(args)).count() == 200
    assert cli.records(cli.parser().parse_args([*args[:-4], "--survey-years", "2019"])).select("year").distinct().collect() == [(2019,)]
    with pytest.raises(ValueError, match="needs"):
        cli.records(cli.parser().parse_args([*args[:6], "--states", "CA"]))
    assert cli.main(args)["n_samples"] == 20
