"""Every query with SQL gives the same rows as DuckDB; the others give rows at all."""

import importlib.util

import pytest
from compare import duck, rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    ours, theirs = rows(entry.queries()[name](spark, SF).toPandas()), rows(con.execute(SQL[name]).df())
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "quarter" in df.columns


def test_rest_imports_nothing_of_the_text_operators():
    import subprocess
    import sys

    code = "import sys, tidemark.plans; assert not [m for m in sys.modules if m.startswith('tidemark.llm') or m == 'corpus_pipeline']"
    assert importlib.util.find_spec("tidemark") and subprocess.run([sys.executable, "-c", code], cwd="/".join(entry.__file__.split("/")[:-1])).returncode == 0


def same_as_sql(spark, folder, name):
    return rows(entry.queries()[name](spark, str(folder)).toPandas()) == rows(duck(str(folder)).execute(SQL[name]).df())


@pytest.fixture()
def other(tmp_path):
    """The tables of SF by links, so that a test can put others in their place."""
    import pathlib

    for f in pathlib.Path(SF).glob("*.parquet"):
        (tmp_path / f.name).symlink_to(f)
    return tmp_path


def replaced(folder, table, sql):
    """A table of the folder made anew by SQL over the one that was there."""
    path, old = folder / f"{table}.parquet", f"{SF}/{table}.parquet"
    path.unlink()
    duck(SF).execute(f"copy ({sql.format(old=old)}) to '{path}' (format parquet)")


def test_search_finds_a_full_name(spark, other):
    replaced(other, "customer", "select * replace (case when c_custkey = 1 then 'BUILDING' else c_mktsegment end as c_mktsegment) from '{old}'")
    assert same_as_sql(spark, other, "f10_search")


def test_firms_of_almost_nothing_are_described(spark, other):
    replaced(other, "customer", "select * replace (case when c_custkey % 3 = 0 then -0.3 when c_custkey % 3 = 1 then -0.0::double else c_acctbal end as c_acctbal) from '{old}'")
    assert same_as_sql(spark, other, "f33_json_ld")


def test_firms_of_one_name_have_places_of_their_own(spark, other):
    replaced(other, "customer", "select * replace ('One' as c_name, 3 as c_nationkey) from '{old}'")
    got = entry.queries()["t02_table_sort"](spark, str(other)).toPandas()
    assert all(sorted(x for x in got[c] if x <= 100) == list(range(1, 101)) for c in ("by_size", "by_state"))


@pytest.mark.parametrize("name", ["j02_winning_providers", "j14_nested_providers", "m07_owner_documents", "r08_timeline"])
def test_large_tables_go_into_more_parts(spark, con, name, monkeypatch):
    """A task's rows stay as many however large a table is: the parts grow in number, and rows stay the same."""
    from tidemark.plans.fixtures import Tables

    parts = Tables.parts
    monkeypatch.setattr(Tables, "parts", lambda self, table, rows=500: parts(self, table, rows))
    df = entry.queries()[name](spark, SF)
    assert f", {Tables(spark, SF).parts('lineitem')})" in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df.toPandas()) == rows(con.execute(SQL[name]).df())


def test_many_events_go_into_more_archives(spark, con, monkeypatch, tmp_path):
    """No file of an archive is collected in a row, and an archive doesn't grow with the events."""
    from tidemark.plans import sources

    monkeypatch.setattr(sources, "DRP_ROWS", 50)
    monkeypatch.setattr(sources, "work_dir", lambda _: f"file://{tmp_path}/z")
    df = entry.queries()["m04_disclosure_events"](spark, SF)
    assert len(list((tmp_path / "z").glob("*.zip"))) == 20
    assert rows(df.toPandas()) == rows(con.execute(SQL["m04_disclosure_events"]).df())


@pytest.mark.parametrize("name", ["s04_archive_members", "m04_disclosure_events"])
def test_no_file_is_collected_in_a_row(spark, name, monkeypatch, tmp_path):
    from tidemark.plans import sources

    plans = []
    write = sources.write_archives
    monkeypatch.setattr(sources, "write_archives", lambda *a, **b: (out := write(*a, **b), plans.append(out._jdf.queryExecution().optimizedPlan().toString()))[0])
    entry.queries()[name](spark, SF)
    assert len(plans) == 1 and "collect_list" not in plans[0]


@pytest.mark.parametrize("rows_a_part", [500_000, 300])
def test_annual_reports_come_in_parts(spark, other, monkeypatch, tmp_path, rows_a_part):
    """No report is collected in a row, and many filings go into more files of a year; what a firm hasn't filed is null."""
    from tidemark.plans import reports

    replaced(other, "orders", "select * replace (case when o_custkey % 7 = 3 then null else o_totalprice end as o_totalprice) from '{old}'")
    monkeypatch.setattr(reports, "FILED_ROWS", rows_a_part)
    monkeypatch.setattr(reports, "shared_dir", lambda *_: f"file://{tmp_path}/z")
    plans = []
    write = reports.write_archives
    monkeypatch.setattr(reports, "write_archives", lambda *a, **b: (out := write(*a, **b), plans.append(out._jdf.queryExecution().optimizedPlan().toString()))[0])
    assert same_as_sql(spark, other, "m01_annual_reports")
    assert len(plans) == 1 and "collect_list" not in plans[0]
    names = sorted(f.name.partition("-")[2] for f in (tmp_path / "z").iterdir() if not f.name.startswith("."))
    assert len(set(names)) == 7 and len(names) == 7 * (5 if rows_a_part == 300 else 1)
