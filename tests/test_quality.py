from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.operators.quality import broken_values, column_profile, load_shifts, load_changes, quality_findings, suspect_chunks
from lectern.sources.footers import footers, opened

COLUMNS = pa.schema([("id", pa.int32()), ("marks", pa.int32()), ("year", pa.int32()), ("section", pa.string()), ("load_no", pa.int32()), ("check_name", pa.string())])


def written(folder, rows, name="a", **how):
    table = pa.Table.from_pylist([dict(zip(COLUMNS.names, r)) for r in rows], schema=COLUMNS)
    (folder / "q.parquet").mkdir(exist_ok=True)
    pq.write_table(table, folder / "q.parquet" / f"{name}.parquet", **how)
    return str(folder / "q.parquet")


CLEAN = [(1, 5, 2020, "A", 0, "x"), (2, None, None, None, 0, "x"), (3, 100, 1990, "12", 0, "x"), (4, 1, 2099, "ABC", 0, "x")]
DIRTY = [(5, 0, 1989, "a", 1, "x"), (6, 101, 2100, "A ", 1, "x"), (7, None, 20244, "", 1, "x"), (8, 7, None, "ABCD", 1, "x"), (9, 7, 2020, "A\n", 1, "x")]
VALUES = sorted([("marks", "5"), ("marks", "6"), ("year", "5"), ("year", "6"), ("year", "7"), ("section", "5"), ("section", "6"), ("section", "7"), ("section", "8"), ("section", "9")])


@pytest.mark.parametrize("how", [{}, {"use_dictionary": False}, {"write_statistics": False}, {"write_statistics": False, "use_dictionary": False}, {"compression": "zstd"}, {"compression": "none", "data_page_version": "2.0"}])
def test_broken_values_whatever_the_file_tells(spark, tmp_path, how):
    written(tmp_path, CLEAN, "clean", **how)
    path = written(tmp_path, DIRTY, "dirty", **how)
    got = sorted((r["column_name"], r["item_key"]) for r in broken_values(spark, path).collect())
    assert got == VALUES


def test_clean_chunks_are_not_read(spark, tmp_path, monkeypatch):
    path = written(tmp_path, CLEAN + [(10, 5, 2020, "a", 0, "x")] * 2, row_group_size=4)
    got = sorted((r["row_group"], r["column_name"]) for r in suspect_chunks(spark, path).collect())
    assert got == [(1, "section")]
    assert [tuple(r) for r in broken_values(spark, path).collect()] == [("value", "section", "10")]


def test_paths_by_any_name_of_their_system(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert opened(str(tmp_path / "x")).read() == opened(f"file:{tmp_path}/x").read() == opened(f"file://{tmp_path}/x").read() == b"abc"


def test_dictionaries_are_decoded(spark, tmp_path):
    path = written(tmp_path, [(i, i % 3, 2000 + i % 2, "ABC"[i % 3], 0, "x") for i in range(1000)])
    found = {r["column_name"]: r for r in footers(spark, spark.read.parquet(path).inputFiles(), ["marks", "section", "year"], ["marks", "section"]).collect()}
    assert sorted(found["marks"]["items"]) == ["0", "1", "2"] and found["marks"]["complete"]
    assert sorted(found["section"]["items"]) == ["A", "B", "C"] and found["year"]["items"] is None
    assert (found["year"]["min_value"], found["year"]["max_value"], found["year"]["n_nulls"]) == ("2000", "2001", 0)


def test_empty_table(spark, tmp_path):
    path = written(tmp_path, [])
    assert quality_findings(spark, path).count() == 0
    profile = {r["column_name"]: r for r in column_profile(spark, path).collect()}
    assert profile["marks"]["n_rows"] == 0 and profile["marks"]["n_distinct"] == 0 and profile["marks"]["min_value"] is None


def test_profile_with_and_without_statistics(spark, tmp_path):
    rows = CLEAN + DIRTY
    written(tmp_path, rows[:4], "a")
    path = written(tmp_path, rows[4:], "b", write_statistics=False, use_dictionary=False)
    p = {r["column_name"]: r for r in column_profile(spark, path).collect()}
    assert (p["marks"]["n_rows"], p["marks"]["n_nulls"], p["marks"]["n_distinct"], p["marks"]["min_value"], p["marks"]["max_value"], p["marks"]["n_violations"]) == (9, 2, 6, "0", "101", 2)
    assert (p["section"]["n_nulls"], p["section"]["n_distinct"], p["section"]["n_violations"]) == (1, 8, 5)


def test_shifts(spark):
    def load(n, marks, nulls, section_nulls=0):
        return [(i, None if i < nulls else marks, 2020, None if i < section_nulls else "A", n) for i in range(20)]

    rows = load(0, 10, 1) + load(1, 10, 3) + load(3, 16, 3) + load(4, 16, 3, 3) + [(1, 5, 2020, "A", None)]
    df = spark.createDataFrame(rows, "id int, marks int, year int, section string, load_no int")
    got = sorted((r["column_name"], r["item_key"]) for r in load_shifts(df).collect())
    assert got == [("marks", "3"), ("section", "4")]


def test_changes_of_every_column(spark):
    rows = [(1, 10, None, "ab", 0), (2, 20, 2000, None, 0), (3, 30, None, None, 2), (4, None, None, None, 2), (5, 1, 1, "a", None)]
    df = spark.createDataFrame(rows, "id int, marks int, year int, section string, load_no int")
    got = {(r["load_no"], r["column_name"]): (r["n_rows"], r["null_share"], r["mean"], r["null_share_change"], r["mean_ratio"]) for r in load_changes(df).collect()}
    assert got[0, "marks"] == (2, 0.0, 15.0, None, None) and got[2, "marks"] == (2, 0.5, 30.0, 0.5, 2.0)
    assert got[0, "section"] == (2, 0.5, 2.0, None, None) and got[2, "section"] == (2, 1.0, None, 0.5, None) and len(got) == 8
    assert load_changes(df.where("false")).count() == 0
