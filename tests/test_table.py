"""Saved rows as a versioned table, and safe replacement of files."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators.extract import extract, extract_all
from leafmill.sources import files
from leafmill.sources.csv import column_names, read_csv, save_csv, save_snapshot, snapshots, write_csv
from leafmill.sources.table import FAN, RowTable


def headings(pages, *texts, **columns):
    rows = extract(pages("".join(f"<h1>{t}</h1>" for t in texts)), ["headings"])
    return rows.withColumns({name: F.lit(value) for name, value in columns.items()})


def texts(frame):
    return sorted(r["text"] for r in frame.collect())


def failing(rows):
    return rows.withColumn("text", F.when(F.col("pos") < 0, "x").otherwise(F.raise_error(F.lit("halfway"))))


def all_files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names}


def test_runs_are_replaced_one_by_one(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"), digits=1)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.save(headings(pages, "one", "two", "two"), "a") == 2
    assert table.save(headings(pages, "two", "three"), "b") == 2
    assert texts(table.read()) == ["one", "three", "two", "two"] and table.runs() == ["a", "b"]
    assert table.save(headings(pages, "four"), "a") == 1
    assert texts(table.read()) == ["four", "three", "two"] and texts(table.read("a")) == ["four"]
    assert table.save(headings(pages, "nothing").limit(0), "b") == 0
    assert texts(table.read()) == ["four"] and table.runs() == ["a"]
    assert {r["run_ts"] for r in table.read().collect()} == {"a"}


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"), digits=1)
    table.save(headings(pages, "one", "two"), "a")
    for write in (table.save, table.append):
        for run in ("a", "b"):
            if write == table.append and run == "a":
                continue
            with pytest.raises(Exception, match="halfway"):
                write(failing(headings(pages, "three")), run)
    assert texts(table.read()) == ["one", "two"] and table.version()["number"] == 1
    table.append(headings(pages, "three"), "b")
    assert texts(table.read()) == ["one", "three", "two"]
    assert table.clean() > 0 and texts(table.read()) == ["one", "three", "two"] and table.clean() == 0


def test_one_of_two_writers_is_told(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"), digits=1)
    before = table.version()
    table.save(headings(pages, "one"), "a")
    with pytest.raises(Exception, match="exists"):
        table._commit(before, runs=[])
    assert texts(table.read()) == ["one"] and not glob.glob(f"{tmp_path}/t/versions/*.tmp")


def test_a_failing_csv_write_leaves_the_old_rows(spark, pages, tmp_path):
    path = save_csv(headings(pages, "one", "two"), str(tmp_path / "rows.csv"))
    stored = headings(pages, "three")
    for json_cells in (True, False):
        with pytest.raises(Exception, match="halfway"):
            write_csv(failing(stored), path, json_cells=json_cells)
        assert texts(read_csv(spark, path)) == ["one", "two"]
    save_csv(stored, path)
    assert texts(read_csv(spark, path)) == ["three"]


def test_a_replacement_that_ended_early_is_undone(spark, pages, tmp_path):
    path = save_csv(headings(pages, "one"), str(tmp_path / "rows.csv"))
    os.rename(path, path + files.PREVIOUS)
    save_csv(headings(pages, "two"), path, append=True)
    assert texts(read_csv(spark, path)) == ["one", "two"] and not os.path.exists(path + files.PREVIOUS)


def test_appending_adds_what_is_new(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"), digits=1)
    assert table.append(headings(pages, "one", "two", "two"), "a") == 2
    assert table.append(headings(pages, "two", "three", "one"), "b") == 1
    assert table.append(headings(pages, "four"), "b") == 0  # a batch that is given again
    assert table.append(headings(pages, "one"), "c") == 0
    assert texts(table.read()) == ["one", "three", "two"] and texts(table.read("b")) == ["three"]
    # After a run was replaced, the index follows the rows that are left.
    table.save(headings(pages, "five"), "a")
    assert table.append(headings(pages, "one", "five", "three"), "d") == 1
    assert texts(table.read()) == ["five", "one", "three"]


def test_prompts_are_told_apart(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"), digits=1)
    for prompt, new in ((1, 1), (2, 1), (2, 0)):
        rows = headings(pages, "one", prompt_id=prompt)
        assert table.append(rows, f"run-{prompt}-{new}", scope=["prompt_id"]) == new
    with pytest.raises(ValueError, match="scope"):
        table.append(headings(pages, "one", prompt_id=1), "other")


def test_names_of_runs_and_columns(spark, pages, tmp_path):
    table = RowTable(spark, str(tmp_path / "t"))
    for run in ("a/b", "a=b", ""):
        with pytest.raises(ValueError, match="run"):
            table.save(headings(pages, "one"), run)
    with pytest.raises(ValueError, match="columns"):
        table.save(headings(pages, "one", run_ts="x"), "a")
    table.save(headings(pages, "one"), "a")
    with pytest.raises(ValueError, match="columns"):
        table.append(headings(pages, "two", more=1), "b")


def test_the_catalogue_knows_the_columns(spark, pages, tmp_path):
    html = "<table><tr><th>K<th>price<tr><td>a<td>1</table><h1>head</h1>"
    other = "<table><tr><th>Z<th>K<tr><td>a<td>1</table>"
    table = RowTable(spark, str(tmp_path / "t"))
    table.save(extract_all(pages(html)), "a", full=True)
    assert table.columns() == column_names(extract_all(pages(html)))
    # The first table row of this source is there, so what the run adds has another source.
    elsewhere = extract_all(pages(("https://elsewhere.example/", other)))
    table.append(elsewhere, "b")
    assert table.columns() == [*column_names(extract_all(pages(html))), "Z"]
    assert table.columns("b") == column_names(elsewhere)
    path = write_csv(table.read(), str(tmp_path / "wide.csv"), columns=table.columns(), json_cells=False)
    assert read_csv(spark, path).columns == table.columns()


def test_snapshots_are_runs_of_a_table(spark, pages, tmp_path):
    folder = str(tmp_path)
    for day, text in ((1, "one"), (2, "two")):
        path = save_snapshot(headings(pages, text, text), folder, now=datetime.datetime(2024, 1, day, 3))
        assert texts(read_csv(spark, path)) == [text]
    assert path == f"{folder}/crawl_20240102_030000.csv"
    saved = snapshots(spark, folder).read()
    assert sorted((r["run_ts"], r["text"]) for r in saved.collect()) == [
        ("20240101_030000", "one"), ("20240102_030000", "two"),
    ]
    assert save_snapshot(headings(pages, "x").limit(0), folder) == ""


def test_an_append_writes_and_reads_no_saved_rows(spark, pages, tmp_path):
    """Bytes that appends write do not grow with the table; a rare append merges keys."""
    path, written = str(tmp_path / "t"), []
    table = RowTable(spark, path, digits=1)
    for run in range(2 * FAN + 3):
        before = all_files(path)
        table.append(headings(pages, *[f"heading {run} {i}" for i in range(3)], "everywhere"), f"r{run:03d}")
        after = all_files(path)
        assert all(after.get(name) == size for name, size in before.items() if "/versions/" not in name)
        rows = sum(s for n, s in after.items() if n not in before and "/rows/" in n)
        keys = sum(s for n, s in after.items() if n not in before and "/keys/" in n)
        written.append((rows, keys))
    assert table.read().count() == 3 * len(written) + 1
    # The same rows cost the same, early and late.
    assert max(r for r, _ in written[-5:]) < 1.2 * max(r for r, _ in written[1:6])
    usual = sorted(k for _, k in written)[len(written) // 2]
    assert sum(k > 2.5 * usual for _, k in written) <= 2
    assert len(table.version()["keys"]) <= 2 * FAN
    fresh = table.keys().filter(F.col("bucket").isin("a", "b"))
    parts = {f.split("bucket=")[1][0] for f in fresh.select("content_key").inputFiles()}
    assert "PartitionFilters: [bucket" in fresh._jdf.queryExecution().executedPlan().toString() and len(parts) > 2
