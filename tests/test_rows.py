"""Duplicates, profiles, files and streams."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from leafmill.operators.dedup import append_merge, dedup_content, dedup_full, dedup_removed
from leafmill.operators.extract import extract, extract_all
from leafmill.operators.profile import (
    cli_more, cli_sample, column_order, page_counts, summary_by_source, summary_by_type,
    summary_sample, summary_totals,
)
from leafmill.schema import FIELDS
from leafmill.session import drop_stored, exact_names, shared_folder, store
from leafmill.sources.csv import (
    column_names, drop_type, file_profile, output_path, read_csv, save_csv, save_snapshot, snapshot_path, widen,
)
from leafmill.sources.table import FAN, RowTable, scoped_key
from leafmill.streaming.pages import page_stream, stream_rows, stream_unique_rows

HTML = (
    "<title></title><h1>head</h1><h1>head</h1><p>" + "p" * 31 + "</p>"
    "<table><tr><th>K<th>price<tr><td>a,\"b\"<td>1</table><table><tr><td>x</table>"
    "<a href='/a\n b\"'>link text</a>"
)


@pytest.fixture(scope="module")
def rows(pages):
    return extract_all(pages(HTML, ("https://other/", HTML)))


def bag(frame, *columns):
    return sorted(map(repr, map(tuple, frame.select(*columns).collect())))


def test_dedup_keeps_the_first_and_one_table_row_per_source(rows):
    kept = dedup_content(rows)
    per_page = kept.orderBy("page_ord", "pos").groupBy("page_id").agg(F.collect_list("type")).collect()
    types = ["page_title", "heading_h1", "table_row", "paragraph", "link"]
    assert [r[1] for r in per_page] == [types, types]
    first = kept.filter("type = 'table_row'").first()
    assert first["cells"] == {"K": "K", "price": "price"}
    again = dedup_content(kept)
    assert bag(again, "page_id", "pos") == bag(kept, "page_id", "pos")
    assert tuple(dedup_removed(rows).first()) == (16, 10, 6)


def test_dedup_scope(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, "t", "x", "s"), (2, 1, 0, "t", "x", "s"), (2, 2, 0, "t", "x", "s"),
         (2, 3, 0, None, "x", "s"), (2, 4, 0, "", "x", "s")],
        "prompt_id int, page_ord int, pos int, text string, type string, source string",
    )
    kept = dedup_content(rows, ["prompt_id"])
    assert bag(kept, "prompt_id", "page_ord") == ["(1, 1)", "(2, 1)", "(2, 3)"]
    assert dedup_content(rows).count() == 2


def test_pages_of_one_place_are_told_apart(pages):
    html = "<h1>same</h1><a href={}>same link</a>"
    twice = pages(("https://a/", html.format("x")), ("https://a/", html.format("y")))
    kept = dedup_content(extract_all(twice.withColumn("page_ord", F.lit(1)).repartition(8)))
    assert bag(kept, "page_id", "href") == ["(0, '')", "(0, 'https://a/x')"]


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    rows = spark.range(0, 1000, 1, 4).selectExpr(
        "id page_ord", "0 pos", "string(id div 5000) text", "'x' type", "'s' source"
    )
    plan = dedup_content(rows)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_append_merge(spark):
    saved = spark.createDataFrame(
        [("s", "x", "old", "1"), ("s", "x", "old", "2"), ("s", "table_row", None, "3"), ("s", "y", None, "4")],
        "source string, type string, text string, href string",
    )
    new = spark.createDataFrame(
        [(0, 0, "s", "x", "old", "5"), (0, 1, "s", "x", "new", "6"), (0, 2, "s", "table_row", None, "7"),
         (0, 3, "s", "y", "", "8"), (0, 4, "s", "x", "new", "9")],
        "page_ord int, pos int, source string, type string, text string, href string",
    )
    assert bag(append_merge(saved, new), "href") == ["('1',)", "('3',)", "('4',)", "('6',)", "('8',)"]
    assert append_merge(saved, new, missing_equals_empty=True).count() == 4


def test_profiles(rows, pages):
    assert tuple(summary_totals(rows).first()) == (16, 8)
    names = [r["name"] for r in column_order(rows).orderBy("first_met").collect()]
    assert names == ["source", "type", "text", "href", "table_index", "K", "price", "col_0"]
    by_type = summary_by_type(rows).collect()
    assert [tuple(r) for r in by_type] == [
        ("table_row", 6), ("heading_h1", 4), ("link", 2), ("page_title", 2), ("paragraph", 2),
    ]
    assert sum(r["n_rows"] for r in summary_by_source(rows).collect()) == 16
    counts = page_counts(pages(HTML, "", None)).orderBy("page_id").collect()
    assert [r["total_rows"] for r in counts] == [8, 0, 0]
    assert [counts[0][k] for k in ("structured", "metadata", "headings", "tables")] == [0, 1, 2, 3]
    shown = summary_sample(rows).collect()
    assert [r["text"] for r in shown] == ["", "head", "head", "nan", "nan"]
    assert [r["text"] for r in cli_sample(rows).collect()] == ["", "head", "head", "", ""]
    assert cli_more(rows).first()[0] == 11 and cli_more(rows.limit(2)).first()[0] == 0
    assert tuple(summary_totals(rows.limit(0)).first()) == (0, 0)


def test_save_and_read(spark, rows, tmp_path):
    path = save_csv(rows, str(tmp_path / "out"), json_cells=False)
    part = glob.glob(f"{path}/part-*.csv")[0]
    with open(part, "rb") as f:
        assert f.read(9) == b"\xef\xbb\xbfsource"
    saved = read_csv(spark, path)
    assert saved.columns == ["source", "type", "text", "href", "table_index", "K", "price"]
    assert saved.count() == 10
    link = saved.filter("type = 'link'").first()
    assert link["href"].endswith('/a b"') or "\n" in link["href"]
    table = saved.filter("type = 'table_row'").first()
    assert (table["table_index"], table["text"], table["K"]) == ("0.0", None, "K")
    profile = file_profile(spark, path).first()
    assert (profile["n_rows"], profile["n_columns"]) == (10, 7) and profile["n_bytes"] > 0
    assert drop_type(saved).columns == ["source", "text", "href", "table_index", "K", "price"]


def test_table_numbers_alone_are_whole(spark, pages, tmp_path):
    path = save_csv(extract(pages(HTML), ["tables"]), str(tmp_path / "tables"), json_cells=False)
    assert [r["table_index"] for r in read_csv(spark, path).collect()] == ["0"]


def test_values_survive_a_round_trip(spark, pages, tmp_path):
    odd = ['say "hi", you', "back\\slash \\", "semi;colon", "=1+1", "'q'", 'ends with "', ' lead']
    page = "".join(f"<div class=quote><span class=text>{t}</span><a class=tag>{t}</a></div>" for t in odd)
    html = page + "".join(f"<a href='{t.replace(chr(39), '')}\nx'>link {i}</a>" for i, t in enumerate(odd))
    rows = extract(pages(html), ["quotes", "links"])
    saved = read_csv(spark, save_csv(rows, str(tmp_path / "odd")))
    expected = rows.select(*[F.nullif(c, F.lit("")).alias(c) for c in ("type", "text", "tags", "href")])
    assert bag(saved, "type", "text", "tags", "href") == bag(expected, "type", "text", "tags", "href")


def test_appending_to_a_file(spark, pages, tmp_path):
    path = str(tmp_path / "grown")
    save_csv(extract(pages("<h1>one</h1><h1>two</h1>"), ["headings"]), path, json_cells=False)
    more = extract(pages("<h1>two</h1><h1>new</h1><table><tr><th>Z<tr><td>z</table>"))
    save_csv(more, path, append=True, json_cells=False)
    saved = read_csv(spark, path)
    assert saved.columns == ["source", "type", "text", "href", "table_index", "Z"]
    assert bag(saved, "text") == ["('new',)", "('one',)", "('two',)", "(None,)"]


def test_any_header_can_be_a_column(spark, pages, tmp_path):
    names = ["Price", "price", "Text", "U.S. `size`", "", "a,b", "Table_Index", "page_ord", "_new"]
    header = "".join(f"<th>{n}</th>" for n in names)
    cells = "".join(f"<td>{i}</td>" for i in range(len(names)))
    html = f"<table><tr>{header}</tr><tr>{cells}</tr></table><p>{'x' * 31}"
    path = save_csv(extract(pages(html), ["tables", "paragraphs"]), str(tmp_path / "names"), json_cells=False)
    saved = read_csv(spark, path)
    assert saved.columns[:3] == ["source", "type", "table_index"]
    assert set(names) - {""} <= set(saved.columns) and len(saved.columns) == 14
    save_csv(extract(pages(html.replace("<th>", "<th>A")), ["tables", "paragraphs"]), path, append=True, json_cells=False)
    with exact_names(spark):
        assert read_csv(spark, path).count() == 2
    assert "APrice" in read_csv(spark, path).columns


def test_headers_named_like_kept_columns(spark, pages, tmp_path):
    html = "<table><tr><th>Pos<th>prompt_id<th>Page_Ord<th>Pos_cell<tr><td>1<td>2<td>3<td>4</table>"
    rows = extract(pages(html), ["tables"]).withColumn("prompt_id", F.lit(7))
    wide = widen(rows, keep=["prompt_id", "page_ord", "pos"])
    assert {"Pos_cell_cell", "prompt_id_cell", "Page_Ord_cell", "Pos_cell"} <= set(wide.columns)
    wide.write.parquet(str(tmp_path / "wide"))
    assert spark.read.parquet(str(tmp_path / "wide")).filter("Pos_cell_cell = '1'").count() == 1
    path = str(tmp_path / "saved")
    save_csv(rows, path, scope=["prompt_id"], full=True, json_cells=False)
    saved = read_csv(spark, path)
    assert saved.select("prompt_id", "prompt_id_cell").filter("prompt_id_cell = '2'").first()["prompt_id"] == "7"
    save_csv(rows, path, scope=["prompt_id"], append=True, json_cells=False)
    assert set(saved.columns) <= set(read_csv(spark, path).columns)


def test_appending_per_prompt(spark, pages, tmp_path):
    path, rows = str(tmp_path / "prompts"), extract(pages("<h1>one</h1>"), ["headings"])
    for prompt in (1, 2, 2):
        asked = rows.withColumn("prompt_id", F.lit(prompt))
        save_csv(asked, path, append=True, scope=["prompt_id"])
    assert bag(read_csv(spark, path), "prompt_id", "text") == ["('1', 'one')", "('2', 'one')"]


def test_cells_as_json(spark, rows, tmp_path):
    saved = read_csv(spark, save_csv(rows, str(tmp_path / "json")))
    assert saved.filter("type = 'table_row'").first()["cells"] == '{"K":"K","price":"price"}'


def test_nothing_to_save(spark, pages, tmp_path):
    path = str(tmp_path / "none")
    assert save_csv(extract_all(pages("<p>short")), path) == ""
    assert glob.glob(path) == []


def test_wide_table_has_a_bound(rows):
    with pytest.raises(ValueError):
        column_names(rows, 3)
    names = column_names(rows)
    assert widen(rows, names).columns == ["page_ord", "pos", *names]


def test_paths(tmp_path, rows):
    assert output_path("/out", "a.csv") == "/out/a.csv"
    assert output_path("/out", "/b/a.csv") == "/b/a.csv"
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert snapshot_path("/out", "crawl", when) == "/out/crawl_20240102_030405.csv"
    assert save_snapshot(rows, str(tmp_path), "x").startswith(f"{tmp_path}/x_2")


def test_streams(spark, pages, tmp_path):
    folder, batches = str(tmp_path / "in"), [pages("<h1>one</h1><h1>two</h1>"), pages("<h1>two</h1><h1>new</h1>")]
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(folder)
        everything = stream_rows(page_stream(spark, folder), f"{tmp_path}/all", f"{tmp_path}/c1")
        unique = stream_unique_rows(page_stream(spark, folder), f"{tmp_path}/unique", f"{tmp_path}/c2")
        for stream in (everything, unique):
            assert stream.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/all").count() == 4
    saved = RowTable(spark, f"{tmp_path}/unique").read()
    assert bag(saved, "text", "run_ts") == [
        "('new', 'batch-000000000001')", "('one', 'batch-000000000000')", "('two', 'batch-000000000000')",
    ]


def test_a_batch_reads_few_files_however_many_came_before(spark, pages, tmp_path):
    """Seventeen batches of one new heading and one that all have: what the last reads does not grow with them."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "unique")
    for n in range(2 * FAN + 1):
        pages(f"<h1>every page</h1><h1>heading {n}</h1>").coalesce(1).write.mode("append").parquet(folder)
    stream = stream_unique_rows(page_stream(spark, folder, maxFilesPerTrigger=1), path, f"{tmp_path}/c", digits=1)
    assert stream.awaitTermination(300)
    table = RowTable(spark, path)
    assert len(table.runs()) == 2 * FAN + 1 and table.read().count() == 2 * FAN + 2
    found = table.version()
    assert len(found["keys"]) < FAN
    key = scoped_key()
    bucket = table.read().filter("text = 'every page'").select(F.substring(key, 1, 1)).first()[0]
    read = table.keys(found).filter(F.col("bucket") == bucket)
    assert read.count() >= 1 and len(read.inputFiles()) <= 16 * FAN
    # A batch that is given again finds its run.
    assert table.append(extract_all(pages("<h1>other</h1>")), table.runs()[3]) == 0


def test_full_dedup_keeps_table_rows(spark, pages):
    html = "<table><tr><td>one<tr><td>two<tr><td>one</table>"
    rows = extract(pages(html, html), ["tables"])
    assert dedup_content(rows).count() == 1
    assert sorted(r["cells"]["col_0"] for r in dedup_full(rows).collect()) == ["one", "two"]


def test_profile_counts_the_bytes_of_all_parts(spark, pages, tmp_path):
    path = save_csv(extract(pages("<h1>one</h1>", "<h1>two</h1>", "<h1>three</h1>"), ["headings"]), str(tmp_path / "rows.csv"))
    parts = [f for f in os.listdir(path) if f.endswith(".csv")]
    profile = file_profile(spark, path).first()
    assert profile["n_files"] == len(parts)
    assert profile["n_rows"] == 3 and profile["n_bytes"] == sum(os.path.getsize(f"{path}/{f}") for f in parts)


def test_repeated_headers_and_links_need_no_setting(spark, pages):
    """The last cell of a repeated header, the first of equal links, under the session's own map policy."""
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    html = (
        "<table><tr><th>A<th>B<th>A<th>C<th>B<tr><td>1<td>2<td>3<td>4<td>5</table>"
        "<a href='/x'>link</a><a href='/y'>other</a><a href='/x'>li<b>nk</b></a><a href='/x'>third</a>"
    )
    table = extract(pages(html), ["tables"]).filter("pos = 1").first()["cells"]
    assert list(table.items()) == [("A", "3"), ("B", "5"), ("C", "4")]
    links = extract(pages(html), ["links"]).orderBy("pos").collect()
    assert [(r["pos"], r["text"], r["href"][-2:]) for r in links] == [
        (0, "link", "/x"), (1, "other", "/y"), (2, "third", "/x"),
    ]


def test_without_ansi_mode(spark, pages):
    html = '<div class="thumbnail"><h4 class="price">$1</h4><a class="title">item</a></div>'
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert extract(pages(html), ["products"]).first()["rating"] == "0"
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_extraction_moves_nothing(spark, pages):
    plan = extract(pages("<h1>one</h1>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    dealt = extract(pages("<h1>one</h1>"), partitions=3)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(3)" in dealt


def test_shared_folder_of_a_cluster_must_be_named():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_stored_copies_can_be_dropped(spark):
    copy = store(spark.range(3), "copy")
    (file, *_) = copy.inputFiles()
    assert drop_stored(spark) >= 1 and not os.path.exists(file.removeprefix("file:"))


def test_rows_equal_in_full_tell_where_fields_end(spark, pages):
    """Absent, empty and neighbouring values are told apart, the order of cells is not."""
    fields = ["source", "type", "text", "href", "author"]
    values = [("a", "b", "c", "d", "e"), ("a", "b", "c", "de", ""), ("a", "b", "cd", "", "e"), ("a", "b", "c", "1:d", "e"),
              ("a", "b", "c", None, "e"), ("a", "b", "c", "", "e"), ("a", "b", "c", "-", "e"), (None, "b", "c", "d", "e"), ("a", "b", "c", "d", "e")]
    cells = [{"k": "1", "l": "2"}, {"l": "2", "k": "1"}, {"k": "1", "l": None}, {"k": '1"},{"key":"l","value":"2'}, {}, None]
    rows = [(i, 0, *v, c) for i, (v, c) in enumerate((v, c) for v in values for c in cells)]
    kind = "page_ord bigint, pos int, " + ", ".join(f"{f} string" for f in fields) + ", cells map<string,string>"
    absent = [F.lit(None).cast("string").alias(f) for f in FIELDS if f not in fields]
    kept = dedup_full(spark.createDataFrame(rows, kind).select("*", *absent))
    first = {(v, str(sorted(c.items()) if c is not None else None)): i for i, v, c in reversed([(r[0], r[2:-1], r[-1]) for r in rows])}
    assert sorted(r["page_ord"] for r in kept.collect()) == sorted(first.values())


def test_pages_are_shredded_once(spark, pages):
    """Also where only tables are asked for, whose rows no lambda makes."""
    html = "<table><tr><th>text<th>Z<tr><td>t<td>z<tr></table><p>" + "long " * 9 + "<table><tr><td>1</table>"
    given = pages(html, "<p>none", "").repartition(2)
    alone, among = extract(given, ["tables"]), extract(given, ["paragraphs", "tables"])
    for rows in (alone, among):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    assert alone.columns == among.columns
    shown = [[r["table_index"], r["type"], r["text"], r["cells"]] for r in alone.orderBy("pos").collect()]
    assert shown == [
        [0, "table_row", "text", {"text": "text", "Z": "Z"}], [0, "table_row", "t", {"text": "t", "Z": "z"}],
        [1, "table_row", None, {"col_0": "1"}],
    ]
    tables = among.filter("family_rank = 8").orderBy("pos").collect()
    assert [[r["table_index"], r["type"], r["text"], r["cells"]] for r in tables] == shown
