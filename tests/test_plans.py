"""Plans from prompts and from stored replies; fetch logs and planned pages."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators.bloom import MAX_BLOCKS, bloom_filter, n_blocks, possible
from leafmill.operators.extract import extract
from leafmill.plans import fixed
from leafmill.plans.replies import empty_plans, plan_summary, plan_urls, plans
from leafmill.plans.routing import catalog, page_categories, route, topic
from leafmill.run import run, run_report
from leafmill.sources import pages as page_sources
from leafmill.sources.csv import MAX_COLUMNS, read_csv
from leafmill.sources.pages import PlannedPages, _hot_urls, extract_planned, planned_pages, resolve_fetches

PROMPTS = {
    "a book shop": "books",
    "Bread and butter": "books",
    "INSPIRE me about jobs": "quotes",
    "a network of things": "jobs",
    "current prices": "news",
    "price of a Laptop": "products",
    "volcanoes": "general",
    "": "general",
    "booK": "books",
}


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "prompt_id bigint, prompt string")


def test_route(spark):
    got = route(prompts(spark, PROMPTS)).select("prompt", "rule").collect()
    assert dict(map(tuple, got)) == PROMPTS


def test_plan_urls(spark):
    planned = plan_urls(plans(prompts(spark, PROMPTS)))
    by_prompt = {}
    for r in planned.orderBy("prompt_id", "pos").collect():
        by_prompt.setdefault(r["prompt_id"], []).append(r)
    counts = {"books": 10, "quotes": 10, "jobs": 2, "news": 5, "products": 4, "general": 5}
    assert [len(by_prompt[i]) for i in range(len(PROMPTS))] == [counts[r] for r in PROMPTS.values()]
    ninth = by_prompt[0][9]
    assert (ninth["pos"], ninth["url"], ninth["source_name"]) == (
        10, "https://books.toscrape.com/catalogue/page-10.html", "Books Page 10",
    )
    first = by_prompt[6][0]
    assert first["url"] == "https://en.wikipedia.org/wiki/volcanoes"
    assert first["description"] == "Wikipedia article on volcanoes"
    assert first["expected_elements"] == ["h1", "h2", "h3", "p", "table", "li"]


def test_topic_is_cut_after_replacing(spark):
    text = "É " + "x y" * 30
    assert prompts(spark, [text]).select(topic(F.col("prompt"))).first()[0] == text.replace(" ", "_")[:50]


PLAN = {
    "project_description": "P",
    "data_type": "D",
    "urls": [
        {"url": "https://u@h:1/x", "source_name": "", "description": "d", "expected_elements": ["p"]},
        {"source_name": "S"},
    ],
    "target_columns": ["a", "b"],
    "scraping_strategy": "deep",
    "estimated_rows": 7,
}
GOOD = json.dumps(PLAN)
REPLIES = {
    GOOD: 2,
    f"  ```json\n{GOOD}\n```  ": 2,
    f"```{GOOD}```": 2,
    f"```json {json.dumps(PLAN, indent=1)}\n\n```\n": 2,
    f"Sure: ```{GOOD}```": None,
    f"{GOOD} done": None,
    f"{GOOD}{GOOD}": None,
    f"[{GOOD}]": None,
    '{"data_type": "D"}': 0,
    '{"urls": []}': 0,
    '{"urls": null}': None,
    '{"urls": 5}': None,
    '{"urls": {}, "estimated_rows": "500"}': 0,
    "": None,
    None: None,
    "null": None,
    '{"urls": [{"url": 5}, {}]}': 2,
    '{"a": "line\nbreak"}': None,
}


NEVER = object()


def _plan_by_hand(reply):
    """The fields of a reply by Python's own reader; NEVER when it is no plan."""
    try:
        found = json.loads(reply)
        len(found.get("urls", []))
    except (ValueError, TypeError, AttributeError):
        return NEVER

    def text(value):
        plain = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        return "None" if value is None else plain

    def texts(values):
        return [text(v) for v in values] if isinstance(values, list) else None

    urls = found.get("urls") if isinstance(found.get("urls"), list) else []
    names = ["project_description", "data_type", "scraping_strategy", "estimated_rows"]
    return {n: text(found[n]) if n in found else None for n in names} | {
        "target_columns": texts(found.get("target_columns")),
        "urls": [
            {k: None if u.get(k) is None else text(u[k]) for k in ("url", "source_name", "description")}
            | {"expected_elements": texts(u.get("expected_elements"))}
            for u in urls if isinstance(u, dict)
        ],
    }


def _random_reply(rng):
    def value(depth):
        kind = rng.randrange(9 if depth else 7)
        if kind < 4:
            return rng.choice(["a", "", " x\"y\\", "true", "5", "null", "é\n\u2028", "[1", "NaN"])
        if kind < 7:
            return rng.choice([None, True, False, 0, -7, 12345678901234567890, 2.5])
        if kind == 7:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice("ab"): value(depth - 1) for _ in range(rng.randrange(3))}

    def target():
        if rng.random() < 0.2:
            return value(1)
        names = rng.sample(["url", "source_name", "description", "expected_elements", "else"], rng.randrange(6))
        return {n: [value(1)] * 2 if n == "expected_elements" and rng.random() < 0.7 else value(1) for n in names}

    plan = {n: value(2) for n in rng.sample([*PLAN, "other"], rng.randrange(8))}
    if rng.random() < 0.8:
        plan["urls"] = [target() for _ in range(rng.randrange(4))]
    text = json.dumps(plan, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    if rng.random() < 0.4:  # repeated names
        lists = ["urls", "target_columns"]
        more = {n: rng.choice([None, 5, True, [], {"a": 1}]) if n in lists else value(1) for n in rng.sample([*PLAN], 2)}
        text = text[:-1] + (", " if plan else "") + json.dumps(more)[1:]
    damage = rng.random()
    if damage < 0.1:
        return text + rng.choice([" x", "}", "]", ", {}", "], [{}", '}, {"v": 1', "//", "{", '"'])
    if damage < 0.2:
        at = rng.randrange(len(text))
        return text[:at] + rng.choice(["'", ",", "\t", "", "\\", "}", "0", "NaN"]) + text[at + 1 :]
    return text


def test_replies_are_read_as_python_reads_them(spark):
    """Random replies, some damaged, against Python's reader; only its spelling of values that are not texts differs."""
    rng = random.Random(11)
    replies = [_random_reply(rng) for _ in range(1500)]
    rows = [(i, "volcanoes", r) for i, r in enumerate(replies)]
    frame = plans(spark.createDataFrame(rows, "prompt_id bigint, prompt string, raw_response string"))
    wrong, read = [], 0
    for r in frame.collect():
        expected = _plan_by_hand(replies[r["prompt_id"]])
        found = NEVER if r["planned_by"] == "rules" else r["plan"].asDict(recursive=True)
        read += found is not NEVER
        if found != expected:
            wrong.append((replies[r["prompt_id"]], found, expected))
    assert not wrong, wrong[:3]
    assert 900 < read < 1450


def test_replies_are_read_without_python(replied):
    for frame in (replied, plan_summary(replied), plan_urls(replied), empty_plans(replied)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and plan.count("from_json") < 60


@pytest.fixture(scope="module")
def replied(spark):
    rows = [(i, "volcanoes", r) for i, r in enumerate(REPLIES)]
    return plans(spark.createDataFrame(rows, "prompt_id bigint, prompt string, raw_response string"))


def test_replies(replied):
    got = replied.select("prompt_id", "planned_by", F.size("plan.urls")).orderBy("prompt_id").collect()
    expected = [("rules", 5) if n is None else ("reply", n) for n in REPLIES.values()]
    assert [(r[1], r[2]) for r in got] == expected
    empty = [r[0] for r in empty_plans(replied).orderBy("prompt_id").collect()]
    assert empty == [i for i, n in enumerate(REPLIES.values()) if n == 0]


def test_summary_and_urls_of_replies(replied):
    shown = {r["prompt_id"]: r for r in plan_summary(replied).collect()}
    assert tuple(shown[1])[1:] == ("P", "D", "deep", "7", "a, b", 2)
    assert tuple(shown[8])[1:] == ("N/A", "D", "N/A", "N/A", "", 0)
    assert tuple(shown[5])[1:] == (
        "Data collection for: volcanoes", "mixed", "multi-source", "500",
        "source, type, text, href, extra", 5,
    )
    urls = plan_urls(replied).filter("prompt_id = 0").orderBy("pos").collect()
    assert [tuple(u) for u in urls] == [
        (0, 1, "https://u@h:1/x", "u@h:1", "d", ["p"]), (0, 2, "", "S", "", None),
    ]


def test_catalog(spark):
    assert catalog(spark).count() == 26
    assert len({c for c, _, _ in fixed.CATALOG}) == 10


def test_resolve_fetches(spark):
    log = [
        ("a", 1, 200, None, "A"),
        ("b", 1, 500, None, "error page"), ("b", 2, 200, None, "B"), ("b", 3, 200, None, "late"),
        ("c", 1, 404, None, "gone"), ("c", 2, 200, None, "C"),
        ("d", 1, None, "timeout", None), ("d", 2, None, "timeout", None), ("d", 3, None, "t", None),
        ("e", 3, 503, None, None), ("e", 4, 200, None, "E"),
        ("f", 1, 301, None, ""),
        ("g", 2, 403, None, "no"), ("g", 3, 404, None, None),
    ]
    frame = spark.createDataFrame(log, "url string, attempt int, status int, error string, body string")
    got = sorted(tuple(r) for r in resolve_fetches(frame).collect())
    assert got == [("a", 1, "A"), ("b", 2, "B"), ("f", 1, "")]


def test_planned_pages_are_joined_once(spark, pages):
    stored = pages(("https://a/1", "<h1>one</h1>"), ("https://b/2", "<h1>two</h1>"), ("https://c/3", ""))
    planned = spark.createDataFrame(
        [(1, 1, "https://b/2", "B"), (1, 2, "https://a/1", ""), (2, 1, "https://b/2", "Other"),
         (2, 2, "https://c/3", "C"), (2, 3, "https://none/", "N")],
        "prompt_id bigint, pos bigint, url string, source_name string",
    )
    assert planned_pages(planned, stored).count() == 3
    rows = extract_planned(planned, stored)
    got = rows.select("prompt_id", "page_ord", "source", "text").orderBy("prompt_id", "page_ord")
    assert [tuple(r) for r in got.collect()] == [
        (1, 1, "B", "two"), (1, 2, "a", "one"), (2, 1, "Other", "two"),
    ]


def test_a_url_all_plans_share(spark, pages):
    planned = spark.range(3000).selectExpr(
        "id prompt_id", "1L pos", "if(id % 3 = 0, 'https://a/1', concat('https://b/', id)) url", "'N' source_name"
    )
    assert [r["_salts"] for r in _hot_urls(planned, 30).collect()] == [34]
    assert _hot_urls(planned.filter("prompt_id < 3"), 1).count() == 3
    stored = pages(("https://a/1", "<h1>one</h1><h1>two</h1>"), ("https://b/1", "<h1>bbb</h1>"))
    rows = extract_planned(planned, stored, rows_per_task=30)
    assert rows.count() == 2001 and rows.select("prompt_id", "text").distinct().count() == 2001


def test_a_small_share_of_a_large_plan_is_hot_too(spark, pages):
    """900 of a million plan rows, where a task does 100: nine salts, told apart by the rows' places."""
    planned = spark.range(1_000_000).selectExpr(
        "id prompt_id", "1L pos", "if(id < 900, 'https://a/1', concat('https://b/', id)) url", "'N' source_name"
    )
    assert [r["_salts"] for r in _hot_urls(planned, 100).collect()] == [9]
    rows = extract_planned(planned, pages(("https://a/1", "<h1>one</h1>")), rows_per_task=100)
    assert "_salts" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 900


def _moved(plan):
    """The columns of every node of a plan that moves or sorts rows."""
    name, out = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return _moved(plan.initialPlan())
    if "Exchange" in name or name.startswith("Sort"):
        out.append((name, {a.name() for a in _each(plan.output())}))
    for child in [*_each(plan.children()), *_each(plan.subqueries())]:
        out += _moved(child)
    return out


def _each(items):
    return [items.apply(i) for i in range(items.length())]


@pytest.mark.parametrize("listed", [0, 100_000])
def test_markup_of_planned_pages_stays_where_it_is_read(spark, pages, monkeypatch, listed):
    """Without any automatic broadcast: only the pages asked for leave their task, and none to be extracted."""
    monkeypatch.setattr(page_sources, "MOST_LISTED", listed)
    stored = pages(*[(f"https://a/{i % 1000}", f"<h1>title {i}</h1>") for i in range(3000)])
    planned = spark.range(20).selectExpr("id prompt_id", "1L pos", "concat('https://a/', id * 7) url", "'N' source_name")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for salts in (None, 1):
            rows = extract_planned(planned, stored, rows_per_task=salts)
            moved = _moved(rows._jdf.queryExecution().executedPlan())
            assert len(moved) > 3 and not [m for m in moved if "html" in m[1]]
            assert sorted(r["text"] for r in rows.collect()) == sorted(f"title {2000 + i * 7}" for i in range(20))
        wanted = PlannedPages(planned, stored)
        assert 20 <= wanted.likely().count() <= 25
        moved = _moved(wanted.exact()._jdf.queryExecution().executedPlan())
        assert [m for m in moved if "html" in m[1]]
        assert wanted.exact().count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("listed", [0, 100_000])
def test_equal_page_rows_count_once(spark, pages, monkeypatch, listed):
    """Rows that agree in URL and id are one page; markup that differs gives the least of it; versions may be NULL."""
    monkeypatch.setattr(page_sources, "MOST_LISTED", listed)
    stored = pages(("https://a/1", "<h1>one</h1>"), ("https://b/1", "<h1>two</h1>"))
    more = stored.filter("page_id = 0").withColumn("html", F.lit("<h1>zzz</h1>"))
    planned = spark.createDataFrame(
        [(1, 1, "https://a/1", "A"), (1, 2, "https://b/1", "B")], "prompt_id bigint, pos bigint, url string, source_name string"
    )
    again = stored.union(more).union(stored).withColumn("seen", F.when(F.col("url") == "https://b/1", F.col("page_id")))
    for version in ("page_id", "seen"):
        assert sorted(r["html"] for r in planned_pages(planned, again, version).collect()) == [
            "<h1>one</h1>", "<h1>two</h1>",
        ]
        found = extract_planned(planned, again, version=version).collect()
        assert sorted((r["page_ord"], r["text"]) for r in found) == [(1, "one"), (2, "two")]
    assert extract_planned(planned.limit(0), stored).count() == 0


def test_bloom_filter_lets_every_key_through(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) k", "if(id % 3 = 0, null, id) n")
    blocks = n_blocks(20_000)
    bloom = bloom_filter(keys, ["k", "n"], blocks)
    assert possible(keys, ["k", "n"], bloom, blocks).count() == 20_000
    others = keys.withColumn("k", F.concat("k", F.lit("!")))
    assert possible(others, ["k", "n"], bloom, blocks).count() < 200
    assert possible(keys, ["k"], bloom_filter(keys.limit(0), ["k"], 1), 1).count() == 0
    assert n_blocks(10**12) == MAX_BLOCKS


def test_planned_source_does_not_undo_a_header(spark, pages):
    html = "<table><tr><th>source<tr><td>mine</table>"
    planned = spark.createDataFrame(
        [(1, 1, "https://a/1", "A")], "prompt_id bigint, pos bigint, url string, source_name string"
    )
    rows = extract_planned(planned, pages(("https://a/1", html))).orderBy("pos")
    assert [r["source"] for r in rows.collect()] == ["source", "mine"]
    assert extract(pages(html), ["tables"]).count() == 2


def test_run(spark, pages, tmp_path):
    stored = pages(
        ("https://realpython.github.io/fake-jobs/", "<div class=card-content><h2 class=title>T</h2></div>"
         "<h1>jobs</h1><h1>jobs</h1>"),
        ("https://lobste.rs", "<h1>stories</h1>"),
    )
    asked = prompts(spark, ["find me work", "volcanoes", "read"])
    done = run(asked, stored, str(tmp_path))
    report = {r["prompt_id"]: tuple(r)[1:] for r in done.report().collect()}
    assert report == {
        0: ("success", 3, 2, done.csv_path), 1: ("success", 1, 5, done.csv_path), 2: ("success", 0, 10, ""),
    }
    saved = read_csv(spark, done.csv_path)
    assert saved.columns[:3] == ["prompt_id", "source", "type"]
    assert saved.count() == 3 and read_csv(spark, done.snapshot_path).count() == 3
    assert done.summary()["totals"].first()["total_rows"] == 4
    assert done.sample().count() == 4
    nothing = run(prompts(spark, ["read"]), stored, str(tmp_path), "none.csv", snapshot=False)
    assert nothing.csv_path == ""


def test_run_with_more_headers_than_columns_allowed(spark, pages, tmp_path):
    n = MAX_COLUMNS + 1
    html = "".join(f"<th>h{i}" for i in range(n)), "".join(f"<td>{i}" for i in range(n))
    stored = pages(("https://lobste.rs", f"<table><tr>{html[0]}<tr>{html[1]}</table>"))
    asked = prompts(spark, ["volcanoes"])
    done = run(asked, stored, str(tmp_path), full=True)
    for path in (done.csv_path, done.snapshot_path):
        cells = [json.loads(r["cells"]) for r in read_csv(spark, path).filter("type = 'table_row'").collect()]
        assert {f"h{i}": str(i) for i in range(n)} in cells
    with pytest.raises(ValueError, match="columns"):
        run(asked, stored, str(tmp_path), "wide.csv", json_cells=False)


def test_report_of_an_empty_plan(spark):
    asked = spark.createDataFrame([(1, "x", "{}")], "prompt_id bigint, prompt string, raw_response string")
    rows = spark.createDataFrame([], "prompt_id bigint")
    assert tuple(run_report(plans(asked), rows, "f").first()) == (1, "error", 0, 0, "")


def test_the_latest_version_of_a_page_counts(spark, pages):
    planned = spark.createDataFrame(
        [(1, 1, "https://a/1", "A")], "prompt_id bigint, pos bigint, url string, source_name string"
    )
    stored = pages(("https://a/1", "<h1>new title</h1>"), ("https://a/1", "<h1>old title</h1>"))
    assert [r["text"] for r in extract_planned(planned, stored).collect()] == ["old title"]
    dated = stored.withColumn("fetched", -F.col("page_id"))
    assert [r["text"] for r in extract_planned(planned, dated, version="fetched").collect()] == ["new title"]


def test_half_a_surrogate_pair_in_a_reply(spark):
    reply = '{"data_type": "cut \\ud83d", "urls": [{"url": "https://a/", "source_name": "\\udc00"}]}'
    frame = spark.createDataFrame([(1, "p", reply), (2, "p", "[1]")], "prompt_id bigint, prompt string, raw_response string")
    found = {r["prompt_id"]: r for r in plans(frame).collect()}
    assert found[1]["planned_by"] == "reply" and found[1]["plan"]["data_type"] == "cut ?"
    assert found[2]["planned_by"] == "rules"


def test_pages_have_the_category_of_their_host(spark):
    known = catalog(spark).orderBy("category").first()
    pages = spark.createDataFrame([(1, known["url_template"]), (2, "https://nowhere.example/"), (3, None)], "page_id bigint, url string")
    found = {r["page_id"]: r["category"] for r in page_categories(pages).collect()}
    assert found == {1: known["category"], 2: None, 3: None}


def test_limits_are_arguments(spark):
    attempts = spark.createDataFrame(
        [("u", 4, 200, None, "late")], "url string, attempt int, status int, error string, body string"
    )
    assert resolve_fetches(attempts).count() == 0 and resolve_fetches(attempts, max_attempts=None).count() == 1
    frame = spark.createDataFrame([("a b" * 100,)], "p string")
    lengths = frame.select(F.length(topic(F.col("p"))).alias("cut"), F.length(topic(F.col("p"), None)).alias("whole"))
    assert tuple(lengths.first()) == (50, 300)


def test_fixed_values_are_pinned():
    """The SQL of the plans takes rules, targets and catalogue from the engine: a change must be meant."""
    values = {name: getattr(fixed, name) for name in dir(fixed) if name.isupper()}
    digest = hashlib.sha256(json.dumps(values, sort_keys=True, default=sorted).encode()).hexdigest()
    assert digest == "a9d6649249ce6c06d3cddbc659307c1a179570435311c1150465516e64e444c1"
