"""Reading the given tables."""

from leafmill.plans.replies import plan_summary, plans
from registry import derived


def test_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """A task gets a bounded part of a table's file; small tables still go to all cores."""
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert derived.table(spark, str(tmp_path), "orders").rdd.getNumPartitions() == cores
    monkeypatch.setattr(derived, "TASK_BYTES", 1000)
    frame = derived.table(spark, str(tmp_path), "orders")
    assert frame.rdd.getNumPartitions() > 2 * cores
    assert sorted(r["id"] for r in frame.collect()) == list(range(5000))


def test_every_reply_is_read_whatever_the_role_holds(spark, tmp_path):
    """A message of shape 6 has a reply also with quotes in its role, or without one."""
    roles = ["user", 'a "b" \\ c', "", "é\n", None]
    rows = [(6 + 8 * i, 1, role, "a text") for i, role in enumerate(roles)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    planned = plans(derived.replies(spark, str(tmp_path))).orderBy("prompt_id")
    assert [r["planned_by"] for r in planned.collect()] == ["reply"] * 5
    shown = [tuple(r)[1:] for r in plan_summary(planned).orderBy("prompt_id").collect()]
    types = [f"{role} ?" for role in roles[:4]] + ["N/A"]
    assert shown == [("N/A", t, "N/A", "N/A", "", 0) for t in types]
