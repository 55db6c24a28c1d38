"""Publication: two writers, stale and changed plans, a crash between data and log."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tarnlake.sources import writers as W


def table(spark, n, plus=0):
    return spark.range(n).select("id", (F.col("id") + plus).cast("string").alias("v"))


def test_a_plan_tells_what_changes(spark, tmp_path):
    root = str(tmp_path / "p")
    first = W.plan(table(spark, 10), root, "id")
    assert (first.base, first.rows, first.added, first.changed, first.removed, first.rate) == (0, 10, 10, 0, 0, 0.0)
    W.publish(table(spark, 10), root, first)
    new = table(spark, 12).where("id <> 3").withColumn("v", F.when(F.col("id") == 4, None).otherwise(F.col("v")))
    second = W.plan(new, root, "id")
    assert (second.base, second.rows, second.added, second.changed, second.removed, second.rate) == (1, 11, 2, 1, 1, 0.2)
    with pytest.raises(ValueError):
        W.publish(new, root, second, most=0.1)
    W.publish(new, root, second, most=0.2)
    assert W.current(spark, root).count() == 11
    assert [e.get("added") for e in W.history(spark, root)] == [10, 2]


def test_a_stale_or_changed_plan_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "p")
    W.publish(table(spark, 5), root)
    planned = W.plan(table(spark, 6), root, "id")
    with pytest.raises(W.Conflict):
        W.publish(table(spark, 6, plus=1), root, planned)
    W.publish(table(spark, 7), root)
    with pytest.raises(W.Conflict):
        W.publish(table(spark, 6), root, planned)
    assert W.current(spark, root).count() == 7 and len(W.history(spark, root)) == 2
    with pytest.raises(ValueError):
        W.plan(table(spark, 3).unionByName(table(spark, 1)), root, "id")


def test_of_two_writers_one_publishes(spark, tmp_path):
    root = str(tmp_path / "p")
    W.publish(table(spark, 2), root)

    def attempt(i):
        try:
            W._commit(spark, root, 1, {"version": f"v{i}"})
            return i
        except W.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(attempt, range(32)) if i is not None]
    assert len(won) == 1
    assert W.history(spark, root)[-1]["version"] == f"v{won[0]}"


def test_a_crash_before_the_log_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    W.publish(table(spark, 4), root)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(W, "_commit", crash)
        with pytest.raises(KeyboardInterrupt):
            W.publish(table(spark, 9), root)
    assert W.current(spark, root).count() == 4
    W.publish(table(spark, 9), root)
    assert W.current(spark, root).count() == 9
    W.rollback(spark, root)
    assert W.current(spark, root).count() == 4 and len(W.history(spark, root)) == 3
    with pytest.raises(ValueError):
        W.current(spark, str(tmp_path / "none"))
