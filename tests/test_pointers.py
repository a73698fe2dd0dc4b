"""Changes of stored tables by several writers."""

import threading

import pytest

from granary.plans.service import Service
from granary.sources import readers


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    at = str(tmp_path / "t")
    assert readers.pointer(spark, at) is None
    readers.swap(spark.range(1), at, "a", 0)
    with pytest.raises(readers.Conflict):
        readers.swap(spark.range(2), at, "b", 0)
    assert readers.current(spark, at).count() == 1 and not (tmp_path / "t" / "v_b").exists()
    readers.swap(spark.range(3), at, "c", 1)
    assert readers.pointer(spark, at)[0] == 2 and readers.current(spark, at).count() == 3
    assert not [x for x in (tmp_path / "t").iterdir() if x.name.startswith("CURRENT")]


def test_a_table_of_the_old_form_is_read_and_changed(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/v_old")
    (tmp_path / "CURRENT").write_text(f"{tmp_path}/v_old")
    assert readers.pointer(spark, str(tmp_path))[0] == 0 and readers.current(spark, str(tmp_path)).count() == 4
    readers.swap(spark.range(5), str(tmp_path), "new", 0)
    assert readers.current(spark, str(tmp_path)).count() == 5


def test_a_change_based_on_an_older_table_is_refused(spark, tmp_path):
    base = spark.createDataFrame([], "pos long, question string")
    one, other = Service(spark, str(tmp_path), base), Service(spark, str(tmp_path), base)
    n = one.create_item({"question": "q"})
    stale = one.table("items")
    other.review_item(n, "approved", "first")
    with pytest.raises(readers.Conflict):
        one.put("items", stale)
    assert other.items(status="approved")[0] == 1


def test_rows_that_are_added_at_once_all_stay(spark, tmp_path):
    s = Service(spark, str(tmp_path), spark.createDataFrame([], "pos long, question string"))
    failed = []

    def record(k):
        try:
            s._record(f"run {k}", "publish", "skipped")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=record, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = s.publish_history().collect()
    assert not failed and sorted(r.publish_id for r in rows) == ["run 0", "run 1", "run 2"] and sorted(r.id for r in rows) == [1, 2, 3]
