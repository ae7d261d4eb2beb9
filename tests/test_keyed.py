import datetime as dt
import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from courtside.sources import keyed as K
from tests.conftest import rows

SCHEMA = "id long, part string, v string"
T0 = dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="courtside-keyed-") + "/t"


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_row_delta(spark):
    old = frame(spark, (1, "a", "x"), (2, "a", None), (3, "a", "z"), (None, "b", "n"), (4, "a", "same"), (5, None, "q"))
    new = frame(spark, (1, "a", "X"), (2, "a", "y"), (None, "b", "m"), (4, "a", "same"), (5, None, "q"), (6, "a", None))
    assert rows(K.row_delta(old, new, ["id", "part"])) == sorted(
        [("change", 1, "a", "X"), ("change", 2, "a", "y"), ("change", None, "b", "m"), ("delete", 3, "a", "z"), ("insert", 6, "a", None)], key=repr)
    assert K.row_delta(old, old, ["id", "part"]).count() == 0
    # a value that moves from one column to the next is a change
    moved = K.row_delta(spark.createDataFrame([(1, None, "x")], SCHEMA), spark.createDataFrame([(1, "x", None)], SCHEMA), ["id"])
    assert rows(moved) == [("change", 1, "x", None)]


def test_versions_changes_and_retention(spark, path):
    def refresh(hours, *data):
        return rows(K.refresh_keyed(spark, frame(spark, *data), path, ["id"], keep=3, now=at(hours)))

    assert refresh(0, (1, "a", "x"), (2, "a", "y")) == [(1, "a", "x"), (2, "a", "y")]
    assert refresh(7, (9, "z", "z")) == [(1, "a", "x"), (2, "a", "y")]  # fresh: not read again
    assert refresh(9, (1, "a", "changed"), (3, "a", "new")) == [(1, "a", "changed"), (3, "a", "new")]
    assert rows(K.changes_since(spark, path, 1)) == sorted([(2, "change", 1, "a", "changed"), (2, "delete", 2, "a", "y"), (2, "insert", 3, "a", "new")], key=repr)
    assert K.changes_since(spark, path, 2).count() == 0
    for i in range(3, 6):
        refresh(10 * i, (i, "a", "x"))
    assert [c.version for c in K.commits(spark, path)] == [3, 4, 5]
    assert sorted(os.listdir(f"{path}/data")) == sorted(c.data for c in K.commits(spark, path))
    assert rows(K.read_version(spark, path, 4)) == [(4, "a", "x")]
    with pytest.raises(ValueError):
        K.changes_since(spark, path, 1)


def test_one_of_two_writers_wins(spark, path):
    K.refresh_keyed(spark, frame(spark, (1, "a", "x"), (2, "a", "y")), path, ["id"], now=at(0))
    gate, got = threading.Barrier(2), {}

    def writer(name):
        source = frame(spark, (1, "a", name), (2, "a", "y"))

        def read():
            gate.wait()  # both have seen that version 1 is stale
            return source
        got[name] = rows(K.refresh_keyed(spark, read, path, ["id"], now=at(9)))

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("first", "second")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got["first"] == got["second"] and got["first"][0][2] in got
    assert [c.version for c in K.commits(spark, path)] == [1, 2] and len(os.listdir(f"{path}/data")) == 2
    assert rows(K.changes_since(spark, path, 1)) == [(2, "change", 1, "a", got["first"][0][2])]


def test_a_commit_is_made_once(spark, path):
    assert K._create(spark, f"{path}/commits/1.json", "{}") and not K._create(spark, f"{path}/commits/1.json", "other")
    with open(f"{path}/commits/1.json") as f:
        assert f.read() == "{}"


def test_repeated_keys_and_empty_sources(spark, path):
    with pytest.raises(ValueError):
        K.refresh_keyed(spark, frame(spark, (1, "a", "x"), (1, "a", "y")), path, ["id"], now=at(0))
    assert K.commits(spark, path) == []
    assert K.refresh_keyed(spark, frame(spark, (1, "a", "x")).limit(0), path, ["id"], now=at(0)).count() == 0
    assert rows(K.refresh_keyed(spark, frame(spark, (1, "a", "x")), path, ["id"], now=at(9))) == [(1, "a", "x")]
    assert rows(K.refresh_keyed(spark, frame(spark).where(F.lit(False)), path, ["id"], now=at(18))) == []
    assert [r.change for r in K.changes_since(spark, path, 0).orderBy("version").collect()] == ["insert", "delete"]
