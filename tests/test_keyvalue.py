import pytest

from graphloom.operators.bitmap import Bitmap
from graphloom.operators.keyvalue import KeyValueStore


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def kv(spark):
    return KeyValueStore(spark.createDataFrame([(1, "b"), (1, "a"), (3, "c"), (5, "d")], "key long, value string"), duplicates=True)


def test_reads(kv):
    assert rows(kv.get(1)) == [(1, "a")] and rows(kv.get(2)) == []
    assert kv.exists(1, "b") and not kv.exists(1, "c")
    assert rows(kv.seek(2)) == [(3, "c")] and rows(kv.seek(6)) == []
    assert rows(kv.seek_both(1, "aa", nearest=True)) == [(1, "b")] and rows(kv.seek_both(1, "aa")) == []
    assert rows(kv.last()) == [(5, "d")] and rows(kv.scan(False))[0] == (5, "d")
    assert sorted(rows(kv.no_dup())) == [(1, "a"), (3, "c"), (5, "d")]
    assert kv.count().first()[0] == 4


def test_writes(spark, kv):
    new = spark.createDataFrame([(1, "z"), (9, "y")], "key long, value string")
    assert kv.put(new).count().first()[0] == 6
    single = KeyValueStore(kv.no_dup())
    assert sorted(rows(single.put(new).df)) == [(1, "z"), (3, "c"), (5, "d"), (9, "y")]
    added, refused = single.add(new)
    assert added.count().first()[0] == 4 and rows(refused) == [(1, "z")]
    with pytest.raises(ValueError):
        single.put_right(new)
    assert single.put_right(new.where("key = 9")).count().first()[0] == 4
    assert single.delete(new).count().first()[0] == 2


def test_steps(spark, kv):
    assert sorted(rows(kv.steps())) == [(1, "a", None, (1, "b")), (1, "b", (1, "a"), (3, "c")), (3, "c", (1, "b"), (5, "d")), (5, "d", (3, "c"), None)]
    assert sorted(rows(kv.neighbours()), key=str) == [(1, "a", None, "b"), (1, "b", "a", None), (3, "c", None, None), (5, "d", None, None)]
    hot = KeyValueStore(spark.range(5000).selectExpr("7 AS key", "id AS value"), duplicates=True)
    assert all(r["next"] == (r["value"] + 1 if r["value"] < 4999 else None) for r in hot.neighbours().collect())


def test_bitmap(spark):
    b = Bitmap.of(spark.createDataFrame([(3,), (3,), (64,), (-1,), (None,)], "x long"), "x")
    assert rows(b.iterator()) == [(3,), (64,)] and rows(b.reverse_iterator()) == [(64,), (3,)]
    assert tuple(b.ends().first()) == (3, 64, 2)
    assert tuple(Bitmap.of(b.df.where("false"), "bit").ends().first()) == (-1, -1, 0)
    assert b.count(3, 63).first()[0] == 1 and b.get(64) and not b.get(4)
    with pytest.raises(ValueError):
        b.count(5, 3)
    more, new = b.set(spark.createDataFrame([(3,), (4,)], "bit long"))
    assert rows(new) == [(4,)] and more.ends().first()["n"] == 3
    less, old = b.clear(spark.createDataFrame([(3,), (4,)], "bit long"))
    assert rows(old) == [(3,)] and less.ends().first()["n"] == 1
