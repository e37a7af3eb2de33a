import datetime as dt

import pytest

from palaver.operators import keys
from palaver.schemas import AUTHOR_SIGHTINGS, AUTHORS, COMMENTS
from palaver.sources import tables
from palaver.sources.snapshots import Change, Store


def day(year, month=1, d=1):
    return dt.datetime(year, month, d)


def authors(spark, *rows):
    return spark.createDataFrame(list(rows), AUTHORS)


OLD = (1, "old", True, True, None, False, day(2010), day(2011), day(2012))
NEW = (1, None, None, False, False, None, day(2009), day(2010), day(2011))


@pytest.mark.parametrize("rules, registered", [
    (keys.KEEP_REGISTRATION, day(2010)), (keys.EARLIEST_REGISTRATION, day(2009))])
def test_upsert_rules(spark, rules, registered):
    only_old = (2, "o", None, None, None, None, None, day(2001), day(2002))
    only_new = (3, "n", None, None, None, True, None, None, day(2003))
    got = {r["id"]: tuple(r) for r in keys.upsert(
        authors(spark, OLD, only_old), authors(spark, NEW, only_new), "id", rules).collect()}
    # A new null wins for profile columns; false or null is null, so the flags become null.
    assert got[1] == (1, None, None, False, None, None, registered, day(2010), day(2012))
    assert got[2] == only_old
    assert got[3] == only_new


def test_upsert_twice_changes_nothing(spark):
    stored, batch = authors(spark, OLD), authors(spark, NEW)
    once = keys.upsert(stored, batch, "id", keys.EARLIEST_REGISTRATION)
    twice = keys.upsert(once, batch, "id", keys.EARLIEST_REGISTRATION)
    assert once.collect() == twice.collect()


def test_canonical_authors(spark):
    seen = spark.createDataFrame([
        (1, "first", True, True, None, False, None, day(2001)),
        (1, "second", False, None, False, True, day(1999), day(2003)),
        (1, None, None, None, None, None, day(2000), day(2004)),
        (2, None, None, None, None, None, None, day(2002)),
    ], AUTHOR_SIGHTINGS)
    got = {r["id"]: tuple(r) for r in keys.canonical_authors(seen).collect()}
    assert got[1] == (1, "second", False, True, False, True, day(2000), day(2001), day(2004))
    assert got[2] == (2, None, None, None, None, None, None, day(2002), day(2002))


def test_usernames(spark):
    seen = spark.createDataFrame([
        (1, "a", None, None, None, None, None, day(2001)),
        (1, "a", None, None, None, None, None, day(2001)),
        (1, "b", None, None, None, None, None, day(2002)),
    ], AUTHOR_SIGHTINGS)
    history = spark.createDataFrame([(1, "a", day(2001))], "author_id bigint, username string, seen_at timestamp_ntz")
    assert [tuple(r) for r in keys.new_usernames(history, seen).collect()] == [(1, "b", day(2002))]


def test_insert_ignore_keeps_what_is_stored(spark):
    kind = "comment_id bigint, content string"
    stored = spark.createDataFrame([(1, "old text")], kind)
    batch = spark.createDataFrame([(1, "other"), (2, "b"), (2, "a"), (None, "no id")], kind)
    fresh = keys.insert_ignore(stored, batch, ["comment_id"], ["content"])
    assert [tuple(r) for r in fresh.collect()] == [(2, "a")]
    full = stored.unionByName(fresh)
    assert keys.insert_ignore(full, batch, ["comment_id"], ["content"]).count() == 0


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    batch = spark.range(50_000).selectExpr("id % 2 AS comment_id", "id AS n")
    fresh = keys.first_per_key(batch, ["comment_id"], ["n"])
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert sorted(tuple(r) for r in fresh.collect()) == [(0, 0), (1, 1)]


def comment(i, year=2020):
    return (i, 1, 1, day(year), "t", 0, True, None, None, 0, year)


def test_bulk_insert_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    tables.bulk_insert_comments(store, "comments", spark.createDataFrame([comment(1), comment(2, 2021)], COMMENTS))
    for bad in ([comment(3), comment(3)], [comment(None)], [comment(2)]):
        with pytest.raises(ValueError):
            tables.bulk_insert_comments(store, "comments", spark.createDataFrame(bad, COMMENTS))
    stored = store.read("comments", COMMENTS)
    assert stored.count() == 2 and store.version() == 1
    markers = tables.load_markers(stored).collect()
    assert sorted((r["year"], r["rows_loaded"]) for r in markers) == [(2020, 1), (2021, 1)]
    assert all(r["loaded_at"] is not None for r in markers)


def test_versions_never_replace(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([comment(1)], COMMENTS)
    first = store.commit(Change("comments", df))
    second = store.commit(Change("comments", df.limit(0), replace=True), Change("other", df))
    assert (first, second) == (1, 2)
    assert store.read("comments", COMMENTS).count() == 0 and store.read("other", COMMENTS).count() == 1
    assert store.read("comments", COMMENTS, version=first).count() == 1
    assert store.read("other", COMMENTS, version=first).count() == 0
