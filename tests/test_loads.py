import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from palaver.plans import loads
from palaver.plans.loads import Crawl
from palaver.schemas import AUTHOR_SIGHTINGS, AUTHORS, COMMENTS, COMMENTS_RAW, LOAD_MARKERS, POSTS
from palaver.sources import authors as author_source, tables
from palaver.sources.snapshots import Change, Store
from test_sources import node, post, write


@pytest.fixture()
def crawl(tmp_path):
    write(tmp_path, "posts/api_date_2024-01-01.json", {"items": [post(1), post(2)]})
    write(tmp_path, "posts/api_date_2024-01-02.json", "[")
    write(tmp_path, "comments/2020/2020_01_01_a.json", {
        "summary": {"id": 1}, "comments": [node(1, [node(2)], kudos_count=3), node(None)],
        "authors": [{"id": 10, "username": "ann", "registered_at": "2015-01-01T00:00:00"}]})
    write(tmp_path, "comments/2021/2021_01_01_b.json", {
        "summary": {"id": 2}, "comments": [node(3), node(2, content="later copy")],
        "authors": [{"id": 10, "username": "anna", "registered_at": "2014-01-01T00:00:00"}]})
    write(tmp_path, "comments/2021/undated.json", {"comments": []})
    write(tmp_path, "comments/2022/2022_01_01_c.json", {
        "summary": {"id": 3}, "comments": [], "authors": [{"id": 11}, {"username": "nobody"}]})
    write(tmp_path, "comments/2020/more/2020_01_01_d.json", '{"summary": {"id": 4}, "comm')
    return tmp_path


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def comments_of(spark, root, years=None):
    return loads.read_crawl(spark, str(root / "comments"), years)


def test_posts_load_once(spark, crawl, store):
    for _ in range(2):
        assert loads.load_posts(store, str(crawl / "posts")).count() == 2


def test_bulk_load_refuses_and_raw_load_ignores_repeats(spark, crawl, store):
    with pytest.raises(ValueError):
        loads.load_comments(store, comments_of(spark, crawl))
    assert store.version() == 0 and store.read("comments", COMMENTS).count() == 0
    assert loads.load_comments(store, comments_of(spark, crawl, [2021])).count() == 2
    with pytest.raises(ValueError):
        loads.load_comments(store, comments_of(spark, crawl, [2021]))
    assert store.read("comments", COMMENTS).where("year = 2021").count() == 2
    raw = loads.reload_comments_raw(store, comments_of(spark, crawl))
    assert raw.columns == COMMENTS_RAW.names
    rows = {r["comment_id"]: r for r in raw.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[2]["parent_comment_id"] == 1 and rows[2]["content"] is None
    assert rows[1]["kudos_count"] == 3
    markers = store.read("load_markers", LOAD_MARKERS).collect()
    assert sorted((r["year"], r["rows_loaded"], r["files"]) for r in markers) == [(2020, 3, 1), (2021, 2, 2), (2022, 0, 1)]
    assert loads.reload_comments_raw(store, comments_of(spark, crawl)).count() == 3


def test_a_load_that_dies_leaves_the_old_state(spark, crawl, store, monkeypatch):
    loads.reload_comments_raw(store, comments_of(spark, crawl, [2020]))
    before = store.version()
    published = Store._publish

    def die(*_):
        raise RuntimeError("killed between write and publish")

    monkeypatch.setattr(Store, "_publish", die)
    with pytest.raises(RuntimeError):
        loads.reload_comments_raw(store, comments_of(spark, crawl))
    with pytest.raises(RuntimeError):
        loads.load_comments(store, comments_of(spark, crawl, [2021]))
    monkeypatch.setattr(Store, "_publish", published)
    # The rows are written, but no reader sees them; the markers still fit the rows.
    other = Store(spark, store.root)
    assert other.version() == before
    assert other.read("comments_raw", COMMENTS_RAW).count() == 2
    assert [r["year"] for r in other.read("load_markers", LOAD_MARKERS).collect()] == [2020]
    assert other.read("comments", COMMENTS).count() == 0
    assert loads.reload_comments_raw(other, comments_of(spark, crawl)).count() == 3
    assert other.read("comments_raw", COMMENTS_RAW, version=before).count() == 2  # an older state can still be read


def test_the_second_of_two_writers_fails(spark, crawl, store, monkeypatch):
    loads.load_posts(store, str(crawl / "posts"))
    late = Store(spark, store.root)
    monkeypatch.setattr(late, "version", lambda: store.version() - 1)
    with pytest.raises(AnalysisException):
        late.commit(Change("posts", spark.createDataFrame([], POSTS), replace=True))
    assert store.read("posts", POSTS).count() == 2


def test_compaction_keeps_the_rows(spark, crawl, store):
    for year in (2020, 2021):
        loads.load_comments(store, Crawl(None, comments_of(spark, crawl, [year]).flat.where("comment_id in (1, 3)")))
    assert len(store.folders()["comments"]) == 2
    rows = sorted(map(tuple, store.read("comments", COMMENTS).collect()), key=str)
    store.compact("comments", COMMENTS, ["year"])
    assert len(store.folders()["comments"]) == 1
    assert sorted(map(tuple, store.read("comments", COMMENTS).collect()), key=str) == rows


def test_authors(spark, crawl, store):
    authors = loads.load_authors(store, str(crawl / "comments/2020"))
    authors = loads.load_authors(store, str(crawl / "comments/2021"))
    assert authors.columns == AUTHORS.names
    (one,) = authors.where("id = 10").collect()
    assert (one["id"], one["username"]) == (10, "anna")
    assert one["registered_at"] == dt.datetime(2015, 1, 1)
    assert (one["first_seen_at"], one["last_seen_at"]) == (dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1))
    seen = spark.createDataFrame(
        [(10, "ann", None, None, None, True, dt.datetime(2013, 1, 1), dt.datetime(2019, 1, 1)),
         (None, "x", None, None, None, None, None, None)], AUTHOR_SIGHTINGS)
    merged, names = loads.merge_sightings(store, seen)
    (one,) = merged.where("id = 10").collect()
    assert (one["username"], one["registered_at"]) == ("ann", dt.datetime(2013, 1, 1))
    assert [tuple(r) for r in names.collect()] == [(10, "ann", dt.datetime(2019, 1, 1))]
    _, again = loads.merge_sightings(store, seen)
    assert again.count() == 1


def test_both_author_scans_agree(spark, crawl):
    root = str(crawl / "comments")
    scans = author_source.read_author_sightings(spark, root), loads.read_crawl(spark, root).sightings
    assert sorted(map(str, scans[0].collect())) == sorted(map(str, scans[1].collect()))


def test_ledger_of_a_crawl(spark, crawl):
    ledger = comments_of(spark, crawl).ledger()
    got = {r["file"]: (r["year"], r["comments"], r["rows_loaded"], r["sightings"], r["without_id"], r["without_name"], r["without_day"])
           for r in ledger.collect()}
    assert got == {
        "2020_01_01_a.json": (2020, "loaded", 3, 1, 0, 0, 0),
        "2021_01_01_b.json": (2021, "loaded", 2, 1, 0, 0, 0),
        "undated.json": (2021, "no summary id", 0, 0, 0, 0, 0),
        "2022_01_01_c.json": (2022, "empty", 0, 2, 1, 1, 0),
        "2020_01_01_d.json": (None, "unreadable", 0, 0, 0, 0, 0),
    }


def test_errors_of_a_crawl(spark, crawl):
    rows = loads.ingest_errors(spark, str(crawl / "posts"), str(crawl / "comments")).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("2020_01_01_d.json", "unreadable"), ("2022_01_01_c.json", "author without id"),
        ("2022_01_01_c.json", "author without name"),
        ("api_date_2024-01-02.json", "unreadable"), ("undated.json", "no day in name"),
        ("undated.json", "no summary id")]


def test_missing_reports_are_skipped(spark, tmp_path):
    (tmp_path / "a.csv").write_text("segment,count\n0,5\n")
    found = tables.read_reports(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")])
    assert list(found) == [str(tmp_path / "a.csv")]
    assert [tuple(r) for r in found[str(tmp_path / "a.csv")].collect()] == [(0, 5)]


def test_only_keys_that_the_batch_has_are_held_against_it(spark, tmp_path, monkeypatch):
    """A table may be far larger than a batch: its keys must not travel with every batch."""
    from palaver.sources import tables
    from palaver.sources.snapshots import Store
    from pyspark.sql import types as T

    schema, held = T.StructType().add("id", "string").add("file", "string"), []
    store, plain = Store(spark, str(tmp_path / "store")), tables.insert_ignore
    rows = spark.range(1000).selectExpr("CAST(id AS string) AS id", "'a' AS file")
    assert tables.append_new(store, "posts", rows, schema, "id", ["file"]).count() == 1000
    monkeypatch.setattr(tables, "insert_ignore", lambda stored, *rest: held.append(stored.count()) or plain(stored, *rest))
    batch = spark.createDataFrame([("7", "b"), ("7", "c"), ("new", "b"), ("new", "a"), (None, "b")], schema)
    found = tables.append_new(store, "posts", batch, schema, "id", ["file"])
    assert held == [1] and found.count() == 1001
    assert [r["file"] for r in found.where("id IN ('7', 'new')").orderBy("id").collect()] == ["a", "a"]
