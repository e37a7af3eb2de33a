import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import crawl, threads
from palaver.plans import loads
from palaver.schemas import POSTS
from palaver.sources import authors, comments, posts, tables
from palaver.sources.snapshots import Store
from palaver.streaming.ingest import ingest_posts


def write(root, name, document):
    target = root / name
    target.parent.mkdir(parents=True, exist_ok=True)
    text = document if isinstance(document, str) else json.dumps(document, indent=2)
    target.write_text(text, encoding="utf-8")


def post(i, **more):
    return {"id": f"p{i}", "id_int": i, **more}


STREAM = {"version": "stream", "uri": "/s"}


def test_posts(spark, tmp_path):
    write(tmp_path, "api_date_2024-01-01.json", {"items": [
        post(1, media_type="VIDEO", media=[{"variants": None}, {"variants": [{"version": "x"}, STREAM]}],
             tags=" red blue ", stats={"kudos_total": 5, "views_total": 6, "id": 7},
             published_at="2024-01-01T10:00:00+02:00", title="first"),
        post(2, media_type="IMAGE", media=[{"variants": [STREAM]}], tags=""),
        post(3, media_type="VIDEO", media=None, tags=None),
        post(4, media_type="VIDEO", media=[]),
        {"id": "", "title": "no id"}, {"title": "absent id"},
    ]})
    write(tmp_path, "api_date_2024-01-02.json", {"items": []})
    write(tmp_path, "api_date_2024-01-03.json", {"items": None})
    write(tmp_path, "api_date_2024-01-04.json", '{"items": [')
    write(tmp_path, "other.json", {"items": [post(9)]})
    days = posts.read_post_days(spark, str(tmp_path))
    rows = {r["id"]: r for r in posts.flatten_posts(days).collect()}
    assert sorted(rows) == ["p1", "p2", "p3", "p4"]
    one = rows["p1"]
    assert one["stream_uri"] == "/s" and one["tags"] == ["red", "blue"]
    assert (one["kudos_total"], one["views_total"], one["stats_id"]) == (5, 6, 7)
    assert one["published_at"] == dt.datetime(2024, 1, 1, 10)
    assert [rows[p]["stream_uri"] for p in ("p2", "p3", "p4")] == [None] * 3
    assert rows["p2"]["tags"] == rows["p3"]["tags"] == []
    assert rows["p3"]["kudos_total"] is None
    errors = posts.post_errors(days).collect()
    assert [tuple(r) for r in errors] == [("api_date_2024-01-04.json", "unreadable")]


def node(i, children=None, **more):
    return {"id": i, "author": (i or 0) * 10, "child_comments": children, **more}


def flat(spark, root, years=None):
    return loads.read_comments(spark, str(root), years)


def errors_below(spark, root, **options):
    opened = comments.open_documents(comments.read_documents(spark, str(root)), **options)
    return sorted(tuple(r) for r in comments.comment_errors(opened).collect())


def test_comment_tree_by_hand(spark, tmp_path):
    leaf = {"id": 3, "author": 30}
    write(tmp_path, "2020/2020_01_01_a.json", {"summary": {"id": 77}, "comments": [
        node(1, [node(2, [leaf], content="two", creation_datetime="2020-01-02T03:04:05")]),
        node(4, None), node(5, [])]})
    write(tmp_path, "2021/2021_01_01_b.json", {"summary": {"id": 78}, "comments": None})
    write(tmp_path, "2021/2021_01_01_c.json", {"summary": {"id": 79}})
    write(tmp_path, "2021/2021_01_01_d.json", {"summary": {}, "comments": [node(8)]})
    write(tmp_path, "2021/2021_01_01_e.json", {"comments": [node(9)]})
    write(tmp_path, "2021/2021_01_01_f.json", "{not json")
    write(tmp_path, "2021/deep/2021_01_01_g.json", {"summary": {"id": 80}, "comments": [node(10)]})
    write(tmp_path, "drafts/2021_01_01_h.json", {"summary": {"id": 81}, "comments": [node(11)]})
    rows = flat(spark, tmp_path).collect()
    assert sorted((r["comment_id"], r["parent_comment_id"], r["depth"]) for r in rows if r["comment_id"] != 1
                  and r["parent_comment_id"]) == [(2, 1, 1), (3, 2, 2)]
    assert sorted(r["comment_id"] for r in rows if r["parent_comment_id"] is None) == [1, 4, 5]
    two = next(r for r in rows if r["comment_id"] == 2)
    assert (two["post_id"], two["year"], two["author_id"], two["content"]) == (77, 2020, 20, "two")
    assert two["creation_datetime"] == dt.datetime(2020, 1, 2, 3, 4, 5)
    assert two["kudos_count"] is None and two["approved"] is None
    assert errors_below(spark, tmp_path) == [
        ("2021_01_01_d.json", "no summary id"), ("2021_01_01_e.json", "no summary id"),
        ("2021_01_01_f.json", "unreadable"), ("2021_01_01_g.json", "not in a year folder"),
        ("2021_01_01_h.json", "not in a year folder")]
    assert flat(spark, tmp_path, years=[2021]).count() == 0
    archive = comments.compact_documents(spark, str(tmp_path), str(tmp_path / "archive.parquet"))
    assert loads.crawl_of(archive).comments.count() == len(rows)


def test_a_bad_field_costs_the_field_at_any_depth(spark, tmp_path):
    def chain(length):
        whole = None
        for i in reversed(range(length)):
            whole = node(i, [whole] if whole else [])
        return whole

    for length, name in ((3, "a"), (70, "b"), (900, "c")):
        top = chain(length)
        at = top
        while at["child_comments"]:
            parent, at = at, at["child_comments"][0]
        at["id"], parent["author"], parent["kudos_count"] = "x", {"name": "n"}, 10**12
        top["child_comments"].append("no object")
        write(tmp_path, f"2020/2020_01_01_{name}.json", deep_json({"summary": {"id": length}, "comments": [top]}))
    rows = flat(spark, tmp_path).collect()
    for length in (3, 70, 900):
        found = sorted((r for r in rows if r["post_id"] == length and (r["author_id"] is not None or r["kudos_count"] or r["depth"] != 1
                                                                       or r["comment_id"] is not None)), key=lambda r: r["depth"])
        assert len([r for r in rows if r["post_id"] == length]) == length + 1  # the word among the replies has no fields
        assert [r["comment_id"] for r in found] == [*range(length - 1), None]
        assert found[-2]["author_id"] is None and found[-2]["kudos_count"] is None
        assert found[-1]["parent_comment_id"] == length - 2 and found[-1]["author_id"] == (length - 1) * 10


def deep_json(document):
    """JSON text of a document that is nested too deeply for the encoder."""
    if not isinstance(document, dict):
        return json.dumps(document)
    top = dict(document)
    parts, closing, (first,) = [], [], top.pop("comments")
    while True:
        children = first["child_comments"] or []
        own = json.dumps({k: v for k, v in first.items() if k != "child_comments"})
        rest = "".join("," + json.dumps(c) for c in children if not isinstance(c, dict))
        parts.append(own[:-1] + ', "child_comments": [')
        closing.append(rest.lstrip(",") + "]}" if not any(isinstance(c, dict) for c in children) else rest + "]}")
        inner = [c for c in children if isinstance(c, dict)]
        if not inner:
            break
        first = inner[0]
    return json.dumps(top)[:-1] + ', "comments": [' + "".join(parts) + "".join(reversed(closing)) + "]}"


def test_documents_deeper_than_the_parser_are_unreadable(spark, tmp_path):
    write(tmp_path, "2020/2020_01_01_a.json", {"summary": {"id": 1}, "comments": [node(1, [node(2, [node(3)])])]})
    assert errors_below(spark, tmp_path, max_levels=4) == [("2020_01_01_a.json", "unreadable")]
    assert errors_below(spark, tmp_path) == []
    assert flat(spark, tmp_path).count() == 3


def test_flatten_undoes_nesting_at_any_depth(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(threads, "STEPS", 1)
    monkeypatch.setattr(comments, "STEPS", 1)
    monkeypatch.setattr(threads, "DEEP_STEP_LEVELS", 3)
    rng = random.Random(4)
    want, nodes, roots = [], {}, []
    for i in range(1, 300):
        parent = rng.choice([None, i - 1, i - 1, i - 1, rng.randrange(max(1, i - 9), i + 1)]) or None
        parent = parent if parent in nodes else None
        nodes[i] = node(i, [])
        (nodes[parent]["child_comments"] if parent else roots).append(nodes[i])
        want.append((i, parent))
    write(tmp_path, "2022/2022_01_01_x.json", {"summary": {"id": 5}, "comments": roots})
    rows = flat(spark, tmp_path)
    assert sorted((r["comment_id"], r["parent_comment_id"]) for r in rows.collect()) == sorted(
        want, key=lambda p: p[0])
    assert rows.agg({"depth": "max"}).first()[0] > 20
    depths = threads.thread_depth(rows).withColumnRenamed("depth", "counted")
    assert depths.join(rows, "comment_id").where("depth <> counted").count() == 0


def test_a_deep_document_is_parsed_once_a_round(spark):
    """The parse stands outside of the loop over the steps, however the optimizer puts expressions together."""
    text = F.concat(F.lit('{"comments": [{"id": 1, "child_comments": [{"id": '), F.col("id"), F.lit("}]}]}"))
    top = F.struct(F.lit(0).alias("depth"), F.lit(None).alias("parent_comment_id"), F.lit("$.comments[0]").alias("at"))
    opened = spark.range(7, 8).repartition(1).select(text.alias("text"), F.array(top).cast(threads._FRONTIER).alias("frontier"))
    walked = opened.withColumn("doc", comments.parsed("text")).select(
        threads.walk(F.col("doc"), F.col("frontier"), 4, 1).alias("walked")).select("walked.found", "walked.frontier")
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json(") < plan.index("aggregate(")
    assert [x["comment_id"] for x in walked.first()["found"]] == [1, 7]


def test_thread_depth_by_hand(spark):
    kind = "comment_id bigint, parent_comment_id bigint"
    links = [(1, None), (2, 1), (3, 2), (4, 1), (5, 999), (6, 5)] + [(i, 1) for i in range(100, 140)]
    got = {r["comment_id"]: tuple(r)[1:] for r in threads.thread_depth(
        spark.createDataFrame(links, kind)).collect()}
    assert len(got) == len(links)
    assert got[1] == (1, 0, 42) and got[2] == (1, 1, 1) and got[3] == (1, 2, 0)
    assert got[5] == (5, 0, 1) and got[6] == (5, 1, 0)  # the parent of 5 is not stored
    with pytest.raises(ValueError):
        threads.thread_depth(spark.createDataFrame([(1, 2), (2, 1)], kind))


def test_authors(spark, tmp_path):
    write(tmp_path, "2020/2020_02_03_a.json", {"authors": [
        {"id": 1, "username": "u", "active": True, "registered_at": "2019-05-06T07:08:09"},
        {"id": 2, "banned": True}], "comments": [node(1)]})
    write(tmp_path, "2020/more/2020_02_04_b.json", {"authors": []})
    write(tmp_path, "2020/more/2020_13_99_c.json", {"authors": [{"id": 3}]})
    write(tmp_path, "2020/undated.json", {"authors": None})
    rows = {r["author_id"]: r for r in authors.read_author_sightings(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1]["seen_at"] == dt.datetime(2020, 2, 3)
    assert rows[1]["registered_at"] == dt.datetime(2019, 5, 6, 7, 8, 9)
    assert rows[2]["banned"] is True and rows[2]["username"] is None
    assert rows[3]["seen_at"] is None
    undated = authors.undated_files(spark, str(tmp_path)).collect()
    assert sorted(r["file"] for r in undated) == ["2020_13_99_c.json", "undated.json"]


def test_crawl_gaps_against_a_listing(spark, tmp_path):
    for name in ("2024/2024_01_01_a_1.json", "2024/2024_01_02_b.json"):
        write(tmp_path, name, {})
    listed = authors.list_files(spark, str(tmp_path)).selectExpr(
        "concat_ws('/', slice(split(path, '/'), -2, 2)) AS file")
    wanted = spark.createDataFrame(
        [("2024-01-01", "a_1"), ("2024-01-01", "a_2"), ("2024-01-02", "b"), ("2024-01-02", None),
         ("2024-01-02", "")], "day string, composite_id string")
    got = {r["day"]: tuple(r)[1:] for r in crawl.crawl_gaps(wanted, listed).collect()}
    assert got == {"2024-01-01": (2, 1, False), "2024-01-02": (1, 0, True)}
    left = crawl.missing_posts(wanted, listed).collect()
    assert [(r["composite_id"], r["request_path"]) for r in left] == [("a_2", "a/2")]


def test_calendar(spark):
    bounds = spark.sql("SELECT DATE '2024-02-27' AS first_day, DATE '2024-03-01' AS last_day")
    days = [str(r["day"]) for r in crawl.crawl_calendar(bounds).collect()]
    assert days == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]


def test_stream_resumes_and_ignores_known_posts(spark, tmp_path):
    root, store, checkpoint = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "cp")
    write(root, "api_date_2024-01-01.json", {"items": [post(1, title="a"), post(2, title="a")]})
    ingest_posts(spark, str(root), store, checkpoint)
    write(root, "api_date_2024-01-02.json", {"items": [post(2, title="b"), post(3, title="b")]})
    ingest_posts(spark, str(root), store, checkpoint)
    ingest_posts(spark, str(root), store, checkpoint)
    rows = store.read("posts", POSTS).collect()
    assert sorted((r["id"], r["title"]) for r in rows) == [("p1", "a"), ("p2", "a"), ("p3", "b")]


def test_a_late_batch_opens_few_folders(spark, tmp_path, monkeypatch):
    """Many small batches: keys are read from a bounded number of folders, and each manifest without a job."""
    from palaver.sources import snapshots
    from palaver.sources.snapshots import Change, Store

    monkeypatch.setattr(snapshots, "LOOSE_FOLDERS", 3)
    root, store, opened = tmp_path / "in", Store(spark, str(tmp_path / "store")), []
    read = Store._read
    monkeypatch.setattr(Store, "_read", lambda self, table, schema, folders: opened.append(len(folders or [])) or read(self, table, schema, folders))
    for day in range(1, 13):  # every file has one new post and two that are known
        write(root, f"api_date_2024-01-{day:02d}.json", {"items": [post(i, title=f"d{day}") for i in (day, day + 1, day + 2)]})
    ingest_posts(spark, str(root), store, str(tmp_path / "cp"), files_per_batch=1)
    assert store.version() == 12 and max(opened) <= 4
    rows = [(int(r["id"][1:]), int(r["title"][1:])) for r in store.read("posts", POSTS).collect()]
    assert sorted(i for i, _ in rows) == list(range(1, 15)) and all(day <= i <= day + 2 for i, day in rows)
    # Keys that were stored together don't outlive the folders they stand for.
    late = Store(spark, store.root)
    late.commit(Change("posts", late.read("posts", POSTS).where("id in ('p1', 'p7')"), replace=True))
    assert sorted(r["id"] for r in store.keys("posts", POSTS, "id").rows.collect()) == ["p1", "p7"]
    again = posts.flatten_posts(posts.read_post_days(spark, str(root)))
    assert tables.append_new(store, "posts", again, POSTS, "id", ["file", "pos"]).count() == 14
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("states", "no job")
    assert store.version() == 14 and len(store.folders()["posts"]) == 2 and len(jobs.getJobIdsForGroup("states")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_file_wins_within_a_batch(spark, tmp_path):
    root, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    for day in ("02", "01"):
        write(root, f"api_date_2024-01-{day}.json", {"items": [post(1, title=day)]})
    batch = posts.flatten_posts(posts.read_post_days(spark, str(root)))
    stored = tables.append_new(store, "posts", batch, POSTS, "id", ["file"])
    assert [(r["id"], r["title"]) for r in stored.collect()] == [("p1", "01")]
    assert tables.append_new(store, "posts", batch, POSTS, "id", ["file"]).count() == 1


def test_a_cycle_beside_a_long_thread_is_found(spark):
    links = [(i, i - 1 if i else None) for i in range(9)] + [(20, 21), (21, 22), (22, 20)]
    with pytest.raises(ValueError):
        threads.thread_depth(spark.createDataFrame(links, "comment_id bigint, parent_comment_id bigint"))


def test_documents_are_nested_a_few_at_a_time():
    import json

    import pyarrow as pa

    from palaver.fixtures import _nest

    rows = lambda post: [{"id": post * 10 + i, "parent_comment_id": post * 10 + i - 1 if i else None, "content": f"t{i}"} for i in (1, 0, 2)]
    batch = pa.RecordBatch.from_pylist([{"post_id": p, "path": f"p{p}", "rows": rows(p), "people": [{"id": 1, "banned": None}]} for p in range(100)])
    found = list(_nest(iter([batch])))
    assert max(b.num_rows for b in found) <= 16 and sum(b.num_rows for b in found) == 100
    last = json.loads(found[-1].to_pylist()[-1]["body"])
    assert last["summary"] == {"id": 99} and last["authors"] == [{"id": 1, "banned": None}]
    top, = last["comments"]
    assert [top["id"], top["child_comments"][0]["child_comments"][0]["id"]] == [990, 992] and "parent_comment_id" not in top
