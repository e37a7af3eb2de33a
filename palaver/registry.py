"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver import fixtures as fx
from palaver.functions.formatting import round_numbers
from palaver.operators import crawl, keys, threads, timeline
from palaver.operators.forest import (
    anomaly_flag, anomaly_scores as forest_scores, score_forest)
from palaver.operators.scaling import scaled_features as scale
from palaver.operators.scoring import (
    composite_score as composite, suspect_comments as draw_suspects, top_segment as top)
from palaver.operators.segmentation import (
    assign_segments, choose_segments, silhouette_exact as exact_score, silhouette_squared as squared_score)
from palaver.plans import features as ft, loads, reports
from palaver.plans.pipeline import analyse
from palaver.schemas import AUTHOR_USERNAMES, AUTHORS, COMMENTS, COMMENTS_RAW, FEATURES, LOAD_MARKERS, POSTS
from palaver.session import one_row, stage, work_dir
from palaver.sources import authors as author_source, comments as comment_source
from palaver.sources import posts as post_source, tables
from palaver.sources.snapshots import Store
from palaver.streaming.ingest import ingest_posts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def six(df: DataFrame) -> DataFrame:
    """Floating-point columns to six decimals, as in the check SQL."""
    floats = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[
        F.round(F.col(f"`{c}`"), 6).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


# ---- per-author features ---------------------------------------------------------------


@query
def lexical_diversity(spark, sf_dir):
    return six(ft.lexical_diversity(fx.comments(spark, sf_dir)))


@query
def repeated_ratio(spark, sf_dir):
    return six(ft.repeated_ratio(fx.comments(spark, sf_dir)))


@query
def link_ratio(spark, sf_dir):
    return six(ft.link_ratio(fx.comments(spark, sf_dir)))


@query
def sentiment_polarity(spark, sf_dir):
    return six(ft.sentiment_polarity(fx.comments(spark, sf_dir), fx.lexicon(spark, sf_dir)))


@query
def comments_per_day(spark, sf_dir):
    return six(ft.comments_per_day(fx.comment_facts(spark, sf_dir)))


@query
def burstiness_hours(spark, sf_dir):
    return six(timeline.burstiness(fx.comment_facts(spark, sf_dir)))


@query
def hour_histogram(spark, sf_dir):
    return ft.hour_histogram(fx.comment_facts(spark, sf_dir))


@query
def hour_entropy(spark, sf_dir):
    return six(ft.hour_entropy(fx.comment_facts(spark, sf_dir)))


@query
def author_features(spark, sf_dir):
    return six(ft.author_features(fx.comments(spark, sf_dir), fx.lexicon(spark, sf_dir)))


@query
def features_filtered(spark, sf_dir):
    everyone = fx.comment_facts(spark, sf_dir).select(F.col("author_id").alias("id")).distinct()
    chosen = ft.select_comments(fx.comments(spark, sf_dir), ft.sample_authors(everyone, 100), 2021)
    return six(ft.author_features(chosen, fx.lexicon(spark, sf_dir)))


@query
def sample_authors(spark, sf_dir):
    return ft.sample_authors(fx.authors(spark, sf_dir), 200)


@query
def sample_half(spark, sf_dir):
    """A sample as large as half of all authors."""
    authors = fx.authors(spark, sf_dir)
    return ft.sample_authors(authors, authors.count() // 2)


@query
def corpus_counts(spark, sf_dir):
    return ft.corpus_counts(fx.comment_facts(spark, sf_dir))


@query
def comment_gaps(spark, sf_dir):
    return six(timeline.comment_gaps(fx.comment_facts(spark, sf_dir)))


@query
def duplicate_flags(spark, sf_dir):
    return timeline.duplicate_flags(fx.comments(spark, sf_dir))


@query
def comments_by_year(spark, sf_dir):
    return ft.select_comments(fx.comment_facts(spark, sf_dir), year=2021).select(
        "comment_id", "author_id", "creation_datetime", "year")


@query
def union_years(spark, sf_dir):
    comments = fx.comment_facts(spark, sf_dir).select("comment_id", "author_id", "year")
    years = [comments.where(f"year = {year}") for year in range(2019, 2025)]
    return reduce(DataFrame.unionByName, years)


# ---- authors and keyed loads -----------------------------------------------------------

_CUT = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"


@query
def authors_canonical(spark, sf_dir):
    return fx.authors(spark, sf_dir)


def _upserted(spark, sf_dir, rules):
    sightings = fx.authors_raw(spark, sf_dir)
    stored = keys.canonical_authors(sightings.where(f"seen_at < {_CUT}"))
    batch = keys.canonical_authors(sightings.where(f"seen_at >= {_CUT}"))
    return keys.upsert(stored, batch, "id", rules)


@query
def authors_upsert_coalesce(spark, sf_dir):
    return _upserted(spark, sf_dir, keys.KEEP_REGISTRATION)


@query
def authors_upsert_least(spark, sf_dir):
    return _upserted(spark, sf_dir, keys.EARLIEST_REGISTRATION)


@query
def username_history(spark, sf_dir):
    sightings = fx.authors_raw(spark, sf_dir)
    history = sightings.where(f"seen_at < {_CUT}").select(
        "author_id", "username", "seen_at").distinct()
    return history.unionByName(keys.new_usernames(history, sightings))


@query
def posts_incremental(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    known = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    crawled = [
        documents.select(F.col("doc_id").alias("id"), F.lit(file).alias("file"), text.alias("title"))
        for file, text in (("api_date_2.json", F.col("source")), ("api_date_1.json", F.md5("text")))
    ]
    return keys.insert_ignore(known, crawled[0].unionByName(crawled[1]), ["id"], ["file"])


@query
def comment_key_check(spark, sf_dir):
    comments = fx.comment_facts(spark, sf_dir)
    batch = comments.select("comment_id").unionAll(
        comments.where("not approved").select("comment_id")
    ).unionAll(comments.where("parent_comment_id is null").select("parent_comment_id"))
    return keys.duplicate_keys(batch, "comment_id")


@query
def comments_insert_ignore(spark, sf_dir):
    columns = ["comment_id", "kudos_count", F.md5("content").alias("content_md5")]
    comments = fx.comments(spark, sf_dir)
    stored = comments.where("year <= 2021").select(*columns)
    late = comments.withColumn("kudos_count", F.col("kudos_count") + 100).select(*columns)
    later = comments.withColumn("kudos_count", F.col("kudos_count") + 200).select(*columns)
    fresh = keys.insert_ignore(
        stored, later.unionAll(late), ["comment_id"], ["kudos_count"])
    return stored.unionByName(fresh)


@query
def load_markers(spark, sf_dir):
    return tables.load_markers(fx.comment_facts(spark, sf_dir)).drop("loaded_at")


# ---- raw documents ---------------------------------------------------------------------


def _new_store(spark, name: str) -> Store:
    return Store(spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _plain_posts(posts: DataFrame) -> DataFrame:
    return posts.withColumn("tags", F.array_join("tags", " "))


@query
def posts_flat(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "post_days")
    days = post_source.read_post_days(spark, root)
    return _plain_posts(post_source.flatten_posts(days).drop("file", "pos"))


@query
def stream_ingest(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "post_days")
    store = _new_store(spark, "stream-posts")
    for _ in range(2):  # the second run finds no new files
        ingest_posts(spark, root, store, f"{store.root}/checkpoint", files_per_batch=20)
    return _plain_posts(store.read("posts", POSTS))


@query
def comments_flat(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "comment_documents")
    return loads.read_comments(spark, root)


@query
def author_sightings(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "comment_documents")
    return author_source.read_author_sightings(spark, root)


@query
def deep_threads(spark, sf_dir):
    """Chains of up to 600 replies, in each an author that is no number and at its end an
    id that is none."""
    return _crawled(spark, sf_dir, "deep_documents").comments.select(
        "post_id", "comment_id", "parent_comment_id", "author_id", "depth", "content", "year")


@query
def deep_sightings(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "deep_documents")
    return author_source.read_author_sightings(spark, root).select("author_id", "seen_at")


@query
def crawl_sightings(spark, sf_dir):
    """Sightings from the documents that the comments were taken from."""
    return _crawled(spark, sf_dir, "comment_documents").sightings


def _crawled(spark, sf_dir, name: str) -> loads.Crawl:
    """Documents parsed once, whatever is asked of them later."""
    root = fx.documents_on_disk(spark, sf_dir, name)
    return fx.once(spark, sf_dir, f"{name} crawl", lambda: loads.read_crawl(spark, root))


@query
def load_ledger(spark, sf_dir):
    """What became of every file, nested, damaged and empty ones included."""
    return _crawled(spark, sf_dir, "ledger_documents").ledger().drop("path")


@query
def ledger_years(spark, sf_dir):
    """Markers of all years with files, also of those without a comment."""
    return tables.year_markers(_crawled(spark, sf_dir, "ledger_documents").ledger()).drop("loaded_at")


@query
def ledger_errors(spark, sf_dir):
    return loads.ledger_errors(_crawled(spark, sf_dir, "ledger_documents").ledger())


@query
def comments_of_years(spark, sf_dir):
    root = fx.documents_on_disk(spark, sf_dir, "comment_documents")
    return loads.read_comments(spark, root, [2019, 2022]).select("comment_id", "depth", "year")


def _reloaded(spark, sf_dir) -> Store:
    """A store whose raw comments, markers and ledger were loaded and then reset by a second load."""
    def load() -> Store:
        store = _new_store(spark, "reload")
        for _ in range(2):
            loads.reload_comments_raw(store, _crawled(spark, sf_dir, "comment_documents"))
        return store

    return fx.once(spark, sf_dir, "reloaded", load)


@query
def raw_reload(spark, sf_dir):
    return _reloaded(spark, sf_dir).read("comments_raw", COMMENTS_RAW)


@query
def reload_markers(spark, sf_dir):
    return _reloaded(spark, sf_dir).read("load_markers", LOAD_MARKERS).select("year", "rows_loaded")


@query
def bulk_load(spark, sf_dir):
    """Three commits of some years each, as readers see them."""
    def load() -> Store:
        store = _new_store(spark, "bulk")
        root = fx.documents_on_disk(spark, sf_dir, "comment_documents")
        for years in ([2019, 2020], [2021], [2022, 2023, 2024]):
            loads.load_comments(store, loads.read_crawl(spark, root, years))
        return store

    return fx.once(spark, sf_dir, "bulk", load).read("comments", COMMENTS)


def _merged(spark, sf_dir) -> Store:
    """Authors and names of two batches of sightings, the second upserted into the first."""
    def load() -> Store:
        store, sightings = _new_store(spark, "authors"), fx.authors_raw(spark, sf_dir)
        for part in (f"seen_at < {_CUT}", f"seen_at >= {_CUT}"):
            loads.merge_sightings(store, sightings.where(part))
        return store

    return fx.once(spark, sf_dir, "merged authors", load)


@query
def stored_authors(spark, sf_dir):
    return _merged(spark, sf_dir).read("authors", AUTHORS)


@query
def stored_usernames(spark, sf_dir):
    return _merged(spark, sf_dir).read("author_usernames", AUTHOR_USERNAMES)


def _listed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Posts of which every other has no document, and the files that are really there."""
    root = fx.documents_on_disk(spark, sf_dir, "comment_documents")
    name = F.col("file")
    files = author_source.list_files(spark, root).select(
        F.concat(F.substring(name, 1, 4), F.lit("/"), name).alias("file"))
    talks = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    day = F.date_add(F.lit("2019-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).cast("string")
    posts = talks.select(day.alias("day"), "conv_id", F.explode(F.array(F.lit("c"), F.lit("x"))).alias("kind"))
    return posts.select("day", F.concat("kind", F.col("conv_id").cast("string")).alias("composite_id")), files


@query
def crawl_listing(spark, sf_dir):
    return crawl.crawl_gaps(*_listed(spark, sf_dir))


@query
def missing_posts(spark, sf_dir):
    return crawl.missing_posts(*_listed(spark, sf_dir))


@query
def ingest_errors(spark, sf_dir):
    return comment_source.comment_errors(_crawled(spark, sf_dir, "damaged_documents").documents)


@query
def thread_depth(spark, sf_dir):
    return threads.thread_depth(fx.comment_facts(spark, sf_dir))


@query
def crawl_gaps(spark, sf_dir):
    base = fx.posts_base(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_number")).cast("string")
    posts = base.select(day.alias("day"), "composite_id", "doc_id")
    fetched = posts.join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    files = fetched.select(
        crawl.comment_file_name(F.col("day"), F.col("composite_id")).alias("file"))
    return crawl.crawl_gaps(posts, files)


@query
def crawl_calendar(spark, sf_dir):
    bounds = fx.table(spark, sf_dir, "events").agg(
        F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"))
    return crawl.crawl_calendar(bounds).select(F.col("day").cast("string").alias("day"))


# ---- models and reports ----------------------------------------------------------------


def stored_features(spark, sf_dir):
    return fx.once(spark, sf_dir, "features", lambda: stage(
        ft.author_features(fx.comments(spark, sf_dir), fx.lexicon(spark, sf_dir)), "features"))


def stored_scaled(spark, sf_dir):
    return fx.once(spark, sf_dir, "scaled", lambda: stage(
        scale(stored_features(spark, sf_dir), FEATURES), "scaled"))


def _fixed_labels(df: DataFrame) -> DataFrame:
    """Labels and scores from the author id, for the reports that need no model."""
    value = (F.col("author_id") % 20 - 1).cast("double") / 100
    return df.withColumns({
        "segment": (F.col("author_id") % 3).cast("int"),
        "anomaly_score": anomaly_flag(value),
        "anomaly_score_val": value,
    })


def _labelled(spark, sf_dir):
    return _fixed_labels(stored_features(spark, sf_dir))


@query
def scaled_features(spark, sf_dir):
    return six(scale(stored_features(spark, sf_dir), FEATURES))


@query
def anomaly_flags(spark, sf_dir):
    return _labelled(spark, sf_dir).select("author_id", "anomaly_score")


@query
def segment_report(spark, sf_dir):
    return six(reports.segment_report(_labelled(spark, sf_dir)))


@query
def anomaly_report(spark, sf_dir):
    return six(reports.anomaly_report(_labelled(spark, sf_dir)))


@query
def describe_tied(spark, sf_dir):
    """Columns of which half, or nearly all, of the values are equal."""
    even = F.col("l_orderkey") % 2 == 0
    return six(reports.describe(fx.table(spark, sf_dir, "lineitem").select(
        F.when(even, 0).otherwise(F.col("l_extendedprice")).cast("double").alias("half_tied"),
        F.col("l_linenumber").cast("double").alias("few_values"),
        F.when(F.col("l_linenumber") > 6, F.col("l_quantity")).cast("double").alias("mostly_null"),
        F.col("l_extendedprice").cast("double").alias("price")), ("half_tied", "few_values", "mostly_null", "price")))


@query
def composite_score(spark, sf_dir):
    return six(composite(_labelled(spark, sf_dir)).select("author_id", "composite_score"))


@query
def top_segment(spark, sf_dir):
    return six(top(composite(_labelled(spark, sf_dir))))


@query
def suspect_comments(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    return draw_suspects(fx.comments(spark, sf_dir), labelled, top(composite(labelled)))


@query
def suspect_first_ten(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    return draw_suspects(fx.comments(spark, sf_dir), labelled, top(composite(labelled)), size=10)


@query
def composite_without_columns(spark, sf_dir):
    """Columns that a table lacks count as constant."""
    labelled = _labelled(spark, sf_dir).drop("link_ratio", "hour_entropy")
    return six(composite(labelled).select("author_id", "composite_score"))


@query
def scored_users_rounded(spark, sf_dir):
    return round_numbers(_labelled(spark, sf_dir))


@query
def report_display(spark, sf_dir):
    return reports.report_display(reports.segment_report(_labelled(spark, sf_dir)))


@query
def report_widths(spark, sf_dir):
    return reports.report_widths(reports.segment_report(_labelled(spark, sf_dir)))


@query
def report_roundtrip(spark, sf_dir):
    path = f"{work_dir(spark)}/segment-report-{uuid.uuid4().hex}"
    report = reports.segment_report(_labelled(spark, sf_dir)).orderBy("segment")
    tables.write_report(round_numbers(report), path)
    return tables.read_report(spark, path, reports.SEGMENT_REPORT)


def _score_frame(spark, score: float) -> DataFrame:
    return six(spark.createDataFrame([(score,)], "score double"))


@query
def silhouette_squared(spark, sf_dir):
    labelled = _fixed_labels(stored_scaled(spark, sf_dir))
    return _score_frame(spark, squared_score(labelled, FEATURES))


@query
def silhouette_exact(spark, sf_dir):
    return six(exact_score(_fixed_labels(stored_scaled(spark, sf_dir)), FEATURES))


def _segmented(spark, sf_dir):
    return fx.once(spark, sf_dir, "segmented", lambda: choose_segments(
        stored_scaled(spark, sf_dir), FEATURES))


def _planted(spark, sf_dir):
    """Authors in four groups that are far apart: the choice of k and the labels follow."""
    apart = [(F.col(c) / 100 + 50 * (F.col("author_id") % 4)).alias(c) for c in FEATURES]
    return fx.once(spark, sf_dir, "planted", lambda: choose_segments(
        stored_scaled(spark, sf_dir).select("author_id", *apart), FEATURES, max_clusters=6, restarts=3))


@query
def planted_segments(spark, sf_dir):
    return _planted(spark, sf_dir)[0].select("author_id", "segment")


@query
def planted_k(spark, sf_dir):
    return _planted(spark, sf_dir)[1].limit(1).select("k", "metric")


@query
def assigned_segments(spark, sf_dir):
    """Every author to the nearest mean of the labelled groups."""
    scaled = stored_scaled(spark, sf_dir)
    centres = _fixed_labels(scaled).groupBy("segment").agg(*[F.avg(c).alias(c) for c in FEATURES])
    return assign_segments(scaled, centres, FEATURES)


@query
def fixed_forest_scores(spark, sf_dir):
    return six(score_forest(stored_scaled(spark, sf_dir), FEATURES, fx.FIXED_FOREST).select("author_id", "forest_score"))


@query
def anomaly_facts(spark, sf_dir):
    """What any forest must give: a score for every author, signs that agree, and the share that is
    flagged, from above and, where values tie with the border's, from below."""
    scored = stage(forest_scores(stored_scaled(spark, sf_dir), FEATURES), "scored")
    value, flagged = F.col("anomaly_score_val"), F.count_if(F.col("anomaly_score") == -1)
    border = one_row(scored.where("anomaly_score_val >= 0").agg(F.min("anomaly_score_val").alias("least")))["least"]
    share = F.ceil(0.05 * (F.count("*") - 1))
    return scored.agg(
        F.count_distinct("author_id").alias("authors"),
        F.count_if((value < 0) != (F.col("anomaly_score") == -1)).alias("wrong_signs"),
        F.count_if(value.isNull() | (F.abs(value) > 1)).alias("out_of_range"),
        (flagged <= share).alias("few_flagged"),
        (flagged + F.sum((value == border).cast("int")) >= share).alias("enough_flagged"))


@query
def choose_k(spark, sf_dir):
    return six(_segmented(spark, sf_dir)[1])


@query
def segments(spark, sf_dir):
    return _segmented(spark, sf_dir)[0].select("author_id", "segment")


@query
def anomaly_scores(spark, sf_dir):
    return six(forest_scores(stored_scaled(spark, sf_dir), FEATURES))


@query
def full_analysis(spark, sf_dir):
    """Features, segments and anomalies of every author, end to end."""
    return fx.once(spark, sf_dir, "analysis", lambda: stage(six(analyse(
        fx.comments(spark, sf_dir), fx.lexicon(spark, sf_dir)).scored), "analysis"))


@query
def analysis_features(spark, sf_dir):
    """The features that the whole analysis carries to its result."""
    return full_analysis(spark, sf_dir).select("author_id", *FEATURES)
