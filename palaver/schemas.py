"""Column types of the stored tables and of the raw JSON documents."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_FLAG, _TIME = T.BooleanType(), T.TimestampNTZType()


def _row(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


POSTS = _row(
    id=_TEXT, id_int=_LONG, composite_id=_TEXT, published_at=_TIME, upload_id=_TEXT,
    title=_TEXT, description=_TEXT, tags=T.ArrayType(_TEXT), nsfw=_FLAG, nopreroll=_FLAG,
    secret=_FLAG, partner_content=_FLAG, media_type=_TEXT, stream_uri=_TEXT,
    kudos_total=_LONG, views_total=_LONG, stats_id=_LONG, created_at=_TIME, date=_TIME,
)

COMMENTS = _row(
    comment_id=_LONG, post_id=_LONG, author_id=_LONG, creation_datetime=_TIME, content=_TEXT,
    kudos_count=_INT, approved=_FLAG, reference_id=_LONG, parent_comment_id=_LONG,
    depth=_INT, year=_INT,
)

COMMENTS_RAW = _row(
    comment_id=_LONG, post_id=_LONG, parent_comment_id=_LONG, author_id=_LONG, approved=_FLAG,
    creation_datetime=_TIME, content=_TEXT, kudos_count=_LONG, reference_id=_LONG,
)

AUTHORS = _row(
    id=_LONG, username=_TEXT, active=_FLAG, newbie=_FLAG, banned=_FLAG, premium=_FLAG,
    registered_at=_TIME, first_seen_at=_TIME, last_seen_at=_TIME,
)

AUTHOR_SIGHTINGS = _row(
    author_id=_LONG, username=_TEXT, active=_FLAG, newbie=_FLAG, banned=_FLAG, premium=_FLAG,
    registered_at=_TIME, seen_at=_TIME,
)

LOAD_MARKERS = _row(year=_INT, rows_loaded=_LONG, files=_LONG, loaded_at=_TIME)

AUTHOR_USERNAMES = _row(author_id=_LONG, username=_TEXT, seen_at=_TIME)

_VARIANTS = T.ArrayType(_row(version=_TEXT, uri=_TEXT))

RAW_POST_DAY = _row(
    items=T.ArrayType(_row(
        id=_TEXT, id_int=_LONG, composite_id=_TEXT, published_at=_TEXT, upload_id=_TEXT,
        title=_TEXT, description=_TEXT, tags=_TEXT, nsfw=_FLAG, nopreroll=_FLAG, secret=_FLAG,
        partner_content=_FLAG, media_type=_TEXT,
        media=T.ArrayType(_row(variants=_VARIANTS)),
        stats=_row(kudos_total=_LONG, views_total=_LONG, id=_LONG),
        created_at=_TEXT, date=_TEXT,
    )),
    _corrupt_record=_TEXT,
)

RAW_AUTHORS = _row(
    authors=T.ArrayType(_row(
        id=_LONG, username=_TEXT, active=_FLAG, newbie=_FLAG, banned=_FLAG, premium=_FLAG,
        registered_at=_TEXT,
    )),
)

FEATURES = (
    "lexical_diversity",
    "repeated_ratio",
    "link_ratio",
    "sentiment_polarity",
    "comments_per_day",
    "burstiness_hours",
    "hour_entropy",
)
