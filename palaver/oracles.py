"""DuckDB SQL that computes the same results as the registered queries.

Models (KMeans, isolation forest) have none: their numbers depend on random starts.
"""

from __future__ import annotations

from palaver import fixtures as fx
from palaver.schemas import FEATURES

_NAMES = {t: t for t in fx._TABLES}

_VIEWS: dict[str, str] = {
    "comments": fx.COMMENTS_SQL.format(**_NAMES),
    "authors_raw": fx.AUTHORS_RAW_SQL.format(**_NAMES),
    "threads": fx.THREADS_SQL.format(**_NAMES),
    "posts_base": fx.POSTS_SQL.format(**_NAMES),
    "word_counts": r"""
        SELECT word, count(*) AS uses
        FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) w
        WHERE word <> '' GROUP BY word""",
    "lexicon": fx.LEXICON_SQL.format(word_counts="word_counts"),
    "words": r"""
        SELECT author_id, comment_id, word
        FROM (SELECT author_id, comment_id,
                     unnest(regexp_split_to_array(coalesce(content, ''), '\s+')) AS word
              FROM comments WHERE author_id IS NOT NULL) w
        WHERE word <> ''""",
    "gaps": """
        SELECT author_id, comment_id, (epoch_us(creation_datetime) - lag(epoch_us(creation_datetime))
          OVER (PARTITION BY author_id ORDER BY creation_datetime, comment_id)) / 3.6e9 AS gap
        FROM comments WHERE author_id IS NOT NULL AND creation_datetime IS NOT NULL""",
    "histogram": """
        SELECT author_id, CAST(hour(creation_datetime) AS INT) AS hour, count(*) AS comments FROM comments
        WHERE author_id IS NOT NULL AND creation_datetime IS NOT NULL GROUP BY ALL""",
    "basics": """
        SELECT author_id, count(*) AS n,
          (count(*) - count(DISTINCT coalesce(content, ''))) / count(*) AS repeated_ratio,
          avg(CASE WHEN contains(lower(coalesce(content, '')), 'http') THEN 1e0 ELSE 0e0 END)
            AS link_ratio,
          CASE WHEN count(creation_datetime) > 0 THEN count(*) ELSE 0 END / greatest(floor(
            (epoch_us(max(creation_datetime)) - epoch_us(min(creation_datetime))) / 86400e6), 1)
            AS comments_per_day
        FROM comments WHERE author_id IS NOT NULL GROUP BY author_id""",
    "lexical": """
        SELECT author_id, count(DISTINCT word) / count(*) AS lexical_diversity
        FROM words GROUP BY author_id""",
    "sentiment": """
        SELECT author_id, sum(polarity) AS polarity_sum
        FROM (SELECT w.author_id, w.comment_id, avg(l.polarity) AS polarity
              FROM words w JOIN lexicon l ON l.word = lower(w.word) GROUP BY ALL) per_comment
        GROUP BY author_id""",
    "bursts": """
        SELECT author_id,
          CASE WHEN count(gap) = 0 THEN 0 ELSE stddev_samp(gap) END AS burstiness_hours
        FROM gaps GROUP BY author_id""",
    "entropies": """
        SELECT author_id, sum(-share * log2(share)) AS hour_entropy
        FROM (SELECT author_id, comments / sum(comments) OVER (PARTITION BY author_id) AS share
              FROM histogram) shares
        GROUP BY author_id""",
    "features": """
        SELECT b.author_id, coalesce(lexical_diversity, 0) AS lexical_diversity, repeated_ratio,
          link_ratio, coalesce(polarity_sum, 0) / n AS sentiment_polarity, comments_per_day,
          burstiness_hours, hour_entropy
        FROM basics b LEFT JOIN lexical USING (author_id) LEFT JOIN sentiment USING (author_id)
        LEFT JOIN bursts USING (author_id) LEFT JOIN entropies USING (author_id)""",
    "labelled": """
        SELECT *, CAST(author_id % 3 AS INT) AS segment,
          CASE WHEN author_id % 20 - 1 < 0 THEN -1 ELSE 1 END AS anomaly_score,
          CAST(author_id % 20 - 1 AS DOUBLE) / 100 AS anomaly_score_val
        FROM features""",
}

_DEPENDS = {
    "word_counts": [], "lexicon": ["word_counts"], "words": ["comments"], "gaps": ["comments"],
    "histogram": ["comments"], "basics": ["comments"], "lexical": ["words"],
    "sentiment": ["words", "lexicon"], "bursts": ["gaps"], "entropies": ["histogram"],
    "features": ["basics", "lexical", "sentiment", "bursts", "entropies"],
    "labelled": ["features"], "scaled": ["features"], "scaled_labelled": ["scaled"],
    "composite": ["labelled"],
}


def _columns(template: str, names=FEATURES, joiner: str = ", ") -> str:
    return joiner.join(template.format(c=c) for c in names)


_VIEWS["scaled"] = "SELECT author_id, " + _columns(
    "coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / "
    "nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 0) AS {c}") + " FROM features"
_VIEWS["scaled_labelled"] = "SELECT *, author_id % 3 AS segment FROM scaled"
_Z = "coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)"
_VIEWS["composite"] = (
    "SELECT *, -2 * " + _Z.format(c="anomaly_score_val")
    + "".join(f" {sign} {_Z.format(c=c)}" for sign, c in (
        ("+", "repeated_ratio"), ("+", "link_ratio"), ("-", "lexical_diversity"),
        ("+", "comments_per_day"), ("-", "hour_entropy")))
    + " AS composite_score FROM labelled")


def _with(select: str, *views: str, recursive: bool = False, **extra: str) -> str:
    """``select`` behind the views it needs, each after those it reads itself."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    parts = [f"{v} AS ({_VIEWS[v]})" for v in ordered] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


# Adding zero turns a negative zero into a plain one.
_FEATURES_6 = _columns("round({c}, 6) + 0e0 AS {c}")


def _canonical(where: str = "true") -> str:
    def latest(name: str) -> str:
        return (f"arg_max({name}, {{'t': seen_at, 'u': {name}}}) "
                f"FILTER (WHERE {name} IS NOT NULL) AS {name}")

    return f"""
        SELECT author_id AS id, {latest('username')}, {latest('active')}, {latest('newbie')},
          bool_or(banned) AS banned, bool_or(premium) AS premium, {latest('registered_at')},
          min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at
        FROM authors_raw WHERE {where} GROUP BY author_id"""


_CUT = "TIMESTAMP '1998-01-01 00:00:00'"


def _upsert(registered: str) -> str:
    both = {
        "username": "n.username", "active": "n.active", "newbie": "n.newbie",
        "banned": "o.banned OR n.banned", "premium": "o.premium OR n.premium",
        "registered_at": registered,
        "first_seen_at": "least(o.first_seen_at, n.first_seen_at)",
        "last_seen_at": "greatest(o.last_seen_at, n.last_seen_at)",
    }
    columns = ", ".join(
        f"CASE WHEN o.id IS NULL THEN n.{c} WHEN n.id IS NULL THEN o.{c} ELSE {v} END AS {c}"
        for c, v in both.items())
    return _with(
        f"SELECT coalesce(o.id, n.id) AS id, {columns} FROM o FULL JOIN n ON o.id = n.id",
        "authors_raw", o=_canonical(f"seen_at < {_CUT}"), n=_canonical(f"seen_at >= {_CUT}"))


_SEGMENT_REPORT = "SELECT segment, {columns}, count(*) AS count FROM labelled GROUP BY segment"
_FIXED3 = "CASE WHEN {c} IS NULL THEN '' ELSE printf('%.3f', CAST({c} AS DOUBLE)) END AS {c}"
_REPORT_COLUMNS = ("segment", *FEATURES, "count")
_METRICS = (*FEATURES, "anomaly_score_val")


def _describe(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST(count({c}) AS DOUBLE) AS count, "
        f"round(avg({c}), 6) + 0e0 AS mean, round(stddev_samp({c}), 6) + 0e0 AS std, "
        f"round(min({c}), 6) + 0e0 AS min, round(quantile_cont({c}, 0.25), 6) + 0e0 AS \"25%\", "
        f"round(quantile_cont({c}, 0.5), 6) + 0e0 AS \"50%\", "
        f"round(quantile_cont({c}, 0.75), 6) + 0e0 AS \"75%\", round(max({c}), 6) + 0e0 AS max "
        f"FROM {source}" for c in columns)



_POSTS_FLAT = r"""
SELECT id, id_int, composite_id,
  CAST(day AS TIMESTAMP) + INTERVAL '8 hours 30 minutes' AS published_at,
  CAST(NULL AS VARCHAR) AS upload_id, concat('Post ', doc_id) AS title, text AS description,
  CASE WHEN doc_id % 7 <> 0 THEN concat(lang, ' ', source) ELSE '' END AS tags,
  doc_id % 5 = 0 AS nsfw, doc_id % 2 = 0 AS nopreroll, false AS secret,
  CAST(NULL AS BOOLEAN) AS partner_content,
  CASE WHEN doc_id % 3 = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS media_type,
  CASE WHEN doc_id % 3 = 0 THEN concat('/stream/', doc_id) END AS stream_uri,
  CASE WHEN doc_id % 29 <> 0 THEN doc_id % 13 END AS kudos_total,
  CASE WHEN doc_id % 29 <> 0 THEN n_chars END AS views_total,
  CASE WHEN doc_id % 29 <> 0 THEN doc_id END AS stats_id,
  CAST(day AS TIMESTAMP) + INTERVAL '8 hours 30 minutes' AS created_at,
  CAST(day AS TIMESTAMP) AS date
FROM (SELECT *, DATE '2024-01-01' + day_number AS day FROM posts_base) dated
WHERE id <> ''"""

_FILE_OF_POST = ("concat(strftime(DATE '2019-01-01' + CAST(post_id % 365 AS INT), '%Y_%m_%d'), "
                 "'_c', post_id, '.json')")

_SILHOUETTE = """
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6)
  AS score
FROM (SELECT author_id, max(CASE WHEN own THEN size END) AS size,
        max(CASE WHEN own THEN total / nullif(size - 1, 0) END) AS a,
        min(CASE WHEN NOT own THEN total / size END) AS b
      FROM (SELECT p.author_id, p.segment = q.segment AS own, q.segment, count(*) AS size,
              sum({distance}) AS total
            FROM scaled_labelled p CROSS JOIN scaled_labelled q
            GROUP BY p.author_id, p.segment, q.segment) sums
      GROUP BY author_id) per_row"""
_SQUARE = _columns("(p.{c} - q.{c}) * (p.{c} - q.{c})", joiner=" + ")

_DEEP = {
    "positions": " UNION ALL ".join(
        f"SELECT {i} AS chain, {n} AS length, unnest(range({n})) AS pos" for i, n in enumerate(fx.CHAINS)),
    "deep": fx.DEEP_SQL.format(conversations="conversations", positions="positions"),
}


_SIGHTINGS = (
    "SELECT author_id, concat('user', author_id * 10 + post_id % 3) AS username, "
    "author_id % 2 = 0 AS active, post_id % 2 = 0 AS newbie, "
    "CASE WHEN post_id % 4 <> 0 THEN author_id % 9 = 0 END AS banned, false AS premium, "
    "TIMESTAMP '2019-05-06 07:08:09' AS registered_at, "
    "CAST(DATE '2019-01-01' + CAST(post_id % 365 AS INT) AS TIMESTAMP) AS seen_at "
    "FROM (SELECT DISTINCT author_id, post_id FROM threads) seen")

# What a load makes of the seven kinds of documents that take turns.
_LEDGER = {"ledger": """
SELECT concat(CASE WHEN kind = 6 THEN 'undated' ELSE '2020_03_04' END, '_l', conv_id, '.json') AS file,
  CASE kind WHEN 3 THEN 2018 WHEN 4 THEN NULL WHEN 6 THEN NULL ELSE 2020 END AS year,
  CASE kind WHEN 1 THEN 'unreadable' WHEN 2 THEN 'no summary id' WHEN 3 THEN 'empty' WHEN 4 THEN 'unreadable'
    WHEN 6 THEN 'not in a year folder' ELSE 'loaded' END AS comments,
  CASE WHEN kind IN (0, 5) THEN turns ELSE 0 END AS rows_loaded,
  CAST(CASE WHEN kind IN (1, 4) THEN 0 ELSE 1 END AS INT) AS sightings, CAST(0 AS INT) AS without_id,
  CAST(CASE WHEN kind = 5 THEN 1 ELSE 0 END AS INT) AS without_name,
  CAST(CASE WHEN kind = 6 THEN 1 ELSE 0 END AS INT) AS without_day
FROM (SELECT conv_id, conv_id % 7 AS kind, count(*) AS turns FROM conversations GROUP BY conv_id) c"""}


def _tree_sql(tree: dict, node: int = 0) -> str:
    """Path length of a row in a fixed tree."""
    if tree["feature"][node] < 0:
        return f"{tree['path'][node]}e0"
    return (f"CASE WHEN {FEATURES[tree['feature'][node]]} <= {tree['threshold'][node]}e0 "
            f"THEN {_tree_sql(tree, tree['left'][node])} ELSE {_tree_sql(tree, tree['right'][node])} END")


# Mean depth of an unsuccessful search among 8 rows.
_MEAN_PATH = "(2 * (ln(7e0) + 0.5772156649015329) - 14e0 / 8)"

ORACLES: dict[str, str] = {
    "lexical_diversity": _with(
        "SELECT b.author_id, round(coalesce(lexical_diversity, 0), 6) AS lexical_diversity "
        "FROM basics b LEFT JOIN lexical USING (author_id)", "basics", "lexical"),
    "repeated_ratio": _with(
        "SELECT author_id, round(repeated_ratio, 6) AS repeated_ratio FROM basics", "basics"),
    "link_ratio": _with("SELECT author_id, round(link_ratio, 6) AS link_ratio FROM basics", "basics"),
    "sentiment_polarity": _with(
        "SELECT b.author_id, round(coalesce(polarity_sum, 0) / n, 6) + 0e0 AS sentiment_polarity "
        "FROM basics b LEFT JOIN sentiment USING (author_id)", "basics", "sentiment"),
    "comments_per_day": _with(
        "SELECT author_id, round(comments_per_day, 6) AS comments_per_day FROM basics", "basics"),
    "burstiness_hours": _with(
        "SELECT author_id, round(burstiness_hours, 6) AS burstiness_hours FROM bursts", "bursts"),
    "hour_histogram": _with("SELECT * FROM histogram", "histogram"),
    "hour_entropy": _with(
        "SELECT author_id, round(hour_entropy, 6) + 0e0 AS hour_entropy FROM entropies", "entropies"),
    "author_features": _with(f"SELECT author_id, {_FEATURES_6} FROM features", "features"),
    "features_filtered": _with(
        f"SELECT author_id, {_FEATURES_6} FROM features", "features"
    ).replace(
        f"comments AS ({_VIEWS['comments']})",
        f"all_comments AS ({_VIEWS['comments']}), "
        "chosen AS (SELECT author_id FROM (SELECT DISTINCT author_id FROM all_comments) ids "
        "ORDER BY md5(concat('42:', author_id)), author_id LIMIT 100), "
        "comments AS (SELECT * FROM all_comments WHERE year = 2021 "
        "AND author_id IN (SELECT author_id FROM chosen))"),
    "sample_authors": _with(
        "SELECT id FROM (SELECT DISTINCT author_id AS id FROM authors_raw) ids "
        "ORDER BY md5(concat('42:', id)), id LIMIT 200", "authors_raw"),
    "sample_half": _with(
        "SELECT id FROM (SELECT DISTINCT author_id AS id FROM authors_raw) ids "
        "ORDER BY md5(concat('42:', id)), id LIMIT (SELECT count(DISTINCT author_id) // 2 FROM authors_raw)", "authors_raw"),
    "corpus_counts": _with(
        "SELECT count(DISTINCT author_id) AS authors, count(*) AS comments FROM comments", "comments"),
    "comment_gaps": _with(
        "SELECT author_id, comment_id, round(gap, 6) AS gap_hours FROM gaps", "gaps"),
    "duplicate_flags": _with(
        "SELECT author_id, comment_id, row_number() OVER (PARTITION BY author_id, "
        "coalesce(content, '') ORDER BY creation_datetime, comment_id) > 1 AS is_repeat "
        "FROM comments WHERE author_id IS NOT NULL", "comments"),
    "comments_by_year": _with(
        "SELECT comment_id, author_id, creation_datetime, year FROM comments WHERE year = 2021",
        "comments"),
    "union_years": _with(
        " UNION ALL ".join(f"SELECT comment_id, author_id, year FROM comments WHERE year = {year}"
                           for year in range(2019, 2025)), "comments"),
    "authors_canonical": _with(_canonical(), "authors_raw"),
    "authors_upsert_coalesce": _upsert("coalesce(o.registered_at, n.registered_at)"),
    "authors_upsert_least": _upsert("least(o.registered_at, n.registered_at)"),
    "username_history": _with(
        "SELECT DISTINCT author_id, username, seen_at FROM authors_raw", "authors_raw"),
    "posts_incremental": (
        "SELECT doc_id AS id, 'api_date_1.json' AS file, md5(text) AS title FROM documents "
        "WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "comment_key_check": _with(
        "SELECT comment_id, count(*) AS copies FROM batch GROUP BY comment_id "
        "HAVING comment_id IS NULL OR count(*) > 1", "comments",
        batch="SELECT comment_id FROM comments UNION ALL "
        "SELECT comment_id FROM comments WHERE NOT approved UNION ALL "
        "SELECT parent_comment_id FROM comments WHERE parent_comment_id IS NULL"),
    "comments_insert_ignore": _with(
        "SELECT comment_id, CASE WHEN year <= 2021 THEN kudos_count ELSE kudos_count + 100 END "
        "AS kudos_count, md5(content) AS content_md5 FROM comments", "comments"),
    "load_markers": _with(
        "SELECT year, count(*) AS rows_loaded FROM comments GROUP BY year", "comments"),
    "posts_flat": _with(_POSTS_FLAT, "posts_base"),
    "stream_ingest": _with(_POSTS_FLAT, "posts_base"),
    "comments_flat": _with("SELECT * FROM threads", "threads"),
    "author_sightings": _with(_SIGHTINGS, "threads"),
    "deep_threads": _with(
        "SELECT post_id, CASE WHEN NOT ends THEN comment_id END AS comment_id, parent_comment_id, author_id, "
        "CAST(depth AS INT) AS depth, content, year FROM deep",
        **_DEEP),
    "deep_sightings": _with(
        "SELECT DISTINCT post_id AS author_id, TIMESTAMP '2019-01-01 00:00:00' AS seen_at FROM deep", **_DEEP),
    "comments_of_years": _with(
        "SELECT comment_id, depth, year FROM threads WHERE year IN (2019, 2022)", "threads"),
    "crawl_sightings": _with(_SIGHTINGS, "threads"),
    "bulk_load": _with("SELECT * FROM threads", "threads"),
    "stored_authors": _upsert("least(o.registered_at, n.registered_at)"),
    "stored_usernames": _with("SELECT DISTINCT author_id, username, seen_at FROM authors_raw", "authors_raw"),
    "load_ledger": _with("SELECT * FROM ledger", **_LEDGER),
    "ledger_years": _with(
        "SELECT year, CAST(sum(rows_loaded) AS BIGINT) AS rows_loaded, count(*) AS files FROM ledger "
        "WHERE year IS NOT NULL GROUP BY year", **_LEDGER),
    "ledger_errors": _with(
        "SELECT file, comments AS reason FROM ledger WHERE comments NOT IN ('loaded', 'empty') UNION ALL "
        "SELECT file, 'author without name' FROM ledger WHERE without_name > 0 UNION ALL "
        "SELECT file, 'no day in name' FROM ledger WHERE without_day > 0", **_LEDGER),
    "raw_reload": _with(
        "SELECT comment_id, post_id, parent_comment_id, author_id, approved, creation_datetime, content, "
        "CAST(kudos_count AS BIGINT) AS kudos_count, reference_id FROM threads", "threads"),
    "reload_markers": _with("SELECT year, count(*) AS rows_loaded FROM threads GROUP BY year", "threads"),
    "crawl_listing": (
        "SELECT CAST(DATE '2019-01-01' + CAST(conv_id % 365 AS INT) AS VARCHAR) AS day, "
        "2 * count(*) AS posts, count(*) AS missing, false AS complete "
        "FROM (SELECT DISTINCT conv_id FROM conversations) c GROUP BY conv_id % 365"),
    "missing_posts": (
        "SELECT CAST(day AS VARCHAR) AS day, concat('x', conv_id) AS composite_id, "
        "concat('2019/', strftime(day, '%Y_%m_%d'), '_x', conv_id, '.json') AS file, "
        "concat('x', conv_id) AS request_path FROM (SELECT DISTINCT conv_id, "
        "DATE '2019-01-01' + CAST(conv_id % 365 AS INT) AS day FROM conversations) c"),
    "ingest_errors": _with(
        f"SELECT {_FILE_OF_POST} AS file, CASE WHEN post_id % 9 = 0 THEN 'unreadable' "
        "ELSE 'no summary id' END AS reason FROM (SELECT DISTINCT post_id FROM threads) posts "
        "WHERE post_id % 9 = 0 OR post_id % 10 = 0", "threads"),
    "thread_depth": _with(
        "SELECT t.comment_id, root_id, depth, coalesce(replies, 0) AS replies FROM t "
        "LEFT JOIN r ON r.parent_comment_id = t.comment_id", "comments", recursive=True,
        t="SELECT comment_id, comment_id AS root_id, CAST(0 AS BIGINT) AS depth FROM comments "
        "WHERE parent_comment_id IS NULL UNION ALL "
        "SELECT c.comment_id, t.root_id, t.depth + 1 FROM t "
        "JOIN comments c ON c.parent_comment_id = t.comment_id",
        r="SELECT parent_comment_id, count(*) AS replies FROM comments GROUP BY parent_comment_id"),
    "crawl_gaps": _with(
        "SELECT CAST(DATE '2024-01-01' + day_number AS VARCHAR) AS day, "
        "count(*) FILTER (WHERE composite_id <> '') AS posts, "
        "count(*) FILTER (WHERE composite_id <> '' AND l.doc_id IS NULL) AS missing, "
        "count(*) FILTER (WHERE composite_id <> '' AND l.doc_id IS NULL) = 0 AS complete "
        "FROM posts_base p LEFT JOIN labels l ON l.doc_id = p.doc_id GROUP BY day_number",
        "posts_base"),
    "crawl_calendar": (
        "SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series("
        "(SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) FROM events), "
        "(SELECT CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) FROM events), INTERVAL 1 DAY)) AS day) d"),
    "scaled_features": _with(f"SELECT author_id, {_FEATURES_6} FROM scaled", "scaled"),
    "anomaly_flags": _with("SELECT author_id, anomaly_score FROM labelled", "labelled"),
    "segment_report": _with(
        _SEGMENT_REPORT.format(columns=_columns("round(avg({c}), 6) + 0e0 AS {c}")), "labelled"),
    "anomaly_report": _with(_describe(_METRICS, "labelled WHERE anomaly_score = -1"), "labelled"),
    "describe_tied": _with(
        _describe(("half_tied", "few_values", "mostly_null", "price"), "tied"),
        tied="SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0e0 ELSE CAST(l_extendedprice AS DOUBLE) END AS half_tied, "
        "CAST(l_linenumber AS DOUBLE) AS few_values, CAST(l_extendedprice AS DOUBLE) AS price, "
        "CASE WHEN l_linenumber > 6 THEN CAST(l_quantity AS DOUBLE) END AS mostly_null FROM lineitem"),
    "composite_score": _with(
        "SELECT author_id, round(composite_score, 6) + 0e0 AS composite_score FROM composite", "composite"),
    "top_segment": _with(
        "SELECT segment, round(avg(composite_score), 6) + 0e0 AS composite_score FROM composite "
        "GROUP BY segment ORDER BY avg(composite_score) DESC, segment LIMIT 1", "composite"),
    "suspect_comments": _with(
        "SELECT author_id AS user_id, content AS comment FROM comments WHERE author_id IN "
        "(SELECT author_id FROM labelled WHERE segment = (SELECT segment FROM composite "
        "GROUP BY segment ORDER BY avg(composite_score) DESC, segment LIMIT 1)) "
        "ORDER BY md5(concat('42:', comment_id)), comment_id LIMIT 100", "composite"),
    "scored_users_rounded": _with(
        "SELECT author_id, " + _columns("round_even({c}, 3) + 0e0 AS {c}") + ", segment, anomaly_score, "
        "round_even(anomaly_score_val, 3) + 0e0 AS anomaly_score_val FROM labelled", "labelled"),
    "report_display": _with(
        f"SELECT {_columns(_FIXED3, _REPORT_COLUMNS)} FROM report", "labelled",
        report=_SEGMENT_REPORT.format(columns=_columns("avg({c}) AS {c}"))),
    "report_widths": _with(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(greatest(max(length({c})), {len(c)}) AS INT) AS width "
            "FROM shown" for c in _REPORT_COLUMNS), "labelled",
        report=_SEGMENT_REPORT.format(columns=_columns("avg({c}) AS {c}")),
        shown=f"SELECT {_columns(_FIXED3, _REPORT_COLUMNS)} FROM report"),
    "report_roundtrip": _with(
        _SEGMENT_REPORT.format(columns=_columns("round_even(avg({c}), 3) + 0e0 AS {c}")), "labelled"),
    "silhouette_squared": _with(_SILHOUETTE.format(distance=_SQUARE), "scaled_labelled"),
    "silhouette_exact": _with(_SILHOUETTE.format(distance=f"sqrt({_SQUARE})"), "scaled_labelled"),
    "suspect_first_ten": _with(
        "SELECT author_id AS user_id, content AS comment FROM comments WHERE author_id IN "
        "(SELECT author_id FROM labelled WHERE segment = (SELECT segment FROM composite "
        "GROUP BY segment ORDER BY avg(composite_score) DESC, segment LIMIT 1)) "
        "ORDER BY md5(concat('42:', comment_id)), comment_id LIMIT 10", "composite"),
    "composite_without_columns": _with(
        "SELECT author_id, round(-2 * " + _Z.format(c="anomaly_score_val") + " + "
        + _Z.format(c="repeated_ratio") + " - " + _Z.format(c="lexical_diversity") + " + "
        + _Z.format(c="comments_per_day") + ", 6) + 0e0 AS composite_score FROM labelled", "labelled"),
    "planted_segments": _with(
        "SELECT author_id, CAST(author_id % 4 AS INT) AS segment FROM features", "features"),
    "planted_k": "SELECT CAST(4 AS INT) AS k, 'squared' AS metric",
    "assigned_segments": _with(
        "SELECT author_id, segment FROM near QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY d, segment) = 1",
        "scaled_labelled",
        centres=f"SELECT CAST(segment AS INT) AS segment, {_columns('avg({c}) AS {c}')} FROM scaled_labelled GROUP BY ALL",
        near=f"SELECT p.author_id, q.segment, {_SQUARE} AS d FROM scaled_labelled p CROSS JOIN centres q"),
    "fixed_forest_scores": _with(
        "SELECT author_id, round(-power(2, -(" + " + ".join(_tree_sql(t) for t in fx.FIXED_FOREST)
        + f") / (2 * {_MEAN_PATH})), 6) AS forest_score FROM scaled", "scaled"),
    "anomaly_facts": _with(
        "SELECT count(*) AS authors, CAST(0 AS BIGINT) AS wrong_signs, CAST(0 AS BIGINT) AS out_of_range, "
        "true AS few_flagged, true AS enough_flagged FROM basics", "basics"),
    "analysis_features": _with(f"SELECT author_id, {_FEATURES_6} FROM features", "features"),
}
