"""Seven behaviour features per author.

Null author: the comment is dropped. Null text: empty text that still counts. Null time:
the comment counts, but not for days, gaps and hours.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions.text import fingerprint, has_link
from palaver.functions.time import entropy_of, per_day
from palaver.operators.timeline import burstiness
from palaver.operators.wording import survey, variety, variety_and_totals, word_totals
from palaver.session import stage

_HOUR_BINS = [f"h{hour:02d}" for hour in range(24)]


def _named(comments: DataFrame) -> DataFrame:
    return comments.where("author_id is not null")


def _marked(comments: DataFrame) -> DataFrame:
    return _named(comments).withColumn("mark", fingerprint(F.col("content")))


def _variety(comments: DataFrame) -> DataFrame:
    """Words, distinct words and distinct texts per author; texts stay where they are read."""
    return variety(_marked(comments).select("author_id", "content", "mark"))


def lexical_diversity(comments: DataFrame) -> DataFrame:
    """Distinct words over all words, 0 for an author without words."""
    ratio = F.try_divide(F.col("distinct_words"), F.col("n_words"))
    return _variety(comments).select("author_id", F.coalesce(ratio, F.lit(0.0)).alias("lexical_diversity"))


def repeated_ratio(comments: DataFrame) -> DataFrame:
    """Share of comments whose text the author has posted before."""
    texts = _named(comments).groupBy("author_id", fingerprint(F.col("content")).alias("text")).agg(
        F.count("*").alias("copies"))
    return texts.groupBy("author_id").agg(
        (F.sum(F.col("copies") - 1) / F.sum("copies")).alias("repeated_ratio"))


def link_ratio(comments: DataFrame) -> DataFrame:
    return _named(comments).groupBy("author_id").agg(
        F.avg(has_link(F.col("content")).cast("double")).alias("link_ratio"))


def _word_values(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word").agg(F.avg("polarity").alias("value")).where("value is not null")


def _polarity_sums(totals: DataFrame) -> DataFrame:
    """Sum over an author's comments of the mean polarity of their lexicon words."""
    per_comment = totals.groupBy("author_id", "comment_id").agg(
        F.try_divide(F.sum("total"), F.sum("hits")).alias("polarity"))
    return per_comment.groupBy("author_id").agg(F.sum("polarity").alias("polarity_sum"))


def sentiment_polarity(comments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean comment polarity by a (word, polarity) table of lower-case words.

    A comment's polarity is the mean over its words that the table holds, 0 if it holds
    none. Negation and intensifiers are not modelled.
    """
    sizes = _named(comments).groupBy("author_id").agg(F.count("*").alias("n"))
    totals = word_totals(_named(comments).select("author_id", "comment_id", "content"), _word_values(lexicon))
    return sizes.join(_polarity_sums(totals), "author_id", "left").select(
        "author_id",
        (F.coalesce("polarity_sum", F.lit(0.0)) / F.col("n")).alias("sentiment_polarity"))


def _if_dated(n: Column, n_dated: Column) -> Column:
    return F.when(n_dated > 0, n).otherwise(0)


def comments_per_day(comments: DataFrame) -> DataFrame:
    """Comments over the whole days between first and last, at least one day.

    Comments without a time count; an author without any time has 0.
    """
    ts = F.col("creation_datetime")
    return _named(comments).groupBy("author_id").agg(
        per_day(_if_dated(F.count("*"), F.count(ts)), F.min(ts), F.max(ts)).alias("comments_per_day"))


def hour_histogram(comments: DataFrame) -> DataFrame:
    dated = _named(comments).where("creation_datetime is not null")
    return dated.groupBy("author_id", F.hour("creation_datetime").alias("hour")).agg(
        F.count("*").alias("comments"))


def _hour_counts() -> list[Column]:
    hour = F.hour("creation_datetime")
    return [F.count_if(hour == i).alias(name) for i, name in enumerate(_HOUR_BINS)]


def _hour_entropy() -> Column:
    return entropy_of([F.col(name) for name in _HOUR_BINS]).alias("hour_entropy")


def hour_entropy(comments: DataFrame) -> DataFrame:
    """Base-2 entropy of the posting hours.

    The 24 bins are columns of one aggregate, so a histogram costs one small shuffle and
    no window.
    """
    return _named(comments).groupBy("author_id").agg(*_hour_counts()).select(
        "author_id", _hour_entropy())


def _activity(comments: DataFrame) -> DataFrame:
    """Everything that needs no text, in one pass over the comments."""
    ts = F.col("creation_datetime")
    return _named(comments).groupBy("author_id").agg(
        F.count("*").alias("n"),
        F.count(ts).alias("n_dated"),
        F.min(ts).alias("first_at"),
        F.max(ts).alias("last_at"),
        *_hour_counts(),
    ).select("author_id", "n", "n_dated", "first_at", "last_at", _hour_entropy())


def author_features(comments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All seven features, one row per author.

    Four tables of one row per author are stored and joined, so that what one of them shuffles has left the
    disk before the next begins. Texts are surveyed, then cut into words once for all that is asked of them, and
    none is moved.
    """
    texts = _marked(comments).select("author_id", "comment_id", "content", "mark")
    words, totals = variety_and_totals(texts, _word_values(lexicon), survey(texts))
    joined = (
        stage(_activity(comments), "activity")
        .join(stage(words, "variety"), "author_id")
        .join(stage(_polarity_sums(totals), "polarity"), "author_id", "left")
        .join(stage(burstiness(comments), "burstiness"), "author_id", "left")
    )
    n = F.col("n").cast("double")
    return joined.select(
        "author_id",
        F.coalesce(F.try_divide(F.col("distinct_words"), F.col("n_words")), F.lit(0.0)).alias(
            "lexical_diversity"),
        ((n - F.col("n_texts")) / n).alias("repeated_ratio"),
        (F.col("n_links") / n).alias("link_ratio"),
        (F.coalesce("polarity_sum", F.lit(0.0)) / n).alias("sentiment_polarity"),
        per_day(_if_dated(F.col("n"), F.col("n_dated")), F.col("first_at"), F.col("last_at")).alias(
            "comments_per_day"),
        F.when(F.col("n_dated") < 2, 0.0).otherwise(F.col("burstiness_hours")).alias(
            "burstiness_hours"),
        "hour_entropy",
    )


def corpus_counts(comments: DataFrame) -> DataFrame:
    return comments.agg(
        F.count_distinct("author_id").alias("authors"), F.count("*").alias("comments"))


#: Hexadecimal digits by which a sample's border is narrowed down, and rows that may be sorted.
_DIGITS, _BORDER_ROWS = 4, 100_000


def sample_authors(authors: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` authors in an order that depends on the seed and the id alone.

    The order is that of a hash. Counts of its first digits say where the border lies: what comes
    before is a filter, and only the rows that share the border's digits, BORDER_ROWS at most
    unless one id repeats, are sorted. However large the sample, no task holds it.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    ids = authors.select("id").withColumn("_order", order)
    border, left = "", size
    while True:
        digits = len(border) + _DIGITS
        near = ids.where(F.startswith("_order", F.lit(border))) if border else ids
        counts = sorted(near.groupBy(F.substring("_order", 1, digits).alias("head")).count().collect())
        upto = list(accumulate(n for _, n in counts))
        here = next((pair for pair, so_far in zip(counts, upto) if so_far >= left), None)
        if here is None:
            return ids.select("id")  # the sample has room for all
        left -= sum(n for head, n in counts if head < here[0])
        border = here[0]
        if here[1] <= _BORDER_ROWS or len(border) >= 32:
            break
    within = ids.where(F.substring("_order", 1, len(border)) < border)
    rest = ids.where(F.startswith("_order", F.lit(border))).orderBy("_order", "id").limit(left)
    return within.unionByName(rest).select("id")


def select_comments(
    comments: DataFrame, authors: DataFrame | None = None, year: int | None = None
) -> DataFrame:
    """Comments of the given authors and directory year; each filter only if asked for."""
    chosen = comments if year is None else comments.where(F.col("year") == year)
    if authors is None:
        return chosen
    ids = authors.select(F.col("id").alias("author_id"))
    return chosen.join(ids, "author_id", "left_semi")
