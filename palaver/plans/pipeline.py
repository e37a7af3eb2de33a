"""The end-to-end analysis: comments in; features, segments, anomalies and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from palaver.functions.formatting import round_numbers
from palaver.operators.forest import anomaly_scores
from palaver.operators.scaling import scaled_features
from palaver.operators.scoring import composite_score, suspect_comments, top_segment
from palaver.operators.segmentation import choose_segments
from palaver.plans.features import author_features, sample_authors, select_comments
from palaver.plans.reports import anomaly_report, segment_report
from palaver.schemas import FEATURES
from palaver.session import stage
from palaver.sources.tables import write_report, write_rows


@dataclass
class Analysis:
    features: DataFrame
    scored: DataFrame
    k_scores: DataFrame
    segments: DataFrame
    anomalies: DataFrame
    top: DataFrame
    suspects: DataFrame


def score_authors(
    features: DataFrame, max_clusters: int = 10, contamination: float = 0.05, seed: int = 42,
    restarts: int = 10, metric: str = "squared",
) -> tuple[DataFrame, DataFrame]:
    """Stored features with segment and anomaly columns, and the table of candidate k."""
    scaled = stage(scaled_features(features, FEATURES), "scaled")
    labelled, k_scores = choose_segments(
        scaled, FEATURES, max_clusters, restarts, seed, metric)
    anomalies = anomaly_scores(scaled, FEATURES, contamination, seed)
    scored = features.join(labelled.select("author_id", "segment"), "author_id").join(
        anomalies, "author_id")
    return stage(scored, "scored"), k_scores


def analyse(
    comments: DataFrame,
    lexicon: DataFrame,
    authors: DataFrame | None = None,
    sample: int | None = None,
    year: int | None = None,
    max_clusters: int = 10,
    contamination: float = 0.05,
    seed: int = 42,
    restarts: int = 10,
    metric: str = "squared",
) -> Analysis:
    """Runs the whole analysis.

    ``sample`` draws that many ``authors``; ``year`` keeps one directory year. The feature
    table is stored before the models read it many times.
    """
    drawn = sample_authors(authors, sample, seed) if sample else None
    chosen = select_comments(comments, drawn, year)
    features = stage(author_features(chosen, lexicon), "features")
    scored, k_scores = score_authors(
        features, max_clusters, contamination, seed, restarts, metric)
    top = top_segment(composite_score(scored))
    return Analysis(
        features=features,
        scored=scored,
        k_scores=k_scores,
        segments=segment_report(scored),
        anomalies=anomaly_report(scored),
        top=top,
        suspects=suspect_comments(chosen, scored, top, seed=seed),
    )


def write_outputs(result: Analysis, root: str) -> None:
    """The feature table as Parquet and the reports as CSV, rounded to three decimals."""
    result.features.write.mode("overwrite").parquet(f"{root}/user_features")
    write_report(round_numbers(result.segments.orderBy("segment")), f"{root}/segment_report")
    write_report(round_numbers(result.anomalies), f"{root}/anomaly_report")
    write_rows(round_numbers(result.scored), f"{root}/user_segments_and_anomalies")
    write_report(result.suspects, f"{root}/most_likely_bots_segment_comments")
