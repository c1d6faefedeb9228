"""Ensemble: pick weights on the holdout, blend the submissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cartwheel.operators import candidates as C, ensemble as X, evaluate as E


def choose_and_blend(oof: DataFrame, submissions: DataFrame, truth: DataFrame, sample: DataFrame,
                     vectors: Sequence[Mapping[str, float]], rule: str = "max", n: int = 12,
                     fallback: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """(chosen weights, blended submission); lists shorter than ``n`` are filled from the ``fallback`` articles."""
    report = X.evaluate_weights(X.oof_ranks(oof, n), truth, vectors, rule, n)
    chosen = dict(vectors[X.best_weights(report).first()["vector_id"]])
    ranked = X.blend(X.submission_ranks(submissions, n), chosen, rule, n)
    ranked = ranked.select("customer_id", "article_id", F.col("rank"))
    if fallback is not None:
        ranked = C.fill_to(ranked.withColumn(C.RANK, F.col("rank") - 1), fallback, sample.select("customer_id").distinct(), n)
    return chosen, E.submission(sample, ranked, n)
