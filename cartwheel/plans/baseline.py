"""Frequency baseline: own best sellers, filled from the global list, scored on a holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartwheel.operators import candidates as C, evaluate as E, labels as L, prepare as P


def baseline_predictions(history: DataFrame, targets: DataFrame, n: int = 12) -> DataFrame:
    """(customer_id, article_id, rank) with ``n`` articles for every target."""
    own = C.customer_frequent(P.members(history, targets, "customer_id"), n)
    return C.fill_to(own, C.popular_article(history, n), targets, n)


def baseline_map(transactions: DataFrame, start: str, end: str | None = None, n: int = 12) -> DataFrame:
    history, target = P.holdout(transactions, start, end)
    truth = L.truth_pairs(target)
    return E.mean_average_precision(baseline_predictions(history, truth.select("customer_id"), n), truth, n)
