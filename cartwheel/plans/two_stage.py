"""Candidates, labels and features for training, validation and inference; model and submission."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from cartwheel.functions.dates import last_day_value
from cartwheel.functions.stage import cut
from cartwheel.operators import candidates as C, evaluate as E, features as X, labels as L, models as M, pairs as B, prepare as P


class Tables(NamedTuple):
    """Prepared inputs, kept as tables: plain facts, customers with ``customer_type``, articles, forecast."""
    transactions: DataFrame
    customers: DataFrame
    articles: DataFrame
    forecast: DataFrame


def prepare(transactions: DataFrame, customers: DataFrame, articles: DataFrame, forecast: DataFrame) -> Tables:
    """Stage tables of the inputs that every week reads again, so that what is behind them is computed once."""
    customers = P.normalise_value(customers, "fashion_news_frequency", "None", "NONE")
    customers = P.customer_segment(customers).drop("segment")
    if "postal_code" in customers.columns:      # as many values as a dimension has rows: a number, numbered over many tasks
        customers = P.label_encode(customers, ["postal_code"], cut(P.label_codes(customers, ["postal_code"], large=True)))
    return Tables(cut(transactions), cut(customers), cut(articles), cut(forecast))


def candidates_for(tables: Tables, history: DataFrame, targets: DataFrame, forecast: DataFrame,
                   ns: dict | None = None, with_partners: bool = True, end: str | None = None) -> DataFrame:
    partners = B.bought_same_day(history) if with_partners else None
    return C.recommend(targets, history, tables.customers, tables.articles, forecast, ns, partners=partners, end=end)


def labelled_frame(tables: Tables, history: DataFrame, target: DataFrame, ratio: float | None = None,
                   text_vectors: DataFrame | None = None, groups: Sequence[str] = X.INDEX_GROUPS,
                   ns: dict | None = None) -> DataFrame:
    """Candidates of the target customers with ``buy`` and all features.

    The labelled pairs are cut through the checkpoint folder: sampling and
    features read them several times.
    """
    forecast = P.forecast_in_period(tables.forecast, target)
    end = last_day_value(history)
    found = candidates_for(tables, history, target.select("customer_id"), forecast, ns, end=end)
    labelled = cut(L.add_labels(found, target))
    if ratio is not None:
        labelled = L.undersample(labelled, ["customer_id", "article_id", C.STRATEGY, C.RANK], ratio)
    return X.add_features(labelled, history, tables.articles, tables.customers, forecast, text_vectors, groups=groups, end=end)


def rolling_training(tables: Tables, splits: Sequence[P.Split], per_week_groups: bool = False, **options) -> DataFrame:
    """Labelled frames of several rolling weeks, stacked."""
    result = None
    for split in splits:
        part = labelled_frame(tables, P.history_of(tables.transactions, split),
                              P.target_of(tables.transactions, split), **options)
        if per_week_groups:
            part = P.iteration_id(part, split.iter)
        result = part if result is None else result.unionByName(part)
    return result


def train_and_validate(train: DataFrame, valid: DataFrame, truth: DataFrame, features: Sequence[str] | None = None,
                       n_seed: int = 1, n: int = 12, **params) -> tuple[list, DataFrame, DataFrame]:
    """(models, out-of-fold predictions, MAP report) of seed-averaged models."""
    features = list(features or P.feature_columns(train))
    train, valid = cut(train), cut(valid)
    models = M.fit_seeds(train, valid, features, n_seed, **params)
    oof = cut(M.score_mean(models, valid, features))
    return models, oof, E.mean_average_precision(E.best_by_score(oof, "pred", n), truth, n)


def recommend_all(tables: Tables, sample: DataFrame, models: list, features: Sequence[str], first_day: str,
                  text_vectors: DataFrame | None = None, groups: Sequence[str] = X.INDEX_GROUPS, n: int = 12) -> DataFrame:
    """Submission for every sample customer in one job."""
    forecast = P.forecast_from(tables.forecast, first_day)
    end = last_day_value(tables.transactions)
    found = cut(candidates_for(tables, tables.transactions, sample.select("customer_id"), forecast, end=end))
    wide = X.add_features(found, tables.transactions, tables.articles, tables.customers, forecast, text_vectors,
                          groups=groups, end=end)
    best = E.best_by_score(M.score_mean(models, wide, features), "pred", n)
    filled = C.fill_to(best.withColumn(C.RANK, F.col("rank") - 1), C.popular_article(tables.transactions, n), sample, n)
    return E.submission(sample, filled, n)
