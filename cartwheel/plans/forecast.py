"""First-week sales of new articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwheel.operators import evaluate as E, features as X, labels as L, models as M, prepare as P


def training_articles(transactions: DataFrame, articles: DataFrame, first_after: str,
                      text_vectors: DataFrame | None = None, folds: int = 5) -> DataFrame:
    """Known articles with their first-week sales, attributes and fold."""
    frame = X.first_week_sales(transactions, first_after).join(X.article_attributes(articles), "article_id", "left")
    if text_vectors is not None:
        frame = frame.join(text_vectors, "article_id", "left")
    return L.assign_folds(frame, "article_id", folds)


def unseen_articles(transactions: DataFrame, articles: DataFrame, launch_day: str,
                    text_vectors: DataFrame | None = None) -> DataFrame:
    """Articles that were never sold, dated at the launch day."""
    frame = (P.non_members(X.article_attributes(articles), transactions, "article_id")
             .withColumn("1st_week_sales_dat", F.lit(launch_day).cast("date")))
    return frame if text_vectors is None else frame.join(text_vectors, "article_id", "left")


def forecast_first_week(transactions: DataFrame, articles: DataFrame, first_after: str, launch_day: str,
                        features: Sequence[str] | None = None, text_vectors: DataFrame | None = None,
                        folds: int = 5, loss: str = "absolute", **params) -> tuple[DataFrame, DataFrame]:
    """(forecast table, regression report on the out-of-fold part)."""
    train = training_articles(transactions, articles, first_after, text_vectors, folds)
    unseen = unseen_articles(transactions, articles, launch_day, text_vectors)
    drop = ("article_id", "1st_week_sales", "1st_week_sales_dat", "fold")
    features = list(features or P.feature_columns(train, drop))
    predicted = M.forecast_sales(train, unseen, features, folds=folds, loss=loss, **params)
    judged = predicted.filter(F.col("fold").isNotNull()).join(train.select("article_id", "1st_week_sales"), "article_id")
    report = E.regression_report(judged, "1st_week_sales", "1st_week_sales_pred")
    return predicted.select("article_id", "1st_week_sales_dat", "1st_week_sales_pred"), report
