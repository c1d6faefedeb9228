"""Boosted-tree models: training, averaging, scoring, importance, persistence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cartwheel.functions.stage import cut
from cartwheel.operators import boosting as B
from cartwheel.operators.boosting import Booster
from cartwheel.operators.factors import factor_candidates  # noqa: F401  (a first-stage model)
from cartwheel.operators.prepare import feature_columns, warm_cold

MISSING = -1.0      # counts, day differences, prices and shares are never negative


def split_types(frame: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, category) feature names."""
    types = {f.name: f.dataType for f in frame.schema.fields}
    category = [c for c in features if isinstance(types[c], T.StringType)]
    return [c for c in features if c not in category], category


def assembler(frame: DataFrame, features: Sequence[str]) -> tuple[list, int]:
    """Pipeline stages from raw columns to one vector, and the bins the trees need, for the small table of articles with a forecast.

    Text columns, which are those named as categories, become indexed nominal
    features. The buy models use ``boosting`` instead, which numbers no values.
    """
    numeric, category = split_types(frame, features)
    stages, inputs, bins = [], list(numeric), 32
    if category:
        indexer = StringIndexer(inputCols=category, outputCols=[f"{c}__idx" for c in category],
                                handleInvalid="keep", stringOrderType="alphabetAsc").fit(frame)
        stages.append(indexer)
        inputs += [f"{c}__idx" for c in category]
        bins = max([bins, *(len(labels) + 1 for labels in indexer.labelsArray)])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages, bins


def fill_missing(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing numbers get a value outside every feature's range: a branch of their own."""
    numeric, category = split_types(frame, features)
    return frame.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in numeric}
        | {c: F.coalesce(F.col(c), F.lit("")) for c in category})


# a run of a few rounds; ``boosting.PRODUCTION`` has the settings of a long one
DEFAULT = B.PRODUCTION._replace(rounds=20, learning_rate=0.2, leaves=16, min_rows=10, min_hessian=0.05, patience=5)


def fit_buy_model(train: DataFrame, valid: DataFrame | None = None, features: Sequence[str] | None = None,
                  seed: int = 0, truth: str | None = None, packed: B.Packed | None = None, **params) -> Booster:
    """Boosted trees on ``buy``; with ``valid`` training stops when its metric stops improving. ``params`` are fields of ``boosting.Params``.

    ``packed`` holds the same rows from ``pack_rows``, where several models are fitted on them.
    """
    features = list(features or feature_columns(train))
    return B.boost(packed or pack_rows(train, valid, features, truth, params.get("bins", DEFAULT.bins)), DEFAULT._replace(seed=seed, **params))


def pack_rows(train: DataFrame, valid: DataFrame | None, features: Sequence[str], truth: str | None = None, bins: int = DEFAULT.bins) -> B.Packed:
    return B.pack_rows(train, features, valid, bins, truth=truth)


def score(model: Booster, frame: DataFrame, features: Sequence[str] | None = None,
          keys: Sequence[str] = ("customer_id", "article_id")) -> DataFrame:
    """(keys, pred) for every row, in one distributed pass: the probability of a purchase, or a margin if the model ranks."""
    return B.score(model, frame, keys)


def score_mean(models: Sequence[Booster], frame: DataFrame, features: Sequence[str] | None = None,
               keys: Sequence[str] = ("customer_id", "article_id")) -> DataFrame:
    """Mean prediction over several models (seeds, folds, bags), per row: no union, no join."""
    return B.score(models, frame, keys)


def fit_seeds(train: DataFrame, valid: DataFrame | None, features: Sequence[str], n_seed: int, **params) -> list[Booster]:
    """One model per seed, all from rows that are packed once."""
    packed = pack_rows(train, valid, features, params.get("truth"), params.get("bins", DEFAULT.bins))
    return [fit_buy_model(train, valid, features, seed, packed=packed, **params) for seed in range(n_seed)]


def fit_bags(bagged: DataFrame, valid: DataFrame | None, features: Sequence[str], seeds: Sequence[int],
             **params) -> list[Booster]:
    """One model per bag of an under-sampled training frame with a ``seed`` column."""
    bagged = cut(bagged)
    return [fit_buy_model(bagged.filter(F.col("seed") == s).drop("seed"), valid, features, s, **params) for s in seeds]


def fit_warm_cold(train: DataFrame, features: Sequence[str], probe: str = "customer_total_cnt",
                  **params) -> dict[str, Booster]:
    """One model for customers with history and one for those without; none for a population without training rows."""
    models = {name: fit_buy_model(part, None, features, **params)
              for name, part in zip(("warm", "cold"), warm_cold(train, probe)) if not part.isEmpty()}
    if not models:
        raise ValueError("no training rows")
    return models


def score_warm_cold(models: Mapping[str, Booster], frame: DataFrame, features: Sequence[str],
                    probe: str = "customer_total_cnt") -> DataFrame:
    """(keys, pred) of all rows, each by its population's model, or by the other one where its own has no model."""
    warm, cold = warm_cold(frame, probe)
    return (score(models.get("warm") or models["cold"], warm, features)
            .unionByName(score(models.get("cold") or models["warm"], cold, features)))


def importance(models: Sequence[Booster]) -> DataFrame:
    """(feature, importance): gain share per feature, mean over models, highest first."""
    return B.importance(models)


def save_model(model: Booster, path: str) -> None:
    B.save(model, path)


def find_models(spark: SparkSession, folder: str, prefix: str = "") -> list[Booster]:
    """The models saved under ``folder`` whose names start with ``prefix``, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().toString() for s in store.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    return load_models(sorted(names))


def load_models(paths: Sequence[str]) -> list[Booster]:
    return [B.load(SparkSession.active(), p) for p in paths]


# ---- first-week sales -----------------------------------------------------------------

def forecast_sales(train: DataFrame, unseen: DataFrame, features: Sequence[str], label: str = "1st_week_sales",
                   folds: int = 5, loss: str = "absolute", **params) -> DataFrame:
    """Out-of-fold predictions for known articles, fold-mean predictions for unseen ones.

    ``train`` carries a ``fold`` column. Returns (article_id,
    1st_week_sales_dat, 1st_week_sales_pred, fold); unseen articles have fold
    null. ``loss`` is "absolute" or "squared".
    """
    keep = ["article_id", "1st_week_sales_dat"]
    train = cut(fill_missing(train, features).select(*keep, *features, "fold", F.col(label).cast("double").alias("label")))
    unseen = cut(fill_missing(unseen, features).select(*keep, *features))
    options = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1} | params
    stages, bins = assembler(train.select(*features).unionByName(unseen.select(*features)), features)
    result = None
    for fold in range(folds):
        trees = GBTRegressor(featuresCol="features", labelCol="label", lossType=loss, maxBins=bins, seed=fold, **options)
        model = Pipeline(stages=[*stages, trees]).fit(train.filter(F.col("fold") != fold))
        mine = (model.transform(train.filter(F.col("fold") == fold))
                .select(*keep, F.lit(fold).alias("fold"), F.col("prediction").alias("p")))
        new = model.transform(unseen).select(*keep, F.lit(None).cast("int").alias("fold"), F.col("prediction").alias("p"))
        part = mine.unionByName(new)
        result = part if result is None else result.unionByName(part)
    return result.groupBy(*keep, "fold").agg(F.avg("p").alias("1st_week_sales_pred"))
