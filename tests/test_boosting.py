"""The booster against a plain NumPy one that splits one leaf after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwheel.operators import boosting as B, evaluate as E, gradients as G, models as M

SCHEMA = "customer_id string, article_id string, x double, y double, shop string, buy int"


def rows(n=2000, seed=1, shops=40):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        x, y, shop = rng.gauss(0, 1), rng.randint(0, 9), rng.randint(0, shops - 1)
        chance = 1 / (1 + math.exp(-(1.5 * x * (y > 4) + (1.2 if shop % 7 == 0 else -0.8))))
        found.append((f"c{i // 8:04d}", f"a{i % 97:03d}", None if rng.random() < 0.1 else x, float("nan") if rng.random() < 0.05 else float(y),
                      None if shop == 3 else f"s{shop}", int(rng.random() < chance)))
    return found


class Plain:
    """Best-first trees over the same bins, every leaf's split searched by direct sums."""

    def __init__(self, data, edges, shops, params, base):
        self.params, self.base = params, base
        self.bins = [[0 if v is None or math.isnan(v) else min(sum(e < v for e in edge) + 1, len(edge)) for v in column] for column, edge in zip(data, edges)]
        self.shops = shops

    def score(self, g, h):
        return g * g / (h + self.params.l2)

    def best(self, at, g, h):
        p, found = self.params, None
        total = (sum(g[i] for i in at), sum(h[i] for i in at), len(at))
        sides = []
        for f, column in enumerate(self.bins):
            for missing in (True, False):
                for edge in range(max(column) + 1):
                    sides.append((f, edge, missing, {i for i in at if (missing if column[i] == 0 else column[i] <= edge)}))
        by_shop = {}
        for i in at:
            by_shop.setdefault(self.shops[i], []).append(i)
        often = [(sum(g[i] for i in m) / (sum(h[i] for i in m) + p.cat_smooth), code) for code, m in by_shop.items() if len(m) >= p.cat_min_rows]
        for order in (sorted(often), sorted(often, key=lambda r: (-r[0], r[1]))):
            left = set()
            for _, code in order[:p.cat_most]:
                left = left | set(by_shop[code])
                sides.append((len(self.bins), None, None, set(left)))
        for f, edge, missing, left in sides:
            a = (sum(g[i] for i in left), sum(h[i] for i in left), len(left))
            b = tuple(x - y for x, y in zip(total, a))
            if min(a[2], b[2]) >= p.min_rows and min(a[1], b[1]) >= p.min_hessian:
                gain = self.score(*a[:2]) + self.score(*b[:2]) - self.score(*total[:2])
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, left)
        return found

    def tree(self, g, h):
        leaves = [(list(range(len(g))), self.best(range(len(g)), g, h))]
        while len(leaves) < self.params.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][1][0] if leaves[i][1] else -1)
            if not leaves[at][1]:
                break
            members, (_, left) = leaves.pop(at)
            for side in ([i for i in members if i in left], [i for i in members if i not in left]):
                leaves.append((side, self.best(side, g, h)))
        value = np.zeros(len(g))
        for members, _ in leaves:
            value[members] = -self.params.learning_rate * sum(g[i] for i in members) / (sum(h[i] for i in members) + self.params.l2)
        return value

    def run(self, label):
        margin = np.full(len(label), self.base)
        for _ in range(self.params.rounds):
            margin = margin + self.tree(*G.log_loss_gradients(margin, label))
        return margin


def test_trees_equal_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    data = rows(700)
    frame = spark.createDataFrame(data, SCHEMA)
    params = B.Params(rounds=3, leaves=9, min_rows=15, bins=12, learning_rate=0.3, window=2, cat_most=4, cat_min_rows=8)
    model = B.fit(frame, ["x", "y", "shop"], params)
    assert model.numbers == ("x", "y") and model.categories == ("shop",) and [sum(n.feature < 0 for n in t) for t in model.trees] == [9, 9, 9]
    codes = {r.shop: r.code for r in frame.select("shop", B.code_of("shop").alias("code")).distinct().collect()}
    plain = Plain([[r[2] for r in data], [r[3] for r in data]], model.edges, [codes[r[4]] for r in data], params, model.base)
    want = plain.run(np.array([r[5] for r in data], float))
    keys = [f"{r[0]}-{i}" for i, r in enumerate(data)]
    again = spark.createDataFrame([(k, *r[1:]) for k, r in zip(keys, data)], SCHEMA)
    found = {r.customer_id: r.pred for r in B.score(model, again).collect()}
    assert max(abs(found[k] - 1 / (1 + math.exp(-m))) for k, m in zip(keys, want)) < 1e-9
    assert {n.feature for t in model.trees for n in t} >= {0, 2}


@pytest.mark.parametrize("seed", range(8))
def test_number_split_equals_all_thresholds(seed):
    rng = np.random.default_rng(seed)
    hist = np.stack([rng.normal(0, 3, 20), rng.uniform(0, 4, 20), rng.integers(0, 9, 20)]) * (rng.random(20) < 0.8)
    params = B.Params(min_rows=3, l1=0.3 * (seed % 2), l2=0.5)
    best = 0.0
    for missing in (True, False):
        for at in range(20):
            left = hist[:, [b for b in range(20) if (missing if b == 0 else b <= at)]].sum(axis=1)
            right = hist.sum(axis=1) - left
            if min(left[2], right[2]) >= 3 and min(left[1], right[1]) >= params.min_hessian:
                best = max(best, B._score(*left[:2], params) + B._score(*right[:2], params) - B._score(*hist.sum(axis=1)[:2], params))
    found = B.best_number_split(hist, params)
    assert abs((found[0] if found and found[0] > 0 else 0.0) - best) < 1e-9


def test_stopping_round_is_the_best_of_all(spark):
    train, valid = (spark.createDataFrame(rows(900, seed), SCHEMA) for seed in (1, 2))
    features = ["x", "y", "shop"]
    params = B.Params(rounds=10, leaves=5, min_rows=10, learning_rate=0.9, patience=4, window=4)
    model = B.fit(train, features, params, valid)
    # the same rounds without watching, cut by hand
    whole = B.fit(train, features, params._replace(rounds=len(model.history)))
    truth = valid.filter("buy = 1").select("customer_id", "article_id").distinct()
    labels = {(r.customer_id, r.article_id): r.buy for r in valid.collect()}
    losses = []
    for rounds, loss, precision in model.history:
        scored = B.score(whole._replace(trees=whole.trees[:rounds]), valid)
        plain = [(-math.log(r.pred if labels[r.customer_id, r.article_id] else 1 - r.pred)) for r in scored.collect()]
        assert abs(sum(plain) / len(plain) - loss) < 1e-9
        losses.append(loss)
        if rounds in (1, len(model.history)):
            report = E.mean_average_precision(E.best_by_score(scored, "pred"), truth).first()
            assert abs(report[0] - precision) < 1e-9
    best = min(range(len(losses)), key=losses.__getitem__) + 1
    assert len(model.trees) == best and len(losses) - best >= 4 or len(losses) == 10


def test_ranking_loss_is_not_below_the_pointwise_one(spark):
    rng = random.Random(6)
    data = []
    for c in range(150):
        shift = rng.gauss(0, 4)                 # customers differ in level, which ranks nothing
        for a in range(20):
            x = rng.gauss(0, 1)
            data.append((f"c{c:03d}", f"a{a:02d}", x, shift, "s", int(rng.random() < (0.9 if x > 1.2 else 0.03))))
    frame = spark.createDataFrame(data, SCHEMA)
    train, valid = frame.filter("customer_id < 'c100'"), frame.filter("customer_id >= 'c100'")
    truth = valid.filter("buy = 1").select("customer_id", "article_id")
    value = {}
    for objective in ("log_loss", "ndcg", "map"):
        model = B.fit(train, ["x", "y"], B.Params(objective=objective, rounds=8, leaves=6, min_rows=10, min_hessian=1e-6, window=8), valid)
        value[objective] = E.mean_average_precision(E.best_by_score(B.score(model, valid), "pred"), truth).first()[0]
        assert abs(value[objective] - max(h[2] for h in model.history)) < 1e-9 or objective == "log_loss"
    assert min(value["ndcg"], value["map"]) >= value["log_loss"] - 0.01 and value["ndcg"] > 0.7


def test_many_categories_are_never_numbered(spark):
    n = 30_000
    frame = (spark.range(n).select((F.col("id") / 10).cast("int").cast("string").alias("customer_id"), F.col("id").cast("string").alias("article_id"),
                                   F.concat(F.lit("v"), (F.col("id") % 10_000).cast("string")).alias("shop"))
             .withColumn("buy", ((F.substring("shop", 2, 9).cast("int") % 10_000) < 20).cast("int")))
    model = B.fit(frame, ["shop"], B.Params(rounds=2, leaves=3, cat_min_rows=3, min_rows=5, learning_rate=0.5, cat_smooth=1.0))
    named = {c for t in model.trees for node in t for c in node.codes}
    assert 0 < len(named) <= 2 * 2 * 32
    scored = {r.article_id: r.pred for r in B.score(model, frame).collect()}
    assert min(scored[str(i)] for i in range(20)) > 10 * max(scored[str(i)] for i in range(20, 5000))


def test_models_are_stored_and_weighed(spark, tmp_path):
    frame = spark.createDataFrame(rows(400), SCHEMA)
    model = B.fit(frame, ["x", "y", "shop"], B.Params(rounds=2, leaves=4, row_share=0.7, feature_share=0.7))
    B.save(model, f"file://{tmp_path}/m")
    assert B.load(spark, f"file://{tmp_path}/m") == model
    shares = {r.feature: r.importance for r in B.importance([model, model]).collect()}
    assert set(shares) == {"x", "y", "shop"} and abs(sum(shares.values()) - 1) < 1e-12
    unseen = spark.createDataFrame([("c", "a", None, None, "never seen", 0)], SCHEMA)
    assert 0 < B.score([model, model], unseen).first().pred < 1
    one = B.fit(frame.filter("buy = 0"), ["x"], B.Params(rounds=3))
    assert all(len(t) == 1 for t in one.trees)


def test_listed_categories_give_the_trees_of_those_grouped_by_code(spark, monkeypatch):
    frame = spark.createDataFrame(rows(1500, seed=3), SCHEMA)
    params = B.Params(rounds=3, leaves=8, min_rows=10, learning_rate=0.3, cat_most=6, cat_min_rows=5, row_share=0.8)
    assert B.code_lists(frame, ["shop"])[0].tolist() == sorted(r[0] for r in frame.select(B.code_of("shop")).distinct().collect())
    listed = B.fit(frame, ["x", "y", "shop"], params)
    monkeypatch.setattr(B, "LISTED", 0)
    assert B.code_lists(frame, ["shop"]) == (None,)
    grouped = B.fit(frame, ["x", "y", "shop"], params)
    shape = lambda b: [[(n.feature, n.bin, n.missing, n.codes, n.left, n.right, n.rows) for n in t] for t in b.trees]
    assert shape(listed) == shape(grouped) and any(n.codes for t in listed.trees for n in t)
    assert all(abs(p.value - q.value) < 1e-12 for s, t in zip(listed.trees, grouped.trees) for p, q in zip(s, t))
    # a value that training never saw goes the same way in packed and in plain rows
    valid = spark.createDataFrame([(*r[:4], "never seen", r[5]) for r in rows(200, seed=4)], SCHEMA)
    monkeypatch.undo()
    watched = B.fit(frame, ["x", "y", "shop"], params, valid)
    loss = [-math.log(p if y else 1 - p) for p, y in ((r.pred, r.buy) for r in B.score(B.fit(frame, ["x", "y", "shop"], params), valid, ("customer_id", "article_id", "buy")).collect())]
    assert abs(sum(loss) / len(loss) - watched.history[-1][1]) < 1e-9


def test_models_of_several_seeds_share_the_packed_rows(spark, monkeypatch):
    frame = spark.createDataFrame(rows(600), SCHEMA)
    calls, real = [], B.pack
    monkeypatch.setattr(B, "pack", lambda *a, **k: calls.append(1) or real(*a, **k))
    both = M.fit_seeds(frame, frame, ["x", "y", "shop"], 2, rounds=12, leaves=4, window=5, patience=100)
    assert len(calls) == 2              # the training rows and the validation rows
    assert both[1] == M.fit_buy_model(frame, frame, ["x", "y", "shop"], 1, rounds=12, leaves=4, window=5, patience=100) != both[0]
