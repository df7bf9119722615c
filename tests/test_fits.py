"""The distributed fits against plain Python on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.operators import boosting, forest, logistic, net, svm
from pitchline.operators.fitting import Fitted, draw, draw_column, pack
from pitchline.operators.models import LABEL, feature_importance, fit, predict


def frame(spark, x, y, parts=3):
    rows = [(i, *map(lambda v: None if v is None else float(v), r), c) for i, (r, c) in enumerate(zip(x, y))]
    names = ", ".join(f"f{i} double" for i in range(len(x[0])))
    return spark.createDataFrame(rows, f"match_id long, {names}, {LABEL} string").repartition(parts)


@pytest.fixture(scope="module")
def noisy(spark):
    """Three overlapping classes and a feature of noise."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = np.column_stack([y + rng.normal(0, 0.9, 400), -y + rng.normal(0, 1.2, 400), rng.normal(0, 1, 400)])
    return x, np.array(["A", "D", "H"])[y]


def test_draws_agree_in_numpy_and_spark(spark):
    ids = [0, 1, -7, 2**40 + 3, 999_999_937]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r[0]: r[1] for r in df.select("id", draw_column(F.col("id"), 84_000_253)).collect()}
    assert [got[i] for i in ids] == pytest.approx(draw(ids, 84_000_253).tolist(), abs=0)
    u = draw(np.arange(20_000), 5)
    assert abs(u.mean() - 0.5) < 0.01 and abs((u < 0.6).mean() - 0.6) < 0.015
    assert abs(np.corrcoef(u, draw(np.arange(20_000), 7))[0, 1]) < 0.03


# ------------------------------------------------------------------ boosting
def plain_boosting(ids, x, y, k, rounds, depth, rate, rows, cols, lam, alpha, seed):
    """One node at a time, every cut tried."""
    m = [[0.0] * k for _ in x]
    p, out = len(x[0]), []

    def soft(g):
        return math.copysign(max(abs(g) - alpha, 0.0), g)

    def obj(s):
        return soft(s[0]) ** 2 / (s[1] + lam)

    for r in range(rounds):
        prob = []
        for row in m:
            e = [math.exp(v - max(row)) for v in row]
            prob.append([v / sum(e) for v in e])
        step = [[0.0] * k for _ in x]
        for c in range(k):
            tree = r * k + c
            keep = [i for i in range(len(x)) if draw(ids[i], boosting.stream(seed, tree)) < rows]
            order = sorted(range(p), key=lambda f: (draw(f, boosting.stream(seed, tree) + 1), f))[:max(1, int(p * cols))]
            gh = {i: (prob[i][c] - (y[i] == c), max(2 * prob[i][c] * (1 - prob[i][c]), 1e-16)) for i in range(len(x))}
            total = lambda rows_: (sum(gh[i][0] for i in rows_), sum(gh[i][1] for i in rows_))  # noqa: E731, B023

            def grow(inside, every, level, node):
                s = total(inside)
                best = None
                if level < depth:
                    for f in sorted(order):
                        for v in sorted({x[i][f] for i in range(len(x))})[:-1]:
                            left = [i for i in inside if x[i][f] <= v]
                            right = [i for i in inside if x[i][f] > v]
                            a, b = total(left), total(right)
                            if a[1] < 1 or b[1] < 1:
                                continue
                            gain = round(obj(a) + obj(b) - obj(s), 9)
                            if gain > 1e-6 and (best is None or gain > best[0]):
                                best = gain, f, v
                if best is None:
                    for i in every:
                        step[i][c] = -soft(s[0]) / (s[1] + lam)
                    return
                out.append((r, c, node, best[1], best[2], best[0]))
                _, f, v = best
                grow([i for i in inside if x[i][f] <= v], [i for i in every if x[i][f] <= v], level + 1, 2 * node + 1)
                grow([i for i in inside if x[i][f] > v], [i for i in every if x[i][f] > v], level + 1, 2 * node + 2)

            grow(keep, list(range(len(x))), 0, 0)
        m = [[a + rate * b for a, b in zip(p_, q_)] for p_, q_ in zip(m, step)]
    return out, m


def test_boosting_equals_plain_python(spark, noisy):
    x, y = np.round(noisy[0][:60], 1), noisy[1][:60]
    args = dict(learning_rate=0.3, subsample=0.7, colsample_bytree=0.7, reg_lambda=1.5, reg_alpha=0.4)
    data = pack(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], LABEL, False, False)
    model = boosting.fit_boosted(data, n_estimators=4, max_depth=2, **args)
    want, margins = plain_boosting(list(range(60)), x.tolist(), [["A", "D", "H"].index(c) for c in y], 3, 4, 2, 0.3, 0.7, 0.7, 1.5, 0.4, 42)
    got = [(r, c, n, t["feature"][n], t["value"][n], t["gain"][n]) for r, trees in enumerate(model.state["rounds"]) for c, t in enumerate(trees)
           for n in range(7) if t["feature"][n] >= 0]
    assert len(want) > 15
    assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want)
    assert np.allclose(sorted(g[4:] for g in got), sorted(w[4:] for w in want), atol=1e-6)
    assert np.allclose(boosting.margins_of(model, x), margins, atol=1e-9)


def test_boosting_terms_act(spark, noisy, monkeypatch):
    monkeypatch.setattr(boosting, "REWRITE", 3)            # margins written and reread in between
    data = pack(frame(spark, noisy[0].tolist(), noisy[1]), ["f0", "f1", "f2"], LABEL, False, False)
    base = boosting.fit_boosted(data, n_estimators=8)
    loss = base.state["loss"]
    assert loss[0] == pytest.approx(math.log(3)) and all(a > b for a, b in zip(loss, loss[1:]))
    weights = lambda m: np.array([w for trees in m.state["rounds"] for t in trees for w in t["weight"]])
    assert np.abs(weights(boosting.fit_boosted(data, n_estimators=2, reg_lambda=1000.0))).max() < np.abs(weights(base)).max() / 3
    assert not weights(boosting.fit_boosted(data, n_estimators=2, reg_alpha=1e6)).any()
    assert [len(boosting.columns_of(20, s, 42, 0)) for s in (0.01, 0.5, 1.0)] == [1, 10, 20]
    assert len({tuple(boosting.columns_of(20, 0.5, 42, t)) for t in range(30)}) > 25


# ------------------------------------------------------------------ forest
def test_forest_does_not_depend_on_partitions(spark, noisy):
    trees = []
    for parts in (1, 5):
        data = pack(frame(spark, noisy[0].tolist(), noisy[1], parts), ["f0", "f1", "f2"], LABEL, False, True)
        trees.append(forest.fit_forest(data, n_estimators=6, max_depth=3).state["trees"])
    for a, b in zip(*trees):
        assert (a["feature"], a["bin"]) == (b["feature"], b["bin"])
        assert np.allclose(a["dist"], b["dist"])


def test_forest_limits(spark, noisy):
    x, y = noisy
    data = pack(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], LABEL, False, False)
    ids = np.arange(len(x))
    for split, leaf in ((120, 15), (2, 60)):
        m = forest.fit_forest(data, n_estimators=5, max_depth=4, min_samples_split=split, min_samples_leaf=leaf)
        for i, t in enumerate(m.state["trees"]):
            inside = {0: ids[forest.bag_counts(ids, 42, i) > 0]}
            for n in range(15):
                if t["feature"][n] < 0:
                    continue
                rows = inside[n]
                assert len(rows) >= split
                right = x[rows, t["feature"][n]] > t["value"][n]
                inside[2 * n + 1], inside[2 * n + 2] = rows[~right], rows[right]
                assert min(len(rows[~right]), len(rows[right])) >= leaf
    counts = np.concatenate([forest.bag_counts(np.arange(5000), 42, t) for t in range(10)])
    assert abs(counts.mean() - 1) < 0.02 and abs((counts == 0).mean() - math.exp(-1)) < 0.01


# ------------------------------------------------------------------ logistic regression
def test_logistic_gradient_vanishes(spark, noisy):
    x, y = noisy
    m = fit(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], "logistic_regression")
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w = np.array(m.state["weights"])
    s = z @ w.T
    prob = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    onehot = np.array([[c == k for k in m.classes] for c in y], dtype=float)
    weight = np.array([len(y) / (3 * (y == c).sum()) for c in y])
    grad = ((prob - onehot) * weight[:, None]).T @ z + np.hstack([w[:, :-1] / 0.01, np.zeros((3, 1))])
    assert np.abs(grad).max() < 1e-6
    assert m.state["passes"] < 15
    p = predict(m, frame(spark, x.tolist(), y)).toPandas().set_index("match_id").sort_index()
    assert np.allclose(p[["p_A", "p_D", "p_H"]], prob)


# ------------------------------------------------------------------ support vectors
def test_svm_probabilities(spark, noisy):
    x, y = noisy
    m = fit(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], "svm")
    z = (x - x.mean(0)) / x.std(0)
    _, prob = svm.scores(m, z)
    assert np.allclose(prob.sum(1), 1) and (prob >= 0).all()
    truth = np.array([m.classes.index(c) for c in y])
    wins = np.zeros((len(x), 3))
    for (a, b), w, (slope, _) in zip(m.state["pairs"], m.state["weights"], m.state["sigmoid"]):
        assert slope < 0                                      # the larger the margin, the larger the probability
        f = z @ np.array(w[:-1]) + w[-1]
        wins[:, a] += f
        wins[:, b] -= f
    raw = np.exp(wins) / np.exp(wins).sum(1, keepdims=True)
    loss = lambda p: -np.log(p[np.arange(len(y)), truth]).mean()
    assert loss(prob) < loss(raw)


def test_svm_reaches_the_hinge_optimum(spark, noisy):
    """No better weights around, by the plain hinge objective."""
    x, y = noisy
    data = pack(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], LABEL, True, True)
    w = svm.hinge_models(data, [(0, 2, None)], 0.1, 5, 50)[0]
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    side = np.where(y == "A", 1.0, np.where(y == "H", -1.0, 0.0))
    weight = np.array([len(y) / (3 * (y == c).sum()) for c in y]) * (side != 0)
    cost = lambda v: 0.5 * (v[:-1] ** 2).sum() + 0.1 * (weight * np.maximum(0, 1 - side * (z @ v))).sum()
    rng = np.random.default_rng(1)
    around = min(cost(w + rng.normal(0, s, 4)) for s in (0.3, 0.1, 0.03, 0.01, 0.003) for _ in range(400))
    assert cost(w) <= around + 1e-3 * cost(w)


def test_coupling():
    # consistent pairs give the classes' own probabilities back
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(svm.couple(r), p)
    assert np.allclose(svm.couple(np.array([[[0.5, 0.9], [0.1, 0.5]]])), [[0.9, 0.1]])


def test_sigmoid_recovers_known_parameters(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 2, 8000)
    label = (rng.random(8000) < 1 / (1 + np.exp(-1.5 * f + 0.4))).astype(float)
    held = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(f, label)], "pair int, f double, label double")
    (a, b), = svm.sigmoid_fit(held, 1)
    assert abs(a + 1.5) < 0.1 and abs(b - 0.4) < 0.1


# ------------------------------------------------------------------ net
def test_net_gradient_is_the_finite_difference():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    v = net.start(4, 5, 3, 1)
    _, grad = net.loss_and_gradient(v, x, y, 5, 3)
    for i in range(len(v)):
        d = np.zeros_like(v)
        d[i] = 1e-6
        up, down = (net.loss_and_gradient(v + s * d, x, y, 5, 3)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_net_stops_on_noise_and_learns(spark, noisy):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(500, 3)), np.array(["A", "D", "H"])[rng.integers(0, 3, 500)]
    m = fit(frame(spark, x.tolist(), y), ["f0", "f1", "f2"], "fnn")
    assert m.state["epochs"] < 200
    learned = fit(frame(spark, noisy[0].tolist(), noisy[1]), ["f0", "f1", "f2"], "fnn")
    curve = learned.state["curve"]
    assert min(v for _, v in curve) < curve[0][1] - 0.2
    free = fit(frame(spark, noisy[0].tolist(), noisy[1]), ["f0", "f1", "f2"], "fnn", {"alpha": 100.0, "max_iter": 40})
    assert np.abs(free.state["weights"]).mean() < np.abs(learned.state["weights"]).mean()


# ------------------------------------------------------------------ all
def test_nulls_ties_and_saved_models(spark, noisy):
    x = noisy[0][:90].tolist()
    x[3], x[4] = [None, 1.0, None], [None, None, None]
    x[10] = x[11]
    y = list(noisy[1][:90])
    y[7] = None
    df = frame(spark, x, y)
    for kind, params in (("random_forest", {"n_estimators": 3}), ("xgboost", {"n_estimators": 2}), ("logistic_regression", {}), ("fnn", {"max_iter": 3})):
        m = fit(df, ["f0", "f1", "f2"], kind, params)
        again = Fitted.from_json(m.to_json())
        a, b = (predict(k, df).orderBy("match_id").toPandas() for k in (m, again))
        assert a.equals(b) and len(a) == 90
        assert ((a.p_H + a.p_D + a.p_A - 1).abs() < 1e-9).all()
        imp = feature_importance(m)
        assert imp is None or (set(imp) == {"f0", "f1", "f2"} and max(imp.values()) > 0)
    with pytest.raises(ValueError):
        fit(df.where("false"), ["f0"], "xgboost")
    one = fit(df.where(F.col(LABEL) == "H"), ["f0", "f1"], "random_forest", {"n_estimators": 2})
    assert {(r.y_pred, r.p_H) for r in predict(one, df).collect()} == {("H", 1.0)}
    assert logistic.probabilities(fit(df, ["f0"], "logistic_regression")) is not None


def test_a_pass_is_one_stage_and_many_tasks_are_added_up(spark):
    from pitchline.operators import fitting
    rows = spark.range(0, 1000, 1, 3)
    of = lambda b: np.array([b.num_rows, b.column(0).to_numpy().sum()], dtype=float)
    spark.sparkContext.setJobGroup("one-pass", "")
    assert fitting.task_sums(rows, of, 2).tolist() == [1000, 499500]
    spark.sparkContext.setJobGroup("others", "")
    tracker = spark.sparkContext.statusTracker()
    assert sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("one-pass")) == 1
    assert fitting.task_sums(spark.range(0, 1000, 1, fitting.FEW_PARTS + 1), of, 2).tolist() == [1000, 499500]


def test_rows_as_bytes_and_trees_by_columns():
    import pyarrow as pa
    from pitchline.operators.fitting import matrix, row_bytes
    from pitchline.operators.trees import reached, walk
    rng = np.random.default_rng(3)
    b = rng.integers(0, 9, (50, 4)).astype(np.int16)
    assert (matrix(row_bytes(b).slice(7, 30), 4, np.int16) == b[7:37]).all()
    x = rng.normal(size=(5, 3))
    assert (matrix(row_bytes(x), 3) == matrix(pa.array(x.tolist(), pa.list_(pa.float64())), 3)).all()
    tree = {"feature": [2, -1, 0, -1, -1, -1, -1], "bin": [4, 0, 3, 0, 0, 0, 0]}
    values = np.arange(7.0)
    assert (reached(tree, b.T, values, 2) == values[walk(tree, b, "bin", 2)]).all()


# ------------------------------------------------------------------ what a fit at size reads and sorts
def test_cuts_sort_only_the_rows_near_them(spark, monkeypatch):
    import datetime as dt

    from pitchline.operators import splits
    n = 20_000
    when = lambda i: None if i % 997 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i * 7919 % n // 3)
    rows = [(when(i), None if i % 501 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "t timestamp, id long").repartition(4).cache()
    last = lambda r: tuple((v is None, v if v is not None else 0 if j else dt.datetime.min) for j, v in enumerate(r))
    order = sorted(rows, key=last)
    sorted_rows, plain = [], splits.positional_index
    monkeypatch.setattr(splits, "positional_index", lambda d, *a, **k: sorted_rows.append(d.count()) or plain(d, *a, **k))
    at = [0, 1, int(n * 0.7), int(n * 0.85), n - 30]
    assert [tuple(r.values()) for r in splits.keys_at(df, ["t", "id"], n, at)] == [order[a] for a in at]
    assert max(sorted_rows) < n // 20
    assert [r and tuple(r.values()) for r in splits.keys_at(df, ["t", "id"], n, [n - 1, n])] == [order[-1], None]       # a null time: all are sorted
    got = {(r[0], r[1]): r[2] for r in splits.split_labels(df, ["t", "id"]).collect()}
    assert all(got[r] == ("train" if i < at[2] else "val" if i < at[3] else "test") for i, r in enumerate(order))


def test_passes_read_bytes_and_draws_are_kept(spark, noisy):
    from pitchline.operators.fitting import matrix, pack
    from pitchline.operators.trees import binned, cut_points
    x, label = noisy
    df = spark.createDataFrame([(i, *map(float, r), c) for i, (r, c) in enumerate(zip(x, label))], "match_id long, f0 double, f1 double, f2 double, target_match_result string")
    data = pack(df, ["f0", "f1", "f2"], "target_match_result", True, True)
    t = data.rows.select("x", "xb").toArrow()
    assert (matrix(t["xb"].combine_chunks(), 3) == matrix(t["x"].combine_chunks(), 3)).all()
    cuts, _ = cut_points(data.rows, 3)
    rows, _ = binned(data, cuts, drawn=lambda ids: np.column_stack([forest.bag_counts(ids, 42, i) for i in range(5)]), parts=3)
    t = rows.select("id", "n").toArrow()
    ids = t["id"].to_numpy()
    assert sorted(ids.tolist()) == list(range(400))
    assert (matrix(t["n"].combine_chunks(), 5, np.uint8) == np.column_stack([forest.bag_counts(ids, 42, i) for i in range(5)])).all()
    data.close()


def test_passes_read_kept_blocks_on_all_cores(spark):
    """Packed rows are spread over the cores; passes after the first read no file."""
    from pitchline.operators import fitting
    df = spark.range(20_000).coalesce(1).select(F.col("id").alias("match_id"), (F.col("id") % 7).cast("double").alias("f"), F.when(F.col("id") % 2 == 0, "H").otherwise("A").alias("y"))
    data = fitting.pack(df, ["f"], "y", False, False)
    assert data.rows.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    of = lambda b: np.array([b.num_rows, b.column("id").to_numpy().sum()])
    blocks = fitting.kept(data.rows.select("id"))
    first = fitting.task_sums(blocks, of, 2).tolist()
    data.close()
    assert first == fitting.task_sums(blocks, of, 2).tolist() == [20_000, 199_990_000]
    blocks.unpersist()
