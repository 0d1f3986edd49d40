"""The models and resamples that SQL can't express, against NumPy over whole tables."""

import hashlib

import numpy as np
import pytest

from clickpulse.operators import explore, validation
from clickpulse.plans.queries import END, QUERIES, START
from clickpulse.plans.tables import Analysis
from clickpulse.plans.weights import WEIGHTS, directions

FEATURES = [w.feature for w in WEIGHTS]
PREDICTORS = [f for f in FEATURES if f not in ("cart_rate", "session_conversion_rate", "km_median_time_to_cart_s")]
TARGETS = ["cart_rate", "session_conversion_rate", "km_speed_to_cart"]


@pytest.fixture(scope="module")
def daily(spark, sf_dir):
    """A row per day, a column per feature."""
    rows = Analysis.of_shop(spark, sf_dir).daily.toPandas()
    wide = rows.pivot(index="date", columns="feature", values="value").astype(float).sort_index()
    return wide.set_index(wide.index.astype(str))


@pytest.fixture(scope="module")
def z(daily):
    table = daily[FEATURES] * np.array([w.direction for w in WEIGHTS])
    return (table - table.mean()) / table.std(ddof=0)


@pytest.fixture(scope="module")
def changes(daily):
    whole = daily.diff().dropna()
    speed = (1 / daily["km_median_time_to_cart_s"]).diff()
    return whole.assign(km_speed_to_cart=speed.loc[whole.index])


def first_component(table):
    values, vectors = np.linalg.eigh(np.corrcoef(table.to_numpy(), rowvar=False))
    top = vectors[:, -1] * (-1 if vectors[:, -1].sum() < 0 else 1)
    return top / np.abs(top).sum(), values[-1] / values.sum()


def test_pc1_weights(spark, sf_dir, z):
    got = QUERIES["pc1_weights"](spark, sf_dir).toPandas().set_index("feature")
    used = [f for f in FEATURES if z[f].notna().all()]
    loading, explained = first_component(z[used])
    assert set(got.index) == set(used)
    assert np.allclose(got.loc[used, "weight"], np.abs(loading), atol=2e-6) and np.allclose(got["explained"], explained, atol=2e-6)


def ridge(x, y, alpha):
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def plain_score(changes, start, end):
    inside = changes.loc[start:end]
    scaled = (changes - inside.mean()) / inside.std(ddof=0).replace(0, 1)
    fit = scaled.loc[start:end]
    score = scaled[PREDICTORS] @ ridge(fit[PREDICTORS].to_numpy(), fit[TARGETS].mean(axis=1).to_numpy(), 1.0)
    signs = sum(np.corrcoef(score.loc[start:end], fit[t])[0, 1] for t in TARGETS)
    return -score if signs < 0 else score


def test_delta_score(spark, sf_dir, changes):
    got = QUERIES["delta_score"](spark, sf_dir).toPandas().set_index("date").sort_index()
    score = plain_score(changes, START, END)
    assert list(got.index) == list(score.index) and np.allclose(got["score"], score, atol=1e-4)
    fitted = score.loc[START:END]
    sigma = 1.4826 * np.median(np.abs(fitted - np.median(fitted)))
    assert np.allclose(got["lo"], np.median(fitted) - 3 * sigma, atol=1e-4) and np.allclose(got["hi"], np.median(fitted) + 3 * sigma, atol=1e-4)
    assert (got["is_anomaly"] == ((got["score"] < got["lo"]) | (got["score"] > got["hi"]))).all()


def test_delta_holdout(spark, sf_dir, daily, changes):
    got = QUERIES["delta_holdout"](spark, sf_dir).toPandas().set_index("target")
    score = plain_score(changes, START, "2024-01-16")
    late = [d for d in score.index if (np.datetime64(daily.index[-1]) - np.datetime64(d)).astype(int) < 14]
    assert (got["n_days"] == len(late)).all()
    for t in TARGETS:
        assert abs(got.loc[t, "r"] - np.corrcoef(score[late], changes.loc[late, t])[0, 1]) < 1e-4


def test_ridge_sweep(spark, sf_dir, changes):
    got = QUERIES["ridge_sweep"](spark, sf_dir).toPandas().set_index(["target", "alpha"])
    assert len(got) == 21
    for t in TARGETS:
        wrong = {}
        for alpha in (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 50.0):
            errors = []
            for day in changes.index:
                rest = changes.drop(day)
                scaled = (rest - rest.mean()) / rest.std(ddof=0).replace(0, 1)
                own = ((changes.loc[day] - rest.mean()) / rest.std(ddof=0).replace(0, 1)).astype(float)
                errors.append(abs(own[PREDICTORS] @ ridge(scaled[PREDICTORS].to_numpy(), scaled[t].to_numpy(), alpha) - own[t]))
            wrong[alpha] = np.mean(errors)
            assert abs(got.loc[(t, alpha), "mae"] - wrong[alpha]) < 1e-5
        assert [a for a in wrong if got.loc[(t, a), "best"]] == [min(wrong, key=wrong.get)]


def test_weight_stability_and_choice(spark, sf_dir, z):
    got = QUERIES["weight_stability"](spark, sf_dir).toPandas().set_index(["group", "variant", "feature"])
    days = [d for d in z.index if z.loc[d].notna().any()]
    groups = {}
    for w in WEIGHTS:
        groups.setdefault(w.group, []).append(w.feature)
    drawn = {f"resample-{b}": [days[int(hashlib.md5(f"{b}-{i}".encode()).hexdigest()[:8], 16) % len(days)] for i in range(len(days))] for b in range(50)}
    half = -(-len(days) // 2)
    n, weights, whole = 0, {}, {}
    for group, names in groups.items():
        variants = {"all": days, "first half": days[:half], "second half": days[half:], **drawn, **{f"without {f}": days for f in names}}
        for variant, picked in variants.items():
            part = z.loc[picked, [f for f in names if f"without {f}" != variant]]
            part = part[[f for f in part if part[f].notna().all() and part[f].std() > 0]]
            if part.shape[1] < 2:
                continue
            loading, explained = first_component(part)
            for f, x in zip(part.columns, loading, strict=True):
                row = got.loc[(group, variant, f)]
                n += 1
                assert abs(row["weight"] - abs(x)) < 1e-5 and abs(row["equal"] - 1 / part.shape[1]) < 2e-6 and abs(row["explained"] - explained) < 1e-5
                weights.setdefault((group, f), {})[variant] = abs(x)
            if variant == "all":
                whole[group] = explained, loading.min()
    assert n == len(got)
    choice = QUERIES["weight_choice"](spark, sf_dir).toPandas().set_index("group")
    for group, (explained, least) in whole.items():
        bands = {f: np.percentile([x for v, x in w.items() if v.startswith("resample-")], [2.5, 50, 97.5]) for (g, f), w in weights.items() if g == group}
        widest = max((hi - lo) / mid for lo, mid, hi in bands.values())
        split = max(abs(w["first half"] - w["second half"]) for (g, _), w in weights.items() if g == group)
        row = choice.loc[group]
        assert abs(row["widest_interval"] - widest) < 1e-4 * max(1, widest) and abs(row["time_split"] - split) < 1e-5
        assert row["equal_inside"] == all(lo <= 1 / len(bands) <= hi for lo, _, hi in bands.values())
        assert row["choice"] == ("pc1" if explained > 0.5 and least > 0 and widest < 1 else "equal")


def test_choice_of_one_strong_component(spark):
    """Features that go together make PC1 the choice; noise leaves equal weights."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        common = rng.standard_normal()
        day = f"2024-01-{i + 1:02}" if i < 31 else f"2024-02-{i - 30:02}" if i < 60 else ""
        rows += [(day, w.feature, common + 0.2 * rng.standard_normal() if w.group == "quality" else rng.standard_normal()) for w in WEIGHTS]
    scores = explore.oriented(spark.createDataFrame(rows, "date string, feature string, value double"), directions())
    got = {r["group"]: r["choice"] for r in validation.weight_choice(validation.weight_stability(scores)).collect()}
    assert got["quality"] == "pc1" and got["engagement"] == "equal"


def test_best_weights_beat_all_others(spark):
    """Against a fine grid over three features, and against random weights and their corners over seven."""
    rng = np.random.default_rng(9)
    grid = np.array([(a, b, 100 - a - b) for a in range(101) for b in range(101 - a)]) / 100
    for trial in range(4):
        k = 3 if trial < 2 else 7
        x = rng.standard_normal((60, k)) + 1.2 * rng.standard_normal((60, 1))
        gram = np.corrcoef(x, rowvar=False)
        others = grid if k == 3 else np.vstack((rng.dirichlet(np.ones(k), 20_000), np.eye(k)))
        r = others @ gram / np.sqrt(np.einsum("ij,jk,ik->i", others, gram, others))[:, None]
        for objective, best in (("mean", r.mean(1).max()), ("min", r.min(1).max())):
            w = validation._ascend(gram, objective)
            mine = gram @ w / np.sqrt(w @ gram @ w)
            assert w.min() >= 0 and w.sum() == pytest.approx(1)
            assert (mine.mean() if objective == "mean" else mine.min()) >= best - 1e-6


def test_best_weights_as_a_table(spark):
    pairs = [("a", "b", 0.5), ("a", "c", 0.1), ("b", "c", None)]
    rows = spark.createDataFrame([*pairs, *((b, a, r) for a, b, r in pairs)], "feature_a string, feature_b string, r double")
    found = validation.best_weights(rows).toPandas()
    assert len(found) == 6 and np.allclose(found.groupby("candidate")["weight"].sum(), 1)
    others = validation.weight_set_scores(rows, {"equal": dict.fromkeys("abc", 1 / 3), "one": {"a": 1.0, "b": 0.0, "c": 0.0}}).toPandas()
    assert found[found["candidate"] == "min"]["min_r"].iloc[0] >= others["min_r"].max() - 1e-9
    assert found[found["candidate"] == "mean"]["mean_r"].iloc[0] >= others["mean_r"].max() - 1e-9
    assert validation.best_weights(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="objective"):
        validation.best_weights(rows, ("most",))
