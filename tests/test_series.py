"""State-space factor, Welch's spectrum and phase surrogates by lag, against plain versions."""

import numpy as np
import pandas as pd
import pytest

from tallyhouse.functions import kernels as K
from tallyhouse.operators import spectra as Sp
from tallyhouse.operators import statespace as S
from tallyhouse.plans import catalog
from tests.conftest import SMALL


def simulated(n=600, seed=3):
    rng = np.random.default_rng(seed)
    f = np.zeros(n)
    for t in range(2, n):
        f[t] = 0.6 * f[t - 1] + 0.2 * f[t - 2] + rng.normal()
    y = np.outer(f, [1.0, -0.7, 0.4]) + rng.normal(0, [0.5, 0.5, 0.8], (n, 3))
    return f, y


def plain_smoother(y, model):
    """Kalman filter and Rauch-Tung-Striebel smoother, period by period."""
    h, f = np.c_[model.loadings, np.zeros(len(model.loadings))], model.step
    m, p, ms, ps, mp, pp = np.zeros(2), np.eye(2), [], [], [], []
    for row in y:
        a, b = f @ m, f @ p @ f.T + S._Q
        k = b @ h.T @ np.linalg.inv(h @ b @ h.T + np.diag(model.noise))
        m, p = a + k @ (row - h @ a), b - k @ h @ b
        ms.append(m), ps.append(p), mp.append(a), pp.append(b)
    out = [ms[-1]]
    for t in range(len(y) - 2, -1, -1):
        g = ps[t] @ f.T @ np.linalg.inv(pp[t + 1])
        out.append(ms[t] + g @ (out[-1] - mp[t + 1]))
    return np.array(ms), np.array(out[::-1])


def test_scans_are_the_filter_and_the_smoother():
    _, y = simulated(97)
    model = S.Model(np.array([1.0, -0.5, 0.3]), np.array([0.4, 0.5, 0.6]), np.array([0.5, 0.2]))
    ms, smooth = plain_smoother(y, model)
    m, p = S.filtered(y, model, S.start())
    assert m == pytest.approx(ms)
    assert S.scan(S.smoothing(m, p, model, True), S.backward, True)[1] == pytest.approx(smooth)


@pytest.mark.parametrize("block", [4096, 64])
def test_factor_is_recovered(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    f, y = simulated()
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)] + [(9999, None, 1.0, 1.0)], "t int, a double, b double, c double").repartition(3)
    factor, model = S.dynamic_factor(frame, "t", ["a", "b", "c"], "a")
    got = factor.toPandas().sort_values("t")
    z = (y - y.mean(0)) / y.std(0, ddof=1)
    assert got["factor"].to_numpy() == pytest.approx(plain_smoother(z, model)[1][:, 0], abs=1e-8)  # whatever the blocks
    assert np.corrcoef(got["factor"], f)[0, 1] > 0.95
    true = np.array([1.0, -0.7, 0.4]) / y.std(0, ddof=1)
    assert model.loadings == pytest.approx(true, abs=0.08) and model.ar == pytest.approx([0.6, 0.2], abs=0.1)
    assert model.noise == pytest.approx((np.array([0.5, 0.5, 0.8]) / y.std(0, ddof=1)) ** 2, abs=0.06)
    rows = S.wave_check(frame, "t", ["a", "b", "c"], "a").collect()
    assert len(rows) == 3 and all(r.r > 0.9 and r.n == 600 for r in rows)


def plain_welch(x, size):
    size = min(size, len(x) // 2)
    w = np.hanning(size + 1)[:-1]
    parts = [x[k : k + size] for k in range(0, len(x) - size + 1, size - size // 2)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 / (w * w).sum() for p in parts], axis=0)
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.arange(len(power)) / size, power, len(parts)


def test_welch_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=700) + 3 * np.sin(2 * np.pi * np.arange(700) / 7), "b": rng.normal(size=101), "c": rng.normal(size=3)}
    frame = spark.createDataFrame([(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("a", 9999, None), ("d", 1, 1.0)], "s string, t int, v double").repartition(4)
    got = Sp.welch(frame, ["s"], "t", "v", 128).toPandas()
    assert set(got["s"]) == {"a", "b"}
    for k in "ab":
        freq, power, parts = plain_welch(series[k], 128)
        mine = got[got["s"] == k].sort_values("frequency")
        assert mine["frequency"].to_numpy() == pytest.approx(freq) and mine["power"].to_numpy() == pytest.approx(power) and (mine["segments"] == parts).all()
    top = got[got["s"] == "a"].sort_values("power").iloc[-1]
    assert abs(top["frequency"] - 1 / 7) < 0.01


def test_phase_surrogates_by_lag(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120).cumsum() * 0.2 + rng.normal(size=120)
    y = np.roll(x, -2) + 0.3 * rng.normal(size=120)  # y at t is x at t + 2
    frame = spark.createDataFrame([("s", t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, x, strict=True))], "k string, t int, y double, x double")
    got = {r.lag: r for r in Sp.lag_scan_against_phases(frame, ["k"], "t", "y", "x", draws=300, block=100).collect()}
    null = np.concatenate([K.surrogates("phase", y, K.rng_of("phases", "s", b), 100) for b in range(3)])
    for lag in range(-3, 4):
        a, b = (y[: 120 - lag], x[lag:]) if lag >= 0 else (y[-lag:], x[:lag])
        r = np.corrcoef(a, b)[0, 1]
        cut = null[:, : 120 - lag] if lag >= 0 else null[:, -lag:]
        beyond = np.array([abs(np.corrcoef(n, b)[0, 1]) >= abs(r) - 1e-9 for n in cut]).sum()
        assert (got[lag].r, got[lag].p, got[lag].n) == pytest.approx((r, (1 + beyond) / 301, 120 - abs(lag)))
    assert got[2].p < 0.01


@pytest.mark.parametrize("name, rows", [("wave_cross_check", 3), ("axes_against_wave_by_lag", 35), ("welch_spectrum", 10)])
def test_registered(spark, name, rows):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    assert len(got) >= rows and not got.isna().any().any()
    if name == "welch_spectrum":
        o = pd.read_parquet(f"{SMALL}/orders.parquet")
        d = o[o["o_orderpriority"].str[0] == "1"].assign(day=pd.to_datetime(o["o_orderdate"]).dt.normalize()).groupby("day")["o_totalprice"].mean().to_numpy()
        assert got[got["axis"] == "1"].sort_values("frequency")["power"].to_numpy() == pytest.approx(plain_welch(d, 256)[1])


def test_shifts_turn_a_series():
    x = np.arange(20.0)
    made = K.surrogates("shift", x, K.rng_of("shift"), 200)
    assert {tuple(m) for m in made} <= {tuple(np.roll(x, k)) for k in range(20)} and len({m[0] for m in made}) > 15


def test_associations_against_shifts(spark):
    from tallyhouse.operators import coupling as C

    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = x**2 + 0.1 * rng.normal(size=60)
    frame = spark.createDataFrame([("s", t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, x, strict=True))], "k string, t int, y double, x double")
    got = C.surrogate_scan(frame, ["k"], ("dcor",), ("shift",), screen=100, refine=100).first()
    assert got.observed == pytest.approx(K.distance_correlation(y, x)) and got.p < 0.05
