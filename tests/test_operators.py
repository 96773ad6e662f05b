"""Properties and hand-computed cases that SQL doesn't cover."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.config import Config
from tidewright.functions.columns import normalized, by_date, vix_regime, vol_regime_label
from tidewright.operators import correlation, engine, hmm, metrics, regime, report, riskopt, runner, signals, strategies
from tidewright.sources import bars
from tidewright.streaming.bars import bars_of_stream


@pytest.fixture(scope="module")
def data(spark):
    raw, assets, vix = bars.synthetic_bars(spark, 700)
    return bars.build_panel(raw, assets).persist(), raw, assets, vix.persist()


PANELS = {
    "momentum": signals.momentum_score, "obv": signals.obv, "flow": signals.money_flow, "vol": signals.realized_vol, "atr": lambda p: signals.atr(p).drop("close"),
    "strength": signals.relative_strength, "drawdown": signals.drawdown, "trend": signals.volume_trend, "corr": lambda p: correlation.rolling_avg_correlation(p, 40),
}


@pytest.mark.parametrize("name", PANELS)
def test_no_look_ahead(data, name):
    panel, raw, assets, _ = data
    cut = "2016-11-30"
    whole = PANELS[name](panel).filter(F.col("date") <= cut).toPandas()
    short = PANELS[name](bars.build_panel(raw, assets, end=cut)).toPandas()
    both = whole.merge(short, on=["date", "ticker"], suffixes=("_a", "_b"))
    assert len(both) == len(whole) == len(short)
    assert np.allclose(both.value_a.astype(float), both.value_b.astype(float), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_weights_and_paths(data):
    panel, _, _, vix = data
    labels = regime.classify(regime.risk_score(panel, vix, ["T0", "T4"], ["T1"]))
    given_ = {"regime_based": {"regimes": labels, "on": {"equity": 0.6, "abroad": 0.3}, "off": {"bonds": 0.5, "cash": 0.5}}, "bench_6040": {"equity": "T0", "bonds": "T1"}, "bench_bh": {"ticker": "T0"}}
    trials = {n: runner.by_name(panel, n, **given_.get(n, {})) for n in strategies.parse_strategies(None)}
    dates = bars.period_last(panel, "monthly")
    for name, make in trials.items():
        w = make(dates).toPandas()
        assert len(w) and (w.w > 0).all() and (w.groupby("date").w.sum() <= 1 + 1e-6).all(), name
        assert "T7" not in set(w.ticker)
    paths = runner.suite(panel, trials, ("monthly", "signal")).toPandas()
    assert (paths.equity > 0).all() and (paths.cash >= -1e-6).all() and len(paths.groupby(["strategy", "freq"])) == 2 * len(trials)
    with pytest.raises(KeyError):
        strategies.parse_strategies("nothing")


def test_one_trade_costs_what_it_should():
    h, cash, turnover = engine.trade(np.zeros(2), 100_000.0, np.array([0.5, 0.5]), 0.0015)
    assert h.sum() == pytest.approx(99_850.0) and cash == pytest.approx(0.225) and turnover == pytest.approx(0.9985)
    out = engine.fold(np.array([[0.0, 0.0], [0.1, 0.0], [0.0, 0.1]]), {0: np.array([1.0, 0.0]), 2: np.array([0.0, 0.0])}, 100.0, 0.0)
    assert out.equity.tolist() == pytest.approx([100, 110, 110]) and out.rebalanced.tolist() == [True, False, True] and out.period_return.iloc[2] == pytest.approx(0.1)
    late = engine.fold(np.full((8, 1), 0.001), {0: np.array([1.0]), 2: np.array([1.0]), 6: np.array([0.0])}, 1.0, 0.0, gated=True)
    assert late.rebalanced.tolist() == [True, False, False, False, False, False, True, False]


def test_optimisers():
    rng = np.random.default_rng(0)
    for _ in range(20):
        block = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
        cov = riskopt.shrunk_cov(block)
        w = riskopt.min_variance(cov)
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()
        for _ in range(200):
            other = rng.dirichlet(np.ones(6))
            assert w @ cov @ w <= other @ cov @ other + 1e-12
        floor = riskopt.min_variance(cov, 0.05)
        assert floor.min() >= 0.05 - 1e-9 and floor.sum() == pytest.approx(1)
        e = riskopt.equal_risk(cov)
        share = e * (cov @ e)
        assert share.max() / share.min() == pytest.approx(1, abs=1e-6)


def test_hidden_markov_model_recovers_two_regimes():
    rng = np.random.default_rng(1)
    state = (np.arange(900) // 150) % 2
    x = rng.normal(size=(900, 2)) * np.where(state, 0.4, 1.0)[:, None] + np.where(state, 1.5, -1.5)[:, None]
    p = hmm.fit(x, 2)
    probability = hmm.forward_filter(x, p)
    assert np.allclose(probability.sum(axis=1), 1)
    up = int(np.argmax(p.means[:, 0]))
    assert np.mean((probability.argmax(axis=1) == up) == (state == 1)) > 0.95
    assert np.allclose(hmm.forward_filter(x[:500], p), probability[:500])
    assert sorted(hmm.state_labels(p)) == ["risk_off", "risk_on"]


def test_hmm_labels_do_not_change_with_more_history(data):
    panel, _, _, vix = data
    features = regime.market_features(panel, vix, ["T0", "T1", "T2", "T4"]).persist()
    args = {"first": 200, "refit": 100, "burn": 50, "counts": (2,)}
    whole = hmm.classify_hmm(features, **args).toPandas().set_index("date")
    cut = datetime.date(2017, 3, 1)
    short = hmm.classify_hmm(features.filter(F.col("date") <= cut), **args).toPandas().set_index("date")
    assert set(whole.regime) <= {"risk_on", "risk_off", "neutral"} and len(set(whole.regime)) > 1
    assert (whole.loc[short.index].regime == short.regime).all()
    assert set(hmm.classify_hmm(features, first=5000).toPandas().regime) == {"neutral"}


def test_edge_rules(spark):
    rows = [(datetime.date(2020, 1, d), "a", p) for d, p in ((1, None), (2, 10.0), (3, 11.0), (4, 0.0), (5, 12.0))]
    panel = spark.createDataFrame(rows, "date date, ticker string, px double")
    assert [None if r.value is None else round(r.value, 6) for r in signals.total_return(panel, 1).orderBy("date").collect()] == [None, None, 0.1, -1.0, None]
    legs = [r.value for r in signals.momentum_score(panel, {1: 1.0, 3: 1.0}).orderBy("date").collect()]
    assert legs[0] is None and legs[2] == pytest.approx(0.05) and legs[4] == pytest.approx(0.1)
    level = spark.createDataFrame([(14.0,), (15.0,), (35.0,), (None,)], "v double")
    assert [tuple(r) for r in level.select(vix_regime(F.col("v")), vol_regime_label(F.col("v"))).collect()] == [("low", "low"), ("normal", "normal"), ("extreme", "extreme"), (None, "normal")]
    w = spark.createDataFrame([("d", 0.5), ("d", 1.5), ("d", -1.0), ("e", 0.3)], "date string, w double").withColumn("n", normalized(F.col("w"), by_date()))
    assert sorted((r.n or 0) for r in w.collect()) == pytest.approx([0, 0.25, 0.3, 0.75])


def test_flat_series_has_no_correlation(spark):
    rows = [(datetime.date(2020, 1, d), t, 0.0 if t == "a" else d * 0.01) for d in range(1, 9) for t in ("a", "b")]
    panel = spark.createDataFrame(rows, "date date, ticker string, ret double")
    assert {(r.ticker_a, r.ticker_b): r.c for r in correlation.correlation_matrix(panel).collect()} == {("a", "b"): None, ("b", "a"): None, ("a", "a"): None, ("b", "b"): 1.0}
    assert [r.value for r in correlation.rolling_avg_correlation(panel, 3).collect()] == [None] * 16


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(1, 8), st.integers(0, 4))
def test_walk_forward(n, folds, embargo):
    out = metrics.walk_forward(n, folds, 0.5, embargo)
    assert out == [] if n < 10 else True
    for (train, test), after in zip(out, [*out[1:], None]):
        assert train.start == 0 and len(train) and train.stop + embargo == test.start and len(test)
        if after:
            assert test.stop <= after[1].start and len(after[0]) > len(train)


def test_append_status_and_sinks(spark, data, tmp_path):
    panel, raw, assets, vix = data
    folder = str(tmp_path / "bars")
    raw.filter("ticker != 'T1'").write.partitionBy("ticker").parquet(folder)
    new = bars.append_bars(bars.read_bars(spark, folder), raw)
    assert {r.ticker for r in bars.update_report(new).collect()} == {"T1"}
    assert bars.read_bars(spark, folder, ["T0"]).select("ticker").distinct().count() == 1
    status = {r.ticker: r.obs for r in bars.data_status(assets, bars.read_bars(spark, folder)).collect()}
    assert status["T1"] == 0 and status["T0"] == 700
    paths = runner.suite(panel, {"bench_equal": runner.by_name(panel, "bench_equal")}).persist()
    table = runner.measured(paths).persist()
    report.export(table, paths, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/equity"), header=True).count() == paths.count()
    text = report.markdown_report(table, {"Rotation": regime.category_rotation(panel)}, "now")
    assert "## Rotation" in text and text == report.markdown_report(table, {"Rotation": regime.category_rotation(panel)}, "now")
    assert report.equity_frame(paths, "weekly").count() == paths.count()


def test_config(tmp_path):
    (tmp_path / "assets.yaml").write_text("assets:\n- {ticker: A, category: x}\n- {ticker: B, category: y, tradable: false}\nroles: {risk_on: [A, Z], vix: B}\n")
    (tmp_path / "backtest.yaml").write_text("costs: {commission: 0.001, slippage: 0.0005}\n")
    c = Config.load(str(tmp_path))
    assert (c.tickers, c.tradable_tickers, c.role("risk_on"), c.role("vix"), c.tradable_in_category("y")) == (["A", "B"], ["A"], ["A"], ["B"], [])
    assert c.cost == pytest.approx(0.0015)


def test_stream(spark, tmp_path):
    times = pd.date_range("2024-01-01", periods=300, freq="17min")
    spark.createDataFrame([("a" if i % 3 else "b", t.to_pydatetime(), float(i)) for i, t in enumerate(times)], "event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("event_type string, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    q = bars_of_stream(ticks).writeStream.format("memory").queryName("bars_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ticker, r.start.date()): (r.open, r.close, r.volume) for r in spark.sql("select * from bars_out").collect()}
    own = [(i, t) for i, t in enumerate(times) if i % 3 == 0 and t.date() == times[0].date()]
    assert got["b", times[0].date()] == (float(own[0][0]), float(own[-1][0]), len(own)) and not math.isnan(got["b", times[0].date()][0])


def loop_trade(holdings, value, weights, cost):
    """The cost rule, step by step on plain lists."""
    desired = [w * value for w in weights]
    fee = cost * sum(abs(d - h) for d, h in zip(desired, holdings))
    cash, steps = value - sum(desired) - fee, 0
    while steps < 8 and cash < -1e-9 and sum(desired) > 0:
        scale = max(value - fee, 0.0) / sum(desired)
        desired = [d * scale for d in desired]
        fee = cost * sum(abs(d - h) for d, h in zip(desired, holdings))
        cash, steps = value - sum(desired) - fee, steps + 1
    return desired, cash


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=6), st.floats(0, 500), st.floats(0.9, 1.0), st.floats(0, 0.02), st.integers(0, 9))
def test_costs_follow_the_loop(holdings, cash, total, cost, seed):
    h = np.array(holdings)
    if h.sum() + cash <= 1:
        return
    w = np.random.default_rng(seed).dirichlet(np.ones(len(h))) * total
    got, left, _ = engine.trade(h, cash, w, cost)
    desired, want = loop_trade(holdings, float(h.sum() + cash), w.tolist(), cost)
    assert got.tolist() == pytest.approx(desired, rel=1e-9, abs=1e-9) and left == pytest.approx(want, abs=1e-6)


def config(**more):
    assets = [{"ticker": f"T{i}", "name": f"name {i}", "category": ["equity", "bonds", "metals", "abroad"][i % 4], "tradable": i != 7} for i in range(8)]
    strategy = {
        "momentum": {"lookback_weights": {126: 1.0}, "skip_recent_days": 5},
        "strategies": {
            "topn": {"n": 2, "lookback_weights": {63: 1.0}, "absolute_filter": False},
            "momentum_score": {"n": 3, "weights": {"momentum": 1.0}, "corr_lookback": 40, "vol_lookback": 20},
            "regime_based": {"risk_on": {"equity": 0.6}, "risk_off": {"bonds": 0.5}},
            "regime_budget": {"base": "topn", "base_params": {"n": 1}, "mode": "continuous", "budgets": {"risk_on": 0.9}},
        },
        "benchmarks": {"sixty_forty": {"T0": 0.6, "T1": 0.4}, "buy_hold": {"T0": 1.0}},
    }
    backtest = {"backtest": {"initial_capital": 5000, "benchmark": "T0"}, "costs": {"commission": 0.001}, "rebalance": {"frequencies": ["monthly"]}, **more}
    return Config(assets, {"risk_on": ["T0", "T4"], "risk_off": ["T1"], "vix": "T7"}, strategy, backtest)


def test_configured_suite(data):
    panel, _, _, vix = data
    c = config()
    assert c.strategy_args("topn") == {"n": 2, "weights": {63: 1.0}, "absolute": False, "skip": 5}
    setup = runner.Setup(panel, c, ["topn", "momentum_score", "regime_based", "regime_budget", "bench_6040", "bench_equal", "bench_bh"], vix)
    assert setup.warm == 252
    setup.trials["broken"] = lambda dates: dates.select("nothing")
    paths, errors = setup.run()
    got = paths.toPandas()
    assert [(r.strategy, r.freq) for r in errors.collect()] == [("broken", "monthly")]
    assert set(got.strategy) == {"topn", "momentum_score", "regime_based", "regime_budget", "bench_6040", "bench_equal", "bench_bh"}
    start = engine.common_start(panel, 252).first()[0]
    firsts = got.groupby("strategy").date.min()
    assert firsts.nunique() == 1 and firsts.iloc[0] >= start and firsts.iloc[0] == bars.period_last(panel.filter(F.col("date") >= str(start)), "monthly").agg(F.min("date")).first()[0]
    assert got[got.date == firsts.iloc[0]].equity.between(4900, 5000).all()
    assert {"alpha", "beta", "n_rebalances"} <= set(setup.measured(paths).columns)
    both, chosen = setup.out_of_sample((0.5, 0.25, 0.25), "calmar")
    assert both.filter("valid_sharpe IS NOT NULL").count() == 7 and chosen.filter("selected").count() == 1
    late = setup.run(window=("2017-06-01", "2017-08-31"))[0].agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    assert str(late.a) >= "2017-06-01" and str(late.b) <= "2017-08-31"


def test_overlay_in_a_run(data):
    panel, _, _, vix = data
    plain = runner.Setup(panel, config(), ["bench_bh"], vix)
    capped = runner.Setup(panel, config(risk_overlay={"enabled": True, "max_single_weight": 0.1}), ["bench_bh"], vix)
    spiked = runner.Setup(panel, config(risk_overlay={"enabled": True, "corr_spike": {"enabled": True, "window": 20, "threshold": -2.0, "override_budget": 0.25}}), ["bench_bh"], vix)
    dates = bars.period_last(panel, "monthly").filter("date > '2016-01-01'")
    weights = [sorted({round(r.w, 9) for r in s.trials["bench_bh"](dates).collect()}) for s in (plain, capped, spiked)]
    assert weights == [[1.0], [0.1], [0.25]]
    cash = [s.run()[0].filter("rebalanced").agg(F.min("cash")).first()[0] for s in (plain, capped)]
    assert cash[0] < 0.01 and cash[1] > 0.89


def test_walk_forward_plan_follows_the_ranges(spark):
    for n in (9, 10, 25, 60, 253):
        calendar = spark.range(n).selectExpr("date_add(DATE'2020-01-01', cast(2 * id AS int)) AS date")
        day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=2 * i)
        for folds, embargo in ((5, 1), (3, 0)):
            want = [(day(train.stop - 1), day(test.start), day(test.stop - 1)) for train, test in metrics.walk_forward(n, folds, 0.5, embargo)]
            got = metrics.walk_forward_plan(calendar, folds, 0.5, embargo).orderBy("fold").collect()
            assert [(r.train_end, r.test_start, r.test_end) for r in got] == want
    sizes = {r.split: r["rows"] for r in metrics.split_summary(metrics.chronological_split(spark.range(8).selectExpr("date_add(DATE'2020-01-01', cast(id AS int)) AS date"))).collect()}
    assert sizes == {"train": 4, "valid": 1, "test": 3}


def test_budget_without_a_score_is_the_middle_one(spark):
    day = datetime.date(2020, 1, 1)
    base = spark.createDataFrame([(day, "a", 0.5)], "date date, ticker string, w double")
    regimes = spark.createDataFrame([(day, None, None)], "date date, regime string, score double")
    assert [r.w for discrete in (True, False) for r in strategies.budgeted(base, regimes, discrete).collect()] == [0.3, 0.3]


def test_sleeve_leaves_one_category_out(data):
    panel = data[0]
    assert regime.market_sleeve(panel, ["T0", "T1", "T9"]) == ["T0", "T1"]
    assert regime.market_sleeve(panel, ["T0", "T3"], "abroad") == ["T0", "T1", "T2", "T4", "T5", "T6"]


def test_sweep_and_its_means(data):
    panel = data[0]
    blends = {"fast": ({21: 1.0}, 0), "slow": ({126: 0.5, 63: 0.5}, 5)}
    dates = bars.period_last(panel, "monthly").filter("date > '2016-06-01'")
    every = {(r.n, r.lookback, r.filt, r.date, r.ticker): r.w for r in runner.sweep_weights(panel, dates, (1, 3), blends).collect()}
    for n in (1, 3):
        for name, (w, skip) in blends.items():
            for filt in (True, False):
                own = {(n, name, "on" if filt else "off", r.date, r.ticker): r.w for r in strategies.topn(panel, dates, n, w, skip, filt).collect()}
                assert own == {k: v for k, v in every.items() if k[:3] == (n, name, "on" if filt else "off")}
    table = runner.sweep(panel, (1, 3), blends).persist()
    assert table.count() == 8 and table.filter("full_sharpe IS NULL OR valid_sharpe IS NULL OR test_sharpe IS NULL OR dsr IS NULL").count() == 0
    assert runner.marginal_means(table).count() == 2 + 2 + 2


def test_report_and_command_line(data, tmp_path, monkeypatch):
    import yaml

    from tidewright import cli

    panel, raw, _, vix = data
    c = config()
    folder, stored = tmp_path / "config", str(tmp_path / "bars")
    folder.mkdir()
    for name, content in (("assets", {"assets": c.assets, "roles": c.roles}), ("strategy", c.strategy), ("backtest", c.backtest)):
        (folder / f"{name}.yaml").write_text(yaml.safe_dump(content))
    raw.write.partitionBy("ticker").parquet(stored)
    run = lambda *a: cli.main(["--config", str(folder), "--bars", stored, *a])
    assert run("analyze", "all", "--window", "60", "--lookback", "21", "--top", "2") == 0
    assert run("backtest", "report", "--strategy", "topn,bench_equal", "--out", str(tmp_path / "out")) == 0
    text = (tmp_path / "out/REPORT.md").read_text()
    for part in ("## Overview", "1b.", "## 2.", "## 4.", "### Momentum", "### Principal", "## 6."):
        assert part in text
    assert "failed:" not in text
    assert run("backtest", "oos", "--strategy", "bench_bh,bench_equal", "--select", "calmar", "--train", "0.5", "--valid", "0.25", "--test", "0.25") == 0
    assert run("chart", "regime", "--strategy", "bench_bh", "--rebalance", "monthly", "--out", str(tmp_path / "out")) == 0
    assert (tmp_path / "out/regime").exists() and (tmp_path / "out/monthly").exists()
