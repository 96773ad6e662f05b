"""Parameters: YAML files as dimension tables and keyword arguments."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Keys of a strategy's YAML block and the arguments that they set.
ARGUMENTS = {
    "topn": {"n": "n", "lookback_weights": "weights", "absolute_filter": "absolute", "min_assets": "min_assets", "skip": "skip"},
    "risk_parity": {"method": "method", "vol_lookback": "rows", "absolute_filter": "momentum", "momentum_lookback": "momentum_rows", "shrinkage": "shrinkage"},
    "momentum_score": {"n": "n", "weights": "weights", "vol_lookback": "vol_rows", "corr_lookback": "corr_rows", "volume_lookback": "volume_rows", "absolute_filter": "absolute", "momentum": "momentum", "skip": "skip"},
    "min_variance": {"cov_window": "rows", "min_weight": "floor", "shrinkage": "shrinkage", "absolute_filter": "momentum", "momentum_lookback": "momentum_rows"},
    "regime_based": {"risk_on": "on", "risk_off": "off"},
    "regime_budget": {"base": "base", "base_params": "base_params", "regime_source": "source", "mode": "discrete", "budgets": "budgets", "min_budget": "least"},
    "bench_6040": {"shares": "shares"},
    "bench_bh": {"shares": "shares"},
    "bench_equal": {"shares": "members"},
}
BENCHMARK_BLOCKS = {"bench_6040": "sixty_forty", "bench_bh": "buy_hold", "bench_equal": "equal_weight"}
SCORE_PARTS = ("momentum", "volume", "volatility", "correlation")


class Config:
    """What the YAML files of one folder say; ``assets`` are rows of ticker, name, category and tradable in order."""

    def __init__(self, assets: list[dict] | None = None, roles: dict | None = None, strategy: dict | None = None, backtest: dict | None = None, root: Path = Path(".")):
        self.assets, self.roles, self.strategy, self.backtest, self.root = assets or [], roles or {}, strategy or {}, backtest or {}, root

    @classmethod
    def load(cls, folder: str) -> Config:
        import yaml

        files = {p.stem: yaml.safe_load(p.read_text()) or {} for p in Path(folder).glob("*.yaml")}
        universe = files.get("assets", {})
        return cls(universe.get("assets"), universe.get("roles"), files.get("strategy"), files.get("backtest"), Path(folder).resolve().parent)

    def pick(self, **where) -> list[str]:
        """Tickers of the assets whose attributes have these values."""
        return [a["ticker"] for a in self.assets if all(a.get(k, k == "tradable") == v for k, v in where.items())]

    tickers = property(lambda self: self.pick())
    tradable_tickers = property(lambda self: self.pick(tradable=True))

    def tradable_in_category(self, category: str) -> list[str]:
        return self.pick(category=category, tradable=True)

    def role(self, name: str) -> list[str]:
        """Tickers of a role; those that are not in the universe are passed over."""
        found = self.roles.get(name, [])
        known = set(self.pick())
        return [t for t in ([found] if isinstance(found, str) else found) if t in known]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``ticker, category, pos, tradable``, the dimension that panels are built on."""
        return spark.createDataFrame([(a["ticker"], a["category"], i, bool(a.get("tradable", True))) for i, a in enumerate(self.assets)], "ticker string, category string, pos int, tradable boolean")

    def names_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a["ticker"], a.get("name", a["ticker"])) for a in self.assets], "ticker string, name string")

    def strategy_args(self, name: str, over: dict | None = None) -> dict:
        """Keyword arguments of a strategy: its block, overridden key by key by ``over``."""
        momentum = self.strategy.get("momentum", {})
        if name in BENCHMARK_BLOCKS:
            block = {"shares": self.strategy.get("benchmarks", {}).get(BENCHMARK_BLOCKS[name])}
        else:
            block = {**self.strategy.get("strategies", {}).get(name, {}), **(over or {})}
        if name in ("topn", "momentum_score"):
            block.setdefault("skip", int(momentum.get("skip_recent_days", 0) or 0))
        if name == "topn":
            block.setdefault("lookback_weights", momentum.get("lookback_weights"))
        if name == "momentum_score":
            block.setdefault("momentum", momentum.get("lookback_weights"))
        out = {argument: block[key] for key, argument in ARGUMENTS.get(name, {}).items() if block.get(key) is not None}
        if name == "momentum_score" and "weights" in out:
            out["weights"] = tuple(float(out["weights"].get(part, 0.0)) for part in SCORE_PARTS)
        if name == "regime_budget":
            out["discrete"] = str(out.get("discrete", "discrete")).lower() != "continuous"
            budgets = out.get("budgets", {})
            out["budgets"] = tuple(float(budgets.get(label, usual)) for label, usual in (("risk_on", 1.0), ("neutral", 0.6), ("risk_off", 0.3)))
        if name == "bench_equal" and "members" in out:
            out["members"] = tuple(out["members"])
        if name in ("bench_6040", "bench_bh") and not out.get("shares"):
            equity, bonds = ((self.role(r) or [None])[0] for r in ("equity_benchmark", "risk_off"))
            out = {"equity": equity, "bonds": bonds} if name == "bench_6040" else {"ticker": equity or next(iter(self.tradable_tickers), None)}
        return out

    @property
    def cost(self) -> float:
        costs = self.backtest.get("costs", {})
        return sum(costs.values()) if costs else 0.0015

    def setting(self, key: str, usual):
        found = self.backtest.get("backtest", {}).get(key)
        return usual if found is None else found

    capital = property(lambda self: float(self.setting("initial_capital", 100_000.0)))
    risk_free = property(lambda self: float(self.setting("risk_free_rate", 0.02)))
    frequencies = property(lambda self: tuple(self.backtest.get("rebalance", {}).get("frequencies", ("monthly",))))

    @property
    def benchmark(self) -> str | None:
        return self.setting("benchmark", (self.role("equity_benchmark") or [None])[0])

    def path(self, name: str) -> Path:
        return self.root / self.backtest.get("data", {}).get(name, name)
