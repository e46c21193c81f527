"""Frozen settings; checked when built, turned into literals inside the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from panelwright.errors import ConfigurationError


@dataclass(frozen=True)
class Band:
    """Entry threshold for newcomers and a lower exit threshold for members."""

    entry: float
    exit: float

    def __post_init__(self) -> None:
        if self.exit > self.entry:
            raise ConfigurationError("exit threshold must not be above entry")


# Screen thresholds per universe type.
@dataclass(frozen=True)
class ScreenConfig:
    market_cap: Band = Band(200_000_000, 150_000_000)
    addv_long: Band = Band(750_000, 500_000)
    addv_short: Band = Band(500_000, 350_000)
    frequency: Band = Band(0.95, 0.90)
    price_us: Band = Band(3.0, 2.0)
    price_europe: Band = Band(2.0, 1.5)
    region: str = "us"
    min_history: int = 252
    min_seasoning: int = 60
    min_annual: int = 3
    min_quarterly: int = 8
    cap_percentile: Band = Band(0.10, 0.075)
    min_exchange_size: int = 10
    window_long: int = 252
    window_short: int = 63

    @classmethod
    def broad(cls) -> "ScreenConfig":
        return cls(
            market_cap=Band(100_000_000, 75_000_000), addv_long=Band(500_000, 350_000),
            addv_short=Band(300_000, 200_000), frequency=Band(0.90, 0.85),
            price_us=Band(2.0, 1.0), price_europe=Band(1.0, 0.5),
            min_history=126, min_seasoning=30, min_annual=2, min_quarterly=4,
        )

    @classmethod
    def small_cap(cls) -> "ScreenConfig":
        return cls(
            market_cap=Band(50_000_000, 35_000_000), addv_long=Band(250_000, 150_000),
            addv_short=Band(150_000, 100_000), frequency=Band(0.90, 0.85),
            price_us=Band(1.0, 0.5), price_europe=Band(0.5, 0.25),
            min_history=126, min_seasoning=30, min_annual=2, min_quarterly=4,
        )


@dataclass(frozen=True)
class CleaningConfig:
    max_abs_return: float = 10.0
    winsor_z: float = 3.0
    remove_z: float = 10.0
    correlation_threshold: float = 0.95
    absolute_correlation: bool = False
    variance_floor: float = 1e-8
    top_k: int | None = None
    pareto: bool = False
    expiry_lookahead_days: int | None = None


@dataclass(frozen=True)
class FactorConfig:
    lookback: int = 252
    skip: int = 21
    volatility_lookback: int = 252
    beta_lookback: int = 252
    amihud_lookback: int = 252
    annual_periods: int = 252
    complete_dates: bool = True
    annual_lag_days: int = 90
    quarterly_lag_days: int = 45
    analyst_lag_days: int = 5
    macro_lag_days: int = 63


# Factor to group, group to tier.
FACTOR_GROUPS = {
    "book_to_price": "value", "earnings_yield": "value", "cash_flow_yield": "value",
    "sales_to_price": "value", "ebitda_to_ev": "value",
    "gross_profitability": "profitability", "roe": "profitability",
    "operating_margin": "profitability", "profit_margin": "profitability",
    "asset_growth": "investment", "momentum_12_1": "momentum", "volatility": "low_risk",
    "beta": "low_risk", "amihud_illiquidity": "liquidity", "dividend_yield": "dividend",
    "recommendation_change": "sentiment", "net_insider_buying": "ownership",
}
CORE_FACTORS = (
    "book_to_price", "earnings_yield", "gross_profitability", "roe", "asset_growth",
    "momentum_12_1", "volatility", "dividend_yield",
)
CORE_GROUPS = ("value", "profitability", "momentum", "low_risk")
GROUPS = (*CORE_GROUPS, "investment", "liquidity", "dividend", "sentiment", "ownership")

# Multiplicative group tilts per macro regime.
REGIME_TILTS = {
    "expansion": {"momentum": 1.2, "value": 0.8, "low_risk": 0.8},
    "slowdown": {"low_risk": 1.3, "dividend": 1.2, "momentum": 0.7},
    "recession": {"low_risk": 1.5, "profitability": 1.3, "momentum": 0.5, "value": 1.2},
    "recovery": {"value": 1.3, "momentum": 1.2, "low_risk": 0.7},
}

# Usual yearly long-short spread per group (low, high).
SPREAD_BANDS = {
    "value": (0.02, 0.06), "profitability": (0.02, 0.05), "investment": (0.01, 0.04),
    "momentum": (0.04, 0.10), "low_risk": (0.01, 0.04), "liquidity": (0.01, 0.03),
    "dividend": (0.01, 0.03), "sentiment": (0.005, 0.02), "ownership": (0.005, 0.02),
}


@dataclass(frozen=True)
class StandardizeConfig:
    method: str = "z_score"
    lower: float = 0.01
    upper: float = 0.99
    neutralize: bool = True
    by_country: bool = False
    restandardize: bool = False

    def __post_init__(self) -> None:
        if self.method not in ("z_score", "rank_normal"):
            raise ConfigurationError(f"unknown method {self.method!r}")
        if not 0.0 <= self.lower < self.upper <= 1.0:
            raise ConfigurationError("need 0 <= lower < upper <= 1")


@dataclass(frozen=True)
class CompositeConfig:
    method: str = "equal_weight"
    core_weight: float = 1.0
    other_weight: float = 0.5
    ic_lookback: int = 36
    ridge_alpha: float = 1.0
    tree_depth: int = 3
    tree_rounds: int = 50

    def tiers(self) -> dict[str, float]:
        return {g: self.core_weight if g in CORE_GROUPS else self.other_weight for g in GROUPS}


@dataclass(frozen=True)
class SelectionConfig:
    method: str = "fixed_count"
    target_count: int = 100
    buffer_fraction: float = 0.1
    target_quantile: float = 0.8
    exit_quantile: float | None = 0.7
    sector_balance: bool = False
    sector_tolerance: float = 0.05


# Business days per calendar rule.
CALENDAR_DAYS = {"monthly": 21, "quarterly": 63, "semiannual": 126, "annual": 252}


@dataclass(frozen=True)
class DriftRule:
    """Threshold rule; the calendar period turns it into the hybrid rule."""

    threshold: float = 0.05
    relative: bool = False
    period_days: int | None = None

    @classmethod
    def every(cls, frequency: str, threshold: float = 0.05, relative: bool = False) -> DriftRule:
        """The hybrid rule of a calendar frequency."""
        if frequency not in CALENDAR_DAYS:
            raise ConfigurationError(f"unknown frequency {frequency!r}")
        return cls(threshold, relative, CALENDAR_DAYS[frequency])


@dataclass(frozen=True)
class LiquidityTier:
    min_dollars: float
    min_shares: float


# Instrument filter thresholds.
@dataclass(frozen=True)
class InstrumentRules:
    min_price: float = 5.0
    max_price: float = 10_000.0
    min_market_cap: float = 100_000_000
    small_cap: float = 2_000_000_000
    large_cap: float = 10_000_000_000
    tiers: dict[str, LiquidityTier] = field(
        default_factory=lambda: {
            "large_cap": LiquidityTier(10_000_000, 500_000),
            "mid_cap": LiquidityTier(5_000_000, 250_000),
            "small_cap": LiquidityTier(1_000_000, 100_000),
        }
    )
    min_history_rows: int = 750
