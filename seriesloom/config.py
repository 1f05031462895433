"""Governance values, search grids and tolerances, in one frozen bundle."""

from __future__ import annotations

from dataclasses import dataclass, field

# Admission ranges, tolerances and clinical bounds the results depend on.
RANGES = {
    "sbp": (60, 260), "dbp": (30, 160), "weight": (25, 220), "idwg": (-5, 12),
    "age": (18, 110), "temperature": (33, 41), "session_hours": (0.5, 12.0),
}
MIN_PULSE_PRESSURE = 10
MAX_OUT_OF_RANGE = 0.005
LAGS = (1, 2, 3, 5, 7, 14)
WINDOWS = (3, 7, 14, 30)
ALPHAS = (0.1, 0.3)
HORIZONS = (0, 1, 2)
SIGNALS = ("sbp", "dbp")
GAP_FIRST, GAP_LOW, GAP_HIGH = 2.0, 1.0, 30.0
STALE_DAYS = 14


@dataclass(frozen=True)
class Config:
    gap_hours: float = 6.0
    day_start_hour: int = 8
    min_sessions: int = 60
    min_span_days: int = 120
    max_entities: int | None = None
    test_frac: float = 0.2
    val_frac: float = 0.2
    holdout_frac: float = 0.3
    split_salt: str = "patient-split"
    signals: tuple = SIGNALS
    lags: tuple = LAGS
    windows: tuple = WINDOWS
    alphas: tuple = ALPHAS
    horizons: tuple = HORIZONS
    population_threshold: float = 140.0
    cap_tighten: float = 25.0
    cap_loosen: float = 15.0
    emergency_floor: float = 180.0
    warm: int = 48
    shrink_k: float = 30.0
    quantile: float = 0.90
    search_warm: tuple = (24, 36, 48, 72)
    search_k: tuple = (10.0, 30.0, 60.0)
    search_q: tuple = (0.85, 0.90, 0.95)
    cuts: tuple = (20, 32, 48, 72, 100, 140)
    future: int = 30
    event_quantile: float = 0.95
    warn_window: int = 3
    alert_budget_pct: float = 5.0
    budgets: tuple = (1, 2, 5, 10)
    cold_start_min: int = 7
    steady_state: int = 48
    cold_probe: tuple = (3, 7, 10, 25, 48, 60)
    thin_fracs: tuple = (0.0, 0.1, 0.2, 0.3, 0.5)
    draws: int = 200
    confidence_tau: float = 0.55
    fair_margin: float = 1.5
    fair_margin_pp: float = 0.05
    ood_rate_max: float = 0.20
    pair_violation_max: float = 0.0
    cold_penalty_max: float = 4.0
    missing_max: float = 6.0
    ranges: dict = field(default_factory=lambda: dict(RANGES))
