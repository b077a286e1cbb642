"""Settings of the analysis: time grid, split boundaries, thresholds and weights.

Every operator takes a ``Settings`` value, so the same code runs on the 5-minute production grid and on any coarser grid.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import NamedTuple

# Thresholds, weights and bounds that results depend on.
STATES = (("NORMAL", 0.85), ("MODERATE", 0.70), ("HEAVY", 0.50), ("CRITICAL", 0.0))
SR_MAD_FLOOR = 0.02
FLOW_MAD_FLOOR = 0.05
MAD_TO_SIGMA = 1.4826
Z_WEIGHTS = {"speed": 0.8, "flow": 0.2}
RAIN_EFFECT = 0.3
NETWORK_SHIFT_EFFECT = 0.03
TYPE_MIN_LIKELIHOOD = 0.5
BOTTLENECK_Z = -2.5
RECURRENCE_Z = -1.5
MAX_HOPS = 3
RISK_LEVELS = (("HIGH", 0.5), ("MEDIUM", 0.25), ("LOW", 0.1))
BPR_ALPHA, BPR_BETA = 0.15, 4.0
MIN_CAPACITY_SHARE = 0.1
STATE_CAPACITY_LOSS = {"CRITICAL": 0.5, "HEAVY": 0.33, "MODERATE": 0.2, "NORMAL": 0.0}
SCORE_WEIGHTS = {"network": 2.0, "local": 0.1, "worsened": 0.1, "cost": 1.0}
BAND_PENALTY = {"high": 0.0, "medium": 0.5, "low": 1.5}
CANDIDATE_HOPS = 2
CANDIDATES_TRIED = 6
SERVICE_AREA = {"south": 17.10, "west": 78.10, "north": 17.70, "east": 78.80}
VALUE_COLUMNS = ("speed_kmh", "flow_vph", "occupancy_pct", "delay_min", "queue_length_veh", "congestion_index")
FORECAST_METRICS = {"speed": "speed_kmh", "flow": "flow_vph", "congestion": "congestion_index"}
VARIANTS = ("z_composite", "drop", "drop_epicentre")

# Corridor scoring.
CONGESTION_WEIGHTS = {"utilization": 0.25, "speed_reduction": 0.20, "delay": 0.20, "junction_signal": 0.10, "persistence": 0.10,
                      "current": 0.15}
BOTTLENECK_WEIGHTS = {"utilization": 0.25, "speed_reduction": 0.20, "delay": 0.20, "junction_signal": 0.15, "persistence": 0.15,
                      "throughput_ceiling": 0.15}
BOTTLENECK_LEVELS = (("CRITICAL", 75), ("HIGH", 50), ("MODERATE", 25))
SUITABILITY_WEIGHTS = {"traffic_pressure": 0.20, "junction_bottleneck": 0.20, "delay": 0.15, "capacity_utilization": 0.20,
                       "historical_growth": 0.10, "accident_risk": 0.15}
CONFIDENCE_WEIGHTS = {"coverage": 0.35, "history": 0.20, "freshness": 0.15, "model_validation": 0.15, "field_completeness": 0.15}
STRETCH_M, MAX_STRETCHES, MATCH_RADIUS_M, MATCH_TOLERANCE_M = 300.0, 300, 750.0, 40.0
ZONE = {"gap": 1, "extend": 3, "min_m": 500.0, "max_m": 2000.0, "ramp_m": 150.0, "keep": 3}

# Rider-facing route assessment.
SAMPLE_M, LEVEL_MIN_M, FALLBACK_M = 120.0, 300.0, 1500.0
FREE_FLOW_RATIO, MIN_RATIO, MIN_BASE_KMH = 0.85, 0.25, 5.0
LEVEL_OF_STATE = {"NORMAL": "free_flow", "MODERATE": "moderate", "HEAVY": "heavy", "CRITICAL": "severe", "NO_DATA": "no_data"}
ROUTE_LABELS = ("Recommended route", "Alternative", "Second alternative", "Third alternative")
NEAREST_PER_CATEGORY = 12


class Intervention(NamedTuple):
    """One way to relieve a zone; a capacity gain of None is that of one more lane, at most ``gain_cap``."""

    intervention: str
    fixed_gain: float | None
    gain_cap: float | None
    signal_removal: float
    demand_shift: float
    land_need: float
    base_construction: float
    sensitivity: float
    unit_cost: float


# Interventions compared for a zone.
INTERVENTIONS = (
    Intervention("flyover", fixed_gain=0.35, gain_cap=None, signal_removal=0.80, demand_shift=0.0, land_need=0.35, base_construction=70.0, sensitivity=25.0, unit_cost=120.0),
    Intervention("road_extension", fixed_gain=0.28, gain_cap=None, signal_removal=0.0, demand_shift=0.0, land_need=1.0, base_construction=80.0, sensitivity=15.0, unit_cost=45.0),
    Intervention("road_widening", fixed_gain=None, gain_cap=0.5, signal_removal=0.0, demand_shift=0.0, land_need=0.8, base_construction=78.0, sensitivity=15.0, unit_cost=35.0),
    Intervention("junction_redesign", fixed_gain=0.10, gain_cap=None, signal_removal=0.25, demand_shift=0.0, land_need=0.3, base_construction=85.0, sensitivity=10.0, unit_cost=8.0),
    Intervention("signal_optimization", fixed_gain=0.05, gain_cap=None, signal_removal=0.20, demand_shift=0.0, land_need=0.0, base_construction=95.0, sensitivity=2.0, unit_cost=0.5),
    Intervention("traffic_diversion", fixed_gain=0.0, gain_cap=None, signal_removal=0.0, demand_shift=0.10, land_need=0.0, base_construction=90.0, sensitivity=0.0, unit_cost=1.0),
)
SAVING_TOLERANCE_VEH_H = 0.1  # a saving below this is within the noise of the figures
EXTENSION_LENGTH_FACTOR, MAX_JUNCTIONS, STRUCTURE_COST_SHARE = 0.7, 6, 0.01
INTERVENTION_WEIGHTS = {"traffic_impact": 0.35, "land_feasibility": 0.20, "construction_feasibility": 0.15, "cost_efficiency": 0.15,
                        "long_term_impact": 0.15}
MIN_OVERALL, MIN_TRAFFIC_IMPACT = 45, 5
DEMAND_GROWTH, EMISSION_ELASTICITY, MAX_SIGNAL_SHARE, MAX_UTILIZATION = 0.20, 0.5, 0.5, 1.5
ZONE_CONFIDENCE_WEIGHTS = {"traffic": 0.35, "road_network": 0.20, "land": 0.25, "infrastructure": 0.20}
LAND_CONFIDENCE, INFRASTRUCTURE_CONFIDENCE = 65, 60


@dataclass(frozen=True)
class Settings:
    """Everything that depends on the time grid or on the data at hand."""

    # the span of the data and its splits: always given, never guessed
    start: str
    end: str
    fit_end: str
    calib_start: str
    train_end: str
    val_start: str
    val_end: str
    step_minutes: int = 5
    slots_per_day: int = 288
    horizons: dict = field(default_factory=lambda: {15: 3, 30: 6, 45: 9, 60: 12})
    peak_hours: tuple = (7, 8, 9, 16, 17, 18, 19)
    offpeak_hours: tuple = (10, 11, 12, 13, 14, 15)
    lags: tuple = (1, 3, 6, 12)
    means: tuple = (3, 6, 12)
    slope: int = 3
    fill_slots: int = 3
    quality_slots: int = 12
    history_slots: int = 300
    recent_slots: int = 36
    forecast_history_slots: int = 25
    issue_delay_minutes: int = 10
    growth_days: int = 5
    full_confidence_days: int = 14
    variant: str = "drop_epicentre"
    threshold: float = 0.2  # fitted by the threshold sweep of the data at hand
    fit_every: int = 3
    band_min_rows: int = 50

    @property
    def step_seconds(self) -> int:
        return self.step_minutes * 60

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


# A six-hour grid over thirty days, for data that is too sparse for five-minute slots.
SIX_HOURLY = Settings(
    step_minutes=360, slots_per_day=4,
    start="2024-01-01 00:00:00", fit_end="2024-01-19 18:00:00", calib_start="2024-01-20 00:00:00", train_end="2024-01-24 18:00:00",
    val_start="2024-01-25 00:00:00", val_end="2024-01-30 18:00:00", end="2024-01-30 18:00:00",
    horizons={360: 1, 720: 2, 1080: 3}, peak_hours=(6, 18), offpeak_hours=(0, 12),
    issue_delay_minutes=0, threshold=0.2, history_slots=8, recent_slots=6,
)
