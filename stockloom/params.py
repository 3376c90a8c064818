"""Thresholds and dates that the models read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Detection thresholds, windows and policy constants.

    Dates default to the window that the ERP views over the star-schema tables
    cover; an ERP extract brings its own.
    """

    history_end: str = "2000-12-31"
    #: Item numbers from here on are obsolete records.
    obsolete_from: int = 100_000
    forward_start: str = "2001-01-01"
    as_of_date: str = "2001-06-30"
    dead_lookback_months: int = 24
    stale_lead_gap_days: float = 3
    stale_rop_min_units: float = 5
    stale_rop_min_share: float = 0.30
    duplicate_gap_days: int = 1
    abc_a: float = 0.80
    abc_b: float = 0.95
    adi_cut: float = 1.32
    cv2_cut: float = 0.49
    ses_alpha: float = 0.3
    croston_alpha: float = 0.1
    order_line_cost: float = 35.0
    holding_rate: float = 0.25
    lot_min_days: float = 14.0
    lot_max_days: float = 120.0
    safety_cap: float = 4.0
    hysteresis: float = 0.20
    drift_threshold: float = 0.10
    fresh_count_days: int = 90
    close_count_share: float = 0.05
    chronic_adjustments: int = 3
    chronic_days: int = 365
    phantom_days: int = 90
    remediation_start: str = "2000-10-22"
    remediation_end: str = "2000-12-31"
    reason_code_from: str = "2000-12-04"
    login_from: str = "2000-12-04"
    cost_year: int = 2000
    lead_tolerance_days: float = 3
    cover_days: float = 75.0
    carrying_rate: float = 0.22
    labour_rate: float = 38.0
    work_weeks: int = 50
    soon_days: float = 14.0


#: Normal quantiles for the rule schedule and for recomputed reorder points, by ABC class.
RULE_Z = {"A": 2.05, "B": 1.64, "C": 1.28}
RECOMPUTED_Z = {"A": 2.054, "B": 1.645, "C": 1.282}
SERVICE_LEVEL = {"A": 0.98, "B": 0.95, "C": 0.90}
FILL_TARGET = {"line": 0.99, "service": 0.985, "standard": 0.985}
#: Users that several people share, adjustment reasons that say nothing, and causes that the errors explain.
SHARED_USERS = ("U0", "U1")
VAGUE_REASONS = ("", "nan", "ADJ", "VAR", "MISC")
ERROR_CAUSES = ("stale_lead_time", "unrecorded_consumption", "phantom_on_order")
#: Weekly hours that interviews reported, and whether they go into working around the records.
INTERVIEW_HOURS = {"spreadsheet and reconciliation": (6, True), "expediting": (4, False), "recounts and corrections": (8, True)}
GENERIC_ITEMS = ("NONSTOCK", "MISC", "SHOPSUPPLY")
#: Sign of a posting's effect on stock.
POSTING_SIGN = {"RECEIPT": 1, "RETURN": 1, "ADJUST": 1, "ISSUE": -1, "BACKFLUSH": -1, "SCRAP": -1}
