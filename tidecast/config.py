"""Settings of the planning operators, in one frozen object that callers may replace in part."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

#: The label of a dimension that is summed over, and the labels of rows without a mapping.
ALL = "ALL"
UNMAPPED, UNKNOWN = "UNMAPPED", "UNK"
#: Mappings that hold from the start begin here.
OPEN_START = date(1900, 1, 1)


@dataclass(frozen=True)
class EngineConfig:
    fx_policy: str = "constant"
    fx_base_month: date | None = None
    fuzzy_auto: float = 0.93
    fuzzy_review: float = 0.62
    weight_name: float = 0.55
    weight_vector: float = 0.25
    weight_knn: float = 0.20
    adi_cut: float = 1.32
    cv2_cut: float = 0.49
    seasonality_min: float = 0.70
    acf_min: float = 0.25
    exog_min: float = 0.55
    seasonal_obs: int = 30
    max_deviation_pct: float = 60.0
    requires_approval: bool = False
    champion_tolerance: float = 0.02
    fva_level: float = 0.05
    dq_block: bool = True
    horizon: int = 12
    samples: int = 400
    seed: int = 7
    reconciliation: str = "mint_shrink"


DEFAULT = EngineConfig()
