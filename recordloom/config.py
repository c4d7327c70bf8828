"""Study parameters. Values equal the reference's."""

from __future__ import annotations

from dataclasses import dataclass

# The nine metrics of a stay, in report order.
METRICS = (
    "n_records",
    "t_first_h",
    "median_interval_min",
    "iqr_interval_min",
    "max_interval_min",
    "n_gaps_gt30m",
    "n_gaps_gt2h",
    "n_gaps_gt4h",
    "frac_time_in_gaps",
)


@dataclass(frozen=True)
class Config:
    """Defaults: a 24 h window in minutes, three records, gaps over 30, 120 and 240 minutes; buckets of event stores."""

    window_min: int = 1440
    min_records: int = 3
    gap_min: tuple[int, int, int] = (30, 120, 240)
    percentiles: tuple[int, ...] = (5, 10, 20)
    min_hospital: int = 500
    min_cell: int = 50
    bootstraps: int = 500
    pctile_bootstraps: int = 200
    seed: int = 17
    buckets: int = 16


DEFAULT = Config()
