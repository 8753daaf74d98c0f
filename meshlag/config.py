"""Thresholds of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    bins: int = 40
    least_km: float = 50.0
    most_km: float = 13_000.0
    min_bin_count: int = 50
    min_epochs: int = 20
    band_low_hz: float = 1e-5
    band_high_hz: float = 5e-4
    segment: int = 1024
    monthly_folds: int = 5
    station_block: int = 10
    bootstrap: int = 1000
    bootstrap_block: int = 10
    pair_replicates: int = 1000
    two_way_replicates: int = 200
    null_iterations: int = 100
    surrogates: int = 100
    shifts: int = 2000
    spectral_replicates: int = 200
    spectral_block: int = 28
    least_train: int = 10_000
    least_held: int = 1_000
    activity_kp: float = 4.0
    activity_ap: float = 20.0
    activity_f107: float = 200.0


DEFAULT = Config()
EARTH_KM = 6371.0088
EARTH_KM_ROUND = 6371.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
