"""All registered queries of the station-mesh engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlag.plans import daily_series, decay, events, geometry, inference, influence, lags, motion, network, pairs, reports, resampling, shadow, spectra, streams  # noqa: F401
from meshlag.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["decay_fit_by_center"](spark, sf_dir)
