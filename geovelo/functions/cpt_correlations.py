"""Shear-wave velocity from cone soundings: published correlations as columns.

Inputs: depth m; qc, fs, qt and effective stress in MPa; Ic and Qtn dimensionless. Each entry gives (vs m/s, sd of ln vs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ATMOSPHERE = 0.1
Pair = tuple[Column, Column]


def _floor(x: Column) -> Column:
    return F.when(x <= 0, 1e-4).otherwise(x)


def _andrus(scale: float, by_qt: float, by_ic: float, by_depth: float, spread: float) -> Callable[[], Pair]:
    def vs() -> Pair:
        v = F.lit(scale) * F.pow(_floor(F.col("qt")) * 1000, F.lit(by_qt)) * F.pow("depth", F.lit(by_depth))
        v = v * F.pow("ic", F.lit(by_ic)) if by_ic else v
        return v, F.when(v == 0, 0.0).otherwise(F.log(F.lit(spread) / F.nullif(v, F.lit(0.0)) + 1))

    return vs


def _power(scale: float, by_qc: float, by_fs: float, by_depth: float) -> Column:
    return F.lit(scale) * F.pow(F.col("qc") * 1000, F.lit(by_qc)) * F.pow(F.col("fs") * 1000, F.lit(by_fs)) * F.pow("depth", F.lit(by_depth))


def _mcgann_2015() -> Pair:
    d = F.col("depth")
    return _power(18.4, 0.144, 0.083, 0.278), F.when(d <= 5, 0.162).when(d < 10, 0.216 - 0.0108 * d).otherwise(0.108)


def _robertson_2009() -> Pair:
    stress = F.pow(F.col("eff_stress") / ATMOSPHERE, F.lit(0.25))
    return F.sqrt(F.pow(F.lit(10.0), 0.55 * F.col("ic") + 1.68) * _floor(F.col("qtn"))) * stress, F.lit(0.2)


def _hegazy_2006() -> Pair:
    stress = F.pow(F.col("eff_stress") / ATMOSPHERE, F.lit(0.25))
    return 0.0831 * _floor(F.col("qtn")) * stress * F.exp(1.786 * F.col("ic")), F.lit(0.2)


#: name -> (columns, whether it needs the soil parameters of the fixed-point solve)
CPT_CORRELATIONS: dict[str, tuple[Callable[[], Pair], bool]] = {
    "mcgann_2015": (_mcgann_2015, False),
    "mcgann_2018": (lambda: (_power(103.6, 0.0074, 0.130, 0.253), F.lit(0.2367)), False),
    "andrus_2007_holocene": (_andrus(2.27, 0.412, 0.989, 0.033, 22.0), True),
    "andrus_2007_pleistocene": (_andrus(2.62 * 1.12, 0.395, 0.912, 0.124, 45.0), True),
    "andrus_2007_tertiary_age_cooper_marl": (_andrus(13.0, 0.382, 0.0, 0.099, 67.0), False),
    "robertson_2009": (_robertson_2009, True),
    "hegazy_2006": (_hegazy_2006, True),
}
