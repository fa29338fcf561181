"""Shear-wave velocity from standard penetration tests, and the factors that turn N into N60."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WATER_TABLE, DRIVEN = 2.0, 0.3048
HAMMERS, SOILS = ("Auto", "Safety", "Standard"), ("Clay", "Silt", "Sand", "Gravel")

# Fixed values by soil: b0, b1, b2, tau; unit weight dry, saturated; spread a, c, floor. None is clay and any other soil.
SPT_CORRELATIONS = {
    "brandenberg_2010": {
        "Sand": (4.045, 0.096, 0.236, 0.217, 18, 20, 0.57, 0.07, 0.20),
        "Silt": (3.783, 0.178, 0.231, 0.227, 17, 19, 0.31, 0.03, 0.15),
        None: (3.996, 0.230, 0.164, 0.227, 16, 18, 0.21, 0.01, 0.16),
    },
    "kwak_2015": {
        "Sand": (3.913, 0.167, 0.216, 0.217, 18, 20, 0.57, 0.07, 0.20),
        "Silt": (3.879, 0.255, 0.168, 0.227, 17, 19, 0.31, 0.03, 0.15),
        "Gravel": (3.840, 0.154, 0.285, 0.369, 19, 21, 0.31, 0.03, 0.15),
        None: (4.119, 0.209, 0.165, 0.227, 16, 18, 0.21, 0.01, 0.16),
    },
}


def energy_factor(ratio: Column, hammer: Column) -> Column:
    by_hammer = F.when(hammer == "Safety", 0.7).when(hammer == "Standard", 0.5).otherwise(0.8)
    return F.when(ratio.isNotNull(), ratio / 60).otherwise(by_hammer)


def rod_factor(length: Column) -> Column:
    return F.when(length < 3, 0.75).when(length < 4, 0.8).when(length < 6, 0.85).when(length < 10, 0.95).otherwise(1.0)


def bore_factor(diameter: Column) -> Column:
    return F.when(diameter.between(65, 115), 1.0).when(diameter == 200, 1.15).otherwise(1.05)


def spt_velocity(name: str, n60: Column, depth: Column, soil: Column) -> tuple[Column, Column, Column]:
    """(vs, sd of ln vs, effective stress kPa); the stress is taken a foot below the depth, where the counted blows end."""
    if name not in SPT_CORRELATIONS:
        raise KeyError(f"{name} is not one of {sorted(SPT_CORRELATIONS)}")
    rows = SPT_CORRELATIONS[name]

    def value(k: int) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for kind, row in rows.items():
            if kind:
                out = out.when(soil == kind, float(row[k]))
        return out.otherwise(float(rows[None][k]))

    below = depth + DRIVEN
    stress = F.when(below > WATER_TABLE, WATER_TABLE * value(4) + (below - WATER_TABLE) * (value(5) - 9.81)).otherwise(below * value(4))
    spread = F.when(stress <= 200, value(6) - value(7) * F.log(stress)).otherwise(value(8))
    vs = F.exp(value(0) + value(1) * F.log(n60) + value(2) * F.log(stress))
    return vs, F.sqrt(value(3) * value(3) + spread * spread), stress
