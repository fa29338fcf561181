"""Vs30 from the average velocity to a shallower depth Z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Z, C0, C1, C2, SD.
BOORE_2011 = (
    (5, 0.2046, 1.318, -0.1174, 0.119), (6, -0.06072, 1.482, -0.1423, 0.111), (7, -0.2744, 1.607, -0.1600, 0.103), (8, -0.3723, 1.649, -0.1634, 0.097), (9, -0.4941, 1.707, -0.1692, 0.090),
    (10, -0.5438, 1.715, -0.1667, 0.084), (11, -0.6006, 1.727, -0.1649, 0.078), (12, -0.6082, 1.707, -0.1576, 0.072), (13, -0.6322, 1.698, -0.1524, 0.067), (14, -0.6118, 1.659, -0.1421, 0.062),
    (15, -0.5780, 1.611, -0.1303, 0.056), (16, -0.5430, 1.565, -0.1193, 0.052), (17, -0.5282, 1.535, -0.1115, 0.047), (18, -0.4960, 1.494, -0.1020, 0.043), (19, -0.4552, 1.447, -0.09156, 0.038),
    (20, -0.4059, 1.396, -0.08064, 0.035), (21, -0.3827, 1.365, -0.07338, 0.030), (22, -0.3531, 1.331, -0.06585, 0.027), (23, -0.3158, 1.291, -0.05751, 0.023), (24, -0.2736, 1.250, -0.04896, 0.019),
    (25, -0.2227, 1.202, -0.03943, 0.016), (26, -0.1768, 1.159, -0.03087, 0.013), (27, -0.1349, 1.120, -0.02310, 0.009), (28, -0.09038, 1.080, -0.01527, 0.006), (29, -0.04612, 1.040, -0.007618, 0.003),
)
# Z, a, b, sigma.
BOORE_2004 = (
    (10, 0.042062, 1.0292, 0.07126), (11, 0.02214, 1.0341, 0.064722), (12, 0.012571, 1.0352, 0.059353), (13, 0.014186, 1.0318, 0.054754), (14, 0.0123, 1.0297, 0.050086),
    (15, 0.013795, 1.0263, 0.045925), (16, 0.013893, 1.0237, 0.042219), (17, 0.019565, 1.019, 0.039422), (18, 0.024879, 1.0144, 0.036365), (19, 0.025614, 1.0117, 0.033233),
    (20, 0.025439, 1.0095, 0.030181), (21, 0.025311, 1.0072, 0.027001), (22, 0.0269, 1.0044, 0.024087), (23, 0.022207, 1.0042, 0.020826), (24, 0.016891, 1.0043, 0.017676),
    (25, 0.011483, 1.0045, 0.014691), (26, 0.0065646, 1.0045, 0.011452), (27, 0.002519, 1.0043, 0.0083871), (28, 0.00077322, 1.0031, 0.0055264), (29, 0.00043143, 1.0015, 0.0027355),
)
VS30_CORRELATIONS = ("boore_2004", "boore_2011")


def coefficients(spark: SparkSession) -> DataFrame:
    """(vs30_correlation, z, a, b, c, sigma): 45 rows, of fixed size and so safe to broadcast."""
    rows = [("boore_2011", *r) for r in BOORE_2011] + [("boore_2004", z, a, b, None, s) for z, a, b, s in BOORE_2004]
    return spark.createDataFrame(rows, "vs30_correlation string, z int, a double, b double, c double, sigma double")


def vs30(vsz: Column, a: Column, b: Column, c: Column) -> Column:
    lg = F.log10(vsz)
    return F.pow(F.lit(10.0), a + b * lg + F.coalesce(c, F.lit(0.0)) * lg * lg)


def vs30_sd(vsz: Column, b: Column, c: Column, sigma: Column) -> Column:
    """sigma for the linear form (c null); the quadratic form adds the slope taken at ln vsz, as published use has it."""
    ln = F.log(vsz)
    lg = F.log10(ln)
    slope = (b * F.pow(F.lit(10.0), b * lg) + 2 * c * lg * F.pow(F.lit(10.0), c * lg * lg)) / ln
    return F.when(c.isNull(), sigma).otherwise(F.sqrt(sigma * sigma + slope * slope))
