"""Schemas of the tables that the library reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


SOUNDING = _schema("cpt_id:long pos:int depth:double qc:double fs:double u:double gwl:double nar:double")
BOREHOLE = _schema("spt_id:long pos:int depth:double n:double soil:string hammer:string diameter:double energy_ratio:double")
PROFILE = _schema("profile_id:long vs_correlation:string pos:int depth:double vs:double vs_sd:double layered:boolean")
SITE = _schema("site_id:long easting:double northing:double vs30:double uncertainty:double")
POINT = _schema("point_id:long easting:double northing:double")
PIXEL = _schema("row:int col:int value:double")
EDGE = _schema("gid:int feature_ord:int x1:double y1:double x2:double y2:double")
CPT_FILE = _schema("depth:double qc:double fs:double u:double")
SPT_FILE = _schema("Depth:double NValue:double Soil:string")
PROFILE_FILE = _schema("Depth:double Vs:double Vs_SD:double")
