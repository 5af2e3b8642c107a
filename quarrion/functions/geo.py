"""Distances on the WGS-84 ellipsoid as plain SQL expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: The ellipsoid, metres in a mile, iterations (six suffice but for nearly opposite points).
A, FLAT, MILE, ROUNDS = 6378137.0, 1 / 298.257223563, 1609.344, 6
B = A * (1 - FLAT)


def distance_steps(lat1: str, lng1: str, lat2: str, lng2: str) -> list[tuple[str, str]]:
    """(name, expression) in order; the last is ``miles``, 0 for equal points."""
    d = "CAST({} AS DOUBLE)".format
    steps = [
        ("_u1", f"atan({d(1 - FLAT)} * tan(radians({lat1})))"), ("_u2", f"atan({d(1 - FLAT)} * tan(radians({lat2})))"), ("_l", f"radians({lng2}) - radians({lng1})"),
        ("_su1", "sin(_u1)"), ("_cu1", "cos(_u1)"), ("_su2", "sin(_u2)"), ("_cu2", "cos(_u2)"), ("_m0", "_l"),
    ]
    for i in range(ROUNDS):
        steps += [
            (f"_ss{i}", f"sqrt((_cu2*sin(_m{i}))*(_cu2*sin(_m{i})) + (_cu1*_su2-_su1*_cu2*cos(_m{i}))*(_cu1*_su2-_su1*_cu2*cos(_m{i})))"), (f"_cs{i}", f"_su1*_su2+_cu1*_cu2*cos(_m{i})"), (f"_sg{i}", f"atan2(_ss{i}, _cs{i})"),
            (f"_sa{i}", f"CASE WHEN _ss{i} = 0 THEN CAST(0 AS DOUBLE) ELSE _cu1*_cu2*sin(_m{i})/_ss{i} END"), (f"_ca{i}", f"1 - _sa{i}*_sa{i}"),
            (f"_cm{i}", f"CASE WHEN _ca{i} = 0 THEN CAST(0 AS DOUBLE) ELSE _cs{i} - 2*_su1*_su2/_ca{i} END"), (f"_c{i}", f"{d(FLAT / 16)}*_ca{i}*(4+{d(FLAT)}*(4-3*_ca{i}))"),
            (f"_m{i + 1}", f"_l + (1-_c{i})*{d(FLAT)}*_sa{i}*(_sg{i}+_c{i}*_ss{i}*(_cm{i}+_c{i}*_cs{i}*(2*_cm{i}*_cm{i}-1)))"),
        ]
    i = ROUNDS - 1
    steps += [
        ("_q", f"_ca{i}*{d((A * A - B * B) / (B * B))}"), ("_ka", "1+_q/16384*(4096+_q*(-768+_q*(320-175*_q)))"), ("_kb", "_q/1024*(256+_q*(-128+_q*(74-47*_q)))"),
        ("_ds", f"_kb*_ss{i}*(_cm{i}+_kb/4*(_cs{i}*(2*_cm{i}*_cm{i}-1)-_kb/6*_cm{i}*(4*_ss{i}*_ss{i}-3)*(4*_cm{i}*_cm{i}-3)))"), ("miles", f"CASE WHEN _ss{i} = 0 THEN CAST(0 AS DOUBLE) ELSE {d(B)}*_ka*(_sg{i}-_ds)/{d(MILE)} END"),
    ]
    return steps


def miles_between(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    """The steps over whole batches; null coordinates give null."""
    a1, l1, a2, l2 = (np.radians(x.to_numpy(dtype="float64", na_value=np.nan)) for x in (lat1, lng1, lat2, lng2))
    u1, u2, lon = np.arctan((1 - FLAT) * np.tan(a1)), np.arctan((1 - FLAT) * np.tan(a2)), l2 - l1
    su1, cu1, su2, cu2, m = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), lon
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(ROUNDS):
            ss = np.hypot(cu2 * np.sin(m), cu1 * su2 - su1 * cu2 * np.cos(m))
            cs = su1 * su2 + cu1 * cu2 * np.cos(m)
            sg = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * np.sin(m) / ss)
            ca = 1 - sa * sa
            cm = np.where(ca == 0, 0.0, cs - 2 * su1 * su2 / ca)
            c = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
            m = lon + (1 - c) * FLAT * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        q = ca * (A * A - B * B) / (B * B)
        ka, kb = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))), q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
        ds = kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        miles = np.where(ss == 0, 0.0, B * ka * (sg - ds) / MILE)
    return pd.Series(miles).where(~np.isnan(lon + a1 + a2), None)


def with_miles(df: DataFrame, lat1: str, lng1: str, lat2: str, lng2: str) -> DataFrame:
    """Adds ``miles`` in Arrow batches. As column expressions the iteration doubles with every filter pushed through it."""
    run = F.pandas_udf(miles_between, T.DoubleType())
    return df.withColumn("miles", run(*[F.col(c).cast("double") for c in (lat1, lng1, lat2, lng2)]))


def miles_sql(rows: str, lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """The same iteration over a SQL query, as nested selects."""
    for name, e in distance_steps(lat1, lng1, lat2, lng2):
        rows = f"SELECT *, {e} AS {name} FROM ({rows})"
    return rows


def box(lat, miles: float):
    """Half widths in degrees of latitude and longitude of a radius around ``lat``, with a margin."""
    tall = miles / 69 + 0.1
    return F.lit(tall), F.lit(tall) / F.greatest(F.lit(0.15), F.cos(F.radians(lat)))
