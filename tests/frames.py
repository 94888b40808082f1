"""Small input tables."""

from __future__ import annotations

import datetime as dt

from fieldpanel.schemas import AGES, INDEX_COLS, RAW_SCHEMA

IDX = [0.1, 0.2, 0.3, -0.1, -0.2, 0.4]


def raw(spark, **overrides):
    """Six sites with one observation each; a list per column replaces its values."""
    rows = []
    for i in range(6):
        row = {c: None for c in RAW_SCHEMA.fieldNames()}
        row |= dict(
            ID=i + 1, PixelID=str(101 + i), Area_ha=100.0 * (i + 1), Planted=1000.0 * (i + 1), Season=2001 + i,
            Year=2001 + i, DOY=1, prevUse="AG", SpcsCmp="HW 100, SW 0", Type="Decidous",
            ImgDate=dt.date(2001 + i, 12, 31),
        )
        row |= {c: IDX[i] for c in INDEX_COLS}
        row |= {c: values[i] for c, values in overrides.items()}
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def wide_sites(spark):
    """Two pixels, one of them listed twice; ages without survey are null."""
    names = ["ID", "PixelID", "Season", "Type", "Density", "ImgDate"]
    schema = "ID long, PixelID string, Season int, Type string, Density double, ImgDate date, "
    schema += ", ".join([*(f"SrvvR_{k} double" for k in AGES), *(f"AsssD_{k} date" for k in AGES)])

    def date(year):
        return dt.date(year, 7, 1) if year else None

    a = [1, "1_1", 2001, "Conifer", 1434.54, dt.date(2010, 1, 1), None, 90.0, None, 90.0, None, 90.0, 101.0]
    a += [date(y) for y in (None, 2010, None, 2012, None, 2014, 2015)]
    b = [2, "2_2", 2002, "Mixed", 1235.0, dt.date(2010, 1, 1), 90.0, 90.0, None, 90.0, 90.0, None, None]
    b += [date(y) for y in (2009, 2010, None, 2012, 2013, None, None)]
    c = [*b[:5], dt.date(2010, 2, 2), *b[6:]]
    assert len(names) == 6
    return spark.createDataFrame([tuple(a), tuple(b), tuple(c)], schema)
