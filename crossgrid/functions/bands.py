"""Band positions, band groups, spectral ratios and class codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Band order, band groups and reflectance scale of the 12-band chips.
BAND_NAMES = (
    "B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12",
)
BAND_GROUPS = {
    "visible": ("B02", "B03", "B04"),
    "red_edge": ("B05", "B06", "B07"),
    "nir": ("B08", "B8A"),
    "swir": ("B11", "B12"),
    "atmospheric": ("B01", "B09"),
}
REFLECTANCE_SCALE = 10000.0

# Land-cover class codes.
LAND_COVER_CLASSES = {
    10: "Tree cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up",
    60: "Bare/sparse vegetation",
    70: "Snow and ice",
    80: "Permanent water bodies",
    90: "Herbaceous wetland",
    95: "Mangroves",
    100: "Moss and lichen",
}


def band(name: str, bands="bands") -> Column:
    return F.col(bands)[BAND_NAMES.index(name)]


def ratio(a: Column, b: Column) -> Column:
    """Normalised difference; 0 where the sum is 0."""
    return F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))


def ndvi(bands="bands") -> Column:
    return ratio(band("B08", bands), band("B04", bands))


def ndwi(bands="bands") -> Column:
    return ratio(band("B03", bands), band("B08", bands))


def ndmi(bands="bands") -> Column:
    return ratio(band("B08", bands), band("B11", bands))
