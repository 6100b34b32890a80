"""Derived tract features: logs of values and percentages of counts, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Derived feature = 100 * (sum of numerators) / denominator.
PERCENTAGES = {
    "owner_pct": (("owner_occupied_units",), "total_housing_units"),
    "crowded_pct": (
        ("owner_crowded_1_01_to_1_50", "renter_crowded_1_01_to_1_50"), "crowding_total_households"),
    "severely_crowded_pct": (
        ("owner_severely_crowded_1_51_plus", "renter_severely_crowded_1_51_plus"),
        "crowding_total_households"),
    "single_family_pct": (("units_1_detached", "units_1_attached"), "total_units_in_structure"),
    "poverty_rate": (("population_below_poverty_line",), "poverty_total_population"),
    "pct_2plus_vehicles": (
        ("owner_2_vehicles", "owner_3_plus_vehicles", "renter_2_vehicles", "renter_3_plus_vehicles"),
        "vehicles_total_households"),
    "poor_heat_pct": (("fuel_oil_kerosene_heat", "wood_heat"), "heating_total_households"),
    "gas_heat_pct": (("utility_gas_heat",), "heating_total_households"),
    "propane_pct": (("propane_heat",), "heating_total_households"),
    "no_fuel_pct": (("no_fuel_heat",), "heating_total_households"),
    "solar_heat_pct": (("solar_heat",), "heating_total_households"),
    "unemployment_rate": (("unemployed",), "labor_force_total"),
    "rent_burdened_30plus_pct": (
        ("rent_burdened_30_34", "rent_burdened_35_39", "rent_burdened_40_49", "rent_burdened_50_plus"),
        "rent_burden_universe"),
    "owner_burdened_30plus_pct": (
        ("owner_mortgaged_30_34", "owner_mortgaged_35_39", "owner_mortgaged_40_49",
         "owner_mortgaged_50_plus"),
        "owner_mortgaged_units"),
    "broadband_pct": (("broadband_internet",), "internet_total_households"),
    "computer_pct": (("has_computer",), "computer_total_households"),
    "units_2_pct": (("units_2",), "total_units_in_structure"),
    "units_3_4_pct": (("units_3_4",), "total_units_in_structure"),
    "units_5_9_pct": (("units_5_9",), "total_units_in_structure"),
    "units_10_19_pct": (("units_10_19",), "total_units_in_structure"),
    "units_20_49_pct": (("units_20_49",), "total_units_in_structure"),
    "units_50plus_pct": (("units_50plus",), "total_units_in_structure"),
    "mobile_home_pct": (("mobile_home",), "total_units_in_structure"),
    "car_alone_pct": (("commute_car_alone",), "commute_universe"),
    "transit_pct": (("commute_transit",), "commute_universe"),
    "walk_pct": (("commute_walk",), "commute_universe"),
    "work_from_home_pct": (("commute_work_home",), "commute_universe"),
}

# Log features, the vehicle counts, and the columns the older period lacks.
LOGS = {"log_home_value": "median_home_value", "log_gross_rent": "median_gross_rent"}
VEHICLE_COUNTS = (
    "owner_1_vehicle", "owner_2_vehicles", "owner_3_plus_vehicles",
    "renter_1_vehicle", "renter_2_vehicles", "renter_3_plus_vehicles",
)
NOT_IN_OLDER_PERIOD = (
    "internet_total_households", "broadband_internet", "computer_total_households", "has_computer",
)

# Older spellings of input columns and what they are called here.
COLUMN_ALIASES = {
    "owner_crowded_1_01_to_1_50_occupants": "owner_crowded_1_01_to_1_50",
    "renter_crowded_1_01_to_1_50_occupants": "renter_crowded_1_01_to_1_50",
    "owner_severely_crowded_1_51_plus_occupants": "owner_severely_crowded_1_51_plus",
    "renter_severely_crowded_1_51_plus_occupants": "renter_severely_crowded_1_51_plus",
}


def log_clipped(x) -> Column:
    """log1p of the value clipped at 0; NULL stays NULL (``greatest`` alone would skip it)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


def percent(numerators, denominator) -> Column:
    """100 * sum / denominator; NULL with a NULL part or a zero denominator."""
    total = F.col(numerators[0]).cast("double")
    for c in numerators[1:]:
        total = total + F.col(c)
    return F.try_divide(total, F.col(denominator).cast("double")) * 100


def derive_features(df: DataFrame) -> DataFrame:
    """Add every derived feature whose input columns exist; broadband is NULL without them."""
    df = df.withColumnsRenamed({k: v for k, v in COLUMN_ALIASES.items() if k in df.columns})
    have = set(df.columns)
    new = {name: log_clipped(c) for name, c in LOGS.items() if c in have}
    for name, (nums, den) in PERCENTAGES.items():
        if have.issuperset({*nums, den}):
            new[name] = percent(nums, den)
    total = "vehicles_total_households"
    if have.issuperset({*VEHICLE_COUNTS, total}):
        new["pct_no_vehicle"] = 100.0 - percent(VEHICLE_COUNTS, total)
    if {"total_bedrooms", "total_housing_units"} <= have:
        new["avg_bedrooms_per_unit"] = F.try_divide(
            F.col("total_bedrooms").cast("double"), F.col("total_housing_units").cast("double"))
    new.setdefault("broadband_pct", F.lit(None).cast("double"))
    return df.withColumns(new)


def null_unreleased(df: DataFrame, period: str, older: str, columns=NOT_IN_OLDER_PERIOD) -> DataFrame:
    """NULL the columns that the older period did not release."""
    return df.withColumns({
        c: F.when(F.col(period) != older, F.col(c)) for c in columns if c in df.columns
    })
