"""Dimension seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Room features; the id is the place in the list, from 1.
FEATURES = [
    "King-size bed",
    "Queen-size bed",
    "Twin beds",
    "Ocean view",
    "City view",
    "Mountain view",
    "Free WiFi",
    "Flat-screen TV",
    "Air conditioning",
    "Mini-bar",
    "Coffee machine",
    "In-room safe",
    "Bathtub",
    "Shower",
    "Balcony",
    "Terrace",
    "Room service",
    "Soundproof",
    "Non-smoking",
    "Interconnected rooms available",
    "Up to 3 guests",
    '55" 4K Smart TV',
]

# Room badges; the id is the place in the list, from 1.
BADGES = [
    "Ocean View",
    "Mountain View",
    "Beachfront",
    "Family-friendly",
    "Romantic",
    "Non-smoking",
    "Business",
    "Spa",
    "Pet-friendly",
    "Accessible",
    "Eco-friendly",
    "Luxury",
    "Budget",
    "All-inclusive",
    "Adults only",
    "Free Cancellation",
    "No prepayment",
    "Breakfast included",
    "Pool access",
    "Fitness center",
    "Restaurant on-site",
    "Bar on-site",
    "Free Breakfast",
]


def dimension(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Ids by place in the list, description equal to the name. The rows are literals of the plan."""
    rows = [
        F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(name).alias("description"))
        for i, name in enumerate(names, 1)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
