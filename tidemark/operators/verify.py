"""Verification flags over policies of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.urls import path

# Names that say nothing, and paths of pages about staff.
GENERIC_NAMES = ["energy policy", "energy law", "energy regulation", "data center policy", "data center regulation", "heat policy", "heat regulation", "heat law", "energy efficiency", "policy", "regulation", "law", "directive", "act", "bill", "measure", "standard"]
STAFF_PATHS = ["/about", "/contact", "/team", "/staff"]

# Region -> words that a jurisdiction of it holds.
REGION_WORDS = {
    "germany": ["germany", "german", "deutschland", "deutsch", "bundesrepublik"], "france": ["france", "french", "français", "république"], "netherlands": ["netherlands", "dutch", "nederland"], "denmark": ["denmark", "danish", "danmark"], "sweden": ["sweden", "swedish", "sverige"],
    "norway": ["norway", "norwegian", "norge"], "ireland": ["ireland", "irish", "éire"], "switzerland": ["switzerland", "swiss", "schweiz", "suisse"], "uk": ["united kingdom", "uk", "britain", "british", "england", "scotland", "wales"], "us": ["united states", "us", "usa", "america", "american", "federal"],
    "singapore": ["singapore"], "japan": ["japan", "japanese"], "greece": ["greece", "greek", "hellenic", "ελλάδα", "ελληνική"], "estonia": ["estonia", "estonian", "eesti"], "poland": ["poland", "polish", "polska", "rzeczpospolita"], "south_africa": ["south africa", "south african"],
    "brazil": ["brazil", "brazilian", "brasil"], "new_zealand": ["new zealand", "aotearoa"], "eu": ["european union", "eu", "european"], "oregon": ["oregon"], "texas": ["texas"], "california": ["california"], "virginia": ["virginia"],
}


def jurisdiction_mismatch(jurisdiction: Column, regions: Column, words: dict[str, list[str]] = REGION_WORDS) -> Column:
    """VF-02: a known jurisdiction that holds no word of any of the regions, one of which has words."""
    place, have = F.lower(F.coalesce(jurisdiction, F.lit(""))), F.coalesce(regions, F.array().cast("array<string>"))
    known, found = F.lit(False), F.lit(False)
    for region, each in words.items():
        hit = F.lit(False)
        for w in each:
            hit = hit | place.contains(w)
        tagged = F.array_contains(have, region)
        known, found = known | tagged, found | (tagged & hit)
    return (place != "") & (jurisdiction != "Unknown") & known & ~found


def generic_name(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*GENERIC_NAMES)


def verify(df: DataFrame, today: Column, regions: Column | None = None, words: dict[str, list[str]] = REGION_WORDS) -> DataFrame:
    """VF-01..04: adds verification_flags, in fixed order. A repeated URL is flagged from its second row of a scan on, by seq."""
    again = F.row_number().over(W.partitionBy("scan_id", "url").orderBy("seq")) > 1
    mismatch = F.lit(False) if regions is None else jurisdiction_mismatch(F.col("jurisdiction"), regions, words)
    low, staff = F.lower(path(F.col("url"))), F.lit(False)
    for p in STAFF_PATHS:
        staff = staff | low.contains(p)
    rules = [
        ("duplicate_url", again),
        ("jurisdiction_mismatch", mismatch),
        ("future_date", F.col("effective_date") > F.date_add(today, 730)),
        ("generic_name", generic_name(F.col("policy_name")) & (F.coalesce("bill_number", F.lit("")) == "")),
        ("low_confidence_high_score", (F.col("relevance_score") >= 9) & staff),
    ]
    return df.withColumn("verification_flags", F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules))))


def verification_summary(df: DataFrame) -> DataFrame:
    """VF-05: per scan and flag: rows; flag 'passed' and 'flagged' are rows without and with any."""
    flags = F.concat(F.col("verification_flags"), F.array(F.when(F.size("verification_flags") > 0, "flagged").otherwise("passed")))
    return df.select("scan_id", F.explode(flags).alias("flag")).groupBy("scan_id", "flag").agg(F.count("*").alias("n"))
