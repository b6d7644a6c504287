"""Campaign name components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and channel codes of the campaign naming scheme.
CAMPAIGN_BRAND = r"^[a-z]{2}_(?:nv_)?([a-z]{2})_"
CAMPAIGN_CHANNEL = r"(aud|dis|psoc|psocdp|prg|rad|olv|vod|sem|prt|ooh|cin|prog)"
CAMPAIGN_MARKET = r"^([a-z]{2})_"
CAMPAIGN_NAMEPLATE = r"^[a-z]{2}_(?:nv_)?[a-z]{2}_([a-z0-9]{2,5})_"
CAMPAIGN_OBJECTIVE_1 = r"(do|think|see|thk)"
CAMPAIGN_OBJECTIVE_2 = r"(lead|conv|aware|engage|traffic|consideration|purchase|retention)"
MEDIA_CODE = r"(gmc[0-9]+)"
MEDIA_CHANNELS = {
    "gmc1000": "Google Search",
    "gmc2000": "Google Display Network",
    "gmc3000": "Facebook",
    "gmc4000": "Instagram",
    "gmc5000": "YouTube",
    "gmc6000": "LinkedIn",
    "gmc7000": "Twitter",
    "gmc8000": "Bing Ads",
    "gmc9000": "CRM / Direct Email",
}
UNKNOWN_MEDIA_CHANNEL = "Unknown Media Channel"


def extract_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, with NULL (not Spark's empty string) where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def campaign_components(campaign: Column) -> list[Column]:
    lowered = F.lower(campaign)
    return [
        extract_or_null(lowered, CAMPAIGN_BRAND).alias("cmp_brand"),
        extract_or_null(lowered, CAMPAIGN_CHANNEL).alias("cmp_channel"),
        extract_or_null(lowered, CAMPAIGN_MARKET).alias("cmp_market"),
        extract_or_null(lowered, CAMPAIGN_NAMEPLATE).alias("cmp_nameplate"),
    ]


def campaign_objectives(campaign: Column) -> list[Column]:
    lowered = F.lower(campaign)
    return [
        extract_or_null(lowered, CAMPAIGN_OBJECTIVE_1).alias("cmp_objective1"),
        extract_or_null(lowered, CAMPAIGN_OBJECTIVE_2).alias("cmp_objective2"),
    ]


def media_channel(campaign: Column) -> Column:
    """Channel name of the media code inside a campaign name."""
    code = extract_or_null(F.lower(campaign), MEDIA_CODE)
    names = F.create_map(*[F.lit(x) for pair in MEDIA_CHANNELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.lit(UNKNOWN_MEDIA_CHANNEL))
