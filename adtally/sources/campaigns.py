"""The static table that tells which campaign an ad belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.operators.lookup import Lookup
from adtally.settings import ADS_PER_CAMPAIGN, CAMPAIGNS


def numbered_campaigns(
    spark: SparkSession, campaigns: int = CAMPAIGNS, ads_per_campaign: int = ADS_PER_CAMPAIGN
) -> Lookup:
    """Ads ``0 .. campaigns * ads_per_campaign - 1``, numbered through by campaign."""
    ads = campaigns * ads_per_campaign
    frame = spark.range(ads).select(
        F.col("id").alias("ad_id"), F.expr(f"id div {ads_per_campaign}").alias("campaign_id")
    )
    return Lookup.bounded(frame, ["ad_id"], rows=ads, row_bytes=16)


def campaigns_of(events: DataFrame, ads_per_campaign: int = ADS_PER_CAMPAIGN) -> DataFrame:
    """The campaign table of the numbered ads that occur in ``events``.

    Ads are gathered first and unreadable numbers dropped after, by an
    aggregate: a filter on the number itself would be moved below and have
    every event parsed twice.
    """
    ads = events.groupBy("ad_id").agg(F.min("ad_id").alias("_least")).where(F.col("_least") >= 0)
    return ads.select("ad_id", F.expr(f"ad_id div {ads_per_campaign}").alias("campaign_id"))


def campaign_table(frame: DataFrame) -> Lookup:
    """An ``(ad_id, campaign_id)`` table, its size measured once.

    For a table that is stored: one that has to be computed is computed for the
    measurement and again for each use, so write it down first.
    """
    return Lookup.measured(frame.select("ad_id", "campaign_id"), ["ad_id"])
