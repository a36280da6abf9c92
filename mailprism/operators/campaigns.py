"""Campaigns: messages that differ in digits, links, addresses and layout only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.common import as_column


def campaign_pattern(clean: Column | str) -> Column:
    """Cleaned text with every run of digits masked."""
    return F.regexp_replace(as_column(clean), r"\p{Nd}+", "#")


def fingerprint(clean: Column | str) -> Column:
    return F.sha2(campaign_pattern(clean), 256)


def campaigns(messages: DataFrame, clean: str, min_messages: int = 2) -> DataFrame:
    """Clusters of equal fingerprint: messages, distinct cleaned texts and the pattern.

    Two aggregations that combine before the shuffle: the first counts the copies of each
    text, the second adds up the texts of a fingerprint.
    """
    marked = messages.select(campaign_pattern(clean).alias("pattern"), F.sha2(clean, 256).alias("text_id"))
    variants = marked.groupBy("pattern", "text_id").agg(F.count("*").alias("n"))
    return (
        variants.groupBy("pattern")
        .agg(F.sum("n").alias("messages"), F.count("*").alias("variations_detected"))
        .filter(F.col("messages") >= min_messages)
        .select(F.sha2("pattern", 256).alias("cluster_id"), "messages", "variations_detected", "pattern")
    )


def with_campaign(messages: DataFrame, key: str, clean: str, found: DataFrame) -> DataFrame:
    """Campaign of each message that belongs to one: `email_id` and the context fields."""
    return (
        messages.select(F.col(key).cast("string").alias("email_id"), fingerprint(clean).alias("cluster_id"))
        .join(found.select("cluster_id", "variations_detected", "pattern"), "cluster_id")
        .select("email_id", "cluster_id", "variations_detected", "pattern")
    )
