"""Scored company records: the columns the reports and rankings read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.functions import quality as Q
from webrec.functions.common import filled


def score_records(companies: DataFrame, fields=("name", "address", "city", "state", "latitude", "longitude", "phone", "website", "materials", "services")) -> DataFrame:
    """Completeness, contact quality, quality score and status per company."""
    arrays = [f for f in fields if f in ("materials", "services")]
    return companies.withColumns({
        "completeness": Q.completeness_score(list(fields), arrays),
        "contact_quality": Q.contact_quality("phone", "email", "website", "address", "hours"),
        "quality": Q.quality_score(),
    }).withColumn("status", Q.verification_status(F.col("completeness")))


def profile_records(companies: DataFrame) -> DataFrame:
    """All business rules in the order that makes later ones see earlier
    flags: capability and commercial flags, then profile, then position."""
    scored = score_records(companies)
    n_metals = F.when(F.size("materials") > 0, F.size("materials")).otherwise(0)
    text_for_flags = F.concat_ws(" ", F.array_join("services", " "), "description")
    flagged = scored.withColumns({
        **Q.operational_capability(F.col("services"), "hours", n_metals),
        **Q.digital_presence("website", "pricing"),
        **Q.commercial_flags(text_for_flags),
    })
    flags = {c: F.col(c) for c in ("pickup_service", "container_rental", "certified_scales", "processing_capabilities", "commercial_accounts")}
    profiled = flagged.withColumns(Q.business_profile(
        F.col("materials"), "city", "state", "website", "phone", "email", F.col("services"), F.col("pricing_available") == "Yes",
        F.col("completeness"), F.col("contact_quality"), flags))
    return profiled.withColumns(Q.market_position("city", "state", F.col("services"), F.col("all_metal_types_count")))


def reject_synthetic_batch(records: DataFrame, batch: str = "batch_id", **cols: str) -> DataFrame:
    """Drop every batch that has a flagged row. The flags are pre-aggregated to
    one row per bad batch, so a huge batch never meets in one task."""
    bad = records.where(F.size(Q.detect_synthetic(**cols)) > 0).select(batch).distinct()
    return records.join(bad, batch, "left_anti")


def with_contact(records: DataFrame, phone: str = "phone") -> tuple[DataFrame, DataFrame]:
    """Two tables: with and without a phone."""
    return records.where(filled(phone)), records.where(~filled(phone))
