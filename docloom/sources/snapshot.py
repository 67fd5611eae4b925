"""The published side as tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "pages": "id string, title string, parent_id string, space_id string, status string, position int, version int, created_at timestamp, body string",
    "attachments": "id string, name string, page_id string, media_type string, size bigint, checksum string, version int, created_at timestamp",
    "properties": "id string, page_id string, key string, value string, version int",
    "labels": "id string, page_id string, name string, prefix string",
    "comments": "id string, page_id string, status string, resolution_status string",
    "users": "account_id string, public_name string, display_name string, email string",
    "spaces": "space_id string, space_key string, homepage_id string",
    "sync_state": "page_id string, page_version int, source_digest string",
}


def load_snapshot(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One snapshot table; fields that the schema does not name are ignored."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{directory}/{name}")
