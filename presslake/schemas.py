"""Table schemas and additive schema alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


TYPES = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _fields(spec: str) -> T.StructType:
    """Fields from `name TYPE, …`; unlike a DDL string this needs no running session at import time."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (f.split() for f in spec.split(","))])


ANALYSIS = _fields(
    "is_ai_topic BOOLEAN, confidence DOUBLE, topic STRING, explanation STRING, keywords ARRAY<STRING>"
)

FEED = _fields("url STRING, title STRING, seendate STRING, domain STRING, language STRING, sourcecountry STRING")

PAGE = _fields("url STRING, html STRING")

ARTICLE = T.StructType(
    _fields(
        "url STRING, title STRING, text STRING, domain STRING, domain_category STRING, language STRING, "
        "source_country STRING, published_at STRING, downloaded_at TIMESTAMP, processed_at TIMESTAMP, "
        "gdelt_id STRING, extraction_method STRING, content_hash STRING"
    ).fields
    + [T.StructField("analysis", ANALYSIS)]
    + _fields("summary_en STRING, summary_da STRING, batch_id STRING").fields
)

REJECTED = T.StructType(
    [f for f in ARTICLE.fields if f.name != "analysis"]
    + _fields("rejection_reason STRING, rejected_at TIMESTAMP").fields
)

STORED = _fields(
    "url STRING, title STRING, domain STRING, domain_category STRING, language STRING, source_country STRING, "
    "processed_at TIMESTAMP, gdelt_id STRING, extraction_method STRING, ai_topic_detected BOOLEAN, "
    "summary_en STRING, summary_da STRING, ai_topic STRING, ai_confidence DOUBLE, ai_keywords ARRAY<STRING>, "
    "published_at STRING, file_stored_in STRING, batch_id STRING"
)

STORED_REJECTED = _fields(
    "url STRING, title STRING, domain STRING, domain_category STRING, language STRING, source_country STRING, "
    "rejected_at TIMESTAMP, gdelt_id STRING, extraction_method STRING, rejection_reason STRING, "
    "file_stored_in STRING, batch_id STRING"
)

RUN = _fields(
    "run_id STRING, started_at TIMESTAMP, completed_at TIMESTAMP, fetched BIGINT, validated BIGINT, "
    "stored BIGINT, rejected BIGINT, ai_topic_count BIGINT, seconds DOUBLE, status STRING, error STRING"
)

FAILURE = _fields("domain STRING, reason STRING, at TIMESTAMP, batch_id STRING")

PENDING = T.StructType(FEED.fields + _fields("waits BOOLEAN, at TIMESTAMP, batch_id STRING").fields)

ANSWER = _fields("url STRING, response_text STRING")

STORED_ANSWER = _fields("url STRING, response_text STRING, scorer_error STRING, at TIMESTAMP, batch_id STRING")

SUMMARY_CACHE = _fields("cache_key STRING, summary STRING")

SUMMARY_TABLE = _fields("cache_key STRING, summary STRING, at TIMESTAMP, batch_id STRING")

RUN_EVENT = _fields(
    "run_id STRING, at TIMESTAMP, status STRING, fetched BIGINT, validated BIGINT, stored BIGINT, "
    "rejected BIGINT, ai_topic_count BIGINT, seconds DOUBLE, error STRING"
)

COLUMN_DEFAULTS = {"domain_category": "unknown"}


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Select exactly the columns of `schema`: cast what is there, add what is missing with its default."""
    defaults = COLUMN_DEFAULTS if defaults is None else defaults
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
