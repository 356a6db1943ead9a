"""Receiver side: signature, freshness, repeats and payload checks of signed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.signing import fresh, signature_valid
from emberlog.functions.text import is_json_object
from emberlog.session import cut

PAYLOAD = (
    "incident_id string, host string, source string, severity string, message string, timestamp string"
)


def is_object(body: Column) -> Column:
    """The body parses as JSON and is an object; a name may occur twice."""
    return is_json_object(body)


def verify(signed: DataFrame, secret: bytes) -> DataFrame:
    """Verdict columns: signature_ok, fresh_ok, payload_ok."""
    return (
        signed.withColumn(
            "signature_ok",
            signature_valid(
                secret, F.col("svix_id"), F.col("svix_timestamp"), F.col("svix_signature"),
                F.col("raw_body"),
            ),
        )
        .withColumn("fresh_ok", fresh(F.col("svix_timestamp"), F.col("received_us")))
        .withColumn("payload_ok", is_object(F.col("raw_body")))
    )


def first_deliveries(signed: DataFrame, key: str = "svix_id") -> DataFrame:
    """(key, received_us, seq) of the first row of every event id, by (received_us, seq).

    Ids and times are cut first, so whatever was checked above is checked once.  The first sequence
    number of each id is found with a map-side combine, so an id that was sent very often does
    not meet in one task; the rows themselves are then joined on the sequence number, which is unique.
    """
    narrow = cut(signed.select(key, "received_us", "seq"))
    firsts = narrow.groupBy(key).agg(F.min(F.struct("received_us", "seq")).alias("first"))
    return narrow.join(firsts.select(F.col("first.seq").alias("seq")), "seq", "left_semi")


def payload(signed: DataFrame) -> DataFrame:
    """The six fields as columns; a JSON null is a missing value."""
    body = F.from_json("raw_body", PAYLOAD)
    return signed.withColumn("p", body).select("*", "p.*").drop("p")
