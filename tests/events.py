"""Builders of small inputs."""

SECOND = 1_000_000
START = 1_704_067_200 * SECOND

GATE_SCHEMA = (
    "id long, received_us long, incident_id string, host string, source string, severity string, "
    "message string, timestamp string"
)


def gate_rows(spark, rows):
    """rows: (seconds, severity, message) or (seconds, severity, message, source)."""
    data = []
    for i, row in enumerate(rows):
        at, severity, message, *rest = row
        data.append((i, START + round(at * SECOND), f"evt-{i}", "h", rest[0] if rest else "s", severity, message, "t"))
    return spark.createDataFrame(data, GATE_SCHEMA)
