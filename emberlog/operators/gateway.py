"""Collector side: keyword routing, envelopes, allow-list, throttle, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import SECOND, rfc3339, seconds
from emberlog.functions.keys import gateway_fingerprint
from emberlog.functions.severity import collector_severity
from emberlog.functions.signing import incident_id, signature
from emberlog.functions.source import detect_dll, format_source, program_from_source
from emberlog.functions.text import ascii_lower, cut_bytes, is_json_object, strip
from emberlog.operators.slices import Heat, lay_out, stored
from emberlog.operators.throttle import throttle
from emberlog.session import cut


def router_hits(message: Column) -> Column:
    """Names of the keyword routers that take this line, in router order."""
    text = ascii_lower(message)

    def name_if_hit(name, word, benign):
        hit = text.contains(word.lower())
        if benign:
            hit = hit & ~text.contains(benign.lower())
        return F.when(hit, F.lit(name))

    return F.array_compact(F.array(*[name_if_hit(*router) for router in V.ROUTERS]))


def route(lines: DataFrame, message: str = "message") -> DataFrame:
    """Keep lines that at least one router takes; adds ``routers``."""
    return lines.withColumn("routers", router_hits(F.col(message))).filter(F.size("routers") > 0)


def fan_out(routed: DataFrame) -> DataFrame:
    """One row per router that took the line."""
    return routed.withColumn("router", F.explode("routers")).drop("routers")


def once(**columns: Column) -> Column:
    """A struct of columns that are worked out once a row, whatever is asked of them later."""
    return F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def parse_envelope(raw: DataFrame) -> DataFrame:
    """Add source and message: a JSON envelope where it parses, else the body is the message.

    Names match without regard to case, and of several values for a field the last counts.  JSON null leaves a field
    empty.  A field that is no string makes the whole body the message, but a source that could be read stays; so does any
    other JSON value that is not an object, without a source.

    The two columns pass a generator of one row, over which no filter or join condition is pushed: it would take the whole
    parse with it, several times a row.
    """
    is_null = F.coalesce(strip(F.col("raw")) == "null", F.lit(False))

    def values(name):
        mine = F.filter(F.map_entries("fields"), lambda e: F.lower(e["key"]) == name)
        return F.transform(mine, lambda e: e["value"])

    def kind(value):
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

    def text(name):
        strings = F.filter(values(name), lambda v: kind(v) == "STRING")
        return F.coalesce(F.try_variant_get(F.get(strings, F.size(strings) - 1), "$", "string"), F.lit(""))

    def readable(name):
        return F.forall(values(name), lambda v: kind(v).isin("STRING", "VOID"))

    good = F.col("fields").isNotNull() & readable("source") & readable("message")
    source = F.when(F.col("fields").isNotNull(), strip(text("source"))).otherwise("")
    message = strip(F.when(good, text("message")).when(is_null, "").otherwise(F.col("raw")))
    return (
        raw.withColumn("fields", F.when(is_json_object(F.col("raw")), F.from_json("raw", "map<string, variant>")))
        .withColumn("parsed", once(source=source, message=message))
        .withColumns({"source": F.col("parsed.source"), "message": F.col("parsed.message")})
        .drop("fields", "parsed")
    )


def acceptable(raw: Column, message: Column) -> Column:
    """Body within 64 KiB and a message left after trimming."""
    return (F.octet_length(raw) <= V.MAX_BODY_BYTES) & (message != "")


def with_context(events: DataFrame, allow: DataFrame) -> DataFrame:
    """Add program, dll, project and enabled from the allow-list.

    A program listed under two projects takes the least project name.  The allow-list is
    configuration; whether it is small enough to broadcast is left to Spark's size check.
    """
    one = allow.groupBy("program").agg(
        F.min("project").alias("project"), F.min_by("enabled", "project").alias("enabled")
    )
    return (
        events.withColumn("program", program_from_source(F.col("source")))
        .withColumn("dll", detect_dll(F.col("message")))
        .join(one, "program", "left")
        .withColumn("project", F.coalesce("project", F.lit("")))
        .withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    )


def cooldown_us(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 0)
        .when(severity == "warning", V.GATEWAY_WARNING_COOLDOWN_S * SECOND)
        .otherwise(V.GATEWAY_COOLDOWN_S * SECOND)
    ).cast("bigint")


def keyed_events(events: DataFrame) -> DataFrame:
    """Cut the message to 4096 bytes, grade and fingerprint it; time in whole seconds."""
    return (
        events.withColumn("message", cut_bytes(F.col("message"), V.MAX_GATEWAY_MESSAGE_BYTES))
        .withColumn("severity", collector_severity(F.col("message")))
        .withColumn(
            "fingerprint", gateway_fingerprint(F.col("source"), F.col("severity"), F.col("message"))
        )
        .withColumn("us", seconds(F.col("received_us")) * F.lit(SECOND))
    )


def receive(raw: DataFrame, allow: DataFrame) -> DataFrame:
    """Every body parsed, placed, graded and keyed, with ``ok`` and ``enabled``; nothing dropped.

    The library is looked for in the message as it is stored, cut to its limit.
    """
    parsed = parse_envelope(raw).withColumn("ok", acceptable(F.col("raw"), F.col("message")))
    return with_context(keyed_events(parsed), allow)


def receipts(received: DataFrame) -> DataFrame:
    """The narrow part of received rows, cut before anything filters on ``ok``."""
    return cut(
        received.select("id", "us", F.unhex("fingerprint").alias("fingerprint"), "severity", "ok", "enabled")
    )


def gateway_throttle(narrow: DataFrame, heat: Heat = Heat()) -> DataFrame:
    """(id, us, fingerprint, accepted, accepted_id): the event each row is counted under.

    A critical event is always accepted: its cooldown is zero, and a zero cooldown is forced.
    """
    rows = narrow.filter(F.col("ok") & F.col("enabled")).drop("ok", "enabled")
    laid = stored(lay_out(rows, "fingerprint", heat))
    judged = throttle(laid, cooldown_us(F.col("severity")))
    return judged.select(
        "id", "us", F.lower(F.hex("fingerprint")).alias("fingerprint"), "severity", "accepted",
        F.col("anchor_id").alias("accepted_id"), F.col("anchor_us").alias("accepted_us"),
    )


def ingest(raw: DataFrame, allow: DataFrame) -> DataFrame:
    """One verdict per incoming body: rejected, disabled, duplicate or accepted.

    Input: id, received_us, raw.  Rejected and disabled rows never reach the throttle's shuffle.
    """
    narrow = receipts(receive(raw, allow))
    stopped = narrow.filter(~F.col("ok") | ~F.col("enabled")).select(
        "id", F.when(F.col("ok"), "disabled").otherwise("rejected").alias("verdict"),
        F.lit(None).cast("bigint").alias("accepted_id"),
    )
    return stopped.unionByName(
        gateway_throttle(narrow).select(
            "id", F.when(F.col("accepted"), "accepted").otherwise("duplicate").alias("verdict"),
            "accepted_id",
        )
    )


def accepted_events(raw: DataFrame, allow: DataFrame, judged: DataFrame) -> DataFrame:
    """The stored events with the number of rows each one stands for.

    Duplicates are counted per accepted id with a map-side combine; the accepted id then meets its own body once,
    and only those bodies are parsed, placed and keyed again.
    """
    counts = judged.groupBy(F.col("accepted_id").alias("id")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    received = receive(raw.join(counts, "id"), allow)
    return received.select(
        "id",
        incident_id(F.col("source"), F.col("us"), F.col("id")).alias("incident_id"),
        F.col("us").alias("created_us"),
        "source", "severity", "message", "fingerprint", "occurrences",
        *[c for c in ("project", "program", "dll", "enabled", "host") if c in received.columns],
    )


def signed_events(accepted: DataFrame, host: Column, secret: bytes, signed_us: Column) -> DataFrame:
    """The six-field body and its three headers, ready for a sink."""
    body = F.to_json(
        F.struct(
            "incident_id",
            host.alias("host"),
            format_source(F.col("project"), F.col("program"), F.col("source"), F.col("dll")).alias("source"),
            "severity",
            "message",
            rfc3339(F.col("created_us")).alias("timestamp"),
        )
    )
    return (
        accepted.withColumn("raw_body", body)
        .withColumn("svix_id", F.col("incident_id"))
        .withColumn("svix_timestamp", seconds(signed_us))
        .withColumn(
            "svix_signature",
            signature(secret, F.col("svix_id"), F.col("svix_timestamp"), F.col("raw_body")),
        )
        .select("svix_id", "svix_timestamp", "svix_signature", "raw_body")
    )


def pending(ledger: DataFrame) -> DataFrame:
    """Undelivered events, oldest first, at most 50: one retry batch."""
    return (
        ledger.filter(F.col("delivered_us").isNull())
        .orderBy("created_us", "id")
        .limit(V.PENDING_BATCH)
    )


def recheck(events: DataFrame, allow: DataFrame) -> DataFrame:
    """Look the program up again before delivery; a disabled one is closed with a reason."""
    known = with_context(events.drop("program", "dll", "project", "enabled"), allow)
    return known.withColumn("last_error", F.when(~F.col("enabled"), V.DISABLED_REASON)).withColumn(
        "action", F.when(F.col("enabled"), "deliver").otherwise("close")
    )


def closures(rechecked: DataFrame, now_us: int) -> DataFrame:
    """What a recheck closes, as the ledger takes it."""
    return rechecked.filter(F.col("action") == "close").select(
        "id", F.lit(now_us).cast("bigint").alias("closed_us"), F.col("last_error").alias("reason")
    )


def delivery_ledger(events: DataFrame, attempts: DataFrame, closures: DataFrame | None = None) -> DataFrame:
    """attempts, delivered_us and last_error per event; a success clears the error.

    An event's attempts are combined before the shuffle; the newest one decides.  ``closures`` (id, closed_us, reason)
    are events found disabled at delivery: they count as delivered then, with the reason as their error, and are
    not offered again.
    """
    order = F.struct("attempt_us", "seq")
    tries = attempts.groupBy("id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min(F.when(F.col("ok"), F.col("attempt_us"))).alias("delivered_us"),
        F.max_by(F.when(F.col("ok"), F.lit(None)).otherwise(F.col("error")), order).alias("last_error"),
    )
    ledger = events.join(tries, "id", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0).cast("bigint"))
    )
    if closures is None:
        return ledger
    closed = closures.groupBy("id").agg(F.min("closed_us").alias("closed_us"), F.min_by("reason", "closed_us").alias("reason"))
    shut = F.col("delivered_us").isNull() & F.col("closed_us").isNotNull()
    return ledger.join(closed, "id", "left").withColumns({
        "last_error": F.when(shut, F.col("reason")).otherwise(F.col("last_error")),
        "delivered_us": F.when(shut, F.col("closed_us")).otherwise(F.col("delivered_us")),
    }).drop("closed_us", "reason")


def prune(events: DataFrame, time: str, now_us: int, keep_s: int) -> DataFrame:
    """Rows not older than the retention; one exactly that old stays."""
    return events.filter(F.col(time) >= now_us - keep_s * SECOND)
