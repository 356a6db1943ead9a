"""The keyed rules as single steps: (state, time) -> (state, verdict).

What the array operations of the streams are held against.  Times are whole microseconds.
"""

from __future__ import annotations

from emberlog import fixed_values as V

SECOND = 1_000_000
FORGET = V.STATE_RETENTION_S * SECOND


def storm_step(state: dict | None, now: int) -> tuple[dict, str, bool]:
    """Fingerprint layer.  State: seen, count, sent, storm (time of the last storm page)."""
    if state is None or now - state["seen"] > FORGET:
        return {"seen": now, "count": 1, "sent": now, "storm": None}, V.FIRST_SEEN, True
    same_run = now - state["seen"] <= V.STORM_GAP_S * SECOND
    count = state["count"] + 1 if same_run else 1
    storm = state["storm"] if same_run else None
    sent = state["sent"]
    if count >= V.STORM_THRESHOLD:
        send = storm is None or now - storm >= V.STORM_SUMMARY_S * SECOND
        status = V.STORM if send else V.STORM_HELD
        if send:
            storm = now
    else:
        send = now - sent >= V.REPEAT_SUMMARY_S * SECOND
        status = V.REPEAT if send else V.DUPLICATE
    return {"seen": now, "count": count, "sent": now if send else sent, "storm": storm}, status, send


def class_step(state: dict | None, now: int) -> tuple[dict, str, bool]:
    """Class layer.  State: seen, window, count, total, sent, storm."""
    if state is None or now - state["seen"] > FORGET:
        fresh = {"seen": now, "window": now, "count": 1, "total": 1, "sent": now, "storm": None}
        return fresh, "class_new", True
    new = dict(state, seen=now, total=state["total"] + 1)
    if now - state["window"] > V.CLASS_STORM_WINDOW_S * SECOND:
        new["window"], new["count"] = now, 1
    else:
        new["count"] += 1
    quiet = state["storm"] is None or now - state["storm"] >= V.CLASS_STORM_COOLDOWN_S * SECOND
    if new["count"] >= V.CLASS_STORM_N and quiet:
        new["sent"] = new["storm"] = now
        return new, "class_storm_summary", True
    if now - state["sent"] >= V.CLASS_COOLDOWN_S * SECOND:
        new["sent"] = now
        return new, "class_cooldown_expired", True
    return new, "class_cooldown", False


def throttle_step(state: dict | None, now: int, row_id: int, cooldown: int) -> tuple[dict, bool]:
    """Gateway throttle.  State: time and id of the last accepted row."""
    if state is None or now - state["us"] >= cooldown:
        return {"us": now, "id": row_id}, True
    return state, False
