"""Driver-side time arguments. Instants are integer microseconds since the epoch, UTC."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MAX_SECONDS = 253_402_300_799  # 9999-12-31T23:59:59Z
_UNITS = {"ms": Decimal("0.001"), "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_STEP = re.compile(r"([0-9]*\.?[0-9]+)(ms|s|m|h|d|w)?")


def parse_instant(value: datetime | str | int | float) -> int:
    """Epoch seconds, or ISO-8601 with a zone, as microseconds."""
    if isinstance(value, bool):
        raise ValueError("an instant must be a number, text or datetime")
    if isinstance(value, datetime):
        moment = value
    else:
        text = str(value).strip()
        try:
            seconds = Decimal(text)
        except InvalidOperation:
            seconds = None
        if seconds is not None:
            if not seconds.is_finite() or not 0 <= seconds <= _MAX_SECONDS:
                raise ValueError(f"instant out of range: {value}")
            return int((seconds * 1_000_000).to_integral_value())
        try:
            moment = datetime.fromisoformat(text)
        except ValueError as exc:
            raise ValueError(f"instant must be ISO-8601 or epoch seconds: {value}") from exc
    if moment.tzinfo is None or moment.utcoffset() is None:
        raise ValueError("instant must include a timezone")
    return (moment - _EPOCH) // timedelta(microseconds=1)


def parse_step(value: str | int | float | None, start_us: int, end_us: int) -> int:
    """A step in microseconds: seconds, or a number with ms, s, m, h, d or w."""
    if value is None or value == "":
        return max(math.ceil((end_us - start_us) / 240), 1_000_000)
    match = _STEP.fullmatch(str(value).strip().lower())
    if match is None:
        raise ValueError(f"invalid step: {value}")
    step = int(Decimal(match.group(1)) * _UNITS[match.group(2) or "s"] * 1_000_000)
    if step <= 0:
        raise ValueError("step must be positive")
    return step
