"""Durations, relative times and strftime patterns."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from ..lang.ast import QueryError

_UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "w": 604800}
#: strftime tokens and the Java patterns for them.
TOKENS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD",
    "p": "a", "I": "hh", "f": "SSSSSS", "z": "xx", "Z": "z", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "3N": "SSS", "6N": "SSSSSS", "9N": "SSSSSSSSS",
}


def seconds(text: str) -> float:
    """'5m', '1h30m', '90' (seconds). Months have no fixed length: see months()."""
    text = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    if not re.fullmatch(r"(\d+(\.\d+)?(us|ms|sec|min|hr|[smhdw]))+", text):
        raise QueryError(f"unknown duration {text!r}")
    return sum(float(n) * _UNITS[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(us|ms|sec|min|hr|[smhdw])", text))


def months(text: str) -> int | None:
    m = re.fullmatch(r"(\d+)mon", text.strip())
    return int(m[1]) if m else None


def micros(text: str) -> int:
    n = round(seconds(text) * 1e6)
    if n <= 0:
        raise QueryError(f"a span must be positive: {text!r}")
    return n


def _snap(t: datetime, unit: str) -> datetime:
    if unit in ("s", "sec"):
        return t.replace(microsecond=0)
    if unit in ("m", "min"):
        return t.replace(second=0, microsecond=0)
    if unit in ("h", "hr"):
        return t.replace(minute=0, second=0, microsecond=0)
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "d":
        return day
    if m := re.fullmatch(r"w([0-6])?", unit):
        start = 1 if m[1] is None else int(m[1])  # 0 is Sunday; a bare week starts on Monday
        return day - timedelta(days=(day.isoweekday() - start) % 7)
    if unit == "mon":
        return day.replace(day=1)
    raise QueryError(f"unknown unit {unit!r} to snap to")


def resolve(text: str, now: datetime | None = None) -> datetime:
    """-1h, +5m, -1d@d, @w1, now, epoch seconds or ISO 8601, as a naive time in UTC."""
    now = (now or datetime.now(UTC)).replace(tzinfo=None)
    text = text.strip().strip('"')
    if text in ("now", "now()", ""):
        return now
    if m := re.fullmatch(r"([+-]?)(?:(\d+)([a-z]+?))?(?:@([a-z]+[0-6]?))?", text):
        sign, n, unit, snap = m.groups()
        t = now
        if n:
            if unit == "mon":
                month = t.year * 12 + t.month - 1 + (int(n) if sign == "+" else -int(n))
                t = t.replace(year=month // 12, month=month % 12 + 1, day=min(t.day, 28))
            elif unit in _UNITS:
                t += timedelta(seconds=(1 if sign == "+" else -1) * int(n) * _UNITS[unit])
            else:
                raise QueryError(f"unknown duration {text!r}")
        return _snap(t, snap) if snap else t
    if re.fullmatch(r"\d{9,}(\.\d+)?", text):
        return datetime.fromtimestamp(float(text), UTC).replace(tzinfo=None)
    try:
        t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise QueryError(f"unknown time {text!r}") from None
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def java_format(fmt: str) -> str:
    out, i, plain = "", 0, ""

    def flush():
        nonlocal plain, out
        if plain:
            out += "".join("''" if c == "'" else c for c in [plain]) if not re.search("[A-Za-z']", plain) else "'" + plain.replace("'", "''") + "'"
            plain = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            two = fmt[i + 1 : i + 3]
            key = two if two in TOKENS else fmt[i + 1]
            if key == "%":
                plain += "%"
                i += 2
                continue
            if key not in TOKENS:
                raise QueryError(f"unknown time token %{key}")
            flush()
            out += TOKENS[key]
            i += 1 + len(key)
        else:
            plain += fmt[i]
            i += 1
    flush()
    return out
