"""Values with a kind, and the coercion rules of the language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in a string.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


@dataclass
class Val:
    col: Column
    kind: str  # null string int float bool time array other
    literal: object = None
    dtype: str | None = None  # of a time column: timestamp, timestamp_ntz or date

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "array" if isinstance(t, T.ArrayType) else "other"


def number(v: Val) -> Column:
    """As double; null where it isn't a number."""
    if v.kind == "float":
        return v.col.cast("double")
    if v.kind == "int":
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "string":
        return F.when(v.col.rlike(NUMBER), v.col.try_cast("double"))
    if v.kind == "time":
        return epoch(v.col)
    return F.lit(None).cast("double")


def epoch(c: Column) -> Column:
    """Seconds since 1970 of a time in UTC, as double."""
    return micros(c) / F.lit(1e6)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def text(v: Val) -> Column:
    """As string; floats without a fraction lose the point."""
    if v.kind == "string":
        return v.col
    if v.kind == "float":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
    if v.kind == "array":
        return F.array_join(v.col.cast("array<string>"), "|||")
    if v.kind == "other":
        return F.to_json(v.col)
    if v.kind == "time":
        fraction = F.regexp_replace(F.date_format(v.col, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return v.col.cast("string")


def truth(v: Val) -> Column:
    """Two-valued: null, 0 and the empty string are false."""
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.numeric:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "string":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "null":
        return F.lit(False)
    return v.col.isNotNull()


def common(vals: list[Val]) -> tuple[list[Column], str]:
    """The values as one type."""
    kinds = {v.kind for v in vals if v.kind != "null"}
    if not kinds:
        return [v.col.cast("string") for v in vals], "string"
    if len(kinds) == 1:
        k = kinds.pop()
        return [v.col for v in vals], k
    if kinds <= {"int", "float"}:
        return [v.col.cast("double") for v in vals], "float"
    if "array" in kinds:
        return [v.col.cast("array<string>") if v.kind in ("array", "null") else F.when(v.col.isNotNull(), F.array(text(v))) for v in vals], "array"
    return [text(v) for v in vals], "string"


def compare(op: str, a: Val, b: Val) -> Column:
    """Two-valued comparison: numeric where both sides are numbers, else as times or strings; false with a null,
    but two null values are equal where neither is a literal."""
    if op == "=" and a.kind != "null" and b.kind != "null" and a.literal is None and b.literal is None:
        return F.coalesce(_compare("=", a, b), F.lit(False)) | (a.col.isNull() & b.col.isNull())
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        return other.col.isNull() if op == "=" else other.col.isNotNull() if op == "!=" else F.lit(False)
    return F.coalesce(_compare(op, a, b), F.lit(False))


def may_be_null(op: str, a: Val, b: Val) -> Column | None:
    """The comparison without its last step, null becoming false; None where nulls have a meaning of their own."""
    if "null" in (a.kind, b.kind) or op == "=" and a.literal is None and b.literal is None:
        return None
    return _compare(op, a, b)


_OPS = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def _compare(op: str, a: Val, b: Val) -> Column:
    f = _OPS[op]
    if a.numeric and b.numeric:
        return f(a.col, b.col)
    if a.kind == b.kind == "bool":
        return f(a.col, b.col)
    if "time" in (a.kind, b.kind):
        other = b if a.kind == "time" else a
        if other.kind == "time":
            if a.dtype == b.dtype:
                return f(a.col, b.col)
            if b.literal is not None and a.dtype:  # only the literal is cast, so that the comparison reaches the scan
                return f(a.col, b.col.cast(a.dtype))
            return f(a.col.cast("timestamp"), b.col.cast("timestamp"))
        if other.kind == "string":
            return f(*(x.col.cast("timestamp") if x.kind == "time" else x.col.try_cast("timestamp") for x in (a, b)))
        return f(number(a), number(b))
    if a.kind == b.kind == "string":
        if op in ("=", "!="):
            return f(a.col, b.col)
        x, y = number(a), number(b)
        if isinstance(b.literal, str):
            try:
                float(b.literal)
            except ValueError:
                return f(a.col, b.col)
        return F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(a.col, b.col))
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(text(a), text(b)))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if "null" in (a.kind, b.kind):
        return Val(F.lit(None).cast("double"), "float")
    if op == "+" and a.kind == b.kind == "string":
        return Val(F.concat(a.col, b.col), "string")
    if op in "+-" and a.kind == "time" and b.kind != "time":
        shift = F.make_dt_interval(secs=number(b).cast("decimal(18,6)"))
        return Val(a.col + shift if op == "+" else a.col - shift, "time")
    if a.kind == b.kind == "int":
        x, y = a.col.cast("long"), b.col.cast("long")
        if op == "/":
            return Val(F.when(y != 0, F.try_divide(x - F.try_mod(x, y), y).cast("long")), "int")
        if op == "%":
            return Val(F.try_mod(x, y), "int")
        return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), "int")
    x, y = number(a), number(b)
    if op == "/":
        return Val(F.try_divide(x, y), "float")
    if op == "%":
        return Val(F.lit(None).cast("long"), "int")
    return Val({"+": x + y, "-": x - y, "*": x * y}[op], "float")
