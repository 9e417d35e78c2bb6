"""Expression and search trees to Spark columns, for one DataFrame's schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.ast import Bin, Call, Compare, Field, FString, Glob, Junction, Lit, OneOf, QueryError, Test, Time, Un, Word
from . import coerce, times
from .coerce import Val
from .patterns import glob_to_regex, is_glob, java_regex, quote, required_literal
from .scalar import FUNCTIONS, json_path, null

ALIASES = {"source": "_source", "_source": "source", "sourcetype": "_sourcetype", "_sourcetype": "sourcetype", "_index": "index", "timestamp": "_time"}
EXTENSIONS: dict = {}


def register_function(name: str, make) -> None:
    """make(compiler, argument trees) -> Val, callable by that name in queries."""
    EXTENSIONS[name.lower()] = make


class Compiler:
    def __init__(self, df: DataFrame, now: datetime | None = None):
        self.df, self.schema, self.now = df, {f.name: f.dataType for f in df.schema.fields}, now

    # fields
    def field(self, name: str) -> Val:
        """A column; an alias; a path into a struct or JSON column; a key of the raw JSON; else null."""
        for n in (name, ALIASES.get(name)):
            if n in self.schema:
                kind = coerce.kind_of(self.schema[n])
                return Val(F.col(f"`{n}`"), kind, dtype=self.schema[n].simpleString() if kind == "time" else None)
        root, dot, rest = name.partition(".")
        bracket = root.find("[")
        if bracket > 0:
            root, rest, dot = root[:bracket], name[bracket:], "."
        if dot and root in self.schema:
            kind = self.schema[root]
            if isinstance(kind, T.StructType):
                at, c = kind, F.col(f"`{root}`")
                for step in rest.split("."):
                    if not isinstance(at, T.StructType) or step not in at.names:
                        return null()
                    at, c = at[step].dataType, c[step]
                return Val(c, coerce.kind_of(at))
            if isinstance(kind, T.StringType):
                return Val(F.get_json_object(F.col(f"`{root}`"), json_path(rest)), "string")
            return null()
        if "_raw" in self.schema and not name.startswith("_"):
            raw = F.col("_raw")
            paths = [json_path(name)] + ([f"$['{name}']"] if dot else [])
            return Val(F.coalesce(*[F.get_json_object(raw, p) for p in paths]) if len(paths) > 1 else F.get_json_object(raw, paths[0]), "string")
        return null()

    # expressions
    def __call__(self, e) -> Val:
        if isinstance(e, Lit):
            v = e.value
            if v is None:
                return null()
            kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
            return Val(F.lit(v).cast("long") if kind == "int" else F.lit(v), kind, v)
        if isinstance(e, Field):
            return self.field(e.name)
        if isinstance(e, Time):
            if e.text[:1].isdigit() and not e.text[:4].isdigit():
                return Val(F.lit(times.seconds(e.text)), "float", times.seconds(e.text))
            return Val(F.lit(times.resolve(e.text, self.now)).cast("timestamp_ntz"), "time", e.text, "timestamp_ntz")
        if isinstance(e, Call):
            make = EXTENSIONS.get(e.name) or FUNCTIONS.get(e.name)
            if make is None:
                raise QueryError(f"unknown function {e.name}()")
            return make(self, e.args)
        if isinstance(e, FString):
            return Val(F.concat(*[coerce.text(self(p)) for p in e.parts]), "string")
        if isinstance(e, Glob):
            return Val(self._raw_like(e.pattern), "bool")
        if isinstance(e, Un):
            if e.op == "not":
                return Val(~self.truth(e.arg), "bool")
            v = self(e.arg)
            return Val(-v.col, "int") if v.kind == "int" else Val(-coerce.number(v), "float")
        if isinstance(e, Test):
            c = self._test(e)
            return Val(~c if e.negated else c, "bool")
        if isinstance(e, Bin):
            return self._binary(e)
        raise QueryError(f"cannot compile {e!r}")

    def truth(self, e) -> Column:
        return coerce.truth(self(e))

    def condition(self, e) -> Column:
        """What a filter keeps. A filter takes null for false, so where only AND and OR stand above a comparison it is left
        as it is, in the form that Parquet scans can use."""
        if isinstance(e, Bin) and e.op in ("and", "or"):
            a, b = self.condition(e.left), self.condition(e.right)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Bin) and e.op in ("=", "!=", "<", "<=", ">", ">=") and not isinstance(e.right, Glob) and not (isinstance(e.right, Lit) and isinstance(e.right.value, str) and is_glob(e.right.value)):
            c = coerce.may_be_null(e.op, self(e.left), self(e.right))
            return self.truth(e) if c is None else c
        if isinstance(e, Test) and e.op == "between" and not e.negated:
            return self.condition(Bin("and", Bin(">=", e.arg, e.others[0]), Bin("<=", e.arg, e.others[1])))
        if isinstance(e, Test) and e.op == "in" and not e.negated:
            v = self(e.arg)
            if v.kind in ("int", "float", "string") and all(isinstance(x, Lit) and type(x.value) in ((int, float) if v.numeric else (str,)) for x in e.others):
                return v.col.isin([x.value for x in e.others])
        return self.truth(e)

    def compare(self, op: str, a: Val, b: Val) -> Column:
        return coerce.compare(op, a, b)

    def _binary(self, e: Bin) -> Val:
        if e.op == "and":
            return Val(self.truth(e.left) & self.truth(e.right), "bool")
        if e.op == "or":
            return Val(self.truth(e.left) | self.truth(e.right), "bool")
        if e.op == "xor":
            return Val(self.truth(e.left) != self.truth(e.right), "bool")
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            if e.op in ("=", "!=") and (isinstance(e.right, Glob) or isinstance(e.right, Lit) and isinstance(e.right.value, str) and is_glob(e.right.value)):
                pattern = e.right.pattern if isinstance(e.right, Glob) else e.right.value
                left = coerce.text(self(e.left))
                hit = left.rlike(f"(?s)^{glob_to_regex(pattern)}$")
                return Val(F.coalesce(hit if e.op == "=" else ~hit, F.lit(False)), "bool")
            return Val(self.compare(e.op, self(e.left), self(e.right)), "bool")
        if e.op == "concat":
            return Val(F.concat(coerce.text(self(e.left)), coerce.text(self(e.right))), "string")
        return coerce.arithmetic(e.op, self(e.left), self(e.right))

    def _test(self, e: Test) -> Column:
        v = self(e.arg)
        if e.op == "null":
            return v.col.isNull() if v.kind != "null" else F.lit(True)
        if e.op == "in":
            if v.kind in ("int", "float", "string") and all(isinstance(x, Lit) and type(x.value) in ((int, float) if v.numeric else (str,)) for x in e.others):
                return F.coalesce(v.col.isin([x.value for x in e.others]), F.lit(False))
            out = F.lit(False)
            for x in e.others:
                out = out | self.compare("=", v, self(x))
            return out
        if e.op == "between":
            return self.compare(">=", v, self(e.others[0])) & self.compare("<=", v, self(e.others[1]))
        pattern = e.others[0]
        if not isinstance(pattern, Lit):
            raise QueryError(f"{e.op} needs a constant pattern")
        if e.op == "like":
            return F.coalesce(coerce.text(v).ilike(str(pattern.value).replace("\\", "\\\\")), F.lit(False))
        return self.regex(coerce.text(v), str(pattern.value))

    def regex(self, c: Column, pattern: str) -> Column:
        """An unanchored match, behind a test for a string that every match contains."""
        hit = c.rlike(java_regex(pattern))
        part = required_literal(pattern)
        return F.coalesce(F.contains(c, F.lit(part)) & hit if part else hit, F.lit(False))

    def _raw_like(self, glob: str) -> Column:
        raw = self.raw()
        return F.coalesce(raw.rlike(f"(?is){glob_to_regex(glob)}"), F.lit(False))

    def raw(self) -> Column:
        """The raw text; without one, all string columns joined by spaces."""
        if "_raw" in self.schema:
            return F.col("_raw")
        names = [f"`{n}`" for n, t in self.schema.items() if isinstance(t, T.StringType)]
        return F.concat_ws(" ", *names) if names else F.lit(None).cast("string")

    # search
    def search(self, tree) -> Column:
        if tree is None:
            return F.lit(True)
        if isinstance(tree, Junction):
            parts = [self.search(p) for p in tree.parts]
            if tree.op == "not":
                return ~parts[0]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if tree.op == "and" else out | p
            return out
        if isinstance(tree, Word):
            return F.coalesce(self._word(tree), F.lit(False))
        if isinstance(tree, OneOf):
            out = F.lit(False)
            for v in tree.values:
                out = out | self._equals(self.field(tree.field), v)
            return out
        return self._compare(tree)

    def _word(self, w: Word) -> Column:
        raw = self.raw()
        if w.mode == "case":
            return F.contains(raw, F.lit(w.text))
        if w.mode == "term":
            return raw.rlike(rf"(?i)(?<![A-Za-z0-9_]){quote(w.text)}(?![A-Za-z0-9_])")
        if w.text == "*":
            return F.lit(True)
        if is_glob(w.text):
            return raw.rlike(f"(?is){glob_to_regex(w.text)}")
        return F.contains(F.lower(raw), F.lit(w.text.lower()))

    def _equals(self, v: Val, value: str) -> Column:
        if v.kind == "null":
            return F.lit(False)
        s = coerce.text(v)
        if value == "*":
            return v.col.isNotNull()
        if is_glob(value):
            return F.coalesce(s.rlike(f"(?is)^{glob_to_regex(value, path='/' in value)}$"), F.lit(False))
        if v.numeric:
            try:
                return F.coalesce(v.col == F.lit(float(value) if v.kind == "float" or "." in value else int(value)), F.lit(False))
            except ValueError:
                return F.lit(False)
        return F.coalesce(F.lower(s) == F.lit(value.lower()), F.lit(False))

    def _compare(self, c: Compare) -> Column:
        v = self.field(c.field)
        if c.op == "=":
            return self._equals(v, c.value)
        if c.op == "!=":
            return v.col.isNotNull() & ~self._equals(v, c.value) if v.kind != "null" else F.lit(False)
        if v.kind == "time":
            return self.compare(c.op, v, Val(F.lit(times.resolve(c.value, self.now)).cast("timestamp_ntz"), "time"))
        try:
            n = float(c.value)
            return self.compare(c.op, v, Val(F.lit(n), "float", n))
        except ValueError:
            return self.compare(c.op, v, Val(F.lit(c.value), "string", c.value))
