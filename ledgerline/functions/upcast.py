"""Schema evolution by composed version steps.

Each version of an event has its schema, and a step takes the fields of one version to
those of the next.  A row of any known version is decoded with its own schema and taken
through all steps after it, so readers see the newest version only.  The steps are
composed when the plan is built: one projection with a branch per version.  Unknown
fields are ignored, fields that a payload lacks take their defaults, versions that are
not known are rejected.  ``compatibility`` says what a new schema breaks for readers of
the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fields = dict[str, Column]
CORRUPT = "_corrupt"
UNSUPPORTED, MALFORMED, MISSING = "UNSUPPORTED_VERSION", "MALFORMED", "MISSING_FIELD"

#: Types that hold every value of another one.
_WIDER = {(T.ByteType, T.ShortType), (T.ByteType, T.IntegerType), (T.ByteType, T.LongType), (T.ShortType, T.IntegerType), (T.ShortType, T.LongType),
          (T.IntegerType, T.LongType), (T.IntegerType, T.DoubleType), (T.ShortType, T.DoubleType), (T.ByteType, T.DoubleType),
          (T.FloatType, T.DoubleType), (T.DateType, T.TimestampNTZType)}


def _fits(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return old == new or (type(old), type(new)) in _WIDER


def compatibility(old: T.StructType, new: T.StructType, defaults: dict | None = None, path: str = "") -> list[str]:
    """What breaks when data of ``old`` is read as ``new``: fields that are gone, types that
    do not hold the old values, and new required fields without a default.  An empty
    list means that ``new`` may replace ``old``."""
    have, out = set(defaults or {}), []
    now = {f.name: f for f in new.fields}
    for f in old.fields:
        at = path + f.name
        if f.name not in now:
            out.append(f"{at}: removed")
        else:
            out += _type_problems(f.dataType, now[f.name].dataType, at)
            if f.nullable and not now[f.name].nullable and at not in have:
                out.append(f"{at}: required, was optional")
    was = {f.name for f in old.fields}
    out += [f"{path}{f.name}: new and required" for f in new.fields if f.name not in was and not f.nullable and path + f.name not in have]
    return out


def _type_problems(old: T.DataType, new: T.DataType, at: str) -> list[str]:
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return compatibility(old, new, path=f"{at}.")
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return _type_problems(old.elementType, new.elementType, f"{at}[]")
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        return _type_problems(old.keyType, new.keyType, f"{at}<key>") + _type_problems(old.valueType, new.valueType, f"{at}<value>")
    return [] if _fits(old, new) else [f"{at}: {old.simpleString()} to {new.simpleString()}"]


class Versions:
    """The versions of one event type, oldest first."""

    def __init__(self):
        self._names: list[str] = []
        self._schemas: dict[str, T.StructType] = {}
        self._aliases: dict[str, str] = {}
        self._steps: dict[str, Callable[[Fields], Fields]] = {}
        self._defaults: dict[str, dict[str, object]] = {}

    def add(self, name: str, schema: T.StructType, step: Callable[[Fields], Fields] | None = None, aliases: tuple = (), defaults: dict | None = None) -> Versions:
        """The next version.  ``step`` makes its fields from those of the version before;
        without one, fields of the same name are taken over, which is refused if the
        schemas are not compatible.  ``defaults`` stand for fields that are missing or null."""
        known = {name, *aliases}
        if known & set(self._aliases):
            raise ValueError(f"version {name} is known")
        if self._names and step is None:
            problems = compatibility(self._schemas[self._names[-1]], schema, defaults)
            if problems:
                raise ValueError(f"version {name} needs a step: " + "; ".join(problems))
        self._aliases |= {a: name for a in known}
        self._names.append(name)
        self._schemas[name], self._defaults[name] = schema, dict(defaults or {})
        self._steps[name] = step or (lambda fields: fields)
        return self

    @property
    def latest(self) -> str:
        return self._names[-1]

    def _typed(self, name: str, fields: Fields) -> Fields:
        """The fields of a version with their types and defaults; others are left out."""
        out = {}
        for f in self._schemas[name].fields:
            value = fields[f.name].cast(f.dataType) if f.name in fields else F.lit(None).cast(f.dataType)
            if f.name in self._defaults[name]:
                value = F.coalesce(value, F.lit(self._defaults[name][f.name]).cast(f.dataType))
            out[f.name] = value
        return out

    def _upcast(self, name: str, parsed: Column) -> Fields:
        fields = self._typed(name, {f.name: parsed[f.name] for f in self._schemas[name].fields})
        for later in self._names[self._names.index(name) + 1:]:
            fields = self._typed(later, self._steps[later](fields))
        return fields

    def decode(self, df: DataFrame, payload: str = "payload", version: str = "version", missing: str | None = None, out: str = "event") -> DataFrame:
        """``df`` with ``out`` (a struct of the newest version, null if rejected) and
        ``decode_error``.  A null version counts as ``missing`` (the oldest by default)."""
        own = F.coalesce(F.col(version), F.lit(missing or self._names[0]))
        name = F.lit(None).cast("string")
        for alias, of in self._aliases.items():
            name = F.when(own == alias, F.lit(of)).otherwise(name)
        rows = df.withColumn("_version", name)
        event, corrupt = F.lit(None), F.lit(None).cast("string")
        for v in self._names:
            schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in self._schemas[v].fields], T.StructField(CORRUPT, T.StringType())])
            rows = rows.withColumn(f"_p{v}", F.when(F.col("_version") == v, F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})))
            parsed = F.col(f"`_p{v}`")
            event = F.when(F.col("_version") == v, F.struct(*[c.alias(n) for n, c in self._upcast(v, parsed).items()])).otherwise(event)
            corrupt = F.coalesce(corrupt, parsed[CORRUPT])
        rows = rows.withColumns({"_event": event, "_bad": corrupt})
        required = [f.name for f in self._schemas[self.latest].fields if not f.nullable]
        lacks = F.lit(False)
        for n in required:
            lacks = lacks | F.col("_event")[n].isNull()
        error = (F.when(F.col("_version").isNull(), UNSUPPORTED).when(F.col(payload).isNull() | (F.trim(payload) == "") | F.col("_bad").isNotNull(), MALFORMED)
                 .when(lacks, MISSING))
        return rows.withColumn("decode_error", error).withColumn(out, F.when(F.col("decode_error").isNull(), F.col("_event"))).drop(
            "_version", "_event", "_bad", *[f"_p{v}" for v in self._names])
