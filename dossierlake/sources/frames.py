"""Event records in frames: a magic byte, the id of the writer's schema, and a body in JSON or binary Avro.

The id, four bytes with the highest first, chooses the parser from a table of schemas; what a reader's field lacks in the
writer's schema is its default.  Records that are too short, begin with another byte, name no known schema, don't parse, or
lack a field that must be there become dead letters with a reason and their bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

#: first byte of a frame, and bytes before its body (fixed values)
MAGIC, HEADER = 0, 5


@dataclass(frozen=True)
class Schema:
    """A registered writer's schema: body is json or avro; a field that is not nullable must have a value."""

    id: int
    fields: StructType
    body: str = "json"


class Malformed(ValueError):
    """Bytes that are not of the schema."""


def frame_parts(value: Column) -> tuple[Column, Column, Column]:
    """(error, schema id, body) of a frame; id and body are null where the header is wrong."""
    error = F.when(value.isNull() | (F.octet_length(value) < HEADER), "TooShort").when(F.substring(value, 1, 1) != F.unhex(F.lit(f"{MAGIC:02x}")), "BadMagic")
    number = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")
    return error, F.when(error.isNull(), number), F.when(error.isNull(), F.substring(value, HEADER + 1, 2_147_483_647))


# --- Avro --------------------------------------------------------------------------------------------------------


class _Bytes:
    """Values of Avro's binary encoding, read one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed("cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A zigzag number, seven bits a byte, lowest first."""
        out = shift = 0
        while True:
            (byte,) = self.take(1)
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out >> 1 ^ -(out & 1)
            shift += 7
            if shift > 63:
                raise Malformed("number too long")

    def value(self, kind: DataType):
        if isinstance(kind, (LongType, IntegerType)):
            return self.number()
        if isinstance(kind, StringType):
            return self.take(self.number()).decode()
        if isinstance(kind, BooleanType):
            return self.take(1) == b"\x01"
        if isinstance(kind, DoubleType):
            return struct.unpack("<d", self.take(8))[0]
        if isinstance(kind, FloatType):
            return struct.unpack("<f", self.take(4))[0]
        if isinstance(kind, MapType):
            return dict(self.pairs(kind))
        raise TypeError(f"{kind.simpleString()} has no Avro form here")

    def pairs(self, kind: MapType) -> Iterator[tuple]:
        """Entries of a map, in blocks that tell their count, a negative one with the block's bytes behind it."""
        while count := self.number():
            if count < 0:
                count = -count
                self.number()
            for _ in range(count):
                yield self.take(self.number()).decode(), self.value(kind.valueType)

    def record(self, fields: StructType) -> dict:
        """A field that may be null is a union of null, first, and its type."""
        out = {}
        for f in fields:
            branch = self.number() if f.nullable else 1
            if branch not in (0, 1):
                raise Malformed("no such branch")
            out[f.name] = self.value(f.dataType) if branch else None
        if self.at != len(self.data):
            raise Malformed("bytes are left over")
        return out


def _avro(fields: StructType):
    """Column function: the record of a body, and whether it was well-formed."""
    kind = StructType([*[StructField(f.name, f.dataType) for f in fields], StructField("_fine", BooleanType())])

    @F.pandas_udf(kind)
    def decode(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for body in bodies:
            row = dict.fromkeys(kind.names) | {"_fine": False}
            if body is not None:
                try:
                    row = _Bytes(body).record(fields) | {"_fine": True}
                except (Malformed, UnicodeDecodeError):
                    pass
            out.append(tuple(row[n] for n in kind.names))
        return pd.DataFrame(out, columns=kind.names).astype(object).where(lambda d: d.notna(), None)

    return decode


# --- reading -----------------------------------------------------------------------------------------------------


def _json(fields: StructType):
    """The same for a JSON body, with Spark's own parser: one object and nothing behind it."""
    marked = StructType([StructField(f.name, f.dataType) for f in fields]).add("_corrupt", "string")

    def decode(body: Column) -> Column:
        text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
        row = F.from_json(text, marked, {"columnNameOfCorruptRecord": "_corrupt"})
        alone = F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")), F.lit(-1)) == 1
        fine = F.coalesce(row["_corrupt"].isNull() & alone, F.lit(False)) & text.isNotNull()
        return F.struct(*[row[f.name].alias(f.name) for f in fields], fine.alias("_fine"))

    return decode


def scan_frames(records: DataFrame, schemas: list[Schema], reader: StructType, defaults: dict | None = None, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of framed records: the reader's columns, or value, schema_id and error; other columns stay.

    A reader's field that a registered schema lacks must have a default, else the two do not go together, which is raised here.
    """
    defaults = defaults or {}
    for s in schemas:
        lacking = [f.name for f in reader if f.name not in s.fields.names and f.name not in defaults]
        if lacking:
            raise ValueError(f"schema {s.id} has no {', '.join(lacking)}, and the reader has no default for it")
    error, number, body = frame_parts(F.col(value))
    rows = records.withColumns({"_error": error, "_id": number, "_body": body})
    target = StructType([StructField(f.name, f.dataType) for f in reader])
    event, fault = F.lit(None).cast(target), F.lit("UnknownSchema")
    for s in schemas:
        own = F.col("_id") == s.id
        got = f"_s{s.id}"
        rows = rows.withColumn(got, (_avro if s.body == "avro" else _json)(s.fields)(F.when(own, F.col("_body"))))
        lost = F.lit(False)
        for f in s.fields:
            if not f.nullable:
                lost = lost | F.col(got)[f.name].isNull()
        fields = [(F.col(got)[f.name] if f.name in s.fields.names else F.lit(defaults[f.name])).cast(f.dataType).alias(f.name) for f in reader]
        event = F.when(own, F.struct(*fields)).otherwise(event)
        fault = F.when(own, F.when(~F.col(got)["_fine"], "BadBody").when(lost, "MissingField")).otherwise(fault)
    told = rows.withColumn("_error", F.coalesce("_error", F.when(F.col("_id").isNotNull(), fault)))
    others = [c for c in records.columns if c != value]
    # unnested, so that a filter on the error is not put before the parsers and runs them again
    told = told.select(*others, value, F.explode(F.array(F.struct("_id", "_error", event.alias("_event")))).alias("_f")).select(*others, value, "_f.*")
    return told.where("_error is null").select(*others, "_event.*"), told.where("_error is not null").select(*others, value, F.col("_id").alias("schema_id"), F.col("_error").alias("error"))
