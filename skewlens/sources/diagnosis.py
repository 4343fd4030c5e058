"""What is wrong with a payload record: each required field that is missing or has another type.

Spark's JSON reader gives NULL for both (and for all other fields of such a record).  Here a record is a VARIANT, and each required
field is looked up by its path, so a record with several faults names them all and its other fields stay readable.
The reasons are ``malformed record``, ``missing <field>`` and ``wrong type <field>``, in the order of the schema, each once.

A string is wanted as a JSON string, a number as a JSON whole number in the range of its column.  JSON null counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.schemas import JOB, JOB_REQUIRED, STAGE_ATTEMPT, STAGE_REQUIRED, TASK, TASK_REQUIRED

_NUMBERS = {T.LongType: "bigint", T.IntegerType: "int"}


def _at(struct: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = struct
    for name in path.split("."):
        kind = kind[name].dataType
    return kind


def _wrong(record: Column, path: str, kind: T.DataType) -> Column:
    """Whether the (present) field has another type."""
    own = F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
    if type(kind) in _NUMBERS:
        return (own != "BIGINT") | F.try_variant_get(record, f"$.{path}", _NUMBERS[type(kind)]).isNull()
    if isinstance(kind, T.ArrayType):
        return F.try_variant_get(record, f"$.{path}", kind.simpleString()).isNull()
    return ~own.startswith("OBJECT") if isinstance(kind, T.MapType) else own != "STRING"


def _faults(record: Column, struct: T.StructType, required: Sequence[str]) -> list[tuple[str, Column, Column]]:
    """(field, whether it is missing, whether it has another type)."""
    out = []
    for path in required:
        got = F.try_variant_get(record, f"$.{path}", "variant")
        missing = got.isNull() | F.is_variant_null(got)
        out.append((path, missing, F.when(missing, False).otherwise(_wrong(record, path, _at(struct, path)))))
    return out


def _texts(field: str) -> list[str]:
    return [f"missing {field}", f"wrong type {field}"]


def _found(record: Column, struct: T.StructType, required: Sequence[str], prefix: str = "") -> Column:
    """array<string> of one record's faults."""
    texts = [F.when(cond, F.lit(text)) for field, *conds in _faults(record, struct, required)
             for cond, text in zip(conds, _texts(prefix + field))]
    return F.array_compact(F.array(*texts))


def _shape(struct: T.StructType, required: Sequence[str]) -> str:
    """The text of a record's type that has exactly the required fields, all of their type."""
    parts = []
    for f in sorted(struct.fields, key=lambda f: f.name):
        below = [p[len(f.name) + 1:] for p in required if p.startswith(f"{f.name}.")]
        if below:
            parts.append(f"{f.name}: {_shape(f.dataType, below)}")
        elif f.name in required:
            parts.append(f"{f.name}: {'BIGINT' if type(f.dataType) in _NUMBERS else 'STRING'}")
    return f"OBJECT<{', '.join(parts)}>"


def _found_in(struct: T.StructType, required: Sequence[str], prefix: str):
    """The faults of a value; one of the usual type has none and is not looked at field by field."""
    usual = [_shape(struct, required), _shape(struct, [*required, *(f.name for f in struct.fields if not isinstance(f.dataType, T.StructType))])]
    return lambda record: F.when(F.schema_of_variant(record).isin(*usual), F.array().cast("array<string>")).otherwise(
        _found(record, struct, required, prefix))


def reasons(record: Column, struct: T.StructType, required: Sequence[str],
            nested: dict[str, tuple[T.StructType, Sequence[str]]] | None = None) -> Column:
    """array<string> of what is wrong with a record, a VARIANT that is NULL if the text is no JSON (empty: nothing).

    ``nested`` names map fields whose every value must have further fields.
    """
    parts = [_found(record, struct, required)]
    for field, (kind, fields) in (nested or {}).items():
        values = F.map_values(F.try_variant_get(record, f"$.{field}", "map<string,variant>"))
        each = F.flatten(F.transform(values, _found_in(kind, fields, f"{field}.")))
        # In the order of the schema, whatever value has the fault.
        every = F.array(*[F.lit(text) for path in fields for text in _texts(f"{field}.{path}")])
        parts.append(F.coalesce(F.array_intersect(every, each), F.array().cast("array<string>")))
    return F.when(record.isNull(), F.array(F.lit("malformed record"))).otherwise(F.concat(*parts))


def _lines(spark: SparkSession, path, app_id: str | None) -> DataFrame:
    lines = spark.read.text(path)
    given = F.lit("" if app_id is None else app_id)
    app = F.coalesce(F.col("app_id").cast("string"), given) if "app_id" in lines.columns else given
    lines = lines.where(F.length(F.trim("value")) > 0).select(app.alias("app_id"), "value")
    return lines.withColumn("_record", F.try_parse_json("value"))           # parsed once, looked at often


def diagnose_stages(spark: SparkSession, path, app_id: str | None = None) -> DataFrame:
    """(app_id, stageId, attemptId, reasons, value), one row per JSON line of stage attempts; ids where they can be read."""
    record, why = F.col("_record"), reasons(F.col("_record"), STAGE_ATTEMPT, STAGE_REQUIRED, {"tasks": (TASK, TASK_REQUIRED)})
    return _lines(spark, path, app_id).select("app_id", F.try_variant_get(record, "$.stageId", "bigint").alias("stageId"),
                                              F.try_variant_get(record, "$.attemptId", "int").alias("attemptId"),
                                              why.alias("reasons"), "value")


def diagnose_jobs(spark: SparkSession, path, app_id: str | None = None) -> DataFrame:
    """(app_id, jobId, reasons, value), one row per JSON line of jobs; the id where it can be read."""
    record, why = F.col("_record"), reasons(F.col("_record"), JOB, JOB_REQUIRED)
    return _lines(spark, path, app_id).select("app_id", F.try_variant_get(record, "$.jobId", "int").alias("jobId"),
                                              why.alias("reasons"), "value")
