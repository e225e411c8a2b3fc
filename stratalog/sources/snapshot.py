"""JSON snapshots: {"rows": [{"key": ..., "value": ...}]} or the bare array."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.errors import InvalidInput
from stratalog.schema import PUT

# The demo rows, in order.
DEMO = [
    ("user:1", "alice"),
    ("user:2", "bob"),
    ("user:3", "carol"),
    ("order:1001", "paid"),
    ("order:1002", "pending"),
    ("feature:bloom", "enabled"),
]
#: The time of an export as text, in UTC.
MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def number_text(x: Column) -> Column:
    """A double as a browser writes it: plain digits from 1e-6 to below 1e21, a signed exponent elsewhere, no trailing zero or point."""
    java = F.abs(x).cast("string")  # digits, a point and digits, then perhaps E and an exponent
    mantissa = F.regexp_extract(java, r"^([0-9.]+)", 1)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    shift = F.coalesce(F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    digits = F.ltrim(F.concat(whole, part), F.lit("0"))
    lead = F.length(F.concat(whole, part)) - F.length(digits)
    point = F.length(whole) + shift - lead  # where the point stands, counted from the first digit
    digits = F.rtrim(digits, F.lit("0"))
    n = F.length(digits)
    exponent = point - 1
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.abs(exponent).cast("string"))
    plain = F.when(point >= n, F.rpad(digits, point, F.lit("0"))).when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    text = F.when((point > 21) | (point < -5), scientific).otherwise(plain)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def browser_text(v: Column) -> Column:
    """A variant as a browser makes text of it: objects have one text, arrays join their members' texts by commas. Members that are arrays themselves are joined as their JSON."""
    kind = F.schema_of_variant(v)

    def scalar(x: Column, kind: Column) -> Column:
        number = number_text(F.try_variant_get(x, "$", "double"))
        return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number).when(kind.startswith("OBJECT"), "[object Object]").otherwise(F.try_variant_get(x, "$", "string"))

    members = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda m: F.coalesce(scalar(m, F.schema_of_variant(m)), F.lit("")))
    return F.when(kind.startswith("ARRAY"), F.array_join(members, ",")).otherwise(scalar(v, kind))


def parse_rows(doc: Column) -> Column:
    """The rows of a snapshot text in either form, as (key, value) texts; a key or value that is missing or null is an empty text, and a text that isn't JSON has no rows."""
    whole = F.try_parse_json(doc)
    rows = F.coalesce(F.try_variant_get(whole, "$.rows", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    text = lambda r, name: F.coalesce(browser_text(F.try_variant_get(r, f"$.{name}", "variant")), F.lit(""))
    return F.transform(rows, lambda r: F.struct(text(r, "key").alias("key"), text(r, "value").alias("value")))


def import_log(docs: DataFrame, column: str = "doc", first_seq: int = 1) -> DataFrame:
    """Snapshots as puts. Rows with an empty key are skipped; pos is the row's place, so later rows win."""
    rows = docs.select(F.posexplode(parse_rows(F.col(column))).alias("pos", "r"))
    return rows.where(F.col("r.key") != "").select((F.col("pos") + first_seq).cast("bigint").alias("seq"), F.lit(PUT).cast("tinyint").alias("op"), F.col("r.key").alias("key"), F.col("r.value").alias("value"))


def load(spark: SparkSession, text: str) -> DataFrame:
    """import_log() of one text; a text without a usable row is an error, as in an upload form."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise InvalidInput(f"the snapshot isn't JSON: {e}") from e
    rows = data.get("rows") if isinstance(data, dict) else data
    if not any(isinstance(r, dict) and r.get("key") not in (None, "") for r in (rows if isinstance(rows, list) else [])):
        raise InvalidInput("the snapshot has no rows")
    return import_log(spark.createDataFrame([(text,)], "doc string"))


def export_json(rows: DataFrame, prefix: str, exported_at: Column | None = None) -> DataFrame:
    """One row with the snapshot text of a scan already limited: it gathers that scan in a single value. exported_at is now unless it is given."""
    moment = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), MOMENT) if exported_at is None else exported_at
    ordered = F.array_sort(F.collect_list(F.struct("key", "value")))
    return rows.agg(ordered.alias("rows")).select(F.to_json(F.struct(moment.alias("exported_at"), F.lit(prefix).alias("prefix"), F.col("rows"))).alias("snapshot"))


def demo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, PUT, *row) for k, row in enumerate(DEMO, 1)], "seq long, op int, key string, value string")
