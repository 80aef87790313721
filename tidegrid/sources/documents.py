"""Published state documents: assembly and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top-level fields each kind of document must have, and types of nested fields.
REQUIRED = {"live": ["schema_version", "market", "anomaly", "persistence"], "historical": ["schema_version", "historical", "attribution"]}
NUMBERS = {"live": ["anomaly.ensemble_score", "market.vix", "market.spx"], "historical": []}
ARRAYS = {"live": [], "historical": ["historical.dates", "historical.ensemble_scores"]}


def live_document(df: DataFrame, keys: list[str], market: dict[str, Column], anomaly: dict[str, Column], persistence: dict[str, Column], version: str = "2.0.0") -> DataFrame:
    """One JSON document per row."""
    def part(cols: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in cols.items()])

    doc = F.struct(F.lit(version).alias("schema_version"), part(market).alias("market"), part(anomaly).alias("anomaly"), part(persistence).alias("persistence"))
    return df.select(*keys, F.to_json(doc).alias("document"))


def _get(path: str) -> Column:
    return F.try_variant_get("_json", f"$.{path}", "variant")


def validate_documents(df: DataFrame, keys: list[str], doc: str, kind: str) -> DataFrame:
    """One row per violation: missing fields (critical), wrong types (error), a score outside 0..1
    or arrays of unequal length (warning). Each document is parsed once; types come from the parsed
    JSON, not from casts."""
    parsed, fields = F.col("_json"), sorted({*REQUIRED[kind], *NUMBERS[kind], *ARRAYS[kind]})
    value = lambda f: F.col(f"_at.`{f}`")
    found: list[tuple[Column, str, str]] = [(parsed.isNull(), "critical", "document is null or not JSON")]
    for f in REQUIRED[kind]:
        found.append((parsed.isNotNull() & value(f).isNull(), "critical", f"missing required field {f}"))
    numeric = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$"
    for f in NUMBERS[kind]:
        found.append((value(f).isNotNull() & ~F.schema_of_variant(value(f)).rlike(numeric), "error", f"{f} is not a number"))
    for f in ARRAYS[kind]:
        found.append((value(f).isNotNull() & ~F.schema_of_variant(value(f)).startswith("ARRAY"), "error", f"{f} is not an array"))
    if kind == "live":
        s = F.try_variant_get("_json", "$.anomaly.ensemble_score", "double")
        found.append(((s < 0) | (s > 1), "warning", "score out of range"))
    else:
        n = [F.size(F.try_variant_get("_json", f"$.{f}", "array<variant>")) for f in ARRAYS[kind]]
        found.append((F.coalesce(n[0] != n[1], F.lit(False)) & (n[0] >= 0) & (n[1] >= 0), "warning", "array lengths differ"))
    d = df.withColumn("_json", F.try_parse_json(F.col(doc)))
    d = d.withColumn("_at", F.struct(*[_get(f).alias(f) for f in fields]))
    rows = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("violation"))) for c, sev, msg in found])
    out = d.select(*keys, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("v"))
    return out.select(*keys, "v.severity", "v.violation")
