"""Parameter documents: routes and tuning, with defaults and clamps."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions.replies import MAX_SEVERITY, MIN_SEVERITY
from newsdesk.operators.decode import with_json

# Parameter defaults, and the floors applied when tuning is written.
DEFAULTS = {
    "model": "llama3.1:8b",
    "min_severity": 2,
    "poll_minutes": 10,
    "drip_seconds": 90,
    "max_per_drop": 1,
    "seen_path": "data/seen.json",
}
MIN_POLL_MINUTES = 1
MIN_DRIP_SECONDS = 5

TYPES = {
    "model": "string",
    "min_severity": "int",
    "poll_minutes": "bigint",
    "drip_seconds": "bigint",
    "max_per_drop": "int",
    "seen_path": "string",
}
# The severity floor is one byte.
LARGEST = {"min_severity": 255}
TUNING_KEYS = ("min_severity", "poll_minutes", "drip_seconds")


@dataclass(frozen=True)
class Params:
    """One parsed parameter document."""

    webhooks: dict[str, str] = field(default_factory=dict)
    model: str = DEFAULTS["model"]
    min_severity: int = DEFAULTS["min_severity"]
    poll_minutes: int = DEFAULTS["poll_minutes"]
    drip_seconds: int = DEFAULTS["drip_seconds"]
    max_per_drop: int = DEFAULTS["max_per_drop"]
    seen_path: str = DEFAULTS["seen_path"]

    @classmethod
    def from_json(cls, text: str) -> Params:
        """Parse a document; ``webhooks`` is required and unknown keys are ignored."""
        document = json.loads(text)
        known = {k: v for k, v in document.items() if k in cls.__dataclass_fields__}
        webhooks = known.get("webhooks")
        if not isinstance(webhooks, dict) or not all(isinstance(v, str) for v in webhooks.values()):
            raise ValueError("webhooks must be a map of strings")
        for name, kind in TYPES.items():
            value = known.get(name, DEFAULTS[name])
            if kind == "string":
                fits = isinstance(value, str)
            else:
                fits = type(value) is int and 0 <= value <= LARGEST.get(name, value)
            if not fits:
                raise ValueError(f"{name} has the wrong type")
        return cls(**known)

    def tuned(self, min_severity: int, poll_minutes: int, drip_seconds: int) -> Params:
        return replace(
            self,
            min_severity=min(max(min_severity, MIN_SEVERITY), MAX_SEVERITY),
            poll_minutes=max(poll_minutes, MIN_POLL_MINUTES),
            drip_seconds=max(drip_seconds, MIN_DRIP_SECONDS),
        )

    def ticks_per_poll(self) -> int:
        """Drip ticks between polls: the poll is due at the first tick past its period."""
        period, tick = self.poll_minutes * 60, max(self.drip_seconds, 1)
        return max(1, -(-period // tick))

    def poll_seconds(self) -> int:
        """Time between polls: the nominal period rounded up to whole drip ticks."""
        return self.ticks_per_poll() * max(self.drip_seconds, 1)

    def capacity_per_poll(self) -> int:
        return self.ticks_per_poll() * self.max_per_drop

    def routes(self, spark: SparkSession) -> DataFrame:
        return routes_of(spark.range(1).select(_map_literal(self.webhooks).alias("webhooks")))


def _map_literal(pairs: dict[str, str]) -> Column:
    parts = [F.lit(part) for pair in pairs.items() for part in pair]
    return F.create_map(*parts) if parts else F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")


def load_params(spark: SparkSession, path: str) -> Params:
    """Read one document from any file system Spark reaches."""
    return Params.from_json(spark.read.text(path, wholetext=True).head()[0])


def reload_params(spark: SparkSession, path: str, current: Params) -> Params:
    """The document as it is now, or ``current`` while it cannot be read."""
    try:
        return load_params(spark, path)
    except Exception:
        return current


def save_tuning(
    spark: SparkSession, path: str, min_severity: int, poll_minutes: int, drip_seconds: int
) -> None:
    """Clamp the three tuning keys and replace them in the document; other keys stay.

    Spark writes the document as a folder of one text file, which :func:`load_params`
    reads like a plain file. It is written beside the old one and then takes its place; if a
    crash comes between the two, the new document is still there under ``<path>.new``.
    """
    document = json.loads(spark.read.text(path, wholetext=True).head()[0])
    tuned = Params().tuned(min_severity, poll_minutes, drip_seconds)
    document.update({key: getattr(tuned, key) for key in TUNING_KEYS})
    text = json.dumps(document, indent=2, ensure_ascii=False)
    row = spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    row.write.mode("overwrite").text(f"{path}.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.rename(new, old)


def parsed_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Replace JSON documents by their typed parameters, defaults filled in.

    Only valid documents remain: ``webhooks`` must be an object of strings, and a knob
    that is present must be an unsigned integer (a string for names and paths).
    """
    webhooks = F.try_variant_get("_json", "$.webhooks", "map<string,variant>")
    valid = webhooks.isNotNull() & F.forall(
        F.map_values(webhooks), lambda v: F.schema_of_variant(v) == "STRING"
    )
    filled = []
    for name, kind in TYPES.items():
        value = F.try_variant_get("_json", f"$.{name}", "variant")
        typed = F.try_variant_get(value, "$", kind)
        if kind == "string":
            fits = F.schema_of_variant(value) == "STRING"
        else:
            fits = (F.schema_of_variant(value) == "BIGINT") & (typed >= 0)
        if name in LARGEST:
            fits = fits & (typed <= LARGEST[name])
        valid = valid & F.when(value.isNull(), F.lit(True)).otherwise(F.coalesce(fits, F.lit(False)))
        filled.append(F.coalesce(typed, F.lit(DEFAULTS[name]).cast(kind)).alias(name))
    urls = F.transform_values(webhooks, lambda _, v: F.try_variant_get(v, "$", "string"))
    rest = [c for c in documents.columns if c != column]
    return with_json(documents, column, "_json").where(valid).select(
        *rest, urls.alias("webhooks"), *filled
    )


def routes_of(params: DataFrame, *keys: str) -> DataFrame:
    """``category, channel`` rows of a webhooks map."""
    return params.select(*keys, F.explode("webhooks").alias("category", "channel"))


def bands_of(webhooks: Column) -> Column:
    """Configured bands in name order."""
    return F.array_sort(F.map_keys(webhooks))


def tuning_view(documents: DataFrame, column: str = "document") -> DataFrame:
    """Three knobs with defaults, and the configured bands, of every document.

    Unlike :func:`parsed_documents` this view tolerates any document: a knob that is not
    an unsigned integer shows its default.
    """


    def knob(name: str) -> Column:
        value = F.try_variant_get("_json", f"$.{name}", "variant")
        whole = F.try_variant_get(value, "$", "bigint")
        unsigned = F.when((F.schema_of_variant(value) == "BIGINT") & (whole >= 0), whole)
        return F.coalesce(unsigned, F.lit(DEFAULTS[name]).cast("bigint")).alias(name)

    webhooks = F.try_variant_get("_json", "$.webhooks", "map<string,variant>")
    bands = F.coalesce(bands_of(webhooks), F.array().cast("array<string>"))
    rest = [c for c in documents.columns if c != column]
    return with_json(documents, column, "_json").select(*rest, *[knob(k) for k in TUNING_KEYS], bands.alias("webhook_bands"))


def clamped_tuning(tuning: DataFrame) -> DataFrame:
    """Clamps applied when tuning is written."""
    return tuning.withColumns(
        {
            "min_severity": F.greatest(
                F.lit(MIN_SEVERITY), F.least(F.lit(MAX_SEVERITY), F.col("min_severity"))
            ),
            "poll_minutes": F.greatest(F.lit(MIN_POLL_MINUTES), F.col("poll_minutes")),
            "drip_seconds": F.greatest(F.lit(MIN_DRIP_SECONDS), F.col("drip_seconds")),
        }
    )
