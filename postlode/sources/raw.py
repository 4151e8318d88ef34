"""Landed inputs: payloads, pages, seed lists, and the split-off of broken payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import let, trim_ws
from ..functions.jsonld import let_last_key_win
from ..schema import PAYLOAD_SHAPE, RAW_DDL
from ..session import cut


def read_raw(spark: SparkSession, path: str, schema: str = RAW_DDL, fmt: str = "parquet", streaming: bool = False,
             max_files: int | None = None) -> DataFrame:
    """Landed payloads or pages as a batch or as a stream of new files."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schema).format(fmt).load(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Domains or URLs, one per line; text after ``#`` and blank lines are dropped."""
    value = trim_ws(F.split_part(F.col("value"), F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(value.alias("value")).where("value <> ''")


def broken(payload) -> F.Column:
    """Not JSON.  An object with a repeated key is JSON, though not a variant; its last value counts."""
    alone = F.get_json_object(F.concat(F.lit("["), F.col(payload), F.lit("]")), "$[0]")
    return F.try_parse_json(payload).isNull() & (alone.isNull() | F.get_json_object(F.concat(F.lit("["), F.col(payload), F.lit("]")), "$").isNull())


def payload_fault(provider: Column, payload: str) -> Column:
    """What is wrong with a payload; NULL if nothing is.

    ``unreadable``: no JSON.  ``kind``: a list where an object belongs, or the reverse.  ``shape``: the member that holds the
    postings is missing or no list, as in an error message sent instead of an answer.  Providers without a declared shape
    are only asked for JSON.
    """

    def judge(row: Column) -> Column:
        value = row["value"]
        is_list = F.try_variant_get(value, "$", "array<variant>").isNotNull()
        is_object = F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
        fault = F.when(row["broken"], "unreadable")
        for name, (kind, member) in PAYLOAD_SHAPE.items():
            here = row["provider"] == name
            fault = fault.when(here & ~(is_list if kind == "ARRAY" else is_object), "kind")
            if member:
                held = "map<string,variant>" if name.endswith("_detail") else "array<variant>"
                fault = fault.when(here & F.try_variant_get(value, f"$.{member}", held).isNull(), "shape")
        return fault

    return let(F.struct(F.try_parse_json(payload).alias("value"), broken(payload).alias("broken"), provider.alias("provider")), judge)


_REQUEST = ["provider", "board", "request_no"]


def payload_faults(raw: DataFrame) -> DataFrame:
    """``provider, board, request_no, fault`` of the faulty payloads, stored: the one pass that reads the payloads for it."""
    let_last_key_win(raw.sparkSession)
    rows = raw.select(*_REQUEST, payload_fault(F.col("provider"), "payload").alias("fault"))
    return cut(rows.where("fault IS NOT NULL"), "payload-faults")


def first_failures(faults: DataFrame) -> DataFrame:
    """``provider, board, failed_at``: the first request of each source that could not be read at all."""
    ended = faults.where(F.col("fault").isin("unreadable", "kind"))
    return ended.groupBy("provider", "board").agg(F.min("request_no").alias("failed_at"))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[k]) for k in names]


def split_broken(raw: DataFrame, earlier: DataFrame | None = None, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(usable, quarantined)``, the latter with its ``fault``.

    A source loses its first unreadable payload and everything requested after it (``after``); ``earlier`` has failures of
    earlier runs as ``provider, board, failed_at``.  A payload of the wrong shape is set aside by itself.  Other sources are
    not touched.  Faults are written out before they are joined back, so Spark knows their size: a short list is broadcast
    and the payloads are not moved; a long one is shuffled.  ``read`` is ``raw`` with what is to be observed on the one pass
    that reads the payloads.
    """
    faults = payload_faults(raw if read is None else read)
    failed = first_failures(faults)
    if earlier is not None:
        failed = failed.unionByName(earlier).groupBy("provider", "board").agg(F.min("failed_at").alias("failed_at"))
    failed = cut(failed, "failed-sources")
    own = faults.groupBy(*_REQUEST).agg(F.min("fault").alias("fault"))
    marked = raw.join(failed, _same(raw, failed, ["provider", "board"]), "left").select(raw["*"], "failed_at")
    marked = marked.join(own, _same(marked, own, _REQUEST), "left").select(marked["*"], own["fault"].alias("_fault"))
    lost = F.coalesce(F.col("request_no") >= F.col("failed_at"), F.lit(False)) | F.col("_fault").isNotNull()
    usable = marked.where(~lost).select(*raw.columns)
    return usable, marked.where(lost).select(*raw.columns, F.coalesce("_fault", F.lit("after")).alias("fault"))
