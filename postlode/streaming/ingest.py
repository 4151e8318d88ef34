"""Incremental runs: new payload files in, new postings out, duplicates removed against everything kept so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import text_or_empty
from ..functions.urls import url_key
from ..operators.dedupe import dedupe_postings, posting_keys, title_key
from ..operators.enrich import enrich
from ..operators.skew import lookup
from ..plans.search import SearchSpec, postings_filter
from ..session import cut
from ..sources.postings import project_postings
from ..sources.raw import first_failures, split_broken
from ..sources.registry import normalize, providers_in

_URLS = "u STRING"
_TITLES = "t STRING, s STRING"
_FAILED = "provider STRING, board STRING, failed_at INT"
STATE_PARTS = 32  # folders of a state table, by the hash of the key


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(STATE_PARTS)).cast("int")


def _stored(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """Rows written by earlier batches; what a failed attempt of this batch left behind is not read."""
    try:
        stored = spark.read.schema(f"{schema}, batch BIGINT").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Made of columns: a frame of Python rows starts a Python worker on every core, to send nothing.
        nothing = F.from_json(F.lit("{}"), f"{schema}, batch BIGINT")
        return spark.range(0).select(nothing.alias("r")).select("r.*")
    return stored.where(F.col("batch") < batch_id)


def keyed_state(keys: DataFrame, path: str, schema: str, batch_id: int) -> DataFrame:
    """The part of a state table that can hold ``keys`` (one column): the folders of their hashes, of earlier batches.

    A small batch reads a small part of the state, however large that has grown; no batch reads more than all of it.
    """
    (name,) = keys.columns
    # At most one number per part.
    parts = [r["part"] for r in keys.select(_part(name).alias("part")).distinct().collect()]
    state = _stored(keys.sparkSession, path, f"{schema}, part INT", batch_id)
    return state.where(F.col("part").isin(parts)).drop("batch", "part")


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's part of a table.  A repeated batch replaces its own part and nothing else."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _put_keyed(df: DataFrame, key: str, path: str, batch_id: int) -> None:
    """Write one batch's keys into the folders of their hashes, one file each."""
    rows = df.withColumn("part", _part(key)).repartition("part")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch_id}")


def not_seen(batch: DataFrame, seen_urls: DataFrame, seen_titles: DataFrame, order_by: str = "seq") -> DataFrame:
    """Rows that no earlier decision rules out.

    The batch's distinct keys are looked up in the state, so each state table is hashed by key at most once and
    no popular key gathers rows; the hits, one per key, are then joined to the rows.
    """
    rows = batch.withColumns({
        "_u": url_key(F.col("url")), "_t": title_key(F.col("title"), F.col("company")),
        "_s": text_or_empty(F.col("source")),
    })
    urls = rows.where("_u IS NOT NULL").groupBy("_u").agg(F.count("*").alias("n"))
    urls = urls.join(seen_urls.select(F.col("u").alias("_u")), "_u", "left_semi").withColumn("_url_seen", F.lit(True))
    titles = rows.where("_t IS NOT NULL").groupBy("_t").agg(F.count("*").alias("n"))
    titles = titles.join(seen_titles.select(F.col("t").alias("_t"), F.col("s").alias("_owner")), "_t")
    rows = lookup(rows, urls, ["_u"], F.col(order_by))
    rows = lookup(rows, titles, ["_t"], F.col(order_by))
    fresh = F.col("_url_seen").isNull() & F.coalesce(F.col("_owner") == F.col("_s"), F.lit(True))
    return rows.where(fresh).select(*batch.columns)


def dedupe_batch(batch: DataFrame, state: str, batch_id: int, order_by: str = "seq") -> DataFrame:
    """Duplicates of one batch removed against itself and all earlier batches; the kept keys join the state.

    Equal to one run over all batches in arrival order, because a decision never changes once made.  Whole rows are
    stored once; what follows handles keys and row numbers only.
    """
    batch = cut(batch.withColumn("_row", F.monotonically_increasing_id()), "stream-batch")
    narrow = batch.select("_row", order_by, "url", "title", "company", "source")
    urls = narrow.select(url_key(F.col("url")).alias("u")).where("u IS NOT NULL").distinct()
    titles = narrow.select(title_key(F.col("title"), F.col("company")).alias("t")).where("t IS NOT NULL").distinct()
    seen_urls = keyed_state(urls, f"{state}/urls", _URLS, batch_id)
    seen_titles = keyed_state(titles, f"{state}/titles", _TITLES, batch_id)
    fresh = cut(not_seen(narrow, seen_urls, seen_titles, order_by), "stream-fresh")
    kept = cut(dedupe_postings(fresh, order_by), "stream-kept")
    keys = posting_keys(kept, order_by)
    _put_keyed(keys.where("u IS NOT NULL").select("u").distinct(), "u", f"{state}/urls", batch_id)
    owners = keys.where("t IS NOT NULL").select("t", "s").distinct()
    _put_keyed(owners.join(seen_titles, "t", "left_anti"), "t", f"{state}/titles", batch_id)
    return batch.join(kept.select("_row"), "_row", "left_semi").drop("_row")


def usable_batch(raw: DataFrame, state: str, out: str, batch_id: int) -> DataFrame:
    """The payloads of one (stored) batch that can be read, those behind a failure of an earlier batch left out.

    What is left out goes to ``out``, with its fault, and the failures of this batch to the state.
    """
    failed = f"{state}/failed"
    earlier = _stored(raw.sparkSession, failed, _FAILED, batch_id).groupBy("provider", "board").agg(F.min("failed_at").alias("failed_at"))
    usable, lost = split_broken(raw, earlier)
    lost = cut(lost, "stream-lost")
    _put(first_failures(lost), failed, batch_id)
    _put(lost, out, batch_id)
    return usable


def stream_postings(source: DataFrame, spec: SearchSpec, out: str, state: str, checkpoint: str,
                    to_postings: Callable[[DataFrame], DataFrame] | None = None, order_by: str = "seq",
                    quarantine: str | None = None) -> StreamingQuery:
    """Process the files that have arrived since the last run and append the matching postings to ``out``.

    ``to_postings`` turns a batch of the source into postings; by default the payloads that can be read are normalised by
    every registered provider, and the others go to ``quarantine`` (by default a folder of the state).  Output and state are
    partitioned by batch, so a batch repeated after a failure leaves no second copy.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        if to_postings:
            postings = to_postings(batch)
        else:
            raw = cut(batch, "stream-payloads")
            usable = usable_batch(raw, state, quarantine or f"{state}/quarantine", batch_id)
            postings = normalize(usable, spec.today, providers_in(raw) or None)
        kept = dedupe_batch(postings, state, batch_id, order_by)
        found = enrich(kept, spec.today, spec.summary_chars).where(postings_filter(spec))
        _put(project_postings(found, spec.include_description), out, batch_id)

    return (
        source.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
