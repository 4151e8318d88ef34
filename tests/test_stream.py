"""Payload files as a stream: faults split off per batch, failures remembered, state read by the batch's own keys."""

import json
import os
from datetime import date
from urllib.parse import unquote, urlsplit

from pyspark.sql import functions as F

from postlode.plans.search import SearchSpec
from postlode.schema import RAW_DDL
from postlode.sources.raw import read_raw, split_broken
from postlode.streaming import ingest as S

SPEC = SearchSpec(as_of=date(2027, 3, 9))


def jobs(*names):
    return json.dumps({"jobs": [{"title": n, "company_name": "Quay", "url": f"https://quay.test/{n}"} for n in names]})


def landed(spark, *rows):
    return spark.createDataFrame([(p, b, n, "", body, None) for p, b, n, body in rows], RAW_DDL)


def test_faults_by_kind(spark):
    raw = landed(
        spark, ("remotive", None, 0, jobs("a")), ("remotive", None, 1, '{"error":"slow down"}'), ("remotive", None, 2, jobs("b")), ("remotive", None, 3, "[]"), ("remotive", None, 4, jobs("c")),
        ("lever", "x", 0, "[]"), ("lever", "x", 1, '{"ok":false}'), ("lever", "x", 2, "[]"), ("lever", "y", 5, "[]"), ("remoteok", None, 0, "<html>"), ("greenhouse", "g", 0, '{"jobs":null}'),
        ("greenhouse", "h", 0, '{"jobs":[],"jobs":[{"title":"twice"}]}'), ("workday_detail", "w", 0, '{"jobPostingInfo":{}}'), ("workday_detail", "w", 1, '{"jobPostingInfo":[]}'), ("own", None, 0, '"anything"'),
    )
    usable, lost = split_broken(raw)
    assert {(r["provider"], r["request_no"]): r["fault"] for r in lost.collect()} == {
        ("remotive", 1): "shape", ("remotive", 3): "kind", ("remotive", 4): "after", ("lever", 1): "kind", ("lever", 2): "after",
        ("remoteok", 0): "unreadable", ("greenhouse", 0): "shape", ("workday_detail", 1): "shape"} and lost.count() == 8
    assert usable.columns == raw.columns and usable.count() == 7


def test_stream_of_torn_files(spark, tmp_path):
    """A failure in the second run ends its source in the third; the same job from another source is dropped throughout."""
    runs = [
        [("remotive", None, 0, jobs("Rope maker", "Cook")), ("greenhouse", "q", 0, '{"jobs":[{"title":"Cook","company_name":"Quay","absolute_url":"https://g.test/1"}]}'), ("remotive", None, 1, jobs("Clerk"))],
        [("remotive", None, 2, "busy"), ("remotive", None, 3, jobs("Lost one")), ("greenhouse", "q", 1, '{"jobs":[{"title":"Mate","absolute_url":"https://g.test/2"}]}')],
        [("remotive", None, 4, jobs("Lost two")), ("greenhouse", "q", 2, '{"jobs":[{"title":"Mate again","absolute_url":"https://g.test/2/"},{"title":"Purser","absolute_url":"https://g.test/3"}]}')],
    ]
    where = {d: str(tmp_path / d) for d in ("in", "out", "state", "checkpoint")}
    for rows in runs:
        landed(spark, *rows).repartition(3).write.mode("append").parquet(where["in"])
        source = read_raw(spark, where["in"], streaming=True)
        S.stream_postings(source, SPEC, where["out"], where["state"], where["checkpoint"]).awaitTermination()
    out = spark.read.parquet(where["out"]).collect()
    found = sorted(r["title"] for r in out)
    assert [t for t in found if t != "Cook"] == ["Clerk", "Mate", "Purser", "Rope maker"] and found.count("Cook") == 1
    lost = spark.read.parquet(where["state"] + "/quarantine").collect()
    assert sorted((r["request_no"], r["fault"]) for r in lost) == [(2, "unreadable"), (3, "after"), (4, "after")]


def test_a_small_batch_reads_a_small_part_of_the_state(spark, tmp_path):
    def batch(low, high):
        ids = spark.range(low, high).withColumnRenamed("id", "seq")
        name = F.col("seq").cast("string")
        return ids.select("seq", F.concat(F.lit("https://s.test/"), name).alias("url"), F.concat(F.lit("T"), name).alias("title"), F.lit("C").alias("company"), F.lit("s").alias("source"))

    state = str(tmp_path / "state")
    assert S.dedupe_batch(batch(0, 5000), state, 0).count() == 5000
    assert S.dedupe_batch(batch(4998, 5003), state, 1).count() == 3

    def read(low, high):
        rows = S.keyed_state(batch(low, high).select(S.url_key(F.col("url")).alias("u")), f"{state}/urls", "u STRING", 9)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
        # The only filters are on folders, so every file that is opened returns rows and is named here.
        files = rows.select(F.input_file_name().alias("f")).distinct().collect()
        return sum(os.path.getsize(unquote(urlsplit(r["f"]).path)) for r in files)

    few, all_ = read(10, 14), read(0, 5000)
    assert 0 < few <= 8 / S.STATE_PARTS * all_
    assert S.dedupe_batch(batch(0, 5003), state, 2).count() == 0


def test_a_state_that_is_not_there_is_read_without_python(spark, tmp_path):
    state = S._stored(spark, f"{tmp_path}/none", "u STRING, part INT", 3)
    assert state.dtypes == [("u", "string"), ("part", "int"), ("batch", "bigint")] and state.isEmpty()
    assert "ExistingRDD" not in state._jdf.queryExecution().toString()
