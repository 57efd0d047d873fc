"""Model calls: overlapping, bounded in time, repeated, counted."""

import time

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from claimflow.operators.infer import batch_inference, extract
from claimflow.operators.inference import CallLimits, call_model
from claimflow.operators.meter import call_records, call_summary
from workload import extract as we

SF = "/root/testdata/sf0.001"


def asked(spark, n):
    """One partition, so that whatever overlaps does so within a task; every tenth row is skipped."""
    return spark.range(n).coalesce(1).select("id", F.lit("s").alias("s"), F.when(F.col("id") % 10 != 9, F.col("id").cast("string")).alias("u"))


def replies(spark, n, call, limits):
    df = asked(spark, n).withColumn("c", call_model(call, limits)("s", "u"))
    return df.select("id", "c.*").collect()


def test_slow_calls_overlap_in_input_order(spark):
    def slow(system, user):
        import time

        time.sleep(0.5)
        return user

    replies(spark, 1, slow, CallLimits())  # start the worker
    started = time.perf_counter()
    rows = replies(spark, 22, slow, CallLimits(lanes=10))
    assert time.perf_counter() - started < 0.5 * 20 * 0.7
    assert [(r.id, r.reply) for r in rows] == [(i, None if i % 10 == 9 else str(i)) for i in range(22)]
    assert all(r.attempts is None and r.success is None for r in rows if r.id % 10 == 9)


def test_a_call_that_hangs_is_a_row_with_an_error(spark):
    def hangs(system, user):
        import time

        if user == "3":
            time.sleep(60)
        return "r" + user

    started = time.perf_counter()
    for lanes in (1, 4):
        rows = replies(spark, 8, hangs, CallLimits(lanes=lanes, timeout_s=1.0))
        assert [r.reply for r in rows] == [None if i == 3 else f"r{i}" for i in range(8)]
        assert rows[3].error == "no reply within 1 s" and rows[3].attempts[0].latency_ms >= 1000 and not rows[3].success
    assert time.perf_counter() - started < 40


def test_failed_attempts_are_repeated_and_recorded(spark):
    def second_time(system, user):
        import time

        seen = globals().setdefault("_seen_by_test", {})
        seen[user] = seen.get(user, 0) + 1
        if seen[user] <= int(user) % 4:
            raise ValueError(f"try {seen[user]}")
        return str(time.time())

    rows = replies(spark, 9, second_time, CallLimits(lanes=3, retries=2, wait_s=0.01))
    for r in rows:
        needed = r.id % 4
        assert [a.success for a in r.attempts] == [False] * min(needed, 3) + [True] * (needed < 3)
        assert r.success == (needed < 3) and r.error == (None if needed < 3 else "try 3")
        assert r.latency_ms == pytest.approx(sum(a.latency_ms for a in r.attempts), abs=0.02)


def test_every_attempt_is_a_record_with_the_tokens_of_the_answered_one(spark):
    def call(system, user):
        if "7" in user:
            raise RuntimeError("down")
        return '{"patient_name": {"value": "Z", "confidence": 0.9}}'

    docs = spark.range(20).select(
        F.col("id").cast("string").alias("record_id"), F.col("id").cast("string").alias("document_id"), F.col("id").cast("string").alias("full_text"),
        F.lit("referral").alias("document_type"), F.lit(None).cast("double").alias("ocr_mean_confidence"), F.current_timestamp().alias("ingested_at"))
    records = call_records(extract(docs, call, limits=CallLimits(lanes=4, retries=1, wait_s=0.0))).collect()
    assert len(records) == 22 == len({r.call_id for r in records})
    assert sum(r.success for r in records) == 18 and all(r.input_tokens > 0 for r in records if r.success)
    assert all(r.input_tokens == 0 and r.cost_usd == 0.0 and r.error == "down" for r in records if not r.success)
    built_in = call_records(extract(docs))
    assert built_in.count() == 20 and call_summary(built_in).first().llm_calls == 20


def test_limits_do_not_change_replies(spark):
    def call(system, user):
        return '{"patient_name": {"value": "%s", "confidence": 0.9}}' % len(user)

    docs = spark.range(50).select("id", F.repeat(F.lit("x "), F.col("id").cast("int")).alias("safe_text"), F.lit("referral").alias("document_type"))
    got = [batch_inference(docs, call, limits=x).select("id", "fields").orderBy("id").collect() for x in (
        CallLimits(), CallLimits(lanes=7, timeout_s=20.0, retries=3))]
    assert got[0] == got[1]


def test_query_equals_sql(spark):
    assert compare(we.QUERIES["call_attempts"](spark, SF), connect(SF), we.ORACLES["call_attempts"]) == ""
