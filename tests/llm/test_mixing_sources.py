"""Mixing: small sources, many sources, and the words taken against a plain count over the slots."""

import collections

import pytest

from claimflow.llm import mixing

KIND = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], KIND)


def test_small_sources_come_out_at_their_targets(spark):
    rows = [(100 * s + d, "w " * 10, f"s{s:02d}") for s in range(30) for d in range(2)]
    name = {i: s for i, _, s in rows}
    got = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(frame(spark, rows)).collect():
        got[name[r["doc_id"]]][0] += r["taken"]
        got[name[r["doc_id"]]][1] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = mixing.targets([20] * 30)
    assert [got[s][1] for s in sorted(got)] == pytest.approx(want)
    assert [got[s][0] for s in sorted(got)] == [round(t) for t in want]


@pytest.mark.parametrize("sizes", [[1, 1, 1, 5000], [3, 0, 400, 33, 65, 31, 32]])
def test_targets_and_words_of_any_sizes(spark, sizes):
    rows = [(1000 * s + d, " ".join(["w"] * min(17, n - 17 * d)), None if s == len(sizes) - 1 else f"{s:03d}")
            for s, n in enumerate(sizes) for d in range(-(-n // 17) or 1)]
    got = mixing.mix(frame(spark, rows), block=32).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["doc_id"] // 1000] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["doc_id"] // 1000]
    want = mixing.targets(sizes)
    assert {r["doc_id"] // 1000: r["target"] for r in got} == pytest.approx(dict(enumerate(want)))
    assert [taken[s] for s in range(len(sizes))] == [int(t + 0.5) for t in want]
    texts = mixing.mixed_documents(frame(spark, rows), block=32).collect()
    words = collections.Counter()
    for r in texts:
        words[r["doc_id"] // 1000] += len(r["text"].split())
    assert words == collections.Counter({s: n for s, n in taken.items() if n})


def test_many_sources_need_no_bound(spark):
    # More sources than the driver ever held; order, targets and slots are made in tasks.
    n = 120_000
    df = spark.range(n, numPartitions=8).selectExpr("id AS doc_id", "'a b c d' AS text", "'en' AS lang",
                                                    "lpad(cast(id AS string), 7, '0') AS source")
    rows = mixing.stored(mixing.placed(df, "doc_id", "text", "source", carry=False), "placed")
    plan = mixing.source_table(rows, 32, mixing.WEIGHTS, mixing.SHARE, mixing.LIMIT)
    got = plan.selectExpr("count(*)", "count(DISTINCT _at)", "max(_at)", "sum(_target)", "max(_target)").first()
    assert tuple(got)[:3] == (n, n, n - 1) and got[3] == pytest.approx(6 * n) and got[4] == 8
    assert plan.where("_at <> cast(_source AS long)").count() == 0
    want = mixing.targets([4] * n)[:3]
    assert [r["_target"] for r in plan.where("_at < 3").orderBy("_at").collect()] == pytest.approx(want)
    slots = mixing.slot_table(plan, 32, 4, 1)
    assert slots.selectExpr("sum(CASE WHEN _take = 32 THEN 4 ELSE _take END)").first()[0] == pytest.approx(6 * n, rel=0.1)


def test_every_shard_draws_from_every_large_source(spark):
    rows = [(s, "w " * 64_000, f"s{s}") for s in range(3)]
    placed = mixing.placed(frame(spark, rows), "doc_id", "text", "source", carry=False)
    plan = mixing.source_table(placed, 32, mixing.WEIGHTS, mixing.SHARE, mixing.LIMIT)
    slots = mixing.slot_table(plan, 32, 8, 5).collect()
    counts = collections.Counter((r["shard"], r["_at"]) for r in slots)
    for r in plan.collect():
        own = [counts[shard, r["_at"]] for shard in range(8)]
        assert sum(own) == r["_slots"] and min(own) > 0.8 * r["_slots"] / 8 and len(set(own)) > 1
        seen = collections.Counter(x["_block"] for x in slots if x["_at"] == r["_at"])
        assert max(seen.values()) - min(seen.get(b, 0) for b in range(r["_blocks"])) <= 1
