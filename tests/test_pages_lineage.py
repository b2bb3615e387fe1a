import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hireloom.operators import catalog as c
from hireloom.operators import metrics, resumes, tracking


def _postings(spark, count=500):
    rnd = random.Random(1)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rnd.randrange(20))
    rows = [(i, None if rnd.random() < 0.2 else day(), day()) for i in range(count)]
    return spark.createDataFrame(rows, "posting_id long, posted_at timestamp, created_at timestamp").repartition(7)


def test_a_page_far_back_reads_one_partition(spark):
    found = _postings(spark)
    table = c.RankTable(found, parts=10)
    assert table.total == 500
    whole = [r.posting_id for r in c.page(found, 500).collect()]
    for limit, offset in ((20, 0), (20, 333), (50, 480), (7, 600), (500, 0)):
        got = table.page(limit, offset).collect()
        assert [r.posting_id for r in got] == whole[offset : offset + limit]
        assert [r["rank"] for r in got] == list(range(offset + 1, min(offset + limit, 500) + 1))
    first = table.before[5]
    plan = table.page(3, first)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(_part" in plan and "= 5)" in plan
    assert c.RankTable(found.limit(0)).page(5, 0).count() == 0


def test_cursors_walk_all_pages(spark):
    found = _postings(spark, 90)
    whole, cursor, walked = [r.posting_id for r in c.page(found, 90).collect()], None, []
    while rows := c.next_page(found, cursor, 17).collect():
        walked += [r.posting_id for r in rows]
        cursor = (rows[-1].posted_at, rows[-1].created_at, rows[-1].posting_id)
    assert walked == whole


def test_ancestry_of_chains_trees_and_cycles(spark):
    rnd = random.Random(2)
    parent = {}
    for start, length in ((0, 1), (100, 2), (200, 50), (300, 17)):
        parent |= {start + i: (start + i - 1 if i else None) for i in range(length)}
    parent |= {1000 + i: (1000 + rnd.randrange(i) if i else None) for i in range(80)}
    parent |= {2000: 2002, 2001: 2000, 2002: 2001, 2003: 2001, 2004: 2004, 3000: 9999, 3001: 3000}
    frame = spark.createDataFrame([(v, p) for v, p in parent.items()], "version_id long, parent_version_id long")
    got = {r.version_id: (r.root_version_id, r.depth, r.cyclic) for r in resumes.ancestry(frame).collect()}
    for v in parent:
        seen, at = [v], v
        while parent.get(at) in parent and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        cyclic = parent.get(at) in parent
        assert got[v] == ((None, None, True) if cyclic else (at, len(seen) - 1, False)), v
    assert resumes.ancestry(frame.limit(0)).count() == 0


def test_conversion_counts_what_reached_both_steps(spark):
    rows = [("a", "interested"), ("a", "applied"), ("b", "interested"), ("c", "applied"), ("d", "interested"), ("d", "interview")]
    history = spark.createDataFrame(rows, "application_key string, to_status string")
    got = [tuple(r) for r in tracking.conversion(history, ["interested", "applied", "interview", "offer"]).collect()]
    assert got == [(0, "interested", 3, None), (1, "applied", 2, 0.3333), (2, "interview", 1, 0.0), (3, "offer", 0, 0.0)]


def test_merged_sketches_keep_their_rank_error(spark):
    rnd = random.Random(3)
    rows = [(f"p{n % 3}", datetime(2024, 1 + n % 12, 1), [f"s{n % 5}", "all"], rnd.lognormvariate(0, 2)) for n in range(9000)]
    frame = spark.createDataFrame(rows, "location string, posted_at timestamp, skills array<string>, pay_min double")
    sketches = metrics.pay_sketches(frame, 200)
    merged = metrics.merged_sketches(sketches.where("skill = 'all'"), ["location"])
    assert sketches.agg(F.sum("demand")).first()[0] == 18_000
    for r in metrics.sketch_quantiles(merged, {"low": 0.05, "mid": 0.5, "high": 0.95}).collect():
        pays = sorted(p for place, _, _, p in rows if place == r.location)
        assert r.demand == len(pays)
        for name, share in (("low", 0.05), ("mid", 0.5), ("high", 0.95)):
            assert abs(sum(p <= r[name] for p in pays) / len(pays) - share) < 0.03
    unpaid = frame.withColumn("pay_min", F.lit(None).cast("double"))
    assert metrics.sketch_quantiles(metrics.pay_sketches(unpaid, 200), {"mid": 0.5}).where("mid IS NOT NULL").count() == 0


def test_pages_and_payloads_are_read_once(spark):
    """A filter on what was read from a page or a payload worked it out a second time before."""
    from __spark_entry__ import queries

    for name, mark in (("job_pages", "top-card-layout__title"), ("repaired_payloads", "(?:json)?")):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        filters = [x for x in plan.split("\n") if "Filter" in x[:80]]
        assert "Generate explode(array(" in plan and not any(mark in x for x in filters)
