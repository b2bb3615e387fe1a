from pyspark.sql import functions as F

from hireloom.operators import ingest as i
from hireloom.operators import tracking as t
from hireloom.operators.ordered import neighbour
from hireloom.plans.ingest_queries import _existing, _observations

SF = "/root/testdata/sf0.001"


def test_second_ingest_creates_nothing(spark, tmp_path):
    as_of = F.lit("2003-01-01").cast("timestamp")
    batch = i.dedupe(_observations(spark, SF))
    empty = _existing(spark, SF).limit(0)
    first = i.upsert_postings(empty, batch, as_of)
    root = str(tmp_path / "postings")
    i.write_version(first.drop("action"), root, 1)
    again = i.upsert_postings(i.read_current(spark, root), batch, as_of)
    i.write_version(again.drop("action"), root, 2)
    assert {r["action"] for r in i.counters(first).collect()} == {"insert"}
    assert {r["action"] for r in i.counters(again).collect()} == {"update"}
    assert i.read_current(spark, root).count() == first.count() == batch.count()


def test_every_ingest_appends_a_snapshot(spark, tmp_path):
    batch = i.dedupe(_observations(spark, SF))
    path = str(tmp_path / "snaps")
    for day in ("2024-01-01", "2024-01-02"):
        i.append_snapshots(i.snapshots(batch, F.lit(day).cast("timestamp")), path)
    snaps = spark.read.parquet(path)
    per_posting = snaps.groupBy("posting_id").agg(
        F.count("*").alias("n"), F.count_distinct("checksum").alias("c")
    )
    assert {tuple(r)[1:] for r in per_posting.collect()} == {(2, 1)}


def test_company_fills_only_empty_fields(spark):
    old = spark.createDataFrame(
        [("acme", "Acme", "w0", None)], "company_key string, name string, website string, industry string"
    )
    batch = spark.createDataFrame(
        [("ACME!", None, "Tools", 0, 2), ("acme", "w1", "Other", 0, 1), ("New", "", None, 1, 1)],
        "company_name string, company_website string, company_industry string, "
        "provider_rank int, position int",
    )
    rows = {r.company_key: tuple(r)[1:] for r in i.upsert_companies(old, batch).collect()}
    assert rows["acme"] == ("Acme", "w0", "Other", "update")
    assert rows["new"] == ("New", None, None, "insert")


def _commands(spark, rows):
    return spark.createDataFrame(
        rows,
        "command_id long, ts string, profile_id long, posting_id long, op string, status string, "
        "reason string, idempotency_key string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_lifecycle_of_one_application(spark):
    rows = [
        (0, "2024-01-01 08:00", 1, 5, "set_status", "applied", None, None),
        (1, "2024-01-01 09:00", 1, 5, "upsert", "interested", None, None),
        (2, "2024-01-01 10:00", 1, 5, "upsert", "interested", None, None),
        (3, "2024-01-02 09:00", 1, 5, "set_status", "applied", "sent", None),
        (4, "2024-01-05 09:00", 1, 5, "delete", "cancelled", None, None),
        (5, "2024-01-06 09:00", 1, 5, "upsert", "interested", None, None),
    ]
    commands = _commands(spark, rows).withColumn("application_key", t.default_key())
    history = t.history(commands)
    got = [
        (r.from_status, r.to_status, r.reason) for r in history.orderBy("created_at").collect()
    ]
    assert got == [
        (None, "interested", "tracker_create"),
        ("interested", "applied", "sent"),
        ("applied", "cancelled", "tracker_remove"),
        ("cancelled", "interested", "tracker_upsert"),
    ]
    assert [r.command_id for r in t.rejected(commands).collect()] == [0]
    assert t.applications_after(history).first().status == "interested"


def test_a_key_finds_a_cancelled_application_and_a_pair_an_active_one(spark):
    apps = spark.createDataFrame(
        [("k1", 1, 5, "cancelled"), ("k2", 1, 6, "applied")],
        "application_key string, profile_id long, posting_id long, status string",
    )
    commands = _commands(
        spark,
        [
            (1, "2024-01-01", 1, 5, "upsert", "applied", None, "k1"),
            (2, "2024-01-01", 1, 6, "upsert", "draft", None, "other"),
            (3, "2024-01-01", 1, 5, "upsert", "draft", None, None),
        ],
    )
    got = {r.command_id: r.application_key for r in t.resolve(commands, apps).collect()}
    # The first command revives k1, so the third finds an active application of its pair.
    assert got == {1: "k1", 2: "k2", 3: "k1"}


def test_neighbour_links_chunks(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 9, 30, 31)], "k string, n int")
    for following, want in ((False, [None, 1, 2, 9, 30]), (True, [2, 9, 30, 31, None])):
        got = neighbour(
            rows, ["k"], ["n"], F.col("n"), "x", F.floor(F.col("n") / 10), following
        ).orderBy("n")
        assert [r.x for r in got.collect()] == want


def test_a_version_written_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "versions")
    i.write_version(spark.range(3), root, 1)
    i.write_version(spark.range(3), root, 1)
    assert i.read_current(spark, root).count() == 3
    i.write_version(spark.range(5), root, 2)
    assert i.read_current(spark, root).count() == 5


def test_new_keys_of_one_pair_in_one_batch_share_an_application(spark):
    rows = [
        (1, "2024-01-01", "p", "j", "applied", "k1", "upsert"),
        (2, "2024-01-02", "p", "j", "interview", "k2", "upsert"),
        (3, "2024-01-03", "p", "j", "cancelled", "k1", "delete"),
        (4, "2024-01-04", "p", "j", "applied", "k3", "upsert"),
        (5, "2024-01-05", "p", "j", "rejected", "k4", "set_status"),
        (6, "2024-01-06", "q", "j", "applied", None, "upsert"),
    ]
    commands = spark.createDataFrame(
        rows, "command_id long, ts string, profile_id string, posting_id string, status string, idempotency_key string, op string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    found = {r.command_id: r.application_key for r in t.resolve(commands).collect()}
    assert found == {1: "k1", 2: "k1", 3: "k1", 4: "k3", 5: "k3", 6: "track:q:j"}


def test_duplicates_in_every_script_and_without_titles(spark):
    rows = [
        (1, "Фирма А", "Инженер", None), (2, "Фирма Б", "Повар", None), (3, "фирма а", "инженер!", None),
        (4, "公司", "工程师", None), (5, "x", "", None), (6, "x", "", None), (7, "x", None, None),
    ]
    frame = spark.createDataFrame(rows, "posting_id long, company_name string, title string, location string").withColumn("provider_rank", F.lit(0))
    assert {r.posting_id: r.canonical_id for r in i.merge_duplicates(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_first_row_per_key_carries_the_columns_read_only(spark):
    """Whole rows went through the shuffle before, whatever a query read of them."""
    from __spark_entry__ import queries

    plan = queries()["observation_dedupe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "p_type" not in plan.split("Relation")[0] and "l_quantity" not in plan.split("Relation")[0]


def test_neighbours_are_dealt_once(spark):
    """Rows and the links of their chunks come from one shuffle; a row has its neighbour across chunks and within."""
    from pyspark.sql import functions as F

    from hireloom.operators.ordered import first_wins, latest, neighbour

    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 9, 30), ("b", 4, 40)], "k string, t int, v int")
    chunk = F.floor(F.col("t") / 5)
    before = neighbour(rows, ["k"], ["t"], F.col("v"), "near", chunk)
    after = neighbour(rows, ["k"], ["t"], F.col("v"), "near", chunk, following=True)
    show = lambda df: sorted((r["k"], r["t"], r["near"]) for r in df.collect())
    assert show(before) == [("a", 1, None), ("a", 2, 10), ("a", 9, None), ("b", 4, None)]
    assert show(after) == [("a", 1, None), ("a", 2, 30), ("a", 9, None), ("b", 4, None)]
    assert sorted(first_wins(rows, ["k"], ["t"]).collect()) == [("a", 1, 10), ("b", 4, 40)]
    assert sorted(latest(rows, ["k"], ["t"]).collect()) == [("a", 9, 30), ("b", 4, 40)]
