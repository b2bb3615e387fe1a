"""The engine's tables derived from a star-schema folder of Parquet files.

The folder has no postings or resumes of its own, so parts stand for
postings, orders for resumes, order lines for provider observations and
events for application commands. Everything is computed by Spark from whole
tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.sources.providers import provider_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows in as many tasks as a shuffle has: small rows that cost much work each would be put into a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])


def _case(value: Column, *choices: object) -> Column:
    """The choice at an index; the last one stands for every other value."""
    out = F.lit(choices[-1])
    for i, choice in reversed(list(enumerate(choices[:-1]))):
        picked = choice if isinstance(choice, Column) else F.lit(choice)
        out = F.when(value == i, picked).otherwise(out)
    return out


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("company_id"),
            F.col("s_name").alias("company_name"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("market"),
        )
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    nation = F.concat(F.lit("NATION_"), (key % 25).cast("string"))
    years = (size % 12).cast("string")
    return table(spark, sf_dir, "part").select(
        key.alias("posting_id"),
        _case(key % 3, "remotive", "naukri", "demo").alias("provider"),
        (key % 100).alias("company_id"),
        F.concat(
            _case(size % 5, "Senior ", "Junior ", "Mid-level ", ""), F.col("p_name")
        ).alias("title"),
        F.concat(
            F.lit("Own "), F.lower("p_type"), F.lit(" parts for "), F.col("p_brand"),
            F.when(size % 4 == 0, F.concat(F.lit(". Needs "), years, F.lit("+ years of practice.")))
            .otherwise(". Ships to many markets."),
        ).alias("description"),
        _case(
            size % 6, "Remote - Worldwide", "Remote - US", "Bengaluru, India",
            F.concat(F.lit("Hybrid - "), nation), nation, None,
        ).alias("location"),
        _case(size % 6, "remote", "remote", "hybrid", "hybrid", "onsite", None).alias(
            "remote_type"
        ),
        F.concat(
            F.split("p_name", " "), F.array(F.col("p_brand"), F.lower("p_type"))
        ).alias("skills"),
        _case(key % 10, "discovered", "eligible", "archived", "normalized").alias("status"),
        F.when(key % 17 != 0, F.timestamp_seconds(F.lit(1704067200) + size * 86400)).alias(
            "posted_at"
        ),
        F.timestamp_seconds(F.lit(1709251200) + key).alias("created_at"),
        F.col("p_retailprice").alias("pay_min"),
        F.concat(F.lit("https://example.com/jobs/"), key.cast("string")).alias("canonical_url"),
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume per customer: the skills are those of the parts in its newest order."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderkey").alias("l_orderkey")
    )
    # By its file this table looks small enough to be sent whole through the driver when its rows no longer are.
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"
    ).hint("merge")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber")
        .join(newest, "l_orderkey")
        .join(part, "l_partkey")
    )
    skill = F.explode(
        F.concat(F.split("p_name", " "), F.array(F.col("p_brand"), F.lower("p_type")))
    )
    first = F.struct("l_linenumber", "l_partkey", "p_name", "p_type")
    summaries = (
        lines.select("c_custkey", first.alias("line"), skill.alias("skill"))
        .groupBy("c_custkey")
        .agg(
            F.array_sort(F.collect_set("skill")).alias("skills"),
            F.min("line").alias("line"),
        )
    )
    nation = F.col("c_nationkey")
    return summaries.join(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("resume_id"),
        F.col("c_custkey").alias("profile_id"),
        F.translate("c_name", "#0123456789", " abcdefghij").alias("name"),
        F.col("line.p_name").alias("headline"),
        F.concat(F.lit("Works in "), F.lower("c_mktsegment")).alias("summary"),
        "skills",
        F.array(
            F.struct(
                F.col("line.p_name").alias("title"),
                F.initcap("c_mktsegment").alias("company"),
                F.lit(None).cast("string").alias("summary"),
                F.array(
                    F.concat(F.lit("Delivered "), F.lower("line.p_type"), F.lit(" parts"))
                ).alias("bullets"),
            )
        ).alias("experience"),
        F.concat(F.lit("NATION_"), nation.cast("string")).alias("location"),
        _case(nation % 4, "remote", "hybrid", "onsite", None).alias("preferred_remote"),
    )


def observations(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Order lines as repeated provider observations of a part.

    With ``parts`` they are dealt by the part into so many partitions, before texts make the lines long.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "l_partkey").hint("merge") if parts else rows

    flag = F.col("l_returnflag")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        "l_linestatus", "l_quantity", "l_shipdate",
    )
    return (
        dealt(lines)
        .join(dealt(part), "l_partkey")
        .select(
            F.when(flag == "R", "remotive").when(flag == "N", "naukri").otherwise("demo").alias(
                "provider"
            ),
            F.col("l_partkey").cast("string").alias("external_id"),
            F.col("p_name").alias("title"),
            F.concat(F.lit("Supplier #"), F.col("l_suppkey").cast("string")).alias(
                "company_name"
            ),
            F.concat(F.lit("Own "), F.lower("p_type"), F.lit(" parts")).alias("description"),
            F.when(F.col("l_linestatus") == "O", "Remote - US").alias("location"),
            F.concat(F.split("p_name", " "), F.array(F.col("p_brand"))).alias("skills"),
            F.col("l_quantity").alias("pay_min"),
            F.when(
                F.col("l_suppkey") % 3 == 0,
                F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example")),
            ).alias("company_website"),
            F.col("l_shipdate").cast("timestamp").alias("retrieved_at"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        )
        .withColumn("provider_rank", provider_rank(F.col("provider")))
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracker commands of a profile on a posting."""
    kind = F.col("event_type")
    item = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("command_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("profile_id"),
        (item % 10).cast("bigint").alias("posting_id"),
        F.when(kind.isin("signup", "purchase"), "upsert")
        .when(kind == "error", "delete")
        .otherwise("set_status")
        .alias("op"),
        F.when(kind == "signup", "interested")
        .when(kind == "view", "tailored")
        .when(kind == "click", "applied")
        .when(kind == "purchase", "interview")
        .otherwise("cancelled")
        .alias("status"),
    )


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain-text resume per customer order summary, in the usual layout."""
    r = resumes(spark, sf_dir)
    role = F.col("experience")[0]
    lines = [
        F.col("name"),
        F.initcap("headline"),
        F.concat(F.lit("c"), F.col("resume_id").cast("string"),
                 F.lit("@mail.example.com | +91 98765 43210 | "), F.col("location")),
        F.lit(""),
        F.lit("Professional Summary"),
        F.col("summary"),
        F.lit(""),
        F.lit("EXPERIENCE"),
        F.concat(F.initcap(role["title"]), F.lit(" Lead | "), role["company"],
                 F.lit(" Works, "), F.col("location"), F.lit(" FEB 2021 – PRESENT")),
        F.concat(F.lit("• "), role["bullets"][0], F.lit(" on time")),
        F.lit("and below the agreed budget"),
        F.lit("- Kept records"),
        F.concat(F.lit("Junior "), F.initcap(role["title"]), F.lit(" | Old Works, "),
                 F.col("location"), F.lit(" Oct 2018 – Jan 2021")),
        F.lit("• Counted stock daily"),
        F.lit(""),
        F.lit("Education:"),
        F.concat(F.lit("BCA | College of "), F.col("location"), F.lit(", City Sep 2017 | 8.5 CGPA")),
        F.concat(F.lit("Skills: "), F.array_join("skills", ", ")),
        F.lit("Languages"),
        F.lit("English, Hindi"),
    ]
    return r.select("resume_id", F.concat_ws("\n", *lines).alias("text"))
