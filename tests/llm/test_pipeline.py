import corpus_pipeline
import __spark_entry__ as entry


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_rows_of_one_id_keep_their_texts(spark, frame):
    rows = [(1, None), (1, "first text of one"), (1, "second and other words"), (1, "first text of one"), (2, "something else")]
    got = corpus_pipeline.drop_near_copies(spark, frame(rows), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted({(i, t or "") for i, t in rows})


def test_stages_keep_what_is_clean(spark, frame, words, tmp_path):
    """Each stage's decision against what the rows were made for."""
    import random

    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, copy = prose(60), prose(90)
    rows = [(i, prose(50)) for i in range(80)]
    rows += [(100 + i, f"{prose(10)} stupidity moronic {prose(10)}") for i in range(30)]
    rows += [(200, copy), (201, copy), (202, copy + " more"), (300, f"{passage} {prose(30)}"), (301, f"{prose(30)}\n{passage}")]
    rows += [(400, "key password=abcdefghijkl1234 " + prose(20)), (500, None), (501, ""), (600, "again"), (600, "again")]
    folder = str(tmp_path)
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 130)) for i in range(130)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {i for i, _ in rows if not 100 <= i < 130}
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {201, 202}
    texts = dict(rows)
    assert kept["substring_dedup"] == {i: texts[i] if i != 301 else texts[i].split("\n")[0] for i in kept["near_dedup"]}
    assert kept["secrets"] == kept["substring_dedup"] | {400: kept["substring_dedup"][400].replace("password=abcdefghijkl1234", "[secret:assign]")}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept["secrets"]) and len(pieces) == len(kept["secrets"])
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)
