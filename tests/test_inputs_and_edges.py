"""Inputs that must be refused, and edges that must not be."""
import pytest
from pyspark.sql import functions as F

from conftest import events_frame
from tidemark import sources as SRC
from tidemark.operators import metrics as M, report as R, splits as SP, stats as S, vectors as VX

SCORED = "narration_id string, verb int, noun int, verb_output array<double>, noun_output array<double>"


@pytest.mark.parametrize("row", [("x", None, 0, [1.0, 0.0], [1.0, 0.0]), ("x", 7, 0, [1.0, 0.0], [1.0, 0.0]), ("x", 0, -1, [1.0, 0.0], [1.0, 0.0]),
                                 ("x", 0, 0, [float("nan"), 0.0], [1.0, 0.0]), ("x", 0, 0, [1.0, 0.0], None), ("x", 0, 0, [1.0, None], [1.0, 0.0])])
def test_metrics_refuse_bad_rows(spark, row):
    good = ("y", 1, 1, [0.0, 1.0], [0.0, 1.0])
    assert M.rank_metrics(spark.createDataFrame([good], SCORED), num_nouns=2).count() == 3
    with pytest.raises(Exception, match="missing, not finite or out of range"):
        M.rank_metrics(spark.createDataFrame([good, row], SCORED), num_nouns=2).collect()


def test_probabilities_must_sum_to_one(spark):
    with pytest.raises(Exception, match="out of range"):
        M.rank_metrics(spark.createDataFrame([("y", 1, 1, [0.5, 1.0], [0.0, 1.0])], SCORED), kind="probabilities", num_nouns=2).collect()


def test_repeated_reference_seed(spark):
    rows = [("A", 1, "a1", 5.0), ("A", 2, "a2", 6.0), ("A", 3, "a3", 7.0), ("B", 1, "b1", 4.0), ("B", 1, "b1x", 3.0)]
    runs = spark.createDataFrame(rows, "configuration string, seed int, run string, score double")
    a = {r["configuration"]: r for r in R.ablation(runs, "B").collect()}
    assert a["A"]["score_n"] == 3 and a["A"]["delta_mean"] == 2.0
    assert [r["delta"] for r in R.delta_vs(runs, "B").where("configuration = 'A'").collect()] == [2.0]


def test_half_labelled_rows_count(spark):
    ev = events_frame(spark, [("a", "P1", "P1_1", 2.0, 3.0, 0, None), ("b", "P1", "P1_1", 3.0, 4.0, None, 1), ("c", "P1", "P1_1", 4.0, 5.0, 0, 1)])
    got = {(r["field"], r["class_id"]): r["n"] for r in S.class_counts(ev, 2, 2).collect()}
    assert got == {("verb", 0): 2, ("verb", 1): 0, ("noun", 0): 0, ("noun", 1): 2}


def test_quoted_fields(spark, folder):
    with open(f"{folder}/a.csv", "w") as out:
        out.write('narration_id,participant_id,note,video_id,start_timestamp,stop_timestamp,verb_class,noun_class\n'
                  'n1,P1,"say ""hi"", then\ngo",P1_1,00:00:20,00:00:21,1,2\n')
    row = SRC.read_events(spark, f"{folder}/a.csv").first()
    assert (row["video_id"], row["start"], row["verb"], row["noun"]) == ("P1_1", 20.0, 1, 2)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_feeds_across_blocks(spark, folder, end):
    import random
    from tidemark.sources.records import csv_records, read_csv
    draw = random.Random(end)
    notes = ['plain', '', '"two\nlines"', '"say ""hi"", then\n\n""go"""', '""', '"' + "long\n" * 60 + '"', '"\n"', '"a,b"']
    for name in ("a", "b"):
        with open(f"{folder}/{name}.csv", "w", newline="") as out:
            out.write(f"id,note,more{end}" + end.join(f"{name}{i},{draw.choice(notes)},x{i}" for i in range(300)) + (end if name == "a" else "") + end)
    want = spark.read.csv(folder, header=True, quote='"', escape='"', multiLine=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = read_csv(spark, folder)
        assert spark.read.text(folder).rdd.getNumPartitions() > 20
        assert got.columns == ["id", "note", "more"] and got.count() == 600
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        with open(f"{folder}/a.csv", "a") as out:
            out.write('z,"never ends,1\n')
        with pytest.raises(Exception, match="never ends"):
            read_csv(spark, f"{folder}/a.csv").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with open(f"{folder}/b.csv", "w") as out:
        out.write('id,note\n1,5" pipe\n2,6" pipe\n')
    with pytest.raises(Exception, match="not quoted"):
        csv_records(spark, f"{folder}/b.csv").collect()


def test_every_target_and_pool_is_accepted(spark):
    rows = [(f"e{p}_{i}", f"P{p}", f"P{p}_{i}", 2.0 * i, 2.0 * i + 1, p % 3, i % 2) for p in range(6) for i in range(p + 1)]
    ev = events_frame(spark, rows)
    assert SP.choose_unseen(ev, target=0.01).count() >= 2
    assert SP.choose_unseen(ev, pool=(0.0, 1.0), target=0.5).count() >= 2


def test_combination_counts_equal_the_listing(spark):
    rows = [(f"e{p}_{i}", f"P{p:02d}", f"P{p}_1", 2.0 * i, 2.0 * i + 1, 0, 0) for p in range(20) for i in range(1 + p % 5)]
    ev = events_frame(spark, rows)
    listed = SP.combinations(ev, 0.2, band=0.05).groupBy(F.size("names").cast("long").alias("members"), "outside").agg(
        F.count(F.lit(1)).alias("combinations"), F.sum("n").alias("events"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, SP.combination_counts(ev, 0.2, band=0.05).collect()))


def test_a_query_without_a_key_is_a_miss(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    queries = spark.createDataFrame(vectors, "id long, vector array<double>")
    r = VX.retrieval_top1(queries, queries.where("id <> 3")).first()
    assert r["n"] == 3 and r["top1"] == pytest.approx(2 / 3) and r["chance"] == pytest.approx(1 / 3)


def test_scores_for_many_classes(spark):
    features = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, vector array<double>")
    classes = spark.createDataFrame([(i, [float(i), 1.0], 0.5) for i in range(40)], "class_id int, w array<double>, b double")
    scores = VX.score_classes(features, classes, "v").first()["scores"]
    assert len(scores) == 40 and scores[39] == 41.5


def test_fingerprint_ignores_order_and_files(spark, folder):
    lines = spark.range(100).select(F.col("id").cast("string").alias("value"))
    lines.repartition(5).write.text(f"{folder}/a")
    assert SRC.file_fingerprint(spark, f"{folder}/a").first() == SRC.fingerprint(lines).first()
    assert SRC.fingerprint(lines.where("value <> '7'")).first()["digest"] != SRC.fingerprint(lines).first()["digest"]


def test_events_of_a_video_without_clips_are_an_error(spark):
    from tidemark import plans
    from tidemark.operators.checks import IntegrityError
    ev = events_frame(spark, [("a", "P1", "P1_1", 20.0, 21.0, 0, 0), ("b", "P1", "P1_2", 20.0, 21.0, 0, 0)]).withColumn("subset", F.lit("val"))
    bank = spark.createDataFrame([("P1_1", float(t), t) for t in range(1, 20)], "video_id string, t_end_s double, row long")
    assert plans.validation_history(ev.where("video_id = 'P1_1'"), bank, 4).count() == 4
    with pytest.raises(IntegrityError, match="video_without_clips"):
        plans.validation_history(ev, bank, 4)


def test_attention_joins_queries_once_and_answers_events_without_steps(spark):
    steps = spark.createDataFrame([("a", 1, True, [1.0, 0.0]), ("a", 2, True, [0.0, 1.0])], "narration_id string, k int, valid boolean, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "narration_id string, q array<double>")
    once = {r["narration_id"]: r for r in VX.attend(steps, "q", "vector", "vector", "valid", queries=queries).collect()}
    each = VX.attend(steps.join(queries, "narration_id"), "q", "vector", "vector", "valid").first()
    assert once["a"]["attended"] == each["attended"] and once["b"]["attended"] == [0.0, 0.0] and once["b"]["weights"] == [[]]


def test_manifest_violations_around_the_cutoff_zero(spark, folder):
    """Cutoffs just before and after zero, where the changes that p5 makes move cutoffs and window ends past zero."""
    import duckdb

    import __spark_entry__ as entry_module
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01 01:00:00' + to_microseconds(d * 100000) AS ts, 1 AS user_id, t AS event_type, 1.5 AS value,
      '{{"k": 1}}' AS props FROM range(-15, 16) r(d), (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error')) e(t)) TO '{folder}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.sql(entry_module.oracle_sql()["p5_manifest_violations"]).fetchall()
    got = entry_module.queries()["p5_manifest_violations"](spark, folder).select("id", "check").collect()
    assert sorted(map(tuple, got)) == sorted(want)
