"""Result files, metric vectors and row numbering."""

import pytest
from pyspark.sql import functions as F

from adtally.operators.numbering import pair_by_position, with_row_index
from adtally.operators.results import (
    filter_by_nodes,
    head_rows,
    label_result_columns,
    number_results,
    tag_run,
    union_runs,
    with_group_label,
    with_latency_seconds,
)
from adtally.schemas import RESULT_COLUMNS
from adtally.sources.metric_text import read_metric_pairs, read_metric_vector, write_metric_vectors
from adtally.sources.results import read_results, read_written_results, write_results

HEADER = ",0,1,2,3,4\n"


@pytest.fixture
def folder(tmp_path):
    """Two runs, a header-only run, another kind of file, and a copy one folder down."""
    runs = tmp_path / "exp" / "spark"
    (runs / "spark").mkdir(parents=True)
    rows = "0,357.0,59650.0,2,0,spark\n1,316.0,44848.0,2,0,spark\n"
    (runs / "test_Nodes-2_System-spark_Test-0.csv").write_text(HEADER + rows)
    (runs / "test_Nodes-4_System-spark2_Test-21.csv").write_text(HEADER + "0,51.0,11764.0,4,21,spark2\n")
    (runs / "test_Nodes-8_System-spark_Test-2.csv").write_text(HEADER)
    (runs / "spark" / "test_Nodes-2_System-spark_Test-0.csv").write_text(HEADER + rows)
    return tmp_path / "exp"


def test_results_are_read_and_labelled(spark, folder):
    for path in (f"{folder}/spark", f"{folder}/spark/*.csv"):
        rows = label_result_columns(read_results(spark, path))
        got = sorted(map(tuple, rows.select(*RESULT_COLUMNS, "file_nodes", "file_system", "file_test").collect()))
        assert got == [
            (0, 51.0, 11764.0, 4, 21, "spark2", 4, "spark2", 21),
            (0, 357.0, 59650.0, 2, 0, "spark", 2, "spark", 0),
            (1, 316.0, 44848.0, 2, 0, "spark", 2, "spark", 0),
        ]
        assert dict(rows.dtypes)["NumberOfNodes"] == "int" and dict(rows.dtypes)["countOfEvent"] == "double"


def test_missing_and_empty_inputs_give_no_rows(spark, folder):
    some = read_results(spark, f"{folder}/spark")
    none = read_results(spark, f"{folder}/absent")
    header_only = read_results(spark, f"{folder}/spark/test_Nodes-8_System-spark_Test-2.csv")
    assert none.dtypes == some.dtypes == header_only.dtypes
    assert none.count() == header_only.count() == 0
    assert union_runs(none, some, header_only).count() == 3


def test_results_round_trip_by_run(spark, tmp_path):
    pairs = spark.range(100).select(
        F.col("id").alias("key"), (F.col("id") * 2).alias("countOfEvent"), (F.col("id") + 10_000).alias("latencyTime")
    )
    runs = union_runs(tag_run(pairs, 2, 0, "spark"), tag_run(pairs.where("key < 7"), 4, 1, "spark"))
    results = number_results(runs, ["key"])
    write_results(results.where("TestNumber = 0").limit(3), str(tmp_path / "out"))  # replaced by the next
    write_results(results.where("TestNumber = 1"), str(tmp_path / "out"))
    write_results(results.where("TestNumber = 0"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "system=spark" / "nodes=2" / "test=0").is_dir()
    part = next((tmp_path / "out" / "system=spark" / "nodes=4" / "test=1").glob("*.csv"))
    assert part.read_text().splitlines()[0].replace('""', "") == ",0,1,2,3,4"
    back = read_written_results(spark, str(tmp_path / "out")).select(*RESULT_COLUMNS)
    assert back.dtypes == results.dtypes
    assert back.exceptAll(results).count() == 0 and results.exceptAll(back).count() == 0
    assert filter_by_nodes(back, 4).agg(F.min("testIndex"), F.max("testIndex")).first() == (0, 6)


def test_expressions(spark):
    row = spark.createDataFrame([(2, "spark", 11240.0)], "NumberOfNodes int, System string, latencyTime double")
    out = with_group_label(with_latency_seconds(row)).first()
    assert out["groups"] == "2spark" and out["latencyTime(s)"] == 11.24


def test_head_is_ordered(spark):
    rows = spark.range(1000).repartition(7)
    assert [r[0] for r in head_rows(rows, ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_row_index_over_many_partitions(spark):
    """A hot run holds most rows; each run is numbered without gaps in its order."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("run"), F.col("id") % 10)).alias("run"),
        (F.col("id") * 7919 % 20_011).alias("key"),
    )
    local = rows.toPandas()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_row_index(rows, ["key"], within=["run"]).toPandas()
        everything = with_row_index(rows, ["key"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    local["want"] = local.sort_values("key").groupby("run").cumcount()
    both = got.merge(local, on=["run", "key"])
    assert len(both) == 20_000 and (both["idx"] == both["want"]).all()
    ordered = everything.sort_values("idx")
    assert list(ordered["idx"]) == list(range(20_000)) and ordered["key"].is_monotonic_increasing


def test_metric_lines_keep_their_order_however_the_file_is_cut(spark, tmp_path):
    numbers = [float(i * 37 % 1009) for i in range(50_000)]
    lines = [str(n) for n in numbers]
    lines.insert(100, "")
    lines.insert(200, "# a remark")
    lines.insert(300, "   ")
    (tmp_path / "seen.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_metric_vector(spark, str(tmp_path / "seen.txt"))
        assert [r["value"] for r in got.orderBy("idx").collect()] == numbers
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_line_that_is_no_number_is_an_error(spark, tmp_path):
    (tmp_path / "seen.txt").write_text("1\ntwo\n")
    with pytest.raises(Exception, match="two"):
        read_metric_vector(spark, str(tmp_path / "seen.txt")).collect()


def test_vectors_round_trip(spark, tmp_path):
    frame = spark.range(5000).select("id", (F.col("id") * 3 % 101).alias("n"), (F.col("id") * 1.5).alias("ms"))
    write_metric_vectors(frame.repartition(6), str(tmp_path / "v"), "n", "ms", ["id"])
    got = read_metric_pairs(spark, str(tmp_path / "v"))
    assert got.columns == ["idx", "countOfEvent", "latencyTime"]
    want = frame.select(F.col("id").alias("idx"), F.col("n").cast("double"), "ms")
    assert got.exceptAll(want).count() == 0 and got.count() == 5000


@pytest.mark.parametrize("longer", ["left", "right", "neither"])
def test_pairs_are_padded(spark, longer):
    sizes = {"left": (5, 3), "right": (3, 5), "neither": (4, 4)}[longer]
    left = spark.range(sizes[0]).select(F.col("id").alias("idx"), F.col("id").alias("a"))
    right = spark.range(sizes[1]).select(F.col("id").alias("idx"), F.col("id").alias("b"))
    got = sorted(map(tuple, pair_by_position(left, right).collect()))
    assert [(a, b) for _, a, b in got] == [
        (i if i < sizes[0] else None, i if i < sizes[1] else None) for i in range(max(sizes))
    ]


def test_union_fills_missing_columns(spark):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    two = spark.createDataFrame([("y", 2)], "b string, a int")
    three = spark.createDataFrame([(3,)], "a int")
    assert sorted(map(tuple, union_runs(one, two, three).collect()), key=str) == [(1, "x"), (2, "y"), (3, None)]


def test_a_missing_number_keeps_its_line(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, 10.0), (2, None, 20.0), (3, 3, 30.0)], "k int, seen int, updated double")
    write_metric_vectors(frame, str(tmp_path / "v"), "seen", "updated", ["k"])
    got = [tuple(r) for r in read_metric_pairs(spark, str(tmp_path / "v")).orderBy("idx").collect()]
    assert got == [(0, 1.0, 10.0), (1, None, 20.0), (2, 3.0, 30.0)]


def test_rows_without_a_run_key_are_numbered_too(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 1)], "run string, v int")
    got = sorted(((r["run"] or "", r["v"], r["idx"]) for r in with_row_index(rows, ["v"], ["run"]).collect()))
    assert got == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


@pytest.mark.parametrize("line", ["0,abc,1.0,2,0,spark", "0,1.0,1.0,2,0"])
def test_malformed_result_rows_are_an_error(spark, tmp_path, line):
    path = tmp_path / "test_Nodes-2_System-spark_Test-0.csv"
    path.write_text(f",0,1,2,3,4\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|CSV"):
        read_results(spark, str(path)).collect()
