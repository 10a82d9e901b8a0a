"""Queries and their SQL over small tables made for the purpose: values that round, ties, tables of many tasks."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables in a folder."""
    c = duckdb.connect()
    c.sql("SET threads = 1")
    for table, content in tables.items():
        pq.write_table(content, f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    expected = c.sql(__spark_entry__.oracle_sql()[name])
    return sorted(map(tuple, df.collect()), key=repr), sorted(expected.select(*df.columns).fetchall(), key=repr)


def images():
    """0.29 times 100 is 29 in single precision and less in double; samples below zero."""
    rows = [[0.29] * 64, [0.57, -0.29] * 32, [-1.5, 2.75] * 32]
    return pa.table({"vec_id": pa.array([1, 2, 3], pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0, 1, 2], pa.int32())})


def test_rle_frames_in_single_precision(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q38_rle_frames", embeddings=images())
    assert found == expected and len(found) == 3


def test_jpeg_frames_in_single_precision(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q69_lossless_jpeg_frames", embeddings=images())
    assert found == expected and len(found) == 3


def test_painted_labels_of_equal_frames(spark, tmp_path):
    """Of lines of one number the first in the table stays, whatever its label."""
    flags = ["A", "R", "N", "N", "R", "A", "R"]
    lines = pa.table({
        "l_suppkey": pa.array([1, 1, 1, 2, 2, 3, 3], pa.int64()), "l_orderkey": pa.array([5, 5, 4, 7, 7, 1, 1], pa.int64()), "l_linenumber": pa.array([2, 2, 2, 1, 1, 1, 2], pa.int32()), "l_returnflag": flags,
    })
    found, expected = both(spark, tmp_path, "q61_painted_labels", lineitem=lines)
    assert found == expected and [r[1] for r in found] == ["A", "N", "R"]


def customers(n):
    names = [f"Customer#{k:09d}" for k in range(n)]
    return pa.table({"c_custkey": pa.array(range(n), pa.int64()), "c_name": names, "c_nationkey": pa.array([k % 25 for k in range(n)], pa.int32()), "c_acctbal": [k / 4 for k in range(n)], "c_mktsegment": ["A", "B"] * (n // 2)})


def workers(df):
    """How many workers, and how many steps that deal rows, a plan has."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow"), plan.count("Repartition")


def test_paths_are_parsed_once_in_many_tasks(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q54_paths_in_items", customer=customers(20000))
    assert found == expected
    assert workers(__spark_entry__.queries()["q54_paths_in_items"](spark, str(tmp_path))) == (2, 1)


def test_spread(spark, tmp_path):
    """One row group's rows go to many tasks evenly; small, large and dealt tables stay as they are."""
    from pyspark.sql import functions as F

    from lumenfold.sources import batches

    pq.write_table(customers(20000), f"{tmp_path}/customer.parquet")
    rows = spark.read.parquet(f"{tmp_path}/customer.parquet")
    sizes = [r["count"] for r in batches.spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * 20000 / len(sizes) and sum(sizes) == 20000
    assert batches.spread(batches.spread(rows)).rdd.getNumPartitions() == batches.spread(rows).rdd.getNumPartitions()
    assert "Repartition" not in batches.spread(spark.range(10).toDF("k"))._jdf.queryExecution().optimizedPlan().toString()


def test_chosen_columns(spark):
    from lumenfold.sources import p10, records

    df = spark.createDataFrame([("a", p10.write([(0x00100010, "PN", "A^B"), (0x00280010, "US", [512])]))], "instance_id string, content binary")
    every = records.elements(df)
    for columns in (["path", "instance_id"], ["longs", "tag", "text", "vm"]):
        assert records.elements(df, columns=columns).collect() == every.select(*columns).collect()


def test_frame_order_has_no_repeated_work(spark):
    """Parts of the normal are columns: the plan's text stays short, where it repeated them for each of their uses."""
    from pyspark.sql import functions as F

    from lumenfold.operators import series

    three = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    rows = spark.range(6).select((F.col("id") % 2).alias("s"), F.col("id").alias("k"), F.array(F.lit(0.0), F.lit(0.0), (-F.col("id")).cast("double")).alias("o"), three(2, 0, 0).alias("x"), three(0, 2, 0).alias("y"))
    out = series.multiframe_order(rows, ["s"], "o", ("x", "y"), "k")
    assert out.columns == ["s", "k", "o", "x", "y", "position_along", "order_error", "frame_ordinal"] and dict(out.dtypes)["frame_ordinal"] == "int"
    assert {(r.k, r.position_along, r.order_error, r.frame_ordinal) for r in out.collect()} == {(0, 0.0, None, 2), (2, -2.0, None, 1), (4, -4.0, None, 0), (1, 0.0, None, 2), (3, -2.0, None, 1), (5, -4.0, None, 0)}
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 8000


def test_traversal_is_parsed_once_in_many_tasks(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q55_traversal", customer=customers(20000))
    assert found == expected
    assert workers(__spark_entry__.queries()["q55_traversal"](spark, str(tmp_path))) == (2, 1)


def test_syntaxes_are_parsed_once_in_many_tasks(spark, tmp_path):
    """Customers without a name stay."""
    c = customers(20000)
    c = c.set_column(1, "c_name", pa.array([None if k == 7 else n for k, n in enumerate(c["c_name"].to_pylist())]))
    found, expected = both(spark, tmp_path, "q60_syntaxes", customer=c)
    assert found == expected
    assert workers(__spark_entry__.queries()["q60_syntaxes"](spark, str(tmp_path))) == (8, 4)


def test_json_records_in_many_tasks(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q39_json_records", customer=customers(20000))
    assert found == expected
    assert workers(__spark_entry__.queries()["q39_json_records"](spark, str(tmp_path))) == (4, 1)


def test_selected_elements_in_many_tasks(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q53_selected_elements", customer=customers(20000))
    assert found == expected
    assert workers(__spark_entry__.queries()["q53_selected_elements"](spark, str(tmp_path))) == (2, 1)


def test_walk_parses_each_file_once(spark, tmp_path):
    from lumenfold.sources import p10, records

    found, expected = both(spark, tmp_path, "q63_walk", customer=customers(20000))
    assert found == expected
    plan = __spark_entry__.queries()["q63_walk"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("Repartition"), plan.count("Join")) == (2, 1, 0)
    whole = p10.write([(0x00100010, "PN", "A^B")])
    files = spark.createDataFrame([("f/a", whole), ("f/b", whole[:-3]), ("f/c", None), ("d", b"")], "instance_id string, content binary")
    assert {tuple(r) for r in records.walk(files).collect()} == {("f", 3, 1, 2, 11, 2 * len(whole) - 3), ("", 1, 0, 1, 0, 0)}


def parts(n):
    return pa.table({"p_partkey": pa.array(range(n), pa.int64()), "p_size": pa.array([k % 51 for k in range(n)], pa.int32())})


def test_overlay_grids_are_compiled_and_dealt(spark, tmp_path):
    """Corners and indexes are plain arithmetic; only what runs over the corners loops."""
    found, expected = both(spark, tmp_path, "q40_overlay_grids", part=parts(20000))
    assert found == expected
    plan = __spark_entry__.queries()["q40_overlay_grids"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "arrays_zip" not in plan


def test_grid_functions_without_a_grid(spark):
    from pyspark.sql import functions as F

    from lumenfold.functions import geometry as G

    grid = G.volume(G.vector(1, 2, 3), (G.vector(0, 2, 0), G.vector(1, 0, 0), G.vector(0, 0, -1)), (2.0, 3.0, 4.0), (5, 6, 7))
    rows = spark.range(2).select(F.when(F.col("id") == 0, grid).alias("g"), G.vector(1, 1, 2).alias("i"))
    found = rows.select(G.grid_to_world(F.col("g"), F.col("i")).alias("w"), G.grid_to_index(F.col("g"), G.vector(4, 4, -5)).alias("i"), G.grid_contains(F.col("g"), F.col("i")).alias("c")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([([4.0, 4.0, -5.0], [1.0, 1.0, 2.0], True), ([None] * 3, None, None)], key=repr)


def test_palettes_in_many_tasks(spark, tmp_path):
    found, expected = both(spark, tmp_path, "q64_record_palettes", part=parts(20000))
    assert found == expected
    plan = __spark_entry__.queries()["q64_record_palettes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 2 and plan.count("MapInArrow") == 2
