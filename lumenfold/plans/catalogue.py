"""The record engine's operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, geometry, pixels, tags
from ..operators import djson, elements, labels, overlay, remap, series, stacks, transcode
from ..sources import frames, jsonmodel, p10, records, sink
from ..sources.batches import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TRIM = "trim({0}, ' ' || chr(0))"


@query("SELECT n_nationkey AS instance_id, n_name AS text, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name IS NOT NULL")
def q1_lookup_by_keyword(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    tagged = rows.select(F.col("n_nationkey").alias("instance_id"), F.explode(F.map_from_arrays(F.array(F.lit("00100010"), F.lit("00081030")), F.array("n_name", "r_name"))).alias("tag_hex", "text"), F.lit(0).alias("depth"))
    return elements.wide(tagged, ["PatientName", "StudyDescription"]).select("instance_id", F.col("PatientName").alias("text"), F.col("StudyDescription").alias("region"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def q2_projection_tree(spark, d):
    names = {"00100020": "o_orderkey", "00080060": "o_orderstatus", "00080020": "o_orderdate", "00080005": None, "00080016": None}
    tree = elements.selection({"PatientID": {}, "(0008,0060)": {}, "StudyDate": {}})
    return table(spark, d, "orders").select(*(names[t] for t in tree if names[t])).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
  l_returnflag = 'R' AS bad FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity AS first_value, CASE WHEN bad THEN NULL ELSE l_quantity END AS v0, CASE WHEN bad THEN NULL ELSE l_discount END AS v1, CASE WHEN bad THEN NULL ELSE l_tax END AS v2, CASE WHEN bad THEN NULL ELSE 3 END AS n FROM t""")
def q3_text_to_doubles(spark, d):
    line = table(spark, d, "lineitem")
    text = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("\\ "), F.col("l_discount").cast("string"), F.lit("/\\"), F.col("l_tax").cast("string"), F.when(F.col("l_returnflag") == "R", "\\x").otherwise(""))
    v = F.col("v")
    first = coerce.to_double(F.concat(F.col("l_quantity").cast("string"), F.lit("\\1")))
    return line.withColumn("v", coerce.to_doubles(text)).select("l_orderkey", "l_linenumber", first.alias("first_value"), *(F.get(v, F.lit(i)).alias(f"v{i}") for i in range(3)), F.when(v.isNotNull(), F.size(v)).alias("n"))


@query(r"SELECT p_partkey, p_name AS s0, p_brand AS s1, p_type AS s2, 4 AS vm, '' AS s3 FROM part")
def q4_text_values(spark, d):
    text = F.concat_ws("\\", F.concat(F.lit("  "), F.col("p_name"), F.lit(" \0")), "p_brand", F.concat(F.col("p_type"), F.lit(" ")), F.lit(""))
    v = coerce.to_strings(text)
    return table(spark, d, "part").select("p_partkey", *(F.get(v, F.lit(i)).alias(f"s{i}") for i in range(4)), coerce.multiplicity(text).alias("vm"))


@query("""SELECT c_custkey, c_name AS family, c_mktsegment AS given, NULL::VARCHAR AS ideographic, c_name || '^' || c_mktsegment || '==' || c_mktsegment AS written, true AS too_many FROM customer""")
def q5_person_names(spark, d):
    text = F.concat(F.concat_ws("^", "c_name", "c_mktsegment"), F.lit("=="), F.col("c_mktsegment"))
    pn = coerce.person_name(text)
    return table(spark, d, "customer").select("c_custkey", F.get(pn["alphabetic"], F.lit(0)).alias("family"), F.get(pn["alphabetic"], F.lit(1)).alias("given"), F.array_join(pn["ideographic"], "^").alias("ideographic"), coerce.person_name_text(pn).alias("written"), coerce.person_name(F.concat(text, F.lit("=x"))).isNull().alias("too_many"))


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1.2.' || o_custkey WHEN 1 THEN '1.02.' || o_custkey WHEN 2 THEN '1..' || o_custkey ELSE '1.2.840.' || repeat(o_custkey::VARCHAR || '.', 12) || '1' END AS u FROM orders)
SELECT o_orderkey, length(u) <= 64 AND regexp_full_match(u, '(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*') AS strict, length(u) <= 64 AND regexp_full_match(u, '[0-9.]+') AS loose FROM t""")
def q6_uid_validity(spark, d):
    c = F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 4
    u = F.when(k == 0, F.concat(F.lit("1.2."), c)).when(k == 1, F.concat(F.lit("1.02."), c)).when(k == 2, F.concat(F.lit("1.."), c)).otherwise(F.concat(F.lit("1.2.840."), F.repeat(F.concat(c, F.lit(".")), 12), F.lit("1")))
    return table(spark, d, "orders").select("o_orderkey", coerce.uid_strict(u).alias("strict"), coerce.uid_loose(u).alias("loose"))


@query("""SELECT c_custkey, printf('%08X', r_regionkey) || '.' || n_nationkey || '.' || printf('%08X', c_nationkey) || '.' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q7_preorder_paths(spark, d):
    n = F.broadcast(table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", elements.item_path((F.col("r_regionkey"), F.col("n_nationkey")), (F.col("c_nationkey"), F.col("c_custkey"))).alias("path"))


@query("SELECT o_orderkey, 'IS' AS vr, o_custkey::VARCHAR AS customer, o_orderpriority AS priority, NULL::VARCHAR AS missing FROM orders")
def q8_json_round_trip(spark, d):
    text = djson.record(djson.attribute("00200013", "IS", F.array("o_custkey")), djson.attribute("00081030", "LO", F.array("o_orderpriority")), djson.attribute("00100020", "LO", F.array().cast("array<string>")))
    return table(spark, d, "orders").withColumn("j", text).select("o_orderkey", djson.vr_of(F.col("j"), "00200013").alias("vr"), djson.value(F.col("j"), "00200013").alias("customer"), djson.value(F.col("j"), "00081030").alias("priority"), djson.value(F.col("j"), "00100020").alias("missing"))


@query("""SELECT doc_id, CASE WHEN n_chars >= 1024 AND lang <> 'de' THEN 'uri' ELSE 'inline' END AS bulk_mode, '/s/' || source || '/' || doc_id || '/7FE00010' AS uri FROM documents""")
def q9_json_bulk_decision(spark, d):
    uri = djson.bulk_uri("/s/{study}/{instance}/{tag}", F.col("source"), F.lit(None), F.col("doc_id").cast("string"), F.lit("7FE00010"))
    return table(spark, d, "documents").select("doc_id", djson.bulk_mode(F.col("n_chars"), F.col("lang") != "de").alias("bulk_mode"), uri.alias("uri"))


@query("""SELECT event_id, 'SL' AS number_vr, CASE WHEN event_id % 2 = 0 THEN 'UI' ELSE 'LO' END AS text_vr, CASE WHEN user_id % 2 = 1 THEN 'UN' ELSE 'LO' END AS private_vr FROM events""")
def q10_json_vr_inference(spark, d):
    uid = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("1.2."), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    number = F.regexp_replace(F.schema_of_variant(F.parse_json("props").cast("variant")), "OBJECT<k: (.*)>", "$1")
    kind = F.when(number == "BIGINT", "int").when(number == "DOUBLE", "double").otherwise("string")
    no = F.lit(False)
    return table(spark, d, "events").select("event_id", djson.inferred_vr(kind, F.lit(""), no).alias("number_vr"), djson.inferred_vr(F.lit("string"), uid, no).alias("text_vr"), djson.inferred_vr(F.lit("string"), F.col("event_type"), F.col("user_id") % 2 == 1).alias("private_vr"))


@query("""SELECT count(*) AS n_rows, count(*) AS rewritten, count(DISTINCT c_nationkey) AS n_targets, 0::BIGINT AS n_conflicts FROM customer""")
def q11_uid_remap(spark, d):
    rows = table(spark, d, "customer").withColumn("uid", F.concat(F.lit("1.2.840."), F.col("c_nationkey").cast("string")))
    pairs = remap.mapping(rows, "uid", "1.2.826")
    done = remap.rewrite(rows, "uid", pairs)
    out = done.agg(F.count("*").alias("n_rows"), F.sum((F.col("rewritten") & coerce.uid_strict(F.col("uid"))).cast("long")).alias("rewritten"), F.countDistinct("uid").alias("n_targets"))
    return out.crossJoin(F.broadcast(remap.conflicts(pairs).agg(F.count("*").alias("n_conflicts"))))  # one row each


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS i, l_linenumber - lag(l_linenumber) OVER w AS gap FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
a AS (SELECT *, arg_min(CASE WHEN gap > 0.001 THEN gap END, CASE WHEN gap > 0.001 THEN i END) OVER (PARTITION BY l_orderkey) AS anchor FROM g),
s AS (SELECT l_orderkey, count(*) AS n_slices, max(anchor) AS first_gap, count(*) FILTER (WHERE gap <= 0.001) AS n_duplicates, count(*) FILTER (WHERE gap > 0.001 AND abs(gap - anchor) > 0.001) AS n_uneven FROM a GROUP BY l_orderkey)
SELECT *, CASE WHEN n_duplicates > 0 THEN 'duplicate_position' WHEN n_uneven > 0 THEN 'non_uniform_spacing' ELSE 'ok' END AS status, n_duplicates = 0 AND n_uneven = 0 AND first_gap IS NOT NULL AS uniform FROM s""")
def q12_slice_stacks(spark, d):
    return stacks.analysis(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("""WITH RECURSIVE p AS (SELECT o_custkey, epoch(o_orderdate) / 86400.0 AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
g AS (SELECT o_custkey, i, x, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY i) AS gap FROM p),
r AS (SELECT o_custkey, i, 0::BIGINT AS s, NULL::DOUBLE AS anchor FROM g WHERE i = 0
 UNION ALL SELECT g.o_custkey, g.i,
  CASE WHEN r.anchor IS NOT NULL AND g.gap > 0.001 AND abs(g.gap - r.anchor) <= 0.001 THEN r.s WHEN g.gap > 0.001 THEN g.i - 1 ELSE g.i END,
  CASE WHEN r.anchor IS NOT NULL AND g.gap > 0.001 AND abs(g.gap - r.anchor) <= 0.001 THEN r.anchor WHEN g.gap > 0.001 THEN g.gap END
 FROM r JOIN g ON g.o_custkey = r.o_custkey AND g.i = r.i + 1),
e AS (SELECT o_custkey, s, max(i) AS e, any_value(anchor) FILTER (WHERE anchor IS NOT NULL) AS anchor FROM r GROUP BY o_custkey, s HAVING max(i) - s >= 2 AND max(anchor) IS NOT NULL)
SELECT e.o_custkey, a.x AS run_start, b.x AS run_end, e.anchor AS run_gap FROM e JOIN p a ON a.o_custkey = e.o_custkey AND a.i = e.s JOIN p b ON b.o_custkey = e.o_custkey AND b.i = e.e""")
def q13_uniform_runs(spark, d):
    rows = table(spark, d, "orders").withColumn("x", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    return stacks.uniform_runs(rows, ["o_custkey"], "x")


@query("""WITH t AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS off, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, doc_id, (coalesce(lead(off) OVER (PARTITION BY source ORDER BY off), total) - off)::BIGINT AS frame_length FROM t""")
def q14_offset_tables(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("source")
    rows = table(spark, d, "documents").select("source", "doc_id", (F.sum("n_chars").over(w.orderBy("doc_id")) - F.col("n_chars")).alias("off"), F.sum("n_chars").over(w).alias("total"))
    return stacks.frame_lengths(rows, ["source"], "off", "total").select("source", "doc_id", "frame_length")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n_members, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey)) AS members_md5 FROM orders GROUP BY ALL""")
def q15_frame_groups(spark, d):
    g = stacks.groups(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", ["o_orderdate"])
    return g.select("o_orderpriority", "o_orderstatus", "n_members", F.md5(F.array_join(F.transform("members", lambda m: m.cast("string")), ",").cast("binary")).alias("members_md5"))


@query("""WITH g AS (SELECT o_custkey, epoch(o_orderdate) / 86400.0 - lag(epoch(o_orderdate) / 86400.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS gap FROM orders) SELECT o_custkey, median(gap) AS median_gap FROM g WHERE gap > 0 GROUP BY o_custkey""")
def q16_median_gap(spark, d):
    rows = table(spark, d, "orders").withColumn("x", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    return stacks.median_gap(rows, ["o_custkey"], "x")


@query("""SELECT label, count(*) AS voxels, min(vec_id % 8) AS min_x, max(vec_id % 8) AS max_x, sum(vec_id % 8)::BIGINT AS sum_x, min(vec_id // 8) AS min_y, max(vec_id // 8) AS max_y, sum(vec_id // 8)::BIGINT AS sum_y,
 sum(vec_id % 8) / count(*) AS centroid_x, sum(vec_id // 8) / count(*) AS centroid_y FROM embeddings GROUP BY label""")
def q17_label_stats(spark, d):
    v = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 8).alias("x"), F.floor(F.col("vec_id") / 8).alias("y"))
    return labels.stats(v, "label", ["x", "y"])


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, labels, dense_rank() OVER (ORDER BY labels)::INTEGER AS code, contains(labels, 'R') AS has_r FROM s""")
def q18_label_sets(spark, d):
    sets = labels.label_sets(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")
    return sets.join(F.broadcast(labels.set_codes(sets)), "labels").select("l_orderkey", F.array_join("labels", ",").alias("labels"), "code", labels.has_label(F.col("labels"), "R").alias("has_r"))


@query("SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE * (label + 1) - label AS v FROM embeddings, unnest(range(1, 65)) AS t(i)")
def q19_rescale(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(pixels.rescale(F.col("embedding"), F.col("label") + 1, -F.col("label"))).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("SELECT vec_id, [100,90,80,70,60,50][least(greatest(label - 2, 0), 5) + 1] AS v FROM embeddings")
def q20_modality_lut(spark, d):
    return table(spark, d, "embeddings").select("vec_id", pixels.lut(F.col("label"), F.array(*map(F.lit, range(100, 49, -10))), F.lit(2)).alias("v"))


@query("""WITH t AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x FROM embeddings)
SELECT vec_id, trunc(least(greatest(CASE WHEN x <= -0.5 - 199.5 THEN 0 WHEN x > -0.5 + 199.5 THEN 1 ELSE (x + 0.5) / 399 + 0.5 END, 0), 1) * 255)::INTEGER AS linear,
 trunc(least(greatest(CASE WHEN x <= -200 THEN 0 WHEN x > 200 THEN 1 ELSE x / 400 + 0.5 END, 0), 1) * 255)::INTEGER AS exact,
 trunc(1 / (1 + exp(-4 * x / 400)) * 255)::INTEGER AS sigmoid FROM t""")
def q21_windows(spark, d):
    x, c, w = F.col("embedding")[0].cast("double") * 1000, F.lit(0.0), F.lit(400.0)
    return table(spark, d, "embeddings").select("vec_id", *(pixels.window(x, c, w, f).alias(n) for n, f in (("linear", "linear"), ("exact", "linear_exact"), ("sigmoid", "sigmoid"))))


@query("SELECT vec_id, (label % 4) * 10 AS r, 255 - (label % 4) AS g, CASE WHEN label % 4 = 3 THEN 7 ELSE 0 END AS b FROM embeddings")
def q22_palette(spark, d):
    p = pixels.palette(F.col("label") % 4, F.array(*map(F.lit, (0, 10, 20, 30))), F.array(*map(F.lit, (255, 254, 253, 252))), F.array(*map(F.lit, (0, 0, 0, 7))), F.lit(0))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", "p.r", "p.g", "p.b")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 1)::INTEGER AS b0, ((l_partkey >> 1) & 1)::INTEGER AS b1, ((l_partkey >> 2) & 1)::INTEGER AS b2, ((l_partkey >> 3) & 1)::INTEGER AS b3 FROM lineitem")
def q23_bit_unpack(spark, d):
    b = pixels.unpack_bits(F.col("l_partkey"), 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(F.get(b, F.lit(i)).alias(f"b{i}") for i in range(4)))


@query("""WITH t AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), u AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM t)
SELECT vec_id, round(x / n, 9) AS ux, round(y / n, 9) AS uy, round(z / n, 9) AS uz, round(1 + x / n * label * 2, 6) AS wx, round(2 + y / n * label * 2, 6) AS wy, label::DOUBLE AS back, label >= -0.5 AND label < 4.5 AS inside FROM u""")
def q24_geometry(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", geometry.unit(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))))
    u, o = F.col("u"), geometry.vector(1, 2, 3)
    world = geometry.index_to_world(o, u, geometry.vector(0, 0, 0), F.lit(2.0), F.col("label"), F.lit(0))
    back = geometry.world_to_index(o, u, geometry.vector(0, 0, 0), F.lit(2.0), world)
    return e.select("vec_id", *(F.round(u[i], 9).alias(n) for i, n in enumerate(("ux", "uy", "uz"))), F.round(world[0], 6).alias("wx"), F.round(world[1], 6).alias("wy"), F.round(back[0], 6).alias("back"), geometry.contains_index(F.col("label").cast("double"), F.lit(5)).alias("inside"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'non_parallel' WHEN p_size % 5 = 0 THEN 'opposite_normal' WHEN p_size > 40 THEN 'out_of_plane' WHEN p_partkey % 3 = 0 THEN 'different_extent' WHEN p_partkey % 2 = 0 THEN 'compatible' WHEN p_size < 10 THEN 'different_spacing' WHEN p_size < 20 THEN 'different_extent' ELSE 'requires_resampling' END AS status FROM part""")
def q25_overlay_ladder(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey")
    normal = F.when(s % 7 == 0, 0.5).when(s % 5 == 0, -1.0).otherwise(1.0)
    status = geometry.overlay_status(normal, F.when(s > 40, 1.0).otherwise(0.0), k % 3 != 0, k % 2 == 0, s >= 10, s >= 20)
    return table(spark, d, "part").select("p_partkey", status.alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, CASE WHEN p_size > 25 THEN p_retailprice END, -1.0) AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def q26_layered_lookup(spark, d):
    frames = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("v"))
    shared = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("v"))
    return elements.layered(frames, shared, spark.sql("SELECT -1.0D AS v"), ["l_partkey"], ["l_partkey"], "v").select("l_orderkey", "l_linenumber", "l_partkey", "v")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS charset FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q27_nearest_ancestor(spark, d):
    n = F.broadcast(table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), "r_name").alias("charset"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0 UNION ALL SELECT -o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 2""")
def q28_overlay(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_orderkey") % 6 == 0).alias("gone"))
    new = o.filter("o_orderkey % 10 = 2").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(False).alias("gone"))
    return elements.overlay(o, changed.unionByName(new), ["o_orderkey"], "o_orderstatus", "gone")


@query("""WITH t AS (SELECT doc_id, n_chars, regexp_replace(text, '[\\r\\n\\t]', ' ', 'g') AS c FROM documents)
SELECT doc_id, '00104000' || chr(9) || 'LT' || chr(9) || n_chars || chr(9) || '1' || chr(9) || CASE WHEN length(c) > 40 THEN substring(c, 1, 37) || '...' ELSE c END || chr(9) || 'PatientComments' AS line FROM t""".replace("\\\\", "\\"))
def q29_dump_lines(spark, d):
    line = coerce.dump_line(F.lit("00104000"), F.lit("LT"), F.col("n_chars"), F.lit(1), F.col("text"), F.lit("PatientComments"))
    return table(spark, d, "documents").select("doc_id", line.alias("line"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def q30_payload_split(spark, d):
    meta, payload = elements.split_payload(table(spark, d, "documents"), "doc_id", "text")
    return elements.join_payload(meta, payload, "doc_id").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT l_orderkey, l_linenumber, l_discount, l_discount / 0.1 >= 0.5 AS half, l_discount > 0 AS any_value, l_linenumber = 3 AS third, l_linenumber <> 0 AS bits FROM lineitem")
def q31_segment_masks(spark, d):
    v, most = F.col("l_discount"), F.lit(0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", labels.mask(v, "FRACTIONAL", 0.5, most).alias("half"), labels.mask(v, "FRACTIONAL", 0, most).alias("any_value"), labels.mask(F.col("l_linenumber"), "LABELMAP", label=3).alias("third"), labels.mask(F.col("l_linenumber"), "BINARY").alias("bits"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = user_id % 2 AND event_id % 3 = user_id % 3 THEN CASE WHEN value > 50 THEN 'metadata_overlay' ELSE 'as_is' END WHEN event_id % 2 = 0 AND user_id % 2 = 1 THEN 'native_to_encapsulated' WHEN event_id % 2 = 1 AND user_id % 2 = 0 THEN 'encapsulated_to_native' WHEN event_id % 2 = 1 THEN 'encapsulated_to_encapsulated' ELSE 'native_to_native' END AS decision FROM events""")
def q32_transcode_decision(spark, d):
    from ..operators.transcode import decision

    e, u = F.col("event_id"), F.col("user_id")
    same = (e % 2 == u % 2) & (e % 3 == u % 3)
    return table(spark, d, "events").select("event_id", decision(same, e % 2 == 1, u % 2 == 1, F.col("value") > 50).alias("decision"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate IS NULL THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown, o_orderkey % 2 = 1 AS private, o_orderkey % 65536 = 0 AS group_length FROM orders")
def q33_tag_predicates(spark, d):
    tag = F.shiftleft(F.col("o_orderkey"), 16)
    return table(spark, d, "orders").select("o_orderkey", coerce.shown_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("shown"), tags.is_private(tag).alias("private"), tags.is_group_length(F.col("o_orderkey")).alias("group_length"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 'F' ELSE 'O' END AS worst_status FROM lineitem GROUP BY l_orderkey""")
def q34_worst_status(spark, d):
    return stacks.worst_status(table(spark, d, "lineitem"), ["l_orderkey"], "l_linestatus", ["F", "O"])


@query("""SELECT vec_id, i - 1 AS i, CASE WHEN hi > lo THEN trunc((embedding[i]::DOUBLE - lo) / (hi - lo) * 255)::INTEGER ELSE 0 END AS v FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings), unnest(range(1, 65)) AS t(i)""")
def q35_min_max(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(pixels.min_max(x)).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@query("""SELECT vec_id, i - 1 AS i, embedding[((i - 1) % 2) * 32 + (i - 1) // 2 + 1] AS interleaved, embedding[i] AS back FROM embeddings, unnest(range(1, 65)) AS t(i)""")
def q36_planar_layout(spark, d):
    mixed = pixels.interleaved(F.col("embedding"), 2)
    e = table(spark, d, "embeddings").withColumn("m", mixed)
    return e.select("vec_id", F.posexplode(F.arrays_zip(F.col("m").alias("a"), pixels.planar(F.col("m"), 2).alias("b"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x.a").alias("interleaved"), F.col("x.b").alias("back"))


@query("SELECT doc_id, md5(rtrim(text, ' ')) AS text_md5, lang, n_chars FROM documents")
def q37_record_round_trip(spark, d):
    """Binary records of all documents, written, parsed and pivoted."""
    made = sink.build(table(spark, d, "documents"), "doc_id", {"StudyDescription": "lang", "InstanceNumber": "n_chars", "TextValue": "text"}, p10.DEFLATED)
    w = elements.wide(records.elements(made), ["StudyDescription", "InstanceNumber", "TextValue"])
    return w.select(F.col("instance_id").cast("bigint").alias("doc_id"), F.md5(F.col("TextValue").cast("binary")).alias("text_md5"), F.col("StudyDescription").alias("lang"), F.col("InstanceNumber").cast("bigint").alias("n_chars"))


@query("SELECT vec_id, 8 AS n_rows, 8 AS n_columns, list_sum(list_transform(embedding, lambda x: floor(x * 100) + 100))::BIGINT AS total, (floor(embedding[10] * 100) + 100)::BIGINT AS tenth FROM embeddings")
def q38_rle_frames(spark, d):
    """Embeddings as 8 x 8 images of two bytes a sample, written natively, transcoded to RLE, decoded."""
    return transcoded_images(spark, d, frames.RLE)


def transcoded_images(spark, d, syntax):
    """Samples are signed and computed in the embeddings' own type, as SQL does: single precision may round a product up to the next whole number."""
    rows = spread(table(spark, d, "embeddings").select("vec_id", "embedding"))
    hundred = F.lit(100).cast(rows.schema["embedding"].dataType.elementType)
    value = F.transform("embedding", lambda x: F.pmod(F.floor(x * hundred) + 100, F.lit(65536)))
    raw = F.unhex(F.array_join(F.transform(value, lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))), ""))
    e = rows.select("vec_id", raw.alias("raw"), F.lit(8).alias("side"), F.lit(16).alias("bits"), F.lit(1).alias("one"))
    made = sink.build(e, "vec_id", {"Rows": "side", "Columns": "side", "BitsAllocated": "bits", "PixelRepresentation": "one", "SamplesPerPixel": "one", "PixelData": "raw"})
    f = frames.frames(frames.transcoded(made, syntax))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("samples"), i, F.lit(1))), 16, 10).cast("bigint")
    sample = lambda i: byte(i * 2 + 1) + 256 * ((byte(i * 2 + 2) + 128) % 256 - 128)
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), sample), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return f.select(F.col("instance_id").cast("bigint").alias("vec_id"), "n_rows", "n_columns", total.alias("total"), sample(F.lit(9)).alias("tenth"))


@query("SELECT c_custkey, c_name AS patient, c_nationkey AS instance, c_mktsegment AS segment FROM customer")
def q39_json_records(spark, d):
    """Records as JSON and back."""
    made = sink.build(table(spark, d, "customer"), "c_custkey", {"PatientName": "c_name", "InstanceNumber": "c_nationkey", "StudyDescription": "c_mktsegment"})
    back = jsonmodel.from_json(jsonmodel.to_json(made))
    w = elements.wide(records.elements(back, columns=["instance_id", "depth", "tag_hex", "text"]), ["PatientName", "InstanceNumber", "StudyDescription"])
    return w.select(F.col("instance_id").cast("bigint").alias("c_custkey"), F.col("PatientName").alias("patient"), F.col("InstanceNumber").cast("int").alias("instance"), F.col("StudyDescription").alias("segment"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'out_of_plane' WHEN p_partkey % 2 = 1 THEN 'different_extent' WHEN p_partkey % 5 = 0 THEN 'different_spacing' WHEN p_partkey % 7 = 0 THEN 'different_extent' ELSE 'compatible' END AS plane_status,
 CASE WHEN p_partkey % 2 = 1 THEN 'different_extent' WHEN p_partkey % 5 = 0 THEN 'different_spacing' WHEN p_partkey % 7 = 0 THEN 'different_extent' WHEN p_size % 3 = 1 THEN 'requires_resampling' ELSE 'compatible' END AS volume_status FROM part""")
def q40_overlay_grids(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    axes = (geometry.vector(1, 0, 0), geometry.vector(0, 1, 0))
    step, n = F.when(k % 5 == 0, 2.0).otherwise(1.0), F.when(k % 7 == 0, 5).otherwise(4)
    source = geometry.plane(F.array((k % 2 * 9).cast("double"), F.lit(0.0), (s % 3).cast("double")), axes, (step, step), (n, n))
    target = geometry.plane(geometry.vector(0, 0, 0), axes, (1.0, 1.0), (4, 4))
    volume = geometry.volume(geometry.vector(0, 0, 0), (*axes, geometry.vector(0, 0, 1)), (1.0, 1.0, 2.0), (4, 4, 5))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", source.alias("source"), target.alias("target"), volume.alias("volume"), F.lit("1.2").alias("frame"))
    flat = overlay.check(rows, "source", "target", "frame", "frame", True, True).withColumn("plane_status", F.col("overlay.status")).drop("overlay")
    return overlay.check(flat, "source", "volume", "frame", "frame", True, False).select("p_partkey", "plane_status", F.col("overlay.status").alias("volume_status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber - 0.5) / 2 AS i, l_quantity AS j, (l_partkey - 3.0) / 4 AS k, (l_linenumber - 0.5) / 2 < 2.5 AND l_quantity < 19.5 AND (l_partkey - 3.0) / 4 >= -0.5 AND (l_partkey - 3.0) / 4 < 99.5 AS inside FROM lineitem")
def q41_grid_indexes(spark, d):
    grid = geometry.volume(geometry.vector(0.5, 0, 3), (geometry.vector(1, 0, 0), geometry.vector(0, 1, 0), geometry.vector(0, 0, 1)), (2.0, 1.0, 4.0), (3, 20, 100))
    world = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.col("l_partkey").cast("double"))
    rows = table(spark, d, "lineitem").withColumn("index", geometry.grid_to_index(grid, world))
    i = F.col("index")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", i[0].alias("i"), i[1].alias("j"), i[2].alias("k"), geometry.grid_contains(grid, i).alias("inside"))


@query("""WITH t AS (SELECT vec_id, label, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, embedding[1]::DOUBLE AS x FROM embeddings),
s AS (SELECT vec_id, label, CASE WHEN label < 5 THEN CASE WHEN x <= -0.25 THEN 0 WHEN x > 0.25 THEN 255 ELSE trunc((x / 0.5 + 0.5) * 255)::INTEGER END ELSE trunc((x - lo) / (hi - lo) * 255)::INTEGER END AS v FROM t)
SELECT vec_id, CASE WHEN label % 2 = 1 THEN 255 - v ELSE v END AS shown FROM s""")
def q42_display(spark, d):
    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    label = F.col("label")
    shown = pixels.display(F.col("x"), F.when(label % 2 == 1, "MONOCHROME1").otherwise("MONOCHROME2"), F.when(label < 5, 0.0), F.when(label < 5, 0.5), "linear_exact")
    return e.select("vec_id", F.get(shown, F.lit(0)).alias("shown"))


@query("SELECT n_nationkey AS label, count(c_custkey) AS n_frames, md5(coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey), '')) AS frames_md5 FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 99, 0, md5('')")
def q43_segment_frames(spark, d):
    """Every customer is a frame of its nation's segment; segment 99 has none."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("label"))
    segments = nations.unionByName(spark.range(99, 100).select(F.col("id").cast(nations.schema["label"].dataType).alias("label")))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("frame"))
    return labels.segment_frames(segments, found, "label", "frame").select("label", "n_frames", F.md5(F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").cast("binary")).alias("frames_md5"))


@query("""WITH s AS (SELECT l_orderkey, max(l_linestatus) AS last, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS labels FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, labels, dense_rank() OVER (ORDER BY labels)::INTEGER AS code, last AS painted, false AS over_limit FROM s""")
def q44_label_volume(spark, d):
    rows = table(spark, d, "lineitem")
    every = labels.volume(rows, ["l_orderkey"], "l_linestatus")
    top = labels.volume(rows, ["l_orderkey"], "l_linestatus", "no").select("l_orderkey", F.get("labels", F.lit(0)).alias("painted"))
    return every.join(top, "l_orderkey").select("l_orderkey", F.array_join("labels", ",").alias("labels"), "code", "painted", "over_limit")


@query("SELECT c_custkey AS instance_id, c_name AS text FROM customer WHERE c_custkey % 2 = 0")
def q45_private_elements(spark, d):
    """Each customer reserves block 0x10 or 0x11 for a maker; the element of the maker MAKER is looked up."""
    c = table(spark, d, "customer")
    block = F.when(F.col("c_custkey") % 4 == 0, 0x10).otherwise(0x11)
    maker = F.when(F.col("c_custkey") % 2 == 0, "MAKER ").otherwise("OTHER")
    base = 0x00290000
    two = F.array(F.struct((block + base).alias("tag"), maker.alias("text")), F.struct((block * 256 + 1 + base).alias("tag"), F.col("c_name").alias("text")))
    rows = c.select(F.col("c_custkey").alias("instance_id"), F.lit("").alias("parent_path"), F.explode(two).alias("e")).select("instance_id", "parent_path", F.col("e.tag").cast("bigint").alias("tag"), "e.text")
    return elements.private(rows, 0x0029, 0x01, "MAKER").select("instance_id", "text")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'B' WHEN o_orderkey % 2 = 0 THEN 'A' END AS charset FROM orders")
def q46_inherited_charset(spark, d):
    """A text two levels down inherits the set of the item around it, else of the root."""
    k = F.col("o_orderkey")
    rows = F.array(
        F.when(k % 2 == 0, F.struct(F.lit("").alias("parent_path"), F.lit("00080005").alias("tag_hex"), F.lit("A").alias("text"))),
        F.when(k % 3 == 0, F.struct(F.lit("00620002.1").alias("parent_path"), F.lit("00080005").alias("tag_hex"), F.lit("B").alias("text"))),
        F.struct(F.lit("00620002.1.00620003.0").alias("parent_path"), F.lit("00100010").alias("tag_hex"), F.col("o_orderstatus").alias("text")),
    )
    e = table(spark, d, "orders").select(k.alias("instance_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("instance_id", "e.*")
    return elements.nearest_charset(e).filter("tag_hex = '00100010'").select(F.col("instance_id").alias("o_orderkey"), "charset")


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_pairs, true AS integers, CASE WHEN min(l_suppkey) - max(l_linenumber) >= 0 THEN CASE WHEN max(l_suppkey) - min(l_linenumber) < 256 THEN 'uint8' WHEN max(l_suppkey) - min(l_linenumber) < 65536 THEN 'uint16' ELSE 'uint32' END
 WHEN min(l_suppkey) - max(l_linenumber) >= -128 AND max(l_suppkey) - min(l_linenumber) < 128 THEN 'int8' WHEN max(l_suppkey) - min(l_linenumber) < 32768 THEN 'int16' ELSE 'int32' END AS kind FROM lineitem GROUP BY l_orderkey""")
def q47_rescale_plan(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.lit(1.0).alias("slope"), (-F.col("l_linenumber")).cast("double").alias("intercept"), "l_suppkey")
    return series.rescale_plan(rows, ["l_orderkey"], "l_suppkey", "l_suppkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity - first(l_quantity) OVER w) AS position_along, abs(l_tax - first(l_tax) OVER w) AS residual FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey, l_quantity, l_tax)")
def q48_positions_along(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ord", F.struct(F.expr("l_linenumber * 1000000000L + l_partkey * 10000 + l_suppkey"), "l_quantity", "l_tax"))
    rows = rows.withColumns({"o": F.array("l_tax", F.lit(0.0), "l_quantity"), "n": geometry.vector(0, 0, 1)})
    return series.along_normal(rows, ["l_orderkey"], "o", "n", "ord").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "position_along", "residual")


@query("SELECT c_custkey, '1.2.' || c_nationkey || '.' || c_custkey AS uid, c_custkey % 2 = 0 AS is_long FROM customer")
def q49_uid_append(spark, d):
    short = F.concat(F.lit("1.2."), F.col("c_nationkey").cast("string"))
    long = F.concat(F.lit("1.2."), F.repeat(F.lit("3"), 58))
    fallback = remap.append(long, F.col("c_custkey") + 1_000_000)
    fits = coerce.uid_strict(fallback) & F.startswith(fallback, F.lit("1.2." + "3" * 26 + "."))
    return table(spark, d, "customer").select("c_custkey", remap.append(short, F.col("c_custkey")).alias("uid"), (fits & (F.col("c_custkey") % 2 == 0)).alias("is_long"))


@query("""SELECT event_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'lossy target' END ELSE 'bits don''t suit the type' END AS problem, CASE WHEN user_id % 2 = 1 OR event_id % 5 = 0 THEN '01' ELSE '00' END AS lossy FROM events""")
def q50_segmentation_writes(spark, d):
    e = table(spark, d, "events")
    least = F.broadcast(e.agg(F.min("event_type").alias("least")))  # one row
    bits = F.when(F.col("event_type") == F.col("least"), 1).otherwise(8)
    problem = labels.write_errors(F.lit("BINARY"), bits, F.lit("MONOCHROME2"), F.lit(1), F.col("user_id") % 2 == 1)
    state = transcode.lossy_state(F.when(F.col("event_id") % 5 == 0, "01").otherwise("00"), F.col("user_id") % 2 == 1)
    return e.crossJoin(least).select("event_id", problem.alias("problem"), state.alias("lossy"))


@query("SELECT source, lang, last_id, last_chars FROM (SELECT source, lang, doc_id AS last_id, n_chars AS last_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def q51_last_of_equal_keys(spark, d):
    rows = table(spark, d, "documents").withColumnsRenamed({"n_chars": "last_chars"}).withColumn("last_id", F.col("doc_id"))
    return elements.duplicates_last(rows, ["source", "lang"], "doc_id", ["last_id", "last_chars"])


@query("SELECT p_partkey, least(greatest(y + 1.402 * r, 0), 255)::DOUBLE AS red, least(greatest(y - 0.344136 * b - 0.714136 * r, 0), 255)::DOUBLE AS green, least(greatest(y + 1.772 * b, 0), 255)::DOUBLE AS blue FROM (SELECT p_partkey, trunc(1.0 * (p_partkey % 256)) AS y, p_size * 5 - 128.0 AS b, p_partkey % 200 - 128.0 AS r FROM part)".replace("least(greatest(", "trunc(least(greatest(").replace(", 255)::DOUBLE", ", 255))::DOUBLE"))
def q52_ybr(spark, d):
    rgb = pixels.ybr_to_rgb(F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") % 200)
    return table(spark, d, "part").select("p_partkey", *(rgb[c].cast("double").alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))))
