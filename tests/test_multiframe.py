import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import geometry as G
from lumenfold.functions import pixels
from lumenfold.operators import elements, labels, multiframe, overlay, remap, series
from lumenfold.sources import charset, frames, jsonmodel, p10, records

PIXELS = np.arange(2 * 3 * 4, dtype="<u2")
GROUP = lambda tag, *rows: (tag, "SQ", [list(rows)])
POSITION = [[GROUP(0x00209113, (0x00200032, "DS", f"0\\0\\{z}")), GROUP(0x00209111, (0x00209056, "SH", "s"), (0x00209057, "UL", [z + 1]))] for z in (0, 5)]
BODY = [
    (0x00080016, "UI", "1.2"), (0x00080018, "UI", "1.2.3"), (0x0020000D, "UI", "1.2.8"), (0x0020000E, "UI", "1.2.9"), (0x00200052, "UI", "1.2.7"), (0x00280002, "US", [1]), (0x00280004, "CS", "MONOCHROME2"),
    (0x00280008, "IS", "2"), (0x00280010, "US", [3]), (0x00280011, "US", [4]), (0x00280100, "US", [16]), (0x00280103, "US", [0]), (0x00281053, "DS", "2"), (0x00281052, "DS", "-1"), (0x7FE00010, "OW", PIXELS.tobytes()),
    (0x52009229, "SQ", [[GROUP(0x00209116, (0x00200037, "DS", "1\\0\\0\\0\\1\\0")), GROUP(0x00289110, (0x00280030, "DS", "0.5\\0.25"))]]), (0x52009230, "SQ", POSITION),
    (0x00290010, "LO", "MAKER"), (0x00291001, "LO", "private"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([("a", p10.write(BODY))], "instance_id string, content binary")
    return records.elements(rows).cache()


def test_frames_in_every_syntax(spark):
    data = p10.write(BODY)
    rows = [(s, frames.transcode(data, s)) for s in (*frames.NATIVE, frames.RLE)] + [("none", b""), ("null", None), ("short", p10.write([(t, v, x if t != p10.PIXELS else b"\0\0") for t, v, x in BODY]))]
    got = frames.frames(spark.createDataFrame(rows, "instance_id string, content binary")).collect()
    for s in (*frames.NATIVE, frames.RLE):
        assert b"".join(bytes(r.samples) for r in sorted((r for r in got if r.instance_id == s), key=lambda r: r.frame)) == PIXELS.tobytes()
    assert {r.instance_id for r in got if r.error} == {"none", "null", "short"}
    back = frames.transcoded(spark.createDataFrame(rows[-4:-3], "instance_id string, content binary"), p10.EXPLICIT).first()
    assert [x for _, _, x in frames.frames_of(bytes(back.content))] == [x for _, _, x in frames.frames_of(data)]
    with pytest.raises(p10.Broken):
        frames.transcode(data, "1.2.840.10008.1.2.4.90")


def test_fragments():
    offsets = np.array([0, 20], "<u4").tobytes()
    assert frames.split_fragments([offsets, b"abcd", b"", b"ef"], 2) == [b"abcd", b"ef"]
    assert frames.split_fragments([b"", b"ab\xff\xd9", b"c", b"d\xff\xd9\0"], 2) == [b"ab\xff\xd9", b"cd\xff\xd9\0"]
    with pytest.raises(p10.Broken):
        frames.split_fragments([b"", b"a", b"b", b"c"], 2)
    assert frames.check_extended(*frames.extended_offsets([b"abc", b"de"]), 22) is None
    assert frames.check_extended([0, 0], [1, 1], 40) == "offset 1 does not rise"


def test_groups(found):
    rows = multiframe.planes(found).orderBy("frame").collect()
    assert [r.status for r in rows] == ["ok", "ok"] and [r.plane.origin[2] for r in rows] == [0.0, 5.0] and rows[0].plane.spacing[:2] == [0.25, 0.5] and rows[0].plane.size[:2] == [4.0, 3.0]
    t = multiframe.transforms(found).first()
    assert (t.slope, t.intercept, t.center, t.status) == (2.0, -1.0, None, "ok")
    assert [tuple(r)[1:] for r in multiframe.stack_keys(found).select("instance_id", "frame", "stack_id", "in_stack_position").orderBy("frame").collect()] == [(0, "s", 1), (1, "s", 6)]
    assert multiframe.references(found).count() == 0 and multiframe.tiled(found).count() == 0
    assert multiframe.planes(found.filter("path NOT LIKE '5200%'")).first().status == "missing_position"


def test_elements(found):
    assert elements.private(found, 0x0029, 0x01, "MAKER").first().text == "private"
    assert elements.private(found, 0x0029, 0x01, "OTHER").count() == 0
    with pytest.raises(ValueError):
        elements.private(found, 0x0028, 0x01, "MAKER")
    changed = elements.with_value(elements.with_value(found, "PatientID", F.lit("x")), "Modality", F.lit("CT"))
    assert elements.wide(changed, ["PatientID", "Modality"]).first()[1:] == ("x", "CT")
    assert changed.count() == found.count() + 2
    assert elements.without(found, "52009229").filter("path LIKE '52009229%'").count() == 0
    sets = found.sparkSession.createDataFrame([("a", "", "00080005", "A"), ("a", "00620002.0", "00080005", "B"), ("a", "00620002.0.00620003.0", "00100010", "t"), ("a", "00620002.1", "00100010", "t"), ("b", "", "00100010", "t")], "instance_id string, parent_path string, tag_hex string, text string")
    assert {(r.instance_id, r.parent_path): r.charset for r in elements.nearest_charset(sets).filter("text = 't'").collect()} == {("a", "00620002.0.00620003.0"): "B", ("a", "00620002.1"): "A", ("b", ""): None}


def test_uid_rewrite(found, tmp_path):
    out, pairs = remap.rewrite_elements(found, "1.2.826")
    assert out.filter("rewritten").count() == 4 and pairs.count() == 3  # the instance's UID is in the file meta, too
    path = str(tmp_path / "pairs")
    remap.save(pairs, None, path)
    known = found.sparkSession.read.parquet(path)
    again, more = remap.rewrite_elements(found, "1.2.999", known, frames_of_reference=True)
    assert more.count() == 4 and again.filter("rewritten AND text LIKE '1.2.826.%'").count() == 4
    with pytest.raises(ValueError):
        remap.save(pairs.withColumn("target_uid", F.lit("1.2")), known, path)
    long = F.lit("1.2." + "3" * 58)
    r = found.select(remap.append(F.lit("1.2"), F.lit(7)), remap.append(long, F.lit(1234567)), remap.append(F.lit("1..2"), F.lit(1))).first()
    assert r[0] == "1.2.7" and r[1].startswith("1.2." + "3" * 26 + ".") and len(r[1]) <= 64 and r[2] is None


def test_json(spark):
    data = p10.write([e for e in BODY if e[0] >> 16 != 0x0029])
    texts = jsonmodel.to_json(spark.createDataFrame([("a", data), ("b", b"\1\2\3\4\5\6\7\1\2")], "instance_id string, content binary")).orderBy("instance_id").collect()
    assert texts[0].error is None and texts[1].json in (None, "{}")
    back = jsonmodel.from_json(spark.createDataFrame([("a", texts[0].json), ("c", "[]"), ("d", "{"), ("e", f"[{texts[0].json},{texts[0].json}]")], "instance_id string, json string")).collect()
    assert sorted((r.instance_id, r.item) for r in back if r.error is None) == [("a", 0), ("e", 0), ("e", 1)] and [r.instance_id for r in back if r.error] == ["d"]
    assert [s for _, _, s in frames.frames_of(bytes(back[0].content))] == [s for _, _, s in frames.frames_of(data)]
    _, parts = jsonmodel.write(frames.transcode(data, frames.RLE), "uri", template="/{study}/{instance}/{tag}")
    assert [(p[1], p[2], p[3]) for p in parts] == [(k, f"/1.2.8/1.2.3/7FE00010/frames/{k + 1}", "image/dicom-rle") for k in (0, 1)]
    for template in ("/{x}", "/{tag", "/fixed/}"):
        with pytest.raises(p10.Broken):
            jsonmodel.write(data, "uri", 1, template)


def test_overlay(spark):
    flat = lambda z, n=4, step=1.0, x=0.0, flip=1: G.plane(G.vector(x, 0, z), (G.vector(flip, 0, 0), G.vector(0, 1, 0)), (step, step), (n, n))
    v = G.volume(G.vector(0, 0, 0), tuple(G.vector(*(float(i == k) for i in range(3))) for k in range(3)), (1.0, 1.0, 2.0), (4, 4, 5))
    df = spark.range(1).select(F.lit("1").alias("f"), F.lit("2").alias("g"), F.lit("").alias("e"), flat(0).alias("a"), flat(4).alias("b"), flat(0, n=5).alias("c"), flat(0, x=9).alias("d"), flat(0, step=2.0).alias("h"), flat(0, flip=-1).alias("m"), flat(1).alias("o"), v.alias("v"))
    cases = [("a", "a", "f", "compatible"), ("a", "a", "g", "different_frame_of_reference"), ("a", "a", "e", "missing_frame_of_reference"), ("a", "b", "f", "out_of_plane"), ("a", "c", "f", "different_extent"), ("a", "d", "f", "different_extent"), ("a", "h", "f", "different_spacing"), ("a", "m", "f", "opposite_orientation"), ("b", "v", "f", "compatible"), ("o", "v", "f", "requires_resampling"), ("v", "b", "f", "compatible"), ("v", "v", "f", "compatible")]
    for s, t, frame, status in cases:
        r = overlay.check(df, s, t, "f", frame, s != "v", t != "v").first().overlay
        assert r.status == status and r.can_direct == (status == "compatible"), (s, t, frame, r)
    r = df.select(G.grid_to_grid(F.col("b"), F.col("v"), F.array(*map(F.lit, (1.0, 2.0, 0.0)))).alias("i"), G.grid_contains(F.col("v"), F.array(*map(F.lit, (-0.5, 3.4, 4.6)))).alias("c"), G.grid_matrix(F.col("v")).alias("m")).first()
    assert r.i == [1.0, 2.0, 2.0] and r.c is False and r.m[10] == 2.0
    bad = spark.range(1).select(G.grid_status((F.lit(1),) * 3, (F.lit(1.0),) * 3, (G.vector(1, 0, 0), G.vector(0, 1, 0), G.vector(0, 0, -1))), G.grid_status((F.lit(0), F.lit(1)), (F.lit(1.0),) * 2, (G.vector(1, 0, 0), G.vector(0, 1, 0))), G.grid_status((F.lit(1),) * 2, (F.lit(1.0),) * 2, (G.vector(2, 0, 0), G.vector(0, 1, 0)))).first()
    assert tuple(bad) == ("invalid_orientation", "invalid_size", "ok")


def test_pixels(spark):
    assert pixels.expand_segments([0, 2, 10, 20, 1, 2, 30, 2, 1, 0, 0], 16) == [10, 20, 25, 30, 10, 20]
    for broken in ([1, 2, 3], [0, 5, 1], [3, 1, 1], [0, 1, 5, 2, 1, 99, 0]):
        with pytest.raises(ValueError):
            pixels.expand_segments(broken, 16)
    none = F.lit(None).cast("double")
    x = F.array(*map(F.lit, (0, 5, 10)))
    r = spark.range(1).select(pixels.display(x, F.lit("MONOCHROME1"), none, none), pixels.display(x, F.lit("MONOCHROME2"), F.lit(5.0), F.lit(10.0), "linear_exact"), pixels.ybr_to_rgb(F.lit(100), F.lit(128), F.lit(255)), pixels.integer_kind(F.lit(-1), F.lit(200)), pixels.lut_descriptor(F.array(*map(F.lit, (0, 65535, 16))), F.lit(True))).first()
    assert r[0] == [255, 128, 0] and r[1] == [0, 127, 255] and tuple(r[2]) == (255, 9, 100) and r[3] == "int16" and tuple(r[4]) == (65536, -1, 16)


def test_texts():
    assert charset.decode(b"Yamada^Tarou=\x1b$B;3ED\x1b(B^\x1b$BB@O:\x1b(B", "\\ISO 2022 IR 87", delimiters=b"\\^=") == "Yamada^Tarou=山田^太郎"
    for text, sets in (("山田 x", "\\ISO 2022 IR 87"), ("金^喜", "\\ISO 2022 IR 149"), ("é山", "ISO 2022 IR 100\\ISO 2022 IR 87"), ("Ä", "ISO_IR 100")):
        assert charset.decode(charset.encode(text, sets), sets, delimiters=b"\\^=") == text
    assert charset.decode(b"\xff", "\\ISO 2022 IR 149") is None and charset.decode(b"\xff", "\\ISO 2022 IR 149", "replace_hex_escape") == "(0xFF)"
    assert charset.encode("a山", "ISO_IR 100") is None and charset.encode("a山", "ISO_IR 100", "replace_unicode_escape") == b"a(U+5C71)"
    assert charset.terms_of("ISO_IR 100\\ISO 2022 IR 87") is None and charset.terms_of("x") is None


def test_series(spark):
    tilted = [0.0, 0.6, 0.8]
    rows = [("s", k, [1.0, 0.0, 0.0], tilted if k == 2 else [0.0, 1.0, 0.0], [0.0, 0.0, float(z)], [0.0, 0.0, 1.0]) for k, z in enumerate((4, 0, 9, 2))]
    df = spark.createDataFrame(rows, "s string, k int, x array<double>, y array<double>, o array<double>, n array<double>")
    assert sorted(r.k for r in series.main_orientation(df, ["s"], "x", "y", "k").collect()) == [0, 1, 3]
    assert [r.position_along for r in series.along_normal(df, ["s"], "o", "n", "k").orderBy("k").collect()] == [0.0, -4.0, 5.0, -2.0]
    wide = df.withColumns({"f": F.lit("1"), "r": F.lit(4), "c": F.when(F.col("k") == 3, 5).otherwise(4), "a": F.lit(1.0), "b": F.lit(1.0)})
    assert sorted(tuple(r) for r in series.issues(wide, ["s"], "k", "f", ("r", "c"), ("a", "b"), ("x", "y")).collect()) == [("s", 2, "orientation_mismatch"), ("s", 3, "size_mismatch")]
    with pytest.raises(ValueError):
        series.only_series(spark.createDataFrame([("a",), ("b",)], "series_uid string"))
    data = p10.write(BODY)
    source = spark.createDataFrame([("d/B", data), ("d/a", b"text"), ("d/c", data[:300])], "instance_id string, content binary")
    listed = series.folder_list(records.elements(source), records.probe(source)).orderBy(*series.listed_order()).collect()
    assert [(r.instance_id, r.is_record, r.Rows, r.NumberOfFrames) for r in listed] == [("d/a", False, None, None), ("d/B", True, 3, 2), ("d/c", True, None, 1)]
    v = series.volumes(frames.frames(source.limit(1)), ["instance_id"], ["frame"]).first()
    assert v.n_slices == 2 and v.error is None and b"".join(map(bytes, v.slices)) == PIXELS.tobytes()
    plan = series.rescale_plan(spark.createDataFrame([("s", 1.0, -5.0, 0, 250), ("s", 1.0, 0.0, 3, 9)], "s string, slope double, intercept double, low long, high long"), ["s"], "low", "high").first()
    assert tuple(plan) == ("s", 2, True, "int16")


def test_label_volume(spark):
    masks = spark.createDataFrame([(1, 0, b"\1\0\1\0"), (2, 0, b"\1\1\0\0"), (3, 1, b"\0\0\0\0")], "label int, z int, samples binary")
    voxels = labels.set_bits(masks, "samples", "label", "z", F.lit(2))
    painted = labels.volume(voxels, ["z", "y", "x"], "label")
    assert sorted((r.z, r.y, r.x, tuple(r.labels), r.code) for r in painted.collect()) == [(0, 0, 0, (1, 2), 2), (0, 0, 1, (2,), 3), (0, 1, 0, (1,), 1)]
    assert labels.restored(painted, 2).count() == 2 and sorted(r.code for r in labels.codes_of(painted, 1).collect()) == [1, 2]
    assert {tuple(r.labels) for r in labels.volume(voxels, ["z", "y", "x"], "label", "no").collect()} == {(1,), (2,)}
    segments = spark.createDataFrame([(1,), (2,), (4,)], "label int")
    assert [r.label for r in labels.undefined(masks, segments, "label").collect()] == [3]
    assert {r.label: (r.n_frames, r.frames) for r in labels.segment_frames(segments, masks, "label", "z").collect()} == {1: (1, [0]), 2: (1, [0]), 4: (0, [])}
    table = spark.createDataFrame([(1, 10, 0, 0, 255), (2, 30, 0, 0, 255)], "label int, r int, g int, b int, a int")
    assert {r.code: r.r for r in labels.colours(labels.set_codes(painted), table, "label").collect()} == {1: 10, 2: 20, 3: 30}


def test_syntaxes(spark, found):
    from lumenfold.operators import transcode

    r = transcode.classified(records.instances(found)).first()
    assert (r.name, r.family, r.can_encode, r.lossy) == ("ExplicitVRLittleEndian", "native", True, False)
    assert transcode.resolve("rle lossless") == frames.RLE and transcode.resolve("x") is None
    x = spark.range(1).select(transcode.lossy_history(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(2.0)), F.lit("c"), F.lit(3.0)).alias("h"), transcode.colour_planes(F.lit(3), F.lit("rle"), F.lit(0)).alias("p")).first()
    assert x.h.methods == ["a", "c"] and x.h.ratios == [2.0, 3.0] and x.p == 1


def test_multiframe_order(spark):
    x, y, turned = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.001]
    rows = [("a", 0, [0.0, 0.0, 5.0], x, y), ("a", 1, None, x, y), ("a", 2, [0.0, 0.009, 1.0], x, y), ("a", 3, [0.0, 0.0, 5.0], None, None)]
    rows += [("off", 0, [0.0, 0.0, 0.0], x, y), ("off", 1, [0.02, 0.0, 1.0], x, y), ("turned", 0, [0.0] * 3, x, y), ("turned", 1, [0.0, 0.0, 1.0], x, turned), ("none", 0, None, x, y), ("none", 1, [9.0, 9.0, -9.0], x, y)]
    df = spark.createDataFrame(rows, "s string, k int, o array<double>, x array<double>, y array<double>")
    found = {(r.s, r.k): (r.frame_ordinal, r.position_along, r.order_error) for r in series.multiframe_order(df, ["s"], "o", ("x", "y"), "k").collect()}
    assert [found["a", k] for k in range(4)] == [(1, 0.0, None), (3, None, None), (0, -4.0, None), (2, 0.0, None)]
    assert {found["off", k][::2] for k in range(2)} == {(None, "positions are off the axis")}
    assert {found["turned", k][::2] for k in range(2)} == {(None, "orientations vary")}
    assert [found["none", k] for k in range(2)] == [(0, None, None), (1, None, None)]
    assert series.multiframe_order(df.limit(0), ["s"], "o", ("x", "y"), "k").count() == 0
