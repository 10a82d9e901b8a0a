import numpy as np
import pytest

from lumenfold.operators.elements import at_path, selection, stop_before, wide
from lumenfold.sources import p10, records

BODY = [
    (0x00080005, "CS", "ISO_IR 100"), (0x00080016, "UI", "1.2.3"), (0x00080018, "UI", "1.2.3.4"), (0x00100010, "PN", "A^B".encode()), (0x0020000E, "UI", "1.2.9"), (0x00280010, "US", [512]), (0x00280030, "DS", "0.5\\0.25"),
    (0x00620002, "SQ", [[(0x00620004, "US", [1]), (0x00620005, "LO", "liver")], [(0x00620004, "US", [2])]]), (0x7FE00010, "OW", bytes(range(8))),
]


@pytest.mark.parametrize("syntax", [p10.IMPLICIT, p10.EXPLICIT, p10.DEFLATED, p10.BIG_ENDIAN])
def test_round_trip(spark, syntax):
    data = p10.write(BODY, syntax)
    found = records.elements(spark.createDataFrame([("a", data)], "instance_id string, content binary"))
    by_path = {r.path: r for r in found.collect()}
    assert by_path["00020010"].text == syntax
    assert by_path["00280010"].longs == [512] and by_path["00280030"].doubles == [0.5, 0.25]
    assert by_path["00620002.0.00620005"].text == "liver" and by_path["00620002.1.00620004"].longs == [2]
    assert at_path(found, "SegmentSequence.1.SegmentNumber").count() == 1
    assert wide(found, ["Rows", "PatientName"]).first().PatientName == "A^B"
    assert all(r.error is None for r in by_path.values())
    assert records.instances(found).first().transfer_syntax_uid == syntax
    assert records.series(found).first().series_uid == "1.2.9"


def test_until_select_and_broken(spark):
    data = p10.write(BODY)
    df = spark.createDataFrame([("a", data), ("b", data[:-10]), ("c", None), ("d", b"")], "instance_id string, content binary")
    rows = records.elements(df).collect()
    assert [r.instance_id for r in rows if r.error] == ["b", "c", "d"]
    assert any(r.instance_id == "b" and r.path == "00280010" for r in rows)
    assert max(r.tag for r in records.elements(df.limit(1), load_until=0x00280010).collect()) == 0x00280010
    assert {r.tag_hex for r in records.elements(df.limit(1), select={"Rows": {}}).collect()} == {"00080005", "00080016", "00280010"}
    assert {r.instance_id: r.is_record for r in records.probe(df).collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert stop_before(records.elements(df.limit(1)), records.F.col("tag_hex") == "00280010").filter("tag_hex >= '00280010'").count() == 0


def test_selection():
    assert list(selection({"Rows": {}, "(0028,0010)": {}})) == ["00080005", "00080016", "00280010"]
    with pytest.raises(ValueError):
        selection({"00000000": {}})


def test_rle():
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint16):
        x = [np.repeat(rng.integers(0, 200, 50), rng.integers(1, 9, 50))[:100].astype(dtype) for _ in range(3)]
        assert p10.rle_decode(p10.rle_encode(x), 100, x[0].itemsize) == b"".join(c.tobytes() for c in x)
    with pytest.raises(p10.Broken):
        p10.rle_decode(bytes(64), 10, 1)


def test_text_policies():
    assert p10.decode_text(b"a\xff", "ISO_IR 192") is None
    assert p10.decode_text(b"a\xffb", "ISO_IR 192", "replace_hex_escape") == "a(0xFF)b"
    assert p10.decode_text(b"a\xff", "ISO_IR 192", "replace_fffd") == "a�"
    assert p10.numbers(b"\1", "US") is None and len(p10.numbers(b"", "US")) == 0


def test_two_sets(spark):
    data = p10.write([(0x00080005, "CS", "\\ISO 2022 IR 87"), (0x00100010, "PN", b"Yamada=\x1b$B;3ED\x1b(B"), (0x00081030, "LO", b"a\\b")])
    w = wide(records.elements(spark.createDataFrame([("a", data)], "instance_id string, content binary")), ["PatientName", "StudyDescription"]).first()
    assert (w.PatientName, w.StudyDescription) == ("Yamada=山田", "a\\b")


def test_values_that_do_not_fit(spark):
    """A text beyond a 16-bit length and numbers out of range are errors beside good rows."""
    from lumenfold.sources import sink

    rows = spark.createDataFrame([(1, "x" * 70_000, 5), (2, "short", 70_000), (3, "fine", 65_535), (4, None, None)], "id long, text string, n int")
    made = {r.instance_id: r for r in sink.build(rows, "id", {"PatientComments": "text", "Rows": "n"}).collect()}
    assert made["1"].content is None and "LT" in made["1"].error and made["2"].content is None and "US" in made["2"].error
    assert made["3"].error is None and made["4"].error is None
    assert sink.valid("DA", "20200101") is None and sink.valid("DA", "2020") and sink.valid("IS", "99999999999") and sink.valid("CS", "lower") and sink.valid("US", 1.5) and sink.valid("SS", [1, 40_000])
    assert sink.valid("PN", "a" * 64 + "=" + "b" * 64) is None and sink.valid("LO", "a\\b")


def test_files(spark, tmp_path):
    from lumenfold.sources import records, sink

    rows = spark.createDataFrame([(i, f"name{i}") for i in range(20)], "id long, name string")
    made = sink.build(rows, "id", {"PatientName": "name"})
    for _ in range(2):  # a second run leaves the same files
        done = sink.write_files(made.unionByName(spark.createDataFrame([("x", None, None)], "instance_id string, content binary, error string")), f"file://{tmp_path}").collect()
    assert sorted(r.instance_id for r in done if r.error) == ["x"]
    found = records.elements(records.files(spark, str(tmp_path))).filter("tag_hex = '00100010'").collect()
    assert sorted(r.text for r in found) == sorted(f"name{i}" for i in range(20)) and len(list(tmp_path.glob("*"))) == 20


def test_broken_records_can_end_the_job(spark):
    from lumenfold.sources import records, sink

    made = sink.build(spark.createDataFrame([(1, "a" * 20)], "id long, name string"), "id", {"PatientName": "name"})
    cut = made.selectExpr("instance_id", "substring(content, 1, length(content) - 5) AS content")
    assert records.elements(cut).filter("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="bytes"):
        records.elements(cut, keep_on_error=False).count()


def test_palette_tables():
    from lumenfold.functions.pixels import table_entries
    from lumenfold.sources import frames, p10

    assert table_entries(b"\1\2\3", 3, 8) == [1, 2, 3] and table_entries(b"\1\0\2\1", 2, 8) == [1, 2] and table_entries(b"\1\0\2\1", 2, 16) == [1, 258]
    with pytest.raises(ValueError):
        table_entries(b"\1", 2, 8)
    head = lambda c, n=2: (0x00281101 + c, "US", [n, 0, 8])
    good = p10.write([*(head(c) for c in range(3)), *((0x00281201 + c, "OW", bytes([c, c + 1])) for c in range(3))])
    assert frames.palette_of(good) == (0, 8, [0, 1], [1, 2], [2, 3], None)
    with pytest.raises(ValueError):
        frames.palette_of(p10.write([head(0), head(1), head(2, 3), *((0x00281201 + c, "OW", bytes([c, c + 1])) for c in range(3))]))
    assert frames.palette_of(p10.write([(0x00280010, "US", [1])])) is None


def test_pixels_that_do_not_suit():
    from lumenfold.sources import frames, p10

    record = p10.write([(0x00280010, "US", [1])])
    for args in (([b"abc"], 1, 2, 1, "u1", "MONOCHROME2"), ([b"abc"], 1, 1, 3, "u1", "MONOCHROME2"), ([], 1, 1, 1, "u1", "MONOCHROME2"), ([b"abcd"], 1, 1, 1, "f4", "MONOCHROME2")):
        with pytest.raises(p10.Broken):
            frames.set_pixel_data(record, *args)
    (_, layout, samples), = frames.frames_of(frames.set_pixel_data(record, [b"abcdef"], 1, 2, 3, "u1", "RGB"))
    assert samples == b"abcdef" and layout.samples == 3 and layout.photometric == "RGB"
