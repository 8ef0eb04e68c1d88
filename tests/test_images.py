"""PNG files of all filters and colour types, regions by brute force, rules on given measures."""

import struct
import zlib

import numpy as np
import pytest

from lexiloom.operators import vision
from lexiloom.sources import images


def png(w, h, kind, rows, palette=b"", depth=8, interlace=0):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlace)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [None, (0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)])
def test_round_trip(filters):
    rng = np.random.default_rng(6)
    for shape in ((1, 1, 3), (7, 5, 3), (40, 33, 3)):
        for pixels in (rng.integers(0, 256, shape, dtype=np.uint8), np.full(shape, 255, np.uint8)):
            assert np.array_equal(images.read_png(images.write_png(pixels, filters)), pixels)


def test_colour_types():
    assert images.read_png(png(2, 1, 0, bytes([0, 9, 200]))).tolist() == [[[9] * 3, [200] * 3]]
    assert images.read_png(png(1, 2, 4, bytes([0, 9, 1, 2, 1, 1]))).tolist() == [[[9] * 3], [[10] * 3]]
    assert images.read_png(png(1, 1, 6, bytes([1, 1, 2, 3, 99]))).tolist() == [[[1, 2, 3]]]
    assert images.read_png(png(2, 1, 3, bytes([0, 1, 0]), bytes([1, 2, 3, 4, 5, 6]))).tolist() == [[[4, 5, 6], [1, 2, 3]]]


BROKEN = [b"", b"GIF89a", png(2, 1, 3, bytes([0, 2, 0]), bytes(6)), png(1, 1, 0, bytes([7, 0])), png(1, 1, 0, b"\0"), png(1, 1, 0, bytes(2), depth=16), png(1, 1, 0, bytes(2), interlace=1), png(1 << 20, 1 << 20, 2, b""), png(1, 1, 5, bytes(2)), images.write_png(np.zeros((2, 2, 3), np.uint8))[:-20]]


@pytest.mark.parametrize("i", range(len(BROKEN)))
def test_broken_files(i):
    with pytest.raises(ValueError):
        images.read_png(BROKEN[i])


def test_files_of_a_folder(spark, tmp_path):
    pixels = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.PNG").write_bytes(images.write_png(pixels))
    (tmp_path / "deep" / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no image")
    rows = {r["image_id"].rpartition("/")[2]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.PNG", "b.png"} and bytes(rows["a.PNG"]["rgb"]) == pixels.tobytes() and rows["b.png"]["error"] == "no PNG signature"
    assert vision.analyse_pixels(images.read_images(spark, str(tmp_path))).count() == 1


def test_regions_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    for h, w, grid in ((9, 9, 3), (10, 7, 3), (2, 5, 3), (1, 1, 2)):
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        for region, x, y, *colour in images.grid_regions(pixels, grid):
            ry, rx = divmod(region, grid)
            y0, y1, x0, x1 = int(ry * h / grid), int((ry + 1) * h / grid), int(rx * w / grid), int((rx + 1) * w / grid)
            own = [pixels[i, j] for i in range(y0, y1) for j in range(x0, x1)]
            assert colour == [sum(int(p[c]) for p in own) // len(own) for c in range(3)] and (x, y) == (round((x0 + x1) / 2 / w, 3), round((y0 + y1) / 2 / h, 3))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "abc" * 500_000), (None, "x")], "doc_id bigint, text string")
    decoded = images.decode_images(images.text_images(docs), "doc_id", "png")
    assert {(r["image_id"], r["width"], r["height"]) for r in decoded.collect()} == {(1, 48, 3), (2, 48, 3), (3, 48, 10419), (None, 48, 3)}
    assert images.extract_regions(decoded).count() == 36 and images.extract_regions(decoded.where("false")).count() == 0


def test_composition_of_a_plain_and_a_split_image():
    plain = vision.pixel_measures(np.full((30, 30, 3), 200, np.uint8))
    assert plain["thirds"] == [0.0] * 4 and plain["balance"] == 0 and plain["shares"] == [100.0] and plain["dominant"] == ["#c0c0c0"]
    half = np.zeros((60, 60, 3), np.uint8)
    half[20:40, 45:55] = 255
    got = vision.pixel_measures(half)
    assert got["balance"] == 1.0 and got["iv_right"] == 1.0 and got["salience_x"] > 0.7 and got["thirds"][:2] == [0.0, 0.0] and min(got["thirds"][2:]) > 0
    assert got["framing"] == round(1 - got["iv_centre"], 3)


def test_rules_of_visual_grammar(spark):
    columns = "image_id bigint, saturation double, brightness double, iv_left double, iv_right double, iv_top double, iv_bottom double, iv_centre double"
    rows = [(1, 0.8, 220.0, 0.7, 0.3, 0.46, 0.54, 0.7), (2, 0.1, 40.0, 0.5, 0.5, 0.2, 0.8, 0.5), (3, 0.5, 128.0, 0.4, 0.6, 0.5, 0.5, 0.2)]
    found = {(r["image_id"], r["category"]): round(r["confidence"], 3) for r in vision.visual_grammar(spark.createDataFrame(rows, columns)).collect()}
    assert found == {
        (1, "information_value:given_new"): 0.8, (1, "information_value:centre_margin"): 0.4, (1, "salience"): 0.9, (1, "framing"): 0.4, (1, "modality"): 0.663,
        (2, "information_value:ideal_real"): 1.0, (2, "salience"): 0.9, (2, "modality"): 0.743,
        (3, "information_value:given_new"): 0.4, (3, "salience"): 0.9, (3, "framing"): 0.6,
    }


def test_pieces_and_one_pass(spark):
    import pyarrow as pa

    from lexiloom.operators import vision

    sizes = [images.PIECE - 1, 1, 1, 2 * images.PIECE, 0, 3]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6)), "x": pa.array([bytes(n) for n in sizes])})
    assert [p.num_rows for p in images.pieces(iter([batch]), 1)] == [2, 1, 1, 2]
    docs = spark.createDataFrame([(1, "abc é " * 200), (2, None), (3, "")], "doc_id bigint, text string")
    chained = images.decode_images(images.text_images(docs), "doc_id", "png")
    for one, many in ((images.text_pixels(docs), chained), (images.text_regions(docs), images.extract_regions(chained)), (vision.analyse_texts(docs), vision.analyse_pixels(chained))):
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
        assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
