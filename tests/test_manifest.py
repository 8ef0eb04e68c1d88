"""Manifests of files and rows: a damaged, lost or new file is named."""

import hashlib

import pytest

from lexiloom.sources import manifest


def test_damaged_files_are_named(spark, tmp_path):
    spark.range(4000).repartition(60).write.parquet(f"file://{tmp_path}/t")
    manifest.file_digests(spark, f"file://{tmp_path}/t").write.parquet(f"file://{tmp_path}/a")
    a = spark.read.parquet(f"file://{tmp_path}/a")
    tree = manifest.build(a).cache()
    assert a.count() >= 60 and tree.where("level = 0").first()["things"] == a.count()
    parts = sorted((tmp_path / "t").glob("part-*.parquet"))
    for i in (3, 40):
        data = bytearray(parts[i].read_bytes())
        data[len(data) // 2] ^= 1
        parts[i].write_bytes(data)
        (tmp_path / "t" / f".{parts[i].name}.crc").unlink()  # the local file system's own check would end the read
    parts[7].unlink()
    (tmp_path / "t" / "new.txt").write_text("x")
    b = manifest.file_digests(spark, f"file://{tmp_path}/t")
    found = {tuple(r) for r in manifest.differences(a, b, tree, manifest.build(b)).collect()}
    assert found == {(parts[3].name, "changed"), (parts[40].name, "changed"), (parts[7].name, "lost"), ("new.txt", "gained")}
    assert manifest.differences(a, a, tree, tree).count() == 0


def test_only_differing_nodes_are_followed(spark):
    rows = [(f"n{i}", f"d{i}") for i in range(3000)]
    a = spark.createDataFrame(rows, "name string, digest string")
    b = spark.createDataFrame([(n, d if n != "n77" else "other") for n, d in rows], "name string, digest string")
    x, y = manifest.build(a).cache(), manifest.build(b).cache()
    assert x.agg({"level": "max"}).first()[0] == 2 == manifest.depth_for(3000)
    assert [r["prefix"] for r in manifest.differing_nodes(x, y).collect()] == [hashlib.sha256(b"n77").hexdigest()[:2]]
    assert sorted(tuple(r) for r in x.subtract(y).select("level", "prefix").collect()) == [(k, hashlib.sha256(b"n77").hexdigest()[:k]) for k in range(3)]


def test_odd_rows(spark):
    t = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "z", None)], "name bigint, text string, digest string")
    d = manifest.row_digests(t, "name", ["text"])
    assert d.select("digest").distinct().count() == 3
    assert manifest.build(d).where("level = 0").first()["things"] == 2
    assert manifest.build(d.where("false")).count() == 0
    with pytest.raises(ValueError, match="depths"):
        manifest.differing_nodes(manifest.build(d), manifest.build(d, depth=3))
