"""Archives by ranges of members: whole, damaged, empty, nested in folders."""

import io
import tarfile
import zipfile

import pytest

from lexiloom.sources import archives


def test_ranges_of_a_zip_are_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("root/news/", "")
        for i in range(250):
            z.writestr(f"root/news/{i}.txt", f"text {i}")
        z.writestr("top.xml", b"\xff\x00")
    df = archives.read_members(spark, f"file://{tmp_path}/c.zip", range_members=50)
    assert df.rdd.getNumPartitions() == 6
    rows = {r["name"]: (r["genre"], bytes(r["content"])) for r in df.collect()}
    assert len(rows) == 251 and rows["root/news/7.txt"] == ("news", b"text 7") and rows["top.xml"] == (None, b"\xff\x00")


def test_folders_of_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with tarfile.open(tmp_path / "deep" / "a.tar.gz", "w:gz") as tar:
        for name, data in (("x/1-sentences.txt", b"1\tOne."), ("x/2", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b", "w") as z:
        z.writestr("y.txt", "y")
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    (tmp_path / "note.txt").write_text("no archive")
    (tmp_path / "_hidden.zip").write_text("PK")
    rows = {(r["archive"].rpartition("/")[2], r["name"]) for r in archives.read_members(spark, f"file://{tmp_path}").collect()}
    assert rows == {("a.tar.gz", "x/1-sentences.txt"), ("a.tar.gz", "x/2"), ("b", "y.txt")}
    (tmp_path / "cut.zip").write_bytes((tmp_path / "b").read_bytes()[:40])
    with pytest.raises(Exception, match="BadZipFile|not a zip"):
        archives.read_members(spark, f"file://{tmp_path}").collect()


@pytest.mark.parametrize("kind", ["zip", "tar.gz"])
def test_round_trip(spark, tmp_path, kind):
    rows = [(1, "a", "s"), (2, None, None), (3, "", "s"), (4, "é" * 3_000_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(2, "doc_id")
    assert archives.write_archives(docs, f"file://{tmp_path}/w", kind) == 2
    got = {r["name"]: bytes(r["content"]).decode() for r in archives.read_members(spark, f"file://{tmp_path}/w").collect()}
    assert got == {"s/1.txt": "a", "none/2.txt": "", "s/3.txt": "", "long/4.txt": "é" * 3_000_000}
    assert archives.write_archives(docs.where("false"), f"file://{tmp_path}/none", kind) == 0
