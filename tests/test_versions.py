"""Versions of a corpus: only changed documents are made again, crashes leave the active version, writers do not overwrite."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tokens import tokens
from lexiloom.operators import catalog, versions
from lexiloom.sources.storage import Conflict, Log


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, part_ string, digest string").drop("part_", "digest")


def rows(spark, texts):
    return docs(spark, [(i, t, "p", "d") for i, t in texts.items()])


def words(store, version=None):
    return sorted((r["doc_id"], r["text"]) for r in store.rows(version).select("doc_id", "text").collect())


def test_only_changed_documents_are_made(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/v")
    assert store.active() is None and store.history() == []
    with pytest.raises(ValueError, match="no version"):
        store.rows()
    first = store.commit(rows(spark, {1: "a b", 2: "c", 3: None}), tokens, "t")
    assert (first["documents"], first["made"]) == (3, 3) and words(store) == [(1, "a"), (1, "b"), (2, "c")]
    second = store.commit(rows(spark, {1: "a b", 2: "x", 4: "new"}), tokens, "t")
    assert (second["documents"], second["made"]) == (3, 2) and words(store) == [(1, "a"), (1, "b"), (2, "x"), (4, "new")]
    assert words(store, first["version"]) == [(1, "a"), (1, "b"), (2, "c")]
    again = store.commit(rows(spark, {1: "a b", 2: "x", 4: "new"}), tokens, "t")
    assert again["made"] == 0 and words(store) == words(store, second["version"])
    other = store.commit(rows(spark, {1: "a b"}), tokens, "t", {"model": 2})
    assert other["made"] == 1  # another recipe makes all again
    store.activate(first["version"])
    assert words(store) == [(1, "a"), (1, "b"), (2, "c")] and len(store.history()) == 5
    empty = store.commit(rows(spark, {1: "a"}).where("false"), tokens, "t")
    assert empty["documents"] == 0 and words(store) == []


def test_a_crash_leaves_the_active_version(spark, tmp_path, monkeypatch):
    store = versions.Versions(spark, f"file://{tmp_path}/v")
    store.commit(rows(spark, {1: "a"}), tokens, "t")

    def broken(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit(rows(spark, {1: "b"}), broken, "t")
    with monkeypatch.context() as m:
        m.setattr(Log, "put", lambda *_: broken(None))
        with pytest.raises(RuntimeError):
            store.commit(rows(spark, {1: "c"}), tokens, "t")
    assert words(store) == [(1, "a")] and len(store.history()) == 1
    assert len(store.vacuum()) == 3 and store.vacuum() == [] and words(store) == [(1, "a")]
    store.commit(rows(spark, {1: "c"}), tokens, "t")
    assert words(store) == [(1, "c")]


def test_of_two_writers_one_is_told(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/v")
    store.commit(rows(spark, {1: "a"}), tokens, "t")

    def slow(d):
        versions.Versions(spark, store.path).commit(rows(spark, {1: "other"}), tokens, "t")
        return tokens(d)

    with pytest.raises(Conflict):
        store.commit(rows(spark, {1: "b"}), slow, "t")
    assert words(store) == [(1, "other")]


def test_small_tables_keep_changes_of_others(spark, tmp_path):
    table = catalog.Table(spark, f"file://{tmp_path}/t", "id int, name string")
    assert table.rows().count() == 0
    table.add([(1, "a"), (2, "b")])
    old = table.rows()
    other = catalog.Table(spark, table.path, table.schema)
    calls = []

    def late(folders):
        if not calls:  # another session adds a row after this one has read
            calls.append(1)
            other.add([(3, "c")])
        return table._read(folders).where(F.col("id") != 1), []

    table._change(late)
    assert sorted(r["id"] for r in table.rows().collect()) == [2, 3]
    assert sorted(r["id"] for r in old.collect()) == [1, 2]  # readers of before are not disturbed
    table.remove(F.col("name") == "c")
    assert [tuple(r) for r in other.rows().collect()] == [(2, "b")]
