"""Reading splits from awkward paths."""

import pytest

from quire.sources import io as IO

SCHEMA = "doc_id long, content string, labels int"


def put(spark, folder, first, n, name="part"):
    rows = [(first + i, f"text, \"quoted\"\nline {i}", i % 2) for i in range(n)]
    return IO.write_csv(spark.createDataFrame(rows, SCHEMA), f"{folder}/{name}")


@pytest.mark.parametrize("root", ["plain", "my dir", "a%20b", "train/train", "x+y", "ünï cöde", "train dev/test/train"])
def test_entries_are_named_below_the_path(spark, tmp_path, root):
    folder = f"{tmp_path}/{root}"
    for first, n, name in ((0, 7, "train"), (100, 3, "my dev set"), (200, 2, "test%2Ftrain+x"), (300, 4, "other")):
        put(spark, folder, first, n, name)
    for path in (folder, folder + "/", "file://" + folder):
        got = {}
        for r in IO.read_splits(spark, path, SCHEMA).collect():
            got.setdefault(r["split"], set()).add(r["doc_id"])
        assert got == {"train": set(range(7)) | {200, 201}, "dev": {100, 101, 102}, "test": {200, 201}}


def test_columns_rename_and_shuffle_by_split(spark, tmp_path):
    for first, n, name in ((0, 30, "train"), (100, 20, "dev")):
        put(spark, str(tmp_path), first, n, name)
    out = IO.read_splits(spark, str(tmp_path), SCHEMA, columns=["doc_id", "content"], rename={"content": "text"}, shuffle_key="doc_id")
    assert out.columns == ["doc_id", "text", "split"]
    rows = out.collect()
    assert [r["split"] for r in rows] == ["dev"] * 20 + ["train"] * 30
    ids = [r["doc_id"] for r in rows]
    assert ids[:20] != sorted(ids[:20]) and ids[20:] != sorted(ids[20:])
    again = IO.read_splits(spark, str(tmp_path), SCHEMA, shuffle_key="doc_id").collect()
    assert [r["doc_id"] for r in again] == ids
    other = IO.read_splits(spark, str(tmp_path), SCHEMA, shuffle_key="doc_id", seed=7).collect()
    assert [r["doc_id"] for r in other] != ids
    loaded = IO.load_labeled_path(spark, str(tmp_path), "text", "labels", SCHEMA, splits=True, rename={"content": "text"})
    assert loaded.count() == 50 and set(loaded.columns) == {"text", "labels", "doc_id", "split"}


def test_paths_that_hold_no_splits_are_errors(spark, tmp_path):
    put(spark, str(tmp_path / "a"), 0, 3, "validation")
    (tmp_path / "empty").mkdir()
    for path in (tmp_path / "a", tmp_path / "empty", tmp_path / "missing"):
        with pytest.raises(ValueError):
            IO.read_splits(spark, str(path), SCHEMA)


def test_a_single_file_is_one_table(spark, tmp_path):
    folder = put(spark, str(tmp_path), 0, 5, "train")
    import glob
    one, = glob.glob(f"{folder}/*.csv")[:1]
    df = IO.read_splits(spark, one, SCHEMA)
    assert "split" not in df.columns and df.count() > 0
