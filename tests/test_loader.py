import pytest

from tierstone.functions.http import KeyOptions
from tierstone.operators import catalog
from tierstone.sources import loader


def test_tree_with_empty_file_and_later_root(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "a/b").mkdir(parents=True), b.mkdir()
    (a / "index.html").write_text("old")
    (a / "big.bin").write_bytes(bytes((j * 7 + 3) & 255 for j in range(40960)))
    (a / "empty").touch()
    (a / "a/b/deep.txt").write_text("deep")
    (b / "index.html").write_text("new")
    rows = {r["key"]: r for r in loader.load_trees(spark, [str(a), str(b)]).collect()}
    assert set(rows) == {"/index.html", "/big.bin", "/empty", "/a/b/deep.txt"}
    assert bytes(rows["/index.html"]["value"]) == b"new" and rows["/empty"]["size"] == 0 and rows["/big.bin"]["size"] == 40960
    assert {r["key"] for r in loader.load_trees(spark, [str(a)], KeyOptions(strip_slash=True)).collect()} == {"index.html", "big.bin", "empty", "a/b/deep.txt"}


def test_marked_folders(spark, tmp_path):
    own, other = tmp_path / "own", tmp_path / "other"
    other.mkdir()
    (other / "x").touch()
    with pytest.raises(loader.UnmarkedFolder):
        loader.bless_folder(spark, str(other))
    with pytest.raises(loader.UnmarkedFolder):
        loader.wipe_folder(spark, str(other))
    loader.bless_folder(spark, str(own))
    (own / "y").mkdir()
    assert loader.wipe_folder(spark, str(own)) == 1 and loader.has_marker(spark, str(own))


def test_snapshot_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 0, 0, 1)], "digest string, size long, flags long, expiry long, etag long")
    path = str(tmp_path / "s")
    catalog.write_snapshot(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        catalog.write_snapshot(df, path)
    touched = catalog.touch(df, spark.createDataFrame([("d", 9), ("e", 9)], "digest string, new_expiry long")).collect()
    assert [(r["digest"], r["expiry"]) for r in touched] == [("d", 9)]
