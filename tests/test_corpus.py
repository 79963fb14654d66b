"""A corpus folder is read whole: extensions in any case, CSV files of several headers."""

from strataloom.sources import files


def test_extensions_in_any_case_and_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "B.CSV").write_text("x,y\n3,4\n")
    (tmp_path / "c +[1] d.csv").write_text("\nk,x,z\n7,8,9\n")
    spark.createDataFrame([(5,)], "p long").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "D.PARQUET")
    rows = files.read_corpus(spark, str(tmp_path)).select("source_type", "kind", "text").collect()
    assert sorted(map(tuple, rows)) == [
        ("csv", "row", "k=7; x=8; z=9"), ("csv", "row", "x=1; y=2"), ("csv", "row", "x=3; y=4"), ("parquet", "row", "p=5"),
    ]


def test_partition_folders_keep_their_column(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"k={k}").mkdir()
        (tmp_path / f"k={k}" / "a.csv").write_text(f"x\n{k}0\n")
    rows = files.read_corpus(spark, str(tmp_path)).select("text").collect()
    assert sorted(r[0] for r in rows) == ["x=10; k=1", "x=20; k=2"]
