"""Sheets with a header of their own, tables cached by the version of their inputs."""
import pytest

from sieve.sources.tables import input_version, materialize_once, read_sheet


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_rows_with_one_filled_cell_are_records_and_banners_are_not(spark, tmp_path):
    path = write(tmp_path / "s", a="Survey 2020,,\nREGION, SPECIES ,TARGET\nsouth,,\nnorth,x,1\n", b="\"two\nlines\",,\n,,\nSPECIES,TARGET,REGION\ny,0,east\n,,west\n")
    got = read_sheet(spark, path, ["SPECIES", "REGION", "MISSING"], "TARGET").collect()
    assert sorted((r.SPECIES or "", r.REGION or "", r.MISSING, r.TARGET) for r in got) == [
        ("", "south", None, None), ("", "west", None, None), ("x", "north", None, "1"), ("y", "east", None, "0")]
    assert len({r.record_id for r in got}) == 4


def test_record_like_the_header_is_kept_only_as_a_record(spark, tmp_path):
    path = write(tmp_path / "s", a="banner,\nREGION,TARGET\nREGION,TARGET\nn,1\n")
    assert sorted(r.REGION for r in read_sheet(spark, path, ["REGION"], "TARGET").collect()) == ["REGION", "n"]


def test_file_without_header_or_label_is_refused(spark, tmp_path):
    good = "b,,\nREGION,SPECIES,TARGET\nn,x,1\n"
    with pytest.raises(ValueError, match="no header row"):
        read_sheet(spark, write(tmp_path / "s", a=good, b="n,x,1\n"), ["REGION", "SPECIES"], "TARGET")
    with pytest.raises(ValueError, match="TARGET"):
        read_sheet(spark, write(tmp_path / "t", a=good, b="b,,\nREGION,SPECIES,OTHER\nn,x,1\n"), ["REGION", "SPECIES"], "TARGET")


def test_changed_input_is_built_anew(spark, tmp_path):
    src, out, built = str(tmp_path / "in"), str(tmp_path / "out"), []

    def table(n):
        spark.range(n).write.mode("overwrite").parquet(src)

    def cached():
        df = spark.read.parquet(src)

        def build():
            built.append(1)
            return df.selectExpr("id * 2 AS twice")
        return materialize_once(spark, out, build, input_version(df))
    table(5)
    first = cached()
    assert cached().count() == 5 and len(built) == 1
    table(7)
    assert cached().count() == 7 and len(built) == 2
    assert first.count() == 5                   # the earlier version's files stay
