"""Bootstrap counts, nulls on both paths of the ordered operators, sheets by header, text scans."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sieve.operators import prefix, resample
from sieve.sources.tables import materialize_once, read_sheet
from tests.conftest import SMALL


@pytest.mark.parametrize("positives", [1, 3])
def test_bootstrap_returns_all_replicates(spark, positives):
    rows = [(i, int(i < positives)) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id long, y int")
    got = resample.bootstrap(df, 200).join(df, "record_id").groupBy("replicate").agg(F.sum("draws").alias("n"), F.countDistinct("y").alias("k")).collect()
    assert sorted(r.replicate for r in got) == list(range(200)) and all(r.n == 40 and r.k == 2 for r in got)


def test_bootstrap_of_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        resample.bootstrap(spark.createDataFrame([(1, 1), (2, 1)], "record_id long, y int"), 5)


def _rows(spark):
    rows = [(i, g, None if i % 4 == 0 else float(i % 7), 1) for i in range(80) for g in ("a", None)]
    return spark.createDataFrame(rows, "id long, g string, v double, one int")


def test_ordered_operators_agree_on_nulls(spark):
    df = _rows(spark)
    both = [{(r.id, r.g): r.cum_one for r in prefix.prefix_sums(df, ["g"], "v", ["one"], ["id"], small_group_rows=n).collect()} for n in (10**6, 4)]
    assert both[0] == both[1] and None not in both[0].values()
    both = [{(r.id, r.g): r.pos for r in prefix.hash_rank(df, ["g"], F.md5(F.col("id").cast("string")), "id", small_group_rows=n).collect()} for n in (10**6, 4)]
    assert both[0] == both[1] and sorted(p for (_, g), p in both[0].items() if g is None) == list(range(1, 81))


def test_quantiles_ignore_nulls_on_both_paths(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)] * 5, "v double")
    both = [[r.value for r in prefix.exact_quantiles(df, [], "v", [0.0, 0.5, 1.0], small_group_rows=n).orderBy("q_idx").collect()] for n in (10**6, 2)]
    assert both[0] == both[1] == [1.0, 5.5, 10.0]


def test_sheet_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("banner,,\nREGION, SPECIES ,TARGET\nnorth,ash,1\nNULL,oak,0\n")
    rows = read_sheet(spark, str(tmp_path), ["SPECIES", "REGION", "COLOUR"], "TARGET").collect()
    assert {(r.SPECIES, r.REGION, r.COLOUR, r.TARGET) for r in rows} == {("ash", "north", None, "1"), ("oak", None, None, "0")}
    with pytest.raises(ValueError):
        read_sheet(spark, str(tmp_path), ["SPECIES", "REGION"], "LABEL")


def test_a_broken_cache_is_an_error(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    (path / "_SUCCESS").write_text("")
    (path / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="(?i)parquet|footer|infer"):
        materialize_once(spark, str(path), lambda: spark.range(3)).collect()
    assert (path / "part-0.parquet").read_text() == "broken"


@pytest.mark.parametrize("name", ["clean_names", "clean_tags", "serialize_optional", "token_profile", "mean_pool_hash"])
def test_text_queries_scan_documents_only(spark, name):
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "labels.parquet" not in plan and "Join" not in plan
