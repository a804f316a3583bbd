from __future__ import annotations

import gzip
from datetime import date

import duckdb
import pytest

from stratacart.sources.landing import (
    cuts_query,
    jdbc_read_options,
    jdbc_write_options,
    range_predicates,
    read_csv,
    read_jdbc_balanced,
    require_columns,
)


def test_read_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('id,name,day\n1,,2024-01-01\n2,""\n3, pad ,2024-01-02,more\n4,x,y\n')
    df = read_csv(spark, str(path), ["day", "id"])
    assert df.dtypes == [("id", "string"), ("name", "string"), ("day", "string")]
    assert sorted(map(tuple, df.collect())) == [
        ("1", None, "2024-01-01"),
        ("2", None, None),
        ("3", " pad ", "2024-01-02"),
        ("4", "x", "y"),
    ]


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("extra,name,id\na,b,c\n")
    assert read_csv(spark, str(path), ["id", "name"]).first().asDict() == {
        "extra": "a",
        "name": "b",
        "id": "c",
    }
    with pytest.raises(ValueError, match="gender, country"):
        read_csv(spark, str(path), ["id", "gender", "country"])


def test_headers_that_differ_are_not_mixed_up(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("id,name\n7,q\n")
    (tmp_path / "raw" / "b.csv").write_text("name,id\nr,8\n")
    (tmp_path / "raw" / "empty.csv").write_text("")
    (tmp_path / "raw" / "_SUCCESS").write_text("")
    both = [("7", "q"), ("8", "r")]
    for paths in (str(tmp_path / "raw"), [str(tmp_path / "raw" / n) for n in ("a.csv", "b.csv")]):
        assert sorted(map(tuple, read_csv(spark, paths).select("id", "name").collect())) == both
    (tmp_path / "c.csv").write_text("id\n9\n")
    some = read_csv(spark, [str(tmp_path / "raw" / "a.csv"), str(tmp_path / "c.csv")])
    assert sorted(map(tuple, some.select("id", "name").collect())) == [("7", "q"), ("9", None)]


def test_many_files_of_two_headers_are_two_scans(spark, tmp_path, executed_plan):
    for n in range(1000):
        names = ("id", "name") if n % 2 else ("name", "id", "more")
        row = {"id": str(n), "name": "x", "more": "y"}
        text = ",".join(names) + "\n" + ",".join(row[x] for x in names) + "\n"
        (tmp_path / f"{n}.csv").write_text(text)
    df = read_csv(spark, str(tmp_path), ["id"])
    assert set(df.columns) == {"id", "name", "more"}
    assert executed_plan(df).count("FileScan csv") == 2
    assert sorted(int(r.id) for r in df.collect()) == list(range(1000))
    assert {r.name for r in df.collect()} == {"x"}


def test_headers_are_read_as_the_files_are_written(spark, tmp_path):
    texts = {
        "quoted.csv": b'"id","na\nme"\n1,a\n', "marked.csv": b"\xef\xbb\xbfid,x\n2,b\n",
        "three.csv": b"id,y\n3,c\n",
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"id,z\n4,d\n"))
    df = read_csv(spark, str(tmp_path), options={"multiLine": "true"})
    assert {"id", "na\nme", "x", "y", "z"} == set(df.columns)
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3", "4"]
    assert sorted(r.id for r in read_csv(spark, f"{tmp_path}/m*.csv").collect()) == ["2"]


def test_names_of_files_are_no_patterns(spark, tmp_path):
    for n, name in enumerate(("odd [1].csv", "odd 1.csv", "a{b}.csv")):
        (tmp_path / name).write_text(f"id,y\n{n},c\n")
    assert sorted(r.id for r in read_csv(spark, str(tmp_path)).collect()) == ["0", "1", "2"]


def test_partition_folders_stay_columns(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"shop={n}").mkdir()
        (tmp_path / f"shop={n}" / "a.csv").write_text(f"id\n{n}\n")
    found = sorted(map(tuple, read_csv(spark, str(tmp_path)).select("id", "shop").collect()))
    assert found == [("1", 1), ("2", 2)]


def test_no_file_is_named(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    for path in (tmp_path, tmp_path / "none"):
        with pytest.raises(ValueError, match="no CSV file"):
            read_csv(spark, str(path))


def test_options_and_rows_that_do_not_fit(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("id;name\n1;a\n2\n3;b;c\n")
    df = read_csv(spark, str(path), ["id"], {"sep": ";"}, corrupt_column="bad")
    assert sorted(map(tuple, df.collect())) == [
        ("1", "a", None),
        ("2", None, "2"),
        ("3", "b", "3;b;c"),
    ]


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"], "t") is df


def test_jdbc_read_options():
    assert jdbc_read_options("jdbc:x:y", "t", single_task=True, options={"user": "u"}) == {
        "url": "jdbc:x:y",
        "dbtable": "t",
        "fetchsize": "10000",
        "user": "u",
    }
    split = jdbc_read_options(
        "jdbc:x:y", "t", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3
    )
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "3")
    with pytest.raises(ValueError, match="both bounds"):
        jdbc_read_options("jdbc:x:y", "t", partition_column="id")
    with pytest.raises(ValueError, match="single_task"):
        jdbc_read_options("jdbc:x:y", "t")


def test_jdbc_write_options():
    options = jdbc_write_options("jdbc:x:y", "s.t", num_partitions=2, options={"driver": "d"})
    assert options["numPartitions"] == "2" and options["truncate"] == "true"
    assert options["driver"] == "d" and options["dbtable"] == "s.t"
    assert jdbc_write_options("u", "t", truncate=False)["truncate"] == "false"


def test_ranges_hold_about_as_many_rows_each():
    """The SQL and the conditions on a table in this process: gaps, a hot value and NULLs."""
    source = duckdb.connect()
    source.execute(
        "CREATE TABLE t AS SELECT CASE WHEN i % 3 = 0 THEN 500000 WHEN i % 50 = 1 THEN NULL "
        "ELSE i * i END AS id, i AS row_no FROM range(3000) r(i)"
    )
    cuts = [r[0] for r in source.execute(cuts_query("t", "id", 10)).fetchall()]
    conditions = range_predicates("id", cuts)
    found = [source.execute(f"SELECT row_no FROM t WHERE {c}").fetchall() for c in conditions]
    assert sorted(r for part in found for (r,) in part) == list(range(3000))
    sizes = sorted(map(len, found))
    hot = source.execute("SELECT count(*) FROM t WHERE id = 500000").fetchone()[0]
    assert sizes[-1] < hot + 700 and sizes[-2] < 700 and len(conditions) > 5


def test_conditions_of_few_values():
    assert range_predicates("c", []) == range_predicates("c", [3]) == ["1 = 1"]
    assert range_predicates("c", [date(2024, 1, 1), date(2024, 2, 1)]) == [
        "c < '2024-02-01' OR c IS NULL",
        "c >= '2024-02-01'",
    ]
    assert range_predicates("c", ["a", "o'b"])[-1] == "c >= 'o''b'"
    with pytest.raises(ValueError, match="cannot cut"):
        range_predicates("c", [b"a", b"b"])


def test_balanced_read_asks_for_cuts_first(spark, monkeypatch):
    seen = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **options):
            seen["asked"] = options
            return self

        def load(self):
            return spark.createDataFrame([(n,) for n in (1, 50, 50, 90)], "cut_value long")

        def jdbc(self, url, table, predicates, properties):
            seen["read"] = (url, table, predicates, properties["user"])
            return spark.range(1)

    class Session:
        read = Reader()

    df = read_jdbc_balanced(Session(), "jdbc:x:y", "t", "id", 4, ["id"], {"user": "u"})
    assert df.columns == ["id"] and "NTILE(4)" in seen["asked"]["query"]
    conditions = ["id < 50 OR id IS NULL", "id >= 50 AND id < 90", "id >= 90"]
    assert seen["read"] == ("jdbc:x:y", "t", conditions, "u")
