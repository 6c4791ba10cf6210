import os

import pytest
from pyspark.sql import functions as F

from flockwatch.sources import delimited, sinks

FIXTURE = ['id,"na me",v', '1,"a,b",x', '2,c', '3,d,', '4," q ""z"" ",w', '5,e,f,g', '6,h,i,,']


def _write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_quote_aware_reader_golden(spark, tmp_path):
    df = delimited.read_delimited(spark, _write(tmp_path, "f.csv", FIXTURE))
    assert df.columns == ["id", "na me", "v"]
    assert sorted(map(tuple, df.collect())) == [("1", "a,b", "x"), ("4", "q z", "w"), ("6", "h", "i")]
    # Option: keep trailing empty fields (Spark's own split behaviour).
    keep = delimited.read_delimited(spark, _write(tmp_path, "g.csv", FIXTURE), keep_trailing_empty=True)
    assert sorted(map(tuple, keep.collect())) == [("1", "a,b", "x"), ("3", "d", ""), ("4", "q z", "w")]


def test_header_repeated_in_every_file(spark, tmp_path):
    d = tmp_path / "multi"
    d.mkdir()
    (d / "a.csv").write_text("id,v\n1,x\n")
    (d / "b.csv").write_text("id,v\n2,y\n")
    df = delimited.read_delimited(spark, str(d))
    assert sorted(map(tuple, df.collect())) == [("1", "x"), ("2", "y")]


def test_row_that_equals_the_header_stays(spark, tmp_path):
    d = tmp_path / "same"
    d.mkdir()
    (d / "a.csv").write_text("id,v\n1,x\nid,v\n")
    (d / "b.csv").write_text("id,v\nid,v\n2,y\n")
    (d / "c.csv").write_text("")
    (d / "d.csv").write_text("other,names\n3,z\n")
    df = delimited.read_delimited(spark, str(d))
    assert sorted(map(tuple, df.collect())) == [("1", "x"), ("2", "y"), ("3", "z"), ("id", "v"), ("id", "v")]
    fixed = delimited.read_fixed_delimited(spark, str(d), ",")
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, df.collect()))


def test_first_lines_go_in_files_of_many_splits(spark, tmp_path):
    d = tmp_path / "splits"
    d.mkdir()
    for name in "ab":
        (d / f"{name}.csv").write_text("id,v\n" + "".join(f"{i},{name * 40}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = delimited.read_delimited(spark, str(d), file_column="origin").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((int(r["id"]), r["v"][0], r["origin"][-5:]) for r in rows) == [(i, n, f"{n}.csv") for i in range(500) for n in "ab"]


def test_headerless_data_keeps_every_row(spark, tmp_path):
    data = _write(tmp_path, "bare.csv", ["1,x", "2,y"])
    head = _write(tmp_path, "names.csv", ["A,B"])
    df = delimited.read_delimited(spark, data, header_path=head, data_has_header=False)
    assert df.columns == ["A", "B"] and sorted(map(tuple, df.collect())) == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, data, data_has_header=False)


def test_catalogue_file_and_not_null_guard(spark, tmp_path):
    path = _write(tmp_path, "cat.csv", ["TABLE,COLUMN,ID,TYPE", 't,v,2,"NUMBER(10,2) NOT NULL"', "t,k,1,CHAR(1)", "u,x,1,TIMESTAMP(6)"])
    catalog = delimited.read_catalog(spark, path)
    assert {r.table_name: [f.column_name for f in r.fields] for r in delimited.catalog_schemas(catalog).collect()} == {
        "t": ["k", "v"], "u": ["x"]}
    schema = delimited.struct_type_for(catalog, "t")
    good = spark.createDataFrame([("a", "1.5"), ("", "2")], "k string, v string")
    typed = delimited.apply_schema(good, schema, empty_is_null=True)
    assert [f.nullable for f in typed.schema.fields] == [True, False]
    assert sorted(map(tuple, typed.collect()), key=str) == [("a", 1.5), (None, 2.0)]
    for bad in (None, ""):
        with pytest.raises(Exception, match="NOT NULL column v"):
            rows = spark.createDataFrame([("a", "1.5"), ("b", bad)], "k string, v string")
            delimited.apply_schema(rows, schema, empty_is_null=True).collect()


def test_external_header(spark, tmp_path):
    data = _write(tmp_path, "d.csv", ["ignored,names", "1,x", "2,y,z"])
    head = _write(tmp_path, "h.csv", ['" A ",B'])
    df = delimited.read_delimited(spark, data, header_path=head)
    assert df.columns == ["A", "B"] and [tuple(r) for r in df.collect()] == [("1", "x")]


def test_fixed_delimiter_no_trim(spark, tmp_path):
    df = delimited.read_fixed_delimited(
        spark, _write(tmp_path, "p.txt", ["a|b|c", ' 1|"2"|3', "4|5|", "6|7|8|9"]))
    assert [tuple(r) for r in df.collect()] == [(" 1", '"2"', "3")]


def test_schema_catalogue_golden(spark):
    cat = spark.createDataFrame(
        [("t", "a", "2", "VARCHAR2(20 CHAR) NOT NULL"), ("t", "b", "1", "NUMBER(10,2)"),
         ("t", "c", "3", "TIMESTAMP(6)"), ("t", "d", "4", "DATE"), ("t", "e", "5", "NUMBER NOT NULL"),
         ("u", "x", "1", "CHAR(1)")],
        "table_name string, column_name string, column_id string, type_text string")
    st = delimited.struct_type_for(cat, "t")
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in st.fields] == [
        ("b", "double", True), ("a", "string", False), ("c", "timestamp", True),
        ("d", "string", True), ("e", "double", False)]
    schemas = {r.table_name: [f.column_name for f in r.fields]
               for r in delimited.catalog_schemas(cat).collect()}
    assert schemas == {"t": ["b", "a", "c", "d", "e"], "u": ["x"]}
    raw = spark.createDataFrame([("x", "1.5", "2020-01-01 00:00:00", "d", "2")], "a string, b string, c string, d string, e string")
    typed = delimited.apply_schema(raw, st).first()
    assert typed.b == 1.5 and typed.e == 2.0


def test_list_files(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.csv").write_text("1")
    (tmp_path / "x" / "y" / "b.csv").write_text("22")
    (tmp_path / "x" / "y" / "c.txt").write_text("333")
    got = sorted(os.path.basename(r.file_path) for r in
                 delimited.list_files(spark, str(tmp_path / "x"), "*.csv").collect())
    assert got == ["a.csv", "b.csv"]


def test_model_export_round_trip(spark, tmp_path):
    import datetime as dt
    mem = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (7, 3, "c")],
                                "model_id long, min_size long, acct_key string")
    tr = spark.createDataFrame([(1, 2, dt.date(2015, 7, 16), "F", "S")],
                               "model_id long, min_size long, trade_date date, fund string, side string")
    pm, pt = str(tmp_path / "m"), str(tmp_path / "t")
    sinks.export_models(mem, tr, pm, pt)
    sets = {r.model_id: r.accts for r in delimited.model_member_sets(delimited.read_model_members(spark, pm)).collect()}
    assert sets == {1: ["a", "b"], 7: ["c"]}
    back = delimited.read_model_trades(spark, pt).first()
    assert back.trade_date == dt.date(2015, 7, 16) and back.fund == "F"
    # Parquet table sink and source.
    sinks.write_table(mem, str(tmp_path / "pq"))
    assert sinks.read_table(spark, str(tmp_path / "pq")).count() == 3


def test_line_of_delimiters_has_no_fields(spark, tmp_path):
    df = delimited.read_delimited(spark, _write(tmp_path, "one.csv", ["only", "x", ",,", "", "y,"]))
    assert sorted(r.only for r in df.collect()) == ["", "x", "y"]


def test_lines_are_not_shuffled_to_drop_headers(spark, tmp_path):
    for i in range(3):
        _write(tmp_path, f"part-{i}.txt", ["a|b", f"{i}|x", "a|b"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = delimited.read_fixed_delimited(spark, str(tmp_path), "|")
        assert sorted(map(tuple, df.collect())) == [("0", "x"), ("1", "x"), ("2", "x"), *[("a", "b")] * 3]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
