"""Files: formats, encodings, rejects and typed errors."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.sources.files import (
    SourceError,
    choose_encoding,
    format_of,
    load_tables,
    preview,
    read_checked,
    read_table,
    require_rows,
    undecodable_rows,
)


def write(folder, name, data: bytes):
    path = folder / name
    path.write_bytes(data)
    return str(path)


def test_csv_tsv_txt_parquet_give_the_same_table(spark, tmp_path):
    rows = [["id", "name", "price"], ["1", "Ärmel", "2.5"], ["2", "plain", ""]]
    paths = {
        "a": write(tmp_path, "a.csv", "\n".join(",".join(r) for r in rows).encode()),
        "b": write(tmp_path, "b.TSV", "\n".join("\t".join(r) for r in rows).encode()),
        "c": write(tmp_path, "c.txt", "\n".join(",".join(r) for r in rows).encode("utf-8-sig")),
        "d": write(tmp_path, "d.csv", "\n".join(",".join(r) for r in rows).encode("latin1")),
    }
    tables = load_tables(spark, paths, views=True, encoding="auto")
    tables["a"].write.parquet(str(tmp_path / "e.parquet"))
    tables["e"] = read_table(spark, str(tmp_path / "e.parquet"))
    for df in tables.values():
        assert df.dtypes == [("id", "int"), ("name", "string"), ("price", "double")]
        assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Ärmel", 2.5), (2, "plain", None)]
    assert spark.table("a").count() == 2
    assert choose_encoding(spark, paths["d"]) == "ISO-8859-1" and choose_encoding(spark, paths["c"]) == "UTF-8"


def test_declared_schema_is_not_inferred(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"id,name\n1,x\n")
    assert read_table(spark, path, schema="id string, name string", encoding="UTF-8").dtypes[0] == ("id", "string")


def test_errors_say_what_is_wrong(spark, tmp_path):
    with pytest.raises(SourceError, match="unsupported file format '.xlsx'"):
        format_of("book.xlsx")
    with pytest.raises(SourceError, match="PATH_NOT_FOUND"):
        read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(SourceError, match="no columns"):
        read_table(spark, write(tmp_path, "empty.csv", b""))
    with pytest.raises(SourceError, match="no rows"):
        require_rows(read_table(spark, write(tmp_path, "head.csv", b"a,b\n")), "head")


def test_rejects_are_kept_whole(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"id,price\n1,2.5\nx,3\n2,4,5\n3,1\n4,y\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("price", T.DoubleType())])
    checked = read_checked(spark, path, schema)
    assert [tuple(r) for r in checked.rows.orderBy("id").collect()] == [(1, 2.5), (3, 1.0)]
    assert sorted(r["line"] for r in checked.rejects.collect()) == ["2,4,5", "4,y", "x,3"]
    assert sorted(r["id"] for r in checked.rows.select("id").collect()) == [1, 3]


def test_undecodable_and_preview(spark):
    df = spark.createDataFrame([("ok", "a�b"), ("x", "y")], "p string, q string")
    assert {r["column"]: r["row_count"] for r in undecodable_rows(df).collect()} == {"p": 0, "q": 1}
    assert preview(spark.range(100).select(F.col("id"))).count() == 25


def test_quoted_commas_quotes_and_line_breaks(spark, tmp_path):
    data = b'id,note,amount\n1,"say ""hi"", now",5\n2,"two\nlines",6\n'
    path = write(tmp_path, "q.csv", data)
    rows = read_table(spark, path, schema="id INT, note STRING, amount INT", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", now', 5), (2, "two\nlines", 6)]
    first = read_checked(spark, write(tmp_path, "one.csv", data[:37]), T.StructType.fromDDL("id INT, note STRING, amount INT"))
    assert first.rows.collect()[0]["note"] == 'say "hi", now'
