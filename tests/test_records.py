"""Records that span lines: read by many tasks, equal to a read in one."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from attest.sources.files import SourceError, read_checked, read_table
from attest.sources.records import csv_records, header_names

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("price", T.DoubleType())])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 200 bytes, so that a small file is read by many tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(path, rows, end="\n", encoding="utf-8", header=("id", "note", "price")):
    out = io.StringIO()
    maker = csv.writer(out, lineterminator=end)
    maker.writerow(header)
    maker.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))
    return str(path)


def one_task(spark, path, sep=",", schema=SCHEMA):
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NOTES = ["plain", "two\nlines", 'a "quoted" word', "\n\n\nleading", 'odd " quote', "comma, and\n\"both\"", "", "x" * 450 + "\n" + "y" * 450, "tab\t", "é日本\n語", "carriage\r\nreturn", "\n".join(["many"] * 90)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_equal_one(spark, tmp_path, small_ranges, end):
    rng = random.Random(3)
    rows = [(i, rng.choice(NOTES), i / 4) for i in range(300)]
    path = written(tmp_path / "a.csv", rows, end)
    df = read_table(spark, path, schema=SCHEMA, multi_line=True)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    # Spark's own reader turns carriage returns within quotes into line feeds where lines end with both
    same = [(i, n.replace("\r\n", "\n") if n and end == "\r\n" else n, p) for i, n, p in rows_of(df)]
    assert sorted(same, key=repr) == rows_of(one_task(spark, path))
    # an empty text is read as NULL by either
    assert rows_of(df) == sorted(((i, n or None, p) for i, n, p in rows), key=repr)


def test_types_and_names_are_found(spark, tmp_path, small_ranges):
    path = written(tmp_path / "a.csv", [(i, f"line\n{i}", i + 0.5) for i in range(50)], header=("id", "the\nnote", "ID"))
    df = read_table(spark, path, multi_line=True)
    assert df.dtypes == [("id0", "int"), ("the\nnote", "string"), ("ID2", "double")]
    assert df.count() == 50
    assert header_names('a,,"x,y"', ",") == ["a", "_c1", "x,y"]


def test_rejects_in_the_same_pass(spark, tmp_path, small_ranges):
    path = written(tmp_path / "a.csv", [(i if i % 10 else "none", f"line\n{i}", i) for i in range(100)])
    checked = read_checked(spark, path, SCHEMA, multi_line=True)
    assert checked.rows.count() == 90 and checked.rejects.count() == 10
    assert '"line\n50"' in "".join(r["line"] for r in checked.rejects.collect())


def test_folders_encodings_and_marks(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(4):
        written(folder / f"{n}.csv", [(n * 100 + i, f"Ä\n{i}", 1.0) for i in range(20)], encoding=("utf-8", "utf-8-sig")[n % 2])
    assert rows_of(read_table(spark, str(folder), "csv", schema=SCHEMA, multi_line=True)) == sorted(((n * 100 + i, f"Ä\n{i}", 1.0) for n in range(4) for i in range(20)), key=repr)
    latin = written(tmp_path / "latin.csv", [(1, "Größe\nzwei", 2.0)], encoding="latin1")
    assert rows_of(read_table(spark, latin, schema=SCHEMA, encoding="auto", multi_line=True)) == [(1, "Größe\nzwei", 2.0)]
    with pytest.raises(ValueError):
        csv_records(spark, latin, "UTF-16")


def test_plain_files_are_not_shuffled(spark, tmp_path, small_ranges):
    path = written(tmp_path / "a.csv", [(i, 'a, "b"', 1.0) for i in range(100)])
    df = read_table(spark, path, schema=SCHEMA, multi_line=True)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows_of(df) == rows_of(one_task(spark, path))


def test_odd_files(spark, tmp_path, small_ranges):
    for name, text in {"open.csv": 'id,note,price\n1,a,2\n2,"never closed\nmore,3\n', "blank.csv": "id,note,price\n\n1,a,2\n\n\n", "end.csv": 'id,note,price\n1,"a\n",2'}.items():
        (tmp_path / name).write_text(text)
        assert rows_of(read_table(spark, str(tmp_path / name), schema=SCHEMA, multi_line=True))[0][:2] == rows_of(one_task(spark, str(tmp_path / name)))[0][:2]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(SourceError, match="no columns"):
        read_table(spark, str(tmp_path / "empty.csv"), multi_line=True)
    (tmp_path / "head.csv").write_text('id,note,price\n')
    head = read_table(spark, str(tmp_path / "head.csv"), multi_line=True)
    assert head.columns == ["id", "note", "price"] and head.count() == 0
