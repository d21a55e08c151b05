"""CSV records with line breaks read in parallel, rejected records, typed Parquet input."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfeat.sources import records
from riskfeat.sources.scan import read_rejected, read_sources, scan_csv, scan_parquet, scan_rejected
from riskfeat.sources.schema import TABLE_COLUMNS, TRAIN_FILES

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


@pytest.fixture
def small_blocks(conf):
    conf(spark__sql__files__maxPartitionBytes="1500", spark__sql__files__openCostInBytes="500")


def cell(rng):
    return rng.choice([
        str(rng.randrange(1000)), "", "word", '"a,b"', '"x\ny"', '"q""q"', '"\n\n"', '""" \n,"', '"l1\nl2\nl3"', '5" pipe', 'a"b"c', '""', " sp ",
        '"' + "long\n" * 300 + '"', '"r\r\ns"',
    ])


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        f.write(end.join(["id,a,b", *rows]) + end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_one_task_reader(spark, tmp_path, small_blocks, end):
    """Records run across blocks, some over several; blank lines and two files."""
    rng = random.Random(2)
    for f in range(2):
        rows = [f"{f * 10000 + i},{cell(rng)},{cell(rng)}" if i % 50 else "" for i in range(700)]
        write(tmp_path / f"p{f}.csv", rows, end)
    lines = records.lines_of(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20 and records.has_open_lines(lines)
    states = records.block_states(lines)
    assert sum(inside for inside, _ in states.values()) > 5  # blocks that begin within quotes
    assert any(inside and owner != block for (_, block), (inside, owner) in states.items())
    got = records.parsed(records.records(lines), ["id", "a", "b"]).select("id", "a", "b")
    want = spark.read.options(**OPTIONS).csv(str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 2 * 686


def test_quote_states():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('a,"b', True, False), ('"a""', True, False), ('""', False, True),
        ('","', False, True), ('x","y', True, True), ('a"b,"c', True, True), ("", False, True), ('"a"b,"c"', False, False), ('"a",', False, False),
    ]:
        assert (records.ends_inside(line, False), records.ends_inside(line, True)) == (outside, inside), line


def test_scan_with_and_without_line_breaks(spark, tmp_path, small_blocks):
    write(tmp_path / "plain.csv", [f'{i},"x,{i}",NA' for i in range(300)], "\r\n")
    got = scan_csv(spark, str(tmp_path / "plain.csv"), SCHEMA)
    assert "PythonUDF" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(i, f"x,{i}", None) for i in range(300)]
    write(tmp_path / "broken.csv", [f'{i},"x\n{i}",y' for i in range(300)], "\r\n")
    got = scan_csv(spark, str(tmp_path / "broken.csv"), SCHEMA)
    assert sorted(map(tuple, got.collect())) == [(i, f"x\n{i}", "y") for i in range(300)]
    # other column orders, columns that are missing, a quote that is never closed, no rows
    write(tmp_path / "open.csv", ['1,"x\nz",q', '2,"never', "3,closed,z"])
    assert ("q", 1, None) in map(tuple, scan_csv(spark, str(tmp_path / "open.csv"), T.StructType.fromDDL("b string, id int, c double")).collect())
    write(tmp_path / "none.csv", [])
    assert scan_csv(spark, str(tmp_path / "none.csv"), SCHEMA).collect() == []


@pytest.mark.parametrize("text", ["x", '"x\ny"'])
def test_rejected_records(spark, tmp_path, text):
    write(tmp_path / "r.csv", [f"1,{text},2", f"z9,{text},2", f",{text},3", "", f"4,{text},5", f"NA,{text},6"])
    kept = scan_csv(spark, str(tmp_path / "r.csv"), SCHEMA).where("id IS NOT NULL").collect()
    assert sorted(r.id for r in kept) == [1, 4]
    bad = scan_rejected(spark, str(tmp_path / "r.csv"), SCHEMA).collect()
    assert sorted(r.record for r in bad) == sorted([f"z9,{text},2", f",{text},3", f"NA,{text},6"])


def test_sources_leave_rows_without_a_key_apart(spark, tmp_path):
    for table, columns in TABLE_COLUMNS.items():
        head = ",".join(["id", *columns])
        with open(tmp_path / TRAIN_FILES[table], "w") as f:
            f.write(f"{head}\n7,{','.join('1' for _ in columns)}\nbad,{','.join('1' for _ in columns)}\n")
    tables = read_sources(spark, str(tmp_path), "train")
    assert all([r.id for r in getattr(tables, t).collect()] == [7] for t in TABLE_COLUMNS)
    bad = read_rejected(spark, str(tmp_path), "train").collect()
    assert sorted(r.table for r in bad) == sorted(TABLE_COLUMNS) and all(r.record.startswith("bad,") for r in bad)
    # masked ids are text, so every key is good
    assert read_rejected(spark, str(tmp_path), "train", key_type="string").count() == 0


def test_parquet_gets_the_declared_types(spark, tmp_path):
    rows = spark.createDataFrame([("1", "NA", 3), ("x", "b", None)], "id string, a string, b long").withColumn("extra", F.lit(1))
    rows.write.parquet(str(tmp_path / "p"))
    schema = T.StructType.fromDDL("id bigint, a string, b double, c timestamp_ntz")
    got = scan_parquet(spark, str(tmp_path / "p"), schema)
    assert got.schema.simpleString() == "struct<id:bigint,a:string,b:double,c:timestamp_ntz>"
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, None, 3.0, None)", "(None, 'b', None, None)"]


def test_no_task_writes_or_reads_all_line_breaks(spark, tmp_path, conf):
    """The texts of the query go out and come back in as many tasks as the table has blocks."""
    from riskfeat.catalog import QUERIES

    texts = [(i, None if i % 9 == 0 else f'line {i}\n"quoted", {"x" * 900}\nend', "en", None if i % 4 == 0 else "web,a", 900) for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    conf(spark__sql__files__maxPartitionBytes="4000", spark__sql__files__openCostInBytes="500")
    out = QUERIES["scan_csv_line_breaks"](spark, str(tmp_path))
    assert len(out.inputFiles()) > 4
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, t, s) for i, t, _, s, _ in texts if i % 10 != 3)
