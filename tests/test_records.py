"""CSV files cut at any offset against the reader of whole files."""

import random

import pytest
from conftest import rows
from pyspark.sql import types as T

from tradewind.sources.files import read_csv_table
from tradewind.sources.records import csv_records

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("text", T.StringType()), T.StructField("n", T.DoubleType())])


@pytest.fixture
def cut_at(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield cut
    for name, value in before.items():
        spark.conf.set(name, value)


def cell(rng):
    kind = rng.random()
    if kind < 0.5:
        return "".join(rng.choice("abc é") for _ in range(rng.randint(0, 6)))
    return '"' + "".join(rng.choice(['""', ",", "\n", "x", "é", "", "\n\n"]) for _ in range(rng.randint(0, 9))) + '"'


def written(rng, folder, end, records, header="id,text,n"):
    lines = [header] + [f"{k},{cell(rng)},{rng.choice(['1.5', '', 'bad', '2e-3'])}" + rng.choice(["", "", "", ",extra"]) for k in range(records)]
    if rng.random() < 0.5:
        lines.insert(rng.randint(1, len(lines)), "")
    path = folder / f"t{rng.random()}.csv"
    path.write_bytes((end.join(lines) + rng.choice(["", end])).encode())
    return path


def both(spark, path, **options):
    """Rows and quarantine of both readers; the kept text of a bad record ends where its reader says."""
    result = []
    for whole in (False, True):
        got = read_csv_table(spark, str(path), SCHEMA, whole_files=whole, **options)
        result.append((sorted(rows(got.rows), key=repr), sorted((r[:-1] for r in rows(got.quarantine)), key=repr)))
    return result


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_files_cut_at_many_offsets(spark, tmp_path, cut_at, end):
    rng = random.Random(end)
    for size in (1201, 1810):
        path = written(rng, tmp_path, end, 600)
        cut_at(10**9)
        _, want = both(spark, path)
        cut_at(size)
        got, _ = both(spark, path)
        assert got == want, size


def test_every_place_of_a_record_meets_a_cut(spark, tmp_path, cut_at):
    """A pattern of 41 bytes, cut by ranges whose length leaves every rest."""
    path = tmp_path / "one.csv"
    pattern = ['{0},"a\n\n""b"",\nc",1.5', "", "{0},plain,", '{0},"\n",2', '{0},"""",x']
    path.write_text('"id","te\nxt",n\n' + "".join("\n".join(pattern).format(k % 10) + "\n" for k in range(400)))
    want = sorted(p.format(k % 10) for k in range(400) for p in pattern if p)
    for size in (1500, 1501, 1507):
        cut_at(size)
        assert sorted(r.record for r in csv_records(spark, str(path)).collect()) == want, size
    assert csv_records(spark, str(path), header=False).count() == len(want) + 1


def test_a_header_and_a_cell_that_reach_over_several_ranges(spark, tmp_path, cut_at):
    path = tmp_path / "wide.csv"
    path.write_text('id,"' + "te\nxt" * 1000 + '",n\n1,"' + "a\n" * 3000 + '",2\n2,b,3\n')
    cut_at(2000)
    assert sorted(r.record for r in csv_records(spark, str(path)).collect()) == ['1,"' + "a\n" * 3000 + '",2', "2,b,3"]


def test_a_folder_of_files_each_with_its_header(spark, tmp_path, cut_at):
    rng = random.Random(3)
    folder = tmp_path / "many"
    folder.mkdir()
    for _ in range(2):
        written(rng, folder, "\n", 200)
    (folder / "empty.csv").write_text("")
    (folder / "only.csv").write_text("id,text,n\n")
    cut_at(10**9)
    _, want = both(spark, folder)
    cut_at(1300)
    assert both(spark, folder)[0] == want and len(want[0]) + len(want[1]) == 400


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, cut_at):
    path = tmp_path / "large.csv"
    with path.open("w") as out:
        out.write("id,text,n\n")
        for k in range(60_000):
            out.write(f'{k},"line {k}\nand ""{k}""",{k}.5\n')
    cut_at(1 << 18)
    table = read_csv_table(spark, str(path), SCHEMA)
    assert table.rows.rdd.getNumPartitions() >= path.stat().st_size // (1 << 18)
    assert table.quarantine.count() == 0
    assert table.rows.selectExpr("count(*)", "sum(id)", "sum(n)", "count_if(text = concat('line ', id, '\\nand \"', id, '\"'))").first() == (
        60_000, 60_000 * 59_999 // 2, 60_000 * 59_999 / 2 + 30_000, 60_000,
    )
