"""Exports with line breaks in values: many tasks give what one task gives."""

import pytest

from registra.sources import exports, io


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def value(k):
    return ["plain", "two\nlines", 'with "quotes", and\n\n"more"\n', "x" * (37 * (k % 9)), "", " spaced ", "ë;ç"][k % 7]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_equals_one_task(spark, tmp_path, small_blocks, end):
    """Records over several blocks, quotes that are doubled, blank lines, a byte order mark, two delimiters."""
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    for f, sep in enumerate(",;"):
        lines = [sep.join(["\ufeffNr" if f else "Nr", "Titulli", '"Vlera"'])]
        for k in range(60):
            lines.append(sep.join([str(100 * f + k), quoted(value(k)), quoted(value(k + 3)) if k % 2 else "12"]))
            lines += [""] * (k % 5 == 0)
        lines.append(sep.join(["9", quoted("long\n" * 300), "1"]))
        (tmp_path / f"f{f}.csv").write_text(end.join(lines) + end, newline="")
    got, want = exports.read_export_split(spark, str(tmp_path)), io.read_export(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(rows_of(got)) == 122 and exports.records(spark, str(tmp_path)).select("file").distinct().count() == 2
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_ragged_rows_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        exports.read_export_split(spark, str(tmp_path)).collect()


def test_headers(spark, tmp_path):
    assert exports.header_names("\ufeffa; A ;;b", ";") == ["a0", "A1", "_c2", "b"]
    (tmp_path / "a.csv").write_text("\n")
    with pytest.raises(ValueError, match="header"):
        exports.read_export_split(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("a,b\n")
    assert exports.read_export_split(spark, str(tmp_path / "b.csv")).collect() == []


def test_search_sink_adds_replaces_and_counts(spark, tmp_path):
    """A dry run writes nothing; without reset documents are added, with it they replace; files are of bounded length."""
    docs, path = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id int, title string").coalesce(1), str(tmp_path / "s")
    assert io.write_search_documents(docs, path, dry_run=True) == 10 and not (tmp_path / "s").exists()
    assert io.write_search_documents(docs.where("id < 4"), path) is None
    io.write_search_documents(docs.where("id >= 4"), path, rows_per_file=2)
    assert sorted(r.id for r in spark.read.json(path).collect()) == list(range(10)) and len(list((tmp_path / "s").glob("*.json"))) == 4
    io.write_search_documents(docs.where("id = 7"), path, reset=True)
    assert [r.id for r in spark.read.json(path).collect()] == [7]
    io.write_search_documents(docs, str(tmp_path / "p"), file_format="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
