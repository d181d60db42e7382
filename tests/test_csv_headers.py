"""Headers of CSV files read in pieces."""

from clinisieve.sources import csv_records


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_headers_are_found_without_the_records(spark, tmp_path):
    texts = {"a": '\n \n"x\n1",y\nu,"v\nw"\n', "b": '"x\n1",y\r\n1,2\n', "c": "\n\n", "d": '"x\nopen,y\n', "e": "", "f": '"' + "long\n" * 40 + '",y\n1,2\n'}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "16")
    small.conf.set("spark.sql.files.openCostInBytes", "16")
    lines = csv_records.lines_of(small, str(tmp_path))
    pieces = csv_records.pieces_of(lines)
    headers = csv_records.headers_of(lines, pieces)
    assert "MapInArrow" not in plan(headers)
    whole = csv_records.records_of(lines, pieces).where("number = 0").select("file", "record")
    assert sorted(map(tuple, headers.collect())) == sorted(map(tuple, whole.collect())) and headers.count() == 4
