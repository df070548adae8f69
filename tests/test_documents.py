import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from asofkit.sources.documents import BarDocuments, bars, problems


def bar(day, close):
    return {"trading_date": day, "close": close, "volume": None}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bars")

    def put(security, year, *lines, name="part-0.txt"):
        folder = at / f"security_id={security}" / f"year={year}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines))

    put("A", 2023, {"bars": [bar("2023-12-29", 1), bar("2023-01-03", "2.5")], "currency": "USD"})
    put("A", 2024, {"bars": [bar("2024-01-02", 3)]}, b"", {"bars": [bar("2024-01-03", 4)]})
    put("B%2FC", 2024, {"bars": [bar("2024-01-02", 5)], "security_id": "B/C"})
    put("D", 2024, b'{"bars": [{"trading_date": "2024-01')  # damaged
    put("D", 2024, b"\xff\xfe", name="part-1.txt")
    put("D", 2024, {"bars": [bar("2024-05-05", 7)]}, name="part-2.txt")
    put("D", 2023, {"bars": [bar("2022-05-05", 7)]})  # another year
    put("E", 2024, {"bars": [], "security_id": "A"}, {"none": 1}, name="part-0.txt")
    put("E", 2024, b"no document", name="_SUCCESS")
    (at / "README").write_text("no folder")
    spark.dataSource.register(BarDocuments)
    return str(at)


def rows(df):
    return sorted((r["security_id"], str(r["trading_date"]), r["currency"], r["close"], r["volume"]) for r in df.collect())


ALL = [("A", "2023-01-03", "USD", 2.5, None), ("A", "2023-12-29", "USD", 1.0, None), ("A", "2024-01-02", None, 3.0, None), ("A", "2024-01-03", None, 4.0, None), ("B/C", "2024-01-02", None, 5.0, None), ("D", "2024-05-05", None, 7.0, None)]


def test_bars_and_problems(spark, root):
    read = spark.read.format("asofkit_bars").option("bytes", 200)
    assert rows(read.load(root)) == ALL and rows(read.load(f"file://{root}")) == ALL
    assert read.load(root).rdd.getNumPartitions() > 3
    bad = problems(spark, root).collect()
    assert sorted((r["security_id"], r["year"], r["path"].rsplit("/", 1)[1]) for r in bad) == [("D", 2023, "part-0.txt"), ("D", 2024, "part-0.txt"), ("D", 2024, "part-1.txt"), ("E", 2024, "part-0.txt")]
    assert read.load(f"{root}/nothing").count() == 0


@pytest.mark.parametrize("securities", [None, ["A"], ["A", "B/C", "Z"], []])
@pytest.mark.parametrize("first, last", [(None, None), ("2023-12-29", None), ("2023-12-30", "2024-01-02"), (None, "2023-01-03"), ("2024-06-01", "2024-05-01")])
def test_what_is_asked_for_is_what_is_read(spark, root, securities, first, last):
    days = [d and date.fromisoformat(d) for d in (first, last)]
    want = [r for r in ALL if (securities is None or r[0] in securities) and (not first or r[1] >= first) and (not last or r[1] <= last)]
    assert rows(bars(spark, root, securities, *days)) == want


def test_a_read_keeps_its_rows_after_a_filtered_one(spark, root):
    df = bars(spark, root)
    assert [df.count(), df.where("security_id = 'A'").count(), df.count(), df.where("trading_date < date '2024-01-01'").count(), df.count()] == [6, 4, 6, 2, 6]


def test_other_companies_and_years_are_not_opened(spark, root):
    read = lambda *asked: spark.read.format("asofkit_bars").options(bytes=1, **dict(asked)).load(root).rdd.getNumPartitions()
    assert [read(("securities", '["A"]')), read(("securities", '["A"]'), ("first", "2024-06-01")), read(("last", "2023-12-31")), read()] == [2, 1, 2, 8]  # files
