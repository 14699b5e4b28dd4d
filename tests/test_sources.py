"""Readers on small hand-written files."""

from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks.sources import r01_ingest_filings
from loantide.operators.columns import stack_by_name
from loantide.plans.panel import PERIOD, filing_report, ingest_filings, snapshot_panel
from loantide.schema import FILING_INDEX_COLUMNS
from loantide.session import shared_folder
from loantide.sources import filings, loan_records, restated

INDEX = (
    ",".join(FILING_INDEX_COLUMNS)
    + """
10-D,"Report [parts 1, or 2]",2/3/2031,1/2/2031,7,11,,0000000001-24-000002,22,https://archive.test/a
ABS-EE,Loan data,2/4/2031,1/3/2031,7,12,,0000000001-24-000001,33,https://archive.test/b
"""
)
RECORDS = "<assetData>\n<assets><assetNumber>{0}</assetNumber><zeroBalanceCode>01</zeroBalanceCode></assets>\n</assetData>\n"


@pytest.fixture
def archive(tmp_path):
    (tmp_path / "index.csv").write_text(INDEX)
    for number in ("0000000001-24-000001", "0000000001-24-000002", "0000000009-24-000009"):
        folder = tmp_path / "landing" / f"accession_number={number}"
        folder.mkdir(parents=True)
        (folder / "exhibit.xml").write_text(RECORDS.format(number[-1]))
    return tmp_path


def test_filing_index(spark, archive):
    rows = filings.read_filing_index(spark, str(archive / "index.csv")).orderBy("form_type").collect()
    assert rows[0].form_description == "Report [parts 1, or 2]" and rows[0].film_number_s == "11"
    assert rows[1].size == 33 and rows[1].file_number_s is None


def test_only_listed_loan_data_is_ingested(spark, archive):
    raw = ingest_filings(spark, str(archive / "index.csv"), str(archive / "landing"), "https://archive.test/data/", "exhibit.xml")
    rows = raw.select("assetNumber", "zeroBalanceCode", "accession_number", "data_file_link").collect()
    link = "https://archive.test/data/000000000124000001/exhibit.xml"
    assert [tuple(r) for r in rows] == [("1", "01", "0000000001-24-000001", link)]


def test_lists_flatten_in_parallel(spark):
    df = spark.createDataFrame([("a", ["1", "2"], ["x"]), ("b", [], []), ("c", None, None)], "k string, p array<string>, q array<string>")
    rows = sorted(map(tuple, loan_records.flatten_lists(df, ["p", "q"]).collect()), key=str)
    assert rows == sorted([("a", "1", "x"), ("a", "2", None), ("b", None, None), ("c", None, None)], key=str)


def test_filings_with_different_leaves_stack(spark):
    a = spark.createDataFrame([("1", "x")], "assetNumber string, recoveredAmount string")
    b = spark.createDataFrame([("2", "y")], "assetNumber string, vehicleModelName string")
    rows = stack_by_name(a, b).orderBy("assetNumber").collect()
    assert [tuple(r) for r in rows] == [("1", "x", None), ("2", None, "y")]


def session(folder=None, **conf):
    context = SimpleNamespace(getCheckpointDir=lambda: folder)
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=context)


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_folder(session("/own", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert shared_folder(session("/own")) == "/own"
    with pytest.raises(ValueError):
        shared_folder(session())


def ingest(spark, archive, **more):
    return ingest_filings(spark, str(archive / "index.csv"), str(archive / "landing"), "https://archive.test/data", "exhibit.xml", **more)


def test_every_leaf_is_kept(spark, archive):
    listed = archive / "landing" / "accession_number=0000000001-24-000001" / "more.xml"
    listed.write_text("<d><assets><assetNumber>7</assetNumber><newLeaf>a</newLeaf><fee>1</fee><fee>2</fee><empty/></assets>\n</d>")
    rows = {r.assetNumber: r for r in ingest(spark, archive).collect()}
    assert (rows["7"].newLeaf, rows["7"].fee_1, rows["7"].fee_2, rows["7"].empty) == ("a", "1", "2", None)
    assert rows["1"].newLeaf is None and rows["1"].zeroBalanceCode == "01" and "vehicleModelName" in rows["1"]


def test_undashed_folders_are_found(spark, archive):
    landing = archive / "landing"
    (landing / "accession_number=0000000001-24-000001").rename(landing / "accession_number=000000000124000001")
    assert [r.accession_number for r in ingest(spark, archive).collect()] == ["0000000001-24-000001"]


def test_damaged_and_missing_filings(spark, archive):
    landing = archive / "landing"
    index = filings.asset_filings(filings.read_filing_index(spark, str(archive / "index.csv")), "b", "e")
    state = lambda: [(r.records, r.state) for r in filing_report(spark, index, str(landing)).collect()]
    assert state() == [(1, "complete")]
    file = landing / "accession_number=0000000001-24-000001" / "exhibit.xml"
    whole = file.read_text()
    file.write_text("<assetData>\n<assets><assetNumber>1</assetNumber>")
    assert state() == [(1, "cut off")]
    file.write_text("<assetData>\n<assets><assetNumber>1</assetNumber><zeroBal")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        ingest(spark, archive).collect()
    file.write_text(whole.replace("</zeroBalanceCode>", "</zeroBalance>"))
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        ingest(spark, archive).collect()
    file.rename(archive / "elsewhere.xml")
    assert state() == [(0, "missing")]
    with pytest.raises(FileNotFoundError, match="0000000001-24-000001"):
        ingest(spark, archive)
    assert ingest(spark, archive, skip_missing=True).count() == 0


def test_longer_lists_are_an_error(spark):
    df = spark.createDataFrame([("a", ["1", "2", "3"])], "k string, p array<string>")
    assert loan_records.widen_repeated(df, "p", 3).first().p_3 == "3"
    with pytest.raises(Exception, match="p occurs 3 times"):
        loan_records.widen_repeated(df, "p", 2).collect()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_once_and_months_pruned(spark, archive, tmp_path):
    raw = ingest(spark, archive)
    assert plan(raw).count("FileScan text") == 1
    filed = raw.withColumn(PERIOD, F.lit("4-30-2024"))
    snapshot_panel(filed, str(tmp_path / "snapshot"))
    back = spark.read.parquet(str(tmp_path / "snapshot"))
    month = plan(back.where(F.col(PERIOD) == F.lit("2024-04-30").cast("date")))
    assert f"PartitionFilters: [isnotnull({PERIOD}" in month and back.first()[f"filed_{PERIOD}"] == "4-30-2024"


def test_report_line_voids_on_missing(spark):
    from loantide.sources.storage import plain_number, report_line

    df = spark.createDataFrame([(1.5,), (None,)], "v double").select(report_line("Rate: ", plain_number("v"), "%").alias("line"))
    assert [r.line for r in df.collect()] == ["Rate: 1.5%", None]
    assert df.where(F.col("line").isNull()).count() == 1


def filed(spark, accession, day, rows, period="2031-01-31"):
    df = spark.createDataFrame([(str(a), str(v)) for a, v in rows], "assetNumber string, amount string")
    texts = {"accession_number": F.lit(accession), "filing_date": F.lit(day).cast("date"), PERIOD: F.lit(period).cast("date")}
    return df.withColumns(texts)


def values(df):
    return sorted((r.assetNumber, r.amount, r.accession_number) for r in df.collect())


def test_restated_months(spark, tmp_path):
    path = str(tmp_path / "panel")
    with pytest.raises(FileNotFoundError):
        restated.read_restated(spark, path)
    first = filed(spark, "a1", "2031-02-15", [(1, 10), (2, 20)])
    restated.append_filings(first, path)
    restated.append_filings(first, path)
    assert values(restated.read_restated(spark, path)) == [("1", "10", "a1"), ("2", "20", "a1")]
    # A later filing replaces the month, with a column more; an earlier one that arrives late does not.
    restated.append_filings(filed(spark, "a3", "2031-03-15", [(1, 11)]).withColumn("extra", F.lit("x")), path)
    restated.append_filings(filed(spark, "a2", "2031-02-20", [(1, 12), (3, 30)]), path)
    restated.append_filings(filed(spark, "b1", "2031-03-15", [(1, 9)], "2031-02-28"), path)
    assert values(restated.read_restated(spark, path)) == [("1", "11", "a3"), ("1", "9", "b1")]
    assert values(restated.read_restated(spark, path, as_of=date(2031, 3, 1))) == [("1", "12", "a2"), ("3", "30", "a2")]
    assert restated.read_restated(spark, path, as_of=date(2031, 1, 1)).count() == 0
    # Same day: the greater number. Rows without a period are a month of their own.
    restated.append_filings(filed(spark, "a4", "2031-03-15", [(5, 50)]).unionByName(filed(spark, "a4", "2031-03-15", [(6, 60)], None)), path)
    assert values(restated.read_restated(spark, path)) == [("1", "9", "b1"), ("5", "50", "a4"), ("6", "60", "a4")]
    plan = restated.read_restated(spark, path).where(F.col(PERIOD) == "2031-02-28")
    assert "PartitionFilters: [isnotnull(reportingPeriodEndingDate" in plan._jdf.queryExecution().toString()


def test_filings_of_a_lost_write_are_not_read(spark, tmp_path):
    path = str(tmp_path / "panel")
    restated.append_filings(filed(spark, "a1", "2031-02-15", [(1, 10)]), path)
    lost = filed(spark, "a2", "2031-02-20", [(1, 99)])
    lost.write.partitionBy(PERIOD).parquet(f"{path}/batches/batch=lost")
    assert values(restated.read_restated(spark, path)) == [("1", "10", "a1")]
    restated.append_filings(lost, path)
    assert values(restated.read_restated(spark, path)) == [("1", "99", "a2")]
    with pytest.raises(Exception, match="no accession number"):
        restated.append_filings(filed(spark, None, "2031-02-20", [(1, 1)]), path)
    assert values(restated.read_restated(spark, path)) == [("1", "99", "a2")]
    empty = filed(spark, "a9", "2031-09-20", [(1, 1)]).where("false")
    restated.append_filings(empty, str(tmp_path / "empty"))
    assert restated.read_restated(spark, str(tmp_path / "empty"), schema=empty.schema).count() == 0


def test_deals_are_restated_apart(spark, tmp_path):
    path = str(tmp_path / "panel")
    both = [filed(spark, f"{d}1", "2031-02-15", [(1, d)]).withColumn("deal", F.lit(d)) for d in "xy"]
    restated.append_filings(both[0].unionByName(both[1]), path, by=["deal"])
    restated.append_filings(filed(spark, "x2", "2031-03-15", [(2, "z")]).withColumn("deal", F.lit("x")), path, by=["deal"])
    assert values(restated.read_restated(spark, path, by=["deal"])) == [("1", "y", "y1"), ("2", "z", "x2")]


def test_amended_form_is_ingested_with_its_date(spark, archive):
    index = archive / "index.csv"
    index.write_text(index.read_text() + "ABS-EE/A,Loan data,2/9/2031,1/3/2031,7,12,,0000000009-24-000009,33,https://archive.test/c\n")
    raw = ingest_filings(
        spark, str(index), str(archive / "landing"), "https://archive.test/data/", "exhibit.xml", form=["ABS-EE", "ABS-EE/A"], dated=True
    )
    rows = sorted((r.accession_number, str(r.filing_date)) for r in raw.collect())
    assert rows == [("0000000001-24-000001", "2031-02-04"), ("0000000009-24-000009", "2031-02-09")]


def test_records_that_close_themselves(spark, tmp_path):
    from xml.etree import ElementTree

    some = ["<assets/>", "<assets />", "<assets a='1'/>", "<assets>\n</assets>", "<assets a='1'><assetNumber>7</assetNumber></assets>"]
    some += ["<assets ><assetNumber>8</assetNumber><empty/></assets>", "<assetsOther>9</assetsOther>", "<assets\na='2' />"]
    text = "<assetData>" + "".join(some + some[::-1]) + "<assets/></assetData>\n"
    (tmp_path / "hostile.xml").write_text(text)
    expected = sorted(str(r.findtext("assetNumber")) for r in ElementTree.fromstring(text).iter("assets"))
    schema = loan_records.record_schema(["assetNumber"])
    for read in (loan_records.scan_loan_records, loan_records.read_loan_records):
        rows = read(spark, str(tmp_path / "hostile.xml"), schema=schema).collect()
        assert sorted(str(r.assetNumber) for r in rows) == expected
    report = loan_records.file_report(spark, str(tmp_path / "hostile.xml")).collect()
    assert [(r.records, r.complete) for r in report] == [(len(expected), True)]
    leaves = {r.leaf: r.most for r in loan_records.leaf_names(spark, str(tmp_path / "hostile.xml")).collect()}
    assert leaves == {"assetNumber": 1, "empty": 1}


def record_files(path):
    return sorted(path.rglob("part-*"))


def test_records_are_written_compressed(spark, tmp_path):
    records = spark.range(2000, numPartitions=1).select(F.col("id").cast("string").alias("assetNumber"), (F.col("id") % 2).cast("string").alias("month"))
    plain, small = tmp_path / "plain", tmp_path / "small"
    loan_records.write_loan_records(records, str(plain), partition_by=["month"])
    loan_records.write_loan_records(records, str(small), partition_by=["month"], compression="gzip")
    size = lambda path: sum(f.stat().st_size for f in record_files(path))
    assert 5 * size(small) < size(plain)
    schema = loan_records.record_schema(["assetNumber"])
    for read in (loan_records.read_loan_records, loan_records.scan_loan_records):
        rows = read(spark, str(small), schema=schema)
        assert sorted(int(r.assetNumber) for r in rows.select("assetNumber").collect()) == list(range(2000))


def test_a_task_goes_on_with_a_new_file(spark, tmp_path):
    records = spark.range(1000, numPartitions=1).select(F.col("id").cast("string").alias("assetNumber"))
    loan_records.write_loan_records(records, str(tmp_path / "bounded"), file_records=300)
    files = record_files(tmp_path / "bounded")
    assert sorted(f.read_text().count("<assets>") for f in files) == [100, 300, 300, 300]
    assert all(f.read_text().rstrip().endswith("</assetData>") for f in files)
    loan_records.write_loan_records(records, str(tmp_path / "whole"), file_records=0)
    assert len(record_files(tmp_path / "whole")) == 1
    rows = loan_records.read_loan_records(spark, str(tmp_path / "bounded"), schema=loan_records.record_schema(["assetNumber"])).collect()
    assert sorted(int(r.assetNumber) for r in rows) == list(range(1000))


def test_larger_panels_have_more_files_and_not_larger_ones(spark, tmp_path):
    records = spark.range(loan_records.FILE_RECORDS + 1, numPartitions=1).select(F.col("id").cast("string").alias("assetNumber"))
    loan_records.write_loan_records(records, str(tmp_path / "default"))
    assert len(record_files(tmp_path / "default")) == 2


def test_records_of_known_leaves_add_no_name(spark, tmp_path):
    plain = "<assets><a>1</a><b x='1'>2</b></assets>"
    (tmp_path / "plain.xml").write_text(f"<assetData><head>0</head>\n{plain}\n<assets/>\n{plain}\n</assetData>\n<tail>0</tail>")
    odd = "<assets><a>1</a><a>2</a><a/></assets>", "<assets><b>1</b><c >2</c></assets>", "<assets></assets>"
    (tmp_path / "odd.xml").write_text(f"<assetData>{plain}{''.join(odd)}</assetData>")

    def names(file, known=()):
        return {r.leaf: r.most for r in loan_records.leaf_names(spark, str(tmp_path / file), known=known).collect()}

    assert names("plain.xml", ["a", "b", "z"]) == {}
    assert names("plain.xml", ["b"]) == {"a": 1, "b": 1} == names("plain.xml")
    assert names("odd.xml", ["a", "b"]) == {"a": 3, "b": 1, "c": 1}
    assert names("odd.xml") == {"a": 3, "b": 1, "c": 1}


def test_filing_numbers_are_made_behind_the_exchange(spark, sf_dir, monkeypatch):
    plans, write = [], loan_records.write_loan_records

    def noted(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, *args, **kwargs)

    monkeypatch.setattr(loan_records, "write_loan_records", noted)
    r01_ingest_filings(spark, sf_dir)
    above, _, below = plans[0].partition("RebalancePartitions")
    assert "date_format" in above and below and "date_format" not in below
