"""Statistics sections with quoted cells, and the report's lines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import report
from eventloom.sources import models

HEAD = ",".join(("Name", "Count", *report.MEASURES))
FIGURES = ["1234.5", "0", "-1", "1e3"] * 6


def rows_of(spark, text):
    return models.stats_section(spark.createDataFrame([("f", text)], "file string, value string")).orderBy("row").collect()


def lines_of(spark, *records, head=HEAD):
    text = "\n".join(("intro", "Individual task statistics", head, *records))
    stats = models.stats_section(spark.createDataFrame([("f", text)], "file string, value string"))
    return [r.line for r in report.task_report(stats).orderBy("row", "line_no").collect()]


def test_quoted_cells(spark):
    tail = "," + ",".join(["5", *FIGURES])
    names = ['"Check, then sign"', '"say ""yes"""', '"two\nlines"', 'mid"quote', '"" ', '"a"b"c"', "plain"]
    text = "x\n\n" + "The Individual task statistics:\r\n\r\n" + HEAD + "\r\n" + "\n \n".join(n + tail for n in names)
    got = rows_of(spark, text)
    assert [r.cells[0] for r in got] == ["Check, then sign", 'say "yes"', "two\nlines", 'mid"quote', " ", 'ab"c"', "plain"]
    assert [r.row for r in got] == list(range(len(names))) and all(len(r.cells) == 26 and r.header == HEAD.split(",") for r in got)


def test_records_are_those_of_a_csv_reader(spark):
    rnd = random.Random(3)
    tables = [[["".join(rnd.choice('ab,"\n ') for _ in range(rnd.randint(0, 5))) + "x" for _ in range(rnd.randint(1, 5))] for _ in range(4)] for _ in range(80)]
    texts = []
    for t in tables:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(t)
        texts.append(out.getvalue())
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", models.csv_records(F.col("text")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == tables


@pytest.mark.parametrize(("text", "problem"), [("a\nb", "no marker"), ("Individual task statistics\na,b\n1,2", "fewer than 26 columns"), ("Individual task statistics", "fewer than 26 columns"), ("", "no marker")])
def test_problems(spark, text, problem):
    assert [(r.problem, r.cells) for r in rows_of(spark, text)] == [(problem, None)]


def test_open_quotes_end_with_the_text(spark):
    assert rows_of(spark, f'Individual task statistics\n{HEAD}\n"never, closed\n1')[0].cells == ["never, closed\n1"]


def test_report_lines(spark):
    got = lines_of(spark, ",".join(['"Check, then sign"', "7.9", *FIGURES]))
    want = ["Task: Check, then sign"]
    for kind in ("duration", "waiting time", "idle time", "cost", "cost over thresh", "duration over thresh"):
        want += [f"- Avg {kind}: 1,234.50", f"- Min {kind}: 0.00", f"- Max {kind}: -1.00", f"- Total {kind}: 1,000.00"]
    assert got == [*want, "- Count: 7", ""]


def test_report_of_missing_and_wrong_cells(spark):
    got = lines_of(spark, ",".join(["", "1", "NA", *FIGURES[1:]]), ",".join(["b", "1", "2", "it's", *FIGURES[2:]]), ",".join(["c", "n/a", *FIGURES]), ",".join(["d", "many", *FIGURES]), "e,3,4")
    assert got[:2] == ["Task: nan", "- Avg duration: nan"] and got[26] == ""
    assert got[27:30] == ["Task: b", "- Avg duration: 2.00", 'Error processing row 1: could not convert string to float: "it\'s"']
    assert got[30] == "Task: c" and got[55] == "Error processing row 2: cannot convert float NaN to integer"
    assert got[81] == "Error processing row 3: invalid literal for int() with base 10: 'many'"
    assert got[82:85] == ["Task: e", "- Avg duration: 4.00", "- Min duration: nan"] and got[107] == "- Count: 3"
    assert lines_of(spark, ",".join(["b", "1", *FIGURES]), head=HEAD.replace("Min cost,", "Least cost,"))[-1] == "Error processing row 0: 'Min cost'"


def test_titles(spark):
    files = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    assert [r.line for r in report.report_header(files).where("file = 'a'").orderBy("line_no").collect()] == ["Individual Task Statistics", "-" * 26]
