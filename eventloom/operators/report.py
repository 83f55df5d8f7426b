"""Text reports of task statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fmt2, int_trunc

# What is reported, how it is named and laid out, and which cells count as missing.
KINDS = ("duration", "waiting time", "idle time", "cost", "cost over thresh", "duration over thresh")
FIGURES = ("Avg", "Min", "Max", "Total")
MEASURES = tuple(f"{f} {k}" for k in KINDS for f in FIGURES)
HEADER = ("Individual Task Statistics", "--------------------------")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _quoted(text: Column) -> Column:
    """In single quotes, or in double ones if it has single quotes alone."""
    mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise("'")
    return F.concat(mark, text, mark)


def _line(name: Column, place: Column) -> Column:
    """A line, or why there is none: of the name (at place 0), a figure, or the count (at the last place)."""
    at = F.array_position("header", name)
    raw = F.get("cells", at.cast("int") - 1)
    cell = F.when(~F.trim(raw).isin(*MISSING), raw)
    figure = fmt2(F.when(cell.isNull(), F.lit(float("nan"))).otherwise(cell.try_cast("double")))
    count = int_trunc(cell).cast("string")
    first, last = place == 0, place == len(MEASURES) + 1
    shown = F.when(first, F.concat(F.lit("Task: "), F.coalesce(cell, F.lit("nan")))).otherwise(F.concat(F.lit("- "), name, F.lit(": "), F.when(last, count).otherwise(figure)))
    wrong = F.when(~last, F.concat(F.lit("could not convert string to float: "), _quoted(cell))).when(cell.isNull(), "cannot convert float NaN to integer")
    wrong = F.coalesce(wrong, F.concat(F.lit("invalid literal for int() with base 10: "), _quoted(cell)))
    why = F.when(at == 0, F.concat(F.lit("'"), name, F.lit("'"))).when(shown.isNull(), wrong)
    return F.struct(shown.alias("line"), why.alias("why"))


def task_report(stats: DataFrame) -> DataFrame:
    """``file, row, line_no, line``: a title, 24 figures, a count and a blank line per row.

    A missing name or figure is shown as nan.  Where a figure or the count is no number, the count is missing or a
    column is absent, the lines before it stay and an error line ends the row.
    """
    names = F.array(*map(F.lit, ("Name", *MEASURES, "Count")))
    made = stats.where("problem is null").select("file", "row", F.transform(names, _line).alias("all"))
    bad = F.array_position(F.transform("all", lambda x: x["why"].isNotNull()), True).cast("int")
    text = F.transform("all", lambda x: x["line"])
    error = F.concat(F.lit("Error processing row "), F.col("row").cast("string"), F.lit(": "), F.get("all", bad - 1)["why"])
    shown = F.when(bad > 0, F.concat(F.slice(text, F.lit(1), bad - 1), F.array(error))).otherwise(F.concat(text, F.array(F.lit(""))))
    return made.select("file", "row", F.posexplode(shown).alias("line_no", "line"))


def report_header(files: DataFrame) -> DataFrame:
    """Two title lines for each file, before its rows."""
    return files.select("file").distinct().select("file", F.lit(-1).alias("row"), F.posexplode(F.array(*map(F.lit, HEADER))).alias("line_no", "line"))
