"""Process models (XML), simulation parameters (JSON) and statistics reports (CSV sections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tags of named model elements, in the order in which they are read.
ELEMENT_TAGS = ("task", "userTask", "serviceTask", "scriptTask", "manualTask", "businessRuleTask", "receiveTask", "sendTask", "callActivity", "startEvent", "endEvent")
STATS_MARKER = "Individual task statistics"
#: Models of one file at most.
FILE_MODELS = 5_000

_FLOW = "array<struct<_id:string,_sourceRef:string,_targetRef:string>>"
_GATEWAY = "array<struct<_id:string,_gatewayDirection:string>>"
_ELEMENT = "array<struct<_id:string,_name:string>>"

#: What no operator looks into is a variant: it is carried through as it is.
PARAMS_SCHEMA = """
model_id string,
arrival_time_calendar array<struct<`from`:string,`to`:string,beginTime:string,endTime:string>>,
arrival_time_distribution struct<distribution_name:string,distribution_params:array<struct<value:double>>>,
resource_calendars variant,
resource_profiles array<struct<id:string,resource_list:array<struct<id:string,name:string,cost_per_hour:double,amount:bigint,assignedTasks:array<string>>>>>,
task_resource_distribution array<struct<task_id:string,mean:double,resources:variant>>,
gateway_branching_probabilities array<struct<gateway_id:string,probabilities:array<struct<path_id:string,value:double>>>>
"""


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """One row per process of the model files: ``model_id`` (the process id) and its parts, in document order."""
    tags = ", ".join(f"`{t}` {_ELEMENT}" for t in ELEMENT_TAGS)
    schema = f"_id string, sequenceFlow {_FLOW}, exclusiveGateway {_GATEWAY}, {tags}"
    return spark.read.format("xml").option("rowTag", "process").option("ignoreNamespace", True).schema(schema).load(path).withColumnRenamed("_id", "model_id")


def write_models(processes: DataFrame, path: str) -> str:
    """Write processes as XML, thousands a file, so that files are few and none is large; as many as there are models would take most of the time."""
    processes.write.format("xml").option("rootTag", "definitions").option("rowTag", "process").option("maxRecordsPerFile", FILE_MODELS).save(path)
    return path


def scan_flows(models: DataFrame) -> DataFrame:
    return models.select("model_id", F.posexplode("sequenceFlow").alias("ordinal", "f")).select("model_id", "ordinal", F.col("f._id").alias("flow_id"), F.col("f._sourceRef").alias("source_ref"), F.col("f._targetRef").alias("target_ref"))


def scan_gateways(models: DataFrame) -> DataFrame:
    """Exclusive gateways that diverge."""
    rows = models.select("model_id", F.posexplode("exclusiveGateway").alias("ordinal", "g"))
    return rows.select("model_id", "ordinal", F.col("g._id").alias("gateway_id"), F.col("g._gatewayDirection").alias("direction")).where("direction = 'Diverging'")


def all_elements(models: DataFrame) -> DataFrame:
    """Elements of all tags, named or not, with an ordinal over tags in reading order."""

    def tagged(tag: str):
        return F.transform(F.coalesce(F.col(tag), F.array().cast(_ELEMENT)), lambda e: F.struct(F.lit(tag).alias("tag"), e["_id"].alias("element_id"), e["_name"].alias("name")))

    parts = F.concat(*map(tagged, ELEMENT_TAGS))
    return models.select("model_id", F.posexplode(parts).alias("ordinal", "e")).select("model_id", "ordinal", "e.*")


def last_named(elements: DataFrame) -> DataFrame:
    """One row per name of a model: the later tag, then the later element wins; nameless ones are passed over."""
    w = Window.partitionBy("model_id", "name").orderBy(F.desc("ordinal"))
    return elements.where("name is not null and name <> ''").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def scan_tasks(elements: DataFrame) -> DataFrame:
    """Plain tasks alone, whether named or not."""
    return elements.where("tag = 'task'")


def scan_params(spark: SparkSession, path: str, *, per_file: bool = False) -> DataFrame:
    """Parameters, one model a line, or with ``per_file`` one model a file over any number of lines."""
    return spark.read.schema(PARAMS_SCHEMA).option("multiLine", per_file).json(path)


def write_params(params: DataFrame, path: str) -> str:
    params.write.json(path)
    return path


# A cell in quotes may hold commas, line ends and doubled quotes; a quote inside another cell is a character like others.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:{_QUOTED}(?:"[^,\n]*+|\z)|[^,"\n][^,\n]*+|)'
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\n|\z)"


def csv_records(text: Column) -> Column:
    """Records of CSV text as arrays of cells; blank lines are passed over."""

    def plain(cell: Column) -> Column:
        inside = F.replace(F.regexp_extract(cell, f"^({_QUOTED})", 1).substr(F.lit(2), F.length(cell)), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')), F.concat(inside, F.regexp_extract(cell, rf'(?s)^{_QUOTED}"?(.*)$', 1))).otherwise(cell)

    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1)), lambda x: F.length(F.trim(x)) > 0)
    return F.transform(records, lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(f",({_CELL})"), F.lit(1)), plain))


def stats_section(files: DataFrame) -> DataFrame:
    """``file, row, cells, header, problem`` for ``files(file, value)``, whole texts of statistics reports.

    The section is the CSV text after the first line that holds the marker, its first record the header;
    a report without the marker or with fewer than 26 columns gives one row that names the problem.
    """
    text = F.regexp_replace("value", "\r\n?", "\n")
    at = F.locate(STATS_MARKER, text)
    after = F.position(F.lit("\n"), F.concat(text, F.lit("\n")), at)
    cut = files.select("file", at.alias("at"), F.when(at > 0, csv_records(F.substr(text, after + 1))).alias("records"))
    header = F.get("records", F.lit(0))
    told = cut.select("file", "records", header.alias("header"), F.when(F.col("at") == 0, F.lit("no marker")).when(F.coalesce(F.size(header), F.lit(0)) < 26, F.lit("fewer than 26 columns")).alias("problem"))
    body = F.when(F.col("problem").isNull(), F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0))))
    rows = told.select("file", "header", "problem", F.posexplode_outer(body).alias("row", "cells")).where("cells is not null or problem is not null")
    return rows.select("file", "row", "cells", "header", "problem")


def write_report(lines: DataFrame, path: str) -> str:
    """Write ``lines(file, row, line_no, line)`` as text, in order."""
    lines.orderBy("file", "row", "line_no").select("line").write.text(path)
    return path
