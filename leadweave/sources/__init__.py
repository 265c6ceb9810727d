"""Reading and writing: typed CSV, Parquet tables, named tables of a warehouse, JSON documents, and the order-table mapping."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEADS = "lead_id string, created_at timestamp, observation_complete_at timestamp, channel string, campaign string, service_type string, region string, consent_to_contact boolean, is_returning boolean, response_minutes double, follow_up_count int, estimated_value double"
EVENTS = "event_id string, lead_id string, event_type string, event_at timestamp, event_value double"
#: Tables that read_table() gives out.
READABLE = ("model_training_set", "mart_monthly_funnel", "mart_channel_performance", "mart_campaign_performance", "mart_recent_candidates", "fct_lead_outcomes")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, by a declared schema; values that don't fit fail the scan."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_csv_apart(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): a CSV file with a header by a declared schema, and the text of the lines that don't fit it as column ``line``.

    A line is bad if it has fewer or more fields than the schema, or a value that isn't of its column's type; empty fields are null. Lines
    are read once and kept, with all their columns: a scan that needs only some of them wouldn't see what is wrong with the others.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    bad = "_line" if "_line" not in names else "_line_"
    read = spark.read.schema(f"{schema}, {bad} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
    found = saved(read.csv(path))
    return found.where(F.col(bad).isNull()).select(*names), found.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, LEADS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, EVENTS)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'").csv(path)


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where the setting is absent a local master gets a folder of its own; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leadweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Warehouse:
    """Named tables below a folder, each replaced as a whole: a version is written beside the others, then a pointer file is moved to name it.

    Until that move readers get the version before, and a run that fails leaves it as it was. The KEPT latest versions stay, so that
    a reader who has started on one can end.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        """The version that readers get, None if there is none yet."""
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"Not a table name: {name}")
        at = self._path(name, "current")
        return self.spark.read.text(str(at)).first().value if self._files().exists(at) else None

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        before = self.version(name)
        made = f"v{int(before[1:10]) + 1 if before else 1:09d}-{uuid.uuid4().hex[:8]}"
        try:
            df.write.parquet(f"{self.root}/{name}/{made}")
        except Exception:
            self._files().delete(self._path(name, made), True)
            raise
        jvm, fs = self.spark._jvm, self._files()
        pointer = self._path(name, f"next-{made}")
        out = fs.create(pointer, True)
        out.write(bytearray(made.encode()))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(pointer, self._path(name, "current"), how)
        versions = sorted(s.getPath().getName() for s in fs.listStatus(self._path(name)) if s.getPath().getName().startswith("v"))
        for old in versions[: -self.KEPT]:
            fs.delete(self._path(name, old), True)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        version = self.version(name)
        if version is None:
            raise ValueError(f"No table {name} below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def has(self, name: str) -> bool:
        return self.version(name) is not None

    def read_table(self, name: str) -> DataFrame:
        """One of READABLE."""
        if name not in READABLE:
            raise ValueError(f"Unsupported table: {name}")
        return self.table(name)

    def register(self, name: str) -> None:
        """Make a table readable in SQL."""
        self.table(name).createOrReplaceTempView(name)


def json_value(value: Any) -> Any:
    """A value as JSON has it: dates as ISO text, decimals as numbers, NaN as null."""
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value != value:
        return None
    if hasattr(value, "asDict"):
        return {k: json_value(v) for k, v in value.asDict().items()}
    if isinstance(value, list | tuple):
        return [json_value(v) for v in value]
    return value


def records(df: DataFrame) -> list[dict[str, Any]]:
    """The rows of a bounded result (a report, a top-k) as JSON objects."""
    return [json_value(r) for r in df.collect()]


def write_json(path: str | Path, document: Any) -> None:
    Path(path).write_text(json.dumps(document, indent=2), encoding="utf-8")


# The order tables as leads and events: see the README.
EVENT_OF_LINE = {2: "contacted", 3: "qualified", 4: "consultation_booked", 5: "consultation_attended", 6: "customer_won"}


def leads_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = load(spark, sf_dir, "orders", "customer", "nation", "region")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    consent, key = F.col("c_acctbal") >= 0, F.col("o_orderkey")
    created = F.expr("o_orderdate + make_dt_interval(0, 0, cast((o_orderkey * 37) % 1440 as int), 0)")
    return joined.select(
        key.cast("string").alias("lead_id"),
        created.alias("created_at"),
        (created + F.expr("interval 24 hours")).alias("observation_complete_at"),
        F.col("c_mktsegment").alias("channel"),
        F.col("o_orderpriority").alias("campaign"),
        F.col("o_orderstatus").alias("service_type"),
        F.col("r_name").alias("region"),
        consent.alias("consent_to_contact"),
        (F.col("o_custkey") % 3 == 0).alias("is_returning"),
        (((key * 131) % 144001).cast("double") / 100).alias("response_minutes"),
        F.when(consent, key % 7).otherwise(F.lit(0)).cast("int").alias("follow_up_count"),
        F.col("o_totalprice").alias("estimated_value"),
    )


def events_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = load(spark, sf_dir, "lineitem")
    kind = F.lit("lead_created")
    for number, name in EVENT_OF_LINE.items():
        kind = F.when(F.col("l_linenumber") == number, F.lit(name)).otherwise(kind)
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.col("l_orderkey").cast("string").alias("lead_id"),
        kind.alias("event_type"),
        F.col("l_shipdate").alias("event_at"),
        F.when(F.col("l_linenumber") == 2, F.col("l_quantity")).alias("event_value"),
    )
