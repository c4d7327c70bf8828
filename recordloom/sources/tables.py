"""Readers: declared schemas over CSV or Parquet, and the star schema's stand-ins for the study's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns the study reads, by table.
SCHEMAS: dict[str, str] = {
    "icustays": "stay_id long, hadm_id long, intime timestamp_ntz, los double",
    "chartevents": "stay_id long, itemid int, charttime timestamp_ntz, valuenum double",
    "d_items": "itemid int, label string, abbreviation string, unitname string, param_type string, linksto string",
    "inputevents": "stay_id long, itemid int, starttime timestamp_ntz",
    "outputevents": "stay_id long, itemid int, charttime timestamp_ntz, value double",
    "labevents": "hadm_id long, itemid int, charttime timestamp_ntz, valuenum double",
    "d_labitems": "itemid int, label string, fluid string, category string",
    "patient": "patientunitstayid long, hospitalid int, unittype string, unitdischargeoffset int, unitadmittime24 string, age string, gender string",
    "vitalPeriodic": "patientunitstayid long, observationoffset int, heartrate double, systemicmean double, sao2 double, respiration double",
    "nurseCharting": "patientunitstayid long, nursingchartoffset int, nursingchartcelltypevallabel string, nursingchartcelltypevalname string, nursingchartvalue string",
    "lab": "patientunitstayid long, labresultoffset int, labname string, labresult string",
    "infusionDrug": "patientunitstayid long, infusionoffset int, drugname string",
    "apacheApsVar": "patientunitstayid long, eyes double, motor double, verbal double, heartrate double, meanbp double, respiratoryrate double, temperature double, urine double, vent double, intubated double",
    "apachePredVar": "patientunitstayid long, electivesurgery double",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reaches has the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def locate(spark: SparkSession, folder: str, names: list[str]) -> str:
    """Path of the first of names in folder; a compressed name (a.csv.gz) also stands for the plain file (a.csv)."""
    spellings = [s for name in names for s in (name, name[: name.rindex(".")] if "." in name else name)]
    found = next((s for s in spellings if exists(spark, f"{folder}/{s}")), None)
    if found is None:
        raise FileNotFoundError(f"{folder} has no {' or '.join(dict.fromkeys(spellings))}")
    return f"{folder}/{found}"


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a declared schema; only these columns are parsed.

    CSV columns are found by the header's names. A gzip file is one task: convert it once with to_parquet().
    """
    if path.endswith((".csv", ".csv.gz")):
        header = spark.read.option("header", True).csv(path).columns
        wanted = {c.split()[0]: c.split(None, 1)[1] for c in schema.split(", ")}
        full = ", ".join(f"`{c}` {wanted.get(c, 'string')}" for c in header)
        return spark.read.schema(full).option("header", True).csv(path).select(*[c for c in wanted])
    return spark.read.parquet(path).select(*[F.col(c.split()[0]) for c in schema.split(", ")])


def to_parquet(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """A Parquet copy that is written unless it is there; force writes it again."""
    if force or not exists(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def optional(df: DataFrame, name: str, kind: str = "string"):
    """The column if the table has it, else null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _variable(key: str, variables: dict[str, int]) -> Column:
    names = F.create_map(*(F.lit(x) for v, i in variables.items() for x in (i, v)))
    return names[(F.col(key) % len(variables)).cast("int")].alias("variable")


class Star:
    """The star schema in the study's roles; a day stands for a minute.

    stays: customers in regions (databases), nations (hospitals) and market segments (unit types). nurse: orders;
    monitor: lineitems of those orders by ship date; clock: events.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.spark, self.folder = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self._read(name)

    def stays(self) -> DataFrame:
        nations = self._read("nation").join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        joined = self._read("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("stay_key"),
            F.col("r_name").alias("database"),
            F.col("n_name").alias("hospital"),
            F.col("c_mktsegment").alias("unittype"),
            F.concat("n_name", F.lit(":"), "c_mktsegment").alias("unit_id"),
            F.col("c_acctbal").alias("los"),
            (F.col("c_acctbal") >= 0).alias("completed"),
        )

    def people(self) -> DataFrame:
        """Covariates of a stay: gender, year group, and two numbers that stand for comorbidities and chapters."""
        key = F.col("c_custkey")
        orders = self._read("orders").groupBy(F.col("o_custkey").alias("stay_key"))
        numbers = orders.agg(F.avg("o_totalprice").alias("comorbid"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("chapters"))
        who = self._read("customer").select(
            key.alias("stay_key"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
            F.concat(F.lit("group "), F.floor(key / 7) % 4).alias("year_group"),
        )
        return who.join(numbers, "stay_key", "left")

    def _offset(self, date: str):
        return F.datediff(F.col(date), F.lit("1995-01-01")).alias("offset_min")

    def nurse(self) -> DataFrame:
        return self._read("orders").select(F.col("o_custkey").alias("stay_key"), self._offset("o_orderdate"))

    def monitor(self) -> DataFrame:
        lines = self._read("lineitem").join(self._read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(F.col("o_custkey").alias("stay_key"), self._offset("l_shipdate"))

    def nurse_variables(self, variables: dict[str, int]) -> DataFrame:
        """Nurse events of several variables, told apart by the order's key modulo their number."""
        return self._read("orders").select(_variable("o_orderkey", variables), F.col("o_custkey").alias("stay_key"), self._offset("o_orderdate"))

    def monitor_variables(self, variables: dict[str, int]) -> DataFrame:
        """Monitor events of several variables, told apart by the part's key modulo their number."""
        lines = self._read("lineitem").join(self._read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(_variable("l_partkey", variables), F.col("o_custkey").alias("stay_key"), self._offset("l_shipdate"))

    def clock(self) -> DataFrame:
        return self._read("events").select(F.col("user_id").alias("stay_key"), "ts", F.col("event_type").alias("item"), "value")
