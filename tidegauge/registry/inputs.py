"""Survey-shaped inputs derived from the given tables, in Spark and as SQL.

``orders`` becomes the respondent table: o_orderkey is the row id, the order year the wave,
and every answer is a hash of the row id. The work of a query grows with ``orders``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.hashing import hash_int
from tidegauge.operators.cells import analytic
from tidegauge.operators.clean import recode
from tidegauge.session import new_folder

WAVES = tuple(range(1995, 2002))
ERA_CUT = 1999
FOCUS = 2000  # the wave that the single-wave studies use
ROWS_PER_TASK = 250_000  # orders whose answers one task derives

SALTS = (
    "emp", "sex", "age", "mar", "edu", "inc", "ins", "mil", "drug", "tx", "ori", "hlt",
    "sick", "crim", "hrs", "k6", "y", "str", "psu", "wt",
)

# Coded answers as text that both engines read; h_* are the row's hash integers.
RAW = {
    "employment": "case when h_emp%10 < 8 then 1 else 2 end",
    "sex": "case when h_sex%50 = 0 then null else 1+h_sex%2 end",
    "age": "case when h_age%45 = 0 then 94 else 1+h_age%6 end",
    "marital": "case when h_mar%40 = 0 then 99 when h_mar%40 = 1 then null else 1+h_mar%4 end",
    "education": "1+h_edu%11",
    "income": "case when h_inc%60 = 0 then 98 else 1+h_inc%7 end",
    "health_insurance": "1+h_ins%2",
    "military": (
        "case h_mil%12 when 0 then 2 when 1 then 3 when 2 then 99 when 3 then 85 "
        "when 4 then 89 when 5 then null else 1 end"
    ),
    "drug_use": "case when h_drug%20 = 0 then 94 when h_drug%20 < 5 then 1 else 2 end",
    "mental_health_tx": "case when h_tx%30 = 0 then 97 when h_tx%30 < 6 then 1 else 0 end",
    "sexual_orientation": (
        "case when h_ori%50 = 0 then 94 when h_ori%50 = 1 then 4 "
        "when h_ori%50 < 6 then 2+h_ori%2 else 1 end"
    ),
    "overall_health": "1+h_hlt%5",
    "sick_days": "case when h_sick%25 = 0 then 85 else h_sick%15 end",
    "criminal": "case when h_crim%33 = 0 then 97 when h_crim%33 < 4 then 1 else 2 end",
    "work_hours": "case when h_hrs%25 = 0 then 98 else h_hrs%61 end",
    "k6_score": "case when h_k6%30 = 0 then 97 else h_k6%25 end",
    "suicide": (
        "case when h_y%40 = 0 then 97 when h_y%1000 < 20 + 4*(h_k6%25) + "
        "(case when h_drug%20 < 5 then 60 else 0 end) then 1 else 2 end"
    ),
    "strat": "1+h_str%20",
    "psu": "1+h_psu%2",
    "wgt": "cast(500 + h_wt%1500 as double)",
}

P_NEW = (
    "cast(1 + 24*coalesce(k6_score,8) + 60*coalesce(drug_use,0) + h_pn%200 as double)"
    "/cast(1000 as double)"
)
P_OLD = "cast(1 + 12*coalesce(k6_score,8) + h_po%500 as double)/cast(1000 as double)"


def _sql_hash(salt: str, column: str) -> str:
    return f"cast('0x'||substr(md5(concat('{salt}:', cast({column} as varchar))),1,7) as bigint)"


SKIP = "(85,89,94,97,98,99)"


def _sql_bin(c: str, alias: str) -> str:
    return (
        f"case when {c} in {SKIP} then null when {c} = 1 then cast(1 as double) "
        f"when {c} in (0,2) then cast(0 as double) end as {alias}"
    )


def _sql_num(c: str) -> str:
    return f"case when {c} in {SKIP} then null else cast({c} as double) end as {c}"


def clean_select(source: str, employment: str = "cast(employment as double)") -> str:
    """SQL recode of a coded table, independent of the Spark recode."""
    return f"""select row_id, wave, {employment} as employment,
  {_sql_bin('suicide', 'y')},
  case when sex = 1 then cast(1 as double) else cast(0 as double) end as male,
  case when marital in {SKIP} then null when marital = 1 then cast(1 as double)
       else cast(0 as double) end as married,
  case when sexual_orientation in {SKIP} then null
       when sexual_orientation = 1 then cast(0 as double)
       when sexual_orientation in (2,3) then cast(1 as double)
       else cast(sexual_orientation as double) end as lgbtq,
  case when military in (85,94,97,98) then null when military in (2,3) then cast(1 as double)
       else cast(0 as double) end as veteran,
  {', '.join(_sql_bin(c, c) for c in ('drug_use', 'mental_health_tx', 'criminal'))},
  {', '.join(_sql_num(c) for c in ('k6_score', 'work_hours', 'sick_days', 'income', 'education', 'age', 'overall_health'))},
  cast(health_insurance as double) as health_insurance, strat, psu, wgt
from {source}"""


CTES = {
    "hashed": (
        "select o_orderkey as row_id, cast(year(o_orderdate) as integer) as wave, "
        + ", ".join(f"{_sql_hash(s, 'o_orderkey')} as h_{s}" for s in SALTS)
        + " from orders"
    ),
    "raw": "select row_id, wave, " + ", ".join(f"{v} as {k}" for k, v in RAW.items()) + " from hashed",
    "clean": clean_select("raw"),
    "analytic": "select * from clean where employment = 1 and y is not null",
    "scored": (
        f"select *, {_sql_hash('pn', 'row_id')} as h_pn, {_sql_hash('po', 'row_id')} as h_po "
        "from analytic"
    ),
    "preds": (
        "select row_id, wave, cast(y as integer) as y, male, age, veteran, lgbtq, income, "
        f"{P_NEW} as p_new, {P_OLD} as p_old from scored"
    ),
}


def respondents(orders: DataFrame) -> DataFrame:
    """Coded answers of every order, for a batch or a stream."""
    keyed = orders.select(F.col("o_orderkey").alias("row_id"), F.year("o_orderdate").alias("wave"))
    hashed = keyed.select(
        "row_id", "wave", *[hash_int(s, F.col("row_id")).alias(f"h_{s}") for s in SALTS]
    )
    return hashed.select("row_id", "wave", *[F.expr(v).alias(k) for k, v in RAW.items()])


class Inputs:
    """Lazy Spark frames over one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """The respondent table, derived from ``orders`` once per application and stored by wave.

        This is the step that receives wave files; every query then reads (and prunes) this
        table. Twenty digests a row are much work on few bytes, so rows are dealt to tasks by their
        number, however the source is cut into files and blocks.
        """
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        cores = self.spark.sparkContext.defaultParallelism
        tasks = max(cores, -(-orders.count() // ROWS_PER_TASK))
        rows = respondents(orders.repartition(tasks, "o_orderkey"))
        self.raw_folder = new_folder(self.spark, "respondents")
        rows.write.partitionBy("wave").parquet(self.raw_folder)
        return self.spark.read.schema(rows.schema).parquet(self.raw_folder).select(*rows.columns)

    @cached_property
    def clean(self) -> DataFrame:
        return recode(self.raw)

    @cached_property
    def analytic(self) -> DataFrame:
        return analytic(self.clean)

    @cached_property
    def preds(self) -> DataFrame:
        scored = self.analytic.withColumn("h_pn", hash_int("pn", F.col("row_id"))).withColumn(
            "h_po", hash_int("po", F.col("row_id"))
        )
        return scored.select(
            "row_id", "wave", F.col("y").cast("int").alias("y"), "male", "age", "veteran",
            "lgbtq", "income", F.expr(P_NEW).alias("p_new"), F.expr(P_OLD).alias("p_old"),
        )

    @cached_property
    def long_preds(self) -> DataFrame:
        """(row_id, wave, y, model, score)."""
        return self.preds.select(
            "row_id", "wave", "y", F.expr("stack(2, 'new', p_new, 'old', p_old) as (model, score)")
        )


CTES["long_preds"] = (
    "select row_id, wave, y, 'new' as model, p_new as score from preds union all "
    "select row_id, wave, y, 'old' as model, p_old as score from preds"
)
