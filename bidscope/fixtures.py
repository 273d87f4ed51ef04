"""The ``notices`` fixture: a raw opportunity sheet derived from the driver's
``orders``, ``customer`` and ``nation`` tables.

Every row of ``orders`` becomes one notice, so the fixture grows with the
scale factor.  It carries four date layouts plus junk, every classification
branch, blank / token / NULL set-asides and a NULL type.  ``NOTICES_SQL`` is
the same derivation as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sizing import broadcast_if_bounded, spread

NOTICE_COLUMNS = ("SolicitationNumber", "Title", "Agency", "PostedDate", "ResponseDeadLine",
                  "Type", "TypeOfSetAsideDescription", "UiLink", "NaicsCode")

NOTICES_SQL = """
SELECT concat('SOL-', cast(o_orderkey as string)) AS SolicitationNumber,
  concat(c_mktsegment, ' supplies for ', o_orderpriority) AS Title,
  n_name AS Agency,
  CASE WHEN o_orderkey % 25 = 4 THEN 'TBD'
       WHEN o_orderkey % 5 = 1 THEN concat(substr(d,6,2),'/',substr(d,9,2),'/',substr(d,1,4))
       WHEN o_orderkey % 5 = 2 THEN concat(d,'T23:30:00-05:00')
       WHEN o_orderkey % 5 = 3 THEN concat(d,' 08:00:00')
       ELSE d END AS PostedDate,
  cast(cast(d as date) + cast(o_orderkey % 45 as int) as string) AS ResponseDeadLine,
  CASE o_orderkey % 7 WHEN 0 THEN 'Solicitation' WHEN 1 THEN 'Combined Synopsis/Solicitation' WHEN 2 THEN 'Presolicitation'
       WHEN 3 THEN 'Sources Sought' WHEN 4 THEN 'Request for Information' WHEN 5 THEN 'Award Notice' END AS Type,
  CASE o_custkey % 12 WHEN 0 THEN 'Service-Disabled Veteran-Owned Small Business (SDVOSB) Set-Aside'
       WHEN 1 THEN 'Women-Owned Small Business'
       WHEN 2 THEN 'SBA Certified Economically Disadvantaged WOSB (EDWOSB) Program Set-Aside (FAR 19.15)'
       WHEN 3 THEN 'Economically Disadvantaged Concern' WHEN 4 THEN 'Total Small Business Set-Aside (FAR 19.5)'
       WHEN 5 THEN 'Veteran-Owned Small Business' WHEN 6 THEN 'No Set aside used' WHEN 7 THEN '8(a) Set-Aside'
       WHEN 8 THEN '' WHEN 9 THEN 'None' WHEN 10 THEN '  N/A ' END AS TypeOfSetAsideDescription,
  concat('https://example.test/opp/', cast(o_orderkey as string)) AS UiLink,
  cast(541510 + o_orderkey % 6 as string) AS NaicsCode
FROM (SELECT *, cast(cast(o_orderdate as date) as string) AS d FROM orders) o
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")


_BUILT: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NOTICES_SQL`` in the DataFrame API.

    The lazy frame is built once per session and folder (footers read, size
    check done) and reused by every query; no data is cached.
    """
    key = (id(spark), sf_dir.rstrip("/"))
    hit = _BUILT.get(key)
    if hit is None or hit[0] is not spark:
        orders = spread(read_table(spark, sf_dir, "orders").select(*ORDER_COLUMNS))
        _BUILT[key] = (spark, notices_from_orders(spark, sf_dir, orders))
    return _BUILT[key][1]


def notices_from_orders(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Notices for a batch *or streaming* ``orders`` frame.

    ``orders`` (the large side) joins ``customer`` on its key, a shuffle join
    that AQE may turn into a broadcast at run time and splits when one
    customer holds a large share of orders; ``nation`` is broadcast after a
    bounded row-count check.
    """
    o = orders
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    k = F.col("o_orderkey")
    day = F.to_date(F.col("o_orderdate"))
    d = day.cast("string")
    posted = (F.when(k % 25 == 4, F.lit("TBD"))
              .when(k % 5 == 1, F.concat(F.substring(d, 6, 2), F.lit("/"), F.substring(d, 9, 2),
                                         F.lit("/"), F.substring(d, 1, 4)))
              .when(k % 5 == 2, F.concat(d, F.lit("T23:30:00-05:00")))
              .when(k % 5 == 3, F.concat(d, F.lit(" 08:00:00")))
              .otherwise(d))
    type_text = (F.when(k % 7 == 0, "Solicitation")
                 .when(k % 7 == 1, "Combined Synopsis/Solicitation")
                 .when(k % 7 == 2, "Presolicitation")
                 .when(k % 7 == 3, "Sources Sought")
                 .when(k % 7 == 4, "Request for Information")
                 .when(k % 7 == 5, "Award Notice"))
    ck = F.col("o_custkey") % 12
    set_aside = (F.when(ck == 0, "Service-Disabled Veteran-Owned Small Business (SDVOSB) Set-Aside")
                 .when(ck == 1, "Women-Owned Small Business")
                 .when(ck == 2, "SBA Certified Economically Disadvantaged WOSB (EDWOSB) Program "
                                "Set-Aside (FAR 19.15)")
                 .when(ck == 3, "Economically Disadvantaged Concern")
                 .when(ck == 4, "Total Small Business Set-Aside (FAR 19.5)")
                 .when(ck == 5, "Veteran-Owned Small Business")
                 .when(ck == 6, "No Set aside used")
                 .when(ck == 7, "8(a) Set-Aside")
                 .when(ck == 8, "")
                 .when(ck == 9, "None")
                 .when(ck == 10, "  N/A "))

    joined = (o.join(c, o.o_custkey == c.c_custkey)
               .join(broadcast_if_bounded(n), F.col("c_nationkey") == F.col("n_nationkey")))
    return joined.select(
        F.concat(F.lit("SOL-"), k.cast("string")).alias("SolicitationNumber"),
        F.concat(F.col("c_mktsegment"), F.lit(" supplies for "), F.col("o_orderpriority")).alias("Title"),
        F.col("n_name").alias("Agency"),
        posted.alias("PostedDate"),
        F.date_add(day, (k % 45).cast("int")).cast("string").alias("ResponseDeadLine"),
        type_text.alias("Type"),
        set_aside.alias("TypeOfSetAsideDescription"),
        F.concat(F.lit("https://example.test/opp/"), k.cast("string")).alias("UiLink"),
        (F.lit(541510) + k % 6).cast("string").alias("NaicsCode"),
    )
