"""Contract-shaped test input derived from the TPC-H-like driver tables.

There is no contract register among the test inputs, so the register is
derived, by fixed rules, from orders / customer / lineitem / part /
supplier / nation / region. The same rules are written in SQL for the
DuckDB oracle (``oracle.py``); both give the same rows.

Every line of an order is a holder of its contract, every returned line an
amendment (in line order, not in date order), so "first holder" and "last
amendment" are the operators' work. Some dates are written with slashes or
not at all readable, and the group reference has blank, short, padded and
repeated ids.

Plan shape: lineitem is dealt by order, then gathered in a single grouped pass
(an order has a handful of lines, so gathering before the shuffle would sort
every task's rows and save nothing), then joined to orders on the key it is
already partitioned by. Customer is joined before, to orders without their
lines, part after. Nothing is broadcast by hint: Spark's size threshold
decides, with a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.sources.schemas import CONTRACT

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# CPV family per part type, procedure label per order priority.
CPV_FAMILY_BY_TYPE = [
    ("ECONOMY", "72"), ("SMALL", "48"), ("LARGE", "32"),
    ("MEDIUM", "30"), ("STANDARD", "64"), ("PROMO", "45"),
]
PROCEDURE_BY_PRIORITY = [
    ("1-URGENT", "Marché passé sans publicité ni mise en concurrence préalable"),
    ("2-HIGH", "Appel d'offres restreint"),
    ("3-MEDIUM", "Procédure adaptée"),
    ("5-LOW", "Appel d'offres ouvert"),
]
PROCEDURE_EVEN = "Procédure avec négociation"
PROCEDURE_ODD = "Dialogue compétitif"
DATE_SHIFT_MONTHS = 264
UNREADABLE_DATE = "à préciser"


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


class TableSet(dict):
    """Driver tables of one folder, each read (lazily) on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df


def _pad14(c):
    return F.lpad(c.cast("string"), 14, "0")


def _shift(ts):
    return F.add_months(ts, DATE_SHIFT_MONTHS).cast("string")


def _divisible(k, n: int):
    return (k % F.lit(n)) == 0


def order_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order: its lines and its returned lines, in line order."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                         (F.col("l_returnflag") == "R").alias("returned"), "l_shipdate", "l_extendedprice")
    returned = F.col("returned")
    return li.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("lines"),
        F.sort_array(F.collect_list(F.when(returned, F.struct("l_linenumber", "l_shipdate", "l_extendedprice")))).alias("amends"),
    ).withColumn("lead", F.get("lines", 0))


def raw_contracts(t: dict[str, DataFrame]) -> DataFrame:
    """The contract register, one row per contract, nested like the source."""
    customer = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    part = t["part"].select("p_partkey", "p_name", "p_type", "p_size")
    # Hash-partition orders on the order key: the per-order line aggregate is
    # partitioned the same way, so their join needs no further exchange, and
    # the per-row work after it runs in parallel whatever the file layout.
    orders = (t["orders"].select("o_orderkey", "o_custkey", "o_totalprice",
                                 "o_orderdate", "o_orderpriority")
              .join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
              .repartition("o_orderkey"))

    k = F.col("o_orderkey")
    # An order without lines has no part; its own key spreads what would meet under the null key.
    lead_part = F.col("lead.l_partkey")
    j = (orders
         .join(order_lines(t["lineitem"]), k == F.col("l_orderkey"), "left")
         .join(part, (F.coalesce(lead_part, k) == F.col("p_partkey")) & lead_part.isNotNull(), "left"))

    ptype = F.col("p_type")

    montant = (F.when(_divisible(k, 97), F.lit(1.0))
               .when(_divisible(k, 101), F.lit(6e8))
               .when(_divisible(k, 103), F.lit(None).cast("double"))
               .when(_divisible(k, 107), F.lit(2e10))
               .otherwise(F.col("o_totalprice")))
    duree = (k % 48).cast("double") + F.when(_divisible(k, 5), F.lit(0.5)).otherwise(F.lit(0.0))
    objet = F.when(F.col("p_name").isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Marché "), F.col("p_name"), F.lit(" "), F.col("c_mktsegment"),
                 F.when(_divisible(k, 19), F.lit(" 50%_net")).otherwise(F.lit(""))))
    family = None
    for ptype_value, fam in CPV_FAMILY_BY_TYPE:
        family = (F.when(ptype == ptype_value, F.lit(fam)) if family is None
                  else family.when(ptype == ptype_value, F.lit(fam)))
    cpv = F.concat(family, F.lpad((F.col("p_size") % 5).cast("string"), 6, "0"))
    proc = F.when(_divisible(k, 11), F.lit(None).cast("string"))
    for prio, label in PROCEDURE_BY_PRIORITY:
        proc = proc.when(F.col("o_orderpriority") == prio, F.lit(label))
    proc = proc.when(_divisible(k, 2), F.lit(PROCEDURE_EVEN)).otherwise(F.lit(PROCEDURE_ODD))
    day = _shift(F.col("o_orderdate"))
    date_notif = (F.when(_divisible(k, 109), F.lit(None).cast("string"))
                  .when(_divisible(k, 113), F.lit(UNREADABLE_DATE))
                  .when(_divisible(k, 23), F.replace(day, F.lit("-"), F.lit("/")))
                  .otherwise(day))
    cust = F.col("o_custkey")
    buyer_num = (F.when(_divisible(k, 17), F.lit(9000000) + F.year("o_orderdate"))
                 .when((k % 3) == 0, cust % 3)
                 .when((k % 3) == 1, F.lit(100) + cust % 60)
                 .otherwise(F.lit(1000) + cust))
    def holder(line):
        s = line.getField("l_suppkey")
        num = (F.when(line.getField("l_linenumber") != F.col("lead.l_linenumber"), s)
               .when((ptype == "PROMO") & ((s % 5) != 0), F.lit(1))
               .when((ptype == "STANDARD") & ((s % 5) < 3), F.lit(2))
               .when((ptype == "LARGE") & ((s % 10) < 2), F.lit(3))
               .when((ptype == "ECONOMY") & ~_divisible(k, 4), s % 9)
               .otherwise(s))
        return F.struct(F.struct(_pad14(num).alias("id")).alias("titulaire"))

    holders = F.transform("lines", holder)
    nat = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    place = (F.when(_divisible(k, 13), F.lit(None))
             .when((k % 4) == 0, F.struct(nat.alias("code"), F.lit("Code département").alias("typeCode")))
             .when((k % 4) == 1, F.struct(F.concat(nat, F.lit("000")).alias("code"),
                                          F.lit("Code postal").alias("typeCode")))
             .when((k % 4) == 2, F.struct(F.concat(nat, F.lit("000")).alias("code"),
                                          F.lit("Code commune").alias("typeCode")))
             .otherwise(F.struct(F.lit("FR").alias("code"), F.lit("Code pays").alias("typeCode"))))
    amendments = F.when(F.size("amends") > 0, F.transform("amends", lambda x: F.struct(
        _shift(x.getField("l_shipdate")).alias("date_modif"),
        (x.getField("l_extendedprice") * F.lit(6)).alias("montant"))))

    out = j.select(
        k.cast("string").alias("id"),
        montant.alias("montant"),
        duree.alias("dureeMois"),
        objet.alias("objet"),
        F.when(F.col("p_name").isNull(), F.lit(None).cast("string")).otherwise(cpv).alias("codeCPV"),
        proc.alias("procedure"),
        date_notif.alias("dateNotification"),
        F.struct(_pad14(buyer_num).alias("id")).alias("acheteur"),
        holders.alias("titulaires"),
        place.alias("lieuExecution"),
        amendments.alias("modifications"),
    )
    # Same column types as a register read with the declared schema. A type that differs in nullability alone is left
    # as it is: its cast would build every list anew.
    types = dict(out.dtypes)
    return out.select([F.col(f.name) if types[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in CONTRACT.fields])


def groups_reference(t: dict[str, DataFrame]) -> DataFrame:
    """Company -> group reference: every supplier whose key is not a multiple
    of 8, and for every seventh a second row whose id is blank, short or padded.

    Leaving one supplier in eight out of the reference is what makes some
    holders unmapped ('NON MAPPE'), as in a real register; it is part of the
    data, not a way to read less.
    """
    sk = F.col("s_suppkey")
    group = F.concat(F.lit("GROUP_"), (sk % 5).cast("string"))
    clean = (t["supplier"].filter((sk % 8) != 0)
             .select(_pad14(sk).alias("siret"), F.col("s_name").alias("nom_entreprise"),
                     F.when(_divisible(sk, 5), F.lit("INDEPENDANT")).otherwise(group).alias("groupe")))
    odd_id = (F.when((sk % 3) == 0, F.lit("  ")).when((sk % 3) == 1, sk.cast("string"))
              .otherwise(F.concat(F.lit(" "), _pad14(sk))))
    odd = t["supplier"].filter(_divisible(sk, 7)).select(
        odd_id.alias("siret"), F.concat("s_name", F.lit(" bis")).alias("nom_entreprise"), group.alias("groupe"))
    return clean.unionByName(odd)


def population_reference(t: dict[str, DataFrame]) -> DataFrame:
    """Department population table: one row per nation."""
    n = t["nation"]
    r = t["region"]
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("dept"),
                    F.col("n_name").alias("nom_dept"),
                    (F.lit(500000) + F.lit(10000) * F.col("n_nationkey")).cast("int").alias("population_2023"),
                    F.col("r_name").alias("region")))


def name_lookup(t: dict[str, DataFrame]) -> DataFrame:
    """Company id -> registered name, one row per supplier.

    Names carry group keywords by a fixed rule of the supplier key so the
    keyword mapping has something to find: a leading keyword, a trailing
    'EY' (which must not match 'EY '), or none.
    """
    sk = F.col("s_suppkey")
    nm = F.col("s_name")
    nom = (F.when(_divisible(sk, 6), F.concat(F.lit("SOPRA "), nm))
           .when((sk % 6) == 1, F.concat(nm, F.lit(" EY")))
           .when((sk % 6) == 2, F.concat(F.lit("ERNST "), nm))
           .when((sk % 6) == 3, F.concat(F.lit("OPEN "), nm))
           .when((sk % 6) == 4, F.concat(F.lit("CGI "), nm))
           .otherwise(nm))
    return t["supplier"].select(_pad14(sk).alias("siret"), nom.alias("nom"))
