"""Invoices as texts, made from the star schema, so that what is read from them can be held against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Template

DEMO = Template("Demo Leverancier B.V.", (r"Demo\s+Leverancier\s+B\.V\.", r"KvK\s+12345678"), {"invoice_number": r"Factuurnummer:\s*([A-Z0-9-]+)", "date": r"Factuurdatum:\s*([0-9]{2}-[0-9]{2}-[0-9]{4})", "amount": r"Totaal\s+incl\.\s+btw:\s*(?:EUR|€)?\s*([0-9\.,]+)", "currency_code": r"Totaal\s+incl\.\s+btw:\s*(EUR)"}, ("templates", "nl", "demo", "template.yml"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dutch(amount: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def written_amount(amount: Column, kind: Column) -> Column:
    """An amount in one of six ways; the last two are none."""
    plain = F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))
    return (
        F.when(kind == 0, dutch(amount)).when(kind == 1, F.format_number(amount, 2)).when(kind == 2, F.replace(plain, F.lit("."), F.lit(",")))
        .when(kind == 3, F.concat(F.lit("EUR "), dutch(amount))).when(kind == 4, F.concat(F.lit("€ "), plain)).otherwise(F.lit("n.v.t."))
    )


def day(c: Column, form: str = "dd-MM-yyyy") -> Column:
    return F.date_format(c, form)


def number(c: Column) -> Column:
    return F.concat(F.lit("ORD-"), c.cast("string"))


def invoices(orders: DataFrame, issuer: Column | None = None, block: Column | None = None, drop: Column | None = None) -> DataFrame:
    """doc_id, text of each order. drop: an array of the lines that are left out (number, date, total)."""
    gone = lambda name: F.array_contains(drop, name) if drop is not None else F.lit(False)
    lines = F.array(
        F.coalesce(issuer, F.lit("Demo Leverancier B.V.")) if issuer is not None else F.lit("Demo Leverancier B.V."), F.lit("KvK 12345678"),
        F.when(~gone("number"), F.concat(F.lit("Factuurnummer: "), number(F.col("o_orderkey")))), F.when(~gone("date"), F.concat(F.lit("Factuurdatum: "), day(F.col("o_orderdate")))),
        block if block is not None else F.lit(None).cast("string"), F.when(~gone("total"), F.concat(F.lit("Totaal incl. btw: EUR "), dutch(F.col("o_totalprice")))),
    )
    return orders.withColumn("doc_id", F.col("o_orderkey")).withColumn("text", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))


def first_supplier(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """l_orderkey, s_name: each order's supplier of the smallest key."""
    least = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    return least.join(supplier.select("s_suppkey", "s_name"), "s_suppkey").select("l_orderkey", "s_name")


def item_lines(lineitem: DataFrame) -> DataFrame:
    """l_orderkey, rows: each order's items as cells, in order."""
    row = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("Artikel "), F.col("l_partkey").cast("string")).alias("d"), F.col("l_quantity").cast("int").cast("string").alias("q"), dutch(F.col("l_extendedprice")).alias("a"))
    return lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def block_rows(rows: Column) -> Column:
    """A table of lines, two spaces and more between cells, with a line after it that ends it."""
    return F.concat(F.lit("Omschrijving   Aantal   Prijs\n"), F.array_join(F.transform(rows, lambda r: F.concat_ws("   ", r["d"], r["q"], r["a"])), "\n"), F.lit("\nTotaal"))


def _column(rows: Column, name: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: r[name]), "\n")


def block_headed(rows: Column) -> Column:
    """A paragraph for each column, its name on top."""
    return F.concat(F.lit("\nOmschrijving\n"), _column(rows, "d"), F.lit("\n\nAantal\n"), _column(rows, "q"), F.lit("\n\nPrijs\n"), _column(rows, "a"), F.lit("\n"))


def block_names_first(rows: Column) -> Column:
    """The names, a paragraph each, then a paragraph of values for each."""
    return F.concat(F.lit("\nOmschrijving\n\nAantal\n\nPrijs\n\n"), _column(rows, "d"), F.lit("\n\n"), _column(rows, "q"), F.lit("\n\n"), _column(rows, "a"), F.lit("\n"))
