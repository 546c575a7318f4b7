"""A starter template from one sample: python -m foliant sample.txt --issuer ... --template-dir templates"""

from __future__ import annotations

import argparse
import sys
from pathlib import PurePath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import generate as G
from .sources.documents import Reader, join_pages, page_texts, read_files, read_texts
from .sources.templates import existing, write_templates


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description="Make a starter template from a sample invoice.")
    p.add_argument("sample", help="file of the sample: text, or a kind for which a reader is given")
    p.add_argument("--issuer", required=True, help="the supplier's name")
    for what in ("invoice-number", "date", "amount"):
        p.add_argument(f"--{what}-label", required=True, help=f"label of the {what.replace('-', ' ')} as printed")
    p.add_argument("--currency-label", default="", help="label of the currency, if it has one of its own")
    p.add_argument("--country-code", default="NL")
    p.add_argument("--currency-code", default="EUR")
    p.add_argument("--keyword", action="append", dest="keywords", default=[], help="a further keyword; may be repeated")
    p.add_argument("--template-dir", default="/app/templates", help="folder below which the template is written")
    p.add_argument("--output", help="file of the template, instead of the first free name of the supplier")
    return p


def main(given: list[str] | None = None, spark: SparkSession | None = None, reader: Reader | None = None) -> int:
    a = parser().parse_args(given)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    if PurePath(a.sample).suffix.lower() in ("", ".txt"):
        texts = read_texts(spark, a.sample)
    elif reader is not None:
        texts = join_pages(page_texts(read_files(spark, a.sample), reader))
    else:
        print(f"No reader for {a.sample}: give its text", file=sys.stderr)
        return 2
    sources = [r["text"] for r in texts.select("text").collect()]  # one sample
    spec = G.Spec(a.issuer, a.invoice_number_label, a.date_label, a.amount_label, a.country_code, a.currency_code, a.currency_label, tuple(a.keywords))
    made = G.generate(spark.createDataFrame([(0, sources)], "doc_id long, sources array<string>"), spec)
    if a.output:
        out = PurePath(a.output)
        folder, made = str(out.parent), made.withColumn("path", F.lit(out.name))
    else:
        folder, made = a.template_dir, G.numbered(made, "content", existing(spark, a.template_dir))
    path = made.first()["path"]
    write_templates(made, folder)
    print(f"Template written to: {folder}/{path}")
    if lacking := G.missing_labels(spec, sources):
        print(f"Labels not found in the text: {', '.join(lacking)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
