"""The engine's queries over rendered invoices and over the text tables, each with SQL that works the result out from
the base tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import catalogue as C
from ..functions import infer as I
from ..functions import normalize as N
from ..functions.regexes import lines, squeeze, strip
from ..operators import generate as G
from ..operators import match as match_
from ..operators import model as M
from ..operators.engine import Engine, Options
from ..operators.line_items import item_rows, with_line_items
from ..operators.match import Template, match
from ..operators.respond import merge_missing, missing_required, respond
from ..sources.documents import join_pages
from . import rendering as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return put


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "orders")


def _invoices(spark: SparkSession, sf: str) -> DataFrame:
    return R.invoices(_orders(spark, sf).select("o_orderkey", "o_orderdate", "o_totalprice")).select("doc_id", "text")


def _field(name: str):
    return F.col("fields")[name]["value"]


def _flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", *more, "status", _field("invoice_number").alias("invoice_number"), _field("invoice_date").alias("invoice_date"), "total_amount", _field("currency_code").alias("currency_code"))


@query("""SELECT o_orderkey AS doc_id, 'success' AS status, 'ORD-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%d-%m-%Y') AS invoice_date, o_totalprice AS total_amount, 'EUR' AS currency_code FROM orders""")
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Match, repair and respond over every order's invoice."""
    return _flat(respond(match(_invoices(spark, sf), [R.DEMO])))


def _supplier_templates() -> list[Template]:
    """Three that fit: by number alone, whole, and a copy of the whole one later in path order."""
    whole = dict(R.DEMO.fields)
    return [
        Template(None, (r"Supplier#\d+",), {"invoice_number": whole["invoice_number"], "date": whole["date"]}, ("t", "a-part", "template.yml")),
        Template(None, (r"Supplier#\d+", "KvK"), whole | {"issuer": r"^(Supplier#\d+)$"}, ("t", "b-whole", "template.yml")),
        Template(None, (r"Supplier#\d+", "KvK"), whole | {"issuer": r"^(Supplier#\d+)$"}, ("t", "c-copy", "template.yml")),
        Template("Other", ("no such keyword",), whole, ("t", "0-other", "template.yml")),
    ]


@query("""SELECT o_orderkey AS doc_id, 't__b-whole__template.yml' AS template_id, s_name AS issuer, o_totalprice AS total_amount
FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = k""")
def match_best_template(spark: SparkSession, sf: str) -> DataFrame:
    """The best of several templates that fit, by score, then by path."""
    names = R.first_supplier(R.table(spark, sf, "lineitem"), R.table(spark, sf, "supplier"))
    docs = R.invoices(_orders(spark, sf).join(names, F.col("o_orderkey") == F.col("l_orderkey")), F.col("s_name")).select("doc_id", "text")
    out = respond(match(docs, _supplier_templates()))
    return out.select("doc_id", "template_id", F.col("unmapped_fields")["issuer"]["value"].alias("issuer"), "total_amount")


_SHOWN = ("alpha one", "beta two", "gamma three")


@query("""SELECT o_orderkey AS doc_id, CAST(o_orderkey % 4 AS INTEGER) AS hits, o_orderkey % 4 >= 2 AS passes FROM orders""")
def keyword_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Half of a template's keywords, rounded up."""
    k = F.col("o_orderkey") % 4
    text = F.concat_ws("\n", *[F.when(k > n, F.lit(w.upper())) for n, w in enumerate(_SHOWN)])
    docs = _orders(spark, sf).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", match_.keyword_hits(F.col("text"), _SHOWN).alias("hits"), match_.gate(F.col("text"), _SHOWN).alias("passes"))


def _dropped():
    p = F.substring("o_orderpriority", 1, 1)
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    return F.when(p == "1", names("number")).when(p == "2", names("date", "total")).when(p == "3", names("number", "date", "total")).otherwise(F.array().cast("array<string>"))


def _dropped_docs(spark: SparkSession, sf: str) -> DataFrame:
    return R.invoices(_orders(spark, sf), drop=_dropped()).select("doc_id", "text")


@query("""SELECT o_orderkey AS doc_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'partial' WHEN '2' THEN 'partial' WHEN '3' THEN 'failed' ELSE 'success' END AS status,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 1 WHEN '3' THEN 0 ELSE 4 END AS n_fields FROM orders""")
def status_classify(spark: SparkSession, sf: str) -> DataFrame:
    """success, partial or failed, by what an invoice lacks."""
    return respond(match(_dropped_docs(spark, sf), [R.DEMO])).select("doc_id", "status", F.size("fields").alias("n_fields"))


@query("""SELECT o_orderkey AS doc_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'invoice_number' WHEN '2' THEN 'invoice_date,total_amount,currency_code'
WHEN '3' THEN 'invoice_number,invoice_date,total_amount,currency_code' ELSE '' END AS missing FROM orders""")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Required names that a response lacks, in the order asked."""
    need = F.array(*[F.lit(r) for r in C.REQUIRED])
    return respond(match(_dropped_docs(spark, sf), [R.DEMO])).select("doc_id", F.array_join(missing_required(F.col("fields"), need), ",").alias("missing"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_totalprice END AS amount FROM orders""")
def normalize_amount(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts written in six ways."""
    written = R.written_amount(F.col("o_totalprice"), F.col("o_orderkey") % 6)
    return _orders(spark, sf).select(F.col("o_orderkey").alias("doc_id"), N.amount(written).alias("amount"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN NULL ELSE NULL END AS currency,
CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'INV/' || o_orderkey END AS invoice_number FROM orders""")
def normalize_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Currencies and invoice numbers as printed."""
    k = F.col("o_orderkey")
    money = F.element_at(F.array(F.lit(" € "), F.lit("usd"), F.lit("Euros"), F.lit("dollar"), F.lit("  ")), (k % 5 + 1).cast("int"))
    given = F.when(k % 3 == 0, F.concat(F.lit("# INV / "), k.cast("string"), F.lit(" :"))).when(k % 3 == 1, F.concat(F.lit("INV/"), k.cast("string"))).otherwise(F.lit("Factuurnummer"))
    return _orders(spark, sf).select(k.alias("doc_id"), N.currency(money).alias("currency"), N.invoice_number(given).alias("invoice_number"))


@query("""SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%d.%m.%Y') AS invoice_date, 'A-' || o_orderkey AS invoice_number FROM orders""")
def infer_header_row(spark: SparkSession, sf: str) -> DataFrame:
    """A date below its label, and a number beside a date and a time."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat(F.lit("Klant   Factuurdatum   Pagina\n4711   "), R.day(d, "dd.MM.yyyy"), F.lit("   1\n"), R.day(d, "dd-MM-yyyy"), F.lit(" 12:30 A-"), k.cast("string"), F.lit("\n"))
    docs = _orders(spark, sf).select(k.alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", I.infer_date(F.col("text")).alias("invoice_date"), I.infer_number(F.col("text")).alias("invoice_number"))


@query("""SELECT o_orderkey AS doc_id, o_totalprice AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM orders""")
def infer_total(spark: SparkSession, sf: str) -> DataFrame:
    """A total some way from its label, and the currency of the text."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Totaal bedrag binnen 14 dagen op onze rekening\nte voldoen "), R.dutch(F.col("o_totalprice")), F.when(k % 2 == 0, F.lit(" €")).otherwise(F.lit(" in USD")), F.lit("\n"))
    docs = _orders(spark, sf).select(k.alias("doc_id"), text.alias("text"))
    return docs.select("doc_id", N.amount(I.infer_amount(F.col("text"))).alias("amount"), I.infer_currency(F.col("text")).alias("currency"))


@query("""SELECT o_orderkey AS doc_id, 'success' AS status, 'ORD-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%d-%m-%Y') AS invoice_date, o_totalprice AS total_amount, 'EUR' AS currency_code FROM orders""")
def repair_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A template that captures labels instead of values, repaired from the text."""
    wrong = Template("unknown", ("KvK",), {"invoice_number": "(Factuurnummer)", "amount": "(Totaal)", "currency_code": "(incl)\\."}, ("t", "template.yml"))
    return _flat(respond(match(_invoices(spark, sf), [wrong])))


_ISSUER_SCORE = r"""
CASE WHEN length(x) < 4 OR length(x) > 60 OR contains(lower(x), 'factuur') OR contains(lower(x), 'invoice') OR contains(lower(x), 'btw') OR contains(lower(x), 'kvk') OR contains(lower(x), 'iban') OR contains(x, '@') OR contains(lower(x), 'www.') OR contains(lower(x), 'http') THEN -10
ELSE greatest(0, 13 - i) + CASE WHEN regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(b\.?v\.?|vof|shop|company|holding|services?)($|[^\p{L}\p{N}_])') THEN 10 ELSE 0 END
+ CASE WHEN regexp_matches(x, '[0-9]') THEN 0 ELSE 3 END + CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 5 THEN 2 ELSE 0 END END"""


@query(f"""WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p)) AS x FROM (SELECT doc_id, string_split(text, chr(10))[1:20] AS p FROM documents)),
s AS (SELECT doc_id, i, x, {_ISSUER_SCORE} AS score FROM l WHERE x <> '')
SELECT doc_id, max(score) AS score, arg_max(x, score * 100 - i) AS issuer FROM s WHERE score >= 0 GROUP BY doc_id""")
def issuer_score(spark: SparkSession, sf: str) -> DataFrame:
    """The line that names a document's issuer best."""
    best = R.table(spark, sf, "documents").select("doc_id", I.best_line(F.col("text")).alias("b"))
    return best.filter("b is not null").select("doc_id", "b.score", F.col("b.line").alias("issuer"))


def _with_items(spark: SparkSession, sf: str, block) -> DataFrame:
    rows = R.item_lines(R.table(spark, sf, "lineitem"))
    docs = R.invoices(_orders(spark, sf).join(rows, F.col("o_orderkey") == F.col("l_orderkey")), block=block(F.col("rows")))
    found = with_line_items(docs.select("doc_id", "text"))
    cell = lambda name: F.col("item")[name].alias(name)
    return item_rows(found, "doc_id").select("doc_id", cell("omschrijving"), cell("aantal"), cell("prijs"))


_ITEMS = """SELECT l_orderkey AS doc_id, 'Artikel ' || l_partkey AS omschrijving, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS aantal,
translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS prijs FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


@query(_ITEMS)
def line_items_inline(spark: SparkSession, sf: str) -> DataFrame:
    """Items from lines under a header."""
    return _with_items(spark, sf, R.block_rows)


@query(_ITEMS)
def line_items_columnar(spark: SparkSession, sf: str) -> DataFrame:
    """Items from a paragraph for each column."""
    return _with_items(spark, sf, R.block_headed)


@query(_ITEMS)
def line_items_names_first(spark: SparkSession, sf: str) -> DataFrame:
    """Items from names first, then values."""
    return _with_items(spark, sf, R.block_names_first)


@query(r"""SELECT doc_id, CAST(list_sum(list_transform(['factuurnummer','invoice number','factuurdatum','invoice date','factuurbedrag','invoice total','totaal netto','factuur','pagina','betaald','btw'], lambda m: CASE WHEN contains(lower(text), m) THEN 1 ELSE 0 END)) AS INTEGER) AS headers,
CAST(len(regexp_extract_all(text, '[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}')) + len(regexp_extract_all(text, '[0-9]{1,3}([.,][0-9]{3})*[.,][0-9]{2}|[0-9]+[.,][0-9]{2}')) + len(regexp_extract_all(text, '(?i)EUR|€')) AS INTEGER) AS n_values,
CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS INTEGER) AS length FROM documents""")
def text_source_rank(spark: SparkSession, sf: str) -> DataFrame:
    """How much of an invoice a text shows."""
    s = R.table(spark, sf, "documents").select("doc_id", I.source_score(F.col("text")).alias("s"))
    return s.select("doc_id", "s.headers", F.col("s.values").alias("n_values"), "s.length")


_VALUE_LINE = r"""(regexp_matches(x, '[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}') OR regexp_matches(x, '[0-9][.,][0-9]{2}') OR (len(regexp_extract_all(x, '[0-9]+')) >= 3 AND NOT regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(b\.?v\.?|vof|shop|company|holding|services?)($|[^\p{L}\p{N}_])'))
OR ((contains(lower(x), 'betaling') OR contains(lower(x), 'bestelnummer') OR contains(lower(x), 'leveringsnummer')) AND regexp_matches(x, '[0-9]')))"""


@query(f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents),
v AS (SELECT doc_id, x, {_VALUE_LINE} AS is_value FROM l WHERE x <> '')
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN is_value THEN 1 ELSE 0 END) AS BIGINT) AS value_lines,
CAST(sum(CASE WHEN length(x) BETWEEN 3 AND 60 AND NOT (contains(lower(x), 'adres') OR contains(lower(x), 'factuur') OR contains(lower(x), 'btw') OR contains(lower(x), 'kvk') OR contains(lower(x), 'iban') OR contains(lower(x), 'omschrijving') OR contains(x, '@') OR contains(lower(x), 'www.')) AND NOT is_value AND regexp_matches(x, '[A-Za-z]') THEN 1 ELSE 0 END) AS BIGINT) AS company_lines
FROM v GROUP BY doc_id""")
def classify_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold values, and lines that may name a company."""
    every = R.table(spark, sf, "documents").select("doc_id", F.explode(F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")).alias("x"))
    count = lambda c: F.sum(c.cast("long"))
    return every.groupBy("doc_id").agg(F.count("*").alias("n_lines"), count(I.is_value_line(F.col("x"))).alias("value_lines"), count(I.is_company_name(F.col("x"))).alias("company_lines"))


@query(r"""SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 5 END AS score,
CASE s_suppkey % 5 WHEN 0 THEN '(?i)shop' || s_suppkey || '\.example\.nl' WHEN 1 THEN '(?i)mail' || s_suppkey || '\.example\.com' WHEN 2 THEN '(?i)NL' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || 'B01'
WHEN 3 THEN '(?i)KvK\s*(?:nr)?[:.]?\s*' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') ELSE '(?i)Bakker\s+en\s+Zoon\s+B\.V\.' END AS pattern FROM supplier""")
def keyword_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What a line offers to know its supplier by."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("Web: https://www.Shop"), s, F.lit(".example.nl"))).when(k % 5 == 1, F.concat(F.lit("info@Mail"), s, F.lit(".example.com")))
        .when(k % 5 == 2, F.concat(F.lit("btw nl"), F.lpad(s, 9, "0"), F.lit("b01"))).when(k % 5 == 3, F.concat(F.lit("KvK nr "), F.lpad(s, 8, "0"))).otherwise(F.lit("Bakker en Zoon B.V."))
    )
    return R.table(spark, sf, "supplier").select(k.alias("doc_id"), I.keyword_candidate(line).alias("c")).select("doc_id", "c.score", "c.pattern")


@query(r"""SELECT page_id, lower(regexp_extract(url, '(?i)(?:https?://)?(?:www\.)?([A-Z0-9.-]+\.[A-Z]{2,})', 1)) AS domain FROM pages""")
def domain_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The host of a line of text."""
    return R.table(spark, sf, "pages").select("page_id", N.domain(F.col("url")).alias("domain"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.78 ELSE greatest(0.0, least(1.0, value / 100)) END AS confidence FROM events""")
def confidence_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Confidences within 0 and 1, the default where there is no number."""
    given = F.when(F.col("event_id") % 7 == 0, F.lit("high")).otherwise((F.col("value") / 100).cast("string"))
    return R.table(spark, sf, "events").select("event_id", N.confidence(given, F.lit(0.78)).alias("confidence"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def model_json(spark: SparkSession, sf: str) -> DataFrame:
    """Objects within a model's answers: bare, fenced, and within prose."""
    i, p = F.col("event_id") % 3, F.col("props")
    said = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("Here {you are}: "), p, F.lit(" {and} so on")))
    return R.table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json(M.object_in(said)), "$.k", "long").alias("k"))


@query("""SELECT o_orderkey AS doc_id, 'ORD-' || o_orderkey AS invoice_number, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS total_amount, CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.95 END AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Shop' END AS issuer FROM orders""")
def model_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """A model's fields, nested with confidences or flat without."""
    k = F.col("o_orderkey")
    number = R.number(k)
    nested = F.to_json(F.struct(F.when(k % 5 == 0, F.lit("  ")).otherwise(F.lit("Shop")).alias("issuer"), F.struct(F.struct(number.alias("value"), F.lit(0.9).alias("confidence")).alias("invoice_number"), F.col("o_totalprice").alias("amount")).alias("fields")))
    flat = F.to_json(F.struct(F.when(k % 5 == 0, F.lit("  ")).otherwise(F.lit("Shop")).alias("issuer"), number.alias("invoice_number")))
    got = _orders(spark, sf).select(k.alias("doc_id"), M.extraction_of(F.when(k % 2 == 0, nested).otherwise(flat)).alias("x"))
    return got.select("doc_id", F.col("x.fields")["invoice_number"].alias("invoice_number"), N.amount(F.col("x.fields")["amount"]).alias("total_amount"), F.col("x.confidence")["invoice_number"].alias("confidence"), "x.issuer")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'partial' ELSE 'success' END AS status,
CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'M-' || o_orderkey ELSE 'ORD-' || o_orderkey END AS invoice_number, CASE WHEN substr(o_orderpriority, 1, 1) = '2' THEN NULL ELSE strftime(o_orderdate, '%d-%m-%Y') END AS invoice_date,
CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'model' END AS fallback_reader FROM orders WHERE substr(o_orderpriority, 1, 1) <> '3'""")
def merge_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Local fields first, a model's for what is required and missing."""
    p = F.substring("o_orderpriority", 1, 1)
    orders = _orders(spark, sf).filter(p != "3")
    local = respond(match(R.invoices(orders, drop=_dropped()).select("doc_id", "text"), [R.DEMO]))
    payload = F.create_map(F.lit("invoice_number"), F.concat(F.lit("M-"), F.col("o_orderkey").cast("string")))
    theirs = respond(orders.filter(p == "1").select(F.col("o_orderkey").alias("doc_id"), payload.alias("payload")), reader="model")
    out = merge_missing(local, theirs)
    return out.select("doc_id", "status", _field("invoice_number").alias("invoice_number"), _field("invoice_date").alias("invoice_date"), F.col("unmapped_fields")["fallback_source_reader"]["value"].alias("fallback_reader"))


@query("""SELECT conv_id AS doc_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def page_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to one text."""
    turns = R.table(spark, sf, "conversations").withColumn("text", F.col("text"))
    return join_pages(turns, "conv_id", "turn").withColumnRenamed("conv_id", "doc_id")


@query(r"""SELECT doc_id, CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'supplier' ELSE trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') END AS slug,
trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, '''' || replace(text, '''', '''''') || '''' AS quoted,
CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 1200 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1200) || '...' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS preview FROM documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs, squeezed texts, quoted texts and previews, of whole texts."""
    t = F.col("text")
    return R.table(spark, sf, "documents").select("doc_id", N.slug(t).alias("slug"), squeeze(t).alias("squeezed"), N.yaml_quote(t).alias("quoted"), N.preview(F.array(t)).alias("preview"))


@query(r"""WITH n AS (SELECT doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS k FROM n WHERE t <> '')
SELECT doc_id, length(t) AS length FROM r WHERE k = 1""")
def dedupe_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Of texts that are equal but for white space, the first."""
    n = R.table(spark, sf, "documents").select("doc_id", squeeze(F.col("text")).alias("t")).filter("t <> ''")
    return n.groupBy("t").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.length("t").alias("length"))


def _preview(number: str, day: str, total: str) -> str:
    return f"""SELECT o_orderkey AS doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS row_no, unnest(['Issuer', 'Invoice Number', 'Invoice Date', 'Total Amount', 'Currency', 'Line Items', 'Issues']) AS label,
unnest(['Demo Leverancier B.V.', {number}, {day}, {total}, 'EUR', '0', 'line item table not reconstructed']) AS value, unnest(['ok', 'ok', 'ok', 'ok', 'ok', 'warning', 'warning']) AS status FROM orders"""


@query(_preview("'ORD-' || o_orderkey", "strftime(o_orderdate, '%d-%m-%Y')", "printf('%.2f', o_totalprice)"))
def document_preview(spark: SparkSession, sf: str) -> DataFrame:
    """A starter template made from each invoice, and what it reads from it."""
    docs = _invoices(spark, sf).select("doc_id", F.array("text").alias("sources"))
    return G.preview(docs, G.Spec("Demo Leverancier B.V.", "Factuurnummer", "Factuurdatum", "Totaal incl. btw"))


@query("""SELECT o_orderkey AS doc_id, 'nl/demo_leverancier_b_v/template.yml' AS path, true AS reads_all FROM orders""")
def generate_template(spark: SparkSession, sf: str) -> DataFrame:
    """A starter template from each invoice, with no label given."""
    docs = _invoices(spark, sf).select("doc_id", F.array("text").alias("sources"))
    made = G.generate(docs, G.Spec())
    reads = F.forall(F.array(*[F.lit(r) for r in C.REQUIRED]), lambda r: F.map_contains_key("fields", r))
    return made.select("doc_id", "path", reads.alias("reads_all"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    names = R.first_supplier(R.table(spark, sf, "lineitem"), R.table(spark, sf, "supplier"))
    orders = _orders(spark, sf).join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = R.invoices(orders, F.col("s_name"), drop=_dropped()).select("doc_id", "text", "o_custkey", "s_name")
    whole = Template(None, ("KvK",), dict(R.DEMO.fields) | {"issuer": r"^(Supplier#\d+|Demo Leverancier B\.V\.)$"}, ("t", "template.yml"))
    return respond(match(docs, [whole])).withColumn("issuer", F.col("payload")["issuer"])


_STATUS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'partial' WHEN '2' THEN 'partial' WHEN '3' THEN 'failed' ELSE 'success' END"
_TOTAL = "CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN NULL ELSE o_totalprice END"


@query(f"""SELECT coalesce(status, 'all') AS status, coalesce(CAST(y AS VARCHAR), 'all') AS missing_date, count(*) AS n, CAST(round(coalesce(sum(t), 0), 2) AS DECIMAL(20, 2)) AS total FROM (SELECT {_STATUS} AS status, {_TOTAL} AS t, CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN 'yes' ELSE 'no' END AS y FROM orders) GROUP BY ROLLUP (status, y)""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and totals by status, with subtotals."""
    r = respond(match(_dropped_docs(spark, sf), [R.DEMO])).select("status", F.when(_field("invoice_date").isNull(), F.lit("yes")).otherwise(F.lit("no")).alias("missing_date"), "total_amount")
    out = r.rollup("status", "missing_date").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("total_amount"), F.lit(0.0)), 2).cast("decimal(20,2)").alias("total"))
    return out.select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("missing_date", F.lit("all")).alias("missing_date"), "n", "total")


@query("""SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(20, 2)) AS spend FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def spend_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted totals by the customer's nation."""
    docs = R.invoices(_orders(spark, sf)).select("doc_id", "text", "o_custkey")
    got = respond(match(docs, [R.DEMO])).select("o_custkey", "total_amount")
    who = R.table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(R.table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return got.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("total_amount"), 2).cast("decimal(20,2)").alias("spend"))


@query("""WITH s AS (SELECT n_name, s_name, CAST(round(sum(o_totalprice), 2) AS DECIMAL(20, 2)) AS amount FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)
SELECT n_name, s_name, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY amount DESC, s_name) AS rank FROM s) WHERE rank <= 3""")
def top_suppliers_per_nation(spark: SparkSession, sf: str) -> DataFrame:
    """The three suppliers of each nation that invoiced most."""
    names = R.first_supplier(R.table(spark, sf, "lineitem"), R.table(spark, sf, "supplier"))
    docs = R.invoices(_orders(spark, sf).join(names, F.col("o_orderkey") == F.col("l_orderkey")), F.col("s_name")).select("doc_id", "text")
    got = respond(match(docs, _supplier_templates())).select(F.col("payload")["issuer"].alias("s_name"), "total_amount")
    sums = got.groupBy("s_name").agg(F.round(F.sum("total_amount"), 2).cast("decimal(20,2)").alias("amount"))
    where = R.table(spark, sf, "supplier").select("s_name", "s_nationkey").join(R.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("amount"), "s_name")
    return sums.join(where, "s_name").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("n_name", "s_name", "amount", "rank")


@query("""SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def orders_without_items(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices from which no item can be read."""
    rows = R.item_lines(R.table(spark, sf, "lineitem"))
    orders = _orders(spark, sf).join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = R.invoices(orders, block=F.when(F.col("rows").isNotNull(), R.block_rows(F.col("rows"))))
    return with_line_items(docs.select("doc_id", "text")).filter(F.size("line_items") == 0).select("doc_id")


@query("""SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies, copy FROM (SELECT o_orderkey, 0 AS copy FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 10 = 0)""")
def duplicate_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices of one issuer that share a number."""
    docs = _invoices(spark, sf).withColumn("copy", F.lit(0))
    every = docs.unionByName(docs.filter("doc_id % 10 = 0").withColumn("copy", F.lit(1)))
    got = respond(match(every, [R.DEMO])).select("doc_id", "copy", F.col("payload")["issuer"].alias("issuer"), _field("invoice_number").alias("n"))
    return got.select("doc_id", F.count("*").over(Window.partitionBy("issuer", "n")).alias("copies"), "copy")


class _Known:
    """A model that reads what the rendering wrote; for queries and tests."""

    provider_name = "known"

    def is_configured(self) -> bool:
        return True

    def extract_fields(self, content, required, session=None):
        key = content.decode()
        return {"fields": {"invoice_number": f"M-{key}", "date": "01-01-2000", "amount": "1,00", "currency_code": "EUR"}, "confidence": {"amount": 0.5}, "issuer": "Known", "model": "known-1"}

    def generate_template(self, content, required, context=None, session=None):
        fields = dict(R.DEMO.fields) if context else {"invoice_number": "x"}
        return {"issuer": "Supplier", "keywords": ["KvK 12345678"], "fields": fields}


@query(f"""SELECT o_orderkey AS doc_id, 'success' AS status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'merged' WHEN '2' THEN 'merged' WHEN '3' THEN 'model' ELSE 'local' END AS route,
CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 'M-' || o_orderkey ELSE 'ORD-' || o_orderkey END AS invoice_number, CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN '01-01-2000' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS invoice_date FROM orders""")
def engine_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The whole engine: templates, then a model for what they leave open."""
    docs = R.invoices(_orders(spark, sf), drop=_dropped()).select("doc_id", "text", F.col("doc_id").cast("string").cast("binary").alias("content"))
    out = Engine([R.DEMO], _Known(), Options(use_model=True)).extract(docs)
    return out.select("doc_id", "status", "route", _field("invoice_number").alias("invoice_number"), _field("invoice_date").alias("invoice_date"))


@query(f"""SELECT o_orderkey AS doc_id, 'success' AS status, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'model' ELSE 'healed' END AS route,
CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'M-' ELSE 'ORD-' END || o_orderkey AS invoice_number, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1.0 ELSE o_totalprice END AS total_amount FROM orders""")
def engine_heal(spark: SparkSession, sf: str) -> DataFrame:
    """No template to begin with: one is made for each document, on the second request, and reads those that have all
    that is required; the model's own response stands for the others."""
    docs = R.invoices(_orders(spark, sf), drop=_dropped()).select("doc_id", "text", F.col("doc_id").cast("string").cast("binary").alias("content"))
    out = Engine([], _Known(), Options(use_model=True, heal=True)).extract(docs)
    return out.select("doc_id", "status", "route", _field("invoice_number").alias("invoice_number"), _field("total_amount").cast("double").alias("total_amount"))


@query("""SELECT s_suppkey AS doc_id, CASE WHEN k = 0 THEN 'nl/supplier_' || n || '/template.yml' ELSE 'nl/supplier_' || n || '/template_' || k || '.yml' END AS path
FROM (SELECT s_suppkey, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 + CASE WHEN s_nationkey = 3 THEN 5 ELSE 0 END AS k FROM supplier)""")
def template_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Names of new templates: numbered within their supplier's folder, behind what is there."""
    folder = F.concat(F.lit("nl/"), N.slug(F.concat(F.lit("Supplier "), F.col("s_nationkey").cast("string"))))
    made = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(folder, F.lit("/template.yml")).alias("path"))
    return G.numbered(made, "doc_id", ["nl/supplier_3/template.yml", "nl/supplier_3/template_4.yml", "nl/supplier_3/template_ai_9.yml", "nl/other/template.yml"])


@query("""SELECT o_orderkey AS doc_id, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'second' ELSE 'first' END AS reader, 'success' AS status FROM orders""")
def best_reader(spark: SparkSession, sf: str) -> DataFrame:
    """Of two readers' texts the one that gives more; of equals the earlier."""
    orders = _orders(spark, sf)
    first = R.invoices(orders, drop=_dropped()).select("doc_id", "text", F.lit("first").alias("reader"), F.lit(0).alias("reader_rank"))
    second = R.invoices(orders).select("doc_id", "text", F.lit("second").alias("reader"), F.lit(1).alias("reader_rank"))
    return Engine([R.DEMO]).best_of_readers(first.unionByName(second)).select("doc_id", "reader", "status")


@query("""SELECT o_orderkey AS doc_id, 'a' || (o_orderkey % 3) || '|b' || CASE WHEN o_orderkey % 2 = 0 THEN '|c d' ELSE '' END AS names, 'x+|y' AS patterns,
CASE WHEN o_orderkey % 2 = 0 THEN 'nld+eng' ELSE 'eng' END AS language FROM orders""")
def request_options(spark: SparkSession, sf: str) -> DataFrame:
    """Required names from a list as typed, patterns each once, and the language that a country is read in."""
    k = F.col("o_orderkey")
    a = F.concat(F.lit("a"), (k % 3).cast("string"))
    typed = F.concat(F.lit(" "), a, F.lit(" , b ,,"), a, F.when(k % 2 == 0, F.lit(",\tc d ")).otherwise(F.lit(", ")))
    patterns = F.array(F.lit("x+"), F.lit(None), F.lit(""), F.lit("y"), F.lit("x+"))
    return _orders(spark, sf).select(k.alias("doc_id"), F.array_join(N.required_fields(typed), "|").alias("names"), F.array_join(N.distinct_patterns(patterns), "|").alias("patterns"), N.ocr_language(F.when(k % 2 == 0, F.lit("nl")).otherwise(F.lit("BE"))).alias("language"))


@query("""SELECT o_orderkey AS doc_id, 'INV' || o_orderkey AS number, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_totalprice END AS amount, 'EUR' AS currency, strftime(o_orderdate, '%d%m%Y') AS day FROM orders""")
def comparable_values(spark: SparkSession, sf: str) -> DataFrame:
    """Fields as they are compared when a template is held against what is expected of it."""
    k = F.col("o_orderkey")
    total = N.comparable("amount", R.written_amount(F.col("o_totalprice"), k % 6)).cast("double")
    return _orders(spark, sf).select(k.alias("doc_id"), N.comparable("invoice_number", F.concat(F.lit(": INV "), k.cast("string"))).alias("number"), total.alias("amount"), N.comparable("currency_code", F.lit(" euro ")).alias("currency"), N.comparable("date", R.day(F.col("o_orderdate"), "dd/MM/yyyy")).alias("day"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'too many ' || event_id WHEN 1 THEN 'plain ' || event_id WHEN 2 THEN 'bad ' || event_id ELSE left('no json ' || event_id || ' ' || repeat('x', 600), 500) END AS error FROM events""")
def model_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What a model's refusal says, in one line."""
    i, k = F.col("event_id") % 4, F.col("event_id").cast("string")
    body = (
        F.when(i == 0, F.concat(F.lit('{"error":{"message":" too\\n many '), k, F.lit('"}}'))).when(i == 1, F.concat(F.lit('{"message":"plain  '), k, F.lit('"}')))
        .when(i == 2, F.concat(F.lit('{"error":"bad '), k, F.lit('"}'))).otherwise(F.concat(F.lit("no json\n"), k, F.lit(" "), F.repeat(F.lit("x"), 600)))
    )
    return R.table(spark, sf, "events").select("event_id", M.error_text(body).alias("error"))


_COMPANY_LINE = f"""(length(x) BETWEEN 3 AND 60 AND NOT (contains(lower(x), 'adres') OR contains(lower(x), 'factuur') OR contains(lower(x), 'btw') OR contains(lower(x), 'kvk') OR contains(lower(x), 'iban') OR contains(lower(x), 'omschrijving') OR contains(x, '@') OR contains(lower(x), 'www.')) AND NOT {_VALUE_LINE} AND regexp_matches(x, '[A-Za-z]'))"""


@query(rf"""WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, trim(unnest(p)) AS x FROM (SELECT doc_id, string_split(text, chr(10))[1:25] AS p FROM documents)),
s AS (SELECT doc_id, i, x, CASE WHEN length(x) < 4 OR contains(lower(x), 'factuur') OR contains(lower(x), 'btw') OR contains(lower(x), 'kvk') OR contains(lower(x), 'iban') OR contains(x, '@') OR contains(lower(x), 'www.') OR contains(lower(x), 'http') THEN -10
WHEN length(x) > 24 AND regexp_matches(x, '[0-9]') THEN -5 ELSE greatest(0, 16 - i) + CASE WHEN {_COMPANY_LINE} THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(x), '(^|[^\p{{L}}\p{{N}}_])(b\.?v\.?|vof|shop|company|holding|services?)($|[^\p{{L}}\p{{N}}_])') THEN 10 ELSE 0 END
+ CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 5 THEN 2 ELSE 0 END END AS score FROM l WHERE x <> '')
SELECT doc_id, max(score) AS score, arg_max(x, score * 100 - i) AS issuer FROM s WHERE score >= 0 GROUP BY doc_id""")
def sample_issuer(spark: SparkSession, sf: str) -> DataFrame:
    """The line that names the issuer of a sample best, by the rules for templates being made."""
    best = R.table(spark, sf, "documents").select("doc_id", I.best_line(F.col("text"), I.generator_issuer_score, 25).alias("b"))
    return best.filter("b is not null").select("doc_id", "b.score", F.col("b.line").alias("issuer"))
