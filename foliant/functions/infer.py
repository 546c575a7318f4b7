"""Values read from the text alone, where a template has not given them: ordered places, the first usable one wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogue as C
from . import normalize as N
from .regexes import capture, hits, java, lines, squeeze, strip, words


def infer_number(text: Column) -> Column:
    return F.coalesce(*[N.invoice_number(capture(text, p)) for p in C.NUMBER_PLACES])


def header_row_date(text: Column) -> Column:
    """The first date of the line below a date label, over all such lines in order."""
    at = F.transform(lines(text), strip)
    below = F.filter(F.arrays_zip(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))).alias("label"), F.slice(at, 2, F.size(at)).alias("next")), lambda p: F.lower(p["label"]).rlike("|".join(C.DATE_HEADERS)))
    dates = F.transform(below, lambda p: F.nullif(F.regexp_extract(p["next"], java(C.DATE), 1), F.lit("")))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def infer_date(text: Column) -> Column:
    return F.coalesce(header_row_date(text), *[capture(text, p) for p in C.DATE_PLACES])


def infer_amount(text: Column) -> Column:
    """As written. Labels next to an amount come before labels some way from one."""
    beside = [rf"{re.escape(x)}\s*[:#-]?\s*(?:EUR|€)?\s*{C.AMOUNT}" for x in C.TOTAL_LABELS]
    ahead = [rf"{re.escape(x)}[\s\S]{{0,120}}?(?:EUR|€)?\s*{C.AMOUNT}" for x in C.TOTAL_LABELS]
    found = [capture(text, p) for p in beside + ahead]
    return F.coalesce(*[F.when(N.is_amount(c), c) for c in found])


def infer_currency(text: Column) -> Column:
    return F.coalesce(*[N.currency(capture(text, p)) for p in C.CURRENCY_PLACES], F.when(F.contains(text, F.lit("€")), F.lit("EUR")))


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(low, F.lit(m))
    return found


def is_value_line(line: Column) -> Column:
    runs = F.size(F.regexp_extract_all(line, F.lit(r"(?U)(\d+)"), F.lit(1)))
    return hits(line, C.DATE) | hits(line, C.AMOUNT) | ((runs >= 3) & ~hits(line, C.COMPANY_SUFFIX)) | (any_of(line, C.VALUE_MARKS) & line.rlike(r"(?U)\d"))


def is_company_name(line: Column) -> Column:
    return F.length(line).between(3, 60) & ~any_of(line, (*C.COMPANY_MARKS, "@", "www.")) & ~is_value_line(line) & line.rlike("[A-Za-z]")


def issuer_score(line: Column, index: Column) -> Column:
    """How well a line of a document (its place from 0) names the issuer."""
    score = F.greatest(F.lit(0), 12 - index) + 10 * hits(line, C.COMPANY_SUFFIX).cast("int") + 3 * (~line.rlike(r"(?U)\d")).cast("int") + 2 * (words(line) <= 5).cast("int")
    return F.when(~F.length(line).between(4, 60) | any_of(line, C.EXTRACT_MARKS), -10).otherwise(score)


def generator_issuer_score(line: Column, index: Column) -> Column:
    """The same for a sample that a template is made from: names of companies count more."""
    score = F.greatest(F.lit(0), 15 - index) + 10 * is_company_name(line).cast("int") + 10 * hits(line, C.COMPANY_SUFFIX).cast("int") + 2 * (words(line) <= 5).cast("int")
    return F.when((F.length(line) < 4) | any_of(line, C.GENERATE_MARKS), -10).when(line.rlike(r"(?U)\d") & (F.length(line) > 24), -5).otherwise(score)


def best_line(text: Column, score=issuer_score, top: int = 20) -> Column:
    """struct(score, at, line) of the best of the first lines, the first of equals; null below zero."""
    scored = F.transform(F.slice(lines(text), 1, top), lambda x, i: F.struct(score(strip(x), i).alias("score"), (-i).alias("at"), strip(x).alias("line")))
    return F.array_max(F.filter(scored, lambda s: (s["line"] != "") & (s["score"] >= 0)))


def infer_issuer(text: Column) -> Column:
    return best_line(text)["line"]


def detect_issuer(sources: Column) -> Column:
    """The best line of several texts; of equals the one in the earlier text, then the earlier line."""
    best = F.transform(sources, lambda t, k: F.struct(best_line(t, generator_issuer_score, 25).alias("b"), k.alias("k")))
    ranked = F.transform(F.filter(best, lambda s: s["b"].isNotNull()), lambda s: F.struct(s["b"]["score"].alias("score"), (-s["k"]).alias("source"), s["b"]["line"].alias("line")))
    return F.array_max(ranked)["line"]


def resolve_issuer(given: Column, sources: Column) -> Column:
    return F.coalesce(N.issuer(given), detect_issuer(sources), F.nullif(strip(given), F.lit("")), F.lit("Generated Supplier"))


def source_score(text: Column) -> Column:
    """struct(headers, values, length): how much of an invoice a text shows."""
    low = F.lower(text)
    headers = sum((F.contains(low, F.lit(m)).cast("int") for m in C.SOURCE_MARKS), F.lit(0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.struct(headers.alias("headers"), (count(C.DATE) + count(C.AMOUNT) + count("(?iu)(?:EUR|€)")).alias("values"), F.length(squeeze(text)).alias("length"))


def ranked_sources(sources: Column) -> Column:
    """Non-blank texts, equal ones (but for white space) once, best first; of equals the earlier."""
    indexed = F.filter(F.transform(sources, lambda t, i: F.struct(i.alias("i"), t.alias("t"), squeeze(t).alias("n"))), lambda s: s["n"] != "")
    first = F.filter(indexed, lambda s: ~F.exists(indexed, lambda o: (o["n"] == s["n"]) & (o["i"] < s["i"])))
    ranked = F.transform(first, lambda s: F.struct(source_score(s["t"]).alias("score"), (-s["i"]).alias("i"), s["t"].alias("t")))
    return F.transform(F.reverse(F.array_sort(ranked)), lambda s: s["t"])


def escaped(c: Column) -> Column:
    """A text as a pattern that matches it."""
    return F.regexp_replace(c, r"([\\\[\](){}*+?|^$.&~#\-\s])", r"\\$1")


def flexible(c: Column) -> Column:
    """A name as a pattern: any white space for a blank, any dash or none for a hyphen."""
    return F.replace(F.replace(escaped(strip(c)), F.lit("\\ "), F.lit("\\s+")), F.lit("\\-"), F.lit("[-–—]?"))


def keyword_candidate(line: Column) -> Column:
    """struct(score, pattern) of what a line offers to know its supplier by; score 0 and null for nothing."""
    offer = lambda score, pattern: F.struct(F.lit(score).alias("score"), F.concat(F.lit("(?i)"), pattern).alias("pattern"))
    email, vat = F.regexp_extract(line, java(C.EMAIL), 1), F.regexp_substr(line, F.lit(java(C.VAT)))
    kvk, iban = F.regexp_substr(line, F.lit(f"(?U){C.KVK}")), F.regexp_substr(line, F.lit(f"(?U){C.IBAN}"))
    host = N.domain(line)
    none = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("pattern"))
    return (
        F.when((F.length(line) > 100) | is_value_line(line), none)
        .when(any_of(line, C.URL_MARKS) & host.isNotNull(), offer(6, escaped(host)))
        .when(email != "", offer(6, escaped(F.lower(email))))
        .when(vat.isNotNull(), offer(7, escaped(F.upper(vat))))
        .when(any_of(line, ("kvk",)) & kvk.isNotNull(), offer(6, F.concat(F.lit(r"KvK\s*(?:nr)?[:.]?\s*"), kvk)))
        .when(iban.isNotNull(), offer(5, iban))
        .when(is_company_name(line), offer(5, flexible(line)))
        .otherwise(none)
    )


def keyword_candidates(issuer: Column, sources: Column, top: int = 3) -> Column:
    """The issuer's pattern if a text has it, then the best lines' patterns, each once; the detected issuer's, or any
    mention of an invoice, where there is none."""
    named = F.when(~N.is_generic(issuer) & F.exists(sources, lambda t: N.contains_phrase(t, issuer)), F.array(F.concat(F.lit("(?i)"), flexible(issuer)))).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.filter(F.flatten(F.transform(sources, lambda t: F.transform(lines(t), strip))), lambda x: x != ""), keyword_candidate)
    offers = F.filter(F.transform(every, lambda k, i: F.struct((-k["score"]).alias("s"), i.alias("i"), k["pattern"].alias("p"))), lambda k: k["p"].isNotNull())
    found = F.slice(F.array_distinct(F.concat(named, F.transform(F.array_sort(offers), lambda k: k["p"]))), 1, top)
    instead = F.coalesce(F.concat(F.lit("(?i)"), flexible(detect_issuer(sources))), F.lit(r"(?i)factu\W*ur"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(instead))


def is_supplier_identifier(keyword: Column, sources: Column) -> Column:
    digits, low = F.regexp_count(keyword, F.lit(r"(?U)\d")), F.lower(keyword)
    plain = F.regexp_replace(keyword, r"(?i)\(\?[a-z]+\)", "")
    for written, read in ((r"\s+", " "), (r"\s*", " "), (r"\.", "."), ("\\", "")):
        plain = F.replace(plain, F.lit(written), F.lit(read))
    plain = F.lower(squeeze(plain))
    in_line = F.exists(sources, lambda t: F.exists(lines(t), lambda x: F.contains(F.lower(squeeze(x)), plain) & any_of(x, C.SUPPLIER_LINE_MARKS)))
    by_form = N.domain(keyword).isNotNull() | hits(keyword, C.EMAIL) | ((digits >= 8) & (any_of(keyword, ("kvk", "btw", "vat")) | (F.contains(low, F.lit("nl")) & F.contains(low, F.lit("b")))))
    return by_form | ((plain != "") & F.coalesce(in_line, F.lit(False)))


def is_invoice_specific(keyword: Column, sources: Column) -> Column:
    """A keyword that only one invoice would have."""
    token = keyword.rlike(r"(?iU)^[A-Z0-9._/-]+$") & keyword.rlike(r"(?U)\d")
    looks = hits(keyword, C.DATE) | hits(keyword, C.AMOUNT) | (F.regexp_count(keyword, F.lit(r"(?U)\d")) >= 8) | token | any_of(keyword, C.ORDER_MARKS)
    return looks & ~is_supplier_identifier(keyword, sources)


def column_is(cells: Column, kind: str) -> Column:
    """All cells of a non-empty column are quantities, descriptions, amounts or VAT rates."""
    whole = lambda p: (lambda x: x.rlike(f"(?U)^(?:{p})$"))
    test = {
        "quantity": whole(r"\d+(?:[.,]\d+)?"), "vat": whole("[0-9]{1,2}%"),
        "amount": lambda x: F.contains(x, F.lit("€")) | hits(x, C.AMOUNT),
        "description": lambda x: ~whole(C.AMOUNT)(x) & ~F.contains(x, F.lit("%")),
    }[kind]
    return (F.size(cells) > 0) & F.forall(cells, test)
