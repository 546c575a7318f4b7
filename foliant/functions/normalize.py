"""Values as texts to values: amounts, numbers, currencies, issuers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogue as C
from .regexes import java, squeeze, strip


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def first_value(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first key whose value is neither null nor empty."""
    return F.coalesce(*[F.nullif(payload[k], F.lit("")) for k in keys])


def amount(c: Column) -> Column:
    """An amount's text as a double: the last of comma and dot is the decimal mark, a comma alone is one."""
    bare = F.regexp_replace(c, r"(?U)^\s+|\s+$|EUR|€|\x{A0}| ", "")
    comma_last = bare.rlike(r",[^.]*$")
    plain = F.when(comma_last, F.translate(bare, ",.", ".")).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    number = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i:[+-]?(nan|inf(inity)?))$"
    return F.when(plain.rlike(number), plain.try_cast("double"))


def is_amount(c: Column) -> Column:
    """Whether a text of the shape of an amount has one decimal mark: its last mark, of a kind that occurs once."""
    return c.rlike(r"^[^,]*,[^,.]*$|^[^.]*\.[^,.]*$")


def invoice_number(c: Column) -> Column:
    """Without white space and without marks at the ends; null if no digit is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"(?iU)^[^A-Z0-9]+|[^A-Z0-9/._-]+$", "")
    return F.when(bare.rlike(r"(?U)\d"), bare)


def currency(c: Column) -> Column:
    up = F.upper(strip(c))
    return F.when(up.isin("€", "EURO", "EUROS"), F.lit("EUR")).when(F.length(up) == 3, up)


def is_generic(c: Column) -> Column:
    return F.lower(squeeze(c)).isin(*C.GENERIC_ISSUERS)


def issuer(c: Column) -> Column:
    return F.when(~is_generic(c), strip(c))


def slug(c: Column) -> Column:
    """Lower case, one underscore for each run of other characters; `supplier` for nothing."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", F.lit("supplier")).otherwise(name)


def domain(c: Column) -> Column:
    """The first host-like word, without scheme and www."""
    return F.lower(F.nullif(F.regexp_extract(c, java(C.DOMAIN), 1), F.lit("")))


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(squeeze(text)), F.lower(squeeze(phrase)))


def comparable(field: str, value: Column) -> Column:
    """A field's value as it is compared: number, amount, currency by their rules, others by their digits."""
    if field == "invoice_number":
        return invoice_number(value)
    if field == "amount":
        return amount(value).cast("string")
    if field == "currency_code":
        return currency(value)
    return F.regexp_replace(value, "[^0-9]", "")


def public_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.PUBLIC_NAMES.items() for x in pair])
    return F.coalesce(known[name], name)


def required_fields(c: Column) -> Column:
    """A comma list as an array: stripped, without blanks, each name once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def distinct_patterns(patterns: Column) -> Column:
    return F.array_distinct(F.filter(patterns, lambda x: x.isNotNull() & (x != "")))


def confidence(c: Column, default: Column) -> Column:
    """Within 0 and 1; the default for what is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), default)))


def yaml_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def preview(sources: Column, limit: int = 1200) -> Column:
    """Non-blank texts, white space squeezed, joined by a rule and cut to the limit."""
    whole = F.array_join(F.filter(F.transform(sources, squeeze), lambda t: t != ""), "\n\n---\n\n")
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), F.lit("..."))).otherwise(whole)


def ocr_language(country: Column) -> Column:
    return F.when(F.upper(country) == "NL", F.lit("nld+eng")).otherwise(F.lit("eng"))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def session(path: Column) -> Column:
    """A name for the requests of one file: the front of its own without the ending, and a part that no other has."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit("ocr-"), F.substring(stem, 1, 40), F.lit("-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
