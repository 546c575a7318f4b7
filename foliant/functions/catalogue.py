"""What invoices and receipts look like: value shapes, labels, markers."""

from __future__ import annotations

# Shapes of values.
NUMBER = r"((?=[A-Z0-9/._-]*\d)[A-Z0-9][A-Z0-9/._-]+)"
DATE = r"([0-9]{2}[./-][0-9]{2}[./-][0-9]{4})"
AMOUNT = r"([0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}|[0-9]+[.,][0-9]{2})"
_DAY = r"[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}"
_TIME = r"[0-9]{2}:\d{2}(?::\d{2})?"
_SIGN = r"\s*[:#-]?\s*"
_HYPHENATED = r"[A-Z0-9][A-Z0-9/._]*(?:\s*-\s*[A-Z0-9][A-Z0-9/._]*)+"
COMPANY_SUFFIX = r"\b(b\.?v\.?|vof|shop|company|holding|services?)\b"
WORD_ONLY = r"[A-Za-z\s/.()\-#%]+"
TOTALS = r"(subtotal|totaal|total|sum|bedrag|btw|vat|tax|subtotaal)"

# Field names, in order of priority.
NUMBER_KEYS = ("invoice_number", "invoice_no", "invoice_id", "number")
DATE_KEYS = ("invoice_date", "date")
AMOUNT_KEYS = ("total_amount", "amount", "invoice_total", "total")
CURRENCY_KEYS = ("currency_code", "currency", "currency_symbol")
SCORED_KEYS = ("amount", "total_amount", "date", "invoice_date", "invoice_number", "invoice_no", "invoice_id", "number", "currency_code", "currency", "currency_symbol")
PUBLIC_NAMES = {"invoice_number": "invoice_number", "date": "invoice_date", "amount": "total_amount", "currency_code": "currency_code"}
REQUIRED = ("invoice_number", "date", "amount", "currency_code")
GENERIC_ISSUERS = ("", "n/a", "na", "onbekend", "supplier", "unknown", "vendor")

# Where a value is looked for when a template has not given it, in order.
NUMBER_PLACES = (
    rf"Factuurnummer{_SIGN}{NUMBER}", rf"Factuur\s+nummer{_SIGN}{NUMBER}", rf"Invoice\s*number{_SIGN}{NUMBER}",
    rf"Factuurnummer[\s\S]{{0,120}}?{NUMBER}", rf"Invoice\s*number[\s\S]{{0,120}}?{NUMBER}",
    rf"(?:Factuurdatum|Invoice\s*date){_SIGN}{_DAY}\s+{NUMBER}",
    rf"(?:{_DAY})\s+{_TIME}\s+[^\n0-9A-Z]{{0,4}}(?:[A-Z]\s+)?((?=[A-Z0-9/._-]*\d){_HYPHENATED})",
    rf"(?:{_DAY})\s+{_TIME}\s+({_HYPHENATED})",
    rf"(?:{_DAY})\s+{_TIME}\s+{NUMBER}",
    rf"(?:{_DAY})\s+{_TIME}[\s\S]{{0,40}}?\n\s*([0-9]{{10,}})",
)
DATE_PLACES = (
    rf"^{DATE}\s+{_TIME}\b", rf"Factuurdatum{_SIGN}{DATE}", rf"Invoice\s*date{_SIGN}{DATE}", rf"Datum{_SIGN}{DATE}",
    rf"Factuurdatum[\s\S]{{0,160}}?{DATE}", rf"Invoice\s*date[\s\S]{{0,160}}?{DATE}",
)
DATE_HEADERS = ("factuurdatum", "invoice date")
TOTAL_LABELS = ("Totaal incl. BTW", "Totaal incl btw", "Te betalen", "Totaal bedrag", "Totaal", "Subtotaal")
CURRENCY_PLACES = (
    rf"Valuta{_SIGN}((?:[A-Z]{{3}}|€))", rf"Totaal\s+incl\.\s+BTW{_SIGN}((?:[A-Z]{{3}}|€))", rf"Te betalen{_SIGN}((?:[A-Z]{{3}}|€))",
    r"\b((?:EUR|USD|GBP|CHF))\b",
)

# Marks of lines that name no supplier, and of lines and texts of other kinds.
EXTRACT_MARKS = ("factuur", "invoice", "btw", "kvk", "iban", "@", "www.", "http")
GENERATE_MARKS = ("factuur", "btw", "kvk", "iban", "@", "www.", "http")
COMPANY_MARKS = ("adres", "factuur", "btw", "kvk", "iban", "omschrijving")
VALUE_MARKS = ("betaling", "bestelnummer", "leveringsnummer")
ORDER_MARKS = ("factuurnummer", "invoice_number", "bestelnummer", "leveringsnummer")
SUPPLIER_LINE_MARKS = ("kvk", "btw", "vat", "www.", "http://", "https://", "@")
URL_MARKS = ("http://", "https://", "www.")
SOURCE_MARKS = ("factuurnummer", "invoice number", "factuurdatum", "invoice date", "factuurbedrag", "invoice total", "totaal netto", "factuur", "pagina", "betaald", "btw")
DOMAIN = r"(?:https?://)?(?:www\.)?([A-Z0-9.-]+\.[A-Z]{2,})"
EMAIL = r"[A-Z0-9._%+-]+@([A-Z0-9.-]+\.[A-Z]{2,})"
VAT = r"\bNL[0-9A-Z]{9,14}\b"
KVK = r"\b[0-9]{8}\b"
IBAN = r"\b[A-Z]{2}[0-9A-Z]{13,30}\b"
