"""Text normalisation and small parsers, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import blank_to_null, col, let, positive, round_half_up

# Unit words and number shapes.
WEIGHT_UNIT = r"(kg|kilogram|gram|gr|g)\b"
NUMBER = r"(\d+(?:[.,]\d+)?)"
MULTI_PACK = rf"(?i){NUMBER}\s*[x×]\s*{NUMBER}\s*{WEIGHT_UNIT}"
SINGLE_PACK = rf"(?i){NUMBER}\s*{WEIGHT_UNIT}"
ANY_UNIT = r"(?:kg|kilogram|gram|gr|g|ml|l|liter|pcs|buah|sachet|pack)"
ANY_NUMBER = r"\d+(?:[.,]\d+)?"
PACK_IN_NAME = rf"(?i)({ANY_NUMBER}\s*[x×]\s*{ANY_NUMBER}\s*{ANY_UNIT}\b|{ANY_NUMBER}\s*{ANY_UNIT}\b)"
DOTTED_THOUSANDS = r"^\d{1,3}(\.\d{3})+(,\d+)?$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
FORMULA_START = r"^[=+\-@\t\r]"


def entity_key(value: Column | str) -> Column:
    """Lower-cased letters and digits only; empty string for null."""
    return F.coalesce(F.regexp_replace(F.lower(col(value)), "[^a-z0-9]", ""), F.lit(""))


def identity_text(value: Column | str) -> Column:
    """Lower-cased, trimmed and with single blanks; null if nothing is left. Few texts have other blanks and go through the second pattern."""
    raw = col(value).cast("string")
    plain = F.trim(F.lower(raw))
    return F.nullif(F.when(raw.rlike(r"\s\s|[^\S ]"), F.regexp_replace(plain, r"\s+", " ")).otherwise(plain), F.lit(""))


def family_name(name: Column | str) -> Column:
    """Product line without pack sizes, offer words and punctuation."""
    text = F.lower(col(name))
    text = F.regexp_replace(text, r"\b\d+(?:[.,]\d+)?\s*(?:x\s*\d+(?:[.,]\d+)?)?\s*(?:kg|kilogram|gram|gr|g|ml|l)\b", "")
    text = F.regexp_replace(text, r"\b(promo|diskon|hemat|beli\s*\d+|gratis\s*\d+|special|pack|kemasan\s*baru)\b", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def regional_key(name: Column | str, pack: Column | str) -> Column:
    label = F.trim(F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]+", " "))
    size = F.regexp_replace(F.lower(F.coalesce(col(pack), F.lit(""))), "[^a-z0-9]+", "")
    return F.concat_ws("|", label, size)


def offer_key(competitor_id="competitor_id", name="product_name", pack="pack_size", category="category") -> Column:
    """Identity of a competitor pack across sightings (what an analyst's decision attaches to)."""
    parts = [
        F.coalesce(col(competitor_id).cast("string"), F.lit("")),
        F.lower(F.trim(F.coalesce(col(name), F.lit("")))),
        F.lower(F.trim(F.coalesce(col(pack), F.lit("")))),
        F.upper(F.coalesce(col(category), F.lit(""))),
    ]
    return F.concat_ws("\u001f", *parts)


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def pack_grams(pack: Column | str) -> Column:
    """'300g' -> 300, '1,5 kg' -> 1500, '12x25g' -> 300; null when not a weight."""
    text = col(pack)
    factor = lambda pattern, group: F.when(
        F.lower(F.regexp_extract(text, pattern, group)).startswith("k"), F.lit(1000.0)).otherwise(F.lit(1.0))
    amount = lambda pattern, group: _amount(F.regexp_extract(text, pattern, group))
    multi = amount(MULTI_PACK, 1) * amount(MULTI_PACK, 2) * factor(MULTI_PACK, 3)
    single = amount(SINGLE_PACK, 1) * factor(SINGLE_PACK, 2)
    return positive(round_half_up(F.coalesce(multi, single), 2))


def pack_from_name(name: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(name), PACK_IN_NAME, 1))


def _price_number(value: Column) -> Column:
    text = F.regexp_replace(value.cast("string"), r"(?i)rp\.?|idr|\s", "")
    dotted = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    plain = F.regexp_replace(text, ",", ".")
    number = F.when(text.rlike(DOTTED_THOUSANDS), dotted).otherwise(plain)
    return F.when(number.rlike(PLAIN_NUMBER) | number.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d+$"), number.try_cast("double"))


def import_price(value: Column | str) -> Column:
    """Price for the catalogue import: null unless 0 < price < 10,000,000."""
    return let(_price_number(col(value)), lambda n: F.when((n > 0) & (n < 1e7), n))


def extracted_price(value: Column | str) -> Column:
    """Price out of extracted text: null unless 0 <= price < 100,000,000, 2 decimals."""
    return let(_price_number(col(value)), lambda n: F.when((n >= 0) & (n < 1e8), round_half_up(n, 2)))


def guard_formula(value: Column | str) -> Column:
    text = col(value)
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and host, default path '/', no fragment."""
    head = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"

    def build(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, head, i)
        path = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("/"))
        tail = F.coalesce(F.nullif(part(4), F.lit("?")), F.lit(""))
        return F.when(text.rlike(head), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, tail)).otherwise(text)

    return let(F.trim(col(url)), build)


def trigrams(word: Column | str) -> Column:
    """Distinct trigrams of one normalised word, padded by two leading blanks and one trailing blank."""
    padded = F.concat(F.lit("  "), col(word), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(col(word)) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(left) + F.size(right) - shared), F.lit(0.0))


def name_tokens(name: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(name), F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def tokens_contained(left: Column, right: Column) -> Column:
    """True when one non-empty token set contains the other."""
    return (F.size(left) > 0) & (F.size(right) > 0) & (
        (F.size(F.array_except(left, right)) == 0) | (F.size(F.array_except(right, left)) == 0))


def squashed(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "))


def looks_like_shell(html: Column | str) -> Column:
    """Little visible text plus a client-side framework marker."""
    page = col(html)
    visible = F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), r"\s+", " "))
    marker = F.lower(page).rlike(r'__next_data__|id="__next"|data-reactroot|webpack|vite')
    return F.coalesce((F.length(page) > 0) & (F.length(visible) < 500) & marker, F.lit(False))


def document_type(url: Column | str, mime: Column | str, head: Column | str) -> Column:
    """HTML / PDF / IMAGE / UNKNOWN from the mime type, the path and the first bytes (as latin-1 text)."""
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(col(mime), F.lit("")), "^([^;]*)", 1)))
    path = F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1))
    lead = F.coalesce(col(head), F.lit(""))
    html_lead = F.lower(F.ltrim(F.regexp_replace(lead, r"^\s+", "")))
    return (
        F.when((kind == "application/pdf") | lead.startswith("%PDF-") | path.endswith(".pdf"), "PDF")
        .when(kind.startswith("image/") | lead.startswith("\u0089PNG\r\n\u001a\n") | lead.startswith("ÿØÿ")
              | lead.startswith("GIF87a") | lead.startswith("GIF89a") | lead.startswith("RIFF"), "IMAGE")
        .when(kind.isin("text/html", "application/xhtml+xml") | path.endswith(".html") | path.endswith(".htm"), "HTML")
        .when(html_lead.startswith("<!doctype html") | html_lead.startswith("<html") | html_lead.startswith("<head"), "HTML")
        .otherwise("UNKNOWN")
    )
