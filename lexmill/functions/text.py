"""Column expressions over text: names, cleaning, quotes, windows, tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal suffixes that names are compared without.
NAME_SUFFIXES = ["inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "co", "company", "corp", "corporation", "plc", "gmbh", "ag", "sa", "nv", "bv", "pllc", "pc"]
# Keywords of deal types, the first type that has one counts.
DEAL_TYPES = [
    ("real estate", ["purchase and sale agreement", "real property", "square feet", "square foot", "lease agreement"]),
    ("note / debt", ["promissory note", "senior note", "convertible note", "principal amount", "indenture", "credit agreement", "loan"]),
    ("equity financing", ["securities purchase agreement", "registered direct", "private placement", "at-the-market", "at the market", "standby equity", "underwriting agreement", "warrant", "pipe"]),
    ("M&A / asset", ["merger agreement", "asset purchase", "stock purchase agreement", "business combination", "arrangement agreement"]),
    ("services / commercial", ["master services", "services agreement", "supply agreement", "collaboration", "license agreement", "distribution"]),
    ("officer / director", ["employment agreement", "separation", "appointed", "resigned", "director", "chief executive", "chief financial"]),
]
# Presence patterns of disclosure categories.
RUBRIC = {
    "price / consideration": r"\$|purchase price|consideration|aggregate (?:of|principal)|for a (?:total|purchase)",
    "asset size / description": r"square f|sq\.?\s?ft|\bacres?\b|rentable|building|premises|parcel|shares of|units of",
    "term / duration / maturity": r"\bmatur|\bterm\b|for a period of|expir|through (?:the )?(?:date|[A-Z][a-z]+ \d)",
    "deposit / earnest money": r"earnest|\bdeposit\b|escrow",
    "interest rate / discount": r"interest (?:rate|at)|per annum|\bcoupon\b|original issue discount|\bOID\b",
    "closing / completion timing": r"closing|consummat|shall (?:close|be held)|completion|on or before|effective date of",
    "termination rights": r"terminat",
    "conversion / redemption": r"convert|conversion|redeem|redemption",
    "governing law": r"governing law|governed by (?:the )?laws|laws of the state",
    "indemnification": r"indemnif",
    "dispute resolution": r"arbitrat|dispute resolution|exclusive jurisdiction|\bvenue\b|jury trial",
    "assignment / change-of-control": r"assign(?:ment|ed|s|able)?\b|change of control",
    "representations / warranties": r"represent|warrant",
    "confidentiality": r"confidential|non-disclosure",
    "'customary provisions' catch-all": r"customary",
}
# Marks of redacted text.
REDACTION = r"[▀-▟■-◿]{2,}|\*{3,}|_{5,}"
STUB = "incorporated herein by reference"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """All white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_key(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +")
    return F.coalesce(F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(NAME_SUFFIXES)), " "), F.lit(""))


def is_missing(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "not found")


def clean(text: Column) -> Column:
    """Form feeds to line ends; no contents headings, no bare page numbers; blanks and empty lines collapsed."""
    t = F.regexp_replace(text, "\f", "\n")
    t = F.regexp_replace(t, r"(?imd)^\s*table of contents\s*$", "")
    t = F.regexp_replace(t, r"(?md)^\s*\d{1,3}\s*$", "")
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_exhibit_header(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"^(?i:[ \t]*(?:EX-[\d.]+|[\w-]+\.html?)[ \t]*(?:\n|$))+", ""))


ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def html_to_text(html: Column, block_lines: bool = False) -> Column:
    """Text of a page; block_lines: with line ends where blocks end."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    if block_lines:
        t = F.regexp_replace(t, r"(?i)</?(?:p|div|tr|br|li|h[1-6]|table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    if not block_lines:
        return F.trim(F.regexp_replace(t, r"[ \t\n\r\f\u000B ]+", " "))
    t = F.regexp_replace(t, r"[ \t ]+", " ")
    return strip(F.regexp_replace(t, r" *(?:\n *)+", "\n"))


def scrub_redactions(value: Column) -> Column:
    t = F.regexp_replace(value, REDACTION, "[REDACTED]")
    return strip(F.regexp_replace(t, r"(\[REDACTED\][ ,]*){2,}", "[REDACTED] "))


def verify_quote(quote: Column, source: Column) -> Column:
    """Whether the quote, or each of the segments between its ellipses in turn, stands in the source word for word."""
    src = squeeze(source)
    segments = F.filter(F.transform(F.split(quote, r"(?U)\s*(?:\.{3}|…)\s*"), squeeze), lambda s: s != "")

    def step(at: Column, segment: Column) -> Column:
        found = F.call_function("locate", segment, src, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(segment))

    in_turn = (F.size(segments) > 0) & (F.aggregate(segments, F.lit(1), step) > 0)
    return F.coalesce((squeeze(quote) != "") & (F.contains(src, squeeze(quote)) | in_turn), F.lit(False))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")


def windows(text: Column, width: int, overlap: int) -> Column:
    """Array of (start, text): windows of `width` characters, each overlapping the one before."""
    stride = width - min(overlap, width // 5)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(width)).alias("window")))


def is_stub(output: Column) -> Column:
    return (F.length(output) < 450) & F.contains(F.lower(output), F.lit(STUB))


def deal_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("unclassified")
    for label, words in reversed(DEAL_TYPES):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(low, F.lit(w))
        out = F.when(has, F.lit(label)).otherwise(out)
    return out


def band(rate: Column) -> Column:
    return F.when(rate >= 0.8, "ALWAYS").when(rate >= 0.3, "USUALLY").otherwise("RARELY")


def citation(filename: Column, page: Column, doc_type: Column) -> Column:
    return F.concat(filename, F.when(page > 0, F.concat(F.lit(" p."), page.cast("string"))).otherwise(""), F.when(F.coalesce(doc_type, F.lit("")) != "", F.concat(F.lit(" ["), doc_type, F.lit("]"))).otherwise(""))


def page_count(page: Column) -> Column:
    """An aggregate: the last page, null where no block has one."""
    return F.nullif(F.max(F.coalesce(page, F.lit(0))), F.lit(0))


def replace_nth(text: Column, needle: str, new: Column, n: Column) -> Column:
    """text with its n-th (from 0) occurrence of needle replaced; unchanged where there are fewer."""
    parts = F.split(text, "\\Q" + needle + "\\E", -1)
    head = F.array_join(F.slice(parts, 1, n + 1), needle)
    tail = F.array_join(F.slice(parts, n + 2, F.greatest(F.size(parts) - n - 1, F.lit(0))), needle)
    return F.when((n >= 0) & (n < F.size(parts) - 1), F.concat(head, new, tail)).otherwise(text)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def parse_amount(text: Column) -> Column:
    """The first amount in text as a decimal, million and billion counted in; null where there is none or it is out of range."""
    number = F.regexp_extract(text, r"([\d,]*\d[\d,]*(?:\.\d+)?)", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)[\d,]*\d[\d,]*(?:\.\d+)?\s*(million|billion)?", 1))
    factor = F.when(unit == "million", F.lit(1_000_000)).when(unit == "billion", F.lit(1_000_000_000)).otherwise(F.lit(1))
    return F.try_multiply(F.regexp_replace(number, ",", "").try_cast("decimal(27,6)"), factor.cast("decimal(10,0)")).try_cast("decimal(28,6)")


def chunk_text(text: str, size: int = 1200, overlap: int = 150) -> list[str]:
    """Greedy packing of paragraphs into chunks of `size` characters; a longer paragraph gives off its head first."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    out, pending = [], ""
    for para in filter(None, (p.strip() for p in text.split("\n"))):
        while len(para) > size:
            out.append(para[:size])
            para = para[size - overlap :]
        if pending and len(pending) + 1 + len(para) > size:
            out.append(pending.strip())
            carried = pending[-overlap:] if overlap else ""
            pending = f"{carried}\n{para}" if carried else para
        else:
            pending = f"{pending}\n{para}" if pending else para
    if pending.strip():
        out.append(pending.strip())
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: chunk_text(t or ""))


def fixed(x: Column, places: int) -> Column:
    """A double with so many decimals (6 at most). The double itself is rounded, as C and Python do it, ties to even; Java's %f rounds its shortest decimal form up.

    The product with the power of ten is split into two doubles without loss, which tells on which side of a half it lies.
    """
    scale, v = float(10**places), F.abs(x)
    product, wide = v * scale, v * 134217729.0
    high = wide - (wide - v)
    lost = (high * scale - product) + (v - high) * scale
    low = F.floor(product)
    half = (product - low) - 0.5 + lost
    n = low + F.when((half > 0) | ((half == 0) & (low % 2 == 1)), 1).otherwise(0)
    whole = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), places, "0"))
    return F.when(v < 2**52 / scale, whole).otherwise(F.format_string(f"%.{places}f", x))
