"""Putting filings together: item order, routing of documents, exhibits, closing sentences, supplements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import replace_nth

# Titles of items, and the item to which a cross-reference points if it is selected, in order of preference.
ITEM_TITLES = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.03": "Creation of a Direct Financial Obligation",
    "3.02": "Unregistered Sales of Equity Securities",
    "5.02": "Departure/Election of Directors or Officers",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
}


#: Marks of redaction that must not be left.
LEAK = r"\[REDACTED\]|[▀-▟■-◿]{2,}|\*{3,}"
# Exhibit classes that can be a source, and the forms of current reports.
LISTED, FORMS = ["1", "2", "3", "4", "10", "99"], ["8-K", "8-K/A"]
COMPANIONS = {"3.02": ["1.01", "2.03", "2.01"], "2.01": ["1.01"], "2.03": ["1.01"]}


def item_key(item: Column) -> Column:
    return F.transform(F.split(item, r"\."), lambda p: p.cast("int"))


def filing_order(items: Column) -> Column:
    """Known items once each, by their numbers."""
    known = F.filter(F.array_distinct(items), lambda i: i.isin(list(ITEM_TITLES)))
    return F.transform(F.array_sort(F.transform(known, lambda i: F.struct(item_key(i).alias("k"), i.alias("i")))), lambda x: x["i"])


def exhibit_key(number: Column) -> Column:
    """Two numbers to sort exhibits by, malformed ones last."""
    major, minor = (F.regexp_extract(number, r"^(\d+)(?:\.(\d+))?", i) for i in (1, 2))
    return F.struct(F.when(major != "", major.cast("int")).otherwise(9999).alias("a"), F.when(minor != "", minor.cast("int")).otherwise(0).alias("b"))


def exhibit_index(exhibits: DataFrame) -> DataFrame:
    """filing, place, number, description: the first of each number, sorted, with the interactive data file at the end."""
    first = Window.partitionBy("filing", "number").orderBy("pos")
    rows = exhibits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("filing", "number", "description")
    last = exhibits.select("filing").distinct().select("filing", F.lit("104").alias("number"), F.lit("Cover Page Interactive Data File (embedded within the Inline XBRL document)").alias("description"))
    place = Window.partitionBy("filing").orderBy((F.col("number") == "104").cast("int"), exhibit_key(F.col("number")), "number")
    return rows.filter("number <> '104'").unionByName(last).withColumn("place", F.row_number().over(place))


def route(assigned: DataFrame, families: DataFrame, sources: DataFrame) -> DataFrame:
    """filing, item, doc: each item's documents; without one, the first document of the item's family, else the filing's first.

    assigned: filing, item, doc (null where nothing is assigned); families: item, family; sources: filing, doc, family, pos.
    """
    kin = sources.groupBy("filing", "family").agg(F.min_by("doc", "pos").alias("kin"))
    first = sources.groupBy("filing").agg(F.min_by("doc", "pos").alias("first"))
    rows = assigned.join(families, "item", "left").join(kin, ["filing", "family"], "left").join(first, "filing", "left")
    return rows.select("filing", "item", F.coalesce("doc", "kin", "first").alias("doc"))


def unrouted(sources: DataFrame, routed: DataFrame) -> DataFrame:
    """sources (filing, doc, ...) that no item draws on: an exhibit index lists them, nothing is drafted from them."""
    return sources.join(routed.select("filing", "doc").distinct(), ["filing", "doc"], "left_anti")


def exhibit_links(index_html: Column, base: str) -> Column:
    """Array of (cls, url) in the rows of a filing's index page: exhibits of the kept classes, each address once."""
    row = lambda r: F.struct(F.regexp_extract(r, r"(?i)EX-(\d+)(?:\.(\d+))?", 1).alias("major"), F.regexp_extract(r, 'href="([^"]+)"', 1).alias("u"))
    able = F.filter(F.transform(F.split(index_html, "(?i)<tr"), row), lambda x: x["major"].isin(*LISTED) & (x["u"] != ""))
    full = F.transform(able, lambda x: F.struct(F.concat(F.lit("EX-"), x["major"]).alias("cls"), F.when(F.startswith(x["u"], F.lit("http")), x["u"]).otherwise(F.concat(F.lit(base), x["u"])).alias("url")))
    # The first row of each address: a filter alone would work out its array for every row anew.
    return F.aggregate(full, F.array().cast("array<struct<cls:string,url:string>>"), lambda got, x: F.when(F.exists(got, lambda g: g["url"] == x["url"]), got).otherwise(F.array_append(got, x)))


def recent_forms(filings: DataFrame, by: str, order: list[Column], most: int = 50) -> DataFrame:
    """The first filings, by the order, of each registrant that are current reports or amendments of such."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return filings.filter(F.col("form").isin(*FORMS)).withColumn("nth", first).filter(F.col("nth") <= most)


def number_exhibits(docs: DataFrame) -> DataFrame:
    """docs (filing, pos, prefix, asked) with number: the asked one, or the next free prefix.n in order of pos."""
    asked = docs.filter("asked IS NOT NULL").select("filing", F.col("asked").alias("number")).distinct()
    per = docs.filter("asked IS NULL")
    many = per.groupBy("filing", "prefix").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("filing").agg(F.count(F.lit(1)).alias("used")), "filing", "left")
    free = many.select("filing", "prefix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + F.coalesce("used", F.lit(0)))).alias("i"))
    free = free.withColumn("number", F.concat_ws(".", F.col("prefix"), F.col("i").cast("string"))).join(asked, ["filing", "number"], "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy("filing", "prefix").orderBy("i"))).select("filing", "prefix", "nth", "number")
    given = per.withColumn("nth", F.row_number().over(Window.partitionBy("filing", "prefix").orderBy("pos"))).join(free, ["filing", "prefix", "nth"]).drop("nth")
    return given.unionByName(docs.filter("asked IS NOT NULL").withColumn("number", F.col("asked")))


def listed(parts: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(parts)
    return F.when(n <= 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n - 1), ", "), F.lit(", and "), F.element_at(parts, -1)))


def combined_qualifier(nouns: Column, numbers: Column) -> Column:
    """The closing sentence for one instrument or for several."""
    one = F.format_string(
        "The foregoing description of the %1$s does not purport to be complete and is qualified in its entirety by reference to the full text of such %1$s, a copy of which is filed as Exhibit %2$s to this Current Report on Form 8-K and is incorporated herein by reference.",
        F.element_at(nouns, 1),
        F.element_at(numbers, 1),
    )
    many = F.format_string(
        "The foregoing descriptions of the %s do not purport to be complete and are qualified in their entirety by reference to the full text of such documents, copies of which are filed as Exhibits %s to this Current Report on Form 8-K and are incorporated herein by reference.",
        listed(nouns),
        listed(numbers),
    )
    return F.when(F.size(nouns) == 1, one).otherwise(many)


def cross_reference(item: Column, selected: Column) -> Column:
    """The item whose text this one refers to instead of a text of its own: the first of its companions that is selected."""
    out = F.lit(None).cast("string")
    for own, companions in COMPANIONS.items():
        for c in reversed(companions):
            out = F.when((item == own) & F.array_contains(selected, c), F.lit(c)).otherwise(out)
    return out


def cross_reference_text(item: Column, companion: Column) -> Column:
    return F.concat(F.lit("The information set forth under Item "), companion, F.lit(" of this Current Report on Form 8-K is incorporated by reference into this Item "), item, F.lit("."))


def assemble_disclosure(c: Column) -> Column:
    """The first sentence of a disclosure from a struct of clauses; what is empty is left out, nothing is made up."""
    has = lambda f: F.coalesce(c[f], F.lit("")) != ""
    part = lambda f, before, after="": F.when(has(f), F.concat(F.lit(before), c[f], F.lit(after))).otherwise("")
    sale = F.concat(F.lit(", pursuant to which the Company agreed to issue and sell"), part("shares", " ", " shares"), F.when(has("shares"), "").otherwise(" shares"), part("class", " of "), part("price", " at a purchase price of ", " per share"), part("total", ", for aggregate gross proceeds of "))
    bought = F.concat(part("asset", " to acquire "), part("total", " for a purchase price of "))
    terms = F.when(has("shares") | has("price"), sale).when(has("asset"), bought).otherwise(part("total", " providing for aggregate consideration of "))
    return F.concat(part("date", "On ", ", "), F.when(has("company"), c["company"]).otherwise("the Company"), F.lit(" (the “Company”) entered into a "), c["agreement"], F.lit(" (the “Agreement”)"), part("counterparty", " with "), terms, F.lit("."))


def fill_gaps(text: Column, fills: Column, placeholder: str) -> Column:
    """text with its placeholders filled: fills are structs (n, value); the last first, so that earlier numbers hold."""
    order = F.reverse(F.array_sort(fills))
    return F.aggregate(order, text, lambda t, f: replace_nth(t, placeholder, f["value"], f["n"]))


def gaps(text: Column, placeholder: str) -> Column:
    """Array of (n, before, after): what stands around each placeholder, 70 characters before and 40 after."""
    parts = F.split(text, "\\Q" + placeholder + "\\E", -1)
    n = F.size(parts) - 1
    # So many neighbouring pieces have 70 and 40 characters by the placeholders between them alone.
    back, on = (k // len(placeholder) + 2 for k in (70, 40))
    start = lambda i: F.greatest(i + 2 - back, F.lit(1))
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n),
        lambda i: F.struct(
            i.alias("n"),
            F.right(F.array_join(F.slice(parts, start(i), i + 2 - start(i)), placeholder), F.lit(70)).alias("before"),
            F.left(F.array_join(F.slice(parts, i + 2, F.lit(on)), placeholder), F.lit(40)).alias("after"),
        ),
    )


def compliance_flags(item: Column, disclosure: Column) -> Column:
    """Array of (requirement, satisfied): what the disclosure of an item must visibly have."""
    low = F.lower(disclosure)
    words = F.size(F.filter(F.split(disclosure, r"\s+"), lambda w: w != ""))
    flag = lambda name, ok: F.struct(F.lit(name).alias("requirement"), ok.alias("satisfied"))
    closing = [flag("exhibit incorporation-by-reference", F.contains(low, F.lit("qualified in its entirety"))), flag("no unresolved redaction markers", ~disclosure.rlike(LEAK))]
    agreement = [
        flag("(a) date of agreement", disclosure.rlike(r"\b[A-Z][a-z]+ \d{1,2}, \d{4}\b")),
        flag("(b) parties identified", F.contains(low, F.lit(" between ")) | F.contains(low, F.lit(" with "))),
        flag("(c) material-relationship statement", F.contains(low, F.lit("material relationship"))),
        flag("(d) material terms described", words > 40),
    ]
    return F.when(item == "1.01", F.array(*agreement, *closing)).otherwise(F.array(*closing))


def display_verdict(fabricated: Column, blanked: Column, derived: Column, omitted: Column) -> Column:
    return F.when(fabricated > 0, "blocked").when(blanked + derived + omitted > 0, "review").otherwise("clean")
