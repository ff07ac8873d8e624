"""Rendered exports as strings, one a row: a due-diligence memo, a filing, a review pack. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import boilerplate as B
from ..functions.boilerplate import fill
from ..functions.text import html_escape, strip


def either(x: Column, other: str = "") -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", other).otherwise(x)


def lines(array: Column, line) -> Column:
    """Each element as a line that begins with a newline."""
    return F.array_join(F.transform(F.coalesce(array, F.array()), lambda x: F.concat(F.lit("\n"), line(x))), "")


def memo(contract: Column, doc_type: Column, summary: Column, clauses: Column, risks: Column) -> Column:
    """A contract's section of the memo, in Markdown; clauses: array of struct name, value, quote, verified; risks: array of text."""

    def clause(c: Column) -> Column:
        doubt = ~F.coalesce(c["verified"], F.lit(False)) & (F.coalesce(c["quote"], F.lit("")) != "")
        return fill("- **", c["name"], "**: ", either(c["value"], "Not found"), F.when(doubt, " (unverified)").otherwise(""))

    kind = F.when(F.coalesce(doc_type, F.lit("")) == "", "").otherwise(fill("*", doc_type, "*"))
    head = fill("## ", contract, "\n\n", kind, "\n", either(summary), "\n")
    some = F.coalesce(F.size(risks), F.lit(0)) > 0
    return fill(strip(fill(head, lines(clauses, clause), F.when(some, fill("\n\n### Key risks", lines(risks, lambda r: fill("- ", r)))).otherwise(""))), "\n")


def filing_html(registrant: Column, sections: Column, exhibits: Column) -> Column:
    """Cover, item sections, the exhibit index and a signature; sections: array of struct item, title, disclosure; exhibits: of number, description."""
    name, dated = html_escape(either(registrant)), html_escape(B.report_date(F.transform(sections, lambda s: s["disclosure"])))

    def section(s: Column) -> Column:
        body = F.transform(B.disclosure_paragraphs(s["disclosure"], s["item"]), lambda p: fill("<p>", B.bold_html(p), "</p>"))
        return fill("<h2>Item ", html_escape(s["item"]), " ", html_escape(either(s["title"])), "</h2>", F.array_join(body, ""))

    rows = F.transform(exhibits, lambda e: fill("<tr><td>", html_escape(e["number"]), "</td><td>", html_escape(e["description"]), "</td></tr>"))
    cover, own = fill("<h1>", name, "</h1><p>Date of report: ", dated, "</p>"), F.array_join(F.transform(sections, section), "")
    return fill("<html><body>", cover, own, "<h2>Item 9.01 Financial Statements and Exhibits</h2><table>", F.array_join(rows, ""), "</table><h2>SIGNATURE</h2><p>", name, "</p></body></html>")


def review_pack(verdict: Column, items: Column, flags: Column) -> Column:
    """Reconciled facts by status and the compliance checks, in Markdown; items: array of struct status, raw, kind, source_snippet; flags: of requirement, satisfied."""

    def part(status: str) -> Column:
        own = F.filter(items, lambda i: i["status"] == status)
        listed = lines(own, lambda i: F.rtrim(fill("- ", i["raw"], " [", i["kind"], "] ", either(i["source_snippet"]))))
        return F.when(F.size(own) > 0, fill(f"\n\n## {status} (", F.size(own).cast("string"), ")", listed)).otherwise("")

    return fill("# Review: ", verdict, *map(part, ("fabricated", "omitted", "derived", "matched")), "\n\n## Compliance", lines(flags, lambda f: fill("- [", F.when(f["satisfied"], "x").otherwise(" "), "] ", f["requirement"])), "\n")
