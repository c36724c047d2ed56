"""Sinks: fixed-layout CSV and spreadsheet files of leads.

Rows are projected and escaped by Columns, so the CSV body is written by Spark in parallel (csv_lines + text). The
single-file forms (BOM, CRLF, XLSX) are for export-sized selections: their row bound is checked before anything is
collected.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim

MOST = 100_000  # rows of a single-file export

# The layouts, header -> column.
LISTING = {"Company Name": "company_name", "Category": "category", "Business Type": "business_type", "Address": "address", "City": "city", "Region": "region", "Country": "country", "Postal Code": "postal_code", "Phone": "phone", "Website": "website", "Email": "email", "Email Status": "email_status", "Rating": "rating", "Review Count": "review_count", "Opening Status": "opening_status", "Booking URL": "booking_url", "Ordering URL": "ordering_url", "Menu URL": "menu_url", "Source URL": "source_url", "Place ID": "place_id", "Price Range": "price_range", "Imported At": "imported_at", "Source Query": "source_query", "Run ID": "run_id"}
ENRICHED = LISTING | {"Lead Score": "lead_score", "Quality Tier": "quality_tier", "Decision Maker": "decision_maker_name", "Decision Maker Title": "decision_maker_title", "Additional Emails": "additional_emails", "Additional Phones": "additional_phones", "LinkedIn": "linkedin", "Facebook": "facebook", "Instagram": "instagram", "People Count": "people_count"}
PEOPLE = {"Company Name": "company_name", "Name": "name", "Title": "title", "Email": "email", "Phone": "phone", "LinkedIn": "linkedin_url", "Website": "website"}


def cell(c: Column) -> Column:
    """A value as CSV: trimmed, quoted where it holds a comma, quote or line end; arrays joined by "; "."""
    t = js_trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def layout(leads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The layout's columns under their headers; columns that the leads lack are empty."""
    kinds = dict(leads.dtypes)
    one = lambda c: F.lit(None).cast("string") if c not in kinds else F.array_join(c, "; ") if kinds[c].startswith("array<string") else F.col(c).cast("string")
    return leads.select(*[one(c).alias(h) for h, c in columns.items()])


def csv_lines(leads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(line): each lead as a CSV line of the layout."""
    return layout(leads, columns).select(F.concat_ws(",", *[cell(F.col(f"`{h}`")) for h in columns]).alias("line"))


def people_rows(leads: DataFrame) -> DataFrame:
    """One row for each person of each lead, in the PEOPLE layout; a lead without people gives an empty person."""
    return layout(leads.select("company_name", "website", F.explode_outer("people").alias("p")).select("company_name", "website", "p.*"), PEOPLE)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a single-file export holds {MOST} rows at most; write csv_lines() with Spark instead")
    return rows


def csv_text(leads: DataFrame, columns: dict[str, str]) -> str:
    """A whole CSV file: byte-order mark, header, CRLF line ends."""
    return "﻿" + "".join(line + "\r\n" for line in [",".join(columns), *(r["line"] for r in _bounded(csv_lines(leads, columns)))])


def column_letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _sheet(headers: list[str], rows: list) -> str:
    def line(n: int, values) -> str:
        cells = "".join(f'<c r="{column_letters(i)}{n}" t="inlineStr"{" s=\"1\"" if n == 1 else ""}><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v or ""))}</t></is></c>' for i, v in enumerate(values))
        return f'<row r="{n}">{cells}</row>'

    body = "".join(line(n, r) for n, r in enumerate([headers, *rows], 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData><autoFilter ref="A1:{column_letters(len(headers) - 1)}{len(rows) + 1}"/></worksheet>'


def xlsx(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook of text cells (leading zeros stay), header rows in bold and frozen, with filters; stored, not packed."""
    names = list(sheets)
    main, rel, pkg = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    } | {f"xl/worksheets/sheet{i}.xml": _sheet(df.columns, _bounded(df)) for i, df in enumerate(sheets.values(), 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def export(leads: DataFrame, kind: str, enriched: bool) -> bytes:
    """The file of an export: csv or xlsx, in the listing or the enriched layout, only rows with something to contact."""
    from ..operators.leads import valid_for_export

    rows = leads.where(valid_for_export(*[F.col(c) for c in ("company_name", "website", "email", "phone")]))
    columns = ENRICHED if enriched else LISTING
    if kind == "csv":
        return csv_text(rows, columns).encode()
    if kind == "xlsx":
        sheets = {"Leads": layout(rows, columns)}
        return xlsx(sheets | {"People": people_rows(rows)} if enriched and "people" in leads.columns else sheets)
    raise ValueError(f"no export of kind {kind}")
