"""Choosing filings for requests and resolving their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import blank_to_null, first_chars, head_slice, html_to_text, is_partial, trimmed
from ledgerline.operators.anchors import build_outline
from ledgerline.sources.staging import staged

HTML_CHARS, TEXT_CHARS, HEAD_CHARS = 8_000_000, 500_000, 500_000
#: Bodies that are parsed in one task at the least.
BODIES_PER_FILE = 500


def normalize_key(df: DataFrame, ticker: str = "ticker", form: str = "form_type") -> DataFrame:
    """Ticker and form upper-cased; the year stays text as it is."""
    return df.withColumns({ticker: F.upper(ticker), form: F.upper(form)})


def pick_filing(requests: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """requests, their key normalised, with accession, filing_date and match_kind: `year`, `latest` or `none`.

    The latest filing of the requested calendar year is taken, else the latest of all; equal dates go to the larger
    accession. Tickers and forms are alike whatever their case, on both sides. The catalog is reduced to one row for each (ticker, form), with the
    latest filing of each of its years, before it meets the requests: one equi-join on narrow rows, whatever the number of filings of a company.
    Requests without a ticker or form have no filing and never meet in the join. Columns of the catalog named by keep come with the filing, as `filed_*`.
    """
    filing = F.struct("filing_date", "accession", *(F.col(c).alias(f"filed_{c}") for c in keep))
    key = ["ticker", "form_type"]
    by_year = catalog.groupBy(*(F.upper(c).alias(c) for c in key), F.year("filing_date").alias("calendar_year")).agg(F.max(filing).alias("filing"))
    dated = F.collect_list(F.when(F.col("calendar_year").isNotNull(), F.struct("calendar_year", "filing")))
    by_key = by_year.groupBy(*key).agg(F.max("filing").alias("newest"), F.map_from_entries(dated).alias("years"))
    asked = normalize_key(requests)
    keyed = F.col("ticker").isNotNull() & F.col("form_type").isNotNull()
    met = asked.where(keyed).join(by_key, key, "left").withColumn("in_year", F.try_element_at("years", F.col("year").try_cast("int")))
    chosen = F.coalesce("in_year", "newest")
    kind = F.when(F.col("in_year").isNotNull(), "year").when(F.col("newest").isNotNull(), "latest").otherwise("none")
    found = {"accession": "accession", "filing_date": "filing_date"} | {f"filed_{c}": f"filed_{c}" for c in keep}
    picked = met.select(*requests.columns, *(chosen[c].alias(c) for c in found), kind.alias("match_kind"))
    none = {c: F.lit(None).cast(picked.schema[c].dataType) for c in found} | {"match_kind": F.lit("none")}
    return picked.unionByName(asked.where(~keyed).withColumns(none).select(*picked.columns))


def resolve_body(df: DataFrame, html_chars: int = HTML_CHARS, text_chars: int = TEXT_CHARS) -> DataFrame:
    """html as null if blank and else its first html_chars characters; text from text, html or markdown, whichever is first not blank."""
    html = first_chars(blank_to_null(F.col("html")), html_chars)
    own = F.nullif(trimmed(F.coalesce("text", F.lit(""))), F.lit(""))
    from_html = F.nullif(html_to_text(html), F.lit(""))
    text = F.coalesce(own, from_html, trimmed(F.coalesce("markdown", F.lit(""))))
    return df.withColumns({"html": html, "text": first_chars(text, text_chars)})


def filing_display(df: DataFrame, head_chars: int = HEAD_CHARS, lazy: bool = True) -> DataFrame:
    """display_html and html_partial: the head slice of long html."""
    html = F.col("html")
    return df.withColumns({"display_html": head_slice(html, head_chars, lazy), "html_partial": is_partial(html, head_chars, lazy)})


def attach(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows left-joined with found on key; rows whose key is null meet nothing, so they pass the join by. rows are read twice."""
    met = rows.where(F.col(key).isNotNull()).join(found, key, "left")
    return met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def in_folders(bodies: DataFrame, picked: DataFrame, folders: dict[str, str]) -> DataFrame:
    """The bodies that lie in folders of some pick; folders names a column of bodies, that they are partitioned by, for each of picked.

    The folders that picks name are far fewer than picks, at most as many as there are folders, so they are broadcast, and the scan of bodies leaves
    out all others before it reads a file (dynamic partition pruning).
    """
    named = picked.where("match_kind <> 'none'").select(*(F.col(own).alias(c) for own, c in folders.items())).distinct()
    return bodies.join(F.broadcast(named), list(folders.values()), "left_semi")


def filing_pack(requests: DataFrame, catalog: DataFrame, bodies: DataFrame, *, body_key: str = "accession", head_chars: int = HEAD_CHARS, folders: tuple[str, ...] = (), shown_as: dict[str, Column] | None = None) -> DataFrame:
    """One row a request: its filing, text, display html, partial flag and anchors.

    Filings are picked on narrow rows; then the bodies (body_key, html, text, markdown) that were picked are read, each once however
    often it was asked for, and resolved once; outlines are made from what that wrote, and whole bodies are shuffled only to meet
    their requests. A catalog in which several filings share a body names it by body_key. Where catalog and bodies both have the
    columns that bodies are partitioned by (write_filings: form_type and filing_year), folders names them: other folders are not read.

    A caller that needs no whole texts says what it wants of text, display_html and html_partial in shown_as, by name: that is worked out once a
    body, and only that meets the requests, in place of the three.
    """
    shared = () if body_key == "accession" else (body_key,)
    picked = pick_filing(requests, catalog, (*shared, *folders))
    picked = staged(picked.withColumnRenamed(f"filed_{body_key}", body_key))
    near = in_folders(bodies, picked, {f"filed_{c}": c for c in folders}) if folders else bodies
    picked = picked.drop(*(f"filed_{c}" for c in folders))
    wanted = near.select(body_key, "html", "text", "markdown").join(picked.select(body_key).where(F.col(body_key).isNotNull()).distinct(), body_key, "left_semi")
    read = staged(resolve_body(wanted).drop("markdown"), compression="zstd", rows_per_file=BODIES_PER_FILE)
    anchor = F.struct("place", "id", "label", "level", "source")
    outline = build_outline(read.select(body_key, "html"), body_key).groupBy(body_key).agg(F.array_sort(F.collect_list(anchor)).alias("anchors"))
    wanted_of_body = {c: F.col(c) for c in ("text", "display_html", "html_partial")} if shown_as is None else shown_as
    shown = filing_display(read, head_chars).select(body_key, *(column.alias(name) for name, column in wanted_of_body.items()))
    return attach(picked, shown.join(outline, body_key, "left"), body_key)
