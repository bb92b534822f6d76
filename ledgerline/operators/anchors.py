"""From elements of html to the ordered outline of a document: relational steps on narrow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import case_folded, collapsed, is_bare_item_label, is_item_line, item_heading, item_key, item_rank, slugify, trimmed
from ledgerline.operators.nodes import LABEL_CHARS, anchor_elements

MAX_ANCHORS = 320
# The passes of an outline, characters of a slug's input, and of an item line that is a label.
TOC, HEADING, ITEM = 1, 2, 4
HEADING_SLUG_CHARS, ITEM_SLUG_CHARS, ITEM_LABEL_CHARS = 200, 48, 160
ITEM_PREFIX = "sec-item-"


def _numbered(rows: DataFrame, id_col: str, base: Column, prefix: Column) -> DataFrame:
    """rows with made: prefix and base, numbered from the second use of the base within document and pass; null where base is."""
    uses = F.row_number().over(Window.partitionBy(id_col, "pass", "_base").orderBy("seq"))
    counted = rows.withColumn("_base", base).withColumn("_use", F.when(F.col("_base").isNotNull(), uses))
    made = F.concat(prefix, "_base", F.when(F.col("_use") > 1, F.concat(F.lit("-"), "_use")).otherwise(""))
    return counted.withColumn("made", made).drop("_base", "_use")


def heading_ids(headings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """headings (id, seq, own_id, label) with anchor: the own id, else the label's slug, numbered from its second use in the document."""
    own = F.nullif(trimmed(F.coalesce("own_id", F.lit(""))), F.lit(""))
    base = F.when(own.isNull(), slugify(F.substring("label", 1, HEADING_SLUG_CHARS)))
    numbered = _numbered(headings.withColumn("pass", F.lit(HEADING)), id_col, base, F.lit(""))
    return numbered.withColumn("anchor", F.coalesce(own, "made")).drop("pass", "made")


def anchor_rows(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """Raw anchors of every document: (id, pass, seq, anchor id, label, level, source), repeated ids included, blank ones not.

    Links come first; one with a bare item label takes the heading that its target's row, or else the target, begins with. Headings without
    an id are named by their slug. Item lines come last; one whose id an earlier anchor has gives none. An outline shuffles these rows once,
    by document, and its html never.
    """
    found = anchor_elements(pages, id_col, html_col).repartition(id_col)
    number = F.when(F.col("tag") == "a", TOC).when(F.col("tag").rlike("^h[1-6]$"), HEADING).otherwise(ITEM)
    rows = found.withColumns({"pass": number, "own": F.nullif(trimmed(F.col("own_id")), F.lit(""))})
    rows = rows.where((F.col("pass") == TOC) | ((F.col("pass") == HEADING) & (F.col("text") != "")) | ((F.col("pass") == ITEM) & is_item_line(F.col("text"))))
    # An anchor is taken if an earlier one has its id: a link's or a heading's, or that of an item line above.
    first = F.min(F.when(F.col("own").isNotNull(), F.struct("pass", "seq"))).over(Window.partitionBy(id_col, "own"))
    taken = (F.col("pass") == ITEM) & F.col("own").isNotNull() & (F.struct("pass", "seq") > F.col("_first"))
    rows = rows.withColumn("_first", first).where(~F.coalesce(taken, F.lit(False)))
    slug = F.when((F.col("pass") == HEADING) & F.col("own").isNull(), slugify(F.substring("text", 1, HEADING_SLUG_CHARS)))
    slug = slug.when(F.col("pass") == ITEM, slugify(F.substring("text", 1, ITEM_SLUG_CHARS)))
    rows = _numbered(rows, id_col, slug, F.when(F.col("pass") == ITEM, ITEM_PREFIX).otherwise(""))
    made = F.when((F.col("pass") == HEADING) | (F.coalesce("own_id", F.lit("")) == ""), F.col("made"))  # an item line whose id is blank gives none
    label = F.when(F.col("pass") == ITEM, F.substring("text", 1, ITEM_LABEL_CHARS)).otherwise(F.col("text"))
    rich = F.coalesce(item_heading(F.col("around")), item_heading(F.col("target")))
    linked = F.when(is_bare_item_label(F.col("text")), F.coalesce(rich, "text")).otherwise(F.col("text"))
    # Texts of elements are collapsed, but may be cut at a space; a link may have a fragment in place of a text.
    label = F.when(F.col("pass") == TOC, F.substring(collapsed(linked), 1, LABEL_CHARS)).otherwise(F.trim(label))
    level = F.when(F.col("pass") == TOC, 2).when(F.col("pass") == HEADING, F.substring("tag", 2, 1).try_cast("int")).otherwise(1)
    source = F.when(F.col("pass") == TOC, "toc").when(F.col("pass") == HEADING, "heading").otherwise("item")
    named = rows.select(id_col, "pass", "seq", F.coalesce("own", made).alias("id"), label.alias("label"), level.alias("level"), source.alias("source"))
    return named.where("id IS NOT NULL").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "id"))


def first_wins(anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first anchor of each id in a document, by pass and place; partial aggregation, no sort of whole documents."""
    rest = [c for c in anchors.columns if c not in (id_col, "id")]
    first = F.min_by(F.struct(*rest), F.struct("pass", "seq")).alias("first")
    return anchors.groupBy(id_col, "id").agg(first).select(id_col, "id", "first.*")


def with_item_keys(anchors: DataFrame) -> DataFrame:
    """anchors with item_key and item_rank (null for what is no item)."""
    return anchors.withColumn("item_key", item_key(F.col("label"))).withColumn("item_rank", F.when(F.col("item_key").isNotNull(), item_rank(F.col("item_key"))))


def _merged(anchors: DataFrame, id_col: str) -> DataFrame:
    """anchors with first_pass and first_seq, merged as merge_items says; anchors of no item stay as they are. One pass over the rows."""
    keyed = F.col("item_key").isNotNull()
    label = F.when(keyed, collapsed(F.col("label")))
    own = Window.partitionBy(id_col, "item_key")
    best = own.orderBy(F.length(label).desc(), label.rlike("[a-z]").desc(), case_folded(label), "pass", "seq")
    placed = anchors.withColumns({"_place": F.row_number().over(best), "_first": F.min(F.when(keyed, F.struct("pass", "seq"))).over(own)})
    kept = placed.where(~keyed | (F.col("_place") == 1))
    return kept.select(*anchors.columns, F.coalesce("_first.pass", "pass").alias("first_pass"), F.coalesce("_first.seq", "seq").alias("first_seq"))


def merge_items(anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the anchors of one item in a document, the one with the richest label, with first_pass and first_seq of the item's first.

    Longer labels are richer; of equal length, one with a lower-case letter; then the smaller when case is folded; then the earlier.
    """
    return _merged(anchors.where("item_key IS NOT NULL"), id_col)


def ordered_outline(anchors: DataFrame, id_col: str = "doc_id", max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """(id, place, anchor id, label, level, source, item_key, display): others in push order, then items by rank, the first max_anchors."""
    merged = _merged(with_item_keys(first_wins(anchors, id_col)), id_col)
    order = Window.partitionBy(id_col).orderBy(F.coalesce("item_rank", F.lit(-1)), "first_pass", "first_seq")
    placed = merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_anchors)
    display = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), "label")
    return placed.select(id_col, "place", "id", "label", "level", "source", "item_key", display.alias("display"))


def build_outline(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html", max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """The outline of every document; only its anchor elements are shuffled, once, never its html."""
    return ordered_outline(anchor_rows(pages, id_col, html_col), id_col, max_anchors)
