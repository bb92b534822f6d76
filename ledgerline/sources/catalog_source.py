"""A filing archive as a data source of its own: `spark.read.format("filing_catalog")`, and as a stream of new filings.

Reads what sources.tables.write_filings() writes: Parquet files in folders by form_type and filing_year. Equalities and IN lists on ticker, form_type and filing_year
are pushed down (Spark asks for it with spark.sql.python.filterPushdown.enabled): folders that do not fit are not opened, and rows of other tickers
are skipped by the files' statistics before they leave the reader. A partition is a group of row groups of one file, so that
a large file is read by several tasks.

Load the source anew for each query: Spark keeps the filters that it pushed into a relation, so a second query on the same DataFrame may be given the
rows of the first one's filters.

Options: `path`, in any file system that pyarrow opens; `bodies` (`false` leaves html, text and markdown unread); `rowgroups`, those of a partition.

As a stream, the offset is the newest filing (date, then accession): each batch has the filings beyond the last offset, each once. A filing
that is added later with an older date than the newest one is not new. For archives that Spark alone can open, read the folder as Parquet.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

BODIES = ("html", "text", "markdown")
FOLDERS = ("form_type", "filing_year")
PUSHED = ("ticker", *FOLDERS)
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_KINDS = {"accession": pa.int64(), "filing_date": pa.date32(), "filing_year": pa.int32()}


@dataclass
class Piece(InputPartition):
    """Row groups of a file, the folders that it lies in, and the filings of it that are wanted."""

    path: str
    groups: tuple[int, ...]
    form_type: str | None
    filing_year: int | None
    after: tuple[str, int] | None = None
    upto: tuple[str, int] | None = None


class Archive:
    """The files of an archive and what is read of them."""

    def __init__(self, options, schema: T.StructType):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (pafs.LocalFileSystem(), options["path"])
        self.columns = schema.names
        self.groups = int(options.get("rowgroups", "1"))

    def files(self, wanted: dict[str, set]) -> Iterator[tuple[str, str | None, int | None]]:
        """(path, form_type, filing_year) of the files in folders that fit."""
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda i: i.path):
            parts = info.path[len(self.root) :].strip("/").split("/")
            if info.type != pafs.FileType.File or any(p.startswith(("_", ".")) for p in parts):
                continue
            folder = {k: None if v == NO_VALUE else unquote(v) for k, _, v in (p.partition("=") for p in parts[:-1])}
            form, year = folder.get("form_type"), folder.get("filing_year")
            year = int(year) if year is not None else None
            if form in wanted.get("form_type", {form}) and year in wanted.get("filing_year", {year}):
                yield info.path, form, year

    def pieces(self, wanted: dict[str, set], **span) -> list[Piece]:
        out = []
        for path, form, year in self.files(wanted):
            groups = range(pq.read_metadata(path, filesystem=self.fs).num_row_groups)
            out += [Piece(path, tuple(groups[k : k + self.groups]), form, year, **span) for k in range(0, len(groups), self.groups)]
        return out

    def read(self, piece: Piece, tickers: set | None) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(piece.path, filesystem=self.fs)
        at = file.schema_arrow.names.index("ticker")
        groups = [g for g in piece.groups if tickers is None or _may_hold(file.metadata.row_group(g).column(at).statistics, tickers)]
        stored = [c for c in self.columns if c not in FOLDERS]
        asked = list(dict.fromkeys((*stored, "ticker", "accession", "filing_date")))
        for batch in file.iter_batches(batch_size=512, row_groups=groups, columns=asked) if groups else ():
            keep = pa.array([True] * batch.num_rows)
            if tickers is not None:
                keep = pc.and_(keep, pc.is_in(batch["ticker"], pa.array(sorted(tickers), pa.string())))
            for edge, beyond in ((piece.after, True), (piece.upto, False)):
                if edge is not None:
                    day, number = pa.scalar(dt.date.fromisoformat(edge[0])), pa.scalar(edge[1], pa.int64())
                    later = pc.or_(pc.greater(batch["filing_date"], day), pc.and_(pc.equal(batch["filing_date"], day), pc.greater(batch["accession"], number)))
                    keep = pc.and_(keep, pc.fill_null(later if beyond else pc.invert(later), False))
            batch = batch.filter(keep)
            folders = {"form_type": piece.form_type, "filing_year": piece.filing_year}
            columns = [pa.array([folders[c]] * batch.num_rows, _KINDS.get(c, pa.string())) if c in folders else batch[c].cast(_KINDS.get(c, pa.string())) for c in self.columns]
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)


def _may_hold(statistics, values: set) -> bool:
    return statistics is None or not statistics.has_min_max or any(statistics.min <= v <= statistics.max for v in values)


class CatalogReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.archive, self.wanted = Archive(options, schema), {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values - {None}
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.archive.pieces(self.wanted)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an archive without files has one partition without a piece
            yield from self.archive.read(partition, self.wanted.get("ticker"))


class CatalogStream(DataSourceStreamReader):
    """New filings: an offset is the newest filing so far."""

    def __init__(self, options, schema: T.StructType):
        self.archive, self.newest = Archive(options, schema), {"filing_date": "0001-01-01", "accession": -(2**63)}

    def initialOffset(self) -> dict:
        return {"filing_date": "0001-01-01", "accession": -(2**63)}

    def latestOffset(self) -> dict:
        """Reads dates and accessions of the newest year's files alone, and of those only what is beyond the last offset."""
        known = (self.newest["filing_date"], self.newest["accession"])
        files = [(year, path) for path, _, year in self.archive.files({}) if year is not None and year >= int(known[0][:4])]
        last = max((year for year, _ in files), default=None)
        for year, path in files:
            if year == last:
                narrow = pq.ParquetFile(path, filesystem=self.archive.fs).read(columns=["filing_date", "accession"])
                day = pc.max(narrow["filing_date"]).as_py()
                if day is not None:
                    number = pc.max(narrow.filter(pc.equal(narrow["filing_date"], pa.scalar(day)))["accession"]).as_py()
                    known = max(known, (day.isoformat(), number))
        self.newest = {"filing_date": known[0], "accession": known[1]}
        return self.newest

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        years = set(range(int(start["filing_date"][:4]), int(end["filing_date"][:4]) + 1))
        span = {"after": (start["filing_date"], start["accession"]), "upto": (end["filing_date"], end["accession"])}
        return self.archive.pieces({"filing_year": years}, **span)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from self.archive.read(partition, None)


class FilingCatalog(DataSource):
    """Register with spark.dataSource.register(FilingCatalog)."""

    @classmethod
    def name(cls) -> str:
        return "filing_catalog"

    def schema(self) -> str:
        bodies = "" if self.options.get("bodies", "true").lower() == "false" else "html string, text string, markdown string, "
        return f"accession long, ticker string, filing_date date, {bodies}form_type string, filing_year int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CatalogReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return CatalogStream(self.options, schema)
