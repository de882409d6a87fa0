"""A cursor-paginated source as a Spark data source; pages come from a folder of landed responses.

A registry's pages depend on one another through cursors, so one partition reads them in order. It fails if a cursor
repeats, if a page is missing or malformed, or if the registry's version changed between the first and last page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class PagedStudies(DataSource):
    """Options: path, max_studies. The folder holds version.json, version_after.json (optional), first.json and one
    file per cursor, <cursor>.json."""

    @classmethod
    def name(cls) -> str:
        return "paged_studies"

    def schema(self) -> str:
        return "position long, page long, study string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("max_studies", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = Path(self.folder)
        load = lambda name: json.loads((folder / f"{name}.json").read_text())
        seen, cursor, position, number, rows = set(), "first", 0, 0, []
        while cursor:
            page = load(cursor)
            studies = page.get("studies")
            if not isinstance(studies, list) or not all(isinstance(s, dict) for s in studies):
                raise ValueError(f"invalid page {cursor}")
            for s in studies:
                if self.most and position >= self.most:
                    break
                rows.append((position, number, json.dumps(s, sort_keys=True)))
                position += 1
            if self.most and position >= self.most:
                break
            cursor = page.get("nextPageToken")
            if cursor is not None and (not isinstance(cursor, str) or not cursor):
                raise ValueError("invalid cursor")
            if cursor in seen:
                raise ValueError(f"repeated cursor {cursor}")
            seen.add(cursor)
            number += 1
        identity = lambda v: (v.get("apiVersion"), v.get("dataTimestamp"))
        after = folder / "version_after.json"
        if after.exists() and identity(load("version")) != identity(load("version_after")):
            raise ValueError("the registry changed while it was read")
        yield from rows
