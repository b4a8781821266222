"""What a source is, and how it is written in one string."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

FILES = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}


@dataclass(frozen=True)
class Source:
    kind: str  # csv, parquet, json, orc, table, sql or mongo
    name: str
    uri: str = ""
    database: str | None = None
    staging_uri: str | None = None
    split_by: str | None = None  # of a table behind JDBC: the numeric column that its reads are split by

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.name}"


def parse(spec: str) -> Source:
    """A path by its ending, table:<name>, <jdbc url>::<table>, or mongodb://...::<database>.<collection>.

    A table behind JDBC may end in #<column>, a numeric one that splits its rows over tasks.
    """
    text = spec.strip()
    if text.startswith("table:") and text[6:]:
        return Source("table", text[6:])
    if "::" in text:
        uri, _, name = text.rpartition("::")
        if re.match(r"mongo(db(\+srv)?|mock)://", uri):
            database, dot, collection = name.partition(".")
            if not (dot and database and collection):
                raise ValueError(f"{spec!r} should end in <database>.<collection>")
            return Source("mongo", collection, uri, database)
        if uri and name:
            name, _, split = name.partition("#")
            return Source("sql", name, uri, split_by=split or None)
    stem, ending = os.path.splitext(text.rstrip("/"))
    if ending.lower() in FILES and stem:
        return Source(FILES[ending.lower()], os.path.basename(stem), text)
    raise ValueError(f"{spec!r} is no source")


def redacted(uri: str) -> str:
    """A URL without its password."""
    return re.sub(r"(://[^:/@]+):[^@]*@", r"\1:***@", re.sub(r"(?i)(password=)[^&;]*", r"\1***", uri))
