"""ZIP archives written by the tasks that hold their entries."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

from tradeloom import ship_with_tasks
from tradeloom.sources.files import store_of

ship_with_tasks(__name__)


def write_archives(entries: DataFrame, path: str) -> DataFrame:
    """One archive per ``archive`` name below ``path`` from ``entry_no, entry, content`` rows; lists what was written.

    An archive's entries meet in one task, which is what the format asks for. A repeated
    task writes the same file again.
    """

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("entry_no")
        name, buffer = group["archive"][0].as_py(), io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for entry, content in zip(group["entry"].to_pylist(), group["content"].to_pylist(), strict=True):
                archive.writestr(zipfile.ZipInfo(entry), content)
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(buffer.getvalue())
        return pa.table({"archive": [name], "entries": [len(group)]})

    return entries.groupBy("archive").applyInArrow(write, "archive string, entries bigint")
