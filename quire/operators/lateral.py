"""Table functions for SQL: what a markdown book or an archive holds, row by row, by lateral join.

After `register(spark)`, `SELECT b.* FROM books, LATERAL markdown_blocks(source) b` has the rows of
`bookmd.blocks`, and `LATERAL archive_files(content)` those of `containers.unpacked`."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.functions import bookmd as M
from quire.sources.session import importable

BLOCK = ("chapter_no", "block_id", "parent_id", "ord", "kind", "level", "text", "marker", "items", "href", "alt", "form", "info")


@udtf(returnType="chapter_no int, block_id int, parent_id int, ord int, kind string, level int, text string, marker string, items array<string>, href string, alt string, form string, info string")
class MarkdownBlocks:
    def eval(self, source: str) -> Iterator[tuple]:
        for row in M.block_rows(M.parsed(source or "")):
            yield tuple(row[c] for c in BLOCK)


@udtf(returnType="path string, ord int, content binary, error string")
class ArchiveFiles:
    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                rows = [(i.filename, k, z.read(i), None) for k, i in enumerate(z.infolist()) if not i.is_dir()]
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, ValueError, EOFError, OSError) as e:
            rows = [(None, None, None, f"not a readable archive: {e}")]
        yield from rows


def register(spark: SparkSession) -> SparkSession:
    """Gives the session markdown_blocks(source) and archive_files(content)."""
    importable(spark)
    spark.udtf.register("markdown_blocks", MarkdownBlocks)
    spark.udtf.register("archive_files", ArchiveFiles)
    return spark
