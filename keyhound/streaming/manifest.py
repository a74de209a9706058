"""Following a file tree with a manifest: what is new since the last run, with state no larger than the tree.

The manifest is a table of path, length and modification time of the files that were handed out, as the tree
held them at the last run.  A run lists the tree, takes what the manifest does not have, hands it over, and
replaces the manifest by the listing: files that are gone leave it, and come again when they return.  A run
that fails before its end changes nothing, so its files are handed over again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.session import written
from keyhound.sources.corpus import SETTLE_MS, VERSION, list_corpus
from keyhound.sources.filesystem import open_root

_VERSION_NAME = "manifest-{:012d}"


class Manifest:
    """Versions of the table in one folder; the last finished one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self) -> list[int]:
        filesystem, inner = open_root(self.folder)
        found = filesystem.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        finished = [x for x in found if filesystem.get_file_info(f"{x.path}/_SUCCESS").type == fs.FileType.File]
        return sorted(int(x.base_name.rpartition("-")[2]) for x in finished if x.base_name.startswith("manifest-"))

    def _path(self, version: int) -> str:
        return f"{self.folder.rstrip('/')}/{_VERSION_NAME.format(version)}"

    def seen(self) -> DataFrame:
        """``path, length, modified`` of the files handed out and still there."""
        versions = self._versions()
        schema = "path STRING, length BIGINT, modified BIGINT"
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(versions[-1]))

    def replace(self, listing: DataFrame) -> None:
        """Write the next version, then remove all before the last one, which a reader may still have open."""
        versions = self._versions()
        listing.select(*VERSION).write.mode("overwrite").parquet(self._path(versions[-1] + 1 if versions else 0))
        filesystem, _ = open_root(self.folder)
        for old in versions[:-1]:
            filesystem.delete_dir(open_root(self._path(old))[1])


def follow_corpus(
    spark: SparkSession,
    root: str,
    folder: str,
    handle: Callable[[DataFrame], None],
    excluded: Sequence[str] = (),
    settle_ms: int = SETTLE_MS,
) -> DataFrame:
    """One run: ``handle`` gets path and length of files that are new or changed since the last run with ``folder``.

    Files changed less than ``settle_ms`` ago wait for the next run.  Returns what was handed over.
    """
    manifest = Manifest(spark, folder)
    now = F.lit(int(spark.sql("SELECT unix_millis(current_timestamp())").first()[0]))
    millis = F.col("modified") / 1_000_000
    settled = ~((millis > now - settle_ms) & (millis <= now))
    listing = written(list_corpus(spark, root, excluded, with_versions=True).filter(settled), "listing")
    new = written(listing.join(manifest.seen(), VERSION, "left_anti").select("path", "length"), "new-files")
    handle(new)
    manifest.replace(listing)
    return new
