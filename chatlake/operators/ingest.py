"""S1 + S2 + S5 + D10: one call from a folder of note files to a stored archive.

Every file is known by its path and a digest of its bytes, kept in the table
``note_files`` that is written in the same batch as the rows made from it.  A
file that is known is skipped by an anti join before it is parsed; a file whose
bytes have changed replaces what was made from it.  A call that crashed is
simply repeated: what it staged is finished or was never seen, so nothing is
added twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.dataset import read_table
from chatlake.operators import store
from chatlake.plans.publish import Batch, recover
from chatlake.plans.staging import staged
from chatlake.sources import org_notes

FILES = "note_files"


@dataclass
class Ingested:
    """Counts of one call, and the rejected files with a reason each."""

    files: int
    skipped: int
    replaced: int
    conversations: int
    messages: int
    rejected: DataFrame


def ingest_archive(spark: SparkSession, directory: str, root: str, clear: bool = False,
                   dedupe: str | None = "file") -> Ingested:
    """Read every note file of ``directory`` into the archive at ``root``, daily figures included.

    ``clear`` empties the archive first.  ``dedupe="file"`` skips files that the
    archive has and replaces those that have changed; ``None`` adds all files
    again, as the reference does.  Rejected files are not remembered, so a later
    call tries them again.
    """
    if dedupe not in ("file", None):
        raise ValueError("dedupe is 'file' or None")
    recover(spark, root)
    if clear:
        store.clear(spark, root)
        batch = Batch(spark, root)
        batch.replace(FILES, spark.createDataFrame([], "file_path string, digest string"))
        batch.publish()
    todo = org_notes.scan_note_files(spark, directory).withColumn("digest", F.sha2("raw", 256))
    known = read_table(spark, root, FILES)
    skipped = replaced = 0
    if known is not None and dedupe:
        # One row per file and no content: staged, as the table itself may be replaced below.
        known = staged(known, "known")
        # One scan of the folder; known files leave their bytes behind.
        seen = todo.join(known.distinct().withColumn("seen", F.lit(True)), ["file_path", "digest"], "left")
        found = staged(seen.withColumn("raw", F.when(F.col("seen").isNull(), F.col("raw"))), "scanned")
        skipped = found.where("seen").count()
        todo = found.where("seen is null").drop("seen")
        changed = todo.where("digest is not null").join(known, "file_path", "left_semi").select("file_path")
        replaced = changed.count()
        if replaced:
            _forget(spark, root, changed, known)
    else:
        todo = staged(todo, "scanned")
    convs, msgs, bad_names = org_notes.ingest_texts(org_notes.texts_of(todo))
    rejected = staged(todo.where("reason is not null").select("file_path", "reason").unionByName(bad_names), "rejected")
    read = staged(todo.join(rejected, "file_path", "left_anti").select("file_path", "digest"), "read")
    # Messages come from tables that are staged already: counted without their text, written once.
    convs = staged(convs, "conversations")
    done = Ingested(read.count(), skipped, replaced, convs.count(), msgs.count(), rejected)
    if done.files:
        store.append_conversations(spark, root, convs, msgs, also={FILES: read})
    return done


def _forget(spark: SparkSession, root: str, changed: DataFrame, known: DataFrame) -> None:
    """Remove what was made from changed files, and their digests, in one batch."""
    batch = Batch(spark, root)
    batch.replace(FILES, known.join(changed, "file_path", "left_anti").select(*known.columns))
    gone = read_table(spark, root, "conversations").join(changed, "file_path", "left_semi").select(
        F.col("id").alias("conversation_id"))
    store.remove_conversations(spark, root, gone, batch)
