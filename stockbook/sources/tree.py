"""Listing and reading the files below a folder, in tasks.

Folders are rows: each task lists its folders and what it finds in them, up to STEP of them, and hands the rest back as
rows that the next round deals out to all tasks; so wide trees spread after the first round and deep ones need few
rounds. Every round is written, so a lost executor costs one. Names may hold anything; links are never followed.
Executors must see the folder under the same path, as with any path without a store of its own.
"""

from __future__ import annotations

import os
from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockbook.shared import settled

#: Folders that a task lists in one round, and bytes of contents that one task reads and one batch holds.
STEP, TASK_BYTES, BATCH_BYTES = 1000, 32 << 20, 4 << 20
_FOUND = pa.schema([("kind", pa.string()), ("raw", pa.binary()), ("path", pa.string()), ("size", pa.int64())])


def _expand(top: bytes, step: int):
    """Rows of files, of folders that are still to be listed, and of folders that can't be."""

    def run(batches):
        left = step
        for batch in batches:
            todo, rows = deque(batch.column("raw").to_pylist()), []
            while todo and left > 0:
                folder = todo.popleft()
                left -= 1
                try:
                    with os.scandir(folder) as entries:
                        inside = sorted(entries, key=lambda e: e.name)
                except OSError:
                    if folder == top:
                        raise
                    rows.append(("error", folder, 0))
                    continue
                for e in inside:
                    if folder == top and e.name == b".git" or e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        todo.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        rows.append(("file", e.path, e.stat(follow_symlinks=False).st_size))
            rows += [("folder", f, 0) for f in todo]
            rows = [(kind, raw, raw[len(top.rstrip(b"/")) + 1 :].decode("utf-8", "replace"), size) for kind, raw, size in rows]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    return run


def list_tree(spark: SparkSession, root: str, step: int = STEP) -> DataFrame:
    """(raw, path, size, readable): all regular files below root but for its own .git, and folders that can't be listed
    (not readable). raw is the place as bytes, path is below root, with what is no UTF-8 replaced. Links are left out."""
    top = os.fsencode(os.path.abspath(root))
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(top,)], "raw binary")
    rounds = []
    while True:
        found = settled(level.mapInArrow(_expand(top, step), "kind string, raw binary, path string, size long"))
        rounds.append(found.where("kind <> 'folder'"))
        level = found.where("kind = 'folder'").select("raw")
        if level.isEmpty():
            break
        level = level.repartition(tasks)
    all_ = reduce(lambda a, b: a.unionByName(b), rounds)
    return all_.select("raw", F.translate("path", "\\", "/").alias("path"), "size", (F.col("kind") == "file").alias("readable"))


def _contents(batches):
    """Contents of the files, as text; null for those that can't be read (any more)."""
    for batch in batches:
        paths, texts, size = [], [], 0

        def full(paths, texts):
            return pa.record_batch([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

        for raw, path, readable in zip(*[batch.column(c).to_pylist() for c in ("raw", "path", "readable")], strict=True):
            data = None
            if readable:
                try:
                    with open(raw, "rb") as file:
                        data = file.read()
                except OSError:
                    data = None
            paths.append(path)
            texts.append(None if data is None else data.decode("utf-8", "replace"))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield full(paths, texts)
                paths, texts, size = [], [], 0
        if paths:
            yield full(paths, texts)


def read_contents(listing: DataFrame) -> DataFrame:
    """(path, content) of the files of a listing, dealt out so that a task reads about TASK_BYTES; a larger file is a batch of its own."""
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    tasks = min(max(total["bytes"] // TASK_BYTES, listing.sparkSession.sparkContext.defaultParallelism), max(total["files"], 1))
    return listing.select("raw", "path", "readable").repartition(int(tasks)).mapInArrow(_contents, "path string, content string")
