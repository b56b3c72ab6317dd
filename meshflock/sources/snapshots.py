"""Checksum-verified restore of compressed snapshots: all are checked before any is written."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def contents(spark: SparkSession, folder: str, name: str = "*.gz") -> DataFrame:
    """(path, packed, raw, bytes): digests of the packed files and of what they hold."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packed = content.as_py()
                try:
                    raw = gzip.decompress(packed)
                except (OSError, EOFError):
                    raw = b""
                yield pa.RecordBatch.from_pydict({"path": [path], "packed": [hashlib.sha256(packed).hexdigest()], "raw": [hashlib.sha256(raw).hexdigest()], "bytes": [len(raw)]})

    files = spark.read.format("binaryFile").load(f"{folder}/{name}").select("path", "content")
    return files.mapInArrow(run, "path string, packed string, raw string, bytes long")


def restore(spark: SparkSession, folder: str, out: str, files: list[dict], verify_only: bool = False) -> list[str]:
    """``files``: name (of the .gz in ``folder``), target, sha256 (packed), raw_sha256, bytes.

    Targets must stay inside ``out``. One that exists stays if it holds what is expected and is
    an error if not. The driver gets digests of all files, and the content of one at a time."""
    root = Path(out).resolve()
    found = {Path(r.path).name: r for r in contents(spark, folder).collect()}
    targets, missing = [], []
    for f in files:
        target = (root / f["target"]).resolve()
        if not target.is_relative_to(root):
            raise ValueError(f"{f['target']} leaves {root}")
        got = found.get(f["name"])
        if got is None or (got.packed, got.raw, got.bytes) != (f["sha256"], f["raw_sha256"], f["bytes"]):
            raise ValueError(f"{f['name']} is not the expected file")
        if not target.exists():
            missing.append((target, f["name"]))
        elif hashlib.sha256(target.read_bytes()).hexdigest() != f["raw_sha256"]:
            raise FileExistsError(target)
        targets.append(str(target))
    for target, name in [] if verify_only else missing:
        packed = spark.read.format("binaryFile").load(f"{folder}/{name}").select("content").first()[0]
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("xb") as handle:
            handle.write(gzip.decompress(bytes(packed)))
    return targets
