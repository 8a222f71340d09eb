"""JSON, JSON Lines and other file sources and sinks, integrity of data sets, and sizes of stored files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON value per file; a malformed file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, anything else that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Create-only, with columns in sorted order."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned and clustered by columns, so that later scans prune by them; a hot value is spread over files by adaptive execution."""
    df.hint("rebalance", *by).write.partitionBy(*by).mode("errorifexists").parquet(path)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(path: str | Path, text: bool = False) -> str:
    """SHA-256 of a file, read in blocks; as text, line ends count as LF."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        held = b""
        while block := f.read(1 << 20):
            if text:
                block = held + block
                held = b"\r" if block.endswith(b"\r") else b""
                block = block[: len(block) - len(held)].replace(b"\r\n", b"\n")
            h.update(block)
        h.update(held)
    return h.hexdigest()


def verify_manifest(folder: str | Path) -> list[str]:
    """Names in ``manifest.json``'s ``files`` (name to SHA-256) that are missing or differ."""
    base = Path(folder)
    files = json.loads((base / "manifest.json").read_text())["files"]
    return sorted(n for n, want in files.items() if not (base / n).is_file() or digest(base / n, text=n.endswith((".json", ".jsonl", ".md"))) != want)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every file below a path, by the cluster's own listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"))


def markdown(df: DataFrame, title: str, most: int = 100_000) -> str:
    """A report table, streamed to the driver; more than ``most`` rows are an error, none is left out."""
    if (n := df.count()) > most:
        raise ValueError(f"{n} rows, more than {most}")
    cell = lambda x: "" if x is None else str(x).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    rows: Iterable[Any] = df.toLocalIterator()
    line = lambda xs: "| " + " | ".join(map(cell, xs)) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), "|" + " - |" * len(df.columns), *map(line, rows)]) + "\n"
