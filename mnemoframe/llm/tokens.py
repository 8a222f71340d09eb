"""Encoding of texts with a public byte-level BPE (problem 6), over Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: The public pattern by which this family of byte-level BPE cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_table() -> dict[int, str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


@cache
def tokenizer(name: str, folder: str = TOKENIZER_DIR) -> Any:
    """The tokenizers-library tokenizer of a JSON file; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(folder, f"{name}.json")))
    t.encode_special_tokens = True
    return t


@cache
def sizer(name: str, folder: str = TOKENIZER_DIR) -> Any:
    """The same vocabulary as ranks, several times as fast, for sizes and offsets."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, f"{name}.tiktoken").read_bytes().splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(name: str, folder: str = TOKENIZER_DIR) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id, by the reversed byte table, and their numbers."""
    back = {c: b for b, c in byte_table().items()}
    vocabulary = tokenizer(name, folder).get_vocab(with_added_tokens=False)
    table = [b""] * (1 + max(vocabulary.values()))
    for s, i in vocabulary.items():
        if all(c in back for c in s):
            table[i] = bytes(back[c] for c in s)
    return table, np.array([len(x) for x in table], np.int64)


def raw_bytes(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    return b"".join(map(token_bytes(name, folder)[0].__getitem__, ids))


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    """The text of ids; a character of which only some bytes are there becomes U+FFFD."""
    return raw_bytes(ids, name, folder).decode("utf-8", "replace")


def offsets(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[np.ndarray, np.ndarray]:
    """Where each id begins and ends in the decoded text, in characters: a token holding part of one spans the whole of it."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(raw_bytes(ids, name, folder), np.uint8)
    ends = np.cumsum(token_bytes(name, folder)[1][ids])
    begins = np.concatenate([[0], ends[:-1]])
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    return upto[begins + 1] - 1, upto[ends]


def spans(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in offsets(ids, name, folder)), strict=True))


def budgets(table: DataFrame, use: str, name: str, columns: tuple[str, ...], most: int = 100_000) -> list[Row]:
    """The distinct budgets of a use and tokenizer; more than ``most`` are an error, none is left out."""
    rows = table.where((F.col("budget_use") == use) & (F.col("tokenizer") == name)).select(*columns).distinct()
    if (n := rows.count()) > most:
        raise ValueError(f"{n} budgets, more than {most}")
    return rows.collect()


def lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _encoder(name: str, folder: str, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = lists([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return run


def encode(df: DataFrame, id_column: str, text_column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk: int = 256) -> DataFrame:
    """Rows (id_column, ids); a null or empty text has an empty list. Rows, ids and copies are kept as they are."""
    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(id_column, text_column).mapInArrow(_encoder(name, folder, chunk), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, id_column: str, text_column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Rows (id_column, n_ids, n_chars, same): whether decoding gives the text again; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                covered = [int(offsets(i, name, folder)[1][-1]) if i else 0 for i in ids]
                same = [decode(i, name, folder) == x for i, x in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int32()), pa.array(covered, pa.int32()), pa.array(same)], names=["id", "n_ids", "n_chars", "same"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"id {kind}, n_ids int, n_chars int, same boolean").withColumnRenamed("id", id_column)
