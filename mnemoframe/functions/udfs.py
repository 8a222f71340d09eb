"""Functions that have no JVM form: Arrow-batched Python."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, StringType, StructField, StructType

WIDTH = 1024


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed; null stays null."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, UTF-8; null if it is not JSON."""

    def one(t: str) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def features(text: str) -> list[str]:
    """Words, and character 2- and 3-grams within them, of the normalised text."""
    words = re.findall(r"\w+", unicodedata.normalize("NFKC", text).lower().strip())
    return [*words, *(w[k : k + n] for w in words for n in (2, 3) for k in range(len(w) - n + 1))]


def embed(text: str, width: int = WIDTH) -> np.ndarray:
    """Signed feature hashing by SHA-256, scaled to unit length; zeros for a text without words."""
    out = np.zeros(width)
    for f in features(text):
        h = hashlib.sha256(f.encode()).digest()
        out[int.from_bytes(h[:4], "big", signed=True) % width] += 1 if h[4] & 1 else -1
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def hash_embedding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: embed(t or "").tolist())


def differences(a: Any, b: Any, path: str = "$") -> list[str]:
    """Sorted paths at which two JSON values differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return sorted(p for k in a.keys() | b.keys() for p in ([f"{path}.{k}"] if k not in a or k not in b else differences(a[k], b[k], f"{path}.{k}")))
    if isinstance(a, list) and isinstance(b, list):
        same = [p for k, (x, y) in enumerate(zip(a, b, strict=False)) for p in differences(x, y, f"{path}[{k}]")]
        return sorted([*same, *(f"{path}[{k}]" for k in range(min(len(a), len(b)), max(len(a), len(b))))])
    return [] if type(a) is type(b) and a == b else [path]


@F.pandas_udf(ArrayType(StringType()))
def json_differences(left: pd.Series, right: pd.Series) -> pd.Series:
    """The paths at which two JSON texts differ; ``$`` if either is not JSON and they are not equal."""

    def one(a: str | None, b: str | None) -> list[str]:
        if a == b:
            return []
        try:
            return differences(json.loads(a), json.loads(b))
        except (TypeError, ValueError):
            return ["$"]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


class StrictError(ValueError):
    def __init__(self, code: str, path: str) -> None:
        super().__init__(f"{code} at {path}")
        self.code, self.path = code, path


# The decoder's bounds on depth, nodes, length of a string and bytes.
DEPTH, NODES, STRING, SIZE = 8, 1024, 16_384, 65_536


def strict_json(text: str, depth: int = DEPTH, nodes: int = NODES, string: int = STRING, size: int = SIZE) -> Any:
    """JSON within bounds; duplicate keys, deep nesting, long strings and numbers that are not finite are errors with their kind."""
    if len(text.encode()) > size:
        raise StrictError("TOO_LARGE", "$")

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in items}) != len(items):
            raise StrictError("DUPLICATE_KEY", "$")
        return dict(items)

    def refuse(_: str) -> None:
        raise StrictError("BAD_NUMBER", "$")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
    except StrictError:
        raise
    except (ValueError, RecursionError):
        raise StrictError("NOT_JSON", "$") from None
    left = nodes
    stack = [(value, "$", 1)]
    while stack:
        v, path, level = stack.pop()
        left -= 1
        if left < 0:
            raise StrictError("TOO_MANY_NODES", "$")
        if level > depth:
            raise StrictError("TOO_DEEP", path)
        if isinstance(v, str) and len(v) > string:
            raise StrictError("STRING_TOO_LONG", path)
        if isinstance(v, dict):
            stack += ((x, f"{path}.{k}", level + 1) for k, x in v.items())
        elif isinstance(v, list):
            stack += ((x, f"{path}[{k}]", level + 1) for k, x in enumerate(v))
    return value


@F.pandas_udf(StructType([StructField("ok", BooleanType()), StructField("code", StringType()), StructField("path", StringType())]))
def strict_check(texts: pd.Series) -> pd.DataFrame:
    def one(t: str | None) -> tuple[bool, str | None, str | None]:
        try:
            strict_json(t if t is not None else "")
        except StrictError as e:
            return False, e.code, e.path
        return True, None, None

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "code", "path"])
