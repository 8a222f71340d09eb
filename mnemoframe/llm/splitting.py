"""Splitting of long texts at natural boundaries (problem 8) by bounded-quantifier regular expressions and SQL array functions.

Python encodes each text once and gives one letter per token that says how strong the boundary after that token is, and where tokens
end. From there on SQL works: an expression whose alternatives, strongest first, consume up to the limit of these letters and at last fall
back to any whole character cuts the letters into pieces; array functions add up their lengths, look back by the overlap and take the
text. Merges never cross the end of a token, so a run of whole tokens has no more tokens when it is encoded by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mnemoframe.llm.tokens import TOKENIZER_DIR, budgets, sizer

SCHEMA = "doc_id {kind}, marks string, char_ends array<int>, byte_ends array<int>, whole array<int>, data binary"
#: UTF-8 ends of sentences and clauses without a space after them.
WIDE_STOPS, WIDE_COMMAS = ("。", "！", "？"), ("，", "；", "、", "：")


def expression(most: int) -> str:
    """Up to ``most`` letters: the whole rest, else to the last boundary of the strongest kind in the window's second half."""
    least = max(0, most // 2 - 1)
    natural = "|".join(f".{{{least},{most - 1}}}{kind}" for kind in "plscw")
    return f".{{1,{most}}}\\z|{natural}|.{{0,{most - 1}}}[^z]|z*[^z]"


def letters(raw: np.ndarray, ends: np.ndarray) -> str:
    """Per token end: paragraph p, line l, sentence s, clause c, word w, character x, or z within a character."""
    pad = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(1, np.uint8)])
    at = ends + 3
    after, b1, b2, b3 = pad[at], pad[at - 1], pad[at - 2], pad[at - 3]
    space = (after == 32) | (after == 9) | (after == 10) | (after == 13)
    out = np.full(len(ends), ord("x"), np.uint8)
    out[space | (b1 == 32) | (b1 == 9)] = ord("w")
    three = b3.astype(np.uint32) << 16 | b2.astype(np.uint32) << 8 | b1
    wide = lambda marks: np.isin(three, [int.from_bytes(c.encode(), "big") for c in marks])
    out[(np.isin(b1, list(b",;:")) & space) | wide(WIDE_COMMAS)] = ord("c")
    out[(np.isin(b1, list(b".!?")) & space) | wide(WIDE_STOPS)] = ord("s")
    line = ((b1 == 10) | (b1 == 13)) & (after != 10) & (after != 13)
    out[line] = ord("l")
    out[line & ((b2 == 10) | (b2 == 13) & (b3 == 10) | (b1 == 13) & (b2 == 13)) & ~((b2 == 13) & (b1 == 10) & (b3 != 10))] = ord("p")
    out[(after & 0xC0) == 0x80] = ord("z")
    if len(out):
        out[-1] = ord("p")
    return out.tobytes().decode("ascii")


def _marker(name: str, folder: str, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text of more than ``least`` tokens: its letters, where each token ends in characters (begun) and bytes, and the next token border that cuts no character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = sizer(name, folder)
        lengths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], np.int64)
        number = lambda arrays: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0)]), pa.int32()))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                keys: list[int] = []
                marks, chars, places, borders, data = [], [], [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = encoding.encode_ordinary(text)
                    if len(ids) <= least:
                        continue
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ends = np.cumsum(lengths[ids])
                    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    keys.append(k)
                    marks.append(letters(raw, ends))
                    chars.append(begun[ends])
                    places.append(ends)
                    border = np.concatenate([[True], np.frombuffer(marks[-1].encode(), np.uint8) != ord("z")])
                    sound = np.flatnonzero(border)
                    borders.append(sound[np.searchsorted(sound, np.arange(len(border)))])
                    data.append(raw.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(marks, pa.string()), number(chars), number(places), number(borders), pa.array(data, pa.binary())],
                    names=["doc_id", "marks", "char_ends", "byte_ends", "whole", "data"],
                )

    return run


def _ends(marks: Column, first: Column, later: Column) -> Column:
    """Where the pieces end, in tokens: the first piece by one expression, the others by another."""
    head = F.call_function("regexp_extract", marks, first, F.lit(0))
    rest = F.regexp_extract_all(F.substr(marks, F.length(head) + 1), later, F.lit(0))
    sizes = F.concat(F.array(F.length(head)), F.transform(rest, F.length))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends"))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), add, lambda acc: acc["ends"])


def split(docs: DataFrame, budget: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Pieces of each text that is longer than a piece size of the budget table (a few rows), numbered from 0.

    Null, empty and short texts have no pieces. Copies are split one by one. Pieces cover the text; a piece begins the overlap before
    the end of the one before, or up to three tokens later where that would cut a character. ``n_tokens`` counts the tokens of the text that
    a piece holds; none is over its size but for a single character that is. An empty table gives no rows.
    """
    limits = sorted({(r[0], min(max(r[1] or 0, 0), r[0] - 1)) for r in budgets(budget, "piece", name, ("capacity_tokens", "overlap_tokens")) if r[0] and r[0] > 0})
    kind = docs.schema[id_column].dataType.simpleString()
    least = min((b[0] for b in limits), default=0)
    long = docs.where(F.octet_length(text_column) > least).select(F.col(id_column).alias("doc_id"), text_column)
    marked = long.where(F.lit(bool(limits))).mapInArrow(_marker(name, folder, least), SCHEMA.format(kind=kind))
    each = F.filter(F.array(*(F.struct(F.lit(n).alias("size"), F.lit(o).alias("overlap"), F.lit(expression(n)).alias("first"), F.lit(expression(n - o)).alias("later")) for n, o in limits or [(1, 0)])), lambda b: F.length("marks") > b["size"])

    def cut(b: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            before = F.get("ends", i - 1)
            back = F.greatest(F.lit(0), before - F.col("overlap_tokens"), e - F.col("capacity_tokens"))  # a last character of several tokens takes from the overlap
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get("whole", F.least(before, back)))
            at = lambda name, k: F.when(k == 0, F.lit(0)).otherwise(F.get(name, k - 1))
            place = at("byte_ends", begin)
            text = F.decode(F.substr("data", place + 1, at("byte_ends", e) - place), "UTF-8")
            return F.struct(at("char_ends", begin).alias("char_start"), at("char_ends", e).alias("char_end"), (e - begin).alias("n_tokens"), text.alias("piece"))

        return F.transform("ends", piece)

    per = marked.withColumn("b", F.explode(each)).select("*", F.col("b.size").alias("capacity_tokens"), F.col("b.overlap").alias("overlap_tokens")).withColumn("ends", _ends(F.col("marks"), F.col("b.first"), F.col("b.later")))
    out = per.select("doc_id", "capacity_tokens", "overlap_tokens", cut(F.col("b")).alias("pieces"))
    return out.select(F.col("doc_id").alias(id_column), "capacity_tokens", "overlap_tokens", F.posexplode_outer("pieces").alias("piece_no", "p")).select(id_column, "capacity_tokens", "overlap_tokens", "piece_no", "p.*")
