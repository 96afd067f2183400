"""Cutting texts into chunks for the index.

A chunk is filled with paragraphs, a paragraph longer than a chunk with lines; a single longer
line stays one chunk.  The fold depends on what is pending, so it runs as an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, MOST = 2_000, 8


def chunk_text(text: str, size: int = CHUNK) -> list[str]:
    """Chunks of one text.  Whole texts of ``size`` or less are kept as they are, other chunks are
    stripped; what is left of a long paragraph begins the next chunk without a blank line, and
    pending white space can give an empty chunk."""
    if len(text) <= size:
        return [text]
    done: list[str] = []
    pending = ""

    def pack(pieces: list[str], held: str, end: str) -> str:
        for piece in pieces:
            if len(held) + len(piece) + len(end) > size:
                if held:
                    done.append(held.strip())
                held = ""
            held += piece + end
        return held

    for paragraph in text.split("\n\n"):
        if len(paragraph) <= size:
            pending = pack([paragraph], pending, "\n\n")
        else:
            if pending:
                done.append(pending.strip())
            tail = pack(paragraph.split("\n"), "", "\n").strip()
            if tail and not pending:
                done.append(tail)
            elif tail:
                pending = tail
    if pending.strip():
        done.append(pending.strip())
    return done


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(chunk_text, na_action="ignore")


def capped(chunks: Column, most: int = MOST) -> Column:
    """The first and the last half of more than ``most`` chunks."""
    half = most // 2
    return F.when(F.size(chunks) <= most, chunks).otherwise(F.concat(F.slice(chunks, 1, half), F.slice(chunks, -half, half)))


def chunk_rows(df: DataFrame, id_col: str, text_col: str, cap: bool = False) -> DataFrame:
    """(id, chunk_no, chunk): null texts and blank chunks give no row."""
    cut = df.select(id_col, _chunks(F.col(text_col)).alias("c"))
    if cap:
        cut = cut.select(id_col, capped(F.col("c")).alias("c"))
    return cut.select(id_col, F.posexplode("c").alias("chunk_no", "chunk")).where(F.trim("chunk") != "")
