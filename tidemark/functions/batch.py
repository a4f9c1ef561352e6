"""Callables over batches of rows as Column functions, for summarisers, rerankers and other models, and chunking in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def batched(make: Callable, returns: str = "string", most: int | None = None) -> Callable[..., Column]:
    """A Column function of a callable on lists: make(list, ...) -> list of as many values, called once for each Arrow batch (or for
    each `most` rows of it). Nulls come as None; a callable that returns another number of values is an error."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            lists = [[None if x is None or x != x else x for x in c.tolist()] for c in columns]
            out, n = [], len(lists[0])
            for start in range(0, n, most or max(n, 1)):
                part = [c[start : start + (most or n)] for c in lists]
                got = list(make(*part))
                if len(got) != len(part[0]):
                    raise ValueError(f"{len(part[0])} rows were asked for, {len(got)} came back")
                out += got
            yield pd.Series(out, dtype=object)

    def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return run(batches)

    several.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run((b,) for b in batches)

    one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else several, returns)(*columns)


def register_chunk_text(spark: SparkSession, headings=None, name: str = "chunk_text", **sizes) -> None:
    """Makes chunk_text(text, type) a table function of SQL: (chunk_index, section, title, chunk_text, char_start, char_end,
    page_start, page_end) of a text, type being 'report' or 'call'; sizes as for chunk_documents."""
    from tidemark.operators import indexing as ix

    rules = [(n, p) for n, p in headings or ix.HEADINGS]

    class ChunkText:
        def __init__(self):
            self.rules = [(n, re.compile(p, re.M)) for n, p in rules]

        def eval(self, text: str, kind: str):
            text = text or ""
            for i, (section, title, a, b) in enumerate(ix.chunk_text(text, kind, self.rules, **sizes)):
                yield i, section, title or section.replace("_", " ").title(), text[a:b], a, b, a // ix.PAGE_CHARS + 1, max(b - 1, a) // ix.PAGE_CHARS + 1

    schema = "chunk_index int, section string, title string, chunk_text string, char_start int, char_end int, page_start int, page_end int"
    spark.udtf.register(name, F.udtf(ChunkText, returnType=schema, useArrow=True))
