"""Token counts of the sections of a document, from one encoding of the whole document.

The document is encoded once; the tokens' character spans are then joined to the sections' intervals.
Encoding sections on their own would give other tokens, and sums that differ from the document's.

Sections are a document's lines: a line with its newline is one section, so they cover the text without
gaps. Intervals are joined by merging two sorted lists (binary search of token starts and ends among the
section bounds), inside the task that holds the document: no shuffle, no exploded tokens.

Rule for a token that crosses a boundary: it counts, whole, for the section that holds the larger part
of its characters; if two hold as much, for the earlier one ("majority"). Rule "start" gives it to the
section of its first character. Each token counts once, so the sections add up to the document.
`n_crossing` counts the tokens of a section that also touch another one.

Defined results: a null or empty text has one empty section 0 with no tokens. Repeated rows stay
repeated; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import tokenizer_of

RULES = ("majority", "start")


def line_bounds(text: str) -> np.ndarray:
    """Starts of the lines and the text's length; every line keeps its newline."""
    sizes = np.fromiter(map(len, text.split("\n")), np.int64)
    ends = np.cumsum(sizes + 1)
    bounds = np.concatenate(([0], ends))
    bounds[-1] = len(text)
    return bounds[:-1] if len(bounds) > 2 and bounds[-1] == bounds[-2] else bounds


def allocate(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; sections are [bounds[i], bounds[i + 1])."""
    n = len(bounds) - 1
    if not len(spans):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.clip(np.searchsorted(bounds, start, side="right") - 1, 0, n - 1)
    final = np.clip(np.searchsorted(bounds, end, side="left") - 1, 0, n - 1)
    crossing = final > first
    chosen = first.copy()
    if rule == "majority":
        for k in np.flatnonzero(crossing):
            edges = np.clip(bounds[first[k] : final[k] + 2], start[k], end[k])
            chosen[k] = first[k] + int(np.argmax(np.diff(edges)))
    return np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)


def section_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority") -> DataFrame:
    """One row per section: id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = df.schema[id_col].dataType.simpleString()
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        for batch in batches:
            rows, columns = [], [[] for _ in names]
            texts = batch.column(1).to_pylist()
            for i, (text, spans) in enumerate(zip(texts, tokenizer.spans(texts), strict=True)):
                bounds = line_bounds(text or "")
                counts, crossing = allocate(spans, bounds, rule)
                n = len(counts)
                rows.append(np.full(n, i))
                for c, v in zip(columns, (np.arange(n), bounds[:-1], bounds[1:], counts, crossing, np.full(n, len(spans))), strict=True):
                    c.append(v)
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], ["id", *names])

    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in names)
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)


def op9_token_spans(spark, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document."""
    import public_tokenizers

    from .common import documents

    return section_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
