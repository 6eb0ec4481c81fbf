"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are put together with a separator and encoded once, as a whole, so counts add up to
what a model would be given. The byte lengths of the tokens give their byte spans; these are matched to
the sections' spans by a sorted interval lookup inside the row. A token that crosses a border is
allocated by a stated rule:

- `first`: to the section that holds its first byte;
- `last`: to the section that holds its last byte;
- `most`: to the section that holds most of its bytes, the earlier one of equal shares.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

RULES = ("first", "last", "most")

_ENCODERS: dict[str, tuple] = {}


def encoder(ranks: bytes, pattern: str) -> tuple:
    """(tiktoken encoding, byte length of each id), kept by the worker process."""
    key = f"{hash(ranks)}:{pattern}"
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            lengths[i] = len(token)
        _ENCODERS.clear()
        _ENCODERS[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths)
    return _ENCODERS[key]


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a border.

    ends: ascending byte ends of the tokens; borders: ascending byte ends of the sections, which cover
    the text. Empty sections get no token.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(borders, starts, side="right")
    last = np.searchsorted(borders, ends - 1, side="right")
    if rule == "first":
        owner = first
    elif rule == "last":
        owner = last
    else:
        owner = first.copy()
        for t in np.flatnonzero(last > first):
            parts = np.arange(first[t], last[t] + 1)
            held = np.minimum(borders[parts], ends[t]) - np.maximum(np.concatenate(([0], borders))[parts], starts[t])
            owner[t] = parts[np.argmax(held)]
    return np.bincount(owner, minlength=len(borders)), np.bincount(owner[last > first], minlength=len(borders))


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n\n", section: str = "\n", rule: str = "first") -> DataFrame:
    """Tokens of each section of each field, from one encoding of each row's whole text.

    Columns: id_col, field, section (from 0 within its field), start_char, end_char (code points within
    the field, end exclusive), n_tokens, n_crossing (tokens of it that cross its border). A section ends
    after each `section` string and at the end of its field. The separator counts with the field before
    it. A null or empty field is one empty section without tokens. Every row of docs gives at least one
    row for each field; repeated and null ids give rows of their own. Other columns, whatever their names, are not
    read, unless they are named in fields. Very long texts are encoded whole; their tokens' and sections' borders are
    held at once (8 and about 100 bytes each), and rows are told 50,000 at a time. An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    small_batches(docs.sparkSession)
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not grow
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "field", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
    schema = f"`{id_col}` {kind}, field string, section int, start_char int, end_char int, n_tokens long, n_crossing long"
    gap = separator.encode()

    def rows_of(own, lengths, texts: list[str]):
        """Arrays for one document: field numbers, sections, char starts, char ends, tokens, crossing."""
        field, number, starts, ends, borders = [], [], [], [], []
        at = 0
        for k, t in enumerate(texts):
            chars = 0
            parts = t.split(section)
            parts = [p + section for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
            for s, p in enumerate(parts):
                at += len(p.encode())
                field.append(k), number.append(s), starts.append(chars), ends.append(chars + len(p)), borders.append(at)
                chars += len(p)
            if k + 1 < len(texts):
                at += len(gap)
                borders[-1] = at
        whole = separator.join(texts)
        sizes = lengths[np.array(own.encode_ordinary(whole), np.int64)] if whole else np.empty(0, np.int64)
        tokens, crossing = attribute(np.cumsum(sizes), np.array(borders), rule)
        return field, number, starts, ends, tokens, crossing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths = encoder(shared.value, pattern)
        for batch in batches:
            out, index = [[] for _ in range(6)], []
            for r in range(batch.num_rows):
                found = rows_of(own, lengths, [batch.column(1 + k)[r].as_py() or "" for k in range(len(fields))])
                index.extend([r] * len(found[0]))
                for column, values in zip(out, found, strict=True):
                    column.extend(values)
                if len(index) > 50_000 or r + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(index)),
                            pa.array([fields[k] for k in out[0]], pa.string()),
                            *(pa.array(np.array(c, np.int32)) for c in out[1:4]),
                            *(pa.array(np.array(c, np.int64)) for c in out[4:]),
                        ],
                        names,
                    )
                    out, index = [[] for _ in range(6)], []

    return docs.select(F.col(id_col), *[F.col(c).cast("string").alias(f"field_{i}") for i, c in enumerate(fields)]).mapInArrow(run, schema)
