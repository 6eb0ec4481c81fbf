"""Packing documents into token sequences of fixed size by bounded-space online best fit.

Every document is its token ids and an end id. Documents longer than a sequence are cut into pieces of a
whole sequence; their first piece takes the rest, so each document has at most one piece that is not full.

Encoding writes one small row for each piece (no text, no ids) to the shared folder. These rows are dealt
to tasks of about `piece_rows` by a hash of their row number, so no id, length or text can make a task
large. In a task the pieces arrive online, in runs of `run_rows` that are sorted by falling length, and each
goes to the open sequence with the least free space that holds it. Free spaces are a bitset, one bit for
each size, with a stack of open sequences behind each bit; the best fit is the lowest bit at or above the
piece's length. At most `open_bins` sequences are open: before one more is opened, the fullest is closed.
With as many open sequences as a run has pieces, a run fills what the runs before have left open.

A task's memory is one run and the open sequences; no sequence crosses tasks, so a lost task is simply
done again, with the same result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, small_batches

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 4096
RUN_ROWS = 4096
#: Pieces that a task packs, on average: about one sequence of each task stays partly empty.
PIECE_ROWS = 16_384

#: Fixed value: what the byte-level pre-tokenizer splits at.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts above this many bytes are encoded in parts of about that size.
PART_BYTES = 1 << 20
#: A run of bytes without white space, or of white space, from which the library itself encodes the text.
LONG_RUN = 2_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space of the pre-tokenizer that is not ASCII.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
#: Anything but Latin, basic Greek and Cyrillic, dashes and quotes, kana, Han and Hangul: characters that all
#: versions of Unicode since 5.0 class alike, so two libraries cannot differ on them.
_RARE = re.compile("[^\x00-ɏΑ-ΡΣ-ώА-я‐-‧ぁ-ゔァ-ヺ一-龥가-힣！-～]")


def _byte_ranks(definition: dict) -> dict[bytes, int] | None:
    """Bytes and rank of each token, if the tokenizer is plain byte-level BPE whose ids follow its merges."""
    model, split = definition["model"], definition.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or definition.get("normalizer") or definition.get("post_processor"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab, first = model["vocab"], len(model["vocab"]) - len(merges)
    if first != 256 or any(vocab["".join(m)] != first + i for i, m in enumerate(merges)):
        return None
    # the byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others follow from 256
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids of a tokenizer file as the tokenizers library gives them, without added special tokens.

    Plain byte-level BPE runs by the same ranks in a faster library; texts with a special token's own
    string, rare characters or very long runs, and any other kind of tokenizer, are encoded by the tokenizers library.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(definition)
        added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks := _byte_ranks(parsed):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bool:
        if self.fast is None or (self.added and self.added.search(text)) or (not text.isascii() and _RARE.search(text)):
            return True
        edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(text.encode(), np.uint8)], prepend=True, append=True))
        return len(edges) > 1 and int(np.diff(edges).max()) >= LONG_RUN or len(edges) <= 1 and len(text) >= LONG_RUN

    def ids(self, text: str) -> np.ndarray:
        """Ids of one whole text, as little-endian unsigned 32-bit integers."""
        if self._by_library(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= PART_BYTES or (not text.isascii() and _WIDE_SPACE.search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        # no token of the split reaches from other characters into white space: parts may end before it
        out, at = [], 0
        for space in re.finditer(r"(?<![\t-\r\x1c-\x20])[\t-\r ]", text):
            if space.start() - at >= PART_BYTES:
                out.append(np.array(self.fast.encode_ordinary(text[at : space.start()]), "<u4"))
                at = space.start()
        return np.concatenate([*out, np.array(self.fast.encode_ordinary(text[at:]), "<u4")])


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The worker process's encoder, kept for later tasks."""
    key = hashlib.blake2b(definition.encode(), digest_size=16).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first takes what does not fill a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every row's whole text: id_col, piece, start, length, ids_crc32, and ids if asked for.

    A null text is empty and has the end id alone. Repeated rows give pieces each; no other column of docs
    is read. Very long texts are encoded in parts; their ids are held at once (4 bytes each).
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not grow
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for batch in batches:
            row, found, ids = [], [], []
            for r, text in enumerate(batch.column(1)):
                all_ids = np.concatenate([own.ids(text.as_py() or ""), end])
                for k, (s, n) in enumerate(cut(len(all_ids), capacity)):
                    part = all_ids[s : s + n]
                    row.append(r)
                    found.append((k, s, n, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                if len(row) >= 50_000 or len(ids) >= 1_000 or r + 1 == batch.num_rows:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:]), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])],
                        [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                    )
                    row, found, ids = [], [], []

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class OpenBins:
    """Open sequences by free space. place() gives the sequence (numbered from 0) and the offset of each piece."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.behind: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.opened = 0

    def _take(self, free: int) -> int:
        stack = self.behind[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes first
            free, found = self.capacity, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.behind[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def best_fit(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, run_rows: int = RUN_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """pieces with sequence_id and offset: where each row's length_col units lie, in sequences of `capacity`.

    Lengths are from 1 to capacity; anything else is an error. Every sequence is gapless from offset 0. Any
    other columns, repeated rows and rows without an id are kept; an empty table gives an empty one. Columns named
    sequence_id, offset or row_ are replaced.
    """
    rows = materialise(pieces.drop("sequence_id", "offset", "row_").withColumn("row_", F.monotonically_increasing_id()))
    tasks = max(1, math.ceil(rows.count() / piece_rows))
    deal = F.xxhash64("row_")
    dealt = rows.select("row_", F.col(length_col).cast("long").alias("length_")).repartition(tasks, deal).sortWithinPartitions(deal, "row_")
    dealt = dealt.withColumn("task_", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        row, length, task = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def packed(row, length):
            order = np.argsort(-length, kind="stable")
            if len(length) and not (0 < length[order[-1]] and length[order[0]] <= capacity):
                raise ValueError(f"lengths must be from 1 to {capacity}")
            placed = np.array([bins.place(n) for n in length[order].tolist()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(row[order]), pa.array((task << 33) + placed[:, 0]), pa.array(placed[:, 1])], ["row_", "sequence_id", "offset"])

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(2)[0].as_py()
            if batch.column(1).null_count:
                raise ValueError(f"lengths must be from 1 to {capacity}")
            row, length = np.append(row, batch.column(0).to_numpy()), np.append(length, batch.column(1).to_numpy())
            while len(row) >= run_rows:
                yield packed(row[:run_rows], length[:run_rows])
                row, length = row[run_rows:], length[run_rows:]
        if len(row):
            yield packed(row, length)

    places = dealt.mapInArrow(run, "row_ long, sequence_id long, offset long")
    return rows.join(places, "row_").drop("row_")


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, **how) -> DataFrame:
    """Where the pieces of every row's whole text lie: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return best_fit(token_pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id), capacity=capacity, **how).select(*names)


def packed_sequences(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, **how) -> DataFrame:
    """The sequences themselves: sequence_id, ids (at most `capacity`), and pieces: for each its id_col, piece, offset, length."""
    placed = best_fit(token_pieces(docs, tokenizer_file, id_col, text_col, capacity, end_id, with_ids=True), capacity=capacity, **how)
    # at most `capacity` ids come together for a sequence
    parts = F.array_sort(F.collect_list(F.struct("offset", "piece", "length", F.col(id_col), "ids")))
    told = F.transform("parts", lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), told.alias("pieces"))
