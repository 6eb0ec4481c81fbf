"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it into chunks whose borders depend on the content alone,
so copies and shared passages give equal chunks wherever they stand. A worker process remembers the
chunks that it has encoded until it has met CHUNKS to twice as many other ones; a chunk that comes later
is put together from its fragments again. Its first and last fragments may be halves of words, so each join of two chunks
is repaired: the window from the last white space before the cut to the first one after it is encoded
anew and must agree with the chunks' own tokens on both sides; if it does not, the whole text is encoded
anew.

An unseen chunk is encoded by fragments between white space, which are remembered too. That is exact for
tokenizers whose splitting rule drops white space and never matches across it; Codec checks the
tokenizer's definition for that and encodes whole texts of any other by the library directly.

Memories are bounded and belong to the worker process; nothing is shuffled. Meeting equal chunks of
different workers would move every text and all ids across the network, which costs more than encoding.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import handing_back, small_batches

#: Cut where these bits of the rolling hash are 0: about 2 KB a chunk.
CUT_BITS = 11
LEAST_CHUNK = 256
#: Bytes that the rolling hash looks back on.
WINDOW = 16
FRAGMENTS = 100_000
CHUNKS = 2_000
#: What bytes.split() splits at.
_WHITE = frozenset(b"\t\n\x0b\x0c\r ")
#: Letters and digits of ASCII and Latin-1, then full stops and commas: their tokens never join, and case does not count.
_PLAIN = re.compile(rb"((?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]*)")
_ROLL = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Content-defined cut positions of data, from 0 to its length."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [0, n] if n else [0]
    x = _ROLL[np.frombuffer(data, np.uint8)]
    # buzhash by doubling: the hash of 2k bytes is that of k bytes, rotated, and the next k
    k = 1
    while k < WINDOW:
        y = x[:-k]
        x = ((y << np.uint32(k)) | (y >> np.uint32(32 - k))) ^ x[k:]
        k *= 2
    found, last = [0], 0
    for c in (np.flatnonzero((x >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW).tolist():
        if c - last >= LEAST_CHUNK and c < n and data[c] & 0xC0 != 0x80:  # not inside a character
            found.append(c)
            last = c
    return [*found, n]


class _Memory:
    """Bounded map of two generations: what was not asked for during a whole generation is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get_all(self, keys, make) -> dict:
        """Values of all keys; those not remembered come from make(list of keys)."""
        out, missing, new, old = {}, [], self.new, self.old
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                new[k] = v
            out[k] = v
        made = dict(zip(missing, make(missing), strict=True)) if missing else {}
        out.update(made)
        new.update(made)
        if len(new) > self.most:
            self.new, self.old = {}, new
        return out


class Codec:
    """Encoder and decoder of one tokenizer file. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_fragments = _splits_at_white_space(json.loads(definition))
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.model = self.tokenizer.model
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): bytes_.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0xDF, 0x100)]) if c != "\xf7"}
        self.fragments, self.cores, self.chunks = _Memory(FRAGMENTS), _Memory(FRAGMENTS), _Memory(CHUNKS)

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        names, packed = self.names, self.packed
        return b"".join([packed[i] for i in ids]), " ".join([names[i] for i in ids]).encode()

    def _library(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        if self.by_fragments:  # such a tokenizer has no decoder: tokens are joined by spaces
            return [self._pair(e.ids) for e in found]
        return [(np.array(e.ids, "<u4").tobytes(), self.tokenizer.decode(e.ids, skip_special_tokens=False).encode()) for e in found]

    def _encode_cores(self, cores: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Lower-case words of ASCII and Latin-1 letters are one unit of the library's model each."""
        out, rest = [None] * len(cores), []
        for k, c in enumerate(cores):
            word = c.decode()
            if word.isalpha():
                out[k] = self._pair([t.id for t in self.model.tokenize(word.translate(self.letters))])
            else:
                rest.append(k)
        for k, v in zip(rest, self._library([cores[k] for k in rest]) if rest else [], strict=True):
            out[k] = v
        return out

    def _encode_fragments(self, parts: list[bytes]) -> list[tuple[bytes, bytes]]:
        split = []
        for p in parts:
            plain = _PLAIN.fullmatch(p)
            split.append((plain[1].decode().lower().encode(), plain[2]) if plain else (None, p))
        cores = self.cores.get_all({c for c, _ in split if c}, self._encode_cores)
        rest = self.cores.get_all({e for _, e in split if e}, self._library)
        out = []
        for c, e in split:
            if not e:
                out.append(cores[c] if c else (b"", b""))
            elif c is None:
                out.append(rest[e])
            else:
                (i, d), (j, f) = cores[c], rest[e]
                out.append((i + j, d + b" " + f))
        return out

    def _encode_chunks(self, chunks: list[bytes]) -> list[tuple]:
        """(head, ids, decoded, tail, first and last inner fragment) of each chunk.

        head and tail are what stands before the first and after the last white space, for the joins; a
        chunk without white space is all head, and its other parts are None.
        """
        split = []
        for data in chunks:
            parts = data.split()
            if len(parts) == 1 and len(parts[0]) == len(data):
                split.append((data, None, None))
                continue
            tail = parts.pop() if parts and data[-1] not in _WHITE else b""
            head = parts.pop(0) if parts and data[0] not in _WHITE else b""
            split.append((head, parts, tail))
        inner = self.fragments.get_all({p for _, parts, _ in split if parts for p in parts}, self._encode_fragments)
        out = []
        for head, parts, tail in split:
            if parts is None:
                out.append((head, None, None, None, b"", b""))
                continue
            both = [inner[p] for p in parts]
            out.append((head, b"".join([x for x, _ in both]), b" ".join([y for _, y in both if y]), tail, parts[0] if parts else b"", parts[-1] if parts else b""))
        return out

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        if not self.by_fragments:
            return self._library(texts)
        pieces = []
        for t in texts:
            at = cuts(t)
            pieces.append([t[i:j] for i, j in zip(at, at[1:], strict=False)])
        known = self.chunks.get_all({c for own in pieces for c in own}, self._encode_chunks)
        plans, joins = [], set()
        for own in pieces:
            plan, edge, last = [], b"", b""
            # alternate: join, chunk, join, chunk, ..., join
            for c in own:
                head, ids, decoded, tail, first, final = known[c]
                if ids is None:
                    edge += head
                    continue
                plan += [(last, edge + head, first), (ids, decoded)]
                edge, last = tail, final
            plan.append((last, edge, b""))
            plans.append(plan)
            for before, middle, after in plan[::2]:
                if middle:
                    joins.update((middle, before, after))
        near = self.fragments.get_all(joins, self._encode_fragments)
        windows = {step for plan in plans for step in plan[::2] if step[1] and (step[0] or step[2])}
        windows = list(windows)
        agree = {}
        for step, (ids, _) in zip(windows, self._library([b" ".join(w) for w in windows]) if windows else [], strict=True):
            # the window must hold the neighbours' own tokens on both sides, and the join's between them
            agree[step] = ids == near[step[0]][0] + near[step[1]][0] + near[step[2]][0]
        out = []
        for own, plan in zip(pieces, plans, strict=True):
            ids, words = [], []
            for k, step in enumerate(plan):
                if k % 2 == 0:
                    if not step[1]:
                        continue
                    if not agree.get(step, True):  # no agreement: the widest window, the whole text
                        ids = None
                        break
                    step = near[step[1]]
                if step[0]:
                    ids.append(step[0])
                    words.append(step[1])
            out.append(self._library([b"".join(own)])[0] if ids is None else (b"".join(ids), b" ".join(words)))
        return out


def _splits_at_white_space(definition: dict) -> bool:
    """Whether ids and decoded text of a text are those of its parts between white space."""
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [definition.get("pre_tokenizer") or {}])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and not re.search(r"\\s(?!\\p)|\\W| |\.|\(\?", re.sub(r"\[\^\\s[^\]]*\]", "", pattern))
    norms = (definition.get("normalizer") or {}).get("normalizers", [definition.get("normalizer") or {}])
    local = all(n.get("type") in ("NFC", "Lowercase") or n == {} or (n.get("type") == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in norms)
    own = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"])) for t in definition.get("added_tokens", []))
    return bool(drops and local and own and definition.get("decoder") is None and any(n.get("type") == "Lowercase" for n in norms) and definition.get("post_processor") is None)


_CODECS: dict[str, Codec] = {}


def codec(definition: str) -> Codec:
    """The worker process's codec of a tokenizer, kept for later tasks."""
    key = hashlib.blake2b(definition.encode(), digest_size=16).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(definition)
    return _CODECS[key]


def _batches(column: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in column:
        t = (x.as_py() or "").encode()
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of each row's whole text.

    Columns: id_col, n_tokens, ids_sha256, decoded_sha256. Null texts are empty, and empty ones have no
    token. Rows keep their number, repeated and null ids too; other columns, whatever their names, are not read.
    Very long texts are encoded whole, chunk by chunk; their ids and decoded text are held at once. An empty table
    gives an empty result.
    """
    return _run(docs, tokenizer_file, id_col, text_col, digests=True)


def bpe_encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: id_col, ids array<int>, decoded string."""
    return _run(docs, tokenizer_file, id_col, text_col, digests=False)


def chunk_reuse(docs: DataFrame, text_col: str = "text", most: int = CHUNKS) -> DataFrame:
    """How often chunks are reused, in one row: chunks, in_batch, remembered, encoded, different.

    in_batch: chunks that stand earlier in the same batch; remembered: those that the worker still knew;
    encoded: the others. different: chunks by hash, which is what one memory for all workers would encode.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _REUSE.setdefault(most, _Memory(most))
        for batch in batches:
            for texts in _batches(batch.column(0)):
                own = [hashlib.blake2b(t[i:j], digest_size=16).digest() for t in texts for at in [cuts(t)] for i, j in zip(at, at[1:], strict=False)]
                first, new = set(own), set()
                memory.get_all(first, lambda keys, new=new: new.update(keys) or [True] * len(keys))
                state = []
                for c in own:
                    state.append("encoded" if c in new else "remembered" if c in first else "in_batch")
                    new.discard(c)
                    first.discard(c)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(state, pa.string())], ["chunk", "state"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(handing_back(run), "chunk binary, state string")
    each = rows.groupBy("chunk").agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(s) for s in ("in_batch", "remembered", "encoded")])
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "chunks"), ("in_batch", "in_batch"), ("remembered", "remembered"), ("encoded", "encoded"))], F.count("*").alias("different"))


#: The worker process's memories of chunk_reuse, kept for later tasks as those of codecs are.
_REUSE: dict[int, _Memory] = {}


def _run(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not grow
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(shared.value)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1)):
                found = own.encode_batch(texts)
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                if digests:
                    columns = [
                        pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for _, d in found], pa.string()),
                    ]
                    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [
                        pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                        pa.array([d.decode() for _, d in found], pa.string()),
                    ]
                    names = [id_col, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([ids, *columns], names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(handing_back(run), schema)
