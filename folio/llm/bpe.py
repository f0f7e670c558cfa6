"""Byte-pair encoding and decoding by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can't be merged across, so every place of a text that holds
such a pair is a certain cut. Texts are cut there at once, as arrays of bytes; the fragments are encoded
independently, each distinct short one once a task, and what they give is concatenated. Within a fragment the
vocabulary's own pre-tokenizer splits once more, its pieces are cut at forced pairs, and merges run by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

#: Fragments of up to so many bytes are remembered, and so many of them in a task.
SHORT, MOST_FRAGMENTS = 48, 400_000
#: Pieces of up to so many bytes are merged by looking at all pairs, longer ones by a heap.
FEW = 24
#: The rank of a pair that no merge has.
NONE = 1 << 62
#: Fragments that the vocabulary's pattern takes as one piece.
WHOLE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: Results are handed on when so many bytes of text are done.
PIECE_BYTES = 8 << 20
#: A cut within a text needs these: last and next to last bytes of white space beyond ASCII don't stand before it.
SPACE_ENDS = [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
SPACE_BEFORE = [0xC2, 0x80, 0x81, 0x9A]
#: Byte-level vocabularies write bytes as these characters: printable ones as themselves, others from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def load_vocabulary(path: str) -> str:
    """The text of a byte-level BPE file of the tokenizers library, checked to be of the kind that this module encodes."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    _Codec(text)
    return text


class _Codec:
    """What a task needs of a vocabulary: tokens as bytes, ranks by pairs of ids, and the table of forced pairs."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        given = json.loads(text)
        model, split = given["model"], given["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("the vocabulary isn't a plain byte-pair encoding")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or given["normalizer"]:
            raise ValueError("the vocabulary's texts aren't split by the byte-level pattern as they are")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in given["added_tokens"]):
            raise ValueError("added tokens that take their neighbours along aren't known here")
        others = [b for b in range(256) if b not in PRINTABLE]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(others)}
        self.tokens = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        ids = {t: i for i, t in self.tokens.items()}
        if not all(bytes([b]) in ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.rank, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(byte_of[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[ids[left], ids[right]] = rank
            self.made.append(ids[left + right])
        self.added = {t["content"].encode(): t["id"] for t in given["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        inside = np.zeros((256, 256), bool)
        for t in self.tokens.values():
            inside[list(t[:-1]), list(t[1:])] = True
        self.forced = ~inside.ravel()
        # In a text, a cut also leaves the pattern's view as it is: no white space before it, no apostrophe behind it,
        # and whole characters on both sides.
        safe = ~inside
        safe[[*b"\t\n\v\f\r\x1c\x1d\x1e\x1f "], :] = False
        safe[:, [0x27, *range(0x80, 0xC0)]] = False
        self.cuts = safe.ravel()
        self.space_end, self.space_before = np.zeros(256, bool), np.zeros(256, bool)
        self.space_end[SPACE_ENDS], self.space_before[SPACE_BEFORE] = True, True
        self.pieces = Tokenizer.from_str(text).pre_tokenizer.pre_tokenize_str
        self.known = _Known(self)

    def fragments(self, data: bytes) -> list[bytes]:
        """A text cut at every forced pair that also leaves the pattern's view of both sides as it is."""
        a = np.frombuffer(data, np.uint8)
        if len(a) < 2:
            return [data] if data else []
        at = self.cuts[a[:-1].astype(np.uint16) * 256 + a[1:]]
        at[1:] &= ~(self.space_end[a[1:-1]] & self.space_before[a[:-2]])
        ends = (np.flatnonzero(at) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)], strict=True)]

    def encode(self, data: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian unsigned 32-bit integers."""
        out, rest = [], data
        while self.added:
            found = [(i, -len(t), t) for t in self.added if (i := rest.find(t)) >= 0]
            if not found:
                break
            at, _, token = min(found)
            out += [*map(self.known.__getitem__, self.fragments(rest[:at])), _packed([self.added[token]])]
            rest = rest[at + len(token) :]
        out += map(self.known.__getitem__, self.fragments(rest))
        return b"".join(out)

    def fragment(self, data: bytes) -> bytes:
        if WHOLE.fullmatch(data) and len(data) <= FEW:
            return _packed(self.merged(data))
        ids, text = [], data.decode("utf-8")
        for _, (first, last) in self.pieces(text):
            piece = text[first:last].encode()
            if len(piece) <= FEW:
                ids += self.merged(piece)
                continue
            a = np.frombuffer(piece, np.uint8)
            ends = (np.flatnonzero(self.forced[a[:-1].astype(np.uint16) * 256 + a[1:]]) + 1).tolist()
            for i, j in zip([0, *ends], [*ends, len(piece)], strict=True):
                ids += self.merged(piece[i:j])
        return _packed(ids)

    def merged(self, piece: bytes) -> list[int]:
        """Merges by rank, the leftmost first; of a long run by a heap of pairs over a linked list, so it isn't scanned again."""
        ids = [self.of_byte[b] for b in piece]
        if len(ids) > FEW:
            return self.merged_long(ids)
        rank, made = self.rank.get, self.made
        ranks = [rank(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < NONE:
            at = ranks.index(best)
            ids[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), NONE)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), NONE)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank, made = self.rank.get, self.made
        heap = [(r, i) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]), NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j]), NONE) != best:
                continue
            ids[i], ids[j] = made[best], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((ids[i], ids[k]), NONE)) < NONE:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank((ids[k], ids[i]), NONE)) < NONE:
                heapq.heappush(heap, (r, k))
        return [i for i in ids if i >= 0]

    def decode(self, packed: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8, which parts of a text may give, become replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


class _Known(dict):
    """Encoded fragments; a miss encodes, and keeps short ones while there is room."""

    def __init__(self, codec: _Codec):
        self.codec = codec

    def __missing__(self, data: bytes) -> bytes:
        out = self.codec.fragment(data)
        if len(data) <= SHORT and len(self) < MOST_FRAGMENTS:
            self[data] = out
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _mapped(df: DataFrame, vocabulary: str, column: str, work, kind: pa.DataType) -> DataFrame:
    """Add a last column of Arrow type ``kind``: ``work`` (of a codec and a value) for each value of ``column``."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    ddl = f"{column[1]} {'binary' if kind == pa.binary() else 'string'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(sent.value)
        for batch in batches:
            values, first, held, done = batch.column(batch.schema.get_field_index(column[0])), 0, 0, []
            for i, x in enumerate(values):
                x = x.as_py() or b""
                done.append(work(codec, x))
                held += len(x)
                if held >= PIECE_BYTES or i + 1 == len(values):
                    part = batch.slice(first, len(done))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, kind)], [*batch.schema.names, column[1]])
                    first, held, done = i + 1, 0, []

    return df.mapInArrow(run, extended(df.schema, ddl))


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids`` (its tokens' ids, packed as little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``vocabulary`` is what ``load_vocabulary`` gives; it is broadcast, and its size is that of the file, whatever the corpus.
    A null or empty text has no tokens; texts of any length are encoded whole, in time n log n for a run without a cut.
    An added token's string in a text is that token. Repeated rows stay; other columns stay, but a column named
    ``ids`` or ``n_tokens`` is replaced. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in (text, "ids", "n_tokens")]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_utf8"))
    out = _mapped(given, vocabulary, ("_utf8", "ids"), _Codec.encode, pa.binary()).drop("_utf8")
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, vocabulary: str, decoded: str = "decoded") -> DataFrame:
    """Rows with the text of their ``ids`` as a column; null ids give an empty text, unknown ids raise."""
    given = encoded.drop(decoded)
    return _mapped(given, vocabulary, ("ids", decoded), _Codec.decode, pa.string())
