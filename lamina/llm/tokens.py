"""BPE encoding and decoding by content-defined chunks that are encoded once and reused.

A rolling hash over the last bytes picks chunk ends at any character, so equal passages fall into equal chunks
whatever stands before them, and a cut may part a word, a number or a run of spaces. Each distinct chunk is
encoded once per worker and kept in a bounded table. Then every joint is repaired: from the last piece of
the left chunk that nothing to the right can change, pieces are cut anew across the joint until one ends where
a piece of the right chunk ends as well; what lies between is encoded anew. The look to the right doubles until
that happens; if it never does, both chunks become one, with as many of the next ones as there is text left of the joint, so
that text without breaks is read and encoded about twice at most. From such a place on the right chunk's own ids
hold, as the pre-tokenizer never looks back; it looks ahead by LOOK characters at most.

Ids equal those of the tokenizers library on the whole text with add_special_tokens=False.
Defined cases: a null text counts as empty (no ids, empty decoded text); repeated rows each get a result;
a text that holds a special token is one chunk; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lamina.llm.common import as_bytes, columns, mix, slices

#: One place in 2**MASK_BITS ends a chunk.
MASK_BITS = 8
#: Bytes before a place that the rolling hash sees.
ROLL = 8
#: Chunks, and repaired joints, that a worker keeps; then it starts anew.
KEPT = 40_000
#: Characters of a text left of a joint from which on the joint is not kept.
LONG = 4096
#: Characters after a piece that can decide its end; characters right of a joint that are looked at first.
LOOK, FIRST = 3, 24
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 2 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else 256 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary file as an encoder; its merge order is the order of its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@dataclass(slots=True)
class Chunk:
    """A text and its ids; tail: its end from the last piece that starts LOOK characters before the end or earlier."""

    text: str
    ids: np.ndarray
    tail_at: int
    tail: str
    tail_size: int


class Codec:
    """Encodes and decodes with bounded tables of chunks and joints."""

    def __init__(self, path: str, kept: int = KEPT, mask_bits: int = MASK_BITS):
        self.t, self.kept, self.mask = encoding(path), kept, np.uint64((1 << mask_bits) - 1)
        self.special = sorted(self.t.special_tokens_set)
        self.pieces = regex.compile(PATTERN)
        self.chunks: dict[bytes, Chunk] = {}
        self.joints: dict[tuple[str, str], tuple | None] = {}
        number = [b"%d," % i for i in range(self.t.n_vocab)]
        self.size = np.array([len(x) for x in number])
        self.flat = np.frombuffer(b"".join(number), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def ids(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.t.encode(text, allowed_special="all")
        return self.t.encode_ordinary(text)

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sorted chunk starts: those of the documents, and the characters that the rolling hash chooses."""
        n = len(buf)
        roll = np.zeros(n, np.uint64)
        for k in range(1, min(ROLL, n - 1) + 1):
            roll[k:] += (buf[: n - k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x100000001B3**k % (1 << 64))
        # bytes 0x80 to 0xBF go on with a character
        at = np.flatnonzero(((mix(roll) & self.mask) == 0) & ((buf & 0xC0) != 0x80))
        held = [x.encode() for x in self.special]
        data = buf.tobytes()
        if any(x in data for x in held):
            whole = np.array([any(x in data[a:b] for x in held) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
            at = at[~whole[np.searchsorted(offs, at, "right") - 1]]
        return np.unique(np.concatenate((at, offs[:-1][offs[:-1] < offs[1:]])))

    def chunk(self, text: str) -> Chunk:
        """Encode a text that starts at the start of a piece."""
        last = 0
        for m in self.pieces.finditer(text):
            if m.start() > len(text) - LOOK:
                break
            last = m.start()
        ids = self.ids(text)
        return Chunk(text, np.array(ids, np.int32), last, text[last:], len(self.ids(text[last:])) if last else len(ids))

    def known(self, data: bytes) -> Chunk:
        got = self.chunks.get(data)
        if got is None:
            got = self.chunk(data.decode())
            if len(self.chunks) >= self.kept:
                self.chunks.clear()
            self.chunks[data] = got
        return got

    def joint(self, tail: str, right: str) -> tuple[int, int, list[int]] | None:
        """(characters and ids of the right chunk that are replaced, new ids from the tail on); None if the two never agree."""
        look = FIRST
        while True:
            head = right[:look]
            key = (tail, head)
            if len(tail) > LONG:
                got = self._agreement(tail, head)
            elif key not in self.joints:
                if len(self.joints) >= self.kept:
                    self.joints.clear()
                self.joints[key] = self._agreement(tail, head)
                got = self.joints[key]
            else:
                got = self.joints[key]
            if got is not None or len(head) == len(right):
                return got
            look *= 2

    def _agreement(self, tail: str, head: str) -> tuple[int, int, list[int]] | None:
        n, most = len(tail), len(head) - LOOK
        own, ends = [0], {0: 0}  # ends of the right chunk's pieces, by their number
        for m in self.pieces.finditer(head):
            if m.end() > most:
                break
            own.append(m.end())
            ends[m.end()] = len(own) - 1
        both, text = [], tail + head
        for m in self.pieces.finditer(text):
            p = m.end() - n
            if p > most:
                return None
            both.append((m.start(), m.end()))
            if p in ends:
                new = [i for a, b in both for i in self.t.encode_ordinary(text[a:b])]
                gone = sum(len(self.t.encode_ordinary(head[a:b])) for a, b in zip(own[: ends[p]], own[1:]))
                return p, gone, new
        return None

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets per document)."""
        data = buf.tobytes()
        starts = self.cuts(buf, offs)
        first = offs[np.searchsorted(offs, starts)] == starts if len(starts) else np.zeros(0, bool)
        out: list[np.ndarray] = []
        doc_sizes: list[int] = []
        left: Chunk | None = None
        begin, end, first = starts.tolist(), [*starts[1:].tolist(), len(data)], first.tolist()
        k = 0
        while k < len(begin):
            begins, right = first[k], self.known(data[begin[k] : end[k]])
            k += 1
            if begins:
                doc_sizes.append(0)
                out.append(right.ids)
                doc_sizes[-1] += len(right.ids)
                left = right
                continue
            found = self.joint(left.tail, right.text)
            doc_sizes[-1] -= left.tail_size
            out[-1] = out[-1][: len(out[-1]) - left.tail_size]
            if found is None or right.tail_at < found[0]:
                # no piece ends in both, or none is left from which to go on: one chunk of both
                parts, size = [left.tail, right.text], len(left.tail) + len(right.text)
                while size < 2 * len(left.tail) and k < len(begin) and not first[k]:
                    parts.append(data[begin[k] : end[k]].decode())
                    size += len(parts[-1])
                    k += 1
                left = self.chunk("".join(parts))
                out.append(left.ids)
                doc_sizes[-1] += len(left.ids)
                continue
            _, gone, new = found
            out.append(np.array(new, np.int32))
            out.append(right.ids[gone:])
            doc_sizes[-1] += len(new) + len(right.ids) - gone
            left = right
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        per = np.zeros(len(offs) - 1, np.int64)
        per[np.flatnonzero(np.diff(offs) > 0)] = doc_sizes
        return ids, np.concatenate(([0], np.cumsum(per)))

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each followed by a comma."""
        n = self.size[ids]
        at = np.cumsum(n) - n
        return self.flat[np.repeat(self.at[ids] - at, n) + np.arange(int(n.sum()))].tobytes()

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        return [self.t.decode_bytes(ids[a:b].tolist()).decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; with_ids adds token_ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            key, text = columns(batch, id_col, text_col)
            buf, offs = as_bytes(text)
            for a, b in slices(offs, SLICE):
                ids, at = c.encode(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                joined, ends = c.joined(ids), np.concatenate(([0], np.cumsum(c.size[ids])))[at]
                decoded = c.decode(ids, at)
                sha = [hashlib.sha256(joined[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [key.slice(a, b - a), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())]
                    names += ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        # workers live on; other stages need the memory
        c.chunks.clear()
        c.joints.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", token_ids array<int>, decoded string" if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
