"""Byte-level byte-pair encoding by backtracking, and decoding by an offset table.

The tokens that byte-pair merging gives are the only sequence in which every neighbouring pair is compatible: merging
the two tokens' bytes alone gives back just these two. So a piece is encoded from left to right with the longest token
that starts at each place (one Aho-Corasick pass finds them all), the next shorter one where the pair is not
compatible, and one step back where no token fits. A place that was found to lead nowhere is never tried again, so
the time is linear in the piece's length.

A text is first parted at the special tokens and into pieces as the tokenizer's pattern has it. A place after a
character that is not white space and before a space always lies between two pieces; so the text is cut there, and the
ids of such chunks are remembered.

Decoding gathers the bytes of all tokens, which lie one after the other with an offset per id.

Null texts count as empty: no ids, and the empty text back. Every text has a defined encoding, since each byte is a
token. Rows are encoded one by one, so repeated rows, ties and other columns do not matter.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pieces of a byte-level tokenizer
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
).findall
_RUNS = regex.compile(f"[{SPACE}] ").search
_CHUNKS = regex.compile(f"(?<=[^{SPACE}])(?= )", regex.V1).split
CACHED_CHUNKS, CACHED_CHARS = 700_000, 48
SCHEMA = "doc_id long, ids binary, n_tokens long, decoded string"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_CODECS: dict = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (a byte-level BPE with merges)."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        # ranks: bytes first, then tokens in the order of their merges
        names = [c for c in letters if c in vocab] + ["".join(p) for p in pairs]
        rank = {}
        for name in names:
            rank.setdefault(name, len(rank))
        self.names = list(rank)
        self.id_of = [vocab[name] for name in self.names]
        self.parts: list[tuple[int, int] | None] = [None] * len(rank)
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            token = rank[left + right]
            self.merged[rank[left], rank[right]] = token
            if self.parts[token] is None:
                self.parts[token] = (rank[left], rank[right])
        self.size = [len(name) for name in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, token in rank.items():
            self.automaton.add_word(name, token)
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of each
        self.shorter: list[int] = [-1] * len(rank)
        for name, token in rank.items():
            for n in range(len(name) - 1, 0, -1):
                if name[:n] in rank:
                    self.shorter[token] = rank[name[:n]]
                    break
        self.agree: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.blank = letters[0x20]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.odd_special = any("<" not in x for x in self.special)
        self._offsets(vocab, {c: b for b, c in enumerate(letters)})

    def _offsets(self, vocab: dict[str, int], byte_of: dict[str, int]) -> None:
        held = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, token in vocab.items():
            held[token] = bytes(byte_of[c] for c in name)
        for name, token in self.special.items():
            held[token] = name.encode()
        self.blob = np.frombuffer(b"".join(held), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token a and token b alone gives a, b.

        Undo the merges of both, the latest first. While a merge is undone, the tokens that touch at the seam are
        those that touched before it happened; if they have a merge of lower rank than it, that one came first.
        """
        known = self.agree.get((a, b))
        if known is None:
            known = self.agree[a, b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        before = len(self.names)  # merges of lower rank than this have been done at this moment
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            # the later of the two merges is undone; of equal ones the right token's, as merging goes left to right
            if left > right and self.parts[left]:
                before, left = left, self.parts[left][1]
            elif self.parts[right]:
                before, right = right + 1, self.parts[right][0]
            elif self.parts[left]:
                before, left = left, self.parts[left][1]
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given in the characters that stand for its bytes."""
        n = len(piece)
        longest, size = [0] * n, self.size
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - size[token]] = token  # ends ascend, so the longest of a start comes last
        if size[longest[0]] == n:
            return [self.id_of[longest[0]]]
        live = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0 and not (live[at + size[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return [self.id_of[t] for t in out]
                token = longest[at]
            else:
                live[at] = False
                token = out.pop()
                at -= size[token]

    def encode_chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        if self.split_special is None or "<" not in chunk and not self.odd_special:
            parts = [chunk]
        else:
            parts = self.split_special(chunk)
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in PIECES(part):
                if piece.isascii() and piece.isprintable():
                    ids += self.encode_piece(piece.replace(" ", self.blank))
                else:
                    ids += self.encode_piece(piece.encode().decode("latin-1").translate(self.table))
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def learn(self, chunk: str) -> bytes:
        """The ids of a chunk, remembered. A full stop or comma after a letter is always a piece of its own."""
        if chunk[-1:] in (".", ",") and chunk[-2:-1].isalpha():
            word, mark = chunk[:-1], chunk[-1]
            head = self.known.get(word)
            if head is None:
                head = self.known[word] = self.encode_chunk(word)
            ids = head + self.encode_chunk(mark)
        else:
            ids = self.encode_chunk(chunk)
        self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _RUNS(text):
            chunks = _CHUNKS(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *[" " + x for x in rest]]
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        for chunk in chunks:
            if chunk not in known and len(chunk) <= CACHED_CHARS:
                self.learn(chunk)
        return b"".join([known[c] if c in known else self.encode_chunk(c) for c in chunks])

    def decode(self, ids: bytes) -> str:
        token = np.frombuffer(ids, "<u4")
        start, size = self.offset[token], self.offset[token + 1] - self.offset[token]
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size)
        return self.blob[shift + np.arange(len(shift))].tobytes().decode("utf-8", errors="replace")


def codec(path: str) -> Codec:
    """One codec per Python worker and tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded): ids as little-endian unsigned 32-bit integers, and the text they give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                ids = [tool.encode(t or "") for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([tool.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "n_tokens", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
