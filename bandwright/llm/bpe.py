"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

Encoding splits a text at special tokens and then into pieces by the usual byte-level
pattern. Inside a piece an Aho-Corasick automaton proposes the longest tokens from left to
right. Two neighbours may stand side by side only if merging their joined bytes gives just
these two (`Vocabulary.fits`, kept in a table of pairs seen). Where they don't fit, the
encoder falls back to the token's longest prefix token, and steps back where none is left;
a bit for each position says whether it is known to lead nowhere, so that a piece takes
time linear in its length. The only sequence of fitting neighbours that covers a piece is
the one that merging by rank gives.

Decoding cuts token bytes from one blob by an offset table.

The vocabulary file (a tokenizers JSON with a byte-level BPE model) is a parameter; it is
read by the driver and broadcast. Null and empty texts have no tokens, null id lists decode
to null, unknown ids raise an error. Input columns that carry a result's name are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import plain

#: The piece pattern of byte-level BPE; white space is Unicode's White_Space property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_PIECES = 300_000
CACHED_PAIRS = 150_000
CACHED_LENGTH = 32
BASE = -1


def _byte_names() -> dict[str, int]:
    """How a vocabulary file writes bytes: printable ones as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merges and special tokens of one vocabulary file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        names, model = _byte_names(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.ids = {
            bytes(names[c] for c in name): i
            for name, i in model["vocab"].items()
            if name not in self.special
        }
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens: list[bytes | None] = [None] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        # Of a merged token: its rank and its two parts.
        self.rank, self.parts, self.merges = [BASE] * size, [None] * size, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = (self.ids[bytes(names[c] for c in part)] for part in (a, b))
            whole = self.ids[self.tokens[left] + self.tokens[right]]
            self.merges[left, right] = rank
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = rank, (left, right)

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged by rank, give just `left` and `right`.

        Goes back in time over the states of the border. In each, a merge across the
        border must not have come before the merge that ended this state.
        """
        before = len(self.merges)
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a == b == BASE:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:  # of equal merges the left one comes first, so the right one is undone first
                before, right = b + 1, self.parts[right][0]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.ids = {token.decode("latin-1"): i for token, i in vocabulary.ids.items()}
        self.size = [len(t or b"") for t in vocabulary.tokens]
        self.most = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[int, int | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.pattern = regex.compile(PIECES)
        self.cuts = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")

    def fits(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.vocabulary.fits(left, right)
        return found

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of `token`."""
        if token not in self.prefixes:
            text = self.vocabulary.tokens[token].decode("latin-1")
            lengths = range(len(text) - 1, 0, -1)
            self.prefixes[token] = next((self.ids[text[:n]] for n in lengths if text[:n] in self.ids), None)
        return self.prefixes[token]

    def match(self, piece: str, at: int) -> int | None:
        rest = piece[at:at + self.most]
        for n in range(self.longest.longest_prefix(rest), 0, -1):
            found = self.ids.get(rest[:n])
            if found is not None:
                return found
        return None

    def piece(self, piece: str) -> list[int]:
        """Token ids of one piece (bytes as latin-1 characters)."""
        greedy = [i for _, i in self.longest.iter_long(piece)]
        pairs = self.pairs
        for k in range(1, len(greedy)):
            pair = greedy[k - 1], greedy[k]
            fit = pairs.get(pair)
            if fit is None:
                fit = self.fits(*pair)
            if not fit:
                return self.backtrack(piece, greedy[:k], greedy[k])
        return greedy

    def backtrack(self, piece: str, out: list[int], token: int | None) -> list[int]:
        """Goes on after the fitting tokens `out`, where `token` is the longest match."""
        at = sum(self.size[i] for i in out)
        size, total = self.size, len(piece)
        dead = bytearray(total + 1)
        while at < total:
            end = at + size[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at, token = end, self.match(piece, end)
                continue
            token = self.shorter(token)
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        if not any(name in text for name in self.vocabulary.special):
            return self._plain(text)
        out, last = [], 0
        for cut in self.cuts.finditer(text):
            out += [self._plain(text[last:cut.start()]), np.int32(self.vocabulary.special[cut[0]]).tobytes()]
            last = cut.end()
        return b"".join([*out, self._plain(text[last:])])

    def _plain(self, text: str) -> bytes:
        out, known = [], self.pieces
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.piece(piece.encode().decode("latin-1")), np.int32).tobytes()
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        tokens = [t or b"" for t in vocabulary.tokens]
        self.known = np.array([t is not None for t in vocabulary.tokens])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("ids outside the vocabulary")
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[places].tobytes().decode("utf-8", "replace")


# One per worker process and vocabulary, so that a worker's next task finds its tables full.
_encoders: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(_vocabulary(content))
    return _encoders[key]


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    key = hash(content)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(content)
    return _vocabularies[key]


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """`docs` with the token ids of the whole text as array<int>.

    With the name `decoded` also with the text decoded from the ids, in the same pass.
    """
    docs = without(docs, [ids, decoded or ids])
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        decoder = Decoder(encoder.vocabulary) if decoded else None
        for batch in batches:
            ends, parts, texts = [0], [], []
            for value in plain(batch.column(text)):
                parts.append(encoder.packed(value.as_py()))
                ends.append(ends[-1] + len(parts[-1]) // 4)
                if decoder:
                    texts.append(decoder.decode(np.frombuffer(parts[-1], np.int32)))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            added = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
            if decoded:
                added[decoded] = pa.array(texts, pa.string())
            yield beside(batch, added)

    fields = [(ids, "array<int>"), *([(decoded, "string")] if decoded else [])]
    return mapped(docs, run, extended(docs, fields))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text that the ids stand for."""
    docs = without(docs, [text])
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(_vocabulary(content.value))
        for batch in batches:
            lists = batch.column(ids)
            texts = [decoder.decode(x.values.to_numpy()) if x.is_valid else None for x in lists]
            yield beside(batch, {text: pa.array(texts, pa.string())})

    return mapped(docs, run, extended(docs, [(text, "string")]))
