"""Byte-level BPE from a rank file by a lazily determinised finite-state transducer.

A rank file gives every token a rank; of all neighbours in a piece whose joined bytes are a
token, those of least rank merge first, the leftmost of equals. A piece that is a token as
a whole is that token.

* **Compiling the merges.** Every token is merged once from its bytes, which gives the two
  parts of its last merge. Two tokens may stand side by side only if merging their joined
  bytes gives just these two (`Merges.fits`); a sequence of tokens is a piece's encoding
  exactly if all neighbours fit. So the transducer's plain form has a configuration for
  every cut of the bytes read so far: the last whole token, the trie node of the token begun
  after it, and the tokens not yet emitted.
* **Determinising lazily.** A state is the set of configurations that one run of bytes
  leads to, without those that no fitting token can end. What all of them have in common
  is emitted by the transition, so a token leaves after a bounded lookahead, of less than
  the longest token. Transitions are made when a text first takes them and are kept in a
  hash table; past MOST_STATES states the tables are emptied before the next slice.
* **Running it.** All pieces of a slice of rows step together, one byte at a time, by numpy
  look-ups; the last few long pieces go on one by one. Cost is linear in the bytes.
* **Pieces** are cut by the usual byte-level pattern (PATTERN), over all rows at once:
  classes of code points, then run borders, then the three exceptions of the pattern.
* **Decoding** cuts token bytes from one blob by an offset table; text comes out of them by
  an incremental UTF-8 state machine that holds back an unfinished character only.

Null and empty texts have no tokens. Null id lists decode to null; unknown ids and bytes
that no token holds raise an error. Bytes that are not UTF-8 become U+FFFD. Repeated rows,
empty tables and null ids need no care: rows are encoded one by one. Input columns that
carry a result's name are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from bandwright.llm.frames import beside, extended, mapped, without
from bandwright.llm.words import bytes_of, plain, slices

#: The piece pattern of byte-level BPE; \s is Unicode's White_Space property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
MOST_STATES = 250_000
FEW = 8
# Below a node of more tokens than this some token is taken to fit; a wrong guess only delays output.
CHECKED = 8
CHUNK = 4096
START = ((-1, 0, ()),)


class Merges:
    """Tokens of a rank file's content, and which of them may stand side by side."""

    def __init__(self, content: bytes):
        lines = (line.split() for line in content.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = 1 + max(self.ranks.values(), default=-1)
        self.tokens: list[bytes | None] = [None] * size
        for token, i in self.ranks.items():
            self.tokens[i] = token
        # Of a token: its last merge's parts; -1 for a single byte; None if merging never gives it.
        self.parts: list[tuple[int, int] | int | None] = [None] * size
        # Tokens some merge of which comes after a later one; their times are not their ranks.
        self.uneven: set[int] = set()
        for token, i in sorted(self.ranks.items(), key=lambda x: (len(x[0]), x[1])):
            if len(token) == 1:
                self.parts[i] = -1
                continue
            out, last = self.merge(token)
            if len(out) == 1 and last:
                self.parts[i] = last
                if any(p in self.uneven or self.parts[p] != -1 and p > i for p in last):
                    self.uneven.add(i)

    def merge(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Token ids of a short string merged by rank, and what the last merge joined."""
        ranks, parts, last = self.ranks, [data[i:i + 1] for i in range(len(data))], None
        while True:
            joined = (ranks.get(a + b) for a, b in zip(parts, parts[1:]))
            best = min(((r, i) for i, r in enumerate(joined) if r is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts], last
            i = best[1]
            last = ranks[parts[i]], ranks[parts[i + 1]]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged by rank, give just `left` and `right`.

        Undoes the latest merge of either side again and again; at no time may the tokens
        at the border have been the next to merge.
        """
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        if self.uneven and (left in self.uneven or right in self.uneven):
            return self.merge(tokens[left] + tokens[right])[0] == [left, right]
        before = len(tokens)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            a, b = parts[left], parts[right]
            if a == -1 and b == -1:
                return True
            if b == -1 or a != -1 and left > right:
                before, left = left, a[1]
            else:  # of equal ranks the left one merges first, so the right one is undone first
                before, right = right + 1, b[0]


class Transducer:
    def __init__(self, content: bytes):
        self.merges = Merges(content)
        self.kids: list[dict[int, int]] = [{}]
        # Of a trie node: the token ending there that merging gives, and one that it never gives.
        self.ends, self.wholes = [-1], [-1]
        for token, i in self.merges.ranks.items():
            node = 0
            for byte in token:
                after = self.kids[node].get(byte)
                if after is None:
                    after = self.kids[node][byte] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                    self.wholes.append(-1)
                node = after
            (self.ends if self.merges.parts[i] is not None else self.wholes)[node] = i
        self.below = [0] * len(self.kids)
        for node in range(len(self.kids) - 1, -1, -1):
            self.below[node] = (self.ends[node] >= 0) + sum(self.below[k] for k in self.kids[node].values())
        self.clear()

    def clear(self) -> None:
        """Forgets all states and transitions."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.finals = np.full(1 << 12, -1, np.int32)
        self.lives: dict[tuple[int, int], bool] = {}
        # What transitions emit: number 0 is nothing.
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.flat: list[int] = []
        self.offset, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        # Open addressing: key is state * 256 + byte.
        self.bits, self.count = 16, 0
        self._table(1 << self.bits)
        self.number(START)

    def _table(self, slots: int) -> None:
        self.keys = np.full(slots, -1, np.int64)
        self.after, self.out = np.empty(slots, np.int32), np.empty(slots, np.int32)

    def live(self, token: int, node: int) -> bool:
        """Whether some token at or below the node may follow `token`."""
        if self.below[node] > CHECKED:
            return True
        known = self.lives.get((token, node))
        if known is None:
            known, open_nodes = False, [node]
            while open_nodes and not known:
                at = open_nodes.pop()
                known = self.ends[at] >= 0 and self.merges.fits(token, self.ends[at])
                open_nodes.extend(self.kids[at].values())
            self.lives[token, node] = known
        return known

    def number(self, state: tuple) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            if known >= len(self.finals):
                self.finals = np.concatenate([self.finals, np.full_like(self.finals, -1)])
            whole = next((self.wholes[n] for t, n, _ in state if t < 0 and self.wholes[n] >= 0), None)
            last = next((rest for _, node, rest in state if node == 0), None)
            if whole is not None or last is not None:
                self.finals[known] = self.emission(last if whole is None else (whole,))
        return known

    def emission(self, tokens: tuple[int, ...]) -> int:
        known = self.emitted.get(tokens)
        if known is None:
            known = self.emitted[tokens] = len(self.emitted)
            if known >= len(self.size):
                self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
                self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.offset[known], self.size[known] = len(self.flat), len(tokens)
            self.flat += tokens
        return known

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the number of what is emitted on the way."""
        configurations = []
        fits, live = self.merges.fits, self.live
        for token, node, rest in self.states[state]:
            after = self.kids[node].get(byte)
            if after is None:
                continue
            end, below = self.ends[after], self.kids[after].values()
            if end >= 0 and (token < 0 or fits(token, end)):
                configurations.append((end, 0, (*rest, end)))
            if token < 0 and (below or self.wholes[after] >= 0) or token >= 0 and any(live(token, n) for n in below):
                configurations.append((token, after, rest))
        if not configurations:
            raise ValueError("a byte that no token of the vocabulary holds")
        first, least = configurations[0][2], min(len(rest) for _, _, rest in configurations)
        common = 0
        while common < least and all(rest[common] == first[common] for _, _, rest in configurations):
            common += 1
        rests = sorted((token, node, rest[common:]) for token, node, rest in configurations)
        return self.number(tuple(rests)), self.emission(first[:common])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray) -> None:
        """Makes the transitions of keys that are not in the table."""
        if (self.count + len(keys)) * 2 > len(self.keys):
            used = self.keys >= 0
            old = self.keys[used], self.after[used], self.out[used]
            while (self.count + len(keys)) * 2 > 1 << self.bits:
                self.bits += 1
            self._table(1 << self.bits)
            self._place(*old)
        made = [self.transition(key >> 8, key & 255) for key in keys.tolist()]
        after, out = np.array(made, np.int32).T
        self._place(keys, after, out)
        self.count += len(keys)

    def _place(self, keys: np.ndarray, after: np.ndarray, out: np.ndarray) -> None:
        mask = len(self.keys) - 1
        for key, slot, a, o in zip(keys.tolist(), self._home(keys).tolist(), after.tolist(), out.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.after[slot], self.out[slot] = key, a, o

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the table holds the keys; missing transitions are made."""
        while True:
            found, mask = self._home(keys), len(self.keys) - 1
            there = self.keys[found]
            wrong = np.flatnonzero(there != keys)
            missing = []
            while len(wrong):
                empty = there[wrong] < 0
                missing.append(keys[wrong[empty]])
                wrong = wrong[~empty]
                found[wrong] = (found[wrong] + 1) & mask
                there[wrong] = self.keys[found[wrong]]
                wrong = wrong[there[wrong] != keys[wrong]]
            lacking = np.unique(np.concatenate(missing)) if missing else ()
            if not len(lacking):
                return found
            self._insert(lacking)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces data[start:end], one after the other, and their number for each piece."""
        if len(self.states) > MOST_STATES:
            self.clear()
        order = np.argsort(start - end, kind="stable")
        at, length = start[order], (end - start)[order]
        n, state = len(at), np.zeros(len(at), np.int64)
        counts, events = np.zeros(n, np.int64), []

        def emit(which: np.ndarray, numbers: np.ndarray) -> None:
            events.append((which, counts[which], numbers))
            counts[which] += self.size[numbers]

        step, active = 0, n
        while active > FEW:
            slot = self.slots(state[:active] << 8 | data[at[:active] + step])
            state[:active] = self.after[slot]
            said = np.flatnonzero(self.out[slot])
            emit(said, self.out[slot[said]])
            step += 1
            going = int(np.searchsorted(-length, -step, "left"))
            ended = np.arange(going, active)
            emit(ended, self.finals[state[ended]])
            active = going
        for i in range(active):
            self._finish(i, int(state[i]), data[at[i] + step:at[i] + length[i]].tobytes(), emit)
        if any((numbers < 0).any() for _, _, numbers in events):
            raise ValueError("a piece that the vocabulary's tokens cannot spell")
        return self._flatten(order, counts, events)

    def _finish(self, i: int, state: int, rest: bytes, emit) -> None:
        """Steps one long piece to its end."""
        mask = len(self.keys) - 1
        for byte in rest:
            key = state << 8 | byte
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while (there := self.keys[slot]) != key:
                if there < 0:
                    slot = int(self.slots(np.array([key]))[0])
                    mask = len(self.keys) - 1
                    break
                slot = (slot + 1) & mask
            state = int(self.after[slot])
            if self.out[slot]:
                emit(np.array([i]), self.out[slot:slot + 1].copy())
        emit(np.array([i]), self.finals[state:state + 1])

    def _flatten(self, order: np.ndarray, counts: np.ndarray, events: list) -> tuple[np.ndarray, np.ndarray]:
        """The emitted tokens at their places, in the order of the pieces."""
        numbers = np.empty_like(counts)
        numbers[order] = counts
        first = (np.cumsum(numbers) - numbers)[order]
        ids = np.empty(int(counts.sum()), np.int32)
        flat = np.array(self.flat, np.int32)
        for which, before, what in events:
            place, source, size = first[which] + before, self.offset[what], self.size[what]
            for k in range(int(size.max(initial=0))):
                more = size > k
                ids[place[more] + k] = flat[source[more] + k]
        return ids, numbers


class Stream:
    """Encodes one piece that arrives in parts; tokens leave as soon as they are certain."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.configurations = transducer, transducer.number(START)

    def push(self, data: bytes) -> list[int]:
        said, t = [], self.transducer
        for byte in data:
            self.configurations, number = t.transition(self.configurations, byte)
            said += t.flat[t.offset[number]:t.offset[number] + t.size[number]]
        return said

    def pending(self) -> int:
        """The most tokens that a configuration still holds back."""
        return max(len(rest) for _, _, rest in self.transducer.states[self.configurations])

    def close(self) -> list[int]:
        t, number = self.transducer, self.transducer.finals[self.configurations]
        self.configurations = t.number(START)
        return t.flat[t.offset[number]:t.offset[number] + t.size[number]] if number > 0 else []


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the engine sees it that rank-file encoders cut with.

    Versions of Unicode differ between engines; an encoder of single bytes shows what its
    patterns match.
    """
    single_bytes = {bytes([i]): i for i in range(256)}
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        engine = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        matched = bytes(engine.encode_ordinary(everything)).decode()
        found[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return found


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, where the matches of PATTERN start and the last ends, each row's first match."""
    data, ends = bytes_of(texts)
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n, kind = len(points), classes()[points]
    rows = np.searchsorted(places, ends)
    opens = np.zeros(n + 1, bool)
    opens[rows] = True
    border = opens[:n].copy()
    border[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else is a match of its own, or a blank before it.
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:n])
    border[last] = True
    border[last[points[last] == ord(" ")] + 1] = False
    # Contractions, where an apostrophe starts a match: after it one letter, or two.
    marks = np.flatnonzero(border[:-1] & (points[:-1] == ord("'")) & ~opens[1:n])
    one = points[marks + 1]
    two = np.where((marks + 2 < n) & ~opens[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    border = np.append(border, True)
    border[marks[single | double] + 1] = False
    border[marks[single] + 2] = True
    border[marks[double] + 3] = True
    starts = np.flatnonzero(border)
    return data, places[starts], np.searchsorted(starts, rows)


class Utf8Stream:
    """An incremental UTF-8 state machine: text comes out as soon as its characters are whole."""

    def __init__(self):
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = next((i for i in range(len(data) - 1, max(len(data) - 4, -1), -1) if data[i] >= 0xC0), len(data))
        state = "start"
        for byte in data[cut:]:
            state = _next(state, byte)
        if state in ("start", "wrong"):
            cut = len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


#: From a state by a range of bytes to a state: "one" to "three" more bytes are due; after
#: some first bytes the second one has a narrower range.
_UTF8 = {
    "start": [(0x00, 0x7F, "start"), (0xC2, 0xDF, "one"), (0xE0, 0xE0, "after_e0"), (0xE1, 0xEC, "two"),
              (0xED, 0xED, "after_ed"), (0xEE, 0xEF, "two"), (0xF0, 0xF0, "after_f0"), (0xF1, 0xF3, "three"),
              (0xF4, 0xF4, "after_f4")],
    "one": [(0x80, 0xBF, "start")], "two": [(0x80, 0xBF, "one")], "three": [(0x80, 0xBF, "two")],
    "after_e0": [(0xA0, 0xBF, "one")], "after_ed": [(0x80, 0x9F, "one")],
    "after_f0": [(0x90, 0xBF, "two")], "after_f4": [(0x80, 0x8F, "two")], "wrong": [],
}


def _next(state: str, byte: int) -> str:
    return next((to for lo, hi, to in _UTF8[state] if lo <= byte <= hi), "wrong")


class Decoder:
    def __init__(self, merges: Merges):
        tokens = [t or b"" for t in merges.tokens]
        self.known = np.array([t is not None for t in merges.tokens], bool)
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def raw(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("ids outside the vocabulary")
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[places].tobytes()

    def stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that arrive in parts; a character cut by a part waits for the next."""
        machine = Utf8Stream()
        for ids in parts:
            yield machine.push(self.raw(ids))
        yield machine.close()

    def text(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids[i:i + CHUNK] for i in range(0, len(ids), CHUNK)))


# One per worker process and vocabulary, so that a worker's next task finds its states.
_transducers: dict[int, Transducer] = {}


def transducer(content: bytes) -> Transducer:
    key = hash(content)
    if key not in _transducers:
        _transducers.clear()
        _transducers[key] = Transducer(content)
    return _transducers[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_rows(machine: Transducer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and how many each row has."""
    ids, numbers = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for lo, hi in slices(texts):
        data, cuts, first = pieces(texts.slice(lo, hi - lo))
        found, counts = machine.encode(data, cuts[:-1], cuts[1:])
        sums = np.concatenate([[0], np.cumsum(counts)])
        ids.append(found)
        numbers.append(np.diff(sums[first]))
    return np.concatenate(ids), np.concatenate(numbers)


def encode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
    packed: str | None = None,
) -> DataFrame:
    """`docs` with the token ids of the whole text as array<int>.

    With the name `packed` also with the ids as little-endian unsigned 32-bit integers, with
    `decoded` with the bytes decoded from the ids, in the same pass.
    """
    docs = without(docs, [ids, packed or ids, decoded or ids])
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(content.value)
        decoder = Decoder(machine.merges) if decoded else None
        for batch in batches:
            values, numbers = encode_rows(machine, plain(batch.column(text)))
            ends = np.concatenate([[0], np.cumsum(numbers)])
            rows = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            added = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))}
            if packed:
                added[packed] = pa.array([values[a:b].astype("<u4").tobytes() for a, b in rows], pa.binary())
            if decoder:
                added[decoded] = pa.array([decoder.raw(values[a:b]) for a, b in rows], pa.binary())
            yield beside(batch, added)

    binary = [(name, "binary") for name in (packed, decoded) if name]
    return mapped(docs, run, extended(docs, [(ids, "array<int>"), *binary]))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text that the ids stand for."""
    docs = without(docs, [text])
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(transducer(content.value).merges)
        for batch in batches:
            lists = batch.column(ids)
            texts = [decoder.text(x.values.to_numpy()) if x.is_valid else None for x in lists]
            yield beside(batch, {text: pa.array(texts, pa.string())})

    return mapped(docs, run, extended(docs, [(text, "string")]))
