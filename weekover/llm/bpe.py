"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string is unique, and so is the last token of the encoding of each
of its prefixes. ``Prefixes`` stores that token for every prefix: the token ending at
``i`` is the one whose predecessor, the last token of the prefix before it, forms a valid
pair with it. A sequence is the encoding of its bytes exactly if all its adjacent pairs
are, so no search backtracks. Appending bytes only adds entries, and after an edit the
entries are the same again as soon as a longest token's worth of them agree.

Many short byte strings fill their entries in step: all their tokens are found by walking
a trie from every byte at once, then the entries of one length after the other are filled,
the longest token first. Only pairs of tokens that were never met are judged one by one.

``encode``, ``decode`` and ``recoded`` (both in one pass) are the operators on frames. Texts
are encoded whole, whatever their length; NULL and empty texts give no tokens; NULL ids
decode to empty bytes. Equal texts have equal ids, and an empty table gives an empty one.
Other columns pass through; an existing column with the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weekover.llm.common import with_columns

# Bounds of a worker's memory: remembered pieces and pairs, and the characters of texts
# looked at together. What is forgotten is found again.
PIECES, PAIRS, CHUNK_CHARS = 500_000, 400_000, 1 << 20
# Pieces up to this many bytes fill their entries in step.
SHORT_BYTES = 64
# A vocabulary is sent to every executor, so its file must stay below this size.
VOCABULARY_BYTES = 64 << 20


def merged(data: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """BPE by definition, for single tokens: join the pair of lowest rank while there is one.

    Stops at ``least`` parts.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        joined = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        k = min(range(len(joined)), key=joined.__getitem__)
        if joined[k] == len(ranks):
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


class Numbers:
    """A table from whole numbers (none negative) to small ones that is asked many at a time."""

    def __init__(self, bits: int):
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        self.shift, self.count = np.uint64(64 - bits), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that are not there."""
        found = np.full(len(keys), -1, np.int32)
        asked, at = np.arange(len(keys)), self._slots(keys)
        while len(asked):
            held = self.keys[at]
            hit = held == keys[asked]
            found[asked[hit]] = self.values[at[hit]]
            more = ~hit & (held >= 0)
            asked, at = asked[more], (at[more] + 1) & (len(self.keys) - 1)
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that differ and are not there; at most half of the slots may be used."""
        self.count += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            # Of keys that wanted one slot the last has it.
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)


class Vocabulary:
    """Ranks of a tiktoken file, and which pairs of tokens are encodings of their bytes."""

    def __init__(self, content: bytes):
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.reach = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._starts: dict[int, bool] = {}

    @functools.cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all tokens in a byte string, each byte taken as a character."""
        finder = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            finder.add_word(token.decode("latin-1"), (rank, len(token)))
        finder.make_automaton()
        return finder

    @functools.cached_property
    def trie(self) -> tuple[Numbers, np.ndarray]:
        """Node and byte to the next node, and the token that ends in each node (-1 for none)."""
        nodes: dict[int, int] = {}
        ends: list[int] = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = nodes.get(key, 0)
                if not node:
                    node = nodes[key] = len(ends)
                    ends.append(-1)
            ends[node] = rank
        table = Numbers((2 * len(nodes)).bit_length())
        table.add(np.fromiter(nodes, np.int64), np.fromiter(nodes.values(), np.int32))
        return table, np.array(ends, np.int32)

    @functools.cached_property
    def widths(self) -> np.ndarray:
        """Bytes of each token."""
        widths = np.zeros(max(self.tokens) + 1, np.int64)
        widths[list(self.sizes)] = list(self.sizes.values())
        return widths

    @functools.cached_property
    def table(self) -> pa.Array:
        """Bytes of each token, for ``take``; ids that do not exist are NULL."""
        return pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_binary())

    def decode(self, ids: pa.Array) -> pa.LargeBinaryArray:
        """Bytes of each id."""
        if len(ids) and not 0 <= pc.min(ids).as_py() <= pc.max(ids).as_py() < len(self.table):
            raise ValueError("an id is not in the vocabulary")
        known = self.table.take(ids)
        if known.null_count:
            raise ValueError("an id is not in the vocabulary")
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token's own bytes joins."""
        found = self._halves.get(token)
        if found is None:
            left, right = merged(self.tokens[token], self.ranks, 2)
            found = self._halves[token] = (self.ranks[left], self.ranks[right])
        return found

    def follows(self, first: int, second: int) -> bool:
        """Whether the two tokens are the encoding of their joint bytes."""
        key = (first, second)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.apart(first, second)
        return known

    def apart(self, first: int, second: int) -> bool:
        """Undoes merges from the latest on: nothing may have joined the two sides earlier.

        Of merges of one rank the left one comes first.
        """
        tokens, before = self.tokens, len(self.ranks)
        while True:
            a, b = tokens[first], tokens[second]
            if self.ranks.get(a + b, before) < before:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            if len(a) > 1 and (len(b) == 1 or first > second):
                before, first = first, self.halves(first)[1]
            else:
                before, second = second + 1, self.halves(second)[0]

    def starts(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self._starts.get(token)
        if known is None:
            own = self.tokens[token]
            known = self._starts[token] = merged(own, self.ranks) == [own]
        return known


class Prefixes:
    """The last token of every prefix of a byte string that may be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def become(self, data: bytes) -> None:
        """Start anew with other bytes."""
        self.data, self.last = data, [-1]
        self._extend(len(data))

    def _extend(self, stop: int) -> None:
        """Adds the entries up to ``stop``: of the tokens that end there, the one that follows validly."""
        v, last = self.vocabulary, self.last
        pair, done = v.pairs.get, len(last) - 1
        start = max(0, done + 1 - v.reach)
        for end, (token, size) in v.finder.iter(self.data[start:stop].decode("latin-1")):
            end += start + 1
            if end <= done:
                continue
            at = end - size
            if at:
                valid = pair((last[at], token))
                if valid is None:
                    valid = v.follows(last[at], token)
            else:
                valid = v.starts(token)
            if valid:
                last.append(token)
                done = end
        if done < stop:
            raise ValueError(f"no token ends with byte {self.data[done]}")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many entries had to be computed anew."""
        old = self.last[stop + 1 :]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start + 1 :]
        shift = start + len(new)
        agreed = 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end)
            k = end - shift - 1  # place among the entries behind the edit
            agreed = agreed + 1 if k >= 0 and self.last[end] == old[k] else 0
            # Entries look back at a longest token at most: what follows is as before.
            if agreed >= self.vocabulary.reach:
                self.last.extend(old[k + 1 :])
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        found, end, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while end:
            token = last[end]
            found.append(token)
            end -= sizes[token]
        found.reverse()
        return found


class Lockstep:
    """The last tokens of the prefixes of many short byte strings, filled in step."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # Judged pairs by last token + 1 (0 for the start) and next token.
        self.pairs = Numbers((2 * PAIRS).bit_length())

    def _valid(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (last.astype(np.int64) + 1) << 32 | token
        found = self.pairs.find(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.count + len(new) > PAIRS:
                self.pairs = Numbers((2 * max(PAIRS, len(new))).bit_length())
                new = np.unique(keys)
            v = self.vocabulary
            judged = [v.starts(k & 0xFFFFFFFF) if k >> 32 == 0 else v.apart((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()]
            self.pairs.add(new, np.array(judged, np.int32))
            found = self.pairs.find(keys)
        return found > 0

    def _matches(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, width, token) of all tokens in the data; ``left`` is how many bytes a start may reach over."""
        nodes, ends = self.vocabulary.trie
        start, node, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for width in range(1, self.vocabulary.reach + 1):
            fits = left[start] >= width
            start, node = start[fits], node[fits]
            if not len(start):
                break
            node = nodes.find(node << 8 | data[start + width - 1]).astype(np.int64)
            start, node = start[node >= 0], node[node >= 0]
            token = ends[node]
            own = token >= 0
            found.append((start[own], np.full(own.sum(), width), token[own]))
        return tuple(map(np.concatenate, zip(*found)))

    def encode(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the strings one after the other, and the number of ids of each; no string is empty."""
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        stops = np.cumsum(sizes)
        string = np.repeat(np.arange(len(strings)), sizes)
        start, width, token = self._matches(data, stops[string] - np.arange(len(data)))
        # Entry p + k + 1 belongs to the prefix of string k that ends behind byte p.
        origin, own = stops - sizes, string[start]
        behind, before = start + width + own, start + own
        # By end, the longest first; ``turn`` is a token's place among those of its end.
        order = np.argsort(behind * (self.vocabulary.reach + 1) - width)
        start, width, token, behind, before = (x[order] for x in (start, width, token, behind, before))
        first = np.concatenate([[True], behind[1:] != behind[:-1]])
        turn = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        steps = (start + width - origin[string[start]]) * (self.vocabulary.reach + 1) + turn
        order = np.argsort(steps, kind="stable")
        steps = steps[order]
        last = np.full(len(data) + len(strings), -2, np.int32)
        last[origin + np.arange(len(strings))] = -1
        for part in np.split(order, np.flatnonzero(steps[1:] != steps[:-1]) + 1):
            part = part[(last[behind[part]] == -2) & (last[before[part]] != -2)]
            if len(part):
                part = part[self._valid(last[before[part]], token[part])]
                last[behind[part]] = token[part]
        end, at, found = stops + np.arange(len(strings)), np.arange(len(strings)), []
        counts = np.zeros(len(strings), np.int64)
        while len(at):
            token = last[end]
            if (token < 0).any():
                raise ValueError(f"no token ends a prefix of {strings[at[np.flatnonzero(token < 0)[0]]]!r}")
            found.append((at, token))
            counts[at] += 1
            end = end - self.vocabulary.widths[token]
            more = last[end] != -1
            at, end = at[more], end[more]
        # Ids were found from the last one backwards.
        ids, place = np.empty(counts.sum(), np.int32), np.cumsum(counts)
        for step, (own, token) in enumerate(found):
            ids[place[own] - 1 - step] = token
        return ids, counts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each entry, one entry after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts; remembers the ids of a bounded number of pieces."""

    def __init__(self, content: bytes, pattern: str):
        self.vocabulary = Vocabulary(content)
        self.split = regex.compile(pattern).findall
        self.lockstep = Lockstep(self.vocabulary)
        self._forget()

    def _forget(self) -> None:
        # Places of pieces, and by place the start and number of their ids.
        self.place: dict[str, int] = {}
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, pieces: set[str]) -> None:
        """The given pieces have a place afterwards."""
        new = [piece for piece in pieces if piece not in self.place]
        if len(self.place) + len(new) > PIECES:
            self._forget()
            new = list(pieces)
        if not new:
            return
        strings = [piece.encode("utf-8", "surrogatepass") for piece in new]
        short = [k for k, s in enumerate(strings) if 0 < len(s) <= SHORT_BYTES]
        counts = np.zeros(len(new), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)]
        starts = np.zeros(len(new), np.int64)
        done = 0
        if short:
            ids, counts[short] = self.lockstep.encode([strings[k] for k in short])
            starts[short] = np.cumsum(counts[short]) - counts[short]
            parts.append(ids)
            done = len(ids)
        for k in (k for k, s in enumerate(strings) if len(s) > SHORT_BYTES):
            ids = np.array(Prefixes(self.vocabulary, strings[k]).tokens(), np.int32)
            parts.append(ids)
            starts[k], counts[k], done = done, len(ids), done + len(ids)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *parts])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids one text after the other, number of ids of each text) of some texts at a time."""
        waiting, chars = [], 0
        for text in chain(texts, (None,)):
            if waiting and (chars > CHUNK_CHARS or text is None):
                self._learn(set().union(*waiting))
                sizes = np.fromiter(map(len, waiting), np.int64, len(waiting))
                places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(waiting)), np.int64, sizes.sum())
                counts = self.counts[places]
                ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                yield self.ids[_spread(self.starts[places], counts)], np.diff(ends)
                waiting, chars = [], 0
            if text is not None:
                waiting.append(self.split(text))
                chars += len(text)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(content, pattern)


@functools.lru_cache(maxsize=2)
def _decoder(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return content


def _send(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _ids(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    parts = list(encoder.encode_all(x.as_py() or "" for x in texts))
    offsets = np.zeros(len(texts) + 1, np.int32)
    if parts:
        np.cumsum(np.concatenate([counts for _, counts in parts]), out=offsets[1:])
    values = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _bytes(vocabulary: Vocabulary, column: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    known = vocabulary.decode(pc.list_flatten(column))
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    # All bytes of the batch in one, cut at the texts' ends.
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(known)))])[np.concatenate([[0], np.cumsum(counts)])]
    data = known.buffers()[2] or pa.py_buffer(b"")
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), data]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), buffers).cast(pa.binary())


IDS = T.ArrayType(T.IntegerType())


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    text: str = "text",
    output: str = "tokens",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds the ids of the whole text; each match of ``pattern`` is encoded separately."""
    sent = _send(docs.sparkSession, vocabulary_path)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {output: _ids(_encoder(sent.value, pattern), batch.column(0))}

    return with_columns(docs, make, [text], {output: IDS}, keep)


def decode(
    docs: DataFrame,
    vocabulary_path: str,
    tokens: str = "tokens",
    output: str = "decoded",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds the bytes of the ids; empty for NULL. An id outside the vocabulary is an error."""
    sent = _send(docs.sparkSession, vocabulary_path)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {output: _bytes(_decoder(sent.value), batch.column(0))}

    return with_columns(docs, make, [tokens], {output: T.BinaryType()}, keep)


def recoded(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    text: str = "text",
    tokens: str = "tokens",
    output: str = "decoded",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds the ids of the whole text and the bytes they decode to, in one pass and one worker."""
    sent = _send(docs.sparkSession, vocabulary_path)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder = _encoder(sent.value, pattern)
        ids = _ids(encoder, batch.column(0))
        return {tokens: ids, output: _bytes(encoder.vocabulary, ids)}

    return with_columns(docs, make, [text], {tokens: IDS, output: T.BinaryType()}, keep)
