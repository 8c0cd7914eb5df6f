"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised, cut into characters, and an agenda of adjacent symbol pairs
merges the pair of the best score first, of equal scores the leftmost, until no
pair is a piece. Where no piece of the vocabulary holds a space after another
character, no merge crosses the start of a run of spaces; the text is cut there
and each distinct chunk goes through the agenda once a task: the agendas of all
new short chunks of an Arrow batch side by side in numpy, those of long chunks as
heaps. Each batch is checked against the sentencepiece library.
"""

from __future__ import annotations

import re
import struct
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import shared, sliced, text_or_empty

# Piece types, the BPE model type, and the sign of a space in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"

#: distinct chunks whose ids a task keeps before it starts anew
CHUNKS_KEPT = 800_000
#: text bytes whose new chunks go through their agendas at once
SLICE_BYTES = 4 << 20
#: characters up to which the agendas of chunks are kept side by side
SHORT = 40


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(buf: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(buf, at)
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


class _Pairs:
    """Pieces by the ids of their two halves: an open-addressed table that numpy looks up in bulk."""

    SHIFT = 21  # ids, of pieces or of characters without one, are below 2 ** 21

    def __init__(self, left: np.ndarray, right: np.ndarray, piece: np.ndarray):
        self.bits = max(4, int(4 * len(piece)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.pieces = np.zeros(1 << self.bits, dtype=np.int64)
        key = left << self.SHIFT | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            taken, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[taken >= 0]
            self.keys[slot[first]], self.pieces[slot[first]] = key[first], piece[first]
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            key, piece, slot = key[rest], piece[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = left << self.SHIFT | right
        slot, out = self._slot(key), np.full(len(key), -1, dtype=np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.pieces[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """A merge-type vocabulary read from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, kind, rules = [], None, {}
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                rules = dict(_fields(value))
        self.names = [p for p, *_ in pieces]
        if kind != BPE:
            raise ValueError("the model isn't of merge type (BPE)")
        if any(t == USER_DEFINED for *_, t in pieces):
            raise ValueError("user-defined pieces aren't supported")
        #: the library normalises where the model has a character map, drops spaces or keeps them as they are
        self.plain = not rules.get(2) and not rules.get(4, 1) and bool(rules.get(5, 1))
        self.prefix = SPACE if rules.get(3, 1) else ""
        self.trims = bool(rules.get(4, 1))
        self.cost = {p: -s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED)}
        self.unused = {p for p, _, t in pieces if t == UNUSED}
        self.unknown = next(i for i, (*_, t) in enumerate(pieces) if t == UNKNOWN)
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        whole = any(SPACE in p.lstrip(SPACE) for p in self.cost)
        self.chunks = (lambda s: [s]) if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        #: the library can be asked about a chunk by itself
        self.by_chunk = not whole and self.plain and bool(self.byte)
        #: ids of each chunk seen, as int32 bytes, and the chunks that the library encodes otherwise
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        symbol = {chr(i): len(pieces) + i for i in {ord(c) for p in self.id for c in p}} | self.id
        halves = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = _Pairs(*np.array(halves or np.empty((0, 3)), dtype=np.int64).reshape(-1, 3).T.copy())
        self.costs = np.array([-s for _, s, _ in pieces])
        #: the id of each character, beyond all pieces for one that is no piece
        self.character = np.arange(len(pieces), len(pieces) + 0x110000)
        for p in self.id:
            if len(p) == 1:
                self.character[ord(p)] = self.id[p]
        self.surface = [self._surface(p, t) for p, _, t in pieces]
        self.is_byte = np.array([t == BYTE for *_, t in pieces])

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    # -- encoding -------------------------------------------------------------

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def learn(self, chunks: list[str], check: bool = False) -> None:
        """Put distinct chunks through their agendas; with ``check`` the library encodes them as well."""
        short = [c for c in chunks if len(c) <= SHORT] if not self.unused else []
        self.known.update(zip(short, self._side_by_side(short), strict=True))
        for c in chunks:
            if c not in self.known:
                self.known[c] = self._bytes_of(self.symbols(c))
        if check:
            # as a text, a chunk has its spaces back but for the one that the library puts first; that one alone is no text
            asked = [c for c in chunks if c != self.prefix]
            said = self.library.encode([c.removeprefix(self.prefix).replace(SPACE, " ") for c in asked], num_threads=1)
            self.wrong.update(c for c, ids in zip(asked, said, strict=True) if array("i", ids).tobytes() != self.known[c])

    def _side_by_side(self, chunks: list[str]) -> list[bytes]:
        """The ids of short chunks: in each round, the best pair of every chunk's agenda merges."""
        if not chunks:
            return []
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        symbol = self.character[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")]
        chunk = np.repeat(np.arange(len(chunks)), size)

        def costs_at(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Cost and piece of the pair of each symbol i and the next, infinite and -1 for none."""
            i = np.minimum(i, len(symbol) - 1)
            after = np.minimum(i + 1, len(symbol) - 1)
            piece = self.pairs.find(symbol[i], symbol[after])
            piece[(chunk[i] != chunk[after]) | (i == after)] = -1
            return np.where(piece >= 0, self.costs[piece], np.inf), piece

        done_chunk, done_symbol = [], []
        cost, piece = costs_at(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            best = np.minimum.reduceat(cost, first)
            length = np.diff(np.append(first, len(symbol)))
            over = np.repeat(np.isinf(best), length)  # chunks without a pair left are done
            at = np.flatnonzero((cost == np.repeat(best, length)) & ~over)
            at = at[np.concatenate([[True], chunk[at[1:]] != chunk[at[:-1]]])] if len(at) else at  # the leftmost of equals
            done_chunk.append(chunk[over])
            done_symbol.append(symbol[over])
            symbol[at] = piece[at]
            stays = ~over
            stays[at + 1] = False
            new = (np.cumsum(stays) - 1)[at]
            symbol, chunk, cost, piece = symbol[stays], chunk[stays], cost[stays], piece[stays]
            if len(new):
                mark = np.zeros(len(symbol), dtype=bool)
                mark[new] = mark[np.maximum(new - 1, 0)] = True
                changed = np.flatnonzero(mark)
                cost[changed], piece[changed] = costs_at(changed)
        chunk, symbol = np.concatenate(done_chunk), np.concatenate(done_symbol)
        order = np.argsort(chunk, kind="stable")
        ids = symbol[order].astype(np.int32)
        ends = np.cumsum(np.bincount(chunk, minlength=len(chunks)))
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for k in np.unique(chunk[order][ids >= len(self.costs)]).tolist():  # characters that are no pieces
            out[k] = self._bytes_of([self.piece_of(i) for i in np.frombuffer(out[k], dtype=np.int32).tolist()])
        return out

    def piece_of(self, i: int) -> str:
        return self.names[i] if i < len(self.names) else chr(i - len(self.names))

    def symbols(self, chunk: str) -> list[str]:
        """The pieces of a chunk after all merges of its agenda, a heap of (cost, left symbol, right symbol, characters of both)."""
        n, cost = len(chunk), self.cost
        symbol, before, after = list(chunk), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(cost[pair], i, i + 1, 2) for i in range(n - 1) if (pair := chunk[i : i + 2]) in cost]
        heapify(agenda)
        halves: dict[str, tuple[str, str]] = {}
        while agenda:
            _, a, b, size = heappop(agenda)
            left, right = symbol[a], symbol[b]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has merged meanwhile
            symbol[a], symbol[b] = left + right, ""
            if symbol[a] in self.unused:
                halves[symbol[a]] = left, right
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y >= 0 and (both := symbol[x] + symbol[y]) in cost:
                    heappush(agenda, (cost[both], x, y, len(both)))
        out, todo = [], [s for s in reversed(symbol) if s]
        while todo:  # an unused piece is only a step to others: the halves it was made of stand for it
            s = todo.pop()
            if s in halves:
                todo += reversed(halves[s])
            else:
                out.append(s)
        return out

    def _bytes_of(self, symbols: list[str]) -> bytes:
        ids = []
        for s in symbols:
            if s in self.id:
                ids.append(self.id[s])
            elif self.byte:
                ids += [self.byte[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def encode(self, texts: list[str], check: bool = False) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, int32, none for an empty one; and whether the library, if asked, agrees on all its chunks."""
        if len(self.known) > CHUNKS_KEPT:
            self.known.clear()
        chunked = [self.chunks(self.normalised(t)) for t in texts]
        self.learn(list(set(chain.from_iterable(chunked)) - self.known.keys()), check)
        out = []
        for chunks in chunked:
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), dtype=np.int32)
            if not self.byte:  # neighbouring unknown characters are one id
                again = np.zeros(len(ids), dtype=bool)
                again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
                ids = ids[~again]
            out.append(ids)
        return out, [not self.wrong or self.wrong.isdisjoint(chunks) for chunks in chunked]

    # -- decoding -------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: pieces with spaces, byte pieces by runs, the space that encoding put first left out."""
        listed = ids.tolist()
        start, lead = 0, b""
        if self.prefix or self.trims:
            while start < len(listed) and not lead and listed[start] != self.unknown and not self.is_byte[listed[start]]:
                lead = self.surface[listed[start]]
                start += 1
                if lead[:1] == b" ":
                    lead = lead[1:]
                    if not self.trims:
                        break  # only one space is left out, and all leading ones where the model trims
        raw = lead + b"".join(map(self.surface.__getitem__, listed[start:] if start else listed))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return lead.decode() + self._decode_runs(listed[start:])

    def _decode_runs(self, ids: list[int]) -> str:
        """As ``decode``, where bytes of a run aren't UTF-8: each such byte becomes U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                del run[:size]
            if i >= 0:
                out.append(self.surface[i].decode())
        return "".join(out)


def encoded(
    docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", check: str | None = "chunks"
) -> DataFrame:
    """(doc_id, ids array<int>, decoded string, agrees boolean) of every row, without begin and end ids.

    ``agrees``: the sentencepiece library decodes the ids to the same text, and
    encodes to the same ids: each distinct chunk of the task when it first comes
    up (``check="chunks"``, where the model has no rules that need the whole text), or
    each text as a whole (``check="texts"``); null without a check. Null texts are
    empty ones: no ids, an empty decoded text. Repeated rows each get a row, null
    ids stay null, other columns are not read, an empty table gives an empty one.
    Only the distinct chunks of a task are held beside one slice of texts; a very
    long text is a slice of its own.
    """
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, ids array<int>, decoded string, agrees boolean"
    held = shared(docs.sparkSession, model)

    def run(batches):
        vocabulary = Vocabulary(held())
        library = vocabulary.library
        by_chunk = check == "chunks" and vocabulary.by_chunk
        for batch in sliced(batches, max_bytes=SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            ids, agrees = vocabulary.encode(texts, check=by_chunk)
            decoded = [vocabulary.decode(i) for i in ids]
            if check is None:
                agrees = [None] * len(texts)
            else:
                listed = [i.tolist() for i in ids]
                if not by_chunk:
                    agrees = [a == b for a, b in zip(listed, library.encode(texts, num_threads=1), strict=True)]
                agrees = [a and d == s for a, d, s in zip(agrees, decoded, library.decode(listed, num_threads=1), strict=True)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                    pa.array(decoded, pa.string()),
                    pa.array(agrees, pa.bool_()),
                ],
                names=["doc_id", "ids", "decoded", "agrees"],
            )

    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text")).mapInArrow(run, schema)
