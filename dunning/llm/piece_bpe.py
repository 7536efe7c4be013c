"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding follows the model: spaces become the meta symbol, one is put in front,
and candidate merges of neighbouring symbols are taken from an agenda by piece
score, leftmost first. With dropout, a candidate that comes up is skipped when a
keyed hash of (seed, document, place of the chunk in it, candidate) falls below the rate; a skipped
candidate returns only if a neighbour's merge makes it anew. What is left and not in the vocabulary is
spelled in bytes. Rate 0 gives the library's own ids.

A merge never crosses the start of a run of meta symbols, nor a character that is
part of no longer piece, nor (where no piece does) the edge between letters and
others, so a text falls into chunks that are segmented alone. Every occurrence of a
chunk draws anew for each of its candidates. What is remembered (a bounded number of chunks per
worker) holds no draw: the candidates that come up if none is skipped, and the ids then.
Draws are made over many occurrences at once; those with a skip are segmented anew, their
agendas side by side in numpy. Equal rows (key and text) always give equal ids.

Decoding is exact: a meta symbol in the text itself is spelled in bytes, so
``decode(encode(x)) == x`` for every text without lone surrogates.

Nulls and edges: a null text has null ids, an empty text none; a null id draws by the
text alone; long texts are encoded whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.common import slices
from dunning.llm.hashing import Lookup

META = "▁"
DROPOUT = 0.1
SEED = 4
#: Chunks remembered by a worker; bounds memory, not results.
REMEMBERED = 500_000
#: Chunks whose draws are made at once; bounds memory, not results.
AT_ONCE = 400_000
#: Longer chunks (in characters) are not remembered.
LONGEST = 64


LOW64 = (1 << 64) - 1
NEVER = 1 << 62
#: Chunks up to this length keep their agenda in a list, longer ones in a heap.
SHORT = 64
#: Odd multipliers that spread a candidate's place over 64 bits.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Step from one chunk's place to the next, and the rounds that spread it (SplitMix64).
STEP, ROUNDS = 0x9E3779B97F4A7C15, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def _crossing(piece: str, letter: re.Pattern) -> set[str]:
    """Letters of the piece that stand next to something else."""
    kinds = [bool(letter.match(c)) for c in piece]
    return {piece[i] if kinds[i] else piece[i + 1] for i in range(len(piece) - 1) if kinds[i] != kinds[i + 1]}


class Pieces:
    """A SentencePiece BPE model read from its file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("needs a BPE model with byte fallback, a dummy prefix and no normalization")
        if any(p.score != int(p.score) or p.score > 0 for p in proto.pieces):
            raise ValueError("needs whole-numbered scores, as BPE training gives them")
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        #: Merges go by falling score; equal scores share a rank and go leftmost first.
        self.rank = {p: int(-proto.pieces[i].score) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if kinds[i] == 6:
                self.bytes[int(p[3:5], 16)] = i
        self.spelled = [p.replace(META, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        lengths = np.array([len(x) for x in self.spelled], np.int64)
        #: Every piece's bytes one after another, and where they start and how many they are.
        self.spelling, self.spans = np.frombuffer(b"".join(self.spelled), np.uint8), (np.cumsum(lengths) - lengths, lengths)
        long = [p for p in self.ids if len(p) > 1]
        if any(META in p.lstrip(META) for p in long):
            raise ValueError("pieces must not run across spaces")
        joined = set("".join(long))
        self.apart = "".join(c for c in map(chr, range(33)) if c not in joined)
        stop = re.escape(self.apart)
        bare = [p.lstrip(META) for p in long]
        odd = re.escape("".join({x for p in bare for x in _crossing(p, re.compile(r"[^\W\d_]"))}))
        letter = f"[^\\W\\d_{odd}]"
        apart = not any(_crossing(p, re.compile(letter)) for p in bare)
        run = f"(?:{letter}+|(?:(?!{letter})[^{META}{stop}])+)" if apart else f"[^{META}{stop}]+"
        self.chunk = re.compile(f"{META}+{run}|{META}+|{run}|[{stop}]")

    def segment(self, chunk: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """Ids of one chunk. ``key``: seed of the hash that decides which candidates are skipped."""
        limit = int(rate * (1 << 64))
        return self.drawn(chunk, limit, xxhash.xxh64_intdigest(chunk, key) if limit else 0)

    def drawn(self, chunk: str, limit: int, salt: int) -> list[int]:
        """Ids of one chunk; a candidate is skipped when its hash with ``salt`` is below ``limit``."""
        return self.spell(chunk, (self._short if len(chunk) <= SHORT else self._long)(chunk, limit, salt))

    def spell(self, chunk: str, cuts: list[int]) -> list[int]:
        out, ids = [], self.ids
        for a, b in pairwise(cuts):
            found = ids.get(chunk[a:b])
            if found is None:
                out += [self.bytes[x] for x in chunk[a:b].encode()]
            else:
                out.append(found)
        return out

    def _short(self, chunk: str, limit: int, salt: int) -> list[int]:
        """Where symbols start, and the end. The agenda is a list of the ranks at each place, searched for its least."""
        rank, n, (spread, mix), low = self.rank.get, len(chunk), MIX, LOW64
        at = list(range(n + 1))
        agenda = [rank(chunk[i : i + 2], NEVER) for i in range(n - 1)]
        while agenda and (least := min(agenda)) != NEVER:
            k = agenda.index(least)
            i, stop = at[k], at[k + 2]
            if limit and (((i << 40 | at[k + 1] << 20 | stop) * spread & low ^ salt) * mix & low) < limit:
                agenda[k] = NEVER
                continue
            del at[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = rank(chunk[i : at[k + 2]], NEVER)
            if k:
                agenda[k - 1] = rank(chunk[at[k - 1] : stop], NEVER)
        return at

    def trail(self, chunk: str, skipped: frozenset[int], first: int) -> tuple[list[int], list[int]]:
        """As ``_short``, skipping the candidates of these ordinals alone; also the places, spread, of the candidates from ordinal ``first`` on."""
        rank, n, spread, low = self.rank.get, len(chunk), MIX[0], LOW64
        at, places, ordinal = list(range(n + 1)), [], -1
        agenda = [rank(chunk[i : i + 2], NEVER) for i in range(n - 1)]
        while agenda and (least := min(agenda)) != NEVER:
            k = agenda.index(least)
            i, stop = at[k], at[k + 2]
            ordinal += 1
            if ordinal in skipped:
                agenda[k] = NEVER
                continue
            if ordinal >= first:
                places.append((i << 40 | at[k + 1] << 20 | stop) * spread & low)
            del at[k + 1], agenda[k]
            if k < len(agenda):
                agenda[k] = rank(chunk[i : at[k + 2]], NEVER)
            if k:
                agenda[k - 1] = rank(chunk[at[k - 1] : stop], NEVER)
        return at, places

    def _long(self, chunk: str, limit: int, salt: int) -> list[int]:
        """As ``_short``, with a heap for the agenda; an entry is one number: rank, start, end."""
        rank, n, (spread, mix), low = self.rank.get, len(chunk), MIX, LOW64
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end = list(range(1, n + 1))  # the symbol at i ends at end[i]; 0 once merged away
        prev = list(range(-1, n))
        agenda = [r << 2 * bits | i << bits | i + 2 for i in range(n - 1) if (r := rank(chunk[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            found = heappop(agenda)
            i, stop = found >> bits & mask, found & mask
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue  # one of its symbols has changed
            if limit and (((i << 40 | mid << 20 | stop) * spread & low ^ salt) * mix & low) < limit:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                r = rank(chunk[i : end[stop]])
                if r is not None:
                    heappush(agenda, r << 2 * bits | i << bits | end[stop])
            p = prev[i]
            if p >= 0:
                r = rank(chunk[p:stop])
                if r is not None:
                    heappush(agenda, r << 2 * bits | p << bits | stop)
        at = [0]
        while at[-1] < n:
            at.append(end[at[-1]])
        return at

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(META + text.replace(" ", META)) if text else []

    def encode(self, text: str, rate: float = 0.0, key: int = 0) -> list[int]:
        return [i for c in split_meta(self, text) for i in (self.segment(c, rate, key) if c is not None else [self.bytes[b] for b in META.encode()])]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode()[1:]


def split_meta(pieces: Pieces, text: str) -> list[str | None]:
    """Chunks of the text; None stands for a meta symbol in the text itself."""
    if META not in text:
        return pieces.chunks(text)
    out: list[str | None] = []
    for k, part in enumerate(text.split(META)):
        if k:
            out.append(None)
            out += pieces.chunk.findall(part.replace(" ", META))
        else:
            out += pieces.chunk.findall(META + part.replace(" ", META))
    return out


class Memory(dict):
    """Chunk to its ids as int32 bytes, for one key. Chunks not met again while half the room fills are forgotten."""

    def __init__(self, pieces: Pieces, rate: float, key: int, room: int):
        self.pieces, self.rate, self.key, self.half, self.old = pieces, rate, key, max(1, room // 2), {}

    def __missing__(self, chunk: str | None) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            ids = [self.pieces.bytes[b] for b in META.encode()] if chunk is None else self.pieces.segment(chunk, self.rate, self.key)
            found = array("i", ids).tobytes()
        if chunk is None or len(chunk) <= LONGEST:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def salts(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One 64-bit number for each document key and place of a chunk in it."""
    z = keys + (places + np.uint64(1)) * np.uint64(STEP)
    for shift, by in ROUNDS:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def _gather(flat: array | np.ndarray, kind: type, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    before = np.cumsum(sizes) - sizes
    at = np.repeat(starts - before, sizes)
    at += np.arange(len(at))
    return np.frombuffer(flat, kind)[at] if len(at) else np.empty(0, kind)


class Agendas:
    """The agendas of many chunks side by side: chunks of one length are the rows of a matrix, and a step takes the
    least candidate of every row. Symbols are numbered; 0 is a character that no longer piece holds."""

    BITS = 20

    def __init__(self, pieces: Pieces):
        number = {c: i for i, c in enumerate(sorted({x for p in pieces.rank for x in (*p, p)}), 1)}
        pairs = [(number[p[:k]] << self.BITS | number[p[k:]], r << self.BITS | number[p]) for p, r in pieces.rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.merge = Lookup(*np.array(pairs, np.int64).T, missing=NEVER)
        self.char = np.zeros(0x110000, np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.id_of = np.full(len(number) + 1, -1, np.int32)
        for c, i in number.items():
            self.id_of[i] = pieces.ids.get(c, -1)
        self.alone = {ord(c): i for c, i in pieces.ids.items() if len(c) == 1 and c not in number}
        self.bytes = np.array(pieces.bytes, np.int32)

    def run(self, chunks: list[str], limit: int = 0, salts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks and how many each has; without ``limit`` also the places, spread, of their candidates, and how many.

        With it, a candidate is skipped when its hash with the chunk's salt is below it."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(lengths, kind="stable")
        made = [self._alike([chunks[i] for i in rows], int(lengths[rows[0]]), limit, None if salts is None else salts[rows]) for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(rows)]
        back = np.argsort(order, kind="stable")
        out = []
        for flat, sizes, kind in ((0, 1, np.int32), (2, 3, np.uint64)):
            every = np.concatenate([np.empty(0, np.int64), *[m[sizes] for m in made]])
            out += [_gather(np.concatenate([np.empty(0, kind), *[m[flat] for m in made]]), kind, (np.cumsum(every) - every)[back], every[back]), every[back]]
        return tuple(out)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.merge[(left << self.BITS | right).ravel().astype(np.uint64)].reshape(left.shape)

    def _alike(self, chunks: list[str], length: int, limit: int, salts: np.ndarray | None) -> tuple[np.ndarray, ...]:
        n = len(chunks)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        # one column more than characters: an end without a symbol, which place -1 names too, where no candidate ever stands
        symbol = np.concatenate([self.char[codes], np.zeros((n, 1), np.int64)], axis=1)
        after = np.tile(np.arange(1, length + 2), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        alive = np.ones((n, length), bool)
        agenda = np.full((n, length + 1), NEVER, np.int64)
        agenda[:, : length - 1] = self._pair(symbol[:, : length - 1], symbol[:, 1:length])
        row, came = np.arange(n), []
        while len(row):
            now = agenda[row]
            i = now.argmin(axis=1)
            least = now[np.arange(len(row)), i]
            there = least != NEVER
            row, i, least = row[there], i[there], least[there]
            mid = after[row, i]
            stop = after[row, mid]
            place = (i << 40 | mid << 20 | stop).astype(np.uint64) * np.uint64(MIX[0])
            r = row
            if limit:
                skip = (place ^ salts[row]) * np.uint64(MIX[1]) <= np.uint64(limit - 1)
                agenda[row[skip], i[skip]] = NEVER
                r, i, mid, stop, least = row[~skip], i[~skip], mid[~skip], stop[~skip], least[~skip]
            else:
                came.append((row, place))
            made = least & ((1 << self.BITS) - 1)
            symbol[r, i], after[r, i], alive[r, mid] = made, stop, False
            before[r, stop] = i
            agenda[r, mid] = NEVER
            agenda[r, i] = self._pair(made, symbol[r, stop])
            left = before[r, i]
            agenda[r, left] = self._pair(symbol[r, left], made)
        ids, sizes = self._spelled(symbol[:, :length][alive], codes[alive], alive.sum(axis=1))
        rows = np.concatenate([np.empty(0, np.int64), *[c[0] for c in came]])
        by_row = np.argsort(rows, kind="stable")
        places = np.concatenate([np.empty(0, np.uint64), *[c[1] for c in came]])[by_row]
        return ids, sizes, places, np.bincount(rows, minlength=n)

    def _spelled(self, symbols: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols, in bytes where there is no piece, and how many each row has."""
        ids = self.id_of[symbols]
        for j in np.flatnonzero(symbols == 0) if self.alone else ():
            ids[j] = self.alone.get(int(codes[j]), -1)
        odd = ids < 0
        if not odd.any():
            return ids, counts
        code = codes[odd]
        times = np.ones(len(ids), np.int64)
        times[odd] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        flat, spelled = np.repeat(ids, times), np.repeat(odd, times)
        flat[spelled] = self.bytes[np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        upto = np.r_[0, np.cumsum(times)]
        ends = np.r_[0, np.cumsum(counts)]
        return flat, upto[ends[1:]] - upto[ends[:-1]]


class States:
    """For chunks met before, the places of the candidates that come up if none is skipped, and the ids then."""

    def __init__(self, pieces: Pieces, rate: float, room: int):
        self.pieces, self.limit, self.room = pieces, int(rate * (1 << 64)), max(1, room)
        self.agendas = Agendas(pieces)
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str | None, int] = {None: 0}  # a meta symbol in the text itself
        self.places, self.place_ends = array("Q"), array("q", [0, 0])
        self.ids = array("i", [self.pieces.bytes[b] for b in META.encode()])
        self.id_ends = array("q", [0, len(self.ids)])

    def _learn(self, chunks: list[str]) -> None:
        ids, sizes, places, candidates = self.agendas.run(chunks)
        self.roots.update(zip(chunks, range(len(self.roots), len(self.roots) + len(chunks))))
        for flat, ends, values, counts in ((self.ids, self.id_ends, ids, sizes), (self.places, self.place_ends, places, candidates)):
            ends.frombytes((np.cumsum(counts) + len(flat)).astype(np.int64).tobytes())
            flat.frombytes(values.tobytes())

    def _spans(self, ends: array, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(ends, np.int64)
        return ends[states], ends[states + 1] - ends[states]

    def encode(self, chunks: list[str | None], keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the chunks, and how many each has. ``keys``: of a chunk's document; ``places``: of the chunk in it."""
        if len(self.roots) > self.room:
            self.forget()
        states = np.fromiter(map(self.roots.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(states < 0)
        if len(new):
            self._learn(list(dict.fromkeys(c for c in map(chunks.__getitem__, new) if len(c) <= LONGEST)))
            states[new] = [self.roots.get(chunks[i], -1) for i in new]
        salt = salts(keys, places)
        known = np.flatnonzero(states >= 0)
        starts, sizes = self._spans(self.place_ends, states[known])
        hashes = _gather(self.places, np.uint64, starts, sizes)
        hashes ^= np.repeat(salt[known], sizes)
        hashes *= np.uint64(MIX[1])
        skips = np.flatnonzero(hashes <= np.uint64(self.limit - 1))
        again = known[np.unique(np.searchsorted(np.cumsum(sizes), skips, "right"))]
        drawn, many, _, _ = self.agendas.run([chunks[i] for i in again], self.limit, salt[again])
        long = np.flatnonzero(states < 0)  # drawn at once, not remembered
        apart = [np.array(self.pieces.drawn(chunks[i], self.limit, int(salt[i])), np.int32) for i in long]
        pool = np.concatenate([np.frombuffer(self.ids, np.int32), drawn, *apart])
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[known], sizes[known] = self._spans(self.id_ends, states[known])
        starts[again], sizes[again] = len(self.ids) + np.cumsum(many) - many, many
        sizes[long] = [len(x) for x in apart]
        starts[long] = len(self.ids) + len(drawn) + np.cumsum(sizes[long]) - sizes[long]
        return _gather(pool, np.int32, starts, sizes), sizes


@lru_cache(maxsize=2)
def _states(model: bytes, rate: float, room: int) -> tuple[Pieces, States | Memory]:
    """Kept by a Python worker from one task to the next. Without dropout nothing is drawn."""
    pieces = Pieces(model)
    return pieces, States(pieces, rate, room) if int(rate * (1 << 64)) else Memory(pieces, 0.0, 0, room)


def _drawn(states: States, split: list[list[str | None]], keys: np.ndarray) -> list[np.ndarray]:
    """Ids of every text, from its chunks and its key."""
    counts = np.array([len(x) for x in split], np.int64)
    ends = np.cumsum(counts)
    chunks = [c for x in split for c in x]
    row = np.repeat(np.arange(len(split)), counts)
    places = (np.arange(len(chunks)) - (ends - counts)[row]).astype(np.uint64)
    parts = [states.encode(chunks[i : i + AT_ONCE], keys[row[i : i + AT_ONCE]], places[i : i + AT_ONCE]) for i in range(0, len(chunks), AT_ONCE)]
    ids = np.concatenate([np.empty(0, np.int32), *[p[0] for p in parts]])
    upto = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]]))])[ends]
    return np.split(ids, upto[:-1]) if len(split) else []


def _lossless(pieces: Pieces, texts: list[str | None], found: list[np.ndarray]) -> list[bool | None]:
    """Whether the ids of a text spell it, for all texts at once."""
    starts, lengths = pieces.spans
    ids = np.concatenate([np.empty(0, np.int32), *found])
    spelled = _gather(pieces.spelling, np.uint8, starts[ids], lengths[ids]).tobytes()
    upto = np.r_[0, np.cumsum(lengths[ids])][np.r_[0, np.cumsum([len(x) for x in found], dtype=np.int64)]].tolist()
    return [None if text is None else spelled[a + 1 : b] == text.encode() for text, a, b in zip(texts, upto, upto[1:], strict=False)]


def _encoder(shared, rate: float, room: int):
    pieces, states = _states(shared.value, rate, room)

    def run(texts: pa.Array, keys: pa.Array) -> list[pa.Array]:
        texts = texts.to_pylist()
        split = [split_meta(pieces, text) if text else [] for text in texts]
        if isinstance(states, States):
            found = _drawn(states, split, keys.to_numpy().view(np.uint64))
        else:
            found = [np.frombuffer(b"".join(map(states.__getitem__, x)), np.int32) for x in split]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        exact = _lossless(pieces, texts, found)
        values = pa.array(np.concatenate([np.empty(0, np.int32), *found]))
        empty = pa.array([text is None for text in texts], pa.bool_())
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=empty), pa.array(exact, pa.bool_())]

    return run


def _kernels(df: DataFrame, fields: list[T.StructField], used: list[int], keep: int, factory) -> DataFrame:
    """The first ``keep`` columns of ``df`` (named c0, c1, ...) and what the kernel makes of the used ones."""
    schema = T.StructType(df.schema.fields[:keep] + fields)
    columns = [f.name for f in schema.fields]

    def run(batches):
        kernel = factory()
        for batch in batches:
            for part in slices(batch, used[0]):
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], *kernel(*[part.column(i) for i in used])], names=columns)

    return df.mapInArrow(run, schema)


def with_ids(df: DataFrame, model: bytes, text: str = "text", key: Column | None = None, dropout: float = DROPOUT, seed: int = SEED, remembered: int = REMEMBERED) -> DataFrame:
    """``df``, ``ids`` (array of int) and ``lossless`` (whether decoding them gave the text). ``key`` and the text draw what is skipped in a row."""
    if not 0 <= dropout <= 1:
        raise ValueError("dropout must be 0 to 1")
    names, at = df.columns, df.columns.index(text)
    given = F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit(""))
    drawn = F.xxhash64(F.lit(seed), given, F.col(f"`{text}`"))
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], drawn.alias("key"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # a model file of a few MB
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), True), T.StructField("lossless", T.BooleanType(), True)]
    return _kernels(plain, fields, [at, len(names)], len(names), partial(_encoder, shared, dropout, remembered)).toDF(*names, "ids", "lossless")


def _decoder(shared):
    pieces = Pieces(shared.value)
    return lambda ids: [pa.array([None if x is None else pieces.decode(x) for x in ids.to_pylist()], pa.string())]


def with_text(df: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` and the texts that its ids were made from."""
    names, at = df.columns, df.columns.index(ids)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return _kernels(plain, [T.StructField("decoded", T.StringType())], [at], len(names), partial(_decoder, shared)).toDF(*names, out)
