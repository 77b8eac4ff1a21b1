"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character, and an agenda holds every adjacent pair whose union is a piece,
ordered by score, then from the left. The best pair merges, its new neighbours join the agenda, and entries
whose symbols have since changed are passed over. What remains is looked up; an unknown character falls back to its
bytes (or to the unknown piece where the vocabulary has no bytes).

No piece of such a vocabulary holds a space mark after another character (checked on loading), so no merge crosses
from a word into the next one's mark, and a text can be cut there, and at line feeds where no piece of more than one character has one. Each
distinct chunk runs through the agenda once for as long as it is remembered; two generations of a bounded dictionary hold results. The agendas of all
short chunks that are new in a batch are rows of a matrix, and in each round every row merges its best pair. Every text is also encoded as a whole by the
sentencepiece library and compared. If `whole` is more than 1, only texts whose hash is divisible by it are, and the chunks that an Arrow batch meets for the first time.

Decoding refuses ids outside the vocabulary. Defined cases: a null text has null ids and counts, and agrees; an empty text has no ids. A literal space mark (U+2581) is the
same symbol as a space, so decoding gives a space (round_trip is then false). Repeated rows and null ids keep their rows. Extra columns are
ignored. An empty table gives no rows. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import math
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.environ.get("MARLSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
REMEMBER = 150_000
WHOLE = 1
LONGEST = 48
TOGETHER = 8192
POINTS = 0x110000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A merge-type vocabulary read from a model file, with its agenda encoder and its decoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            data = f.read()
        model.ParseFromString(data)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and leading space marks are supported")
        self.dummy = norm.add_dummy_prefix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        byte_ids: dict[int, int] = {}
        self.unk = spec.unk_id
        for k, p in enumerate(model.pieces):
            if p.type == 4:
                raise ValueError("user-defined pieces are not supported")
            if p.type == 6:
                byte_ids[int(p.piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 1:
                self.ids[p.piece], self.scores[p.piece] = k, p.score
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            else:
                self.bytes_of.append(spec.unk_surface.encode() if p.type == 2 else b"")
        self.fallback = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        kind = lambda c: bool(re.match(r"[^\W\d_]", c))
        beside = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1) if p[i] != MARK}
        if any("\n" in pair or kind(pair[0]) != kind(pair[1]) for pair in beside):
            pattern = f"{MARK}*[^{MARK}]+|{MARK}+"
        else:  # no piece joins a letter to another kind of character, nor a line feed to anything
            pattern = rf"{MARK}*[^\W\d_]+|{MARK}*(?:[\d_]|[^\w{MARK}\n])+|\n|{MARK}+"
        self.chunks = re.compile(pattern).findall
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.file_pairs()

    def file_pairs(self) -> None:
        """Numbers for symbols (ids, and after them the characters that are no piece) and a hash table from two symbols to the id of their union."""
        size = len(self.lengths)
        self.number = np.arange(size, size + POINTS)
        self.nothing = size + POINTS  # stands beside the first and the last symbol and joins with none
        self.score = np.full(size + 1, -np.inf)  # the last for no union, -1
        for p, k in self.ids.items():
            self.score[k] = self.scores[p]
            if len(p) == 1:
                self.number[ord(p)] = k
        symbol = lambda x: int(self.number[ord(x)]) if len(x) == 1 else self.ids.get(x)
        halves = [(symbol(p[:i]), symbol(p[i:]), k) for p, k in self.ids.items() for i in range(1, len(p))]
        left, right, union = np.array([h for h in halves if None not in h[:2]], np.int64).reshape(-1, 3).T
        keys = left * (self.nothing + 1) + right
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.unions = np.full(1 << bits, -1), np.full(1 << bits, -1)
        at = self.slot(keys)
        while len(keys):  # a key goes to the first free slot from its own
            free = np.flatnonzero(self.slots[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            self.slots[taken], self.unions[taken] = keys[free[first]], union[free[first]]
            rest = self.slots[at] != keys
            keys, union, at = keys[rest], union[rest], at[rest] + 1 & len(self.slots) - 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * SPREAD >> self.shift).view(np.int64)

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of symbols make, -1 where they make none."""
        keys = left * (self.nothing + 1) + right
        at = self.slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.unions[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        at = at[rest]
        while len(rest):
            at = at + 1 & len(self.slots) - 1
            found = self.slots[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.unions[at[hit]]
            on = ~hit & (found >= 0)
            rest, at = rest[on], at[on]
        return out

    def agendas(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each of many short texts in which spaces are marks already."""
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        out = [b""] * len(texts)
        for k in range(0, len(order), TOGETHER):
            part = order[k : k + TOGETHER]
            for i, ids in zip(part, self.together([texts[i] for i in part])):
                out[i] = ids
        return out

    def together(self, texts: list[str]) -> list[bytes]:
        """A row of the matrix is a text: its symbols stay where their first character stood, with the places of their neighbours and the score of the pair that each begins."""
        sizes = np.array([len(t) for t in texts])
        width = int(sizes.max(initial=0)) + 2
        columns = np.arange(width)
        alive = (columns > 0) & (columns <= sizes[:, None])
        symbol = np.full(alive.shape, self.nothing)
        symbol[alive] = self.number[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        joined = np.full(alive.shape, -1)
        joined[:, :-1] = self.union(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(-1, width - 1)
        agenda = self.score[joined]
        symbol, joined, alive = symbol.ravel(), joined.ravel(), alive.ravel()
        left = np.arange(len(symbol)) - 1
        right = left + 2
        base = np.arange(len(texts)) * width  # of the rows that are still in the agenda
        while len(base):
            best = agenda.argmax(axis=1)
            flat = agenda.ravel()
            at = np.arange(len(base)) * width + best
            on = np.flatnonzero(flat[at] > -np.inf)
            if len(on) < 0.7 * len(base):
                agenda, base, best = agenda[on], base[on], best[on]
                flat, on = agenda.ravel(), np.arange(len(base))
            start, first = base[on], base[on] + best[on]
            move = on * width - start  # from a place among all rows to one in the agenda
            second = right[first]
            after, before = right[second], left[first]
            union = symbol[first] = joined[first]
            alive[second] = False
            right[first], left[after] = after, first
            flat[second + move] = -np.inf
            for place, pair in ((first, self.union(union, symbol[after])), (before, self.union(symbol[before], union))):
                joined[place] = pair
                flat[place + move] = self.score[pair]
        kept = symbol[alive]
        counts = alive.reshape(-1, width).sum(axis=1)
        ends = np.cumsum(counts)
        strange = np.flatnonzero(kept >= len(self.lengths))
        if len(strange):  # a character that is no piece becomes what lookup gives for it
            points = (kept[strange] - len(self.lengths)).tolist()
            found = {c: self.lookup(chr(c)) for c in set(points)}
            given = [found[c] for c in points]
            times = np.ones(len(kept), np.int64)
            times[strange] = [len(g) for g in given]
            ends = np.concatenate([[0], np.cumsum(times)])[ends]
            kept = np.repeat(kept, times)
            kept[kept >= len(self.lengths)] = [k for g in given for k in g]
        packed, ends = kept.astype(np.int32).tobytes(), (4 * ends).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def agenda(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already. A short text's agenda is a list in the order of the symbols, a longer one's a heap."""
        if len(text) > LONGEST:
            return self.heap_agenda(text)
        get, none = self.scores.get, -math.inf
        symbol = list(text)
        agenda = [get(a + b, none) for a, b in zip(symbol, symbol[1:])]
        while agenda:
            best = max(agenda)
            if best == none:
                break
            i = agenda.index(best)
            union = symbol[i] = symbol[i] + symbol.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(union + symbol[i + 1], none)
            if i:
                agenda[i - 1] = get(symbol[i - 1] + union, none)
        ids = self.ids
        return [k for x in symbol for k in ((ids[x],) if x in ids else self.lookup(x))]

    def heap_agenda(self, text: str) -> list[int]:
        scores, n = self.scores, len(text)
        symbol: list = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1:] = [-1] * bool(n)
        heap = []
        for i in range(n - 1):
            s = scores.get(symbol[i] + symbol[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, symbol[i] + symbol[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, j, union = heapq.heappop(heap)
            if right[i] != j or symbol[i] is None or symbol[j] is None or len(symbol[i]) + len(symbol[j]) != len(union) or symbol[i] + symbol[j] != union:
                continue
            symbol[i], symbol[j] = union, None
            after = right[i] = right[j]
            if after >= 0:
                left[after] = i
                s = scores.get(union + symbol[after])
                if s is not None:
                    heapq.heappush(heap, (-s, i, after, union + symbol[after]))
            before = left[i]
            if before >= 0:
                s = scores.get(symbol[before] + union)
                if s is not None:
                    heapq.heappush(heap, (-s, before, i, symbol[before] + union))
        return [k for x in symbol if x is not None for k in self.lookup(x)]

    def lookup(self, x: str) -> list[int]:
        if x in self.ids:
            return [self.ids[x]]
        return [self.unk] if self.fallback is None else [self.fallback[b] for b in x.encode("utf-8", "replace")]

    def escape(self, text: str) -> str:
        return (MARK + text if self.dummy and text else text).replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(self.escape(text)) for i in self.agenda(c)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.lengths):
            raise ValueError(f"ids from {ids.min()} to {ids.max()}, but the vocabulary has 0 to {len(self.lengths) - 1}")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        raw = self.flat[at + np.arange(len(at))].tobytes()
        return raw[1:] if self.dummy and raw[:1] == b" " else raw

    def decode(self, ids) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode("utf-8", "replace")

    def expected(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of the chunks; one without a leading mark is set after a line feed, which no merge crosses."""
        led = [c.startswith(MARK) and self.dummy for c in chunks]
        got = self.library.encode([c[1:] if at else "\n" + c for c, at in zip(chunks, led)], num_threads=1)
        # a lone mark is an empty text for the library, which encodes nothing for it
        return [(g or self.lookup(c)) if at else g[len(self.lookup(MARK)) * self.dummy + len(self.lookup("\n")):] for c, g, at in zip(chunks, got, led)]


class _Chunks(dict):
    """Packed ids by chunk, in two generations of at most `most` entries each."""

    def __init__(self, pieces: Pieces, most: int):
        self.pieces, self.most, self.old = pieces, most, {}
        self.fresh: list[str] = []

    def make(self, chunk: str) -> bytes:
        self.fresh.append(chunk)
        return array("i", self.pieces.agenda(chunk)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            packed = self.make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = packed
        return packed

    def fill(self, chunks: set[str]) -> None:
        """Remembers the short ones of these, so that none is met alone."""
        new = chunks.difference(self)
        known = new.intersection(self.old)
        self.update(zip(known, map(self.old.__getitem__, known)))
        short = [c for c in new - known if len(c) <= LONGEST]
        self.update(zip(short, self.make_all(short)))

    def make_all(self, chunks: list[str]) -> list[bytes]:
        self.fresh += chunks
        return self.pieces.agendas(chunks)

    def turn(self) -> None:
        self.fresh = []
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


class _Words(_Chunks):
    """Packed ids by what stands between two single spaces, which is cut into chunks."""

    def __init__(self, pieces: Pieces, chunks: _Chunks, most: int):
        super().__init__(pieces, most)
        self.chunks = chunks
        self.made: tuple[list[str], list[bytes]] = [], []

    def make(self, word: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.pieces.chunks(MARK + word)))

    def make_all(self, words: list[str]) -> list[bytes]:
        marked = [MARK + w for w in words]
        if self.pieces.chunks("".join(marked)) == marked:  # each is one chunk, which need not be remembered twice
            self.chunks.fresh += marked
            self.made = marked, self.pieces.agendas(marked)
            return self.made[1]
        parts = [self.pieces.chunks(w) for w in marked]
        self.chunks.fill(set(chain.from_iterable(parts)))
        return [b"".join(map(self.chunks.__getitem__, p)) for p in parts]

    def turn(self) -> None:
        self.made = [], []
        super().turn()


_LOADED: dict[str, tuple[Pieces, _Chunks, _Words]] = {}


def loaded(path: str) -> tuple[Pieces, _Chunks, _Words]:
    if path not in _LOADED:
        pieces = Pieces(path)
        chunks = _Chunks(pieces, REMEMBER)
        _LOADED[path] = pieces, chunks, _Words(pieces, chunks, REMEMBER)
    return _LOADED[path]


SCHEMA = "doc_id long, ids array<int>, n_ids int, round_trip boolean, agrees boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("round_trip", pa.bool_()), ("agrees", pa.bool_())])


def _rows(path: str, doc_ids, texts: list[str | None], check: bool, whole: int = WHOLE) -> pa.RecordBatch:
    pieces, chunks, words = loaded(path)

    def cut(t: str | None) -> tuple[_Chunks, list[str]]:
        if t and pieces.dummy and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t:
            return words, t.split(" ")
        return chunks, pieces.chunks(pieces.escape(t)) if t else []

    cuts = [cut(t) for t in texts]
    for memory in (words, chunks):
        memory.fill(set().union(*(c for m, c in cuts if m is memory)))
    packed = [None if t is None else b"".join(map(m.__getitem__, c)) for t, (m, c) in zip(texts, cuts)]
    del cuts
    agrees = [True] * len(texts)
    if check and whole > 1 and chunks.fresh:  # else the whole texts tell
        fresh = list(dict.fromkeys(chunks.fresh))
        made = dict(zip(*words.made))
        wrong = {c for c, e in zip(fresh, pieces.expected(fresh)) if array("i", e).tobytes() != (made.get(c) or chunks.get(c) or chunks.make(c))}
        if wrong:  # forgotten, so that the next batch meets them anew and flags its documents too
            agrees = [t is None or wrong.isdisjoint(pieces.chunks(pieces.escape(t))) for t in texts]
            chunks.forget()
            words.forget()
    if check:
        asked = [k for k, t in enumerate(texts) if t and (whole == 1 or xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) % whole == 0)]
        for k in asked:
            agrees[k] &= pieces.library.EncodeAsNumpy(texts[k]).astype(np.int32, copy=False).tobytes() == packed[k]
    chunks.turn()
    words.turn()
    counts = [None if p is None else len(p) // 4 for p in packed]
    trips = [None if t is None else pieces.decode_bytes(np.frombuffer(p, np.int32)) == t.encode("utf-8", "replace") for t, p in zip(texts, packed)]
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum([c or 0 for c in counts], out=offsets[1:])
    valid = pa.array([c is None for c in counts], pa.bool_())
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
    lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=valid)
    return pa.record_batch([doc_ids, lists, pa.array(counts, pa.int32()), pa.array(trips, pa.bool_()), pa.array(agrees, pa.bool_())], schema=_ARROW)


def encode(docs: DataFrame, model: str = MODEL, check: bool = True, whole: int = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, round_trip (decoding gives the text back) and agrees (the text got the library's ids; with `whole` above 1, every chunk first met
    in its Arrow batch did, and the whole text if it is one of those compared)."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            step = max(1, int(len(texts) * 4e6 / max(1, texts.nbytes)))
            for k in range(0, len(texts), step):
                yield _rows(model, b.column(0).slice(k, step), texts.slice(k, step).to_pylist(), check, whole)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of id lists; null lists (or a null in one) give a null text."""

    def run(batches):
        for b in batches:
            pieces = loaded(model)[0]
            texts = [None if x is None or None in x else pieces.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
