"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its word n-grams (N words in a row; all its words as one gram if it has fewer). Two documents are a pair if their
sets have Jaccard similarity of at least THETA, that is an overlap of at least T = THETA / (1 + THETA) * (size + size).

DivideSkip divides the inverted lists of a query's grams into the L longest and the rest. Merging the short lists gives the documents
that occur in at least T - L of them; the long lists are probed for just those by binary search, until T is reached or out of reach. Here:

1. A sketch of fixed size counts in how many documents the grams occur. It gives all grams one order, rare first. Any order gives the right result;
   a good one keeps passages that many documents share out of the short lists.
2. Grams are divided by hash into parts. If two sets have similarity THETA, so have what they hold of some part, as the whole's is between the least
   and the greatest of the parts'. Each document sends its short lists' postings of each part (all but its ceil(THETA * n) - 1 commonest grams there) to the
   group of that part, which so sees all hits of a pair in it: those that reach T - L, by sizes in the part, are candidates. No pair leaves its group
   before that, and a group counts the pairs of few documents at a time. Only a spanning forest of the candidates goes on.
   Groups are also by size (powers of 4, by the larger of a pair; a document that is near the next goes to both), and a size has as many parts as keep
   a group at about POSTINGS, but none with fewer than PART_GRAMS grams of a document. Where that leaves a group too large, its grams are divided into
   R ranges; in one of them a pair has the R-th part of its hits. With its postings a document carries BITS parities of its grams of the part; two
   sets differ in at least as many grams as in parities, which refuses most of what the hits let pass.
3. The surviving pairs' connected components are separate small corpora. In each, every document is a query: DivideSkip runs
   over the component's full inverted lists, and what it retains is the result. Counts there are those of the grams themselves. A component of more
   than COMPONENT_GRAMS grams is cut into blocks, and every two blocks are searched by themselves.

Short lists are merged by `run_merge`, one stable sort of the concatenated lists, which merges their ascending runs; `heap_merge` does the same with a heap of list
heads and gives the same result (tested), but takes many times as long (see README).

Documents with equal sets are a class, named by a 64-bit hash of the set; the search compares one of each class, and its partners count with all their copies.
So no link is lost, and copies are never expanded into pairs but by `all_pairs`.

Defined cases: a null or empty text, or one without words, has no grams and no partner. A null id is the least id. Repeated rows (equal id and text) are
linked to each other. Extra columns are ignored by `join` and carried by `keep_one`, whatever their names. Ties: of a group the least (id, hash
of the text) stays. An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import math
import os
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_id, as_table, components, forest, identified, in_pieces, key_filter, mix, slices, word_hashes

N = 2
THETA = 0.6
SKETCH_BITS = 22
CHUNKS = 64
POSTINGS = 8_000_000  # of a group, about
PART_GRAMS = 32
CLASSES = 16  # powers of 4
PAIR_HITS = 2_000_000  # that a group counts at a time
SLICE = 1 << 18  # postings, hits or pairs that are looked at together
BITS = 256
COMPONENT_GRAMS = 4_000_000  # that a search holds at most
MU = 0.0085  # cost of a probe against a merge step, as in the published heuristic for L


def gram_sets(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, sizes, signatures): the distinct gram hashes of all texts in order, ascending in each; how many each has; a hash of each set."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    gram = words.copy()
    left = ends[owner] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    for k in range(1, n):
        more = left > k
        gram[more] = mix(gram[more] * np.uint64(31) + words[np.flatnonzero(more) + k])
    starts = (left >= n) | ((counts[owner] < n) & (left == counts[owner]))
    gram, owner = gram[starts], owner[starts]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[first], owner[first]
    sizes = np.bincount(owner, minlength=len(texts))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram + np.uint64(0x51ED27)))])
    stop = np.cumsum(sizes)
    return gram, sizes, mix(total[stop] - total[stop - sizes] + sizes.astype(np.uint64))


def least_size(n, theta: float):
    """ceil(theta * n), safe against rounding."""
    return np.ceil(theta * np.asarray(n) - 1e-9).astype(np.int64)


def least_overlap(a, b, theta: float):
    return np.ceil(theta / (1 + theta) * (np.asarray(a) + b) - 1e-9).astype(np.int64)


def _pieces_of(batches, column: int):
    for b in slices(batches):
        texts = [t or "" for t in b.column(column).to_pylist()]
        for i, j in in_pieces(texts):
            yield b, i, j, texts[i:j]


def document_sketch(docs: DataFrame, n: int = N, bits: int = SKETCH_BITS) -> np.ndarray:
    """Logarithm of the number of documents, by hash of a gram: 2**bits bytes, whatever the size of the corpus. A partition counts a slot up to 255."""
    per = (1 << bits) // CHUNKS

    def count(batches):
        held = np.zeros(1 << bits, np.int64)
        for _, _, _, texts in _pieces_of(batches, 0):
            held += np.bincount((gram_sets(texts, n)[0] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        small = np.minimum(held, 255).astype(np.uint8)
        yield pa.record_batch({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array([small[k * per : (k + 1) * per].tobytes() for k in range(CHUNKS)], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                held[k] = held.get(k, 0) + np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64)
        logs = [np.minimum(255, np.round(12 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.record_batch({"chunk": pa.array(held, pa.int32()), "counts": pa.array(logs, pa.binary())})

    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(CHUNKS // 4, "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.collect():
        out[r.chunk * per : (r.chunk + 1) * per] = np.frombuffer(r.counts, np.uint8)
    return out


def _class_of(n: np.ndarray) -> np.ndarray:
    """floor(log4(n)) of sizes of at least 1."""
    return np.minimum((np.frexp(np.asarray(n, float))[1] - 1) // 2, CLASSES - 1)


def _near_next(n, k, theta: float):
    """Whether a document of class k may be similar to one of the next class."""
    return (k < CLASSES - 1) & (n >= 4.0 ** (k + 1) * theta - 1e-9)


class Groups:
    """How many parts each class has and how many ranges each part, from the class's postings. Groups are numbered by class, part and range."""

    def __init__(self, postings):
        postings = np.asarray(postings, np.int64)
        least = 4 ** np.arange(CLASSES)
        # parities tell sets of up to about BITS / 2 grams apart, so no part has more even if there are few documents
        self.parts = np.clip(-(-postings // POSTINGS), np.maximum(1, 8 * least // BITS), np.maximum(1, least // PART_GRAMS))
        self.ranges = np.maximum(1, -(-postings // (self.parts * POSTINGS)))
        self.begin = np.cumsum(self.parts * self.ranges) - self.parts * self.ranges
        self.tasks = max(12, int((-(-4 * postings // POSTINGS)).sum()))

    def of(self, group: int) -> tuple[int, int]:
        """Class and ranges of a group."""
        k = int(np.searchsorted(self.begin, group, "right")) - 1
        return k, int(self.ranges[k])


def _parities(grams: np.ndarray, head: np.ndarray) -> np.ndarray:
    """BITS parities of each run of grams, as 64-bit words: bit x tells whether the number of grams that hash to x is odd."""
    at = mix(grams ^ np.uint64(0xA5A5A5A5)) % np.uint64(BITS)
    ones = np.uint64(1) << (at % np.uint64(64))
    word = at // np.uint64(64)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, ones, np.uint64(0)), head) for w in range(BITS // 64)], axis=1)


def _group_rows(held: list, groups: Groups, theta: float, sketch: np.ndarray, bits: int):
    """One row for each group: its documents (signature, size, size in the part, how many grams here, parities) and the lower halves of their short lists' grams."""
    grams, sizes, sigs = (np.concatenate(x) for x in zip(*held))
    begin = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    own = _class_of(sizes[some])
    near = _near_next(sizes[some], own, theta)
    doc, kind = np.concatenate([some, some[near]]), np.concatenate([own, own[near] + 1])
    for k in np.unique(kind).tolist():
        docs = doc[kind == k]
        n = sizes[docs]
        owner = np.repeat(np.arange(len(docs)), n)
        gram = grams[np.repeat(begin[docs] - np.cumsum(n) + n, n) + np.arange(len(owner))]
        part = ((gram >> np.uint64(32)) * np.uint64(groups.parts[k]) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((gram, sketch[(gram >> np.uint64(64 - bits)).astype(np.int64)], owner, part))
        gram, owner, part = gram[order], owner[order], part[order]
        head, inside = _runs(part * len(docs) + owner)
        parities = _parities(gram, head)
        member = np.repeat(np.arange(len(head)), inside)
        short = np.arange(len(gram)) - head[member] < (inside - least_size(inside, theta) + 1)[member]
        low, member = (gram[short] & np.uint64(0xFFFFFFFF)).astype(np.uint32), member[short]
        del gram, order, short
        ranges = int(groups.ranges[k])
        group = groups.begin[k] + part[head][member] * ranges + low % np.uint32(ranges)
        order = np.lexsort((member, group))
        low, member, group = low[order], member[order], group[order]
        at, here = _runs(group * len(head) + member)
        who = member[at]
        first, many = _runs(group[at])
        spans = list(zip(first.tolist(), (first + many).tolist()))
        edge = np.append(at, len(low))
        of = docs[owner[head]][who]
        columns = [[x[a:b].tobytes() for a, b in spans] for x in (sigs[of], sizes[of].astype(np.int32), inside[who].astype(np.int32), here.astype(np.int32), parities[who])]
        columns.append([low[edge[a] : edge[b]].tobytes() for a, b in spans])
        yield pa.record_batch([pa.array(group[at][first], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "docs", "sizes", "inside", "here", "parities", "grams"])


def _spooled(batches, kinds):
    """(key, an array for each binary column) of rows that come ordered by their first column. The columns of a key are gathered in files among Spark's own
    and mapped, so a key of any size takes no memory of its own."""
    now, files = None, []
    place = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]

    def mapped():
        for f in files:
            f.flush()
        return [np.asarray(np.memmap(f, kind, "r")) for f, kind in zip(files, kinds)]

    for b in batches:
        for k, key in enumerate(b.column(0).to_pylist()):
            if key != now:
                if files:
                    yield now, mapped()
                for f in files:
                    f.close()
                now, files = key, [tempfile.TemporaryFile(dir=place if os.path.isdir(place) else None) for _ in kinds]
            for f, c in zip(files, b.columns[1:]):
                f.write(c[k].as_buffer())
    if files:
        yield now, mapped()


def _group_pairs(batches, theta: float, groups: Groups):
    """Spanning forests of the groups' candidates. Of one group at a time, what its search needs is in memory."""
    held, size = [], 0
    for group, columns in _spooled(batches, (np.uint64, np.int32, np.int32, np.int32, np.uint64, np.uint32)):
        for edges in _candidates(*columns, theta, *groups.of(group)):
            held.append(edges)
            size += len(edges)
            if size > SLICE or len(held) > 1 << 12:
                held = [forest(np.concatenate(held))]
                size = len(held[0])
                if size > SLICE // 2:  # it no longer shrinks: pass it on
                    yield _edges(held[0])
                    held, size = [], 0
    if size:
        yield _edges(forest(np.concatenate(held)))


def _edges(edges: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"u": edges[:, 0], "v": edges[:, 1]})


def _candidates(docs, sizes, inside, here, parities, grams, theta: float, kind: int, ranges: int):
    """A group's pairs that have hits and parities enough, in arrays. Documents are numbered by size; those of each slice are paired with all later ones that
    fit. Besides slices, 28 bytes a document and 8 a posting are in memory."""
    _, first = np.unique(docs, return_index=True)  # copies have the same name
    first = first[np.argsort(sizes[first], kind="stable")].astype(np.int32)
    begin = (np.cumsum(here) - here)[first]
    n, m = sizes[first], inside[first]
    edge = np.concatenate([[0], np.cumsum(here[first])])
    least = int(np.searchsorted(n, 4**kind))  # a pair of two lesser ones belongs to the class before
    keys = np.empty(edge[-1], np.uint64)
    partner = keys.view(np.uint32)[::2]

    def blocks():
        """(first document, end, their grams, whose these are)."""
        x = 0
        while x < len(n):
            y = max(x + 1, int(np.searchsorted(edge, edge[x] + SLICE, "right")) - 1)
            many = np.diff(edge[x : y + 1])
            yield x, y, grams[np.repeat(begin[x:y] - edge[x:y], many) + np.arange(edge[x], edge[y])], np.repeat(np.arange(x, y), many)
            x = y

    for x, y, lists, who in blocks():
        keys[edge[x] : edge[y]] = lists.astype(np.uint64) << np.uint64(32) | who.astype(np.uint64)
    keys.sort()  # by list, then document

    def count(who, start, partners):
        upto = np.concatenate([[0], np.cumsum(partners)])
        pairs, held = np.empty(upto[-1], np.uint64), 0
        for low in range(0, len(pairs), SLICE):
            high = min(low + SLICE, len(pairs))
            s = slice(int(np.searchsorted(upto, low, "right")) - 1, int(np.searchsorted(upto, high)))
            skip = np.maximum(upto[s], low)
            many = np.minimum(upto[s.start + 1 : s.stop + 1], high) - skip
            a = np.repeat(who[s], many)
            b = partner[np.repeat(start[s] - upto[s] + low, many) + np.arange(high - low)].astype(np.int64)
            ok = (np.minimum(m[a], m[b]) >= theta * np.maximum(m[a], m[b]) - 1e-9) & (a != b)  # equal if two grams of one have the same lower half
            a, b = a[ok].astype(np.uint64), b[ok].astype(np.uint64)
            pairs[held : held + len(a)] = a << np.uint64(32) | b
            held += len(a)
        pairs = pairs[:held]
        pairs.sort()
        head, hits = _runs(pairs)
        for low in range(0, len(head), SLICE):
            s = slice(low, low + SLICE)
            a = (pairs[head[s]] >> np.uint64(32)).astype(np.int64)
            b = (pairs[head[s]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            overlap = least_overlap(m[a], m[b], theta)
            ok = hits[s] * ranges >= overlap - np.maximum(least_size(m[a], theta), least_size(m[b], theta)) + 1
            a, b, overlap = a[ok], b[ok], overlap[ok]
            most = m[a] + m[b] - 2 * overlap
            a, b = first[a], first[b]
            ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
            if ok.any():
                yield np.stack([docs[a[ok]].view(np.int64), docs[b[ok]].view(np.int64)], axis=1)

    words = parities.reshape(-1, BITS // 64)
    for x, y, lists, who in blocks():
        lists = lists.astype(np.uint64) << np.uint64(32)
        limit = np.searchsorted(n, (n[x:y] + 1e-9) / theta, "right")
        start = np.searchsorted(keys, lists | np.maximum(who + 1, least).astype(np.uint64))
        partners = np.maximum(0, np.searchsorted(keys, lists | limit[who - x].astype(np.uint64)) - start)
        upto = np.concatenate([[0], np.cumsum(partners)])[edge[x : y + 1] - edge[x]]  # by document
        low = 0
        while low < y - x:  # as many documents as have so many hits, or one
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + PAIR_HITS, "right")) - 1)
            s = slice(edge[x + low] - edge[x], edge[x + high] - edge[x])
            if upto[high] - upto[low] > PAIR_HITS:  # one, with some of its partners at a time
                step = max(1, PAIR_HITS // (s.stop - s.start))
                for p in range(max(x + low + 1, least), limit[low], step):
                    begins, ends = (np.searchsorted(keys, lists[s] | np.uint64(q)) for q in (p, min(p + step, limit[low])))
                    yield from count(who[s], begins, ends - begins)
            elif upto[high] > upto[low]:
                yield from count(who[s], start[s], partners[s])
            low = high


def _posting_rows(held: list, buckets: int, theta: float, sketch: np.ndarray, bits: int):
    """One row for each bucket: its documents (signature, size, how many grams) and their grams' lower halves. With `_bucket_pairs` and `_likely_pairs` this is
    another way to candidates, over whole sets: buckets of grams whose pairs are shuffled and summed. It is kept to test `_group_pairs` by."""
    grams, sizes, sigs = (np.concatenate(x) for x in zip(*held))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((grams, sketch[(grams >> np.uint64(64 - bits)).astype(np.int64)], owner))
    place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    short = place < (sizes - least_size(sizes, theta) + 1)[owner]
    grams, owner = grams[order][short], owner[short]
    bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, grams, owner = bucket[order], (grams[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])
    head = np.flatnonzero(new)
    lengths = np.diff(np.append(head, len(owner))).astype(np.int32)
    edge, head_edge = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(bucket[head], np.arange(buckets + 1))
    docs, ns = sigs[owner[head]], sizes[owner[head]].astype(np.int32)
    used = [k for k in range(buckets) if edge[k] < edge[k + 1]]
    columns = [[x[e[k] : e[k + 1]].tobytes() for k in used] for x, e in ((docs, head_edge), (ns, head_edge), (lengths, head_edge), (grams, edge))]
    return pa.record_batch([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "docs", "sizes", "lengths", "grams"])


def _pair_hits(gram: np.ndarray, doc: np.ndarray, most: int = 1 << 19):
    """Index pairs of postings that share a gram, list by list, in arrays of about `most` pairs. gram is ascending."""
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(gram)))
    for size in np.unique(length[length > 1]).tolist():
        begin = start[length == size]
        if size <= 2048:
            x, y = np.triu_indices(size, 1)
            step = max(1, most // len(x))
            for k in range(0, len(begin), step):
                at = begin[k : k + step, None]
                yield doc[(at + x).ravel()], doc[(at + y).ravel()]
        else:  # row by row: a list of any length in bounded memory
            for b in begin.tolist():
                for i in range(b, b + size - 1):
                    yield np.full(b + size - 1 - i, doc[i]), doc[i + 1 : b + size]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(x)))


def _add(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    head, _ = _runs(keys)
    return keys[head], np.add.reduceat(times, head) if len(head) else times


PAIRS = "part int, head binary, body binary"


def _packed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _pack_pairs(names: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, hits: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs of document numbers, ordered by (a, b), as a table of the documents and compressed columns: the steps from one partner to the next, and
    the hits. Numbers take as many bytes as the largest needs."""
    head, many = _runs(a)
    u = a[head]
    v, at = np.unique(b, return_inverse=True)
    step = np.diff(at, prepend=0)
    step[head] = at[head]
    kinds = [next(k for k in (np.uint8, np.uint16, np.uint32) if not len(x) or x.max() <= np.iinfo(k).max) for x in (step, hits)]
    table = [np.array([len(u), len(v), len(a), kinds[0]().itemsize, kinds[1]().itemsize], np.int64), names[u], names[v], n[u].astype(np.int32), n[v].astype(np.int32), many.astype(np.int32)]
    return _packed(table), _packed([step.astype(kinds[0]), hits.astype(kinds[1])])


def _unpack_pairs(head: bytes, body: bytes) -> tuple[np.ndarray, ...]:
    """(names of the lesser, their sizes, how many partners each; names of partners, their sizes; each pair's place among the partners; hits)."""
    raw = zstandard.ZstdDecompressor().decompress(head)
    nu, nv, pairs, step_bytes, hit_bytes = np.frombuffer(raw, np.int64, 5).tolist()
    at, out = 40, []
    for kind, count in ((np.uint64, nu), (np.uint64, nv), (np.int32, nu), (np.int32, nv), (np.int32, nu)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    u, v, n_u, n_v, many = out
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    raw = zstandard.ZstdDecompressor().decompress(body)
    step = np.frombuffer(raw, kinds[step_bytes], pairs).astype(np.int64)
    hits = np.frombuffer(raw, kinds[hit_bytes], pairs, pairs * step_bytes)
    place = np.cumsum(step)
    begin = np.cumsum(many) - many
    place -= np.repeat((place - step)[begin] if pairs else place, many)
    return u, n_u, many, v, n_v, place, hits


def _by_key(batches):
    """(key, rows of binary columns) of rows that come ordered by their first column."""
    now, rows = None, []
    for b in batches:
        for key, *row in zip(b.column(0).to_pylist(), *b.columns[1:]):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def _bucket_pairs(batches, theta: float, parts: int):
    """Per pair of documents of one bucket that are of fitting sizes, the number of short lists that hold both: one row for each part of the lesser
    names. One bucket is in memory at a time."""
    for _, rows in _by_key(batches):
        docs, sizes, lengths, grams = (np.concatenate([np.frombuffer(r[k].as_buffer(), kind) for r in rows]) for k, kind in enumerate((np.uint64, np.int32, np.int32, np.uint32)))
        yield from _pairs_of_bucket(docs, sizes, lengths, grams, theta, parts)


def _pairs_of_bucket(docs, sizes, lengths, grams, theta: float, parts: int):
    names, first, number = np.unique(docs, return_index=True, return_inverse=True)
    n = sizes[first].astype(np.int64)
    owner = np.repeat(number.astype(np.int32), lengths)
    del docs, sizes, lengths, number
    both = np.sort(grams.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]  # copies have the same name
    both = both[keep]
    grams, owner = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int32)
    del both, keep
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []
    size = 0

    def settle():
        new = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        new.sort()
        head, times = _runs(new)
        return _add(np.concatenate([new[head], *(k for k, _ in counts)]), np.concatenate([times, *(c for _, c in counts)]))

    for a, b in _pair_hits(grams, owner):
        fit = np.minimum(n[a], n[b]) >= theta * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[fit].astype(np.int64), b[fit].astype(np.int64)
        waiting.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
        size += len(a)
        if size > max(1 << 20, 2 * sum(len(k) for k, _ in counts)):
            counts, waiting, size = [settle()], [], 0
    keys, hits = settle()
    a, b = keys // len(names), keys % len(names)
    part = ((names[a] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as a is
    edge = np.searchsorted(part, np.arange(parts + 1))
    used = [k for k in range(parts) if edge[k] < edge[k + 1]]
    packed = [_pack_pairs(names, n, a[s], b[s], hits[s]) for s in (slice(edge[k], edge[k + 1]) for k in used)]
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array([h for h, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())], names=["part", "head", "body"])


def _likely_pairs(batches, theta: float):
    """A spanning forest of the pairs whose hits in all buckets reach T - L. A part is a few of all names, so its pairs are summed in memory."""
    for _, packed in _by_key(batches):
        rows = [_unpack_pairs(*(x.as_py() for x in r)) for r in packed]
        names, first = np.unique(np.concatenate([x for r in rows for x in (r[0], r[3])]), return_index=True)
        n = np.concatenate([x for r in rows for x in (r[1], r[4])])[first].astype(np.int64)
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        for u, _, many, v, _, at, hits in rows:
            counts.append((np.repeat(np.searchsorted(names, u), many) * len(names) + np.searchsorted(names, v)[at], hits.astype(np.int64)))
            if sum(len(k) for k, _ in counts[1:]) > max(1 << 20, len(counts[0][0])):
                counts = [_add(np.concatenate([k for k, _ in counts]), np.concatenate([c for _, c in counts]))]
        keys, hits = _add(np.concatenate([k for k, _ in counts]), np.concatenate([c for _, c in counts]))
        a, b = keys // len(names), keys % len(names)
        most_long = np.maximum(least_size(n[a], theta), least_size(n[b], theta)) - 1
        ok = hits >= least_overlap(n[a], n[b], theta) - most_long
        edges = forest(np.stack([names[a[ok]].view(np.int64), names[b[ok]].view(np.int64)], axis=1))
        yield pa.record_batch({"u": edges[:, 0], "v": edges[:, 1]})


def heap_merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, in how many lists each is) of ascending lists, by a heap of list heads."""
    merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64)
    head, times = _runs(merged)
    return merged[head], times


def run_merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same by a stable sort of the concatenated lists, which merges their ascending runs."""
    merged = np.sort(np.concatenate(lists), kind="stable")
    head, times = _runs(merged)
    return merged[head].astype(np.int64), times


def divide_skip(sets: list[np.ndarray], theta: float, mu: float = MU, block: np.ndarray | None = None, merge: Callable = run_merge):
    """All pairs (i, j, overlap) of ascending arrays of distinct grams with Jaccard similarity of at least theta, of different blocks if these are given."""
    sizes = np.array([len(s) for s in sets])
    rank = np.argsort(sizes, kind="stable")  # a query looks for documents before it in this order
    grams = np.concatenate([sets[k] for k in rank])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes[rank])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    del order
    start, length = _runs(grams)
    names = grams[start]
    del grams
    ordered = sizes[rank]
    blocks = None if block is None else np.asarray(block)[rank]
    for q in range(1, len(sets)):
        own = sets[rank[q]]
        n = len(own)
        if not n:
            continue
        low = int(np.searchsorted(ordered, least_size(n, theta)))
        if low >= q:
            continue
        lists = np.searchsorted(names, own)
        by_length = lists[np.argsort(length[lists], kind="stable")]
        least = int(least_size(n, theta))
        longest = int(length[by_length[-1]])
        skip = min(least - 1, int(least / (mu * math.log2(max(2, longest)) + 1)))
        short, long = by_length[: n - skip], by_length[n - skip :]
        found, count = merge([owner[start[k] : start[k] + length[k]] for k in short])
        ok = (found >= low) & (found < q)
        if blocks is not None:
            ok &= blocks[found] != blocks[q]
        found, count = found[ok], count[ok]
        need = least_overlap(n, ordered[found], theta)
        ok = count + skip >= need
        found, count, need = found[ok], count[ok], need[ok]
        for k, one in enumerate(long[::-1] if len(found) else ()):  # longest last would keep hopeless candidates longer
            entries = owner[start[one] : start[one] + length[one]]
            spot = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
            count = count + (entries[spot] == found)
            ok = count + (skip - 1 - k) >= need
            if not ok.all():
                found, count, need = found[ok], count[ok], need[ok]
                if not len(found):
                    break
        for f, c in zip(found.tolist(), count.tolist()):
            yield int(rank[q]), int(rank[f]), c


FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("overlap", pa.int32()), ("jaccard", pa.float64())])
LINKED = pa.schema([("sig", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _pairs_found(sigs, sets, sizes, blocks, weights, theta: float):
    rows = [(min(sigs[i], sigs[j]), max(sigs[i], sigs[j]), c, c / (len(sets[i]) + len(sets[j]) - c)) for i, j, c in divide_skip(sets, theta, block=blocks)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FOUND.types)], schema=FOUND)


def _links_found(sigs, sets, sizes, blocks, weights, theta: float):
    """Per document with partners here: the least one that it is connected to here, and how many documents (copies counted) it is similar to."""
    links, edges = np.zeros(len(sigs), np.int64), []
    for i, j, _ in divide_skip(sets, theta, block=blocks):
        links[i] += weights[j]
        links[j] += weights[i]
        edges.append((i, j))
        if len(edges) > 1 << 16:
            edges = list(map(tuple, forest(np.array(edges)).tolist()))
    if edges:
        root = np.arange(len(sigs))
        least = forest(np.array(edges, np.int64))
        root[least[:, 0]] = least[:, 1]
        at = np.flatnonzero(links)
        names = np.array(sigs, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]]), pa.array(links[at])], schema=LINKED)


def _search(batches, n: int, theta: float, report: Callable):
    """Rows (component, i, j, sig, block, weight, text) come ordered by (component, i, j, sig): the documents of two blocks, or of one if i = j, of a component. They are
    searched when the next such group begins."""
    now, sigs, sets, blocks, weights = None, [], [], [], []

    def flush():
        if len(sets) > 1:
            yield from report(sigs, sets, None, blocks if now[1] != now[2] else None, weights, theta)

    for b, i, j, texts in _pieces_of(batches, 6):
        grams, sizes, _ = gram_sets(texts, n)
        stop = np.cumsum(sizes)
        for *key, sig, block, weight, lo, hi in zip(*(b.column(c).slice(i, j - i).to_pylist() for c in range(6)), stop - sizes, stop):
            if key != now:
                yield from flush()
                now, sigs, sets, blocks, weights = key, [], [], [], []
            if sigs and sigs[-1] == sig:  # a repeated row
                continue
            sigs.append(sig)
            sets.append(grams[lo:hi])
            blocks.append(block)
            weights.append(weight)
    if now is not None:
        yield from flush()


def _classes(own: DataFrame, n: int) -> DataFrame:
    """kid, th, sig, n (grams) of every document; one without grams has a name of its own."""

    def run(batches):
        for b, i, j, texts in _pieces_of(batches, 2):
            _, sizes, sigs = gram_sets(texts, n)
            th = b.column(1).slice(i, j - i)
            yield pa.record_batch([b.column(0).slice(i, j - i), th, pa.array(np.where(sizes > 0, sigs.view(np.int64), th.to_numpy())), pa.array(sizes, pa.int64())], names=["kid", "th", "sig", "n"])

    return own.mapInArrow(run, "kid long, th long, sig long, n long")


def _groups(documents: DataFrame, theta: float) -> Groups:
    kind = F.least(F.floor((F.length(F.bin("n")) - 1) / 2), F.lit(CLASSES - 1))
    each = documents.where("n > 0").select(kind.alias("k"), "n", (F.col("n") - F.ceil(F.lit(theta) * F.col("n") - F.lit(1e-9)) + 1).alias("short"))
    each = each.select(F.explode(F.when(_near_next(F.col("n"), F.col("k"), theta), F.array("k", F.col("k") + 1)).otherwise(F.array("k"))).alias("k"), "short")
    held = np.zeros(CLASSES, np.int64)
    for r in each.groupBy("k").agg(F.sum("short").alias("short")).collect():
        held[r.k] = r.short
    return Groups(held)


def _searched(docs: DataFrame, n: int, theta: float, id_col: str, text_col: str, report: Callable, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: kid, th, sig, n; classes: sig, first, weight; what `report` says of the groups of classes that may be similar)."""
    own = identified(docs, id_col, text_col)
    spark = docs.sparkSession
    documents = as_table(_classes(own, n), "ngram-classes")
    shared = spark.sparkContext.broadcast(document_sketch(own, n))
    groups = _groups(documents, theta)

    def emit(batches):
        held, size = [], 0
        for _, _, _, texts in _pieces_of(batches, 0):
            held.append(gram_sets(texts, n))
            size += len(held[-1][0])
            if size > 1 << 20:
                yield from _group_rows(held, groups, theta, shared.value, SKETCH_BITS)
                held, size = [], 0
        if size:
            yield from _group_rows(held, groups, theta, shared.value, SKETCH_BITS)

    postings = own.select("text").mapInArrow(emit, "bucket long, docs binary, sizes binary, inside binary, here binary, parities binary, grams binary").repartition(groups.tasks, "bucket").sortWithinPartitions("bucket")
    likely = as_table(postings.mapInArrow(lambda batches: _group_pairs(batches, theta, groups), "u long, v long"), "ngram-candidates")
    classes = documents.where("n > 0").groupBy("sig").agg(F.min(F.struct("kid", "th")).alias("first"), F.count("*").alias("weight"), F.min("n").alias("n"))
    chosen = as_table(classes.join(components(likely), F.col("sig") == F.col("node")).select("component", "sig", "first.*", "weight", "n"), "ngram-chosen")
    # a component of more grams than a task should hold is cut into blocks, and every two blocks are searched by themselves
    cut = chosen.groupBy("component").agg(F.sum("n").alias("grams")).where(F.col("grams") > COMPONENT_GRAMS).select("component", F.ceil(F.col("grams") * 2 / COMPONENT_GRAMS).cast("int").alias("k"))
    placed = chosen.join(cut, "component", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    texts = key_filter(chosen, own).join(placed, ["kid", "th"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    texts = texts.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "block", "weight", "text")
    ordered = texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "sig")
    return documents, classes.select("sig", "first", "weight"), ordered.mapInArrow(lambda batches: _search(batches, n, theta, report), schema)


def _grouped(docs: DataFrame, n: int, theta: float, id_col: str, text_col: str) -> DataFrame:
    """kid, th, best (the least document of the group), links, of every document."""
    documents, classes, found = _searched(docs, n, theta, id_col, text_col, _links_found, "sig long, root long, links long")
    found = as_table(found, "ngram-links")
    linked = found.groupBy("sig").agg(F.sum("links").alias("links"))
    named = classes.join(components(found.select(F.col("sig").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "sig"), "sig", "left").join(linked, "sig", "left")
    named = as_table(named.where("weight > 1 or component is not null").select("sig", "first", "weight", "component", F.coalesce("links", F.lit(0)).alias("links")), "ngram-named")
    best = named.where("component is not null").groupBy("component").agg(F.min("first").alias("best"))
    named = named.join(best, "component", "left").select("sig", F.coalesce("best", "first").alias("best"), (F.col("links") + F.col("weight") - 1).alias("links"))
    return documents.join(named, "sig", "left").select("kid", "th", F.coalesce("best", F.struct("kid", "th")).alias("best"), F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, n: int = N, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, links of every document: links counts the other documents that it is similar to, copies included; class_id is the least id of
    those connected to it by links, its own if there are none."""
    return _grouped(docs, n, theta, id_col, text_col).select(as_id(F.col("kid")).alias("doc_id"), as_id(F.col("best.kid")).alias("class_id"), "links")


def all_pairs(docs: DataFrame, n: int = N, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_a, doc_b, jaccard (6 decimals): every pair of similar documents, those of all members of both classes and those within a class. doc_a is the
    lesser. The output grows with the product of the classes' sizes."""
    documents, _, found = _searched(docs, n, theta, id_col, text_col, _pairs_found, "u long, v long, overlap int, jaccard double")
    placed = documents.where("n > 0").withColumn("k", F.row_number().over(Window.partitionBy("sig").orderBy("kid", "th")))
    left, right = (placed.select(F.col("sig").alias(s), F.struct("kid", "th").alias(f"f{s}"), F.col("k").alias(f"k{s}")) for s in ("u", "v"))
    near = found.select("u", "v", F.round("jaccard", 6).alias("jaccard")).join(left, "u").join(right, "v")
    same = left.join(right.withColumnRenamed("v", "u"), "u").where("ku < kv").withColumn("jaccard", F.lit(1.0))
    named = near.select("fu", "fv", "jaccard").union(same.select("fu", "fv", "jaccard"))
    return named.select(as_id(F.least("fu", "fv")["kid"]).alias("doc_a"), as_id(F.greatest("fu", "fv")["kid"]).alias("doc_b"), "jaccard")


def keep_one(docs: DataFrame, n: int = N, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of a group (documents connected by links) but for its least. Documents without grams stay."""
    grouped = _grouped(docs, n, theta, id_col, text_col).where("links > 0")
    gone = grouped.groupBy("kid", "th").agg(F.max(F.struct("kid", "th") == F.col("best")).alias("first"))
    rows = identified(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).drop("text")
    rows = rows.join(gone, ["kid", "th"], "left").where("first is null or first")
    rows = rows.withColumn("copy", F.when(F.col("first"), F.row_number().over(Window.partitionBy("kid", "th", "first").orderBy("kid"))).otherwise(1))
    return rows.where("copy = 1").select("row.*")


_SETS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] END) AS gram FROM w WHERE len(ws) > 0
), r AS (
  SELECT doc_id, gram, count(*) OVER (PARTITION BY doc_id) AS n FROM g
), p AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id AND least(a.n, b.n) >= {THETA} * greatest(a.n, b.n) - 1e-9 GROUP BY ALL
), pairs AS (
  SELECT doc_a, doc_b, round(o / (na + nb - o), 6) AS jaccard FROM p WHERE o >= ceil({THETA} / (1 + {THETA}) * (na + nb) - 1e-9)
)"""

SQL = f"""{_SETS}, e AS (
  SELECT doc_a AS u, doc_b AS v FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs
), reached(doc_id, other) AS (
  SELECT u, v FROM e UNION SELECT doc_id, v FROM reached JOIN e ON other = u
), c AS (
  SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id
), l AS (
  SELECT u AS doc_id, count(*) AS links FROM e GROUP BY u
)
SELECT d.doc_id, coalesce(least, d.doc_id) AS class_id, coalesce(links, 0) AS links FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""

ALL_SQL = f"{_SETS}\nSELECT doc_a, doc_b, jaccard FROM pairs\n"
