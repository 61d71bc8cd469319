"""Removal of long passages that an earlier document has, by sparse suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller id. Suffixes are
sorted only at anchors: each window of LENGTH bytes names its smallest GRAM-byte hash, so equal windows name equal
anchors at equal places, and every pair of equal windows meets at an anchor.

1. Anchors go to partitions by hash. Within a task a hash that several documents have is sent once; the reducers find
   the hashes that stand in more than one document.
2. Only at such anchors the bytes around them are fetched. Contexts that are equal within a task are sent once, with the
   smallest id; the others are then known to be repeated as a whole.
3. In each partition the contexts are suffix-sorted to both sides by deep-shallow sorting: multikey sorting, eight bytes a
   symbol, to a shallow depth; what still ties there, long common prefixes, is ordered by blind tries. With the common
   prefixes of neighbours, every window gets the class of equal ones, compared byte by byte, and so the smallest id that
   has it. A hot anchor, one that very many texts have, would bring all its contexts to one partition; its
   windows travel apart instead, each to the partition that its own LENGTH bytes name.
4. The windows found are joined to the texts, and their bytes are cut out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._common import cut, slices, text_of

LENGTH, GRAM = 50, 16
SIDE = LENGTH - GRAM
#: Bytes sorted as symbols of eight before tries take over (the first eight name the anchor).
SHALLOW = 24
#: Bytes of text for each partition of anchors and of documents.
ANCHOR_BYTES, TEXT_BYTES = 1 << 24, 1 << 22
#: Anchors and texts that are combined before they are sent.
HELD, ROWS = 1_000_000, 10_000
#: An anchor is hot if so many texts have it: an eighth of the anchors of a usual partition. The bits of hot anchors, of
#: fixed size whatever their number, go to all tasks; an anchor that shares a hot one's bit is treated as hot too, which
#: changes the way only.
HOT, HOT_BITS = ANCHOR_BYTES // 128, 1 << 24
LAST = np.iinfo(np.int64).max
WHOLE = np.uint32(0xFFFFFFFF)


# ---- deep-shallow sorting


class BlindTrie:
    """Orders strings of one length: inner nodes know a depth and the bytes that branch there, not the bytes skipped."""

    def __init__(self, first: bytes):
        self.root: list | bytes = first

    def insert(self, s: bytes) -> None:
        """``s`` must not be in the trie."""
        node = self.root
        while not isinstance(node, bytes):  # blindly down to some leaf
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = next(i for i, (x, y) in enumerate(zip(s, node, strict=True)) if x != y)
        other = node[depth]
        parent, node = None, self.root
        while not isinstance(node, bytes) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][s[depth]] = s
            return
        new = [depth, {other: node, s[depth]: s}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def sorted(self) -> Iterator[bytes]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                yield node
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix."""
    m, width = rows.shape
    order = np.arange(m)
    if m < 2:
        return order
    shallow = min(SHALLOW, width) // 8
    symbols = np.ascontiguousarray(rows[:, : shallow * 8]).view(">u8").astype(np.uint64)
    segment = np.zeros(m, dtype=np.int64)
    todo = np.arange(m)  # places in the order that still tie
    for d in range(shallow):
        here = symbols[order[todo], d]
        by = np.lexsort((here, segment[todo]))
        order[todo] = order[todo][by]
        here, seg = here[by], segment[todo]
        new = np.ones(len(todo), dtype=bool)
        new[1:] = (here[1:] != here[:-1]) | (seg[1:] != seg[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(todo)))
        segment[todo] = np.repeat(todo[starts], sizes)
        todo = todo[np.repeat(sizes > 1, sizes)]
        if not len(todo):
            return order
    if width > shallow * 8:
        tails = np.ascontiguousarray(rows[:, shallow * 8 :])
        seg = segment[todo]
        starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        wide = tails.shape[1]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(todo)], strict=True):
            at = order[todo[a:b]]
            part = tails[at]
            if (part[1:] == part[:1]).all():
                continue
            raw = part.tobytes()
            places: dict[bytes, list[int]] = {}
            for i, row in enumerate(at.tolist()):
                places.setdefault(raw[i * wide : (i + 1) * wide], []).append(row)
            strings = iter(places)
            trie = BlindTrie(next(strings))
            for s in strings:
                trie.insert(s)
            order[todo[a:b]] = [row for s in trie.sorted() for row in places[s]]
    return order


def classes_by_depth(group: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the rows sorted by (group, tail): bytes of the tail in common with the row before, -1 where a group begins."""
    named = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), tails], axis=1)
    order = deep_shallow(named)
    common = np.full(len(order), -1, dtype=np.int16)
    if len(order) > 1:
        s, g = tails[order], group[order]
        differ = s[1:] != s[:-1]
        common[1:] = np.where(g[1:] != g[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), tails.shape[1]))
    return order, common


def earlier(grams: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor, bit t tells that the window starting t bytes before it also stands in a document with a smaller id.

    grams: (m, GRAM) bytes; left: (m, SIDE) bytes before, nearest first; right: (m, SIDE) bytes after; before, after: how
    many of them there are.
    """
    m = len(doc)
    by_doc = np.argsort(doc, kind="stable")
    doc = doc[by_doc]
    words = np.ascontiguousarray(grams[by_doc]).view(">u8").astype(np.uint64)
    o = np.lexsort((words[:, 1], words[:, 0]))
    new = np.ones(m, dtype=bool)
    new[1:] = (words[o][1:] != words[o][:-1]).any(axis=1)
    group = np.empty(m, dtype=np.uint64)
    group[o] = np.cumsum(new)
    sides = [classes_by_depth(group, x[by_doc]) for x in (left, right)]
    before, after = before[by_doc], after[by_doc]
    mask = np.zeros(m, dtype=np.uint64)
    ids = [np.empty(m, dtype=np.uint64) for _ in sides]
    for t in range(SIDE + 1):
        for depth, (order, common), into in zip((t, SIDE - t), sides, ids, strict=True):
            into[order] = np.cumsum(common < depth)
        rows = np.flatnonzero((before >= t) & (after >= SIDE - t))
        if not len(rows):
            continue
        _, first, inverse = np.unique(ids[0][rows] * np.uint64(m + 1) + ids[1][rows], return_index=True, return_inverse=True)
        found = doc[rows[first]][inverse] < doc[rows]  # rows are in order of ids: the first of a class has the smallest
        mask[rows[found]] |= np.uint64(1 << t)
    out = np.empty(m, dtype=np.uint64)
    out[by_doc] = mask
    return out


# ---- anchors


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of texts that lie end to end; the places rise."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_bytes._VALUE[data] * _bytes.UP.upto(n), out=sums[1:])
    h = _bytes.mix((sums[GRAM:] - sums[:-GRAM]) * _bytes.DOWN.upto(n - GRAM + 1))  # each place's gram_hash
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= SIDE + 1:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := SIDE + 1 - reach:
        least = np.minimum(least[:-rest], least[rest:])
    whole = np.zeros(n + 1, dtype=np.int32)  # windows that lie within one text
    lengths = np.diff(offsets)
    for_ = lengths >= LENGTH
    np.add.at(whole, offsets[:-1][for_], 1)
    np.add.at(whole, offsets[1:][for_] - LENGTH + 1, -1)
    least = least[np.cumsum(whole[: len(least)]) > 0]
    places = least & low
    places = places[np.append(True, places[1:] != places[:-1])] if len(places) else places
    places = np.unique(places).astype(np.int64)
    return h[places], places


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """The hash that ``anchors`` gives, of each row of GRAM bytes."""
    return _bytes.mix((_bytes._VALUE[grams] * _bytes.UP.upto(GRAM)).sum(axis=1, dtype=np.uint64))


_KEY = np.dtype([("doc", "<i8"), ("th", "<u4")])


def _runs(doc: np.ndarray, th: np.ndarray) -> tuple[bytes, bytes]:
    """Documents as runs: (keys, counts)."""
    if not len(doc):
        return b"", b""
    new = np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))
    at = np.flatnonzero(new)
    keys = np.empty(len(at), dtype=_KEY)
    keys["doc"], keys["th"] = doc[at], th[at]
    return keys.tobytes(), np.diff(np.append(at, len(doc))).astype("<u4").tobytes()


def _unrun(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.frombuffer(keys, dtype=_KEY), np.frombuffer(counts, dtype="<u4")
    return np.repeat(k["doc"], n), np.repeat(k["th"], n)


def _halves(x: np.ndarray) -> tuple[bytes, bytes]:
    """Low and high halves of 32-bit values apart, so that the high ones compress."""
    return (x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("<u2").tobytes()


def _whole(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, dtype="<u2").astype(np.uint32) | (np.frombuffer(high, dtype="<u2").astype(np.uint32) << np.uint32(16))


def bucket_of(doc: np.ndarray, th: np.ndarray, n: int) -> np.ndarray:
    """Partition of a text by its id and checksum, so that rows with one id (or none) are spread: what ``pmod(xxhash64(id) ^ crc32(text), n)`` gives in SQL."""
    # The primes of XXH64, and SQL's seed.
    p1, p2, p3, p4, p5, seed = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 42))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    h = np.full(len(doc), np.uint64((int(seed) + int(p5) + 8) & ((1 << 64) - 1)), dtype=np.uint64)
    h ^= turn(doc.view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    return ((h.view(np.int64) ^ th.astype(np.int64)) % n).astype(np.int32)


def _split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows in order) of each value of ``by``."""
    order = np.argsort(by, kind="stable")
    values, starts = np.unique(by[order], return_index=True)
    for v, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=False):  # no values, no rows
        yield v, rows


_BLOB = "route int, kind int, keys binary, counts binary, low binary, high binary, a binary, b binary"
_NAMES = [x.split()[0] for x in _BLOB.split(", ")]
_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _TYPES, strict=True)], _NAMES)


#: Kinds of rows: hashes to compare; places found shared; contexts to compare; windows found; single windows to compare; bits of hot anchors.
HASHES, PLACES, CONTEXTS, WINDOWS, SINGLES, BITS = range(6)


def _places(q: int, doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    """Rows that tell documents' partitions their shared places."""
    o = np.lexsort((pos, th, doc))
    doc, th, pos = doc[o], th[o], pos[o]
    for v, at in _split(bucket_of(doc, th, q)):
        yield (v, PLACES, *_runs(doc[at], th[at]), *_halves(pos[at]), b"", b"")


class _Anchors:
    """Anchors of a task's texts, sent whenever HELD of them or ROWS texts are held."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.copies: list[tuple[int, int]] = []
        self.known: dict[bytes, int] = {}  # the smallest id so far of each text held
        self.texts = self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = [t.as_buffer() if t.is_valid else b"" for t in batch.column(1)]
        digests = [hashlib.blake2b(t, digest_size=16).digest() for t in raw]
        checks = np.array([zlib.crc32(t) for t in raw], dtype=np.uint32)
        # of a text that was met under an id no larger, the anchors don't go on
        stay = np.zeros(len(raw), dtype=bool)
        for i, d in enumerate(digests):
            known = self.known.get(d)
            stay[i] = known is None or ids[i] < known
            if stay[i]:
                self.known[d] = int(ids[i])
            elif ids[i] > known and len(raw[i]) >= LENGTH:
                self.copies.append((int(ids[i]), int(checks[i])))
        for row, data, offsets in _bytes.byte_blocks(batch.column(1)):
            h, at = anchors(data, offsets)
            owner = np.searchsorted(offsets, at, "right") - 1
            keep = stay[row + owner]
            h, at, owner = h[keep], at[keep], owner[keep]
            self.parts.append((h, ids[row + owner], checks[row + owner], (at - offsets[owner]).astype(np.uint32)))
            self.size += len(h)
        self.texts += len(raw)

    def full(self) -> bool:
        return self.size >= HELD or self.texts >= ROWS

    def rows(self) -> Iterator[tuple]:
        p, q = self.p, self.q
        if self.copies:
            doc, th = (np.array(x) for x in zip(*self.copies, strict=True))
            yield from _places(q, doc.astype(np.int64), th.astype(np.uint32), np.full(len(doc), WHOLE))
        parts = list(zip(*self.parts, strict=True))
        self.clear()
        if not parts or not any(map(len, parts[0])):
            return
        h, doc, th, pos = (np.concatenate(x) for x in parts)
        o = np.lexsort((pos, th, doc, h))
        h, doc, th, pos = h[o], doc[o], th[o], pos[o]
        new = np.append(True, h[1:] != h[:-1])
        other = np.append(False, (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        group = np.cumsum(new) - 1
        shared = (np.bincount(group, weights=other) > 0)[group]
        yield from _places(q, doc[shared], th[shared], pos[shared])
        send = np.flatnonzero(new | ~shared)  # of a shared hash one row is enough
        send = send[np.lexsort((pos[send], th[send], doc[send]))]
        texts = np.minimum(np.where(shared, np.bincount(group, weights=new | other)[group], 1), 65535).astype("<u2")[send]
        h, doc, th, pos = h[send], doc[send], th[send], pos[send]
        for v, at in _split(((h >> np.uint64(40)) % np.uint64(p)).astype(np.int32)):
            tag = h[at]
            yield (v, HASHES, *_runs(doc[at], th[at]), *_halves(pos[at]), (tag & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((tag >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes() + texts[at].tobytes())


def _anchor_rows(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Anchors(p, q)
        for batch in (part for whole in batches for part in slices(whole)):
            held.add(batch)
            if held.full():
                yield _batch(list(held.rows()))
        yield _batch(list(held.rows()))

    return run


def _parted(table: pa.Table, kind: int) -> tuple[pa.Table, list[dict]]:
    """(rows that were settled within a task and only pass, rows of the kind)."""
    ours = pa.compute.equal(table["kind"], kind)
    return table.filter(pa.compute.invert(ours)), table.filter(ours).to_pylist()


def _shared_places(p: int, q: int):
    def run(table: pa.Table) -> pa.Table:
        done, rows = _parted(table, HASHES)
        if not rows:
            return done
        parts = []
        for r in rows:
            low = np.frombuffer(r["a"], dtype="<u4").astype(np.uint64)
            high, texts = np.frombuffer(r["b"], dtype=np.uint8, count=len(low)), np.frombuffer(r["b"], dtype="<u2", offset=len(low))
            parts.append((*_unrun(r["keys"], r["counts"]), _whole(r["low"], r["high"]), low | (high.astype(np.uint64) << np.uint64(32)), texts))
        doc, th, pos, tag, texts = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(tag, kind="stable")
        doc, th, pos, tag, texts = doc[o], th[o], pos[o], tag[o], texts[o]
        new = np.append(True, tag[1:] != tag[:-1])
        other = np.append(False, ~new[1:] & ((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        group = np.cumsum(new) - 1
        shared = (np.bincount(group, weights=other) > 0)[group]
        hot = np.unique(tag[new & (np.bincount(group, weights=texts)[group] >= HOT)] % np.uint64(HOT_BITS)).astype("<u4")
        bits = [(0, BITS, b"", b"", b"", b"", hot.tobytes(), b"")] if len(hot) else []
        return pa.concat_tables([done, pa.Table.from_batches([_batch([*_places(q, doc[shared], th[shared], pos[shared]), *bits])])])

    return run


class _Places:
    """Places (and windows) in the rows of a documents' partition, by document."""

    def __init__(self, table: pa.Table, kinds: tuple[int, ...]):
        doc, th, pos, mask = [], [], [], []
        for r in table.to_pylist():
            if r["kind"] in kinds:
                d, t = _unrun(r["keys"], r["counts"])
                doc.append(d), th.append(t), pos.append(_whole(r["low"], r["high"]))
                mask.append(np.frombuffer(r["a"], dtype="<u8") if r["kind"] == WINDOWS else np.zeros(len(d), dtype=np.uint64))
        if not doc:
            self.at, self.pos, self.mask = {}, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint64)
            return
        doc, th, pos, mask = (np.concatenate(x) for x in (doc, th, pos, mask))
        o = np.lexsort((pos, th, doc))
        doc, th, self.pos, self.mask = doc[o], th[o], pos[o], mask[o]
        starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        ends = np.append(starts[1:], len(doc))
        self.at = {(d, t): (a, b) for d, t, a, b in zip(doc[starts].tolist(), th[starts].tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def get(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(key, (0, 0))
        return self.pos[a:b], self.mask[a:b]


def hot_bits(shared: DataFrame) -> np.ndarray:
    """The bits of hot anchors, as HOT_BITS / 64 words: no more rows than that come to the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4")
            words, inverse = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], ["w", "v"])

    table = shared.where(f"kind = {BITS}").select("a").mapInArrow(split, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(HOT_BITS // 64, dtype=np.int64)
    out[table["w"].to_numpy()] = table["v"].to_numpy()
    return out.view(np.uint64)


def _context_rows(p: int, q: int, hot):
    def run(texts: pa.Table, places: pa.Table) -> pa.Table:
        wanted = _Places(places, (PLACES,))
        known: set[tuple[int, int]] = set()
        bufs, parts, at = [], [], 0
        for doc, text in zip(texts["id"].to_pylist(), texts["t"], strict=True):
            t = text.as_buffer().to_pybytes()
            key = (doc, zlib.crc32(t))
            if key not in wanted.at or key in known:
                continue
            known.add(key)
            pos = np.unique(wanted.get(key)[0])
            pos = pos[pos != WHOLE].astype(np.int64)
            if len(pos):
                bufs.append(b"\0" * SIDE + t + b"\0" * SIDE)
                parts.append((np.full(len(pos), doc, dtype=np.int64), np.full(len(pos), key[1], dtype=np.uint32), pos, pos + at + SIDE, np.minimum(pos, SIDE), np.minimum(len(t) - pos - GRAM, SIDE)))
                at += len(bufs[-1])
        if not parts:
            return pa.Table.from_batches([_batch([])])
        data = np.frombuffer(b"".join(bufs), dtype=np.uint8)
        doc, th, pos, where, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        ctx = np.lib.stride_tricks.sliding_window_view(data, GRAM + 2 * SIDE)[where - SIDE]
        whole = np.ascontiguousarray(np.concatenate([ctx, before.astype(np.uint8)[:, None], after.astype(np.uint8)[:, None]], axis=1))
        gram = np.ascontiguousarray(ctx[:, SIDE : SIDE + GRAM]).view("<u8")
        route = (_bytes.mix(gram[:, 0] * np.uint64(3) + _bytes.mix(gram[:, 1])) % np.uint64(p)).astype(np.int32)
        bit = (gram_hash(ctx[:, SIDE : SIDE + GRAM]) % np.uint64(HOT_BITS)).astype(np.int64)
        warm = (hot.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        # equal contexts: the smallest id goes on, and those of larger ids are wholly repeated
        o = np.argsort(doc, kind="stable")
        _, first, inverse = np.unique(whole[o].view(np.dtype((np.void, whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
        head = o[first[inverse.ravel()]]
        out = []
        rest = o[doc[head] < doc[o]]
        bits = np.arange(SIDE + 1)
        mask = (((before[rest, None] >= bits) & (after[rest, None] >= SIDE - bits)).astype(np.uint64) << bits.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        out += _windows(q, doc[rest], th[rest], pos[rest].astype(np.uint32), mask)
        go = np.sort(o[doc[head] == doc[o]])
        out += _single_rows(p, q, go[warm[go]], doc, th, pos, ctx, before, after)
        go = go[~warm[go]]
        for v, rows in _split(route[go]):
            r = go[rows]
            out.append((v, CONTEXTS, *_runs(doc[r], th[r]), *_halves(pos[r].astype(np.uint32)), zstandard.compress(np.ascontiguousarray(ctx[r]).tobytes(), 3), np.stack([before[r], after[r]], axis=1).astype(np.uint8).tobytes()))
        return pa.Table.from_batches([_batch(out)])

    return run


def _single_rows(p: int, q: int, rows: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, ctx: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple]:
    """Windows of hot anchors: of equal ones those of larger ids are settled here, and those of the smallest go where the window's bytes say."""
    out = []
    for t in range(SIDE + 1):
        r = rows[(before[rows] >= t) & (after[rows] >= SIDE - t)]
        if not len(r):
            continue
        r = r[np.argsort(doc[r], kind="stable")]
        window = np.ascontiguousarray(ctx[r, SIDE - t : SIDE - t + LENGTH])
        _, first, inverse = np.unique(window.view(np.dtype((np.void, LENGTH))).ravel(), return_index=True, return_inverse=True)
        later = doc[r[first]][inverse.ravel()] < doc[r]
        gone = r[later]
        out += _windows(q, doc[gone], th[gone], pos[gone].astype(np.uint32), np.full(len(gone), 1 << t, dtype=np.uint64))
        r, window = r[~later], window[~later]
        key = np.ascontiguousarray(window[:, -8:]).view("<u8")[:, 0]
        for k in range(0, LENGTH - 8, 8):
            key = _bytes.mix(key * np.uint64(3) + np.ascontiguousarray(window[:, k : k + 8]).view("<u8")[:, 0])
        for v, at in _split((key % np.uint64(p)).astype(np.int32)):
            x = r[at]
            out.append((v, SINGLES, *_runs(doc[x], th[x]), *_halves(pos[x].astype(np.uint32)), zstandard.compress(window[at].tobytes(), 3), np.full(len(x), t, dtype=np.uint8).tobytes()))
    return out


def _windows(q: int, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> Iterator[tuple]:
    some = mask > 0
    doc, th, pos, mask = doc[some], th[some], pos[some], mask[some]
    o = np.lexsort((pos, th, doc))
    doc, th, pos, mask = doc[o], th[o], pos[o], mask[o]
    for v, at in _split(bucket_of(doc, th, q)):
        yield (v, WINDOWS, *_runs(doc[at], th[at]), *_halves(pos[at]), mask[at].astype("<u8").tobytes(), b"")


def _single_windows(q: int, rows: list[dict]) -> list[tuple]:
    """Of single windows, those that a smaller id has too."""
    if not rows:
        return []
    parts = [(*_unrun(r["keys"], r["counts"]), _whole(r["low"], r["high"]), np.frombuffer(zstandard.decompress(r["a"]), dtype=np.uint8).reshape(-1, LENGTH), np.frombuffer(r["b"], dtype=np.uint8)) for r in rows]
    doc, th, pos, window, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.argsort(doc, kind="stable")
    doc, th, pos, t = doc[o], th[o], pos[o], t[o]
    _, first, inverse = np.unique(np.ascontiguousarray(window[o]).view(np.dtype((np.void, LENGTH))).ravel(), return_index=True, return_inverse=True)
    mask = np.where(doc[first][inverse.ravel()] < doc, np.uint64(1) << t.astype(np.uint64), np.uint64(0))
    return list(_windows(q, doc, th, pos, mask))


def _found_windows(q: int):
    def run(table: pa.Table) -> pa.Table:
        done, rows = _parted(table, CONTEXTS)
        done, singles = _parted(done, SINGLES)
        out = [done, pa.Table.from_batches([_batch(_single_windows(q, singles))])]
        if rows:
            parts = [(*_unrun(r["keys"], r["counts"]), _whole(r["low"], r["high"]), np.frombuffer(zstandard.decompress(r["a"]), dtype=np.uint8).reshape(-1, GRAM + 2 * SIDE), np.frombuffer(r["b"], dtype=np.uint8).reshape(-1, 2)) for r in rows]
            doc, th, pos, ctx, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask = earlier(ctx[:, SIDE : SIDE + GRAM], ctx[:, SIDE - 1 :: -1] if SIDE else ctx[:, :0], ctx[:, SIDE + GRAM :], sizes[:, 0].astype(int), sizes[:, 1].astype(int), doc)
            out.append(pa.Table.from_batches([_batch(list(_windows(q, doc, th, pos, mask)))]))
        return pa.concat_tables(out)

    return run


def removed_runs(starts: np.ndarray) -> np.ndarray:
    """(k, 2) maximal runs covered by windows that start at the sorted places."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + LENGTH)
    return np.stack([starts[new], starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + LENGTH], axis=1)


def _cut_texts(texts: pa.Table, found: pa.Table) -> pa.Table:
    by = _Places(found, (PLACES, WINDOWS))
    bits = np.arange(SIDE + 1, dtype=np.uint64)
    ids, size, gone, spans, shas, kept_texts = [], [], [], [], [], []
    for doc, text in zip(texts["id"].to_pylist(), texts["t"], strict=True):
        t = text.as_buffer().to_pybytes()
        pos, mask = by.get((doc, zlib.crc32(t)))
        if len(pos) and pos[-1] == WHOLE:  # places rise
            runs = np.array([[0, len(t)]])
        else:
            pos, mask = pos[mask > 0], mask[mask > 0]
            row, back = np.nonzero((mask[:, None] >> bits) & np.uint64(1))
            runs = removed_runs(np.unique(pos[row].astype(np.int64) - back))
        keep, at = [], 0
        for a, b in runs.tolist():
            keep.append(t[at:a])
            at = b
        keep.append(t[at:])
        left = b"".join(keep)
        ids.append(doc), size.append(len(t)), gone.append(len(t) - len(left)), spans.append(len(runs)), shas.append(hashlib.sha256(left).hexdigest()), kept_texts.append(left)
    return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry_bytes: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_bytes``, what is left, if asked for).

    Ids are integers; a null id counts as larger than all others and comes back as null. A null text is empty. Rows with
    the same id don't take from each other, nor do two places of one document; equal rows get equal results. Texts
    shorter than 50 bytes lose nothing. What is cut may split a character: the rest is bytes. Extra columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(int(LAST))).alias("id"), text_of(docs, text_col).alias("t"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    p, q = 1 + total // ANCHOR_BYTES, 1 + total // TEXT_BYTES

    def places() -> DataFrame:
        return rows.mapInArrow(_anchor_rows(p, q), _BLOB).groupBy("route").applyInArrow(_shared_places(p, q), _BLOB)

    shared = cut(places())
    hot = spark.sparkContext.broadcast(hot_bits(shared))
    shared = shared.where(f"kind <> {BITS}")
    route = F.pmod(F.xxhash64("id").bitwiseXOR(F.crc32(F.col("t").cast("binary"))), F.lit(q)).cast("int")

    def keyed() -> DataFrame:
        return rows.withColumn("route", route).groupBy("route")

    sent = keyed().cogroup(shared.groupBy("route")).applyInArrow(_context_rows(p, q, hot), _BLOB)
    found = cut(sent.groupBy("route").applyInArrow(_found_windows(q), _BLOB))
    hot.destroy()
    whole = shared.unionByName(found)
    out = keyed().cogroup(whole.groupBy("route")).applyInArrow(_cut_texts, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    named = F.when(F.col("id") != int(LAST), F.col("id")).alias(id_col)
    return out.select(named, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if carry_bytes else []))
