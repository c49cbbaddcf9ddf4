"""Repeated substrings across documents, by enhanced suffix arrays.

Sorting every suffix of a corpus needs many times its bytes, so suffixes are sampled: of each window of `length` bytes the
`K`-byte string with the least hash is its anchor. Equal windows have equal anchors at the same place, so every
repeat of at least `length` bytes shows up as anchors with equal context. Suffixes that start at anchors, dealt by
the anchor's hash, keep all suffixes with a common prefix together.

1. Anchors: each task sends the distinct hashes of its documents, 6 bytes each, dealt by hash. A hash that two documents
   have is shared. Hashes only choose candidates; text decides.
2. Contexts: of shared anchors, the bytes of the windows they stand for go to the hash's task. A context that several
   documents of one part have goes once, with the smallest id; the others are settled at once.
3. Enhanced suffix array: in each task the suffixes from the anchors are sorted, with the lengths of common prefixes
   of neighbours and of their common left extensions. A stack scan over the prefix lengths gives the tree of common-prefix intervals. In each interval the left extensions are
   tested: where they differ, the interval's members are sorted by their reversed left contexts and a second scan gives
   the intervals of common left context. Each pair of a right and a left interval that cannot be
   extended for all its members is a maximal repeat (within its context), with all its occurrences.
4. A byte goes if a repeat of at least `length` bytes covers it and some occurrence is in a document with a smaller id.
   Spans are joined for each document, and the bytes that remain are hashed.

A task can't send a blob to each of very many buckets: at 100 TB these are some 800,000, and of 16 MB of text each would get one or two hashes. Where there are more
than FAN of them, blobs go to about as many groups of buckets as their square root first, and are put together and cut again by bucket there; the results are the same.

Documents are dealt by the hash of their id and text, so that rows without an id or of one id are dealt too, into parts of some PART bytes, so their number grows with the table, and travel compressed, twice. Long documents are taken apart in blocks, so work arrays stay small.

Defined cases: a null or empty text has no bytes and loses none. Texts under `length` bytes stay. Ids are whole numbers; null ids are neither
sources nor cut. Rows that repeat an id are alike: none of them is a source for the others. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import n_parts, text_bytes, text_or_empty

LENGTH, K = 50, 24
NULL_ID = -(1 << 63)
MULT = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 16
#: Bytes of text in a part
PART = 128 << 20
#: Buckets that a task sends blobs to, and bytes that are put together before they are cut by bucket
FAN, HELD = 1024, 16 << 20
#: First bytes of blobs of settled spans and of contexts
SPANS, CONTEXTS = b"\0", b"\1"
_POWERS: list[np.ndarray] = []
U = np.uint64


# ---- anchors ---------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours."""
    r, d = x, 1
    while 2 * d <= w:
        r, d = f(r[:-d], r[d:]), 2 * d
    n = len(x) - w + 1
    return f(r[:n], r[w - d : w - d + n]) if d < w else r


def _hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A 48-bit hash of every k bytes, from prefix sums of a polynomial."""
    if not _POWERS or len(_POWERS[0]) < len(a):
        _POWERS[:] = [np.cumprod(np.full(max(len(a), 2 * BLOCK), m, U)) for m in (MULT, pow(MULT, -1, 1 << 64))]
    up, down = _POWERS
    c = np.zeros(len(a) + 1, U)
    np.cumsum(TABLE[a] * up[: len(a)], out=c[1:])
    h = (c[k:] - c[:-k]) * down[: len(a) - k + 1]
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    return h >> U(16)


def _blocks(a: np.ndarray, length: int, k: int):
    """For each block of windows of a text: its place, the hashes, and the places of the anchors in it."""
    w, n = length - k + 1, len(a) - length + 1
    pad = np.zeros(w - 1, U)
    for at in range(0, max(n, 0), BLOCK):
        h = _hashes(a[at : min(len(a), at + BLOCK + length - 1)], k)
        low = _slide(h, w, np.minimum)
        yield at, h, np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == h)


def anchor_hashes(a: np.ndarray, length: int, k: int) -> np.ndarray:
    found = [h[p] for _, h, p in _blocks(a, length, k)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, U)


def anchor_windows(a: np.ndarray, shared: np.ndarray, length: int, k: int):
    """(anchor, first window, last window, hash) of the anchors with a hash in the sorted array shared."""
    w, out = length - k + 1, []
    for at, h, p in _blocks(a, length, k):
        p = p[shared[np.minimum(np.searchsorted(shared, h[p]), len(shared) - 1)] == h[p]] if len(shared) else p[:0]
        # its windows are those in which no hash is smaller; ties give a window several anchors
        first, last = np.maximum(p - w + 1, 0), np.minimum(p, len(h) - w)
        for way in (-1, 1):
            live = np.arange(len(p))
            for d in range(1, w):
                q = p[live] + way * d
                live, q = live[ok := (q >= 0) & (q < len(h))], q[ok]
                hit = h[q] < h[p[live]]
                if way < 0:
                    first[live[hit]] = np.maximum(first[live[hit]], q[hit] + 1)
                else:
                    last[live[hit]] = np.minimum(last[live[hit]], q[hit] - w)
                live = live[~hit]
        out.append((p + at, first + at, last + at, h[p]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)


# ---- contexts: right bytes, left bytes backwards, and their numbers, padded to whole words ------------------------


def _row(length: int, k: int) -> int:
    return -(-(length + (length - k) + 2) // 8) * 8


def contexts(a: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, k: int) -> np.ndarray:
    side = length - k
    out = np.zeros((len(p), _row(length, k)), np.uint8)
    right_n, left_n = last + length - p, p - first
    padded = np.concatenate([np.zeros(side, np.uint8), a, np.zeros(length, np.uint8)])
    for at, n, start, way in ((0, length, p + side, 1), (length, side, p + side - 1, -1)):
        step = np.arange(n)
        got = padded[start[:, None] + way * step]
        got[step >= (right_n if way > 0 else left_n)[:, None]] = 0
        out[:, at : at + n] = got
    out[:, length + side], out[:, length + side + 1] = right_n, left_n
    return out


def classes(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows put so that equal ones are neighbours, and where each class of equal rows starts."""
    words = ctx.view(U)
    h = np.zeros(len(words), U)
    for col in words.T:
        h = (h ^ col) * U(MULT)
        h ^= h >> U(29)
    order = np.argsort(h, kind="stable")
    same = (h[order[1:]] == h[order[:-1]]) & (words[order[1:]] == words[order[:-1]]).all(axis=1)
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)


# ---- enhanced suffix array -----------------------------------------------------------------------------------------


def _words(m: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian words, last first, as lexsort takes them: sorting by them sorts the bytes."""
    padded = np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))
    return list(padded.view(">u8").astype(U).T[::-1])


def _common(m: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows x and y."""
    differ = m[x] != m[y]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(n, np.minimum(size[x], size[y]).astype(np.int64))


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(prefix length, first, last) of the inner nodes of the common-prefix interval tree, by a stack scan.

    lcp[i] is the length of the common prefix of suffixes i and i + 1.
    """
    out, stack = [], []
    for i, n in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > n:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, first))
    return out


def maximal_groups(ctx: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least `length` bytes among the distinct context rows.

    Returns members (row numbers), where each group starts in them, and each group's right and left length.
    """
    side = length - k
    keep = np.arange(len(ctx))
    for last in (False, True):
        right, left = ctx[keep, :length], ctx[keep, length : length + side]
        right_n, left_n = ctx[keep, length + side], ctx[keep, length + side + 1]
        order = np.lexsort([right_n, *_words(right)])
        r = _common(right, right_n, order[:-1], order[1:])
        family = np.empty(len(order), np.int64)
        family[order] = np.cumsum(np.concatenate([[0], r < k]))[: len(order)]
        by_left = np.lexsort([left_n, *_words(left), family])
        l = np.where(family[by_left[:-1]] == family[by_left[1:]], _common(left, left_n, by_left[:-1], by_left[1:]), -1)
        if not last and len(keep):  # rows that reach the length with no other one leave the array
            best_r, best_l = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
            for best, o, n in ((best_r, order, r), (best_l, by_left, l)):
                best[o] = np.maximum(np.concatenate([[0], n]), np.concatenate([n, [0]]))
            keep = keep[best_r + best_l >= length]
    left_rank = np.empty(len(keep), np.int64)
    left_rank[by_left] = np.arange(len(keep))
    ll = _common(left, left_n, order[:-1], order[1:])
    found: tuple[list, ...] = ([], [], [], [])
    size = 0

    def add(rows, starts, rights, lefts):
        nonlocal size
        for out, x in zip(found, (rows, np.asarray(starts) + size, rights, lefts)):
            out.append(np.asarray(x, np.int64))
        size += len(rows)

    cuts = np.flatnonzero(np.concatenate([[True], r < k, [True]])) if len(keep) else np.zeros(1, np.int64)
    pairs = cuts[:-1][np.diff(cuts) == 2]
    pairs = pairs[r[pairs] + ll[pairs] >= length]
    add(np.stack([order[pairs], order[pairs + 1]], axis=1).ravel(), 2 * np.arange(len(pairs)), r[pairs], ll[pairs])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < 3:
            continue
        rows, lcp = order[a:b], r[a : b - 1]
        rank, back = left_rank[rows], l
        for depth, i, j in intervals(lcp.tolist()):
            own = rank[i : j + 1]
            inner = np.argsort(own)
            lined = own[inner]
            # common left extensions of neighbours in left order: least over the stretch of the whole left array
            lcs = [int(back[x]) if y == x + 1 else int(back[x:y].min()) for x, y in zip(lined[:-1].tolist(), lined[1:].tolist())]
            if max(lcs) + depth < length:
                continue
            for extent, x, y in intervals(lcs):
                if extent + depth < length:
                    continue
                places = inner[x : y + 1]
                low, high = int(places.min()) + i, int(places.max()) + i
                if int(lcp[low:high].min()) == depth:  # else all its members go on alike to the right
                    add(rows[places + i], [0], [depth], [extent])
    members, starts, rights, lefts = (np.concatenate(x) for x in found)
    return keep[members], starts, rights, lefts


# ---- blobs: arrays of equal length as compressed byte planes -------------------------------------------------------


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    n = len(arrays[0])
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(n, -1) for x in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join([n.to_bytes(8, "little"), *(p.tobytes() if p.shape[1] > 8 else np.ascontiguousarray(p.T).tobytes() for p in planes)]))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """kinds: types, or the number of bytes in a row of a matrix."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = int(raw[:8].view(U)[0]), 8, []
    for kind in kinds:
        w = kind if isinstance(kind, int) else np.dtype(kind).itemsize
        part = raw[at : at + n * w]
        out.append(part.reshape(n, w) if isinstance(kind, int) else np.ascontiguousarray(part.reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def _gather(blobs, *kinds) -> list[np.ndarray]:
    got = [_unpack(b, *kinds) for b in blobs]
    return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros((0, k), np.uint8) if isinstance(k, int) else np.zeros(0, k) for k in kinds]


def _split(key: np.ndarray, *arrays: np.ndarray):
    """(key, arrays) for each value of key."""
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else []
    for rows in np.split(order, cut[1:]) if len(key) else []:
        yield int(key[rows[0]]), [x[rows] for x in arrays]


def _runs(batch: pa.RecordBatch, limit: int = 1 << 24):
    """(doc_ids, parts, texts) of some 16 MB of text at a time."""
    ids, parts = np.asarray(batch.column(0).fill_null(NULL_ID)), np.asarray(batch.column(1))
    at, texts, size = 0, [], 0
    for k, t in enumerate(batch.column(2)):
        texts.append(t.as_py().encode())
        size += len(texts[-1])
        if size >= limit or k == batch.num_rows - 1:
            yield ids[at : k + 1], parts[at : k + 1], texts
            at, texts, size = k + 1, [], 0


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["key", "blob"])


def _merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each owner with touching and overlapping ones joined."""
    order = np.lexsort([start, owner])
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    step = np.int64(max(int(end.max()), 1)) + 1
    group = np.cumsum(np.concatenate([[0], np.diff(owner) != 0]))
    reach = np.maximum.accumulate(end + group * step) - group * step
    new = np.concatenate([[True], (np.diff(owner) != 0) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return owner[at], start[at], reach[np.append(at[1:], len(owner)) - 1]


# ---- steps ---------------------------------------------------------------------------------------------------------


def _send_hashes(buckets: int, length: int, k: int, size: int = 1):
    """Step 1: (bucket, blob of part, hash, many): each distinct hash and part; many if two documents here have the hash."""

    def run(batches):
        for b in batches:
            for ids, parts, texts in _runs(b):
                own = [anchor_hashes(np.frombuffer(t, np.uint8), length, k) if i != NULL_ID else np.zeros(0, U) for i, t in zip(ids.tolist(), texts)]
                h, part = np.concatenate(own), np.repeat(parts, [len(x) for x in own]).astype(np.uint32)
                order = np.lexsort([part, h])
                h, part = h[order], part[order]
                new = np.concatenate([[True], np.diff(h) != 0]) if len(h) else np.zeros(0, bool)
                many = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1] > 1
                first = new | np.concatenate([[True], np.diff(part) != 0]) if len(h) else new
                h, part, many = h[first], part[first], many[first].astype(np.uint8)
                order = np.argsort(part, kind="stable")
                h, part, many = h[order], part[order], many[order]
                yield _rows(_group(_split((h % U(buckets)).astype(np.int64), part, h, many), size))

    return run


def group_size(n: int, fan: int) -> int:
    """Buckets in a group: one where n of them are few enough to be sent to."""
    return 1 if n <= fan else int(np.ceil(np.sqrt(n)))


def _group(pairs, size: int, mark: bytes = b"", level: int = 1) -> list[tuple[int, bytes]]:
    """(group, blob of keys and arrays after a mark) from (key, arrays): all that goes to one group of keys in one blob; of groups of one the keys are left out."""
    if size == 1:
        return [(key, mark + _pack(*x, level=level)) for key, x in pairs]
    out: dict[int, list] = {}
    for key, x in pairs:
        out.setdefault(key // size, []).append([np.full(len(x[0]), key, np.uint32), *x])
    return [(g, mark + _pack(*(np.concatenate(a) for a in zip(*own)), level=level)) for g, own in out.items()]


def _regroup(kinds: dict[bytes, tuple], held: int = HELD):
    """Blobs that _group made, sorted by group: put together up to `held` bytes and cut by key. kinds: the arrays after each mark."""

    def cut(blobs):
        pairs = []
        for mark, own in kinds.items():
            mine = [b[len(mark) :] for b in blobs if b.startswith(mark)]
            if mine:
                key, *arrays = _gather(mine, np.uint32, *own)
                pairs += _group(_split(key.astype(np.int64), *arrays), 1, mark)
        return _rows(pairs)

    def run(batches):
        now, blobs, size = None, [], 0
        for b in batches:
            for group, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blobs and (group != now or size > held):
                    yield cut(blobs)
                    blobs, size = [], 0
                now, size = group, size + len(blob)
                blobs.append(blob)
        if blobs:
            yield cut(blobs)

    return run


def _to_keys(blobs: DataFrame, kinds: dict[bytes, tuple], size: int) -> DataFrame:
    """(key, blob) of grouped blobs; a group's blobs are dealt over as many tasks as it has keys."""
    if size == 1:
        return blobs
    deal = F.pmod(F.xxhash64("blob"), F.lit(size)).cast("int")
    return blobs.repartition("key", deal).sortWithinPartitions("key").mapInArrow(_regroup(kinds), "key int, blob binary")


def _share(size: int):
    """Function of a bucket's blobs: (part, or group of parts, blob of its shared hashes)."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(_group(_shared(table), size))])

    return run


def _shared(table: pa.Table):
    part, h, many = _gather(table.column("blob").to_pylist(), np.uint32, U, np.uint8)
    order = np.argsort(h, kind="stable")
    h, part, many = h[order], part[order], many[order]
    start = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(h)))
    shared = np.repeat((n > 1) | (np.maximum.reduceat(many, start) > 0), n) if len(h) else many.astype(bool)
    for key, x in _split(part[shared].astype(np.int64), h[shared]):
        yield key, [np.unique(x[0])]


def _send_texts():
    """(part, blob of documents)"""

    def run(batches):
        for b in batches:
            for ids, parts, texts in _runs(b):
                pairs = []
                for key, (rows,) in _split(parts.astype(np.int64), np.arange(len(ids))):
                    own = [texts[i] for i in rows]
                    head = np.stack([ids[rows], np.array([len(t) for t in own], np.int64)]).astype("<i8")
                    pairs.append((key, zstandard.ZstdCompressor(level=3).compress(b"".join([len(own).to_bytes(8, "little"), head.tobytes(), *own]))))
                yield _rows(pairs)

    return run


def _documents(blobs) -> list[tuple[int, bytes]]:
    """A part's documents, in an order that is the same each time."""
    out = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        ids, sizes = np.frombuffer(raw, "<i8", 2 * n, at).reshape(2, n).tolist()
        at += 16 * n
        for i, size in zip(ids, sizes):
            out.append((i, raw[at : at + size]))
            at += size
    return sorted(out)


def _send_contexts(buckets: int, length: int, k: int, settle: bool, size: int = 1):
    """Step 2: (bucket, or group of buckets, blob): settled spans after a byte 0, contexts of shared anchors after a byte 1."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        shared = np.sort(_gather(right.column("blob").to_pylist(), U)[0])
        part, got = key[0].as_py(), []
        if len(shared):
            for row, (i, text) in enumerate(_documents(left.column("blob").to_pylist())):
                if i != NULL_ID and len(text) >= length:
                    a = np.frombuffer(text, np.uint8)
                    p, first, last, h = anchor_windows(a, shared, length, k)
                    got.append((np.full(len(p), i), np.full(len(p), row, np.uint32), p, first, last, h, contexts(a, p, first, last, length, k)))
        pairs = []
        if got:
            doc, row, p, first, last, h, ctx = (np.concatenate(x) for x in zip(*got))
            stay = np.ones(len(doc), bool)
            if settle:
                order, starts = classes(ctx)
                if len(order):
                    least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
                    stay[order] = doc[order] == least
                span = _merge(row[~stay], first[~stay], last[~stay] + length)
                if len(span[0]):
                    pairs += _group([(part % buckets, [np.full(len(span[0]), part, np.uint32), *span])], size, SPANS)
            here = np.flatnonzero(stay)
            parts = np.full(len(here), part, np.uint32)
            pairs += _group(_split((h[here] % U(buckets)).astype(np.int64), parts, doc[here], row[here], p[here], ctx[here]), size, CONTEXTS, 3)
        return pa.Table.from_batches([_rows(pairs)])

    return run


def _groups_here(blobs, length: int, k: int):
    """Steps 3: (part, doc, row, anchor) of the contexts that came, their classes, and the maximal repeats among these."""
    part, doc, row, p, ctx = _gather([b[1:] for b in blobs if b.startswith(CONTEXTS)], np.uint32, np.int64, np.uint32, np.int64, _row(length, k))
    order, starts = classes(ctx)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order)))) if len(order) else 0
    return (part, doc, row, p, ctx), (order, starts, number), maximal_groups(ctx[order[starts]] if len(order) else ctx, length, k)


def _settle(length: int, k: int, size: int = 1):
    """Step 4: (part, or group of parts, blob of row, start, end): spans that an earlier document has too."""
    side = length - k

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        spans = [[x.astype(np.int64) for x in _unpack(b[1:], np.uint32, np.uint32, np.int64, np.int64)] for b in blobs if b.startswith(SPANS)]
        (part, doc, row, p, ctx), (order, starts, number), (members, at, rights, lefts) = _groups_here(blobs, length, k)
        if len(order):
            least = np.minimum.reduceat(doc[order], starts)
            copy = doc > least[number]  # a whole context of a smaller id
            x = np.flatnonzero(copy)
            spans.append([part[x], row[x], p[x] - ctx[x, length + side + 1], p[x] + ctx[x, length + side]])
            if len(members):
                n = np.diff(np.append(at, len(members)))
                later = least[members] > np.repeat(np.minimum.reduceat(least[members], at), n)
                hit, right, left = members[later], np.repeat(rights, n)[later], np.repeat(lefts, n)[later]
                # to the class's rows in its smallest document
                first = np.flatnonzero(~copy)
                first = first[np.argsort(number[first], kind="stable")]
                low, high = np.searchsorted(number[first], hit), np.searchsorted(number[first], hit, side="right")
                each = high - low
                x = first[np.repeat(low - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())] if len(hit) else hit
                spans.append([part[x], row[x], p[x] - np.repeat(left, each), p[x] + np.repeat(right, each)])
        pairs = []
        if spans:
            part, row, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*spans))
            for key, x in _split(part, row, start, end):
                owner, start, end = _merge(*x)
                pairs.append((key, [owner.astype(np.uint32), start, end]))
        return pa.Table.from_batches([_rows(_group(pairs, size))])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 5: a row for each document of a part."""
    row, start, end = _merge(*(x.astype(np.int64) for x in _gather(right.column("blob").to_pylist(), np.uint32, np.int64, np.int64)))
    docs = _documents(left.column("blob").to_pylist())
    cut = np.searchsorted(row, np.arange(len(docs) + 1))
    out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
    for k, (i, text) in enumerate(docs):
        own = list(zip(start[cut[k] : cut[k + 1]].tolist(), end[cut[k] : cut[k + 1]].tolist()))
        digest, at = hashlib.sha256(), 0
        for s, e in own:
            digest.update(text[at:s])
            at = e
        digest.update(text[at:])
        values = (None if i == NULL_ID else i, len(text), sum(e - s for s, e in own), len(own), digest.hexdigest(), [{"start": s, "stop": e} for s, e in own])
        for c, v in zip(out, values):
            out[c].append(v)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({c: pa.array(v, kind if c == "spans" else pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()})


def _dealt(docs: DataFrame, parts: int | None, length: int, k: int, id_col: str, text_col: str, settle: bool, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents' blobs by part, the contexts' blobs by bucket, and how many buckets a group has."""
    parts = parts or max(n_parts(docs.sparkSession), -(-text_bytes(docs, text_col) // PART))
    size, ids, text = group_size(parts, fan), F.col(id_col).cast("long"), text_or_empty(text_col)
    rows = docs.select(ids.alias("doc_id"), F.pmod(F.hash(ids, text), F.lit(parts)).alias("part"), text.alias("text"))
    blobs = "key int, blob binary"
    hashes = _to_keys(rows.mapInArrow(_send_hashes(parts, length, k, size), blobs), {b"": (np.uint32, U, np.uint8)}, size)
    shared = _to_keys(hashes.groupBy("key").applyInArrow(_share(size), blobs), {b"": (U,)}, size)
    texts = rows.mapInArrow(_send_texts(), blobs)
    found = texts.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(_send_contexts(parts, length, k, settle, size), blobs)
    return texts, _to_keys(found, {SPANS: (np.uint32, np.uint32, np.int64, np.int64), CONTEXTS: (np.uint32, np.int64, np.uint32, np.int64, _row(length, k))}, size), size


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = K, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte spans."""
    texts, found, size = _dealt(docs, parts, length, anchor, id_col, text_col, True, fan)
    spans = _to_keys(found.groupBy("key").applyInArrow(_settle(length, anchor, size), "key int, blob binary"), {b"": (np.uint32, np.int64, np.int64)}, size)
    return texts.groupBy("key").cogroup(spans.groupBy("key")).applyInArrow(_cut, RESULT)


def maximal_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = K, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """All occurrences of all maximal repeats: repeat_id (of its bytes), n_bytes, doc_id, start, n_occurrences.

    Repeats are maximal within the context of an anchor, at most 2 * length - anchor bytes: a longer repeat is a chain of overlapping ones.
    """
    side = length - anchor

    def run(table: pa.Table) -> pa.Table:
        (_, doc, _, p, ctx), (order, starts, _), (members, at, rights, lefts) = _groups_here(table.column("blob").to_pylist(), length, anchor)
        size = np.diff(np.append(starts, len(order)))
        groups = [(m, int(r), int(b)) for m, r, b in zip(np.split(members, at[1:]) if len(at) else [], rights, lefts)]
        whole = [x for x in range(len(starts)) if size[x] > 1]  # equal contexts, unless a group has the same rows
        groups += [(np.array([x]), int(ctx[order[starts[x]], length + side]), int(ctx[order[starts[x]], length + side + 1])) for x in whole]
        out: dict[str, list] = {c: [] for c in ("repeat_id", "n_bytes", "doc_id", "start", "n_occurrences")}
        for m, r, b in groups:
            rows = np.concatenate([order[starts[x] : starts[x] + size[x]] for x in m])
            one = ctx[rows[0]]
            name = hashlib.sha256(one[length : length + b][::-1].tobytes() + one[:r].tobytes()).hexdigest()
            for x in rows:
                for c, v in zip(out, (name, r + b, int(doc[x]), int(p[x]) - b, len(rows))):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.string() if c == "repeat_id" else pa.int64()) for c, v in out.items()})

    _, found, _ = _dealt(docs, parts, length, anchor, id_col, text_col, False, fan)
    return found.groupBy("key").applyInArrow(run, "repeat_id string, n_bytes long, doc_id long, start long, n_occurrences long")
