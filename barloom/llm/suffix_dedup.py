"""Operator 4: removal of repeated 50-byte strings by suffix arrays that are built by induced sorting.

Equal windows of 50 bytes must meet in one shard. Each window is anchored at the smallest of the hashes of its 24-byte grams, so
equal windows have equal anchors; consecutive windows with one anchor form a piece (50 to 76 bytes). Pieces whose anchor occurs in
one document alone are dropped. The different pieces that are left are dealt by anchor, and each shard sorts their suffixes. Whole
copies of a text with a smaller doc_id hold nothing that it doesn't hold, and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix, seeds, slices, stored, texts_of, utf8

WINDOW, GRAM = 50, 24
#: Bytes of pieces, and places of pieces, that one suffix array stands for. An anchor in more documents than HOT has its windows
#: compared one by one, and up to so many of such anchors are broadcast.
SHARD_BYTES, SHARD_ROWS, HOT, MOST_HOT = 1 << 20, 200_000, 20_000, 50_000
BUCKETS, SALTS = 8, 16
_LOWEST = -(1 << 63)
_A, _B, _C = seeds(3, 41) | U64(1)


# --- suffix arrays ---------------------------------------------------------------------------------------------------------------


def _smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; equal letters take over from the right. The last (sentinel) is."""
    n = len(s)
    step = np.flatnonzero(s[:-1] != s[1:])
    following = np.searchsorted(step, np.arange(n - 1))
    out = np.ones(n, bool)
    out[:-1] = s[step[following]] < s[step[following] + 1]
    return out


def _induce_by_letter(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Induced sorting with all suffixes of one bucket at a time: for long strings over few letters."""
    counts = np.bincount(s, minlength=k)
    end = np.cumsum(counts)
    begin = end - counts
    sa = np.full(len(s), -1, np.int64)

    def deal(q: np.ndarray, place: np.ndarray, sign: int) -> None:
        letter = s[q]
        order = np.argsort(letter, kind="stable")
        q, letter = q[order], letter[order]
        n = np.bincount(letter, minlength=k)
        within = np.arange(len(q)) - (np.cumsum(n) - n)[letter]
        sa[place[letter] + within if sign > 0 else place[letter] - 1 - within] = q
        place += sign * n

    def before(q: np.ndarray, wanted: bool) -> np.ndarray:
        q = q[q > 0] - 1
        return q[small[q] == wanted]

    letters = s[lms]
    n_lms = np.bincount(letters, minlength=k)
    seeded, at = lms[np.argsort(letters, kind="stable")], np.append(0, np.cumsum(n_lms))
    head, tail = begin.copy(), end.copy()
    for c in np.flatnonzero(counts):
        done = begin[c]
        while done < head[c]:
            q, done = sa[done : head[c]].copy(), head[c]
            if len(q := before(q, False)):
                deal(q, head, 1)
        if n_lms[c] and len(q := before(seeded[at[c] : at[c + 1]], False)):
            deal(q, head, 1)
    for c in np.flatnonzero(counts)[::-1]:
        done = end[c]
        while done > tail[c]:
            q, done = sa[tail[c] : done][::-1].copy(), tail[c]
            if len(q := before(q, True)):
                deal(q, tail, -1)
        if len(q := before(sa[begin[c] : head[c]][::-1], True)):
            deal(q, tail, -1)
    sa[0] = len(s) - 1
    return sa


def _induce_by_suffix(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Induced sorting one suffix at a time: for short strings over many letters."""
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    letters, is_small, n = s.tolist(), small.tolist(), len(s)
    sa = [-1] * n
    tail = ends.tolist()
    for p in reversed(lms.tolist()):
        c = letters[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = (ends - counts).tolist()
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not is_small[p]:
            c = letters[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and is_small[p]:
            c = letters[p]
            tail[c] -= 1
            sa[tail[c]] = p
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Order of the suffixes of s (letters 0 to k - 1; 0 stands at the end alone).

    Suffixes are classified as smaller or larger than their successors; the leftmost-smaller ones split s into substrings, which a
    first induction sorts. Their ranks make a shorter string, which is sorted by recursion unless all ranks differ, and a second
    induction takes the order of all suffixes from there.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _smaller(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_by_letter if n > 64 * k else _induce_by_suffix
    sa = induce(s, small, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]
    number = np.cumsum(is_lms) - 1
    length = np.append(np.diff(lms), 0) + 1  # with the first letter of the next substring
    a, b = ranked[:-1], ranked[1:]
    size = length[number[b]]
    same = length[number[a]] == size
    live = np.flatnonzero(same)
    j = 0
    while len(live):
        same[live[s[a[live] + j] != s[b[live] + j]]] = False
        j += 1
        live = live[same[live] & (size[live] > j)]
    names = np.append(0, np.cumsum(~same))
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ranked]] = names
        ranked = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(s, small, ranked, k)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    n = len(data)
    padded = np.zeros((n // 8 + 2) * 8, np.uint8)
    padded[:n] = data
    out = np.empty(n, U64)
    for j in range(min(8, n)):
        part = out[j::8]
        part[:] = np.frombuffer(padded.data, U64, len(part), j)
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, in text order, how many bytes it shares with its predecessor in sa, at most most."""
    w = words_at(np.append(data, np.zeros(most + 8, np.uint8)))
    before = np.full(len(data), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(data), np.int64)
    live = np.flatnonzero(before >= 0)
    for j in range(0, most, 8):
        apart = w[live + j] ^ w[before[live] + j]
        lowest = apart & (~apart + U64(1))
        out[live] += np.where(apart == 0, 8, (np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64)) >> 3)
        live = live[apart == 0]
    return np.minimum(out, most)


def lowest_holders(pieces: list[bytes], low: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each piece the lowest of low over all pieces that hold the same bytes anywhere; and windows by piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    # UTF-8 has no bytes above 244, so two letters are free: 1 ends a piece, 0 ends the string
    flat = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8) + np.uint8(2)
    sa = suffix_array(flat.astype(np.int64), 247)
    shared = common_prefixes(flat, sa, window)
    starts = np.cumsum(sizes + 1) - sizes - 1
    n_windows = np.maximum(sizes - window + 1, 0)
    whole = np.repeat(starts - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
    owner = np.full(len(flat), -1, np.int64)
    owner[whole] = np.repeat(np.arange(len(pieces)), n_windows)
    order = sa[owner[sa] >= 0]
    if not len(order):
        return np.zeros(0, np.int64), n_windows
    # two whole windows are equal if all common prefixes between them are long: those between stand for the same bytes
    run = np.flatnonzero(np.append(True, shared[order[1:]] < window))
    best = np.minimum.reduceat(low[owner[order]], run)
    out = np.empty(len(flat), np.int64)
    out[order] = np.repeat(best, np.diff(np.append(run, len(order))))
    return out[whole], n_windows


# --- pieces ----------------------------------------------------------------------------------------------------------------------


def anchored(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes of the pieces, last bytes plus one, and their anchors (48-bit hashes). Windows don't cross rows."""
    n, span = len(data), window - gram + 1
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = words_at(data)
    h = w[: n - gram + 1] * _A
    for j in (*range(8, gram - 7, 8), gram - 8)[: -(-gram // 8) - 1]:
        h ^= h >> U64(29)
        h += w[j : j + len(h)]
        h *= _B
    h ^= h >> U64(32)
    h *= _C
    h ^= h >> U64(29)
    # the smallest of span hashes, the leftmost of equal ones: minima from the left and from the right within blocks
    bits = max(20, int(n).bit_length())
    keyed = np.full(-(-n // span) * span + span, ~U64(0), U64)
    keyed[: len(h)] = (h >> U64(bits) << U64(bits)) | np.arange(len(h), dtype=U64)
    blocks = keyed.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - window + 1
    place = (np.minimum(right[:m], left[span - 1 : span - 1 + m]) & U64((1 << bits) - 1)).astype(np.int64)
    ok = np.ones(m, bool)
    for e in offsets[1:-1].tolist():  # windows that would reach over an end
        ok[max(0, e - window + 1) : e] = False
    fresh = ok.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    final = ok.copy()
    final[:-1] &= (place[1:] != place[:-1]) | ~ok[1:]
    starts = np.flatnonzero(fresh)
    return starts, np.flatnonzero(final) + window, h[place[starts]] >> U64(16)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the one exchange that they go through."""
    for batch in batches:
        for s in slices(batch):
            data, offsets = utf8(s.column("text"))
            whole = memoryview(np.ascontiguousarray(data))
            packed = [pa.compress(whole[a:b], "zstd", asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("k"), s.column("row"), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], ["doc_id", "k", "row", "n", "packed"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch with the bytes of their texts, and where each begins; memory follows the sizes of the texts."""
    sizes = batch.column("n").to_numpy()
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 256]), 1 << 20, "right")))
        s = batch.slice(start, end - start)
        texts = [pa.decompress(p.as_buffer(), n, "zstd", asbytes=True) for p, n in zip(s.column("packed"), sizes[start:end].tolist(), strict=True)]
        yield s, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes[start:end])])
        start = end


def _marks(n_buckets: int):
    """Anchors of slices of documents, in blocks for each bucket of anchors.

    An entry of data is an anchor (48 bits) and the place in ks of the only document of the slice that holds it (16 bits), or 65535
    where several do. Those are known to share it: their pairs go along in known_k and known_m, in any block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for s, data, offsets in _unpacked(batch):
                starts, _, m = anchored(data, offsets)
                if not len(starts):
                    continue
                k = s.column("k").to_numpy()[np.searchsorted(offsets, starts, "right") - 1]
                ks, place = np.unique(k, return_inverse=True)
                both = np.unique(m | place.astype(U64) << U64(48))
                m, place = both & U64((1 << 48) - 1), both >> U64(48)
                order = np.argsort(m, kind="stable")
                m, place = m[order], place[order]
                group = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                n = np.diff(np.append(group, len(m)))
                several = np.repeat(n > 1, n)
                known_m, known_k = m[several], ks[place[several].astype(np.int64)]
                m, place = m[group], np.where(n > 1, U64(65535), place[group])
                bucket = ((m >> U64(16)) * U64(n_buckets) >> U64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                turn = (turn + 1) % n_buckets
                blocks, used, mine = [], [], []
                for j in range(n_buckets):
                    a, b = cuts[j], cuts[j + 1]
                    if a < b or j == turn:
                        here, at = np.unique(place[a:b][place[a:b] < 65535], return_inverse=True)
                        entry = place[a:b].copy()
                        entry[entry < 65535] = at.astype(U64)
                        blocks.append((m[a:b] | entry << U64(48)).tobytes())
                        used.append(ks[here.astype(np.int64)])
                        mine.append(j)
                longs = pa.list_(pa.int64())
                at = [known_k if j == turn else [] for j in mine], [known_m.view(np.int64) if j == turn else [] for j in mine]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array(used, longs), pa.array(blocks, pa.binary()), pa.array(at[0], longs), pa.array(at[1], longs)], ["bucket", "ks", "data", "known_k", "known_m"])

    return run


def _by_document(k: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(k, kind="stable")
    k, m = k[order], m[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(k)), pa.int32()), pa.array(m))], ["k", "ms"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks in the order of buckets: documents with those of their anchors that other documents hold as well."""

    def shared(held: list) -> pa.RecordBatch:
        entries = [np.frombuffer(data, U64) for _, data in held]
        m = np.concatenate([e & U64((1 << 48) - 1) for e in entries]).view(np.int64)
        place = [(e >> U64(48)).astype(np.int64) for e in entries]
        told = np.concatenate(place) == 65535
        k = np.concatenate([np.append(ks, 0)[np.minimum(p, len(ks))] for (ks, _), p in zip(held, place, strict=True)])
        order = np.lexsort((k, m))
        m, k, told = m[order], k[order], told[order]
        if not len(m):
            return _by_document(k, m)
        group = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        n = np.diff(np.append(group, len(m)))
        met = np.bitwise_or.reduceat(told, group) | (np.maximum.reduceat(k, group) > np.minimum.reduceat(k, group))
        take = np.repeat(met, n) & ~told
        return _by_document(k[take], m[take])

    held, last = [], None
    for batch in batches:
        lists = [batch.column(c) for c in ("ks", "known_k", "known_m")]
        if len(known := lists[1].flatten()):
            yield _by_document(known.to_numpy(), lists[2].flatten().to_numpy())
        for i, (bucket, data) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True)):
            if bucket != last and held:
                yield shared(held)
                held = []
            last = bucket
            held.append((lists[0][i].values.to_numpy(), data))
    if held:
        yield shared(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (k, row, n, packed, ms) whose anchors are among ms. Of equal ones that follow one another, as in a text of one
    word, the first goes, with the number of the others in more."""
    for batch in batches:
        for s, data, offsets in _unpacked(batch):
            starts, ends, anchor = anchored(data, offsets)
            row = np.searchsorted(offsets, starts, "right") - 1
            ms = s.column("ms")
            holder = np.repeat(np.arange(s.num_rows, dtype=U64), np.diff(ms.offsets.to_numpy()))
            at = np.flatnonzero(np.isin(mix(anchor + row.astype(U64) * _A), mix(ms.flatten().to_numpy().view(U64) + holder * _A)))
            starts, ends, row = starts[at], ends[at], row[at]
            whole = data.tobytes()
            body = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            follows = np.flatnonzero((np.diff(starts) == (ends - starts)[:-1] - WINDOW + 1) & (np.diff(ends - starts) == 0) & (np.diff(row) == 0)) + 1
            follows = follows[[body[i] == body[i - 1] for i in follows.tolist()]] if len(follows) else follows
            first = np.delete(np.arange(len(at)), follows)
            more = np.diff(np.append(first, len(at))) - 1
            cols = [anchor[at].view(np.int64), s.column("k").to_numpy()[row], s.column("row").to_numpy()[row], starts - offsets[row]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in cols], pa.array(more), pa.array([body[i] for i in first.tolist()], pa.binary())], ["m", "k", "row", "start", "more", "body"])


SPANS = ["k", "row", "a", "b"]


def _spans(k: np.ndarray, row: np.ndarray, start: np.ndarray, more: np.ndarray, content: np.ndarray, lows: np.ndarray, n_windows: np.ndarray) -> pa.RecordBatch:
    """Bytes from a to b of documents whose windows a lower document holds. content: the piece at each place; lows: by its windows."""
    begins = np.cumsum(n_windows) - n_windows
    least, most = np.minimum.reduceat(lows, begins), np.maximum.reduceat(lows, begins)
    every = k > most[content]
    out = [np.stack([k[every], row[every], start[every], start[every] + (more[every] + 1) * n_windows[content[every]] - 1 + WINDOW])]
    for i in np.flatnonzero(~every & (k > least[content])).tolist():
        c = content[i]
        gone = np.diff(np.concatenate([[0], (lows[begins[c] : begins[c] + n_windows[c]] < k[i]).astype(np.int8), [0]]))
        each = start[i] + np.arange(more[i] + 1)[:, None] * n_windows[c]
        a, b = ((each + np.flatnonzero(x)).reshape(-1) for x in (gone > 0, gone < 0))
        out.append(np.stack([np.full(len(a), k[i]), np.full(len(a), row[i]), a, b - 1 + WINDOW]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], SPANS)


def _sorted_shards(limit: int):
    """Spans for pieces in the order of m, body and k: one suffix array for so many whole anchors as limit allows."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        m, k, row, start, more = (rows.column(c).to_numpy() for c in ("m", "k", "row", "start", "more"))
        body = rows.column("body").to_pylist()
        new = np.array([True, *[a != b for a, b in zip(body[1:], body[:-1], strict=True)]]) | np.append(True, m[1:] != m[:-1])
        first = np.flatnonzero(new)
        content, low, owner = np.cumsum(new) - 1, k[first], m[first]
        pieces = [body[i] for i in first.tolist()]
        n_windows = np.array([len(p) for p in pieces]) - WINDOW + 1
        # a piece that its anchor has alone is compared with nothing
        alone = np.append(True, owner[1:] != owner[:-1]) & np.append(owner[1:] != owner[:-1], True)
        lows = np.repeat(low, n_windows)
        if not alone.all():
            some = np.flatnonzero(~alone)
            lows[np.repeat(~alone, n_windows)] = lowest_holders([pieces[i] for i in some.tolist()], low[some])[0]
        return _spans(k, row, start, more, content, lows, n_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for batch in batches:
            m = batch.column("m").to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False))
            begin = done = 0
            for i in [*np.flatnonzero(m[1:] != m[:-1]) + 1] if len(m) else []:
                if size + sizes[i - 1] - done >= limit or n + i - begin >= SHARD_ROWS:
                    yield shard([*held, batch.slice(begin, i - begin)])
                    held, size, n, begin, done = [], 0, 0, i, sizes[i - 1]
            if held and len(m) and held[-1].column("m")[-1].as_py() != m[0] and begin == 0 and size >= limit:
                yield shard(held)
                held, size, n = [], 0, 0
            if begin < len(m):
                held.append(batch.slice(begin))
                size, n = size + int(sizes[-1]) - int(done), n + len(m) - int(begin)
        if held:
            yield shard(held)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of pieces on its own."""
    for batch in batches:
        for s in slices(batch, "body"):
            k, row, start, more, body = (s.column(x).to_pylist() for x in ("k", "row", "start", "more", "body"))
            at = [(i, j) for i, b in enumerate(body) for j in range(len(b) - WINDOW + 1)]
            cols = [pa.array([x[i] + j * y for i, j in at], pa.int64()) for x, y in ((k, 0), (row, 0), (start, 1), (more, 0))]
            steps = pa.array([len(body[i]) - WINDOW + 1 for i, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, steps, pa.array([body[i][j : j + WINDOW] for i, j in at], pa.binary())], ["k", "row", "a", "more", "step", "window"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _removed(with_text: bool):
    """Rows (doc_id, k, row, n, packed, found) without the bytes of windows that a lower document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, data, offsets in _unpacked(batch):
                depth = np.zeros(len(data) + 1, np.int64)
                found = s.column("found")
                at = found.flatten()
                owner = np.repeat(np.arange(s.num_rows), np.diff(found.offsets.to_numpy()))
                own = pc.struct_field(at, "row").to_numpy() == s.column("row").to_numpy()[owner]
                for name, step in (("a", 1), ("b", -1)):
                    np.add.at(depth, offsets[owner[own]] + pc.struct_field(at, name).to_numpy()[own], step)
                gone = np.cumsum(depth)[:-1] > 0
                before = np.append(0, np.cumsum(gone))
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1]
                inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
                fresh[inner] = gone[inner]  # a run that ends with one text and one that begins with the next
                runs = np.append(0, np.cumsum(fresh))
                left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cols = [s.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(before[offsets])), pa.array(np.diff(runs[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                text = pa.array([x.decode(errors="replace") for x in left]) if with_text else pa.nulls(len(left), pa.string())
                yield pa.RecordBatch.from_arrays([*cols, text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, with_text: bool = False, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the text left, if with_text).

    Every byte goes that a 50-byte string covers which also starts in a document with a smaller doc_id. Texts are bytes of UTF-8,
    whole; a cut character is replaced in kept only. Null text is empty, a null doc_id is the lowest of all, rows with equal doc_id
    don't count as copies of each other, an empty table gives no row, and other columns are ignored.

    1. Texts are compressed and shuffled once, by document; that exchange serves all steps but the last of them. Copies of a whole
       text (by its length and 128 bits of hashes) lose all of it if it has a window, and are left out from here on.
    2. Anchors by document, packed in blocks of 8 bytes an anchor: one shuffle. An anchor that several documents of a slice hold is
       known as shared at once, so a very common one sends one entry a slice to where it is decided.
    3. Pieces at shared anchors are cut out and dealt by anchor, equal ones side by side.
    4. Suffix arrays over the different pieces of many anchors at a time and their common prefixes give each window's lowest
       document. Anchors in more than hot documents (a passage that very many share) have their windows grouped by their bytes
       instead, with the same result, so that no task gets all of them.
    5. Each text loses the bytes of windows whose lowest document is lower than its own.

    Texts may be of any length.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = texts_of(docs).withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST).cast("long"))).withColumn("row", F.xxhash64("text"))
    # copies: equal texts of a larger k; a group's lowest goes to each of its salts, so that a large one is spread out
    keys = plain.select("k", "row", F.xxhash64("text", F.lit(7)).alias("other"), F.octet_length("text").cast("long").alias("n"))
    groups = keys.groupBy("row", "other", "n").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high")
    groups = groups.select("row", "other", "n", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copied = keys.withColumn("salt", F.pmod(F.hash("k"), F.lit(SALTS))).join(groups, ["row", "other", "n", "salt"]).filter("k > low")
    copies = stored(copied.select("k", "row", "n").distinct(), "copies")
    rows = plain.select("doc_id", "k", "row", "text").mapInArrow(_packed, "doc_id long, k long, row long, n long, packed binary")
    own = rows.join(copies.groupBy("k").agg(F.collect_set("row").alias("copied")), "k", "left").filter("copied is null or not array_contains(copied, row)").drop("copied")
    blocks = own.mapInArrow(_marks(n * BUCKETS), "bucket int, ks array<long>, data binary, known_k array<long>, known_m array<long>")
    shared = blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, "k long, ms array<long>")
    wanted = stored(shared.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("ms"))).alias("ms")), "anchors")
    often = stored(wanted.select(F.explode("ms").alias("m")).groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("m"), "hot-anchors")
    n_often = often.count()
    pieces = own.join(wanted, "k").mapInArrow(_cut, "m long, k long, row long, start long, more long, body binary")
    cold, spans = pieces, "k long, row long, a long, b long"
    if n_often:
        known = F.broadcast(often) if n_often <= MOST_HOT else often
        cold = pieces.join(known, "m", "left_anti")
    found = cold.repartition(n, "m").sortWithinPartitions("m", "body", "k").mapInArrow(_sorted_shards(shard_bytes), spans)
    if n_often:
        windows = pieces.join(known, "m", "left_semi").select("k", "row", "start", "more", "body").mapInArrow(_windows, "k long, row long, a long, more long, step long, window binary")
        lowest = windows.groupBy("window").agg(F.min("k").alias("low"))
        each = F.explode(F.expr("sequence(a, a + more * step, step)")).alias("a")
        found = found.union(windows.join(lowest, "window").filter("low < k").select("k", "row", each).select("k", "row", "a", (F.col("a") + WINDOW).alias("b")))
    found = found.union(copies.filter(F.col("n") >= WINDOW).select("k", "row", F.lit(0).cast("long"), "n"))
    by_row = found.groupBy("k").agg(F.collect_list(F.struct("row", "a", "b")).alias("found"))
    none = F.expr("cast(array() as array<struct<row: bigint, a: bigint, b: bigint>>)")
    return rows.join(by_row, "k", "left").withColumn("found", F.coalesce("found", none)).mapInArrow(_removed(with_text), OUT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 50-byte strings leave of documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
