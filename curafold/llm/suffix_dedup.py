"""Removal of byte strings that repeat across documents, by blockwise suffix sorting with a difference cover.

Every window of ``LENGTH`` bytes has an anchor: its smallest hashed gram, the first of equal ones. Equal windows have
equal anchors at equal places, so windows fall into suffix buckets ``(anchor, place of the window before it)``.

1. A filter finds the anchors that occur in two documents; all other windows can't repeat.
2. The windows around such an anchor travel as one context of at most ``2 * LENGTH - GRAM`` bytes; equal contexts of
   a block of documents travel once.
3. Anchors are dealt out, and each task sorts one suffix bucket at a time: first the suffixes at the
   places of a difference cover are ranked once, with the lengths of their common prefixes; a suffix
   is then compared by the few bytes before its next cover place and by the rank there, however long
   the tie. Equal windows get the smallest document they start in.
   The windows of a very frequent anchor are contexts of their own and dealt out by their bytes.
4. The verdicts return to the blocks, which mark and cut the bytes.

Texts are dealt into blocks once; steps 1, 2 and 4 read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curafold.llm.common import chunks, column_bytes, mix64, text_of

LENGTH, GRAM = 50, 18
#: Grams in a window; also the number of places a window can have before its anchor.
PLACES = LENGTH - GRAM + 1
SLOT = LENGTH + PLACES - 1
#: Bytes of text in a block. There are as many parts of anchors as blocks.
BLOCK_BYTES = 8 << 20
#: Bytes that are turned into windows at a time.
PART_BYTES = 512 << 10
#: Contexts whose suffixes are sorted at a time.
SORTED_CONTEXTS = 16_384
#: The windows of an anchor that occurs more often are dealt out one by one, so no anchor is one task's.
HOT_OCCURRENCES = 1 << 16

#: A perfect difference set: any two places have a common distance to members of it.
COVER, PERIOD = (0, 1, 3, 9), 13
TO_COVER = np.array([next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER) for i in range(PERIOD)])
SAMPLED = np.array([p for p in range(PLACES + int(TO_COVER.max())) if p % PERIOD in COVER])

GOLD = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
BASE = 0x5851F42D4C957F2D
SLOT_WORDS = (SLOT + 7) // 8
MIXER = mix64(np.arange(301, 301 + SLOT_WORDS + 2, dtype=np.uint64) * GOLD) | np.uint64(1)
NO_ID = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place, by doubling."""
    step, size, rest = BYTE_VALUE[data], 1, GRAM
    out, done = None, 0
    while rest:
        if rest & 1:
            if out is None:
                out, done = step, size
            else:
                n = len(data) - done - size + 1
                out, done = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + step[done : done + n], done + size
        rest >>= 1
        if rest:
            n = len(step) - size
            step, size = step[:n] * np.uint64(pow(BASE, size, 1 << 64)) + step[size : size + n], 2 * size
    return mix64(out)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, place)`` of the anchor of each window: the smallest hash and its first place, by doubling."""
    low = gram_hashes(data)
    place, size = np.arange(len(low), dtype=np.int32), 1
    while size < PLACES:
        step = min(size, PLACES - size)
        n = len(low) - step
        right = low[step:] < low[:n]
        low, place = np.where(right, low[step:], low[:n]), np.where(right, place[step:], place[:n])
        size += step
    return low, place.astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``(bytes, start, usable)``: parts of the text of a block and which of their windows lie within one row.

    A row over the size of a chunk comes in slices that overlap by a window less one byte.
    """
    for a, b in chunks(offsets, PART_BYTES):
        start, stop = int(offsets[a]), int(offsets[b])
        while stop - start >= LENGTH:
            end = min(stop, start + 2 * PART_BYTES)
            inner = offsets[a + 1 : b] - start  # ends of rows within the part
            usable = np.ones(end - start - LENGTH + 1, bool)
            for k in range(1, LENGTH):
                at = inner - k
                usable[at[(at >= 0) & (at < len(usable))]] = False
            yield data[start:end], start, usable
            if end == stop:
                break
            start = end - LENGTH + 1


def contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(hash, anchor, first window, last window, bytes, start)`` of the runs of windows that share an anchor."""
    for part, start, usable in pieces(data, offsets):
        hashes, place = window_anchors(part)
        new = usable.copy()
        new[1:] &= ~usable[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        ends = np.append(first[1:], len(usable))
        # The last usable window before the next run begins.
        until = np.maximum.accumulate(np.where(usable, np.arange(len(usable)), 0))
        yield hashes[first], place[first], first, until[ends - 1], part, start


def slots(part: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The bytes of contexts, aligned at their anchors; zero where a context has none."""
    at = anchor.astype(np.int32)[:, None] + np.arange(-(PLACES - 1), LENGTH, dtype=np.int32)
    inside = (at >= first[:, None]) & (at < (last + LENGTH)[:, None])
    return np.where(inside, part[np.clip(at, 0, len(part) - 1)], 0).astype(np.uint8)


def fingerprints(rows: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of the bytes of contexts and of the places of their windows."""
    wide = np.zeros((len(rows), SLOT_WORDS * 8), np.uint8)
    wide[:, :SLOT] = rows
    total = (mix64(wide.view(np.uint64)) * MIXER[:SLOT_WORDS]).sum(axis=1, dtype=np.uint64)
    return mix64(total + near.astype(np.uint64) * MIXER[-2] + far.astype(np.uint64) * MIXER[-1])


def part_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(n_parts)).astype(np.int64)


def by_part(parts: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def packed(values: np.ndarray) -> bytes:
    """An array, compressed byte plane by byte plane; ascending hashes go as their differences."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=np.uint64) if kind is np.uint64 else values


def _text(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table.column("body").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    return *column_bytes(column), table.column("place").to_numpy()


def _owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


ANCHORS = "part bigint, block bigint, hashes binary, counts binary"
SHARED = "block bigint, hashes binary, hot binary"
CONTEXTS = "part bigint, block bigint, hashes binary, prints binary, least binary, flags binary, near binary, far binary, bytes binary, size bigint"
VERDICTS = "block bigint, hashes binary, prints binary, least binary, masks binary, hot binary"


def _find_anchors(n_parts: int):
    def find(key: tuple, table: pa.Table) -> pa.Table:
        """The distinct anchors of a block, the logarithm of how often they occur, and whether in two documents."""
        data, offsets, place = _text(table)
        hashes, docs = [], []
        for h, _, first, _, _, start in contexts(data, offsets):
            hashes.append(h)
            docs.append(place[_owners(offsets, first + start)])
        h, d = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *docs])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        counts = np.zeros(0, np.uint8)
        if len(starts):
            several = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)
            counts = np.log2(np.diff(np.append(starts, len(h)))).astype(np.uint8) | (several.astype(np.uint8) << 7)
        h = h[starts]
        rows = [(p, packed(h[at]), packed(counts[at])) for p, at in by_part(part_of(h, n_parts), n_parts)]
        return pa.table({
            "part": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
        })

    return find


def _arrays(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [unpacked(b.as_py(), kind) for b in table.column(name)]


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_arrays(table, name, kind)])


def _share(hot_occurrences: int):
    def share(key: tuple, table: pa.Table) -> pa.Table:
        """The anchors of a part that occur in two documents, for each block that has them. A document is in one block only."""
        each = _arrays(table, "hashes", np.uint64)
        counts = _joined(table, "counts", np.uint8)
        names, back, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        shared = (times > 1) | (np.bincount(back, counts >> 7, len(names)) > 0)
        hot = np.bincount(back, 2.0 ** (1 + (counts & 127)), len(names)) > hot_occurrences
        cuts = np.cumsum([len(h) for h in each])[:-1]
        rows = []
        for block, h, keep, warm in zip(table.column("block").to_pylist(), each, np.split(shared[back], cuts), np.split(hot[back], cuts), strict=True):
            if keep.any():
                rows.append((block, packed(h[keep]), packed(warm[keep])))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), **{n: pa.array([r[i] for r in rows], pa.binary()) for i, n in ((1, "hashes"), (2, "hot"))}})

    return share


def single_windows(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts cut into their windows: the context and the window of each."""
    sizes = last - first + 1
    row = np.repeat(np.arange(len(anchor)), sizes)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def distinct_contexts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One entry for each context ``(hash, print)`` with its smallest document; the flag tells of more than one."""
    h, prints, least, flags = columns[:4]
    order = np.lexsort([least, prints, h])
    h_, p_, d_ = h[order], prints[order], least[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h_[1:] != h_[:-1]) | (p_[1:] != p_[:-1])]))
    if not len(starts):
        return columns
    pick = order[starts]
    out = [c[pick] for c in columns]
    several = (d_[np.append(starts[1:], len(d_)) - 1] > d_[starts]) | (np.maximum.reduceat(flags[order] & 1, starts) > 0)
    out[3] = (out[3] & 2) | several
    return out


def _send_contexts(n_parts: int):
    def send(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        """The distinct contexts around the shared anchors of a block, with the smallest document of each.

        Contexts of a hot anchor go window by window, each dealt out by its own bytes. Flags: 1 for several
        documents, 2 for a window of a hot anchor.
        """
        names = ("part", "block", "hashes", "prints", "least", "flags", "near", "far", "bytes", "size")
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 7, pa.int64())
        wanted, hot = _joined(shared, "hashes", np.uint64), _joined(shared, "hot", bool)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in (np.uint64, np.uint64, np.int64, np.uint8, np.uint8, np.uint8)] + [[np.zeros((0, SLOT), np.uint8)]]
        if len(wanted) and docs.num_rows:
            data, offsets, place = _text(docs)
            for h, anchor, first, last, part, start in contexts(data, offsets):
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                use = wanted[at] == h
                h, anchor, first, last, warm = h[use], anchor[use], first[use], last[use], hot[at[use]]
                row, window = single_windows(anchor[warm], first[warm], last[warm])
                hot_rows = np.flatnonzero(warm)[row]
                cold = ~warm
                h, anchor = np.concatenate([h[cold], h[hot_rows]]), np.concatenate([anchor[cold], anchor[hot_rows]])
                first, last = np.concatenate([first[cold], window]), np.concatenate([last[cold], window])
                flags = np.repeat(np.array([0, 2], np.uint8), [int(cold.sum()), len(window)])
                body = slots(part, anchor, first, last)
                near, far = anchor - last, anchor - first
                columns = [h, fingerprints(body, near, far), place[_owners(offsets, first + start)], flags, near.astype(np.uint8), far.astype(np.uint8), body]
                for column, value in zip(found, distinct_contexts(columns), strict=True):
                    column.append(value)
        columns = distinct_contexts([np.concatenate(c) for c in found])
        h, prints, flags = columns[0], columns[1], columns[3]
        rows = []
        block = key[0].as_py()
        for p, at in by_part(np.where(flags & 2, part_of(prints, n_parts), part_of(h, n_parts)), n_parts):
            body = columns[6][at].tobytes()
            rows.append((p, block, *(packed(c[at]) for c in columns[:6]), pa.compress(body, "zstd", asbytes=True), len(body)))
        return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})

    return send


def cover_ranks(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at cover places, ``rows x SAMPLED``, and the length of the prefix that each
    has in common with the suffix one rank below, up to ``LENGTH``."""
    n = len(body)
    wide = np.zeros((n, SLOT + LENGTH + 8), np.uint8)
    wide[:, :SLOT] = body
    width = (LENGTH + 7) // 8 * 8
    suffixes = np.stack([wide[:, p : p + width] for p in SAMPLED], axis=1).reshape(-1, width)
    suffixes[:, LENGTH:] = 0
    keys = suffixes.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    common = np.zeros(len(order), np.int64)
    step = 1 << 17
    for a in range(1, len(order), step):
        upper, lower = suffixes[order[a : a + step]], suffixes[order[a - 1 : min(a + step, len(order)) - 1]]
        differs = upper[:, :LENGTH] != lower[:, :LENGTH]
        common[a : a + step] = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    return rank.reshape(n, len(SAMPLED)), common


def smallest_owners(group: np.ndarray, body: np.ndarray, near: np.ndarray, far: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context and place, the smallest document that its window starts in: ``contexts x PLACES``."""
    out = np.repeat(least[:, None], PLACES, axis=1)
    rank, common = cover_ranks(body)
    column = {int(p): i for i, p in enumerate(SAMPLED)}
    classes: dict[int, np.ndarray] = {}
    for place in range(PLACES):  # one suffix bucket at a time
        rows = np.flatnonzero((near <= place) & (place <= far))
        if not len(rows):
            continue
        start = PLACES - 1 - place
        ahead = int(TO_COVER[start % PERIOD])
        depth = LENGTH - ahead
        if depth not in classes:
            classes[depth] = np.cumsum(common < depth)
        tie = classes[depth][rank[rows, column[start + ahead]]]
        head = np.zeros(len(rows), np.uint64)
        for k in range(ahead):
            head = (head << np.uint64(8)) | body[rows, start + k].astype(np.uint64)
        order = np.lexsort([tie, head, group[rows]])
        g, e, t = group[rows][order], head[order], tie[order]
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1]) | (t[1:] != t[:-1])]))
        low = np.minimum.reduceat(least[rows][order], starts)
        out[rows[order], place] = np.repeat(low, np.diff(np.append(starts, len(rows))))
    return out


def all_places(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Bits of the places from ``near`` to ``far``."""
    one = np.uint64(1)
    return (one << (far.astype(np.uint64) + one)) - (one << near.astype(np.uint64))


def _judge(key: tuple, table: pa.Table) -> pa.Table:
    """Which windows of a context also start in a smaller document than the smallest of the block."""
    each = _arrays(table, "hashes", np.uint64)
    sizes = np.array([len(h) for h in each])
    h, prints, least = np.concatenate(each), _joined(table, "prints", np.uint64), _joined(table, "least", np.int64)
    flags, near, far = (_joined(table, n, np.uint8) for n in ("flags", "near", "far"))
    bodies = [np.frombuffer(pa.decompress(b.as_py(), n, "zstd"), np.uint8) for b, n in zip(table.column("bytes"), table.column("size").to_pylist(), strict=True)]
    body = np.concatenate(bodies).reshape(-1, SLOT)
    del bodies
    order = np.lexsort([least, prints, h])
    new_anchor = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    new_context = new_anchor | np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
    starts = np.flatnonzero(new_context)
    stops = np.append(starts[1:], len(order))
    context = np.cumsum(new_context) - 1
    pick = order[starts]  # the entry of each context with the smallest document
    group = (np.cumsum(new_anchor) - 1)[starts]
    masks = np.zeros(len(h), np.uint64)
    later = least[pick][context] < least[order]
    masks[order] = np.where(later, all_places(near[order], far[order]), np.uint64(0))
    # Anchors with different contexts compare their windows, some anchors at a time.
    crowd = np.flatnonzero(np.bincount(group)[group] > 1)
    places = np.arange(PLACES)
    at = 0
    while at < len(crowd):
        end = int(np.searchsorted(group[crowd], group[crowd[min(at + SORTED_CONTEXTS, len(crowd)) - 1]], side="left"))
        end = end if end > at else int(np.searchsorted(group[crowd], group[crowd[at]], side="right"))
        if at + SORTED_CONTEXTS >= len(crowd):
            end = len(crowd)
        some = crowd[at:end]
        rows = pick[some]
        lowest = smallest_owners(group[some], body[rows], near[rows], far[rows], least[rows])
        lengths = stops[some] - starts[some]
        which = np.repeat(np.arange(len(some)), lengths)
        entries = order[np.repeat(starts[some], lengths) + np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
        for a in range(0, len(entries), SORTED_CONTEXTS):
            e, w = entries[a : a + SORTED_CONTEXTS], which[a : a + SORTED_CONTEXTS]
            bits = (lowest[w] < least[e][:, None]) & (places >= near[e][:, None]) & (places <= far[e][:, None])
            masks[e] = (bits.astype(np.uint64) << places.astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        at = end
    send = (masks > 0) | ((flags & 1) > 0)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    rows = [(block, cuts[i] + np.flatnonzero(send[cuts[i] : cuts[i + 1]])) for i, block in enumerate(table.column("block").to_pylist())]
    rows = [(block, at) for block, at in rows if len(at)]
    columns = {"block": pa.array([b for b, _ in rows], pa.int64())}
    for name, values in (("hashes", h), ("prints", prints), ("least", least), ("masks", masks), ("hot", (flags & 2) > 0)):
        columns[name] = pa.array([packed(values[at]) for _, at in rows], pa.binary())
    return pa.table(columns)


def _cut(with_text: bool):
    def cut(key: tuple, docs: pa.Table, verdicts: pa.Table) -> pa.Table:
        """Marks the windows to remove and cuts the covered bytes."""
        data, offsets, place = _text(docs)
        n = len(data)
        change = np.zeros(n + 1, np.int8)  # a window starts once, so a byte is in LENGTH windows at most
        hashes, prints, masks = (_joined(verdicts, n, np.uint64) for n in ("hashes", "prints", "masks"))
        least, warm = _joined(verdicts, "least", np.int64), _joined(verdicts, "hot", bool)
        hot = np.unique(hashes[warm])
        code = mix64(hashes + prints * GOLD)
        order = np.argsort(code)
        hashes, prints, least, masks, code = hashes[order], prints[order], least[order], masks[order], code[order]
        names = np.unique(hashes)
        if len(names):
            for h, anchor, first, last, part, start in contexts(data, offsets):
                use = names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h
                h, anchor, first, last = h[use], anchor[use], first[use], last[use]
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    row, window = single_windows(anchor[is_hot], first[is_hot], last[is_hot])
                    row, cold = np.flatnonzero(is_hot)[row], ~is_hot
                    h, anchor = np.concatenate([h[cold], h[row]]), np.concatenate([anchor[cold], anchor[row]])
                    first, last = np.concatenate([first[cold], window]), np.concatenate([last[cold], window])
                near, far = anchor - last, anchor - first
                mine = fingerprints(slots(part, anchor, first, last), near, far)
                at = np.minimum(np.searchsorted(code, mix64(h + mine * GOLD)), len(code) - 1)
                use = (hashes[at] == h) & (prints[at] == mine)
                anchor, near, far, at, first = anchor[use], near[use], far[use], at[use], first[use]
                later = place[_owners(offsets, first + start)] > least[at]
                spots = np.arange(PLACES)
                out = ((masks[at][:, None] >> spots.astype(np.uint64)) & np.uint64(1)).astype(bool) | later[:, None]
                out &= (spots >= near[:, None]) & (spots <= far[:, None])
                row, spot = np.nonzero(out)
                window = anchor[row] - spot + start
                change[window] += 1
                change[window + LENGTH] -= 1
        covered = np.cumsum(change[:n], dtype=np.int8) > 0
        removed, spans, kept = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            out, body = covered[a:b], data[a:b]
            if out.any():
                removed[i], spans[i] = np.count_nonzero(out), out[0] + np.count_nonzero(out[1:] & ~out[:-1])
                body = body[~out]
            kept.append(body.tobytes() if with_text else sha256(body).hexdigest())
        digests = [sha256(k).hexdigest() for k in kept] if with_text else kept
        out = {
            "doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return cut


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, hot_occurrences: int = HOT_OCCURRENCES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, with ``with_text`` also the bytes ``kept``; one row per document.

    A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id.
    Strings are judged on the input and never cross documents. Null counts as empty. A null id
    counts as larger than any other; rows that share an id, or have none, don't remove from each other, and are
    dealt out to blocks by their texts.
    Cut bytes needn't be valid UTF-8.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("place"), text_of(text).cast("binary").alias("body")
    )
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("place", "body"), F.lit(n_blocks))).groupBy("block")
    anchors = blocks.applyInArrow(_find_anchors(n_blocks), ANCHORS)
    shared = anchors.groupBy("part").applyInArrow(_share(hot_occurrences), SHARED)
    found = blocks.cogroup(shared.groupBy("block")).applyInArrow(_send_contexts(n_blocks), CONTEXTS)
    verdicts = found.groupBy("part").applyInArrow(_judge, VERDICTS)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return blocks.cogroup(verdicts.groupBy("block")).applyInArrow(_cut(with_text), schema)
