"""Removal of byte strings that occur earlier, by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a smaller doc_id, or further left in the same document. Sorting every suffix
of the corpus would ship each byte a hundred times, so suffixes are first met at
*anchors*: in every window of ``LENGTH`` bytes the 32-byte gram with the least
hash. Equal windows have equal anchors at equal offsets, so nothing is missed.

1. Scan: anchors with the hash of their *slice*, the bytes that windows with this
   anchor can reach. Of equal slices in one batch only the earliest is shuffled;
   the others are already decided. A string that very many documents share costs
   a row a batch.
2. By gram: a slice that equals an earlier one is decided. A gram whose slices
   are all equal is done; the first of each different slice goes on.
3. Those slices are cut from the texts and their suffixes sorted, gram by gram:
   a multikey quicksort a machine word at a time down to ``SHALLOW`` bytes, then
   blind tries for the groups that still tie. Suffixes that share a leaf are equal
   over ``LENGTH`` bytes, and all but the earliest are removed. A gram with very many
   different slices is parted: by ranges of the offset at which a window starts, and
   by the bytes that all windows of the range hold, so that equal windows still meet.
4. The removed intervals are gathered by document and applied.

Defined results: a null text is empty; a null doc_id comes before all others;
rows that agree in doc_id and text are one document and return the same row
each; rows that share a doc_id alone are ordered by a hash of their text; an
empty table gives an empty result; other columns are ignored. Texts may be of
any length below two gigabytes; long ones are walked a stretch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import buffers, text_of, whole_keys
from sondage.plans.shared import materialize

LENGTH, GRAM, SHALLOW = 100, 32, 32
#: Bytes that are hashed at once, and slices that are sorted at once.
CHUNK, SLICES = 1 << 20, 20_000
#: Bytes around a stretch of a long text, at least two windows.
MARGIN = 2 * LENGTH
#: Different slices of a gram beyond which they are parted by offset and surroundings, the number of offset ranges, and the mark of such rows in ``sides``.
MANY, RANGES, PARTED = 4096, 4, 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFFFF)
NONE_FIRST = -(1 << 63)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_B, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_B_INV, k, 1 << 64))])
        return cls.up[:n], cls.down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the documents ``data[offsets[i]:offsets[i + 1]]``: document, position,
    gram hash, slice hash, and the bytes of the slice left and right of the anchor."""
    n, reach = len(data), LENGTH - GRAM
    if n < LENGTH:
        z = np.empty(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64), z, z
    up, down = _Powers.to(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
    h = _mix((c[GRAM:] - c[:-GRAM]) * down[: n - GRAM + 1])
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, w = 1, reach + 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        m = np.minimum(m[: -(w - width)], m[w - width :])
    inside = np.zeros(len(m) + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    at = (m[np.cumsum(inside[:-1], dtype=np.int8) > 0] & _LOW).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    doc = np.searchsorted(offsets, at, "right") - 1
    left, right = np.minimum(reach, at - offsets[doc]), np.minimum(LENGTH, offsets[doc + 1] - at)
    start = at - left
    whole = _mix((c[at + right] - c[start]) * down[start] ^ (left * 1009 + right).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return doc, at - offsets[doc], h[at], whole, left, right


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each group; touching ones become one."""
    if not len(start):
        return start, end, group
    order = np.lexsort((start, group))
    start, end, group = start[order], end[order], group[order]
    base = np.cumsum(np.r_[0, group[1:] != group[:-1]]) * (1 << 33)
    far = np.maximum.accumulate(end + base)
    new = np.r_[True, (start + base)[1:] > far[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return start[new], (far - base)[last], group[new]


RUN, MET = 1, 0
#: kind RUN: an interval to remove, with ``at`` = start, ``other`` = end. kind MET: an anchor, with ``at`` = position, ``other`` = slice hash. ``sub`` is the text's hash.
ROWS = "kind byte, gram long, other long, doc_id long, sub long, at int, sides int"


def _rows(kind, gram, other, doc, sub, at, sides) -> pa.RecordBatch:
    n = len(doc)
    longs = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, other, doc, sub))
    cols = [pa.array(np.broadcast_to(np.int8(kind), n)), *longs, pa.array(np.asarray(at).astype(np.int32)), pa.array(np.asarray(sides).astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "gram", "other", "doc_id", "sub", "at", "sides"])


def _runs(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """RUN rows; ``group`` numbers the documents, which ``doc`` and ``sub`` give by number."""
    start, end, group = merged(start, end, group)
    spread = _mix((sub[group] ^ doc[group] ^ (start << 20)).view(np.uint64))
    return _rows(RUN, spread, end, doc[group], sub[group], start, np.zeros(len(start)))


def _parts(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, one past the last, first byte, one past the last byte) of about
    ``CHUNK`` bytes: whole documents, or a stretch of a long one."""
    size, first = end - begin, 0
    while first < len(begin):
        if size[first] > CHUNK:
            for at in range(0, int(size[first]), CHUNK):
                yield first, first + 1, at, min(at + CHUNK, int(size[first]))
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(np.cumsum(size[first:]), CHUNK, "right")) + first)
        yield first, last, 0, CHUNK
        first = last


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b["bytes"])
        ids, sub = b["doc_id"].to_numpy(), b["sub"].to_numpy()
        order = np.lexsort((sub, ids))
        order = order[np.r_[True, (ids[order][1:] != ids[order][:-1]) | (sub[order][1:] != sub[order][:-1])]] if len(order) else order
        ids, sub, begin, end = ids[order], sub[order], off[:-1][order], off[1:][order]
        found = []
        for first, last, lo, hi in _parts(begin, end):
            if last == first + 1:
                # windows with an anchor in the stretch lie within ``MARGIN`` of it
                near = max(0, lo - MARGIN)
                part = data[begin[first] + near : min(end[first], begin[first] + hi + MARGIN)]
                doc, at, *rest = anchors(part, np.array([0, len(part)]))
                keep = (at + near >= lo) & (at + near < hi)
                found.append((doc[keep] + first, at[keep] + near, *(x[keep] for x in rest)))
            else:
                part = np.concatenate([data[x:y] for x, y in zip(begin[first:last], end[first:last], strict=True)])
                doc, *rest = anchors(part, np.r_[0, np.cumsum((end - begin)[first:last])])
                found.append((doc + first, *rest))
        if not found:
            continue
        doc, pos, gram, whole, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(whole, kind="stable")
        again = np.zeros(len(by), bool)
        again[by[1:]] = whole[by[1:]] == whole[by[:-1]]
        if again.any():
            yield _runs(ids, sub, (pos - left)[again], (pos + right)[again], doc[again])
        one = np.flatnonzero(~again)
        for s in range(0, len(one), 1 << 16):
            i = one[s : s + (1 << 16)]
            yield _rows(MET, gram[i], whole[i], ids[doc[i]], sub[doc[i]], pos[i], left[i] * 128 + right[i])


def _number(doc: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((sub, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1])] if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return doc[order][new], sub[order][new], group


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_keys(batches, "gram", 1 << 17):
        kind, gram, other, doc, sub, at, sides = (t[c].to_numpy() for c in ("kind", "gram", "other", "doc_id", "sub", "at", "sides"))
        run = kind == RUN
        if run.any():
            yield _rows(RUN, gram[run], other[run], doc[run], sub[run], at[run], sides[run])
        met = np.flatnonzero(~run)
        met = met[np.lexsort((at[met], sub[met], doc[met], other[met], gram[met]))]
        gram, other, doc, sub, at, sides = (x[met] for x in (gram, other, doc, sub, at, sides))
        if not len(met):
            continue
        same_gram = np.r_[False, gram[1:] == gram[:-1]]
        same = same_gram & np.r_[False, other[1:] == other[:-1]]
        twice = same & np.r_[False, (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (at[1:] == at[:-1])]
        gone = same & ~twice
        if gone.any():
            here, left, right = at[gone].astype(np.int64), sides[gone] // 128, sides[gone] % 128
            ids, subs, group = _number(doc[gone], sub[gone])
            yield _runs(ids, subs, here - left, here + right, group)
        g = np.cumsum(~same_gram) - 1
        slices = np.bincount(g, weights=~same)[g]
        open_ = ~same & (slices > 1)
        yield _rows(MET, gram[open_], other[open_], doc[open_], sub[open_], at[open_], sides[open_] + np.where(slices[open_] > MANY, PARTED, 0))


#: The offsets of the ranges: a window starts so many bytes before its anchor.
BOUNDS = np.linspace(0, LENGTH - GRAM + 1, RANGES + 1).astype(np.int64)


def _key(gram: np.ndarray, data: np.ndarray, begin: np.ndarray, size: int, part: int) -> np.ndarray:
    """A hash of a gram, a range and the ``size`` bytes from ``begin``, which all windows of the range hold."""
    h = gram.view(np.uint64) ^ np.uint64(part + 1)
    for at in range(0, size, 8):
        word = np.zeros(len(begin), np.uint64)
        for i in range(at, min(at + 8, size)):
            word = (word << np.uint64(8)) | data[begin + i].astype(np.uint64)
        h = _mix((h ^ word) * np.uint64(_B))
    return h.view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices at the wanted positions of each text."""
    for b in batches:
        data, off = buffers(b["bytes"])
        ids, sub, want = b["doc_id"].to_numpy(), b["sub"].to_numpy(), b["want"]
        inner, bounds = want.flatten(), np.asarray(want.offsets)
        bounds = bounds - bounds[0]
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        gram, pos, sides = (np.asarray(inner.field(c)) for c in ("gram", "at", "sides"))
        parted, sides = sides >= PARTED, sides % PARTED
        at, left, right = off[row] + pos, (sides // 128).astype(np.int64), (sides % 128).astype(np.int64)
        whole = np.flatnonzero(~parted)
        todo = [(whole, gram[whole], 0, LENGTH - GRAM)]
        for k in range(RANGES):
            lo, hi = int(BOUNDS[k]), int(BOUNDS[k + 1]) - 1
            some = np.flatnonzero(parted & (left >= lo) & (LENGTH - right <= hi))
            todo.append((some, _key(gram[some], data, at[some] - lo, LENGTH - (hi - lo), k), lo, hi))
        for rows, key, lo, hi in todo:
            for s in range(0, len(rows), 1 << 15):
                i = rows[s : s + (1 << 15)]
                # no window of another range fits in what is cut
                before, after = np.minimum(left[i], hi), np.minimum(right[i], LENGTH - lo)
                parts = [data[x:y].tobytes() for x, y in zip(at[i] - before, at[i] + after, strict=True)]
                r = row[i]
                cols = [pa.array(key[s : s + (1 << 15)]), pa.array(ids[r]), pa.array(sub[r]), pa.array(pos[i].astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "doc_id", "sub", "at", "left", "slice"])


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a number that orders as they do; zeros follow the end."""
    word = np.zeros(len(data) + 8, np.uint64)
    word[: len(data)] = data
    for width in (1, 2, 4):
        word[:-width] = (word[:-width] << np.uint64(8 * width)) | word[width:]
    return word[: len(data)]


def repeats(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW, word: np.ndarray | None = None) -> np.ndarray:
    """Which of the suffixes at ``start`` equal, over ``depth`` bytes, one that is
    listed before in the same ``group``.

    Shallow: ternary multikey quicksort with the next eight bytes as its key; all
    groups are parted at once, and groups of one are done. Deep: a blind trie per
    group. Its first suffix is the path; each other one is compared with it once,
    and hangs at the depth and byte where it leaves the path; those that hang at
    one place are a trie of their own. One that never leaves shares its leaf."""
    word = words_of(data) if word is None else word
    out = np.zeros(len(start), bool)
    rows = np.arange(len(start))

    def part(rows: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        g = np.cumsum(new) - 1
        keep = np.bincount(g)[g] > 1 if len(g) else new
        return rows[order][keep], g[keep]

    rows, group = part(rows, (group,))
    for d in range(0, shallow, 8):
        rows, group = part(rows, (word[start[rows] + d], group))
    at = np.full(len(rows), shallow)
    while len(rows):
        first = np.r_[True, group[1:] != group[:-1]]
        lead = rows[np.flatnonzero(first)[np.cumsum(first) - 1]]
        lcp, open_ = np.full(len(rows), depth), np.ones(len(rows), bool)
        for d in range(shallow, depth, 8):
            d = min(d, depth - 8)
            i = np.flatnonzero(open_)
            x = word[start[rows[i]] + d] ^ word[start[lead[i]] + d]
            miss = x != 0
            zeros = 7 - np.floor(np.log2(x[miss].astype(np.float64))).astype(np.int64) // 8
            # a value just below a power of 256 may round up to it
            zeros += (x[miss] >> ((np.uint64(7) - zeros.astype(np.uint64)) * np.uint64(8))) == 0
            lcp[i[miss]] = d + zeros
            open_[i[miss]] = False
        out[rows[(lcp == depth) & ~first]] = True
        left = lcp < depth
        rows, group, at = rows[left], group[left], lcp[left]
        byte = data[start[rows] + at].astype(np.int64)
        rows, group = part(rows, (byte, at, group))
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = LENGTH - GRAM
    for t in whole_keys(batches, "gram", SLICES):
        gram, doc, sub, at, left = (t[c].to_numpy() for c in ("gram", "doc_id", "sub", "at", "left"))
        column = t["slice"].combine_chunks()
        data, off = buffers(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        order = np.lexsort((at, sub, doc, gram))
        again = np.zeros(len(order), bool)
        again[1:] = True
        for x in (gram, doc, sub, at):
            again[1:] &= x[order][1:] == x[order][:-1]
        order = order[~again]
        gram, doc, sub, at, left, begin, size = gram[order], doc[order], sub[order], at[order].astype(np.int64), left[order].astype(np.int64), off[:-1][order], np.diff(off)[order]
        g = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
        most, least = np.zeros(len(g), np.int64), np.full(len(g), LENGTH)
        # offsets never meet each other, so a large gram is sorted a few offsets at a time
        step, word = max(1, (4 * SLICES) // len(g)), words_of(data)
        for o0 in range(0, reach + 1, step):
            k = np.arange(o0, min(o0 + step, reach + 1))
            row, o = np.repeat(np.arange(len(g)), len(k)), np.tile(k, len(g))
            fits = (o <= left[row]) & (left[row] - o + LENGTH <= size[row])
            row, o = row[fits], o[fits]
            found = repeats(data, begin[row] + left[row] - o, g[row] * (reach + 1) + o, word=word)
            np.maximum.at(most, row[found], o[found])
            np.minimum.at(least, row[found], o[found])
        gone = least < LENGTH
        if gone.any():
            ids, subs, group = _number(doc[gone], sub[gone])
            yield _runs(ids, subs, at[gone] - most[gone], at[gone] - least[gone] + LENGTH, group)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b["bytes"])
        runs = b["runs"]
        size, removed, spans, digest = np.diff(off), [], [], []
        for i, r in enumerate(runs):
            text = data[off[i] : off[i + 1]]
            if not r.is_valid or not len(r.values):
                removed.append(0)
                spans.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                continue
            s, e = np.asarray(r.values.field("start")), np.asarray(r.values.field("end"))
            s, e, _ = merged(s, e, np.zeros(len(s), np.int64))
            sha, at = hashlib.sha256(), 0
            for x, y in zip(s, e, strict=True):
                sha.update(text[at:x])
                at = y
            sha.update(text[at:])
            removed.append(int((e - s).sum()))
            spans.append(len(s))
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([b["given"], pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    given = F.col(id_col).cast("long")
    return df.select(given.alias("given"), F.coalesce(given, F.lit(NONE_FIRST)).alias("doc_id"), F.xxhash64(text).alias("sub"), text.cast("binary").alias("bytes"))


def removed_runs(docs: DataFrame) -> DataFrame:
    """From ``keyed`` documents: (doc_id, sub, start, end), intervals to remove; they may overlap."""
    met = docs.select("doc_id", "sub", "bytes").mapInArrow(_scan, ROWS).repartition("gram").sortWithinPartitions("gram").mapInArrow(_by_gram, ROWS)
    met = materialize(met, "suffix-anchors")
    want = met.where(F.col("kind") == MET).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("gram", "at", "sides")).alias("want"))
    slices = docs.select("doc_id", "sub", "bytes").join(want, ["doc_id", "sub"]).mapInArrow(_cut, "gram long, doc_id long, sub long, at int, left int, slice binary")
    sorted_ = slices.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort, ROWS)
    both = met.where(F.col("kind") == RUN).unionByName(sorted_)
    return both.select("doc_id", "sub", F.col("at").cast("long").alias("start"), F.col("other").alias("end"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    docs = keyed(df, id_col, text_col)
    runs = removed_runs(docs).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    whole = docs.join(runs, ["doc_id", "sub"], "left").select("given", "bytes", "runs")
    return whole.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
