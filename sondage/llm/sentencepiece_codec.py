"""SentencePiece encoding and decoding.

Encoding is Unigram: the segmentation into pieces with the largest sum of log
scores. Pieces are matched by a double-array trie over their bytes, from all
starts at once, and a Viterbi pass picks the best path; of equal ones the one
whose last piece starts earliest. A character that no piece covers alone may be
taken as unknown, at the least score minus ``UNKNOWN_PENALTY``, and is written as
the pieces of its bytes. White space is marked: a mark is put before the text and
spaces become marks; decoding turns marks into spaces, bytes into characters
(U+FFFD where they are none) and drops the first space.

No piece crosses from another character to a mark, or holds a newline; so a text
is cut before marks and at newlines, and each different part is solved once per
task and remembered, up to ``REMEMBERED`` parts. A long part is matched a stretch at
a time, with the Viterbi scores of the last places carried over, and long texts are
cut between parts. Models of which that isn't true, or that normalise texts before,
are refused.

The model file is a parameter and is read on the driver; tasks get its pieces,
scores and trie, whose size the vocabulary bounds. Defined results: a null text is
empty and an empty text has no pieces; a U+2581 in a text is read as a space, as
in the public library; null ids and repeated rows pass through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import buffers, text_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts that a task remembers, bytes of text taken at once, and the longest part that is solved together with others.
REMEMBERED, PIECE, SHORT = 1 << 18, 1 << 20, 64
#: Longest part that is remembered, bytes of parts solved at once, and bytes of one part that are matched at once.
LONGEST_KNOWN, AT_ONCE = 1 << 10, 1 << 17
PARTS = re.compile(rb" *[^ \n]+|\n| +")


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over ``keys``: from state s, byte c leads to
    base[s] + c if its check is s. value is the key's number or -1."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for n, key in enumerate(keys):
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = children[at][c]
        value[at] = n
    size = 4 * len(children) + 4096
    base, check, out = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    slot, free, wide = {0: 0}, 256, 256
    queue = [0]
    for node in queue:
        kids = children[node]
        if not kids:
            continue
        cs = sorted(kids)
        while used[free]:
            free += 1
        # a single child fills the first hole; several look on from where room was found last
        b, tries = (free if len(cs) == 1 else max(free, wide)) - cs[0], 0
        while any(used[b + c] for c in cs):
            b += 1
            tries += 1
        if len(cs) > 1 and tries > 32:
            wide = b + cs[0]
        s = slot[node]
        base[s] = b
        for c in cs:
            used[b + c] = 1
            check[b + c] = s
            out[b + c] = value[kids[c]]
            slot[kids[c]] = b + c
            queue.append(kids[c])
    last = max(slot.values()) + 257
    return base[:last], check[:last], out[:last]


@dataclass
class Model:
    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: list[int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int
    unknown: float
    solved: dict[bytes, bytes] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"solved": {}}


def load(path: str) -> Model:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read()).normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("the model normalises texts before it encodes them")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
    pieces, ids = [], [int(i) for i in np.flatnonzero(normal)]
    for i in range(n):
        p = sp.id_to_piece(i)
        if normal[i] and (MARK in p.lstrip(MARK) or "\n" in p or " " in p):
            raise ValueError(f"piece {i} crosses the parts that are solved apart")
        pieces.append(p.replace(MARK, " ").encode() if normal[i] else bytes([byte_ids.index(i)]) if sp.is_byte(i) else b"")
    keys = [pieces[i] for i in ids]
    base, check, value = double_array(keys)
    value = np.where(value >= 0, np.array(ids, np.int64)[value], -1)
    return Model(pieces, scores, normal, byte_ids, base, check, value, max(map(len, keys)), float(scores[normal].min()) - UNKNOWN_PENALTY)


_CHAR = np.array([0 if b >> 6 == 2 else 4 if b >= 240 else 3 if b >= 224 else 2 if b >= 192 else 1 for b in range(256)], np.int64)


def matches(model: Model, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece in ``data``, ``ends`` giving for each byte
    the end of its part, and (start, end, -1) of every character that no piece
    covers alone; by start, then by end."""
    width = _CHAR[data]
    start = np.flatnonzero(width)
    state, at, found = np.zeros(len(start), np.int64), start, []
    alone = np.zeros(len(data), bool)
    for d in range(model.longest):
        pos = at + d
        ok = pos < ends[at]
        at, state, pos = at[ok], state[ok], pos[ok]
        nxt = model.base[state] + data[pos]
        ok = model.check[nxt] == state
        at, state = at[ok], nxt[ok]
        if not len(at):
            break
        v = model.value[state]
        hit = v >= 0
        found.append((at[hit], at[hit] + d + 1, v[hit]))
        alone[at[hit & (width[at] == d + 1)]] = True
    rest = start[~alone[start]]
    found.append((rest, np.minimum(rest + width[rest], ends[rest]), np.full(len(rest), -1)))
    s, e, v = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((e, s))
    return s[order], e[order], v[order]


def _write(model: Model, part: bytes, path: list[tuple[int, int, int]]) -> bytes:
    ids: list[int] = []
    for s, e, v in path:
        if v >= 0:
            ids.append(v)
        else:
            ids += [model.byte_ids[c] for c in part[s:e]]
    return np.array(ids, np.int32).tobytes()


def solve(model: Model, parts: list[bytes]) -> list[bytes]:
    """The best segmentation of each part, as the bytes of 32-bit piece ids."""
    out: list[bytes] = [b""] * len(parts)
    length = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(length) - length
    s, e, v = matches(model, data, np.repeat(begin + length, length))
    row = np.searchsorted(begin, s, "right") - 1
    score = np.where(v >= 0, model.scores[v], model.unknown)
    short = np.flatnonzero(length <= SHORT)
    if len(short):
        number = np.full(len(parts), -1)
        number[short] = np.arange(len(short))
        n = length[short]
        best = np.full((len(short), SHORT + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(short), SHORT + 1), np.int64)
        piece = np.zeros((len(short), SHORT + 1), np.int64)
        m = np.flatnonzero(number[row] >= 0)
        off = s[m] - begin[row[m]]
        order = np.argsort(off, kind="stable")
        m, off = m[order], off[order]
        edge = np.searchsorted(off, np.arange(SHORT + 2))
        for o in range(int(n.max())):
            k = m[edge[o] : edge[o + 1]]
            r, to = number[row[k]], e[k] - begin[row[k]]
            new = best[r, o] + score[k]
            win = new > best[r, to]
            r, to, k = r[win], to[win], k[win]
            best[r, to], back[r, to], piece[r, to] = new[win], o, v[k]
        at, steps = n.copy(), []
        while at.any():
            live = np.arange(len(at))
            steps.append((back[live, at], at.copy(), np.where(at > 0, piece[live, at], -2)))
            at = np.where(at > 0, back[live, at], 0)
        a, b, p = (np.array([x[i] for x in reversed(steps)]).T for i in range(3))
        plain = (p != -1).all(1)
        keep = p != -2
        ids = p.astype(np.int32)
        for i, j in enumerate(short.tolist()):
            if plain[i]:
                out[j] = ids[i][keep[i]].tobytes()
            else:
                out[j] = _write(model, parts[j], [(int(x), int(y), int(z)) for x, y, z in zip(a[i][keep[i]], b[i][keep[i]], p[i][keep[i]], strict=True)])
    for j in np.flatnonzero(length > SHORT).tolist():
        lo, hi = np.searchsorted(s, [begin[j], begin[j] + length[j]])
        frontier = Frontier(int(length[j]))
        frontier.extend(s[lo:hi] - begin[j], e[lo:hi] - begin[j], v[lo:hi], score[lo:hi])
        out[j] = frontier.path(model, parts[j])
    return out


class Frontier:
    """The Viterbi pass over one part: scores of the places that pieces still reach, and
    of each place passed the last piece and its length."""

    def __init__(self, size: int) -> None:
        self.size, self.total = size, {0: 0.0}
        self.length, self.took = np.zeros(size + 1, np.uint16), np.zeros(size + 1, np.int32)

    def extend(self, s: np.ndarray, e: np.ndarray, v: np.ndarray, score: np.ndarray) -> None:
        """Takes matches by start, all of which come after those before."""
        total, at, length, took = self.total, -1, self.length, self.took
        here = 0.0
        for x, y, z, w in zip(s.tolist(), e.tolist(), v.tolist(), score.tolist(), strict=True):
            if x != at:
                at, here = x, total.pop(x)
            t = here + w
            if y not in total or t > total[y]:
                total[y] = t
                length[y], took[y] = y - x, z

    def path(self, model: Model, part: bytes) -> bytes:
        at, ids = self.size, array("i")
        while at:
            n, v = int(self.length[at]), int(self.took[at])
            if v >= 0:
                ids.append(v)
            else:
                ids.extend(model.byte_ids[c] for c in reversed(part[at - n : at]))
            at -= n
        ids.reverse()
        return ids.tobytes()


def solve_long(model: Model, part: bytes) -> bytes:
    """``solve`` of one part, ``AT_ONCE`` bytes of starts at a time."""
    frontier = Frontier(len(part))
    for at in range(0, len(part), AT_ONCE):
        data = np.frombuffer(part, np.uint8, min(len(part) - at, AT_ONCE + model.longest + 4), at)
        s, e, v = matches(model, data, np.full(len(data), len(data)))
        own = s < AT_ONCE
        s, e, v = s[own], e[own], v[own]
        frontier.extend(s + at, e + at, v, np.where(v >= 0, model.scores[v], model.unknown))
    return frontier.path(model, part)


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """A text, cut where a part begins, about ``size`` bytes at a time."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b"\n", at, at + size) + 1
        if cut <= at:
            cut = text.rfind(b" ", at + 1, at + size)
            while cut > at and text[cut - 1] == 32:
                cut -= 1
        if cut <= at:
            # no blank within: up to the next one
            nearest = [x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0]
            cut = min(nearest) if nearest else len(text)
            while cut > at and cut < len(text) and text[cut] == 32 and text[cut - 1] == 32:
                cut -= 1
            if cut <= at:
                cut = len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(model: Model, texts: list[bytes]) -> list[np.ndarray]:
    """Piece ids of UTF-8 texts."""
    mark = MARK.encode()
    return _encode_parts(model, [PARTS.findall(b" " + (t.replace(mark, b" ") if mark in t else t)) if t else [] for t in texts])


def _encode_parts(model: Model, parts: list[list[bytes]]) -> list[np.ndarray]:
    known = model.solved
    new = list(dict.fromkeys(p for ps in parts for p in ps if p not in known))
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(dict.fromkeys(p for ps in parts for p in ps))
    long = {p: solve_long(model, p) if len(p) > AT_ONCE else solve(model, [p])[0] for p in new if len(p) > LONGEST_KNOWN}
    new = [p for p in new if len(p) <= LONGEST_KNOWN]
    ends = np.cumsum([len(p) for p in new])
    at = 0
    while at < len(new):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        known.update(zip(new[at:last], solve(model, new[at:last]), strict=True))
        at = last
    get = known.__getitem__ if not long else lambda p: long[p] if p in long else known[p]
    return [np.frombuffer(b"".join(map(get, ps)), np.int32) for ps in parts]


def encode_long(model: Model, text: bytes) -> np.ndarray:
    """``encode`` of one long text."""
    mark = MARK.encode()
    whole = b" " + (text.replace(mark, b" ") if mark in text else text)
    return np.concatenate([_encode_parts(model, [PARTS.findall(part)])[0] for part in stretches(whole, PIECE)])


def decode(model: Model, ids: np.ndarray) -> bytes:
    """UTF-8 bytes of the text."""
    text = b"".join(b"".join(map(model.pieces.__getitem__, ids[i : i + (1 << 18)].tolist())) for i in range(0, len(ids), 1 << 18))
    return text.removeprefix(b" ").decode("utf-8", "each_byte").encode()


# as in the public library, every byte that is no part of a character is one U+FFFD
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))

#: The model that a worker used last, by the number of its file, so that later tasks remember what earlier ones solved.
_MODELS: dict[int, Model] = {}


def _encode(model: Model, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _MODELS:
            _MODELS.clear()
        here = _MODELS.setdefault(number, model)
        for b in batches:
            data, off = buffers(b["bytes"])
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(off, off[first] + PIECE, "right")) - 1)
                texts = [data[off[i] : off[i + 1]].tobytes() for i in range(first, last)]
                ids = encode(here, texts) if off[last] - off[first] <= PIECE else [encode_long(here, t) for t in texts]
                back = [decode(here, x) == t for x, t in zip(ids, texts, strict=True)]
                fallback = [int(np.count_nonzero(~here.normal[x])) for x in ids]
                n = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
                cols = [b["doc_id"].slice(first, last - first), lists, pa.array(n), pa.array(fallback, pa.int64()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_pieces", "n_bytes", "exact"])
                first = last

    return run


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, n_bytes, exact) of each row: the piece ids, how many
    there are and how many of them are single bytes, and whether decoding them gives
    the text back."""
    model = load(path)
    number = zlib.crc32(path.encode())
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("bytes"))
    return rows.mapInArrow(_encode(model, number), "doc_id long, ids array<int>, n_pieces long, n_bytes long, exact boolean")


def decoded(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of piece ids; null ids give the empty text."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(model, np.asarray(x.values)) if x.is_valid else b"" for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
