"""BPE encoding and decoding with a lexicon that is a minimal acyclic transducer.

A text is split at special tokens, brought to NFC, lower-cased and cut into words,
which the model's merges turn into ids. Nearly all words of a corpus are frequent ones,
so all words are counted first, the most frequent, at most ``LEXICON``, are merged once,
and compiled into a transducer over their bytes: states with the same continuations are
one (its suffixes are shared), and ids are written on the earliest arc that settles
them. The transducer is one file that executors fetch and map into memory, so all
workers of a machine share its pages. A block of words walks through it side by side,
one byte a step. Words that it doesn't hold are merged exactly: the pair of least
rank, of equal ones the leftmost, until no pair is left. A word is cut before where no
piece of the vocabulary holds the two bytes side by side, as no merge can cross there.

The lexicon changes the work only, never an id. Its size is bounded, whatever the
corpus; counts are of all rows, and pre-aggregated in each task.

Defined results: a null text is empty and an empty text has no ids; blanks and other
white space leave no ids and aren't restored; the strings of special tokens become
those tokens; null ids and repeated rows pass through; an empty table gives an empty
result and an empty lexicon; other columns are ignored by ``encoded`` and kept by
``decoded``. Decoding gives, as the public library does for this model, the pieces in
their byte letters with their word ends, joined by single spaces.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import buffers, text_of
from sondage.plans.shared import materialize, shared_root

#: Words that are compiled, and the longest of them in bytes.
LEXICON, LONGEST = 1 << 16, 64
#: Chunks that a task counts at once, those that it remembers, the longest of them, bytes of text and ids taken at once.
COUNTED, REMEMBERED, LONGEST_KNOWN, PIECE, AT_ONCE = 1 << 18, 1 << 17, 1 << 10, 1 << 21, 1 << 19
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is
    printable, else the next of those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Model:
    """Merges over ids: ``merges`` maps a pair to its rank and the id it becomes."""

    path: str
    pieces: list[str]
    inner: list[int]
    last: list[int]
    merges: dict[int, tuple[int, int]]
    #: touching[256 * a + b]: some piece holds byte a and then byte b.
    touching: bytes
    special: dict[str, int]
    words: regex.Pattern
    #: The same, and ends of lines.
    lines: regex.Pattern
    #: The model file without its vocabulary, for characters that Python's tables don't know.
    frame: str
    known: dict[bytes, bytes] = field(default_factory=dict)
    arrays: tuple[np.ndarray, ...] = ()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "arrays": ()}

    def tables(self) -> tuple[np.ndarray, ...]:
        """Pairs in order, their ranks, the id made at each rank, and the ids of bytes within and at the end of a word."""
        if not self.arrays:
            pairs = np.array(sorted(self.merges), np.int64)
            found = np.array([self.merges[p] for p in pairs.tolist()], np.int64).reshape(-1, 2)
            made = np.zeros(len(pairs), np.int64)
            made[found[:, 0]] = found[:, 1]
            self.arrays = (pairs, found[:, 0], made, np.array(self.inner, np.int64), np.array(self.last, np.int64))
        return self.arrays


def load(path: str) -> Model:
    """Reads a model file. Models that cut or normalise texts in other ways are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bpe, cut = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
    odd = bpe["dropout"] or bpe["continuing_subword_prefix"] or bpe["byte_fallback"] or bpe["ignore_merges"] or bpe["end_of_word_suffix"] != WORD_END or spec["decoder"]
    if odd or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[0]["behavior"] != "Removed" or cut[1]["add_prefix_space"]:
        raise ValueError("the model isn't one of lower-cased words with word ends")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        raise ValueError("a special token takes part in normalising")
    vocab, letters = bpe["vocab"], byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    pieces = [""] * (1 + max([*vocab.values(), *special.values()]))
    touching = bytearray(1 << 16)
    for piece, i in [*vocab.items(), *special.items()]:
        pieces[i] = piece
        if piece not in special:
            spelled = [byte_of[c] for c in piece.removesuffix(WORD_END)]
            for a, b in zip(spelled, spelled[1:], strict=False):
                touching[256 * a + b] = 1
    frame = json.dumps(spec | {"model": bpe | {"vocab": {}, "merges": []}, "added_tokens": []})
    pattern = cut[0]["pattern"]["Regex"]
    merges: dict[int, tuple[int, int]] = {}
    for rank, (a, b) in enumerate(bpe["merges"]):
        merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
    return Model(path, pieces, [vocab[c] for c in letters], [vocab[c + WORD_END] for c in letters], merges, bytes(touching), special, regex.compile(pattern), regex.compile(pattern + r"|\n"), frame)


def merged(model: Model, word: bytes) -> list[int]:
    """Ids of one word."""
    out: list[int] = []
    start, touching = 0, model.touching
    for at in range(1, len(word)):
        if not touching[256 * word[at - 1] + word[at]]:
            out += _merge(model, [model.inner[b] for b in word[start:at]])
            start = at
    return out + _merge(model, [*(model.inner[b] for b in word[start:-1]), model.last[word[-1]]])


def _merge(model: Model, ids: list[int]) -> list[int]:
    merges, n = model.merges, len(ids)
    if n == 1:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get(ids[i] << 32 | ids[i + 1])
        if found:
            heap.append(found[0] << 32 | i)
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if ids[i] < 0 or j >= n:
            continue
        found = merges.get(ids[i] << 32 | ids[j])
        # what stood here when the pair was noted may be merged by now
        if not found or found[0] != top >> 32:
            continue
        ids[i], ids[j] = found[1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = merges.get(ids[i] << 32 | ids[k])
            if found:
                heapq.heappush(heap, found[0] << 32 | i)
        h = before[i]
        if h >= 0:
            found = merges.get(ids[h] << 32 | ids[i])
            if found:
                heapq.heappush(heap, found[0] << 32 | h)
    return [i for i in ids if i >= 0]


def merged_all(model: Model, words: Sequence[bytes]) -> list[bytes]:
    """``merged`` of many words as the bytes of 32-bit numbers. Words of like length are
    merged side by side, one pair of each a round."""
    out: list[bytes] = [b""] * len(words)
    length = np.array([len(w) for w in words], np.int64)
    low = 0
    for width in (4, 8, 16, 32):
        at = np.flatnonzero((length > low) & (length <= width))
        low = width
        for first in range(0, len(at), 1 << 14):
            some = at[first : first + (1 << 14)]
            for i, ids in zip(some.tolist(), _merge_side_by_side(model, [words[i] for i in some.tolist()], width), strict=True):
                out[i] = ids
    for i in np.flatnonzero(length > low).tolist():
        out[i] = np.array(merged(model, words[i]), np.int32).tobytes()
    return out


def _merge_side_by_side(model: Model, words: list[bytes], width: int) -> list[bytes]:
    pairs, ranks, made, inner, last = model.tables()
    none = np.int64(len(made))
    length = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    # two columns more than letters, so that what comes after the last is there to be read
    ids = np.full((len(words), width + 2), -1, np.int64)
    ids[row, np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)] = inner[data]
    ids[np.arange(len(words)), length - 1] = last[data[np.cumsum(length) - 1]]

    def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, ranks[at], none)

    rank = np.full(ids.shape, none)
    rank[:, :width] = rank_of(ids[:, :width], ids[:, 1 : width + 1])
    done = np.empty_like(ids)
    live, cols = np.arange(len(words)), np.arange(width + 1)
    while len(live):
        # the first of the least ranks is the leftmost
        best = rank.argmin(1)
        least = rank[np.arange(len(live)), best]
        go = least < none
        done[live[~go]] = ids[~go]
        live, ids, rank, best, least = live[go], ids[go], rank[go], best[go], least[go]
        each = np.arange(len(live))
        after = cols[None] > best[:, None]
        ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
        rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
        ids[each, best] = made[least]
        rank[each, best] = rank_of(ids[each, best], ids[each, best + 1])
        has = np.flatnonzero(best > 0)
        rank[has, best[has] - 1] = rank_of(ids[has, best[has] - 1], ids[has, best[has]])
    kept = done >= 0
    edge = 4 * np.r_[0, np.cumsum(kept.sum(1))]
    flat = done[kept].astype(np.int32).tobytes()
    return [flat[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


class Transducer:
    """Arcs by (state, byte), sorted, each with its target and the ids it writes;
    states with the ids that end a word there, or none if no word does."""

    MAGIC = b"MAT1"
    NAMES = ("keys", "target", "arc_start", "end_start", "ends", "pool")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    def write(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = self.MAGIC + struct.pack("<6q", *(len(p) for p in parts))
        return head + b"".join(p.astype("<i8" if n == "keys" else "<i4").tobytes() for n, p in zip(self.NAMES, parts, strict=True))

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        whole = np.memmap(path, np.uint8, "r")
        if bytes(whole[:4]) != cls.MAGIC:
            raise ValueError(f"{path} holds no transducer")
        at, arrays = 52, {}
        for n, k in zip(cls.NAMES, struct.unpack("<6q", bytes(whole[4:52])), strict=True):
            wide = 8 if n == "keys" else 4
            arrays[n] = np.frombuffer(whole, "<i8" if n == "keys" else "<i4", k, at)
            at += wide * k
        return cls(**arrays)

    def look_up(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The ids of each word as 32-bit numbers, None if it isn't in the lexicon."""
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state = np.zeros(len(words), np.int64)
        arcs = np.full((len(words), int(length.max(initial=0))), -1, np.int64)
        live = np.flatnonzero(length > 0)
        for d in range(arcs.shape[1]):
            live = live[length[live] > d]
            key = state[live] << 8 | data[begin[live] + d]
            arc = np.searchsorted(self.keys, key)
            hit = arc < len(self.keys)
            hit[hit] = self.keys[arc[hit]] == key[hit]
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            arcs[live, d] = arc
            state[live] = self.target[arc]
        ended = (state >= 0) & (length > 0)
        ended[ended] = self.ends[state[ended]] == 1
        found = np.flatnonzero(ended)
        if not len(found):
            return [None] * len(words)
        # what the arcs of each path write, then what the last state does
        arcs, last = arcs[found], state[found]
        inside = arcs >= 0
        first = np.column_stack([np.where(inside, self.arc_start[arcs], 0), self.end_start[last]]).ravel()
        size = np.column_stack([np.where(inside, self.arc_start[arcs + 1] - self.arc_start[arcs], 0), self.end_start[last + 1] - self.end_start[last]])
        edge = 4 * np.r_[0, np.cumsum(size.sum(1))]
        size = size.ravel()
        ids = self.pool[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
        out: list[bytes | None] = [None] * len(words)
        for i, x, y in zip(found.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[i] = ids[x:y]
        return out


@dataclass
class _State:
    arcs: dict[int, list] = field(default_factory=dict)
    final: bool = False
    end: tuple[int, ...] = ()
    number: int = -1

    def signature(self) -> tuple:
        return (self.final, self.end, *((b, t.number, out) for b, (t, out) in self.arcs.items()))


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> Transducer:
    """The minimal transducer of (word, ids), built word by word in byte order: once a
    word leaves a branch, the branch is final and its states are replaced by equal ones."""
    register: dict[tuple, _State] = {}
    done: list[_State] = []

    def settle(state: _State) -> _State:
        known = register.setdefault(state.signature(), state)
        if known is state:
            state.number = len(done)
            done.append(state)
        return known

    path = [_State()]
    last = b""
    for word, rest in sorted((w, tuple(i)) for w, i in entries):
        if word <= last:
            raise ValueError("words are not empty and stand once")
        same = 0
        while same < len(last) and word[same] == last[same]:
            same += 1
        for d in range(len(last), same, -1):
            path[d - 1].arcs[last[d - 1]][0] = settle(path[d])
        del path[same + 1 :]
        for d in range(same):
            # the arc goes on writing what this word agrees with; the rest moves below it
            arc, below = path[d].arcs[word[d]], path[d + 1]
            k = 0
            while k < min(len(arc[1]), len(rest)) and arc[1][k] == rest[k]:
                k += 1
            moved, arc[1], rest = arc[1][k:], arc[1][:k], rest[k:]
            if moved:
                for a in below.arcs.values():
                    a[1] = moved + a[1]
                if below.final:
                    below.end = moved + below.end
        for d in range(same, len(word)):
            path.append(_State())
            path[d].arcs[word[d]] = [path[d + 1], ()]
        path[same].arcs[word[same]][1] = rest
        path[-1].final = True
        last = word
    for d in range(len(last), 0, -1):
        path[d - 1].arcs[last[d - 1]][0] = settle(path[d])
    root = settle(path[0])
    # the start is state 0
    renumber = {root.number: 0} | {s.number: i + 1 for i, s in enumerate(s for s in done if s is not root)}
    keys, target, writes = [], [], []
    states = sorted(done, key=lambda s: renumber[s.number])
    for s in states:
        for b in sorted(s.arcs):
            t, out = s.arcs[b]
            keys.append(renumber[s.number] << 8 | b), target.append(renumber[t.number]), writes.append(out)  # noqa: B018
    pool = [i for out in writes for i in out]
    arc_start = np.cumsum([0, *map(len, writes)])
    end_start = len(pool) + np.cumsum([0, *(len(s.end) for s in states)])
    pool += [i for s in states for i in s.end]
    return Transducer(
        keys=np.array(keys, np.int64), target=np.array(target, np.int32), arc_start=arc_start.astype(np.int32), end_start=end_start.astype(np.int32),
        ends=np.array([s.final for s in states], np.int32), pool=np.array(pool, np.int32),
    )


#: Characters met so far that Python's tables know.
_ASSIGNED: set[str] = set()


def _newer(text: str) -> bool:
    """Whether a text holds a character that Python's tables don't know."""
    fresh = set(text) - _ASSIGNED
    if any(unicodedata.category(c) == "Cn" for c in fresh):
        return True
    _ASSIGNED.update(fresh)
    return False


def cut(model: Model, chunk: bytes) -> list[bytes | int]:
    """The words of a text without ASCII blanks, as UTF-8, and the ids of its special tokens."""
    text = chunk.decode()
    out: list[bytes | int] = []
    for piece in regex.split("(" + "|".join(map(regex.escape, model.special)) + ")", text) if model.special else [text]:
        if piece in model.special:
            out.append(model.special[piece])
        elif _newer(piece):
            out += _cut_newer(model.frame, piece)
        else:
            out += [w.encode() for w in model.words.findall(_plain(piece))]
    return out


def _plain(text: str) -> str:
    """NFC and lower case, which is by character: no sigma is final."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def cut_all(model: Model, chunks: Sequence[bytes]) -> list[list[bytes | int]]:
    """``cut`` of many chunks, which are normalised and matched as one text of lines."""
    odd = [s.encode() for s in model.special]
    text = b"\n".join(chunks).decode()
    if _newer(text) or any(s in text for s in model.special):
        return [cut(model, c) if _newer(c.decode()) or any(s in c for s in odd) else [w.encode() for w in model.words.findall(_plain(c.decode()))] for c in chunks]
    out: list[list[bytes | int]] = []
    here: list[bytes | int] = []
    for w in model.lines.findall(_plain(text)):
        if w == "\n":
            out.append(here)
            here = []
        else:
            here.append(w.encode())
    return [*out, here] if chunks else []


def _cut_newer(frame: str, piece: str) -> list[bytes]:
    """Words of a text with characters newer than Python's tables, by those of the public library."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_str(frame)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    return [bytes(byte_of[c] for c in w) for w, _ in tool.pre_tokenizer.pre_tokenize_str(tool.normalizer.normalize_str(piece))]


def ids_of(model: Model, lexicon: Transducer, chunks: list[bytes]) -> list[bytes]:
    """The ids of chunks, as the bytes of 32-bit numbers."""
    cuts = cut_all(model, chunks)
    words = list(dict.fromkeys(w for ws in cuts for w in ws if isinstance(w, bytes)))
    short = [w for w in words if len(w) <= LONGEST]
    known: dict[bytes | int, bytes] = {w: found for w, found in zip(short, lexicon.look_up(short), strict=True) if found is not None}
    unseen = [w for w in words if w not in known]
    known.update(zip(unseen, merged_all(model, unseen), strict=True))
    known.update((i, np.int32(i).tobytes()) for i in model.special.values())
    return [b"".join(map(known.__getitem__, ws)) for ws in cuts]


def encode(model: Model, lexicon: Transducer, texts: Sequence[bytes]) -> list[np.ndarray]:
    """Ids of UTF-8 texts. Chunks between blanks are remembered, up to a number of them."""
    split = [t.split() for t in texts]
    known = model.known
    new = list(set().union(*split).difference(known))
    forget = [c for c in new[: max(0, REMEMBERED - len(known))] if len(c) > LONGEST_KNOWN] + new[max(0, REMEMBERED - len(known)) :]
    for at in range(0, len(new), 1 << 14):
        part = new[at : at + (1 << 14)]
        known.update(zip(part, ids_of(model, lexicon, part), strict=True))
    out = [np.frombuffer(b"".join(map(known.__getitem__, cs)), np.int32) for cs in split]
    for c in forget:
        del known[c]
    return out


def decode(pieces: list[str], ids: np.ndarray) -> str:
    return " ".join(map(pieces.__getitem__, ids.tolist()))


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a binary column, about ``PIECE`` bytes at a time."""
    data, off = buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + PIECE, "right")) - 1)
        yield first, last, [data[off[i] : off[i + 1]].tobytes() for i in range(first, last)]
        first = last


def _word_counts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words: dict[bytes, int] = {}
            chunks = list(seen)
            for at in range(0, len(chunks), 1 << 14):
                part = chunks[at : at + (1 << 14)]
                for c, ws in zip(part, cut_all(model, part), strict=True):
                    n = seen[c]
                    for w in ws:
                        if isinstance(w, bytes) and len(w) <= LONGEST:
                            words[w] = words.get(w, 0) + n
            seen.clear()
            rows = list(words.items())
            for at in range(0, len(rows), 10_000):
                some = rows[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

        for b in batches:
            for _, _, texts in _blocks(b["bytes"]):
                for t in texts:
                    seen.update(c for c in t.split() if len(c) <= LONGEST_KNOWN)
                if len(seen) > COUNTED:
                    yield from flush()
        yield from flush()

    return run


def word_counts(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows: words of chunks of at most ``LONGEST_KNOWN`` bytes."""
    counts = df.select(text_of(text_col).cast("binary").alias("bytes")).mapInArrow(_word_counts(model), "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(df: DataFrame, model: Model, most: int = LEXICON, text_col: str = "text") -> Transducer:
    """The most frequent words that stand twice or more, compiled: as many classes of
    counts, eight a doubling, as hold at most ``most`` words. What comes to the driver is
    bounded by ``most`` and ``LONGEST``."""
    class_ = F.floor(F.log2("n") * 8).alias("class")
    counts = materialize(word_counts(df, model, text_col).where("n > 1").select("word", class_), "words")
    held, least = 0, None
    for r in counts.groupBy("class").agg(F.count("*").alias("k")).orderBy(F.desc("class")).collect():
        held += r.k
        if held > most:
            break
        least = r["class"]
    words = counts.where(F.col("class") >= F.lit(least)).select("word").collect() if least is not None else []
    return compile_lexicon((bytes(r.word), merged(model, bytes(r.word))) for r in words)


def share(spark: SparkSession, lexicon: Transducer) -> str:
    """Puts the file into the shared folder and gives it to all executors, also those
    that come later; returns the name by which tasks find it."""
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    uri = f"{shared_root(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(lexicon.write())
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


#: The model and the mapped lexicon that a worker used last, so that later tasks remember what earlier ones met.
_USED: dict[str, tuple[Model, Transducer]] = {}


def _encode(model: Model, name: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _USED:
            _USED.clear()
            _USED[name] = (model, Transducer.mapped(SparkFiles.get(name)))
        here, lexicon = _USED[name]
        for b in batches:
            for first, last, texts in _blocks(b["bytes"]):
                ids = encode(here, lexicon, texts)
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids)))
                more = {"decoded": pa.array([decode(here.pieces, x) for x in ids], pa.string())} if back else {}
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].slice(first, last - first), "ids": lists, "n_tokens": pa.array(n), **more})

    return run


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON, back: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens) of each row, with a lexicon of ``df``'s own words; with
    ``back`` also ``decoded``, what the ids give when they are decoded."""
    model = load(path)
    name = share(df.sparkSession, lexicon_of(df, model, most, text_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("bytes"))
    return rows.mapInArrow(_encode(model, name, back), "doc_id long, ids array<int>, n_tokens long" + ", decoded string" * back)


def decoded(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give the empty text."""
    pieces = load(path).pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) if x.is_valid else 0 for x in b[ids_col]], np.int64)
            upto, first = np.cumsum(sizes), 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + AT_ONCE, "right")))
                some = b.slice(first, last - first)
                texts = [decode(pieces, np.asarray(x.values)) if x.is_valid else "" for x in some[ids_col]]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])
                first = last

    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col!r} already")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{out_col}` string")
