import random

import numpy as np
import pytest
import sentencepiece

from sondage.llm import sentencepiece_codec as c
from sondage.llm.queries import PIECE_MODEL
from tests.llm import frames


@pytest.fixture(scope="module")
def model():
    return c.load(PIECE_MODEL)


def brute(model, text):
    """Unigram Viterbi over the whole text, character by character."""
    if not text:
        return []
    text = " " + text.replace(c.MARK, " ")
    number = {model.pieces[i].decode(): int(i) for i in np.flatnonzero(model.normal)}
    best = [(0.0, None, None)] + [None] * len(text)
    for s in range(len(text)):
        for e in range(s + 1, min(len(text), s + model.longest) + 1):
            i = number.get(text[s:e])
            if i is None and (e > s + 1 or text[s] in number):
                continue
            total = best[s][0] + (model.unknown if i is None else model.scores[i])
            if best[e] is None or total > best[e][0]:
                best[e] = (total, s, i)
    out, e = [], len(text)
    while e:
        _, s, i = best[e]
        out[:0] = [i] if i is not None else [model.byte_ids[b] for b in text[s:e].encode()]
        e = s
    return out


TEXTS = ["Hello world", " two  spaces   here ", "a\nb\n\nc", "naïve façade été", "日本語テキスト \U0001f600!", "x" * 300, "\t tab", "▁mark▁", "a" + " " * 200 + "b", "aé" * 120, "1234567890" * 30, "\x00\x01", "ſK"]


def test_double_array():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abc\xe2\x96 ") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    base, check, value = c.double_array(keys)
    number = {k: i for i, k in enumerate(keys)}
    for _ in range(3000):
        k = bytes(rng.choice(b"abc\xe2\x96 z") for _ in range(rng.randrange(1, 7)))
        s = 0
        for b in k:
            n = base[s] + b
            s = n if check[n] == s else None
            if s is None:
                break
        assert (-1 if s is None else value[s]) == number.get(k, -1)


def test_encode_and_decode(model):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeàß é\n.,A1▁") for _ in range(rng.randrange(150))) for _ in range(200)]
    ids = c.encode(model, [t.encode() for t in texts])
    plain = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for t, x in zip(texts, ids, strict=True):
        assert x.tolist() == brute(model, t)
        assert c.decode(model, x).decode() == t.replace(c.MARK, " ") == plain.decode(x.tolist())


def test_invalid_bytes_decode_as_the_public_library(model):
    ids = [model.byte_ids[0xE2], model.byte_ids[0x96], 15043, model.byte_ids[0xFF]]
    assert c.decode(model, np.array(ids)).decode() == sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL).decode(ids)


def test_awkward_rows(spark, model):
    df = frames.awkward(spark)
    rows = c.encoded(df, PIECE_MODEL).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids)) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, tuple(brute(model, r.text))) for r in df.collect())
    assert all(r.exact and r.n_pieces == len(r.ids) for r in rows)
    back = c.decoded(c.encoded(df, PIECE_MODEL), PIECE_MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert c.encoded(frames.empty(spark), PIECE_MODEL).count() == 0


def test_whole_table(spark):
    rows = c.encoded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PIECE_MODEL)
    assert rows.where("not exact").count() == 0 and rows.count() == 1000


def test_long_parts_and_texts(model):
    """Stretches give what one pass gives, and cover the text."""
    rng = random.Random(8)
    solid = "".join(rng.choice(["the", "ing", "日本", "é", "x", "\U0001f600", "12", "Q"]) for _ in range(120_000)).encode()
    assert len(solid) > 2 * c.AT_ONCE
    assert c.solve_long(model, solid) == c.solve(model, [solid])[0]
    words = " ".join(rng.choice(["the", "  two", "a\nb", "\n\n", "日本語"]) for _ in range(400_000)).encode()
    for text in (words, solid + words, b" " * (3 << 20), b"x" + b" " * (2 << 20) + b"y" * 5, b"\n" * (2 << 20)):
        parts = list(c.stretches(b" " + text, 1 << 16))
        assert b"".join(parts) == b" " + text
        assert [p for s in parts for p in c.PARTS.findall(s)] == c.PARTS.findall(b" " + text)
    got = c.encode_long(model, words)
    assert np.array_equal(got, c.encode(model, [words])[0]) and c.decode(model, got) == words


def test_memory_of_a_long_text():
    """5 MB without a blank, in a process of its own."""
    import subprocess
    import sys

    code = f"""
import resource
import numpy as np
from sondage.llm import sentencepiece_codec as c
m = c.load({PIECE_MODEL!r})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "thequickbrownfox\u00e9".encode() * 300_000
ids = c.encode_long(m, text)
assert c.decode(m, ids) == text
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 300, used
