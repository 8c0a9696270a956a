import hashlib
import random
import sys
import unicodedata
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sondage.llm import word_bpe as w
from sondage.llm.queries import WORD_MODEL, op11_word_bpe
from tests.llm import frames


@pytest.fixture(scope="module")
def model():
    return w.load(WORD_MODEL)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_MODEL)


def own(model, texts, lexicon=None):
    return [x.tolist() for x in w.encode(model, lexicon or w.compile_lexicon([]), [t.encode() for t in texts])]


def theirs(library, texts):
    return [e.ids for e in library.encode_batch(list(texts), add_special_tokens=False)]


def test_words_as_the_library(model, library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCXYZ'!?.,-_<>|0123456789 \t\n\x0b\x1c\x85\u00a0éÉßİΣσςάΆ\u0301\u0338中文字한글🎉👍🏽\u200d٣½Ⅷ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    texts += ["", " \n", "don't we'll I'M he'S 'sunny", "x" * 5000, "中" * 3000, "ab" * 4000, "aaaa" * 333 + "b", "<|endoftext|><|startoftext|>", "a<|endoftext|>\u0338b <|endoftext|", "ΑΣ ΟΔΟΣ", "\ufb01 \u212b \u1e9e"]
    assert own(model, texts) == theirs(library, texts)


def test_every_character_as_the_library(model, library):
    chars = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    known = [f"a{c}{c}1" for c in chars if unicodedata.category(c) != "Cn"]
    newer = [f"a{c}{c}1" for c in chars if unicodedata.category(c) == "Cn"]
    newer = newer[:3000] + newer[3000::400]
    for texts in (known, newer):
        text = " ".join(texts)
        assert own(model, [text]) == theirs(library, [text])


def residuals(entries):
    """States of the least transducer: prefixes told apart by what may follow them and what
    is then still to be written, once all that is settled has been."""
    table = dict(entries)
    tails = set()
    for u in {x[:k] for x in table for k in range(len(x) + 1)}:
        rest = {x[len(u) :]: tuple(ids) for x, ids in table.items() if x.startswith(u)}
        first, k = next(iter(rest.values())), 0
        while all(len(ids) > k and ids[k] == first[k] for ids in rest.values() if len(first) > k) and k < len(first):
            k += 1
        tails.add(frozenset((x, ids[k:]) for x, ids in rest.items()))
    return len(tails)


def test_transducer_is_minimal_and_exact(model, tmp_path):
    rng = random.Random(7)
    for n, letters in ((1, "a"), (60, "ab"), (300, "abc"), (500, "etaoinsr")):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))).encode() for _ in range(n)}
        for ids in (lambda x: w.merged(model, x), lambda x: [len(x), 5, x[-1]][: 1 + len(x) % 3], lambda x: []):
            entries = [(x, ids(x)) for x in words]
            made = w.compile_lexicon(entries)
            (tmp_path / "lexicon").write_bytes(made.write())
            back = w.Transducer.mapped(str(tmp_path / "lexicon"))
            asked = [*words, *[x + b"a" for x in words], *[x[:-1] for x in words], b"\xff", b""]
            got = [None if x is None else np.frombuffer(x, np.int32).tolist() for x in back.look_up(asked)]
            assert got == [dict(entries).get(x) for x in asked]
            assert len(back.ends) == residuals(entries)
    big = w.compile_lexicon([(f"{a}{b}{c}ings".encode(), [7]) for a in "bcd" for b in "aeiou" for c in "lmnrt"])
    assert len(big.ends) == 8
    with pytest.raises(ValueError):
        w.compile_lexicon([(b"a", [1]), (b"a", [1])])


def test_merging_as_pair_by_pair(model):
    rng = random.Random(11)
    for _ in range(400):
        word = "".join(rng.choice("etaoinshrdlu" if rng.random() < 0.9 else "qxz") for _ in range(rng.randrange(1, 30))).encode()
        ids = [*(model.inner[b] for b in word[:-1]), model.last[word[-1]]]
        while True:
            found = [(model.merges[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a << 32 | b in model.merges]
            if not found:
                break
            i = min(found)[1]
            ids[i : i + 2] = [model.merges[ids[i] << 32 | ids[i + 1]][1]]
        assert w.merged(model, word) == ids
        assert np.frombuffer(w.merged_all(model, [b"x", word, word[:3]])[1], np.int32).tolist() == ids


def test_ids_are_decoded_a_block_at_a_time(spark, monkeypatch, library):
    monkeypatch.setattr(w, "AT_ONCE", 50)
    df = spark.createDataFrame([(i, None if i == 3 else [320, i, 512] * (i % 40), "x") for i in range(200)], "doc_id long, ids array<int>, text string")
    for r in w.decoded(df, WORD_MODEL).collect():
        assert r.decoded == library.decode(r.ids or [], skip_special_tokens=False) and r.text == "x"


def check(spark, df, library, most=w.LEXICON):
    rows = df.select("doc_id", "text").collect()
    ids = theirs(library, [r.text or "" for r in rows])
    want = Counter((r.doc_id, tuple(i), library.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids, strict=True))
    got = w.decoded(w.encoded(df, WORD_MODEL, most=most), WORD_MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    both = w.encoded(df, WORD_MODEL, most=most, back=True).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in both) == want


def test_documents_as_the_library(spark, library):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5), library)
    check(spark, frames.awkward(spark), library)
    check(spark, frames.awkward(spark), library, most=1)
    assert w.encoded(frames.empty(spark), WORD_MODEL).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op11_word_bpe(spark, sf).collect():
        ids = theirs(library, [docs[r.doc_id]])[0]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_words_are_counted_over_all_rows(spark, model):
    df = frames.awkward(spark)
    got = {bytes(r.word): r.n for r in w.word_counts(df, model).collect()}
    want = Counter(x for r in df.collect() for c in (r.text or "").encode().split() if len(c) <= w.LONGEST_KNOWN for x in w.cut(model, c) if len(x) <= w.LONGEST)
    assert got == dict(want)
