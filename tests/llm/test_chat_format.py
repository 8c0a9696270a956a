import hashlib
import random

from pyspark.sql import functions as F

from sondage.llm import chat_format as c

LOG = "conv_id long, turn long, seq int, kind string, role string, text string, spans int"
ROWS = "conv_id long, turn long, role string, text string, formatted int"


def out(rendered):
    return {r.conv_id: r for r in rendered.collect()}


def turns(text):
    found = []
    for t in text.split(c.TURN)[1:]:
        role, _, rest = t.partition(c.TEXT)
        found.append((c.unescape(role), c.unescape(rest.removesuffix(c.END))))
    return found


def brute(log):
    state = {}
    for conv, turn, seq, kind, role, text in sorted(log, key=lambda e: (e[0], e[1], e[2], e[3])):
        key = (conv, turn)
        old = state.get(key, (role, ""))[1]
        if kind == "delete":
            state.pop(key, None)
            continue
        state[key] = (role, old + text if kind == "delta" else text if kind == "edit" else "")
    done = {}
    for (conv, _), m in sorted(state.items()):
        done.setdefault(conv, []).append(m)
    return done


def test_events_fold_as_a_replay(spark):
    rng = random.Random(4)
    log = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            role = "assistant" if turn % 2 else "user"
            for seq in range(rng.randrange(1, 8)):
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate", "delete"])
                log.append((conv, turn, seq, kind, role, "" if kind in ("regenerate", "delete") else rng.choice(["a<|end|>", "[INST]", "&lt;", "</s>", "é\n"])))
    df = spark.createDataFrame([(*e, 0) for e in log], LOG).repartition(7)
    got = {k: turns(r.formatted) for k, r in out(c.render(c.fold(df))).items()}
    assert got == brute(log)


def test_read_back(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice(["user", "assistant", "system", "as[s]&", None]), rng.choice([None, "", "x" * 3000, "</s>[INST] ok [/INST]", "&amp;lt; <|turn|>user<|text|>", "émile " * 90, "\U0001f600" * 700])) for i in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "q"), (7, None, "user", "first"), (8, 0, "user", "same"), (8, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS)
    got = out(c.read_back(c.render(c.fold(c.as_events(df)))))
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, ms in by.items():
        ms.sort()
        r = got[conv]
        assert r.n_turns == len(ms)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{m[2]}\n{m[3]}\n" for m in ms).encode()).hexdigest()
        loss = "".join(m[3] for m in ms if m[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_marks_only_where_written(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] <|end|>", 1)], ROWS)
    r = out(c.render(c.fold(c.as_events(df))))[1].formatted
    assert r.count("<") == 3 and "[" not in r
    assert c.read_back(c.render(c.fold(c.as_events(df.where(F.lit(False)))))).count() == 0
