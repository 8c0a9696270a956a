import hashlib
import re

from sondage.llm import secret_scan as s
from tests.llm import frames

KEY, TOKEN, IDENT = "AKIA" + "Z9" * 8, "aB3dE5" * 7, "Q7W8E9R0T1Y2U3I4"
CASES = [
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "password=secret:abcdefghijklmnop", "API_KEY: 'aaaabbbbcccc' pasſword=abcdefghijklmnop", "token=token=abcdefghijkl",
    "AKIA" + "A" * 13 + " AKIA" + "A" * 14, "0" * 15 + " " + "f" * 16 + "F", f"id {IDENT} far {'x ' * 300} {TOKEN}", f"id {IDENT} near {TOKEN} é", f"at https://db.example.com/x {TOKEN}",
    f"{TOKEN} alone", f"{KEY} with {TOKEN}", f"only {IDENT}", "see https://a.example.com", f"token: {'a1' * 10} https://a.example.com/q", "A" * 50000 + "1", "token" + " " * 3000 + "= " + "q" * 12,
    f"https://docs.example.com/document/d/{TOKEN}/edit", f"see https://docs.example.com/d/{TOKEN} and https://b.example.org/{TOKEN}x", f"mysql://db/{'0' * 20}/x {TOKEN}", f"{KEY} {'aB3' * 200}", f"amqp://q.example/{'v' * 900}:8 {TOKEN}",
    f"{TOKEN}{' ' * s.SCOPE}{IDENT}", f"{TOKEN}{' ' * (s.SCOPE + 1)}{IDENT}", f"{IDENT} x {TOKEN} y {TOKEN}z https://h.example.com/ é {KEY}",
]


def base(text):
    text = text or ""
    found = []
    for kind, rank, pattern, group, least in (
        ("assign", 0, re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        ("access", 1, re.compile("AKIA[A-Z0-9]+"), 0, 18),
        ("hex", 2, re.compile("[0-9a-f]+"), 0, 16),
    ):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def spell(spans):
    return ",".join(f"{k}:{x}:{y}" for k, x, y in spans)


def check(df):
    got = sorted((tuple(r) for r in s.digest(df).collect()), key=str)
    want = []
    for r in df.select("doc_id", "text").collect():
        b = base(r.text)
        want.append((r.doc_id, *(sum(k == x[0] for x in b) for k in ("assign", "access", "hex")), hashlib.sha256(spell(b).encode()).hexdigest(), spell(brute(r.text, b))))
    assert got == sorted(want, key=str)


def weak(text):
    """Every weak part, character by character."""
    ends, runs, letters = [], [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    at = text.find("://")
    while at >= 0:
        head = re.search(r"(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)$", text[:at])
        end = at + 3
        while end < len(text) and text[end] in letters | set("_.:@/-"):
            end += 1
        if head and end - at >= 7 and not (head.start() and (text[head.start() - 1] in "._" or text[head.start() - 1].isalnum())) and not (ends and head.start() < ends[-1][2]):
            ends.append(("endpoint", head.start(), end))
        at = text.find("://", at + 1)
    start = None
    for i, ch in enumerate(text + " "):
        if ch in letters | set("+/_-"):
            start = i if start is None else start
        elif start is not None:
            run, start_, start = text[start:i], start, None
            if len(run) < 16 or not any(c.isdigit() for c in run) or not any(c.isupper() for c in run) or any(x < i and start_ < y for _, x, y in ends):
                continue
            if len(run) <= 32 and all(c.isupper() or c.isdigit() for c in run):
                runs.append(("ident", start_, i))
            elif len(run) >= 32 and any(c.islower() for c in run):
                runs.append(("secret", start_, i))
    return ends + runs


def brute(text, b):
    text = text or ""
    every = weak(text)
    over = lambda p, q: p[1] < q[2] and q[1] < p[2]
    own = [p for p in every if not any(over(p, q) for q in b)]
    others = b + own + [p for p in every if p[0] == "endpoint" and p not in own]
    gap = lambda p, q: max(q[1] - p[2], p[1] - q[2])
    linked = [p for p in own if any(q[0] in s.NEEDS[p[0]] and not over(p, q) and gap(p, q) <= s.SCOPE for q in others)]
    return sorted(b + linked, key=lambda p: (p[1], s.KINDS.index(p[0]), p[2]))


def test_cases(spark):
    df = frames.documents(spark, CASES)
    check(df)
    found = {r.doc_id: r.spans for r in s.digest(df).collect()}
    assert "ident" not in found[6] and "secret" not in found[6]
    assert "ident" in found[7] and "secret" in found[7]
    assert "endpoint" in found[8] and "secret" in found[8]
    assert found[9] == found[11] == found[12] == ""
    assert found[10].startswith("access:0:20,secret")
    assert "endpoint" in found[13]
    assert found[16] == found[17] == found[22] == "", "a key in an address is part of the address"
    assert "secret" in found[18] and "endpoint" not in found[18] and "hex" in found[18]
    assert found[19] == "access:0:20,secret:21:621" and f"endpoint:0:{17 + 902},secret" in found[20]
    assert found[21].startswith("secret") and "ident" in found[21]


def test_awkward_rows(spark):
    check(frames.awkward(spark))
    assert s.digest(frames.empty(spark)).count() == 0
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_masking(spark):
    df = frames.documents(spark, [*CASES, None])
    out = {r.doc_id: r for r in s.masked(df).collect()}
    assert list(s.masked(df).columns) == df.columns
    assert out[10].text == "[access] with [secret]" and out[10].n_chars == len(out[10].text)
    assert out[9].text == CASES[9] and out[len(CASES)].text is None
    for r in out.values():
        assert not base(r.text)


def test_masking_keeps_columns_of_any_name(spark):
    names = ["spans", "__sub", "__id", "__hit", "row", "id", "sub", "d", "s", "hit", "n"]
    df = spark.createDataFrame([(1, CASES[10], *names), (2, "plain", *names), (None, None, *names)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = s.masked(df)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "[access] with [secret]", *names), (2, "plain", *names), (None, None, *names)], key=str)


def test_secrets_of_planted_pairs(spark):
    """Split credentials among long clean texts are found whole, and lone halves aren't."""
    text = ("Some words of a clean text without keys. " * 40).strip()
    rows = [f"{text} {IDENT} {text[:200]} {TOKEN} {text}" if i % 3 == 0 else f"{text} {TOKEN} {text}" if i % 3 == 1 else f"{text} {IDENT} {text}" for i in range(60)]
    got = {r.doc_id: r.spans for r in s.digest(frames.documents(spark, rows)).collect()}
    at = len(text) + 1
    want = f"ident:{at}:{at + 16},secret:{at + 217 + 1}:{at + 218 + 42}"
    assert all(got[i] == (want if i % 3 == 0 else "") for i in range(60)), (got[0], want)
