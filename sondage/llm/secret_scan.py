"""Secret scans with multipart credential linking.

Single parts are found by patterns. Three base kinds are reported wherever they
occur: ``assign`` (a named value), ``access`` (an access-key identifier) and
``hex``. Other parts are too weak alone: bare identifiers (``ident``), bare
tokens of mixed characters (``secret``) and service endpoints (``endpoint``).
Such a candidate is reported only if complementary parts occur with it in one
scope: the parts of a document are cut into buckets of the scope's width and
interval-joined on document and bucket, as a semi-join with the real distance as
a condition, so partners are never listed.

* a ``secret`` needs an identifier (access, ident) or an endpoint within ``SCOPE``;
* an ``ident`` or an ``endpoint`` needs a secret (secret, assign) within ``SCOPE``.

Partners are disjoint: what lies within an endpoint, such as a document's key in
its address, is part of the endpoint and no candidate. A candidate that a base span
overlaps isn't reported again; an endpoint that holds one still is a partner.

Spans are code points, end exclusive, and go to the whole end of a run. Defined results: a null text is empty and
has no spans; rows that agree in id and text are scanned once and return the
same row each; a null id is an id of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import text_of
from sondage.plans.shared import materialize

# The base patterns and the shortest value of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Weak parts. A run of key characters is a bare identifier if it is 16 to 32 capitals and
#: digits, a bare secret if it is 32 characters or more with capitals, small letters and digits.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")
IDENT = re.compile(r"[A-Z0-9]{16,32}")
SECRET_LEAST = 32
CAPITAL, SMALL, DIGIT = re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]")
ENDPOINT = re.compile(r"(?<![\w.])(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9_.:@/-]{4,}+")
#: The kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
NEEDS = {"secret": ("access", "ident", "endpoint"), "ident": ("secret", "assign"), "endpoint": ("secret", "assign")}
#: Code points between two parts of one credential, at most.
SCOPE = 400


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans, by start and then kind as listed."""
    found = []
    folded = text.lower()
    if any(n in folded for n in NAMES):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def weak_kind(run: str) -> str | None:
    if not DIGIT.search(run) or not CAPITAL.search(run):
        return None
    if IDENT.fullmatch(run):
        return "ident"
    return "secret" if SECRET_LEAST <= len(run) and SMALL.search(run) else None


def clear_of(spans: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[bool]:
    """For spans by start, whether none of the disjoint ``taken`` ones overlaps them."""
    out, i = [], 0
    for s, e, _ in spans:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        out.append(i == len(taken) or taken[i][0] >= e)
    return out


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Weak candidates, and endpoints that are partners only, as a base span overlaps them."""
    ends = [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    runs = [(*m.span(), kind) for m in RUN.finditer(text) if (kind := weak_kind(m[0]))]
    runs = [x for x, free in zip(runs, clear_of(runs, [(s, e) for s, e, _ in ends]), strict=True) if free]
    taken: list[tuple[int, int]] = []
    for s, e, _ in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    found = sorted(ends + runs)
    free = clear_of(found, taken)
    return [x for x, f in zip(found, free, strict=True) if f], [x for x, f in zip(found, free, strict=True) if not f and x[2] == "endpoint"]


PARTS = "array<struct<kind:string,start:int,end:int>>"
SCANNED = f"doc_id long, sub long, base {PARTS}, weak {PARTS}, partners {PARTS}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found: list[list] = [[], [], []]
        for t in b["text"].to_pylist():
            base = base_spans(t)
            for out, spans in zip(found, (base, *weak_spans(t, base)), strict=True):
                out.append([(k, s, e) for s, e, k in spans])
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["sub"], *(pa.array(x, part) for x in found)], ["doc_id", "sub", "base", "weak", "partners"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sub"), text.alias("text"))


def _linked(scanned: DataFrame, scope: int) -> DataFrame:
    """(doc_id, sub, linked): the weak parts whose complement lies within ``scope``."""
    some = scanned.where(F.size("weak") > 0)
    parts = some.select("doc_id", "sub", F.explode(F.concat("base", "weak", "partners")).alias("p")).select("doc_id", "sub", "p.*").distinct()
    bucket = F.floor(F.col("start") / scope)
    near = some.select("doc_id", "sub", F.explode("weak").alias("p")).select("doc_id", "sub", "p.*").distinct()
    near = near.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, F.floor(F.col("end") / scope), F.floor(F.col("end") / scope) + 1)))
    other = parts.select(F.col("doc_id").alias("d"), F.col("sub").alias("s"), F.col("kind").alias("k"), F.col("start").alias("from"), F.col("end").alias("to"), F.floor(F.col("start") / scope).alias("b"))
    other = other.unionByName(other.withColumn("b", F.floor(F.col("to") / scope))).distinct()
    fits = F.lit(False)
    for kind, needs in NEEDS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("k").isin(*needs))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sub") == F.col("s")) & (F.col("bucket") == F.col("b"))
    close = F.col("from").between(F.col("end"), F.col("end") + scope) | F.col("start").between(F.col("to"), F.col("to") + scope)
    kept = near.join(other, on & fits & close, "left_semi").select("doc_id", "sub", "kind", "start", "end").distinct()
    return kept.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, sub, base, spans) of each row: base spans, and all spans in
    order. ``sub`` is the XXH64 of the text, with which a reader finds it again."""
    scanned = materialize(_keyed(df, id_col, text_col).mapInArrow(_scan, SCANNED), "secret-parts")
    linked = _linked(scanned, scope).select(F.col("doc_id").alias("d"), F.col("sub").alias("s"), "linked")
    both = scanned.join(linked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sub") == F.col("s")), "left")
    rank = F.array(*[F.lit(k) for k in KINDS])

    def order(p: Column) -> Column:
        return F.struct(p["start"].alias("start"), F.array_position(rank, p["kind"]).alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"))

    every = F.array_sort(F.transform(F.concat("base", F.coalesce("linked", F.array().cast(PARTS))), order))
    return both.select("doc_id", "sub", "base", F.transform(every, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"))).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """The rows of ``scan`` as counts and digests."""
    found = scan(df)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, spans = b["row"], b["spans"]
        hits = spans.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
        if len(hits):
            names = [row.type.field(i).name for i in range(row.type.num_fields)]
            fields = dict(zip(names, row.flatten(), strict=True))
            out = fields["text"].to_pylist()
            for i in hits:
                t, at, parts = out[i] or "", 0, []
                for p in spans[i].as_py():
                    if p["end"] > at:
                        parts += [t[at : p["start"]], f"[{p['kind']}]" if p["start"] >= at else ""]
                        at = p["end"]
                out[i] = "".join([*parts, t[at:]])
            fields["text"] = pa.array(out, fields["text"].type)
            row = pa.StructArray.from_arrays(list(fields.values()), fields=list(row.type))
        yield pa.RecordBatch.from_arrays([row, spans.is_valid()], ["row", "hit"])


def masked(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``documents`` rows with every span replaced by its kind in brackets, and
    ``n_chars`` counted again where that changed. A text without spans, null
    included, is returned as it is. Columns of any other name are kept as they are."""
    found = scan(df, scope=scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("d"), F.col("sub").alias("s"), "spans").distinct()
    rows = df.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of("text")).alias("sub"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("sub") == F.col("s")), "left").select("row", "spans")
    new = both.mapInArrow(_mask, both.select("row", F.lit(True).alias("hit")).schema)
    length = F.when(F.col("hit"), F.length("row.text")).otherwise(F.col("row.n_chars")) if "n_chars" in df.columns else None
    kinds = dict(df.dtypes)
    return new.select(*[(length.cast(kinds[c]) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in df.columns])
