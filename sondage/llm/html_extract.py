"""HTML extraction by inferred wrappers.

The pages of a host come from few templates. A template is inferred as a
union-free regular expression over tokens: block tags with their labels, template
texts (``=`` and a hash), and ``#`` for a text slot. Each page's token stream is
folded, repeated groups becoming ``( ... )+``; streams of one host are aligned one
after the other, and what one of them lacks becomes optional, ``( ... )?``. A text
that more than half of a host's different pages hold is a string of the template;
texts that differ are slots. So pages that differ in slots or in the number of
paragraphs alone have the same folded stream.

1. Scan: each page's tokens with a hash for each text, written once. Equal pages
   of a host count as one.
2. Count: the texts of each host's pages. Those of the template are at most twice
   the texts of an average page.
3. Align: equal folded streams of a host are counted before anything meets by
   host, and hosts are folded in salted parts, ever fewer: a host with a third of
   all pages sends its different streams only, and no task aligns all of those.
4. The wrapper's text slots, with the containers around them, give the *region*:
   article (or main) elements if they hold half of the slots' text, else the
   lowest container that holds all slots. Texts of links alone don't count for it.
5. Extract: the text blocks of the region. Containers in it that hold template
   text alone go.

Elements that HTML itself calls navigation, footer, aside, dialog and so on go,
and so do page headers, and other headers but for their headings. Class names
come last: an element that one calls a menu, an advert, comments or the like goes
unless it is a shell, which its share of the text in the host's slots tells.

Blocks are decoded, white space becomes one space, and blocks are joined by two
newlines. Defined results: null or empty html has the empty text; a page without
a host, the only page of a host, and one that lacks the region of its host use
their own slots (all texts are slots where one page is all there is); a page all
of whose text is template text keeps it; repeated rows and null ids pass through;
malformed markup never fails: an unclosed element ends with its parent, an unknown
end tag is ignored, a ``<`` that starts no tag is text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape
from itertools import count
from os.path import commonprefix
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import ascii_lower, text_of
from sondage.plans.shared import materialize

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.DOTALL)
LABELS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content is never text.
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A block of text of its own; an open one ends where the next block begins.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address summary".split())
CONTAINERS = frozenset("html body div section article main table tbody thead tfoot tr ul ol dl figure details center fieldset header footer nav aside form head menu dialog hgroup".split())
BOILERPLATE = frozenset("nav footer aside head menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Class and id names of what isn't the article are made of these words, and of words that say nothing (``PLAIN``).
MARKS = frozenset("ad ads adsbygoogle advert advertisement adverts sponsor sponsored promo banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist respond responses discussion disqus replies share sharing social related recommended newsletter subscribe signup popup modal footer".split())
PLAIN = frozenset("top bottom left right site page post entry global header inner outer box block area wrap wrapper container section widget bar list items item links buttons posts form reader user the main".split())
CONTENT = ("article", "main")
#: Class names with one of these words and a number name what the page holds, not its kind: the number isn't part of the label.
NUMBERED = frozenset("post postid page pageid entry article item node id comment topic thread story product attachment author".split())
#: Parts into which a host's streams are folded, one step after the other; each divides the one before.
SALTS = (4096, 64, 1)
#: Tasks among which the rows of one host are parted where they meet what is known of it.
SPREAD = 32


#: A label ends with this if the element goes, and with the other if it goes unless it is a shell.
GOES, MAY_GO = "!", "~"


def _marked(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in PLAIN for w in words)


def _kind(name: str) -> str:
    """A class name without the number of what it names; a column's or a heading's stays."""
    return re.sub(r"[0-9]+", "0", name) if re.search(r"[0-9]", name) and not NUMBERED.isdisjoint(re.split(r"[^a-z]+", name)) else name


def _label(tag: str, attrs: str, parent: str) -> str:
    """The element's name with its class names, and how it is marked."""
    found = {}
    for m in LABELS.finditer(attrs) if attrs else ():
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = found.get("class", "").split()
    label = ".".join(["main" if found.get("role") == "main" and tag in ("div", "section") else tag, *sorted(map(_kind, names[:3]))]).translate(_SAFE)
    if tag in BOILERPLATE or found.get("role") in ROLES or (tag == "header" and parent in ("", "html", "body")):
        return label + GOES
    return label + MAY_GO if tag == "form" or (tag not in ("html", "body") and any(map(_marked, [*names, found.get("id", "")]))) else label


_SAFE = str.maketrans({c: "_" for c in f"/#= {GOES}{MAY_GO}"})


def _tag(label: str) -> str:
    return label.split(".", 1)[0].rstrip(GOES + MAY_GO)


class Block(NamedTuple):
    """A text with the labels of the containers around it, their numbers in the page, whether it is kept, and its characters outside links."""

    path: str
    boxes: tuple[int, ...]
    kept: bool
    text: str
    loose: int

    @property
    def key(self) -> int:
        return xxhash.xxh64_intdigest(self.text, 7) >> 1


def parse(html: str) -> tuple[list[Block], list[str | Block]]:
    """The text blocks, and the token stream of block tags and blocks."""
    blocks: list[Block] = []
    tokens: list[str | Block] = []
    stack: list[tuple[str, str, bool, str, tuple[int, ...]]] = []  # name, label, within a header, path of containers, their numbers
    text: list[str] = []
    at = linked = 0
    link = False

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                name, _, header, path, boxes = stack[-1] if stack else ("", "", False, "", ())
                heading = len(name) == 2 and name[0] == "h" and name != "hr"
                loose = len(joined) if linked * 5 < len(joined) * 4 else 0
                blocks.append(Block(path, boxes, GOES not in path and (heading or not header), joined, loose))
                tokens.append(blocks[-1])
            text.clear()
        linked = 0

    def close(to: int) -> None:
        flush()
        while len(stack) > to:
            tokens.append("/" + stack.pop()[1])

    while m := TAG.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = not m[1]
            continue
        if m[1]:
            if tag in LEAVES or tag in CONTAINERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                else:
                    flush()
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag not in LEAVES and tag not in CONTAINERS:
            continue
        flush()
        # an open leaf ends here, but list items, cells and quotes hold other blocks
        if stack and stack[-1][0] in LEAVES and (stack[-1][0] not in ("li", "dd", "td", "th", "blockquote") or stack[-1][0] == tag or (stack[-1][0] in ("td", "th") and tag in ("td", "th", "tr")) or (stack[-1][0] == "dd" and tag == "dt")):
            close(len(stack) - 1)
        if tag == "tr" and stack and stack[-1][0] == "tr":
            close(len(stack) - 1)
        name, _, header, path, boxes = stack[-1] if stack else ("", "", False, "", ())
        label = _label(tag, m[3], name)
        held = tag in CONTAINERS or label[-1] in (GOES, MAY_GO)
        stack.append((tag, label, header or tag == "header", f"{path}/{label}" if held else path, (*boxes, len(tokens)) if held else boxes))
        tokens.append(label)
    if at < len(html):
        text.append(html[at:])
    close(0)
    return blocks, tokens


# A wrapper is a list of items: a token, or (mark, items) with mark "+" or "?".
Item = str | tuple


def spell(items: tuple[Item, ...]) -> str:
    return " ".join(x if isinstance(x, str) else f"( {spell(x[1])} ){x[0]}" for x in items)


def fold(items: tuple[Item, ...], longest: int = 24) -> tuple[Item, ...]:
    """Immediate repetitions of a group of items become one repeated group,
    short groups first, until nothing repeats."""
    changed = True
    while changed:
        changed = False
        for n in range(1, min(longest, len(items) // 2) + 1):
            out: list[Item] = []
            i = 0
            while i < len(items):
                group = items[i : i + n]
                k = 1
                while len(group) == n and items[i + k * n : i + (k + 1) * n] == group:
                    k += 1
                if k > 1 and n > 0:
                    same = n == 1 and isinstance(group[0], tuple) and group[0][0] == "+"
                    out.append(group[0] if same else ("+", group))
                    changed = True
                    i += k * n
                else:
                    out.append(items[i])
                    i += 1
            items = tuple(out)
    return items


def _absorb(items: tuple[Item, ...], groups: list[tuple]) -> tuple[Item, ...]:
    """Single occurrences of a group that repeats elsewhere are that group once."""
    for g in groups:
        n, out, i = len(g[1]), [], 0
        while i < len(items):
            if items[i : i + n] == g[1]:
                i += n
                found = True
            elif items[i] == g:
                i += 1
                found = True
            else:
                out.append(items[i])
                i += 1
                continue
            if found and not (out and out[-1] == g):
                out.append(g)
        items = tuple(out)
    return items


def _options(items: tuple[Item, ...], other: tuple[Item, ...]) -> tuple[Item, ...]:
    """Occurrences in ``items`` of what is optional in ``other``, as that option."""
    for g in dict.fromkeys(x for x in other if isinstance(x, tuple) and x[0] == "?" and len(x[1]) > 1):
        n, out, i = len(g[1]), [], 0
        while i < len(items):
            hit = items[i : i + n] == g[1]
            out.append(g if hit else items[i])
            i += n if hit else 1
        items = tuple(out)
    return items


def align(a: tuple[Item, ...], b: tuple[Item, ...]) -> tuple[Item, ...]:
    """The union-free expression that both streams match: repeated groups of
    either hold in both, and what only one has is optional."""
    groups = [x for x in dict.fromkeys([*a, *b]) if isinstance(x, tuple) and x[0] == "+"]
    a, b = _absorb(a, groups), _absorb(b, groups)
    a, b = _options(a, b), _options(b, a)
    plain = lambda xs: [x[1] if isinstance(x, tuple) and x[0] == "?" else (x,) for x in xs]
    ka, kb = plain(a), plain(b)
    if ka == kb:
        return tuple(x if x == y else ("?", k) for x, y, k in zip(a, b, ka, strict=True))
    out: list[Item] = []
    for op, i, j, k, m in SequenceMatcher(None, [spell(x) for x in ka], [spell(x) for x in kb], autojunk=False).get_opcodes():
        if op == "equal":
            out += [a[x] if a[x] == b[y] else ("?", ka[x]) for x, y in zip(range(i, j), range(k, m), strict=True)]
            continue
        for side, lo, hi in ((a, i, j), (b, k, m)):
            run: list[Item] = []
            for x in side[lo:hi]:
                if isinstance(x, tuple) and x[0] == "?":
                    out += [("?", tuple(run))] * bool(run)
                    run = []
                    out.append(x)
                else:
                    run.append(x)
            out += [("?", tuple(run))] * bool(run)
    return tuple(out)


def _loads(text: str) -> tuple[Item, ...]:
    tup = lambda x: x if isinstance(x, str) else (x[0], tuple(tup(y) for y in x[1]))
    return tuple(tup(x) for x in json.loads(text))


SCANNED = "host string, page long, tokens array<string>, texts array<long>"
STREAMS = "host string, stream string, n long, mass map<string,long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page; a text is ``#``, its hash, its path if it counts for the region, and its characters outside links."""
    for b in batches:
        seen: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
        for host, html in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
            blocks, tokens = parse(html)
            spelled = [t if isinstance(t, str) else f"#{t.key}#{t.path if t.kept else GOES}#{t.loose}" for t in tokens]
            page = xxhash.xxh64_intdigest("\n".join(spelled)) >> 1
            if (host, page) not in seen:
                seen[host, page] = (spelled, list({t.key for t in blocks}))
        cols = [[k[0] for k in seen], [k[1] for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "tokens", "texts"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded streams and characters of slots by container, with the equal streams of a batch counted."""
    for b in batches:
        n: Counter = Counter()
        mass: dict[tuple[str, str], Counter] = {}
        for host, tokens, fixed in zip(b["host"].to_pylist(), b["tokens"].to_pylist(), b["fixed"].to_pylist(), strict=True):
            template, out, slots = set(fixed or ()), [], []
            for t in tokens:
                if t[0] != "#":
                    out.append(t)
                    continue
                _, key, path, chars = t.split("#")
                if int(key) in template:
                    out.append("=" + key)
                else:
                    out.append("#")
                    if path != GOES:
                        slots.append((path, int(chars)))
            key = (host, json.dumps(fold(tuple(out))))
            n[key] += 1
            held = mass.setdefault(key, Counter())
            for path, chars in slots:
                held[path] += chars
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([list(mass[k].items()) for k in keys], pa.map_(pa.string(), pa.int64()))],
            ["host", "stream", "n", "mass"],
        )


def _fold_host(host: str, rows: pd.DataFrame) -> tuple[str, str, int, dict[str, int]]:
    wrapper: tuple[Item, ...] | None = None
    mass: Counter = Counter()
    for stream, held in sorted(zip(rows["stream"], rows["mass"], strict=True), key=lambda r: (len(r[0]), r[0])):
        new = _loads(stream)
        wrapper = new if wrapper is None else wrapper if new == wrapper else align(wrapper, new)
        mass.update(dict(held))
    return host, json.dumps(wrapper), int(rows["n"].sum()), dict(mass)


def _fold_rows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(*_fold_host(key[0], rows), int(key[1]))], columns=["host", "stream", "n", "mass", "salt"])


#: A container around a slot: its label, whether it may be missing, and whether it may repeat.
Around = tuple[str, bool, bool]


def slots(wrapper: tuple[Item, ...]) -> set[tuple[Around, ...]]:
    """The containers around each text slot of the wrapper, outermost first. One
    that opens in an optional group may be missing, and so may one that closes in
    an optional group which it doesn't open in."""
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []
    found: set[tuple[Around, ...]] = set()
    number = count()

    def walk(items: tuple[Item, ...], options: tuple[int, ...], repeats: bool) -> None:
        for x in items:
            if not isinstance(x, str):
                walk(x[1], (*options, next(number)) if x[0] == "?" else options, repeats or x[0] == "+")
            elif x == "#":
                found.add(tuple(s[:3] for s in stack))
            elif x[0] == "=":
                continue
            elif x[0] != "/":
                if _tag(x) in CONTAINERS or x[-1] in (GOES, MAY_GO):
                    stack.append((x, bool(options), repeats, options))
            elif (i := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == x[1:]), -1)) >= 0:
                if stack[i][3][: len(options)] == options:
                    del stack[i:]
                else:
                    stack[i:] = [(label, True, again, within) for label, _, again, within in stack[i:]]

    walk(wrapper, (), False)
    return found


def fits(path: str, slot: tuple[Around, ...]) -> bool:
    """Whether a slot of the wrapper can lie in the containers of ``path``."""
    labels = path.split("/")[1:]
    ends = {0}
    for label, missing, repeats in slot:
        new = set(ends) if missing else set()
        for at in ends:
            while at < len(labels) and labels[at] == label:
                at += 1
                new.add(at)
                if not repeats:
                    break
        ends = new
    return len(labels) in ends


def shells(mass: dict[str, int]) -> frozenset[str]:
    """The marked labels that must be shells: those of article and main with half
    of the text, and where unmarked elements hold less than a tenth of it, the
    label with most text and others that hold nearly as much."""
    total, under, plain = sum(mass.values()), Counter(), 0
    for path, n in mass.items():
        marked = {label for label in path.split("/") if label.endswith(MAY_GO)}
        under.update(dict.fromkeys(marked, n))
        plain += 0 if marked else n
    most = max(under.values(), default=0) if plain * 10 < total else 2 * total
    return frozenset(label for label, n in under.items() if n and (n * 10 >= most * 9 or (_tag(label) in CONTENT and n * 2 >= total)))


def goes(path: str, known: frozenset[str]) -> bool:
    """Whether a marked element that is no shell lies around ``path``."""
    return MAY_GO in path and any(label.endswith(MAY_GO) and label not in known for label in path.split("/"))


def _inside(path: str, region: str) -> bool:
    if region in CONTENT:
        return any(_tag(label) == region for label in path.split("/"))
    return path == region or path.startswith(region + "/")


def region_of(wrapper: tuple[Item, ...], mass: dict[str, int]) -> tuple[str, frozenset[str]]:
    """The region and the shells, from the characters in each container of slots:
    ``article`` or ``main`` if such elements hold half of them, else the lowest
    container of all; of texts that lie in no slot, the same."""
    known = slots(wrapper)
    inside = {p: n for p, n in mass.items() if any(fits(p, s) for s in known)} or mass
    full = {p: n for p, n in inside.items() if n} or dict.fromkeys(inside, 1)
    shell = shells(full)
    held = {p: n for p, n in full.items() if not goes(p, shell)} or full
    for name in CONTENT:
        if 2 * sum(n for p, n in held.items() if _inside(p, name)) >= sum(held.values()) > 0:
            return name, shell
    return "/".join(commonprefix([p.split("/") for p in held])), shell


WRAPPERS = "host string, n_pages long, wrapper string, region string, shells array<string>"


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        items = [_loads(s) for s in b["stream"]]
        found = [region_of(x, dict(m)) for x, m in zip(items, b["mass"], strict=True)]
        yield pd.DataFrame({"host": b["host"], "n_pages": b["n"], "wrapper": [spell(x) for x in items], "region": [r for r, _ in found], "shells": [sorted(s) for _, s in found]})


def _pages(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = ascii_lower(F.regexp_extract(text_of(url_col), r"^[^:]*://([^/?#]*)", 1))
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), text_of(html_col).alias("html"))


def _with_host(rows: DataFrame, by_host: DataFrame, salt: Column) -> DataFrame:
    """A left join on the host that parts the rows of a host among ``SPREAD`` tasks."""
    each = by_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("part", F.pmod(salt, F.lit(SPREAD)).cast("int")).join(each, ["host", "part"], "left").drop("part")


def template_texts(scanned: DataFrame) -> DataFrame:
    """(host, fixed): the texts that more than half of the different pages of a host hold."""
    pages = scanned.groupBy("host").agg(F.count("*").alias("n_pages")).where("n_pages > 1")
    texts = scanned.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count("*").alias("n")).where("n > 1")
    return texts.join(pages, "host").where("2 * n > n_pages").groupBy("host").agg(F.collect_list("text").alias("fixed"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n_pages, wrapper, region, shells, fixed) of each host of ``_pages`` rows; ``n_pages`` are different ones."""
    scanned = pages.where("host <> ''").select("host", "html").mapInArrow(_scan, SCANNED).dropDuplicates(["host", "page"])
    scanned = materialize(scanned, "html-tokens")
    fixed = materialize(template_texts(scanned), "html-templates")
    streams = _with_host(scanned.select("host", "page", "tokens"), fixed, F.col("page")).select("host", "tokens", "fixed").mapInArrow(_streams, STREAMS)
    streams = materialize(streams, "html-streams")
    same = F.struct("host", "stream")
    flat = streams.select(same.alias("k"), "n", F.explode_outer("mass").alias("path", "held")).groupBy("k", "path").agg(F.sum("held").alias("held"))
    counts = streams.groupBy("host", "stream").agg(F.sum("n").alias("n"))
    masses = flat.groupBy("k").agg(F.map_from_entries(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "held")))).alias("mass"))
    each = counts.join(masses.select("k.host", "k.stream", "mass"), ["host", "stream"])
    rows = each.withColumn("salt", F.xxhash64("stream"))
    for n in SALTS:
        rows = rows.withColumn("salt", F.pmod("salt", F.lit(n)).cast("long")).groupBy("host", "salt").applyInPandas(_fold_rows, f"{STREAMS}, salt long")
    return rows.drop("salt").mapInPandas(_finish, WRAPPERS).join(fixed, "host", "left")


def main_text(html: str, region: str | None, shell: frozenset[str] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """The text of one page, given its host's region, shells and template texts."""
    kept = [x for x in parse(html)[0] if x.kept]
    slot = [x.key not in fixed for x in kept] if fixed else [True] * len(kept)
    if region is None or not any(_inside(x.path, region) and not goes(x.path, shell) for x in kept):
        mass: Counter = Counter()
        for x, varies in zip(kept, slot, strict=True):
            if varies:
                mass[x.path] += x.loose
        if not mass:
            mass.update({x.path: 1 for x in kept})
        region, shell = region_of((), mass) if mass else ("", shell)
    found = [(x, varies) for x, varies in zip(kept, slot, strict=True) if _inside(x.path, region) and not goes(x.path, shell)]
    depth = region.count("/")
    if fixed and any(varies for _, varies in found):
        # of several elements that the region's path names, those with a slot that isn't all links; of what they contain, what holds a slot
        live = {box for x, varies in found if varies for box in x.boxes}
        full = {x.boxes[depth - 1] for x, varies in found if varies and x.loose and depth} or live
        found = [(x, varies) for x, varies in found if (not depth or x.boxes[depth - 1] in full) and all(box in live for box in x.boxes[depth:])]
    return "\n\n".join(x.text for x, _ in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b[c].to_pylist() for c in ("html", "region", "shells", "fixed"))
        texts = [main_text(h, r, frozenset(s or ()), frozenset(f or ())) for h, r, s, f in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    pages = _pages(df, id_col, url_col, html_col)
    known = materialize(wrappers(pages), "html-wrappers").select("host", "region", "shells", "fixed")
    both = _with_host(pages, known, F.xxhash64("url", "page_id")).select("page_id", "url", "html", "region", "shells", "fixed")
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
