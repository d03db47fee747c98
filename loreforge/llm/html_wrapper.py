"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of each host."""

from __future__ import annotations

import difflib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import attach, read_table, stored
from loreforge.llm.url_filter import host_of

#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul title head".split())
#: Elements whose content is text without markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the main text.
OUT = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object select style script svg template textarea title".split())
#: Elements that hold the main text.
MAIN = frozenset("article main".split())
#: Parts of class names, ids and roles that mark what isn't main text; those of the second row do so only outside it.
OUT_NAMES = re.compile(r"(?:^|[-_])(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|consent|cookies?|dialog|disqus|footer|gdpr|login|menu|modal|nav(?:bar|igation)?|newsletter|notices?|notification|pagination|pager|popup|promo\w*|related|replies|responses|search|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget|complementary|contentinfo)(?:$|[-_])")
OUT_NAMES_OUTSIDE = re.compile(r"(?:^|[-_])(?:header|masthead|topbar|site-name|logo|alert)(?:$|[-_])")

#: Within a main element a name marks only if all its parts are such words or these, which say how something is laid out: "comment-list"
#: is one of comments, "related-work" and "search-algorithms" are parts of an article.
LAYOUT_NAMES = re.compile(r"(?:area|bar|block|body|bottom|box|btn|button|buttons|card|cards|col|column|container|content|count|entry|feed|footer|form|group|head|header|heading|inner|item|items|js|left|link|links|list|meta|module|outer|panel|post|posts|right|row|section|stories|text|thread|title|top|user|view|wrap|wrapper|articles|media|slot|unit|\d+)?")

#: A text is part of the template if this share of the host's pages (and LEAST_PAGES) have it at its place; within the
#: element that names itself main, more of more, and only where most of that element's text differs.
SHARE, LEAST_PAGES, MAIN_SHARE, MAIN_PAGES = 0.5, 3, 0.9, 5
MASS = 0.7  # share of a host's differing text that its main container holds
BRANCH = 32  # expressions that one task aligns; more of a host are aligned in a tree
TEXTS = 64  # counters of a slot: texts of a greater share than one in so many are among them, whatever the order of merging
RARE = 0.01  # optional parts of a smaller share of pages leave the expression

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# ---------------------------------------------------------------- token streams


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """('<', element key), ('>', element) and ('#', text with references decoded); a key is the element with its class, id and role."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]  # the second form has a quote that isn't closed
        if name:
            name = name.lower()
            if m[1] or m[4]:
                yield ">", name
                continue
            attrs = m[3] or m[6] or ""
            names = sorted({w.lower() for _, a, b, c in _NAMES.findall(attrs) for w in (a or b or c).split()}) if "=" in attrs else []
            yield "<", ".".join([name, *names])
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                yield ">", name
            elif name in VOID or attrs.endswith("/"):
                if name not in VOID:
                    yield ">", name
        elif m[0][0] != "<" or m[0] == "<":
            yield "#", html_lib.unescape(m[0])


class Place(NamedTuple):
    """A container on the way to a text: a hash of the path, and what the names on it say."""

    path: int
    name: str
    out: bool
    main: bool


ROOT = Place(0, "", False, False)


def _path(parent: int, key: str) -> int:
    return xxhash.xxh3_64_intdigest(key, seed=parent) >> 1


def _layout(name: str) -> bool:
    return all(OUT_NAMES.search(x) or LAYOUT_NAMES.fullmatch(x) for x in re.split("[-_]+", name))


def enter(parent: Place, key: str) -> Place:
    """The place of an element in its parent: the element and its class names tell what is never or certainly main text.

    Within a main element names that have other parts as well say nothing; what is template there is found by the wrapper.
    """
    name, *names = key.split(".")
    marked = [x for x in names if OUT_NAMES.search(x)]
    out = parent.out or name in OUT or (any(map(_layout, marked)) if parent.main else bool(marked))
    out = out or not parent.main and (name == "header" or any(OUT_NAMES_OUTSIDE.search(x) for x in names))
    return Place(_path(parent.path, key), name, out, parent.main or name in MAIN or "main" in names)


class Text(NamedTuple):
    places: tuple[int, ...] | None  # paths of the containers it is in, outermost first, where they are asked for
    place: Place
    block: int
    text: str
    links: int  # characters of it within links


def events(page: str, chains: bool = False) -> Iterator[str | Text]:
    """Keys of containers and paragraphs, '/name' for ends of containers, and texts; ends of elements may be missing.

    Texts that follow one another in one block and container are one.
    """
    stack = [ROOT]
    open_ = Counter()
    block, in_link = 0, False
    parts: list[str] = []
    links = 0

    def text():
        nonlocal links
        out = Text(tuple(p.path for p in stack) if chains else None, stack[-1], block, "".join(parts), links)
        parts.clear()
        links = 0
        return out

    for kind, x in tokens(page):
        if kind == "#":
            parts.append(x)
            links += len(x) if in_link else 0
            continue
        name = x.partition(".")[0]
        if name == "a":
            in_link = kind == "<"
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS and name not in OUT:
            continue
        if parts:
            yield text()
        block += name in BLOCKS
        if name in VOID or name in ("p", "hr"):
            if kind == "<":
                yield x
        elif kind == "<":
            if name == "li":
                while stack[-1].name == "li":
                    open_[stack.pop().name] -= 1
                    yield "/li"
            stack.append(enter(stack[-1], x))
            open_[name] += 1
            yield x
        elif open_[name]:
            while True:
                top = stack.pop().name
                open_[top] -= 1
                yield "/" + top
                if top == name:
                    break
    if parts:
        yield text()


def squeezed(text: str) -> str:
    return " ".join(text.split())


def digest(text: str) -> str:
    return f"{xxhash.xxh3_64_intdigest(text):016x}"


def page_stream(page: str) -> list[dict]:
    """The page as tokens: s the form ('#' for a text), c the pages that have it, v the pages with each text, k the texts, n and l their characters in all and in links."""
    out: list[dict] = []
    for e in events(page):
        if isinstance(e, str):
            out.append({"s": e, "c": 1})
        elif t := squeezed(e.text):
            if out and out[-1]["s"] == "#":
                _add(out[-1], {"c": 0, "v": {digest(t): 1}, "k": 1, "n": len(t), "l": e.links})
            else:
                out.append({"s": "#", "c": 1, "v": {digest(t): 1}, "k": 1, "n": len(t), "l": e.links})
    return fold(out)


# ---------------------------------------------------------------- union-free regular expressions


def _add(a: dict, b: dict, pages: bool = True) -> dict:
    """a with b's counts; tokens of one form. Within one page a text counts once."""
    a["c"] += b["c"] if pages else 0
    if "v" in b:
        for k, n in b["v"].items():
            a["v"][k] = a["v"].get(k, 0) + n if pages else max(a["v"].get(k, 0), n)
        if "e" in b:
            a["e"] = a.get("e", 0) + b["e"]
        if len(a["v"]) > 2 * TEXTS:
            # counters lose as much as the first one over TEXTS holds (e: in all), so a frequent text can't be driven out
            cut = sorted(a["v"].values(), reverse=True)[TEXTS]
            a["v"], a["e"] = {k: n - cut for k, n in a["v"].items() if n > cut}, a.get("e", 0) + cut
        for k in ("k", "n", "l"):
            a[k] += b[k]
    if "g" in b:
        for x, y in zip(a["g"], b["g"], strict=True):
            _add(x, y, pages)
    return a


def _periods(forms: list[str], least: int, window: int = 64) -> list[int]:
    """Lengths from `least` on at which the sequence may repeat: distances between equal runs of tokens, near ones first."""
    ids = np.unique(np.array(forms, dtype=object).astype(str), return_inverse=True)[1].astype(np.uint64)
    width = min(window, least)
    if len(ids) < 2 * least:
        return []
    h = np.zeros(len(ids) - width + 1, dtype=np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k]
    order = np.argsort(h, kind="stable")
    found: set[int] = set()
    for step in range(1, 9):
        same = h[order[step:]] == h[order[:-step]]
        found |= set((order[step:] - order[:-step])[same].tolist())
    return sorted(d for d in found if d >= least)


def _balanced(body: list[str]) -> bool:
    """Whether a run of tokens ends each container that it begins, and no other: only such a run can repeat at one place."""
    depth = 0
    for s in body:
        if s[0] == "/":
            depth -= 1
        elif s[0] not in "#(" and (name := s.partition(".")[0]) not in VOID and name not in ("p", "hr"):
            depth += 1
        if depth < 0:
            return False
    return depth == 0


def fold(seq: list[dict], short: int = 64) -> list[dict]:
    """Repeats of a run of tokens become one group (...)+, short runs first; so a list of any length is one group.

    Lengths up to `short` are all tried, longer ones where equal runs of tokens stand that far apart.
    """
    size, longer = 1, None
    while 2 * size <= len(seq):
        forms = [t["s"] for t in seq]
        out: list[dict] = []
        i = 0
        while i < len(seq):
            body, j = forms[i : i + size], i + size
            while forms[j : j + size] == body and len(body) == size:
                j += size
            if j > i + size and _balanced(body):
                first = seq[i : i + size]
                for k in range(i + size, j, size):
                    for x, y in zip(first, seq[k : k + size], strict=True):
                        _add(x, y, pages=False)
                single = size == 1 and first[0]["s"].endswith(")+")
                out.append(first[0] if single else {"s": "(" + " ".join(body) + ")+", "c": 1, "g": first})
                i = j
            else:
                out.append(seq[i])
                i += 1
        # a new group may itself be part of a repeated run
        if len(out) < len(seq):
            size, longer = 1, None
        elif size < short:
            size += 1
        else:
            longer = _periods(forms, short + 1) if longer is None else longer
            longer = [d for d in longer if d > size]
            if not longer:
                return out
            size = longer[0]
        seq = out
    return seq


def _grouped(seq: list[dict], groups: list[dict]) -> list[dict]:
    """Single runs that the other side has as a repeated group become that group."""
    for group in groups:
        form, body = group["s"], [t["s"] for t in group["g"]]
        out, i, n = [], 0, len(body)
        while i < len(seq):
            run = seq[i : i + n]
            if seq[i]["s"] == form and not seq[i].get("o") or [t["s"] for t in run] == body and not any(t.get("o") for t in run):
                single = seq[i]["s"] != form
                t = {"s": form, "c": max(x["c"] for x in run), "g": run} if single else seq[i]
                if out and out[-1]["s"] == form:
                    _add(out[-1], t | {"c": 0}, pages=False)
                else:
                    out.append(t)
                i += n if single else 1
            else:
                out.append(seq[i])
                i += 1
        seq = out
    return seq


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """The union-free expression of two: tokens of one form stay (texts that differ make a slot), runs that one side lacks become optional (o)."""
    forms = lambda s: [t["s"] for t in s]
    if forms(a) != forms(b):
        groups = lambda s: [t for t in s if "g" in t and not any("g" in x for x in t["g"])]
        a, b = _grouped(a, groups(b)), _grouped(b, groups(a))
    if forms(a) == forms(b):
        return [_add(x, y) | ({"o": 1} if x.get("o") or y.get("o") else {}) for x, y in zip(a, b, strict=True)]
    out: list[dict] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, forms(a), forms(b), autojunk=False).get_opcodes():
        if op == "equal":
            out += [_add(x, y) | ({"o": 1} if x.get("o") or y.get("o") else {}) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [t | {"o": 1} for t in (*a[i:j], *b[k:m])]
    return out


def merged(streams: list[list[dict]], pages: int) -> list[dict]:
    """One expression of several; optional parts that under RARE of the pages have leave it (none of up to 100 pages)."""
    out = streams[0]
    for s in streams[1:]:
        out = align(out, s)
    return [t for t in out if not t.get("o") or t["c"] >= RARE * pages]


# ---------------------------------------------------------------- what of a wrapper is main text


def _slots(wrapper: list[dict]) -> Iterator[tuple[tuple[int, ...], Place, dict]]:
    """(paths of its containers, place, token) for each text token of a wrapper."""
    stack = [ROOT]

    def walk(seq):
        for t in seq:
            s = t["s"]
            if "g" in t:
                yield from walk(t["g"])
            elif s == "#":
                yield tuple(p.path for p in stack), stack[-1], t
            elif s[0] == "/":
                if any(p.name == s[1:] for p in stack):
                    while stack.pop().name != s[1:]:
                        pass
            elif (name := s.partition(".")[0]) not in VOID and name not in ("p", "hr"):
                stack.append(enter(stack[-1], s))

    yield from walk(wrapper)


def _needed(place: Place, pages: int) -> float:
    share, least = (MAIN_SHARE, MAIN_PAGES) if place.main else (SHARE, LEAST_PAGES)
    return max(least, share * pages)


def candidates(wrapper: list[dict], pages: int) -> list[list]:
    """[path, digest] of the texts that may be template: their counters at a path, with what these may have lost, reach the share.

    Optional parts can give a path several slots, which are taken together.
    """
    counted: dict[int, tuple[Place, Counter, int]] = {}
    for _, p, t in _slots(wrapper):
        place, n, lost = counted.get(p.path, (p, Counter(), 0))
        n.update(t["v"])
        counted[p.path] = (place, n, lost + t.get("e", 0))
    return sorted([path, d] for path, (place, n, lost) in counted.items() for d, c in n.items() if c + lost >= _needed(place, pages))


def decide(wrapper: list[dict], pages: int, counts: dict[tuple[int, str], int]) -> dict:
    """template: [path, digest] of texts that belong to the host's template; main: path of the container of most differing text.

    counts: pages that have a candidate text at its path. Texts at their place on SHARE of the pages are template. main counts
    where no element names itself so.
    """
    found = list(_slots(wrapper))
    template: list[list] = []
    fixed_of = lambda p, t, needed: [d for d in t["v"] if counts.get((p.path, d), 0) >= needed]
    inside = [(p, t) for _, p, t in found if p.main and not p.out]
    same = sum(t["n"] for p, t in inside if fixed_of(p, t, MAIN_SHARE * pages))
    differ = 2 * same <= sum(t["n"] for _, t in inside)
    mass: Counter = Counter()
    total = 0
    for chain, place, t in found:
        fixed = fixed_of(place, t, _needed(place, pages))
        if not place.main or differ:
            template += [[place.path, d] for d in fixed]
        if not place.out:
            plain = max(0, t["n"] - t["l"]) * max(0.0, 1 - sum(counts[place.path, d] for d in fixed) / t["k"])
            total += plain
            for p in dict.fromkeys(chain):
                mass[p] += plain
    main = None
    if pages >= LEAST_PAGES and total and not inside:
        depth = {p: k for chain, _, _ in found for k, p in enumerate(chain)}
        main = max((p for p, m in mass.items() if m >= MASS * total), key=lambda p: (depth[p], p), default=None)
    return {"template": template, "main": main}


def extract(page: str, model: dict) -> str:
    """The page's blocks of main text.

    Texts in elements that are never main text and texts of the template go. Of the others those in a main
    element stay, where the page has one; else those in the host's main container; else all. A page that the template
    covers as a whole keeps its texts.
    """
    main, template = model.get("main"), model["template"]
    got = [(e, t) for e in events(page, chains=main is not None) if isinstance(e, Text) and not e.place.out for t in [squeezed(e.text)]]
    own = [(e, t) for e, t in got if t]
    left = [(e, t) for e, t in own if (e.place.path, digest(t)) not in template] if template else own
    own = left or own
    if any(e.place.main for e, _ in own):
        own = [x for x in own if x[0].place.main]
    elif main is not None:
        own = [x for x in own if main in x[0].places] or own
    keep = {id(e) for e, _ in own}
    blocks: list[str] = []
    last = -1
    for e, _ in got:
        if id(e) in keep:
            if e.block == last:
                blocks[-1] += e.text
            else:
                blocks.append(e.text)
                last = e.block
    return "\n\n".join(x for x in map(squeezed, blocks) if x)


# ---------------------------------------------------------------- operator

_STREAMS = "host string, form string, stream string, pages long"


def _forms(stream: list[dict]) -> str:
    return digest(" ".join(t["s"] for t in stream))


def _page_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of pages; those of one host and form within a batch are added up at once."""
    for b in batches:
        sums: dict[tuple[str, str], tuple[list[dict], int]] = {}
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            s = page_stream(page or "")
            k = (host, _forms(s))
            old = sums.get(k)
            sums[k] = (s, 1) if old is None else (align(old[0], s), old[1] + 1)
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in keys], pa.string()), "form": pa.array([f for _, f in keys], pa.string()), "stream": pa.array([json.dumps(sums[k][0]) for k in keys], pa.string()), "pages": pa.array([sums[k][1] for k in keys], pa.int64())})


def _fold_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pages", "form"], ascending=[False, True])
    n = int(pdf["pages"].sum())
    w = merged([json.loads(s) for s in pdf["stream"]], n)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "form": [_forms(w)], "stream": [json.dumps(w)], "pages": [n]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, model): what each host's expression says, as JSON.

    Equal pages of a host count once. Pages become folded token streams, and those of one form are added up, in parts first.
    The expressions of a host are then aligned up to BRANCH in a task, most frequent first, in rounds until each
    host has one; the number of rounds grows with the logarithm of a host's forms.
    """
    distinct = pages.select("host", "html", F.xxhash64("html").alias("h")).dropDuplicates(["host", "h"]) if _has_copies(pages) else pages
    streams = stored(distinct.select("host", "html").mapInArrow(_page_streams, _STREAMS), "page-streams")
    # one form of one host may be a third of all rows: parts of it first
    part = F.pmod(F.xxhash64("stream"), F.lit(64))
    streams = streams.groupBy("host", "form", part.alias("part")).applyInPandas(_fold_group, _STREAMS)
    while True:
        streams = stored(streams, "host-expressions")
        sizes = stored(streams.groupBy("host").agg(F.count("*").alias("n")), "host-sizes")
        most = sizes.agg(F.max("n")).collect()[0][0] or 0
        if most <= 1:
            break
        parts = attach(streams, sizes.select("host", F.ceil(F.col("n") / BRANCH).alias("parts")), "host", "inner")
        parts = parts.withColumn("part", F.pmod(F.xxhash64("form", "stream"), F.col("parts")))
        streams = parts.select("host", "form", "stream", "pages", "part").groupBy("host", "part").applyInPandas(_fold_group, _STREAMS)

    def asked(batches):
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "asked": [json.dumps(candidates(json.loads(s), n)) for s, n in zip(pdf["stream"], pdf["pages"], strict=True)]})

    # counters tell which texts may be template; those are counted exactly, page by page
    wanted = streams.select("host", "stream", "pages").mapInPandas(asked, "host string, asked string").where("asked <> '[]'")
    hits = attach(distinct.select("host", "html"), wanted, "host", "inner").select("host", "html", "asked").mapInArrow(_page_hits, "host string, path long, digest string, n long")
    exact = hits.groupBy("host", "path", "digest").agg(F.sum("n").alias("n"))
    exact = stored(exact.groupBy("host").agg(F.collect_list(F.struct("path", "digest", "n")).alias("counts")), "host-templates")  # of a host's template

    def models(batches):
        for pdf in batches:
            counts = [{(r["path"], r["digest"]): r["n"] for r in c} if c is not None else {} for c in pdf["counts"]]
            yield pd.DataFrame({"host": pdf["host"], "model": [json.dumps(decide(json.loads(s), n, c)) for s, n, c in zip(pdf["stream"], pdf["pages"], counts, strict=True)]})

    both = streams.select("host", "stream", "pages").join(exact.hint("merge"), "host", "left")
    return both.mapInPandas(models, "host string, model string")


def _page_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, how many pages of a host have a candidate text at its path."""
    known: dict[str, set] = {}
    for b in batches:
        n: Counter = Counter()
        for host, page, asked in zip(*(b.column(c).to_pylist() for c in ("host", "html", "asked")), strict=True):
            if asked not in known:
                if len(known) > 10_000:
                    known.clear()
                known[asked] = {(p, d) for p, d in json.loads(asked)}
            texts = {(e.place.path, digest(t)) for e in events(page or "") if isinstance(e, Text) and (t := squeezed(e.text))}
            n.update((host, *x) for x in texts & known[asked])
        rows = list(n.items())
        yield pa.RecordBatch.from_pydict({c: pa.array([(*k, v)[i] for k, v in rows], t) for i, (c, t) in enumerate({"host": pa.string(), "path": pa.int64(), "digest": pa.string(), "n": pa.int64()}.items())})


def _has_copies(pages: DataFrame) -> bool:
    """Whether any host has a page twice: a count of hashes."""
    return pages.groupBy("host", F.xxhash64("html")).agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    Null html is an empty page, null URLs and those without :// are pages of the host ''. A page without main text has
    an empty one. Repeated rows give equal results, an empty table none; other columns are left out.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = infer_wrappers(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            out = []
            for page, model in zip(b.column("html").to_pylist(), b.column("model").to_pylist(), strict=True):
                if model not in known:
                    if len(known) > 10_000:
                        known.clear()
                    m = json.loads(model or '{"template": [], "main": null}')
                    known[model] = m | {"template": {(p, d) for p, d in m["template"]}}
                out.append(extract(page or "", known[model]))
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})

    joined = attach(pages, wrappers, "host").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "model")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_wrapper(spark, sf_dir) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
