"""Main text of web pages by equivalence-class template deduction.

Tokens are elements in their place (the chain of names from the root, with class
or id). Over the pages of a host each token has an occurrence vector, its count on
every page; tokens with the same vector form an equivalence class. Classes whose
tokens stand once on a page, on most pages, and within one slot of the class
around them make up the host's template, the other classes nest in its slots.
What stands in the slots that hold the article is the page's text.

A vector is never gathered: its sum over pages of count times a hash of the page
stands for it, so a host of any size is summed like any other.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import append_columns, cut, quoted, read
from cairn.llm.registry import query

__all__ = ["deduce", "extract", "parse", "templates"]

#: A token is part of the template if it stands on this share of a host's pages.
SUPPORT = 0.5
#: Without a slot marked as the article, those are main that hold this share of the text of the largest one.
MAIN_SHARE = 0.3

# Element kinds of HTML, and words that name parts of a page in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
ASIDE = frozenset("head nav header footer aside form script style textarea title noscript template iframe button select option input menu dialog svg object canvas audio video label".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header masthead menu nav navbar navigation newsletter notice notices paywall pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": None, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
        "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
OTHER = re.compile(r"<!--(?:>|->|.*?-->|.*$)|<[!?][^>]*>?", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
NO_SIDE, SIDE, IN_MAIN = 0, 1, 2


class Element:
    __slots__ = ("name", "key", "parent", "label", "aside", "main", "inline")

    def __init__(self, name, key, parent, label, aside, main, inline):
        self.name, self.key, self.parent, self.label, self.aside, self.main, self.inline = name, key, parent, label, aside, main, inline


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def enter(parent: Element, name: str, attrs: str) -> Element:
    """The element's key is a hash of its parent's and of its name with class, id and role (numbers aside)."""
    label, words = name, set()
    if attrs and "=" in attrs:
        for what, *value in NAMES.findall(attrs):
            v = " ".join(sorted(DIGITS.sub("0", "".join(value).lower()).split()))
            label += f" {what.lower()}={v}"
            words.update(WORD.findall(v))
    main = parent.main or name in MAIN or bool(words & MAIN_WORDS)
    aside = parent.aside or (name in ASIDE and not (name == "header" and parent.main)) or (bool(words & ASIDE_WORDS) and name not in ("html", "body", *MAIN))
    return Element(name, signed(xxhash.xxh64_intdigest(f"{parent.key} {label}")), parent, label, aside, main, name in INLINE)


ROOT = Element("", 0, None, "", False, False, False)


def parse(page: str):
    """Yields (element, text, linked) in page order: a new element with text None,
    text inside an element, and (element, "", False) at the bounds of blocks."""
    at, n, stack = 0, len(page), [ROOT]
    lower = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield stack[-1], page[at:lt], any(e.name == "a" for e in stack[-3:])
            at = lt
            continue
        m = OTHER.match(page, at) if page[at + 1:at + 2] in ("!", "?") else TAG.match(page, at) or LOOSE.match(page, at)
        if not m:
            yield stack[-1], "<", False
            at += 1
            continue
        at = m.end()
        if m.re is OTHER:
            continue
        name = m[2].lower()
        if m[1]:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    stack.pop()
                if name not in INLINE:
                    yield stack[-1], "", False
                stack.pop()
            continue
        if name not in INLINE:
            yield stack[-1], "", False
            for depth in range(len(stack) - 1, 0, -1):  # an open paragraph or item ends here, with what is inside
                e = stack[depth]
                if e.name in ENDS and (name in ENDS[e.name] if ENDS[e.name] else True):
                    del stack[depth:]
                    break
                if not e.inline and e.name not in ENDS:
                    break
        elif name == "br":
            yield stack[-1], " ", False
        element = enter(stack[-1], name, m[3])
        yield element, None, False
        if name in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else page
            end = lower.find(f"</{name}", at)
            at = n if end < 0 else end
            if end >= 0:
                gt = page.find(">", at)
                at = n if gt < 0 else gt + 1
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(element)


class Token:
    __slots__ = ("parent", "kind", "count", "text", "link")

    def __init__(self, e: Element):
        self.parent, self.kind = e.parent.key if e.parent else 0, SIDE if e.aside else IN_MAIN if e.main else NO_SIDE
        self.count = self.text = self.link = 0


def tokens(page: str) -> dict[int, Token]:
    """By key, the tokens of a page with their counts and the lengths of their own
    and their linked text; key 0 is the page itself."""
    out: dict[int, Token] = {0: Token(ROOT)}
    out[0].count = 1
    for e, text, linked in parse(page):
        if text is None:
            out.setdefault(e.key, Token(e)).count += 1
        elif text and e.key in out:
            size = len(text.strip())
            out[e.key].text += size
            out[e.key].link += size * linked
    return out


def deduce(rows: list[tuple], pages: int) -> dict[int, bool]:
    """The slots of a template, by key: whether they hold the article.

    ``rows`` has (key, parent, kind, vector, pages with it, count in all, text,
    linked text) for each token.
    """
    parent = {r[0]: r[1] for r in rows}
    classes = defaultdict(list)
    for r in rows:
        if r[4] >= SUPPORT * pages:
            classes[r[3], r[4], r[5]].append(r)
    once = {0} | {r[0] for (_, df, total), c in classes.items() if df == total for r in c}

    def slot(key: int) -> int:
        while key and key not in once:
            key = parent.get(key, 0)
        return key

    for (_, df, total), c in classes.items():  # a class is valid if its outermost tokens stand in one slot
        own = {r[0] for r in c}
        if df == total and len({slot(r[1]) for r in c if r[1] not in own}) > 1 and df < pages:
            once -= own - {0}
    text: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for r in rows:
        s = text[slot(r[0])]
        s[0] += r[6]
        s[1] += r[7]
    kind = {0: NO_SIDE} | {r[0]: r[2] for r in rows}
    open_ = {k for k in once if kind[k] != SIDE}
    marked = {k for k in open_ if kind[k] == IN_MAIN}
    if any(text[k][0] for k in marked):
        return {k: k in marked for k in once}
    most = max((text[k][0] - 2 * text[k][1] for k in open_), default=0)
    return {k: k in open_ and text[k][0] > 0 and text[k][0] - 2 * text[k][1] >= MAIN_SHARE * most for k in once}


def extract(page: str, slots: dict[int, bool] | None) -> list[str]:
    """The blocks of the article: text in the main slots of the template; where
    those are not on the page, in those of a template of this page alone."""
    events = list(parse(page))
    for known in (slots, None):
        if known is None:
            known = deduce([(k, t.parent, t.kind, t.count, 1, t.count, t.text, t.link) for k, t in tokens(page).items()], 1)
        memory: dict[int, bool] = {}
        blocks: list[str] = []
        part: list[str] = []
        seen = False
        for e, text, _ in events:
            if text is None:
                continue
            if text == "":
                if part:
                    blocks.append("".join(part))
                    part = []
                continue
            if (keep := memory.get(e.key)) is None:
                f = e
                while f is not ROOT and f.key not in known:
                    f = f.parent
                keep = memory[e.key] = not e.aside and known.get(f.key, False)
            if keep:
                part.append(text)
                seen = True
        if part:
            blocks.append("".join(part))
        if seen:
            break
    return [b for b in (" ".join(entities.unescape(b).split()) for b in blocks) if b]


HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, keys, main): the slots of each host's template and whether they hold the article."""
    schema = T.StructType([T.StructField(c, T.LongType() if c not in ("host", "kind") else T.StringType() if c == "host" else T.IntegerType())
                           for c in ("host", "key", "parent", "kind", "vector", "pages", "count", "text", "link")])

    def run(batches):
        for b in batches:
            total: dict[tuple[str, int], list[int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = xxhash.xxh64_intdigest(page)
                for k, t in tokens(page).items():
                    x = total.setdefault((host, k), [t.parent, t.kind, 0, 0, 0, 0, 0])
                    x[2] = (x[2] + r * t.count) & (1 << 64) - 1
                    x[3] += 1
                    x[4] += t.count
                    x[5] += t.text
                    x[6] += t.link
            rows = [(h, k, v[0], v[1], signed(v[2]), *v[3:]) for (h, k), v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(zip(*rows))], names=schema.names)

    # sums of vectors wrap around: two halves are summed on their own, so no addition overflows
    low, high = F.col("vector").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("vector", 32)
    sums = cut(at_host(pages, url, html).mapInArrow(run, schema).groupBy("host", "key").agg(
        F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.sum(low).alias("low"), F.sum(high).alias("high"), *[F.sum(c).alias(c) for c in ("pages", "count", "text", "link")]))
    size = sums.filter("key = 0").select("host", F.col("pages").alias("all"))
    used = sums.join(size, "host").filter(F.col("pages") >= SUPPORT * F.col("all"))
    vector = F.concat_ws(" ", (F.col("high") + F.shiftright("low", 32)).bitwiseAND(0xFFFFFFFF), F.col("low").bitwiseAND(0xFFFFFFFF))
    row = F.struct("key", "parent", "kind", vector.alias("vector"), "pages", "count", "text", "link")
    lists = used.groupBy("host").agg(F.first("all").alias("all"), F.collect_list(row).alias("rows"))
    made = T.StructType([T.StructField("host", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("main", T.ArrayType(T.BooleanType()))])

    def decide(batches):
        for b in batches:
            slots = [deduce([tuple(r.values()) for r in rows], n) for n, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(s) for s in slots], pa.list_(pa.int64())), pa.array([list(s.values()) for s in slots], pa.list_(pa.bool_()))],
                                             names=made.names)

    return lists.mapInArrow(decide, made)


def at_host(pages: DataFrame, url: str, html: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(quoted(url).cast("string"), F.lit("")), HOST, 1))
    return pages.select(host.alias("host"), F.coalesce(quoted(html).cast("string"), F.lit("")).alias("html"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text``: the blocks of the article, character references
    decoded, white space in a block turned into one space, joined by newlines.

    Null or empty html gives an empty text. Pages without a host (null or odd
    urls) are deduced together. A page that lacks its host's main slots, or is the
    only one, is deduced by itself. Columns named ``text`` and ``host`` are replaced.
    """
    known = cut(templates(pages, url, html))
    name, keys, main = "_cairn_host", "_cairn_keys", "_cairn_main"
    host = F.lower(F.regexp_extract(F.coalesce(quoted(url).cast("string"), F.lit("")), HOST, 1))
    full = pages.drop("text", "host").withColumn(name, host).join(known.select(F.col("host").alias(name), F.col("keys").alias(keys), F.col("main").alias(main)), name, "left")
    made = T.StructType([T.StructField("text", T.StringType())])

    def fn(b: pa.RecordBatch) -> list:
        memory: dict[str, dict] = {}
        out = []
        for page, h, k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            if h not in memory:
                memory[h] = dict(zip(k.as_py() or [], m.as_py() or []))
            out.append("\n".join(extract(page or "", memory[h])))
        return [out]

    return append_columns(full, [html, name, keys, main], made, fn).drop(name, keys, main)


@query("op8_html_template")
def op8(spark, sf_dir):
    rows = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
