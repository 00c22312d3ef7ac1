"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page's tags and texts are a token stream with nested groups. Streams of one host are
aligned one after the other into an expression: equal groups match; a group that follows
one of its kind makes a repeated group; a mismatch is resolved by looking ahead on either
side, and what is skipped becomes an optional group; texts that differ become a slot, and
texts that never do stay fixed. Every task aligns its own pages of a host, so a host with
any share of the pages costs one small expression per task; these are aligned in two steps.

The expression tells which slots are the article: those inside article groups (the tag, else
a main part, else a group so named), or, where the host marks none, those outside menus,
headers, footers, sidebars, notices, adverts, forms and comments that are not mostly links. Text that is fixed on all pages of the host is template.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import attach, stage

#: Expressions that a task holds before it gives them out and begins anew.
HELD_HOSTS = 5000
#: A text is template if it is fixed on all of at least so many pages.
FIXED_PAGES = 3
SALTS = 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
_NEVER = frozenset(
    "script style textarea title xmp noembed noframes iframe head noscript template svg canvas object audio video math "
    "nav footer aside form button select option input label fieldset dialog menu".split()
)
#: What marks the article, from the surest mark to the least.
LEVELS = ("article", "main", "content")
#: Words of class, id and role that name parts which are not the article.
_NEVER_WORDS = frozenset(
    "ad ads adv adbox adslot adunit adbanner advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner "
    "sidebar aside nav navbar navigation menu menubar breadcrumb breadcrumbs comment comments commentlist disqus reply "
    "replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended footer masthead toolbar pager pagination "
    "widget copyright disclaimer complementary contentinfo search".split()
)
#: As these, but inside an article they head the article itself.
_HEAD_WORDS = frozenset("header topbar".split())
#: Words of parts that may hold articles other than the page's own.
_OTHERS_WORDS = frozenset("comment comments commentlist disqus reply replies respond related recommended sidebar widget".split())
#: A name that begins or ends so tells of the page's layout or state: "no-sidebar", "share-enabled".
_LAYOUT_FIRST = frozenset("has no with without".split())
_LAYOUT_LAST = frozenset("enabled disabled".split())
_WRAP_LAST = frozenset("wrap wrapper container".split())
_ARTICLE_WORDS = frozenset("article articlebody content main post entry story".split())
#: An open tag that ends an open one of these, as far as the nearest of the fences.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_FENCES = frozenset("html body table td th button object".split())


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[str, str, tuple[str, str] | None]:
    """The key of a group, and what it is: "never", one of ``LEVELS``, or "plain".

    Third, for a group that is "never" by its names alone: key and kind without these.
    """
    if tag in _NEVER:
        return tag, "never", None
    if tag in ("html", "body"):  # their names speak of the whole page
        return tag, "plain", None
    words: set[str] = set()
    #: Words of names that may speak of the part itself.
    own: set[str] = set()
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                for one in value.split():
                    found = [w.lower() for w in _NAME.findall(one)]
                    words.update(found)
                    if not _is_layout(found) and not (tag == "article" and len(found) > 1 and not _OTHERS_WORDS & set(found)):
                        own.update(found)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return f"{tag}!", "never", None
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return f"{tag}!", "never", None
    key = f"{tag}.{'.'.join(sorted(words))}" if words else tag
    if tag == "main" or (words == {"main"} and "role" in attributes):
        return key, "main", None
    kind = "article" if tag == "article" else "content" if words & _ARTICLE_WORDS else "plain"
    if own & _NEVER_WORDS or ((tag == "header" or own & _HEAD_WORDS) and not in_article):
        return f"{tag}.{min(own & (_NEVER_WORDS | _HEAD_WORDS), default='')}", "never", (key, kind)
    return key, kind, None


def _is_layout(name: list[str]) -> bool:
    if len(name) < 2:
        return False
    wraps = name[-1] in _WRAP_LAST and not _ARTICLE_WORDS.isdisjoint(name)
    return wraps or name[0] in _LAYOUT_FIRST or name[-1] in _LAYOUT_LAST


class Group:
    """A node of a page: its key, what it is, and its groups and texts in order."""

    __slots__ = ("instead", "key", "kind", "parts", "tag")

    def __init__(self, tag: str, key: str, kind: str, instead: tuple[str, str] | None = None) -> None:
        self.tag, self.key, self.kind, self.instead = tag, key, kind, instead
        self.parts: list[Group | tuple[str, bool]] = []


def parse(page: str | None) -> Group:
    """The groups of a page. Texts are (raw text, in a link); inline tags leave no group."""
    root = Group("", "", "plain")
    stack, inline, links, articles, named = [root], [], 0, 0, False
    page = page or ""
    at, size = 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal articles
        for group in stack[depth:]:
            articles -= group.kind in LEVELS
        del stack[depth:]

    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            if page[token.start()] != "<" or token.end() - token.start() == 1:
                stack[-1].parts.append((token[0], links > 0))
            continue
        tag = tag.lower()
        if token[1]:
            if tag in _INLINE:
                if tag == "a" and links:
                    links -= 1
                if inline and inline[-1][0] == tag and len(stack) > inline[-1][1]:
                    pop_to(inline.pop()[1])
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    links = 0
                    break
                if stack[depth].tag in _FENCES and tag not in ("body", "html", "table", "tr", "td", "th"):
                    break
            else:
                if tag == "p":
                    stack[-1].parts.append(Group("p", "p", "plain"))
            inline = [x for x in inline if x[1] < len(stack)]
            continue
        if tag == "br":
            stack[-1].parts.append((" ", False))
            continue
        attributes = token[3]
        if tag in _INLINE:
            if tag == "a":
                links = 1
            if "=" not in attributes and "hidden" not in attributes:
                continue
            key, kind, instead = _kind(tag, attributes, articles > 0)
            if kind != "never":
                continue
            if tag in _VOID:
                continue
            inline.append((tag, len(stack)))
        else:
            if tag in _ENDS:
                ended, fences = _ENDS[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in fences:
                        break
                    if stack[depth].tag in ended:
                        pop_to(depth)
                        if tag != "tr":
                            break
            elif tag not in _VOID:
                # Any other block ends an open paragraph.
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        pop_to(depth)
                        break
                    if stack[depth].tag in _FENCES:
                        break
            key, kind, instead = _kind(tag, attributes, articles > 0)
        group = Group(tag, key, kind, instead)
        named = named or instead is not None
        stack[-1].parts.append(group)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", end.start()) + 1 or size
            continue
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        articles += kind in LEVELS
        stack.append(group)
    if named:
        _take_back(root)
    return root


def _take_back(root: Group) -> None:
    """Names do not take the page's article away: without another one, its group is no "never" group.

    That is a group that holds an article or main part, or most of the page's text outside
    links. Parts that may hold others' articles (comments) do so only with most of the text.
    """
    if _holds(root, False):
        return
    whole = _unlinked(root)

    def visit(group: Group) -> None:
        for part in group.parts:
            if isinstance(part, tuple) or (part.kind == "never" and part.instead is None):
                continue
            if part.kind == "never":
                others = not _OTHERS_WORDS.isdisjoint(part.key.split("."))
                if not (_holds(part, True) and not others) and 2 * _unlinked(part) <= whole:
                    continue
                (part.key, part.kind), part.instead = part.instead, None
            visit(part)

    visit(root)


def _holds(group: Group, within_named: bool) -> bool:
    """Whether an article or main part lies in ``group``, also in parts that are "never" by name."""
    return any(
        (p.kind in ("article", "main"))
        or ((p.kind != "never" or (within_named and p.instead is not None)) and _holds(p, within_named))
        for p in group.parts
        if isinstance(p, Group)
    )


def _unlinked(group: Group) -> int:
    return sum(
        (0 if p[1] else len("".join(p[0].split())))
        if isinstance(p, tuple)
        else (0 if p.kind == "never" and p.instead is None else _unlinked(p))
        for p in group.parts
    )


# An expression is [key, kind, flags, pages, chars, link chars, text, parts]: flags 1 optional,
# 2 repeated; text is None (no text), a number (always this one) or "" (a slot). The last
# value counts the pages that have a text here: where it is less than all, the text is optional.
_KEY, _KIND, _FLAGS, _PAGES, _CHARS, _LINKED, _TEXT, _PARTS, _WITH_TEXT = range(9)
OPTIONAL, REPEATED = 1, 2


def expression(group: Group) -> list:
    """A page's own expression: neighbours of one key are folded into repeated groups."""
    texts = [t for t in group.parts if isinstance(t, tuple)]
    joined = " ".join("".join(t for t, _ in texts).split())
    linked = sum(len(t) for t, in_link in texts if in_link)
    out = [group.key, group.kind, 0, 1, len(joined), min(linked, len(joined)), hash_text(joined) if joined else None, [], int(bool(joined))]
    parts = out[_PARTS]
    if group.kind == "never":
        return out
    for part in group.parts:
        if isinstance(part, Group):
            made = expression(part)
            if parts and parts[-1][_KEY] == made[_KEY]:
                parts[-1] = align(parts[-1], made, 1)
                parts[-1][_FLAGS] |= REPEATED
            else:
                parts.append(made)
    return out


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace")) << 20 | len(text) & 0xFFFFF


def align(a: list, b: list, pages: int | None = None) -> list:
    """The expression that both match; ``pages`` if both are of the same page."""
    if a[_TEXT] is None or b[_TEXT] is None:
        text = a[_TEXT] if b[_TEXT] is None else b[_TEXT]
    else:
        text = a[_TEXT] if a[_TEXT] == b[_TEXT] else ""
    out = [
        a[_KEY],
        a[_KIND],
        a[_FLAGS] | b[_FLAGS],
        pages or a[_PAGES] + b[_PAGES],
        a[_CHARS] + b[_CHARS],
        a[_LINKED] + b[_LINKED],
        text,
        [],
        max(a[_WITH_TEXT], b[_WITH_TEXT]) if pages else a[_WITH_TEXT] + b[_WITH_TEXT],
    ]
    left, right, parts = a[_PARTS], b[_PARTS], out[_PARTS]
    i = j = 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i][_KEY] == right[j][_KEY]:
            parts.append(align(left[i], right[j], pages))
            i, j = i + 1, j + 1
            continue
        # Look ahead on either side for the other side's group; the shorter skip is optional.
        ahead_left = next((k for k in range(i, len(left)) if j < len(right) and left[k][_KEY] == right[j][_KEY]), None)
        ahead_right = next((k for k in range(j, len(right)) if i < len(left) and right[k][_KEY] == left[i][_KEY]), None)
        if j >= len(right) or (
            i < len(left) and ahead_left is not None and (ahead_right is None or ahead_left - i <= ahead_right - j)
        ):
            stop = ahead_left if j < len(right) else len(left)
            parts += [_optional(x) for x in left[i:stop]]
            i = stop
        else:
            # Without a match ahead one group is skipped, so that later ones can still meet.
            stop = ahead_right if ahead_right is not None else (j + 1 if i < len(left) else len(right))
            parts += [_optional(x) for x in right[j:stop]]
            j = stop
    out[_PARTS] = _fold(parts, pages)
    return out


def _optional(x: list) -> list:
    return [*x[:_FLAGS], x[_FLAGS] | OPTIONAL, *x[_FLAGS + 1 :]]


def _fold(parts: list[list], pages: int | None) -> list[list]:
    """Neighbours of one key, as alignment may leave them, become one repeated group."""
    out: list[list] = []
    for part in parts:
        if out and out[-1][_KEY] == part[_KEY]:
            out[-1] = align(out[-1], part, pages or max(out[-1][_PAGES], part[_PAGES]))
            out[-1][_FLAGS] |= REPEATED
        else:
            out.append(part)
    return out


class Wrapper:
    """A host's expression, ready to be applied: which groups' texts belong to the article."""

    def __init__(self, host: list) -> None:
        self.host = host
        pages = max(1, host[_PAGES])
        #: The surest mark of the article that at least half of the host's pages have, or None.
        self.level = next((level for level in LEVELS if 2 * _pages_with(host, level) >= pages), None)
        self.drops_fixed = pages >= FIXED_PAGES and self._varies(host, False)

    def _varies(self, x: list, inside: bool) -> bool:
        if x[_KIND] == "never":
            return False
        inside = inside or self.level in (None, x[_KIND])
        return (inside and x[_TEXT] == "") or any(self._varies(p, inside) for p in x[_PARTS])

    def is_template(self, x: list | None) -> bool:
        return bool(x) and self.drops_fixed and isinstance(x[_TEXT], int) and x[_WITH_TEXT] >= self.host[_PAGES] and not x[_FLAGS]

    def is_linked(self, x: list | None) -> bool:
        """Mostly links: a menu that no name gives away."""
        return bool(x) and 10 * x[_LINKED] > 6 * x[_CHARS] > 0

    def text(self, page: Group) -> str:
        """The article's blocks, one per line; a page without the host's mark is read as if there were none."""
        blocks: list[str] = []
        for level in (self.level, None) if self.level else (None,):
            run: list[str] = []
            self._read(page, self.host, level is None, level, blocks, run)
            _close(run, blocks)
            if blocks:
                break
        return "\n".join(blocks)

    def _read(
        self, group: Group, known: list | None, inside: bool, level: str | None, blocks: list[str], run: list[str]
    ) -> None:
        template = self.is_template(known) or (level is None and self.is_linked(known))
        groups = known[_PARTS] if known else []
        at = 0
        for part in group.parts:
            if isinstance(part, tuple):
                if inside and not template:
                    run.append(part[0])
                continue
            # Tokens and expression go on together; optional groups may be passed over.
            meet = next((k for k in range(at, len(groups)) if groups[k][_KEY] == part.key), None)
            if meet is None:
                meet = next((k for k in range(at) if groups[k][_KEY] == part.key), None)
            else:
                at = meet
            if part.tag not in _INLINE:
                _close(run, blocks)
            if part.kind == "never":
                continue
            self._read(
                part, groups[meet] if meet is not None else None, inside or part.kind == level, level, blocks, run
            )
            _close(run, blocks)


def _pages_with(x: list, level: str) -> int:
    if x[_KIND] == "never":
        return 0
    return x[_PAGES] if x[_KIND] == level else max((_pages_with(p, level) for p in x[_PARTS]), default=0)


def _close(run: list[str], blocks: list[str]) -> None:
    if run:
        block = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if block:
            blocks.append(block)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; an empty string without one."""
    host = F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (the expression as JSON) and n_pages of every host in ``pages`` (host, html)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(x), x[_PAGES]) for h, x in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist([{"host": h, "wrapper": w, "n_pages": n} for h, w, n in rows], _WRAPPERS)

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                own = expression(parse(page.as_py()))
                held[host] = align(held[host], own) if host in held else own
                if len(held) > HELD_HOSTS:
                    yield out()
        yield out()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        merged = None
        for wrapper in sorted(rows["wrapper"]):
            own = json.loads(wrapper)
            merged = own if merged is None else align(merged, own)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(merged)], "n_pages": [merged[_PAGES]]})

    kinds = "host string, wrapper string, n_pages long"
    first = pages.select("host", "html").mapInArrow(local, kinds)
    salted = first.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt"))
    return salted.applyInPandas(merge, kinds).groupBy("host").applyInPandas(merge, kinds)


_WRAPPERS = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n_pages", pa.int64())])


@lru_cache(maxsize=256)
def _wrapper(text: str) -> Wrapper:
    return Wrapper(json.loads(text))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Reads page_id, url and html; other columns are ignored. White space inside a block
    becomes one space; blocks are joined by one line feed. A null or empty html has an empty
    text; pages without a host share a wrapper; a null page_id or url stays null; repeated
    rows are extracted each; an empty table gives no rows.
    """
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    wrappers = stage(infer_wrappers(slim), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _wrapper(w.as_py()).text(parse(page.as_py()))
                for page, w in zip(batch.column("html"), batch.column("wrapper"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    made = attach(slim, wrappers, "host", "n_pages").mapInArrow(run, "page_id long, url string, text string")
    return made.withColumn("n_chars", F.length("text").cast("long"))
