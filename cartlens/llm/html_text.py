"""Main text of web pages by consensus paths: containers are scored per page, hosts vote, pages are read again.

A page is a tree of containers; a container's path is the tags from the root with their classes, digits made alike.
Every page gives each of its containers a share of its running text (links count against it). The shares are summed by
host and path, and the path with most votes is the host's article path. Pages are then read again at the article or
main element around that path, or, without one, at the container above it that adds little but title and lead. A page
that holds less than half of its text there uses its own best container, unless that one is common on the host and
mostly not the best: a side bar.

Markup is read by the states of the HTML standard, in one pass without going back, with its rules for optional end
tags, raw text and markup that never ends; elements deeper than ``MAX_DEPTH`` count as part of the one there.
Menus, headers, footers, side bars, notices, adverts, forms, comments and scripts are cut out by tag, role and class.
A class counts by its last word before words of layout ("author-comment-list", "post-ad-block", not "has-sidebar" or
"notice-period"), and what holds most of a page's text, and the page's article or heading if it has one, is not cut for
its class, role or form.
Votes are small integers, summed before they are shuffled; the winning paths are broadcast only if they are few, else
joined, where adaptive execution splits a hot host.

Defined cases: null or empty html gives an empty text. Pages with a null or unreadable url have no host in
common; each uses its own best container. Pages that repeat are each read. Ties between paths go to the path that sorts
last. What stands behind a comment, tag or quoted value that never ends is lost, as in a browser. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import table, wrapped
from cartlens.session import checkpointed

# Beyond so many hosts, their paths are joined, not broadcast.
BROADCAST_HOSTS = 20_000

CONTAINERS = frozenset("html body main article section div td center blockquote ul ol dl table tbody tr".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre th thead tfoot caption figure figcaption address hr header footer nav aside form "
    "fieldset details summary dialog menu".split()
)
CUT_TAGS = frozenset(
    "head nav footer aside form button select option dialog menu iframe object svg canvas audio video noscript "
    "template fieldset label input".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# Words of a class or id that mark what is no article text.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription sidebar sidenav menu nav navbar navigation "
    "topbar breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies discussion share "
    "sharing social related recommended widget login signup toolbar pagination pager".split()
)
# First words by which a class speaks of something else on the page ("has-sidebar").
MODIFIERS = frozenset("has have with no not without is show hide non".split())
ANCHORS = frozenset("article main h1".split())
# A path on fewer than one in so many pages of a host says nothing about the host.
COMMON = 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# A tag looks for the element it ends no further than this.
SCOPE = frozenset("html body table ul ol dl article section main div".split())

# Elements that may stand in a head; any other one, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript noframes".split())
# Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Words of layout at the end of a class, which do not say what the element is.
LAYOUT = frozenset(
    "area bar bars banner block blocks body bottom box boxes btn button buttons card cards col column container content desktop float grid "
    "group head header heading holder icon icons image img inline inner item items label large left link links list lists main mobile module "
    "outer panel posts articles stories primary right row secondary section side slot small sticky strip tab text title top unit units user users "
    "widget widgets wrap wrapper form message messages thread".split()
)
MAX_DEPTH = 512

_TAG_NAME = re.compile(r"[^\s/>]*").match
_BEFORE_ATTRIBUTE = re.compile(r"[\s/]*").match
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*").match
_EQUALS = re.compile(r"\s*=\s*").match
_UNQUOTED = re.compile(r"[^\s>]*").match


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``at`` on, the first of each name, and where the tag ends; -1 if it never does."""
    found: dict[str, str] = {}
    while True:
        at = _BEFORE_ATTRIBUTE(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE_NAME(page, at)
        at, value, equals = name.end(), "", _EQUALS(page, name.end())
        if equals:
            at = equals.end()
            if page[at : at + 1] in ("'", '"') and at < len(page):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                value = _UNQUOTED(page, at).group()
                at += len(value)
        found.setdefault(name.group().lower(), value)


def markup(page: str):
    """(text before it, tag, whether it is an end tag, attributes) of every tag; tag None for the text at the end.

    Comments, declarations and the content of raw elements are left out. Every character is looked at once.
    """
    lower, at, texts = page.lower(), 0, []
    if len(lower) != len(page):  # a few letters get longer in lower case
        lower = "".join(c.lower() if c.isascii() else c for c in page)
    while True:
        start = page.find("<", at)
        if start < 0 or start + 1 >= len(page):
            texts.append(page[at:])
            break
        texts.append(page[at:start])
        second = page[start + 1]
        closing = second == "/"
        first = page[start + 2 : start + 3] if closing else second
        if first.isascii() and first.isalpha():
            name = _TAG_NAME(lower, start + 1 + closing)
            attributes, at = _attributes(page, name.end())
            if at < 0:
                break
            yield "".join(texts), name.group(), closing, attributes
            texts = []
            if not closing and name.group() in RAW:
                mark, end = f"</{name.group()}", lower.find(f"</{name.group()}", at)
                while end >= 0 and lower[end + len(mark) : end + len(mark) + 1] not in (*"> /\t\n\r\f", ""):
                    end = lower.find(mark, end + 1)
                if end < 0:
                    break
                yield "", name.group(), True, {}
                at = page.find(">", end) + 1
                if not at:
                    break
        elif page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                at = page.find(">", start) + 1
                continue
            end = page.find("-->", start + 4)
            if end < 0:
                break
            at = end + 3
        elif second in "!?" or closing:
            end = page.find(">", start)
            if end < 0:
                break
            at = end + 1
        else:
            texts.append("<")
            at = start + 1
    yield "".join(texts), None, False, {}


class _Open:
    """An open element: its path, whether it or one above it is cut out, whether it is inside a link, and the numbers
    of the elements at or above it that are cut out unless they hold most of the text."""

    __slots__ = ("tag", "path", "cut", "link", "article", "doubts")

    def __init__(self, tag, path, cut, link, article, doubts=()):
        self.tag, self.path, self.cut, self.link, self.article, self.doubts = tag, path, cut, link, article, doubts


def _cut_name(names: str) -> bool:
    """Whether the last word before words of layout, in a class or id of ``names``, says that it is no article text."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if len(w) > 1]
        if words and words[0] in MODIFIERS:
            continue
        while words and words[-1] in LAYOUT and words[-1] not in CUT_WORDS:
            words.pop()
        if words and words[-1] in CUT_WORDS:
            return True
    return False


def _opened(tag: str, found: dict[str, str], above: _Open, number: int) -> _Open:
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    article = above.article or tag in ("article", "main")
    cut = (
        above.cut or (tag in CUT_TAGS and tag != "form") or (tag == "header" and not above.article)
        or "hidden" in found
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    )
    doubt = tag == "form" or (tag not in ("html", "body") and (
        found.get("role", "").lower() in CUT_ROLES or found.get("aria-hidden", "").lower() == "true" or _cut_name(names)
    ))
    # Inside a block there is no doubt.
    cut = cut or (doubt and tag not in BLOCKS)
    doubts = (*above.doubts, number) if doubt and not cut else above.doubts
    path = above.path
    if tag in CONTAINERS:
        classes = sorted(set(re.sub(r"\d+", "0", found.get("class", "").lower()).replace("/", "_").split()))
        path = f"{path}/{'.'.join([tag, *classes])}"
    return _Open(tag, path, cut, above.link or tag == "a", article, doubts)


def blocks(page: str | None):
    """(paths of the container and those above it, text, characters in links) of the blocks outside what is cut."""
    page = page or ""
    root = _Open("", "", False, False, False)
    stack, parts, linked, out, anchors = [root], [], 0, [], []
    opened: Counter[str] = Counter()

    def close(n: int):
        for element in stack[n:]:
            opened[element.tag] -= 1
        del stack[n:]

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1].path, text, min(linked, len(text)), stack[-1].doubts))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        top = stack[-1]
        if raw and not top.cut:
            text = html.unescape(raw)
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    for number, (text, tag, closing, attributes) in enumerate(markup(page)):
        if stack[-1].tag == "head" and ((text and not text.isspace()) or (tag and not closing and tag not in IN_HEAD)):
            close(len(stack) - 1)
        add(text)
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            if not stack[-1].cut:
                parts.append(" ")
            continue
        if closing:
            if opened[tag] > 0:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        close(n)
                        break
                    if not block and stack[n].tag in BLOCKS:
                        break  # an inline end tag does not close a block
            continue
        if tag in VOID:
            continue
        if block:
            ends = ENDS.get(tag, frozenset())
            if opened["p"] > 0 or any(opened[e] > 0 for e in ends):
                for n in range(len(stack) - 1, 0, -1):
                    name = stack[n].tag
                    if name in ends or name == "p":
                        close(n)
                        if name != "tr":
                            break
                    if name in SCOPE:
                        break
        if len(stack) >= MAX_DEPTH:
            continue
        stack.append(_opened(tag, attributes, stack[-1], number))
        opened[tag] += 1
        if tag in ANCHORS and not stack[-1].cut:
            anchors.append(stack[-1].doubts)
    flush()
    held = Counter()
    for _, text, _, doubts in out:
        held.update(dict.fromkeys(doubts, len(text)))
    total = sum(len(text) for _, text, _, _ in out)
    gone = {n for n, size in held.items() if 2 * size <= total or (anchors and not any(n in a for a in anchors))}
    return [(path, text, n) for path, text, n, doubts in out if gone.isdisjoint(doubts)]


def _above(path: str):
    """The path itself and all paths above it."""
    while path:
        yield path
        path = path.rpartition("/")[0]
    yield ""


def votes(page: str | None) -> list[tuple[str, int]]:
    """(path, share in thousandths) of the containers of a page, by the running text directly in them.

    A container passes a third of its score to the one above it, so that text split over several
    parts is found together. An article element counts double.
    """
    return _shares(blocks(page))


def _shares(found: list[tuple[str, str, int]]) -> list[tuple[str, int]]:
    scores: dict[str, float] = {}
    for path, text, linked in found:
        score = max(0, len(text) - 3 * linked)
        for level, p in zip(range(3), _above(path)):
            bonus = 2 if _tag(p) in ("article", "main") else 1
            scores[p] = scores.get(p, 0.0) + bonus * score / 3**level
    total = sum(scores.values())
    return [(p, round(1000 * s / total)) for p, s in sorted(scores.items())] if total else []


def _tag(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0]


def _best(shares: list[tuple[str, int]]) -> str:
    return max(shares, key=lambda v: (v[1], v[0]), default=("", 0))[0]


def _inside(found: list[tuple[str, str, int]], path: str) -> list[tuple[str, str, int]]:
    return [b for b in found if b[0] == path or b[0].startswith(f"{path}/")]


def _running(found: list[tuple[str, str, int]]) -> int:
    return sum(max(0, len(text) - 3 * linked) for _, text, linked in found)


def lifted(found: list[tuple[str, str, int]], path: str) -> str:
    """The nearest article or main element at or above ``path``; without one, the container above it, below the body,
    whose other text is at most a quarter of what ``path`` holds and not mostly links."""
    for p in _above(path):
        if _tag(p) in ("article", "main"):
            return p
    # Characters, and those in links, by path: pages have few paths.
    held: dict[str, list[int]] = {}
    for p, text, linked in found:
        sums = held.setdefault(p, [0, 0])
        sums[0] += len(text)
        sums[1] += linked

    def inside(at: str) -> tuple[int, int]:
        parts = [v for p, v in held.items() if p == at or p.startswith(f"{at}/")]
        return sum(v[0] for v in parts), sum(v[1] for v in parts)

    mine, parent = inside(path), path.rpartition("/")[0]
    while _tag(parent) not in ("", "html", "body"):
        both = inside(parent)
        more, links = both[0] - mine[0], both[1] - mine[1]
        if 4 * more > mine[0] or 2 * links > more:
            break
        path, parent, mine = parent, parent.rpartition("/")[0], both
    return path


def extract(page: str | None, path: str | None, rejected=()) -> str:
    """The text around ``path``, or, where the page has nothing there, around its own best container; also where it
    has less than half of its text there, unless that container is one of the host's ``rejected`` ones."""
    found = blocks(page)
    own = _inside(found, path) and _inside(found, lifted(found, path)) if path is not None else []
    if found and (not own or 2 * _running(own) < _running(found)):
        best = _best(_shares(found))
        if not own or best not in rejected:
            other = _inside(found, lifted(found, best))
            own = other if not own or _running(other) > _running(own) else own
    return "\n".join(text for _, text, _ in own)


def _votes_of(page):
    def ballot(x):
        shares = votes(x)
        best = _best(shares)
        return [{"path": p, "share": s, "best": int(p == best)} for p, s in shares]

    @F.pandas_udf("array<struct<path:string,share:bigint,best:bigint>>")
    def udf(pages: pd.Series) -> pd.Series:
        return pd.Series([ballot(x) for x in pages], dtype=object)

    return udf(page)


def _extracted(page, path, rejected):
    @F.pandas_udf("string")
    def udf(pages: pd.Series, paths: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series(
            [extract(x, p, () if r is None else set(r)) for x, p, r in zip(pages, paths, others)], dtype=object
        )

    return udf(page, path, rejected)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, rejected): the path each host's pages vote for, and the common ones that are mostly not the best."""
    ballots = pages.select(_host(F.col(url)).alias("host"), F.explode(_votes_of(F.col(page))).alias("v")).where("host <> ''")
    counted = checkpointed(ballots.groupBy("host", "v.path").agg(
        F.sum("v.share").alias("votes"), F.count(F.lit(1)).alias("n"), F.sum("v.best").alias("best")
    ))
    winners = counted.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("w"), F.sum("best").alias("pages"))
    # A page has few paths, so few can be common.
    losers = (
        counted.join(winners.select("host", "pages"), "host").where((F.col("n") * COMMON >= F.col("pages")) & (F.col("best") * 2 <= F.col("n")))
        .groupBy("host").agg(F.collect_list("path").alias("rejected"))
    )
    return winners.join(losers, "host", "left").select("host", F.col("w.path").alias("path"), "rejected")


def main_texts(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` as struct ``row``, beside ``host``, ``path`` and ``main_text``."""
    winners = checkpointed(host_paths(pages, url, page))
    few = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = wrapped(pages, _page=page, _url=url).withColumn("host", _host(F.col("_url")))
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left")
    return joined.select("row", "host", "path", _extracted(F.col("_page"), F.col("path"), F.col("rejected")).alias("main_text"))


def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the main text of every page."""
    found = main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "row.page_id", "row.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")
    )
