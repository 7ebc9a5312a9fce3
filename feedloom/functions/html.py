"""Article texts, titles and images from HTML. Regular expressions serve snippets; whole pages are parsed, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif")


def is_likely_image(url: Column) -> Column:
    u = F.lower(F.trim(url))
    good = u.rlike(r"\.(?:jpg|jpeg|png|webp|gif)$") | F.contains(u, F.lit("/images/")) | F.contains(u, F.lit("cdn")) | F.contains(u, F.lit("image"))
    return (u != "") & ~u.startswith("data:") & ~u.endswith(".svg") & good


def largest_of_srcset(srcset: Column) -> Column:
    """The URL with the greatest width; the first of equals, and 0 for what isn't a width."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda x: F.trim(x)), lambda x: x != "")
    width = lambda x: F.coalesce(F.regexp_extract(x, r"^\S+\s+(-?\d+)w(?:\s|$)", 1).try_cast("int"), F.lit(0))
    rows = F.transform(parts, lambda x, i: F.struct(F.negative(width(x)).alias("w"), i.alias("i"), F.regexp_extract(x, r"^(\S+)", 1).alias("u")))
    return F.coalesce(F.get(F.array_sort(rows), F.lit(0))["u"], F.lit(""))


_QUOTE, _REST = "[\"']", "[^\"']+"
#: An image's attribute, as a regular expression for any name `a` of one.
_IMAGE = "(?i)<img[^>]+{a}=" + _QUOTE + "(" + _REST + ")" + _QUOTE + "[^>]*>"


def image_in_snippet(html: Column) -> Column:
    """The first image's URL: of srcset the first one, else data-src, else src; "" for none."""
    srcset, data, src = (F.regexp_extract(html, _IMAGE.format(a=a), 1) for a in ("srcset", "data-src", "src"))
    first = F.regexp_extract(F.substring_index(srcset, ",", 1), r"(\S+)", 1)
    return F.when(first != "", first).when(data != "", data).otherwise(src)


def item_image(enclosures: Column, description: Column, content: Column, page_image: Column) -> Column:
    """An enclosure that is an image by type or suffix, else an image in the description, the content, or the page's own."""
    fits = F.filter(enclosures, lambda e: (F.trim(e["url"]) != "") & (F.lower(e["type"]).startswith("image/") | F.lower(e["url"]).rlike(r"\.(?:jpg|jpeg|png|webp|gif)$")))
    choices = [F.get(fits, F.lit(0))["url"], image_in_snippet(description), image_in_snippet(content), page_image]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "order")

    def __init__(self, tag: str, attrs: dict, parent, order: int):
        self.tag, self.attrs, self.parent, self.parts, self.order = tag, attrs, parent, [], order

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Starting one of these ends an open paragraph.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.nodes: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close("p", _BLOCKS - {"p"})
        if tag == "li":
            self._close("li", frozenset({"ul", "ol"}))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, len(self.nodes))
        self.at.parts.append(node)
        self.nodes.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: frozenset) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            if n.tag in stop:
                return
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_endtag(self, tag):
        self._close(tag, frozenset() if tag != "p" else frozenset({"article", "div", "main", "section", "td"}))

    def handle_data(self, data):
        self.at.parts.append(data)


def _simple(node: Node, part: str) -> bool:
    """tag, .class, #id, tag[attribute] or tag[attribute=value]."""
    if "[" in part:
        tag, _, rest = part.partition("[")
        name, equal, value = rest.rstrip("]").partition("=")
        return (not tag or node.tag == tag) and name in node.attrs and (not equal or node.attrs[name] == value)
    if part.startswith("."):
        return part[1:] in node.attrs.get("class", "").split()
    if part.startswith("#"):
        return node.attrs.get("id") == part[1:]
    return node.tag == part


def select(nodes: list[Node], selector: str) -> list[Node]:
    """Nodes in the document's order that a selector of simple parts, each within the one before, matches."""
    *outer, last = selector.split()

    def within(node: Node) -> bool:
        k, n = len(outer) - 1, node.parent
        while k >= 0 and n is not None:
            if _simple(n, outer[k]):
                k -= 1
            n = n.parent
        return k < 0

    return [n for n in nodes if _simple(n, last) and within(n)]


NAVIGATION = tuple(
    "abonnement|annonce|cookie|del artikel|dr nyheder|følg|gdpr|log ind|læs også|nyhedsbrev|opdateret|opret|print|privatlivspolitik|publiceret|redigeret|reklame|se også|sponsor"
    "|amerikanske kongres|anden verdenskrig|beijing|den russiske præsident|dokumenter fra|føderale efterforskning|jeffrey epstein|kim jong-un|kinas hovedstad|militærparade|nordkoreas leder|sexforbryder|undersøger|vladimir putin".split("|")
)


def is_navigation(text: Column) -> Column:
    """Whether a paragraph leads elsewhere or belongs to another article."""
    return F.lower(text).rlike("|".join(NAVIGATION))




def _selectors(kinds: str) -> tuple[str, ...]:
    """Selectors of paragraphs: c:x in class x, i:x in the element with id x, t:x in tag x, and - anywhere."""
    mark = {"c": ".", "i": "#", "t": ""}
    return tuple("p" if k == "-" else f"{mark[k[0]]}{k[2:]} p" for k in kinds.split())


#: By site, as a part of the URL; the first that fits: selectors, least bytes of a paragraph (exclusive), and paragraphs that are enough.
SITES = (
    ("ekstrabladet.dk", _selectors("c:article-body c:article-content c:content t:article c:body-text"), 10, 1),
    ("tv2.dk", _selectors("c:article-body c:content t:article c:article-text"), 10, 1),
    ("bt.dk", _selectors("c:article-body c:content t:article"), 10, 1),
    ("", _selectors("t:article c:article c:content c:post-content c:entry-content t:main i:content c:text -"), 20, 3),
)
DR = ("article .dre-article-body p", *_selectors("c:dre-article-body t:article[data-article-id] c:article-content"), "main article p")
TITLES = "h1 title .article-title .headline .entry-title".split()


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _leads_away(s: str) -> bool:
    low = s.lower()
    return any(x in low for x in NAVIGATION)


def paragraphs(nodes: list[Node], url: str) -> list[str]:
    """The article's paragraphs; those found by several selectors stand several times, as they are gathered until there are enough."""
    found: list[str] = []
    if "dr.dk" in url:
        for selector in DR:
            good = [t for t in (n.text().strip() for n in select(nodes, selector)) if _bytes(t) >= 30 and not _leads_away(t)]
            found += good[:5]
            if len(found) >= 2:
                return found
        for n in select(nodes, "p"):
            if len(found) >= 3:
                break
            t = n.text().strip()
            if _bytes(t) > 50 and not _leads_away(t):
                found.append(t)
        return found
    _, selectors, least, enough = next(s for s in SITES if s[0] in url)
    for selector in selectors:
        found += [t for t in (n.text().strip() for n in select(nodes, selector)) if _bytes(t) > least]
        if len(found) >= enough:
            break
    return found


JUNK_PHRASES = (
    "På Ekstra Bladet lægger vi stor vægt " + "på at have en tæt dialog " + "med jer læsere",
    "Jeres input er guld værd, og mange " + "historier ville ikke kunne lade " + "sig gøre uden jeres tip",
    "Men selv om vi også har tradition " + "for at turde, når andre tier, " + "værner vi om en sober og " + "konstruktiv tone",
    *"Ekstra Bladet og evt. politianmeldt|DR Nyheder følger Danmarks Radio|Følg med på dr.dk".split("|"),
    *"Abonnement|Cookie|Del artiklen|Følg os på|GDPR|Gem artiklen|Hør mere:|Klik her for at|Log ind|Læs mere på|Læs også:|Opret bruger|Print artiklen|Privatlivspolitik|Se også:|Send til en ven|Tilmeld dig nyhedsbrevet|Video:".split("|"),
)
JUNK_LINES = tuple("annonce|cookie|del artikel|følg os|gdpr|gem artikel|klik her|læs mere|print|reklame".split("|"))
LONGEST, ENOUGH = 1800, 1600


def clean_text(content: str) -> str:
    """Paragraphs of more than 30 bytes, without tags and junk. A short line ends a paragraph, a junk line doesn't, a sentence's end does. A
    text of more than LONGEST bytes keeps the leading paragraphs that stay below ENOUGH, or stays whole if the first one doesn't."""
    import re

    for tag, to in (("<br>", " "), ("<br/>", " "), ("<p>", "\n\n"), ("</p>", "")):
        content = content.replace(tag, to)
    # What follows an opening bracket is within a tag until the next closing one, also where none comes.
    text = re.sub(r"<[^>]*(?:>|$)", "", content).replace(">", "").strip()
    for phrase in JUNK_PHRASES:
        text = text.replace(phrase, "")
    done: list[str] = []
    part = ""

    def end():
        nonlocal part
        if _bytes(part.strip()) > 30:
            done.append(part.strip())
        part = ""

    for line in (x.strip() for x in text.split("\n")):
        if _bytes(line) < 8:
            end()
        elif not any(x in line.lower() for x in JUNK_LINES):
            part = f"{part} {line}" if part else line
            if line.endswith((".", "!", "?")):
                end()
    end()
    out = re.sub("\n{3,}", "\n\n", re.sub(" {2,}", " ", "\n\n".join(done))).strip()
    if _bytes(out) > LONGEST:
        kept, total = [], 0
        for p in out.split("\n\n"):
            if total + _bytes(p) >= ENOUGH:
                break
            kept.append(p)
            total += _bytes(p) + 2
        out = "\n\n".join(kept) if kept else out
    return out


def title_of(nodes: list[Node]) -> str:
    for selector in TITLES:
        first = select(nodes, selector)[:1]
        if first and first[0].text().strip():
            return first[0].text().strip()
    return ""


def _likely(u: str) -> bool:
    u = u.strip().lower()
    return bool(u) and not u.startswith("data:") and not u.endswith(".svg") and (u.endswith(IMAGE_SUFFIXES) or "/images/" in u or "cdn" in u or "image" in u)


def _largest(srcset: str) -> str:
    best, width = "", -1
    for fields in (p.split() for p in srcset.split(",") if p.strip()):
        w = int(fields[1][:-1]) if len(fields) > 1 and fields[1].endswith("w") and fields[1][:-1].lstrip("-").isdigit() else 0
        if w > width:
            best, width = fields[0], w
    return best


def image_of(nodes: list[Node], page_url: str) -> str:
    """The page's image: declared for sharing, else the first in the article, the main part or anywhere; relative URLs are resolved."""

    def resolved(src: str) -> str:
        try:
            src = src.strip()
            return src if not src or urlsplit(src).scheme in ("http", "https") else urljoin(page_url, src)
        except ValueError:
            return ""

    declared = [("meta[property=og:image]", "content"), ("meta[property=og:image:url]", "content"), ("meta[property=og:image:secure_url]", "content")]
    choices = [(select(nodes, s)[:1], a) for s, a in declared]
    choices.append((sorted(select(nodes, "meta[name=twitter:image]") + select(nodes, "meta[name=twitter:image:src]"), key=lambda n: n.order)[:1], "content"))
    choices.append((select(nodes, "link[rel=image_src]")[:1], "href"))
    for found, attr in choices:
        if found and attr in found[0].attrs:
            url = resolved(found[0].attrs[attr])
            if url.startswith("http"):
                return url
    for selector in ("article img", "main img", "img"):
        for n in select(nodes, selector)[:1]:
            for attr in ("srcset", "data-src", "src"):
                if attr in n.attrs:
                    url = resolved(_largest(n.attrs[attr]) if attr == "srcset" else n.attrs[attr])
                    if url.startswith("http") and _likely(url):
                        return url
    return ""


def extract(html: str | None, url: str | None) -> tuple[str, str, str]:
    """Title, cleaned article and image of a page; a null page has none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes, url = tree.nodes, url or ""
    return title_of(nodes), clean_text("\n\n".join(paragraphs(nodes, url))), image_of(nodes, url)


def articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, article_title, article and image of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [extract(h, u) for u, h in zip(batch["url"], batch["html"])]
            yield pd.DataFrame({"url": batch["url"], **{k: [g[i] for g in got] for i, k in enumerate(("article_title", "article", "image"))}})

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, article_title string, article string, image string")


@F.pandas_udf(StringType())
def cleaned_article(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else clean_text(s))
