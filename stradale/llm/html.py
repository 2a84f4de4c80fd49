"""Main text of HTML by the line-block distribution.

Markup is stripped into lines, one for each block of the page (paragraph, heading, list item, cell
and so on), in page order. Lines of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments stay in the sequence as empty lines, as do lines that are mostly links. A line
weighs its length; where the page names its article (<article>, <main>), lines in it weigh SURGE
more and lines outside it nothing. Weights are summed over sliding windows of WINDOW lines. The text
surges where a sum reaches the page's threshold and dives where the sums fall to nothing; a surge
reaches back to the last such dive, so that a short heading stays with its text. All lines with a
weight between two dives are kept if the text surges between them. On a page that never surges,
which has short lines only, all lines with a weight are kept.

Defined cases: a null or empty page, or one without text, gives the empty text; unclosed and
truncated markup is read to the end of the page; repeated rows get equal results; no row is dropped.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from .common import map_texts

# --- fixed values: element and attribute names -----------------------------------------------------
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "head"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILER_WORDS = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "rail", "related", "replies",
    "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "topbar", "topnav", "sidenav", "subnav", "widget", "alert", "announcement", "notification", "disclaimer", "recommended", "trending",
}
PAGE_HEADER = {"header"}  # as a class or id word, outside an article only
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
# ----------------------------------------------------------------------------------------------------

#: Lines of a window, and the bounds of a page's threshold (characters in a window).
WINDOW, QUIET, SURGE = 3, 40, 120
#: A quote opens a value only after an equals sign; every tag ends at `>` or at the page's end, so a scan never goes back.
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
ATTR = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CLOSED_BY = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def boiler(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no part of an article, by its name and attributes."""
    if name in BOILER_TAGS or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in ATTR.finditer(attrs):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k in ("class", "id"):
            words = {w.lower() for w in WORDS.findall(v)}
            if words & BOILER_WORDS or (name in ("div", "section") and not in_article and words & PAGE_HEADER):
                return True
        if k == "role" and v.lower() in BOILER_ROLES or k == "hidden" or k == "aria-hidden" and v.lower() == "true":
            return True
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, in an article, boilerplate) of each block in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    opened: dict[str, int] = {}  # how often a name is on the stack
    skip = article = link = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            t = entities.unescape(raw)
            parts.append(t)
            if link:
                linked += len(t)

    def flush() -> None:
        nonlocal linked
        t = " ".join("".join(parts).split())
        parts.clear()
        if t:
            out.append(("", 0, False, True) if skip else (t, min(linked, len(t)), article > 0, False))
        linked = 0

    def pop() -> str:
        nonlocal skip, article, link
        name, bad, art = stack.pop()
        opened[name] -= 1
        skip -= bad
        article -= art
        link -= name == "a"
        return name

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if m["end"]:
            if opened.get(name):
                while True:
                    inner = stack[-1][0]
                    if inner not in INLINE:
                        flush()
                    if pop() == name:
                        break
            continue
        if name in RAW:
            e = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = e.end() if e else n
            continue
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if name in CLOSED_BY and any(x[0] == name for x in stack[-3:]):
            # an open element of this kind ends here, and inline elements left open in it
            k = max(i for i in range(max(0, len(stack) - 3), len(stack)) if stack[i][0] == name)
            if all(x[0] in INLINE for x in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
        bad = boiler(name, m["attrs"], article > 0)
        art = name in ("article", "main")
        stack.append((name, bad, art))
        opened[name] = opened.get(name, 0) + 1
        skip += bad
        article += art
        link += name == "a"
    flush()
    return out


def weights(found: list[tuple[str, int, bool, bool]]) -> list[int]:
    """What each line weighs: nothing, its length, or more within the page's article."""
    zone = any(a and not bad for _, _, a, bad in found)
    if zone:
        return [len(t) + SURGE if a and not bad else 0 for t, _, a, bad in found]
    return [0 if bad or 2 * linked > len(t) else len(t) for t, linked, _, bad in found]


def surges(size: list[int]) -> list[int]:
    """The lines to keep, by the distribution of window sums."""
    half = WINDOW // 2
    sums = [sum(size[max(0, i - half) : i + half + 1]) for i in range(len(size))]
    full = [s for s in sums if s]
    if not full:
        return []
    limit = min(float(SURGE), max(float(QUIET), 0.4 * sum(full) / len(full)))
    kept: list[int] = []
    run: list[int] = []
    surge = False
    for i, s in enumerate([*sums, 0]):
        if s:
            run.append(i)
            surge |= s >= limit
            continue
        if surge:  # a dive ends a text that has surged
            kept += run
        run, surge = [], False
    if not kept:
        kept = list(range(len(size)))
    return [i for i in kept if size[i]]


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by two newlines."""
    found = lines(page or "")
    return "\n\n".join(found[i][0] for i in surges(weights(found)))


def extract(df: DataFrame, keys: list[str] | None = None, html: str = "html") -> DataFrame:
    """One row per page: keys, text, n_chars. One Arrow pass, no shuffle."""

    def make():
        from stradale.llm.html import main_text

        def work(pages):
            got = [main_text(p) for p in pages]
            return [(t, len(t)) for t in got]

        return work

    return map_texts(df, keys or ["page_id", "url"], html, make, "text string, n_chars long")
