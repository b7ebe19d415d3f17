"""A page's visible blocks of text with what its markup says of them.

``blocks`` reads a page as browsers do where it matters for text: unclosed and misnested elements,
implied ends of paragraphs, list items and table cells, quoted ``>``, raw-text elements, comments.
A block is the text between two borders of elements that are not inline; ``<br>`` is white space.
Each has a level: CHROME for text that markup names as something other than the article, else OPEN,
or HINTED, MAIN, ARTICLE by the innermost element that claims the content.
"""

from __future__ import annotations

import re
from html import unescape

CHROME, OPEN, HINTED, MAIN, ARTICLE = -1, 0, 1, 2, 3

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+))?"""
_MARK = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>"""
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.DOTALL)
_NAMED = re.compile(
    r"""(?<![^\s/"'])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?(?=[\s/]|\Z)""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# elements by their part in a page, fixed values of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark nobr output
    picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr meter progress""".split())
UNSEEN = set("head noscript template svg math object canvas audio video select button datalist applet".split())
SIDE = set("nav aside footer form menu dialog search".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
TABLE = {"table", "thead", "tbody", "tfoot"}
# an opening tag ends open elements of the first set, up to one of the second
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, TABLE | {"tr"}), "th": ({"td", "th"}, TABLE | {"tr"}), "tr": ({"tr", "td", "th"}, TABLE),
    "thead": (TABLE - {"table"} | {"tr", "td", "th"}, {"table"}), "tbody": (TABLE - {"table"} | {"tr", "td", "th"}, {"table"}),
    "tfoot": (TABLE - {"table"} | {"tr", "td", "th"}, {"table"}),
}
# words within class names and ids by which sites name what is not the article
SIDE_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    sidebar sidenav widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs
    menu submenu nav navbar navigation footer header masthead toolbar pagination pager pagenav comment comments commentlist
    disqus respond reply replies login search skip copyright""".split())
WITHOUT = {"has", "with", "no", "not", "without", "hide"}  # such a class tells of another element
HINTS = {"article", "post", "entry", "story", "content", "main", "articlebody"}
CLAIMS = {"article", "main", "content", "articlebody"}  # as a whole class or id


def _side(names: list[str], whole: bool) -> bool:
    """Whether class names or ids name something beside the article; ``whole``: as a single word."""
    for name in names:
        parts = [p.lower() for p in _PARTS.findall(name)]
        if len(parts) > 1 and (whole or parts[0] in WITHOUT):
            continue
        if not SIDE_WORDS.isdisjoint(parts):
            return True
    return False


def _level(tag: str, attributes: str, level: int, form: bool) -> tuple[int, bool]:
    """Level of an element within one of ``level``, and whether it is not shown at all."""
    names, role, prop, hidden = [], "", "", False
    if attributes:
        for key, a, b, c in _NAMED.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                names += value.split()
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                prop = value.strip().lower()
            elif key == "style":
                hidden = hidden or bool(_UNSEEN_STYLE.search(value))
            else:
                hidden = hidden or key == "hidden" or value.strip().lower() == "true"
    if tag in ("html", "body"):
        return level, False
    if hidden or tag in UNSEEN:
        return CHROME, True
    if level == CHROME:
        # an article does not stand in a form: then the form is around the page
        return (ARTICLE if form and tag == "article" else MAIN if form and tag == "main" else CHROME), False
    if tag == "article" or role == "article" or prop == "articlebody":
        return (CHROME if _side(names, True) else ARTICLE), False
    if tag == "main" or role == "main":
        return max(level, MAIN), False
    if tag in SIDE or role in SIDE_ROLES or tag == "header" and level < ARTICLE:
        return CHROME, False
    if names:
        lower = {n.lower() for n in names}
        if CLAIMS.isdisjoint(lower):
            names = [n for n in names if level < ARTICLE or "header" not in n.lower()]
            if _side(names, False):
                return CHROME, False
        if level < HINTED and any(p.lower() in HINTS for n in names for p in _PARTS.findall(n)):
            return HINTED, False
    return level, False


def blocks(page: str) -> list[tuple[int, str, str]]:
    """(level, name of the innermost element, text) of each block with text, in page order."""
    out: list[tuple[int, str, str]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", OPEN, False, False)]  # name, level, unseen, inline
    pieces: list[str] = []

    def close() -> None:
        if pieces:
            name, level, unseen, _ = next(e for e in reversed(stack) if not e[3])
            text = " ".join("".join(pieces).split())
            if text and not unseen:
                out.append((level, name, text))
            pieces.clear()

    def cut(depth: int) -> None:
        close()
        del stack[depth:]

    def heard(text: str) -> None:
        if text and not stack[-1][2] and (stack[-1][1] != CHROME or not stack[-1][3]):
            pieces.append(unescape(text) if "&" in text else text)

    at = 0
    while True:
        mark = _MARK.search(page, at)
        if mark is None:
            heard(page[at:])
            break
        heard(page[at : mark.start()])
        at = mark.end()
        if mark[2] is None:
            continue
        tag = mark[2].lower()
        if mark[1]:
            if tag == "br":
                pieces.append(" ")
            elif tag in INLINE:
                if stack[-1][3]:
                    for depth in range(len(stack) - 1, 0, -1):
                        if not stack[depth][3]:
                            break
                        if stack[depth][0] == tag:
                            del stack[depth:]
                            break
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        cut(depth)
                        break
                else:
                    close()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID:
            if tag not in INLINE:
                close()
            continue
        name, level, unseen, inline = stack[-1]
        if tag in INLINE:
            if inline or mark[3]:
                inner, hidden = _level(tag, mark[3], level, False)
                if inline or hidden or inner == CHROME != level:
                    stack.append((tag, inner, unseen or hidden, True))
            continue
        close()
        while stack[-1][3]:  # inline elements do not reach beyond blocks
            stack.pop()
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            ended, border = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in border:
                    break
                if stack[depth][0] in ended:
                    del stack[depth:]
        if stack[-1][0] == "head":
            stack.pop()
        if tag in ("article", "main"):  # neither stands in a menu: the menu was not closed
            for depth in range(1, len(stack)):
                if stack[depth][0] == "nav":
                    del stack[depth:]
                    break
        name, level, unseen, _ = stack[-1]
        around = not unseen and next((e[0] for e in stack if e[1] == CHROME), "") == "form"
        inner, hidden = _level(tag, mark[3], level, around)
        stack.append((tag, inner, unseen or hidden, False))
    close()
    return out


def chosen(found: list[tuple[int, str, str]]) -> list[bool]:
    """Which blocks markup allows in the article: those of the highest level of the page; beside an
    ``article`` also main headings of ``main``."""
    top = max((level for level, _, _ in found), default=OPEN)
    if top == CHROME:
        return [False] * len(found)
    return [level >= top or top == ARTICLE and level == MAIN and tag == "h1" for level, tag, _ in found]
