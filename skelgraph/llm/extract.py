"""Main-text extraction from HTML by two-pass block rules.

Pass 1 classes each block by length, stop-word density and link density: long blocks
of many stop words and few links are good; long ones of few stop words, blocks of links and runs of
MENU or more short links are bad; the rest is open. Pass 2 gives open blocks the label of the nearest
decided neighbours; a block outside articles that is bad for its own words or links alone is text after all
if it stands between good blocks, or, without a link itself, beside one at an end of the page with no link between. Blocks in containers that name themselves menu, header, footer,
sidebar, notice, advert, form or comments, by tag, role or a whole class name, are never asked, but a container
that holds most of the page's long blocks is not taken at its name (comments are). `article` and `main` are
evidence: they hold the page's text if they hold most of its good text, and in them single
links and few stop words leave a block open. Density is waived
where the stop words do not know the language: pages that do not declare one of theirs
(`LANGUAGES`) and hold few of them, or have no good block at all. Null or empty html gives ''. Every kept block is
whole, and blocks are joined by one line feed; time is in proportion to the page. Rows
may repeat or tie; an empty table gives no rows; `text` and `n_chars` replace columns of these names, others stay.
"""
import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

# Frequent function words of the supported languages.
STOP_WORDS = frozenset("""
the of and to in is that for it was on with as be at by this are from or have an not you he she they we his her its which but had were been their has would
de la le et les des en un une du que qui dans est pour pas sur au par avec il elle ce se ne plus aux ont son sa ses
der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an er sie wie oder wird bei aus nach einer um am
el los las y una por con no su para se del al como más o lo pero sus le ya fue este ha si sin sobre
""".split())
LANGUAGES = ("en", "fr", "de", "es")
LONG, HIGH, LOW, LINKS, KNOWN, MENU, SEVERAL = 70, 0.25, 0.1, 0.33, 0.05, 3, 3
_SKIP = "script style noscript template svg iframe object textarea select head".split()
_BLOCK = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_HOLDS = _BLOCK - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
_BAD = frozenset("nav footer aside form button menu dialog".split())
_NAME = (r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|footer|header|masthead|menu|modal|nav\w*|"
         r"newsletter|notices?|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)")
_SIDE = r"(?:site|page|global|top|bottom|left|right|main|primary|secondary|post|entry|user|reader)"
_PLACE = r"(?:area|bar|block|box|buttons?|container|icons?|inner|items?|links?|list|section|wrap|wrapper|form|thread|posts?|\d+)"
_NAMES = re.compile(rf"(?:{_SIDE}[-_])*{_NAME}(?:[-_](?:{_NAME}|{_PLACE}))*", re.I)  # of a whole class name or id
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(%s)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<[!?][^<>]*>"
                    % "|".join(_SKIP), re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|lang)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _pinned(tag, attrs, inside):
    """How a container names itself boilerplate: 2 by its tag, role or as comments, 1 by another name, 0 not."""
    if tag in _BAD or (tag == "header" and not inside):
        return 2
    if not attrs or tag in ("html", "body", "main"):
        return 0
    found = 0
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "role" and value.lower() in _ROLES:
            return 2
        for token in value.split() if name in ("class", "id") else ():
            if _NAMES.fullmatch(token):
                found = max(found, 2 if "comment" in token.lower() else 1)
    return found


def _unpinned(out, named):
    """The containers pinned by name that hold most of the page's long blocks without links, and SEVERAL of them: they are not what their name says."""
    total, held, count = 0, dict.fromkeys(named, 0), dict.fromkeys(named, 0)
    for text, links, pins, _ in out:
        if len(text) >= LONG and links <= LINKS * len(text) and 0 not in pins:
            total += len(text)
            for k in pins:
                held[k] += len(text)
                count[k] += 1
    return {k for k, n in held.items() if 2 * n > total and count[k] >= SEVERAL}


def blocks(page: str):
    """(declared language, [(text, link characters, pinned as boilerplate, inside an article)]) in page order."""
    out, parts, links, lang = [], [], 0, ""
    stack, anchor, at = [], 0, 0  # stack: (tag, pins, inside); a pin is 0 or the number of a container pinned by name
    named = []

    def close():
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, links, *(stack[-1][1:] if stack else ((), False))))
        parts, links = [], 0

    def add(raw):
        nonlocal links
        if raw:
            parts.append(raw)
            if anchor:
                links += len(" ".join(html.unescape(raw).split()))

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if (m.group(1) or "").lower() == "head":
                close()
        elif tag == "a":
            anchor = 0 if m.group(2) else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            close()
            anchor = 0
            if tag == "html" and not m.group(2):
                lang = next((a or b or c for name, a, b, c in _ATTR.findall(m.group(4)) if name.lower() == "lang"), lang)
            if tag in _HOLDS:
                if m.group(2):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                elif not m.group(4).endswith("/"):
                    _, pins, inside = stack[-1] if stack else ("", (), False)
                    how = 0 if 0 in pins else _pinned(tag, m.group(4), inside)
                    if how == 2:
                        pins = (0,)
                    elif how:
                        named.append(len(named) + 1)
                        pins = (*pins, named[-1])
                    stack.append((tag, pins, inside or tag in ("article", "main")))
        elif tag in ("button", "label", "option") and not m.group(2):
            parts.append(" ")
    add(page[at:])
    close()
    free = _unpinned(out, named) if named else set()
    return lang[:2].lower(), [(text, links, any(k not in free for k in pins), inside) for text, links, pins, inside in out]


def _link_runs(found):
    """Which blocks stand in a run of MENU or more short blocks that are hardly more than links: a menu, wherever it stands."""
    out, run = [False] * len(found), []
    for k, (text, links, *_) in enumerate([*found, ("", 0, False, False)]):
        if links > 0.9 * len(text) and len(text) < LONG:
            run.append(k)
            continue
        if len(run) >= MENU:
            for r in run:
                out[r] = True
        run = []
    return out


def first_pass(lang, found, stop_words=STOP_WORDS):
    """True, False or None (open) for each block."""
    counts = []
    for text, _, bad, _ in found:
        words = _WORD.findall(text.lower())
        counts.append((sum(w in stop_words for w in words), len(words)))
    asked = [c for c, b in zip(counts, found) if not b[2]]
    known = lang in LANGUAGES or sum(c[0] for c in asked) >= KNOWN * sum(c[1] for c in asked)
    labels = []
    for (stops, n), (text, links, bad, inside), menu in zip(counts, found, _link_runs(found)):
        density = stops / n if n else 0.0
        if bad or menu:
            labels.append(False)
        elif links > LINKS * len(text):
            labels.append(None if inside else False)
        elif len(text) < LONG:
            labels.append(None)
        elif not known or density >= HIGH:
            labels.append(True)
        else:
            labels.append(None if inside or density >= LOW else False)
    if not any(labels):  # no text like the stop words': length and links decide alone
        labels = [True if len(b[0]) >= LONG and not b[2] and b[1] <= LINKS * len(b[0]) else x for x, b in zip(labels, found)]
    return labels


def second_pass(found, labels):
    """One boolean per block: open ones take the label of the nearest decided neighbours that are not pinned."""
    good = [sum(len(b[0]) for b, x in zip(found, labels) if x and b[3] == side) for side in (False, True)]
    holds = good[1] > 0 and good[1] >= good[0]  # the article holds most of the good text, so what is outside is not text
    scope = [k for k, b in enumerate(found) if not b[2] and (b[3] or not holds)]
    menu = _link_runs(found)

    def weak(k):  # called bad for its own stop words or links only: what stands between good blocks is text
        return labels[k] is None or labels[k] is False and not menu[k] and not found[k][3]

    def nearest(order, counts):
        seen, last = {}, None
        for k in order:
            seen[k] = last
            last = k if counts(k) else last
        return seen

    def decided(k):
        return labels[k] is not None

    before, after = nearest(scope, decided), nearest(scope[::-1], decided)
    def linked(k):
        return found[k][1] > LINKS * len(found[k][0])

    firm = [nearest(order, lambda k: not weak(k)) for order in (scope, scope[::-1])]
    firm_or_linked = [nearest(order, lambda k: not weak(k) or linked(k)) for order in (scope, scope[::-1])]
    out = [False] * len(found)
    for k in scope:
        b, a = before[k], after[k]
        near = [x for x in (b, a) if x is not None]
        if labels[k] is None:
            if len(near) == 2 and labels[b] != labels[a]:
                out[k] = labels[b if k - b < a - k else a] if k - b != a - k else True
            else:
                out[k] = labels[near[0]] if near else True
        else:
            out[k] = labels[k]
        if not out[k] and weak(k):
            sides = [side[k] for side in firm]
            out[k] = None not in sides and all(labels[x] for x in sides)
            if not out[k] and not found[k][1]:
                sides = [side[k] for side in firm_or_linked if side[k] is not None]
                out[k] = len(sides) > 0 and all(labels[x] for x in sides)
    return out


def main_text(page, stop_words=STOP_WORDS) -> str:
    lang, found = blocks(page) if page else ("", [])
    return "\n".join(b[0] for b, good in zip(found, second_pass(found, first_pass(lang, found, stop_words))) if good)


def extract(pages: DataFrame, html_col="html", stop_words=STOP_WORDS) -> DataFrame:
    """All columns of `pages`, with text and n_chars."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda page: main_text(page, stop_words))

    text = run(F.coalesce(F.col(html_col), F.lit("")))
    pages = pages.drop(*{"n_chars"} - {html_col})
    return attach(pages, F.struct(text.alias("text")), ["text"]).withColumn("n_chars", F.length("text").cast("long"))
