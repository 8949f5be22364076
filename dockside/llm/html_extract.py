"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over tags: elements, text slots,
optional parts and repeated groups. A page alone is a wrapper in which siblings of
one kind, and groups of siblings that follow each other again, are taken together
as repeats. Two wrappers of a host are aligned: what both have is merged, text that
differs becomes a slot, and elements that only one of them has become optional.

Every task folds its pages into one wrapper per host and these are merged in two
steps, so a host with a third of all pages costs a few rows per task. The wrapper
then decides which slots are the article's text: those in the element that marks
the article, or, where there is none, those in the smallest element that holds
most of the running text; text that is the same on all pages is the site's own.
Menus, buttons, hidden elements and the like never count. Forms and elements whose
class or id names something else (adverts, comments ...) are doubtful: they stay in
the wrapper, which overrules the name where such an element is or holds the article.
A page may follow another template than most of its host: where elements that mark an
article hold little of a page's running text, the element that holds most of it counts.
"""

import html
import json
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import record_batch, store

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
FOREIGN = frozenset(("svg", "math"))
# In these foreign elements HTML goes on.
HTML_IN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr td th input label".split()
)
# Elements that are never part of an article's text.
OTHER = frozenset(
    "nav footer aside button select option input label dialog menu head object embed applet"
    " audio video canvas datalist fieldset header".split()
) | RAW | FOREIGN | {"template"}
# A start tag of the key closes an open element of the value.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
# These hold others of their kind apart.
WALLS = frozenset("table ul ol dl body html article section main".split())
CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# A whole class or id that names something else. The words around the name are from
# closed lists, so has-sidebar, no-sidebar, tag-legal or comment-content say nothing.
OTHER_NAMES = re.compile(
    r"(?:^|\s)(?:(?:site|main|page|post|primary|secondary|top|bottom|left|right|global|mobile|header|footer"
    r"|social|email|related|google|text)[_-])?"
    r"(?:nav|navbar|navigation|menu|sidebar|side-bar|footer|masthead|topbar|toolbar|ad|ads"
    r"|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent"
    r"|gdpr|notice|notification|alert|popup|modal|overlay|comment|comments|commentlist|disqus|respond"
    r"|replies|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|newsletter|subscribe"
    r"|signup|login|search|pagination|pager|widget|skip|tags|legal|copyright|outbrain|taboola)"
    r"(?:[_-](?:area|list|box|bar|banner|notice|links?|buttons?|icons?|menu|form|section|posts?|articles?"
    r"|stories|slot|unit|thread|popup|modal|overlay|consent|\d+))?(?=$|\s)"
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    # What stands in such an element is not markup.
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)"
    r"[^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
START = re.compile(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
TELLING = re.compile(r"class|id\s*=|role|hidden|style|itemprop", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_TAG = re.compile(r"[^a-z0-9:_-]")
NO_NAME = re.compile(r"[^a-z_-]")

# The end of a doubtful element's key; no tag or name has it.
DOUBT = "!"
# A step of a path: name and number.
STEP = re.compile(r"/([^/\[]+)\[(\d+)\]")

# Open elements inside each other that are told apart; text of deeper ones is theirs.
DEEPEST = 150
# Parts of one element from which on a wrapper takes parts of one kind together.
MOST_PARTS = 400
# The name of all elements whose names are too many to be told apart.
ANY = ".*"
# The end of the key of an element that its attributes mark as the article.
MARK = "+"
# Pages that must agree before equal text counts as the site's own.
SAME_ON = 5
# Hosts that a task holds before it passes them on.
HOSTS_HELD = 2000


class Element:
    __slots__ = ("tag", "key", "other", "main", "doubt", "children")

    def __init__(self, tag, key="", other=False, main=False, doubt=False):
        self.tag, self.other, self.main, self.doubt = tag, other, main, doubt
        # The key of a doubtful element says so.
        self.key = (key or tag) + MARK * (main and tag not in ("article", "main")) + DOUBT * doubt
        self.children = []


def start_element(tag: str, attributes: str, inside_main: bool) -> Element:
    other = tag in OTHER and not (tag == "header" and inside_main)
    main = tag in ("article", "main")
    doubt = tag == "form"
    key = tag
    if attributes and TELLING.search(attributes):
        held = {}
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            held.setdefault(name.lower(), (a or b or c).lower())
        names = f"{held.get('class', '')} {held.get('id', '')}".strip()
        role = held.get("role", "")
        if names:
            # Only its letters, so that a key can stand in a path.
            key = f"{tag}.{NO_NAME.sub('', names.split()[0])}"
        if (names and tag not in ("html", "body") and OTHER_NAMES.search(names)) or role == "form":
            doubt = True
        if (
            role in OTHER_ROLES
            or "hidden" in held
            or held.get("aria-hidden") == "true"
            or ("style" in held and HIDDEN.search(held["style"]))
        ):
            other = True
        elif role == "main" or held.get("itemprop") == "articlebody":
            main = True
    return Element(tag, key, other, main, doubt)


def closed_by(name: str, deeper: list[Element]) -> int | None:
    """Place of the element that an end tag closes, if it is one of the deeper ones."""
    for i in range(len(deeper) - 1, -1, -1):
        tag = deeper[i].tag
        if tag == name:
            return i
        if name in INLINE and tag not in INLINE or tag in WALLS and name not in WALLS and name != "div":
            break
    return None


def foreign_at(stack: list[Element]) -> int:
    """Place of the open svg or math that a tag stands in; 0 where HTML is."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in HTML_IN:
            break
        if stack[i].tag in FOREIGN:
            while stack[i - 1].tag in FOREIGN:
                i -= 1
            return i
    return 0


def parse(page: str) -> Element:
    """The page as a tree; missing and crossed end tags are mended."""
    root = Element("#root")
    stack = [root]
    # Open elements deeper than those of the stack.
    deeper: list[Element] = []
    mains = others = at = 0
    while match := TAG.search(page, at):
        begin, after = match.span()
        if begin > at and not others:
            stack[-1].children.append(page[at:begin])
        at = after
        raw, ending, name, attributes = match.groups()
        if raw is not None and others and foreign_at(stack):
            # In svg and math such an element may be closed by its start tag.
            start = START.match(page, begin)
            if start and start.group().endswith("/>"):
                at = start.end()
                continue
        if name is None:
            if raw is not None and not others:
                stack[-1].children.append(Element(raw.lower(), other=True))
            continue
        name = name.lower()
        if not name.isalnum():
            name = NO_TAG.sub("", name) or "x"
        if ending:
            if deeper:
                place = closed_by(name, deeper)
                if place is not None:
                    others -= sum(e.other for e in deeper[place:])
                    del deeper[place:]
                    continue
                if name in INLINE or not any(e.tag == name for e in stack):
                    continue
                if any(e.tag in WALLS for e in deeper) and name not in WALLS and name != "div":
                    continue
                others -= sum(e.other for e in deeper)
                deeper = []
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i].tag
                if tag == name:
                    for e in stack[i:]:
                        mains -= e.main
                        others -= e.other
                    del stack[i:]
                    break
                # An inline end tag does not close the block around it.
                if name in INLINE and tag not in INLINE or tag in WALLS and name not in WALLS and name != "div":
                    break
            else:
                continue
            continue
        if others and not deeper and name in CLOSE_P and (place := foreign_at(stack)):
            # HTML ends svg and math that are still open.
            for e in stack[place:]:
                mains -= e.main
                others -= e.other
            del stack[place:]
        if deeper and (name in CLOSE_P or name in CLOSES):
            if deeper[-1].tag in (("p",) if name in CLOSE_P else CLOSES[name]):
                others -= deeper.pop().other
        elif name in CLOSE_P or name in CLOSES:
            wanted = ("p",) if name in CLOSE_P else CLOSES[name]
            last = None
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i].tag
                if tag in wanted:
                    last = i
                    if name in CLOSE_P:
                        break
                elif tag in WALLS or (tag not in INLINE and tag not in ("p", "tr", "thead", "tbody")):
                    break
            if last is not None:
                for e in stack[last:]:
                    mains -= e.main
                    others -= e.other
                del stack[last:]
        if others:
            # Nothing in here counts; only where it ends.
            element = Element(name)
        else:
            element = start_element(name, attributes, mains > 0)
            stack[-1].children.append(element)
        closed = attributes.endswith("/") and name != "template"
        if name not in VOID and not closed:
            if len(stack) < DEEPEST:
                stack.append(element)
                mains += element.main
            else:
                deeper.append(element)
            others += element.other
    if at < len(page) and not others:
        stack[-1].children.append(page[at:])
    return root


# ---- parts of an element: blocks, and runs of text with their inline tags -----


def has_block(element: Element) -> bool:
    return any(
        not isinstance(c, str) and not c.other and (c.tag not in INLINE or has_block(c))
        for c in element.children
    )


def inline_text(element, out: list, doubts: list, linked: bool = False) -> int:
    """Add the text of inline content to ``out``; how many characters of it are linked.

    Doubtful elements in it go to ``doubts``.
    """
    links = 0
    for child in element.children:
        if isinstance(child, str):
            out.append(child)
            if linked:
                links += len(child)
        elif child.doubt and not child.other:
            doubts.append(child)
        elif child.tag in ("br", "td", "th"):
            out.append(" ")
            links += inline_text(child, out, doubts, linked)
        elif not child.other:
            links += inline_text(child, out, doubts, linked or child.tag == "a")
    return links


def parts_of(element: Element) -> list:
    """Child blocks and text runs ``(text, linked characters)`` in order; other parts left out."""
    parts, run, links = [], [], 0

    def close():
        nonlocal run, links
        if run:
            text = "".join(run)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                parts.append((text, min(links, len(text))))
        run, links = [], 0

    for child in element.children:
        if isinstance(child, str):
            run.append(child)
        elif child.other:
            if child.tag not in INLINE:
                close()
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in INLINE and not child.main and not has_block(child):
            if child.doubt:
                # Beside the text around it, which goes on.
                parts.append(child)
                continue
            part: list[str] = []
            links += inline_text(child, part, parts, child.tag == "a")
            if child.tag in ("td", "th"):
                part = [" ", *part, " "]
            run += part
        else:
            close()
            parts.append(child)
    close()
    return parts


# ---- wrappers -----------------------------------------------------------------
#
# A text slot is ["#", hash or None, pages, characters, linked characters, hash of all
# texts that a page has there or None],
# an element ["e", key, repeated, pages, main, parts],
# a repeated group ["g", "", True, pages, 0, parts].


def name_of(part: list) -> str:
    if part[0] == "#":
        return "#"
    if part[0] == "e":
        return part[1]
    return "(" + " ".join(map(name_of, part[5])) + ")"


def merge_part(a: list, b: list, same_page: bool = False) -> list:
    pages = max(a[2], b[2]) if same_page and a[0] == "#" else None
    if a[0] == "#":
        n = pages if pages is not None else a[2] + b[2]
        once = a[1] if a[1] == b[1] else None
        if same_page:
            page = zlib.crc32(b"%d,%d" % (a[5], b[5])) if a[5] is not None and b[5] is not None else None
        else:
            page = a[5] if a[5] == b[5] else None
        return ["#", once, n, a[3] + b[3], a[4] + b[4], page]
    n = max(a[3], b[3]) if same_page else a[3] + b[3]
    parts = merge_parts(a[5], b[5], same_page)
    return [a[0], a[1], a[2] or b[2] or same_page, n, a[4] or b[4], parts]


def align(left: list[str], right: list[str]) -> list[tuple[int | None, int | None]]:
    """Longest common subsequence of two lists of names, as pairs of places."""
    if left == right:
        return [(i, i) for i in range(len(left))]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if left[i] == right[j] else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and left[i] == right[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            pairs.append((i, None))
            i += 1
        else:
            pairs.append((None, j))
            j += 1
    return pairs


def merge_parts(a: list, b: list, same_page: bool = False) -> list:
    """Align two lists of parts; what only one has stays, and so is optional."""
    out = [
        merge_part(a[i], b[j], same_page) if i is not None and j is not None else a[i] if j is None else b[j]
        for i, j in align([name_of(p) for p in a], [name_of(p) for p in b])
    ]
    return fewer(out)


def flat(parts: list) -> list:
    """Parts with those of repeated groups in their place."""
    return [q for p in parts for q in (flat(p[5]) if p[0] == "g" else [p])]


def generic(key: str) -> str:
    """The key that elements of too many names share; it keeps the marks at the key's end."""
    name = key.rstrip(DOUBT + MARK)
    return name.split(".")[0] + ANY + key[len(name) :]


def gathered(parts: list, key_of) -> list:
    """Parts of one key taken together as a repeat, at the place of the first."""
    held: dict[str, list[list]] = {}
    for p in parts:
        held.setdefault("#" if p[0] == "#" else key_of(p), []).append(p)
    out = []
    for key, same in held.items():
        # In pairs, so that each part is merged a few times only.
        while len(same) > 1:
            pairs = [merge_part(a, b, True) for a, b in zip(same[::2], same[1::2])]
            same = pairs + same[len(same) // 2 * 2 :]
        out.append(same[0] if key == "#" else [same[0][0], key, *same[0][2:]])
    return out


def fewer(parts: list) -> list:
    """All of ``parts`` in about ``MOST_PARTS``: more of them are taken together by kind.

    First those of one name, then those of the rarer names by tag, then by nothing
    but their marks. Nothing is left out.
    """
    if len(parts) <= MOST_PARTS:
        return parts
    out = gathered(flat(parts), lambda p: p[1])
    if len(out) > MOST_PARTS:
        often = sorted((p[3] for p in out if p[0] == "e" and ANY not in p[1]), reverse=True)
        # Equally rare names go together, whatever their order.
        rare = often[min(MOST_PARTS // 2, len(often) - 1)] if often else 0
        out = gathered(out, lambda p: p[1] if p[3] > rare else generic(p[1]))
    if len(out) > MOST_PARTS:
        out = gathered(out, lambda p: ANY + generic(p[1]).split(ANY)[1])
    return out


def fold_repeats(parts: list) -> list:
    """Take together siblings of one kind, then groups of two to four that follow again."""
    for period in (1, 2, 3, 4):
        if len(parts) < 2 * period:
            break
        names = [name_of(p) for p in parts]
        out, i = [], 0
        while i < len(parts):
            unit, j = parts[i : i + period], i + period
            times = 1
            while names[i : i + period] == names[j : j + period] and len(unit) == period:
                if all(n == "#" for n in names[i : i + period]):
                    break
                unit = merge_parts(unit, parts[j : j + period], True)
                j, times = j + period, times + 1
            if times == 1:
                out.append(parts[i])
                i += 1
            elif period == 1:
                unit[0][2] = True
                out.append(unit[0])
                i = j
            else:
                pages = max(p[2] if p[0] == "#" else p[3] for p in unit)
                out.append(["g", "", True, pages, 0, unit])
                i = j
        parts = out
    return parts


def wrapper_of(element: Element, path: str = "", blocks: list | None = None) -> list:
    """Parts of a page's element as a wrapper.

    ``blocks`` gets its texts with their place: path of the element, text, and
    whether there is more than links in it. A step of a path is a name and its
    number among its siblings of that name.
    """
    out = []
    seen: dict[str, int] = {}
    for part in parts_of(element):
        name = "#" if isinstance(part, tuple) else part.key
        number = seen.get(name, 0)
        seen[name] = number + 1
        step = f"{path}/{name}[{number}]"
        if isinstance(part, tuple):
            text, links = part
            mark = zlib.crc32(text.encode("utf-8", "replace"))
            out.append(["#", mark, 1, len(text), links, mark])
            if blocks is not None:
                blocks.append((step, text, links < len(text)))
        else:
            inner = wrapper_of(part, step, blocks)
            out.append(["e", part.key, False, 1, int(part.main), inner])
    return fewer(fold_repeats(out))


def merge_hosts(a: dict, b: dict) -> dict:
    """Merge two wrappers; ``pages`` holds hashes of some different pages, ``n`` counts all."""
    return {
        "n": a["n"] + b["n"],
        "pages": sorted({*a["pages"], *b["pages"]})[:SAME_ON],
        "parts": merge_parts(a["parts"], b["parts"]),
    }


# ---- which slots are the article ------------------------------------------------


def tag_of(name: str) -> str:
    return name.split(".")[0].rstrip(DOUBT + MARK)


def doubtful(part: list) -> bool:
    """Whether a part is a doubtful element that :func:`overrule` has not accepted."""
    return part[0] == "e" and part[1].endswith(DOUBT) and len(part) == 6


def running_text(parts: list, doubts: bool = False) -> int:
    """Characters of unlinked text in slots that differ from page to page."""
    total = 0
    for p in parts:
        if p[0] != "#":
            if doubts or not doubtful(p):
                total += running_text(p[5], doubts)
        elif 2 * p[4] < p[3] and (p[1] is None or p[2] == 1):
            total += p[3] - p[4]
    return total


def same_text(parts: list, n: int) -> int:
    """Characters of unlinked text in slots that are the same on all ``n`` pages."""
    total = 0
    for p in parts:
        if p[0] != "#":
            total += 0 if doubtful(p) else same_text(p[5], n)
        elif 2 * p[4] < p[3] and p[5] is not None and p[2] >= n:
            total += p[3] - p[4]
    return total


def marked_text(parts: list, doubts: bool = False) -> int:
    """The part of :func:`running_text` that stands in elements that mark the article."""
    total = 0
    for p in parts:
        if p[0] != "#" and (doubts or not doubtful(p)):
            total += running_text(p[5], doubts) if p[4] else marked_text(p[5], doubts)
    return total


def overrule(parts: list, whole: int, marks: int, clear: int, inside: bool = False) -> None:
    """Accept doubtful elements that are or hold the article.

    Around them there is running text of ``whole`` characters, ``marks`` of them in
    elements that mark the article and ``clear`` of these without doubt. Where there
    are such, only what holds nearly all text of a mark is accepted; else what has
    half of the marked text, or, without marks, half of all.
    """
    for p in parts:
        if p[0] == "#":
            continue
        if not doubtful(p):
            overrule(p[5], whole, marks, clear, inside or bool(p[4]))
            continue
        text = running_text(p[5], True)
        if clear:
            accepted = inside and text > 4 * clear
        elif marks:
            accepted = 2 * (text if p[4] or inside else marked_text(p[5], True)) >= marks
        else:
            accepted = 2 * text > whole
        if accepted:
            p.append(True)
            held = inside or bool(p[4])
            now = running_text(p[5]) if held else marked_text(p[5])
            overrule(p[5], text, text if held else marked_text(p[5], True), now, held)


def marked(parts: list) -> bool:
    return any(p[0] != "#" and not doubtful(p) and (p[4] or marked(p[5])) for p in parts)


# Paragraphs and the like are part of the text, not around it.
BLOCKS_OF_TEXT = ("p", "li", "pre", "blockquote")


def mark_body(parts: list) -> None:
    """Mark the smallest element that holds most of the running text."""
    whole = running_text(parts)
    holder = None
    while whole:
        inner = [
            p for p in parts if p[0] != "#" and not doubtful(p) and 10 * running_text(p[5]) >= 7 * whole
        ]
        # A repeated element or a paragraph is part of the text, not around it.
        if not inner or inner[0][2] or tag_of(inner[0][1]) in BLOCKS_OF_TEXT:
            break
        holder, parts = inner[0], inner[0][5]
    if holder is not None:
        holder[4] = 1


def prepared(text: str | None) -> dict:
    """A stored wrapper with the article's element marked."""
    wrapper = json.loads(text) if text else {"n": 0, "pages": [], "parts": []}
    parts = wrapper["parts"]
    wrapper["common"] = len(wrapper["pages"]) >= SAME_ON
    # A host of one article in several frames has no text of its own in paragraphs.
    wrapper["frame"] = wrapper["common"] and 3 * same_text(parts, wrapper["n"]) <= running_text(parts, True)
    overrule(parts, running_text(parts, True), marked_text(parts, True), marked_text(parts))
    wrapper["by_mark"] = marked(parts)
    if not wrapper["by_mark"]:
        mark_body(parts)
    wrapper["any"] = marked(parts)
    return wrapper


# Headings of readers' comments, of other stories and of offers. They count only where
# the wrapper knows the heading as the site's own.
OTHER_HEADS = re.compile(
    r"(?:(?:all|latest|reader|readers|recent|user|your)\s)?(?:comments|responses|replies)"
    r"|(?:add|leave|post|write) a (?:comment|reply|response)|join the (?:conversation|discussion)"
    r"|related (?:articles|content|links|news|posts|reading|stories)"
    r"|(?:more|other|popular|recommended|top|trending) (?:articles|news|posts|stories)"
    r"|read (?:more|next|on)|recommended(?: for you)?|most (?:popular|read)|trending(?: now)?|up next"
    r"|you (?:may|might) (?:also )?(?:enjoy|like)(?: this| these)?"
    r"|advertisement|sponsored(?: content| links)?|(?:our )?newsletter|share (?:this|this article|this post)"
    r"|kommentare|leserkommentare|mehr zum thema|das könnte sie auch interessieren"
    r"|commentaires|articles similaires|à lire aussi|comentarios|artículos relacionados|te puede interesar"
)
HEAD = re.compile(r"(?P<parent>.*)/(?P<rank>h[1-6])[^/]*\[\d+\]/#\[\d+\]")
LISTS = ("ul", "ol", "dl")


def only_links(parts: list) -> bool:
    """Whether all text of a wrapper's parts is linked on all pages."""
    return all(p[4] >= p[3] if p[0] == "#" else only_links(p[5]) for p in parts)


TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt tr figcaption".split())


def marks(name: str) -> bool:
    """Whether a step's name says that it marks the article."""
    return tag_of(name) in ("article", "main") or MARK in name


def mark_in(path: str) -> str | None:
    """The path up to its first element that marks the article."""
    if "/article" not in path and "/main" not in path and MARK not in path:
        return None
    end = 0
    for step in STEP.finditer(path):
        end = step.end()
        if marks(step[1]):
            return path[:end]
    return None


class Chooser:
    """Which places of a host's pages hold the article's text."""

    def __init__(self, wrapper: dict):
        self.wrapper = wrapper
        self.known: dict[tuple[str, bool, bool, bool], bool] = {}
        self.running: dict[str, bool] = {}

    def keeps(self, path: str, unlinked: bool, anywhere: bool, doubts: bool) -> bool:
        key = (path, unlinked, anywhere, doubts)
        if key not in self.known:
            self.known[key] = self._decide(path, unlinked, anywhere, doubts)
        return self.known[key]

    def _decide(self, path, unlinked, anywhere, doubts):
        slot, steps = self._slots(path)
        inside, tag = anywhere, ""
        for name, element in steps:
            if name.endswith(DOUBT) and not doubts and (element is None or doubtful(element)):
                return False
            tag = tag_of(name)
            inside = inside or bool(element and element[4]) or marks(name)
        if not inside:
            return False
        own = slot is not None and slot[1] is not None and slot[2] >= SAME_ON
        if not unlinked and self.wrapper["common"] and any(
            e and e[3] >= SAME_ON and tag_of(name) in LISTS and only_links(e[5]) for name, e in steps
        ):
            # A list that holds links alone on all pages leads to other stories.
            return False
        if tag in TEXT_TAGS:
            return not (own and self.wrapper["frame"] and slot[2] >= self.wrapper["n"])
        # Nothing but links, or equal on all pages: the site's own.
        return unlinked and not (own and self.wrapper["common"])

    def _slots(self, path):
        """The text slot of a path, and the names and elements above it; None where unknown."""
        slots, steps = flat(self.wrapper["parts"]), []
        for step in STEP.findall(path):
            name, number = step[0], int(step[1])
            # The n-th part of a kind is the n-th of the wrapper, the last one repeats.
            held = [s for s in slots if name_of(s) == name]
            if not held and name != "#":
                shared = generic(name), ANY + generic(name).split(ANY)[1]
                held = [s for s in slots if s[1] in shared and s[0] == "e"]
            slot = held[min(number, len(held) - 1)] if held else None
            if name == "#":
                return slot, steps
            steps.append((name, slot))
            slots = flat(slot[5]) if slot else []
        return None, steps

    def _runs(self, path: str) -> bool:
        """Whether a place is clear and its text differs from page to page."""
        if path not in self.running:
            slot, steps = self._slots(path)
            clear = not any(n.endswith(DOUBT) and (e is None or doubtful(e)) for n, e in steps)
            same = self.wrapper["common"] and slot is not None and slot[1] is not None and slot[2] >= SAME_ON
            self.running[path] = clear and not same
        return self.running[path]

    def body(self, rows: list[tuple]) -> str | None:
        """Path of the element that holds this page's text, where its marks do not."""
        in_marks: dict[str, int] = {}
        free = []
        for path, text, unlinked in rows:
            if not unlinked or not self._runs(path):
                continue
            at = mark_in(path)
            if at is None:
                free.append((path, len(text)))
            else:
                in_marks[at] = in_marks.get(at, 0) + len(text)
        whole = sum(n for _, n in free)
        holder = ""
        while whole:
            inner: dict[str, int] = {}
            for path, n in free:
                if path.startswith(holder + "/"):
                    step = path[: path.find("]", len(holder)) + 1]
                    inner[step] = inner.get(step, 0) + n
            step, n = max(inner.items(), key=lambda x: x[1], default=("", 0))
            name = step[len(holder) + 1 :].split("[")[0]
            if 10 * n < 7 * whole or name == "#" or tag_of(name) in BLOCKS_OF_TEXT:
                break
            holder, whole = step, n
        # One mark is better evidence than teasers that are marked each.
        least = max(in_marks.values(), default=0) * (4 if len(in_marks) == 1 else 1)
        return holder if holder and whole > least else None

    def _others_head(self, path: str, text: str):
        """Parent and rank of a heading of the site's own that names something else than the article."""
        head = HEAD.fullmatch(path)
        if head and self.wrapper["common"] and OTHER_HEADS.fullmatch(text.lower().strip(" .:!?…")):
            slot, _ = self._slots(path)
            if slot is not None and slot[1] is not None and slot[2] >= SAME_ON:
                return head["parent"], head["rank"]
        return None

    def without_others(self, rows: list[tuple]) -> list[tuple]:
        """A page's rows without what stands under such headings.

        If the heading is the first thing in its element, all of it goes up to the next
        heading of its rank; else only the list or the like elements that follow it.
        """
        gone: set[int] = set()
        for i, (path, text, _) in enumerate(rows):
            found = None if i in gone else self._others_head(path, text)
            if found is None:
                continue
            parent, rank = found
            top = mark_in(path) or ""
            within = [p.startswith(parent + "/") for p, _, _ in rows]
            while sum(within) == 1 and len(parent) > len(top):
                # Nothing but the heading is in there.
                parent = parent[: parent.rindex("/")]
                within = [p.startswith(parent + "/") for p, _, _ in rows]
            own = parent != top and not any(within[:i])
            gone.add(i)
            step = None
            for j in range(i + 1, len(rows)):
                other = HEAD.fullmatch(rows[j][0])
                if not within[j] or other and other["parent"] == parent and other["rank"] <= rank:
                    break
                name = rows[j][0][len(parent) + 1 :].split("[")[0]
                if not own:
                    if tag_of(name) in ("#", "p", "pre", "blockquote") or step not in (None, name):
                        break
                    step = name
                gone.add(j)
        return [r for i, r in enumerate(rows) if i not in gone] if len(gone) < len(rows) else rows

    def article(self, paths: list[str], texts: list[str], unlinked: list[bool]) -> str:
        """The article's blocks, joined by blank lines."""
        rows = self.without_others(list(zip(paths, texts, unlinked)))
        if self.wrapper["by_mark"]:
            holder = self.body(rows)
            if holder is not None:
                held = [r for r in rows if r[0].startswith(holder + "/") and mark_in(r[0]) is None]
                blocks = [t for p, t, u in held if self.keeps(p, u, True, False)]
                if blocks:
                    return "\n\n".join(blocks)
        anywhere = not self.wrapper["any"]
        # Where the first finds nothing, the page is unlike the others of its host: what a
        # doubtful element marks, then all that is clear, then all.
        for where, doubts in ((anywhere, False), (anywhere, True), (True, False), (True, True)):
            blocks = [t for p, t, u in rows if self.keeps(p, u, where, doubts)]
            if blocks:
                break
        return "\n\n".join(blocks)


# ---- jobs -------------------------------------------------------------------------


def host_of(url: str = "url"):
    """Column: the host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


READ_TYPE = (
    "host string, part int, wrapper string, page_id long, url string,"
    " paths array<string>, texts array<string>, unlinked array<boolean>"
)
READ = pa.schema(
    [
        ("host", pa.string()),
        ("part", pa.int32()),
        ("wrapper", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("paths", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
        ("unlinked", pa.list_(pa.bool_())),
    ]
)
WRAPPER_TYPE = "host string, part int, wrapper string"
WRAPPER = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page's texts with their places, and a wrapper per task and host.

    A row of a page has no ``wrapper``; a row with one has no page.
    """

    def wrappers(held):
        part = TaskContext.get().partitionId() % 64
        texts = [json.dumps(w, separators=(",", ":")) for w in held.values()]
        none = [None] * len(held)
        return record_batch(READ, list(held), [part] * len(held), texts, *[none] * 5)

    def read(batches):
        held: dict[str, dict] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                columns = [c.to_pylist() for c in batch.slice(start, 256).columns]
                out = []
                for page_id, url, host, page in zip(*columns):
                    blocks: list = []
                    mark = zlib.crc32(page.encode("utf-8", "replace"))
                    new = {"n": 1, "pages": [mark], "parts": wrapper_of(parse(page), "", blocks)}
                    out.append((host, None, None, page_id, url, *(zip(*blocks) if blocks else [()] * 3)))
                    old = held.get(host)
                    if old is None and len(held) >= HOSTS_HELD:
                        yield wrappers(held)
                        held = {}
                    held[host] = new if old is None else merge_hosts(old, new)
                yield record_batch(READ, *zip(*out))
        if held:
            yield wrappers(held)

    some = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        host_of().alias("host"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    return store(some.mapInArrow(read, READ_TYPE), "pages")


def merge_wrappers(partial: DataFrame) -> DataFrame:
    """One wrapper per host, stored in the shared folder."""

    def merge(table):
        merged = None
        for text in sorted(table["wrapper"].to_pylist()):
            new = json.loads(text)
            merged = new if merged is None else merge_hosts(merged, new)
        text = json.dumps(merged, separators=(",", ":"))
        return pa.table([table["host"][:1], table["part"][:1], [text]], schema=WRAPPER)

    once = partial.groupBy("host", "part").applyInArrow(merge, WRAPPER_TYPE)
    twice = once.groupBy("host").applyInArrow(merge, WRAPPER_TYPE)
    return store(twice.select("host", "wrapper"), "wrappers")


RESULT = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (with ``html``).

    A NULL or empty page gives an empty text. Pages without a URL count as one
    host. Repeated rows give repeated results and count once when text is judged
    to be the same on all pages. Other columns are ignored. The pages are read
    once; their texts wait in the shared folder for the wrappers.
    """
    known_pages = read_pages(pages)
    wrappers = merge_wrappers(
        known_pages.where("wrapper IS NOT NULL").select("host", "part", "wrapper")
    )

    def extract(batches):
        known: dict[str | None, Chooser] = {}
        for batch in batches:
            ids, urls, wrappers, *blocks = (c.to_pylist() for c in batch.columns)
            out = []
            for wrapper, *row in zip(wrappers, *blocks):
                if wrapper not in known:
                    if len(known) >= HOSTS_HELD:
                        known.clear()
                    known[wrapper] = Chooser(prepared(wrapper))
                out.append(known[wrapper].article(*row))
            yield record_batch(RESULT, ids, urls, out, [len(t) for t in out])

    # Joined as the size of the stored wrappers suggests.
    return (
        known_pages.where("wrapper IS NULL")
        .drop("wrapper")
        .join(wrappers, "host", "left")
        .select("page_id", "url", "wrapper", "paths", "texts", "unlinked")
        .mapInArrow(extract, "page_id long, url string, text string, n_chars long")
    )
