"""Main text of web pages by two-pass block rules.

The first pass labels every block by stop-word density, length and the share of text in links; the
containers' own words (``nav``, ``class="ad"``, ``<article>``) are a further feature: furniture and
what stands outside of an article is bad, and a block inside of one stays open where its words are
too few or too unlike prose to tell. In the second pass each open block takes the label of its
nearest decided neighbours; of two equally near ones good wins. Good blocks are joined in page
order. Pages of any length are read whole.

Defined results: a null or empty page, and one without main text, gives an empty text; broken or
cut-off markup is read as far as it goes; repeated rows each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm.common import only, text_slices

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have he her his i in is it its not of on or she that the their
    they this to was we were which with you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für
    hat ich im in ist mit nach nicht noch oder sich sie sind über um und von vor war wie wird zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas
    plus pour qu que qui sa se ses son sur un une vous
    al como con de del el ella en es esta este ha la las lo los más no o para pero por que se si sin
    sobre son su sus un una y ya""".split()
)
# Elements whose content is never page text.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video select option textarea button title head".split())
# Elements that hold page furniture.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
# Elements that start and end a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
# Words of class, id and role that name page furniture.
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions
    banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended
    recommendations share sharing social footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter
    subscribe subscription signup login comment comments commentlist disqus respond reply replies toolbar pagination pager
    copyright complementary contentinfo search form""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
# Words that only place or shape what they stand beside in a class.
PLACE_WORDS = frozenset(
    """site page main global top bottom left right header head body box bar block container wrapper wrap inner outer content
    list item items section area column col panel slot unit link links button buttons icon icons area zone group row post posts
    article articles text title primary secondary fixed sticky mobile desktop small large js is the of for and by""".split()
)
_WORD = re.compile(r"[^\W\d_]+")
#: Elements that never hold others.
_VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())
_CONTAINERS = BLOCKS - frozenset("p li dd dt h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot hr html body".split())

GOOD, BAD, OPEN = 1, 0, -1
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINK_HIGH = 0.12, 0.25, 0.33


class Block:
    __slots__ = ("text", "linked", "furniture", "inside")

    def __init__(self, text: str, linked: int, furniture: bool, inside: bool):
        self.text, self.linked, self.furniture, self.inside = text, linked, furniture, inside


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(raw)}


def _hidden(attributes: dict[str, str]) -> bool:
    if attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None


def _named(attributes: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a whole class, id, role or label names one of the words, beside words of place alone."""
    for key in ("class", "id", "role", "aria-label"):
        for token in attributes.get(key, "").split():
            parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if p]
            if any(p in words for p in parts) and all(p in words or p in FURNITURE_WORDS or p in PLACE_WORDS or len(p) < 3 for p in parts):
                return True
    return False


def _is_furniture(tag: str, raw: str, inside: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not raw.strip():
        return False
    attributes = _attributes(raw)
    if _hidden(attributes):
        return True
    if tag in ("body", "html", "main"):
        return False
    if tag == "article":
        return _named(attributes, COMMENT_WORDS)
    return _named(attributes, FURNITURE_WORDS) or not inside and _named(attributes, frozenset({"header"}))


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order, with what their containers say."""
    out: list[Block] = []
    buffer: list[str] = []
    linked, in_link, at, skip = 0, 0, 0, ""
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, inside an article
    furniture = inside = False

    def flush():
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            out.append(Block(text, linked, furniture, inside))
        buffer.clear()
        linked = 0

    def put(raw: str):
        nonlocal linked
        if raw:
            s = html.unescape(raw) if "&" in raw else raw
            buffer.append(s)
            if in_link:
                linked += len(" ".join(s.split()))

    while at < len(page):
        if skip:  # raw content ends with its own end tag alone
            m = re.compile(rf"</{skip}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            skip, at = "", m.end() if m else len(page)
            continue
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in DROPPED:
            # A head without an end tag ends at the body, so only its own parts are dropped.
            if not closing and tag not in ("head", "option", "embed") and not attributes.endswith("/"):
                skip = tag
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            buffer.append(" ")
        elif tag in BLOCKS:
            flush()
            in_link = 0
            if tag in _CONTAINERS and tag not in _VOID:
                if not closing:
                    inside_now = inside or tag in ("article", "main")
                    stack.append((tag, furniture, inside))
                    furniture = furniture or _is_furniture(tag, attributes, inside)
                    inside = inside_now
                elif any(x[0] == tag for x in stack):
                    while True:
                        name, furniture, inside = stack.pop()
                        if name == tag:
                            break
    flush()
    return out


def _dense(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_label(b: Block, stops: bool, article: bool) -> int:
    """Density, length and links decide; where a page has an article, what stands outside of it is bad."""
    if b.furniture or article and not b.inside:
        return BAD
    n = len(b.text)
    links = b.linked / n
    if links > LINK_HIGH:
        # Inside of an article prose may be full of links; a list of links is not.
        return OPEN if b.inside and (links <= 0.6 or n >= LONG) else BAD
    if not b.inside and "\N{COPYRIGHT SIGN}" in b.text:
        return BAD
    if n < SHORT:
        return BAD if links and not b.inside else OPEN
    density = _dense(b.text) if stops else STOP_LOW
    if density < STOP_LOW:
        return OPEN if b.inside else BAD
    return GOOD if n >= LONG or density >= STOP_HIGH and b.inside else OPEN


def labels(found: list[Block]) -> list[int]:
    """Both passes: a label for each block."""
    words = [w for b in found if not b.furniture for w in _WORD.findall(b.text.lower())]
    stops = sum(w in STOP_WORDS for w in words) >= 0.02 * len(words)  # else no language that is known here
    article = any(b.inside and not b.furniture for b in found)
    first = [_first_label(b, stops, article) for b in found]
    out = list(first)
    before, after = [None] * len(first), [None] * len(first)
    for side, order in ((before, range(len(first))), (after, reversed(range(len(first))))):
        near = None
        for i in order:
            side[i] = near
            # Furniture says nothing about the article that it stands in.
            if first[i] != OPEN and not (article and (found[i].furniture or not found[i].inside)):
                near = i
    for i, x in enumerate(first):
        if x != OPEN:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if not near:
            out[i] = GOOD
        else:
            best = min(abs(i - j) for j in near)
            out[i] = max(first[j] for j in near if abs(i - j) == best)
    if article and not any(x == GOOD for x in out):
        out = [GOOD if b.inside and not b.furniture else BAD for b in found]
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return " ".join(b.text for b, x in zip(found, labels(found)) if x == GOOD)


def _kernel(batches):
    for part, pages in text_slices(batches, "html"):
        texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars)."""
    own = only(pages, id, url, html).toDF("id", "url", "html")
    kinds = dict(own.dtypes)
    return own.mapInArrow(_kernel, f"id {kinds['id']}, url string, text string, n_chars long").withColumnsRenamed({"id": id, "url": url})
