"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page is read once, tag by tag, into a flat list of blocks: runs of text between block-level tags. A block is described by
its number of words and its link density, by those of its neighbours, by whether it stands inside an article, and by
how far it stands inside page furniture (navigation, footer, advert, comments and the like, told by element, class, id and
role): 1 inside, 0.5 where the name may as well be the subject of a section (``discussion``), 0 outside. An article or
main element below furniture is outside again, unless it is hidden. A form without such a name that holds more than half of the
page's words, no article around it, is the wrapper of the page and no furniture. A small decision tree, trained on the labelled blocks of ``labelled_blocks.py``, keeps or drops every block.

The reference project keeps no web pages, so this operator is general: any table with a key and an html column.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gradewell.llm.common import per_batch
from gradewell.llm.labelled_blocks import KEPT, LABELLED_PAGES

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "in_furniture")
BLOCK_TAGS = frozenset("""address article aside blockquote body head caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose start and end are followed, to know what a block stands in.
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header main menu nav ol p pre search section select span table ul".split())
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form header menu nav search select".split())
ARTICLE_TAGS = frozenset(["article", "main"])
#: Elements whose content is never page text.
SILENT = "script|style|noscript|template|textarea|title|iframe|object|svg|math|canvas|audio|video"
#: Of these, the ones that a tag ending in ``/>`` closes, and the ones that it closes only if the page has no end tag for them.
EMPTY = "svg|math"
FALLBACK = frozenset("object canvas audio video".split())
FURNITURE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright dialog
disclaimer discussion disqus feedback foot footer form gdpr head header login masthead menu menubar meta modal nav navbar navigation newsletter notice pager pagination popup
privacy promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar
widget widgets banners contentinfo complementary alert alertdialog legal notification notifications responses""".split())
#: Words that begin like these count too (commentlist, cookiebar).
FURNITURE_STEMS = ("advert", "adsby", "banner", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "navbar", "navig", "newsletter", "popup", "promo", "sidebar", "sponsor", "subscri")
#: Of these, the ones that are subjects of sections as well; so are words that begin like ``TOPIC_STEMS``.
TOPIC_NAMES = frozenset("consent cookies copyright disclaimer discussion feedback legal notice notification notifications privacy promotion register responses search".split())
TOPIC_STEMS = ("commentar", "commentator", "navigator", "promoter")
#: Last words that say nothing of what an element holds; boxes are judged by the word before, wrappers only if all other words agree.
BOX_WORDS = frozenset("area bar block box button buttons col column form group icon icons inner item items label link links list panel row section slot text title top unit".split())
WRAP_WORDS = frozenset("container content grid inner layout main outer page site wrap wrapper".split())
STATE_WORDS = frozenset("no with without has".split())
#: Names of readers' comments, in which an article element is a comment.
COMMENT_NAMES = ("comment", "disqus", "replies", "reply", "respond")
ARTICLE_NAMES = frozenset("article articlebody content entry main post story".split())
#: Attributes; outside quotes they end at ``<`` too, and nothing is tried twice, so a page is read in one pass.
INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(?:{EMPTY})(?=[\s/>]){INSIDE}(?<=/)>|<({SILENT})(?=[\s/>])({INSIDE})>|<(/?)([a-zA-Z][^\s/><]*)({INSIDE})(?:>|(?=<))|<[!?/][^<>]*>""", re.S | re.I)
SILENT_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT.split("|")}
NAME = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[a-z]+", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_furniture: float


def furniture_word(word: str) -> float:
    """1 for a name of page furniture, 0.5 for one that may be a subject as well, else 0."""
    if word in TOPIC_NAMES or word.startswith(TOPIC_STEMS):
        return 0.5
    return float(word in FURNITURE_NAMES or word.startswith(FURNITURE_STEMS))


def furniture_token(words: list[str]) -> float:
    """As ``furniture_word``, for the words of one class, id or role: the last one that says what the element holds decides."""
    if STATE_WORDS & set(words):
        return 0.0
    if len(words) > 1 and words[-1] in WRAP_WORDS:
        return min(map(furniture_word, words[:-1]))
    while len(words) > 1 and words[-1] in BOX_WORDS:
        words = words[:-1]
    last = furniture_word(words[-1])
    return max(map(furniture_word, words)) if last else 0.0


def names_of(tag: str, attributes: str) -> tuple[bool, float, bool, bool]:
    """Whether an element opens an article, how far it opens page furniture, whether an article element in it is
    furniture too (an aside's teaser, a reader's comment), and whether it is hidden."""
    article, furniture = tag in ARTICLE_TAGS, float(tag in FURNITURE_TAGS)
    whole, hidden = tag in FURNITURE_TAGS and tag not in ("form", "header", "fieldset"), False
    if attributes:
        for name, value in NAME.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("hidden",) or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN_STYLE.search(value):
                hidden = True
            elif name in ("class", "id", "role"):
                for token in value.split():
                    found = [w.lower() for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))]
                    if not found or found[0] in STATE_WORDS:
                        continue
                    if len(found) == 1 and found[0] in ARTICLE_NAMES:
                        article = True
                    elif len(found) > 1 and found[0] in ARTICLE_NAMES and found[1] in ("content", "body", "text", "header", "title"):
                        article |= found[1] in ("content", "body", "text")
                    elif level := furniture_token(found):
                        furniture = max(furniture, level)
                        whole |= level == 1 and any(w.startswith(COMMENT_NAMES) for w in found)
    if tag == "body":
        return article, 0.0, False, False
    return article, furniture, whole, hidden and tag not in ARTICLE_TAGS


def blocks_of(html: str | None) -> list[Block]:
    """The flat text blocks of a page, without empty ones, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[bool, float, bool, bool, int]]] = []
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = links = 0
    #: Words below each form that may be the wrapper of the page, and the form each block stands in (-1: none).
    forms: list[int] = []
    form_of: list[int] = []
    #: In an article, level of furniture, whether articles in it are furniture, hidden, form; ``stack`` has what held before each element.
    state = (False, 0.0, False, False, -1)

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), state[0], 1.0 if state[3] else state[1]))
                form_of.append(state[4])
                if state[4] >= 0:
                    forms[state[4]] += words
            held.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            held.append(piece)
            if links:
                linked += len(piece.split())

    html = html or ""
    at = 0
    unclosed: set[str] = set()  # silent elements without a further end tag
    while found := TAG.search(html, at):
        if found.start() > at:
            put(html[at:found.start()])
        at = found.end()
        silent, inside, slash, tag, attributes = found.groups()
        if silent:
            silent = silent.lower()
            end = None if silent in unclosed else SILENT_END[silent].search(html, at)
            if end:
                at = end.end()
            else:
                unclosed.add(silent)
                if not (silent in FALLBACK and inside.endswith("/")):
                    at = len(html)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if slash else 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag not in CONTAINERS:
            continue
        if slash:
            if opened[tag]:
                while stack:
                    name, state = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            continue
        if tag == "p":
            if stack and stack[-1][0] == "p":
                name, state = stack.pop()
                opened[name] -= 1
        elif tag in BLOCK_TAGS:
            while stack and stack[-1][0] in ("p", "span"):
                name, state = stack.pop()
                opened[name] -= 1
        article, level, whole, hidden, form = state
        opens_article, opens, opens_whole, opens_hidden = names_of(tag, attributes)
        if tag == "header" and article and not any(w in attributes.lower() for w in ("nav", "menu")):
            opens = 0.0  # the heading of an article
        if tag == "form" and form < 0 and not article and not names_of("div", attributes)[1]:
            opens, form = 0.0, len(forms)
            forms.append(0)
        if tag in ARTICLE_TAGS:
            if tag == "main" or not whole and opens < 1:
                level, whole, form = 0.0, False, -1
            opens = 0.0
        stack.append((tag, state))
        opened[tag] += 1
        state = article or opens_article, max(level, opens), whole or opens_whole and opens > 0, hidden or opens_hidden, form
    put(html[at:])
    close()
    everything = sum(b.words for b in out)
    for block, form in zip(out, form_of):
        if form >= 0 and 2 * forms[form] <= everything:
            block.in_furniture = 1.0
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block; beyond the ends of the page stand empty neighbours."""
    words = np.array([b.words for b in blocks], float)
    density = np.array([b.linked / b.words for b in blocks], float)
    shift = lambda x, by: np.concatenate([[0.0], x[:-1]]) if by > 0 else np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, density, shift(words, 1), shift(density, 1), shift(words, -1), shift(density, -1),
                            [b.in_article for b in blocks], [b.in_furniture for b in blocks]]).astype(float)


class DecisionTree:
    """Binary splits by Gini impurity, grown until ``least`` rows or ``depth``."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1) -> None:
        self.root = self.grow(rows, labels, depth, least)

    def grow(self, rows: np.ndarray, labels: np.ndarray, depth: int, least: int):
        share = labels.mean()
        if depth == 0 or len(labels) < 2 * least or share in (0.0, 1.0):
            return float(share)
        best = (2 * share * (1 - share) - 1e-9, None, None)
        for feature in range(rows.shape[1]):
            values = np.unique(rows[:, feature])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, feature] <= cut
                n = low.sum()
                if least <= n <= len(labels) - least:
                    a, b = labels[low].mean(), labels[~low].mean()
                    impurity = (n * 2 * a * (1 - a) + (len(labels) - n) * 2 * b * (1 - b)) / len(labels)
                    if impurity < best[0]:
                        best = (impurity, feature, cut)
        if best[1] is None:
            return float(share)
        low = rows[:, best[1]] <= best[2]
        return best[1], best[2], self.grow(rows[low], labels[low], depth - 1, least), self.grow(rows[~low], labels[~low], depth - 1, least)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))

        def go(node, chosen: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[chosen] = node
                return
            low = rows[chosen, node[0]] <= node[1]
            go(node[2], chosen[low])
            go(node[3], chosen[~low])

        go(self.root, np.arange(len(rows)))
        return out >= 0.5


@lru_cache(maxsize=1)
def block_tree() -> DecisionTree:
    """The tree trained on the labelled pages; a few hundred rows."""
    rows, labels = [], []
    for page in LABELLED_PAGES:
        found = blocks_of(page)
        rows.append(features_of(found))
        labels.append([b.text.endswith(KEPT) for b in found])
    return DecisionTree(np.vstack(rows), np.concatenate(labels).astype(float))


def main_text(html: str | None) -> str:
    """Kept blocks in page order, joined by a line feed."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    keep = block_tree().predict(features_of(blocks))
    return "\n".join(b.text for b, ok in zip(blocks, keep) if ok)


def extract_main_text(pages: DataFrame, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, carried columns, text, n_chars) for every page; no shuffle.

    ``text`` is the article: character references decoded, white space inside a block made one space and trimmed, blocks
    in page order joined by ``\\n``. It is empty where there is none, and for a null or empty page; ``n_chars`` counts its
    code points. Broken and unclosed mark-up is read to the end of the page. Keys may be null or repeated; columns other
    than the named ones are not read. An empty table gives an empty result.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, *carry)}
    inner = {f"c{i}": c for i, c in enumerate(kinds)}
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in inner.items()) + ", text string, n_chars bigint"

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in rows["html"]]
        return {**{n: rows[n] for n in inner}, "text": texts, "n_chars": [len(t) for t in texts]}

    return per_batch(pages, {**inner, "html": html}, schema, work, weigh="html").toDF(*kinds, "text", "n_chars")
