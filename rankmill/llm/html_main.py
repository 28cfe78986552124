"""Main text of web pages by boosted trees over the nodes of the document tree.

A page becomes a tree of block elements; inline markup only adds to the text of its block. Each node is
scored by gradient-boosted trees for holding main text somewhere below it. Decoding is hierarchical: a
node can be in only if its parent is, and the best consistent choice is found from the leaves up, where a
subtree is worth the larger of zero and its node's log-odds plus the worth of its children. No kept
paragraph can then stand in a dropped container.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.boosting import Trees
from rankmill.llm.common import hash_share, slices

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose start tag ends an open paragraph, and parts of tables and forms: these are blocks. Every other
#: element, known or not, is inline and only adds to the text of its block.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
BLOCK = ENDS_P | frozenset("caption legend tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of a page: all up to their own end tag is skipped.
SILENT = frozenset("head svg object canvas audio video map button select label datalist".split())
#: Elements that may stand in a head; any other start tag ends it.
HEAD = frozenset("title style script meta link base noscript template html".split())
#: Elements without text of a page whose content is not markup.
RAW = frozenset("script style textarea title iframe noscript template".split())
#: A start tag of the key ends an open element of the values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
TAG_GROUPS = (
    "nav menu", "header", "footer", "aside", "form fieldset dialog", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol li",
    "table tbody thead tr td th", "blockquote pre", "figure figcaption", "dl dt dd", "body html",
)
TAG_GROUP = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group.split()}
#: Beginnings of attribute tokens by what they name; the last two groups speak for main text.
TOKEN_GROUPS = (
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion", "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager tabs",
    "sidebar side aside rail widget widgets", "foot footer copyright legal colophon", "head header masthead topbar branding",
    "cookie cookies consent notice alert warning popup modal overlay gdpr disclaimer banner", "comment comments disqus reply replies respond discussion reviews",
    "share sharing social related recommended recommendations more trending popular tags", "form login signup signin subscribe newsletter search register poll",
    "article story post entry blogpost news", "content main body text prose page copy maincontent",
)
TOKEN_GROUP = {token: i for i, group in enumerate(TOKEN_GROUPS) for token in group.split()}
NEGATIVE_TAGS = frozenset("nav menu header footer aside form fieldset dialog".split())
PUNCTUATION = re.compile(r"[.,;:!?]")
#: Pages sampled from the table and pages made from templates for training: fixed upper bounds.
TRAIN_PAGES = 200
TRAIN_TEMPLATES = 400


def token_groups(attributes: str) -> list[int]:
    """Groups named by the tokens of class, id, role, label and itemprop."""
    found = []
    for match in ATTRIBUTE.finditer(attributes):
        value = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", match[1] or match[2] or match[3] or "")
        found += [TOKEN_GROUP[t] for t in re.split(r"[^a-z]+", value.lower()) if t in TOKEN_GROUP]
    return found


@dataclass
class Page:
    """Block nodes in page order (0 is the root) and the text runs with the node that owns them."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    groups: list[list[int]] = field(default_factory=lambda: [[]])
    attributes: list[str] = field(default_factory=lambda: [""])
    inner: list[int] = field(default_factory=lambda: [0])
    inputs: list[int] = field(default_factory=lambda: [0])
    #: (node, text, in a link); a None text ends the block that was open.
    runs: list[tuple[int, str | None, bool]] = field(default_factory=list)

    @staticmethod
    def parse(source: str) -> Page:
        """Blocks and text runs, in time proportional to the source.

        The number of open elements is kept by tag, so the stack is only searched for what is on it, and what a
        search passes is closed. In a skipped element nothing counts but its own end tag or that of an element
        around it (some pages leave buttons and labels open).
        """
        page, at = Page(), 0
        stack: list[tuple[str, int]] = [("html", 0)]
        opened: Counter[str] = Counter()
        skipped, inside, endless = "", Counter(), set()

        def close(place: int) -> None:
            for tag, _ in stack[place:]:
                opened[tag] -= 1
            if any(tag in BLOCK for tag, _ in stack[place:]):
                page.runs.append((stack[place - 1][1], None, False))
            del stack[place:]

        def close_nearest(tag: str) -> None:
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))

        def text(piece: str) -> None:
            if piece and not skipped:
                page.runs.append((stack[-1][1], html.unescape(piece), opened["a"] > 0))

        position = 0
        while (match := TAG.search(source, position)) is not None:
            text(source[at : match.start()])
            at = position = match.end()
            tag, ends = (match[2] or "").lower(), bool(match[1])
            if not tag:
                continue
            if tag in RAW and not ends:
                if not skipped:
                    page.inner[stack[-1][1]] += 1
                if match[3].endswith("/") and skipped == "svg":
                    continue
                end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                if end is not None:
                    at = position = end.end()
                elif tag in ("noscript", "template"):
                    endless.add(tag)
                else:
                    at = position = len(source)
                continue
            if skipped == "head" and not ends and tag not in HEAD:
                skipped = ""
            if skipped:
                if not ends:
                    if tag not in VOID and not match[3].endswith("/"):
                        inside[tag] += 1
                    continue
                if inside[tag] > 0:
                    inside[tag] -= 1
                    continue
                if tag == skipped:
                    skipped = ""
                elif skipped != "object" and opened[tag] > 0:
                    skipped = ""
                    close_nearest(tag)
                continue
            if ends:
                if opened[tag] > 0:
                    close_nearest(tag)
                elif tag == "p":
                    page.runs.append((stack[-1][1], None, False))
                continue
            if tag in ENDS_P and opened["p"] > 0:
                close_nearest("p")
            if any(opened[x] > 0 for x in ENDS.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPES.get(tag, ()):
                        break
                    if stack[i][0] in ENDS[tag]:
                        close(i)
                        break
            owner = stack[-1][1]
            page.inner[owner] += 1
            if tag in VOID:
                page.inputs[owner] += tag == "input"
                page.runs.append((owner, None, False) if tag == "hr" else (owner, " ", False))
                continue
            if tag in ("html", "body"):
                continue
            if tag in SILENT:
                if not match[3].endswith("/"):
                    skipped, inside = tag, Counter()
                continue
            if tag in BLOCK:
                page.runs.append((owner, None, False))
                page.tags.append(tag)
                page.parents.append(owner)
                page.groups.append(token_groups(match[3]) if match[3] else [])
                page.attributes.append(match[3])
                page.inner.append(0)
                page.inputs.append(0)
                owner = len(page.tags) - 1
            stack.append((tag, owner))
            opened[tag] += 1
        text(source[at:])
        return page

    def text(self, kept: np.ndarray) -> str:
        """Blocks of the kept nodes, white space collapsed, joined by blank lines."""
        blocks, current, owner = [], [], -1
        for node, piece, _ in [*self.runs, (0, None, False)]:
            if piece is None or node != owner:
                if line := " ".join("".join(current).split()):
                    blocks.append(line)
                current, owner = [], node
            if piece is not None and kept[node]:
                current.append(piece)
        return "\n\n".join(blocks)

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parents = np.array(self.parents)
        own = np.zeros((n, 4))
        for node, piece, link in self.runs:
            if piece:
                size = len(piece.strip())
                own[node] += (size, size * link, len(PUNCTUATION.findall(piece)), 0)
        own[:, 3] = self.inner
        start = np.cumsum(own[:, 0]) - own[:, 0]
        total = own.copy()
        paragraphs = np.array([tag == "p" for tag in self.tags], dtype=float)
        inputs = np.array(self.inputs, dtype=float)
        depth = np.zeros(n)
        children = np.zeros(n)
        negative, positive = np.zeros(n), np.zeros(n)
        counts = np.zeros((n, len(TOKEN_GROUPS)))
        kinds = np.zeros((n, len(TAG_GROUPS) + 1))
        for i in range(n):
            kinds[i, TAG_GROUP.get(self.tags[i], len(TAG_GROUPS))] = 1
            for g in self.groups[i]:
                counts[i, g] += 1
            if i:
                p = parents[i]
                depth[i] = depth[p] + 1
                children[p] += 1
                bad = self.tags[p] in NEGATIVE_TAGS or counts[p, :9].any()
                negative[i] = max(negative[p], bad)
                positive[i] = max(positive[p], self.tags[p] in ("article", "main") or counts[p, 9:].any())
        place, same = np.zeros(n), {}
        seen: dict[int, int] = {}
        largest = np.zeros(n)
        for i in range(n - 1, 0, -1):
            total[parents[i]] += total[i]
            paragraphs[parents[i]] += paragraphs[i]
            inputs[parents[i]] += inputs[i]
        for i in range(1, n):
            p = int(parents[i])
            place[i] = seen.get(p, 0)
            seen[p] = seen.get(p, 0) + 1
            same[p, self.tags[i]] = same.get((p, self.tags[i]), 0) + 1
            largest[p] = max(largest[p], total[i, 0])
        siblings = np.maximum(1, children[np.maximum(parents, 0)])
        alike = np.array([same.get((int(p), t), 1) for p, t in zip(parents, self.tags)])
        chars = np.maximum(1, total[:, 0])
        hidden = np.array([bool(a) and HIDDEN.search(a) is not None for a in self.attributes], dtype=float)
        columns = [
            depth, np.log1p(total[:, 0]), total[:, 1] / chars, np.log1p(total[:, 0] / (1 + total[:, 3])), total[:, 2] / chars, np.log1p(children),
            place / siblings, np.log1p(siblings), alike / siblings, total[:, 0] / max(1, total[0, 0]), total[:, 0] / np.maximum(1, largest[np.maximum(parents, 0)]),
            np.log1p(paragraphs), np.log1p(inputs), start / max(1, total[0, 0]), negative, positive, hidden,
        ]
        return np.column_stack([*columns, kinds, counts])

    def decode(self, log_odds: np.ndarray) -> np.ndarray:
        """The kept nodes: the best choice in which every kept node has a kept parent; the root is kept."""
        worth = log_odds.copy()
        for i in range(len(worth) - 1, 0, -1):
            worth[self.parents[i]] += max(0.0, worth[i])
        kept = np.zeros(len(worth), dtype=bool)
        kept[0] = True
        for i in range(1, len(worth)):
            kept[i] = kept[self.parents[i]] and worth[i] > 0
        return kept


def weak_labels(page: Page) -> np.ndarray:
    """1 where a node holds main text by plain signs: in an article or main element, in nothing negative."""
    n = len(page.tags)
    inside, barred, main = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n)
    for i in range(1, n):
        p = page.parents[i]
        inside[i] = inside[p] or page.tags[i] in ("article", "main") or "data-main" in page.attributes[i]
        barred[i] = barred[p] or page.tags[i] in NEGATIVE_TAGS or any(g < 9 for g in page.groups[i]) or "data-not" in page.attributes[i]
        main[i] = inside[i] and not barred[i]
    for i in range(n - 1, 0, -1):
        main[page.parents[i]] = max(main[page.parents[i]], main[i])
    return main


def template_pages(count: int = TRAIN_TEMPLATES, seed: int = 3) -> list[str]:
    """Labelled pages of many shapes; data-main and data-not mark what is main text and what is not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["an", "er", "ti", "lo", "que", "st", "ou", "sch", "ra"], k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + rng.choice([".", ".", "!", "?"])
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.randint(a, b)))
    plain = lambda: rng.choice(["", "", f' class="{word()}"', f' id="{word()}-{word()}"'])

    def name(group: int) -> str:
        token = rng.choice(TOKEN_GROUPS[group].split())
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", word() + "-", "site-", word() + " "])}{token}{rng.choice(["", "-" + word(), "s"])}"'

    def junk() -> str:
        group = rng.randrange(9)
        inner = rng.choice([
            lambda: f"<ul>{links(1, 8)}</ul>", lambda: sentence(), lambda: f"<p>{prose(1, 2)}</p>", lambda: f"<h3>{words(1, 4)}</h3><p>{prose(1, 3)}</p>",
            lambda: f"<h4>{words(1, 3)}</h4><ul>{links(2, 6)}</ul>",
        ])()
        if group == 8:
            return f"<form{rng.choice([name(8), ''])} data-not><p>{words(1, 5)}</p><input type=text>{rng.choice(['', f'<p>{sentence()}</p>'])}</form>"
        if group == 6:
            inner = "".join(f"<div{name(6)}><p>{prose(1, 3)}</p></div>" for _ in range(rng.randint(1, 4)))
        bare = {1: "nav", 2: "aside", 3: "footer", 4: "header"}.get(group)
        if bare and rng.random() < 0.5:
            return f"<{bare}{rng.choice([plain(), name(group)])} data-not>{inner}</{bare}>"
        box = rng.choice(["div", "div", "section", "aside"])
        return f"<{box}{name(group)} data-not>{inner}</{box}>"

    def body() -> str:
        parts = [f"<h1>{words(2, 8)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            parts.append(rng.choice([
                lambda: f"<p>{prose(1, 6)}</p>", lambda: f"<p>{prose(1, 6)}</p>", lambda: f"<p>{sentence()}</p>", lambda: f"<p>{words(1, 3)}.</p>",
                lambda: f"<p><b>{prose(1, 2)}<br>", lambda: f"<h2>{words(1, 5)}</h2><p>{prose(1, 4)}</p>", lambda: f"<ul><li>{sentence()}</li><li>{words(1, 6)}</li></ul>",
                lambda: f"<blockquote><p>{prose(1, 2)}</p></blockquote>", lambda: f"<p>{prose(1, 2)} <a href=/x>{words(1, 4)}</a> {sentence()}</p>",
                lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr></table>", lambda: f"<div{plain()}><p>{prose(1, 3)}</p></div>",
                lambda: f"<pre>{words(3, 9)}</pre>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>",
            ])())
            if rng.random() < 0.12:
                parts.append(junk())
        return "".join(parts)

    pages = []
    for _ in range(count):
        tag, mark = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", name(9)), ("div", name(10)), ("section", name(9)), ("div", plain())])
        main = f"<{tag}{mark}{plain() if not mark else ''} data-main>{body()}{junk() if rng.random() < 0.3 else ''}</{tag}>"
        for _ in range(rng.choice([0, 0, 1, 2])):
            main = f"<div{plain()}>{rng.choice(['', junk()])}{main}{rng.choice(['', junk()])}</div>"
        before, after = "".join(junk() for _ in range(rng.randint(0, 3))), "".join(junk() for _ in range(rng.randint(0, 3)))
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{before}{main}{after}</body></html>")
    return pages


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", rows: int = TRAIN_PAGES) -> Trees:
    """Trees fitted on the labelled templates and, with ``weak_labels``, at most ``rows`` pages drawn by
    the hash of their id.

    Sampled pages without an article or main element carry no signs and are left out of the fit.
    """
    drawn = hash_share(F.col(page_id).cast("string")) < min(1.0, 1.2 * rows / max(1, pages.count()))
    some = pages.where(F.col(source).isNotNull() & drawn).select(source).orderBy(F.xxhash64(source), source).limit(rows)
    parsed = [Page.parse(x) for x in [*template_pages(), *(r[0] for r in some.collect())]]
    labels = [weak_labels(p) for p in parsed]
    used = [(p.features()[1:], y[1:]) for p, y in zip(parsed, labels) if len(y) > 1 and y.any()]
    x, y = np.concatenate([f for f, _ in used]), np.concatenate([t for _, t in used])
    return Trees().fit(x, y, np.ones(len(y)))


def main_text(source: str | None, trees: Trees) -> str:
    page = Page.parse(source or "")
    return page.text(page.decode(trees.log_odds(page.features())))


def extract(pages: DataFrame, trees: Trees, source: str = "html") -> DataFrame:
    """``pages`` without the source, plus ``text`` and its length ``n_chars`` in code points.

    Every row comes back once. Null and empty sources and pages without main text give the empty string;
    text outside any element is kept. Columns named like the outputs are replaced.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for part in slices(iter([batch.to_frame("html")]), 64):
                parsed = [Page.parse(x or "") for x in part["html"]]
                found = [p.features() for p in parsed]
                scores = np.split(trees.log_odds(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
                out += [p.text(p.decode(s)) for p, s in zip(parsed, scores)]
            yield pd.Series(out, dtype=object)

    keep = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    found = pages.select(*keep, texts(F.col(source)).alias("text"))
    return found.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
