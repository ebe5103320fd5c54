"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded hierarchically.

* A small tag-soup reader builds the DOM of a page: void elements, raw-text elements,
  implied ends of paragraphs and list items, unclosed and stray tags. It reads any text in
  linear time: every character is looked at a bounded number of times.
* Every element has features: text and tag density of its subtree, share of link text,
  depth, place among its siblings and how alike they are, and how often its tag and the words
  of its class, id and role stood inside or outside of main text in the training pages.
* Training labels have two sources. By structure: the subtree that holds the most running
  text is main text, less what is mostly links, and less texts that many training pages
  repeat. By names, in pages with `article` or `main`: what lies in them is main text, less
  elements that NOT_MAIN words name. Where both exist, names decide and elements on which
  they disagree weigh less; other pages have the labels of structure alone. In half of the
  copies tag and attribute words are masked, so that the trees also learn the structure; in a
  third the parts beside main text are put inside it, so that they learn to cut. At most
  `sample` pages are read for training.
* Decoding: each element is outside, main, or cut out of main; only outside -> main -> cut is
  allowed from parent to child, so no choice contradicts that of an ancestor. The best
  labelling of a page is found by dynamic programming over the tree.

Nothing is lost to odd markup: foreign elements (`svg`, `math`) end at `/>`, at their end tag or at the
next HTML block; a button or list of choices is cut out only if its end tag is there. Where the best
labelling keeps nothing, all of the page is main text but links, what boilerplate words name and what is cut out,
so a page has an empty text only if nothing else is visible.

Defined cases: null or empty html gives an empty text; a page without block elements is plain
text and all of it main text; an unclosed tag at the end is text; a quote that is never closed ends
with its tag; pages are judged alone, so repeated rows give the same text; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong strike sub sup time tt u var ins del".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Read like other elements, and cut out of every text once their end tag is seen.
CUT_OUT = frozenset("svg math button select datalist".split())
FOREIGN = frozenset("svg math".split())
CLOSED_BY = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
# Words that name parts of a page beside its main text.
NOT_MAIN = frozenset("nav navigation navbar menu header masthead footer sidebar aside widget ad ads advert advertisement sponsor sponsored promo banner cookie consent notice popup modal share social comment comments respond related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter login signup form search toolbar copyright disclaimer".split())
MAIN = frozenset(("article", "main"))

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
QUOTED = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+""")
ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


class Page:
    """Elements of a page in document order; element 0 is the root."""

    __slots__ = ("tag", "parent", "words", "texts", "depth", "hidden")

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.words, self.depth = ["#root"], [-1], [()], [0]
        #: (element, text, begins a new block)
        self.texts: list[tuple[int, str, bool]] = []
        stack, tag, at, fresh = [0], self.tag, 0, True
        #: of each open element: the place in the stack of the paragraph that a block would close, or 0
        paragraph, opened = [0], {}
        size, last, last_cdata, quotes = len(html), html.rfind(">"), html.rfind("]]>"), True

        ended = set()

        def close(k):
            for node in stack[k:]:
                opened[tag[node]] -= 1
            del stack[k:], paragraph[k:]

        def say(text):
            nonlocal fresh
            self.texts.append((stack[-1], entities.unescape(text) if "&" in text else text, fresh))
            fresh = False

        while at < size:
            start = html.find("<", at)
            if start != at:
                say(html[at:start] if start > 0 else html[at:])
                at = start if start > 0 else size
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = end + 3 if end >= 0 else size
                continue
            if at > last:  # no tag ends any more
                say(html[at:])
                break
            if html.startswith("<![CDATA[", at) and at < last_cdata:
                at = html.find("]]>", at) + 3
                continue
            if html[at + 1 : at + 2] in ("!", "?"):
                at = html.find(">", at) + 1
                continue
            m = NAME.match(html, at + 1)
            if m is None:
                say("<")
                at += 1
                continue
            end = QUOTED.match(html, m.end()).end() if quotes else html.find(">", m.end())
            if end >= size or html[end] != ">":  # a quote is never closed: from here on quotes mean nothing
                quotes, end = False, html.find(">", m.end())
            attrs, name, closing = html[m.end() : end], m.group(1).lower(), html[at + 1] == "/"
            at = end + 1
            if name not in INLINE:
                fresh = True
            if closing:
                if opened.get(name):
                    k = next(k for k in range(len(stack) - 1, 0, -1) if tag[stack[k]] == name)
                    ended.add(stack[k])
                    close(k)
                continue
            foreign = any(map(opened.get, FOREIGN))
            if foreign and name in CLOSES_P and not opened.get("foreignobject"):  # an HTML block ends an unclosed drawing
                k = next(k for k in range(1, len(stack)) if tag[stack[k]] in FOREIGN)
                ended.add(stack[k])
                close(k)
                foreign = False
            if name in CLOSES_P:
                if paragraph[-1]:
                    close(paragraph[-1])
            elif name in CLOSED_BY and tag[stack[-1]] in CLOSED_BY[name].split():
                close(len(stack) - 1)
            if name in VOID:
                continue
            node = len(tag)
            tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.words.append(tuple(dict.fromkeys(w for a in ATTR.findall(attrs) for w in WORD.findall("".join(a).lower()))) if "=" in attrs else ())
            if attrs.rstrip().endswith("/") and (foreign or name in FOREIGN):
                continue
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(html, at)
                at = found.end() if found else size
            else:
                paragraph.append(len(stack) if name == "p" else paragraph[-1] if name in INLINE else 0)
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1

        #: elements that are cut out of every text, with all that is in them
        self.hidden = [False] * len(tag)
        for k in range(1, len(tag)):
            self.hidden[k] = self.hidden[self.parent[k]] or tag[k] in CUT_OUT and k in ended
        self.texts = [x for x in self.texts if not self.hidden[x[0]]]

    def text(self, keep) -> str:
        """Text of the kept elements: blanks within a block to one space, blocks joined by one space."""
        parts: list[str] = []
        for node, text, fresh in self.texts:
            if keep[node]:
                if fresh:
                    parts.append(" ")
                parts.append(text)
        return " ".join("".join(parts).split())


def names_boilerplate(tag: str, words: tuple) -> bool:
    return tag in NOT_MAIN or tag in RAW or tag in CUT_OUT or any(w in NOT_MAIN for w in words)


def remaining(page: Page) -> list[bool]:
    """All but links and what boilerplate words name."""
    keep = [True] * len(page.tag)
    for k in range(1, len(keep)):
        bad = names_boilerplate(page.tag[k], page.words[k]) and page.tag[k] not in CUT_OUT and page.tag[k] not in MAIN
        keep[k] = keep[page.parent[k]] and page.tag[k] != "a" and not bad
    return keep


FEATURES = 18


def features(page: Page, odds: dict[str, float], mask: bool = False) -> np.ndarray:
    """One row per element."""
    n, parent = len(page.tag), page.parent
    own, links, below = [0.0] * n, [0.0] * n, [1.0] * n
    stops, parts = [0.0] * n, [0.0] * n
    for node, text, _ in page.texts:
        own[node] += len(text)
        stops[node] += text.count(".") + text.count(",")
        parts[node] += 1
    total, dots, chunks = own[:], stops[:], parts[:]
    tags = page.tag
    blocks = [0.0] * n
    kids: list[int] = [0] * n
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if tags[k] == "a":
            links[k] = total[k]
        total[p] += total[k]
        links[p] += links[k]
        below[p] += below[k]
        dots[p] += dots[k]
        chunks[p] += chunks[k]
        kids[p] += 1
        if tags[k] == "p":
            blocks[k] += 1
        blocks[p] += blocks[k]
    place, alike, seen = [0] * n, [0] * n, {}
    for k in range(1, n):
        p = parent[k]
        place[k] = seen.get((p, ""), 0)
        seen[(p, "")] = place[k] + 1
        alike[k] = seen[(p, tags[k])] = seen.get((p, tags[k]), 0) + 1
    word, low, high = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n if not mask else 0):
        values = [odds.get(w, 0.0) for w in page.words[k]]
        said = min(values) if values and min(values) < -1 else sum(values)
        if tags[k] in NOT_MAIN or tags[k] in MAIN:
            said += odds.get("<" + tags[k], 0.0)
        word[k] = said
        # what names say of the elements around, from the innermost `article` or `main` on
        low[k] = 0.0 if tags[k] in MAIN else min(said, low[parent[k]] if k else 0.0)
        high[k] = max(said, high[parent[k]] if k else 0.0)
    p = np.array(parent)
    p[0] = 0
    t, l_, b, d = np.array(total), np.array(links), np.array(below), np.array(page.depth, float)
    dots_, own_, k_, w = np.array(dots), np.array(own), np.array(kids, float), np.array(word)
    whole = max(1.0, total[0])
    same = np.array([seen.get((parent[k], tags[k]), 1) for k in range(n)], float)
    many = np.maximum(1, k_[p])
    cols = [
        np.log1p(t), np.log1p(t / b), l_ / np.maximum(1, t), t / whole, d, np.array(place) / many, same / many, np.log1p(many),
        dots_ / np.maximum(1, t) * 100, np.log1p(own_), w, np.array(low), np.array(high), t / np.maximum(1, t[p]),
        np.log1p(k_), np.log1p(np.array(blocks)), np.log1p(t[p] / b[p]), np.array(chunks) / b,
    ]
    return np.stack(cols, axis=1).astype(np.float32)


def named_labels(page: Page) -> list[int] | None:
    """1 in main text, 0 outside, by sectioning elements and boilerplate words; None if the page has no such element."""
    if not MAIN & set(page.tag):
        return None
    out = [0] * len(page.tag)
    for k in range(1, len(out)):
        bad = names_boilerplate(page.tag[k], page.words[k]) and page.tag[k] not in MAIN
        out[k] = int(not bad and (out[page.parent[k]] == 1 or page.tag[k] in MAIN))
    return out


#: Characters of a text that may be running text.
RUNNING = 60


def plain(text: str) -> str:
    return " ".join(text.split())


def grafted(page: Page, labels: list[int]) -> tuple[Page, list[int]] | None:
    """The page with its parts beside main text put inside it, among its children, and children put into those; None if it has none.

    Training pages may show adverts, forms and comments outside of main text only, and without paragraphs; in others they
    stand within, and read like main text."""
    parent, n, y = list(page.parent), len(page.tag), list(labels)
    main = next((k for k in range(1, n) if y[k] and not y[parent[k]] and page.tag[k] in MAIN), None)
    inside = [False] * n
    parts: list[int] = []
    for k in range(1, n):
        named = names_boilerplate(page.tag[k], page.words[k]) and page.tag[k] not in RAW and not y[k]
        if named and not inside[parent[k]]:
            parts.append(k)
        inside[k] = inside[parent[k]] or named
    if main is None or inside[main] or not parts:
        return None
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        kids[parent[k]].append(k)
    text = kids[main][:]
    for i, h in enumerate(parts):
        kids[parent[h]].remove(h)
        kids[main].insert((i + 1) * len(kids[main]) // (len(parts) + 1), h)
    for h, k in zip(parts, text[1::3]):  # read like main text, though they are none
        kids[main].remove(k)
        kids[h].append(k)
    order, left = [], [0]
    while left:
        k = left.pop()
        order.append(k)
        left += reversed(kids[k])
        for x in kids[k]:
            parent[x] = k
            if k in parts or inside[k]:
                inside[x], y[x] = True, 0
    new = {k: i for i, k in enumerate(order)}
    out = Page("")
    out.tag, out.words = [page.tag[k] for k in order], [page.words[k] for k in order]
    out.parent = [-1 if k == 0 else new[parent[k]] for k in order]
    out.depth = [0] * n
    for k in range(1, n):
        out.depth[k] = out.depth[out.parent[k]] + 1
    out.hidden = [page.hidden[k] for k in order]
    out.texts = sorted(((new[k], t, fresh) for k, t, fresh in page.texts), key=lambda x: x[0])
    return out, [y[k] for k in order]


def structural_labels(page: Page, repeated: set[str]) -> list[int] | None:
    """The same by structure alone: the subtree with the most running text, less links and repeated texts; None without any."""
    n, parent = len(page.tag), page.parent
    total, linked, template = [0.0] * n, [0.0] * n, [0.0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or page.tag[k] == "a"
    for node, text, _ in page.texts:
        size = len(plain(text))
        total[node] += size
        linked[node] += size * in_link[node]
        template[node] += size * (plain(text) in repeated)
    for k in range(n - 1, 0, -1):
        for x in (total, linked, template):
            x[parent[k]] += x[k]
    good = [max(0.0, total[k] - 2 * max(linked[k], template[k])) for k in range(n)]
    own = [0.0] * n  # running text in the element itself or its inline parts
    for node, text, _ in page.texts:
        k = node
        while k and page.tag[k] in INLINE and parent[k]:
            k = parent[k]
        size = len(plain(text))
        own[k] += size if not in_link[node] and plain(text) not in repeated else -size
    running = [x if x >= RUNNING else 0.0 for x in own]
    below = running[:]
    for k in range(n - 1, 0, -1):
        below[parent[k]] += below[k]
    if not below[0]:
        return None
    top = 0
    for k in range(1, n):  # down to the smallest element that holds nearly all running text
        if parent[k] == top and below[k] >= 0.8 * below[0]:
            top = k
    out = [0] * n
    for k in range(max(1, top), n):
        inside = k == top or out[parent[k]] == 1 or parent[k] == top
        linky = linked[k] > 0.5 * total[k] or template[k] > 0.5 * total[k]
        out[k] = int(inside and not (total[k] and linky and page.tag[k] not in INLINE) and page.tag[k] not in RAW and (good[k] > 0 or not total[k] or page.tag[k] in INLINE))
    return out


class Trees:
    """Gradient boosting of binary decisions with histograms, logistic loss and trees of fixed depth."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        rate = np.average(y, weights=weight)
        self.base = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split = np.zeros(2**self.depth - 1, np.int64)
            limit = np.full(2**self.depth - 1, np.inf, np.float32)
            for level in range(self.depth):
                for own in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == own)
                    best = (1e-6, 0, np.inf)
                    if len(rows) >= 20:
                        gs, hs = g[rows].sum(), h[rows].sum()
                        for j, e in enumerate(edges):
                            if not len(e):
                                continue
                            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (gain[k], j, e[k])
                    split[own], limit[own] = best[1], best[2]
                    node[rows] = 2 * own + 1 + (x[rows, best[1]] > best[2])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((split, limit, value))
            f += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of main text."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, split[node]] > limit[node])
            out += value[node - (2**self.depth - 1)]
        return out


#: Cost of entering main text and of cutting out of it: scattered choices must pay.
ENTER, CUT = 2.0, 1.0


def decode(parent: list[int], odds: list[float], own: list[float]) -> list[bool]:
    """Best labelling outside -> main -> cut of a tree; True for main."""
    n = len(parent)
    weight = [o * (0.25 + math.log1p(t)) for o, t in zip(odds, own, strict=True)]
    main = weight[:]  # best score of the subtree if the element is main
    out = [-w for w in weight]  # if it is outside of all main text
    cut = out[:]  # if it is cut out
    for k in range(n - 1, 0, -1):
        p = parent[k]
        main[p] += max(main[k], cut[k] - CUT)
        out[p] += max(out[k], main[k] - ENTER)
        cut[p] += cut[k]
    state = [0] * n
    state[0] = 1 if main[0] - ENTER > out[0] else 0
    for k in range(1, n):
        s = state[parent[k]]
        if s == 0:
            state[k] = 1 if main[k] - ENTER > out[k] else 0
        elif s == 1:
            state[k] = 2 if cut[k] - CUT > main[k] else 1
        else:
            state[k] = 2
    return [s == 1 for s in state]


class Extractor:
    def __init__(self, pages: list[str]) -> None:
        read = [Page(h or "") for h in pages]
        held: dict[str, int] = {}
        for p in read:
            for text in {plain(t) for _, t, _ in p.texts}:
                held[text] = held.get(text, 0) + 1
        repeated = {t for t, n in held.items() if n >= max(3, len(read) // 50)}
        labels, weights = [], []
        for p in read:
            by_name, by_shape = named_labels(p), structural_labels(p, repeated)
            y = by_name or by_shape
            labels.append(y)
            weights.append([1.0 if not (by_name and by_shape) or by_name[k] == by_shape[k] else 0.5 for k in range(len(p.tag))])
        counts: dict[str, list[float]] = {}
        for p, y in zip(read, labels, strict=True):
            for k in range(len(p.tag) if y else 0):
                for w in ("<" + p.tag[k], *p.words[k]):
                    counts.setdefault(w, [0.5, 0.5])[y[k]] += 1
        self.odds = {w: max(-5.0, min(5.0, math.log(c[1] / c[0]))) for w, c in counts.items()}
        for w in NOT_MAIN:  # words that the sample doesn't show keep their meaning
            self.odds.setdefault(w, -5.0)
            self.odds.setdefault("<" + w, -5.0)
        for w in MAIN:
            self.odds.setdefault("<" + w, 5.0)
        x, y, z = [], [], []
        for p, own, weight in zip(read, labels, weights, strict=True):
            if own:
                for mask in (False, True):
                    x.append(features(p, self.odds, mask))
                    y.append(own)
                    z.append(weight)
                if more := grafted(p, own):
                    x.append(features(more[0], self.odds))
                    y.append(more[1])
                    z.append([1.0] * len(more[1]))
        self.model = None
        if x:
            x, y, z = np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(z)
            if 0 < y.mean() < 1:
                self.model = Trees().fit(x, y, z * (0.2 + x[:, 9].astype(float)))

    def texts(self, pages: list[str | None]) -> list[str]:
        read = [Page(h or "") for h in pages]
        tables = [features(p, self.odds) for p in read]
        if not read:
            return []
        x = np.concatenate(tables)
        # without a page to learn from: running text of few links that no boilerplate word names
        score = self.model.predict(x) if self.model else np.where(x[:, 11] < -1, -3.0, 2.0 - 4 * x[:, 2])
        out, at = [], 0
        for p, t in zip(read, tables, strict=True):
            n = len(t)
            bare = all(x in INLINE for x in p.tag[1:])  # a page without blocks is plain text
            keep = [True] * n if bare else decode(p.parent, score[at : at + n].tolist(), np.expm1(t[:, 9]).tolist())
            out.append(p.text(keep) or p.text(remaining(p)))
            at += n
        return out


def fit(pages: DataFrame, sample: int = 300, most_bytes: int = 200_000, id_col: str = "page_id", html_col: str = "html") -> Extractor:
    """Learn from at most `sample` pages of at most `most_bytes` characters: those with the smallest hash of their id.

    Of repeated ids, twice as many pages at most, those with the smallest hash of their text."""
    rows = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) <= most_bytes))
    ids = [r[0] for r in rows.select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(sample).collect()]
    chosen = rows.where(F.col(id_col).isin([i for i in ids if i is not None])).select(F.col(html_col).alias("h")).orderBy(F.xxhash64("h"), "h").limit(2 * sample)
    return Extractor(sorted(r[0] for r in chosen.collect()))


def extract(pages: DataFrame, sample: int = 300, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    model = fit(pages, sample, id_col=id_col, html_col=html_col)
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    kind = dict(base.dtypes)["_id"]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = model.texts(part.column("_html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return base.mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
