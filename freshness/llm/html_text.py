"""Main text of web pages by a recurrent block labeller.

`leaf_blocks` reads a page into its leaf blocks in order: the text between two block-level tags, with the
path of tags, classes and ids above it. A bidirectional LSTM (numpy) reads the sequence: for each block the
mean vector of its hashed path names, the mean vector of its hashed words, and a few ratios. It labels every block
with what comes before and after it in view.

Training needs no hand-made labels. A bounded sample of the pages gives blocks of which the tag path says plainly
whether they are content; they are dealt anew into layouts of many kinds (wrappers, class names,
interleaved boilerplate), for which the labels are known by construction.

Edge cases: null and empty pages, and pages without content, have an empty text; broken
markup is read as browsers do (unclosed tags end with their parent, a stray `<` is text, an unclosed
comment or script ends the page); repeated pages are read each; other columns of the input are kept.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshness.llm.text import with_fields

NAMES, WORDS = 4096, 1024  # hashed path names and words
NAME_DIM, WORD_DIM, HIDDEN = 16, 8, 24
RATIOS = 8
SAMPLE_PAGES = 300  # pages that layouts are made of
LAYOUTS, EPOCHS, BATCH = 800, 12, 32
GROUP_BLOCKS = 20_000  # blocks labelled at once

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody "
    "td textarea tfoot th thead title tr ul video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style".split())  # their text ends at their end tag alone, or with the page
_HIDDEN = frozenset("svg template".split())  # left out up to their end tag; without one the page goes on behind the start tag
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_CLOSES_P = _BLOCK_TAGS - {"button", "caption", "head", "html", "body", "iframe", "legend", "noscript", "optgroup", "option", "select", "tbody", "td", "textarea",
                           "tfoot", "th", "thead", "title", "tr", "video"}
_STOPS = frozenset("table ul ol dl div section article main aside nav header footer form body html".split())  # an implied end does not go beyond these
# A quote opens a value only behind an equals sign; any other quote is a character like others, and the tag ends at the first `>`.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]  # names from the root: tags, and `.word` for words of classes, ids and roles
    text: str
    linked: int  # characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for found in _NAMED.finditer(attributes):
            out += ["." + w for w in _PARTS.findall((found[2] or found[3] or found[4] or "").lower())]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with decoded text and single blanks."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(tuple(n for _, names in stack if names for n in names), text, linked))
            parts.clear()
        linked = 0

    def pop_to(place: int):
        nonlocal links
        while len(stack) > place:
            links -= stack.pop()[0] == "a"

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) if links else 0
        if start == size:
            break
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = size if close < 0 else close + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            close = page.find(">", start)
            at = size if close < 0 else close + 1
            continue
        tag = _TAG.match(page, start)
        if not tag:
            parts.append("<")
            at = start + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _RAW | _HIDDEN and not tag[1]:
            if not tag[3].endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else size if name in _RAW else at
            continue
        if name in _BLOCK_TAGS:
            end_block()
        if tag[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
            continue
        closes = _CLOSES.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop_to(i)
                    break
                if stack[i][0] in _STOPS:
                    break
        if name not in _VOID and not tag[3].endswith("/"):
            stack.append((name, _names(name, tag[3])))
            links += name == "a"
    end_block()
    return blocks


# --- features


_name_ids: dict[str, int] = {}


def _name_id(name: str) -> int:
    found = _name_ids.get(name)
    if found is None:
        if len(_name_ids) > 100_000:
            _name_ids.clear()
        found = _name_ids[name] = zlib.crc32(name.encode()) % NAMES
    return found


@dataclass
class Features:
    """Blocks of several pages one after the other."""

    names: np.ndarray  # hashed names of all paths
    name_starts: np.ndarray
    words: np.ndarray
    word_starts: np.ndarray
    ratios: np.ndarray
    pages: np.ndarray  # blocks of each page


def features(pages: list[list[Block]]) -> Features:
    names, name_starts, words, word_starts, ratios = [], [], [], [], []
    for blocks in pages:
        for i, b in enumerate(blocks):
            name_starts.append(len(names))
            names += [_name_id(n) for n in b.path] or [_name_id("")]
            names.append(_name_id("leaf:" + next((n for n in reversed(b.path) if n[0] != "."), "")))
            found = b.text.lower().split()
            word_starts.append(len(words))
            words += [zlib.crc32(w.encode()) % WORDS for w in found]
            chars, n = len(b.text), len(found)
            ratios.append((np.log1p(n) / 5, min(1.0, b.linked / chars), (b.text.count(".") + b.text.count(",")) / n, i / len(blocks),
                           (len(blocks) - 1 - i) / len(blocks), float(n < 4), float("©" in b.text), min(len(b.path), 20) / 20))
    return Features(np.array(names, np.int64), np.array(name_starts, np.int64), np.array(words, np.int64), np.array(word_starts, np.int64),
                    np.array(ratios, np.float32).reshape(-1, RATIOS), np.array([len(p) for p in pages], np.int64))


def _means(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(starts, len(ids)))[:, None]
    return np.add.reduceat(table[ids], starts, axis=0) / counts


# --- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiLSTM:
    """Path and word embeddings, one LSTM in each direction, and a logistic output for each block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        width = NAME_DIM + WORD_DIM + RATIOS
        put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"names": np.zeros((NAMES, NAME_DIM), np.float32), "words": np.zeros((WORDS, WORD_DIM), np.float32)}
        self.p["names"] += rng.standard_normal((1, NAME_DIM)).astype(np.float32) * 0.01
        for way in "fb":
            self.p |= {f"x{way}": put(width, 4 * HIDDEN), f"h{way}": put(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"out": put(2 * HIDDEN, 1), "bias": np.zeros(1, np.float32)}

    def _inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps x pages x width, mask, place of each block in the flattened grid)."""
        flat = np.concatenate((_means(self.p["names"], f.names, f.name_starts), _means(self.p["words"], f.words, f.word_starts), f.ratios), axis=1)
        steps, pages = int(f.pages.max()), len(f.pages)
        page = np.repeat(np.arange(pages), f.pages)
        step = np.arange(len(page)) - np.repeat(np.cumsum(f.pages) - f.pages, f.pages)
        place = step * pages + page
        grid = np.zeros((steps * pages, flat.shape[1]), np.float32)
        grid[place] = flat
        mask = np.zeros(steps * pages, np.float32)
        mask[place] = 1
        return grid.reshape(steps, pages, -1), mask.reshape(steps, pages, 1), place

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        steps, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        inner = (x.reshape(steps * pages, -1) @ self.p[f"x{way}"] + self.p[f"b{way}"]).reshape(steps, pages, -1)
        kept = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ self.p[f"h{way}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, forget, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = forget * c + i * g
            squashed = np.tanh(new_c)
            m = mask[t]
            if keep:
                kept.append((t, h, c, i, forget, o, g, squashed, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out, kept

    def predict(self, f: Features) -> np.ndarray:
        """Probability of content for each block."""
        x, mask, place = self._inputs(f)
        both = np.concatenate([self._run(way, x, mask, False)[0] for way in "fb"], axis=2)
        return _sigmoid(both.reshape(-1, 2 * HIDDEN)[place] @ self.p["out"] + self.p["bias"])[:, 0]

    def gradients(self, f: Features, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the blocks and its gradient, by backpropagation through time."""
        x, mask, place = self._inputs(f)
        steps, pages, width = x.shape
        runs = {way: self._run(way, x, mask, True) for way in "fb"}
        hidden = np.concatenate([runs[way][0] for way in "fb"], axis=2).reshape(-1, 2 * HIDDEN)
        p = _sigmoid(hidden[place] @ self.p["out"] + self.p["bias"])[:, 0]
        n = len(labels)
        loss = -float(np.mean(labels * np.log(p + 1e-7) + (1 - labels) * np.log(1 - p + 1e-7)))
        error = ((p - labels) / n).astype(np.float32)[:, None]
        grads = {"out": hidden[place].T @ error, "bias": error.sum(axis=0)}
        d_hidden = np.zeros_like(hidden)
        d_hidden[place] = error @ self.p["out"].T
        d_hidden = d_hidden.reshape(steps, pages, 2 * HIDDEN)
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            wx, wh = self.p[f"x{way}"], self.p[f"h{way}"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.p[f"b{way}"])
            dh = dc = np.zeros((pages, HIDDEN), np.float32)
            for t, h, c, i, forget, o, g, squashed, m in reversed(runs[way][1]):
                dh = dh + d_hidden[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                inside = dh * m
                d_new = dc * m + inside * o * (1 - squashed**2)
                dz = np.concatenate((d_new * g * i * (1 - i), d_new * c * forget * (1 - forget), inside * squashed * o * (1 - o), d_new * i * (1 - g**2)), axis=1)
                gx += x[t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(axis=0)
                dx[t] += dz @ wx.T
                dh = dh * (1 - m) + dz @ wh.T
                dc = dc * (1 - m) + d_new * forget
            grads |= {f"x{way}": gx, f"h{way}": gh, f"b{way}": gb}
        flat = dx.reshape(-1, width)[place]
        for key, ids, starts, part in (("names", f.names, f.name_starts, flat[:, :NAME_DIM]), ("words", f.words, f.word_starts, flat[:, NAME_DIM : NAME_DIM + WORD_DIM])):
            counts = np.diff(np.append(starts, len(ids)))
            grads[key] = np.zeros_like(self.p[key])
            np.add.at(grads[key], ids, np.repeat(part / counts[:, None], counts, axis=0))
        return loss, grads

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 2) -> float:
        """Adam over batches of pages of similar length; returns the last loss."""
        rng = np.random.default_rng(seed)
        pages = sorted(pages, key=lambda x: len(x[0]))
        batches = [(features([b for b, _ in part]), np.concatenate([y for _, y in part]).astype(np.float32))
                   for part in (pages[i : i + BATCH] for i in range(0, len(pages), BATCH))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            for i in rng.permutation(len(batches)):
                loss, grads = self.gradients(*batches[i])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (0.3 if epoch >= epochs - 3 else 1.0) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return loss


# --- layouts to learn from. Names that pages commonly give to their parts.

CONTENT_ROOTS = ["article", "main", "main article", "div.content", "div.article", "div.post", "div.entry.content", "div.post.content", "div.story.body", "section.article",
                 "div.article.body", "div.main.content", "section.content", "div.page.content", "td.content", "div.text", "section", "div.container div.row div.col", "div"]
BOILERPLATE = {
    "menu": ["nav ul li a", "nav a", "div.menu ul li a", "div.nav ul li a", "header nav ul li a", "ul.menu li a", "div.navbar div a", "nav.breadcrumb ol li a", "div.breadcrumbs a",
             "menu li a", "ul.navigation li a", "div.topbar a"],
    "header": ["header", "header h1", "header div.logo", "div.header", "div.masthead", "div.site.header p", "header p.tagline", "div.banner", "div.top.header div"],
    "footer": ["footer", "footer p", "div.footer", "footer div.copyright", "div.site.footer p", "footer ul li a", "div.legal", "footer small", "div.bottom p"],
    "sidebar": ["aside", "aside p", "aside ul li a", "div.sidebar", "div.sidebar div.widget", "div.sidebar ul li a", "aside.related", "div.widget", "section.sidebar p", "div.rail div"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.ad.slot", "aside.ad", "div.promo", "ins.adsbygoogle", "section.promo p", "div.banner.ad", "p.ad", "p.sponsored"],
    "notice": ["div.cookie", "div.cookie.notice", "div.notice", "div.cookie.banner p", "div.consent", "div.gdpr p", "div.alert", "div.popup", "div.modal p", "p.notice", "section.notice", "div.privacy.notice", "dialog p"],
    "form": ["form", "form label", "form p", "form div.field", "form button", "div.newsletter form p", "div.subscribe", "form.search label", "div.login form", "form select option", "form fieldset legend", "div.signup p", "button"],
    "comment": ["div.comments div.comment p", "section.comments p", "div.comment", "ul.comments li", "ol.comment.list li p", "section.comments article.comment p", "div.comment.body", "div.reply p", "div.disqus",
                "div.responses p", "section.comments h2", "div.user.comment", "aside.comments p", "div.discussion p", "div.comments h3", "li.comment p", "article.comment p", "div.reader.comments p", "div.comments"],
    "share": ["div.share a", "ul.social li a", "div.related ul li a", "div.related h3", "div.tags a", "section.related p", "div.recommended", "div.more.stories a", "div.share", "div.pagination a"],
}
CONTENT_LEAVES = ["p"] * 14 + ["h2", "h3", "ul li", "ol li", "blockquote", "blockquote p", "pre", "div", "section p", "table tr td", "figure figcaption", "p b", "p b", "dl dd"]
SHORT_WORDS = ["home", "about", "contact", "login", "search", "subscribe", "share", "comments", "reply", "cookies", "accept", "privacy", "terms", "menu", "©", "2024", "advertisement", "sponsored", "related"]
OPAQUE = ["x", "wrap", "inner", "box", "col", "block", "root", "app", "layout", "css", "page", "grid"]


def _path(text: str) -> list[str]:
    out = []
    for element in text.split():
        tag, *words = element.split(".")
        out += [tag, *("." + w for w in words)]
    return out


def made_layout(content: list[str], others: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page made of the given texts, with labels: content inside one root, boilerplate before, between and after."""
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    outer = ["html", "body"] + [n for _ in range(int(rng.integers(3))) for n in (["div"] if rng.random() < 0.5 else ["div", "." + pick(OPAQUE)])]
    outer = outer if rng.random() < 0.95 else []
    root = _path(pick(CONTENT_ROOTS[:2] if rng.random() < 0.4 else CONTENT_ROOTS)) if rng.random() < 0.97 else []
    blocks: list[Block] = []
    labels: list[int] = []

    def boilerplate(kind: str, inside: list[str], count: int):
        path = _path(pick(BOILERPLATE[kind]))
        long = kind in ("comment", "notice", "advert", "sidebar", "footer")
        for _ in range(count):
            if long and rng.random() < 0.75:
                text = pick(others or content or ["text"]) if rng.random() < 0.4 or not content else pick(content)
            else:
                words = pick(others or ["more"]).split()[: int(rng.integers(1, 5))]
                text = " ".join(words if rng.random() < 0.6 else [pick(SHORT_WORDS)])
            extra = [pick(["p", "span", "div", "li", "a", "h3"])] if rng.random() < 0.3 else []
            names = tuple(inside + path + extra)
            blocks.append(Block(names, text, len(text) if "a" in names else 0))
            labels.append(0)

    if outer and rng.random() < 0.8:
        blocks.append(Block(("html", "head", "title"), pick(content or others or ["title"]), 0))
        labels.append(0)
    for kind in ("header", "menu", "notice", "advert", "form", "sidebar"):
        if rng.random() < (0.7 if kind == "menu" else 0.3):
            boilerplate(kind, outer, int(rng.integers(2, 9)) if kind == "menu" else int(rng.integers(1, 3)))
    inside = outer + root
    if rng.random() < 0.7 and content:
        blocks.append(Block(tuple(inside + (["header"] if rng.random() < 0.1 else []) + [pick(["h1", "h1", "h1", "h2"])]), " ".join(pick(content).split()[:8]), 0))
        labels.append(1)
    for text in content:
        if rng.random() < 0.07:
            boilerplate(pick(["advert", "notice", "share", "form", "sidebar", "advert"]), inside if rng.random() < 0.8 else outer, 1)
        leaf = _path(pick(CONTENT_LEAVES))
        text = " ".join(text.split()[: int(rng.integers(1, 4))]) if rng.random() < 0.1 else text
        blocks.append(Block(tuple(inside + leaf), text, int(len(text) * rng.random() * 0.3) if rng.random() < 0.15 else 0))
        labels.append(1)
    for kind in ("share", "comment", "form", "sidebar", "advert", "notice", "menu", "footer"):
        if rng.random() < (0.6 if kind in ("footer", "comment") else 0.25):
            within = inside if kind in ("share", "comment", "form", "advert") and rng.random() < 0.35 else outer
            boilerplate(kind, within, int(rng.integers(1, 6)))
    return blocks, labels


_BAD = {"nav", "header", "footer", "aside", "form", "head", "noscript", "select", "button"} | {"." + w for kind in BOILERPLATE.values() for p in kind for w in re.findall(r"\.([a-z]+)", p)} - {
    ".content", ".body", ".top", ".site", ".more", ".list", ".user", ".reader", ".slot", ".field", ".bottom", ".stories"}
_GOOD = {"article", "main", ".article", ".post", ".entry", ".content"}


def plain_label(block: Block) -> int | None:
    """1 or 0 where the path alone says what a block is, else None."""
    names = set(block.path)
    if names & _BAD:
        return 0
    return 1 if names & _GOOD else None


def train(pages: list[str], layouts: int = LAYOUTS, epochs: int = EPOCHS, seed: int = 3) -> BiLSTM:
    """A labeller from a sample of pages: the pages themselves where paths are plain, and layouts made of their texts."""
    rng = np.random.default_rng(seed)
    sets, content, others = [], [], []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [plain_label(b) for b in blocks]
        good, bad = [b.text for b, y in zip(blocks, labels) if y == 1], [b.text for b, y in zip(blocks, labels) if y == 0]
        if good:
            content.append(good)
            others += bad
        if blocks and None not in labels and len(blocks) <= 400:
            sets.append((blocks, labels))
    if not content:  # nothing to go by: prose of its own words
        content, others = [["one two three four, five six seven. eight nine ten eleven twelve."] * 3], ["home", "about us", "contact"]
    for _ in range(layouts):
        texts = content[int(rng.integers(len(content)))]
        start = int(rng.integers(len(texts)))
        texts = texts[start : start + int(rng.integers(0, 24))] if rng.random() < 0.6 else texts[:40]
        made = made_layout(texts, others, rng)
        if made[0]:
            sets.append(made)
    model = BiLSTM()
    model.fit(sets, epochs)
    return model


def main_texts(model: BiLSTM, pages: list[str]) -> list[str]:
    """The main text of each page; blocks of many pages are labelled at once."""
    out = [""] * len(pages)
    found: list[tuple[int, list[Block]]] = []
    held = 0

    def label():
        nonlocal held
        found.sort(key=lambda x: len(x[1]))
        group: list[tuple[int, list[Block]]] = []
        for item in [*found, None]:
            if group and (item is None or len(item[1]) * (len(group) + 1) > GROUP_BLOCKS):
                keep = model.predict(features([b for _, b in group])) > 0.5
                at = 0
                for i, blocks in group:
                    out[i] = " ".join(b.text for b, k in zip(blocks, keep[at : at + len(blocks)]) if k)
                    at += len(blocks)
                group = []
            group.append(item)
        found.clear()
        held = 0

    for i, page in enumerate(pages):
        blocks = leaf_blocks(page)
        if blocks:
            found.append((i, blocks))
            held += len(blocks)
        if held > 4 * GROUP_BLOCKS:
            label()
    label()
    return out


def fit_labeller(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES, longest: int = 1 << 16) -> BiLSTM:
    """A labeller trained on at most `sample` pages, chosen by a hash of their markup; they alone reach the driver."""
    text = F.col(html_col).cast("string")
    chosen = pages.select(text.alias("html")).where(F.length(text).between(1, longest)).orderBy(F.xxhash64("html"), "html").limit(sample)
    return train([r.html for r in chosen.collect()])


def extract(pages: DataFrame, model: BiLSTM, html_col: str = "html") -> DataFrame:
    """`pages` plus text and n_chars. The network has a fixed size and is broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        texts = main_texts(shared.value, [p or "" for p in column.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

    return with_fields(pages, F.arrow_udf(run, "text string, n_chars long")(F.col(html_col).cast("string")), ["text", "n_chars"])
