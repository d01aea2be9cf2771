"""Main text of web pages: a bidirectional LSTM, in numpy, labels every leaf block of a page from the whole page.

A page is cut into leaf blocks: text between block-level tags, with the path of open tags, their classes and ids. A block's vector holds hashed
path parts, hashed words and a few measures. Two LSTMs read the page's blocks forwards and backwards, so each label sees the whole page.
The network is trained (back-propagation through time, Adam) on invented pages with known labels: a fixed number, from a fixed seed.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapstone.llm.common import map_arrow, pick

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without content, elements whose content is raw up to their end tag or the page's end, elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea".split())
#: Elements whose content is raw up to their end tag; without one, only the start tag is passed over. The title's content is text.
RAW_IF_CLOSED = frozenset("iframe title".split())
#: Elements that a slash in their start tag closes; their text is left to the labeller.
EMPTY = frozenset("noscript template svg object canvas math select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: A start tag that ends an open element of the same group within the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Buckets of path parts and words, measures of a block, hidden units of each direction.
PATHS, WORDS, MEASURES, HIDDEN = 192, 48, 6, 24
#: Invented pages to train on, passes over them, blocks that one batch holds.
PAGES, EPOCHS, CELLS = 1000, 8, 16384
#: Open elements that a path holds (as browsers bound their trees): deeper ones share their parent's path.
DEEPEST = 512


class _Markup:
    """Finds the tags of a page from left to right. Each place is looked at a bounded number of times, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.closing: dict[str, list[tuple[int, int]]] = {}

    def _skip(self, text: str, at: int) -> int:
        found = self.page.find(text, at)
        return len(self.page) if found < 0 else found + len(text)

    def _tag_end(self, at: int) -> int:
        """Past the first ``>`` outside quotes; a quote that never closes is passed over."""
        while (m := _STOP.search(self.page, at)) is not None:
            mark, at = m.group(), m.end()
            if mark == ">":
                return at
            if at <= self.last[mark] and self.last[">"] > (shut := self.page.find(mark, at)):
                at = shut + 1
        return -1

    def next_tag(self, at: int) -> tuple[int, int, bool, str, str]:
        """Where the next tag, comment or declaration begins and ends, whether it is an end tag, its name (empty: no tag) and its attributes."""
        page, end = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                return start, self._skip("-->", start + 4), False, "", ""
            if page.startswith("<![CDATA[", start):
                return start, self._skip("]]>", start + 9), False, "", ""
            if page.startswith(("<!", "<?"), start):
                return start, self._skip(">", start), False, "", ""
            m = _NAME.match(page, start + 1)
            if m and start < self.last[">"]:
                stop = self._tag_end(m.end())
                if stop > 0:
                    return start, stop, bool(m.group(1)), m.group(2).lower(), page[m.end() : stop - 1]
            at = start + 1
        return end, end, False, "", ""

    def end_of(self, name: str, at: int) -> tuple[int, int] | None:
        """The first end tag of this name from ``at`` on; a page's end tags of a name are looked up once."""
        if name not in self.closing:
            self.closing[name] = [m.span() for m in re.finditer(rf"</{name}\b[^>]*>", self.page, re.I)]
        spans = self.closing[name]
        k = bisect_left(spans, (at, 0))
        return spans[k] if k < len(spans) else None


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each leaf block in page order; path parts are tags, classes, ids, roles, and ``~hidden``.

    Character references are decoded, white space becomes one space. Unclosed elements end with their parent; stray end tags are passed over.
    """
    blocks, stack, pieces, links = [], [], [], 0
    at, in_link, end = 0, 0, len(page)
    markup, open_names, deeper = _Markup(page), Counter(), Counter()
    path: tuple[str, ...] | None = ()

    def flush() -> None:
        nonlocal links, path
        if pieces:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                if path is None:
                    path = tuple(part for _, parts in stack for part in parts)
                blocks.append((path, text, links))
            pieces.clear()
        links = 0

    def close_from(k: int) -> None:
        nonlocal in_link, path
        for name, _ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]
        path, in_link = None, open_names["a"]

    while at < end:
        start, at_end, closes, name, attributes = markup.next_tag(at)
        if start > at:
            pieces.append(page[at:start])
            if in_link:
                links += start - at
        at = at_end
        if not name:
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if closes:
            if deeper[name]:
                deeper[name] -= 1
                continue
            for k in range(len(stack) - 1, -1, -1) if open_names[name] else ():
                if stack[k][0] == name:
                    if not (inline and any(t not in INLINE for t, _ in stack[k + 1 :])):
                        close_from(k)
                    break
            continue
        shut = attributes.endswith("/")
        if name in RAW or name in RAW_IF_CLOSED:
            if not shut or name == "title":
                close = markup.end_of(name, at)
                if name == "title" and close:
                    stack.append((name, [name]))
                    path = None
                    pieces.append(page[at : close[0]])
                    flush()
                    stack.pop()
                    path = None
                at = close[1] if close else end if name in RAW else at
            continue
        if name in VOID or name in EMPTY and shut:
            continue
        if name in BREAKS_P or name in CLOSES:
            wanted = CLOSES.get(name, set()) | ({"p"} if name in BREAKS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in wanted:
                    close_from(k)
                elif stack[k][0] not in INLINE:
                    break
        if len(stack) >= DEEPEST:
            deeper[name] += 1
            continue
        parts = [name] if not inline else []
        if attributes and not inline:
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key == "style":
                    if _hides(value):
                        parts.append("~hidden")
                elif key in ("hidden", "aria-hidden"):
                    if key == "hidden" or value.lower() == "true":
                        parts.append("~hidden")
                else:
                    parts.extend("." + x.lower() for x in _NAME_PART.findall(value))
        stack.append((name, parts))
        open_names[name] += 1
        path, in_link = None, open_names["a"]
    flush()
    return blocks


def _hides(style: str) -> bool:
    """Whether one of a style's declarations takes its element from the page; of one property the last counts."""
    said = {}
    for declaration in style.lower().split(";"):
        name, _, value = declaration.partition(":")
        said[name.strip()] = value.partition("!")[0].strip()
    return said.get("display") == "none" or said.get("visibility") == "hidden"


@lru_cache(maxsize=1 << 16)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Each part, and each of the last two tags by itself, in its bucket."""
    out = np.zeros(PATHS, np.float32)
    tags = [p for p in path if p[0] not in ".~"]
    for part in {*path, *(f"{k}:{t}" for k, t in enumerate(reversed(tags[-2:])))}:
        out[zlib.crc32(part.encode()) % PATHS] = 1
    return out


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = n = zlib.crc32(word.lower().encode()) % WORDS
        return n


_buckets = _WordBuckets()


def vectors(blocks: list[tuple[tuple[str, ...], str, int]], first: int = 0, total: int | None = None) -> np.ndarray:
    """(blocks, PATHS + WORDS + MEASURES) of a page's blocks, or of a stretch of them that begins at ``first`` of ``total``."""
    total = total or len(blocks)
    out = np.zeros((len(blocks), PATHS + WORDS + MEASURES), np.float32)
    for row, (path, text, links) in enumerate(blocks):
        words = text.split(" ")
        out[row, :PATHS] = _path_vector(path)
        out[row, PATHS : PATHS + WORDS] = np.bincount(list(map(_buckets.__getitem__, words)), minlength=WORDS) / len(words)
        n = len(text)
        out[row, PATHS + WORDS :] = (np.log1p(n) / 6, min(1.0, links / n), min(1.0, text.count(".") / len(words)), (first + row) / total, np.log1p(len(path)) / 3, np.log1p(total) / 5)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class BlockLabeller:
    """Two LSTMs and a logistic unit: parameters, forward pass, gradients."""

    def __init__(self, seed: int = 11):
        rng, wide = np.random.default_rng(seed), PATHS + WORDS + MEASURES
        one = lambda: [rng.normal(0, 0.12, (wide, 4 * HIDDEN)).astype(np.float32), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32), np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)]
        self.parameters = [*one(), *one(), np.zeros(2 * HIDDEN, np.float32), np.zeros(1, np.float32)]

    def _run(self, x: np.ndarray, mask: np.ndarray, which: int, keep: bool = False, state: tuple | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (time, pages, HIDDEN). Padding keeps the state at zero, before the first and after the last block.

        ``state`` holds what a stretch of a page begins with; the state it ends with goes to ``self.state``.
        """
        w, u, b = self.parameters[3 * which : 3 * which + 3]
        steps = range(len(x)) if which == 0 else range(len(x) - 1, -1, -1)
        gates_in = x @ w + b
        h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        out, tape = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in steps:
            z = gates_in[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c_new = (f * c + i * g) * mask[t][:, None]
            tanh_c = np.tanh(c_new)
            h_new = o * tanh_c * mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh_c))
            h, c = h_new, c_new
            out[t] = h
        self.state = h, c
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, pages): chance that a block is main text."""
        v, b = self.parameters[6:]
        return _sigmoid(np.concatenate((self._run(x, mask, 0)[0], self._run(x, mask, 1)[0]), 2) @ v + b)

    def probabilities_of_long(self, blocks: list, stretch: int) -> np.ndarray:
        """The same for one page of many blocks: forwards, then backwards, a stretch at a time with carried states; hidden states alone are held whole."""
        total, cuts = len(blocks), range(0, len(blocks), stretch)
        v, b = self.parameters[6:]
        logits = np.full(total, b[0], np.float32)
        for which, order in ((0, cuts), (1, reversed(cuts))):
            state = None
            for at in order:
                x = vectors(blocks[at : at + stretch], at, total)[:, None]
                h, _ = self._run(x, np.ones(x.shape[:2], np.float32), which, state=state)
                state = self.state
                logits[at : at + len(x)] += h[:, 0] @ v[which * HIDDEN : (which + 1) * HIDDEN]
        return _sigmoid(logits)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        v, b = self.parameters[6:]
        (forth, tape_f), (back, tape_b) = self._run(x, mask, 0, True), self._run(x, mask, 1, True)
        both = np.concatenate((forth, back), 2)
        error = (_sigmoid(both @ v + b) - y) * mask / mask.sum()
        grads = []
        for which, tape in ((0, tape_f), (1, tape_b)):
            w, u, _ = self.parameters[3 * which : 3 * which + 3]
            d_u, d_z = np.zeros_like(u), np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
            d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh_c in reversed(tape):
                m = mask[t][:, None]
                d_h = (d_h + error[t][:, None] * v[which * HIDDEN : (which + 1) * HIDDEN]) * m
                d_c = (d_c + d_h * o * (1 - tanh_c**2)) * m
                z = np.hstack((d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g**2)))
                d_z[t] = z
                d_u += h.T @ z
                d_h, d_c = z @ u.T, d_c * f
            flat = d_z.reshape(-1, 4 * HIDDEN)
            grads += [x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(0)]
        return [*grads, np.tensordot(error, both, ((0, 1), (0, 1))), np.array([error.sum()])]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), PATHS + WORDS + MEASURES), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


# --- invented pages ---

#: Names for the parts of invented pages: (tags, classes and ids) each.
MAIN_BOXES = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "main-content"), ("div", "article-body"), ("section", "entry-content"), ("div", "post body"), ("div", "story text"), ("article", "hentry"))
MENUS = (("nav", ""), ("nav", "menu"), ("div", "nav"), ("ul", "menu"), ("div", "navigation"), ("nav", "navbar top"), ("div", "breadcrumb"), ("div", "topbar links"), ("nav", "pagination"), ("div", "pager"))
SIDES = (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "related-posts"), ("div", "social share"), ("div", "tags"), ("div", "recommended"), ("aside", "promo"))
NOTICES = (("div", "cookie notice"), ("div", "cookie-banner"), ("div", "banner"), ("div", "notice"), ("div", "alert"), ("section", "consent gdpr"), ("div", "popup modal"), ("div", "newsletter subscribe"), ("div", "paywall"))
ADVERTS = (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("aside", "ad sponsor"), ("div", "sponsored"), ("ins", "adsbygoogle"), ("div", "promo ad"))
HEADERS = (("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "logo"), ("header", "top"))
FOOTERS = (("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("footer", "bottom"), ("div", "legal"))
COMMENTS = (("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("div", "comment"), ("div", "discussion replies"), ("section", "responses comment-list"), ("div", "disqus thread"))
FORMS = (("form", ""), ("form", "search"), ("form", "login"), ("form", "contact"), ("form", "signup newsletter"))
#: Words that the invented furniture sometimes uses.
FURNITURE_WORDS = tuple("home about contact login register search menu share tweet subscribe newsletter cookies accept privacy policy terms copyright rights reserved advertisement sponsored related next previous comments reply read more sign up follow us archive categories".split())


def invented_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and, in page order, whether each of its leaf blocks is main text."""
    out: list[str] = []
    labels: list[bool] = []
    syllables = ("an", "be", "co", "der", "en", "fi", "go", "he", "in", "ka", "le", "mo", "na", "or", "pe", "que", "ra", "st", "ti", "un", "ver", "wo", "é", "ö", "ñ")
    pick_one = lambda options: options[int(rng.integers(len(options)))]

    def prose(low: int, high: int, furniture: bool) -> str:
        n = int(rng.integers(low, high))
        words = ["".join(pick_one(syllables) for _ in range(int(rng.integers(1, 4)))) if not furniture or rng.random() < 0.6 else pick_one(FURNITURE_WORDS) for _ in range(n)]
        text = " ".join(w + "." * (rng.random() < 0.1) for w in words)
        return text + pick_one((".", "", "!")) if not furniture else text

    def box(names: tuple, attributes: bool = True) -> tuple[str, str]:
        tag, label = pick_one(names)
        name = label if label and rng.random() < 0.85 or tag == "div" else ""
        key = "id" if rng.random() < 0.25 else "class"
        return (f'<{tag} {key}="{name}">' if name and attributes else f"<{tag}>"), f"</{tag}>"

    def leaf(tag: str, text: str, main: bool, inner: str = "") -> None:
        out.append(f"<{tag}>{f'<{inner}>{text}</{inner}>' if inner else text}</{tag}>")
        labels.append(main)

    def furniture(names: tuple) -> None:
        start, end = box(names)
        out.append(start)
        shape = rng.random()
        if names in (MENUS,) or shape < 0.25:
            if not start.startswith(("<ul", "<ol")):
                out.append("<ul>")
                end = "</ul>" + end
            for _ in range(int(rng.integers(2, 9))):
                leaf("li", f'<a href="/x">{prose(1, 4, True)}</a>', False)
        elif shape < 0.55:
            out.append(prose(3, 30, rng.random() < 0.5))
            labels.append(False)
        else:
            if rng.random() < 0.4:
                leaf(pick_one(("h2", "h3", "h4", "strong") if not names == FORMS else ("h3", "legend")), prose(1, 6, True), False)
                if out[-1].startswith("<strong"):
                    out[-1] = f"<div>{out[-1]}</div>"
            for _ in range(int(rng.integers(1, 5))):
                leaf(pick_one(("p", "div", "p", "li")), prose(2, 60 if names is COMMENTS else 30, rng.random() < 0.5), False, pick_one(("", "", "a")))
            if names is FORMS:
                out.append('<input name="q">')
                leaf("button", prose(1, 3, True), False)
        out.append(end)

    def hidden() -> None:
        """Something that no reader sees, wherever it stands."""
        tag = pick_one(("div", "p", "section", "span", "ul"))
        out.append(f"<{tag} {pick_one(HIDDEN_BY)}>" if tag != "span" else f"<div {pick_one(HIDDEN_BY)}>")
        for _ in range(int(rng.integers(1, 4))):
            leaf("li" if tag == "ul" else "p" if tag in ("div", "section", "span") and rng.random() < 0.7 else "div" if tag != "p" else "b", prose(2, 40, rng.random() < 0.3), False)
            if tag == "p":
                break
        out.append(f"</{tag}>" if tag != "span" else "</div>")

    def bare_page() -> str:
        """A page that is nothing but its text: without tags, right in the body, in paragraphs, or in boxes without a name."""
        shape, n = int(rng.integers(5)), int(rng.integers(1, 16))
        if shape == 0:
            labels.append(True)
            return prose(5, 200, False)
        if shape == 1:
            parts = [prose(5, 90, False) for _ in range(n)]
            labels.extend([True] * n)
            body = pick_one(("<br><hr>", "<hr>")).join(parts)
        else:
            tag = pick_one(("p", "p", "div")) if shape < 4 else "p"
            if rng.random() < 0.4:
                leaf("h1", prose(3, 12, False), True)
            for _ in range(n):
                leaf(tag, prose(1, 70, False), True)
            inner = "".join(out)
            body = f"<div{pick_one(VISIBLE)}>{inner}</div>" if shape >= 3 else inner
        return body if rng.random() < 0.4 else f"<html><body{pick_one(VISIBLE)}>{body}</body></html>"

    def main_part() -> None:
        wrap = box(SIMPLE_BOXES) if rng.random() < 0.3 else ("", "")
        start, end = box(MAIN_BOXES)
        if rng.random() < 0.12:
            start, end = f"<div{pick_one(VISIBLE)}>", "</div>"  # a box that doesn't tell what it holds
        out.append(wrap[0] + start)
        unnamed = rng.random() < 0.2
        if unnamed:
            out.append(f"<div{pick_one(VISIBLE)}>")
        if rng.random() < 0.85:
            leaf("h1", prose(3, 12, False), True)
        kinds, paragraph = rng.random(), "div" if rng.random() < 0.12 else "p"
        for k in range(int(rng.integers(1, 14))):
            roll = rng.random()
            if kinds < 0.15 and roll < 0.5:
                out.append(prose(8, 60, False) + "<br>")
                labels.append(True)
            elif roll < 0.05:
                hidden()
            elif roll < 0.09:
                shape = int(rng.integers(3))
                if shape == 0:
                    leaf("pre", prose(3, 40, False), True, pick_one(("", "code")))
                elif shape == 1:
                    out.append("<dl>")
                    for _ in range(int(rng.integers(1, 4))):
                        leaf("dt", prose(1, 4, False), True)
                        leaf("dd", prose(3, 20, False), True)
                    out.append("</dl>")
                else:
                    out.append('<figure><img src="a.png">')
                    leaf("figcaption", prose(3, 15, False), True)
                    out.append("</figure>")
            elif roll < 0.72:
                leaf(paragraph, prose(1, pick_one((3, 70, 70, 70)), False), True, pick_one(("", "", "", "b", "em")))
            elif roll < 0.8:
                leaf(pick_one(("h2", "h3")), prose(2, 7, False), True)
            elif roll < 0.86:
                out.append(pick_one(("<ul>", "<ol>")))
                close = out[-1].replace("<", "</")
                for _ in range(int(rng.integers(2, 6))):
                    leaf("li", prose(2, 20, False), True)
                out.append(close)
            elif roll < 0.9:
                out.append("<blockquote>")
                leaf("p", prose(5, 40, False), True)
                out.append("</blockquote>")
            elif roll < 0.93:
                out.append("<table><tr>")
                for _ in range(int(rng.integers(2, 5))):
                    leaf("td", prose(1, 6, False), True)
                out.append("</tr></table>")
            elif k:
                furniture(pick_one((ADVERTS, SIDES, FORMS, NOTICES)))
        if rng.random() < 0.12:
            furniture(COMMENTS)
        out.append("</div>" * unnamed + end + wrap[1])

    if rng.random() < 0.12:
        return bare_page(), labels
    leaf("title", prose(2, 10, False), False)
    out[-1] = f"<html><head>{out[-1]}<style>p{{}}</style></head><body>"
    for names, chance in ((NOTICES, 0.25), (HEADERS, 0.4), (MENUS, 0.8), (ADVERTS, 0.5), (SIDES, 0.2), (FORMS, 0.2)):
        if rng.random() < chance:
            furniture(names)
    main_part()
    for names, chance in ((COMMENTS, 0.35), (SIDES, 0.4), (ADVERTS, 0.2), (FORMS, 0.2), (MENUS, 0.2), (NOTICES, 0.15), (FOOTERS, 0.85)):
        if rng.random() < chance:
            furniture(names)
    return "".join(out) + "</body></html>" * (rng.random() < 0.9), labels


#: Styles that hide an element, and attributes that don't.
HIDDEN_BY = ('style="display:none"', 'style="display: none;"', "hidden", 'aria-hidden="true"', 'style="visibility:hidden"')
VISIBLE = ("", "", ' style="color:red"', ' style="overflow:hidden"', ' style="display:block;border:none"', ' style="margin:0"')
SIMPLE_BOXES = (("div", "wrapper"), ("div", "container"), ("section", ""), ("div", "page"), ("div", "row"), ("div", "main"))


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, epochs: int = EPOCHS) -> BlockLabeller:
    """The labeller, trained on ``pages`` invented pages; the same on every call."""
    rng, model = np.random.default_rng(23), BlockLabeller()
    made = []
    while len(made) < pages:
        page, labels = invented_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            made.append((vectors(blocks), np.array(labels, np.float32)))
    first, second, n, per_batch = [np.zeros_like(p) for p in model.parameters], [np.zeros_like(p) for p in model.parameters], 0, 20
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for k in range(0, len(order), per_batch):
            n += 1
            chosen = [made[r] for r in order[k : k + per_batch]]
            x, mask = _padded([v for v, _ in chosen])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, labels) in enumerate(chosen):
                y[: len(labels), j] = labels
            rate = 0.02 * (1 - 0.9 * (epoch + k / len(order)) / epochs)
            for p, g, m, v in zip(model.parameters, model.gradients(x, mask, y), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.995**n)) + 1e-7)
    never = ~np.any([v.any(0) for v, _ in made], 0)  # what no page showed says nothing
    for w in (model.parameters[0], model.parameters[3]):
        w[never] = 0
    return model


def label_pages(model: BlockLabeller, pages: list[str]) -> list[tuple[list[tuple], np.ndarray]]:
    """(blocks, chance of each to be main text) of each page. Pages of like length share a batch; a long page is read in stretches, its states carried."""
    parsed = [leaf_blocks(p) for p in pages]
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    chances: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(parsed[order[end]]) * (end + 1 - at) <= CELLS // 4:
            end += 1
        group = order[at:end]
        if len(parsed[group[0]]) > CELLS // 4:
            chances[group[0]] = model.probabilities_of_long(parsed[group[0]], CELLS // 4)
            at = end
            continue
        x, mask = _padded([vectors(parsed[k]) for k in group])
        p = model.probabilities(x, mask)
        for j, k in enumerate(group):
            chances[k] = p[: len(parsed[k]), j]
        at = end
    return list(zip(parsed, chances, strict=True))


def main_texts(model: BlockLabeller, pages: list[str]) -> list[str]:
    return [" ".join(text for (_, text, _), p in zip(blocks, chance.tolist(), strict=True) if p >= 0.5) for blocks, chance in label_pages(model, pages)]


def extract_main_text(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row. Null or empty html, and pages without main text, have an empty text; ids and urls are passed on.

    A narrow map; the trained parameters (about 100 kB) travel with the tasks.
    """
    model = model or trained()

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, held, size = [], [], 0
        for page in batch.column("html").to_pylist():
            held.append(page or "")
            size += len(held[-1])
            if size > 1 << 21:
                texts += main_texts(model, held)
                held, size = [], 0
        texts += main_texts(model, held)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = map_arrow(pick(pages, page_id="long", url="string", html="string"), extract, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
