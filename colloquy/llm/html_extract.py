"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of tags and of the words between them. Words score positive and tags negative; the best contiguous
region is found by one linear scan (`best_region`). What a tag costs is learned from labelled pages (`train`): a
structured perceptron moves the weights until the best region of a labelled page is its labelled content. Pages that
mark their content themselves (one `<article>` or `<main>` element) are the labelled ones in a table, at most
`MAX_PAGES` of them; `BUILT_IN` adds layouts without such marks.

A contiguous region can't leave out what stands inside an article (an advert, a share bar) and would prefer long reader
comments to a short article. So elements are first told apart as content or furniture (`Elements`): a logistic
regression over an element's tag and the words of its class, id and role, separately for elements inside marked content
and elsewhere, learned from the same labelled pages (what a page has outside its content is furniture) and from `KINDS`.
The words and tags of furniture score nothing and are no text; the region decides about all the rest.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
two line feeds in page order; nothing is capped. Tokenising is linear in the page's length.

Defined cases: null and empty pages and pages without words give an empty text; unclosed and misnested elements are
taken as they come (an element ends at its end tag, with its parent, or where the body, `<main>` or an `<article>`
begins; a head without an end ends where text begins); a `<` that begins no tag, or whose tag never ends, is text;
repeated rows give repeated results; very long pages are one sequence; an empty table trains on the built-in pages only;
the input's other columns are left aside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages of a table that training uses at most, the first by hash of their text.
MAX_PAGES = 400
ROUNDS = 12

SCHEMA = "page_id long, url string, text string, n_chars long, first_token long, last_token long"

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
#: Elements that start and end a block of text.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no text of a page, and those whose source is no markup.
_CONTROLS = frozenset("button select option input textarea iframe object embed canvas audio video map dialog".split())
_RAW = frozenset("script style noscript template svg title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their own kind.
_SIBLINGS = frozenset("p li dt dd td th tr option".split())

WORD = "a word"
#: Tags inside marked content are features of their own.
INSIDE = "@in"
#: Weights before training: a word is worth one, a tag costs one, one of running text a tenth, one in marked content less.
START_TAG = -1.0
#: Tags of running text: they stand on both sides of a content's edges, so their weights aren't trained.
_LIGHT = frozenset("p br b i em strong span h1 h2 h3 h4 blockquote".split())

#: What elements are by their tag and class, as further labelled examples (fixed lists): furniture anywhere, furniture
#: outside of an article only, and content.
KINDS = {
    "anywhere": "nav aside footer form menu .ad .ads .advert .advertisement .promo .sponsor .sponsored .banner .nav .navbar .navigation .breadcrumb .breadcrumbs .sidebar .related .related-posts .recommended .recommendations .comment .comments .comment-list .comments-area .post-comments .respond .replies .cookie .cookies .cookie-notice .consent .notice .alert .popup .modal .newsletter .newsletter-signup .subscribe .signup .login .share .sharing .share-buttons .social .social-links .widget .pagination .pager .toolbar .search-form .login-form .ad-slot .ad-banner .site-footer .hidden!",
    "outside": "header .header .masthead .site-header .page-header .foot .footer .menu .main-menu .side .side-bar .search .form .topbar .copyright",
    "content": "article main .article .content .main .post .entry .story .body .text .post-header .entry-header .article-header .post-title .entry-content .post-content .post-body .article-body .article-text .main-content .page-content .story-body .text-body div span a center p section ul ol li dl h1 h2 h3 h4 table tr td font b i",
    "content inside": "header .header .menu .side .search .foot .form p ul ol li h1 h2 h3 h4 section div span a b i figure table tr td blockquote",
}


def end_finder(page: str):
    """A function from where a tag begins to its closing `>` (-1 if none): quoted values are passed over if they end."""
    cache = {c: page.find(c) for c in ">\"'"}
    last = page.rfind(">")

    def find(c: str, at: int) -> int:
        if 0 <= cache[c] < at:
            cache[c] = page.find(c, at)
        return cache[c]

    def end_of(at: int) -> int:
        while at <= last:
            end = find(">", at)
            quotes = [q for q in (find('"', at), find("'", at)) if 0 <= q < end]
            if not quotes:
                return end
            q = min(quotes)
            if page[max(at - 1, q - 8) : q].rstrip()[-1:] != "=":
                at = q + 1
                continue
            closing = find(page[q], q + 1)
            if closing < 0 or closing > last:
                return end
            at = closing + 1
        return -1

    return end_of


def events_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kinds: text, open, close, and gap for what is skipped."""
    end_of, at, seek, closed = end_finder(page), 0, 0, {}
    while (begin := page.find("<", seek)) >= 0:
        kind, name, attributes = "gap", "", ""
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = len(page) if end < 0 else end + 3
        elif m := _NAME.match(page, begin + 1):
            end = end_of(begin + 1) + 1
            if not end:
                break
            name = m[0].lower()
            kind, attributes = ("close", "") if name[0] == "/" else ("open", page[m.end() : end - 1])
            name = name.lstrip("/")
            if kind == "open" and name in _RAW:
                kind = "gap"
                if closed.get(name, True):
                    found = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, end)
                    closed[name] = found is not None
                    end = found.end() if found else len(page) if name in ("script", "style") else end
        elif page[begin + 1 : begin + 2] in ("!", "?") and page[begin + 1 :begin + 2]:
            end = end_of(begin + 1) + 1
            if not end:
                break
        else:
            seek = begin + 1
            continue
        if begin > at:
            yield "text", page[at:begin], ""
        yield kind, name, attributes
        at = seek = end
    if at < len(page):
        yield "text", page[at:], ""


@lru_cache(maxsize=20_000)
def hints_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, whole and in parts, each after a dot."""
    out = []
    if "=" in attributes:
        for value in _HINT.findall(attributes):
            for word in value.strip("\"'").lower().split():
                parts = re.findall(r"[^\W\d_]+", word)
                out += ["." + word, *("." + x for x in parts if x != word)]
    if attributes and _HIDDEN.search(attributes):
        out.append(".hidden!")
    return tuple(dict.fromkeys(out))


def features_of(name: str, hints: tuple[str, ...], inside: bool) -> tuple[str, ...]:
    """What the element is judged by: its hints, else its tag; inside marked content every feature is one of its own."""
    return tuple(f + INSIDE if inside else f for f in hints or (name,))


class Elements:
    """Logistic regression over element features: above 0 is furniture, below CONTENT is marked content."""

    CONTENT = -2.0

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[tuple, tuple[float, bool]] = {}

    def score(self, name: str, hints: tuple[str, ...], inside: bool) -> float:
        return self.judge(name, hints, inside)[0]

    def judge(self, name: str, hints: tuple[str, ...], inside: bool) -> tuple[float, bool]:
        """Score and whether the hints mark content.

        Known hints decide, else the tag; navigation, forms and the like stay so whatever their class says.
        """
        if len(self.known) > 50_000:
            self.known.clear()
        key = (name, hints, inside)
        if key not in self.known:
            z = self.bias + self.weights.get(*(*features_of(name, (), inside), 0.0))
            hinted = [self.weights[f] for f in features_of(*key) if f in self.weights] if hints else []
            if hinted:
                z = max(z, self.bias + sum(hinted)) if z > 0 and name != "header" else self.bias + sum(hinted)
            self.known[key] = z, bool(hinted) and z < self.CONTENT
        return self.known[key]


def fit_elements(examples: Counter, rounds: int = 400, decay: float = 0.003) -> Elements:
    """examples: how often each (features, furniture) was seen. Full gradient steps with per-feature scaling."""
    every = sorted(examples)
    number: dict[str, int] = {}
    for features, _ in every:
        for f in features:
            number.setdefault(f, len(number))
    x = np.zeros((len(every), len(number)))
    for i, (features, _) in enumerate(every):
        x[i, [number[f] for f in features]] = 1.0
    y = np.array([float(furniture) for _, furniture in every])
    times = np.log1p([examples[e] for e in every])
    w, b, scale, scale_b = np.zeros(len(number)), -1.0, np.full(len(number), 1e-9), 1e-9
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y) * times
        g = x.T @ error + decay * w
        scale += g * g
        scale_b += error.sum() ** 2
        w -= 0.5 * g / np.sqrt(scale)
        b -= 0.5 * error.sum() / np.sqrt(scale_b)
    return Elements(dict(zip(number, w.tolist())), float(b))


def known_kinds() -> Counter:
    """KINDS as examples."""
    out: Counter = Counter()
    for kind, words in KINDS.items():
        for word in words.split():
            hints = (word,) if word[-1] == "!" else hints_of(f" class={word[1:]}") if word[0] == "." else ()
            for inside in {"anywhere": (False, True), "outside": (False,), "content": (False, True), "content inside": (True,)}[kind]:
                out[features_of(word, hints, inside), kind in ("anywhere", "outside")] += 20
    return out


def examples_of(page: str) -> Counter:
    """Elements of a page that marks its content: the outermost ones without content are furniture, plain ones inside it content."""
    out: Counter = Counter()
    events = list(events_of(page))
    marks = [name for name in ("article", "main") if sum(k == "open" and n == name for k, n, _ in events) == 1]
    if not marks:
        return out
    # Elements as [features, holds the content, parent]; of furniture only the outermost element of a subtree is one.
    stack: list[tuple[str, int]] = []
    found: list[list] = []
    inside = 0
    for kind, name, attributes in events:
        if kind == "open" and name not in _VOID:
            if name == marks[0]:
                for _, i in stack:
                    found[i][1] = True
            found.append([(name, hints_of(attributes), bool(inside)), name == marks[0], stack[-1][1] if stack else -1])
            stack.append((name, len(found) - 1))
            inside += name == marks[0]
        elif kind == "close" and any(n == name for n, _ in stack[-64:]):
            while stack and (top := stack.pop())[0] != name:
                inside -= top[0] == marks[0]
            inside -= name == marks[0]
    for (name, hints, within), holds, parent in found:
        if within and not hints and name not in ("header", "footer", "nav", "aside", "form", "menu"):
            out[features_of(name, (), True), False] += 1
        elif not within and not holds and name not in ("head", "html", "body") and name not in _CONTROLS and (parent < 0 or found[parent][1] or found[parent][0][0] in ("html", "body")):
            out[features_of(name, hints, False), True] += 1
    return out


BUILT_IN_ELEMENTS = fit_elements(known_kinds())


def tokens_of(page: str, elements: Elements | None = None) -> list[tuple[str, str, bool]]:
    """(kind, text, left out) in page order. kind is WORD for text between tags, else the tag's feature."""
    elements = elements or BUILT_IN_ELEMENTS
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, marked content
    open_names: Counter = Counter()
    furniture = content = 0

    def close() -> str:
        nonlocal furniture, content
        name, bad, good = stack.pop()
        open_names[name] -= 1
        furniture -= bad
        content -= good
        return name

    for kind, name, attributes in events_of(page):
        if kind == "text":
            out.append((WORD, name, furniture > 0))
        elif kind == "gap":
            # Comments, declarations, scripts and the like neither score nor show; they still part words.
            out.append(("", " ", furniture > 0))
        elif kind == "close":
            left_out = furniture > 0
            if open_names[name]:
                while close() != name:
                    pass
            out.append((f"/{name}" + INSIDE * (content > 0), "", left_out))
        else:
            if name in ("article", "main", "body"):
                # What holds the article isn't furniture: a form around a whole page, a menu without an end.
                stack[:] = [(n, False, good) for n, _, good in stack] if furniture else stack
                furniture = 0
            if stack and ((name in _SIBLINGS and stack[-1][0] == name) or (stack[-1][0] == "p" and name in _BLOCKS)):
                close()
            z, good = elements.judge(name, hints_of(attributes), content > 0) if name not in ("html", "head", "body") else (0.0, False)
            good |= name in ("article", "main")
            bad = not good and (z > 0 or name in _CONTROLS)
            feature = (f"{name}.content" if good else name) + INSIDE * (content > 0)
            if name not in _VOID:
                stack.append((name, bad, good))
                open_names[name] += 1
                furniture += bad
                content += good
            out.append((feature, "", furniture > 0 or bad))
    return out


def start_weight(kind: str) -> float:
    return START_TAG / 20 if kind.endswith(INSIDE) else START_TAG / 10 if kind.lstrip("/") in _LIGHT else START_TAG


def scores_of(tokens: list[tuple[str, str, bool]], weights: dict[str, float]) -> list[float]:
    word = weights[WORD]
    return [0.0 if out or not kind else word * len(text.split()) if kind == WORD else weights.get(kind) or start_weight(kind) for kind, text, out in tokens]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range [a, b) of the largest positive sum, the first of equal ones; (0, 0) if there is none."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def train(pages: list[tuple[list[tuple[str, str, bool]], tuple[int, int]]], rounds: int = ROUNDS) -> dict[str, float]:
    """Averaged structured perceptron; the word's weight stays 1, so that tag weights are in words."""
    weights: dict[str, float] = {WORD: 1.0}
    total: dict[str, float] = {}
    steps = 0
    for _ in range(rounds):
        wrong = 0
        for tokens, (low, high) in pages:
            a, b = best_region(scores_of(tokens, weights))
            if (a, b) != (low, high):
                wrong += 1
                # Tags that the region wrongly spans cost more, those that it wrongly leaves out cost less.
                for i in range(min(a, low), max(b, high)):
                    kind = tokens[i][0]
                    inside, right = a <= i < b, low <= i < high
                    if inside != right and kind not in (WORD, "") and kind.lstrip("/") not in _LIGHT and not tokens[i][2]:
                        step = 8.0 if right else -8.0
                        weights[kind] = min(-0.01, max(-400.0, weights.get(kind, start_weight(kind)) + step / (1 if not right else 16)))
            for k, v in weights.items():
                total[k] = total.get(k, 0.0) + v
            steps += 1
        if not wrong:
            return weights
    return {k: v / steps for k, v in total.items()} | {WORD: 1.0} if steps else weights


def labelled(page: str, elements: Elements) -> tuple[list, tuple[int, int]] | None:
    """Tokens and content range of a page with exactly one <article> (or else <main>) that holds words; else None."""
    tokens = tokens_of(page, elements)
    kinds = [t[0] for t in tokens]
    for name in ("article", "main"):
        opens = [i for i, k in enumerate(kinds) if k.removesuffix(INSIDE).split(".")[0] == name]
        closes = [i for i, k in enumerate(kinds) if k.removesuffix(INSIDE) == f"/{name}"]
        if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
            inner = [i for i in range(opens[0] + 1, closes[0]) if kinds[i] == WORD and tokens[i][1].strip() and not tokens[i][2]]
            # The tightest range: from the first word to the last one.
            return (tokens, (inner[0], inner[-1] + 1)) if inner else None
    return None


def _built_in() -> list[tuple[list, tuple[int, int]]]:
    """Layouts without marks, with furniture that no class tells: link lists, cells and short lines around running text."""
    words = "the report that came out this week says more than most of the earlier ones did about the river and its towns".split()
    links = "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(["Home", "World news", "Our people", "About us", "All the reports"]))
    out = []
    for n, (before, inside, after) in enumerate([
        (f"<ul>{links}</ul><div>", "<h1>%s</h1><p>%s</p><p>%s</p>", f"</div><h3>More</h3><ul>{links}</ul><table><tr><td><a>Terms</a></td><td><a>Contact</a></td></tr></table>"),
        ("<div><a>One</a> | <a>Two of them</a> | <a>Three</a></div><div><font>Sign in</font></div><div>", "<h2>%s</h2><p>%s <a>%s</a></p><ul><li>%s</li><li>%s</li></ul>", "</div><div><a>Top</a> | <a>Map of the site</a></div>"),
        ("<table><tr><td><a>Links</a><br><a>Archive of old news</a></td><td>", "<p>%s</p><blockquote>%s</blockquote><p>%s</p>", f"</td></tr></table><ul>{links}</ul>"),
        (f"<table><tr><td><a>Daily</a></td><td><a>Weekly</a></td></tr></table><ul>{links}</ul><section>", "<h1>%s</h1><p>%s</p><p>%s</p><p>%s</p>", f"</section><dl><dt><a>Next</a></dt><dd><a>A look at the hills</a></dd></dl><ul>{links}</ul>"),
    ]):
        for k in range(3):
            texts = [" ".join((words * 4)[: 12 + 9 * ((i + n + k) % 4)]) for i in range(inside.count("%s"))]
            left, body = tokens_of(f"<html><body>{before}"), tokens_of(inside % tuple(texts))
            word_at = [i for i, t in enumerate(body) if t[0] == WORD]
            out.append((left + body + tokens_of(f"{after}</body></html>"), (len(left) + word_at[0], len(left) + word_at[-1] + 1)))
    return out


BUILT_IN = _built_in()


def region_text(tokens: list[tuple[str, str, bool]], low: int, high: int) -> str:
    """The region's text without the elements that are left out."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for kind, text, left_out in tokens[low:high]:
        if kind == WORD or not kind:
            if not left_out:
                run.append(text)
        elif (name := kind.lstrip("/").removesuffix(INSIDE).split(".")[0]) in _BLOCKS:
            close()
        elif name == "br":
            run.append(" ")
    close()
    return "\n\n".join(blocks)


class Model:
    """elements tells furniture from content, weights are the costs of tags."""

    def __init__(self, pages: list[str]):
        seen = known_kinds()
        for page in pages:
            seen.update(examples_of(page))
        self.elements = fit_elements(seen)
        self.weights = train([x for page in pages if (x := labelled(page, self.elements))] + BUILT_IN)


def extract(page: str | None, model: Model) -> tuple[str, int, int]:
    tokens = tokens_of(page or "", model.elements)
    low, high = best_region(scores_of(tokens, model.weights))
    return region_text(tokens, low, high), low, high


def learn(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """From at most max_pages pages of the table that label themselves, and the built-in pages and kinds."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select("html")
    return Model([page for (page,) in marked.orderBy(F.xxhash64("html"), "html").limit(max_pages).toLocalIterator()])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars and the best region (tokens first_token to last_token - 1) of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [extract(page.as_py(), shared.value) for page in part.column(2)]
                texts = [t for t, _, _ in found]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                columns += [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "first_token", "last_token"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)
