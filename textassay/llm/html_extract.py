"""Main text of web pages by boosted trees over the DOM, decoded as a hierarchy.

Every block element of a page is described by its tag, its attributes' words, its
depth, the density of text, links and marks in its subtree, its place among its
siblings and what its ancestors are.  Boosted trees give each the odds to belong
to the article.  Decoding then chooses for the whole tree at once: an element is
outside, inside, or dropped; inside may only begin once on a path, and what is
below a dropped element is dropped.  So no paragraph is taken out of a dropped
comment, and no menu out of an article contradicts its list items.

The trees are fitted on the driver on pages written by a generator with known
articles (``training_pages``); no page of the corpus is used.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import Trees, fit
from .common import bounded_batches, text_or_empty
from .dom import Page, parse

TAGS = ("p", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "h1", "h2", "h3")
TAG_AT = {t: k for k, t in enumerate(TAGS)} | {"h4": 21, "h5": 21, "h6": 21, "th": 14, "tr": 13, "tbody": 13, "dl": 2, "dd": 1, "dt": 1, "menu": 2, "fieldset": 12}
#: Words of class, id and role, by what they tell.
GROUPS = {
    "body": "article articlebody content post entry main story text body copy prose page blog editorial",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination topbar toolbar tabs toc skip",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner dfp taboola outbrain",
    "side": "sidebar side aside widget widgets related recommended recommendations more popular trending rail teaser teasers complementary",
    "foot": "footer foot copyright legal colophon credits contentinfo imprint",
    "head": "header head masthead logo branding hero site title",
    "comment": "comment comments reply replies respond disqus discussion thread commentlist responses reader readers feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message banner disclaimer warning notification",
    "share": "share sharing social follow facebook twitter tweet buttons tags tag meta byline author bio",
    "form": "form search login contact input",
}
GROUP_OF = {w: k for k, words in enumerate(GROUPS.values()) for w in words.split()}
N_GROUPS = len(GROUPS)
OUTER_TAGS = np.isin(np.array([*TAGS, "other"]), ["nav", "header", "footer", "aside", "form"])
INNER_TAGS = np.isin(np.array([*TAGS, "other"]), ["article", "main"])


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each block element of the pages, one page after another; and where each page begins."""
    sizes = np.array([len(p.tags) for p in pages])
    first = np.cumsum(sizes) - sizes
    shift = np.repeat(first, sizes)
    n = int(sizes.sum())
    flat = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, n)
    parent, depth, chars, linked, marks, inner = (flat(x) for x in ("parents", "depths", "chars", "linked", "marks", "inner"))
    end = flat("ends") + shift
    root = parent < 0
    parent = np.where(root, 0, parent) + shift
    tag = np.fromiter((TAG_AT.get(t, len(TAGS)) for p in pages for t in p.tags), np.int64, n)
    groups = np.zeros((n, N_GROUPS))
    for k, words in enumerate(w for p in pages for w in p.names):
        for w in words:
            if (g := GROUP_OF.get(w)) is not None:
                groups[k, g] = 1
    index = np.arange(n)
    subtree = lambda v: (s := np.r_[0, np.cumsum(v)])[end] - s[index]

    def above(flag: np.ndarray) -> np.ndarray:
        """How many ancestors have the flag."""
        steps = np.zeros(n + 1)
        np.add.at(steps, index + 1, flag)
        np.add.at(steps, end, -flag)
        return np.cumsum(steps)[:n]

    text, links, dots, nodes = subtree(chars), subtree(linked), subtree(marks), end - index
    markup = nodes + subtree(inner)
    kids = np.bincount(parent[~root], minlength=n)
    kid_text = np.bincount(parent[~root], text[~root], minlength=n)
    same = np.zeros(n)
    key = parent * (len(TAGS) + 1) + tag
    values, inverse, count = np.unique(np.where(root, -1 - index, key), return_inverse=True, return_counts=True)
    same = count[inverse]
    order = np.lexsort((index, parent))
    order = order[~root[order]]
    begin = np.r_[True, parent[order][1:] != parent[order][:-1]] if len(order) else np.zeros(0, bool)
    place = np.zeros(n)
    run = np.arange(len(order))
    place[order] = run - np.maximum.accumulate(np.where(begin, run, 0)) if len(order) else 0
    page_text = np.repeat(text[first], sizes) + 1
    before = np.r_[0, np.cumsum(chars)][index] - np.repeat(np.r_[0, np.cumsum(chars)][first], sizes)
    siblings = kids[parent]
    x = [
        (tag[:, None] == np.arange(len(TAGS))).astype(float),
        groups,
        np.stack([above(groups[:, g]) for g in range(N_GROUPS)], axis=1),
        np.stack(
            [
                above(OUTER_TAGS[tag].astype(float)),
                above(INNER_TAGS[tag].astype(float)),
                above((tag == TAG_AT["li"]).astype(float)),
                depth,
                np.log1p(chars),
                np.log1p(text),
                links / (text + 1),
                text / markup,
                dots / (text + 1) * 100,
                np.log1p(nodes),
                subtree((tag == 0).astype(float)),
                subtree(INNER_TAGS[tag].astype(float)),
                subtree(OUTER_TAGS[tag].astype(float)),
                siblings,
                same / np.maximum(siblings, 1),
                place / np.maximum(siblings, 1),
                np.log1p(kid_text[parent] / np.maximum(siblings, 1)),
                text / page_text,
                before / page_text,
                tag[parent],
            ],
            axis=1,
        ),
    ]
    return np.concatenate(x, axis=1), first


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements are inside the article: the choice of the largest likelihood without contradictions.

    Elements count by their own text; outside > inside > dropped along every path.
    """
    n = len(page.tags)
    weight = 1 + np.log1p(np.array(page.chars)) / 2
    yes, no = (-np.logaddexp(0, -odds) * weight).tolist(), (-np.logaddexp(0, odds) * weight).tolist()
    outside, inside, dropped = no, yes, list(no)
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        outside[up] += max(outside[k], inside[k])
        inside[up] += max(inside[k], dropped[k])
        dropped[up] += dropped[k]
    state = [0] * n  # 0 outside, 1 inside, 2 dropped
    state[0] = int(inside[0] > outside[0])
    for k in range(1, n):
        up = state[page.parents[k]]
        state[k] = 2 if up == 2 else (1 if inside[k] >= dropped[k] else 2) if up == 1 else int(inside[k] > outside[k])
    return np.array(state) == 1


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The article of each page, its blocks joined by empty lines."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    x, first = features(pages)
    odds = trees.margin(x)
    out = []
    for page, at in zip(pages, first.tolist(), strict=True):
        inside = decode(page, odds[at : at + len(page.tags)])
        out.append("\n\n".join(text for node, text in page.blocks if inside[node]))
    return out


# --- training pages


class Writer:
    """Writes pages of many layouts; text of articles is marked by a private sign."""

    SIGN = "\ue000"

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.syllables = ["".join(self.rng.choice(x) for x in ("bcdfglmnprstv", "aeiouéäñ", "nrslt")) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + self.rng.choice(".....!?") for _ in range(self.rng.randint(low, high)))

    def named(self, tag: str, *names: str, of: str = "") -> str:
        name = self.rng.choice(names)
        how = self.rng.choice([f'class="{name}"', f'id="{name}"', f'class="{self.word()} {name}"'])
        return f"<{tag} {how}{of}>"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def menu(self) -> str:
        r = self.rng
        items = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9)))
        open_, close = r.choice([("<nav>", "</nav>"), (self.named("div", "nav", "menu", "main-menu", "navbar", "breadcrumb"), "</div>"), (self.named("nav", "top", "menu"), "</nav>")])
        return f"{open_}<ul>{items}</ul>{close}" if r.random() < 0.8 else f"{open_}{' | '.join(self.link() for _ in range(4))}{close}"

    def advert(self) -> str:
        tag = self.rng.choice(["div", "div", "div", "aside", "section", "p"])
        return f"{self.named(tag, 'ad', 'ads', 'advert', 'sponsored', 'ad-slot', 'promo', 'banner')}{self.sentences(1, 3)}</{tag}>"

    def notice(self) -> str:
        return f"{self.named('div', 'cookie-notice', 'consent', 'notice', 'newsletter', 'alert', 'popup', 'subscribe-box')}<p>{self.sentences(1, 3)}</p>{self.rng.choice(['', '<button>Ok</button>', self.link()])}</div>"

    def side(self) -> str:
        r, tag = self.rng, self.rng.choice(["aside", "aside", "div", "section"])
        open_ = "<aside>" if tag == "aside" and r.random() < 0.6 else self.named(tag, "sidebar", "widget", "related", "popular-posts", "teasers", "right-rail")
        body = r.choice([f"<h3>{self.words(1, 4)}</h3><ul>" + "".join(f"<li>{self.link(2, 8)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 5)}</p>", f"<p>{self.sentences(1, 4)}</p>" * r.randint(1, 2), self.sentences(1, 4)])
        return f"{open_}{body}</{tag}>"

    def form(self) -> str:
        open_ = self.rng.choice(["<form>", self.named("form", "search", "login", "contact-form")])
        return f"{open_}<label>{self.words(1, 3)}</label><input type=text><p>{self.sentences(1, 2)}</p><button>{self.word()}</button></form>"

    def comments(self) -> str:
        r = self.rng
        tag = r.choice(["div", "section", "ul", "ol"])
        item = "li" if tag in ("ul", "ol") else r.choice(["div", "div", "article"])
        one = lambda: f"{self.named(item, 'comment', 'reply', 'comment-body', 'reader-comment')}{r.choice(['', f'<h4>{self.words(1, 2)}</h4>', f'<b>{self.words(1, 2)}</b>'])}<p>{self.sentences(1, 6)}</p></{item}>"
        head = r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>"]) if tag not in ("ul", "ol") else ""
        return f"{self.named(tag, 'comments', 'comment-list', 'disqus', 'discussion', 'responses', 'comments-area')}{head}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"

    def header(self) -> str:
        r = self.rng
        inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 8)}</p>", self.link()])
        tag = r.choice(["header", "header", "div"])
        open_ = "<header>" if tag == "header" and r.random() < 0.6 else self.named(tag, "header", "site-header", "masthead", "logo", "topbar")
        return f"{open_}{inner}{r.choice(['', self.menu()])}</{tag}>"

    def footer(self) -> str:
        r = self.rng
        tag = r.choice(["footer", "footer", "footer", "div"])
        open_ = "<footer>" if tag == "footer" and r.random() < 0.7 else self.named(tag, "footer", "site-footer", "copyright")
        inner = r.choice([f"&copy; {self.word()}.com &middot; {self.sentences(1, 5)}", f"<p>{self.sentences(1, 4)}</p>", f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(4))}</ul><p>&copy; {self.words(1, 3)}</p>", f"{self.sentences(1, 2)}\n{self.sentences(1, 3)}"])
        return f"{open_}{inner}</{tag}>"

    def share(self) -> str:
        return f"{self.named('div', 'share', 'social', 'share-buttons', 'author-bio')}{r if (r := self.words(1, 4)) else ''} {self.link()}</div>"

    def article(self) -> str:
        """The article's elements; every text of it begins with the sign."""
        r, s = self.rng, self.SIGN
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{s}{self.words(1, 9)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 25])):
            kind, short = r.random(), r.random() < 0.25
            body = self.words(1, 6) + "." if short else self.sentences(1, 12)
            if kind < 0.62:
                out.append(f"<p>{s}{body}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.70:
                out.append(f"<p>{s}<b>{body}<br>")
            elif kind < 0.75:
                out.append(f"<h2>{s}{self.words(1, 6)}</h2><p>{s}{body}</p>")
            elif kind < 0.81:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{s}{r.choice([self.words(1, 9), self.sentences(1, 2), self.link(2, 4)])}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>")
            elif kind < 0.85:
                out.append(f"<blockquote>{r.choice([f'<p>{s}{body}</p>', s + body])}</blockquote>")
            elif kind < 0.88:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{s}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.91:
                out.append(f"<figure><img src=x><figcaption>{s}{self.words(2, 9)}</figcaption></figure>")
            elif kind < 0.94:
                out.append(f"<div>{s}{body}</div>")
            elif kind < 0.96:
                out.append(f"<pre>{s}{body}</pre>")
            else:
                out.append(r.choice([self.advert, self.notice, self.share, self.side, self.form])())
        return "".join(out)

    def loose(self) -> str:
        """An article without an element of its own: its parts stand in the body, some of them no elements at all."""
        r, s = self.rng, self.SIGN
        how = r.random()
        if how < 0.4:
            return self.article()
        if how < 0.7:
            return s + r.choice(["<br><br>", "<br>", " "]).join(self.sentences(1, 6) for _ in range(r.randint(1, 6)))
        return "".join(f"<div>{s}{self.sentences(1, 6)}</div>" for _ in range(r.randint(1, 8)))

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.04:
            return self.SIGN + self.sentences(1, 6)  # plain text
        around = r.random()
        if around < 0.14:
            open_, close, inner = "", "", self.loose()
        elif around < 0.2:
            open_, close = r.choice([("<div>", "</div>"), ("<center>", "</center>"), ("<table><tr><td>", "</td></tr></table>"), (self.named("div", self.word()), "</div>")])
            inner = self.loose()
        else:
            open_, close = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (self.named("div", "content", "post", "entry", "article-body", "story", "post-content", "main"), "</div>"), (self.named("article", "post", "entry", "story"), "</article>"), (self.named("section", "content", "article", "post-body"), "</section>")])
            inner = self.article()
        if r.random() < 0.12:
            inner += self.comments()
        if r.random() < 0.1:
            inner += self.share() + self.side()
        body = open_ + inner + close
        before = [f() for f in (self.header, self.menu, self.notice, self.advert, self.side, self.form) if r.random() < 0.45]
        after = [f() for f in (self.comments, self.side, self.advert, self.form, self.notice, self.menu, self.footer, self.footer) if r.random() < 0.4]
        if not open_ and r.random() < 0.5:
            before, after = [], []
        if r.random() < 0.5:
            r.shuffle(after)
        if open_ and r.random() < 0.35:
            body = f"{self.named('div', 'wrapper', 'container', 'page', 'layout', 'row', 'columns')}{body}{r.choice(['', self.side()])}</div>"
        whole = f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(before)}<!-- {self.word()} -->{body}{''.join(after)}"
        return whole + r.choice(["</body></html>", "</body></html>", ""])


def training_pages(seed: int = 11, pages: int = 800) -> tuple[list[Page], list[np.ndarray]]:
    """Pages with, for every block element, whether it belongs to the article.

    Elements with marked text do; so do those that enclose only such elements, as
    far up as the article goes.
    """
    writer = Writer(seed)
    found, labels = [], []
    for _ in range(pages):
        page = parse(writer.page())
        own = np.zeros(len(page.tags), bool)
        foreign = np.zeros(len(page.tags))
        for node, text in page.blocks:
            if text.startswith(Writer.SIGN):
                own[node] = True
        for node, text in page.blocks:
            foreign[node] += not own[node]
        marked, others = own.astype(int), foreign.copy()
        for k in range(len(page.tags) - 1, 0, -1):
            marked[page.parents[k]] += marked[k]
            others[page.parents[k]] += others[k]
        # The article is the lowest element that has all marked text; elements in it belong to it if they hold some.
        top = max((k for k in range(len(page.tags)) if marked[k] == marked[0]), default=0)
        inside = np.zeros(len(page.tags), bool)
        for k in range(top, page.ends[top]):
            inside[k] = marked[k] > 0 and (k == top or inside[page.parents[k]])
        found.append(page)
        labels.append(inside)
    return found, labels


_fitted: dict[tuple[int, int], Trees] = {}


def trained(seed: int = 11, pages: int = 800) -> Trees:
    """The trees, fitted once in a process."""
    if (seed, pages) not in _fitted:
        found, labels = training_pages(seed, pages)
        x, _ = features(found)
        _fitted[seed, pages] = fit(x, np.concatenate(labels).astype(float))
    return _fitted[seed, pages]


TEXTS = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])


def extract_partition(trees: Trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html").to_pylist()
            texts = [t for at in range(0, len(html), 100) for t in main_texts(html[at : at + 100], trees)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Null or empty html, and pages without an article, have an empty text.  Ids and
    URLs may be null or repeated and are passed on; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(extract_partition(trees or trained()), "page_id long, url string, text string, n_chars long")
