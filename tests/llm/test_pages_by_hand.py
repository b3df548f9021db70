"""Pages written by hand, none by the generator, with the articles that a reader would take from them."""

import time

import numpy as np
import pytest

from textassay.llm import dom, html_extract

A = "The harbour was closed on Monday after the storm had torn two boats from their moorings."
B = "Nobody was hurt, said the harbour master, but the repairs will take until the end of May."
C = "Ferries to the islands leave from the old pier until then, every two hours."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul>'

PAGES = {
    "bare body": (f"<html><body><p>{A}</p><p>{B}</p></body></html>", [A, B]),
    "bare body, no html": (f"<p>{A}<p>{B}<p>{C}", [A, B, C]),
    "plain text": (f"{A} {B}", [f"{A} {B}"]),
    "text with breaks": (f"<body>{A}<br><br>{B}</body>", [f"{A} {B}"]),
    "bare body between menu and footer": (f"<body><nav>{MENU}</nav><p>{A}</p><p>{B}</p><footer>&copy; 2020 Harbour News</footer></body>", [A, B]),
    "heading in the body": (f"<body><h1>Storm closes harbour</h1><p>{A}</p><p>{B}</p></body>", ["Storm closes harbour", A, B]),
    "article": (f"<body><header><a href='/'>Harbour News</a></header><article><h1>Storm</h1><p>{A}</p><p>{B}</p></article></body>", ["Storm", A, B]),
    "main": (f"<body><nav>{MENU}</nav><main><h1>Storm</h1><p>{A}</p><p>{C}</p></main><footer><p>All rights reserved.</p></footer></body>", ["Storm", A, C]),
    "content class": (f"<body><div class='navbar'>{MENU}</div><div class='content'><p>{A}</p><p>{B}</p></div><div class='sidebar'><h3>Popular</h3>{MENU}</div></body>", [A, B]),
    "button in the article": (f"<body><article><p>{A}</p><button>Share</button><p>{B}</p></article></body>", [A, B]),
    "button in a paragraph": (f"<body><article><p>{A} <button type=button>Copy link</button></p><p>{B}</p></article></body>", [A, B]),
    "reader comments": (f"<body><article><p>{A}</p><p>{B}</p></article><section class='comments'><h2>Comments</h2><div class='comment'><p>My uncle lost his boat there.</p></div><div class='comment'><p>So sad.</p></div></section></body>", [A, B]),
    "cookie notice": (f"<body><div class='cookie-notice'><p>We use cookies to improve this site.</p><button>OK</button></div><main><p>{A}</p><p>{B}</p></main></body>", [A, B]),
    "advert inside": (f"<body><article><p>{A}</p><div class='ad'>Buy a new boat today, cheap.</div><p>{B}</p></article></body>", [A, B]),
    "aside inside": (f"<body><article><p>{A}</p><aside><h4>Related</h4>{MENU}</aside><p>{B}</p><p>{C}</p></article></body>", [A, B, C]),
    "form": (f"<body><form action='/s'><label>Search</label><input name=q><button>Go</button></form><article><p>{A}</p><p>{B}</p></article></body>", [A, B]),
    "scripts and styles": (f"<head><style>p {{}}</style><script>var a = '<p>no</p>';</script></head><body><article><p>{A}</p><script>b()</script><p>{B}</p></article></body>", [A, B]),
    "list in the article": (f"<body><main><h1>What is known</h1><ul><li>{A}</li><li>{B}</li></ul><p>{C}</p></main></body>", ["What is known", A, B, C]),
    "quote": (f"<body><article><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></article></body>", [A, B, C]),
    "characters": ("<body><article><p>Caf&eacute; &amp; bar &lt;open&gt; &#8211; until\n\t ten in the evening, says the owner.</p><p>" + B + "</p></article></body>", ["Café & bar <open> – until ten in the evening, says the owner.", B]),
    "upper case, loose ends": (f"<BODY><ARTICLE><H1>Storm<P>{A}<P>{B}</ARTICLE></BODY>", ["Storm", A, B]),
    "inline markup": (f"<body><article><p>{A[:20]}<b>{A[20:40]}</b><i>{A[40:]}</i></p><p>{B}</p></article></body>", [A, B]),
    "newsletter box": (f"<body><article><p>{A}</p><p>{B}</p></article><div class='newsletter subscribe'><p>Get our letter every week.</p><form><input><button>Send</button></form></div></body>", [A, B]),
    "wrapped": (f"<body><div class='wrapper'><div class='header'><div class='logo'>Harbour News</div></div><div class='post'><h2>Storm</h2><p>{A}</p><p>{B}</p></div><div class='footer'>Imprint</div></div></body>", ["Storm", A, B]),
    "menu only": (f"<body><nav>{MENU}</nav></body>", []),
    "nothing": ("<html><head><title>x</title></head><body></body></html>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_articles(name):
    html, want = PAGES[name]
    assert html_extract.main_texts([html], html_extract.trained()) == ["\n\n".join(want)]


def best_by_trying(page, odds):
    """The best likelihood of any choice without contradictions, element by element."""
    weight = 1 + np.log1p(np.array(page.chars)) / 2
    yes, no = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight

    def tried(k, states):
        if k == len(page.tags):
            return 0.0
        up = states[page.parents[k]] if k else "outside"
        allowed = {"outside": ("outside", "inside"), "inside": ("inside", "dropped"), "dropped": ("dropped",)}[up]
        return max((yes if s == "inside" else no)[k] + tried(k + 1, [*states, s]) for s in allowed)

    return tried(0, [])


def test_decoding_of_real_pages_is_the_best_choice():
    trees, checked = html_extract.trained(), 0
    for html, _ in PAGES.values():
        page = dom.parse(html)
        if len(page.tags) > 13:
            continue
        odds = trees.margin(html_extract.features([page])[0])
        inside = html_extract.decode(page, odds)
        weight = 1 + np.log1p(np.array(page.chars)) / 2
        got = float((np.where(inside, -np.logaddexp(0, -odds), -np.logaddexp(0, odds)) * weight).sum())
        assert abs(got - best_by_trying(page, odds)) < 1e-9
        checked += 1
    assert checked > 15


@pytest.mark.parametrize("piece", ["<div>", "<p>a", "<svg>", "<li>x", "<a href=x>y", "<button>", "</div>", "<td>1"])
def test_time_is_linear_in_the_page(piece):
    took = []
    for n in (20_000, 40_000):
        best = min(_time(piece * n) for _ in range(2))
        took.append(best)
    assert took[1] < 2 and took[1] <= 2.5 * took[0] + 0.1


def _time(source):
    began = time.perf_counter()
    dom.parse(source)
    return time.perf_counter() - began
