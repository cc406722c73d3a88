"""Main text: built pages with known articles, pages on which the cut corrects the classifier, odd and deep markup."""

import random
import resource
import subprocess
import sys
import time

import pytest

from chromaflow.llm import html_text

LONG = "The river rose for three days and then it fell again, and people came back to their houses. " * 3


def text(*parts):
    return "\n".join(" ".join(p.split()) for p in parts)


def unary(page):
    blocks = html_text.blocks_of(page)
    return text(*(b.text for b in blocks if html_text.odds(b) > 0))


#: Pages that the classifier alone gets wrong, and their article.
CUT_DECIDES = {
    "short lines of an unmarked article": (f"<body><div><h2>Rain</h2><div>{LONG}</div><div>So it went</div><div>{LONG}</div><div>Day two</div><div>{LONG}</div></div></body>", ["Rain", LONG, "So it went", LONG, "Day two", LONG]),
    "a sentence among links": (
        f"<body><div><p>{LONG}</p></div><div><div><a>One more page</a></div><div><a>Other news here</a></div><div>Read all about the town.</div><div><a>Next of these</a></div><div><a>Last of these</a></div></div></body>",
        [LONG],
    ),
    "a heading without a heading's tag": (f"<body><div><div>Of floods</div><p>{LONG}</p><div>And after</div><p>{LONG}</p></div></body>", ["Of floods", LONG, "And after", LONG]),
}


@pytest.mark.parametrize("name", CUT_DECIDES)
def test_cut_corrects_the_classifier(name):
    page, article = CUT_DECIDES[name]
    assert html_text.main_text(page) == text(*article)
    assert unary(page) != text(*article)


def test_topics_and_states_in_names_lose_nothing():
    for opening in ('<section class="related-work">', '<p class="notice-of-award">', '<p class="share-price">', '<div id="search-engines-history">', '<div class="ad-hoc-networks">', '<section class="header-files">'):
        tag = opening[1:].split()[0]
        page = f"<body><article><p>{LONG}</p>{opening}{LONG}</{tag}><p>{LONG}</p></article></body>"
        assert html_text.main_text(page) == text(LONG, LONG, LONG), opening
    assert html_text.main_text(f'<body><div class="search-engines-history"><p>{LONG}</p></div></body>') == text(LONG)
    assert html_text.main_text(f"<article><p>{LONG} <math><mi>E</mi> is mc</math> holds for all bodies.</p></article>") == text(f"{LONG} E is mc holds for all bodies.")


def test_unmarked_and_short_texts():
    assert html_text.main_text("Hello &amp; welcome") == "Hello & welcome"
    assert html_text.main_text("<html><body><nav><a>Home</a></nav>Soon here</body></html>") == "Soon here"
    assert html_text.main_text("<body><nav><a>Home</a></nav><footer>End</footer></body>") == ""
    assert html_text.main_text("a < b and c > d") == "a < b and c > d"


def test_nothing_but_markup_is_dropped_unasked(monkeypatch):
    """All that is text reaches the cut, whatever its names say."""
    page = f'<nav>N</nav><aside>A</aside><form>F</form><footer>E</footer><div class="ad">D</div><div hidden>H</div><p>{LONG}</p><script>s</script><style>t</style><select><option>o</select><svg><text>g</text></svg>'
    assert [b.text for b in html_text.blocks_of(page)] == ["N", "A", "F", "E", "D", "H", " ".join(LONG.split())]
    monkeypatch.setattr(html_text, "cut", lambda z, edges: [True] * len(z))
    assert html_text.main_text(page).startswith("N\nA\nF\nE\nD\nH\n")


def built(seed):
    """A page of an article among boilerplate, and the article."""
    rng = random.Random(seed)
    word = lambda: rng.choice("rain river house people town water day night bridge road field sun".split())
    sentence = lambda a=6, b=18: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    wanted, inside = [], []
    title = sentence(2, 6).rstrip(".")
    wanted.append(title)
    for _ in range(rng.randint(1, 7)):
        kind = rng.random()
        if kind < 0.6:
            body = " ".join(sentence() for _ in range(rng.randint(1, 5)))
            shown = body.replace(" ", rng.choice([" ", "\n  ", "\t"]), 2)
            if rng.random() < 0.3:
                shown = shown.replace("river", "<b>river</b>").replace("town", '<a href="t">town</a>', 1)
            inside.append(f"<p>{shown}</p>" if rng.random() < 0.7 else f"<p>{shown}")
            wanted.append(body)
        elif kind < 0.75:
            head = sentence(1, 4).rstrip(".")
            inside.append(f"<h2>{head}</h2>")
            wanted.append(head)
        elif kind < 0.9:
            items = [sentence(3, 8) for _ in range(rng.randint(2, 4))]
            inside.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            wanted += items
        else:
            junk = rng.choice(['<div class="ad">{}</div>', '<aside class="related-posts"><p>{}</p></aside>', '<div class="share-buttons"><a>{}</a></div>', "<script>var x = '{}'</script>"])
            inside.append(junk.format(sentence()))
    menu = "".join(f"<li><a href='/{i}'>{word().capitalize()}</a></li>" for i in range(rng.randint(2, 8)))
    shell = rng.choice(["<article>{}</article>", '<main><div class="content">{}</div></main>', '<div id="main" class="post">{}</div>', '<div class="entry-content">{}</div>'])
    comments = '<section class="comments"><div class="comment"><p>{}</p></div></section>'.format(" ".join(sentence() for _ in range(4))) if rng.random() < 0.5 else ""
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><header><div>{word()} site</div></header><nav><ul>{menu}</ul></nav>"
        + (f'<div class="cookie-notice">We use cookies. {sentence()}</div>' if rng.random() < 0.5 else "")
        + shell.format(f"<h1>{title}</h1>" + "".join(inside))
        + comments
        + f'<div class="sidebar"><h3>More</h3><ul>{menu}</ul></div><form>Name <input><button>Send</button></form><footer>&copy; {sentence()}</footer></body></html>'
    )
    return page, wanted


@pytest.mark.parametrize("seed", range(60))
def test_built_pages(seed):
    page, wanted = built(seed)
    assert html_text.main_text(page) == text(*wanted)


def test_large_and_deep_pages():
    """A megabyte of nested or broken tags takes seconds and little memory."""
    pages = {
        "nested": "<div>" * 200_000 + LONG, "unmatched": "<div>" * 20_000 + "</article>" * 60_000 + LONG, "vectors": "<svg>" * 150_000, "inline": "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000 + LONG,
        "mixed": f"<div>{LONG}</div><div><a>x y</a></div>" * 4_000, "marks": "<" * 200_000 + "&" * 200_000,
    }
    for name, page in pages.items():
        began = time.perf_counter()
        got = html_text.main_text(page)
        assert time.perf_counter() - began < 20 and (name in ("vectors", "marks") or LONG.split()[0] in got), name
    code = "from chromaflow.llm import html_text as h; import resource as r; a = r.getrusage(r.RUSAGE_SELF).ru_maxrss; h.main_text('<div>' * 200_000 + 'x'); print(r.getrusage(r.RUSAGE_SELF).ru_maxrss - a)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=html_text.__file__.rsplit("/", 3)[0]).stdout)
    assert grown * (1 if sys.platform == "linux" else 1 / 1024) < 300 * 1024 and resource
