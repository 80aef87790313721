"""Visible text of pages: inherited visibility, selectors with ancestors, drawn and fallback text, folded cells."""

import random

import pytest

from tidegrid.llm import htmltext


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div style="visibility:hidden">a<p style="visibility:visible">b', "b"),
        ('<div style="display:none">a<p style="display:block;visibility:visible">b</p></div>c', "c"),
        ('<div style="visibility:collapse">a<b style="visibility:inherit">b</b></div>c', "c"),
        ("area <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> end", "area x=2 end"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>label</text></svg> z", "label z"),
        ("<object data=x>instead</object>", "instead"),
        ("<style>.nav .x{display:none}</style><div class=nav><p>q<span class=x>no</span></div><span class=x>yes</span>", "q\n\nyes"),
        ("<style>ul > li.h{display:none}</style><ul><li class=h>no<li>yes</ul>", "- yes"),
        ("<style>div > b{display:none}</style><div><i><b>yes</b></i><b>no</b></div>", "yes"),
        ("<style>a b i{visibility:hidden}</style><a><u><b><i>no</i></b></u></a><b><i>yes</i></b>", "yes"),
        ("<style>#m p.n{display:none} p{display:block}</style><div id=m><p class=n>no</div><p class=n>yes", "yes"),
        ("<style>.a .b{display:block} .b{display:none}</style><div class=a><p class=b>yes</div><p class=b>no", "yes"),
        ("<style>* .b{display:none} p:hover{display:none} p + p{display:none}</style><div><p class=b>no</p></div><p>yes", "yes"),
    ],
)
def test_what_shows(html, text):
    assert htmltext.render(html) == text


def test_columns_begin_at_the_same_place_whatever_a_cell_holds():
    html = "<table><tr><td>" + "word " * 60 + "<td>right<tr><td>short<td>also<tr><td>" + "x" * 45 + "<td>third</table>"
    lines = htmltext.render(html).split("\n")
    at = {line.index(w) for line in lines for w in ("right", "also", "third") if w in line}
    assert len(at) == 1 and max(map(len, lines)) <= htmltext.WRAP + 2 + len("right")
    assert " ".join(lines).split().count("word") == 60
    long = "y" * 300
    assert long in htmltext.render(f"<table><tr><td>{long} z<td>b</table>")


STYLES = ["", "display:none", "visibility:hidden", "visibility:visible", "display:block;visibility:collapse"]
RULES = [((".c0",), "display:none"), ((".c1", ".c2"), "visibility:hidden"), (("div", ".c3"), "visibility:visible"), ((".c2",), "visibility:visible")]


def tree(rng, depth):
    tag, cls, style = rng.choice(["div", "p", "span", "section", "b"]), rng.choice(["", "c0", "c1", "c2", "c3"]), rng.choice(STYLES[:1] * 4 + STYLES)
    kids = [tree(rng, depth - 1) if depth and rng.random() < 0.6 and tag != "p" else f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 4))]
    return tag, cls, style, kids


def as_html(n):
    if isinstance(n, str):
        return n + " "
    tag, cls, style, kids = n
    return f'<{tag} class="{cls}" style="{style}">' + "".join(map(as_html, kids)) + f"</{tag}>"


def seen(n, above, shown):
    """Visible words by the cascade, worked out element by element."""
    if isinstance(n, str):
        return [n] if shown else []
    tag, cls, style, kids = n
    here = [*above, (tag, cls)]
    said = {}

    def is_(e, s):
        return e[1] == s[1:] if s[0] == "." else e[0] == s

    weighed = sorted(enumerate(RULES), key=lambda r: (sum(s[0] == "." for s in r[1][0]), len(r[1][0]), r[0]))
    for _, (sel, body) in weighed:
        ok = is_(here[-1], sel[-1]) and (len(sel) == 1 or any(is_(e, sel[0]) for e in here[:-1]))
        if ok:
            said |= dict(p.split(":") for p in body.split(";"))
    said |= dict(p.split(":") for p in style.split(";") if p)
    if said.get("display") == "none":
        return []
    shown = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility"), shown)
    return [w for k in kids for w in seen(k, here, shown)]


def test_random_trees_against_a_second_cascade():
    rng = random.Random(4)
    css = "<style>" + " ".join(f"{' '.join(s)}{{{b}}}" for s, b in RULES) + "</style>"
    for _ in range(400):
        nodes = [tree(rng, 4) for _ in range(3)]
        want = [w for n in nodes for w in seen(n, [], True)]
        assert htmltext.render(css + "".join(map(as_html, nodes))).split() == want


def test_clashing_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in htmltext.extract(pages, keep=("url",)).collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert htmltext.extract(pages.limit(0)).count() == 0
    for clash in (("text",), ("page_id",), ("url", "url")):
        with pytest.raises(ValueError):
            htmltext.extract(pages, keep=clash)
