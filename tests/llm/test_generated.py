"""Main text, pseudonyms and derivatives against generated input whose right result is known by construction."""

from __future__ import annotations

import html
import random
import re
from html.parser import HTMLParser

import pytest

from foliary.llm import pseudonyms, tagpaths, warc


def sentence(rng: random.Random, least: int = 8) -> str:
    words = ["".join(rng.choice("abcdeéüo") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(least, least + 20))]
    return " ".join(words).capitalize() + rng.choice([".", ", and so on.", "; no?", " & more."])


def spaced(rng: random.Random, text: str) -> str:
    """The same text with references, inline tags and other white space."""
    out = []
    for word in text.split(" "):
        word = html.escape(word, quote=False).replace("é", rng.choice(["é", "&eacute;", "&#233;", "&#xe9;"]))
        out.append(rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<a href='/x?a=1&amp;b=2'>{}</a>", "<em class=x>{}</em>"]).format(word))
    return re.sub(" ", lambda _: rng.choice([" ", " ", "\n", "  ", "\t"]), " ".join(out)) if "<a " not in "".join(out) else " ".join(out)


ASIDES = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News, sport</a></li></ul></nav>", "<header><h1>The site</h1><p>A claim, in a sentence.</p></header>", "<footer><p>All rights, they say, are reserved. Terms.</p></footer>",
    "<aside><p>By the way, this is not it. Nor this.</p></aside>", "<div class='sidebar'><h2>More</h2><p>Other stories, for you. Read on.</p></div>", "<div id=cookie-banner>We use cookies, of course. Accept?</div>", "<div class='ad-slot'>Buy this, now. It is cheap.</div>",
    "<section class='comments'><h3>Comments</h3><p>I think, therefore I comment. At length, too. Really.</p><p>So do I, in a way. Yes.</p></section>", "<form><label>Name, please.</label><input><button>Send.</button></form>", "<script>var p = '<p>No, never. Not this.</p>';</script>",
    "<style>p:after { content: 'no, no.'; }</style>", "<noscript><p>Turn it on, please. Now.</p></noscript>", "<!-- <p>A comment, of sorts. Out.</p> -->", "<div role=navigation><a>One</a> <a>Two</a></div>", "<p hidden>Hidden, as you see. Not.</p>", "<div style='display: none'>Not shown, at all. No.</div>",
]


def article(rng: random.Random) -> tuple[str, list[str]]:
    parts, want = [], []
    title = sentence(rng, 2).rstrip(".")
    parts.append(f"<h1>{spaced(rng, title)}</h1>")
    want.append(title)
    for _ in range(rng.randint(3, 9)):
        kind = rng.random()
        if kind < 0.7:
            lines = [sentence(rng)]
            parts.append(f"<p>{spaced(rng, lines[0])}" + rng.choice(["</p>", "</p>", ""]))
        elif kind < 0.8:
            lines = ["Heading " + str(rng.randint(1, 9))]
            parts.append(f"<h2>{lines[0]}</h2>")
        elif kind < 0.9:
            lines = [sentence(rng, 1) for _ in range(rng.randint(1, 3))]
            parts.append("<ul>" + "".join(f"<li>{spaced(rng, x)}" for x in lines) + "</ul>")
        else:
            lines = [sentence(rng)]
            parts.append(f"<blockquote><p>{spaced(rng, lines[0])}</p></blockquote>")
        if rng.random() < 0.15:
            parts.append(rng.choice([x for x in ASIDES if not x.startswith("<header")]))  # an article's own header holds its title
        want += lines
    lines = [sentence(rng)]
    parts.append(f"<p>{spaced(rng, lines[0])}</p>")
    return "".join(parts), want + lines


@pytest.mark.parametrize("seed", range(300))
def test_main_text_of_generated_pages(seed):
    rng = random.Random(seed)
    inner, want = article(rng)
    around = rng.choice(["<article>{}</article>", "<main><article class='post h-entry'>{}</article></main>", "<div id=content>{}</div>", "<div class='page layout-sidebar-left'><div class=inner-wrap>{}</div></div>", "<section class=story>{}</section>", "<table><tr><td>{}</td></tr></table>"])
    before, after = rng.sample(ASIDES, 4), rng.sample(ASIDES, 4)
    page = f"<!DOCTYPE html><html lang=en><head><title>T</title><meta charset=utf-8></head><body>{''.join(before)}{around.format(inner)}{''.join(after)}</body></html>"
    assert tagpaths.main_text(page).split("\n") == want


class Shown(HTMLParser):
    """Visible text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "title")
        if tag in warc.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "title")
        if tag in warc.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\n", " "))


@pytest.mark.parametrize("seed", range(40))
def test_derivatives_of_generated_pages(seed):
    rng = random.Random(100 + seed)
    inner, _ = article(rng)
    page = f"<html lang=fr><head><title> A &amp;\n title </title></head><body>{''.join(rng.sample(ASIDES, 5))}<div>{inner}</div></body></html>"
    other = Shown()
    other.feed(page)
    want = "\n".join(x for x in (" ".join(line.split()) for line in "".join(other.parts).split("\n")) if x)
    title, language, links, text = warc.read_page(page)
    assert text == want and (title, language) == ("A & title", "fr")
    assert [x["url"] for x in links if x["url"].startswith("/x")] == ["/x?a=1&b=2"] * page.count("<a href='/x?a=1&amp;b=2'>")


def planted(rng: random.Random) -> tuple[str, str]:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(["card", "iban", "ssn", "ip", "email", "phone", "date"])
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        number = next(body + str(c) for c in range(10) if pseudonyms.luhn(body + str(c)))
        return kind, rng.choice(["", " ", "-"]).join(re.findall("....", number))
    if kind == "iban":
        bban = digits(18)
        return kind, f"DE{98 - int(bban + '131400') % 97:02d}{bban}"
    if kind == "ssn":
        return kind, f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    if kind == "ip":
        return kind, ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "email":
        return kind, f"{rng.choice(['ann', 'bob.x', 'c-3'])}{rng.randint(1, 99)}@mail.example.org"
    if kind == "phone":
        return kind, rng.choice([f"+1 ({rng.randint(201, 989)}) {rng.randint(201, 989)}-{digits(4)}", f"{rng.randint(201, 989)}-{rng.randint(201, 989)}-{digits(4)}", f"+49 30 {rng.randint(1000, 9999)} {digits(4)}"])
    y, m, d = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    return kind, rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d} {pseudonyms.MONTHS[m - 1]} {y}", f"{pseudonyms.MONTHS[m - 1]} {d}, {y}"])


@pytest.mark.parametrize("seed", range(40))
def test_pseudonyms_of_planted_values(seed):
    rng = random.Random(200 + seed)
    text, want = "", []
    for _ in range(30):
        text += " ".join(rng.choice(["word", "and", "no. 17", "3/4", "v1.2.3", "x@y", "12 of 99", "(see)"]) for _ in range(rng.randint(1, 5))) + ", "
        kind, value = planted(rng)
        want.append((len(text), len(text) + len(value), kind))
        text += value + rng.choice([", ", "; ", ". ", ")\n"])
    permute = pseudonyms.permuter(b"key")
    new, spans = pseudonyms.rewrite(text, permute)
    assert spans == want
    assert pseudonyms.reveal(new, b"key") == text
    for a, b, kind in want:
        value = text[a:b]
        alone, found = pseudonyms.rewrite(f"on {value}!", permute)
        assert alone[3:-1] in new and found == [(3, 3 + len(value), kind)]
