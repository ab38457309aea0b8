"""Reading HTML as a run of tokens, in time that grows with the page and not with its nesting."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# fixed values: names of HTML and MathML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg object select canvas audio video map annotation annotation-xml".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mpadded mphantom munder mover munderover mmultiscripts menclose merror mfenced mtable mtr mtd""".split()
)


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", tag, attributes), ("close", tag, "") and ("raw", tag, content) in page order.

    Comments, declarations and CDATA sections are left out. An element whose content is no markup comes as an opening
    token, its content and a closing token; it ends at the page's end if it is not closed.
    """
    at, end, lower = 0, len(source), None
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            yield "text", "", source[at:]
            return
        if m.start() > at:
            yield "text", "", source[at : m.start()]
        at = m.end()
        closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag not in RAW and tag not in VOID:
                yield "close", tag, ""
            continue
        yield "open", tag, raw
        if tag in RAW:
            if not raw.endswith("/"):
                lower = source.lower() if lower is None else lower
                if len(lower) == end:
                    stop = lower.find(f"</{tag}", at)
                else:  # a character's lower case has another length
                    found = re.compile(f"</{tag}", re.I).search(source, at)
                    stop = found.start() if found else -1
                yield "raw", tag, source[at : stop if stop >= 0 else end]
                close = source.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else end
            yield "close", tag, ""
