"""Saved originals for a reader: markup cut down to what shows text, and passages marked in reviewed blocks.

The markup is rewritten token by token in one pass: elements on the list stay with at most an id (and a named colour), what
is active or fetched goes with all it holds, other tags go and leave what they hold.
"""

from __future__ import annotations

import re
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.html import RAW, VOID, _mapped, tokens

# Elements that stay, that go with what they hold, and the forms of ids and colours that stay.
SHOWN = set("p div span section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre code b strong i em u s small big sup sub font a br hr".split())
GONE = set("script style link iframe frame frameset object embed svg math img video audio source picture form input button textarea select template noscript canvas".split())
IDENTIFIER, COLOUR = re.compile(r"[A-Za-z][A-Za-z0-9_.:-]{0,127}"), re.compile(r"(?:#[0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?|[a-zA-Z]{1,20})")
ENDLESS = VOID | {"frame", "param", "track", "col"}


def safe_markup(source: str) -> str:
    """The body of a page as sound markup of shown elements only; elements that are left open end with the one around them."""
    out: list[str] = []
    open_: list[str] = []
    places: dict[str, int] = {}  # how many of an element are open
    gone: list[str] = []  # open elements that go, and what is open within the outermost
    inside = not re.search(r"<body[\s>/]", source, re.I)
    for t in tokens(source):
        if t.name == "body" and t.kind != "text":
            inside = t.kind == "start"
            continue
        if t.name in ("head", "title") and t.kind != "text" and not gone and t.kind == "start" and t.name == "title":
            gone.append("title")
            continue
        if gone:
            if t.kind == "start" and t.name == gone[0] and t.name not in RAW:
                gone.append(t.name)
            elif t.kind == "end" and t.name == gone[0]:
                gone.pop()
            continue
        if t.kind == "start" and t.name in GONE:
            if t.name not in ENDLESS:
                gone.append(t.name)
            continue
        if not inside:
            continue
        if t.kind == "text":
            out.append(escape(t.name).replace("&#x27;", "&#39;").replace("&quot;", "&#34;"))
            continue
        name = "ul" if t.name == "dir" else t.name
        if name not in SHOWN:
            continue
        if t.kind == "start":
            out.append(f"<{name}{_kept(name, t.attributes)}>")
            if name not in ("br", "hr"):
                open_.append(name)
                places[name] = places.get(name, 0) + 1
        elif places.get(name):
            while True:
                last = open_.pop()
                places[last] -= 1
                out.append(f"</{last}>")
                if last == name:
                    break
    return "".join(out) + "".join(f"</{x}>" for x in reversed(open_))


def _kept(name: str, attributes: dict[str, str]) -> str:
    ids = [v for k, v in attributes.items() if (k == "id" or (name == "a" and k == "name")) and IDENTIFIER.fullmatch(v)]
    colour = attributes.get("color", "") if name == "font" else ""
    return (f' id="{ids[0]}"' if ids else "") + (f' style="color:{colour}"' if COLOUR.fullmatch(colour) else "")


def shown_pages(pages: DataFrame) -> DataFrame:
    """(page_id, body) of pages (page_id, html); a page without markup has an empty body."""
    own = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return _mapped(own, ["page_id", "html"], lambda i, h: [(i, safe_markup(h))], "page_id long, body string")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def target(original: Column, reviewed: Column, start: Column, end: Column) -> Column:
    """The markup that shows characters start to end (exclusive) of a reviewed block, with a note if it differs from what was
    extracted; null for a span that the block does not hold."""
    sound = (start >= 0) & (end > start) & (end <= F.length(reviewed))
    part = lambda a, n: escaped(F.substring(reviewed, (a + 1).cast("int"), n.cast("int")))
    note = F.when(original.eqNullSafe(reviewed), "").otherwise("<p>This block was corrected; compare it with the original below.</p>")
    return F.when(sound, F.concat(F.lit('<section id="saved-passage"><h2>Passage</h2>'), note, F.lit("<pre>"), part(F.lit(0), start), F.lit("<mark>"), part(start, end - start), F.lit("</mark>"), part(end, F.length(reviewed) - end), F.lit("</pre></section>")))


def moved(corrections: Column, place: Column, ends: bool = False) -> Column:
    """Where a character of a text lies after corrections: an array in order of struct<at, removed, added> (characters), none of
    which overlap. A place inside what a correction removed moves to its beginning, or with `ends` to its end."""
    def step(shift: Column, c: Column) -> Column:
        behind = place >= c["at"] + c["removed"]
        within = (place > c["at"]) & ~behind
        inside = F.when(F.lit(ends), c["at"] + c["added"]).otherwise(c["at"]) - place
        return F.when(behind, shift + c["added"] - c["removed"]).when(within, shift + inside).otherwise(shift)

    return place + F.aggregate(corrections, F.lit(0), step)


def article_table(xml: bytes) -> str | None:
    """A table of an article's XML as markup of rows and cells with their spans; None if it is no sound table."""
    import xml.etree.ElementTree as E

    out: list[str] = []

    def write(node, cell: bool) -> None:
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        own = name in ("table", "thead", "tbody", "tfoot", "tr", "td", "th")
        if own:
            spans = [(k, v) for k in ("colspan", "rowspan") if name in ("td", "th") and (v := node.get(k, "")).isascii() and v.isdigit() and 1 <= int(v) <= 100]
            out.append(f"<{name}{''.join(f' {k}={chr(34)}{int(v)}{chr(34)}' for k, v in spans)}>")
        elif name == "break" and cell:
            out.append("<br>")
        cell_here = cell or name in ("td", "th")
        if cell_here and node.text and isinstance(node.tag, str):
            out.append(escape(node.text))
        for child in node:
            write(child, cell_here)
            if cell_here and child.tail:
                out.append(escape(child.tail))
        if own:
            out.append(f"</{name}>")

    try:
        root = E.fromstring(xml)
    except E.ParseError:
        return None
    write(root, False)
    return "".join(out) if out and out[0].startswith("<table") else None
