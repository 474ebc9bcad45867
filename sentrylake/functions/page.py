"""A page of HTML read once: tokens by the standard parser, folded with their state into a struct that columns look into."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructType

_TEXTS = ArrayType(StringType())
_FORM = StructType().add("action", StringType()).add("method", StringType()).add("inputs", ArrayType(StructType().add("name", StringType()).add("type", StringType())))
#: sources are those of scripts, scripts the bodies of those without one; prompts are placeholders of fields; body is the text without
#: title, scripts and styles, shown that with the title, both with single spaces.
PAGE = StructType().add("forms", ArrayType(_FORM)).add("sources", _TEXTS).add("icon", StringType()).add("prompts", _TEXTS).add("scripts", StringType()).add("title", StringType()).add("body", StringType()).add("shown", StringType())

#: Characters of HTML, and pages, whose parts are held as objects at a time.
PIECE, PIECE_ROWS = 1 << 20, 1024

TELLING = frozenset({"form", "input", "script", "style", "title", "link"})


class _Tokens(HTMLParser):
    """(kind, name or text, attributes) of the tags that tell something, and of all text; character references are decoded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        if tag in TELLING:
            self.seen.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if tag in TELLING:
            self.seen.append(("close", tag, None))

    def handle_data(self, data):
        self.seen.append(("text", data, None))


def tokens(html: str | None) -> list[tuple]:
    """The tokens up to the end, or to a construct that isn't complete there; those before one that no parser reads."""
    reader = _Tokens()
    try:
        reader.feed(html or "")
    except AssertionError:  # a marked section of an unknown kind
        pass
    return reader.seen


def _spaced(texts: list[str]) -> str:
    return " ".join(" ".join(texts).split())


def folded(seen: list[tuple]) -> dict:
    """The parts of a page. A form counts when it is closed, and with the inputs since the last form was opened; of icons the last."""
    forms, sources, prompts, scripts, title, body, shown = [], [], [], [], [], [], []
    form = icon = None
    inline = styled = titled = False
    hidden = 0  # scripts and styles that are open
    for kind, what, attrs in seen:
        if kind == "text":
            if inline:
                scripts.append(what)
            elif not styled:
                shown.append(what)
            if titled:
                title.append(what)
            elif not hidden:
                body.append(what)
        elif what == "form":
            if kind == "open":
                form = {"action": attrs.get("action", ""), "method": (attrs.get("method") or "get").lower(), "inputs": []}
            elif form is not None:
                forms.append(form)
                form = None
        elif what == "title":
            titled = kind == "open"
        elif what in ("script", "style"):
            hidden = hidden + 1 if kind == "open" else max(0, hidden - 1)
            if what == "style":
                styled = kind == "open"
            elif kind == "close":
                inline = False
            elif attrs.get("src"):
                sources.append(attrs["src"])
            else:
                inline = True
        elif kind == "open" and what == "input":
            if form is not None:
                form["inputs"].append({"name": attrs.get("name", ""), "type": (attrs.get("type") or "text").lower()})
            if attrs.get("placeholder"):
                prompts.append(attrs["placeholder"])
        elif kind == "open" and "icon" in attrs.get("rel", "").lower() and attrs.get("href"):
            icon = attrs["href"]
    return {"forms": forms, "sources": sources, "icon": icon, "prompts": prompts, "scripts": "\n".join(scripts), "title": _spaced(title), "body": _spaced(body), "shown": _spaced(shown)}


@F.arrow_udf(PAGE)
def page_of(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The parts of each page as PAGE; null is a page without any. Pages leave in pieces of PIECE characters of HTML, so that a task
    holds the parts of few of them as objects, however many rows a batch has."""
    kind = to_arrow_type(PAGE)
    for batch in pages:
        held, size = [], 0
        for html in batch:
            html = html.as_py()
            held.append(folded(tokens(html)))
            size += len(html or "") + PIECE // PIECE_ROWS
            if size >= PIECE:
                yield pa.array(held, type=kind)
                held, size = [], 0
        if held:
            yield pa.array(held, type=kind)
