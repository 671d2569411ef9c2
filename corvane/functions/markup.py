"""Text of markup by a parser that bears malformed nesting, beside the regular expressions of ``text.clean_html``."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T


class TextNodes(HTMLParser):
    """The texts between tags, in order; those of scripts and styles, comments and declarations are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden, self.fresh = "", True

    def handle_starttag(self, tag, attrs):
        self.fresh = True
        if tag in ("script", "style"):
            self.hidden = tag

    def handle_startendtag(self, tag, attrs):
        self.fresh = True  # closed at once: nothing is inside

    def handle_endtag(self, tag):
        self.fresh = True
        if tag == self.hidden:
            self.hidden = ""

    def handle_comment(self, data):
        self.fresh = True

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if self.hidden:
            return
        if self.fresh:
            self.nodes.append(data)
        else:  # the parser gives a text with a stray < in parts
            self.nodes[-1] += data
        self.fresh = False


#: Pages whose texts a worker makes before it hands them on. A batch may be 64 MB; its texts are never held beside it all at once.
HELD = 64


def text_of(html: str | None) -> str:
    """Text nodes with a line break between each two."""
    parser = TextNodes()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.nodes)


def texts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``text_of`` every page, ``HELD`` pages at a time."""
    for batch in batches:
        for at in range(0, len(batch), HELD):
            yield pa.array([text_of(page.as_py()) for page in batch.slice(at, HELD)], pa.string())
        del batch  # gone before the next one is read


def parsed_html(html: Column) -> Column:
    """What ``text.clean_html`` gives for well-formed markup; attributes with ``>``, open and crossed tags and all entities are read as a browser would."""
    t = F.regexp_replace(F.arrow_udf(texts_of, "string")(html), r"(?U)\s+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return T.strip(F.regexp_replace(t, r"[ \t]+", " "))
