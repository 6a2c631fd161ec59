"""Safe reader-view HTML. The only step that needs a markup parser, so it runs as an Arrow-batched UDF."""

from __future__ import annotations

import html
import sys
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

VOID = {"br", "img", "hr"}
DROP_WITH_TEXT = {"script", "style", "textarea", "option"}
# An option needs no end tag: it ends where its list does.
OPTION_LISTS = {"select", "optgroup", "datalist"}
# A start tag ends these open elements, unless one of the second set was opened after them.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre", "hr", "figure", "figcaption", "table"}
ENDED_BY = {tag: ({"p"}, {"li", "td", "th", "blockquote", "figure", "figcaption"}) for tag in BLOCKS} | {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "thead": ({"thead", "tbody"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}),
}
FORCED = {
    "a": {"rel": "noopener noreferrer", "target": "_blank"},
    "img": {"loading": "lazy", "decoding": "async", "referrerpolicy": "no-referrer"},
}


def _text(value: str) -> str:
    return html.escape(value, quote=False)


def _safe_link(value: str) -> bool:
    flat = "".join(ch for ch in value if ch > " ")
    head = flat.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    return ":" not in head or head.split(":", 1)[0].lower() in K.ALLOWED_SCHEMES


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.muted: str | None = None  # the element whose text is dropped

    def _close(self, tags, guards=frozenset()):
        """End the innermost open element of ``tags`` and all inside it, but do not look past a guard."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] in tags:
                self.out += [f"</{tag}>" for tag in reversed(self.open[at:])]
                del self.open[at:]
                return
            if self.open[at] in guards:
                return

    def handle_starttag(self, tag, attrs):
        if self.muted == "option" and (tag in OPTION_LISTS or tag in BLOCKS):
            self.muted = None
        if tag in DROP_WITH_TEXT and self.muted in (None, "option"):
            self.muted = tag
        if self.muted or tag not in K.ALLOWED_TAGS:
            return
        self._close(*ENDED_BY.get(tag, ((),)))
        kept = {}
        allowed = K.ALLOWED_ATTRIBUTES.get(tag, [])
        for name, value in attrs:
            if name in allowed and name not in kept:
                if name in ("href", "src") and not _safe_link(value or ""):
                    continue
                kept[name] = value or ""
        kept.update(FORCED.get(tag, {}))
        text = "".join(f' {name}="{html.escape(value)}"' for name, value in kept.items())
        if tag in VOID:
            self.out.append(f"<{tag}{text} />")
        else:
            self.out.append(f"<{tag}{text}>")
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == self.muted or (self.muted == "option" and (tag in OPTION_LISTS or tag in self.open)):
            self.muted = None
        if not self.muted:
            self._close({tag})

    def handle_data(self, data):
        if not self.muted:
            self.out.append(_text(data))


def clean_markup(value: str | None) -> str | None:
    if value is None:
        return None
    if "<" not in value and "&" not in value:
        return _text(value)
    cleaner = _Cleaner()
    cleaner.feed(value)
    cleaner.close()
    return "".join(cleaner.out + [f"</{tag}>" for tag in reversed(cleaner.open)])


# Ship the code with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(K)


#: Bytes of markup that a Python worker holds as objects at once; a longer single body is a slice of its own.
SLICE_BYTES = 2_000_000


def clean_slices(values: pa.Array, limit: int = SLICE_BYTES) -> pa.Array:
    """``clean_markup`` of every value, a slice of about ``limit`` bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, start = [pa.array([], pa.string())], 0
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        parts.append(pa.array([clean_markup(v) for v in values.slice(start, stop - start).to_pylist()], pa.string()))
        start = stop
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def _sanitize(values: pa.Array) -> pa.Array:
    return clean_slices(values)


def sanitize_html(body: Column) -> Column:
    return _sanitize(body)
