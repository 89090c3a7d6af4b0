"""HTML that needs a real tokenizer: safe descriptions.

Only this leaves the JVM. It runs in Arrow batches over Python's own
``html.parser``, one document at a time; Spark partitions the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------------------
DROPPED = {
    "script", "style", "iframe", "form", "input", "button", "textarea", "select",
    "object", "embed", "applet", "noscript",
}
KEPT_ATTRS = {"a": ["href"], "img": ["src", "alt"]}
LINK_EXTRAS = {"target": "_blank", "rel": "noopener noreferrer"}
# -------------------------------------------------------------------------------------
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
#: Text of a batch that is turned into Python strings at a time.
RUN_BYTES = 1 << 20


def _quoted(value: str) -> str:
    """Double quotes, or single ones around a value that holds only double quotes."""
    text = escape(value, quote=False)
    if '"' in text and "'" not in text:
        return f"'{text}'"
    return '"' + text.replace('"', "&quot;") + '"'


def _open_tag(tag: str, attrs: dict) -> str:
    kept = {k: attrs[k] for k in attrs if k in KEPT_ATTRS.get(tag, [])}
    if tag == "a" and kept.get("href"):
        kept.update(LINK_EXTRAS)
    shown = "".join(f" {k}={_quoted(v)}" for k, v in kept.items())
    return f"<{tag}{shown}/>" if tag in VOID else f"<{tag}{shown}>"


class _Sanitizer(HTMLParser):
    """Writes safe HTML while it reads: the tree of a page is never held, only the tags that are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.counts: dict[str, int] = {}
        self.dropped = 0  # open tags from the first dropped one on

    def _close(self) -> None:
        tag = self.open.pop()
        self.counts[tag] -= 1
        if self.dropped:
            self.dropped -= 1
        else:
            self.out.append(f"</{tag}>")

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED or self.dropped:
            self.dropped += tag not in VOID
        else:
            self.out.append(_open_tag(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.open.append(tag)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED and not self.dropped:
            self.out.append(_open_tag(tag, {k: v or "" for k, v in attrs}))
            if tag not in VOID:
                self.out.append(f"</{tag}>")

    def handle_endtag(self, tag):
        if self.counts.get(tag):
            while self.open[-1] != tag:
                self._close()
            self._close()

    def _write(self, text: str) -> None:
        if not self.dropped:
            self.out.append(text)

    def handle_data(self, data):
        self._write(escape(data, quote=False))

    def handle_decl(self, decl):
        self._write(f"<!{decl}>\n")

    def handle_pi(self, data):
        self._write(f"<?{data}>")

    def close(self):
        super().close()
        while self.open:
            self._close()


def sanitize(page: str) -> str:
    """Safe structural HTML of one document."""
    builder = _Sanitizer()
    builder.feed(page)
    builder.close()
    return "".join(builder.out).strip()


def _runs(pages: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch with about RUN_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // RUN_BYTES
    starts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield pages.slice(lo, hi - lo)


@F.arrow_udf(StringType())
def _sanitize_batch(pages: pa.Array) -> pa.Array:
    done = [pa.array([None if t is None else sanitize(t) for t in run.to_pylist()], pa.string()) for run in _runs(pages)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def clean_html(c: Column) -> Column:
    """Safe HTML for a description. Text without any markup never crosses into Python's
    parser: it is sent as NULL and taken over as it is."""
    from boardlake.functions.text import strip

    marked = c.rlike("[<>&]")
    return F.when(marked, _sanitize_batch(F.when(marked, c))).otherwise(F.coalesce(strip(c), F.lit("")))
