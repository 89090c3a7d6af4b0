"""Edit-aware token counts: a segment tree over each document's pre-tokens; edits re-encode only what they touch.

The leaves of the tree are blocks of pre-tokens with their characters and token counts; a node is the sum of its two
children. An edit replaces characters [start, end) of the text as it was before any edit; edits do not overlap. The
pre-tokens from CONTEXT characters before an edit on are split again until a border falls on an old border behind the edit:
splitting from a border on depends on nothing before it, so all behind stays. Only new pre-tokens are encoded;
the blocks concerned, and the sums above them, change.

Null texts count as empty. Edits that are null, reversed, out of range or overlap an earlier one are refused with an error, as they
name no text. Repeated rows are counted alike. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from boardlake.llm.base import no_threads, query, table

#: Characters behind a pre-token that its end may depend on.
CONTEXT = 2
BLOCK = 32
KEEP = 800_000
_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Tokens of single pre-tokens by the tokenizers library; each is encoded once per worker."""

    def __init__(self, path: str):
        no_threads()
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.known: dict[str, int] = {}

    def learn(self, parts: list[list[str]]) -> None:
        if len(self.known) > KEEP:
            self.known.clear()
        fresh = list(set().union(*parts).difference(self.known))
        for w, e in zip(fresh, self.lib.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.known[w] = len(e.ids)

    def __call__(self, part: str) -> int:
        n = self.known.get(part)
        if n is None:
            n = self.known[part] = len(self.lib.encode_batch_fast([part], add_special_tokens=False)[0].ids)
        return n


class SegmentTree:
    """Pre-tokens of a text in blocks; chars and tokens are sums, the root at 1, the leaves from size on."""

    def __init__(self, parts: list[str], count):  # noqa: ANN001
        self.blocks = [([len(p) for p in parts[k:k + BLOCK]], [count(p) for p in parts[k:k + BLOCK]]) for k in range(0, len(parts), BLOCK)] or [([], [])]
        self.size = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (sizes, counts) in enumerate(self.blocks):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(sizes), sum(counts)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, place in it, first character) of the pre-token that holds a character; the last one for the end."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        sizes, place = self.blocks[k - self.size][0], 0
        while place < len(sizes) - 1 and at >= start + sizes[place]:
            start += sizes[place]
            place += 1
        return k - self.size, place, start

    def replace(self, first: tuple[int, int], last: tuple[int, int], sizes: list[int], counts: list[int]) -> None:
        """Pre-tokens from first to last (both included) become others; they all go to the first block."""
        (b, i), (c, j) = first, last
        tail = self.blocks[c][0][j + 1:], self.blocks[c][1][j + 1:]
        head = self.blocks[b][0][:i], self.blocks[b][1][:i]
        for k in range(b, c + 1):
            self.blocks[k] = ([], [])
        self.blocks[c] = tail
        self.blocks[b] = (head[0] + sizes + (tail[0] if b == c else []), head[1] + counts + (tail[1] if b == c else []))
        touched = set(range(self.size + b, self.size + c + 1))
        for k in touched:
            self.chars[k], self.tokens[k] = sum(self.blocks[k - self.size][0]), sum(self.blocks[k - self.size][1])
        while touched := {k // 2 for k in touched if k > 1}:
            for k in touched:
                self._sum(k)


def apply_edit(tree: SegmentTree, text: str, start: int, end: int, new: str, count) -> tuple[str, int]:  # noqa: ANN001
    """(text after the edit, pre-tokens encoded again); the tree follows."""
    after = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    if not text:
        parts = _PRE_TOKEN.findall(after)
        tree.replace((0, 0), (0, 0), [len(p) for p in parts], [count(p) for p in parts])
        return after, len(parts)
    b, i, at = tree.find(max(0, start - CONTEXT))
    c, j, old = b, i, at  # the next old pre-token and its first character
    sizes: list[int] = []
    counts: list[int] = []
    old_end = old + tree.blocks[c][0][j]
    while True:
        m = _PRE_TOKEN.match(after, at)
        if m is not None:
            sizes.append(m.end() - at)
            counts.append(count(m[0]))
            at = m.end()
        border = at - shift  # where this border lay before the edit
        while old_end < border or old_end < end:
            while j + 1 >= len(tree.blocks[c][0]):
                if c + 1 >= len(tree.blocks):
                    break
                c, j = c + 1, -1
            else:
                j += 1
                old_end += tree.blocks[c][0][j]
                continue
            break
        if m is None or (old_end == border and border >= end):
            break
    tree.replace((b, i), (c, j), sizes, counts)
    return after, len(sizes)


def count_edited(text: str, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[int, int, int, int]:
    """(tokens before, tokens after, pre-tokens before, pre-tokens encoded again) of a text and its edits."""
    parts = _PRE_TOKEN.findall(text)
    tree = SegmentTree(parts, counter)
    before, again, limit = tree.total, 0, len(text)
    for start, end, new in sorted(edits, key=lambda e: e[:2], reverse=True):  # from behind: places ahead stay
        if not 0 <= start <= end <= limit:
            raise ValueError(f"edit [{start}, {end}) does not lie in the text or overlaps another")
        text, n = apply_edit(tree, text, start, end, new, counter)
        again, limit = again + n, start
    return before, tree.total, len(parts), again


_MADE: dict[str, Counter] = {}


def edited_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_pre_tokens, n_encoded_again); edits: array<struct<start, end, new>>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MADE:
            _MADE[path] = Counter(path)
        counter = _MADE[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                edits = [[(e["start"], e["end"], e["new"]) for e in x or ()] for x in part.column(2).to_pylist()]
                counter.learn([_PRE_TOKEN.findall(t) for t in texts])
                rows = [count_edited(t, e, counter) for t, e in zip(texts, edits, strict=True)]
                columns = [[r[0] for r in rows], [len(e) for e in edits], *([r[k] for r in rows] for k in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    names = [id_col, "n_tokens", "n_edits", "n_tokens_after", "n_pre_tokens", "n_encoded_again"]
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:])
    return docs.select(id_col, text_col, edits_col).mapInArrow(run, schema)


_NUMBER = regex.compile("[0-9]{4,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a usual cleaning step: a line equal to an earlier one goes, and a run of four digits or more becomes a place-holder."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line and line in seen:
            edits.append((at - 1, end, ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "<num>") for m in _NUMBER.finditer(line)]
        at = end + 1
    return edits


@query("op7_edit_counts")
def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after cleaning_edits."""
    @F.arrow_udf("array<struct<start:int,end:int,new:string>>")
    def edits(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
        return pa.array([[{"start": s, "end": e, "new": n} for s, e, n in cleaning_edits(t or "")] for t in texts.to_pylist()], kind)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits("text").alias("edits"))
    return edited_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
