"""Token ids of whole texts by the tokenizers library, at the speed of a word list.

A byte-level pre-tokenizer always ends a token before a space that is followed by a character that is no white
space. So a text is cut there, each different piece goes through the library once per worker, and texts are
put together from the pieces' ids. Texts with other runs of white space go through the library as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from boardlake.llm.base import let_go, no_threads, ragged

#: Texts, and bytes of them, in a run at most.
_RUN, _RUN_BYTES = 20_000, 2_000_000

END_ID = 2
_MARKS = ".,;:!?"
_JOIN = 200
#: How byte-level vocabularies write a space.
_SPACE = "\u0120"
_LINE_END = "\u010a"


class _Growing:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.empty(1024, kind), 0

    @property
    def now(self) -> np.ndarray:
        return self.all[:self.n]

    def extend(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.all):
            wider = np.empty(max(end, 2 * len(self.all)), self.all.dtype)
            wider[:self.n] = self.now
            self.all = wider
        self.all[self.n:end] = values
        self.n = end


class _Slots(dict):
    """Numbers for keys in the order of arrival; pending has the keys that no number existed for."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.pending.append(key)
        return n


class TextEncoder:
    """encode(texts) gives the ids that the library gives, without special tokens. keep: pieces remembered."""

    def __init__(self, path: str, keep: int = 500_000):
        no_threads()
        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        byte = {c: b for b, c in _byte_letters().items()}
        size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            size[i] = len(token) if all(c in byte for c in token) else len(token.encode())
        for i, added in self.lib.get_added_tokens_decoder().items():
            size[i] = len(added.content.encode())
        self.bytes_of, self.marks, self.keep = size, {m: i for m in _MARKS if (i := vocab.get(m)) is not None}, keep
        split = self.lib.pre_tokenizer
        whole_words = self.lib.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel)
        self.word = self.lib.model.tokenize if whole_words else None
        self.line_end = [t.id for t in self.word(_LINE_END)] if whole_words and split.use_regex and not split.add_prefix_space else None
        self._clear()

    def forget(self) -> None:
        """Lets go of all pieces: a worker that goes on with other work should not hold them."""
        self._clear()
        let_go()

    def _clear(self) -> None:
        self.slots, self.flat = _Slots(), _Growing(np.uint32)
        self.start, self.size = _Growing(np.int64), _Growing(np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _put(self, at: list[int] | np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """ids holds one run of sizes[k] ids for each piece at[k]."""
        self.start.now[at] = self.flat.n + np.cumsum(sizes) - sizes
        self.size.now[at] = sizes
        self.flat.extend(ids)

    def _line(self, key: str) -> list[int] | None:
        """Ids of a word and a mark, a line end, and a word with or without a mark; None for other pieces."""
        left, _, right = key.partition("\n")
        ends, last = self.marks.get(left[-1:]), self.marks.get(right[-1:])
        word, after = left[:-1], right if last is None else right[:-1]
        if ends is None or not (_is_word(word) and _is_word(after)):
            return None
        out = [t.id for t in self.word(_SPACE + _letters(word))]
        out.append(ends)
        out += self.line_end
        out += [t.id for t in self.word(_letters(after))]
        if last is not None:
            out.append(last)
        return out

    def _learn(self) -> None:
        """Ids of the pending pieces. A piece stands for itself after a space; one that starts with a space begins a text."""
        slots, marks, base = self.slots, self.marks, self.start.n
        plain, plain_at, heads, heads_at, words, ends, tails_at, words_at = [], [], [], [], [], [], [], []
        ids, sizes = array("I"), array("q")
        for i, key in enumerate(slots.pending, base):  # grows while it is read
            mark = marks.get(key[-1:])
            if key[:1] == " ":
                heads.append(key[1:])
                heads_at.append(i)
            elif mark is not None and _is_word(word := key[:-1]):
                words.append(slots[word])
                ends.append(mark)
                tails_at.append(i)
            elif self.word is not None and _is_word(key):  # one token run: no need to split it
                found = self.word(_SPACE + _letters(key))
                ids.extend([t.id for t in found])
                sizes.append(len(found))
                words_at.append(i)
            elif self.line_end is not None and "\n" in key and (line := self._line(key)):
                ids.extend(line)
                sizes.append(len(line))
                words_at.append(i)
            elif key and not key[0].isspace():
                plain.append(key)
                plain_at.append(i)
        slots.pending = []
        grow = len(slots) - base
        self.start.extend(np.zeros(grow, np.int64))
        self.size.extend(np.full(grow, -1, np.int64))
        if words_at:
            self._put(words_at, np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.uint32))
        for lo in range(0, len(plain), _JOIN):
            joined = " " + " ".join(plain[lo:lo + _JOIN])
            ids = np.array(self._whole([joined])[0], np.uint32)
            spans = np.fromiter(map(len, joined.encode().split(b" ")[1:]), np.int64) + 1
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(spans), "left") + 1
            self._put(plain_at[lo:lo + _JOIN], np.diff(at, prepend=0), ids)
        if heads:
            found = self._whole(heads)
            self._put(heads_at, np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32))
        if words:
            sizes = self.size.now[words]
            to = np.cumsum(sizes + 1)
            ids = np.empty(to[-1], np.uint32)
            ids[ragged(to - sizes - 1, sizes)] = self.flat.now[ragged(self.start.now[words], sizes)]
            ids[to - 1] = ends
            self._put(tails_at, sizes + 1, ids)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; nulls are empty texts."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        sizes, lo = pc.binary_length(texts).to_numpy(), 0
        while lo < len(texts):  # a longer text is a run of its own
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:lo + _RUN]), _RUN_BYTES, "right")))
            yield from self._encode(texts.slice(lo, hi - lo))
            lo = hi

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if len(self.slots) > self.keep:
            self._clear()
        parts = pc.split_pattern(texts, " ")
        bounds, words = parts.offsets.to_numpy(), parts.values
        words = words.slice(bounds[0], bounds[-1] - bounds[0])
        first, counts = bounds[:-1].astype(np.int64) - bounds[0], np.diff(bounds).astype(np.int64)
        coded = words.dictionary_encode()  # each different piece is looked up once
        slot = self.slots.__getitem__
        names = coded.dictionary
        at = np.fromiter(map(slot, names.to_numpy(False)), np.int64, len(names))[coded.indices.to_numpy()]
        at[first] = np.fromiter((slot(" " + w) for w in words.take(pa.array(first)).to_numpy(False)), np.int64, len(first))
        if self.slots.pending:
            self._learn()
        size, start = self.size.now[at], self.start.now[at]
        odd = np.minimum.reduceat(size, first) < 0
        if odd.any():
            size = np.where(np.repeat(odd, counts), 0, size)
        ids = self.flat.now[ragged(start, size)]
        ends = np.cumsum(np.add.reduceat(size, first))
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        begin = 0
        for o, e in zip(odd.tolist(), ends.tolist(), strict=True):
            yield np.array(next(whole), np.uint32) if o else ids[begin:e]
            begin = e


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _is_word(key: str) -> bool:
    """Letters alone, of scripts whose letters the library's pattern knows too."""
    return key.isalpha() and (key.isascii() or max(key) < "\u2000")


def _letters(word: str) -> str:
    """A word as byte-level vocabularies write it."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


_MADE: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _MADE:
        _MADE[path] = TextEncoder(path)
    return _MADE[path]
