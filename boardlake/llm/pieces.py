"""Subword encoding and decoding with a SentencePiece vocabulary: shared-prefix Viterbi.

A text is marked as the library does (a leading mark, blanks as marks) and falls into marked words, as no piece goes on with
a mark after another character. The distinct new words of a batch, sorted, are the paths of a trie. It is walked from the root
on, all nodes of a depth at once as arrays: a prefix that words share is one node and has one forward state. An automaton of all
pieces names the pieces that end at a node, so a node costs one step and as many sums as such pieces. A word of LONG characters
or more is walked alone.

The vocabulary is one of merges: the library joins the two neighbours whose piece ranks first until none are left. Its result is
the one path along which no two neighbouring pieces would have been cut otherwise: joining their characters alone by rank gives
the same two pieces. So a prefix has one forward state, the last piece of its path (every other path scores minus infinity), and
a node takes the one ending piece that agrees with the state at its beginning. A character without a piece is never joined and
is written as its bytes. Vocabularies in which a piece goes on with a mark are walked text by text. Words already met by a
worker are not walked again, as long as their characters stay under KEPT_CHARS.

Null texts give null ids, empty texts no ids. Repeated rows encode alike. An empty table gives no rows. Decoding ids gives the
text back, where it holds no mark of its own; ids outside the vocabulary are left out. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from boardlake.llm.base import pieces as runs, query, ragged, table

MARK = "▁"
#: Characters of words that a worker remembers, links of the automaton that it adds, pairs of pieces whose agreement it remembers.
KEPT_CHARS, LEARNT, PAIRS = 5_000_000, 200_000, 400_000
#: Characters of texts that are encoded at a time.
_RUN = 2_000_000
#: Numbers a pair of a piece or character and a piece: above any code point.
_WIDE = 1 << 22
#: Longer words are walked one by one; so many others are walked at once.
LONG, _WALK = 48, 50_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Automaton:
    """Aho-Corasick automaton: ends[state] lists (length, id) of the pieces that end there, the longest first."""

    def __init__(self, words: list[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for word, i in words:
            state = 0
            for ch in word:
                state = self.next[state].setdefault(ch, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.ends.append([])
            self.ends[state].append((len(word), i))
        self.fail, self.learnt = [0] * len(self.next), 0
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for ch, to in self.next[state].items():
                queue.append(to)
                self.fail[to] = self.step(self.fail[state], ch) if state else 0
                self.ends[to] += self.ends[self.fail[to]]

    def step(self, state: int, ch: str) -> int:
        while (to := self.next[state].get(ch)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to

    def learn(self, state: int, ch: str) -> int:
        """step by way of the fail links, remembered as a link of its own for LEARNT pairs."""
        to = self.step(state, ch)
        if self.learnt < LEARNT:
            self.learnt += 1
            self.next[state][ch] = to
        return to


class Remembered:
    """Numbers by key (from 0 on), for arrays of keys at once: open addressing in two arrays, at most half full."""

    def __init__(self, room: int):
        self.room, self.bits = room, (2 * room).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for those that are not there."""
        at, out = self._place(keys), np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            met = self.keys[at]
            hit = met == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (met >= 0)
            left, at = left[on], at[on] + 1 & len(self.keys) - 1
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there; all are forgotten when more than room would be there."""
        if self.rows + len(keys) > self.room:
            self.clear()
            keys, values = keys[:self.room], values[:self.room]
        self.rows += len(keys)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & len(self.keys) - 1


class Merges:
    """How pieces come about: rank (lower first) of each piece's text, and the pieces along both edges of each."""

    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        self.left: dict[str, list[str]] = {}
        self.right: dict[str, list[str]] = {}

    def parts(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """(pieces that text is joined to, the last two joined)."""
        now, last = list(text), None
        while len(now) > 1:
            best, at = min((self.rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)))
            if best == np.inf:
                break
            last = now[at], now[at + 1]
            now[at:at + 2] = [now[at] + now[at + 1]]
        return now, last

    def edge(self, piece: str, side: int) -> list[str]:
        """The pieces that stand at one end of a piece while it comes about, the character first."""
        known = (self.left, self.right)[side]
        if piece not in known:
            last = self.parts(piece)[1]
            known[piece] = [piece] if last is None else [*self.edge(last[side], side), piece]
        return known[piece]

    def agree(self, a: str, b: str) -> bool:
        """Would a followed by b be joined to just these two? True unless a join across comes before what ends either edge."""
        left, right, rank = self.edge(a, 1), self.edge(b, 0), self.rank.get
        i = j = 0
        while True:
            next_left = rank(left[i + 1]) if i + 1 < len(left) else np.inf
            next_right = rank(right[j + 1]) if j + 1 < len(right) else np.inf
            across = rank(left[i] + right[j])
            if across is not None and across < next_left and across <= next_right:  # of equal joins the left one comes first
                return False
            if next_left == next_right == np.inf:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class PieceTable:
    """Texts of the pieces: all that decoding needs."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        self.plain = [i for i in range(size) if not (i in self.silent or i in self.byte_of or sp.is_unused(i))]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode("utf-8") for i, t in enumerate(self.texts)]
        self.written = np.array([i not in self.silent for i in range(size)] + [False, False])  # none for ids past the end, and -1
        self.rank = {self.texts[i]: -sp.get_score(i) for i in self.plain}

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined to characters, marks as blanks, the leading mark dropped; control and unknown ids skipped."""
        if len(ids) and self.written[np.clip(ids, -1, len(self.texts))].all():
            return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")
        out, held = [], bytearray()  # a silent id ends a run of bytes
        for i in ids.tolist():
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if 0 <= i < len(self.texts) and i not in self.silent:
                out.append(self.texts[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ").removeprefix(" ")


class PieceEncoder(PieceTable):
    def __init__(self, path: str):
        super().__init__(path)
        self.merges = Merges(self.rank)
        # a piece that joining its characters doesn't give is in no text's path; a single character has nothing to join
        self.automaton = Automaton([(self.texts[i], i) for i in self.plain if len(self.merges.parts(self.texts[i])[0]) == 1])
        self.split = not any(re.search(f"[^{MARK}]{MARK}", self.texts[i]) for i in self.plain)
        self.known: dict[str, int] = {}
        self.agreed, self.pairs = Remembered(PAIRS), {}
        self._arrays()
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat, self.start, self.size, self.chars = array("i"), array("q"), array("q"), 0

    def _arrays(self) -> None:
        """The automaton for many words at once: links by state and character, fail links, pieces that end at each state."""
        a = self.automaton
        chars = sorted({ch for links in a.next for ch in links})
        self.char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.char[[ord(ch) for ch in chars]] = np.arange(1, len(chars) + 1)
        self.links = Remembered(len(a.next))
        rows = [(state * _WIDE + int(self.char[ord(ch)]), to) for state, links in enumerate(a.next) for ch, to in links.items()]
        self.links.put(*np.array(rows, np.int64).reshape(-1, 2).T)
        self.fail = np.array(a.fail, np.int64)
        self.n_ends = np.array([len(x) for x in a.ends], np.int64)
        self.first_end = np.cumsum(self.n_ends) - self.n_ends
        self.end_size, self.end_id = np.array([x for ends in a.ends for x in ends], np.int64).reshape(-1, 2).T

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Automaton.step of many states."""
        state, left = state.copy(), np.arange(len(state))
        while len(left):
            to = self.links.get(state[left] * _WIDE + char[left])
            done = (to >= 0) | (state[left] == 0)
            state[left] = np.where(done, np.maximum(to, 0), self.fail[state[left]])
            left = left[~done]
        return state

    def _text(self, i: int) -> str:
        return self.texts[i] if i < len(self.texts) else chr(i - len(self.texts))

    def _agree(self, front: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merges.agree of pieces or characters and pieces, remembered."""
        keys = front.astype(np.int64) * _WIDE + piece
        out = self.agreed.get(keys)
        if len(new := np.flatnonzero(out < 0)):
            fresh, where = np.unique(keys[new], return_inverse=True)
            found = np.array([self.merges.agree(self._text(k // _WIDE), self.texts[k % _WIDE]) for k in fresh.tolist()], np.int32)
            self.agreed.put(fresh, found)
            out[new] = found[where]
        return out > 0

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's ids) of words, which are sorted: a walk of their trie, all nodes of a depth at once.

        Nodes of a depth are the words that don't share so long a prefix with the word before; the others take over its node.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        depth = int(size.max(initial=0))
        codes = np.array(words, f"U{max(depth, 1)}").view(np.uint32).reshape(len(words), -1)
        same = np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1).sum(axis=1)
        shared = np.minimum(np.append(0, same), np.minimum(size, np.append(0, size[:-1])))
        # by depth and word: last piece (len(texts) + code point: a character without one) and its length
        last, length = np.zeros((depth + 1, len(words)), np.int32), np.zeros((depth + 1, len(words)), np.int16)
        state = np.zeros(len(words), np.int64)
        for d in range(1, depth + 1):
            on = size >= d
            own = on & (shared < d)
            at = np.flatnonzero(own)
            code = codes[at, d - 1]
            here = self._step(state[at], self.char[code])
            i, n = (len(self.texts) + code).astype(np.int32), np.ones(len(at), np.int16)
            left, k = np.flatnonzero(self.n_ends[here] > 0), 0
            while len(left):  # the longest ending piece first
                end = self.first_end[here[left]] + k
                piece, span = self.end_id[end], self.end_size[end]
                fits = span == d
                inner = np.flatnonzero(~fits)
                fits[inner] = self._agree(last[d - span[inner], at[left[inner]]], piece[inner])
                i[left[fits]], n[left[fits]] = piece[fits], span[fits]
                k += 1
                left = left[~fits & (self.n_ends[here[left]] > k)]
            node, all_on = np.cumsum(own)[on] - 1, np.flatnonzero(on)
            last[d, all_on], length[d, all_on], state[all_on] = i[node], n[node], here[node]
        back, at, word = [], size.copy(), np.flatnonzero(size)
        while len(word):
            back.append((word, last[at[word], word]))
            at[word] -= length[at[word], word]
            word = word[at[word] > 0]
        counts = np.zeros(len(words), np.int64)
        for word, _ in back:
            counts[word] += 1
        end, flat = np.cumsum(counts), np.zeros(int(counts.sum()), np.int64)
        for k, (word, i) in enumerate(back, 1):
            flat[end[word] - k] = i
        return self._spell(flat, counts)

    def walk(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """viterbi of one long word, node by node."""
        links, learn, ends, known = self.automaton.next, self.automaton.learn, self.automaton.ends, self.pairs
        last, sizes, here = [-1], [0], 0
        for ch in word:
            to = links[here].get(ch)
            here = learn(here, ch) if to is None else to
            for length, i in ends[here]:
                front = last[-length]
                if front < 0:
                    break
                ok = known.get((front, i))
                if ok is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    ok = known[front, i] = self.merges.agree(self._text(front), self.texts[i])
                if ok:
                    break
            else:
                length, i = 1, len(self.texts) + ord(ch)
            last.append(i)
            sizes.append(length)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= sizes[at]
        return self._spell(np.array(out[::-1], np.int64), np.array([len(out)]))

    def _spell(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their bytes."""
        strange = np.flatnonzero(flat >= len(self.texts))
        if not len(strange):
            return flat.astype(np.int32), counts
        spelled = [[self.bytes[b] for b in self._text(i).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                   for i in flat[strange].tolist()]
        wide = np.ones(len(flat), np.int64)
        wide[strange] = [len(x) for x in spelled]
        ends = np.cumsum(wide)
        out = np.repeat(flat, wide).astype(np.int32)
        out[ragged(ends[strange] - wide[strange], wide[strange])] = list(chain.from_iterable(spelled))
        return out, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])

    def marked(self, text: str) -> list[str]:
        """The marked words of a text, each without the mark that it begins with."""
        if not text:
            return []
        if not self.split:
            return [text.replace(" ", MARK)]
        if text[0] != " " != text[-1] and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for lo, hi in runs(texts, _RUN):
            yield from self._encode([self.marked(t) for t in texts[lo:hi]])

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start.frombytes((len(self.flat) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
        self.size.frombytes(counts.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.chars += sum(map(len, words)) + len(words)

    def _encode(self, words: list[list[str]]) -> Iterator[np.ndarray]:
        if self.chars > KEPT_CHARS:
            self._clear()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        own = dict.fromkeys(chain.from_iterable(words))  # small enough to be looked up fast
        fresh = [w for w in own if w not in self.known]
        short = sorted(w for w in fresh if len(w) < LONG)
        for lo in range(0, len(short), _WALK):
            self._keep(short[lo:lo + _WALK], *self.viterbi([MARK + w for w in short[lo:lo + _WALK]]))
        for w in fresh:
            if len(w) >= LONG:
                self._keep([w], *self.walk(MARK + w))
        own.update(zip(own, map(self.known.__getitem__, own)))
        at = np.fromiter(map(own.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if not len(at):
            yield from (np.empty(0, np.int32) for _ in words)
            return
        starts, sizes = np.frombuffer(self.start, np.int64)[at], np.frombuffer(self.size, np.int64)[at]
        ids = np.frombuffer(self.flat, np.int32)[ragged(starts, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        for a, b in zip(ends, ends[1:], strict=False):
            yield ids[a:b]


_MADE: dict[tuple[type, str], PieceTable] = {}


def _made(kind: type, path: str) -> PieceTable:
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def piece_encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    return _made(PieceEncoder, path)


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns named in keep, and ids (array<int>)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, batch.num_columns - 1):
                found = list(piece_encoder(path).encode([t or "" for t in texts]))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), lists], names=[*names, "_ids"])

    names = [f"_k{i}" for i in range(len(keep))]
    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    chosen = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), F.col(text_col).alias("_text"))
    coded = chosen.mapInArrow(run, ", ".join([*fields, "_ids array<int>"]))
    return coded.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("_ids").alias("ids"))


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of a batch with about 4 MB of text, and their texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)) // 4_000_000
    edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = batch.slice(lo, hi - lo)
        yield part, part.column(text).to_pylist()


def decode(path: str):  # noqa: ANN201
    """Column function: the text of an array of ids; null ids are left out."""
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        e = _made(PieceTable, path)
        return pa.array([e.decode(x.values.drop_null().to_numpy()) if x.is_valid else None for x in ids], pa.string())

    return text


@query("op3_piece_viterbi")
def op3_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, their crc32, and whether decoding them gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = piece_encoder(path)
        for batch in batches:
            for part, texts in _parts(batch, 1):
                n, crc, same = [], [], []
                for t, ids in zip(texts, e.encode([t or "" for t in texts]), strict=True):
                    n.append(len(ids))
                    crc.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                    same.append(e.decode(ids) == (t or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=names)

    names = ["doc_id", "n_ids", "ids_crc32", "text_matches"]
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, text_matches boolean")
