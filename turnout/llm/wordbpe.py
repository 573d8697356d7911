"""Byte-pair encoding with word ends, by blocks of documents.

A block's words are made distinct first, so the merges run once a distinct word and block; they run on all of its words at
once, as numpy arrays.  Results equal those of the ``tokenizers`` library for a file of the kind of ``word_bpe_49k.json``
(NFC, lower case, white space dropped, end-of-word suffix, no decoder, special tokens matched in the raw text).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Longer words are merged one by one with a heap, as their number of rounds is not bounded.
LONG_WORD = 48
NEVER = np.int64(1 << 40)
SPACE, LETTER, DIGIT, OTHER = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point.  Code points that Unicode 3.2 lacks or classed otherwise are 255: libraries differ on them."""
    old, out = unicodedata.ucd_3_2_0.category, np.full(0x110000, OTHER, np.uint8)
    for c in range(0x80, 0x110000):
        kind = old(chr(c))
        if kind == "Cn" or kind[0] != unicodedata.category(chr(c))[0]:
            out[c] = 255
        elif kind[0] == "L":
            out[c] = LETTER
        elif kind[0] == "N":
            out[c] = DIGIT
    out[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    out[range(ord("0"), ord("9") + 1)] = DIGIT
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self._special_split = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in (*vocab.items(), *self.special.items()):
            self.tokens[number] = token
        self.token_bytes = [t.encode() for t in self.tokens]
        chars = byte_symbols()
        self.symbol_bytes = {c: b for b, c in enumerate(chars)}
        self.path = path
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pair = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        self._hashed(np.array([a << 20 | b for a, b in self.pair], np.int64), np.array([r for r, _ in self.pair.values()], np.int64))
        self.rank_merged = np.zeros(len(pairs), np.int64)
        for rank, merged in self.pair.values():
            self.rank_merged[rank] = merged

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer, for the few texts that need it."""
        return Tokenizer.from_file(self.path)

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _apart(self, text: str, special: bool) -> list[str]:
        """Words of a text that block splitting leaves out: one with special tokens, or characters libraries differ on."""
        if special and self._special_split:
            parts = self._special_split.split(text)
            if len(parts) > 1:
                return [w for part in parts for w in ([part] if part in self.special else self._apart(part, False))]
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.symbol_bytes[c] for c in w).decode("utf-8", "surrogateescape")
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] if normal else []

    def split_block(self, texts: list[str | None], special: bool = True) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
        """All words of the texts in a row, the number of words for each text, and which words are special tokens."""
        table = char_classes()
        odd: dict[int, list[str]] = {}
        plain = []
        for i, text in enumerate(texts):
            text = text or ""
            if special and "<|" in text and self._special_split.search(text):
                odd[i], text = self._apart(text, True), ""
            else:
                text = self._normal(text)
                if not text.isascii() and (table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == 255).any():
                    odd[i], text = self._apart(texts[i], False), ""
            plain.append(text)
        joined = "\n".join(plain) + "\n"
        chars = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
        del plain
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        wide = len(raw) != len(joined)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32) if wide else data
        del joined
        kind = table[codes]
        # A word starts where the class changes and at every digit; it ends where the next one starts or a space does.
        change = np.empty(len(kind) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[:-1] |= kind == DIGIT
        self._cut_contractions(codes, kind, change)
        edges = np.flatnonzero(change)
        starts, stops = edges[:-1], edges[1:]
        words = kind[starts] != SPACE
        starts, stops = starts[words], stops[words]
        counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(chars)]))
        if wide:
            width = np.ones(len(codes), np.int8)
            for limit in (0x80, 0x800, 0x10000):
                width += codes >= limit
            place = np.r_[0, np.cumsum(width, dtype=np.int64)]
            starts, stops = place[starts], place[stops]
        sizes = stops - starts
        ends = np.cumsum(sizes)
        packed = data[np.repeat(kind != SPACE, width) if wide else kind != SPACE]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(packed)])
        marks = np.zeros(len(column), bool)
        if odd:
            column, counts, marks = self._with_apart(column, counts, odd)
        return column, counts, marks

    def _cut_contractions(self, codes: np.ndarray, kind: np.ndarray, change: np.ndarray) -> None:
        """An apostrophe that starts a run of marks forms one word with the letters of a contraction after it."""
        at = np.flatnonzero(codes == ord("'"))
        at = at[change[at]]
        after = lambda i, k: np.where(i + k < len(codes), codes[np.minimum(i + k, len(codes) - 1)], 0)
        free = np.ones(len(at), bool)
        for ending in CONTRACTIONS:
            fits = free.copy()
            for k, c in enumerate(ending, 1):
                fits &= after(at, k) == ord(c)
            free &= ~fits
            hit = at[fits]
            change[hit + 1] = False
            change[hit + len(ending) + 1] = True

    def _with_apart(self, column: pa.LargeBinaryArray, counts: np.ndarray, odd: dict[int, list[str]]):
        """Puts the words of the texts that were split apart into their places."""
        upto, parts, marks, counts = np.r_[0, np.cumsum(counts)], [], [], counts.copy()
        last = 0
        for i, words in sorted(odd.items()):
            parts += [column.slice(upto[last], upto[i] - upto[last]), pa.array([w.encode("utf-8", "surrogateescape") for w in words], pa.large_binary())]
            marks += [np.zeros(upto[i] - upto[last], bool), np.array([w in self.special for w in words], bool)]
            counts[i], last = len(words), i
        parts.append(column.slice(upto[last]))
        marks.append(np.zeros(len(parts[-1]), bool))
        return pa.concat_arrays(parts), counts, np.concatenate(marks)

    def merge_long(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, with a heap over linked symbols."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        left, right, alive = [*range(-1, len(ids) - 1)], [*range(1, len(ids) + 1)], [True] * len(ids)
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < len(ids) and (found := self.pair.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = self.pair[a, b][1], False, right[j]
            if right[j] < len(ids):
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [ids[i] for i in range(len(ids)) if alive[i]]

    def _hashed(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open table of pairs at a load of a fifth or less, so that most look-ups end at the first slot."""
        self.bits = int(len(keys) * 5).bit_length()
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NEVER)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]
            won = free[self.slot_key[at[free]] == keys[free]]
            self.slot_rank[at[won]] = ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], NEVER)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[at[left]]
            same = held == key[left]
            out[left[same]] = self.slot_rank[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes ``data[start:start + size]``: all ids in a row, and the count for each word.

        Words are at least one byte long.  Each round merges the leftmost pair of lowest rank in every word that has one.
        """
        counts = np.zeros(len(starts), np.int64)
        long = np.flatnonzero(sizes > LONG_WORD)
        short = np.flatnonzero(sizes <= LONG_WORD)
        size = sizes[short]
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(short)), size)
        raw = data[np.repeat(starts[short] - first, size) + np.arange(int(size.sum()))]
        symbol = self.inner[raw]
        ends = first + size - 1
        symbol[ends] = self.final[raw[ends]]
        done_ids, done_words = [], []
        rank = np.full(len(symbol), NEVER)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank(symbol[:-1], symbol[1:]), NEVER)
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.r_[begin, len(word)])
            at = np.flatnonzero((rank == np.repeat(least, length)) & (rank < NEVER))
            if len(at):
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            over = np.repeat(least == NEVER, length)
            if over.any():
                done_ids.append(symbol[over])
                done_words.append(word[over])
            if not len(at):
                break
            symbol[at] = self.rank_merged[rank[at]]
            keep = ~over
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            for i in (moved, moved[moved > 0] - 1):
                j = np.minimum(i + 1, len(symbol) - 1)
                rank[i] = np.where((j > i) & (word[j] == word[i]), self._rank(symbol[i], symbol[j]), NEVER)
        ids = np.concatenate([*done_ids, np.zeros(0, np.int64)])
        of = short[np.concatenate([*done_words, np.zeros(0, np.int64)])]
        if len(long):
            apart = [self.merge_long(data[starts[w]:starts[w] + sizes[w]].tobytes()) for w in long]
            ids = np.concatenate([ids, *(np.array(a, np.int64) for a in apart)])
            of = np.concatenate([of, np.repeat(long, [len(a) for a in apart])])
        order = np.argsort(of, kind="stable")
        counts += np.bincount(of, minlength=len(starts))
        return ids[order], counts

    def encode_block(self, texts: list[str | None], lookup: Callable | None = None, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and the number of ids for each text; a null text has none.

        ``lookup(data, starts, sizes)`` may give the ids of known words: (known, ids, counts of the known).
        """
        words, per_text, marks = self.split_block(texts, special)
        if not len(words):
            return np.zeros(0, np.uint32), per_text
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary
        del words, coded
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        parts, counts = [], np.zeros(len(distinct), np.int64)
        place = np.zeros(len(distinct), np.int64)
        open_words = np.ones(len(distinct), bool)
        for i in np.unique(index[marks]):
            place[i], counts[i], open_words[i] = len(parts), 1, False
            parts.append(np.array([self.special[distinct[int(i)].as_py().decode()]], np.int64))
        base = sum(map(len, parts))
        if lookup is not None:
            todo = np.flatnonzero(open_words)
            known, ids, known_counts = lookup(data, starts[todo], sizes[todo])
            hit = todo[known]
            counts[hit], place[hit], open_words[hit] = known_counts, base + np.cumsum(known_counts) - known_counts, False
            parts.append(ids)
            base += len(ids)
        todo = np.flatnonzero(open_words)
        ids, own = self.merge(data, starts[todo], sizes[todo])
        counts[todo], place[todo] = own, base + np.cumsum(own) - own
        parts.append(ids)
        pool = np.concatenate(parts).astype(np.uint32)
        take = counts[index]
        ends = np.cumsum(take)
        flat = pool[np.repeat(place[index] - (ends - take), take) + np.arange(int(ends[-1]))]
        upto = np.r_[0, ends][np.r_[0, np.cumsum(per_text)]]
        return flat, np.diff(upto)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by one space, in UTF-8; ids outside the vocabulary are left out."""
        known = self.token_bytes
        return b" ".join([known[i] for i in ids.tolist() if i < len(known)])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One tokenizer for each Python worker."""
    return WordBpe(path)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``most`` bytes together; a larger row is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_blocks(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, stop, texts) of a batch, a few MB at a time, so a worker's memory does not follow the batch."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int32)
    for start, stop in slices(sizes, most):
        yield start, stop, texts.slice(start, stop - start).to_pylist()
