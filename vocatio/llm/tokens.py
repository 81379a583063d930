"""Exact token ids of the public tokenizers, one encode call per distinct piece of text.

Both vocabularies pre-split at white space, so the ids of a text are the ids of its pieces in
order.  A batch's pieces are cut and numbered by Arrow; each Python worker keeps the ids of the
pieces it has met (bounded) in flat arrays, hands only new ones to the tokenizers library, and puts
a text's ids together by one gather.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' patterns see it (Unicode White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
#: A run of other characters with one blank before it, white space up to the last one before
#: other characters, or that last one.
_SPACED = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: What keeps a text from being cut at single blanks and newlines alone: other white space (and NUL,
#: which marks exact pieces), white space next to white space, and white space at an end.
_UNEVEN = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Signs that are a token run of their own after a letter; the apostrophe is not one of them.
_SIGNS = ".,;:!?&%$#*|<>()[]{}/\\+=-_\"@^~`"
#: Words that normalizers leave as they are and patterns do not cut, where case does not count.
_LOWER = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: Pieces a worker remembers, words in one call, and bytes of text worked on at once.
MAX_PIECES, WORDS_A_CALL, BATCH = 900_000, 500, 16 << 20

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, keeps_space: bool) -> "Encoder":
    """The worker's encoder for the vocabulary file at ``path``."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = Encoder(path, keeps_space)
    return _encoders[path, keeps_space]


def _strings(column: pa.StringArray) -> list[str]:
    """The column's values; joined and split, which is many times faster than one by one."""
    if not len(column) or pc.any(pc.match_substring(column, "\x01")).as_py():
        return column.to_pylist()
    whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    return pc.binary_join(whole, "\x01")[0].as_py().split("\x01")


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``BATCH`` bytes of the column ``text``."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes, dtype=np.int64) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for at, to in zip(cuts, cuts[1:]):
        if to > at:
            yield batch.slice(at, to - at)


class Encoder:
    """``keeps_space``: the vocabulary encodes white space (byte level); else it drops it, and case
    with it.

    A key is a piece of text.  Where white space counts, a word after a blank is its own key, and
    NUL stands before any other piece."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # words of a-z (and A-Z, where case counts) need no normalizing and no pattern; neither do those of
        # ``_LOWER`` where it does not, once their bytes are spelled as the vocabulary spells them
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): spelled(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.keeps_space = keeps_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.edge = np.zeros(size, bool)  # ids that open a word after a blank, or that end a word
        for token, n in self.tokenizer.get_vocab().items():
            self.edge[n] = token.startswith("Ġ") if keeps_space else token.endswith("</w>")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids if keeps_space else []
        self.exact = "\0" if keeps_space else ""
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # key to its row
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, self.dtype)  # the rows' ids
        self.used = 0

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember ``keys``, whose ids follow each other in ``ids``."""
        n, k = len(self.index), len(keys)
        while n + k > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + k] = sizes
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.index.update(zip(keys, range(n, n + k)))

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after the other, and the size of each."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, self.dtype)
        for at in range(0, len(rows), 1 << 18):
            size, end = sizes[at : at + (1 << 18)], ends[at : at + (1 << 18)]
            low, high = end[0] - size[0], end[-1]
            place = np.repeat(self.start[rows[at : at + (1 << 18)]] - (end - size), size) + np.arange(low, high)
            out[low:high] = self.flat[place]
        return out, sizes

    def _learn_words(self, keys: list[str]) -> None:
        """Encode new keys that are one word of letters each, many in one call: edge ids tell a word
        from its neighbours."""
        exact = [key for key in keys if key[0] == "\0"]  # words without a blank before them
        spaced = [key for key in keys if key[0] != "\0"] if exact else keys
        for some, plain in ((spaced, False), (exact, True)):
            fits = str.isascii if self.keeps_space else _LOWER.fullmatch
            simple, other = [], []
            for key in some:
                (simple if fits(key) else other).append(key)
            for tokenizer, those in ((self.of_words, simple), (self.tokenizer, other)):
                # byte-level vocabularies write the blank before a word, and the newline, as letters
                bare = tokenizer is self.of_words
                before = ("Ċ " if bare else "\n") if plain else "Ġ" if bare else " "
                glue = " " + before if bare and self.keeps_space else before
                before, glue = (before, glue) if self.keeps_space else ("", " ")
                groups = [those[k : k + WORDS_A_CALL] for k in range(0, len(those), WORDS_A_CALL)]
                for at in range(0, len(groups), 100):
                    texts = [before + glue.join([key[1:] for key in g] if plain else g) for g in groups[at : at + 100]]
                    if bare and not self.keeps_space:
                        texts = [text.translate(self.letters) for text in texts]
                    for group, got in zip(groups[at : at + 100], tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                        self._cut(group, np.array(got.ids, self.dtype), plain)

    def _cut(self, group: list[str], ids: np.ndarray, plain: bool) -> None:
        if plain:
            edges = np.flatnonzero(ids == self.newline[0])
            sizes = np.diff(np.append(edges, len(ids))) - 1
            ids = ids[ids != self.newline[0]]
        else:
            edges = np.flatnonzero(self.edge[ids])
            sizes = np.diff(np.append(edges, len(ids))) if self.keeps_space else np.diff(edges, prepend=-1)
        if len(edges) == len(group):
            self._add(group, ids, sizes)
        else:
            self._learn_others(group)

    def _learn_others(self, keys: list[str]) -> None:
        """Encode new keys of any kind, each by itself."""
        for at in range(0, len(keys), 20_000):
            some = keys[at : at + 20_000]
            texts = some
            if self.keeps_space:
                texts = [key[1:] if key[0] == "\0" else " " + key for key in some]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.array([i for ids in got for i in ids], self.dtype)
            self._add(some, flat, np.array([len(ids) for ids in got], np.int64))

    def _parts(self, key: str) -> list[str] | None:
        """The keys that make up ``key``, if it is a word of letters with a newline before or signs
        behind it."""
        word = key.rstrip(_SIGNS)
        signs = [self.exact + key[len(word) :]] if len(word) < len(key) else []
        if word.isalpha() and (word.isascii() or self.keeps_space or normalize("NFC", word).lower().isalpha()):
            return [word, *signs]
        if self.keeps_space and key[0] in "\0\n":
            first = ["\0\n"] if key[0] == "\n" else []
            if word[1:].isalpha():
                return [*first, "\0" + word[1:], *signs]
            if first:
                return [*first, "\0" + key[1:]]
        return None

    def _learn(self, keys: list[str]) -> None:
        words, others, parted = [], [], {}
        for key in keys:
            if key.isalpha():
                words.append(key)
            elif not key:
                others.append(key)
            elif parts := self._parts(key):
                if parts == [key]:
                    words.append(key)
                else:
                    parted[key] = parts
            else:
                others.append(key)
        if parted:
            new = {p for parts in parted.values() for p in parts}.difference(self.index, words, others)
            for p in new:
                (words if p.lstrip("\0").isalpha() else others).append(p)
        self._learn_words(words)
        self._learn_others(others)
        if parted:
            counts = np.array([len(parts) for parts in parted.values()], np.int64)
            rows = np.array([self.index[p] for parts in parted.values() for p in parts], np.int64)
            ids, sizes = self._gather(rows)
            self._add(list(parted), ids, np.add.reduceat(sizes, np.cumsum(counts) - counts))

    def _rows(self, pieces: pa.StringArray) -> np.ndarray:
        """The row of each piece."""
        coded = pieces.dictionary_encode()
        keys = _strings(coded.dictionary)
        rows = np.array(list(map(self.index.get, keys, repeat(-1))), np.int64)
        if (at := np.flatnonzero(rows < 0)).size:
            new = [keys[i] for i in at.tolist()]
            self._learn(new)
            rows[at] = list(map(self.index.__getitem__, new))
        return rows[coded.indices.to_numpy()] if keys else np.zeros(0, np.int64)

    def _pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts, and the number of each text's."""
        if not self.keeps_space:
            special = pc.match_substring(texts, "<|")
            cut = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
            return cut.flatten(), np.diff(cut.offsets.to_numpy())
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for s in self.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, s))
        uneven = pc.or_(uneven, pc.equal(texts, ""))
        even = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
        cut = pc.split_pattern(even, " ")
        if not (at := np.flatnonzero(uneven.to_numpy(zero_copy_only=False))).size:
            return cut.flatten(), np.diff(cut.offsets.to_numpy())
        lists = []
        for text in texts.take(pa.array(at)).to_pylist():
            whole = any(s in text for s in self.special)
            lists.append(["\0" + text] if whole else ["\0" + p for p in _SPACED.findall(text)])
        more = pa.array(lists, pa.list_(pa.string()))
        place = np.arange(len(texts))
        place[at] = len(texts) + np.arange(len(at))
        cut = pa.concat_arrays([cut, more]).take(pa.array(place))
        return cut.flatten(), np.diff(cut.offsets.to_numpy())

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end``, and the size of each,
        with it.  Null counts as empty."""
        if len(self.index) > MAX_PIECES:
            self._forget()
        pieces, counts = self._pieces(texts.fill_null(""))
        ids, sizes = self._gather(self._rows(pieces))
        before = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.concatenate([[0], np.cumsum(counts)])
        per = np.diff(before[cuts]) + 1
        out = np.full(len(ids) + len(per), end, self.dtype)
        own = np.ones(len(out), bool)
        own[np.cumsum(per) - 1] = False
        out[own] = ids
        return out, per
