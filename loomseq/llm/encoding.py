"""Whole-text tokenisation with the ``tokenizers`` library, without encoding a repeated word twice.

A text is cut at white space into chunks that the tokenizer's own pre-tokeniser can never join, each chunk is
encoded once per worker, and a text's ids are gathered from the ids of its chunks, which are known by 64 bits of hash.
Chunks of letters alone, most of them, go to the tokenizer's own model without its normaliser and pre-tokeniser, whose
result for letters is known. The outcome is the library's own for the whole text (tests compare the two); a tokenizer
whose pre-tokeniser isn't one of the two known forms is called on whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from loomseq.llm.textnp import LOWER, hash_spans, spans

#: What the Unicode class ``\s`` holds for the library; Python's own class has five more characters.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of white space beyond ASCII, and of characters that only Python takes for white space: such texts are cut as text.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WORDS = re.compile(f"[^{_WS}]+")
#: A run of white space but for its last character, or a word with at most one space before it, or one white space.
_SPACED = re.compile(f"[{_WS}]+(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]")
_TAIL = ".,"
#: Entries after which a worker's cache starts anew, so that its memory stays bounded.
CACHE_ENTRIES = 1_500_000
_JOINED = 1000
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
#: The letter that a byte-level vocabulary writes for each byte: itself if it can be printed, else the next free one from U+0100 on.
_LETTER = {b: (b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}


class Encoder:
    """``encode(texts) -> (ids, offsets)``: uint32 ids of all texts in a row, and where each text's ids begin."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_entries = cache_entries
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = "whole"
        if spec["model"]["type"] == "BPE" and not any(re.search(rf"[{_WS}]", t) for t in self.specials):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
                self.kind, self.mark, self.cut = "spaced", "\n", _SPACED.findall
            elif pre.get("type") == "Sequence" and [n.get("type") for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.kind, self.mark, self.cut = "words", "\x01", _WORDS.findall
        if self.kind != "whole":
            self.plain = Tokenizer(Tokenizer.from_file(path).model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.plain_mark = chr(_LETTER[1])
            got, own = self._ids(self.tokenizer, self.mark), self._ids(self.plain, self.plain_mark)
            if len(got) != 1 or len(own) != 1:
                self.kind = "whole"
            else:
                self.mark_id, self.plain_mark_id = got[0], own[0]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, chunk: str) -> str | None:
        """A chunk of letters, with at most a space before them, as the model takes it after normaliser and pre-tokeniser; None for others."""
        word = chunk[1:] if self.kind == "spaced" and chunk[:1] == " " else chunk
        if not word.isalpha():
            return None
        if self.kind == "words":
            if word.isascii():
                return word.lower()
            word = unicodedata.normalize("NFC", word)
            if "\u03a3" in word:  # Python's lower case of a last sigma looks at its place
                return None
            word = word.lower()
            if not word.isalpha():
                return None
        out = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER)
        return chr(_LETTER[32]) + out if len(word) != len(chunk) and self.kind == "spaced" else out

    def _ends_in_letter(self, head: str) -> bool:
        """Whether the last character is a letter after the normaliser too: some letters, such as a capital I with a dot, lower-case or decompose to a letter and a mark, which the library joins to punctuation after it."""
        if self.kind == "words" and not head.isascii():
            head = unicodedata.normalize("NFC", head)[-1:].lower()
        return head[-1:].isalpha()

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and each one's start and length; many in one call, where the mark's id tells where one ends."""
        starts, lens = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        flat, size = [np.zeros(0, np.uint32)], 0
        letters, sure, odd = ([], []), ([], []), []
        for i, c in enumerate(chunks):
            if (x := self._letters(c)) is not None:
                letters[0].append(i)
                letters[1].append(x)
            elif self.mark in c or "<|" in c or c.isspace():
                odd.append(i)
            else:
                sure[0].append(i)
                sure[1].append(c)
        for (which, texts), tokenizer, glue, mark in ((letters, self.plain, f" {self.plain_mark} ", self.plain_mark_id), (sure, self.tokenizer, self.mark if self.kind == "spaced" else f" {self.mark} ", self.mark_id)):
            joined = [glue.join(texts[k : k + _JOINED]) for k in range(0, len(which), _JOINED)]
            for k, e in enumerate(tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                own = which[k * _JOINED : (k + 1) * _JOINED]
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(ids == mark)
                if len(ends) != len(own) - 1:
                    odd += own
                    continue
                first = np.concatenate([[0], ends + 1])
                starts[own] = size + first
                lens[own] = np.concatenate([ends, [len(ids)]]) - first
                flat.append(ids)
                size += len(ids)
        for i in odd:
            ids = np.array(self._ids(self.tokenizer, chunks[i]), np.uint32)
            starts[i], lens[i] = size, len(ids)
            flat.append(ids)
            size += len(ids)
        return np.concatenate(flat), starts, lens

    def _learn(self, new: list[str]) -> None:
        """Append the ids of new chunks to the cache. A chunk's last full stops and commas are encoded apart from a letter before them, as the library does."""
        base: dict[str, int] = {}
        heads, tails = [], []
        put = base.setdefault
        for c in new:
            head = c.rstrip(_TAIL)
            tail = ""
            if len(head) != len(c):
                if self._ends_in_letter(head):
                    tail = c[len(head) :]
                else:
                    head = c
            heads.append(put(head, len(base)))
            tails.append(put(tail, len(base)) if tail else -1)
        ids, starts, lens = self._each(list(base))
        starts, lens = np.append(starts, 0), np.append(lens, 0)  # -1: no tail
        at = np.stack([np.array(heads, np.int64), np.array(tails, np.int64)], 1).ravel()
        size = lens[at]
        ends = np.cumsum(size)
        flat = ids[np.arange(int(ends[-1])) + np.repeat(starts[at] - (ends - size), size)]
        old = len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.lens = np.concatenate([self.lens, size.reshape(-1, 2).sum(1)])
        self.starts = np.concatenate([self.starts, old + (ends - size)[::2]])

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each chunk's place in the cache, after new ones are learnt."""
        h = hash_spans(LOWER[data] if self.kind == "words" else data, starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != uniq[inside]
        if new.any():
            raw = data.tobytes()
            n = len(self.starts)
            self._learn([raw[starts[i] : ends[i]].decode() for i in first[new]])
            slots = np.arange(n, len(self.starts))
            self.slots = np.insert(self.slots, at[new], slots)
            self.hashes = np.insert(self.hashes, at[new], uniq[new])
            at = np.searchsorted(self.hashes, uniq)
        return self.slots[at][inverse]

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the chunks of texts without odd white space, in order. One full stop or comma after an ASCII letter is a chunk of its own, so words before it are learnt once."""
        starts, ends, of = spans(data, offsets)
        dot = (data[ends - 1] == 46) | (data[ends - 1] == 44)
        before = data[np.maximum(ends - 2, 0)] | 32
        dot &= (ends - starts > 1) & (before >= 97) & (before <= 122)
        if self.kind == "words":
            return self._in_order((starts, ends - dot, of), (ends[dot] - 1, ends[dot], of[dot]))
        n = len(offsets) - 1
        before = np.concatenate([[0], ends[:-1]])[: len(starts)]
        gap = np.maximum(before, offsets[of])  # white space before a word begins here
        space = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 32)
        other = (starts > gap) & ~space
        long = starts - gap >= 2
        last = np.full(n, -1)
        last[of] = np.arange(len(of))
        tail = np.where(last >= 0, ends[last] if len(ends) else 0, offsets[:-1])  # and after the last one here
        rest = np.flatnonzero(offsets[1:] > tail)
        return self._in_order(
            (starts - space, ends - dot, of),
            (ends[dot] - 1, ends[dot], of[dot]),
            (gap[long], starts[long] - 1, of[long]),
            (starts[other] - 1, starts[other], of[other]),
            (tail[rest], offsets[1:][rest], rest),
        )

    @staticmethod
    def _in_order(*parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(a, kind="stable")
        return a[order], b[order], t[order]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts in UTF-8 that lie in a row, text i from ``offsets[i]`` on."""
        n = len(offsets) - 1
        raw = data.tobytes()
        if self.kind == "whole":
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
        if len(self.starts) > self.cache_entries:
            self._clear()
        odd = sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in _ODD.finditer(raw)})
        starts, ends, of = self._chunks(data, offsets)
        if odd:
            good = ~np.isin(of, odd)
            starts, ends, of = starts[good], ends[good], of[good]
        at = self._known(data, starts, ends)
        if odd:
            more, texts = [], []
            for i in odd:
                own = [c.encode() for c in self.cut(raw[offsets[i] : offsets[i + 1]].decode())]
                bounds = np.concatenate([[0], np.cumsum([len(c) for c in own])]).astype(np.int64)
                more.append(self._known(np.frombuffer(b"".join(own), np.uint8), bounds[:-1], bounds[1:]))
                texts.append(np.full(len(own), i))
            at, of = np.concatenate([at, *more]), np.concatenate([of, *texts])
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
        lens, begins = self.lens[at], self.starts[at]
        upto = np.cumsum(lens)
        pick = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begins - (upto - lens), lens)
        return self.flat[pick], np.concatenate([[0], np.cumsum(np.bincount(of, lens, n))]).astype(np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        own = [(t or "").encode() for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file, kept from task to task while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
