"""Exact encoding with memory: texts are cut where no token can span, and pieces seen before are looked up."""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

from unicodedata import normalize  # noqa: E402

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: White space beyond ASCII's and what str.split cuts at though tokenizers may not.
UNUSUAL = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A stop or comma inside a run of punctuation, or a character whose normal form takes more than lower case.
ENTANGLED = re.compile(r"[^\w\s][.,]|_[.,]|[\u0130\u0250-\U0010ffff]")
PLAIN_CUT = re.compile("[ \t\n\x0b\x0c\r]+")

#: Byte-level alphabet: printable bytes stand for themselves, the others, in order, for U+0100 and on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_open: dict[tuple, object] = {}


def opened(kind: type, path: str):
    """One encoder per worker process; its memory lasts over tasks."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]


def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """For vocabularies that drop white space and never join over it: ids as little-endian unsigned
    32-bit bytes. Words are runs without white space; each is encoded once and remembered, up to
    `most` of them (then all are forgotten, so memory is bounded)."""

    def __init__(self, path: str, most: int = 1_200_000):
        self.tokenizer, self.most = load(path), most
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str], used: set[str]) -> None:
        """Letters of known normal form are one pre-token and go to the model straight."""
        if len(self.words) + len(words) > self.most:
            self.words.clear()
            words = list(used)
        known, odd, tokenize = self.words, [], self.tokenizer.model.tokenize
        for w in words:
            if w.isalpha() and (w.isascii() or (max(w) < "\u0250" and "\u0130" not in w)):
                shown = w.lower() if w.isascii() else normalize("NFC", w).lower().encode().decode("latin-1").translate(BYTE_LEVEL)
                known[w] = np.array([t.id for t in tokenize(shown)], "<u4").tobytes()
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        """Runs without white space; in plain texts lower case, and cut before each stop and comma, where a pre-token begins."""
        if UNUSUAL.search(text):
            return PLAIN_CUT.split(text)
        if ENTANGLED.search(text):
            return text.split()
        return text.lower().replace(".", " .").replace(",", " ,").split()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        used = set().union(*split) - {""}
        self._learn(list(used - self.words.keys()), used)
        self.words[""] = b""
        look = self.words.__getitem__
        return [b"".join(map(look, ws)) for ws in split]


class ChunkEncoder:
    """Byte-level BPE with content-defined chunks. A rolling hash over the last eight bytes sets chunk
    ends, so copies and shared passages fall into equal chunks wherever they stand; a chunk is
    encoded once and looked up from then on. Tokens may span chunk ends, so each join is repaired: text
    from the last place in the left chunk to the first in the right chunk that no token
    can span (white space after something else) is encoded anew and takes the place of both ends. A chunk without such a place
    is all seam and widens the repair to the next one, until both sides agree with the whole text's encoding.

    Memory is bounded: chunks and words are forgotten when there are too many."""

    MASK = 0x7E00  # a chunk of 64 bytes in the mean
    WORD = re.compile(r"\s+\S+|\S+|\s+")
    #: Runs of white space or punctuation, which are pre-tokens as a whole.
    MIXED = re.compile(r"[^\w\s][.,]|_[.,]|\s[\s.,]|\x00")
    #: Between what is white space to nobody and what is to everybody.
    SAFE = re.compile(r"(?<=\S)(?=[ \t\n\x0b\x0c\r])")

    def __init__(self, path: str, most_chunks: int = 250_000, most_words: int = 700_000):
        self.tokenizer, self.most_chunks, self.most_words = load(path), most_chunks, most_words
        self.chunks: dict[str, tuple] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.gear = np.random.RandomState(20_011).randint(0, 2**32, 256, np.uint64).astype(np.uint32)

    def _cuts(self, data: bytes) -> np.ndarray:
        """Ends of chunks in bytes; never inside a character."""
        b = np.frombuffer(data, np.uint8)
        h = self.gear[b]
        for k in (1, 2, 4):
            h[k:] += h[:-k] << np.uint32(k)
        ends = np.flatnonzero((h[:-1] & np.uint32(self.MASK)) == 0) + 1 if len(b) else np.zeros(0, np.int64)
        return ends[(b[ends] & 0xC0) != 0x80]

    def _learn(self, new: set[str], needed: set[str]) -> None:
        known = self.words
        if len(known) + len(new) > self.most_words:
            known.clear()
            new = needed
        fresh = list(new)
        for p, e in zip(fresh, self.tokenizer.encode_batch(fresh, add_special_tokens=False), strict=True):
            known[p] = ("".join([f"{i}," for i in e.ids]), self.tokenizer.decode(e.ids, skip_special_tokens=False))

    def _pieces(self, text: str, odd: bool) -> tuple[str, str]:
        """Decimal ids, each with a comma behind, and the decoded text of a text whose ends are safe. odd: it may hold unusual white space."""
        known = self.words
        if odd and UNUSUAL.search(text):
            words = self.SAFE.split(text)
        elif self.MIXED.search(text):
            words = self.WORD.findall(text)
        else:  # before a single space or line feed, a stop or a comma a pre-token begins
            words = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(".", "\0.").replace(",", "\0,").split("\0")
            if not words[0]:
                del words[0]
        try:
            got = [known[w] for w in words]
        except KeyError:
            self._learn({w for w in words if w not in known}, set(words))
            got = [known[w] for w in words]
        return "".join([g[0] for g in got]), "".join([g[1] for g in got])

    def _chunk(self, text: str, odd: bool) -> tuple:
        """(head, ids and decoded text of the body, tail); head alone if the chunk has no safe place."""
        first = self.SAFE.search(text)
        if not first:
            return (text,)
        a, core = first.start(), text.rstrip()
        if odd:
            *_, last = self.SAFE.finditer(text)
            return (text[:a], *self._pieces(text[a : last.start()], odd), text[last.start() :])
        b = len(core) if len(core) < len(text) else len(core.rsplit(None, 1)[0])
        return (text[:a], *self._pieces(text[a:b], odd), text[b:])

    def encode(self, text: str) -> tuple[str, str]:
        """ids as decimals joined by commas, and the text decoded from them."""
        data, at, seam, odd = text.encode(), 0, "", bool(UNUSUAL.search(text))
        chunks, words, ids, decoded = self.chunks, self.words, [], []
        for end in [*self._cuts(data).tolist(), len(data)]:
            own, at = data[at:end], end
            c = chunks.get(own)
            if c is None:
                if len(chunks) >= self.most_chunks:
                    chunks.clear()
                c = chunks[own] = self._chunk(own.decode(), odd)
            seam += c[0]
            if len(c) > 1:
                i, d = words.get(seam) or self._pieces(seam, odd)
                ids += i, c[1]
                decoded += d, c[2]
                seam = c[3]
        i, d = self._pieces(seam, odd)
        return "".join([*ids, i])[:-1], "".join([*decoded, d])
