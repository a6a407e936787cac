"""Tokenising with a public vocabulary file, memoised by the unit that the vocabulary never merges across.

Both public BPE files split a text into pieces before merging: runs of letters, of digits, of other characters, with
some care for apostrophes and white space. So the ids of a text are the ids of its pieces joined, and a piece seen
before costs a dictionary lookup instead of a BPE run. The library still produces every id.

Texts are cut in groups, by array operations over the bytes of a whole group: classes of bytes, borders between them,
and the distinct pieces of the group with their places. Texts with an apostrophe, a likely special token, unusual white
space or characters beyond ASCII that are no letters are cut one by one, or go through the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
from tokenizers import Tokenizer  # noqa: E402

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"


class Recent:
    """Ids of units met lately, in two generations of about `limit` units: the old one goes when the new one is full."""

    def __init__(self, limit: int):
        self.new: dict = {}
        self.old: dict = {}
        self.limit = limit

    def fetch(self, units: set) -> list:
        """Moves what the old generation knows to the new one; returns the units that neither knows."""
        units = units.difference(self.new)
        known = {u: self.old[u] for u in units if u in self.old}
        self.new.update(known)
        return [u for u in units if u not in known]

    def trim(self) -> None:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTER, DIGIT, OTHER, BLANK, LINE, SPACE = range(6)  # classes of bytes; all beyond ASCII count as letters


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[128:] = out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = LETTER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[[9, 11, 12, 13]] = SPACE
    out[32], out[10] = BLANK, LINE
    return out


class Encoder:
    """texts -> their ids, each as little-endian unsigned 32-bit integers in bytes. None counts as empty.

    A fresh unit that is one piece goes straight to the vocabulary's model, any other through the whole library.
    """

    alphabet = byte_letters()
    classes = byte_classes()

    def __init__(self, path: str, limit: int = 150_000, group_bytes: int = 1 << 20):
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.seen = Recent(limit)
        self.group_bytes = group_bytes
        self.letters: set[int] = set()  # code points beyond ASCII found to be letters
        self.others: set[int] = set()

    def forget(self) -> None:
        """Drop the memo, so that an idle worker holds none."""
        self.seen = Recent(self.seen.limit)

    def units(self, text: str) -> list[bytes] | None:
        """The text's units, or None if it must be encoded whole."""
        raise NotImplementedError

    def borders(self, kinds: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Flags of the bytes at which a unit begins; start flags the first byte of each text."""
        raise NotImplementedError

    def odd(self, kinds: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of bytes whose text is not for cutting by classes; last flags the last byte of each text."""
        raise NotImplementedError

    def piece(self, unit: bytes) -> str | None:
        """The unit as one piece in the byte-level alphabet, or None if it is not one piece."""
        raise NotImplementedError

    def as_text(self, unit: bytes) -> str:
        return unit.decode()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_unit(self, unit: bytes) -> bytes:
        piece = self.piece(unit)
        if piece is None:
            return self.whole(self.as_text(unit))
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def looked_up(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units."""
        known = self.seen.new
        ids = list(map(known.get, units))
        fresh = self.seen.fetch({u for u, x in zip(units, ids) if x is None})
        known.update(zip(fresh, map(self.encode_unit, fresh)))
        out = [known[u] if x is None else x for u, x in zip(units, ids)]
        for u in fresh:
            if len(u) > 64:
                del known[u]
        self.seen.trim()
        return out

    def not_letters(self, raw: np.ndarray) -> np.ndarray:
        """Places of first bytes of characters beyond ASCII that are no letters."""
        at = np.flatnonzero(raw >= 0xC0)
        if not len(at):
            return at
        lead, more = raw[at].astype(np.int64), np.append(raw, np.zeros(3, np.uint8)).astype(np.int64) & 63
        two, three = (lead & 31) << 6 | more[at + 1], (lead & 15) << 12 | more[at + 1] << 6 | more[at + 2]
        code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 7) << 18 | more[at + 1] << 12 | more[at + 2] << 6 | more[at + 3]))
        for c in set(np.unique(code).tolist()) - self.letters - self.others:
            (self.letters if chr(c).isalpha() else self.others).add(c)
        if self.others.isdisjoint(np.unique(code).tolist()):
            return at[:0]
        return at[np.isin(code, np.array(sorted(self.others)))]

    def group(self, texts: list[str]) -> list[bytes]:
        """Ids of texts none of which holds an apostrophe or what may be a special token; those that can't be cut by classes are cut alone."""
        raws = [t.encode() for t in texts]
        raw = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        kinds = self.classes[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[np.append(0, ends)] = True
        apart = np.unique(np.searchsorted(ends, np.concatenate([self.odd(kinds, edge[1:]), self.not_letters(raw)]), "right"))
        alone = {int(i): self.one(texts[i]) for i in apart}
        begin = np.flatnonzero(self.borders(kinds, edge[:-1]))
        begin = begin[~np.isin(np.searchsorted(ends, begin, "right"), apart)] if len(apart) else begin
        if len(apart):  # what is cut alone leaves the buffer
            keep = np.repeat(~np.isin(np.arange(len(raws)), apart), [len(r) for r in raws])
            moved = np.cumsum(keep) - 1
            raw, begin = raw[keep], moved[begin]
        cuts = np.append(begin, len(raw)).astype(np.int32)
        data = self.lowered(raw)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        place = coded.indices.to_numpy()
        ids = self.looked_up(coded.dictionary.to_pylist())
        size = np.array([len(x) >> 2 for x in ids], np.int64)
        first = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(ids), "<u4")
        n = size[place]
        upto = np.append(0, np.cumsum(n))
        out = blob[np.repeat(first[place] - upto[:-1], n) + np.arange(upto[-1])]
        sizes = np.array([0 if i in alone else len(r) for i, r in enumerate(raws)], np.int64)
        stop = upto[np.searchsorted(begin, np.cumsum(sizes))]
        start = np.append(0, stop[:-1])
        return [alone[i] if i in alone else out[a:b].tobytes() for i, (a, b) in enumerate(zip(start.tolist(), stop.tolist()))]

    def lowered(self, raw: np.ndarray) -> np.ndarray:
        return raw

    def one(self, text: str) -> bytes:
        units = self.units(text)
        if units is None:
            return self.whole(text)
        own = list(dict.fromkeys(units))
        ids = dict(zip(own, self.looked_up(own)))
        return b"".join([ids[u] for u in units])

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            if not text:
                held.append(b"")
            elif "'" in text or "<|" in text:
                held.append(self.one(text))
            else:
                held.append(text)
                size += len(text)
                if size >= self.group_bytes:
                    yield from self.flush(held)
                    held, size = [], 0
        yield from self.flush(held)

    def flush(self, held: list[str | bytes]) -> Iterator[bytes]:
        own = [x for x in held if isinstance(x, str)]
        done = iter(self.group(own) if own else [])
        for x in held:
            yield next(done) if isinstance(x, str) else x


class WordEncoder(Encoder):
    """For a vocabulary that lowers letters and drops white space.

    Units are runs of letters, of digits and of other characters; white-space-delimited runs where they hold an
    apostrophe, and, after a space, in texts with a character beyond ASCII that is no letter or a likely special token.
    """

    runs = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\s]+").findall
    quoted = re.compile(rb"[^\s']*'[^\s]*|[a-z\x80-\xff]+|[0-9]+|[^a-z0-9\x80-\xff\s]+").findall

    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)

    def units(self, text):
        raw = text.encode()
        if "<|" in text or len(self.not_letters(np.frombuffer(raw, np.uint8))):
            return [b" " + u for u in raw.split()]
        return (self.quoted if "'" in text else self.runs)(raw.lower())

    def borders(self, kinds, start):
        gap = np.minimum(kinds, BLANK)  # all white space is one class
        return start | np.append(True, gap[1:] != gap[:-1])[: len(gap)]

    def odd(self, kinds, last):
        return np.zeros(0, np.int64)

    def lowered(self, raw):
        return self.lower[raw]

    def encode_unit(self, unit):
        return super().encode_unit(unit) if unit.strip() else b""

    def as_text(self, unit):
        return unit.decode().removeprefix(" ")

    def piece(self, unit):
        if unit.isalpha():
            return unit.decode()
        if unit[:1] == b" " or unit.isdigit() or b"'" in unit:
            return None
        if unit[0] > 127 or unit[-1] > 127 or not unit.isascii():
            text = self.library.normalizer.normalize_str(unit.decode())
            if not text.isalpha():
                return None
            unit = text.encode()
        return unit.decode("latin-1").translate(self.alphabet)


class ByteEncoder(Encoder):
    """For a byte-level vocabulary that keeps white space and joins a space to what follows.

    A text goes to the library whole if white space but a line feed or a space before something else, or a character
    beyond ASCII that is no letter, or what may be a special token stands in it.
    """

    runs = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^A-Za-z0-9\x80-\xff\s]+|\n").findall
    quoted = re.compile(rb" ?[^\s']*'[^\s]*| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^A-Za-z0-9\x80-\xff\s]+|\n").findall

    def units(self, text):
        raw = text.encode()
        if "<|" in text or "\n\n" in text or len(self.not_letters(np.frombuffer(raw, np.uint8))):
            return None
        units = (self.quoted if "'" in text else self.runs)(raw)
        return units if len(b"".join(units)) == len(raw) else None  # else white space that no unit takes

    def borders(self, kinds, start):
        before = np.append(np.uint8(LINE), kinds[:-1])[: len(kinds)]
        return start | (before != BLANK) & ((kinds != before) | (kinds == LINE))

    def odd(self, kinds, last):
        after = np.append(kinds[1:], np.uint8(LINE))[: len(kinds)]
        twice = (kinds == LINE) & (after == LINE) & ~last
        return np.flatnonzero((kinds == SPACE) | twice | (kinds == BLANK) & (last | (after >= BLANK)))

    def piece(self, unit):
        return None if b"'" in unit else unit.decode("latin-1").translate(self.alphabet)


@functools.lru_cache(maxsize=2)
def encoder(name: str, path: str | None = None) -> Encoder:
    """One encoder for each Python worker and vocabulary file; path overrides the place of the public file."""
    path = path or public_tokenizers.path(name)
    return WordEncoder(path) if name.startswith("word") else ByteEncoder(path)
