"""Token ids and counts of whole texts, worker side: caches over pre-tokens in front of the library's BPE model.

A text is cut where the library's own pre-tokenizer always cuts; what lies between two cuts (a unit) is looked
up in a bounded cache, a missing unit is split into pre-tokens by the tokenizer's pattern, and only pre-tokens
that no cache holds reach the BPE model. Texts with characters whose class may differ between Unicode versions,
or with special strings, go through the library as they are. Results are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

BYTE_LEVEL = "byte"
WORD_LEVEL = "word"
#: The splitting patterns of the two kinds of tokenizer file.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of settled class; Latin letters here are composed, and lower-case to one character each.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏЀ-ҁҊ-ԓ‐-‧‰-‾€一-龥]")
#: White space before a space: the only place where a run of white space spans two units.
RUN = re.compile(r"[ \t\n\r] ")
LONG_UNIT, SEGMENT = 64, 1 << 20
#: Bytes that a generation of a worker's cache of units holds; that of pre-tokens holds a quarter.
CACHE_BYTES = 56 << 20


def byte_alphabet() -> list[str]:
    """The visible character for each byte, as byte-level BPE writes them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class _Cache(dict):
    """A dict that asks ``make`` for what is missing. Full, it becomes the old generation, from which hits move back.

    ``limit`` is in bytes for a generation, at ENTRY bytes an entry: the slot in the dict, two object heads, and a
    key of at most LONG_UNIT characters with its value, as they are on average.
    """

    ENTRY = 230

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // self.ENTRY, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_UNIT:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Units(_Cache):
    """Words, and words with one sign behind them, which are put together from the word's entry and the sign's."""

    def __init__(self, make, limit: int, signs: dict, word):
        super().__init__(make, limit)
        self.signs, self.word = signs, word

    def __missing__(self, unit):
        sign = self.signs.get(unit[-1:])
        if sign is not None and unit[:-1].isalpha():
            return self[unit[:-1]] + sign
        value = self.old.get(unit)
        if value is None:
            value = self.word(unit) if unit.isalpha() else self.make(unit)
            if len(unit) > LONG_UNIT:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers; ``count(text)``: how many.

    ``frequent`` is a table from pre-token to number of ids, shared by all workers (counts only).
    """

    def __init__(self, path: str, counts: bool = False, frequent: dict[str, int] | None = None, limit: int = CACHE_BYTES):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        kind = (spec["normalizer"] or {}).get("type"), spec["pre_tokenizer"]["type"], spec["model"]["type"], spec.get("post_processor", {}) and spec["post_processor"]["type"]
        self.counts = counts
        self.zero = 0 if counts else b""
        if kind[1:3] == ("ByteLevel", "BPE") and spec["normalizer"] is None and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.kind, pattern = BYTE_LEVEL, BYTE_PATTERN
        elif kind[0] == "Sequence" and WORD_PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            self.kind, pattern = WORD_LEVEL, WORD_PATTERN
        else:
            self.kind, pattern = "", r"[\s\S]+"
        self.find = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_alphabet()))
        self.frequent = frequent or {}
        self.pieces = _Cache(self._piece, limit // 4)
        signs = {c: self._piece(c) for c in ".,;:!?"} if self.kind else {}
        self.units = _Units(self._unit, limit, signs, (lambda w: self._piece(" " + w)) if self.kind == BYTE_LEVEL else (lambda w: self._piece(w.lower())))

    def _pack(self, ids: list[int]):
        return len(ids) if self.counts else struct.pack(f"<{len(ids)}I", *ids)

    def _join(self, parts):
        return sum(parts) if self.counts else b"".join(parts)

    def _piece(self, piece: str):
        got = self.frequent.get(piece)
        if got is not None:
            return got
        return self._pack([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])

    def _unit(self, unit: str):
        """Byte level: the unit stands after a space. Word level: between white space."""
        if self.kind == BYTE_LEVEL:
            return self._join(map(self.pieces.__getitem__, self.find(" " + unit)))
        return self._join(map(self.pieces.__getitem__, self.find(unit.lower())))

    def _whole(self, text: str):
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None):
        if not text:
            return self.zero
        if not self.kind or UNSAFE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        if self.kind == WORD_LEVEL:
            return self._join(self._join(map(self.units.__getitem__, s.split())) for s in segments(text))
        return self._join(map(self._spaced, segments(text)))

    def _spaced(self, text: str):
        if RUN.search(text):
            return self._join(map(self.pieces.__getitem__, self.find(text)))
        units = iter(text.split(" "))
        first = self._join(map(self.pieces.__getitem__, self.find(next(units))))
        return first + self._join(map(self.units.__getitem__, units))


def kept_by_worker(key: tuple, make):
    """What ``make`` gives, kept in this Python worker, so that later tasks find its caches warm.

    One such object is held; it goes before another is made. Each bounds its own size in bytes.
    """
    import sys

    held = sys.__dict__.setdefault("_plumbline_kept", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def worker_encoder(path: str, counts: bool = False, frequent: bytes = b"", limit: int = CACHE_BYTES) -> Encoder:
    """An encoder shared by the tasks of a worker; ``frequent`` is a packed table, ``limit`` as in ``CACHE_BYTES``."""
    return kept_by_worker(("encoder", path, counts, zlib.crc32(frequent), limit), lambda: Encoder(path, counts, unpack_table(frequent) if frequent else None, limit))


def segments(text: str) -> Iterator[str]:
    """A long text in parts of about a million characters, cut before a single space between two words."""
    at = 0
    while len(text) - at > 2 * SEGMENT:
        cut = at + SEGMENT
        while (cut := text.find(" ", cut + 1)) >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            pass
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


#: Characters of texts that are worked on at once.
TOGETHER = 1 << 19


def together(texts: list[str | None], most: int = TOGETHER) -> Iterator[list[str | None]]:
    """The texts in runs of about ``most`` characters; a longer one stands alone."""
    run: list[str | None] = []
    held = 0
    for t in texts:
        size = len(t) if t else 0
        if run and held + size > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += size
    if run:
        yield run


def pack_table(lengths: dict[str, int]) -> bytes:
    """A compact table: the pre-tokens, then their lengths as 16-bit integers, compressed."""
    keys = "\0".join(lengths).encode()
    return zlib.compress(struct.pack("<I", len(keys)) + keys + struct.pack(f"<{len(lengths)}H", *lengths.values()))


def unpack_table(data: bytes) -> dict[str, int]:
    raw = zlib.decompress(data)
    size = struct.unpack_from("<I", raw)[0]
    keys = raw[4 : 4 + size].decode().split("\0") if size else []
    return dict(zip(keys, struct.unpack_from(f"<{len(keys)}H", raw, 4 + size), strict=True))
