"""Tokenising whole texts inside Arrow batches.

A tokenizer file is opened once per Python worker.  Texts are cut at ASCII
spaces where the cut cannot change a token, equal pieces of a batch are
encoded once, and a per-worker memo bounded in bytes keeps the pieces met
before; so the tokenizer library itself sees each distinct piece only.  Every
id comes from the library.  Null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces, and characters of them, that one worker remembers; beyond either, it starts afresh.
MEMO_PIECES, MEMO_CHARS = 600_000, 8 << 20
#: Bytes of text that are cut and encoded together; longer texts are taken in parts.
SLICE_BYTES = 2 << 20

#: A word of Latin-1 letters (none of which changes under NFC), perhaps with a space before it.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Full stops and commas behind a letter: both tokenizers end a pre-token between them.
_STOPPED = r"(?s)\A(?P<word>.*[A-Za-zÀ-ÖØ-öø-ÿ])(?P<stops>[.,]+)\z"
#: A space that has other white space beside it.
_ODD = re.compile(r"\s(?<! ) | \s")
#: Where a text can be cut: before a lone space, or (for tokenizers that drop white space) at any.
_LONE, _ANY = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"(?=[ \n])")
#: Byte-level BPE writes the bytes 0x80-0xA0 and 0xAD as the characters from 0x122 on.
_BYTE_CHARS = {b: 0x122 + k for k, b in enumerate([*range(0x80, 0xA1), 0xAD])}
_encoders: dict[tuple, "PieceEncoder"] = {}


def _gather(ids: np.ndarray, lo: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids[lo : lo + size] of all runs one after another, and where each ends."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(lo - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class PieceEncoder:
    """Encodes lists of texts with one tokenizer file.

    spaced: the tokenizer keeps white space (byte-level BPE), so a piece takes
    the space before it along, and only `\\S \\S` is a safe cut.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.spaced = spaced
        self.memo: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.ends, self.count, self.chars = np.zeros(1 << 16, np.int64), 0, 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_new(self, pieces: list[str]) -> list[list[int]]:
        """A plain Latin-1 word is one pre-token: the library's BPE model takes it directly. All else goes through the
        whole pipeline."""
        model, out, rest, where = self.tokenizer.model.tokenize, [None] * len(pieces), [], []
        for k, (p, plain) in enumerate(zip(pieces, map(_PLAIN.match, pieces))):
            if not plain:
                rest.append(p)
                where.append(k)
                continue
            word = p if self.spaced else p.strip(" ").lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
            out[k] = [t.id for t in model("\u0120" + word[1:] if word[0] == " " else word)]
        for k, ids in zip(where, self._library(rest)):
            out[k] = ids
        return out

    def _numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece's ids in self.ids; pieces are distinct."""
        memo, pieces = self.memo, pieces.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.ends[at], self.ends[at + 1]
        if self.count + len(new) > MEMO_PIECES or self.chars > MEMO_CHARS:  # start afresh
            memo.clear()
            self.used = self.count = self.chars = 0
            at, new = np.full(len(pieces), -1), np.arange(len(pieces))
        names = [pieces[k] for k in new.tolist()]
        self.chars += sum(map(len, names))
        found = self._encode_new(names)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[self.count + 1 : self.count + 1 + len(new)] = self.used + np.cumsum(sizes)
        at[new] = np.arange(self.count, self.count + len(new))
        memo.update(zip(names, at[new].tolist()))
        self.used += len(flat)
        self.count += len(new)
        return self.ends[at], self.ends[at + 1]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces one after another, and where each ends. Case (if the tokenizer drops it) and stops
        behind a word are taken off first, so that one entry of the memo serves all forms of a word."""
        if not self.spaced:  # special strings keep their case: only as written are they special
            pieces = pc.if_else(pc.match_substring(pieces, "<|"), pieces, pc.ascii_lower(pieces))
        parts = pc.extract_regex(pieces, _STOPPED)
        words, stops = pc.coalesce(pc.struct_field(parts, "word"), pieces), pc.coalesce(pc.struct_field(parts, "stops"), pa.scalar("", pieces.type))
        d = pa.concat_arrays([words, stops]).dictionary_encode()
        lo, hi = self._numbers(d.dictionary)
        code = d.indices.to_numpy().reshape(2, -1).T.ravel()
        out, ends = _gather(self.ids, lo[code], (hi - lo)[code])
        return out, ends[1::2]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends in them."""
        texts, odd = [t or "" for t in texts], {}
        if self.spaced:
            for k, t in enumerate(texts):
                if "  " in t or (t and (t[0].isspace() or t[-1].isspace())) or _ODD.search(t):
                    odd[k] = _LONE.split(t)
                    texts[k] = ""
        joined = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(joined if self.spaced else pc.replace_substring(joined, "\n", " "), " ")
        starts = cut.offsets.to_numpy()
        flat = cut.flatten()
        if self.spaced:
            first = np.zeros(len(flat), bool)
            first[starts[:-1]] = True
            flat = pc.binary_join_element_wise(pa.array(np.where(first, "", " "), pa.large_string()), flat, pa.scalar("", pa.large_string()))
        if odd:  # their pieces stand behind all others; bring them to their places
            at = len(flat) + np.cumsum([0, *map(len, odd.values())])
            flat = pa.concat_arrays([flat, pa.array(chain.from_iterable(odd.values()), pa.large_string())])
            own = dict(zip(odd, zip(at.tolist(), at[1:].tolist())))
            spans = [own.get(k, span) for k, span in enumerate(zip(starts.tolist(), starts[1:].tolist()))]
            flat = flat.take(pa.array(np.concatenate([np.arange(a, b) for a, b in spans])))
            starts = np.cumsum([0, *(b - a for a, b in spans)])
        d = flat.dictionary_encode()
        ids, ends = self._pieces(d.dictionary)
        code, sizes = d.indices.to_numpy(), np.diff(ends, prepend=0)
        out, ends = _gather(ids, (ends - sizes)[code], sizes[code])
        return out, np.concatenate([[0], ends])[starts[1:]]


def encoder(path: str, spaced: bool) -> PieceEncoder:
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = PieceEncoder(path, spaced)
    return _encoders[path, spaced]


def _cut(text: str, spaced: bool) -> Iterator[str]:
    """A long text in parts of about SLICE_BYTES, cut where no token can change."""
    at, step, safe = 0, max(1, SLICE_BYTES // 4), _LONE if spaced else _ANY
    while len(text) - at > step and (found := safe.search(text, at + step)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def parts(texts: pa.Array, spaced: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers and texts (or parts of them, in order) of about SLICE_BYTES together, so that work and memory follow
    bytes, not rows."""
    rows, out, size = [], [], 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        text = texts[k].as_py() or ""
        for part in _cut(text, spaced) if n > SLICE_BYTES else (text,):
            rows.append(k)
            out.append(part)
            size += n if part is text else 4 * len(part)
            if size >= SLICE_BYTES:
                yield rows, out
                rows, out, size = [], [], 0
    if rows:
        yield rows, out
