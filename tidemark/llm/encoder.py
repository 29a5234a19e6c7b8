"""Byte-level BPE encoding of whole texts by the tokenizers library, each distinct unit once per worker.

The vocabulary's splitting rule puts a border before every space that stands
between two other characters, around a line break between two others, and between
a letter and a full stop or comma. A text is therefore the concatenation of its
units' encodings: a unit is a word with the space or line break before it, without the
stop after it. Arrow cuts a batch into units and numbers the distinct ones, the
library encodes those not known yet, many in one call, and one gather from a flat
array lays the ids out. When too many units are known, those that several batches held stay so. Texts with white space in a row are cut only where a border is
certain; texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.shared import worker_state

CACHE_UNITS = 600_000
CHUNK = 100_000
SPACES_IN_A_ROW = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}][\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
STOPPED = r"\pL[.,]$"


class Encoder:
    """Encodes to little-endian ids of ``dtype``. With ``special`` a special token's string is its id, else ordinary text."""

    def __init__(self, vocabulary: str, dtype: str = "<u4", special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype(dtype)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(pieces.values()) + 1, bool)
        self.opens[[i for p, i in pieces.items() if p.startswith("Ġ")]] = True
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.strings = [t.content for t in added if special or not t.special]
        single = [self.ids(x) for x in ("\n", ".", ",")]
        if any(len(x) != 1 for x in single):
            raise ValueError("not a byte-level vocabulary with its own line break, full stop and comma")
        self.line_break, self.full_stop, self.comma = (int(x[0]) for x in single)
        self.forget()

    def forget(self) -> None:
        """Entries of units: where their ids begin in ``flat``, and how many they are."""
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.held = np.zeros(1 << 14, np.int64)  # batches that held the unit, halved at each thinning
        self.used = 0

    def thin(self) -> None:
        """Forget units of one batch, and beyond half of CACHE_UNITS those that the fewest batches held."""
        kept, most = np.flatnonzero(self.held[: len(self.place)] > 1), CACHE_UNITS // 2
        if len(kept) > most:
            kept = np.sort(kept[np.argpartition(self.held[kept], len(kept) - most)[len(kept) - most :]])
        names = list(self.place)
        size, held = self.size[kept], self.held[kept] // 2
        begins = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.begin[kept] - begins, size) + np.arange(size.sum())]
        self.forget()
        self.keep([names[i] for i in kept.tolist()], ids, begins)
        self.held[: len(kept)] = held

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def lay(self, ids: np.ndarray) -> int:
        """Put ids behind those in ``flat``; returns where they begin."""
        at, end = self.used, self.used + len(ids)
        if end >= len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), end + 1), self.dtype)
            grown[:at] = self.flat[:at]
            self.flat = grown
        self.flat[at:end] = ids
        self.used = end
        return at

    def keep(self, units: list[str], ids: np.ndarray, begins: np.ndarray) -> None:
        """New entries whose ids follow each other."""
        at, n = self.lay(ids), len(self.place)
        if n + len(units) > len(self.begin):
            grow = max(len(self.begin), len(units))
            self.begin = np.concatenate([self.begin, np.zeros(grow, np.int64)])
            self.size = np.concatenate([self.size, np.zeros(grow, np.int64)])
            self.held = np.concatenate([self.held, np.zeros(grow, np.int64)])
        self.begin[n : n + len(units)] = at + begins
        self.size[n : n + len(units)] = np.diff(begins, append=len(ids))
        self.place.update(zip(units, range(n, n + len(units)), strict=True))

    def learn(self, units: list[str]) -> None:
        """Encode units, those of one kind in one text: an id whose piece opens with a space, or that of a line break, begins a unit."""
        words, lines, single = [], [], []
        for u in units:
            first = u[:1]
            if first and not first.isspace():
                words.append(u)
            else:
                (lines if first == "\n" and u[1:2] and not u[1:2].isspace() else single).append(u)
        for u in single:
            self.keep([u], self.ids(u if u[:1] == "\n" else " " + u), np.zeros(1, np.int64))
        for some, before, starts in ((words, " ", lambda ids: self.opens[ids]), (lines, "", lambda ids: ids == self.line_break)):
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and size < CHUNK:
                    size += len(some[end]) + 1
                    end += 1
                ids = self.ids(before + before.join(some[at:end]))
                self.keep(some[at:end], ids, np.flatnonzero(starts(ids)))
                at = end

    def entries(self, units: list[str]) -> np.ndarray:
        """Entry numbers of distinct units."""
        own = self.known(units)
        missing = np.flatnonzero(own < 0)
        if self.place and len(self.place) + len(missing) > CACHE_UNITS:
            self.thin()
            own = self.known(units)
            missing = np.flatnonzero(own < 0)
        new = [units[i] for i in missing.tolist()]
        self.learn(new)
        own[missing] = self.known(new)
        self.held[own] += 1
        return own

    def known(self, units: list[str]) -> np.ndarray:
        """Entry numbers of units, -1 for those not known."""
        return np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text ends."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if len(self.place) > CACHE_UNITS:
            self.thin()
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, SPACES_IN_A_ROW).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for string in self.strings:
            whole |= pc.match_substring(column, string).to_numpy(zero_copy_only=False)
        apart = odd | whole
        # a unit ends before a space or a line break
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(apart), "", column), "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy()[:-1]
        # the first unit of a text has no space before it: like one after a line break, less the break
        units = cut.values.dictionary_encode()
        codes = units.indices.to_numpy()
        first = units.dictionary.take(pa.array(codes[offsets]))
        names = pa.concat_arrays([units.dictionary, pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), first, pa.scalar("", pa.large_string()))])
        stopped = pc.match_substring_regex(names, STOPPED)
        core = pc.if_else(stopped, pc.utf8_slice_codeunits(names, 0, -1), names).dictionary_encode()
        entry = self.entries(core.dictionary.to_numpy(zero_copy_only=False).tolist())[core.indices.to_numpy()]
        stop = np.where(pc.ends_with(names, ".").to_numpy(zero_copy_only=False), self.full_stop, self.comma)
        has_stop = stopped.to_numpy(zero_copy_only=False)

        n_units = len(units.dictionary)
        codes = codes.astype(np.int64)
        codes[offsets] = n_units + np.arange(len(texts))
        own = entry[codes]
        begin, size, more = self.begin[own], self.size[own], has_stop[codes]
        begin[offsets] += 1
        size[offsets] -= 1
        kept = self.used
        for i in np.flatnonzero(apart).tolist():
            ids = self.ids(texts[i]) if whole[i] else np.concatenate([self.ids(p) for p in SAFE_CUT.split(texts[i])])
            begin[offsets[i]], size[offsets[i]] = self.lay(ids), len(ids)
        total = size + more
        ends = np.cumsum(total)
        out = self.flat[np.repeat(begin - (ends - total), total) + np.arange(ends[-1])]
        out[ends[more] - 1] = stop[codes[more]]
        self.used = kept
        return out, ends[np.append(offsets[1:], len(codes)) - 1]

    def encode_closed(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode``, with ``end_id`` after each text."""
        ids, ends = self.encode(texts)
        n = np.arange(len(texts))
        out = np.empty(len(ids) + len(texts), self.dtype)
        out[np.arange(len(ids)) + np.repeat(n, np.diff(ends, prepend=0))] = ids
        out[ends + n] = end_id
        return out, ends + n + 1


def encoder(vocabulary: str, dtype: str = "<u4", special: bool = False) -> Encoder:
    """One encoder per Python worker, so its units stay known from task to task."""
    kept = worker_state("encoder")
    key = ("encoder", vocabulary, dtype, special)
    if key not in kept:
        kept[key] = Encoder(vocabulary, dtype, special)
    return kept[key]


def text_groups(texts: list[str], chars: int = 4_000_000):
    """Index ranges of consecutive texts of about ``chars`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= chars):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end
