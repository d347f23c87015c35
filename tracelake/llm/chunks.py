"""Cutting texts into chunks that never share a pre-token, with a bounded memo of their encodings.

A space between two characters that are not white space always starts a new pre-token of the pattern
(no alternative goes on past it), so a text may be cut before each such space, and a chunk that was
encoded once need not be encoded again.  Texts in which a space touches other white space are cut
only where this holds.

In the same way a pre-token never goes on from a letter or digit to a symbol or line end, from any
character to a line end, or from a line end to what follows it, so texts can be cut there too; only
the number of line ends before a word matters, so a run of them is never cut.

A text with the literal of an added token isn't cut at all: the library finds the token in the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = "\x01"
#: Texts that are left to :func:`pieces_of`: other white space than single spaces and line ends, or the mark itself.
UNEVEN = (
    r"[ \n] |[\x01\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}"
    r"\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
AFTER_WORD = r"([\pL\pN])([!-&(-/:-@\[-`{-~\n])"
LINE_END = r"([^ \n])\n([^ \n])"


def pieces_of(text: str) -> list[str]:
    """Chunks of `text` that concatenate to it; all but the first begin with their space."""
    parts = text.split(" ")
    if len(parts) == 1:
        return [text] if text else []
    if not any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, held = [], parts[0]
    for part in parts[1:]:
        if held and not held[-1].isspace() and part and not part[0].isspace():
            out.append(held)
            held = " " + part
        else:
            held = f"{held} {part}"
    out.append(held)
    return out


class Table:
    """Chunk -> ids, for whole columns of texts.  It remembers `limit` chunks, each of at most `longest` characters,
    and their ids only, in room that is made once: so its size is bounded whatever the texts are.

    Cutting and counting the distinct chunks is done by Arrow and putting ids in place by numpy, so
    Python sees each distinct chunk of a batch once.  `encode` gets the chunks that aren't known and
    returns ids, and where in them those of each chunk start and how many they are.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]],
        limit: int = 800_000,
        longest: int = 64,
        literals: Sequence[str] = (),
    ):
        self.encode, self.limit, self.longest, self.literals = encode, limit, longest, literals
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros((2, max(1, limit)), np.int64)
        self.used = 0  # of ids

    def held(self) -> int:
        """Bytes of the remembered ids."""
        return self.ids.nbytes

    def packed(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each text; a null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for literal in self.literals:
            whole |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False) | whole
        even = texts.filter(pa.array(~uneven))
        even = pc.replace_substring_regex(even, AFTER_WORD, rf"\1{CUT}\2")
        even = pc.replace_substring_regex(even, LINE_END, f"\\1{CUT}\n{CUT}\\2")
        cut = pc.split_pattern(pc.replace_substring(even, " ", f"{CUT} "), CUT)
        others = [[t] if w else pieces_of(t) for t, w in zip(texts.filter(pa.array(uneven)).to_pylist(), whole[uneven])]
        flat = pa.chunked_array([cut.flatten(), pa.array(chain.from_iterable(others), pa.large_string())])
        counts = np.append(cut.value_lengths().to_numpy(zero_copy_only=False), [len(x) for x in others])
        start, length, buffer, codes = self._chunks(flat.combine_chunks())
        sizes = length[codes]
        ends = np.append(0, np.cumsum(sizes))
        at = np.arange(ends[-1]) + np.repeat(start[codes] - ends[:-1], sizes)
        data = memoryview(buffer[at].astype("<u4").tobytes())
        stops = 4 * ends[np.append(0, np.cumsum(counts.astype(np.int64)))]
        out = [b""] * len(texts)
        for i, a, b in zip(np.argsort(uneven, kind="stable").tolist(), stops.tolist(), stops[1:].tolist()):
            out[i] = bytes(data[a:b])
        return out

    def _chunks(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct chunk its start and length in a buffer of ids, the buffer, and the chunks by number."""
        coded = flat.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(slots < 0)
        words = [chunks[i] for i in missing.tolist()]
        ids, starts, lengths = self.encode(words)
        length = self.lengths[slots]
        length[missing] = lengths
        known = slots >= 0  # the known ones' ids come first in the buffer
        total = np.append(0, np.cumsum(length[known]))
        at = np.arange(total[-1]) + np.repeat(self.starts[slots[known]] - total[:-1], length[known])
        buffer = np.concatenate([self.ids[at], ids])
        start = np.empty(len(chunks), np.int64)
        start[known] = total[:-1]
        start[missing] = starts + total[-1]
        self._remember(words, ids, starts, lengths)
        return start, length, buffer, coded.indices.to_numpy(zero_copy_only=False)

    def _remember(self, words: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        keep = [i for i, w in enumerate(words) if len(w) <= self.longest][: self.limit - first]
        if not keep:
            return
        self.known.update((words[i], first + n) for n, i in enumerate(keep))
        sizes = lengths[keep]
        total = np.append(0, np.cumsum(sizes))
        at = np.arange(total[-1]) + np.repeat(starts[keep] - total[:-1], sizes)
        if self.used + len(at) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.zeros(max(len(at), self.used, 1 << 16), np.uint32))
        self.ids[self.used : self.used + len(at)] = ids[at]
        self.starts[first : first + len(keep)] = self.used + total[:-1]
        self.lengths[first : first + len(keep)] = sizes
        self.used += len(at)
