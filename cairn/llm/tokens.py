"""Encoding whole texts, one distinct stretch between white space at a time.

The pre-tokenizers of these vocabularies decide where to split by looking at white space and what touches it, so a text cut
before a run of white space that follows something else has the ids of its parts, in order. Most stretches come again and
again: a worker keeps the ids of those it has met (a bounded number of them) and encodes the new ones only. A text in which
a special token's string stands goes to the library whole, as the library finds those before it splits.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Set

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cairn.llm.common import LET_GO

#: White space as the Unicode property White_Space has it (fixed values); Python's \s also has U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
#: Those of ASCII, and the last two and three bytes (as numbers) of the others in UTF-8.
WHITE_1, WHITE_2, WHITE_3 = (np.array(sorted(int.from_bytes(c.encode()) for c in WHITES if len(c.encode()) == n)) for n in (1, 2, 3))
STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bytes that a worker remembers before it lets go of what its last batch did not have, what a stretch takes beside its text
#: and ids, and the longest that is remembered.
KEPT, BESIDE, LONGEST = 80 << 20, 200, 64
#: New stretches that go to the library in one text; it takes a third longer over a stretch where there are a thousand.
TOGETHER = 200
#: Stretches that are asked about together.
ASKED = 500


class Remembering:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; what a stretch encodes to is left to `learn`."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.known, self.size = kept, {}, 0

    def _remember(self, learned: dict[str, bytes]) -> None:
        self.known.update(learned)
        self.size += BESIDE * len(learned) + sum(map(len, learned)) + sum(map(len, learned.values()))

    def learn(self, new: Set[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def folded(self, texts: pa.Array) -> pa.Array:
        """The texts in a form that encodes alike and has fewer different stretches."""
        return texts

    def unsafe(self, stretch: str) -> bool:
        """Whether a folded stretch, or any of several with "\\0" between them, may encode otherwise than the text's own."""
        return False

    def whole(self, texts: pa.Array) -> pa.Array | None:
        """Texts that must not be cut, if there may be any; they are left to `_whole`."""
        return None

    def _whole(self, text: str) -> bytes:
        raise NotImplementedError

    def _odd(self, parts: pa.Array, met: list[str]) -> np.ndarray:
        """Which of `parts` (`met`, as an array) end in white space, or may not be folded, as seen from the bytes of all of them
        at once; those that are not ASCII are asked about many together, as very few may not be folded."""
        ends = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset)
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        odd = ends[1:] > ends[:-1]
        at = ends[1:][odd] - 1
        white, wide = np.isin(data[at], WHITE_1), np.flatnonzero(data[at] >= 128)
        two = data[at[wide] - 1].astype(np.int32) << 8 | data[at[wide]]
        white[wide] = np.isin(two, WHITE_2) | np.isin(data[at[wide] - 2].astype(np.int32) << 16 | two, WHITE_3)
        odd[odd] = white
        others = np.flatnonzero(~pc.string_is_ascii(parts).to_numpy(zero_copy_only=False)).tolist()
        for first in range(0, len(others), ASKED):
            some = others[first : first + ASKED]
            if self.unsafe("\0".join(map(met.__getitem__, some))):
                for i in some:
                    odd[i] |= self.unsafe(met[i])
        return odd

    def _meet(self, met: list[str]) -> list[bytes]:
        """The ids of each of `met`, which are all different."""
        if self.size > self.kept:
            held, self.known, self.size = self.known, {}, 0
            self._remember({s: held[s] for s in met if s in held})
        ids = list(map(self.known.get, met))
        if new := {met[i]: i for i, x in enumerate(ids) if x is None}:
            learned = self.learn(new.keys())
            for s, x in learned.items():
                ids[new[s]] = x
            self._remember(learned if max(map(len, new)) <= LONGEST else {s: x for s, x in learned.items() if len(s) <= LONGEST})
        return ids

    def _one(self, text: str) -> bytes:
        cut = STRETCH.findall(text)
        met = list(set(cut))
        return b"".join(map(dict(zip(met, self._meet(met), strict=True)).__getitem__, cut))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Arrow splits the texts before each space and line feed and numbers what comes of it, so Python meets each stretch
        once a batch. A part that ends in white space would split a run of it: texts with such parts are done by STRETCH."""
        marked = pc.replace_substring(pc.replace_substring(self.folded(texts), " ", "\0 "), "\n", "\0\n")
        parts = pc.split_pattern(marked, "\0")
        ends, numbered = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten().dictionary_encode()
        codes = numbered.indices
        # no part has the mark in it, so all are made Python's by one split
        met = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary), "\0")[0].as_py().split("\0") if len(codes) else []
        odd = self._odd(numbered.dictionary, met)
        found = pa.array(self._meet(met), pa.large_binary()).take(codes)  # one after the other in one buffer
        (_, at, data), codes = found.buffers(), codes.to_numpy()
        raw, cuts = data.to_pybytes() if data else b"", np.frombuffer(at, np.int64, len(found) + 1)[ends].tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        again = {*np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(odd[codes])])[ends])).tolist(), *pc.indices_nonzero(pc.match_substring(texts, "\0")).to_pylist()}
        for i in again:
            out[i] = self._one(texts[i].as_py())
        if (whole := self.whole(texts)) is not None:
            for i in pc.indices_nonzero(whole).to_pylist():
                out[i] = self._whole(texts[i].as_py())
        return out


class Encoder(Remembering):
    """By a file of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it would look up, and add, each stretch that this never asks for again
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: How many bytes of the normalised text each token stands for: its alphabet has a character for each byte.
        self.spans = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.spans[i] = len(token.removesuffix("</w>"))
        self.drops_white = self.tokenizer.normalizer is not None

    def folded(self, texts: pa.Array) -> pa.Array:
        """Where white space is dropped and case folded anyway, line feeds are blanks and A-Z a-z."""
        return pc.ascii_lower(pc.replace_substring(texts, "\n", " ")) if self.drops_white else texts

    def unsafe(self, stretch: str) -> bool:
        """A mark may combine with a small letter but not with its capital, so folding comes too early for it."""
        return self.drops_white and not unicodedata.is_normalized("NFC", stretch)

    def whole(self, texts: pa.Array) -> pa.Array | None:
        """Those that have a special token's string, or would after folding."""
        if not self.special:
            return None
        return functools.reduce(pc.or_, [pc.match_substring(texts, t, ignore_case=self.drops_white) for t in self.special])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _borders(self, joined: str) -> np.ndarray:
        """Where each of the stretches that are joined ends, in bytes as the library normalises them: white space, which only
        begins a stretch here, neither combines nor changes what stands beside it."""
        if self.drops_white and not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).lower()
        data = np.frombuffer(joined.encode(), np.uint8)
        starts = np.flatnonzero((data == 32) | (data == 10))
        return np.append(starts[1:], len(data)) - (np.arange(1, len(starts) + 1) if self.drops_white else 0)

    def _alone(self, new: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return {s: np.array(e.ids, "<u4").tobytes() for s, e in zip(new, found, strict=True)}

    def _together(self, new: list[str]) -> dict[str, bytes]:
        """As _alone, for stretches of one white character and what follows it; the library encodes them as one text, which is then cut by the bytes that tokens stand for."""
        joined = "".join(new)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends, borders = np.cumsum(self.spans[ids]), self._borders(joined)
        cuts = np.searchsorted(ends, borders)
        if not len(ids) or len(cuts) != len(new) or cuts[-1] != len(ids) - 1 or not np.array_equal(ends[cuts], borders):
            return self._alone(new)
        raw, cuts = ids.tobytes(), (4 * cuts + 4).tolist()
        return {s: raw[a:b] for s, a, b in zip(new, [0, *cuts], cuts, strict=False)}

    def learn(self, new: Set[str]) -> dict[str, bytes]:
        plain, others = [], []
        for s in new:
            (plain if len(s) > 1 and s[0] in " \n" and s[1] not in WHITES else others).append(s)
        out = self._alone(others)
        for at in range(0, len(plain), TOGETHER):
            out.update(self._together(plain[at : at + TOGETHER]))
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """This worker's encoder of the file; it lives until the worker does something else."""
    return Encoder(path)


LET_GO.append(encoder.cache_clear)
