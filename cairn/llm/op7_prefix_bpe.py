"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string only one token can end its encoding: the encoding of a prefix is the encoding of a
shorter prefix and one more token, and a token may follow another only where merging the two by rank would give just these
two. So `last[i]` holds the token that ends the encoding of the first i bytes. Its predecessor is `last[i - len]`, an append
continues from the end of the table, and an edit needs the table anew only from the token before it until old and new agree.
A text that is encoded once needs the entries on its way only: `encode` goes forward by the longest token that may follow, and back
from prefixes that nothing goes on from.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Set
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import LET_GO, batches, documents, slices, texts
from cairn.llm.tokens import Remembering

class PrefixBPE:
    """The vocabulary of a rank file: `ranks` maps each token's bytes to its id, which is also its rank.

    A table of a byte string is a list: entry i is the token that ends the encoding of the first i bytes (entry 0: None)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        #: The longest token's length by the first three bytes.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > self.reach.get(b[:3], 2):
                self.reach[b[:3]] = len(b)

    @classmethod
    def from_file(cls, path: str) -> PrefixBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte; (-1, -1) where no run of merges ends in this token."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = None if len(parts) < 2 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether left and right are the encoding of their bytes together.

        The merges that made both are undone, the latest first. At each step the tokens that touch at the border must not
        have a merge of their own that would have come before the merge undone last."""
        if (known := self.follows.get((left, right))) is not None:
            return known
        a, b, before, found = left, right, 1 << 60, True
        while found:
            found = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) >= before
            undo_a, undo_b = self.half(a), self.half(b)
            if undo_a is None and undo_b is None:
                break
            if undo_b is None or (undo_a is not None and a > b):
                before, a = a, undo_a[1]
            else:
                before, b = b + 1, undo_b[0]  # of equal merges the one further left comes first
        if len(self.follows) > 200_000:
            self.follows.clear()
        self.follows[left, right] = found
        return found

    def extend(self, data: bytes, table: list) -> list:
        """Fills `table`, made for a prefix of `data`, up to all of it, and returns it."""
        ranks, may, longest = self.ranks, self.follows, self.longest
        for end in range(len(table), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is None or (h := self.half(token)) is not None and h[0] < 0:
                    continue
                if start:
                    ok = may.get((table[start], token))
                    if not (self.may_follow(table[start], token) if ok is None else ok):
                        continue
                table.append(token)
                break
        return table

    def table(self, data: bytes) -> list:
        return self.extend(data, [None])

    def _longest(self, data: bytes, at: int, most: int) -> int | None:
        """The longest token of at most `most` bytes that is in `data` from `at` on and that merges can make."""
        for end in range(min(len(data), at + most), at, -1):
            token = self.ranks.get(data[at:end])
            if token is not None and ((h := self.half(token)) is None or h[0] >= 0):
                return token
        return None

    def encode(self, data: bytes) -> list[int]:
        """The encoding of `data`, without a table. Of each prefix that is reached the tokens so far are the encoding, so one from
        which no token leads on is in no encoding of more, and is not reached again."""
        may, reach, bytes_of, out, at, dead = self.follows, self.reach, self.bytes_of, [], 0, set()
        while at < len(data):
            token = self._longest(data, at, reach.get(data[at : at + 3], 2))
            while True:
                end = at + len(bytes_of[token])
                if end not in dead:
                    if not out:
                        break
                    ok = may.get((out[-1], token))
                    if self.may_follow(out[-1], token) if ok is None else ok:
                        break
                if token not in self.shorter:
                    self.shorter[token] = self._longest(bytes_of[token], 0, end - at - 1)
                if (token := self.shorter[token]) is None:
                    if not out:  # ranks that are not those of merges
                        return list(self.tokens(self.table(data)))
                    dead.add(at)
                    token = out.pop()
                    at -= len(bytes_of[token])
            out.append(token)
            at = end
        return out

    def tokens(self, table: list, end: int | None = None) -> tuple[int, ...]:
        """The encoding of the first `end` bytes (all without it), read backwards from the table."""
        out, at = [], len(table) - 1 if end is None else end
        while at:
            out.append(table[at])
            at -= len(self.bytes_of[table[at]])
        return tuple(reversed(out))

    def append(self, data: bytes, table: list, more: bytes) -> tuple[bytes, list]:
        """The string and its table with `more` at its end; what is there stays as it is."""
        return data + more, self.extend(data + more, list(table))

    def edit(self, data: bytes, table: list, start: int, stop: int, new: bytes) -> tuple[bytes, list]:
        """The string and its table after bytes start to stop - 1 become `new`.

        Entries up to `start` hold. After the edit, entries are made anew until as many in a row as the longest token has
        bytes are those of the old table: every later entry depends on these and on unchanged bytes alone."""
        changed = data[:start] + new + data[stop:]
        done, moved, same = list(table[: start + 1]), len(new) - (stop - start), 0
        while len(done) <= len(changed):
            self.extend(changed[: len(done)], done)
            at = len(done) - 1
            same = same + 1 if at > start + len(new) and done[at] == table[at - moved] else 0
            if same >= self.longest:
                done += table[at - moved + 1 :]
        return changed, done

    def decode(self, tokens) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


class PrefixEncoder(Remembering):
    """Whole texts, each match of the pattern by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__(kept=48 << 20)
        self.bpe, self.cut = PrefixBPE.from_file(path), regex.compile(pattern)
        size = max(self.bpe.bytes_of) + 1
        self.decimals, self.bytes = pa.array([str(i) for i in range(size)]), pa.array([self.bpe.bytes_of.get(i, b"") for i in range(size)], pa.binary())

    def learn(self, new: Set[str]) -> dict[str, bytes]:
        encode, cut, known = self.bpe.encode, self.cut.findall, {}

        def ids(match: str) -> bytes:
            if (x := known.get(match)) is None:
                got = encode(match.encode())
                x = known[match] = struct.pack(f"<{len(got)}I", *got)
            return x

        return {s: b"".join(map(ids, cut(s))) for s in new}

    def joined(self, ids: list[bytes], words: pa.Array, between) -> list:
        """For each text's ids, what `words` has for them, joined."""
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        flat = words.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(ends, flat) if len(flat) > 1 << 30 else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), between).to_pylist()


@cache
def encoder(path: str, pattern: str) -> PrefixEncoder:
    """This worker's encoder of the file; it lives until the worker does something else."""
    return PrefixEncoder(path, pattern)


LET_GO.append(encoder.cache_clear)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of each row's whole text (null: empty), however long. Each row has a row,
    repeated ones too; a null doc_id stays; other columns are ignored; an empty table gives none."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole, 8 << 20):
                yield pa.record_batch([batch.column(0), pa.array(encoder(ranks, pattern).encode(batch.column(1)), pa.binary())], names=["doc_id", "ids"])

    return batches(texts(docs), rows, "doc_id long, ids binary", 4000)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids of all documents and what they decode to, as digests."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for whole in it:
            for batch in slices(whole):
                ids = batch.column(1).to_pylist()
                listed = [hashlib.sha256(x.encode()).hexdigest() for x in own.joined(ids, own.decimals, ",")]
                decoded = [hashlib.sha256(x).hexdigest() for x in own.joined(ids, own.bytes, b"")]
                yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batches(encode(documents(spark, sf_dir), ranks, pattern), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 4000)


QUERIES = {"op7_prefix_bpe": query}
