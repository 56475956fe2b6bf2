"""Byte-level BPE over whole corpora with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's public pattern. Within a pre-token, buckets per
merge rank hold the positions of a linked list of parts, a three-level bitmap over the ranks finds
the lowest bucket in use by find-first-set, and entries whose pair has changed since are skipped. A
merge costs a few word operations whatever the pre-token's length, so one of a million characters
takes a million steps, not a million squared. Pre-tokens recur, so each worker keeps those it has met.

Defined results: null and empty texts have no ids (an empty list, not null); special tokens' strings
are ordinary text; repeated documents are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..plans.spread import spread

#: Where the public vocabularies lie, unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern: the pre-tokens of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens, and characters of them, a worker remembers before it begins anew.
REMEMBER, REMEMBER_CHARS = 300_000, 16_000_000
#: Characters of one batch of results.
BATCH_CHARS = 2_000_000


class Encoder(dict):
    """Pre-token -> its ids as bytes of 32-bit integers; missing ones are encoded on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.held = 0
        self.ranks = ranks
        most = max(ranks.values(), default=0)
        # the bitmap's lower levels, 64 ranks and 64 words a word; empty between calls
        self.low, self.middle = [0] * ((most >> 6) + 1), [0] * ((most >> 12) + 1)
        self.findall = regex.compile(PATTERN).findall
        self.widths = np.zeros(most + 1, np.int32)
        for piece, i in ranks.items():
            self.widths[i] = len(piece)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.merge_all([piece])[0]

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of several pre-tokens that are no tokens themselves, through one queue: pairs never reach over
        their edges, so each is merged as if alone. The queue's steps are written out: they run for every byte."""
        get = self.ranks.get
        piece = b"".join(pieces)
        size = len(piece)
        edge = bytearray(size + 1)  # 1 where a pre-token begins, and at the end
        begins = [0, *accumulate(map(len, pieces))]
        for i in begins:
            edge[i] = 1
        after = list(range(1, size + 1))  # the start of the next part
        before = list(range(-1, size - 1))
        rank_at: list[int | None] = [None] * size  # rank of the pair that begins here
        low, middle, top = self.low, self.middle, 0
        buckets: dict[int, list[int]] = {}
        for i in range(size - 1):
            rank = get(piece[i : i + 2])
            if rank is not None and not edge[i + 1]:
                rank_at[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so a heap as it is
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    middle[rank >> 12] |= 1 << ((rank >> 6) & 63)
                    top |= 1 << (rank >> 12)
        while top:
            # find first set, from the top level down: the lowest rank in use
            c = (top & -top).bit_length() - 1
            word = middle[c]
            b = (c << 6) | ((word & -word).bit_length() - 1)
            word = low[b]
            lowest = (b << 6) | ((word & -word).bit_length() - 1)
            bucket, least = buckets[lowest], lowest
            while bucket and least == lowest:  # its positions from the left, unless a lower rank appears
                i = heappop(bucket)
                if rank_at[i] != lowest:
                    continue  # stale: the pair has changed or is gone
                j = after[i]
                after[i] = k = after[j]
                rank_at[i] = rank_at[j] = None
                if not edge[k]:
                    before[k] = i
                    rank = get(piece[i : after[k]])
                    if rank is not None:
                        rank_at[i] = rank
                        if rank in buckets:
                            heappush(buckets[rank], i)
                        else:
                            buckets[rank] = [i]
                            low[rank >> 6] |= 1 << (rank & 63)
                            middle[rank >> 12] |= 1 << ((rank >> 6) & 63)
                            top |= 1 << (rank >> 12)
                            if rank < least:
                                least = rank
                if not edge[i]:
                    at = before[i]
                    rank_at[at] = rank = get(piece[at:k])
                    if rank is not None:
                        if rank in buckets:
                            heappush(buckets[rank], at)
                        else:
                            buckets[rank] = [at]
                            low[rank >> 6] |= 1 << (rank & 63)
                            middle[rank >> 12] |= 1 << ((rank >> 6) & 63)
                            top |= 1 << (rank >> 12)
                            if rank < least:
                                least = rank
            if not bucket:
                del buckets[lowest]
                low[b] &= ~(1 << (lowest & 63))
                if not low[b]:
                    middle[c] &= ~(1 << (b & 63))
                    if not middle[c]:
                        top &= ~(1 << c)
        out, ranks = [], self.ranks
        for i, end in zip(begins, begins[1:]):
            ids = []
            while i < end:
                ids.append(ranks[piece[i : after[i]]])
                i = after[i]
            out.append(ids)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Remembers the ids of all pre-tokens of some texts that aren't known yet, merged together."""
        if len(self) >= REMEMBER or self.held >= REMEMBER_CHARS:
            self.clear()
            self.held = 0
        ranks, odd = self.ranks, []
        for token in set().union(*texts).difference(self):
            self.held += len(token)
            piece = token.encode()
            whole = ranks.get(piece)
            if whole is None:
                odd.append((token, piece))
            else:
                self[token] = array("i", (whole,)).tobytes()
        if odd:
            for (token, _), ids in zip(odd, self.merge_all([p for _, p in odd])):
                self[token] = array("i", ids).tobytes()

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBER or self.held >= REMEMBER_CHARS:
            self.clear()
            self.held = 0
        self.held += len(token)
        self[token] = ids = array("i", self.merge(token.encode())).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, as bytes."""
        return b"".join(map(self.__getitem__, self.findall(text)))

    def cut(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of some texts, all of them learned."""
        out = [self.findall(t) if t else [] for t in texts]
        self.learn(out)
        return out


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, loaded once per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Encoder(ranks)


def in_parts(texts: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a column of texts of about ``chars`` characters, each with its first row."""
    begin, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        held.append(text)
        size += len(text) if text else 0
        if size >= chars:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The id and ``ids`` of each document. A map over the table; only one of fewer parts than cores is dealt out first."""
    if id_col == "ids":
        raise ValueError("the id column would clash with the result's columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        ids_of = encoder.__getitem__
        for batch in batches:
            for begin, texts in in_parts(batch.column(1)):
                found = [b"".join(map(ids_of, tokens)) for tokens in encoder.cut(texts)]
                offsets = np.cumsum([0, *(len(b) >> 2 for b in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), ids], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


class Measure(dict):
    """Pre-token -> number of its ids (or what ``describe`` makes of the pre-token and that number)."""

    def __init__(self, encoder: Encoder, describe: Callable[[str, int], int] | None = None) -> None:
        super().__init__()
        self.encoder, self.describe = encoder, describe

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = len(self.encoder[token]) >> 2
        self[token] = value = self.describe(token, n) if self.describe else n
        return value


def token_counts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of each document (0 for null and empty texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        measure = Measure(encoder)
        size = measure.__getitem__
        for batch in batches:
            counts = [sum(map(size, tokens)) for _, texts in in_parts(batch.column(len(keep))) for tokens in encoder.cut(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col)).mapInArrow(run, f"{kinds}, n_tokens bigint")
