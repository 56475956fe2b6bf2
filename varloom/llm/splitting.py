"""Splitting texts above a token limit at natural boundaries, with overlap between pieces.

A text is parsed into a tree: sections nested by the depth of their headings, blocks (paragraphs, quotes,
records, fenced and tagged parts), list items nested by indentation, lines, sentences, words, pre-tokens,
tokens. The tree is kept as the level of each boundary between pre-tokens: a boundary opens a node of its
level, which reaches to the next boundary of that level or one above. A heading belongs to what follows
it, so the boundary below one is no better than between words; nothing inside a fence is a heading or item.

Sibling subtrees merge into a piece while they fit, from the finest level up; a node is descended into only
where it is too large for what is left of a piece that isn't well filled yet. So a piece ends at the highest
boundary among those that fill it well, and inside a word only where the word alone is too large.

Sizes are tokens of the whole text's own encoding; a piece encoded alone keeps the limit too. Each piece after the first begins exactly the
overlap's tokens before the end of the piece before it. Where a token's edge lies inside a character,
cuts move to the character's edge; an overlap that begins inside one takes the whole character into
``text``.

Defined results: null and empty texts and texts within the limit give no pieces; repeated documents
give theirs again; an empty table gives no rows; a piece that can't keep the limit encoded alone is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.spread import spread
from .bpe import VOCABULARY, Encoder, Measure, in_parts, load

#: Levels of the tree from the top (headings have six); a cut's kind is the level of its boundary.
KINDS = ("section",) * 6 + ("paragraph", "item", "item", "line", "sentence", "word", "part", "token")
SECTION, BLOCK, ITEM, SUBITEM, LINE, SENTENCE, WORD, PART, TOKEN = 0, *range(6, 14)
#: Characters that end a sentence before a blank, and those that end it anywhere.
ENDERS, WIDE_ENDERS = ".!?…", "。！？"
#: What begins headings, list items and fences.
HEADING, BULLETS, FENCES = "=#", ("-", "*", "+", "•", "–", "‣"), ("```", "~~~")
#: Fixed pattern: the end of a line; a paragraph separator counts as two.
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
#: Fewest tokens of new text a piece must be able to hold: no character has more.
LEAST = 8
#: Share of its room from which a piece counts as well filled.
WELL = 0.75

# a pre-token's meaning, 12 bits: newlines (up to 2), kinds, blanks after the last newline (up to 3), mark
_BLANK, _LEADING, _ENDS, _WIDE, _TAIL, _MARK = 4, 8, 16, 32, 6, 8
_ENDS_CR, _BEGINS_LF = 1, 2  # marks of blanks: a line's end may lie in two pre-tokens
_BULLET, _FENCE, _QUOTE, _TAG, _NUMBER, _POINT, _UPPER = range(7, 14)


def _mark(bare: str) -> int:
    """What a pre-token means where it begins a line: a heading's depth 1 to 6, or one of the marks."""
    c = bare[0]
    if c in HEADING and len(bare) <= 6 and bare == c * len(bare):
        return len(bare)
    if bare in BULLETS:
        return _BULLET
    if bare.startswith(FENCES):
        return _FENCE
    if c == ">":
        return _QUOTE
    if c == "<" and bare[1:2] != "/":
        return _TAG
    if len(bare) <= 3 and bare.isascii() and bare.isdigit():
        return _NUMBER
    if bare in (".", ")"):
        return _POINT
    return _UPPER if len(bare) >= 3 and bare.isupper() else 0


def describe(token: str, n: int) -> int:
    """Pre-token in one integer: tokens << 39 | characters << 12 | what it means for the text's structure."""
    if token.isspace():
        ends = list(_LINE_END.finditer(token))
        tail = len(token) - ends[-1].end() if ends else len(token)
        flags = min(2, sum(1 + (e.group() == "\u2029") for e in ends)) | _BLANK | min(3, tail) << _TAIL
        flags |= ((token[-1] == "\r") * _ENDS_CR + (token[0] == "\n") * _BEGINS_LF) << _MARK
    else:
        flags = _LEADING if token[0].isspace() else 0
        bare = token.strip()
        if any(c in ENDERS for c in bare) and not bare[0].isalnum():
            flags |= _ENDS
        if bare[-1] in WIDE_ENDERS:
            flags |= _WIDE
        flags |= _mark(bare) << _MARK
    return n << 39 | len(token) << 12 | flags


def _line_levels(flags: np.ndarray, at: np.ndarray, text: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of the boundary before each line's first pre-token that isn't blank, and whether the line is numbered:
    ``at`` their places, ``text`` their texts, ``lines`` the newlines before."""
    padded, ahead = np.r_[flags, np.full(2, _BLANK)], np.r_[np.zeros(2, flags.dtype), flags]
    mark = flags[at] >> _MARK
    second, third = padded[at + 1], padded[at + 2]
    apart = (second & (_BLANK | _LEADING)) > 0
    before, earlier = np.where(lines > 0, ahead[at + 1], 0), np.where(lines > 0, ahead[at], 0)
    indent = np.where(before & _BLANK, before >> _TAIL & 3, 0) + ((flags[at] & _LEADING) > 0)
    indent += np.where((before & _BLANK > 0) & (before & 3 == 0) & (earlier & _BLANK > 0), earlier >> _TAIL & 3, 0)
    same = np.r_[False, text[1:] == text[:-1]]  # the line before is of the same text

    def last(x: np.ndarray) -> np.ndarray:
        return np.r_[False, x[:-1]] & same

    fence = mark == _FENCE
    fences = np.cumsum(fence) - fence
    inside = (fences - np.maximum.accumulate(np.where(same, 0, fences)) & 1) > 0
    free = ~inside & ~fence
    numbered = (mark == _NUMBER) & (second >> _MARK == _POINT) & ((second & _LEADING) == 0)
    titled = free & numbered & (third >> _MARK == _UPPER) & (indent == 0)
    heading = free & (((mark >= 1) & (mark <= 6) & apart & (indent == 0)) | titled)
    item = free & ~heading & (((mark == _BULLET) & apart) | (numbered & ((third & (_BLANK | _LEADING)) > 0)))
    quote = free & (mark == _QUOTE) & apart
    opens = free & (((mark == _QUOTE) | (mark == _TAG)) & ~apart)
    level = np.full(len(at), LINE, np.int8)
    level[item] = ITEM
    level[(lines >= 2) | (quote != last(quote)) | opens | (fence & ~inside) | last(fence & inside)] = BLOCK
    level[item & (indent > 0)] = SUBITEM
    level[inside] = LINE
    level[heading] = np.where(titled, 5, mark - 1)[heading]
    level[last(heading)] = WORD
    level[~same] = SECTION
    return level, numbered & (titled | item)


def levels(packed: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The level of the boundary before each pre-token of several texts laid end to end."""
    n = len(packed)
    flags = packed & 0xFFF
    blank = (flags & _BLANK) > 0
    newlines = np.zeros(n + 1, np.int64)
    halves = np.r_[blank[:-1] & blank[1:] & ((flags[:-1] >> _MARK & _ENDS_CR) > 0) & ((flags[1:] >> _MARK & _BEGINS_LF) > 0), False]
    np.cumsum((flags & 3) - halves, out=newlines[1:])
    own = np.repeat(begins, sizes)
    here = np.arange(n)
    solid = np.maximum.accumulate(np.where(blank, -1, here))  # the last pre-token up to each that isn't blank
    before = np.r_[-1, solid[:-1]]
    known = before >= own  # else there is none in this text
    since = np.where(known, before + 1, own)
    lines = newlines[:-1] - newlines[since]
    gap = (here > since) | ((flags & _LEADING) > 0)
    earlier = np.where(known, flags[np.maximum(before, 0)], 0)
    level = np.full(n, PART, np.int8)
    level[gap] = WORD
    level[((earlier & _WIDE) > 0) | (((earlier & _ENDS) > 0) & gap)] = SENTENCE
    at = np.flatnonzero(~blank & ((lines >= 1) | ~known))
    if len(at):
        level[at], numbered = _line_levels(flags, at, own[at], lines[at])
        third = at[numbered] + 2
        third = third[third < n]
        level[third[level[third] == SENTENCE]] = WORD  # the point of a number ends no sentence
    level[blank] = PART  # blanks stay with what they follow
    level[begins[sizes > 0]] = SECTION
    return level


class Tree:
    """One text: the level of the boundary before each pre-token, tokens and characters before it."""

    def __init__(self, encoder: Encoder, tokens: list[str], packed: np.ndarray, level: np.ndarray | None = None) -> None:
        self.encoder, self.tokens = encoder, tokens
        if level is None:
            level = levels(packed, np.zeros(1, np.int64), np.array([len(tokens)]))
        self.levels = level.tobytes() + bytes([SECTION])
        # lists, as single look-ups are far quicker there than in arrays
        self.upto = [0, *np.cumsum(packed >> 39).tolist()]
        self.chars = [0, *np.cumsum((packed >> 12) & 0x7FFFFFF).tolist()]
        self._inside: dict[int, tuple[list[int], list[int]]] = {}
        self._alone: dict[tuple[int, int], int] = {}

    def inside(self, token: int) -> tuple[list[int], list[int]]:
        """At each edge of a pre-token's tokens the whole characters up to it; and the edges that are a character's."""
        found = self._inside.get(token)
        if found is None:
            text = self.tokens[token]
            ids = np.frombuffer(self.encoder[text], np.int32)
            edges = [0, *accumulate(self.encoder.widths[ids].tolist())]
            starts = [0, *accumulate(len(c.encode()) for c in text)] if not text.isascii() else range(len(text) + 1)
            shown = [bisect_right(starts, e) - 1 for e in edges]
            found = self._inside[token] = shown, [i for i, (c, e) in enumerate(zip(shown, edges)) if starts[c] == e]
        return found

    def cut(self, start: int, room: int) -> tuple[int, int, int]:
        """Where a piece of new text from token ``start`` of at most ``room`` tokens ends: (tokens, characters, level)."""
        upto, levels = self.upto, self.levels
        if upto[-1] - start <= room:
            return upto[-1], self.chars[-1], SECTION
        high = bisect_right(upto, start + room) - 1
        low = bisect_left(upto, start + max(1, int(WELL * room)), 0, high + 1)
        # sibling subtrees up to the furthest boundary of the highest level that fills the piece well
        best = min(levels[low : high + 1], default=TOKEN)
        if best < PART:
            at = levels.rfind(best, low, high + 1)
            return upto[at], self.chars[at], best
        # a word reaches over all of that: it moves to the next piece, unless it alone is too large
        first = bisect_right(upto, start, 0, low)
        near = min(levels[first:low], default=TOKEN)
        if near < PART:
            word = next(i for i in range(low - 1, first - 1, -1) if levels[i] < PART)
            stop = high + 1
            while levels[stop] >= PART and upto[stop] - upto[word] <= room:
                stop += 1
            if upto[stop] - upto[word] <= room:
                at = levels.rfind(near, first, low)
                return upto[at], self.chars[at], near
        if upto[high] > start and (low <= high or upto[high + 1] - upto[high] <= room):
            return upto[high], self.chars[high], levels[high]
        # a pre-token is too large itself: at the furthest character's edge inside it
        shown, edges = self.inside(high)
        base = upto[high]
        k = bisect_right(edges, start + room - base) - 1
        if base + edges[k] <= start:
            k += 1  # one character takes more tokens than the room
        at = edges[k]
        if at == len(shown) - 1:
            return upto[high + 1], self.chars[high + 1], levels[high + 1]
        return base + at, self.chars[high] + shown[at], TOKEN

    def character(self, token_at: int) -> int:
        """The character that holds the beginning of a token."""
        k = bisect_right(self.upto, token_at) - 1
        if self.upto[k] == token_at:
            return self.chars[k]
        return self.chars[k] + self.inside(k)[0][token_at - self.upto[k]]

    def alone(self, first: int, end: int) -> int:
        """By how many tokens a piece differs from its own encoding: the parts of pre-tokens it begins or ends
        in, encoded alone, against their tokens here."""
        upto = self.upto
        a, b = bisect_right(upto, first) - 1, bisect_right(upto, end) - 1
        if upto[a] == first and upto[b] == end:
            return 0
        found = self._alone.get((first, end))
        if found is None:
            found = 0
            head = self.inside(a)[0][first - upto[a]]
            tail = self.inside(b)[0][end - upto[b]] if upto[b] != end else 0
            if a == b:
                found = (len(self.encoder[self.tokens[a][head:tail]]) >> 2) - (end - first)
            else:
                if upto[a] != first:
                    found += (len(self.encoder[self.tokens[a][head:]]) >> 2) - (upto[a + 1] - first)
                if upto[b] != end:
                    found += (len(self.encoder[self.tokens[b][:tail]]) >> 2) - (end - upto[b])
            self._alone[first, end] = found
        return found


def pieces(tree: Tree, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, str]]:
    """(first token, tokens, overlapping tokens, first character, end character, kind of the end) per piece.

    A piece's text encoded alone keeps the limit too: one that begins or ends inside a pre-token and would
    exceed it so is cut shorter, by itself.
    """
    out: list[tuple[int, int, int, int, int, str]] = []
    start, total = 0, tree.upto[-1]
    while start < total:
        first = max(0, start - overlap) if out else 0
        begin = out[-1][4] if out and first == start else tree.character(first)
        room, last = limit - (start - first), -1
        while True:
            end, chars, level = tree.cut(start, room)
            over = end - first + tree.alone(first, end) - limit
            if over <= 0:
                break
            if end == last or room <= 1:
                raise ValueError(f"no piece from token {first} on keeps the limit of {limit} tokens encoded alone")
            last, room = end, max(1, min(end - start, room) - max(1, over))
        out.append((first, end - first, start - first, begin, chars, KINDS[level]))
        start = end
    if out:
        out[-1] = (*out[-1][:5], "end")
    return out


def split_documents(df: DataFrame, limits: dict[int, tuple[int, int]], id_col: str = "doc_id", text_col: str = "text",
                    vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of each text above a limit; ``limits``: limit_id -> (most tokens, overlap).

    Columns: limit_id, the id, piece_no from 1, first_token, n_tokens, n_overlap, first_char, end_char,
    cut (the boundary at the piece's end) and text. A map over the table; only one of fewer parts than cores is dealt out first.
    """
    for most, overlap in limits.values():
        if overlap < 0 or most - overlap < LEAST:
            raise ValueError(f"a limit must exceed its overlap by at least {LEAST} tokens")
    names = ["limit_id", id_col, "piece_no", "first_token", "n_tokens", "n_overlap", "first_char", "end_char", "cut", "text"]
    if len(set(names)) < len(names):
        raise ValueError("the id column would clash with the result's columns")
    least = min((most for most, _ in limits.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        look = Measure(encoder, describe).__getitem__
        for batch in batches:
            for begin, texts in in_parts(batch.column(1)):
                # a token has a byte at least, so shorter texts can't be above a limit
                lists = encoder.cut([t if t and (len(t) > least or len(t.encode()) > least) else None for t in texts])
                sizes = np.array([len(tokens) for tokens in lists])
                if not sizes.any():
                    continue
                begins = np.cumsum(sizes) - sizes
                packed = np.fromiter(map(look, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
                level = levels(packed, begins, sizes)
                upto = np.r_[0, np.cumsum(packed >> 39)]
                totals = (upto[begins + sizes] - upto[begins]).tolist()
                rows, which, cols = [], [], [[] for _ in names[2:]]
                for i in np.flatnonzero(np.array(totals) > least).tolist():
                    span = slice(begins[i], begins[i] + sizes[i])
                    tree, text = Tree(encoder, lists[i], packed[span], level[span]), texts[i]
                    for limit_id, (most, overlap) in limits.items():
                        if totals[i] > most:
                            found = pieces(tree, most, overlap)
                            rows += [begin + i] * len(found)
                            which += [limit_id] * len(found)
                            for column, values in zip(cols, (range(1, len(found) + 1), *zip(*found), [text[p[3] : p[4]] for p in found])):
                                column += values
                if rows:
                    yield emit(batch, rows, which, cols)

    def emit(batch: pa.RecordBatch, rows: list[int], which: list[int], cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())),
             *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"limit_id bigint, `{id_col}` {kind}, " + ", ".join(
        f"{c} bigint" for c in names[2:8]) + ", cut string, text string")
