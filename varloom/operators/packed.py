"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton finds the known whole values of a field, dynamic programming picks the
cheapest cover of the field by values. Delimiters inside a legitimate value (a known phrase, an
allele with its frequency, quoted text) are protected because the value covers them.

The dictionary holds *shapes*: values with each run of digits as ``0`` and each allele before a bar as
``A``, so that one word stands for all numbers. Words are learned from the table (text that is quoted
somewhere, neighbours that never occur apart) and built from the rule that an allele and its frequency
are one value however the number is written. Fields of one shape have one cover, so covers are remembered.

Defined results: null, empty and blank fields give no rows; a field of one value gives that value
with number 1 (``min_items`` leaves such fields out); empty places take no number; repeated rows give
their values again; columns other than the two named are never read, so clashing names can't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.cut import cut
from ..plans.spread import spread

#: The delimiters. Runs of them, blanks included, separate two values.
DELIMITERS = ("::", ",", ";", "/", "|", "&", "；", "，")
#: Opening quote and its closing quote.
QUOTES = {'"': '"', "'": "'", "“": "”"}
#: Fixed patterns: what a shape writes as 0 and as A (an allele that begins a word and stands before a bar).
DIGITS, ALLELE = r"[0-9]+", r"(?<![A-Za-z0-9_])[ACGTNacgtn]+(?=\|)"
#: Shapes of alleles and the parts of a number in any spelling (decimal comma, exponent, per cent).
ALLELES, BOUNDS, SIGNS = ("A", "-", "*"), ("", "<", ">", "~"), ("", "+", "-")
MANTISSAS, EXPONENTS, UNITS = ("0", "0.0", "0,0", ".0", ",0"), ("", "e0", "e-0", "e+0", "E0", "E-0", "E+0"), ("", "%")
#: Fixed pattern: an identifier's shape.
IDENTIFIER = r"rs-?0"

#: Costs of a value in a cover.
KNOWN, UNKNOWN, QUOTED = 1.0, 3.0, 0.5
#: Share of each part's occurrences that must lie in a learned value.
TOGETHER = 0.9
#: Most words sent to the tasks; more is an error, never a cut.
MAX_WORDS = 200_000
#: Characters of shapes a worker remembers the covers of before it begins anew.
REMEMBER_CHARS = 8_000_000


def _delimiter_pattern(delimiters: tuple[str, ...]) -> str:
    return r"(?:\s|" + "|".join(map(re.escape, sorted(delimiters, key=len, reverse=True))) + ")+"


def frequency_words() -> frozenset[str]:
    """The shapes of an allele and its frequency, from the rule."""
    return frozenset(a + "|" + "".join(number) for a, *number in product(ALLELES, BOUNDS, SIGNS, MANTISSAS, EXPONENTS, UNITS))


_DIGITS, _ALLELE = re.compile(DIGITS), re.compile(ALLELE)


def shape_of(text: str) -> str:
    """A value or field with its numbers and alleles replaced; delimiters and quotes stay where they are."""
    shape = _DIGITS.sub("0", text)
    return _ALLELE.sub("A", shape) if "|" in shape else shape


class Segmenter:
    """Splits one field into values. ``known`` holds shapes of whole values that may contain delimiters."""

    def __init__(self, known: Iterable[str], delimiters: tuple[str, ...] = DELIMITERS) -> None:
        import ahocorasick

        self._gap = re.compile(_delimiter_pattern(delimiters))
        self._parts = re.compile(f"({_delimiter_pattern(delimiters)})").split
        self._known = frozenset(map(shape_of, known))
        self._automaton = None
        phrases = [w for w in self._known if self._gap.search(w)]
        if phrases:
            self._automaton = ahocorasick.Automaton()
            for w in phrases:
                self._automaton.add_word(w, len(w))
            self._automaton.make_automaton()
        self._longest = max(map(len, self._known), default=0) + 2
        self._identifier = re.compile(IDENTIFIER)
        self._covers: dict[str, list[tuple[int, int, bool]] | None] = {}
        self._held = 0

    def _quoted(self, text: str, begin: int, ends: dict[int, int]) -> Iterator[int]:
        """Where quoted text from ``begin`` closes: the first closing quote at a value's end, and
        later ones if what they enclose is a known value (which then holds a quote itself)."""
        close, at, closed = QUOTES[text[begin]], begin + 1, False
        while True:
            at = text.find(close, at)
            if at < 0:
                return
            slashes = 0
            while text[at - 1 - slashes] == "\\" and at - 1 - slashes > begin:
                slashes += 1
            if slashes % 2:
                at += 1
            elif close == '"' and text[at + 1 : at + 2] == '"':
                at += 2
            else:
                at += 1
                if at in ends:
                    if not closed or text[begin + 1 : at - 1] in self._known:
                        yield at
                    if closed and at - begin > self._longest:
                        return
                    closed = True

    def atoms(self, text: str) -> tuple[list[int], list[int]]:
        """Where the text between delimiters begins and stops."""
        edges = [0, *accumulate(map(len, self._parts(text)))]
        begins, stops = edges[:-1:2], edges[1::2]
        if begins[-1] == stops[-1]:  # a delimiter at the end, or no text
            begins.pop(), stops.pop()
        if begins and begins[0] == stops[0]:
            return begins[1:], stops[1:]
        return begins, stops

    def cover(self, shape: str) -> list[tuple[int, int, bool]] | None:
        """The cheapest cover of a shape: (first atom, last atom, quoted) of each value in order, None if each atom is one."""
        begins, stops = self.atoms(shape)
        n = len(begins)
        first = {b: i for i, b in enumerate(begins)}
        last = {e: i for i, e in enumerate(stops)}
        wide: dict[int, list[tuple[int, float, bool]]] = {}
        if self._automaton is not None and n > 1:
            for end, size in self._automaton.iter(shape):
                i, j = first.get(end + 1 - size), last.get(end + 1)
                if i is not None and j is not None:
                    wide.setdefault(i, []).append((j, KNOWN, False))
        for i, b in enumerate(begins):
            if shape[b] in QUOTES:
                for end in self._quoted(shape, b, last):
                    wide.setdefault(i, []).append((last[end], QUOTED, True))
        if not wide:
            return None
        best: list[tuple[float, int, bool]] = [(0.0, -1, False)] + [(float("inf"), -1, False)] * n
        known, identifier = self._known, self._identifier
        for i in range(n):
            here = best[i][0]
            if here == float("inf"):
                continue
            atom = shape[begins[i] : stops[i]]
            cost = here + (KNOWN if atom in known or identifier.fullmatch(atom) else UNKNOWN)
            if cost < best[i + 1][0]:
                best[i + 1] = (cost, i, False)
            for j, extra, quoted in wide.get(i, ()):
                if here + extra < best[j + 1][0]:
                    best[j + 1] = (here + extra, i, quoted)
        out, j = [], n
        while j > 0:
            _, i, quoted = best[j]
            out.append((i, j - 1, quoted))
            j = i
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """The values of a field as written, quotes around them removed and quotes inside restored."""
        shape = shape_of(text)
        try:
            cover = self._covers[shape]
        except KeyError:
            cover = self.cover(shape)
            if self._held > REMEMBER_CHARS:
                self._covers.clear()
                self._held = 0
            self._covers[shape] = cover
            self._held += len(shape) + 100
        parts = self._parts(text)
        if cover is None:
            return [x for x in parts[::2] if x]
        out, lead = [], 0 if parts[0] else 2
        for i, j, quoted in cover:
            value = parts[lead + 2 * i] if i == j else "".join(parts[lead + 2 * i : lead + 2 * j + 1])
            if quoted:
                mark = value[-1]
                value = value[1:-1].replace("\\" + mark, mark)
                if mark == '"':
                    value = value.replace('""', '"')
                if not value:
                    continue
            out.append(value)
        return out


def _jvm_gap(delimiters: tuple[str, ...] = DELIMITERS) -> str:
    """The delimiters for the JVM, which needs to be told that blanks are Unicode's."""
    return r"(?U)(?:[\s\x1c-\x1f]|" + "|".join(f"\\Q{d}\\E" for d in sorted(delimiters, key=len, reverse=True)) + ")+"


def _count_words(segmenter: Segmenter, shapes: Counter, k: int) -> Counter:
    """Occurrences of (parts, word): single parts, ``k`` neighbouring ones, and text in quotes that holds delimiters (0 parts)."""
    words: Counter = Counter()
    for shape, n in shapes.items():
        begins, stops = segmenter.atoms(shape)
        cover = segmenter.cover(shape) if begins else None
        if cover is None or not any(quoted for _, _, quoted in cover):
            for b, e in zip(begins, stops):
                words[1, shape[b:e]] += n
            for b, e in zip(begins, stops[k - 1 :]):
                words[k, shape[b:e]] += n
        elif k == 2:
            for i, j, quoted in cover:
                if quoted and j > i:
                    mark = shape[stops[j] - 1]
                    words[0, shape[begins[i] + 1 : stops[j] - 1].replace("\\" + mark, mark).replace('""', '"')] += n
    return words


def learn_dictionary(df: DataFrame, value_col: str, min_support: int = 3, together: float = TOGETHER, max_words: int = MAX_WORDS) -> dict[str, int]:
    """Shapes of whole values that hold delimiters, with counts.

    A word is what quotes enclose somewhere, or neighbours that never occur apart: at least the share ``together`` of
    all occurrences of each part lies in the word. It must occur ``min_support`` times, whatever the table's size, be of
    any length, hold no identifier (that is a value of its own) and not fall apart into values that are each as frequent
    between delimiters as the word. Tasks count the words of the shapes they meet and shuffle these counts only. More
    words than ``max_words`` are an error.
    """
    texts = spread(df.select(F.col(value_col).alias("v")).where("v IS NOT NULL"))
    gap = _jvm_gap()

    def counts(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segmenter, shapes = Segmenter(()), Counter()

            def flush() -> pa.RecordBatch:
                words = _count_words(segmenter, shapes, k)
                shapes.clear()
                parts = [p for p, _ in words]
                return pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array([w for _, w in words], pa.string()), pa.array(list(words.values()), pa.int64())], ["parts", "w", "n"])

            held = 0
            for batch in batches:
                for text, n in Counter(map(shape_of, batch.column(0).to_pylist())).items():
                    if text not in shapes:
                        held += len(text) + 100
                    shapes[text] += n
                if held > REMEMBER_CHARS:
                    yield flush()
                    held = 0
            yield flush()

        return run

    def whole(k: int) -> list[list[str]]:
        words = texts.mapInArrow(counts(k), "parts int, w string, n bigint")
        counted = cut(words.groupBy("parts", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support)).withColumn("of", F.filter(F.split("w", gap), lambda x: x != ""))
        # words stay in the cluster until those that can't be whole are gone: each part's count comes by a join
        alone = counted.where("parts = 1").select(F.col("w").alias("p"), F.col("n").alias("alone"))
        several = counted.where("parts <> 1").where(~F.exists("of", lambda x: x.rlike(f"^{IDENTIFIER}$")))
        judged = several.select("parts", "w", "n", "of", F.explode("of").alias("p")).join(alone, "p", "left").groupBy("parts", "w", "of").agg(
            F.max("n").alias("n"), F.max(F.coalesce("alone", F.lit(0))).alias("most"), F.min(F.coalesce("alone", F.lit(0))).alias("least"))
        kept = judged.where(((F.col("parts") > 1) & (F.col("n") >= together * F.col("most"))) | ((F.col("parts") == 0) & (F.col("least") < F.col("n"))))
        found = kept.limit(max_words + 1).collect()
        words_of.update({r["w"]: max(r["n"], words_of.get(r["w"], 0)) for r in found})
        if len(words_of) > max_words:
            raise ValueError(f"more than {max_words} words: raise min_support or max_words")
        return [r["of"] for r in found if r["parts"] == k]

    words_of: dict[str, int] = {}
    k, last = 2, whole(2)
    # a word of k + 1 parts begins and ends with words of k parts
    while {tuple(of[1:]) for of in last} & {tuple(of[:-1]) for of in last}:
        k += 1
        last = whole(k)
    return words_of


def split_packed(df: DataFrame, id_col: str, value_col: str, dictionary: Iterable[str] | None = None,
                 min_items: int = 1, min_support: int = 3) -> DataFrame:
    """One row per value of ``value_col``: the id, ``item_no`` from 1 and ``item``.

    The dictionary is learned from the whole table (one pass over the column; only counts of words are
    shuffled) and joined by the words of alleles with frequencies, unless given. No other shuffle; fields
    without any delimiter never leave the JVM when ``min_items`` is above 1.
    """
    if id_col in ("item_no", "item"):
        raise ValueError("the id column would clash with the result's columns")
    pairs = df.select(F.col(id_col), F.col(value_col).alias("__value"))
    known = frozenset(learn_dictionary(pairs, "__value", min_support)) | frequency_words() if dictionary is None else frozenset(dictionary)
    pairs = pairs.where(F.col("__value").isNotNull())
    if min_items > 1:
        pairs = pairs.where(F.trim("__value").rlike(_jvm_gap()))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Segmenter(known).split
        for batch in batches:
            items: list[str] = []
            sizes: list[int] = []
            for text in batch.column(1).to_pylist():
                found = split(text)
                if len(found) < min_items:
                    found = []
                items += found
                sizes.append(len(found))
            rows = pa.array([i for i, k in enumerate(sizes) for _ in range(k)], pa.int64())
            numbers = pa.array([j for k in sizes for j in range(1, k + 1)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), numbers, pa.array(items, pa.string())], [id_col, "item_no", "item"])

    return spread(pairs).mapInArrow(run, f"`{id_col}` {kind}, item_no bigint, item string")
