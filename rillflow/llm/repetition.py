"""Quality rules: repeated passages within a text, by a suffix array over its words.

``repetition_rules`` adds to every document the measures of one text. Its suffix array orders the suffixes of the word
sequence (prefix doubling over all texts of a batch at once; only suffixes that are still tied are sorted again). The
ranks of each doubling give the longest common prefix of neighbours by binary lifting. The deepest LCP interval that
holds a suffix has the greater of its two neighbouring values: that many words, from there, occur elsewhere in the text
too. Those that no longer span from the word before covers are the maximal repeated substrings; the union of their
spans is the covered part.

A text fails the method when its repeats of ``min_words`` or more cover over ``most_covered`` of its words, or when
the longest of them has over ``most_longest`` words and over ``most_share`` of the text. The share is well below half of what
may be covered, so a text can fail by one long passage that it has twice.

Defined results: a null text counts as an empty one; an empty text has no words, nothing repeated, and fails the base
(fewer than 20 words). Texts of any length are read whole. Equal rows get equal results. Columns beyond those named
are carried along; a column that has the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import split_words, text_chunks

#: What a batch of suffixes holds at most, in bytes of text; a longer text stands alone.
CHUNK_BYTES = 3_000_000

MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_covered_words", T.LongType()),
        T.StructField("longest_repeat", T.LongType()),
        # places at which a maximal repeated substring stands
        T.StructField("n_maximal_repeats", T.LongType()),
    ]
)


def suffix_array(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, text by text, and their ranks by the first 1, 2, 4, ... words.

    start, end: of the text that each word is in.
    """
    n = len(codes)
    key = start * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    levels = []

    def ranked(where: np.ndarray, keys: np.ndarray, base: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank by ``keys``, which are sorted at ``where`` of the order; returns where ties are left."""
        new = np.ones(len(where), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(new, where, 0)) if base is None else where[np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))]
        rank[order[where]] = first
        tied = ~new
        tied[:-1] |= ~new[1:]
        return where[tied]

    rank = np.empty(n, dtype=np.int64)
    where = np.arange(n)
    where = ranked(where, key[order], None, rank)
    levels.append(rank.astype(np.int32))
    h = 1
    while len(where):
        at = order[where]
        after = at + h
        inside = after < end[at]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        perm = np.argsort(key, kind="stable")
        order[where] = at[perm]
        rank = rank.copy()
        where = ranked(where, key[perm], where, rank)
        levels.append(rank.astype(np.int32))
        h *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix in the order shares with the one before it (of the same text)."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    length = np.zeros(len(at), dtype=np.int64)
    stop_a, stop_b = end[a], end[b]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < stop_a) & (y < stop_b)
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += same * (1 << k)
    out[at] = length
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words is in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(codes: np.ndarray, offsets: np.ndarray, min_words: int, window: int = 8) -> dict[str, np.ndarray]:
    """Per text: words in repeated windows, words in repeats of min_words or more, the longest, and the maximal ones."""
    n, texts = len(codes), len(offsets) - 1
    zero = np.zeros(texts, dtype=np.int64)
    if not n:
        return {"window": zero, "covered": zero, "longest": zero, "maximal": zero}
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(texts), lengths)
    start, end = offsets[text], offsets[text + 1]
    order, levels = suffix_array(codes, start, end)
    lcp = common_prefixes(order, levels, end)
    longest = np.zeros(n, dtype=np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    per_text = lambda x: np.bincount(text, weights=x, minlength=texts).astype(np.int64)
    from_window = np.flatnonzero(longest >= window)
    from_any = np.flatnonzero(longest >= min_words)
    before = np.where(from_any > start[from_any], longest[from_any - 1], 0)
    maximal = from_any[before <= longest[from_any]]
    most = zero.copy()
    np.maximum.at(most, text[from_any], longest[from_any])
    return {
        "window": per_text(covered(from_window, np.full(len(from_window), window), n)),
        "covered": per_text(covered(maximal, longest[maximal], n)),
        "longest": most,
        "maximal": np.bincount(text[maximal], minlength=texts).astype(np.int64),
    }


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if text.count("\n") == 0:
        return 0
    lines = text.encode().split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    real = [x for x in lines if x.strip(b" \t\n\v\f\r")]
    return len(real) - len(set(real))


def measured(texts: pa.Array, min_words: int) -> dict[str, np.ndarray]:
    """The measures of each text."""
    texts = pc.fill_null(texts, "")
    codes, offsets, _ = split_words(texts)
    found = repeats(codes, offsets, min_words)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": np.diff(offsets),
        "word_chars": chars - count("[ \\t\\n\\v\\f\\r]"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": np.fromiter(map(dup_lines, texts.to_pylist()), dtype=np.int64, count=len(texts)),
        "n_repeat_words": found["window"],
        "n_covered_words": found["covered"],
        "longest_repeat": found["longest"],
        "n_maximal_repeats": found["maximal"],
    }


def repetition_rules(docs: DataFrame, text: str = "text", min_words: int = 5, most_covered: float = 0.35, most_longest: int = 40, most_share: float = 0.1) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to each document. One pass, no shuffle."""
    rest = [f for f in docs.schema.fields if f.name not in {*MEASURES.names, "base_failed", "kept"}]
    names = [f.name for f in rest]

    def measure(batches):
        for batch in batches:
            for at, stop in text_chunks(batch.column(names.index(text)), CHUNK_BYTES):
                part = batch.slice(at, stop - at)
                found = measured(part.column(names.index(text)), min_words)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[k], pa.int64()) for k in MEASURES.names)], names=[*names, *MEASURES.names])

    out = docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(measure, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rest), *MEASURES.fields]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = (F.col("n_covered_words") <= most_covered * F.col("n_words")) & ~((F.col("longest_repeat") > most_longest) & (F.col("longest_repeat") > most_share * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
