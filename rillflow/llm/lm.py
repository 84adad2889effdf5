"""Scoring of texts by a byte language model that mixes contexts of all depths (context-tree weighting).

``score`` learns from the rows that are not held out and gives every text the log10 probability of its bytes (A-Z in
lower case) and an end mark, beside a word model with add-one counts. Steps:

1. Tasks cut their texts into blocks and write one row with a block's texts, and for each part its distinct words and its
   distinct grams (a symbol and the ``depth`` symbols before) with their counts in the training rows. Words go to the part
   of their hash, grams to that of the two symbols of context next to them, so that a part holds whole trees of contexts.
2. Parts sum the counts of all blocks. A part that gets much is first summed in as many shares of its blocks as its bytes
   need, so that no task holds what all blocks send to a frequent context. Trees are weighted from the full depth up to
   two symbols of context. What is above has at most 257 contexts of 512 nodes, whatever the input, and is summed apart.
3. Parts work out the log probability of each gram, and answer every block, again in shares of the blocks.
4. A block meets its answers and adds them up along its texts.

Nothing is kept per corpus but the distinct words and grams, dealt over the parts. Log probabilities travel rounded to 37
bits, an error below 1e-11 of each, and are summed in double precision.

Defined results: a null text counts as an empty one, whose score is that of the end mark alone. A null key counts as the
empty text for the split. Texts of any length are read whole. Equal rows get equal results. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import ctw
from rillflow.llm.bpe import MOST_BROADCAST, first_rows, packed, packed_words, unpacked, unpacked_words
from rillflow.llm.common import checkpointed, mixed, parts_for, split_words, text_chunks, tidy, word_hashes

BLOCK_BYTES = 5_000_000
#: Packed bytes of grams that one share of a part's blocks has, about.
SHARE_BYTES = 8_000_000
#: Grams that a block looks up at once.
LOOKUP = 500_000
TEXTS, WORDS, GRAMS = 0, 1, 2


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit integers as differences, byte plane by byte plane."""
    return squeeze(np.ascontiguousarray(np.diff(x, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T))


def unpacked_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(spread(x), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def packed_logs(x: np.ndarray) -> bytes:
    """Doubles without their last 16 bits, rounded, byte plane by byte plane."""
    return squeeze(np.ascontiguousarray((x.astype("<f8").view("<i8") + (1 << 15)).view(np.uint8).reshape(-1, 8)[:, 2:].T))


def unpacked_logs(x: bytes) -> np.ndarray:
    planes = np.frombuffer(spread(x), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return out.view("<f8").ravel()


def part_of_gram(code: np.ndarray, depth: int, parts: int) -> np.ndarray:
    return (mixed((code >> (ctw.BITS * (depth - 1))).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def stream_of(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, each with its end mark, and where each text's begin."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(texts)) * (depth + 1) + np.cumsum(lengths) - lengths + depth  # where each text's symbols begin
    stream = np.full(int(lengths.sum()) + len(texts) * (depth + 1), ctw.END, np.int16)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    begin = np.cumsum(lengths) - lengths
    for k, (a, n) in enumerate(zip(at.tolist(), lengths.tolist(), strict=True)):
        stream[a : a + n] = data[first + begin[k] : first + begin[k] + n]
    gram = ctw.grams(stream, depth)
    real = np.ones(len(stream), bool)
    real[(at[:, None] - 1 - np.arange(depth)[None, :]).ravel()] = False
    return gram[real[depth:]], begin + np.arange(len(texts))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def counted(gram: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams, sorted, and how often each stands where it is learnt from. Changes ``gram``."""
    gram <<= 1
    gram |= held
    gram.sort()
    where = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    times = np.diff(np.append(where, len(gram)))
    gram = gram[where]
    times[(gram & 1) == 1] = 0
    gram >>= 1
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return gram[first], np.add.reduceat(times, first)


def dealt(owner: np.ndarray, parts: int):
    """(part, positions) of each part that owns some."""
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


def blocks_of(docs: DataFrame, depth: int, parts: int) -> DataFrame:
    schema = pa.schema([("block", pa.binary()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.int64()), ("ends", pa.int64())])

    def cut(batches):
        for batch in batches:
            for at, stop in text_chunks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(at, stop - at)
                texts = pa.concat_arrays([lowered(part.column(2))])
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                codes, offsets, words = split_words(texts)
                learns = np.repeat(~held, np.diff(offsets))
                count = np.bincount(codes[learns], minlength=len(words))
                rows, tokens = [], int(learns.sum() + (~held).sum())
                for p, own in dealt((word_hashes(words) % np.uint64(parts)).astype(np.int64), parts):
                    data, sizes = packed_words(pa.concat_arrays([words.take(pa.array(own))]))
                    rows.append((p, WORDS, data, packed(count[own]), sizes, [], [], 0, 0))
                del codes, learns, words
                gram, begin = stream_of(texts, depth)
                gram, times = counted(gram, np.repeat(held, np.diff(np.append(begin, len(gram)))))
                for p, own in dealt(part_of_gram(gram, depth, parts), parts):
                    rows.append((p, GRAMS, packed_sorted(gram[own]), packed(times[own]), b"", [], [], 0, 0))
                keys, whole = part.column(0).to_pylist(), squeeze(b"".join(t.as_buffer() for t in texts))
                lengths = packed(pc.binary_length(texts).to_numpy(zero_copy_only=False))
                rows.append((-1, TEXTS, whole, b"", lengths, keys, held.tolist(), tokens, int((~held).sum())))
                name = hashlib.blake2b(whole + lengths + repr(keys).encode(), digest_size=16).digest()
                del gram, times, texts
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.binary()), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(9))], schema=schema)
                tidy()

    return docs.mapInArrow(cut, "block binary, part int, kind int, data binary, counts binary, lengths binary, keys array<long>, held array<boolean>, tokens long, ends long")


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of some rows, sorted, and the sums of their counts. A few rows at a time are merged."""
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0

    def merge():
        codes = np.concatenate([code, *(x for x, _ in held)])
        counts = np.concatenate([count, *(c for _, c in held)])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[first], np.add.reduceat(counts[order], first)

    for x, c in zip(table.column("data"), table.column("counts"), strict=True):
        held.append((unpacked_sorted(x.as_py()), unpacked(c.as_py()).astype(np.int64)))
        size += len(held[-1][0])
        if size > max(1_000_000, len(code)):
            code, count = merge()
            held, size = [], 0
    return merge() if held else (code, count)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 5, modulus: int = 7, remainder: int = 2, handed: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6: a gram has 64 bits")
    parts = parts_for(docs)
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (F.crc32(name.cast("binary")) % modulus == remainder).alias("held"), F.col(f"`{text}`").alias("text"))
    blocks = checkpointed(blocks_of(base, depth, parts))

    def count_words(key, table):
        first = first_rows(table.column("block").to_pylist())
        words, sizes = unpacked_words(table.column("data").to_pylist(), table.column("lengths").to_pylist())
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(c).astype(np.int64) for c in table.column("counts").to_pylist())])
        total = np.bincount(code, counts, len(coded.dictionary)).astype(np.int64)
        pieces = np.split(code, np.cumsum(sizes)[:-1])
        out = [packed(total[pieces[k]]) for k in first]
        table = table.take(first)
        return pa.table({"block": table.column("block"), "part": table.column("part"), "kind": table.column("kind"), "data": pa.array(out, pa.binary()), "known": pa.array([int((total > 0).sum())] + [0] * (len(out) - 1), pa.int64())})

    answered = "block binary, part int, kind int, data binary, known long"
    word_rows = checkpointed(blocks.filter(F.col("kind") == WORDS).select("block", "part", "kind", "data", "counts", "lengths").groupBy("part").applyInArrow(count_words, answered))
    sums = blocks.filter(F.col("part") < 0).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("ends"), F.lit(0)).alias("ends")).first()
    n, ends = sums["tokens"], sums["ends"]
    v = word_rows.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"] + (ends > 0)

    gram_rows = blocks.filter(F.col("kind") == GRAMS).select("block", "part", "data", "counts")
    # a row for each part: in how many shares its blocks are worked on
    shares = checkpointed(gram_rows.groupBy("part").agg(F.ceil(F.sum(F.length("data") + F.length("counts")) / SHARE_BYTES).cast("int").alias("shares")))
    # not more rows than shuffle partitions; no exchange by part alone, which would keep the shares of a part together
    shares = F.broadcast(shares) if parts <= MOST_BROADCAST else shares
    gram_rows = gram_rows.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")).cast("int"))

    def add_counts(key, table):
        code, count = summed(table)
        out = pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([packed_sorted(code)], pa.binary()), "counts": pa.array([packed(count)], pa.binary())})
        tidy()
        return out

    added = gram_rows.groupBy("part", "share").applyInArrow(add_counts, "part int, data binary, counts binary")
    counts = checkpointed(added.groupBy("part").applyInArrow(add_counts, "part int, data binary, counts binary"))

    def summarise(batches):
        for batch in batches:
            for x, c in zip(batch.column(1), batch.column(2), strict=True):
                found = ctw.summary(unpacked_sorted(x.as_py()), unpacked(c.as_py()).astype(np.int64), depth)
                yield pa.RecordBatch.from_pydict({"c1": pa.array(list(found), pa.int32()), "node": pa.array([t.ravel().tolist() for t in found.values()], pa.list_(pa.float64()))})
                tidy()

    tops: dict[int, np.ndarray] = {}
    # at most 257 x 1,536 sums reach the driver, whatever the input
    tables = counts.mapInArrow(summarise, "c1 int, node array<double>")
    for row in tables.select("c1", F.posexplode("node").alias("k", "v")).filter("v <> 0").groupBy("c1", "k").agg(F.sum("v").alias("v")).groupBy("c1").agg(F.collect_list(F.struct("k", "v")).alias("all")).collect():
        table = np.zeros(3 * ctw.NODES)
        for k, x in row["all"]:
            table[k] = x
        tops[row["c1"]] = table.reshape(3, ctw.NODES)
    top = ctw.Top(tops, handed)

    def rate(batches):
        for batch in batches:
            for p, x, c in zip(*batch.columns, strict=True):
                code = unpacked_sorted(x.as_py())
                logs = packed_logs(ctw.log_probabilities(code, unpacked(c.as_py()).astype(np.int64), depth, top))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p.as_py()], pa.int32()), "data": pa.array([x.as_py()], pa.binary()), "logs": pa.array([logs], pa.binary())})
                tidy()

    rated = checkpointed(counts.mapInArrow(rate, "part int, data binary, logs binary"))
    rated = rated.join(shares, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "data", "logs")

    def answer(left, right):
        code, logs = unpacked_sorted(left.column("data")[0].as_py()), unpacked_logs(left.column("logs")[0].as_py())
        first = first_rows(right.column("block").to_pylist())
        out = [packed_logs(logs[np.searchsorted(code, unpacked_sorted(right.column("data")[k].as_py()))]) for k in first]
        right = right.take(first)
        tidy()
        return pa.table({"block": right.column("block"), "part": right.column("part"), "kind": pa.array([GRAMS] * len(out), pa.int32()), "data": pa.array(out, pa.binary()), "known": pa.array([0] * len(out), pa.int64())})

    answers = rated.groupBy("part", "share").cogroup(gram_rows.select("block", "part", "share", "data").groupBy("part", "share")).applyInArrow(answer, answered).unionByName(word_rows)
    share = float(np.log10(n + v + 1))

    def add_up(left, right):
        right = right.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds = right.column("kind").to_numpy()
        found = np.concatenate([np.zeros(0, np.uint32), *(unpacked(right.column("data")[k].as_py()) for k in np.flatnonzero(kinds == WORDS).tolist())]).astype(np.int64)
        logs = np.concatenate([np.zeros(0), *(unpacked_logs(right.column("data")[k].as_py()) for k in np.flatnonzero(kinds == GRAMS).tolist())])
        tables = []
        for whole, lengths, keys, held in zip(*(left.column(c).to_pylist() for c in ("data", "lengths", "keys", "held")), strict=True):
            size = unpacked(lengths).astype(np.int64)
            texts = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(spread(whole))])
            codes, offsets, words = split_words(texts)
            count = np.zeros(len(words), np.int64)
            count[np.concatenate([np.zeros(0, np.int64), *(own for _, own in dealt((word_hashes(words) % np.uint64(parts)).astype(np.int64), parts))])] = found
            run = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0)[codes])])
            seen = np.concatenate([[0], np.cumsum((count > 0)[codes])])
            tokens = np.diff(offsets) + 1
            base = run[offsets[1:]] - run[offsets[:-1]] + np.log10(ends + 1.0) - tokens * share
            known = seen[offsets[1:]] - seen[offsets[:-1]] + (ends > 0)
            del codes, words, run, seen
            gram, begin = stream_of(texts, depth)
            code = np.sort(gram)
            code = code[np.append(True, code[1:] != code[:-1])]
            value = np.zeros(len(code))
            value[np.argsort(part_of_gram(code, depth, parts), kind="stable")] = logs
            each = gram.view(np.float64)  # the value of each place takes that of its gram
            for k in range(0, len(gram), LOOKUP):
                each[k : k + LOOKUP] = value[np.searchsorted(code, gram[k : k + LOOKUP])]
            total = np.add.reduceat(each, begin) / np.log(10)
            tables.append(pa.table({"doc_id": pa.array(keys, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(keys), n, np.int64), "base_score": base, "score": total, "n_bytes": size, "bits_per_byte": -total * np.log2(10) / (size + 1)}))
            del gram, code, value, each
            tidy()
        return pa.concat_tables(tables)

    texts = blocks.filter(F.col("part") < 0).select("block", "data", "lengths", "keys", "held")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
