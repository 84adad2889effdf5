"""Packing of token ids into rows of fixed length by best-fit-decreasing.

A document longer than a row is split into pieces of a full row and a rest; nothing is dropped. Pieces of a block of
documents are placed from the longest to the shortest, each into the row with the least room that still holds it. Rows
are found by a segment tree over the room that they have left: its leaves count the rows of each room, and a search for
the first leaf that is not empty from a length on takes steps in the logarithm of the row length.

Blocks are packed apart, so rows of different tasks never wait for each other; a block has some million tokens, at which
the room that stays empty is small. ``packed_rows`` and ``encoded_and_packed`` have a row per packed row: ids (padded), the
cumulative lengths of its segments, the positions that start anew with each segment, and the document and piece that each
segment is. ``encoded_matrices`` has up to 256 of them as one id matrix, for writing; ``rows_of`` parts them again, and
``unpacked_documents`` restores the ids of every document. An id that the chosen type of integers does not hold raises an
error.

Defined results: a document without ids (null or empty) has one empty piece in no row; it is listed in a row of its
block with an empty segment. Equal rows are packed each on its own. An empty table gives no rows. A null key is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that are packed together, about.
BLOCK_TOKENS = 4_000_000
MATRICES = "matrix string, height int, width int, kind string, n_tokens long, doc_ids array<array<long>>, pieces array<array<int>>, cu_seqlens array<array<int>>, ids binary, positions binary"
SCHEMA = "row string, n_tokens long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """How many rows have each room left, as a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a row with the least room of at least ``least``: (room, row)."""
        at, tree = least + self.size, self.tree
        while not tree[at]:
            while at & 1:  # a right child: go up until there is something to the right
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not tree[at]:
                at += 1
        room = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces in each row, by best-fit-decreasing."""
    rooms, rows = Rooms(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = rooms.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        rows[found[1]].append(k)
        rooms.add(found[0] - n, found[1])
    return rows


class Packed:
    """A block of documents, packed: the id and position matrices, and each row's segments."""

    def __init__(self, keys: list, ids: list[np.ndarray], capacity: int, pad: int, kind: str, copy: int):
        size = np.array([len(x) for x in ids], dtype=np.int64)
        pieces = np.maximum(1, -(-size // capacity))
        doc = np.repeat(np.arange(len(ids)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, size[doc] - piece * capacity)
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        if max(int(flat.max(initial=0)), pad) > np.iinfo(kind).max:
            raise ValueError(f"an id does not fit {kind}")
        rows = best_fit(length, capacity)
        order = np.array([k for row in rows for k in row], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        length, begin = length[order], (np.cumsum(size) - size)[doc[order]] + piece[order] * capacity
        ends = np.cumsum(length)
        heads = np.searchsorted(row, np.arange(len(rows)))
        room = ends - length - np.append(0, ends)[heads][row]  # where a segment begins in its row
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        self.ids, self.positions = np.full((len(rows), capacity), pad, dtype=kind), np.zeros((len(rows), capacity), dtype="<i4")
        to = np.repeat(row * capacity + room, length) + within
        self.ids.ravel()[to] = flat[np.repeat(begin, length) + within]
        self.positions.ravel()[to] = within
        cuts = heads[1:]
        self.doc_ids = [[keys[k] for k in x] for x in np.split(doc[order], cuts)]
        self.pieces = [x.tolist() for x in np.split(piece[order], cuts)]
        self.cu_seqlens = [[0, *np.cumsum(x).tolist()] for x in np.split(length, cuts)]
        name = hashlib.blake2b(repr(keys).encode(), digest_size=8)
        name.update(size.tobytes() + flat.astype("<u4").tobytes())
        self.names = [f"{name.hexdigest()}{f'.{copy}' if copy else ''}-{n}" for n in range(len(rows))]

    def rows(self) -> pa.Table:
        return pa.table({"row": self.names, "n_tokens": pa.array([x[-1] for x in self.cu_seqlens], pa.int64()), "doc_ids": pa.array(self.doc_ids, pa.list_(pa.int64())), "pieces": pa.array(self.pieces, pa.list_(pa.int32())), "cu_seqlens": pa.array(self.cu_seqlens, pa.list_(pa.int32())), "ids": pa.array([x.tobytes() for x in self.ids], pa.binary()), "positions": pa.array([x.tobytes() for x in self.positions], pa.binary())})

    def matrices(self, height: int) -> pa.Table:
        at = range(0, len(self.names), height)
        cut = lambda x: [x[k : k + height] for k in at]
        lists = lambda x, t: pa.array(cut(x), pa.list_(pa.list_(t)))
        return pa.table(
            {
                "matrix": [self.names[k] for k in at],
                "height": pa.array([len(x) for x in cut(self.names)], pa.int32()),
                "width": pa.array([self.ids.shape[1]] * len(at), pa.int32()),
                "kind": [self.ids.dtype.str.replace("|", "<")] * len(at),
                "n_tokens": pa.array([sum(c[-1] for c in x) for x in cut(self.cu_seqlens)], pa.int64()),
                "doc_ids": lists(self.doc_ids, pa.int64()),
                "pieces": lists(self.pieces, pa.int32()),
                "cu_seqlens": lists(self.cu_seqlens, pa.int32()),
                "ids": pa.array([x.tobytes() for x in cut(self.ids)], pa.binary()),
                "positions": pa.array([x.tobytes() for x in cut(self.positions)], pa.binary()),
            }
        )


def pack_block(keys: list, ids: list[np.ndarray], capacity: int, pad: int, kind: str, copy: int = 0) -> pa.Table:
    """The packed rows of a block of documents. copy: its number among blocks of equal content, which parts their rows' names."""
    return Packed(keys, ids, capacity, pad, kind, copy).rows()


def packed_rows(tokens: DataFrame, capacity: int = 2048, pad: int = 0, kind: str = "<u4", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The packed rows of documents with ids as little-endian unsigned 32-bit integers. No shuffle."""

    def pack(batches):
        keys, held, size = [], [], 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                held.append(np.frombuffer(x.as_py() or b"", dtype="<u4"))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield from pack_block(keys, held, capacity, pad, kind).to_batches()
                    keys, held, size = [], [], 0
        if keys:
            yield from pack_block(keys, held, capacity, pad, kind).to_batches()

    return tokens.select(F.col(f"`{key}`").cast("long"), F.col(f"`{ids}`")).mapInArrow(pack, SCHEMA)


def kind_for(path: str) -> str:
    """The narrowest type of integers that holds every id of a tokenizer file."""
    from rillflow.llm.bpe import WordBPE

    return "<u2" if max(i for i, _ in WordBPE.at(path).pieces()) < 1 << 16 else "<u4"


def encoded_and_packed(docs: DataFrame, path: str, capacity: int = 2048, pad: int = 0, kind: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows of texts, encoded through the table of distinct words, block by block. kind: the ids' type, by default
    the narrowest that holds the vocabulary."""
    from rillflow.llm.bpe import encode

    kind = kind or kind_for(path)
    return encode(docs, path, key, text, lambda keys, ids, copy, _: pack_block(keys, ids, capacity, pad, kind, copy), SCHEMA)


def encoded_matrices(docs: DataFrame, path: str, capacity: int = 2048, pad: int = 0, kind: str | None = None, height: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows as id matrices of up to ``height`` rows, with their positions, cumulative lengths, documents and pieces."""
    from rillflow.llm.bpe import encode

    kind = kind or kind_for(path)
    return encode(docs, path, key, text, lambda keys, ids, copy, _: Packed(keys, ids, capacity, pad, kind, copy).matrices(height), MATRICES)


def rows_of(matrices: DataFrame) -> DataFrame:
    """The packed rows of id matrices."""
    width = F.when(F.col("kind") == "<u2", 2).otherwise(4)
    part = lambda c, w: F.expr(f"substring({c}, cast(at * width * {w} + 1 AS int), cast(width * {w} AS int))")
    rows = matrices.withColumn("w", width).select("*", F.posexplode(F.arrays_zip("doc_ids", "pieces", "cu_seqlens")).alias("at", "s"))
    return rows.select(F.concat_ws("-", F.col("matrix"), F.col("at").cast("string")).alias("row"), F.element_at("s.cu_seqlens", -1).cast("long").alias("n_tokens"), "s.doc_ids", "s.pieces", "s.cu_seqlens", part("ids", "w").alias("ids"), part("positions", "4").alias("positions"))


def write_matrices(matrices: DataFrame, path: str) -> None:
    """Write the id matrices as Parquet, which any executor and any store can take."""
    matrices.write.mode("overwrite").parquet(path)


def unpacked_documents(rows: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, ids) of every document, its pieces joined in order; for tables whose keys are distinct."""
    parts = rows.select("ids", F.posexplode(F.arrays_zip("doc_ids", "pieces")).alias("at", "s"), "cu_seqlens")
    begin, end = F.get("cu_seqlens", F.col("at")), F.get("cu_seqlens", F.col("at") + 1)
    parts = parts.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.substring("ids", begin * width + 1, (end - begin) * width).alias("ids"))
    # hexadecimal, as binary values do not concatenate from an array
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("h")))), lambda x: x["h"]), "").alias("h"))
    return joined.select("doc_id", F.unhex("h").alias("ids"))
