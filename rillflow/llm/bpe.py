"""BPE encoding and decoding through a table of distinct words.

``encode`` gives each text the ids that the tokenizer of a ``word_bpe`` file gives it (byte-level BPE with word ends,
white space dropped). Steps:

1. Tasks split their texts into words and write one row per block of texts: the words by code, and each text as codes.
   A block is named by a digest of its content, so a task that runs again names it alike, and blocks of equal content share
   their name and their answers.
2. The words of all blocks are dealt by their hash over parts; a part holds a word from every block that has it, encodes
   it once and answers every block. Words travel packed, one array for each block and part.
3. A block meets its answers again and puts the ids in place of the codes, by position.

``decode`` turns ids into text by a join: the distinct ids of each block of texts are joined with the table of
(id, piece), and the block puts the pieces in place of its ids. ``encoded_and_decoded`` does both, and its blocks meet
their ids and their pieces at once. The table of pieces is as long as the vocabulary.

Splitting follows the file's normaliser and pattern. Texts of common Latin characters are cut at white space, in Arrow,
and each distinct word once more by one regular expression; all others go through the library's own normaliser and
splitter, as do texts with a special token's string. A file that has a decoder, a post-processor, truncation, padding or
special tokens that take in white space is refused.

With ``twice`` the texts are split once for their words and once more for their codes, which spares a checkpoint of both.
Both passes, and a task that runs again, must then see the same rows in the same order. So it holds only where nothing but
projections and filters stands between the files and the texts, which is looked up in the plan; any other table takes the
checkpoint. Blocks that do not meet their own answers raise an error.

Defined results: a null text counts as an empty one; an empty text has no tokens. Null ids decode to a null, no ids to an
empty text; an id that is not in the vocabulary raises an error. Texts of any length are read whole. Equal rows get equal
results, each its own row. Extra columns are not carried; the key column may be null.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import checkpointed, parts_for, split_words, text_chunks, tidy, word_hashes

#: Text in a block at most, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000
#: Ids of a block of rows that ``decode`` gathers, about.
BLOCK_IDS = 1_000_000
#: Tokens whose pieces are looked up at once within a block.
SLICE_IDS = 500_000
#: Entries of a vocabulary up to which its table of pieces is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 200_000
#: What the fast splitter takes: printable ASCII, tab and line ends, and precomposed Latin letters and punctuation that
#: neither compose further nor count as numbers. All else goes through the library.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ňŊ-ž‐-‧‰-‾€]*")
#: The file's pattern for such characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Marks the string of a special token among the words.
SPECIAL = "\x00special:"


class WordBPE:
    """A tokenizer file, split into what a word needs. Loaded once in each worker."""

    loaded: dict[str, WordBPE] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder()
        wrong = [n for n in ("decoder", "post_processor", "truncation", "padding") if getattr(self.tok, n) is not None]
        wrong += [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
        if wrong:
            raise ValueError(f"{path}: not a plain word BPE file: {wrong}")
        self.special = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.bytes = {c: b for b, c in byte_letters().items()}

    @classmethod
    def at(cls, path: str) -> WordBPE:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def pieces(self) -> list[tuple[int, str]]:
        size = self.tok.get_vocab_size(with_added_tokens=True)
        return [(i, piece) for i in range(size) if (piece := self.tok.id_to_token(i)) is not None]

    def words(self, text: str) -> list[str]:
        """The words that the file's normaliser and splitter make of a text."""
        out = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append(SPECIAL + part)
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    out.append(bytes(self.bytes[c] for c in piece).decode("utf-8", "surrogatepass"))
        return out

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word, or of the words within what stands between white space of a plain text."""
        if word.startswith(SPECIAL):
            return [self.special[word[len(SPECIAL) :]]]
        letters = byte_letters()
        own = SPLIT.findall(word.lower()) if PLAIN.fullmatch(word) else [word]
        return [t.id for w in own for t in self.tok.model.tokenize("".join(letters[b] for b in w.encode("utf-8", "surrogatepass")))]


def byte_letters(kept: dict = {}) -> dict[int, str]:
    """The visible letter that stands for each byte in a byte-level vocabulary."""
    if not kept:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        kept |= {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return kept


def packed(x: np.ndarray) -> bytes:
    """Small integers, byte plane by byte plane: the upper planes are nearly all zeros."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_set(x: np.ndarray) -> bytes:
    """Distinct numbers, each by how far it is from the one below."""
    x = np.unique(x).astype(np.int64)
    return packed(np.diff(x, prepend=0))


def unpacked_set(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x).astype(np.int64))


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """The bytes of some words, and how many each has."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    data = words.buffers()[2]
    first = np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else 0
    return zstandard.ZstdCompressor(level=3).compress(memoryview(data)[first : first + int(lengths.sum())] if data is not None else b""), packed(lengths)


def unpacked_words(data: list[bytes], lengths: list[bytes]) -> tuple[pa.Array, list[int]]:
    """The words of several such rows as one array, and how many each row has."""
    sizes = [unpacked(x) for x in lengths]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
    raw = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in data)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), [len(x) for x in sizes]


def block_words(bpe: WordBPE, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all texts, how many each text has, and the words.

    Nothing of the file's splitting reaches over white space, so plain texts are cut there, and within a word once it
    is encoded.
    """
    plain = pc.and_(pc.match_substring_regex(texts, f"^(?:{PLAIN.pattern})$"), pc.invert(pc.match_substring(texts, "<|")))
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    codes, offsets, words = split_words(pc.if_else(plain, texts, "") if len(odd) else texts)
    lengths = np.diff(offsets)
    if len(odd):
        words = words.to_pylist()
        seen = {w: k for k, w in enumerate(words)}
        pieces = np.split(codes, offsets[1:-1])
        for k in odd.tolist():
            pieces[k] = np.array([seen.setdefault(w, len(seen)) for w in bpe.words(texts[k].as_py())], dtype=np.int32)
            lengths[k] = len(pieces[k])
        codes, words = np.concatenate(pieces), pa.array([w.encode("utf-8", "surrogatepass") for w in seen], pa.binary())
    return codes.astype(np.int32), lengths.astype(np.int32), words


def first_rows(blocks: list[bytes]) -> list[int]:
    """Where each block first stands; blocks of equal content have one name and need one answer."""
    seen: dict[bytes, int] = {}
    for k, name in enumerate(blocks):
        seen.setdefault(name, k)
    return list(seen.values())


CODES = "block binary, part int, data binary, lengths binary, keys array<long>, places binary"


def code_blocks(docs: DataFrame, key: str, text: str, path: str, parts: int) -> DataFrame:
    """(block, part, data, lengths, keys, places): part -1 holds the texts as codes, part p the words that hash to p."""

    def split(batches):
        bpe = WordBPE.at(path)
        for batch in batches:
            for at, stop in text_chunks(batch.column(1), BLOCK_BYTES):
                codes, lengths, words = block_words(bpe, pc.fill_null(batch.column(1).slice(at, stop - at), ""))
                # by part, so that a position in the answer tells the word
                part = (word_hashes(words) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                words = words.take(pa.array(order))
                place = np.empty(len(words), dtype=np.int32)
                place[order] = np.arange(len(words), dtype=np.int32)
                # frequent words get the small codes, which pack well; where each stands among the answers goes along
                often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                code = np.empty(len(words), dtype=np.int32)
                code[often] = np.arange(len(words), dtype=np.int32)
                coded, sizes, places = packed(code[codes]), packed(lengths), packed(place[often])
                keys = batch.column(0).slice(at, stop - at)
                rows, name = [(-1, coded, sizes, keys.to_pylist(), places)], hashlib.blake2b(digest_size=16)
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    rows.append((p, *packed_words(words.slice(bounds[p], bounds[p + 1] - bounds[p])), [], b""))
                for row in rows:
                    name.update(repr((row[0], row[3], *map(len, row[1:]))).encode() + row[1] + row[2] + row[4])
                yield pa.RecordBatch.from_pydict({"block": pa.array([name.digest()] * len(rows), pa.binary()), **{c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("data", pa.binary()), ("lengths", pa.binary()), ("keys", pa.list_(pa.int64())), ("places", pa.binary())))}})
                del codes, words, rows, code, place, part, order
                tidy()

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(split, CODES)


def reads_alike(docs: DataFrame) -> bool:
    """Whether files, projections and filters are all that makes these rows, so that each pass has them in one order."""
    nodes = docs._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    return all(re.match(r"[\s:+\-]*(Project|Filter|Relation) ", n) for n in nodes) and not re.search(r"\b(rand\w*|uuid|shuffle|udf)\(", " ".join(nodes))


def pieces_table(spark, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary; broadcast where it is small enough, which its length decides."""
    pieces = WordBPE.at(path).pieces()
    table = spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in pieces], pa.int32()), "piece": pa.array([p for _, p in pieces], pa.string())}))
    return F.broadcast(table) if len(pieces) <= MOST_BROADCAST else table


class Pieces:
    """The pieces of a block by id, as its join has given them."""

    def __init__(self, ids: pa.ChunkedArray, pieces: pa.ChunkedArray):
        ids = ids.to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.pieces = np.append(np.array(pieces.to_pylist(), dtype=object)[order], None)

    def texts(self, ids: list[np.ndarray]):
        """The text of each of some arrays of ids."""
        for x in ids:
            out = []
            for at in range(0, len(x), SLICE_IDS):
                own = x[at : at + SLICE_IDS]
                where = np.searchsorted(self.ids, own)
                if not len(self.ids) or (self.ids[np.minimum(where, len(self.ids) - 1)] != own).any():
                    raise ValueError("an id is not in the vocabulary")
                out.append(" ".join(self.pieces[where]))
            yield " ".join(out)


def answers_of(blocks: DataFrame, path: str, only_ids: bool) -> DataFrame:
    """What each part answers: (key, part, data, counts), the ids of each block's words and how many each word has.

    only_ids: (key, ids), the distinct ids among them, packed.
    """

    def answer(key, table):
        bpe = WordBPE.at(path)
        table = table.take(first_rows(table.column("block").to_pylist()))
        words, sizes = unpacked_words(table.column("data").to_pylist(), table.column("lengths").to_pylist())
        coded = words.dictionary_encode()
        ids = [bpe.encode_word(w.as_py().decode("utf-8", "surrogatepass")) for w in coded.dictionary]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(count.sum()))
        first = np.cumsum(count) - count
        code = coded.indices.to_numpy().astype(np.int64)
        rows = []
        for own in np.split(code, np.cumsum(sizes)[:-1]):
            if only_ids:
                own = np.unique(own)
            n = count[own]
            ends = np.cumsum(n)
            some = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[own] - (ends - n), n)]
            rows.append(packed_set(some) if only_ids else (packed(some), packed(n)))
        names = [b.hex().upper() for b in table.column("block").to_pylist()]
        tidy()
        if only_ids:
            return pa.table({"key": names, "ids": pa.array(rows, pa.binary())})
        return pa.table({"key": names, "part": table.column("part"), "data": pa.array([r[0] for r in rows], pa.binary()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    return blocks.filter("part >= 0").groupBy("key").applyInArrow(answer, "key string, ids binary" if only_ids else "key string, part int, data binary, counts binary")


def united(wanted: DataFrame) -> DataFrame:
    """(key, ids), each block once with its distinct ids, of (key, ids packed) from all parts.

    The parts' answers of a block have many ids in common, the more parts there are: they are one set before they are rows.
    """

    def unite(key, table):
        ids = np.unique(np.concatenate([unpacked_set(x.as_py()) for x in table.column("ids")]))
        return pa.table({"key": [key[0].as_py()], "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})

    return wanted.groupBy("key").applyInArrow(unite, "key string, ids array<int>")


def joined_pieces(wanted: DataFrame, path: str) -> DataFrame:
    """(key, id, piece) of (key, ids): the ids of each block, a row each, joined with the table of pieces."""
    return wanted.select("key", F.explode("ids").alias("id")).join(pieces_table(wanted.sparkSession, path), "id").select(F.col("key").alias("key"), "id", "piece")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", finish=None, schema: str = "doc_id long, ids binary", twice: bool = False, pieces: bool = False) -> DataFrame:
    """One row per text: the key and its ids as little-endian unsigned 32-bit integers.

    finish: makes the columns of a block's texts from (keys, list of id arrays, number among blocks of equal content, the
    block's ``Pieces``), to spare a second pass; with schema.
    twice: split the texts twice and not keep both in a checkpoint, where the plan allows it: half the disk for more CPU time.
    pieces: join each block's ids with their pieces.
    """
    parts = parts_for(docs)
    blocks = code_blocks(docs, key, text, path, parts).withColumn("key", F.when(F.col("part") < 0, F.hex("block")).otherwise(F.col("part").cast("string")))
    if not (twice and reads_alike(docs)):
        blocks = checkpointed(blocks)
    answers = answers_of(blocks, path, False).select("*", F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("piece"))
    if pieces:
        found = joined_pieces(united(answers_of(blocks, path, True)), path)
        answers = answers.unionByName(found.select("key", "id", "piece", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("counts")))

    def default(keys, ids, copy, _):
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})

    def placed(left, right):
        made = finish or default
        named = right.filter(pc.equal(right.column("part"), -1))
        right = right.filter(pc.greater_equal(right.column("part"), 0)).sort_by("part")
        data, counts = right.column("data").to_pylist(), right.column("counts").to_pylist()
        ids = np.concatenate([np.zeros(0, np.uint32), *(unpacked(x) for x in data)])
        count = np.concatenate([np.zeros(0, np.int32), *(unpacked(x).astype(np.int32) for x in counts)])
        first = (np.cumsum(count) - count).astype(np.int64)
        tables = []
        for copy, (coded, sizes, keys, places) in enumerate(zip(*(left.column(c).to_pylist() for c in ("data", "lengths", "keys", "places")), strict=True)):
            where = unpacked(places)
            if len(where) != len(count):  # a block that was made again from rows in another order is not mixed up with the first
                raise RuntimeError("the words of a block of texts are incomplete: read the texts from files")
            codes, stops = where[unpacked(coded)], np.cumsum(unpacked(sizes).astype(np.int64))
            n = count[codes]
            ends = np.cumsum(n, dtype=np.int64)
            at = np.repeat((first[codes] - (ends - n)).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            cut = np.concatenate([np.zeros(1, np.int64), ends])[stops]
            flat = ids[at]
            del codes, at, n, ends
            tables.append(made(keys, np.split(flat, cut[:-1]), copy, Pieces(named.column("id"), named.column("piece"))))
            tidy()
        return pa.concat_tables(tables)

    return blocks.filter("part < 0").select("key", "data", "lengths", "keys", "places").groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(placed, schema)


def encoded_and_decoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: the key, number of tokens, SHA-256 of its ids and of the text that they decode to."""

    def digests(keys, ids, copy, pieces):
        return pa.table(
            {
                "doc_id": pa.array(keys, pa.int64()),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in pieces.texts(ids)],
            }
        )

    return encode(docs, path, key, text, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", twice=True, pieces=True)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of rows of ids as little-endian unsigned 32-bit integers: a join of each block's ids with their pieces."""

    def gather(batches):
        held, size = [], 0

        def block():
            rows = [None if x is None else np.frombuffer(x, "<u4") for _, x in held]
            lengths = np.array([0 if x is None else len(x) + 1 for x in rows])  # 0: null
            flat = np.concatenate([np.zeros(0, np.uint32), *(x for x in rows if x is not None)])
            keys, data, sizes = [k for k, _ in held], packed(flat), packed(lengths)
            name = hashlib.blake2b(repr(keys).encode() + data + sizes, digest_size=16).hexdigest()
            return pa.RecordBatch.from_pydict({"key": [name], "data": pa.array([data], pa.binary()), "lengths": pa.array([sizes], pa.binary()), "keys": pa.array([keys], pa.list_(pa.int64())), "ids": pa.array([packed_set(flat)], pa.binary())})

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((k, x.as_py()))
                size += len(held[-1][1] or b"") // 4 + 1
                if size >= BLOCK_IDS:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    blocks = checkpointed(tokens.select(F.col(f"`{key}`").cast("long"), F.col(f"`{ids}`")).mapInArrow(gather, "key string, data binary, lengths binary, keys array<long>, ids binary"))

    def spelled(left, right):
        pieces, tables = Pieces(right.column("id"), right.column("piece")), []
        for data, sizes, keys in zip(*(left.column(c).to_pylist() for c in ("data", "lengths", "keys")), strict=True):
            sizes = unpacked(sizes).astype(np.int64)
            texts = pieces.texts(np.split(unpacked(data), np.cumsum(np.maximum(0, sizes - 1))[:-1]))
            tables.append(pa.table({"doc_id": pa.array(keys, pa.int64()), "decoded": pa.array([t if n else None for t, n in zip(texts, sizes, strict=True)], pa.string())}))
        return pa.concat_tables(tables)

    return blocks.select("key", "data", "lengths", "keys").groupBy("key").cogroup(joined_pieces(united(blocks.select("key", "ids")), path).groupBy("key")).applyInArrow(spelled, "doc_id long, decoded string").withColumnRenamed("doc_id", key)
