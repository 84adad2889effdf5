"""The operators of the subpackage against plain versions, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c d e " * 40, "Zeile eins\nzwei drei 12\n" * 3, "x" * 5000, "<|startoftext|> Hi <|endoftext|>", "İΣ ½ é日本 \x1c a\xa0b", "it's 12_3 '' don't", "a\x00b"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(words):
    """(doc_id, text, lang, source): plain texts, exact and near copies, repeated passages, odd ones."""
    rng = random.Random(5)
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n // 12))
    out = [text(rng.choice([60, 120, 300])) for _ in range(60)]
    out += [out[0]] * 5
    near = out[1].split(" ")
    for k in range(6):
        own = list(near)
        own[10 + 3 * k] = f"new{k}"
        out.append(" ".join(own))
    line = " ".join(rng.choices(words, k=20))
    out += [text(120) + "\n" + line + f" {k}" for k in range(5)]
    out += ODD
    rows = [(k, t, "en", f"src{k % 4}" if k % 9 else None) for k, t in enumerate(out)]
    return [*rows, rows[3], (None, "a null key here", None, "src0")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3)


# --- quality rules


def plain_repeats(text, least):
    w = text.split()
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    covered = set()
    for i, k in enumerate(longest):
        if k >= least:
            covered |= set(range(i, i + k))
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    repeated = {i + k for i in range(n - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(covered), max([k for k in longest if k >= least], default=0), len(repeated)


def test_repeats_like_brute_force():
    from rillflow.llm.repetition import measured

    rng = random.Random(1)
    texts = ["", "a", "a a", "a a a a a a a a a a", *(" ".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(40)), *(" ".join(rng.choices("abcdefghijklmno", k=80)) for _ in range(10))]
    for least in (3, 5):
        found = measured(pa.array(texts), least)
        for k, t in enumerate(texts):
            assert (found["n_covered_words"][k], found["longest_repeat"][k], found["n_repeat_words"][k]) == plain_repeats(t, least), t


def test_quality_measures(docs, corpus):
    from rillflow.llm.repetition import repetition_rules

    got = {(r.doc_id, r.text): r for r in repetition_rules(docs.withColumn("kept", F.lit("clash"))).collect()}
    for doc_id, text, *_ in corpus:
        t, r = text or "", got[doc_id, text]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        covered, longest, windows = plain_repeats(t, 5) if len(w) < 400 else (r.n_covered_words, r.longest_repeat, r.n_repeat_words)
        failed = len(w) < 20 or 100 * windows > 30 * len(w)
        assert r.base_failed == failed and r.kept == (not failed and covered <= 0.35 * len(w) and not (longest > 40 and longest > 0.1 * len(w)))
    assert repetition_rules(docs.limit(0)).count() == 0


# --- BPE


@pytest.mark.parametrize("twice", [True, False])
def test_bpe_like_the_library(docs, corpus, twice):
    from tokenizers import Tokenizer

    from rillflow.llm.bpe import decode, encode

    tok = Tokenizer.from_file(tokenizer_path())
    source = docs.sparkSession.createDataFrame(corpus, docs.schema)
    coded = encode(source, tokenizer_path(), twice=twice)
    truth, texts = collections.Counter(), collections.Counter()
    for doc_id, text, *_ in corpus:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        truth[doc_id, tuple(ids)] += 1
        texts[doc_id, tok.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in coded.collect()) == truth
    assert collections.Counter((r.doc_id, r.decoded) for r in decode(coded, tokenizer_path()).collect()) == texts
    nulls = source.sparkSession.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"\x01\0\0\0"))], "k long, i binary")
    assert {r.k: r.decoded for r in decode(nulls, tokenizer_path(), "k", "i").collect()} == {1: None, 2: "", 3: tok.decode([1])}
    assert encode(docs.limit(0), tokenizer_path()).count() == 0


def test_bpe_digests_of_files(spark, corpus, docs, tmp_path):
    """The query's own way: texts from files, split twice, ids joined with their pieces."""
    from tokenizers import Tokenizer

    from rillflow.llm import bpe

    long = " ".join(f"w{k % 977}x é{k % 31}" for k in range(60_000)) * 3
    rows = [*corpus, (999, long, "en", None)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(str(tmp_path / "d"))
    source = spark.read.parquet(str(tmp_path / "d"))
    assert bpe.reads_alike(source.filter("doc_id > 3").select("doc_id", "text")) and not bpe.reads_alike(source.distinct()) and not bpe.reads_alike(source.filter("rand() > 0.5"))
    tok = Tokenizer.from_file(tokenizer_path())
    truth = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        truth[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    for df in (source, source.repartition(2)):
        assert collections.Counter(tuple(r) for r in bpe.encoded_and_decoded(df, tokenizer_path()).collect()) == truth


def test_bpe_pieces_of_a_block_once(spark, corpus, docs, tmp_path, monkeypatch):
    """The rows that are joined with the pieces do not grow with the number of parts."""
    from rillflow.llm import bpe

    spark.createDataFrame(corpus, docs.schema).repartition(3).write.parquet(str(tmp_path / "d"))
    whole, rows, before = bpe.joined_pieces, [], spark.conf.get("spark.sql.shuffle.partitions")

    def counted(wanted, path):
        rows.append(wanted.select("key", F.explode("ids").alias("id")).collect())
        return whole(wanted, path)

    monkeypatch.setattr(bpe, "joined_pieces", counted)
    try:
        for parts in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert bpe.encoded_and_decoded(spark.read.parquet(str(tmp_path / "d")), tokenizer_path()).count() == len(corpus)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    few, many = rows
    assert len(few) == len(many) == len({tuple(r) for r in many}) > 0


def test_blocks_of_equal_content(spark):
    """The same row alone in several partitions: its blocks share a name, and each still gives its row."""
    from rillflow.llm.bpe import encode, encoded_and_decoded
    from rillflow.llm.lm import score
    from rillflow.llm.packing import encoded_and_packed

    df = spark.createDataFrame(spark.sparkContext.parallelize([(3, "the same words stand in this row")] * 3, 3), "doc_id long, text string")
    for twice in (True, False):
        ids = encode(df, tokenizer_path(), twice=twice).collect()
        assert len(ids) == 3 and len({(r.doc_id, bytes(r.ids)) for r in ids}) == 1
    assert encoded_and_decoded(df, tokenizer_path()).count() == 3
    rows = encoded_and_packed(df, tokenizer_path(), 16).collect()
    assert sum(len(r.doc_ids) for r in rows) == 3 and len({r.row for r in rows}) == len(rows)
    split = score(df).collect()
    whole = score(df.coalesce(1)).collect()
    assert len(split) == 3 and split[0].n_known > 0
    for x, y in zip(split, whole, strict=True):
        assert (x.n_tokens, x.n_known, x.train_tokens) == (y.n_tokens, y.n_known, y.train_tokens)
        assert x.score == pytest.approx(y.score) and x.base_score == pytest.approx(y.base_score)


# --- language model


def test_lm_base_and_distribution(docs, corpus):
    from rillflow.llm.lm import score

    rows = score(docs).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count, ends = collections.Counter(), 0
    for i, t, *_ in corpus:
        if not held(i):
            count.update(WORD.findall(low(t)))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    text = {(i, len(low(t).encode())): t for i, t, *_ in corpus}
    assert len(rows) == len(corpus)
    for r in rows:
        w = WORD.findall(low(text[r.doc_id, r.n_bytes]))
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, held(r.doc_id))
        assert math.isclose(base, r.base_score, rel_tol=1e-9) and r.score < 0
    assert score(docs.limit(0)).count() == 0


def plain_ctw(train, text, depth, handed):
    """log P of a text and its end mark by the definition: weighting over contexts as tuples, one decision after the other."""
    lg = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    symbols = lambda t: [256] * depth + list(t) + [256]

    def decisions(s, i):
        x, prefix = s[i], ()
        for k in range(9 if x < 256 else 1):
            bit = (x >> (8 - k)) & 1
            yield prefix, bit
            prefix += (bit,)

    counts = collections.defaultdict(lambda: [0, 0])
    for t in train:
        s = symbols(t)
        for i in range(depth, len(s)):
            for node, bit in decisions(s, i):
                for d in range(depth + 1):
                    counts[node, tuple(s[i - 1 - k] for k in range(d))][bit] += 1
    kids = collections.defaultdict(set)
    for node, context in counts:
        if context:
            kids[node, context[:-1]].add(context)
    done = {}

    def weigh(node, context):
        if (node, context) not in done:
            own = lg(*counts[node, context])
            below = sum(weigh(node, c)[0] for c in kids[node, context]) if len(context) < depth else None
            both = own if below is None else np.logaddexp(own, below) + math.log(0.5)
            done[node, context] = both, 1.0 if below is None else math.exp(own - np.logaddexp(own, below))
        return done[node, context]

    def predict(node, context, history, above):
        a, b = counts.get((node, context), (0, 0))
        if a + b == 0 and context:
            return above if handed else 0.5
        p, stop = (b + 0.5) / (a + b + 1), weigh(node, context)[1] if a + b else 1.0
        return p if len(context) == depth else stop * p + (1 - stop) * predict(node, (*context, history[-1 - len(context)]), history, p)

    s, total = symbols(text), 0.0
    for i in range(depth, len(s)):
        for node, bit in decisions(s, i):
            p = predict(node, (), s[:i], 0.5)
            total += math.log(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("handed", [False, True])
@pytest.mark.parametrize("slice_", [300_000, 40])
def test_lm_like_the_definition(spark, monkeypatch, handed, slice_):
    """Scores through blocks, parts and shares against context-tree weighting by its definition."""
    from rillflow.llm import ctw, lm

    monkeypatch.setattr(ctw, "SLICE", slice_)
    monkeypatch.setattr(lm, "SHARE_BYTES", 300)
    rng = random.Random(12)
    rows = [(k, "".join(rng.choices("abAB é\x00", k=rng.randint(0, 40)))) for k in range(24)] + [(30, None), (31, ""), (3, "ab"), (None, "ba")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [low(t) for i, t in rows if not held(i)]
    truth = sorted((-1 if i is None else i, plain_ctw(train, low(t), 3, handed) / math.log(10)) for i, t in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.score(df, depth=3, handed=handed).collect())
    assert len(got) == len(truth)
    for x, y in zip(got, truth, strict=True):
        assert x[0] == y[0] and math.isclose(x[1], y[1], rel_tol=1e-9)


@pytest.mark.parametrize("slice_", [300_000, 20])
def test_ctw_sums_to_one(monkeypatch, slice_):
    from rillflow.llm import ctw

    monkeypatch.setattr(ctw, "SLICE", slice_)
    data = np.array([256] * 3 + list(b"the cat sat on the mat and the rat \0" * 4) + [256], np.int16)
    seen, times = np.unique(ctw.grams(data, 3), return_counts=True)
    for context in ([116, 104, 101], [120, 121, 122], [97, 116, 32], [256, 256, 256]):
        head = (context[2] << 27) | (context[1] << 18) | (context[0] << 9)
        code = np.union1d(seen, head + np.arange(257))
        count = np.zeros(len(code), np.int64)
        count[np.searchsorted(code, seen)] = times
        for handed in (False, True):
            found = ctw.log_probabilities(code, count, 3, ctw.Top(ctw.summary(code, count, 3), handed))
            assert math.isclose(np.exp(found[np.searchsorted(code, head + np.arange(257))]).sum(), 1, rel_tol=1e-6)


# --- mixing, sharding


def test_one_long_repeat_fails(spark, words):
    """A passage of 150 words that stands twice in 1,000 fails, one of 30 does not; and a text of 20 MB is read whole."""
    from rillflow.llm.repetition import repetition_rules

    rng = random.Random(2)
    own = [f"{rng.choice(words)}{k}" for k in range(1000)]
    rows = [(1, " ".join(own)), (2, " ".join(own[:500] + own[100:250] + own[500:850])), (3, " ".join(own[:500] + own[100:130] + own[500:])), (4, " ".join(f"{k * 7919 % 1_000_003}word" for k in range(1_900_000)))]
    assert len(rows[3][1]) > 19_000_000
    got = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).drop("text").collect()}
    assert [got[k].kept for k in (1, 2, 3)] == [True, False, True] and got[2].longest_repeat == 150 and not got[2].base_failed
    assert got[4].n_words == 1_900_000


def clashing(docs):
    """The documents with columns named like what operators might use inside, each with values of its own."""
    names = ["_key", "_text", "_pos", "_line", "_id", "_size", "_times", "_words", "_copy", "_node", "_hash", "_name", "_block", "kept", "n_lines", "dropped_lines", "row", "node", "bucket", "digest", "mix_copy", "Mix_Words", "line_key", "own_node", "size", "n_words", "h"]
    return docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names)), names


def test_clashing_names_in_every_stage(spark, docs):
    import corpus_pipeline as P

    table, names = clashing(docs.withColumn("n_chars", F.length("text").cast("long")))
    now = table
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == table.columns, name
        rows = now.collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names), name
    from rillflow.llm import bpe, embeddup, lm, mixing, neardup, packing, quality, sharding

    n = table.count()
    assert sharding.sharded(table).count() == mixing.fair_mix(table).count() == neardup.near_duplicates(table).count() == n
    assert bpe.encode(table, tokenizer_path()).count() == lm.score(table).count() == n and packing.encoded_and_packed(table, tokenizer_path()).count() > 0
    labels = table.select("doc_id", F.lit(1).alias("quality"), "_key", "node")
    assert quality.classified(table, labels).count() == n
    vectors = table.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("n_chars").cast("double")).alias("embedding"), *names)
    assert embeddup.linked(vectors).count() == n


def plain_mix(corpus):
    size = lambda t: len(WORD.findall(t or ""))
    total = collections.Counter()
    for _, t, _, s in corpus:
        total[s] += size(t)
    sources = sorted(total, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), float(sum(total.values()))
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * total[s]}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        open_ -= over
    return target, total


def test_mixing(docs, corpus):
    from rillflow.llm.mixing import fair_mix, mixed_documents

    target, total = plain_mix(corpus)
    rows = fair_mix(docs).collect()
    assert len(rows) == len(corpus)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, _, s in corpus}
    taken, most = collections.Counter(), max(r.size for r in rows)
    for r in rows:
        s = source[r.doc_id, r.size]
        assert r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert sum(taken.values()) <= sum(total.values()) and all(abs(taken[s] - target[s]) <= 2 * most for s in target)
    key = lambda rs: sorted(map(tuple, rs), key=repr)
    assert key(rows) == key(fair_mix(docs.repartition(5)).collect())
    mix = mixed_documents(docs)
    assert mix.columns == docs.columns and sum(len(WORD.findall(r.text or "")) for r in mix.collect()) == sum(taken.values())
    assert fair_mix(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    again = fair_mix(named).collect()
    assert abs(sum(r.taken for r in again) - sum(taken.values())) <= 2 * most and len({r.doc_id for r in again if r.doc_id}) > 50


def test_targets_of_many_sources(spark):
    """As many sources as documents, in slices, against the plain rule."""
    from rillflow.llm.mixing import fair_mix

    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([1, 1, 2, 60]), "en", f"host{rng.randint(0, 400)}") for k in range(600)]
    target, _ = plain_mix(rows)
    got = fair_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(math.isclose(r.target, target[rows[r.doc_id][3]], rel_tol=1e-9) for r in got)


def test_sharding(docs, spark, corpus):
    from rillflow.llm.sharding import sharded

    rows = sharded(docs).collect()
    assert len(rows) == len(corpus)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {(i, len((t or "").encode()) + 1): t for i, t, *_ in corpus}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id, r["size"]] or "").encode()) for r in rows)
    assert sharded(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="weight"):
        sharded(docs, 3, weights=[1.0])


@pytest.mark.parametrize("shards", [1, 7, 10, 16, 17, 24])
def test_one_more_shard(spark, shards):
    """For every number of shards: what is said of one more comes true, and takes rows only into itself."""
    from rillflow.llm.sharding import sharded

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    now, then = ({r.doc_id: r for r in sharded(df, n).collect()} for n in (shards, shards + 1))
    assert all(now[k].grown_shard == then[k].shard for k in now)
    moved = [k for k in now if now[k].shard != then[k].shard]
    assert all(then[k].shard == shards for k in moved) and abs(len(moved) / 4000 - 1 / (shards + 1)) < 0.03


def test_weights_of_shards(spark):
    from rillflow.llm.sharding import sharded

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    weights = [1.0] * 15 + [3.0]
    old, new = ({r.doc_id: r.shard for r in sharded(df, 16, weights=w).collect()} for w in (None, weights))
    total = collections.Counter(new.values())
    assert all(new[k] in (old[k], 15) for k in old)
    assert abs(total[15] / 20_000 - 3 / 18) < 0.02 and all(abs(total[k] / 20_000 - 1 / 18) < 0.012 for k in range(15))


# --- line dedup


def test_line_dedup(spark, docs):
    from rillflow.llm.lines import template_dedup

    rows = [(k, f"{chr(97 + k)}own {chr(97 + k)}line number of {chr(97 + k)}this\nShared words 12:0{k} go on and on for ever\n\nlast {chr(97 + k) * 3}") for k in range(4)]
    rows += [(10, None), (11, ""), (12, rows[0][1]), (13, "Shared words 12:09 go on and on for ever"), (13, "Shared words 12:09 go on and on for ever")]
    got = {r.doc_id: r for r in template_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect()}
    assert got[0].text == got[12].text == rows[0][1] and got[0].dropped_lines == []
    for k in (1, 2, 3):
        lines = rows[k][1].split("\n")
        assert got[k].text == "\n".join([lines[0], lines[2], lines[3]]) and got[k].dropped_lines == [1] and got[k].n_lines == 3
    assert got[10].text is None and got[11].text == "" and got[13].text == ""
    assert template_dedup(docs).count() == docs.count() and template_dedup(docs.limit(0)).count() == 0


def test_pipeline_drops_long_passages_of_two_texts(spark):
    from corpus_pipeline import line_dedup

    own = lambda name, n: " ".join(f"{name}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    long, short = own("passage", 60), own("short", 20)
    rows = [(k, f"{own('start' + chr(97 + k), 8)}\n{long}\n{short}\n{own('end' + chr(97 + k), 8)}") for k in range(2)]
    rows.append((2, rows[0][1]))
    df = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup(spark, df, "").collect()}
    left = rows[1][1].replace(long + "\n", "")
    assert got == {0: (rows[0][1], len(rows[0][1])), 1: (left, len(left)), 2: (rows[0][1], len(rows[0][1]))}


@pytest.mark.parametrize("large", [1000, 0])
def test_every_template_of_a_leaf(spark, monkeypatch, large):
    """Four templates and unrelated lines in one leaf; leaders in the order of lines, against a plain loop."""
    from corpus_pipeline import line_dedup
    from rillflow.llm import lines as L

    monkeypatch.setattr(L, "LARGE_LEAF", large)

    rng = random.Random(3)
    heads = ["".join(rng.choices("bcdfgh", k=4)) for _ in range(4)]
    lines = ["one leaf for aaa " + " ".join(f"un{chr(97 + k)}{chr(97 + j)}" for j in range(16)) for k in range(3)]
    for h in heads:
        for k in range(4):
            body = [f"{h}{chr(97 + j)}" for j in range(16)]
            body[5 + k] = "name" + chr(97 + k)
            lines.append("one leaf for " + h + " " + " ".join(body))
    rng.shuffle(lines)
    leads, taken = [], collections.defaultdict(list)
    for line in sorted(lines):
        near = [x for x in leads if sum(a == b for a, b in zip(x.split(), line.split(), strict=True)) >= 0.85 * 20]
        if not near:
            leads.append(line)
        taken[(near or [line])[0]].append(lines.index(line))
    truth = {k for found in taken.values() if len(found) >= 3 for k in sorted(found)[1:]}
    assert len(truth) == 12
    df = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(lines)], "doc_id long, text string, n_chars long")
    assert {r.doc_id for r in line_dedup(spark, df, "").filter("text = ''").collect()} == truth


def test_an_unrelated_line_changes_nothing(spark):
    from rillflow.llm.lines import template_dedup

    like = [(k, "one leaf for " + " ".join(f"w{chr(97 + j)}" if j != 9 else f"own{chr(97 + k)}" for j in range(17))) for k in range(4)]
    for more in ([], [(9, "one leaf for " + " ".join(f"a{chr(97 + j)}" for j in range(17)))]):
        got = {r.doc_id: r.text for r in template_dedup(spark.createDataFrame(like + more, "doc_id long, text string")).collect()}
        assert [k for k in got if got[k] == ""] == [1, 2, 3] or sorted(k for k in got if got[k] == "") == [1, 2, 3]


# --- near-dedup


def plain_groups(corpus, width=5, least=0.8):
    def shingles(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t, *_ in corpus]
    up = list(range(len(corpus)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            same = (corpus[i][1] or "") == (corpus[j][1] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                up[top(i)] = top(j)
    out = collections.defaultdict(list)
    for k in range(len(corpus)):
        out[top(k)].append(corpus[k][0])
    return out.values()


def test_near_duplicates(docs, corpus):
    from rillflow.llm.neardup import deduplicated, near_duplicates

    rows = near_duplicates(docs).collect()
    truth = collections.Counter()
    for group in plain_groups(corpus):
        for i in group:
            truth[i, min((x for x in group if x is not None), default=None)] += 1
    assert collections.Counter((r.doc_id, r.component_id) for r in rows) == truth
    groups = len(plain_groups(corpus))
    assert sum(r.kept for r in rows) == groups
    out = deduplicated(docs)
    assert out.columns == docs.columns and out.count() == groups
    assert near_duplicates(docs.limit(0)).count() == 0


def test_repeat_counts_do_not_hide_near_duplicates(spark, words):
    """Pairs of equal or similar shingle sets whose repeat counts differ, against brute force."""
    from rillflow.llm.neardup import near_duplicates

    rng = random.Random(17)
    rows = []
    for k in range(12):
        body, once = rng.choices(words, k=204), rng.choices(words, k=20)
        often = once * 30 + once[:4]
        rows += [(2 * k, " ".join(body + once + once[:4])), (2 * k + 1, " ".join([*body[: 204 - k], *often]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = [sorted(g) for g in plain_groups(rows)]
    assert sorted(groups) == [[2 * k, 2 * k + 1] for k in range(12)]
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {i: g[0] for g in groups for i in g}


def test_recall_at_the_threshold(spark, words):
    """Pairs whose similarity is 0.8 to 0.85, where banding finds the fewest: at least 99 in 100 are linked."""
    from rillflow.llm.neardup import near_duplicates
    from rillflow.llm.probminhash import jaccard

    rng = random.Random(23)
    rows, wanted = [], []
    while len(wanted) < 300:
        a = rng.choices(words, k=200)
        b = list(a)
        for _ in range(4):
            b[rng.randrange(200)] = f"new{rng.random()}"
        a, b = " ".join(a), " ".join(b)
        if 0.8 <= jaccard(pa.array([a]), pa.array([b]), 5)[0] <= 0.85:
            wanted.append(len(rows))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == got[k + 1] for k in wanted) >= 297


def test_full_comparison_in_blocks(spark, words, monkeypatch):
    """A chain of near copies, each like its neighbours only, in small blocks and without leaders."""
    from rillflow.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    base = rng.choices(words, k=120)
    texts = []
    for k in range(20):
        base = list(base)
        base[(k * 7) % 110] = f"w{k}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = neardup.near_duplicates(df, bands=30, rows=2, rounds=1).collect()
    assert {r.component_id for r in found} == {min(g) for g in plain_groups([(k, t) for k, t in enumerate(texts)])}


def test_probminhash_estimates_jaccard():
    from rillflow.llm.probminhash import jaccard, shingles, signatures

    rng = random.Random(4)
    w = [f"w{k}" for k in range(500)]
    a = rng.choices(w, k=200)
    b = a[:150] + rng.choices(w, k=50)
    texts = pa.array([" ".join(a), " ".join(b), "", "one"])
    v, t, c = shingles(texts, 5)
    sig = signatures(v, t, c.astype(float), 4, 2000)
    true = jaccard(texts.take(pa.array([0])), texts.take(pa.array([1])), 5)[0]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and not sig[2].any() and len(set(sig[3].tolist())) == 1


def test_components(spark):
    from rillflow.llm.common import components

    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


# --- embeddings


@pytest.mark.parametrize("most_members", [4096, 40])
def test_embeddings(spark, most_members):
    from rillflow.llm.embeddup import linked

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[0] + rng.normal(scale=0.1, size=(40, 16))
    x[140:150] = x[1]
    x[150] = 3 * x[2]
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0] * 3), (414, [2.0] * 3), (405, []), (406, [float("inf")] + [1.0] * 15), (5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    got = linked(df, cell=60, most_members=most_members).collect()
    good = [*rows, odd[-2], odd[-1]]
    m = np.array([r[1] for r in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    comp = list(range(len(good)))
    for _ in range(5):
        comp = [min(comp[j] for j in np.flatnonzero(near[k])) for k in range(len(good))]
    ids = [g[0] for g in good]
    least = {c: min((ids[k] for k in range(len(good)) if comp[k] == c and ids[k] is not None), default=None) for c in set(comp)}
    truth = collections.Counter((ids[k], int(near[k].sum()) - 1, least[comp[k]]) for k in range(len(good)))
    truth.update((i, 0, i) for i, _ in odd[:8] if i not in (404, 414))
    truth.update([(404, 1, 404), (414, 1, 404)])
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == truth
    assert linked(df.limit(0)).count() == 0
    assert linked(spark.createDataFrame(odd[:2], df.schema)).count() == 2
    # without a graph: no number of cells is allowed, so all vectors are compared
    full = linked(df, most_overlap=0).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in full) == truth
    large = spark.createDataFrame([(1, [1e39, 1e39]), (2, [1e39, 1e39]), (3, [2e200, 2e200]), (4, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in linked(large).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_many_near_copies_in_bounded_memory():
    """2,000 vectors within 0.9 of each other: every pair is found, and no step holds them all at once."""
    import tracemalloc

    from rillflow.llm import vectors as V

    rng = np.random.default_rng(3)
    x = V.unit(rng.normal(size=64) + rng.normal(scale=0.02, size=(2000, 64)))
    edges = V.build(x, 16, 1)
    tracemalloc.start()
    found = sum(len(r) for r, _ in V.within(x, edges, x, V.medoids(x, 8), np.arange(len(x)), 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 * 2000 and peak < 300e6


# --- classifier, packing


def test_classifier(spark, words):
    from rillflow.llm.quality import classified

    rng = random.Random(7)
    good, bad = words[:200], [w.upper() + "!!" for w in words[200:260]]
    rows = [(k, " ".join(rng.choices(good if k % 3 else bad, k=60))) for k in range(600)] + [(900, None), (901, ""), (902, "x " * 3000), (None, "null key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)] + [(7, None), (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classified(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.97
    assert {r.score for r in classified(docs, labels.limit(0)).collect()} == {0.5}
    assert classified(docs.limit(0), labels).count() == 0


def test_word_vectors(spark, docs, corpus, monkeypatch):
    from rillflow.llm import quality as Q
    from rillflow.llm.common import mixed, word_hashes

    def shape(w):
        for pattern, mark in Q.KINDS:
            w = re_unicode.sub(pattern, mark, w)
        return w

    import regex as re_unicode

    texts = [t or "" for _, t, _, _ in corpus]
    split = [WORD.findall(t) for t in texts]
    key = lambda w: int(word_hashes(pa.array([w]))[0]) >> 1
    index = {w: Q.index_vectors(np.array([key(w)]))[0].astype(int) for ws in split for w in ws}
    sums, shapes = collections.defaultdict(lambda: np.zeros(Q.SIZE, int)), collections.defaultdict(lambda: np.zeros(Q.SIZE, int))
    for ws in split:
        for k, w in enumerate(ws):
            for j in range(max(0, k - 2), min(len(ws), k + 3)):
                if j != k:
                    sums[w] = sums[w] + index[ws[j]]
                    shapes[shape(w)] = shapes[shape(w)] + index[ws[j]]
    unit = lambda x: np.rint(x / (np.sqrt((x**2).sum()) or 1) * Q.PRECISION) / Q.PRECISION
    truth = []
    for ws in split:
        v = np.array([unit(sums[w]) for w in ws]).reshape(-1, Q.SIZE)
        s = np.array([unit(shapes[shape(w)]) for w in ws]).reshape(-1, Q.SIZE)
        rows = [v.mean(axis=0), v.std(axis=0), s.mean(axis=0)] if ws else [np.zeros(3 * Q.SIZE)]
        truth.append(np.concatenate([*rows, [np.log1p(len(ws))]]))
    table = docs.select("doc_id", F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    got = Q.pooled(table).collect()
    assert len(got) == len(corpus)
    by_id = {k: truth[i] for i, (k, *_) in enumerate(corpus)}
    for r in got:
        assert np.allclose(np.frombuffer(r.features, "<f4"), by_id[r.doc_id], atol=2e-4)
    # the same bytes however texts are cut into blocks and slices, and for equal texts
    one = {r.doc_id: bytes(r.features) for r in Q.pooled(table.coalesce(1)).collect()}
    assert one == {r.doc_id: bytes(r.features) for r in got} and one[0] == one[60]
    monkeypatch.setattr(Q, "SLICE_WORDS", 70)
    monkeypatch.setattr(Q, "LANE_ROWS", 9)
    block = Q.Block(pa.array(texts))
    rows = Q.features_of(block.codes, block.offsets, block.word, block.shape, Q.unit_vectors(block.sums()))
    assert [r.tobytes() for r in rows] == [one[k] for k, *_ in corpus]
    for x, y in zip(Q.unpacked_block(block.packed()), (block.codes, block.offsets, block.word, block.shape), strict=True):
        assert (x == y).all()
    part = Q.Block(pa.array(["x", *texts[:9]]).slice(1))
    assert part.name.digest() == Q.Block(pa.array(texts[:9])).name.digest() != Q.Block(pa.array(texts[:8])).name.digest()
    x = np.array([[0, -1, 5, 1 << 40, -(1 << 41), *[0] * 27]])
    assert (Q.unpacked_sums(Q.packed_sums(x)) == x).all() and Q.unpacked_sums(Q.packed_sums(x[:0])).shape == (0, Q.SIZE)
    keys = np.sort(mixed(np.arange(1000, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)
    bounds = Q.bounds_of(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == 1000 and min(np.diff(bounds)) > 90


def test_word_vectors_that_most_bundles_ask_for(spark, tmp_path):
    """They are broadcast, so texts with the same words in many partitions write far less than a vector a word and partition."""
    from rillflow.llm import quality as Q

    rng, names = random.Random(5), ["".join(p) for p in itertools.product("abcdefghijklmn", repeat=3)]
    rows = [(k, k % 4 == 0, " ".join(rng.choices(names, k=4000)) + f" own{k}") for k in range(24)]
    spark.createDataFrame(spark.sparkContext.parallelize(rows, 24), "doc_id long, held_out boolean, text string").write.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext._jsc.sc().statusStore()
    conf = {"spark.sql.files.openCostInBytes": str(1 << 30), "spark.sql.shuffle.partitions": "5"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        table = spark.read.parquet(str(tmp_path / "t"))
        assert table.rdd.getNumPartitions() == 24
        spark.sparkContext.setJobGroup("vectors", "vectors")
        got = {r.doc_id: bytes(r.features) for r in Q.pooled(table).collect()}
        spark.sparkContext.setJobGroup("other", "other")
        whole = {r.doc_id: bytes(r.features) for r in Q.pooled(table.coalesce(1)).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == whole and len(got) == len(rows)
    status = spark.sparkContext.statusTracker()
    stages = {k for j in status.getJobIdsForGroup("vectors") for k in status.getJobInfo(j).stageIds}
    written = sum(tracker.lastStageAttempt(k).shuffleWriteBytes() for k in stages)
    # a vector packs into some 20 bytes or more: those of all partitions alone would be above this
    assert written < 24 * len(names) * 20


def test_best_fit():
    from rillflow.llm.packing import best_fit

    rng = random.Random(1)
    lengths = [rng.randint(0, 50) for _ in range(300)]
    rows = best_fit(np.array(lengths), 50)
    assert sorted(k for r in rows for k in r) == list(range(300)) and all(sum(lengths[k] for k in r) <= 50 for r in rows)
    left, truth = [], []
    for k in sorted(range(300), key=lambda k: (-lengths[k], k)):
        fits = [x for x in left if x >= lengths[k]]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else 50) - lengths[k])
        truth.append(k)
    assert sorted(50 - sum(lengths[k] for k in r) for r in rows) == sorted(left)


def test_packing_is_lossless(docs, corpus, spark, tmp_path):
    from rillflow.llm.bpe import encode
    from rillflow.llm.packing import encoded_and_packed, encoded_matrices, pack_block, packed_rows, rows_of, unpacked_documents, write_matrices

    own = spark.createDataFrame([r for r in corpus if r[0] is not None and r is not corpus[-2]], docs.schema)
    ids = encode(own, tokenizer_path())
    rows = packed_rows(ids, 64)
    truth = {r.doc_id: bytes(r.ids) for r in ids.collect()}
    assert {r.doc_id: bytes(r.ids) for r in unpacked_documents(rows).collect()} == truth
    for r in rows.collect():
        positions = np.frombuffer(r.positions, "<i4")
        assert len(r.ids) == 4 * 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
    made = encoded_matrices(own, tokenizer_path(), 64, kind="<u4", height=8)
    write_matrices(made, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert all(len(r.ids) == 4 * 64 * r.height and len(r.positions) == 4 * 64 * r.height and r.height == len(r.doc_ids) <= 8 for r in got.collect())
    assert {r.doc_id: bytes(r.ids) for r in unpacked_documents(rows_of(got)).collect()} == truth
    narrow = encoded_and_packed(own, tokenizer_path(), 64)
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in unpacked_documents(narrow, 2).collect()} == {k: np.frombuffer(v, "<u4").tolist() for k, v in truth.items()}
    with pytest.raises(ValueError, match="fit"):
        pack_block([1], [np.array([70_000], np.uint32)], 8, 0, "<u2")
    assert encoded_and_packed(docs.limit(0), tokenizer_path()).count() == 0 and encoded_matrices(docs.limit(0), tokenizer_path()).count() == 0


# --- pipeline


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    folder = str(tmp_path)
    table = docs.withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == table.columns, name
        out.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
    assert now.count() == P.run(spark, folder).count() > 0
    kept = spark.read.parquet(f"{folder}/0")
    assert kept.filter("size(split(text, ' ')) < 5").count() == 0
    assert spark.read.parquet(f"{folder}/2").count() < spark.read.parquet(f"{folder}/1").count()
