import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm.packing import END_OF_TEXT, _Encoder, pack_documents, plan_packing
from evalspark.llm.queries import tokenizer_path
from evalspark.llm.ranking import BUCKETS
from evalspark.llm.sharding import shard_documents, shard_rows
from evalspark.llm.topk_search import block_top_k, top_k_search

from .helpers import awkward, frame


# ------------------------------------------------------------ sharding

def check_shards(rows, n_rows, n_shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert sum(sizes) == n_rows and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_edge_rows(spark):
    rows = awkward(2000)
    out = shard_documents(frame(spark, rows), 7).collect()
    check_shards(out, len(rows), 7)
    size = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == size
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert shard_documents(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        shard_documents(frame(spark, rows), 0)


def test_every_shard_has_the_mixture(spark):
    rnd = random.Random(1)
    sources = ["hot"] * 1000 + ["b"] * 333 + [None] * 120 + ["rare"] * 11
    rnd.shuffle(sources)
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sources)], "doc_id long, source string, shard string")
    out = shard_rows(df, "doc_id", "source", 20).collect()
    check_shards(out, len(sources), 20)
    total = Counter(sources)
    for s in range(20):
        here = Counter(r.source for r in out if r.shard == s)
        assert all(abs(here[k] - n / 20) <= 1.5 for k, n in total.items())
    again = shard_rows(df.repartition(9), "doc_id", "source", 20).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert BUCKETS == 16 ** 3


# ------------------------------------------------------------ top-k search

def brute_top_k(rows, k, is_query):
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in ints:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def test_top_k_edge_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.5, 0.25]) for _ in range(4)]) for i in range(90)]  # many ties
    rows += [(100, None), (None, [1.0] * 4), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]),
             (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [0.5]), (105, []), (150, [0.5, 0.5, 0.25, 0.0]),
             (7, [3.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as part", "'x' as vec", "2 as score")
    query = F.col("vec_id") % 50 == 0
    for blocks in ((16_384, 32_768), (10, 1)):
        got = {tuple(r) for r in top_k_search(df, query, 5, *blocks).collect()}
        assert got == brute_top_k(rows, 5, lambda i: i % 50 == 0)
    assert top_k_search(df.limit(0), query).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert top_k_search(few, query).count() == 2


def test_pruned_blocks_equal_all_products():
    rnd = np.random.default_rng(4)
    c = np.floor(256 * rnd.normal(size=(5000, 16)) * np.exp(rnd.normal(size=(5000, 1)))).astype(np.int64)
    q, ids = c[::100], np.arange(5000)
    row, found, score = block_top_k(ids[::100], q, ids, c, np.linalg.svd(c.astype(float), full_matrices=False)[2].T, 5)
    for r in range(len(q)):
        s = c @ q[r]
        s[100 * r] = s.min() - 1
        best = np.lexsort((ids, -s))[:5]
        assert found[row == r].tolist() == best.tolist() and score[row == r].tolist() == s[best].tolist()


# ------------------------------------------------------------ packing

def check_packing(pieces, capacity):
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_edge_rows(spark):
    from tokenizers import Tokenizer

    rows = awkward(6000)
    out = pack_documents(frame(spark, rows), tokenizer_path(), with_ids=True).collect()
    check_packing(out, 2048)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in (r[:2] for r in rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_OF_TEXT]
        for k in range(0, len(ids), 2048):
            own = ids[k:k + 2048]
            want[i, k // 2048, k, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in out) == want
    assert pack_documents(frame(spark, []), tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_texts():
    texts = ["", "a's don't DON'T it'S *'s 's", "<|endoftext|> x <|STARTOFTEXT|> <|startoftext|>a", "“Hello”, “,” ”.x é. É. ﬁx ΑΣ İi!",
             "a\x1cb c\x85d\xa0e f", "12.5 3x4 x² ½. 1/2 a1b2", "日本語。テスト！ foo—bar x…y (a)[b]{c}`d~", "word́, Å. å.b ,́a",
             "___a_b__ $100 #tag @me a.b.c", "\t\n\r \x0c", "ß ÿ÷ö ×ab"]
    own = _Encoder(tokenizer_path())
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in own.encode(texts) + own.encode(texts)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want + want


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([8, 64, 2048])
    lengths = [min(capacity, max(1, int(rnd.paretovariate(0.7) * capacity / 15))) for _ in range(rnd.choice([0, 1, 7, 900]))]
    counts = Counter(lengths)
    plan = plan_packing(counts, capacity)
    table = plan.table()
    bins = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            _, lo, per, first, offset = table[(table[:, 0] == length) & (table[:, 1] <= rank)][-1]
            bins[first + (rank - lo) // per].append((offset + (rank - lo) % per * length, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plan.sequences
    rooms = []
    for length in sorted(lengths, reverse=True):  # best-fit decreasing, piece by piece
        at = min((k for k, room in enumerate(rooms) if room >= length), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity)
            at = -1
        rooms[at] -= length
    assert plan.sequences <= len(rooms)


def test_pack_takes_columns_with_clashing_names(spark):
    from evalspark.llm.packing import pack

    rows = [(i % 7, i % 3, 1 + i % 5, i, "x", -1, -2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, start long, rank string, sequence_id int, offset int")
    out = pack(df.repartition(3), 8).collect()
    assert {r.rank for r in out} == {"x"} and len(out) == 60
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 8
