import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm.graph import components
from evalspark.llm.line_dedup import boilerplate_lines, dedup_pages, drop_boilerplate
from evalspark.llm.ngram_join import (
    block_bounds,
    candidates,
    ngram_jaccard_join,
    overlap_counts,
    set_id,
    shingle_sets,
    size_levels,
)
from evalspark.llm.substring_dedup import substring_dedup
from evalspark.llm.words import chunks, ngram_hashes, split_words

from .helpers import awkward, frame, prose, words


# ------------------------------------------------------------ words

def test_split_words_matches_a_regex():
    texts = ["", None, "a b", " \t\n\x0b\x0c\r", "é  ü\nß", "x" * 70_000, "a\x1cb c\xa0d", "日本 語"]
    w = split_words(pa.array(texts, type=pa.string()))
    got = [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    again = split_words(pa.array(["b", "d c\xa0d", "b"]))
    assert again.hash[0] == again.hash[3]
    assert len(set(w.hash.tolist())) == len(set(got))


def test_chunks_cover_all_rows_within_the_limit():
    texts = pa.array(["a" * 5, None, "b" * 50, "", "c" * 4, "d" * 6])
    assert list(chunks(texts, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(chunks(pa.array([], type=pa.string()))) == []


def test_ngram_hashes_depend_on_order():
    w = split_words(pa.array(["a b c a b", "b a"]))
    g = ngram_hashes(w.hash, 2)
    assert g[0] == g[3] and g[0] != g[5]
    assert len(ngram_hashes(w.hash[:1], 2)) == 0


# ------------------------------------------------------------ line dedup

def test_line_dedup_counts_pages_of_the_site(spark):
    pages = [(i, f"menu\nbody {i}\n menu \n", "a") for i in range(10)]
    pages += [(20 + i, f"menu\nother {i}", "b") for i in range(10)]
    pages[11:20] = [(21 + i, f"text {i}", "b") for i in range(9)]  # menu is on one page of b only
    got = {r.doc_id: r for r in drop_boilerplate(frame(spark, pages), "source", "text", 0.3).collect()}
    assert all(got[i].text == f"body {i}\n" and got[i].n_dropped == 2 and got[i].n_lines == 4 for i in range(10))
    assert got[20].text == "menu\nother 0" and got[20].n_dropped == 0
    assert got[0].key == "k" and got[0].rank == 7  # other columns stay


def test_line_dedup_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x", "a"), (4, "x", "a"), (4, "x", "a"), (5, "x\n\nx", None),
            (None, "x\ny", "a"), (6, "x", "small")]
    out = drop_boilerplate(frame(spark, rows), "source", "text", 0.3)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == Counter([(1, None, 0, 0), (2, "", 1, 0), (3, "", 1, 1), (4, "", 1, 1), (4, "", 1, 1),
                           (5, "x\n\nx", 3, 0), (None, "y", 2, 1), (6, "x", 1, 0)])
    salted = drop_boilerplate(frame(spark, rows), "source", "text", 0.3, broadcast_bytes=0)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in salted.collect()) == got
    pair = [(1, "menu\na", "two"), (2, "menu\nb", "two"), (3, "menu", "one")]  # a host of two pages is judged
    assert {r.text for r in drop_boilerplate(frame(spark, pair), "source", "text", 0.3).collect()} == {"a", "b", "menu"}
    empty = frame(spark, [])
    assert drop_boilerplate(empty, "source", "text").count() == 0
    assert boilerplate_lines(empty, "source", "text").count() == 0


def test_html_pages(spark):
    page = "<html><head><title>t</title><script>var x='<p>';</script></head><body><!-- c --><div class=\"ad\">buy</div>"
    rows = [(i, f"http://Site.example.com:80/{i}", page + f"<p>own <b>{i}</b><br>line</body></html>") for i in range(5)]
    rows += [(9, None, "<p>buy"), (10, "http://other.org/", None)]
    got = {r.page_id: r for r in dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].host == "site.example.com" and "buy" not in got[0].text and "own 0" in got[0].text
    assert "line" not in got[0].text and "var" not in got[0].text
    assert got[9].host is None and "buy" in got[9].text
    assert got[10].text is None and got[10].n_lines == 0


# ------------------------------------------------------------ substring dedup

def brute_substring(rows, window=13):
    first = {}
    for i, t in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = Counter()
    for i, t in (r[:2] for r in rows):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def got_substring(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest())
                   for r in df.collect())


def test_substring_dedup_edge_rows(spark):
    rows = awkward()
    out = substring_dedup(frame(spark, rows))
    assert got_substring(out) == brute_substring(rows)
    null = [r for r in out.collect() if r.doc_id == 4][0]
    assert null.kept_text is None and null.n_words == 0
    assert substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_random_passages(spark, seed):
    rnd = random.Random(seed)
    passages = [prose(100 + k, rnd.randrange(8, 40), 50) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rnd.random(), rnd.randrange(0, 20), 8 if rnd.random() < 0.3 else 500) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(passages))
        rows.append((rnd.randrange(50), " ".join(parts)))
    df = frame(spark, rows).repartition(5)
    assert got_substring(substring_dedup(df)) == brute_substring(rows)


def test_substring_spans_are_the_removed_words(spark):
    p = prose(9, 20)
    out = {r.doc_id: r for r in substring_dedup(frame(spark, [(1, p), (2, "a b " + p + " c " + p)])).collect()}
    assert out[2].span_start == [2, 23] and out[2].span_length == [20, 20] and out[2].kept_text == "a b c"


# ------------------------------------------------------------ n-gram join

def brute_join(rows, shingle=3, percent=90):
    sets = []
    for r in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (r[1] or "")))
        sets.append({tuple(w[p:p + shingle]) for p in range(len(w) - shingle + 1)} if len(w) >= shingle
                    else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    links[a] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    group = defaultdict(list)
    for a in range(len(rows)):
        group[find(a)].append(rows[a][0])
    return Counter((rows[a][0], len(sets[a]), None if rows[a][0] is None else min(group[find(a)]), links[a])
                   for a in range(len(rows)))


def got_join(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect())


def test_ngram_join_edge_rows(spark):
    rows = awkward(5000)
    assert got_join(ngram_jaccard_join(frame(spark, rows))) == brute_join(rows)
    assert ngram_jaccard_join(frame(spark, [])).count() == 0


def test_ngram_join_repeated_rows_of_the_smallest_id(spark):
    base, other = prose(31, 120).split(), prose(32, 120).split()
    near = [" ".join(w[:60] + ["new"] + w[61:]) for w in (base, other)]
    a, b = " ".join(base), " ".join(other)
    rows = [(1, a), (1, a), (1, a.upper()), (2, near[0]), (3, b), (3, prose(33, 90)), (3, None), (4, near[1]), (5, b)]
    got = got_join(ngram_jaccard_join(frame(spark, rows)))
    assert got == brute_join(rows)
    assert {k[3] for k in got if k[0] == 2} == {3}


def test_ngram_join_near_copies_around_the_limit(spark):
    rnd = random.Random(5)
    rows = []
    for g, n in enumerate((4, 11, 25, 60, 200)):
        base = prose(50 + g, n, 1000).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, n // 20))):
                k = rnd.randrange(len(copy))
                copy[k:k + rnd.randrange(2)] = [f"n{rnd.randrange(10**6)}"] * rnd.randrange(2)
            rows.append((rnd.randrange(10**6), " ".join(copy)))
    got = got_join(ngram_jaccard_join(frame(spark, rows).repartition(4)))
    assert got == brute_join(rows)
    assert sum(r[3] > 0 for r in got) > 40


def test_row_blocks_lose_no_link(spark, monkeypatch):
    import evalspark.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK_ROWS", 3)
    base = prose(77, 150).split()
    rows = [(i, " ".join(base[:i] + ["new"] + base[i + 1:])) for i in range(5, 45)]
    assert got_join(ngram_jaccard_join(frame(spark, rows))) == brute_join(rows)


def test_size_classes_and_block_bounds():
    levels = size_levels(90)
    for n in [*range(1, 500), 12345]:
        own = np.searchsorted(levels, n, side="right") - 1
        least = -(-n * 90 // 100)
        assert own - (np.searchsorted(levels, least, side="right") - 1) <= 1
        differ, lows = block_bounds(int(own), 90)
        assert differ >= 2 * n * 10 // 190 and len(lows) > differ


def test_overlap_counts():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, 200)).astype(np.uint64) for _ in range(7)]
    got = overlap_counts(sets[:4], sets[4:], columns=50)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)] + [(300, 301 + i) for i in range(50)]
    df = spark.createDataFrame(chain, "x long, y long")
    got = {r.node: r.component for r in components(df, "x", "y").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and got[350] == 300 and 200 not in got
    assert components(df.limit(0), "x", "y").count() == 0


def test_few_products_for_the_links_of_a_corpus(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text")
    for shingle, percent in ((5, 80), (3, 90)):
        groups = components(candidates(docs, shingle, percent), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        products = groups.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        assert products < 1000


@pytest.mark.parametrize("pair_rows", [2, 64])
@pytest.mark.parametrize("shingle,percent", [(1, 80), (2, 60), (3, 90)])
def test_candidates_hold_every_link(spark, shingle, percent, pair_rows):
    rnd = random.Random(shingle)
    texts = []
    for size in (3, 6, 12, 30, 80, 300):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + max(1, size * (100 - percent) // 150))):
                k = rnd.randrange(len(copy))
                copy[k:k + rnd.randrange(2)] = [f"n{rnd.randrange(10**6)}"] * rnd.randrange(2)
            texts.append(" ".join(copy))
    part = pa.array(texts)
    sets = list(shingle_sets(part, shingle))
    ids = [set_id(s, 1) if len(s) else None for s in sets]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    group = {r.node: r.component for r in components(candidates(df, shingle, percent, pair_rows), "a", "b").collect()}
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if ids[i] != ids[j] and same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                links += 1
                assert group[ids[i]] == group[ids[j]]
    assert links > 5


def test_key_filter_keeps_all_keys_of_its_table(spark):
    from evalspark.llm.key_filter import KeyFilter
    from evalspark.llm.words import mix

    keys = mix(np.arange(5000, dtype=np.uint64))
    held = KeyFilter(spark.createDataFrame([(int(k),) for k in keys[:1000].view(np.int64)], "key long"))
    found = held.may_hold(keys)
    assert found[:1000].all() and found[1000:].mean() < 0.2
    empty = KeyFilter(spark.createDataFrame([], "key long"))
    assert not empty.may_hold(keys).any()


def test_few_bytes_a_key_are_shuffled_to_find_the_repeated_ones():
    from evalspark.llm.ngram_join import PART_BITS, _packed, _repeated

    keys = np.random.default_rng(3).integers(0, 1 << 64, 2_000_000, dtype=np.uint64)
    twice = keys[999_000:1_001_000]  # half of them come again in the same task
    tasks = [np.concatenate([keys[:1_000_000], keys[999_000:1_000_000]]), np.concatenate([keys[1_000_000:], twice[1000:]])]
    tasks = [_packed(tasks[0]), _packed(tasks[1]), _packed(keys[5:6])]
    alone = [b.column("key").to_pylist() for b in _repeated(iter([_packed(np.repeat(keys[:1], 2))]))]
    assert [len(k) for k in alone] == [1]  # a part that a single task holds
    planes = b"".join(p for t in tasks[:2] for p in t.column("keys").to_pylist())
    assert len(planes) == 4 * (len(keys) + 2000) and len(pa.compress(planes, "lz4", asbytes=True)) < 3.5 * len(keys)
    found = pa.Table.from_batches(tasks).sort_by("part").to_batches(max_chunksize=100)
    found = np.concatenate([b.column("key").to_numpy() for b in _repeated(iter(found))]).view(np.uint64)
    want = {k >> np.uint64(32 - PART_BITS) << np.uint64(32 - PART_BITS) for k in [*twice, keys[5]]}
    assert want <= set(found) and len(found) <= len(want) + 5  # a few keys have the leading bits of another


def test_rows_without_ids_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    from evalspark.llm.key_filter import without

    rows = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(500)] + [(3, "again"), (4, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(0, 500, 3)], "doc_id long")
    want = sorted((r.text or "" for r in rows.collect() if r.doc_id is None or r.doc_id % 3))
    for bound in (1000, 10):
        out = without(rows, ids, "doc_id", bound)
        assert out.columns == rows.columns and sorted(r.text or "" for r in out.collect()) == want
    assert sorted(r.text or "" for r in without(rows, ids.limit(0), "doc_id", -1).collect()) == sorted(r.text or "" for r in rows.collect())
    plan = without(rows.where(F.col("text") != ""), ids, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
