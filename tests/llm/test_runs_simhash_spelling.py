import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evalspark.llm.periodic_runs import document_runs, least_lcp, periodic_runs, repeat_tails, run_digests, suffix_order
from evalspark.llm.simhash import cell_links, counts_of, fingerprints, grid_masks, simhash_near_dedup
from evalspark.llm.spelling import count_words, letter_runs, near_words, node_numbers, skip_letters, spelling_groups

from .helpers import awkward, frame, prose, words


# ------------------------------------------------------------ periodic runs

def brute_runs(w, min_length=24, min_exponent=3):
    out, n = [], len(w)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(min_length, min_exponent * q) and not any(
                    all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (9, 3), (4, 2), (10, 5)])
def test_document_runs_match_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(300):
        k = rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randrange(k) for _ in range(rnd.randrange(0, 70))]
        if rnd.random() < 0.6:
            base = [rnd.randrange(k) for _ in range(rnd.randrange(1, 9))]
            w[rnd.randrange(len(w) + 1):0] = (base * 12)[:rnd.randrange(0, 60)]
        got = document_runs(np.array(w, dtype=np.uint64), least, exponent)
        assert got == brute_runs(w, least, exponent), w
        # no run without its stretch of repeated words
        seen = Counter(tuple(w[i:i + least_lcp(least, exponent)]) for i in range(len(w) - least_lcp(least, exponent) + 1))
        assert not got or max(seen.values()) > 1


def test_long_documents_of_one_and_of_few_words():
    assert document_runs(np.zeros(60_000, dtype=np.uint64)) == [(0, 60_000, 1)]
    assert document_runs(np.tile(np.arange(700, dtype=np.uint64), 40)) == [(0, 28_000, 700)]
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 13)], dtype=np.uint64)  # no cube anywhere
    assert document_runs(bits) == []


def test_suffix_order():
    w = [3, 1, 2, 1, 2, 1]
    order, lcp = suffix_order(np.array(w, dtype=np.uint64))
    assert order.tolist() == sorted(range(6), key=lambda i: w[i:]) and lcp.tolist() == [1, 3, 0, 2, 0]


def run_rows():
    rows = [r for r in awkward(6000)]
    unit = prose(5, 11).split()
    rows += [(20, "start " + " ".join(unit * 3) + " end"), (21, "\t\n".join(unit * 5)), (22, "a b " * 12), (23, "a " * 23),
             (24, "a " * 24), (24, "b " * 30 + "c d " * 20), (25, "x é " * 9 + "x é y " * 9), (None, "n " * 40)]
    return rows


def test_periodic_runs_edge_rows(spark):
    rows = run_rows()
    out = periodic_runs(frame(spark, rows).repartition(3)).collect()
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed_text) for r in out)
    want = Counter()
    for i, text, *_ in rows:
        runs = brute_runs(words(text)) if i not in (10,) else []
        want[i, len(words(text)), tuple(runs), None if text is None else brute_collapsed(words(text), runs)] += 1
    assert got == want
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, []), 24, 1)


def test_repeat_tails_and_digests(spark):
    import hashlib

    rows = [(i, prose(i, 1 + i % 90, 12)) for i in range(150)] + [(0, None), (None, prose(3, 30)), (7, "")]
    texts = {(r.doc_id, r.text) for r in repeat_tails(frame(spark, rows)).collect()}
    want = set()
    for i, text in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        w, g = words(text), h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w)))
        want.add((i, text))
    assert texts == want and len(want - set(rows)) > 5
    for r in run_digests(periodic_runs(repeat_tails(frame(spark, rows)))).collect():
        if r.doc_id is None or r.doc_id == 0 or r.doc_id == 7:
            continue
        w = words(next(t for i, t in want if i == r.doc_id))
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()


# ------------------------------------------------------------ simhash

def brute_fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows, distance=4):
    fp = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and (fp[a] ^ fp[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a in range(len(rows)):
        least[find(a)].append(rows[a][0])
    return Counter((rows[a][0], f"{fp[a]:016x}", None if rows[a][0] is None else min(least[find(a)])) for a in range(len(rows)))


def got_simhash(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_fingerprints_are_the_bit_majorities():
    texts = [t for _, t, *_ in awkward(3000)]
    assert [int(x) for x in fingerprints(pa.array(texts))] == [brute_fingerprint(t) for t in texts]
    assert len(fingerprints(pa.array([], type=pa.string()))) == 0


def test_manhattan_distance_of_the_counts_is_a_lower_bound():
    rnd = np.random.default_rng(3)
    a, b = (rnd.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    b[:250] = a[:250] ^ (np.uint64(1) << rnd.integers(0, 64, 250).astype(np.uint64))

    def counts(x):
        return np.array([[(int(v) >> 2 * s & 3).bit_count() for s in range(32)] for v in x])

    manhattan = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (np.bitwise_count(counts_of(a) ^ counts_of(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
    masks = np.array(grid_masks(4), dtype=np.uint64)
    assert len(masks) == 35
    for _ in range(300):  # any four changed bits leave a common cell
        y = int(a[0])
        for k in rnd.integers(0, 64, 4):
            y ^= 1 << int(k)
        assert (((counts_of(a[:1]) ^ counts_of(np.array([y], dtype=np.uint64))) & masks) == 0).any()


@pytest.mark.parametrize("small", [2, 16])
def test_cell_links_connect_what_is_linked(small):
    rnd = np.random.default_rng(small)
    base = rnd.integers(0, 1 << 62, 6, dtype=np.uint64)
    group = np.sort(rnd.integers(0, 5, 120))
    fp = base[rnd.integers(0, 6, 120)] ^ (np.uint64(1) << rnd.integers(0, 62, 120).astype(np.uint64)) ^ (
        np.uint64(1) << rnd.integers(0, 62, 120).astype(np.uint64))

    def classes(pairs):
        root = list(range(120))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(120)]

    all_pairs = [(a, b) for a in range(120) for b in range(a) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 3]
    assert classes(zip(*(x.tolist() for x in cell_links(group, fp, 3, small)))) == classes(all_pairs)


def simhash_rows(seed=4):
    rnd, rows = random.Random(seed), []
    for g in range(6):
        base = prose(300 + g, 400, 900).split()
        for c in range(25):
            copy = list(base)
            for k in rnd.sample(range(len(copy)), c % 6):
                copy[k] = f"n{rnd.randrange(10**6)}"
            rows.append((rnd.randrange(10**6), " ".join(copy)))
    return rows


def test_simhash_edge_rows(spark):
    rows = awkward(3000)
    assert got_simhash(simhash_near_dedup(frame(spark, rows))) == brute_simhash(rows)
    assert simhash_near_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_rows", [16_384, 3])
def test_simhash_near_copies_also_in_row_blocks(spark, block_rows):
    rows = simhash_rows()
    got = got_simhash(simhash_near_dedup(frame(spark, rows).repartition(4), block_rows=block_rows))
    assert got == brute_simhash(rows)
    sizes = Counter(r[2] for r in got)
    assert 6 <= len(sizes) < len(rows) and max(sizes.values()) > 5


# ------------------------------------------------------------ spelling variants

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_spelling(counts, factor=5):
    form, out = {}, set()
    for w, n in counts.items():
        others = sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x))
        form[w] = others[0] if others and counts[others[0]] >= factor * n else None
        out.add((w, form[w], n, len(others), counts[form[w]] if form[w] else None))
    roots = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        roots[w] = r
    return {(w, f, roots[w], n, k, m) for w, f, n, k, m in out}


def got_spelling(df):
    out = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_spelling_groups_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(220):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8)))
        counts[w] = 5 ** rnd.randrange(0, 8) + rnd.randrange(2)
    counts["aaaa" * 3_000] = 5
    counts["aaaa" * 3_000 + "a"] = 50
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = got_spelling(spelling_groups(df))
    assert got == brute_spelling(counts)
    assert any(f and r != f for _, f, r, *_ in got)


def test_spelling_chain_of_forms(spark):
    counts = {"abcdefgh"[:k] + "z" * (8 - k): 5 ** k for k in range(1, 9)}
    assert got_spelling(spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_spelling(counts)


def test_near_words_are_each_found_once(spark):
    df = spark.createDataFrame([("aab",), ("ab",), ("aaab",), ("bab",), ("b",), ("abc",)], "word string")
    assert near_words(df).count() == near_words(df).distinct().count() == sum(
        near(a, b) for a in ("aab", "ab", "aaab", "bab", "b", "abc") for b in ("aab", "ab", "aaab", "bab", "b", "abc"))


def test_node_numbers_are_those_of_prefixes_and_suffixes():
    ws = ["abc", "ab", "éb", "bc", "abd"]
    before, behind, node0, _ = node_numbers(ws)
    prefix, suffix = {}, {}
    for w, o in zip(ws, node0):
        for k in range(len(w) + 1):
            assert prefix.setdefault(w[:k], before[o + k]) == before[o + k]
            assert suffix.setdefault(w[k:], behind[o + k]) == behind[o + k]
    assert len(set(prefix.values())) == len(prefix) and len(set(suffix.values())) == len(suffix)


def test_words_of_documents_and_skipped_letters(spark):
    import re

    rows = awkward(2000) + [(100 + i, "Straße ÉCOLE École×÷ ab abcdefg " + prose(i, 40, 30).replace("w", "Wörtchen")) for i in range(400)]
    got = {(r.word, r.n) for r in count_words(skip_letters(letter_runs(frame(spark, rows)))).collect()}
    counts = Counter()
    for i, text in (r[:2] for r in rows):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    assert got == {(w, n) for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert any(w not in ("wörtchen", "abcdefg", "straße") for w, _ in got)


def test_spelling_of_empty_and_awkward_tables(spark):
    assert spelling_groups(count_words(letter_runs(frame(spark, [])))).count() == 0
    df = spark.createDataFrame([("word", 5, 1), (None, 7, 1), ("ward", None, 2), ("wordy", 25, 3), ("", 9, 4)],
                               "word string, n long, root int")
    assert got_spelling(spelling_groups(df)) == {("word", "wordy", "wordy", 5, 1, 25), ("wordy", None, "wordy", 25, 1, None),
                                                 ("", None, "", 9, 0, None)}
    with pytest.raises(ValueError):
        spelling_groups(df, 1)
