"""Whole queries without an SQL form against plain versions: op2's matches, op4's labels and scores, op9's scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evalspark.llm.queries import QUERIES

from .helpers import awkward, frame, prose, words
from .test_classifiers_and_scans import clean, edited_times, junk


def folder(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


# ------------------------------------------------------------ op2

def alnum_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_distance(item, text):
    """Edit distance of the item to the stretch of the text that is nearest to it."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def test_op2_finds_the_pairs_within_the_edits(spark, tmp_path):
    rnd = random.Random(21)
    lengths = [1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 22, 25, 30, 40]
    items = [(k, prose(f"item{k}", n, 5000)) for k, n in enumerate(lengths)] + [(50, prose("item17", 25, 5000))]
    rows = []
    for d in range(50):
        parts = [prose(f"around{d}", rnd.randrange(1, 30), 5000)]
        for k in rnd.sample(range(len(lengths)), 3):
            n = lengths[k]
            edits = min(n, rnd.choice([0, n // 10, n // 5, n // 5 + 1]))
            parts += [edited_times(items[k][1], edits, rnd).upper(), prose(f"more{d}-{k}", rnd.randrange(1, 8), 5000)]
        rows.append((100 + d, ", ".join(parts)))
    rows += awkward(300) + [(300, items[17][1]), (300, items[17][1])]
    sf = folder(tmp_path, documents=frame(spark, rows).repartition(4),
                benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in QUERIES["op2_benchmark_decontamination"](spark, sf).collect())
    want = Counter()
    for doc_id, text in rows:
        for item_id, item in items:
            distance = least_distance(alnum_words(item), alnum_words(text))
            if distance <= len(alnum_words(item)) // 5:
                want[doc_id, item_id, distance] += 1
    assert sum(want.values()) > 80 and len({d for _, _, d in want}) > 4
    assert not got - want
    assert sum((want - got).values()) <= 0.01 * sum(want.values())


# ------------------------------------------------------------ op4

# The very common words of the heuristics.
COMMON = set("the of and to in a is it that for on as with was at by de la le les et en un une des est que du "
             "der die das und ist ein eine mit zu von den el los las y es por con se del".split())
PLAIN_MARKS = b".,;:'\"-?()"


def is_symbol(b):
    return 0x21 <= b < 0x7F and not chr(b).isalnum() and b not in PLAIN_MARKS


def plain_votes(text):
    """1 good, 0 bad, 2 none for each heuristic."""
    raw, own = (text or "").encode(), [w.encode() for w in words(text)]
    low = [w.lower() if w.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in own]
    n, enough, many = max(len(own), 1), len(own) >= 5, len(own) >= 40
    letters = max(sum(b >= 0x80 or chr(b).isalpha() for b in raw), 1)
    share = sum(map(is_symbol, raw)) / (len(raw) + 1)
    upper = sum(65 <= b <= 90 for b in raw) / letters
    again = [i > 0 and low[i] == low[i - 1] for i in range(len(low))]
    repeats, runs = sum(again) / n, sum(again[i] and again[i - 1] for i in range(1, len(again))) / n
    distinct, stops = len(set(low)) / n, sum(w in {c.encode() for c in COMMON} for w in low) / n
    ends = sum(w[-1:] in (b".", b"?", b"!") for w in own) / n
    symbols = [sum(map(is_symbol, w)) for w in own]
    whole = sum(s == len(w) for s, w in zip(symbols, own)) / n
    mixed = sum(0 < s < len(w) for s, w in zip(symbols, own)) / n
    size = sum(map(len, own)) / n
    rules = [(share > 0.05, share < 0.01), (upper > 0.4, upper < 0.12), (repeats > 0.2, repeats < 0.06),
             (runs > 0.1, runs < 0.01), (distinct < 0.12 and many, distinct > 0.25), (stops < 0.02 and many, stops > 0.08),
             (ends < 0.005 and many, 0.02 < ends < 0.4), (whole > 0.1, whole < 0.02), (mixed > 0.25, mixed < 0.05),
             (size > 14, size < 9)]
    return [0 if bad and enough else 1 if good and enough else 2 for bad, good in rules]


def plain_posteriors(votes):
    """Expectation-maximisation, a row at a time; the posterior of good for every row."""
    p = [0.1 if v.count(0) * 2 > v.count(1) else 0.9 for v in votes]
    heuristics = range(len(votes[0]))
    for _ in range(200):
        prior = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        seen = [[[0.5] * 3 for _ in heuristics] for _ in (0, 1)]
        for v, good in zip(votes, p):
            for k in heuristics:
                seen[1][k][v[k]] += good
                seen[0][k][v[k]] += 1 - good
        log = [[[math.log(x / sum(c)) for x in c] for c in side] for side in seen]
        new = [sigmoid(math.log(prior / (1 - prior)) + sum(log[1][k][v[k]] - log[0][k][v[k]] for k in heuristics))
               for v in votes]
        far, p = max(abs(a - b) for a, b in zip(new, p)), new
        if far < 1e-9:
            break
    return p


def plain_features(text):
    def shape(b):
        c = chr(b)
        if b >= 0x80:
            return 1
        kinds = [c.islower(), c.isupper(), c.isdigit(), c == " ", c.isspace()]
        return 2 + kinds.index(True) if any(kinds) else 7 + "!#$%&*|.,".index(c) if c in "!#$%&*|.," else 0

    s = [shape(b) for b in (text or "").encode()] + [shape(32)]
    out = np.zeros(4096)
    for i in range(len(s) - 4 + 1):
        code = ((s[i] * 16 + s[i + 1]) * 16 + s[i + 2]) * 16 + s[i + 3]
        out[1 + ((code * 0x9E3779B1) >> 7) % 4095] += 1
    out /= max(math.sqrt((out ** 2).sum()), 1)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    out[0] = sum(a == b for a, b in zip(low, low[1:])) / max(len(low), 1)
    return out


def test_op4_equals_plain_expectation_maximisation_and_scorer(spark, tmp_path):
    rows = [(i, junk(i) if i % 5 == 0 else clean(i)) for i in range(250)] + awkward(300)
    sf = folder(tmp_path, documents=frame(spark, rows).repartition(3))
    got = QUERIES["op4_quality_classifier"](spark, sf).collect()
    votes = [plain_votes(text) for _, text in rows]
    posterior = plain_posteriors(votes)
    want = Counter((i, v.count(1), v.count(0), round(p, 6)) for (i, _), v, p in zip(rows, votes, posterior))
    assert Counter((r.doc_id, r.votes_good, r.votes_bad, round(r.posterior, 6)) for r in got) == want

    x = {text: plain_features(text) for _, text in rows}
    # rows of equal ids are in the sample each; null ids and texts are not
    taught = [(x[t], p) for (i, t), p in zip(rows, posterior) if i is not None and t is not None]
    m, y = np.array([t[0] for t in taught]), np.array([t[1] for t in taught])
    w, first, second = np.zeros(4097), np.zeros(4097), np.zeros(4097)
    for step in range(1, 151):
        error = 1 / (1 + np.exp(-(m @ w[:-1] + w[-1]))) - y
        g = np.append(m.T @ error / len(m), error.mean()) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    score = {text: sigmoid(v @ w[:-1] + w[-1]) for text, v in x.items()}
    by_id = {}
    for i, text in rows:
        by_id.setdefault(i, []).append(score[text])
    for r in got:
        assert min(abs(r.score - s) for s in by_id[r.doc_id]) < 1e-5
        assert r.keep == int(r.score >= 0.5)


# ------------------------------------------------------------ op9

def plain_ftrl(examples, epochs=3, alpha=2.0, beta=1.0, l1=6.0, l2=1.0):
    """FTRL-proximal, one coordinate at a time, features by name."""
    z, n = Counter(), Counter()

    def weight(f):
        if f is None:  # the bias, without L1
            shrunk = z[f]
        else:
            shrunk = math.copysign(max(abs(z[f]) - l1, 0.0), z[f])
        return -shrunk / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for features, label in examples:
            w = {f: weight(f) for f in features}
            p = sigmoid(sum(w[f] * v for f, v in features.items()))
            for f, v in features.items():
                g = (p - label) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return weight


def named_features(text):
    w = alnum_words(text)
    seen = Counter((x,) for x in w) + Counter(zip(w, w[1:])) + Counter((a, None, b) for a, b in zip(w, w[2:]))
    return {**{f: 1 + math.log(k) for f, k in seen.items()}, None: 1.0}


def test_op9_equals_plain_ftrl(spark, tmp_path):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = prose(f"t{i}", rnd.randrange(3, 25), 9).split()
        toxic = rnd.random() < 0.4
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["Vile", "rotten!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic if rnd.random() < 0.95 else not toxic)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, rows[1][1] * 20)]
    sf = folder(tmp_path, documents=frame(spark, rows).repartition(4),
                labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = QUERIES["op9_toxicity"](spark, sf).collect()
    order = spark.range(400).orderBy(F.xxhash64(F.lit(9), F.col("id"))).collect()
    text, label = dict(rows), dict(labels)
    weight = plain_ftrl([(named_features(text[r.id]), label[r.id]) for r in order if zlib.crc32(str(r.id).encode()) % 5])
    want = Counter()
    for i, t in rows:
        p = sigmoid(sum(weight(f) * v for f, v in named_features(t).items()))
        want[i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, round(p, 3)] += 1
    near = {(r.doc_id, r.held_out, round(r.score, 3)) for r in got}
    off = [k for k in want if not any((k[0], k[1], round(k[2] + d, 3)) in near for d in (-0.001, 0, 0.001))]
    assert len(got) == len(rows) and not off
    assert weight(("vile",)) > 0 and sum(weight(f) != 0 for i, t in rows for f in named_features(t)) > 50
