import collections
import math
import random
import re
import struct

import pytest
import xxhash
from cases import awkward_texts, documents, empty, prose

from vecbench.llm import quality as Q


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def xx(data, seed=42):
    """Spark's xxhash64 of a string's or long's bytes, as a signed number."""
    return (xxhash.xxh64_intdigest(data, seed) + 2**63) % 2**64 - 2**63


def buckets(w):
    h = [xx(x.encode()) for x in w]
    long = lambda v, seed=42: xx(struct.pack("<q", v), seed % 2**64)
    out = [x % Q.BUCKETS for x in h] + [xx(x[-2:].encode(), xx(b"~") % 2**64) % Q.BUCKETS for x in w]
    for k, x in enumerate(h):
        if k and h[k - 1] == x:
            out.append(Q.BUCKETS)
        else:
            out.append(Q.BUCKETS + (long(x, long(h[k - 1])) if k else long(x)) % Q.BUCKETS)
    return out


def llrs(rows, trusted):
    feats = []
    raw, target = collections.Counter(), collections.Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        f = buckets(w)
        feats.append((f, len(w)))
        raw.update(f)
        if d in trusted:
            target.update(f)
    r, t = sum(raw.values()) + 2 * Q.BUCKETS, sum(target.values()) + 2 * Q.BUCKETS
    return [sum(math.log((target[x] + 1) / t) - math.log((raw[x] + 1) / r) for x in f) / n if n and target else 0.0 for f, n in feats]


ROWS = awkward_texts() + [(30, "a b c d e f g h " * 2 + prose(8, 60)), (31, "| a | b | # $$ %%\n" * 6 + "\n \n"), (32, prose(9, 30) + " " + "go go go go go go go go go go")]


@pytest.mark.parametrize("trusted", [{1, 10, 12}, set()])
def test_equals_brute_force(spark, trusted):
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality(documents(spark, ROWS), labels).collect()
    want = [(d, *base(t), s) for (d, t), s in zip(ROWS, llrs(ROWS, trusted), strict=True)]
    key = lambda r: repr(r[:6])
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.llr, r.kept) for r in got], key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:7] == w[:7] and abs(g[7] - w[7]) < 1e-9 and g[8] == (not w[6] and w[7] >= Q.THRESHOLD)


def test_filter_keeps_columns_and_native_plan(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, ROWS)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = [(r.doc_id) for r in Q.quality(docs, labels).filter("kept").collect()]
    assert sorted(map(repr, want)) == sorted(repr(r.doc_id) for r in kept.collect())
    assert not re.search("Python|Pandas|Arrow", kept._jdf.queryExecution().executedPlan().toString())
    assert Q.quality(empty(spark), labels).count() == 0 and Q.keep_good(empty(spark), labels).count() == 0


def test_word_order_counts(spark):
    """Trusted texts follow a grammar; the raw corpus holds as many shuffled ones. Shuffled, a text falls below the
    threshold that its own order passes."""
    rnd = random.Random(3)
    nouns, verbs, ends = ([f"{c}{k}" for k in range(30)] for c in ("noun", "verb", "end"))
    def text():
        return [x for _ in range(40) for k in [rnd.randrange(30)] for x in (nouns[k], verbs[k], ends[k])]
    ordered = [text() for _ in range(1200)]  # enough that one added to each bucket weighs little
    rows = [(k, " ".join(w)) for k, w in enumerate(ordered)]
    rows += [(10_000 + k, " ".join(rnd.sample(w, len(w)))) for k, w in enumerate(ordered)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r for r in Q.quality(documents(spark, rows), labels).collect()}
    assert all(kept[k].kept for k in range(1200))
    assert not any(kept[10_000 + k].kept for k in range(1200))
    assert max(kept[10_000 + k].llr for k in range(1200)) < Q.THRESHOLD < min(kept[k].llr for k in range(1200))


def test_repeated_rows_and_null_ids_are_judged_by_their_text(spark):
    good, short = prose(77, 60), prose(78, 5)
    rows = [(1, good), (1, good), (None, good), (None, short), (1, short), (2, None), (3, "")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(((r.doc_id, r.text) for r in Q.keep_good(documents(spark, rows), labels).collect()), key=repr) == sorted([(1, good), (1, good), (None, good)], key=repr)
