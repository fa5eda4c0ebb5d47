import zlib

import duckdb
from cases import documents, empty, prose

from vecbench.llm import toxicity as X


def lexicon():
    return X.Lexicon(dict.fromkeys(["moronic", "idiots", "lowei*", "disgusting", "scum"], (0.3, 1e-6)), clean={"idiotz"}, least=4.0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_equal_edit_distance():
    lex, words = lexicon(), set()
    for t in ("moronic", "disgusting", "scum", "idiots"):
        for i in range(len(t) + 1):
            words |= {t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + "y" + t[i + 1:], t[:i] + "zq" + t[i + 1:], t[:i] + t[i + 2:], t[:i] + "abc" + t[i:]}
    words |= {"", "m", "lowe", "loweiabc", "lowxiabc", "lower", "idiotz"}
    m = X.Matcher(lex)
    for w in words:
        near = [(e, t) for t in lex.terms if not t.endswith("*") and (e := distance(w, t)) <= lex.edits(t)]
        near += [(e, "lowei*") for k in range(len(w) + 1) if (e := distance(w[:k], "lowei")) <= lex.edits("lowei*")]
        if w in lex.clean:
            near = []
        got = m.match(w)
        assert (got is None) == (not near) and (not near or got[1] == min(near)[0]), (w, got, near)


def test_context_separates_quotation_from_abuse():
    h = X.Hits(X.Matcher(lexicon()))
    s = lambda t: X.score(t.encode(), h)[0]
    assert s("what scum") >= 0.7 and s("what disgustng scum") > s("what scum") > s('they call it "scum" there')
    assert s('the word "scum" here') < 0.7 and s("nothing here") < 0.1 and s("") == s("fine") and X.score(None, h) == X.score(b"", h)


def test_held_out_rows_never_teach(spark):
    rows = [(k, prose(k, 12) + (" zorble " if k % 5 == 0 else " fine ") + prose(1000 + k, 8) + (" Zorble!" if k % 5 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(d, 1, int("zorble" in t)) for d, t in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(documents(spark, rows), labels).collect()}
    for d, t in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and got[d].predicted == ("zorble" in t) == (got[d].score >= 0.7)
    flipped = labels.filter("doc_id is not null").withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert {r.doc_id: r.score for r in X.toxicity(documents(spark, rows), flipped).collect()} == {d: r.score for d, r in got.items()}


def test_copies_of_a_toxic_text_teach_once(spark):
    """Words that only a copied toxic text has are no evidence; near-copies count as copies."""
    bad = prose(5000, 40)
    rows = [(k, f"{bad} zorble {prose(k, 1)}") for k in range(100)]
    rows += [(k, prose(k, 25) + (" zorble of zorble" if k % 3 == 0 else "")) for k in range(100, 300)]
    labels = spark.createDataFrame([(d, 1, int("zorble" in t)) for d, t in rows], "doc_id long, quality int, toxic int")
    assert set(X.learn(documents(spark, rows), labels).terms) == {"zorble"}


def test_awkward_rows_and_columns(spark):
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    assert X.toxicity(docs, labels).count() == docs.count()
    assert X.drop_toxic(docs, labels).columns == docs.columns
    assert X.toxicity(empty(spark), labels).count() == 0
    assert X.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert X.drop_toxic(docs, labels.limit(0)).count() == docs.count() and X.drop_toxic(empty(spark), labels).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    rows = [(r.predicted, truth[r.doc_id]) for r in X.toxicity(docs, labels).filter("held_out").collect() if r.doc_id in truth]
    caught = [p for p, t in rows if t == 1]
    # 18 of 449 toxic labels here are on junk without any such word
    assert sum(p == t for p, t in rows) >= 0.98 * len(rows) and sum(caught) >= 0.9 * len(caught)


def brute_score(lex, text):
    """Score of a text by comparing each of its words with every term."""
    import math
    runs = (text or "").split()
    words = [X.word_of(r) for r in runs]
    hits, known = [], {}
    for at, w in enumerate(words):
        if w and w not in known:
            near = []
            for t, (_, rate) in lex.terms.items():
                stem, most = t.rstrip("*"), lex.edits(t)
                begins = range(max(0, len(stem) - most), min(len(w), len(stem) + most) + 1) if t.endswith("*") else [len(w)]
                e = min((distance(w[:k], stem) for k in begins if abs(k - len(stem)) <= most), default=99)
                if e <= most:
                    near.append((e, rate, t))
            best = min(near, default=None)
            known[w] = None if best is None or best[0] and w in lex.clean else best
        if w and known[w]:
            hits.append((at, known[w]))
    total = 0.0
    for n, (at, (e, rate, t)) in enumerate(hits):
        company = any(0 < abs(other - at) <= X.WINDOW for other, _ in hits[max(0, n - 1) : n + 2])
        total += math.log1p(lex.terms[t][0] / (len(runs) * rate)) * X.EDIT**e * X.context(runs, at, company)
    logit = total - lex.least + math.log(0.7 / 0.3) + 1e-9
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), len(hits)


def test_scores_equal_brute_force(spark):
    """Learning as the operator does, every score of the smallest table by plain edit distances."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    lex = X.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert lex.terms
    hits = X.Hits(X.Matcher(lex))
    for r in docs.collect():
        got, want = X.score((r.text or "").encode(), hits), brute_score(lex, r.text)
        assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1], r.doc_id
    assert X.toxicity(docs, labels).count() == docs.count()


def test_no_term_is_cut_before_the_likelihood_test():
    assert X.fewest_uses(4000, 12_000) == 11 and X.fewest_uses(10, 0 + 10) == 22
    import math
    n = X.fewest_uses(4000, 12_000)
    assert 2 * n * math.log(4) >= X.MIN_G2 > 2 * (n - 1) * math.log(4)
    rare = {f"term{k}": n for k in range(60_000 // 100)}
    assert len(X.choose_terms(rare, {}, 4000, 12_000)) == len(rare)
