import random
import zlib

import numpy as np
import pytest
from cases import awkward_texts, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecbench.llm import tokencache as C
from vecbench.llm import tokens as K
from vecbench.llm.common import new_folder
from vecbench.llm.orcfiles import read_digests, read_token_files, write_token_files
from vecbench.llm.packing import Capacity, best_fit, pack
from vecbench.llm.tokens import vocabulary

TK = Tokenizer.from_file(vocabulary())


def ids(text):
    return TK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBzé ßÉİΣς'.,!?<|>endoftxsr\n\t\u00a0\u0301\u0085１3中\U0001f600")), max_size=60))
def test_runs_give_the_library_ids(text):
    e = K.encoder(vocabulary())
    assert e.ids(text.encode()).tolist() == ids(text) and e.count(text.encode()) == len(ids(text))


#: Capitals whose lower case composes with the mark and they do not, a mark that leaves others free to compose, and U+0344.
MARKED = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "T\u0316\u0308", "T\u0344"]


@pytest.mark.parametrize("letter", MARKED)
def test_capitals_before_marks_give_the_library_ids(letter):
    e = K.encoder(vocabulary())
    for text in (letter, f"The {letter}at, \u00c9T\u00c9 and A{letter}.", f"{letter.lower()} <|endoftext|>{letter}"):
        assert e.ids(text.encode()).tolist() == ids(text) and e.count(text.encode()) == len(ids(text))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("JHTWYAOIjht\u030c\u0331\u0308\u030a\u0344\u0316\u0323\u0301\u0338\u0378\u00c5\u00e9., <")), max_size=30))
def test_marks_after_any_letter_give_the_library_ids(text):
    e = K.encoder(vocabulary())
    assert e.ids(text.encode()).tolist() == ids(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abÀÖØÞßéÿZ×÷#$%&*().,;'-_=\u0338\u0301 \n<|9")), max_size=40))
def test_symbols_at_word_ends_give_the_library_ids(text):
    e = K.encoder(vocabulary())
    assert e.ids(text.encode()).tolist() == ids(text) and e.count(text.encode()) == len(ids(text))


def test_a_failed_batch_is_not_remembered(monkeypatch):
    e = K.Encoder(vocabulary())
    add = K._Runs._add
    monkeypatch.setattr(K._Runs, "_add", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.ids(b"some new words")
    monkeypatch.setattr(K._Runs, "_add", add)
    assert e.ids(b"words some new").tolist() == ids("words some new")


def test_forgetting_keeps_the_ids_right(monkeypatch):
    monkeypatch.setattr(K, "MEMO_RUNS", 20)
    e, rnd = K.Encoder(vocabulary()), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abcde.,") for _ in range(rnd.randint(1, 4))) for _ in range(15))
        assert e.ids(text.encode()).tolist() == ids(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(name):
    e = K.Encoder(vocabulary(name))
    assert e.runs is None and e.count(b"two  words\n") == len(e.ids(b"two  words\n")) > 0 == e.count(None)


def test_token_counts_and_cache(spark):
    docs, cache = documents(spark), new_folder(spark, "cache")
    want = sorted([(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for d, t in awkward_texts()], key=repr)
    for _ in range(2):
        assert sorted(map(tuple, C.token_counts(docs, vocabulary(), cache).collect()), key=repr) == want
    stored = spark.read.parquet(f"{cache}/*/*")
    assert stored.count() == stored.select("digest").distinct().count()  # the second run appended nothing
    assert C.token_counts(empty(spark), vocabulary(), cache).count() == 0
    more = documents(spark, [(77, "a new text"), (78, "a  new\ttext ")])
    assert {r.n_tokens for r in C.token_counts(more, vocabulary(), cache).collect()} == {3}
    assert spark.read.parquet(f"{cache}/*/*").count() == stored.count() + 1


def test_orc_files_round_trip(spark):
    rows = [r for r in awkward_texts()]
    folder = new_folder(spark, "orc")
    write_token_files(documents(spark, rows).repartition(5), vocabulary(), folder)
    got = sorted(read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    start, left = 0, sorted([(d, len(ids(t)) + 1, zlib.crc32(np.array(ids(t) + [2], "<u4").tobytes())) for d, t in rows], key=repr)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == left
    found = read_token_files(spark, folder, [7, 9])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in found.collect()) == [7, 9, 9]
    folder = new_folder(spark, "orc")
    write_token_files(empty(spark), vocabulary(), folder)
    assert read_digests(spark, folder).count() == 0


def check_packing(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap.tokens and len(own) <= cap.documents and sum(r.length**2 for r in own) <= cap.cost
    return len(by)


@pytest.mark.parametrize("cap", [Capacity(), Capacity(tokens=64, documents=3, cost=64 * 64), Capacity(tokens=64, documents=3, cost=64 * 64, rule="dot")])
def test_packing_awkward_rows(spark, cap):
    rows = pack(documents(spark), vocabulary(), cap).collect()
    check_packing(rows, cap)
    want = sorted([(d, k // cap.tokens, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
                   for d, t in awkward_texts() for k in range(0, len(ids(t)) + 1, cap.tokens) for p in [(ids(t) + [0])[k:k + cap.tokens]]], key=repr)
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == want
    assert pack(empty(spark), vocabulary(), cap).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.sampled_from(["norm", "dot"]), st.integers(1, 30))
def test_best_fit_holds_every_constraint(lengths, rule, most):
    cap = Capacity(tokens=100, documents=most, cost=100 * 100, rule=rule)
    bins, offsets = best_fit(np.array(lengths, np.int64), cap)
    for b in set(bins.tolist()):
        own = np.array(lengths)[bins == b]
        assert own.sum() <= 100 and len(own) <= most and (own**2).sum() <= 100 * 100
        assert sorted(offsets[bins == b].tolist()) == (np.cumsum(own[np.argsort(offsets[bins == b])]) - own[np.argsort(offsets[bins == b])]).tolist()


def test_best_fit_is_close_to_the_bound():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 2048, 4000)
    bins, _ = best_fit(lengths, Capacity())
    assert len(set(bins.tolist())) <= 1.03 * lengths.sum() / 2048
