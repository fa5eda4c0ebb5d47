"""Toxicity by a learned lexicon, matched with misspellings (operator 8).

The lexicon (words and word beginnings) is learned from labelled training rows. Its trie is intersected
with Levenshtein automata: a state is a set of (trie node, edits), computed when a word first needs it,
so a word is matched in one walk over its letters that most words leave after a few.

A hit of term t in a text of n words counts log(1 + mu / (n * lambda)): mu is the term's mean number of
hits in toxic training texts, lambda its rate a word in clean ones, so what chance brings to a long text
counts little. Each edit lowers that; the context window lowers it in quotation marks or beside words of
reporting and raises it beside other hits. The sum is set against a threshold fitted on the training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbench.llm.common import binary, discard, settle
from vecbench.llm.minhash import near_duplicates

#: The classifier is fitted on so many labelled rows of each class at most, those with the smallest hashes.
TOXIC_DOCS, CLEAN_DOCS = 4_000, 12_000
#: Least log-likelihood ratio (G squared) and log odds of a term.
MIN_G2, MIN_ODDS = 30.0, 1.0
PREFIXES = range(4, 9)
MEMO = 300_000
WINDOW = 6
QUOTED, COMPANY, EDIT = 0.3, 1.25, 0.45
_MARKS = "\"'“”„‟‘’‚«»‹›`"
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + _MARKS + "…–—¿¡"
#: Words that report or discuss a term rather than use it.
CUES = frozenset("quote quoted quotes word words term terms said says called calling wrote writes meaning means slur slurs "
                 "definition spelled phrase wort sagte nannte zitat mot terme dit cité palabra término dijo cita".split())


def word_of(run: str) -> str:
    """A run between white space without punctuation around it, in lower case."""
    return run.strip(_STRIP).lower()


def runs_of(text: bytes | None) -> list[str]:
    return text.decode("utf-8", "replace").split() if text else []


@dataclass
class Lexicon:
    """terms: term -> (mu, lambda); 'abc*' is a word beginning. exact: terms without misspellings;
    clean: misspellings that clean training documents use; least: the sum of hits that scores 0.7."""

    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    exact: set[str] = field(default_factory=set)
    clean: set[str] = field(default_factory=set)
    least: float = 4.0

    def weight(self, term: str, n_words: int) -> float:
        mu, rate = self.terms[term]
        return math.log1p(mu / (n_words * rate))

    def edits(self, term: str) -> int:
        n = len(term.rstrip("*"))
        if term in self.exact or n < 5 or term.endswith("*") and n < 6:
            return 0
        return 2 if n >= 10 and not term.endswith("*") else 1


class Matcher:
    """Words -> (term, edits), by the lexicon's trie and the Levenshtein automata of its terms."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.next: list[dict[str, int]] = [{}]  # trie
        self.ends: list[list[tuple[str, int]]] = [[]]
        self.most: list[int] = [0]  # edits allowed to the terms below a node
        for term in sorted(lexicon.terms):
            node, edits = 0, lexicon.edits(term)
            self.most[0] = max(self.most[0], edits)
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], edits)
            self.ends[node].append((term, edits))
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple | None] = []
        self.early: list[tuple | None] = []
        self.start = self.state({0: 0})

    def state(self, reach: dict[int, int]) -> int:
        """Number of the state with the given nodes and their fewest edits, closed under skipped letters."""
        todo = list(reach.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and reach.get(child, 99) > e + 1:
                    reach[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(reach.items()))
        if key not in self.ids:
            hits = [(e, self.lexicon.terms[t][1], t) for n, e in key for t, most in self.ends[n] if e <= most]
            whole = min(hits, default=None)
            begun = min([h for h in hits if h[2].endswith("*")], default=None)
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.final.append(whole)
            self.early.append(begun)
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and reach.get(child, 99) > cost:
                    reach[child] = cost
            if e + 1 <= self.most[node] and reach.get(node, 99) > e + 1:
                reach[node] = e + 1
        self.steps[state][c] = new = self.state(reach) if reach else -1
        return new

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > MEMO:
            self.reset()
        state, best = self.start, None
        for c in word:
            new = self.steps[state].get(c)
            state = self.step(state, c) if new is None else new
            if state < 0:
                break
            if self.early[state] and (best is None or self.early[state] < best):
                best = self.early[state]
        if state >= 0 and self.final[state] and (best is None or self.final[state] < best):
            best = self.final[state]
        return None if best is None or best[0] and word in self.lexicon.clean else (best[2], best[0])


class Hits(dict):
    """Run -> hit or None, remembered; bounded by starting anew."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __missing__(self, run: str):
        if len(self) >= MEMO:
            self.clear()
        word = word_of(run)
        self[run] = hit = self.matcher.match(word) if word else None
        return hit


def context(runs: list[str], at: int, others: bool) -> float:
    """Weight of the hit at a place: lower where it is quoted or reported, higher in company."""
    near = runs[max(0, at - WINDOW) : at + WINDOW + 1]
    own = runs[at]
    before = sum(r[:1] in _MARKS for r in runs[max(0, at - WINDOW) : at] if r) > sum(r[-1:] in _MARKS for r in runs[max(0, at - WINDOW) : at] if r)
    after = any(r.rstrip(",.;:!?")[-1:] in _MARKS for r in runs[at + 1 : at + WINDOW + 1] if r.rstrip(",.;:!?"))
    quoted = own[0] in _MARKS and own.rstrip(",.;:!?")[-1:] in _MARKS or (before or own[0] in _MARKS) and (after or own.rstrip(",.;:!?")[-1:] in _MARKS)
    if quoted or any(word_of(r) in CUES for r in near):
        return QUOTED
    return COMPANY if others else 1.0


def evidence(text: bytes | None, hits: Hits) -> tuple[float, int]:
    """Sum of the hits' weights, and their number."""
    lexicon = hits.matcher.lexicon
    runs = runs_of(text)
    found = [(k, h) for k, h in enumerate(map(hits.__getitem__, runs)) if h is not None]
    total = 0.0
    for n, (k, (term, edits)) in enumerate(found):
        company = n > 0 and k - found[n - 1][0] <= WINDOW or n + 1 < len(found) and found[n + 1][0] - k <= WINDOW
        total += lexicon.weight(term, len(runs)) * EDIT**edits * context(runs, k, company)
    return total, len(found)


def score(text: bytes | None, hits: Hits) -> tuple[float, int]:
    """(score, hits) of a text: 0.7 where the sum of hits is the lexicon's least."""
    total, n = evidence(text, hits)
    logit = total - hits.matcher.lexicon.least + math.log(0.7 / 0.3) + 1e-9
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), n


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id's text leaves 1 mod 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _terms(wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in binary(batch.column(0)):
                words = {word_of(r) for r in set(runs_of(text))}
                terms = words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}
                terms = [t for t in terms if t and (wanted is None or t in wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string())], ["term"])
    return run


def _uses(terms: list[str]):
    """(word, term, uses, n): per text its words; per term its exact uses; misspelled words of clean texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(dict.fromkeys(terms, (1.0, 1.0))))
        for batch in batches:
            for text, toxic in zip(binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = Counter(word_of(r) for r in runs_of(text))
                found = {w: m for w in words if w and (m := matcher.match(w))}
                uses = Counter()
                for w, (t, e) in found.items():
                    uses[t] += 0 if e else words[w]
                rows = [("", "", sum(words.values()))] + [("", t, n) for t, n in uses.items()] + [(w, t, 1) for w, (t, e) in found.items() if e and not toxic]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([toxic] * len(rows), pa.int32())], ["word", "term", "uses", "toxic"])
    return run


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(Matcher(lexicon))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence(t, hits)[0] for t in binary(batch.column(0))], pa.float64()), batch.column(1)], ["total", "toxic"])
    return run


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """Terms that toxic texts have significantly more often, none a beginning of another: the strongest
    first, each as the longest form that keeps 98 % of its support, a whole word before a beginning."""
    strength: dict[str, float] = {}
    for t, n in toxic.items():
        c = clean.get(t, 0)
        odds = math.log((n + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        share = (n + c) / (n_toxic + n_clean)
        g2 = 2 * (n * math.log(n / (n_toxic * share)) + (c * math.log(c / (n_clean * share)) if c else 0.0))
        if odds >= MIN_ODDS and g2 >= MIN_G2 and len(t.rstrip("*")) >= 3:
            strength[t] = g2
    below: dict[str, list[str]] = {}
    for t in strength:
        for n in PREFIXES:
            if n <= len(t.rstrip("*")):
                below.setdefault(t[:n], []).append(t)
    chosen, taken = [], set()
    for t in sorted(strength, key=lambda t: (-strength[t], len(t), t)):
        stem = t.rstrip("*")
        if t in taken:
            continue
        same = [x for x in below.get(stem, []) if x not in taken and toxic[x] >= 0.98 * toxic[t]] if t.endswith("*") else []
        best = max([*same, t], key=lambda x: (not x.endswith("*"), len(x), x))
        chosen.append(best)
        taken.update(below.get(stem, []) if t.endswith("*") else [t])
        taken.update(stem[:n] + "*" for n in PREFIXES if n <= len(stem))
    return chosen


def fit_least(rows: list[tuple[float, int]]) -> float:
    """Sum with the fewest errors on (sum, toxic) rows, 0.4 of the way through the best gap; 1 at least."""
    rows = sorted(rows)
    errors = sum(1 - t for _, t in rows)  # all called toxic
    best, least = errors, 0.0
    for k, (total, toxic) in enumerate(rows):
        errors += 1 if toxic else -1
        if errors < best and (k + 1 == len(rows) or rows[k + 1][0] > total):
            best, least = errors, total + 0.4 * (rows[k + 1][0] - total) if k + 1 < len(rows) else total + 1
    return max(1.0, least)


def without_copies(texts: DataFrame) -> DataFrame:
    """``texts`` (text, toxic, doc_id) with one text of each group of near-copies (linked at 0.75) of a class, else a
    copied text's words would look like evidence."""
    # a mark on every word of one class keeps texts of two classes from being linked
    marked = F.when(F.col("toxic") == 1, F.regexp_replace("text", r"[^\x20\x09-\x0D]+", "$0\u0001")).otherwise(F.col("text"))
    kept = near_duplicates(texts.select("doc_id", marked.alias("text"))).filter("kept").select("doc_id")
    return texts.join(kept, "doc_id", "left_semi")


def fewest_uses(n_toxic: int, n_clean: int) -> int:
    """Toxic documents that a term needs for the least G squared if no clean one has it: fewer can't pass."""
    return max(1, math.ceil(MIN_G2 / (2 * math.log((n_toxic + n_clean) / n_toxic)) - 1e-9))


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Lexicon:
    """A lexicon from labelled rows outside ``held_out``; empty if a class has no rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).dropDuplicates(["doc_id"])
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = rows.filter("toxic = 1").orderBy(*order).limit(toxic_docs).unionAll(rows.filter("toxic = 0").orderBy(*order).limit(clean_docs))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a doc_id with several texts is labelled as one document: its first text stands for it
    drawn = settle(keyed.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    texts = settle(without_copies(drawn).select("text", "toxic"), "sample")
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    least = fewest_uses(n_toxic, n_clean)
    terms = texts.filter("toxic = 1").select("text").mapInArrow(_terms(None), "term string").groupBy("term").count()
    toxic = {r["term"]: r["count"] for r in terms.filter(F.col("count") >= least).collect()}  # of the sample: bounded with it
    terms = texts.filter("toxic = 0").select("text").mapInArrow(_terms(frozenset(toxic)), "term string").groupBy("term").count()
    clean = {r["term"]: r["count"] for r in terms.collect()}
    chosen = choose_terms(toxic, clean, n_toxic, n_clean)
    uses, words, lexicon = Counter(), Counter(), Lexicon()
    forms = Counter()
    for r in texts.mapInArrow(_uses(chosen), "word string, term string, uses long, toxic int") \
            .groupBy("word", "term", "toxic").agg(F.sum("uses").alias("uses")).collect():  # of the sample: bounded with it
        if r["word"]:
            lexicon.clean.add(r["word"])
            forms[r["term"]] += 1
        elif r["term"]:
            uses[r["term"], r["toxic"]] = r["uses"]
        else:
            words[r["toxic"]] = r["uses"]
    lexicon.terms = {t: (uses[t, 1] / n_toxic, (uses[t, 0] + 0.5) / (words[0] + 1)) for t in chosen if uses[t, 1]}
    lexicon.exact = {t for t, n in forms.items() if n > 5}  # misspelled, they look like other words
    totals = texts.mapInArrow(_evidence(lexicon), "total double, toxic int").collect()  # a row a sampled text
    lexicon.least = fit_least([tuple(r) for r in totals])
    discard(drawn, texts)
    return lexicon


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(Matcher(lexicon))
        for batch in batches:
            out = [score(t, hits) for t in binary(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s for s, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())],
                                             ["doc_id", "held_out", "score", "n_hits"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row a row of ``docs``: doc_id, held_out, score, predicted (score >= ``threshold``), n_hits.

    Null or empty text has no hits and the lowest score. Null doc_ids are not held out and have no label;
    repeated ones keep a row each. Without training labels of both classes nothing is found. Further
    columns are ignored; an empty table gives an empty result.
    """
    lexicon = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(lexicon), "doc_id long, held_out boolean, score double, n_hits long") \
        .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def _clean(lexicon: Lexicon, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(Matcher(lexicon))
        for batch in batches:
            text = binary(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([score(t, hits)[0] < threshold for t in text], pa.bool_()))
    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs``, all columns, without the rows that ``toxicity`` predicts as toxic.

    Every row is judged by its own text: repeated rows and doc_ids share no fate beyond equal texts, null doc_ids are no
    matter. Null and empty texts stay; without training labels of both classes all rows do; an empty table stays empty.
    """
    return docs.mapInArrow(_clean(learn(docs, labels), threshold), docs.schema)
