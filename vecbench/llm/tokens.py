"""Token ids by the library of a vocabulary file, for whole batches of texts.

Every id comes from the library. For vocabularies that drop white space and never join pieces across it
(``_drops_white_space``), a text's ids are those of its white-space-separated runs in order, so each distinct run
is encoded once a Python worker and looked up after that; punctuation at the end of a word of letters is
a piece, and so a run, of its own. Other vocabularies encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

#: Distinct runs that a Python worker remembers before it forgets half of them.
MEMO_RUNS = 1_000_000
#: Letters whose normal form is themselves, and one letter in lower case: a run of them is one piece.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+")
#: Punctuation at the end of a run, behind such a letter: a piece of its own.
_ENDS = re.compile(rb"([.,!?;:#$%&*()](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:#$%&*()]*)(?=[ \t-\r]|\Z)")
#: First bytes of U+0300 to U+037F: every mark that composes with an ASCII letter.
_MARKS = re.compile(rb"[\xcc\xcd]")
_JOIN = 512
#: Bytes of texts that are looked up together.
BLOCK = 1 << 19


def file_digest(path: str) -> str:
    """Version of a vocabulary: CRC-32 and length of its file."""
    with open(path, "rb") as f:
        data = f.read()
    return f"{os.path.basename(path)}:{zlib.crc32(data):08x}:{len(data)}"


def _drops_white_space(path: str) -> bool:
    """Whether the file's pre-tokenizer keeps only matches that hold no white space, and its
    normaliser turns white space into spaces: then runs between white space are encoded alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = next((s for s in steps if s.get("type") == "Split"), {})
    pattern = split.get("pattern", {}).get("Regex", "")
    byte_level = next((s for s in steps if s.get("type") == "ByteLevel"), {})
    return (split.get("behavior") == "Removed" and split.get("invert") is True
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not byte_level.get("add_prefix_space", True)
            and spec.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])))


class _Runs(dict):
    """White-space-free run (bytes) -> number; ``flat[starts[n]:][:lengths[n]]`` are its ids. A run that is asked
    for the first time gets the next number, and its ids with those of all others of the same call."""

    def __init__(self, tokenizer, spec: dict):
        self.tokenizer = tokenizer
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.pending: list[bytes] = []
        vocabulary, suffix = tokenizer.get_vocab(), spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def __missing__(self, run: bytes) -> int:
        n = self[run] = len(self)
        self.pending.append(run)
        return n

    def forget(self) -> None:
        """Keep the half learned first: those are the frequent runs."""
        n = len(self) // 2
        half = list(islice(self.items(), n))
        self.used = int((self.starts[:n] + self.lengths[:n]).max(initial=0))
        self.clear()
        self.update(half)

    def _learn(self) -> None:
        """Encode the pending runs: words of simple letters many at a time, others one by one."""
        first = len(self) - len(self.pending)
        while len(self) >= len(self.lengths):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        texts = [r.decode("utf-8", "replace") for r in self.pending]
        simple = [k for k, t in enumerate(texts) if _LETTERS.fullmatch(t)]
        others = sorted(set(range(len(texts))) - set(simple))
        for k in range(0, len(simple), _JOIN):
            some = simple[k : k + _JOIN]
            joined = " ".join([texts[j] for j in some])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            edges = np.append(0, np.flatnonzero(self.last[ids]) + 1)
            if len(edges) != len(some) + 1 or edges[-1] != len(ids):  # the last id of a word doesn't show
                words = np.array(self.tokenizer.encode(joined, add_special_tokens=False).word_ids, np.int64)
                edges = np.searchsorted(words, np.arange(len(some) + 1))
            self._add(first + np.array(some), ids, np.diff(edges))
        for k in range(0, len(others), _JOIN):
            some = others[k : k + _JOIN]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([texts[j] for j in some], add_special_tokens=False)]
            self._add(first + np.array(some), np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids]))

    def _add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def numbers(self, runs: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_RUNS:
            self.forget()
        out = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        if self.pending:
            try:
                self._learn()
            except BaseException:  # a worker is reused: it must not remember runs without ids
                for run in self.pending:
                    del self[run]
                raise
            finally:
                self.pending = []
        return out


class Encoder:
    """Ids of texts by ``tokenizers`` (.json) or ``sentencepiece`` (.model), nothing added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.runs = None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor
            self.pieces = SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            if _drops_white_space(path):
                with open(path, encoding="utf-8") as f:
                    self.runs = _Runs(self.tokenizer, json.load(f))

    def _split(self, text: bytes) -> list[bytes]:
        # a special string is matched before lower-casing, so such texts keep their capitals
        if b"<|" in text:
            return _ENDS.sub(rb" \1", text).split()
        if not _MARKS.search(text):
            return _ENDS.sub(rb" \1", text.lower()).split()
        # the library composes before it lower-cases, and some marks compose with the small letter only (h and U+0331)
        return [r if _MARKS.search(r) else r.lower() for r in _ENDS.sub(rb" \1", text).split()]

    def _whole(self, text: bytes) -> list[int]:
        text = text.decode("utf-8", "replace")
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if hasattr(self, "tokenizer") else self.pieces.encode(text)

    def _blocks(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts a few at a time (BLOCK bytes or one text): their run numbers and runs a text."""
        runs, counts, size = [], [], 0
        for text in texts:
            own = self._split(text) if text else []
            runs += own
            counts.append(len(own))
            size += len(text or b"")
            if size >= BLOCK:
                yield self.runs.numbers(runs), np.array(counts)
                runs, counts, size = [], [], 0
        if counts:
            yield self.runs.numbers(runs), np.array(counts)

    def many(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, as unsigned 32-bit numbers; null is empty."""
        if self.runs is None:
            for text in texts:
                yield np.array(self._whole(text) if text else [], np.uint32)
            return
        for k, counts in self._blocks(texts):
            lengths = self.runs.lengths[k]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(k) else 0
            flat = self.runs.flat[np.arange(total) + np.repeat(self.runs.starts[k] - (ends - lengths), lengths)]
            edges = np.append(0, ends)[np.append(0, np.cumsum(counts))]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield flat[a:b]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """Number of ids of each text."""
        if self.runs is None:
            return [len(x) for x in self.many(texts)]
        out = []
        for k, counts in self._blocks(texts):
            sums = np.append(0, np.cumsum(self.runs.lengths[k]))
            out += np.diff(sums[np.append(0, np.cumsum(counts))]).tolist()
        return out

    def ids(self, text: bytes | None) -> np.ndarray:
        return next(self.many([text]))

    def count(self, text: bytes | None) -> int:
        return self.counts([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; workers are reused, so what it remembers serves later tasks."""
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
