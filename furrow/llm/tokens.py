"""Token counts by heap-and-linked-list byte-pair merging, and token ids of the same vocabulary by its library.

Both work through the same observation: the pre-tokeniser drops white space and never joins across it, so a text is
the concatenation of its blank-separated chunks, and each worker keeps what it has found for the chunks seen lately.
The caches are bounded; a chunk that fell out is worked out once more.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from furrow.llm.common import KEY_BYTES, Bounded, load, map_texts

VOCABULARY = "word_bpe_49k.json"
CACHED = 500_000
#: Of id coders, whose misses cost more: about 200 MB.
CACHED_IDS = 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-rank adjacent pair is merged again and again (leftmost on ties).

    The symbols form a doubly linked list; a heap holds (rank, place) of its adjacent pairs, and an entry that a merge
    has overtaken is skipped when popped. No identifiers are made.
    """
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class PairCounter:
    """Counts the tokens of UTF-8 texts under a byte-level pair vocabulary with word ends (a tokenizers JSON file)."""

    #: The file's own pre-tokeniser pattern.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, cached: int = CACHED):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.ranks = {(m[0], m[1]) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(file["model"]["merges"])}
        self.end = file["model"]["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(file["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.mark = b"<|" if all(t["content"].startswith("<|") for t in file["added_tokens"]) else b""
        self.chunks, self.words = Bounded(cached), Bounded(cached)

    def word(self, w: str) -> int:
        n = self.words.get(w)
        if n is None:
            symbols = [self.letters[b] for b in w.encode()]
            symbols[-1] += self.end
            n = merged_length(symbols, self.ranks)
            if len(w) <= KEY_BYTES:
                self.words[w] = n
        return n

    def plain(self, s: str) -> int:
        s = "".join(c.lower() for c in unicodedata.normalize("NFC", s)) if not s.isascii() else s.lower()
        return sum(map(self.word, self.WORDS.findall(s)))

    def chunk(self, raw: bytes) -> int:
        s, n, at = raw.decode("utf-8", "replace"), 0, 0
        if self.mark in raw:
            for m in self.special.finditer(s):
                n += self.plain(s[at : m.start()]) + 1
                at = m.end()
        return n + self.plain(s[at:])

    def __call__(self, text: bytes) -> int:
        c = self.chunks
        c.room()
        self.words.room()
        chunks = text.split()
        got = list(map(c.get, chunks))
        if None in got:
            for i, n in enumerate(got):
                if n is None:
                    w = chunks[i]
                    n = c.get(w)
                    if n is None:
                        n = self.chunk(w)
                        if len(w) <= KEY_BYTES:
                            c[w] = n
                    got[i] = n
        return sum(got)


class IdCoder:
    """Token ids of UTF-8 texts by the tokenizers library, which sees only chunks that the cache lacks.

    A batch of texts is split and its chunks are numbered by Arrow; ids are looked up once for each distinct chunk of the
    batch and laid out for all its texts at once.
    """

    #: One of these after a letter or digit is a token of its own, and letters are put in lower case: such chunks are
    #: put together from the ids of what stands before, which is seen more often.
    TAILS = b".,;:!?"
    PARTING = "<|endoftext|>"

    def __init__(self, path: str, kind: str = "<u4", cached: int = CACHED_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.kind, self.cache = np.dtype(kind), Bounded(cached)
        self.part = self.coder.token_to_id(self.PARTING)
        # of each id, whether its token ends a pre-token: plain words, joined by blanks, are told apart by these
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.coder.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.coder.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.tails = {bytes([t]): b for t, b in zip(self.TAILS, self.ids([chr(t) for t in self.TAILS]), strict=True)} | {b"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, some: list[str], by: str) -> np.ndarray:
        return np.array(self.coder.encode_batch_fast([by.join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)

    def plain(self, some: list[str]) -> list[bytes]:
        """Of words that are letters alone, so one pre-token each, whose last token says so."""
        ids = self.joined(some, " ")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(some):  # the library's letters aren't Python's
            return self.parted(some)
        raw, w = ids.tobytes(), self.kind.itemsize
        ends = (ends * w).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def parted(self, some: list[str]) -> list[bytes]:
        """Of chunks without special strings, joined by one."""
        ids = self.joined(some, self.PARTING)
        cuts = np.append(np.flatnonzero(ids == self.part), len(ids)).tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *[c + 1 for c in cuts]], cuts, strict=False)]

    def learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks that the cache lacks, which take their place in it."""
        c, own, made, letters, others, odd = self.cache, {}, [], {}, {}, []
        for w in chunks:
            if not w:
                own[w] = b""
                continue
            if b"<|" in w:
                odd.append(w)
                continue
            stem, tail = (w[:-1], w[-1:]) if w[-1] in self.TAILS and len(w) > 1 else (w, b"")
            if stem.isalpha():
                low, s = stem.lower(), None
            else:
                s = stem.decode("utf-8", "replace")
                if tail and not s[-1].lower()[-1].isalnum():
                    stem, tail, s = w, b"", w.decode("utf-8", "replace")
                low = stem.lower() if stem.isascii() else stem
            if low != w:
                made.append((w, low, tail))
                if low in own:
                    continue
                v = c.get(low)
                if v is not None:
                    own[low] = v
                    continue
            if s is None or s.isalpha() and s.lower().isalpha():
                letters[low] = low.decode() if s is None else s
            else:
                others[low] = s
        for ask, by in ((letters, self.plain), (others, self.parted)):
            keys, texts = list(ask), list(ask.values())
            for i in range(0, len(keys), 256):
                own.update(zip(keys[i : i + 256], by(texts[i : i + 256]), strict=True))
        own.update(zip(odd, self.ids([w.decode("utf-8", "replace") for w in odd]), strict=True))
        for w, low, tail in made:
            own[w] = own[low] + self.tails[tail]
        c.update([e for e in own.items() if len(e[0]) <= KEY_BYTES])
        return [own[w] for w in chunks]

    def codes(self, chunks: list[bytes]) -> list[bytes]:
        self.cache.room()
        got = list(map(self.cache.get, chunks))
        lack = [i for i, v in enumerate(got) if v is None]
        for i, v in zip(lack, self.learn([chunks[i] for i in lack]), strict=True):
            got[i] = v
        return got

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each begins (the last entry: where all end)."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
        numbered = split.flatten().dictionary_encode()
        which = numbered.indices.to_numpy(zero_copy_only=False)
        codes = self.codes(numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // self.kind.itemsize
        data = np.frombuffer(b"".join(codes), dtype=self.kind)
        n = size[which]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return data[at], np.concatenate([[0], ends])[split.offsets.to_numpy()]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        ids, edge = self.coded(texts)
        raw, edge = ids.tobytes(), (edge * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in itertools.pairwise(edge)]


_KEPT: dict = {}


def kept(kind: type, *args):
    """One of each kind in a worker process, so that its cache serves the tasks that follow."""
    if (kind, args) not in _KEPT:
        _KEPT[kind, args] = kind(*args)
    return _KEPT[kind, args]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row's whole text.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted
    each; special strings inside a text are one token each; an empty table gives an empty result.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        counter = kept(PairCounter, path)
        for texts in batches:
            n = np.fromiter(map(counter, texts), dtype=np.int64, count=len(texts))
            yield [pa.array(list(map(len, texts)), pa.int64()), pa.array(n), pa.array(n > limit)]

    return map_texts(docs, count, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], [doc_id], text)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))
