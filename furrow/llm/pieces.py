"""N-best SentencePiece segmentations, and decoding.

The pieces of a model file and their scores span a lattice over a text: a piece is an edge from the place where it
begins to the place where it ends, and the score of a segmentation is the sum of its pieces' scores. A forward Viterbi
pass gives the best score up to each place; a backward A* search from the end takes these as its heuristic, which is
exact, so it pops whole segmentations best first.

No piece of the vocabulary reaches over the start of a word, so a text's lattice falls apart into its words, whose
best segmentations each worker keeps for words seen lately. The best N of the whole text are then combinations
of few words' second and later choices: only the N - 1 words whose second choice costs least can matter, and a heap
over these gives the combinations in order.

Characters that no piece covers become byte pieces at a score below every piece's. Spaces become U+2581, one is put
before the text, and decoding undoes both, so that decode(encode(x)) = x for texts without that mark.

Defined cases: a null text counts as empty and has no pieces and one empty segmentation of score 0; of equal scores fewer
pieces come first, and of equal numbers an order that depends on the text alone, so the first N are the same whatever N;
repeated rows are segmented each; a null id stays null; an empty table gives an empty result; other columns are not looked
at. A U+2581 of a text is read as a space, as the mark means one, so such a text doesn't come back: round_trip is false.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from furrow.llm.common import KEY_BYTES, Bounded, load, map_texts
from furrow.llm.tokens import kept, vocabulary_path

MODEL = "piece_bpe_32k.model"
BEST = 3
MARK = "▁"
_NEVER = float("inf")
#: What a piece costs besides its score, so that of equal scores fewer pieces win: less than any difference of scores, which
#: are whole numbers, for words of up to a million pieces.
TIE = 2.0**-20


class Lattice:
    """The pieces of a model file."""

    def __init__(self, path: str, best: int = BEST, cached: int = 800_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.best = best
        self.text = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in usual}
        # runs of marks carry no score of their own in such files: they stand just under the scored pieces
        scored = [s for s in scores.values() if s > -1e8]
        low = min(scored, default=0.0) - 1.0
        self.ids = {self.text[i]: i for i in usual}
        self.score = {self.text[i]: (s if s > -1e8 else low) for i, s in scores.items()}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.values = {i: v for v, i in self.bytes.items()}
        self.off_score = low - 10.0
        # a tree of characters; the cost of a piece is under the empty string at its last character
        self.root: dict = {}
        for p, score in self.score.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = TIE - score
        self.code = {p: i.to_bytes(2, "little") for p, i in self.ids.items()}
        lone = [c for c in "\n\r\t" if not any(c in p for p in self.score)]
        # no piece holds these characters, so they part words as well
        self.parts = re.compile(f"[{''.join(lone)}]|{MARK}+[^{MARK}{''.join(lone)}]*|[^{MARK}{''.join(lone)}]+")
        self.cache = Bounded(cached)
        self.chosen = Bounded(cached // 10)

    def edges(self, w: str) -> list[list[tuple[int, float]]]:
        """For each place, (where it begins, cost) of the pieces that end there; a character without a piece of its
        own is one edge of byte pieces. A start is followed down the tree of pieces, no further than one can go."""
        n = len(w)
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            node = self.root
            for j in range(i, n):
                node = node.get(w[j])
                if node is None:
                    break
                s = node.get("")
                if s is not None:
                    out[j + 1].append((i, s))
            if not out[i + 1] or out[i + 1][-1][0] != i:
                out[i + 1].append((i, (TIE - self.off_score) * len(w[i].encode("utf-8", "surrogatepass"))))
        return out

    def nbest(self, w: str, best: int) -> list[tuple[float, list[int]]]:
        """(cost, places of the piece ends) of the best segmentations of a word, best first; a cost is minus the score,
        and TIE for each piece."""
        edges, n = self.edges(w), len(w)
        ahead = [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = min([ahead[i] + s for i, s in edges[j]])
        # cost so far backwards + least cost ahead, running number, place, cost so far, (place, what follows).
        # The heuristic is exact, so each entry stands for at least one whole segmentation of just that cost, and no
        # more entries than segmentations still wanted need to be kept.
        # Of equal costs the newest comes first: a path that is as good as others is followed to its end before them, so
        # the order of segmentations doesn't depend on how many are wanted.
        queue = [(ahead[n], 0, n, 0.0, None)]
        number = 0
        out: list[tuple[float, list[int]]] = []
        while queue:
            f, _, j, g, path = queue.pop(0)
            if not j:
                ends = []
                while path is not None:
                    ends.append(path[0])
                    path = path[1]
                out.append((f, ends))
                if len(out) == best:
                    break
                continue
            path, want = (j, path), best - len(out)
            for i, s in edges[j]:
                h = g + s
                f = h + ahead[i]
                if len(queue) < want or f <= queue[-1][0]:
                    number -= 1
                    insort(queue, (f, number, i, h, path))
                    if len(queue) > want:
                        queue.pop()
        return out

    def code_of(self, w: str, ends: list[int]) -> bytes:
        """Ids (little-endian, two bytes each) of a segmentation of a word."""
        at, own, code = 0, [], self.code.get
        for j in ends:
            p = w[at:j]
            own.append(code(p) or b"".join(self.bytes[b].to_bytes(2, "little") for b in p.encode("utf-8", "surrogatepass")))
            at = j
        return b"".join(own)

    def two_best(self, w: str) -> tuple[float, float, list[int]]:
        """Costs of the best and of the second segmentation of a word, and the places of the best one's piece ends: what
        nbest() finds (of equal costs the piece that begins last), in one pass that makes no lists of edges."""
        n, root = len(w), self.root
        cost, second, back = [_NEVER] * (n + 1), [_NEVER] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            node, here, next_, lone = root, cost[i], second[i], True
            for j in range(i, n):
                node = node.get(w[j])
                if node is None:
                    break
                s = node.get("")
                if s is not None:
                    if j == i:
                        lone = False
                    j += 1
                    f, least = here + s, cost[j]
                    if f <= least:
                        other = next_ + s
                        second[j] = other if other < least else least
                        cost[j], back[j] = f, i
                    elif f < second[j]:
                        second[j] = f
            if lone:
                s = (TIE - self.off_score) * len(w[i].encode("utf-8", "surrogatepass"))
                f, least = here + s, cost[i + 1]
                if f <= least:
                    second[i + 1] = min(least, next_ + s)
                    cost[i + 1], back[i + 1] = f, i
                elif f < second[i + 1]:
                    second[i + 1] = f
        ends = [n] if n else []
        while ends and back[ends[-1]]:
            ends.append(back[ends[-1]])
        ends.reverse()
        return cost[n], second[n], ends

    def word(self, w: str) -> tuple[float, float, bytes, str]:
        """Best score, what the second choice costs, ids of the best, and the word itself."""
        cost, second, ends = self.two_best(w)
        code = self.code_of(w, ends)
        return TIE * (len(code) // 2) - cost, second - cost if self.best > 1 else _NEVER, code, w

    def words(self, raw: bytes) -> list[tuple]:
        c = self.cache
        c.room()
        if not raw:
            return []
        ws = self.parts.findall((b" " + raw).decode("utf-8", "replace").replace(" ", MARK))
        got = list(map(c.get, ws))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    w = ws[i]
                    v = c.get(w)
                    if v is None:
                        v = self.word(w)
                        if len(w) <= KEY_BYTES:
                            c[w] = v
                    got[i] = v
        return got

    def choices(self, w: str) -> list[tuple[float, bytes]]:
        """(what it costs against the best, ids) of the best segmentations of a word, kept for words asked for lately."""
        out = self.chosen.get(w)
        if out is None:
            found = self.nbest(w, self.best)
            out = [(cost - found[0][0], self.code_of(w, ends)) for cost, ends in found]
            self.chosen.room()
            if len(w) <= KEY_BYTES:
                self.chosen[w] = out
        return out

    def segmentations(self, raw: bytes) -> list[tuple[float, bytes]]:
        """(score, ids) of a text's best segmentations, best first."""
        words = self.words(raw)
        top = sum(map(itemgetter(0), words))
        ids = list(map(itemgetter(2), words))
        out = [(top, b"".join(ids))]
        # the words whose second choice costs least; the first best-1 of them suffice, and only they are looked at again
        costs = list(map(itemgetter(1), words))
        places: list[int] = []
        while costs and len(places) < self.best - 1 and (least := min(costs)) < _NEVER:
            places.append(costs.index(least))
            costs[places[-1]] = _NEVER
        choices = [self.choices(words[i][3]) for i in places]
        more = [[c for c, _ in found] for found in choices]
        start = (0,) * len(places)
        # of equal costs, later choices of earlier words come first, whatever words stand behind them
        heap, seen = [(0.0, start)], {start}
        while heap and len(out) < self.best:
            cost, choice = heapq.heappop(heap)
            choice = tuple(-j for j in choice)
            if choice != start:
                own = list(ids)
                for i, c, j in zip(places, choices, choice, strict=True):
                    own[i] = c[j][1]
                code = b"".join(own)
                out.append((top - cost + TIE * ((len(code) - len(out[0][1])) // 2), code))
            for k, j in enumerate(choice):
                if j + 1 < len(more[k]):
                    nxt = choice[:k] + (j + 1,) + choice[k + 1 :]
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(m[x] for m, x in zip(more, nxt, strict=True)), tuple(-j for j in nxt)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of a segmentation."""
        if not ids:
            return b""
        out = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return out.replace(MARK.encode(), b" ")[1:]

    @property
    def spelled(self) -> list[bytes]:
        """What each piece stands for: its text with blanks for marks, or its byte."""
        if not hasattr(self, "_spelled"):
            texts = [t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in self.text]
            self._spelled = [bytes((self.values[i],)) if i in self.values else t for i, t in enumerate(texts)]
        return self._spelled


def encode(docs: DataFrame, path: str | None = None, best: int = BEST, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, score and ids_crc32 of the best segmentation, round_trip (whether it decodes to the text); of
    each of the best N, best first: scores, all_n_pieces, all_ids_crc32 and all_round_trip; and, if asked for, ids: their
    piece ids (little-endian, two bytes each)."""
    path = path or vocabulary_path(MODEL)

    def run(batches: Iterator[list[bytes]]) -> Iterator[list[pa.Array]]:
        lattice = kept(Lattice, path, best)
        for texts in batches:
            found = [lattice.segmentations(t) for t in texts]
            n = [[len(b) // 2 for _, b in f] for f in found]
            crc = [[zlib.crc32(b) for _, b in f] for f in found]
            same = [[lattice.decode(b) == t for _, b in f] for f, t in zip(found, texts, strict=True)]
            scores = [[s for s, _ in f] for f in found]
            new = [pa.array([x[0] for x in v], k) for v, k in ((n, pa.int64()), (scores, pa.float64()), (crc, pa.int64()), (same, pa.bool_()))]
            new += [pa.array(v, pa.list_(k)) for v, k in ((scores, pa.float64()), (n, pa.int64()), (crc, pa.int64()), (same, pa.bool_()))]
            yield new + ([pa.array([[b for _, b in f] for f in found], pa.list_(pa.binary()))] if keep_ids else [])

    fields = [("n_pieces", "bigint"), ("score", "double"), ("ids_crc32", "bigint"), ("round_trip", "boolean"), ("scores", "array<double>")]
    fields += [("all_n_pieces", "array<bigint>"), ("all_ids_crc32", "array<bigint>"), ("all_round_trip", "array<boolean>")]
    return map_texts(docs, run, fields + ([("ids", "array<binary>")] if keep_ids else []), [doc_id], text)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """rows (doc_id, ids: array of segmentations) with the text that the first segmentation decodes to."""
    path = path or vocabulary_path(MODEL)
    first = rows.selectExpr("doc_id", f"`{ids}`[0] AS first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = kept(Lattice, path, BEST)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lattice.decode(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return first.mapInArrow(run, f"doc_id {first.schema['doc_id'].dataType.simpleString()}, text string")


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), keep_ids=False)
