"""Byte-level BPE: pre-tokens and pair counts as plans, training on the histogram of different pre-tokens, encoding of different pre-tokens.

The corpus is only ever touched by the histogram (partial aggregation before its one shuffle) and by the final join. Training goes over the table of different
pre-tokens in rounds that find many merges each (merge_rounds); encoding costs n log n for a pre-token of n bytes (merge_by_rank).
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound
from . import arrow
from .pack import prefix_sum
from .storage import stored

#: Fixed value: the pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Pair = tuple[int, int]


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)({PATTERN})"))


def histogram(docs: DataFrame) -> DataFrame:
    """(chunk, freq) of the different pre-tokens."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("freq"))


def bytes_of(chunk: Column) -> Column:
    """The UTF-8 bytes of a string as an array of ints."""
    raw = F.encode(chunk, "utf-8")
    return bound(raw, lambda r: F.transform(F.sequence(F.lit(1), F.octet_length(r)), lambda i: F.conv(F.hex(F.substring(r, i, F.lit(1))), 16, 10).cast("int")))


def pair_counts(hist: DataFrame) -> DataFrame:
    """(a, b, cnt): adjacent bytes of the histogram's pre-tokens, each pair by its pre-token's frequency; overlapping pairs all count."""
    ids = hist.filter(F.octet_length("chunk") > 1).select("freq", bytes_of(F.col("chunk")).alias("ids"))
    return id_pair_counts(ids)


def id_pair_counts(ids: DataFrame) -> DataFrame:
    """(a, b, cnt) of (freq, ids)."""
    n = F.size("ids") - 1
    pairs = ids.select("freq", F.inline(F.arrays_zip(F.slice("ids", 1, n).alias("a"), F.slice("ids", F.lit(2), n).alias("b"))))
    return pairs.groupBy("a", "b").agg(F.sum("freq").alias("cnt"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair, ties to the lowest: an aggregation, not a sort."""
    return counts.agg(F.max(F.struct("cnt", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("m")).select((-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), F.col("m.cnt").alias("cnt"))


def merged(ids: tuple[int, ...], pair: Pair, new: int) -> tuple[int, ...]:
    """ids with each non-overlapping occurrence of pair, from the left, replaced by new."""
    out: list[int] = []
    skip = False
    for i, x in enumerate(ids):
        if skip:
            skip = False
        elif x == pair[0] and i + 1 < len(ids) and ids[i + 1] == pair[1]:
            out.append(new)
            skip = True
        else:
            out.append(x)
    return tuple(out)


def train_naive(hist: dict[str, int], vocab: int) -> list[Pair]:
    """Merges by counting every pair anew each time: the definition, for tests and tiny vocabularies."""
    words = Counter()
    for chunk, n in hist.items():
        words[tuple(chunk.encode())] += n
    merges: list[Pair] = []
    for new in range(256, vocab):
        pairs: Counter = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] += n
        if not pairs:
            break
        merges.append(min(pairs, key=lambda p: (-pairs[p], p)))
        again: Counter = Counter()
        for w, n in words.items():
            again[merged(w, merges[-1], new)] += n
        words = again
    return merges


def merge_by_rank(ids: list[int], rank: dict[Pair, int]) -> list[int]:
    """ids with the merges of rank (pair to new id, later merges with higher ids) done in order, each from the left.

    The ids are a chain, and a heap has the mergeable pairs by (rank, place): n ids cost n log n, however many merges there are.
    """
    n, ids = len(ids), list(ids)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        new, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or rank.get((ids[i], ids[j])) != new:  # one of the two has been merged since
            continue
        ids[i], ids[j] = new, -1  # -1 is in no pair
        k, h = after[j], before[i]
        after[i], after[j] = k, -1
        if k >= 0:
            before[k] = i
            if (r := rank.get((new, ids[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if h >= 0 and (r := rank.get((ids[h], new))) is not None:
            heapq.heappush(heap, (r, h))
    return [x for x in ids if x >= 0]


class Symbols:
    """The ids of many weighted words, each word a chain, and the places of each pair: a merge costs as much as it changes."""

    def __init__(self, words: Iterable[tuple[int, list[int]]]):
        self.id: list[int] = []
        self.weight: list[int] = []
        self.after: list[int] = []
        self.before: list[int] = []
        self.total: dict[Pair, int] = defaultdict(int)
        self.places: dict[Pair, set[int]] = defaultdict(set)
        for freq, ids in words:
            first, n = len(self.id), len(ids)
            self.id += ids
            self.weight += [freq] * n
            self.after += [*range(first + 1, first + n), -1][:n]
            self.before += [-1, *range(first, first + n - 1)][:n]
        for i, j in enumerate(self.after):
            if j >= 0:
                self._set(i, j, 1, self.total)

    def _set(self, i: int, j: int, sign: int, change: dict[Pair, int]) -> None:
        pair = self.id[i], self.id[j]
        change[pair] += sign * self.weight[i]
        (self.places[pair].add if sign > 0 else self.places[pair].discard)(i)

    def merge(self, pair: Pair, new: int) -> dict[Pair, int]:
        """Merges a pair wherever it stands, and returns how the pairs' totals change."""
        change: dict[Pair, int] = defaultdict(int)
        for i in sorted(self.places.get(pair, ())):
            j = self.after[i]
            if j < 0 or (self.id[i], self.id[j]) != pair:  # the place before it took this one
                continue
            h, k = self.before[i], self.after[j]
            for x, y in ((h, i), (i, j), (j, k)):
                if x >= 0 <= y:
                    self._set(x, y, -1, change)
            self.id[i], self.id[j], self.after[i], self.after[j] = new, -1, k, -1
            if k >= 0:
                self.before[k] = i
            for x, y in ((h, i), (i, k)):
                if x >= 0 <= y:
                    self._set(x, y, 1, change)
        self.places.pop(pair, None)
        for p, n in change.items():
            self.total[p] += n
            if not self.total[p]:
                del self.total[p]
        return {p: n for p, n in change.items() if n}

    def best(self) -> Pair | None:
        """The most frequent pair, ties to the lowest."""
        return max(self.total, key=lambda p: (self.total[p], -p[0], -p[1]), default=None)


@dataclass
class Tokenizer:
    """Merges in order (ids from 256), and special strings with ids above them."""

    merges: list[Pair]
    specials: dict[str, int] = field(default_factory=dict)
    END = "<|endoftext|>"

    def __post_init__(self) -> None:
        self.rank = {tuple(p): 256 + i for i, p in enumerate(self.merges)}
        self.bytes = {i: bytes([i]) for i in range(256)}
        for (a, b), i in self.rank.items():
            self.bytes[i] = self.bytes[a] + self.bytes[b]

    def register(self, name: str) -> int:
        """The special's id; the first call gives it the next one."""
        return self.specials.setdefault(name, 256 + len(self.merges) + len(self.specials))

    @property
    def end_id(self) -> int:
        return self.register(self.END)

    @property
    def vocab_size(self) -> int:
        return 256 + len(self.merges) + len(self.specials)

    def encode_chunk(self, chunk: str) -> list[int]:
        return merge_by_rank(list(chunk.encode()), self.rank) if self.rank else list(chunk.encode())

    def token_bytes(self, i: int) -> bytes:
        if i in self.bytes:
            return self.bytes[i]
        return next(name for name, k in self.specials.items() if k == i).encode()

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens one after another, and by id where a token's begin and how many they are; -1 for an id that is none."""
        known = sorted([*self.bytes, *self.specials.values()])
        raw, length = [self.token_bytes(i) for i in known], np.full(known[-1] + 1, -1, np.int64)
        length[known] = [len(x) for x in raw]
        first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        return np.frombuffer(b"".join(raw), np.uint8), first, length

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes, ids)).decode("utf-8", errors="replace")

    def dumps(self) -> str:
        return json.dumps({"merges": [[a, b, 256 + i] for i, (a, b) in enumerate(self.merges)], "special_tokens": self.specials})

    @classmethod
    def loads(cls, raw: str) -> Tokenizer:
        """Reads an object with merges and special tokens, or an older bare list of merges."""
        own = json.loads(raw)
        triples = own["merges"] if isinstance(own, dict) else own
        return cls([(a, b) for a, b, _ in sorted(triples, key=lambda t: t[2])], dict(own.get("special_tokens", {})) if isinstance(own, dict) else {})


def _keys(pairs: Iterable[Pair]) -> np.ndarray:
    return np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))


#: Between words that stand one after another.
_GAP = -1


def _laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words of (freq, ids) one after another with a gap after each, and the frequency at each place."""
    ids, at = arrow.values(batch.column(1))
    x = np.full(len(ids) + len(batch), _GAP, np.int32)
    own = np.ones(len(x), bool)
    own[at[1:] + np.arange(len(batch))] = False
    x[own] = ids
    return x, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(at) + 1)


def _merge_all(x: np.ndarray, w: np.ndarray, pair: Pair, new: int, change: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words as _laid_out() with a pair merged from the left wherever it stands. change gets (pairs as a << 32 | b, how their totals change)."""
    hit = np.flatnonzero((x[:-1] == pair[0]) & (x[1:] == pair[1]))
    if not len(hit):
        return x, w
    if pair[0] == pair[1]:  # of a run of places that overlap, every second one
        first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
    left = np.ones(len(x), bool)
    left[hit + 1] = False
    y, v = x[left], w[left]
    to = hit - np.arange(len(hit))
    y[to] = new
    if change is not None:
        for ids, freq, places, sign in ((x, w, (hit - 1, hit, hit + 1), -1), (y, v, (to - 1, to), 1)):
            i = np.unique(np.concatenate(places))
            i = i[(i >= 0) & (i < len(ids) - 1)]
            i = i[(ids[i] != _GAP) & (ids[i + 1] != _GAP)]
            change.append((ids[i].astype(np.int64) << 32 | ids[i + 1], sign * freq[i]))
    return y, v


def _summed(rows: list[np.ndarray]) -> list[np.ndarray]:
    """[t, pair, d] with the changes of each turn and pair added up."""
    t, pair, d = rows
    order = np.lexsort((pair, t))
    t, pair, d = t[order], pair[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (pair[1:] != pair[:-1])])) if len(t) else np.zeros(0, np.int64)
    d = np.add.reduceat(d, first) if len(t) else d
    return [c[d != 0] for c in (t[first], pair[first], d)]


def _guess(frequent: DataFrame, counts: DataFrame, merges: list[Pair], first: Pair, n: int, pairs: int = 20_000) -> list[Pair]:
    """first, and the merges that would follow it if each pair stood in all words among the same neighbours as in the frequent ones.

    The most frequent pairs start from their totals over all words; what a merge does to its neighbours is scaled by how often the frequent words
    have the pair. One task does it, over a bounded number of words and pairs; the driver gets n pairs.
    """

    def run(batches):
        laid, total = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], {}
        for b in batches:
            top = b.filter(b.column(0))
            total |= {tuple(ids): float(f) for f, ids in zip(top.column(1).to_pylist(), top.column(2).to_pylist(), strict=True)}
            laid.append(_laid_out(b.filter(pc.invert(b.column(0))).select([1, 2])))
        x, w = (np.concatenate(c) for c in zip(*laid, strict=True))
        for i, p in enumerate(merges):
            x, w = _merge_all(x, w, p, 256 + i)
        out, pair = [], first
        best = [(-c, p) for p, c in total.items()]
        heapq.heapify(best)
        while len(out) < n:
            seen = int(w[:-1][(x[:-1] == pair[0]) & (x[1:] == pair[1])].sum())
            scale = total.pop(pair, float(seen)) / max(seen, 1)
            change: list = []
            x, w = _merge_all(x, w, pair, 256 + len(merges) + len(out), change)
            if change:
                _, keys, d = _summed([np.zeros(sum(len(p) for p, _ in change), np.int32), *(np.concatenate(c) for c in zip(*change, strict=True))])
                for k, d_ in zip(keys.tolist(), d.tolist(), strict=True):
                    p = k >> 32, k & 0xFFFFFFFF
                    if p != pair and (p in total or d_ > 0):
                        total[p] = total.get(p, 0.0) + d_ * scale
                        heapq.heappush(best, (-total[p], p))
            out.append((len(out), *pair))
            while best and total.get(best[0][1]) != -best[0][0]:
                heapq.heappop(best)
            if not best or best[0][0] >= 0:
                break
            pair = heapq.heappop(best)[1]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out, strict=True)], ["t", "a", "b"])

    top = counts.orderBy(F.col("cnt").desc(), "a", "b").limit(pairs)
    both = frequent.select(F.lit(False).alias("pair"), "freq", "ids").unionByName(top.select(F.lit(True).alias("pair"), F.col("cnt").alias("freq"), F.array("a", "b").alias("ids")))
    return [(r.a, r.b) for r in sorted(both.coalesce(1).mapInArrow(run, "t int, a int, b int").collect())]


def _changes(words: DataFrame, merges: list[Pair], guess: list[Pair], done: int = 0, memory: int = 300_000) -> DataFrame:
    """(t, a, b, d): how each guessed merge would change each pair's total, after the merges and the guesses before it. The words of a batch are
    one array, in which a merge is a few NumPy passes. done: the merges that the words have had."""

    def run(batches):
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array((held[1] >> 32).astype(np.int32)), pa.array((held[1] & 0xFFFFFFFF).astype(np.int32)), pa.array(held[2])], ["t", "a", "b", "d"])

        for batch in arrow.parts(batches, 1, 1 << 18):
            x, w = _laid_out(batch)
            for i, pair in enumerate(merges[done:], done):
                x, w = _merge_all(x, w, pair, 256 + i)
            out = [held]
            for t, pair in enumerate(guess):
                change: list = []
                x, w = _merge_all(x, w, pair, 256 + len(merges) + t, change)
                out += [[np.full(len(p), t, np.int32), p, d] for p, d in change]
            held = _summed([np.concatenate(c) for c in zip(*out, strict=True)])
            if len(held[0]) > memory:
                yield rows()
                held = [c[:0] for c in held]
        yield rows()

    parts = words.mapInArrow(run, "t int, a int, b int, d long")
    return parts.groupBy("t", "a", "b").agg(F.sum("d").alias("d")).filter("d <> 0")


def _merged_words(words: DataFrame, merges: list[Pair], done: int = 0) -> DataFrame:
    """(freq, ids) with the merges after the first done ones; words of one id go."""

    def run(batches):
        for batch in arrow.parts(batches, 1, 1 << 18):
            x, w = _laid_out(batch)
            for i, pair in enumerate(merges[done:], done):
                x, w = _merge_all(x, w, pair, 256 + i)
            end = np.flatnonzero(x == _GAP)
            yield pa.RecordBatch.from_arrays([batch.column(0), arrow.lists(x[x != _GAP], np.append(0, end - np.arange(len(end))))], ["freq", "ids"])

    return words.mapInArrow(run, "freq long, ids array<int>").filter(F.size("ids") > 1)


def _right(counts: DataFrame, changes: DataFrame, guess: list[Pair]) -> int:
    """How many of the guessed merges are the best pair each at its turn, over all words.

    A pair's total is a step function of the merges done. The driver gets the totals of the guessed pairs at their turns; a row of any other step
    then says by itself the first turn at which its pair would have been better.
    """
    n, w = len(guess), Window.partitionBy("a", "b").orderBy("t")
    steps = counts.select(F.lit(-1).alias("t"), "a", "b", F.col("cnt").alias("d")).unionByName(changes)
    held = steps.select("a", "b", (F.col("t") + 1).alias("first"), F.coalesce(F.lead("t").over(w) + 1, F.lit(n)).alias("end"), F.sum("d").over(w).alias("cnt"))
    held = stored(held.filter("cnt > 0 and first < end"), "steps")
    turn = {p: t for t, p in enumerate(guess)}
    own = held.join(F.broadcast(counts.sparkSession.createDataFrame([(t, *p) for p, t in turn.items()], "t int, a int, b int")), ["a", "b"]).filter("first <= t and t < end")
    total = {r.t: r.cnt for r in own.select("t", "cnt").collect()}
    n = next((t for t, p in enumerate(guess) if t not in total or turn[p] != t), n)  # a guess that stands nowhere
    at, a, b = (F.lit(list(x)) for x in ([total[t] for t in range(n)], *zip(*guess[:n], strict=True)))

    def better(t: Column) -> Column:
        lower = (F.col("a") < F.get(a, t)) | ((F.col("a") == F.get(a, t)) & (F.col("b") < F.get(b, t)))
        return (F.col("cnt") > F.get(at, t)) | ((F.col("cnt") == F.get(at, t)) & lower)

    able = held.filter((F.col("cnt") >= min(total[t] for t in range(n))) & (F.col("first") < n))
    wrong = able.select(F.array_min(F.filter(F.sequence("first", F.least(F.col("end"), F.lit(n)) - 1), better)).alias("t")).agg(F.min("t")).first()[0]
    return n if wrong is None else wrong


def merge_rounds(hist: DataFrame, vocab: int, frequent: int = 200_000, ahead: int = 64, most: int = 1024, again: int = 96) -> Iterator[list[Pair]]:
    """The merges of a table (chunk, freq) of any size, in order, some of them a round.

    Each round guesses the next merges from the most frequent words, counts in one pass over all words how they would change the pairs' totals, and keeps the
    guesses up to the first that another pair beats. So the merges are those of all words; the guess decides only how many a round finds. Its
    first one is the best pair of the table of totals, so no round finds none. The totals are a table that the accepted changes are added to; the words are
    written anew after ``again`` merges (``most`` if that is less), and taken as merged till then. Neither comes to the driver, which gets the guessed pairs and their totals.

    frequent: words that guesses are made from (of 256 bytes at most); ahead: the first number of guesses, which doubles as long as they are right.
    """
    words = stored(hist.filter(F.octet_length("chunk") > 1).select("freq", bytes_of(F.col("chunk")).alias("ids")), "words")
    usual = stored(words.filter(F.size("ids") <= 256).orderBy(F.col("freq").desc(), "ids").limit(frequent), "frequent")
    counts = stored(id_pair_counts(words), "pairs")
    merges: list[Pair] = []
    written = 0
    while (left := vocab - 256 - len(merges)) > 0:
        best = best_pair(counts).first()
        if best.cnt is None:
            return
        guess = _guess(usual, counts, merges, (best.a, best.b), min(ahead, left))
        changes = stored(_changes(words, merges, guess, written), "changes")
        n = _right(counts, changes, guess)
        merges += guess[:n]
        yield guess[:n]
        if n == left:
            return
        done = changes.filter(F.col("t") < n).select("a", "b", F.col("d").alias("cnt"))
        counts = stored(counts.select("a", "b", "cnt").unionByName(done).groupBy("a", "b").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0"), "pairs")
        if len(merges) - written >= min(most, again):
            words, written = stored(_merged_words(words, merges, written), "words"), len(merges)
        ahead = min(most, max(16, 2 * n))


def train(docs: DataFrame, vocab: int, frequent: int = 200_000) -> Tokenizer:
    """Counts pre-tokens in Spark, and merges over their table. No pre-token is left out, and the plan is the same at every size."""
    hist = stored(histogram(docs), "pretokens")
    return Tokenizer([p for some in merge_rounds(hist, vocab, frequent) for p in some])


#: Texts that a trained tokenizer must give back as they were.
PROBES = ("Plain words, and a full stop.", "if (x > 0) { return x * 2; }  // twice\n\tfor k in range(9): pass", "na\u00efve caf\u00e9, \u4e2d\u6587\u5b57, \u03b1\u03b2\u03b3, \U0001f642", "  spaces \r\n and 12345 digits\u3000")


def report(docs: DataFrame, tok: Tokenizer, order: str = "doc_id", chars: int = 2_000_000) -> DataFrame:
    """One row: the first chars characters of the corpus in order, their tokens, characters for each token, and the probes that come back unchanged."""
    sized = prefix_sum(docs.select(order, "text"), F.length("text"), order, "_before").filter(F.col("_before") < chars)
    sample = sized.select(order, F.substring("text", F.lit(1), (F.lit(chars) - F.col("_before")).cast("int")).alias("text"))
    n = encode_documents(sample, tok, order).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("tokens"))
    total = sample.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    came = sum(tok.decode([i for c in regex.findall(PATTERN, p) for i in tok.encode_chunk(c)]) == p for p in PROBES)
    return total.join(n).select("chars", "tokens", F.round(F.col("chars") / F.greatest("tokens", F.lit(1)), 3).alias("chars_per_token"), F.lit(came).alias("probes_back"), F.lit(tok.vocab_size).alias("vocab_size"))


def merge_pair(ids: Column, pair: Pair, new: int) -> Column:
    """ids with each non-overlapping occurrence of pair, from the left, replaced by new, as an expression."""
    step = lambda acc, x: F.when((x == pair[1]) & (F.get(acc, F.size(acc) - 1) == pair[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(ids, F.array().cast("array<int>"), step)


def pairs_of(ids: Column) -> Column:
    """The different adjacent pairs of an array."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.array_distinct(F.arrays_zip(F.slice(ids, 1, n).alias("a"), F.slice(ids, 2, n).alias("b")))


def lost_pairs(ids: Column, pair: Pair, new: int) -> Column:
    """The pairs that ids has before the merge of pair and lacks after it."""
    return bound(ids, lambda x: F.array_except(pairs_of(x), pairs_of(merge_pair(x, pair, new))))


def encode_chunks(chunks: DataFrame, tok: Tokenizer) -> DataFrame:
    """(chunk, ids) of a table of different pre-tokens."""
    shared = chunks.sparkSession.sparkContext.broadcast(tok)

    def run(batches):
        for batch in batches:
            ids = [shared.value.encode_chunk(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["chunk", "ids"])

    return chunks.select("chunk").mapInArrow(run, "chunk string, ids array<int>")


#: White space of one byte, and the bytes that it, a longer one or a separator (U+001C to U+001F) may end with.
_SPACE, _MAY_END = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
_MAY_END[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[0x21:0x7F] = ~_LETTER[0x21:0x7F]


def _spans(data: np.ndarray, at: np.ndarray, special: bool, whole: bool = False) -> np.ndarray:
    """Where spans that can be encoded by themselves begin: each row's start, white space after what surely is none, and ASCII signs and digits after an ASCII
    letter. No pre-token goes on from the one into the other, and none looks back. special: there are strings that stand for themselves, so white space
    alone counts; whole: not even that."""
    cut = np.zeros(len(data), bool)
    if not whole:
        cut[1:] = _SPACE[data[1:]] & ~_MAY_END[data[:-1]]
        if not special:
            cut[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
    cut[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Recent:
    """What was put lately: a generation of about most bytes and the one before it."""

    def __init__(self, most: int = 1 << 25):
        self.most, self.new, self.old, self.held = most, {}, {}, 0

    def get(self, key: str) -> bytes | None:
        if (got := self.new.get(key)) is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        self.new[key] = value
        self.held += 200 + 2 * len(key) + len(value)
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0


_NO_MERGE = (1 << 31) - 1
#: Bytes of a pre-token beyond which it is merged by itself.
_LONG = 4096


def _ranks(tok: Tokenizer):
    """look(a, b): the new id of each pair of two arrays, _NO_MERGE where there is none or a gap."""
    keys, n = _keys(tok.rank), 256 + len(tok.merges)
    new = np.array([tok.rank[k >> 32, k & 0xFFFFFFFF] for k in keys.tolist()], np.int32)
    if n <= 1024:
        table = np.full((n + 1, n + 1), _NO_MERGE, np.int32)  # a gap is -1, the last row and column
        table[keys >> 32, keys & 0xFFFFFFFF] = new
        return lambda a, b: table[a, b]

    def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where((keys[at] == k) & (b != _GAP), new[at], _NO_MERGE).astype(np.int32)

    return look


def merge_words(words: list[bytes], look) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words one after another, and their bounds. A round does each word's first merge, as merge_by_rank() does, in a few NumPy passes
    over the words that have one; a word has as many rounds as merges at most."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    x, word, done = np.full(int(size.sum()) + len(words), _GAP, np.int32), np.arange(len(words)), []
    own = np.ones(len(x), bool)
    own[np.cumsum(size) + word] = False
    x[own] = np.frombuffer(b"".join(words), np.uint8)
    while len(word):
        end = np.flatnonzero(x == _GAP)
        start = np.append(0, end[:-1] + 1)
        new = np.append(look(x[:-1], x[1:]), np.int32(_NO_MERGE))
        low = np.minimum.reduceat(new, start)
        hit = np.flatnonzero((new == np.repeat(low, end - start + 1)) & (new != _NO_MERGE))
        if len(hit):  # of a run of places that overlap, every second one
            first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            hit = hit[(hit - hit[first][np.cumsum(first) - 1]) % 2 == 0]
        over = low == _NO_MERGE
        left = ~np.repeat(over, end - start + 1)
        done.append((word[over], (end - start)[over], x[~left & (x != _GAP)]))
        x[hit] = new[hit]
        left[hit + 1] = False
        x, word = x[left], word[~over]
    if not done:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    word, size, flat = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(word)
    return arrow.gathered(flat, (np.cumsum(size) - size)[order], size[order])


def encode_documents(docs: DataFrame, tok: Tokenizer, key: str = "doc_id", specials: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, ids): each worker encodes its documents, some megabytes at a time; nothing is shuffled.

    A part's texts are cut into spans at white space, Arrow finds the different ones, and only those that the worker has not met lately are encoded.
    specials: the strings that stand for themselves; the longest is tried first. None: all text is ordinary. carry: columns to pass on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tok)
    pieces = "|".join(regex.escape(s) for s in sorted(specials or [], key=len, reverse=True))
    whole = any(regex.search(r"\s", s) for s in specials or [])  # a cut could go through it

    def run(batches):
        tok, split, known = shared.value, regex.compile(PATTERN), Recent()
        special, look = regex.compile(f"({pieces})") if pieces else None, _ranks(tok) if tok.merges else None

        def ordinary(text: str) -> list[int]:
            return [x for c in split.findall(text) for x in tok.encode_chunk(c)]

        def encode(spans: list[str]) -> list[bytes]:
            out, where, words, ends = [b""] * len(spans), [], [], [0]
            for i, span in enumerate(spans):
                if special and special.search(span):
                    ids = (x for k, part in enumerate(special.split(span)) for x in ([tok.specials[part]] if k % 2 else ordinary(part)))
                    out[i] = array("i", ids).tobytes()
                elif look is None:
                    out[i] = np.frombuffer(span.encode(), np.uint8).astype(np.int32).tobytes()
                elif len(span) > _LONG:
                    out[i] = array("i", ordinary(span)).tobytes()
                else:
                    one = span.isascii() and (span[1:] if span[0] == " " else span).isalpha()  # surely one pre-token
                    words += [span.encode()] if one else [c.encode() for c in split.findall(span)]
                    where.append(i)
                    ends.append(len(words))
            flat, at = merge_words(words, look)
            at, raw = (4 * at[ends]).tolist(), flat.tobytes()
            for k, i in enumerate(where):
                out[i] = raw[at[k] : at[k + 1]]
            return out

        for batch in arrow.parts(batches, 1, 1 << 20):
            data, at = arrow.text_bytes(batch.column(1))
            if tok.merges or special:
                start = _spans(data, at, special is not None, whole)
                spans = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
                texts = spans.dictionary.to_pylist()
                made = [known.get(x) for x in texts]
                new = [i for i, ids in enumerate(made) if ids is None]
                for i, ids in zip(new, encode([texts[i] for i in new]), strict=True):
                    made[i] = ids
                    known.put(texts[i], ids)
                length = np.fromiter(map(len, made), np.int64, len(made)) // 4
                which = spans.indices.to_numpy(zero_copy_only=False)
                ids, ends = arrow.gathered(np.frombuffer(b"".join(made), np.int32), (np.cumsum(length) - length)[which], length[which])
                at = ends[np.searchsorted(start, at)]
            else:  # every byte is a token
                ids = data.astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], arrow.lists(ids, at)], [key, *carry, "ids"])

    rows = docs.select(key, "text", *carry)
    return rows.mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *rows.schema.fields[2:], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_by_join(docs: DataFrame, tok: Tokenizer, key: str = "doc_id") -> DataFrame:
    """(key, ids) by encoding each different pre-token once and joining back: for models whose encoding is dear."""
    chunks = docs.select(key, F.posexplode(pretokens(F.col("text"))).alias("at", "chunk"))
    table = encode_chunks(chunks.select("chunk").distinct(), tok)
    parts = chunks.join(table, "chunk").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return docs.select(key).join(parts, key, "left").select(key, F.coalesce(F.flatten(F.transform("parts", lambda p: p["ids"])), F.array().cast("array<int>")).alias("ids"))


def decode_documents(rows: DataFrame, tok: Tokenizer, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, text) of (key, ids, carry), some 100,000 ids at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(tok)

    def run(batches):
        pool, first, length = shared.value.table()
        for batch in arrow.parts(batches, 1, 1 << 18):
            ids, at = arrow.values(batch.column(1))
            if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or (length[ids] < 0).any()):
                raise ValueError("an id that is no token's")
            data, ends = arrow.gathered(pool, first[ids], length[ids])
            raw, ends = data.tobytes(), ends[at].tolist()
            texts = [raw[i:j].decode("utf-8", errors="replace") for i, j in zip(ends, ends[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(texts, pa.string())], [key, *carry, "text"])

    own = rows.select(key, "ids", *carry)
    return own.mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *own.schema.fields[2:], T.StructField("text", T.StringType())]))


class StreamDecoder:
    """Text of ids that come one at a time: only whole characters leave; flush() gives what is left, replaced."""

    def __init__(self, tok: Tokenizer, state: tuple[bytes, int] = (b"", 0)):
        self.tok, self.utf8 = tok, codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.utf8.setstate(state)

    def push(self, i: int) -> str:
        return self.utf8.decode(self.tok.token_bytes(i))

    def flush(self) -> str:
        return self.utf8.decode(b"", final=True)

    def state(self) -> tuple[bytes, int]:
        return self.utf8.getstate()


def decode_streams(rows: DataFrame, tok: Tokenizer) -> DataFrame:
    """(seq_id, pos, piece): what each id of each sequence (seq_id, pos, token_id) adds to the text."""
    shared = rows.sparkSession.sparkContext.broadcast(tok)

    def run(batches):
        now, dec = None, None
        for batch in batches:
            out = []
            for s, i in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != now:
                    now, dec = s, StreamDecoder(shared.value)
                out.append(dec.push(i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["seq_id", "pos", "piece"])

    ordered = rows.select("seq_id", "pos", "token_id").repartition("seq_id").sortWithinPartitions("seq_id", "pos")
    return ordered.mapInArrow(run, "seq_id long, pos long, piece string")
