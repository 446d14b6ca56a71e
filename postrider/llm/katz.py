"""Katz backoff language model: Good-Turing discounted n-gram counts in parts, exactly normalised weights, recursive scores."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.columns import only
from .chunks import Numbers, bucketed, chunks, deltas, mix, pack, unpack

#: Counts above this are not discounted.
LARGE = 5
#: Tokens whose n-grams one task counts at a time, about.
KEYS = 1_000_000
#: Words in a chunk; a document with more is a chunk of its own.
WORDS = 600_000
#: Numbers of the beginning of a text (a context only) and of its end (a token); words have larger ones.
BEGIN, END, FIRST = 0, 1, 2
#: An odd number that spreads word numbers over 64 bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    """Whether a text is kept from training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def discounts(of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..LARGE, in Katz's form, from the numbers of types with count 1..LARGE+1.

    Copied texts make these numbers irregular, so they are smoothed first, at any
    size: a straight line through their logarithms by that of the count, each
    number spread over the empty counts beside it. On the line, n(r) = A r^b, the
    count r becomes r* = (r + 1) n(r + 1) / n(r), and the factors are (r* / r - c)
    / (1 - c) with c = (LARGE + 1) n(LARGE + 1) / n(1). They lie in (0, 1) where
    the line falls faster than 1 / r, which a slope of -1.1 at most sees to; with
    fewer than two numbers the slope is -2.
    """
    n = np.array(of_counts[: LARGE + 1], np.float64)
    there = np.nonzero(n)[0] + 1
    slope = -2.0
    if len(there) > 1:
        before = np.concatenate([[0], there[:-1]])
        after = np.concatenate([there[1:], [2 * there[-1] - before[-1]]])
        x, y = np.log(there), np.log(n[there - 1] * 2 / (after - before))
        slope = min(-1.1, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    r = np.arange(1, LARGE + 1)
    ratio, cut = (1 + 1 / r) ** (slope + 1), (LARGE + 1.0) ** (slope + 1)
    return np.concatenate([[1.0], (ratio - cut) / (1 - cut)])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(1, LARGE + 2)]


@dataclass
class Katz:
    """The few numbers that hold for the whole model; counts and weights come with the messages."""

    order: int
    parts: int
    texts: int
    tokens: int = 0
    types: int = 0
    #: By length of the n-gram, less one.
    factors: list[np.ndarray] = field(default_factory=list)
    words_kept: float = 0.0

    def reduced(self, counts: np.ndarray, n: int) -> np.ndarray:
        """Discounted counts of n-grams."""
        return counts * self.factors[n - 1][np.where(counts > LARGE, 0, counts)]

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(word) by its count; all words that were not seen are one, which has what the discounts leave."""
        if not self.tokens:
            return np.ones(len(counts))
        left = self.tokens - self.words_kept
        total = float(self.tokens) if left > 0 else self.tokens + 1.0
        return np.where(counts > 0, self.reduced(counts, 1), total - self.words_kept) / total

    def contexts(self, n: int, classes: list[np.ndarray], large: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(denominator, backoff weight) of contexts of n-grams.

        ``classes`` are the numbers of their n-grams seen 1..LARGE times,
        ``large`` sums the larger counts, ``covered`` the lower probabilities of
        the n-grams seen. A context that discounts leave nothing gets one more
        in its denominator; one that was not seen leaves all to the lower order.
        """
        count = sum((r * c for r, c in enumerate(classes, 1)), large)
        kept = sum((self.factors[n - 1][r] * r * c for r, c in enumerate(classes, 1)), large.astype(np.float64))
        total = np.where(count - kept > 1e-9 * np.maximum(count, 1), count, count + 1)
        weight = (1 - kept / total) / np.maximum(1 - covered, 1e-12)
        return np.where(count > 0, total, 1), np.where(count > 0, weight, 1.0)


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32 if x.max(initial=0) < 2**32 else np.uint64)


def dealt(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the hashes; places rise, parts without any are left out."""
    part = (hashes % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    start = 0
    for p, end in enumerate(ends):
        if end > start:
            yield p, order[start:end]
        start = end


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, the first place of each, each place's number among them); keys are not negative."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 64:
        # Key and place fit into one number, which sorts faster than places by key.
        both = np.sort(keys << bits | np.arange(len(keys)))
        ordered, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def named(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of word numbers as they are sent; the rows are sorted, so the first column has small differences."""
    return [small(deltas(keys[0])), *map(small, keys[1:])]


def same(asked: list[list[np.ndarray]]) -> np.ndarray:
    """For each row of all messages (columns as in :func:`named`), the number of its n-gram; rows are compared by their words."""
    columns = [np.concatenate([np.cumsum(a[0], dtype=np.int64) for a in asked])]
    columns += [np.concatenate([a[k] for a in asked]).astype(np.int64) for k in range(1, len(asked[0]))]
    # Mixed from the first column on: low bits of the key are cut off below.
    key = mix(columns[0].view(np.uint64))
    for c in columns[1:]:
        key = mix(key * SPREAD + c.view(np.uint64))
    # As much of the hash as leaves room for the place: one number, which sorts faster than places by hash.
    bits = np.uint64(len(key).bit_length())
    both = np.sort(key >> bits << bits | np.arange(len(key), dtype=np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.append(True, both[1:] >> bits != both[:-1] >> bits)[: len(both)]
    run = np.cumsum(new) - 1
    number = np.empty(len(key), np.int64)
    number[order] = run
    first = order[new]
    # Rows whose words are not those of the first row of equal hash are told apart by their words.
    other = np.zeros(len(key), bool)
    for c in columns:
        other |= c != c[first][number]
    if other.any():
        number[other] = len(first) + np.unique(np.stack([c[other] for c in columns]), axis=1, return_inverse=True)[1].reshape(-1)
    return number


def first_of(number: np.ndarray) -> np.ndarray:
    """The first place of each number that is there."""
    first = np.full(int(number.max(initial=-1)) + 1, len(number), np.int64)
    np.minimum.at(first, number, np.arange(len(number)))
    return first[first < len(number)]


class Texts:
    """A chunk as it was written: of each text its id and size, of each word its place among ``names``."""

    def __init__(self, state: bytes):
        self.ids, self.known, sizes, words, self.held, names = unpack(state)
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.int64)
        self.names = names.tobytes().split(b"\n") if len(words) else []
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names))

    def word_counts(self) -> np.ndarray:
        """How often each word occurs in texts for training."""
        return np.bincount(self.words[np.repeat(self.held, self.sizes) == 0], minlength=len(self.names))


@dataclass
class Level:
    """The distinct n-grams of a chunk, sorted by their words' numbers."""

    #: Which n-gram ends at each place of the chunk.
    gram: np.ndarray
    #: The last word's number, and a hash of all of them that deals n-grams out.
    last: np.ndarray
    hashes: np.ndarray
    #: Counts in this chunk's texts for training, then in all such texts.
    counts: np.ndarray
    #: The level below; the context, and the n-gram without its first word, by their places there.
    below: Level | None = None
    prev: np.ndarray | None = None
    lower: np.ndarray | None = None
    #: n-grams that this chunk tells their context of, so that each is told once.
    own: np.ndarray | None = None
    #: The distinct contexts, each n-gram's place among them, their denominators and weights.
    contexts: np.ndarray | None = None
    context: np.ndarray | None = None
    total: np.ndarray | None = None
    weight: np.ndarray | None = None

    def columns(self, at: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """The words' numbers of some n-grams, first words first."""
        return [*(self.below.columns(self.prev[at]) if self.below else []), self.last[at]]


class Grams:
    """A chunk's n-grams of up to ``longest`` words. Each text is its beginning, its words and its end."""

    def __init__(self, row: pd.Series, model: Katz, longest: int):
        self.model, self.row = model, row
        t = self.texts = Texts(row["state"])
        number, count = np.empty(len(t.names), np.int64), np.empty(len(t.names), np.int64)
        values = answers(row["words"])
        for p, at in dealt(t.hashes, model.parts):
            number[at], count[at] = unpack(values[p])
        number, count = np.append(number, [END, BEGIN]), np.append(count, [model.texts, 0])
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number, m = number[order], len(t.names)

        lengths = t.sizes + 2
        pads = np.cumsum(lengths) - lengths
        token = np.full(int(lengths.sum()), m, np.int64)
        self.real = np.ones(len(token), bool)
        self.real[pads] = False
        inner = self.real.copy()
        inner[pads + lengths - 1] = False
        token[inner], token[pads] = t.words, m + 1
        token = rank[token]
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        trained = self.real & (t.held[self.text] == 0)
        self.levels = [Level(token, number, mix(number.view(np.uint64) * SPREAD), count[order])]
        for _ in range(1, longest):
            below = self.levels[-1]
            prev = np.concatenate(([0], below.gram[:-1]))
            # The beginning of a text has no words before it but other beginnings.
            prev[pads] = below.gram[pads[0]]
            pair, first, gram = distinct(prev * len(number) + token)
            prev, last = pair // len(number), number[pair % len(number)]
            self.levels.append(Level(
                gram, last, mix(below.hashes[prev] + last.view(np.uint64) * SPREAD),
                np.bincount(gram[trained], minlength=len(pair)), below, prev, below.gram[first],
            ))

    def counted(self) -> Grams:
        """With the counts in all texts for training."""
        values = {p: iter(unpack(v)) for p, v in answers(self.row["counts"]).items()}
        for level in self.levels[1:]:
            level.counts, level.own = np.zeros(len(level.hashes), np.int64), np.zeros(len(level.hashes), bool)
            for p, at in dealt(level.hashes, self.model.parts):
                level.counts[at], own = next(values[p]), next(values[p])
                level.own[at] = np.unpackbits(own, count=len(at)).view(bool)
            new = np.append(True, level.prev[1:] != level.prev[:-1])
            level.contexts, level.context = level.prev[new], np.cumsum(new) - 1
        return self

    def wanted(self, n: int) -> np.ndarray:
        """Contexts whose weight is asked for, as an n-gram of theirs was not seen."""
        level = self.levels[n - 1]
        out = np.zeros(len(level.contexts), bool)
        out[level.context[level.counts == 0]] = True
        return out

    def weighed(self, n: int) -> Grams:
        """With the weights of the contexts of n-grams."""
        level, values = self.levels[n - 1], answers(self.row[f"weights{n}"])
        wanted = self.wanted(n)
        level.total, level.weight = np.ones(len(wanted)), np.ones(len(wanted))
        for p, at in dealt(self.levels[n - 2].hashes[level.contexts], self.model.parts):
            level.total[at], level.weight[at[wanted[at]]] = unpack(values[p])
        return self

    def probability(self, n: int) -> np.ndarray:
        """P(last word | words before) of the chunk's n-grams, by what was seen of them or else by the lower order."""
        level = self.levels[n - 1]
        if n == 1:
            return self.model.word(level.counts)
        back = level.weight[level.context] * self.probability(n - 1)[level.lower]
        return np.where(level.counts > 0, self.model.reduced(level.counts, n) / level.total[level.context], back)


def answers(told: list) -> dict[int, bytes]:
    return {a["part"]: a["value"] for a in told}


MESSAGE = "part int, chunk long, value binary"


def scored(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the lower-cased (A-Z) whole text and one end; a null
    text is empty. A model of n-grams up to ``order`` words (2 or more), learned
    from the texts that are not held out, scores all texts: log10 of P(token |
    tokens before), where an n-gram that was not seen backs off to the one
    without its first word, by its context's weight, again and again. Null and
    repeated ids are passed through; an empty table gives an empty result; other
    columns are not read.

    1. Texts are written in chunks (see WORDS), bucketed, and not
       shuffled again. Each chunk asks the parts of the vocabulary for its
       words' numbers and counts.
    2. Each chunk asks the parts of the n-gram counts for its distinct n-grams:
       a frequent one is one entry of a chunk, not one for each time that it
       occurs. Answers have the count in all texts, and for each n-gram one
       chunk that is to tell its context of it.
    3. For each length, the parts of the weights add up what these chunks tell
       of each context: n-grams seen once, twice and so on, larger counts, and
       the lower-order probability that they cover. From these they answer with
       its denominator and weight.

    n-grams are dealt to parts by a hash of all their words, contexts by one of
    their own, so that a frequent word's n-grams lie in many parts; equality is
    decided by the words. Chunks send nothing to parts that they do not need.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() * 1_000_000
        for k, c in enumerate(chunks(batches, lower=True, words=WORDS)):
            ids = [r[0] for r in c.rows]
            held = np.array([held_out(i) for i in ids], np.uint8)
            state = pack(
                np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), small(c.sizes),
                small(c.words), held, np.frombuffer(b"\n".join(c.named), np.uint8),
            )
            yield pa.RecordBatch.from_arrays([pa.array([place + k]), pa.array([len(c.words) + len(ids)]), pa.array([int((held == 0).sum())]), pa.array([state], pa.binary())], ["chunk", "n", "texts", "state"])

    d = only(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    table = bucketed(d.mapInArrow(cut, "chunk long, n long, texts long, state binary"))
    size = table.agg(F.sum("n"), F.sum("texts")).head()
    model = Katz(order, int(max(4, (size[0] or 0) // KEYS)), int(size[1] or 0))
    state = table.select("chunk", "state")

    def told(ask: Callable, answer: Callable, asking: DataFrame, name: str, stats: int = 0) -> tuple[DataFrame, list[int]]:
        """The table with a column of the answers to each chunk, and the sums of the numbers that parts report."""

        def of_chunk(frame: pd.DataFrame) -> pd.DataFrame:
            rows = [(p, row["chunk"], v) for _, row in frame.iterrows() for p, v in ask(row)]
            return pd.DataFrame(rows, columns=["part", "chunk", "value"])

        def of_part(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("chunk")
            values, numbers = answer(int(frame["part"].iat[0]), [unpack(v) for v in frame["value"]])
            return frame.assign(value=values, stats=[numbers] + [None] * (len(frame) - 1))[["part", "chunk", "value", "stats"]]

        out = asking.groupBy("chunk").applyInPandas(of_chunk, MESSAGE).groupBy("part").applyInPandas(of_part, MESSAGE + ", stats array<long>")
        # Written once, by chunk: later rounds read the answers without a shuffle.
        out = bucketed(out.repartition(buckets, "chunk"))
        sums = out.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(stats)]).head() if stats else []
        by_chunk = out.groupBy("chunk").agg(F.collect_list(F.struct("part", "value")).alias(name))
        # A chunk of empty texts asks nothing of the vocabulary.
        joined = asking.join(by_chunk, "chunk", "left")
        return joined.withColumn(name, F.coalesce(name, F.array().cast("array<struct<part:int,value:binary>>"))), [int(x or 0) for x in sums]

    parts = model.parts

    def ask_words(row: pd.Series) -> Iterator[tuple[int, bytes]]:
        t = Texts(row["state"])
        counts = t.word_counts()
        for p, at in dealt(t.hashes, parts):
            yield p, pack(small(counts[at]), np.frombuffer(b"\n".join([t.names[i] for i in at.tolist()]), np.uint8))

    def number_words(part: int, asked: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
        known = Numbers()
        at = [np.fromiter(map(known.__getitem__, names.tobytes().split(b"\n")), np.int64, len(counts)) for counts, names in asked]
        total = np.bincount(np.concatenate(at), np.concatenate([c for c, _ in asked])).astype(np.int64)
        # Frequent words have small numbers, which pack well.
        best = sorted(known, key=lambda w: (-total[known[w]], w))
        number = np.empty(len(best), np.int64)
        number[[known[w] for w in best]] = FIRST + part + parts * np.arange(len(best))
        stats = [int(total.sum()), int((total > 0).sum()), *counts_of_counts(total), int(total[total > LARGE].sum())]
        return [pack(small(number[a]), small(total[a])) for a in at], stats

    asking, s = told(ask_words, number_words, state, "words", 3 + LARGE + 1)
    model.tokens, model.types = s[0] + model.texts, s[1] + (model.texts > 0)
    ends = np.array([model.texts] * (model.texts > 0), np.int64)
    of_words = [a + b for a, b in zip(s[2:-1], counts_of_counts(ends), strict=True)]
    model.factors = [discounts(of_words)]
    model.words_kept = float(sum(model.factors[0][r] * r * of_words[r - 1] for r in range(1, LARGE + 1)) + s[-1] + ends[ends > LARGE].sum())

    def ask_counts(row: pd.Series) -> Iterator[tuple[int, bytes]]:
        grams = Grams(row, model, model.order)
        out: dict[int, list] = {}
        for n, level in enumerate(grams.levels[1:], 2):
            columns = level.columns()
            for p, at in dealt(level.hashes, parts):
                sent = out.setdefault(p, [])
                # Lengths that send nothing to this part have no rows there.
                sent += [np.zeros(0, np.uint8)] * (sum(range(3, n + 1)) - len(sent))
                sent += [*named([c[at] for c in columns]), small(level.counts[at])]
        width = sum(range(3, model.order + 2))
        for p, sent in out.items():
            yield p, pack(*sent, *[np.zeros(0, np.uint8)] * (width - len(sent)))

    def add_counts(part: int, asked: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
        out, stats, start = [[] for _ in asked], [], 0
        for n in range(2, model.order + 1):
            number = same([a[start : start + n] for a in asked])
            counts = np.concatenate([a[start + n] for a in asked]).astype(np.int64)
            start += n + 1
            total = np.bincount(number, counts).astype(np.int64)
            own = np.zeros(len(number), bool)
            at = np.nonzero(counts)[0]
            own[at[first_of(number[at])]] = True
            stats += counts_of_counts(total)
            x = 0
            for answer, a in zip(out, asked, strict=True):
                y = x + len(a[start - 1])
                if y > x:
                    answer += [small(total[number[x:y]]), np.packbits(own[x:y])]
                x = y
        return [pack(*o) for o in out], stats

    asking, s = told(ask_counts, add_counts, asking, "counts", (LARGE + 1) * (order - 1))
    model.factors += [discounts(s[k : k + LARGE + 1]) for k in range(0, len(s), LARGE + 1)]
    for n in range(2, order + 1):
        asking, _ = told(_ask_weights(model, n), _weigh(model, n), asking, f"weights{n}")

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_scores(_filled(row, model, model.order, model.order), model) for _, row in frame.iterrows()], ignore_index=True)

    return asking.groupBy("chunk").applyInPandas(judged, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _filled(row: pd.Series, model: Katz, longest: int, weighed: int) -> Grams:
    """A chunk's n-grams with all answers that there are: counts, and weights up to a length."""
    grams = Grams(row, model, longest).counted()
    for n in range(2, weighed + 1):
        grams.weighed(n)
    return grams


def _ask_weights(model: Katz, n: int) -> Callable:
    def ask(row: pd.Series) -> Iterator[tuple[int, bytes]]:
        grams = _filled(row, model, n, n - 1)
        level, below = grams.levels[n - 1], grams.levels[n - 2]
        size = len(level.contexts)
        context, counts = level.context[level.own], level.counts[level.own]
        classes = [small(np.bincount(context[counts == r], minlength=size)) for r in range(1, LARGE + 1)]
        large = small(np.bincount(context[counts > LARGE], counts[counts > LARGE], size))
        covered = np.bincount(context, grams.probability(n - 1)[level.lower[level.own]], size)
        wanted = grams.wanted(n)
        columns = below.columns(level.contexts)
        for p, at in dealt(below.hashes[level.contexts], model.parts):
            tells = covered[at] > 0
            yield p, pack(*named([c[at] for c in columns]), *[c[at] for c in classes], large[at], np.packbits(tells), covered[at][tells], np.packbits(wanted[at]))

    return ask


def _weigh(model: Katz, n: int) -> Callable:
    def weigh(part: int, asked: list[list[np.ndarray]]) -> tuple[list[bytes], None]:
        number = same([a[: n - 1] for a in asked])
        sums = [np.bincount(number, np.concatenate([a[k] for a in asked])).astype(np.int64) for k in range(n - 1, n + LARGE)]
        covered = np.zeros(len(number))
        covered[np.concatenate([np.unpackbits(a[-3], count=len(a[0])).view(bool) for a in asked])] = np.concatenate([a[-2] for a in asked])
        total, weight = model.contexts(n, sums[:-1], sums[-1], np.bincount(number, covered))
        out, x = [], 0
        for a in asked:
            own = number[x : x + len(a[0])]
            out.append(pack(small(total[own]), weight[own[np.unpackbits(a[-1], count=len(own)).view(bool)]]))
            x += len(own)
        return out, None

    return weigh


def _scores(grams: Grams, model: Katz) -> pd.DataFrame:
    t, text, n = grams.texts, grams.text[grams.real], len(grams.texts.ids)
    words = grams.levels[0].counts[grams.levels[0].gram[grams.real]]
    base = np.log10((words + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
    score = np.log10(grams.probability(model.order))[grams.levels[-1].gram[grams.real]]
    ids = pd.array(t.ids, dtype="Int64")
    ids[t.known == 0] = pd.NA
    return pd.DataFrame({
        "doc_id": ids, "held_out": t.held == 1, "n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text[words > 0], minlength=n),
        "train_tokens": model.tokens, "base_score": np.bincount(text, base, n), "score": np.bincount(text, score, n),
    })
