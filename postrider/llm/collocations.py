"""Phrases whose words occur together: counted in tiles of frequency-ranked ids, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.columns import only
from ..plans.staging import stage
from .chunks import Numbers, pack, unpack

#: Words in a chunk; a document with more is a chunk of its own.
WORDS = 700_000
#: Rows that a task sends at a time.
ROWS = 1 << 15
#: Frequent words or phrases of a length that are sent to all tasks; more are joined.
SMALL = 400_000
#: What ends a piece, and the letters that are lower-cased.
BREAKS, BLANK, UPPER = b",;:!?\n\x0b\x0c\r", b"\t", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word that texts cannot have, as a full stop ends a piece.
BREAK = b"."
_PLAIN = bytes.maketrans(UPPER + BREAKS + BLANK, UPPER.lower() + BREAK * len(BREAKS) + b" ")
#: Ranks of words, and of words in a tile's side.
WORD_BITS, SIDE_BITS = 30, 9
#: A tile is counted by address if it has so many pairs, a share of its cells.
DENSE = (1 << 2 * SIDE_BITS) // 16
#: Tiles on each side that may be dense.
LOW = 64


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with :data:`BREAK` where a piece ends."""
    return (text or "").encode().translate(_PLAIN).replace(BREAK, b" . ").split()


ASKED = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("state", pa.binary()), ("code", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def split_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as in :data:`ASKED` from rows (lang, text): for each chunk one with its word numbers in order, 0 for the end of a piece, and one for each word with its number and count."""
    task, made = TaskContext.get().partitionId(), 0
    open_: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
    size: dict[str, int] = {}

    def chunk(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        known, parts = open_.pop(lang)
        size.pop(lang)
        words = np.concatenate(parts)
        made += 1
        number = (task << 32) + made
        yield pa.RecordBatch.from_pylist([{"chunk": number, "lang": lang, "state": pack(words, np.frombuffer(b"\n".join(list(known)[1:]), np.uint8))}], ASKED)
        named, n = list(known), np.bincount(words, minlength=len(known))
        for at in range(1, len(named), ROWS):
            part = named[at : at + ROWS]
            columns = [np.full(len(part), number), [lang] * len(part), [None] * len(part), np.arange(at, at + len(part)), part, n[at : at + ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASKED, strict=True)], schema=ASKED)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            parts = words_of(text.as_py())
            if not parts:
                continue
            if lang not in open_:
                open_[lang], size[lang] = (Numbers({BREAK: 0}), []), 0
            known, held = open_[lang]
            held += [np.fromiter(map(known.__getitem__, parts), np.int32, len(parts)), np.zeros(1, np.int32)]
            size[lang] += len(parts)
            if size[lang] >= WORDS:
                yield from chunk(lang)
    for lang in list(open_):
        yield from chunk(lang)


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the distinct pairs of ranks; a pair's code is a * 2^WORD_BITS + b.

    Ranks fall into tiles of equal sides. As low ranks are frequent, some tiles
    hold most of the pairs: these are counted by address, an array with a cell
    for each pair of the tile. The pairs of all other tiles are sorted.
    """
    side, mask = SIDE_BITS, (1 << SIDE_BITS) - 1
    if len(a) and (int(a.max()) >= 1 << 63 - WORD_BITS or int(b.max()) >= 1 << WORD_BITS):
        raise ValueError("more frequent words or phrases than a code can hold")
    # Only tiles of low ranks can hold as many.
    low = np.nonzero((a < LOW << side) & (b < LOW << side))[0]
    tile = ((a[low] >> side) * LOW + (b[low] >> side)).astype(np.int16)
    codes, counts, rest = [], [], np.ones(len(a), bool)
    for t in np.nonzero(np.bincount(tile, minlength=1) >= DENSE)[0].tolist():
        own = low[tile == t]
        cells = np.bincount(((a[own] & mask) << side) | (b[own] & mask), minlength=1 << 2 * side)
        full = np.nonzero(cells)[0]
        codes.append((((t // LOW << side) + (full >> side)) << WORD_BITS) | ((t % LOW << side) + (full & mask)))
        counts.append(cells[full])
        rest[own] = False
    coo = (a[rest] << WORD_BITS) | b[rest]
    coo, n = np.unique(coo, return_counts=True)
    return np.concatenate([*codes, coo]), np.concatenate([*counts, n])


def joined_pairs(words: np.ndarray, phrases: np.ndarray, length: int) -> np.ndarray:
    """Where a phrase of that length and the one a word later are both frequent, so that the longer phrase may be."""
    at = np.nonzero(phrases[: max(0, len(words) - length)] >= 0)[0]
    return at[phrases[at + 1] >= 0]


def shortened(words: np.ndarray, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that are in no frequent phrase of that length; one -1 stands for what lay between."""
    inside = np.zeros(len(words), bool)
    starts = np.nonzero(phrases >= 0)[0]
    for k in range(length):
        inside[starts + k] = True
    keep = inside | (np.concatenate([[False], inside[:-1]]) if len(words) else inside)
    return np.where(inside, words, -1)[keep], np.where(inside, phrases, -1)[keep]


def ranked(phrases: DataFrame, *ties: str) -> DataFrame:
    """``phrases`` with the column rank: from 0 in each lang by falling n, without a task that holds a lang."""
    order = ["lang", F.desc("n"), *ties]
    s = stage(phrases.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).alias("part")
    # As many rows as the sort has partitions, for each lang.
    firsts = s.groupBy("lang", part).agg(F.min("row").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("lang", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    s = s.withColumn("part", part).join(firsts, ["lang", "part"])
    return s.withColumn("rank", F.col("row") - F.col("first") + F.col("base")).drop("row", "part", "first", "base")


def with_ranks(words: np.ndarray, before: np.ndarray, length: int, code: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of the phrase of that length that starts at each place, or -1; ``before`` has those of a word less, ``code`` is sorted."""
    at = joined_pairs(words, before, length - 1)
    phrases = np.full(len(words), -1, np.int64)
    if len(code) and len(at):
        asked = (before[at] << WORD_BITS) | words[at + length - 1]
        place = np.minimum(np.searchsorted(code, asked), len(code) - 1)
        phrases[at] = np.where(code[place] == asked, rank[place], -1)
    return phrases


class Known:
    """Ranks of frequent words and phrases by lang, small enough to be sent to all tasks."""

    def __init__(self) -> None:
        self.words: dict[str, dict[bytes, int]] = {}
        self.codes: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []

    def add(self, found: pa.Table) -> None:
        """The next length, from a table (lang, word, rank) for words and (lang, code, rank) for phrases."""
        if "code" in found.schema.names:
            self.codes.append({})
        for lang in found["lang"].unique().to_pylist():
            own = found.filter(pc.equal(found["lang"], lang))
            if "word" in own.schema.names:
                self.words[lang] = {w.encode(): r for w, r in zip(own["word"].to_pylist(), own["rank"].to_pylist(), strict=True)}
            else:
                code, rank = own["code"].to_numpy(), own["rank"].to_numpy()
                order = np.argsort(code)
                self.codes[-1][lang] = code[order], rank[order]

    def state(self, packed: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(words, phrases, length) of a chunk, for the longest phrases that are known."""
        numbers, names = unpack(packed)
        of_word = self.words.get(lang, {})
        of = np.array([-1, *[of_word.get(w, -1) for w in names.tobytes().split(b"\n")]], np.int64)
        words, phrases = shortened(of[numbers], of[numbers], 1)
        for k, of_lang in enumerate(self.codes, 2):
            code, rank = of_lang.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            words, phrases = shortened(words, with_ranks(words, phrases, k, code, rank), k)
        return words, phrases, 1 + len(self.codes)


def _small(level: DataFrame) -> pa.Table | None:
    """The rows of a level if they are few."""
    found = level.limit(SMALL + 1).toArrow()
    return found if len(found) <= SMALL else None


def _answered(chunks: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """Rows (chunk, lang, state) of the next level from rows (chunk, lang, state) and the ranks that each chunk's distinct phrases got."""

    def next_state(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not (len(chunk) and len(answer)):
            return chunk.slice(0, 0)
        arrays = unpack(chunk["state"][0].as_py())
        code, rank = answer["code"].to_numpy(), answer["rank"].to_numpy()
        if length == 1:
            of = np.full(int(max(code.max(), arrays[0].max())) + 1, -1, np.int64)
            of[code] = rank
            words = phrases = of[arrays[0]]
        else:
            order = np.argsort(code)
            words = arrays[0]
            phrases = with_ranks(words, arrays[1], length, code[order], rank[order])
        return chunk.set_column(chunk.schema.get_field_index("state"), "state", pa.array([pack(*shortened(words, phrases, length))], pa.binary()))

    own = answers.select(F.col("chunk").alias("asker"), "code", "rank")
    return chunks.groupBy("chunk").cogroup(own.groupBy("asker")).applyInArrow(next_state, "chunk long, lang string, state binary")


def _pairs(states: Callable[[bytes, str], tuple[np.ndarray, np.ndarray, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (chunk, lang, state) the rows (chunk, lang, code, n): how often each phrase that is a word longer occurs in a chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, packed in zip(*batch.columns, strict=True):
                own, phrases, length = states(packed.as_py(), lang.as_py())
                at = joined_pairs(own, phrases, length)
                codes, n = tile_counts(phrases[at], own[at + length])
                for start in range(0, len(codes), ROWS):
                    part = slice(start, start + ROWS)
                    size = len(codes[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, chunk.as_py())), pa.array([lang.as_py()] * size, pa.string()), pa.array(codes[part]), pa.array(n[part])], ["chunk", "lang", "code", "n"])

    return counted


def _states(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks with the ranks of the longest phrases that all tasks know, to be told of longer ones."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(*shipped.value.state(s.as_py(), lang.as_py())[:2]) for lang, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["chunk", "lang", "state"])

    return known


def _told(asked: DataFrame, level: DataFrame, key: str) -> DataFrame:
    """(chunk, code, rank): the ranks of what chunks asked for. The frequent ones are few beside that: hashed, not sorted."""
    return asked.join(level.select("lang", key, "rank").hint("shuffle_hash"), ["lang", key]).select("chunk", "code", "rank")


def frequent_phrases(docs: DataFrame, least: int = 100, most_words: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, length, phrase, n), (lang, n)): the phrases of up to ``most_words`` words with ``least`` occurrences or more, words included; the words of each lang.

    At each level a chunk sends its distinct phrases with their counts, and the
    frequent ones are ranked by frequency. A phrase one word longer is then a
    pair of ranks: of its beginning and of its last word. Up to :data:`SMALL`
    ranks are sent to all tasks; of more, a chunk is told those that it has, by
    a join.
    """
    d = only(docs, lang=F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")), text=text_col)
    rows = stage(d.mapInArrow(split_chunks, "chunk long, lang string, state binary, code long, word string, n long"))
    asked = rows.filter("code IS NOT NULL").select("chunk", "lang", "code", "word", "n")
    counts = stage(asked.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    level = stage(ranked(counts.filter(F.col("n") >= least), "word"))
    words = level.select("lang", F.col("rank").alias("b"), "word")
    bases = rows.filter("code IS NULL").select("chunk", "lang", "state")
    known, state = Known(), None  # what all tasks know; beyond that, what chunks were told
    found = _small(level.select("lang", "word", "rank"))
    if found is not None:
        known.add(found)
    else:
        state = stage(_answered(bases, _told(asked, level, "word"), 1))
    levels = [level.select("lang", F.lit(1).alias("length"), F.col("word").alias("phrase"), "n", "rank")]

    for length in range(2, most_words + 1):
        if state is None:
            shipped = docs.sparkSession.sparkContext.broadcast(known)
            asked = bases.mapInArrow(_pairs(lambda packed, lang, shipped=shipped: shipped.value.state(packed, lang)), "chunk long, lang string, code long, n long")
        else:
            asked = state.mapInArrow(_pairs(lambda packed, lang, length=length: (*unpack(packed), length - 1)), "chunk long, lang string, code long, n long")
        sums = asked.groupBy("lang", "code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        level = stage(ranked(sums, "code"))
        if length < most_words:
            found = _small(level.select("lang", "code", "rank")) if state is None else None
            if found is not None:
                known.add(found)
            else:
                before = state or stage(bases.mapInArrow(_states(shipped), "chunk long, lang string, state binary"))
                state = stage(_answered(before, _told(asked, level, "code"), length))
        a, b = F.shiftright("code", WORD_BITS), F.col("code").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
        longer = level.select("lang", a.alias("a"), b.alias("b"), "n", "rank").join(words, ["lang", "b"])
        before = levels[-1].select("lang", F.col("rank").alias("a"), "phrase")
        longer = longer.join(before, ["lang", "a"]).select("lang", F.lit(length).alias("length"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "n", "rank")
        levels.append(stage(longer))

    every = levels[0]
    for found in levels[1:]:
        every = every.union(found)
    return every.drop("rank"), counts.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang whose words occur together more often than by chance.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces,
    these at blanks and tabs into words. ``n`` counts a lang's words, ``a`` the
    occurrences of a phrase in pieces, overlaps included. Phrases of 2 to
    ``most_words`` words with ``a`` of ``least`` or more are cut after each word
    but the last into parts with ``l`` and ``r`` occurrences; floor(1000 a n /
    (l r)) of the lowest cut is the score, ties to the earliest cut. A phrase
    goes if a longer one that contains it occurs as often. Order: score, then
    a, falling, then phrase in byte order. All numbers are exact, in decimals
    where products pass 64 bits.

    A null lang is ``und``, a null or empty text has no words. Each row counts,
    rows that repeat an id too. An empty table, and one without phrases as
    frequent, gives an empty result. Other columns are not read.

    What tasks exchange are counts by phrase; no task holds a lang, and a lang
    or word with most of the rows is spread over all chunks that have it.
    """
    phrases, words = frequent_phrases(docs, least, most_words, lang_col, text_col)
    phrases = stage(phrases)
    split = phrases.filter("length > 1").withColumn("words", F.split("phrase", " "))
    candidates = split.select("lang", "phrase", "length", F.col("n").alias("a"), "words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("of_part").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("rest"), F.col("of_part").alias("r")), ["lang", "rest"]).join(stage(words), "lang")
    # Both products have 38 digits at most.
    score = F.expr("cast(1000 AS decimal(4,0)) * cast(a AS decimal(15,0)) * cast(n AS decimal(17,0)) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Parts of 2 words or more of each longer candidate, at most nine for five words.
    spans = candidates.filter("length > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    spans = spans.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    within = spans.groupBy("lang", _part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    own = lowest.join(within, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    out = own.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
