"""Ranked retrieval over messages, as one plan of column expressions.

Terms are matched as whole words after folding accents and letter case; there
is no stemming. A hit in the headers or the body makes a row primary; recall by
similar spelling or by synonyms only adds rows below all primary ones.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters with accents and what they fold to.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Fixed values of the score: a half-life of 30 days, weights of fields and tiers.
DECAY = 0.0231049


@dataclass(frozen=True)
class Terms:
    """Groups of alternatives that must all be met, phrases among them, and words that no row may have."""

    groups: tuple[tuple[str, ...], ...] = ()
    without: tuple[str, ...] = ()

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for g in self.groups for w in g))


def folded(c: Column) -> Column:
    return F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTED, FOLDED))


def tokens(c: Column) -> Column:
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def frequency(words: Column, term: str) -> Column:
    """How often a word, or a phrase of words beside each other, occurs in an array of words."""
    parts = term.lower().split()
    if len(parts) == 1:
        return F.size(F.filter(words, lambda x: x == parts[0]))
    # As one text, so that the words are not computed again for each place.
    text, phrase = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), " " + "  ".join(parts) + " "
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def matches(words: Column, terms: Terms) -> Column:
    """All groups met by one of their alternatives."""
    return functools.reduce(operator.and_, [functools.reduce(operator.or_, [frequency(words, t) > 0 for t in g]) for g in terms.groups], F.lit(True))


def rank(words: Column, terms: Terms) -> Column:
    """Frequency of the terms by the text's length; 0 where the groups are not all met."""
    hits = functools.reduce(operator.add, [frequency(words, t) for t in terms.words], F.lit(0))
    return F.when(matches(words, terms), hits / (1 + F.log(F.size(words) + 1))).otherwise(0.0)


def widened(terms: Terms, synonyms: dict[str, tuple[str, ...]], most: int = 24) -> Terms:
    """All words and their synonyms as one group of alternatives."""
    more = [s for w in terms.words for s in synonyms.get(w, ()) if s not in terms.words]
    return Terms((terms.words + tuple(dict.fromkeys(more))[:most],), terms.without) if more else Terms()


def trigrams(c: Column) -> Column:
    """Distinct three-letter parts of the words, each with two blanks before and one behind."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def similarity(c: Column, term: str) -> Column:
    """Share of the term's three-letter parts that the text has."""
    t = trigrams(F.lit(term))
    return F.size(F.array_intersect(trigrams(c), t)) / F.greatest(F.size(t), F.lit(1))


#: Words that say nothing of what is looked for.
STOPWORDS = (
    "a an and are as at be by do for from i in is it me my of on or our that the this to us we with you your "
    "about any all show find get email emails mail message messages"
).split()


def significant(words: tuple[str, ...], most: int = 8) -> tuple[str, ...]:
    """The words that are looked for by similar spelling: three letters or more, no stopwords, each once."""
    return tuple(dict.fromkeys(w for w in words if len(w) >= 3 and w not in STOPWORDS))[:most]


def significant_tokens(c: Column, most: int = 8) -> Column:
    """The same of a column of free text, folded."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))), 1, most)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, each computed once for a row.

    A plain projection would be merged into the filters and columns above it
    and computed again in each of them; rows of a generator are not.
    """
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", held.alias("__once")).select("*", "__once.*").drop("__once")


def covers(words: DataFrame, terms: Terms) -> DataFrame:
    """(id, density): cover density of rows (id, words) that have all groups of terms.

    A cover is a shortest run of words with all groups in it; it counts one by
    its length. Only hits leave their row: each is the end of the run from the
    earliest of the groups' last hits, and the run is shortest if its start is
    beyond that of the hit before.
    """
    named = [(i, w) for i, g in enumerate(terms.groups) for w in g]
    of = functools.reduce(lambda c, x: c.when(F.col("word") == x[1], x[0]), named, F.when(F.lit(False), -1))
    hits = words.select("id", F.posexplode("words").alias("pos", "word")).withColumn("g", of).filter("g IS NOT NULL").select("id", "pos", "g")
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("g") == i, F.col("pos"))).over(so_far) for i in range(len(terms.groups))]
    start = functools.reduce(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), lasts)
    runs = hits.select("id", "pos", start.alias("start")).filter("start IS NOT NULL")
    before = F.lag("start").over(Window.partitionBy("id").orderBy("pos"))
    short = runs.withColumn("before", before).filter("before IS NULL OR start > before")
    return short.groupBy("id").agg(F.sum(1.0 / (F.col("pos") - F.col("start") + 1)).alias("density"))


def weighted_head() -> Column:
    """(word, weight) of the header fields without stopwords: A in the subject, B in the sender, C in the recipients; a word's best weight."""
    field = lambda c, w: F.transform(F.filter(tokens(c), lambda x: ~x.isin(STOPWORDS)), lambda x: F.struct(x.alias("word"), F.lit(w).alias("weight")))
    people = F.concat_ws(" ", F.array_join("to_emails", " "), F.array_join("cc_emails", " "))
    return F.concat(field(F.substring("subject", 1, 32768), "A"), field(F.concat_ws(" ", "from_name", "from_email"), "B"), field(people, "C"))


def marked(text: Column, words: tuple[str, ...], fragments: int = 2, around: int = 6) -> Column:
    """The first fragments around hits, with the hits in <mark>, joined by an ellipsis; null without a hit. For the rows of a page."""
    any_of = "|".join(words)
    cut = rf"(?i)(?:[^\s]+\s+){{0,{around}}}\b(?:{any_of})\b(?:\s+[^\s]+){{0,{around}}}"
    found = F.slice(F.regexp_extract_all(text, F.lit(cut), 0), 1, fragments)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.regexp_replace(x, rf"(?i)\b({any_of})\b", "<mark>$1</mark>")), " ... "))


def listish(headers: Column, sender: Column) -> Column:
    """Mail of a list: by its headers, or by a sender that only sends in bulk."""
    has = lambda k: F.map_contains_key(headers, F.lit(k))
    return F.coalesce(has("list-unsubscribe") | has("list-id"), F.lit(False)) | F.rlike(F.lower(F.coalesce(sender, F.lit(""))), F.lit(r"^(newsletter|marketing|mailer)@"))


def shown_score(order: str, included: tuple[str, ...], score: Column) -> Column:
    """The score where the order ranks (smart or relevance) over words that are looked for; else null."""
    return score if order in ("smart", "relevance") and included else F.lit(None).cast("double")


def recency(date: Column, now: str) -> Column:
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / 86_400_000_000.0
    return F.exp(-DECAY * days)


def prior() -> Column:
    """Flagged and unread messages gain, mail of lists loses; within 0.2 and 4."""
    has = lambda f: F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), f)
    bulk = listish(F.col("headers"), F.col("from_email"))
    return F.greatest(F.lit(0.2), F.least(F.lit(4.0), 1 + 0.5 * has("\\Flagged").cast("double") + 0.3 * (~has("\\Seen")).cast("double") - 0.7 * bulk.cast("double")))


def scored(messages: DataFrame, terms: Terms, now: str, synonyms: dict[str, tuple[str, ...]] | None = None, fuzzy: float | None = None) -> DataFrame:
    """Rows that the terms recall, with is_primary, text_rel and score.

    One scan with all branches as columns instead of one scan for each branch.
    """
    head = F.concat_ws(" ", "subject", "from_name", "from_email", F.array_join("to_emails", " "))
    wide = widened(terms, synonyms or {})
    df = once(messages, __head=tokens(head), __body=tokens(F.col("body")))
    none = F.lit(0.0)
    near = F.greatest(none, *[similarity(head, w) for w in significant(terms.words)]) if fuzzy else none
    barred = functools.reduce(operator.or_, [F.array_contains(c, w) for w in terms.without for c in ("__head", "__body")], F.lit(False))
    df = once(
        df, __h=rank(F.col("__head"), terms), __b=rank(F.col("__body"), terms), __barred=barred, __f=near,
        __wh=rank(F.col("__head"), wide) if wide.groups else none, __wb=rank(F.col("__body"), wide) if wide.groups else none,
    ).filter(~F.col("__barred"))
    primary = (F.col("__h") > 0) | (F.col("__b") > 0)
    recalled = primary | (F.col("__wh") > 0) | (F.col("__wb") > 0) | (F.col("__f") >= (fuzzy or 2.0))
    text = F.when(primary, 0.6 * F.col("__h") + 0.2 * F.col("__b")).otherwise(0.3 * F.col("__f") + 0.2 * (0.6 * F.col("__wh") + 0.2 * F.col("__wb")))
    df = df.filter(recalled).withColumn("is_primary", primary).withColumn("text_rel", F.round(text, 9))
    df = df.withColumn("relevance", F.round(F.col("text_rel") * prior(), 9))
    df = df.withColumn("score", F.round(F.col("text_rel") * recency(F.col("date"), now) * prior(), 9))
    return df.drop("__head", "__body", "__h", "__b", "__wh", "__wb", "__f", "__barred")


BEST = (F.desc, ("is_primary", "score", "date", "id"))


def best_first() -> list[Column]:
    return [F.desc(c) for c in BEST[1]]


def one_for_each(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The best row for each key: copies of a delivery, or rows of a conversation."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first()))).filter("__rn = 1").drop("__rn")


def top(df: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page by rank; ``limit`` is held between 1 and 100."""
    return df.orderBy(*best_first()).offset(max(0, offset)).limit(min(100, max(1, limit)))
