"""Ranked search: the flagship query and its parts."""

import uuid

from pyspark.sql import functions as F

from ..operators import ranking as r
from ..operators.postings import TextIndex
from ..operators.spelling import SpellingIndex
from ..plans.staging import shared_dir, stage
from ..sources.tables import SQL, live_messages, read
from . import Group

group = Group()
add = group.add
NOW = "2024-03-01 00:00:00"
#: Mail of lists, by headers or sender.
LISTISH = "(listed OR regexp_matches(lower(from_email), '^(newsletter|marketing|mailer)@'))"
TERMS = r.Terms((("der", "the"), ("und", "of")), ("los",))
SYNONYMS = {"of": ("por",), "the": ("une",)}

TOK = "list_filter(regexp_split_to_array(lower(strip_accents(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
HEAD = TOK.format("concat_ws(' ', subject, from_name, from_email, array_to_string(to_emails, ' '))")


def tf(words, term):
    return f"len(list_filter({words}, lambda x: x = '{term}'))"


def rank_sql(words, groups):
    met = " AND ".join("(" + " OR ".join(f"{tf(words, t)} > 0" for t in g) + ")" for g in groups)
    hits = " + ".join(tf(words, t) for t in dict.fromkeys(t for g in groups for t in g))
    return f"CASE WHEN {met} THEN ({hits})::DOUBLE / (1 + ln(len({words}) + 1)) ELSE 0.0 END"


def scored_sql(groups, without=(), wide=None):
    """The same plan in SQL, as a table called scored."""
    w = (rank_sql("hw", wide), rank_sql("bw", wide)) if wide else ("0.0", "0.0")
    out = "".join(f" AND {tf('hw', x)} = 0 AND {tf('bw', x)} = 0" for x in without)
    return f"""{SQL}, t AS (SELECT *, {HEAD} AS hw, {TOK.format('body')} AS bw FROM m),
x AS (SELECT *, {rank_sql('hw', groups)} AS h, {rank_sql('bw', groups)} AS b, {w[0]} AS wh, {w[1]} AS wb FROM t WHERE true{out}),
y AS (SELECT *, h > 0 OR b > 0 AS is_primary, round(CASE WHEN h > 0 OR b > 0 THEN 0.6::DOUBLE * h + 0.2::DOUBLE * b ELSE 0.2::DOUBLE * (0.6::DOUBLE * wh + 0.2::DOUBLE * wb) END, 9) AS text_rel FROM x WHERE h > 0 OR b > 0 OR wh > 0 OR wb > 0),
scored AS (SELECT *, round(text_rel * exp(-0.0231049::DOUBLE * ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(date))::DOUBLE / 86400000000.0::DOUBLE))
 * greatest(0.2::DOUBLE, least(4.0::DOUBLE, 1 + 0.5::DOUBLE * list_contains(coalesce(flags, []), '\\Flagged')::INT + 0.3::DOUBLE * (NOT list_contains(coalesce(flags, []), '\\Seen'))::INT - 0.7::DOUBLE * {LISTISH}::INT)), 9) AS score FROM y)"""


BASE = scored_sql(TERMS.groups, TERMS.without)
BEST = "is_primary DESC, score DESC, date DESC, id DESC"


@add("search_smart", f"""WITH {scored_sql(TERMS.groups, TERMS.without, [tuple(r.widened(TERMS, SYNONYMS).groups[0])])},
d AS (SELECT DISTINCT ON (account, md5(body)) * FROM scored ORDER BY account, md5(body), {BEST}),
c AS (SELECT *, count(*) OVER (PARTITION BY account, folder) AS in_conversation FROM d),
g AS (SELECT DISTINCT ON (account, folder) * FROM c ORDER BY account, folder, {BEST})
SELECT id, account, folder, is_primary, text_rel, score, in_conversation FROM g ORDER BY {BEST} LIMIT 25""")
def search_smart(spark, d):
    """Ranked search with recall by synonyms, one row for each delivery and conversation, first page."""
    from pyspark.sql import Window

    s = r.scored(live_messages(spark, d), TERMS, NOW, SYNONYMS)
    s = r.one_for_each(s.withColumn("delivery", F.md5("body")), "account", "delivery")
    s = s.withColumn("in_conversation", F.count("*").over(Window.partitionBy("account", "folder")))
    return r.top(r.one_for_each(s, "account", "folder")).select("id", "account", "folder", "is_primary", "text_rel", "score", "in_conversation")


@add("ord_smart", f"WITH {BASE} SELECT id, score FROM scored ORDER BY {BEST} LIMIT 25")
def ord_smart(spark, d):
    return r.top(r.scored(live_messages(spark, d), TERMS, NOW)).select("id", "score")


@add("flt_body", f"WITH {SQL} SELECT id FROM m WHERE {tf(TOK.format('body'), 'the')} > 0")
def flt_body(spark, d):
    return live_messages(spark, d).filter(r.matches(r.tokens(F.col("body")), r.Terms((("the",),)))).select("id")


@add("flt_exclude_text", f"WITH {SQL} SELECT id FROM m WHERE {tf(TOK.format('body'), 'the')} = 0 AND {tf(HEAD, 'the')} = 0")
def flt_exclude_text(spark, d):
    head = F.concat_ws(" ", "subject", "from_name", "from_email", F.array_join("to_emails", " "))
    return live_messages(spark, d).filter((r.frequency(r.tokens(F.col("body")), "the") == 0) & (r.frequency(r.tokens(head), "the") == 0)).select("id")


@add("fts_body_doc", f"WITH {SQL} SELECT id, md5(array_to_string({TOK.format('body')}, ' ')) AS words, len({TOK.format('body')})::INT AS n FROM m")
def fts_body_doc(spark, d):
    t = r.tokens(F.col("body"))
    return live_messages(spark, d).select("id", F.md5(F.array_join(t, " ")).alias("words"), F.size(t).alias("n"))


@add("fts_query", f"WITH {SQL}, t AS (SELECT id, {TOK.format('body')} AS w FROM m) SELECT id FROM t WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND ({tf('w', 'and')} > 0 OR {tf('w', 'or')} > 0)")
def fts_query(spark, d):
    """A phrase, and one of two alternatives."""
    return live_messages(spark, d).filter(r.matches(r.tokens(F.col("body")), r.Terms((("of the",), ("and", "or"))))).select("id")


@add("rec_concept", f"WITH {scored_sql((('the',),), (), [('the', 'une')])} SELECT id, is_primary FROM scored")
def rec_concept(spark, d):
    return r.scored(live_messages(spark, d), r.Terms((("the",),)), NOW, SYNONYMS).select("id", "is_primary")


@add("cand_scan", f"WITH {SQL} SELECT id FROM m WHERE account = 'src1' AND size > 1000")
def cand_scan(spark, d):
    return live_messages(spark, d).filter((F.col("account") == "src1") & (F.col("size") > 1000)).select("id")


@add("cand_union", f"WITH {SQL}, h AS (SELECT id FROM m WHERE {tf(HEAD, 'the')} > 0 ORDER BY date DESC, id DESC LIMIT 400), b AS (SELECT id FROM m WHERE {tf(TOK.format('body'), 'the')} > 0 ORDER BY date DESC, id DESC LIMIT 400) SELECT id FROM h UNION SELECT id FROM b")
def cand_union(spark, d):
    """Candidates of the branches, each its newest 400: the cap is the feature."""
    df = live_messages(spark, d)
    head = F.concat_ws(" ", "subject", "from_name", "from_email", F.array_join("to_emails", " "))
    branch = lambda c: df.filter(r.frequency(r.tokens(c), "the") > 0).orderBy(F.desc("date"), F.desc("id")).limit(400).select("id")
    return branch(head).union(branch(F.col("body"))).distinct()


@add("scr_recency", f"WITH {SQL} SELECT id, round(exp(-0.0231049::DOUBLE * ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(date))::DOUBLE / 86400000000.0::DOUBLE)), 6) AS recency FROM m")
def scr_recency(spark, d):
    return live_messages(spark, d).select("id", F.round(r.recency(F.col("date"), NOW), 6).alias("recency"))


@add("scr_prior", f"WITH {SQL} SELECT id, round(greatest(0.2, least(4.0, 1 + 0.5 * list_contains(coalesce(flags, []), '\\Flagged')::INT + 0.3 * (NOT list_contains(coalesce(flags, []), '\\Seen'))::INT - 0.7 * {LISTISH}::INT)), 6)::DOUBLE AS prior FROM m")
def scr_prior(spark, d):
    return live_messages(spark, d).select("id", F.round(r.prior(), 6).alias("prior"))


@add("scr_primary", f"WITH {BASE} SELECT id, is_primary, text_rel FROM scored")
def scr_primary(spark, d):
    return r.scored(live_messages(spark, d), TERMS, NOW).select("id", "is_primary", "text_rel")


@add("grp_delivery", f"WITH {BASE}, d AS (SELECT account, md5(body) AS delivery, id, list(id) OVER (PARTITION BY account, md5(body) ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids, row_number() OVER (PARTITION BY account, md5(body) ORDER BY {BEST}) AS rn FROM scored) SELECT account, id, list_sort(ids) AS ids FROM d WHERE rn = 1")
def grp_delivery(spark, d):
    """The best copy of each delivery, with the ids of all: one list for each delivery, not for each copy."""
    s = r.scored(live_messages(spark, d), TERMS, NOW).withColumn("delivery", F.md5("body"))
    ids = s.groupBy("account", "delivery").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return r.one_for_each(s, "account", "delivery").join(ids, ["account", "delivery"]).select("account", "id", "ids")


@add("grp_thread", f"WITH {BASE} SELECT DISTINCT ON (account, folder) account, folder, id FROM scored ORDER BY account, folder, {BEST}")
def grp_thread(spark, d):
    return r.one_for_each(r.scored(live_messages(spark, d), TERMS, NOW), "account", "folder").select("account", "folder", "id")


@add("vec_knn", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20""")
def vec_knn(spark, d):
    """Exact cosine search of one vector, given as a literal."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = F.lit(e.filter("vec_id = 0").head()["v"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("v"), q) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(q, q))
    return e.filter("vec_id <> 0").withColumn("s", score).orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("score"))


#: The prior of a row, as scr_prior has it.
PRIOR = f"greatest(0.2::DOUBLE, least(4.0::DOUBLE, 1 + 0.5::DOUBLE * list_contains(coalesce(flags, []), '\\Flagged')::INT + 0.3::DOUBLE * (NOT list_contains(coalesce(flags, []), '\\Seen'))::INT - 0.7::DOUBLE * {LISTISH}::INT))"
STOP = "[" + ", ".join(f"'{w}'" for w in r.STOPWORDS) + "]"


@add("ord_relevance", f"WITH {BASE}, z AS (SELECT *, round(text_rel * {PRIOR}, 9) AS relevance FROM scored) SELECT id, relevance FROM z ORDER BY is_primary DESC, relevance DESC, date DESC, id DESC LIMIT 25")
def ord_relevance(spark, d):
    """By text and prior, without recency."""
    s = r.scored(live_messages(spark, d), TERMS, NOW)
    return s.orderBy(F.desc("is_primary"), F.desc("relevance"), F.desc("date"), F.desc("id")).limit(25).select("id", "relevance")


@add("exp_significant", f"WITH t AS (SELECT conv_id, turn, {TOK.format('text')} AS w FROM conversations) SELECT conv_id, turn, array_to_string(w2[1:8], ' ') AS terms FROM (SELECT conv_id, turn, list_filter(list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({STOP}, x)), lambda x, i: list_position(list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({STOP}, x)), x) = i) AS w2 FROM t)")
def exp_significant(spark, d):
    """Words of a free text that are worth a search by similar spelling."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(r.significant_tokens(F.col("text")), " ").alias("terms"))


@add("fts_header_doc", f"""WITH {SQL}, w AS (SELECT id, [{{'w': x, 'k': 'A'}} for x in {TOK.format('subject[1:32768]')} if NOT list_contains({STOP}, x)] AS a, [{{'w': x, 'k': 'B'}} for x in {TOK.format("concat_ws(' ', from_name, from_email)")} if NOT list_contains({STOP}, x)] AS b,
[{{'w': x, 'k': 'C'}} for x in {TOK.format("concat_ws(' ', array_to_string(to_emails, ' '), array_to_string(list_filter(cc_emails, lambda x: x IS NOT NULL), ' '))")} if NOT list_contains({STOP}, x)] AS c FROM m)
SELECT id, array_to_string([x.w || ':' || x.k for x in list_concat(a, b, c)], ' ') AS words FROM w""")
def fts_header_doc(spark, d):
    """Words of the header fields with their weights."""
    words = F.transform(r.weighted_head(), lambda x: F.concat_ws(":", x["word"], x["weight"]))
    return live_messages(spark, d).select("id", F.array_join(words, " ").alias("words"))


@add("fts_rank", f"""WITH {SQL}, t AS (SELECT id, {TOK.format('body')} AS w FROM m), h AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t), g AS (SELECT id, pos, word IN ('der', 'the') AS a FROM h WHERE word IN ('der', 'the', 'und', 'of')),
s AS (SELECT id, pos, max(pos) FILTER (WHERE a) OVER o AS la, max(pos) FILTER (WHERE NOT a) OVER o AS lb FROM g WINDOW o AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT id, pos, least(la, lb) AS st FROM s WHERE la IS NOT NULL AND lb IS NOT NULL), k AS (SELECT *, lag(st) OVER (PARTITION BY id ORDER BY pos) AS b FROM c),
x AS (SELECT id, sum(1.0::DOUBLE / (pos - st + 1)) AS density FROM k WHERE b IS NULL OR st > b GROUP BY id) SELECT id, round(density / len(w), 9) AS rank FROM x JOIN t USING (id)""")
def fts_rank(spark, d):
    """Cover density of the body, by its number of words."""
    t = r.once(live_messages(spark, d).select("id", "body"), words=r.tokens(F.col("body"))).select("id", "words")
    return r.covers(t, TERMS).join(t, "id").select("id", F.round(F.col("density") / F.size("words"), 9).alias("rank"))


FUZZY = ("theing", "usser", "newslettr")
FIELDS = f"""f AS (SELECT id, 'subject' AS field, {TOK.format('substr(subject, 1, 80)')} AS w FROM m UNION ALL SELECT id, 'from_name', {TOK.format('from_name')} FROM m UNION ALL SELECT id, 'from_email', {TOK.format('from_email')} FROM m
  UNION ALL SELECT id, 'recipients', {TOK.format("concat_ws(' ', array_to_string(to_emails, ' '), array_to_string(list_filter(cc_emails, lambda x: x IS NOT NULL), ' '))")} FROM m),
q AS (SELECT term, list_distinct([substr('  ' || term || ' ', i, 3) for i in range(1, length(term) + 2)]) AS q FROM (SELECT unnest([{', '.join(f"'{t}'" for t in FUZZY)}]) AS term)),
g AS (SELECT id, field, flatten([[substr('  ' || x || ' ', i, 3) for i in range(1, length(x) + 2)] for x in w]) AS t FROM f),
n AS (SELECT id, field, term, coalesce(list_max([list_max([len(list_intersect(list_distinct(t[i:j]), q))::DOUBLE / (len(q) + len(list_distinct(t[i:j])) - len(list_intersect(list_distinct(t[i:j]), q))) for j in range(i, len(t) + 1) if list_contains(q, t[j])]) for i in range(1, len(t) + 1) if list_contains(q, t[i])]), 0) AS near FROM g, q)"""


def spelling_index(spark, d):
    """The index of all header fields; subjects are the first eighty characters."""
    people = F.concat_ws(" ", F.array_join("to_emails", " "), F.array_join("cc_emails", " "))
    named = {"subject": F.substring("subject", 1, 80), "from_name": F.col("from_name"), "from_email": F.col("from_email"), "recipients": people}
    index = SpellingIndex(spark, f"{shared_dir(spark)}/spelling-{uuid.uuid4().hex}")
    index.build(live_messages(spark, d).select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in named.items()]))))
    return index


@add("rec_fuzzy", f"WITH {SQL}, {FIELDS} SELECT id, field, term, round(near, 6) AS near FROM n WHERE near >= 0.4")
def rec_fuzzy(spark, d):
    """Fields with words that are spelt like a significant term, by an index of three-letter parts."""
    return spelling_index(spark, d).search(r.significant(("the", *FUZZY))).select("id", "field", "term", F.round("near", 6).alias("near"))


@add("rec_fuzzy_score", f"WITH {SQL}, {FIELDS} SELECT id, round(0.3::DOUBLE * max(near) FILTER (WHERE field IN ('subject', 'from_name')), 9) AS score FROM n WHERE id IN (SELECT id FROM n WHERE near >= 0.4) GROUP BY id")
def rec_fuzzy_score(spark, d):
    """What recall by spelling adds to the text score: the most that the subject or the sender's name is like a term, for rows that any field recalls."""
    index = spelling_index(spark, d)
    found = index.scores(stage(index.search(FUZZY).select("id").distinct()), FUZZY, ("subject", "from_name"))
    return found.select("id", F.round(0.3 * F.col("score"), 9).alias("score"))


def text_index(spark, d):
    """Postings of all live messages."""
    index = TextIndex(spark, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}")
    index.build(live_messages(spark, d), F.concat_ws(" ", "subject", "from_name", "from_email", F.array_join("to_emails", " ")), F.col("body"))
    return index


@add("fts_postings", f"WITH {BASE} SELECT id, round(h, 9) AS head, round(b, 9) AS body FROM y")
def fts_postings(spark, d):
    """Ranks of header and body from the postings of the words that are looked for; the same as a scan of all texts gives."""
    return text_index(spark, d).ranks(TERMS).select("id", F.round("head", 9).alias("head"), F.round("body", 9).alias("body"))


@add("fts_best", f"WITH {BASE} SELECT id, text_rel FROM y WHERE is_primary ORDER BY text_rel DESC, id DESC LIMIT 25")
def fts_best(spark, d):
    """The best by text alone; blocks of messages whose bound is too low are not scored."""
    return text_index(spark, d).best(TERMS, 25)


@add("scr_listish", f"WITH {SQL} SELECT id, id % 9 = 0 OR id % 14 = 0 OR regexp_matches(lower(CASE WHEN id % 8 = 0 THEN 'Newsletter@host.example' ELSE from_email END), '^(newsletter|marketing|mailer)@') AS listish FROM m")
def scr_listish(spark, d):
    """Mail of lists, by headers or sender."""
    i = F.col("id")
    none = F.create_map().cast("map<string,string>")
    headers = F.when(i % 9 == 0, F.create_map(F.lit("list-id"), F.lit("<x>"))).when(i % 14 == 0, F.create_map(F.lit("list-unsubscribe"), F.lit("<y>"))).when(i % 2 == 0, none)
    sender = F.when(i % 8 == 0, F.lit("Newsletter@host.example")).otherwise(F.col("from_email"))
    return live_messages(spark, d).select("id", r.listish(headers, sender).alias("listish"))


@add("rnk_null_score", f"WITH {BASE} SELECT id, 'smart' AS sorted_by, score FROM scored UNION ALL SELECT id, 'recent', NULL FROM scored UNION ALL SELECT id, 'smart without words', NULL FROM scored")
def rnk_null_score(spark, d):
    """The score is shown only where it ranked."""
    s = r.scored(live_messages(spark, d), TERMS, NOW)
    shown = lambda name, order, words: s.select("id", F.lit(name).alias("sorted_by"), r.shown_score(order, words, F.col("score")).alias("score"))
    return shown("smart", "smart", TERMS.words).union(shown("recent", "recent", TERMS.words)).union(shown("smart without words", "smart", ()))


CUT = r"(?i)(?:[^\s]+\s+){0,6}\b(?:the|of)\b(?:\s+[^\s]+){0,6}"


@add("snp_headline", f"WITH {SQL}, p AS (SELECT id, body FROM m WHERE contains(body, ' the ') ORDER BY date DESC, id DESC LIMIT 25) SELECT id, array_to_string([regexp_replace(x, '(?i)\\b(the|of)\\b', '<mark>\\1</mark>', 'g') for x in regexp_extract_all(body, '{CUT}')[1:2]], ' ... ') AS snippet FROM p")
def snp_headline(spark, d):
    """Two fragments around hits, for the rows of a page only."""
    page = live_messages(spark, d).filter(F.contains("body", F.lit(" the "))).orderBy(F.desc("date"), F.desc("id")).limit(25)
    return page.select("id", r.marked(F.col("body"), ("the", "of")).alias("snippet"))


@add("flt_bcc", f"WITH {SQL} SELECT id FROM m WHERE contains(lower('hidden' || (id % 4) || '@host.example'), 'hidden3')")
def flt_bcc(spark, d):
    bcc = F.array(F.concat(F.lit("Hidden"), (F.col("id") % 4).cast("string"), F.lit("@host.example")))
    return live_messages(spark, d).withColumn("bcc_emails", bcc).filter(F.contains(F.lower(F.array_join("bcc_emails", " ")), F.lit("hidden3"))).select("id")


@add("flt_has_body", f"WITH {SQL}, l AS (SELECT DISTINCT doc_id FROM labels) SELECT id, doc_id IS NOT NULL AS has_body FROM m LEFT JOIN l ON doc_id = id")
def flt_has_body(spark, d):
    """Whether a body was fetched; the labelled documents stand for those."""
    fetched = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("fetched")).distinct()
    return live_messages(spark, d).join(fetched, "id", "left").select("id", F.col("fetched").isNotNull().alias("has_body"))
