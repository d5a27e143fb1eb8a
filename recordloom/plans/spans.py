"""Queries: words split into parts, and spans of them that may be names, with their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.functions import words as W
from recordloom.plans.tables import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_NEXT = lambda c, last: "[" + ", ".join(f"lead({c}, {k}) OVER o" for k in range(last + 1)) + "]"
_PREFIX = lambda c: f"coalesce({c} IN {_IN(W.TITLE_PREFIXES)} OR lower({c}) IN {_IN((*W.OCCUPATIONS, *W.PREFIX_VERBS))}, FALSE)"
_TAGGED = r"""
SELECT doc_id, i, CASE WHEN i % 9 = 0 THEN '<pname>' || w || '</pname>' ELSE w END AS w
FROM (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS i
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS words FROM documents))
"""
_CAPITALISED = rf"(regexp_matches(u, '\p{{Lu}}') OR u IN {_IN(W.PARTICLES)} OR (starts_with(u, '''') AND u <> '''s'))"
_MARKS = rf"""(CASE WHEN u IN {_IN(W.PUNCTUATION_TITLES)} THEN '2'
  WHEN regexp_matches(u, '[[:punct:]]') AND regexp_matches(u, '\p{{Lu}}') AND (regexp_full_match(u, '\p{{L}}[^-]*-[^-]*\p{{L}}') OR length(u) - length(replace(u, '''', '')) = 1) THEN '3'
  WHEN regexp_matches(translate(u, '.-''', ''), '[[:punct:]]') THEN '1' ELSE '0' END)"""
_POS = r"""(CASE WHEN regexp_matches(u, '^\p{Lu}') THEN 'NNP' WHEN ends_with(u, 'ing') THEN 'VBG' WHEN ends_with(u, 'ed') THEN 'VBD'
  WHEN regexp_matches(u, '(ous|ful|ive|able|al)$') THEN 'JJ' WHEN ends_with(u, 'ly') THEN 'RB' ELSE 'NN' END)"""
#: Distinct words are split step by step: what stays whole, or the letters before a mark, the mark, and the rest.
_DOCS = rf"""
tagged AS ({_TAGGED}),
split AS (
  SELECT w, w AS rest, []::VARCHAR[] AS parts FROM (SELECT DISTINCT w FROM tagged)
  UNION ALL
  SELECT w,
    CASE WHEN take > 0 THEN substr(rest, take + 1) WHEN possessive THEN '' ELSE substr(rest, f + 2) END,
    list_concat(parts, list_filter(CASE WHEN take > 0 THEN [substr(rest, 1, take)] WHEN possessive THEN [substr(rest, 1, f), substr(rest, f + 1)] ELSE [substr(rest, 1, f), c] END, lambda x: x <> ''))
  FROM (SELECT *, c = '''' AND length(rest) > 2 AND ends_with(rest, 's') AS possessive,
      CASE WHEN length(rest) < 2 OR f = length(rest) OR regexp_full_match(rest, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN length(rest)
        WHEN regexp_full_match(rest, '\p{{L}}[^-]*-[^-]*\p{{L}}') AND regexp_matches(rest, '\p{{Lu}}') THEN length(rest)
        WHEN starts_with(rest, '<pname>') THEN CASE WHEN p = 0 THEN length(rest) ELSE p + 7 END
        WHEN p > 0 THEN p + 7
        WHEN c = '.' AND (rest IN {_IN(W.PUNCTUATION_TITLES)} OR rest = 'U.S.' OR (length(rest) = 2 AND regexp_matches(rest, '^\p{{Lu}}'))) THEN length(rest)
        WHEN c = '''' AND NOT (length(rest) > 2 AND ends_with(rest, 's')) THEN length(rest)
        ELSE 0 END AS take
    FROM (SELECT *, substr(rest, f + 1, 1) AS c FROM (SELECT *, length(regexp_extract(rest, '^[\p{{L}}\p{{N}}]*')) AS f, strpos(rest, '</pname>') AS p FROM split WHERE rest <> '')))
), docs AS (
  SELECT doc_id, flatten(list(parts ORDER BY i)) AS raws, string_agg(tagged.w, ' ' ORDER BY i) AS text
  FROM tagged JOIN split ON split.w = tagged.w AND split.rest = '' GROUP BY doc_id
)"""
_SPANS = rf"""{_DOCS}, tokens AS (
  SELECT doc_id, pos, raw, u, {_CAPITALISED} AS cap, {_MARKS} AS mark, {_POS} AS tag
  FROM (SELECT *, regexp_replace(raw, '</?pname>', '', 'g') AS u FROM (SELECT doc_id, unnest(raws) AS raw, unnest(range(0, len(raws))) AS pos FROM docs))
), near AS (
  SELECT doc_id, pos, {_NEXT("raw", 3)} AS raws, {_NEXT("u", 5)} AS us, {_NEXT("cap", 5)} AS caps, {_NEXT("mark", 3)} AS marks, {_NEXT("tag", 4)} AS tags,
    lag(u, 1) OVER o AS b, lag(u, 2) OVER o AS b2, lag(cap, 2) OVER o AS b2_cap, lag(tag, 1) OVER o AS b_tag
  FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), runs AS (
  SELECT *, us[1:n] AS own, array_to_string(us[1:n], ' ') AS string, array_to_string(raws[1:n], ' ') AS tagged_string, array_to_string(marks[1:n], '') AS marked,
    us[n + 1] AS a, us[n + 2] AS a2, caps[n + 2] AS a2_cap, tags[n + 1] AS a_tag
  FROM near, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE us[n] IS NOT NULL AND len(list_filter(caps[1:n], lambda c: NOT c)) = 0
), candidates AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, n) - 1 AS string_id FROM runs
  WHERE (us[n] IN {_IN(W.NAME_SUFFIXES)} OR NOT regexp_matches(marked, '^[01]*2|^[01]*1[01]*$')) AND string NOT IN {_IN(W.COMMON_WORDS)}
    AND lower(string) NOT IN {_IN([w.lower() for w in (*W.ORGANISATIONS, *W.CLUBS, *W.LOCATIONS)])}
)"""
_FIRST = "SELECT DISTINCT string_split(text, ' ')[1] AS word FROM benchmark"
_ALL = r"SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS word FROM benchmark"
_HITS = lambda names: f"(SELECT DISTINCT doc_id, string_id FROM (SELECT doc_id, string_id, unnest(own) AS word FROM candidates) JOIN ({names}) USING (word))"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as marked-up ones: one word in nine is tagged as a name."""
    words = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    marked = F.transform("words", lambda w, i: F.when(i % 9 == 0, F.concat(F.lit(T.START), w, F.lit(T.END))).otherwise(w))
    return words.select("doc_id", F.array_join(marked, " ").alias("text"))


@query(f"WITH RECURSIVE {_DOCS} SELECT doc_id, array_to_string(raws, ' ') AS parts, len(raws)::INTEGER AS n FROM docs")
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tagged(spark, sf_dir).select("doc_id", T.split_tokens(F.col("text")).alias("parts"))
    return found.select("doc_id", F.array_join("parts", " ").alias("parts"), F.size("parts").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS word FROM documents),
m AS (SELECT *, length(regexp_extract(word, '^[\p{L}\p{N}]*')) AS first, length(word) - length(replace(word, '-', '')) AS hyphens, length(word) - length(replace(word, chr(39), '')) AS apostrophes FROM w)
SELECT doc_id, count(*) AS n, sum(CASE WHEN first < length(word) THEN first END)::BIGINT AS before_marks, sum(hyphens)::BIGINT AS hyphens, sum(apostrophes)::BIGINT AS apostrophes FROM m GROUP BY doc_id""")
def word_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(T.first_mark(w)).cast("bigint").alias("before_marks"), F.sum(T.times(w, "-")).cast("bigint").alias("hyphens"), F.sum(T.times(w, "'")).cast("bigint").alias("apostrophes"))


@query(f"WITH RECURSIVE {_SPANS} SELECT doc_id, n::INTEGER AS n_words, count(*) AS n, count(DISTINCT string) AS n_distinct, max(string_id)::INTEGER AS last_id FROM candidates GROUP BY 1, 2")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.candidates(_tagged(spark, sf_dir), "doc_id", features=())
    return found.groupBy("doc_id", (F.col("end_index") - F.col("start_index")).alias("n_words")).agg(F.count("*").alias("n"), F.count_distinct("string").alias("n_distinct"), F.max("string_id").alias("last_id"))


@query(rf"""WITH RECURSIVE {_SPANS}, named AS ({_FIRST}), f AS {_HITS(_FIRST)}, l AS {_HITS(_ALL)}, g AS {_HITS("SELECT n_name AS word FROM nation")}
SELECT string_id::INTEGER AS string_id, string, 'd' || doc_id || '.txt' AS filename, doc_id AS "documentID", pos::INTEGER AS start_index, (pos + n)::INTEGER AS end_index,
  ((length(d.text) - length(replace(d.text, string, ''))) / length(string))::INTEGER AS frequency,
  ({_PREFIX("b")} OR {_PREFIX("b2")})::INTEGER AS prefixed,
  (coalesce(lower(a) IN {_IN(W.FOLLOWERS)}, FALSE) OR coalesce(lower(a2) IN {_IN(W.FOLLOWERS)}, FALSE))::INTEGER AS suffixed,
  (string IN (SELECT word FROM named) OR (b IS NOT NULL AND a IS NOT NULL
    AND (lower(b) IN {_IN(W.PLACE_BEFORE)} OR lower(a) IN {_IN(W.PLACE_AFTER)} OR len(list_filter(own, lambda x: lower(x) IN {_IN(W.PLACE_WORDS)})) > 0)))::INTEGER AS "otherEntity",
  (coalesce(regexp_matches(b[1:1], '\p{{Lu}}') AND NOT {_PREFIX("b")}, FALSE) OR coalesce(regexp_matches(a[1:1], '\p{{Lu}}'), FALSE))::INTEGER AS near_capitalized,
  (us[n] IN {_IN(W.NAME_SUFFIXES)})::INTEGER AS name_suffix,
  (len(list_filter(own, lambda x: x IN {_IN(W.COMMON_WORDS)})) > 0)::INTEGER AS common_word,
  (CASE WHEN (doc_id, string_id) IN (SELECT (doc_id, string_id) FROM f) THEN 2 ELSE 0 END)::INTEGER AS first_name,
  (CASE WHEN (doc_id, string_id) IN (SELECT (doc_id, string_id) FROM l) THEN 2 ELSE 0 END + CASE WHEN (doc_id, string_id) IN (SELECT (doc_id, string_id) FROM g) THEN 2 ELSE 0 END)::INTEGER AS actor_legislator_name,
  (b IS NOT NULL AND a IS NOT NULL AND ((b IN {_IN(W.LIST_WORDS)} AND coalesce(b2_cap, FALSE)) OR (a IN {_IN(W.LIST_WORDS)} AND coalesce(a2_cap, FALSE))))::INTEGER AS in_name_list,
  (coalesce(b IN ('(', ')'), FALSE) OR coalesce(a IN ('(', ')'), FALSE))::INTEGER AS near_parentheses,
  (starts_with(coalesce(b_tag, ''), 'VB') OR starts_with(coalesce(a_tag, ''), 'VB'))::INTEGER AS near_verb,
  (starts_with(coalesce(b_tag, ''), 'JJ') OR starts_with(coalesce(a_tag, ''), 'JJ'))::INTEGER AS near_adj,
  (len(list_filter(tags[1:n], lambda x: x <> 'NNP')) = 0)::INTEGER AS is_proper_noun,
  (starts_with(tagged_string, '<pname>') AND strpos(tagged_string, '</pname>') > 1 AND strpos(tagged_string, '</pname>') + 7 = length(tagged_string))::INTEGER AS class_label
FROM candidates JOIN docs d USING (doc_id)""")
def span_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 columns of every candidate."""
    lines = table(spark, sf_dir, "benchmark").select(F.col("text").alias("value"))
    firsts = lines.select(F.get(F.split("value", " "), 0).alias("value"))
    people = {"first_name": T.gazetteer_words(firsts, "line"), "_actor": T.gazetteer_words(lines, "all"), "_legislator": table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"))}
    found = T.gazetteer_flags(T.candidates(_tagged(spark, sf_dir), "doc_id"), people, ["doc_id", "string_id"])
    return T.title_flags(found, T.gazetteer_words(firsts, "line")).select(
        "string_id", "string", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("doc_id").alias("documentID"), "start_index", "end_index", "frequency",
        "prefixed", "suffixed", F.col("other_entity").alias("otherEntity"), "near_capitalized", "name_suffix", "common_word", "first_name", (F.col("_actor") + F.col("_legislator")).alias("actor_legislator_name"),
        "in_name_list", "near_parentheses", "near_verb", "near_adj", "is_proper_noun", "class_label",
    )


@query(f"WITH RECURSIVE {_SPANS}, l AS {_HITS(_ALL)} SELECT doc_id, count(*) AS n, (2 * count(l.string_id))::BIGINT AS flags FROM candidates LEFT JOIN l USING (doc_id, string_id) GROUP BY doc_id")
def gazetteer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.gazetteer_words(table(spark, sf_dir, "benchmark"), "all", "text")
    found = T.candidates(_tagged(spark, sf_dir), "doc_id", features=()).select("doc_id", "string_id", "string")
    return T.gazetteer_flags(found, {"listed": words}, ["doc_id", "string_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("listed").cast("bigint").alias("flags"))
