"""Document statistics and domain classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.operators import corpus
from tablecraft.operators.taxonomies import DOMAIN_CORPORA, DOMAIN_KEYWORDS, FALLBACK_KEYWORDS, STOP_WORDS
from tablecraft.plans.catalogue.registry import query, r, rounded

# White space of every script, spelled out for engines whose \s is ASCII.
WS = "[\\s\\x{0B}\\x{85}\\x{A0}\\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def pieces_sql(separator: str, c: str = "text") -> str:
    """List of stripped non-empty pieces."""
    return f"list_filter(list_transform(string_split({c}, {separator}), lambda p: {strip_sql('p')}), lambda p: p <> '')"


PARAGRAPHS = pieces_sql("chr(10) || chr(10)")
LINES = pieces_sql("chr(10)")


@query("td01_counts", f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS INT) AS words,
  CAST(length(text) AS INT) AS characters, CAST(len({PARAGRAPHS}) AS INT) AS paragraphs FROM documents""")
def _(t):
    return t.wide("documents").select("doc_id", corpus.word_count("text").alias("words"), F.length("text").alias("characters"),
                                 F.size(corpus.paragraphs("text")).alias("paragraphs"))


@query("td02_headings", f"""SELECT doc_id, list_filter({LINES}, lambda l: length(l) < 80 AND (regexp_matches(l, '{corpus.RX_HEADING}') OR (upper(l) = l AND lower(l) <> l))) AS headings FROM documents""")
def _(t):
    return t.wide("documents").select("doc_id", corpus.headings("text").alias("headings"))


@query("td03_figures", f"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '{corpus.RX_FIGURE}', 1) AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM f),
g AS (SELECT doc_id, v, min(i) AS i FROM u GROUP BY 1, 2),
h AS (SELECT doc_id, list(v ORDER BY i) AS a FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(a, CAST([] AS VARCHAR[])) AS figures FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def _(t):
    return t.wide("documents").select("doc_id", corpus.figures("text").alias("figures"))


@query("td04_definitions", f"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '{corpus.RX_DEFINITION}', 1) AS a, regexp_extract_all(text, '{corpus.RX_DEFINITION}', 2) AS b FROM documents),
u AS (SELECT doc_id, unnest(a) AS term, unnest(b) AS definition, generate_subscripts(a, 1) AS i FROM x)
SELECT doc_id, CAST(i - 1 AS INT) AS place, {strip_sql('term')} AS term, {strip_sql('definition')} AS definition FROM u""")
def _(t):
    found = t.wide("documents").select("doc_id", F.posexplode(corpus.definitions("text")).alias("place", "d"))
    return found.select("doc_id", "place", "d.term", "d.definition")


@query("td05_summary", f"""SELECT doc_id, substr(array_to_string(list_slice({PARAGRAPHS}, 1, 4), ' '), 1, 800) AS summary, array_to_string(list_slice({PARAGRAPHS}, 1, 3), ' ') AS short FROM documents""")
def _(t):
    return t.wide("documents").select("doc_id", corpus.summary("text").alias("summary"), corpus.summary("text", 3, None).alias("short"))


@query("td06_takeaways", f"""SELECT doc_id, list_transform(list_slice({PARAGRAPHS}, 1, 5), lambda p: substr(p, 1, 160) || '...') AS takeaways FROM documents""")
def _(t):
    return t.wide("documents").select("doc_id", corpus.takeaways("text").alias("takeaways"))


@query("td07_title", f"""SELECT conv_id, turn, {LINES}[1] AS title FROM conversations""")
def _(t):
    return t.wide("conversations").select("conv_id", "turn", corpus.title("text").alias("title"))


# TF-IDF ----------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_CORPORA = ", ".join(f"('{d}', '{words}')" for d, words in DOMAIN_CORPORA.items())


def _terms_sql(name: str, key: str, source: str) -> str:
    """CTE ``name``: key, term, tf of words and neighbouring pairs."""
    return f"""{name}_w AS (SELECT {key}, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '{corpus.RX_TOKEN}'), lambda w: w NOT IN ({_STOP})) AS a FROM {source})),
{name}_t AS (SELECT {key}, w AS term FROM {name}_w UNION ALL SELECT {key}, term FROM (SELECT {key}, w || ' ' || lead(w) OVER (PARTITION BY {key} ORDER BY i) AS term FROM {name}_w) WHERE term IS NOT NULL),
{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_t GROUP BY 1, 2)"""


_TFIDF = f"""WITH corpora(domain, text) AS (VALUES {_CORPORA}), {_terms_sql('ct', 'domain', 'corpora')}, {_terms_sql('dt', 'doc_id', 'documents')},
idf AS (SELECT term, ln((1 + 7) / (1.0 + count(*))) + 1 AS idf FROM ct GROUP BY 1),
cw AS (SELECT domain, term, (1 + ln(tf)) * idf AS w FROM ct JOIN idf USING (term)),
cn AS (SELECT domain, term, w / sqrt(sum(w * w) OVER (PARTITION BY domain)) AS w FROM cw),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM dt JOIN idf USING (term)),
nd AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
sc AS (SELECT dw.doc_id, domain, sum(dw.w * cn.w) / any_value(norm) AS s FROM dw JOIN cn USING (term) JOIN nd ON nd.doc_id = dw.doc_id GROUP BY 1, 2)"""


@query("td08_domain_scores", f"{_TFIDF} SELECT doc_id, domain, {r('s', 6)} AS similarity FROM sc")
def _(t):
    return rounded(corpus.domain_scores(t.wide("documents"), "text", "doc_id"), 6)


@query("td08_classify_domain", f"""{_TFIDF}, best AS (SELECT doc_id, arg_max(domain, (round(s, 12), domain)) AS domain, max(s) AS s FROM sc GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(s, 0) > 0.03 THEN domain ELSE 'generic' END AS domain, {r('coalesce(s, 0)', 6)} AS similarity,
  CAST(CASE WHEN coalesce(s, 0) > 0.03 THEN least(99, greatest(68, floor(s * 180) + 40)) ELSE 60 END AS INT) AS confidence FROM documents d LEFT JOIN best USING (doc_id)""")
def _(t):
    return rounded(corpus.classify_domain(t.wide("documents"), "text", "doc_id"), 6)


@query("td08_matched_terms", f"""{_TFIDF}, k AS (SELECT doc_id, term, round(w, 9) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rank FROM dw)
SELECT doc_id, CAST(rank AS INT) AS rank, term, {r('w', 6)} AS weight FROM k WHERE rank <= 6""")
def _(t):
    return rounded(corpus.matched_terms(t.wide("documents"), "text", "doc_id"), 6)


# Keywords --------------------------------------------------------------------------------------------

_KEYWORDS = ", ".join(f"({i}, '{d}', '{w.replace('_', ' ')}')" for i, (d, words) in enumerate(DOMAIN_KEYWORDS.items()) for w in words)


@query("td09_keyword_domains", f"""WITH k(place, domain, w) AS (VALUES {_KEYWORDS}),
s AS (SELECT concat('conversation_', CAST(conv_id AS VARCHAR), '_', CAST(turn AS VARCHAR)) AS dataset, list_filter(string_split(text, ' '), lambda w: w <> '') AS columns FROM conversations),
c AS (SELECT dataset, regexp_replace(lower(dataset), '[-_]', ' ', 'g') AS name, list_transform(columns, lambda c: regexp_replace(lower(c), '[-_]', ' ', 'g')) AS cols FROM s),
p AS (SELECT dataset, place, domain, list_sum(list_transform(cols, lambda c: CASE WHEN c = w THEN 4.0 WHEN contains(c, w) OR contains(w, c) THEN 2.0 ELSE 0.0 END)) AS hits,
  CASE WHEN contains(name, w) THEN 3.0 ELSE 0.0 END + CASE WHEN contains(name || ' ' || array_to_string(cols, ' '), w) THEN 0.5 ELSE 0.0 END AS extra FROM c, k),
g AS (SELECT dataset, place, domain, sum(CAST(coalesce(hits, 0) + extra AS DOUBLE)) AS score FROM p GROUP BY 1, 2, 3),
b AS (SELECT dataset, domain, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, place) AS i FROM g)
SELECT dataset, CASE WHEN score < 2 THEN 'general' ELSE domain END AS domain, {r('score')} AS score, CAST(CASE WHEN score < 2 THEN 60 ELSE least(98, round(50 + score * 5)) END AS INT) AS confidence FROM b WHERE i = 1""")
def _(t):
    schemas = t.wide("conversations").select(
        F.concat_ws("_", F.lit("conversation"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("dataset"),
        F.filter(F.split("text", " "), lambda w: w != "").alias("columns"))
    return rounded(corpus.keyword_domains(schemas))


_HITS = ", ".join(" + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words) + f" AS {d}" for d, words in FALLBACK_KEYWORDS.items())
_NAMES = list(FALLBACK_KEYWORDS)


@query("td10_substring_domain", f"""WITH h AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, lower(text) AS x FROM documents)),
g AS (SELECT *, greatest({", ".join(_NAMES)}) AS hits FROM h)
SELECT doc_id, CASE WHEN hits = 0 THEN 'generic' {" ".join(f"WHEN {d} = hits THEN '{d}'" for d in _NAMES)} END AS domain, CAST(hits AS INT) AS hits FROM g""")
def _(t):
    return corpus.substring_domain(t.wide("documents"), "text", "doc_id")


@query("td00_document_profile", f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS INT) AS words,
  CAST(length(text) AS INT) AS characters, CAST(len({PARAGRAPHS}) AS INT) AS paragraphs, {LINES}[1] AS title, substr(array_to_string(list_slice({PARAGRAPHS}, 1, 4), ' '), 1, 800) AS summary,
  CAST(len(list_filter({LINES}, lambda l: length(l) < 80 AND (regexp_matches(l, '{corpus.RX_HEADING}') OR (upper(l) = l AND lower(l) <> l)))) AS INT) AS headings,
  CAST(len(list_distinct(regexp_extract_all(text, '{corpus.RX_FIGURE}', 1))) AS INT) AS figures,
  CAST(len(regexp_extract_all(text, '{corpus.RX_DEFINITION}', 1)) AS INT) AS definitions FROM documents""")
def _(t):
    out = corpus.document_profile(t.wide("documents"), "text", ["doc_id"])
    return out.select("doc_id", "words", "characters", "paragraphs", "title", "summary", F.size("headings").alias("headings"),
                      F.size("figures").alias("figures"), F.size("definitions").alias("definitions"))
