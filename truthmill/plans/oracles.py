"""SQL for the queries of ``truthmill.plans.catalog``, as DuckDB runs it on the same tables.

Written apart from the Spark expressions, from the definitions: the SQL unnests tokens
where Spark works inside arrays, and counts rows where Spark counts array elements.
"""

from __future__ import annotations

from truthmill.functions.html import ENTITIES, INLINE_TAGS
from truthmill.functions.tokens import ARTICLE_RULES, PLURAL_RULES
from truthmill.lexicon import MULTILINGUAL as LEX

ORACLES: dict[str, str] = {}


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# ---- shared pieces ---------------------------------------------------------------------

NEWS = """news AS (
  SELECT d.doc_id, d.text AS content, CAST(l.quality AS DOUBLE) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

HASH = "(('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"
U11 = HASH.format(seed=11)
U12 = HASH.format(seed=12)

SETS = f"""{NEWS},
sets AS (
  SELECT CASE WHEN {U11} < 0.7 THEN 'train' ELSE 'test' END AS dataset, CAST(doc_id AS VARCHAR) AS doc_id, content, label
  FROM news WHERE label = 0
  UNION ALL
  SELECT CASE WHEN {U11} < 0.6 THEN 'train' WHEN {U11} < 0.6 + 0.3 THEN 'test' ELSE 'held_out' END,
         CAST(doc_id AS VARCHAR), content, label
  FROM news WHERE label = 1
  UNION ALL
  SELECT 'validation', concat('turn:', conv_id, ':', turn), text, CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END
  FROM conversations WHERE trim(coalesce(text, '')) <> ''
  UNION ALL
  SELECT 'held_out', concat('item:', item_id), text, 0.0 FROM benchmark WHERE trim(coalesce(text, '')) <> ''
)"""

SPLIT = r"""[\s!,.?;''"]+"""


def split_list(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '{SPLIT}'), lambda t: t <> '')"


def letters(col: str) -> str:
    """Letter runs; the rare one above 255 letters is cut afterwards."""
    return (
        rf"flatten(list_transform(regexp_extract_all({col}, '\p{{L}}+'), "
        "lambda w: CASE WHEN length(w) <= 255 THEN [w] ELSE regexp_extract_all(w, '.{1,255}') END))"
    )


def kept_letters(col: str) -> str:
    return f"list_filter({letters(col)}, lambda t: lower(t) NOT IN {_list(LEX.stop_keeping_pronouns)})"


def unnested(source: str, tokens: str, keys: str, where: str = "true") -> str:
    """One row per token with its position."""
    return (
        f"SELECT {keys}, unnest(t) AS word, generate_subscripts(t, 1) AS pos "
        f"FROM (SELECT {keys}, {tokens} AS t FROM {source} WHERE {where})"
    )


def occurrences(col: str, needle: str) -> str:
    n = needle.replace("'", "''")
    return f"CAST((length({col}) - length(replace({col}, '{n}', ''))) / {len(needle)} AS BIGINT)"


# Word-break tokens: mark each joining character that sits between two letters or two
# digits, twice since neighbouring pairs overlap, then take runs with marked joiners.
_MARK = ""


def word_list(col: str) -> str:
    t = col
    for _ in range(2):
        t = rf"regexp_replace({t}, '([\p{{L}}\p{{M}}])([.:''’])(\p{{L}})', '\1{_MARK}\2\3', 'g')"
        t = rf"regexp_replace({t}, '(\p{{N}})([.,;''’])(\p{{N}})', '\1{_MARK}\2\3', 'g')"
    run = r"[\p{L}\p{M}\p{N}_]+"
    t = rf"regexp_extract_all({t}, '{run}(?:{_MARK}[.,:;''’]{run})*')"
    return f"list_transform({t}, lambda t: replace(t, '{_MARK}', ''))"


def _stem_ctes(source: str, word: str = "word") -> str:
    """CTEs s0 … s5 stemming the word column of a relation; s5 has the stem as ``stem``."""

    def phase(n: int, cases: str) -> str:
        return f"s{n} AS (SELECT * EXCLUDE (stem), CASE WHEN done THEN stem {cases} ELSE stem END AS stem FROM s{n - 1})"

    def rule(low: int, ending: str, cut: int, put: str) -> str:
        return (
            f"WHEN length(stem) >= {low} AND ends_with(stem, '{ending}') "
            f"THEN left(stem, length(stem) - {cut}) || '{put}'"
        )

    def plural(low: int, ending: str, cut: int, put: str) -> str:
        if "?" in ending:
            return (
                f"WHEN length(stem) >= {low} AND right(stem, 1) = 'и' AND left(right(stem, 3), 1) = 'е' "
                f"THEN left(stem, length(stem) - 3) || 'я' || left(right(stem, 2), 1)"
            )
        return rule(low, ending, cut, put)

    return ",\n".join(
        [
            f"""s0 AS (SELECT *, length({word}) < 4 OR (length({word}) >= 6 AND ends_with({word}, 'ища')) AS done,
            CASE WHEN length({word}) >= 6 AND ends_with({word}, 'ища') THEN left({word}, length({word}) - 3)
                 ELSE {word} END AS stem FROM {source})""",
            phase(1, " ".join(rule(*r) for r in ARTICLE_RULES)),
            phase(2, " ".join(plural(*r) for r in PLURAL_RULES)),
            phase(3, "WHEN length(stem) >= 4 THEN regexp_replace(regexp_replace(stem, 'я$', ''), '[аое]$', '')"),
            phase(4, rule(5, "ен", 2, "н")),
            phase(
                5,
                "WHEN length(stem) >= 6 AND left(right(stem, 2), 1) = 'ъ' "
                "THEN left(stem, length(stem) - 2) || right(stem, 1)",
            ),
        ]
    )


NUMBER = (
    r"^-?(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]|[0-9]+[lL])$"
)


def is_number(col: str) -> str:
    return f"regexp_matches(replace({col}, ',', '.'), '{NUMBER}')"


# Terms of the analyzer chain over the marked documents: (doc_id, label, pos, n, term).
# The fixture words have Latin letters, which no stem rule ends with, so the stem steps
# leave them as they are; ``stem_tokens`` checks the rules.
TERMS = f"""{NEWS},
raw AS ({unnested('news', word_list("replace(content, 'br2n', '')"), 'doc_id, label')}),
gapped AS (
  SELECT doc_id, label, pos,
         CASE WHEN length(word) <= 255 AND lower(word) NOT IN {_list(LEX.stop)}
               AND NOT {is_number('lower(word)')} AND length(word) BETWEEN 3 AND 1000
              THEN lower(word) END AS w
  FROM raw
),
ahead AS (
  SELECT doc_id, label, pos, w,
         lead(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS w2,
         lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3
  FROM gapped
),
terms AS (
  SELECT doc_id, label, pos, n, replace(term, ',', '(comma)') AS word FROM (
    SELECT doc_id, label, pos, 1 AS n, w AS term FROM ahead
    UNION ALL SELECT doc_id, label, pos, 2, w || ' ' || w2 FROM ahead
    UNION ALL SELECT doc_id, label, pos, 3, w || ' ' || w2 || ' ' || w3 FROM ahead
  ) WHERE term IS NOT NULL AND NOT contains(term, '_')
),
counts AS (
  SELECT word, count(*) FILTER (label = 0) AS cnt0, count(*) FILTER (label = 1) AS cnt1, count(*) AS cnt
  FROM terms GROUP BY word
),
vocab AS (
  SELECT word, cnt0, cnt1, cnt, CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS idx
  FROM counts WHERE cnt > 10
)"""


def feature_columns(source: str, keys: str) -> str:
    """The ten ratios of a relation with ``content``, by counting its unnested tokens."""
    first, second, plural = _list(LEX.first), _list(LEX.second), _list(LEX.plural)
    return f"""kept AS (SELECT *, {kept_letters('content')} AS k, row_number() OVER () AS rid FROM {source}),
tokens AS (SELECT rid, unnest(k) AS word FROM kept),
tallies AS (
  SELECT rid, count(*) AS n,
    count(*) FILTER (lower(word) IN {_list(LEX.negative)}) AS negative,
    count(*) FILTER (regexp_matches(word, '[А-ЯA-Z]')) AS has_upper,
    count(*) FILTER (regexp_matches(word, '^[А-ЯA-Z]+$')) AS all_upper,
    count(*) FILTER (regexp_matches(word, '^[А-ЯA-Z]')) AS first_upper,
    count(*) FILTER (regexp_matches(word, '^[а-яa-z]+$')) AS all_lower,
    count(*) FILTER (lower(word) IN {first}) AS p1,
    count(*) FILTER (lower(word) IN {second}) AS p2,
    count(*) FILTER (lower(word) IN {plural}) AS pp
  FROM tokens GROUP BY rid
),
features AS (
  SELECT {keys},
    coalesce(negative, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS negative_ratio,
    coalesce(has_upper, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS has_upper_ratio,
    coalesce(all_upper, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS all_upper_ratio,
    coalesce(first_upper, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS first_upper_ratio,
    coalesce(all_lower, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS all_lower_ratio,
    coalesce(p1, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS first_person_ratio,
    coalesce(p2, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS second_person_ratio,
    coalesce(pp, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS plural_pronoun_ratio,
    {occurrences('content', '!')} / greatest(coalesce(n, 0), 1)::DOUBLE AS exclamation_ratio,
    {occurrences('content', '"')} / greatest(coalesce(n, 0), 1)::DOUBLE AS quote_ratio
  FROM kept LEFT JOIN tallies USING (rid)
)"""


def scored(base: str, source: str, keys: str) -> str:
    return f"""WITH {base}, {feature_columns(source, keys)},
scored AS (SELECT {keys}, first_upper_ratio AS score,
  CASE WHEN first_upper_ratio < 0.11 THEN 1.0 ELSE 0.0 END AS prediction FROM features)"""


SCORED_NEWS = scored(NEWS, "news", "doc_id, label")
SCORED_SETS = scored(SETS, "sets", "dataset, doc_id, label")

NORMAL_WORDS = (
    r'''list_filter(string_split(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
  lower({col}), '[;.,!?\(\):''"“”–\\]+', ' ', 'g'), '\s+-\s+', ' ', 'g'), '\s+[0-9]+\s+', ' ', 'g'),
  'br2n', ' '), '\s+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN '''
    + _list(LEX.word_count_stop)
    + ")"
)


def normal_words(col: str) -> str:
    return NORMAL_WORDS.replace("{col}", col)


def markup_text(col: str) -> str:
    """Text of a fragment without comments or scripts."""
    inline = "|".join(INLINE_TAGS)
    t = f"regexp_replace({col}, '</?(?:{inline})(?:[\\s/][^>]*)?>', '', 'gi')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for name, char in ENTITIES.items():
        t = f"replace({t}, '&{name};', '" + char.replace("'", "''") + "')"
    t = f"replace({t}, '&amp;', '&')"
    return f"trim(regexp_replace({t}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"


PAGES = f"""page AS (
  SELECT page_id AS key, url, html,
    {markup_text("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title,
    {markup_text("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")} AS content,
    array_to_string(list_transform(
      regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a[^>]*>(.*?)</a>', 1),
      lambda a: {markup_text('a')}), ',') AS category
  FROM pages
)"""
ARTICLE_URL = r"^https?://[^/]+/(en|fr)/[0-9]+([/?#.].*)?$"

TOKENS_OUT = "len(t)::INT AS n, array_to_string(t, '|') AS tokens"


# ---- sources, sinks and pages -----------------------------------------------------------

ORACLES["page_scan"] = "SELECT page_id, url, html FROM pages"

ORACLES["lexicon_dedup"] = f"""WITH {NEWS},
words AS ({unnested('news', letters('content'), 'doc_id, label')})
SELECT lower(word) AS word, arg_min(label, (doc_id, pos)) AS score FROM words GROUP BY 1"""

ORACLES["page_to_json"] = f"""WITH {PAGES}
SELECT key, CAST(json_object('key', CAST(key AS VARCHAR), 'url', url, 'html', html, 'title', title,
  'content', content, 'category', category, 'viewCount', 0, 'commentCount', 0) AS VARCHAR) AS json FROM page"""

ORACLES["export_features"] = f"""WITH {SETS},
chosen AS (
  SELECT doc_id, content, label FROM sets WHERE dataset IN ('held_out', 'validation')
  UNION ALL SELECT CAST(doc_id AS VARCHAR), content, label FROM news
), {feature_columns('chosen', 'label, doc_id')}
SELECT * FROM features"""

ORACLES["word_count_lines"] = f"WITH {TERMS} SELECT word || ',' || cnt AS line FROM vocab"

ORACLES["jsonl_repair"] = """
WITH lines AS (
  SELECT event_type, CASE WHEN value > 20 THEN left(props, length(props) - 1) ELSE props END AS v FROM events
)
SELECT event_type, count(*) FILTER (json_valid(v)) AS kept, count(*) FILTER (NOT json_valid(v)) AS skipped
FROM lines GROUP BY event_type"""

ORACLES["jsonl_repaired_lines"] = """
WITH lines AS (
  SELECT '{"id":' || event_id || ',"p":' || CASE WHEN value > 20 THEN left(props, length(props) - 1) ELSE props END || '}' AS line FROM events
)
SELECT line FROM lines WHERE json_valid(line)"""

ORACLES["page_url_parts"] = r"""
SELECT page_id,
  regexp_extract(url, '^([a-z]+)://', 1) AS protocol,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  CASE WHEN regexp_matches(url, '^[^#]*\?') THEN regexp_extract(url, '^[^#?]*\?([^#]*)', 1) END AS query,
  CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS ref
FROM pages"""

ORACLES["page_extract"] = f"WITH {PAGES} SELECT key, title, content FROM page"

ORACLES["page_link_list"] = f"WITH {PAGES} SELECT key, category FROM page"

ORACLES["page_article_filter"] = f"""WITH {PAGES}
SELECT key, regexp_matches(url, '{ARTICLE_URL}') AS is_article,
  CASE WHEN regexp_matches(url, '{ARTICLE_URL}') AND content <> '' THEN content ELSE '' END AS content FROM page"""

ORACLES["page_reject_counts"] = f"""WITH {PAGES}
SELECT CASE WHEN contains(url, '#') THEN 'bad_url'
            WHEN NOT regexp_matches(url, '{ARTICLE_URL}') OR content = '' THEN 'no_content'
            ELSE 'ok' END AS outcome, count(*) AS pages
FROM page GROUP BY 1"""

ORACLES["page_write_counts"] = f"""WITH {PAGES}
SELECT count(*) FILTER (url NOT LIKE '%#%' AND regexp_matches(url, '{ARTICLE_URL}') AND content <> '') AS ok,
  count(*) FILTER (contains(url, '#')) AS bad_url,
  count(*) FILTER (NOT contains(url, '#') AND (NOT regexp_matches(url, '{ARTICLE_URL}') OR content = '')) AS no_content,
  0::BIGINT AS bad_date, 0::BIGINT AS bad_count
FROM page"""

ORACLES["publish_date_parse"] = """
SELECT o_orderkey,
  CASE o_orderstatus
    WHEN 'O' THEN strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S')
    WHEN 'F' THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S')
  END AS published
FROM orders"""

ORACLES["view_count_split"] = """
SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS published,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS view_count,
  CAST(0 AS BIGINT) AS comment_count
FROM events"""

# ---- dataset preparation ----------------------------------------------------------------

ORACLES["nonblank_docs"] = "SELECT doc_id, text FROM documents WHERE trim(coalesce(text, '')) <> ''"

ORACLES["labelled_docs"] = f"WITH {NEWS} SELECT doc_id, content, label FROM news WHERE trim(coalesce(content, '')) <> ''"

ORACLES["category_to_label"] = """
SELECT doc_id, lang AS category, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
FROM documents"""

ORACLES["without_source"] = "SELECT doc_id, source FROM documents WHERE source <> 'src0'"

ORACLES["latest_k"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, props
FROM events ORDER BY events.ts DESC NULLS LAST, event_id LIMIT 7061"""

ORACLES["corpus_sample"] = """
SELECT doc_id, text AS content FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 101444"""

ORACLES["weighted_split"] = f"""
SELECT doc_id, CASE WHEN {U11} < 0.7 THEN 0 ELSE 1 END AS two_way,
  CASE WHEN {U11} < 0.6 THEN 0 WHEN {U11} < 0.6 + 0.3 THEN 1 ELSE 2 END AS three_way FROM documents"""

ORACLES["train_test_union"] = f"""WITH {SETS}
SELECT dataset, doc_id, CAST(label AS DOUBLE) AS label, CAST(length(content) AS INT) AS chars FROM sets"""

ORACLES["sorted_corpus"] = "SELECT doc_id, text AS content FROM documents ORDER BY text, doc_id"

ORACLES["delivered_ranges"] = """
WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) - 1 AS idx FROM documents)
SELECT CAST(idx // 1000 AS BIGINT) AS range, arg_min(doc_id, idx) AS first, arg_max(doc_id, idx) AS last, count(*) AS n, true AS in_order
FROM numbered GROUP BY 1"""
ORACLES["token_length"] = f"""
SELECT doc_id, CAST(greatest(len({split_list('text')}), 1) AS DOUBLE) AS length FROM documents"""

# ---- tokens -----------------------------------------------------------------------------


def _token_query(tokens: str) -> str:
    return f"SELECT doc_id, {TOKENS_OUT} FROM (SELECT doc_id, {tokens} AS t FROM documents)"


ORACLES["regex_tokens"] = _token_query(split_list("text"))
ORACLES["stopword_filter"] = _token_query(
    f"list_filter({split_list('text')}, lambda w: w NOT IN {_list(LEX.stop)})"
)
ORACLES["letter_tokens"] = _token_query(letters("text"))
ORACLES["letter_tokens_stop"] = _token_query(kept_letters("text"))
ORACLES["word_tokens"] = _token_query(word_list("text"))
ORACLES["word_normalise"] = _token_query(normal_words("text"))

ORACLES["bigrams"] = f"""
WITH kept AS (
  SELECT doc_id, list_filter({split_list('text')}, lambda w: w NOT IN {_list(LEX.stop)}) AS k FROM documents
),
words AS (SELECT doc_id, unnest(k) AS w, generate_subscripts(k, 1) AS pos FROM kept),
pairs AS (SELECT doc_id, pos, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM words),
grouped AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY pos) AS tokens
            FROM pairs WHERE g IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(tokens, '') AS tokens
FROM documents LEFT JOIN grouped USING (doc_id)"""

ORACLES["number_filter"] = rf"""
WITH words AS (
  SELECT event_id, regexp_split_to_array(event_type || ' ' || replace(CAST(value AS VARCHAR), '.', ',') || ' ' || props,
         '[\s:{{}}]+') AS t FROM events
)
SELECT event_id, array_to_string(list_filter(t, lambda w: w <> '' AND NOT {is_number('w')}), '|') AS kept,
  CAST(len(list_filter(t, lambda w: {is_number('w')})) AS BIGINT) AS numbers
FROM words"""

ORACLES["stem_tokens"] = f"""
WITH cyrillic AS (
  SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувътез') AS c FROM documents
),
words AS (SELECT * FROM ({unnested('cyrillic', letters('c'), 'doc_id')}) WHERE length(word) BETWEEN 3 AND 1000),
{_stem_ctes('words')},
grouped AS (SELECT doc_id, string_agg(stem, '|' ORDER BY pos) AS tokens FROM s5 GROUP BY doc_id)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN grouped USING (doc_id)"""

ORACLES["gap_aware_shingles"] = f"""
WITH words AS ({unnested('documents', split_list('text'), 'doc_id')}),
gapped AS (SELECT doc_id, pos, CASE WHEN word NOT IN {_list(LEX.stop)} THEN word END AS w FROM words),
ahead AS (
  SELECT doc_id, pos, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS w2,
         lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM gapped
),
shingles AS (
  SELECT doc_id, pos, 1 AS n, w AS g FROM ahead
  UNION ALL SELECT doc_id, pos, 2, w || ' ' || w2 FROM ahead
  UNION ALL SELECT doc_id, pos, 3, w || ' ' || w2 || ' ' || w3 FROM ahead
),
grouped AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY pos, n) AS tokens
            FROM shingles WHERE g IS NOT NULL AND NOT contains(g, '_') GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(tokens, '') AS tokens
FROM documents LEFT JOIN grouped USING (doc_id)"""

ORACLES["analyzer_chain"] = f"""WITH {TERMS},
grouped AS (SELECT doc_id, count(*) AS n, string_agg(word, '|' ORDER BY pos, n) AS tokens FROM terms GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(tokens, '') AS tokens
FROM news LEFT JOIN grouped USING (doc_id)"""

ORACLES["bag_of_words"] = f"""
WITH words AS ({unnested('documents', split_list('text'), 'doc_id')})
SELECT doc_id, word, count(*) AS tf FROM words GROUP BY doc_id, word"""

# ---- credibility features ---------------------------------------------------------------

ORACLES["credibility_features"] = f"WITH {NEWS}, {feature_columns('news', 'doc_id, label')} SELECT * FROM features"


def _score_case(scores: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN lower(word) = '{w}' THEN {s}" for w, s in scores.items()) + " ELSE 0.0 END"


ORACLES["credibility_features_extra"] = f"""WITH {NEWS},
words AS ({unnested('news', kept_letters('content'), 'doc_id')}),
tallies AS (
  SELECT doc_id, count(*)::DOUBLE AS n,
    count(*) FILTER (lower(word) IN {_list(LEX.third)}) AS third,
    count(*) FILTER (lower(word) IN {_list(LEX.singular)}) AS singular,
    count(*) FILTER (lower(word) IN {_list(LEX.positive)}) AS positive,
    count(*) FILTER (lower(word) IN {_list(LEX.months)}) AS months,
    count(*) FILTER (regexp_matches(word, '[0-9]')) AS digits,
    sum({_score_case(LEX.positive)}) AS ps, sum({_score_case(LEX.negative)}) AS ns
  FROM words GROUP BY doc_id
)
SELECT doc_id, label,
  coalesce(third / n, 0.0) AS third_person_ratio, coalesce(singular / n, 0.0) AS singular_pronoun_ratio,
  coalesce(positive / n, 0.0) AS positive_ratio, coalesce(months / n, 0.0) AS month_ratio,
  coalesce(digits / n, 0.0) AS digit_ratio,
  CAST(coalesce(ps, 0.0) AS DOUBLE) AS positive_score, CAST(coalesce(ns, 0.0) AS DOUBLE) AS negative_score
FROM news LEFT JOIN tallies USING (doc_id)"""

ORACLES["substring_counts"] = f"""SELECT doc_id,
  {occurrences('text', '!')} AS exclamations, {occurrences('text', '"')} AS quotes,
  {occurrences('text', '„')} AS open_quotes, {occurrences('text', '“')} AS close_quotes,
  {occurrences('text', 'http')} AS links, {occurrences('text', '#')} AS hashes,
  {occurrences('text', "'")} AS apostrophes, {occurrences('text', '?')} AS questions
FROM documents"""

ORACLES["sentiment_scores"] = f"""WITH {NEWS},
marked AS ({unnested('news', letters('content'), 'doc_id, label')}),
scores AS (
  SELECT lower(word) AS word, CASE WHEN arg_min(label, doc_id * 1000000 + pos) > 0 THEN 1.0 ELSE -0.5 END AS score
  FROM marked GROUP BY 1
),
words AS ({unnested('documents', letters('text'), 'doc_id')}),
hits AS (SELECT w.doc_id, s.score FROM words w JOIN scores s ON lower(w.word) = s.word)
SELECT doc_id, CAST(sum(CASE WHEN score > 0 THEN score ELSE 0 END) AS DOUBLE) AS positive_score,
  CAST(sum(CASE WHEN score < 0 THEN -score ELSE 0 END) AS DOUBLE) AS negative_score,
  CAST(count(*) AS BIGINT) AS scored_tokens
FROM hits GROUP BY doc_id"""

# ---- corpus statistics ------------------------------------------------------------------

CORPUS_COUNT = f"""words AS ({unnested('documents', normal_words('text'), 'doc_id')}),
corpus AS (SELECT word, count(*) AS cnt FROM words GROUP BY word)"""

ORACLES["corpus_word_count"] = f"WITH {CORPUS_COUNT} SELECT word, cnt FROM corpus"
ORACLES["top_word"] = f"WITH {CORPUS_COUNT} SELECT word, cnt FROM corpus ORDER BY cnt DESC, word LIMIT 1"
ORACLES["topk_words"] = f"WITH {CORPUS_COUNT} SELECT word, cnt FROM corpus ORDER BY cnt DESC, word LIMIT 50"
ORACLES["class_word_count"] = f"WITH {TERMS} SELECT label, word, count(*) AS cnt FROM terms GROUP BY label, word"
ORACLES["class_count_outer_join"] = f"WITH {TERMS} SELECT word, cnt0, cnt1, cnt FROM counts"
ORACLES["vocabulary_index"] = f"WITH {TERMS} SELECT word, cnt, idx FROM vocab"
ORACLES["vocab_stats"] = f"""WITH {TERMS}
SELECT count(*) AS words, round(avg(cnt), 6) AS mean, round(stddev_pop(cnt), 6) AS stdev,
  max(cnt) AS max, min(cnt) AS min FROM vocab"""
ORACLES["tfidf_weights"] = f"""WITH {TERMS},
bag AS (SELECT doc_id, word, count(*) AS tf FROM terms GROUP BY doc_id, word)
SELECT doc_id, word, idx, tf,
  round(sqrt(tf) * (ln((SELECT count(*) FROM labels) / (cnt + 1.0)) + 1), 6) AS weight
FROM bag JOIN vocab USING (word)"""
ORACLES["idf_alt"] = f"""WITH {TERMS}
SELECT word, cnt, round(ln(1 + (SELECT count(*) FROM labels) / cnt::DOUBLE), 6) AS idf FROM vocab"""
ORACLES["ml_idf"] = f"""
WITH words AS ({unnested('documents', split_list('text'), 'doc_id')})
SELECT word, count(DISTINCT doc_id) AS df,
  round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(DISTINCT doc_id) + 1.0)), 6) AS idf
FROM words GROUP BY word"""
ORACLES["similar_news"] = f"""WITH {NEWS},
words AS ({unnested('news', normal_words('content'), 'doc_id, label')}),
sums AS (SELECT word, count(*) FILTER (label = 0)::DOUBLE AS c0, count(*) FILTER (label = 1)::DOUBLE AS c1
         FROM words GROUP BY word),
bag AS (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM words GROUP BY doc_id, word)
SELECT doc_id,
  round(sum(tf * c0) / (sqrt(sum(tf * tf)) * sqrt((SELECT sum(c0 * c0) FROM sums))), 6) AS to_unreliable,
  round(sum(tf * c1) / (sqrt(sum(tf * tf)) * sqrt((SELECT sum(c1 * c1) FROM sums))), 6) AS to_credible
FROM bag JOIN sums USING (word) GROUP BY doc_id"""
ARTICLES = f"""{NEWS},
words AS ({unnested('news', normal_words('content'), 'doc_id, label')}),
bag AS (SELECT doc_id, label, word, count(*) AS tf FROM words GROUP BY ALL),
spelt AS (SELECT doc_id, label, string_agg(word || ' ' || tf, ' ' ORDER BY word) AS s FROM bag GROUP BY doc_id, label),
classes AS (SELECT label, s, min(doc_id) AS id, count(*) AS articles FROM spelt GROUP BY label, s)"""
ORACLES["article_classes"] = f"WITH {ARTICLES} SELECT doc_id, id, label FROM spelt JOIN classes USING (label, s)"
ORACLES["similar_pairs"] = f"""WITH {ARTICLES},
idf AS (SELECT word, ln(((SELECT count(*) FROM spelt) + 1.0) / (count(*) + 1.0)) AS idf FROM bag GROUP BY word),
weights AS (SELECT id, c.label, articles, word, tf * idf AS w FROM classes c JOIN bag b ON b.doc_id = c.id JOIN idf USING (word)),
lengths AS (SELECT id, sqrt(sum(w * w)) AS length FROM weights GROUP BY id),
dots AS (
  SELECT u.id AS unreliable_id, c.id AS credible_id, any_value(u.articles) AS unreliable_articles,
    any_value(c.articles) AS credible_articles, sum(u.w * c.w) AS dot
  FROM weights u JOIN weights c ON u.word = c.word AND u.label = 0 AND c.label = 1 GROUP BY u.id, c.id
)
SELECT unreliable_id, credible_id, unreliable_articles, credible_articles, round(dot / (a.length * b.length), 6) AS cosine
FROM dots JOIN lengths a ON a.id = unreliable_id JOIN lengths b ON b.id = credible_id
WHERE round(dot / (a.length * b.length), 6) >= 0.2"""
ORACLES["nb_theta"] = f"""WITH {TERMS},
totals AS (SELECT sum(cnt0) AS t0, sum(cnt1) AS t1, count(*) AS v FROM vocab)
SELECT 0.0::DOUBLE AS label, word, round(ln((cnt0 + 1.0) / (t0 + v)), 6) AS theta FROM vocab, totals
UNION ALL
SELECT 1.0::DOUBLE, word, round(ln((cnt1 + 1.0) / (t1 + v)), 6) FROM vocab, totals"""
ORACLES["fold_assignment"] = f"SELECT doc_id, CAST(floor({U12} * 10) AS INT) AS fold FROM documents"

# ---- vectors ----------------------------------------------------------------------------

CELLS = """cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
)"""
SIMILAR = f"""{CELLS},
sums AS (SELECT label, pos, sum(x) AS total FROM cells GROUP BY label, pos),
nearness AS (
  SELECT vec_id, label, sum(x * total) / (sqrt(sum(x * x)) * sqrt(sum(total * total))) AS c
  FROM cells JOIN sums USING (label, pos) GROUP BY vec_id, label
)"""

ORACLES["l2_normalise"] = f"""WITH {CELLS}
SELECT vec_id, CAST(pos AS INT) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM cells"""
ORACLES["vector_sum_by_label"] = f"""WITH {CELLS}
SELECT label, CAST(pos AS INT) AS pos, round(sum(x), 6) AS total FROM cells GROUP BY label, pos"""
ORACLES["cosine_similarity"] = f"WITH {SIMILAR} SELECT vec_id, label, round(c, 6) AS cosine FROM nearness"
ORACLES["cosine_topk"] = f"""WITH {SIMILAR},
ranked AS (SELECT label, vec_id, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS rank FROM nearness)
SELECT label, vec_id, round(c, 6) AS cosine, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5"""

ORACLES["nearest_vectors"] = """WITH units AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_inner_product(v, v)) AS length FROM embeddings
),
scored AS (
  SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_inner_product(q.v, r.v) / (q.length * r.length), 6) AS cosine
  FROM units q JOIN units r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT query, neighbour, cosine, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS INT) AS rank
FROM scored QUALIFY rank <= 5"""


def _hinge_steps(steps: int, reg: float) -> str:
    """Gradient steps on the mean hinge loss with soft thresholding, from the definition: step i is 1 / sqrt(i) long."""
    sql = "w0 AS (SELECT idx, 0.0::DOUBLE AS weight FROM (SELECT DISTINCT idx FROM cells))"
    for i in range(1, steps + 1):
        step = f"(1.0 / sqrt({i}.0))"
        sql += f""",
margin{i} AS (SELECT doc_id, side, sum(x * weight) AS m FROM cells JOIN w{i - 1} USING (idx) GROUP BY doc_id, side),
moved{i} AS (
  SELECT idx, weight + {step} * coalesce(pull, 0) / (SELECT count(*) FROM fitted) AS weight
  FROM w{i - 1} LEFT JOIN (
    SELECT idx, sum(side * x) AS pull FROM cells JOIN margin{i} USING (doc_id, side) WHERE side * m < 1 GROUP BY idx
  ) USING (idx)
),
w{i} AS (SELECT idx, sign(weight) * greatest(abs(weight) - {reg} * {step}, 0) AS weight FROM moved{i})"""
    return sql


ORACLES["svm_l1_weights"] = f"""WITH {TERMS},
fitted AS (SELECT doc_id, 2 * label - 1 AS side FROM news WHERE {U11} < 0.7),
fit_words AS (SELECT word, count(*) AS cnt FROM terms JOIN fitted USING (doc_id) GROUP BY word HAVING count(*) > 10),
numbered AS (SELECT word, cnt, row_number() OVER (ORDER BY word) - 1 AS idx FROM fit_words),
bag AS (SELECT doc_id, word, count(*) AS tf FROM terms GROUP BY doc_id, word),
cells AS (
  SELECT doc_id, side, idx, sqrt(tf) * (ln((SELECT count(*) FROM fitted) / (cnt + 1.0)) + 1) AS x
  FROM bag JOIN fitted USING (doc_id) JOIN numbered USING (word)
),
{_hinge_steps(3, 0.02)}
SELECT CAST(idx AS BIGINT) AS idx, round(weight, 6) AS weight FROM w3 WHERE weight <> 0"""

ORACLES["cooccurrence_counts"] = f"""WITH words AS ({unnested('documents', split_list('text'), 'doc_id')}),
known AS (SELECT word FROM words GROUP BY word HAVING count(*) >= 20)
SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, count(*) AS n
FROM words x JOIN words y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos <= x.pos + 5
WHERE x.word IN (SELECT word FROM known) AND y.word IN (SELECT word FROM known) GROUP BY 1, 2"""

# ---- evaluation -------------------------------------------------------------------------

CELL_SUMS = """
  count(*) FILTER (label = 0 AND prediction = 0) AS tp, count(*) FILTER (label = 1 AND prediction = 0) AS fp,
  count(*) FILTER (label = 0 AND prediction = 1) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tn"""


def _f(p: str, r: str, b2: float) -> str:
    return f"({1 + b2} * {p} * {r}) / nullif({b2} * {p} + {r}, 0)"


BINARY = f"""
  tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
  (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS accuracy,
  1.0 - (tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE AS test_error,
  {_f('(tp / nullif(tp + fp, 0)::DOUBLE)', '(tp / nullif(tp + fn, 0)::DOUBLE)', 1.0)} AS f1,
  {_f('(tp / nullif(tp + fp, 0)::DOUBLE)', '(tp / nullif(tp + fn, 0)::DOUBLE)', 4.0)} AS f2"""


def _label_rows(keys: str = "") -> str:
    out = []
    for label, (a, b, c, d) in ((0.0, ("tp", "fp", "fn", "tn")), (1.0, ("tn", "fn", "fp", "tp"))):
        p, r = f"({a} / nullif({a} + {b}, 0)::DOUBLE)", f"({a} / nullif({a} + {c}, 0)::DOUBLE)"
        out.append(
            f"SELECT {keys} {label}::DOUBLE AS label, {a} + {c} AS examples, {b} / nullif({b} + {d}, 0)::DOUBLE AS fpr, "
            f"{r} AS tpr, {r} AS recall, {p} AS precision, {_f(p, r, 1.0)} AS f1 FROM cm"
        )
    return " UNION ALL ".join(out)


CM = f"{SCORED_NEWS}, cm AS (SELECT {CELL_SUMS} FROM scored)"
CM_SETS = f"{SCORED_SETS}, cm AS (SELECT dataset, {CELL_SUMS} FROM scored GROUP BY dataset)"

ORACLES["confusion_matrix"] = f"""{SCORED_NEWS},
grid AS (SELECT * FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) a(label), (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) b(prediction))
SELECT g.label, g.prediction, count(s.doc_id) AS n
FROM grid g LEFT JOIN scored s ON g.label = s.label AND g.prediction = s.prediction GROUP BY 1, 2"""
ORACLES["per_label_metrics"] = f"{CM} {_label_rows()}"
ORACLES["binary_metrics"] = f"""{CM}
SELECT tp, fp, fn, tn, {BINARY}, tp + fp AS predicted_0, tp AS predicted_0_correct FROM cm"""
ORACLES["scored_write_counts"] = f"{CM} SELECT tp + fp AS predicted_0, tp AS predicted_0_correct, tp, fp, fn, tn FROM cm"
ORACLES["eval_by_dataset"] = f"""{CM_SETS}
SELECT dataset, tp, fp, fn, tn, {BINARY}, tp + fp AS predicted_0, tp AS predicted_0_correct FROM cm"""
ORACLES["eval_report"] = f"""{CM_SETS},
by_label AS ({_label_rows('dataset,')}),
overall AS (SELECT dataset, tp, fp, fn, tn, {BINARY} FROM cm)
""" + " UNION ALL ".join(
    [
        f"SELECT dataset, '{m}' AS metric, label, {m}::DOUBLE AS value FROM by_label"
        for m in ("examples", "fpr", "tpr", "recall", "precision", "f1")
    ]
    + [
        f"SELECT dataset, '{m}' AS metric, NULL::DOUBLE AS label, {m}::DOUBLE AS value FROM overall"
        for m in ("tp", "fp", "fn", "tn", "precision", "recall", "accuracy", "test_error", "f1", "f2")
    ]
)

CURVE = f"""{SCORED_NEWS},
by_score AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM by_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
),
rates AS (
  SELECT score, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall, fp / n::DOUBLE AS fpr FROM curve
)"""
ORACLES["threshold_metrics"] = f"""{CURVE}
SELECT score AS threshold, precision, recall,
  coalesce({_f('precision', 'recall', 1.0)}, 0.0) AS f1, coalesce({_f('precision', 'recall', 4.0)}, 0.0) AS f2
FROM rates"""
ORACLES["roc_curve"] = f"""{CURVE}
SELECT fpr, recall AS tpr FROM rates UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT 1.0::DOUBLE, 1.0::DOUBLE"""
ORACLES["pr_curve"] = f"""{CURVE}
SELECT recall, precision FROM rates
UNION ALL SELECT 0.0::DOUBLE, arg_max(precision, score) FROM rates"""
ORACLES["auc_metrics"] = f"""{CURVE},
roc AS (
  SELECT fpr AS x, recall AS y, 1 - score AS o FROM rates
  UNION ALL SELECT 0.0, 0.0, -1 UNION ALL SELECT 1.0, 1.0, 9
),
pr AS (
  SELECT recall AS x, precision AS y, 1 - score AS o FROM rates
  UNION ALL SELECT 0.0, (SELECT arg_max(precision, score) FROM rates), -1
),
roc_steps AS (SELECT x - lag(x) OVER (ORDER BY o) AS dx, (y + lag(y) OVER (ORDER BY o)) / 2 AS h FROM roc),
pr_steps AS (SELECT x - lag(x) OVER (ORDER BY o) AS dx, (y + lag(y) OVER (ORDER BY o)) / 2 AS h FROM pr)
SELECT round((SELECT sum(dx * h) FROM roc_steps), 6) AS area_under_roc,
       round((SELECT sum(dx * h) FROM pr_steps), 6) AS area_under_pr"""
