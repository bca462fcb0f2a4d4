"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from truthmill.llm import licenses, linedups, quality

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    phrases = ", ".join(f"({_text(p)}, {_text(label)})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({i}, {_text(label)}, {_text(t.lower())})" for i, (label, t) in enumerate(licenses.TEMPLATES))
    enough = f"ceil(round({licenses.THRESHOLD} * len(t.s), 9))"
    return f"""
WITH phrase(p, label) AS (VALUES {phrases}),
template(id, label, t) AS (VALUES {templates}),
sets AS (SELECT id, label, list_distinct(regexp_extract_all(t, {WORD})) AS s, len(regexp_extract_all(t, {WORD})) AS reach FROM template),
doc AS (SELECT doc_id, row_number() OVER () AS row, {LOWER} AS text, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
place AS (
  SELECT row, label, i - 1 AS spot
  FROM doc, phrase, unnest(range(1, len(w) + 1)) AS r(i)
  WHERE array_to_string(w[i:i + len(string_split(p, ' ')) - 1], ' ') = p
),
base AS (
  SELECT row, count(*) AS n, min(spot) AS lo, max(spot) AS hi, list(DISTINCT label) AS labels FROM place GROUP BY row
),
block AS (
  SELECT row, list_distinct(regexp_extract_all(line, {WORD})) AS s
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM doc)
),
holding AS (
  SELECT row, w, t.*, flatten(list_transform(string_split(text, chr(10)), lambda x, i: list_transform(regexp_extract_all(x, {WORD}), lambda y: i))) AS l
  FROM doc, sets t WHERE len(list_intersect(list_distinct(w), t.s)) >= {enough}
),
wrapped AS (
  SELECT row, id, list_distinct(w[i:i + reach - 1]) AS s
  FROM holding, unnest(range(1, len(w) + 1)) AS r(i) WHERE l[least(i + reach - 1, len(w))] > l[i]
),
near AS (
  SELECT row, label, len(list_intersect(b.s, t.s)) AS n, t.s FROM block b, sets t
  UNION ALL SELECT row, label, len(list_intersect(b.s, t.s)), t.s FROM wrapped b JOIN sets t USING (id)
),
found AS (
  SELECT row, max(n / len(s)) AS share, list(DISTINCT label) AS labels
  FROM near t WHERE n >= {enough} GROUP BY row
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM doc LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""


def benchmark_overlap() -> str:
    return f"""
WITH item AS (SELECT item_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM benchmark WHERE item_id IS NOT NULL),
span AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
run AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT n FROM span), unnest(range(1, greatest(len(w) - n, -1) + 2)) AS r(i)
),
hit AS (SELECT DISTINCT doc_id, item_id, i, run.n FROM run JOIN span USING (n, g)),
place AS (SELECT doc_id, count(DISTINCT j) AS n FROM hit, unnest(range(i, i + hit.n)) AS r(j) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(place.n, 0) AS n_hit,
  CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(place.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN place USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup(long_words: int = linedups.LONG_WORDS) -> str:
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, i - 1 AS place, trim(lines[i], {BLANKS}) AS line, lines[i] AS whole FROM doc, unnest(range(1, len(lines) + 1)) AS r(i)
),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM line WHERE line <> ''
),
run AS (
  SELECT a.doc_id, a.place, [a.place, b.place, c.place] AS places, [a.line, b.line, c.line] AS run
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN worded c ON a.doc_id = c.doc_id AND c.n = a.n + {linedups.RUN - 1}
  UNION ALL SELECT doc_id, place, [place], [line] FROM worded WHERE words >= {long_words}
  UNION ALL
  SELECT a.doc_id, a.place, [a.place, b.place], [a.line, b.line]
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.n = a.n + 1 WHERE a.words + b.words >= {long_words}
),
later AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS k FROM run),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS place FROM later WHERE k > 1),
kept AS (
  SELECT doc_id, count(gone.place) AS n, string_agg(CASE WHEN gone.place IS NULL THEN whole END, chr(10) ORDER BY place) AS text
  FROM line LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, (SELECT count(*) FROM worded w WHERE w.doc_id = doc.doc_id) AS n_word_lines,
  kept.n AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc JOIN kept USING (doc_id)
"""


def _steps(source: str, names: str, steps: list[dict[str, str]]) -> str:
    """Nested selects that add columns step by step."""
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in step.items())} FROM {source})"
    return f"SELECT {names} FROM {source}"


def quality_rules() -> str:
    q = quality
    group, same = "lang, source, small", "lang IS NOT DISTINCT FROM g.lang AND x.source IS NOT DISTINCT FROM g.source AND x.small = g.small"
    features = ", ".join(q.FEATURES)
    sums = ", ".join(f"{sql} AS {name}" for name, sql in q.sums_sql().items())
    parts = [
        f"doc AS (SELECT doc_id, row_number() OVER () AS row, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)",
        "gram AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM doc, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS r(i))",
        "twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS c FROM gram) WHERE c > 1)",
        "rep AS (SELECT row, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 5)) AS r(j) GROUP BY row)",
        f"ln AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM doc) WHERE trim(line, {BLANKS}) <> '' GROUP BY row)",
        """stat AS (SELECT doc_id, row, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ!]', '', 'g')) AS n_capitals,
  coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM doc LEFT JOIN rep USING (row) LEFT JOIN ln USING (row))""",
        "feat AS (SELECT *, " + ", ".join(f"{sql} AS {f}" for f, sql in q.FEATURE_SQL.items())
        + f", n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM stat)",
        "size AS (SELECT lang, source, count(*) AS n FROM feat WHERE NOT base_failed GROUP BY ALL)",
        f"""placed AS (SELECT feat.* EXCLUDE (source), CASE WHEN size.n >= {q.LEAST_ROWS} THEN feat.source END AS source, coalesce(size.n < {q.LEAST_ROWS}, true) AS small
  FROM feat LEFT JOIN size ON feat.lang IS NOT DISTINCT FROM size.lang AND feat.source IS NOT DISTINCT FROM size.source)""",
        "judged AS (SELECT * FROM placed WHERE NOT base_failed)",
        f"mid AS (SELECT {group}, " + ", ".join(f"quantile_cont({f}, 0.5) AS mid_{f}" for f in q.FEATURES) + f" FROM judged GROUP BY ALL HAVING count(*) >= {q.LEAST_ROWS})",
        f"mad AS (SELECT g.lang, g.source, g.small, " + ", ".join(f"quantile_cont(abs(x.{f} - g.mid_{f}), 0.5) AS mad_{f}" for f in q.FEATURES)
        + f", " + ", ".join(f"any_value(mid_{f}) AS mid_{f}" for f in q.FEATURES) + f" FROM judged x JOIN mid g ON x.{same} GROUP BY ALL)",
        f"level0 AS (SELECT x.*, {q.level_sql(q.first_distance_sql())} AS level FROM judged x JOIN mad g ON x.{same})",
    ]
    kept = ", ".join([group, *[f"mean_{i}" for i in range(len(q.FEATURES))], *[f"l_{i}_{j}" for i in range(len(q.FEATURES)) for j in range(i + 1)]])

    def estimate(name: str, close: str, times: float | None = None) -> list[str]:
        """Sums over the close rows, their factor, and everybody's distance by it."""
        return [
            f"sum_{name} AS (SELECT {group}, {sums} FROM ({close}) GROUP BY ALL)",
            f"factor_{name} AS ({_steps(f'sum_{name}', kept, q.factor_sql(times))})",
            f"near_{name} AS (SELECT x.*, g.* EXCLUDE ({group}) FROM judged x JOIN factor_{name} g ON x.{same})",
            f"scored_{name} AS ({_steps(f'near_{name}', f'doc_id, row, {group}, {features}, d2', q.distance_sql())})",
            f"level_{name} AS (SELECT *, {q.level_sql('d2')} AS level FROM scored_{name})",
        ]

    for name, support, times in (("most", q.SUPPORT, None), ("half", q.HALF, q.HALF_FACTOR)):
        before = "level0"
        for n in range(q.STEPS + 1):
            parts.append(f"cut_{name}{n} AS (SELECT {group}, quantile_cont(level, {support}) AS cut FROM {before} GROUP BY ALL)")
            parts += estimate(f"{name}{n}", f"SELECT x.* FROM {before} x JOIN cut_{name}{n} g ON x.{same} WHERE level <= cut", times)
            before = f"level_{name}{n}"
    parts += estimate("within", f"SELECT * FROM level_half{q.STEPS} WHERE d2 <= {q.WITHIN}", q.WITHIN_FACTOR)
    for name, rows in (("most", f"level_most{q.STEPS}"), ("within", f"level_within WHERE d2 <= {q.WITHIN}")):
        parts.append(f"scale_{name} AS (SELECT {group}, greatest(1.0, (exp((quantile_cont(level, 0.5) + 1) / 64) - 1) / {q.MEDIAN_DISTANCE}) AS scale FROM {rows} GROUP BY ALL)")
    for name, rows in (("most", f"level_most{q.STEPS}"), ("within", "level_within")):
        parts.append(f"dist_{name} AS (SELECT row, {', '.join(f'x.{c}' for c in group.split(', '))}, d2 / scale AS distance FROM {rows} x JOIN scale_{name} g ON x.{same})")
    parts += [
        f"junk AS (SELECT {group} FROM dist_within GROUP BY ALL HAVING avg(CASE WHEN distance > {q.CUTOFF} THEN 1.0 ELSE 0.0 END) > {1 - q.SUPPORT})",
        f"dist AS (SELECT row, distance FROM dist_most x WHERE NOT EXISTS (SELECT 1 FROM junk g WHERE x.{same})"
        f" UNION ALL SELECT row, distance FROM dist_within x JOIN junk g ON x.{same})",
    ]
    return f"""
WITH {",".join(chr(10) + p for p in parts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distance, base_failed,
  NOT base_failed AND coalesce(distance, 0) <= {q.CUTOFF} AS kept
FROM placed LEFT JOIN dist USING (row)
"""


def hard_negatives() -> str:
    """Whole-number products are exact as doubles: components are far below 2**20."""
    return """WITH whole AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.row AS a_row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.row <> b.row
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id) AS slot FROM scores WHERE same
  QUALIFY slot <= 5
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a_row, p.slot ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON p.a_row = n.a_row AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
  QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives"""
