"""SQL that gives the rows of the registered corpus queries, where SQL can express them.

Sharding on a ring, packing and main text have none: they are walks over a state, and
tests hold them against brute force.
"""

from __future__ import annotations

from plumbline.llm import licenses, mixing, quality, urls, warc

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lower(value: str) -> str:
    """A-Z only."""
    return f"translate({value}, '{_UPPER}', '{_UPPER.lower()}')"


OP1 = f"""
WITH p AS (
    SELECT page_id, url, sha1(coalesce(html, '')) AS digest,
           octet_length(encode(coalesce(html, ''))) AS n
    FROM pages
), m AS (
    SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {warc.MIN_PAYLOAD} AND page_id < last THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN n >= {warc.MIN_PAYLOAD} AND page_id < last THEN last END AS refers_to,
       url
FROM m
"""

OP2 = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           sqrt(list_sum(list_transform(range(1, len(q.e) + 1),
                                        lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank
    FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_TEMPLATES = ", ".join(
    f"({_text(name)}, [{', '.join(map(_text, held))}])"
    for name, held in ((n, licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES.items())
)
_WINDOWS = ", ".join(
    f"({_text(name)}, {len(licenses.template_words(text)) - 1}, {_text(gram)}, {len(held)})"
    for name, text, held in ((n, t, licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES.items())
    for gram in held
)
OP3_PASSAGES = f"""
WITH t(license, reach, g, size) AS (VALUES {_WINDOWS}),
w AS (
    SELECT doc_id, string_split(
        trim(regexp_replace({_lower('text')}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w
    FROM documents
), g AS (
    SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS gs
    FROM w WHERE len(w) > 1
), p AS (
    SELECT doc_id, license, reach, size, i, g
    FROM (SELECT doc_id, unnest(gs) AS g, unnest(range(0, len(gs))) AS i FROM g) JOIN t USING (g)
), near AS (
    SELECT a.doc_id, a.license, a.reach, a.size, a.i, count(DISTINCT b.g) AS shared
    FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.license = b.license
        AND b.i >= a.i AND b.i < a.i + a.reach
    GROUP BY ALL
), windows AS (
    SELECT doc_id, license, reach, i, n, 2.0::DOUBLE * shared / (n + size) AS dice
    FROM (
        SELECT near.*, len(list_distinct(gs[i + 1:i + reach])) AS n
        FROM near JOIN g USING (doc_id)
    )
    WHERE 2.0::DOUBLE * shared / (n + size) >= {licenses.THRESHOLD}
), parted AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, license ORDER BY i) AS passage
    FROM (
        SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id, license ORDER BY i) > reach, TRUE)
            ::INTEGER AS fresh
        FROM windows
    )
), first AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, license, passage ORDER BY dice DESC, i) AS turn
    FROM parted
)
SELECT doc_id, 'passage' AS unit, i::BIGINT AS unit_no, license, dice, n::BIGINT AS n_bigrams
FROM first WHERE turn = 1
"""
OP3 = f"""
WITH t(license, b) AS (VALUES {_TEMPLATES}),
held AS (
    SELECT doc_id, 'line' AS unit, string_split(text, chr(10)) AS xs FROM documents
    UNION ALL
    SELECT doc_id, 'block', string_split_regex(text, {_text(licenses.BLANK_LINE)}) FROM documents
), units AS (
    SELECT doc_id, unit, unnest(range(0, len(xs))) AS unit_no, unnest(xs) AS held FROM held
), words AS (
    SELECT doc_id, unit, unit_no, string_split(
        trim(regexp_replace({_lower('held')}, '[^a-z0-9]+', ' ', 'g')), ' ') AS w
    FROM units WHERE unit = 'line' OR contains(held, chr(10))
), grams AS (
    SELECT doc_id, unit, unit_no,
           list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
    FROM words WHERE len(w) > 1
), scored AS (
    SELECT g.doc_id, g.unit, g.unit_no, t.license, len(g.b) AS n_bigrams,
           2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice
    FROM grams g JOIN t ON greatest(len(g.b), len(t.b))
        <= least(len(g.b), len(t.b)) * (2 - {licenses.THRESHOLD}) / {licenses.THRESHOLD} + 1e-9
), best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license)
        AS turn
    FROM scored WHERE dice >= {licenses.THRESHOLD}
)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, dice, n_bigrams::BIGINT AS n_bigrams
FROM best WHERE turn = 1
UNION ALL
SELECT * FROM ({OP3_PASSAGES})
"""

OP4 = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w
    FROM documents
), s AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) = 1 THEN [w[1]]
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
        END) AS g
    FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.id, edges.b FROM reach JOIN edges ON reach.other = edges.a
), root AS (
    SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id,
       d.doc_id = component_id AS kept
FROM documents d JOIN root ON root.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_KEY = "coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))"
OP6 = f"""
WITH sizes AS (
    SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1) AS size
    FROM documents GROUP BY source
), total AS (
    SELECT sum(size) AS size, sum(pow(size, {mixing.TEMPERATURE})) AS weight FROM sizes
), rates AS (
    SELECT s.source,
           {mixing.EPOCHS} * t.size / t.weight * pow(s.size, {mixing.TEMPERATURE}) / s.size AS rate
    FROM sizes s, total t
), parts AS (
    SELECT *, greatest(ceil(rate / {mixing.LARGEST_MEAN}), 1) AS parts FROM rates
), cdf AS (
    SELECT source, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)))
        OVER (PARTITION BY source ORDER BY k) AS c
    FROM parts, range(0, {mixing.TERMS} + 1) t(k)
), ladder AS (
    SELECT source, list(c) AS cs FROM cdf GROUP BY source
), keyed AS (
    SELECT d.doc_id, d.source, p.rate, l.cs, {_KEY} AS key,
           unnest(range(1, p.parts::BIGINT + 1)) AS part, row_number() OVER () AS row
    FROM documents d
    JOIN parts p ON p.source IS NOT DISTINCT FROM d.source
    JOIN ladder l ON l.source IS NOT DISTINCT FROM d.source
), drawn AS (
    SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || key || '|' || part), 1, 13))::BIGINT
        / {float(1 << 52)} AS u
    FROM keyed
), counts AS (
    SELECT row, any_value(doc_id) AS doc_id, any_value(source) AS source,
           any_value(rate) AS rate, any_value(key) AS key,
           sum(len(list_filter(cs, lambda c: c <= u)))::BIGINT AS n
    FROM drawn GROUP BY row
), copies AS (
    SELECT *, unnest(range(1, n + 1)) AS copy FROM counts
)
SELECT doc_id, source, round(rate, 6) AS rate, copy, md5('{mixing.SEED}|' || key || '|' || copy) AS shuffle_key
FROM copies
"""

_RULES = ", ".join(
    f"({_text(r.verdict)}, {_text(r.host)}, {_text(r.path)}, {_text(r.text)}, "
    f"{r.host.count('.') + 1}, {len(r.path)})"
    for r in urls.RULES
)
OP7 = f"""
WITH rules(verdict, host, path, rule, labels, depth) AS (VALUES {_RULES}),
rest AS (
    SELECT page_id, CASE WHEN contains(url, '://')
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
    FROM pages
), parts AS (
    SELECT page_id, {_lower("regexp_extract(r, '^[^/?#]*')")} AS host,
           regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest
), ranked AS (
    SELECT p.*, rules.rule, rules.verdict, row_number() OVER (
        PARTITION BY p.page_id
        ORDER BY labels DESC NULLS LAST, depth DESC NULLS LAST, verdict = 'block' DESC) AS turn
    FROM parts p LEFT JOIN rules
        ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host))
        AND starts_with(p.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict
FROM ranked WHERE turn = 1
"""


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(line, {_text(pattern)}))"


_WINDOW = " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER v" for k in range(1, quality.WINDOW))])
OP10 = f"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
    FROM documents
), base AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)
               AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols
    FROM w
), said AS (
    SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), windows AS (
    SELECT doc_id, i, {_WINDOW} AS run
    FROM said WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n
    FROM windows WHERE run IS NOT NULL
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM runs, range(0, 8) t(k) WHERE runs.n > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS ws
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
), judged AS (
    SELECT doc_id, line, length(line) AS chars,
           {_n(quality.LINE_SYMBOLS)} * 4 > len(ws)
           OR ({_n(quality.LINE_MARKS)} >= 3 AND {_n(quality.LINE_MARKS)} * 3 > len(ws))
           OR ({_n(quality.SEPARATORS)} >= 2 AND {_n(quality.SEPARATORS)} * 4 > len(ws))
           OR (len(ws) <= {quality.MENU_WORDS}
               AND NOT regexp_matches(line, {_text(quality.CLOSED)}))
           OR coalesce(list_sum(list_transform(
               range(1, len(ws)), lambda i: (ws[i] = ws[i + 1])::INTEGER)), 0) * 4 > len(ws)
           OR coalesce(list_sum(list_transform(
               regexp_extract_all(line, {_text('|'.join(quality.BOILERPLATE))}, 0, 'i'),
               lambda x: len(regexp_extract_all(x, '{_WORD}')))), 0) * 4 > len(ws) AS fails
    FROM lines WHERE len(ws) > 0
), lost AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(chars) AS chars,
           coalesce(sum(chars) FILTER (fails), 0) AS lost
    FROM judged GROUP BY doc_id
), all_of AS (
    SELECT b.*, coalesce(l.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
           coalesce(l.chars, 0) AS chars, coalesce(l.lost, 0) AS lost
    FROM base b LEFT JOIN repeated r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       n_words < {quality.MIN_WORDS}
           OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed,
       NOT (n_words < {quality.MIN_WORDS}
           OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT}
           OR lost * 100 > chars * {quality.MAX_LOST_PERCENT}) AS kept
FROM all_of
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')"

OP12 = f"""
WITH docs AS (
    SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL
), lengths AS (
    SELECT doc_id, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM lengths
), asked AS (
    SELECT item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)
    GROUP BY ALL
), held AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, unnest(ts) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, corpus GROUP BY term, n_docs
), parts AS (
    SELECT doc_id, term, w * ((1000000000 * tf)
               // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all))) AS part
    FROM held JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
), scores AS (
    SELECT item_id, doc_id, sum(times * part)::BIGINT AS score
    FROM asked JOIN parts USING (term) GROUP BY ALL
), best AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER
               AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_warc_revisits": OP1,
    "op2_vantage_point_neighbours": OP2,
    "op3_license_scan": OP3,
    "op4_minhash_near_duplicates": OP4,
    "op6_poisson_mixing": OP6,
    "op7_url_filter": OP7,
    "op10_quality_rules": OP10,
    "op12_ranked_search": OP12,
}
