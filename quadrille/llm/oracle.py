"""DuckDB SQL that the queries must equal, built from the operators' own fixed values."""

from __future__ import annotations

from . import licenses, quality, secrets

_SPLIT = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def exact_dedup_sql() -> str:
    return """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def quality_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    rules = quality.RULES
    share = alpha / len(rules)
    measures = ", ".join(f"{e.replace(' div ', ' // ')} AS m_{r}" for r, (e, _) in rules.items())
    tests = " UNION ALL ".join(
        f"SELECT lang, '{r}' AS rule, i * {step} AS cutoff, count(*) AS n, count(*) FILTER (m_{r} > i * {step}) AS k FROM good, range(1, {quality.GRID + 1}) s(i) GROUP BY lang, i" for r, (_, step) in rules.items()
    )
    verdict = " AND ".join(f"NOT coalesce(m_{r} > (SELECT cutoff FROM cuts WHERE cuts.lang = m.lang AND rule = '{r}'), false)" for r in rules)
    return rf"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
        s AS (SELECT *, {_SPLIT.format(t="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM s)),
        twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, {quality.WINDOW}) r(j) GROUP BY doc_id),
        f AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
                     (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN covered USING (doc_id)),
        m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {measures} FROM f),
        good AS (SELECT m.* FROM m JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
        tests AS ({tests}),
        tails AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share})))) AS p FROM tests WHERE k < n * {share}),
        cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tails WHERE p <= {delta} / ({len(rules) * quality.GRID} * (SELECT count(DISTINCT lang) FROM good)) GROUP BY lang, rule)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept, n_lines FROM m"""


def licenses_sql() -> str:
    posts = ", ".join(f"('{w}', {t}, {i})" for w, t, i in licenses.postings())
    templates = ", ".join(f"({t}, '{label}', '{must}')" for t, (label, must, _) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH s AS (SELECT doc_id, list_filter(string_split_regex({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS j FROM s),
        posts(x, t, i) AS (VALUES {posts}), templates(t, label, must) AS (VALUES {templates}), phrases(p, label) AS (VALUES {phrases}),
        base AS (SELECT s.doc_id, label, j FROM phrases JOIN words ON words.x = p[1] JOIN s ON s.doc_id = words.doc_id WHERE w[j + 1:j + len(p)] = p),
        df AS (SELECT x, count(DISTINCT doc_id) AS df FROM words WHERE x IN (SELECT x FROM posts) GROUP BY x),
        rare AS (SELECT doc_id, x FROM (SELECT DISTINCT doc_id, x FROM words) JOIN df USING (x) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, x) <= {licenses.RARE}),
        votes AS (SELECT doc_id, t, j - i AS shift, count(*) AS n FROM words JOIN rare USING (doc_id, x) JOIN posts USING (x) GROUP BY ALL),
        best AS (SELECT doc_id, t, max(n) AS n FROM votes GROUP BY ALL),
        whole AS (SELECT doc_id, t, count(*) AS n FROM rare JOIN posts USING (x) GROUP BY ALL),
        verified AS (SELECT doc_id, label, least(1.0, best.n / whole.n::DOUBLE) AS share FROM best JOIN whole USING (doc_id, t) JOIN templates USING (t) JOIN s USING (doc_id)
                     WHERE whole.n >= 2 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || must || ' ') AND best.n / whole.n::DOUBLE >= {licenses.AGREE}),
        b AS (SELECT doc_id, count(*) AS n_base, min(j) AS first_word, max(j) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
        v AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM verified) GROUP BY doc_id),
        top AS (SELECT doc_id, max(share) AS share FROM verified GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
        FROM s LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN top USING (doc_id)"""


def secrets_sql() -> str:
    def spans(kind: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, '{kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, m[i] AS m, v[i] AS v
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d)) WHERE length(v[i]) >= {least}"""

    base = " UNION ALL ".join(f"SELECT *, {rank} AS k FROM ({spans(kind, *x)})" for rank, (kind, x) in enumerate(secrets.PATTERNS.items()))
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {secrets.most(bits)}" for _, p, bits in secrets.CLASSES) + " END"
    counts = "SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.PATTERNS)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        base AS (SELECT doc_id, kind, k, s, s + length(m) AS e FROM ({base})),
        cands AS (SELECT doc_id, m, s, s + length(m) AS e FROM ({spans(secrets.ENTROPY, secrets.CANDIDATE, 1, secrets.WINDOW)}) WHERE NOT ({allowed})),
        windows AS (SELECT *, unnest(range(1, length(m) - {secrets.WINDOW - 2})) AS i FROM cands),
        chars AS (SELECT doc_id, s, i, m[i + j] AS c, count(*) AS n FROM windows, range(0, {secrets.WINDOW}) r(j) GROUP BY ALL),
        sums AS (SELECT doc_id, s, i, sum({secrets.TERMS}[n + 1]) AS total FROM chars GROUP BY ALL),
        low AS (SELECT doc_id, s, min(total) AS total FROM sums GROUP BY ALL),
        high AS (SELECT doc_id, '{secrets.ENTROPY}' AS kind, {len(secrets.PATTERNS)} AS k, c.s, c.e FROM cands c JOIN low USING (doc_id, s)
                 WHERE total <= {limit} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)),
        n AS ({counts}, doc_id, string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, k) AS said FROM base GROUP BY doc_id),
        a AS (SELECT doc_id, string_agg(concat_ws(':', kind, s::BIGINT, e::BIGINT), ',' ORDER BY s, k) AS spans FROM (SELECT * FROM base UNION ALL BY NAME SELECT * FROM high) GROUP BY doc_id)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in secrets.PATTERNS)}, sha256(coalesce(said, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)"""


def near_duplicates_sql(percent: int = 80) -> str:
    """Two-word shingles, all pairs that share one, and the closure of their links."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(t=low)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {percent} * (na.n + nb.n - k)),
        sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, t.b FROM reach r JOIN sym t ON r.b = t.a),
        c AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def repeated_passages_sql(length: int = 50) -> str:
    """All windows of ``length`` bytes, as hexadecimal digits, with the smallest document of each."""
    return f"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * length}) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d)),
        f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
        c AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE first < doc_id),
        marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM c),
        numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM numbered GROUP BY doc_id, r),
        before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
        cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM before JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""
