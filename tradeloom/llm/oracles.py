"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tradeloom.llm.quality_rules import RULES

_SPACE = r"[\x20\x09-\x0D]"
_LEVELS = "\n    UNION ALL ".join(
    f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {k} AS rank, {part} AS part, {whole} AS whole FROM counted"
    for k, (rule, (part, whole)) in enumerate(RULES.items())
)

QUALITY_RULES = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts)),
windows AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word, b, c) AS times FROM (
    SELECT doc_id, pos, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ) WHERE c IS NOT NULL),
repeated AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
    FROM windows, range(3) AS r(k) WHERE times > 1 GROUP BY doc_id),
counted AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
        SELECT doc_id, stratum, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
            length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
            n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words,
            length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
            length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
            length(regexp_replace(t, '[^|]', '', 'g')) AS n_pipes
        FROM texts LEFT JOIN repeated USING (doc_id))),
levels AS (SELECT *, CASE WHEN whole > 0 THEN least(ceil(100 * part / whole), 101) ELSE 0 END AS level FROM (
    {_LEVELS})),
marked AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
learned AS (SELECT unnest([stratum, NULL]) AS stratum, rule, level, (quality = 1)::INT AS good
    FROM levels JOIN marked USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT greatest(1, count(DISTINCT coalesce(stratum, '*'))) * {len(RULES)} AS n FROM learned),
rejected AS (SELECT stratum, rule, c, sum(good) AS n, sum((level > c)::INT * good) AS k, sum((level > c)::INT * (1 - good)) AS bad
    FROM learned, range(101) AS r(c) GROUP BY ALL),
judged AS (SELECT *, (SELECT sum(exp(
            CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) END
            + j * ln({0.05 / len(RULES)!r}) + (n - j) * ln(1 - {0.05 / len(RULES)!r})))
        FROM range(k::BIGINT + 1) AS r(j)) <= 0.05 / (SELECT n FROM tests) AS valid FROM rejected),
strictest AS (SELECT stratum, rule, arg_min(bad, c) AS most FROM judged WHERE valid GROUP BY ALL),
cutoffs AS (SELECT j.stratum, j.rule, max(c) AS cutoff FROM judged j JOIN strictest s
    ON j.rule = s.rule AND j.stratum IS NOT DISTINCT FROM s.stratum WHERE most > 0 AND bad >= 0.98 * most GROUP BY ALL),
hits AS (SELECT l.doc_id, string_agg(l.rule, ',' ORDER BY l.rank) AS rejected_by
    FROM levels l LEFT JOIN cutoffs own ON own.rule = l.rule AND own.stratum = l.stratum
    LEFT JOIN cutoffs every ON every.rule = l.rule AND every.stratum IS NULL
    WHERE whole > 0 AND 100 * part > coalesce(own.cutoff, every.cutoff) * whole GROUP BY l.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM counted LEFT JOIN hits USING (doc_id)
"""

_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_BARE = "replace(found, ' ', '')"

PII = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern, alone, context) AS (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '', ''),
    (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', '', ''),
    (2, 'card', '[0-9](?:[\x20-]?[0-9])+', '', ''),
    (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', '', ''),
    (4, 'iban', '[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?', '[A-Za-z0-9]', ''),
    (5, 'local_phone', '\(?[0-9]{{3}}\)?[\x20.-][0-9]{{3}}[.-][0-9]{{4}}', '[0-9+.-]', 'phone|tel|call|mobile|fax|telefon|telefono|téléphone'),
    (6, 'ssn', '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}', '[0-9-]', 'ssn|social security')),
matched AS (SELECT doc_id, t, rank, kind, alone, context, regexp_extract_all(t, pattern) AS f, regexp_split_to_array(t, pattern) AS g
    FROM texts, kinds),
placed AS (SELECT doc_id, t, rank, kind, alone, context, f[i] AS found, s, s + length(f[i]) AS e FROM (
    SELECT *, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM matched))),
confirmed AS (SELECT * FROM placed WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(found, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right('0' || p, 4)::INT > 255)) = 0
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
        lambda i: CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT
            ELSE 2 * substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT
                - 9 * (substr({_DIGITS}, length({_DIGITS}) - i + 1, 1)::INT > 4)::INT END)) % 10 = 0
    WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''),
        lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)::INT - 1)),
        lambda rest, v: (rest * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    ELSE true END
    AND (alone = '' OR NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || chr(10) || substr(t, e + 1, 1), alone))
    AND (context = '' OR regexp_matches(lower(substr(t, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0)) || chr(10) || substr(t, e + 1, 30)),
        '(^|[^\p{{L}}])(' || context || ')([^\p{{L}}]|$)'))),
kept AS (SELECT * FROM confirmed c WHERE rank < 4 OR NOT EXISTS (
    SELECT 1 FROM confirmed b WHERE b.doc_id = c.doc_id AND b.rank < 4 AND b.s < c.e AND c.s < b.e)),
spelled AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || e AS span FROM kept)
SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM texts LEFT JOIN spelled USING (doc_id) GROUP BY doc_id
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = rf"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS found FROM documents),
held AS (SELECT d, doc_id, found, len(found) AS n FROM counted WHERE len(found) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held),
tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(found) AS term FROM held) GROUP BY d, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
scored AS (SELECT item_id, h.doc_id, d,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN held h USING (d), whole GROUP BY item_id, h.doc_id, d),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

_MERKLE_LEVELS = 6


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _merkle_levels(name: str) -> str:
    """Levels ``name``0.. of trees, and for each node what stands before and after it in its run."""
    parts = []
    for k in range(_MERKLE_LEVELS):
        parts.append(f"""{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (n + 15) // 16 AS n
    FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 16, n)""")
        parts.append(f"""{name}_by{k} AS (SELECT x.tree, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before,
        coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
    FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.pos // 16 = y.pos // 16 WHERE x.n > 1 GROUP BY x.tree, x.pos)""")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(_MERKLE_LEVELS + 1))
    return ",\n".join([*parts, f"{name}_roots AS ({tops})"])


def _merkle_fold(name: str, levels: str) -> str:
    return ",\n".join(
        f"""{name}{k + 1} AS (SELECT p.* REPLACE (p.pos // 16 AS pos, coalesce(sha256(before || f || after), f) AS f,
        proof || coalesce(before || after, '') AS proof) FROM {name}{k} p LEFT JOIN {levels}_by{k} s ON s.tree = p.tree AND s.pos = p.pos)"""
        for k in range(_MERKLE_LEVELS)
    )


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""

MERKLE_MANIFEST = f"""
WITH leaves AS (SELECT doc_id, tree, leaf, tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n
    FROM (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
        CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
        FROM documents)),
a0 AS (SELECT tree, pos, leaf AS h, n FROM leaves),
{_merkle_levels("a")},
b0 AS (SELECT '' AS tree, tree AS source_key, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM a_roots),
{_merkle_levels("b")},
p0 AS (SELECT doc_id, tree, pos, leaf, coalesce(tampered, leaf) AS f, '' AS proof FROM leaves),
{_merkle_fold("p", "a")},
q0 AS (SELECT p.* REPLACE ('' AS tree, b.pos AS pos), b.h AS subroot FROM p{_MERKLE_LEVELS} p JOIN b0 b ON b.source_key = p.tree),
{_merkle_fold("q", "b")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{_MERKLE_LEVELS}, b_roots
"""

ORACLES = {
    "op2_quality_rules": QUALITY_RULES, "op10_pii": PII, "op11_lexical_search": LEXICAL_SEARCH,
    "op12_merkle_manifest": MERKLE_MANIFEST,
}
