"""DuckDB SQL that the registered queries must agree with, where SQL can express them."""

from __future__ import annotations

from handbill.llm import line_dedup, mixing, quality, variants
from handbill.llm.common import LOWER, UPPER

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
    ), f AS (
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
               min(page_id) OVER (PARTITION BY sha256(html)) AS first_id
        FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
"""

OP9 = f"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
        SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
    ), k AS (
        SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS key FROM l
    ), s AS (
        SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {line_dedup.MIN_KEY_CHARS}
        GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS}
    ), m AS (
        SELECT rid, k.doc_id, line, pos, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN s ON k.key = s.key
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY rid
"""

OP2 = f"""
    WITH d AS (
        SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS hash FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
               [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
        FROM s
    ), c AS (
        SELECT *, {mixing.MAX_RATIO} * source_size / weight AS cap FROM w
    ), b AS (
        SELECT *, (SELECT sum(source_size) FROM c) - {mixing.MAX_RATIO} * coalesce(sum(source_size) OVER earlier, 0) AS rest,
               (SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER earlier, 0) AS among
        FROM c WINDOW earlier AS (ORDER BY cap, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
        SELECT source, source_size,
               least(CAST({mixing.MAX_RATIO} * source_size AS DOUBLE), (SELECT first(rest / among ORDER BY cap, place) FROM b WHERE rest / among <= cap) * weight) AS target
        FROM b
    ), r AS (
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
               CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce('s' || d.source, 't')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS shift,
               CAST(row_number() OVER (PARTITION BY d.source ORDER BY lpad(CAST(length(CAST(size AS VARCHAR)) AS VARCHAR), 2, '0') || rpad(substr(CAST(size AS VARCHAR), 1, 2), 2, '0'), hash, size) AS DOUBLE) AS n
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), o AS (
        SELECT *, least({mixing.MAX_RATIO}, CAST(floor(n * rate + shift) - floor((n - 1) * rate + shift) AS BIGINT)) AS copies FROM r
    )
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM o
"""


def _common(lang: str) -> str:
    counts = [f"len(list_filter(words, lambda x: x IN ('{w}', '{w.upper()}', '{w.capitalize()}')))" for w in quality.COMMON[lang]]
    return f"WHEN '{lang}' THEN [{', '.join(counts)}]"


def _distance(p: str, q: str, size: int) -> str:
    """The Jensen-Shannon distance of two lists of counts, null if either is null or adds up to 0."""
    term = lambda x, i: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({_share(p, i)} + {_share(q, i)}) / 2)) ELSE 0 END"
    terms = " + ".join(term(_share(x, i), i) for i in range(1, size + 1) for x in (p, q))
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, ({terms}) / 2)) END"


def _share(x: str, i: int) -> str:
    return f"(CAST({x}[{i}] AS DOUBLE) / CAST(list_sum({x}) AS DOUBLE))"


_SUMS = ", ".join(f"CAST(sum(chars[{i + 1}]) AS DOUBLE)" for i in range(len(quality.CLASSES)))
_COMMON_SUMS = ", ".join(f"CAST(sum(commons[{i + 1}]) AS DOUBLE)" for i in range(quality.N_COMMON + 1))

OP10 = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {WORDS} AS words FROM documents
    ), g AS (
        SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
    ), e AS (
        SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1
    ), h AS (
        SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM e) GROUP BY rid
    ), n AS (
        SELECT d.rid, doc_id, lang, text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words,
               CASE lang {" ".join(map(_common, quality.COMMON))} END AS commons,
               len(regexp_extract_all(text, '\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '\p{{Nd}}')) AS digits
        FROM d LEFT JOIN h ON d.rid = h.rid
    ), m AS (
        SELECT rid, doc_id, lang, n_words, word_chars, n_symbols, n_repeat_words, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               [upper, digits, length(text) - word_chars, n_symbols, octet_length(encode(text)) - length(text)] AS five, length(text) AS n_all,
               list_append(commons, n_words - list_sum(commons)) AS commons
        FROM n
    ), q AS (
        SELECT *, list_append(five, greatest(0, n_all - list_sum(five))) AS chars FROM m
    ), r AS (
        SELECT lang AS ref_lang, sum(n_words) AS ref_words, [{_SUMS}] AS ref_chars, [{_COMMON_SUMS}] AS ref_commons
        FROM q WHERE lang IS NOT NULL GROUP BY lang
    ), j AS (
        SELECT *, round(CASE WHEN ref_words >= {quality.MIN_REFERENCE_WORDS} AND word_chars >= {quality.MIN_CHARS_JUDGED} THEN {_distance("chars", "ref_chars", len(quality.CLASSES))} END, 6) AS char_distance,
               round(CASE WHEN ref_words >= {quality.MIN_REFERENCE_WORDS} AND n_words >= {quality.MIN_WORDS_JUDGED} THEN {_distance("commons", "ref_commons", quality.N_COMMON + 1)} END, 6) AS word_distance,
               n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
        FROM q LEFT JOIN r ON lang = ref_lang
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(char_distance > {quality.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(word_distance > {quality.MAX_WORD_DISTANCE}, false) AS kept,
           char_distance, word_distance
    FROM j
"""

#: A checksum step a value: a byte is mixed in, -1 shifts by one bit.
_CRC = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"

OP12 = rf"""
    WITH RECURSIVE o AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents
    ), b AS (
        SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS code FROM o GROUP BY ALL
    ), s AS (
        SELECT run, k, xor(4294967295, list_reduce(flatten(list_prepend([4294967295], list_transform(range(length(code) // 2),
               lambda i: [CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), {_CRC})) AS h
        FROM b
    ), c AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
        FROM s GROUP BY 1 HAVING length(word) >= {variants.MIN_CHARS} AND sum(k) >= {variants.MIN_COUNT}
    ), p AS (
        SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c
    ), w AS (
        SELECT word, n, i, substr(word, 1, i - 1) AS pre, substr(word, i + 1) AS post FROM p
    ), e AS (
        SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM w a JOIN w b ON a.i = b.i AND a.pre = b.pre AND a.post = b.post AND a.word <> b.word
        UNION
        SELECT w.word, w.n, c.word, c.n FROM w JOIN c ON pre || post = c.word
        UNION
        SELECT c.word, c.n, w.word, w.n FROM w JOIN c ON pre || post = c.word
    ), f AS (
        SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY ALL
    ), t AS (
        SELECT word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {variants.RATIO} * c.n THEN near END AS form,
               CASE WHEN near_n >= {variants.RATIO} * c.n THEN near_n END AS form_n
        FROM c LEFT JOIN f USING (word)
    ), r AS (
        SELECT word, word AS root, 0 AS step FROM t
        UNION ALL
        SELECT r.word, form, step + 1 FROM r JOIN t ON r.root = t.word WHERE form IS NOT NULL
    )
    SELECT word, form, (SELECT arg_max(root, step) FROM r WHERE r.word = t.word) AS root, n, n_near, form_n FROM t
"""

SQL = {"op2_mixing": OP2, "op5_warc": OP5, "op9_line_dedup": OP9, "op10_quality": OP10, "op12_variants": OP12}
