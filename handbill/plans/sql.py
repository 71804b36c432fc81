"""What the registered queries share: their register, the moment they are asked at, and pieces of SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from handbill.functions import vocab
from handbill.sources import star

NOW = datetime(1998, 6, 17, 12)
#: The same moment as UTC fields.
NOW_UTC = datetime(1998, 6, 17, 19)
SUNDAY = datetime(1998, 6, 21, 10)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL over the star schema's listings if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {star.SQL_TABLES.strip()} {sql}"
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str) -> str:
    return quoted(p)


LIVE = "(u_last >= TIMESTAMP '1998-06-17 12:00:00' OR u_last IS NULL)"
DESCRIBED = "coalesce(title, '') || ' ' || chr(10) || ' ' || coalesce(description, '')"
TYPES = f"lower({DESCRIBED})"


def norm_sql(c: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    for p in vocab.TITLE_PREFIXES:
        out = f"regexp_replace({out}, {quoted('^' + p)}, '')"
    return out


def id_sql(venue: str, start: str, title: str) -> str:
    norm, day = norm_sql(title), f"substr(coalesce({start}, ''), 1, 10)"
    slug = f"regexp_replace(substr(regexp_replace({norm}, '[^a-z0-9-]', '-', 'g'), 1, 40), '^-+|-+$', '', 'g')"
    return f"concat_ws('-', {venue}, {day}, nullif({slug}, ''), substr(sha1(concat_ws('|', {venue}, {day}, {norm})), 1, 10))"


def kind_sql(default: str = "'other'") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({TYPES}, {pattern(p)}) THEN '{k}'" for k, p in vocab.TYPE_PATTERNS) + f" ELSE {default} END"


def kinds_sql() -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({TYPES}, {pattern(p)}) THEN '{k}' END" for k, p in vocab.TYPE_PATTERNS) + ")"


SHOWN = "seq, venue_id, title, start, \"end\""


def shown(df: DataFrame) -> DataFrame:
    return df.select("seq", "venue_id", "title", "start", "end")


def window_sql(first: str, last: str, now: str = "1998-06-17 12:00:00", more: str = "") -> str:
    return f"""
        SELECT {SHOWN.replace('venue_id', 'p.venue_id')} FROM placed p JOIN venue v ON p.venue_id = v.id
        WHERE (u_last >= TIMESTAMP '{now}' OR u_last IS NULL) AND s_wall IS NOT NULL AND u_last >= TIMESTAMP '{first}' AND s_wall <= TIMESTAMP '{last}' {more}"""


def money_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN '$' || CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('$%.2f', {x}) END"


def range_sql(a: str) -> str:
    low, high = f"list_min({a})", f"list_max({a})"
    return f"CASE WHEN {low} = {high} THEN {money_sql(low)} ELSE {money_sql(low)} || '–' || {money_sql(high)} END"


AMOUNTS = "list_transform(regexp_extract_all({t}, '\\$\\s?(\\d{{1,4}}(?:\\.\\d{{2}})?)', 1), lambda x: CAST(x AS DOUBLE))"


def word_price_sql(source: str) -> str:
    paid = f"regexp_matches(t, {pattern(vocab.PAID_HINT)}, 'i')"
    phrase, word = (f"regexp_matches(t, {pattern(p)}, 'i') AND NOT {paid}" for p in (vocab.FREE_PHRASE, vocab.FREE_WORD))
    return f"""SELECT key, CASE WHEN {phrase} OR (len(a) = 0 AND {word}) THEN true END AS is_free,
        CASE WHEN {phrase} THEN 'Free' WHEN len(a) > 0 THEN {range_sql('a')} WHEN {word} THEN 'Free' END AS price_text
        FROM (SELECT key, t, {AMOUNTS.format(t='t')} AS a FROM ({source}))"""


def after(ctes: str, select: str) -> str:
    return f", {ctes} {select}"


def escaped_sql(c: str) -> str:
    return f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ','), chr(10), chr(92) || 'n')"
