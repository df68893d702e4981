"""Registry of queries: name -> Spark function of (spark, sf_dir), and its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


# Pieces of SQL that several twins share.
TOKEN_SQL = r"[a-z0-9][a-z0-9_\-\.]*[a-z0-9]|[a-z0-9]"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_SQL}')"


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def n_words(x: str) -> str:
    t = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return rf"(CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '\s+')) END)"


def n_tokens(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE greatest(1, round_even({n_words(x)} * 1.33, 0)::INT) END)"


def sents(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    marked = rf"""regexp_replace({flat}, '([.!?])\s+([A-Z0-9`"''(\[])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def eviction(items: str, cap: int = 12, budget: int = 900) -> str:
    """CTEs from items(session, n, pos, priority, tokens), n from 1, to held(session, s, gone): what a working memory holds after its last item, and
    how many items it lost. The least by priority and time go until both limits hold, but one stays."""
    fits = f"list_filter(range(1, len(s) + 1), lambda k: k = len(s) OR (list_sum(list_transform(s[k:], lambda x: x.t)) <= {budget} AND len(s) - k + 1 <= {cap}))[1]"
    return f"""step AS (SELECT session, n, [{{'p': priority, 'at': pos, 't': tokens}}] AS s, 0 AS gone FROM {items} WHERE n = 1
 UNION ALL SELECT session, n, s[k:] AS s, gone + k - 1 AS gone FROM (SELECT *, {fits} AS k FROM (SELECT i.session, i.n, list_sort(list_append(r.s, {{'p': priority, 'at': pos, 't': tokens}})) AS s, gone FROM step r JOIN {items} i ON i.session = r.session AND i.n = r.n + 1))),
held AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1)"""


def truncated(source: str, keys: str, text: str, budget: int) -> str:
    """CTE cut(keys, short): texts cut to a budget of tokens."""
    return rf"""tl AS (SELECT {keys}, generate_subscripts(string_split({text}, chr(10)), 1) AS i, unnest(string_split({text}, chr(10))) AS line FROM {source} WHERE {n_tokens(text)} > {budget}),
tc AS (SELECT *, {n_tokens('line')} AS n, sum({n_tokens('line')}) OVER (PARTITION BY {keys} ORDER BY i) AS total FROM tl),
tx AS (SELECT {keys}, coalesce(min(i) FILTER (total > {budget}), 1000000000) AS k FROM tc GROUP BY {keys}),
tp AS (SELECT tc.*, CASE WHEN i < k THEN line ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''), 1, floor(({budget} - (total - n)) / 1.33)::INT), ' ') || ' …' END AS piece
 FROM tc JOIN tx USING ({keys}) WHERE i < k OR (i = k AND floor(({budget} - (total - n)) / 1.33)::INT > 3)),
cut AS (SELECT {keys}, coalesce(string_agg(piece, chr(10) ORDER BY i), '') AS short FROM tx LEFT JOIN tp USING ({keys}) GROUP BY {keys} UNION ALL SELECT {keys}, {text} FROM {source} WHERE {n_tokens(text)} <= {budget})"""


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
