"""Pieces of the SQL that checks the queries."""

# ruff: noqa: E501
from __future__ import annotations

BLANK = "E' \\n\\t\\r'"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(trim({c}, {BLANK}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {BLANK})), lambda x: x <> '')"


def bucket(t: str) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % 64)"


def sign(t: str) -> str:
    return f"(CASE WHEN ('0x' || substr(md5({t}), 9, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


def normalise(c: str) -> str:
    marked = f"regexp_replace(lower({c}), '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g')"
    bare = f"regexp_replace({marked}, chr(1) || '(a|an|the)' || chr(1), ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace(replace({bare}, chr(1), ''), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


SEPARATOR = "(CASE WHEN contains(text, E'\\n\\n') THEN E'\\n\\n' WHEN contains(text, E'\\n') THEN E'\\n' WHEN contains(text, '.') THEN '.' WHEN contains(text, '!') THEN '!' WHEN contains(text, '?') THEN '?' WHEN contains(text, ',') THEN ',' ELSE ' ' END)"


def greedy(size: int, overlap: int) -> str:
    """SELECT of parent_id, the documents' columns and chunks: the fold over pieces in a list_reduce."""
    return f"""
    SELECT doc_id AS parent_id, lang, source,
      list_transform(list_concat(f.chunks, CASE WHEN len(f.cur) > 0 THEN [f.cur] ELSE [] END), lambda c: list_reduce(c, lambda a, b: a || sep || b)) AS chunks
    FROM (SELECT *, list_reduce(
        list_transform(list_filter(string_split(text, sep), lambda p: p <> ''), lambda p: {{'chunks': []::VARCHAR[][], 'cur': [p], 'n': length(p)::BIGINT + wide}}),
        lambda s, e: CASE WHEN s.n + e.n > {size} AND len(s.cur) > 0 THEN
          {{'chunks': list_concat(s.chunks, [s.cur]),
            'cur': list_concat(s.cur[(len(s.cur) - {_kept('s.cur', overlap)} + 1):], e.cur),
            'n': (coalesce(list_sum(list_transform(s.cur[(len(s.cur) - {_kept('s.cur', overlap)} + 1):], lambda q: length(q) + wide)), 0) + e.n)::BIGINT}}
          ELSE {{'chunks': s.chunks, 'cur': list_concat(s.cur, e.cur), 'n': s.n + e.n}} END,
        {{'chunks': []::VARCHAR[][], 'cur': []::VARCHAR[], 'n': 0::BIGINT}}) AS f
      FROM (SELECT *, length(sep)::BIGINT AS wide FROM (SELECT *, {SEPARATOR} AS sep FROM documents)))"""


def _kept(cur: str, overlap: int) -> str:
    """How many pieces at the end of cur fit into the overlap."""
    return f"len(list_filter(range(1, len({cur}) + 1), lambda i: list_sum(list_transform({cur}[(len({cur}) - i + 1):], lambda q: length(q) + wide)) <= {overlap}))"


def packed(size: int) -> str:
    return f"""
    SELECT doc_id AS parent_id, lang, source,
      list_transform(list_concat(f.chunks, CASE WHEN len(f.cur) > 0 THEN [f.cur] ELSE [] END), lambda c: array_to_string(c, ' ')) AS chunks
    FROM (SELECT *, list_reduce(
        list_transform({sentences('text')}, lambda p: {{'chunks': []::VARCHAR[][], 'cur': [p], 'n': length(p)::BIGINT}}),
        lambda s, e: CASE WHEN s.n + e.n > {size} AND len(s.cur) > 0 THEN {{'chunks': list_concat(s.chunks, [s.cur]), 'cur': e.cur, 'n': e.n + 1}}
          ELSE {{'chunks': s.chunks, 'cur': list_concat(s.cur, e.cur), 'n': s.n + e.n + 1}} END,
        {{'chunks': []::VARCHAR[][], 'cur': []::VARCHAR[], 'n': 0::BIGINT}}) AS f FROM documents)"""


def fan(chunks: str, extra: str = "") -> str:
    return f"SELECT parent_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS chunk_index, {extra} unnest(chunks) AS content FROM ({chunks})"


def merge_small(c: str, least: int) -> str:
    return f"""list_reduce(list_transform({c}, lambda x: [x]), lambda s, e:
      CASE WHEN len(s) > 0 AND length(s[len(s)]) + length(e[1]) < {least} THEN list_concat(s[1:(len(s) - 1)], [s[len(s)] || ' ' || e[1]]) ELSE list_concat(s, e) END, []::VARCHAR[])"""


def bm25(docs: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs tok .. scored(query_id, id, score) of all benchmark items over docs."""
    return f"""
    tok AS (SELECT {key} AS id, unnest({tokens(text)}) AS term FROM {docs}),
    post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dls AS (SELECT id, count(*) AS dl FROM tok GROUP BY ALL),
    cor AS (SELECT (SELECT count(*) FROM {docs})::DOUBLE AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM {docs}) AS avgdl),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
    ask AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
    scored AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
      FROM ask JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (id) CROSS JOIN cor GROUP BY ALL)"""


def top(source: str, k: int, by: str = "query_id", score: str = "score", key: str = "id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {key}) AS rank FROM {source}) WHERE rank <= {k})"


def hash_vectors(source: str, key: str, text: str, name: str) -> str:
    """CTEs {name}w(key, b, w) unit weights by bucket."""
    return f"""
    {name}t AS (SELECT {key} AS k, unnest({tokens(text)}) AS t FROM {source}),
    {name}s AS (SELECT k, {bucket('t')} AS b, sum({sign('t')})::DOUBLE AS w FROM {name}t GROUP BY ALL),
    {name}w AS (SELECT k, b, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}s)"""
