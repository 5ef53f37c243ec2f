"""The order-dependent folds as recursive SQL for DuckDB, to compare the operators with."""

from __future__ import annotations

from loomline.functions.text import LONGEST_PHRASE

#: White space as Python splits words at it.
PY_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrases(source: str, key: str, text: str, name: str = "said") -> str:
    """CTEs up to ``name``(key, text): repeated phrases dropped (W13). ``source`` has ``key`` and ``text``, null texts none."""
    return f"""
        {name}_t AS (SELECT {key}, {text} AS own, list_filter(string_split_regex({text}, '{PY_WS}+'), lambda w: w <> '') AS ts FROM {source} WHERE {text} IS NOT NULL),
        {name}_k AS (SELECT *, list_transform(ts, lambda t: translate(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+$', ''), '{_UPPER}', '{_LOWER}')) AS ks FROM {name}_t),
        {name}_w AS (
            SELECT {key}, own, ts, ks, [1] AS kept, 2 AS place, 0 AS size FROM {name}_k WHERE len(ts) > 1
            UNION ALL
            SELECT {key}, own, ts, ks, CASE WHEN hit > 0 THEN kept ELSE list_append(kept, place) END, place + greatest(hit, 1), hit FROM (
                SELECT *, coalesce(list_max(list_filter(range(1, least({LONGEST_PHRASE}, len(kept), len(ts) - place + 1) + 1), lambda s: list_transform(kept[len(kept) - s + 1 : len(kept)], lambda k: ks[k]) = ks[place : place + s - 1])), 0) AS hit
                FROM {name}_w WHERE place <= len(ts))
        ),
        {name} AS (
            SELECT {key}, array_to_string(list_transform(kept, lambda k: ts[k]), ' ') AS text FROM {name}_w WHERE place > len(ts)
            UNION ALL SELECT {key}, own FROM {name}_t WHERE len(ts) < 2
        )"""


def filled(source: str, key: str, order: str, words: str, target: int, name: str = "filled") -> str:
    """CTEs up to ``name``: rows of ``source`` with ``ordinal``, the chunk they fall in when a chunk ends at ``target`` words."""
    return f"""
        {name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n, {words} AS k FROM {source}),
        {name} AS (
            SELECT *, 0 AS ordinal, k AS total FROM {name}_n WHERE n = 1
            UNION ALL
            SELECT s.*, w.ordinal + CASE WHEN w.total >= {target} THEN 1 ELSE 0 END, s.k + CASE WHEN w.total >= {target} THEN 0 ELSE w.total END
            FROM {name} w JOIN {name}_n s ON s.{key} = w.{key} AND s.n = w.n + 1
        )"""


def written(source: str, key: str, text: str, ws: str, words, target: int, most: int, name: str = "written") -> str:
    """CTEs up to ``name``(key, ordinal, text): written notes at headings and blank lines."""
    return f"""
        {name}_l AS (SELECT {key}, unnest(string_split_regex({text}, '\\r?\\n')) AS line, generate_subscripts(string_split_regex({text}, '\\r?\\n'), 1) AS i FROM {source}),
        {name}_m AS (SELECT *, regexp_replace(line, '^{ws}+|{ws}+$', '', 'g') AS bare FROM {name}_l),
        {name}_g AS (SELECT *, sum(CASE WHEN bare = '' OR starts_with(bare, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM {name}_m),
        {name}_b AS (SELECT {key}, g, string_agg(line, chr(10) ORDER BY i) AS block, max(CASE WHEN starts_with(bare, '#') THEN 1 ELSE 0 END) AS head FROM {name}_g WHERE bare <> '' GROUP BY {key}, g),
        {name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY g) AS n, {words("block")} AS k FROM {name}_b),
        {name}_w AS (
            SELECT *, 0 AS ordinal, k AS total, k >= {target} AS full FROM {name}_n WHERE n = 1
            UNION ALL
            SELECT {key}, g, block, head, n, k, ordinal, total, total >= {target} FROM (
                SELECT s.*, w.ordinal + CASE WHEN w.full OR s.head = 1 OR w.total + s.k > {most} THEN 1 ELSE 0 END AS ordinal,
                    s.k + CASE WHEN w.full OR s.head = 1 OR w.total + s.k > {most} THEN 0 ELSE w.total END AS total
                FROM {name}_w w JOIN {name}_n s ON s.{key} = w.{key} AND s.n = w.n + 1)
        ),
        {name} AS (SELECT {key}, CAST(ordinal AS INTEGER) AS ordinal, string_agg(block, chr(10) || chr(10) ORDER BY n) AS text FROM {name}_w GROUP BY {key}, ordinal)"""
