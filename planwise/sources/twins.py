"""SQL for DuckDB: the input frames as common table expressions, and statements that find those they need."""

from __future__ import annotations

import re

from .adapters import TABLES, TEMPLATES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Name to statement, each using earlier ones only.
FRAMES: dict[str, str] = {
    "catalog": " union all ".join(
        f"select {quoted(t)} as tab, c.col, c.ordinal, c.type, (select count(*) from {t}) as rows from (values {', '.join(f'({quoted(c)}, {i}, {quoted(k)})' for i, (c, k) in enumerate(columns.items(), 1))}) c(col, ordinal, type)"
        for t, columns in TABLES.items()
    ),
    "query_log": f"""
        select event_id as query_id, (event_id % {len(TEMPLATES)})::int as template_id, datediff('day', date '2024-01-01', ts::date)::int as round_id, ts,
          replace(list_extract([{', '.join(map(quoted, TEMPLATES))}], (event_id % {len(TEMPLATES)} + 1)::int), '{{k}}', json_extract_string(props, '$.k')) as sql,
          1 + (event_id * 7919) % 1000 as freq, value as latency, user_id from events""",
    "workload": "select min(query_id) as query_id, template_id, sql, sum(freq)::bigint as freq, count(*) as n from query_log group by template_id, sql",
    "measures": "select event_type as component, datediff('day', date '2024-01-01', ts::date)::int as batch, list_extract(['execution', 'creation', 'total'], (user_id % 3 + 1)::int) as name, value from events",
    "predictions": """
        select o_orderkey as id, o_totalprice as truth, round(pred, 4) as pred from orders join (
          select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as pred from lineitem group by l_orderkey) on o_orderkey = l_orderkey
        where o_totalprice > 0 and pred > 0""",
}


def frame(name: str, sql: str) -> None:
    FRAMES[name] = sql


def with_frames(body: str) -> str:
    """The statement, after the frames that it names, directly or by another frame."""
    wanted: list[str] = []

    def add(text: str, within: tuple[str, ...] = ()) -> None:
        for name in sorted(set(re.findall(r"[a-z_]+", text)) & FRAMES.keys() - {*wanted, *within}):
            add(FRAMES[name], (*within, name))
            if name not in wanted:
                wanted.append(name)

    add(body)
    if not wanted:
        return body
    head = ",\n".join(f"{n} as ({FRAMES[n]})" for n in wanted)
    return f"with recursive {head}\n{body}"
