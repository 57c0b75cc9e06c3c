"""Registered queries: each name has a Spark callable and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}

_DAY = "TIMESTAMP '2023-01-01' + to_days(CAST(doc_id * 7 % 700 AS INTEGER))"


def _list(values):
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _ctes():
    from engramlake.sources import bindings as b

    types, mix, etypes, rels = _list(b.MEMORY_TYPES), _list(b.STATUS_MIX), _list(b.EDGE_TYPES), _list(b.RELATIONS)
    notes = _list([t.replace("'", "''") for t in b.NOTE_TEMPLATES])
    return {
        "msg": """SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text,
                  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS created_at FROM conversations""",
        "mem": f"""SELECT doc_id AS memory_id, source AS topic, {types}[1 + doc_id // 6 % 6] AS memory_type, text AS content,
                  CAST(doc_id % 6 AS INTEGER) AS resolution, 0.3 + 0.1 * (doc_id % 7) AS importance, 0.5 + 0.1 * (doc_id % 5) AS confidence,
                  {mix}[1 + doc_id // 7 % 7] AS status, doc_id % 10 <> 9 AS is_current, {_DAY} AS valid_from,
                  CASE WHEN doc_id % 4 = 0 THEN {_DAY} + to_days(CAST(200 + doc_id % 300 AS INTEGER)) END AS valid_until,
                  doc_id // 10 AS conv_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id // 10 * 1000 + 1 END AS message_id,
                  {_DAY} AS created_at, {_DAY} + to_days(CAST(doc_id % 13 AS INTEGER)) AS updated_at,
                  CASE WHEN doc_id % 11 <> 0 THEN {_DAY} + to_days(CAST(doc_id % 50 AS INTEGER)) END AS last_accessed,
                  doc_id % 9 AS access_count FROM documents""",
        "edges": f"""SELECT doc_id AS src, (doc_id - 1) // 3 AS dst, {etypes}[1 + doc_id % 7] AS type, 0.3 + 0.1 * (doc_id % 7) AS strength, {_DAY} AS created_at
                  FROM documents WHERE doc_id >= 1
                  UNION ALL SELECT doc_id, doc_id - 11, {etypes}[1 + doc_id // 7 % 7], 0.2 + 0.1 * (doc_id % 8), {_DAY} FROM documents WHERE doc_id >= 11
                  UNION ALL SELECT (doc_id - 1) // 3, doc_id, {etypes}[1 + doc_id // 3 % 7], 0.5, {_DAY} FROM documents WHERE doc_id >= 1 AND (doc_id - 1) // 3 % 20 = 0""",
        "facts": f"""SELECT event_id AS fact_id, 'user_' || user_id AS entity, event_type AS property, 'v' || CAST(floor(value / 50) AS BIGINT) AS value,
                  'v' || CAST(floor(value / 70) AS BIGINT) AS old_value, ts, 'src' || event_id % 3 AS source, {rels}[1 + event_id % 8] AS relation,
                  CASE WHEN event_id % 5 = 0 THEN 'superseded' WHEN event_id % 17 = 0 THEN 'deprecated' ELSE 'active' END AS status,
                  'user_' || user_id || ' ' || event_type || ' is v' || CAST(floor(value / 50) AS BIGINT) AS raw FROM events""",
        "qry": """SELECT item_id AS query_id, text, 'src' || item_id % 20 AS topic, TIMESTAMP '2023-12-01' + to_days(CAST(item_id % 400 AS INTEGER)) AS asked_at FROM benchmark""",
        "notes": f"""SELECT event_id AS message_id, user_id * 100 + day(ts) AS conv_id, event_id AS turn,
                  CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
                  replace(replace(replace(replace(replace(replace({notes}[1 + event_id % 17], '{{u}}', 'U' || user_id), '{{p}}', event_type),
                  '{{v}}', 'v' || CAST(floor(value / 50) AS BIGINT)), '{{w}}', 'v' || CAST(floor(value / 70) AS BIGINT)),
                  '{{n}}', CAST(event_id % 30 + 1 AS VARCHAR)), '{{d}}', strftime(ts, '%-d %B %Y')) AS text,
                  ts AS created_at, 'user_' || user_id AS speaker FROM events""",
        "decs": """SELECT o_orderkey AS decision_id, o_custkey AS topic_id,
                  lower(o_orderpriority) || ' status-' || lower(o_orderstatus) || ' total-' || CAST(floor(o_totalprice / 100000) AS BIGINT) || ' year-' || year(o_orderdate) AS text,
                  o_orderdate AS decided_at, o_orderdate AS valid_from,
                  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders""",
    }


EXTRA_CTES: dict[str, str] = {}


def expand_sql(sql: str) -> str:
    """Prefix the logical tables a statement names and make decimal literals doubles."""
    known = {**_ctes(), **EXTRA_CTES}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"(?i)\b(from|join)\s+{name}\b|,\s*{name}\b(?=\s+[a-z]\b)", text):
                visit(known[name])
                needed.append(name)

    visit(sql)
    body = sql.strip().rstrip(";")
    recursive = False
    if re.match(r"(?i)with\s+recursive\s", body):
        recursive, body = True, re.sub(r"(?i)^with\s+recursive\s", "", body)
        joined = ", "
    elif re.match(r"(?i)with\s", body):
        body = re.sub(r"(?i)^with\s", "", body)
        joined = ", "
    else:
        joined = " "
    if needed:
        head = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed)
        body = ("WITH RECURSIVE " if recursive else "WITH ") + head + joined + body
    elif joined == ", ":
        body = ("WITH RECURSIVE " if recursive else "WITH ") + body
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", body)


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    import importlib
    import pkgutil

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda x: x.name):
        importlib.import_module(f"registry.{m.name}")
