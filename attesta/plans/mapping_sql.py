"""Plain SQL twins of the derived tables, used by the check queries only."""

from __future__ import annotations

from attesta.functions.vocabulary import (
    AUTHORITY_CLASSES, MAPPED_CURRENTNESS, SOURCE_KINDS, SURFACES, WORK_ROLES, WORK_SURFACES, WORK_TYPES)


def _pick(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], CAST({index} % {len(values)} + 1 AS INT))"


TABLES = {
    "raw_sources": f"""
      SELECT source_id, 'Source ' || n AS title, {_pick(SURFACES, 'n')} AS surface,
             {_pick(SOURCE_KINDS, 'n')} AS source_kind, {_pick(AUTHORITY_CLASSES, 'n')} AS authority_class,
             'p' || (n % 4) AS project_id, 'loc:' || source_id AS locator,
             CASE WHEN n % 5 = 0 THEN '' ELSE 'r' || (n % 3) END AS revision,
             '2024-01-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') AS as_of,
             {_pick(MAPPED_CURRENTNESS, 'n')} AS currentness,
             CASE WHEN n % 2 = 0 THEN '' ELSE 'public' END AS privacy,
             CASE WHEN n % 6 = 0 THEN '' ELSE substr(sha256(source_id), 1, 16) END AS content_hash, n
      FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INT) AS n FROM documents)""",
    "src": """
      SELECT source_id, title, surface, source_kind, authority_class, project_id, locator,
             nullif(revision, '') AS revision, as_of, currentness,
             coalesce(nullif(privacy, ''), 'private') AS privacy, nullif(content_hash, '') AS content_hash, n
      FROM raw_sources""",
    "cur": """
      SELECT source_id, title, surface, source_kind, authority_class, project_id, locator,
             CASE WHEN n % 3 = 0 THEN 'r9' ELSE revision END AS revision,
             CASE WHEN n % 3 = 0 THEN '2024-03-01' ELSE as_of END AS as_of, currentness, privacy, content_hash, n
      FROM src""",
    "raw_items": """
      SELECT d.doc_id, 'd' || d.doc_id AS item_id, d.source AS source_id,
             CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang END AS project_id,
             CASE WHEN d.doc_id % 97 = 5 THEN 'MYSTERY' WHEN d.doc_id % 10 = 3 THEN 'IMPLEMENTATION_FACT'
                  WHEN d.doc_id % 10 = 7 THEN 'HUMAN_LENS' WHEN l.quality = 1 THEN 'RESEARCH_RESULT'
                  WHEN l.quality = 0 THEN 'HYPOTHESIS' ELSE 'UNKNOWN' END AS item_type,
             d.text AS claim, 's' || (d.doc_id % 5) AS source_section,
             CASE WHEN d.doc_id % 13 = 0 THEN 'open PR branch' ELSE '' END AS source_status,
             CASE WHEN d.doc_id % 11 = 0 THEN 'verified' WHEN d.doc_id % 2 = 0 THEN '' ELSE 'HYPOTHESIS' END
               AS epistemic_state,
             CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE CAST(d.doc_id % 10 AS VARCHAR) END AS confidence,
             CASE WHEN d.doc_id % 5 = 0 THEN '2024-02-02' ELSE '' END AS as_of,
             CASE WHEN d.doc_id % 25 = 0 AND d.doc_id > 0 THEN 'd' || (d.doc_id - 1) ELSE '' END
               AS supersedes_item_id
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "items": """
      SELECT r.doc_id, r.item_id, r.source_id, coalesce(nullif(r.project_id, ''), s.project_id) AS project_id,
             r.item_type, r.claim, r.source_section, nullif(r.source_status, '') AS source_status,
             coalesce(nullif(r.epistemic_state, ''), 'SOURCE_ASSERTION') AS epistemic_state,
             CAST(NULL AS VARCHAR) AS authority_scope, CAST(NULL AS VARCHAR) AS validity,
             TRY_CAST(nullif(r.confidence, '') AS DOUBLE) AS confidence,
             coalesce(nullif(r.as_of, ''), s.as_of) AS as_of,
             nullif(r.supersedes_item_id, '') AS supersedes_item_id, CAST(NULL AS VARCHAR) AS provenance,
             s.title AS source_title, s.surface AS source_surface, s.source_kind AS source_kind,
             s.authority_class AS source_authority_class, s.revision AS source_revision,
             s.as_of AS source_as_of, s.currentness AS source_currentness,
             s.content_hash AS source_content_hash
      FROM raw_items r LEFT JOIN src s ON s.source_id = r.source_id""",
    "edges": """
      SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS edge_id,
             'o' || l_orderkey AS from_item_id, 'p' || l_partkey AS to_item_id,
             CASE l_returnflag WHEN 'R' THEN 'DERIVED_FROM' WHEN 'A' THEN 'SUPPORTS' ELSE 'RELATED_TO' END
               AS relation_type, l_orderkey, l_partkey, l_linenumber
      FROM lineitem""",
    "revs": """
      SELECT o_custkey AS logical_id, o_orderkey AS revision_no, o_orderdate AS at_time, o_orderstatus AS status,
             CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, o_orderpriority AS priority
      FROM orders""",
    "wi": f"""
      SELECT 'w' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS work_id, CAST(c_nationkey AS BIGINT) AS project_id,
             c_mktsegment AS thread, {_pick(WORK_TYPES, 'o_orderkey')} AS type,
             CASE WHEN o_orderkey % 10 = 6 THEN 'CURRENT' WHEN o_orderkey % 10 = 7 THEN 'BLOCKED'
                  WHEN o_orderkey % 10 = 8 THEN 'RESOLVED' WHEN o_orderkey % 10 = 9 THEN 'UNKNOWN'
                  WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'P' THEN 'IN_PROGRESS'
                  ELSE 'COMPLETED' END AS status,
             CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'P0' WHEN '2' THEN 'P1' WHEN '3' THEN 'P2'
                  WHEN '4' THEN 'P3' ELSE 'TAIL' END AS priority,
             'order ' || o_orderkey AS title,
             CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'note ' || o_orderkey END AS status_note,
             CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '  ' ELSE 'ship ' || o_orderkey END
               AS next_action,
             strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL
                  ELSE strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS resolved_at,
             CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS archived_at,
             o_orderkey AS order_key
      FROM orders JOIN customer ON c_custkey = o_custkey""",
    "ws": f"""
      SELECT 's' || s_suppkey AS source_id, CAST(s_nationkey AS BIGINT) AS project_id,
             {_pick(WORK_SURFACES, 's_suppkey')} AS surface, {_pick(WORK_ROLES, 's_suppkey')} AS role,
             s_name AS title, 'loc:' || s_suppkey AS locator
      FROM supplier""",
    "gov": """
      SELECT event_id, ts, user_id AS scope,
             CASE event_type WHEN 'click' THEN 'MODEL_PROPOSAL' WHEN 'purchase' THEN 'USER_DECISION'
                  WHEN 'error' THEN 'RESEARCH_CLAIM' WHEN 'view' THEN 'QUERY_RESUME' ELSE 'OPEN_LOOP' END AS event_type,
             CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS parity
      FROM events""",
    "msg": """
      SELECT conv_id || ':' || turn AS message_id, conv_id, turn, role,
             CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'MODEL' WHEN 'system' THEN 'TOOL'
                  ELSE 'UNKNOWN' END AS speaker, text
      FROM conversations""",
    "parts": r"""
      SELECT message_id, conv_id, turn, speaker, text, unnest(pieces) AS piece,
             unnest(range(len(pieces))) AS pos
      FROM (SELECT *, regexp_extract_all(text, '[^.\n]*[.\n]+|[^.\n]+') AS pieces FROM msg)""",
    "atoms": """
      SELECT message_id, conv_id, turn, speaker, text, piece, pos, start_at, start_at + length(piece) AS end_at
      FROM (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY message_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM parts)""",
    "halves": r"""
      SELECT message_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos
      FROM (SELECT message_id, regexp_extract_all(text, '[^.,\n]*[.,\n]+|[^.,\n]+') AS pieces FROM msg)""",
    "preds": """
      SELECT message_id, pos, start_at, start_at + length(piece) AS end_at
      FROM (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY message_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM halves)""",
}
DEPENDS = {"src": ("raw_sources",), "cur": ("src",), "items": ("raw_items", "src"), "parts": ("msg",),
           "atoms": ("parts",), "halves": ("msg",), "preds": ("halves",)}


def with_tables(needs: tuple[str, ...], body: str) -> str:
    """``WITH`` list of the needed tables, dependencies first, in front of ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        add(need)
    body = body.strip()
    if not ordered:
        return body
    shared = ",\n".join(f"{name} AS ({TABLES[name]})" for name in ordered)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {shared},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {shared},\n{body[5:]}"
    return f"WITH {shared}\n{body}"
