"""The chat query: tool calls and results that follow from the conversations, and the SQL for the same rows.

Every assistant turn calls a tool, every user turn answers the call of the turn before, and a call builds on
the call two turns before.  Lengths of the texts decide on the tool and on what is wrong with its arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrail.llm.chat import Schemas, format_chat
from contrail.llm.common import load

TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"key": ("string", True), "exact": ("boolean", True)},
    "translate": {"text": ("string", True), "to": ("string", True)},
}

_WORD = "regexp_extract(text, '[a-z]+', 0)"
# Plain SQL that both engines read; n is the length of the text, w a word of it.
_NAME = "CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'translate' END"
_ARGUMENTS = """CASE n % 3
    WHEN 0 THEN concat('{"query":"', w, '", "limit":', CASE WHEN n % 4 = 0 THEN concat('"', n, '"') ELSE concat('', n) END, '}')
    WHEN 1 THEN CASE WHEN n % 5 = 0 THEN '{"exact": false}' ELSE concat('{"key":"', w, '", "exact":true}') END
    ELSE CASE WHEN n % 7 = 0 THEN concat('{"tone":"dry", "to":"en", "text":"', w, '"}') ELSE concat('{"to":"en", "text":"', w, '"}') END END"""


def op10_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    messages = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    sized = messages.selectExpr("conv_id", "turn", "role", "text", "length(text) AS n", f"{_WORD} AS w")
    calls = sized.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "concat('call-', conv_id, '-', turn) AS call_id", f"{_NAME} AS name", f"{_ARGUMENTS} AS arguments",
        "concat('call-', conv_id, '-', turn - 2) AS after")
    results = messages.where("role = 'user' AND turn > 0").selectExpr("conv_id", "turn", "concat('call-', conv_id, '-', turn - 1) AS call_id", "text AS content")
    return format_chat(messages, calls, results, TOOLS)


CHAT_SQL = f"""
WITH RECURSIVE sized AS (SELECT conv_id, turn, role, text, length(text) AS n, {_WORD} AS w FROM conversations),
calls AS (SELECT conv_id, turn, concat('call-', conv_id, '-', turn) AS call_id, {_NAME} AS name, {_ARGUMENTS} AS arguments, n, w
    FROM sized WHERE role = 'assistant'),
owners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, arguments) AS k FROM calls) WHERE k = 1),
results AS (SELECT conv_id, turn, concat('call-', conv_id, '-', turn - 1) AS call_id, text AS content FROM sized WHERE role = 'user' AND turn > 0),
leveled AS (
    SELECT o.conv_id, o.turn, CAST(0 AS BIGINT) AS level FROM owners o WHERE NOT EXISTS (
        SELECT 1 FROM owners p WHERE p.conv_id = o.conv_id AND p.turn = o.turn - 2)
    UNION ALL
    SELECT o.conv_id, o.turn, l.level + 2 FROM leveled l JOIN owners o ON o.conv_id = l.conv_id AND o.turn = l.turn + 2),
linked AS (SELECT o.*, l.level, EXISTS (SELECT 1 FROM results r WHERE r.conv_id = o.conv_id AND r.call_id = o.call_id) AS answered
    FROM owners o JOIN leveled l ON l.conv_id = o.conv_id AND l.turn = o.turn)
SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BIGINT) AS level, 'ok' AS status, '' AS problems,
    concat('{{"content":', to_json(text), ',"role":', to_json(role), '}}') AS line FROM sized
UNION ALL
SELECT c.conv_id, c.turn, 'call', c.call_id, k.level,
    CASE WHEN c.name <> k.name OR c.arguments <> k.arguments THEN 'duplicate_id' WHEN k.answered THEN 'ok' ELSE 'unanswered' END,
    CASE WHEN c.n % 12 = 0 THEN 'type:limit' WHEN c.n % 3 = 1 AND c.n % 5 = 0 THEN 'missing:key'
        WHEN c.n % 3 = 2 AND c.n % 7 = 0 THEN 'unknown:tone' ELSE '' END,
    concat('{{"arguments":', CASE c.n % 3
        WHEN 0 THEN concat('{{"limit":', CASE WHEN c.n % 4 = 0 THEN concat('"', c.n, '"') ELSE concat('', c.n) END, ',"query":"', c.w, '"}}')
        WHEN 1 THEN CASE WHEN c.n % 5 = 0 THEN '{{"exact":false}}' ELSE concat('{{"exact":true,"key":"', c.w, '"}}') END
        ELSE concat('{{"text":"', c.w, '","to":"en"', CASE WHEN c.n % 7 = 0 THEN ',"tone":"dry"' ELSE '' END, '}}') END,
        ',"id":', to_json(c.call_id), ',"name":', to_json(c.name), '}}')
    FROM calls c JOIN linked k ON k.conv_id = c.conv_id AND k.call_id = c.call_id
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, k.level + 1, CASE WHEN k.conv_id IS NULL THEN 'orphan' ELSE 'ok' END, '',
    concat('{{"call_id":', to_json(r.call_id), ',"content":', to_json(r.content), '}}')
    FROM results r LEFT JOIN linked k ON k.conv_id = r.conv_id AND k.call_id = r.call_id
"""
