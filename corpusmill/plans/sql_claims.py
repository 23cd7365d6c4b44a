"""DuckDB SQL for chunks, claims and what is counted of them, over documents, pages and conversations.

The test tables hold no code fences, no Chinese or boilerplate headings and no note labels; rules for these have
tests of their own.
"""

from __future__ import annotations

from .sql import DOCS, WEB, clean, evidence, inline, key, lines, noise, normal, plain, q, re_, strip

# Chunk sizes in characters, evaluating words, header cells and pairs, negations, labels that name no concept.
TARGET, MOST, LEAST = 4000, 6400, 800
EVALUATIONS = ("better", "worse", "useful", "important", "effective")
HEADERS = ("字段", "field", "name")
PAIRS = (("field", "value"), ("字段", "值"), ("name", "value"), ("key", "value"))
NEGATIONS = ("not", "no", "never", "cannot")
GENERIC = ("", "文档开始", "sample", "未命名章节", "文档段落")
TRIM = " -:;,.!?。！？；：()[]{}\"'"
TRIM_TITLE = " -:;,.!?。！？；：，、()[]{}\"'"
CUT = "\x01"

CHATS = f"""turns AS (SELECT conv_id, string_agg(role || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, coalesce(text, '')) AS raw FROM conversations GROUP BY conv_id),
chats AS (SELECT conv_id AS ord, 'raw/chats/conv_' || conv_id || '.md' AS source_path, 'src_chats_conv_' || conv_id || '_' || substr(sha256(raw), 1, 12) AS source_id, {re_(strip(re_(re_('raw', chr(13) + chr(10) + '?', chr(10)), '[ \\t\\f\\r\\v]+(' + chr(92) + 'n|' + chr(92) + 'z)', '$1')), '$^')} || chr(10) AS text FROM turns)"""


def squeezed(x: str) -> str:
    return re_(x, r"\s+", " ")


def parts_of(x: str, marks: str) -> str:
    """A text at marks and line ends, as a list."""
    return f"string_split({re_(re_(re_(x, f'([{marks}])' + chr(92) + 's*', '$1' + CUT), chr(10) + '+', CUT), '([.])' + chr(92) + 's{2,}', '$1' + CUT)}, {q(CUT)})"


def by_heading() -> str:
    """Sections of the lines ``l`` by headings, as ``sec``."""
    running = "WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)"
    return f"""ca AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM l),
cb AS (SELECT *, count(level) OVER w AS section FROM ca {running}),
cc AS (SELECT *, section + least(0, min(level - section) OVER w) AS depth FROM cb {running}),
ch AS (SELECT source_id, section, depth, coalesce(nullif({squeezed(strip(re_('line', '^#{1,6}' + chr(92) + 's+')))}, ''), '未命名章节') AS title FROM cc WHERE level IS NOT NULL),
cp AS (SELECT a.source_id, a.section, d.depth AS d, arg_max(d.title, d.section) AS title FROM ch a JOIN ch d ON d.source_id = a.source_id AND d.section <= a.section AND d.depth <= a.depth GROUP BY ALL),
cq AS (SELECT source_id, section, list(title ORDER BY d) AS parts FROM cp GROUP BY ALL),
sec AS (SELECT cc.source_id, ord, cc.section, line_no, line, s, CASE WHEN cc.section = 0 THEN ['文档开始'] ELSE cq.parts END AS parts FROM cc LEFT JOIN cq USING (source_id, section))"""


def by_paragraph() -> str:
    """Sections by blank lines."""
    return f"""ca AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS head FROM l),
cb AS (SELECT *, head OR (s <> '' AND NOT coalesce(lag(s <> '' AND NOT head) OVER (PARTITION BY source_id ORDER BY line_no), false)) AS fresh FROM ca),
cc AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY source_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM cb),
sec AS (SELECT source_id, ord, section, line_no, line, s, [coalesce(nullif({squeezed(strip('first_value(CASE WHEN head THEN ' + re_('line', '^#{1,6}' + chr(92) + 's+') + ' ELSE substr(s, 1, 24) END) OVER (PARTITION BY source_id, section ORDER BY line_no)'))}, ''), '未命名章节')] AS parts FROM cc WHERE s <> '')"""


SUMMARY = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda r: " + strip("r") + "), lambda r: r <> ''), ' ')"


def chunks(sections: str) -> str:
    """Greedy chunks ``ck`` of the sections: blocks packed in order by a recursion over their places."""
    return f"""{sections},
bg AS (SELECT *, sum((s = '')::INT) OVER (PARTITION BY source_id, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM sec),
bt AS (SELECT source_id, ord, section, block, any_value(parts) AS parts, min(line_no) AS start_line, max(line_no) AS end_line, {re_("string_agg(line, chr(10) ORDER BY line_no)", '^' + chr(92) + 'n+|' + chr(92) + 'n+' + chr(92) + 'z')} AS text FROM bg WHERE s <> '' GROUP BY source_id, ord, section, block),
bk AS MATERIALIZED (SELECT *, length(text) AS n_chars, row_number() OVER (PARTITION BY source_id, section ORDER BY start_line) AS i FROM bt WHERE {strip('text')} <> ''),
pk AS (SELECT source_id, section, i, 0 AS place, CASE WHEN n_chars >= {TARGET} THEN 1 ELSE 0 END AS g, CASE WHEN n_chars >= {TARGET} THEN 0 ELSE n_chars END AS chars, CASE WHEN n_chars >= {TARGET} THEN 0 ELSE 1 END AS n FROM bk WHERE i = 1
  UNION ALL SELECT source_id, section, i, place, CASE WHEN is_full THEN place + 1 ELSE place END, CASE WHEN is_full THEN 0 ELSE c END, CASE WHEN is_full THEN 0 WHEN over_ THEN 1 ELSE n + 1 END
  FROM (SELECT *, NOT over_ AND c >= {TARGET} AS is_full FROM (SELECT b.source_id, b.section, b.i, p.n, p.n > 0 AND p.chars + b.n_chars > {MOST} AS over_, CASE WHEN p.n > 0 AND p.chars + b.n_chars > {MOST} THEN p.g + 1 ELSE p.g END AS place,
    CASE WHEN p.n > 0 AND p.chars + b.n_chars > {MOST} THEN b.n_chars ELSE p.chars + b.n_chars END AS c FROM pk p JOIN bk b ON b.source_id = p.source_id AND b.section = p.section AND b.i = p.i + 1))),
pe AS (SELECT source_id, section, arg_max(g, i) AS g, arg_max(n > 0 AND g > 0 AND chars + 2 * (n - 1) < {LEAST}, i) AS small FROM pk GROUP BY ALL),
pg_ AS (SELECT pk.source_id, pk.section, pk.i, CASE WHEN small AND pk.place = pe.g THEN pk.place - 1 ELSE pk.place END AS g FROM pk JOIN pe USING (source_id, section)),
c0 AS (SELECT bk.source_id, ord, section, pg_.g, any_value(parts) AS parts, min(start_line) AS start_line, max(end_line) AS end_line, {strip("string_agg(text, chr(10) || chr(10) ORDER BY start_line)")} || chr(10) AS text FROM bk JOIN pg_ USING (source_id, section, i) GROUP BY bk.source_id, ord, section, pg_.g),
c1 AS (SELECT *, array_to_string(parts, ' > ') AS section_path, {SUMMARY} AS flat, row_number() OVER (PARTITION BY source_id ORDER BY section, g) - 1 AS chunk_index FROM c0),
ck AS (SELECT *, 'chk_' || source_id || '_' || {key('section_path')} || '_' || start_line || '_' || substr(sha256(text), 1, 10) AS chunk_id FROM c1)"""


def claims(base: str, table: str) -> str:
    """Units ``u``, chunks ``ck`` and claim mentions ``cl`` of a table's texts."""
    subject = "coalesce(parts[-1], '')"
    header = " OR ".join(f"(lower(coalesce(cells[1], '')) = {q(a)} AND lower(coalesce(cells[2], '')) = {q(b)})" for a, b in PAIRS)
    evaluation = " OR ".join(f"contains(lower(c2), {q(w)})" for w in EVALUATIONS)
    return f"""{evidence(base, table)},
{chunks(by_heading())},
u0 AS (SELECT *, CASE block_kind WHEN 'metadata_line' THEN 'metadata_fact' WHEN 'table_row' THEN 'table_fact' WHEN 'section_heading' THEN 'structural_shell' WHEN 'code_example' THEN 'code_example' ELSE 'statement' END AS unit_kind,
  'ev_' || source_id || '_' || start_line || '_' || substr(sha256(source_id || '|' || sids || '|' || start_line || '|' || text), 1, 12) AS evidence_block_id, {normal('text')} AS nt,
  CASE WHEN block_type = 'table_row' THEN list_transform(string_split(trim({strip('raw')}, '|'), '|'), lambda r: {inline('r')}) ELSE [] END AS cells FROM ev2 WHERE {strip('text')} <> ''),
u AS (SELECT *, 'ku_' || source_id || '_' || substr(sha256(source_id || '|' || evidence_block_id || '|' || nt), 1, 12) AS knowledge_unit_id FROM u0),
cv AS (SELECT u.source_id, u.knowledge_unit_id, arg_min(ck.chunk_id, (CASE WHEN ck.start_line <= u.start_line AND ck.end_line >= u.end_line THEN 0 ELSE 1 END, ck.chunk_index)) AS chunk_id, arg_min(ck.section_path, (CASE WHEN ck.start_line <= u.start_line AND ck.end_line >= u.end_line THEN 0 ELSE 1 END, ck.chunk_index)) AS chunk_section_path
  FROM u JOIN ck ON ck.source_id = u.source_id AND ck.start_line <= u.end_line AND ck.end_line >= u.start_line GROUP BY ALL),
ub0 AS (SELECT *, coalesce({strip('local_heading')}, '') AS hd, {strip('text')} AS st FROM u WHERE unit_kind NOT IN ('structural_shell', 'code_example')),
ub1 AS (SELECT *, CASE WHEN hd <> '' AND starts_with(st, hd) AND {strip('substr(st, length(hd) + 1)')} <> '' THEN hd || '：' || {strip('substr(st, length(hd) + 1)')} ELSE st END AS body FROM ub0),
bodies AS (SELECT knowledge_unit_id AS id, source_id, ord, start_line, unit_kind, parts, cells, mk, mv, evidence_block_id, body, true AS unit FROM ub1
  UNION ALL SELECT chunk_id, source_id, ord, start_line, 'chunk', parts, [], NULL, NULL, NULL, text, false FROM ck),
bp AS MATERIALIZED (SELECT *, {plain('body')} AS p, {clean('body')} AS whole FROM bodies),
w0 AS (SELECT id, unnest({parts_of('p', '。！？!?；;')}) AS r, generate_subscripts({parts_of('p', '。！？!?；;')}, 1) AS i FROM bp),
w1 AS (SELECT id, i, {clean('r')} AS c FROM w0 WHERE NOT regexp_matches(r, '^\\s*#{{1,6}}\\s+\\S+')),
w AS (SELECT * FROM w1 WHERE NOT {noise('c')}),
x0 AS (SELECT id, i, c AS w, list_filter(list_transform(string_split({re_('c', '([,;。！？!?；])' + chr(92) + 's*', '$1' + CUT)}, {q(CUT)}), lambda r: {clean('r')}), lambda r: NOT {noise('r')}) AS cs FROM w WHERE length(c) > 140),
x1 AS (SELECT id, i, w, unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM x0 WHERE len(cs) >= 2),
y0 AS (SELECT id, i, 0 AS j, c FROM w UNION ALL SELECT id, i, j, c FROM x1 WHERE c <> w),
y1 AS (SELECT id, i, j, {clean('c')} AS c FROM y0),
y AS (SELECT id, c, min((i, j)) AS place FROM y1 WHERE NOT {noise('c')} GROUP BY id, c),
z0 AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS pos FROM y),
z1 AS (SELECT id, {clean('p')} AS c FROM bp WHERE id NOT IN (SELECT id FROM z0)),
z2 AS (SELECT id, c, 0 AS pos FROM z1 WHERE NOT {noise('c')}),
z3 AS (SELECT id, whole AS c FROM bp WHERE unit_kind IN ('metadata_fact', 'table_fact') AND NOT ({header}) AND id NOT IN (SELECT id FROM z0 UNION ALL SELECT id FROM z2)),
z4 AS (SELECT * FROM z0 UNION ALL SELECT * FROM z2 UNION ALL SELECT id, c, 0 FROM z3 WHERE NOT {noise('c')}),
f0 AS (SELECT bp.*, z4.c, z4.pos FROM bp JOIN z4 USING (id)),
f1 AS (SELECT * FROM f0 WHERE unit OR source_id NOT IN (SELECT source_id FROM f0 WHERE unit)),
f2 AS (SELECT *, CASE WHEN unit_kind = 'metadata_fact' AND {subject} <> '' THEN {subject} || ' ' || mk || ' 是 ' || mv
  WHEN unit_kind = 'table_fact' AND {subject} <> '' AND len(cells) >= 2 AND {strip('cells[1]')} <> '' AND {strip('cells[2]')} <> '' AND {strip('cells[1]')} NOT IN ({', '.join(map(q, HEADERS))}) THEN {subject} || ' ' || {strip('cells[1]')} || ' 是 ' || {strip('cells[2]')}
  WHEN unit THEN {clean('c')} ELSE c END AS claim FROM f1),
f3 AS (SELECT *, {clean('claim')} AS c2, {normal('claim')} AS normalized_text FROM f2),
cl AS MATERIALIZED (SELECT 'clm_' || substr(sha256(source_id || '|' || normalized_text), 1, 16) AS claim_id, claim AS text, normalized_text, CASE WHEN unit_kind IN ('metadata_fact', 'table_fact') THEN unit_kind WHEN {evaluation} THEN 'evaluation' ELSE 'fact' END AS claim_type,
  source_id, ord, start_line AS line, pos, unit_kind AS claim_origin_kind, parts, id, unit, evidence_block_id FROM f3)"""


#: Claims merged by normalized text, the first mention leading.
MERGED = """mg AS (SELECT normalized_text, arg_min(claim_id, (ord, line, pos, claim_id)) AS claim_id, arg_min(text, (ord, line, pos, claim_id)) AS text, arg_min(claim_type, (ord, line, pos, claim_id)) AS claim_type,
  arg_min(claim_origin_kind, (ord, line, pos, claim_id)) AS claim_origin_kind, arg_min(parts, (ord, line, pos, claim_id)) AS parts, count(*) AS n_mentions, count(DISTINCT source_id) AS n_sources, count(DISTINCT id) AS n_refs, count(DISTINCT evidence_block_id) AS n_evidence FROM cl GROUP BY 1)"""


def similarity_tokens(n: str) -> str:
    """Distinct tokens of a column of normal text without its negations."""
    base = n
    for word in NEGATIONS:
        base = f"replace({base}, '{word}', '')"
    base = f"trim({strip(squeezed(base))}, {q(TRIM)})"
    return f"list_filter({ordered_distinct('(' + tokens_of(base) + ')')}, lambda t: length(trim(t)) >= 2)"


def tokens_of(x: str) -> str:
    """Tokens of an expression in order: words of 2 and more, then other parts between blanks."""
    words = "list_filter(regexp_extract_all(v, '[a-z0-9_]+'), lambda t: length(t) >= 2)"
    parts = "list_filter(string_split_regex(v, '\\s+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[a-z0-9_]+'))"
    return f"list_transform([{x}], lambda v: list_concat({words}, {parts}))[1]"


def ordered_distinct(xs: str) -> str:
    return f"list_transform([{xs}], lambda ys: list_filter(ys, lambda y, k: list_position(ys, y) = k))[1]"


def base_text(n: str) -> str:
    for word in NEGATIONS:
        n = f"replace({n}, '{word}', '')"
    return strip(squeezed(n))


def own_group() -> str:
    """A claim's group where no label names one."""
    return f"substr(normalized_text, 1, 24) || '|' || substr(sha256(coalesce(nullif({base_text('normalized_text')}, ''), nullif(normalized_text, ''), text) || '|' || array_to_string(({similarity_tokens('normalized_text')})[1:8], ' ')), 1, 12)"


def concept_title(x: str) -> str:
    return f"trim({squeezed(re_(f'translate({strip(x)}, {q(chr(124) + chr(95))}, {q(chr(32) * 2)})', '^' + chr(92) + 's*' + chr(92) + 'd+[.)、:：]?' + chr(92) + 's+'))}, {q(TRIM_TITLE)})"


def generic(x: str) -> str:
    t = f"lower({concept_title(x)})"
    return f"({t} IN ({', '.join(map(q, GENERIC))}) OR regexp_matches({t}, '^(?:表格|table|sheet|工作表|page|第)\\s*\\d+'))"


#: Merged claims by concept group, with their section's label.
GROUPS = f"""{MERGED},
gl0 AS (SELECT *, list_filter(list_transform(parts, lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM mg),
gl1 AS (SELECT *, list_filter(ps, lambda p: NOT {generic('p')} AND NOT (regexp_matches(p, '[：:。？?]') AND length(p) >= 10)) AS good FROM gl0),
gl2 AS (SELECT *, array_to_string((CASE WHEN len(good) > 0 THEN good ELSE ps END)[-3:], ' / ') AS label FROM gl1),
gr AS MATERIALIZED (SELECT *, CASE WHEN label <> '' AND NOT {generic('label')} THEN {key(concept_title('label'), 'concept')} ELSE {own_group()} END AS grp FROM gl2)"""

#: Claims of pages by group, with role and hint.
ROLES = f"""ro AS (SELECT *, CASE WHEN regexp_matches({strip('text')}, '[？?]$') THEN 'meta' WHEN claim_origin_kind IN ('table_fact', 'metadata_fact') THEN 'reference' WHEN claim_origin_kind = 'code_example' THEN 'example' ELSE 'fact' END AS role FROM gr),
rh AS (SELECT *, CASE role WHEN 'meta' THEN 'reject' WHEN 'reference' THEN 'reference' WHEN 'example' THEN 'example' ELSE 'topic' END AS hint FROM ro),
kn AS (SELECT DISTINCT normalized_text, evidence_block_id FROM cl WHERE evidence_block_id IS NOT NULL),
kk AS (SELECT kn.normalized_text, u.block_kind, CASE WHEN u.block_kind = 'metadata_line' THEN u.mk END AS mk FROM kn JOIN u USING (evidence_block_id)),
gk AS (SELECT grp, block_kind, mk FROM rh JOIN kk USING (normalized_text))"""

DOC_CLAIMS, WEB_CLAIMS = claims(DOCS, "docs"), claims(WEB, "web")
_CHUNK = "chunk_id, source_id, section_path, chunk_index::INT AS chunk_index, start_line::INT AS start_line, end_line::INT AS end_line, length(text)::INT AS char_count"

SQL: dict[str, str] = {
    "document_chunks": f"""WITH RECURSIVE {DOCS}, {lines('docs')}, {chunks(by_heading())} SELECT {_CHUNK}, CASE WHEN {strip('text')} = '' THEN 0 ELSE greatest(1, length({strip('text')}) // 4) END::INT AS token_estimate,
  CASE WHEN length(flat) <= 120 THEN flat ELSE rtrim(substr(flat, 1, 117)) || '...' END AS summary, lag(chunk_id) OVER w AS previous_chunk, lead(chunk_id) OVER w AS next_chunk FROM ck WINDOW w AS (PARTITION BY source_id ORDER BY section, g)""",
    "conversation_chunks": f"WITH RECURSIVE {CHATS}, {lines('chats')}, {chunks(by_paragraph())} SELECT {_CHUNK}, 'chat_turn' AS chunk_kind FROM ck",
    "claims_extract": f"WITH RECURSIVE {DOC_CLAIMS} SELECT source_id, line::BIGINT AS line, pos::BIGINT AS pos, text, normalized_text, claim_type, claim_origin_kind FROM cl",
    "claims_merge": f"WITH RECURSIVE {DOC_CLAIMS}, {MERGED} SELECT normalized_text, claim_id, n_mentions, n_sources FROM mg",
    "claims_merged_full": f"WITH RECURSIVE {DOC_CLAIMS}, {MERGED} SELECT claim_id, normalized_text, n_sources AS sources, n_refs AS refs, n_evidence AS evidence, claim_type FROM mg",
    "claim_references": f"""WITH RECURSIVE {DOC_CLAIMS}, {MERGED}, rf AS (SELECT normalized_text, source_id, id, min((ord, line, pos, claim_id)) AS spot, min(line) AS start_line FROM cl GROUP BY ALL)
  SELECT mg.claim_id, row_number() OVER (PARTITION BY normalized_text ORDER BY spot, id) AS position, source_id, id AS reference, start_line::BIGINT AS start_line FROM rf JOIN mg USING (normalized_text)""",
    "unit_chunk_join": f"WITH RECURSIVE {DOC_CLAIMS} SELECT source_id, knowledge_unit_id, chunk_id, chunk_section_path FROM cv",
    "claim_tokens": f"""WITH RECURSIVE {DOC_CLAIMS}, {MERGED}, ts AS (SELECT unnest({similarity_tokens('normalized_text')}) AS token FROM mg)
  SELECT token, count(*) AS claims, max(CASE WHEN regexp_matches(token, '^[a-z0-9_]+$') THEN greatest(1.0, least(length(token), 8) / 2.0) ELSE least(length(token), 4) END::DOUBLE) AS weight FROM ts GROUP BY token""",
    "concept_groups": f'WITH RECURSIVE {DOC_CLAIMS}, {GROUPS} SELECT grp AS "group", count(*) AS claims, min(normalized_text) AS first_text FROM gr GROUP BY grp',
    "topic_labels": f"""WITH RECURSIVE {WEB_CLAIMS}, {GROUPS}, v AS (SELECT grp, label, {normal('label')} AS n, sum(greatest(1, n_sources)) AS votes FROM gr WHERE label <> '' AND NOT {generic('label')} GROUP BY grp, label)
  SELECT grp AS "group", arg_max(label, (votes, len({similarity_tokens('n')}), length(label), label)) AS topic FROM v GROUP BY grp""",
    "retract_source": f"""WITH RECURSIVE {DOC_CLAIMS}, r AS (SELECT cl.normalized_text, count(DISTINCT cl.id) FILTER (NOT starts_with(docs.source_path, 'raw/src1/')) AS refs FROM cl JOIN docs USING (source_id) GROUP BY 1)
  SELECT CASE WHEN refs > 0 THEN 'active' ELSE 'archived' END AS lifecycle_status, count(*) AS claims, sum(refs)::BIGINT AS refs FROM r GROUP BY 1""",
    "coverage_rows": f"""WITH RECURSIVE {WEB_CLAIMS}, men AS (SELECT DISTINCT normalized_text, source_id, NULL AS id FROM cl UNION ALL SELECT DISTINCT normalized_text, source_id, id FROM cl)
  SELECT source_id, coalesce(b.n, 0) AS blocks, coalesce(e.n, 0) AS evidence, coalesce(k.n, 0) AS units, coalesce(c.n, 0) AS chunks, coalesce(m.n, 0) AS claim_mentions FROM (SELECT DISTINCT source_id FROM web) w LEFT JOIN (SELECT source_id, count(*) AS n FROM blocks GROUP BY 1) b USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS n FROM ev2 GROUP BY 1) e USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM u GROUP BY 1) k USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM ck GROUP BY 1) c USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM men GROUP BY 1) m USING (source_id)""",
    "coverage_gaps": f"""WITH RECURSIVE {WEB_CLAIMS}, o AS (SELECT *, {clean('text')} AS c FROM u WHERE knowledge_unit_id NOT IN (SELECT id FROM cl WHERE unit) AND evidence_block_id NOT IN (SELECT evidence_block_id FROM cl WHERE evidence_block_id IS NOT NULL))
  SELECT CASE WHEN unit_kind = 'structural_shell' THEN 'intentional_shell' WHEN unit_kind = 'code_example' THEN 'intentional_code' WHEN {strip('text')} = '' THEN 'empty' WHEN {noise('c')} THEN 'noise' ELSE 'missing_claim' END AS gap, count(*) AS n FROM o GROUP BY 1""",
    "related_pages": """WITH p AS (SELECT 'page_' || page_id AS page_id, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^([^/]+)', 1) AS host FROM pages), r AS (SELECT a.page_id, b.page_id AS related_id, row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id) AS rank FROM p a JOIN p b USING (host) WHERE a.page_id <> b.page_id)
  SELECT page_id, related_id, 'family' AS reason, rank FROM r WHERE rank <= 8""",
    "markdown_links": f"""WITH {WEB} SELECT source_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(!?\\[[^\\]]+\\]\\([^)]+\\))'), lambda m: NOT starts_with(m, '!')), lambda m: {strip("regexp_extract(m, '" + chr(92) + "]" + chr(92) + "(([^)]+)" + chr(92) + ")$', 1)")})))::BIGINT AS links,
  len(list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \\t]*#+[ \\t]*(\\S[^\\n]*)$', 1), lambda h: {strip('h')}), lambda h: h <> ''))::BIGINT AS headings, length({plain('text')})::BIGINT AS plain_chars FROM web""",
    "record_upserts": "SELECT doc_id::BIGINT AS doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels",
    "record_filters": "SELECT 's-' || coalesce(source, 'none') AS source_id, count(*) AS records, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents WHERE source IS DISTINCT FROM 'src1' OR length(coalesce(text, '')) < 1000 GROUP BY 1",
    "page_lifecycles": """WITH b AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1), p AS (SELECT source, CASE WHEN toxic = 1 THEN 'removed' WHEN quality = 0 THEN 'archived' ELSE 'active' END AS lifecycle_status FROM documents LEFT JOIN b USING (doc_id))
  SELECT source, lifecycle_status, lifecycle_status = 'active' AS live, count(*) AS pages FROM p GROUP BY ALL""",
    "review_ledger": """SELECT DISTINCT conv_id || '-' || turn AS review_id, CASE WHEN turn >= 3 THEN 'archived' WHEN coalesce(text, '') = '' THEN 'superseded' ELSE 'active' END AS lifecycle_status, lpad(turn::VARCHAR, 9, '0') AS created_at FROM conversations WHERE role = 'user'""",
    "alias_actions": """WITH f AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY source) AS first FROM documents WHERE source IS NOT NULL)
  SELECT 'page_' || doc_id AS page_id, list_sort(list_filter([CASE WHEN first THEN source END, lang], lambda x: x IS NOT NULL)) AS aliases FROM f""",
    "structured_sources": f"WITH {evidence(WEB, 'web')} SELECT DISTINCT source_id FROM ev2 WHERE {strip('text')} <> ''",
    "page_intent_routes": f"""WITH RECURSIVE {WEB_CLAIMS}, {GROUPS}, {ROLES}, r_n AS (SELECT grp, count(*) AS claims, count(*) FILTER (hint = 'reject') AS j, count(*) FILTER (hint = 'reference') AS r, count(*) FILTER (hint = 'example') AS e, count(*) FILTER (hint = 'topic') AS t, count(*) FILTER (role <> 'meta' AND role <> 'example') >= 2 AS worthy FROM rh GROUP BY grp),
  r_k AS (SELECT grp, count(*) FILTER (block_kind IN ('table_row', 'metadata_line')) AS rb, count(*) FILTER (block_kind = 'code_example') AS eb FROM gk GROUP BY grp), r_s AS (SELECT r_n.*, coalesce(rb, 0) AS rb, coalesce(eb, 0) AS eb FROM r_n LEFT JOIN r_k USING (grp)),
  r_i AS (SELECT *, CASE WHEN j >= claims THEN 'reject' WHEN r > 0 AND (r >= 2 OR rb >= 1) THEN 'reference' WHEN e > 0 AND (2 * e >= 2 OR eb >= 1) THEN 'example' WHEN t > 0 THEN 'topic' WHEN worthy THEN 'concept' ELSE 'topic' END AS intent FROM r_s),
  r_x AS (SELECT grp, string_agg(text, chr(10) ORDER BY claim_id) AS texts FROM (SELECT grp, claim_id, {strip('text')} AS text, row_number() OVER (PARTITION BY grp ORDER BY claim_id) AS p FROM rh) WHERE p <= 5 AND text <> '' GROUP BY grp)
  SELECT grp AS "group", claims, intent AS source_page_intent, CASE WHEN intent = 'topic' AND worthy THEN 'concept' ELSE intent END AS page_intent, CASE WHEN intent = 'topic' AND worthy THEN 'topic_promoted_to_concept_by_claim_group' ELSE 'heuristic_page_intent' END AS route_reason, 0.75::DOUBLE AS confidence, texts FROM r_i JOIN r_x USING (grp)""",
    "structure_projection": f"""WITH RECURSIVE {WEB_CLAIMS}, {GROUPS}, {ROLES}, r_f AS (SELECT grp, 'evidence_kind' AS kind, block_kind AS value FROM gk UNION ALL SELECT grp, 'metadata_key', mk FROM gk WHERE mk <> '' UNION ALL SELECT grp, 'section_path', array_to_string(list_filter(parts, lambda p: p <> ''), ' > ') FROM rh),
  r_g AS (SELECT grp, kind, value, count(*) AS n FROM r_f WHERE value <> '' GROUP BY ALL) SELECT grp AS "group", kind, value, n FROM r_g QUALIFY row_number() OVER (PARTITION BY grp, kind ORDER BY n DESC, value) <= 8""",
    "intent_descriptors": "",
    "rendered_claims": f"""WITH RECURSIVE {WEB_CLAIMS}, {GROUPS}, {ROLES}, o AS (SELECT *, role NOT IN ('meta', 'example') AS ok FROM rh), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY grp) AS any_ok FROM o)
  SELECT grp AS "group", count(*) AS claims, min(claim_id) AS first_claim FROM a WHERE ok OR NOT any_ok GROUP BY grp""",
}
_TITLE = concept_title("topic")
SQL["intent_descriptors"] = f"""WITH t AS ({SQL['topic_labels']}), i AS (SELECT *, unnest(['reference', 'topic']) AS intent FROM t), c AS (SELECT *, {_TITLE} AS base FROM i), d AS (SELECT *, CASE WHEN base <> '' THEN base WHEN intent = 'reference' THEN '参考' ELSE '主题' END AS title FROM c)
  SELECT "group", intent, title, intent || ':' || {key('title', 'concept')} AS canonical_id, title || CASE intent WHEN 'reference' THEN ' 的参考信息、规则条目与检索入口。' ELSE ' 的主题概览与相关证据入口。' END AS summary, CASE intent WHEN 'reference' THEN '参考条目 / Reference Notes' ELSE '主题要点 / Topic Notes' END AS section_title FROM d"""
