"""One DuckDB statement per query, with the same column names."""

from __future__ import annotations

from docloom.functions import lookups as L
from docloom.functions.lookups import SPACE

from .common import IMAGE, OPTIONS, S, dir_of, html_text, md5_digest, resolved, rstrip, statement, stem, strip, table, url_path

NAME = r"regexp_replace(path, '^.*/', '')"
SLUG_CLEAN = rf"regexp_replace({strip('text')}, '{S}*\{{#([^{{}}]+)\}}$', '')"


def hyphens(x: str, drop: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{drop}', '', 'g'), '{S}+', '-', 'g')"


def slug_unicode(x: str) -> str:
    return hyphens(f"lower(nfc_normalize({strip(x)}))", rf"[^{SPACE}\pL\pN_-]")


def encode(x: str) -> str:
    safe = f"regexp_replace({x}, '[^A-Za-z0-9._~()''!*:@,;+?-]+', ' ', 'g')"
    joined = f"trim(regexp_replace({safe}, '\\s\\s+', ' ', 'g'))"
    out = joined
    for char, code in (("(", "28"), (")", "29"), ("!", "21"), ("*", "2A"), (":", "3A"), ("@", "40"), (",", "2C"), (";", "3B"), ("+", "2B"), ("?", "3F")):
        out = f"replace({out}, '{char}', '%{code}')"
    return f"replace(replace({out}, '''', '%27'), ' ', '+')"


HEADING_ID = rf"coalesce(nullif(regexp_extract(text, '\{{#([^{{}}]+)\}}$', 1), ''), {slug_unicode(rf'''regexp_replace(text, '{S}*\{{#([^{{}}]+)\}}$', '')''')})"
HTML_HEADS = rf"""SELECT path, CAST(k AS INT) AS pos, CAST(regexp_extract(m, '(?i)^<h([1-6])', 1) AS INT) AS level, {html_text('m')} AS text
  FROM (SELECT path, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT path, regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>') AS ms FROM html))"""
TEXTS = f"(SELECT text FROM heads UNION SELECT text FROM ({HTML_HEADS}))"
ABSOLUTE = "regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*:|//[^/?#])')"
ANCHOR_TEXT = html_text(r'''regexp_extract(m, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)''')
HTML_LINKS = rf"""SELECT path, CAST(k AS INT) AS pos, {ANCHOR_TEXT} AS text,
  regexp_extract(m, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS url
  FROM (SELECT path, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT path, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>') AS ms FROM html))"""
KIND = f"""CASE WHEN url LIKE 'mailto:%' THEN 'mention' WHEN {ABSOLUTE} THEN 'absolute' WHEN url LIKE '#%' OR url = '' THEN 'anchor'
  WHEN {url_path('url')} LIKE '%.md' THEN 'page' ELSE 'attachment' END"""
DIAGRAMS = r"(SELECT *, regexp_matches(content, '(?sm)\A---\n.+?^---(?:\n|\z)') AS fronted FROM fblocks WHERE closed AND lang IN ('mermaid', 'plantuml'))"

# matched documents and pages, used by several plans
BY_ID = """SELECT n.path, n.page_id, p.status, p.title AS page_title, p.version, 'id' AS matched_by, CASE WHEN p.id IS NULL THEN 'no such page' END AS error
  FROM nodes n LEFT JOIN snap_pages p ON p.id = n.page_id WHERE n.page_id IS NOT NULL"""
BY_TITLE = """SELECT n.path, p.id AS page_id, p.status, p.title AS page_title, p.version, CASE WHEN p.id IS NULL THEN 'none' ELSE 'title' END AS matched_by, NULL AS error
  FROM nodes n LEFT JOIN (SELECT * FROM snap_pages QUALIFY count(*) OVER (PARTITION BY space_id, title) = 1) p ON p.space_id = n.space_id AND p.title = n.full_title WHERE n.page_id IS NULL"""
MATCHED = f"""SELECT *, CASE WHEN matched_by = 'title' AND status NOT IN ('current', 'draft') THEN 'unable to update page with status ' || status END AS status_error
  FROM (SELECT * FROM ({BY_ID}) UNION ALL SELECT * FROM ({BY_TITLE}))"""
TITLED = """SELECT n.path, {id} AS page_id, p.title AS page_title, p.version, p.body, coalesce(n.title, '') AS title, n.doc_id, n.digest, n.original,
    EXISTS (SELECT 1 FROM snap_pages o WHERE o.space_id = n.space_id AND o.title = coalesce(n.title, '')) AS taken"""
NEW_TITLE = "CASE WHEN title <> '' AND (title = page_title OR NOT taken) THEN title ELSE page_title END"
# The page body differs from the generated content only in volatile parts unless its text was edited.
SAME = "strip_text(body) = original"
BODY_TEXT = "regexp_replace(body, '<[^>]*>', '', 'g')"
RULE = f"""CASE WHEN new_title <> page_title THEN 'title' WHEN s.source_digest = c.digest AND s.page_version = c.version THEN 'checksum'
  WHEN {strip(BODY_TEXT)} = {strip('original')} THEN 'content' ELSE 'changed' END"""
CHANGES = f"""SELECT path, c.page_id, {RULE} AS rule, version, s.page_version FROM (
    SELECT n.path, n.node_id AS page_id, n.full_title AS new_title, p.title AS page_title, p.version, p.body, n.digest, n.original FROM nodes n JOIN snap_pages p ON p.id = n.node_id) c
  LEFT JOIN snap_sync_state s ON s.page_id = c.page_id"""
PROPERTY_ROWS = "SELECT n.node_id AS page_id, replace(kv.key, 'properties.', '') AS key, kv.value FROM nodes n JOIN kv ON kv.path = n.path WHERE kv.key LIKE 'properties.%'"
SAFE_NAME = "regexp_replace(replace(replace({0}, '..', 'PAR'), '/', '_'), '[^0-9A-Za-z_.-]', '_', 'g')"
WANTED = f"""SELECT page_id, name, checksum, size FROM (SELECT n.node_id AS page_id, {SAFE_NAME.format('i.url')} AS name, md5(regexp_extract(i.url, '([^/]*)\\.\\w+$', 1)) AS checksum,
    100 + n.doc_id % 2 AS size, row_number() OVER (PARTITION BY n.node_id, i.url ORDER BY i.pos DESC) AS r FROM pics i JOIN nodes n ON n.path = i.path WHERE i.kind = 'local') WHERE r = 1"""


def attachment_plan(mark: str) -> str:
    return f"""SELECT coalesce(w.page_id, a.page_id) AS page_id, coalesce(w.name, a.name) AS name,
      CASE WHEN w.page_id IS NULL THEN 'delete' WHEN a.{mark} = w.{mark} THEN 'skip' ELSE 'upload' END AS action
      FROM ({WANTED}) w FULL JOIN snap_attachments a ON a.page_id = w.page_id AND a.name = w.name"""


RULE_LINES = """SELECT base_dir, unnest(rules) AS pattern, CAST(generate_subscripts(rules, 1) - 1 AS INT) AS line_no FROM (
  SELECT 'docs/' || lang || '/' || source AS base_dir, ['# drafts', 'Doc' || (min(doc_id) + 1) || '.md', CASE WHEN min(doc_id) % 2 = 0 THEN 'deep/*3.md' ELSE 'deep/' END, '*7.md', '!*77.md'] AS rules
  FROM src GROUP BY lang, source UNION ALL SELECT '', ['**/src1?/doc*.md', 'docs/*/src3/', '!docs/de/src3/', 'Doc?1.md'] WHERE (SELECT count(*) FROM src) > 0)"""
COMPILED = rf"""SELECT base_dir, line_no, pattern LIKE '!%' AS negated, pattern LIKE '%/' AS dir_only,
  concat(CASE WHEN rtrim(bare, '/') LIKE '%/%' THEN '^' ELSE '^(?:.+/)?' END,
    replace(replace(replace(replace(replace(replace(regexp_replace(rtrim(bare, '/'), '\.', '\\.', 'g'), '**/', chr(1)), '/*/', '/' || chr(2) || '/'), '*', '[^/]*'), '?', '[^/]'), chr(1), '(?:.+/)?'), chr(2), '[^/]+'),
    CASE WHEN bare LIKE '%/' THEN '/.*$' ELSE '(?:/.*)?$' END) AS regex
  FROM (SELECT *, ltrim(pattern, '!') AS bare FROM ({RULE_LINES})) WHERE pattern NOT LIKE '#%'"""
# every directory above a file and the file itself, relative to every list above it
RULE_TARGETS = """SELECT path, target, base_dir, CASE WHEN base_dir = '' THEN target ELSE substr(target, length(base_dir) + 2) END AS rel FROM (
    SELECT path, path AS target FROM src UNION ALL SELECT path, above || '/' FROM prefixes WHERE above <> '') t
  JOIN (SELECT DISTINCT base_dir FROM ({lines})) b ON b.base_dir = '' OR starts_with(t.target, b.base_dir || '/')"""
IGNORED = f"""SELECT DISTINCT path FROM (
  SELECT t.path, t.target, t.base_dir, max_by(c.negated, c.line_no) AS negated FROM ({RULE_TARGETS.format(lines=RULE_LINES)}) t
  JOIN ({COMPILED}) c ON c.base_dir = t.base_dir AND regexp_matches(t.rel, c.regex) WHERE t.rel <> '' GROUP BY 1, 2, 3) WHERE NOT negated"""

# Documents in their tree: the space comes from the nearest explicit page above, pages found by title have to trace back.
PLACED = """lined AS (SELECT n.*, q.parent, p.id AS own_id, p.space_id AS own_space FROM nodes n JOIN parents q ON q.path = n.path LEFT JOIN snap_pages p ON p.id = n.page_id),
    inh AS (SELECT path, coalesce(own_space, 'S-HOME') AS space FROM lined WHERE parent IS NULL UNION ALL SELECT l.path, coalesce(l.own_space, i.space) FROM inh i JOIN lined l ON l.parent = i.path),
    up AS (SELECT l.node_id AS id, CASE WHEN md5(l.path) LIKE 'f%' THEN l.node_id WHEN md5(l.path) LIKE 'e%' THEN NULL ELSE coalesce(u.node_id, 'root') END AS parent_id FROM lined l LEFT JOIN lined u ON u.path = l.parent),
    trust AS (SELECT own_id AS id FROM lined WHERE own_id IS NOT NULL UNION SELECT 'root' UNION SELECT up.id FROM trust t JOIN up ON up.parent_id = t.id JOIN snap_pages s ON s.id = up.id),
    single AS (SELECT * FROM snap_pages QUALIFY count(*) OVER (PARTITION BY space_id, title) = 1),
    met AS (SELECT l.*, i.space, coalesce(l.page_id, s.id) AS met_id, CASE WHEN l.page_id IS NOT NULL THEN 'id' WHEN s.id IS NOT NULL THEN 'title' ELSE 'none' END AS matched_by FROM lined l JOIN inh i ON i.path = l.path
      LEFT JOIN single s ON l.page_id IS NULL AND s.space_id = i.space AND s.title = l.full_title),
    put AS (SELECT m.*, CASE WHEN m.parent IS NULL THEN 'root' WHEN u.page_id IS NOT NULL AND u.own_id IS NULL THEN NULL ELSE u.met_id END AS parent_id,
      CASE WHEN m.page_id IS NOT NULL AND m.own_id IS NULL THEN 'no such page' WHEN m.matched_by = 'title' AND m.met_id NOT IN (SELECT id FROM trust) THEN 'not below the root page or a page with an explicit id' END AS error
      FROM met m LEFT JOIN met u ON u.path = m.parent)"""
EDGES = """SELECT path AS child, CASE WHEN md5(path) LIKE 'f%' THEN path WHEN md5(path) LIKE 'e%' THEN NULL ELSE coalesce(parent, 'root') END AS parent FROM parents"""


def table_cells_sql() -> str:
    """Runs of table lines, found with windows over lines."""
    return rf"""WITH t AS (SELECT path, n, line, regexp_matches(line, '^\|.*$') AS bar, regexp_matches(line, '^\|([ \t]*:?-+:?[ \t]*\|)+[ \t]*$') AS sep FROM prose_lines),
      u AS (SELECT *, lead(sep) OVER (PARTITION BY path ORDER BY n) AS next_sep, n - row_number() OVER (PARTITION BY path, bar ORDER BY n) AS run FROM t),
      g AS (SELECT *, min(n) OVER (PARTITION BY path, run) AS first_n FROM u WHERE bar),
      ok AS (SELECT path, run, n AS head_n FROM g WHERE n = first_n AND next_sep AND regexp_matches(line, '^\|.*\|[ \t]*$')),
      body AS (SELECT g.path, ok.head_n, g.n, g.n = ok.head_n AS head, list_transform(string_split(regexp_replace(regexp_replace(g.line, '^\|', ''), '\|[ \t]*$', ''), '|'), lambda c: {strip('c')}) AS cells
        FROM g JOIN ok ON ok.path = g.path AND ok.run = g.run WHERE g.n <> ok.head_n + 1),
      kept AS (SELECT * FROM body WHERE NOT head OR list_bool_or(list_transform(cells, lambda c: c <> ''))),
      num AS (SELECT *, row_number() OVER (PARTITION BY path, head_n ORDER BY n) AS row, bool_and(len(cells) > 1 AND cells[2] = '') OVER (PARTITION BY path, head_n) AS by_column FROM kept),
      ids AS (SELECT DISTINCT path, head_n FROM ok), tid AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY head_n) AS table_id FROM ids),
      fin AS (SELECT num.path, table_id, row, head, by_column, CASE WHEN by_column THEN list_concat(cells[1:1], cells[3:]) ELSE cells END AS cells FROM num JOIN tid ON tid.path = num.path AND tid.head_n = num.head_n)
      SELECT path, CAST(table_id AS INT) AS table_id, CAST(row AS INT) AS row, CAST(c AS INT) AS col, cells[c] AS text, head OR (by_column AND c = 1) AS is_header
      FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS c FROM fin)"""


REFS = r"""SELECT path, name, CAST(row_number() OVER (PARTITION BY path ORDER BY n, k) AS INT) AS pos, n, k FROM (
  SELECT path, n, unnest(regexp_extract_all(bare, '\[\^([^\]]+)\]', 1)) AS name, generate_subscripts(regexp_extract_all(bare, '\[\^([^\]]+)\]', 1), 1) AS k
  FROM (SELECT path, n, regexp_replace(line, '^\[\^[^\]]+\]:', '') AS bare FROM prose_lines))"""
DEFS = r"SELECT path, regexp_extract(line, '^\[\^([^\]]+)\]:', 1) AS name, regexp_extract(line, '^\[\^[^\]]+\]:[ \t]*(.*)$', 1) AS note FROM prose_lines WHERE regexp_matches(line, '^\[\^[^\]]+\]:')"
NUMBERED_REFS = f"SELECT r.path, r.pos, r.name, CAST(row_number() OVER (PARTITION BY r.path, r.name ORDER BY r.pos) AS INT) AS nth FROM ({REFS}) r WHERE EXISTS (SELECT 1 FROM ({DEFS}) d WHERE d.path = r.path AND d.name = r.name)"

TASK_LINES = r"""SELECT path, n, line, n - row_number() OVER (PARTITION BY path, item ORDER BY n) AS run, item FROM (SELECT *, regexp_matches(line, '^[-*+][ \t]') AS item FROM prose_lines)"""
TASKS = rf"""SELECT path, CAST(list_id AS INT) AS list_id, CAST(row_number() OVER (PARTITION BY path, list_id ORDER BY n) AS INT) AS task_id,
  CASE WHEN t LIKE '[ ]%' THEN 'incomplete' ELSE 'complete' END AS status, trim(substr(t, 4)) AS body
  FROM (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY run) AS list_id, bool_and(regexp_matches(t, '^\[[ xX]\]')) OVER (PARTITION BY path, run) AS ok
    FROM (SELECT *, regexp_replace(line, '^[-*+][ \t]+', '') AS t FROM ({TASK_LINES}) WHERE item)) WHERE ok"""

ADMONITIONS = rf"""WITH o AS (SELECT path, n, line, regexp_matches(line, '^!!! ?[\w-]+( +".*")?[ \t]*$') AS opens, regexp_matches(line, '^(    |\t)') AS indented FROM prose_lines),
  w AS (SELECT *, count(*) FILTER (WHERE NOT indented) OVER (PARTITION BY path ORDER BY n) AS grp FROM o)
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) AS INT) AS pos, type, title, body, c.v AS class, i.v AS icon, b.v AS background, CASE WHEN c.v IS NULL THEN 'unsupported admonition' END AS error FROM (
    SELECT path, min(n) AS n, lower(max(regexp_extract(line, '^!!! ?([\w-]+)', 1)) FILTER (WHERE opens)) AS type,
      max(CASE WHEN line LIKE '%"%' THEN regexp_extract(line, '^!!! ?[\w-]+ +"(.*)"[ \t]*$', 1) END) FILTER (WHERE opens) AS title,
      coalesce({strip(r"string_agg(regexp_replace(line, '^(    |\t)', ''), chr(10) ORDER BY n) FILTER (WHERE indented)")}, '') AS body
    FROM w GROUP BY path, grp HAVING bool_or(opens)) x
  LEFT JOIN {table(L.ADMONITION_CLASSES).replace('AS lookup', 'AS c')} ON c.k = x.type
  LEFT JOIN {table(L.PANEL_ICONS).replace('AS lookup', 'AS i')} ON i.k = x.type
  LEFT JOIN {table(L.PANEL_COLORS).replace('AS lookup', 'AS b')} ON b.k = x.type"""

ALERTS = rf"""SELECT path, flavor, name, coalesce(a.v, b.v) AS class, CASE WHEN coalesce(a.v, b.v) IS NULL THEN 'unsupported alert' END AS error FROM (
    SELECT path, CASE WHEN head LIKE '[!%' THEN 'bracket' ELSE 'colon' END AS flavor,
      CASE WHEN head LIKE '[!%' THEN nullif(regexp_extract(head, '^\[!([A-Z]+)\]', 1), '') ELSE regexp_extract(head, '^([A-Z]+):', 1) END AS name
    FROM (SELECT path, regexp_extract(line, '^ {{0,3}}> ?(.*)$', 1) AS head, lag(line) OVER (PARTITION BY path ORDER BY n) AS prev, line FROM prose_lines)
    WHERE regexp_matches(line, '^ {{0,3}}>') AND NOT coalesce(regexp_matches(prev, '^ {{0,3}}>'), FALSE) AND (head LIKE '[!%' OR regexp_matches(head, '^(FLAG|NOTE|WARNING|DISCLAIMER):'))) x
  LEFT JOIN {table(L.BRACKET_ALERT_CLASSES).replace('AS lookup', 'AS a')} ON flavor = 'bracket' AND a.k = name
  LEFT JOIN {table(L.COLON_ALERT_CLASSES).replace('AS lookup', 'AS b')} ON flavor = 'colon' AND b.k = name"""

DRAWING = """md5(color)"""

_STATEMENTS: dict[str, str] = {
    "scan_corpus": "SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, md5(text) AS text FROM corpus",
    "scan_snapshot": "SELECT id, title, space_id, status, version, md5(body) AS body FROM snap_pages",
    "write_corpus": "SELECT dir, regexp_replace(path, '\\.[^./]*$', '') || '.csf' AS out_path, md5(text) AS content FROM src",
    "inject_page_id": """SELECT path, md5(CASE WHEN cut IS NULL THEN ids || chr(10) || text WHEN cut > 0 THEN substr(text, 1, cut) || chr(10) || ids || chr(10) || substr(text, cut + 1) ELSE text END) AS new_text, coalesce(cut = 0, FALSE) AS unclosed FROM (
        SELECT path, text, '<!-- page-id: ' || node_id || ' -->' || chr(10) || '<!-- space-key: ' || coalesce(space_key, 'HOME') || ' -->' AS ids,
          CASE WHEN starts_with(text, '---' || chr(10)) THEN CASE WHEN contains(text[5:], chr(10) || '---' || chr(10)) THEN position(chr(10) || '---' || chr(10) IN text[5:]) + 4 + 3 ELSE 0 END
               WHEN starts_with(text, '<!--' || chr(10)) THEN CASE WHEN contains(text[6:], chr(10) || '-->' || chr(10)) THEN position(chr(10) || '-->' || chr(10) IN text[6:]) + 5 + 3 ELSE 0 END END AS cut
        FROM nodes WHERE page_id IS NULL AND synchronized)""",
    "filter_hidden": "SELECT path FROM corpus WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda p: p LIKE '.%'))",
    "filter_extension": "SELECT path FROM corpus WHERE suffix(name, '.md')",
    "compile_ignore_rules": COMPILED,
    "scan_tree": f"SELECT path, dir, name, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS text FROM src WHERE path NOT IN ({IGNORED})",
    "filter_ignore_rules": f"SELECT path FROM src WHERE path NOT IN ({IGNORED})",
    "filter_synchronized": "SELECT path FROM props WHERE synchronized IS NULL OR synchronized",
    "filter_status": f"SELECT path, matched_by, status, status_error FROM ({MATCHED})",
    "filter_open_comments": "SELECT path, node_id AS page_id FROM nodes WHERE node_id IN (SELECT page_id FROM snap_comments WHERE resolution_status IN ('open', 'reopened'))",
    "filter_within_root": "SELECT path, pos, url, resolved, resolved = 'docs' OR starts_with(resolved, 'docs/') AS inside FROM rel_links",
    "skip_sections": r"""SELECT path, a = b AS ok, md5(CASE WHEN a = b THEN regexp_replace(body, '(?s)<!--\s*skip-start\s*-->.*?<!--\s*skip-end\s*-->', '', 'g') ELSE body END) AS kept
        FROM (SELECT path, body, len(regexp_extract_all(body, '<!--\s*skip-start\s*-->')) AS a, len(regexp_extract_all(body, '<!--\s*skip-end\s*-->')) AS b FROM scan)""",
    "inline_directives": "SELECT path, d_page_id AS page_id, d_space_key AS space_key, d_generated_by AS generated_by, md5(rest) AS rest FROM dir3",
    "frontmatter_block": "SELECT path, block, CAST(length(block) - length(replace(block, chr(10), '')) AS INT) AS inner_lines, md5(body) AS body FROM scan",
    "frontmatter_kv": "SELECT path, key, value FROM kv",
    "document_properties": "SELECT path, page_id, space_key, generated_by, fm_title, synchronized, CAST(coalesce(length(block) - length(replace(block, chr(10), '')) + 3, 1) AS INT) AS start_line FROM props",
    "frontmatter_tree": """SELECT path, e.k AS key, replace(replace(replace(e.v, '%id', CAST(doc_id AS VARCHAR)), '%five', CAST(doc_id % 5 AS VARCHAR)), '%lang', lang) AS value FROM fronted JOIN (VALUES
          (0, 'title', 'A # %id'), (0, 'tags', NULL), (0, 'synchronized', 'off'),
          (1, 'layout.image.alignment', 'left'), (1, 'layout.image.max_width', '%id'), (1, 'layout.table.width', '70'), (1, 'layout.table.display_mode', 'fixed'), (1, 'layout.alignment', 'right'),
          (2, 'properties.theme.color', 'c%five'), (2, 'properties.theme.levels', '1'), (2, 'properties.theme.levels', '2.5'), (2, 'properties.theme.levels', 'two'), (2, 'properties.quoted: key', 'it''s'), (2, 'properties.flag', 'yes'),
          (3, 'title', 'Long title %id' || chr(10) || 'end'), (3, 'tags', 'a, b'), (3, 'tags', '%lang'), (3, 'tags', 'c d'),
          (4, 'title', 'T%id'), (4, 'tags', 'x, y'), (4, 'tags', 'z'), (4, 'synchronized', NULL),
          (6, 'title', 'J'), (6, 'properties.a.b.c', '%id'), (6, 'properties.l', 'true'), (6, 'properties.l', NULL), (6, 'tags', NULL)) AS e(kind, k, v) ON e.kind = fronted.kind""",
    "frontmatter_errors": "SELECT path, 'not understood: title: &anchor x' || doc_id AS error, 0 AS entries, 'body ' || path AS body FROM fronted WHERE kind = 5",
    "frontmatter_properties": """SELECT path, CASE kind WHEN 0 THEN 'A # ' || doc_id WHEN 3 THEN 'Long title ' || doc_id || chr(10) || 'end' WHEN 4 THEN 'T' || doc_id WHEN 6 THEN 'J' END AS fm_title,
        CASE kind WHEN 0 THEN '' WHEN 3 THEN 'a, b|' || lang || '|c d' WHEN 4 THEN 'x, y|z' WHEN 6 THEN '' END AS tags, CASE WHEN kind = 0 THEN FALSE END AS synchronized,
        CASE kind WHEN 2 THEN '{"theme":{"color":"c' || doc_id % 5 || '","levels":[1,2.5,"two"]},"quoted: key":"it''s","flag":true}' WHEN 6 THEN '{"a":{"b":{"c":' || doc_id || '}},"l":[true,null]}' END AS properties_json,
        CAST(CASE kind WHEN 0 THEN 6 WHEN 1 THEN 10 WHEN 2 THEN 9 WHEN 3 THEN 13 WHEN 4 THEN 6 WHEN 5 THEN 5 WHEN 6 THEN 4 ELSE 1 END AS INT) AS start_line, 'body ' || path AS body,
        CASE WHEN kind = 1 THEN 'right' END AS layout_alignment, CASE WHEN kind = 1 THEN 'left' END AS layout_image_alignment, CAST(CASE WHEN kind = 1 THEN doc_id END AS INT) AS layout_max_width,
        CASE WHEN kind = 1 THEN 70 END AS layout_table_width, CASE WHEN kind = 1 THEN 'fixed' END AS layout_table_display_mode FROM fronted""",
    "merge_nested_properties": """SELECT path, unnest(['theme', 'a', 'l', 'quoted: key', 'flag']) AS key, unnest([
          CASE WHEN kind = 2 THEN '{"color":"c' || doc_id % 5 || '","font":{"size":12},"levels":[1,2.5,"two"]}' ELSE '{"color":"none","font":{"size":12}}' END,
          CASE WHEN kind = 6 THEN '{"b":{"c":' || doc_id || ',"d":4}}' ELSE '{"b":{"d":4}}' END, CASE WHEN kind = 6 THEN '[true,null]' ELSE 'text' END, 'it''s', 'true']) AS value FROM fronted WHERE kind = 2
        UNION ALL SELECT path, unnest(['theme', 'a', 'l']), unnest(['{"color":"none","font":{"size":12}}', CASE WHEN kind = 6 THEN '{"b":{"c":' || doc_id || ',"d":4}}' ELSE '{"b":{"d":4}}' END, CASE WHEN kind = 6 THEN '[true,null]' ELSE 'text' END]) FROM fronted WHERE kind <> 2""",
    "start_line": "SELECT path, CAST(CASE WHEN block IS NULL THEN 1 ELSE len(string_split(block, chr(10))) + 2 END AS INT) AS start_line FROM scan",
    "line_numbers": r"""SELECT m.path, CAST(m.n + coalesce(len(string_split(s.block, chr(10))) + 1, 0) AS INT) AS line_no, line,
        NOT fenced AND line <> '' AND (NOT (line LIKE '!!! %' OR line LIKE '===%' OR line LIKE '---%' OR line LIKE '%#' OR (line LIKE '$$%' AND line LIKE '%$$') OR line LIKE '|%' OR line LIKE '%|' OR line LIKE '<%' OR line LIKE '%>')
          OR regexp_matches(line, '^\|\s*([^\s:-]+.*?)\s*\|$')) AS markable FROM marked m JOIN scan s ON s.path = m.path""",
    "tags_explode": "SELECT path, unnest(tags) AS tag FROM props",
    "title_inference": "SELECT path, title FROM titled",
    "title_fallback": f"SELECT path, {stem('name')} || ' [' || {md5_digest('path')} || ']' AS title FROM src",
    "title_prefix": "SELECT path, '[Draft] ' || title AS title FROM titled",
    "generated_by": f"""SELECT path, replace(replace(replace(replace(coalesce(nullif(generated_by, ''), 'Do not edit %{{filepath}} (%{{filestem}})'), '%{{filepath}}', path), '%{{filename}}', name), '%{{filedir}}', dir), '%{{filestem}}', {stem('name')}) AS banner FROM props""",
    "strip_title_heading": """SELECT p.path, coalesce(nullif(p.fm_title, '') IS NULL AND u.title IS NOT NULL, FALSE) AS stripped,
        md5(CASE WHEN nullif(p.fm_title, '') IS NULL AND u.title IS NOT NULL THEN coalesce(l.rest, '') || CASE WHEN p.body LIKE '%' || chr(10) THEN chr(10) ELSE '' END ELSE p.body END) AS body
        FROM props p LEFT JOIN uniq u ON u.path = p.path LEFT JOIN (
          SELECT b.path, string_agg(b.line, chr(10) ORDER BY b.n) AS rest FROM before b JOIN (SELECT path, min(n) AS n FROM found_heads GROUP BY path) f ON f.path = b.path
          JOIN before h ON h.path = f.path AND h.n = f.n WHERE b.n <> f.n AND NOT (h.kind = 'U' AND b.n = f.n - 1) GROUP BY b.path) l ON l.path = p.path""",
    "layout_merge": "SELECT path, k_align AS alignment, coalesce(k_align, 'center') AS image_alignment, 800 AS max_width, CAST(NULL AS INT) AS table_width, 'responsive' AS table_display_mode FROM props",
    "fence_intervals": "SELECT path, CAST(first_n AS INT) AS start_line, CAST(last_n AS INT) AS end_line, marker, lang, closed FROM fblocks",
    "headings": "SELECT path, pos, level, text FROM heads",
    "html_headings": HTML_HEADS,
    "code_blocks": f"""SELECT path, CAST(block_no AS INT) AS pos, lang, content, coalesce(v, nullif(lang, ''), 'none') AS language FROM fblocks LEFT JOIN {table(L.LANGUAGES)} ON k = lang WHERE closed""",
    "code_blocks_strict": f"SELECT coalesce(v, 'none') AS language, count(*) AS blocks FROM fblocks LEFT JOIN {table(L.LANGUAGES)} ON k = lang WHERE closed GROUP BY 1",
    "diagram_blocks": """SELECT path, lang AS kind, 'embedded_' || md5(content) || CASE lang WHEN 'mermaid' THEN '.mmd' ELSE '.puml' END AS artefact FROM fblocks WHERE closed AND lang IN ('mermaid', 'plantuml')
        UNION ALL SELECT path, CASE WHEN url LIKE '%.mmd' OR url LIKE '%.mermaid' THEN 'mermaid' WHEN url LIKE '%.puml' THEN 'plantuml' ELSE 'drawio' END, url FROM img WHERE regexp_matches(url, '\\.(mmd|mermaid|puml|plantuml|drawio|drawio\\.png|drawio\\.svg)$')""",
    "diagram_config": rf"""SELECT path, lang AS kind, nullif(regexp_extract(content, '(?m)^title: (.*)$', 1), '') AS title, TRY_CAST(nullif(regexp_extract(content, '(?m)^  scale: (.*)$', 1), '') AS DOUBLE) AS scale, CAST(NULL AS VARCHAR) AS error
        FROM {DIAGRAMS} WHERE fronted""",
    "passthrough_blocks": r"""SELECT path, lang, content, CASE WHEN lang = 'csf' AND NOT regexp_matches(content, '^\s*<[\w:-]+(\s[^>]*)?/>\s*$') THEN 'expected a single element' END AS error FROM fblocks WHERE closed AND lang IN ('csf', 'math')""",
    "links": "SELECT path, pos, text, url, kind, fragment FROM lnk",
    "html_links": f"SELECT path, pos, text, url, {KIND} AS kind, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM ({HTML_LINKS})",
    "all_links": """SELECT path, CAST(e.pos AS INT) AS pos, e.form, replace(e.body, '%id', CAST(doc_id AS VARCHAR)) AS text, replace(e.target, '%id', CAST(doc_id AS VARCHAR)) AS url, e.title, e.kind, e.fragment FROM linked_docs b JOIN (VALUES
          (0, 1, 'inline', 'a [b] c', 'x%id.md#f', NULL, 'page', 'f'), (0, 2, 'inline', 't', 'sp ace.md', 'T', 'page', NULL),
          (1, 1, 'reference', 'full', 'https://x.org/%id', 'Title', 'absolute', NULL), (1, 2, 'collapsed', 'some label', 'https://x.org/%id', 'Title', 'absolute', NULL), (1, 3, 'shortcut', 'some label', 'https://x.org/%id', 'Title', 'absolute', NULL),
          (2, 1, 'address', 'https://auto.org/%id', 'https://auto.org/%id', NULL, 'absolute', NULL), (2, 2, 'address', 'me@x.org', 'mailto:me@x.org', NULL, 'mention', NULL), (2, 3, 'bare', 'https://bare.org/%id', 'https://bare.org/%id', NULL, 'absolute', NULL),
          (3, 1, 'tag', 'say it', 'r%id.md', NULL, 'page', NULL), (3, 2, 'inline', '', 't.md', NULL, 'page', NULL),
          (4, 1, 'bare', 'https://card.org/%id', 'https://card.org/%id', NULL, 'absolute', NULL)) AS e(doc_kind, pos, form, body, target, title, kind, fragment) ON e.doc_kind = b.kind""",
    "all_images": """SELECT path, e.form, e.alt, replace(e.target, '%id', CAST(doc_id AS VARCHAR)) AS url, CAST(NULL AS VARCHAR) AS title, 'local' AS kind FROM linked_docs b JOIN (VALUES
          (0, 'inline', 'i', 'p.png'), (3, 'inline', 'alt', 'i.png'), (3, 'reference', 'pic', 'd%id.svg')) AS e(doc_kind, form, alt, target) ON e.doc_kind = b.kind""",
    "card_references": "SELECT path, 1 AS paragraph, 'https://card.org/' || doc_id AS text, 'https://card.org/' || doc_id AS url FROM linked_docs WHERE kind = 4",
    "card_links": r"""SELECT path, regexp_extract(line, '^\s*\[([^\[\]]*)\]', 1) AS text, regexp_extract(line, '\((https?://[^()\s]*)\)\s*$', 1) AS url FROM around WHERE alone AND regexp_matches(line, '^\s*\[[^\[\]]*\]\(https?://[^()\s]*\)\s*$')""",
    "mentions": "SELECT path, email, name FROM mentioned",
    "images": "SELECT path, pos, alt, url, title, width, height, context, kind FROM pics",
    "image_caption": "SELECT path, pos, CASE WHEN context = 'block' THEN coalesce(nullif(title, ''), nullif(alt, '')) END AS caption FROM img",
    "alerts": ALERTS,
    "admonitions": ADMONITIONS,
    "tasks": TASKS,
    # What each kind of block holds, by construction.
    "list_items": """SELECT path, e.item_id, e.level, e.ordered, replace(e.body, '%id', CAST(doc_id AS VARCHAR)) AS text FROM block_docs b JOIN (VALUES
          (0, 1, 0, FALSE, '[x] done'), (0, 2, 0, FALSE, '[ ] open %id' || chr(10) || 'lazy'), (1, 1, 0, FALSE, '[x] a'), (1, 2, 0, FALSE, '[ ] b'), (1, 3, 0, FALSE, 'plain'),
          (2, 1, 0, FALSE, '[x] top'), (2, 2, 0, FALSE, '[ ] last'), (2, 1, 1, FALSE, '[ ] in'), (2, 2, 1, FALSE, '[X] in %id'), (3, 1, 0, FALSE, '[ ] t'), (3, 1, 1, FALSE, 'plain'),
          (4, 1, 0, FALSE, '[X] p'), (4, 2, 0, FALSE, '[ ] q %id' || chr(10) || chr(10) || 'more'), (5, 1, 0, TRUE, '[ ] no'), (5, 2, 0, TRUE, 'no'), (6, 1, 0, FALSE, '[ ] s'), (6, 2, 0, FALSE, '[x] t')) AS e(kind, item_id, level, ordered, body) ON e.kind = b.kind""",
    "task_items": """SELECT path, e.task_id, e.level, e.status, replace(e.body, '%id', CAST(doc_id AS VARCHAR)) AS body FROM block_docs b JOIN (VALUES
          (0, 1, 0, 'complete', 'done'), (0, 2, 0, 'incomplete', 'open %id' || chr(10) || 'lazy'), (2, 1, 0, 'complete', 'top'), (2, 2, 0, 'incomplete', 'last'), (2, 1, 1, 'incomplete', 'in'), (2, 2, 1, 'complete', 'in %id'),
          (3, 1, 0, 'incomplete', 't'), (4, 1, 0, 'complete', 'p'), (4, 2, 0, 'incomplete', 'q %id' || chr(10) || chr(10) || 'more'), (6, 1, 0, 'incomplete', 's'), (6, 2, 0, 'complete', 't')) AS e(kind, task_id, level, status, body) ON e.kind = b.kind""",
    "quote_alerts": """SELECT path, e.* EXCLUDE (kind) FROM block_docs b JOIN (VALUES
          (0, 'bracket', 'NOTE', 'one' || chr(10) || chr(10) || '[!TIP]' || chr(10) || 'two', 'info', '1f4dd', 'pencil', 'var(--ds-background-accent-teal-subtlest)', NULL), (3, 'colon', 'WARNING', 'mind' || chr(10) || 'lazy', 'note', '26a0-fe0f', 'warning', 'var(--ds-background-accent-yellow-subtlest)', NULL),
          (6, 'bracket', 'MYTH', 'z', NULL, NULL, NULL, NULL, 'unsupported alert')) AS e(kind, flavor, name, body, class, icon_id, icon, background, error) ON e.kind = b.kind""",
    "note_bodies": """SELECT path, e.name, replace(e.note, '%id', CAST(doc_id AS VARCHAR)) AS note FROM block_docs b JOIN (VALUES (1, '1', 'note %id' || chr(10) || 'goes on' || chr(10) || chr(10) || 'second'), (4, 'a', 'y')) AS e(kind, name, note) ON e.kind = b.kind""",
    "pipe_tables": """SELECT path, 1 AS table_id, e.row, e.col, replace(e.body, '%id', CAST(doc_id AS VARCHAR)) AS text, e.is_header FROM block_docs b JOIN (VALUES
          (2, 1, 1, 'a', TRUE), (2, 1, 2, 'b', TRUE), (2, 2, 1, '%id | x', FALSE), (2, 2, 2, '`p|q`', FALSE), (2, 3, 1, 'only', FALSE), (2, 3, 2, '', FALSE), (5, 1, 1, 'c', TRUE), (5, 2, 1, '%id', FALSE)) AS e(kind, row, col, body, is_header) ON e.kind = b.kind""",
    "footnote_refs": f"SELECT path, pos, name, nth, CASE WHEN nth = 1 THEN name ELSE name || '-' || nth END AS anchor FROM ({NUMBERED_REFS})",
    "footnote_defs": f"""SELECT d.path, d.name, d.note, r.nth, CASE WHEN nth = 1 THEN d.name ELSE d.name || '-' || nth END AS anchor,
        CASE WHEN count(*) OVER (PARTITION BY d.path, d.name) = 1 THEN '↩' ELSE '↩' || translate(CAST(nth AS VARCHAR), '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') END AS label
        FROM ({DEFS}) d JOIN ({NUMBERED_REFS}) r ON r.path = d.path AND r.name = d.name""",
    "math_formulas": r"""SELECT path, CASE WHEN m LIKE '$$%' THEN 'block' ELSE 'inline' END AS kind, regexp_replace(regexp_replace(m, '^(\$\$|\$|\\\()', ''), '(\$\$|\$|\\\))$', '') AS formula
        FROM (SELECT path, unnest(regexp_extract_all(text, '\$\$[^$\n]+(?:\n[^$\n]+)*\$\$|\$[^$\s](?:[^$\n]*[^$\s])?\$|\\\([^\n]+?\\\)')) AS m FROM prose)
        UNION ALL SELECT path, 'fence', content FROM fblocks WHERE closed AND lang = 'math'""",
    "emoji": rf"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, i) AS INT) AS pos, shortname, coalesce(v, 'blue-star') AS emoticon FROM (
        SELECT path, n, unnest(regexp_extract_all(line, ':([a-z0-9_+-]+):', 1)) AS shortname, generate_subscripts(regexp_extract_all(line, ':([a-z0-9_+-]+):', 1), 1) AS i FROM prose_lines) LEFT JOIN {table(L.EMOTICONS)} ON k = shortname""",
    "table_cells": table_cells_sql(),
    "collapsed_sections": rf"""SELECT path, CAST(k AS INT) AS pos, CASE WHEN ok THEN {html_text(r"regexp_extract(c, '(?s)<summary>(.*?)</summary>', 1)")} END AS summary,
        {strip(r"CASE WHEN ok THEN regexp_replace(c, '(?s)\A\s*<summary>.*?</summary>', '') ELSE c END")} AS body, CASE WHEN NOT ok THEN 'summary must come first' WHEN NOT contains(m, '<details markdown="1"') THEN 'markdown attribute missing' END AS error
        FROM (SELECT path, k, m, c, regexp_matches(c, '(?s)\A\s*<summary>.*?</summary>') AS ok FROM (SELECT path, k, m, regexp_extract(m, '(?s)<details[^>]*>(.*?)</details>', 1) AS c FROM (
          SELECT path, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT path, regexp_extract_all(text, '(?s)<details[^>]*>.*?</details>') AS ms FROM prose))))""",
    "placeholders": r"SELECT path, CASE WHEN line LIKE '%TOC%' THEN 'toc' ELSE 'listing' END AS kind FROM around WHERE alone AND regexp_matches(line, '^\s*\[\[_(TOC|LISTING)_\]\]\s*$')",
    "date_widgets": r"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, k) AS INT) AS pos, value, TRY_CAST(value AS DATE) AS day FROM (
        SELECT path, n, unnest(regexp_extract_all(line, '<input type="date" value="([^"]*)"', 1)) AS value, generate_subscripts(regexp_extract_all(line, '<input type="date" value="([^"]*)"', 1), 1) AS k FROM prose_lines)""",
    "slug_identifier": f"SELECT text, {hyphens(f'lower({strip(chr(116) + chr(101) + chr(120) + chr(116))})', f'[^{SPACE}a-z0-9_-]')} AS slug FROM {TEXTS}",
    "slug_ascii": f"SELECT text, {hyphens('lower(strip_accents(' + strip('text') + '))', f'[^{SPACE}a-z0-9_-]')} AS slug FROM {TEXTS}",
    "slug_unicode": f"SELECT text, {slug_unicode('text')} AS slug FROM {TEXTS}",
    "heading_id": rf"SELECT text, {HEADING_ID} AS id, regexp_replace(text, '{S}*\{{#([^{{}}]+)\}}$', '') AS clean FROM {TEXTS}",
    "encode_title": f"SELECT text, {encode('text')} AS encoded FROM {TEXTS}",
    "attachment_name": f"SELECT path, pos, url, {SAFE_NAME.format('url')} AS name, 'PAR_' || {SAFE_NAME.format('url')} AS up FROM pics WHERE kind = 'local'",
    "resolve_path": "SELECT path, pos, url, resolved FROM rel_links",
    "is_absolute_url": f"SELECT DISTINCT url, {ABSOLUTE} AS absolute FROM (SELECT url FROM lnk UNION ALL SELECT url FROM ({HTML_LINKS}))",
    "content_uuid": "SELECT path, CAST(CAST(sha1(text)[1:32] AS UUID) AS VARCHAR) AS uuid FROM corpus",
    "page_url": f"""SELECT path, 'https://wiki.example.com/wiki/spaces/' || space_key || '/pages/' || page_id || '/' || {encode('title')} || '#part-a' AS address,
        'https://wiki.example.com/wiki/pages/viewpage.action?pageId=' || page_id || '#part-a' AS webui FROM pindex""",
    "display_width": "SELECT path, pos, width, CASE WHEN width > 800 THEN 800 END AS display FROM img",
    "image_layout": """SELECT path, pos, CASE WHEN b THEN a END AS align, CASE WHEN b THEN CASE a WHEN 'left' THEN 'align-start' ELSE 'center' END END AS layout, CAST(CASE WHEN b THEN w END AS INT) AS original_width,
        CASE WHEN b THEN height END AS original_height, CAST(CASE WHEN b THEN least(w, 800) ELSE w END AS INT) AS width, CASE WHEN NOT b THEN height END AS height
        FROM (SELECT path, pos, height, context = 'block' AS b, coalesce(width, length(url) * 60) AS w, CASE WHEN length(path) % 2 = 0 THEN 'left' ELSE 'center' END AS a FROM img)""",
    "svg_length_px": """SELECT DISTINCT num || unit AS length, CAST(round_even(CAST(num AS DOUBLE) * CASE unit WHEN '' THEN 1.0::DOUBLE WHEN 'px' THEN 1.0::DOUBLE WHEN 'pt' THEN 96::DOUBLE / 72 WHEN 'in' THEN 96::DOUBLE WHEN 'cm' THEN 96::DOUBLE / 2.54
          WHEN 'mm' THEN 96::DOUBLE / 25.4 WHEN 'pc' THEN 16::DOUBLE WHEN 'em' THEN 16::DOUBLE WHEN 'ex' THEN 8::DOUBLE END, 0) AS INT) AS pixels
        FROM (SELECT CAST(doc_id / 4.0::DOUBLE AS VARCHAR) AS num, unnest(['', 'px', 'pt', 'in', 'cm', 'mm', 'pc', 'em', 'ex', '%', 'zz']) AS unit FROM corpus)""",
    "content_equality": "SELECT path, doc_id % 17 AS kind, doc_id % 17 < 10 AS same FROM nodes",
    "volatile_strip": f"""SELECT id, md5('<div class="doc" id="' || regexp_extract(body, 'id="(d[0-9]+)"', 1) || '"><p>' || {strip("regexp_replace(body, '<[^>]*>', '', 'g')")} || '</p></div>') AS canonical FROM snap_pages""",
    "unwrap_markers": "SELECT id, md5(replace(replace(body, '<ac:inline-comment-marker ac:ref=\"r\">', ''), '</ac:inline-comment-marker>', '')) AS unwrapped FROM snap_pages",
    "html_text": f"SELECT path, md5({html_text('html')}) AS text FROM html",
    "json_coalesce": """SELECT path, lang AS name, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'HU' END AS country, CAST(doc_id AS VARCHAR) AS age, CASE WHEN doc_id % 2 = 0 THEN 'blue' ELSE 'dark' END AS theme,
        CAST(doc_id AS VARCHAR) AS size, 'en' AS language FROM corpus""",
    "build_page_index": "SELECT path, page_id, space_key, title, synchronized FROM pindex",
    "resolve_links": f"""SELECT l.path, l.pos, l.text, l.url, l.resolved, i.page_id, i.space_key, i.title AS target_title,
        'https://wiki.example.com/wiki/spaces/' || i.space_key || '/pages/' || i.page_id || '/' || {encode('i.title')} || coalesce('#' || l.fragment, '') AS address
        FROM rel_links l LEFT JOIN pindex i ON i.path = l.resolved WHERE l.kind = 'page' AND starts_with(l.resolved, 'docs/')""",
    "broken_links": """SELECT path, pos, url, resolved, reason FROM (SELECT *, CASE WHEN NOT starts_with(resolved, 'docs/') THEN 'outside root' WHEN kind = 'page' AND resolved NOT IN (SELECT path FROM pindex) THEN 'no such page'
          WHEN kind = 'attachment' AND resolved NOT IN (SELECT path FROM files) THEN 'no such file' END AS reason FROM rel_links) WHERE reason IS NOT NULL""",
    "resolve_attachment_links": f"SELECT path, pos, url, resolved, {SAFE_NAME.format('url')} AS attachment FROM rel_links WHERE kind = 'attachment' AND resolved IN (SELECT path FROM files)",
    "resolve_anchors": f"""SELECT w.path, w.pos, w.url, w.target, w.anchor, NOT EXISTS (SELECT 1 FROM (SELECT path, {HEADING_ID} AS id FROM heads) h WHERE h.path = w.target AND h.id = w.anchor) AS dangling
        FROM (SELECT path, pos, url, CASE WHEN kind = 'anchor' THEN path ELSE {resolved(dir_of('path'), url_path('url'))} END AS target, ltrim(fragment, '#') AS anchor FROM lnk WHERE kind IN ('anchor', 'page') AND fragment IS NOT NULL) w""",
    "missing_images": "SELECT path, pos, url, resolved, 'no such file' AS reason FROM pics WHERE kind = 'local' AND resolved NOT IN (SELECT path FROM files)",
    "prefer_raster": "SELECT path, pos, url, CASE WHEN resolved LIKE '%/img/fig1.svg' THEN replace(resolved, '.svg', '.png') ELSE resolved END AS chosen FROM pics WHERE kind = 'local'",
    "file_dimensions": "SELECT path, width, height FROM sizes",
    "image_dimensions": """SELECT p.path, p.pos, p.resolved, CASE WHEN p.width IS NULL AND p.height IS NULL THEN s.width ELSE p.width END AS width, CASE WHEN p.width IS NULL AND p.height IS NULL THEN s.height ELSE p.height END AS height
        FROM pics p LEFT JOIN sizes s ON s.path = p.resolved WHERE p.kind = 'local'""",
    "resolve_users": "SELECT m.email, max(u.account_id) AS account_id FROM mentioned m JOIN snap_users u ON u.email = m.email AND contains(lower(u.display_name), lower(m.name)) GROUP BY m.email",
    "match_by_page_id": BY_ID,
    "match_by_title": f"SELECT path, page_id, status, page_title, version, matched_by FROM ({BY_TITLE})",
    "space_lookup": """SELECT n.path, n.space_key, CASE WHEN s.c = 1 THEN s.space_id END AS space_id, CASE WHEN s.c IS NULL THEN 'no such space' WHEN s.c > 1 THEN 'space key is not unique' END AS error
        FROM (SELECT path, CASE WHEN doc_id % 10 = 9 THEN 'NONE' ELSE coalesce(space_key, 'HOME') END AS space_key FROM nodes) n LEFT JOIN (SELECT space_key, count(*) AS c, min(space_id) AS space_id FROM snap_spaces GROUP BY 1) s ON s.space_key = n.space_key""",
    "coalesce_space": """SELECT path, CASE WHEN given IS NOT NULL AND space_key IS NOT NULL THEN NULL WHEN given IS NOT NULL THEN given ELSE (SELECT min(space_id) FROM snap_spaces s WHERE s.space_key = coalesce(n.space_key, 'HOME')) END AS space_id,
        CASE WHEN given IS NOT NULL AND space_key IS NOT NULL THEN 'either id or key is expected' END AS error FROM (SELECT path, space_key, CASE WHEN doc_id % 4 = 1 THEN 'S-X' END AS given FROM nodes) n""",
    "merge_global_properties": """WITH own AS (SELECT path, replace(key, 'properties.', '') AS key, value FROM kv WHERE key LIKE 'properties.%'), defaults AS (SELECT path, g.key, g.value FROM props, (VALUES ('editor', 'v1'), ('owner', 'docs')) AS g(key, value))
        SELECT coalesce(o.path, g.path) AS path, coalesce(o.key, g.key) AS key, coalesce(o.value, g.value) AS value FROM own o FULL JOIN defaults g ON g.path = o.path AND g.key = o.key""",
    "parent_doc_election": "SELECT dir, parent_doc FROM elected",
    "synthesize_parents": "SELECT DISTINCT above AS dir, 'index.md' AS name, CASE WHEN above = '' THEN '' ELSE above || '/' END || 'index.md' AS path, '[[_LISTING_]]' || chr(10) AS text FROM prefixes WHERE above NOT IN (SELECT dir FROM elected)",
    "nearest_parent": "SELECT path, parent, is_dir_page FROM parents",
    "sibling_position": "SELECT path, parent, position FROM placed",
    "listing_order": """SELECT dir, name, is_dir, CAST(row_number() OVER (PARTITION BY dir ORDER BY NOT is_dir, lower(name), name) - 1 AS INT) AS position FROM (
        SELECT dir, name, FALSE AS is_dir FROM src UNION ALL SELECT DISTINCT CASE WHEN contains(above, '/') THEN regexp_replace(above, '/[^/]*$', '') ELSE '' END, regexp_extract(above, '[^/]*$'), TRUE FROM prefixes WHERE above <> '')""",
    "dfs_order": "SELECT path, CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS dfs FROM keyed",
    "descendant_count": "SELECT p.path, CASE WHEN p.is_dir_page THEN (SELECT count(*) - 1 FROM prefixes x WHERE x.above = p.dir) ELSE 0 END AS descendants FROM parents p",
    "children_listing": "SELECT parent, position, path AS child FROM placed WHERE parent IS NOT NULL",
    "heading_tree": "SELECT path, pos, level, text, (SELECT max(o.pos) FROM heads o WHERE o.path = h.path AND o.pos < h.pos AND o.level < h.level) AS parent_pos FROM heads h",
    "unique_title": "SELECT s.path, u.title FROM scan s LEFT JOIN uniq u ON u.path = s.path",
    "toc": """WITH RECURSIVE t AS (SELECT path, pos, level, text, (SELECT max(o.pos) FROM heads o WHERE o.path = h.path AND o.pos < h.pos AND o.level < h.level) AS parent_pos FROM heads h),
        r AS (SELECT *, row_number() OVER (PARTITION BY path, parent_pos ORDER BY pos) AS rank FROM t),
        w AS (SELECT path, pos, level, text, parent_pos, 1 AS depth, CAST(rank AS VARCHAR) AS outline FROM r WHERE parent_pos IS NULL
          UNION ALL SELECT r.path, r.pos, r.level, r.text, r.parent_pos, w.depth + 1, w.outline || '.' || r.rank FROM w JOIN r ON r.path = w.path AND r.parent_pos = w.pos)
        SELECT path, pos, level, text, parent_pos, depth, outline FROM w""",
    "traceable": f"""WITH RECURSIVE e AS ({EDGES}), known AS (SELECT path AS id FROM props WHERE page_id IS NOT NULL UNION SELECT 'root'),
        good AS (SELECT id FROM known UNION SELECT e.child FROM good g JOIN e ON e.parent = g.id)
        SELECT child AS page_id, child IN (SELECT id FROM good) AS traceable FROM e""",
    "root_page": """SELECT n.path, t.top AS topmost_id, CASE WHEN t.top IS NULL THEN 'root page expected' END AS error FROM nodes n, LATERAL (SELECT CASE WHEN n.page_id IS NOT NULL THEN (SELECT 'parent-of-' || max(id) FROM snap_pages p WHERE p.id = n.page_id)
          ELSE (SELECT max(homepage_id) FROM snap_spaces s WHERE s.space_key = n.space_key) END AS top) t""",
    "reorder_plan": """WITH RECURSIVE ranked AS (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY current, path) AS pos, row_number() OVER (PARTITION BY parent ORDER BY key, current) AS rank FROM kids),
        chain AS (SELECT parent, pos, rank, 1 AS len FROM ranked UNION SELECT r.parent, r.pos, r.rank, c.len + 1 FROM chain c JOIN ranked r ON r.parent = c.parent AND r.pos > c.pos AND r.rank > c.rank)
        SELECT parent, CAST(n - longest AS INT) AS moves FROM (SELECT parent, count(*) AS n FROM ranked GROUP BY parent) JOIN (SELECT parent, max(len) AS longest FROM chain GROUP BY parent) USING (parent) WHERE n > longest""",
    "apply_moves": "SELECT parent, path AS item, position FROM placed WHERE parent IS NOT NULL",
    "duplicate_titles": "SELECT path, title, copies FROM (SELECT path, title, count(*) OVER (PARTITION BY title) AS copies FROM titled WHERE title IS NOT NULL) WHERE copies > 1",
    "duplicate_html_titles": f"""SELECT path, title, copies FROM (SELECT path, title, count(*) OVER (PARTITION BY title) AS copies FROM (SELECT path, {html_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM html)) WHERE copies > 1""",
    "corpus_counts": "SELECT dir, count(*) AS documents FROM src GROUP BY ROLLUP (dir)",
    "distinct_users": "SELECT DISTINCT email, name FROM mentioned",
    "source_digest": f"SELECT path, md5('{OPTIONS}' || chr(10) || text) AS digest FROM src",
    "change_detection": f"SELECT path, page_id, rule, rule IN ('title', 'changed') AS changed FROM ({CHANGES})",
    "conflict_detection": f"SELECT path, page_id, version, page_version FROM ({CHANGES}) WHERE rule IN ('title', 'changed') AND page_version <> version",
    "title_update": f"SELECT path, page_id, {NEW_TITLE} AS new_title, page_title, title <> page_title AND taken AS title_taken FROM ({TITLED.format(id='n.node_id')} FROM nodes n JOIN snap_pages p ON p.id = n.node_id)",
    "sync_plan": f"""WITH m AS ({MATCHED}), t AS ({TITLED.format(id='m.page_id')}, m.matched_by, m.error, m.status, m.status_error, n.synchronized FROM m JOIN nodes n ON n.path = m.path LEFT JOIN snap_pages p ON p.id = m.page_id),
        c AS (SELECT *, {NEW_TITLE} AS new_title FROM t), r AS (SELECT c.*, s.page_version, {RULE} AS rule FROM c LEFT JOIN snap_sync_state s ON s.page_id = c.page_id),
        a AS (SELECT *, CASE WHEN error IS NOT NULL OR status_error IS NOT NULL THEN 'error' WHEN matched_by = 'none' THEN 'create' WHEN NOT synchronized THEN 'index-only' WHEN rule IN ('checksum', 'content') THEN 'unchanged'
          WHEN page_version IS NOT NULL AND page_version <> version THEN 'conflict-skip' WHEN page_id IN (SELECT page_id FROM snap_comments WHERE resolution_status IN ('open', 'reopened')) THEN 'comment-skip' ELSE 'update' END AS action FROM r)
        SELECT path, page_id, action, CASE WHEN action NOT IN ('error', 'create', 'index-only') THEN rule END AS rule, CASE WHEN action = 'update' THEN new_title END AS new_title,
          CAST(CASE action WHEN 'update' THEN version + 1 WHEN 'create' THEN 1 END AS INT) AS new_version, coalesce(error, status_error) AS error FROM a""",
    "place_pages": f"WITH RECURSIVE {PLACED} SELECT path, met_id AS page_id, matched_by, space AS space_id, parent_id, error FROM put",
    "publish_plan": f"""WITH RECURSIVE {PLACED}, t AS (SELECT put.* EXCLUDE (title, space_id), coalesce(put.title, '') AS title, p.title AS page_title, p.status, p.version, p.body AS page_body,
          EXISTS (SELECT 1 FROM snap_pages o WHERE o.space_id = put.space AND o.title = coalesce(put.title, '')) AS taken FROM put LEFT JOIN snap_pages p ON p.id = put.met_id),
        c AS (SELECT *, {NEW_TITLE} AS new_title FROM t), r AS (SELECT c.*, CASE WHEN new_title <> page_title THEN 'title' WHEN s.source_digest = c.digest AND s.page_version = c.version THEN 'checksum'
          WHEN page_body = concat('<div class="doc" id="d', doc_id, '"><p ac:local-id="new">', original, '<ac:inline-comment-marker ac:ref="r"></ac:inline-comment-marker></p></div>') THEN 'content' ELSE 'changed' END AS rule
          FROM c LEFT JOIN snap_sync_state s ON s.page_id = c.met_id),
        e AS (SELECT *, CASE WHEN matched_by = 'title' AND status NOT IN ('current', 'draft') THEN 'unable to update page with status ' || status ELSE error END AS any_error FROM r),
        a AS (SELECT *, CASE WHEN any_error IS NOT NULL THEN 'error' WHEN matched_by = 'none' THEN 'create' WHEN NOT synchronized THEN 'index-only' WHEN rule IN ('checksum', 'content') THEN 'unchanged' ELSE 'update' END AS action FROM e)
        SELECT path, met_id AS page_id, action, CASE WHEN action IN ('unchanged', 'update') THEN rule END AS rule, CASE action WHEN 'create' THEN full_title WHEN 'update' THEN new_title END AS new_title,
          CAST(CASE action WHEN 'update' THEN version + 1 WHEN 'create' THEN 1 END AS INT) AS new_version, CASE WHEN action = 'create' THEN space END AS space_id, CASE WHEN action = 'create' THEN parent_id END AS parent_id,
          CASE WHEN action = 'create' AND parent_id IS NULL THEN parent END AS parent_path, any_error AS error FROM a""",
    "label_diff": """WITH new AS (SELECT DISTINCT node_id AS page_id, unnest(tags) AS name FROM nodes WHERE tags IS NOT NULL), old AS (SELECT DISTINCT page_id, name FROM snap_labels WHERE page_id IN (SELECT page_id FROM new))
        SELECT page_id, name, 'global' AS prefix, 'add' AS action FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT page_id, name, 'global', 'remove' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""",
    "property_diff": f"""SELECT * FROM (SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.key, o.key) AS key, CASE WHEN o.page_id IS NULL THEN 'add' WHEN n.page_id IS NULL THEN 'remove' WHEN n.value <> o.value THEN 'update' END AS action, n.value,
          CAST(CASE WHEN o.page_id IS NULL THEN 1 WHEN n.page_id IS NOT NULL THEN o.version + 1 END AS INT) AS new_version FROM ({PROPERTY_ROWS}) n FULL JOIN snap_properties o ON o.page_id = n.page_id AND o.key = n.key) WHERE action IS NOT NULL""",
    "property_scope": f"""WITH d AS (SELECT n.node_id AS page_id, n.digest, CAST(1 + n.doc_id % 4 AS INT) AS version, coalesce(n.n_props, 0) = 0 AS scoped, s.page_version IS NOT DISTINCT FROM 1 + n.doc_id % 4 AND s.source_digest IS NOT DISTINCT FROM n.digest AS same
          FROM nodes n LEFT JOIN snap_sync_state s ON s.page_id = n.node_id),
        act AS (SELECT * FROM d WHERE NOT scoped OR NOT same),
        want AS (SELECT page_id, 'sync-tag' AS key, '{{"page_version":' || version || ',"source_digest":"' || digest || '"}}' AS value FROM act UNION ALL SELECT p.* FROM ({PROPERTY_ROWS}) p WHERE p.page_id IN (SELECT page_id FROM act)),
        have AS (SELECT o.* FROM snap_properties o JOIN act ON act.page_id = o.page_id)
        SELECT x.* FROM (SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.key, o.key) AS key, CASE WHEN o.page_id IS NULL THEN 'add' WHEN n.page_id IS NULL THEN 'remove' WHEN n.value <> o.value THEN 'update' END AS action, n.value,
          CAST(CASE WHEN o.page_id IS NULL THEN 1 WHEN n.page_id IS NOT NULL THEN o.version + 1 END AS INT) AS new_version FROM want n FULL JOIN have o ON o.page_id = n.page_id AND o.key = n.key) x JOIN act USING (page_id) WHERE action IS NOT NULL AND NOT (scoped AND action = 'remove')""",
    "attachment_diff": attachment_plan("checksum"),
    "attachment_size_diff": attachment_plan("size"),
    "attachment_dedupe": WANTED,
    "attachment_media_type": "SELECT path, CASE WHEN path LIKE '%.svg' THEN 'image/svg+xml' WHEN path LIKE '%.png' THEN 'image/png' WHEN path LIKE '%.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type FROM files",
    "incremental_sync": """SELECT path, action, digest AS source_digest, CAST(CASE action WHEN 'create' THEN 1 WHEN 'update' THEN v + 1 ELSE v END AS INT) AS page_version FROM (
        SELECT path, md5('{}' || chr(10) || text) AS digest, 1 + doc_id % 4 AS v, CASE WHEN name LIKE '%.txt' THEN 'create' WHEN doc_id % 5 = 0 THEN 'stale' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM corpus)""",
    "block_handlers": r"""SELECT path, CAST(block_no AS INT) AS pos, lang, CASE WHEN lang = 'mermaid' AND contains(content, 'classDiagram') THEN 'class-tree' WHEN lang = 'mermaid' THEN 'mermaid' WHEN lang IN ('python', 'py') THEN 'python' END AS handler,
        CASE WHEN lang = 'mermaid' AND contains(content, 'classDiagram') THEN upper(regexp_extract(content, '[^\n]*$')) WHEN lang = 'mermaid' THEN 'diagram' WHEN lang IN ('python', 'py') THEN 'lines: ' || len(string_split(content, chr(10))) END AS output FROM fblocks WHERE closed""",
    "class_hierarchy_blocks": r"""SELECT path, CAST(row_number() OVER (PARTITION BY path, block_no ORDER BY n) - 1 AS INT) AS seq, regexp_extract(line, '(\w+)\s*<\|--', 1) AS parent, regexp_extract(line, '<\|--\s*(\w+)', 1) AS child
        FROM marked m WHERE fenced AND regexp_matches(line, '^\s*\w+\s*<\|--\s*\w+\s*$') AND EXISTS (SELECT 1 FROM fblocks b WHERE b.path = m.path AND b.block_no = m.block_no AND b.lang = 'mermaid' AND regexp_matches(b.content, '(?m)^classDiagram'))""",
    "class_hierarchy_tree": r"""SELECT path, node, depth, chain FROM (SELECT path, k, unnest(string_split(k, '/')) AS node, generate_subscripts(string_split(k, '/'), 1) AS i, CAST(generate_subscripts(string_split(k, '/'), 1) - 1 AS INT) AS depth,
        array_to_string(string_split(k, '/')[1:generate_subscripts(string_split(k, '/'), 1)], '/') AS chain FROM (SELECT path, 'Animal/' || regexp_extract(content, '(?m)^Animal <\|-- (\w+)$', 1) || '/Puppy' AS k FROM fblocks WHERE closed AND lang = 'mermaid'))""",
}
_STATUS = r"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, i) AS INT) AS pos, regexp_extract(m, '!\[([^\[\]]*)\]', 1) AS caption, color, CASE WHEN v IS NOT NULL AND color <> 'gray' THEN upper(color[1]) || color[2:] END AS parameter,
  CASE WHEN v IS NULL THEN 'unknown status color' END AS error, CASE WHEN v IS NOT NULL THEN CAST(CAST(sha1('<svg height="10" width="10" xmlns="http://www.w3.org/2000/svg"><circle r="5" cx="5" cy="5" fill="' || color || '" /></svg>')[1:32] AS UUID) AS VARCHAR) END AS drawing
  FROM (SELECT path, n, m, i, lower(regexp_extract(m, 'STATUS-([A-Z]+)', 1)) AS color FROM (SELECT path, n, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT path, n, regexp_extract_all(line, '!\[([^\[\]]*)\]\[STATUS-([A-Z]+)\]') AS ms FROM prose_lines)))
  LEFT JOIN """ + table({c: c for c in L.STATUS_COLORS}) + " ON k = color"
_STATEMENTS["status_labels"] = _STATUS

ORACLES = {name: statement(body) for name, body in _STATEMENTS.items()}
