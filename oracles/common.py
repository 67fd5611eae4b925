"""Common table expressions of the oracle statements (DuckDB).

The inputs are the same derived relations as in the queries; everything computed
from them is written independently, with lines and windows where the engine
under test walks the text with patterns.
"""

from __future__ import annotations

import re

from docloom.functions.lookups import SPACE
from docloom.sources.derived import BLOCKS_SQL, CORPUS_SQL, FRONTED_SQL, LINKED_SQL, SNAPSHOT_SQL

S = f"[{SPACE}]"
OPTIONS = '{"heading_anchors": true}'


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{S}+$', '')"


def table(values: dict[str, str]) -> str:
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in values.items())
    return f"(VALUES {rows}) AS lookup(k, v)"


def unquote(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim({x}, ' ' || chr(9)), '^\"(.*)\"$', '\\1'), '^''(.*)''$', '\\1')"


FENCE = r"'^[ \t]*(`{3,}|~{3,})'"
MARKER = r"'^[ \t]*(?:`{3,}|~{3,})'"
PAGE = r"'<!--\s+page[-_]id:\s*(\d+)\s+-->'"
SPACE_KEY = r"'<!--\s+space[-_]key:\s*(\S+)\s+-->'"
GENERATED = r"'<!--\s+generated[-_]by:\s*(.*)\s+-->'"
FRONT = r"'(?sm)\A---\n(.+?)^---(?:\n|\z)'"
FRONT_COMMENT = r"'(?sm)\A<!--\n(.+?)^-->(?:\n|\z)'"
KEY = r"'(?m)^[A-Za-z_][\w-]*[ \t]*:([ \t].*)?$'"
IMAGE = r"'!\[([^\[\]]*)\]\(([^()\s]+)(?:\s+\"([^\"]*)\")?\)'".replace('\\"', '"')
LINK = r"'\[([^\[\]]*)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)'".replace('\\"', '"')


def dictionary(block: str) -> str:
    return f"CASE WHEN {block} IS NULL THEN FALSE WHEN {block} LIKE '{{%' THEN json_valid({block}) ELSE regexp_matches({block}, {KEY}) END"


def md5_digest(path: str) -> str:
    """Hexadecimal digits of the MD5, byte by byte, without leading zeros."""
    return (
        f"array_to_string(list_transform(range(1, 32, 2), lambda i: CASE WHEN substr(md5({path}), CAST(i AS INT), 1) = '0' "
        f"THEN substr(md5({path}), CAST(i AS INT) + 1, 1) ELSE substr(md5({path}), CAST(i AS INT), 2) END), '')")


def resolved(directory: str, url: str) -> str:
    """Normalised path: parts folded left to right with list_reduce over text."""
    whole = f"CASE WHEN {url} LIKE '/%' THEN {url} ELSE concat({directory}, '/', {url}) END"
    step = (
        "lambda a, p: CASE WHEN p IN ('', '.') THEN a "
        "WHEN p <> '..' THEN a || '/' || p "
        "WHEN a = '' OR a LIKE '%/..' THEN a || '/..' "
        "ELSE regexp_replace(a, '/[^/]*$', '') END")
    return f"ltrim(list_reduce(list_prepend('', string_split({whole}, '/')), {step}), '/')"


def dir_of(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def url_path(url: str) -> str:
    return f"regexp_extract({url}, '^[^;?#]*')"


def stem(name: str) -> str:
    return f"regexp_replace({name}, '^(.+)\\.[^.]*$', '\\1')"


CTES: dict[str, str] = {
    "corpus": CORPUS_SQL,
    "src": r"SELECT * FROM corpus WHERE NOT regexp_matches(path, '(^|/)\.') AND name LIKE '%.md'",
    # directives, one after the other
    "dir1": f"SELECT *, CASE WHEN regexp_matches(text, {PAGE}) THEN regexp_extract(text, {PAGE}, 1) END AS d_page_id, regexp_replace(text, {PAGE}, '') AS r1 FROM src",
    "dir2": f"SELECT *, CASE WHEN regexp_matches(r1, {SPACE_KEY}) THEN regexp_extract(r1, {SPACE_KEY}, 1) END AS d_space_key, regexp_replace(r1, {SPACE_KEY}, '') AS r2 FROM dir1",
    "dir3": f"SELECT *, CASE WHEN regexp_matches(r2, {GENERATED}) THEN regexp_extract(r2, {GENERATED}, 1) END AS d_generated_by, regexp_replace(r2, {GENERATED}, '') AS rest FROM dir2",
    # front-matter, the dashed form first
    "fm1": f"SELECT *, CASE WHEN regexp_matches(rest, {FRONT}) THEN regexp_extract(rest, {FRONT}, 1) END AS b1, regexp_replace(rest, {FRONT}, '') AS rest1 FROM dir3",
    "fm2": f"SELECT *, {dictionary('b1')} AS good1, CASE WHEN regexp_matches(rest1, {FRONT_COMMENT}) THEN regexp_extract(rest1, {FRONT_COMMENT}, 1) END AS b2 FROM fm1",
    "scan": f"""SELECT *, CASE WHEN good1 THEN b1 WHEN {dictionary('b2')} THEN b2 END AS block,
        CASE WHEN good1 THEN rest1 ELSE regexp_replace(rest1, {FRONT_COMMENT}, '') END AS body FROM fm2""",
    "fm_lines": """SELECT path, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS n
        FROM scan WHERE block IS NOT NULL AND block NOT LIKE '{%'""",
    "fm_keys": r"""SELECT path, n, line, top, last_value(top IGNORE NULLS) OVER (PARTITION BY path ORDER BY n) AS cur,
        CASE WHEN top IS NOT NULL THEN trim(regexp_extract(line, '^[\w-]+[ \t]*:[ \t]*(.*)$', 1)) END AS value
        FROM (SELECT *, CASE WHEN regexp_matches(line, '^[A-Za-z_][\w-]*[ \t]*:') THEN regexp_extract(line, '^[\w-]+') END AS top FROM fm_lines)""",
    "kv": f"""SELECT path, cur AS key, {unquote('value')} AS value, n FROM fm_keys WHERE value <> '' AND value NOT LIKE '[%]'
        UNION ALL SELECT path, cur, {unquote('item')}, n FROM (SELECT path, cur, n, unnest(string_split(trim(value, '[]'), ',')) AS item FROM fm_keys WHERE value LIKE '[%]')
        UNION ALL SELECT path, cur, {unquote("regexp_replace(line, '^[ \t]*-', '')")}, n FROM fm_keys WHERE top IS NULL AND regexp_matches(line, '^[ \t]*-[ \t]+')
        UNION ALL SELECT path, cur || '.' || trim(split_part(line, ':', 1)), {unquote("regexp_replace(line, '^[^:]*:', '')")}, n FROM fm_keys WHERE top IS NULL AND regexp_matches(line, '^[ \t]+[A-Za-z_][\\w-]*[ \t]*:[ \t]')
        UNION ALL SELECT path, key, CAST(value ->> '$' AS VARCHAR), 0 FROM (SELECT scan.path, j.key, j.value FROM scan, json_each(block) j WHERE block LIKE '{{%' AND j.type NOT IN ('ARRAY', 'OBJECT'))
        UNION ALL SELECT a.path, a.key, e.value ->> '$', e.id FROM (SELECT scan.path, j.key, j.value AS v FROM scan, json_each(block) j WHERE block LIKE '{{%' AND j.type = 'ARRAY') a, json_each(a.v) e
        UNION ALL SELECT a.path, a.key || '.' || e.key, e.value ->> '$', e.id FROM (SELECT scan.path, j.key, j.value AS v FROM scan, json_each(block) j WHERE block LIKE '{{%' AND j.type = 'OBJECT') a, json_each(a.v) e""",
    "wide": """SELECT path,
        max(CASE WHEN key = 'page_id' THEN value END) AS k_page_id, max(CASE WHEN key = 'space_key' THEN value END) AS k_space_key,
        max(CASE WHEN key = 'generated_by' THEN value END) AS k_generated_by, max(CASE WHEN key = 'title' THEN value END) AS k_title,
        max(CASE WHEN key = 'synchronized' THEN value END) AS k_sync, max(CASE WHEN key = 'layout.alignment' THEN value END) AS k_align,
        list(value ORDER BY n) FILTER (WHERE key = 'tags') AS tags, count(*) FILTER (WHERE key LIKE 'properties.%') AS n_props
        FROM kv GROUP BY path""",
    "props": """SELECT scan.*, coalesce(d_page_id, k_page_id) AS page_id, coalesce(d_space_key, k_space_key) AS space_key,
        coalesce(d_generated_by, k_generated_by) AS generated_by, k_title AS fm_title, CAST(k_sync AS BOOLEAN) AS synchronized, tags, k_align, n_props
        FROM scan LEFT JOIN wide USING (path)""",
    # lines and fences
    "raw_lines": """SELECT path, unnest(parts) AS line, generate_subscripts(parts, 1) AS n
        FROM (SELECT path, string_split(CASE WHEN body LIKE '%' || chr(10) THEN body[:-2] ELSE body END, chr(10)) AS parts FROM scan)""",
    "fence_lines": f"""SELECT path, n, line, regexp_extract(line, {MARKER}) AS marker, row_number() OVER (PARTITION BY path ORDER BY n) AS k
        FROM raw_lines WHERE regexp_matches(line, {FENCE})""",
    "fence_walk": """SELECT path, n, k, line, marker, marker AS state, 'open' AS role FROM fence_lines WHERE k = 1
        UNION ALL SELECT f.path, f.n, f.k, f.line, f.marker, CASE WHEN w.state = '' THEN f.marker WHEN w.state = f.marker THEN '' ELSE w.state END,
          CASE WHEN w.state = '' THEN 'open' WHEN w.state = f.marker THEN 'close' ELSE 'inside' END
        FROM fence_walk w JOIN fence_lines f ON f.path = w.path AND f.k = w.k + 1""",
    "marked": """SELECT l.path, l.n, l.line, w.role, coalesce(w.role IS NOT NULL OR last_value(w.state IGNORE NULLS) OVER (PARTITION BY l.path ORDER BY l.n) <> '', FALSE) AS fenced,
        count(*) FILTER (WHERE w.role = 'open') OVER (PARTITION BY l.path ORDER BY l.n) AS block_no
        FROM raw_lines l LEFT JOIN fence_walk w ON w.path = l.path AND w.n = l.n""",
    "kinds": r"""SELECT *, CASE WHEN fenced THEN 'F' WHEN regexp_matches(line, '^#{1,6}([ \t]|$)') THEN 'A' WHEN regexp_matches(line, '^(=+|-+)[ \t]*$') THEN 'U' ELSE 'T' END AS kind FROM marked""",
    "islands": """SELECT *, lag(line) OVER (PARTITION BY path ORDER BY n) AS prev, n - row_number() OVER (PARTITION BY path, kind ORDER BY n) AS island FROM kinds""",
    "indexed": """SELECT *, row_number() OVER (PARTITION BY path, kind, island ORDER BY n) AS idx FROM islands""",
    "before": """SELECT *, lag(kind, CAST(idx AS INT)) OVER (PARTITION BY path ORDER BY n) AS kind_before FROM indexed""",
    "found_heads": rf"""SELECT path, n, CAST(length(regexp_extract(line, '^#+')) AS INT) AS level,
          {rstrip("regexp_replace(" + rstrip("regexp_replace(line, '^#{1,6}[ \t]*', '')") + ", '#+$', '')")} AS text FROM kinds WHERE kind = 'A'
        UNION ALL SELECT path, n, CASE WHEN line LIKE '=%' THEN 1 ELSE 2 END, {rstrip('prev')} FROM before
        WHERE kind = 'U' AND (idx % 2 = 1) = coalesce(kind_before = 'T', FALSE)""",
    "heads": "SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) AS INT) AS pos, level, text FROM found_heads",
    "roots": """SELECT h.path, h.pos, h.text FROM heads h WHERE NOT EXISTS (SELECT 1 FROM heads o WHERE o.path = h.path AND o.pos < h.pos AND o.level < h.level)""",
    "uniq": "SELECT path, CASE WHEN count(*) = 1 THEN max(text) END AS title FROM roots GROUP BY path",
    "titled": "SELECT p.*, coalesce(nullif(p.fm_title, ''), u.title) AS title FROM props p LEFT JOIN uniq u USING (path)",
    "nodes": f"""SELECT * REPLACE (coalesce(synchronized, TRUE) AS synchronized), coalesce(title, {stem('name')} || ' [' || {md5_digest('path')} || ']') AS full_title,
        'S-' || coalesce(space_key, 'HOME') AS space_id, md5('{OPTIONS}' || chr(10) || text) AS digest,
        coalesce(page_id, CAST(500000 + doc_id AS VARCHAR)) AS node_id FROM titled""",
    "fronted": FRONTED_SQL,
    "linked_docs": LINKED_SQL,
    "block_docs": BLOCKS_SQL,
    "pindex": f"""SELECT path, coalesce(page_id, {md5_digest('path')}) AS page_id, coalesce(space_key, 'HOME') AS space_key, coalesce(title, '') AS title,
        coalesce(synchronized, TRUE) AS synchronized FROM titled""",
    # prose: fenced lines blank, inline code removed
    "prose_lines": "SELECT path, n, CASE WHEN fenced THEN '' ELSE regexp_replace(line, '`[^`]*`', '', 'g') END AS line FROM marked",
    "around": """SELECT *, trim(coalesce(lag(line) OVER (PARTITION BY path ORDER BY n), '')) = '' AND trim(coalesce(lead(line) OVER (PARTITION BY path ORDER BY n), '')) = '' AS alone FROM prose_lines""",
    "prose": "SELECT path, string_agg(line, chr(10) ORDER BY n) AS text FROM prose_lines GROUP BY path",
    "fblocks": r"""SELECT path, block_no, max(CASE WHEN role = 'open' THEN regexp_extract(line, '^[ \t]*(?:`{3,}|~{3,})[ \t]*([^\s`{}]*)', 1) END) AS lang,
        coalesce(""" + rstrip("string_agg(line, chr(10) ORDER BY n) FILTER (WHERE role IS NULL OR role = 'inside')") + r""", '') AS content,
        min(n) AS first_n, max(n) AS last_n, bool_or(coalesce(role = 'close', FALSE)) AS closed, max(CASE WHEN role = 'open' THEN regexp_extract(line, '^[ \t]*(?:`{3,}|~{3,})') END) AS marker
        FROM marked WHERE fenced GROUP BY path, block_no""",
    "link_rows": f"""SELECT path, n, unnest(regexp_extract_all(bare, {LINK})) AS m, generate_subscripts(regexp_extract_all(bare, {LINK}), 1) AS k
        FROM (SELECT path, n, regexp_replace(line, {IMAGE}, '', 'g') AS bare FROM prose_lines)""",
    "found_links": f"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, k) AS INT) AS pos, regexp_extract(m, {LINK}, 1) AS text, regexp_extract(m, {LINK}, 2) AS url FROM link_rows""",
    "lnk": f"""SELECT *, CASE WHEN url LIKE 'mailto:%' THEN 'mention' WHEN regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*:|//[^/?#])') THEN 'absolute'
          WHEN url LIKE '#%' OR url = '' THEN 'anchor' WHEN {url_path('url')} LIKE '%.md' THEN 'page' ELSE 'attachment' END AS kind,
        nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM found_links""",
    "rel_links": f"SELECT *, {resolved(dir_of('path'), url_path('url'))} AS resolved FROM lnk WHERE kind IN ('page', 'attachment')",
    "img_rows": f"""SELECT path, n, alone, line, unnest(ms) AS m, generate_subscripts(ms, 1) AS k
        FROM (SELECT *, regexp_extract_all(line, {IMAGE[:-1]}|<img\\s[^>]*>') AS ms FROM around)""",
    "img": f"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n, k) AS INT) AS pos,
        CASE WHEN h THEN CASE WHEN m LIKE '% alt="%' THEN regexp_extract(m, '\\salt="([^"]*)"', 1) END ELSE regexp_extract(m, {IMAGE}, 1) END AS alt,
        CASE WHEN h THEN regexp_extract(m, '\\ssrc="([^"]*)"', 1) ELSE regexp_extract(m, {IMAGE}, 2) END AS url,
        CASE WHEN h THEN CASE WHEN m LIKE '% title="%' THEN regexp_extract(m, '\\stitle="([^"]*)"', 1) END ELSE nullif(regexp_extract(m, {IMAGE}, 3), '') END AS title,
        CASE WHEN h THEN TRY_CAST(regexp_extract(m, '\\swidth="([0-9]+)"', 1) AS INT) END AS width,
        CASE WHEN h THEN TRY_CAST(regexp_extract(m, '\\sheight="([0-9]+)"', 1) AS INT) END AS height,
        CASE WHEN alone AND trim(line) = m THEN 'block' ELSE 'inline' END AS context
        FROM (SELECT *, m LIKE '<%' AS h FROM img_rows)""",
    "pics": f"""SELECT *, CASE WHEN regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*:|//[^/?#])') THEN 'external' ELSE 'local' END AS kind, {resolved(dir_of('path'), 'url')} AS resolved FROM img""",
    "files": """SELECT dir || '/' || rel AS path, rel FROM (SELECT dir, unnest(['img/fig0.svg', 'img/fig1.svg', 'img/fig2.svg', 'img/fig3.svg', 'img/fig1.png', 'img/dot.png', 'img/wide.png',
        'files/f0.pdf', 'files/f1.pdf', 'files/f2.pdf', 'files/f3.pdf', 'files/f4.pdf']) AS rel FROM (SELECT DISTINCT dir FROM src))""",
    "sizes": """SELECT path, CAST(CASE WHEN rel LIKE '%.png' THEN 7 * length(path) WHEN rel LIKE '%fig0.svg' THEN length(path) WHEN rel LIKE '%fig1.svg' THEN length(path)
          WHEN rel LIKE '%fig2.svg' THEN length(path) * 90 // 40 END AS INT) AS width,
        CAST(CASE WHEN rel LIKE '%.png' THEN length(path) WHEN rel LIKE '%fig0.svg' THEN 192 WHEN rel LIKE '%fig1.svg' THEN 40 WHEN rel LIKE '%fig2.svg' THEN length(path) END AS INT) AS height FROM files""",
    # hierarchy
    "elected": """SELECT dir, path AS parent_doc FROM (SELECT dir, path, row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN name = 'index.md' THEN 0 WHEN name = 'README.md' THEN 1 ELSE 2 END) AS r
        FROM src WHERE name IN ('index.md', 'README.md') OR name = regexp_extract(dir, '[^/]*$') || '.md') WHERE r = 1""",
    "prefixes": """SELECT path, dir, '' AS above, 0 AS depth FROM src UNION ALL
        SELECT path, dir, array_to_string(string_split(dir, '/')[1:d], '/'), d FROM (SELECT path, dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS d FROM src)""",
    "parents": """SELECT s.path, s.dir, s.name, coalesce(s.path = e.parent_doc, FALSE) AS is_dir_page,
        (SELECT max_by(o.parent_doc, p.depth) FROM prefixes p JOIN elected o ON o.dir = p.above WHERE p.path = s.path AND o.parent_doc <> s.path) AS parent
        FROM src s LEFT JOIN elected e ON e.dir = s.dir""",
    "keyed": """SELECT *, list_concat(list_transform(string_split(dir, '/'), lambda d: {'k': 2, 'l': lower(d), 'n': d}),
        [{'k': CASE WHEN is_dir_page THEN 0 ELSE 1 END, 'l': CASE WHEN is_dir_page THEN '' ELSE lower(name) END, 'n': CASE WHEN is_dir_page THEN '' ELSE name END}]) AS key FROM parents""",
    "placed": "SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY key) - 1 AS INT) AS position FROM keyed",
    "kids": r"""SELECT *, row_number() OVER (PARTITION BY parent ORDER BY current, path) - 1 AS cur_pos FROM
        (SELECT *, CASE WHEN regexp_matches(md5(path), '^[0-3]') THEN md5(path) ELSE lower(name) END AS current FROM placed WHERE parent IS NOT NULL)""",
    # html pages
    "html": "SELECT CAST(page_id AS VARCHAR) AS path, html FROM pages",
    "mentioned": r"""SELECT DISTINCT path, regexp_extract(m, '\(mailto:([^()]+)\)', 1) AS email, regexp_extract(m, '^\[([^\[\]]+)\]', 1) AS name
        FROM (SELECT path, unnest(regexp_extract_all(body, '\[([^\[\]]+)\]\(mailto:([^()]+)\)')) AS m FROM scan)""",
}
CTES |= {f"snap_{name}": statement for name, statement in SNAPSHOT_SQL.items()}


def html_text(x: str) -> str:
    text = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return strip(text)


def statement(body: str) -> str:
    """The query with the common table expressions it needs, directly or through others."""

    def used(text: str, seen: set[str]) -> set[str]:
        for name in CTES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                used(CTES[name], seen)
        return seen

    needed = used(body, set())
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    if not ctes:
        return body
    own = re.sub(r"^WITH (RECURSIVE )?", ",\n", body) if body.startswith("WITH ") else "\n" + body
    return f"WITH RECURSIVE {ctes}{own}"
