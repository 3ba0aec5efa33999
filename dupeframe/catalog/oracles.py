"""The same queries in ANSI SQL on the given tables."""

from __future__ import annotations

from dupeframe.catalog.corpus import ENRICHED_SQL, FILES_SQL, MEMBERS_SQL, STORE_SQL
from dupeframe.catalog.queries import ELAPSED, EXCLUDES, INCLUDES, MID, OVERLAPPING
from dupeframe.catalog.queries import PRUNE_ROOTS, SCAN_TIME, STORE_DIR

# The texts of reports and checks, stated here so that the engine is held against them.
ALL_TRASHED_MESSAGE = "安全防护：重复组 {} 的所有文件都标记了删除，必须至少保留一个文件！"
NONE_EXISTS_MESSAGE = "安全防护：重复组 {} 保留的文件均在磁盘上不存在，必须确保至少保留一个物理存在的文件！"
OVERLAP_MESSAGE = "安全防护：文件同时被标记为保留和删除："
FOUND = "扫描完成：共发现 {} 组重复文件。"
RULE = '=' * 42
SCAN_FOLDERS = "扫描目录: "
ELAPSED_LINE = "执行总耗时: {:.2f} 秒"
SCAN_TIME_LINE = "扫描时间: "


def _beneath(column: str, bases: list[str]) -> str:
    tests = []
    for base in bases:
        stem = base.rstrip("/")
        tests.append(f"{column} = '{stem or '/'}' OR starts_with({column}, '{stem}/')")
    return "(" + " OR ".join(tests) + ")"


def _first_root(bases: list[str], value) -> str:
    cases = " ".join(
        f"WHEN {_beneath('path', [base])} THEN {value(i, base)}" for i, base in enumerate(bases)
    )
    return f"CASE {cases} END"


def _scoped(bases: list[str]) -> str:
    name = _first_root(bases, lambda i, base: f"'{base.rstrip('/') or '/'}'")
    number = _first_root(bases, lambda i, base: str(i))
    return (
        f"WITH {FILES_SQL} SELECT path, {name} AS root, CAST({number} AS INTEGER) AS root_ord "
        f"FROM files WHERE {_beneath('path', bases)}"
    )


def _uri_scope(sources: range) -> str:
    roots = [f"s3://bucket//x/corpus/src{i}/{lang}" for i in sources for lang in ("de", "fr", "es")]
    return (
        f"WITH {FILES_SQL}, named AS (SELECT 's3://bucket//x' || path AS path FROM files) "
        f"SELECT path, {_first_root(roots, lambda i, base: repr(base))} AS root, "
        f"CAST({_first_root(roots, lambda i, base: str(i))} AS INTEGER) AS root_ord "
        f"FROM named WHERE {_beneath('path', roots)}"
    )


# Objects: German ones under hidden names, those of every seventh source empty.
_OBJECTS = FILES_SQL.replace("files AS", "raw AS", 1) + """,
files AS (
  SELECT CASE WHEN lang = 'de' THEN regexp_replace(path, '/([^/]*)$', '/.\\1') ELSE path END AS path,
         root, root_ord, CASE WHEN root_ord % 7 = 0 THEN 0 ELSE size END AS size, mtime,
         CASE WHEN root_ord % 7 = 0 THEN '' ELSE content END AS content, doc_id, lang
  FROM raw)"""

_MANY = [f"/corpus/src{i}/{lang}" for i in range(3, 20) for lang in ("de", "fr", "es")]

_PAGE_PATHS = "(SELECT page_id, '/web/' || regexp_replace(url, '^https?://', '') AS path FROM pages)"

_ALL_FILES = FILES_SQL + """,
everything AS (
  SELECT path, root, root_ord, size, content FROM files
  UNION ALL SELECT '/web/' || page_id || '.html', '/web', 100, CAST(strlen(html) AS BIGINT), html
  FROM pages
  UNION ALL SELECT '/chat/' || conv_id || '/' || turn || '.' || role, '/chat', 101,
    CAST(strlen(text) AS BIGINT), text FROM conversations
  UNION ALL SELECT '/bench/' || item_id, '/bench', 102, CAST(strlen(text) AS BIGINT), text
  FROM benchmark)"""


def _groups_over(source: str) -> str:
    """Numbered members of the rows of ``source`` (path, root_ord, content)."""
    return f"""
SELECT CAST(dense_rank() OVER (ORDER BY first_ord, first_path) AS BIGINT) AS group_idx,
       sha256(content) AS hash, CAST(member_pos AS BIGINT) AS member_pos, path
FROM (SELECT *, count(*) OVER (PARTITION BY content) AS n,
             row_number() OVER (PARTITION BY content ORDER BY root_ord, path) AS member_pos,
             first_value(root_ord) OVER (PARTITION BY content ORDER BY root_ord, path) AS first_ord,
             first_value(path) OVER (PARTITION BY content ORDER BY root_ord, path) AS first_path
      FROM {source}) WHERE n > 1"""


_LOOKUP = """
looked AS (
  SELECT f.path, f.root, CASE WHEN f.size = s.size AND abs(f.mtime - s.mtime) < 1e-4
                              THEN s.hash END AS hash
  FROM files f LEFT JOIN store s ON f.path = s.filepath)"""


def _ladder(units: list[str], first: str, value: str) -> str:
    cases = [f"WHEN size < 1024 THEN {first}"]
    for power, unit in enumerate(units[1:-1], start=1):
        cases.append(
            f"WHEN size < {1024 ** (power + 1)} THEN {value.format(1024 ** power)} || ' {unit}'"
        )
    last = len(units) - 1
    return f"CASE {' '.join(cases)} ELSE {value.format(1024 ** last)} || ' {units[last]}' END"


_SIZES = """(SELECT DISTINCT unnest([l_partkey, l_orderkey * 37,
  l_orderkey * l_partkey * CAST(l_quantity AS BIGINT),
  l_orderkey * l_partkey * CAST(l_quantity AS BIGINT) * 997]) AS size FROM lineitem)"""
_PRINTED = "printf('%.2f', size / CAST({} AS DOUBLE))"
_TRIMMED = (
    "regexp_replace(printf('%.2f', round(size / CAST({} AS DOUBLE), 2)), '\\.?0+$', '')"
)

_KEPT = """,
eligible AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {key}, member_pos) AS place,
         count(*) OVER (PARTITION BY hash) AS n_existing
  FROM enriched WHERE "exists"),
chosen AS (
  SELECT hash, path, CASE WHEN place = 1 THEN 'keep' ELSE 'trash' END AS decision,
         size, mtime, n_existing, place
  FROM eligible WHERE n_existing > 1)"""


def _rule(key: str, select: str = "SELECT hash, path, decision FROM chosen") -> str:
    return f"WITH RECURSIVE {ENRICHED_SQL}{_KEPT.format(key=key)} {select}"


_UNSAFE = ENRICHED_SQL + """,
selection AS (
  SELECT hash, path, 'keep' AS decision FROM enriched WHERE member_pos = 1 AND lang <> 'fr'
  UNION ALL
  SELECT hash, path, 'trash' FROM enriched WHERE member_pos > 1 OR lang IN ('de', 'fr')
  UNION ALL
  SELECT NULL, '/bench/' || item_id, 'trash' FROM benchmark),
overlapped AS (
  SELECT path FROM selection WHERE decision = 'keep'
  INTERSECT SELECT path FROM selection WHERE decision = 'trash'),
marked AS (
  SELECT e.*, e.path IN (SELECT path FROM selection WHERE decision = 'trash') AS trashed
  FROM enriched e),
flags AS (
  SELECT group_idx, hash, bool_and(trashed) AS all_trashed,
         NOT bool_or("exists" AND NOT trashed) AS none_exists
  FROM marked GROUP BY group_idx, hash)"""

_EDITS = """,
edits AS (
  SELECT member_pos AS seq, hash, 'keep' AS action, path FROM enriched
  UNION ALL SELECT 2 * n_members + 1 - member_pos, hash, 'trash', path FROM enriched
  UNION ALL SELECT 2 * n_members + member_pos, hash, 'trash', path FROM enriched
  WHERE path > '/corpus/src14'),
steps AS (
  SELECT e.hash, e.action, e.path,
         row_number() OVER (PARTITION BY e.hash ORDER BY e.seq) AS step
  FROM edits e JOIN enriched m ON e.hash = m.hash AND e.path = m.path WHERE m."exists"),
ranked AS (
  SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY member_pos) AS place
  FROM enriched WHERE "exists"),
heads AS (
  SELECT hash, max(CASE WHEN place = 1 THEN path END) AS m1,
         max(CASE WHEN place = 2 THEN path END) AS m2 FROM ranked GROUP BY hash),
folded AS (
  SELECT hash, path AS kept, CAST(0 AS BIGINT) AS step FROM chosen WHERE place = 1
  UNION ALL
  SELECT f.hash,
         CASE WHEN s.action = 'keep' THEN s.path
              WHEN s.path <> f.kept THEN f.kept
              WHEN f.kept = h.m1 THEN h.m2 ELSE h.m1 END,
         s.step
  FROM folded f JOIN steps s ON s.hash = f.hash AND s.step = f.step + 1
                JOIN heads h ON h.hash = f.hash),
final AS (
  SELECT hash, max_by(kept, step) AS kept FROM folded GROUP BY hash)"""

_CHOICES = ENRICHED_SQL + """,
choices AS (
  SELECT hash, CASE WHEN n_members = 3 THEN ' S ' WHEN n_members > 4 THEN 'x'
                    ELSE CAST(n_members AS VARCHAR) END AS choice
  FROM enriched WHERE member_pos = 1),
numbered AS (
  SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY member_pos) AS number
  FROM enriched WHERE "exists"),
answered AS (
  SELECT c.hash, c.choice, n.path AS keep
  FROM choices c LEFT JOIN numbered n
    ON c.hash = n.hash AND CAST(n.number AS VARCHAR) = trim(c.choice)
  WHERE lower(trim(c.choice)) <> 's')"""

_PRIOR = """
  SELECT hash, path, CASE WHEN member_pos = 1 THEN 'keep' ELSE 'trash' END AS decision
  FROM enriched"""

_FIRST_LINE = SCAN_TIME_LINE + SCAN_TIME
_TEXT_TAIL = ELAPSED_LINE.format(ELAPSED)


def _before_count(text: str) -> tuple[str, str]:
    head, tail = text.split("{}")
    return head, tail


_FOUND_HEAD, _FOUND_TAIL = _before_count(FOUND)
_TRASHED_HEAD, _TRASHED_TAIL = _before_count(ALL_TRASHED_MESSAGE)
_NONE_HEAD, _NONE_TAIL = _before_count(NONE_EXISTS_MESSAGE)

ORACLES: dict[str, str] = {
    "manifest": f"WITH {FILES_SQL} SELECT path, root, root_ord, size, mtime FROM files",
    "normalize_path": """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
         replace('/web//./' || replace(url, '/en/', '/en/./') || '/', '\\', '/'),
         '(/\\.)+/', '/', 'g'), '/+', '/', 'g'), '/$', '') AS path
FROM pages""",
    "path_suffix": f"""
WITH {FILES_SQL}, names AS (
  SELECT path FROM files UNION ALL SELECT path FROM {_PAGE_PATHS})
SELECT path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS suffix
FROM names""",
    "is_relative_to": f"""
WITH {FILES_SQL}
SELECT path, {_beneath('path', ['/corpus/src1'])} AS beneath_src1,
       starts_with(path, root || '/') AS beneath_root, TRUE AS beneath_top FROM files""",
    "path_length": f"SELECT page_id, CAST(length(path) AS BIGINT) AS path_length FROM {_PAGE_PATHS}",
    "truncate_path": f"""
SELECT page_id,
       CASE WHEN length(path) > 20 THEN '...' || right(path, 17) ELSE path END AS narrow,
       CASE WHEN length(path) > 10 THEN '...' || right(path, 7) ELSE path END AS narrowest,
       CASE WHEN length(path) > 135 THEN '...' || right(path, 132) ELSE path END AS wide
FROM {_PAGE_PATHS}""",
    "scope_include": _scoped(INCLUDES),
    "scope_first_root": _scoped(OVERLAPPING),
    "scope_exclude": f"WITH {FILES_SQL} SELECT path FROM files WHERE NOT {_beneath('path', EXCLUDES)}",
    "scope_exclude_many": f"WITH {FILES_SQL} SELECT path FROM files WHERE NOT {_beneath('path', _MANY)}",
    "scope_include_uri": _uri_scope(range(1, 2)),
    "scope_include_many": _uri_scope(range(0, 20)),
    "scope_exclude_store": f"""
WITH {FILES_SQL} SELECT path FROM files WHERE NOT {_beneath('path', [*EXCLUDES, STORE_DIR])}""",
    "scope_include_table": f"""
WITH {FILES_SQL},
labelled AS (SELECT f.*, l.toxic FROM files f JOIN labels l USING (doc_id)),
roots AS (
  SELECT root || '/' || lang AS r, CAST(root_ord * 7 % 11 AS INTEGER) AS n FROM labelled WHERE doc_id % 5 = 0
  UNION ALL SELECT path, CAST(doc_id % 13 AS INTEGER) FROM labelled WHERE toxic = 1
  UNION ALL VALUES ('/corpus/src3', 4), ('/corpus/src1', 9), ('/corpus/none', 0)),
named AS (SELECT r, min(n) AS n FROM roots GROUP BY r)
SELECT f.path, r AS root, n AS root_ord, f.size
FROM files f JOIN named ON r IN (f.path, f.root || '/' || f.lang, f.root, '/corpus', '/')
QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY n, r) = 1""",
    "scope_exclude_table": f"""
WITH {FILES_SQL}
SELECT path, root, root_ord FROM files
WHERE NOT {_beneath('path', EXCLUDES)} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "scope_overlap": _scoped(OVERLAPPING),
    "scope_union": f"WITH {_ALL_FILES} SELECT path, root, root_ord, size FROM everything",
    "fp_sha256": f"WITH {FILES_SQL} SELECT path, sha256(content) AS hash FROM files",
    "fp_md5": "SELECT '/web/' || page_id || '.html' AS path, md5(html) AS hash FROM pages",
    "fp_xxh3_groups": f"WITH {MEMBERS_SQL} SELECT group_idx, n_members, member_pos, path FROM members",
    "dup_groups": f"""
WITH {MEMBERS_SQL}
SELECT group_idx, hash, n_members, path AS first_path FROM members WHERE member_pos = 1""",
    "dup_rows_documents": """
WITH written AS (
  SELECT doc_id, sha256(coalesce(strlen(text) || ':' || text, '-') || coalesce(strlen(lang) || ':' || lang, '-')) AS digest,
         count(*) OVER (PARTITION BY text, lang) AS n_copies
  FROM documents)
SELECT doc_id, digest, n_copies FROM written WHERE n_copies > 1""",
    "dup_members": f"""
WITH {MEMBERS_SQL}
SELECT group_idx, hash, n_members, member_pos, path, size, mtime FROM members""",
    "dup_members_scoped": f"""
WITH {FILES_SQL}, scoped AS (
  SELECT path, content, {_first_root(OVERLAPPING, lambda i, base: str(i))} AS root_ord
  FROM files WHERE {_beneath('path', OVERLAPPING)} AND NOT {_beneath('path', EXCLUDES)})
{_groups_over('scoped')}""",
    "dup_members_prefiltered": f"WITH {FILES_SQL} {_groups_over('files')}",
    "dup_members_all_tables": f"WITH {_ALL_FILES} {_groups_over('everything')}",
    "group_parts": f"""
WITH {MEMBERS_SQL}, parts AS (
  SELECT *, CAST((member_pos - 1) // 2 + 1 AS BIGINT) AS part FROM members)
SELECT group_idx, part, count(*) AS n_paths,
       string_agg(path, '|' ORDER BY member_pos) AS paths
FROM parts GROUP BY group_idx, part""",
    "dup_rows_part": """
SELECT p_name, count(*) AS n_copies FROM part GROUP BY p_name HAVING count(*) > 1""",
    "dup_rows_lineitem": """
SELECT l_partkey, l_suppkey, count(*) AS n_copies FROM lineitem
GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""",
    "dup_row_members_lineitem": """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_copies FROM lineitem)
WHERE n_copies > 1""",
    "dup_row_members_orders": """
SELECT * FROM (
  SELECT o_orderkey, o_orderstatus, o_orderpriority,
         count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n_copies FROM orders)
WHERE n_copies > 1""",
    "size_candidates": f"""
WITH {FILES_SQL} SELECT path, size FROM files
WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)""",
    "cache_lookup": f"""
WITH {STORE_SQL}, {_LOOKUP} SELECT path, hash, hash IS NOT NULL AS hit FROM looked""",
    "is_fresh": f"""
WITH {STORE_SQL}
SELECT f.path, f.size = s.size AND abs(f.mtime - s.mtime) < 1e-4 AS fresh
FROM files f JOIN store s ON f.path = s.filepath""",
    "cache_stats": f"""
WITH {STORE_SQL}, {_LOOKUP}
SELECT count(hash) AS hits, count(*) AS total,
       CAST(count(hash) AS DOUBLE) / count(*) * 100 AS hit_rate FROM looked""",
    "cache_isolation": f"""
WITH {STORE_SQL}, names AS (
  SELECT unnest(['sha256', 'md5', 'xxh3']) AS algorithm), both_stores AS (
  SELECT * FROM store
  UNION ALL SELECT s.filepath, s.size, s.mtime, md5(f.content), 'md5'
  FROM store s JOIN files f ON s.filepath = f.path WHERE s.size < 1000), looked AS (
  SELECT n.algorithm, f.path,
         CASE WHEN f.size = s.size AND abs(f.mtime - s.mtime) < 1e-4 THEN s.hash END AS hash
  FROM files f CROSS JOIN names n
  LEFT JOIN both_stores s ON f.path = s.filepath AND s.algorithm = n.algorithm)
SELECT algorithm, path, hash, hash IS NOT NULL AS hit FROM looked""",
    "cache_upsert": """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC, event_id DESC) AS place FROM events)
WHERE place = 1""",
    "cache_prune": f"""
WITH {STORE_SQL}
SELECT filepath, hash FROM store
WHERE NOT {_beneath('filepath', PRUNE_ROOTS)} OR filepath IN (
  SELECT path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))""",
    "cache_stale": f"""
WITH {STORE_SQL}
SELECT filepath, size FROM store
WHERE {_beneath('filepath', PRUNE_ROOTS)} AND filepath NOT IN (
  SELECT path FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))""",
    "incremental_scan": f"""
WITH {FILES_SQL}
SELECT path, sha256(content) AS hash,
       doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AS hit FROM files""",
    "scan_summary": f"""
WITH {MEMBERS_SQL}
SELECT (SELECT count(*) FROM files) AS total_files,
       (SELECT count(DISTINCT hash) FROM members) AS duplicate_groups""",
    "group_size": f"""
WITH {MEMBERS_SQL} SELECT group_idx, hash, size FROM members WHERE member_pos = 1""",
    "format_size_scan": "SELECT size, " + _ladder(
        ["B", "KB", "MB", "GB", "TB", "PB"], "size || ' B'", _PRINTED
    ) + f" AS text FROM {_SIZES}",
    "format_size_handler": "SELECT size, " + _ladder(
        ["B", "KB", "MB", "GB", "TB"], "size || '.00 B'", _PRINTED
    ) + f" AS text FROM {_SIZES}",
    "format_size_web": "SELECT size, " + _ladder(
        ["B", "KB", "MB", "GB", "TB"], "size || ' B'", _TRIMMED
    ) + f" AS text FROM {_SIZES}",
    "format_mtime": """
SELECT l_orderkey, l_linenumber,
       strftime(make_timestamp(CAST((1704067200 + l_orderkey * 61 + l_linenumber) * 1000000
                                    AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS text
FROM lineitem""",
    "algorithm_label": """
SELECT CASE event_type WHEN 'view' THEN 'XXH3-128' WHEN 'click' THEN 'BLAKE3'
       ELSE upper(event_type) END AS label, count(*) AS n
FROM events GROUP BY 1""",
    "rates": f"""
WITH {STORE_SQL}, {_LOOKUP}
SELECT root, CAST(count(hash) AS DOUBLE) / count(*) * 100 AS hit_rate FROM looked GROUP BY root""",
    "incremental_store": f"""
WITH {FILES_SQL},
kept AS (
  SELECT * FROM files WHERE NOT (
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    AND (path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src7/en/%' OR path LIKE '/corpus/src4/%')))
SELECT path AS filepath, size, mtime, sha256(content) AS hash, 'sha256' AS algorithm FROM kept
UNION ALL
SELECT path, size, mtime, md5(content), 'md5' FROM kept
WHERE path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src10/en/%' OR path LIKE '/corpus/src7/%'
   OR path LIKE '/corpus/src12/de/%'""",
    "store_reset": f"""
WITH {FILES_SQL}
SELECT 'scanned' AS state, path AS filepath, sha256(content) AS hash FROM files
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "store_two_runs": f"""
WITH {FILES_SQL},
found AS (SELECT *, root IN ('/corpus/src1', '/corpus/src3', '/corpus/src7') AS scanned FROM files)
SELECT path AS filepath, size, mtime,
       CASE WHEN scanned THEN sha256(content) ELSE sha256('') END AS hash, 'sha256' AS algorithm
FROM found
WHERE scanned OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "list_join": f"""
WITH {FILES_SQL}
SELECT path, '/, /corpus, ' || root || ', ' || root || '/' || lang || ', ' || path AS folders
FROM files""",
    "report_json_roundtrip": f"""
WITH {MEMBERS_SQL} SELECT group_idx, hash, n_members, member_pos, path FROM members""",
    "report_json_rows_roundtrip": f"""
WITH {MEMBERS_SQL} SELECT group_idx, hash, n_members, member_pos, path FROM members""",
    "report_json_summary": f"""
WITH {MEMBERS_SQL}
SELECT '{SCAN_TIME}' AS scan_time, CAST({round(ELAPSED, 2)} AS DOUBLE) AS elapsed_seconds,
       (SELECT count(*) FROM files) AS total_files,
       (SELECT count(DISTINCT hash) FROM members) AS duplicate_groups,
       '/corpus, /web' AS scan_folders, 'sha256' AS algorithm""",
    "report_csv_roundtrip": f"WITH {MEMBERS_SQL} SELECT group_idx, hash, path FROM members",
    "report_txt_lines": f"""
WITH {MEMBERS_SQL}, lines AS (
  SELECT 0 AS section, 0 AS group_idx, 0 AS line_no, '{_FIRST_LINE}' AS line
  UNION ALL SELECT 0, 0, 1, '{SCAN_FOLDERS}/corpus, /web'
  UNION ALL SELECT 0, 0, 2, '{_FOUND_HEAD}' || count(DISTINCT hash) || '{_FOUND_TAIL}' FROM members
  UNION ALL SELECT 0, 0, 3, '{RULE}'
  UNION ALL SELECT 1, group_idx, -1, '' FROM members WHERE member_pos = 1
  UNION ALL SELECT 1, group_idx, 0, 'SHA256: ' || hash FROM members WHERE member_pos = 1
  UNION ALL SELECT 1, group_idx, member_pos, '  - ' || path FROM members
  UNION ALL SELECT 2, 0, 0, '{RULE}'
  UNION ALL SELECT 2, 0, 1, '{_TEXT_TAIL}')
SELECT CAST(section AS INTEGER) AS section, CAST(group_idx AS BIGINT) AS group_idx,
       CAST(line_no AS BIGINT) AS line_no, line FROM lines""",
    "report_json_lines": f"""
WITH {MEMBERS_SQL}, totals AS (
  SELECT (SELECT count(*) FROM files) AS n_files, (SELECT max(group_idx) FROM members) AS n_groups),
lines AS (
  SELECT 0 AS section, 0 AS group_idx, generate_subscripts(head, 1) - 1 AS line_no,
         unnest(head) AS line
  FROM (SELECT ['{{', '  "summary": {{', '    "scan_time": "{SCAN_TIME}",',
                '    "elapsed_seconds": {round(ELAPSED, 2)},',
                '    "total_files": ' || n_files || ',',
                '    "duplicate_groups": ' || n_groups || ',',
                '    "scan_folders": [', '      "/corpus",', '      "/web"', '    ],',
                '    "algorithm": "sha256"', '  }},', '  "duplicates": {{'] AS head FROM totals)
  UNION ALL SELECT 1, group_idx, 0, '    "' || hash || '": [' FROM members WHERE member_pos = 1
  UNION ALL SELECT 1, group_idx, member_pos,
    '      "' || path || '"' || CASE WHEN member_pos < n_members THEN ',' ELSE '' END FROM members
  UNION ALL SELECT 1, group_idx, member_pos + 1,
    CASE WHEN group_idx < n_groups THEN '    ],' ELSE '    ]' END
  FROM members, totals WHERE member_pos = n_members
  UNION ALL SELECT 2, 0, 0, '  }}'
  UNION ALL SELECT 2, 0, 1, '}}')
SELECT CAST(section AS INTEGER) AS section, CAST(group_idx AS BIGINT) AS group_idx,
       CAST(line_no AS BIGINT) AS line_no, line FROM lines""",
    "report_order": f"""
WITH {MEMBERS_SQL} SELECT group_idx, member_pos, path FROM members ORDER BY group_idx, member_pos""",
    "enrich": f"""
WITH {ENRICHED_SQL}
SELECT group_idx, hash, member_pos, path, "exists", size, mtime FROM enriched""",
    "existing_members": f"""
WITH {ENRICHED_SQL} SELECT group_idx, member_pos, path FROM enriched WHERE "exists" """,
    "default_keep": _rule("member_pos"),
    "choose_keep": _rule(
        "mtime DESC", "SELECT hash, path AS keep, n_existing FROM chosen WHERE place = 1"
    ),
    "keep_oldest": _rule("mtime"),
    "keep_newest": _rule("mtime DESC"),
    "keep_shortest": _rule("length(path)"),
    "keep_longest": _rule("length(path) DESC"),
    "rule_over_prior": _rule(
        "length(path) DESC",
        f"""SELECT hash, path, decision FROM chosen UNION ALL
SELECT * FROM ({_PRIOR}) WHERE hash NOT IN (SELECT hash FROM chosen)""",
    ),
    "manual_edits": f"""
WITH RECURSIVE {ENRICHED_SQL}{_KEPT.format(key='mtime')}{_EDITS}
SELECT c.hash, c.path, CASE WHEN c.path = f.kept THEN 'keep' ELSE 'trash' END AS decision
FROM chosen c JOIN final f ON c.hash = f.hash""",
    "index_choices": f"""
WITH {_CHOICES}
SELECT n.hash, n.path, CASE WHEN n.path = a.keep THEN 'keep' ELSE 'trash' END AS decision
FROM numbered n JOIN answered a ON n.hash = a.hash WHERE a.keep IS NOT NULL""",
    "rejected_choices": f"WITH {_CHOICES} SELECT hash, choice FROM answered WHERE keep IS NULL",
    "decision_sets": _rule(
        "mtime DESC",
        """SELECT decision, path FROM chosen UNION
SELECT CASE WHEN row_number() OVER (PARTITION BY e.hash ORDER BY member_pos) = 1
            THEN 'keep' ELSE 'trash' END, e.path FROM eligible e WHERE n_existing > 1""",
    ),
    "action_payloads": f"""
WITH {MEMBERS_SQL}
SELECT hash, path, CASE WHEN member_pos = 1 THEN 'keep' ELSE 'trash' END AS decision
FROM members""",
    "check_overlap": f"WITH {_UNSAFE} SELECT path FROM overlapped",
    "check_all_trashed": f"WITH {_UNSAFE} SELECT group_idx, hash FROM flags WHERE all_trashed",
    "check_none_exists": f"WITH {_UNSAFE} SELECT group_idx, hash FROM flags WHERE none_exists",
    "group_flags": f"WITH {_UNSAFE} SELECT group_idx, hash, all_trashed, none_exists FROM flags",
    "untrashed_members": f"WITH {_UNSAFE} SELECT group_idx, hash, path FROM marked WHERE NOT trashed",
    "violations": f"""
WITH {_UNSAFE}
SELECT CAST(1 AS INTEGER) AS severity, CAST(NULL AS BIGINT) AS group_idx,
       'overlap' AS check_name, CAST(NULL AS VARCHAR) AS hash, path FROM overlapped
UNION ALL
SELECT 2, group_idx, CASE WHEN all_trashed THEN 'all_trashed' ELSE 'none_exists' END, hash, NULL
FROM flags WHERE all_trashed OR none_exists
UNION ALL
SELECT DISTINCT 3, CAST(NULL AS BIGINT), 'not_in_report', CAST(NULL AS VARCHAR), path
FROM selection WHERE decision = 'trash' AND path NOT IN (SELECT path FROM enriched)""",
    "first_violation": f"""
WITH {_UNSAFE}
SELECT 'overlap' AS check_name, row_number() OVER (ORDER BY path) AS position, path,
       '{OVERLAP_MESSAGE}' || path AS message
FROM overlapped
UNION ALL
SELECT CASE WHEN all_trashed THEN 'all_trashed' ELSE 'none_exists' END, 1, NULL,
       CASE WHEN all_trashed THEN '{_TRASHED_HEAD}' || hash || '{_TRASHED_TAIL}'
            ELSE '{_NONE_HEAD}' || hash || '{_NONE_TAIL}' END
FROM (SELECT * FROM flags WHERE (all_trashed OR none_exists)
      AND NOT EXISTS (SELECT * FROM overlapped) ORDER BY group_idx LIMIT 1)""",
    "first_group_violation": f"""
WITH {_UNSAFE}
SELECT CASE WHEN all_trashed THEN 'all_trashed' ELSE 'none_exists' END AS check_name, hash,
       CAST(1 AS BIGINT) AS position,
       CASE WHEN all_trashed THEN '{_TRASHED_HEAD}' || hash || '{_TRASHED_TAIL}'
            ELSE '{_NONE_HEAD}' || hash || '{_NONE_TAIL}' END AS message
FROM (SELECT * FROM flags WHERE all_trashed OR none_exists ORDER BY group_idx LIMIT 1)""",
    "reclaim_plan": _rule(
        "mtime DESC",
        "SELECT path, TRUE AS \"exists\", size FROM chosen WHERE decision = 'trash' ORDER BY path",
    ),
    "reclaim_plan_marked": f"""
WITH {ENRICHED_SQL}
SELECT path, "exists", size FROM enriched WHERE member_pos > 1 ORDER BY path""",
    "reclaim_totals": _rule(
        "mtime DESC",
        """SELECT count(*) AS n_marked, count(*) AS n_existing,
       CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM chosen WHERE decision = 'trash'""",
    ),
    "reclaim_totals_marked": f"""
WITH {ENRICHED_SQL}
SELECT count(*) AS n_marked, count(*) FILTER (WHERE "exists") AS n_existing,
       CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM enriched WHERE member_pos > 1""",
    "reclaim_text": _rule("mtime DESC", "SELECT path, " + _ladder(
        ["B", "KB", "MB", "GB", "TB"], "size || '.00 B'", _PRINTED
    ) + """ AS size_text,
       strftime(make_timestamp(CAST(mtime * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS mtime_text
FROM chosen WHERE decision = 'trash'"""),
    "survivors": f"""
WITH {FILES_SQL}, best AS (
  SELECT path, size, row_number() OVER (
           PARTITION BY content ORDER BY length(path), root_ord, path) AS place FROM files)
SELECT path, size FROM best WHERE place = 1""",
}
ORACLES["survivors_prefiltered"] = ORACLES["survivors"]
ORACLES |= {
    "tree_manifest": ORACLES["manifest"],
    "tree_scan": ORACLES["dup_members"],
    "tree_scan_excludes": ORACLES["dup_members_scoped"],
    "tree_links": f"WITH {FILES_SQL} SELECT path, size FROM files",
    "object_scan": f"""
WITH {_OBJECTS + MEMBERS_SQL[len(FILES_SQL):]}
SELECT group_idx, hash, n_members, member_pos, path, size FROM members""",
    "object_manifest": f"""
WITH {_OBJECTS}
SELECT path, {_first_root(OVERLAPPING, lambda i, base: f"'{base}'")} AS root,
       CAST({_first_root(OVERLAPPING, lambda i, base: str(i))} AS INTEGER) AS root_ord, size
FROM files WHERE {_beneath('path', OVERLAPPING)} AND NOT {_beneath('path', EXCLUDES)}""",
    "tree_incremental": f"""
WITH {FILES_SQL}
SELECT path, sha256(content) AS hash, NOT {_beneath('path', EXCLUDES)} AS hit FROM files""",
    "quarantine_outcome": f"""
WITH {MEMBERS_SQL} SELECT path, 'moved' AS status, size AS bytes FROM members WHERE member_pos > 1""",
    "quarantine_totals": f"""
WITH {MEMBERS_SQL}
SELECT count(*) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS reclaimed_bytes
FROM members WHERE member_pos > 1""",
    "refused_plan": f"""
WITH {MEMBERS_SQL}
SELECT '{_TRASHED_HEAD}' || hash || '{_TRASHED_TAIL}' AS message
FROM members WHERE group_idx = 1 AND member_pos = 1""",
}
ORACLES |= {
    "report_document_roundtrip": ORACLES["report_json_roundtrip"],
    "report_rewrite_roundtrip": f"""
SELECT 'file' AS form, group_idx, hash, member_pos, path FROM ({ORACLES["dup_members"]})
UNION ALL SELECT 'folder', group_idx, hash, member_pos, path FROM ({ORACLES["dup_members_scoped"]})""",
    "report_txt_roundtrip": f"""
SELECT row_number() OVER (ORDER BY section, group_idx, line_no) AS line_no, line
FROM ({ORACLES["report_txt_lines"]})""",
    "action_payload_repeats": f"""
WITH {MEMBERS_SQL}
SELECT hash, path, CASE WHEN member_pos = 1 THEN 'trash' ELSE 'keep' END AS decision
FROM members WHERE member_pos = 1 OR member_pos = n_members""",
}
ORACLES |= {
    "index_choices_hot": ORACLES["index_choices"],
    "dup_members_hot": ORACLES["dup_members"],
    "dup_row_members_hot": ORACLES["dup_row_members_lineitem"],
    "keep_newest_hot": ORACLES["keep_newest"],
}
