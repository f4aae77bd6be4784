"""DuckDB SQL for the registered queries, written from the rules' RE2 patterns."""

from __future__ import annotations

from collections.abc import Sequence

from credsift.functions.errors import NOT_FOUND_MARKERS
from credsift.functions.filters import (
    FALSE_POSITIVE_PATTERN,
    LINE_FILTER_PATTERNS,
    PLACEHOLDER_PATTERN,
    SKIPPED_EXTENSIONS,
    SKIPPED_NAMES,
)
from credsift.functions.urls import URL_ERRORS
from credsift.rules import DEFAULT_RULES, INLINE_TOKEN_RULE, Rule
from workloads import derive


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items: Sequence[str]) -> str:
    return ", ".join(q(item) for item in items)


def mask(v: str) -> str:
    return (
        f"CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) "
        f"ELSE left({v}, 4) || repeat('*', least(length({v}) - 8, 20)) || right({v}, 4) END"
    )


def truncated(v: str, n: int = 120) -> str:
    return f"CASE WHEN length({v}) > {n} THEN left({v}, {n}) || '...' ELSE {v} END"


PLACEHOLDER = f"regexp_matches(raw, {q(PLACEHOLDER_PATTERN)})"
DOCUMENTS = derive.for_oracle(derive.PLANTED_DOCUMENTS)
PAGES = derive.for_oracle(derive.PLANTED_PAGES)
TURNS = derive.for_oracle(derive.PLANTED_TURNS)
FILES = derive.for_oracle(derive.FILES)

ENTRIES = {
    "documents": f"SELECT source AS repo, doc_id AS entry_seq, path, text FROM ({DOCUMENTS}) AS d",
    "pages": f"SELECT '' AS repo, page_id AS entry_seq, url AS path, html AS text FROM ({PAGES}) AS p",
    "turns": (
        "SELECT '' AS repo, conv_id * 1048576 + turn AS entry_seq, "
        f"concat(cast(conv_id AS varchar), '/', cast(turn AS varchar)) AS path, text FROM ({TURNS}) AS t"
    ),
    "repeated": f"SELECT source AS repo, doc_id AS entry_seq, path, text FROM ({derive.for_oracle(derive.REPEATED_DOCUMENTS)}) AS d",
    "large_files": (
        "SELECT '' AS repo, row_number() OVER (ORDER BY folder) AS entry_seq, folder AS path, text FROM ("
        "SELECT concat(source, '-', cast(doc_id % 8 AS varchar)) AS folder, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text "
        f"FROM ({DOCUMENTS}) AS d GROUP BY 1) AS f"
    ),
    "plain_documents": "SELECT '' AS repo, doc_id AS entry_seq, cast(doc_id AS varchar) AS path, text FROM documents",
}

SKIPPED_PATH = (
    f"(regexp_extract(path, '([^/]*)$', 1) IN ({values(SKIPPED_NAMES)}) "
    f"OR lower(regexp_extract(path, '([.][^./]*)$', 1)) IN ({values(SKIPPED_EXTENSIONS)}))"
)


def scan(
    entries: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    line_filter: str = "as_documented",
    per_entry: int | None = None,
    total: int | None = None,
    line_bytes: int | None = None,
    file_bytes: int | None = None,
) -> str:
    """CTEs: entries, lines, matched, raws, hits, firsts, capped, kept."""
    per_rule = ", ".join(
        f"{{'rule_ord': {i}, 'rule_id': {q(r.rule_id)}, 'severity': {q(r.severity)}, "
        f"'raws': regexp_extract_all(line, {q(r.pattern)}, {r.group})}}"
        for i, r in enumerate(rules)
    )
    small = f" AND strlen(text) <= {file_bytes}" if file_bytes else ""
    short = f" WHERE strlen(line) <= {line_bytes}" if line_bytes else ""
    entry_cap = f"WHERE in_entry <= {per_entry}" if per_entry else ""
    total_cap = f"WHERE before <= {total}" if total else ""
    return f"""
WITH entries AS MATERIALIZED ({entries}),
files AS (SELECT * FROM entries WHERE NOT {SKIPPED_PATH}{small}),
lines AS MATERIALIZED (
  SELECT repo, entry_seq, path, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_idx
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM files)),
matched AS (SELECT *, [{per_rule}] AS m FROM lines{short}),
found AS (SELECT * EXCLUDE (m), unnest(list_filter(m, lambda x: len(x.raws) > 0)) AS r FROM matched),
raws AS MATERIALIZED (
  SELECT * FROM (
    SELECT repo, entry_seq, path, line, line_idx, r.rule_ord AS rule_ord, r.rule_id AS rule_id, r.severity AS severity,
           unnest(r.raws) AS raw, generate_subscripts(r.raws, 1) - 1 AS match_ord FROM found)
  WHERE length(raw) > 0),
secrets AS (SELECT * FROM raws WHERE NOT {PLACEHOLDER}),
hits AS (
  SELECT *, {mask('raw')} AS masked FROM secrets
  WHERE NOT regexp_matches(line, {q(LINE_FILTER_PATTERNS[line_filter])})),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, path, rule_id, masked ORDER BY entry_seq, line_idx, rule_ord, match_ord) AS nth FROM hits)
  WHERE nth = 1),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY repo, entry_seq ORDER BY line_idx, rule_ord, match_ord) AS in_entry FROM firsts) {entry_cap}),
kept AS MATERIALIZED (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY repo ORDER BY entry_seq) AS before FROM capped) {total_cap})
"""


def redacted(line_bytes: int | None = None) -> str:
    """CTEs shown (lines with their secrets masked, place by place) and contexts."""
    short = f" WHERE strlen(l.line) <= {line_bytes}" if line_bytes else ""
    return f""",
parts AS (
  SELECT DISTINCT repo, entry_seq, line_idx, line, raw, string_split(line, raw) AS p FROM secrets),
spans AS (
  SELECT repo, entry_seq, line_idx, line, raw, unnest(range(1, len(p))) AS i, p FROM parts),
places AS (
  SELECT DISTINCT repo, entry_seq, line_idx, line, s, s + n AS e FROM (
    SELECT repo, entry_seq, line_idx, line, length(raw) AS n,
           cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(raw) AS bigint) AS s FROM spans)),
islands AS (
  SELECT repo, entry_seq, line_idx, line, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY repo, entry_seq, line_idx ORDER BY s, e) AS island FROM (
      SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY repo, entry_seq, line_idx ORDER BY s, e
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM places))
  GROUP BY repo, entry_seq, line_idx, line, island),
masked_spans AS (
  SELECT *, substr(line, s + 1, e - s) AS raw,
         coalesce(lag(e) OVER (PARTITION BY repo, entry_seq, line_idx ORDER BY s), 0) AS before FROM islands),
redacted AS (
  SELECT repo, entry_seq, line_idx,
         string_agg(concat(substr(line, before + 1, s - before), {mask('raw')}), '' ORDER BY s) || substr(any_value(line), max(e) + 1) AS line
  FROM masked_spans GROUP BY repo, entry_seq, line_idx),
shown AS (
  SELECT l.repo, l.entry_seq, l.line_idx, coalesce(r.line, l.line) AS line
  FROM lines AS l LEFT JOIN redacted AS r USING (repo, entry_seq, line_idx){short}),
contexts AS (
  SELECT k.repo, k.entry_seq, k.line_idx, string_agg(s.line, chr(10) ORDER BY s.line_idx) AS context
  FROM (SELECT DISTINCT repo, entry_seq, line_idx FROM kept) AS k
  JOIN shown AS s ON s.repo = k.repo AND s.entry_seq = k.entry_seq AND abs(s.line_idx - k.line_idx) <= 1
  GROUP BY ALL)
"""


FINDINGS = """
SELECT k.repo, k.rule_id AS type, k.severity, k.path AS file, cast(k.line_idx + 1 AS int) AS line,
       k.masked AS matched_value, c.context
FROM kept AS k LEFT JOIN contexts AS c USING (repo, entry_seq, line_idx)
"""


def findings(entries: str, **options) -> str:
    return scan(entries, **options) + redacted(options.get("line_bytes")) + FINDINGS


# -- repository URLs ----------------------------------------------------------

def _url_case() -> str:
    e = {name: q(text) for name, text in URL_ERRORS.items()}
    bad_escape = "replace(regexp_replace({0}, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%', chr(1))"
    return f"""
WITH given AS (SELECT request_id, regexp_replace(repo_url, '^\\s+|\\s+$', '', 'g') AS url
               FROM ({derive.for_oracle(derive.REQUESTS)}) WHERE repo_url IS NOT NULL AND repo_url <> ''),
cut AS (SELECT *, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) ELSE '' END AS fragment,
               CASE WHEN contains(url, '#') THEN substr(url, 1, strpos(url, '#') - 1) ELSE url END AS bare FROM given),
s AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
             regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest0 FROM cut),
r AS (SELECT *, CASE WHEN contains(rest0, '?') THEN substr(rest0, strpos(rest0, '?') + 1) ELSE '' END AS query,
             CASE WHEN contains(rest0, '?') THEN substr(rest0, 1, strpos(rest0, '?') - 1) ELSE rest0 END AS rest FROM s),
a AS (SELECT *, CASE WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//([^/]*)', 1) ELSE '' END AS authority,
             CASE WHEN starts_with(rest, '//') THEN regexp_replace(rest, '^//[^/]*', '')
                  WHEN starts_with(rest, '/') OR scheme = '' THEN rest ELSE '' END AS path FROM r),
h AS (SELECT *, regexp_extract(authority, '([^@]*)$', 1) AS host,
             CASE WHEN contains(authority, '@') THEN regexp_replace(authority, '@[^@]*$', '') END AS userinfo,
             'https://github.com' || url_decode(replace(path, '+', '%2B')) AS clean0 FROM a),
e AS (SELECT *, CASE
    WHEN strlen(url) > 256 THEN {e['length']}
    WHEN strlen(url) <> length(url) OR contains(url, chr(0)) THEN {e['characters']}
    WHEN regexp_matches(url, '[\\x01-\\x1F\\x7F]') OR starts_with(bare, ':')
      OR (scheme = '' AND contains(split_part(rest, '/', 1), ':'))
      OR contains({bad_escape.format('path')}, chr(1)) OR contains({bad_escape.format('fragment')}, chr(1))
      OR (starts_with(host, '[') AND NOT regexp_matches(host, '\\](:[0-9]*)?$'))
      OR (NOT starts_with(host, '[') AND contains(host, ':') AND NOT regexp_matches(host, ':[0-9]*$'))
      OR regexp_matches(host, '[ \\\\^`{{|}}]') OR regexp_matches(host, '%([0-7]|$|.[^0-9A-Fa-f])')
      OR coalesce(regexp_matches(userinfo, '[^A-Za-z0-9\\-._:~!$&''()*+,;=%@]'), false) THEN {e['syntax']}
    WHEN scheme <> 'https' THEN {e['scheme']}
    WHEN host <> 'github.com' THEN {e['host']}
    WHEN userinfo IS NOT NULL THEN {e['userinfo']}
    WHEN query <> '' OR fragment <> '' THEN {e['query']}
    WHEN contains(clean0, '..') THEN {e['path']}
    WHEN NOT regexp_matches(clean0, '^https://github\\.com/[A-Za-z0-9_.\\-]+/[A-Za-z0-9_.\\-]+(\\.git)?/?$') THEN {e['shape']}
  END AS error FROM h)
"""


DISPLAY = "regexp_replace(regexp_replace({0}, '\\.git$', ''), '/$', '')"

# -- history ------------------------------------------------------------------

COMMITS = derive.for_oracle(derive.COMMITS)
TREE_FILES = derive.for_oracle(derive.TREE_FILES)
BLOBS = derive.for_oracle(derive.BLOBS)

# First parents alone reach every commit of a repository here.
WALK = f"""
WITH commits AS MATERIALIZED ({COMMITS}),
trees AS MATERIALIZED ({TREE_FILES}),
blobs AS MATERIALIZED ({BLOBS}),
reached AS (SELECT *, cast(commits_in_repo - seq AS int) AS depth FROM commits),
pairs AS (SELECT c.repo, c.hash AS commit, p.hash AS parent FROM reached AS c
          LEFT JOIN reached AS p ON p.repo = c.repo AND p.hash = c.parent),
sides AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.commit, o.commit) AS commit, coalesce(n.path, o.path) AS path,
         n.blob AS new_blob, o.blob AS old_blob
  FROM (SELECT p.repo, p.commit, t.path, t.blob FROM pairs AS p JOIN trees AS t ON t.repo = p.repo AND t.commit_hash = p.commit) AS n
  FULL OUTER JOIN
       (SELECT p.repo, p.commit, t.path, t.blob FROM pairs AS p JOIN trees AS t ON t.repo = p.repo AND t.commit_hash = p.parent) AS o
    ON n.repo = o.repo AND n.commit = o.commit AND n.path = o.path),
diff AS (
  SELECT repo, commit, path, old_blob, new_blob,
         CASE WHEN old_blob IS NULL THEN 'A' WHEN new_blob IS NULL THEN 'D' ELSE 'M' END AS status
  FROM sides WHERE old_blob IS DISTINCT FROM new_blob),
usable AS (SELECT * FROM blobs WHERE NOT ends_in_nul)
"""


# The same without blobs: parent and child trees side by side, one aggregation per path.
DIFF = f"""
WITH commits AS MATERIALIZED ({COMMITS}),
trees AS MATERIALIZED ({TREE_FILES}),
roles AS (
  SELECT t.repo, c.hash AS commit, t.path, t.blob AS new_blob, NULL AS old_blob
  FROM trees AS t JOIN commits AS c ON c.repo = t.repo AND c.hash = t.commit_hash
  UNION ALL
  SELECT t.repo, c.hash, t.path, NULL, t.blob FROM trees AS t JOIN commits AS c ON c.repo = t.repo AND c.parent = t.commit_hash),
sides AS (SELECT repo, commit, path, max(new_blob) AS new_blob, max(old_blob) AS old_blob FROM roles GROUP BY repo, commit, path),
diff AS (
  SELECT repo, commit, path, old_blob, new_blob,
         CASE WHEN old_blob IS NULL THEN 'A' WHEN new_blob IS NULL THEN 'D' ELSE 'M' END AS status
  FROM sides WHERE old_blob IS DISTINCT FROM new_blob)
"""


def _files(side: str) -> str:
    return f""",
ranks AS (SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY committer_when DESC, hash) AS rank FROM reached),
ordered AS (
  SELECT f.*, CASE WHEN from_history THEN r.rank ELSE 1073741824 END * 4294967296
              + row_number() OVER (PARTITION BY f.repo, from_history, f.commit ORDER BY path) AS entry_seq
  FROM (SELECT repo, commit, path, {side} AS blob, true AS from_history FROM diff
        WHERE {side} IS NOT NULL AND NOT {SKIPPED_PATH}
        UNION ALL
        SELECT t.repo, t.commit_hash, t.path, t.blob, false FROM trees AS t JOIN commits AS c
          ON c.repo = t.repo AND c.hash = t.commit_hash AND c.seq = c.commits_in_repo
        WHERE NOT {SKIPPED_PATH.replace('(path', '(t.path')}) AS f
  JOIN ranks AS r ON r.repo = f.repo AND r.hash = f.commit),
placed AS MATERIALIZED (
  SELECT * FROM (SELECT o.*, b.text, row_number() OVER (PARTITION BY o.repo ORDER BY entry_seq) AS nth
                 FROM ordered AS o JOIN usable AS b ON b.repo = o.repo AND b.blob = o.blob))
"""


TRIMMED_MESSAGE = "regexp_replace(message, '^\\s+|\\s+$', '', 'g')"


def reachable(limit: int) -> str:
    return f"""
WITH RECURSIVE commits AS MATERIALIZED ({COMMITS}),
ways AS (
  SELECT repo, hash, 0 AS depth FROM commits WHERE seq = commits_in_repo
  UNION
  SELECT w.repo, p.hash, w.depth + 1 FROM ways AS w
  JOIN (SELECT repo, hash AS child, parent AS hash FROM commits WHERE parent IS NOT NULL
        UNION SELECT repo, hash, merged FROM commits WHERE merged IS NOT NULL) AS p ON p.repo = w.repo AND p.child = w.hash
  WHERE w.depth + 1 < {limit})
SELECT repo, hash, cast(min(depth) AS int) AS depth FROM ways GROUP BY repo, hash
"""


# Ways of different lengths to one commit are all followed; the least one counts.
REACHABLE_LONG = f"""
WITH RECURSIVE commits AS MATERIALIZED ({derive.for_oracle(derive.LONG_COMMITS)}),
edges AS MATERIALIZED (SELECT repo, hash AS child, parent AS hash FROM commits WHERE parent IS NOT NULL
  UNION SELECT repo, hash, merged FROM commits WHERE merged IS NOT NULL),
ways AS (
  SELECT repo, hash, 0 AS depth FROM ({derive.for_oracle(derive.LONG_REFS)}) AS r
  UNION
  SELECT w.repo, e.hash, w.depth + 1 FROM ways AS w JOIN edges AS e ON e.repo = w.repo AND e.child = w.hash)
SELECT repo, hash, cast(min(depth) AS int) AS depth FROM ways GROUP BY repo, hash
"""


COMMIT_ORDER_REFS = f"""
WITH RECURSIVE commits AS MATERIALIZED ({derive.for_oracle(derive.LONG_COMMITS)}),
edges AS MATERIALIZED (SELECT repo, hash AS child, parent AS hash FROM commits WHERE parent IS NOT NULL
  UNION SELECT repo, hash, merged FROM commits WHERE merged IS NOT NULL),
reach AS (
  SELECT repo, hash, name FROM ({derive.for_oracle(derive.LONG_REFS)}) AS r
  UNION
  SELECT w.repo, e.hash, w.name FROM reach AS w JOIN edges AS e ON e.repo = w.repo AND e.child = w.hash)
SELECT repo, hash AS commit, row_number() OVER (PARTITION BY repo ORDER BY name, committer_when DESC, hash) AS rank
FROM (SELECT repo, hash, min(name) AS name FROM reach GROUP BY repo, hash) AS f JOIN commits USING (repo, hash)
"""


def _history_scan(side: str) -> str:
    ctes = scan("SELECT repo, entry_seq, path, text, commit, from_history FROM placed").strip()
    ctes = ctes.removeprefix("WITH ").replace("raws AS MATERIALIZED", "raws AS MATERIALIZED", 1)
    return WALK + _files(side) + ",\n" + ctes


def _history_findings(side: str) -> str:
    return _history_scan(side) + f"""
SELECT k.repo, k.rule_id AS type, k.severity, k.path AS file, cast(k.line_idx + 1 AS int) AS line, p.commit,
       {truncated(TRIMMED_MESSAGE)} AS commit_message, c.author_name AS commit_author, k.masked AS matched_value
FROM kept AS k JOIN placed AS p ON p.repo = k.repo AND p.entry_seq = k.entry_seq
JOIN commits AS c ON c.repo = p.repo AND c.hash = p.commit
"""


def _full_history_findings(side: str) -> str:
    descriptions = " ".join(f"WHEN {q(r.rule_id)} THEN {q(r.description)}" for r in DEFAULT_RULES)
    return _history_scan(side) + redacted() + f"""
SELECT k.repo, sha256(concat_ws(chr(1), k.repo, k.rule_id, k.masked, k.path, p.commit, cast(k.line_idx + 1 AS varchar))) AS id,
       k.rule_id AS type, k.severity, CASE k.rule_id {descriptions} END AS description, k.path AS file,
       cast(k.line_idx + 1 AS int) AS line, p.commit, {truncated(TRIMMED_MESSAGE)} AS commit_message, c.author_name AS commit_author,
       strftime(c.author_when, '%Y-%m-%d') AS commit_date, k.masked AS matched_value, x.context
FROM kept AS k JOIN placed AS p ON p.repo = k.repo AND p.entry_seq = k.entry_seq
JOIN commits AS c ON c.repo = p.repo AND c.hash = p.commit
LEFT JOIN contexts AS x ON x.repo = k.repo AND x.entry_seq = k.entry_seq AND x.line_idx = k.line_idx
"""


# Entry after entry of each path: of its values, in order, those not reported yet, as many as the cap allows.
def carry_over(cap: int) -> str:
    fresh = f"list_filter(e.keys, lambda k: NOT list_contains(w.reported, k))[1:{cap}]"
    return scan(ENTRIES["repeated"]).replace("WITH entries", "WITH RECURSIVE entries", 1) + f""",
once AS (SELECT repo, path, entry_seq, concat(rule_id, '|', masked) AS key, line_idx, rule_ord, match_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, path, entry_seq, rule_id, masked ORDER BY line_idx, rule_ord, match_ord) AS nth FROM hits)
  WHERE nth = 1),
e AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY entry_seq) AS i FROM (
    SELECT repo, path, entry_seq, list(key ORDER BY line_idx, rule_ord, match_ord) AS keys FROM once GROUP BY repo, path, entry_seq)),
w AS (
  SELECT repo, path, entry_seq, i, keys[1:{cap}] AS new, keys[1:{cap}] AS reported FROM e WHERE i = 1
  UNION ALL
  SELECT e.repo, e.path, e.entry_seq, e.i, {fresh}, list_concat(w.reported, {fresh})
  FROM w JOIN e ON e.repo = w.repo AND e.path = w.path AND e.i = w.i + 1)
SELECT repo, path, entry_seq, unnest(new) AS value FROM w
"""


HISTORY_STATS = f""",
per_repo AS (
  SELECT r.repo, r.commits AS total_commits_scanned, coalesce(f.files, 0) AS total_files_scanned,
         coalesce(k.found, 0) AS total_findings
  FROM (SELECT repo, count(DISTINCT hash) AS commits FROM reached GROUP BY repo) AS r
  LEFT JOIN (SELECT repo, count(DISTINCT path) AS files FROM placed GROUP BY repo) AS f USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS found FROM kept GROUP BY repo) AS k USING (repo))
"""

# -- anchored windows ---------------------------------------------------------

def anchored(window: int, limit: int) -> str:
    return f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (
  SELECT user_id, event_id, i, ts, ts AS window_start, cast(1 AS bigint) AS n FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.ts,
         CASE WHEN e.ts - w.window_start > INTERVAL {window} SECOND THEN e.ts ELSE w.window_start END,
         CASE WHEN e.ts - w.window_start > INTERVAL {window} SECOND THEN 1 ELSE w.n + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, window_start, n, n = 1 OR n <= {limit} AS allowed FROM w
"""


def oracle_sql() -> dict[str, str]:
    false_positive = "regexp_matches(line, {0})"
    plain_lines = """
SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
    page_lines = """
SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages)"""
    document_findings = findings(ENTRIES["documents"])
    out = {
        "mask_secret": f"SELECT doc_id, {mask('text')} AS text, {mask('lang')} AS lang, {mask('source')} AS source FROM documents",
        "truncate_text": f"SELECT doc_id, {truncated('text')} AS text FROM documents",
        "split_lines": f"SELECT doc_id, cast(line_no AS int) AS line_no, line FROM ({plain_lines})",
        "path_parts": f"SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS base_name, lower(regexp_extract(path, '([.][^./]*)$', 1)) AS file_ext FROM ({FILES})",
        "trim_all": f"SELECT hash, {TRIMMED_MESSAGE} AS message FROM ({COMMITS})",
        "line_length_limit": f"SELECT page_id, cast(line_no AS int) AS line_no, strlen(line) AS bytes FROM ({page_lines}) WHERE strlen(line) <= 4096",
        "is_placeholder": f"""
SELECT raw AS value, count(*) AS n, {PLACEHOLDER} AS placeholder
FROM (SELECT unnest(string_split(concat(text, ' ', CASE doc_id % 9 WHEN 0 THEN 'changeme' WHEN 1 THEN 'YOUR_API' WHEN 2 THEN 'your-token'
      WHEN 3 THEN '<secret>' WHEN 4 THEN '***' WHEN 5 THEN 'N/A' WHEN 6 THEN '0000' WHEN 7 THEN 'XXXX' ELSE 'Test' END), ' ')) AS raw FROM documents)
GROUP BY raw""",
        "skip_by_name": f"SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) IN ({values(SKIPPED_NAMES)}) AS skipped FROM ({FILES})",
        "skip_by_extension": f"SELECT doc_id, path, lower(regexp_extract(path, '([.][^./]*)$', 1)) IN ({values(SKIPPED_EXTENSIONS)}) AS skipped FROM ({FILES})",
        "size_limit": f"SELECT doc_id FROM ({FILES}) WHERE strlen(text) + ends_in_nul::int <= 1048576",
        "is_binary": f"SELECT doc_id, ends_in_nul AND strlen(text) < 512 AS is_binary FROM ({FILES})",
        "scannable_files": f"SELECT doc_id, path FROM ({FILES}) WHERE NOT {SKIPPED_PATH} AND NOT ends_in_nul",
        "scannable_files_limited": f"SELECT doc_id, path FROM ({FILES}) WHERE NOT {SKIPPED_PATH} AND strlen(text) + ends_in_nul::int <= 1048576 AND NOT (ends_in_nul AND strlen(text) < 512)",
        "corpus_size": "SELECT source AS root, cast(sum(strlen(text)) AS bigint) AS bytes, sum(strlen(text)) > 50000 AS over_limit FROM documents GROUP BY source",
        "read_requests": f"SELECT request_id, regexp_replace(repo_url, '^\\s+|\\s+$', '', 'g') AS repo_url FROM ({derive.for_oracle(derive.REQUESTS)}) WHERE repo_url IS NOT NULL AND repo_url <> ''",
        "validate_repo_url": _url_case() + "SELECT request_id, CASE WHEN error IS NULL THEN clean0 END AS clean, error FROM e",
        "display_url": _url_case() + f"SELECT request_id, {DISPLAY.format('clean0')} AS repo_url FROM e WHERE error IS NULL",
        "classify_scan_error": f"""
SELECT request_id, CASE WHEN late THEN 408 WHEN missing THEN 404 ELSE 500 END AS status,
       CASE WHEN late THEN 'scan timeout' WHEN missing THEN 'repository not found or private' ELSE 'internal scan error' END AS error
FROM (SELECT request_id, deadline_exceeded OR contains(message, 'timeout') AS late,
             {' OR '.join(f"contains(lower(message), {q(m)})" for m in NOT_FOUND_MARKERS)} AS missing
      FROM ({derive.for_oracle(derive.OUTCOMES)}))""",
        "match_rules_all": scan(ENTRIES["documents"]) + "SELECT path, cast(line_idx AS int) AS line_idx, rule_id, cast(match_ord AS int) AS match_ord, raw FROM raws",
        "match_rules_join": scan(ENTRIES["documents"]) + "SELECT path, cast(line_idx AS int) AS line_idx, rule_id, cast(match_ord AS int) AS match_ord, raw FROM raws",
        "rule_hits": scan(ENTRIES["pages"]) + "SELECT rule_id, severity, count(*) AS hits, count(DISTINCT raw) AS distinct_values FROM raws GROUP BY ALL",
        "dedupe_findings": scan(ENTRIES["documents"]) + "SELECT repo, path, rule_id, masked, cast(line_idx AS int) AS line_idx FROM firsts",
        "cap_per_entry": scan(ENTRIES["documents"], per_entry=10) + "SELECT repo, path, rule_id, masked, cast(line_idx AS int) AS line_idx FROM capped",
        "dedupe_and_cap": scan(ENTRIES["documents"], per_entry=10) + "SELECT repo, path, rule_id, masked, cast(line_idx AS int) AS line_idx FROM capped",
        "dedupe_repeats": scan(ENTRIES["repeated"]) + "SELECT repo, path, rule_id, masked, cast(line_idx AS int) AS line_idx, entry_seq FROM firsts",
        "dedupe_and_cap_carry_over": carry_over(3),
        "non_empty_matches": f"""
SELECT doc_id, raw, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(line, '[0-9]*')) AS raw FROM ({plain_lines}))
WHERE length(raw) > 0 GROUP BY ALL""",
        "write_new_findings_repeats": scan(ENTRIES["repeated"]) + "SELECT DISTINCT repo, rule_id AS type, path AS file, masked AS matched_value FROM hits",
        "scan_repo_history_full": _full_history_findings("new_blob"),
        "cap_total": scan(ENTRIES["turns"], per_entry=50, total=100) + "SELECT path, rule_id, masked FROM kept",
        "cap_entries": f"SELECT repo, entry_seq, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY entry_seq) AS nth FROM ({ENTRIES['documents']})) WHERE nth <= 7",
        "line_context_raw": """
SELECT doc_id, cast(i AS int) AS line_idx, array_to_string(l[greatest(i, 1):least(i + 2, len(l))], chr(10)) AS context
FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
        "redact_text": scan(ENTRIES["documents"]) + redacted() + """
SELECT entry_seq AS doc_id, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM shown GROUP BY entry_seq""",
        "triage_order": scan(ENTRIES["documents"]) + """
SELECT CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS rank,
       severity, rule_id AS type, path AS file, cast(line_idx + 1 AS int) AS line FROM kept ORDER BY rank""",
        "triage_summary": scan(ENTRIES["documents"]) + "SELECT severity, rule_id AS type, count(*) AS findings, count(DISTINCT path) AS files FROM kept GROUP BY ROLLUP (severity, rule_id)",
        "scan_stats": scan(ENTRIES["documents"], total=20) + """,
last AS (SELECT repo, max(entry_seq) AS last FROM kept GROUP BY repo HAVING count(*) >= 20)
SELECT f.repo, cast(0 AS bigint) AS total_commits_scanned, f.files AS total_files_scanned, coalesce(k.found, 0) AS total_findings
FROM (SELECT f.repo, count(DISTINCT path) AS files FROM files AS f LEFT JOIN last USING (repo)
      WHERE last IS NULL OR entry_seq <= last GROUP BY f.repo) AS f
LEFT JOIN (SELECT repo, count(*) AS found FROM kept GROUP BY repo) AS k USING (repo)""",
        "scan_documents": document_findings,
        "scan_documents_limited": findings(ENTRIES["documents"], per_entry=50, total=1000, line_bytes=4096, file_bytes=1 << 20),
        "scan_documents_in_parts": document_findings,
        "scan_files_in_ranges": findings(ENTRIES["large_files"]).replace(
            "SELECT k.repo, k.rule_id AS type, k.severity, k.path AS file,", "SELECT k.path AS folder, k.rule_id AS type, k.severity,"
        ),
        "scan_documents_as_coded": findings(ENTRIES["documents"], line_filter="as_coded"),
        "scan_pages": findings(ENTRIES["pages"]),
        "scan_conversations": findings(ENTRIES["turns"]),
        "user_rule_inline_token": findings(ENTRIES["plain_documents"], rules=(*DEFAULT_RULES, INLINE_TOKEN_RULE)),
        "first_parent": WALK + "SELECT repo, commit, parent FROM pairs",
        "latest_commits": f"SELECT repo, hash, cast(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY committer_when DESC, hash) AS rank FROM ({COMMITS})) WHERE rank <= 5",
        "reachable_commits": reachable(1 << 30),
        "reachable_commits_limited": reachable(5),
        "reachable_commits_long": REACHABLE_LONG,
        "commit_order_refs": COMMIT_ORDER_REFS,
        "history_entries": WALK + _files("new_blob") + """
SELECT p.repo, p.entry_seq, p.path, p.commit, strlen(text) AS bytes FROM placed AS p WHERE from_history""",
        "head_entries": WALK + _files("new_blob") + """
SELECT p.repo, p.path, p.commit, c.author_name AS commit_author, strlen(text) AS bytes
FROM placed AS p JOIN commits AS c ON c.repo = p.repo AND c.hash = p.commit WHERE NOT from_history""",
        "rejected_requests": f"SELECT request_id, 'request body must contain repo_url' AS error FROM ({derive.for_oracle(derive.REQUESTS)}) WHERE repo_url IS NULL OR repo_url = ''",
        "files_read_back": """
SELECT concat('source=', source) AS folder, line, count(*) AS n
FROM (SELECT source, unnest(string_split(string_agg(concat(text, chr(10), '--', chr(10)), ''), chr(10))) AS line FROM documents GROUP BY source)
GROUP BY ALL""",
        "tree_diff": DIFF + "SELECT repo, commit, path, status, old_blob, new_blob FROM diff",
        "tree_diff_introducing": DIFF + "SELECT repo, commit, path, new_blob AS blob FROM diff WHERE new_blob IS NOT NULL",
        "tree_diff_replacing": DIFF + "SELECT repo, commit, path, old_blob AS blob FROM diff WHERE old_blob IS NOT NULL",
        "history_union_head": WALK + _files("new_blob") + "SELECT repo, commit, path, blob, from_history, entry_seq FROM ordered",
        "repository_entries": WALK + _files("new_blob") + f"""
SELECT p.repo, p.entry_seq, p.path, p.commit, {TRIMMED_MESSAGE} AS commit_message, author_name AS commit_author, from_history,
       strlen(text) + (SELECT any_value(u.ends_in_nul::int) FROM usable AS u WHERE u.repo = p.repo AND u.blob = p.blob) AS bytes
FROM placed AS p JOIN commits AS c ON c.repo = p.repo AND c.hash = p.commit""",
        "scan_repo_history": _history_findings("new_blob"),
        "scan_repo_history_replacing": _history_findings("old_blob"),
        "scan_repo_stats": _history_scan("new_blob") + HISTORY_STATS + "SELECT * FROM per_repo",
        "scan_report": _history_scan("new_blob") + HISTORY_STATS + """
SELECT s.repo AS repo_url, total_commits_scanned, total_files_scanned, total_findings,
       coalesce(f.listed, '') AS listed
FROM per_repo AS s LEFT JOIN (
  SELECT repo, string_agg(concat(rule_id, '@', path, ':', cast(line_idx + 1 AS int)), ',' ORDER BY entry_seq, line_idx, rule_ord, match_ord) AS listed
  FROM kept GROUP BY repo) AS f USING (repo)""",
        "anchored_window_count": anchored(86_400, 2),
        "rate_limit_flags": f"SELECT user_id, event_id, allowed FROM ({anchored(3_600, 5)})",
    }
    for mode in LINE_FILTER_PATTERNS:
        out[f"false_positive_line_{mode.removeprefix('as_')}"] = (
            f"SELECT page_id, cast(line_no AS int) AS line_no, {false_positive.format(q(LINE_FILTER_PATTERNS[mode]))} AS false_positive "
            f"FROM ({page_lines.replace('FROM pages', f'FROM ({PAGES})')})"
        )
    assert FALSE_POSITIVE_PATTERN == LINE_FILTER_PATTERNS["as_coded"]
    out["scan_stream"] = findings(ENTRIES["documents"])
    out["write_new_findings"] = out["scan_stream"]
    out["write_findings"] = document_findings
    out["rate_limit_stream"] = anchored(86_400, 2)
    return out
