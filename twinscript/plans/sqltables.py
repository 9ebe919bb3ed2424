"""The derived tables of ``twinscript.tables`` as SQL, shared by the check queries."""

RESOURCES = r"""
numbered AS (
  SELECT doc_id, lang, source AS slot,
         CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nr
  FROM documents),
resources AS (
  SELECT doc_id, slot || '/u' || (doc_id % 5) || '/xml/' || lang || '/' || nr || '.xml' AS path,
         slot, 'u' || (doc_id % 5) AS branch, lang, nr || '.xml' AS basename,
         'part-' || nr || '_' || CASE doc_id % 3 WHEN 0 THEN lang
            WHEN 1 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'spa' END
            ELSE CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
                 ELSE 'Spanish' END END || '.xml' AS name,
         nr, size, 'g' || (doc_id % 3) AS gid, 'user' || (doc_id % 5) AS owner
  FROM numbered)"""

METADATA = RESOURCES + r""",
metadata AS (
  SELECT r.path, r.slot, r.branch, r.lang, r.size, r.gid, r.owner,
         r.slot || ',' || r.lang || ',' || CASE WHEN r.size >= 10 THEN 'long' ELSE 'short' END AS keywords,
         l.quality AS quality
  FROM resources r LEFT JOIN labels l ON r.doc_id = l.doc_id)"""

GROUPS = r"""
touched AS (
  SELECT 'g' || (user_id % 3) AS gid, 'user' || (user_id % 7) AS member FROM events
  WHERE event_type <> 'error'),
groups AS (
  SELECT gid, min(member) AS owner, list_sort(list(DISTINCT member)) AS members FROM touched GROUP BY gid)"""

PAIRS = RESOURCES + r""",
doc_pairs AS (
  SELECT a.path || '|' || b.path AS pair_id, a.slot, a.basename, a.path AS src_path, b.path AS trg_path,
         a.lang AS src_lang, b.lang AS trg_lang, a.size AS src_size, b.size AS trg_size,
         a.doc_id AS src_doc, b.doc_id AS trg_doc
  FROM resources a JOIN resources b ON a.slot = b.slot AND a.basename = b.basename AND a.lang < b.lang)"""

LINES = r"""
lines AS (
  SELECT doc_id, lang, u.pos AS sent_pos, u.line AS text FROM (
    SELECT doc_id, lang, unnest(list_transform(ls, lambda x, i: {'pos': i, 'line': x})) AS u FROM (
      SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls
      FROM documents)))"""

BITEXT = r"""
bitext AS (
  SELECT u.conv_id || '-' || u.turn AS pair_id, u.conv_id, u.turn, u.text AS src_text, a.text AS trg_text
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def with_tables(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
