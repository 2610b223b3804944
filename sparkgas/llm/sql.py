"""SQL for queries of training-data operators whose method has another plain form."""

from sparkgas.llm.quality_rules import RULES, STOP_WORDS

# the checksum that crc32 gives, over the ASCII characters of a column s
CRC32 = """xor(list_reduce(range(0, 8 * length(s)), lambda acc, k:
        xor(xor(acc, (k % 8 = 0)::BIGINT * ascii(substr(s, k // 8 + 1, 1))) >> 1,
            3988292384 * (xor(acc, (k % 8 = 0)::BIGINT * ascii(substr(s, k // 8 + 1, 1))) & 1)), 4294967295), 4294967295)"""

_BOUNDS = [f"{r.measure} {op} {bound}" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))

# windows of three words come from neighbouring rows; a measure without a value passes its bounds
QUALITY_RULES = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), placed AS (
    SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), windows AS (
    SELECT rid, pos, word, word || ' ' || lead(word, 1) OVER own || ' ' || lead(word, 2) OVER own AS three
    FROM placed WINDOW own AS (PARTITION BY rid ORDER BY pos)
), found AS (
    SELECT rid, pos, count(*) OVER (PARTITION BY rid, three) AS times FROM windows WHERE three IS NOT NULL
), covered AS (
    SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY rid
), stops AS (
    SELECT rid, count(DISTINCT lower(word)) AS stop_words, count(*) AS stop FROM placed WHERE lower(word) IN ({_STOP}) GROUP BY rid
), counted AS (
    SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        length(array_to_string(lines, '')) AS line_chars, length(array_to_string(list_distinct(lines), '')) AS new_line_chars,
        coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(t.stop_words, 0) AS stop_words, coalesce(t.stop, 0) AS stop,
        len(regexp_extract_all(text, '\p{{L}}[^\x20\x09-\x0D]*')) AS letter_words,
        len(regexp_extract_all(text, '[!?][\x20\x09-\x0D]')) AS exclaimed,
        length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper_chars,
        len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\t]*[-*•]'))) AS bullets,
        len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\t]*[\r\x{{85}}\x{{2028}}\x{{2029}}]?$'))) AS ellipses
    FROM split s LEFT JOIN covered c USING (rid) LEFT JOIN stops t USING (rid)
), ratios AS (
    SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_word_ratio,
        n_repeat_words / nullif(n_words, 0) AS repeat_word_ratio, stop / nullif(n_words, 0) AS stop_word_ratio,
        n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, 1 - new_line_chars / nullif(line_chars, 0) AS dup_line_char_ratio,
        bullets / nullif(n_lines, 0) AS bullet_line_ratio, ellipses / nullif(n_lines, 0) AS ellipsis_line_ratio,
        letter_words / nullif(n_words, 0) AS letter_word_ratio, upper_chars / nullif(word_chars, 0) AS upper_char_ratio,
        exclaimed / nullif(n_words, 0) AS exclaimed_word_ratio
    FROM counted
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        {" AND ".join(f"coalesce({bound}, true)" for bound in _BOUNDS)} AS passed
    FROM ratios
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept
FROM judged
"""

PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), dealt AS (
    SELECT conv_id, own, {CRC32} % 9 AS h FROM (SELECT *, conv_id::VARCHAR AS s FROM turns)
), rebuilt AS (
    SELECT d.conv_id, coalesce(head.own, [])[1:d.h] || d.own[d.h + 1:] AS turns
    FROM dealt d LEFT JOIN turns head ON head.conv_id = d.conv_id - (d.conv_id % 5 + 5) % 5
), members AS (
    SELECT conv_id, turns[1:depth] AS path, depth, depth = len(turns) AS ends
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * coalesce(strlen(path[depth].text), 0) AS own_saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY path, depth
), children AS (
    SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)
), subtrees AS (
    SELECT path[1:above] AS path, sum(own_saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
    s.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""

FAR = 1_000_000_000_000  # dearer than any repair


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}'}}"


def _stay(initial: str) -> str:
    """The cost of a row that is kept as it is, where only one initial may be."""
    return f"CASE WHEN fault IN (1, 2) OR initial <> '{initial}' THEN {FAR} WHEN fault = 3 THEN 5 ELSE 0 END"


REROLED = f"CASE WHEN fault IN (1, 2) THEN {FAR} WHEN fault = 3 THEN 6 ELSE 1 END"
FIRST, NONE = "{'c': 0::BIGINT, 't': ''}", f"{{'c': {FAR}::BIGINT, 't': ''}}"
INSERTED = f"list_min([u, {', '.join(_edit(q, '5', 'I') for q in ('z', 's', 'a'))}]) AS u"
CLOSED = f"""SELECT * REPLACE (list_min([a, {_edit("u", "5", "I")}]) AS a) FROM (SELECT * REPLACE ({INSERTED}) FROM walk)"""

STRUCTURE_REPAIR = f"""
WITH RECURSIVE marked AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32} % 20 AS how
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations)
), damaged AS (
    SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(0, CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM marked)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
        regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS final, left(role, 1) AS initial
    FROM damaged
), judged AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair, CASE
        WHEN final = '' THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
        WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
    FROM placed
), convs AS (
    SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(j.pos) AS n
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id
    GROUP BY c.conv_id
), walk AS (
    SELECT conv_id, n, 0::BIGINT AS pos, {FIRST} AS z, {NONE} AS s, {NONE} AS u, {NONE} AS a FROM convs
    UNION ALL
    SELECT w.conv_id, w.n, j.pos, {_edit("z", "2", "D")},
        list_min([{_edit("s", "2", "D")}, {_edit("z", _stay("s"), "K")}]),
        list_min([{_edit("u", "2", "D")}, {", ".join(f"{_edit(q, _stay('u'), 'K')}, {_edit(q, REROLED, 'R')}" for q in "zsa")}]),
        list_min([{_edit("a", "2", "D")}, {_edit("u", _stay("a"), "K")}, {_edit("u", REROLED, "R")}])
    FROM ({CLOSED}) w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = w.pos + 1
), best AS (
    SELECT conv_id, list_min([z, a]) AS best FROM ({CLOSED}) WHERE pos = n
), letters AS (
    SELECT conv_id, k, substr(best.t, k, 1) AS letter,
        count(*) FILTER (substr(best.t, k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos,
        count(*) FILTER (substr(best.t, k, 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place
    FROM (SELECT *, unnest(range(1, length(best.t) + 1)) AS k FROM best)
), left_over AS (
    SELECT l.conv_id, l.place, l.letter, j.role, j.initial, CASE WHEN l.letter = 'I' THEN '' ELSE j.text END AS text,
        max(CASE WHEN l.place = 1 AND l.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS head
    FROM letters l JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND j.pos = greatest(l.pos, 1)
    WHERE l.letter <> 'D'
), repaired AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY place) AS lines
    FROM left_over GROUP BY conv_id
)
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, b.best.c AS cost, b.best.t AS audit,
    sha256(coalesce(r.lines, '')) AS repaired_sha256
FROM convs c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
