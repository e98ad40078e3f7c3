"""What the queries return, in DuckDB SQL, where SQL can say it."""

from hindcast.llm import chosen_paths
from hindcast.llm.decontaminate import WIDTH, WORD
from hindcast.llm.prefix_trie import BLOCK, HEADS
from hindcast.llm.substrings import WIDTH as REPEAT

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = f"""
    WITH docs AS (
      SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS words FROM documents),
    items AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all({_LOWER}, '{WORD}') AS words FROM benchmark),
    sized AS (SELECT *, least(len(words), {WIDTH}) AS width FROM items WHERE len(words) > 0),
    windows AS (
      SELECT DISTINCT item, width, unnest([words[i:i + width - 1] FOR i IN range(1, len(words) - width + 2)]) AS w
      FROM sized),
    widths AS (SELECT DISTINCT width FROM windows),
    seen AS (
      SELECT row_id, width, unnest(range(1, len(words) - width + 2)) AS start,
             unnest([words[i:i + width - 1] FOR i IN range(1, len(words) - width + 2)]) AS w
      FROM docs, widths WHERE len(words) >= width),
    hits AS (SELECT row_id, start, seen.width, item FROM seen JOIN windows USING (w)),
    found AS (
      SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
      FROM hits GROUP BY row_id),
    covered AS (
      SELECT row_id, count(DISTINCT word) AS n_hit
      FROM (SELECT row_id, unnest(range(start, start + width)) AS word FROM hits) GROUP BY row_id)
    SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
           coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN found USING (row_id) LEFT JOIN covered USING (row_id)"""

_WORDS = r"[^\x20\x09-\x0D]+"

_SUBSTRINGS = f"""
    WITH docs AS (
      SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
    windows AS (
      SELECT row_id, unnest(range(1, len(words) - {REPEAT} + 2)) AS start,
             unnest([md5(array_to_string(words[i:i + {REPEAT} - 1], ' ')) FOR i IN range(1, len(words) - {REPEAT} + 2)]) AS w
      FROM docs WHERE len(words) >= {REPEAT}),
    repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
    gone AS (SELECT DISTINCT row_id, unnest(range(start, start + {REPEAT})) AS place FROM windows JOIN repeated USING (w)),
    places AS (SELECT row_id, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM docs),
    kept AS (
      SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
      FROM places ANTI JOIN gone USING (row_id, place) GROUP BY row_id)
    SELECT doc_id, len(words)::bigint AS n_words, (len(words) - coalesce(n, 0))::bigint AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (row_id)"""


def _similar(width: int, share: int, more: str = "") -> str:
    """Components of documents whose sets of ``width``-word shingles have ``share`` percent of their union in common."""
    return f"""
    WITH RECURSIVE docs AS (
      SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM documents),
    sets AS (
      SELECT row_id, doc_id,
             CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
                  ELSE list_distinct([array_to_string(words[i:i + {width} - 1], ' ')
                                      FOR i IN range(1, len(words) - {width} + 2)]) END AS elements
      FROM docs),
    flat AS (SELECT row_id, len(elements) AS n, unnest(elements) AS e FROM sets),
    shared AS (
      SELECT a.row_id AS x, b.row_id AS y, any_value(a.n + b.n) AS sizes, count(*) AS n
      FROM flat a JOIN flat b ON a.e = b.e AND a.row_id <> b.row_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared WHERE 100 * n >= {share} * (sizes - n)),
    reached AS (
      SELECT row_id AS x, row_id AS y FROM sets UNION SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x)
    SELECT doc_id, len(elements)::bigint AS n_shingles, component_id{more}
    FROM sets JOIN (SELECT x AS row_id, min(doc_id) AS component_id FROM reached JOIN sets ON y = row_id GROUP BY x) USING (row_id)"""


# The bits of a CRC one by one, over the bytes of a number in decimal.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, [ascii(d[i])::bigint FOR i IN range(1, len(d) + 1)]),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                                        lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_TRIE = f"""
    WITH turns AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
             {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, cast(conv_id AS varchar) AS d, list(t ORDER BY place) AS turns FROM turns GROUP BY conv_id),
    headed AS (SELECT *, {_CRC} % {HEADS} AS h FROM own),
    rebuilt AS (
      SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
      FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {BLOCK}),
    prefixes AS (
      SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, unnest([turns[1:i] FOR i IN range(0, len(turns) + 1)]) AS path,
             len(turns) AS n
      FROM rebuilt),
    nodes AS (
      SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(path[-1].text), 0) AS own,
             sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
      FROM prefixes GROUP BY path, depth),
    family AS (
      SELECT c.*, p.conv_id AS parent_conv_id
      FROM nodes c LEFT JOIN nodes p ON c.depth = p.depth + 1 AND c.path[1:c.depth - 1] = p.path),
    children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    counted AS (SELECT family.*, coalesce(n_children, 0) AS n_children FROM family LEFT JOIN children USING (path, depth)),
    above AS (
      SELECT unnest([path[1:i] FOR i IN range(0, depth + 1)]) AS path, unnest(range(0, depth + 1)) AS depth, own, n_children = 0 AS leaf
      FROM counted),
    subtrees AS (SELECT path, depth, count(*) FILTER (leaf) AS n_leaves, sum(own)::bigint AS saved_tokens FROM above GROUP BY path, depth)
    SELECT conv_id, depth::bigint AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM counted JOIN subtrees USING (path, depth)"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRINGS,
    "op3_jaccard_join": _similar(5, 75),
    "op8_decontamination": _DECONTAMINATION,
    "op11_conversation_trie": _TRIE,
    "op12_minhash_near_dedup": _similar(chosen_paths.WIDTH, chosen_paths.SHARE, ", doc_id IS NOT DISTINCT FROM component_id AS kept"),
}
