"""SQL of the conversation trie and the filter audit, for DuckDB."""

from tomewise.llm.chat import CONTROLS
from tomewise.llm.conv_trie import FAMILY, HEADS
from tomewise.llm.filter_audit import CAPITAL_PERCENT, DISTINCT_PERCENT, FILTERS, LEAST_WORDS, MARKS, ORDERS

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part,
    (CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
     + CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
     + CASE WHEN regexp_matches(t, '[{MARKS.decode()}]') THEN 8 ELSE 0 END
     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
cells AS (SELECT part, mask, count(*) AS n,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY part, mask),
orders AS (SELECT unnest(string_split('{",".join(ORDERS)}', ',')) AS filter_order),
steps AS (SELECT filter_order, step, filter_order[step] AS filter,
    list_sum([CAST(power(2, instr('{FILTERS}', x) - 1) AS INT) FOR x IN string_split(filter_order[:step], '')])::INT AS upto,
    CAST(power(2, instr('{FILTERS}', filter_order[step]) - 1) AS INT) AS own
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & upto = own THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & upto <> own THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & upto = own THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & upto = own THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter FROM counted"""

SAID = "</s>[INST] ok [/INST]"
_CONTROL = "|".join(c.replace("[", chr(92) + "[").replace("]", chr(92) + "]") for c in CONTROLS)


def _escaped(text: str) -> str:
    """The length of a text with its backslashes doubled and one more in each control string."""
    back = f"length({text}) - length(replace({text}, chr(92), ''))"
    return f"(length({text}) + {back} + len(regexp_extract_all({text}, '{_CONTROL}')))"


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS p FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY p)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY p) FILTER (r = 'assistant'), '')) AS loss_sha256,
    sum(CASE r WHEN 'user' THEN length('[INST][/INST]') + {_escaped("t")} WHEN 'assistant' THEN length('</s>') + {_escaped("t")}
        WHEN 'system' THEN length('[SYS][/SYS]') + {_escaped("t")}
        ELSE length('[ROLE][/ROLE]</s>') + {_escaped("r")} + {_escaped("t")} END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""

# Fixed value: the reversed polynomial of CRC-32.
CRC_POLYNOMIAL = 3988292384


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    bit = f"CASE WHEN x % 2 = 1 THEN xor(x // 2, {CRC_POLYNOMIAL}::UBIGINT) ELSE x // 2 END"
    byte = f"list_reduce(list_concat([xor(crc, b)], range(8)::UBIGINT[]), lambda x, i: {bit})"
    letters = f"list_transform(string_split({text}, ''), lambda c: ord(c)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {letters}), lambda crc, b: {byte}), 4294967295::UBIGINT)"


TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, ({crc32("conv_id::VARCHAR")} % {HEADS})::BIGINT AS h, conv_id - conv_id % {FAMILY} AS base FROM l),
r AS (SELECT c.conv_id, t.p, role, text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
    UNION ALL SELECT c.conv_id, t.p - h + least(h, coalesce(l.n, 0)), role, text
    FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN l ON l.conv_id = c.base WHERE t.p > h),
k AS (SELECT conv_id, p AS depth, strlen(text) AS bytes,
      md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY p)) AS node FROM r
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
m AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM k GROUP BY node, depth),
last AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN last USING (conv_id, depth) GROUP BY node),
e AS (SELECT m.node, k.node AS parent FROM m JOIN k ON k.conv_id = m.conv_id AND k.depth = m.depth - 1),
kids AS (SELECT parent AS node, count(*) AS children FROM e GROUP BY parent),
sub AS (SELECT k.node, sum(CASE WHEN children IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * m.bytes) AS saved
    FROM m JOIN k ON k.conv_id = m.conv_id AND k.depth <= m.depth LEFT JOIN kids ON kids.node = m.node GROUP BY k.node)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(children, 0) AS n_children,
    leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN sub USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
    LEFT JOIN e USING (node) LEFT JOIN m up ON up.node = e.parent"""
