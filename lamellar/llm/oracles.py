"""DuckDB SQL of the queries that SQL can express, over the same tables. The rules are those of the modules' docstrings, by plainer ways: no hashes, masks or tours."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, punctuation

from lamellar.llm.urls import RULES

#: White space of Java's \s.
S = r"[ \t\n\x0B\f\r]"


def op3() -> str:
    """Diagonals on which a document and an item share three words in sequence, each laid out word by word; substitutions are summed up in windows."""
    strip = punctuation.replace("'", "''")
    words = rf"""list_transform(list_filter(string_split_regex(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> ''),
      lambda x: CASE WHEN trim(x, '{strip}') = '' THEN x ELSE trim(x, '{strip}') END)"""
    return f"""
WITH d AS (SELECT row, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL)),
b AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS n, least(len(w), 13) AS size, CASE WHEN len(w) >= 13 THEN 2 WHEN len(w) >= 7 THEN 1 ELSE 0 END AS most
  FROM (SELECT item_id, {words} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))),
dg AS (SELECT row, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT row, w, unnest(range(1, n - 1)) AS p FROM d WHERE n >= 3)),
bg AS (SELECT item, q, w[q] AS a, w[q + 1] AS b, w[q + 2] AS c FROM (SELECT item, w, unnest(range(1, n - 1)) AS q FROM b WHERE n >= 3)),
diagonals AS (SELECT DISTINCT row, item, p - q AS shift FROM dg JOIN bg USING (a, b, c)),
laid AS (SELECT row, item, shift, size, most, i, (dw[i + shift] <> bw[i])::INTEGER AS miss
  FROM (SELECT row, item, shift, size, most, d.w AS dw, b.w AS bw, unnest(range(greatest(1, 1 - shift), least(b.n, d.n - shift) + 1)) AS i FROM diagonals JOIN d USING (row) JOIN b USING (item))),
sums AS (SELECT row, item, shift, size, most, i, sum(miss) OVER w AS misses, count(*) OVER w AS seen FROM laid WINDOW w AS (PARTITION BY row, item, shift ORDER BY i ROWS 12 PRECEDING)),
windows AS (SELECT DISTINCT row, item, i + shift - size AS s, i + shift AS e FROM sums WHERE seen = size AND misses <= most
  UNION SELECT row, item, 0, b.n FROM d JOIN b ON d.w = b.w WHERE b.n BETWEEN 1 AND 2),
spans AS (SELECT row, item, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY row, item ORDER BY s) AS g
  FROM (SELECT *, (s > coalesce(lag(e) OVER (PARTITION BY row, item ORDER BY s), -1))::INTEGER AS fresh FROM windows)) GROUP BY row, item, g)
SELECT doc_id, item_id, d.n AS n_words, CAST(sum(e - s) AS BIGINT) AS n_overlap_words, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM spans JOIN d USING (row) JOIN b USING (item) GROUP BY row, item, doc_id, item_id, d.n"""


def op5(order: int = 3, least_context: int = 2, fold: int = 5) -> str:
    """Grams cut out of the text one by one, levels of the model joined one after another; CRC-32 by its table."""
    table = []
    for k in range(256):  # the polynomial's remainders of all bytes
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    octets = "list_transform(range(0, octet_length(encode(url))), lambda i: ('0x' || substring(hex(encode(url)), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule, ruled = (" ".join(f"WHEN {fits(h, p)} THEN '{of(kind, h + p)}'" for kind, h, p in rules) for of in (lambda kind, name: name, lambda kind, name: kind))
    text = r"'^' || regexp_replace(regexp_replace(lower(regexp_replace(url, '^[^:]*://', '')), '[0-9]', '0', 'g'), '[^a-z0./?=&#_%:~+,;@!$''()\[\]-]', '*', 'g')"
    gram = f"substring(text, greatest(i - {order}, 1), least(i, {order + 1}))"
    smooth = lambda c, lower: f"CASE WHEN n_{c} > 0 THEN ({c} + t_{c} * {lower}) / (n_{c} + t_{c}) ELSE {lower} END AS p_{c}"
    levels = [f"l1 AS (SELECT g, {smooth('allow', '(1 / 64)')}, {smooth('block', '(1 / 64)')} FROM known WHERE length(g) = 1)"]
    for k in range(2, order + 2):
        levels.append(f"l{k} AS (SELECT k.g, {smooth('allow', 'l.p_allow')}, {smooth('block', 'l.p_block')} FROM known k JOIN l{k - 1} l ON l.g = right(k.g, {k - 1}) WHERE length(k.g) = {k})")
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, order + 2))
    looked_up = " ".join(f"LEFT JOIN model m{k} ON m{k}.g = CASE WHEN length(a.g) >= {k} THEN right(a.g, {k}) END" for k in range(1, order + 2))
    best = ", ".join(f"m{k}.llr" for k in range(order + 1, 0, -1))
    return f"""
WITH split AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
page AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM part),
u AS MATERIALIZED (SELECT url, ruled, count(*) AS n, {text} AS text, {crc} % {fold} = 0 AS tested FROM page WHERE url IS NOT NULL GROUP BY url, ruled),
spot AS MATERIALIZED (SELECT url, ruled, tested, n, {gram} AS g FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM u)),
suffix AS (SELECT ruled, n, right(g, k) AS g FROM (SELECT ruled, n, g, unnest(range(1, length(g) + 1)) AS k FROM spot WHERE ruled IS NOT NULL AND NOT tested)),
gram AS (SELECT g, left(g, length(g) - 1) AS h, coalesce(sum(n) FILTER (ruled = 'allow'), 0)::DOUBLE AS allow, coalesce(sum(n) FILTER (ruled = 'block'), 0)::DOUBLE AS block FROM suffix GROUP BY g),
context AS (SELECT h, sum(allow) AS n_allow, sum(block) AS n_block, count(*) FILTER (allow > 0) AS t_allow, count(*) FILTER (block > 0) AS t_block FROM gram GROUP BY h HAVING sum(allow) + sum(block) >= {least_context} OR h = ''),
known AS (SELECT * FROM gram JOIN context USING (h)),
{", ".join(levels)},
model AS MATERIALIZED (SELECT g, ln(p_allow / p_block) AS llr FROM ({every})),
score AS (SELECT a.url, avg(coalesce({best}, 0)) AS score FROM spot a {looked_up} GROUP BY a.url),
bins AS (SELECT round(greatest(-20, least(20, score)), 2) AS bin, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS allow, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS block
  FROM u JOIN score USING (url) WHERE ruled IS NOT NULL AND tested GROUP BY 1),
cut AS (SELECT bin, coalesce(lag(bin) OVER w, bin) AS below, (sum(block) OVER w - block) / sum(block) OVER () - (sum(allow) OVER w - allow) / sum(allow) OVER () AS gain FROM bins WINDOW w AS (ORDER BY bin)),
enough AS (SELECT count(DISTINCT (ruled, tested)) = 4 AS known_both FROM u WHERE ruled IS NOT NULL),
threshold AS (SELECT (min(below) + max(bin)) / 2 AS least FROM cut, enough WHERE known_both AND gain = (SELECT max(gain) FROM cut))
SELECT page_id, host, path, rule, round(score, 6) AS score, coalesce(ruled, CASE WHEN score < least THEN 'block' ELSE 'allow' END) AS verdict FROM page LEFT JOIN score USING (url), threshold"""


def op6() -> str:
    """Passages and messages compared as texts; reply order by paths from the roots."""
    marks = rf"^{S}*((?:>{S}?)+)"
    norm = lambda x: rf"trim(regexp_replace(lower({x}), '{S}+', ' ', 'g'), ' ')"
    lines = lambda x: f"list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda y: {norm('y')}), lambda y: y <> '')"
    blank = rf"\n{S}*\n"
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, conv_id, coalesce('c' || conv_id, 'null') AS c, turn, role, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '(?m)^{S}*>') AS quoted FROM conversations),
line AS (SELECT row, i, x, length(regexp_replace(regexp_extract(x, '{marks}', 1), '[^>]', '', 'g')) AS level
  FROM (SELECT row, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM (SELECT row, string_split_regex(text, '\r?\n') AS xs FROM m WHERE quoted))),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS r FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY row ORDER BY i))::INTEGER AS fresh FROM line)),
run AS (SELECT row, r, level, string_agg(regexp_replace(x, '{marks}', ''), chr(10) ORDER BY i) AS t FROM numbered GROUP BY row, r, level),
unquoted AS (SELECT row, string_agg(regexp_replace(t, '(?m)^.*wrote:{S}*$', '', 'g'), chr(10) ORDER BY r) AS t FROM run WHERE level = 0 GROUP BY row),
said AS (SELECT m.*, CASE WHEN quoted THEN regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{S}+|{S}+$', '', 'g') ELSE text END AS body FROM m LEFT JOIN unquoted USING (row)),
piece AS (SELECT row, level, 0 AS part, {lines('t')} AS xs FROM run WHERE level > 0
  UNION ALL SELECT row, level, 1, {lines('p')} FROM (SELECT row, level, unnest(string_split_regex(t, '{blank}')) AS p FROM run WHERE level > 0)
  UNION ALL SELECT row, level, 2, [x] FROM (SELECT row, level, unnest({lines('t')}) AS x FROM run WHERE level > 0)),
asked AS (SELECT DISTINCT c, row, turn, level, part, len(xs) AS n, array_to_string(xs, ' ') AS h FROM piece JOIN m USING (row) WHERE len(xs) > 0 AND turn IS NOT NULL),
own AS (SELECT c, row, turn, body, {lines('body')} AS xs FROM said WHERE turn IS NOT NULL AND c IN (SELECT c FROM asked)),
says AS (SELECT c, row, turn, array_to_string(xs, ' ') AS h FROM own
  UNION SELECT c, row, turn, array_to_string({lines('p')}, ' ') FROM (SELECT c, row, turn, unnest(string_split_regex(body, '{blank}')) AS p FROM own)
  UNION SELECT c, row, turn, array_to_string(xs[i:i + n - 1], ' ') FROM (SELECT *, unnest(range(1, len(xs) - n + 2)) AS i FROM own JOIN (SELECT DISTINCT c, n FROM asked) USING (c) WHERE n <= len(xs))),
link AS (SELECT row, parent FROM (SELECT a.row, s.row AS parent, row_number() OVER (PARTITION BY a.row ORDER BY a.level, a.part, s.turn DESC, s.row) AS k
  FROM asked a JOIN says s ON s.c = a.c AND s.h = a.h AND s.turn < a.turn) WHERE k = 1),
node AS (SELECT said.*, parent, row_number() OVER (ORDER BY turn NULLS FIRST, row) AS k FROM said LEFT JOIN link USING (row)),
tree AS (SELECT row, 0 AS depth, [k] AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT node.row, depth + 1, list_append(path, k) FROM tree JOIN node ON node.parent = tree.row)
SELECT conv_id, turn, role, body AS text, (SELECT p.turn FROM m p WHERE p.row = node.parent) AS parent_turn, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY c ORDER BY path) - 1 AS place FROM node JOIN tree USING (row)"""


def op9(window: int = 8, least_contexts: int = 3, least_share: float = 0.5, least_bits: float = 3.0, least_novelty: float = 0.5, least_letters: int = 3, reach: int = 400) -> str:
    """Plain patterns; places by the lengths of what stands between the matches; terms are letter runs of the whole text."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def found(pattern: str, of: str = "d") -> str:
        """row, s, e, v of the matches."""
        lists = f"SELECT row, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM {of} WHERE regexp_matches(text, '{pattern}')"
        each = f"SELECT row, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS v, unnest(gaps[1:len(hits)]) AS gap FROM ({lists})"
        return f"SELECT row, e - length(v) AS s, e, v FROM (SELECT row, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS e FROM ({each}))"

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = "(x * 2 - CASE WHEN x > 4 THEN 9 ELSE 0 END)"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN {doubled} ELSE x END for x, i in list_transform(string_split(reverse({digits}), ''), lambda z: z::INTEGER)])"
    luhn = luhn.replace("i % 2 = 1", "i % 2 = 0")  # i is from 1
    valid = {
        "email": "true",
        "ip": "list_bool_and([length(ltrim(p, '0')) < 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255') for p in string_split(v, '.')])",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    base = " UNION ALL ".join(f"SELECT {k} AS k, '{kind}' AS kind, row, s, e, v FROM ({found(patterns[kind])}) WHERE {valid[kind]}" for k, kind in enumerate(patterns))
    words = lambda x: rf"list_filter(string_split_regex(lower({x}), '\P{{L}}+'), lambda y: y <> '')"
    # one character more than the reach tells if a word goes on beyond it
    left = rf"CASE WHEN s > {reach} THEN regexp_replace(substring(text, s - {reach}, {reach + 1}), '^(?:\p{{L}}+|\P{{L}})', '') ELSE substring(text, 1, s) END"
    right = rf"CASE WHEN length(text) - e > {reach} THEN regexp_replace(substring(text, e + 1, {reach + 1}), '(?s)(?:\p{{L}}+|\P{{L}})$', '') ELSE substring(text, e + 1) END"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}" for kind in patterns)
    mark = "kind || ':' || s || ':' || e"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({base}),
near AS (SELECT entity, list_slice(l, greatest(len(l) - {window - 1}, 1), len(l)) AS l, r[1:{window}] AS r FROM (SELECT kind || ':' || lower(v) AS entity, {words(left)} AS l, {words(right)} AS r FROM base JOIN d USING (row))),
contexts AS MATERIALIZED (SELECT row_number() OVER () AS context, entity, list_distinct(list_concat(l, r)) AS near, count(*) AS n FROM near GROUP BY entity, l, r),
entities AS (SELECT entity, sum(n) AS entity_rows FROM contexts GROUP BY 1),
words AS MATERIALIZED (SELECT entity, context, n, unnest(near) AS word FROM contexts),
pairs AS (SELECT entity, word AS term, count(*) AS evidence, sum(n) AS together FROM words WHERE length(word) >= {least_letters} OR (length(word) > 1 AND regexp_full_match(word, '\P{{Latin}}+')) GROUP BY 1, 2 HAVING count(*) >= {least_contexts}),
shared AS (SELECT entity, term, o.word, count(*) AS k, any_value(evidence) AS evidence FROM pairs JOIN words t USING (entity) JOIN words o USING (entity, context) WHERE t.word = term AND o.word <> term GROUP BY 1, 2, 3),
novel AS (SELECT entity, term FROM shared GROUP BY 1, 2 HAVING sum(CASE WHEN 2 * k <= greatest(evidence, 2) THEN k ELSE 0 END) / sum(k) >= {least_novelty}),
holds AS MATERIALIZED (SELECT row, unnest(list_distinct({words('text')})) AS term FROM d),
known AS (SELECT term, least(1.0, together / term_rows) AS share, entity_rows FROM pairs JOIN novel USING (entity, term) JOIN entities USING (entity) JOIN (SELECT term, count(*) AS term_rows FROM holds GROUP BY 1) USING (term)),
terms AS (SELECT DISTINCT term FROM known WHERE share >= {least_share} AND log2(share / (entity_rows / (SELECT greatest(1, count(*)) FROM d))) >= {least_bits}),
told AS (SELECT * FROM d WHERE row IN (SELECT row FROM holds JOIN terms USING (term))),
runs AS ({found(r'\p{L}+', 'told')}),
spans AS (SELECT * FROM base UNION ALL SELECT 4, 'term', row, s, e, v FROM runs WHERE lower(v) IN (SELECT term FROM terms) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = runs.row AND b.s < runs.e AND b.e > runs.s)),
of AS (SELECT row, {counts}, string_agg({mark}, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg({mark}, ',' ORDER BY k, s) AS spans, CAST(count(*) AS BIGINT) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in patterns)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN of USING (row)"""


ORACLES = {"op3_decontaminate": op3(), "op5_url_filter": op5(), "op6_quotation_linking": op6(), "op9_pii": op9()}
