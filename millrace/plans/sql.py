"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from millrace.functions.quality import GROUNDING, OFFENSIVE, PAIR_PLACEHOLDERS, PLACEHOLDERS, SECRETS
from millrace.functions.text import NO_WORD, ORPHANS, SPACE
from millrace.operators.splits import PARTITION_SALT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def strip(x: str) -> str:
    return f"regexp_replace({text(x)}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({text(x)}, '{SPACE}+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(lower({text(x)}), '{SPACE}+', ' ', 'g'))"


def form(x: str) -> str:
    return f"trim(regexp_replace(lower({text(x)}), '{NO_WORD}+', ' ', 'g'))"


def ngrams(items: str, n: int) -> str:
    return f"CASE WHEN len({items}) >= {n} THEN list_transform(range(1, len({items}) - {n} + 2), lambda i: array_to_string({items}[i:i + {n - 1}], ' ')) ELSE [] END"


def shingles(items: str, k: int = 3) -> str:
    return f"list_distinct(CASE WHEN len({items}) < {k} THEN {items} ELSE {ngrams(items, k)} END)"


def repetition(grams: str) -> str:
    return f"CASE WHEN len({grams}) > 0 THEN 1.0::DOUBLE - len(list_distinct({grams}))::DOUBLE / len({grams})::DOUBLE ELSE 0.0::DOUBLE END"


def fences(x: str) -> str:
    return f"len(regexp_extract_all({text(x)}, '(?m)^```'))"


def cut_off(x: str) -> str:
    t = strip(x)
    return f"({t} = '' OR {fences(t)} % 2 <> 0 OR regexp_matches(lower(right({t}, 20)), ' (?:{'|'.join(ORPHANS)})$'))"


def placeholder(x: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({strip(x)}, {quoted('(?i)' + p)}) THEN {quoted(p)} END" for p in PLACEHOLDERS) + ")"


def secrets(x: str) -> str:
    return "list_filter([" + ", ".join(f"regexp_extract({text(x)}, {quoted(p)}, 0)" for p in SECRETS) + "], lambda s: s <> '')"


def ungrounded(x: str) -> str:
    return f"(regexp_matches(lower({text(x)}), {quoted(OFFENSIVE)}) AND NOT regexp_matches(lower({text(x)}), {quoted(GROUNDING)}))"


def pair_reason(i: str, r: str, w: str | None = None) -> str:
    """Over columns i and r that are stripped already; ``w`` is r's words."""
    bad = quoted("(?i)" + "|".join(f"(?:{p})" for p in PAIR_PLACEHOLDERS))
    w = w or words(r)
    return f"""CASE WHEN {i} = '' THEN 'instruction_blank' WHEN {r} = '' THEN 'response_blank'
        WHEN length({i}) < 10 THEN 'instruction_short=' || length({i}) WHEN length({r}) < 20 THEN 'response_short=' || length({r})
        WHEN length({i}) + length({r}) > 24000 THEN 'pair_long=' || (length({i}) + length({r}))
        WHEN regexp_matches({i}, {bad}) THEN 'instruction_placeholder' WHEN regexp_matches({r}, {bad}) THEN 'response_placeholder'
        WHEN contains({r}, '```') AND {fences(r)} % 2 <> 0 THEN 'response_fence_open'
        WHEN len({w}) >= 30 AND {repetition(ngrams(w, 4))} > 0.45 THEN 'response_repeats' END"""


def has_word(x: str, keyword: str) -> str:
    """Whether a keyword of letters, digits and blanks stands between word boundaries."""
    return f"regexp_matches(lower({text(x)}), '(^|{NO_WORD})' || regexp_replace(lower({keyword}), '([^\\p{{L}}\\p{{N}}\\s])', '\\\\\\1', 'g') || '({NO_WORD}|$)')"


def partition_of(i: str, r: str) -> str:
    digest = f"md5('{PARTITION_SALT}::' || {squeeze(i)} || '::' || {squeeze(r)})"
    return f"CASE WHEN {digest} < 'e6666666666668000000000000000000' THEN 'train' WHEN {digest} < 'f3333333333338000000000000000000' THEN 'validation' ELSE 'test' END"


def contents(messages: str, role: str) -> str:
    """The contents of a role, stripped, without blank ones."""
    return f"list_filter(list_transform(list_filter({messages}, lambda m: m.role = '{role}'), lambda m: {strip('m.content')}), lambda c: c <> '')"


def content_id(source: str, i: str, r: str) -> str:
    return f"'{source}_' || sha256('{source}::' || {i} || '::' || {r})[1:16]"


def ascii_words(x: str) -> str:
    """Runs of ASCII word characters and hyphens between Unicode's word boundaries. This engine knows ASCII's boundaries
    only, so words with other letters stand as one ASCII word until the runs are found."""
    other, mark = "[\\p{L}\\p{M}\\p{N}_]*[^\\x00-\\x7F\\s\\p{P}\\p{S}\\p{Z}\\p{C}][\\p{L}\\p{M}\\p{N}_]*", "0qxq0"
    runs = f"regexp_extract_all(regexp_replace(lower({text(x)}), '{other}', '{mark}', 'g'), '\\b[a-z0-9_-]+\\b')"
    return f"list_filter(flatten(list_transform({runs}, lambda w: string_split(w, '{mark}'))), lambda w: w <> '')"


def tidy(x: str) -> str:
    """The clean-up of texts; of compatibility forms it knows full width and the ellipsis, which these tables hold."""
    blanks = "[\\t\\x0B-\\r\\x1C-\\x20\\x{85}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    t = f"replace(translate({text(x)}, {quoted(wide + chr(0x3000))}, {quoted(plain + ' ')}), '…', '...')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace(replace(replace({t}, chr(160), ' '), chr(8203), ''), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({t}, '{blanks}+(\\n|$)', '\\1', 'g')")


def near_pairs(source: str, key: str, words_: str, threshold: float) -> str:
    """Tables s, n, e: shingles of three words, their numbers, and pairs a < b of rows at least as similar as ``threshold``."""
    return f"""w AS (SELECT {key} AS id, {words_} AS w FROM {source}), s AS (SELECT id, unnest({shingles("w")}) AS g FROM w), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    k AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
    e AS (SELECT a, b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k / (x.n + y.n - k) >= {threshold})"""


def greedy_keep() -> str:
    """Tables q, r, gone, near_by: of the pairs e the rows dropped one after the other, and the first kept row near each."""
    return """q AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM (SELECT DISTINCT b FROM e)),
    r(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT q.i, CASE WHEN (SELECT count(*) FROM e WHERE e.b = q.b AND NOT list_contains(r.gone, e.a)) > 0 THEN list_append(r.gone, q.b) ELSE r.gone END
        FROM r JOIN q ON q.i = r.i + 1),
    gone AS (SELECT unnest(gone) AS id FROM r WHERE i = (SELECT max(i) FROM r)),
    near_by AS (SELECT b AS id, min(a) AS kept_by FROM e WHERE a NOT IN (SELECT id FROM gone) AND b IN (SELECT id FROM gone) GROUP BY b)"""


def contaminated(rows: str, key: str, text_: str) -> str:
    """Tables of which ``hit`` has the keys of the rows that equal, hold, lie within or resemble a benchmark prompt."""
    split = "list_filter(string_split(f, ' '), lambda x: x <> '')"
    return f"""cd AS (SELECT id, f, {split} AS w FROM (SELECT {key} AS id, {form(text_)} AS f FROM {rows}) WHERE f <> ''),
    cb AS (SELECT item_id, f, {split} AS w FROM (SELECT item_id, {form("text")} AS f FROM benchmark) WHERE f <> ''),
    cs AS (SELECT id, len(s) AS n, unnest(s) AS g FROM (SELECT id, {shingles("w")} AS s FROM cd)), ct AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM (SELECT item_id, {shingles("w")} AS s FROM cb)),
    hit AS (SELECT id FROM cd JOIN cb ON cd.f = cb.f UNION SELECT id FROM cd JOIN cb ON length(cd.f) > 40 AND length(cb.f) > 40 AND (contains(cd.f, cb.f) OR contains(cb.f, cd.f))
        UNION SELECT id FROM (SELECT id, item_id, cs.n AS a, ct.n AS b, count(*) AS k FROM cs JOIN ct USING (g) GROUP BY ALL) WHERE k / (a + b - k) >= 0.7)"""
