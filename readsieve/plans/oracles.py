"""The same queries as SQL for DuckDB, over whole tables.

Written from the definitions, with windows enumerated by ``substr`` and hashes
worked out on the distinct k-mers; nothing is shared with the Spark code but
the parameters.
"""

from __future__ import annotations

from readsieve.operators.bloom import BloomParams
from readsieve.operators.emission import KmerSpec
from readsieve.plans.queries import FILTER, LEAST_SHARED, SCREENS, SIZE, SMALL_BLOCKED, SMALL_FILTER, WATCH_SPEC
from readsieve.plans.screen import ScreenSpec

# The text alphabet, and factor and seed of the filter's hash.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CYCLE = ("acgt" * 7)[:26]
_WORD = 0xFFFFFFFF
_M = 0x5BD1E995
_SEED = 0x9747B28C

BASES = f"regexp_replace(translate(text, '{_LETTERS}{_LETTERS.upper()}', '{_CYCLE}{_CYCLE}'), '[^acgt]', 'n', 'g')"


def _seqs(prefix: str, table: str, key: str, extra: str = "") -> str:
    return f"{prefix}_seqs AS (SELECT {key} AS id, {BASES} AS s, length(text) AS n{extra} FROM {table})"


def _code(digit: str, power: str, k: int) -> str:
    terms = []
    for j in range(1, k + 1):
        base = f"(instr('acgt', substr(w, {j}, 1)) - 1)"
        terms.append(f"({digit.format(base)}) * {4 ** (k - j) if power == 'down' else 4 ** (j - 1)}")
    return " + ".join(terms)


def _hash_ctes(prefix: str, source: str, k: int) -> str:
    """``{prefix}_hash (w, c, h)`` from the distinct ``w`` of ``source``."""
    m = 4**k - 1
    steps = [
        f"({m} - x) + ((x << 21) & {m})",
        "x",
        "x + (x << 3) + (x << 8)",
        "x",
        "x + (x << 2) + (x << 4)",
        "x",
        "x + (x << 31)",
    ]
    folds = [None, 24, None, 14, None, 28, None]
    inner = (
        f"SELECT w, c, c AS x FROM (SELECT w, least({_code('{}', 'down', k)}, {_code('3 - {}', 'up', k)})::BIGINT AS c "
        f"FROM (SELECT DISTINCT w FROM {source}))"
    )
    for step, fold in zip(steps, folds):
        value = f"xor(x, x >> {fold})" if fold else f"({step}) & {m}"
        inner = f"SELECT w, c, {value} AS x FROM ({inner})"
    return f"{prefix}_hash AS (SELECT w, c, x * 256 + {k} AS h FROM ({inner}))"


def _windows(prefix: str, k: int, where: str) -> str:
    """``{prefix}_win (id, i, w)``: all k-windows, cut from pieces of 256 starts."""
    return (
        f"{prefix}_piece AS (SELECT id, n, p0, substr(s, p0, {255 + k}) AS piece FROM "
        f"(SELECT id, s, n, unnest(range(1, n - {k} + 2, 256)) AS p0 FROM {prefix}_seqs WHERE {where})),\n"
        f"{prefix}_win AS (SELECT id, p0 + j AS i, substr(piece, j + 1, {k}) AS w FROM "
        f"(SELECT id, p0, piece, unnest(range(0, least(256, n - {k} + 2 - p0))) AS j FROM {prefix}_piece))"
    )


def _emit_ctes(prefix: str, spec: KmerSpec) -> str:
    """``{prefix}_emit (id, h)`` from ``{prefix}_seqs``."""
    k, p = spec.k, prefix
    if k % 2 == 0 and spec.compat:
        return _even_ctes(p, k)
    longer = f"n > {k}" if spec.compat else f"n >= {k}"
    parts = [_windows(p, k, longer)]
    if spec.compat:
        parts += [
            f"{p}_head AS (SELECT id, substr(s, 1, {k}) AS w1, substr(s, 2, {k}) AS w2 FROM {p}_seqs WHERE {longer})",
            f"{p}_pair AS (SELECT id, w FROM {p}_win WHERE i >= 2 AND NOT contains(w, 'n') UNION "
            f"SELECT id, w1 FROM {p}_head WHERE NOT contains(w1, 'n') AND contains(w2, 'n'))",
            _hash_ctes(p, f"{p}_pair", k),
            f"{p}_emit AS (SELECT id, h FROM {p}_pair JOIN {p}_hash USING (w) UNION "
            f"SELECT id, 0 FROM {p}_head WHERE contains(w1, 'n') AND contains(w2, 'n'))",
        ]
    else:
        parts += [
            f"{p}_pair AS (SELECT DISTINCT id, w FROM {p}_win WHERE NOT contains(w, 'n'))",
            _hash_ctes(p, f"{p}_pair", k),
            f"{p}_emit AS (SELECT DISTINCT id, h FROM {p}_pair JOIN {p}_hash USING (w))",
        ]
    return ",\n".join(parts)


def _even_ctes(prefix: str, k: int) -> str:
    """The same for even k in compat mode.

    The k-mer at a position is made of the last k bases, absent ones zero in both
    strands; one that is its own reverse complement does not count. A run is the number
    that count since the latest other character, and from k on it gives a hash. From
    position k on, all but the palindromes emit the latest hash, or 0.
    """
    p = prefix
    turned = "translate(reverse(w), 'acgt', 'tgca')"
    return f"""{p}_char AS (SELECT id, unnest(string_split(s, '')) AS ch, unnest(range(0, n)) AS i FROM {p}_seqs WHERE n > 0),
{p}_base AS (SELECT id, i, string_agg(ch, '') OVER (PARTITION BY id ORDER BY i ROWS {k - 1} PRECEDING) AS w
  FROM {p}_char WHERE ch <> 'n'),
{p}_at AS (SELECT id, i, ch, w, coalesce(lpad(w, {k}, 'a') <> rpad({turned}, {k}, 'a'), false) AS counts,
    sum((ch = 'n')::INT) OVER (PARTITION BY id ORDER BY i) AS part
  FROM {p}_char LEFT JOIN {p}_base USING (id, i)),
{p}_run AS (SELECT *, counts AND sum(counts::INT) OVER (PARTITION BY id, part ORDER BY i) >= {k} AS fresh FROM {p}_at),
{p}_fresh AS (SELECT DISTINCT w FROM {p}_run WHERE fresh),
{_hash_ctes(p, f"{p}_fresh", k)},
{p}_last AS (SELECT id, i, counts OR ch = 'n' AS emits,
    last_value(CASE WHEN fresh THEN h END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS latest
  FROM {p}_run LEFT JOIN {p}_hash USING (w)),
{p}_emit AS (SELECT DISTINCT id, coalesce(latest, 0) AS h FROM {p}_last WHERE emits AND i >= {k})"""


def _documents(spec: KmerSpec, extra: str = "") -> str:
    return "WITH " + _seqs("d", "documents", "doc_id", extra) + ",\n" + _emit_ctes("d", spec)


def _benchmark(spec: KmerSpec) -> str:
    return _seqs("b", "benchmark", "item_id") + ",\n" + _emit_ctes("b", spec)


def _sketch_cte(size: int) -> str:
    return (
        "sk AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS rn FROM d_emit "
        f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY h) <= {size})"
    )


# ---------------------------------------------------------------------- Bloom


def _murmur(source: str, seed: str, out: str) -> str:
    """``source`` with a column ``out``: MurmurHash2 of the first 7 bytes of h."""
    mul = f"* {_M}) & {_WORD}"
    steps = [
        f"SELECT *, ((h & {_WORD}) {mul} AS kk, xor({seed}, 7) AS hh FROM {source}",
        f"SELECT * REPLACE ((xor(kk, kk >> 24) {mul} AS kk, (hh {mul} AS hh) FROM ({{}})",
        f"SELECT * REPLACE ((xor(xor(hh, kk), (h >> 32) & 16777215) {mul} AS hh) FROM ({{}})",
        f"SELECT * REPLACE ((xor(hh, hh >> 13) {mul} AS hh) FROM ({{}})",
        f"SELECT * EXCLUDE (kk, hh), xor(hh, hh >> 15) AS {out} FROM ({{}})",
    ]
    sql = steps[0]
    for step in steps[1:]:
        sql = step.format(sql)
    return sql


def _keys(source: str) -> str:
    """``source (h)`` with the two hashes ``a`` and ``b``."""
    first = _murmur(f"(SELECT DISTINCT h::BIGINT AS h FROM {source})", str(_SEED), "a")
    return _murmur(f"({first})", "a", "b")


def _positions(source: str, params: BloomParams) -> str:
    return (
        f"SELECT h, i, ((a + ((i * b) & {_WORD})) & {_WORD}) % {params.bits} AS position "
        f"FROM (SELECT h, a, b, unnest(range(0, {params.hashes})) AS i FROM ({_keys(source)}))"
    )


def _member_ctes(asked: str, params: BloomParams) -> str:
    return (
        f"bits AS (SELECT DISTINCT position FROM ({_positions('b_emit', params)})),\n"
        f"asked AS ({_positions(asked, params)}),\n"
        f"wl AS (SELECT h FROM asked LEFT JOIN bits USING (position) GROUP BY h HAVING count(bits.position) = count(*))"
    )


def _block_bits(source: str) -> str:
    """``h, block, j, bit``: the one bit of each word j of a hash's block."""
    keyed = _murmur(f"({_murmur(f'({_keys(source)})', 'b', 'c')})", "c", "d")
    return (
        f"SELECT h, (a * 2147483648 + b // 2) % {SMALL_BLOCKED.blocks} AS block, j, "
        f"((c + ((j * (d | 1)) & {_WORD})) & {_WORD}) >> 26 AS bit "
        f"FROM (SELECT *, unnest(range(0, 8)) AS j FROM ({keyed}))"
    )


# ---------------------------------------------------------------- containment


def _screen(
    spec: ScreenSpec, key: str = "id AS doc_id", where: str = "", extra: str = ""
) -> str:
    k, size = spec.kmers.k, spec.size
    if spec.filter is None:
        wl = "wl AS (SELECT DISTINCT h FROM b_emit)"
    else:
        wl = _member_ctes("(SELECT h FROM sk UNION SELECT 0)", spec.filter)
    ref = spec.ref_length if spec.ref_length is not None else "(SELECT sum(length(text)) FROM benchmark)::BIGINT"
    padding = f"(SELECT count(*) FROM wl WHERE h = 0) * ({size} - n_minima)" if spec.kmers.compat else "0"
    lost = int(spec.fp_rate * size)
    return f"""{_documents(spec.kmers)},
{_benchmark(spec.kmers)},
{_sketch_cte(size)},
{wl},
hit AS (SELECT sk.id, count(*) AS n_minima, count(wl.h) AS m FROM sk LEFT JOIN wl USING (h) GROUP BY sk.id),
found AS (SELECT hit.id, n AS seq_len, n_minima, (m + {padding} - {lost})::BIGINT AS x
  FROM hit JOIN d_seqs USING (id)),
ratio AS (SELECT *, x::DOUBLE / {size}::DOUBLE AS c, seq_len - {k} + 1 AS q, {ref} - {k} + 1 AS r FROM found)
SELECT {key}, seq_len, n_minima, x AS intersections, c AS containment,
  (q::DOUBLE * c) / ((q + r)::DOUBLE - (q::DOUBLE * c)) AS jaccard
FROM ratio"""


# -------------------------------------------------------------------- queries


def _hashed(k: int) -> str:
    spec = KmerSpec(k, False, "text")
    return f"{_documents(spec)}\nSELECT DISTINCT c AS canonical, h AS hash FROM d_hash"


def _emitted(k: int, compat: bool) -> str:
    return f"""{_documents(KmerSpec(k, compat, "text"))}
SELECT id AS doc_id, count(*) AS n_hashes, max(h)::BIGINT AS max_hash, sum(h)::BIGINT AS sum_hash
FROM d_emit GROUP BY id"""


def _summary(k: int, compat: bool) -> str:
    return f"""{_documents(KmerSpec(k, compat, "text"))},
{_sketch_cte(SIZE)}
SELECT sk.id AS doc_id, any_value(n) AS seq_len, count(*) AS n_minima, max(h)::BIGINT AS largest,
  min(h)::BIGINT AS smallest, sum(h)::BIGINT AS total
FROM sk JOIN d_seqs USING (id) GROUP BY sk.id"""


def _by_source(k: int) -> str:
    return f"""{_documents(KmerSpec(k, True, "text"), ", source")},
pairs AS (SELECT DISTINCT source, h FROM d_emit JOIN d_seqs USING (id)),
sk AS (SELECT source, h, row_number() OVER (PARTITION BY source ORDER BY h) AS rn FROM pairs
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) <= {SIZE})
SELECT source, (max(rn) OVER (PARTITION BY source) - rn)::BIGINT AS rank, h::BIGINT AS hash FROM sk"""


_K7 = KmerSpec(7, True, "text")
_EVENT_JSON = (
    """'{"id": ' || event_id || ', "type": "' || event_type || '", "user": [' || user_id || ', "0x' || """
    """lower(to_hex(user_id)) || '", {"odd": ' || (user_id % 2 = 1) || '}], "props": ' || props || '}'"""
)
# the same object without spaces, with its keys in order
_PROPS = "replace(props, ' ', '')"
_USER = """('[' || user_id || ',"0x' || lower(to_hex(user_id)) || '",{"odd":' || (user_id % 2 = 1) || '}]')"""
_K = "(props->>'$.k')::BIGINT"


def _escaped(column: str) -> str:
    sql = column
    pairs = [(92, r"\\"), (34, r"\""), (8, r"\b"), (9, r"\t"), (10, r"\n"), (11, r"\v"), (12, r"\f"), (13, r"\r")]
    pairs += [(c, f"\\u{c:04x}") for c in [*range(1, 8), *range(14, 32), 127]]
    for code, spelled in pairs:
        sql = f"replace({sql}, chr({code}), '{spelled}')"
    return sql


_DOC_RECORDS = f"SELECT doc_id, 'd' || doc_id AS name, source, {BASES} AS s FROM documents"
_FASTQ_ROWS = (
    "SELECT name, source AS comment, length(s) AS seq_len, md5(s) AS seq_md5, length(s) AS qual_len, 'ok' AS status "
    f"FROM ({_DOC_RECORDS})"
)

ORACLES: dict[str, str] = {
    "base_composition": f"""SELECT lang, {", ".join(
        f"sum(length(s) - length(replace(s, '{b}', '')))::BIGINT AS n_{b}" for b in "acgtn"
    )} FROM (SELECT lang, {BASES} AS s FROM documents) GROUP BY lang""",
    "reverse_complements": f"SELECT doc_id, md5(translate(reverse({BASES}), 'acgt', 'tgca')) AS rc_md5 FROM documents",
    "kmer_windows": f"""WITH {_seqs("d", "documents", "doc_id")},
{_windows("d", 7, "n >= 7")}
SELECT id AS doc_id, count(*) AS n_windows, count(*) FILTER (NOT contains(w, 'n')) AS n_valid FROM d_win GROUP BY id""",
    "canonical_kmers": f"{_documents(KmerSpec(7, False, 'text'))}\nSELECT DISTINCT c AS canonical FROM d_hash",
    "hash64_k5": _hashed(5),
    "hash64_k7": _hashed(7),
    "hash64_k15": _hashed(15),
    "emitted_hashes": _emitted(7, True),
    "emitted_hashes_k5": _emitted(5, True),
    "emitted_hashes_plain": _emitted(7, False),
    "sketch_summary": _summary(7, True),
    "sketch_summary_plain": _summary(7, False),
    "sketch_summary_k15": _summary(15, True),
    "sketch_summary_even_k": _summary(8, True),
    "sketch_rows": f"""{_documents(_K7)},
{_sketch_cte(SIZE)}
SELECT id AS doc_id, (max(rn) OVER (PARTITION BY id) - rn)::BIGINT AS rank, h::BIGINT AS hash FROM sk""",
    "sketch_overlaps": f"""{_documents(_K7)},
{_sketch_cte(SIZE)},
held AS (SELECT id, md5(string_agg(h::VARCHAR, ',' ORDER BY rn)) AS key FROM sk GROUP BY id),
named AS (SELECT id, key, min(id) OVER (PARTITION BY key) AS class_id FROM held),
pairs AS (SELECT a.id, b.id AS other, count(*) AS shared FROM sk a JOIN sk b ON a.h = b.h AND a.id <> b.id
  GROUP BY ALL HAVING count(*) >= {LEAST_SHARED}),
met AS (SELECT p.id, p.shared, n.class_id <> m.class_id AS apart, m.class_id AS other_class
  FROM pairs p JOIN named n ON n.id = p.id JOIN named m ON m.id = p.other)
SELECT n.id AS doc_id, n.class_id, count(DISTINCT m.other_class) FILTER (m.apart)::BIGINT AS n_classes,
  count(m.id)::BIGINT AS n_links, max(m.shared) FILTER (m.apart)::BIGINT AS most_shared
FROM named n LEFT JOIN met m ON m.id = n.id GROUP BY n.id, n.class_id""",
    "sketch_by_source": _by_source(7),
    "sketch_by_source_k15": _by_source(15),
    "whitelist_hashes": f"WITH {_benchmark(_K7)}\nSELECT DISTINCT h::BIGINT AS hash FROM b_emit",
    "whitelist_grown": f"""WITH {_benchmark(_K7)}
SELECT h::BIGINT AS hash, min(CASE id % 2 WHEN 0 THEN 1 ELSE 2 END)::BIGINT AS version FROM b_emit GROUP BY h""",
    "theta_by_source": f"""{_documents(_K7, ", source")},
{_benchmark(_K7)},
pairs AS (SELECT DISTINCT source, h FROM d_emit JOIN d_seqs USING (id))
SELECT source, count(*) AS n_hashes, count(*) FILTER (h IN (SELECT h FROM b_emit)) AS n_shared,
  true AS count_within, true AS shared_within, true AS either_within, true AS only_within
FROM pairs GROUP BY source""",
    "bloom_sizing": """WITH cap AS (SELECT source, sum(length(text))::BIGINT AS entries FROM documents GROUP BY source),
raw AS (SELECT *, CASE WHEN entries >= 1000 THEN -(ln(0.001::DOUBLE) / 0.480453013918201::DOUBLE) END AS bpe FROM cap),
sized AS (SELECT *, floor(entries::DOUBLE * bpe)::BIGINT AS bits FROM raw)
SELECT source, entries, round(bpe, 9) AS bpe, bits, ceil(bits::DOUBLE / 8)::BIGINT AS bytes,
  ceil(0.693147180559945::DOUBLE * bpe)::BIGINT AS hashes FROM sized""",
    "murmur_keys": f"WITH {_benchmark(_K7)}\nSELECT h AS hash, a AS hash_a, b AS hash_b FROM ({_keys('b_emit')})",
    "bloom_positions": f"WITH {_benchmark(_K7)}\nSELECT h AS hash, i, position FROM ({_positions('b_emit', FILTER)})",
    "bloom_words": f"""WITH {_benchmark(_K7)}
SELECT position // 32 AS word, bit_or((1::BIGINT << (position % 32)::INT)) AS bits
FROM ({_positions("b_emit", FILTER)}) GROUP BY 1""",
    "bloom_members": f"{_documents(_K7)},\n{_benchmark(_K7)},\n{_member_ctes('d_emit', SMALL_FILTER)}\nSELECT h AS hash FROM wl",
    "bloom_blocked": f"""{_documents(_K7)},
{_benchmark(_K7)},
bits AS (SELECT DISTINCT block, j, bit FROM ({_block_bits("b_emit")})),
asked AS ({_block_bits("d_emit")})
SELECT h AS hash, h IN (SELECT h FROM b_emit) AS in_whitelist
FROM asked JOIN bits USING (block, j, bit) GROUP BY h HAVING count(*) = 8""",
    **{name: _screen(spec) for name, spec in SCREENS.items()},
    "quarantined_reads": """SELECT doc_id, length(text) AS seq_len,
CASE WHEN length(text) <= 7 THEN 'short' ELSE 'no_kmers' END AS status
FROM documents WHERE NOT regexp_matches(text, '[A-Za-z]{7}')""",
    "fastx_records": f"""{_FASTQ_ROWS} UNION ALL
SELECT name, '', length(s), md5(s), NULL, 'ok' FROM ({_DOC_RECORDS})""",
    "fastx_damaged": f"""SELECT name, source AS comment, length(s) AS seq_len, md5(s) AS seq_md5,
CASE doc_id % 3 WHEN 0 THEN length(s) WHEN 1 THEN length(s) - 1 ELSE 0 END AS qual_len,
CASE doc_id % 3 WHEN 0 THEN 'ok' ELSE 'truncated' END AS status FROM ({_DOC_RECORDS})
UNION ALL SELECT name || 'b', source, 4, md5('acgt'), 4, 'ok' FROM ({_DOC_RECORDS})""",
    "fastx_files": _FASTQ_ROWS,
    "fastx_gzip": _FASTQ_ROWS,
    "fastx_source": _FASTQ_ROWS,
    "watched_files": _screen(WATCH_SPEC, "'d' || id AS name"),
    "watch_metrics": f"""SELECT count(*) AS reads, sum(seq_len)::BIGINT AS bases,
  count(*) FILTER (intersections > 0) AS hits, (SELECT count(*) FROM documents) - count(*) AS quarantined
FROM ({_screen(WATCH_SPEC, "id")})""",
    "file_extensions": """SELECT page_id, ext AS extension, ext IN ('fastq', 'fq') AS is_read_file FROM (
SELECT page_id, CASE WHEN length(url) - length(string_split(url, '.')[-1]) > 1 THEN string_split(url, '.')[-1] ELSE '' END
AS ext FROM pages)""",
    "event_flags": """WITH f AS (SELECT event_id // 8 AS batch, bit_or(CASE event_type WHEN 'signup' THEN 2
WHEN 'purchase' THEN 512 WHEN 'error' THEN 8 ELSE 4 END)::BIGINT AS flags FROM events GROUP BY ALL)
SELECT *, CASE WHEN flags & 514 = 514 THEN 'new_file' WHEN flags & 8 = 8 THEN 'deleted' ELSE 'modified' END AS kind
FROM f""",
    "json_scan": f"""SELECT event_id, event_id AS id, event_type AS type, user_id AS user, user_id AS user_hex,
user_id % 2 = 1 AS odd, {_K} AS k, {_USER} AS user_json, NULL::VARCHAR AS missing, 7::BIGINT AS scanned FROM events""",
    "json_walk": f"""SELECT event_id, path, name, type, md5(value) AS value_md5 FROM (
SELECT event_id, unnest([
  {{'path': '', 'name': NULL, 'type': 'object', 'value':
    '{{"id":' || event_id || ',"props":' || {_PROPS} || ',"type":"' || event_type || '","user":' || {_USER} || '}}'}},
  {{'path': '.id', 'name': 'id', 'type': 'number', 'value': event_id::VARCHAR}},
  {{'path': '.type', 'name': 'type', 'type': 'string', 'value': '"' || event_type || '"'}},
  {{'path': '.user', 'name': 'user', 'type': 'array', 'value': {_USER}}},
  {{'path': '.user[0]', 'name': '0', 'type': 'number', 'value': user_id::VARCHAR}},
  {{'path': '.user[1]', 'name': '1', 'type': 'string', 'value': '"0x' || lower(to_hex(user_id)) || '"'}},
  {{'path': '.user[2]', 'name': '2', 'type': 'object', 'value': '{{"odd":' || (user_id % 2 = 1) || '}}'}},
  {{'path': '.user[2].odd', 'name': 'odd', 'type': (user_id % 2 = 1)::VARCHAR, 'value': (user_id % 2 = 1)::VARCHAR}},
  {{'path': '.props', 'name': 'props', 'type': 'object', 'value': {_PROPS}}},
  {{'path': '.props.k', 'name': 'k', 'type': 'number', 'value': {_K}::VARCHAR}}
], recursive := true) FROM events)""",
    "json_set": f"""SELECT event_id, '{{"k":7}}' AS replaced,
'{{"k":' || {_K} || ',"t":"' || event_type || '"}}' AS added, '{{"k":' || {_K} || ',"a":{{"b":[1]}}}}' AS nested,
'{{"k":' || {_K} || ',"l":[1,2]}}' AS appended, '{{}}' AS deleted, '{{"k":' || {_K} || ',"l":[1,3]}}' AS removed
FROM events""",
    "json_entries": f"""SELECT event_id, unnest([0, 1, 2, 3])::BIGINT AS ord, unnest(['id', 'type', 'user', 'props']) AS key,
unnest([event_id::VARCHAR, '"' || event_type || '"', {_USER}, {_PROPS}]) AS value FROM events""",
    "json_elements": """SELECT event_id, unnest([0, 1, 2])::BIGINT AS idx, unnest([user_id::VARCHAR,
'"0x' || lower(to_hex(user_id)) || '"', '{"odd":' || (user_id % 2 = 1) || '}']) AS value FROM events""",
    "json_element": """SELECT event_id, '{"odd":' || (user_id % 2 = 1) || '}' AS value FROM events""",
    "json_pretty": f"""SELECT event_id, '{{' || chr(10) || '  "id": ' || event_id || ',' || chr(10) || '  "type": "' || event_type
|| '",' || chr(10) || '  "user": [' || chr(10) || '    ' || user_id || ',' || chr(10) || '    "0x' || lower(to_hex(user_id))
|| '",' || chr(10) || '    {{' || chr(10) || '      "odd": ' || (user_id % 2 = 1) || chr(10) || '    }}' || chr(10) || '  ],'
|| chr(10) || '  "props": {{' || chr(10) || '    "k": ' || {_K} || chr(10) || '  }}' || chr(10) || '}}' AS pretty FROM events""",
    "json_print": """SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","none":null,"odd":' ||
(user_id % 2 = 1) || '}' AS object, '[' || event_id || ',' || user_id || ']' AS array FROM events""",
    "json_escape": f"SELECT doc_id, md5({_escaped('text')}) AS escaped_md5, md5(text) AS back_md5 FROM documents",
    "json_binary": """SELECT doc_id, md5('"' || lower(hex(encode(text))) || '"') AS hex_md5,
md5('"' || base64(encode(text)) || '"') AS base64_md5 FROM documents""",
    # each value's start follows from the lengths of what the event's text has before it
    "json_offsets": f"""SELECT event_id, n.path AS path, n.name AS name, n.type AS type, n.at::BIGINT AS at, n.length::BIGINT AS length
FROM (SELECT event_id, unnest([
  {{'path': '.id', 'name': 'id', 'type': 'number', 'at': 7, 'length': a}},
  {{'path': '.type', 'name': 'type', 'type': 'string', 'at': 18 + a, 'length': b}},
  {{'path': '.user[0]', 'name': '0', 'type': 'number', 'at': 30 + a + b, 'length': c}},
  {{'path': '.user[1]', 'name': '1', 'type': 'string', 'at': 33 + a + b + c, 'length': 2 + d}},
  {{'path': '.user[2].odd', 'name': 'odd', 'type': odd, 'at': 46 + a + b + c + d, 'length': length(odd)}},
  {{'path': '.user[2]', 'name': '2', 'type': 'object', 'at': 38 + a + b + c + d, 'length': 9 + length(odd)}},
  {{'path': '.user', 'name': 'user', 'type': 'array', 'at': 29 + a + b, 'length': 19 + c + d + length(odd)}},
  {{'path': '.props.k', 'name': 'k', 'type': 'number', 'at': 65 + a + b + c + d + length(odd), 'length': length({_K}::VARCHAR)}},
  {{'path': '.props', 'name': 'props', 'type': 'object', 'at': 59 + a + b + c + d + length(odd), 'length': length(props)}},
  {{'path': '', 'name': NULL, 'type': 'object', 'at': 0, 'length': 60 + a + b + c + d + length(odd) + length(props)}}
]) AS n FROM (SELECT *, length(event_id::VARCHAR) AS a, length(event_type) AS b, length(user_id::VARCHAR) AS c,
length(to_hex(user_id)) AS d, (user_id % 2 = 1)::VARCHAR AS odd FROM events))""",
    "json_splice": f"""SELECT event_id, start || user_id || hexed || '{{"odd": null}}' || props_at || props || '}}' AS replaced,
start || user_id || hexed || odd || props_at || left(props, length(props) - 1) || ',"t":{{"u":[1]}}}}}}' AS added,
start || user_id || hexed || odd || ',' || event_id || props_at || props || '}}' AS appended,
start || hexed[2:] || odd || props_at || props || '}}' AS removed,
'{{"id": ' || event_id || ', "user": [' || user_id || hexed || odd || props_at || props || '}}' AS deleted
FROM (SELECT *, '{{"id": ' || event_id || ', "type": "' || event_type || '", "user": [' AS start,
', "0x' || lower(to_hex(user_id)) || '", ' AS hexed, '{{"odd": ' || (user_id % 2 = 1) || '}}' AS odd, '], "props": ' AS props_at
FROM events)""",
    "json_lenient": f"""SELECT event_id, event_type AS type, {_USER} AS user_json,
' .id .props .type .user .props.k .user[0] .user[1] .user[2] .user[2].odd' AS paths, '{{"k":7}}' AS changed,
'{{id: ' || event_id || ', type: "' || event_type || '", user: [' || user_id || ', "0x' || lower(to_hex(user_id)) || '", {{odd: '
|| (user_id % 2 = 1) || '}}], props: {{k: 7}}}}' AS spliced FROM events""",
}
