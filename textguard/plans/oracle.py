"""The registered queries once more, as plain SQL in another formulation.

Spark walks arrays; the SQL here unnests matches and uses running windows and
gaps-and-islands. The patterns are used as they stand: the engine that runs
these texts reads a ``(?U)`` prefix as "ungreedy".
"""

from __future__ import annotations

from textguard import rules
from textguard.plans import inputs


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def case_map(column: str, table: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def turns(name: str, condition: str) -> str:
    return (
        f"{name} AS (SELECT {inputs.TURN_ID} AS prompt_id, conv_id, turn, role, "
        f"{inputs.seeded_text(condition)} AS text FROM conversations)"
    )


PROMPTS = turns("prompts", "role = 'user'")
SEEDED = turns("seeded", "true")

# --- normalization -----------------------------------------------------------------
_INVISIBLE = "[" + "".join(rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}" for lo, hi in rules.INVISIBLE_RANGES) + "]"
_SPACES = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {q(_INVISIBLE)}, '', 'g')"


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {q(_SPACES)}, ' ', 'g'))"


def normalize_sql(text: str) -> str:
    # of the characters that NFKC and NFC treat differently, the rows hold only these
    wide = "".join(chr(c) for c in (0x3000, *range(0xFF01, 0xFF5F)))
    plain = "".join(chr(c) for c in (0x20, *range(0x21, 0x7F)))
    folded = f"replace(translate({strip_sql(text)}, {q(wide)}, {q(plain)}), 'ﬁ', 'fi')"
    return collapse_sql(f"lower(nfc_normalize({folded}))")


# --- match spans by unnesting -------------------------------------------------------
def spans_cte(name: str, src: str, pattern: str, text: str = "text", extra: str = "") -> str:
    """(id, i, m, s, e) of every match, positions from running lengths."""
    return f"""{name}_u AS (
  SELECT id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g{extra}
  FROM (SELECT id{extra}, regexp_extract_all({text}, {q(pattern)}) AS ms,
               string_split_regex({text}, {q(pattern)}) AS gs
        FROM {src} WHERE regexp_matches({text}, {q(pattern)}))),
{name} AS (
  SELECT id, i, m{extra},
         CAST(sum(length(g) + length(m)) OVER (PARTITION BY id ORDER BY i) - length(m) AS INT) AS s,
         CAST(sum(length(g) + length(m)) OVER (PARTITION BY id ORDER BY i) AS INT) AS e
  FROM {name}_u)"""


def luhn_sql(m: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    doubled = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 "
        f"THEN CAST(substring(reverse({d}), i, 1) AS INT) ELSE "
        f"(2 * CAST(substring(reverse({d}), i, 1) AS INT)) // 10 + "
        f"(2 * CAST(substring(reverse({d}), i, 1) AS INT)) % 10 END))"
    )
    return f"(length({d}) BETWEEN 13 AND 19 AND {doubled} % 10 = 0)"


def detector_ctes(src: str, prefix: str = "d") -> str:
    """``{prefix}_all(id, ord, kind, s, e, m)``: matches of every detector over
    ``src(id, text)``, card candidates checked."""
    parts, unions = [], []
    for ord_, kind, pattern in rules.DETECTORS:
        parts.append(spans_cte(f"{prefix}{ord_}", src, pattern))
        where = f" WHERE {luhn_sql('m')}" if kind == rules.LUHN_KIND else ""
        unions.append(
            f"SELECT id, {ord_} AS ord, {q(kind)} AS kind, s, e, m FROM {prefix}{ord_}{where}"
        )
    parts.append(f"{prefix}_all AS (" + " UNION ALL ".join(unions) + ")")
    return ",\n".join(parts)


def merged_ctes(src: str, prefix: str = "d") -> str:
    """``{prefix}_merged(id, s, e, kind, idx)`` by gaps and islands."""
    p = prefix
    return f"""{detector_ctes(src, p)},
{p}_run AS (
  SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, ord
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {p}_all),
{p}_isl AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END)
            OVER (PARTITION BY id ORDER BY s, ord) AS island
  FROM {p}_run),
{p}_merged AS (
  SELECT id, min(s) AS s, max(e) AS e, first(kind ORDER BY s, ord) AS kind,
         CAST(island - 1 AS INT) AS idx
  FROM {p}_isl GROUP BY id, island)"""


def redacted_ctes(src: str, prefix: str = "d") -> str:
    """``{prefix}_red(id, redacted, n, secret)`` for every row of ``src``."""
    p = prefix
    mask = case_map("kind", rules.MASKS)
    return f"""{merged_ctes(src, p)},
{p}_pieces AS (
  SELECT m.id, m.idx, m.s, m.e, m.kind, t.text,
         coalesce(lag(m.e) OVER (PARTITION BY m.id ORDER BY m.idx), 0) AS prev
  FROM {p}_merged m JOIN {src} t ON t.id = m.id),
{p}_joined AS (
  SELECT id, string_agg(substring(text, prev + 1, s - prev) || {mask}, '' ORDER BY idx)
               || substring(any_value(text), max(e) + 1) AS redacted,
         CAST(count(*) AS INT) AS n,
         bool_or(kind IN ('ApiKey', 'SecretKey')) AS secret
  FROM {p}_pieces GROUP BY id),
{p}_red AS (
  SELECT t.id, coalesce(j.redacted, t.text) AS redacted, coalesce(j.n, 0) AS n,
         coalesce(j.secret, false) AS secret
  FROM {src} t LEFT JOIN {p}_joined j ON j.id = t.id)"""


# --- injection ------------------------------------------------------------------------
def _escape(phrase: str) -> str:
    return "".join("\\" + c if c in "|[]<>/`.*+?(){}^$\\" and c not in "<>/`" else c for c in phrase)


KEYWORDS = "|".join(_escape(p) for p in sorted(rules.all_phrases(), key=len))
FAKE_TURN = "(?i)" + rules.FAKE_TURN_PATTERN


def injection_ctes(src: str, prefix: str = "j") -> str:
    """``{prefix}_all(id, idx, category, rule_name, s, e, space)`` over ``src(id, text)``."""
    p = prefix
    first = (
        "SELECT id, {prio} AS prio, 1 AS i, {cat} AS category, {rule} AS rule_name, "
        "CAST(length(string_split_regex(text, {rx})[1]) AS INT) AS s, "
        "CAST(length(string_split_regex(text, {rx})[1]) + length(regexp_extract(text, {rx})) AS INT) AS e, "
        "'raw' AS space FROM {src} WHERE regexp_matches(text, {rx})"
    )
    return f"""{p}_norm AS (SELECT id, {normalize_sql('text')} AS norm FROM {src}),
{spans_cte(p + '_kw', p + '_norm', KEYWORDS, 'norm')},
{p}_union AS (
  SELECT id, 1 AS prio, i, 'prompt_injection' AS category, 'keyword:' || m AS rule_name, s, e,
         'normalized' AS space FROM {p}_kw
  UNION ALL {first.format(prio=2, cat=q(rules.MALICIOUS_PAYLOAD), rule=q(rules.BASE64_RULE), rx=q(rules.BASE64_PATTERN), src=src)}
  UNION ALL {first.format(prio=3, cat=q(rules.JAILBREAK), rule=q(rules.FAKE_TURN_RULE), rx=q(FAKE_TURN), src=src)}),
{p}_all AS (
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY prio, i) - 1 AS INT) AS idx,
         category, rule_name, s, e, space FROM {p}_union)"""


def reason_sql(category: str, rule: str) -> str:
    return (
        f"CASE {category} WHEN 'prompt_injection' THEN 'Detected prompt injection pattern ''' || {rule} || '''' "
        f"WHEN 'jailbreak' THEN 'Detected jailbreak or conversation hijacking: ''' || {rule} || '''' "
        f"WHEN 'malicious_payload' THEN {q(rules.REASON_PAYLOAD)} END"
    )


def injection_first_ctes(src: str, prefix: str = "j") -> str:
    """``{prefix}_first(id, category, reason)``: the deciding finding of blocked rows."""
    p = prefix
    return f"""{injection_ctes(src, p)},
{p}_first AS (SELECT id, category, {reason_sql('category', 'rule_name')} AS reason
              FROM {p}_all WHERE idx = 0)"""


DOCS = "docs AS (SELECT doc_id AS id, text, lang, source FROM documents)"
PAGES = "pgs AS (SELECT page_id AS id, html AS text, url FROM pages)"
PR = f"{PROMPTS}, pr AS (SELECT prompt_id AS id, text, role FROM prompts)"
SD = f"{SEEDED}, sd AS (SELECT prompt_id AS id, text, role FROM seeded)"

FINDING_COLUMNS = "category, rule_name, s AS start, e AS \"end\""


def scanning_sql() -> dict[str, str]:
    category = case_map("kind", rules.KIND_CATEGORY)
    pii_verdict = (
        "CASE WHEN n = 0 THEN 'Allow' WHEN secret THEN 'Block' ELSE 'Redact' END AS action, "
        f"CASE WHEN secret THEN {q(rules.REASON_SECRET)} END AS reason, "
        "CASE WHEN secret THEN 'secret_leak' END AS category, "
        "CASE WHEN n > 0 AND NOT secret THEN redacted END AS redacted_text, "
        "CASE WHEN n > 0 AND NOT secret THEN n END AS redactions_count"
    )
    family = "CASE " + " ".join(
        f"WHEN rule_name IN ({', '.join(q('keyword:' + p) for p in ps)}) THEN {q(f)}"
        for f, ps in rules.PHRASES.items()
    ) + " ELSE replace(rule_name, 'structural:', '') END"
    return {
        "strip_invisible": f"WITH {PR} SELECT id AS prompt_id, {strip_sql('text')} AS stripped FROM pr",
        "lower_text": "SELECT doc_id, lower(text) AS lowered FROM documents",
        "collapse_whitespace": f"SELECT doc_id, {collapse_sql('text')} AS collapsed FROM documents",
        "normalize_text": f"WITH {PR} SELECT id AS prompt_id, {normalize_sql('text')} AS normalized FROM pr",
        "normalize_documents": f"SELECT doc_id, {normalize_sql('text')} AS normalized FROM documents",
        "keyword_findings": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT id AS prompt_id, idx, rule_name, s AS start, e AS "end" FROM j_all
            WHERE category = 'prompt_injection'""",
        "base64_blobs": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT id AS prompt_id, s AS start, e AS "end" FROM j_all WHERE category = 'malicious_payload'""",
        "fake_turns": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT id AS prompt_id, s AS start, e AS "end" FROM j_all WHERE category = 'jailbreak'""",
        "injection_findings": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT id AS prompt_id, idx, {FINDING_COLUMNS}, space FROM j_all""",
        "injection_verdict": f"""WITH {PR}, {injection_first_ctes('pr')}
            SELECT pr.id AS prompt_id, CASE WHEN f.id IS NULL THEN 'Allow' ELSE 'Block' END AS action,
                   f.reason, f.category, f.id IS NULL AS is_allowed
            FROM pr LEFT JOIN j_first f ON f.id = pr.id""",
        "attack_families": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT {family} AS family, count(*) AS hits, count(DISTINCT id) AS prompts
            FROM j_all GROUP BY 1""",
        "rule_hit_counts": f"""WITH {PR}, {injection_ctes('pr')}
            SELECT category, rule_name, count(*) AS hits FROM j_all GROUP BY ROLLUP (category, rule_name)""",
        "document_injection_scan": f"""WITH {DOCS}, {injection_ctes('docs')}
            SELECT d.lang, count(DISTINCT d.id) AS docs, count(j.id) AS findings,
                   count(DISTINCT j.id) AS flagged
            FROM docs d LEFT JOIN j_all j ON j.id = d.id GROUP BY d.lang""",
        "pii_detector_spans": f"""WITH {PR}, {detector_ctes('pr')}
            SELECT id AS prompt_id, ord, kind, s AS start, e AS "end" FROM d_all""",
        "document_detector_spans": f"""WITH {DOCS}, {detector_ctes('docs')}
            SELECT id AS doc_id, ord, kind, s AS start, e AS "end" FROM d_all""",
        "luhn_cards": f"""WITH {DOCS}, {spans_cte('c', 'docs', rules.DETECTORS[3][2])}
            SELECT id AS doc_id, m AS candidate, {luhn_sql('m')} AS valid FROM c""",
        "pii_merged_spans": f"""WITH {PR}, {merged_ctes('pr')}
            SELECT id AS prompt_id, idx, s AS start, e AS "end", kind FROM d_merged""",
        "pii_redact": f"""WITH {DOCS}, {redacted_ctes('docs')}
            SELECT id AS doc_id, redacted, n AS redactions FROM d_red""",
        "pii_redact_prompts": f"""WITH {PR}, {redacted_ctes('pr')}
            SELECT id AS prompt_id, redacted, n AS redactions FROM d_red""",
        "pii_redact_pages": f"""WITH {PAGES}, {redacted_ctes('pgs')}
            SELECT id AS page_id, redacted, n AS redactions FROM d_red""",
        "pii_findings": f"""WITH {DOCS}, {merged_ctes('docs')}
            SELECT m.id AS doc_id, idx, {category} AS category, kind AS rule_name, s AS start, e AS "end",
                   CAST(strlen(substring(text, 1, s)) AS INT) AS start_byte,
                   CAST(strlen(substring(text, 1, e)) AS INT) AS end_byte
            FROM d_merged m JOIN docs ON docs.id = m.id""",
        "pii_verdict": f"WITH {PR}, {redacted_ctes('pr')} SELECT id AS prompt_id, {pii_verdict} FROM d_red",
        "pii_summary": f"""WITH {DOCS}, {merged_ctes('docs')}
            SELECT lang, source, kind, count(*) AS findings
            FROM d_merged m JOIN docs ON docs.id = m.id GROUP BY CUBE (lang, source, kind)""",
        "pii_categories": f"""WITH {PR}, {merged_ctes('pr')}
            SELECT kind, {category} AS category, {case_map('kind', rules.MASKS)} AS mask, count(*) AS findings
            FROM d_merged GROUP BY kind""",
        "verdict_mix": f"""WITH {PR}, {injection_first_ctes('pr')}, {redacted_ctes('pr')}
            SELECT pr.role, CASE WHEN f.id IS NOT NULL THEN 'blocked' WHEN d.n > 0 THEN 'redacted'
                        ELSE 'clean' END AS verdict, count(*) AS n
            FROM pr JOIN d_red d ON d.id = pr.id LEFT JOIN j_first f ON f.id = pr.id GROUP BY 1, 2""",
        "simple_prompt_guard": f"""WITH {PR}, {injection_first_ctes('pr')}, {redacted_ctes('pr')}, v AS (
              SELECT pr.id, pr.text, f.id IS NOT NULL AS attack, f.reason AS jr, f.category AS jc,
                     d.n, d.secret, d.redacted
              FROM pr JOIN d_red d ON d.id = pr.id LEFT JOIN j_first f ON f.id = pr.id)
            SELECT id AS prompt_id,
                   CASE WHEN attack OR secret THEN 'Block' WHEN n > 0 THEN 'Redact' ELSE 'Allow' END AS action,
                   CASE WHEN attack THEN jr WHEN secret THEN {q(rules.REASON_SECRET)} END AS reason,
                   CASE WHEN attack THEN jc WHEN secret THEN 'secret_leak' END AS category,
                   CASE WHEN attack OR secret THEN NULL WHEN n > 0 THEN redacted ELSE text END AS sanitized
            FROM v""",
    }


# --- streamed responses -----------------------------------------------------------------
def _line(piece: str) -> str:
    return f"""'data: ' || CAST(json_object('choices', json_array(json_object('delta', json_object('content', {piece})))) AS VARCHAR)"""


CHUNKS = f"""{SEEDED},
pieces AS (
  SELECT prompt_id AS stream_id, CAST(i AS BIGINT) AS seq,
         substring(text, {inputs.CHUNK_CHARS} * i + 1, {inputs.CHUNK_CHARS}) AS piece
  FROM (SELECT prompt_id, text,
               unnest(range(0, CAST(ceil(length(text) / {inputs.CHUNK_CHARS}.0) AS INT))) AS i
        FROM seeded WHERE length(text) > 0)),
parted AS (
  SELECT *, {inputs.TWO_LINES} AND length(piece) > 7 AS two FROM pieces),
chunks AS (
  SELECT stream_id, seq, stream_id % 37 = 3 AND seq = 4 AS transport_error,
         CASE WHEN seq = 0 THEN ': ping' || chr(10) ELSE '' END
         || CASE WHEN two THEN {_line('substring(piece, 1, 7)')} || chr(10) || {_line('substring(piece, 8)')}
            ELSE {_line('piece')} END
         || chr(10) || chr(10) || CASE WHEN seq % 5 = 4 THEN 'data: [DONE]' || chr(10) || chr(10) ELSE '' END AS chunk
  FROM parted),
lost AS (
  SELECT prompt_id AS stream_id, CAST(NULL AS BIGINT) AS seq, 'unscanned' AS status, CAST(NULL AS VARCHAR) AS chunk
  FROM (SELECT prompt_id, text, prompt_id AS stream_id FROM seeded) WHERE {inputs.LOST_ERROR} AND length(text) > 0),
lines AS (
  SELECT stream_id, seq, unnest(string_split(chunk, chr(10))) AS line, unnest(range(0, len(string_split(chunk, chr(10))))) AS place
  FROM chunks WHERE NOT transport_error),
deltas AS (
  SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id, seq ORDER BY place) - 1 AS INT) AS line,
         json_extract_string(substring(line, 6), '$.choices[0].delta.content') AS delta
  FROM lines WHERE starts_with(line, 'data:') AND trim(substring(line, 6)) NOT IN ('', '[DONE]')),
cum AS (
  SELECT stream_id, seq, line, delta,
         sum(length(delta)) OVER (PARTITION BY stream_id ORDER BY seq, line) AS upto,
         string_agg(delta, '' ORDER BY seq, line) OVER (PARTITION BY stream_id) AS full_text
  FROM deltas),
win AS (
  SELECT stream_id, seq, line, delta,
         substring(full_text, CAST(greatest(upto - length(delta) - 200, 0) + 1 AS BIGINT),
                   CAST(least(upto - length(delta), 200) + length(delta) AS BIGINT)) AS scan
  FROM cum),
wn AS (SELECT (stream_id * 1000000 + seq) * 10 + line AS id, scan AS text FROM win)"""

STREAM_ENDS = f"""{CHUNKS}, {injection_first_ctes('wn')}, {redacted_ctes('wn')},
hits AS (
  SELECT d.id // 10000000 AS stream_id, d.id // 10 % 1000000 AS seq, CAST(d.id % 10 AS INT) AS line, 'killed' AS status,
         CASE WHEN d.secret THEN {q(rules.REASON_SECRET)} ELSE f.reason END AS reason,
         CASE WHEN d.secret THEN 'secret_leak' ELSE f.category END AS category
  FROM d_red d LEFT JOIN j_first f ON f.id = d.id WHERE d.secret OR f.id IS NOT NULL
  UNION ALL
  SELECT stream_id, seq, -1, 'upstream_error', NULL, NULL FROM chunks WHERE transport_error),
ends AS (
  SELECT stream_id, seq AS end_seq, line AS end_line, status, reason, category
  FROM hits QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq, line) = 1)"""


def stream_sql() -> dict[str, str]:
    delayed, last_early = inputs.DELAYED, (inputs.LOG_PARTS - 1) * inputs.PART_CHUNKS - 1
    head, tail = (q(x).replace("\n", "' || chr(10) || '") for x in rules.STREAM_ERROR_FRAME.split("%s"))
    return {
        "sse_deltas": f"WITH {CHUNKS} SELECT stream_id, seq, line, delta FROM deltas",
        "stream_windows": f"WITH {CHUNKS} SELECT stream_id, seq, line, scan FROM win",
        "stream_decisions": f"""WITH {STREAM_ENDS}
            SELECT d.stream_id, d.seq, d.line,
                   CASE WHEN (d.seq, d.line) >= (e.end_seq, e.end_line) THEN 'Kill' ELSE 'Pass' END AS decision,
                   CASE WHEN (d.seq, d.line) = (e.end_seq, e.end_line) THEN reason
                        WHEN (d.seq, d.line) > (e.end_seq, e.end_line) THEN {q(rules.REASON_TERMINATED)} END AS reason,
                   CASE WHEN (d.seq, d.line) = (e.end_seq, e.end_line) THEN category
                        WHEN (d.seq, d.line) > (e.end_seq, e.end_line) THEN 'secret_leak' END AS category
            FROM deltas d LEFT JOIN (SELECT * FROM ends WHERE status = 'killed') e ON e.stream_id = d.stream_id""",
        "stream_output": f"""WITH {STREAM_ENDS}
            SELECT c.stream_id, c.seq, CASE WHEN c.seq = e.end_seq THEN e.status ELSE 'pass' END AS status,
                   CASE WHEN e.end_seq IS NULL OR c.seq < e.end_seq THEN c.chunk
                        WHEN e.status = 'killed' THEN {head} || e.reason || {tail} END AS chunk
            FROM chunks c LEFT JOIN ends e ON e.stream_id = c.stream_id
            WHERE e.end_seq IS NULL OR c.seq <= e.end_seq
            UNION ALL SELECT * FROM lost""",
        "stream_kills": f"WITH {STREAM_ENDS} SELECT * FROM ends",
        "stream_summary": f"""WITH {STREAM_ENDS}
            SELECT coalesce(e.status, 'completed') AS status, e.category, count(*) AS streams
            FROM (SELECT DISTINCT stream_id FROM chunks) c LEFT JOIN ends e ON e.stream_id = c.stream_id
            GROUP BY 1, 2""",
        "stream_late_counts": f"""WITH {STREAM_ENDS.replace("FROM parted)", f"FROM parted WHERE NOT ({delayed}))")},
            late AS (
              SELECT 'after_end' AS status, c.stream_id FROM chunks c JOIN ends e ON e.stream_id = c.stream_id AND c.seq > e.end_seq
              UNION ALL
              SELECT CASE WHEN e.end_seq IS NULL THEN 'out_of_order' ELSE 'after_end' END, p.stream_id
              FROM parted p JOIN (SELECT stream_id, count(*) AS n, max(seq) AS top FROM parted GROUP BY 1) t USING (stream_id)
              LEFT JOIN ends e ON e.stream_id = p.stream_id AND e.end_seq <= least(t.top, {last_early})
              WHERE {delayed} AND t.top > 1)
            SELECT status, count(DISTINCT stream_id) AS streams, CAST(count(*) AS BIGINT) AS chunks FROM late GROUP BY 1""",
    }


# --- requests -----------------------------------------------------------------------------
REQUEST_ID = f"coalesce({inputs.HEADER_ID}, 'req-' || lpad(CAST(prompt_id AS VARCHAR), 10, '0'))"
_TOOLS_OK = [t.strip() for t in inputs.ALLOWED_TOOLS.split(",") if t.strip()]
_ROLE_LIST = ", ".join(q(r) for r in rules.ROLES)

REQUESTS = f"""{PROMPTS},
bodies AS (
  SELECT prompt_id AS id, {REQUEST_ID} AS request_id, {inputs.AUTH_OK} AS auth_ok,
         ({inputs.BODY_HEAD}) || CASE WHEN {inputs.BODY_HAS_MESSAGE}
           THEN CAST(json_object('role', 'user', 'content', text) AS VARCHAR) ELSE '' END
         || ({inputs.BODY_TAIL}) AS body
  FROM prompts),
req AS (SELECT id, request_id, auth_ok, json_valid(body) AS readable,
               CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM bodies),
raw_msgs AS (
  SELECT id, unnest(range(0, CAST(json_array_length(j, '$.messages') AS BIGINT))) AS idx, j
  FROM req WHERE json_type(j, '$.messages') = 'ARRAY'),
msgs AS (
  SELECT id, CAST(idx AS INT) AS idx, json_extract(j, '$.messages[' || idx || ']') AS m FROM raw_msgs),
msgf AS (
  SELECT id, idx, CASE WHEN json_type(m, '$.role') = 'VARCHAR' THEN json_extract_string(m, '$.role') END AS role,
         json_type(m, '$.content') AS ctype,
         CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN json_extract_string(m, '$.content') END AS content
  FROM msgs),
raw_tools AS (
  SELECT id, unnest(range(0, CAST(json_array_length(j, '$.tools') AS BIGINT))) AS idx, j
  FROM req WHERE json_type(j, '$.tools') = 'ARRAY'),
tools AS (
  SELECT id, CAST(idx AS INT) AS idx,
         json_extract_string(j, '$.tools[' || idx || '].type') AS type,
         CASE WHEN json_type(j, '$.tools[' || idx || '].function.name') = 'VARCHAR'
              THEN json_extract_string(j, '$.tools[' || idx || '].function.name') END AS name
  FROM raw_tools),
tool_err AS (
  SELECT id, first(msg ORDER BY idx) AS msg, first(denied ORDER BY idx) AS denied FROM (
    SELECT id, idx, CASE WHEN type IS DISTINCT FROM 'function' THEN {q(rules.MSG_TOOL_TYPE)}
                    WHEN name IS NULL THEN {q(rules.MSG_TOOL_NAME)}
                    WHEN name NOT IN ({', '.join(q(t) for t in _TOOLS_OK)})
                      THEN 'Tool ''' || name || ''' is not in the allowed tools list' END AS msg,
           type = 'function' AND name IS NOT NULL AS denied
    FROM tools) WHERE msg IS NOT NULL GROUP BY id
  UNION ALL
  SELECT id, {q(rules.MSG_TOOLS_ARRAY)}, false FROM req
  WHERE json_type(j, '$.tools') IS NOT NULL AND json_type(j, '$.tools') <> 'ARRAY'),
msg_first AS (
  SELECT id, first(msg ORDER BY idx) AS msg FROM (
    SELECT id, idx, CASE WHEN role IS NULL OR role NOT IN ({_ROLE_LIST})
                           THEN 'Message at index ' || idx || ' has an invalid or missing role'
                         WHEN ctype IS NULL THEN 'Message at index ' || idx || ' is missing content' END AS msg
    FROM msgf) WHERE msg IS NOT NULL GROUP BY id),
msg_err AS (
  SELECT r.id, CASE WHEN json_type(r.j) <> 'OBJECT' THEN {q(rules.MSG_OBJECT)}
                    WHEN coalesce(json_type(r.j, '$.messages'), '') <> 'ARRAY'
                      OR json_array_length(r.j, '$.messages') = 0 THEN {q(rules.MSG_MESSAGES)}
                    ELSE f.msg END AS msg
  FROM req r LEFT JOIN msg_first f ON f.id = r.id WHERE r.readable),
model AS (
  SELECT id, coalesce(nullif(CASE WHEN json_type(j, '$.model') = 'VARCHAR'
                                  THEN json_extract_string(j, '$.model') END, ''), {q(rules.DEFAULT_MODEL)}) AS model,
         coalesce(json_type(j, '$.stream') = 'BOOLEAN' AND json_extract_string(j, '$.stream') = 'true', false) AS streaming
  FROM req WHERE readable)"""

# allowlist: upstream, retrieval or both
def _decided(upstream_ok: bool, rag_ok: bool) -> str:
    governance = "NULL" if upstream_ok else q(rules.MSG_GOVERNANCE % (rules.CAT_NETWORK, inputs.BASE_URL))
    rag = "NULL" if rag_ok else q(rules.MSG_GOVERNANCE % (rules.CAT_RAG, rules.RAG_TARGET))
    return f"""{REQUESTS},
ruled AS (
  SELECT r.id, r.request_id, r.readable,
         CASE WHEN NOT readable THEN 'bad_request' WHEN NOT auth_ok THEN 'security_blocked'
              WHEN {governance} IS NOT NULL THEN 'security_blocked'
              WHEN t.msg IS NOT NULL THEN CASE WHEN t.denied THEN 'security_blocked' ELSE 'bad_request' END
              WHEN m.msg IS NOT NULL THEN 'bad_request' END AS kind,
         CASE WHEN NOT readable THEN 'Request body must be valid JSON' WHEN NOT auth_ok THEN {q(rules.MSG_AUTH)}
              WHEN {governance} IS NOT NULL THEN {governance}
              ELSE coalesce(t.msg, m.msg) END AS message,
         CASE WHEN NOT readable THEN NULL WHEN NOT auth_ok THEN 'Authentication'
              WHEN {governance} IS NOT NULL THEN 'NetworkAccess'
              WHEN t.denied THEN 'ToolExecution' END AS category
  FROM req r LEFT JOIN tool_err t ON t.id = r.id LEFT JOIN msg_err m ON m.id = r.id),
mtext AS (
  SELECT f.id * 1000 + f.idx AS id, f.content AS text FROM msgf f JOIN ruled r ON r.id = f.id
  WHERE r.kind IS NULL AND f.content IS NOT NULL),
{injection_first_ctes('mtext')},
{redacted_ctes('mtext')},
attack AS (
  SELECT id // 1000 AS id, CAST(min(id % 1000) AS INT) AS blocked_index,
         first(reason ORDER BY id) AS reason, first(category ORDER BY id) AS category
  FROM j_first GROUP BY 1),
inbound AS (
  SELECT d.id // 1000 AS id, count(*) AS n FROM d_red d LEFT JOIN attack a ON a.id = d.id // 1000
  WHERE d.n > 0 AND (a.id IS NULL OR d.id % 1000 <= a.blocked_index) GROUP BY 1),
unscanned AS (SELECT id, count(*) AS n FROM msgf WHERE content IS NULL GROUP BY id),
decided AS (
  SELECT r.id, r.request_id, r.readable, r.kind IS NULL AS ruled_ok,
         coalesce(r.kind, CASE WHEN a.id IS NOT NULL OR {rag} IS NOT NULL THEN 'security_blocked' END) AS kind,
         coalesce(r.message, a.reason, {rag}) AS message,
         CASE WHEN r.kind IS NOT NULL THEN r.category
              WHEN a.id IS NOT NULL THEN CASE a.category WHEN 'prompt_injection' THEN 'PromptInjection'
                WHEN 'jailbreak' THEN 'Jailbreak' ELSE 'MaliciousPayload' END
              WHEN {rag} IS NOT NULL THEN 'RagPipeline' END AS category,
         a.id IS NOT NULL AS injection_detected, a.blocked_index,
         CAST(coalesce(i.n, 0) AS INT) AS inbound_redactions,
         CASE WHEN r.kind IS NULL THEN CAST(coalesce(u.n, 0) AS INT) ELSE 0 END AS unscanned,
         CASE WHEN r.kind IS NULL THEN model END AS model,
         CASE WHEN r.kind IS NULL THEN streaming END AS streaming
  FROM ruled r LEFT JOIN attack a ON a.id = r.id LEFT JOIN inbound i ON i.id = r.id
  LEFT JOIN unscanned u ON u.id = r.id LEFT JOIN model ON model.id = r.id)"""


DECIDED = _decided(True, True)
CODE = "CASE kind WHEN 'bad_request' THEN 400 WHEN 'security_blocked' THEN 403 END"


def policy_sql() -> dict[str, str]:
    host = "lower(regexp_extract(u, '^[A-Za-z]+://(\\[[^]]*\\]|[^/:]*)', 1))"
    scheme = "lower(regexp_extract(u, '^([A-Za-z]+):', 1))"
    base = (
        f"CASE WHEN {scheme} NOT IN ('http', 'https') THEN 'Unsupported URL scheme: ''' || {scheme} || "
        "'''. Only http and https are allowed.' "
        f"WHEN {host} LIKE '169.254.%' OR {host} = 'metadata.google.internal' "
        f"THEN 'Access to cloud metadata address ''' || {host} || ''' is strictly prohibited' "
    )

    def planted(strict: bool) -> str:
        """Expected reasons, written down with the planted URLs."""
        cases = ""
        for n, (_, blocked, local) in enumerate(inputs.URL_CASES):
            if blocked and not local:
                reason = f"Access to cloud metadata address '{blocked}' is strictly prohibited"
            elif blocked and strict:
                reason = f"Access to localhost '{blocked}' is disabled in current configuration"
            else:
                continue
            cases += f" WHEN {n} THEN {q(reason)}"
        return f"CASE page_id % {len(inputs.URL_CASES)}{cases} END"

    limited = """
        WITH RECURSIVE ev AS (
          SELECT event_id, {key} AS k, ts, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
        walk AS (
          SELECT k, rn, event_id, [ts] AS log, true AS accepted FROM ev WHERE rn = 1
          UNION ALL
          SELECT e.k, e.rn, e.event_id,
                 CASE WHEN len(list_filter(w.log, lambda t: t > e.ts - INTERVAL {window} SECOND)) < {limit}
                      THEN list_append(list_filter(w.log, lambda t: t > e.ts - INTERVAL {window} SECOND), e.ts)
                      ELSE list_filter(w.log, lambda t: t > e.ts - INTERVAL {window} SECOND) END,
                 len(list_filter(w.log, lambda t: t > e.ts - INTERVAL {window} SECOND)) < {limit}
          FROM walk w JOIN ev e ON e.k = w.k AND e.rn = w.rn + 1)
        SELECT event_id, {out}accepted FROM walk"""
    code = {k: c for k, (c, _t) in rules.ERRORS.items()}
    type_ = {k: t for k, (_c, t) in rules.ERRORS.items()}
    code_case = "CASE kind" + "".join(f" WHEN {q(k)} THEN {c}" for k, c in code.items()) + " END"
    message = f"CASE kind WHEN 'rate_limited' THEN {q(rules.MSG_RATE_LIMIT)} ELSE 'event ' || event_id END"
    return {
        "chat_requests": f"""WITH {REQUESTS} SELECT request_id, readable,
              json_type(j) IS NOT NULL AND json_type(j) = 'OBJECT' AS is_object,
              CASE WHEN json_type(j, '$.model') = 'VARCHAR' THEN json_extract_string(j, '$.model') END AS model,
              CASE WHEN json_type(j, '$.messages') = 'ARRAY' THEN CAST(json_array_length(j, '$.messages') AS INT) END AS n_messages,
              CASE WHEN json_type(j, '$.tools') = 'ARRAY' THEN CAST(json_array_length(j, '$.tools') AS INT) END AS n_tools
            FROM req""",
        "message_validation": f"""WITH {REQUESTS} SELECT request_id, CASE WHEN msg IS NOT NULL THEN 400 END AS code,
              msg AS message FROM msg_err JOIN req ON req.id = msg_err.id""",
        "default_model": f"WITH {REQUESTS} SELECT request_id, model FROM model JOIN req ON req.id = model.id",
        "tool_shape": f"""WITH {REQUESTS}, e AS (
              SELECT id, CASE WHEN type IS DISTINCT FROM 'function' THEN {q(rules.MSG_TOOL_TYPE)}
                     WHEN name IS NULL THEN {q(rules.MSG_TOOL_NAME)} END AS msg, idx FROM tools
              UNION ALL SELECT id, {q(rules.MSG_TOOLS_ARRAY)}, 0 FROM req
              WHERE json_type(j, '$.tools') IS NOT NULL AND json_type(j, '$.tools') <> 'ARRAY')
            SELECT request_id, f.msg AS message FROM req LEFT JOIN (
              SELECT id, first(msg ORDER BY idx) AS msg FROM e WHERE msg IS NOT NULL GROUP BY id) f ON f.id = req.id""",
        "tool_allowlist": f"""WITH {REQUESTS}, allowed AS (
              SELECT trim(t) AS name FROM (SELECT unnest(string_split({q(inputs.ALLOWED_TOOLS)}, ',')) AS t) WHERE trim(t) <> '')
            SELECT request_id, idx, name, 'Tool ''' || name || ''' is not in the allowed tools list' AS reason
            FROM tools JOIN req ON req.id = tools.id
            WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM allowed)""",
        "governance_targets": f"""WITH t AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/]+)', 2) AS target FROM pages)
            SELECT page_id, target, CASE WHEN target NOT IN (SELECT target FROM t WHERE starts_with(url, 'https://'))
              THEN 'Blocked McpServer request to ''' || target || ''' by default‑deny policy' END AS error FROM t""",
        "url_policy": f"""WITH s AS (SELECT page_id, url AS u FROM pages)
            SELECT page_id, false AS planted, {base} END AS reason,
              {base} WHEN {host} IN ('localhost', '[::1]') OR {host} LIKE '127.%'
                THEN 'Access to localhost ''' || {host} || ''' is disabled in current configuration' END AS strict_reason
            FROM s UNION ALL
            SELECT page_id, true, {planted(False)}, {planted(True)} FROM pages""",
        "rate_limit_by_user": limited.format(key="user_id", window=86400, limit=3, out="k AS user_id, "),
        "rate_limit_global": limited.format(key="0", window=3600, limit=20, out=""),
        "error_envelopes": f"""WITH e AS (SELECT event_id, event_type, {inputs.ERROR_KIND} AS kind FROM events),
            f AS (SELECT *, {code_case} AS code, {case_map('kind', type_)} AS type, {message} AS message FROM e WHERE kind IS NOT NULL)
            SELECT event_id, code, type, '{{"error":{{"message":"' || message || '","type":"' || type || '","code":' || code
              || CASE WHEN kind = 'security_blocked'
                 THEN ',"category":"' || upper(substring(event_type, 1, 1)) || substring(event_type, 2) || '"' ELSE '' END
              || '}}}}' AS body FROM f""",
        "empty_prompts": f"""WITH {PROMPTS}, b AS (SELECT prompt_id, {inputs.BLANK_PROMPT} AS p FROM prompts)
            SELECT prompt_id, CASE WHEN trim({collapse_sql('p')}) = '' THEN {q(rules.MSG_EMPTY_PROMPT)} END AS message FROM b""",
        "request_decisions": f"""WITH {DECIDED} SELECT request_id, kind, {CODE} AS code, message, category, model,
              streaming, injection_detected, blocked_index, inbound_redactions, unscanned FROM decided""",
        "rag_gate": f"WITH {_decided(True, False)} SELECT category, count(*) AS requests FROM decided GROUP BY category",
        "governance_default_deny": f"""WITH {_decided(False, True)}
            SELECT message, count(*) AS requests FROM decided GROUP BY message""",
        "sanitized_requests": f"""WITH {DECIDED} SELECT d.request_id, m.idx, m.role,
              coalesce(r.redacted, m.content) AS content
            FROM decided d JOIN msgf m ON m.id = d.id LEFT JOIN d_red r ON r.id = m.id * 1000 + m.idx
            WHERE d.kind IS NULL""",
        "upstream_bodies": f"""WITH {DECIDED} SELECT d.request_id,
              CASE WHEN json_type(r.j, '$.model') IS NULL OR json_extract_string(r.j, '$.model') = ''
                THEN {q(rules.DEFAULT_MODEL)} ELSE json_extract_string(r.j, '$.model') END AS model,
              CAST(json_array_length(r.j, '$.messages') AS INT) AS n_messages
            FROM decided d JOIN req r ON r.id = d.id WHERE d.kind IS NULL""",
        "response_redaction": f"""WITH {SD}, {redacted_ctes('sd')}, p AS (SELECT id AS prompt_id, * FROM d_red)
            SELECT {REQUEST_ID} AS request_id, {inputs.STATUS} AS status,
              CASE WHEN {inputs.STATUS} = 200 AND n > 0 THEN 1 ELSE 0 END AS redacted_choices,
              CASE WHEN {inputs.STATUS} = 200 THEN CAST(n AS BIGINT) ELSE 0 END AS response_findings,
              CASE WHEN {inputs.STATUS} = 200 THEN redacted ELSE t.text END AS content
            FROM p JOIN sd t ON t.id = p.id WHERE {inputs.HAS_RESPONSE}""",
        "simple_chat_replies": f"""WITH {SD}, {redacted_ctes('sd')}, p AS (SELECT id AS prompt_id, * FROM d_red)
            SELECT {REQUEST_ID} AS request_id, CASE WHEN {inputs.STATUS} <> 200 THEN 502 END AS code,
              CASE WHEN {inputs.STATUS} = 200 THEN redacted END AS response,
              CASE WHEN {inputs.STATUS} = 200 THEN redacted ELSE '' END AS raw_content,
              CASE WHEN {inputs.STATUS} = 200 THEN n ELSE 0 END AS redactions
            FROM p WHERE {inputs.HAS_RESPONSE}""",
        "simple_chat_requests": f"""WITH {PROMPTS}, sp AS (
              SELECT prompt_id AS id, {inputs.BLANK_PROMPT} AS text, {inputs.AUTH_OK} AS auth_ok FROM prompts),
            {injection_first_ctes('sp')}, {redacted_ctes('sp')}, x AS (
              SELECT s.id, s.text, CASE WHEN {collapse_sql('s.text')} = '' THEN 1 WHEN NOT auth_ok THEN 2
                     WHEN f.id IS NOT NULL THEN 3 WHEN d.secret THEN 4 END AS step, f.reason, f.category, d.n, d.redacted
              FROM sp s JOIN d_red d ON d.id = s.id LEFT JOIN j_first f ON f.id = s.id)
            SELECT id AS prompt_id, CASE WHEN step = 1 THEN 400 WHEN step > 1 THEN 403 END AS code,
              CASE step WHEN 1 THEN {q(rules.MSG_EMPTY_PROMPT)} WHEN 2 THEN {q(rules.MSG_AUTH)} WHEN 3 THEN reason
                        WHEN 4 THEN {q(rules.REASON_SECRET)} END AS message,
              CASE step WHEN 2 THEN 'Authentication' WHEN 3 THEN CASE category WHEN 'prompt_injection' THEN 'PromptInjection'
                WHEN 'jailbreak' THEN 'Jailbreak' ELSE 'MaliciousPayload' END WHEN 4 THEN 'SecretLeak' END AS category,
              CASE WHEN id % 3 = 0 THEN 'm9' ELSE {q(rules.DEFAULT_MODEL)} END AS model,
              CASE WHEN step IS NULL THEN CASE WHEN n > 0 THEN redacted ELSE text END END AS final_prompt
            FROM x""",
    }


# --- audit, metrics and latency ------------------------------------------------------------
# the stream CTEs reuse names of the request CTEs: rename their scan prefixes
_STREAM_CTES = STREAM_ENDS.replace(SEEDED + ",", "", 1)
for _cte in ("d", "j"):
    _STREAM_CTES = _STREAM_CTES.replace(f"{_cte}_", f"s{_cte}_")
for _n in range(1, 9):
    _STREAM_CTES = _STREAM_CTES.replace(f"d{_n}", f"sd{_n}")
CHAT = f"""{DECIDED}, {SEEDED}, {_STREAM_CTES},
rsrc AS (SELECT prompt_id AS id, text FROM seeded),
{redacted_ctes('rsrc', 'r')},
chat AS (
  SELECT d.*, kind IS NULL AS reached, d.id AS prompt_id,
         d.id % 43 = 5 AND kind IS NULL AS no_answer,
         CASE d.id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection refused' ELSE 'no upstream response' END AS failure,
         CASE WHEN kind IS NULL AND (d.id % 43 <> 5 OR d.id % 3 < 2) THEN d.id * 7919 % 900 + 100 ELSE 0 END AS latency,
         -- something is found for every request that has a user message
         kind IS NULL AND EXISTS (SELECT 1 FROM msgf m WHERE m.id = d.id AND m.role = 'user' AND m.content IS NOT NULL)
           AND EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL) AS found,
         CASE WHEN kind IS NULL AND NOT streaming AND d.id % 43 <> 5 AND d.id % 31 <> 0 THEN r.n ELSE 0 END AS findings,
         kind IS NULL AND streaming AND d.id % 43 <> 5 AND d.id % 31 <> 0
           AND coalesce(e.status = 'killed', false) AS stream_killed
  FROM decided d JOIN r_red r ON r.id = d.id LEFT JOIN ends e ON e.stream_id = d.id),
audit AS (
  SELECT strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id * 7), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         request_id, '/v1/chat/completions' AS endpoint, coalesce(model, '') AS model,
         coalesce(streaming, false) AS streaming, injection_detected, findings > 0 AS pii_redacted,
         CAST(findings AS BIGINT) AS pii_findings_count, stream_killed, found AS rag_retrieval_performed,
         CAST(latency AS BIGINT) AS upstream_latency_us, CAST(0 AS BIGINT) AS scan_latency_us,
         CASE WHEN injection_detected THEN 'blocked_security' WHEN kind = 'security_blocked' THEN 'blocked_policy'
              WHEN no_answer THEN 'upstream_error' WHEN stream_killed THEN 'stream_killed' ELSE 'allowed' END AS outcome,
         CASE WHEN injection_detected THEN message
              WHEN category = 'ToolExecution' THEN replace(message, ' in the allowed tools list', ' allowed')
              WHEN kind IS NOT NULL THEN 'Security policy violation: ' || message
              WHEN no_answer THEN failure END AS block_reason
  FROM chat WHERE kind IS NULL OR kind <> 'bad_request')"""

_COUNTERS = """CAST(count_if(readable) AS BIGINT) AS requests, CAST(count_if(injection_detected) AS BIGINT) AS injection_blocks,
  CAST(count_if(coalesce(kind = 'security_blocked', false) AND NOT injection_detected) AS BIGINT) AS policy_blocks,
  CAST(count_if(findings > 0) AS BIGINT) AS pii_redactions, CAST(sum(inbound_redactions) AS BIGINT) AS inbound_pii_redactions,
  CAST(count_if(stream_killed) AS BIGINT) AS stream_kills, CAST(count_if(found) AS BIGINT) AS rag_retrievals,
  CAST(coalesce(sum(latency) FILTER (reached AND NOT no_answer), 0) AS BIGINT) AS upstream_latency_us,
  CAST(count_if(reached AND NOT no_answer) AS BIGINT) AS upstream_latency_samples,
  CAST(coalesce(sum(latency) FILTER (reached AND NOT no_answer) // nullif(count_if(reached AND NOT no_answer), 0), 0) AS BIGINT)
    AS upstream_latency_mean_us"""


def audit_sql() -> dict[str, str]:
    lines = []
    for i, (column, name, kind, help_) in enumerate(rules.METRICS):
        lines.append(f"SELECT {3 * i} AS pos, {q(f'# HELP {name} {help_}')} AS line FROM c")
        lines.append(f"SELECT {3 * i + 1}, {q(f'# TYPE {name} {kind}')} FROM c")
        lines.append(f"SELECT {3 * i + 2}, '{name} ' || {column} FROM c")
    pick = ", ".join(
        f"CAST(list_sort(list(v))[CAST(floor(count(*) * {p}) AS BIGINT) + 1] AS BIGINT) AS p{round(p * 100)}_us"
        for p in (0.50, 0.90, 0.95, 0.99)
    )
    return {
        "audit_records": f"WITH {CHAT} SELECT * FROM audit",
        "upstream_failures": f"""WITH {CHAT} SELECT request_id, CASE failure WHEN 'timeout' THEN 504 ELSE 502 END AS code,
              CASE failure WHEN 'timeout' THEN 'gateway_timeout' ELSE 'bad_gateway' END AS type,
              CASE failure WHEN 'timeout' THEN {q(rules.MSG_TIMEOUT)} ELSE {q(rules.MSG_CONNECTION)} || failure END AS message
            FROM chat WHERE no_answer""",
        "gateway_counters": f"WITH {CHAT} SELECT {_COUNTERS} FROM chat",
        "prometheus_text": f"WITH {CHAT}, c AS (SELECT {_COUNTERS} FROM chat) " + " UNION ALL ".join(lines),
        "metrics_windows": f"""WITH {CHAT} SELECT
              strftime(date_trunc('minute', TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id * 7)), '%Y-%m-%d %H:%M:%S')
                AS window_start, {_COUNTERS} FROM chat GROUP BY 1""",
        "outcome_breakdown": f"""WITH {CHAT} SELECT outcome, endpoint, model, count(*) AS requests
            FROM audit GROUP BY ROLLUP (outcome, endpoint, model)""",
        "latency_sketches": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, true AS p50_us_near,
            true AS p90_us_near, true AS p95_us_near, true AS p99_us_near FROM events GROUP BY 1""",
        "latency_profile": f"""WITH s AS (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events),
            p AS (SELECT event_type, count(*) AS total, {pick}, min(v) AS min_us, max(v) AS max_us,
                         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM s GROUP BY event_type)
            SELECT * EXCLUDE (secs), round(total / secs, 9) AS throughput_rps, p99_us < 1000 AS meets_sla FROM p""",
    }


# --- retrieval --------------------------------------------------------------------------------
def embedding_ctes(src: str, prefix: str, dim: int) -> str:
    """``{prefix}_vec(id, v)`` for src(id, text): bytes, slots, unit length."""
    p = prefix
    return f"""{p}_bytes AS (
  SELECT id, unnest(range(0, len(h))) AS i, unnest(h) AS hx
  FROM (SELECT id, regexp_extract_all(hex(encode(text)), '..') AS h FROM {src})),
{p}_slots AS (
  SELECT id, (31 * i + b) % {dim} AS slot, sum(b / 128.0::DOUBLE - 1) AS x
  FROM (SELECT id, i, CAST('0x' || hx AS BIGINT) AS b FROM {p}_bytes) GROUP BY ALL),
{p}_norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {p}_slots GROUP BY id),
{p}_all AS (
  SELECT s.id, g.i, CASE WHEN n.norm > 1e-6 THEN coalesce(x.x, 0) / n.norm ELSE coalesce(x.x, 0) END AS x
  FROM {src} s CROSS JOIN (SELECT unnest(range(0, {dim})) AS i) g
  LEFT JOIN {p}_slots x ON x.id = s.id AND x.slot = g.i LEFT JOIN {p}_norm n ON n.id = s.id),
{p}_vec AS (SELECT id, list(x ORDER BY i) AS v FROM {p}_all GROUP BY id)"""


def topk_cte(queries: str, corpus: str, k: int, condition: str = "true") -> str:
    """``hits(query_id, doc_id, distance, rank)`` from (id, v) on both sides."""
    return f"""pairs AS (
  SELECT a.id AS query_id, b.id AS doc_id,
         round(greatest(1 - list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 0), 12) AS distance
  FROM {queries} a, {corpus} b WHERE {condition}),
hits AS (
  SELECT query_id, doc_id, distance,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INT) AS rank
  FROM pairs QUALIFY rank <= {k})"""


def retrieval_sql() -> dict[str, str]:
    from textguard.functions.embed import hash_planes

    dim = inputs.EMBED_DIM
    vectors = "vecs AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"
    centroids = """cent AS (
      SELECT label AS id, list(x ORDER BY i) AS v FROM (
        SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
          SELECT CAST(label AS BIGINT) AS label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
        GROUP BY label, i) GROUP BY label)"""
    shown = "query_id, doc_id, round(distance, 6) AS distance, rank"
    planes = hash_planes(64, 8, 4)
    codes = ", ".join(
        " + ".join(
            f"CASE WHEN list_dot_product(CAST(v AS DOUBLE[]), {[float(x) for x in plane]}) > 0 THEN {1 << b} ELSE 0 END"
            for b, plane in enumerate(table)
        )
        for table in planes
    )
    ctx = f"""{PROMPTS}, qs AS (SELECT prompt_id AS id, text FROM prompts),
      docs AS (SELECT doc_id AS id, text FROM documents),
      {embedding_ctes('qs', 'a', dim)}, {embedding_ctes('docs', 'b', dim)}, {topk_cte('a_vec', 'b_vec', 3)},
      ctx AS (SELECT query_id AS id, string_agg(text, {q('@')} ORDER BY rank) AS context
              FROM hits JOIN docs ON docs.id = hits.doc_id GROUP BY query_id)""".replace(
        q("@"), "chr(10) || '---' || chr(10)"
    )
    decided = DECIDED.replace(PROMPTS + ",", "", 1)
    guarded = f"""sp AS (SELECT prompt_id AS id, text, {inputs.AUTH_OK} AS auth_ok FROM prompts),
      {injection_first_ctes('sp')}, {redacted_ctes('sp')}, sp_steps AS (
        SELECT s.id, f.category, CASE WHEN d.n > 0 THEN d.redacted ELSE s.text END AS text,
          CASE WHEN trim(s.text) = '' THEN 0 WHEN NOT auth_ok THEN 1 WHEN f.id IS NOT NULL THEN 2 WHEN d.secret THEN 3 ELSE 4 END AS step
        FROM sp s JOIN d_red d ON d.id = s.id LEFT JOIN j_first f ON f.id = s.id),
      qs AS (SELECT id, text FROM sp_steps WHERE step = 4)"""
    return {
        "embed_documents": f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {embedding_ctes('docs', 'b', dim)}
            SELECT id AS doc_id, CAST(i AS INT) AS idx, round(x, 6) AS x FROM b_all""",
        "ingest_documents": f"""SELECT row_number() OVER (ORDER BY substring(md5(path), 1, 3), path) - 1
              + (SELECT max(page_id) + 1 FROM pages) AS doc_id, md5(text) AS text_md5, {dim} AS dim
            FROM (SELECT 'docs/' || doc_id || '.txt' AS path, text FROM documents)""",
        "ingest_stream": f"""SELECT count(*) AS documents, count(*) AS ids, (SELECT max(page_id) + 1 FROM pages) AS first_id,
              (SELECT max(page_id) FROM pages) + count(*) AS last_id, CAST(sum(length(text)) AS BIGINT) AS n_chars,
              count(text) * {dim} AS numbers FROM documents""",
        "vector_topk": f"WITH {centroids}, {vectors}, {topk_cte('cent', 'vecs', 10)} SELECT {shown} FROM hits",
        "vector_topk_all": f"WITH {vectors}, {topk_cte('vecs', 'vecs', 5)} SELECT {shown} FROM hits",
        "vector_topk_lsh": f"""WITH {vectors}, coded AS (SELECT id, v, [{codes}] AS c FROM vecs),
            {topk_cte('coded', 'coded', 5, 'len(list_filter(range(1, 9), lambda t: a.c[t] = b.c[t])) > 0')}
            SELECT {shown} FROM hits""",
        "doc_lookup": f"""WITH {centroids}, {vectors}, {topk_cte('cent', 'vecs', 10)}
            SELECT query_id, rank, h.doc_id, md5(text) AS text_md5 FROM hits h JOIN documents d ON d.doc_id = h.doc_id""",
        "search_text": f"WITH {ctx} SELECT {shown} FROM hits",
        "simple_context": f"""WITH {ctx}, f AS (
              SELECT qs.id, CASE WHEN context IS NULL THEN text ELSE 'Context:' || chr(10) || context || chr(10) || chr(10)
                     || 'User Question: ' || text END AS final FROM qs LEFT JOIN ctx ON ctx.id = qs.id)
            SELECT id AS prompt_id, md5(final) AS prompt_md5, CAST(length(final) AS INT) AS n_chars FROM f""",
        "simple_upstream_bodies": f"""WITH {ctx.replace("qs AS (SELECT prompt_id AS id, text FROM prompts)", guarded)},
              f AS (SELECT qs.id, CASE WHEN context IS NULL THEN text ELSE 'Context:' || chr(10) || context || chr(10) || chr(10)
                      || 'User Question: ' || text END AS final FROM qs LEFT JOIN ctx ON ctx.id = qs.id)
            SELECT id AS prompt_id, CASE WHEN id % 3 = 0 THEN 'm9' ELSE {q(rules.DEFAULT_MODEL)} END AS model, false AS stream,
              'user' AS role, md5(final) AS content_md5 FROM f""",
        "simple_rag_gate": f"""WITH {PROMPTS}, {guarded} SELECT CASE WHEN g.step = 1 THEN 'Authentication' WHEN g.step = 2 THEN CASE category
                WHEN 'prompt_injection' THEN 'PromptInjection' WHEN 'jailbreak' THEN 'Jailbreak' ELSE 'MaliciousPayload' END
                WHEN g.step = 3 THEN 'SecretLeak' WHEN g.step = 4 THEN 'RagPipeline' END AS category, count(*) AS prompts
            FROM sp_steps g GROUP BY 1""",
        "last_user_message": f"""WITH {REQUESTS}, mtext AS (SELECT id * 1000 + idx AS id, content AS text, role FROM msgf WHERE content IS NOT NULL),
            {redacted_ctes('mtext')}
            SELECT r.request_id, (SELECT last(d.redacted ORDER BY d.id) FROM d_red d JOIN mtext m ON m.id = d.id
                                  WHERE m.role = 'user' AND d.id // 1000 = r.id) AS text
            FROM req r WHERE r.readable""",
        "last_user_turn": """SELECT conv_id, last(text ORDER BY turn) AS text FROM conversations
            WHERE role = 'user' GROUP BY conv_id""",
        "chat_context": f"""WITH {PROMPTS}, {decided},
            qs AS (SELECT d.id, last(r.redacted ORDER BY r.id) AS text FROM decided d
                   JOIN msgf m ON m.id = d.id AND m.role = 'user' JOIN d_red r ON r.id = m.id * 1000 + m.idx
                   WHERE d.kind IS NULL GROUP BY d.id),
            docs AS (SELECT doc_id AS id, text FROM documents),
            {embedding_ctes('qs', 'a', dim)}, {embedding_ctes('docs', 'b', dim)}, {topk_cte('a_vec', 'b_vec', 3)},
            ctx AS (SELECT query_id AS id, '[Retrieved Context]:' || chr(10)
                      || string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context
                    FROM hits JOIN docs ON docs.id = hits.doc_id GROUP BY query_id),
            n AS (SELECT id, count(*) AS n FROM msgf GROUP BY id),
            f AS (SELECT m.id, coalesce(r.redacted, m.content, '') AS text, m.role
                  FROM msgf m LEFT JOIN d_red r ON r.id = m.id * 1000 WHERE m.idx = 0)
            SELECT d.request_id, c.id IS NOT NULL AS rag_retrieval_performed,
              CAST(n.n + CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS INT) AS n_messages,
              CASE WHEN c.id IS NULL THEN f.role ELSE 'system' END AS first_role,
              md5(coalesce(c.context, f.text)) AS first_md5
            FROM decided d JOIN n ON n.id = d.id JOIN f ON f.id = d.id LEFT JOIN ctx c ON c.id = d.id
            WHERE d.kind IS NULL""",
    }


def all_oracles() -> dict[str, str]:
    streaming = {
        "stream_output_stateful": stream_sql()["stream_output"],
        "rate_limit_stateful": policy_sql()["rate_limit_by_user"],
        "chat_metrics_stream": audit_sql()["metrics_windows"],
        "event_metrics_stream": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type,
            count(*) AS requests, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS latency_us
            FROM events GROUP BY 1, 2""",
    }
    return {
        **streaming,
        **scanning_sql(),
        **stream_sql(),
        **policy_sql(),
        **audit_sql(),
        **retrieval_sql(),
    }
