"""ANSI SQL counterparts of the registered queries, for DuckDB on the same tables.

Written as a library of named WITH parts; ``compose`` adds the parts a query needs.
RE2 has no look-behind and its classes are ASCII: texts are searched in a form whose
non-ASCII letters are underscores (also word characters, and no pattern's own), and
the digit patterns with look-arounds work on maximal digit runs.
"""

from __future__ import annotations

import re

from veilscan import catalogs as c
from veilscan.sources.derived import (
    BLOCK_TEMPLATE,
    CUSTOMER_FIELDS_SQL,
    LAYOUT_FIELDS_SQL,
    day_sql,
    template_sql,
)

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def r4(x: str, places: int = 4) -> str:
    """Correct rounding of a double, ties to even, on its exact value."""
    scale = f"{10 ** places}.0::DOUBLE"
    high = "(134217729.0::DOUBLE * v - (134217729.0::DOUBLE * v - v))"
    error = f"(({high} * {scale} - v * {scale}) + (v - {high}) * {scale})"
    low = f"floor(v * {scale})"
    rest = f"(v * {scale} - {low})"
    return (f"list_transform([CAST({x} AS DOUBLE)], lambda v: (CASE WHEN {rest} > 0.5 OR ({rest} = 0.5 AND ({error} > 0 OR ({error} = 0 AND {low} % 2 <> 0))) "
            f"THEN {low} + 1 ELSE {low} END) / {scale})[1]")


def any_word(text: str, values) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(v)})" for v in values) + ")"


def count_words(text: str, values) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(v)}) AS INT)" for v in values) + ")"


PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, deps: str, sql: str) -> None:
    PARTS[name] = (deps.split(), sql)


def compose(select: str, deps: str, corpus: str | None = None) -> str:
    """The query with the parts it needs; ``corpus`` takes the place of the part of that name."""
    parts = PARTS | ({"corpus": ([], corpus)} if corpus else {})
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in parts[name][0]:
            visit(d)
        order.append(name)

    for d in deps.split():
        visit(d)
    recursive = any("UNION ALL SELECT /*r*/" in parts[n][1] for n in order)
    body = ",\n".join(f"{n} AS MATERIALIZED ({parts[n][1]})" if "UNION ALL SELECT /*r*/" not in parts[n][1]
                      else f"{n} AS ({parts[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{select}"


# -- inputs -------------------------------------------------------------------
part("ord_agg", "", """SELECT o_custkey, min(o_orderdate) first_date, max(o_orderdate) last_date,
    min(o_orderkey) first_key, max(o_orderkey) last_key FROM orders GROUP BY o_custkey""")
part("facts", "ord_agg", f"""SELECT {CUSTOMER_FIELDS_SQL},
    CASE WHEN first_date IS NOT NULL THEN {day_sql('first_date')} END AS d1,
    CASE WHEN last_date IS NOT NULL THEN {day_sql('last_date')} END AS d2,
    lpad(CAST(first_key AS STRING), 12, '6') AS o1, lpad(CAST(last_key AS STRING), 12, '7') AS o2
    FROM customer LEFT JOIN ord_agg ON c_custkey = o_custkey""")
part("banking", "facts", f"""SELECT k * 2 + 1 AS screen_id, CAST(c_nationkey AS BIGINT) AS session_id,
    concat('user', k % 50) AS user_id, concat('screen_', k, '.png') AS filename,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k) AS uploaded_at,
    {template_sql().replace("concat(d1, ' UPI", "d1 || concat(' UPI").replace("concat(d2, ' NEFT", "d2 || concat(' NEFT").replace("concat(d2, ' debit Rs. 1,200.50')", "d2 || ' debit Rs. 1,200.50'").replace("concat(' UPI/SIBL/', o1, '/PAY')", "' UPI/SIBL/' || o1 || '/PAY'").replace("concat(' NEFT/UBIN/', o2, '/PAY')", "' NEFT/UBIN/' || o2 || '/PAY'")} AS full_text,
    CASE WHEN k % 29 = 3 THEN 0.35::DOUBLE ELSE CAST(90 + k % 10 AS DOUBLE) / 100 END AS avg_confidence
    FROM facts""")


def canonical(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({x}, {NL}), lambda l: trim(l, {WS})), "
            f"lambda l: l <> ''), {NL})")


part("docs", "", f"""SELECT doc_id AS screen_id, 1000 + CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS session_id,
    concat('user', doc_id % 50) AS user_id, concat('screen_', doc_id) AS filename,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS uploaded_at,
    {canonical('text')} AS full_text, 1.0::DOUBLE AS avg_confidence FROM documents""")
part("corpus", "docs banking", """SELECT * REPLACE (screen_id * 2 AS screen_id) FROM docs UNION ALL SELECT * FROM banking""")
part("scr", "corpus", r"""SELECT *, regexp_replace(full_text, '[\x{00AA}-\x{024F}]', '_', 'g') AS t, lower(full_text) AS low FROM corpus""")


# -- spans --------------------------------------------------------------------
def in_line(pattern: str) -> str:
    out = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", r"[\1 \\t\2]", pattern)
    return out.replace(r"\s", r"[ \t]")


def spans_sql(pattern: str, ignore_case: bool, group: bool = False, source: str = "scr") -> str:
    p = q(("(?i)" if ignore_case else "") + pattern)
    value = "g[i]" if group else "h[i]"
    return f"""SELECT screen_id, e - length(v) AS s, e, substring(full_text, e - length(v) + 1, length(v)) AS value FROM (
      SELECT screen_id, full_text, {value} AS v,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))) AS BIGINT) AS e
      FROM (SELECT screen_id, full_text, h, g, gaps, unnest(range(1, len(h) + 1)) AS i FROM (
        SELECT screen_id, full_text, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {1 if group else 0}) AS g,
          string_split_regex(t, {p}) AS gaps FROM {source} WHERE regexp_matches(t, {p}))))"""


part("runs", "scr", f"""SELECT r.*, s.t,
    CASE WHEN r.s = 0 THEN '' ELSE substring(s.t, r.s, 1) END AS before, substring(s.t, r.e + 1, 1) AS after
    FROM ({spans_sql('[0-9]+', False)}) r JOIN scr s USING (screen_id) WHERE length(value) >= 9""")
LOOKAROUND = {
    "BANK_ACCOUNT": r"""SELECT screen_id, s, e, value FROM runs WHERE length(value) <= 18
        AND NOT regexp_matches(before, '[\w/\-]') AND NOT regexp_matches(after, '[\w/\-]')""",
    "PHONE_IN": r"""SELECT screen_id, CASE WHEN country THEN s - 4 ELSE s END AS s, e,
          substring(full_text, CAST(CASE WHEN country THEN s - 4 ELSE s END AS BIGINT) + 1, e - CASE WHEN country THEN s - 4 ELSE s END) AS value
        FROM (SELECT r.*, sc.full_text, s >= 4 AND regexp_matches(substring(r.t, s - 3, 4), '^\+91[\s\-]$')
            AND (s = 4 OR NOT regexp_matches(substring(r.t, s - 4, 1), '\d')) AS country
          FROM runs r JOIN scr sc USING (screen_id) WHERE length(value) = 10 AND regexp_matches(value, '^[6-9]'))
        UNION ALL SELECT screen_id, s - 1, e, '+' || value FROM runs WHERE length(value) = 12 AND regexp_matches(value, '^91[6-9]')
          AND before = '+' AND (s = 1 OR NOT regexp_matches(substring(t, s - 1, 1), '\d'))""",
}
for i, (kind, pattern, ic, conf, masked) in enumerate(c.DETECTORS):
    if kind in LOOKAROUND:
        part(f"det_{i}", "scr runs", LOOKAROUND[kind])
    else:
        part(f"det_{i}", "scr", spans_sql(pattern, ic))
    prior = "" if i == 0 else f"acc_{i - 1}"
    new = f"SELECT screen_id, {i} AS p, {q(kind)} AS pii_type, value, s, e, {conf}::DOUBLE AS confidence, {str(masked).lower()} AS masked FROM det_{i}"
    if i == 0:
        part("acc_0", "det_0", new)
    else:
        part(f"acc_{i}", f"det_{i} {prior}", f"""SELECT * FROM {prior} UNION ALL SELECT * FROM ({new}) n WHERE NOT EXISTS (
            SELECT 1 FROM {prior} a WHERE a.screen_id = n.screen_id AND a.pii_type <> 'AADHAAR_UNMASKED' AND n.s < a.e AND n.e > a.s)""")
ALL_DETECTED = f"acc_{len(c.DETECTORS) - 1}"

# -- lines and contexts -------------------------------------------------------
part("lines", "scr", f"""SELECT screen_id, i - 1 AS line_index, ls[i] AS text, avg_confidence,
    CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS s,
    CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) + length(ls[i]) AS e
    FROM (SELECT screen_id, avg_confidence, ls, unnest(range(1, len(ls) + 1)) AS i FROM
      (SELECT screen_id, avg_confidence, string_split(full_text, {NL}) AS ls FROM scr))""")
part("ctxlines", "lines", f"""SELECT *, concat_ws({NL}, lag(text) OVER w, text, lead(text) OVER w) AS ctx
    FROM lines WINDOW w AS (PARTITION BY screen_id ORDER BY line_index)""")
ROW = q("(?i)" + c.DATE_AMOUNT_ROW_PATTERN)
part("numlines", "scr", """SELECT screen_id FROM scr WHERE regexp_matches(t, '[0-9]{4}')""")


def with_ctx(source: str) -> str:
    """Matches (screen_id, s, e, ...) with the text of their lines and the neighbours."""
    return f"""SELECT m.*, (SELECT string_agg(l.text, {NL} ORDER BY l.line_index) FROM lines l
        WHERE l.screen_id = m.screen_id AND l.line_index BETWEEN m.l1 - 1 AND m.l2 + 1) AS ctx
      FROM (SELECT m.*, (SELECT min(line_index) FROM lines l WHERE l.screen_id = m.screen_id AND m.s < l.e AND m.e > l.s) AS l1,
                       (SELECT max(line_index) FROM lines l WHERE l.screen_id = m.screen_id AND m.s < l.e AND m.e > l.s) AS l2
            FROM ({source}) m) m"""


# -- document and screen types ------------------------------------------------
def doc_type_sql(low: str) -> str:
    arms = [
        f"WHEN {any_word(low, c.RECEIPT_WORDS)} AND NOT contains({low}, 'statement') THEN 'Transaction Receipt'",
        f"WHEN contains({low}, 'statement') AND (contains({low}, 'date') OR contains({low}, 'balance')) THEN 'Bank Statement'",
        f"WHEN {any_word(low, c.STATEMENT_WORDS)} THEN 'Bank Statement'",
    ]
    arms += [f"WHEN {any_word(low, ws)} THEN {q(name)}" for name, ws in c.DOCUMENT_WORDS]
    arms.append(f"WHEN {count_words(low, c.GENERIC_BANK_WORDS)} >= 2 THEN 'Generic Banking Screen'")
    return "CASE " + " ".join(arms) + " ELSE 'Unknown/Other' END"


part("doctype", "scr", f"SELECT screen_id, {doc_type_sql('low')} AS document_type FROM scr")
part("sthits", "scr", " UNION ALL ".join(
    f"SELECT screen_id, {q(sid)} AS screen_type, {n} AS list_order, {count_words('low', ws)} AS hits FROM scr WHERE {any_word('low', ws)}"
    for n, (sid, ws) in enumerate(c.SCREEN_SIGNALS)))
part("sclass", "scr sthits", f"""SELECT screen_id, coalesce(top.screen_type, '{c.FALLBACK_SCREEN}') AS primary_screen_type,
    CASE WHEN top.hits >= 3 THEN 'high' WHEN top.hits >= 2 THEN 'medium' ELSE 'low' END AS screen_confidence,
    coalesce(types, '{c.FALLBACK_SCREEN}') AS screen_types
    FROM scr LEFT JOIN (SELECT screen_id, arg_min({{'screen_type': screen_type, 'hits': hits}}, -hits * 100 + list_order) AS top,
        string_agg(screen_type, ',' ORDER BY hits DESC, list_order) AS types FROM sthits GROUP BY screen_id) USING (screen_id)""")
part("stypes", "sclass", "SELECT screen_id, unnest(string_split(screen_types, ',')) AS screen_type FROM sclass")

# -- contextual matches -------------------------------------------------------
MISREAD = "CASE WHEN regexp_matches(replace(value, ',', ''), '^(22|33|77)') THEN substring(replace(value, ',', ''), 2) ELSE value END"
part("ctx_balance", "scr", f"SELECT screen_id, s, e, {MISREAD} AS value FROM ({spans_sql(c.BALANCE_PATTERN, True, True)})")
part("ctx_customer", "scr", f"SELECT * FROM ({spans_sql(c.CUSTOMER_ID_PATTERN, True, True)}) WHERE regexp_matches(value, '[0-9]')")
part("ctx_path", "scr", spans_sql(c.UPI_PATH_PATTERN, True, True))
part("ctx_label", "scr", spans_sql(c.LABELLED_REF_PATTERN, True, True))
part("ctx_chain", "scr", spans_sql(in_line(c.UPI_CHAIN_PATTERN), True, True))
part("ctx_lref", "scr", spans_sql(in_line(c.LINE_REF_PATTERN), True, True))
part("ctx_number", "runs ctxlines", f"""SELECT r.screen_id, r.s, r.e, r.value FROM runs r JOIN ctxlines l ON r.screen_id = l.screen_id AND r.s < l.e AND r.e > l.s
    WHERE length(r.value) BETWEEN 10 AND 20 AND ({any_word('lower(l.ctx)', c.TRANSACTION_KEYWORDS)} OR regexp_matches(l.ctx, {ROW}))""")
part("ctx_lines", "ctx_chain ctx_lref ctx_number", """SELECT screen_id, s, e, value, rule, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY screen_id, s, e ORDER BY rule) AS n FROM (
      SELECT *, 0 AS rule, 0.96::DOUBLE AS confidence FROM ctx_chain UNION ALL SELECT *, 1, 0.91 FROM ctx_lref
      UNION ALL SELECT *, 2, 0.91 FROM ctx_number)) WHERE n = 1""")
DATED = q("(?i)" + c.DATED_LINE_PATTERN)
part("ctx_history", "scr doctype lines", f"""SELECT screen_id, 0 AS s, length(full_text) AS e, concat(n, ' transaction rows detected') AS value
    FROM scr JOIN doctype USING (screen_id) JOIN (SELECT screen_id, count(*) AS n FROM lines WHERE regexp_matches(text, {DATED}) GROUP BY screen_id) USING (screen_id)
    WHERE n >= 3 AND document_type IN {inlist(c.HISTORY_DOCUMENT_TYPES)}""")
STRIPPED = "regexp_replace(value, '^\\s+|\\s+$', '', 'g')"
part("ctx_name", "scr", f"""SELECT * FROM (SELECT screen_id, s, e, {STRIPPED} AS value FROM ({spans_sql(in_line(c.CAPITAL_NAME_PATTERN), False)})) WHERE len(string_split_regex(value, '\\s+')) >= 2
    AND regexp_replace(upper(value), '[ .\\-X*]', '', 'g') <> '' AND value NOT IN {inlist(c.NAME_STOP_PHRASES)}
    AND NOT list_has_any(string_split_regex(value, '\\s+'), {lst(c.NAME_FORBIDDEN_TOKENS)})""")
part("ctx_amount", "scr", spans_sql(c.AMOUNT_PATTERN, True))
part("ctx_all", "ctx_balance ctx_customer ctx_lines ctx_path ctx_label ctx_history ctx_name ctx_amount", """
    SELECT screen_id, 'ACCOUNT_BALANCE' AS pii_type, value, s, e, 0.85::DOUBLE AS confidence, 101 AS stage, 0 AS rule FROM ctx_balance
    UNION ALL SELECT screen_id, 'CUSTOMER_ID', value, s, e, 0.82, 102, 0 FROM ctx_customer
    UNION ALL SELECT screen_id, 'TRANSACTION_REFERENCE', value, s, e, confidence, 103, rule FROM ctx_lines
    UNION ALL SELECT screen_id, 'TRANSACTION_REFERENCE', value, s, e, 0.95, 104, 0 FROM ctx_path
    UNION ALL SELECT screen_id, 'TRANSACTION_REFERENCE', value, s, e, 0.88, 105, 0 FROM ctx_label
    UNION ALL SELECT screen_id, 'TRANSACTION_HISTORY', value, s, e, 0.85, 106, 0 FROM ctx_history
    UNION ALL SELECT screen_id, 'ACCOUNT_HOLDER_NAME', value, s, e, 0.30, 107, 0 FROM ctx_name
    UNION ALL SELECT screen_id, 'TRANSACTION_AMOUNT', value, s, e, 0.75, 108, 0 FROM ctx_amount""")

# -- raw matches with context and validation ------------------------------------
part("raw0", f"{ALL_DETECTED} ctx_all", f"""SELECT screen_id, pii_type, value, s, e, confidence, masked, p AS stage, 0 AS rule FROM {ALL_DETECTED}
    UNION ALL SELECT screen_id, pii_type, value, s, e, confidence, false, stage, rule FROM ctx_all""")
part("raw", "raw0 lines scr", f"""SELECT m.*, lower(ctx) AS lctx, sc.avg_confidence AS ocr FROM ({with_ctx('SELECT * FROM raw0')}) m JOIN scr sc USING (screen_id)""")
# Place of a match in the order of its screen.
ORD = "stage * 1000000000000 + CASE WHEN stage = 103 THEN l1 * 100000000 ELSE 0 END + rule * 10000000 + s"
D_LIST = "[" + ",".join(str(n) for row in c.VERHOEFF_D for n in row) + "]"
P_LIST = "[" + ",".join(str(n) for row in c.VERHOEFF_P for n in row) + "]"
VERHOEFF = (f"list_reduce(list_transform(range(1, 13), lambda i: {P_LIST}[((i - 1) % 8) * 10 + CAST(substring(digits, 13 - i, 1) AS INT) + 1]), "
            f"lambda acc, x: {D_LIST}[acc * 10 + x + 1], 0) = 0")
part("val", "raw", f"""SELECT *,
    CASE WHEN is_a THEN CASE WHEN fmt AND {VERHOEFF} THEN true ELSE false END END AS chk FROM (
    SELECT *, pii_type = 'AADHAAR_UNMASKED' AS is_a, regexp_replace(value, '[\\s\\-]', '', 'g') AS digits,
      regexp_matches(regexp_replace(value, '[\\s\\-]', '', 'g'), '^[0-9]{{12}}$') AS fmt,
      {any_word('lctx', c.AADHAAR_KEYWORDS)} AS a_ctx, {any_word('lctx', c.BANKING_KEYWORDS)} AS b_ctx,
      {any_word('lctx', c.TRANSACTION_KEYWORDS)} AS pay, {any_word('lctx', c.ACCOUNT_KEYWORDS)} AS acct FROM raw)""")
part("val2", "val", f"""SELECT *, fmt AND starts AND chk AND NOT rep AS a_valid,
    {r4("greatest(0.0::DOUBLE, least(0.99::DOUBLE, 0.0::DOUBLE + CASE WHEN fmt THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN starts THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN chk THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN a_ctx THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN b_ctx THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN rep THEN 0.30::DOUBLE ELSE 0 END))")} AS a_conf
    FROM (SELECT *, fmt AND substring(digits, 1, 1) NOT IN ('0', '1') AS starts,
      fmt AND regexp_matches(digits, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS rep FROM val)""")
part("ev", "val2", f"""SELECT *, lower(regexp_replace(value, '[\\s,\\-]+', '', 'g')) AS vkey, {ORD} AS ord,
    {r4("greatest(0.0::DOUBLE, least(0.99::DOUBLE, CASE WHEN is_a THEN CASE WHEN pay AND NOT a_ctx THEN least(a_conf, 0.18::DOUBLE) ELSE a_conf END WHEN pii_type = 'BANK_ACCOUNT' AND pay THEN least(confidence, 0.25::DOUBLE) ELSE confidence END))")} AS econf
    FROM val2""")
part("cand", "ev", """SELECT screen_id, vkey, arg_min(value, ord) AS value, min(ord) AS first_ord, max(econf) AS best_conf,
    arg_min(pii_type, -econf * 1e17 + ord) AS best_type_approx, count(*) AS n,
    count(*) FILTER (WHERE stage < 21) AS regex_n, count(*) FILTER (WHERE stage >= 21) AS context_n FROM ev WHERE vkey <> '' GROUP BY screen_id, vkey""")
part("best", "ev", """SELECT screen_id, vkey, pii_type, econf, ocr, a_valid, chk FROM (
    SELECT *, row_number() OVER (PARTITION BY screen_id, vkey ORDER BY econf DESC, ord) AS n FROM ev WHERE vkey <> '') WHERE n = 1""")
part("bestev", "ev", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY screen_id, vkey ORDER BY econf DESC, ord) AS n FROM ev WHERE vkey <> '') WHERE n = 1""")
# Where a match stands: its lines, and the reason that its rule gives (needs lines).
PLACED = "md5(ctx) AS context_md5, CAST(l1 AS BIGINT) AS first_line, CAST(l2 AS BIGINT) AS final_line"
_HELD = (f"list_filter({lst(sorted(c.TRANSACTION_KEYWORDS))}, lambda k: contains(lctx, k)) || "
         f"CASE WHEN regexp_matches(ctx, {ROW}) THEN [{q(c.ROW_KEYWORD)}] ELSE [] END")


def fill(template: str, *values: str) -> str:
    """The text with its ``{}`` replaced by the expressions, in order."""
    parts = [q(p) for p in template.split("{}")]
    return "concat(" + ", ".join([parts[0], *[x for v, p in zip(values, parts[1:]) for x in (v, p)]]) + ")"


REASON = ("CASE WHEN stage < 21 THEN " + fill(c.DETECTOR_REASON, "pii_type") + "".join(
    f" WHEN stage = {n} THEN {q(text)}" for n, text in (
        (101, c.BALANCE_REASON), (102, c.CUSTOMER_REASON), (104, c.UPI_PATH_REASON), (105, c.LABELLED_REASON),
        (106, c.HISTORY_REASON), (107, c.NAME_REASON), (108, c.AMOUNT_REASON)))
    + " ELSE " + fill(c.LINE_REF_REASON, "value", f"array_to_string(list_sort(list_distinct({_HELD})), ', ')",
                      f"trim((SELECT text FROM lines l WHERE l.screen_id = x.screen_id AND l.line_index = x.l1), {WS})") + " END")


def fused(ai: str, det: str, ocr: str) -> str:
    w = f"CASE WHEN {ai} > 0 THEN 0.45::DOUBLE ELSE 0 END"
    return r4(f"greatest(0.0::DOUBLE, least(0.99::DOUBLE, ({ai} * {w} + {det} * 0.25::DOUBLE + {ocr} * 0.15::DOUBLE) / ({w} + 0.25::DOUBLE + 0.15::DOUBLE)))")


CATALOGUE = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(r)}, {q(d)})" for a, b, r, d in c.ENTITY_CATALOGUE) + ") AS cat(pii_type, category, risk, display_type)"


def entities_sql(decided: str, ai: str) -> str:
    return f"""SELECT e.*, category, risk, display_type FROM (
      SELECT screen_id, vkey, b.pii_type, cand.value, {fused(ai, 'econf', 'ocr')} AS confidence, b.pii_type IN {inlist(c.MASKED_TYPES)} AS masked,
        {decided} AS decided, best_conf, first_ord, chk FROM cand JOIN best b USING (screen_id, vkey)) e JOIN {CATALOGUE} USING (pii_type)
      WHERE confidence >= CASE WHEN pii_type = 'TRANSACTION_REFERENCE' THEN 0.45 WHEN decided THEN 0.35 ELSE 0.50 END"""


BAD_AADHAAR = "(b.pii_type = 'AADHAAR_UNMASKED' AND NOT b.a_valid)"
part("ent", "cand best", f"""SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY best_conf DESC, first_ord) AS entity_rank
    FROM ({entities_sql(f'NOT {BAD_AADHAAR}', f'CASE WHEN {BAD_AADHAAR} THEN 0.0::DOUBLE ELSE econf END')})""")
part("ent_plain", "cand best", entities_sql("false", "0.0::DOUBLE"))

# -- rules-only route -----------------------------------------------------------
part("det1", "val2", f"""SELECT *, stage < 21 AS is_det, {ORD} AS ord, EXISTS (SELECT 1 FROM val2 x WHERE x.screen_id = v.screen_id AND x.stage >= 21
      AND x.pii_type = 'TRANSACTION_REFERENCE' AND v.s < x.e AND v.e > x.s) AS on_ref FROM val2 v""")
part("det2", "det1", """SELECT * FROM det1 WHERE NOT is_det OR CASE
    WHEN pii_type = 'AADHAAR_UNMASKED' THEN NOT on_ref AND (NOT pay OR a_ctx) AND a_valid AND a_conf >= 0.75
    WHEN pii_type = 'AADHAAR_MASKED' THEN NOT on_ref AND NOT (pay AND NOT contains(lctx, 'aadhaar') AND NOT contains(lctx, 'aadhar')) ELSE true END""")
part("det3", "det2", """SELECT *, CASE WHEN is_det AND pii_type = 'AADHAAR_UNMASKED' THEN a_conf
      WHEN is_det AND pii_type = 'BANK_ACCOUNT' AND acct THEN least(0.90::DOUBLE, confidence + 0.12::DOUBLE) ELSE confidence END AS conf,
      lower(replace(replace(value, ' ', ''), '-', '')) AS ckey
    FROM det2 d WHERE NOT (is_det AND pii_type = 'BANK_ACCOUNT') OR (NOT on_ref AND NOT EXISTS (SELECT 1 FROM det2 a WHERE a.screen_id = d.screen_id
      AND a.is_det AND a.pii_type IN ('AADHAAR_UNMASKED', 'AADHAAR_MASKED') AND d.s < a.e AND d.e > a.s) AND (acct OR length(value) <> 12))""")
part("dent", "det3", f"""SELECT screen_id, pii_type, value, {r4('conf')} AS confidence, masked,
    coalesce(category, '{c.DEFAULT_CATEGORY}') AS category, coalesce(risk, '{c.DEFAULT_RISK}') AS risk FROM (
    SELECT *, row_number() OVER (PARTITION BY screen_id, pii_type, ckey ORDER BY CASE WHEN is_det THEN 1 ELSE 2 END, ord) AS n FROM det3)
    LEFT JOIN (SELECT * FROM {CATALOGUE} WHERE pii_type <> 'TRANSACTION_AMOUNT') USING (pii_type) WHERE n = 1""")

# -- inventory ------------------------------------------------------------------
PARAMS = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(g)})" for a, b, g in c.PARAMETERS) + ") AS par(pii_id, pii_name, pii_group)"
ENT_PARAM = "(VALUES " + ", ".join(f"({q(t)}, {q(i)})" for t, ids in c.ENTITY_PARAMETERS for i in ids) + ") AS ep(pii_type, pii_id)"
part("entids", "ent", f"SELECT DISTINCT screen_id, pii_id FROM ent JOIN {ENT_PARAM} USING (pii_type)")
part("sigids", "scr", " UNION ".join(
    f"SELECT screen_id, {q(pid)} AS pii_id FROM scr WHERE regexp_matches(lower(t), {q(pattern)})" for pid, pattern, _ in c.TEXT_SIGNALS))
part("present", "entids sigids", "SELECT * FROM entids UNION SELECT * FROM sigids")
part("inv", "scr present", f"""SELECT s.screen_id, pii_id, CASE WHEN p.screen_id IS NULL THEN 'ABSENT' ELSE 'PRESENT' END AS status
    FROM scr s CROSS JOIN {PARAMS} LEFT JOIN present p USING (screen_id, pii_id)""")

# -- features, rules, verdicts ----------------------------------------------------
DASH = ["FIN-01", "ID-01", "ID-14", "ID-13", "KYC-01", "KYC-02", "FIN-07"]
DASH_TYPES = [t for t, ids in c.ENTITY_PARAMETERS if set(ids) & set(DASH)]
CONFLICT = ["PHONE_IN", "EMAIL", "ACCOUNT_HOLDER_NAME", "BANK_ACCOUNT"]
part("conflict", "ent", f"""SELECT screen_id, arg_min(pii_type, r) AS ctype, arg_min(vals, r) AS cvals FROM (
    SELECT screen_id, pii_type, min(entity_rank) AS r, list_sort(list(DISTINCT value)) AS vals FROM ent WHERE pii_type IN {inlist(CONFLICT)}
    GROUP BY screen_id, pii_type HAVING count(DISTINCT value) > 1) GROUP BY screen_id""")
part("efacts", "ent", f"""SELECT screen_id, count(*) AS total_entities, avg(confidence) AS mean_confidence,
    list(DISTINCT pii_type) FILTER (WHERE NOT masked) AS open_types,
    count(*) FILTER (WHERE NOT masked AND pii_type IN {inlist(DASH_TYPES)}) AS open_dash,
    arg_min(value, entity_rank) FILTER (WHERE NOT masked AND pii_type = 'AADHAAR_UNMASKED') AS first_aadhaar,
    arg_min(value, entity_rank) FILTER (WHERE NOT masked AND pii_type = 'BANK_ACCOUNT') AS first_account,
    count(*) FILTER (WHERE pii_type IN ('CREDIT_DEBIT_CARD', 'MASKED_CARD') AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 5 AND 15) AS partial_cards,
    count(*) FILTER (WHERE risk = 'Critical') AS rc, count(*) FILTER (WHERE risk = 'High') AS rh,
    count(*) FILTER (WHERE risk = 'Medium') AS rm, count(*) FILTER (WHERE risk = 'Low') AS rl FROM ent GROUP BY screen_id""")
part("plist", "present", "SELECT screen_id, list_sort(list(pii_id)) AS present FROM present GROUP BY screen_id")
part("feat", "scr sclass efacts plist conflict doctype", f"""SELECT s.screen_id, s.session_id, s.low, s.t, s.avg_confidence, coalesce(p.present, []) AS present,
    string_split(k.screen_types, ',') AS stypes, k.primary_screen_type, k.screen_confidence, d.document_type,
    coalesce(e.total_entities, 0) AS total_entities, e.mean_confidence, coalesce(e.open_types, []) AS open_types, coalesce(e.open_dash, 0) AS open_dash,
    e.first_aadhaar, e.first_account, coalesce(e.partial_cards, 0) AS partial_cards, x.ctype, x.cvals,
    coalesce(rc, 0) AS rc, coalesce(rh, 0) AS rh, coalesce(rm, 0) AS rm, coalesce(rl, 0) AS rl
    FROM scr s JOIN sclass k USING (screen_id) JOIN doctype d USING (screen_id) LEFT JOIN efacts e USING (screen_id)
    LEFT JOIN plist p USING (screen_id) LEFT JOIN conflict x USING (screen_id)""")


def has(*ids: str) -> str:
    return f"list_has_any(present, {lst(ids)})"


def those(*ids: str) -> str:
    return f"list_filter({lst(ids)}, lambda i: list_contains(present, i))"


def says(name: str) -> str:
    return any_word("low", c.RULE_WORDS[name])


NONE = "CAST([] AS VARCHAR[])"
RULE_SQL = {
    "RULE-DM-01": ("Section 6(1)", "HIGH", f"len({those(*DASH)}) > 3 AND open_dash > 3", f"list_sort({those(*DASH)})"),
    "RULE-DM-02": ("Section 6(1)", "CRITICAL", f"list_contains(open_types, 'CREDIT_DEBIT_CARD') OR regexp_matches(t, {q('(?i)' + c.CVV_PATTERN)})", lst(["FIN-02"])),
    "RULE-DM-03": ("Section 6(1)", "CRITICAL", "first_aadhaar IS NOT NULL", lst(["KYC-02"])),
    "RULE-DM-04": ("Section 6(1)", "MEDIUM", has("KYC-01", "KYC-02", "ID-04", "ID-07", "FIN-01"), those("KYC-01", "KYC-02", "ID-04", "ID-07", "FIN-01")),
    "RULE-DM-05": ("Section 6(1)", "HIGH", has("FIN-09", "FIN-11", "FIN-10"), those("FIN-09", "FIN-11", "FIN-10")),
    "RULE-DM-06": ("Section 6(1)", "HIGH", has("ID-17", "ID-18", "ID-20", "CHD-04"), those("ID-17", "ID-18", "ID-20", "CHD-04")),
    "RULE-CN-01": ("Section 5(1)", "CRITICAL", f"NOT {says('cn01_consent')}", f"CASE WHEN {has('KYC-01', 'KYC-02', 'KYC-03')} THEN {those('KYC-01', 'KYC-02', 'KYC-03')} ELSE ['KYC-02'] END"),
    "RULE-CN-02": ("Section 5(1)(i)", "HIGH", f"NOT {says('cn02_purpose')}", NONE),
    "RULE-CN-03": ("Section 5(1)(ii)", "HIGH", f"NOT {says('cn03_withdrawal')}", NONE),
    "RULE-CN-04": ("Section 6(1)", "HIGH", says("cn04_blanket"), NONE),
    "RULE-CN-05": ("Section 6(1)", "MEDIUM", says("cn05_excess"), NONE),
    "RULE-CN-06": ("Section 6", "HIGH", f"{has('ID-01', 'ID-14', 'FIN-01', 'FIN-07')} AND NOT {says('cn06_optout')}", those("ID-01", "ID-14", "FIN-01", "FIN-07")),
    "RULE-SEC-01": ("Section 8(5)", "CRITICAL", "list_contains(open_types, '_KW_PASSWORD')", lst(["ONL-02"])),
    "RULE-SEC-02": ("Section 8(5)", "HIGH", "first_account IS NOT NULL", lst(["FIN-01"])),
    "RULE-SEC-03": ("Section 8(5)", "CRITICAL", f"{says('sec03_debug')} OR {has('ONL-03', 'ONL-04')}", f"CASE WHEN {has('ONL-03', 'ONL-04')} THEN ['ONL-03', 'ONL-04'] ELSE {NONE} END"),
    "RULE-SEC-04": ("Section 8(5)", "HIGH", f"regexp_matches(t, {q('(?i)' + c.OTP_PATTERN)})", NONE),
    "RULE-SEC-05": ("Section 8(5)", "CRITICAL", f"{has('BIO-01', 'BIO-02')} AND NOT {says('sec05_indicator')}", lst(["BIO-01", "BIO-02"])),
    "RULE-RET-01": ("Section 8(7)", "MEDIUM", has("KYC-01", "KYC-02", "KYC-03", "KYC-04", "KYC-05"), those("KYC-01", "KYC-02", "KYC-03", "KYC-04", "KYC-05")),
    "RULE-RET-02": ("Section 8(7)", "MEDIUM", f"{says('ret02_closed')} AND {has('FIN-01', 'ID-01', 'ID-07', 'FIN-07')}", those("FIN-01", "ID-01", "ID-07", "FIN-07")),
    "RULE-CHD-01": ("Section 9(1)", "CRITICAL", f"{has('CHD-01', 'CHD-02')} AND NOT {says('chd01_guardian')}", lst(["CHD-01"])),
    "RULE-CHD-02": ("Section 9(3)", "CRITICAL", has("CHD-01", "CHD-02"), lst(["CHD-01"])),
    "RULE-CHD-03": ("Section 9(3)", "CRITICAL", f"{has('CHD-01', 'CHD-02')} AND {says('chd03_tracking')}", lst(["CHD-01"])),
    "RULE-TP-01": ("Section 4", "HIGH", has("ID-01", "ID-14", "FIN-07", "FIN-08"), those("ID-01", "ID-14", "FIN-07", "FIN-08")),
    "RULE-TP-02": ("Section 5(1)", "HIGH", f"{has('ID-01')} AND NOT {says('tp02_disclosure')}", lst(["ID-01"])),
    "RULE-SEN-01": ("Section 4", "HIGH", has("ID-17", "ID-18", "ID-20"), those("ID-17", "ID-18", "ID-20")),
    "RULE-SEN-02": ("Section 6(1)", "CRITICAL", has("BIO-01", "BIO-02"), lst(["BIO-01", "BIO-02"])),
    "RULE-SEN-03": ("Section 5(1)", "CRITICAL", f"{has('BIO-01', 'BIO-02', 'OTH-02')} AND NOT {says('sen03_consent')}", lst(["BIO-01", "OTH-02"])),
    "RULE-GR-01": ("Section 8(10)", "LOW", f"len(present) >= 3 AND NOT {says('gr01_grievance')}", NONE),
    "RULE-ACC-01": ("Section 8(3)", "MEDIUM", "ctype IS NOT NULL", "CASE ctype WHEN 'PHONE_IN' THEN ['ID-14'] WHEN 'EMAIL' THEN ['ID-13'] WHEN 'ACCOUNT_HOLDER_NAME' THEN ['ID-01'] ELSE ['FIN-01'] END"),
}


def rule_sql(rule_id: str) -> str:
    section, severity, fires, involved = RULE_SQL[rule_id]
    screens = dict(c.RULE_SCREENS)[rule_id]
    order = [r for r, _ in c.RULE_SCREENS].index(rule_id)
    return (f"SELECT screen_id, session_id, {order} AS rule_order, {q(rule_id)} AS rule_id, array_to_string({involved}, ',') AS pii_involved, "
            f"{q(section)} AS act_section, {q(severity)} AS severity FROM feat WHERE list_has_any(stypes, {lst(screens)}) AND ({fires})")


for rule_id in RULE_SQL:
    part(f"r_{rule_id.lower().replace('-', '_')}", "feat", rule_sql(rule_id))
RULE_PARTS = [f"r_{r.lower().replace('-', '_')}" for r in RULE_SQL]
part("viol", " ".join(RULE_PARTS), " UNION ALL ".join(f"SELECT * FROM {p}" for p in RULE_PARTS))
SEV_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
part("vagg", "viol", f"SELECT screen_id, count(*) AS violations, arg_min(severity, {SEV_RANK}) AS overall_severity, bool_or(rule_id = 'RULE-CHD-03') AS tracks FROM viol GROUP BY screen_id")
RULE_DIM = "(VALUES " + ", ".join(f"({i}, {q(r)}, {q(s)})" for i, (r, ss) in enumerate(c.RULE_SCREENS) for s in ss) + ") AS rd(rule_order, rule_id, screen_type)"
part("apprules", "stypes", f"SELECT DISTINCT screen_id, rule_order, rule_id FROM stypes JOIN {RULE_DIM} USING (screen_type)")
REASONS = "(CAST(screen_confidence = 'low' AS INT) + CAST(avg_confidence < 0.4 AS INT) + CAST(partial_cards > 0 AS INT))"
LABELS = "(VALUES " + ", ".join(f"({q(s)}, {q(f'{s} ({n})')}, {q(l)})" for s, n, l in c.SCREEN_NAMES) + ") AS sl(primary_screen_type, screen_label, legacy_document_type)"
part("verd", "feat vagg apprules", f"""SELECT f.*, coalesce(v.violations, 0) AS violations, overall_severity, {REASONS} AS reasons, screen_label, coalesce(tracks, false) AS tracks,
    CASE WHEN v.violations > 0 THEN 'YES' WHEN {REASONS} > 0 THEN 'INCONCLUSIVE' ELSE 'NO' END AS verdict, coalesce(a.n, 0) AS rules_n
    FROM feat f LEFT JOIN vagg v USING (screen_id) LEFT JOIN (SELECT screen_id, count(*) AS n FROM apprules GROUP BY screen_id) a USING (screen_id)
    JOIN {LABELS} USING (primary_screen_type)""")
part("find", "ent", f"""SELECT screen_id, entity_rank, value, display_type, confidence,
    CASE WHEN pii_type IN ('AADHAAR_UNMASKED', 'CREDIT_DEBIT_CARD', 'BANK_ACCOUNT', 'PAN') AND risk = 'Critical' THEN 'Critical' ELSE 'High' END AS severity,
    CASE WHEN pii_type IN ('AADHAAR_UNMASKED', 'CREDIT_DEBIT_CARD', 'BANK_ACCOUNT', 'PAN') THEN 'Masking Compliance' ELSE 'Financial Privacy' END AS category
    FROM ent WHERE NOT masked AND risk IN ('Critical', 'High') AND pii_type IN ('AADHAAR_UNMASKED', 'CREDIT_DEBIT_CARD', 'BANK_ACCOUNT', 'PAN', 'ACCOUNT_BALANCE', 'TRANSACTION_HISTORY')""")
SECTIONS = "(VALUES " + ", ".join(f"({q(s)}, {q(t)}, {q(c.SECTION_PENALTIES.get(s, c.DEFAULT_PENALTY))})" for s, t in c.SECTION_TITLES.items()) + ") AS sec(act_section, section_title, penalty_reference)"
WEIGHT = "CASE risk WHEN 'Critical' THEN 25 WHEN 'High' THEN 10 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 1 ELSE 0 END"

# -- records of processing ----------------------------------------------------------
APP = "(?i)" + "|".join(r"\s+".join(p) for p in c.ROPA_APP_PHRASES)
CATS = "(VALUES " + ", ".join(f"({q(i)}, {q(n.split(' (')[0])})" for i, n in c.ROPA_DATA_CATEGORIES) + ") AS dc(pii_id, cat)"
part("sess_ids", "present scr", "SELECT DISTINCT session_id, pii_id FROM present JOIN (SELECT screen_id, session_id FROM scr) USING (screen_id)")
part("merged", "verd scr sess_ids", f"""SELECT session_id, count(*) AS screens, CAST(sum(total_entities) AS BIGINT) AS entities, CAST(sum(violations) AS BIGINT) AS violations,
    bool_or({any_word('v.low', c.ROPA_CONSENT_WORDS)}) AS says_consent, bool_or({any_word('v.low', c.ROPA_LAW_WORDS)}) AS says_law,
    bool_or(tracks) AS tracks, arg_max(screen_label, v.screen_id) AS screen_label,
    regexp_matches(string_agg(s.full_text, {NL} ORDER BY v.screen_id), {q(APP)}) AS named, any_value(ids.ids) AS ids
    FROM verd v JOIN (SELECT screen_id, full_text FROM scr) s USING (screen_id)
    LEFT JOIN (SELECT session_id, list(pii_id) AS ids FROM sess_ids GROUP BY session_id) ids USING (session_id) GROUP BY session_id""")
part("sess_cats", "sess_ids", f"SELECT session_id, string_agg(DISTINCT cat, ', ' ORDER BY cat) AS cats FROM sess_ids JOIN {CATS} USING (pii_id) GROUP BY session_id")


def sess(*ids: str) -> str:
    return f"list_has_any(coalesce(ids, []), {lst(ids)})"


part("ropa", "merged sess_cats", f"""SELECT *, 'The ' || process || ' process within ' || application_name || ' handles personal data including ' || personal_data_cats
      || '. Data is collected digitally through the mobile banking application.' AS description,
    'Processing personal data for ' || process AS purpose FROM (SELECT session_id,
    CASE WHEN named THEN {q(c.ROPA_APP_FOUND)} ELSE {q(c.ROPA_APP_DEFAULT)} END AS application_name,
    trim(split_part(screen_label, '(', 1)) AS process,
    CASE WHEN {sess('CHD-01', 'CHD-02')} THEN 'Customer, Minor/Child' ELSE 'Customer' END AS data_principal_cats,
    CASE WHEN {sess('CHD-01', 'CHD-02', 'CHD-03', 'CHD-04')} THEN 'Minors' ELSE 'Not Applicable' END AS includes_children,
    CASE WHEN tracks THEN 'Yes' ELSE 'No' END AS child_tracking, coalesce(cats, 'General Personal Data') AS personal_data_cats,
    CASE WHEN says_consent THEN 'Consent' WHEN says_law THEN {q(c.ROPA_GROUND_LAW)} ELSE {q(c.ROPA_GROUND_SERVICE)} END AS grounds,
    CASE WHEN says_consent THEN 'Digital' ELSE '' END AS consent_type,
    CASE WHEN {sess('BIO-01', 'BIO-02', 'CHD-01', 'CHD-02')} THEN 'Yes' ELSE 'No' END AS dpia_applicable
    FROM merged LEFT JOIN sess_cats USING (session_id))""")

# -- blocks ---------------------------------------------------------------------------
_records = []
for n, (text, x1, y1, x2, y2, when) in enumerate(BLOCK_TEMPLATE):
    text = text.replace("concat('UPI/HDFC/', o2, '/LEELA/UPI')", "'UPI/HDFC/' || o2 || '/LEELA/UPI'")
    rec = (f"{{'block_index': {n}, 'text': CAST({text} AS VARCHAR), 'x1': CAST({x1} AS DOUBLE), 'y1': CAST({y1} AS DOUBLE), "
           f"'x2': CAST({x2} AS DOUBLE), 'y2': CAST({y2} AS DOUBLE)}}")
    _records.append(f"CASE WHEN {when} THEN {rec} END" if when else rec)
part("blk0", "facts", f"""SELECT k AS screen_id, b.block_index, b.text, b.x1, b.y1, b.x2, b.y2, CAST(90 + (k + b.block_index) % 10 AS DOUBLE) / 100 AS confidence
    FROM (SELECT k, unnest(list_filter([{', '.join(_records)}], lambda r: r IS NOT NULL)) AS b FROM (SELECT *, {LAYOUT_FIELDS_SQL} FROM facts))""")
part("blk", "blk0", """SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(1.0, x2 - x1) AS width, greatest(1.0, y2 - y1) AS height FROM blk0 WHERE text IS NOT NULL""")
part("med", "blk", "SELECT screen_id, list_sort(list(height))[len(list(height)) // 2 + 1] AS mh, list_sort(list(width))[len(list(width)) // 2 + 1] AS mw FROM blk GROUP BY screen_id")
part("blkr", "blk med", "SELECT blk.*, mh, greatest(10.0, mh * 0.65) AS thr, row_number() OVER (PARTITION BY screen_id ORDER BY cy, x1, block_index) AS rn FROM blk JOIN med USING (screen_id)")
part("grp", "blkr", """SELECT screen_id, rn, 0 AS ln, cy AS total, 1 AS n FROM blkr WHERE rn = 1
    UNION ALL SELECT /*r*/ b.screen_id, b.rn, CASE WHEN abs(b.cy - g.total / g.n) <= b.thr THEN g.ln ELSE g.ln + 1 END,
      CASE WHEN abs(b.cy - g.total / g.n) <= b.thr THEN g.total + b.cy ELSE b.cy END, CASE WHEN abs(b.cy - g.total / g.n) <= b.thr THEN g.n + 1 ELSE 1 END
    FROM grp g JOIN blkr b ON b.screen_id = g.screen_id AND b.rn = g.rn + 1""")
part("mem", "grp blkr", "SELECT b.*, g.ln, row_number() OVER (PARTITION BY b.screen_id, g.ln ORDER BY x1, cy, block_index) AS pos FROM grp g JOIN blkr b USING (screen_id, rn)")
part("txt", "mem", """SELECT screen_id, ln, pos, text AS line, x2 FROM mem WHERE pos = 1
    UNION ALL SELECT /*r*/ m.screen_id, m.ln, m.pos, t.line || CASE WHEN regexp_matches(t.line, '[/\\-:.]$') OR regexp_matches(m.text, '^[/\\-:.]')
      OR greatest(0.0, m.x1 - t.x2) <= greatest(6.0, m.mh * 0.18) THEN '' ELSE ' ' END || m.text, m.x2
    FROM txt t JOIN mem m ON m.screen_id = t.screen_id AND m.ln = t.ln AND m.pos = t.pos + 1""".replace("\\\\", "\\"))
part("bline", "txt mem", f"""SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY screen_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
      (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM (
    SELECT t.screen_id, t.ln AS line_index, t.line AS text, m.blocks, m.x1, m.y1, m.x2, m.y2, m.avg_confidence, m.total, m.n FROM (
      SELECT screen_id, ln, arg_max(line, pos) AS line FROM txt GROUP BY screen_id, ln) t JOIN (
      SELECT screen_id, ln, string_agg(block_index::VARCHAR, ',' ORDER BY pos) AS blocks, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2,
        {r4('sum(confidence) / count(*)')} AS avg_confidence, sum(confidence) AS total, count(*) AS n FROM mem GROUP BY screen_id, ln) m USING (screen_id, ln))""")

# -- labels and values ---------------------------------------------------------------
ALIASES = "(VALUES " + ", ".join(f"({q(a)}, {q(t)})" for a, t in c.ALIAS_TO_TYPE.items()) + ") AS al(alias, entity_type)"
NORM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
part("bound", "bline", f"SELECT screen_id, arg_min(y1, line_index) AS boundary_y FROM bline WHERE {NORM.format('text')} IN {inlist(c.SUMMARY_STOP_LABELS)} GROUP BY screen_id")
part("sline", "bline bound", "SELECT b.* FROM bline b LEFT JOIN bound d USING (screen_id) WHERE d.boundary_y IS NULL OR b.cy < d.boundary_y")
part("seg", "sline mem", f"""SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(1.0, x2 - x1) AS width, greatest(1.0, y2 - y1) AS height FROM (
    SELECT l.screen_id, l.line_index, l.text AS line_text, l.s AS line_start, a.pos AS first, sz.n AS size,
      string_agg(m.text, ' ' ORDER BY m.pos) AS text, min(m.x1) AS x1, min(m.y1) AS y1, max(m.x2) AS x2, max(m.y2) AS y2,
      {r4('sum(m.confidence) / count(*)')} AS confidence
    FROM sline l JOIN mem a ON a.screen_id = l.screen_id AND a.ln = l.line_index JOIN (SELECT unnest(range(1, 6)) AS n) sz ON a.pos + sz.n - 1 <= l.n
    JOIN mem m ON m.screen_id = l.screen_id AND m.ln = l.line_index AND m.pos BETWEEN a.pos AND a.pos + sz.n - 1
    GROUP BY ALL) LEFT JOIN {ALIASES} ON alias = {NORM.format('text')}""")
part("lab", "seg", "SELECT * FROM seg WHERE entity_type IS NOT NULL AND size <= 3")
part("vseg", "seg", "SELECT * FROM seg WHERE entity_type IS NULL AND text <> ''")
AMT = q(r"(?i)(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*\.[0-9]{2})")
part("pair0", "lab vseg", f"""SELECT l.screen_id, l.entity_type, l.text AS label, l.line_index AS l_line, l.first AS l_first, l.size AS l_size,
    s.text AS seg_text, s.line_text, s.line_start, s.line_index AS s_line, s.first AS s_first, s.size AS s_size, s.confidence, s.y1 AS s_y1, s.x1 AS s_x1, s.cy AS s_cy,
    l.x1 AS l_x1, l.x2 AS l_x2, l.y2 AS l_y2, l.cy AS l_cy, l.height AS lh, l.width AS lw, s.height AS sh, s.width AS sw, s.cx AS s_cx, l.cx AS l_cx, s.x2 AS s_x2,
    l.line_index = s.line_index AND l.first <= s.first + s.size - 1 AND s.first <= l.first + l.size - 1 AS shared,
    CASE WHEN l.entity_type IN ('CUSTOMER_ID', 'IFSC') THEN regexp_replace(upper(s.text), '[^A-Z0-9]', '', 'g')
      WHEN l.entity_type = 'BANK_ACCOUNT' THEN regexp_replace(s.text, '[^0-9]', '', 'g')
      WHEN l.entity_type = 'ACCOUNT_BALANCE' THEN CASE WHEN regexp_matches(amt, '^(22|33|77)') THEN substring(amt, 2) ELSE amt END ELSE upper(s.text) END AS value
    FROM lab l JOIN (SELECT *, CASE WHEN regexp_matches(text, {AMT}) THEN replace(regexp_extract(text, {AMT}, 1), ',', '') ELSE text END AS amt FROM vseg) s USING (screen_id)""")
part("pair", "pair0", f"""SELECT *, {r4('CASE WHEN validation > 0 AND raw_spatial > 0 THEN least(0.99::DOUBLE, confidence * 0.25::DOUBLE + raw_spatial * 0.35::DOUBLE + validation * 0.40::DOUBLE) ELSE 0 END')} AS combined,
    {r4('raw_spatial')} AS spatial, validation > 0 AND raw_spatial > 0 AS accepted FROM (SELECT *,
    CASE WHEN entity_type = 'CUSTOMER_ID' AND regexp_matches(value, '^[A-Z0-9]{{5,15}}$') AND regexp_matches(value, '[0-9]') THEN CASE WHEN regexp_matches(value, '[A-Z]') THEN 0.98::DOUBLE ELSE 0.78::DOUBLE END
      WHEN entity_type = 'BANK_ACCOUNT' AND regexp_matches(value, '^[0-9]{{9,18}}$') AND NOT {any_word('lower(line_text)', c.TRANSACTION_KEYWORDS)} THEN 0.97::DOUBLE
      WHEN entity_type = 'IFSC' AND regexp_matches(value, '^[A-Z]{{4}}0[A-Z0-9]{{6}}$') THEN 0.99::DOUBLE
      WHEN entity_type = 'ACCOUNT_BALANCE' AND regexp_matches(seg_text, {AMT}) THEN 0.95::DOUBLE
      WHEN entity_type = 'BRANCH_NAME' AND regexp_matches(value, '^[A-Z][A-Z ,.''-]+$') AND length(value) >= 6
        AND ((contains(value, ',') AND NOT suffix(rtrim(value), ',')) OR len(string_split_regex(value, '\\s+')) >= 3) THEN 0.92::DOUBLE ELSE 0.0::DOUBLE END AS validation,
    CASE WHEN shared THEN 0.0::DOUBLE
      WHEN abs(s_cy - l_cy) <= greatest(lh, sh) * 0.75 AND s_x1 >= l_x2 - 2 THEN greatest(0.2::DOUBLE, 0.88::DOUBLE - least(greatest(0.0::DOUBLE, s_x1 - l_x2) / 350.0::DOUBLE, 0.45::DOUBLE))
      WHEN s_cy > l_cy AND greatest(0.0, s_y1 - l_y2) <= greatest(110.0, lh * 5) AND (greatest(0.0::DOUBLE, least(l_x2, s_x2) - greatest(l_x1, s_x1)) / greatest(1.0::DOUBLE, least(lw, sw)) >= 0.25
          OR abs(s_x1 - l_x1) <= greatest(55.0::DOUBLE, lw * 0.65) OR abs(s_cx - l_cx) <= greatest(75.0::DOUBLE, lw))
        THEN greatest(0.25::DOUBLE, 0.94::DOUBLE - least(greatest(0.0::DOUBLE, s_y1 - l_y2) / 180.0::DOUBLE, 0.40::DOUBLE) - least(abs(s_x1 - l_x1) / 500.0::DOUBLE, 0.15::DOUBLE)) ELSE 0.0::DOUBLE END AS raw_spatial FROM pair0)""")
part("bestpair", "pair", """SELECT *, false AS inferred FROM (SELECT *, row_number() OVER (PARTITION BY screen_id, l_line, l_first, l_size
      ORDER BY combined DESC, spatial DESC, validation DESC, s_line, s_first, s_size) AS n FROM pair WHERE accepted) WHERE n = 1""")
part("holder", "pair0", f"""SELECT *, {r4('least(0.99::DOUBLE, confidence * 0.25::DOUBLE + 0.85::DOUBLE * 0.35::DOUBLE + 0.94::DOUBLE * 0.40::DOUBLE)')} AS combined FROM (
    SELECT *, row_number() OVER (PARTITION BY screen_id, l_line, l_first, l_size ORDER BY s_y1, abs(s_x1 - l_x1), s_line, s_first, s_size) AS n FROM pair0
    WHERE entity_type = 'BANK_ACCOUNT' AND s_cy > l_cy AND s_y1 - l_y2 <= 140 AND s_x1 >= l_x1 - 50 AND s_x1 <= l_x2 + 450
      AND NOT list_has_any(string_split_regex(upper(seg_text), '\\s+'), {lst(c.NAME_FORBIDDEN_TOKENS)}) AND regexp_replace(upper(seg_text), '[ .\\-X*]', '', 'g') <> ''
      AND regexp_matches(upper(seg_text), '^[A-Z][A-Z .''-]*(?:\\s+[A-Z][A-Z .''-]*)+$')) WHERE n = 1""")
part("picked", "bestpair holder", """SELECT screen_id, CASE WHEN inferred THEN 'ACCOUNT_HOLDER_NAME' ELSE entity_type END AS pii_type, value, combined, l_line, l_first, l_size, inferred,
    line_text, line_start, seg_text FROM (SELECT screen_id, entity_type, value, combined, l_line, l_first, l_size, inferred, line_text, line_start, seg_text FROM bestpair
    UNION ALL SELECT screen_id, entity_type, upper(seg_text), combined, l_line, l_first, l_size, true, line_text, line_start, seg_text FROM holder)""")
part("layent", "picked", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY screen_id, pii_type, lower(regexp_replace(value, '[\\s,\\-]+', '', 'g'))
    ORDER BY combined DESC, l_line, l_first, l_size, inferred) AS n FROM picked) WHERE n = 1""".replace("\\\\", "\\"))
