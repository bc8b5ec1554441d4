"""The expected result of every query as one DuckDB statement, written from the rules rather than from the jobs."""

from __future__ import annotations

import re

from hostvigil.functions import dims
from hostvigil.functions import patterns as p
from hostvigil.plans.fixtures import ADAPTERS, COOLDOWN, DOCUMENT_LABELS, LINE_LABELS, NEEDS, TRAFFIC, WINDOW


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def rx(col: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({col}, {q(flags + pattern)})"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def tokens(expr: str, digits: int | None = None) -> str:
    words = f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return words if digits is None else f"list_transform({words}, lambda x: left(md5(x), {digits}))"


# Named pieces: name -> (pieces it needs, SELECT).
PIECES: dict[str, tuple[list[str], str]] = {n: (NEEDS.get(n, []), sql.strip()) for n, sql in ADAPTERS.items()}


def piece(name: str, needs: list[str], sql: str) -> None:
    PIECES[name] = (needs, sql.strip())


def statement(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in PIECES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({PIECES[n][1]})' for n in order)} {select.strip()}"


# --- triage ---
piece("pattern_dim", [], values(enumerate(p.BENIGN_PATTERNS), "pattern_id, pattern"))
piece("keyword_dim", [], values([(i, k.lower(), re.escape(k)) for i, k in enumerate(p.OVERRIDE_KEYWORDS)], "keyword_id, keyword, shown"))


def prefilter(name: str, source: str) -> None:
    hit = " ".join(f"WHEN {rx('raw_line', x)} THEN {i}" for i, x in enumerate(p.BENIGN_PATTERNS))
    word = " ".join(f"WHEN contains(lower(raw_line), {q(k.lower())}) THEN {i}" for i, k in enumerate(p.OVERRIDE_KEYWORDS))
    piece(name + "_hits", [source], f"SELECT *, trim(raw_line) = '' AS is_blank, CASE {hit} END AS hit, CASE {word} END AS word FROM {source}")
    piece(
        name,
        [name + "_hits", "pattern_dim", "keyword_dim"],
        f"""
SELECT h.*, CASE WHEN is_blank THEN 'BENIGN' WHEN hit IS NULL THEN 'PASS_TO_AI' WHEN word IS NULL THEN 'BENIGN' ELSE 'SUSPICIOUS' END AS pre_decision,
  CASE WHEN is_blank THEN 'Empty log line' WHEN hit IS NULL THEN 'No benign pattern matched, requires AI analysis'
       WHEN word IS NULL THEN 'Matched benign pattern: ' || pattern
       ELSE 'Benign pattern matched but suspicious keyword detected: ' || shown END AS pre_reason,
  CASE WHEN is_blank THEN NULL ELSE pattern END AS matched_pattern
FROM {name}_hits h LEFT JOIN pattern_dim ON hit = pattern_id LEFT JOIN keyword_dim ON word = keyword_id""",
    )


def payload(name: str, source: str) -> None:
    noisy = any_of(
        ["trim(raw_line) = ''"]
        + [f"contains(lower(raw_line), {q(s)})" for s in p.NOISE_SUBSTRINGS]
        + [rx("raw_line", x) for x in p.NOISE_PATTERNS + p.EXTRA_NOISE_PATTERNS]
    )

    def src(*parts: str) -> str:
        return any_of([f"contains(lower(source_log), {q(s)})" for s in parts])

    def part(pattern: str) -> str:
        return f"regexp_extract(line, {q(pattern)}, 1)"

    login = any_of([src("auth", "secure"), "contains(line, 'sshd')"])
    found = f"""CASE
  WHEN {src('access', 'nginx', 'apache')} AND {rx('line', p.QUOTED_REQUEST, '')} THEN {part(p.QUOTED_REQUEST)}
  WHEN {login} AND {rx('line', p.SSHD_MESSAGE, '')} THEN {part(p.SSHD_MESSAGE)}
  WHEN {login} AND {rx('line', p.SUDO_MESSAGE, '')} THEN {part(p.SUDO_MESSAGE)}
  WHEN {src('fail2ban')} AND {rx('line', p.FAIL2BAN_MESSAGE, '')} THEN {part(p.FAIL2BAN_MESSAGE)}
  WHEN {src('audit')} AND {rx('line', p.AUDIT_EXECUTABLE, '')} THEN 'Executed binary: ' || {part(p.AUDIT_EXECUTABLE)}
  WHEN {any_of([rx('line', x) for x in p.SECURITY_PATTERNS])} THEN regexp_replace(line, {q(p.SYSLOG_PREFIX)}, '') END"""
    piece(
        name,
        [source],
        f"""
SELECT * EXCLUDE (found, line), CASE WHEN noisy OR trim(found) = '' THEN NULL WHEN length(trim(found)) > 1000 THEN left(trim(found), 1000) || ' [TRUNCATED]' ELSE trim(found) END AS clean_text
FROM (SELECT *, {found} AS found FROM (SELECT *, trim(raw_line) AS line, {noisy} AS noisy FROM {source}))""",
    )


prefilter("pre", "fx_triage")
payload("clean", "fx_triage")
prefilter("pre_sys", "fx_syslog")
payload("clean_sys", "pre_sys")

# --- requests ---
piece(
    "req",
    ["fx_access"],
    f"""
SELECT seq, ts, hostname, regexp_extract(raw_line, {q(p.ACCESS_LINE)}, 1) AS ip, split_part(regexp_extract(raw_line, {q(p.ACCESS_LINE)}, 3), '?', 1) AS endpoint,
  regexp_extract(raw_line, {q(p.ACCESS_LINE)}, 2) AS method, CAST(regexp_extract(raw_line, {q(p.ACCESS_LINE)}, 4) AS BIGINT) AS status
FROM fx_access WHERE {rx('raw_line', p.ACCESS_LINE, '')}""",
)
piece(
    "pairs",
    ["req"],
    f"""
SELECT e.hostname, e.seq, e.ts, x.seq AS xseq, x.ts AS xts, x.ip, x.endpoint, x.status FROM req e JOIN req x
ON e.hostname = x.hostname AND x.ts >= e.ts - INTERVAL {WINDOW} SECOND AND (x.ts < e.ts OR (x.ts = e.ts AND x.seq <= e.seq))""",
)


def report_pieces(prefix: str, pairs: str, key: str, seconds: int) -> None:
    for what in ("ip", "endpoint"):
        piece(
            f"{prefix}_{what}",
            [pairs],
            f"""
SELECT {key}, {what}, n FROM (SELECT {key}, {what}, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(xts), min(xseq)) AS r
FROM {pairs} GROUP BY {key}, {what}) WHERE r = 1""",
        )
    piece(
        f"{prefix}_windows",
        [pairs, f"{prefix}_ip", f"{prefix}_endpoint"],
        f"""
SELECT t.*, i.ip AS top_ip, i.n AS top_ip_requests, p.endpoint AS top_endpoint, p.n AS top_endpoint_requests
FROM (SELECT {key}, any_value(ts) AS ts, count(*) AS total_requests, round(count(*) / CAST({seconds} AS DOUBLE), 2) AS requests_per_second,
   count(*) FILTER (WHERE xts >= ts - INTERVAL {TRAFFIC['minute']} SECOND) AS requests_per_minute, count(DISTINCT ip) AS unique_ips,
   count(*) FILTER (WHERE status >= 400) AS error_requests FROM {pairs} GROUP BY {key}) t
JOIN {prefix}_ip i USING ({key}) JOIN {prefix}_endpoint p USING ({key})""",
    )
    r, i, e, m = (TRAFFIC[k] for k in ("request_threshold", "ip_threshold", "endpoint_threshold", "min_ips"))
    piece(
        f"{prefix}_report",
        [f"{prefix}_windows"],
        f"""
SELECT *, risk_level IN ('HIGH', 'CRITICAL') AS is_anomaly FROM (
SELECT *, CASE WHEN len(found) = 0 THEN 'NORMAL' WHEN total_requests >= {2 * r} OR len(found) >= 2 THEN 'CRITICAL'
  WHEN total_requests >= {r} OR top_ip_requests >= {i} THEN 'HIGH' ELSE 'SUSPICIOUS' END AS risk_level FROM (
SELECT *, list_filter([
  CASE WHEN top_ip_requests >= {i} THEN 'Single IP Flood (' || top_ip || ' sent ' || top_ip_requests || ' req/{seconds}s)' END,
  CASE WHEN total_requests >= {r} AND unique_ips >= {m} THEN 'Distributed DDoS (' || unique_ips || ' unique IPs sent ' || total_requests || ' req/{seconds}s)' END,
  CASE WHEN top_endpoint_requests >= {e} THEN 'Targeted Endpoint Flood (' || top_endpoint || ' received ' || top_endpoint_requests || ' req/{seconds}s)' END,
  CASE WHEN total_requests >= {2 * r} THEN 'Sudden Traffic Spike (' || total_requests || ' req/{seconds}s)' END,
  CASE WHEN error_requests >= {r / 2} THEN 'High HTTP Error Rate (' || error_requests || ' error responses in window)' END], lambda x: x IS NOT NULL) AS found
FROM {prefix}_windows))""",
    )


report_pieces("each", "pairs", "hostname, seq", WINDOW)
piece(
    "now_pairs",
    ["req"],
    f"""
SELECT hostname, (SELECT max(ts) FROM req) AS ts, seq AS xseq, ts AS xts, ip, endpoint, status FROM req
WHERE ts >= (SELECT max(ts) FROM req) - INTERVAL {WINDOW} SECOND""",
)
report_pieces("now", "now_pairs", "hostname", WINDOW)


# --- greedy cooldown: successor of every row, then the chain from each key's first row ---
def cooldown(name: str, source: str, keys: list[str], seconds: int = COOLDOWN) -> None:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    using = " AND ".join(f"c.{k} = n.{k}" for k in keys)
    piece(
        f"{name}_next",
        [source],
        f"SELECT {cols}, a.seq, b.seq AS next_seq FROM {source} a ASOF LEFT JOIN {source} b ON {same} AND a.ts + INTERVAL {seconds} SECOND <= b.ts",
    )
    piece(
        f"{name}_chain",
        [f"{name}_next"],
        f"""
SELECT {', '.join(keys)}, seq, next_seq FROM (SELECT n.*, row_number() OVER (PARTITION BY {', '.join('n.' + k for k in keys)} ORDER BY s.ts, s.seq) AS r
 FROM {name}_next n JOIN {source} s ON s.seq = n.seq AND {' AND '.join(f's.{k} = n.{k}' for k in keys)}) WHERE r = 1
UNION ALL SELECT {', '.join('n.' + k for k in keys)}, n.seq, n.next_seq FROM {name}_chain c JOIN {name}_next n ON {using} AND n.seq = c.next_seq""",
    )
    piece(name, [source, f"{name}_chain"], f"SELECT s.* FROM {source} s SEMI JOIN {name}_chain c ON s.seq = c.seq AND {' AND '.join(f's.{k} = c.{k}' for k in keys)}")


# --- predictions and decisions ---
SEVERITY_CASE = "CASE " + " ".join(f"WHEN {{0}} IN {names(v)} THEN {q(s)}" for s, v in dims.SEVERITY_LABELS.items()) + " ELSE 'MEDIUM' END"
ORDER_LIST = "[" + ", ".join(q(s) for s in dims.SEVERITY_ORDER) + "]"


def decided(name: str, source: str, needs: list[str]) -> None:
    piece(
        name,
        needs,
        f"""
SELECT *, CASE WHEN decision = 'ALERT' THEN CASE WHEN list_position({ORDER_LIST}, risk_level) > list_position({ORDER_LIST}, severity) THEN risk_level ELSE severity END
  WHEN decision = 'LOG_ONLY' THEN 'SAFE' END AS risk, CASE decision WHEN 'ALERT' THEN 'new' WHEN 'LOG_ONLY' THEN 'low_confidence' END AS status FROM (
SELECT *, decision = 'ALERT' AS is_attack,
  CASE WHEN decision = 'IGNORE' THEN 'SAFE' WHEN decision = 'LOG_ONLY' THEN 'UNKNOWN'
   WHEN norm < 0.85 THEN CASE WHEN base IN ('HIGH', 'CRITICAL') THEN base ELSE 'MEDIUM' END
   WHEN norm < 0.95 THEN CASE WHEN base = 'CRITICAL' THEN base ELSE 'HIGH' END
   ELSE CASE WHEN base IN ('LOW', 'MEDIUM') THEN 'HIGH' ELSE 'CRITICAL' END END AS severity,
  decision = 'ALERT' AND (norm >= 0.85 OR base IN ('HIGH', 'CRITICAL')) AS email_required,
  CASE WHEN prediction = 'Benign' THEN CASE WHEN confidence >= 0.70 THEN 'SAFE' ELSE 'LOW' END WHEN confidence < 0.70 THEN 'SAFE'
   WHEN base = 'HIGH' AND confidence >= 0.90 AND (contains(lower(clean_text), '/etc/shadow') OR contains(lower(clean_text), '/etc/passwd')
     OR contains(lower(clean_text), 'root') OR contains(lower(clean_text), '/var/run/docker.sock')) THEN 'CRITICAL' ELSE base END AS risk_level
FROM (SELECT *, CASE WHEN prediction = 'Benign' OR norm < 0.40 THEN 'IGNORE' WHEN norm < 0.70 THEN 'LOG_ONLY' ELSE 'ALERT' END AS decision
 FROM (SELECT *, {SEVERITY_CASE.format('prediction')} AS base,
  CASE WHEN confidence > 1 THEN confidence / CAST(100 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), confidence)) END AS norm FROM {source})))""",
    )


decided("decided", "fx_pred", ["fx_pred"])
piece("incident", ["decided"], "SELECT * FROM decided WHERE decision <> 'IGNORE'")
piece("gated", ["incident"], "SELECT * FROM incident WHERE risk IN ('HIGH', 'CRITICAL') AND confidence >= 0.55")
cooldown("sec_alert", "gated", ["hostname", "prediction", "source_log"])
piece("flood", ["each_report"], "SELECT * FROM each_report WHERE is_anomaly")
cooldown("flood_sent", "flood", ["hostname", "top_ip"])

# --- metrics ---
piece("limits", [], values([(m, w, c) for m, (w, c) in dims.METRIC_LIMITS.items()], "metric, warning, critical"))
piece(
    "states",
    ["fx_metrics", "limits"],
    "SELECT m.*, warning, critical, CASE WHEN current_value >= critical THEN 'CRITICAL' WHEN current_value >= warning THEN 'WARNING' ELSE 'NORMAL' END AS state FROM fx_metrics m JOIN limits USING (metric)",
)
piece(
    "trans",
    ["states"],
    """
SELECT seq, ts, hostname, metric, current_value, old_state, state AS new_state, CASE state WHEN 'NORMAL' THEN 'RECOVERY' ELSE metric || '_' || state END AS event_type,
  CASE state WHEN 'CRITICAL' THEN critical ELSE warning END AS threshold
FROM (SELECT *, lag(state, 1, 'NORMAL') OVER (PARTITION BY hostname, metric ORDER BY ts, seq) AS old_state FROM states) WHERE state <> old_state""",
)
piece(
    "cand",
    ["trans"],
    """
SELECT seq, ts, hostname, metric, metric || CASE new_state WHEN 'WARNING' THEN '_HIGH' ELSE '_CRITICAL' END AS alert_type, new_state AS severity, current_value, threshold,
  'ResourceMonitor:' || metric AS source FROM trans WHERE new_state <> 'NORMAL'""",
)
cooldown("res_alert", "cand", ["hostname", "alert_type", "metric"])
piece(
    "lifecycle",
    ["res_alert", "trans"],
    """
SELECT a.*, CASE WHEN r.resolved_at IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status, r.resolved_at FROM res_alert a
LEFT JOIN (SELECT a.seq, a.alert_type, min(t.ts) AS resolved_at FROM res_alert a JOIN trans t ON t.hostname = a.hostname AND t.metric = a.metric AND t.event_type = 'RECOVERY'
  AND (t.ts > a.ts OR (t.ts = a.ts AND t.seq > a.seq)) GROUP BY a.seq, a.alert_type) r ON a.seq = r.seq AND a.alert_type = r.alert_type
UNION ALL SELECT seq, ts, hostname, metric, 'RECOVERY', 'NORMAL', current_value, threshold, 'ResourceMonitor:' || metric, 'RESOLVED', CAST(NULL AS TIMESTAMP) FROM trans WHERE event_type = 'RECOVERY'""",
)
piece(
    "mailable",
    ["flood_sent", "res_alert", "sec_alert"],
    """
SELECT hostname, seq, ts, 'DDOS_DETECTED' AS alert_type, 'DDoSDetector' AS email_key FROM flood_sent
UNION ALL SELECT hostname, seq, ts, alert_type, 'ResourceMonitor (' || metric || ')' FROM res_alert
UNION ALL SELECT hostname, seq, ts, 'SECURITY_ATTACK', prediction || ':' || source_log FROM sec_alert""",
)
cooldown("mailed", "mailable", ["hostname", "alert_type", "email_key"])

# --- labelled text ---
piece("even", ["fx_dirty"], "SELECT * FROM fx_dirty WHERE ord % 2 = 0")
piece("all_samples", ["fx_dirty"], "SELECT * FROM fx_dirty WHERE ord % 2 = 0 UNION ALL SELECT * FROM fx_dirty WHERE ord % 2 = 1 UNION ALL SELECT * FROM fx_dirty WHERE ord % 4 = 0")
piece("built", ["all_samples"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS r FROM all_samples) WHERE r = 1 AND label IS NOT NULL AND trim(text) <> ''")


def split(name: str, source: str) -> None:
    piece(
        name,
        [source],
        f"""
SELECT * EXCLUDE (r, n), CASE WHEN (r - 1) * 10 < 8 * n THEN 'train' WHEN (r - 1) * 10 < 9 * n THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(ord AS VARCHAR))) AS r, count(*) OVER (PARTITION BY label) AS n FROM {source})""",
    )


split("parts", "fx_labeled")


def bayes(name: str, train: str, docs: str, labels: list[str] | None, live: bool = False) -> None:
    """Pieces <name>_model (token, label, n, logp) and <name>_rank (id, label, score, rank); docs is (id, text).

    A live model hashes tokens and reads 512 characters of a line.
    """
    digits, read = (4, "left(text, 512)") if live else (None, "text")
    piece(f"{name}_labels", [train], f"SELECT unnest([{', '.join(q(x) for x in labels)}]) AS label" if labels else f"SELECT DISTINCT label FROM {train}")
    piece(f"{name}_words", [train], f"SELECT label, unnest({tokens('text', digits)}) AS token FROM {train}")
    piece(f"{name}_vocab", [f"{name}_words"], f"SELECT DISTINCT token FROM {name}_words")
    piece(
        f"{name}_class",
        [train, f"{name}_labels", f"{name}_words", f"{name}_vocab"],
        f"""
SELECT l.label, CAST((SELECT count(*) FROM {name}_words w WHERE w.label = l.label) + (SELECT count(*) FROM {name}_vocab) AS DOUBLE) AS denominator,
  (SELECT count(*) FROM {train} t WHERE t.label = l.label) / CAST((SELECT count(*) FROM {train}) AS DOUBLE) AS share FROM {name}_labels l""",
    )
    piece(
        f"{name}_model",
        [f"{name}_vocab", f"{name}_class", f"{name}_words"],
        f"""
SELECT v.token, c.label, coalesce(k.n, 0) AS n, ln(CAST(coalesce(k.n, 0) + 1 AS DOUBLE) / c.denominator) AS logp FROM {name}_vocab v CROSS JOIN {name}_class c
LEFT JOIN (SELECT token, label, count(*) AS n FROM {name}_words GROUP BY token, label) k ON k.token = v.token AND k.label = c.label""",
    )
    piece(
        f"{name}_rank",
        [docs, f"{name}_model", f"{name}_class"],
        f"""
SELECT id, label, round(exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY id), 4) AS score, row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, label) AS rank FROM (
SELECT id, label, s, max(s) OVER (PARTITION BY id) AS top FROM (
SELECT d.id, c.label, coalesce(m.s, CAST(0 AS DOUBLE)) + CASE WHEN c.share = 0 THEN CAST('-infinity' AS DOUBLE) ELSE ln(c.share) END AS s FROM {docs} d CROSS JOIN {name}_class c
LEFT JOIN (SELECT id, label, sum(logp) AS s FROM (SELECT id, unnest({tokens(read, digits)}) AS token FROM {docs}) JOIN {name}_model USING (token) GROUP BY id, label) m
 ON m.id = d.id AND m.label = c.label))""",
    )


piece("doc_rows", ["fx_labeled"], "SELECT ord AS id, text FROM fx_labeled")
piece("train_part", ["parts"], "SELECT * FROM parts WHERE split = 'train'")
piece("test_rows", ["parts"], "SELECT ord AS id, text FROM parts WHERE split = 'test'")
bayes("doc", "train_part", "doc_rows", DOCUMENT_LABELS)
piece("line_rows", ["clean_sys"], "SELECT seq AS id, clean_text AS text FROM clean_sys WHERE pre_decision <> 'BENIGN' AND clean_text IS NOT NULL")
bayes("line", "fx_train", "line_rows", LINE_LABELS, live=True)
piece("scored_lines", ["clean_sys", "line_rank"], "SELECT c.*, r.label AS prediction, r.score AS confidence FROM clean_sys c JOIN line_rank r ON r.id = c.seq AND r.rank = 1")
decided("line_decided", "scored_lines", ["scored_lines"])
piece(
    "routed",
    ["clean_sys", "line_decided"],
    """
SELECT c.seq, c.ts, c.hostname, c.source_log, c.pre_decision, CASE WHEN c.pre_decision = 'BENIGN' THEN NULL ELSE c.clean_text END AS clean_text,
  CASE WHEN c.pre_decision = 'BENIGN' THEN 'BENIGN' WHEN d.seq IS NULL THEN 'NOISE' ELSE d.decision END AS route, d.prediction, d.confidence, d.decision, d.severity, d.risk_level, d.risk, d.status,
  d.decision = 'ALERT' AND d.email_required AND d.risk IN ('HIGH', 'CRITICAL') AS dispatch
FROM clean_sys c LEFT JOIN line_decided d ON c.seq = d.seq""",
)
piece("all_text", ["clean_sys"], "SELECT *  REPLACE (coalesce(clean_text, trim(raw_line)) AS clean_text) FROM clean_sys WHERE trim(raw_line) <> ''")
piece("all_rows", ["all_text"], "SELECT seq AS id, clean_text AS text FROM all_text")
bayes("adhoc", "fx_train", "all_rows", LINE_LABELS, live=True)
piece("adhoc_scored", ["all_text", "adhoc_rank"], "SELECT c.*, r.label AS prediction, r.score AS confidence FROM all_text c JOIN adhoc_rank r ON r.id = c.seq AND r.rank = 1")
decided("adhoc_decided", "adhoc_scored", ["adhoc_scored"])

# --- evaluation ---
def evaluation(name: str, source: str) -> None:
    """Pieces <name>_classes (label, support, predicted, tp, precision, recall, f1)."""
    piece(
        f"{name}_classes",
        [source],
        f"""
SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / CAST(predicted AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / CAST(support + predicted AS DOUBLE) END AS f1 FROM (
SELECT c.label, (SELECT count(*) FROM {source} s WHERE s.label = c.label) AS support, (SELECT count(*) FROM {source} s WHERE s.predicted_label = c.label) AS predicted,
  (SELECT count(*) FROM {source} s WHERE s.label = c.label AND s.predicted_label = c.label) AS tp
FROM (SELECT label FROM {source} UNION SELECT predicted_label FROM {source}) c)""",
    )


evaluation("ev", "fx_eval")
bayes("run", "train_part", "test_rows", DOCUMENT_LABELS)
piece("run_scored", ["parts", "run_rank"], "SELECT p.ord, p.label, r.label AS predicted_label, r.score AS confidence FROM parts p JOIN run_rank r ON p.ord = r.id AND r.rank = 1")
evaluation("run", "run_scored")
SUMMARY = """SELECT CAST(sum(support) AS BIGINT) AS samples, round(sum(tp) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
 round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM {0}_classes"""

# --- review and retraining ---
piece(
    "reviewed",
    ["fx_review", "fx_verdicts"],
    """
SELECT r.* EXCLUDE (status, reviewed_label), coalesce(CASE v.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END, r.status) AS status, coalesce(a.label, r.reviewed_label) AS reviewed_label
FROM fx_review r LEFT JOIN (SELECT id, arg_max(action, review_seq) AS action FROM fx_verdicts GROUP BY id) v ON r.id = v.id
LEFT JOIN (SELECT id, arg_max(label, review_seq) AS label FROM fx_verdicts WHERE action = 'approve' GROUP BY id) a ON r.id = a.id""",
)
piece(
    "merged",
    ["fx_labeled", "fx_review"],
    """
SELECT origin, ord, text, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY origin, ord) AS r FROM (
SELECT 0 AS origin, ord, text, label FROM fx_labeled UNION ALL SELECT 1, CAST(id AS BIGINT), raw_log, reviewed_label FROM fx_review WHERE status = 'approved')) WHERE r = 1""",
)
piece("merged_keyed", ["merged"], "SELECT origin || '-' || ord AS ord, text, label FROM merged")
split("cycle_parts", "merged_keyed")
piece("cycle_train", ["cycle_parts"], "SELECT * FROM cycle_parts WHERE split = 'train'")
piece("cycle_test", ["cycle_parts"], "SELECT ord AS id, text FROM cycle_parts WHERE split = 'test'")
bayes("cycle", "cycle_train", "cycle_test", None)
piece("cycle_scored", ["cycle_parts", "cycle_rank"], "SELECT p.label, r.label AS predicted_label FROM cycle_parts p JOIN cycle_rank r ON p.ord = r.id AND r.rank = 1")
evaluation("cycle", "cycle_scored")
# --- streams ---
piece(
    "arrivals",
    ["fx_syslog"],
    """
SELECT seq, ts, hostname, least(3, CAST(floor(4 * (epoch_us(ts) - lo) / CAST(hi - lo + 1 AS DOUBLE)) AS BIGINT) + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END) AS segment
FROM fx_syslog, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM fx_syslog)""",
)
LATE_HOURS = 48

_TRI = "SELECT seq, pre_decision AS decision, pre_reason AS reason, matched_pattern FROM pre"
_REPORT = "SELECT hostname, seq, {0} FROM each_report"
_ATTACK_SOURCE = "regexp_extract(source_log, '([a-z0-9]+)\\.log$', 1)"
_LINES = f"SELECT {_ATTACK_SOURCE} AS source, trim(raw_line) AS raw_line FROM fx_syslog WHERE trim(raw_line) <> ''"
_ROUTED = "SELECT seq, pre_decision, clean_text, route, prediction, confidence, severity, risk, status, coalesce(dispatch, false) AS dispatch FROM routed"


def oracle_sql() -> dict[str, str]:
    s = statement
    label_ids = "SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM {0})"
    advice = values(dims.ADVICE.items(), "label, recommendation")
    weights = values([(k, float(v)) for k, v in dims.WEIGHTS.items()], "label, weight")
    alt = "CASE " + " ".join(f"WHEN prediction IN {names(dims.SEVERITY_LABELS[k])} THEN {q(k)}" for k in ("CRITICAL", "HIGH", "SAFE")) + " ELSE 'MEDIUM' END"
    weighted = f"""SELECT seq, CASE WHEN prediction = 'Benign' THEN CAST(round(CAST(CAST((1 - confidence) * 15 AS VARCHAR) AS DECIMAL(30, 18)), 2) AS DOUBLE) ELSE pct END AS risk_pct,
      CASE WHEN prediction = 'Benign' THEN 'SAFE' WHEN pct >= 85 THEN 'CRITICAL' WHEN pct >= 65 THEN 'HIGH' WHEN pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
      FROM (SELECT *, CAST(round(CAST(CAST(least((confidence * CAST(0.7 AS DOUBLE) + coalesce(weight, CAST(0.5 AS DOUBLE)) * CAST(0.3 AS DOUBLE)) * 100, CAST(99.99 AS DOUBLE)) AS VARCHAR) AS DECIMAL(30, 18)), 2) AS DOUBLE) AS pct
      FROM (SELECT seq, prediction, norm AS confidence FROM decided) LEFT JOIN ({weights}) w ON prediction = label)"""
    unknown = """SELECT CAST(seq AS VARCHAR) AS id, ts AS timestamp, clean_text AS raw_log, prediction AS predicted_label, round(confidence, 4) AS confidence, source_log AS log_source,
      'pending' AS status, '' AS reviewed_label FROM fx_pred WHERE confidence < 0.6"""
    hours = """SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (WHERE risk = 'CRITICAL') AS critical, count(*) FILTER (WHERE risk = 'HIGH') AS high,
      count(*) FILTER (WHERE risk = 'MEDIUM') AS medium FROM incident GROUP BY 1"""
    type_case = f"CASE WHEN label IN {names(dims.SERVER_LABELS)} THEN 'Server' ELSE 'Web' END"
    toy = """SELECT seq, CASE WHEN trim(raw_line) = '' THEN 'Benign' WHEN contains(lower(t), 'xmrig') THEN 'Cryptomining' WHEN contains(lower(t), 'failed password') THEN 'SSH_BruteForce' ELSE 'Benign' END AS prediction,
      CASE WHEN trim(raw_line) = '' THEN 0.9999 ELSE CAST(50 + length(t) % 50 AS DOUBLE) / 100 END AS confidence FROM (SELECT *, left(raw_line, 512) AS t FROM fx_syslog)"""
    out = {
        # sources and sinks
        "read_log_lines": s(_LINES, "fx_syslog"),
        "stream_log_lines": s(_LINES, "fx_syslog"),
        "read_labeled_dataset": s("SELECT text, label FROM fx_dirty WHERE label IS NOT NULL AND trim(text) <> ''", "fx_dirty"),
        "read_review_queue": s("SELECT * FROM fx_review", "fx_review"),
        "write_dataset": s(
            "SELECT 'csv' AS format, text, label FROM built UNION ALL SELECT 'json', text, label FROM built", "built"
        ),
        "write_predictions": s(
            "SELECT 'predictions' AS part, * FROM fx_eval UNION ALL SELECT 'misclassified', * FROM fx_eval WHERE label <> predicted_label", "fx_eval"
        ),
        "append_security_tables": s(
            """SELECT table_name, n, n AS ids FROM (SELECT 'attack_logs' AS table_name, count(*) AS n FROM incident UNION ALL SELECT 'security_events', count(*) FROM incident
            UNION ALL SELECT 'alerts', (SELECT count(*) FROM sec_alert) + (SELECT count(*) FROM flood_sent) + (SELECT count(*) FROM lifecycle)
            UNION ALL SELECT 'resource_alerts', count(*) FROM res_alert UNION ALL SELECT 'ddos_events', count(*) FROM flood_sent
            UNION ALL SELECT 'security_decisions', count(*) FROM decided
            UNION ALL SELECT 'system_health', count(*) FROM (SELECT DISTINCT hostname, date_trunc('hour', ts) FROM fx_metrics))""",
            "incident", "sec_alert", "flood_sent", "lifecycle", "res_alert", "decided", "fx_metrics",
        ),
        "stored_alerts": s(
            """SELECT *, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS dt, true AS complete FROM (
            SELECT hostname, seq, ts AS timestamp, alert_type, severity, source, status, resolved_at FROM lifecycle
            UNION ALL SELECT hostname, seq, ts, 'DDOS_DETECTED', risk_level, 'DDoSDetector', 'ACTIVE', CAST(NULL AS TIMESTAMP) FROM flood_sent
            UNION ALL SELECT hostname, seq, ts, 'SECURITY_ATTACK', risk, source_log, 'ACTIVE', CAST(NULL AS TIMESTAMP) FROM sec_alert)""",
            "lifecycle", "flood_sent", "sec_alert",
        ),
        "dual_write_events": s("SELECT t.name AS table_name, seq, prediction, risk, status FROM incident, (VALUES ('attack_logs'), ('security_events')) AS t(name)", "incident"),
        "label_map": s("SELECT label_id, label FROM (" + label_ids.format("(SELECT prediction AS label FROM fx_pred)") + ")", "fx_pred"),
        "metrics_json": s("SELECT seq, prediction, round(confidence * 100, 2) AS confidence_percent, source_log AS source, CAST(seq AS VARCHAR) AS plain FROM fx_pred", "fx_pred"),
        # projections
        "prefilter_classify": s(_TRI, "pre"),
        "prefilter_disabled": s("SELECT seq, 'PASS_TO_AI' AS decision, 'Pre-filter disabled' AS reason, CAST(NULL AS VARCHAR) AS matched_pattern FROM fx_triage", "fx_triage"),
        "noise_filter": s("SELECT seq, raw_line FROM clean WHERE NOT noisy", "clean"),
        "extract_clean_text": s("SELECT seq, clean_text FROM clean", "clean"),
        "sanitize_text": s(
            "SELECT seq, CASE WHEN length(trim(raw_line)) > 1000 THEN left(trim(raw_line), 1000) || ' [TRUNCATED]' ELSE trim(raw_line) END AS text FROM fx_triage", "fx_triage"
        ),
        "parse_access_log": s("SELECT seq, hostname, ip, endpoint, method, status FROM req", "req"),
        "normalize_confidence": s("SELECT seq, norm AS confidence FROM decided", "decided"),
        "security_decision": s("SELECT seq, decision, is_attack, prediction AS label, norm AS confidence, severity, email_required FROM decided", "decided"),
        "decision_passthrough": s(
            """SELECT seq, CASE WHEN prediction = 'Benign' THEN 'IGNORE' ELSE 'ALERT' END AS decision, CASE WHEN prediction = 'Benign' THEN 'SAFE' ELSE base END AS severity,
            prediction <> 'Benign' AND base IN ('HIGH', 'CRITICAL') AS email_required, 'Security Decision Engine disabled — passthrough mode' AS reason FROM decided""", "decided"
        ),
        "risk_level": s("SELECT seq, risk_level FROM decided", "decided"),
        "weighted_risk": s(weighted, "decided"),
        "final_severity": s("SELECT seq, severity, risk_level, risk AS final_severity FROM decided WHERE decision = 'ALERT'", "decided"),
        "flag_unknown": s(
            "SELECT seq, prediction <> 'Benign' AS is_malicious, confidence < 0.6 AND prediction <> 'Benign' AS is_unknown, confidence < 0.6 AS is_unknown_any FROM fx_pred", "fx_pred"
        ),
        "queue_unknown": s(unknown + " AND prediction <> 'Benign'", "fx_pred"),
        "metric_state": s("SELECT seq, state FROM states", "states"),
        "overall_severity": s(
            """SELECT hostname, date_trunc('hour', ts) AS tick, CASE WHEN bool_or(state = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(state = 'WARNING') THEN 'WARNING' ELSE 'NORMAL' END AS overall_severity
            FROM states GROUP BY ALL""", "states"
        ),
        "alert_gate": s("SELECT seq, prediction, risk FROM gated", "gated"),
        "triage_pipeline": s(_ROUTED, "routed"),
        "triage_pipeline_one_pass": s(_ROUTED, "routed"),
        "analyze_on_demand": s(
            """SELECT seq, pre_decision, clean_text, prediction, confidence, round(confidence * 100, 2) AS risk_percentage, decision, severity, risk_level,
            CASE WHEN decision = 'ALERT' THEN severity END AS stored_risk, CASE WHEN decision = 'ALERT' THEN 'manual_eval' END AS status,
            email_required AND severity IN ('HIGH', 'CRITICAL') AS dispatch FROM adhoc_decided""", "adhoc_decided"
        ),
        "analyze_on_demand_top3": s("SELECT id AS seq, rank, label, score FROM adhoc_rank WHERE rank <= 3", "adhoc_rank"),
        "analyze_on_demand_traffic": s(
            """SELECT a.hostname, a.seq, e.total_requests, e.requests_per_minute, e.unique_ips, e.top_ip, e.top_ip_requests, e.top_endpoint, e.top_endpoint_requests, e.error_requests, e.risk_level,
            array_to_string(e.found, '; ') AS patterns, coalesce(e.is_anomaly, false) AS flood_dispatch FROM fx_access a LEFT JOIN each_report e ON a.hostname = e.hostname AND a.seq = e.seq
            WHERE trim(a.raw_line) <> ''""", "fx_access", "each_report"
        ),
        "clean_dataset_text": s("SELECT ord, text, label FROM fx_dirty WHERE label IS NOT NULL AND trim(text) <> ''", "fx_dirty"),
        "render_notifications": s(
            f"""SELECT *, true AS whole FROM (
            SELECT seq, alert_type, CASE alert_type WHEN 'RECOVERY' THEN '✅' ELSE '🚨' END || ' [' || severity || '] ' || alert_type || ' Notification - ' || hostname AS subject, CAST(NULL AS VARCHAR) AS description FROM lifecycle
            UNION ALL SELECT seq, 'DDOS_DETECTED', '🚨 [' || risk_level || '] DDOS_DETECTED Notification - ' || hostname,
              'Possible DDoS Attack detected: ' || array_to_string(found, ', ') || '. Total requests: ' || total_requests || ' in {WINDOW}s.' FROM flood_sent
            UNION ALL SELECT seq, 'SECURITY_ATTACK', '🚨 [' || risk || '] Threat Alert: ' || prediction || ' on ' || hostname,
              'Security threat ''' || prediction || ''' detected with ' || printf('%.2f', CAST(CAST(confidence AS VARCHAR) AS DECIMAL(18, 6)) * 100) || '% confidence in ''' || source_log || '''.' FROM sec_alert)""",
            "lifecycle", "flood_sent", "sec_alert",
        ),
        # joins
        "severity_lookup": s("SELECT seq, prediction, base AS base_severity FROM decided", "decided"),
        "severity_lookup_alt": s(f"SELECT seq, prediction, {alt} AS base_severity FROM fx_pred", "fx_pred"),
        "sliding_window_join": s("SELECT hostname, seq, count(*) AS n_window FROM pairs GROUP BY hostname, seq", "pairs"),
        "weight_lookup": s(f"SELECT seq, prediction, coalesce(weight, CAST(0.5 AS DOUBLE)) AS weight FROM fx_pred LEFT JOIN ({weights}) w ON prediction = label", "fx_pred"),
        "recommendation_lookup": s(
            f"SELECT seq, prediction, coalesce(recommendation, {q(dims.DEFAULT_ADVICE)}) AS recommendation FROM fx_pred LEFT JOIN ({advice}) a ON prediction = label", "fx_pred"
        ),
        "pattern_match_join": s("SELECT seq, hit AS pattern_id, pattern FROM pre_hits LEFT JOIN pattern_dim ON hit = pattern_id", "pre_hits", "pattern_dim"),
        "resolve_alerts": s("SELECT hostname, metric, seq, alert_type, status, resolved_at FROM lifecycle WHERE alert_type <> 'RECOVERY'", "lifecycle"),
        "apply_reviews": s("SELECT id, status, reviewed_label FROM reviewed", "reviewed"),
        "new_labels": s("SELECT DISTINCT reviewed_label AS label FROM fx_review WHERE status = 'approved' AND reviewed_label NOT IN (SELECT label FROM labels48)", "fx_review"),
        "tag_label_type": s(f"SELECT seq, label, {type_case} AS type FROM (SELECT seq, prediction AS label FROM fx_pred)", "fx_pred"),
        # aggregations
        "traffic_counts": s(_REPORT.format("total_requests, requests_per_second, requests_per_minute, unique_ips"), "each_report"),
        "traffic_top_ip": s(_REPORT.format("top_ip, top_ip_requests"), "each_report"),
        "traffic_top_endpoint": s(_REPORT.format("top_endpoint, top_endpoint_requests"), "each_report"),
        "traffic_error_count": s(_REPORT.format("error_requests"), "each_report"),
        "traffic_patterns": s(_REPORT.format("array_to_string(found, '; ') AS patterns"), "each_report"),
        "traffic_risk": s(_REPORT.format("risk_level, is_anomaly"), "each_report"),
        "traffic_snapshot": s(
            """SELECT hostname, total_requests, requests_per_second, requests_per_minute, unique_ips, top_ip, top_ip_requests, top_endpoint, top_endpoint_requests, error_requests,
            array_to_string(found, '; ') AS patterns, risk_level, is_anomaly FROM now_report""", "now_report"
        ),
        "statistics": s(
            """SELECT (SELECT count(*) FROM incident) AS total_incidents, (SELECT count(*) FROM flood_sent) AS total_ddos_events, (SELECT count(*) FROM res_alert) AS total_resource_alerts,
            (SELECT count(*) FROM incident WHERE ts >= (SELECT max(ts) FROM fx_pred) - INTERVAL 24 HOUR) AS last_24h_incidents""", "incident", "flood_sent", "res_alert"
        ),
        "risk_breakdown": s("SELECT " + ", ".join(f'count(*) FILTER (WHERE risk = {q(r)}) AS "{r}"' for r in dims.RISK_LEVELS) + " FROM incident", "incident"),
        "top_attack_types": s("SELECT prediction, count(*) AS cnt FROM incident WHERE prediction <> 'Benign' GROUP BY prediction ORDER BY cnt DESC, prediction LIMIT 10", "incident"),
        "last_24h": s("SELECT count(*) AS last_24h_incidents FROM incident WHERE ts >= (SELECT max(ts) FROM fx_pred) - INTERVAL 24 HOUR", "incident"),
        "label_distribution": s("SELECT label, count(*) AS count, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 2) AS percentage FROM fx_labeled GROUP BY label", "fx_labeled"),
        "server_web_ratio": s(
            f"""SELECT server_count, n - server_count AS web_count, round(server_count * CAST(100 AS DOUBLE) / n, 2) AS server_pct, round(100 - round(server_count * CAST(100 AS DOUBLE) / n, 2), 2) AS web_pct
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {type_case} = 'Server') AS server_count FROM (SELECT prediction AS label FROM fx_pred))""", "fx_pred"
        ),
        "dataset_summary": s("SELECT count(*) AS total_samples, count(DISTINCT label) AS total_classes FROM fx_labeled", "fx_labeled"),
        "weekly_report": s(
            """SELECT 'total' AS section, 'total' AS key, count(*) AS n FROM week UNION ALL SELECT 'total', k, (SELECT count(*) FROM week WHERE status = k) FROM (VALUES ('pending'), ('approved'), ('rejected')) AS v(k)
            UNION ALL SELECT * FROM (SELECT 'label', predicted_label, count(*) FROM week GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
            UNION ALL SELECT * FROM (SELECT 'source', log_source, count(*) FROM week GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""".replace(
                "week", "(SELECT * FROM fx_review WHERE timestamp >= (SELECT max(timestamp) FROM fx_review) - INTERVAL 7 DAY)"
            ), "fx_review"
        ),
        "review_stats": s(
            "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("pending", "approved", "rejected")) + " FROM fx_review", "fx_review"
        ),
        "accuracy": s("SELECT round(avg(CASE WHEN label = predicted_label THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy FROM fx_eval", "fx_eval"),
        "weighted_prf": s(
            "SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM ev_classes", "ev_classes"
        ),
        "classification_report": s(
            """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ev_classes
            UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM ev_classes
            UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM ev_classes""",
            "ev_classes",
        ),
        "confusion_matrix": s("SELECT label, predicted_label, count(*) AS n FROM fx_eval GROUP BY ALL", "fx_eval"),
        "worst_classes": s("SELECT label, round(f1, 6) AS f1, support FROM ev_classes ORDER BY 2, 1 LIMIT 5", "ev_classes"),
        "hourly_report": s(f"SELECT *, CAST(sum(total) OVER (ORDER BY hour) AS BIGINT) AS running_total FROM ({hours})", "incident"),
        "pipeline_counters": s(
            """SELECT hostname, count(*) AS processed, count(*) FILTER (WHERE route = 'BENIGN') AS benign_filtered, count(*) FILTER (WHERE route = 'ALERT') AS incidents,
            count(*) FILTER (WHERE pre_decision = 'SUSPICIOUS') AS suspicious_overrides, count(*) FILTER (WHERE pre_decision = 'PASS_TO_AI') AS passed_to_ai FROM routed GROUP BY hostname""", "routed"
        ),
        "health_snapshot": s(
            "SELECT hostname, date_trunc('hour', ts) AS tick, " + ", ".join(f"arg_max(current_value, ts) FILTER (WHERE metric = '{m}') AS {m.lower()}_percent" for m in dims.METRIC_LIMITS)
            + " FROM fx_metrics GROUP BY ALL", "fx_metrics"
        ),
        # ordered state
        "cooldown_dedup": s("SELECT event_type, seq, ts FROM dedup", "dedup"),
        "email_dedup": s(
            "SELECT hostname, seq, alert_type, email_key FROM mailed UNION ALL SELECT hostname, seq, 'RECOVERY', 'ResourceMonitor (' || metric || ')' FROM trans WHERE event_type = 'RECOVERY'", "mailed", "trans"
        ),
        "metric_transitions": s("SELECT * FROM trans", "trans"),
        "metric_recoveries": s("SELECT * FROM trans WHERE event_type = 'RECOVERY'", "trans"),
        "resource_alerts": s("SELECT * FROM res_alert", "res_alert"),
        "dedup_keep_first": s("SELECT ord, text, label FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS r FROM fx_labeled) WHERE r = 1", "fx_labeled"),
        "stratified_split": s("SELECT ord, label, split FROM parts", "parts"),
        "topk_predictions": s("SELECT id AS ord, rank, label, score FROM doc_rank WHERE rank <= 3", "doc_rank"),
        "surrogate_id": s("SELECT hostname, count(*) AS n, count(*) AS ids FROM fx_pred GROUP BY hostname", "fx_pred"),
        "alert_lifecycle": s("SELECT hostname, metric, seq, ts, alert_type, severity, current_value, threshold, source, status, resolved_at FROM lifecycle", "lifecycle"),
        "traffic_alerts": s(
            f"""SELECT hostname, seq, array_to_string(found, '; ') AS pattern_type, total_requests AS requests_count, top_ip, top_endpoint, risk_level,
            'Possible DDoS Attack detected: ' || array_to_string(found, ', ') || '. Total requests: ' || total_requests || ' in {WINDOW}s.' AS description FROM flood_sent""", "flood_sent"
        ),
        "security_alerts": s("SELECT hostname, seq, 'SECURITY_ATTACK' AS alert_type, risk AS severity, source_log AS source, prediction, clean_text AS raw_log FROM sec_alert", "sec_alert"),
        # sorts and limits
        "recent_incidents": s("SELECT seq, hostname, prediction, risk, status FROM incident WHERE risk IN ('MEDIUM', 'HIGH', 'CRITICAL') ORDER BY ts DESC, seq DESC LIMIT 50", "incident"),
        "active_alerts": s("SELECT hostname, seq, alert_type, severity FROM lifecycle WHERE status = 'ACTIVE'", "lifecycle"),
        "recent_decisions": s(
            "SELECT * FROM (SELECT seq, decision, severity, email_required FROM decided WHERE decision = 'ALERT' ORDER BY ts DESC, seq DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT seq, decision, severity, email_required FROM decided WHERE decision = 'IGNORE' ORDER BY ts DESC, seq DESC LIMIT 50)", "decided"
        ),
        "pending_reviews": s("SELECT id, raw_log, predicted_label FROM fx_review WHERE status = 'pending'", "fx_review"),
        "shuffle_rows": s("SELECT ord, md5('42:' || CAST(ord AS VARCHAR)) AS order_key FROM fx_labeled", "fx_labeled"),
        # sets
        "union_datasets": s("SELECT * FROM all_samples", "all_samples"),
        "build_dataset": s(f"SELECT ord, text, label, md5('42:' || CAST(ord AS VARCHAR)) AS order_key, {type_case} AS type FROM built", "built"),
        "retrain_merge": s("SELECT m.*, label_id FROM merged m JOIN (" + label_ids.format("merged") + ") USING (label)", "merged"),
        "export_approved": s("SELECT raw_log AS text, reviewed_label AS label, confidence, log_source, timestamp, status FROM fx_review WHERE status = 'approved'", "fx_review"),
        # classification
        "label_encode": s("SELECT ord, label, label_id FROM fx_labeled JOIN (" + label_ids.format("fx_labeled") + ") USING (label)", "fx_labeled"),
        "tokenize": s(f"SELECT ord, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS position, unnest(t) AS token FROM (SELECT ord, list_slice({tokens('text')}, 1, 256) AS t FROM fx_labeled)", "fx_labeled"),
        "nb_train": s("SELECT token, label, round(logp, 6) AS logp FROM doc_model UNION ALL SELECT '', label, round(ln(share), 6) FROM doc_class", "doc_model", "doc_class"),
        "nb_score": s("SELECT id AS ord, label AS prediction, score AS confidence FROM doc_rank WHERE rank = 1", "doc_rank"),
        "lr_train_score": s(
            """SELECT p.label, count(*) AS n, true AS floor_met, true AS on_scale FROM parts p JOIN doc_rank r ON r.id = p.ord AND r.rank = 1
            WHERE split = 'test' GROUP BY p.label""", "parts", "doc_rank"
        ),
        "predict_guards": s(
            """SELECT c.seq, coalesce(r.label, 'Benign') AS prediction, coalesce(r.score, CAST(0.9999 AS DOUBLE)) AS confidence FROM fx_syslog c LEFT JOIN guard_rank r ON r.id = c.seq AND r.rank = 1""", "fx_syslog", "guard_rank"
        ),
        "score_with_udf": s(toy, "fx_syslog"),
        "evaluate_run": s(SUMMARY.format("run"), "run_classes"),
        "model_registry": s(SUMMARY.format("run"), "run_classes"),
        "predict_and_flag": s(
            """SELECT CAST(id AS VARCHAR) AS id, text AS raw_log, label AS predicted_label, score AS confidence, 'pending' AS status FROM doc_rank JOIN doc_rows USING (id) WHERE rank = 1 AND score < 0.6""", "doc_rank"
        ),
        "retrain_cycle": s(SUMMARY.format("cycle"), "cycle_classes"),
        # streams
        "stream_triage": s(_ROUTED, "routed"),
        "stream_traffic_windows": s(
            """SELECT window_start, hostname, total_requests, unique_ips, error_requests, top_ip, top_ip_requests, top_endpoint, top_endpoint_requests, risk_level, is_anomaly, array_to_string(found, '; ') AS patterns
            FROM slide_report""", "slide_report"
        ),
        "stream_cooldown": s("SELECT event_type, seq FROM dedup", "dedup"),
        "stream_counters": s(
            """SELECT count(*) AS processed, count(*) FILTER (WHERE route = 'BENIGN') AS benign_filtered, count(*) FILTER (WHERE route = 'ALERT') AS incidents,
            count(*) FILTER (WHERE pre_decision = 'SUSPICIOUS') AS suspicious_overrides, count(*) FILTER (WHERE pre_decision = 'PASS_TO_AI') AS passed_to_ai FROM routed""", "routed"
        ),
        "stream_restart": s("SELECT event_type, seq FROM dedup", "dedup"),
        "stream_flood_alerts": s(
            "SELECT hostname, ts AS timestamp, array_to_string(found, '; ') AS pattern_type, total_requests AS requests_count, top_ip, top_endpoint, risk_level FROM live_flood", "live_flood"
        ),
        "stream_metric_transitions": s("SELECT hostname, metric, seq, old_state, new_state FROM trans", "trans"),
        "stream_hourly_report": s(hours, "incident"),
        "stream_multi_sink": s(
            """SELECT table_name, n, n AS ids FROM (SELECT 'security_decisions' AS table_name, count(*) AS n FROM routed WHERE decision IS NOT NULL UNION ALL SELECT 'attack_logs', count(*) FROM routed WHERE decision IN ('LOG_ONLY', 'ALERT')
            UNION ALL SELECT 'alerts', count(*) FROM live_alert)""", "routed", "live_alert"
        ),
        "stream_late_data": s(
            f"""SELECT date_trunc('hour', ts) AS hour, hostname, count(*) AS n FROM arrivals a LEFT JOIN (SELECT k AS segment, (SELECT date_trunc('millisecond', max(ts)) FROM arrivals WHERE segment < k) - INTERVAL {LATE_HOURS} HOUR AS mark
            FROM (VALUES (0), (1), (2), (3)) AS v(k)) USING (segment) WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""", "arrivals"
        ),
    }
    out |= {"stored_resolve": out["resolve_alerts"], "stored_reviews": out["apply_reviews"], "stored_recent": out["recent_incidents"]}
    out |= {f"stored_{name}": out[name] for name in ("statistics", "hourly_report", "risk_breakdown", "top_attack_types")}
    return out


piece("timed_events", [], "SELECT event_id AS seq, ts, event_type FROM events")
cooldown("dedup", "timed_events", ["event_type"])
piece("guard_rows", ["fx_syslog"], "SELECT seq AS id, raw_line AS text FROM fx_syslog WHERE trim(raw_line) <> ''")
bayes("guard", "fx_train", "guard_rows", LINE_LABELS, live=True)
piece(
    "slides",
    ["req"],
    "SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS window_start FROM req, (VALUES (0), (1)) AS v(k)",
)
piece("slide_pairs", ["slides"], "SELECT hostname, window_start, window_start + INTERVAL 1 HOUR AS ts, seq AS xseq, ts AS xts, ip, endpoint, status FROM slides")
report_pieces("slide", "slide_pairs", "hostname, window_start", WINDOW)
piece("live_gated", ["routed"], "SELECT * FROM routed WHERE dispatch AND risk IN ('HIGH', 'CRITICAL') AND confidence >= 0.55")
cooldown("live_alert", "live_gated", ["hostname", "prediction", "source_log"])
piece(
    "closed_slides",
    ["slide_report", "req"],
    f"""
SELECT *, epoch_us(window_start) AS seq, window_start + INTERVAL 1 HOUR AS ts FROM slide_report
WHERE is_anomaly AND window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM req) - INTERVAL 2 HOUR""",
)
cooldown("live_flood", "closed_slides", ["hostname", "top_ip"])
