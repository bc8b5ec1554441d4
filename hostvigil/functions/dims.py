"""Dimension tables. Fixed values; each has fewer than 60 rows whatever the data size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# The class labels in id order.
LABELS = [
    "Benign", "BruteForce", "CRLF_Injection", "CSRF", "Command_Injection", "CredentialStuffing", "Cron_Abuse",
    "Cryptomining", "DDoS", "Docker_Abuse", "Failed_Login", "FileUpload_Attack", "GraphQL_Injection",
    "Header_Injection", "Insecure_Deserialization", "Kernel_Exploit", "LDAP_Injection", "Lateral_Movement",
    "Linux_Command_Injection", "Linux_Malware", "Malicious_HTTP", "Malicious_System_Command", "Malware",
    "NoSQL_Injection", "OpenRedirect", "PathTraversal", "Persistence", "PortScanning", "PrivilegeEscalation",
    "Prototype_Pollution", "RCE", "Ransomware", "ReverseShell", "Root_Login_Attempt", "SQL_Injection",
    "SSH_BruteForce", "SSH_Login_Attack", "SSRF", "SSTI", "Suspicious_Bash_Command", "Suspicious_Input",
    "Suspicious_Process", "System_Enumeration", "Unauthorized_File_Modification", "WebShell", "XPATH_Injection",
    "XSS", "XXE",
]

# Base severity by label; every other label takes DEFAULT_SEVERITY.
DEFAULT_SEVERITY = "MEDIUM"
SEVERITY_LABELS = {
    "CRITICAL": [
        "ReverseShell", "Kernel_Exploit", "PrivilegeEscalation", "Ransomware", "Linux_Command_Injection",
        "Command_Injection", "Malicious_System_Command", "WebShell", "Persistence", "XXE", "Insecure_Deserialization",
    ],
    "HIGH": [
        "SQL_Injection", "XSS", "PathTraversal", "Docker_Abuse", "SSH_BruteForce", "SSH_Login_Attack",
        "FileUpload_Attack", "NoSQL_Injection", "SSTI", "Cryptomining", "Linux_Malware", "Malware", "Cron_Abuse",
        "Unauthorized_File_Modification",
    ],
    "MEDIUM": [
        "PortScanning", "BruteForce", "Failed_Login", "CredentialStuffing", "Root_Login_Attempt", "Lateral_Movement",
        "Suspicious_Bash_Command", "Suspicious_Process", "CSRF", "Header_Injection", "CRLF_Injection",
        "GraphQL_Injection", "OpenRedirect", "Prototype_Pollution", "LDAP_Injection", "XPATH_Injection", "DDoS",
    ],
    "LOW": ["System_Enumeration", "Suspicious_Input", "Malicious_HTTP"],
    "SAFE": ["Benign"],
}

# Risk weight by label; every other label takes DEFAULT_WEIGHT.
DEFAULT_WEIGHT = 0.50
WEIGHTS = {
    "RCE": 1.00, "ReverseShell": 1.00, "Kernel_Exploit": 0.98, "Command_Injection": 0.98,
    "Linux_Command_Injection": 0.98, "Malicious_System_Command": 0.97, "PrivilegeEscalation": 0.96,
    "SQL_Injection": 0.95, "Malware": 0.95, "Linux_Malware": 0.95, "Ransomware": 0.95, "WebShell": 0.94,
    "Docker_Abuse": 0.93, "Persistence": 0.92, "XXE": 0.90, "Insecure_Deserialization": 0.90,
    "PathTraversal": 0.88, "FileUpload_Attack": 0.88, "XPATH_Injection": 0.88, "SSTI": 0.87,
    "Lateral_Movement": 0.87, "NoSQL_Injection": 0.85, "Cron_Abuse": 0.85,
    "Unauthorized_File_Modification": 0.84, "Root_Login_Attempt": 0.82, "Cryptomining": 0.80, "XSS": 0.80,
    "SSRF": 0.80, "GraphQL_Injection": 0.80, "Prototype_Pollution": 0.78, "LDAP_Injection": 0.78,
    "System_Enumeration": 0.76, "CSRF": 0.75, "OpenRedirect": 0.75,
    "Header_Injection": 0.72, "CRLF_Injection": 0.70, "Suspicious_Bash_Command": 0.70, "Suspicious_Process": 0.68,
    "SSH_BruteForce": 0.65, "BruteForce": 0.65, "CredentialStuffing": 0.65, "SSH_Login_Attack": 0.63,
    "PortScanning": 0.60, "DDoS": 0.60, "Failed_Login": 0.55, "Malicious_HTTP": 0.55,
    "Suspicious_Input": 0.50, "Benign": 0.00,
}

# Labels that count as server attacks; every other label is a web one.
SERVER_LABELS = [
    "SSH_BruteForce", "SSH_Login_Attack", "ReverseShell", "PrivilegeEscalation", "Suspicious_Bash_Command",
    "Linux_Command_Injection", "WebShell", "PortScanning", "Docker_Abuse", "Cron_Abuse", "Persistence",
    "Malicious_System_Command", "Unauthorized_File_Modification", "Suspicious_Process", "System_Enumeration",
    "Kernel_Exploit", "Linux_Malware", "Ransomware", "Cryptomining", "Failed_Login", "Root_Login_Attempt",
    "Lateral_Movement",
]

# Warning and critical level by metric.
METRIC_LIMITS = {"CPU": (80.0, 95.0), "RAM": (80.0, 90.0), "DISK": (80.0, 90.0)}

# Severities from lowest to highest, and the risk levels incident queries know.
SEVERITY_ORDER = ["SAFE", "LOW", "UNKNOWN", "MEDIUM", "HIGH", "CRITICAL"]
RISK_LEVELS = ["SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Advice by label; every other label takes DEFAULT_ADVICE.
DEFAULT_ADVICE = "MEDIUM: Inspect event details, review system logs around timestamp, and verify user authorization."
ADVICE = {
    "ReverseShell": "CRITICAL: Immediate action required! Kill process tree, inspect network sockets (netstat/ss), check crontabs and systemd services, and isolate the server if necessary.",
    "Kernel_Exploit": "CRITICAL: Potential privilege escalation exploit execution. Check /tmp and /var/tmp for compiled binaries, apply Linux kernel security patches immediately.",
    "PrivilegeEscalation": "CRITICAL: Unauthorized root escalation attempt detected. Inspect sudoers configuration, check setuid binaries (find / -perm -4000), and review active root sessions.",
    "Ransomware": "CRITICAL: Potential file encryption activity detected. Immediately freeze disk I/O, isolate host from network, and inspect modified files.",
    "Linux_Command_Injection": "CRITICAL: Arbitrary system command execution detected. Inspect web app inputs, review web user permissions (www-data/nginx), and check /tmp for dropped payloads.",
    "Malicious_System_Command": "CRITICAL: Destructive system command executed (e.g. dd/rm/mkfs). Inspect user terminal history and suspend compromised user accounts.",
    "WebShell": "HIGH: Web shell execution detected. Search for uploaded PHP/ASP/JSP scripts in web roots, inspect web server access logs, and restrict file upload permissions.",
    "Docker_Abuse": "HIGH: Suspicious Docker container breakout or privileged container execution. Inspect running containers (docker ps), review docker socket permissions, and check mounted host paths.",
    "Persistence": "HIGH: System persistence mechanism established (SSH authorized_keys, bash profile, systemd). Inspect /root/.ssh/authorized_keys and system startup scripts.",
    "XXE": "HIGH: XML External Entity injection. Disable external entity resolution (DTD) in XML parsers and sanitize web inputs.",
    "Insecure_Deserialization": "HIGH: Untrusted object deserialization attempt. Review application endpoint parsers and update vulnerable dependencies.",
    "SQL_Injection": "HIGH: Database query injection attempt. Ensure parameterized queries (prepared statements) are used and review WAF rules.",
    "XSS": "HIGH: Cross-site scripting payload detected. Ensure output encoding and CSP headers are active on web applications.",
    "PathTraversal": "HIGH: Arbitrary file access attempt (e.g. /etc/passwd). Restrict web application directory permissions and sanitize file paths.",
    "FileUpload_Attack": "HIGH: Malicious file upload attempt. Restrict executable extensions in upload directories (.php, .phtml, .sh) and enforce mime-type verification.",
    "NoSQL_Injection": "HIGH: NoSQL query manipulation. Validate type inputs and avoid using raw JSON input in database queries.",
    "SSTI": "HIGH: Server-Side Template Injection. Sanitize user inputs passed to template engines (Jinja2, Twig, etc.).",
    "Lateral_Movement": "HIGH: Internal network lateral movement attempt via SSH/SCP. Audit internal SSH keys and restrict inter-host communication.",
    "Cron_Abuse": "HIGH: Unauthorized crontab entry modified or created. Check /etc/crontab, /etc/cron.d/, and user crontabs (crontab -l).",
    "Unauthorized_File_Modification": "HIGH: Sensitive file modified (e.g. /etc/passwd, /etc/shadow, /etc/sudoers). Revert unauthorized file changes and audit file permissions.",
    "Root_Login_Attempt": "HIGH: Direct root login attempt detected. Ensure 'PermitRootLogin no' is set in /etc/ssh/sshd_config.",
    "Cryptomining": "HIGH: Unauthorized cryptomining process detected (e.g. xmrig). Kill high-CPU processes, inspect network connections to mining pools, and clean /tmp.",
    "Linux_Malware": "HIGH: Dropped malware executable or script detected. Isolate process, delete downloaded binary, and scan system with ClamAV/rkhunter.",
    "SSH_BruteForce": "MEDIUM: Repeated SSH authentication failures. Consider enabling Fail2ban or SSH key-only authentication, and block offending IP address.",
    "SSH_Login_Attack": "MEDIUM: Suspicious SSH login attempt. Verify source IP address and enforce multi-factor authentication (MFA).",
    "PortScanning": "MEDIUM: Network port scanning activity (nmap/masscan). Review firewall rules (iptables/ufw) and block scanner IP.",
    "Failed_Login": "MEDIUM: Authentication failure recorded. Monitor for brute force patterns.",
    "CredentialStuffing": "MEDIUM: Automated login attempts with leaked credentials. Enforce rate limiting and CAPTCHA on login endpoints.",
    "BruteForce": "MEDIUM: Brute force password attack. Rate limit authentication endpoints.",
    "Suspicious_Bash_Command": "MEDIUM: Suspicious shell activity (history wiping, environment tampering). Inspect audit log and active user sessions.",
    "Suspicious_Process": "MEDIUM: Unrecognized background process running. Inspect process tree (`ps auxf`) and binary path (`ls -l /proc/<PID>/exe`).",
    "System_Enumeration": "LOW: Reconnaissance commands executed (uname, id, ifconfig). Monitor user activity for escalation.",
    "Benign": "SAFE: Normal benign activity. No action required.",
}


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def values_frame(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A literal relation, so that the optimizer knows its exact size."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS dim({', '.join(columns)})")


def severity_dim(spark: SparkSession) -> DataFrame:
    return values_frame(spark, ["label", "severity"], [(x, s) for s, xs in SEVERITY_LABELS.items() for x in xs])


def severity_dim_alt(spark: SparkSession) -> DataFrame:
    """Variant that knows CRITICAL, HIGH and SAFE labels only."""
    return values_frame(
        spark, ["label", "severity"], [(x, s) for s in ("CRITICAL", "HIGH", "SAFE") for x in SEVERITY_LABELS[s]]
    )


def weight_dim(spark: SparkSession) -> DataFrame:
    return values_frame(spark, ["label", "weight"], WEIGHTS.items())


def advice_dim(spark: SparkSession) -> DataFrame:
    return values_frame(spark, ["label", "recommendation"], ADVICE.items())


def server_dim(spark: SparkSession) -> DataFrame:
    return values_frame(spark, ["label"], [(x,) for x in SERVER_LABELS])


def metric_dim(spark: SparkSession) -> DataFrame:
    return values_frame(spark, ["metric", "warning", "critical"], [(m, w, c) for m, (w, c) in METRIC_LIMITS.items()])
