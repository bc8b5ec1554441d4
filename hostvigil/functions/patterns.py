"""Line patterns of the triage rules. Results depend on every one of them and on their order."""

from __future__ import annotations

# Fixed values. A line that matches one of these is benign; the first match names the reason.
BENIGN_PATTERNS = [
    r"systemd\[\d+\]:\s+\S+\.mount:\s+Succeeded",
    r"systemd\[\d+\]:\s+Started\s+",
    r"systemd\[\d+\]:\s+Finished\s+",
    r"systemd\[\d+\]:\s+Stopped\s+",
    r"systemd\[\d+\]:\s+Stopping\s+",
    r"systemd\[\d+\]:\s+Starting\s+",
    r"systemd\[\d+\]:\s+Reached target\s+",
    r"systemd\[\d+\]:\s+Created slice\s+",
    r"systemd\[\d+\]:\s+Listening on\s+",
    r"systemd\[\d+\]:\s+Mounted\s+",
    r"systemd\[\d+\]:\s+Deactivated successfully",
    r"systemd\[\d+\]:\s+.*startup finished",
    r"systemd\[\d+\]:\s+Closed\s+",
    r"systemd\[\d+\]:\s+Removed slice\s+",
    r"run-docker-runtime.*\.mount:\s+Succeeded",
    r"run-docker-runtime.*runc\.\w+\.mount",
    r"CRON\[\d+\]:\s+\(root\)\s+CMD\s+",
    r"CRON\[\d+\]:\s+\(\w+\)\s+CMD\s+\(/usr/lib/php/sessionclean\)",
    r"NetworkManager.*:\s+.*successfully activated",
    r"NetworkManager.*:\s+.*state change.*connected",
    r"sshd\[\d+\]:\s+Accepted\s+(publickey|keyboard-interactive)\s+for\s+\w+\s+from\s+",
    r"sshd\[\d+\]:\s+pam_unix\(sshd:session\):\s+session (opened|closed)",
    r"dhclient\[\d+\]:\s+DHCP(ACK|OFFER|REQUEST|RELEASE)",
    r"systemd-resolved\[\d+\]:\s+Using DNS server",
    r"systemd-resolved\[\d+\]:\s+Grace period over",
    r"apt-dscp|dpkg-exec|unattended-upgrades",
    r"logrotate.*:\s+(rotating|moving|compressing|creating)",
    r"docker.*container\s+(started|stopped|created|removed|paused|unpaused)",
    r"kernel:.*\s+audit:.*type=\d+\s+audit.*res=success",
]

# How many consecutive benign patterns need the literal: a substring test that spares the regexes.
BENIGN_GUARDS = [
    ("systemd[", 14),
    ("run-docker-runtime", 2),
    ("cron[", 2),
    ("networkmanager", 2),
    ("sshd[", 2),
    ("dhclient[", 1),
    ("systemd-resolved[", 2),
    (None, 1),
    ("logrotate", 1),
    ("docker", 1),
    ("kernel:", 1),
]

# Fixed values. A benign match that also contains one of these is suspicious.
OVERRIDE_KEYWORDS = [
    "reverse", "shell", "exploit", "payload", "/dev/tcp", "nc -e",
    "mkfifo", "base64 -d", "/bin/sh -i", "/bin/bash -i",
    "wget http", "curl.*|.*bash", "chmod 4755", "rm -rf /",
    "dd if=", ":(){ :|:& };:", "python -c", "perl -e",
    "nmap", "masscan", "nikto", "sqlmap", "hydra", "gobuster",
    "xmrig", "minerd", "stratum+tcp",
    "/etc/shadow", "/etc/passwd", "docker.sock",
    "CVE-", "dirty_cow", "dirtycow",
]

# Fixed values. Lines with one of these substrings or patterns carry no payload.
NOISE_SUBSTRINGS = ["systemd[", "run-docker-runtime", ".mount:", "runc."]
NOISE_PATTERNS = [
    r"systemd\[\d+\]:",
    r"run-docker-runtime",
    r"\.mount:?\s+",
    r"runc\.",
    r"CRON\[\d+\]:\s+\(root\)\s+CMD\s+\(/usr/lib/php/sessionclean\)",
    r"apt-dscp|dpkg-exec|unattended-upgrades",
    r"logrotate:\s+ALERT",
    r"dhclient\[\d+\]:\s+DHCP(ACK|OFFER|REQUEST)",
    r"systemd-resolved\[\d+\]:\s+Using DNS server",
]
EXTRA_NOISE_PATTERNS = [
    r"systemd\[\d+\]:\s+(Started|Starting|Stopped|Stopping|Reached target|Created slice|Listening on|Mounted|Succeeded|Deactivating|\S+\.mount)",
    r"CRON\[\d+\]:\s+\(root\)\s+CMD\s+\(/usr/lib/php/sessionclean\)",
    r"apt-dscp|dpkg-exec|unattended-upgrades",
    r"logrotate:\s+ALERT",
    r"dhclient\[\d+\]:\s+DHCP(ACK|OFFER|REQUEST)",
    r"systemd-resolved\[\d+\]:\s+Using DNS server",
]

# One of these literals occurs in every line the noise pattern of the same position matches.
NOISE_GUARDS = [
    ["systemd["], ["run-docker-runtime"], [".mount"], ["runc."], ["cron["], ["apt-dscp", "dpkg-exec", "unattended-upgrades"],
    ["logrotate:"], ["dhclient["], ["systemd-resolved["],
]
EXTRA_NOISE_GUARDS = [
    ["systemd["], ["cron["], ["apt-dscp", "dpkg-exec", "unattended-upgrades"], ["logrotate:"], ["dhclient["], ["systemd-resolved["],
]

# Fixed values. A line of any source that matches one of these is kept whole, minus its syslog prefix.
SECURITY_PATTERNS = [
    r"Failed password",
    r"Invalid user",
    r"Accepted (password|publickey)",
    r"sudo:\s+.*:\s+TTY=.*COMMAND=",
    r"su:\s+.*:\s+session opened for user root",
    r"\b(GET|POST|PUT|DELETE|HEAD|OPTIONS|CONNECT)\b",
    r"\b(nmap|masscan|nikto|sqlmap|gobuster|hydra)\b",
    r"\bdocker\s+(run|exec|build)\b",
    r"xmrig|minerd|stratum\+tcp",
    r"bash -i|/dev/tcp/|nc -e|mkfifo|python.*socket",
    r"chmod \+x|chmod 4755|chown root|useradd|usermod",
    r"wget|curl.*\|.*bash|openssl enc|dirty_cow|CVE-",
    r"fail2ban\.actions.*\[(Ban|Unban)\]",
    r"type=EXECVE|type=SYSCALL|type=PATH",
]

# The same for the security patterns.
SECURITY_GUARDS = [
    ["failed password"], ["invalid user"], ["accepted "], ["sudo:"], ["su:"],
    ["get", "post", "put", "delete", "head", "options", "connect"],
    ["nmap", "masscan", "nikto", "sqlmap", "gobuster", "hydra"],
    ["docker"], ["xmrig", "minerd", "stratum+tcp"],
    ["bash -i", "/dev/tcp/", "nc -e", "mkfifo", "python"],
    ["chmod ", "chown root", "useradd", "usermod"],
    ["wget", "curl", "openssl enc", "dirty_cow", "cve-"],
    ["fail2ban.actions"], ["type=execve", "type=syscall", "type=path"],
]

# Where the payload of each source sits, and the access-log line format.
QUOTED_REQUEST = r'"([^"]+)"'
SSHD_MESSAGE = r"sshd\[\d+\]:\s*(.*)"
SUDO_MESSAGE = r"sudo:\s*(.*)"
FAIL2BAN_MESSAGE = r"fail2ban\..*\]\s*(.*)"
AUDIT_EXECUTABLE = r'exe="([^"]+)"'
SYSLOG_PREFIX = r"^[A-Za-z]{3}\s+\d+\s+\d{2}:\d{2}:\d{2}\s+[^\s]+\s+"
ACCESS_LINE = r'^(\S+)\s+\S+\s+\S+\s+\[[^\]]+\]\s+"([A-Z]+)\s+(\S+)\s+HTTP/[0-9.]+"\s+(\d+)'
