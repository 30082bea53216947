"""Word lists, codes and patterns that decide results.

Nothing in this module computes; it states the vocabulary of the log formats,
the severities, the feature vector and the technique catalogue.
"""

# Syslog codes (RFC 5424; facility codes 12 to 15 have no name here).
FACILITIES = {
    0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog", 6: "lpr", 7: "news",
    8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp",
    16: "local0", 17: "local1", 18: "local2", 19: "local3",
    20: "local4", 21: "local5", 22: "local6", 23: "local7",
}
SEVERITIES = {
    0: "emerg", 1: "alert", 2: "crit", 3: "err", 4: "warning", 5: "notice", 6: "info", 7: "debug",
}
MONTHS = {
    "Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12,
}

# Whitespace that ends or starts a line and is not part of it.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Patterns of the log formats. (?d) keeps "." stopping at \n only,
# (?U) makes \w, \s and \d Unicode-aware.
RE_RFC5424 = (
    r"(?dU)^<(\d{1,3})>(\d)\s+"
    r"(\d{4}-\d{2}-\d{2}T[\d:\.]+(?:Z|[+-]\d{2}:\d{2})|-)\s+"
    r"(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|-)\s*(.*)"
)
RE_RFC3164 = (
    r"(?dU)^<(\d{1,3})>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)"
)
RE_CEF = r"(?dU)^(?:<\d+>)?(?:\w{3}\s+\d+\s+[\d:]+\s+\S+\s+)?CEF:(\d+)\|"
RE_CEF_EXTENSION = r"(?sU)(\w+)=(.*?)(?=\s\w+=|\z)"
RE_SD_PARAM = r'(?dU)(\w+)="([^"\\]*+(?:\\.[^"\\]*+)*+)"'
RE_ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)

# Patterns read out of a message.
RE_IPV4 = (
    r"(?U)\b((?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?))\b"
)
RE_PORT = r"(?iU)(?:port|dport|sport|dst_port|src_port)\s*[=:]?\s*(\d{1,5})"
RE_USER = r"(?iU)(?:user|username|for user|invalid user|for)\s+([A-Za-z0-9_\.\-\@]+)"
RE_PID = r"(?iU)\bpid[=:\s]+(\d+)\b"
RE_PATH = r"(?U)(?:/[\w\.\-]+){2,}"
RE_HTTP_METHOD = r"(?U)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE)\b"
RE_HTTP_STATUS = r"(?idU)(?:HTTP/\d\.\d.\s+|status[=:\s]+)(\d{3})"
RE_AUTH_FAILURE = (
    r"(?iU)\b(failed|failure|invalid|refused|denied|rejected|unauthorized|incorrect)\b"
)
RE_AUTH_SUCCESS = r"(?iU)\b(accepted|success|succeeded|logged in|authenticated|granted)\b"

# Patterns of the feature vector (not the same as the tagging ones).
RE_FEATURE_IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
RE_FEATURE_FAIL = (
    r"(?iU)\b(fail\w*|error\w*|denied|reject\w*|invalid|unauthori[sz]\w*|refused|incorrect)"
)
RE_FEATURE_SUCCESS = (
    r"(?idU)\b(accept\w*|success\w*|granted|authenticated|logged.in|connected)"
)

# Alias keys, first non-empty one wins.
SOURCE_IP_KEYS = ["source_ip", "src", "src_ip", "sourceAddress"]
DEST_IP_KEYS = ["dest_ip", "dst", "dst_ip", "destinationAddress"]
SOURCE_PORT_KEYS = ["source_port", "spt", "sourcePort"]
DEST_PORT_KEYS = ["dest_port", "dpt", "destinationPort"]
JSON_TIME_KEYS = ["timestamp", "@timestamp", "time", "ts", "date"]
JSON_HOST_KEYS = ["host", "hostname", "source_host", "logsource"]
JSON_MESSAGE_KEYS = ["message", "msg", "log", "event", "text"]
JSON_PROGRAM_KEYS = ["program", "process", "app", "application", "service"]

# Program categories.
AUTH_PROGRAMS = [
    "sshd", "sudo", "su", "login", "pam", "auth", "passwd",
    "slapd", "krb5kdc", "gdm", "lightdm", "polkit",
]
NETWORK_PROGRAMS = [
    "firewalld", "iptables", "nftables", "ufw", "fail2ban",
    "snort", "suricata", "zeek", "bro", "tcpdump",
]
WEB_SERVERS = ["nginx", "apache"]

# Ranks.
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}
LEVEL_RANK = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
RULE_STATUSES = ["stable", "test", "experimental", "deprecated", "unsupported"]
STIX_CONFIDENCE = {"critical": 95, "high": 80, "medium": 60, "low": 40, "informational": 20}

# The 31 features, in order.
FEATURE_NAMES = [
    "hour_of_day", "minute_of_hour", "is_weekend", "is_off_hours", "is_business_hours",
    "has_source_ip", "source_ip_octet1", "source_ip_is_rfc1918", "dest_port_norm",
    "source_port_norm", "is_common_port", "is_high_port", "is_privileged_port",
    "dest_port_bucket", "has_dest_port", "log_source_enc", "is_auth_program",
    "is_network_program", "program_hash_norm", "has_pid", "message_length_norm",
    "has_ip_in_message", "has_failure_keyword", "has_success_keyword", "has_path_in_message",
    "severity_enc", "facility_enc", "has_severity", "is_error_severity", "is_info_severity",
    "tag_count_norm",
]
COMMON_PORTS = [
    20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 465, 587, 993, 995, 1433, 1521, 3306, 3389,
    5432, 5900, 6379, 8080, 8443, 27017,
]
PORT_BUCKETS = [
    (0, 0.0), (80, 0.1), (443, 0.2), (1024, 0.3), (3306, 0.4), (5432, 0.5), (8080, 0.6),
    (8443, 0.7), (32768, 0.8),
]
LOG_SOURCE_CODE = {
    "syslog_rfc5424": 0.2, "syslog_rfc3164": 0.4, "cef": 0.6, "json": 0.8, "plaintext": 1.0,
    "file": 0.3, "unknown": 0.5,
}
SEVERITY_CODE = {
    "emerg": 1.0, "alert": 0.86, "crit": 0.72, "err": 0.58,
    "warning": 0.44, "notice": 0.30, "info": 0.16, "debug": 0.08,
}
FACILITY_CODE = {
    "auth": 1.0, "authpriv": 1.0, "kern": 0.9, "daemon": 0.7, "syslog": 0.6, "user": 0.5,
    "mail": 0.4, "cron": 0.4, "ftp": 0.3, "news": 0.2, "lpr": 0.2, "uucp": 0.2,
    "local0": 0.1, "local1": 0.1, "local2": 0.1, "local3": 0.1,
    "local4": 0.1, "local5": 0.1, "local6": 0.1, "local7": 0.1,
}

# Abuse report categories.
ABUSE_CATEGORIES = {
    3: "Fraud Orders", 4: "DDoS Attack", 5: "FTP Brute-Force", 7: "Phishing", 9: "Open Proxy",
    10: "Web Spam", 11: "Email Spam", 14: "Port Scan", 15: "Hacking", 16: "SQL Injection",
    18: "Brute-Force", 19: "Bad Web Bot", 20: "Exploited Host", 21: "Web App Attack",
    22: "SSH", 23: "IoT Targeted",
}

# Incident states and the moves allowed between them.
INCIDENT_STATES = ["new", "triaging", "contained", "dismissed", "closed"]
INCIDENT_MOVES = {
    "new": ["triaging", "dismissed"],
    "triaging": ["contained", "dismissed"],
    "contained": ["closed", "triaging"],
    "dismissed": [],
    "closed": [],
}
INCIDENT_END_STATES = ["closed", "dismissed"]

# ATT&CK tactics in matrix order, and the known techniques
# (id, name, primary tactic, all tactics).
TACTIC_ORDER = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
    "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
TECHNIQUES = [
    ("T1110", "Brute Force", "Credential Access", ["Credential Access"]),
    ("T1110.001", "Password Guessing", "Credential Access", ["Credential Access"]),
    ("T1110.002", "Password Cracking", "Credential Access", ["Credential Access"]),
    ("T1110.003", "Password Spraying", "Credential Access", ["Credential Access"]),
    ("T1110.004", "Credential Stuffing", "Credential Access", ["Credential Access"]),
    ("T1078", "Valid Accounts", "Defense Evasion",
     ["Defense Evasion", "Initial Access", "Persistence", "Privilege Escalation"]),
    ("T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation",
     ["Privilege Escalation", "Defense Evasion"]),
    ("T1548.003", "Sudo and Sudo Caching", "Privilege Escalation",
     ["Privilege Escalation", "Defense Evasion"]),
    ("T1548.001", "Setuid and Setgid", "Privilege Escalation",
     ["Privilege Escalation", "Defense Evasion"]),
    ("T1059", "Command and Scripting Interpreter", "Execution", ["Execution"]),
    ("T1059.004", "Unix Shell", "Execution", ["Execution"]),
    ("T1046", "Network Service Discovery", "Discovery", ["Discovery"]),
    ("T1083", "File and Directory Discovery", "Discovery", ["Discovery"]),
    ("T1087", "Account Discovery", "Discovery", ["Discovery"]),
    ("T1021", "Remote Services", "Lateral Movement", ["Lateral Movement"]),
    ("T1021.004", "SSH", "Lateral Movement", ["Lateral Movement"]),
    ("T1190", "Exploit Public-Facing Application", "Initial Access", ["Initial Access"]),
    ("T1133", "External Remote Services", "Initial Access", ["Initial Access", "Persistence"]),
    ("T1071", "Application Layer Protocol", "Command and Control", ["Command and Control"]),
    ("T1059.001", "PowerShell", "Execution", ["Execution"]),
    ("T1053", "Scheduled Task/Job", "Persistence",
     ["Persistence", "Privilege Escalation", "Execution"]),
    ("T1053.003", "Cron", "Persistence", ["Persistence", "Privilege Escalation", "Execution"]),
    ("T1036", "Masquerading", "Defense Evasion", ["Defense Evasion"]),
    ("T1486", "Data Encrypted for Impact", "Impact", ["Impact"]),
    ("T1489", "Service Stop", "Impact", ["Impact"]),
]
TECHNIQUE_URL = "https://attack.mitre.org/techniques/"

# Defaults.
MAX_LINE_BYTES = 65535
DEDUP_SECONDS = 300
WINDOW_CAP = 500
ANOMALY_THRESHOLD = 0.62
ENRICH_TTL_SECONDS = 3600
RETRAIN_THRESHOLD = 5
