"""The shipped detection content: rules, attack chains and the technique dimension."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.values import TECHNIQUES, TECHNIQUE_URL

# The shipped rules. A group is a list of keywords (any of them in the message,
# else in the raw line) or field|modifier -> values.
RULES = [
    dict(id="b2c4e6f8-1234-4abc-8def-000000000010", title="Suspicious Cron Job Added",
         status="stable", level="medium", file="cron_persistence.yml",
         tags=["attack.persistence", "attack.t1053.003"],
         description="A scheduled job was added whose command looks like a persistence attempt.",
         falsepositives=["Deployment scripts", "Package managers"],
         detection={
             "cron_add": {"message|contains": ["crontab", "cron.d", "cron.daily", "cron.hourly"]},
             "suspicious_content": {"message|contains": [
                 "/tmp", "/dev/shm", "wget", "curl", "bash -i", "nc -e"]},
             "condition": "cron_add and suspicious_content"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000012", title="Password File Modification",
         status="stable", level="high", file="passwd_modification.yml",
         tags=["attack.persistence", "attack.t1136"],
         description="A message names one of the account files, which few tools should touch.",
         falsepositives=["Account management by administrators"],
         detection={
             "passwd_files": {"message|contains": ["/etc/passwd", "/etc/shadow", "/etc/sudoers"]},
             "condition": "passwd_files"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000013", title="Reverse Shell Attempt",
         status="stable", level="critical", file="reverse_shell.yml",
         tags=["attack.execution", "attack.command_and_control", "attack.t1059.004"],
         description="The message holds a command line that opens a shell to a remote host.",
         falsepositives=["Authorized red team exercises"],
         detection={
             "reverse_shell_patterns": {"message|contains": [
                 "/dev/tcp/", "/dev/udp/", "bash -i >&", "bash -i >& /dev", "nc -e /bin",
                 "ncat -e /bin", "python -c.*socket", "perl -e.*socket"]},
             "condition": "reverse_shell_patterns"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000014", title="Setuid/Setgid Bit Set on File",
         status="stable", level="high", file="setuid_binary.yml",
         tags=["attack.privilege_escalation", "attack.t1548.001"],
         description="A chmod call sets the setuid or setgid bit.",
         falsepositives=["Packages that install setuid binaries", "Hardening work"],
         detection={
             "setuid_chmod": {"message|contains": [
                 "chmod u+s", "chmod g+s", "chmod 4755", "chmod 4777", "chmod 2755",
                 "chmod 6755"]},
             "condition": "setuid_chmod"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000011", title="SSH Authorized Key Added",
         status="stable", level="high", file="ssh_key_added.yml",
         tags=["attack.persistence", "attack.t1098"],
         description="A key was written to an authorized_keys file.",
         falsepositives=["Users adding their own key", "Configuration management"],
         detection={
             "authorized_keys": {"message|contains": ["authorized_keys"]},
             "write_operation": {"message|contains": ["write", "added", "append", "echo"]},
             "condition": "authorized_keys and write_operation"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000031", title="Potential DNS Exfiltration",
         status="experimental", level="medium", file="dns_exfiltration.yml",
         tags=["attack.exfiltration", "attack.command_and_control", "attack.t1071"],
         description="A DNS query has an unusually long label, as encoded data would.",
         falsepositives=["Content delivery networks", "Software update services"],
         detection={
             "long_subdomain": {
                 "message|contains": ["query"], "message|re": r"[a-zA-Z0-9]{40,}\."},
             "condition": "long_subdomain"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000030", title="Firewall Drop Rate Spike",
         status="stable", level="medium", file="firewall_drop_spike.yml",
         tags=["attack.discovery", "attack.t1046"],
         description="A firewall dropped or rejected a connection.",
         falsepositives=["Internal network scanners", "Misconfigured applications"],
         detection={
             "firewall_drops": {"message|contains": ["DROP", "REJECT", "DENY", "BLOCKED"]},
             "condition": "firewall_drops"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000006", title="High Severity CEF Event",
         status="stable", level="high", file="cef_high_severity.yml", tags=["attack.impact"],
         description="A security device reported an event in CEF.",
         falsepositives=["Wrong severity thresholds on the device"],
         detection={"high_sev": {"log_source": "cef"}, "condition": "high_sev"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000007", title="Suspicious Root Process Execution",
         status="experimental", level="high", file="new_process_as_root.yml",
         tags=["attack.execution", "attack.t1059"],
         description="A shell or interpreter was started with the root user id.",
         falsepositives=["System startup", "Root administration"],
         detection={
             "root_exec": {"message|contains": ["uid=0", "euid=0"]},
             "shell_indicators": {"message|contains": [
                 "/bin/bash", "/bin/sh", "/bin/zsh", "python", "perl"]},
             "condition": "root_exec and shell_indicators"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000004", title="Port Scan Detected",
         status="stable", level="medium", file="port_scan_detected.yml",
         tags=["attack.discovery", "attack.t1046"],
         description="A detection system or firewall names a port scan.",
         falsepositives=["Network monitoring", "Authorized vulnerability scanners"],
         detection={
             "keywords": ["Port Scan", "port scan", "portscan", "PORTSCAN"],
             "condition": "keywords"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000003", title="Privilege Escalation via Sudo",
         status="stable", level="medium", file="privilege_escalation_sudo.yml",
         tags=["attack.privilege_escalation", "attack.t1548.003"],
         description="A command was run as root through sudo.",
         falsepositives=["Administrative work"],
         detection={
             "keywords": ["sudo"], "filter": {"message|contains": ["as root", "COMMAND="]},
             "condition": "keywords and filter"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000002", title="SSH Successful Login",
         status="stable", level="low", file="ssh_accepted_login.yml",
         tags=["attack.lateral_movement", "attack.t1021.004"],
         description="An SSH login succeeded; useful as a baseline.",
         falsepositives=["Normal access"],
         detection={
             "keywords": ["Accepted password", "Accepted publickey"], "condition": "keywords"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000001", title="SSH Brute Force Attempt",
         status="stable", level="high", file="ssh_brute_force.yml",
         tags=["attack.credential_access", "attack.t1110.001"],
         description="An SSH authentication failed, as in password guessing.",
         falsepositives=["Mistyped passwords"],
         detection={"keywords": ["Failed password", "Invalid user"], "condition": "keywords"}),
    dict(id="a5e1b3c2-1234-4abc-8def-000000000005", title="Web Admin Panel Access Attempt",
         status="stable", level="medium", file="web_admin_access.yml",
         tags=["attack.discovery", "attack.t1083"],
         description="A request asks for a path of an administration panel.",
         falsepositives=["Administrators", "Security scanners"],
         detection={
             "url_patterns": {"message|contains": [
                 "/admin", "/wp-admin", "/phpmyadmin", "/manager/html", "/.env",
                 "/config.php"]},
             "condition": "url_patterns"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000022", title="Web Command Injection Attempt",
         status="stable", level="high", file="command_injection.yml",
         tags=["attack.initial_access", "attack.execution", "attack.t1190", "attack.t1059"],
         description="A request carries a shell command in its input.",
         falsepositives=["Authorized tests", "Security scanners"],
         detection={
             "cmd_injection": {"message|contains": [
                 ";cat ", ";id;", ";whoami", "|id", "|whoami", "`id`", "`whoami`", "$(id)",
                 "$(whoami)", ";ls -la", "&&id"]},
             "condition": "cmd_injection"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000021", title="Directory Traversal Attempt",
         status="stable", level="medium", file="directory_traversal.yml",
         tags=["attack.initial_access", "attack.t1190"],
         description="A request climbs out of the web root.",
         falsepositives=["Relative paths of some frameworks", "Web scanners"],
         detection={
             "traversal_patterns": {"message|contains": [
                 "../", "..%2F", "..%5C", "%2e%2e%2f", "..../", "/etc/passwd", "/etc/shadow",
                 "WEB-INF/"]},
             "condition": "traversal_patterns"}),
    dict(id="b2c4e6f8-1234-4abc-8def-000000000020", title="SQL Injection Attempt",
         status="stable", level="high", file="sql_injection.yml",
         tags=["attack.initial_access", "attack.t1190"],
         description="A request carries an SQL fragment in its input.",
         falsepositives=["Firewall tests", "Authorized tests"],
         detection={
             "sqli_patterns": {"message|contains": [
                 "' OR '", "' OR 1=1", "UNION SELECT", "UNION ALL SELECT", "; DROP TABLE",
                 "' --", "' #", "1=1--", "or 1=1", "AND 1=1"]},
             "condition": "sqli_patterns"}),
]

# The step vocabulary and the six shipped chains
# (id, title, severity, window in seconds, tactic, techniques, steps).
FAILED = ["SSH Brute Force", "Failed password", "auth:failure"]
LOGGED_IN = ["SSH Successful Login", "Accepted password", "auth:success"]
CHAINS = [
    dict(id="chain-001", title="Brute Force Followed by Successful Login", severity="critical",
         window_seconds=600, tactic="Credential Access → Initial Access",
         techniques=["T1110.001", "T1078"],
         steps=[("brute_force", FAILED), ("successful_login", LOGGED_IN)]),
    dict(id="chain-002", title="Port Scan Followed by Brute Force", severity="high",
         window_seconds=300, tactic="Discovery → Credential Access",
         techniques=["T1046", "T1110"],
         steps=[("port_scan", ["Port Scan", "port scan", "portscan"]), ("brute_force", FAILED)]),
    dict(id="chain-003", title="Successful Login Followed by Privilege Escalation",
         severity="critical", window_seconds=900,
         tactic="Initial Access → Privilege Escalation", techniques=["T1078", "T1548.003"],
         steps=[("login", LOGGED_IN),
                ("escalation",
                 ["Privilege Escalation", "Suspicious Root Process", "sudo", "uid=0"])]),
    dict(id="chain-004", title="Port Scan → Web Admin Probe", severity="high",
         window_seconds=180, tactic="Discovery → Initial Access",
         techniques=["T1046", "T1190"],
         steps=[("scan", ["Port Scan", "portscan"]),
                ("web_probe", ["Web Admin Panel", "/admin", "wp-admin", "phpmyadmin"])]),
    dict(id="chain-005", title="Full Intrusion Kill Chain", severity="critical",
         window_seconds=1800, tactic="Full Kill Chain",
         techniques=["T1046", "T1110", "T1078", "T1548"],
         steps=[("recon", ["Port Scan", "portscan"]), ("brute_force", FAILED),
                ("initial_access", LOGGED_IN),
                ("escalation", ["Privilege Escalation", "Suspicious Root Process", "uid=0"])]),
    dict(id="chain-006", title="Repeated Auth Failures from Single Source", severity="medium",
         window_seconds=120, tactic="Credential Access", techniques=["T1110"],
         steps=[("fail_1", ["auth:failure", "Failed password"]),
                ("fail_2", ["auth:failure", "Failed password"]),
                ("fail_3", ["auth:failure", "Failed password"])]),
]

RULE_SCHEMA = (
    "rule_id string, title string, status string, level string, description string, "
    "author string, tags array<string>, falsepositives array<string>, condition string, "
    "source_file string, detection string"
)
MATCHER_SCHEMA = (
    "rule_id string, group string, kind string, field string, modifier string, value string, "
    "is_text boolean"
)


def techniques_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, i.split(".")[0], n, t, a, TECHNIQUE_URL + i.replace(".", "/") + "/")
         for i, n, t, a in TECHNIQUES],
        "technique_id string, parent_id string, name string, tactic string, "
        "all_tactics array<string>, url string",
    )


def chains_table(spark: SparkSession, chains=CHAINS) -> DataFrame:
    return spark.createDataFrame(
        [(c["id"], c["title"], c["severity"], c["window_seconds"], c["tactic"],
          c["techniques"], c["steps"]) for c in chains],
        "chain_id string, title string, severity string, window_seconds int, tactic string, "
        "techniques array<string>, steps array<struct<name:string,matchers:array<string>>>",
    ).withColumn("step_names", F.col("steps.name"))
