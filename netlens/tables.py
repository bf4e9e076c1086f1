"""Taxonomies, weights, limits, patterns and text tables.

Everything in this module is data that has to hold exactly these values for
results to agree with the published behaviour of the detectors, so it is
stated plainly and in natural order.  Logic lives in the operators.
"""

# --- fixed values: flow assembly and beacon constants -----------------------
FLAG_FIN, FLAG_SYN, FLAG_RST, FLAG_PSH = 0x01, 0x02, 0x04, 0x08
FLAG_ACK, FLAG_URG, FLAG_ECE, FLAG_CWR = 0x10, 0x20, 0x40, 0x80
IDLE_TIMEOUT_S = 120.0
ACTIVE_TIMEOUT_S = 5.0
SYN_REUSE_S = 3.0
BULK_MIN_PACKETS = 4
BULK_MAX_GAP_S = 1.0
PAYLOAD_CAP_BYTES = 2048
BEACON_HISTORY = 20
BEACON_MIN_CONNECTIONS = 5
BEACON_MAX_CV = 0.25
BEACON_MIN_MEAN_S = 2.0

# --- fixed values: detection thresholds -------------------------------------
THRESHOLD_IN_DISTRIBUTION = 0.55
THRESHOLD_CROSS_DATASET = 0.35
SIGNATURE_CONFIDENCE = 0.90
BEACON_CONFIDENCE = 0.75
BLOCK_CONFIDENCE = 0.70
MISTAKE_THRESHOLD = 1_000
MISTAKE_CAP = 50_000
BASELINE_MIN_ROWS = 100
BASELINE_ROWS = 50_000
EXPLAIN_EVERY = 500
MINE_EVERY = 2_000
MINE_MIN_ROWS = 50
MINE_MIN_SCORE = 0.1
K_BEST = 30
TRAIN_ROW_CAP = 2_000_000
RETRAIN_ROWS = 20_000
MISTAKE_WEIGHT = 5.0
MIN_RECALL_GAIN = 0.001
MONITOR_EVENTS = 500
MAP_DOTS = 500

# --- fixed values: column names of the two public flow-CSV dialects ---------
COLUMNS_2017 = {
    "Destination Port": "destination_port",
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_backward_packets",
    "Total Length of Fwd Packets": "total_length_of_fwd_packets",
    "Total Length of Bwd Packets": "total_length_of_bwd_packets",
    "Fwd Packet Length Max": "fwd_packet_length_max",
    "Fwd Packet Length Min": "fwd_packet_length_min",
    "Fwd Packet Length Mean": "fwd_packet_length_mean",
    "Fwd Packet Length Std": "fwd_packet_length_std",
    "Bwd Packet Length Max": "bwd_packet_length_max",
    "Bwd Packet Length Min": "bwd_packet_length_min",
    "Bwd Packet Length Mean": "bwd_packet_length_mean",
    "Bwd Packet Length Std": "bwd_packet_length_std",
    "Flow Bytes/s": "flow_bytes_per_s",
    "Flow Packets/s": "flow_packets_per_s",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Min": "flow_iat_min",
    "Fwd IAT Total": "fwd_iat_total",
    "Fwd IAT Mean": "fwd_iat_mean",
    "Fwd IAT Std": "fwd_iat_std",
    "Fwd IAT Max": "fwd_iat_max",
    "Fwd IAT Min": "fwd_iat_min",
    "Bwd IAT Total": "bwd_iat_total",
    "Bwd IAT Mean": "bwd_iat_mean",
    "Bwd IAT Std": "bwd_iat_std",
    "Bwd IAT Max": "bwd_iat_max",
    "Bwd IAT Min": "bwd_iat_min",
    "Fwd PSH Flags": "fwd_psh_flags",
    "Bwd PSH Flags": "bwd_psh_flags",
    "Fwd URG Flags": "fwd_urg_flags",
    "Bwd URG Flags": "bwd_urg_flags",
    "Fwd Header Length": "fwd_header_length",
    "Bwd Header Length": "bwd_header_length",
    "Fwd Packets/s": "fwd_packets_per_s",
    "Bwd Packets/s": "bwd_packets_per_s",
    "Min Packet Length": "min_packet_length",
    "Max Packet Length": "max_packet_length",
    "Packet Length Mean": "packet_length_mean",
    "Packet Length Std": "packet_length_std",
    "Packet Length Variance": "packet_length_variance",
    "FIN Flag Count": "fin_flag_count",
    "SYN Flag Count": "syn_flag_count",
    "RST Flag Count": "rst_flag_count",
    "PSH Flag Count": "psh_flag_count",
    "ACK Flag Count": "ack_flag_count",
    "URG Flag Count": "urg_flag_count",
    "CWE Flag Count": "cwe_flag_count",
    "ECE Flag Count": "ece_flag_count",
    "Down/Up Ratio": "down_per_up_ratio",
    "Average Packet Size": "average_packet_size",
    "Avg Fwd Segment Size": "avg_fwd_segment_size",
    "Avg Bwd Segment Size": "avg_bwd_segment_size",
    "Fwd Header Length.1": "fwd_header_length_1",
    "Fwd Avg Bytes/Bulk": "fwd_avg_bytes_per_bulk",
    "Fwd Avg Packets/Bulk": "fwd_avg_packets_per_bulk",
    "Fwd Avg Bulk Rate": "fwd_avg_bulk_rate",
    "Bwd Avg Bytes/Bulk": "bwd_avg_bytes_per_bulk",
    "Bwd Avg Packets/Bulk": "bwd_avg_packets_per_bulk",
    "Bwd Avg Bulk Rate": "bwd_avg_bulk_rate",
    "Subflow Fwd Packets": "subflow_fwd_packets",
    "Subflow Fwd Bytes": "subflow_fwd_bytes",
    "Subflow Bwd Packets": "subflow_bwd_packets",
    "Subflow Bwd Bytes": "subflow_bwd_bytes",
    "Init_Win_bytes_forward": "init_win_bytes_forward",
    "Init_Win_bytes_backward": "init_win_bytes_backward",
    "act_data_pkt_fwd": "act_data_pkt_fwd",
    "min_seg_size_forward": "min_seg_size_forward",
    "Active Mean": "active_mean",
    "Active Std": "active_std",
    "Active Max": "active_max",
    "Active Min": "active_min",
    "Idle Mean": "idle_mean",
    "Idle Std": "idle_std",
    "Idle Max": "idle_max",
    "Idle Min": "idle_min",
}
COLUMNS_2018 = {
    "Dst Port": "destination_port",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "total_fwd_packets",
    "Tot Bwd Pkts": "total_backward_packets",
    "TotLen Fwd Pkts": "total_length_of_fwd_packets",
    "TotLen Bwd Pkts": "total_length_of_bwd_packets",
    "Fwd Pkt Len Max": "fwd_packet_length_max",
    "Fwd Pkt Len Min": "fwd_packet_length_min",
    "Fwd Pkt Len Mean": "fwd_packet_length_mean",
    "Fwd Pkt Len Std": "fwd_packet_length_std",
    "Bwd Pkt Len Max": "bwd_packet_length_max",
    "Bwd Pkt Len Min": "bwd_packet_length_min",
    "Bwd Pkt Len Mean": "bwd_packet_length_mean",
    "Bwd Pkt Len Std": "bwd_packet_length_std",
    "Flow Byts/s": "flow_bytes_per_s",
    "Flow Pkts/s": "flow_packets_per_s",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Min": "flow_iat_min",
    "Fwd IAT Tot": "fwd_iat_total",
    "Fwd IAT Mean": "fwd_iat_mean",
    "Fwd IAT Std": "fwd_iat_std",
    "Fwd IAT Max": "fwd_iat_max",
    "Fwd IAT Min": "fwd_iat_min",
    "Bwd IAT Tot": "bwd_iat_total",
    "Bwd IAT Mean": "bwd_iat_mean",
    "Bwd IAT Std": "bwd_iat_std",
    "Bwd IAT Max": "bwd_iat_max",
    "Bwd IAT Min": "bwd_iat_min",
    "Fwd PSH Flags": "fwd_psh_flags",
    "Bwd PSH Flags": "bwd_psh_flags",
    "Fwd URG Flags": "fwd_urg_flags",
    "Bwd URG Flags": "bwd_urg_flags",
    "Fwd Header Len": "fwd_header_length",
    "Bwd Header Len": "bwd_header_length",
    "Fwd Pkts/s": "fwd_packets_per_s",
    "Bwd Pkts/s": "bwd_packets_per_s",
    "Pkt Len Min": "min_packet_length",
    "Pkt Len Max": "max_packet_length",
    "Pkt Len Mean": "packet_length_mean",
    "Pkt Len Std": "packet_length_std",
    "Pkt Len Var": "packet_length_variance",
    "FIN Flag Cnt": "fin_flag_count",
    "SYN Flag Cnt": "syn_flag_count",
    "RST Flag Cnt": "rst_flag_count",
    "PSH Flag Cnt": "psh_flag_count",
    "ACK Flag Cnt": "ack_flag_count",
    "URG Flag Cnt": "urg_flag_count",
    "CWE Flag Count": "cwe_flag_count",
    "ECE Flag Cnt": "ece_flag_count",
    "Down/Up Ratio": "down_per_up_ratio",
    "Pkt Size Avg": "average_packet_size",
    "Fwd Seg Size Avg": "avg_fwd_segment_size",
    "Bwd Seg Size Avg": "avg_bwd_segment_size",
    "Fwd Byts/b Avg": "fwd_avg_bytes_per_bulk",
    "Fwd Pkts/b Avg": "fwd_avg_packets_per_bulk",
    "Fwd Blk Rate Avg": "fwd_avg_bulk_rate",
    "Bwd Byts/b Avg": "bwd_avg_bytes_per_bulk",
    "Bwd Pkts/b Avg": "bwd_avg_packets_per_bulk",
    "Bwd Blk Rate Avg": "bwd_avg_bulk_rate",
    "Subflow Fwd Pkts": "subflow_fwd_packets",
    "Subflow Fwd Byts": "subflow_fwd_bytes",
    "Subflow Bwd Pkts": "subflow_bwd_packets",
    "Subflow Bwd Byts": "subflow_bwd_bytes",
    "Init Fwd Win Byts": "init_win_bytes_forward",
    "Init Bwd Win Byts": "init_win_bytes_backward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
    "Active Mean": "active_mean",
    "Active Std": "active_std",
    "Active Max": "active_max",
    "Active Min": "active_min",
    "Idle Mean": "idle_mean",
    "Idle Std": "idle_std",
    "Idle Max": "idle_max",
    "Idle Min": "idle_min",
}
DIALECT_MARKER_2018 = "Dst Port"
LABEL_COLUMNS = ("Label", "label", "LABEL")

# --- fixed values: dataset labels -------------------------------------------
ATTACK_CLASSES = [
    "BENIGN", "DoS", "DDoS", "PortScan", "BruteForce", "Bot",
    "Infiltration", "Heartbleed", "WebAttack",
]
LABEL_CLASS_2017 = {
    "BENIGN": "BENIGN",
    "FTP-Patator": "BruteForce",
    "SSH-Patator": "BruteForce",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "Heartbleed": "Heartbleed",
    "Web Attack – Brute Force": "WebAttack",
    "Web Attack – XSS": "WebAttack",
    "Web Attack – Sql Injection": "WebAttack",
    "Infiltration": "Infiltration",
    "Bot": "Bot",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
}
LABEL_CLASS_2018 = {
    "Benign": "BENIGN",
    "BENIGN": "BENIGN",
    "FTP-BruteForce": "BruteForce",
    "SSH-Bruteforce": "BruteForce",
    "DoS attacks-Hulk": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDOS attack-HOIC": "DDoS",
    "DDOS attack-LOIC-UDP": "DDoS",
    "Brute Force -Web": "WebAttack",
    "Brute Force -XSS": "WebAttack",
    "SQL Injection": "WebAttack",
    "Infilteration": "Infiltration",
    "Bot": "Bot",
}

# --- fixed values: the ten-feature model ------------------------------------
ENGINEERED_FEATURES = [
    "bwd_packet_length_std",
    "average_packet_size",
    "packet_length_mean",
    "packet_length_std",
    "max_packet_length",
    "bytes_per_pkt",
    "psh_flag_count",
    "destination_port",
    "urg_flag_count",
    "bwd_packet_length_mean",
]

# --- fixed values: ATT&CK mapping (attack -> tactic, technique, name) -------
MITRE = {
    "BruteForce": ("Initial Access", "T1110", "Brute Force"),
    "Phishing": ("Initial Access", "T1566", "Phishing"),
    "SQLInjection": ("Execution", "T1190", "Exploit Public-Facing Application"),
    "XSS": ("Execution", "T1059.007", "JavaScript"),
    "CommandInject": ("Execution", "T1059", "Command and Scripting Interpreter"),
    "Bot": ("Persistence", "T1543", "Create or Modify System Process"),
    "Infiltration": ("Lateral Movement", "T1078", "Valid Accounts"),
    "PortScan": ("Discovery", "T1046", "Network Service Scanning"),
    "DDoS": ("Impact", "T1498", "Network Denial of Service"),
    "DoS": ("Impact", "T1499", "Endpoint Denial of Service"),
    "Heartbleed": ("Defense Evasion", "T1600", "Weaken Encryption"),
    "Exfiltration": ("Exfiltration", "T1041", "Exfiltration Over C2 Channel"),
    "ZeroDay": ("Multiple", "T1203", "Exploitation for Client Execution"),
    "WebShell": ("Persistence", "T1505.003", "Server Software Component: Web Shell"),
}
LABEL_ALIASES = {
    "ftp-patator": "BruteForce",
    "ssh-patator": "BruteForce",
    "ftp-bruteforce": "BruteForce",
    "ssh-bruteforce": "BruteForce",
    "brute force -web": "BruteForce",
    "brute force -xss": "XSS",
    "dos slowloris": "DoS",
    "dos hulk": "DoS",
    "dos goldeneye": "DoS",
    "dos slowhttptest": "DoS",
    "dos attacks-hulk": "DoS",
    "dos attacks-slowhttptest": "DoS",
    "dos attacks-goldeneye": "DoS",
    "dos attacks-slowloris": "DoS",
    "ddos": "DDoS",
    "ddos attacks-loic-http": "DDoS",
    "ddos attack-hoic": "DDoS",
    "ddos attack-loic-udp": "DDoS",
    "portscan": "PortScan",
    "bot": "Bot",
    "infiltration": "Infiltration",
    "infilteration": "Infiltration",
    "heartbleed": "Heartbleed",
    "sql injection": "SQLInjection",
    "xss": "XSS",
    "web attack – sql injection": "SQLInjection",
    "web attack – xss": "XSS",
    "web attack – brute force": "BruteForce",
}
# technique -> (detection hint, platforms, data sources)
TECHNIQUES = {
    "T1110": ("Multiple failed logins from single source within short window",
              ["Windows", "Linux", "macOS", "Network"],
              ["Authentication logs", "Windows event 4625"]),
    "T1566": ("Suspicious sender domain, malicious URL in body",
              ["Windows", "Linux", "macOS", "Office 365"],
              ["Email gateway logs", "Web proxy logs"]),
    "T1190": ("SQL metacharacters in request parameters",
              ["Network"],
              ["Web application firewall", "Network traffic"]),
    "T1059.007": ("Script tags or JS event handlers in HTTP requests",
                  ["Windows", "macOS", "Linux"],
                  ["Browser logs", "Web proxy logs"]),
    "T1059": ("Shell metacharacters in web input fields",
              ["Windows", "Linux", "macOS"],
              ["Process monitoring", "Command-line logs"]),
    "T1543": ("Beaconing to C2 at regular intervals",
              ["Windows", "Linux", "macOS"],
              ["Process monitoring", "Network traffic"]),
    "T1078": ("Valid credentials used from unusual location or time",
              ["Windows", "Linux", "macOS", "Cloud"],
              ["Authentication logs", "Network flow"]),
    "T1046": ("Sequential port connections to many hosts",
              ["Network"],
              ["Network traffic", "Netflow"]),
    "T1498": ("High-volume traffic flood from distributed sources",
              ["Network"],
              ["Network traffic", "Netflow"]),
    "T1499": ("Sustained high-rate requests exhausting server resources",
              ["Windows", "Linux", "macOS", "Network"],
              ["Network traffic", "System metrics"]),
    "T1600": ("Heartbeat extension with oversized payload",
              ["Network"],
              ["Network traffic", "TLS inspection"]),
    "T1041": ("Large outbound transfers over established C2 channel",
              ["Windows", "Linux", "macOS"],
              ["Network traffic", "DLP"]),
    "T1203": ("Unknown pattern — anomaly score exceeds baseline",
              ["Windows", "Linux", "macOS"],
              ["Process monitoring", "Network traffic"]),
}
KILL_CHAIN = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution",
    "Persistence", "Privilege Escalation", "Defense Evasion",
    "Credential Access", "Discovery", "Lateral Movement", "Collection",
    "Command and Control", "Exfiltration", "Impact",
]
PHASE_GAP_MINUTES = 30

# --- fixed values: severity, response, honeypots ----------------------------
SEVERITY_ORDER = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_LEVELS = {
    "CRITICAL": ["Infiltration", "ZeroDay", "Heartbleed", "APT", "Honeypot", "WebShell"],
    "HIGH": ["DDoS", "DoS", "Bot", "Ransomware", "CommandInject", "PathTraversal"],
    "MEDIUM": ["BruteForce", "SQLInjection", "XSS", "CSRF"],
    "LOW": ["PortScan", "Phishing"],
    "INFO": ["Reconnaissance"],
}
RESPONSE_MATRIX = {
    "DDoS": ["rate_limit", "ip_block", "alert_high", "log_pcap"],
    "DoS": ["rate_limit", "ip_block", "alert_high", "log_pcap"],
    "PortScan": ["ip_block_24h", "alert_medium", "log"],
    "BruteForce": ["ip_block_1h", "invalidate_sessions", "alert_medium"],
    "SQLInjection": ["block_request", "alert_medium", "log_payload"],
    "XSS": ["sanitize_input", "block_request", "alert_medium"],
    "CommandInject": ["block_request", "ip_block_1h", "alert_high", "log_payload"],
    "PathTraversal": ["block_request", "ip_block_1h", "alert_high", "log_payload"],
    "Phishing": ["block_domain", "alert_medium", "notify_admin"],
    "Bot": ["ip_block", "c2_domain_block", "alert_high"],
    "Infiltration": ["isolate_connection", "alert_critical", "log_pcap"],
    "Heartbleed": ["block_tls", "alert_critical", "patch_notify"],
    "ZeroDay": ["quarantine", "alert_critical", "capture_all", "retrain"],
    "APT": ["isolate_full", "alert_critical", "forensics_mode"],
    "Honeypot": ["ip_block", "alert_critical", "capture_all"],
    "WebShell": ["block_request", "ip_block", "quarantine_file", "alert_critical"],
    "CSRF": ["invalidate_session", "alert_medium"],
}
BLOCK_SECONDS = {"ip_block_1h": 3600, "ip_block_24h": 86400, "ip_block": 3600}
RATE_LIMITS = {
    "DDoS": 5.0,
    "DoS": 10.0,
    "BruteForce": 2.0,
    "PortScan": 20.0,
    "Bot": 5.0,
    "SQLInjection": 3.0,
    "XSS": 3.0,
    "Infiltration": 1.0,
    "Heartbleed": 1.0,
    "ZeroDay": 1.0,
    "APT": 1.0,
    "Phishing": 5.0,
}
RATE_DEFAULT = 30.0
RATE_BURST = 3.0
RATE_FORCED = 0.1
RATE_IDLE_EVICT_S = 300
ALERT_WINDOW_S = 60
SESSION_TTL_S = 86_400
HONEYPOT_SERVICES = {
    2222: "fake_ssh",
    2121: "fake_ftp",
    8080: "fake_admin",
    5432: "fake_db",
    9000: "fake_api",
}

# --- fixed values: risk score -----------------------------------------------
RISK_WEIGHTS = {
    "confidence": 0.25,
    "severity": 0.25,
    "kill_chain": 0.20,
    "ip_reputation": 0.15,
    "sophistication": 0.10,
    "recurrence": 0.05,
}
RISK_SEVERITY = {"CRITICAL": 100.0, "HIGH": 75.0, "MEDIUM": 50.0, "LOW": 25.0, "INFO": 10.0}
RISK_TACTIC = {
    "Reconnaissance": 10.0,
    "Resource Development": 15.0,
    "Initial Access": 30.0,
    "Execution": 45.0,
    "Persistence": 55.0,
    "Privilege Escalation": 65.0,
    "Defense Evasion": 70.0,
    "Credential Access": 72.0,
    "Discovery": 40.0,
    "Lateral Movement": 80.0,
    "Collection": 75.0,
    "Command and Control": 85.0,
    "Exfiltration": 90.0,
    "Impact": 95.0,
    "Multiple": 85.0,
    "Unknown": 20.0,
}
RISK_ACTOR = {"APT": 100.0, "Organised": 65.0, "ScriptKiddie": 20.0, "Insider": 80.0, "Unknown": 30.0}
RISK_LABELS = [(90, "CRITICAL"), (70, "HIGH"), (45, "MEDIUM"), (20, "LOW")]

# --- fixed values: attacker classification ----------------------------------
ACTOR_POINTS = {
    "multi_tactic": 15,
    "lateral_movement": 20,
    "persistence": 15,
    "defence_evasion": 10,
    "slow_tempo": 10,
    "high_target_diversity": 10,
    "repeated_attacker": 10,
    "vpn_or_proxy": 10,
}
ACTOR_APT, ACTOR_ORGANISED, INSIDER_MAX_PORTS = 60, 35, 3

# --- fixed values: reputation -----------------------------------------------
BLACKLIST_POINTS, TOR_POINTS, ABUSE_MIN = 100, 60, 25
MALICIOUS_SCORE = 75

# --- fixed values: payload signature patterns, in match order ---------------
SQL_PATTERNS = [
    r"(\%27)|(\')|(\-\-)|(\%23)|(#)",
    r"((\%3D)|(=))[^\n]*((\%27)|(\')|(\-\-))",
    r"UNION.+SELECT",
    r"INSERT\s+INTO",
    r"DROP\s+TABLE",
    r"exec(\s|\+)+(s|x)p\w+",
    r"\bSELECT\b.+\bFROM\b",
    r"\bOR\s+[\w\d'\"]+\s*=\s*[\w\d'\"]+",
    r"\bAND\s+[\w\d'\"]+\s*=\s*[\w\d'\"]+",
    r"\bDELETE\s+FROM\b",
    r"\bUPDATE\b.+\bSET\b",
    r"\bWAITFOR\s+DELAY\b",
    r"\bSLEEP\s*\(\s*\d+\s*\)",
    r"\bBENCHMARK\s*\(",
    r";\s*(DROP|DELETE|UPDATE|INSERT)\b",
]
XSS_PATTERNS = [
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"\bon\w+\s*=",
    r"<iframe",
    r"document\.cookie",
    r"eval\(",
]
COMMAND_PATTERNS = [
    r"[|`]|&&",
    r";\s*(ls|cat|whoami|id|pwd|uname|wget|curl|nc|bash|sh|python[23]?|perl|rm|chmod|kill|ping|ifconfig|netstat|ps)\b",
    r"\$\(.*\)",
    r"wget\s+http",
    r"curl\s+http",
    r"/bin/(bash|sh|cmd)",
]
TRAVERSAL_PATTERNS = [
    r"\.\./",
    r"\.\.[/\\]",
    r"%2e%2e[%2f%5c]",
    r"\.\.%2f",
    r"\.\.%5c",
    r"/etc/passwd",
    r"/etc/shadow",
    r"[Cc]:\\[Ww]indows",
]
WEBSHELL_PATTERNS = [
    r"(eval|system|exec|passthru|shell_exec|assert)\s*\(\s*\$_(GET|POST|REQUEST|COOKIE)",
    r"Runtime\.getRuntime\(\)\.exec",
    r"System\.Diagnostics\.Process",
    r"<%@\s*page.*Runtime",
    r"/(c99|r57|b374k|wso|webshell)\.(php|asp|aspx|jsp)",
]
PAYLOAD_FAMILIES = [
    ("WebShell", WEBSHELL_PATTERNS),
    ("SQLInjection", SQL_PATTERNS),
    ("XSS", XSS_PATTERNS),
    ("CommandInject", COMMAND_PATTERNS),
    ("PathTraversal", TRAVERSAL_PATTERNS),
]
BASIC_AUTH_PATTERNS = [r"Basic\s+[A-Za-z0-9+/=]{4,}"]
HEADER_NAMES_SCANNED = ["user-agent", "referer", "x-forwarded-for", "cookie"]

# --- fixed values: URL signature patterns, in match order -------------------
URL_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".xyz", ".gq", ".pw",
    ".top", ".work", ".click", ".download", ".loan",
]
URL_HOMOGRAPHS = [
    r"paypa[l1][^a-z]",
    r"g[o0]{2}gle",
    r"micros[o0]ft",
    r"app[l1]e[^a-z]",
    r"arnazon",
    r"amazon[^.a-z]",
    r"faceb[o0]{2}k",
]
URL_SHORTENERS = [r"bit\.ly/", r"tinyurl\.com/", r"t\.co/", r"goo\.gl/", r"is\.gd/"]
URL_RAW_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})/"
REQUEST_LINE = r"^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+(\S+)\s+HTTP/"
CSRF_PATH_PREFIXES = ["/account/"]
CSRF_REQUEST_LINE = r"^(POST|PUT|DELETE|PATCH)\s+(\S+)\s+HTTP/"
CSRF_COOKIE = r"(?mi)^Cookie:\s*(.+)$"
CSRF_SESSION = r"(?i)\bsession=([^;\s]+)"
CSRF_HOST = r"(?mi)^Host:\s*([^\s:]+)"
CSRF_ORIGIN = r"(?mi)^(?:Origin|Referer):\s*(\S+)"

# --- fixed values: domain reputation ----------------------------------------
DOMAIN_TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".xyz", ".gq", ".pw",
    ".top", ".work", ".click", ".download", ".loan", ".win",
    ".stream", ".racing", ".party", ".review", ".trade",
]
DOMAIN_SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly",
    "is.gd", "buff.ly", "adf.ly", "short.io", "rb.gy",
]
DOMAIN_HOMOGRAPHS = [
    r"paypa[l1][^a-z]",
    r"g[o0]{2}gle",
    r"micros[o0]ft",
    r"app[l1]e[^a-z]",
    r"arnazon",
    r"am[a4]zon[^.a-z]",
    r"faceb[o0]{2}k",
    r"twitt[e3]r",
    r"[il1]{3}inkedin",
    r"d[r0]opbox",
]
DOMAIN_KEYWORDS = (
    r"(free-?download|crack|keygen|warez|torrent|nulled|exploit|"
    r"ransomware|backdoor|rootkit|botnet|cryptominer|stealer)"
)
DOMAIN_POINTS = {"tld": 0.4, "shortener": 0.5, "homograph": 0.7, "keyword": 0.6}

# --- fixed values: TLS metadata ---------------------------------------------
JA3_MALICIOUS_PREFIXES = ["e7d705", "a0e9f5", "6734f37", "51c64c"]
WEAK_CIPHERS = ["RC4", "NULL", "EXPORT", "DES", "3DES", "MD5", "anon"]
TLS_BEACON_FREQUENCY, TLS_BEACON_VARIANCE = 20, 0.05

# --- fixed values: metric targets and tolerances ----------------------------
METRIC_TARGETS = {
    "2017_binary": {
        "accuracy": 0.9969, "precision": 0.9853, "recall": 0.9968, "f1": 0.9910,
        "roc_auc": 0.9999, "fp_rate": 0.0031, "fn_rate": 0.0032,
    },
    "cross_dataset": {
        "accuracy": 0.8564, "precision": 0.7418, "recall": 0.2012,
        "f1": 0.3166, "roc_auc": 0.9235,
    },
    "combined_training": {"recall": 0.8083, "f1": 0.8940, "precision": 1.0000},
    "lightweight": {"accuracy": 0.9947, "f1": 0.9846, "roc_auc": 0.9995},
    "multiclass": {"f1_macro": 0.8831},
}
METRIC_TOLERANCE = {
    "accuracy": 0.005, "precision": 0.010, "recall": 0.015, "f1": 0.010,
    "roc_auc": 0.005, "fp_rate": 0.005, "fn_rate": 0.005, "f1_macro": 0.020,
}
LOWER_IS_BETTER = ("fp_rate", "fn_rate")

# --- fixed values: narration texts ------------------------------------------
FEATURE_TEXT = {
    "bwd_packet_length_std": "high variance in backward (server-to-client) packet sizes",
    "average_packet_size": "unusually large average packet size",
    "packet_length_mean": "elevated mean packet length",
    "packet_length_std": "high packet-length variance",
    "max_packet_length": "very large maximum packet size",
    "bytes_per_pkt": "high bytes-per-packet ratio",
    "psh_flag_count": "elevated TCP PSH flag usage (data-push heavy session)",
    "destination_port": "suspicious destination port",
    "urg_flag_count": "abnormal TCP URG (urgent) flag activity",
    "bwd_packet_length_mean": "elevated mean backward packet length",
    "bwd_iat_std": "irregular backward inter-arrival time",
    "avg_bwd_segment_size": "large average backward TCP segment",
    "idle_mean": "abnormally long idle periods between flows",
    "bwd_packet_length_max": "very large backward packet detected",
    "fwd_iat_max": "long maximum forward inter-arrival gap",
    "syn_flag_count": "high SYN flag count (possible SYN flood or port scan)",
    "fin_flag_count": "abnormal FIN flag rate (abrupt connection teardown)",
    "rst_flag_count": "high TCP RST count (connection resets / scan evidence)",
    "flow_duration": "abnormal flow duration",
    "total_fwd_packets": "high number of forward packets (data exfiltration candidate)",
    "total_backward_packets": "high backward packet count",
    "flow_bytes_per_s": "extreme byte rate",
    "flow_packets_per_s": "extreme packet rate (volumetric attack candidate)",
    "init_win_bytes_forward": "suspicious initial TCP window size",
    "init_win_bytes_backward": "suspicious server-side TCP window size",
    "fwd_psh_flags": "forward PSH flags set (data push from client)",
    "bwd_psh_flags": "backward PSH flags set (data push from server)",
    "act_data_pkt_fwd": "high actual data packet count in forward direction",
    "fwd_packet_length_max": "large forward packet detected",
    "subflow_fwd_bytes": "high subflow forward byte count",
}
ATTACK_TEXT = {
    "DDoS": "a Distributed Denial-of-Service flood targeting network availability",
    "DoS": "a Denial-of-Service attack exhausting server resources",
    "PortScan": "network reconnaissance / port enumeration activity",
    "BruteForce": "credential brute-forcing or password-spraying",
    "SQLInjection": "SQL injection targeting database access",
    "XSS": "cross-site scripting payload injection",
    "Bot": "botnet C2 communication or automated bot behaviour",
    "Infiltration": "lateral movement and internal reconnaissance",
    "Heartbleed": "TLS Heartbleed memory-leak exploitation",
    "ZeroDay": "an unknown/zero-day attack pattern flagged by anomaly detection",
    "APT": "advanced persistent threat behaviour",
    "Phishing": "phishing or malicious URL activity",
    "CommandInject": "OS command injection via web input",
    "PathTraversal": "directory traversal attack",
    "Ransomware": "ransomware file-encryption behaviour",
}
ACTION_TEXT = {
    "DDoS": "Activate rate-limiting and upstream DDoS mitigation; block source ASN if volumetric.",
    "DoS": "Rate-limit source IP; check server load and apply connection throttle.",
    "PortScan": "Block source IP for 24 h; check whether scan targeted internal services.",
    "BruteForce": "Block source IP for 1 h; force password reset on targeted accounts; enforce MFA.",
    "SQLInjection": "Block request; review database query logs; patch vulnerable endpoint.",
    "XSS": "Block request; audit application input-validation; deploy CSP header.",
    "Bot": "Block source IP and C2 domain; check for other infected hosts beaconing out.",
    "Infiltration": "CRITICAL — isolate affected network segment; initiate full forensic investigation.",
    "Heartbleed": "CRITICAL — patch OpenSSL; revoke and reissue all TLS certificates immediately.",
    "ZeroDay": "CRITICAL — quarantine source; capture all traffic; trigger adaptive retrain.",
    "APT": "CRITICAL — engage threat-hunting team; full network isolation; evidence preservation.",
    "Phishing": "Block malicious domain; notify affected users; scan for credential reuse.",
    "CommandInject": "Block request; audit web application logs for prior exploitation.",
    "PathTraversal": "Block request; audit file-access logs; restrict web-server directory permissions.",
}
ACTION_DEFAULT = "Investigate the source IP and review related network logs."
ALERT_COLOURS = {
    "CRITICAL": "#FF0000", "HIGH": "#FF6600", "MEDIUM": "#FFCC00",
    "LOW": "#36A64F", "INFO": "#439FE0",
}

# --- fixed values: incident report rules and texts --------------------------
CONSEQUENCES = [
    (["SQLInjection", "Infiltration"], "Potential unauthorised access to personal data"),
    (["DDoS", "DoS"], "Temporary loss of availability of services"),
    (["BruteForce", "XSS"], "Potential credential compromise or session hijacking"),
    (["Bot", "APT"], "Potential persistent access by threat actor"),
]
CONSEQUENCE_DEFAULT = "Potential disruption to network services"
BREACH_BANDS = [
    (["Infiltration", "ZeroDay", "APT", "Heartbleed"],
     "HIGH — Likely requires notification to supervisory authority AND data subjects"),
    (["DDoS", "DoS", "Bot", "Ransomware"],
     "MEDIUM — Requires notification to supervisory authority"),
]
BREACH_DEFAULT = "LOW — Document internally; notify authority if doubt"
INCIDENT_CLASSES = [
    (["APT", "Infiltration", "ZeroDay"], "A.16.1.5 — Response to information security incidents"),
    (["DDoS", "DoS", "Ransomware"],
     "A.16.1.4 — Assessment of and decision on information security events"),
]
INCIDENT_DEFAULT = "A.16.1.2 — Reporting information security events"
ROOT_CAUSE_STAGES = (
    ["Initial Access", "Lateral Movement"],
    "Attacker gained initial foothold and moved laterally — weak network segmentation suspected.",
)
ROOT_CAUSES = [
    (["BruteForce"], "Credential brute-force attack — lack of account lockout or MFA."),
    (["SQLInjection", "XSS"], "Web application vulnerability — insufficient input validation."),
    (["DDoS", "DoS"],
     "Volumetric denial-of-service — insufficient rate limiting / DDoS mitigation."),
]
ROOT_CAUSE_DEFAULT = "Root cause under investigation — refer to forensic timeline."
ERADICATION_ALWAYS = [
    "Block all identified malicious IP ranges at perimeter firewall",
    "Reset passwords for all accounts accessed during the incident window",
]
ERADICATION = [
    (["SQLInjection", "XSS", "CommandInject"],
     "Patch or WAF-protect the vulnerable web application endpoint"),
    (["Bot"], "Identify and clean all C2-beaconing endpoints"),
    (["Heartbleed"], "Patch OpenSSL and revoke/reissue TLS certificates"),
]
CORRECTIVE_ALWAYS = [
    "Update IDS/IPS signatures with patterns from this incident",
    "Review and tighten firewall and WAF rules",
]
CORRECTIVE_ADVANCED = [
    "Engage threat-hunting team for deeper investigation",
    "Implement network micro-segmentation to limit lateral movement",
]
CORRECTIVE = [
    (["BruteForce"], "Enforce MFA on all externally-facing authentication endpoints"),
]

# --- fixed values: zero-day cluster hints (feature, sign, bound, text) ------
CLUSTER_HINTS = [
    ("bwd_packet_length_std", ">", 1.0,
     "high backward packet-length variance (possible exfiltration or C2)"),
    ("psh_flag_count", ">", 1.0, "elevated PSH flags (data-push heavy session)"),
    ("syn_flag_count", ">", 1.0, "high SYN count (possible SYN flood or port sweep)"),
    ("flow_duration", "<", -0.5, "very short flow duration (fast-scan pattern)"),
    ("total_fwd_packets", ">", 1.5, "high forward packet count (possible data-push attack)"),
    ("destination_port", ">", 1.0, "anomalous destination port distribution"),
]

# --- fixed values: address blocks treated as private (first, last) ----------
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
