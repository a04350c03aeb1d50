"""Thresholds and fixed lists of the detection rules, as one frozen value passed to operators."""

from dataclasses import dataclass

# Ports, addresses, names and thresholds that the rules' results depend on.
SERVICE_PORTS = (21, 22, 25, 53, 67, 68, 80, 110, 123, 143, 161, 443, 445, 993, 995, 1883, 3306, 5060, 5353, 5432, 8008, 8009, 8080, 8443, 8888, 9090, 27017)
OUTBOUND_PORTS = (80, 443, 8080, 8443, 27015, 27016, 27017, 27018)
BAD_PORTS = (4444, 5555, 6666, 1337, 31337, 12345, 65535)
BAD_PORT_NAMES = {4444: "Metasploit/Meterpreter", 5555: "Android ADB/Trojan", 6666: "IRC Backdoor", 1337: "Common Backdoor", 31337: "Back Orifice", 12345: "NetBus Trojan", 65535: "Backdoor", 6667: "IRC Botnet C2"}
SERVICE_NAMES = {22: "SSH", 3389: "RDP", 21: "FTP", 23: "Telnet", 445: "SMB", 1433: "MSSQL", 3306: "MySQL", 5432: "PostgreSQL"}
SPECIAL_ADDRESSES = ("255.255.255.255", "0.0.0.0", "::", "::1", "ff02::1", "ff02::2", "ff02::fb", "ff02::1:3")
NOISY_PORTS = (5353, 1900, 3702, 5355, 137, 138, 139, 547, 546, 67, 68, 10001, 8008, 8443)
ABUSE_ENDINGS = ("xyz", "top", "buzz", "tk", "ml", "ga", "cf")
TOR_PORTS = (9001, 9030, 9050, 9051, 9150)
DOH_ADDRESSES = ("1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220", "94.140.14.14", "94.140.15.15")
LISTEN_PORTS = (4444, 5555, 6666, 6667, 1337, 31337, 12345, 27374, 3127, 9999, 7777, 65535, 1234, 8888, 9090, 2222, 3333)
DYNAMIC_DNS = ("no-ip.com", "no-ip.org", "no-ip.biz", "ddns.net", "duckdns.org", "freedns.afraid.org", "changeip.com", "hopto.org", "zapto.org", "sytes.net", "serveftp.com")
TWO_PART_ENDINGS = ("co.uk", "co.jp", "com.au", "co.nz", "co.in", "com.br")
ESCALATION = ((("Reconnaissance", "Suspicious Port"), ("Brute Force", "DoS")), (("Threat Intelligence",), ("Exfiltration", "Data Exposure")), (("Credential Exposure",), ("Brute Force", "Threat Intelligence")))
DEVICE_PORTS = (("printer", (515, 631, 9100), 1), ("camera", (554, 8554), 1), ("dns_server", (53,), 1), ("iot_hub", (1883, 8883, 8123), 1), ("web_server", (80, 443, 8080, 8443), 2), ("database", (3306, 5432, 1433, 6379, 27017), 1))
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Config:
    scan_ports: int = 15
    scan_ms: int = 60_000
    failures: int = 10
    failure_ms: int = 30_000
    flood_ms: int = 10_000
    syn_flood: int = 50
    syn_flood_local: int = 200
    icmp_flood: int = 30
    dns_flood: int = 50
    tunnel_length: int = 60
    upload_mb: int = 100
    odd_hours: tuple = (2, 5)
    odd_hour_bytes: int = 50_000
    cooldown_ms: int = 30_000
    incident_ms: int = 300_000
    dns_memory_ms: int = 30_000
    flow_idle: str = "120 seconds"
    beacon_packets: int = 15
    beacon_cv: float = 0.05
    dga_entropy: float = 3.8
    dga_label: int = 10
    dga_domains: int = 5
    anomaly: float = 0.25
    trees: int = 200
    #: lookup lists are parameters: first-party cloud suffixes, hosting suffixes, infrastructure addresses, gateways
    cloud_suffixes: tuple = ()
    hosting_suffixes: tuple = ()
    infrastructure: tuple = ()
    gateways: tuple = ()


DEFAULT = Config()

# Domains under which anyone can put a site. Names of large first-party services are a table that the caller brings.
HOSTING_SUFFIXES = (
    "appspot.com", "web.app", "firebaseapp.com", "cloudfunctions.net", "run.app", "azurewebsites.net", "cloudapp.net", "azurefd.net", "blob.core.windows.net", "herokuapp.com", "netlify.app", "vercel.app",
    "pages.dev", "workers.dev", "r2.dev", "onrender.com", "fly.dev", "railway.app", "deno.dev", "s3.amazonaws.com", "execute-api.amazonaws.com", "elasticbeanstalk.com", "amplifyapp.com", "github.io",
    "gitlab.io", "bitbucket.io", "blogspot.com", "wordpress.com", "wixsite.com", "squarespace.com", "myshopify.com", "webflow.io", "carrd.co", "notion.site",
)
# Indicator categories that are critical wherever they are met.
CRITICAL_CATEGORIES = ("Botnet C2", "Malicious SSL")
