"""A row of each kind for the lists of payload findings."""

from packetlake.operators import payload

KINDS = {
    "SQL Injection attempt": "GET /a?id=1+union+select+1 HTTP/1.1",
    "Path traversal attempt": "GET /a?f=..\\..\\boot.ini HTTP/1.1",
    "Command injection attempt": "GET /a?x=1;whoami HTTP/1.1",
    "Log4Shell (CVE-2021-44228) exploit attempt": "GET /?x=${jndi:ldap} HTTP/1.1",
    "Shellshock (CVE-2014-6271) exploit attempt": "GET / HTTP/1.1\r\nCookie: () { :;}",
    "Webshell access attempt": "GET /c99.php HTTP/1.1",
    "WordPress exploit probe": "GET /wp-admin/setup.php?step=1 HTTP/1.1",
    "Admin panel probe": "GET /phpmyadmin/ HTTP/1.1",
}
SCHEMA = "pkt_id long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, payload string"


def frame(spark, texts):
    return spark.createDataFrame([(k, k, f"10.0.0.{k}", "10.0.1.1", 5000, 80, t) for k, t in enumerate(texts)], SCHEMA)


def test_each_attack_is_named(spark):
    got = {r.pkt_id: r.attack for r in payload.attacks(frame(spark, [*KINDS.values(), "GET /api/admin/settings HTTP/1.1"])).collect()}
    assert got == dict(enumerate(KINDS))


def test_each_attack_agent_is_named(spark):
    texts = [f"GET / HTTP/1.1\r\nuser-agent: Mozilla/5.0 {a.upper()}1.0\r\n\r\n" for a in payload.ATTACK_AGENTS] + ["GET / HTTP/1.1\r\nUser-Agent: Mozilla/5.0 Firefox\r\nX: sqlmap\r\n\r\n"]
    got = {r.first_pkt: r.signature for r in payload.attack_agents(frame(spark, texts)).collect()}
    assert set(got) == set(range(len(payload.ATTACK_AGENTS)))
    assert all(payload.ATTACK_AGENTS[k].find(s) >= 0 for k, s in got.items())


def test_each_header_discloses(spark):
    text = "HTTP/1.1 200 OK\r\nServer: nginx/1.4.6\r\nX-Powered-By: PHP/8.1\r\nX-AspNet-Version: 4.0\r\nx-php-version: 8.2\r\nX-Generator: Drupal\r\n\r\n"
    got = {r.header: r.risk for r in payload.disclosures(frame(spark, [text])).collect()}
    assert got == {"Server": "HIGH", "X-Powered-By": "MEDIUM", "X-AspNet-Version": "MEDIUM", "X-PHP-Version": "MEDIUM", "X-Generator": "LOW"}
