"""URL verdicts on our own cases with a supplied DNS table."""

from pagewise.operators.admission import url_verdict

CASES = {
    "http://example.com": None,
    "https://example.com/path?q=test": None,
    "HTTPS://Example.COM:8080/api": None,
    "ftp://example.com/file": "INVALID_SCHEME",
    "file:///etc/passwd": "INVALID_SCHEME",
    "javascript:alert(1)": "INVALID_SCHEME",
    "data:text/html,<h1>x</h1>": "INVALID_SCHEME",
    "http:///nohost": "NO_HOST",
    "http://169.254.169.254/latest": "BLOCKED_HOST",
    "http://metadata.google.internal/x": "BLOCKED_HOST",
    "http://127.0.0.1/admin": "PRIVATE_ADDRESS",
    "http://10.0.0.1/": "PRIVATE_ADDRESS",
    "http://10.255.255.255/": "PRIVATE_ADDRESS",
    "http://11.0.0.0/": None,
    "http://172.16.0.1/": "PRIVATE_ADDRESS",
    "http://172.31.255.255/": "PRIVATE_ADDRESS",
    "http://172.32.0.0/": None,
    "http://192.168.1.1/": "PRIVATE_ADDRESS",
    "http://0.1.2.3/": "PRIVATE_ADDRESS",
    "http://localhost/admin": "PRIVATE_ADDRESS",
    "http://six.example.com/": "PRIVATE_ADDRESS",
    "http://[fe80::1]/": "PRIVATE_ADDRESS",
    "http://[2001:db8::1]/": None,
    "http://[::1]/": "PRIVATE_ADDRESS",
    "http://[fd00::1]/": "PRIVATE_ADDRESS",
    "http://[fe80::1]/": "PRIVATE_ADDRESS",
    "http://[2001:db8::1]/": None,
    "http://unresolvable.invalid/": "UNRESOLVABLE",
    "http://mixed.example/": "PRIVATE_ADDRESS",
    "http://blocked.example/secret": "BLOCKED_PATTERN",
    "http://example.com/a path with spaces": None,
}
DNS = [("example.com", "93.184.216.34"), ("localhost", "127.0.0.1"), ("mixed.example", "93.184.216.35"),
       ("mixed.example", "192.168.0.7"), ("blocked.example", "93.184.216.36"), ("six.example.com", "203.0.113.9"), ("six.example.com", "fd00::1")]


def test_verdicts(spark):
    urls = spark.createDataFrame([(u,) for u in CASES], "url STRING")
    dns = spark.createDataFrame(DNS, "host STRING, ip STRING")
    got = {r.url: r.reason for r in url_verdict(urls, dns, [" /secret ", "", "   "]).collect()}
    assert got == CASES
