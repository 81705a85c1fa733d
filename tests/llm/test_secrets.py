import json
import random
import string
import time

from lodeline.llm.secrets import found_secrets, scan, scan_json, scan_text, spans

ALNUM = string.ascii_letters + string.digits


def made(n, seed, alphabet=ALNUM):
    rnd = random.Random(seed)
    return "".join(rnd.choice(alphabet) for _ in range(n))


def tokens():
    """Token-shaped values, put together here so that none stands in the repository."""
    return {
        "akia": "AK" + "IA" + made(16, 1, string.ascii_uppercase + string.digits), "gh": "gh" + "p_" + made(36, 2), "aiza": "AI" + "za" + made(35, 3),
        "gl": "glp" + "at-" + made(20, 4), "npm": "np" + "m_" + made(36, 5), "sk": "s" + "k-" + "a1" + made(30, 6), "xox": "xo" + "xb-123456789012-" + made(24, 7) + "1",
    }


def armor(kind="RSA "):
    return f"-----BEGIN {kind}PRIV" + f"ATE KEY-----\n{made(64, 8)}\n{made(64, 9)}\n-----END {kind}PRIV" + "ATE KEY-----"


def test_contexts():
    pw = "Zu7!" + made(8, 10) + "~"
    for text in (
        f"password: {pw}", f'db_password = "{pw}"', f"export SMTP_PASS={pw}", f"signingKey := '{pw}' // note", f"<apiKey>{pw}</apiKey>", f'{{"sessionPasswd": "{pw}", "n": 1}}',
        f"redis://svc_token:{pw}@db.example:1/x", f'conn = "Server=a;User Id=b;Pwd={pw};Encrypt=true"', f"Authorization: Bearer {pw}", f"sshpass -p {pw} ssh u@h", f"mysql -u root -p{pw} db",
        f"docker login -u ci --password {pw} reg", f"machine m login bot password {pw}", f"set smtp password to {pw} for staging", f"use api_key '{pw}' in X", f"fix login (pwd: {pw})",
        f"    pass: \"{pw}\"", f"ENV TOKEN={pw} \\", f"-H \"PRIVATE-TOKEN: {pw}\"", f"req.setHeader('X-Api-Key', '{pw}');", f"PGPASSWORD={pw} psql -h x", f"https://x.example/y?access_token={pw}&n=1",
    ):
        assert scan_text(text)[0] == [pw], text
        assert pw not in scan_text(text)[1]


def test_formats_and_armor():
    for t in tokens().values():
        assert scan_text(f"x {t} y")[0] == [t] and scan_text(t)[0] == [t]
    block = armor()
    assert scan_text(f"a\n{block}\nb") == ([block], "a\n[REDACTED]\nb")
    assert scan_text(f'K="{block}"')[0] == [block]


def test_what_only_looks_like_one():
    sha = made(40, 11, "0123456789abcdef")
    for text in (
        "password_min_length = 12", "token_limit = 7000", "password: \"\"", "secret: null", "API_KEY=${DB_PASSWORD}", "token = os.environ[\"X\"]", "key = vault.read(\"kv/a/b\")", "secret: \"********\"",
        "API_KEY=<your-key-here>", "API_KEY=s" + "k-" + "x" * 32, f"commit {sha}", f"checksum: {sha}", f"Rotate password, see {sha}", "token: refresh before expiry", "Read the auth_token from the vault",
        "Hide password in the log of X", "secret scan: skip a/b.json", "if (token === undefined) throw new Error(\"token missing\");", "const t = process.env.API_KEY;", "https://someone@git.example/x.git",
        "-----BEGIN CERTIFICATE-----\n" + made(64, 12) + "\n-----END CERTIFICATE-----", "postgres://svc:${DB_PASSWORD}@h/x", "import { t } from \"./token.js\";", "def login(user: str, password: str, token: str | None = None):", "",
    ):
        assert scan_text(text) == ([], text), text


def test_statements_stay_json_and_otherwise_the_same():
    pw = "Ab3!" + made(9, 13)
    raw = '{ "a" : ["x\\u00e9\\n", "password: ' + pw + '\\nrest \\"q\\""], "secret":"' + pw + '", "n": 1.50 }'
    found, out = scan_json(raw)
    assert found == [pw] and out == raw.replace(pw, "[REDACTED]")
    assert json.loads(out)["n"] == 1.5
    assert scan_json("null") == ([], "null") and scan_json("password: " + pw)[0] == [pw]


def test_chunks_see_the_same_as_the_whole():
    t = tokens()
    text = "".join(f"line {i} {list(t.values())[i % 7]}\n" for i in range(40)) + armor() + "filler " * 50
    assert spans(text, chunk=64, overlap=256) == spans(text, chunk=10**9)


def test_time_grows_with_the_text_only():
    pw = "Zu7!" + made(8, 20)
    pieces = ("-----BEGIN RSA PRIV" + "ATE KEY-----\n", f"password: {pw}\n", f"password={pw};", "s" + "k-abc-", "glp" + "at-", "?key=", "mysql ", "password=", "password>", 'password:\\"', "://a:")
    for piece in pieces:
        start = time.process_time()
        found = len(spans(piece * 16_000))
        assert time.process_time() - start < 8, piece
        if pw in piece:
            assert found == 16_000, piece
    start = time.process_time()
    assert len(scan_json(json.dumps([f"password: {pw}{i}" for i in range(8_000)]))[0]) == 8_000
    assert time.process_time() - start < 8


def test_nested_and_interleaved_armor():
    first, second = armor("RSA "), armor("EC ")
    assert scan_text(first + second)[0] == [first, second]
    assert scan_text("-----BEGIN RSA PRIV" + "ATE KEY-----\n" + first)[0] == ["-----BEGIN RSA PRIV" + "ATE KEY-----\n" + first]
    assert scan_text(first.split("\n")[0])[0] == []


def test_tables(spark):
    pw = "Ab3!" + made(9, 14)
    df = spark.createDataFrame([(1, f"pwd: {pw} pwd: {pw}", "x"), (2, None, "x"), (3, "", "x"), (4, "plain " * 20000, "x"), (1, f"pwd: {pw} pwd: {pw}", "x")], "row_id long, subject string, secrets string")
    assert [tuple(r) for r in found_secrets(df, "subject", False, "t").collect()] == [("t", 1, pw)] * 2
    out = {r["row_id"]: r["redacted"] for r in scan(df, "subject", False).collect()}
    assert out[1] == "pwd: [REDACTED] pwd: [REDACTED]" and out[2] is None and out[3] == "" and out[4] == "plain " * 20000
    assert found_secrets(df.limit(0), "subject", True, "t").count() == 0
