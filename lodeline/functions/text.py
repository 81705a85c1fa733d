"""Scalar text functions as Catalyst columns; only signatures need Python.

Null texts give null or an empty array; texts of any length are read whole unless a function names its limit.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def estimate_tokens(text: Column) -> Column:
    """Rough token cost: characters that are no space by four, a token for each run of spaces and each separator, and a tenth on top."""
    solid = F.length(F.regexp_replace(text, F.lit(r"\s+"), F.lit("")))
    runs = F.regexp_count(text, F.lit(r"\s+"))
    marks = F.regexp_count(text, F.lit(r"[/\\._\-:@#]"))
    cost = F.ceil((F.ceil(solid / 4) + runs + marks) * F.lit(1.1))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), cost)).cast("long")


def line_stats(text: Column) -> Column:
    """struct(lines, ending, final_newline, longest): ending is lf, crlf, cr, mixed or none."""
    crlf = F.regexp_count(text, F.lit(r"\r\n"))
    lf = F.regexp_count(text, F.lit(r"\n")) - crlf
    cr = F.regexp_count(text, F.lit(r"\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    ending = F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").when(cr > 0, "cr").otherwise("none")
    final = text.endswith("\n") | text.endswith("\r")
    lines = F.when(F.length(text) == 0, 0).otherwise(crlf + lf + cr + F.when(final, 0).otherwise(1))
    longest = F.array_max(F.transform(F.split(text, r"\r\n|\n|\r"), F.length))
    return F.struct(lines.cast("long").alias("lines"), ending.alias("ending"), final.alias("final_newline"), longest.cast("long").alias("longest"))


# fixed values: names that tell what a file is for
GENERATED_FOLDERS = ("build", "coverage", "dist", "generated", "out", "target", "__generated__", "__pycache__")
VENDORED_FOLDERS = ("bower_components", "node_modules", "third_party", "vendor")
TEST_FOLDERS = ("__tests__", "e2e", "fixtures", "spec", "specs", "test", "tests")
DOCUMENT_KINDS = ("adoc", "md", "mdx", "rst", "txt")
SETTING_KINDS = ("cfg", "conf", "env", "ini", "json", "properties", "toml", "yaml", "yml")
DATA_KINDS = ("csv", "jsonl", "ndjson", "parquet", "sql", "tsv", "xml")
BINARY_KINDS = ("bin", "class", "dll", "exe", "gif", "gz", "ico", "jar", "jpg", "pdf", "png", "so", "wasm", "woff2", "zip")
GENERATED_ENDINGS = (".lock", ".map", ".min.css", ".min.js", "-lock.json", "_pb2.py", ".g.ts")
DOCUMENT_NAMES = ("changelog", "contributing", "license", "readme")


def extension(path: Column) -> Column:
    """What follows the last full stop of the last name of a path, in lower case; empty if there is none."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(F.instr(name, ".") > 1, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def classify_file(path: Column, binary: Column | None = None, head: Column | None = None) -> Column:
    """What a file is for, by the first class that applies: binary, vendored, generated, test, documentation,
    configuration, data, source. ``binary`` tells of its content, ``head`` are its first lines, where a mark of a
    generator counts like a generated name."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    name, folders, ext = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1), extension(path)

    def inside(names):
        return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))

    ends = F.lit(False)
    for e in GENERATED_ENDINGS:
        ends = ends | name.endswith(e)
    marked = F.lit(False) if head is None else F.coalesce(F.lower(F.substring(head, 1, 512)).contains("@generated") | F.lower(F.substring(head, 1, 512)).contains("do not edit"), F.lit(False))
    stem = F.substring_index(name, ".", 1)
    tested = name.contains(".test.") | name.contains(".spec.") | name.startswith("test_") | stem.endswith("_test")
    is_binary = ext.isin(*BINARY_KINDS) if binary is None else ext.isin(*BINARY_KINDS) | F.coalesce(binary, F.lit(False))
    return (
        F.when(is_binary, "binary").when(inside(VENDORED_FOLDERS), "vendored").when(inside(GENERATED_FOLDERS) | ends | marked, "generated")
        .when(inside(TEST_FOLDERS) | tested, "test").when(ext.isin(*DOCUMENT_KINDS) | stem.isin(*DOCUMENT_NAMES), "documentation")
        .when(ext.isin(*SETTING_KINDS), "configuration").when(ext.isin(*DATA_KINDS), "data").otherwise("source")
    )


# fixed values: media types by extension, by name, and by the first bytes of a file in hexadecimal
MEDIA_TYPES = {
    "ts": "text/x-typescript", "tsx": "text/x-typescript", "mts": "text/x-typescript", "cts": "text/x-typescript", "js": "text/javascript", "mjs": "text/javascript", "cjs": "text/javascript",
    "py": "text/x-python", "pyi": "text/x-python", "md": "text/markdown", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/toml", "sql": "text/x-sql",
    "html": "text/html", "css": "text/css", "csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "pdf": "application/pdf",
}
MEDIA_NAMES = {"dockerfile": "text/x-dockerfile", "makefile": "text/x-makefile", "license": "text/plain", "readme": "text/plain"}
MAGIC = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip"}
MARKS = {"EFBBBF": "utf-8", "FFFE": "utf-16le", "FEFF": "utf-16be"}
SNIFF_BYTES = 8192


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def media_type(path: Column) -> Column:
    name = F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    return F.coalesce(_look_up(MEDIA_NAMES, name), _look_up(MEDIA_TYPES, extension(path)), F.lit("application/octet-stream"))


def detect_content(path: Column, content: Column) -> Column:
    """struct(media_type, encoding, binary) of bytes: by their first bytes, else by name; a mark of byte order tells the
    encoding; binary is what has a null byte among the first ones, unless a mark of two-byte characters explains it."""
    start = F.hex(F.substring(content, 1, 8))
    magic, mark = F.lit(None).cast("string"), F.lit(None).cast("string")
    for table in (MAGIC, MARKS):
        found = None
        for k, v in table.items():
            found = F.when(start.startswith(k), v) if found is None else found.when(start.startswith(k), v)
        magic, mark = (found, mark) if table is MAGIC else (magic, found)
    nulls = F.hex(F.substring(content, 1, SNIFF_BYTES)).rlike("^(?:..)*00")
    binary = magic.isNotNull() | (nulls & ~F.coalesce(mark.startswith("utf-16"), F.lit(False)))
    return F.struct(F.coalesce(magic, media_type(path)).alias("media_type"), F.coalesce(mark, F.when(~binary, "utf-8")).alias("encoding"), F.coalesce(binary, F.lit(False)).alias("binary"))


def _near(first: str, second: str, words: int) -> str:
    """A pattern for one of some words followed by one of others within a few words of the same sentence."""
    return rf"(?i)(?<!\w)(?:{first})(?:[^\w.!?\n]+\w+){{0,{words}}}?[^\w.!?\n]+(?:{second})(?!\w)"


#: Shapes of text that addresses a reader's tools instead of informing them, in fixed order; code -> patterns.
INSTRUCTION_SHAPES = {
    "override-instructions": (_near("ignore|disregard|forget|override|bypass", "instructions?|prompts?|rules?|directions?|guidelines?", 5),),
    "role-reassignment": (_near("you", "now|henceforth", 2), _near("from now on", "you", 1), _near("pretend|act|behave|respond", "as", 1) + r"[^\w\n]+(?:an?|if|the|though)(?!\w)"),
    "imperative-to-assistant": (_near("assistant|ai|model|agent", "must|should|shall|will", 1), _near("as", "assistant|ai|language model", 3)),
    "exfiltration-request": (_near("send|post|upload|email|transmit|leak|reveal|print|exfiltrate", "secrets?|passwords?|tokens?|credentials?|keys?|system prompt", 6),),
    "tool-directive": (_near("call|invoke|execute|run|use", "tools?|functions?|commands?|shell|terminal", 3),),
    "delimiter-forgery": (r"(?im)^[\s#<\[|-]*(?:end|begin|start)\s+of\s+(?:context|content|data|input|prompt)(?!\w)", r"(?im)^\s*(?:system|assistant|user)\s*:", r"(?i)<\|\w+\|>|\[/?inst\]"),
}
SHAPE_CHARS = 4096  # fixed value: instruction shapes are looked for at the start of a text


def instruction_shapes(text: Column) -> Column:
    """Codes of the shapes that the first characters of a text have, in the order above."""
    start = F.substring(text, 1, SHAPE_CHARS)

    def any_of(patterns):
        hit = start.rlike(patterns[0])
        for p in patterns[1:]:
            hit = hit | start.rlike(p)
        return hit

    return F.array_compact(F.array(*[F.when(any_of(p), code) for code, p in INSTRUCTION_SHAPES.items()]))


OPEN, CLOSE = "<<<untrusted>>>", "<<<end untrusted>>>"


def contain(text: Column) -> Column:
    """A text between delimiters it cannot forge: runs of three angle brackets inside are broken up."""
    calm = F.replace(F.replace(text, F.lit("<<<"), F.lit("< <<")), F.lit(">>>"), F.lit("> >>"))
    return F.concat(F.lit(OPEN + "\n"), calm, F.lit("\n" + CLOSE))


#: Loose token shapes for logs, where cutting out too much does no harm: how a token begins, what it consists of, how long it is.
LOG_TOKENS = (
    ("gh[a-z]_", "A-Za-z0-9", "16,"), ("github_pat_", "A-Za-z0-9_", "20,"), ("glpat-", "A-Za-z0-9_-", "16,"), ("A[KS]IA", "A-Z0-9", "16"), ("sk-", "A-Za-z0-9_-", "16,"), ("[sr]k_(?:live|test)_", "A-Za-z0-9", "16,"),
    ("xox[a-z]-", "A-Za-z0-9-", "10,"), ("AIza", "A-Za-z0-9_-", "30,"), ("npm_", "A-Za-z0-9", "30,"), ("hf_", "A-Za-z0-9", "30,"), ("pypi-", "A-Za-z0-9_-", "30,"), ("eyJ", "A-Za-z0-9_.-", "20,"),
)
#: Words of names whose values are cut out.
SECRET_WORDS = ("apikey", "api_key", "api-key", "auth", "credential", "passphrase", "passwd", "password", "pwd", "secret", "token")


def redact_log(text: Column) -> Column:
    """A log line without key blocks, token shapes, passwords of URLs (the user name stays) and values of secret names."""
    out = F.regexp_replace(text, F.lit(r"(?s)-----BEGIN ([A-Z ]*)PRIVATE KEY-----.*?-----END \1PRIVATE KEY-----"), F.lit("[redacted]"))
    for start, members, size in LOG_TOKENS:
        out = F.regexp_replace(out, F.lit(rf"(?<![A-Za-z0-9_]){start}[{members}]{{{size}}}"), F.lit("[redacted]"))
    out = F.regexp_replace(out, F.lit(r"(?<=://)([^\s/:@]+):[^\s/@]+@"), F.lit("$1:[redacted]@"))
    names = "|".join(SECRET_WORDS)
    return F.regexp_replace(out, F.lit(rf"(?i)([\w-]*(?:{names})[\w-]*[\"']?\s*[:=]\s*)(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s,;&]+)"), F.lit("$1[redacted]"))


NOREPLY = "users.noreply.github.com"  # fixed value: a domain whose local parts hold a number and a login


def normalise_address(email: Column) -> Column:
    """Comparable form of an address: lower case, no angle brackets, no plus tag (kept where it belongs to a noreply address)."""
    low = F.lower(F.trim(F.translate(email, "<>", "")))
    at = F.length(low) - F.instr(F.reverse(low), "@") + 1
    local, domain = F.substring(low, F.lit(1), at - 1), F.substring(low, at + 1, F.length(low))
    plain = F.when(F.instr(local, "+") > 1, F.substring_index(local, "+", 1)).otherwise(local)
    whole = (F.instr(low, "@") > 1) & (domain != "")
    return F.when(whole, F.concat(F.when(domain == NOREPLY, local).otherwise(plain), F.lit("@"), domain)).otherwise(low)


def login_of(email: Column) -> Column:
    """The login that a noreply address holds; null for other addresses."""
    low = F.lower(F.trim(email))
    local = F.substring_index(F.substring_index(low, "@", 1), "+", -1)
    return F.when(low.endswith("@" + NOREPLY) & (local != ""), local)


# fixed values: addresses, domains and names of machines
SERVICE_ADDRESSES = ("action@github.com", "actions@github.com", "github-actions@github.com", "noreply@github.com", "support@github.com", "bot@renovateapp.com", "renovate@whitesourcesoftware.com", "gitlab-bot@gitlab.com", "bot@stepsecurity.io")
SERVICE_DOMAINS = ("bots.github.com", "users.noreply.gitlab.com")
SERVICE_NAMES = ("github actions", "github-actions", "dependabot", "renovate", "renovate bot", "semantic-release-bot", "greenkeeper", "snyk bot")


def classify_actor(name: Column, email: Column) -> Column:
    """struct(actor_class, reason): agent by the first of six signs, else developer."""
    address, who = normalise_address(email), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    reason = (
        F.when(local.endswith("[bot]") & (domain == NOREPLY), "app-address").when(who.endswith("[bot]"), "bot-name").when(local.endswith("[bot]"), "bot-address")
        .when(address.isin(*SERVICE_ADDRESSES), "service-address").when(domain.isin(*SERVICE_DOMAINS), "service-domain").when(who.isin(*SERVICE_NAMES), "service-name")
    )
    return F.struct(F.when(reason.isNull(), "developer").otherwise("agent").alias("actor_class"), F.coalesce(reason, F.lit("none")).alias("reason"))


def normalise_url(url: Column) -> Column:
    """Canonical form of a repository address: host and path, whatever scheme, user, port or suffix it came with."""
    text = F.trim(url)
    rest = F.when(text.contains("://"), F.substring_index(text, "://", -1)).otherwise(text)
    rest = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    head = F.substring_index(rest, "/", 1)
    rest = F.when(head.contains("@"), F.substring(rest, F.instr(rest, "@") + 1, F.length(rest))).otherwise(rest)
    # host:path of a copy command, or host:port of an address
    scp = ~text.contains("://") & F.substring_index(rest, "/", 1).contains(":")
    host = F.lower(F.when(scp, F.substring_index(rest, ":", 1)).otherwise(F.substring_index(F.substring_index(rest, "/", 1), ":", 1)))
    path = F.when(scp, F.substring(rest, F.instr(rest, ":") + 1, F.length(rest))).otherwise(F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/") + 1, F.length(rest))).otherwise(""))
    path = F.rtrim(F.ltrim(path, F.lit("/")), F.lit("/"))
    path = F.when(path.endswith(".git"), F.substring(path, F.lit(1), F.length(path) - 4)).otherwise(path)
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


CLOSING_WORDS = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")  # fixed values
CLOSING_CHARS, LOOK_BACK = 65_536, 24  # fixed values: how much of a text is read, and how far before a reference a closing word may stand
_NUMBERED = r"(?:#|GH-|[\w.-]+/[\w.-]+#)[0-9]+"
#: What a text can refer to: kind -> (what must stand before, the reference, what must stand behind).
REFERENCES = {
    "issue": (r"(?<![\w/-])", r"[A-Z][A-Z0-9]{1,9}-[0-9]{1,9}", r"(?![\w-])"),
    "number": (r"(?<![\w/-])", r"[\w.-]+/[\w.-]+#[0-9]{1,9}", r"(?![\w-])"),
    "issue-page": (r"(?<=://)", r"[^\s/]+(?:/[^\s/]+)*/browse/[A-Z][A-Z0-9]{1,9}-[0-9]+", r"(?!\w)"),
    "page": (r"(?<=://)", r"[^\s/]+/(?:[^\s/]+/)*pages/[0-9]{2,}", r"(?!\w)"),
}


def closing_references(text: Column) -> Column:
    """References that say what they close, as written, each once."""
    start = F.substring(text, 1, CLOSING_CHARS)
    pattern = rf"(?i)(?<!\w)(?:{'|'.join(CLOSING_WORDS)})(?::\s*|\s+)({_NUMBERED})(?!\w)"
    return F.array_distinct(F.regexp_extract_all(start, F.lit(pattern), F.lit(1)))


def text_references(text: Column, kind: str) -> Column:
    """array<struct<ref, closing>> of one kind of references, each once; closing ones have a closing word shortly before."""
    before, what, behind = REFERENCES[kind]
    words = "|".join(CLOSING_WORDS)
    plain = F.array_distinct(F.regexp_extract_all(text, F.lit(before + what + behind), F.lit(0)))
    closed = F.regexp_extract_all(text, F.lit(rf"(?i)(?<!\w)(?:{words})(?!\w)[^\n.]{{0,{LOOK_BACK}}}?(?-i:{before}({what}){behind})"), F.lit(1))
    return F.transform(plain, lambda r: F.struct(r.alias("ref"), F.array_contains(closed, r).alias("closing")))


def page_references(body: Column) -> Column:
    """array<struct<kind, space, target>>: wiki pages a body refers to, by number in addresses and by title in markup, each once."""
    spaced = F.regexp_extract_all(body, F.lit(r"/spaces/[\w.~-]+/pages/[0-9]{2,}"), F.lit(0))
    bare = F.regexp_extract_all(body, F.lit(r"(?:[^\s/]/|/wiki/)(?<!/spaces/)pages/[0-9]{2,}"), F.lit(0))
    tags = F.regexp_extract_all(body, F.lit(r"<ri:page\s[^>]*>"), F.lit(0))
    none = F.lit(None).cast("string")
    by_id = F.transform(spaced, lambda u: F.struct(F.lit("id").alias("kind"), F.element_at(F.split(u, "/"), 3).alias("space"), F.substring_index(u, "/", -1).alias("target")))
    known = F.transform(by_id, lambda r: r["target"])
    loose = F.transform(F.filter(bare, lambda u: ~F.array_contains(known, F.substring_index(u, "/", -1))), lambda u: F.struct(F.lit("id").alias("kind"), none.alias("space"), F.substring_index(u, "/", -1).alias("target")))

    def named(t):
        title, space = (F.regexp_extract(t, rf'ri:{n}="([^"]{{1,255}})"', 1) for n in ("content-title", "space-key"))
        return F.struct(F.lit("title").alias("kind"), F.when(space != "", space).alias("space"), decode_entities(title).alias("target"))

    titles = F.filter(F.transform(tags, named), lambda r: F.trim(r["target"]) != "")
    return F.array_distinct(F.concat(by_id, loose, titles))


def classify_query(text: Column) -> Column:
    """uuid, object id, path or prose: how a search line is to be answered."""
    t = F.trim(F.substring(text, 1, 1024))
    hexes = F.translate(t, "0123456789abcdef", "") == ""
    groups = F.split(F.lower(t), "-")
    uuid = (F.length(t) == 36) & (F.translate(F.lower(t), "0123456789abcdef-", "") == "") & (F.transform(groups, F.length) == F.array(*[F.lit(n) for n in (8, 4, 4, 4, 12)]))
    one = ~t.rlike(r"\s")
    return F.when(uuid, "uuid").when(hexes & F.length(t).between(7, 40), "object").when(one & (t.contains("/") | t.contains("\\")), "path").otherwise("prose")


# fixed values: words that ask nothing
STOP_WORDS = ("the", "and", "for", "are", "was", "were", "with", "that", "this", "from", "what", "which", "how", "why", "who", "when", "where", "not", "but", "has", "had", "have", "does", "did", "can", "could", "should", "would", "will", "its", "into", "about", "there", "their", "them", "then", "than", "our", "you", "your", "all", "any", "been")


def query_terms(text: Column) -> Column:
    """Distinct content words of a question in order of appearance; full stops and hyphens only inside words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def normalise_statement(text: Column) -> Column:
    """Comparable form of a statement: lower case, single spaces, no comma, semicolon or colon at the end of a word, no
    punctuation at the end (compatibility characters are the caller's, see functions.canonical.nfkc)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    bare = F.filter(F.transform(words, lambda w: F.when(F.length(F.rtrim(w, F.lit(",;:"))) < F.length(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)), lambda w: w != "")
    return F.rtrim(F.rtrim(F.array_join(bare, " "), F.lit(".!?;:,")))


# fixed values: marks of statements worth keeping, and how sure a statement is by its origin
MEMORY_MARKS = {"DECISION": "decision", "DECIDED": "decision", "CONSTRAINT": "constraint", "REQUIREMENT": "constraint", "PREFERENCE": "preference", "CONVENTION": "preference", "GOTCHA": "gotcha", "NOTE": "gotcha", "TODO": "next-step", "NEXT": "next-step"}
ORIGIN_CONFIDENCE = {"explicit": 0.95, "extracted": 0.6}
_CHOICE = ("agreed on", "chose", "decided", "have decided", "picked", "settled on", "went with", "will use")
_RULE = ("always", "do not", "don't", "must not", "never")


def memory_of(line: Column) -> Column:
    """struct(kind, origin, confidence, statement) of a line: by a mark at its start, else by how a choice, a rule with
    its reason or a preference is phrased; null for other lines."""
    text = F.trim(line)
    mark = F.upper(F.regexp_extract(text, r"^([A-Za-z]{4,11}):\s*\S", 1))
    marked = _look_up(MEMORY_MARKS, F.when(mark != "", mark))
    low = F.concat(F.lower(text), F.lit(" "))
    chosen, ruled = F.lit(False), F.lit(False)
    for who in ("we", "i"):
        for verb in _CHOICE:
            chosen = chosen | low.startswith(f"{who} {verb} ")
    for word in _RULE:
        ruled = ruled | low.startswith(f"{word} ")
    preferred = low.rlike(r"^we(?:'re| are) using [^\n]+ over ")
    phrased = F.when(preferred, "preference").when(chosen, "decision").when(ruled & low.contains(" because "), "constraint")
    kind, origin = F.coalesce(marked, phrased), F.when(marked.isNotNull(), "explicit").otherwise("extracted")
    statement = F.when(marked.isNotNull(), F.trim(F.substring(text, F.instr(text, ":") + 1, F.length(text)))).otherwise(text)
    sure = F.when(marked.isNotNull(), ORIGIN_CONFIDENCE["explicit"]).otherwise(ORIGIN_CONFIDENCE["extracted"])
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), origin.alias("origin"), sure.alias("confidence"), statement.alias("statement")))


# fixed values: what a delivery is about, by its event
PROJECT_EVENTS = {
    "push": "history", "create": "history", "delete": "history", "issues": "issue", "issue_comment": "comment", "pull_request": "pull-request", "pull_request_review": "review",
    "pull_request_review_comment": "comment", "release": "release", "deployment": "deployment", "deployment_status": "deployment", "repository": "repository",
}
TRACKER_EVENTS = {"jira": "issue", "comment": "comment"}


def normalise_event(system: Column, event: Column, delivery_id: Column, body: Column) -> Column:
    """struct(subject, event, project, reference, ignored) of a delivered webhook; ``ignored`` says why it is none."""
    field = lambda path: F.get_json_object(body, path)
    sound = F.try_parse_json(body).isNotNull() & F.ltrim(body).startswith("{")
    name = F.when(system == "github", event).otherwise(field("$.webhookEvent"))
    family = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise(F.substring_index(name, "_", 1))
    subject = F.when(system == "github", _look_up(PROJECT_EVENTS, name)).otherwise(_look_up(TRACKER_EVENTS, family))
    ignored = (
        F.when(F.coalesce(delivery_id, F.lit("")) == "", "no-delivery-id").when((system == "github") & subject.isNull(), "unsupported-event")
        .when(~F.coalesce(sound, F.lit(False)), "unparseable").when(subject.isNull(), "unsupported-event")
    )
    key = field("$.issue.key")
    project = F.when(system == "github", field("$.repository.full_name")).otherwise(F.substring_index(key, "-", 1))
    reference = F.when(system == "github", F.coalesce(field("$.issue.number"), field("$.pull_request.number"), field("$.release.tag_name"), field("$.deployment.id"))).otherwise(key)
    full = F.when((system == "github") & field("$.action").isNotNull(), F.concat_ws(".", name, field("$.action"))).otherwise(name)
    live = ignored.isNull()
    return F.struct(F.when(live, subject).alias("subject"), F.when(live, full).alias("event"), F.when(live, project).alias("project"), F.when(live, reference).alias("reference"), ignored.alias("ignored"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))  # fixed values


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_blocks(html: Column) -> Column:
    """Inner texts of headings, paragraphs, list items and cells in order, tags and entities resolved, blank ones left out."""
    # block by block: a block begins at its opening tag and ends where the next begins
    pieces = F.split(html, r"(?i)(?=<(?:h[1-6]|p|li|td|th)[\s>])")
    inner = F.transform(F.filter(pieces, lambda b: b.rlike(r"(?i)^<(?:h[1-6]|p|li|td|th)[\s>]")), lambda b: F.regexp_replace(b, F.lit(r"(?is)</(?:h[1-6]|p|li|td|th)\s*>.*$"), F.lit("")))
    plain = F.transform(inner, lambda b: F.trim(F.regexp_replace(decode_entities(F.regexp_replace(b, F.lit(r"(?s)<[^>]*>"), F.lit(""))), F.lit(r"\s+"), F.lit(" "))))
    return F.filter(plain, lambda t: t != "")


def signature_verdict(secret: str | None, prefix: str = "sha256="):
    """A function of (body, header): verified, unconfigured, missing, malformed or mismatch; compared in constant time."""

    @F.arrow_udf(T.StringType())
    def verdict(bodies: pa.Array, headers: pa.Array) -> pa.Array:
        out = []
        for body, header in zip(bodies.to_pylist(), headers.to_pylist(), strict=True):
            if not secret:
                out.append("unconfigured")
            elif not header:
                out.append("missing")
            else:
                want = hmac.new(secret.encode(), (body or "").encode(), hashlib.sha256).hexdigest()
                given = header[len(prefix) :].lower() if header.startswith(prefix) else ""
                if len(given) != len(want) or set(given) - set("0123456789abcdef"):
                    out.append("malformed")
                else:
                    out.append("verified" if hmac.compare_digest(given, want) else "mismatch")
        return pa.array(out, type=pa.string())

    return verdict
