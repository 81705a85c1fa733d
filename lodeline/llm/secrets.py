"""Credentials in source code, configuration and commit subjects: found, and cut out without harm to what is around.

Method: token formats, the two lines of key armor and the grammars of connection strings and query parameters are one
deterministic automaton (``automaton.py``). Where a credential can begin is found by an Aho-Corasick machine over the
openings, which also knows the names under which credentials are kept and the commands that take them; a text is scanned
in overlapping chunks, and what two chunks both see counts once by its absolute place. From an opening the automaton runs
on over the whole text, its state carried over the limits of chunks; an armor's last line is matched to the earliest open
first line with the same label. Spans are merged in one sweep and placeholders are spliced in. A JSON statement is
scanned string by string as decoded and spliced in its raw spelling, so the rest stays as it was, byte for byte.

Time is linear in the text: runs that meet an earlier one in the same state end there, lines and runs of characters are
measured once, and a value under a name has at most ``MOST`` characters.

Defined cases: null texts give no row and stay null; a statement that is no JSON is scanned as plain text; empty
texts, empty tables and further columns are harmless; repeated rows are each scanned; texts of any length are scanned
whole; a credential that occurs several times in a row is reported once and replaced everywhere; a value under a name,
in a query or after a command that is longer than ``MOST`` characters is none (formats, armor and connection strings have
no such limit).
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.automaton import Automaton, Runner

#: Characters scanned at once, and how far the next chunk reaches back; an opening is always shorter than the overlap.
CHUNK, OVERLAP = 65_536, 256
PLACEHOLDER = "[REDACTED]"
#: Characters of the longest value under a name.
MOST = 4_096

#: opening -> the whole token. Published token formats.
TOKENS = {
    "akia": r"AKIA[A-Z0-9]{16}", "asia": r"ASIA[A-Z0-9]{16}", "aiza": r"AIza[0-9A-Za-z_-]{35}",
    "ghp_": r"ghp_[A-Za-z0-9]{36,}", "gho_": r"gho_[A-Za-z0-9]{36,}", "ghu_": r"ghu_[A-Za-z0-9]{36,}", "ghs_": r"ghs_[A-Za-z0-9]{36,}", "ghr_": r"ghr_[A-Za-z0-9]{36,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{22,}", "glpat-": r"glpat-[A-Za-z0-9_-]{20,}", "npm_": r"npm_[A-Za-z0-9]{36,}", "pypi-": r"pypi-[A-Za-z0-9_-]{32,}",
    "xox": r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "sk-": r"sk-(?:[a-z]+-)*[A-Za-z0-9_]{20,}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}", "sk_test_": r"sk_test_[A-Za-z0-9]{16,}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{16,}", "whsec_": r"whsec_[A-Za-z0-9+/=]{16,}", "hf_": r"hf_[A-Za-z0-9]{30,}", "dop_v1_": r"dop_v1_[a-f0-9]{64}",
    "sg.": r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "eyj": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*[A-Za-z0-9_]",
}
#: Words that a credential's name ends with; separators inside are free.
NAMES = (
    "password", "passwd", "passphrase", "passwort", "pwd", "pass", "secret", "token", "credential", "credentials", "authorization", "api-key", "access-key", "secret-key",
    "private-key", "signing-key", "encryption-key", "auth-key", "account-key", "shared-key", "master-key", "client-key", "license-key", "service-key", "storage-key", "key-id", "auth",
)
#: Where spans overlap, the grammar that fixes more of what it reads wins.
RANK = {"armor": 0, "url": 1, "command": 1, "token": 2, "query": 3, "name": 4}
_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_LABEL = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_GRAMMARS = [
    ("begin", "-----BEGIN " + _LABEL), ("end", "-----END " + _LABEL), ("url", r"""://[^\s/?#@:'"<>`]*:[^\s/?#'"<>`]+@"""),
    ("query", r"""[?&](?:[Aa][Pp][Ii]_?)?[Kk][Ee][Yy]=[^\s&'"#<>`;]+"""), ("query", r"""[?&](?:[Aa][Cc][Cc][Ee][Ss][Ss]_)?[Tt][Oo][Kk][Ee][Nn]=[^\s&'"#<>`;]+"""),
    ("query", r"""[?&](?:[Aa][Uu][Tt][Hh]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Ss][Ii][Gg](?:[Nn][Aa][Tt][Uu][Rr][Ee])?)=[^\s&'"#<>`;]+"""),
]
_SEPARATOR = re.compile(r"""["'\]]{0,2}[ \t]{0,8}(?::=|=>|=|:|>|,(?=[ \t]*["']))[ \t]{0,8}""")
_QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_NOT_XML = re.compile(r"[<\n]")
_NOT_BARE = re.compile(r"[\s\"'`<>,]")
_SCHEME = re.compile(r"(?:Basic|Bearer|token|Digest|ApiKey)\s+", re.I)
_SPOKEN = re.compile(r"""\s{1,64}(?:(?:to|is|was|with|as|of)\s{1,64})?(["'`]?)([^\s"'`]{1,4096})(?![^\s"'`])\1""")
_FLAG = re.compile(r"""[ =](['"]?)([^\s'"]{1,4096})(?![^\s'"])\1""")
# options stand within a thousand characters of their command, so that a line of many commands takes linear time
_FLAG_P = re.compile(r"""(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;&]{0,1024}?\s-p(["']?)([^\s"']{1,4096})(?![^\s"'])\1""")
_SSHPASS = re.compile(r"""sshpass\s{1,64}-p\s{0,64}(["']?)([^\s"']{1,4096})(?![^\s"'])\1""")
_USER_PAIR = re.compile(r"""(?:curl|wget|http)\b[^\n|;&]{0,1024}?\s(?:-u|--user)[\s=]{1,64}(["']?)[^\s:"']{1,256}:([^\s"']{1,4096})(?![^\s"'])\1""")

_FILLER = re.compile(
    r"""^(?:<.*>|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|\{\{.*|\{[A-Za-z_.]*\}|@[A-Za-z_.]+@|[*x#.•?_-]{3,}|null|none|nil|undefined|true|false|todo|tbd|n/a|changeme|change[-_]me|example|
    |redacted|\[?redacted\]?|placeholder|dummy|secret|password|passwd|token|your[-_ ].*|my[-_]?(?:password|secret|token)|test|string|str|int|bool)$""",
    re.I | re.X,
)
_REFERENCE = re.compile(r"^(?:vault[.:/]|os\.|process\.env|env[.(\[]|getenv|System\.|ENV\[|secrets?[.(\[]|config[.(\[]|settings[.(\[]|file:|arn:|ssm:|op://|secretsmanager|projects/|sha(?:1|256|384|512)[-:]|ssh-)", re.I)
_CALL = re.compile(r"^[A-Za-z_][\w.]*[(\[{]")
_WORD = re.compile(r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_./ ](?:[A-Z]?[a-z]+|[A-Z]+))*[.,;:!?)]*$")
_IDENT = re.compile(r"^[A-Za-z_$][A-Za-z_$.]*$")
_SHA = re.compile(r"^[0-9a-f]{40}$|^[0-9a-f]{64}$")
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_SAME = re.compile(r"(.)\1{5,}")
_DIGIT = re.compile(r"\d")


def _filler(value: str) -> bool:
    """Placeholders, empty values, references to the environment or a vault."""
    return not value or bool(_FILLER.match(value) or _REFERENCE.match(value) or _SAME.search(value))


def _plausible(value: str, quoted: bool) -> bool:
    """Whether a value under a credential's name can be one."""
    if _filler(value) or len(value) < 5 or _UUID.match(value):
        return False
    if _CALL.match(value) and not quoted:
        return False
    if quoted:
        return not (_WORD.match(value) and (" " in value or value.islower() and len(value) < 8)) and " " not in value.strip()
    return not (_WORD.match(value) or _IDENT.match(value) and not re.search(r"[a-z][A-Z][a-z]*[A-Z]", value) or value.isdigit() or value[0] in "([{=" or "(" in value)


def _name_pattern(word: str) -> str:
    return word.replace("-", "[-_ ]?")


_NAME = re.compile(r"(?:%s)(?![A-Za-z0-9_-])" % "|".join(sorted(map(_name_pattern, NAMES), key=len, reverse=True)), re.I)


def _openings() -> ahocorasick.Automaton:
    """Everything a credential can begin with, on lower-cased text: (length, kinds of what may follow)."""
    machine = ahocorasick.Automaton()
    add: dict[str, set[str]] = {}
    for opening in (*TOKENS, "-----begin ", "-----end ", "://", *(a + k + "=" for a in "?&" for k in ("key", "apikey", "api_key", "token", "access_token", "auth", "secret", "password", "sig", "signature"))):
        add.setdefault(opening, set()).add("grammar")
    for name in NAMES:
        for joint in ("-", "_", "", " ") if "-" in name else ("",):
            add.setdefault(name.replace("-", joint), set()).add("name")
    for word in ("mysql", "mariadb", "sshpass", "curl", "wget"):
        add.setdefault(word, set()).add("command")
    for opening, kinds in add.items():
        machine.add_word(opening, (len(opening), tuple(sorted(kinds))))
    machine.make_automaton()
    return machine


def _grammars() -> Automaton:
    return Automaton([*(("token", whole) for whole in TOKENS.values()), *_GRAMMARS], whole=("token",))


_MACHINES: list = []


class _Text:
    """A text with its lines and runs of characters, each measured once; places are asked for in ascending order."""

    def __init__(self, text: str):
        self.text, self.runs = text, {}
        self.line_start, self.line_end, self.first_sign = 0, -1, 0

    def at(self, place: int) -> None:
        """Makes the line of ``place`` the current one."""
        if place > self.line_end:
            self.line_start = self.text.rfind("\n", self.line_end + 1, place) + 1 if self.line_end >= 0 else self.text.rfind("\n", 0, place) + 1
            self.line_start = max(self.line_start, self.line_end + 1)
            end = self.text.find("\n", place)
            self.line_end = end if end >= 0 else len(self.text)
            signs = [p for p in (self.text.find(c, self.line_start, self.line_end) for c in ";=") if p >= 0]
            self.first_sign = min(signs, default=self.line_end)

    def run_end(self, stop: re.Pattern, place: int) -> int:
        """Where the run of characters that ``stop`` does not match ends."""
        last = self.runs.get(stop)
        if last is None or not last[0] <= place <= last[1]:
            m = stop.search(self.text, place)
            last = self.runs[stop] = (place, m.start() if m else len(self.text))
        return last[1]

    def next(self, what: re.Pattern, place: int) -> int:
        """Where the first match of ``what`` from ``place`` on begins, the text's length if there is none."""
        last = self.runs.get(what)
        if last is None or last < place:
            m = what.search(self.text, place)
            last = self.runs[what] = m.start() if m else len(self.text)
        return last

    def in_query(self, place: int) -> bool:
        """Whether a name that ends in a parameter of a query begins here or a little before."""
        text, i, low = self.text, place, max(self.line_start, place - 256)
        while i > low and (text[i - 1].isalnum() or text[i - 1] in "_-"):
            i -= 1
        return i > self.line_start and text[i - 1] in "?&"


def _value_at(t: _Text, at: int, xml: bool) -> tuple[int, int, bool] | None:
    """Span of the value that starts at ``at``, without quotes and a scheme word; whether it was quoted."""
    text = t.text
    if text.startswith(('\\"', "\\'"), at):  # a quoted value inside a quoted text
        end = text.find(text[at : at + 2], at + 2, min(t.line_end, at + MOST + 4))
        return (at + 2, end, True) if end > 0 else None
    quoted = _QUOTED.match(text, at)
    if quoted:
        start, end = quoted.span(2)
        scheme = _SCHEME.match(text, start, end)
        return (scheme.end() if scheme else start, end, True)
    if xml:
        end = t.run_end(_NOT_XML, at)
        return (at, end, True) if text.startswith("</", end) else None
    scheme = _SCHEME.match(text, at)
    at = scheme.end() if scheme else at
    end = t.run_end(_NOT_BARE, at)
    return (at, end, bool(scheme)) if end > at else None


def _trim_bare(text: str, start: int, end: int) -> int:
    while end > start and text[end - 1] in ",;\\)]}":
        end -= 1
    return end


def _named(t: _Text, begin: int) -> Iterator[tuple[int, int]]:
    """Credentials under a name that begins at ``begin``."""
    text = t.text
    name = _NAME.match(text, begin)
    if not name:
        return
    before = text[begin - 1 : begin]
    word, at = name.group().lower(), name.end()
    if before.isalpha() and not (text[begin].isupper() and before.islower()) and not re.match(r"pass|pwd|token|secret|key", word):
        return
    strong = not re.match(r"auth$|pass$", word)
    sep = _SEPARATOR.match(text, at)
    if sep:
        xml = ">" in sep.group() and "=" not in sep.group()
        got = _value_at(t, sep.end(), xml)
        if not got:
            return
        start, end, quoted = got
        if not quoted:
            # first the sign that ends a member of a list, wherever the run of characters ends
            stop = ";&#" if t.in_query(begin) else ";"
            far = min(end, start + MOST + 1)
            ends = [p for c in stop if (c != ";" or t.first_sign < begin or text[end - 1] == ";") and (p := text.find(c, start, far)) >= 0]
            end = min(ends, default=end)
        if end - start > MOST:
            return
        if not quoted:
            end = _trim_bare(text, start, end)
        if _plausible(text[start:end], quoted):
            yield start, end
        return
    if text[begin - 2 : begin] == "--" or not strong and text[begin - 1 : begin] not in " -":
        got = _FLAG.match(text, at)
        if got and _plausible(got.group(2), True):
            yield got.span(2)
        return
    spoken = _SPOKEN.match(text, at)
    if spoken:
        start, end = spoken.span(2)
        if not spoken.group(1):
            end = start + text[start:end].index(";") if text[end - 1] == ";" else end
            end = _trim_bare(text, start, end)
        value = text[start:end]
        if _plausible(value, False) and not _SHA.match(value) and re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not re.search(r"[/(\[]|\.\w{1,4}$", value):
            yield start, end


def _places(low: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(place, kind) of all openings in ascending order, each once."""
    openings, seen = _MACHINES[0], set()
    for base in range(0, max(1, len(low)), chunk):
        shift = max(0, base - overlap)
        piece = low[shift : base + chunk]
        for end, (length, kinds) in openings.iter(piece):
            seen.update((shift + end - length + 1, kind) for kind in kinds)
    return sorted(seen)


def spans(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Absolute spans of all credentials in a text, without overlaps, in order."""
    if not _MACHINES:
        _MACHINES.extend((_openings(), _grammars()))
    low = text.lower()
    if len(low) != len(text):  # rare capitals change length; keep positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = _places(low, chunk, overlap)
    if not places:
        return []
    t, runner, names = _Text(text), Runner(_MACHINES[1], text), _MACHINES[1].names
    found: set[tuple[int, int, int]] = set()
    open_armor: dict[str, int] = {}
    for begin, kind in places:
        t.at(begin)
        if kind == "grammar":
            for k, end in runner.run(begin).items():
                name = names[k]
                if name == "begin":
                    open_armor.setdefault(text[begin + 11 : end], begin)
                elif name == "end":
                    label = text[begin + 9 : end]
                    if label in open_armor:
                        found.add((RANK["armor"], open_armor.pop(label), end))
                elif name == "token":
                    if begin and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                        continue
                    if t.next(_SAME, begin) + 6 > end and (text[begin : begin + 3] not in ("sk-", "xox", "hf_") or t.next(_DIGIT, begin) < end):
                        found.add((RANK["token"], begin, end))
                else:
                    start, end = (text.index(":", begin + 3) + 1, end - 1) if name == "url" else (text.index("=", begin) + 1, end)
                    if name == "url" and not _filler(text[start:end]) or name == "query" and end - start <= MOST and _plausible(text[start:end], True):
                        found.add((RANK[name], start, end))
        elif kind == "command":
            for rule in (_FLAG_P, _SSHPASS, _USER_PAIR):
                hit = rule.match(text, begin)
                if hit and not _filler(hit.group(2)):
                    found.add((RANK["command"], *hit.span(2)))
        else:
            found.update((RANK["name"], s, e) for s, e in _named(t, begin))
    # one sweep in the order of rank; taken spans stand in order, so an overlap can only be with a neighbour
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
        i = bisect_right(out, (s, e))
        if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or out[i][0] >= e):
            out.insert(i, (s, e))
    return out


def _decoded(raw: str) -> tuple[str, list[int] | None]:
    """A JSON string literal's text, and the raw position of each character if any is escaped."""
    if "\\" not in raw:
        return raw[1:-1], None
    out, at, i = [], [], 1
    while i < len(raw) - 1:
        at.append(i)
        if raw[i] != "\\":
            out.append(raw[i])
            i += 1
        elif raw[i + 1] == "u":
            code = int(raw[i + 2 : i + 6], 16)
            i += 6
            if 0xD800 <= code < 0xDC00 and raw[i : i + 2] == "\\u":
                code = 0x10000 + ((code - 0xD800) << 10) + (int(raw[i + 2 : i + 6], 16) - 0xDC00)
                i += 6
            out.append(chr(code))
        else:
            out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(raw[i + 1], raw[i + 1]))
            i += 2
    return "".join(out), [*at, len(raw) - 1]


def scan_text(text: str) -> tuple[list[str], str]:
    """(distinct credentials, text with placeholders)."""
    found = spans(text)
    if not found:
        return [], text
    parts, last = [], 0
    for s, e in found:
        parts += [text[last:s], PLACEHOLDER]
        last = e
    return list(dict.fromkeys(text[s:e] for s, e in found)), "".join([*parts, text[last:]])


_COLON = re.compile(r"[ \t\r\n]*:")


def _after_colon(raw: str, at: int) -> bool:
    while at and raw[at - 1] in " \t\r\n":
        at -= 1
    return at > 0 and raw[at - 1] == ":"


def scan_json(raw: str) -> tuple[list[str], str]:
    """The same for a JSON statement: its strings are scanned decoded and spliced raw."""
    try:
        json.loads(raw)
    except ValueError:
        return scan_text(raw)
    secrets: dict[str, None] = {}
    parts, last, member = [], 0, ""
    for literal in _LITERAL.finditer(raw):
        text, at = _decoded(literal.group())
        is_name = bool(_COLON.match(raw, literal.end()))
        found = spans(text)
        if is_name:
            member = text
        elif not found and member and _after_colon(raw, literal.start()) and (m := _NAME.search(member)) and m.end() == len(member) and _plausible(text, True):
            found = [(0, len(text))]
        for s, e in found:
            secrets[text[s:e]] = None
            a, b = (s + 1, e + 1) if at is None else (at[s], at[e])
            parts += [raw[last : literal.start() + a], PLACEHOLDER]
            last = literal.start() + b
    if not secrets:
        return [], raw
    return list(secrets), "".join([*parts, raw[last:]])


def _scanner(as_json: bool, with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scan_json if as_json else scan_text
        for batch in batches:
            rows = [None if t is None else one(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([None if r is None else r[0] for r in rows], type=pa.list_(pa.string()))]
            names = ["row_id", "secrets"]
            if with_text:
                columns.append(pa.array([None if r is None else r[1] for r in rows], type=pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scan


def scan(table: DataFrame, text: str, as_json: bool, with_text: bool = True) -> DataFrame:
    """(row_id, secrets array<string>[, redacted string]) for every row; no shuffle, one pass over the text column."""
    schema = "row_id long, secrets array<string>" + (", redacted string" if with_text else "")
    return table.select("row_id", text).mapInArrow(_scanner(as_json, with_text), schema)


def found_secrets(table: DataFrame, text: str, as_json: bool, table_name: str) -> DataFrame:
    """(table_name, row_id, secret_text): one row for each distinct credential in a row."""
    hits = scan(table, text, as_json, with_text=False)
    return hits.select(F.lit(table_name).alias("table_name"), "row_id", F.explode("secrets").alias("secret_text"))
