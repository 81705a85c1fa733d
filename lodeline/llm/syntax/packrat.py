"""Parsers from grammar texts: every rule becomes a function with a table of what it matched where (packrat parsing).

A grammar is compiled once for each language and process; a stream is parsed in time linear in its tokens.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

from lodeline.llm.syntax import lexer as L
from lodeline.llm.syntax import pylexer as PY

_SCRIPT_KINDS = {"NAME": L.NAME, "NUM": L.NUM, "STR": L.STR, "REGEX": L.REGEX, "PRIVATE": L.PRIVATE, "TNONE": L.TNONE, "THEAD": L.THEAD, "TMID": L.TMID, "TEND": L.TEND, "EOF": L.EOF, "JBEGIN": L.JBEGIN, "JEND": L.JEND, "JOPEN": L.JOPEN, "JCLOSE": L.JCLOSE}
_LANGUAGES = {"script": (_SCRIPT_KINDS, L.EOF), "python": (PY.KINDS, PY.EOF)}
_TOKEN = re.compile(r"\s*(?:'([^']+)'|\{(\w+)\}|%(\w+)|([A-Za-z]+)|([/()*?+!&]))")
# fixed values: words that name nothing in strict code
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT = frozenset("implements interface let package private protected public static yield await".split())


def _read(source: str, kinds: dict[str, int]) -> dict[str, tuple]:
    rules: dict[str, tuple] = {}
    for line in source.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        name, _, body = line.partition("=")
        tokens = [m.groups() for m in _TOKEN.finditer(body)]
        tree, rest = _choice(tokens, 0, kinds)
        if rest != len(tokens):
            raise ValueError(f"grammar rule {name.strip()}: {tokens[rest:]}")
        rules[name.strip()] = tree
    return rules


def _choice(t: list, i: int, kinds: dict[str, int]) -> tuple:
    options = []
    while True:
        items = []
        while i < len(t) and t[i][4] not in ("/", ")"):
            item, i = _item(t, i, kinds)
            items.append(item)
        options.append(("seq", items))
        if i < len(t) and t[i][4] == "/":
            i += 1
            continue
        return ("alt", options) if len(options) > 1 else options[0], i


def _item(t: list, i: int, kinds: dict[str, int]) -> tuple:
    lit, flag, special, name, op = t[i]
    if op in ("!", "&"):
        inner, i = _item(t, i + 1, kinds)
        return ("not" if op == "!" else "and", inner), i
    if op == "(":
        node, i = _choice(t, i + 1, kinds)
        i += 1
    else:
        node = ("lit", lit) if lit else ("flag", flag) if flag else ("test", special) if special else ("kind", name) if name in kinds else ("rule", name)
        i += 1
    while i < len(t) and t[i][4] in ("*", "?", "+"):
        node = ({"*": "star", "?": "opt", "+": "plus"}[t[i][4]], node)
        i += 1
    return node, i


#: Rules whose matches the checks behind the grammar look at.
_SPANS = ("FuncBody", "For", "While", "Do", "Switch", "Member", "Prop", "FuncDef", "ClassDef", "Lambda")


class Grammar:
    """A grammar for one language; ``flags`` are the parts of the grammar the language has."""

    def __init__(self, source: str, flags: frozenset[str], start: str = "Program", family: str = "script"):
        self.flags, self.start = flags, start
        self.kinds, self.eof = _LANGUAGES[family]
        self.rules = _read(source, self.kinds)
        self.reserved = PY.KEYWORDS if family == "python" else RESERVED if "ts" in flags else RESERVED | STRICT
        self.name = self.kinds["NAME"]
        self._n = 0
        self._judged: dict = {}
        fast, slow = {}, {}
        exec(compile(self._program(False), "<grammar>", "exec"), fast)  # noqa: S102
        exec(compile(self._program(True), "<grammar>", "exec"), slow)  # noqa: S102
        self._fast, self._slow = fast["parse"], slow["parse"]

    def _program(self, track: bool) -> str:
        lines = ["def parse(K, W, NL, ADJ, RES):", "  far = [0]"]
        for name in self.rules:
            lines.append(f"  memo_{name} = {{}}")
        for name, tree in self.rules.items():
            lines += [f"  def r_{name}(i):", f"    p = memo_{name}.get(i)", "    if p is not None: return p"]
            self._emit(tree, "i", "p", 4, lines, track)
            lines += [f"    memo_{name}[i] = p", "    return p"]
        lines += ["  def r_Reserved(i):", f"    return i + 1 if K[i] == {self.name} and W[i] in RES else -1"]
        spans = ", ".join(f"{n!r}: memo_{n}" for n in self.rules if n in _SPANS)
        lines += [f"  return r_{self.start}(0), far[0], {{{spans}}}"]
        return "\n".join(lines)

    def _var(self) -> str:
        self._n += 1
        return f"v{self._n}"

    def _dead(self, node: tuple) -> bool:
        if node[0] == "flag":
            return node[1] not in self.flags
        if node[0] == "not" and node[1][0] == "flag":
            return node[1][1] in self.flags
        return node[0] == "seq" and any(self._dead(x) for x in node[1]) or node[0] == "alt" and all(self._dead(x) for x in node[1])

    def _emit(self, node: tuple, a: str, b: str, d: int, out: list[str], track: bool) -> None:
        pad = " " * d
        kind = node[0]
        if kind == "lit":
            out.append(f"{pad}{b} = {a} + 1 if W[{a}] == {node[1]!r} else -1")
            if track:
                out.append(f"{pad}if {b} < 0 and {a} > far[0]: far[0] = {a}")
        elif kind == "kind":
            out.append(f"{pad}{b} = {a} + 1 if K[{a}] == {self.kinds[node[1]]} else -1")
            if track:
                out.append(f"{pad}if {b} < 0 and {a} > far[0]: far[0] = {a}")
        elif kind == "flag":
            out.append(f"{pad}{b} = {a if node[1] in self.flags else -1}")
        elif kind == "test":
            cond = {"nl": f"NL[{a}]", "nonl": f"not NL[{a}]", "adj": f"ADJ[{a}]", "semi": f"(NL[{a}] or W[{a}] == '}}' or K[{a}] == {self.eof})"}[node[1]]
            out.append(f"{pad}{b} = {a} if {cond} else -1")
        elif kind == "rule":
            out.append(f"{pad}{b} = r_{node[1]}({a})")
        elif kind == "seq":
            if self._dead(node):
                out.append(f"{pad}{b} = -1")
                return
            items = [x for x in node[1] if x[0] != "flag" and not (x[0] == "not" and x[1][0] == "flag")]
            if not items:
                out.append(f"{pad}{b} = {a}")
            at = a
            for k, item in enumerate(items):
                to = b if k == len(items) - 1 else self._var()
                self._emit(item, at, to, d, out, track)
                if k < len(items) - 1:
                    out.append(f"{' ' * d}if {to} < 0: {b} = -1")
                    out.append(f"{' ' * d}else:")
                    d += 1
                at = to
        elif kind == "alt":
            live = [x for x in node[1] if not self._dead(x)]
            for k, option in enumerate(live):
                if k:
                    out.append(f"{' ' * d}if {b} < 0:")
                    d += 1
                self._emit(option, a, b, d, out, track)
            if not live:
                out.append(f"{pad}{b} = -1")
        elif kind == "opt":
            t = self._var()
            self._emit(node[1], a, t, d, out, track)
            out.append(f"{pad}{b} = {t} if {t} >= 0 else {a}")
        elif kind in ("star", "plus"):
            t, u = self._var(), self._var()
            out += [f"{pad}{u} = {a}", f"{pad}while True:"]
            self._emit(node[1], u, t, d + 1, out, track)
            out += [f"{pad} if {t} <= {u}: break", f"{pad} {u} = {t}"]
            out.append(f"{pad}{b} = {u}" if kind == "star" else f"{pad}{b} = {u} if {u} > {a} else -1")
        elif kind in ("not", "and"):
            t = self._var()
            self._emit(node[1], a, t, d, out, track)
            out.append(f"{pad}{b} = {a} if {t} {'<' if kind == 'not' else '>='} 0 else -1")

    def first_error(self, text: str) -> int | None:
        """Offset of the first token at which no parse can go on; None if the text is valid."""
        s = L.Stream(text, "jsx" in self.flags)
        if s.mark >= 0:
            return s.mark
        words = [w if k != 0 or w in _CLASS_WORDS else "\0i" for k, w in zip(s.kind, s.word)]
        found = None
        for a, b in _pieces(s):
            # what the parser can tell apart of a piece; pieces that look alike are judged once
            key = (tuple(words[a:b]), tuple(s.nl[a:b]), tuple(s.adj[a:b]))
            error = self._judged.get(key, -1)
            if error == -1:
                if len(self._judged) > 50_000:
                    self._judged.clear()
                error = self._judged[key] = self._piece(s, a, b)
            if error is not None:
                found = a + error
                break
        if found is None:
            return None
        # a piece that is no whole statement by itself is judged again as part of its text
        error = self._piece(s, 0, len(s.kind) - 1)
        return None if error is None else s.at[min(error, len(s.at) - 1)]

    def _piece(self, s: L.Stream, a: int, b: int) -> int | None:
        """The token, counted from ``a``, at which no parse of tokens a..b can go on; None if there is none."""
        kind, word = [*s.kind[a:b], L.EOF], [*s.word[a:b], ""]
        args = (kind, word, [*s.nl[a:b], True], [*s.adj[a:b], False], self.reserved)
        try:
            end, _, spans = self._fast(*args)
            if end < 0:
                return self._slow(*args)[1]
        except RecursionError:
            return 0
        return _misplaced(kind, word, spans)


#: Names that the grammar or the checks behind it tell from others.
_CLASS_WORDS = RESERVED | STRICT | frozenset(
    "as from of async get set type declare abstract readonly override accessor namespace module global require asserts is infer keyof unique satisfies assert target meta eval arguments constructor out intrinsic any unknown never object string number boolean symbol bigint undefined".split()
)
#: Words that go on with a statement whose closing brace stands before them.
_GO_ON = frozenset("else catch finally while in instanceof as satisfies of from is extends implements with assert".split())


def _pieces(s: L.Stream) -> list[tuple[int, int]]:
    """Ranges of tokens that are statements by themselves: cut at a line break after ; or } outside all brackets, where a
    name follows that begins something new."""
    out, start, depth = [], 0, 0
    kind, word, nl = s.kind, s.word, s.nl
    for i in range(len(kind) - 1):
        w = word[i]
        if kind[i] == L.PUNCT:
            if w in "([{" and len(w) == 1:
                depth += 1
            elif w in ")]}":
                depth -= 1
        elif kind[i] in (L.JBEGIN, L.JOPEN, L.THEAD):
            depth += 1
        elif kind[i] in (L.JEND, L.JCLOSE, L.TEND):
            depth -= 1
        if depth == 0 and w in (";", "}") and nl[i + 1] and kind[i + 1] == L.NAME and word[i + 1] not in _GO_ON:
            out.append((start, i + 1))
            start = i + 1
    if start < len(kind) - 1 or not out:
        out.append((start, len(kind) - 1))
    return out


def _misplaced(kind: list[int], word: list[str], spans: dict[str, dict[int, int]]) -> int | None:
    """A return outside functions, a break or continue outside what it could leave, super or new.target outside methods
    and functions: the first such token, None if there is none."""
    if not _PLACED & set(word):
        return None
    ranges = {name: [(i, j) for i, j in found.items() if j >= 0] for name, found in spans.items()}
    loops = [*ranges["For"], *ranges["While"], *ranges["Do"]]

    def within(i: int, some: list[tuple[int, int]]) -> int:
        """Where the innermost of some ranges around token ``i`` begins, -1 if there is none."""
        return max((a for a, b in some if a < i < b), default=-1)

    for i, w in enumerate(word):
        if w not in _PLACED or kind[i] != L.NAME or i and word[i - 1] in (".", "?."):
            continue
        after = word[i + 1] if i + 1 < len(word) else ""
        body = within(i, ranges["FuncBody"])
        if w == "return":
            if after not in (":", "(", "?", "=", ",", "}") and body < 0:
                return i
        elif w in ("break", "continue"):
            if after not in (";", "}") and not (after == "" and kind[i + 1] == L.EOF):
                continue  # a label, or a name that is used as a property
            if i and word[i - 1] in ("{", ",") and after == "}" and kind[i - 1] == L.PUNCT and within(i, ranges["Prop"]) >= 0:
                continue
            around = within(i, loops if w == "continue" else [*loops, *ranges["Switch"]])
            if around < 0 or around < body:
                return i
        elif w == "super":
            if after in ("(", ".", "[") and within(i, ranges["Member"]) < 0 and within(i, ranges["Prop"]) < 0:
                return i
            if after == "(" and not any(a < i < b and "constructor" in word[a : a + 6] for a, b in ranges["Member"]):
                return i
        elif w == "new" and after == "." and body < 0 and within(i, ranges["Member"]) < 0:
            return i
    return None


_PLACED = frozenset(("return", "break", "continue", "super", "new"))


class PythonGrammar(Grammar):
    """Python: the grammar, then what CPython's compiler refuses although the grammar takes it and no scope is needed for."""

    def __init__(self, source: str):
        super().__init__(source, frozenset(), family="python")

    def first_error(self, text: str) -> int | None:
        if "\0" in text:
            return text.index("\0")
        s = PY.Stream(text)
        if s.mark >= 0:
            return s.mark
        words = [w if k != PY.NAME or w in PY.KEYWORDS or w in _SOFT else "\0i" for k, w in zip(s.kind, s.word)]
        for a, b in _blocks(s):
            key = tuple(words[a:b])
            sound = self._judged.get(key)
            if sound is None:
                if len(self._judged) > 50_000:
                    self._judged.clear()
                sound = self._judged[key] = self._run(self._fast, s, a, b) is None
            if not sound:
                break
        else:
            return None
        # a block that is no whole statement by itself is judged again as part of its text
        error = self._run(self._slow, s, 0, len(s.kind) - 1)
        return None if error is None else s.at[min(error, len(s.at) - 1)]

    def _run(self, parse, s: PY.Stream, a: int, b: int) -> int | None:
        try:
            end, far, _ = parse([*s.kind[a:b], PY.EOF], [*s.word[a:b], ""], None, None, self.reserved)
        except RecursionError:
            return 0
        return far if end < 0 else None


#: Names that Python's grammar tells from others in some places.
_SOFT = frozenset(("match", "case", "type", "_"))


def _blocks(s: PY.Stream) -> list[tuple[int, int]]:
    """Ranges of tokens that are statements by themselves: cut behind a line or block at the margin where no word goes on with it."""
    out, start, depth, kind, word = [], 0, 0, s.kind, s.word
    for i in range(len(kind) - 1):
        k = kind[i]
        if k == PY.INDENT:
            depth += 1
        elif k == PY.DEDENT:
            depth -= 1
        if depth == 0 and k in (PY.NEWLINE, PY.DEDENT) and kind[i + 1] not in (PY.INDENT, PY.DEDENT, PY.EOF) and word[i + 1] not in ("else", "elif", "except", "finally") and not (k == PY.NEWLINE and word[start] == "@"):
            out.append((start, i + 1))
            start = i + 1
    if start < len(kind) - 1 or not out:
        out.append((start, len(kind) - 1))
    return out


_GRAMMARS: dict[str, Grammar] = {}
_FLAGS = {"javascript": frozenset(), "typescript": frozenset({"ts"}), "tsx": frozenset({"ts", "jsx"})}


def grammar(language: str) -> Grammar:
    if language not in _GRAMMARS:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))
        source = Path(__file__).with_name("python.peg" if language == "python" else "script.peg").read_text(encoding="utf-8")
        _GRAMMARS[language] = PythonGrammar(source) if language == "python" else Grammar(source, _FLAGS[language])
    return _GRAMMARS[language]
