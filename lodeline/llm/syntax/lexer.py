"""Token streams of ECMAScript, TypeScript and JSX.

Where a slash, a smaller-than sign or a closing brace means different things, what stands before it decides. JSX is
read as one bracket of tokens: its tags are matched here, and only the expressions inside go to the grammar.
"""

from __future__ import annotations

import re

NAME, NUM, STR, REGEX, PRIVATE, TNONE, THEAD, TMID, TEND, PUNCT, EOF, BAD, JBEGIN, JEND, JOPEN, JCLOSE = range(16)

_SPACE = re.compile(r"(?:[ \t\v\f﻿   -   　]+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/|(\r\n|[\n\r  ]))*")
_BLOCK = re.compile(r"/\*.*?\*/", re.S)
_GAP = re.compile(r"[ \t\v\f﻿   -   　]+")
_LINE = re.compile(r"//[^\n\r  ]*")
_WORD = re.compile(r"(?:[^\W\d]|[$_‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n"
    r"|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w$])"
)
_STRING = re.compile(r""""(?:[^"\\\n\r]|\\(?:\r\n|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|0(?![0-9])|[^ux0-9]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|0(?![0-9])|[^ux0-9]))*'""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)(?![\w$])")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
# > is always one token: the grammar joins >> and >= where the context wants an operator
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_MARK = re.compile(r"(?:(?:<{7}|>{7}|\|{7})(?=[ \r\n]|\Z)|={7}(?=\r|\n|\Z))")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=[^=>'\"{])")
_TAG = re.compile(r"[A-Za-z_$][\w$-]*(?:(?:\s*[.:]\s*)[A-Za-z_$][\w$-]*)*")
_ATTR = re.compile(r"[A-Za-z_$][\w$-]*(?:\s*:\s*[A-Za-z_$][\w$-]*)?")
_ATTR_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TEXT = re.compile(r"[^<{>}]*")

_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default export as satisfies is keyof".split())
_HEADS = frozenset(("if", "while", "for", "with"))
_BEFORE_OBJECT = frozenset(("(", ",", "=", ":", "[", "!", "&", "|", "?", "+", "-", "*", "/", "%", "~", "<", ">", "&&", "||", "??", "===", "!==", "==", "!=", "+=", "-=", "...", "=>", "return", "typeof", "in", "of", "new", "await", "yield", "case", "throw", "default", "??=", "||=", "&&="))


_GROUP = re.compile(r"\(\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>)|\((?!\?)")
_REPEAT = re.compile(r"(?:[*+?]|\{(\d+)(?:,(\d*))?\})\??")


def sound_pattern(body: str) -> bool:
    """Whether groups of a regular expression close and every repeat has something to repeat, its bounds in order."""
    i, n, depth, atom = 0, len(body), 0, False
    while i < n:
        c = body[i]
        if c == "\\":
            i, atom = i + 2, True
        elif c == "[":
            i += 1
            while i < n and body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            i, atom = i + 1, True
        elif c == "(":
            m = _GROUP.match(body, i)
            if not m:
                return False
            i, depth, atom = m.end(), depth + 1, False
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            i, atom = i + 1, True
        elif c == "|" or c == "^":
            i, atom = i + 1, False
        elif c in "*+?{" and (m := _REPEAT.match(body, i)):
            if not atom or m.group(2) and int(m.group(1)) > int(m.group(2)):
                return False
            i, atom = m.end(), False
        else:
            i, atom = i + 1, True
    return depth == 0


class Stream:
    """Kinds, texts, offsets, line breaks and adjacency of all tokens; ``bad`` is the offset of the first that is none."""

    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.kind: list[int] = []
        self.word: list[str] = []
        self.at: list[int] = []
        self.nl: list[bool] = []
        self.adj: list[bool] = []
        self.bad = -1
        self.mark = -1
        pos = 0
        if text.startswith("#!"):
            m = re.compile(r"[^\n\r]*").match(text)
            pos = m.end()
        end = self._run(pos, None)
        self._add(EOF, "", end, True, False)

    def _add(self, kind: int, word: str, at: int, nl: bool, adj: bool) -> None:
        self.kind.append(kind)
        self.word.append(word)
        self.at.append(at)
        self.nl.append(nl)
        self.adj.append(adj)

    def _skip(self, i: int) -> tuple[int, bool]:
        text, nl = self.text, False
        n = len(text)
        while i < n:
            c = text[i]
            if c in "\n\r  ":
                nl = True
                i += 1
                if text[i : i + 1] in ("<", ">", "=", "|") and self.mark < 0 and _MARK.match(text, i):
                    self.mark = i
            elif c == "/" and text[i + 1 : i + 2] == "/":
                i = _LINE.match(text, i).end()
            elif c == "/" and text[i + 1 : i + 2] == "*":
                m = _BLOCK.match(text, i)
                if not m:
                    return i, nl
                nl = nl or "\n" in m.group() or "\r" in m.group()
                i = m.end()
            else:
                m = _GAP.match(text, i)
                if not m:
                    break
                i = m.end()
        return i, nl

    def _value_next(self) -> bool:
        """Whether a value may begin here, from the token before."""
        if not self.kind:
            return True
        k, w = self.kind[-1], self.word[-1]
        if k == NAME:
            return w in _BEFORE_VALUE and not (len(self.word) > 1 and self.word[-2] in (".", "?."))
        if k == PUNCT:
            if w == ")":
                return self._paren_head
            if w == "}":
                return self._brace_block
            return w not in ("]", "++", "--") and not (w == "!" and self._bang_post)
        return k in (THEAD, TMID, JOPEN)

    _paren_head = False
    _brace_block = True
    _bang_post = False

    def _run(self, i: int, until: str | None) -> int:
        """Tokens from ``i`` up to the brace that closes an expression in a template or in JSX, or to the end."""
        text, n = self.text, len(self.text)
        stack: list[tuple[str, bool]] = []
        if i == 0 and _MARK.match(text, 0):
            self.mark = 0
        while True:
            start = i
            if i < n and (text[i].isalnum() or text[i] in "().,;{}[]"):
                nl = False
            elif text[i : i + 1] == " " and i + 1 < n and (text[i + 1].isalnum() or text[i + 1] in "(){}=+-[]'\""):
                nl, i = False, i + 1
            else:
                i, nl = self._skip(i)
            adj = i == start
            if i >= n:
                return n
            c = text[i]
            if c.isalpha() or c in "_$\\":
                m = _WORD.match(text, i)
                if not m:
                    return self._fail(i)
                self._add(NAME, m.group(), i, nl, adj)
                i = m.end()
                continue
            if c in "\"'":
                m = _STRING.match(text, i)
                if not m or "\\u{" in m.group() and any(int(x, 16) > 0x10FFFF for x in re.findall(r"\\u\{([0-9a-fA-F]+)\}", m.group())):
                    return self._fail(i)
                self._add(STR, "\u0000s", i, nl, adj)
                i = m.end()
                continue
            if c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
                m = _NUMBER.match(text, i)
                if not m:
                    return self._fail(i)
                self._add(NUM, "\u0000n", i, nl, adj)
                i = m.end()
                continue
            if c == "`":
                i = self._template(i, nl, adj)
                if i < 0:
                    return n
                continue
            if c == "#":
                m = _WORD.match(text, i + 1)
                if not m:
                    return self._fail(i)
                self._add(PRIVATE, "\u0000p", i, nl, adj)
                i = m.end()
                continue
            if c == "/" and self._value_next():
                m = _REGEX.match(text, i)
                if not m or len(set(m.group(1))) != len(m.group(1)) or not set(m.group(1)) <= set("dgimsuvy") or not sound_pattern(m.group()[1 : -1 - len(m.group(1))]):
                    return self._fail(i)
                self._add(REGEX, "\u0000r", i, nl, adj)
                i = m.end()
                continue
            if c == "<" and self.jsx and self._value_next() and not _GENERIC.match(text, i) and self.word[-3:-2] != ["type"]:
                if self.kind and self.word[-1] == "{" and self.kind[-1] == PUNCT and stack and not stack[-1][1] and re.match(r"<[A-Za-z]\w*>\s*\(", text[i : i + 40]):
                    pass  # a generic call signature in an interface
                else:
                    i = self._element(i, nl, adj)
                    if i < 0:
                        return n
                    continue
            m = _PUNCT.match(text, i)
            if not m:
                return self._fail(i)
            w = m.group()
            if w == "(":
                stack.append(("(", bool(self.kind) and self.kind[-1] == NAME and self.word[-1] in _HEADS))
            elif w == ")":
                self._paren_head = stack.pop()[1] if stack and stack[-1][0] == "(" else False
            elif w == "{":
                last = self.word[-1] if self.kind and self.kind[-1] in (PUNCT, NAME) else ""
                stack.append(("{", last in _BEFORE_OBJECT and last != "=>"))
            elif w == "}":
                if until and not any(b == "{" for b, _ in stack):
                    return i
                while stack and stack[-1][0] != "{":
                    stack.pop()
                self._brace_block = not stack.pop()[1] if stack else True
            elif w == "!":
                self._bang_post = not self._value_next()
            self._add(PUNCT, w, i, nl, adj)
            i = m.end()

    def _fail(self, i: int) -> int:
        if self.bad < 0:
            self.bad = i
            self._add(BAD, "\u0000bad", i, False, False)
        return len(self.text)

    def _template(self, i: int, nl: bool, adj: bool) -> int:
        text, first, at = self.text, True, i
        i += 1
        while True:
            m = _TEMPLATE.match(text, i)
            i = m.end()
            if i >= len(text):
                self._fail(at)
                return -1
            if text[i] == "`":
                self._add(TNONE if first else TEND, "\u0000t", at, nl and first, adj)
                return i + 1
            self._add(THEAD if first else TMID, "\u0000t", at, nl and first, adj)
            first = False
            at = i = self._run(i + 2, "}")
            if self.bad >= 0 or text[i : i + 1] != "}":
                self._fail(min(i, len(text)))
                return -1
            i += 1

    def _braced(self, i: int) -> int:
        self._add(JOPEN, "\u0000{", i, False, False)
        i = self._run(i + 1, "}")
        if self.bad >= 0 or self.text[i : i + 1] != "}":
            self._fail(i)
            return -1
        self._add(JCLOSE, "\u0000}", i, False, False)
        return i + 1

    def _element(self, i: int, nl: bool, adj: bool) -> int:
        """A JSX element from its < on; its tags must match."""
        text = self.text
        self._add(JBEGIN, "\u0000<", i, nl, adj)
        i, _ = self._skip(i + 1)
        m = _TAG.match(text, i)
        tag = m.group() if m else ""
        i = m.end() if m else i
        while True:
            i, _ = self._skip(i)
            c = text[i : i + 1]
            if c == ">":
                i += 1
                break
            if c == "/" and tag:
                j, _ = self._skip(i + 1)
                if text[j : j + 1] != ">":
                    self._fail(i)
                    return -1
                self._add(JEND, "\u0000>", j, False, False)
                return j + 1
            if c == "{" and tag:
                if not re.compile(r"\{\s*\.\.\.").match(text, i):
                    self._fail(i)
                    return -1
                i = self._braced(i)
                if i < 0:
                    return -1
                continue
            if c == "<" and tag and self._type_args(i) > 0:
                i = self._type_args(i)
                continue
            m = _ATTR.match(text, i)
            if not m or not tag:
                self._fail(i)
                return -1
            i, _ = self._skip(m.end())
            if text[i : i + 1] == "=":
                i, _ = self._skip(i + 1)
                s = _ATTR_STRING.match(text, i)
                if s:
                    i = s.end()
                elif text[i : i + 1] == "{":
                    if re.compile(r"\{\s*\}").match(text, i):
                        self._fail(i)
                        return -1
                    i = self._braced(i)
                elif text[i : i + 1] == "<":
                    i = self._element(i, False, False)
                else:
                    self._fail(i)
                    return -1
                if i < 0:
                    return -1
        while True:
            for k in re.finditer(r"^", text[i : _JSX_TEXT.match(text, i).end()], re.M) if "\n" in text[i : _JSX_TEXT.match(text, i).end()] else ():
                if _MARK.match(text, i + k.start()) and (i + k.start() == 0 or text[i + k.start() - 1] == "\n") and self.mark < 0:
                    self.mark = i + k.start()
            i = _JSX_TEXT.match(text, i).end()
            c = text[i : i + 1]
            if c == "{":
                i = self._braced(i)
                if i < 0:
                    return -1
            elif c == "<":
                j, _ = self._skip(i + 1)
                if text[j : j + 1] != "/":
                    i = self._element(i, False, False)
                    if i < 0:
                        return -1
                    continue
                j, _ = self._skip(j + 1)
                m = _TAG.match(text, j)
                k, _ = self._skip(m.end() if m else j)
                if re.sub(r"\s", "", m.group() if m else "") != re.sub(r"\s", "", tag) or text[k : k + 1] != ">":
                    self._fail(i)
                    return -1
                self._add(JEND, "\u0000>", k, False, False)
                return k + 1
            else:  # the end of the text, or a bare > or }
                self._fail(i)
                return -1

    def _type_args(self, i: int) -> int:
        m = re.compile(r"<[\w\s.,|&\[\]'\"]+>").match(self.text, i)
        return m.end() if m else -1
