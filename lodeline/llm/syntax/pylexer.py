"""Token streams of Python: names, numbers, strings, operators, line ends, indentation; fields of formatted strings are read in place."""

from __future__ import annotations

import re

NAME, NUM, STR, PUNCT, NEWLINE, INDENT, DEDENT, EOF, FBEGIN, FEND, FOPEN, FCLOSE, FSPEC, BAD = range(14)
KINDS = {"NAME": NAME, "NUM": NUM, "STR": STR, "NEWLINE": NEWLINE, "INDENT": INDENT, "DEDENT": DEDENT, "EOF": EOF, "FBEGIN": FBEGIN, "FEND": FEND, "FOPEN": FOPEN, "FCLOSE": FCLOSE, "FSPEC": FSPEC}
# fixed values: words that name nothing
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())

_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
)
_OLD_OCTAL = re.compile(r"0(?:_?0)*(?:_?[1-9])(?:_?\d)*$")
_PREFIX = re.compile(r"(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF])?(?=[\"'])")
_OPERATOR = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[+\-*/%@&|^~<>()\[\]{},:;.=]")
_SPACE = re.compile(r"[ \t\f]*")
_COMMENT = re.compile(r"#[^\n\r]*")
_MARK = re.compile(r"(?:(?:<{7}|>{7}|\|{7})(?=[ \r\n]|\Z)|={7}(?=\r|\n|\Z))")
_SHORT = {q: re.compile(rf"[^\\{q}\n\r]*") for q in "\"'"}
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}]+\}))")
_BAD_BYTE_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")


class Stream:
    """Kinds, texts and offsets of all tokens; ``mark`` is the offset of a line that a merge left behind, -1 if there is none."""

    def __init__(self, text: str):
        self.text = text
        self.kind: list[int] = []
        self.word: list[str] = []
        self.at: list[int] = []
        self.mark = -1
        self._fields: list[list] = []  # open formatted strings: [quote, raw, brackets when its field began, in spec]
        self._run()

    def _add(self, kind: int, word: str, at: int) -> None:
        self.kind.append(kind)
        self.word.append(word)
        self.at.append(at)

    def _fail(self, at: int) -> None:
        self._add(BAD, "\0bad", at)
        self._add(EOF, "", at)

    def _run(self) -> None:
        text, n, i = self.text, len(self.text), 0
        indents, alternates, brackets = [0], [0], []
        line_start = True
        while True:
            if line_start and not brackets and not self._fields:
                start = i
                i = _SPACE.match(text, i).end()
                if i < n and text[i] in "<>=|" and self.mark < 0 and i == start and _MARK.match(text, i):
                    self.mark = i
                m = _COMMENT.match(text, i)
                j = m.end() if m else i
                if j >= n:
                    i = j
                elif text[j] in "\r\n":
                    i = j + (2 if text.startswith("\r\n", j) else 1)
                    continue
                else:
                    width, alternate = 0, 0
                    for c in text[start:i]:
                        width = 0 if c == "\f" else width + 1 if c == " " else (width // 8 + 1) * 8
                        alternate = 0 if c == "\f" else alternate + 1
                    if width == indents[-1]:
                        if alternate != alternates[-1]:
                            return self._fail(i)
                    elif width > indents[-1]:
                        if alternate <= alternates[-1]:
                            return self._fail(i)
                        indents.append(width)
                        alternates.append(alternate)
                        self._add(INDENT, "\0in", i)
                    else:
                        while width < indents[-1]:
                            indents.pop()
                            alternates.pop()
                            self._add(DEDENT, "\0out", i)
                        if width != indents[-1] or alternate != alternates[-1]:
                            return self._fail(i)
                line_start = False
            i = _SPACE.match(text, i).end()
            if i >= n:
                if brackets or self._fields:
                    return self._fail(n)
                if self.kind and self.kind[-1] not in (NEWLINE, DEDENT, INDENT):
                    self._add(NEWLINE, "\0nl", n)
                for _ in indents[1:]:
                    self._add(DEDENT, "\0out", n)
                self._add(EOF, "", n)
                return
            c = text[i]
            if c in "\r\n":
                if not brackets and not self._fields:
                    self._add(NEWLINE, "\0nl", i)
                    line_start = True
                i += 2 if text.startswith("\r\n", i) else 1
                if (brackets or self._fields) and i < n and text[i] in "<>=|" and self.mark < 0 and _MARK.match(text, i):
                    self.mark = i
                continue
            if c == "#":
                i = _COMMENT.match(text, i).end()
                continue
            if c == "\\":
                if text.startswith("\r\n", i + 1):
                    i += 3
                elif i + 1 < n and text[i + 1] in "\r\n":
                    i += 2
                else:
                    return self._fail(i)
                if i >= n:
                    return self._fail(i)
                continue
            if self._fields and len(brackets) == self._fields[-1][2]:  # at the top of a field
                if c == "}":
                    self._add(FCLOSE, "\0}", i)
                    if len(self._fields[-1]) == 5:
                        self._fields.pop()
                    i = self._formatted(i + 1, brackets)
                    if i < 0:
                        return
                    continue
                if c == "!" and text[i + 1 : i + 2] != "=":
                    self._add(PUNCT, "!", i)
                    i += 1
                    continue
                if c == ":":
                    self._add(FSPEC, "\0:", i)
                    self._fields[-1][3] += 1
                    i = self._formatted(i + 1, brackets)
                    if i < 0:
                        return
                    continue
            if c in "rRbBuUfF\"'":
                m = _PREFIX.match(text, i)
                if m:
                    i = self._string(i, m.group().lower(), m.end(), brackets)
                    if i < 0:
                        return
                    continue
            if c.isdigit() or c == "." and text[i + 1 : i + 2].isdigit():
                m = _NUMBER.match(text, i)
                if not m or not m.group().isascii() or _OLD_OCTAL.match(m.group()):
                    return self._fail(i)
                j = m.end()
                if j < n and (text[j] == "_" or text[j].isdigit() or text[j].isalpha() and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, j)):
                    return self._fail(i)
                self._add(NUM, "\0n", i)
                i = j
                continue
            m = _NAME.match(text, i)
            if m:
                if not m.group().isidentifier():
                    return self._fail(i)
                self._add(NAME, m.group(), i)
                i = m.end()
                continue
            m = _OPERATOR.match(text, i)
            if not m:
                return self._fail(i)
            w = m.group()
            if w in "([{":
                brackets.append(w)
                if len(brackets) > 200:
                    return self._fail(i)
            elif w in ")]}":
                if not brackets or brackets[-1] + w not in ("()", "[]", "{}") or self._fields and len(brackets) <= self._fields[-1][2]:
                    return self._fail(i)
                brackets.pop()
            self._add(PUNCT, w, i)
            i = m.end()

    def _string(self, at: int, prefix: str, i: int, brackets: list) -> int:
        """A string whose quotes begin at ``i``; the place behind it, -1 if it is broken."""
        text = self.text
        quote = text[i] * 3 if text.startswith(text[i] * 3, i) else text[i]
        raw = "r" in prefix
        body = i + len(quote)
        if "f" in prefix:
            self._add(FBEGIN, "\0f", at)
            self._fields.append([quote, raw, len(brackets), 0])
            return self._formatted(body, brackets)
        i = body
        while True:
            if len(quote) == 1:
                i = _SHORT[quote].match(text, i).end()
                c = text[i : i + 1]
                if c == quote:
                    break
                if c != "\\" or i + 1 >= len(text):
                    self._fail(at)
                    return -1
                i += 3 if text.startswith("\r\n", i + 1) else 2
            else:
                j = text.find(quote, i)
                k = text.find("\\", i, j if j >= 0 else len(text))
                if k >= 0:
                    i = k + 2
                elif j < 0:
                    self._fail(at)
                    return -1
                else:
                    i = j
                    break
        inner = text[body:i]
        if "b" in prefix and not inner.isascii() or "\\" in inner and not raw and (_BAD_BYTE_ESCAPE if "b" in prefix else _BAD_ESCAPE).search(inner):
            self._fail(at)
            return -1
        self._add(STR, "\0b" if "b" in prefix else "\0s", at)
        return i + len(quote)

    def _formatted(self, i: int, brackets: list) -> int:
        """The literal part of the innermost formatted string from ``i`` to its next field, its end, or the end of a spec."""
        text, n = self.text, len(self.text)
        field = self._fields[-1]
        quote, raw = field[0], field[1]
        while True:
            if i >= n:
                self._fail(n)
                return -1
            if not field[3] and text.startswith(quote, i) or field[3] and len(quote) == 1 and text[i] == quote:
                if field[3]:
                    self._fail(i)
                    return -1
                self._fields.pop()
                self._add(FEND, "\0f", i)
                return i + len(quote)
            c = text[i]
            if c == "\\":
                if not raw and text.startswith("N{", i + 1):
                    j = text.find("}", i)
                    if j < 0:
                        self._fail(i)
                        return -1
                    i = j + 1
                    continue
                if not raw and _BAD_ESCAPE.match(text, i):
                    self._fail(i)
                    return -1
                i += 1 if text[i + 1 : i + 2] in ("{", "}") else 3 if text.startswith("\r\n", i + 1) else 2
            elif c in "\r\n" and len(quote) == 1:
                self._fail(i)
                return -1
            elif c == "{":
                if text.startswith("{{", i) and not field[3]:
                    i += 2
                    continue
                self._add(FOPEN, "\0{", i)
                if field[3]:  # a field inside a spec stands on a level of its own
                    self._fields.append([quote, raw, len(brackets), 0, "nested"])
                return i + 1
            elif c == "}":
                if field[3]:
                    field[3] = 0
                    self._add(FCLOSE, "\0}", i)
                    i += 1
                    if len(field) == 5:
                        self._fields.pop()
                        field = self._fields[-1]
                    continue
                if text.startswith("}}", i):
                    i += 2
                    continue
                self._fail(i)
                return -1
            else:
                i += 1
