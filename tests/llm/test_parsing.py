import ast
import random
from pathlib import Path

import pytest

from lodeline.llm.parsing import broken_rates, first_error, judge_files, python_error

GOOD = {
    "javascript": [
        "", "// only\n", "a\n++b\nc()", "const {a, ...r} = x, [p = 1, , ...q] = y;", "for (const [k, v] of m) { if (k) continue; else break }", "label: for (;;) { break label }", "x = a ? b : c ? d : e;",
        "const f = async ({a}, b = 1, ...c) => { await g(); for await (const z of w) z(); };", "class A extends (B, C) { static #p = 1; static { this.x = 1 } get a() { return this.#p } async *g() { yield* h() } 'q'() {} [k] = 2 }",
        "let r = /[/\\]}]+/g.test(s) / 2 / 3;", "`a${`b${c}`}d`", "import d, {x as y, default as z} from 'm'; import * as n from 'n'; export * as k from 'k'; export {y as default};", "export default class {}", "export default function () {}",
        "if (a) /re/.exec(b)\nelse {}", "a?.b?.[c]?.(d) ?? e", "x = y\n(function () {})()", "({get: 1, set: 2, async: 3, async f() {}, get g() { return 1 }, [h]: 4, ...i})", "new A().b; new (f())(1); function g() { return new.target }\n", "const big = 10n + 0xFFn + 1_000;", "do x(); while (y) z()",
        "switch (a) { case 1: case 2: b(); default: c() }", "try { a() } catch { b() } finally { c() }", "var of = 1, get = 2, async = 3; async(of)", "/* <<<<<<< HEAD\n=======\n */ x", "x = `\n<<<<<<< HEAD\n=======\n`", "[a, b.c] = d; ({e, f: g.h = 1} = i)", "await x; export const y = await z",
    ],
    "typescript": [
        "type A<T extends string = 'x'> = { readonly [K in keyof T]?: T[K] } & Partial<Record<string, number[]>>;", "interface B extends C<D>, E { (x: number): string; new (y: F): G; m?(): void; [k: string]: unknown; readonly p: typeof q.r }",
        "abstract class H<T> extends I<T> implements J, K { private readonly x?: number = 1; constructor(public y: string, protected z = 2) { super() } abstract m(): void; declare w: string; static override async n<U>(u: U): Promise<U> { return u } }",
        "function f(this: Window, a?: number, ...b: string[]): asserts a is number; function f() {}", "const x = <T,>(y: T): T => y; const z = y as unknown as Map<string, Array<Set<number>>>; const w = v!;", "enum L { A = 1, B = 'b', 'c' } declare module 'm' { export const n: number; } namespace O.P { export type Q = 1 }",
        "let t: [a: string, b?: number, ...c: boolean[]] = ['x']; let u: (new () => X) | ((a: string) => void)[]; let s: `a${string}b`; let k: unique symbol;", "type C1 = A extends infer B extends string ? B : never;", "import type { M } from 'm'; export type { M }; import { type N, O } from 'n';", "f<string>(x); a < b; c > d; g<A, B>`t`; x = y satisfies Z;",
        "const v = a ? (b) : c => d;", "export declare function h(x: number): void; declare global { interface W { x: 1 } }", "let o = <const>{ a: 1 };", "for (let i = 0, n = a.length; i < n; i >>= 1) {}", "if (a >= b && c >>> 2 > 1) {}", "let y: A.B<C>['d'][number] | null;", "@dec() class V { @inject() x: string; constructor(@p() q) {} }", "function isS(x: unknown): x is string { return true }",
    ],
    "tsx": ["const a = <div className=\"x\" {...p} on={() => <b/>}>It's (text {c ? <i>y</i> : null} {/* no */}</div>;", "const f = <T,>(x: T) => <></>;", "export const g = () => (<A.B x:y='1'><C<string> v={1}/>&amp;</A.B>);", "const z = a < b, w = <p>{list.map((x) => (<li key={x}>{x}</li>))}</p>;"],
    "python": ["", "match x:\n    case {'a': b, **c}: pass\n", "def f[T](x: T) -> T: return x\n", "async def g():\n    async with a as b: await c\n", 's = """\n<<<<<<< HEAD\n=======\n"""\n', "print(f'{a!r:>{w}}')\n"],
}
MORE_GOOD = {
    "javascript": [
        "x = (a ?? b) || c; y = a ?? b ?? c; z = a || b && c", "x = (-a) ** b; y = a ** -b; z = 2 ** 3 ** 2; ++a ** b", "delete a.b; delete a[b]; delete a?.b; delete f().x", "a.b++; --c[d]; i++\nj--", "/(a|b)*?[)(]\\)(?:x){2,3}(?<n>y)(?=z)(?<!w)/u.test(s)", '"\\u{10FFFF}"', "new a.b.c(); new (a?.b)()",
        "for (;;) { switch (a) { case 1: continue; default: break } }", "while (a) { f(() => { for (;;) break }) } do { if (b) break } while (c)", "x = {break: 1, continue: 2, return: 3}; x.break; x.return", "class A extends B { constructor() { super(); } m() { super.m(); return () => super.n } get a() { return 1 } set a(v) {} }", "({ m() { super.m() }, get a() { return 1 }, set a(v) {} })",
        "switch (a) { default: x(); case 1: y() }", "outer: for (;;) { for (;;) continue outer }", "function f() {}\nif (a) {\n}\nelse {\n}\ntry {\n}\ncatch (e) {\n}\nfinally {\n}", "x = {\n}\n[a] = b", "const f = function () {\n}\nlet g = 1", "import.meta.url", "label: { break label }",
    ],
    "typescript": ["class A { get a(this: A): number { return 1 } set a(v: number) {} }", "let a = b as C ?? d; let e = f! || g;", "if (a) function f() {}", "export default interface I { break: number; return?(): void }"],
    "python": ["f'{x!r:>{w}.{p}}' f\"{a['b']}\" rf'\\d{y}'\n", "match = 1; case = 2; type = 3\nmatch(x)\n", "type X[T: int = str] = list[T]\n", "with (open(a) as b, c as d,): pass\n", "def g(): x = yield; await_ = 1\n", "try: pass\nexcept* A as e: pass\n", "def f(a, /, b, *, c=1, **d) -> int: ...\n", "x[1:2, ::3, *y] = 1\nprint(*a, **b)\n", "lambda *a, b=1, **c: (a, b)\n", "if x:\n\ty\nelse:\n        z\n", "a = b = yield_ = 0x_1F + 1_0.5e-3j\n", "for x in *a, *b: pass\n", "@a.b[c]\nclass D(E, metaclass=F): x: int = 1\n", "\\\nx = 1\n"],
}
MORE_BAD = {
    "javascript": [
        "-a ** b", "a ?? b || c", "a && b ?? c", "++a++", "0++", "--1", "/(/", "/a)/", "/+a/", "/(?<>a)/", '"\\u{110000}"', "new a?.b()", "a?.`x`", "import.meta = 1", "delete x", "eval = 1", "arguments += 1", "break", "if (a) continue", "for (;;) { function f() { break } }", "switch (a) { case 1: continue }",
        "super()", "function f() { super.x }", "class A { m() { super() } }", "new.target", "while (1) function f() {}", "switch (a) { default: default: }", "class A { get a(x) {} }", "class A { set a() {} }", "({ get a(x) { return 1 } })", "() => { return }\nreturn", "x = 1;\n}\ny = 2;",
    ],
    "typescript": ["-a ** b", "a ?? b || c", "switch (a) { default: default: }", "while (a) { } continue", "class A { set a(x, y) {} }"],
    "python": ["f'{x'\n", "f'{}'\n", "f'{x!}'\n", "x = 08\n", "'\\xZ'\n", "if x:\n        y\n\tz\n", "  x = 1\n", "def f(a, a): pass\n", "*a = 1\n", "a + b = c\n", "f() = 1\n", "x = 1 if y\n", "for x in y z: pass\n", "class A: return\n", "break\n", "await x\n", "print(a=1, 2)\n", "'a' b'b'\n", "x = 'a\nb'\n", "({a: b, **c for d in e})\n", "match x:\n  case 1 + 2: pass\n  case\n", "1_\n", "x = (1]\n", "import a.b as c.d\n", "from . import *, a\n", "def f(*): pass\n", "else: pass\n", "\\x\n"],
}
BAD = {
    "javascript": ["const x;", "function f(a { return a }", "class {", "let a: number = 1", "a = [1, (2, 3]", "const s = 'open", "`open", "return 1", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "a\n>>>>>>> main\n", "x = <b/>", "{\"name\": 1, \"b\": 2}", "if (a {}", "}", "export interface A {}", "a b", "let let = 1", "1 = 2", "def f(x):\n    return x\n", "/* open", "a /= ", "f(a,,b)", "const {a = } = b", "@@ -1 +1 @@", "x = 08"],
    "typescript": ["type A = ;", "interface B { x: }", "const x: = 1", "let y = <b>text</b>", "enum C { A = }", "function f(a: string { }", "import x from"],
    "tsx": ["const a = <div><b></div></b>;", "const a = <div>", "const a = <div>text > more</div>;", "const a = <div x=1/>;", "const a = <p>\n=======\n</p>;", "const a = <p>{x</p>;", "const a = (<p/>"],
    "python": ["def f(:\n", "print 'x'\n", "if a\n    b\n", "<<<<<<< HEAD\nx = 1\n", "return 1\n", "x = (1, 2\n", "\0"],
}


@pytest.mark.parametrize("language", list(GOOD))
def test_valid(language):
    assert [t for t in GOOD[language] if first_error(language, t) is not None] == []


@pytest.mark.parametrize("language", list(BAD))
def test_broken(language):
    assert [t for t in BAD[language] if first_error(language, t) is None] == []


@pytest.mark.parametrize("language", list(MORE_GOOD))
def test_more_valid(language):
    assert [t for t in MORE_GOOD[language] if first_error(language, t) is not None] == []


@pytest.mark.parametrize("language", list(MORE_BAD))
def test_more_broken(language):
    assert [t for t in MORE_BAD[language] if first_error(language, t) is None] == []


def test_the_python_grammar_alone_agrees_with_the_compiler():
    from lodeline.llm.syntax.packrat import grammar

    own = grammar("python").first_error
    library = sorted(Path(ast.__file__).parent.glob("*.py"))[:25]
    texts = [p.read_text(encoding="utf-8") for p in library]
    assert [p.name for p, t in zip(library, texts) if own(t) is not None] == []
    rnd, missed = random.Random(9), 0
    bits = ["(", ")", ":", "=", " if ", "'", "\n", "    ", "**", ",", "f'{", "}", "lambda ", "\\", "1", "x "]
    for text in texts[:12]:
        for _ in range(6):
            at = rnd.randrange(min(len(text), 4000))
            broken = text[:at] + rnd.choice(bits) + text[at + rnd.randrange(2) :]
            a, b = own(broken), python_error(broken)
            assert not (a is not None and b is None), broken[max(0, at - 60) : at + 60]
            missed += a is None and b is not None
    assert missed <= 3  # what only the compiler tells


def test_position_and_depth():
    assert first_error("javascript", "a = 1;\nb = ) 2;") == 11
    assert first_error("javascript", "x = " + "(" * 400 + "1" + ")" * 400) is None
    assert first_error("python", "x = 1\ny = )\n") == 10


def test_tables(spark):
    files = [(1, "r", "a/b.JS", "x = 1", "p"), (2, "r", "a.js", "x = ", "p"), (3, "r", "a.md", "x = (", "p"), (4, "r", None, "x", "p"), (5, "r", "c.py", None, "p"), (6, None, "d.pyi", "def", "p"), (2, "r", "a.js", "x = ", "p"), (7, "r", "e.js", "x = 1;\n" * 20000, "p"), (8, "r", "f.js", "", "p")]
    df = spark.createDataFrame(files, "file_id long, repo_id string, path string, text_content string, language string")
    spec = spark.createDataFrame([("javascript", "js"), ("python", "py"), ("python", "pyi")], "language string, extension string")
    judged = judge_files(df, spec)
    got = sorted((r["file_id"], r["language"], r["error_at"] is None) for r in judged.collect())
    assert got == [(1, "javascript", True), (2, "javascript", False), (2, "javascript", False), (6, "python", False), (7, "javascript", True), (8, "javascript", True)]
    rates = {(r["repo_id"], r["language"]): (r["files"], r["broken"]) for r in broken_rates(judged).collect()}
    assert rates == {("r", "javascript"): (5, 2), (None, "python"): (1, 1)}
    assert judge_files(df.limit(0), spec).count() == 0
