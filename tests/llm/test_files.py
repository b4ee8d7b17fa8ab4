"""Splitting, origin, syntax and truncation on written cases, with odd rows."""

import ast
import random

import pytest

from millrace.llm import code_origin, splitting, syntax, truncation

PIECE = "chunk_id long, repo string, file_path string, start_line int, end_line int, content string, symbol string, language string, lines int, code string"


def chunks(spark, files):
    rows = [(k, repo, path, 1, None, text, None, None, 3, "q") for k, (repo, path, text) in enumerate(files)]
    return spark.createDataFrame(rows, PIECE)


def test_pieces_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\r中。") for _ in range(rng.randint(0, 500)))
        limit = rng.randint(4, 90)
        overlap = rng.randint(0, limit // 2 - 1)
        pieces = splitting.cuts(text, limit, overlap)
        out = ""
        for k, (a, b) in enumerate(pieces):
            assert 0 < b - a <= limit
            out += text[a:b] if not k else text[pieces[k - 1][1] : b]
            if k:
                assert a in (pieces[k - 1][1] - overlap, pieces[k - 1][1] - overlap + 1)
        assert out == text
        if len(text) > limit:  # the first cut by brute force
            s = splitting.strengths(text)
            assert pieces[0][1] == max(range(max(overlap + 1, limit // 2), limit + 1), key=lambda i: (s[i], i))


def test_split_rows(spark):
    body = "".join(f"def f{i}(a):\n    return a + {i}\n\n\n" for i in range(300))
    df = chunks(spark, [("r", "a.py", body), ("r", "b.py", "x" * 4000), ("r", "c.py", "x" * 4001), ("r", "d.py", None), ("r", "e.py", "")])
    rows = splitting.split_oversized(df.union(df)).collect()
    assert {r["chunk_id"] for r in rows} == {0, 2} and all(len(r["content"]) <= 4000 for r in rows)
    lines = body.split("\n")
    for r in rows:
        if r["chunk_id"] == 0:
            assert r["symbol"].startswith("f") and r["content"].split("\n")[1] == lines[r["start_line"]]
            assert r["end_line"] == 1 + body[: r["end"] - 1].count("\n")
    assert splitting.split_oversized(df.limit(0)).count() == 0


VALID = {
    "js": ["", "a = b\nc()\n", "x.map(y => ({...y, z: `t${1}`}))", "class A extends B { static #p = 1; get v() { return this.#p } }", "for (let i = 0, n = 3; i < n; i++) ;", "var r = /[/]\\/\"/g.test(s) ? 1 : 2", "export default async function* f({a, b = 1}, ...c) { yield* g() }", "if (a) b; else { c } /* <<<<<<< x */"],
    "ts": ["interface A<T> { readonly x?: T[]; f(a: number): void }", "export const f = async <T,>(a: T): Promise<Map<string, T>> => { return a as any }", "type U = { [K in keyof T]?: T[K] } | null", "enum E { A = 1, B }", "let a!: string; function f(this: X, b?: number): asserts b is number { }"],
    "go": ["package a\n\nfunc (r *T) F(a, b int) (int, error) {\n\tx := map[string][]int{\"a\": {1, 2}}\n\tfor i := range x {\n\t\tgo func() { <-c }()\n\t}\n\tif v, ok := x[\"b\"]; ok {\n\t\treturn v[0], nil\n\t}\n\treturn 1, nil\n}\n", "package b\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n}\n\ntype I interface {\n\tF(int) error\n}\n"],
    "java": ["package a.b;\nimport java.util.*;\n@Deprecated\npublic class A<T extends B & C> implements D {\n  private final Map<String, List<T>> m = new HashMap<>();\n  A(int... x) throws E { this.m.forEach((k, v) -> { f(k); }); }\n  int[][] g() { return new int[][]{{1}, {2}}; }\n}", "record P(int x, int y) { }", "enum E { A(1) { void f() {} }, B; int x; E(int... v) {} }"],
    "rs": ["use std::{fmt, io::*};\n#[derive(Debug)]\npub struct A<'a, T: Fn(i32) -> i32> where T: Copy { pub x: &'a [T; 3] }\nimpl<'a> A<'a, B> { fn f(&mut self) -> Result<(), Box<dyn E>> { let v = vec![1, 2]; match v[0] { 0 | 1 if true => {} x @ 2..=5 => return Err(x)?, _ => () } if let Some(y) = z { y } else { loop { break } } } }", "fn main() { let c = |a: i32| a + 1; for i in 0..10 { println!(\"{}\", c(i)); } }"],
    "c": ["#include <a.h>\n#define M(x) \\\n  (x)\nstatic const struct a *f(int a[], char *b, ...) { for (int i = 0; i < 3; i++) { b->c[i] = (unsigned char)*b++; } return &(struct a){ .x = 1, [2] = {3} }; }\n", "typedef int (*fp)(void *, size_t);\nenum e { A = 1, B };\nint x[3] = {1, 2, 3}, *y;\n"],
}
BROKEN = {
    "js": ["function f( { ", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "def f(a):\n    return a", "var x = \"abc", "a b c", "if (x) }"],
    "ts": ["let x: = 3", "interface A { x: }", "#!/bin/sh\nif [ -f x ]; then\n  y\nfi"],
    "go": ["package a\nfunc f() {\n\tx := []int1, 2}\n}", "function f(a) {\n  return a;\n}", "package a\nfunc f() {", ""],
    "java": ["class A { int f() { return 1 } }", "class A { void f() { g(; } }", "<!DOCTYPE html>\n<html></html>"],
    "rs": ["fn f() { let x = ; }", "fn f() { x = 1 y = 2; }", "fn f( {}"],
    "c": ["int f() { return 1 }", "int main( { }", "#inclde <x>\nint x;"],
}


@pytest.mark.parametrize("ext", list(VALID))
def test_grammars(ext):
    for text in VALID[ext]:
        assert syntax.parses(text, ext), text
        assert syntax.parses(text.replace("\n", "\r\n"), ext), text
    for text in BROKEN[ext]:
        assert not syntax.parses(text, ext), text


@pytest.mark.parametrize(
    "ext,valid,broken",
    [
        ("c", "enum E {\n A,\n B,\n C\n};", "enum E {\n A,\n B\n C\n};"),
        ("c", "int x[] = {\n 1,\n 2,\n 3,\n};", "int x[] = {\n 1,\n 2\n 3\n};"),
        ("java", "class A { int[] x = {\n 1,\n 2,\n 3\n}; }", "class A { int[] x = {\n 1,\n 2\n 3\n}; }"),
        ("java", "class A { void f() {\n foo(a)\n .bar(b)\n .bar(c);\n} }", "class A { void f() {\n foo(a)\n foo(a)\n .bar();\n} }"),
        ("rs", "fn f() { let s = S {\n a: u,\n b: v,\n c: w\n}; }", "fn f() { let s = S {\n a: u,\n b: v\n c: w\n}; }"),
        ("js", "x = {\n a,\n b,\n c\n}", "x = {\n a,\n b\n c\n}"),
    ],
)
def test_lines_of_one_shape_need_their_separators(ext, valid, broken):
    assert syntax.parses(valid, ext) and not syntax.parses(broken, ext)


PYTHON = [
    "", "x = 1\n", "def f(a, /, b=1, *, c: int = 2, **k) -> int:\n    return a if b else [x async for x in y]\n", "@d(1)\nclass A(B, metaclass=M):\n    x: int = 3\n\n    def f(self): pass\n",
    "try:\n    a\nexcept (B, C) as e:\n    raise D from e\nelse:\n    pass\nfinally:\n    del a[1:2, ::3]\n", "with a as b, c:\n    x = yield\n", "if x:\n  a\nelif y:\n  b\nelse:\n  c\n", "match x:\n    case [1, *r] if r:\n        pass\n    case A(b=1) | None:\n        pass\n",
    "print 'x'", "def f(:\n    pass", "if x:\npass", "x = (1,\n", "for x in y\n    z", "  x = 1", "if a:\n    b\n  c", "class A:\n", "x = 'abc", "a = 1 +", "lambda: (yield)", "f(*a, **b)", "x = {1: 2, **y}", "a = b = c, *d = e", "assert x, y; import a.b as c, d", "async def f():\n    async with a: await b\n", "f'{x!r:>{w}}'", "x = \\\n  3\n", "while 1:\n\tif x:\n\t\tbreak\n\telse:\n\t\tcontinue\n",
]


def test_python_grammar_agrees_with_the_compiler():
    for text in PYTHON:
        try:
            ast.parse(text)
            want = True
        except SyntaxError:
            want = False
        assert syntax.parses(text, "py") == want, text


def test_python_grammar_under_random_damage():
    rng = random.Random(2)
    base = PYTHON[2] + PYTHON[3] + PYTHON[4] + PYTHON[6]
    wrong = 0
    for _ in range(150):
        i, n = rng.randrange(len(base)), rng.randint(1, 6)
        text = base[:i] + base[i + n :]
        try:
            ast.parse(text)
            want = True
        except SyntaxError:
            want = False
        wrong += syntax.parses(text, "py") != want
    assert wrong <= 8  # rules that go beyond a grammar, as of what may be assigned to


def test_files_are_joined_and_odd_rows_pass(spark):
    rows = [
        (1, "r", "a.py", 1, None, "def f():", None, None, 1, ""), (2, "r", "a.py", 2, None, "    return 1", None, None, 1, ""), (2, "r", "a.py", 2, None, "    return 1", None, None, 1, ""),
        (3, None, "b.js", 1, None, "f(", None, None, 1, ""), (4, "r", "c.txt", 1, None, "((", None, None, 1, ""), (5, "r", None, 1, None, "x", None, None, 1, ""), (6, "r", "d.py", None, None, None, None, None, 1, ""),
    ]
    df = spark.createDataFrame(rows, PIECE)
    got = {(r["repo"], r["file_path"]): r["broken"] for r in syntax.parsed_files(df).collect()}
    assert got == {("r", "a.py"): False, (None, "b.js"): True, ("r", "c.txt"): None, ("r", "d.py"): False}
    assert {(r["repo"], r["broken_rate"]) for r in syntax.broken_rates(df).collect()} == {("r", 0.0), (None, 1.0)}
    assert syntax.parsed_files(df.limit(0)).count() == 0


def hand(seed):
    rng = random.Random(seed)
    name = lambda: f"{rng.choice('abcdefgh')}{rng.randint(100, 999)}_part"
    forms = ["    {} = {}({}, 3)", "    if {} > {}: {} = 2", "    for {} in {}: {}.append(1)", "    return {} + {} - {}", "    with {} as {}: {}()", "    {}.update({}[{}])", "    while {} < {}: {} += 1", "    raise {}({}, {})", "    {} = [{}, {}]", "    assert {}, ({}, {})", "    del {}, {}, {}"]
    return "def " + name() + "(a):\n" + "\n".join(rng.choice(forms).format(name(), name(), name()) for _ in range(30))


def test_origin(spark):
    lib = hand(1)
    edited = "\n".join(r for k, r in enumerate(lib.split("\n")) if k % 9)
    getters = "\n\n".join(f"def get_v{i}(m):\n    return m._fields[{i}].V{i}" for i in range(12))
    files = [
        ("r1", "vendor/lib/a.py", lib), ("r2", "core/b.py", edited), ("r3", "core/c.py", hand(2)), ("r1", "core/own.py", lib),
        ("r3", "x/d.py", "# Code generated by tool. DO NOT EDIT.\n" + hand(3)), ("r3", "x/e.py", getters), ("r3", "x/vendor_portal/f.py", 's = "Code generated by x. DO NOT EDIT."\n' + hand(4)),
        ("r3", "x/g.js", "function a(b,c){return d(b,c)||e.f}" * 60), ("r3", "x/h.py", "t = [\n" + "\n".join(f'    ("k{i}", {i}, 0.{i}),' for i in range(40)) + "\n]"),
        ("r3", "x/i_pb2.py", hand(5)), (None, "x/j.py", None), ("r3", "x/k.py", ""), ("r3", "x/l.py", "#!/bin/sh\n" + "if [ -f a ]; then\n  b\nfi\n" * 9),
    ]
    got = {(r["repo"], r["file_path"]): r["reason"] for r in code_origin.not_hand_written(chunks(spark, files)).collect()}
    assert got == {
        ("r1", "vendor/lib/a.py"): "vendored", ("r2", "core/b.py"): "vendored", ("r3", "core/c.py"): None, ("r1", "core/own.py"): None, ("r3", "x/d.py"): "generated", ("r3", "x/e.py"): "generated",
        ("r3", "x/vendor_portal/f.py"): None, ("r3", "x/g.js"): "minified", ("r3", "x/h.py"): "data", ("r3", "x/i_pb2.py"): "generated", (None, "x/j.py"): None, ("r3", "x/k.py"): None, ("r3", "x/l.py"): None,
    }
    assert code_origin.not_hand_written(chunks(spark, files).limit(0)).count() == 0


def test_lines_of_most_repositories_say_nothing(spark):
    stock = "".join(f"import java.util.common.Thing{k};\n" for k in range(6))
    lib = hand(8)
    files = [("r0", "vendor/a.py", stock + lib), ("r1", "x/copy.py", lib), ("r2", "x/short.java", stock + "class A { }\n")]
    files += [(f"r{i}", "x/own.java", stock + hand(20 + i)) for i in range(3, 9)]
    got = {(r["repo"], r["file_path"]): r["reason"] for r in code_origin.not_hand_written(chunks(spark, files)).collect()}
    assert got.pop(("r0", "vendor/a.py")) == "vendored" and got.pop(("r1", "x/copy.py")) == "vendored"
    assert set(got.values()) == {None}


def test_marks_late_in_a_licence_or_in_a_closing_comment(spark):
    licence = "".join(f"# clause {k} of a long text that says little\n" for k in range(150))
    rows = [
        (1, "r", "x/a.py", 1, None, licence + "# Code generated by tool. DO NOT EDIT.\n" + hand(31), None, None, 1, ""),
        (2, "r", "x/b.py", 1, None, hand(32), None, None, 1, ""), (3, "r", "x/b.py", 99, None, hand(33) + "\n\n# Code generated by tool.\n# DO NOT EDIT.\n", None, None, 1, ""),
        (4, "r", "x/c.js", 1, None, "function f(a) {\n  return g(a) + 1;\n}\n/* Code generated by tool. DO NOT EDIT. */", None, None, 1, ""),
        (5, "r", "x/d.py", 1, None, hand(34) + "\n# Code generated by tool. DO NOT EDIT.\n", None, None, 1, ""), (6, "r", "x/d.py", 99, None, hand(35), None, None, 1, ""),
    ]
    got = {r["file_path"]: r["reason"] for r in code_origin.not_hand_written(spark.createDataFrame(rows, PIECE)).collect()}
    assert got == {"x/a.py": "generated", "x/b.py": "generated", "x/c.js": "generated", "x/d.py": None}


def test_truncation(spark):
    rng = random.Random(4)
    words = ["harbor", "lantern", "meadow", "quarry", "signal", "timber", "vessel", "window", "anchor", "bridge"]
    sentence = lambda: "The " + " ".join(rng.choice(words) for _ in range(9)) + "."
    whole = [" ".join(sentence() for _ in range(4)) for _ in range(60)]
    logs = ["\n".join(f"12:{i:02d}:{k:02d} INFO {rng.choice(words)} took {k} ms" for k in range(9)) + "\nexit status 0" for i in range(20)]
    lists = ["Notes:\n" + "\n".join(f"- the {rng.choice(words)}: done" for _ in range(4)) for _ in range(20)]
    dots = [w + " To be continued..." for w in whole[:5]]
    cut = [w[: w.rfind(" ") - 3] for w in whole[:10]] + [whole[11][:-1] + " and then the…", logs[0][: logs[0].rfind("\n") - 7], "```\ncode\n", whole[12][:40] + " [truncated]"]
    texts = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(whole + logs + lists + dots + cut)]
    first = len(texts) - len(cut)
    texts += [(900, "c", None), (901, "c", ""), (902, "c", "  \n"), (903, "d", cut[0]), (0, "a", whole[0]), (None, None, whole[1])]
    df = spark.createDataFrame([(*t, 1, "w") for t in texts], "doc_id long, source string, text string, size int, token string")
    got = {r["doc_id"] for r in truncation.truncated(df).where("cut").collect()}
    assert got == {*range(first, first + len(cut)), 903}
    assert truncation.truncated(df).count() == len(texts)
    assert truncation.truncated(df.limit(0)).count() == 0 and truncation.rates(df).where("source IS NULL").count() == 1


@pytest.mark.parametrize(
    "ext,valid,broken",
    [
        ("js", "x = `x${`y`}z`; `a${ {b: `c${d}`} } e`", "x = `a${b"),
        ("js", "if (a) /re/.test(b);\nwhile (c(d)) /[/]x/g.exec(e)", "if (a) /re"),
        ("js", "x = function (a) {}; (function () {})()\nexport default function (b) {}", "function (a) {}"),
        ("js", "const {a, b: [c]} = d, e = 1\nfor (const f of g) ;", "const a;"),
        ("ts", "const a: number = 1; declare const b: string;", "const a;"),
        ("py", 'x = f"{d["a"]}" f"{y!r:>{w}}{{}}"\n', 'x = f"{d["a"]}\n'),
        ("py", "f(a, *b, c=1, *d, **e, f=2)\nf(x for x in y)\n", "f(a=1, 2)\n"),
        ("py", "f(**a, b=1)\n", "f(**a, *b)\n"),
        ("py", "a.b[c] = d, (e, f) = g\n(x).y: int = 3\nx[0] += 1\n", "1 = x\n"),
        ("py", "for a, *b in c: pass\nwith a as (b, c): pass\n", "f() = x\n"),
        ("py", "if x:\n\ty\n\tz\nif a:\n        b\n", "if x:\n        y\n\tz\n"),
        ("mjs", "import a from 'b'", "import from"),
        ("pyi", "def f() -> int: ...\n", "def f() -> : ...\n"),
    ],
)
def test_what_was_taken_wrongly(ext, valid, broken):
    assert syntax.parses(valid, ext) and not syntax.parses(broken, ext)
