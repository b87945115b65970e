import ast
import json
import subprocess
import time
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm.gll import Grammar, Token
from lorespark.llm.syntax import error_line, syntax_diagnostics, syntax_rates

GOOD = {
    "json": ['{"a": [1, -2.5e3, null, "x\\u00e9"]}', "3"],
    "toml": ['a = 1\n[t."x y"]\nb = [1, 2,\n 3,]\nc = {d = 2026-03-06T10:00:00Z, e = """m\nn"""}\n[[u]]\n', ""],
    "yaml": ["a: 1\nb:\n- x\n- y: z\n  w: |\n    text: {\n", "{a: [1, 2], 'b': c}", "just\nwords", "--- a\n...\n--- b\n", "", "? k\n: v\n&x a: *x\n"],
    "python": [
        "async def f(a, /, b: int = 1, *c, d, **e) -> x:\n    async with a as b, c:\n        await (yield)\n    return [i async for i in x if i]\n",
        "match x:\n    case {'a': [1, *r], **k} if k: pass\n    case A(b=1) | None as z: pass\n",
        "try:\n  pass\nexcept* E as e:\n  raise X from e\nelse:\n\tpass\nfinally: pass\n",
        "x = lambda *a, k=1: (y := a)\nprint(f'{x!r:>{w}} {d[\"k\"]}')\n@d\nclass A[T](B, metaclass=C): x: int = 1; del x\n",
        "",
    ],
    "javascript": [
        "import a, * as b from 'x'; export default class A extends B { #p = 1; static { } get x() { return this.#p } async *g() { yield* 1 } }",
        "const {a = 1, ...r} = b?.[c] ?? (async x => { await x })\nlet re = /[/]\\//g, t = `a${`b${c}`}d`\nfor await (const x of y) ;\n",
        "label: for (let i = 0, n = 9; i < n; i++) { if (a) continue label; else break }\nx = a ? b : c => d\n",
    ],
    "typescript": [
        "export abstract class A<T extends B = C> implements D { private readonly x?: T[]; constructor(public y: string, z?: number) {} abstract m(): void; [k: string]: any }",
        "type M<T> = { readonly [K in keyof T as `x${K}`]?: T[K] extends (infer U)[] ? U : never }; declare module 'm' { export const x: number }",
        "let x = y as const; const a = [1, 2] as const, b = {c: 1} as const satisfies D\nlet t = <const>['a'], u = e as unknown as F[] as const",
        "function f<T>(this: A, ...r: [a: string, b?: number]): r is X { return <any>r as unknown as T }\nenum E { A = 1, B }\nlet v = x! satisfies Y<Z<W>>;",
    ],
    "go": ['package p\nimport (\n\t"fmt"\n\t. "x"\n)\ntype S[T any] struct {\n\ta, b int `t`\n\t*E\n}\nfunc (s *S[T]) F(x ...int) (r <-chan int, err error) {\n\tif v, ok := m[k]; !ok { goto L }\nL:\n\tswitch t := v.(type) { case int, *S: default: }\n\tselect { case x := <-c: case c <- 1: }\n\tfor i := range 10 { defer func() { _ = []int{1: 2} }() }\n\treturn\n}\n'],
    "java": [
        'package a.b; import static c.D.*; @A(x = {1, 2}) public sealed interface I<T extends Q & R> permits S { default <U> U f(List<? super T>[] x) throws E { return x -> switch (x) { case 1, 2 -> "a"; default -> { yield 1; } }; } }',
        'record P(int x, String... y) { P { } static final int[][] A = {{1}, {}}; enum E { A(1) { }, B; } } class C { { for (var e : m.entrySet()) if (e instanceof P(int q, var r) && q >> 2 > 1) f::g; } }'.replace("f::g;", "h(f::g);"),
        "",
    ],
    "shell": ["f() { local x=$(cat <<'E'\n( don't\nE\n); [[ -n $x && $y =~ ^a(b) ]] || return 1; }\ncase \"$1\" in (a|b) echo ;; *) ;; esac\nfor ((i=0;i<3;i++)); do echo ${a[@]:1} `ls`; done >&2 2>/dev/null\narr=(1 2 $(x))\nwhile read -r l; do :; done < <(cmd)\n", "# only\n", ""],
}
BAD = {
    "json": ["", "{a: 1}", '{"a": 1,}', "[1", "01", '{"a": 1} {}', "'x'", '"\t"'],
    "toml": ["a = ", "a = b c", "[t", 'a = "x', "<<<<<<< ours", "a = 1 b = 2", "= 1"],
    "yaml": ["a: b: c", "a: [1, 2", "a:\n\tb: 1", '"open', "a: 1\n b: 2", "- a\nb: c", "<<<<<<< ours\nx: 1"],
    "python": ["def f(:\n  pass", "print 'x'", "if x:\npass", "x = (1", "f() = 1", "a b", "  x\n y\n", "x = “a”", "class", "try:\n  pass\n", "'open", "def f()\n  pass"],
    "javascript": ["const x = ;", "function (", "a => {", "class { x: 1 }", "let x = “a”", "if (x", "}", "<<<<<<< ours", "`open", "return {", "const a: string = 1", "await = 1"],
    "typescript": ["let x: = 1", "interface { a }", "type X = ", "class A { private }}", "def f(x):", "enum E {"],
    "go": ["", "func f() {}", "package p\nvar x = *\n", "package p\nfunc f( {\n}\n", "package p\n}\n", "package p\nimport x\n"],
    "java": ["class {", "class A { int x }", "class A { void f() { return } }", "import a.b", "class A { } }", "class A { String s = \"open; }"],
    "shell": ["if x; then", "f( {", "echo \"open", "case x in a) ;;", "x=$(", "done", "for x in a; do echo", "a | | b", "echo 'x"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert error_line(language, text) is None


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_broken(language, text):
    assert error_line(language, text) is not None


def ok(f, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            f(text)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def damaged(texts):
    """Texts with a piece cut out, doubled or swapped for another sign."""
    return st.sampled_from(texts).flatmap(lambda t: st.tuples(st.integers(0, len(t)), st.integers(0, 6), st.sampled_from(["", "(", ")", "]", ",", ":", "\n", '"', "x", "=", " "])).map(lambda a: t[: a[0]] + a[2] + t[a[0] + a[1] :]))


@settings(max_examples=150, deadline=None)
@given(damaged(GOOD["json"]))
def test_json_agrees_with_a_parser(text):
    def strict(t):
        def constant(name):
            raise ValueError(name)

        json.loads(t, parse_constant=constant)

    assert (error_line("json", text) is None) == ok(strict, text)


@settings(max_examples=200, deadline=None)
@given(damaged([t for t in GOOD["python"] if "f'" not in t and "match" not in t]))
def test_python_agrees_with_a_parser(text):
    if ok(ast.parse, text):
        assert error_line("python", text) is None


@settings(max_examples=100, deadline=None)
@given(damaged(GOOD["toml"]))
def test_toml_accepts_what_a_parser_accepts(text):
    if ok(tomllib.loads, text):
        assert error_line("toml", text) is None


@settings(max_examples=40, deadline=None)
@given(damaged(["for x in a b; do\n  if [ -n \"$x\" ]; then echo '}' | cat; fi\ndone > y\n", "f() {\n  case $1 in\n    a) g ;;\n  esac\n}\n"]))
def test_shell_agrees_with_bash(text):
    bash = subprocess.run(["bash", "-n"], input=text.encode(), capture_output=True)
    assert (error_line("shell", text) is None) == (bash.returncode == 0)


def repeated(n):
    """Files with n elements of each kind of list and chain."""
    numbers = ", ".join(map(str, range(n)))
    return {
        "json": [f"[{numbers}]"],
        "toml": [f"x = [{numbers},]\n", "".join(f"k{i} = {i}\n" for i in range(n))],
        "yaml": [f"x: [{numbers}]\n", "".join(f"- a: {i}\n" for i in range(n))],
        "python": [f"x = [{numbers}]\n", f"f({numbers},)\n", "f(" + ", ".join(f"g({i}, a.b[{i}], k={i})" for i in range(n)) + ")\n", "x = " + " + ".join(f"a{i}" for i in range(n)) + "\n", "if a: pass\n" + "".join(f"elif a == {i}: pass\n" for i in range(n))],
        "javascript": [f"const x = [{numbers},];\n", "x = {" + ", ".join(f"a{i}: [{i}]" for i in range(n)) + ",};\n", "if (a) x();" + "".join(f" else if (x === {i}) y({i});" for i in range(n)), "x" + "".join(f".f({i})" for i in range(n)) + "\n", "x = " + "".join(f"a{i} ? {i} : " for i in range(n)) + "0\n"],
        "typescript": [f"const x = [{numbers},] as const;\n", "type U = " + " | ".join(f"'{i}'" for i in range(n)) + ";\n", "interface I {\n" + "".join(f"a{i}: string\n" for i in range(n)) + "}\n"],
        "go": [f"package p\nvar x = []int{{{numbers},}}\n", "package p\nfunc f() {\n" + "".join(f"x{i} := f({i})\n" for i in range(n)) + "}\n"],
        "java": [f"class A {{ int[] x = {{{numbers},}}; }}\n", "class A { void f() {" + "".join(f"if (x == {i}) y(); else " for i in range(n)) + ";}}\n", "enum E {" + ", ".join(f"A{i}({i})" for i in range(n)) + "}\n"],
        "shell": [f"x=({numbers.replace(',', '')})\n", "".join(f"echo {i} | cat\n" for i in range(n))],
    }


@pytest.mark.parametrize("language", sorted(GOOD))
def test_work_grows_in_proportion(language):
    """Twenty times the elements take about twenty times as long, not four hundred times."""
    for short, long in zip(repeated(300)[language], repeated(6000)[language]):
        took = []
        for text in (short, short, long):
            began = time.process_time()
            assert error_line(language, text) is None
            took.append(time.process_time() - began)
        assert took[2] < 80 * max(took[1], 0.002), (language, short[:40], took)
        assert language == "yaml" or error_line(language, long + " )") is not None


@pytest.mark.parametrize("language, text", [("json", "[" * 3000 + "]" * 3000), ("python", "x = " + "(" * 2000 + "1" + ")" * 2000 + "\n"), ("javascript", "x = " + "[" * 2000 + "]" * 2000 + ";"), ("javascript", "x = " + "(" * 2000 + "a" + ")" * 2000), ("java", "class A { int x = " + "(" * 500 + "1" + ")" * 500 + "; }")])
def test_deep_nesting(language, text):
    assert error_line(language, text) is None and error_line(language, text + "]") is not None


def test_loops_over_what_may_be_empty_end():
    g = Grammar("File = (Name? Name?)* (',' | Name)* ; Name = NAME ;")
    t = [Token(frozenset((k,)), 1) for k in ("NAME", "NAME", ",", "NAME")]
    assert g.recognise(t, ["File"])[0] == {"File"} and g.recognise([], ["File"])[0] == {"File"}


def test_else_belongs_to_the_nearest_if():
    g = Grammar("File = Stat ; Stat = 'if' Stat ('else' Stat | @noelse) | NAME ;")
    token = lambda k: Token(frozenset((k,)), 1)
    assert g.recognise([token(k) for k in "if if NAME else NAME else NAME".split()], ["File"])[0] == {"File"}
    assert g.recognise([token(k) for k in "if NAME else NAME else NAME".split()], ["File"])[0] == set()


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("File = Sum ; Sum = Sum '+' Sum | Sum Sum | NAME | ;")
    token = lambda k: Token(frozenset((k,)), 1)
    assert g.recognise([token(k) for k in ("NAME", "+", "NAME", "NAME")], ["File"])[0] == {"File"}
    assert g.recognise([token("NAME")] * 25, ["File"])[0] == {"File"}
    assert g.recognise([token("-")], ["File"]) == (set(), 0)


def test_dialects_share_a_stack():
    g = Grammar("First = Names 'a' ; Second = Names 'b' ; Names = NAME* ;", ("First", "Second"))
    t = [Token(frozenset((k,)), 1) for k in ("NAME", "NAME", "b")]
    assert g.recognise(t, ["First", "Second"])[0] == {"Second"}


def test_files(spark):
    rows = [("w", "a.json", "json", "{"), ("w", "a.json", "json", "{"), ("w", "b.json", "json", "[]"), ("w", "c.json", "json", None), ("w", "d.md", "markdown", "{"), ("v", "e.py", "python", "x = (\n"), ("v", "f", None, "x"), ("v", "g.py", "python", "x = 1\n" * 3000)]
    df = spark.createDataFrame(rows, "workspace_id string, path string, language string, content string")
    assert {(r.workspace_id, r.path) for r in syntax_diagnostics(df.selectExpr("*", "1 as line", "2 as code")).collect()} == {("w", "a.json"), ("v", "e.py")}
    assert {tuple(r) for r in syntax_rates(df).collect()} == {("w", "json", 2, 1, 0.5), ("v", "python", 2, 1, 0.5)}
    assert syntax_diagnostics(df.where("false")).count() == 0
