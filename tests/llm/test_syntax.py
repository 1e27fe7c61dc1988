import ast
import json
import random
import re
import sysconfig
import tomllib
import warnings
from pathlib import Path

import pytest

from lexmill.llm import syntax
from lexmill.llm.grammars import data, powershell, python

warnings.simplefilter("ignore")


def parses(text):
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


SNIPPETS = """
x = 1|type X[T: int = str] = list[T]|type = 3; match = 2; case = 1; _ = 0|print(*a, **b, c=1)|f(a for a in b)|f(a, b for b in c)|f(**k, *a)|f(a=1, b)|lambda *, a=1, **k: a|lambda: (yield)
x = y = yield z|x: int|(x): int = 3|x.y: int|x, y: int|a.b[c] += 1|a, b += 1|f() = 1|f().x = 1|(a, *b), c = d|[a, b] = c|*a = b|*a, = b|del a, (b, c[0])|del f()|a if b else c = 1
def f(a, /, b, *, c): pass|def f(a=1, b): pass|def f(*): pass|def f(*, **k): pass|def f(**k, a): pass|def f(a, *, b=1, c, **k) -> int: return|async def f(): await x|class A[T](B, metaclass=M): x = 1|class A: pass
with a as b, c as (d, e): pass|with (a as b, c): pass|with (a, b) as c: pass|with a: pass|for *a, b in c: pass|for a in *b, c: pass|for f() in x: pass|while x: break|try: pass|import a.b as c, d|from . import (a, b,)|from .a import *|from a import b,|import a.b.
f"{x!r:>{w}} {{}} {y=}"|f"{x:{y:{z}}}"|f"{x['a']} {'b'}"|f"{"nested"}"|f"{x"|f"{}"|f"}"|f"{x!}"|f'{a:%Y-%m}'|rf"\\d{x}"|f"\\N{BULLET} {x}"|f"{lambda x: 1}"|f"{(lambda x: 1)}"|b"a" "b"|b"é"|"\\x4"|"\\N{nonsense}"|'a' f'{b}' r'c'|f'''{
x}'''
1_000 + 0x_f + 1e5j + .5 + 5.|1__0|0777|00|0b12|1a|1if x else 2|0xfor x in y|a <> b|a !b|a $ b|a ? b|not a in b|a not b|a is not not b|- + ~a ** -b|a < b == c not in d|x := 1|(x := 1)|f(x := 1)|f(a=x := 1)|[x := 1, 2]|{x := 1}|a[x := 1]|a[b:c, *d, ::2]|a[*b]|{**a, 'b': 1, **c}|{*a, b}|{a: b for a, b in c if d if e}|{**a for a in b}|(*a)|(*a,)|(a, b
return|raise A from b|assert a, b|global a, b|nonlocal a|pass; pass;|;|a; b c|@a.b[c](d)
def f(): pass|@x := y
class A: pass|if a: pass
elif b: pass
else: pass|if a:
pass|try:
 a
except (A, B) as e:
 b
else:
 c
finally:
 d|try:
 a
except* E:
 b|match a:
 case [1, *_, {"k": v, **r}] | A(b, c=d) as e if f:
  pass
 case -1 + 2j | None | x.y | "s":
  pass|match a, *b:
 case _: pass|match (a)|a:
  b|x = \\
 1|x = (1,
# c
 2)|def f():
	x
        y|if 1:
    a
  b
"""


def test_python_snippets_agree_with_the_compiler():
    for t in [s for line in re.split(r"\n(?=\S)", SNIPPETS) for s in line.split("|")] + SNIPPETS.split("|"):
        assert (python.furthest_failure(t) < 0) == parses(t), t


def test_python_library_and_damaged_copies_agree_with_the_compiler():
    rng = random.Random(3)
    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::4]
    for f in files:
        t = f.read_text("utf-8")
        assert (python.furthest_failure(t) < 0) == parses(t), f
        t = t[:6000]
        for _ in range(8):
            toks = re.findall(r"\w+|\s+|[^\w\s]", t)
            k = rng.randrange(len(toks))
            if rng.random() < 0.5:
                toks[k : k + 1] = []
            else:
                toks.insert(k, rng.choice([*toks, "(", ")", ":", "'", "=", "\n", "    "]))
            x = "".join(toks)
            assert (python.furthest_failure(x) < 0) == parses(x), x[max(0, python.furthest_failure(x) - 80) :][:160]


def strict_json(t):
    def refuse(x):
        raise ValueError(x)

    try:
        json.loads(t, parse_constant=refuse)
        return True
    except ValueError:
        return False


def test_json_agrees_with_the_library():
    rng = random.Random(4)
    base = json.dumps({"a": [1, -2.5e3, True, None, "x\\n\u00e9"], "b": {"c": {}, "d": []}, "": "\U0001f600"}, ensure_ascii=False, indent=1)
    texts = ["", " ", "1", "01", "-", "1.", ".5", "1e", "NaN", "Infinity", "'a'", "[1,]", "{\"a\":1,}", "[1 2]", "{a:1}", "\"\t\"", "\"\\u12g4\"", "\"\\x\"", "// c\n1", "1 2", "nullx", "[]]", "\ufeff1", "\"\\ud800\"", "truefalse"]
    for _ in range(500):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice(["", "\"", ",", "}", "]", "x", "\\", "0", "\n"]) + base[k + rng.randrange(2) :])
    for t in texts:
        assert (data.json_furthest_failure(t) < 0) == strict_json(t), t


def strict_toml(t):
    try:
        tomllib.loads(t)
        return True
    except ValueError:
        return False


TOML = """# c
title = "a\\u00e9" # d
'lit.key' . b = 'x'
n = [1_000, 0xff, -1.5e+3, inf, 1979-05-27T07:32:00.5Z, 07:32:00, [ ], # c
 {a = 1, b.c = "x"},
]
m = \"\"\"a
 \\
  b \"\"\"
[t.u]
x = true
[[arr]]
k = '''l'''
[arr.sub]
[[arr]]
"""


def test_toml_agrees_with_the_library():
    rng = random.Random(5)
    texts = [TOML, "", "a=1\na=2", "[a]\n[a]", "[a.b]\n[a]", "[a]\nb.c=1\n[a.b]", "a.b=1\na.c=2", "a={b=1}\na.c=2", "[[a]]\n[a]", "a=[1]\n[[a]]", "x = 2024-02-30", "x = 1.", "x = 01", "x =", "= 1", "x = 'a\nb'", "x = {a=1,}", "x = {a=1\n}", "a b = 1", "x = \"\\q\"", "x = 1 y = 2", "[a]x=1", "x = nan", "x = +0x1", "a.1.b=3", "x=1\r\ny=2", "x=\"\"\"a\"\"\"\"\"", "[a.b.c]\n[a]\nb.d=1"]
    for _ in range(600):
        k = rng.randrange(len(TOML))
        texts.append(TOML[:k] + rng.choice(["", "\"", "=", "]", "[", "\n", ".", "{", "'", "1"]) + TOML[k + rng.randrange(3) :])
    for t in texts:
        assert (data.toml_furthest_failure(t) < 0) == strict_toml(t), t


GOOD_PS = [
    "", "Get-ChildItem -Path C:\\x | Where-Object { $_.Length -gt 1kb } | ForEach-Object { $_.Name }", "$a = 1,2,3; $b = @(1..10)", "if ($x -and -not $y) { 1 } elseif ($z) {2} else {3}",
    "try { Foo } catch [System.Exception] { Write-Error $_ } finally { }", "$h=@{a=1;b=\"x$($y.z)\"}\n$h.a", "[int]$x = \"5\"; [System.IO.File]::ReadAllText('a.txt')", "& \"$Python\" -m venv $Venv", "\"a\" + 'b' -f $x",
    "for ($i=0; $i -lt 3; $i++) { $i }", "switch ($x) { 1 { 'a' } default { 'b' } }", "function f { [CmdletBinding()] param([Parameter(Mandatory=$true)][string]$A, $B = 3) process { $A } }", "foo 2>&1 | Out-Null",
    "@\"\nhello \"x\" $(1+1)\n\"@", "$x = @'\n<<<<<<< x\nfunction {\n'@", "Get-X `\n  -A 1 `\n  -B 2", "$a[0].b['c']", "do { $x } until ($y)", "<# { #> # }\n'it''s'", "$x = if ($a) {1} else {2}", "while ($true) { break }", "throw \"x\"", "Write-Host (\"{0:N2}\" -f $x)",
]
BAD_PS = ["function f {", "}", "$x = \"a", "$x = 'a", "if $x { }", "{ \"a\": 1 }", "[1, 2]", "import os\nfor x in range(3):\n    pass", "$x = (1", "<<<<<<< HEAD\n$x = 1\n=======\n$x = 2\n>>>>>>> b", "<# open", "$x = @'\nabc", "@{a=1", "[server]\nport = 1\n[[a.b]]\n"]


@pytest.mark.parametrize("text", GOOD_PS)
def test_powershell_that_parses(text):
    assert powershell.furthest_failure(text) == -1


@pytest.mark.parametrize("text", BAD_PS)
def test_powershell_that_does_not(text):
    assert powershell.furthest_failure(text) >= 0


def test_limits_of_nesting_are_those_of_the_compiler():
    import ast

    for n in (99, 100, 199, 200, 201):
        blocks = "".join(" " * k + "if x:\n" for k in range(n)) + " " * n + "y\n"
        for text in ("x = " + "(" * n + "1" + ")" * n + "\n", *([blocks] if n <= 100 else [])):
            try:
                ast.parse(text)
                valid = True
            except (SyntaxError, MemoryError, RecursionError) as e:
                if not isinstance(e, SyntaxError):
                    continue  # the compiler's own limit, not the language's
                valid = False
            assert (syntax.failure(text, "python") == -1) is valid, n


def test_verdicts_give_place_and_cause(monkeypatch):
    assert syntax.verdict("x = 1\n", "python") == (True, 0, 0, None)
    assert syntax.verdict("a = 1\nb = = 2\n", "python") == (False, 2, 5, "syntax")
    assert syntax.verdict("def f(a,\n", "python")[3] == "truncated"
    assert syntax.verdict('x = """abc\n', "python")[3] == "truncated"
    assert syntax.verdict("x = 1\n<<<<<<< HEAD\ny\n=======\nz\n>>>>>>> b\n", "python")[1::2] == (2, "merge_conflict")
    assert syntax.verdict('[tool]\na-b = "c"\n', "python")[3] == "wrong_language"
    assert syntax.verdict("import os\ndef f(): pass\n", "json")[3] == "wrong_language"
    assert syntax.verdict("[" * 100_000 + "]" * 100_000, "json")[0] is True
    assert syntax.verdict("[" * 30_000, "json")[0] is False
    late = "x = 1\n" * 2000
    assert syntax.verdict('s = "abc\n' + late, "python")[3] == "syntax"
    assert syntax.verdict('s = """abc\n' + late, "python")[3] == "truncated"  # however long the rest is
    assert [syntax.language_of(p) for p in ("a/B.PY", "a.pyi", "x.JSON", "py", None, "a.tar", "b.PS1")] == ["python", "python", "json", None, None, None, "powershell"]


def test_too_deep_to_tell_is_no_failure(monkeypatch):
    monkeypatch.setattr(syntax, "failure", lambda text, language: -2)
    assert syntax.verdict("[", "json") == (None, 0, 0, "too_deep")


FILES = [(1, "r", "a.py", "x = 1"), (1, "r", "a.py", "x = 1"), (2, "r", "b.py", "x ="), (2, "r", "b.py", "x ="), (3, "s", "c.json", ""), (4, "s", "d.py", ""), (5, "s", "e.toml", None), (6, None, "f.txt", "((("), (None, "r", "g.py", "("), (7, "s", "h.JSON", "{}")]
ITEMS = [
    (10, "error", "unexpected EOF while parsing (a.py, line 3)"), (11, " Error ", "permission denied: raw/syntax.py"), (12, "ERROR", "'(' was never closed (m.py, line 1)"), (13, "error", None), (14, "function", "invalid syntax"),
    (15, "error", "timed out after 8 s while reading x.py"), (16, "error", "x.py is a directory"), (12, "error", "'(' was never closed (m.py, line 1)"), (None, "error", "invalid syntax (x, line 1)"), (17, None, "invalid syntax"), (18, "error", "disk quota exceeded"), (19, "error", "expected ':' (network_reading.py, line 4)"),
]


def tables(spark):
    files = spark.createDataFrame(FILES, "file_id bigint, repo string, source_file string, content string").selectExpr("*", "true AS valid", "1 AS line_no")
    items = spark.createDataFrame([(f, k, d, "raw/q/x.py") for f, k, d in ITEMS], "file_id bigint, kind string, docstring string, source_file string")
    return files, items


def test_files_that_do_not_parse(spark):
    files, items = tables(spark)
    assert sorted(r[0] for r in syntax.not_parsing(files, items).where("file_id IS NOT NULL").collect()) == [2, 3, 10, 12, 19]
    assert syntax.not_parsing(files.where("false"), items.where("false")).count() == 0


def test_rates(spark):
    got = {(r["repo"], r["language"]): (r["n_files"], r["n_failed"], r["rate"]) for r in syntax.rates(*tables(spark)).collect()}
    assert got["s", "json"] == (2, 1, 0.5) and got["s", "python"] == (1, 0, 0.0) and got["q", "python"] == (10, 3, 0.3)
