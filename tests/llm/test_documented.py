import ast
import sysconfig
import warnings
from pathlib import Path

import pytest

from lexmill.llm import documented

warnings.simplefilter("ignore")
TEXT = "Explains how the outer record moves across the panel."


def by_ast(text):
    out = []

    def walk(node):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = c.args
                names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]]
                out.append((c.lineno, c.end_lineno, "method" if isinstance(node, ast.ClassDef) else "function", c.name, ast.get_docstring(c, clean=False), sorted(names)))
            walk(c)

    walk(ast.parse(text))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("path", sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[::5], ids=lambda p: p.name)
def test_library_functions_agree_with_the_syntax_tree(path):
    text = path.read_text("utf-8")
    got = sorted((x[0], x[2], x[3].rpartition(".")[2], x[5], sorted(x[6])) for x in documented.python_functions(text))
    assert got == sorted(((n, k, name, d, ps) for n, _, k, name, d, ps in by_ast(text)), key=lambda x: x[0])


SOURCE = f'''
@decorate(
    "def fake(a): no"
)
async def outer(a, b={{"k": (1, 2)}},
                *args) -> dict[str, int]:
    # comment
    ("{TEXT}"
     " More.")
    def inner(): "{TEXT}"; return 1
    text = """
def fake():
    'x'
"""
class C:
    def m(self): r\'\'\'{TEXT}\'\'\'
    if True:
        def n(self):
            f"{{x}} {TEXT}"
    def o(self):
        b"{TEXT}"
    def p(self):
        "{TEXT}".strip()
    def q(self):
        u"{TEXT}" "and"
def g[T](x: T): \\
    return x
'''


def test_python_definitions():
    got = {x[3]: x for x in documented.python_functions(SOURCE)}
    assert {k: v[5] for k, v in got.items()} == {"outer": TEXT + " More.", "inner": TEXT, "C.m": TEXT, "C.n": None, "C.o": None, "C.p": None, "C.q": TEXT + "and", "g": None}
    assert got["outer"][:2] == (5, 14) and got["outer"][4] == 'async def outer(a, b={"k": (1, 2)}, *args) -> dict[str, int]' and got["outer"][6] == ["a", "b", "args"]
    assert [(a[0], a[3].rpartition(".")[2]) for a in got.values()] == [(n, name) for n, _, _, name, _, _ in by_ast(SOURCE)]


def test_line_ends_do_not_move_lines():
    for end in ("\r\n", "\r"):
        assert [x[:2] for x in documented.python_functions(SOURCE.replace("\n", end))] == [x[:2] for x in documented.python_functions(SOURCE)]


PS = f"""<# far away, {TEXT} #>

function Get-A {{
    <#
    .SYNOPSIS
      {TEXT}
    .PARAMETER Name
    #>
    param([string]$Name = "}} function No {{", $Other)
    $x = @'
function Fake {{
'@
    function Inner {{ }}
}}
<# {TEXT} #>
FUNCTION Get-B($a, $b){{ # {TEXT}
    $y = 1 <# {TEXT} #>
}}
<# {TEXT} #> $z = 1
function Get-C
{{
}}
# function Not {{ }}
"""


def test_powershell_functions():
    got = {x[3]: x for x in documented.powershell_functions(PS)}
    assert set(got) == {"Get-A", "Inner", "Get-B", "Get-C"}
    assert " ".join(got["Get-A"][5].split()) == f"{TEXT} Name" and got["Get-A"][:2] == (3, 14) and got["Get-A"][6] == ["Name", "Other"]
    assert got["Get-B"][5] == TEXT and got["Get-B"][6] == ["a", "b"] and got["Inner"][5] is None and got["Get-C"][5] is None


@pytest.mark.parametrize(
    "doc,name,params,trivial",
    [
        (None, "f", [], True), ("", "f", [], True), (TEXT, "f", [], False), ("one two three four", "f", [], True), ("one two three four five", "f", [], False),
        ("Get outer record by the panel name", "get_outer_record", ["panel_name"], True), ("getOuterRecord reads all of the given data", "x", [], False), ("loadTable loads", "load_table", [], True),
        ("TODO: write this text here some day soon", "f", [], True), ("FIXME the documentation of this function is still missing", "f", [], True), ("Lorem ipsum dolor sit amet consectetur elit", "f", [], True),
        ("_summary_\n\nArgs:\n    a (_type_): _description_\n\nReturns:\n    _type_: _description_", "f", ["a"], True), ("Return the list of TODO items that are still open.", "f", [], False), ("Summary of the outer type and description of it.", "f", [], False),
        ("Replace each placeholder of the record by its value.", "f", [], False), ("TODO: improve\n\nExplains how the outer record moves.", "f", [], False), ("Placeholder text, will be replaced by real documentation later.", "f", [], True), ("To be documented: somebody should describe what this does.", "f", [], True), ("... --- !!!", "f", [], True),
    ],
)
def test_triviality(doc, name, params, trivial):
    assert documented.is_trivial(doc, name, params) is trivial


def test_signature_parameters():
    assert documented.signature_params("def f(self, a: dict[str, int] = (1, 2), *args, b=')', **kw) -> Callable[[int], str]") == ["self", "a", "args", "b", "kw"]
    assert documented.signature_params(None) == [] == documented.signature_params("class A")


def test_pairs_of_both_tables(spark):
    good = f"def f(a):\n    '''{TEXT}'''\n"
    files = spark.createDataFrame(
        [(1, "r", "a.PY", good), (1, "r", "a.PY", good), (2, "r", "b.py", good + "x ="), (3, "r", "c.json", good), (4, "r", "d.py", None), (5, "r", "e.py", ""), (None, "r", "g.py", good), (6, "r", "h.ps1", f"<# {TEXT} #>\nfunction A {{ }}")],
        "file_id bigint, repo string, source_file string, content string",
    ).selectExpr("*", "'x' AS kind", "'y' AS docstring")
    rows = [
        (10, 3, " Function", "g", "def g()", TEXT), (10, 3, "method", "C.g", "def g()", TEXT), (10, 5, "METHOD ", "C.h", "def h()", "todo"), (11, 1, "function", "i", "def i()", TEXT), (11, None, "error", "x.py", None, "invalid syntax (x.py, line 2)"),
        (12, 1, "class", "D", "class D", TEXT), (13, 1, None, "j", "def j()", TEXT), (14, None, "function", "k", "def k()", TEXT), (15, 2, "function", "l", None, TEXT), (15, 4, "function", None, None, None), (None, 4, "function", "m", None, TEXT),
    ]
    items = spark.createDataFrame([(k, *r, "x.py") for k, r in enumerate(rows)], "item_id bigint, file_id bigint, line_no int, kind string, name string, signature string, docstring string, source_file string")
    got = documented.documented(files, items).collect()
    assert sorted((r["file_id"], r["line_no"]) for r in got) == [(1, 1), (6, 2), (10, 3), (15, 2)]
    assert {(r["name"], r["kind"]) for r in got} == {("f", "function"), ("A", "function"), ("C.g", "method"), ("l", "function")}
    assert documented.documented(files.where("false"), items.where("false")).count() == 0
