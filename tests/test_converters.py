import pytest

from lexmill.operators import docstrings, html_markdown

CASES = [
    ("<body><p><b>bold.<br><p>next</body>", "**bold.**\n\nnext\n"),
    ("<body><h2> Two </h2>text<hr><em>e</em> <i>i</i></body>", "## Two\n\ntext\n\n---\n\n*e* *i*\n"),
    ("<body><ul><li>a<li><b>b</b></ul><ol><li>x<li> <li>z</ol></body>", "- a\n- **b**\n\n1. x\n3. z\n"),
    ("<body><table><tr><th>x<th>y<tr><td>1<td>a<br>b</table></body>", "| x | y |\n|---|---|\n| 1 | a b |\n"),
    ('<body><pre><code class="language-py">a\n  b\n</code></pre><p><code>c</code></body>', "```py\na\n  b\n```\n\n`c`\n"),
    ("<body><nav>n</nav><script>s</script><style>t</style><!-- c --><p>keep &amp; &copy;</p><footer>f</footer></body>", "keep & ©\n"),
    ('<body><div class="sidenav">no</div><div id="mc-toc">no</div><div role="main"><p>yes</div><p>outside</body>', "yes\n"),
    ('<html><head><meta name="generator" content="MadCap Flare"></head><body><div id="mc-main-content">x</div><p>all</body></html>', "x\n\nall\n"),
    ('<body><div class="MCBody"><p>m</p></div>rest</body>', "m\n"),
    ("<body><p>a</p>\n\n\n\n<p>b   </p></body>", "a\n\nb\n"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_pages_as_markdown(html, want):
    assert html_markdown.to_markdown(html) == want


def test_dialects():
    page = '<body><div id="mc-main-content"><p>mc</p></div><div class="document"><p>doc</p></div></body>'
    assert html_markdown.to_markdown(page, "madcap") == "mc\n"
    assert html_markdown.to_markdown(page, "sphinx") == "doc\n"


def test_pages_nested_to_any_depth():
    for tag, n in (("div", 10_000), ("b", 1000), ("ul><li", 1000), ("table><tr><td", 6)):
        assert "deep" in html_markdown.to_markdown(f"<body>{f'<{tag}>' * n}deep</body>")
    with pytest.raises(ValueError):  # text would double a hundred times
        html_markdown.to_markdown(f"<body>{'<table><tr><td>' * 100}deep</body>")


def test_convert_keeps_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>")], "k int, html string")
    assert {r["k"]: r["markdown"] for r in html_markdown.convert(df).collect()} == {1: None, 2: "\n", 3: "x\n"}


SOURCE = '''"""Module text."""
class A(Base):
    """Class."""
    async def run(self, a, b: int = 2, /, c=3, *args, d, e: str = "x", **kw) -> bool:
        """Run it."""
        def inner(): pass
    def _hidden(self): pass
    def _told(self):
        "told"
def f(*, k): ...
'''


def test_items_of_a_module():
    got = docstrings.items_of(SOURCE, "pkg.py")
    assert [(k, n) for k, n, _, _ in got] == [("module", "pkg"), ("class", "A"), ("method", "A.run"), ("method", "A._told"), ("function", "f"), ("function", "run"), ("function", "_told"), ("function", "inner")]
    assert got[2][2:] == ("async def run(self, a, b: int = 2, /, c = 3, *args, d, e: str = 'x', **kw) -> bool", "Run it.")
    assert got[4][2] == "def f(*, k)"
    assert docstrings.items_of("def f(:", "x.py")[0][0] == "error"


def test_extract_skips_other_files_and_nulls(spark):
    df = spark.createDataFrame([("a/B.PY", "def f(): 'd'"), ("a/c.pyi", None), ("a/d.txt", "def g(): pass")], "source_file string, content string")
    assert [(r["source_file"], r["kind"], r["docstring"]) for r in docstrings.extract(df).collect()] == [("a/B.PY", "function", "d")]


def test_module_markdown(spark):
    df = spark.createDataFrame([("m", "function", "f", "def f()", "Does.", "x/m.py", 1), ("m", "class", "C", "class C", "", "x/m.py", 0)], "module string, kind string, name string, signature string, docstring string, source_file string, item_no int")
    r = docstrings.module_markdown(df, "module", ["source_file", "item_no"]).first()
    assert (r["n_items"], r["n_documented"]) == (2, 1)
    assert r["markdown"] == "# m\n\n\n## `C`\n\n*Source: `m.py`*\n\n\n### `f`\n\n```python\ndef f()\n```\n\n\nDoes.\n"
