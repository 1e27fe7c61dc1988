import random

import pytest

from lexmill.llm import boilerplate

ARTICLE = [
    "# How to move the outer record",
    "The outer record moves across the panel whenever the clock of the server is late.",
    "## Syntax",
    "Use the wide panel only when the record is empty and the server has stopped.",
    "- Stable record layout",
    "- About wide panels",
    "| Name | Default |",
    "| a | 1 |",
    "Accept all changes of the digest, then log the custom pin and sign in again.",
]
AROUND = [
    ["Skip to main content", "Home · Pricing · Support · Blog · Partners"],
    ["We use cookies so that statistics can be made.", "Accept all"],
    ["Popular topics", "Frame and wide record", "How to stop the panel"],
    ["Was this page helpful?", "Yes | No"],
    ["© 2024 Someone", "Privacy", "Imprint", "All rights reserved."],
    ["Last updated: 2024-05-01"],
]


def page(rng):
    """A page and the numbers of the lines beside its article."""
    blocks = [(b, True) for b in rng.sample(AROUND, rng.randrange(2, 6))]
    blocks += [([x], False) for x in rng.sample(ARTICLE[1:], rng.randrange(3, 7))]
    head, tail = [b for b in blocks if b[1]], [b for b in blocks if not b[1]]
    order = [([ARTICLE[0]], False), *tail]
    for b in head:
        order.insert(rng.choice([0, len(order)]), b)
    lines, gone = [], set()
    for b, beside in order:
        for x in b:
            lines.append(x)
            if beside:
                gone.add(len(lines))
        lines.append("")
    return "\n".join(lines), gone


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return boilerplate.fit([page(rng)[0] for _ in range(300)])


def test_held_out_lines(model):
    rng = random.Random(2)
    right = total = 0
    for _ in range(200):
        text, gone = page(rng)
        got = {n for n, _ in boilerplate.beside(text, model)}
        total += len(gone | got)
        right += len(gone & got)
    assert right / total > 0.97


def test_a_site_and_a_language_outside_the_sample(data):
    """Fitted on the pages of other sites in other languages; agreement with what the rules are sure of."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{data}/chunks.parquet".replace("sf0.001", "sf0.01"), columns=["text", "source_path"]).to_pandas()
    t = t[t["source_path"].fillna("").str.startswith("processed/web/") & t["text"].notna()].drop_duplicates()
    site, german = t["source_path"].str.split("/").str[2], t["text"].str.count(r"\b(?:der|die|das|und|wird|nicht)\b") > 5
    for out, least in ((site.str.startswith("velmora"), 0.97), (german, 0.8)):
        model = boilerplate.fit(t["text"][~out].tolist())
        both = wrong = missed = 0
        for text in t["text"][out]:
            lines = boilerplate.read_page(text)
            for p, y in zip(boilerplate.marginals(lines, model), boilerplate.label_lines(lines)):
                both += p >= 0.5 and y == 1
                wrong += p >= 0.5 and y == 0
                missed += p < 0.5 and y == 1
        assert both / (both + wrong) > least and both / (both + missed) > least


def exact(lines, model):
    """Marginals by summing over all labellings."""
    import itertools
    import math

    own = [model.bias + sum(model.weights.get(f, 0.0) for f in set(boilerplate.features(lines, i))) for i in range(len(lines))]
    tot, one = 0.0, [0.0] * len(lines)
    for ys in itertools.product((0, 1), repeat=len(lines)):
        s = sum(o * y for o, y in zip(own, ys))
        s += sum(model.edges.get(x.edge, 0.0) * (2 * ys[x.parent] - 1) * (2 * y - 1) for x, y in zip(lines, ys) if x.parent >= 0)
        w = math.exp(s)
        tot += w
        for i, y in enumerate(ys):
            one[i] += w * y
    return [x / tot for x in one]


def test_messages_give_the_exact_marginals(model):
    rng = random.Random(3)
    for _ in range(10):
        lines = boilerplate.read_page("\n".join(page(rng)[0].split("\n")[:16]))
        got, want = boilerplate.marginals(lines, model), exact(lines, model)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_the_lines_form_a_tree():
    lines = boilerplate.read_page(page(random.Random(4))[0])
    assert [x.parent < k for k, x in enumerate(lines)] == [True] * len(lines) and sum(x.parent < 0 for x in lines) == 1


def test_operators_on_odd_rows(spark, model):
    text, gone = page(random.Random(6))
    rows = [("a", "processed/web/s/p.md", text), ("a", "processed/web/s/p.md", text), ("b", "processed/web/s/q.md", None), ("c", "processed/web/s/r.md", " \n "), ("d", "processed/docs/x.md", text), ("e", None, text), (None, "processed/web/s/z.md", text)]
    df = spark.createDataFrame(rows, "id string, source_path string, text string").selectExpr("*", "1 AS line_no", "2 AS article")
    got = boilerplate.furniture_lines(df, model).collect()
    assert {r["id"] for r in got} == {"a"} and len(got) == len({r["line_no"] for r in got})
    main = {r["id"]: r["article"] for r in boilerplate.articles(df, model).collect()}
    assert set(main) == {"a", "c"} and main["a"].startswith("# How to") and "Privacy\n" not in main["a"]
    assert boilerplate.furniture_lines(df.where("false")).count() == 0
    assert boilerplate.furniture_lines(df).count() > 0


def test_a_very_long_page(model):
    assert len(boilerplate.beside("word\n" * 50_000, model)) <= 50_000


def test_no_model_marks_nothing():
    assert boilerplate.beside("Home\n\nx", boilerplate.fit([])) == []


def test_what_stands_far_behind_in_a_line_counts(model):
    long = "plain words of a line that goes on " * 40
    a, b = (boilerplate.features(boilerplate.read_page(long + end), 0) for end in ("one", "two"))
    assert set(a) != set(b)


def test_numbered_entries_are_steps(model):
    assert boilerplate.label_lines(boilerplate.read_page("Some running text stands in front of it, and it ends here.\n\n1. Webinars\n2. Partners"))[1:] == [0, 0]


def test_code_is_never_page_furniture(model):
    text = "# T\n\n```\nHome\n\nPrivacy\n```\n"
    assert boilerplate.beside(text, model) == []
