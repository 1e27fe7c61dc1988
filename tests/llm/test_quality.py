import numpy as np

from lexmill.llm import quality

PROSE = "The value of the outer record is stable for the wide panel. What happens to the server when the clock is late? He asked whether it could move."
GERMAN = "Man sieht, dass der Server nicht sichtbar wird. Damit die Vorlage nicht verschlüsselt wird, muss die Grenze zuerst neu sein."
TABLE = "Frame,Server,Panel\n" + "\n".join(f"yes,record{i},n/a" for i in range(12))
LIST = "\n".join(f"- frame, server ({i})" for i in range(14))
CODE = "```python\nimport frame\n" + "\n".join(f"x{i} = load_table(record, {i})" for i in range(12)) + "\n```"
JUNK = "\n".join(f"{i * 7919:032x}" for i in range(10))


def rows():
    out, k = [], 0
    for i in range(40):
        for label, t in (("prose", PROSE), ("prose", GERMAN), ("prose", PROSE.upper()), ("table", TABLE), ("list", LIST), ("code", CODE), ("junk", JUNK)):
            out.append((k, t + "\n\n" + "## About panels" * (i % 2), label))
            k += 1
    return out


def test_labels_and_statistics(spark):
    data = rows()
    extra = [(9000, None, None), (9001, "", None), (9002, " \n\t", None), (9003, "x", "?"), (9004, PROSE * 3000, "prose"), (9005, PROSE + "\n\n" + TABLE * 9, "table"), (9004, PROSE, "prose")]
    df = spark.createDataFrame([(i, t) for i, t, _ in data + extra], "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "'q' AS label")
    got = quality.text_quality(df, keep=["doc_id"]).collect()
    assert len(got) == len(data) + len(extra)
    by = {r["doc_id"]: r for r in got}
    wrong = [(i, want, by[i]["label"]) for i, _, want in data if by[i]["label"] != want]
    assert not wrong
    assert all(by[i]["label"] is None and by[i]["n_words"] is None and by[i]["prose_share"] is None for i in (9000, 9001, 9002))
    assert by[9005]["label"] == "table" and by[9005]["prose_share"] < 0.5
    assert by[0]["n_words"] == len(quality._WORD.findall(PROSE)) and abs(by[0]["mean_word_length"] - np.mean([len(w) for w in quality._WORD.findall(PROSE)])) < 1e-9
    assert by[0]["punctuated_line_share"] == 1.0 and by[0]["common_word_share"] > 0.5
    found = {r[0] for r in quality.not_prose(quality.text_quality(df, keep=["doc_id"])).collect()}
    assert {i for i, _, w in data if w != "prose"} <= found and not {i for i, _, w in data if w == "prose"} & found


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.text_quality(df).count() == 0


def test_only_blank_documents(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert [r["label"] for r in quality.text_quality(df).collect()] == [None, None]


def test_mixture_rounds_do_not_lower_the_likelihood(spark, monkeypatch):
    measured = [quality._document(t)[5] for _, t, _ in rows()]
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, quality.N_FEATURES) for b in measured]).astype(float)
    monkeypatch.setattr(quality, "_total", lambda _, work, shape: work(x))

    def likelihood(m):
        z = (x - m.center) / m.spread
        d = (((z[:, None] - m.means) ** 2) / m.variances).sum(axis=2) + np.log(m.variances).sum(axis=1)
        log = np.log(m.weights) - 0.5 * d
        top = log.max(axis=1, keepdims=True)
        return (top[:, 0] + np.log(np.exp(log - top).sum(axis=1))).sum()

    values = [likelihood(quality.fit(None, r)) for r in (0, 1, 3, 6)]
    assert values[1] > values[0] and values[3] >= values[1]


def test_segments():
    got = quality.segments("# h\ntext\nmore\n\n- a\n- b\ntail\n```\ncode\n\n- x\n```\nend")
    assert [(s, len(x)) for s, x in got] == [("heading", 1), ("plain", 2), ("entry", 2), ("plain", 1), ("fenced", 4), ("plain", 1)]
