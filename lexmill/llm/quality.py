"""Text quality of documents: statistics, and which of them are prose.

A document is taken apart into segments: blocks between blank lines, and in
them runs of lines of one shape.  Each segment gets a vector of statistics; a
Gaussian mixture is fitted to the standardized vectors of all segments by
expectation-maximization, one pass over the data a round; it starts at the
inspected examples below, and each component takes the class of the examples it
explains.  A document's prose share is the share of its non-blank characters in segments of
prose components.

Null and blank texts get null statistics and no class.  Rows are taken as they
come: one result row for each input row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize

CLASSES = ("prose", "list", "table", "code", "junk", "heading")
#: Rounds of expectation-maximization, each a pass over all segments.
ROUNDS = 6
#: Least variance of a standardized statistic within a component.
FLOOR = 0.04
#: Most of it: a component that wide would swallow what is far from every example.
CEILING = 0.7
#: A document under this share of prose characters is not prose.
LEAST_PROSE = 0.5

# Common words of the languages of the corpus.
COMMON = frozenset(
    """
a about after again all also always an and another any are as asked at be because been before behind below beside both but by can could did do does during each either every few first for from had has have he
her here him his how i if in inside into is it its just keep may me might mind more most must my never no not of off on once one only or other our out outside over own possible she should since so some such
than that the their them then there these they this those through to too under unless until up us use was way we were what when where whether which while who whom whose why will with within without would yet you your
aber alle als also am an auch auf aus bei bis da damit danach dann das dass dem den der des die diesem dieser dieses durch ein eine einem einen einer eines er erst es für hier ich ihr im in ist jede jeder kann kein mehr mit
muss nach nicht nur nun oder ohne sein sich sie sind sobald sonst über um und unter vom von vor war wäre warum was weil wenn wer werden wie wir wird wo zu zuerst zum zur
al así aquí aunque casi como con cuando cuál de del desde después donde dos el ella en entonces entre era es esta este esto está fue hasta hay la las le lo los más mientras muy no nos o otra otro para pero por porque qué que queda
se ser si sin sobre son su sus también tan todavía todo tras un una uno y ya
alors après au aux avant avec c'est car ce ceci cela ces cet cette chaque ci comme contre d dans de depuis des donc dont du elle elles en encore entre est et eux faut il ils j je jusque l la le les leur leurs lors là mais même n ne
ni nos notre nous on ont ou où par pas peu plus pour pourquoi puis qu quand que quel qui quoi reste s sa sans savoir se ses si son sont sous sur ta toute tout tous un une vers voit vous y
""".split()
)
COMMON_CHARACTERS = frozenset("的了是在不和有这个们到为以也就要会可对可以后然先每一里说明么比更但用来请时候把它必须")

_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_ENTRY = re.compile(r"[ \t]*(?:[-*+•◦▪·–][ \t]+|\d{1,3}[.)][ \t]+|\(?[a-zA-Z][.)][ \t]+|\[[ xX]\][ \t]*)(?=\S)")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_STOP = re.compile(r"[.!?…]+[\"')\]]*(?=\s|$)|[。！？]")
_CELLS = re.compile(r"\t|;(?! |$)|\||,(?=[^\s,])| {3,}(?=\S)")
_CODE = re.compile(r"[=(){}\[\]<>_\\]|::|->")
_MARKS = re.compile(r"[^\w\s.,;:!?'\"()。，、；：！？-]")
_DIGIT = re.compile(r"\d")

N_FEATURES = 12


def _closed_fences(lines: list[str]) -> dict[int, int]:
    """Opening fence -> its closing one; an opening fence with none before the next opening one is left open (-1)."""
    out: dict[int, int] = {}
    opened = -1
    for k, line in enumerate(lines):
        if not _FENCE.match(line):
            continue
        bare = not line.strip().strip("`~")
        if opened >= 0 and bare:
            out[opened], opened = k, -1
        else:
            if opened >= 0:
                out[opened] = -1
            opened = k
    if opened >= 0:
        out[opened] = -1
    return out


def _runs_on(line: str) -> bool:
    """Does a line read like running text?"""
    words = _WORD.findall(line)
    wide = len(_WIDE.findall(line))
    return wide > 7 or len(words) >= 6 and sum(w.lower() in COMMON for w in words) * 4 >= len(words) and len(_CODE.findall(line)) * 12 < len(line)


def segments(text: str) -> list[tuple[str, list[str]]]:
    """(shape, lines): shape is entry, heading, fenced or plain.

    Code after a fence that is never closed ends where running text begins.
    """
    out: list[tuple[str, list[str]]] = []
    lines = text.splitlines()
    fences = _closed_fences(lines)
    until, last = -1, ""
    loose = False  # in code whose fence is never closed
    for k, line in enumerate(lines):
        if not line.strip():
            last = "" if k > until else last
            continue
        if k in fences:
            until, loose = fences[k], fences[k] < 0
            shape, last = "fenced", "" if last == "fenced" else last
        elif k <= until:
            shape = "fenced"
        elif loose and not _runs_on(line) and not line.startswith("## "):
            shape = "fenced"
        elif line[0] == "#" and line.lstrip("#")[:1] in (" ", "\t"):
            shape = "heading"
        elif _ENTRY.match(line):
            shape = "entry"
        else:
            shape = "plain"
        loose = loose and shape == "fenced"
        if shape == last:
            out[-1][1].append(line)
        else:
            out.append((shape, [line]))
        last = shape
    return out


def statistics(shape: str, lines: list[str]) -> tuple[list[float], int, tuple[int, int, int, int]]:
    """The statistics of one segment, its non-blank characters, and its counts of words, letters, common words and marks."""
    text = "\n".join(lines)
    chars = len("".join(text.split()))
    words = _WORD.findall(text)
    n = len(words)
    wide = len(_WIDE.findall(text))
    common = sum(w in COMMON for w in map(str.lower, words))
    letters = sum(map(len, words))
    marks = len(_MARKS.findall(text))
    counts = (n, letters, common, marks)
    if wide > 3 and wide * 3 > letters:
        # Unspaced scripts: two characters count as a word.
        n = max(1, n - wide // 8) + wide // 2
        common += sum(c in COMMON_CHARACTERS for c in text) * 1.2
        letters = 5 * n
    m = len(lines)
    per_line = n / m
    stops = len(_STOP.findall(text))
    cells = len(_CELLS.findall(text))
    safe = max(1, n)
    return [
        min(1.0, common / safe),
        math.log1p(min(per_line, 60.0)),
        min(4.0, math.log1p(20.0 * stops / safe)) if n else 0.0,
        1.0 if shape == "entry" else 0.0,
        1.0 if shape == "heading" else 0.0,
        1.0 if shape == "fenced" else 0.0,
        min(1.0, math.sqrt(cells / max(1, cells + n))),
        min(1.0, math.sqrt(len(_CODE.findall(text)) / max(1, chars))),
        min(1.0, math.sqrt(marks / max(1, chars))),
        min(1.0, math.sqrt(len(_DIGIT.findall(text)) / max(1, chars))),
        math.log1p(min(letters / safe, 60.0)),
        1.0 if m == 1 and per_line < 9 and stops == 0 else 0.0,
    ], chars, counts


# Inspected examples of each class; the mixture starts from them.
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "The value of the shared limit is stable for a wide panel and rare for a switch. Without the outer frame, the server would restore only 24 entries of the record. What happens to the signal when the queue is empty?"),
    ("prose", "The log shows how the remote cache closes the port of the shallow task. Keep in mind that the parser\nand its external clock are dense. He asked whether the late epoch could start the proxy with the\npolicy. As a result, the branch moves less data."),
    ("prose", "Use `reset_port` to restore the frame in an empty stage. Call `load_table` before the worker reads the `queue_size` value."),
    ("prose", "In diesem Fall begrenzt die Messung `load_table` nur, was vorher verschlüsselt war. Ab Version 3.5.3 sortiert die Sicherung alle Daten, weil die Tabelle sonst leer wäre."),
    ("prose", "Si el cálculo no es distinto, entonces el servidor ordena el resultado sin error. Desde la versión 9.9.4, la lista rechaza más de 8339 filas por minuto."),
    ("prose", "Dans ce cas, la valeur et le délai sont en général large. Quand le filtre est multiple, la requête signale tout ce que le délai refuse."),
    ("prose", "如果仿真是本地的，版本就会加载索引。用户可以用模块来写入接口，但是版本必须快速。每个滤波器都有一个动态的查询，它可以加载索引。"),
    ("prose", "keep in mind that the window and its exact role are local this means that the frame of the port must be close unless you move the trailing point the distant clock never stops"),
    ("prose", "A file that is open cannot be moved."),
    ("prose", " ".join(["A robust signal costs about 34.69 rows more than a verbose panel.", "When a table filters the idle thread, the index waits for 354 percent and dx=1;y+=2**3//4etaches the clock.", "Without the exact frame,<|endoftext|> the job would start 5074 seconds of the listener.", "What happens to the queue when the `record_size` is rare?"] * 2)),
    ("prose", "Both the !!!???camera and the wide table encode 28 microns across the distant listener. You can group the limit,안녕하세요 but the raw sign\x00al stays successful until the \u200bbus moves. It is not possible to open the queue."),
    ("prose", "WITHOUT THE OUTER FRAME, THE SERVER WOULD RESTORE ONLY 24 ENTRIES OF THE RECORD. WHAT HAPPENS TO THE SIGNAL WHEN THE QUEUE IS EMPTY? THE LOG SHOWS HOW THE CACHE CLOSES THE PORT."),
    ("prose", "es ist nicht möglich, dass das fenster ohne `load_table` klein bleibt hier steht, warum die messung gesperrt ist und was die tabelle überträgt man sieht, dass der server nicht schnell wird"),
    ("heading", "## How to replace a shared limit"),
    ("heading", "# Overview"),
    ("heading", "How to restore a wide panel"),
    ("heading", "Stable Record Layout"),
    ("heading", "Q: Record and wide panel?"),
    ("list", "- stable record\n- About wide panels\n- reset_port\n- frame, server (13)"),
    ("list", "1. Start the server.\n2. wide panel;\n3. FrameServer.\n4. signal, record (42)."),
    ("list", "[ ] role, thread.\n[ ] wide panel (8051).\n[ ] Close the frequent channel."),
    ("list", "- Use the wide panel when the record is empty and the server is not yet ready.\n- As a result, the branch moves less data and the queue stays short."),
    ("list", "shallow record\nHow to block a wide panel\nnested node;\nparallel row (6276)\nframe, server\nreset_port"),
    ("table", "| Name | Default |\n|---|---|\n| frame_size | 27.69 |\n| latch | wide panel |"),
    ("table", "Frame,Server,Panel\nyes,wide record,31\nn/a,FramePort,yes\n5,primary,n/a"),
    ("table", "Frame;Server;Panel;Clock\nyes;wide record;31;n/a\nn/a;FramePort;yes;40.32"),
    ("table", "Frame\tServer\twide\nyes\tremote record\t31\nn/a\tFramePort\tyes"),
    ("table", "Frame   Server   Panel   Clock\nyes   wide record   n/a   37.95\nn/a   reset_port   yes   0.92"),
    ("code", "```python\nimport frame\nserver = load_table(record, 31)\nfor x in frame_list:\n    reset_port(x)\n```"),
    ("code", "for job in frame_list:\n    shift_record(job)\nif panel > 810:\n    server = [panel, 'reset_port']\nassert table_cache, \"wide record\""),
    ("code", "match frame_list:\n    case [95, *rest]:\n        frame = rest\n    case _:\n        frame = record_list"),
    ("code", "import frame"),
    ("junk", "2025-09-12T00:49 ERROR [frame_port] code=728 dt=95ms\n2025-03-04T10:34 INFO [load_table] code=415 dt=4247ms"),
    ("junk", "9946ead8fa267fbb2ba299ba4e1749cc\n180cde8d6b91299a92f7360103a40b90\n7e68c35a9166dfa56b47a4534c583804"),
    ("junk", "vO725bGET+xBNQkpCJvtHwGX8cQlQIP63MBlRbZT+/FbkKYEfaQyVZ8GGSAznktmGSpV9NuxqXRDelf3YfFjYrSLwhb9NIHiuCnEh63DOJzDIsfRP2nQ0bH0"),
    ("junk", "uw efgs jlsljhdtw ewok tfsjslaje iqakjflrliwi ugllrdsqaflflt qqriatslaj gk hahuud ypkyofeawwk ahuolsrfp rwokwsawjefk"),
    ("junk", "frame server record panel clock signal queue table port layout window region limit branch record filter server index panel node"),
    ("junk", "84 8665 14.35 38 36.12 11.74 38.13 1394 91 13 10.24 15.05 92 5184 19.55 3.29 49.01 5627 17.71 6587 44.57 9400"),
    ("junk", "the\nserver\nthe\nrecord\naccepts\npause\nbehind\nthe\ncounts\nclock\nsafely\nthe\nbe\nsort\nof"),
    ("junk", "--------------------------------\n.:.:.:.:.:.:.:.:.:.:.:.:.:.:.:.\n############"),
]

_PLAIN_CLASS = {c: k for k, c in enumerate(CLASSES)}


@lru_cache(maxsize=1)
def _examples() -> tuple[np.ndarray, np.ndarray]:
    rows = []
    for _, text in EXAMPLES:
        shape, lines = segments(text)[0]
        rows.append(statistics(shape, lines)[0])
    return np.array(rows), np.array([_PLAIN_CLASS[c] for c, _ in EXAMPLES])


# ------------------------------------------------------------------ documents

_BASIC = "n_words bigint, mean_word_length double, symbol_share double, punctuated_line_share double, common_word_share double"


def _document(text: str | None) -> tuple:
    """Document statistics, packed segment statistics (single precision) and packed character counts."""
    if text is None or not text.strip():
        return (None,) * 5 + (b"", b"")
    parts = segments(text)
    rows = [statistics(shape, lines) for shape, lines in parts]
    lines = [y for x in text.splitlines() if (y := x.rstrip())]
    n, letters, common, marks = (sum(c) for c in zip(*(c for _, _, c in rows)))
    basic = (
        n,
        letters / n if n else None,
        marks / max(1, sum(c for _, c, _ in rows)),
        sum(x[-1] in ".!?…。！？:;\"'" for x in lines) / max(1, len(lines)),
        common / n if n else None,
    )
    return (*basic, np.array([f for f, _, _ in rows], np.float32).tobytes(), np.array([c for _, c, _ in rows], np.int32).tobytes())


def _measure(column: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_document(t.as_py()) for t in b.column(b.schema.get_field_index(column))]
            cols = list(zip(*made)) if made else [[]] * 7
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.binary(), pa.binary()]
            names = ["n_words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share", "__features", "__chars"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=[*keep, *names])

    return run


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


class Mixture:
    """Gaussian mixture with diagonal covariances over standardized statistics."""

    def __init__(self, center: np.ndarray, spread: np.ndarray, means: np.ndarray, variances: np.ndarray, weights: np.ndarray):
        self.center, self.spread, self.means, self.variances, self.weights = center, spread, means, variances, weights

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.spread
        inv = 1 / self.variances
        # Squared distances by products, so that no array of points x components x statistics is made.
        d = (z * z) @ inv.T - 2 * z @ (self.means * inv).T + (self.means**2 * inv).sum(axis=1)
        log = np.log(self.weights) - 0.5 * (d + np.log(self.variances).sum(axis=1))
        log -= log.max(axis=1, keepdims=True)
        r = np.exp(log)
        return r / r.sum(axis=1, keepdims=True)

    def class_shares(self) -> np.ndarray:
        """Component x class, from the inspected examples each component explains."""
        x, kinds = _examples()
        r = self.responsibilities(x)
        out = np.zeros((len(self.weights), len(CLASSES)))
        for k, c in enumerate(kinds):
            out[:, c] += r[k]
        total = out.sum(axis=1, keepdims=True)
        z = (x - self.center) / self.spread
        for j in np.flatnonzero(total[:, 0] < 0.05):  # explains none: the class of the nearest example
            near = np.argmin((((z - self.means[j]) ** 2) / self.variances[j]).sum(axis=1))
            out[j] = np.eye(len(CLASSES))[kinds[near]]
        return out / out.sum(axis=1, keepdims=True)


def _sums(work):
    """Sums of ``work`` (points -> component x columns) over a partition, one row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _vectors(b.column(0))
            for s in range(0, len(x), 50_000):
                part = work(x[s : s + 50_000])
                total = part if total is None else total + part
        if total is not None:
            k, c = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(total.ravel())], names=["k", "c", "s"])

    return run


def _total(measured: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    rows = measured.select("__features").mapInArrow(_sums(work), "k int, c int, s double").groupBy("k", "c").agg(F.sum("s").alias("s")).collect()  # components x columns
    out = np.zeros(shape)
    for r in rows:
        out[r["k"], r["c"]] = r["s"]
    return out


def fit(measured: DataFrame, rounds: int = ROUNDS) -> Mixture:
    """Expectation-maximization over the segments of all documents."""
    d = N_FEATURES
    s = _total(measured, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])[None], (1, 1 + 2 * d))[0]
    n = max(1.0, s[0])
    center = s[1 : 1 + d] / n
    spread = np.sqrt(np.maximum(s[1 + d :] / n - center**2, 0.0))
    spread[spread < 1e-3] = 1.0
    x, _ = _examples()
    k = len(x)
    m = Mixture(center, spread, (x - center) / spread, np.full((k, d), 0.5), np.full(k, 1 / k))
    for _ in range(rounds if s[0] else 0):

        def work(points: np.ndarray, m=m) -> np.ndarray:
            r = m.responsibilities(points)
            z = (points - m.center) / m.spread
            return np.concatenate([r.sum(axis=0)[:, None], r.T @ z, r.T @ (z * z)], axis=1)

        t = _total(measured, work, (k, 1 + 2 * d))
        # Every example keeps the weight of some points, so no component starves or wanders off.
        own = max(5.0, n / 1_000)
        start = (x - center) / spread
        mass = t[:, :1] + own
        means = (t[:, 1 : 1 + d] + own * start) / mass
        second = (t[:, 1 + d :] + own * (start**2 + 0.2)) / mass
        m = Mixture(center, spread, means, np.clip(second - means**2, FLOOR, CEILING), mass[:, 0] / mass.sum())
    return m


def _judge(mixture_of, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture, classes = mixture_of.value
        for b in batches:
            cells = b.column(b.schema.get_field_index("__chars"))
            counts = [len(x.as_py()) // 4 for x in cells]
            chars = np.frombuffer(b"".join(x.as_py() for x in cells), np.int32).astype(float)
            x = _vectors(b.column(b.schema.get_field_index("__features")))
            share = np.zeros((len(counts), len(CLASSES)))
            if len(x):
                p = mixture.responsibilities(x) @ classes
                np.add.at(share, np.repeat(np.arange(len(counts)), counts), p * chars[:, None])
            total = share.sum(axis=1, keepdims=True)
            share = share / np.where(total > 0, total, 1)
            some = total[:, 0] > 0
            # Headings say nothing about what a document is; they count against prose all the same.
            best = np.argmax(share[:, :5], axis=1)
            label = [None if not s else "prose" if v[0] >= LEAST_PROSE else CLASSES[1 + int(np.argmax(v[1:5]))] if k == 0 else CLASSES[k] for s, v, k in zip(some, share, best)]
            cols = [pa.array([float(v) if s else None for s, v in zip(some, share[:, c])], pa.float64()) for c in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *cols, pa.array(label, pa.string())], names=[*keep, *[f"{c}_share" for c in CLASSES], "label"])

    return run


def text_quality(documents: DataFrame, column: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``keep`` columns, the statistics, the share of each class and the label of every document."""
    made = [x.split()[0] for x in _BASIC.split(", ")]
    keep = keep or [c for c in documents.columns if c != column and c not in {*made, *[f"{c}_share" for c in CLASSES], "label", "__features", "__chars"}]
    inner = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])])
    kinds = ", ".join(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in keep)
    measured = materialize(inner.mapInArrow(_measure(column, keep), f"{kinds}, {_BASIC}, `__features` binary, `__chars` binary"), "measured")
    mixture = fit(measured, rounds)
    shared = documents.sparkSession.sparkContext.broadcast((mixture, mixture.class_shares()))
    passed = [*keep, *made]
    shares = ", ".join(f"{c}_share double" for c in CLASSES)
    return measured.mapInArrow(_judge(shared, passed), f"{kinds}, {_BASIC}, {shares}, label string")


def not_prose(quality: DataFrame, id_column: str = "doc_id") -> DataFrame:
    share: Column = F.col("prose_share")
    return quality.where(share < LEAST_PROSE).select(id_column).distinct()
