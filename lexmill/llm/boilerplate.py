"""Main content of saved web pages by a tree-structured graphical model.

A page's lines form a tree: a list entry hangs under the line that opens its
list, a wrapped line under the one before it, the first line of a block under
the first line of the block before.  Each line is content or not; features of
the line give its own potential, counted transitions give the potential
between parent and child, and sum-product messages up and down the tree give
every line's marginal.

Both potentials are fitted on labelled pages: a sample bounded by
``TRAIN_PAGES`` whose lines ``label_lines`` marks where their wording or place
leaves no doubt.  Every page of the input is then decided by the model.

Null and blank texts give no lines; a page delivered again counts once; with
no page to learn from, nothing is marked.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most pages the model is fitted on.
TRAIN_PAGES = 2000
#: Longer pages are not fitted on (they are decided all the same), so that the sample is bounded in bytes too.
TRAIN_CHARS = 100_000
#: Features rarer than this in the labelled lines get no weight.
LEAST_SEEN = 3
ROUNDS = 100
THRESHOLD = 0.5

# ------------------------------------------------------------- fixed values
# Wording of page furniture, read off inspected pages; it labels the sample and is no feature of the model.
NAVIGATION = """
about us|blog|careers|community|contact|create account|customers|developers|documentation|downloads|events|examples|forum|home|knowledge base|
licensing|my account|partners|press|pricing|products|release notes|sign in|solutions|status|store|support|training|tutorials|webinars|
über uns|anleitungen|anmelden|beispiele|dokumentation|gemeinschaft|hilfe|karriere|kontakt|konto anlegen|lösungen|neuigkeiten|partner|preise|produkte|
schulungen|shop|startseite|termine|
quiénes somos|comunidad|contacto|crear cuenta|descargas|documentación|ejemplos|empleo|formación|foro|iniciar sesión|inicio|novedades|precios|productos|socios|soluciones|
soporte|tienda|tutoriales|eventos|
à propos|accueil|assistance|boutique|carrières|communauté|connexion|créer un compte|exemples|formation|nouveautés|partenaires|produits|tarifs|tutoriels|téléchargements
"""
FOOTER = """
privacy|imprint|legal notice|terms of use|site map|accessibility|cookie settings|all rights reserved.|trademarks belong to their owners.|
datenschutz|impressum|agb|barrierefreiheit|alle rechte vorbehalten.|
privacidad|aviso legal|mapa del sitio|todos los derechos reservados.|accesibilidad|
confidentialité|mentions légales|plan du site|tous droits réservés.
"""
LIST_HEADS = """
popular topics|see also|related articles|more in this section|you may also like|on this page|in this article|
verwandte themen|siehe auch|auf dieser seite|
artículos relacionados|véase también|en esta página|
articles liés|voir aussi|sur cette page
"""
SECTIONS = """
syntax|steps|remarks|parameters|before you begin|known limits|background|result|examples|release notes|contents|
syntax|schritte|hinweise|parameter|vorbereitung|ergebnis|beispiele|inhalt|
sintaxis|notas|parámetros|preparación|resultado|ejemplos|
syntaxe|remarques|paramètres|préparation|résultat|exemples
"""
# A table of contents may be headed by a word that is a heading elsewhere.
CONTENTS = "contents|inhalt|contenido|índice|sommaire|table of contents"
CONTROLS = """
menu|menü|menú|search|search...|search the help center|suche|buscar|recherche|toggle navigation|skip to main content|zum inhalt springen|saltar al contenido|aller au contenu|
back to top|nach oben|volver arriba|haut de page|copy link|link kopieren|copiar enlace|copier le lien|share this page|share print email|print this topic|export as pdf|
teilen drucken|compartir imprimir|partager imprimer|send feedback|yes no|yes / no|ja nein|sí no|oui non|name@mail|e-mail|advertisement|anzeige|publicidad|publicité|
accept all|allow selection|reject|manage preferences|ok, got it|alle akzeptieren|ablehnen|einstellungen|mehr erfahren|aceptar todo|rechazar|configurar|más información|
tout accepter|refuser|paramétrer|en savoir plus|learn more|read our privacy policy.|you can change your choice at any time.
"""
_PHRASES = re.compile(
    r"^(?:©|\(c\)|copyright\b)\s*\d"
    r"|\bcookies\b.*(?:\bwe use\b|\bour\b|\bthis site\b|\bwir verwenden\b|\butilizamos\b|\bnous\b)|(?:\bwe use\b|\bour\b|\bthis site\b|\bwir verwenden\b|\butilizamos\b|\bnous utilisons\b).*\bcookies\b"
    r"|\btracking technologies\b|\bsmall files on your device\b|^your privacy matters|^ihre privatsphäre|^diese website speichert|^este sitio guarda|^su privacidad|^ce site enregistre|^le respect de votre vie privée"
    r"|^(?:was this page helpful|did this answer your question|rate this article|artikel bewerten|war diese seite hilfreich|valore este artículo|noter cet article|cette page vous a-t-elle aidé|¿le (?:ha )?(?:resultado|sirvió))"
    r"|^[★☆ ]+$|^\d+ of \d+ found this|^(?:yes|ja|sí|oui) \| (?:no|nein|non)$"
    r"|^(?:last updated|reviewed on|updated \S+|zuletzt geändert|stand\b|revisado el|última actualización|mis à jour le|dernière révision)\b.{0,60}$|^\d+ min(?:uten?|utos?|utes)? (?:read|lesezeit|de lectura|de lecture)$|^by \S+ \S+$"
    r"|→$|^(?:←|→|previous:|next:|zurück:|weiter:|anterior:|siguiente:|précédent :|suivant :|précédent:|suivant:)"
    r"|^(?:try \S+ free|\S+ jetzt \d+ tage testen|pruebe \S+ gratis|essayez \S+ gratuitement|book a demo|subscribe to|join the mailing|get monthly|newsletter|neuigkeiten per|reciba|suscríbase|recevez|abonnez-vous|new: \S+ cloud)"
    r"|^(?:you are here|sie sind hier|está aquí|usted está aquí|vous êtes ici)\s*:|^\S.{0,30} ([›»>/]) .{1,40} \1 \S",
    re.I,
)


def _wordlist(text: str) -> frozenset:
    return frozenset(x.strip() for x in text.replace("\n", "").split("|") if x.strip())


_NAV, _FOOT, _HEADS, _TOC, _CONTROL, _SECTION = map(_wordlist, (NAVIGATION, FOOTER, LIST_HEADS, CONTENTS, CONTROLS, SECTIONS))

# -------------------------------------------------------------------- lines

_BULLET = re.compile(r"^\s*(?:([-*•+])|(\d{1,3}[.)]))\s+")
_SEPARATED = re.compile(r" · | \| | {3,}|\s[›»>/]\s|\t")
_DECORATION = re.compile(r"\s*(?:\(\w{1,10}\)|[▾▸▼»›])\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_END = ".?!:;。？！…"


@dataclass(slots=True)
class Line:
    number: int
    text: str
    bare: str  # without bullet, heading marks and decoration, lower case
    kind: str  # heading, code, table, item, sentence, short
    bullet: str
    block: int
    parent: int
    edge: str
    repeat: str  # place among lines of the page with the same wording


def read_page(text: str) -> list[Line]:
    lines: list[Line] = []
    block, fence, blank = 0, False, True
    raws = text.split("\n")
    for number, raw in enumerate(raws, 1):
        s = raw.strip()
        if not s:
            blank = blank or not fence
            continue
        if blank and not fence:
            block += 1
        first, blank = blank, False
        m = _BULLET.match(s)
        bullet = ("-" if m[1] else "1") if m else ""
        body = s[m.end() :] if m else s
        if s.startswith(("```", "~~~")):
            kind, fence = "code", not fence
        elif fence:
            kind = "code"
        elif s[0] == "#" and s.lstrip("#")[:1] == " ":
            kind, body = "heading", s.lstrip("# ")
        elif s[0] == "|" and s.count("|") > 2:
            kind = "table"
        else:
            n = len(body.split())
            goes_on = bool(lines) and not first and lines[-1].kind == "sentence" and len(lines[-1].text) >= 40 and lines[-1].text[-1] not in ".?!。？！" and not bullet
            # A line without a full stop is running text if it is long, or goes on in the next line.
            wraps = len(body) >= 60 or number < len(raws) and raws[number].strip()[:1].islower()
            long = n >= 7 and len(body) >= 40 and wraps and not _SEPARATED.search(body) or len(body) >= 14 and 2 * sum(c > "\u2e80" for c in body) > len(body)
            done = body[-1] in ".?!。？！" and n >= 4
            kind = "sentence" if (goes_on or long or done) and not bullet else "item" if bullet else "short"
        lines.append(Line(number, s, _DECORATION.sub("", body).lower(), kind, bullet, block, -1, "", ""))
    crumbs = {x.bare.rsplit(sep, 1)[1].strip() for x in lines for sep in (" › ", " > ", " » ", " / ") if sep in x.bare}
    seen = Counter(x.bare for x in lines)
    past: Counter = Counter()
    head = -1
    for i, x in enumerate(lines):
        past[x.bare] += 1
        x.repeat = "once" if seen[x.bare] == 1 else "early" if past[x.bare] < seen[x.bare] else "late"
        if x.bare in crumbs and x.kind == "short":
            x.repeat += " crumb"
        prev = lines[i - 1] if i else None
        if prev is None:
            x.edge = "root"
        elif x.block != prev.block:
            x.parent, x.edge = head, f"block {lines[head].kind} {x.kind}"
        elif x.kind in ("item", "short") and prev.kind == x.kind and prev.bullet == x.bullet and prev.parent >= 0 and prev.edge.startswith("list") and "|" not in prev.edge:
            x.parent, x.edge = prev.parent, prev.edge
        elif x.kind in ("item", "short") and prev.kind in ("short", "item", "sentence", "heading"):
            # A line that is a list in itself opens none.
            row = "|" if _SEPARATED.search(prev.text) else ""
            x.parent, x.edge = i - 1, f"list {prev.kind}{prev.bullet}{row} {x.kind}{x.bullet}"
        else:
            x.parent, x.edge = i - 1, f"next {prev.kind} {x.kind}"
        if prev is None or x.block != prev.block:
            head = i
    return lines


def features(lines: list[Line], i: int) -> list[str]:
    x = lines[i]
    out = [f"kind {x.kind}{x.bullet}", f"repeat {x.repeat} {x.kind}"]
    if x.kind in ("code", "table", "heading"):
        return out
    form = _DIGITS.sub("9", x.bare)
    words = _LETTERS.findall(form)
    out.append("form " + form)
    prefix = "w " if x.kind == "sentence" else "s "
    out += [prefix + w for w in words]
    if i == 0:
        out.append(f"top {x.kind}")
    if x.text[-1] in "→›»":
        out.append("arrow")
    prev = lines[i - 1] if i else None
    if prev is not None:
        out.append(f"after {x.kind}{x.bullet} {'same' if prev.block == x.block else 'gap'} {prev.kind}{prev.bullet}")
    if x.parent >= 0 and x.edge.startswith("list") and lines[x.parent].kind == "short":
        out.append("under " + _DIGITS.sub("9", lines[x.parent].bare))
    if words:
        out.append(f"first {words[0]}")
        out.append(f"pair {' '.join(words[:2])}")
    n = len(words)
    out.append(f"words {x.kind} {n if n < 8 else 8}")
    out.append(f"end {x.kind} {x.text[-1] if x.text[-1] in _END else '-'}")
    parts = _SEPARATED.split(x.text)
    if len(parts) > 1:
        out.append(f"parts {min(len(parts), 6)}")
    if not x.text[0].isalnum():
        out.append(f"mark {x.text[0]}")
    if "`" in x.text:
        out.append("tick")
    nxt = lines[i + 1] if i + 1 < len(lines) else None
    alone = (i == 0 or lines[i - 1].block != x.block) and (nxt is None or nxt.block != x.block)
    out.append(f"alone {alone} {x.kind}")
    out.append(f"then {x.kind} {'end' if nxt is None else ('same ' if nxt.block == x.block else 'gap ') + nxt.kind}")
    place = 10 * i // len(lines)
    out.append(f"place {x.kind} {place}")
    if nxt is not None and nxt.block == x.block:
        # A heading of a table of contents stands over entries that come again.
        out.append(f"over {nxt.repeat} {x.kind}")
    return out


def label_lines(lines: list[Line]) -> list[int | None]:
    """1 beside the article, 0 in it, None where nothing tells."""
    out: list[int | None] = [None] * len(lines)
    for i, x in enumerate(lines):
        if x.kind in ("heading", "code", "table"):
            out[i] = 0
            continue
        bare = x.bare
        parts = [p.strip().lower() for p in _SEPARATED.split(bare) if p.strip()]
        known = sum(_DECORATION.sub("", p) in _NAV or p in _FOOT or p in _CONTROL or bool(_PHRASES.search(p)) for p in parts)
        if bare in _HEADS or bare in _FOOT or bare in _CONTROL or _PHRASES.search(bare) and x.kind != "item" and "`" not in bare:
            out[i] = 1
        elif len(parts) > 1 and known * 2 >= len(parts) and known > 1:
            out[i] = 1
        elif bare in _NAV and x.bullet == "1":
            out[i] = 0  # steps are numbered, menus are not
        elif bare in _NAV:
            near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j].block == x.block]
            if any(y.bare in _NAV or y.bare in _FOOT for y in near):
                out[i] = 1
            elif x.kind == "short" and not near and i + 1 < len(lines) and lines[i + 1].kind == "sentence":
                out[i] = 0
        elif bare in _TOC and x.kind == "short" and i + 1 < len(lines) and lines[i + 1].block == x.block and lines[i + 1].kind in ("short", "item"):
            out[i] = 1
        elif x.kind == "sentence" or x.kind == "item" and len(bare) > 50 and bare[-1] in ".?!":
            out[i] = 0
    # Entries follow the head of their list as far as their form is the same.
    for i, x in enumerate(lines):
        if out[i] == 1 and (x.bare in _HEADS or x.bare in _TOC):
            j = i + 1
            while j < len(lines) and lines[j].block == x.block and lines[j].kind in ("short", "item") and lines[j].bullet == lines[i + 1].bullet and not (out[j] == 0 or out[j] == 1 and lines[j].bare not in _NAV):
                out[j] = 1
                j += 1
            goes_on = j < len(lines) and lines[j].block == x.block and lines[j].kind == "sentence" and out[j] == 0
            if j - i > 2 and lines[j - 1].kind == "short" and (goes_on or lines[j - 1].bare in _SECTION and "early" not in lines[j - 1].repeat):
                out[j - 1] = 0
    navigated = {x.block for x in lines if x.bare in _NAV and x.bullet != "1"}
    clean = {x.block for x in lines} - {x.block for x, y in zip(lines, out) if y == 1}
    for i, x in enumerate(lines):
        if out[i] is not None or x.kind not in ("item", "short"):
            continue
        after = lines[i + 1] if i + 1 < len(lines) else None
        alone = (i == 0 or lines[i - 1].block != x.block) and (after is None or after.block != x.block)
        if x.kind == "short" and (i == 0 or "crumb" in x.repeat or "early" not in x.repeat and (alone or x.block in clean or x.bare in _SECTION)):
            out[i] = 0
        elif x.kind == "short" and lines[i - 1].kind == "item" and lines[i - 1].block == x.block and "early" not in x.repeat:
            out[i] = 0  # a heading or title right after a list with bullets
        elif x.edge.startswith("list") and out[x.parent] is not None and not (x.kind == "short" and out[x.parent] == 1):
            out[i] = out[x.parent]
        elif x.kind == "short" and after is not None and (after.kind == "sentence" and out[i + 1] == 0 or after.kind in ("table", "code")):
            out[i] = 0
        elif x.kind == "item" and x.edge.startswith("block") and x.block not in navigated:
            out[i] = 0
    return out


# -------------------------------------------------------------------- model


@dataclass
class Model:
    weights: dict[str, float]  # log odds of a line to be beside the article, by feature
    bias: float
    edges: dict[str, float]  # coupling of parent and child by kind of edge: + for alike, - for unlike


def fit(pages: list[str]) -> Model:
    """Potentials from the labelled lines of ``pages``.

    All weights come from one convex problem, the pseudo-likelihood: the log
    odds of a line given its features and the labels of its neighbours.
    """
    rows: list[int] = []
    names: list[str] = []
    values: list[float] = []
    ys: list[int] = []
    for text in pages:
        lines = read_page(text)
        labels = label_lines(lines)
        at: dict[int, int] = {}
        for i, y in enumerate(labels):
            if y is None:
                continue
            at[i] = r = len(ys)
            ys.append(y)
            for f in set(features(lines, i)):
                rows.append(r)
                names.append(f)
                values.append(1.0)
        for i, x in enumerate(lines):
            p = x.parent
            if p >= 0 and i in at and p in at:
                rows += [at[i], at[p]]
                names += ["\0" + x.edge] * 2
                values += [4.0 * labels[p] - 2.0, 4.0 * labels[i] - 2.0]
    if len(set(ys)) < 2:
        return Model({}, -4.0, {})
    seen = Counter(names)
    index = {f: k for k, f in enumerate(f for f, n in sorted(seen.items()) if n >= LEAST_SEEN)}
    used = [k for k, f in enumerate(names) if f in index]
    row, col, val = np.array(rows)[used], np.array([index[names[k]] for k in used]), np.array(values)[used]
    y, n, m = np.array(ys, float), len(ys), len(index)
    w, b = np.zeros(m), 0.0
    gw, gb = np.full(m, 1e-3), 1e-3
    for _ in range(ROUNDS):  # adaptive gradients
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * val, minlength=n) + b, -40, 40)))
        d = p - y
        g = np.bincount(col, d[row] * val, minlength=m) + 0.5 * w
        gw += g * g
        gb += d.sum() ** 2
        w -= 0.4 * g / np.sqrt(gw)
        b -= 0.4 * d.sum() / math.sqrt(gb)
    return Model(
        {f: float(w[k]) for f, k in index.items() if f[0] != "\0" and abs(w[k]) > 1e-3},
        float(b),
        {f[1:]: float(w[k]) for f, k in index.items() if f[0] == "\0"},
    )


def marginals(lines: list[Line], model: Model) -> list[float]:
    """Probability of each line to be beside the article, by messages up and down the tree.

    With two states a message is one number: the log odds it speaks for.
    """
    n = len(lines)
    get = model.weights.get
    up = [model.bias + sum([get(f, 0.0) for f in set(features(lines, i))]) for i in range(n)]
    pull = [model.edges.get(x.edge, 0.0) for x in lines]

    def through(j: float, odds: float) -> float:
        # log of (e^j e^odds + e^-j) / (e^-j e^odds + e^j)
        odds = max(-60.0, min(60.0, odds))
        return math.log((math.exp(j + odds) + math.exp(-j)) / (math.exp(odds - j) + math.exp(j)))

    sent = [0.0] * n
    for i in range(n - 1, -1, -1):
        p = lines[i].parent
        if p >= 0:
            sent[i] = through(pull[i], up[i])
            up[p] += sent[i]
    full = up[:]
    for i in range(n):
        p = lines[i].parent
        if p >= 0:
            full[i] = up[i] + through(pull[i], full[p] - sent[i])
    return [1 / (1 + math.exp(-max(-60.0, min(60.0, o)))) for o in full]


def beside(text: str, model: Model) -> list[tuple[int, float]]:
    """Line number and marginal of each line that is not part of the article."""
    lines = read_page(text)
    return [(x.number, p) for x, p in zip(lines, marginals(lines, model)) if p >= THRESHOLD] if lines else []


# ----------------------------------------------------------------- operators


def is_page(path: Column) -> Column:
    return F.coalesce(path.startswith("processed/web/"), F.lit(False))


def train(chunks: DataFrame, pages: int = TRAIN_PAGES) -> Model:
    """The model of at most ``pages`` saved pages, chosen by a hash of their id."""
    saved = _pages(chunks).where(F.length("text") <= TRAIN_CHARS)
    n = saved.count()
    if not n:
        return fit([])
    # A threshold on the hash, so that no task sends more than its share.
    grain = 1 << 40
    least = math.ceil(grain * min(1.0, pages / n))
    some = saved.select("id", "text").where(F.pmod(F.xxhash64("id"), F.lit(grain)) < least).collect()  # about `pages` rows
    return fit([r["text"] for r in sorted(some)[:pages]])


def _decide(model_of, keep_lines: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of.value
        for f in frames:
            if keep_lines:
                texts = []
                for text in f["text"]:
                    gone = {n for n, _ in beside(text, model)}
                    texts.append("\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in gone).strip())
                yield f[["id", "source_path"]].assign(article=texts)
            else:
                rows = [(i, n, p) for i, text in zip(f["id"], f["text"]) for n, p in beside(text, model)]
                yield pd.DataFrame(rows, columns=["id", "line_no", "probability"]).astype({"line_no": "int32"})

    return run


def _pages(chunks: DataFrame) -> DataFrame:
    return chunks.where(is_page(F.col("source_path")) & F.col("text").isNotNull() & F.col("id").isNotNull())


def furniture_lines(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """id, line_no, probability of each non-blank line of a saved page that is not part of its article."""
    model = model or train(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # at most as large as the features of TRAIN_PAGES pages
    return _pages(chunks).select("id", "text").mapInPandas(_decide(shared, False), "id string, line_no int, probability double").dropDuplicates(["id", "line_no"])


def articles(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """id, source_path, article: each saved page reduced to its main body."""
    model = model or train(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    return _pages(chunks).select("id", "source_path", "text").mapInPandas(_decide(shared, True), "id string, source_path string, article string").dropDuplicates(["id"])
