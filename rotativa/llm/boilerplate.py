"""Page boilerplate mixed with the article (problem 2).

Each page is a graph of its lines.  A line classifier over the wording and the
place of a line gives two costs, the price of calling it article and the price
of calling it furniture; they are the capacities from the source and to the
sink.  Neighbouring lines, in sequence or two apart, are joined by smoothness
edges, stronger ones within a list of links.  The minimum cut, found by
max-flow, separates the article from the furniture of its page.

The classifier is fitted to the corpus: lines of a page that its note's body
holds are article, lines outside the span of the body are furniture.  Such
labels are noisy, as bodies may be cut or mixed themselves, so the fit is a
logistic regression that starts from stated odds and is drawn back to them.
All its features are categories, and the counts of their combinations over all
pages are all it needs.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines as L
from .residue import is_non_article

FIELDS = ("texto_extraido", "texto_nota_limpia", "texto_cuerpo_nota")

#: Log-odds of furniture by the wording of a line.
_WORDING = {L.FURN: 6.0, L.NAV: 6.0, L.AD: 6.0, L.EMBED: 6.0, L.LINK: 5.0, L.HEAD: 5.0, L.RES: 2.0, L.LABEL: -4.0, L.TEXT: -3.0, L.MENU1: 0.5}
#: Change for a line below the heading of a list of links, by its form.
_BELOW = {"headline": 3.6, "sentence": 2.8, "paragraph": 0.5}
#: Smoothness between neighbours of such a list, and between lines two apart; the same for other lines.
_NEAR, _APART = 2.5, 1.0
_BESIDE, _BEYOND = 0.6, 0.3
#: Lines the counts are scaled to, and how strongly weights are drawn back to the stated odds.
_LINES, _RIDGE = 10_000, 100.0
#: Lines of a body that must stand in the page before it labels others.
_SURE = 3

Shifts = dict[tuple[str, str], float]
_STOP = re.compile(r"[.?!»]\s")
_RANK = re.compile(r"\s*\d{1,2}[.)] \S")


def min_cut(score: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Sink side (True) of a minimum cut.

    A node with score s > 0 has capacity s to the sink, else -s from the
    source.  Nodes whose terminal outweighs all their edges keep their side in
    every minimum cut; they are merged into the terminals first, and max-flow
    by shortest augmenting paths runs on what remains.  On a tie a node stays
    on the source side.
    """
    n = len(score)
    s = [float(x) for x in score]
    side: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    pressure = [sum(x.values()) for x in near]
    todo = [i for i in range(n) if abs(s[i]) > pressure[i] or not near[i]]
    while todo:
        i = todo.pop()
        if side[i] is not None:
            continue
        side[i] = s[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                s[j] += w if side[i] else -w
                pressure[j] -= w
                if abs(s[j]) > pressure[j] + 1e-12:
                    todo.append(j)
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, x in zip(left, _max_flow(left, s, near)):
            side[i] = x
    return [bool(x) for x in side]


def _max_flow(nodes: list[int], s: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths; True for nodes the source no longer reaches."""
    at = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    src, snk = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for v, k in at.items():
        if s[v] > 0:
            cap[k][snk] = s[v]
            cap[snk].setdefault(k, 0.0)
        elif s[v] < 0:
            cap[src][k] = -s[v]
            cap[k].setdefault(src, 0.0)
        for u, w in near[v].items():
            if u in at:
                cap[k][at[u]] = cap[k].get(at[u], 0.0) + w
    while True:
        prev = {src: src}
        q = deque([src])
        while q and snk not in prev:
            x = q.popleft()
            for y, c in cap[x].items():
                if c > 1e-9 and y not in prev:
                    prev[y] = x
                    q.append(y)
        if snk not in prev:
            # on a tie a node stays with the source: the sink's side is what still reaches the sink
            back: list[list[int]] = [[] for _ in range(n + 2)]
            for x in range(n + 2):
                for y, c in cap[x].items():
                    if c > 1e-9:
                        back[y].append(x)
            seen, q = {snk}, deque([snk])
            while q:
                for x in back[q.popleft()]:
                    if x not in seen:
                        seen.add(x)
                        q.append(x)
            return [k in seen for k in range(n)]
        path, y = [], snk
        while y != src:
            path.append((prev[y], y))
            y = prev[y]
        f = min(cap[x][y] for x, y in path)
        for x, y in path:
            cap[x][y] -= f
            cap[y][x] = cap[y].get(x, 0.0) + f


def _form(line: str) -> str:
    t = line.strip()
    if len(t) > 260 or len(_STOP.findall(t)) > 2:
        return "paragraph"
    return "sentence" if t.endswith(".") else "headline"


def _title_at(parts: list[str], classes: list[str], title: str) -> int:
    """Place of the note's own title, or -1."""
    k = L.key(title)
    if len(k) < 8:
        return -1
    short = len(k) // 2 + 4
    for i, line in enumerate(parts):
        if classes[i] in (L.TEXT, L.LABEL, L.RES) and L.key(line)[:short] == k[:short]:
            return i
    return -1


def places(parts: list[str], classes: list[str], at: int) -> list[str]:
    """Where each line stands: above the title, below the heading of a list of links (by its form), or elsewhere."""
    out, below = [], False
    for i, c in enumerate(classes):
        below = below or c == L.HEAD
        out.append(_form(parts[i]) if below and c in (L.TEXT, L.LABEL) else "above" if i < at else "")
    return out


def scores(parts: list[str], classes: list[str], title: str, section: str, known: dict[str, float], shifts: Shifts | None = None) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Classifier scores (log-odds of furniture) and smoothness edges of one page."""
    n = len(parts)
    score = [_WORDING.get(c, 0.0) for c in classes]
    full = [i for i in range(n) if classes[i] != L.BLANK]
    at = _title_at(parts, classes, title)
    own = L.key(section)
    label = -1
    if at >= 0:
        above = [i for i in full if i < at]
        if above and classes[above[-1]] in (L.MENU1, L.TEXT) and len(parts[above[-1]].strip()) < 40:
            label = above[-1]
    else:
        # without its title, the label is the last single entry before the first other line
        for i in full:
            if classes[i] == L.MENU1:
                label = i
            elif classes[i] in (L.TEXT, L.LABEL):
                break
    if label >= 0 and own and classes[label] == L.MENU1 and L.key(parts[label]) not in own and own not in L.key(parts[label]):
        label = label if at >= 0 else -1
    head = -1
    for pos, i in enumerate(full):
        c = classes[i]
        if c == L.MENU1:
            if i == label:
                score[i] = -5.0
            else:
                beside = [classes[j] for j in full[max(0, pos - 1) : pos] + full[pos + 1 : pos + 2]]
                score[i] += 3.0 if any(x in (L.MENU1, L.NAV, L.FURN, L.AD) for x in beside) else 0.0
                if own and L.key(parts[i]) == own and (at < 0 or i > at):
                    score[i] -= 4.0
        elif c == L.HEAD:
            head = pos
        elif head >= 0 and c in (L.TEXT, L.LABEL):
            score[i] += _BELOW[_form(parts[i])] + (2.0 if _RANK.match(parts[i]) else 0.0)
        elif at >= 0 and i < at and i != label and c == L.TEXT:
            score[i] += 4.0
        if known:
            score[i] += known.get(parts[i].strip(), 0.0)
    if shifts:
        for i, where in zip(range(n), places(parts, classes, at)):
            if i != label:
                score[i] += shifts.get((classes[i], where), 0.0)
    edges = []
    first = next((p for p, i in enumerate(full) if classes[i] == L.HEAD), n)
    for p in range(len(full) - 1):
        a, b = full[p], full[p + 1]
        one, two = (_NEAR, _APART) if p >= first else (_BESIDE, _BEYOND)
        edges.append((a, b, one * (0.3 if b - a > 1 else 1.0)))
        if p + 2 < len(full):
            edges.append((a, full[p + 2], two * (0.3 if full[p + 2] - a > 2 else 1.0)))
    return score, edges


def labelled(page: str, body: str, title: str, classes: list[str]) -> list[tuple[str, str, bool]]:
    """(class, place, furniture) of the lines of a page that its body tells apart; none where it tells too little."""
    parts = page.split("\n")
    held = {x.strip() for x in body.split("\n") if x.strip()}
    inside = [x.strip() in held for x in parts]
    if sum(inside) < _SURE:
        return []
    first, last = inside.index(True), len(inside) - 1 - inside[::-1].index(True)
    at = _title_at(parts, classes, title)
    out = []
    for i, (c, where) in enumerate(zip(classes, places(parts, classes, at))):
        # title, section label, byline and sign-off are article outside its body
        if c not in (L.BLANK, L.LABEL, L.MENU1) and i != at and (inside[i] or i < first or i > last):
            out.append((c, where, not inside[i]))
    return out


def fit_shifts(counts: dict[tuple[str, str], tuple[float, float]], rounds: int = 50) -> Shifts:
    """Change of the stated log-odds for each (class, place), from counts of (article, furniture) lines.

    The change has a part for the class and one for the place, found by Newton's
    method on counts scaled to a fixed number of lines.
    """
    cells = sorted(counts)
    total = sum(map(sum, counts.values()))
    if not total:
        return {}
    names = sorted({("c", c) for c, _ in cells} | {("p", p) for _, p in cells if p})
    x = np.array([[n in (("c", c), ("p", p)) for n in names] for c, p in cells], float)
    n = np.array([counts[k] for k in cells], float) * _LINES / total
    stated = np.array([_WORDING.get(c, 0.0) + (_BELOW.get(p, 0.0) or (4.0 if p == "above" and c == L.TEXT else 0.0)) for c, p in cells])
    w = np.zeros(len(names))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(stated + x @ w, -30, 30)))
        grad = x.T @ (n.sum(1) * q - n[:, 1]) + _RIDGE * w
        hess = (x.T * (n.sum(1) * q * (1 - q))) @ x + _RIDGE * np.eye(len(names))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return {k: float(v) for k, v in zip(cells, x @ w)}


def learn_shifts(notes: DataFrame, page: str = "texto_extraido", body: str = "texto_cuerpo_nota", title: str = "titulo") -> Shifts:
    """The classifier's changes, from all pages whose note has a body; one small row for each class and place comes to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter[tuple[str, str, bool]] = Counter()
            for text, inner, name in zip(*(c.to_pylist() for c in b.columns)):
                classes = L.classify_page(text.split("\n"))
                if not is_non_article(text, classes):
                    got.update(labelled(text, inner, name or "", classes))
            cols = list(zip(*got)) or [[], [], []]
            types = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols, types)), pa.array(list(got.values()), pa.int64())], names=["c", "p", "f", "n"])

    picked = notes.select(F.col(f"`{page}`").cast("string").alias("t"), F.col(f"`{body}`").cast("string").alias("b"), F.col(f"`{title}`").cast("string").alias("ti")).where("t IS NOT NULL AND b IS NOT NULL")
    counts: dict[tuple[str, str], list[float]] = {}
    for r in picked.mapInArrow(scan, "c string, p string, f boolean, n long").groupBy("c", "p", "f").agg(F.sum("n").alias("n")).collect():
        counts.setdefault((r["c"], r["p"]), [0.0, 0.0])[int(r["f"])] += r["n"]
    return fit_shifts({k: (a, b) for k, (a, b) in counts.items()})


def furniture_lines(text: str | None, title: str | None = None, section: str | None = None, known: dict[str, float] | None = None, classes: list[str] | None = None, shifts: Shifts | None = None) -> list[int]:
    """Numbers, from 1, of the non-blank lines of a page text that are furniture."""
    if not text:
        return []
    parts = text.split("\n")
    if classes is None:
        classes = L.classify_page(parts)
    score, edges = scores(parts, classes, title or "", section or "", known or {}, shifts)
    cut = min_cut(score, edges)
    return [i + 1 for i, x in enumerate(cut) if x and classes[i] != L.BLANK]


def note_furniture(texts: Sequence[str | None], title: str | None, section: str | None, shifts: Shifts | None = None) -> list[list[int]] | None:
    """Furniture of a note's fields, the page text first; None for a non-article.

    A line of a later field that also stands in the page text carries over the
    page's verdict: there it has its surroundings.
    """
    page = texts[0]
    parts = page.split("\n") if page else []
    classes = L.classify_page(parts)
    if page and is_non_article(page, classes):
        return None
    out = [furniture_lines(page, title, section, None, classes, shifts)]
    bad = set(out[0])
    known: dict[str, float] = {}
    for i, line in enumerate(parts, 1):
        t = line.strip()
        if t:
            v = 4.0 if i in bad else -4.0
            known[t] = v if known.get(t, v) == v else 0.0
    for text in texts[1:]:
        out.append(furniture_lines(text, title, section, known, None, shifts))
    return out


def find_furniture(notes: DataFrame, fields: Sequence[str] = FIELDS, key: str = "noticia_id", title: str = "titulo", section: str = "seccion", shifts: Shifts | None = None) -> DataFrame:
    """(key, campo, linea) of the furniture lines of every article.

    The first field is the page text, by which non-articles are told; these
    give no rows.  The classifier is fitted to the notes if ``shifts`` aren't
    given; the last field is the body it learns from.  Null or blank texts give none; a null title or section only
    takes away its hint.  Repeated rows count once.
    """
    names = list(fields)
    if shifts is None:
        shifts = learn_shifts(notes, names[0], names[-1], title)
    picked = notes.select(
        F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{title}`").cast("string").alias("ti"), F.col(f"`{section}`").cast("string").alias("se"),
        *(F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(names)),
    ).where("k IS NOT NULL")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, cs, ls = [], [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                found = note_furniture(row[3:], row[1], row[2], shifts)
                for name, lines in zip(names, found or ()):
                    ks += [row[0]] * len(lines)
                    cs += [name] * len(lines)
                    ls += lines
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(cs, pa.string()), pa.array(ls, pa.int32())], names=["k", "campo", "linea"])

    return picked.mapInArrow(scan, "k string, campo string, linea int").distinct().withColumnRenamed("k", key)


def main_text(text: str | None, title: str | None = None, section: str | None = None) -> str | None:
    """A page text without its furniture lines."""
    if text is None:
        return None
    bad = set(furniture_lines(text, title, section))
    return "\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in bad)
