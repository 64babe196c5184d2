"""How texts close: what is looked at in an ending, and a model of how whole an ending is, learnt from the corpus itself.

No labels are needed. A text stopped at a place taken by chance is an example of a cut one; the ends that the texts have are
examples of whole ones, but for the few that are cut and that the first fit shows. So the model weighs closing words, by what the
corpus says of them, against the manner in which the text is written.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np

# What is put at a cut.
CUT_MARKS = ("...", "…", " [...]", "�")
#: Share of the made cuts that end with one of these marks.
MARKED = 0.15
#: Rows in which a pair of traits must stand together to be weighed by itself, and the strength of the prior.
SUPPORT, PRIOR = 12, 3.0
#: Score from which an end counts as a cut in the first fit.
FIRM = 1.0

#: Steps of the share of a word's uses that end a sentence, and the uses below which it says nothing.
SHARES, FEW = (1e-9, 0.01, 0.03, 0.08, 0.2, 0.5), 20

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")
_STOP = re.compile(r"[.!?…]")
_SENTENCE = re.compile(r"[.!?…]\s+[^\W_„“\"–]")


def _split(line: str) -> tuple[str, str]:
    """A line without the marks at its end, and these."""
    i = len(line)
    while i and not (line[i - 1].isalnum() or line[i - 1].isspace()):
        i -= 1
    return line[:i], line[i:]


def _last(line: str, part: Callable[[str], bool], skip: bool) -> str:
    """The last run of such characters; `skip` leaves out what comes after it."""
    j = len(line)
    while skip and j and not part(line[j - 1]):
        j -= 1
    i = j
    while i and part(line[i - 1]):
        i -= 1
    return line[i:j]


def closing_words(text: str) -> Iterable[str]:
    """Words in front of a mark that ends a sentence within the text."""
    for x in text.split()[:-1]:
        if not x[-1].isalnum():
            body, marks = _split(x)
            if body and _STOP.search(marks):
                w = _last(body, str.isalpha, True)
                if len(w) > 1:
                    yield w.lower()


def _shape(line: str) -> str:
    """Kinds of a line's tokens: capital words, lower-case words, digits, marks; runs of words as one."""
    out: list[str] = []
    for t in _TOKEN.findall(line):
        k = "C" if t[0].isupper() else "w" if t[0].isalpha() else "9" if t[0].isdigit() else t
        if not (k in "Cw" and out and out[-1] == k):
            out.append(k)
    return "".join(out)


def traits(text: str) -> tuple[str, dict[str, str]] | None:
    """(closing word, traits of the ending); None for a blank text. The words' own statistics are added by `with_word`."""
    t = text.rstrip()
    lines = [y for x in t.splitlines() if (y := x.strip())]
    if not lines:
        return None
    last, before = lines[-1], lines[:-1]
    body, marks = _split(last)
    word, tail = _last(last, str.isalpha, True), _last(body, str.isalnum, False)
    mark = (
        "none" if not marks else "lost" if "�" in marks else "dots" if "..." in marks or "…" in marks else "stop" if _STOP.search(marks)
        else "close" if marks[-1] in ")]\"”’»'" else marks[-1] if marks[-1] in ",;:-–" else "other"
    )
    token = "none" if not tail else "number" if tail.isdigit() else "initial" if len(tail) == 1 else "word"
    style = "lines" if len(before) >= 2 and max(map(len, before)) < 90 else "prose"
    if word.isupper() and len(t) > 30 and (t.isupper() or sum(map(str.isupper, t)) > 0.9 * sum(map(str.isalpha, t))):
        style = "capitals"
    shape = _shape(last) if len(last) < 90 else "long"
    seen = "-" if style != "lines" else str(shape in set(map(_shape, before)))
    stops = -1 if not before else round(3 * sum(bool(_STOP.search(_split(x)[1])) for x in before) / len(before))
    n = len(last.split(None, 6))
    f = {
        "mark": mark, "token": token, "style": style, "sentence": str(bool(_SENTENCE.search(t))), "stopped": str(stops),
        "capital": str(word[:1].isupper() + (len(word) > 1 and word.isupper())), "length": str(n if n < 3 else 3 if n < 6 else 6),
        "seen": seen, "shape": shape if len(shape) < 8 else "long",
        "before": "-" if not before else "mark" if not before[-1][-1].isalnum() else "short" if len(before[-1].split(None, 4)) <= 3 else "open",
    }
    return word.lower(), f


def with_word(f: dict[str, str], uses: int, closing: int, ends: int) -> dict[str, str]:
    """Adds how the corpus uses the closing word: how often inside texts, before a stop, and at the end of other texts."""
    c = closing / max(uses, 1)
    word = [
        "0" if not uses else "1" if uses < 3 else "2" if uses < FEW else "3", "-" if uses < FEW else str(bisect(SHARES, c)),
        "-" if f["style"] != "capitals" else str(bisect((0.05, 0.3), (ends - 1) / max(1, uses + ends))),
    ]
    return f | {
        "uses": word[0], "closing": word[1], "ends": word[2], "word": "".join(word) + f["capital"], "kind": f["style"] + f["mark"] + f["token"],
        "manner": f["style"] + f["sentence"] + f["seen"] + f["stopped"],
    }


def stopped(key: int, text: str) -> str:
    """The text stopped at a place taken by chance from its key, in some cases with a mark put there."""
    h = hashlib.blake2b(b"%d" % key, digest_size=8).digest()
    t, r, k = text.rstrip(), int.from_bytes(h[:4]) / 2**32, int.from_bytes(h[4:]) / 2**32
    cut = t[: max(12, int(len(t) * (0.15 + 0.8 * r)))].rstrip()
    return cut + CUT_MARKS[int(k / MARKED * len(CUT_MARKS))] if k < MARKED else cut


class Terminality:
    """Logarithm of how many times likelier an ending is among cuts than among whole ends: traits and pairs of traits, each with a weight."""

    def __init__(self, ends: list[dict[str, str]], cuts: list[dict[str, str]], firm: float = FIRM) -> None:
        many, few = Counter(f["shape"] for f in ends), Counter(f["shape"] for f in cuts)
        ratio = {s: (many[s] + 1) / (few[s] + 1) for s in {*many, *few}}
        self.shapes = {s: "0" if r < 0.15 else "1" if r < 0.5 else "2" if r < 2 else "3" for s, r in ratio.items()}
        rows = [self._levels(f) for f in (*ends, *cuts)]
        self.level = {x: i + 1 for i, x in enumerate(sorted({x for r in rows for x in r}))}  # 0: not seen in the sample
        n = len(self.level) + 1
        self.weight, self.base = np.zeros((n, n)), 0.0
        if not ends or not cuts:
            return
        x, which = np.unique(self._numbers((*ends, *cuts)), axis=0, return_inverse=True)  # many endings are alike
        whole, cut = np.bincount(which[: len(ends)], minlength=len(x)), np.bincount(which[len(ends) :], minlength=len(x))
        i, j = np.tril_indices(x.shape[1])
        cell = x[:, i] * n + x[:, j]
        often = np.bincount(cell.ravel(), np.repeat(whole + cut, len(i)), n * n) >= SUPPORT
        number = np.full(n * n, -1)
        number[often] = np.arange(often.sum())
        row, col = np.nonzero(often[cell])
        flat, held = number[cell[row, col]], whole
        for _ in range(2):  # ends that look like cuts are left out of the second fit
            w = _fit(flat, row, held, cut, int(often.sum()))
            self.weight.ravel()[often], self.base = w[:-1], float(w[-1])
            held = np.where(self._score(x) < firm, whole, 0)

    def _levels(self, f: dict[str, str]) -> list[str]:
        return [f"{k}={v}" for k, v in f.items() if k != "shape"] + [f"shape={self.shapes.get(f['shape'], '-')}"]

    def _numbers(self, rows: Sequence[dict[str, str]]) -> np.ndarray:
        return np.array([[self.level.get(x, 0) for x in self._levels(f)] for f in rows], dtype=np.int64)

    def _score(self, x: np.ndarray) -> np.ndarray:
        i, j = np.tril_indices(x.shape[1])
        return self.weight[x[:, i], x[:, j]].sum(axis=1) + self.base

    def score(self, rows: Sequence[dict[str, str]]) -> np.ndarray:
        return self._score(self._numbers(rows)) if len(rows) else np.zeros(0)


def _fit(flat: np.ndarray, owner: np.ndarray, whole: np.ndarray, cut: np.ndarray, width: int) -> np.ndarray:
    """Logistic regression over rows that stand for `whole` and `cut` endings, by Newton's method, the steps by conjugate
    gradients; both classes count alike. The last weight is the constant."""
    half = (whole.sum() + cut.sum()) / 2
    a, b = whole * half / max(1, whole.sum()), cut * half / max(1, cut.sum())
    times = lambda v: np.bincount(owner, v[flat], len(whole)) + v[-1]
    back = lambda r: np.append(np.bincount(flat, r[owner], width), r.sum())
    w = np.zeros(width + 1)
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g = back(b - (a + b) * p) - PRIOR * w
        h = (a + b) * p * (1 - p)
        s, r = np.zeros(width + 1), g
        d, rr = r, r @ r
        for _ in range(15):
            if rr < 1e-4:
                break
            q = back(h * times(d)) + PRIOR * d
            step = rr / (d @ q)
            s, r = s + step * d, r - step * q
            new = r @ r
            d, rr = r + new / rr * d, new
        w = w + s
        if np.abs(s).max() < 0.03:
            break
    return w
