"""A sentence classifier fitted on documents that erring reviewers labelled as wholes."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np

from marlstone.llm.abuse_lexicon import BIAS, PHRASE_WORDS, PRIOR, ROLE, plain, roles

LABELS = ["clean", "abusive", "hateful", "sexual"]
_BLANKS = str.maketrans({"\t": " ", "\xa0": " ", "\r": "\n", "\x0b": "\n", "\x0c": "\n", "\u2028": "\n", "\u2029": "\n", "\u3000": " "})
_WORD = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f\s]")
_ALWAYS = frozenset({*ROLE, *PHRASE_WORDS, *"a i m u s t re ll".split()})


def sentences(restored: str, most: int = 24) -> list[str]:
    """The sentences of a restored text in plain letters; one of over ``most`` words as overlapping stretches of that many words."""
    out = []
    text = plain(restored).translate(_BLANKS) if not restored.isascii() or "\t" in restored or "\r" in restored else restored.lower()
    # A stop before a blank, a line's end or two blanks end a sentence; other signs are no words and may stay.
    for s in text.replace(". ", "\n").replace("! ", "\n").replace("? ", "\n").replace("  ", "\n").split("\n"):
        if s.count(" ") < most:
            if s and not s.isspace():
                out.append(s)
            continue
        ws = s.split(" ")
        out.extend(" ".join(ws[i : i + most]) for i in range(0, max(len(ws) - most // 2, 1), most // 2))
    return out


class Doc(NamedTuple):
    restored: str
    votes: list[tuple[str, str]]  # reviewer, label


class AbuseModel:
    """Log odds of (abusive, hateful, sexual) against clean of each sentence; a document is as bad as its worst sentence.

    Evidence of a sentence: the roles its words play (with odds set before any
    label is seen, see :mod:`abuse_lexicon`) and its words, neighbouring pairs and
    pairs with one word between them, whose odds are learned.  With few labels the
    odds set beforehand decide, with many the learned ones.
    """

    def __init__(self, ridge: float = 3.0, hold: float = 20.0, rounds: int = 4, steps: int = 50, seen: int = 3, least: float = 0.05):
        #: ``ridge`` draws learned odds to 0, ``hold`` role odds to what is set beforehand; words in fewer than ``seen`` documents called
        #: other than clean are one word; learned odds under ``least`` are 0.
        self.ridge, self.hold, self.rounds, self.steps, self.seen, self.least = ridge, hold, rounds, steps, seen, least
        self.known: frozenset[str] = _ALWAYS
        self.weights: dict[str, tuple[float, float, float]] = dict(PRIOR)
        self.bias = BIAS
        self.chances_of: dict[tuple[str, ...], tuple[float, float, float, float]] = {}

    def masked(self, sentence: str) -> tuple[str, ...]:
        known = self.known
        return tuple([w if w in known else "0" if w[0].isdigit() else "_" for w in _WORD.findall(sentence)])

    @staticmethod
    def features(masked: tuple[str, ...]) -> list[str]:
        out = {w for w in masked if w != "_"}
        out |= {f"{a} {b}" for a, b in zip(masked, masked[1:], strict=False) if a != "_" and b != "_"}
        out |= {f"{a} * {b}" for a, b in zip(masked, masked[2:], strict=False) if a != "_" and b != "_"}
        return [*roles(masked), *sorted(out)]

    def sentence_odds(self, sentence: str) -> tuple[float, float, float]:
        return self._odds(self.masked(sentence))

    def _odds(self, masked: tuple[str, ...]) -> tuple[float, float, float]:
        a, h, s = self.bias
        get = self.weights.get
        for f in self.features(masked):
            w = get(f)
            if w is not None:
                a, h, s = a + w[0], h + w[1], s + w[2]
        return a, h, s

    def _chances(self, sentence: str) -> tuple[float, float, float, float]:
        masked = self.masked(sentence)
        found = self.chances_of.get(masked)
        if found is None:
            a, h, s = (math.exp(min(x, 50.0)) for x in self._odds(masked))
            total = 1 + a + h + s
            if len(self.chances_of) >= 1 << 16:
                self.chances_of.clear()
            found = self.chances_of[masked] = (a / total, h / total, s / total, (a + h + s) / total)
        return found

    def score(self, restored: str) -> tuple[float, float, float, float]:
        """Probabilities of abusive, hateful, sexual and of any of them, each that of the worst sentence; (0, 0, 0, 0) without any."""
        found = {self._chances(s) for s in sentences(restored)}
        return tuple(map(max, zip(*found, strict=True))) if found else (0.0, 0.0, 0.0, 0.0)

    def fit(self, docs: list[Doc]) -> AbuseModel:
        """EM over what each document is: labels through each reviewer's own error rates, and the best evidence among its sentences.

        Deterministic; documents without sentences or votes say nothing.
        """
        parted = [(sentences(d.restored), d.votes) for d in docs]
        parted = [(s, v) for s, v in parted if s and v]
        if not parted:
            return self
        df = Counter(w for s, v in parted if any(c != "clean" for _, c in v) for w in {w for x in s for w in _WORD.findall(x) if not w[0].isdigit()})
        self.known = _ALWAYS | {w for w, n in df.items() if n >= self.seen}
        ids: dict[tuple[str, ...], int] = {}
        member = []  # distinct evidence per document
        for s, _ in parted:
            member.append(sorted({ids.setdefault(self.masked(x), len(ids)) for x in s}))
        vocab: dict[str, int] = {f: i for i, f in enumerate(PRIOR)}
        n_doc: Counter = Counter()
        instances = [self.features(m) for m in ids]
        for m, (_, v) in zip(member, parted, strict=True):
            if any(c != "clean" for _, c in v):
                n_doc.update({f for i in m for f in instances[i]})
        for f, n in sorted(n_doc.items()):
            if n >= self.seen:
                vocab.setdefault(f, len(vocab))
        cols, ptr = [], [0]
        for inst in instances:
            cols.extend(vocab[f] for f in inst if f in vocab)
            ptr.append(len(cols))
        col, row = np.array(cols, np.int64), np.repeat(np.arange(len(instances)), np.diff(ptr))
        prior = np.zeros((len(vocab) + 1, 3))
        for f, w in PRIOR.items():
            prior[vocab[f]] = w
        prior[-1] = BIAS
        pull = np.full((len(vocab) + 1, 1), self.ridge)
        pull[: len(PRIOR)] = pull[-1] = self.hold
        w = prior.copy()

        reviewers = sorted({r for _, v in parted for r, _ in v})
        at = {r: i for i, r in enumerate(reviewers)}
        lab = {c: i for i, c in enumerate(LABELS)}
        votes = [[(at[r], lab[c]) for r, c in v if c in lab] for _, v in parted]
        err = np.full((len(reviewers), 4, 4), 0.03)
        err[:, range(4), range(4)] = 0.91
        n_inst = np.array([len(m) for m in member])
        flat = np.array([i for m in member for i in m])
        of = np.repeat(np.arange(len(member)), n_inst)
        start = np.concatenate(([0], np.cumsum(n_inst)[:-1]))

        for round_ in range(self.rounds):
            p = _softmax(self._logits(w, row, col, len(instances)))
            best = np.maximum.reduceat(p[flat, 1:], start, axis=0)
            clean = np.minimum.reduceat(p[flat, 0], start)
            doc = np.column_stack([clean, (1 - clean)[:, None] * best / np.maximum(best.sum(1, keepdims=True), 1e-12)])
            doc = np.clip(doc, 0.05 if round_ == 0 else 0.01, None)
            q = doc / doc.sum(1, keepdims=True)
            for d, vs in enumerate(votes):
                for r, c in vs:
                    q[d] *= err[r, :, c]
            q /= q.sum(1, keepdims=True)
            if round_:
                err = np.full_like(err, 0.5)
                err[:, range(4), range(4)] = 8.0
                for d, vs in enumerate(votes):
                    for r, c in vs:
                        err[r, :, c] += q[d]
                err /= err.sum(2, keepdims=True)
            # Each document's sentences stand for clean as far as it is clean; for a kind of content its best evidence does, at first every sentence a share.
            target = np.zeros((len(instances), 4))
            np.add.at(target[:, 0], flat, q[of, 0])
            for c in (1, 2, 3):
                if round_ == 0:
                    np.add.at(target[:, c], flat, q[of, c] / n_inst[of])
                    continue
                order = np.lexsort((p[flat, c], of))
                top = order[np.cumsum(n_inst) - 1]
                np.add.at(target[:, c], flat[top], q[:, c])
            w = self._ascend(w, prior, pull, target, row, col)
        names = list(vocab)
        self.bias = tuple(map(float, w[-1]))
        self.weights = {names[i]: tuple(map(float, w[i])) for i in range(len(names)) if i < len(PRIOR) or np.abs(w[i]).max() >= self.least}
        return self

    @staticmethod
    def _logits(w, row, col, n):
        return np.column_stack([np.bincount(row, w[col, k], n) for k in range(3)]) + w[-1]

    def _ascend(self, w, prior, pull, target, row, col):
        """Weighted multinomial logistic regression with a Gaussian prior, by Adam steps over all instances."""
        n, total = len(target), target.sum(1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.steps + 1):
            p = _softmax(self._logits(w, row, col, n))
            g = target[:, 1:] - total[:, None] * p[:, 1:]
            grad = np.empty_like(w)
            for k in range(3):
                grad[:-1, k] = np.bincount(col, g[row, k], len(w) - 1)
            grad[-1] = g.sum(0)
            grad -= pull * (w - prior)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w


def _softmax(odds: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.zeros(len(odds)), odds])
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
