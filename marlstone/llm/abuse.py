"""Abusive, hateful or sexual content: noisy-channel deobfuscation, then scoring (problem 9)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.abuse_lexicon import PHRASE_WORDS, TELLING
from marlstone.llm.abuse_lexicon import plain as _ascii
from marlstone.llm.abuse_model import LABELS, AbuseModel, Doc
from marlstone.llm.names import typo

# Element names of markup; only these are taken out of words.
_ELEMENTS = "a abbr acronym b big blockquote body br center code dd del div dl dt em font h1 h2 h3 h4 h5 h6 hr html i img ins kbd li mark ol p pre q s samp small span strike strong sub sup table tbody td th thead tr tt u ul wbr".split()
_TAG = re.compile(r"</?(?:" + "|".join(_ELEMENTS) + r")(?:\s[^<>]*)?/?>")
_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_FOREIGN = re.compile(r"\w*[Ͱ-ӿ]\w*")
WORDS = sorted(TELLING)

_HOMOGLYPHS = str.maketrans("аеорсухкіѕјԁһвмтнαοεικνρτυ", "aeopcyxkisjdhbmthaoeiknptu")
_LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
CELLS = 27**3


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8)
    codes = np.where((raw >= 97) & (raw <= 122), raw - 96, 0).astype(np.int64)
    return np.concatenate(([0, 0], codes, [0]))


def trigram_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all letter trigrams of the corpus (other characters are one symbol): 27**3 cells, whatever its size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    c = _codes(t)
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = documents.select(text).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CELLS)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


class Decoder:
    """Restores disguised words: Viterbi paths through the lattice of what each character may stand for.

    A sign may stand for letters it looks like, a star for any letter, a repeated
    letter for one or two, a gap between spaced letters for nothing or for the end of
    a word.  Paths are weighed by a character trigram model of the corpus, mixed with
    the words looked for, and the cost of each disguise; the written form competes as
    it stands.
    """

    def __init__(self, counts: np.ndarray, words: list[str], mix: float = 0.2, slip: float = 0.5):
        self.slip = slip
        self.cost = self._model(counts, words, mix)
        #: Of spaced letters more is lost than of other disguises: here all words of the phrases weigh in.
        self.run_cost = self._model(counts, sorted({*words, *PHRASE_WORDS}), 0.5)
        self.words = {_ascii(w) for w in words}
        self.by_length: dict[int, list[str]] = {}
        self.by_single: dict[str, list[str]] = {}
        self.by_cut: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self.by_length.setdefault(len(w), []).append(w)
            self.by_single.setdefault(re.sub(r"(.)\1+", r"\1", w), []).append(w)
            if len(w) >= 5:
                for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.by_cut.setdefault(cut, []).append(w)
        #: What a token stands for: most tokens come again and again.
        self.token = lru_cache(maxsize=1 << 17)(self._token)
        self.calm: set[str] = set()

    @staticmethod
    def _model(counts: np.ndarray, words: list[str], mix: float) -> list:
        own = np.zeros(CELLS)
        for w in words:
            c = _codes(_ascii(w))
            np.add.at(own, c[:-2] * 729 + c[1:-1] * 27 + c[2:], 1.0)
        corpus = counts.reshape(729, 27) + 0.05
        wanted = own.reshape(729, 27) + 0.002
        p = (1 - mix) * corpus / corpus.sum(1, keepdims=True) + mix * wanted / wanted.sum(1, keepdims=True)
        return (-np.log(p)).reshape(27, 27, 27).tolist()

    def viterbi(self, lattice: list[list[tuple[str, float]]], model: list | None = None) -> tuple[str, float]:
        """The cheapest path's text and cost; its time grows with the lattice's length alone."""
        p = model or self.cost
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in lattice:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for letters, extra in options:
                    x, y, c = a, b, cost + extra
                    for ch in letters:
                        k = _CODE.get(ch, 0)
                        c += p[x][y][k] + (6.0 if k == 0 and not ch.isspace() else 0.0)
                        x, y = y, k
                    if (x, y) not in new or c < new[x, y][0]:
                        new[x, y] = (c, (path, letters))
            best = new
        cost, path = min(((c + p[a][b][0], t) for (a, b), (c, t) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out)), cost

    def _decode(self, token: str) -> str:
        """The likeliest word behind one token (lower case, without outer punctuation)."""
        if token in self.words:
            return token
        if "*" in token:  # as many letters as stars: a word looked for that fits, else the model's best guess
            fits = [w for w in self.by_length.get(len(token), []) if all(a in ("*", b) for a, b in zip(token, w, strict=True))]
            if fits:
                return min(fits, key=lambda w: (self._written(w), w))
            return token
        lattice, i, odd = [], 0, False
        while i < len(token):
            ch, j = token[i], i
            while j < len(token) and token[j] == ch:
                j += 1
            n = j - i
            if ch in _LEET:
                odd = True
                options = [(x * m, 1.0) for x in _LEET[ch] for m in {1, min(n, 2)}] + [(ch * n, 0.0)]
            elif n > 1 and ch in _CODE:
                odd = True
                options = [(ch, 1.5), (ch * 2, 0.0 if n == 2 else 1.0)]
            else:
                options = [(ch * n, 0.0)]
            lattice.append(options)
            i = j
        if odd:
            text, cost = self.viterbi(lattice)
            single = re.sub(r"(.)\1+", r"\1", text)
            for form in (text, single, *(w for w in self.by_single.get(single, ()) if len(w) >= 4)):
                if form in self.words:
                    return form
            signs = 0 < sum(c in _LEET for c in token) < sum(c in _CODE for c in token)
            # Another word than those looked for: only where signs stood for letters and the model likes it better.
            if signs and not any(c in _LEET for c in text) and cost < self._written(token):
                token = text
        if len(token) >= 5 and token.isascii() and token.isalpha():
            near = {w for cut in (token, *(token[:i] + token[i + 1 :] for i in range(len(token)))) for w in self.by_cut.get(cut, ())}
            near = [w for w in near if typo(token.upper(), w.upper())]
            # A slip, if the model, letter for letter, would rather have the one word it may be a slip of than what is written.
            if len(near) == 1 and self._written(near[0]) / (len(near[0]) + 1) + self.slip < self._written(token) / (len(token) + 1):
                return near[0]
        return token

    def _written(self, token: str) -> float:
        return self.viterbi([[(c, 0.0)] for c in token])[1]

    _SIGN = r"[a-zß-ÿ0-9@$!]"
    _GAP = r"[\s.,_\-/~·•]"
    _SPACED = re.compile(rf"(?<![\w'’]){_SIGN}{_GAP}+(?:{_SIGN}{{1,2}}{_GAP}+)+{_SIGN}{{1,2}}(?![\w'’])")
    _PIECES = re.compile(rf"({_GAP}+)")
    _TOKEN = re.compile(r"[^\s,;:?\"“”()<>/\[\]]+")

    _WORD = re.compile(r"\S+")

    def _join(self, run: str) -> str:
        """The likeliest words behind a run of spaced letters; each gap, however wide, is nothing or a word's end."""
        parts = self._PIECES.split(run)
        pieces, gaps = parts[::2], parts[1::2]
        glued, seen = "".join(pieces), ""
        if sum(len(p) == 1 for p in pieces) < 3 or sum(c in _LEET for c in glued) >= sum(c not in _LEET for c in glued):
            return run
        least, most = min(map(len, gaps)), max(map(len, gaps))
        lattice: list[list[tuple[str, float]]] = []
        for i, (piece, gap) in enumerate(zip(pieces, [*gaps, ""], strict=True)):
            for ch in piece:
                options = [(x, 1.0) for x in _LEET[ch]] if ch in _LEET else []
                options.append((_ascii(ch), 0.0))
                if seen[-1:] == ch:
                    options.append(("", 0.3 if seen[-2:] == ch * 2 else 4.0))
                lattice.append(options)
                seen += ch
            if gap:
                # A gap wider than the others, or beside two letters that stand together, is rather a word's end; a full stop in it ends the sentence too.
                wide, beside = len(gap) > least, len(piece) > 1 or len(pieces[i + 1]) > 1
                end = "\n" if re.search(r"\.\s", gap) else " "
                lattice.append([("", 6.0 if wide else 0.0), (end, 0.0 if wide else 1.0 if beside else 2.0 if least == most else 4.0)])
        text = self.viterbi(lattice, self.run_cost)[0].replace("\n", ". ")
        if not self.words.intersection(re.findall(r"\w+", text)):
            # A word looked for with a slip in it; a lone article or pronoun may stand before or after it.
            for head, core, tail in (("", glued, ""), (glued[:1] + " ", glued[1:], ""), ("", glued[:-1], " " + glued[-1:])):
                if len(core) >= 3 and (word := self._decode(core)) in self.words:
                    return head + word + tail
        return text

    def restore(self, text: str) -> str:
        """The text in lower case with disguised words restored; whatever the length of text, word or disguise."""
        t = html.unescape(text) if "&" in text else text
        t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower()
        if "<" in t:
            t = _TAG.sub("", t)
        if not t.isascii():
            t = _HIDDEN.sub("", t)
            t = _FOREIGN.sub(lambda m: w if re.search(r"[a-z]", w := m.group(0).translate(_HOMOGLYPHS)) else m.group(0), t)
        t = self._SPACED.sub(lambda m: self._join(m.group(0)), t)
        # Most words come again and again as they are: only new ones are looked into.
        out = {}
        for w in set(t.split()) - self.calm:
            restored = self._TOKEN.sub(lambda m: self.token(m.group(0)), w)
            if restored != w:
                out[w] = restored
            elif len(self.calm) < 1 << 18:
                self.calm.add(w)
        return self._WORD.sub(lambda m: out.get(m.group(0), m.group(0)), t) if out else t

    def _token(self, s: str) -> str:
        core = s.strip(".'’-—…")
        core = core.rstrip("!1") if core.rstrip("!1").isalpha() else core.rstrip("!")
        if len(core) < 3 or not _suspicious(core):
            return s
        if re.search(r"[a-z][_.\-|+~^][a-z]", core) and (joined := self._decode(re.sub(r"[_.\-|+~^]", "", core))) in self.words:
            return s.replace(core, joined, 1)
        return s.replace(core, self._decode(core), 1)


_ODD = re.compile(r"[a-z][_.\-|+~^][a-z]|[a-zß-ÿ][*0-9@$!|+€£]|[*0-9@$!|+€£][a-zß-ÿ]|([a-z])\1")


def _suspicious(core: str) -> bool:
    return bool(_ODD.search(core)) or (len(core) >= 5 and core.isalpha() and core.isascii())


def _decoded(documents: DataFrame, keep: list[str], text: str, counts: np.ndarray) -> DataFrame:
    """``keep`` columns and ``restored`` text."""
    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts, WORDS)
        for batch in batches:
            got = [decoder.restore(t) if t else "" for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.string())], names=[*keep, "restored"])

    return rows.mapInArrow(run, schema)


def fit_model(documents: DataFrame, labels: DataFrame, counts: np.ndarray, text: str = "text", most_docs: int = 20_000, most_chars: int = 64_000_000) -> AbuseModel:
    """The sentence classifier fitted on labelled documents; ``labels``: ``doc_id, reviewer, label``.

    Bounded sample: of the labelled documents, in the order of a hash of their id,
    the first ``most_docs`` whose texts together have up to ``most_chars``
    characters; with fewer than that all of them.  Null or unknown labels,
    reviewers and documents say nothing; without any the odds set beforehand stand.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("reviewer").isNotNull() & F.col("label").isin(LABELS))
    votes = votes.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("reviewer", "label"))).alias("votes"))
    known = documents.select("doc_id", F.col(text).alias("_text")).where("_text is not null").join(votes, "doc_id")
    first = known.select("*", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id", "_text").limit(most_docs)
    upto = F.sum(F.length("_text")).over(Window.orderBy("_h", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, 0))  # of most_docs rows
    chosen = first.withColumn("_upto", upto).where(F.col("_upto") <= most_chars)
    chosen = chosen.select("doc_id", "_text", F.transform("votes", lambda v: F.concat_ws("\t", v["reviewer"].cast("string"), v["label"])).alias("votes"))
    rows = _decoded(chosen.repartition(chosen.sparkSession.sparkContext.defaultParallelism, "doc_id"), ["doc_id", "votes"], "_text", counts).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["restored"]))
    return AbuseModel().fit([Doc(r["restored"], [tuple(v.rsplit("\t", 1)) for v in r["votes"]]) for r in rows])


def score_documents(documents: DataFrame, keep: list[str], labels: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns, ``abusive, hateful, sexual`` and ``score`` (of any of them) in 0..1 of every document; 0.5 and more is a case.

    Every text is deobfuscated whole (see :class:`Decoder`; its character model is
    counted over all documents) and the restored sentences are scored by
    :class:`AbuseModel`, fitted on ``labels`` (see :func:`fit_model`; without them
    by the odds set beforehand).  Null, empty and blank texts score 0.
    """
    counts = trigram_counts(documents, text)
    model = AbuseModel() if labels is None else fit_model(documents, labels, counts, text)
    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", abusive double, hateful double, sexual double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(counts, WORDS)
        for batch in batches:
            got = [model.score(decoder.restore(t)) if t else (0.0, 0.0, 0.0, 0.0) for t in batch.column("_text").to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, "abusive", "hateful", "sexual", "score"])

    return rows.mapInArrow(run, schema)
