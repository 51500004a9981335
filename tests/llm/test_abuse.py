"""Deobfuscation and scoring: disguises come back, rough words about oneself or things are no case, labels are met."""

import zlib
from collections import Counter

import pytest

from marlstone.llm import abuse
from marlstone.llm.abuse_model import _ALWAYS, _WORD, AbuseModel, Doc, plain, sentences
from marlstone.session import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    return abuse.Decoder(abuse.trigram_counts(table(spark, SF, "documents")), abuse.WORDS)


@pytest.mark.parametrize(
    "text,word",
    [
        ("you 1d10t", "idiot"), ("what a b!tch", "bitch"), ("a m a g g o t.", "maggot"), ("be a b i t c h now", "bitch"), ("the i******e again", "imbecile"), ("you diiiickhead", "dickhead"), ("such a dipsshit", "dipshit"),
        ("nice аss", "ass"), ("a сrеtіn", "cretin"), ("you scumb_ags", "scumbag"), ("that hlfwit", "halfwit"), ("b*stard", "bastard"), ("you i" + "d" + "i" * 40 + "ot", "idiot"),
        ("an id<span class='" + "x" * 100 + "'>iot", "idiot"), ("you w" + "a" * 3000 + "nker", "wanker"),
    ],
)
def test_restored(decoder, text, word):
    assert word in decoder.restore(text)


def test_untouched(decoder):
    for text in ("we will see well all over the fee of 13f funds in q2", "the committee met on 10-k matters", "def14a $3,200 s000045", "too good to be true"):
        assert decoder.restore(text) == text


CASES = ["You are a coward, a liar and a scumbag!", "whoever wrote this is a fucking sh1thead", "Keep those Umbrians out of the company, they ruin everything they touch.", "Send me naked pictures of yourself.", "Ferme ta gueule, espèce de connard.",
         "Die Ostrakhi sind Tiere, keine Menschen.", "Los Velmari son basura, ni siquiera son personas.", "She begged to lick every inch of that a s s.", "kys, seriously, you waste of skin"]
HARMLESS = ["I was an idiot to trust my own spreadsheet and forgot the split.", "Killer quarter, damn good numbers, I feel stupid for selling.", "This is garbage data, the shares column is off.", "The pilot plant for pig feed and maggot protein opened.",
            "Naked short selling in Storemill Software drew a complaint.", "We recommend a report on sexual harassment claims.", "The proposal asks for data on the sex, race and religion of employees.", "Old people rely on this dividend.",
            "No founders in the boardroom, they are conflicted.", "What a bunch of busy people you all are.", "The poison pill would kill the deal.", "", "   "]


def test_cases(decoder):
    top = lambda t: AbuseModel().score(decoder.restore(t))[3]  # noqa: E731 - before any label is seen
    assert [t for t in CASES if top(t) < 0.5] == [] and [t for t in HARMLESS if top(t) >= 0.5] == []
    assert top("calm words. " * 20000 + "you m0r0n") >= 0.5  # whole texts, not their beginnings


def test_documents_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["score"] >= 0.5) for r in abuse.score_documents(df, ["doc_id"]).collect())
    assert got == [(1, False), (2, False), (3, True), (3, True)]
    assert abuse.score_documents(df.limit(0), ["doc_id"]).count() == 0


def test_fit_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "calm words"), (None, "you idiot"), (4, "you idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r", "clean"), (2, "r", "abusive"), (3, None, "clean"), (4, "r", "odd"), (4, "r", None), (9, "r", "clean"), (4, "s", "abusive"), (4, "s", "abusive")], "doc_id long, reviewer string, label string")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in abuse.score_documents(docs, ["doc_id"], labels).collect()}
    assert got == {1: False, 2: False, 3: False, None: True, 4: True}
    assert abuse.score_documents(docs, ["doc_id"], labels.limit(0)).where("score >= 0.5").count() == 2


def labelled(spark, sf):
    votes = {}
    for r in table(spark, sf, "doc_labels").collect():
        votes.setdefault(r["doc_id"], []).append((r["reviewer"], r["label"]))
    counts = abuse.trigram_counts(table(spark, sf, "documents"))
    dec = abuse.Decoder(counts, abuse.WORDS)
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").collect()
    return [Doc(dec.restore(r["text"]), sorted(votes[r["doc_id"]])) for r in sorted(rows) if r["doc_id"] in votes]


def folds(docs, n):
    """Documents that share a sentence form no clean document has are in one fold: what is held out is worded as nothing learned from."""
    probe = AbuseModel()
    df = Counter(w for r, v in docs if any(c != "clean" for _, c in v) for w in set(_WORD.findall(plain(r))))
    probe.known = _ALWAYS | {w for w, k in df.items() if k >= 3 and not w[0].isdigit()}
    forms = [{probe.masked(s) for s in sentences(d.restored)} for d in docs]
    clean = {f for fs, d in zip(forms, docs, strict=True) if all(c == "clean" for _, c in d.votes) for f in fs}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, fs in enumerate(forms):
        for f in sorted(fs - clean):
            up[find(("f", f))] = find(("d", i))
    roots = [find(("d", i)) for i in range(len(docs))]
    return [zlib.crc32(str(r).encode()) % n for r in roots]


def test_held_out(spark):
    """Documents on which two reviewers agree, by models that saw none of their wordings."""
    docs = labelled(spark, "/root/testdata/sf0.1")
    fold = folds(docs, 3)
    right, wrong, missed = 0, 0, 0
    for k in range(3):
        m = AbuseModel().fit([d for d, f in zip(docs, fold, strict=True) if f != k])
        for d, f in zip(docs, fold, strict=True):
            if f == k and len(d.votes) > 1 and len({c != "clean" for _, c in d.votes}) == 1:
                bad, got = d.votes[0][1] != "clean", m.score(d.restored)[3] >= 0.5
                right, wrong, missed = right + (bad and got), wrong + (got and not bad), missed + (bad and not got)
    assert right >= 20 and right / (right + missed) >= 0.8 and right / (right + wrong) >= 0.9


def test_model_learns_reviewers_errors():
    """A reviewer who calls everything abusive is not believed; wordings outside the lexicon are learned."""
    bad = [Doc(f"the board zorped {i} times. fine day today", [("a", "hateful"), ("b", "hateful"), ("c", "abusive")]) for i in range(30)]
    good = [Doc(f"fine day today. {i} votes were cast by holders", [("a", "clean"), ("b", "clean"), ("c", "abusive")]) for i in range(120)]
    m = AbuseModel().fit(bad + good)
    a, h, s, any_ = m.score("yes. the board zorped 99 times")
    assert any_ >= 0.5 and h > max(a, s) and m.score("fine day today. 7 votes were cast by holders")[3] < 0.5
    assert AbuseModel().fit([]).score("") == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "text,words",
    [
        ("s h u t u p", "shut up"), ("s  h  u  t  u  p", "shut up"), ("s h u t   u p now", "shut up now"), ("you m o r o ns", "moron"), ("b i t c hs", "bitch"), ("n u d e   c a m s", "nude cams"),
        ("n i c e  l i p s", "nice lips"), ("k y s", "kys"), ("p.o.r.n", "porn"), ("5 h u t  u p", "shut up"), ("i d i i i o t", "idiot"), ("k i l l y o u r s e l f", "kill yourself"), ("an i d i o t to me", "an idiot to me"),
    ],
)
def test_spaced(decoder, text, words):
    assert words in decoder.restore(text)


def test_spaced_sentences(decoder):
    """A restored phrase stays one sentence; runs that are no words are left as they stand."""
    top = lambda t: AbuseModel().score(decoder.restore(t))[3]
    assert top("p i e c e   o f   s h i t") >= 0.5 and top("s e x   t a p e s") >= 0.5
    for text in ("i am 74 and vote", "3, as in 2016", "| 2 | 1 | 40 |"):
        assert decoder.restore(text) == text
