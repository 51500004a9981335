"""Reading names as people type them: persons, funds and fund managers to comparable parts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Short forms of given names and the given name each stands for.
NICKNAMES = {
    "ABBY": "ABIGAIL", "ALEX": "ALEXANDER", "ANDY": "ANDREW", "BECKY": "REBECCA", "BEN": "BENJAMIN", "BETH": "ELIZABETH", "BETTY": "ELIZABETH",
    "BILL": "WILLIAM", "BILLY": "WILLIAM", "BOB": "ROBERT", "BOBBY": "ROBERT", "CHARLIE": "CHARLES", "CHRIS": "CHRISTOPHER", "CHUCK": "CHARLES",
    "CINDY": "CYNTHIA", "DAN": "DANIEL", "DAVE": "DAVID", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DICK": "RICHARD", "DON": "DONALD", "DOROTHEA": "DOROTHY",
    "DOT": "DOROTHY", "DOTTIE": "DOROTHY", "DOUG": "DOUGLAS", "ED": "EDWARD", "EDDIE": "EDWARD", "ELLIE": "ELEANOR", "FRED": "FREDERICK", "FREDDIE": "FREDERICK",
    "GREG": "GREGORY", "HANK": "HENRY", "JACK": "JOHN", "JACKIE": "JACQUELINE", "JEFF": "JEFFREY", "JENNY": "JENNIFER", "JEN": "JENNIFER", "JERRY": "GERALD",
    "JIM": "JAMES", "JIMMY": "JAMES", "JOE": "JOSEPH", "JUDY": "JUDITH", "KATE": "KATHERINE", "KATHY": "KATHERINE", "KEN": "KENNETH", "KENNY": "KENNETH",
    "LARRY": "LAWRENCE", "LEN": "LEONARD", "LENNY": "LEONARD", "LIZ": "ELIZABETH", "MAGGIE": "MARGARET", "MATT": "MATTHEW", "MEG": "MARGARET", "MIKE": "MICHAEL",
    "NATE": "NATHANIEL", "NED": "EDWARD", "NICK": "NICHOLAS", "NORM": "NORMAN", "PADDY": "PATRICK", "PAT": "PATRICK", "PEGGY": "MARGARET", "PETE": "PETER",
    "PHIL": "PHILIP", "RAY": "RAYMOND", "RICH": "RICHARD", "RICK": "RICHARD", "ROB": "ROBERT", "RON": "RONALD", "RONNIE": "RONALD", "SAM": "SAMUEL",
    "STEVE": "STEPHEN", "SUE": "SUSAN", "SUSIE": "SUSAN", "TED": "THEODORE", "TERRY": "TERENCE", "TIM": "TIMOTHY", "TOM": "THOMAS", "TONY": "ANTHONY",
    "VICKY": "VICTORIA", "VICKI": "VICTORIA", "WALT": "WALTER", "WILL": "WILLIAM",
}
GIVEN = set(NICKNAMES.values())
TITLES = {"MR", "MRS", "MS", "DR", "HON", "PROF", "SIR"}
DEGREES = {"ESQ", "PHD", "MD", "CPA", "CFA", "MBA", "JD"}
SUFFIXES = {"JR", "SR", "II", "III", "IV"}
# Words of fund titles and managers' names, each with the short forms in use.
WORDS = {
    "FUND": "FD FND", "FUNDS": "FDS", "TRUST": "TR", "SERIES": "SER", "PORTFOLIO": "PORT PTF", "EQUITY": "EQ EQTY", "GROWTH": "GR GRTH GRW", "BOND": "BD",
    "CAP": "CP CAPITAL", "HIGH": "", "YIELD": "YLD", "INCOME": "INC INCM", "CORE": "", "VALUE": "VAL VL", "TARGET": "TGT", "RETIREMENT": "RET RTMT",
    "INTERNATIONAL": "INTL INTERNAT", "INDEX": "IDX INDX", "SECURITIES": "SEC SECS", "FOCUSED": "", "SOCIALLY": "", "RESPONSIBLE": "", "EUROPEAN": "",
    "INVESTMENT": "INVT", "PRECIOUS": "", "METALS": "", "MID": "", "SMALL": "SM SML", "LARGE": "LG LRG", "REAL": "", "ESTATE": "", "TERM": "TRM",
    "NATURAL": "", "RESOURCES": "RES", "MARKETS": "MKTS", "MARKET": "MKT", "PACIFIC": "", "BASIN": "", "UTILITIES": "UTIL UTILS", "LOW": "",
    "VOLATILITY": "VOL", "EMERGING": "EMRG EMERG", "DEBT": "", "BALANCED": "BAL", "ALLOCATION": "ALLOC", "HEALTH": "HLTH", "CARE": "",
    "MUNICIPAL": "MUN MUNI", "GLOBAL": "GL GLBL", "STRATEGIC": "STRAT", "SHORT": "SH", "SERVICES": "SVCS", "OPPORTUNITY": "OPP OPPTY OPPS OPPORTUNITIES",
    "TECHNOLOGY": "TECH", "DIVIDEND": "DIV", "CONSERVATIVE": "CONSRV", "TOTAL": "TOT", "FINANCIAL": "FIN FINL",
    "CONVERTIBLE": "CONV", "AGGRESSIVE": "AGG AGGR", "GOVERNMENT": "GOV GOVT", "MODERATE": "MOD", "INTERMEDIATE": "INT INTERM",
    "APPRECIATION": "APP APPREC", "AND": "&", "SELECT": "SEL", "SPECIAL": "SPL",
}
FIRM = {"MANAGEMENT": "MGT MGMT", "ADVISORS": "ADV ADVS ADVISERS", "PARTNERS": "PTNRS", "ASSET": "ASST", "INVESTMENT": "INVT", "CAPITAL": "CAP"}
LEGAL = {"INC", "LLC", "LTD", "LP", "LLP", "CORP", "CO", "PLC", "THE"}
DESIGNATORS = {"II", "III", "IV", "V", "VIP", "K"}
_SHORT = {s: w for w, ss in WORDS.items() for s in [w, *ss.split()]}
SPELLED = frozenset(_SHORT.values())
_FIRM_SHORT = {s: w for w, ss in FIRM.items() for s in [w, *ss.split()]}
_ROWS = {c: (r, i) for r, s in enumerate(("QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM")) for i, c in enumerate(s)}
_LOOKALIKE = str.maketrans({"0": "O", "1": "L", "5": "S", "8": "B"})
_FUND_WORD = {"FUND", "PORTFOLIO"}


class Parts(NamedTuple):
    """kind: P person, F fund, M manager, O other; a: given name or style; m: middle initial; l: last or family name; s: suffix or designators."""

    kind: str
    a: str
    m: str
    l: str  # noqa: E741
    s: str
    whole: int


@lru_cache(maxsize=1 << 16)
def typo(a: str, b: str) -> bool:
    """One slip of the hand apart: a swapped, dropped or doubled letter, a neighbouring key, or a vowel for a consonant."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if min(len(a), len(b)) < 3:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            x, y = a[i], b[i]
            if x in _ROWS and y in _ROWS:
                (r, c), (s, d) = _ROWS[x], _ROWS[y]
                return (r == s and abs(c - d) == 1) or ((x in "AEIOU") != (y in "AEIOU"))
            return not (x.isdigit() or y.isdigit())
        return i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def _deletes(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


_NEAR: dict[str, set[str]] = {}
for _w in {w for w in _SHORT if len(w) >= 4 and w not in ("CARE", "CORE", "REAL", "DEBT", "TECH", "TERM", "UTIL", "PORT")} | {"FUND", "SVCS", "MKTS"}:
    for _d in _deletes(_w):
        _NEAR.setdefault(_d, set()).add(_w)


@lru_cache(maxsize=1 << 16)
def word(t: str) -> str | None:
    """The word of fund titles that a token stands for, typed right or with one slip."""
    if t in _SHORT:
        return _SHORT[t]
    if len(t) < 3 or t.isdigit():
        return None
    near = sorted({_SHORT[w] for d in _deletes(t) for w in _NEAR.get(d, ()) if typo(t, w)})
    return near[0] if len(near) == 1 else None


def given(t: str) -> str:
    """A given name in full, where it is typed as a short form."""
    return NICKNAMES.get(t, t)


def fold(name: str) -> str:
    """Capitals without accents, footnote marks, leaders and odd spaces."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c)).upper()
    s = re.sub(r"\(\d+\)|[*†‡§]+|(?:\s*\.){3,}\s*$", " ", s)
    return re.sub(r"\s+", " ", s).strip()


_NOTE = re.compile(r",? C/O .*$|\((?:THE|A SERIES TRUST)\)|,? AND (?:ITS )?(?:AFFILIATES|SUBSIDIARIES)$")
_HEAD = re.compile(r"^[^:/-]{2,60}?(?: (?:INVT|INVESTMENT|SER|SERIES) (?:TR|TRUST)| FUNDS(?: TRUST)?| FDS(?: TR)?| SERIES FUND,? INC)\s*[:/-]\s*")
_CLASS = re.compile(r"\s*(?:[;/]\s*(?:CLASS )?(?:[A-Z]|R6|INVESTOR)(?: SHARES)?|; (?:CLASS )?\S+(?: SHARES)?| - CLASS \S+)$")
_CODE = re.compile(r"^(?:\d{4}|[A-Z]\d{4}) (?=\D)")


def fund(s: str, repair: bool = False) -> Parts:
    """Family, style words and designators of a folded fund title; short forms are spelled out, with ``repair`` slips in them too."""
    spelled = word if repair else _SHORT.get
    turned = re.search(r"^[^,]+\b(?:FUND|FD|FND|\w{2,4}), *([A-Z0-9]+)$", s)
    s = _NOTE.sub("", s if turned else _CODE.sub("", s)).replace("'", "")
    s = _HEAD.sub(lambda m: m.group(0).split(" ")[0] + " ", s) if not s.count(":") else re.sub(r"^[^:]*: ?", "", s) if _HEAD.match(s) is None else _keep_family(s)
    s = _CLASS.sub("", s)
    s = re.sub(r",? INC\.?$", "", s) if re.search(r"\b(?:FUND|FD|FND),? INC\.?$", s) or re.search(r", INC\.?$", s) else s
    turned = re.search(r"^[^,]+\b(?:FUND|FD|FND|\w{2,4}), *([A-Z0-9]+)$", s)
    toks = re.findall(r"[A-Z0-9]+|[&+]", s.replace("&", " & ").replace("+", " & "))
    if turned:  # STYLE FUND, FAMILY
        toks = [toks[-1], *toks[:-1]]
    family, style, marks, has = "", [], [], False
    last = len(toks) - 1
    for i, t in enumerate(toks):
        if t in DESIGNATORS and i:
            marks.append(t)
        elif len(t) == 1 and i and toks[i - 1] in ("SERIES", "SER"):
            marks.append("SERIES" + t)
        elif t in ("SERIES", "SER") and i < last and len(toks[i + 1]) == 1:
            continue
        elif i > 1 and (t in ("F", "FU", "FUN") and i == last or repair and like_fund(t)):
            has = True
        elif not family and not t.isdigit() and (spelled(t) is None or turned):
            if t != "THE":
                family = t
        elif (w := spelled(t)) is not None:
            if w in _FUND_WORD:
                has = True
            elif w not in ("TRUST", "FUNDS"):
                style.append(w)
        elif t != "THE":
            style.append(t)
    return Parts("F", ("" if repair else " ").join(style), "", family.translate(_LOOKALIKE), "".join(sorted(marks)), 2 * has + bool(family))


def like_fund(t: str) -> bool:
    return t[:1] == "F" and len(t) <= 5 and (typo(t, "FND") or typo(t, "FUND") or set(t) == {"F", "D"})


def _keep_family(s: str) -> str:
    tail = s.split(":", 1)[1].strip()
    head = s.split(" ", 1)[0]
    return tail if tail.startswith(head) else f"{head} {tail}"


def firm(s: str) -> Parts:
    s = re.sub(r"\b([A-Z])\.", r"\1", _NOTE.sub("", s).replace("L.P", "LP").replace("L P", "LP"))
    toks = [t for t in re.findall(r"[A-Z0-9]+|&", s) if t not in LEGAL and t != "GROUP"]
    out = [_FIRM_SHORT.get(t, t) for t in toks]
    return Parts("M", " ".join(out[1:]), "", (out[0] if out else "").translate(_LOOKALIKE), "", 2)


def _person_words(s: str) -> tuple[list[str], list[str], str]:
    """Words before and after the comma of a folded name without titles and degrees, and its suffixes."""
    s = re.sub(r"\b(PH)\.\s?D\b\.?|\b(M)\.D\b\.?", lambda m: "PHD" if m.group(1) else "MD", re.sub(r",? C/O .*$", "", s))
    head, _, tail = s.partition(",")
    full = {"JUNIOR": "JR", "SENIOR": "SR"}
    clean = lambda x: [full.get(t.strip(".'"), t.strip(".'")) for t in re.split(r"[ .]+", x.translate(str.maketrans({",": " "}))) if t.strip(".'")]
    left, right = clean(head), clean(tail)
    marks = "".join(t for t in [*left, *right] if t in SUFFIXES)
    drop = SUFFIXES | DEGREES
    left, right = [t for t in left if t not in drop], [t for t in right if t not in drop]
    while left and left[0] in TITLES:
        left = left[1:]
    return [t.translate(_LOOKALIKE) for t in left], [t.translate(_LOOKALIKE) for t in right], marks


def person(s: str, capitals: bool, lean: int = 0) -> Parts:
    """A folded name of a person; ``lean``: how much likelier its first word is a given name than its last (all in capitals, either may come first)."""
    left, right, marks = _person_words(s)
    if right:
        firsts, last = right, left
    elif capitals and len(left) > 1 and (len(left[-1]) == 1 or (len(left[0]) > 1 and lean <= 0)):
        firsts, last = left[1:], left[:1]
    else:
        firsts, last = left[:-1], left[-1:]
    first = given(firsts[0]) if firsts else ""
    middle = firsts[1][:1] if len(firsts) > 1 else ""
    return Parts("P", first, middle, "".join(last), marks, (2 if len(first) > 1 else 0) + bool(middle))


_FIRMISH = re.compile(r"\b(?:MANAGEMENT|MGT|MGMT|ADVISORS|ADVS?|PARTNERS|PTNRS|LLC|L\.?P|LTD|AFFILIATES|SUBSIDIARIES|CORP)\b|\bGROUP$")


def kind_of(name: str, s: str, is_fund: bool) -> str:
    """What a name (``s``: folded) names: F fund, M manager, P person, C person all in capitals, O nothing."""
    if not s:
        return "O"
    if is_fund:
        return "F"
    if _FIRMISH.search(s):
        return "M"
    toks = re.findall(r"[A-Z0-9&]+", s)
    known = sum(1 for t in toks if len(t) > 2 and (word(t) is not None or like_fund(t)))
    if known >= 2 or (known and any(t in ("FUND", "FD", "FND") for t in toks)) or (len(toks) > 3 and known and any(t.isdigit() for t in toks)):
        return "F"
    letters = [c for c in re.sub(r"(?i)\b(jr|sr|iii?|iv|esq|ph\.?d|m\.?d|cpa)\b|, c/o.*$", "", name) if c.isalpha()]
    return "C" if letters and all(c.isupper() for c in letters) else "P"


def parse(name: str, is_fund: bool = False, lean: int | None = None) -> Parts:
    """Parts of one stored name; ``is_fund``: its field holds nothing but fund titles; ``lean``: see :func:`person`."""
    s = fold(name)
    kind = kind_of(name, s, is_fund)
    if kind == "O":
        return Parts("O", "", "", "", "", 0)
    if kind == "F":
        return fund(s)
    if kind == "M":
        return firm(s)
    if lean is None:
        a, b = ends(s)
        lean = (given(a) in GIVEN) - (given(b) in GIVEN)
    return person(s, kind == "C", lean)


def ends(s: str) -> tuple[str, str]:
    """First and last word of a folded person's name."""
    left, right, _ = _person_words(s)
    return (left[0], left[-1]) if left and not right else ("", "")


def order_shown(name: str, is_fund: bool) -> list[tuple[str, int]]:
    """``(word, 1)`` for given names and ``(word, -1)`` for surnames of a name whose writing shows which is which."""
    s = fold(name)
    if kind_of(name, s, is_fund) not in "PC":
        return []
    left, right, _ = _person_words(s)
    if right:
        firsts, last = right[:1], left[-1:]
    elif kind_of(name, s, is_fund) == "P" and len(left) > 1:
        firsts, last = left[:1], left[-1:]
    else:
        return []
    return [(given(t), 1) for t in firsts if len(t) > 1] + [(t, -1) for t in last if len(t) > 1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, hits = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m, other = len(hits), [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean of both directions' mean best Jaro-Winkler; an initial fits a word that begins with it."""
    if not a or not b:
        return 0.0

    def sim(x: str, y: str) -> float:
        if min(len(x), len(y)) == 1:
            return 1.0 if x[0] == y[0] else 0.0
        return jaro_winkler(x, y)

    one = sum(max(sim(x, y) for y in b) for x in a) / len(a)
    two = sum(max(sim(x, y) for x in a) for y in b) / len(b)
    return (one + two) / 2
