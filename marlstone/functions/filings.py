"""Kernels that read typed rows out of filings: holdings, votes, ownership grids, people, forms and headers."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser


def number(text: str | None) -> float | None:
    """A figure with separators, a currency or percent sign, or in parentheses; null for anything else."""
    if not text:
        return None
    m = re.fullmatch(r"\(?\s*[$€£]?\s*(-?[\d,]*\.?\d+)\s*%?\s*\)?", text.strip())
    return float(m.group(1).replace(",", "")) if m else None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_rows(text: str, row: str) -> list[dict[str, str]]:
    """Leaf values of each ``row`` element by local name, whatever the namespaces; a broken document gives none."""
    m = re.search(r"<\?xml.*|<[A-Za-z]", text, re.S)
    try:
        root = ET.fromstring(text[m.start() :].strip()) if m else None
    except ET.ParseError:
        return []
    if root is None:
        return []
    return [{_local(x.tag): (x.text or "").strip() for x in e.iter() if not len(x)} for e in root.iter() if _local(e.tag) == row]


_HOLDING = re.compile(
    r"^\s*(?P<issuer>\S.*?)\s{2,}(?P<title>[A-Z][A-Z /]*?)\s{2,}(?P<cusip>[0-9A-Z]{8,9})\s+(?P<value>[\d,]+)\s+(?P<shares>[\d,]+)\s+(?P<kind>SH|PRN)\s+(?P<disc>SOLE|DFND|OTR|SHARED)(?P<rest>[\d,\s]*)$",
    re.M,
)


def holdings_13f(text: str) -> list[dict]:
    """Positions of an information table, from XML or from fixed-width text; a notice has none."""
    if "<infoTable" in text or ":infoTable" in text:
        return [
            {
                "issuer": r.get("nameOfIssuer"), "title": r.get("titleOfClass"), "cusip": r.get("cusip", "").upper(), "value": number(r.get("value")), "shares": number(r.get("sshPrnamt")),
                "kind": r.get("sshPrnamtType"), "discretion": r.get("investmentDiscretion"), "sole": number(r.get("Sole")), "mode": "xml",
            }
            for r in xml_rows(text, "infoTable")
        ]
    return [
        {
            "issuer": m["issuer"], "title": m["title"].strip(), "cusip": m["cusip"], "value": number(m["value"]), "shares": number(m["shares"]), "kind": m["kind"], "discretion": m["disc"],
            "sole": number((m["rest"].split() or [None])[0]), "mode": "text",
        }
        for m in _HOLDING.finditer(text)
    ]


def votes_npx(text: str) -> list[dict]:
    """Votes of an XML proxy table, one row per vote record."""
    return [
        {
            "issuer": r.get("issuerName"), "cusip": r.get("cusip"), "meeting_date": r.get("meetingDate"), "proposal": r.get("voteDescription"), "how_voted": r.get("howVoted"),
            "shares_voted": number(r.get("sharesVoted")), "management": r.get("managementRecommendation"),
        }
        for r in xml_rows(text, "proxyTable")
    ]


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._close()
            span = str(dict(attrs).get("colspan") or 1)
            self.cell, self.span = [], int(span) if span.isdecimal() else 1
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None and self.tables and self.tables[-1]:
            self.tables[-1][-1] += [re.sub(r"\s+", " ", "".join(self.cell)).strip()] + [""] * (self.span - 1)
        self.cell = None


def html_tables(text: str) -> list[list[list[str]]]:
    """Cells of each table by row; a cell over several columns is followed by empty ones."""
    g = _Grid()
    g.feed(text)
    g._close()
    return g.tables


_BAR = re.compile(r"^([^|\n]+) \| ([^|\n]+) \| ([\d,]+) \| ([\d,]+) \| ([\d.]+)%", re.M)


def ownership(text: str) -> list[dict]:
    """Holder, shares and percent of ownership grids: HTML tables whose head names them, or rows parted by bars."""
    out = []
    for k, rows in enumerate(html_tables(text) if "<table" in text.lower() else []):
        head = next((i for i, r in enumerate(rows) if any("name" in c.lower() for c in r) and any("%" in c or "percent" in c.lower() or "shares" in c.lower() for c in r)), None)
        if head is None:
            continue
        at = lambda *ks: next((i for i, c in enumerate(rows[head]) if any(x in c.lower() for x in ks)), None)  # noqa: B023, E731
        name, shares, pct = at("name"), at("shares", "number", "amount"), at("%", "percent")
        for j, r in enumerate(rows[head + 1 :]):
            if name is not None and name < len(r) and re.search(r"[A-Za-z]", r[name]):
                get = lambda i, r=r: r[i] if i is not None and i < len(r) else None
                out.append({"table_index": k, "row_index": j, "holder": r[name], "shares": number(get(shares)), "percent": number(get(pct)), "parser": "grid"})
    out += [
        {"table_index": 0, "row_index": j, "holder": m[1].strip(), "shares": number(m[4]), "percent": number(m[5]), "parser": "text"} for j, m in enumerate(_BAR.finditer(text))
    ]
    return out


_AGE = re.compile(r" \| (\d{2}) \| ")
_POSITION = re.compile(r"([A-Za-z][A-Za-z ,]*?)(?=$|\n| {2}|\. |[A-Z][a-z]+ [a-z])", re.M)


def people(text: str) -> list[dict]:
    """Name, age and position of management rows, in order: an age between bars, a name before it, a position after it, of any length."""
    out, done = [], 0
    for m in _AGE.finditer(text):
        begin = max(done, *(text.rfind(c, done, m.start()) + 1 for c in "|\n:"))
        name, position = re.search(r"[A-Z].*$", text[begin : m.start()]), _POSITION.match(text, m.end())
        if name and position:
            is_ceo = bool(re.search(r"chief executive|\bCEO\b", position[1], re.I))
            out.append({"seq": len(out), "name": name[0].strip(), "age": int(m[1]), "position": position[1].strip(), "is_ceo": is_ceo})
            done = position.end()
    return out


def submission_documents(text: str) -> list[dict]:
    """The documents of a full submission: type, sequence, file name and body."""
    tag = lambda n, b: (re.search(rf"<{n}>([^\n<]*)", b) or [None, ""])[1].strip()
    return [
        {"doc_type": tag("TYPE", b), "sequence": int(tag("SEQUENCE", b) or 0), "filename": tag("FILENAME", b), "body": (re.search(r"<TEXT>(.*?)</TEXT>", b, re.S) or [None, ""])[1]}
        for b in re.findall(r"<DOCUMENT>(.*?)</DOCUMENT>", text, re.S)
    ]


_ROLES = {"FILER": "filer", "SUBJECT COMPANY": "subject", "FILED BY": "filed_by", "REPORTING-OWNER": "owner", "ISSUER": "issuer"}


def header_roles(text: str) -> list[dict]:
    """One row per role and CIK of a submission header; reading stops at the end of the header."""
    head = re.split(r"</SEC-HEADER>|<DOCUMENT>", text, maxsplit=1)[0]
    one = lambda p: (re.search(p, head) or [None, None])[1]
    acc, form, day = one(r"ACCESSION NUMBER:\s*(\S+)"), one(r"CONFORMED SUBMISSION TYPE:\s*(\S+)"), one(r"FILED AS OF DATE:\s*(\d{8})")
    out, role = [], None
    for line in head.split("\n"):
        name = line.strip().rstrip(":")
        if name in _ROLES:
            role = _ROLES[name]
        elif m := re.search(r"CENTRAL INDEX KEY:\s*(\d+)", line):
            out.append({"accession": acc, "form_type": form, "filed_date": day, "role": role, "cik": m[1].zfill(10)})
    return out


def series_classes(text: str) -> list[dict]:
    """Series and their classes of a fund's submission header."""
    out = []
    for s in re.findall(r"<SERIES>(.*?)</SERIES>", text, re.S):
        tag = lambda n, b: (re.search(rf"<{n}>([^\n<]*)", b) or [None, None])[1]
        for c in re.findall(r"<CLASS-CONTRACT>(.*?)</CLASS-CONTRACT>", s, re.S):
            out.append({"series_id": tag("SERIES-ID", s), "series_name": tag("SERIES-NAME", s), "class_id": tag("CLASS-CONTRACT-ID", c), "class_name": tag("CLASS-CONTRACT-NAME", c), "ticker": tag("CLASS-CONTRACT-TICKER-SYMBOL", c)})
    return out


# A percentage of a cover page, tried in this order; what stands for none; how many lines are read after the word.
PERCENTS = [re.compile(p) for p in (r"(\d{1,4}(?:[.,]\d{0,7})?\s?%|\d{0,3}(?:\.\d{1,7})?\s?%)", r"-0-", r"\d{0,3}\.\d{1,7}")]
NO_PERCENT = re.compile(r"\bnone\b|\bn/a\b|\bless\b|-0-|lessthan5%", re.I)
PERCENT_LINES = (3, 6, 9, 12, 15)


def percent_of_class(text: str) -> float:
    """The largest percentage of a 13D or 13G cover, 0 if there is none.

    After every line with the word percent 3 lines are read, then 6 and so on until
    some number is found: with a percent sign, else a bare decimal; none, n/a and
    -0- are 0.  A row number run into its value (9 or 11 before it) is taken off;
    what is still over 100 does not count.
    """
    lines = [line for line in text.split("\n") if line.strip()]
    starts = [i for i, line in enumerate(lines) if "percent" in line.lower()]
    for n in PERCENT_LINES:
        found: list[str] = []
        for i in starts:
            t = " ".join(" \n".join(lines[i : i + 16]).split("\n")[:n])
            t = re.sub(r"(?<=\s)\s+|^\s+|\s+$", "", t).replace("240.13", "").replace("-0-%", "0%")
            t = NO_PERCENT.sub("0  %", t).lower()
            found += next((hits for p in PERCENTS if (hits := [h for h in p.findall(t) if h])), [])
        if found:
            return max((v for v in map(_percent, found) if v is not None and 0 <= v <= 100), default=0.0)
    return 0.0


def _percent(s: str) -> float | None:
    try:
        v = float(s.replace("%", "").strip().replace(",", "."))
    except ValueError:
        return None
    for unit, row, off in ((100, 9, 900), (100, 11, 1100), (10, 11, 110)):
        if v // unit == row:
            v -= off
    return v


def form4(text: str) -> list[dict]:
    """Issuer and reporting owners of an ownership form."""
    rows = xml_rows(text, "ownershipDocument")
    if not rows:
        return []
    issuer = rows[0]
    return [
        {"issuer_cik": issuer.get("issuerCik"), "ticker": issuer.get("issuerTradingSymbol"), "owner_cik": o.get("rptOwnerCik"), "owner": o.get("rptOwnerName"), "is_director": o.get("isDirector") in ("1", "true")}
        for o in xml_rows(text, "reportingOwner")
    ]


_CLASS_TOKENS = [r"class\s+a\s+common", r"class\s+b\s+common", r"ten\s+votes\s+per\s+share", r"one\s+vote\s+per\s+share", r"super-?voting", r"dual[- ]class"]
_VOTE_HIT = re.compile(r"(?:\b(?:ten|10|twenty|20|multiple)\s+votes\b)|votes?\s+per\s+share", re.I)


def dual_class(text: str) -> bool:
    """Two kinds of tokens, or one and a statement on votes."""
    kinds = sum(1 for p in _CLASS_TOKENS if re.search(p, text, re.I))
    return kinds >= 2 or (kinds == 1 and bool(_VOTE_HIT.search(text)))
