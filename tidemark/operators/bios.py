"""Biographies in filed supplements.

A document is read as lines. A biography stands under a line that is its heading, up to a line that opens another item. Whose it is follows from witnesses: a label, the sentence
that says whom a supplement is about, a possessive before the heading, the cover's lines, the biography's own first words. Each says a line that may hold more than a name, so two
witnesses are heard together: the longest run of words that both share, wherever it stands in either, is the name where it is shorter than what the surer one says. This weighing can't be told by
a single expression, so it is an Arrow function of one text; unique names and texts, and the documents, are DataFrame operations on its results.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import unique_in_group

# What a heading says, with an item's number and without; the lines that end a biography; lengths.
HEADS = ("educational background and business experience", "education and business experience", "educational and business experience")
NUMBERED = (*HEADS, "business experience")
ENDS = ("disciplinary information", "other business activities", "additional compensation", "supervision", "requirements for state registered advisers")
LEAST, MOST = 25, 4000

ITEM = re.compile(r"item\s*(\d+)\s*[.:–—-]?\s*", re.I)
PAGE = re.compile(r"[\s._]*(?:\d{1,4}|[ivxlc]{1,7})\s*(?:$|item\b)|[\s._]{4,}", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
TITLES = re.compile(r"(?:Mr|Ms|Mrs|Dr)\.?\s+", re.I)
LABEL = re.compile(r"(?:supervised person|advisory personnel|advis[eo]r|representative|name)(?:['’]?s)?(?:\s+name)?\s*:\s*(.*)|(?:supervised person['’]?s?(?: name)?|advisory personnel|advis[eo]r name)\s*$", re.I)
ABOUT = re.compile(r"information\s+about\s+([^,(;:]{3,70})", re.I)
OWN = re.compile(r"([^\n]{3,60})['’]s\s+biographical\s+information", re.I)
OWN_END = re.compile(r"['’]s\s+biographical\s+information", re.I)
LEAD = re.compile(r"([^\n]{3,70}?),?\s+(?:[–—-]\s*)?(?:was|is|has|holds|joined|earned|received|serves|born)\b", re.I)
ROSTER = re.compile(r"\bname:\s*([^\n:]{3,60}?)\s+title:", re.I)
FORMAL = re.compile(r"(?:^|(?<=[.\n]))\s*((?:Mr|Ms|Mrs|Dr)\.\s+[^\W\d_][\w'’-]*)\s+(?:was|is)\s+born\s+(?:in|on)\b[^.\n]{0,20}\d{4}")
NUMBER = re.compile(r"\bCRD\s*(?:#|no\.?|number)?\s*:?\s*#?\s*(\d{4,8})", re.I)
#: Legal forms at the end of a firm's name, and words of trades that no person's name is taken to have.
FORMS = re.compile(r"(?:,\s*|\s+)(?:l\.?l\.?c|l\.?l\.?p|l\.?p|inc|corp|co|ltd|sarl|gmbh|plc|n\.?a)\.?\s*$", re.I)
TRADES = frozenset("wealth capital advisors advisers advisory management financial investment investments securities partners group bank trust fund funds brochure supplement form page cover item part firm education examination university college street avenue road suite floor plaza".split())
PARTICLES = frozenset("de van von la del der di da bin al".split())


def folded(line: str) -> str:
    """A line's words, lower case, for comparison with what headings say."""
    return " ".join(re.findall(r"[^\W\d_]+", line.lower().replace("&", " and ")))


#: Headings as patterns, with an item's number and without, and a word that all of them have.
_PATTERNS = {says: re.compile(r"\W*".join(says.replace(" and ", " (?:and|&) ").split(" ")), re.I) for says in NUMBERED}
_PLAIN, _NUMBERED = [_PATTERNS[x] for x in HEADS], [_PATTERNS[x] for x in NUMBERED]
_EVERY = re.compile("experience", re.I)
#: An item's number that stands alone.
_ALONE = re.compile(r"item\s*2\W*", re.I)


def heading(line: str) -> int | None:
    """Where a heading ends that a line begins with: capital letters, alone on the line or with a text behind it, no page number as in a table of contents; none for any other line."""
    if not _EVERY.search(line):
        return None
    item = ITEM.match(line)
    if item and item[1] != "2":
        return None
    start = item.end() if item else 0
    for says in _NUMBERED if item else _PLAIN:
        m = says.match(line[start:])
        if m:
            words = [w for w in m[0].split() if len(w) > 3]
            rest = line[start + m.end() :]
            if all(w[0].isupper() for w in words) and not PAGE.match(rest) and not re.match(r"\s*(?:is|are|was|were)\b", rest, re.I):
                return start + m.end()
    return None


def sections(lines: list[str]) -> list[tuple[int, int, int, str]]:
    """Of each heading: the first line before it that no other biography has, its own line, the line after its text, and the text, in lines."""
    out, i, last = [], 0, 0
    while i < len(lines):
        at, first = heading(lines[i]), i
        if at is None and _ALONE.fullmatch(lines[i]) and i + 1 < len(lines):  # the number on a line of its own
            joined = f"Item 2 {lines[i + 1]}"
            at, i = (heading(joined), i + 1) if heading(joined) else (None, i)
            at = at - 7 if at else None
        if at is None:
            i += 1
            continue
        body, size, j = [lines[i][at:].strip(" :–—-")], 0, i + 1
        while j < len(lines) and size < MOST and not ends(lines[j]) and heading(lines[j]) is None and not _ALONE.fullmatch(lines[j]):
            body.append(lines[j])
            size += len(lines[j])
            j += 1
        out.append((last, first, j, "\n".join(body).strip()[:MOST]))
        last = i = j
    return out


def ends(line: str) -> bool:
    """Whether a line opens another item."""
    item = ITEM.match(line)
    return bool(item and item[1] != "2") or folded(line).startswith(ENDS) and line[:1].isupper()


def person_name(line: str, firms: frozenset = frozenset()) -> str | None:
    """A person's name that a line begins with, up to a comma, bracket or dash: two to five words with capitals; none for firms, addresses, headings and single words.

    A line with a firm's legal form is a firm's; words that only the document's firms have make no person. Capitals of two or three letters that aren't initials stand for a degree and end a name in mixed case.
    """
    line = " ".join(line.split())
    if FORMS.search(re.split(r"\(", line)[0].strip(" .")):
        return None
    name = TITLES.sub("", re.split(r"[,(|]|\bCRD\b|\s[–—-]+\s", line)[0].strip(" .:–—-®"), count=1)
    words = name.split(" ")
    if not name.isupper():
        short = next((i for i, w in enumerate(words) if i > 1 and re.fullmatch(r"[A-Z]{2,3}®?", w) and w not in ("II", "III", "IV")), len(words))
        words = words[:short]
    if not 2 <= len(words) <= 5 or sum(map(len, words)) > 42:
        return None
    if any(w.lower().strip(".") in TRADES for w in words) or all(w.lower() in firms for w in words):
        return None
    if words[-1] in PARTICLES or not all(w in PARTICLES or (w[0].isupper() and WORD.fullmatch(w) and not re.search("['’]s$", w)) for w in words):
        return None
    whole = [w for w in words if len(w.strip(".")) > 1 and w not in PARTICLES]
    return " ".join(words) if len(whole) >= 2 else None


def firm_words(text: str) -> frozenset:
    """Words of names that the text itself tells to be firms': those with a legal form, and those whose brochure a supplement belongs to."""
    named = [line for line in text.split("\n") if len(line) < 90 and FORMS.search(line.strip(" ."))]
    named += re.findall(r"supplements\s+the\s+([^.(]{3,60}?)\s+(?:disclosure\s+)?brochure", text, re.I)
    return frozenset(w for n in named for w in re.findall(r"[\w'’-]+", n.lower()))


def possessives(text: str) -> list[str]:
    """What OWN finds in a text, in order: looked for only near its end, which few places have."""
    out, at = [], 0
    while end := OWN_END.search(text, at):
        m = OWN.search(text, max(at, end.start() - 60))
        if not m:
            break
        out.append(m[1])
        at = m.end()
    return out


def witnesses(before: list[str], body: str, firms: frozenset) -> list[str]:
    """What may be the name, from the surest witness to the least sure one."""
    text, own = "\n".join(before), body.split("\n")
    labelled = [(m[1] or (lines[i + 1] if i + 1 < len(lines) else "")) for lines in (own[:4], before) for i, x in enumerate(lines) for m in [LABEL.match(x)] if m]
    covers = [i for i, x in enumerate(before) if re.search(r"cover\s+page|part\s+2b", x, re.I) and not PAGE.search(x[-6:])]
    lead = LEAD.match(TITLES.sub("", body, count=1))
    # (lines, what may be a firm there): sentences and labels speak of persons, mere lines may not
    says = [
        (labelled[::-1], ()), (possessives(text)[::-1], ()), (before[covers[-1] + 1 : covers[-1] + 6] if covers else [], firms),
        ([re.split(r"\s+(?:that|which|is|to)\s|(?<=[a-z]{2})\.(?:\s|$)", m[1])[0] for m in ABOUT.finditer(text)][::-1], ()), ([lead[1]] if lead else [], ()), (own[:1], firms), (before[::-1] if not covers else [], firms),
    ]
    return [n for lines, out in says for n in [next(filter(None, (person_name(x, frozenset(out)) for x in lines)), None)] if n]


def shared_run(one: str, other: str) -> list[str]:
    """The longest run of words of one name that the other has too, case aside."""
    a, b = one.split(), [w.lower() for w in other.split()]
    runs = [(n, i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if any([w.lower() for w in a[i : i + n]] == b[j : j + n] for j in range(len(b)))]
    n, i = max(runs, key=lambda r: (r[0], -r[1]), default=(0, 0))
    return a[i : i + n]


def agreed(names: list[str]) -> str | None:
    """The surest witness's name, cut to the run of two words or more that another shares: a name that what stands beside it ran into."""
    if not names:
        return None
    runs = [r for r in (shared_run(names[0], n) for n in names[1:]) if 2 <= len(r) < len(names[0].split()) and person_name(" ".join(r))]
    return " ".join(runs[0]) if runs and names[0] not in names[1:] else names[0]


def number_of(before: str, body: str) -> int | None:
    """The number told last before the biography or in its first lines; one whose sentence speaks of the firm up to it isn't the person's."""
    near = f"{before}\n{body[:300]}"
    found = [m for m in NUMBER.finditer(near) if not re.search(r"\bfirm\b", re.split(r"[.;]\s|\n\s*\n", near[: m.start()])[-1][-120:], re.I)]
    return int(found[-1][1]) if found else None


def rosters(body: str, before: str, firms: frozenset) -> list[tuple[str | None, str, int]]:
    """(name, text, place) of several persons under one heading: labelled with their titles, or each paragraph opening with an honorific, a surname and the birth."""
    labels = [*ROSTER.finditer(body)]
    if len(labels) > 1:
        named = [(person_name(m[1], firms), m.start()) for m in labels]
    else:
        labels = [*FORMAL.finditer(body)]
        if len({m[1] for m in labels}) < 2:
            return []

        def full(surname: str) -> str | None:
            """The longest name that ends in the surname somewhere on the page."""
            for m in re.finditer(rf"((?:(?:[^\W\d_]\.|[^\W\d_][\w'’-]*)[ \t]+){{1,3}}{re.escape(surname)})\b", f"{before}\n{body}"):
                words = m[1].split()
                for i in range(len(words) - 1):
                    if name := person_name(" ".join(words[i:]), firms):
                        return name
            return None

        named = [(full(m[1].split()[-1]) or m[1], m.start(1)) for m in labels]
    cuts = [at for _, at in named[1:]] + [len(body)]
    return [(name, body[at:end], at) for (name, at), end in zip(named, cuts)]


def bios_of(text: str) -> list[dict]:
    """Biographies under their headings: name, CRD number if told, and text; one without a sure name, or too short to be one, is left out."""
    lines = [x.strip() for x in text.split("\n")]
    firms, out = firm_words("\n".join(lines)), []
    for first, at, _, body in sections(lines):
        before = [x for x in lines[first:at] if x]
        parts = [(n, t, "") for n, t, _ in rosters(body, "\n".join(before), firms)] or [(agreed(witnesses(before, body, firms)), body, "\n".join(lines[first:at]))]
        for name, own, around in parts:
            bio = " ".join(own.split()).strip(" :–—-")
            if name and len(bio) >= LEAST:
                out.append({"name": name, "crd": number_of(around, own), "bio": bio})
    return out


def find_bios(text: Column) -> Column:
    """Biographies of a text, as an array of name, crd and bio; none for null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([bios_of(t or "") for t in texts.to_pylist()], pa.list_(pa.struct([("name", pa.string()), ("crd", pa.int64()), ("bio", pa.string())])))

    return F.arrow_udf(run, "array<struct<name:string,crd:bigint,bio:string>>")(text)


def biographies(df: DataFrame, document: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each biography, with the document's columns in keep; those whose text, and then those whose name, is found more than once in a document are left out."""
    kept = list(dict.fromkeys([document, *(keep or [])]))
    rows = df.select(*kept, F.explode(find_bios(F.col(text))).alias("_b")).select(*kept, "_b.name", "_b.crd", "_b.bio")
    return unique_in_group(unique_in_group(rows, document, "bio"), document, "name")


def firm_documents(bios: DataFrame, disclosures: DataFrame, firm: str, number: str = "crd", columns: list[str] | None = None) -> DataFrame:
    """firm and advisors: each firm's biographies by name, then number and text, as structs; who has disclosures (a row for a number) has their columns as a struct.

    Biographies without a firm are left out; a number that is null or has no disclosures has none. Disclosures of a number that is there twice are its first by all columns.
    """
    columns = columns or [c for c in disclosures.columns if c != number]
    own = disclosures.where(F.col(number).isNotNull()).groupBy(number).agg(F.min(F.struct(*columns)).alias("disclosures"))
    rows = bios.where(F.col(firm).isNotNull()).join(own, number, "left")
    rest = [c for c in bios.columns if c not in (firm, number, "name")]
    entry = F.struct("name", number, *rest, "disclosures")
    return rows.groupBy(firm).agg(F.array_sort(F.collect_list(entry)).alias("advisors"))


# executors get these functions along with the plan, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
