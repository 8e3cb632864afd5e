"""Personal information in free text: typed placeholders by weak supervision.

1. Loose patterns propose candidate spans of five kinds (email, phone, id_number, address, name).
2. Labelers - strict patterns, gazetteers, words of the context, look-alikes - vote yes, no or nothing on each.
3. Expectation-maximisation over the counts of all vote patterns estimates each labeler's reliability without labels
   and gives each pattern its probability.
4. A logistic classifier of the span's shape, its ends and its context is trained on a bounded sample of candidates
   with those probabilities as soft labels; it scores every candidate.
5. Of overlapping accepted spans the more probable, then longer one stays; its text becomes a placeholder.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.names import NICKNAMES
from cellwright.session import staged

KINDS = ("email", "phone", "id_number", "address", "name")
#: Most distinct candidates that the classifier is trained on, a kind: those of the smallest hashes, with their numbers.
TRAIN_ROWS = 6_000
#: Length of the classifier's hashed feature vector.
FEATURES = 4096
ABSTAIN, NO, YES = 0, 1, 2

# Common given names (a gazetteer, complete enough for its labeler to be right, not to be complete).
GIVEN = frozenset(
    """
    aaron abby abigail adam alan albert alex alexander alfred alice amara amy ana andrea andrew angela anita ann anna
    anne anthony antonio arthur barbara beatrice becky ben benjamin bernard beth betty bill bob brian bruno carla
    carlos carmen carol caroline catherine cecilia charles charlie charlotte chris christian christina christopher
    chuck clara claire claudia dan daniel david deborah debbie denise diana diego dmitri dolores dominic donald dorothy
    ed edward elena eleanor elizabeth ella ellen emil emilia emily emma eric erik esther eva evelyn fatima felix
    fernando fiona florence frances francis francisco frank fred frederick gabriel george gerald gertrude giulia
    grace greg gregory hana hanna hannah hans harold harry heidi helen henry hugo ian ingrid irene isabel ivan jack
    jacob james jane janet jean jen jennifer jerry jessica jim joan joe john jonas jorge josé joseph juan judith julia
    karen karl kate katherine kathy kenji kevin kira larry laura lawrence leo linda lisa liz louis lucas lucía lucy luis
    maria marie mark martin mary matt matthew max meg mei mia michael miguel mike mohammed monica nancy ned nicholas
    nick nina noor norma olga oliver oscar oskar patricia patrick paul pedro pepe peter philip philippa priya quentin
    rachel ravi rebecca richard rob robert roger rosa ruth sally sam samuel sandra sara sarah sasha simon sofia sophie
    stephen steve sue susan teresa theo theodore thomas tim tom tony trudy ursula vera vicky victor victoria viktor
    walter wei wendy will william yusuf yvonne zoë zoe
    """.split()
) | frozenset(NICKNAMES)
# Legal forms, lines of business and endings of organisations and places.
ORG_WORDS = frozenset(
    """
    ag associates assoc brothers bros bv company co corp corporation depot distribution engineering gmbh group inc
    incorporated international limited llc ltd management manufacturing plc sa sarl services sons technologies
    bearings catering ceramics chemicals cleaning couriers foods freight furniture glassworks insurance lighting optics
    packaging plumbing printing pumps records robotics roofing seeds software stationery textiles timber
    """.split()
)
PLACE_WORDS = frozenset("bay heath cross orla lune st ford haven mouth port stad burg minster vale".split())
TITLES = r"(?:mr|mrs|ms|miss|dr|prof|herr|frau|sr|sra|mme|mlle|m)"
IS_TITLE = regex.compile(r"(?=\p{L}{2})" + TITLES + r"\.?", regex.I)
# Words beside which persons stand, and the words that follow them.
NAME_BEFORE = regex.compile(
    r"(?:\b(?:dear|attn\.?:?|attention:?|cc|ring|ask(?: for)?|signed by|handed over to|contact (?:person|was):?|kontakt:|new one is|payee|applicant"
    r"|c/o|ship to:|entregar a|livraison chez|pd by|paid by|called|regards,?|sincerely,?|by)\s+(?:" + TITLES + r"\.?\s+)?|\b" + TITLES + r"\.?\s+|\b(?:ltd|inc|gmbh|sa|bv|co|corp|llc)\.?\s+\(|^\s*|[.;\n]\s+)$",
    regex.I,
)
STRONG_BEFORE = regex.compile(
    r"\b(?:dear|attn\.?:?|attention:?|cc|ring|ask|ask for|signed by|handed over to|contact person:|contact was|kontakt:|new one is|payee|applicant"
    r"|c/o|ship to:|entregar a|livraison chez|pd by|paid by)\s+(?:" + TITLES + r"\.?\s+)?$|(?:^|\W)" + TITLES + r"\.?\s+$|\b(?:ltd|inc|gmbh|sa|bv|co|corp|llc)\.?\s+\($",
    regex.I,
)
NAME_AFTER = regex.compile(
    r"^(?:\s+(?:approved|signed|says|said|was called|called|wrote|asked|disputes|after the|at the goods|on\s+[+(\d]|en\s|of\s+(?:\d|c/|calle\s|avda|avenida|plaza\s|paseo\s|[\p{L}-]+(?:weg|str|stra(?:ß|ss)e|gasse|platz|allee)\b)|tax|taxpayer|ssn|national|passport|driving|driver)"
    r"|\s*[<(/]|\s*;|,\s+(?:accounts|the\s+(?:new|statement)|flat\b|qq\b|[a-z]{1,9}\s*\d|\d|[\p{L}' /.]+\d)|\)|\s*$|\.\s|\.$|,\s*$)",
    regex.I,
)
STRONG_AFTER = regex.compile(r"^\s+(?:approved|was called|says|of\s+[\p{L}\d/ .,'’-]{4,48}?\s+disputes)\b", regex.I)
PLACE_BEFORE = regex.compile(r"\b(?:in|at|from|to|near|desk in|arrived in)\s+$", regex.I)
NUMBER_CUE = regex.compile(r"(?:\b(?:phone|tel|telefon|call|called on|mobile|fax|ring|on|or)\b\.?:?|/|,|^)\s*$", regex.I)
ID_CUE = regex.compile(r"\b(?:ssn|passport|licen[cs]e|licencia|tin|tax(?:payer)?|national|id|insurance|nino)\b[\s\w.:#']{0,8}$", regex.I)
OTHER_NUMBER = regex.compile(r"\b(?:lot|article|order|ticket|serial|invoice|inv|po|sn|sheet|batch|section|checksum|run|total|page|row|box|version|art)[\s.:#-]*$|[\w]-$|-$", regex.I)

STREET_EN = r"(?:street|st\.?(?!\s+orla\b)|avenue|ave\.?|road|rd|lane|ln|close|terrace|boulevard|blvd|drive|dr|court|ct|way|place|square|crescent|gardens|row|hill|park)"
STREET_FR = r"(?:boulevard|rue|chemin|avenue|place|all[ée]e|impasse|quai|cours)"
STREET_ES = r"(?:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda)"
STREET_DE = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ring|damm|ufer)"
W_ = r"[\p{L}][\p{L}'’-]*"
NUM = r"\d{1,4}(?:\s?bis|\s?ter|\s?[a-zA-Z](?![\p{L}\d]))?"

CANDIDATES = {
    "email": regex.compile(
        r"(?<![\w.%+-])[\p{L}\d](?:[\w.%+-]*\w)?(?:\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?[\p{L}\d-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[\p{L}\d-]+)+"
        r"|\sat\s[\p{L}\d-]+(?:\s?(?:\.|dot)\s?[\p{L}\d-]+)*\sdot\s\p{L}{2,})",
        regex.I,
    ),
    "phone": regex.compile(r"(?<![\w.-])(?:\+ ?)?[(]?\d(?:(?:[ .\-/]|\)[ \-]?| ?\()?\d){8,15}(?!\w|[.-]\d)"),
    "id_number": regex.compile(
        r"(?<![\w-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{6}-\d{5}|\d{2} \d{3} \d{3} \d{3}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]"
        r"|[A-Za-z]\d{7,8}|[A-Za-z]{3,5}\d{6}[A-Za-z\d]{2,4}|\d{9,12})(?![\w-])"
    ),
    "address": regex.compile(
        rf"(?<![\w/.,-])(?:{NUM},?\s+{STREET_FR}\s+(?:(?:de\s+la|du|des|de|d['’])\s*)?{W_}|{NUM}(?:\s+{W_}){{1,3}}\s+{STREET_EN}(?![\p{{L}}])"
        rf"|\b{STREET_ES}\s+(?:de\s+(?:la\s+)?)?{W_}(?:\s+{W_})?,?\s+{NUM}|\b[\p{{L}}-]+?{STREET_DE}\s+{NUM})(?![\p{{L}}\d])",
        regex.I,
    ),
}
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*\.?")
PHONE_STRICT = regex.compile(
    r"(?:\+?1[ .\-/]?)?(?:\(\d{3}\) ?|\d{3}[ .\-/])\d{3}[ .\-/]?\d{4}|\+1\d{10}|(?:\+44 ?(?:\(0\) ?)?|0044 ?|0)(?:7\d{3}[ -]?\d{3} ?\d{3}|20 ?\d{4} ?\d{4}|\d{3,4}[ -]\d{3} ?\d{3,4})|\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){2,5}"
)
ID_STRICT = regex.compile(r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{6}-\d{5}|\d{2} \d{3} \d{3} \d{3}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]\d{8}|[A-Z]{3,5}\d{6}[A-Z]\d{1,2}")


PLAIN_EMAIL = regex.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
EMAIL_CUE = regex.compile(r"(?:mail|reply to|scans go to|e-?mail|contact)[: ]*$|[<(;]\s*$", regex.I)
DATE_LIKE = regex.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}.*")
ADDRESS_LEAD = regex.compile(r"(?:to|at|of|in|chez|en|find|flat \d+,?|,|\bdepot at|:)\s*$", regex.I)
ADDRESS_TAIL = regex.compile(r"\s*(?:,|\.|;|closes|disputes|$|\n)")
UNIT = regex.compile(r"\b(?:rows|pallets|days|pages|cells|boxes|kg|cm|eur|sheets)\b", regex.I)
MORE_NAME = regex.compile(r"\s+\p{Lu}|\s+(?:and|\+|&)\s")
PLACE_TAIL = regex.compile(r"(?:['’]s|\bSt\.?)$")
PLACE_AFTER = regex.compile(r"\s+Orla\b|\s*-on-")
INITIAL_FIRST = regex.compile(r"\p{Lu}\.\s")
ADDRESS_STRICT = regex.compile(rf"^{NUM}\s+{W_}\s+{STREET_EN}$|^{NUM},?\s+{STREET_FR}\s|^{STREET_ES}|{STREET_DE}\s+\d", regex.I)
LEFT_WORDS = regex.compile(r"[\p{L}/@]+|[^\s\p{L}\d]")
RIGHT_WORDS = regex.compile(r"[\p{L}/@]+|\d+|[^\s\p{L}\d]")


#: Last words of what :data:`STRONG_BEFORE` finds, titles aside: only behind these it is asked.
CUE_ENDS = frozenset("dear attn attention cc ring ask for by to person was kontakt is payee applicant o a chez ltd inc gmbh sa bv co corp llc".split())
#: Most words of a name whose first is a known given name.
MOST_NAME_WORDS = 6


class Taken:
    """Stretches of a text, to ask whether a span meets one, in time that grows with their logarithm."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for s, e in sorted(spans):
            if self.end and s < self.end[-1]:
                self.end[-1] = max(self.end[-1], e)
            else:
                self.start.append(s)
                self.end.append(e)

    def meets(self, s: int, e: int) -> bool:
        i = bisect_right(self.end, s)
        return i < len(self.start) and self.start[i] < e

    def holds(self, s: int, e: int) -> bool:
        i = bisect_right(self.start, s) - 1
        return i >= 0 and e <= self.end[i]


def _name_spans(text: str, taken: list[tuple[int, int]], numbers: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Two words, two with an initial, an initial with a word, or family name, comma, given name: the likely shapes.

    Behind a known given name also three and more words with capitals, as names of several given or family names are.
    """
    words = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    busy, numbered = Taken(taken), Taken(list(numbers))
    free = [not busy.meets(s, e) for s, e, _ in words]
    out = []

    def initial(w: str) -> bool:
        return len(w) == 2 and w[1] == "." and w[0].isupper()

    def named(w: str) -> bool:
        return len(w) > 1 and not initial(w)

    n = len(words)
    for i in range(n):
        if not free[i]:
            continue
        s, e, w = words[i]
        gaps = [text[words[j][1] : words[j + 1][0]] if j + 1 < n else None for j in range(i, min(i + 3, n))]
        if IS_TITLE.fullmatch(w):
            continue
        given = w.rstrip(".").lower() in GIVEN
        cue = False
        if not w[0].isupper() and not given:
            last = words[i - 1][2].rstrip(".").lower() if i else ""
            cue = i == 0 or text[max(0, s - 2) : s].strip(" ") in ("", ".", ";", "\n", ".\n")
            cue = cue or ((last in CUE_ENDS or IS_TITLE.fullmatch(last) is not None) and STRONG_BEFORE.search(text[max(0, s - 40) : s]) is not None)
        if not (w[0].isupper() or given or cue or (i + 1 < n and gaps[0] == ", " and words[i + 1][2].lower() in GIVEN)):
            continue
        if i + 1 < n and free[i + 1] and gaps[0] in (" ", "  "):
            w2 = words[i + 1][2]
            if initial(w) and named(w2):
                out.append((s, _end(words[i + 1])))
            elif named(w) and not w.endswith(".") and initial(w2) and i + 2 < n and free[i + 2] and gaps[1] == " " and named(words[i + 2][2]):
                out.append((s, _end(words[i + 2])))
            elif named(w) and not w.endswith(".") and named(w2):
                out.append((s, _end(words[i + 1])))
            if initial(w) and initial(w2) and i + 2 < n and gaps[1] == " " and named(words[i + 2][2]):
                out.append((s, _end(words[i + 2])))
        if given and w[0].isupper() and not w.endswith("."):
            # every longer name that starts here, up to the first word that cannot be part of it; behind a family name
            # a given name is another person's
            leading = True
            for j in range(i + 1, min(n, i + MOST_NAME_WORDS)):
                word = words[j][2]
                plain = word.rstrip(".").lower()
                if plain in GIVEN and not leading:
                    break
                leading = plain in GIVEN
                if not free[j] or numbered.meets(words[j][0], words[j][1]) or text[words[j - 1][1] : words[j][0]] != " " or not word[0].isupper() or initial(word) or plain in ORG_WORDS or (plain in COMMON and plain not in GIVEN):
                    break
                if j > i + 1:
                    out.append((s, _end(words[j])))
                if word.endswith("."):
                    break
        if i + 1 < n and free[i + 1] and gaps[0] == ", " and named(w) and named(words[i + 1][2]):
            stop = _end(words[i + 1])
            if i + 2 < n and free[i + 2] and gaps[1] == " " and initial(words[i + 2][2]):
                out.append((s, words[i + 2][1]))
            out.append((s, stop))
    return out


def _end(word: tuple[int, int, str]) -> int:
    return word[1] - 1 if word[2].endswith(".") else word[1]


def _vote(yes: bool, no: bool = False) -> int:
    return YES if yes else NO if no else ABSTAIN


def _parts(span: str) -> list[str]:
    return [p.strip(".,'’").lower() for p in span.replace(",", " ").split() if p.strip(".,")]


def votes(kind: str, text: str, s: int, e: int, field: str) -> list[int]:
    """The labelers' votes on one candidate; ``field`` is the column that the text was taken from, or empty."""
    span, before, after = text[s:e], text[max(0, s - 48) : s], text[e : e + 40]
    if kind == "email":
        strict = PLAIN_EMAIL.fullmatch(span) is not None
        cue = EMAIL_CUE.search(before) is not None
        return [_vote(strict), _vote(cue), _vote("(" in span or "[" in span or strict or " @ " in span, " at " in span), _vote(len(span) > 8, len(span) < 6)]
    digits = sum(c.isdigit() for c in span)
    if kind == "phone":
        other = OTHER_NUMBER.search(before) is not None
        date = DATE_LIKE.fullmatch(span) is not None
        identity = ID_STRICT.fullmatch(span) is not None
        return [
            _vote(PHONE_STRICT.fullmatch(span) is not None, ID_STRICT.fullmatch(span) is not None),
            _vote(NUMBER_CUE.search(before) is not None and not ID_CUE.search(before), other or ID_CUE.search(before) is not None),
            _vote(span[0] in "+(0" and not identity, date or identity),
            _vote(10 <= digits <= 13 and not identity, digits < 9 or digits > 14),
        ]
    if kind == "id_number":
        other = OTHER_NUMBER.search(before) is not None
        cue = ID_CUE.search(before) is not None
        phone = PHONE_STRICT.fullmatch(span) is not None
        return [
            _vote(ID_STRICT.fullmatch(span) is not None, phone),
            _vote(cue, other or NUMBER_CUE.search(before) is not None and not ID_STRICT.fullmatch(span)),
            _vote(not span.isdigit() and any(c.isdigit() for c in span), span.isdigit() and not cue),
            _vote(8 <= digits + sum(c.isalpha() for c in span) <= 14, other),
        ]
    if kind == "address":
        lead = ADDRESS_LEAD.search(before) is not None
        tail = ADDRESS_TAIL.match(after) is not None
        number = any(c.isdigit() for c in span)
        strict = ADDRESS_STRICT.search(span) is not None
        unit = UNIT.search(span) is not None
        return [_vote(strict, unit), _vote(lead or field == "address" or s == 0, unit), _vote(tail, unit), _vote(number and not unit, unit)]
    words = _parts(span)
    org = any(w in ORG_WORDS for w in words) or (any(w in ORG_WORDS for w in _parts(after[:20])[:2]) and MORE_NAME.match(after) is not None)
    place = words[-1] in PLACE_WORDS or PLACE_TAIL.search(span) is not None or PLACE_AFTER.match(after) is not None
    city = PLACE_BEFORE.search(before) is not None and not STRONG_BEFORE.search(before)
    common = any(w in COMMON and w not in GIVEN and len(w) > 1 for w in words)
    given = words[0] in GIVEN or ("," in span and words[1] in GIVEN) or (len(words) == 2 and words[1] in GIVEN)
    first_initial = INITIAL_FIRST.match(span) is not None
    hard = STRONG_AFTER.match(text[e : e + 72]) is not None
    strong, follows = STRONG_BEFORE.search(before) is not None or hard, NAME_AFTER.match(after) is not None or hard
    return [
        _vote(given, common or org),
        _vote(strong, PLACE_BEFORE.search(before) is not None and not strong),
        _vote(follows and not org, org),
        _vote(first_initial and not common, org or place),
        _vote((strong or NAME_BEFORE.search(before) is not None and follows) and not common and not org and not place, common or city),
        _vote(field == "contact" and not common, place or common or field in ("vendor", "issued", "total", "invoice_number")),
    ]


# Words of notes and letters that are no parts of names.
COMMON = frozenset(
    """
    a accounts account after all an and annex are article as ask at attn avenue batch before bill by call called calle cc
    chemin closes contact courier credit dear deliver delivery depot desk differs dimensions disputes enclosed for find flat
    friday from front goods he in invoice is it kontakt lane livraison lot mail memo missing mobile monday new no note notes
    of office old on one open or order page paid parser payable payee payment person please post re remarks remit reply ring
    road row rows rue run same scans section see serial ship signed slip statement street stays tax tel that the this ticket
    to total vendor verified was when with chez entregar en applicant could not sent twice january february march april may
    june july august september october november december carrier noted items approved above header register supplies national
    id passport ssn licence driving driver's tin taxpayer avda plaza boulevard faithfulness checksum weight if de la du
    bis terrace close blvd ave rd st covers pallets quote returned originals stay go table arrived against counts
    """.split()
)


#: Digits that every candidate of a kind has, and what every e-mail address has.
LEAST_DIGITS = {"email": 0, "id_number": 6, "phone": 9, "address": 1}
AT = regex.compile(r"@|[(\[{ ]\s?at\s?[)\]}]|\sat\s", regex.I)


def candidates(text: str | None, field: str = "") -> list[tuple[str, int, int, list[int], list[int]]]:
    """Candidate spans of a text: kind, start, end, votes and hashed features."""
    if not text:
        return []
    out = []
    taken: list[tuple[int, int]] = []
    mails = Taken([])
    digits = sum(map(str.isdigit, text))
    for kind in ("email", "id_number", "phone", "address"):
        # no pattern is tried on texts that lack what each of its matches has
        if digits < LEAST_DIGITS[kind] or (kind == "email" and not AT.search(text)):
            continue
        for m in CANDIDATES[kind].finditer(text):
            s, e = m.span()
            if kind == "phone" and text[s] == "(" and ")" not in text[s:e]:
                s += 1
            if kind == "phone" and text[e - 1] == ")":
                e -= 1
            if kind == "phone" and mails.holds(s, e):
                continue
            out.append((kind, s, e))
            if kind in ("email", "address"):
                taken.append((s, e))
        if kind == "email":
            mails = Taken([x for x in taken if "@" in text[slice(*x)]])
    # words of notes alone are never a name
    out += [("name", s, e) for s, e in _name_spans(text, taken, [x[1:] for x in out if x[0] == "id_number"]) if any(w not in COMMON or w in GIVEN for w in _parts(text[s:e]) if len(w) > 1)]
    voted = [(k, s, e, votes(k, text, s, e, field)) for k, s, e in out]
    return [(k, s, e, v, features(k, text, s, e, field, v)) for k, s, e, v in voted]


def _shape(span: str) -> str:
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in span]
    return "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)


def features(kind: str, text: str, s: int, e: int, field: str, voted: list[int]) -> list[int]:
    """Hashed features of a span: its shape, its words' ends, the words around it and each labeler's vote, with its kind."""
    span = text[s:e]
    left = [w.lower() for w in LEFT_WORDS.findall(text[max(0, s - 32) : s])[-3:]]
    right = [w.lower() for w in RIGHT_WORDS.findall(text[e : e + 24])[:2]]
    right = ["9" if w.isdigit() else w for w in right]
    words = _parts(span)
    raw = ["bias", "shape:" + _shape(span)[:24], "field:" + field, "l1:" + (left[-1] if left else "^"), "l2:" + " ".join(left[-2:]), "r1:" + (right[0] if right else "$"), "r2:" + " ".join(right)]
    raw += [f"vote{i}:{v}" for i, v in enumerate(voted)]
    if kind == "name":
        raw += ["given" if any(w in GIVEN for w in words) else "unknown", "first:" + words[0], "last3:" + words[-1][-3:], "common" if any(w in COMMON and len(w) > 1 for w in words) else "rare"]
        raw += ["org" if any(w in ORG_WORDS for w in words) else "noorg", "afterorg" if right and right[0] in ORG_WORDS else "", "comma" if "," in span else ""]
    return sorted({crc32(f"{kind}|{x}".encode()) % FEATURES for x in raw if x})


#: Share of the candidates that the labelers' prior reliability weighs, and that prior: rates of abstain, no and yes
#: for false and for true candidates.  It keeps a kind whose candidates are nearly all true from being split in two.
PRIOR_WEIGHT, PRIOR = 0.15, ((0.35, 0.5, 0.15), (0.25, 0.05, 0.7))

CANDIDATE_TYPE = "array<struct<kind string, s int, e int, votes string, feats array<int>>>"


def propose(rows: DataFrame) -> DataFrame:
    """``origin, record_id, text, spans`` of rows ``origin, record_id, text, field`` that have candidate spans."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("votes", pa.string()), ("feats", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [
                [{"kind": k, "s": s, "e": e, "votes": "".join(map(str, v)), "feats": f} for k, s, e, v, f in candidates(t, c or "")]
                for t, c in zip(b["text"].to_pylist(), b["field"].to_pylist(), strict=True)
            ]
            yield pa.record_batch([b["origin"], b["record_id"], b["text"], pa.array(spans, kind)], names=["origin", "record_id", "text", "spans"])

    return rows.mapInArrow(run, f"origin string, record_id bigint, text string, spans {CANDIDATE_TYPE}")


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Expectation-maximisation over counted vote patterns: the probability that a candidate of each pattern is true.

    One latent truth a candidate; labelers vote independently given it, with their own rates of yes, no and nothing.
    They start as better than chance, which names the truth's two values.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        votes_ = np.array([[int(c) for c in v] for v, _ in own])
        weight = np.array([n for _, n in own], float)
        balance = (votes_ == YES).sum(1) - (votes_ == NO).sum(1)
        truth = 1 / (1 + np.exp(-1.5 * balance))
        for _ in range(rounds):
            rates = np.empty((2, votes_.shape[1], 3))
            for t, belief in ((1, truth), (0, 1 - truth)):
                for v in range(3):
                    rates[t, :, v] = ((votes_ == v) * (belief * weight)[:, None]).sum(0) + PRIOR_WEIGHT * weight.sum() * PRIOR[t][v]
                rates[t] /= rates[t].sum(1, keepdims=True)
            prior = min(max((truth * weight).sum() / weight.sum(), 0.02), 0.98)
            log = [np.log(p) + np.log(rates[t][np.arange(votes_.shape[1]), votes_]).sum(1) for t, p in ((0, 1 - prior), (1, prior))]
            # a labeler's word counts once, but labelers share evidence: their sum is damped
            truth = 1 / (1 + np.exp(np.clip(0.7 * (log[0] - log[1]), -30, 30)))
        out |= {(kind, v): float(p) for (v, _), p in zip(own, truth, strict=True)}
    return out


def train(rows: list[tuple[list[int], float, int]], rounds: int = 150, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed features, by full gradient steps with momentum.

    A row is a distinct candidate: its features, its probability of being true, and how many candidates it stands for.
    """
    weights, speed = np.zeros(FEATURES), np.zeros(FEATURES)
    if not rows:
        return weights
    at = np.concatenate([np.full(len(f), i) for i, (f, _, _) in enumerate(rows)])
    feats = np.concatenate([np.array(f, int) for f, _, _ in rows])
    goal = np.array([y for _, y, _ in rows])
    times = np.array([n for _, _, n in rows], float)
    times /= times.mean()
    seen = np.bincount(feats, times[at], minlength=FEATURES) + 1.0
    for _ in range(rounds):
        score = np.bincount(at, weights[feats], minlength=len(rows))
        error = times * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - goal)
        slope = np.bincount(feats, error[at], minlength=FEATURES) / np.sqrt(seen * len(rows)) + shrink * weights
        speed = 0.9 * speed - rate * slope
        weights = weights + speed
    return weights


def choose(spans: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
    """A span within a longer one of its kind goes; of other overlapping spans the most probable, then the longer stays."""
    reach: dict[str, tuple[int, int]] = {}
    whole = []
    for x in sorted(spans, key=lambda x: (x[1], -x[2])):
        _, s, e, kind = x
        if kind not in reach or reach[kind][1] < e or reach[kind] == (s, e):
            reach[kind] = (s, e)
            whole.append(x)
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for _, s, e, kind in sorted(whole, key=lambda x: (-round(x[0], 2), x[1] - x[2], x[1])):
        i = bisect_right(starts, s)
        if (i == 0 or kept[i - 1][1] <= s) and (i == len(kept) or e <= kept[i][0]):
            starts.insert(i, s)
            kept.insert(i, (s, e, kind))
    return kept


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its placeholder and nothing else changed."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def personal_spans(rows: DataFrame) -> DataFrame:
    """``origin, record_id, text, found ARRAY<STRUCT<kind, found>>, redacted`` of every row of ``rows``.

    ``rows`` has ``origin, record_id, text, field``.  NULL and empty texts have no spans and come back unchanged; very
    long texts are read whole; repeated rows are each judged.  What goes to the driver are the counts of vote
    patterns, at most 3^labelers a kind, and at most :data:`TRAIN_ROWS` training rows a kind.
    """
    proposed = staged(propose(rows))
    spans = proposed.select(F.explode("spans").alias("c")).select("c.*")
    counts = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    truth = reliabilities([(r["kind"], r["votes"], r["n"]) for r in counts])
    # equal candidates are one with a weight, so that no span fills the sample however often it stands in the texts
    distinct = staged(spans.groupBy("kind", "votes", "feats").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("kind", "feats", "votes")))
    chosen = [r for k in KINDS for r in distinct.filter(F.col("kind") == k).orderBy("h", "votes").limit(TRAIN_ROWS).collect()]
    weights = train([(r["feats"], truth[r["kind"], r["votes"]], r["n"]) for r in chosen])
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for text, own in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                good = []
                for c in own or []:
                    score = float(weights[c["feats"]].sum())
                    p = 1 / (1 + np.exp(-max(min(score, 30), -30)))
                    # the labelers' votes taught the classifier, which alone decides
                    if p > 0.5:
                        good.append((p, c["s"], c["e"], c["kind"]))
                kept = choose(good)
                found.append([{"kind": k, "found": text[s:e]} for s, e, k in kept])
                texts.append(None if text is None else redact(text, kept))
            yield pa.record_batch([b["origin"], b["record_id"], b["text"], pa.array(found, found_type), pa.array(texts, pa.string())], names=["origin", "record_id", "text", "found", "redacted"])

    return proposed.mapInArrow(run, "origin string, record_id bigint, text string, found array<struct<kind string, found string>>, redacted string")


def texts_of(elements: DataFrame, feedback: DataFrame) -> DataFrame:
    """The two sources of free text in one shape."""
    return elements.select(F.lit("ir_elements").alias("origin"), F.col("element_id").alias("record_id"), "text", F.lit("").alias("field")).unionByName(
        feedback.select(F.lit("feedback_records").alias("origin"), F.col("feedback_id").alias("record_id"), F.col("original_value").alias("text"), F.col("column_name").alias("field"))
    )
