"""Variant spellings of people and organisations: which spellings mean the same party.

1. A spelling is its key: lower case, letters and digits only.  Each key is parsed once into the party's main word
   (family name, or the made-up word of a firm), its facet (given name, line of business or depot number) and words
   that tell nothing (titles, legal forms, order, shortened or left-out words of firms).
2. Distinct main words are blocked by the phonetic code of their sorted tokens and by what is left of them without one
   or two letters: two words with that many typing errors always share such a block, whatever the errors do to the
   code.  A block is a run of one sorted key, compared with arrays by typing errors and Jaro-Winkler.  In a run every
   word meets the first one, and those that it is not alike meet all others, so no accepted pair is left apart.
3. Connected components of the links are the main words' classes.
4. Within a class the facets are told apart: nicknames, initials and typing errors of given names are one, different
   given names, lines of business and depot numbers are not.  An initial or a missing facet joins what it fits if that
   is one party only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.fingerprints import normal_key
from cellwright.session import staged

#: Least Jaro-Winkler similarity of two main words (an error in the second letter can cost 0.1), most errors by length.
LEAST_SIMILARITY = 0.82
SHORT_WORD, LONG_WORD = 5, 9
#: Spellings of a party whose pairs one task makes, and pairs of words that are compared at once.
CHUNK, PAIRS = 500, 200_000
#: Rows of sorted keys that are compared at once, with the last run as a whole.
RUN_ROWS = 200_000

# Nicknames and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "barb": "barbara", "becky": "rebecca",
    "ben": "benjamin", "benny": "benjamin", "bert": "albert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "katherine", "charlie": "charles", "chris": "christopher",
    "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah",
    "dick": "richard", "don": "donald", "drew": "andrew", "ed": "edward", "eddie": "edward", "em": "emilia", "emmy": "emilia",
    "fran": "francisco", "fred": "frederick", "freddy": "frederick", "gert": "gertrude", "greg": "gregory", "hank": "henry",
    "harry": "henry", "jack": "john", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james",
    "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "kate": "katherine", "kathy": "katherine",
    "katie": "katherine", "kit": "christopher", "larry": "lawrence", "lex": "alexander", "liz": "elizabeth", "lou": "louis",
    "maggie": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mike": "michael", "mick": "michael",
    "nate": "nathaniel", "ned": "edward", "nick": "nicholas", "paco": "francisco", "pancho": "francisco", "pat": "patricia",
    "patty": "patricia", "peggy": "margaret", "pepe": "josé", "pete": "peter", "phil": "philip", "pippa": "philippa",
    "rick": "richard", "rich": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sasha": "alexander",
    "steve": "stephen", "sue": "susan", "suzy": "susan", "ted": "edward", "teddy": "edward", "theo": "theodore", "tim": "timothy",
    "tina": "christina", "tom": "thomas", "tony": "anthony", "toni": "anthony", "trish": "patricia", "trudy": "gertrude",
    "vic": "victoria", "vicky": "victoria", "walt": "walter", "will": "william", "zach": "zachary",
}
#: Nicknames of more than one given name.
ALSO = {"ted": "theodore", "pat": "patrick", "sam": "samantha", "alex": "alexandra", "chris": "christina", "fran": "frances"}
# Given names beside those that have nicknames.
GIVEN = frozenset(NICKNAMES) | frozenset(NICKNAMES.values()) | frozenset(
    "amara anna eva hanna ingrid ivan jane julia karl kenji laura linda lucía maria mark mary noor olga oskar paul priya quentin ravi ruth simon ursula viktor yusuf zoë".split()
)
TITLES = frozenset("dr mr mrs ms miss prof herr frau sir dame jr sr".split())
LEGAL = frozenset("ag bv co company corp corporation gesellschaft gmbh inc incorporated limited llc ltd mbh plc sa".split())
#: Words of firms that may be shortened or left out, with their short forms.
FILLERS = {
    "associates": "assoc assocs asc", "brothers": "bros bro", "distribution": "distr distrib dist", "engineering": "eng engg engr engrg",
    "group": "grp", "international": "intl int", "management": "mgmt mgt mgm", "manufacturing": "manuf mfg manu", "services": "serv svcs svc servs",
    "technologies": "tech technol techs", "sons": "son",
}
LINES = tuple(
    """
    bearings catering ceramics chemicals cleaning couriers foods freight furniture glassworks insurance lighting optics
    packaging plumbing printing pumps records robotics roofing seeds software stationery textiles timber
    """.split()
)
SHORT_FORMS = {s: w for w, all_ in FILLERS.items() for s in [w, *all_.split()]}
NOISE = frozenset(("the", "and", "of"))
#: What is typed where a name is missing, as keys; codes of vendors; words that end names of places.
PLACEHOLDERS = frozenset("na nan none null unknown tbc tbd pending missing test x xx xxx same asabove notgiven".split())
#: A one-word spelling is a city if it stands in the cities' column more than so many times as often as among the names.
CITY_TIMES = 2
SEVERAL_WORDS = r"[^\p{L}\p{M}\p{N}'’]+[\p{L}\p{N}]"
VENDOR_CODE = r"^v\d+$"
PLACE_WORDS = frozenset("bay heath cross orla lune".split())

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
DOTTED = regex.compile(r"(?<![\p{L}\p{N}])(?:\p{L}\.){2,}\p{L}?(?![\p{L}])")
GLUED_TITLE = regex.compile(r"\b(Dr|Mr|Mrs|Ms|Prof)(?=\p{Lu}\p{Ll})")
TURNED = regex.compile(r"\W*[\p{L}\p{M}'’-]+\s*,\s*\p{L}")
CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")


def errors(a: str, b: str, most: int = 3) -> int:
    """Typing errors between two words: insertions, deletions, substitutions, exchanged neighbours (each once)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    before, row = None, list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        now = [x]
        for y in range(1, len(b) + 1):
            cost = min(row[y] + 1, now[y - 1] + 1, row[y - 1] + (a[x - 1] != b[y - 1]))
            if before and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                cost = min(cost, before[y - 2] + 1)
            now.append(cost)
        before, row = row, now
    return row[-1]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common start of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + 0.1 * start * (1 - jaro)


def most_errors(shorter: int, same_sound: bool) -> int:
    """Typing errors that two words of at least so many letters may differ by; short words must sound the same."""
    return 2 if shorter >= LONG_WORD else 1 if shorter >= SHORT_WORD or (same_sound and shorter >= 3) else 0


def alike(a: str, b: str) -> bool:
    """Whether two main words are one word with typing errors."""
    most = most_errors(min(len(a), len(b)), phonetic(a) == phonetic(b))
    return a == b or (most > 0 and errors(a, b, most) <= most and jaro_winkler(a, b) >= LEAST_SIMILARITY)


# Letters that sound alike share a digit; vowels and h, w have none.
SOUNDS = str.maketrans("bfpvcgjkqsxzdtlmnr", "111122222222334556")


def phonetic(word: str) -> str:
    """A code of the word's consonants by sound, repeated sounds once."""
    out = []
    for c in word.translate(SOUNDS):
        if c.isdigit() and (not out or out[-1] != c):
            out.append(c)
    return "".join(out) or word[:1]


def shortened(word: str, letters: int) -> set[str]:
    """The word itself and what is left of it without up to so many letters."""
    out = {word}
    last = out
    for _ in range(letters):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def _index(words: set[str], letters: int) -> dict[str, list[str]]:
    """Words by what is left of them: two words with so many typing errors share an entry."""
    index: dict[str, list[str]] = {}
    for w in sorted(words):
        for left in shortened(w, letters if len(w) >= 8 else 1):
            index.setdefault(left, []).append(w)
    return index


LONG_FORMS = ("limited", "company", "corporation", "incorporated", "gesellschaft")
LEXICON = _index({*LINES, *FILLERS, *LONG_FORMS, *GIVEN, "depot"}, 2)
LONGEST = max(map(len, LEXICON))


@lru_cache(100_000)
def near_words(token: str) -> dict[str, int]:
    """Words of the lexicon that a token may mistype, with the errors."""
    if not 3 <= len(token) <= LONGEST + 2:
        return {}
    found = {w for left in shortened(token, 2 if len(token) >= 7 else 1) for w in LEXICON.get(left, ())}
    return {w: errors(token, w, 2) for w in found if errors(token, w, 2) <= 2}


@lru_cache(100_000)
def line_of_business(token: str) -> str | None:
    """The line of business that a token names, shortens or mistypes."""
    if token in LINES:
        return token
    if 3 <= len(token) < LONGEST:
        starts = [w for w in LINES if w.startswith(token)]
        if len(starts) == 1:
            return starts[0]
    if len(token) >= 4:
        near = [w for w, n in near_words(token).items() if w in LINES and n <= (1 if len(w) < 8 else 2) and jaro_winkler(token, w) >= 0.85]
        return near[0] if len(near) == 1 else None
    return None


@lru_cache(100_000)
def filler(token: str) -> bool:
    """Whether a token is a firm's word that may be left out, or its legal form, even mistyped."""
    if token in LEGAL or token in SHORT_FORMS or token in NOISE:
        return True
    return len(token) >= 5 and any(n <= (1 if len(w) < 9 else 2) for w, n in near_words(token).items() if w in FILLERS or w in LONG_FORMS)


@lru_cache(100_000)
def known_given(token: str) -> bool:
    if token in GIVEN:
        return True
    return len(token) >= 4 and any(n <= 1 and len(w) >= 4 for w, n in near_words(token).items() if w in GIVEN)


#: What may stand glued in front of a firm's made-up word.
GLUED_FRONT = ("gmbh", "llc", "ltd", "inc")
WHOLE_WORDS = tuple(sorted({*LINES, *FILLERS, *(w for w in LEGAL if len(w) > 3), "depot"}, key=lambda w: (-len(w), w)))


@lru_cache(100_000)
def apart(token: str) -> tuple[str, ...]:
    """A token that was typed without spaces as its words: known words of firms at its ends, a given name in front."""
    for w in WHOLE_WORDS if token.endswith(WHOLE_WORDS) or token.startswith(WHOLE_WORDS) else ():
        if len(token) > len(w) + 2:
            if token.endswith(w):
                return (*apart(token[: -len(w)]), w)
            if token.startswith(w):
                return (w, *apart(token[len(w) :]))
    return next(((w, token[len(w) :]) for w in GLUED_FRONT if token.startswith(w) and len(token) >= len(w) + 9 and token[len(w)] not in "aeiou"), (token,))


@lru_cache(100_000)
def given_in_front(token: str) -> tuple[str, ...]:
    best = max((g for g in GIVEN if token.startswith(g) and len(token) >= len(g) + 6), key=len, default="")
    return (best, token[len(best) :]) if best else (token,)


def parse(text: str) -> tuple[str, str, str] | None:
    """Kind (``org`` or ``person``), main word and facet of a spelling; None if it names no party.

    A firm's facet is its line of business or ``#`` and its depot number; a person's is the given name, or initials
    with a dot; a facet that is missing is empty.
    """
    text = GLUED_TITLE.sub(r"\1 ", text)
    flat = DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text.replace("’", "'").replace("'", ""))
    raw = TOKEN.findall(flat)
    if len(raw) == 1:
        # letter case is all that separates the words, or its inverse
        turned = flat.swapcase() if raw[0][0].islower() and sum(c.isupper() for c in flat) > len(flat) / 2 else flat
        raw = TOKEN.findall(CAMEL.sub(" ", turned))
    tokens = [w for t in raw for w in (apart(t.lower()) if len(t) > 8 and not filler(t.lower()) and t.lower() not in LINES else (t.lower(),))]
    if len(tokens) == 1:
        tokens = list(given_in_front(tokens[0]))
    rest, line, depot, org = [], "", "", False
    for i, t in enumerate(tokens):
        if t in TITLES and len(tokens) > 2 and t not in LEGAL:
            continue
        if (t == "depot" or (4 <= len(t) <= 6 and errors(t, "depot", 1) <= 1)) and len(tokens) > 1:
            org, depot = True, depot or "#"
        elif t.isdigit():
            depot = "#" + t
        elif t in LEGAL or t in SHORT_FORMS:
            org = True
        elif t in NOISE and len(tokens) > 2:
            continue
        elif t not in GIVEN and not line and len(tokens) > 1 and (found := line_of_business(t)) and (found.startswith(t) or not known_given(t)):
            line, org = found, True
        elif len(tokens) > 2 and not known_given(t) and filler(t):
            org = True
        else:
            rest.append((i, t))
    if not rest:
        return None
    if org:
        words = [t for _, t in rest if len(t) > 2] or [t for _, t in rest]
        # a lone number without the word depot is no depot
        return "org", "".join(sorted(words)) if len(words) < 3 else max(words, key=len), depot if depot not in ("", "#") else line
    words = [t for _, t in rest]
    if len(words) == 1 or words[-1] in PLACE_WORDS or any(c.isdigit() for c in "".join(words)):
        return None
    short = [t for t in words if len(t) <= 2 and t not in GIVEN]
    long = [t for t in words if not (len(t) <= 2 and t not in GIVEN)]
    if not long:
        return None
    if len(long) == 1:
        return "person", long[0], "".join(short)[0] + "."
    comma = TURNED.match(text) is not None
    last_given, first_given = known_given(long[-1]), known_given(long[0])
    turned = (comma and not (first_given and not last_given)) or (last_given and not first_given)
    given, family = (long[-1], long[0]) if turned else (long[0], long[-1])
    return "person", family, given


def same_given(a: str, b: str) -> bool:
    """Whether two given names of one family name are one: nicknames, initials and typing errors."""
    if a == b:
        return True
    if a.endswith(".") or b.endswith("."):
        return False
    forms = _given_forms
    if forms(a) & forms(b):
        return True
    if a in GIVEN and b in GIVEN:
        return False
    return any(min(len(x), len(y)) >= 3 and errors(x, y, 1) <= 1 for x in forms(a) for y in forms(b)) or (
        min(len(a), len(b)) >= 8 and errors(a, b, 2) <= 2 and a[0] == b[0]
    )


def facets(kind: str, found: list[tuple[str, int]]) -> dict[str, str]:
    """Each facet's party within a class of main words, named by its most frequent facet.

    Facets are taken by how often they occur; each joins the first it is the same as.  Initials and missing facets
    come last and join the only party they fit, else one of their own.
    """
    order: dict[str, int] = {}
    near: dict[str, list[tuple[str, str]]] = {}
    letters: dict[str, set[str]] = {}
    out: dict[str, str] = {}

    def join(f: str, home: str) -> None:
        order.setdefault(home, len(order))
        for x in _given_forms(f):
            letters.setdefault(x[0], set()).add(home)
        for x in _near_forms(f):
            near.setdefault(x, []).append((f, home))
        out[f] = home

    full = sorted((f for f in found if f[0] and not f[0].endswith(".")), key=lambda x: (-x[1], x[0]))
    for f, _ in full:
        # the formal name joins first, so a nickname of two names goes to the one that is there
        met = {m for x in _near_forms(f) for m in near.get(x, ())} if kind == "person" else set()
        fits = sorted({home for o, home in met if same_given(f, o)}, key=order.__getitem__)
        join(f, f if not fits else fits[0])
    for f, _ in sorted((f for f in found if not f[0] or f[0].endswith(".")), key=lambda x: (x[0] == "", -x[1], x[0])):
        fits = letters.get(f[0], set()) if f else set(order)
        home = next(iter(fits)) if len(fits) == 1 else f or "?"
        if f:
            join(f, home)
        else:
            order.setdefault(home, len(order))
            out[f] = home
    return out


def _given_forms(name: str) -> set[str]:
    """A given name with the names that it may be a nickname of."""
    return {name, NICKNAMES.get(name, name), ALSO.get(name, name)}


def _near_forms(name: str) -> set[str]:
    """What two given names that are the same have in common at least one of."""
    forms = _given_forms(name)
    out = forms | {y for x in forms if len(x) >= 3 for y in shortened(x, 1)}
    return out | shortened(name, 2) if len(name) >= 8 else out


def spellings(columns: list[DataFrame]) -> DataFrame:
    """``key, text, n``: the keys of one-column frames of names, each with its best separated text and its rows.

    NULL and blank values, placeholders and vendor codes are left out.  Combined before the shuffle, so a spelling
    that most rows have is one row a task.
    """
    out = None
    for df in columns:
        value = F.col(df.columns[0])
        one = df.filter(value.isNotNull()).groupBy(value.alias("text")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    keyed = out.withColumn("key", normal_key(F.col("text"))).filter((F.col("key") != "") & ~F.col("key").rlike(VENDOR_CODE) & ~F.col("key").isin(*sorted(PLACEHOLDERS)))
    parts = F.size(F.split(F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}.']+", " ")), " "))
    best = F.struct(parts.alias("parts"), F.regexp_count("text", F.lit(",")).alias("commas"), F.col("n"), F.col("text"))
    return keyed.groupBy("key").agg(F.max_by("text", best).alias("text"), F.sum("n").alias("n"))


def known_party(text: str) -> bool:
    """Whether a text names a firm, or a person by a given name that is known."""
    found = parse(text)
    return found is not None and (found[0] == "org" or known_given(found[2]))


def parties(found: DataFrame) -> DataFrame:
    """``key, kind, main, facet, n`` of spellings that name a party.

    With a column ``city_texts``, a spelling where it is not NULL is a city, unless one of these texts names a party.
    """
    judged = found if "city_texts" in found.columns else found.withColumn("city_texts", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [
                (parse(t) if c is None or any(map(known_party, c)) else None) or (None, None, None)
                for t, c in zip(b["text"].to_pylist(), b["city_texts"].to_pylist(), strict=True)
            ]
            kind, main, facet = zip(*read, strict=True) if read else ((), (), ())
            yield pa.record_batch(
                [b["key"], pa.array(kind, pa.string()), pa.array(main, pa.string()), pa.array(facet, pa.string()), b["n"]],
                names=["key", "kind", "main", "facet", "n"],
            )

    return judged.mapInArrow(run, "key string, kind string, main string, facet string, n bigint").filter("kind is not null")


# A word as a row of numbers: its letters, then zeros.  A left-out letter shifts those behind it, so with a polynomial
# hash the hashes of all shortened forms follow from running sums; equal forms have equal hashes, and hashes that are
# equal by chance only bring words together that are then compared.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BACK_TWO = np.uint64(pow(int(_BASE), -2, 1 << 64))


def _letters(words: list[str]) -> np.ndarray:
    """Words as rows of letters, short ones filled up with zeros."""
    return np.array(words, dtype=f"<U{max(map(len, words), default=1) or 1}").view(np.uint32).reshape(len(words), -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def block_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word position, key`` of all blocks of words: of the phonetic code, and of the forms without 0, 1 or 2 letters.

    Words of :data:`LONG_WORD` letters and more may lose two, shorter ones one; forms of all lengths are one key space.
    """
    owner = [np.arange(len(words))]
    codes = [phonetic(w) for w in words]
    # the codes' own key space: a letter in front that no form has
    keys = [_hash_of(_letters(["\x01" + c for c in codes])) if words else np.zeros(0, np.uint64)]
    sizes = np.array([len(w) for w in words], int)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        weight = np.multiply.accumulate(np.full(n, _BASE))
        sums = np.zeros((len(at), n + 1), np.uint64)
        sums[:, 1:] = np.cumsum((_letters([words[i] for i in at]).astype(np.uint64) + np.uint64(1)) * weight, axis=1, dtype=np.uint64)
        whole = sums[:, -1]
        # the words with letters that may be wrong lose one or two; letters behind a lost one move forward
        i = np.arange(n)
        one = sums[:, i] + (whole[:, None] - sums[:, i + 1]) * _BACK
        forms = [whole[:, None], one]
        if n >= LONG_WORD:
            i, j = np.triu_indices(n, 1)
            forms.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _BACK + (whole[:, None] - sums[:, j + 1]) * _BACK_TWO)
        all_ = np.sort(np.concatenate(forms, axis=1), axis=1)
        first = np.ones(all_.shape, bool)
        first[:, 1:] = all_[:, 1:] != all_[:, :-1]
        owner.append(at[np.nonzero(first)[0]])
        keys.append(all_[first])
    return np.concatenate(owner), _mixed(np.concatenate(keys)).view(np.int64)


def _hash_of(letters: np.ndarray) -> np.ndarray:
    weight = np.multiply.accumulate(np.full(letters.shape[1], _BASE))
    used = np.where(letters > 0, letters.astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (used * weight).sum(1, dtype=np.uint64)


def errors_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`errors`, without a limit, of many pairs at once: rows of letters ``a`` and ``b``."""
    n, m = a.shape[1], b.shape[1]
    a_len, b_len = (a > 0).sum(1), (b > 0).sum(1)
    table = np.zeros((n + 1, m + 1, len(a)), np.int16)
    table[:, 0] = np.arange(n + 1)[:, None]
    table[0] = np.arange(m + 1)[:, None]
    for x in range(1, n + 1):
        for y in range(1, m + 1):
            same = a[:, x - 1] == b[:, y - 1]
            cost = np.minimum(np.minimum(table[x - 1, y], table[x, y - 1]) + 1, table[x - 1, y - 1] + ~same)
            if x > 1 and y > 1:
                swapped = (a[:, x - 1] == b[:, y - 2]) & (a[:, x - 2] == b[:, y - 1])
                cost = np.where(swapped, np.minimum(cost, table[x - 2, y - 2] + 1), cost)
            table[x, y] = cost
    return table[a_len, b_len, np.arange(len(a))]


def near_pairs(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of different ``words``, given by their places, :func:`alike` may accept: by their typing errors.

    Short words, which must sound the same and may fail by their similarity, are judged in full.
    """
    out = np.zeros(len(x), bool)
    sizes = np.char.str_len(words)
    for at in np.array_split(np.arange(len(x)), max(1, -(-len(x) // PAIRS))):
        short = np.minimum(sizes[x[at]], sizes[y[at]])
        open_ = (np.abs(sizes[x[at]] - sizes[y[at]]) <= 2) & (short >= 3)
        at, short = at[open_], short[open_]
        if not len(at):
            continue
        used = np.unique(np.concatenate([x[at], y[at]]))
        letters = _letters(words[used].tolist())
        found = errors_of(letters[np.searchsorted(used, x[at])], letters[np.searchsorted(used, y[at])])
        out[at] = found <= np.where(short >= LONG_WORD, 2, np.where(short >= SHORT_WORD, 1, 0))
        few = at[(short < SHORT_WORD) & (found == 1)]
        out[few] = [alike(a, b) for a, b in zip(words[x[few]].tolist(), words[y[few]].tolist(), strict=True)]
    return out


def _run_links(keys: np.ndarray, kinds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked words within the runs of equal ``keys`` and kinds (sorted)."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    run = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(keys))
    others = place[~new]
    heads = start[run[others]]
    met = near_pairs(words, heads, others)
    found = [(heads[met], others[met])]
    # few: words of a run that are not alike its first word meet all others of it, pairs of many runs at once
    left = others[~met]
    meet = size[run[left]] - 1
    for part in np.split(np.arange(len(left)), np.searchsorted(np.cumsum(meet), np.arange(PAIRS, meet.sum(), PAIRS))):
        x = np.repeat(left[part], meet[part])
        end = np.cumsum(meet[part])
        y = np.arange(len(x)) - np.repeat(end - meet[part], meet[part]) + start[run[x]] + 1
        x, y = x[x != y], y[x != y]
        near = near_pairs(words, x, y)
        found.append((x[near], y[near]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(mains: DataFrame) -> DataFrame:
    """``kind, a, b`` (``a < b``): links of main words, such that all that are alike are linked or joined by links.

    Every block's words are one run of a sorted key, read in batches.  A word has as many keys as it has shortened
    forms, about n * n / 2, so keys grow with the words; nothing is cut, whatever the size of a block.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 2_000):
                rows = b.slice(part, 2_000)
                owner, key = block_keys(rows["main"].to_pylist())
                at = pa.array(owner)
                yield pa.record_batch([pa.array(key), rows["kind"].take(at), rows["main"].take(at)], names=["key", "kind", "main"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        schema = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string())])

        def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            key, kind = t["key"].to_numpy(), pc.equal(t["kind"], "org").to_numpy()
            # rows of keys of their own, which are most, end here
            equal = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])
            used = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False)) if len(key) else np.zeros(0, int)
            words = np.array(t["main"].take(pa.array(used)).to_pylist(), dtype=str) if len(used) else np.zeros(0, "<U1")
            x, y = _run_links(key[used], kind[used], words)
            pairs = {(k, min(a, b), max(a, b)) for k, a, b in zip(np.where(kind[used][x], "org", "person").tolist(), words[x].tolist(), words[y].tolist(), strict=True) if a != b}
            k, a, b = zip(*sorted(pairs), strict=True) if pairs else ((), (), ())
            return pa.record_batch([pa.array(list(k), pa.string()), pa.array(list(a), pa.string()), pa.array(list(b), pa.string())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            # the last run may go on in the next batch
            keys = b["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            rest.append(b.slice(0, cut))
            if cut and sum(x.num_rows for x in rest) >= RUN_ROWS:
                yield linked(rest)
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield linked(rest)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([jaro_winkler(x, y) >= LEAST_SIMILARITY for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)], pa.bool_()))

    rows = mains.select("kind", "main").mapInArrow(keyed, "key bigint, kind string, main string")
    runs = rows.repartition("key").sortWithinPartitions("key", "kind")
    # a pair is near in each of its blocks, and judged once: words that differ by no more errors than they may are
    # similar enough from SHORT_WORD letters on, so no run was linked by a pair that falls here
    return runs.mapInArrow(compare, "kind string, a string, b string").distinct().mapInArrow(judged, "kind string, a string, b string")


def components(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``: the component's smallest node.

    Every round each node takes its neighbours' smallest root, then its root's root; what is done is written to the
    shared folder, so lost executors cost a round.  Only the number of changed nodes reaches the driver.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        met = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = met.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = staged(met.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = new.filter("was <> root").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def party_of(names: list[DataFrame], cities: DataFrame | None = None) -> DataFrame:
    """``key, party`` of every spelling in one-column frames of names: equal parties are the same party.

    A single word that stands clearly more often in the column of ``cities`` is a city in the wrong field, unless it is
    a party's name without its spaces: then the exchanged copies there have several words that name a party.
    """
    found = spellings(names)
    if cities is not None:
        one_word = ~F.trim(F.col("text")).rlike(SEVERAL_WORDS)
        found = found.join(city_keys(cities), "key", "left").withColumn("city_texts", F.when(one_word & (F.col("cities") > CITY_TIMES * F.col("n")), F.col("texts")))
    read = staged(parties(found))
    mains = staged(read.groupBy("kind", "main").agg(F.sum("n").alias("n")))
    node = lambda c: F.concat("kind", F.lit(":"), F.col(c))
    edges = staged(links(mains).select(node("a").alias("a"), node("b").alias("b")))
    roots = components(edges)
    named = read.withColumn("node", node("main")).join(roots, "node", "left").select("key", "kind", "facet", "n", F.coalesce("root", "node").alias("root"))
    named = staged(named)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root, facet, home = [], [], []
            for r, kind, found in zip(b["root"].to_pylist(), b["kind"].to_pylist(), b["found"].to_pylist(), strict=True):
                for f, h in facets(kind, [(x["facet"], x["n"]) for x in found]).items():
                    root.append(r)
                    facet.append(f)
                    home.append(h)
            yield pa.record_batch([pa.array(x, pa.string()) for x in (root, facet, home)], names=["root", "facet", "home"])

    # one row a class and facet: a class holds as many as there are given names or lines of business
    counted = named.groupBy("root", "kind", "facet").agg(F.sum("n").alias("n"))
    classes = counted.groupBy("root", "kind").agg(F.collect_list(F.struct("facet", "n")).alias("found"))
    homes = classes.mapInArrow(resolve, "root string, facet string, home string")
    return named.join(homes, ["root", "facet"]).select("key", F.xxhash64("root", "home").alias("party"))


def variant_pairs(members: DataFrame) -> DataFrame:
    """``key_a, key_b``: all pairs of different spellings of each party of ``members(key, party)``.

    A party of many spellings is cut into chunks, and each pair of chunks is its own join key.
    """
    members = staged(members)
    sizes = members.groupBy("party").agg(F.count("*").alias("size")).filter("size > 1")
    cut = members.join(sizes, "party").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    cut = staged(cut.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = cut.select("party", F.col("key").alias("key_a"), F.col("chunk").alias("i"), every.alias("j"))
    right = cut.select("party", F.col("key").alias("key_b"), F.col("chunk").alias("j"), every.alias("i"))
    return left.join(right, ["party", "i", "j"]).filter("key_a < key_b").select("key_a", "key_b")


def city_keys(cities: DataFrame) -> DataFrame:
    """``key, cities, texts``: how often each key stands in a column of cities, and its texts of several words there."""
    c = F.col(cities.columns[0])
    several = F.when(F.trim(c).rlike(SEVERAL_WORDS), c)
    return cities.filter(c.isNotNull()).groupBy(normal_key(c).alias("key")).agg(F.count("*").alias("cities"), F.collect_set(several).alias("texts"))
