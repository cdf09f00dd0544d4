"""Personal information inside free text (problem 5)."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.plain_text import FILLERS, TO_LATIN, Memo, _forms
from chronoloom.spark_tools import latest_records, latest_rows

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
#: Persons in one automaton; more are matched in blocks of this size, each over all texts.
PEOPLE_BLOCK = 50_000

# Letters that lose no accent when decomposed but are commonly written plainly.
PLAIN_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"}
SPELLED_OUT = {"ä": "ae", "ö": "oe", "ü": "ue", "ø": "oe", "å": "aa"}

AT_CUES = ["@", "[at]", "(at)", "{at}", "<at>", " at "]
ID_CUES = ["ssn", "social security", "social-security", "social_security", "national insurance", "national-insurance", "national_insurance", "nino", "ni number", "ni-number", "ni no", "passport", "reisepass", "passeport", "steuer-id", "steuer id", "steuer_id", "steuerid", "steueridentifikationsnummer", "idnr", "tax id", "tax-id", "tax_id", "taxpayer", "identity card", "identity-card", "identity_card", "id card", "id-card", "id_card", "personalausweis", "ausweis", "identity no", "identity number", "carte d'identite"]
PHONE_CUES = ["tel", "call", "phone", "ring", "dial", "voicemail", "mobile", "fax", "sms", "contact"]
STREET_CUES = ["street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "close", "court", "ct", "drive", "dr", "way", "place", "square", "sq", "terrace", "crescent", "gardens", "grove", "mews", "boulevard", "blvd", "parkway", "highway", "hill", "row", "walk", "rue", "quai", "impasse", "chemin", "route", "cours", "allee", "strasse", "str", "weg", "platz", "gasse", "damm", "ufer", "chaussee", "steig", "pfad", "markt"]

LOCAL_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\{dot\}\s?|\sdot\s)"
DOMAIN = regex.compile(rf"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:{DOT}[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)+")
SPLIT_DOT = regex.compile(DOT)
FILE_ENDINGS = set("png jpg jpeg gif svg webp ico pdf csv tsv txt zip gz tar doc docx xls xlsx ppt pptx md log eml msg json xml yaml yml html htm js ts py rs go sql css wav mp3 mp4 mov bak".split())

SSN = regex.compile(r"(?<![a-z0-9])(?<!\d[-.])\d{3}([-–. _])\d{2}\1\d{4}(?![a-z0-9])(?![-.]\d)")
NINO = regex.compile(r"(?<![a-z0-9])[a-z]{2}[\s\-_.]?\d{2}[\s\-_.]?\d{2}[\s\-_.]?\d{2}[\s\-_.]?[a-d](?![a-z0-9])")
CUED_IDS = [
    regex.compile(r"(?<![a-z0-9])(?<!\d[-. ])\d{2}[\s\-_./]?\d{3}[\s\-_./]?\d{3}[\s\-_./]?\d{3}(?![a-z0-9])"),
    regex.compile(r"(?<![a-z0-9])[a-z]{1,2}[\s\-]?\d{6,8}(?![a-z0-9])"),
    regex.compile(r"(?<![a-z0-9])[a-z]\d{2}[\s\-]?[a-z]\d{2}[\s\-]?[a-z]\d{3}(?![a-z0-9])"),
    regex.compile(r"(?<![a-z0-9])(?<!\d[-. ])\d{9}(?![a-z0-9])"),
]
#: Characters between an identifier cue and its number.
CUE_REACH = 45

EXTENSION = r"(?:[\s,\-_]{0,2}(?:x|ext\.?|extension)[\s.]?\d{1,5})?"
PHONES = [
    regex.compile(rf"(?<![\d+])(?:\+\s?|(?<![\d.\-])00\s?)(?:1|[2-9]\d{{0,2}})(?:[\s.\-_/]{{0,2}}\(\d{{1,4}}\))?(?:[\s.\-_/]{{0,2}}\d){{7,12}}(?!\d){EXTENSION}"),
    regex.compile(rf"(?<!\d)(?<!\d[\-.])(?:1[\-. _])?(?:\([2-9]\d{{2}}\)[\s_\-.]?|[2-9]\d{{2}}[\-. _])[2-9]\d{{2}}[\-. _]\d{{4}}(?!\d)(?![\-.]\d){EXTENSION}"),
]
NATIONAL = regex.compile(rf"(?<!\d)(?<!\d[\-./ _])(?:\(0\d{{1,4}}\)|0\d{{1,4}})(?:[\s/_\-.]{{0,1}}\d){{5,9}}(?!\d){EXTENSION}")
BARE = regex.compile(r"(?<![\da-z])(?<!\d[\-. ])1?[2-9]\d{2}[2-9]\d{6}(?!\d)")
DATE = regex.compile(r"\d{1,2}[./\-]\d{1,2}[./\-](?:19|20)\d{2}(?!\d)")
#: A run of digits with at most three signs between them; runs with at most two letters or signs more between them are one anchor.
DIGIT_RUN = regex.compile(r"\d(?:[^a-z\d]{0,3}\d)*")
RUN_GAP = 5
#: Signs before and behind a run that a number may reach to: letters of an identifier, brackets, an extension.
BEFORE_RUN, BEHIND_RUN = 6, 16
#: Signs before and behind a street word that an address may reach to.
BEFORE_STREET, BEHIND_STREET = 60, 60
#: Street words that stand at the end of a longer word as well.
SUFFIX_CUES = frozenset(["strasse", "str", "weg", "platz", "allee", "gasse", "damm", "ufer", "chaussee", "steig", "pfad", "markt"])

GAP = r"(?:[\s+_\-]|,\s?|\.\s)"
NOT_A_NAME = r"(?!(?:new|more|unread|min|mins|minutes?|hours?|days?|pages?|messages?|items?|of|the|on|and|at|in|to|for|by|a|an|is|or)\b)"
HOUSE = r"(?<![a-z0-9.:%#$€])(?<!\d[,.\-/])(?:\d{1,4}[a-d]?)"
UNIT = r"(?:,?[\s+_\-](?:apt|apartment|flat|unit|suite)\.?[\s+_\-]?[a-z0-9]{1,4}(?![a-z0-9]))?"
STREETS = [
    regex.compile(rf"{HOUSE}{GAP}(?:{NOT_A_NAME}[a-z][a-z'’]{{2,}}{GAP}){{1,2}}(?:street|st|road|rd|avenue|ave|lane|ln|close|court|ct|drive|terrace|crescent|boulevard|blvd|square|gardens|grove|mews|parkway|highway)(?![a-z0-9]){UNIT}"),
    regex.compile(rf"{HOUSE}{GAP}{NOT_A_NAME}[a-z][a-z'’]{{2,}}{GAP}(?:way|place|hill|row|walk|dr|sq)(?![a-z0-9]){UNIT}"),
    regex.compile(rf"{HOUSE}(?:\s?(?:bis|ter))?{GAP}(?:rue|quai|impasse|chemin)(?:{GAP}|')(?:[a-z]+(?:[\s+_\-]|')){{0,3}}[a-z]{{2,}}"),
    regex.compile(rf"{HOUSE}(?:\s?(?:bis|ter))?{GAP}(?:avenue|boulevard|place|allee|route|cours){GAP}(?:de{GAP}la|des|du|de|d')(?:{GAP}|(?<='))[a-z]{{3,}}"),
    regex.compile(r"(?<![a-z])[a-z]{3,}(?:strasse|str\.?|weg|platz|allee|gasse|damm|ufer|chaussee|steig|pfad|markt)[\s_+\-]{1,2}\d{1,3}(?:\s?[a-h])?(?![a-z0-9])"),
    regex.compile(r"(?<![a-z])[a-z]{3,}[\s\-_](?:strasse|str\.|allee|platz|weg)[\s_+\-]{1,2}\d{1,3}(?:\s?[a-h])?(?![a-z0-9])"),
]

NAME_GAP = r"(?:, ?|[ ._+\-/\\,]|\. |%20)"


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, plain forms, single spaces, without accents, percent signs and invisible characters, and where each of its characters begins
    in the original (with its end last); None for the places of texts that are folded one to one."""
    if text.isascii() and "%" not in text and "  " not in text and text.isprintable():
        return text.lower(), None
    out: list[str] = []
    at: list[int] = []

    def put(s: str, i: int) -> None:
        if s == " " and out and out[-1] == " ":
            return
        if not s:
            return
        out.append(s)
        at.extend([i] * len(s))

    forms, i, n = _forms(), 0, len(text)
    while i < n:
        ch, start = text[i], i
        i += 1
        if ch == "%" and regex.match(r"[0-9A-Fa-f]{2}", text[i : i + 2]):
            raw = bytearray()
            j = start
            while j < n and text[j] == "%" and regex.match(r"[0-9A-Fa-f]{2}", text[j + 1 : j + 3]):
                raw.append(int(text[j + 1 : j + 3], 16))
                j += 3
            # Each decoded character stands where its first byte is written.
            k = start
            for c in raw.decode("utf-8", errors="replace"):
                for d in _letters(c, forms):
                    put(d, k)
                k += 3 * len(c.encode("utf-8")) if c != "�" else 3
            i = j
            continue
        put(_letters(ch, forms), start)
    at.append(n)
    return "".join(out), at


def _letters(ch: str, forms: dict[int, str]) -> str:
    if ch.isspace():
        return " "
    if ch.isascii():
        return ch.lower() if ch.isprintable() else ""
    if ch in FILLERS or unicodedata.category(ch) in ("Cf", "Cc"):
        return ""
    ch = forms.get(ord(ch), ch)
    out = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
    out = "".join(TO_LATIN.get(c, c) for c in out).casefold()
    return "".join(PLAIN_LETTERS.get(c, c) for c in out)


def _variants(name: str) -> set[str]:
    low = unicodedata.normalize("NFC", name).lower()
    spelled = "".join(SPELLED_OUT.get(c, c) for c in low)
    return {v for x in (low, spelled) if (v := folded(x)[0].strip())}


class Finder:
    """Finds personal information: one Aho-Corasick pass gives anchors, local parsers expand and validate around them."""

    def __init__(self, people: list[tuple[str | None, str | None]], types: tuple[str, ...] = TYPES):
        self.types = types
        self.given: dict[str, set[str]] = defaultdict(set)
        for given, family in people:
            if given and given.strip() and family and family.strip():
                for f in _variants(family):
                    self.given[f] |= _variants(given)
        self.names = {f: self._name_parsers(g) for f, g in self.given.items()}
        self.longest = max((len(x) for g in self.given.values() for x in g), default=0)
        self.numbers = bool({"phone", "id_number", "address"} & set(types))
        words: dict[str, set] = defaultdict(set)
        for kind, cues in (("at", AT_CUES), ("id", ID_CUES), ("phone", PHONE_CUES), ("street", STREET_CUES), ("name", self.given)):
            for cue in cues if self.numbers or kind in ("at", "name") else ():
                words[cue].add(kind)
        self.automaton = ahocorasick.Automaton()
        for w, kinds in words.items():
            self.automaton.add_word(w, (w, tuple(sorted(kinds))))
        self.automaton.make_automaton()

    @staticmethod
    def _name_parsers(given: set[str]) -> tuple:
        whole = "|".join(regex.escape(g) for g in sorted(given, key=len, reverse=True))
        first = "".join(sorted({regex.escape(g[0]) for g in given}))
        left = rf"(?<![a-z])(?:(?:{whole}){NAME_GAP}(?:[a-z]\.?{NAME_GAP})?|[{first}](?:\.?{NAME_GAP}(?:[a-z]\.?{NAME_GAP})?)|(?:{whole}|[{first}]))$"
        right = rf"{NAME_GAP}(?:(?:{whole})(?![a-z])|[{first}](?![a-z0-9'’]))"
        return regex.compile(left), regex.compile(right)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of each item in the original text, in order, without overlap; emails before numbers before addresses before names."""
        f, at = folded(text)
        anchors: dict[str, list[tuple[int, int, str]]] = {}
        for end, (word, kinds) in self.automaton.iter(f):
            for kind in kinds:
                if kind == "phone" and end >= len(word) and f[end - len(word)].isalpha():
                    continue
                anchors.setdefault(kind, []).append((end + 1 - len(word), end + 1, word))
        runs = self._runs(f) if self.numbers else []
        if not anchors and not runs:
            return []
        found: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if kind in self.types and all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))

        for a, b, word in anchors.get("at", ()):
            if span := self._email(f, a, b, word):
                add(*span, "email")
        long = [(a, b) for a, b, n in runs if n >= 6]
        if long:
            self._ids(f, long, [(a, b) for a, b, _ in anchors.get("id", ())], add)
            self._phones(f, long, "phone" in anchors, add)
        if runs:
            for a, b, word in anchors.get("street", ()):
                if span := self._street(f, a, b, word, runs):
                    add(*span, "address")
        for a, b, word in anchors.get("name", ()):
            if span := self._name(f, a, b, word):
                add(*span, "name")
        found.sort()
        if at is None:
            return found
        return [(at[a], self._end(at, b, len(text)), kind) for a, b, kind in found]

    @staticmethod
    def _runs(f: str) -> list[tuple[int, int, int]]:
        """(start, end, digits) of each anchor of digits."""
        out: list[tuple[int, int, int]] = []
        for m in DIGIT_RUN.finditer(f):
            n = sum(map(str.isdigit, m[0]))
            if out and m.start() - out[-1][1] <= RUN_GAP:
                out[-1] = (out[-1][0], m.end(), out[-1][2] + n)
            else:
                out.append((m.start(), m.end(), n))
        return out

    @staticmethod
    def _end(at: list[int], b: int, n: int) -> int:
        last = at[b - 1]
        while b < len(at) and at[b] == last:
            b += 1
        return at[b] if b < len(at) else n

    @staticmethod
    def _email(f: str, a: int, b: int, word: str) -> tuple[int, int] | None:
        left, right = a, b
        if word != " at ":
            while left > 0 and f[left - 1] == " " and a - left < 2:
                left -= 1
            while right < len(f) and f[right] == " " and right - b < 2:
                right += 1
            if word == "@" and (left < a) != (right > b):
                return None
        start = left
        while start > 0 and f[start - 1] in LOCAL_SIGNS:
            start -= 1
        while start < left and not f[start].isalnum():
            start += 1
        domain = DOMAIN.match(f, right)
        if start == left or not domain:
            return None
        labels = [x for x in SPLIT_DOT.split(domain.group()) if x]
        end = domain.end()
        if word == " at " and "dot" not in domain.group():
            return None
        if labels[-1] in FILE_ENDINGS and (len(labels) < 3 or not labels[-2].isalpha()):
            return None
        if labels[-1] in FILE_ENDINGS:
            end = right + domain.group().rindex(labels[-1]) - 1
            labels = labels[:-1]
        if len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2:
            return None
        return start, end

    @staticmethod
    def _near(pattern: regex.Pattern, f: str, runs: list[tuple[int, int]]) -> Iterator[regex.Match]:
        """Matches that a run of digits expands to."""
        for a, b in runs:
            yield from pattern.finditer(f, max(0, a - BEFORE_RUN), min(len(f), b + BEHIND_RUN))

    def _ids(self, f: str, runs: list[tuple[int, int]], cues: list[tuple[int, int]], add) -> None:
        for pattern in (SSN, NINO):
            for m in self._near(pattern, f, runs):
                add(m.start(), m.end(), "id_number")
        if cues:
            for pattern in CUED_IDS:
                for m in self._near(pattern, f, runs):
                    if any(m.start() - CUE_REACH <= b <= m.start() or m.end() <= a <= m.end() + CUE_REACH for a, b in cues):
                        add(m.start(), m.end(), "id_number")

    def _phones(self, f: str, runs: list[tuple[int, int]], cued: bool, add) -> None:
        for pattern in PHONES:
            for m in self._near(pattern, f, runs):
                add(m.start(), m.end(), "phone")
        for m in self._near(NATIONAL, f, runs):
            digits = sum(c.isdigit() for c in regex.sub(r"(?:x|ext).*$", "", m.group()))
            written = m.group().isdigit()
            if 9 <= digits <= 12 and not DATE.match(m.group()) and (not written or cued or (digits == 11 and m.group().startswith("07"))):
                add(m.start(), m.end(), "phone")
        if cued:
            for m in self._near(BARE, f, runs):
                add(m.start(), m.end(), "phone")

    @staticmethod
    def _street(f: str, a: int, b: int, word: str, runs: list[tuple[int, int, int]]) -> tuple[int, int] | None:
        """The address around a street word with a house number near it."""
        if b < len(f) and f[b].isalpha() or a > 0 and f[a - 1].isalpha() and word not in SUFFIX_CUES:
            return None
        lo, hi = max(0, a - BEFORE_STREET), min(len(f), b + BEHIND_STREET)
        if not any(x < hi and y > lo for x, y, _ in runs):
            return None
        for pattern in STREETS:
            for m in pattern.finditer(f, lo, hi):
                if m.start() <= a and b <= m.end():
                    return m.start(), m.end()
        return None

    def _name(self, f: str, a: int, b: int, family: str) -> tuple[int, int] | None:
        if b < len(f) and f[b].isalpha():
            return None
        left, right = self.names[family]
        if m := left.search(f, max(0, a - self.longest - 12), a):
            return m.start(), b
        if a > 0 and f[a - 1].isalpha():
            return None
        if m := right.match(f, b):
            return a, m.end()
        return None

    def kinds(self, text: str) -> int:
        """Bits of the types that the text holds, in the order of TYPES."""
        out = 0
        for _, _, kind in self.spans(text):
            out |= 1 << TYPES.index(kind)
        return out

    def redacted(self, text: str) -> str:
        """The text with each item replaced by its type's placeholder, all else unchanged."""
        out, last = [], 0
        for a, b, kind in self.spans(text):
            out += [text[last:a], PLACEHOLDERS[kind]]
            last = b
        return "".join([*out, text[last:]])


def _people_blocks(people: DataFrame | None) -> list[list[tuple[str, str]]]:
    """Distinct persons in blocks of at most PEOPLE_BLOCK; names are read through an iterator, a partition at a time."""
    if people is None:
        return [[]]
    blocks: list[list[tuple[str, str]]] = [[]]
    for row in people.select("given_name", "family_name").distinct().toLocalIterator():
        if len(blocks[-1]) >= PEOPLE_BLOCK:
            blocks.append([])
        blocks[-1].append((row[0], row[1]))
    return blocks


def _udf(people: list[tuple[str, str]], types: tuple[str, ...], redact: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(people, types)
        memo = Memo(finder.redacted if redact else finder.kinds)
        for batch in batches:
            if redact:
                yield pd.Series([None if t is None else memo[t] for t in batch], dtype=object)
            else:
                yield pd.Series([0 if t is None else memo[t] for t in batch], dtype="int32")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType() if redact else T.IntegerType())


def redact_columns(df: DataFrame, columns: list[str], people: DataFrame | None = None) -> DataFrame:
    """`df` with each of `columns` rewritten: every item of personal information replaced by a placeholder of its type.

    Null stays null, empty stays empty, a text without items comes out unchanged byte for byte; whole texts are searched whatever their
    length; other columns, also of clashing names such as 'name' or 'email', are untouched. Rows are independent: no shuffle.
    Method: anchor expansion. One automaton of at-signs, identifier, telephone and street cues and family names, and a scan for runs of digits,
    give the anchors of the folded text (plain forms, no accents, percent signs decoded); deterministic local parsers expand each anchor and check its
    borders: addresses of mail around at-signs, identifiers and telephones around runs, streets around street words, persons around family names.
    """
    blocks = _people_blocks(people)
    for i, block in enumerate(blocks):
        udf = _udf(block, TYPES if i == 0 else ("email", "name"), True)  # only what a block of persons can change
        df = df.withColumns({c: udf(F.col(c)) for c in columns})
    return df


def info_bits(blocks: list[list[tuple[str, str]]], column: str) -> Column:
    out = None
    for i, block in enumerate(blocks):
        bits = _udf(block, TYPES, False)(F.col(column))  # emails hide names inside, so every block looks for all types
        out = bits if out is None else out.bitwiseOR(bits)
    return out


def redacted_activity(activity: DataFrame, people: DataFrame, fields: tuple[str, ...] = ("title", "url_path", "file")) -> DataFrame:
    """event_id and the fields of counted records, with placeholders in place of personal information and all else unchanged."""
    return redact_columns(latest_records(activity, ["event_id", *fields]), list(fields), people)


def personal_info(activity: DataFrame, people: DataFrame, fields: tuple[str, ...] = ("title", "url_path", "file")) -> DataFrame:
    """event_id, field, pii_type of counted records: every type that a field holds at least one item of.

    Texts are searched before records are deduplicated, so that shuffles carry bits in place of texts. Records without an id are left out.
    """
    blocks = _people_blocks(people)
    bits = [F.when(F.col(f).isNotNull(), info_bits(blocks, f)).alias(f"_b{i}") for i, f in enumerate(fields)]
    rows = activity.select("event_id", "start_ts", "end_ts", "ingested_at", *bits).where("event_id is not null")
    rows = latest_rows(rows, "event_id", "ingested_at", ["start_ts", "end_ts"])
    cases = [F.when(F.col(f"_b{i}").bitwiseAND(F.lit(1 << k)) != 0, F.struct(F.lit(f).alias("field"), F.lit(t).alias("pii_type"))) for i, f in enumerate(fields) for k, t in enumerate(TYPES)]
    return rows.select("event_id", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("x")).select("event_id", "x.*")
