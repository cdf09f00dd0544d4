"""Visually identical text in one form (problem 6)."""

from __future__ import annotations

import functools
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.spark_tools import latest_records, latest_rows

# Letters of other scripts that look like a Latin letter, by script.
LOOK_ALIKES = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаесһіјорԛѕѵԝхуүԁӏ", "ABESIJKMHOPCTYXYGQWaechijopqsvwxyydl")),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳϲοανιρυκ", "ABEZHIKMNOPTYXCjcoavipuk")),
    "Armenian": dict(zip("ՕՏԼսօհոցզ", "OSLuohngq")),
}
TO_LATIN = {c: a for letters in LOOK_ALIKES.values() for c, a in letters.items()}
#: Scripts written together in Japanese count as one.
ONE_SCRIPT = {"Han": "Japanese", "Hiragana": "Japanese", "Katakana": "Japanese"}
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_MIXED = regex.compile(r"[\p{L}\p{M}]*[^\x00-\x7f][\p{L}\p{M}]*")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}\ufe0f\u20e3#*0-9]")
_RTL = regex.compile(r"[\p{Script=Arabic}\p{Script=Hebrew}\p{Script=Syriac}\p{Script=Thaana}]")
_ASCII = regex.compile(r"[ -~]*")
#: Marks without a glyph besides the format characters (category Cf).
FILLERS = set("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u2065\u3164\uffa0") | {chr(c) for c in range(0xFE00, 0xFE10)}
HYPHENS = {"‐", "‑", "﹣", "－"}
#: Compatibility forms that look like what they stand for; powers, circles, squares and fractions look different.
ALIKE_FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<small>"}


@functools.cache
def _script_patterns() -> dict[str, regex.Pattern]:
    """A pattern for every script whose name letters begin with, by the names of the character database; found once per worker."""
    places = (*range(0x41, 0x3400), *range(0xA000, 0xABFF), *range(0xF900, 0x12000), 0x4E00, 0xAC00)
    names = [unicodedata.name(chr(cp), "").split() for cp in places if unicodedata.category(chr(cp))[0] == "L"]
    heads = {"_".join(words[:n]).title() for words in names for n in (1, 2, 3)} | {"Han"}
    out = {}
    for head in sorted(heads - {"Common", "Inherited"}):
        try:
            out[head] = regex.compile(rf"\p{{Script_Extensions={head}}}")
        except regex.error:
            continue
    return out


@functools.cache
def _scripts(ch: str) -> frozenset[str]:
    """The scripts that a character is used in; none for those that belong to every script."""
    return frozenset(ONE_SCRIPT.get(name, name) for name, pattern in _script_patterns().items() if pattern.match(ch))


@functools.cache
def _script(ch: str) -> str:
    """The one script of a letter, or one of those that a mark is used in."""
    return min(_scripts(ch), default="")


def _plain_form(ch: str) -> str:
    """What a character of unusual form stands for, itself if it is plain; invisible ones are not treated here."""
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).rpartition(">")
    if not rest:
        return ch
    if not tag:
        return unicodedata.normalize("NFC", ch)  # singletons such as the kelvin sign
    tag += ">"
    name = unicodedata.name(ch, "")
    if tag in ALIKE_FORMS or (tag == "<compat>" and (kind == "Nl" or "LIGATURE" in name or (0x2100 <= ord(ch) <= 0x214F and ch != "№"))):
        return unicodedata.normalize("NFKC", ch)
    return ch


@functools.cache
def _forms() -> dict[int, str]:
    """Every character whose plain form is another; built once per worker from the character database."""
    out = {}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if (unicodedata.decomposition(ch) or unicodedata.category(ch) == "Zs" or ch in HYPHENS) and not 0xAC00 <= cp <= 0xD7A3 and not 0xF900 <= cp <= 0xFAFF:
            if (p := _plain_form(ch)) != ch:
                out[cp] = p
    return out


def _visible(text: str) -> str:
    """Without invisible characters, except where they change what is seen."""
    out: list[str] = []
    for i, ch in enumerate(text):
        if ch not in FILLERS and unicodedata.category(ch) != "Cf":
            out.append(ch)
            continue
        before, after = (out[-1] if out else ""), next((c for c in text[i + 1 :] if c not in FILLERS and unicodedata.category(c) != "Cf"), "")
        keep = False
        if ch == "\u200d":  # joiner: between emoji, after a virama, beside Arabic letters
            keep = bool(before and after and _EMOJI.match(before) and _EMOJI.match(after) and not before.isascii()) or _is_virama(before) or (_script(before) == "Arabic" and _script(after) != "Arabic")
        elif ch == "\u200c":  # non-joiner: between letters that would join
            keep = _is_virama(before) or (before != "" and _script(before) == "Arabic" and _script(after) == "Arabic")
        elif "\ufe00" <= ch <= "\ufe0f":
            keep = before != "" and (bool(regex.match(r"[\p{Emoji}]", before)) and ch in "\ufe0e\ufe0f" or _script(before) in ("Japanese", "Mongolian"))
        elif "\u180b" <= ch <= "\u180d":
            keep = _script(before) == "Mongolian"
        elif "\U000e0020" <= ch <= "\U000e007f":
            keep = before != "" and (_EMOJI.match(before) is not None or "\U000e0020" <= before <= "\U000e007f")
        elif ch in "\u200e\u200f\u061c\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069":
            keep = ch != "\u200e" and _RTL.search(text) is not None or ch == "\u200e" and before != "" and _RTL.search(text[:i]) is not None and _RTL.search(text[i:]) is not None
        elif 0x600 <= ord(ch) <= 0x605 or ord(ch) in (0x6DD, 0x70F, 0x8E2, 0x110BD):
            keep = True  # signs of numbers, which are seen
        if keep:
            out.append(ch)
    return "".join(out)


def _is_virama(ch: str) -> bool:
    return ch != "" and unicodedata.combining(ch) == 9


class Letters:
    """Letters that look like a Latin letter, with the script of each, and the spelling of words with them."""

    def __init__(self, table: dict[str, tuple[str, str]]):
        self.to_latin = {c: latin for c, (_, latin) in table.items()}
        self.of_script: dict[str, dict[str, str]] = {}
        for c, (script, latin) in table.items():
            self.of_script.setdefault(script, {}).setdefault(latin, c)
        self.spelled: dict[str, frozenset[str]] = {}

    def spellings(self, word: str) -> frozenset[str]:
        """Scripts in which the whole word can be spelled: the intersection of its letters' script sets, each with those of its look-alikes."""
        if (known := self.spelled.get(word)) is not None:
            return known
        both: set[str] | None = None
        for ch in word:
            if not (s := _scripts(ch)):
                continue
            sets = set(s)
            latin = ch if "Latin" in s else self.to_latin.get(ch)
            if latin is not None:
                sets |= {"Latin"} | {other for other, letters in self.of_script.items() if latin in letters}
            both = sets if both is None else both & sets
        if len(self.spelled) > 50_000:
            self.spelled.clear()
        out = self.spelled[word] = frozenset(both or ())
        return out

    def respelled(self, word: str, script: str) -> str:
        out = []
        for ch in word:
            s = _scripts(ch)
            latin = self.to_latin.get(ch, ch)
            out.append(ch if not s or script in s else latin if script == "Latin" else self.of_script.get(script, {}).get(latin, ch))
        return "".join(out)

    def mixed(self, text: str) -> str:
        """Each word of mixed scripts in one of those in which it can be spelled: that which most letters of the text belong to beyond doubt, and
        among equals the one that most of its own letters have."""
        sets = {w: [s for ch in w if (s := _scripts(ch))] for w in set(_WORD.findall(text)) if not w.isascii()}
        words = [w for w, s in sets.items() if s and not frozenset.intersection(*s)]
        if not words:
            return text
        sure = Counter(next(iter(can)) for ch in text if len(can := self.spellings(ch)) == 1)
        fixed = {}
        for w in words:
            own = Counter(s for one in sets[w] for s in one)
            if can := self.spellings(w):
                fixed[w] = self.respelled(w, max(can, key=lambda s: (sure[s], own[s], s == "Latin", s)))
        return _WORD.sub(lambda m: fixed.get(m.group(), m.group()), text)

    def whole(self, text: str) -> str:
        """Each word wholly of look-alikes of one script in Latin letters, if the text has Latin letters and no letter that belongs to that script alone."""
        fixed = {}
        for w in {w for w in _WORD.findall(text) if not w.isascii()}:
            scripts = {s for ch in w if (s := _script(ch))}
            if len(scripts) != 1 or not all(ch in self.to_latin or not _scripts(ch) for ch in w):
                continue
            rest = _WORD.sub(lambda m, w=w: "" if m.group() == w else m.group(), text)
            own = any(_script(ch) in scripts and ch not in self.to_latin for ch in text)
            if not own and any(_script(ch) == "Latin" for ch in rest):
                fixed[w] = self.respelled(w, "Latin")
        return _WORD.sub(lambda m: fixed.get(m.group(), m.group()), text) if fixed else text


USUAL = Letters({c: (script, latin) for script, letters in LOOK_ALIKES.items() for c, latin in letters.items()})


def look_alikes(spark: SparkSession) -> Letters:
    """USUAL and every other letter that the confusables data of the platform's Unicode library gives the skeleton of a Latin letter: some hundreds, whatever
    the data. USUAL alone where the library is missing."""
    table = {c: (script, latin) for script, letters in LOOK_ALIKES.items() for c, latin in letters.items()}
    places = (*range(0x370, 0x3040), *range(0xA4D0, 0xAC00), *range(0x10000, 0x12000), *range(0x16F00, 0x16FA0))
    others = [ch for ch in map(chr, places) if unicodedata.category(ch) in ("Lu", "Ll", "Lo", "Lt") and not unicodedata.decomposition(ch)]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:  # a package without the class
        return USUAL
    skeletons = checker.getSkeleton("\n".join([*string.ascii_letters, *others])).split("\n")
    latin: dict[str, list[str]] = {}
    for c, k in zip(string.ascii_letters, skeletons):
        latin.setdefault(k, []).append(c)
    for c, k in zip(others, skeletons[len(string.ascii_letters) :]):
        if c not in table and (found := latin.get(k)) and (script := _script(c)) not in ("", "Latin"):
            table[c] = (script, ([x for x in found if x.isupper() == c.isupper()] or found)[0])
    return Letters(table)


def plain_characters(text: str) -> str:
    """Composed accents; letters, digits and signs of ordinary width, no ligatures or letter-like signs; ordinary spaces and hyphens (their number is
    kept); no invisible characters except where they change what is seen."""
    out = text.translate(_forms()) if not text.isascii() else text
    out = "".join(c for c in out if c in "\t\n\r" or unicodedata.category(c) != "Cc")
    return out if out.isascii() else unicodedata.normalize("NFC", _visible(out))


def plain_steps(text: str, letters: Letters = USUAL) -> tuple[str, str, str]:
    """The text after each step: plain characters, mixed words in one script, words wholly of look-alikes in the script of the text."""
    out = plain_characters(text)
    if not _MIXED.search(out):
        return out, out, out
    mixed = unicodedata.normalize("NFC", letters.mixed(out))  # a respelled letter may take its accent in
    return out, mixed, unicodedata.normalize("NFC", letters.whole(mixed))


def plain_text(text: str | None, whole_words: bool = True, letters: Letters = USUAL) -> str | None:
    """The consistent form of a text: plain characters, each word in letters of one script where that can be had; null for null."""
    if text is None or _ASCII.fullmatch(text):
        return text
    return plain_steps(text, letters)[2 if whole_words else 1]


class Memo(dict):
    """Remembers results of a worker; emptied when full, so its memory is bounded."""

    def __init__(self, fn, size: int = 100_000):
        super().__init__()
        self.fn, self.size = fn, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        self[key] = out = self.fn(key)
        return out


#: What a text isn't plain in: its characters, words of mixed scripts, words wholly of look-alikes.
CHARACTERS, MIXED, WHOLE = 1, 2, 4


def unlike(text: str, letters: Letters = USUAL) -> int:
    """Bits of what differs from the plain form."""
    steps = (text, *plain_steps(text, letters))
    return sum(bit for bit, a, b in zip((CHARACTERS, MIXED, WHOLE), steps, steps[1:]) if a != b)


def _mapped(fn, letters: Letters, kind: T.DataType, missing):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(lambda t: fn(t, letters=letters))
        for batch in batches:
            yield pa.array([missing if t is None else memo[t] for t in batch.to_pylist()], pa.string() if kind == T.StringType() else pa.int32())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


#: Texts of these characters only are plain; they never leave the JVM.
PLAIN_ASCII = r"^[ -~]*$"


def with_plain_text(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds `to`, the consistent form of `column` in which texts that look the same are equal; an existing column `to` is replaced.

    Null stays null and empty stays empty. Plain ASCII texts, by far the most, are passed over by a built-in test; only the rest go through
    Arrow batches. There is no shuffle, and rows are independent, so ties, repeats and skew don't matter.
    """
    odd = F.when(~F.col(column).rlike(PLAIN_ASCII), F.col(column))
    return df.withColumn(to, F.coalesce(_mapped(plain_text, look_alikes(df.sparkSession), T.StringType(), None)(odd), F.col(column)))


def plain_activity(activity: DataFrame, fields: tuple[str, ...] = ("title", "app")) -> DataFrame:
    """event_id and the fields of counted records in plain form, words wholly of look-alikes too."""
    out = latest_records(activity, ["event_id", *fields])
    for f in fields:
        out = with_plain_text(out, f, f)
    return out


def not_plain(activity: DataFrame, fields: tuple[str, ...] = ("title", "app"), kinds: int = CHARACTERS | MIXED) -> DataFrame:
    """event_id, field of counted records whose value is not in plain form though it looks like it, in any of `kinds`.

    A word wholly of look-alikes is in letters of one script, so by itself it is plain; WHOLE asks for such words as well. The test runs before
    records are deduplicated, so that no text is shuffled. Records without an id are left out.
    """
    bits = _mapped(unlike, look_alikes(activity.sparkSession), T.IntegerType(), 0)
    odd = [(F.coalesce(bits(F.when(~F.col(f).rlike(PLAIN_ASCII), F.col(f))), F.lit(0)).bitwiseAND(F.lit(kinds)) != 0).alias(f"_odd{i}") for i, f in enumerate(fields)]
    rows = activity.select("event_id", "start_ts", "end_ts", "ingested_at", *odd).where("event_id is not null")
    rows = latest_rows(rows, "event_id", "ingested_at", ["start_ts", "end_ts"])
    named = F.filter(F.array(*[F.when(F.col(f"_odd{i}"), F.lit(f)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
    return rows.select("event_id", F.explode(named).alias("field"))
