"""Personal data in texts, in plain form and behind disguises (operator 13).

Base spans are the contract's: email, ip, card and phone as patterns over the source, leftmost and non-overlapping per
kind, failing ones dropped. The patterns are scanned so that each takes time in proportion to the text: an email from
each @ outwards, addresses from maximal dotted chains.

Added spans come from offset-preserving transducers. Each rewrites the text and carries, for every character that it
puts out, the source span that it stands for:

1. homoglyphs: other widths, styles and scripts of letters, digits, dots, dashes and spaces; invisible characters go;
2. spelled digits (English, German, French, Spanish; double, triple), letters O, o, I, l among digits, plus for +;
3. at and dot in brackets, between underscores, or as words of their own.

The base patterns find identifiers in what comes out, and their ends are mapped back to source characters. A bare `at`
counts only before a domain with a disguised dot, or after a name with a digit, dot or underscore before a real domain.
A span is added if it holds a rewritten character and no base span of its kind contains it; one that overlaps a base
span of its kind is added only if something stronger than bare words was rewritten in it.

Defined results: null or empty text has no spans; repeated rows are searched each; ties of start are ordered by kind,
then end; an empty table gives no rows; texts are whole. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # a chain of one part too, so that no start is tried twice
PART = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Lookalikes of Latin letters, by letter.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    ".": "․‧·•∙。｡۔", "-": "−‑", "@": "ⓐ", "+": "➕",
}
#: Digits in words, from 0, by language.
SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT = "at|arroba|arobase|klammeraffe"
DOT = "dot|punkt|punto|point"
STRONG, WEAK = 2, 1


def _folds() -> dict[str, str]:
    """Lookalikes, and by rule of Unicode: compatibility forms of one ASCII character, other digits, spaces, dashes, invisible characters."""
    out = {c: k for k, v in LOOKALIKES.items() for c in v}
    for i in range(0x80, 0x20000):
        c = chr(i)
        kind = unicodedata.category(c)
        if c in out or kind in ("Cn", "Cs", "Co", "Lo"):
            continue
        if kind == "Cf" or 0xFE00 <= i <= 0xFE0F:
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        elif kind == "Pd":
            out[c] = "-"
        elif kind == "Nd":
            out[c] = str(unicodedata.decimal(c))
        else:
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and " " <= form <= "~":
                out[c] = form
    return out


FOLDS = _folds()
FOLD = re.compile("[" + "".join(map(re.escape, FOLDS)) + "]")
NUMBER = {w: str(d) for words in SPELLED.values() for d, w in enumerate(words.split())}
_WORD = "|".join(sorted(NUMBER, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple)[ -])?(?:{_WORD})"
#: Digit words, one after another; `oh` and `o` only between others.
SPOKEN = re.compile(rf"(?<![^\W_])(?:{_UNIT})(?:[ ,-]{{1,3}}(?:{_UNIT}|oh|o)(?![^\W_]))*(?![^\W_])", re.IGNORECASE)
TOKEN = re.compile(rf"(double|triple)?[ -]?\b({_WORD}|oh|o)\b", re.IGNORECASE)
MIXED = re.compile(r"(?<![A-Za-z])[OoIl]{0,19}[0-9][0-9OoIl]*(?![A-Za-z])")
GAP = re.compile(r"(?<=[0-9])[ ,-]{1,3}(?=[0-9])")
PLUS = re.compile(r"(?<![^\W_])plus[ ]?(?=\(?[0-9])", re.IGNORECASE)
BRACKETED = re.compile(rf"[ ]{{0,2}}(?:[\[({{<][ ]?(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))[ ]?[\])}}>]|_(?:(?P<at2>{AT})|(?P<dot2>{DOT}))_|-(?:(?P<at3>at)|(?P<dot3>dot))-)[ ]{{0,2}}", re.IGNORECASE)
BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9_-])[ ]{{1,2}}(?:{DOT})[ ]{{1,2}}(?=[A-Za-z0-9])", re.IGNORECASE)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])[ ]{0,2}@[ ]{0,2}(?=[A-Za-z0-9])")
BARE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])[ ]{{1,2}}(?:{AT})[ ]{{1,2}}(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])", re.IGNORECASE)
NAMED = re.compile(r"[0-9._]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    before = 0
    while at >= 0:
        begin = max(done, before)
        start = begin + len(text[begin:at].rstrip(LOCAL)) if at > begin else at
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        before = at + 1
        at = text.find("@", before)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in DOTTED.finditer(text):
        parts = [m.span() for m in PART.finditer(text, chain.start(), chain.end())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


FINDERS = (emails, addresses, cards, phones)


class Aligned:
    """A text and, for each of its characters, the source span that it stands for and how strongly it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1
        self.marks = np.zeros(len(text), np.int8)

    def rewrite(self, edits: list[tuple[int, int, str, int]]) -> None:
        """Put `new` for text[i:j] of each edit (i, j, new, mark), in order and without overlap."""
        if not edits:
            return
        texts, starts, ends, marks, at = [], [], [], [], 0
        for i, j, new, mark in edits:
            texts += [self.text[at:i], new]
            starts += [self.starts[at:i], np.full(len(new), self.starts[i])]
            ends += [self.ends[at:i], np.full(len(new), self.ends[j - 1])]
            marks += [self.marks[at:i], np.full(len(new), max(mark, self.marks[i:j].max()), np.int8)]
            at = j
        self.text = "".join([*texts, self.text[at:]])
        self.starts = np.concatenate([*starts, self.starts[at:]])
        self.ends = np.concatenate([*ends, self.ends[at:]])
        self.marks = np.concatenate([*marks, self.marks[at:]])


def fold_homoglyphs(x: Aligned) -> None:
    if not x.text.isascii():
        x.rewrite([(m.start(), m.end(), FOLDS[m[0]], STRONG) for m in FOLD.finditer(x.text)])


def fold_digits(x: Aligned) -> None:
    edits = []
    for m in SPOKEN.finditer(x.text):
        for t in TOKEN.finditer(x.text, m.start(), m.end()):
            times = {"double": 2, "triple": 3}.get((t[1] or "").lower(), 1)
            edits.append((t.start(), t.end(), NUMBER.get(t[2].lower(), "0") * times, WEAK))
    x.rewrite(edits)
    x.rewrite([(m.start(), m.end(), "", WEAK) for m in _between(x)])
    x.rewrite([(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1", STRONG) for m in MIXED.finditer(x.text) for k, c in enumerate(m[0]) if c in "OoIl"])
    x.rewrite([(m.start(), m.end(), "+", WEAK) for m in PLUS.finditer(x.text)])


def _between(x: Aligned) -> Iterator[re.Match]:
    """Gaps between two digits that were both words."""
    for m in GAP.finditer(x.text):
        if x.marks[m.start() - 1] == WEAK and x.marks[m.end()] == WEAK:
            yield m


def fold_signs(x: Aligned) -> None:
    kind = lambda m: "@" if m["at"] or m["at2"] or m["at3"] else "."
    x.rewrite([(m.start(), m.end(), kind(m), STRONG) for m in BRACKETED.finditer(x.text)])
    x.rewrite([(m.start(), m.end(), ".", WEAK) for m in BARE_DOT.finditer(x.text)])
    x.rewrite([(m.start(), m.end(), "@", WEAK) for m in BARE_AT.finditer(x.text) if _addressed(x, m)])
    x.rewrite([(m.start(), m.end(), "@", STRONG) for m in SPACED_AT.finditer(x.text) if m.end() - m.start() > 1 and DOMAIN.match(x.text, m.end())])


def _addressed(x: Aligned, at: re.Match) -> bool:
    """Whether what stands beside a bare at makes it an address."""
    domain = DOMAIN.match(x.text, at.end())
    if x.marks[domain.start() : domain.end()].any():
        return True
    line = x.text[max(0, at.start() - 64) : at.start()]
    return NAMED.search(line[len(line.rstrip(LOCAL)) :]) is not None


#: What a text must hold for a transducer to make an identifier of it (RE2, ASCII case): two digit words, or one beside a
#: digit or dot; plus before either; at and dot as signs; letters among digits.
CUES = "|".join([
    rf"\b(?:{_WORD})[ ,-]{{1,3}}(?:{_WORD}|oh|o|double|triple)\b",
    rf"[0-9][ ().-]{{0,3}}(?:{_WORD})\b",
    rf"\b(?:{_WORD})[ ().-]{{0,3}}[0-9]",
    rf"\bplus [ (]?(?:[0-9]|(?:{_WORD})\b)",
    rf"[ _-](?:{DOT}|arroba|arobase|klammeraffe)[ _-]",
    rf"[\[({{<] ?(?:{AT}|{DOT}|@|\.) ?[\])}}>]",
    r"[_-]at[_-]",
    r"[A-Za-z0-9._%+-] {1,2}at {1,2}[A-Za-z0-9-]+\.[A-Za-z0-9]",
    r" @|@ ",
    r"[0-9][oil]|[oil][0-9]",
])
FOLDED = "[" + "".join("\\x{%x}" % ord(c) for c in FOLDS) + "]"


def cues(texts: pa.Array) -> list[bool]:
    return pc.or_(pc.match_substring_regex(texts, CUES, ignore_case=True), pc.match_substring_regex(texts, FOLDED)).to_pylist()


def plain_cues(texts: pa.Array) -> list[list[bool]]:
    """Whether a text can hold each kind in plain form: a wider and faster test than the finder's."""
    tests = (pc.match_substring(texts, "@"), pc.match_substring_regex(texts, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), pc.match_substring_regex(texts, "[0-9](?:[ -]?[0-9]){13}"), pc.match_substring(texts, "+"))
    return [t.to_pylist() for t in tests]


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, normalised form) of spans that the transducers add to `base` (start, kind, end)."""
    x = Aligned(text)
    fold_homoglyphs(x)
    fold_digits(x)
    fold_signs(x)
    if not x.marks.any() and len(x.text) == len(text):
        return []
    out = []
    for kind, finder in enumerate(FINDERS):
        own = [(a, b) for a, k, b in base if k == kind]
        for i, j in finder(x.text):
            start, end = int(x.starts[i]), int(x.ends[j - 1])
            mark = x.marks[i:j].max()
            dropped = end - start > j - i  # characters that went leave no mark of their own
            if not (mark or dropped) or any(a <= start and end <= b for a, b in own):
                continue
            if mark != STRONG and not (dropped and not mark) and any(a < end and start < b for a, b in own):
                continue
            out.append((start, kind, end, x.text[i:j]))
    return out


def find_spans(texts: pa.Array) -> Iterator[list[tuple[str, int, int, bool, str]]]:
    """(kind, start, end, base, normalised form) of each text, by start, kind and end."""
    for text, cue, *may in zip(texts.to_pylist(), cues(texts), *plain_cues(texts)):
        base = [(a, k, b) for k, finder in enumerate(FINDERS) if may[k] for a, b in finder(text)]
        rows = [(a, k, b, True, text[a:b]) for a, k, b in base]
        if cue:
            rows += [(a, k, b, False, form) for a, k, b, form in disguised(text, base)]
        yield [(KINDS[k], a, b, plain, form) for a, k, b, plain, form in sorted(rows, key=lambda r: r[:3])]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("form", pa.string())])
NAMES = ("kind", "start", "end", "base", "form")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [[dict(zip(NAMES, s)) for s in spans] for spans in find_spans(pc.fill_null(batch.column("text"), ""))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): of every document, the spans of code points with their kind, whether plain, and normalised form."""
    spans = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, form: string>>"
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.DataType.fromDDL(spans))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_find, schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of plain spans of each kind, the digest of plain spans, all spans, and the number added."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))
