"""Personal data: detection in the text as it stands and, with offsets kept, in the text behind its disguises.

A text passes transducers that each rewrite what they recognise and carry, for every character they emit, where it came
from: character references become characters, look-alike letters and digits ASCII ones and unseen characters go, spelled digits (in four
languages) become digits, "(at)", "_dot_" or their references become @ and dot, dots of numeric addresses lose brackets and spaces, and
letters among digits become the digits they look like. Each reads a text once, from tokens of bounded length.
The same detectors then run over the rewritten text, and what they find in rewritten places is mapped back to the source.
Spans found in the text as it stands are never changed by this.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm.arrow_text import sliced
from tidemart.llm.tables import table

#: In the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone")

# Detectors -----------------------------------------------------------------------------------------------------------
# Digits only ever match inside clusters, so texts are scanned for those and the patterns for the rest stay short.
_cluster = re.compile(r"[0-9+][0-9 .()-]*")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digits = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local_chars:
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        else:
            end = max(end, at)  # no local part reaches over an @
        at = text.find("@", max(at + 1, end))
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind), sorted: leftmost matches that don't overlap others of their kind."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    for c in _cluster.finditer(text):
        s, e = c.span()
        if e - s < 7:  # no match is shorter
            continue
        if text[s] == "+":
            m = _phone.match(text, s, e)
            if m and 10 <= len(_digits.findall(m[0])) <= 15:
                found.append((*m.span(), 3))
        for m in _card.finditer(text, s, e):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if text.count(".", s, e) >= 3:
            for m in _ip.finditer(text, s, e):
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                    found.append((*m.span(), 1))
    found.sort()
    return found


# Transducers ---------------------------------------------------------------------------------------------------------
# Characters that look like the ASCII character they are listed under (Cyrillic, Greek and Latin letters; signs).
LOOK_ALIKES = {
    "a": "аα", "b": "ƅ", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оο", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "w": "ԝ", "x": "хχ", "y": "у", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "․。｡", "-": "‐‑‒–—−", "@": "﹫", "+": "﹢", " ": "   ",
}
# Spelled digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "strich": "-", "tiret": "-", "guion": "-"}
TIMES_WORDS = {"double": 2, "triple": 3, "doppelt": 2, "doble": 2}
# Words for @ and ., their character references, and ends of domains after which a spelled dot with no brackets counts.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "punto", "point")
AT_ENTITIES, DOT_ENTITIES = ("&#64;", "&#x40;", "&commat;"), ("&#46;", "&#x2e;", "&period;")
DOMAIN_ENDS = frozenset("com org net edu gov info biz io co uk us eu de at ch fr be es it nl pl pt se dk fi no cz ru jp cn in br mx ar au ca example test".split())
#: Characters that aren't seen: zero-width ones and soft hyphens.
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_look = {ord(x): a for a, xs in LOOK_ALIKES.items() for x in xs}
_look |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}  # full-width forms
_look |= {base + d: str(d) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}  # other digits
_look |= {ord(x): "" for x in UNSEEN}
_any_look = re.compile("[" + re.escape("".join(map(chr, _look))) + "]")
_one_of = lambda words: "|".join(sorted(words, key=len, reverse=True))
_number = _one_of(DIGIT_WORDS)
_sign = _one_of(w for w, sign in SIGN_WORDS.items() if sign != "+")
_plus = _one_of(w for w, sign in SIGN_WORDS.items() if sign == "+")
_unit = rf"(?:(?:{_one_of(TIMES_WORDS)})[ -])?(?:{_number}|[0-9]{{1,19}})"
_spelled = re.compile(rf"\b(?:(?:{_plus})[ ,-]{{1,2}})?{_unit}(?:(?:[ ,-]{{1,2}}|[ ]?\b(?:{_sign})\b[ ]?){_unit}){{3,}}\b", re.I)
_spelled_part = re.compile(rf"\b(?:{_plus}|{_one_of(TIMES_WORDS)}|{_sign}|{_number})\b|[0-9]", re.I)
_any_word = re.compile(rf"\b(?:{_number})[ ,-]{{1,2}}(?:{_number}|{_sign}|{_one_of(TIMES_WORDS)}|[0-9])\b", re.I)
# Disguises are read from tokens of bounded length, so a text is read once whatever it holds.
_gap = r"[ \t\r\n]{0,4}"
_bracketed = lambda words: rf"{_gap}[\[({{<][ ]{{0,2}}(?:{words})[ ]{{0,2}}[\])}}>]{_gap}"
_apart = lambda words: rf"[ \t]{{1,4}}(?:{words})[ \t]{{1,4}}"
_tokens = re.compile(
    "(?P<label>[A-Za-z0-9%+_-]+)"
    f"|(?P<at>{_bracketed(_one_of(AT_WORDS) + '|@')}|{_one_of(AT_ENTITIES)}|{_apart('@')}|@)|(?P<at_word>{_apart(_one_of(AT_WORDS))})"
    rf"|(?P<dot>{_bracketed(_one_of(DOT_WORDS) + '|[.]')}|{_one_of(DOT_ENTITIES)}|[.])|(?P<dot_word>{_apart(_one_of(DOT_WORDS) + '|[.]')})"
    "|(?P<other>.)",
    re.I | re.S,
)
_any_disguise = re.compile(rf"[\[({{<][ ]{{0,2}}(?:{_one_of(AT_WORDS + DOT_WORDS)}|[@.])[ ]{{0,2}}[\])}}>]|[ \t](?:{_one_of(DOT_WORDS)})[ \t]|[ \t]@[ \t]|{_one_of(AT_ENTITIES + DOT_ENTITIES)}", re.I)


# Character references of printable ASCII characters.
_reference = re.compile(r"&#(?:0{0,4}([0-9]{2,3})|[xX]0{0,4}([0-9a-fA-F]{2}));")
# An address with its signs between dashes, underlines, stars and the like, or with its @ as a URL writes it.
_mark = r"[ ]?[-_*|~][ ]?"
_label = r"[A-Za-z0-9]{1,63}"
_marked = re.compile(
    rf"(?<![A-Za-z0-9])(?:{_label}[.%+])?{_label}(?P<at>{_mark}(?:{_one_of(AT_WORDS)}){_mark}|%40)"
    rf"(?P<domain>{_label}(?:(?:{_mark}(?:{_one_of(DOT_WORDS)}){_mark}|[.-]){_label}){{0,5}}(?:{_mark}(?:{_one_of(DOT_WORDS)}){_mark}|[.])(?P<end>[A-Za-z]{{2,63}}))(?![A-Za-z0-9])",
    re.I,
)
_marked_dot = re.compile(rf"{_mark}(?:{_one_of(DOT_WORDS)}){_mark}", re.I)
_any_mark = re.compile(rf"%40|[-_*|~][ ]?(?:{_one_of(AT_WORDS)})[ ]?[-_*|~]", re.I)
# Four numbers with dots between that are spelled, in brackets, or have spaces around; or with spaces between a number's digits.
_dotted = rf"(?:{_bracketed(_one_of(DOT_WORDS) + '|[.]')}|{_one_of(DOT_ENTITIES)}|{_apart(_one_of(DOT_WORDS) + '|[.]')}|[.])"
_spaced = r"[0-9](?:[ ]?[0-9]){0,2}"
_address = re.compile(rf"(?<![0-9.])(?<![0-9][ ]){_spaced}(?:{_dotted}{_spaced}){{3}}(?![ ]?[0-9])(?!{_dotted}[0-9])", re.I)
_address_part = re.compile(rf"(?P<dot>{_dotted})|[ ]", re.I)
_any_address = re.compile(rf"[0-9](?:[ \t]{{0,4}}[\[({{<]|[ \t]{{1,4}}(?:[.]|{_one_of(DOT_WORDS)})|{_one_of(DOT_ENTITIES)})", re.I)
# Letters that are written for digits.
DIGIT_LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
_mixed = re.compile(r"(?<![A-Za-z0-9])(?:\+[0-9OolI][ ().0-9OolI-]{8,24}[0-9OolI]|[0-9OolI](?:[ -]?[0-9OolI]){13,18})(?![A-Za-z0-9])")
_any_mixed = re.compile(r"[0-9][ -]?[OolI][ -]?[0-9OolI]|(?<![A-Za-z])[OolI][0-9]{2}")


class Traced:
    """A text and, for each of its characters, the source's characters [first, last) that it stands for; whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text, n = text, len(text)
        self.first, self.last, self.new = np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement), in order and apart. A replacement of several characters stands for all of [start, end); where one
        is empty, the character after it counts as rewritten."""
        if not edits:
            return
        text, first, last, new, at, before = [], [], [], [], 0, "-"
        for s, e, by in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:s], by]
            first += [self.first[at:s], np.full(len(by), self.first[s] if by else 0)]
            last += [self.last[at:s], np.full(len(by), self.last[e - 1] if by else 0)]
            kept = self.new[at:s].copy()
            if not before and len(kept):
                kept[0] = True
            new += [kept, np.ones(len(by), bool)]
            at, before = e, by
        self.text, self.first, self.last, self.new = "".join(text), np.concatenate(first), np.concatenate(last), np.concatenate(new)


def look_alikes(t: Traced) -> None:
    t.rewrite([(m.start(), m.end(), _look[ord(m[0])]) for m in _any_look.finditer(t.text)])


def spelled_digits(t: Traced) -> None:
    edits = []
    for run in _spelled.finditer(t.text):
        if not _any_word.search(run[0]):
            continue
        times, begin = 1, None
        for m in _spelled_part.finditer(t.text, *run.span()):
            word = m[0].lower()
            if word in TIMES_WORDS:
                times, begin = TIMES_WORDS[word], m.start()
                continue
            by = SIGN_WORDS.get(word) or DIGIT_WORDS.get(word, word) * times
            at = m.start() if begin is None else begin
            if edits and run.start() < edits[-1][1] <= at:  # what parts two digits goes with the second
                at = edits[-1][1]
            edits.append((at, m.end(), by))
            times, begin = 1, None
    t.rewrite(edits)


def at_and_dot(t: Traced) -> None:
    """An address is a label, perhaps more with dots between, an at sign, and two labels or more with dots between. Spelled signs without
    brackets count only if the domain ends like one, and a bare "at" only before a spelled dot."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _tokens.finditer(t.text)]
    kind = lambda i: tokens[i][0] if 0 <= i < len(tokens) else "other"
    dots, edits, end = ("dot", "dot_word"), [], 0
    for i, (k, s, e) in enumerate(tokens):
        if k not in ("at", "at_word") or kind(i - 1) != "label" or kind(i + 1) != "label":
            continue
        left, right = i - 1, i + 1
        while left - 2 >= end and kind(left - 1) == "dot" and kind(left - 2) == "label":  # an at sign ends this, so no token is passed twice
            left -= 2
        while kind(right + 1) in dots and kind(right + 2) == "label":
            right += 2
        bare = k == "at_word"
        loose = bare or (e - s > 1 and t.text[s:e].strip(" \t") == "@")  # spelled, or with spaces around
        # A spelled dot after which no known end comes is the text's own: the domain stops before it.
        while right > i + 1 and tokens[right - 1][0] == "dot_word" and t.text[tokens[right][1] : tokens[right][2]].lower() not in DOMAIN_ENDS:
            right -= 2
        inner = tokens[i + 2 : right : 2]
        last = t.text[tokens[right][1] : tokens[right][2]].lower()
        if not inner or (bare and not any(d[0] == "dot_word" or d[2] - d[1] > 1 for d in inner)) or (loose and last not in DOMAIN_ENDS):
            continue
        signs = [(a, b, ".") for _, a, b in tokens[left + 1 : i : 2]] + [(s, e, "@")] + [(a, b, ".") for _, a, b in inner]
        edits += [(a, b, by) for a, b, by in signs if t.text[a:b] != by]
        end = right + 1
    t.rewrite(edits)


def references(t: Traced) -> None:
    edits = []
    for m in _reference.finditer(t.text):
        code = int(m[1]) if m[1] else int(m[2], 16)
        if 0x20 <= code < 0x7F:
            edits.append((m.start(), m.end(), chr(code)))
    t.rewrite(edits)


def marked_signs(t: Traced) -> None:
    """Only before a domain that ends like one, so that words which happen to stand between dashes are left alone."""
    edits = []
    for m in _marked.finditer(t.text):
        if m["end"].lower() in DOMAIN_ENDS:
            edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in _marked_dot.finditer(t.text, *m.span("domain"))]
    t.rewrite(edits)


def address_dots(t: Traced) -> None:
    edits = []
    for m in _address.finditer(t.text):
        for x in _address_part.finditer(t.text, *m.span()):
            by = "." if x["dot"] else ""
            if x[0] != by:
                edits.append((*x.span(), by))
    t.rewrite(edits)


def digit_letters(t: Traced) -> None:
    """Letters in what could be a number of ten digits and more of which most are digits already."""
    edits = []
    for m in _mixed.finditer(t.text):
        letters = [i for i in range(*m.span()) if t.text[i] in DIGIT_LETTERS]
        if letters and 2 * len(letters) < len(_digits.findall(m[0])):
            edits += [(i, i + 1, DIGIT_LETTERS[t.text[i]]) for i in letters]
    t.rewrite(edits)


#: In this order, each with a pattern that is in every text it can change.
_steps = [
    (re.compile("&#"), references), (_any_look, look_alikes), (_any_word, spelled_digits), (_any_disguise, at_and_dot), (_any_mark, marked_signs),
    (_any_address, address_dots), (_any_mixed, digit_letters),
]


def hidden(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the source that only the rewritten text shows: none lies within a known one of its kind (it may reach beyond one). known is sorted."""
    steps = [f for pattern, f in _steps if pattern.search(text)]
    if not steps:
        return []
    if steps[0] in (references, look_alikes):  # they may bring the others' words to light
        steps = [f for _, f in _steps]
    t = Traced(text)
    for step in steps:
        step(t)
    changed = np.concatenate([[0], np.cumsum(t.new)])
    if not changed[-1]:
        return []
    # Spans of one kind don't overlap and come in order, so the last that begins at or before a place is the only one that can hold it.
    starts = [[s for s, _, k in known if k == kind] for kind in range(len(KINDS))]
    ends = [[e for _, e, k in known if k == kind] for kind in range(len(KINDS))]
    found, reach = [], [-1] * len(KINDS)
    for s, e, kind in detect(t.text):
        if changed[e] > changed[s]:
            a, b = int(t.first[s]), int(t.last[e - 1])
            at = bisect.bisect_right(starts[kind], a) - 1
            if b > reach[kind] and not (at >= 0 and ends[kind][at] >= b):
                found.append((a, b, kind))
                reach[kind] = b
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, base (array of struct<start, end, kind>, kind an index of KINDS) and added, the spans that
    only the rewritten text shows. Offsets count code points, end exclusive. Null and empty texts have none; repeated rows
    stay; other columns are ignored."""

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    as_rows = lambda found: [dict(zip(("start", "end", "kind"), x, strict=True)) for x in found]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            base, added = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                base.append(detect(text))
                added.append(hidden(text, base[-1]))
            cols = [b.column(0), pa.array(map(as_rows, base), kind), pa.array(map(as_rows, added), kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "added"])

    span = "array<struct<start: bigint, end: bigint, kind: int>>"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(find, f"doc_id long, base {span}, added {span}")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data in text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; overlapping spans by the
    first one's name. Same columns; texts without any, nulls among them, stay as they are."""
    at, schema = docs.columns.index("text"), docs.schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for text in b.column(at):
                text = text.as_py()
                if text:
                    base = detect(text)
                    out, end = [], 0
                    for s, e, k in sorted(base + hidden(text, base)):
                        if s >= end:
                            out += [text[end:s], f"<{KINDS[k].upper()}>"]
                        end = max(end, e)
                    text = "".join(out) + text[end:] if end else text
                texts.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(mask, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    text = lambda x: F.array_join(
        F.transform(x, lambda p: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ","
    )
    by_place = lambda x: F.array_sort(
        x, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(a["kind"] - b["kind"]).cast("int")
    )
    found = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(text(by_place(F.col("base"))), 256).alias("base_sha256"),
        text(by_place(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
