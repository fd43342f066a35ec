"""Personal data in plain and disguised spelling, with spans in the source text.

A *transducer* rewrites a stretch of text and keeps, for every character it emits, the source
range it came from: look-alike letters and digits become ASCII, runs of spelled digits become
digits, "at" and "dot" in brackets or between address parts become their signs. Detectors run on
the rewritten text and each hit is mapped back through those ranges, so spans always count code
points of the source. Every step is linear in the text: patterns begin where a run begins and never
give back what they took, and an address in words is read outwards from its "at", label by label.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from settlematch.llm.common import byte_blocks, record_batch

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The sign with the domain behind it; the part before it is one run of these letters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches: a match can only begin where a run of digits does (seen behind its first digit, which is faster to look for), and no run is given back.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII ones, and spelled digits.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXoavp", strict=True))
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(SPELLED)
SIGNS = {"at": "@", "dot": "."}

_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "²³¹٠-٩۰-۹०-९​-‍⁠․⁰-₉①-⑨﻿！-～\U0001d400-\U0001d7ff]")
_DIGITS = re.compile(rf"(?:\bplus\s++)?(?<![A-Za-z])(?:{_WORD})(?:[\s,.-]++(?:dot|dash|plus|{_WORD}|[0-9]++)\b){{3,}}+", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*+(at|dot)\s*+[\])}>]", re.I)
# Endings of more than two letters that tell an address in bare words from prose. Any two letters count as a country's.
ENDINGS = frozenset("com org net edu gov mil int info biz app dev name pro mobi shop online site store tech cloud xyz page blog news wiki museum example test".split())
# Words of two letters that are no country's ending, and words that stand before "dot" in prose.
NO_ENDING = frozenset("an go he hi if oh ok on of or ox up we".split())
NO_HOST = frozenset("the a an this that these those each every any no one some it its his her their our your my which what another".split())
_TOKEN = re.compile(r"[A-Za-z0-9._%+@-]++|[^\sA-Za-z0-9._%+@-]++")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_LOCAL_LABEL = re.compile(r"[A-Za-z0-9._%+-]+")
_SPOKEN_IP = re.compile(r"(?<![0-9])[0-9]++(?:(?:\s++dot\s++|\.)[0-9]++){3}", re.I)
_SPOKEN_DOT = re.compile(r"\s++dot\s++", re.I)
_HINT = re.compile(r"[\[({<]\s*+(?:at|dot)\s*+[\])}>]|(?<=[A-Za-z0-9])\s++dot\s++(?=[A-Za-z0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping. A match starts at the run of local letters before an @ sign."""
    found, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _is_byte(digits: str) -> bool:
    """Whether a number is at most 255, whatever zeros it begins with."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) < 256


def find_ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_is_byte, m.group().split(".")))] if text.count(".") > 2 else []


def find_cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() > 11 and 12 <= len(d := _only_digits(m.group())) <= 19 and luhn(d)]


def find_phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15] if "+" in text else []


FINDERS = {"email": find_emails, "ip": find_ips, "card": find_cards, "phone": find_phones}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of identifiers in plain spelling, in order of start, then of kind."""
    spans = [(s, KINDS.index(k), e) for k, find in FINDERS.items() for s, e in find(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(spans)]


def plain_letter(c: str) -> str | None:
    """The ASCII that a look-alike stands for ('' for invisible marks), or None if it is no disguise."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in "​‌‍⁠﻿":
        return ""
    if c == "․":
        return "."
    if ord(c) > 127 and _FOREIGN.match(c):
        folded = unicodedata.normalize("NFKC", c)
        return folded if len(folded) == 1 and folded.isascii() else str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else None
    return None


class Rewritten:
    """Text and what was replaced in it, so that every stretch of it can be found in the source."""

    def __init__(self, text: str):
        self.text = text
        #: Per round of edits: where each replacement begins and ends now, and where what it replaced did.
        self.rounds: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def edited(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges (in order, apart) of the current text; a replacement stands for the whole range."""
        if not edits:
            return
        out, at, now, marks = [], 0, 0, ([], [], [], [])
        for s, e, new in edits:
            now += s - at
            for values, x in zip(marks, (now, now + len(new), s, e), strict=True):
                values.append(x)
            out += [self.text[at:s], new]
            now, at = now + len(new), e
        self.text = "".join([*out, self.text[at:]])
        self.rounds.append(marks)

    def source(self, span: tuple[int, int]) -> tuple[int, int]:
        """The source range of a range that is not empty."""
        first, last = span[0], span[1] - 1
        for starts, ends, olds, old_ends in reversed(self.rounds):
            a, b = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
            while a >= 0 and starts[a] == ends[a]:  # removed before it
                a -= 1
            while b >= 0 and starts[b] == ends[b]:
                b -= 1
            i, j = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
            first = olds[a] if a >= 0 and first < ends[a] else first - ends[i] + old_ends[i] if i >= 0 else first
            last = old_ends[b] - 1 if b >= 0 and last < ends[b] else last - ends[j] + old_ends[j] if j >= 0 else last
        return first, last + 1


def _unspelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that write a run of spelled digits as digits without the gaps."""
    at, edits, signs = m.start(), [], SPELLED | {"dot": ".", "dash": "-", "plus": "+"}
    for w in re.finditer(r"[A-Za-z]+|[0-9]+", m.group()):
        s, e = m.start() + w.start(), m.start() + w.end()
        edits.append((at, e, signs.get(w.group().lower(), w.group())))
        at = e
    return edits


def _unbracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits for "at" and "dot" in brackets, with the white space around them."""
    edits, done = [], 0
    for m in _BRACKETED.finditer(text):
        s, e = m.span()
        while s > done and text[s - 1].isspace():
            s -= 1
        while e < len(text) and text[e].isspace():
            e += 1
        edits.append((s, e, SIGNS[m[1].lower()]))
        done = e
    return edits


def _is_ending(label: str) -> bool:
    low = label.lower()
    return low in ENDINGS or len(low) == 2 and low.isalpha() and low.isascii() and low not in NO_ENDING


def _shaped(local: list[str], domain: list[str]) -> bool:
    """What prose lacks: a sign, a spoken dot or digits among letters; in a domain a hyphen, digits or a third part."""
    mixed = any(re.search("[A-Za-z]", x) and re.search("[0-9]", x) for x in (*local, *domain))
    return mixed or len(local) > 1 or any(re.search(r"[A-Za-z0-9][._%+-]+[A-Za-z0-9]", x) for x in local) or any(re.search("[A-Za-z0-9]-[A-Za-z0-9]", x) for x in domain) or len(".".join(domain).split(".")) > 2


def _spoken_addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits for addresses in bare words: the whole chain of labels on both sides of an "at" is read, then judged.

    A chain is labels with "dot" between them; the domain's must hold a spoken dot, unless "at"
    is spoken and its ending is a known one. Where "at" is written as a sign, only dots are spoken.
    """
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    n, done, edits = len(tokens), 0, []

    def is_dot(i: int) -> bool:
        return 0 < i < n - 1 and tokens[i][2].lower() == "dot" and tokens[i - 1][1] < tokens[i][0] and tokens[i][1] < tokens[i + 1][0]

    def label(i: int, pattern: re.Pattern) -> str | None:
        """The token as a label; a last one may carry the stop of its sentence."""
        m = pattern.fullmatch(tokens[i][2].rstrip(".")) if i < n else None
        return m[0] if m else None

    def domain_from(i: int, first: str | None) -> tuple[list[str], int, list[int]]:
        """Labels from token ``i`` on, where the last ends, and the places of the dots between."""
        found, dots = [first or ""], []
        end = tokens[i][0] + len(tokens[i][2].rstrip("."))
        while tokens[i][2][-1] != "." and is_dot(i + 1) and (x := label(i + 2, _LABEL)):
            found.append(x)
            dots.append(i + 1)
            i += 2
            end = tokens[i][0] + len(tokens[i][2].rstrip("."))
        return found, end, dots

    for i, (s, e, word) in enumerate(tokens):
        if i < done:
            continue
        spoken = word.lower() == "at" and 0 < i < n - 1 and tokens[i - 1][1] < s and e < tokens[i + 1][0]
        if spoken:
            first, local, k = label(i + 1, _LABEL), [], i - 1
            if not first or first.lower() in NO_HOST:
                continue
            while k >= done and (m := _LOCAL_LABEL.fullmatch(tokens[k][2])):
                local.insert(0, m[0])
                if k - 2 < done or not is_dot(k - 1):
                    break
                k -= 2
            if not local:
                continue
            domain, end, dots = domain_from(i + 1, first)
            place = i + 1 + 2 * len(dots)
        elif "@" in word and 0 < word.index("@") == word.rindex("@") and (first := _LABEL.fullmatch(word[word.index("@") + 1 :])) and "." not in first[0] and is_dot(i + 1):
            local, k = [word[: word.index("@")]], i
            domain, end, dots = domain_from(i, first[0])
            place = i + 2 * len(dots)
        else:
            continue
        last = ".".join(domain).rsplit(".", 1)
        if len(last) < 2 or not (last[1].isalpha() and last[1].isascii() and len(last[1]) > 1):
            continue
        known = _is_ending(last[1])
        if not (known if not spoken else known and (dots or last[1].lower() in ENDINGS or len(last[1]) == 2 and _shaped(local, domain)) or dots and _shaped(local, domain)):
            continue
        # "plus", "dot" and "at" between labels become their signs
        for j in range(k, i):
            if tokens[j][2].lower() == "dot" and (j - k) % 2:
                edits.append((tokens[j - 1][1], tokens[j + 1][0], "."))
        if spoken:
            edits.append((tokens[i - 1][1], tokens[i + 1][0], "@"))
        edits += [(tokens[j - 1][1], tokens[j + 1][0], ".") for j in dots]
        done = place + 1
    return edits


def rewrite(text: str) -> Rewritten:
    """The three transducers one after another."""
    out = Rewritten(text)
    if not text.isascii():
        out.edited([(m.start(), m.end(), new) for m in _FOREIGN.finditer(text) if (new := plain_letter(m[0])) is not None])
    out.edited([x for m in _DIGITS.finditer(out.text) for x in _unspelled(m)])
    if _HINT.search(out.text):
        out.edited(_unbracketed(out.text))
        out.edited(_spoken_addresses(out.text))
        out.edited([(m.start() + w.start(), m.start() + w.end(), ".") for m in _SPOKEN_IP.finditer(out.text) for w in _SPOKEN_DOT.finditer(m[0])])
    return out


def disguised_spans(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans that only the rewritten text shows, also around the plain rest of one; none inside another of its kind."""
    new = rewrite(text)
    if not new.rounds:
        return []
    found = []
    for kind, find in FINDERS.items():
        plain = [(s, e) for s, k, e in taken if k == kind]  # apart, in order
        starts = [s for s, _ in plain]
        until = 0
        for hit in find(new.text):
            a, b = new.source(hit)
            k = bisect_right(starts, a) - 1
            if b > until and text[a:b] != new.text[hit[0] : hit[1]] and not (k >= 0 and b <= plain[k][1]):
                found.append((a, kind, b))
                until = b
    return found


def all_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Plain spans, and plain and disguised ones together, in order of start, then of kind."""
    base = base_spans(text)
    return base, sorted([*base, *disguised_spans(text, base)], key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_pii(documents: DataFrame) -> DataFrame:
    """Per document: spans of each kind (plain and disguised), and a digest of the plain ones.

    Null and empty texts have no spans. Rows are handled one by one, so repeats stay repeats.
    """

    def run(batches):
        for batch in byte_blocks(batches):
            out = {name: [] for name in _SPANS.names}
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            yield record_batch(_SPANS, out | {"doc_id": batch.column("doc_id")})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with the spans of :func:`find_pii` replaced in ``text``; other columns pass through.

    A null text stays null. ``n_chars``, where there is one, counts the new text.
    """

    def run(batches):
        for batch in byte_blocks(batches):
            texts = [t and redacted(t, all_spans(t)[1]) for t in batch.column("text").to_pylist()]
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, columns["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return documents.mapInArrow(run, documents.schema)


__all__ = ["KINDS", "all_spans", "base_spans", "disguised_spans", "find_pii", "joined", "redact", "redacted", "rewrite"]
