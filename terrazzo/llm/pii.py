"""Personal data: fixed patterns, and a semi-Markov CRF that finds what they miss.

The patterns (``email``, ``ip``, ``card``, ``phone``) are always reported.  The
semi-Markov field scores whole candidate spans (digits in all, grouping,
separators, check digits, words before) and a dynamic program over a window picks
boundaries and types together; entities hold at most MAX_TOKENS tokens, each of any
length.  It adds spelled addresses such as ``ann (at) mail dot com`` and phone numbers
without ``+``.

A candidate must hold an anchor: a digit, or an ``at`` in brackets or followed by
``dot``, and stays on its line.  A window takes MAX_TOKENS whole tokens on both sides of
each anchor, so every candidate of the text lies in one, and the windows give the
best segmentation of the whole text.  A number whose score cannot be above that of
outside, whatever its span holds, is not read (``Bound``): it could be in no best
segmentation.

The weights in ``models/pii.json`` come from ``train`` on invented sentences.

Defined results: null is the empty text; empty tables give no rows; positions are
code points, ends exclusive; repeated rows, and rows with a null doc_id, are read one by
one; a text of any length is read whole; the field's spans do not overlap each other, and
of one that a pattern's span covers in part the rest stays where it holds REST letters and
digits; patterns of different kinds may overlap;
spans are listed by start, then kind, and of equally good segmentations the one with fewer
spans counts; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm import semicrf
from terrazzo.llm.secretscan import uncovered
from terrazzo.llm.workers import tidy

MODEL = Path(__file__).parent / "models" / "pii.json"
TYPES = ("email", "ip", "card", "phone")
#: The field's spans are named apart from the patterns' spans of the same type.
KINDS = (*TYPES, *(f"crf_{t}" for t in TYPES))
MAX_TOKENS = 24
#: Letters and digits that what a pattern leaves of a span must hold.
REST = 6

# The base patterns.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")  # from the first digit of a run: a later one cannot match if it fails
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them: from each at sign to the left as far as its class and the last match allow."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-10:]) <= 255 and (len(p) <= 10 or not p[:-10].strip("0")) for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(c for c in m[0] if c in "0123456789") if len(m[0]) < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9]+|[(\[{<]\s?(?:at|AT|At)\s?[)\]}>]|\b(?:at|AT)\s+[\w-]+\s+(?:dot|DOT)\b")
_SPELLED = re.compile(
    r"[A-Za-z][\w.%+-]*(?:"
    r"\s?[(\[{<]\s?at\s?[)\]}>]\s?[\w-]+(?:(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s|\.)[\w-]+)*(?:\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s|\.)[a-z]{2,6}"
    r"|\sat\s[\w-]+(?:\sdot\s[\w-]+)*\sdot\s[a-z]{2,6})",
    re.I,
)
#: What shows behind a spelled address that it is not at its end.
_GOES_ON = re.compile(r"\w|\s?[(\[{<]\s?dot\s?[)\]}>]\s?\w|\sdot\s\w|\.\w", re.I)
_GROUPS = re.compile(r"\(?0?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}")
_WHERE = {
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|dial|telefon|t[eé]l[eé]phone|tel[eé]fono)\b[^\n]{0,12}$"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b[^\n]{0,16}$"),
    "mail": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b[^\n]{0,16}$"),
}
FEATURES = (
    "bias", "spelled", "digits_lt7", "digits_7_8", "digits_9_15", "digits_12_19", "digits_gt19", "parens", "groups", "one_group", "luhn", "separators_mixed",
    "dots_only", "dashes", "spaces", "letters", "slash_colon_comma", "phone_near", "card_near", "mail_near", "digit_beside", "letter_beside", "decimal_beside", "short_groups",
    "date_like", "trunk_zero", "phone_near_7_15", "card_near_12_19", "groups_9_15", "spelled_digits",
    "goes_on", "joined_before",
)
_AT = {n: k for k, n in enumerate(FEATURES)}


def span_features(text: str, a: int, b: int) -> np.ndarray:
    s, x = text[a:b], np.zeros(len(FEATURES))
    digits = re.sub(r"[^0-9]", "", s)
    n, runs = len(digits), re.findall(r"[0-9]+", s)
    before, after = text[max(0, a - 32) : a], text[b : b + 2]
    near = {k: bool(p.search(before)) for k, p in _WHERE.items()}
    spelled = bool(_SPELLED.fullmatch(s))
    on = {
        "bias": True, "spelled": spelled, "digits_lt7": n < 7, "digits_7_8": 7 <= n <= 8, "digits_9_15": 9 <= n <= 15, "digits_12_19": 12 <= n <= 19, "digits_gt19": n > 19,
        "parens": re.match(r"\(\d+\)", s), "groups": _GROUPS.fullmatch(s), "one_group": len(runs) == 1, "luhn": n >= 12 and n <= 19 and luhn(digits),
        "separators_mixed": len(set(re.sub(r"[0-9()]", "", s))) > 1, "dots_only": set(re.sub(r"[0-9]", "", s)) == {"."}, "dashes": "-" in s, "spaces": " " in s,
        "letters": re.search(r"[^\W\d_]", s) and not spelled, "slash_colon_comma": re.search(r"[/:,;]", s), "phone_near": near["phone"], "card_near": near["card"], "mail_near": near["mail"],
        "digit_beside": before[-1:].isdigit() or after[:1].isdigit(), "letter_beside": before[-1:].isalpha() or after[:1].isalpha(),
        "decimal_beside": re.search(r"[0-9][.,:/-]$", before) or re.match(r"[.,:/-][0-9]", after), "short_groups": runs and max(map(len, runs)) < 3,
        "date_like": re.fullmatch(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./](?:19|20)\d\d", s), "trunk_zero": s.startswith("0"),
        "phone_near_7_15": near["phone"] and 7 <= n <= 15 and not re.search(r"[^\W\d_]", s), "card_near_12_19": near["card"] and 12 <= n <= 19, "groups_9_15": _GROUPS.fullmatch(s) and 9 <= n <= 15, "spelled_digits": spelled and n,
        "goes_on": spelled and _GOES_ON.match(text, b), "joined_before": spelled and re.search(r"[\w.%+-]$", before),
    }
    for name, value in on.items():
        if value:
            x[_AT[name]] = 1
    return x


def _left(text: str, at: int) -> int:
    """Where the MAX_TOKENS-th whole token before ``at`` begins, or its line."""
    line, reach = text.rfind("\n", 0, at) + 1, 160
    while True:
        a = max(line, at - reach)
        starts = [m.start() for m in _TOKEN.finditer(text, a, at) if m.start() > a or a == line]  # one that begins at the cut may be a part
        if len(starts) > MAX_TOKENS:
            return starts[-MAX_TOKENS - 1]
        if a == line:
            return line
        reach *= 4


def _right(text: str, at: int) -> int:
    """Where the MAX_TOKENS-th token after ``at`` ends, or the last one of its line."""
    for k, m in enumerate(_TOKEN.finditer(text, at)):
        if k > MAX_TOKENS or "\n" in text[at : m.start()]:
            break
        at = m.end()
    return at


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of the stretches in which candidates can lie: whole tokens around anchors, joined where they meet."""
    stretch = None
    for m in _ANCHOR.finditer(text):
        a = stretch[1] if stretch and m.start() <= stretch[1] else _left(text, m.start())
        if stretch and a <= stretch[1]:
            stretch = (stretch[0], max(stretch[1], _right(text, m.end())))
        else:
            if stretch:
                yield [t.span() for t in _TOKEN.finditer(text, *stretch)]
            stretch = (a, _right(text, m.end()))
    if stretch:
        yield [t.span() for t in _TOKEN.finditer(text, *stretch)]


#: Features of a number that only reading the span tells; a bound takes those that help as given.
_UNREAD = ("short_groups", "dots_only", "trunk_zero", "letter_beside", "digit_beside", "decimal_beside", "date_like", "separators_mixed")


class Bound:
    """Whether a number could score above outside, from what is known of it before it is read; weights decide, so no candidate that could win is left out."""

    def __init__(self, weights: np.ndarray):
        self.w, self.known = weights, {}

    def may_win(self, n: int, runs: int, letters: bool, marks: bool, space: bool, dash: bool, bracket: bool, near: tuple[bool, bool, bool]) -> bool:
        """``n`` digits in ``runs`` runs; letters, one of ``/:,;``, a space, a dash among them; a bracket first; words before it."""
        key = (min(n, 20), min(runs, 4), letters, marks, space, dash, bracket, near)
        if key not in self.known:
            self.known[key] = self._highest(*key) > 0
        return self.known[key]

    def _highest(self, n, runs, letters, marks, space, dash, bracket, near) -> float:
        phone, card, mail = near
        on = {
            "bias": True, "digits_lt7": n < 7, "digits_7_8": 7 <= n <= 8, "digits_9_15": 9 <= n <= 15, "digits_12_19": 12 <= n <= 19, "digits_gt19": n > 19, "letters": letters, "slash_colon_comma": marks,
            "spaces": space, "dashes": dash, "one_group": runs == 1, "phone_near": phone, "card_near": card, "mail_near": mail,
            "phone_near_7_15": phone and 7 <= n <= 15 and not letters, "card_near_12_19": card and 12 <= n <= 19,
        }
        perhaps = [*_UNREAD, *["parens"] * bracket, *["luhn"] * (12 <= n <= 19), *(["groups"] if runs == 3 and not letters else []), *(["groups_9_15"] if runs == 3 and not letters and 9 <= n <= 15 else [])]
        score = sum(self.w[_AT[f]] for f, is_on in on.items() if is_on) + sum(np.maximum(self.w[_AT[f]], 0) for f in perhaps)
        return float(score.max())


def lattice(text: str, tokens: list[tuple[int, int]], bound: Bound | None = None) -> tuple[semicrf.Lattice, list[tuple[int, int]]]:
    """Candidate spans of a window: 7 digits or more or a spelled address, from a letter, digit or bracket to a letter or digit; with ``bound``, numbers that it rules out are left out."""
    starts, ends, feats, spans = [], [], [], []
    kinds = [("d" if text[a].isdigit() and text[a] in "0123456789" else "w" if text[a].isalpha() else text[a]) for a, _ in tokens]
    digits = [b - a if k == "d" else 0 for (a, b), k in zip(tokens, kinds, strict=True)]
    ats = [k for k, (a, b) in enumerate(tokens) if b - a == 2 and text[a:b].lower() == "at"]
    for i, first in enumerate(kinds):
        if first not in ("d", "w", "("):
            continue
        if first == "w" and not any(i < k < i + MAX_TOKENS for k in ats):
            continue  # what begins with a letter must be a spelled address
        count, marks, runs = 0, 0, 0
        letters = signs = space = dash = False
        near = None
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            count += digits[j]
            runs += digits[j] > 0
            letters |= kinds[j] == "w"
            signs |= kinds[j] in "/:,;"
            dash |= kinds[j] == "-"
            space |= j > i and " " in text[tokens[j - 1][1] : tokens[j][0]]
            word = text[slice(*tokens[j])].lower() if kinds[j] == "w" else ""
            marks += word == "at"
            if j > i and "\n" in text[tokens[j - 1][1] : tokens[j][0]]:
                break
            if kinds[j] not in ("d", "w"):
                continue
            numeric = count >= 7 and first != "w" and kinds[j] == "d"
            if numeric and bound:
                if near is None:
                    before = text[max(0, tokens[i][0] - 32) : tokens[i][0]]
                    near = tuple(bool(p.search(before)) for p in _WHERE.values())
                numeric = bound.may_win(count, runs, letters, signs, space, dash, first == "(", near)
            if numeric or first == "w" and marks and j > i + 2 and _SPELLED.fullmatch(text, tokens[i][0], tokens[j][1]):
                starts.append(i)
                ends.append(j + 1)
                spans.append((tokens[i][0], tokens[j][1]))
                feats.append(span_features(text, tokens[i][0], tokens[j][1]))
    return semicrf.Lattice(len(tokens), starts, ends, np.array(feats) if feats else np.zeros((0, len(FEATURES)))), spans


def field_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, type, end) that the semi-Markov field picks."""
    out, bound = [], Bound(weights)
    for tokens in windows(text):
        window, spans = lattice(text, tokens, bound)
        if spans:
            out += [(tokens[a][0], kind, tokens[b - 1][1]) for a, b, kind in semicrf.decode(window, weights)]
    return out


def find(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans); the field's are the parts of its spans that no base span covers, of at least REST letters and digits where one covers the rest."""
    base = base_spans(text)
    added = []
    for a, k, b in field_spans(text, weights):
        parts = list(uncovered(text, a, b, base))
        added += [(s, len(TYPES) + k, e) for s, e in parts if (s, e) == (a, b) or sum(map(str.isalnum, text[s:e])) >= REST]
    return base, sorted(base + added)


def model() -> np.ndarray:
    return np.array(json.loads(MODEL.read_text())["weights"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end, base) of every text."""
    weights = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                _, spans = find(text.as_py() or "", weights)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < len(TYPES)} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


# --- training ---------------------------------------------------------------------------------


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A line with marked entities, among dates, prices, versions, ids and other numbers that are none."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a=2, b=9: "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(a, b)))

    def card() -> str:
        body = number(15)
        last = next(c for c in "0123456789" if luhn(body + c))
        s = body + last
        return rng.choice([s, " ".join(s[k : k + 4] for k in range(0, 16, 4)), "-".join(s[k : k + 4] for k in range(0, 16, 4))])

    def phone() -> str:
        return rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"{number(3)}.{number(3)}.{number(4)}"])

    def mail() -> str:
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot ")])
        end = rng.choice(["com", "org", "net", "de", f"co{dot}uk", f"com{dot}br"])
        return f"{word()}{rng.choice(['', '.' + word(), '_' + word(), number(2)])}{at}{word()}{rng.choice(['', dot + word()])}{dot}{end}"

    def other() -> str:
        return rng.choice(
            [
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
                lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}",
                lambda: number(rng.randint(1, 19)),
                lambda: f"{number(3)},{number(3)},{number(3)}.{number(2)}",
                lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 999)}",
                lambda: f"ISBN {number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
                lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d} {number(4)}",
                lambda: f"{number(4)}/{number(5)}/{number(3)}",
                lambda: f"{word()}{number(rng.randint(2, 9))}",
                lambda: f"{number(2)} {number(3)} {number(2)} {number(1)}",
                lambda: f"{rng.randint(1, 99)} at {word()} {word()}",
                lambda: f"{word()} at {word()} {word()}",
                lambda: f"{number(4)}-{number(4)}",
                lambda: " ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(3, 8))),
            ]
        )()

    text, spans = "", []
    for _ in range(rng.randint(2, 7)):
        kind = rng.random()
        if kind < 0.12:
            text += rng.choice(["call ", "tel: ", "phone ", "fax ", "", ""])
            s, k = phone(), 3
        elif kind < 0.2:
            text += rng.choice(["card ", "visa ", "credit card: ", ""])
            s, k = card(), 2
        elif kind < 0.3:
            text += rng.choice(["mail ", "contact ", "", ""])
            s, k = mail(), 0
        elif kind < 0.55:
            s, k = other(), -1
        else:
            s, k = " ".join(word() for _ in range(rng.randint(1, 5))), -1
        if k >= 0:
            spans.append((len(text), k, len(text) + len(s)))
        text += s + rng.choice([" ", ", ", ". ", " and "])
    return text, spans


def train(seed: int = 11, lines: int = 700) -> np.ndarray:
    rng, rows = random.Random(seed), []
    for _ in range(lines):
        text, spans = invented(rng)
        truth_of = {(a, b): k for a, k, b in spans}
        for tokens in windows(text):
            window, candidates = lattice(text, tokens)
            if candidates:
                truth = np.zeros((len(candidates), len(TYPES)))
                for c, span in enumerate(candidates):
                    if span in truth_of:
                        truth[c, truth_of[span]] = 1
                rows.append((window, truth))
    return semicrf.fit(rows, len(TYPES))


def main() -> None:
    MODEL.parent.mkdir(exist_ok=True)
    MODEL.write_text(json.dumps({"features": FEATURES, "types": TYPES, "weights": np.round(train(), 4).tolist()}, indent=1) + "\n")


if __name__ == "__main__":
    main()
