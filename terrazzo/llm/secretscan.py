"""Secret scan: fixed patterns, and a linear-chain CRF that tags tokens as secret begin, inside or outside.

The patterns (``assign``, ``access``, ``hex``) are always reported.  The chain adds
spans (kind ``crf``) where token shape, the words on both sides and features of the whole
text speak for a secret: those parts of them that no pattern covers.

A token is a run without white space, quotes, brackets, ``, ; : =`` and ``|``.  Tokens
that are plain words (1 to 15 letters without inner capitals, perhaps stops after them) or
junk words (such a word, or none, with symbols behind it) are outside on every
best path: ``ChainCRF.certain`` proves that from the weights when the model is loaded.
So decoding runs only over the other tokens.  Those with none of the proven ones between
them are one run, whatever punctuation parts them, and a run's neighbour on both sides has
the proven label, so the labels are those of the Viterbi path of the whole text.

The weights in ``models/secrets.json`` come from ``train`` on invented sentences.

Defined results: null is the empty text; empty tables give no rows; positions are
code points, ends exclusive; repeated rows, and rows with a null doc_id, are read one by
one; a text of any length is read whole; the chain's spans overlap neither each other nor
a pattern's, while spans of two patterns may overlap; spans are listed by start, then kind,
and of equally good paths the one with the smaller labels counts; ``scan`` reads doc_id and
text alone, ``redact`` hands on all columns, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.crf import ChainCRF, fit
from terrazzo.llm.workers import tidy

MODEL = Path(__file__).parent / "models" / "secrets.json"
# The base patterns, in the order that ties are listed in.
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # of maximal runs those that are long enough

_STOP = r"""\s"'`,;:=(){}<>\[\]|"""
_TOKEN = re.compile(rf"[^{_STOP}]+")
_WORD = r"(?:[^\W\d_][^\W\d_A-Z]{0,14}|[A-Z]{1,15})[.!?]{0,2}"
_PLAIN = re.compile(_WORD)
#: A word (or nothing) with junk symbols behind it.
_MARKS = r"(?:[^\W\d_][^\W\d_A-Z]{0,14}|[A-Z]{1,15})?[.!?]?[#*$%&]{1,9}"
_JUNK_WORD = re.compile(_MARKS)
#: A token that is neither a plain word nor a junk word.
_ODD = re.compile(rf"(?<![^{_STOP}])(?!(?:{_WORD}|{_MARKS})(?![^{_STOP}]))[^{_STOP}]+")
#: A run without white space whose only tokens are plain or junk words.
_CALM = re.compile(rf"""["'`(\[|=]*(?:{_WORD}|{_MARKS})?["'`,;:)\]|=]*(?:[#*$%&]{{1,9}})?""")
_KEY = re.compile(r"(?i)pass(?:word|wd|phrase)?\b|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|auth|bearer|private[_ -]?key")
# How keys of well-known services begin.
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|xox[abprs]-|AIza|eyJ|ya29\.|npm_|pypi-|SG\.)")
_JUNK = re.compile(r"[#*$%&~^]")
_FILE = re.compile(r"[{};]\s*$|^\s*(?:import|export|def|var|const|let)\s", re.M)

FEATURES = (
    "bias", "plain", "len8", "len16", "len24", "len32", "digit", "inner_upper", "lower", "letter_digit", "hex", "base64", "prefix", "diverse",
    "digits_only", "few_digits", "junk", "address", "letters_only", "key_near", "after_sign", "after_quote", "before_quote", "is_key",
    "file_code", "file_key", "key_and_mixed", "sign_and_mixed", "long_mixed", "long_mixed_case", "snake", "junk_word",
    "key_before", "key_behind", "word_before", "word_behind", "call_or_path", "code_and_quoted",
)
_AT = {n: k for k, n in enumerate(FEATURES)}
OUTSIDE, BEGIN, INSIDE = range(3)


def file_features(text: str) -> list[int]:
    """Features of the whole text: does it look like code, does it speak of keys."""
    return [_AT[n] for n, on in (("file_code", _FILE.search(text)), ("file_key", _KEY.search(text))) if on]


#: The words beside a token, on its own line.
_BEFORE = re.compile(rf"([^{_STOP}]+)[{_STOP.replace(chr(92) + 's', ' ' + chr(92) + 't')}]*$")
_BEHIND = re.compile(rf"[{_STOP.replace(chr(92) + 's', ' ' + chr(92) + 't')}]*([^{_STOP}]+)")


def token_features(text: str, start: int, end: int, file: list[int]) -> np.ndarray:
    x = np.zeros(len(FEATURES))
    w = text[start:end]
    body, n = w.rstrip(".!?"), end - start
    before = text[max(0, start - 48) : start]
    gap = before.rstrip(" \t\"'`")
    line = before[before.rfind("\n") + 1 :]
    key = bool(_KEY.search(line))
    left, right = _BEFORE.search(line), _BEHIND.match(text, end, end + 32)
    left, right = (m[1].rstrip(".!?") if m else "" for m in (left, right))
    plain = bool(_PLAIN.fullmatch(w) or _JUNK_WORD.fullmatch(w))
    digits = sum(c in "0123456789" for c in body)
    letters = sum(c.isalpha() for c in body)
    mixed = digits >= 2 and letters >= 2
    long_mixed = mixed and len(body) >= 16 and not _JUNK.search(body)
    on = {
        "bias": True, "plain": _PLAIN.fullmatch(w), "len8": n >= 8, "len16": n >= 16, "len24": n >= 24, "len32": n >= 32,
        "digit": digits, "inner_upper": re.search(r"(?<=[a-z0-9])[A-Z]", body), "lower": re.search(r"[a-z]", body), "letter_digit": mixed,
        "hex": digits and len(body) >= 8 and re.fullmatch(r"[0-9a-fA-F]+", body), "base64": len(body) >= 12 and mixed and re.fullmatch(r"[A-Za-z0-9+/_.-]+", body),
        "prefix": _PREFIX.match(w) and not plain, "diverse": len(body) >= 16 and len(set(body)) >= 10, "digits_only": digits and digits >= 0.8 * len(body), "few_digits": digits and digits < 0.15 * len(body),
        "junk": _JUNK.search(w), "address": re.search(r"@|//|www\.|\.(?:com|org|net|html?)\b", w), "letters_only": body.isalpha(),
        "key_near": key, "after_sign": gap.endswith(("=", ":")), "after_quote": before.endswith(("'", '"', "`")), "before_quote": text[end : end + 1] in ("'", '"', "`") and end < len(text),
        "is_key": _KEY.fullmatch(body), "key_and_mixed": key and mixed, "sign_and_mixed": mixed and gap.endswith(("=", ":")),
        "long_mixed": long_mixed, "long_mixed_case": long_mixed and re.search(r"[a-z]", body) and re.search(r"[A-Z]", body), "snake": re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+)+", body), "junk_word": _JUNK_WORD.fullmatch(w),
        "key_before": _KEY.search(left), "key_behind": _KEY.search(right), "word_before": _PLAIN.fullmatch(left), "word_behind": _PLAIN.fullmatch(right),
        "call_or_path": "/" in w and not re.search(r"[0-9+]", body) or text[end : end + 1] == "(" or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", body),
        "code_and_quoted": _AT["file_code"] in file and before.endswith(("'", '"', "`")),
    }
    for name, value in on.items():
        if value:
            x[_AT[name]] = 1
    x[file] = 1
    return x


@lru_cache(maxsize=1)
def model() -> ChainCRF:
    held = json.loads(MODEL.read_text())
    crf = ChainCRF(held["emit"], held["move"])
    if not proven(crf):
        raise ValueError("the weights do not prove plain words outside; train again")
    return crf


def proven(crf: ChainCRF) -> bool:
    """Plain words and junk words are outside on every best path."""
    (plain, plain_perhaps), (junk, junk_perhaps) = PROVEN
    at = lambda names: [_AT[n] for n in names]
    return crf.certain(at(plain), at(plain_perhaps), OUTSIDE) and crf.certain(at(junk), at(junk_perhaps), OUTSIDE)


_AROUND = (
    "len8", "len16", "lower", "address", "key_near", "after_sign", "after_quote", "before_quote", "file_code", "file_key",
    "key_before", "key_behind", "word_before", "word_behind", "call_or_path", "code_and_quoted",
)
#: The features that plain words, and junk words, always have, and those that they may have.
PROVEN = ((("bias", "plain"), (*_AROUND, "letters_only", "is_key")), (("bias", "junk", "junk_word"), (*_AROUND, "len24", "diverse")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found, low = [], text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def chain_labels(text: str, crf: ChainCRF) -> Iterator[tuple[int, int, int]]:
    """(start, end, label) of the tokens that are not proven outside; a token that is, between two of them, is given with its label too."""
    if all(map(_CALM.fullmatch, set(text.split()))):
        return
    runs: list[list[tuple[int, int]]] = []
    for m in _ODD.finditer(text):
        if runs and not _TOKEN.search(text, runs[-1][-1][1], m.start()):
            runs[-1].append(m.span())
        else:
            runs.append([m.span()])
    file = file_features(text) if runs else []
    for run in runs:
        yield run[0][0], run[0][0], OUTSIDE
        labels = crf.decode(np.array([token_features(text, a, b, file) for a, b in run]), OUTSIDE)
        for (a, b), label in zip(run, labels.tolist(), strict=True):
            yield a, b, label


def chain_spans(text: str, crf: ChainCRF) -> list[tuple[int, int]]:
    """Spans that the chain tags: a begin (or an inside after an outside) with the insides behind it."""
    spans, open_ = [], False
    for a, b, label in chain_labels(text, crf):
        b -= len(text[a:b]) - len(text[a:b].rstrip(".!?"))
        if label == INSIDE and open_:
            spans[-1] = (spans[-1][0], b)
        elif label != OUTSIDE:
            spans.append((a, b))
        open_ = label != OUTSIDE
    return spans


def uncovered(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of [a, b) that none of the sorted ``base`` spans covers, without the white space around them."""
    for s, e in [(s, e) for s, _, e in base if s < b and a < e] + [(b, b)]:
        part = text[a : max(a, s)]
        if part.strip():
            yield a + len(part) - len(part.lstrip()), a + len(part.rstrip())
        a = max(a, e)


def find(text: str, crf: ChainCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end); the chain's are the parts of its spans that no base span covers."""
    base = base_spans(text)
    added = [(s, 3, e) for a, b in chain_spans(text, crf) for s, e in uncovered(text, a, b, base)]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end) of every text; ``base`` tells the fixed patterns' spans."""
    crf = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                _, spans = find(text.as_py() or "", crf)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span (overlapping or adjoining ones together) replaced; other columns as they are, n_chars counted anew where there is one."""
    crf, schema = model(), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                text, parts, at = text.as_py(), [], 0
                for a, _, b in find(text or "", crf)[1]:
                    if a > at or not parts:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                texts.append("".join([*parts, text[at:]]) if parts else text)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                same = pa.array(sizes, columns["n_chars"].type)
                changed = pa.array([t != o.as_py() for t, o in zip(texts, batch.column("text"), strict=True)])
                columns["n_chars"] = pa.compute.if_else(changed, same, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(tidy(run), schema)


def digest(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


# --- training ---------------------------------------------------------------------------------


def invented(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line with marked secrets, among words, numbers, addresses and identifiers that are none."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda a=2, b=9: pick("etaoinshrdlucmfwypvbgk", rng.randint(a, b))
    mixed = string.ascii_letters + string.digits

    def secret() -> str:
        return rng.choice(
            [
                lambda: pick(mixed, rng.randint(20, 44)),
                lambda: pick(mixed + "+/", rng.randint(32, 44)),
                lambda: "ghp_" + pick(mixed, 36),
                lambda: "sk_live_" + pick(mixed, 24),
                lambda: "AIza" + pick(mixed + "_-", 35),
                lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24),
                lambda: "glpat-" + pick(mixed, 20),
                lambda: "eyJ" + pick(mixed, 17) + "." + pick(mixed, 30) + "." + pick(mixed + "_-", 27),
                lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])),
                lambda: pick("0123456789ABCDEF", rng.choice([32, 40])),
            ]
        )()

    def other() -> str:
        return rng.choice(
            [
                lambda: pick(string.digits, rng.randint(1, 19)),
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
                lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                lambda: f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example.com",
                lambda: f"https://{word()}.example.org/{word()}/{rng.randint(1, 999)}?{word()}",
                lambda: word() + rng.choice(["###", "***", "$$$", "%%%", "&&&"]),
                lambda: word(16, 40),
                lambda: word().capitalize() + word().capitalize() + word().capitalize(),
                lambda: "_".join(word() for _ in range(rng.randint(2, 5))),
                lambda: "-".join(word() for _ in range(rng.randint(2, 4))) + rng.choice(["", "-2"]),
                lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-rc{rng.randint(1, 9)}",
                lambda: f"/{word()}/{word()}/{word()}_{rng.randint(1, 99)}.txt",
                lambda: f"{rng.randint(1, 999)}{word(1, 3)}",
                lambda: word(3, 8).upper() + str(rng.randint(1, 99)),
                lambda: pick("0123456789abcdef", rng.randint(4, 10)),
                lambda: f"{word()}'{word(1, 2)}",
            ]
        )()

    parts: list[tuple[str, bool]] = []
    name = lambda: rng.choice([word(3, 8), word(3, 6) + "_" + word(3, 6), word(3, 6) + word(3, 6).capitalize()])
    code = rng.random() < 0.25
    for _ in range(rng.randint(3, 12)):
        kind = rng.random()
        if code and kind < 0.5:
            parts += [("\n" + rng.choice(["", "  ", "const ", "let ", "import ", "export ", "def ", "return "]), False)]
            odd = rng.random()
            if odd < 0.2:
                key = rng.choice(["apiKey", "api_key", "db_password", "AUTH_TOKEN", "clientSecret", "secret", "private_key", "accessKey", "BEARER"])
                quote = rng.choice(['"', "'", ""])
                parts += [(key + rng.choice([" = ", ": ", "=", " => "]) + quote, False), (secret(), True), (quote + rng.choice([";", ",", ""]), False)]
            elif odd < 0.3:
                parts += [(f'{word()}("', False), (secret(), True), ('")', False)]
            else:
                parts += [(f"{name()}.{name()}" + rng.choice(["(", " = ", " + "]) + rng.choice(['"' + other() + '"', other(), name()]) + rng.choice([");", ";", " {", ","]), False)]
            parts += [("\n", False)]
        elif kind < 0.12:
            key = rng.choice(["password", "secret key", "access_key", "auth token", "api key", "credential", "pwd", "bearer", "private key"])
            value = secret() if rng.random() < 0.8 else rng.choice([pick(mixed + "!_", rng.randint(8, 14)) + "7x", pick(mixed, 12) + "4"])
            lead = rng.choice([" = ", ": ", " ", ' = "', " is ", "="])
            parts += [(key + lead, False), (value, True), ('"' if lead.endswith('"') else "", False), (" ", False)]
        elif kind < 0.2:
            parts += [(secret(), True), (rng.choice([" ", ". ", "\n"]), False)]
        elif kind < 0.22:
            parts += [("-----BEGIN PRIVATE KEY-----\n", False)]
            parts += [x for k in range(rng.randint(2, 4)) for x in ((pick(mixed + "+/", 64), True), ("\n", None))]
        elif kind < 0.5:
            parts += [(other(), False), (rng.choice([" ", ", ", ". "]), False)]
        else:
            parts += [(w, False) for _ in range(rng.randint(1, 5)) for w in (rng.choice([word(), word().capitalize(), rng.choice(["secret", "token", "key", "the", "password"])]), rng.choice([" ", " ", ", ", ". "]))]
    text, spans, glue = "", [], False
    for piece, is_secret in parts:
        if is_secret:
            if glue:
                spans[-1] = (spans[-1][0], len(text) + len(piece))
            else:
                spans.append((len(text), len(text) + len(piece)))
        glue = is_secret is None and bool(spans) and spans[-1][1] == len(text)
        text += piece
    return text, spans


def sequence(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    file, xs, ys = file_features(text), [], []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        inside = next((s for s in spans if a < s[1] and s[0] < b), None)
        xs.append(token_features(text, a, b, file))
        ys.append(OUTSIDE if inside is None else BEGIN if a <= inside[0] else INSIDE)
    return np.array(xs), np.array(ys, dtype=np.int64)


def train(seed: int = 7, lines: int = 1500) -> ChainCRF:
    rng = random.Random(seed)
    rows = [s for s in (sequence(*invented(rng)) for _ in range(lines)) if len(s[1])]
    crf = fit(rows, 3, steps=200, decay=0.0005)
    while not proven(crf):  # no plain or junk word of the sentences is a secret: their bias is raised until that holds for every text
        crf.emit[[_AT["plain"], _AT["junk_word"]], OUTSIDE] += 0.25
    return crf


def main() -> None:
    crf = train()
    MODEL.parent.mkdir(exist_ok=True)
    MODEL.write_text(json.dumps({"features": FEATURES, "emit": np.round(crf.emit, 4).tolist(), "move": np.round(crf.move, 4).tolist()}, indent=1) + "\n")


if __name__ == "__main__":
    main()
